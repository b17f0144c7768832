"""MinHash near-dedup with odd sketches.

Each document's set of 5-word shingles gives MinHash samples, folded into an odd
sketch: bit h(i, sample_i) holds the parity of the samples that fall on it.  The
population count of two sketches' XOR estimates the similarity, most precisely
where it is high, and so screens banded candidates before the exact comparison
of full sets.

Scale: equal sets collapse to one class first (a combined aggregate), so copies
are never paired.  A bucket's members are compared with two hubs of the bucket,
not with each other; only where a bucket then still holds more than one
component are the members outside its main component compared with the rest.
Components come from large-star and small-star rounds over stored edge tables.
No bucket, class or component is ever gathered in one task or on the driver.

Defined results: a document without words (or text) has an empty set and links
with nothing; with fewer than five words its whole sequence is its one shingle;
repeated rows with one doc_id count as one document; a null doc_id links with
nothing, has a null component and is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.common import WORD, WordHash, lower_words, map_rows, mixed, shingle_hashes, signed, stored, table

SHINGLE = 5
#: A pair of sets of similarity 0.75 shares no band with a chance of 5e-6.
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
SIMILARITY = (75, 100)
#: The screen lets estimates pass that are this far below the threshold: 5 standard errors.
MARGIN = 0.25
#: Candidate ids that may be broadcast (8 bytes each); more are shuffled.
BROADCAST_IDS = 2_000_000
#: Rounds in which members outside their bucket's main component meet more of its hubs.
MOST_TURNS = 6
_BLOCK = 1 << 16

#: Where members of a bucket meet all others, sketches of more samples screen more closely.
FINE_SAMPLES, FINE_BITS, FINE_MARGIN = 1024, 4096, 0.08

_RNG = np.random.default_rng(20240607)
_XOR = _RNG.integers(0, 1 << 63, FINE_SAMPLES, np.int64).view(np.uint64)
_MUL = _RNG.integers(0, 1 << 63, FINE_SAMPLES, np.int64).view(np.uint64) | np.uint64(1)
_SALT = mixed(np.arange(1, FINE_SAMPLES + 1).astype(np.uint64))


def shingles(words: list[bytes], hashes: WordHash, k: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of a document's k-word shingles, with repeats."""
    if not words:
        return np.empty(0, np.uint64)
    codes = hashes.array(words)
    if len(words) < k:
        return mixed(shingle_hashes(codes, len(words)) ^ np.uint64(len(words)))
    return shingle_hashes(codes, k)


def minhashes(grams: np.ndarray, starts: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """Samples of several non-empty sets laid end to end: one row a set."""
    out = np.empty((len(starts), samples), np.uint64)
    for i in range(samples):
        out[:, i] = np.minimum.reduceat((grams ^ _XOR[i]) * _MUL[i], starts)
    return out


def odd_sketches(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmaps of the samples, as bits / 64 words a row."""
    bit = (mixed(samples ^ _SALT[: samples.shape[1]]) % np.uint64(bits)).astype(np.int64)
    row = np.arange(len(samples))[:, None] * bits
    parity = np.bincount((row + bit).ravel(), minlength=len(samples) * bits) & 1
    return np.packbits(parity.astype(np.uint8).reshape(len(samples), -1), axis=1).view(np.uint64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    acc = np.zeros((len(samples), BANDS), np.uint64) + _SALT[:BANDS]
    for r in range(ROWS):
        acc = mixed(acc ^ samples[:, r::ROWS][:, :BANDS])
    return acc


def estimate(differing: np.ndarray, samples: int = SAMPLES, bits: int = SKETCH_BITS) -> np.ndarray:
    """Similarity from the population count of two sketches' XOR."""
    share = np.clip(1 - 2 * np.asarray(differing) / bits, 1e-9, 1)
    return 1 + bits / (4 * samples) * np.log(share)


def _most_differing(samples: int = SAMPLES, bits: int = SKETCH_BITS, margin: float = MARGIN) -> int:
    counts = np.arange(bits // 2)
    return int(counts[estimate(counts, samples, bits) >= SIMILARITY[0] / SIMILARITY[1] - margin].max())


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n (set size), digest of the set, band keys and odd sketch."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        hashes = WordHash()

        def flush(held: list[tuple]) -> dict:
            full = [(g, h) for _, g, h, *_ in held if len(g)]
            if full:
                lengths = np.array([len(g) for g, _ in full])
                samples = minhashes(np.concatenate([g for g, _ in full]), np.r_[0, np.cumsum(lengths)[:-1]])
                keys, odd = iter(signed(band_keys(samples))), iter(signed(odd_sketches(samples)))
            return {
                "doc_id": [x[0] for x in held],
                "n": [x[2] for x in held],
                "d1": [x[3] for x in held],
                "d2": [x[4] for x in held],
                "bands": [next(keys) if x[2] else None for x in held],
                "sketch": [next(odd) if x[2] else None for x in held],
            }

        for b in batches:
            held: list[tuple] = []
            total = 0
            for doc, body in zip(b["doc_id"], b[text], strict=True):
                grams = np.unique(shingles(lower_words(body), hashes))
                digest = xxhash.xxh3_128_intdigest(grams.tobytes())
                held.append((doc, grams, len(grams), (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63)))
                total += len(grams)
                if total >= _BLOCK:
                    yield flush(held)
                    held, total = [], 0
            if held:
                yield flush(held)

    schema = "doc_id long, n long, d1 long, d2 long, bands array<long>, sketch array<long>"
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text), run, schema)


def _sets(docs: DataFrame, text: str) -> DataFrame:
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        hashes = WordHash()
        for b in batches:
            for s in range(0, len(b["doc_id"]), 256):
                part = [np.unique(shingles(lower_words(t), hashes)) for t in b[text][s : s + 256]]
                yield {"id": b["doc_id"][s : s + 256], "set": [signed(x) for x in part]}

    return map_rows(docs, run, "id long, set array<long>")


def _fine_sketches(docs: DataFrame, text: str) -> DataFrame:
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        hashes = WordHash()
        for b in batches:
            for s in range(0, len(b["doc_id"]), 64):
                part = [np.unique(shingles(lower_words(t), hashes)) for t in b[text][s : s + 64]]
                starts = np.r_[0, np.cumsum([len(x) for x in part])[:-1]].astype(np.int64)
                samples = minhashes(np.concatenate(part), starts, FINE_SAMPLES)
                yield {"id": b["doc_id"][s : s + 64], "fine": list(signed(odd_sketches(samples, FINE_BITS)))}

    return map_rows(docs, run, "id long, fine array<long>")


# ---------------------------------------------------------------- pairs


def _near(a: str, b: str) -> Column:
    """The sketch screen, with the exact bound that the set sizes give."""
    words = range(SKETCH_BITS // 64)
    differing = sum((F.bit_count(F.get(f"{a}.sketch", F.lit(i)).bitwiseXOR(F.get(f"{b}.sketch", F.lit(i)))) for i in words), F.lit(0))
    top, base = SIMILARITY
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (base * small >= top * large) & (differing <= _most_differing())


def _finely_near(a: str, b: str) -> Column:
    bits = F.zip_with(f"{a}.fine", f"{b}.fine", lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(bits, F.lit(0), lambda t, x: t + x) <= _most_differing(FINE_SAMPLES, FINE_BITS, FINE_MARGIN)


def _chosen(docs: DataFrame, ids: DataFrame, text: str) -> DataFrame:
    """The documents of the (distinct) ids."""
    ids = stored(ids, "candidates")
    small = ids.count() <= BROADCAST_IDS
    return docs.where(F.col(text).rlike(WORD)).join(F.broadcast(ids) if small else ids, "doc_id", "left_semi").select("doc_id", text)


def _confirmed(pairs: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity; compared inside the JVM."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = stored(_sets(_chosen(docs, ids, text), text), "sets")
    a = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    top, base = SIMILARITY
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(b.hint("merge"), "b")
        .join(a.hint("merge"), "a")
        .withColumn("both", both)
        .where(base * F.col("both") >= top * (F.size("sa") + F.size("sb") - F.col("both")))
        .select("a", "b")
        .distinct()
    )


def _screened(stars: DataFrame, sketches: DataFrame) -> DataFrame:
    """Different pairs (a, b) of (id, hub) rows that the sketches don't rule out."""
    pairs = stars.where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    return stored(
        pairs.join(sketches.withColumnRenamed("id", "a").alias("x").hint("merge"), "a")
        .join(sketches.withColumnRenamed("id", "b").alias("y").hint("merge"), "b")
        .where(_near("x", "y"))
        .select("a", "b"),
        "pairs",
    )


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes with an edge; component: the least node.

    Large-star and small-star rounds until the edges no longer change; each round
    is a combined minimum by node and a join, over stored tables.
    """

    def star(e: DataFrame, larger: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else e
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # as a new column: the join then deals out both sides itself, so a hot node can be split
        least = least.select(F.col("u").bitwiseXOR(F.lit(0)).alias("u"), "m")
        joined = both.join(least, "u")
        moved = joined.where("v > u" if larger else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not larger:
            moved = moved.unionByName(least.where("u <> m").select("u", F.col("m").alias("v")))
        turned = moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        return turned.distinct()

    def print_of(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = stored(now, "edges")
    known = print_of(now)
    while known[0]:
        now = stored(star(star(now, True), False), "edges")
        after = print_of(now)
        if after == known:
            break
        known = after
    children = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return children.unionByName(children.select(F.col("component").alias("node"), "component").distinct())


# ---------------------------------------------------------------- the operator


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    sigs = stored(signatures(docs, text), "signatures")
    linked = sigs.where("n > 0 and doc_id is not null")
    classes = stored(
        linked.groupBy("d1", "d2").agg(
            F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
        ),
        "classes",
    )
    # rows of one doc_id with other texts, and copies, are tied to their class directly
    same = linked.join(classes.select("d1", "d2", "id").hint("merge"), ["d1", "d2"]).where("doc_id <> id")
    same = same.select(F.col("id").alias("a"), F.col("doc_id").alias("b"))

    keyed = classes.select("id", F.explode("bands").alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(keyed.join(crowded.hint("merge"), "key"), "members")
    n_members = members.count()
    sketches = classes.select("id", "n", "sketch")

    # every member meets two hubs of its bucket: the least id, and the one that shares most buckets
    score = members.groupBy("id").agg(F.sum("size").alias("score"))
    hubs = (
        members.join(score.hint("merge"), "id")
        .groupBy("key")
        .agg(F.min("id").alias("h1"), F.max_by("id", F.struct("score", -F.col("id"))).alias("h2"))
    )
    stars = members.join(hubs.hint("merge"), "key").select("id", F.explode(F.array("h1", "h2")).alias("hub"))
    links = _confirmed(_screened(stars, sketches), docs, text).unionByName(same)
    labels = stored(components(links), "components")

    # in buckets that still hold several components, members outside the main one meet other hubs of
    # the main one, drawn anew each round; once few enough are left, they meet all the others
    linking = True
    for turn in range(MOST_TURNS + 1):
        placed = members.join(labels.hint("merge"), F.col("id") == F.col("node"), "left").select(
            "key", "id", F.coalesce("component", "id").alias("component")
        )
        parts = placed.groupBy("key", "component").agg(
            F.count("*").alias("c"), F.min_by("id", F.xxhash64("id", "key", F.lit(turn))).alias("hub")
        )
        main = (
            parts.groupBy("key")
            .agg(
                F.max_by(F.struct("component", "hub"), F.struct("c", "component")).alias("main"),
                F.sum("c").alias("size"),
                F.max("c").alias("largest"),
                F.count("*").alias("parts"),
            )
            .where("parts > 1")
        )
        main = stored(main.select("key", "main.component", "main.hub", "size", (F.col("size") - F.col("largest")).alias("out")), "main")
        left = main.agg(F.sum(F.col("out") * F.col("size"))).first()[0] or 0
        if not left:
            break
        m = main.withColumnRenamed("component", "main")
        open_members = placed.join(m, "key")
        exhaust = left <= n_members or not linking or turn == MOST_TURNS
        if not exhaust:
            pairs = _screened(open_members.where("component <> main").select("id", "hub"), sketches)
        else:
            fine = _fine_sketches(_chosen(docs, open_members.select(F.col("id").alias("doc_id")).distinct(), text), text)
            fine = stored(fine, "fine").dropDuplicates(["id"])
            known = open_members.join(classes.select("id", "n", "sketch", "bands"), "id").join(fine, "id")
            known = stored(known.select("key", "id", "component", "main", "n", "sketch", "bands", "fine"), "open")
            x, y = known.where("component <> main").alias("x"), known.alias("y")
            met = x.join(
                y,
                (F.col("x.key") == F.col("y.key"))
                & (F.col("x.component") != F.col("y.component"))
                & ((F.col("y.component") == F.col("y.main")) | (F.col("x.id") < F.col("y.id")))
                & _near("x", "y")
                & (F.get(F.array_intersect("x.bands", "y.bands"), F.lit(0)) == F.col("x.key"))  # their first bucket
                & _finely_near("x", "y"),
            ).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
            pairs = stored(met.distinct(), "pairs")
        tree = labels.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
        links = stored(_confirmed(pairs, docs, text), "links")
        linking = links.count() * 20 >= pairs.count()
        labels = stored(components(tree.unionByName(links)), "components")
        if exhaust:
            break
    out = sigs.join(labels.hint("merge"), F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component stays, the one with the least
    doc_id; of repeated rows with that doc_id, all stay (they are one document)."""
    gone = near_duplicates(docs.select("doc_id", "text")).where("not kept").select("doc_id").distinct()
    gone = stored(gone, "gone")
    small = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*docs.columns)


#: DuckDB: sets of shingle strings, all pairs that share one, components by recursion.
SQL = r"""
with recursive d as (
  select doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda w: w <> '') as w
  from documents
), s as (
  select distinct doc_id, hash(array_to_string(w[p : p + 4], ' ')) as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as p from d where len(w) > 0) x
), n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
sym as (select a, b from e union select b, a from e),
reach(root, node) as (
  select doc_id, doc_id from n union select reach.root, sym.b from reach join sym on sym.a = reach.node
), comp as (select node, min(root) as component_id from reach group by node)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce(component_id, d.doc_id) as component_id,
  coalesce(component_id, d.doc_id) = d.doc_id as kept
from d left join n on n.doc_id = d.doc_id left join comp on comp.node = d.doc_id
"""
