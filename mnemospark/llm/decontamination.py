"""Benchmark decontamination with one FM-index per training shard.

A shard is a bounded run of documents inside a task.  Its text becomes a
sequence over the alphabet of benchmark words (every other word is a break:
no window can contain it, so stretches shorter than the shortest window are
left out).  The shard's suffix array gives the Burrows-Wheeler transform, which
is kept in a wavelet matrix; all test windows are searched backward at once,
and occurrences are located by walking to sampled suffix positions.  Word spans
of the occurrences are merged per document.

The benchmark is broadcast in blocks of a bounded number of words; a larger
benchmark is searched block after block, over the same rows, without a shuffle.

Defined results: a null or empty text has no words and no hits; an item without
words, without text or without an id has no window; an item of fewer than
``window`` words is one window; repeated documents each get their own result and
repeated items count once an id; an empty benchmark hits nothing; other columns
pass through, those with the names of the result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mnemospark.llm.common import discard, prepare, stored, table

WINDOW = 10
#: Words of documents that one FM-index covers (a longer document is one shard).
SHARD_WORDS = 1_000_000
#: Words of benchmark text that are broadcast at once.
BLOCK_WORDS = 1_000_000
SAMPLE_EVERY = 8

#: Words are [0-9a-z] and all characters beyond ASCII, after lower-casing A-Z.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
SPANS = "array<struct<start:int,end:int>>"


def folded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass").translate(_FOLD)


# ---------------------------------------------------------------- the index


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes still tied are sorted again."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    head = np.r_[True, ranked[1:] != ranked[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))  # rank: first row of the tie
    step = 1
    while True:
        tied = ~(head & np.r_[head[1:], True])
        rows = np.flatnonzero(tied)
        if not len(rows):
            return order
        where = order[rows]
        after = where + step
        key = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        first = rank[where]
        inner = np.lexsort((key, first))  # ties keep their rows: first is the row they begin at
        order[rows] = where[inner]
        first, key = first[inner], key[inner]
        fresh = np.r_[True, (first[1:] != first[:-1]) | (key[1:] != key[:-1])]
        head[rows] = fresh
        rank[order[rows]] = np.maximum.accumulate(np.where(fresh, rows, 0))
        step *= 2


class WaveletMatrix:
    """Rank of any symbol at any place in as many steps as a symbol has bits."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        row = symbols
        for bit in reversed(range(max(1, int(sigma - 1).bit_length()))):
            ones = (row >> bit & 1).astype(bool)
            count = np.zeros(len(row) + 1, np.int32)
            np.cumsum(ones, out=count[1:])
            self.levels.append((bit, count, len(row) - int(count[-1])))
            row = np.concatenate([row[~ones], row[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        begin, at = np.zeros_like(at), at.copy()
        for bit, ones, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            begin = np.where(one, zeros + ones[begin], begin - ones[begin])
            at = np.where(one, zeros + ones[at], at - ones[at])
        return at - begin


class FmIndex:
    """FM-index of stretches of symbols 1..sigma-1, each ended by the break 0."""

    def __init__(self, sequence: np.ndarray, sigma: int, every: int = SAMPLE_EVERY):
        n = self.n = len(sequence)
        breaks = sequence == 0
        codes = sequence.astype(np.int64) + int(breaks.sum())
        codes[breaks] = np.arange(int(breaks.sum()))  # breaks differ, so no suffix is compared beyond one
        order = suffix_array(codes)
        before = np.roll(sequence, 1)  # the symbol before each place
        self.bwt = before[order]
        self.ranks = WaveletMatrix(self.bwt, sigma)
        self.first = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(sequence, minlength=sigma), out=self.first[1:])
        kept = (order % every == 0) | (self.bwt == 0)  # starts of stretches too: no walk crosses a break
        self.sample = np.where(kept, order, -1)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of equal length -> (phrase numbers found, first and end row of each)."""
        which = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in reversed(range(phrases.shape[1])):
            c = phrases[which, j]
            low, high = self.first[c] + self.ranks.rank(c, low), self.first[c] + self.ranks.rank(c, high)
            live = low < high
            which, low, high = which[live], low[live], high[live]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of the suffixes at these rows."""
        out, todo, rows, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            at = self.sample[rows]
            done = at >= 0
            out[todo[done]] = at[done] + steps
            todo, rows = todo[~done], rows[~done]
            c = self.bwt[rows]
            rows = self.first[c] + self.ranks.rank(c, rows)
            steps += 1
        return out


# ---------------------------------------------------------------- windows of the benchmark


class Phrases:
    """The windows of a block of items, as rows of symbol numbers by length."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.symbol: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            codes = [self.symbol.setdefault(w, len(self.symbol) + 1) for w in folded(text).split()]
            for s in range(max(1, len(codes) - window + 1)) if codes else ():
                owners.setdefault(tuple(codes[s : s + window]), set()).add(item)
        self.by_length: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for length in sorted({len(k) for k in owners}):
            keys = [k for k in owners if len(k) == length]
            self.by_length[length] = np.array(keys, np.int64), [sorted(owners[k]) for k in keys]
        self.shortest = min(self.by_length, default=0)


def occurrences(texts: list[np.ndarray], phrases: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, list]]:
    """For each window length: (document numbers, start words, length, phrase numbers, owners)
    of all occurrences in the documents, given as symbol numbers (0: no benchmark word)."""
    if not phrases.by_length or not texts:
        return
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    document = np.repeat(np.arange(len(texts)), lengths + 1)
    everything = np.zeros(len(document), np.int64)
    begins = np.r_[0, np.cumsum(lengths + 1)[:-1]]
    for b, t in zip(begins, texts, strict=True):
        everything[b : b + len(t)] = t
    known = everything > 0  # stretches of benchmark words that a window fits in
    edge = np.flatnonzero(np.diff(np.r_[False, known, False].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    fits = end - start >= phrases.shortest
    start, end = start[fits], end[fits]
    if not len(start):
        return
    size = end - start + 1  # with the break
    place = np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
    index = FmIndex(everything[place], len(phrases.symbol) + 1)
    for length, (rows, owners) in phrases.by_length.items():
        which, low, high = index.search(rows)
        count = high - low
        if not len(which):
            continue
        at = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(int(count.sum()))
        found = place[index.locate(at)]
        yield document[found], found - begins[document[found]], length, np.repeat(which, count), owners


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less the words of the spans and what stands between them."""
    import re

    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in re.finditer(rb"[^ ]+", folded(text))]
    out, last = [], 0
    for s, e in spans:
        out.append(raw[last : at[s][0]])
        last = at[e - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


# ---------------------------------------------------------------- over DataFrames


def find_spans(
    df: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, cut: bool = False
) -> DataFrame:
    """df with n_words, spans (merged, in words, end exclusive) and items (sorted ids).

    benchmark has item_id and text.  cut: the text column loses its spans.
    """
    spark = df.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("string").alias("item_id"), "text"
    )
    n_words = items.agg(F.sum(F.regexp_count("text", F.lit(r"[0-9A-Za-z\x80-\x{10FFFF}]+")))).first()[0] or 0
    blocks = int(n_words // BLOCK_WORDS + 1)
    df = df.drop("n_words", "spans", "items").withColumns(
        {
            "n_words": F.lit(0).cast("long"),
            "spans": F.array().cast(SPANS),
            "items": F.array().cast("array<string>"),
        }
    )
    before = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        phrases = spark.sparkContext.broadcast(Phrases([tuple(r) for r in part.collect()], window))
        df = _search(df, phrases, text, cut and k == blocks - 1)
        if k < blocks - 1:  # one block's phrases at a time, here and on the executors
            df = stored(df, "searched")
            phrases.destroy()
            if before is not None:
                discard(before)
            before = df
    return df


def _search(df: DataFrame, broadcast, text: str, cut: bool) -> DataFrame:
    schema = T.StructType(df.schema.fields)
    arrow = to_arrow_schema(schema)
    at_text = schema.fieldNames().index(text)

    def finish(held: list[tuple[pa.RecordBatch, list[np.ndarray]]], phrases: Phrases) -> Iterator[pa.RecordBatch]:
        texts = [t for _, ts in held for t in ts]
        spans: dict[int, list[tuple[int, int]]] = {}
        found: dict[int, set[str]] = {}
        for docs, starts, length, which, owners in occurrences(texts, phrases):
            for d, s, w in zip(docs.tolist(), starts.tolist(), which.tolist(), strict=True):
                spans.setdefault(d, []).append((s, s + length))
                found.setdefault(d, set()).update(owners[w])
        base = 0
        for batch, ts in held:
            columns = {c: batch.column(i) for i, c in enumerate(arrow.names)}
            hit = [d for d in range(base, base + len(ts)) if d in spans]
            columns["n_words"] = pa.array([len(t) for t in ts], pa.int64())
            if hit:
                old_spans, old_items = columns["spans"].to_pylist(), columns["items"].to_pylist()
                for d in hit:
                    i = d - base
                    old_spans[i] = [
                        {"start": s, "end": e}
                        for s, e in merged([*((x["start"], x["end"]) for x in old_spans[i]), *spans[d]])
                    ]
                    old_items[i] = sorted({*old_items[i], *found[d]})
                columns["spans"] = pa.array(old_spans, arrow.field("spans").type)
                columns["items"] = pa.array(old_items, arrow.field("items").type)
            if cut:
                body, all_spans = columns[text].to_pylist(), columns["spans"].to_pylist()
                columns[text] = pa.array(
                    [without(b, [(x["start"], x["end"]) for x in s]) if s else b for b, s in zip(body, all_spans, strict=True)],
                    arrow.field(text).type,
                )
            base += len(ts)
            yield pa.RecordBatch.from_arrays([columns[c] for c in arrow.names], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = broadcast.value
        symbol = phrases.symbol.get
        held: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []
        words = 0
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                texts = []
                for body in batch.column(at_text).to_pylist():
                    found = folded(body).split()
                    texts.append(np.fromiter(map(symbol, found, repeat(0)), np.int32, len(found)))
                    words += len(found)
                held.append((batch, texts))
                if words >= SHARD_WORDS:
                    yield from finish(held, phrases)
                    held, words = [], 0
        if held:
            yield from finish(held, phrases)

    prepare(df.sparkSession)
    return df.mapInArrow(run, schema)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    n_hit = F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"]).cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: benchmark passages are cut out of the texts; a document of
    which no word is left goes."""
    benchmark = table(spark, sf_dir, "benchmark").select("item_id", "text")
    packed = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"), "text")
    left = find_spans(packed, benchmark, cut=True)
    emptied = (F.size("spans") > 0) & ~F.col("text").rlike(r"[0-9A-Za-z\x80-\x{10FFFF}]")
    return left.where(~emptied).select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])


#: DuckDB: windows as word lists, joined to all runs of as many document words.
SQL = r"""
with d as (
  select doc_id, row_number() over () as r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), b as (
  select cast(item_id as varchar) as item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null and item_id is not null
), win as (
  select distinct item_id, array_to_string(w[s : s + 9], ' ') as body, least(10, len(w)) as n
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from b where len(w) > 0) x
), lens as (select distinct n from win),
dw as (
  select r, s, n, array_to_string(w[s : s + n - 1], ' ') as body
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as s from d, lens where len(w) >= n) x
), hit as (select r, s, dw.n, item_id from dw join win on win.n = dw.n and win.body = dw.body),
words as (select r, count(distinct p) as h from (select r, unnest(range(s, s + n)) as p from hit) x group by r),
its as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
        from (select distinct r, item_id from hit) y group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(h, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(h, 0) > 0 as contaminated
from d left join words using (r) left join its using (r)
"""
