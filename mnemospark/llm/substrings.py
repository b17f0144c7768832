"""Substring dedup with suffix automata of reference shards.

A 20-word window is removed when the same words also start earlier.  Sending
every document past an automaton of every shard would cost shards x corpus, so
documents meet only the automata that can match them:

1.  Every window picks an anchor, the least hash among its 8-word shingles, so
    equal windows pick equal anchors.  One row an anchor: where the windows that
    picked it begin and end, and a digest of those words (their context).  The
    rows are made once and stored; anchors that occur once are dropped.
2.  Contexts with equal digests route text to automata.  The first occurrence is
    reference text: a reference shard is a stretch of at most ``STRETCH`` words of
    one document, of which a suffix automaton is built.  The later occurrences,
    merged into passages, stream past it; where the matching statistic reaches the
    threshold, the window ending there is covered.  A shard with many copies is
    dealt over salts, each with the automaton and ``COPIES`` of them at most.
3.  An anchor with several different contexts is a shard as well, as their
    windows may be equal in part.  Its contexts, each once, stream in order of
    (doc_id, start) through an automaton that grows with them.  More than
    ``SHARD`` contexts are split into shards of single windows, routed as in 2.
4.  The covered spans, one list a document, cut the document's words.

Defined results: a null or empty text has no words and loses none; rows that
share a doc_id are texts of one document, in the order of a hash of theirs, and
each loses its own words; repeated rows are one text and treated alike; a row
with a null doc_id matches nothing and stays whole; an empty table gives an empty
result; other columns pass through the operator.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.common import (
    WordHash,
    discard,
    map_arrow,
    map_rows,
    mixed,
    prepare,
    shingle_hashes,
    signed,
    stored,
    table,
    words_of,
)

THRESHOLD = 20
SHINGLE = 8
#: Words (a power of two) of a reference shard, and copies of a context that one salt takes.
STRETCH, COPIES = 4_096, 200
#: Different contexts of an anchor that one automaton takes; more are split by window.
SHARD = 1_000
#: What a piece of text is for: reference or query of a shard, one of several contexts, or one to be split.
REFERENCE, QUERY, CONTEXT, SPLIT = range(4)

_BASE = np.uint64(0x9FB21C651E98DF25)
_INVERSE = np.uint64(pow(0x9FB21C651E98DF25, -1, 1 << 64))


class _Powers:
    """Powers of the context hash's base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << int(n).bit_length()
            self.up = np.r_[np.uint64(1), np.full(size, _BASE, np.uint64)].cumprod(dtype=np.uint64)
            self.down = np.r_[np.uint64(1), np.full(size, _INVERSE, np.uint64)].cumprod(dtype=np.uint64)
        return self.up, self.down


def anchors(hashes: np.ndarray, powers: _Powers, least: int = THRESHOLD, k: int = SHINGLE) -> tuple[np.ndarray, ...]:
    """(anchor, first word, end word, context digest) of each anchor of a document."""
    n = len(hashes) - least + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(np.uint64)
    grams = shingle_hashes(hashes, k)
    width = least - k + 1
    lowest = grams[:n].copy()
    for d in range(1, width):
        np.minimum(lowest, grams[d : d + n], out=lowest)
    at = np.empty(n, np.int64)
    for d in reversed(range(width)):
        hit = np.flatnonzero(grams[d : d + n] == lowest)
        at[hit] = hit + d
    begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    end = np.r_[begin[1:], n] - 1 + least
    up, down = powers.of(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    digest = mixed((total[end] - total[begin]) * down[begin] ^ (end - begin).astype(np.uint64))
    return grams[at[begin]], begin, end, digest


class Automaton:
    """Suffix automaton over several texts, grown word by word."""

    def __init__(self) -> None:
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def restart(self) -> None:
        self.last = 0

    def _split(self, at: int, word: bytes, to: int) -> int:
        """The state of the strings to of just length[at] + 1; cloned if need be."""
        step, link, length = self.step, self.link, self.length
        if length[to] == length[at] + 1:
            return to
        clone = len(step)
        step.append(dict(step[to]))
        link.append(link[to])
        length.append(length[at] + 1)
        link[to] = clone
        while at >= 0 and step[at].get(word) == to:
            step[at][word] = clone
            at = link[at]
        return clone

    def add(self, word: bytes) -> int:
        """Append a word; the length of the longest suffix that ended before."""
        step, link, length = self.step, self.link, self.length
        at = self.last
        known = step[at].get(word)
        if known is not None:  # all since the restart is known
            self.last = self._split(at, word, known)
            return length[self.last]
        new = self.last = len(step)
        step.append({})
        length.append(length[at] + 1)
        link.append(0)
        while at >= 0 and word not in step[at]:
            step[at][word] = new
            at = link[at]
        if at >= 0:
            link[new] = self._split(at, word, step[at][word])
        return length[link[new]]

    def matching(self, words: list[bytes]) -> Iterator[int]:
        """Matching statistics: after each word, how long a suffix of the words so far
        is in the texts of the automaton."""
        step, link, length = self.step, self.link, self.length
        at = size = 0
        for word in words:
            to = step[at].get(word)
            while to is None and at:
                at = link[at]
                size = length[at]
                to = step[at].get(word)
            if to is None:
                size = 0
            else:
                at, size = to, size + 1
            yield size


def spans_of(statistics: Iterator[int], least: int = THRESHOLD) -> Iterator[tuple[int, int]]:
    """(start, end) of the maximal runs covered by windows that end where a matching
    statistic reaches the threshold."""
    start = end = -1
    for i, size in enumerate(statistics, 1):
        if size >= least:
            if i - least > end:
                if end > 0:
                    yield start, end
                start = i - least
            end = i
    if end > 0:
        yield start, end


def covered(contexts: list[tuple[int, int, list[bytes]]], least: int = THRESHOLD) -> Iterator[tuple[int, int, int]]:
    """(doc_id, start, end) of the words covered by windows that started earlier.

    contexts: (doc_id, start, words) in order; overlaps within a document are read once.
    """
    automaton = Automaton()
    last_doc, last_end = None, 0
    for doc, start, words in contexts:
        if doc != last_doc or start > last_end:  # texts of one doc_id lie far apart
            automaton.restart()
            last_end = start
        last_doc = doc
        open_at = -1
        for i in range(last_end - start, len(words)):
            if automaton.add(words[i]) >= least:
                end = start + i + 1
                if open_at < 0:
                    open_at = end - least
            elif open_at >= 0:
                yield doc, open_at, start + i
                open_at = -1
        last_end = max(last_end, start + len(words))
        if open_at >= 0:
            yield doc, open_at, last_end


# ---------------------------------------------------------------- over DataFrames


def _text_key(body: str) -> int:
    """Tells the texts of one doc_id apart: the upper half of a word's place."""
    return (zlib.crc32(body.encode("utf-8", "surrogatepass")) & 0x7FFFFFFF) << 32


def _anchor_rows(docs: DataFrame, least: int, text: str) -> DataFrame:
    """(anchor, doc_id, at, n, ctx); at is the text's key and the first word's number."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        hashes, powers = WordHash(), _Powers()
        for b in batches:
            out: list[tuple] = []
            for doc, body in zip(b["doc_id"], b[text], strict=True):
                found = anchors(hashes.array(words_of(body)), powers, least)
                if len(found[0]):
                    out.append((found[0], found[1] + _text_key(body), found[2] - found[1], found[3], np.full(len(found[0]), doc)))
                if len(out) >= 512:
                    yield _columns(out)
                    out = []
            if out:
                yield _columns(out)

    def _columns(out: list[tuple]) -> dict:
        anchor, at, n, digest, doc = (np.concatenate(x) for x in zip(*out, strict=True))
        return {"anchor": signed(anchor), "doc_id": doc, "at": at, "n": n.astype(np.int32), "ctx": signed(digest)}

    return map_rows(docs.select("doc_id", text), run, "anchor long, doc_id long, at long, n int, ctx long")


def _per_document(rows: DataFrame, value, name: str) -> DataFrame:
    """One list a document, to be merged with the documents: the same plan at every size."""
    return stored(rows.groupBy("doc_id").agg(F.collect_list(value).alias(name)), name)


def _routed(rows: DataFrame, firsts: DataFrame, keys: list[str], a, b, *more: str) -> tuple[DataFrame, DataFrame]:
    """What repeats, as (references, queries) of shards: (doc_id, role, a, b, salt, at, n).

    rows: every occurrence; firsts: keys, first (doc_id and at of the first) and times.
    """
    firsts = firsts.where("times > 1").withColumn("salts", F.ceil(F.col("times") / COPIES).cast("int"))
    place = ("role", "a", "b", "salt", "at", "n", *more)
    references = (
        firsts.select(F.col("first.doc_id"), F.lit(REFERENCE).alias("role"), a.alias("a"), b.alias("b"),
                      F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("first.at"), "n",
                      *[F.col(f"first.{c}") for c in more])
        .select("doc_id", *place)
    )
    queries = (
        rows.join(firsts.select(*keys, "first", "salts"), keys)
        .where(F.struct("doc_id", "at") != F.struct("first.doc_id", "first.at"))
        .withColumns({"role": F.lit(QUERY), "a": a, "b": b, "salt": F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")})
        .select("doc_id", *place)
    )
    return references, queries


def duplicate_spans(docs: DataFrame, least: int = THRESHOLD, text: str = "text") -> DataFrame:
    """(doc_id, at, n): runs of words covered by windows that also start earlier.

    Runs may overlap; every document with a duplicate window is among them.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text)
    rows = stored(_anchor_rows(docs, least, text), "anchor_rows")
    often = stored(rows.groupBy("anchor").count().where("count > 1").select("anchor"), "often")
    seen = stored(rows.join(often.hint("merge"), "anchor", "left_semi"), "anchors")
    discard(rows)
    firsts = stored(
        seen.groupBy("anchor", "ctx", "n").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("times")),
        "contexts",
    )
    several = stored(firsts.groupBy("anchor").agg(F.count("*").alias("contexts")).where("contexts > 1"), "several")
    references, queries = _routed(
        seen, firsts, ["anchor", "ctx", "n"], F.col("first.doc_id"), F.shiftright("first.at", STRETCH.bit_length() - 1)
    )
    role = F.when(F.col("contexts") > SHARD, SPLIT).otherwise(CONTEXT)
    contexts = firsts.join(several.hint("merge"), "anchor").select(
        "first.doc_id", role.alias("role"), F.col("anchor").alias("a"), F.lit(-1).cast("long").alias("b"),
        F.lit(0).alias("salt"), "first.at", "n",
    )
    wanted = references.unionByName(queries).unionByName(contexts)
    lists = _per_document(wanted, F.struct("role", "a", "b", "salt", "at", "n"), "wanted")
    pieces = stored(_cut_pieces(docs.join(lists.hint("merge"), "doc_id"), text), "pieces")
    discard(lists)
    shards = pieces.where(F.col("role") != SPLIT)
    if not several.where(F.col("contexts") > SHARD).isEmpty():
        shards = shards.unionByName(_split_shards(pieces.where(F.col("role") == SPLIT), least))
    key = ["a", "b", "salt"]
    return _stream_shards(shards.repartition(*key).sortWithinPartitions(*key, "role", "doc_id", "at"), least)


_PIECE = "doc_id long, role int, a long, b long, salt int, at long, body string"


def _cut_pieces(docs: DataFrame, text: str) -> DataFrame:
    """The wanted words; what overlaps for the same shard in the same role is one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                b = batch.slice(start, 128)
                column = {name: b.column(i) for i, name in enumerate(b.schema.names)}
                lists = column["wanted"]
                fields = zip(lists.type.value_type, lists.flatten().flatten(), strict=True)
                got = {f.name: np.asarray(x).astype(np.int64) for f, x in fields}
                got["row"] = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths()))
                bodies = column[text].to_pylist()
                keys = np.array([_text_key(x) if x else -1 for x in bodies])
                mine = (got["at"] >> 32 << 32) == keys[got["row"]]  # not another row's of the same doc_id
                got = {k: v[mine] for k, v in got.items()}
                order = np.lexsort([got[k] for k in ("at", "salt", "b", "a", "role", "row")])
                got = {k: v[order] for k, v in got.items()}
                end = got["at"] + got["n"]
                apart = got["role"] > QUERY
                for k in ("row", "role", "a", "b", "salt"):
                    apart[1:] |= got[k][1:] != got[k][:-1]
                apart[1:] |= got["at"][1:] > end[:-1]
                apart[:1] = True
                heads = np.flatnonzero(apart)
                ends = np.maximum.reduceat(end, heads) if len(heads) else end
                head = {k: v[heads] for k, v in got.items()}
                out: list[str] = []
                words, last = [], -1
                for row, at, to in zip(head["row"].tolist(), head["at"].tolist(), ends.tolist(), strict=True):
                    if row != last:
                        words, last = words_of(bodies[row]), row
                    out.append(b" ".join(words[at & 0xFFFFFFFF : to & 0xFFFFFFFF]).decode("utf-8", "surrogatepass"))
                doc = np.asarray(column["doc_id"])
                yield {k: head[k] for k in ("role", "a", "b", "salt", "at")} | {"doc_id": doc[head["row"]], "body": out}

    return map_arrow(docs, run, _PIECE)


def _split_shards(pieces: DataFrame, least: int) -> DataFrame:
    """The single windows of contexts, routed: equal windows share a shard."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict = {"h": [], "l": [], "doc_id": [], "at": [], "body": []}
            for doc, at, body in zip(b["doc_id"], b["at"], b["body"], strict=True):
                words = words_of(body)
                for s in range(len(words) - least + 1):
                    joined = b" ".join(words[s : s + least])
                    wide = xxhash.xxh3_128_intdigest(joined)
                    out["h"].append((wide >> 64) - (1 << 63))
                    out["l"].append((wide & (1 << 64) - 1) - (1 << 63))
                    out["doc_id"].append(doc)
                    out["at"].append(at + s)
                    out["body"].append(joined.decode("utf-8", "surrogatepass"))
            yield out

    kind = "h long, l long, doc_id long, at long, body string"
    windows = stored(map_rows(pieces.select("doc_id", "at", "body"), run, kind).withColumn("n", F.lit(least)), "windows")
    firsts = stored(
        windows.groupBy("h", "l", "n").agg(F.min(F.struct("doc_id", "at", "body")).alias("first"), F.count("*").alias("times")),
        "window_firsts",
    )
    references, queries = _routed(windows, firsts, ["h", "l", "n"], F.col("h"), F.col("l"), "body")
    return references.unionByName(queries).drop("n")


def _stream_shards(rows: DataFrame, least: int) -> DataFrame:
    """Pieces in order of shard, role, doc_id and at -> covered runs, shard by shard."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        current, automaton, several = None, Automaton(), []

        for b in batches:
            out: list[tuple[int, int, int]] = []
            for doc, role, *shard, at, body in zip(*(b[c] for c in ("doc_id", "role", "a", "b", "salt", "at", "body")), strict=True):
                if shard != current:
                    out += covered(several, least)
                    current, automaton, several = shard, Automaton(), []
                words = words_of(body)
                if role == REFERENCE:
                    automaton.restart()
                    for word in words:
                        automaton.add(word)
                elif role == QUERY:
                    out += [(doc, at + s, at + e) for s, e in spans_of(automaton.matching(words), least)]
                else:
                    several.append((doc, at, words))
            yield _span_columns(out)
        yield _span_columns(list(covered(several, least)))

    return map_rows(rows, run, "doc_id long, at long, n int")


def _span_columns(spans: list[tuple[int, int, int]]) -> dict:
    doc, start, end = zip(*spans, strict=True) if spans else ((), (), ())
    return {"doc_id": list(doc), "at": list(start), "n": [e - s for s, e in zip(start, end, strict=True)]}


def with_spans(docs: DataFrame, least: int = THRESHOLD, text: str = "text") -> DataFrame:
    """docs with the column ``spans`` (null where nothing repeats)."""
    lists = _per_document(duplicate_spans(docs, least, text), F.struct("at", "n"), "spans")
    return docs.drop("spans").join(lists.hint("merge"), "doc_id", "left")


def _removed(n: int, body: str | None, spans: list[dict] | None) -> np.ndarray:
    """A flag for each of the n words of a text: covered by a span of this text."""
    if not spans or not n:
        return np.zeros(n, bool)
    key = _text_key(body)
    edge = np.zeros(n + 1, np.int64)
    mine = [(x["at"] - key, x["n"]) for x in spans if x["at"] >> 32 << 32 == key]
    np.add.at(edge, [at for at, _ in mine], 1)
    np.add.at(edge, [at + size for at, size in mine], -1)
    return np.cumsum(edge[:n]) > 0


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict = {"doc_id": b["doc_id"], "n_words": [], "n_removed": [], "kept_sha256": []}
            for body, spans in zip(b["text"], b["spans"], strict=True):
                words = words_of(body)
                gone = _removed(len(words), body, spans)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if spans else words
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield out

    return map_rows(with_spans(docs), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_spans(text: str | None, spans: list[dict] | None) -> str | None:
    """The text less its covered words; what stands between kept words is kept."""
    import re

    if text is None or not spans:
        return text
    at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    gone = _removed(len(at), text, spans)
    out, last = [], 0
    for i in np.flatnonzero(gone).tolist():
        begin, end = at[i]
        out.append(text[last:begin])
        last = end
        while last < len(text) and text[last] in " \t\n\v\f\r":  # the gap behind a removed word goes with it
            last += 1
    return "".join([*out, text[last:]])


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages are cut; a document left without words goes."""
    names = [c for c in docs.columns if c != "text"]
    packed = docs.select(
        F.col("doc_id"), F.struct(*[F.col(c) for c in names if c != "doc_id"], F.lit(0).alias("_none")).alias("_row"), "text"
    )
    prepare(spark)
    cut = F.pandas_udf(_cut_series, "string")
    spanned = with_spans(packed)
    left = spanned.withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut("text", "spans")))
    kept = left.where(F.col("spans").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"_row.`{c}`") for c in docs.columns])


def _cut_series(text, spans):
    import pandas as pd

    return pd.Series(
        [remove_spans(t, None if s is None else list(s)) for t, s in zip(text, spans, strict=True)], dtype=object
    )


#: DuckDB: all windows as strings, each compared with the first of its words.
SQL = r"""
with d as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents
), win as (
  select doc_id, s, md5(array_to_string(w[s : s + 19], ' ')) as h
  from (select doc_id, w, unnest(range(1, len(w) - 18)) as s from d where len(w) >= 20) x
), dup as (
  select doc_id, s from (select doc_id, s, row_number() over (partition by h order by doc_id, s) as k from win) y where k > 1
), gone as (select distinct doc_id, unnest(range(s, s + 20)) as p from dup),
cnt as (select doc_id, count(*) as c from gone group by doc_id),
kept as (
  select u.doc_id, string_agg(word, ' ' order by u.p) as body
  from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d) u
  left join gone g on g.doc_id = u.doc_id and g.p = u.p where g.p is null group by u.doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(c, 0) as bigint) as n_removed,
  sha256(coalesce(body, '')) as kept_sha256
from d left join cnt on cnt.doc_id = d.doc_id left join kept on kept.doc_id = d.doc_id
"""
