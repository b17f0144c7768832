"""LM scoring by Brown class-based bigrams.

    log P(word | previous) = log P(class | previous class) + log P(word | class)

Every training word that occurs twice or more has a class from its own contexts:

1.  The ``CORE`` most frequent words are clustered by exchange on their bigram
    counts: each moves in turn to the class where the likelihood is largest.
2.  For every other word, however rare, one pass gathers the classes of the
    words beside each of its occurrences (two bytes an occurrence).  These rows
    grow with the corpus, stay distributed, and are merged word by word.
3.  The exchange goes on over all of these words in rounds: every word moves to
    the class of largest likelihood given its contexts, then the classes'
    context counts are summed anew, the moved words among them.
4.  Words seen once, and words never seen, share the class ``RARE``.

Transitions are counted over the class sequences of all training documents with
the classes of all words.  Counts and classes of words are one table, joined, not
broadcast; only the ``FREQUENT`` most frequent words, which make up most tokens,
are also broadcast (a fixed number of rows of at most ``LONGEST`` bytes, as
longer words stand as their digests), to keep their tokens out of the join.

Defined results: a null or empty text is the one token "end"; documents with a
null doc_id are training documents (their remainder is none); repeated rows are
scored alike and each counts in training; without training documents the counts
are zero and the scores follow from the smoothing alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.common import held_out, lower_words, map_arrow, map_rows, stored, table

#: The end token; no word holds a line feed.
END = b"\n"
SMOOTH = 0.1
FREQUENT = 131_072
LONGEST = 64
CORE = 2_000
CLASSES = 64
#: Rounds of exchange over the core, and over all other words.
ROUNDS, WORD_ROUNDS = 12, 2
#: Classes and core items of what is no core word: 0 is RARE, 1 is the end token.
RARE, STOP = 0, 1
#: Stands in a class sequence for a word that is still to be joined.
OPEN = 255
#: Tokens, and different words, that a counting task holds before it hands rows on.
CHUNK, VOCABULARY = 1 << 20, 300_000
#: Parts that the core's bigram table is summed in, and what spreads its cells over them.
BLOCKS, SPREAD = 1_000, 1_000_003


def tokens(text: str | None) -> list[bytes]:
    out = lower_words(text)
    if out and max(map(len, out)) > LONGEST:
        out = [w if len(w) <= LONGEST else b"\n" + blake2b(w, digest_size=32).digest() for w in out]
    out.append(END)
    return out


def _chunks(batches: Iterator[dict], text: str, most: int = CHUNK) -> Iterator[list[bytes]]:
    """Tokens of whole documents in a row, each document behind an end token."""
    found: list[bytes] = [END]
    for b in batches:
        for body in b[text]:
            found += tokens(body)
            if len(found) > most:
                yield found
                found = [END]
    if len(found) > 1:
        yield found


def exchange_classes(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each item.  bigrams: counts of item pairs; items RARE and STOP keep
    classes of their own.  Each item in turn goes where the likelihood
    sum N(a,b) log N(a,b) - sum N(a) log N(a) - sum N(b) log N(b) is largest."""
    n = len(bigrams)
    mass = bigrams.sum(0) + bigrams.sum(1)
    klass = np.empty(n, np.int64)
    klass[[RARE, STOP]] = 0, 1
    free = np.array([i for i in np.lexsort((np.arange(n), -mass)) if i not in (RARE, STOP)], np.int64)
    klass[free] = 2 + np.arange(len(free)) % (classes - 2)

    def h(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)

    one = np.zeros((n, classes))
    one[np.arange(n), klass] = 1
    right = bigrams @ one  # item -> following class
    left = bigrams.T @ one  # item -> preceding class
    table = one.T @ right
    for _ in range(rounds):
        moved = 0
        for i in free:
            if not mass[i]:
                continue
            old = klass[i]
            own = bigrams[i, i]
            r, c = right[i].copy(), left[i].copy()
            r[old] -= own
            c[old] -= own
            table[old] -= r
            table[:, old] -= c
            table[old, old] -= own
            # gain of putting the item into each class
            rows, columns = table.sum(1), table.sum(0)
            fresh_rows, fresh_columns = table + r[None, :], table + c[:, None]
            gain = (h(fresh_rows) - h(table)).sum(1) + (h(fresh_columns) - h(table)).sum(0)
            cell = np.diagonal(table)
            gain += h(cell + np.diagonal(fresh_rows) - cell + np.diagonal(fresh_columns) - cell + own)
            gain -= h(np.diagonal(fresh_rows)) + h(np.diagonal(fresh_columns)) - h(cell)
            gain -= h(rows + r.sum() + own) - h(rows) + h(columns + c.sum() + own) - h(columns)
            gain[:2] = -np.inf
            new = int(gain.argmax())
            table[new] += r
            table[:, new] += c
            table[new, new] += own
            if new != old:
                moved += 1
                klass[i] = new
                right[:, old] -= bigrams[:, i]
                right[:, new] += bigrams[:, i]
                left[:, old] -= bigrams[i]
                left[:, new] += bigrams[i]
        if moved * 200 <= len(free):
            break
    return klass


# ---------------------------------------------------------------- counting


def often_counts(training: DataFrame, text: str = "text") -> DataFrame:
    """(word, c): counts by which the core is chosen.  A counting task leaves out what it
    has seen once, so c is too low by the number of those tasks at most."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        seen: Counter = Counter()

        def rows() -> dict:
            often = [(w, c) for w, c in seen.items() if c > 1 and w != END]
            return {"word": [w for w, _ in often], "c": [c for _, c in often]}

        for b in batches:
            for body in b[text]:
                seen.update(tokens(body))
            if len(seen) > VOCABULARY:
                yield rows()
                seen.clear()
        yield rows()

    return map_rows(training.select(text), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> list[tuple]:
    """The rows of largest c, in order.  A histogram of fixed size over the logarithm
    of c first rules out what can't be among them, so that tasks send few others."""
    level = F.floor(F.log2("c") * 64)
    above, least = 0, 0
    for l, n in sorted(map(tuple, counts.groupBy(level).count().collect()), reverse=True):
        above, least = above + n, l
        if above >= most:
            break
    top = counts.where(level >= least).orderBy(F.desc("c"), "word").limit(most).collect()
    return [(bytes(r[0]), *r[1:]) for r in top]


def _core_bigrams(training: DataFrame, core: dict[bytes, int], text: str) -> np.ndarray:
    """Item bigrams of all training documents; the end token starts a document too.
    Partial sums of a table of fixed size meet block by block; its cells are spread
    so that blocks are equally full."""
    n = 2 + len(core)
    width = -(-n * n // BLOCKS)
    place = np.arange(n * n) * SPREAD % (n * n)
    shared = training.sparkSession.sparkContext.broadcast(core)

    def rows(blocks: np.ndarray, total: np.ndarray) -> dict:
        cells = [np.flatnonzero(x) for x in total]
        return {
            "block": blocks,
            "cells": [c.astype(np.uint16).tobytes() for c in cells],
            "c": [x[c].tobytes() for x, c in zip(total, cells, strict=True)],
        }

    def count_up(batches: Iterator[dict]) -> Iterator[dict]:
        item = shared.value
        total = np.zeros(BLOCKS * width, np.int64)
        for found in _chunks(batches, text):
            codes = np.fromiter(map(item.get, found, repeat(RARE)), np.int64, len(found))
            pairs, counts = np.unique(codes[:-1] * n + codes[1:], return_counts=True)
            total[pairs * SPREAD % (n * n)] += counts
        total = total.reshape(BLOCKS, width)
        full = np.flatnonzero(total.any(1))
        yield rows(full, total[full])

    def add_up(batches: Iterator[dict]) -> Iterator[dict]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, cells, c in zip(b["block"], b["cells"], b["c"], strict=True):
                row = total.setdefault(i, np.zeros(width, np.int64))
                row[np.frombuffer(cells, np.uint16)] += np.frombuffer(c, np.int64)
        yield rows(np.array(list(total), np.int64), np.array(list(total.values())).reshape(-1, width))

    kind = "block int, cells binary, c binary"
    out = np.zeros((BLOCKS, width))
    for r in map_rows(map_rows(training.select(text), count_up, kind).repartition("block"), add_up, kind).collect():
        out[r.block, np.frombuffer(r.cells, np.uint16)] = np.frombuffer(r.c, np.int64)
    return out.ravel()[place].reshape(n, n)


def _pieces(values: np.ndarray, edges: np.ndarray, width: int = 1) -> pa.Array:
    """Values of so many bytes, cut at the edges, as binary values."""
    offsets = pa.py_buffer((edges * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])


class Numbers(dict):
    """word -> its number, in the order in which words come up."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _contexts(training: DataFrame, classes: dict[bytes, int], text: str) -> DataFrame:
    """(word, beside) of every word outside the core: beside holds for each occurrence
    the class of the word before, and that of the word behind plus CLASSES."""
    shared = training.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        known = shared.value
        names = Numbers()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> dict:
            number = np.concatenate([x for x, _ in held])
            order = np.argsort(number, kind="stable")
            number, beside = number[order], np.concatenate([x for _, x in held])[order]
            edges = np.r_[np.flatnonzero(np.r_[True, number[1:] != number[:-1]]), len(number)]
            words = list(names)  # in the order of their numbers
            return {"word": pa.array(words, pa.binary()), "beside": _pieces(beside, edges, 2)}

        for found in _chunks(batches, text, CHUNK // 16):
            klass = np.fromiter(map(known.get, found, repeat(OPEN)), np.uint8, len(found))
            tail = klass == OPEN
            at = np.flatnonzero(tail)
            if not len(at):
                continue
            klass[at] = RARE
            number = np.fromiter(map(names.__getitem__, compress(found, tail.tolist())), np.int32, len(at))
            held.append((number, np.stack([klass[at - 1], klass[at + 1] + np.uint8(CLASSES)], 1)))
            if len(names) > VOCABULARY or sum(len(x) for x, _ in held) > 8 * CHUNK:
                yield rows()
                names, held = Numbers(), []
        if held:
            yield rows()

    return map_rows(training.select(text), run, "word binary, beside binary")


class Contexts:
    """How often which class stands beside each word: (word, code, count) triples in order
    of words; a code is the class before, or the class behind plus CLASSES."""

    def __init__(self, words: list[bytes], row: np.ndarray, code: np.ndarray, c: np.ndarray):
        self.words, self.row, self.code, self.c = words, row, code, c
        self.seen = np.bincount(row, c, len(words)).astype(np.int64) // 2

    @classmethod
    def of(cls, words: list[bytes], besides: list[bytes], counts: list[bytes] | None = None) -> Contexts:
        """Neighbours with the same word become one."""
        code = np.frombuffer(b"".join(besides), np.uint8).astype(np.int64)
        heads = np.array([True, *(x != y for x, y in zip(words[1:], words, strict=False))], bool)[: len(words)]
        row = np.repeat(np.cumsum(heads) - 1, np.fromiter(map(len, besides), np.int64, len(besides)))
        c = np.ones(len(code), np.int64) if counts is None else np.frombuffer(b"".join(counts), np.int64)
        cell, inverse = np.unique(row * 2 * CLASSES + code, return_inverse=True)
        sums = np.bincount(inverse, c, len(cell)).astype(np.int64)
        return cls([w for w, h in zip(words, heads.tolist(), strict=True) if h], cell // (2 * CLASSES), cell % (2 * CLASSES), sums)

    def packed(self) -> dict:
        edges = np.searchsorted(self.row, np.arange(len(self.words) + 1))
        return {
            "word": pa.array(self.words, pa.binary()),
            "beside": _pieces(self.code.astype(np.uint8), edges),
            "c": _pieces(self.c, edges, 8),
        }


def _merged(rows: DataFrame) -> DataFrame:
    """One row a word: which classes stand beside it (codes as above), and how often."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        last: dict = {"word": [], "beside": [], "c": []}  # of the word that may go on
        for b in batches:
            fresh = [np.ones(len(x), np.int64).tobytes() for x in b["beside"]]
            found = Contexts.of(last["word"] + b["word"], last["beside"] + b["beside"], last["c"] + fresh)
            out = found.packed()
            last = {k: v[-1:].to_pylist() for k, v in out.items()}
            yield {k: v[:-1] for k, v in out.items()}
        yield last

    sorted_rows = rows.repartition("word").sortWithinPartitions("word")
    return map_rows(sorted_rows, run, "word binary, beside binary, c binary")


class WordClasses:
    """Chooses the class of words by their contexts: the one where the mean
    log-likelihood of the classes before and behind is largest."""

    def __init__(self, before: np.ndarray, behind: np.ndarray):
        """before[a, k], behind[k, b]: how often class k has class a before, b behind it."""

        def smoothed(x: np.ndarray, axis: int) -> np.ndarray:
            share = (x.sum(1 - axis, keepdims=True) + 1) / (x.sum() + len(x))
            return np.log((x + 5.0 * share) / (x.sum(axis, keepdims=True) + 5.0))

        self.gain = np.concatenate([smoothed(before, 0), smoothed(behind, 1).T])

    def choose(self, found: Contexts) -> np.ndarray:
        """The class of each word; RARE for those that occur once."""
        out = np.full(len(found.words), RARE)
        wanted = np.flatnonzero(found.seen > 1)
        if len(wanted):
            mine = found.seen[found.row] > 1
            row, code, c = found.row[mine], found.code[mine], found.c[mine]
            gain = np.add.reduceat(self.gain[code] * c[:, None], np.searchsorted(row, wanted))
            gain[:, [RARE, STOP]] = -np.inf
            out[wanted] = gain.argmax(1)
        return out


def _exchanged(contexts: DataFrame, chooser: WordClasses) -> tuple[np.ndarray, np.ndarray]:
    """Context counts of the classes, over all words of the table, once each has moved."""
    shared = contexts.sparkSession.sparkContext.broadcast(chooser)
    size = CLASSES * 2 * CLASSES

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        total = np.zeros(size, np.int64)
        for b in batches:
            found = Contexts.of(b["word"], b["beside"], b["c"])
            klass = shared.value.choose(found)
            total += np.bincount(klass[found.row] * 2 * CLASSES + found.code, found.c, size).astype(np.int64)
        cell = np.flatnonzero(total)
        yield {"cell": cell, "c": total[cell]}

    out = np.zeros(size)
    for cell, c in map_rows(contexts, run, "cell int, c long").groupBy("cell").agg(F.sum("c")).collect():
        out[cell] = c
    out = out.reshape(CLASSES, 2 * CLASSES)
    return out[:, :CLASSES].T, out[:, CLASSES:]


def _classified(contexts: DataFrame, chooser: WordClasses) -> DataFrame:
    shared = contexts.sparkSession.sparkContext.broadcast(chooser)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            found = Contexts.of(b["word"], b["beside"], b["c"])
            yield {"word": found.words, "c": found.seen, "klass": shared.value.choose(found)}

    return map_rows(contexts, run, "word binary, c long, klass int")


class ClassModel:
    """All that scoring needs besides the table of words; of fixed size."""

    def __init__(self, frequent: list[tuple[bytes, int, int]], totals: dict[int, tuple[int, int]], classes: int = CLASSES):
        self.frequent = {w: i for i, (w, _, _) in enumerate(frequent)}
        self.counts = np.array([c for _, c, _ in frequent], np.float64)
        self.klass = np.array([k for _, _, k in frequent], np.uint8)
        self.mass = np.array([totals.get(i, (0, 0))[0] for i in range(classes)], float)
        self.types = np.array([totals.get(i, (0, 0))[1] for i in range(classes)], float)
        self.n, self.v = int(self.mass.sum()), int(self.types.sum())
        self.step = np.zeros((classes, classes))

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + SMOOTH) / (self.n + SMOOTH * (self.v + 1)))

    def emit(self, count: np.ndarray, klass: np.ndarray) -> np.ndarray:
        """Log of P(word | class).  What is seen once tells next to nothing of what is
        never seen, so in the class RARE all words, and one more, are alike."""
        told = np.log10((count + SMOOTH) / (self.mass[klass] + SMOOTH * (self.types[klass] + 1)))
        return np.where(klass == RARE, -np.log10(self.types[RARE] + 1), told)

    def set_steps(self, pair: np.ndarray) -> None:
        """Transitions from counts of class pairs, smoothed towards the class's own share."""
        share = (pair.sum(0) + 1) / (pair.sum() + len(pair))
        self.step = np.log10((pair + 5.0 * share[None, :]) / (pair.sum(1, keepdims=True) + 5.0))


def word_classes(training: DataFrame, text: str = "text") -> DataFrame:
    """(word, c, klass) of every distinct token of the training documents."""
    core = most_frequent(stored(often_counts(training, text), "often"), CORE)
    items = {END: STOP} | {w: i + 2 for i, (w, _) in enumerate(core)}
    bigrams = _core_bigrams(training, items, text)
    klass = exchange_classes(bigrams)
    one = np.zeros((len(klass), CLASSES))
    one[np.arange(len(klass)), klass] = 1
    pair = one.T @ bigrams @ one
    contexts = stored(_merged(_contexts(training, {w: int(klass[i]) for w, i in items.items()}, text)), "contexts")
    chooser = WordClasses(pair, pair)
    for _ in range(WORD_ROUNDS):
        before, behind = _exchanged(contexts, chooser)
        before[:, RARE], behind[RARE] = pair[:, RARE], pair[RARE]
        before[:, RARE + 1 :] += pair[:, RARE + 1 :]
        behind[RARE + 1 :] += pair[RARE + 1 :]
        chooser = WordClasses(before, behind)
    seen = bigrams.sum(0)  # every token stands behind another, the first ones behind the end token
    known = [(w, int(seen[i]), int(klass[i])) for w, i in items.items() if seen[i]]
    heads = training.sparkSession.createDataFrame(known, "word binary, c long, klass int")
    return stored(_classified(contexts, chooser).unionByName(heads), "words")


def class_sequences(docs: DataFrame, words: DataFrame, model: ClassModel, text: str = "text") -> DataFrame:
    """doc_id, held_out, the class of every token, and the sums that need no transitions."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def begin(batches: Iterator[dict]) -> Iterator[dict]:
        m: ClassModel = shared.value
        frequent = m.frequent.get
        klass = np.r_[m.klass, np.uint8(OPEN)]
        base, emit = np.r_[m.base(m.counts), 0.0], np.r_[m.emit(m.counts, m.klass), 0.0]
        number = (TaskContext.get().partitionId() + 1) << 40
        for b in batches:
            for s in range(0, len(b[text]), 256):
                texts = [tokens(body) for body in b[text][s : s + 256]]
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                edges = np.r_[0, np.cumsum(sizes)]
                at = np.fromiter(map(frequent, chain.from_iterable(texts), repeat(-1)), np.int64, edges[-1])
                tail = np.flatnonzero(at < 0)
                of = np.searchsorted(edges, tail, "right") - 1
                place = tail - edges[of]
                yield {
                    "row": np.arange(number, number + len(texts)),
                    "doc_id": b["doc_id"][s : s + 256],
                    "held_out": b["held_out"][s : s + 256],
                    "classes": _pieces(klass[at], edges),
                    "n_known": np.add.reduceat(at >= 0, edges[:-1], dtype=np.int64),
                    "base": np.add.reduceat(base[at], edges[:-1]),
                    "emit": np.add.reduceat(emit[at], edges[:-1]),
                    "open": pa.ListArray.from_arrays(
                        pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32()),
                        pa.StructArray.from_arrays(
                            [
                                pa.array([texts[i][j] for i, j in zip(of.tolist(), place.tolist(), strict=True)], pa.binary()),
                                pa.array(place, pa.int32()),
                            ],
                            ["word", "at"],
                        ),
                    ),
                }
                number += len(texts)

    # row numbers are made once: they are written with the rows they number
    first = stored(
        map_rows(
            docs.select("doc_id", "held_out", text),
            begin,
            "row long, doc_id long, held_out boolean, classes binary, n_known long, base double, emit double, "
            "open array<struct<word:binary,at:int>>",
        ),
        "sequences",
    )
    tail = first.select("row", F.explode("open").alias("o")).select("row", "o.word", "o.at")
    found = (
        tail.join(words, "word", "left")
        .select("row", F.struct("at", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("klass", F.lit(RARE)).alias("klass")).alias("f"))
        .groupBy("row")
        .agg(F.collect_list("f").alias("found"))
    )

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        m: ClassModel = shared.value
        for b in batches:
            col = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            texts = col["classes"].to_pylist()
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            edges = np.r_[0, np.cumsum(sizes)]
            classes = np.frombuffer(b"".join(texts), np.uint8).copy()
            found = col["found"].combine_chunks() if isinstance(col["found"], pa.ChunkedArray) else col["found"]
            many = np.asarray(found.value_lengths().fill_null(0)).astype(np.int64)
            at, c, klass = (np.asarray(x) for x in found.flatten().flatten())
            of = np.repeat(np.arange(len(texts)), many)
            classes[edges[of] + at] = klass
            sums = {
                "n_known": (c > 0).astype(float),
                "base": m.base(c.astype(float)),
                "emit": m.emit(c.astype(float), klass),
            }
            sums = {k: np.asarray(col[k]) + np.bincount(of, v, len(texts)) for k, v in sums.items()}
            yield {
                "doc_id": col["doc_id"],
                "held_out": col["held_out"],
                "classes": _pieces(classes, edges),
                "n_tokens": sizes,
                "n_known": sums["n_known"].astype(np.int64),
                "base": sums["base"],
                "emit": sums["emit"],
            }

    kind = "doc_id long, held_out boolean, classes binary, n_tokens long, n_known long, base double, emit double"
    joined = first.drop("open").join(found, "row", "left")
    return stored(map_arrow(joined, complete, kind), "classes")


def _pairs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Classes before and at each token, the end token before the first."""
    classes = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    before = np.r_[STOP, classes[:-1]]
    before[np.cumsum([0, *map(len, texts[:-1])])] = STOP
    return before, classes


def train(training: DataFrame, text: str = "text") -> tuple[ClassModel, DataFrame]:
    """The model without its transitions, and the table of words."""
    words = word_classes(training, text)
    sums = words.groupBy("klass").agg(F.sum("c"), F.count("*")).collect()
    return ClassModel(most_frequent(words, FREQUENT), {r[0]: (r[1], r[2]) for r in sums}), words


def score(docs: DataFrame, model: ClassModel, words: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Transitions are counted over the documents that are not held out.
    """
    sequences = class_sequences(docs, words, model, text)
    k = len(model.mass)

    def count_up(batches: Iterator[dict]) -> Iterator[dict]:
        total = np.zeros(k * k, np.int64)
        for b in batches:
            before, classes = _pairs(b["classes"])
            total += np.bincount(before * k + classes, minlength=k * k)
        cells = np.flatnonzero(total)
        yield {"cell": cells, "c": total[cells]}

    pair = np.zeros(k * k)
    counted = map_rows(sequences.where("not held_out").select("classes"), count_up, "cell int, c long")
    for cell, c in counted.groupBy("cell").agg(F.sum("c")).collect():
        pair[cell] = c
    model.set_steps(pair.reshape(k, k))
    shared = docs.sparkSession.sparkContext.broadcast(model.step)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            before, classes = _pairs(b["classes"])
            starts = np.cumsum([0, *map(len, b["classes"][:-1])])
            steps = np.add.reduceat(shared.value[before, classes], starts)
            yield {c: b[c] for c in ("doc_id", "held_out", "n_tokens", "n_known")} | {
                "train_tokens": [model.n] * len(steps),
                "base_score": b["base"],
                "score": steps + np.array(b["emit"]),
            }

    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return map_rows(sequences, run, kind)


def op8_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 10, 0))
    model, words = train(docs.where("not held_out"))
    return score(docs, model, words)
