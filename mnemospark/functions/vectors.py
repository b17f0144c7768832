"""The best rows of many queries inside tasks: exact cosines as products of matrices, keyword scores by document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Places after the point that decide an order, as a factor; the keys of what has no
#: similarity (no vector, or another width) and of what is no number.
DIGITS, NO_KEY, NAN_KEY = 1e9, -(2**62), 2**62
QUERY_BLOCK, VECTOR_BLOCK = 256, 4_096


def unit_rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of length one, or zeros; whether a row has a vector of just that width)."""
    n = len(column)
    fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), width), False))
    out = np.zeros((n, width))
    if width and fits.any():
        taken = column.filter(pa.array(fits))
        flat = taken.flatten()
        rows = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
        if flat.null_count:
            gap = np.asarray(pc.is_null(flat)).reshape(-1, width).any(axis=1)
            fits[np.flatnonzero(fits)[gap]] = False
            rows = rows[~gap]
        length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        out[fits] = np.divide(rows, length, out=np.zeros_like(rows), where=length != 0)
    return out, fits


def keys_of(sims: np.ndarray) -> np.ndarray:
    """Similarities rounded to nine places, halves away from zero, as whole numbers."""
    scaled = sims * DIGITS
    whole = np.copysign(np.floor(np.abs(scaled) + 0.5), scaled)
    return np.where(np.isnan(sims), float(NAN_KEY), whole).astype(np.int64)


class Leaders:
    """The best ``most`` rows of each of n queries so far: the greatest keys, of equal ones the least ids."""

    def __init__(self, n: int, most: int, values: int = 1):
        self.most = most
        self.at, self.key, self.found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)
        self.values = [np.zeros(0) for _ in range(values)]
        self.least = np.full(n, NO_KEY, np.int64)  # what a newcomer must reach
        self.full, self.last = np.zeros(n, bool), np.empty(n, object)  # the id behind which an equal one is no newcomer

    def first(self, i: np.ndarray, key: np.ndarray, j: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
        """The best rows of a block; j: places in the order of the ids."""
        order = np.lexsort((j, -key, i))
        order = order[self._place(i[order]) < self.most]
        return tuple(x[order] for x in (i, key, j, *values))

    @staticmethod
    def _place(i: np.ndarray) -> np.ndarray:
        """The place of each row among those of its query; i is in order."""
        start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
        return np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))

    def merge(self, i: np.ndarray, key: np.ndarray, names: np.ndarray, *values: np.ndarray) -> None:
        equal = np.flatnonzero(self.full[i] & (key == self.least[i]))
        if len(equal):
            keep = np.ones(len(i), bool)
            keep[equal[(names[equal] > self.last[i[equal]]).astype(bool)]] = False
            i, key, names, *values = (x[keep] for x in (i, key, names, *values))
        if not len(i):
            return
        i, key, names = np.r_[self.at, i], np.r_[self.key, key], np.r_[self.found, names]
        turn = np.empty(len(names), np.int64)
        turn[np.asarray(pc.sort_indices(pa.array(names.tolist())))] = np.arange(len(names))
        order = np.lexsort((turn, -key, i))
        place = self._place(i[order])
        order, place = order[place < self.most], place[place < self.most]
        self.values = [np.r_[old, new][order] for old, new in zip(self.values, values, strict=True)]
        self.at, self.key, self.found = i[order], key[order], names[order]
        full = place == self.most - 1
        self.least[self.at[full]], self.last[self.at[full]], self.full[self.at[full]] = self.key[full], self.found[full], True


class Best:
    """The best ``most`` of each query of one space and width, so far."""

    def __init__(self, ids: list, rows: np.ndarray, fits: np.ndarray, width: int, most: int):
        self.ids, self.rows, self.fits, self.width, self.most = ids, rows, fits, width, most
        self.kept = Leaders(len(ids), most)

    def add(self, ids: np.ndarray, column: pa.Array) -> None:
        """ids: in order, so that of equal keys the first are the least ids."""
        rows, there = unit_rows(column, self.width)
        for v in range(0, len(ids), VECTOR_BLOCK):
            block, has, names = rows[v : v + VECTOR_BLOCK], there[v : v + VECTOR_BLOCK], ids[v : v + VECTOR_BLOCK]
            hits = []
            for q in range(0, len(self.ids), QUERY_BLOCK):
                sims = self.rows[q : q + QUERY_BLOCK] @ block.T
                sims[:, ~has] = -np.inf
                sims[~self.fits[q : q + QUERY_BLOCK]] = -np.inf
                least = self.kept.least[q : q + QUERY_BLOCK]
                floor = (least - 0.5) / DIGITS
                open_ = np.flatnonzero(least == NO_KEY)
                floor[open_] = -np.inf
                if len(open_) and len(names) > self.most:
                    kth = np.partition(sims[open_], -self.most, axis=1)[:, -self.most]
                    floor[open_] = np.where(np.isnan(kth), -np.inf, kth - 2 / DIGITS)
                i, j = np.nonzero(~(sims < floor[:, None]))
                sim = sims[i, j]
                key = np.where(np.isneginf(sim), NO_KEY, keys_of(np.where(np.isneginf(sim), 0, sim)))
                hits.append(self.kept.first(i + q, key, j, sim))
            i, key, j, sim = (np.concatenate(x) for x in zip(*hits, strict=True))
            self.kept.merge(i, key, names[j], sim)


def best_of_cells(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(query_id, id, sim, near) of each cell: its queries come first (side 0), then its vectors.

    near is the similarity in whole billionths, by which it is ranked.
    """
    cell, asking, best, kinds = None, [], None, None

    def prepared() -> dict:
        out: dict = {}
        rows = pa.Table.from_batches(asking).combine_chunks() if asking else None
        if rows is None:
            return out
        embedding = rows.column("embedding").combine_chunks()
        widths = pc.fill_null(pc.list_value_length(embedding), 0).to_pylist()
        spaces: dict = {}
        for k, space in enumerate(zip(rows.column("model").to_pylist(), rows.column("provider").to_pylist(), widths, strict=True)):
            if space[0] is not None and space[1] is not None:  # no space equals an unknown one
                spaces.setdefault(space, []).append(k)
        ids = rows.column("query_id").to_pylist()
        for (model, provider, width), at in spaces.items():
            unit, fits = unit_rows(embedding.take(pa.array(at)), width)
            out.setdefault((model, provider), []).append(Best([ids[k] for k in at], unit, fits, width, most))
        return out

    def results():
        for b in [b for found in (best or {}).values() for b in found]:
            for s in range(0, len(b.kept.at), 10_000):
                at, key, sim = (x[s : s + 10_000] for x in (b.kept.at, b.kept.key, b.kept.values[0]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.ids[k] for k in at], kinds[0]), pa.array(b.kept.found[s : s + 10_000].tolist(), kinds[1]),
                     pa.array(sim, mask=key == NO_KEY), pa.array(key)], names=["query_id", "id", "sim", "near"],
                )

    for batch in batches:
        kinds = kinds or (batch.schema.field("query_id").type, batch.schema.field("id").type)
        cells, sides = np.asarray(batch.column("cell")), np.asarray(batch.column("side"))
        cuts = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (sides[1:] != sides[:-1])]) if len(cells) else []
        for start, end in zip(cuts, [*cuts[1:], len(cells)], strict=True):
            part = batch.slice(start, end - start)
            if cells[start] != cell:
                yield from results()
                cell, asking, best = cells[start], [], None
            if sides[start] == 0:
                asking.append(part)
                continue
            if best is None:
                best, asking = prepared(), []
            part = part.take(pc.sort_indices(part.column("id")))
            spaces = np.array(list(zip(part.column("model").to_pylist(), part.column("provider").to_pylist(), strict=True)) + [None], object)[:-1]
            for space, found in best.items():
                mine = np.fromiter((x == space for x in spaces), bool, len(spaces))
                if not mine.any():
                    continue
                own = part if mine.all() else part.filter(pa.array(mine))
                names = np.empty(own.num_rows, object)
                names[:] = own.column("id").to_pylist()
                for b in found:
                    b.add(names, own.column("embedding"))
    yield from results()


def best_documents(
    batches: Iterator[pa.RecordBatch], queries: np.ndarray, starts: np.ndarray, idf: np.ndarray, asked: list, average: float, most: int
) -> Iterator[pa.RecordBatch]:
    """(query_id, id, score, overlap) of the documents that may be among the best ``most`` of a query, by score or by overlap.

    batches: id, doc_len and the terms (numbers) and frequencies of a document.  queries
    from starts[t] to starts[t + 1] are the places in asked of the queries with term t.
    """
    n = len(asked)
    by_score, by_overlap, kinds = Leaders(n, most, 2), Leaders(n, most, 2), None
    step = max(16, 250_000 // max(1, n))
    for batch in batches:
        kinds = kinds or (batch.schema.field("query_id").type, batch.schema.field("id").type)
        batch = batch.take(pc.sort_indices(batch.column("id")))
        for begin in range(0, batch.num_rows, step):
            part = batch.slice(begin, step)
            names = np.empty(part.num_rows, object)
            names[:] = part.column("id").to_pylist()
            size = np.asarray(pc.list_value_length(part.column("ts")))
            doc = np.repeat(np.arange(part.num_rows), size)
            t, tf = np.asarray(part.column("ts").flatten()), np.asarray(part.column("tfs").flatten()).astype(float)
            length = np.asarray(part.column("doc_len")).astype(float)[doc]
            score = idf[t] * (tf * (1.2 + 1) / (tf + 1.2 * (0.25 + 0.75 * length / average)))
            rows = part.num_rows
            cells, sums, counts = rows * n, np.zeros(rows * n), np.zeros(rows * n)
            times = starts[t + 1] - starts[t]
            ends = np.cumsum(times)
            for lo, hi in _runs(ends):  # of pairs of a posting and a query, so many at once
                k = times[lo:hi]
                offset = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                at = np.repeat(doc[lo:hi], k) + queries[np.repeat(starts[t[lo:hi]], k) + offset] * rows
                sums += np.bincount(at, np.repeat(score[lo:hi], k), cells)
                counts += np.bincount(at, minlength=cells)
            sums, counts = sums.reshape(n, -1), counts.reshape(n, -1)
            for kept, key in ((by_score, keys_of(sums)), (by_overlap, counts.astype(np.int64))):
                i, j = _leading(key, (counts > 0) & (key >= kept.least[:, None]), most)
                kept.merge(i, key[i, j], names[j], sums[i, j], counts[i, j])
    for kept in (by_score, by_overlap):
        for s in range(0, len(kept.at), 10_000):
            at, found, score, overlap = (x[s : s + 10_000] for x in (kept.at, kept.found, *kept.values))
            yield pa.RecordBatch.from_arrays(
                [pa.array([asked[k] for k in at], kinds[0]), pa.array(found.tolist(), kinds[1]), pa.array(score), pa.array(overlap.astype(np.int64))],
                names=["query_id", "id", "score", "overlap"],
            )


def _leading(key: np.ndarray, open_: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the open cells that are among the ``most`` greatest of their row, of equal ones the first."""
    n, width = key.shape
    if width > most and np.count_nonzero(open_) > n:
        turn = np.where(open_, (key - key.min()) * width + np.arange(width)[::-1], -1)
        j = np.argpartition(turn, width - most, axis=1)[:, width - most :].ravel()
        i = np.repeat(np.arange(n), most)
        taken = open_[i, j]
        return i[taken], j[taken]
    return np.nonzero(open_)


def _runs(ends: np.ndarray, most: int = 250_000) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(ends):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
        yield lo, hi
        lo = hi
