"""Language ID by nearest centroid over TF-IDF vectors of character n-grams.

Letters of the whole text, lower-cased, with one gap between words, give counts
of 1- to 3-grams in hashed dimensions; counts are damped, weighted by inverse
document frequency over all training documents, and normalised.  Each language
has a few centroids, clustered on the sphere from a bounded sample of labelled
documents; the nearest centroid by cosine gives the language.  A text farther
from its centroid than nearly all of that language's texts are is marked
``rejected`` (its language is still reported, with a lower score); that distance
is seen on texts that took no part in the centroids it is measured from.

``SAMPLE`` documents at most, in expectation, are collected for fitting, chosen
by a hash of doc_id with equal shares per language; document frequencies cover
every training document; every document is scored by its whole text.  Languages
are few: more than ``MOST_LANGUAGES`` different values of lang are an error.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
documents without a language are never learned from; with no training rows at
all every text is ``und``; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.common import held_out, map_rows, stored, table

DIMENSIONS = 4096
SAMPLE = 3_000
CENTROIDS = 3
MOST_LANGUAGES = 1_000
UNKNOWN = "und"
#: Softmax sharpness of the score, and the quantile of cosines below which a text is rejected.
SHARPNESS, REJECT_BELOW = 20.0, 0.005
#: Parts of the sample that in turn are measured from the centroids of the others.
FOLDS = 5

_STEP = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_BITS = np.uint32(32 - DIMENSIONS.bit_length() + 1)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams, or None for a text without a letter."""
    if text is None:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter | np.r_[True, letter[:-1]]  # one gap for any run of other characters
    codes = np.r_[np.uint32(32), codes[keep], np.uint32(32)]
    one = codes * _STEP[0]
    two = one[:-1] + codes[1:] * _STEP[1]
    three = two[:-1] + codes[2:] * _STEP[2]
    hashed = np.concatenate([g * np.uint32(0x27D4EB2F) + np.uint32(n) >> _BITS for n, g in enumerate((one, two, three))])
    return np.bincount(hashed, minlength=DIMENSIONS)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts as normalised TF-IDF vectors."""
    x = np.log1p(counts.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def spherical_centroids(x: np.ndarray, k: int = CENTROIDS, rounds: int = 15) -> np.ndarray:
    """k-means on the sphere, seeded by farthest-first from the mean."""
    centres = [x.mean(0)]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[(x @ np.array(centres).T).max(1).argmin()])
    c = np.array(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        nearest = (x @ c.T).argmax(1)
        c = np.array([x[nearest == i].sum(0) if (nearest == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def least_cosine(x: np.ndarray) -> float:
    """What all but a share REJECT_BELOW of a language's texts exceed, each measured from
    the centroids of the other folds; equal texts are in one fold.  Nothing is rejected
    where a language has fewer different texts than folds."""
    _, copy = np.unique(x, axis=0, return_inverse=True)
    fold = copy.ravel() % FOLDS
    if len(np.unique(fold)) < FOLDS:
        return -1.0
    seen = np.empty(len(x))
    for f in range(FOLDS):
        seen[fold == f] = (x[fold == f] @ spherical_centroids(x[fold != f]).T).max(1)
    return float(np.quantile(seen, REJECT_BELOW))


class CentroidModel:
    def __init__(self, vectors: dict[str, np.ndarray], idf: np.ndarray):
        self.idf = idf.astype(np.float32)
        self.languages = sorted(vectors)
        parts = [spherical_centroids(weighted(vectors[k], self.idf)) for k in self.languages]
        self.centroids = np.concatenate(parts).astype(np.float32) if parts else np.empty((0, DIMENSIONS), np.float32)
        self.starts = np.r_[0, np.cumsum([len(p) for p in parts])[:-1]].astype(int)
        self.least = np.array([least_cosine(weighted(vectors[k], self.idf)) for k in self.languages])

    def predict(self, counts: np.ndarray) -> tuple[list[str], list[float], list[bool]]:
        cosine = np.maximum.reduceat(weighted(counts, self.idf) @ self.centroids.T, self.starts, axis=1)
        best = cosine.argmax(1)
        top = cosine[np.arange(len(best)), best]
        share = 1 / np.exp(SHARPNESS * (cosine - top[:, None])).sum(1)
        rejected = top < self.least[best]
        score = np.clip(np.where(rejected, share * np.maximum(top, 0), share), 0, 1)
        return [self.languages[i] for i in best], score.astype(float).tolist(), rejected.tolist()


def fit(training: DataFrame, text: str = "text", sample: int = SAMPLE) -> CentroidModel:
    """training: doc_id, lang (non-null) and text of the documents to learn from."""
    per_language = [(r[0], r[1]) for r in training.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()]
    if len(per_language) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    share = {k: min(1.0, sample / max(1, len(per_language)) / n) for k, n in per_language}
    picked = F.create_map(*[F.lit(x) for kv in share.items() for x in kv]) if share else F.lit(None)
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = (draw < F.element_at(picked, F.col("lang"))) if share else F.lit(False)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        seen, documents = np.zeros(DIMENSIONS, np.int64), 0
        for b in batches:
            langs, vectors = [], []
            for body, lang, pick in zip(b[text], b["lang"], b["chosen"], strict=True):
                counts = ngram_counts(body)
                if counts is None:
                    continue
                seen += counts > 0
                documents += 1
                if pick:
                    langs.append(lang)
                    vectors.append(np.minimum(counts, 65535).astype(np.uint16).tobytes())
            if langs:
                yield {"lang": langs, "vector": vectors, "dim": [None] * len(langs), "df": [None] * len(langs)}
        dims = [*range(DIMENSIONS), -1]
        none = [None] * len(dims)
        yield {"lang": none, "vector": none, "dim": dims, "df": [*seen.tolist(), documents]}

    found = stored(
        map_rows(training.select("lang", text, chosen.alias("chosen")), run, "lang string, vector binary, dim int, df long"),
        "language_fit",
    )
    df = dict(map(tuple, found.where("dim is not null").groupBy("dim").agg(F.sum("df")).collect()))
    documents = df.pop(-1, 0)
    idf = np.log((1 + documents) / (1 + np.array([df.get(i, 0) for i in range(DIMENSIONS)]))) + 1
    vectors: dict[str, list[np.ndarray]] = {}
    for lang, vector in found.where("vector is not null").select("lang", "vector").orderBy("lang", "vector").collect():
        vectors.setdefault(lang, []).append(np.frombuffer(bytes(vector), np.uint16))
    return CentroidModel({k: np.array(v) for k, v in vectors.items()}, idf)


def identify(docs: DataFrame, model: CentroidModel, text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and rejected of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        m: CentroidModel = shared.value
        for b in batches:
            for s in range(0, len(b[text]), 256):
                counts = [ngram_counts(t) for t in b[text][s : s + 256]]
                langs, scores, rejected = [UNKNOWN] * len(counts), [0.0] * len(counts), [False] * len(counts)
                known = [i for i, c in enumerate(counts) if c is not None]
                if known and m.languages:
                    for i, *found in zip(known, *m.predict(np.array([counts[i] for i in known])), strict=True):
                        langs[i], scores[i], rejected[i] = found
                yield {
                    "doc_id": b["doc_id"][s : s + 256],
                    "held_out": b["held_out"][s : s + 256],
                    "lang_pred": langs,
                    "score": scores,
                    "rejected": rejected,
                }

    schema = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
    return map_rows(docs.select("doc_id", "held_out", text), run, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 4, 2))
    training = docs.where("not held_out and lang is not null and doc_id is not null")
    return identify(docs, fit(training))
