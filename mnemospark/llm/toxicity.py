"""Toxicity: subsequence string kernel SVM with Nystrom landmarks.

The kernel of two strings counts their common subsequences of three characters,
each weighted by DECAY to the length it spans (spans beyond SPAN weigh nothing),
and is normalised.  Gaps are allowed, so ``id-i.ot`` and ``idxiot`` stay close
to ``idiot``.

A text is cut into sentences, and a sentence into units: words, less what is no
letter or digit inside them, and runs of single letters joined.  Labels belong
to documents, so training is multiple-instance: a sentence of a toxic document
is represented by units far more often in toxic documents than chance has it.
Copies are no evidence: documents with the same least shingle hash count once.
What chance does is seen in the sample itself: its labels are dealt anew by a
hash, and the largest evidence of any unit under dealt labels is the bound.
Where no unit exceeds it, those of largest evidence stand in.  Each of these is
joined by virtual examples, itself with a letter put in somewhere.  Units
common in clean documents are negatives.  Landmarks are chosen among both,
kernel rows are whitened (Nystrom), a squared-hinge SVM is fitted, and its
solution is folded back into one weight per subsequence, which scores any unit
exactly as the landmark expansion would.  A logistic function of a document's
largest unit margins, fitted on sampled documents, gives the score; besides, one
unit speaks for itself if its margin exceeds the bar of the family of landmarks
nearest to it, which no clean document of the sample reaches by such units.

Fitting uses a bounded sample (``TOXIC_DOCS``, ``CLEAN_DOCS``, in expectation)
chosen by a hash of doc_id.  Every whole text is scored.

Defined results: a null or empty text has no units and gets the score of a text
whose margins are all least; without units in toxic and in clean training
documents every score is 0; a document labelled twice counts each label; repeated rows get
equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.common import held_out, map_rows, stored, table

TOXIC_DOCS, CLEAN_DOCS = 4_000, 8_000
POSITIVES, NEGATIVES, LANDMARKS = 1_000, 4_000, 384
#: Virtual examples in all (two of each positive unit at least).
VIRTUAL = 6_000
#: Least share of toxic documents among those of a unit that stands for toxic sentences.
SHARE = 0.8
#: How often labels are dealt anew to see what evidence chance gives.
DEALS = 8
#: The least bar, and up to how many clean texts it holds in full; the kernel from which two
#: landmarks are of one family.
LEAST_BAR, FEW, KIN = 0.3, 1_000, 0.35
#: How far above what clean texts reach a bar is, at least.
HEADROOM = 0.1
#: Rounds of refitting with the clean units of the largest margins, and how many join each time.
HARD_ROUNDS, HARD = 3, 1_500
DECAY, SPAN = 0.6, 6
CUT = 0.3
#: Longer units are learned and scored in overlapping pieces, so no character is left out.
PIECE, OVERLAP = 24, 12
LETTERS = 64
#: Words of a shingle by which copies are told.
SHINGLE = 5
_SIZE = LETTERS**3
FLOOR = -1.5
_PUT_IN = "abcdefghijklmnopqrstuvwxyz"

#: Digits and signs that stand for letters.
_LOOKS = str.maketrans("013457@$", "oieastas")
_GAP = re.compile(r"[\x20\x09-\x0D]+")
_INNER = re.compile(r"[^\w@$]+|_")
_SENTENCE = re.compile(r"(?<=[.!?])[\x20\x09-\x0D]+|\n+")


class Codes(dict):
    """character -> code 1..63: a to z, others by their number, so that the letters of an
    alphabet, which have numbers in a row, have codes of their own."""

    def __missing__(self, ch: str) -> int:
        code = self[ch] = ord(ch) - 96 if "a" <= ch <= "z" else 27 + ord(ch) % 37
        return code


def units(text: str | None) -> list[list[str]]:
    """Units of each sentence: cleaned words, and runs of single letters joined."""
    out = []
    for sentence in _SENTENCE.split(text) if text else ():
        found, run = [], []
        for word in _GAP.split(sentence):
            unit = word.lower()
            if not unit.isalpha():
                unit = _INNER.sub("", unit).translate(_LOOKS)
            if len(unit) == 1:
                run.append(unit)
                continue
            if len(run) > 2:
                found.append("".join(run))
            run = []
            if unit:
                found.append(unit)
        if len(run) > 2:
            found.append("".join(run))
        if found:
            out.append(found)
    return out


def pieces(unit: str) -> list[str]:
    if len(unit) <= PIECE:
        return [unit]
    return [unit[s : s + PIECE] for s in range(0, len(unit) - OVERLAP, PIECE - OVERLAP)]


class Kernel:
    """Subsequence features of strings of equal length, worked out together."""

    def __init__(self) -> None:
        self.codes = Codes()
        self.triples: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _of_length(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n not in self.triples:
            found = [
                (i, j, k) for i in range(n) for j in range(i + 1, min(n, i + SPAN)) for k in range(j + 1, min(n, i + SPAN))
            ]
            t = np.array(found, np.int64).reshape(-1, 3)
            self.triples[n] = t, (DECAY ** (t[:, 2] - t[:, 0] + 1)).astype(np.float32)
        return self.triples[n]

    def features(self, strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers of the strings, subsequences, their weights scaled to norm 1)."""
        by_length: dict[int, list[int]] = {}
        for i, s in enumerate(strings):
            by_length.setdefault(len(s), []).append(i)
        code = self.codes.__getitem__
        for n, which in by_length.items():
            t, weight = self._of_length(n)
            if not len(t):
                continue
            chars = np.array([list(map(code, strings[i])) for i in which], np.int64)
            sub = (chars[:, t[:, 0]] * LETTERS + chars[:, t[:, 1]]) * LETTERS + chars[:, t[:, 2]]
            order = np.argsort(sub, axis=1)
            ranked, w = np.take_along_axis(sub, order, 1), weight[order]
            head = np.ones(ranked.shape, bool)
            head[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
            sums = np.add.reduceat(w.ravel(), np.flatnonzero(head.ravel()))  # one sum a string and subsequence
            rows = np.repeat(np.arange(len(which)), head.sum(1))
            norm = np.sqrt(np.bincount(rows, sums * sums, len(which)))
            yield np.array(which), sub, weight[None, :] / norm[:, None].astype(np.float32)

    def against(self, strings: list[str], table: Table) -> np.ndarray:
        """Products of normalised features with the columns of a table of subsequence weights."""
        out = np.zeros((len(strings), table.rows.shape[1]), np.float32)
        for which, sub, weight in self.features(strings):
            for s in range(0, len(which), 128):
                out[which[s : s + 128]] = np.einsum("nt,ntm->nm", weight[s : s + 128], table.rows[table.place[sub[s : s + 128]]])
        return out

    def columns(self, strings: list[str]) -> Table:
        """The normalised features of some strings as columns of such a table."""
        found = list(self.features(strings))
        used = np.unique(np.concatenate([sub.ravel() for _, sub, _ in found])) if found else np.empty(0, np.int64)
        table = Table(used, len(strings))
        for which, sub, weight in found:
            np.add.at(table.rows, (table.place[sub], which[:, None]), weight)
        return table


class Table:
    """A row of weights for each subsequence that is used; row 0 is for all others."""

    def __init__(self, used: np.ndarray, columns: int):
        self.used = used
        self.place = np.zeros(_SIZE, np.int32)
        self.place[used] = np.arange(1, len(used) + 1)
        self.rows = np.zeros((len(used) + 1, columns), np.float32)


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 3e-4, rounds: int = 25) -> np.ndarray:
    """Linear SVM with squared hinge loss by Newton steps; the last coefficient is the bias."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        a = x[inside] * weight[inside, None]
        new = np.linalg.solve(a.T @ x[inside] / len(x) + ridge * np.eye(len(w)), a.T @ y[inside] / len(x))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


class UnitSvm:
    """Scores units; folded to one weight per subsequence."""

    def __init__(self, positive: list[str], negative: list[str], marks: list[str] | None = None):
        kernel = Kernel()
        self.marks = self._landmarks(kernel, positive) if marks is None else marks
        marks = self.marks + negative[:: max(1, len(negative) // (LANDMARKS // 2))][: LANDMARKS // 2]
        table = kernel.columns(marks)
        among = (table.rows.T @ table.rows).astype(float)
        values, vectors = np.linalg.eigh(among)
        keep = values > 1e-6
        whiten = vectors[:, keep] / np.sqrt(values[keep])
        x = kernel.against(positive + negative, table).astype(float) @ whiten
        y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
        w = _squared_hinge(x, y, np.where(y > 0, len(y) / 2 / len(positive), len(y) / 2 / len(negative)))
        self.weights = Table(table.used, 1)
        self.weights.rows[:, 0] = table.rows.astype(float) @ (whiten @ w[:-1])
        self.bias = float(w[-1])

    @staticmethod
    def _landmarks(kernel: Kernel, strings: list[str]) -> list[str]:
        """The strings in order, less those close to one already taken."""
        strings = strings[: 2 * LANDMARKS]
        near = kernel.against(strings, kernel.columns(strings)) >= 0.7
        chosen: list[int] = []
        for i in range(len(strings)):
            if len(chosen) < LANDMARKS // 2 and not near[i, chosen].any():
                chosen.append(i)
        return [strings[i] for i in chosen]


def families(kin: np.ndarray) -> np.ndarray:
    """The least number that each landmark is linked with, over any others."""
    out = np.arange(len(kin))
    while True:
        new = np.array([out[row].min() for row in kin], np.int64) if len(kin) else out
        if (new == out).all():
            return out
        out = new


class Scorer(dict):
    """unit -> (margin, family of the nearest landmark or -1), remembering recent units
    within a fixed bound.  The landmark is looked for where the margin exceeds 0."""

    LIMIT = 300_000

    def __init__(self, svm: UnitSvm):
        super().__init__()
        self.svm, self.kernel = svm, Kernel()
        self.near = self.kernel.columns(svm.marks)
        self.family = families(self.kernel.against(svm.marks, self.near) >= KIN)

    def learn(self, wanted: set[str]) -> None:
        new = [u for u in wanted if u not in self]
        if len(self) + len(new) > self.LIMIT:
            self.clear()
            new = list(wanted)
        parts = [(u, p) for u in new for p in pieces(u)]
        margin = np.minimum(self.kernel.against([p for _, p in parts], self.svm.weights)[:, 0] + self.svm.bias, 1.5)
        mark = np.full(len(parts), -1)
        close = np.flatnonzero(margin > 0)
        if len(close):
            mark[close] = self.family[self.kernel.against([parts[i][1] for i in close.tolist()], self.near).argmax(1)]
        for (u, _), m, k in zip(parts, margin.tolist(), mark.tolist(), strict=True):
            self[u] = max(self.get(u, (FLOOR, -1)), (m, k))


def margins(texts: list[str | None], scorer: Scorer, bars: np.ndarray | None = None) -> tuple[np.ndarray, list[dict[int, float]]]:
    """The three largest margins of each text's different units, how many exceed 0, and
    by how much one exceeds its bar; also the largest margin near each family."""
    cut = [{u for sentence in units(t) for u in sentence} for t in texts]
    out, tops = np.full((len(texts), 5), FLOOR), []
    for i, found in enumerate(cut):
        scorer.learn(found)
        both = [scorer[u] for u in found]
        values = np.sort(np.array([m for m, _ in both]))[::-1]
        out[i, : min(3, len(values))] = values[:3]
        out[i, 3] = np.log1p((values > 0).sum())
        top: dict[int, float] = {}
        for m, k in both:
            if k >= 0:
                top[k] = max(m, top.get(k, m))
        tops.append(top)
        if bars is not None and top:
            out[i, 4] = max(m - bars[k] for k, m in top.items())
    return out, tops


class ToxicityModel:
    """The SVM, the logistic weights of a text's margins, and the bars of the families."""

    def __init__(self, svm: UnitSvm, logistic: np.ndarray, bars: np.ndarray):
        self.svm, self.logistic, self.bars = svm, logistic, bars

    def score(self, features: np.ndarray) -> np.ndarray:
        together = np.c_[features[:, :4], np.ones(len(features))] @ self.logistic
        alone = 10 * features[:, 4] - 0.8
        return 1 / (1 + np.exp(-np.clip(np.maximum(together, alone), -30, 30)))


def family_bars(tops: list[dict[int, float]], marks: int) -> np.ndarray:
    """For each family the largest margin of these clean texts, or the least bar, which
    comes down as more of them show that there is none."""
    bars = np.full(marks, max(HEADROOM, LEAST_BAR * min(1.0, FEW / max(1, len(tops)))))
    for top in tops:
        for k, m in top.items():
            bars[k] = max(bars[k], m + HEADROOM)
    return bars


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def variants(unit: str, most: int) -> list[str]:
    """The unit with a letter put in: virtual examples of masked insults."""
    found = {unit[:at] + _PUT_IN[(len(unit) * 7 + at * 5 + j * 11) % 26] + unit[at:] for at in range(1, len(unit)) for j in range(2)}
    return sorted(found, key=lambda v: (xxhash.xxh64_intdigest(v.encode("utf-8", "surrogatepass")), v))[:most]


def copy_key(found: list[str]) -> int:
    """Least hash of a text's shingles: the same for most near copies."""
    joined = [" ".join(found[i : i + SHINGLE]) for i in range(max(1, len(found) - SHINGLE + 1))]
    return min(xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in joined) - (1 << 63)


def _hardest(clean: DataFrame, svm: UnitSvm) -> list[str]:
    shared = clean.sparkSession.sparkContext.broadcast(svm)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        kernel = Kernel()
        for b in batches:
            yield {"unit": b["unit"], "m": kernel.against(b["unit"], shared.value.weights)[:, 0]}

    scored = map_rows(clean, run, "unit string, m double")
    return [r[0] for r in scored.orderBy(F.desc("m"), "unit").limit(HARD).select("unit").collect()]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> ToxicityModel | None:
    """docs: doc_id and text; labels: doc_id and toxic (0 or 1), to learn from."""
    labels = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic")
    n = dict(map(tuple, labels.groupBy("toxic").count().collect()))
    if not n.get(0) or not n.get(1):
        return None
    share = F.when(F.col("toxic") == 1, min(1.0, TOXIC_DOCS / n[1])).otherwise(min(1.0, CLEAN_DOCS / n[0]))
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = labels.where(draw < share)  # bounded by the sample's parameters
    sample = stored(docs.join(F.broadcast(chosen), "doc_id").select(text, "toxic").dropDuplicates(), "toxicity_sample")

    def unit_rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out_unit, out_toxic, out_key = [], [], []
            for body, toxic in zip(b[text], b["toxic"], strict=True):
                found = [u for sentence in units(body) for u in sentence]
                mine = {p for u in found for p in pieces(u)} | {""}  # "" counts the texts
                out_unit += mine
                out_toxic += [toxic] * len(mine)
                out_key += [copy_key(found)] * len(mine)
            yield {"unit": out_unit, "toxic": out_toxic, "key": out_key}

    rows = map_rows(sample.select(text, "toxic"), unit_rows, "unit string, toxic int, key long").distinct()
    rows = stored(rows, "toxicity_rows")
    n = dict(map(tuple, rows.where("unit = ''").groupBy("toxic").count().collect()))
    if not n.get(0) or not n.get(1):
        return None
    base = n[1] / (n[0] + n[1])
    dealt = [(F.pmod(F.xxhash64(F.lit(k), "key"), F.lit(1 << 20)) < base * (1 << 20)).cast("int") for k in range(DEALS)]
    counted = stored(
        rows.where("unit <> ''")
        .groupBy("unit")
        .agg(
            F.sum("toxic").alias("t"),
            F.sum(1 - F.col("toxic")).alias("c"),
            *[F.sum(x).alias(f"t{k}") for k, x in enumerate(dealt)],
        ),
        "toxicity_units",
    )

    def surprise(t: Column) -> Column:
        """Chernoff bound on seeing a unit so often in toxic documents by chance, as -log(p)."""
        n = F.col("t") + F.col("c")
        share = t / n
        rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
        return F.when(share > base, n * (share * F.log(share / base) + rest)).otherwise(0.0)

    units_of = counted.withColumn("surprise", surprise(F.col("t"))).withColumn("share", F.col("t") / (F.col("t") + F.col("c")))
    chance = [F.max(F.when(F.col(f"t{k}") >= SHARE * (F.col("t") + F.col("c")), surprise(F.col(f"t{k}")))) for k in range(DEALS)]
    bound = float(np.median([x or 0.0 for x in counted.agg(*chance).first()]))
    told = units_of.where((F.col("surprise") > bound) & (F.col("share") >= SHARE))
    bad = [r[0] for r in told.orderBy(F.desc("surprise"), "unit").limit(POSITIVES).select("unit").collect()]
    if not bad:  # no unit exceeds chance: the best there are
        bound = units_of.where("t > 0").agg(F.max("surprise")).first()[0] or 0.0
        best = units_of.where((F.col("t") > 0) & (F.col("surprise") >= bound)).orderBy(F.desc("share"), "unit").limit(POSITIVES)
        bad = [r[0] for r in best.select("unit").collect()]
    # units of more evidence than chance has that are in clean documents too tell neither
    clean = units_of.where((F.col("c") >= 1) & ((F.col("surprise") <= bound) | (F.col("share") < 0.5)))
    common = clean.orderBy(F.desc("c"), "unit").limit(NEGATIVES // 2)
    rare = clean.orderBy(F.xxhash64("unit"), "unit").limit(NEGATIVES // 2)
    good = [r[0] for r in common.select("unit").unionByName(rare.select("unit")).distinct().orderBy(F.xxhash64("unit"), "unit").collect()]
    if not bad or not good:
        return None
    virtual = [v for u in bad for v in variants(u, max(2, VIRTUAL // len(bad)))]
    svm = UnitSvm(bad + virtual, good)
    for _ in range(HARD_ROUNDS):  # the clean units nearest to the insults join the negatives
        hard = _hardest(clean.select("unit"), svm)
        good += sorted(set(hard) - set(good))
        svm = UnitSvm(bad + virtual, good, svm.marks)
    shared = docs.sparkSession.sparkContext.broadcast(svm)

    def feature_rows(batches: Iterator[dict]) -> Iterator[dict]:
        scorer = Scorer(shared.value)
        for b in batches:
            x, tops = margins(b[text], scorer)
            yield {"toxic": b["toxic"], "x": list(x), "near": [list(t.items()) for t in tops]}

    kind = "toxic int, x array<double>, near array<struct<mark:int,m:double>>"
    rows = map_rows(sample.select(text, "toxic"), feature_rows, kind).collect()
    x, y = np.array([r[1][:4] for r in rows]), np.array([r[0] for r in rows], float)
    order = np.lexsort((*x.T, y))
    bars = family_bars([dict(map(tuple, r[2])) for r in rows if not r[0]], len(svm.marks))
    return ToxicityModel(svm, _logistic(x[order], y[order]), bars)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        m = shared.value
        scorer = Scorer(m.svm) if m else None
        for b in batches:
            for s in range(0, len(b[text]), 128):
                part = b[text][s : s + 128]
                score = m.score(margins(part, scorer, m.bars)[0]) if m else np.zeros(len(part))
                yield {
                    "doc_id": b["doc_id"][s : s + 128],
                    "held_out": b["held_out"][s : s + 128],
                    "score": score,
                    "predicted": (score >= CUT).astype(np.int32),
                }

    return map_rows(docs.select("doc_id", "held_out", text), run, "doc_id long, held_out boolean, score double, predicted int")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 4, 2))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out("doc_id", 4, 2))
    return score_toxicity(docs, fit(docs.select("doc_id", "text"), labels))
