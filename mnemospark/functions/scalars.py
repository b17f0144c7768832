"""Scoring, identity and formatting functions, as columns or small Python helpers."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
K1, B = 1.2, 0.75
RRF_K = 60
#: Memory layers with their weight and their half-life in days (None: no decay).
LAYERS = {"semantic": (10, None), "procedural": (7, 180), "artifact": (3, 365), "episodic": (2, 30)}
OTHER_HALF_LIFE = 90
EDGE_TYPES = ("RESOLVES", "SUPERSEDES", "CONTRADICTS", "DERIVED_FROM", "OCCURRED_IN", "CONSTRAINS")
WILSON_Z = 1.959963984540054
DEFAULT_DIMENSIONS, LEAST_DIMENSIONS, MOST_DIMENSIONS = 384, 8, 8192
MOST_DISTANCE = 2.0


def d(x: float) -> Column:
    return F.lit(float(x))


def bm25_idf(documents: Column, df: Column) -> Column:
    return F.log(d(1) + (documents - df + d(0.5)) / (df + d(0.5)))


def bm25_norm(tf: Column, length: Column, average: Column) -> Column:
    mean = F.when(average == 0, d(1)).otherwise(average)
    return tf * d(K1 + 1) / (tf + d(K1) * (d(1 - B) + d(B) * length / mean))


def decay(layer: Column, created_at: Column, now: int) -> Column:
    """Half-life decay by layer; 1 for the layer that never ages."""
    age = F.greatest(d(0), (F.lit(now) - created_at) / d(DAY_MS))
    out = F.when(layer == "semantic", d(1))
    for name, (_, days) in LAYERS.items():
        if days:
            out = out.when(layer == name, F.pow(d(0.5), age / d(days)))
    return out.otherwise(F.pow(d(0.5), age / d(OTHER_HALF_LIFE)))


def recency_score(coverage: Column, importance: Column, decayed: Column) -> Column:
    return coverage * F.when(importance == 0, d(1)).otherwise(importance) * decayed


def rrf(rank: Column) -> Column:
    return d(1) / (d(RRF_K) + rank)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), d(0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    below = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(below == 0, d(0)).otherwise(dot(a, b) / below)


def l2_normalized(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm == 0, a).otherwise(F.transform(a, lambda x: x / norm))


def layer_rank(layer: Column) -> Column:
    order = ("semantic", "procedural", "episodic", "artifact")
    out = F.when(layer == order[0], 0)
    for i, name in enumerate(order[1:], 1):
        out = out.when(layer == name, i)
    return out.otherwise(len(order))


def layer_weight(layer: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, (weight, _) in LAYERS.items():
        out = out.when(layer == name, weight)
    return out.otherwise(0)


def age_days(created_at: Column, now: int) -> Column:
    return F.floor((F.lit(now) - created_at) / F.lit(DAY_MS))


def token_cost(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(4))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def normalized_body(text: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"[ \t]+", " "), r"\A(?U:\s)+|(?U:\s)+\z", ""
    )


def node_id(layer: Column, source_ref: Column, body: Column) -> Column:
    joined = F.concat_ws(" ", layer, source_ref, normalized_body(body))
    return F.concat(F.lit("mem_"), F.left(F.sha2(joined, 256), F.lit(24)))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def short_hash(content: Column, length: int = 16) -> Column:
    return F.left(content_hash(content), F.lit(length))


def clean_identifier(text: Column) -> Column:
    """One name of a written one: without generics and qualifiers; null if that is none."""
    last = F.element_at(F.split(F.regexp_replace(F.trim(text), r"(?s)<.*$", ""), "[.:]"), -1)
    return F.when(last.rlike(r"\A[A-Za-z_$][A-Za-z0-9_$-]{0,126}[?!]?\z"), last)


def quoted_label(text: Column, width: int = 60) -> Column:
    """Text that is safe inside a diagram label."""
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(text, r"""[\[\]{}()"'`<>|]""", ""), r"\s+", " ")), F.lit(width))


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % interval of a share; (0, 1) when nothing was counted."""
    p, z2 = hits / n, WILSON_Z**2
    middle = p + z2 / (2 * n)
    half = WILSON_Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    low = F.greatest(d(0), (middle - half) / (1 + z2 / n))
    high = F.least(d(1), (middle + half) / (1 + z2 / n))
    return F.when(n == 0, d(0)).otherwise(low), F.when(n == 0, d(1)).otherwise(high)


def parent_name(symbol: Column) -> Column:
    """The qualified name less its last dotted part ("" for a bare name)."""
    return F.when(F.instr(symbol, ".") > 0, F.regexp_replace(symbol, r"\.[^.]*$", "")).otherwise(F.lit(""))


def container_prefixes(name: Column, most: int = 4) -> Column:
    """Dotted prefixes of a name, longest first."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    return F.transform(
        F.slice(F.sequence(n, F.lit(1), F.lit(-1)), F.lit(1), F.least(F.lit(most), n)), lambda k: F.array_join(F.slice(parts, 1, k), ".")
    )


def title_for(path: Column, headings: Column, part: Column, parts: Column) -> Column:
    """parent / (heading > chain), or parent / file (i/n) for a text in several parts."""
    steps = F.split(path, "/")
    base, parent = F.element_at(steps, -1), F.when(F.size(steps) > 1, F.element_at(steps, -2))
    own = F.when(F.size(headings) > 0, F.array_join(headings, " > ")).when(
        parts > 1, F.concat(base, F.lit(" ("), part, F.lit("/"), parts, F.lit(")"))
    ).otherwise(base)
    return F.concat_ws(" / ", parent, own)


# ---------------------------------------------------------------- driver-side helpers


def parse_dimensions(value: str | None) -> int:
    if value is None or value == "":
        return DEFAULT_DIMENSIONS
    if not re.fullmatch(r"[0-9]+", value):
        raise ValueError(f"dimensions must be digits only, not {value!r}")
    n = int(value)
    if not LEAST_DIMENSIONS <= n <= MOST_DIMENSIONS:
        raise ValueError(f"dimensions must lie between {LEAST_DIMENSIONS} and {MOST_DIMENSIONS}, not {n}")
    return n


def clamp_distance(value: float) -> float:
    return min(value, MOST_DISTANCE)


def canonical_path(path: str) -> str:
    """One spelling of a path: forward slashes, upper-case drive, no trailing slash."""
    p = path.removeprefix("\\\\?\\").replace("\\", "/")
    p = re.sub(r"^([a-z]):", lambda m: m[1].upper() + ":", p)
    p = posixpath.normpath(p)
    return p if p in ("/", ".") or re.fullmatch(r"[A-Z]:/", p) else p.rstrip("/")


def is_path(target: str) -> bool:
    """Whether a target names a file and not a symbol."""
    return "/" in target or "\\" in target or bool(re.search(r"\.[a-z0-9]{1,6}$", target, re.I))
