"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key ``-ln(u) / w`` (u: a hash of the row,
w: its quality weight).  Within a source, documents are ordered by key and
their sizes prefix-summed against the source's word budget: complete epochs of
the source come first, then the fractional selection in key order, the last
document in part.

A source may hold a third of all rows, so no source is ever sorted in one task:
keys are cut into order-preserving buckets, bucket sums are prefix-summed per
source, and rows are sorted only inside their (source, bucket).  The cut follows
the distribution that keys have, a mixture of exponentials over a histogram of
the weights, so all buckets are about equally full.  Targets take a row a source
in one task: sources may be many thousands, but not as many as documents.

Defined results: a null or empty text has size 0 and takes nothing; a null
source is a source of its own, last in order; repeated rows each count; the key
depends on doc_id, text and seed only, so reruns agree; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.llm.common import WORD, stored, table

LEAST_WEIGHT = 0.1
MOST_EPOCHS = 3
#: Rows of all sources that a bucket holds on average, and steps of the histogram of weights.
ROWS_A_BUCKET, WEIGHT_STEPS = 2_000, 32


def quality_weight(text: str = "text") -> Column:
    """Between LEAST_WEIGHT and 1: the share of letters among visible characters."""
    body = F.coalesce(F.col(text), F.lit(""))
    seen = F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", ""))
    letters = F.length(F.regexp_replace(body, r"[^\p{L}]+", ""))
    return F.greatest(F.lit(LEAST_WEIGHT), F.coalesce(letters / F.nullif(seen, F.lit(0)), F.lit(LEAST_WEIGHT)))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> also weight and target.

    Targets share the total of all sizes by weight; a target stops at ``most``
    times its source's size.  In order of that bound per unit of weight, the
    capped sources are a prefix, so the level is found by running sums.
    One row a source: the windows here never see documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    caps = sizes.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ).withColumn("cap", F.col("source_size").cast("double") * most)
    ratio = F.col("cap") / F.col("weight")
    order = Window.orderBy(ratio, F.col("source").isNull(), F.col("source"))
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.sum("source_size").over(everything)
    left_words = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = left_words / left_weight  # if all before this source are capped
    levels = caps.withColumn("_level", level).withColumn("_ratio", ratio)
    # the first source whose bound isn't reached sets the level for the rest
    final = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(everything)["_level"]
    return levels.withColumn("_final", final).select(
        "source", "source_size", "weight", F.least("cap", F.col("_final") * F.col("weight")).alias("target")
    )


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), text: str = "text", seed: int = 42, weight: Column | None = None
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, key, epochs, taken."""
    w = quality_weight(text) if weight is None else F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(1.0), weight))
    u = (F.xxhash64(F.lit(seed), "doc_id", F.col(text)).bitwiseAND((1 << 52) - 1) + 0.5) / float(1 << 52)
    narrow = stored(
        docs.select(
            "doc_id",
            "source",
            F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
            (-F.log(u) / w).alias("key"),
            w.alias("weight"),
        ),
        "keys",
    )
    steps = narrow.groupBy(F.floor(F.col("weight") * WEIGHT_STEPS)).agg(F.count("*"), F.avg("weight")).collect()
    n = sum(r[1] for r in steps)
    parts = max(1, n // ROWS_A_BUCKET)
    # the share of smaller keys, by the mixture: below 1, and in the order of the keys
    share = sum(((1 - F.exp(-F.col("key") * r[2])) * (r[1] / n) for r in sorted(steps)), F.lit(0.0))
    rows = narrow.drop("weight").withColumn("bucket", F.floor(share * parts).cast("long"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights)
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)))
    t, b, r = targets.alias("t"), starts.alias("b"), rows.alias("r")
    budgets = b.join(t, F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        "b.source", "b.bucket", "b.bucket_start", "t.source_size", "t.target"
    )
    joined = r.join(
        budgets.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")) & (F.col("r.bucket") == F.col("g.bucket"))
    ).select("r.*", "g.bucket_start", "g.source_size", "g.target")
    inside = (
        Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.col("bucket_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.round("target").cast("long")
    per = F.when(F.col("source_size") > 0, F.col("source_size")).otherwise(F.lit(1))
    epochs = F.floor(budget / per).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * per - start))
    return (
        joined.withColumn("epochs", epochs)
        .withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "key", "epochs", "taken")
    )


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the mix over all documents that came this far."""
    return mix(docs.select("doc_id", "text", "source")).select(
        "doc_id", "source", "size", "source_size", "target", "epochs", "taken"
    )
