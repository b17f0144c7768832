"""Retrieval evaluation, reports and health checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.scalars import wilson
from mnemospark.operators.graph import orphans
from mnemospark.operators.retrieval import live


def recall(judged: DataFrame) -> DataFrame:
    """n, hits and the 95 % interval of (query_id, hit) rows."""
    sums = judged.agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("hits"))
    low, high = wilson(F.col("hits").cast("double"), F.col("n").cast("double"))
    return sums.select("n", "hits", low.alias("low"), high.alias("high"))


def judge(hits: DataFrame, questions: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, hit, rejected): whether a top reference holds an expected, or a rejected, text."""
    best = hits.where(F.col("position") <= most).select("query_id", "source_ref")
    both = questions.join(best, "query_id", "left")
    any_of = lambda c: F.coalesce(F.max(F.exists(c, lambda x: F.col("source_ref").contains(x)).cast("int")), F.lit(0))
    return both.groupBy("query_id").agg(any_of("expect").alias("hit"), any_of("reject").alias("rejected"))


def missed(hits: DataFrame, questions: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, got): questions without a hit, and the first references they got."""
    lost = judge(hits, questions).where("hit = 0").select("query_id")
    got = hits.where(F.col("position") <= most).groupBy("query_id")
    got = got.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "source_ref"))), lambda x: x["source_ref"]).alias("got"))
    return lost.join(got, "query_id", "left").select("query_id", F.coalesce("got", F.array().cast("array<string>")).alias("got"))


def phrasings(questions: DataFrame) -> DataFrame:
    """One row for each way a question is put: (query_id, id, q, expect, reject)."""
    also = F.col("also") if "also" in questions.columns else F.lit(None).cast("string")
    put = questions.select("id", "expect", "reject", F.explode(F.array("ask", also)).alias("q")).where("q is not null")
    return put.select(F.xxhash64("id", "q").alias("query_id"), "id", "q", "expect", "reject")


def stats(memory: DataFrame, relations: list[DataFrame], vector: DataFrame) -> DataFrame:
    """(layer, n): memories by layer, edges of all kinds, and memories with a vector."""
    out = memory.groupBy("layer").agg(F.count("*").alias("n"))
    ends = [r.select(F.lit(1).alias("one")) for r in relations]
    every = ends[0]
    for e in ends[1:]:
        every = every.unionByName(e)
    out = out.union(every.agg(F.count("*").alias("n")).select(F.lit("edges"), "n"))
    embedded = memory.join(vector.select("id").distinct(), "id", "left_semi").agg(F.count("*").alias("n"))
    return out.union(embedded.select(F.lit("embedded"), "n"))


def vector_spaces(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("model", F.size("embedding").cast("long").alias("dims"), "provider").agg(F.count("*").alias("n"))


def doctor(memory: DataFrame, edge: DataFrame, about: DataFrame, vector: DataFrame, more: dict[str, DataFrame] | None = None, space: tuple[str, str] | None = None) -> DataFrame:
    """(name, n, status): one row a check.

    more: postings, symbol, calls, pending and journal, as far as there are any; space:
    the model and provider in use.
    """
    alive, more = live(memory), more or {}
    counts = {
        "nodes": alive.agg(F.count("*").alias("n")),
        "edges": edge.agg(F.count("*").alias("n")),
        "embedded": alive.join(vector.select("id").distinct(), "id", "left_semi").agg(F.count("*").alias("n")),
        "spaces": vector_spaces(vector).agg(F.count("*").alias("n")),
        "orphans": orphans(memory, edge, about).agg(F.count("*").alias("n")),
        "anchors": alive.where("coalesce(file_path, '') = ''").agg(F.count("*").alias("n")),
    }
    if space is not None:
        other = (F.col("model") != space[0]) | (F.col("provider") != space[1])
        counts["model drift"] = vector.where(other).agg(F.count("*").alias("n"))
    if "postings" in more:
        text = memory.where(F.concat_ws("", "title", "body").rlike("[A-Za-z0-9]")).select("id")
        counts["keyword index"] = text.join(more["postings"].select("id").distinct(), "id", "left_anti").agg(F.count("*").alias("n"))
    for name in ("symbol", "calls", "pending", "journal"):
        if name in more:
            counts[{"symbol": "code reader", "calls": "code graph", "pending": "unresolved calls"}.get(name, name)] = more[name].agg(F.count("*").alias("n"))
    status = {
        "model drift": F.when(F.col("n") == 0, "ok").otherwise("warn"),
        "keyword index": F.when(F.col("n") == 0, "ok").otherwise("fail"),
        "journal": F.when(F.col("n") == 0, "ok").otherwise("warn"),
        "nodes": F.when(F.col("n") > 0, "ok").otherwise("warn"),
        "spaces": F.when(F.col("n") <= 1, "ok").otherwise("warn"),
        "orphans": F.when(F.col("n") == 0, "ok").otherwise("warn"),
    }
    out = None
    for name, df in counts.items():
        row = df.select(F.lit(name).alias("name"), "n", status.get(name, F.lit("ok")).alias("status"))
        out = row if out is None else out.unionByName(row)
    return out


def within_budget(ranked: DataFrame, by: str, cost: Column, budget: int) -> DataFrame:
    """The first row of each group and those behind it while the running cost fits."""
    w = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("cost", cost).withColumn("running", F.sum("cost").over(w)).where((F.col("rank") == 1) | (F.col("running") <= budget))


def dense_files(chunks: DataFrame, files: DataFrame, least: int = 500, per: int = 400) -> DataFrame:
    """Files cut into suspiciously many chunks for their length."""
    counted = chunks.groupBy("path").agg(F.count("*").alias("chunks")).where(F.col("chunks") >= least)
    return counted.join(files.select("path", F.length("content").alias("n")), "path").where(F.col("chunks") > F.col("n") / per).select("path", "chunks")


#: Words by which a question is known, and openings that are none.
ASKS = (
    r"(?i)\?|(?<![A-Za-z0-9_])(?:why|how|what|where|which|when|does|do|is|are|can|should"
    r"|tai sao|vi sao|the nao|lam sao|nhu the nao|o dau|cai gi|co phai|dung khong|chua)(?![A-Za-z0-9_])"
    r"|tại sao|vì sao|thế nào|làm sao|như thế nào|ở đâu|cái gì|có phải|đúng không|chưa"
)
NOISE = r"(?i)^(ok|oke|okay|yes|no|next|push|continue|thanks)(?![A-Za-z0-9_])|^[/<]"


def harvest_questions(turns: DataFrame, least: int = 12) -> DataFrame:
    """Distinct questions that users asked (conv_id, turn, role, text)."""
    t = F.trim("text")
    asked = turns.where((F.col("role") == "user") & (F.length(t) >= least) & t.rlike(ASKS) & ~t.rlike(NOISE) & ~t.contains("```"))
    asked = asked.where(F.size(F.split(t, "\n")) <= 8).select("conv_id", "turn", F.left(F.regexp_replace(t, r"\s+", " "), F.lit(200)).alias("q"))
    return asked.groupBy(F.lower(F.left("q", F.lit(60))).alias("key")).agg(F.min_by("q", F.struct("conv_id", "turn")).alias("q"))
