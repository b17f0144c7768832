"""Writes as set operations: every function returns the next state of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.scalars import EDGE_TYPES, layer_weight, node_id
from mnemospark.operators.index import small
from mnemospark.operators.retrieval import live
from mnemospark.storage import stored as put


def upsert_nodes(memory: DataFrame, incoming: DataFrame, now: int) -> DataFrame:
    """memory with incoming rows put in, and the column outcome.

    A known id is refreshed: seen now, new importance, one more access, live
    again; its text stays.  Others are created.
    """
    new = incoming.dropDuplicates(["id"]).select(F.col("id"), F.struct(*[c for c in memory.columns if c in incoming.columns]).alias("_n"))
    both = memory.withColumn("_known", F.lit(True)).join(new, "id", "full_outer")
    known, given = F.col("_known").isNotNull(), F.col("_n").isNotNull()
    defaults = {"created_at": F.lit(now), "last_seen_at": F.lit(now), "access_count": F.lit(0), "superseded_at": F.lit(None)}
    columns = []
    for c in memory.columns:
        inside = F.col(f"_n.{c}") if c in incoming.columns else defaults.get(c, F.lit(None))
        fresh = F.coalesce(inside, defaults[c]) if c in defaults and c in incoming.columns else inside
        again = {
            "last_seen_at": F.lit(now),
            "importance": F.coalesce(inside, F.col(c)),
            "access_count": F.coalesce(F.col(c), F.lit(0)) + 1 if c == "access_count" else F.col(c),
            "superseded_at": F.lit(None),
        }.get(c, F.col(c))
        kind = memory.schema[c].dataType
        columns.append(F.when(known & given, again).when(known, F.col(c)).otherwise(fresh).cast(kind).alias(c))
    outcome = F.when(known & given, "refreshed").when(given, "created").otherwise("kept")
    return both.select(*columns, outcome.alias("outcome"))


def flush_postings(postings: DataFrame, changed: DataFrame) -> DataFrame:
    """Postings with the rows of the changed nodes replaced; the ids of these are brought to
    the postings, which are not shuffled, unless they are too many."""
    ids = put(changed.select("id").distinct(), "changed")
    return postings.join(small(ids), "id", "left_anti").unionByName(changed)


def set_embeddings(memory: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """memory with vectors of just the right width; another width is an error."""
    width = F.assert_true(F.size("embedding") == dims, f"embedding is not {dims} wide")
    fit = vectors.withColumn("_ok", width).where("_ok is null").drop("_ok")
    return memory.drop("embedding", "model", "provider").join(fit, "id", "left")


def add_edges(edge: DataFrame, new: DataFrame, memory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, rejected): known type and both ends required; (src, type, dst) once."""
    ids = memory.select("id").distinct()
    a = ids.select(F.col("id").alias("src"), F.lit(True).alias("_a"))
    b = ids.select(F.col("id").alias("dst"), F.lit(True).alias("_b"))
    judged = new.join(a, "src", "left").join(b, "dst", "left")
    reason = (
        F.when(~F.col("type").isin(*EDGE_TYPES), "unknown type").when(F.col("_a").isNull(), "missing source").when(F.col("_b").isNull(), "missing target")
    )
    judged = judged.withColumn("reason", reason)
    good = judged.where("reason is null").select(*edge.columns).dropDuplicates(["src", "type", "dst"])
    fresh = good.join(edge.select("src", "type", "dst"), ["src", "type", "dst"], "left_anti").select(*edge.columns)
    return edge.unionByName(fresh), judged.where("reason is not null").select(*new.columns, "reason")


def insert_absent(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """table and those new rows whose keys it lacks (symbols, files, links)."""
    fresh = new.select(*table.columns).dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def linked_ids(edge: DataFrame, about: DataFrame) -> DataFrame:
    return edge.select(F.col("src").alias("id")).union(edge.select("dst")).union(about.select("memory_id")).distinct()


def delete_nodes(memory: DataFrame, postings: DataFrame, ids: DataFrame, edge: DataFrame, about: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memory, postings, refused): nodes with any link are refused, not deleted."""
    linked = linked_ids(edge, about)
    refused = ids.join(linked, "id", "left_semi")
    gone = ids.join(linked, "id", "left_anti")
    return memory.join(gone, "id", "left_anti"), postings.join(gone, "id", "left_anti"), refused


def supersede(memory: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    hit = ids.select("id", F.lit(True).alias("_hit")).distinct()
    at = F.when(F.col("_hit") & F.col("superseded_at").isNull(), F.lit(now)).otherwise(F.col("superseded_at"))
    return memory.join(hit, "id", "left").withColumn("superseded_at", at).select(*memory.columns)


def replace_relations(relations: DataFrame, fresh: DataFrame, files: DataFrame, key: str = "file_path") -> DataFrame:
    """The relations of some files replaced as a whole."""
    return relations.join(files.select(key).distinct(), key, "left_anti").select(*relations.columns).unionByName(fresh.select(*relations.columns))


def delete_symbols(symbol: DataFrame, calls: DataFrame, about: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(symbol, calls, about, pending): calls into a removed symbol from one that
    stays become pending again."""
    ids = gone.select("id").distinct()
    src, dst = ids.withColumnRenamed("id", "src"), ids.withColumnRenamed("id", "dst")
    site = [c for c in calls.columns if c not in ("dst", "confidence")]
    pending = calls.join(dst, "dst", "left_semi").join(src, "src", "left_anti").select(*site, F.lit("external").alias("reason"))
    return (
        symbol.join(ids, "id", "left_anti"),
        calls.join(src, "src", "left_anti").join(dst, "dst", "left_anti").select(*calls.columns),
        about.join(ids.withColumnRenamed("id", "symbol_id"), "symbol_id", "left_anti").select(*about.columns),
        pending,
    )


def prunable(memory: DataFrame, edge: DataFrame, about: DataFrame, before: int, layers: tuple[str, ...] = ("episodic",), most_weight: int | None = None) -> DataFrame:
    """Unlinked nodes of light layers older than a moment, lightest first in order."""
    old = memory.where((F.col("created_at") < before) & F.col("layer").isin(*layers))
    if most_weight is not None:
        old = old.where(layer_weight(F.col("layer")) <= most_weight)
    left = old.join(linked_ids(edge, about), "id", "left_anti")
    return left.select("id", "layer", "created_at", layer_weight(F.col("layer")).alias("weight"))


def stale(stored: DataFrame, produced: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows that are no longer produced (chunks, symbols or files)."""
    return stored.join(produced.select(*keys).distinct(), keys, "left_anti")


def reclaim(memory: DataFrame, edge: DataFrame, about: DataFrame, on_disk: DataFrame, scope: str, now: int) -> DataFrame:
    """Live artifacts of vanished files within a scope: delete if unlinked, else supersede."""
    inside = (F.lit(scope) == "") | (F.col("file_path") == scope) | F.col("file_path").startswith(scope + "/")
    artifacts = live(memory, ("artifact",)).where(inside)
    gone = artifacts.join(on_disk.select("file_path").distinct(), "file_path", "left_anti").select("id", "file_path")
    linked = linked_ids(edge, about).withColumn("linked", F.lit(True))
    action = F.when(F.col("linked"), "supersede").otherwise("delete")
    return gone.join(linked, "id", "left").select("id", "file_path", action.alias("action"))


def journal_nodes(journal: DataFrame) -> DataFrame:
    """Queued nodes of a journal with the ids they get."""
    n = journal.where("kind = 'node'")
    return n.select(node_id(F.col("layer"), F.col("source_ref"), F.col("body")).alias("id"), "layer", "title", "body", "source_ref", "importance").dropDuplicates(["id"])
