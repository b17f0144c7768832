"""The journal of queued writes: JSON lines, one folder of session files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "kind string, layer string, title string, body string, source_ref string, importance double, "
    "src string, dst string, type string, weight double, _bad string"
)


def read_journal(spark: SparkSession, folder: str) -> DataFrame:
    """All queued rows; lines that are no JSON stay out (see ``malformed``)."""
    return _all(spark, folder).where("_bad is null").drop("_bad")


def malformed(spark: SparkSession, folder: str) -> DataFrame:
    return _all(spark, folder).where("_bad is not null").select(F.col("_bad").alias("line"))


def _all(spark: SparkSession, folder: str) -> DataFrame:
    return parsed(spark.read.text(folder))


def parsed(lines: DataFrame) -> DataFrame:
    """Journal rows of JSON lines; a line that is no JSON is kept in _bad."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    return lines.where("trim(value) <> ''").select(F.from_json("value", SCHEMA, options).alias("r")).select("r.*")


def append_journal(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").json(folder)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A question set: an array of questions, or an object that holds one."""
    one = "struct<id:string,kind:string,ask:string,also:string,expect:array<string>,reject:array<string>>"
    raw = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<{one}>")
    held = F.from_json("value", f"struct<questions:array<{one}>>")["questions"]
    is_list = F.ltrim("value").startswith("[")
    return raw.select(F.inline(F.when(is_list, listed).otherwise(held)))
