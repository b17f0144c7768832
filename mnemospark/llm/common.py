"""Helpers shared by the training-data operators.

Nothing here holds data of unbounded size on the driver: the helpers build
plans, write intermediate tables to the shared checkpoint folder, and turn
texts into words inside executor tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.shipping import ship
from mnemospark.storage import discard as discard
from mnemospark.storage import stored as stored

#: The white space of the word pattern [^\x20\x09-\x0D]+.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the synthetic tables, read by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- words and hashes


def words_of(text: str | None) -> list[bytes]:
    """Words of [^\\x20\\x09-\\x0D]+ as UTF-8; bytes.split() cuts at just these."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def lower_words(text: str | None) -> list[bytes]:
    """The same after lower-casing A-Z (bytes.lower() leaves other letters)."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


class WordHash(dict):
    """word -> 64-bit hash, remembering recent words within a fixed bound."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer for 64-bit values."""
    x = (x ^ (x >> _SHIFT)) * _MIX1
    x = (x ^ (x >> _SHIFT)) * _MIX2
    return x ^ (x >> _SHIFT)


_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-word shingles of a sequence of word hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = hashes[:n].copy()
    for j in range(1, k):
        acc *= _BASE
        acc += hashes[j : j + n]
    return mixed(acc)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


# ---------------------------------------------------------------- Arrow mapping


#: Rows and bytes that Spark hands to a Python worker at once (one longer text is a batch by itself).
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20


def prepare(spark: SparkSession) -> None:
    """What Arrow stages need: this package on the executors, and small batches.  Spark
    reads the bounds when a query runs, so they are lowered for the session."""
    ship(spark)
    rows, size = (f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes"))
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) > BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow: fn takes the batches that hold rows and yields {column: list or array}."""
    from pyspark.sql.types import StructType, _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    prepare(df.sparkSession)
    arrow = to_arrow_schema(kind)

    def column(values, field: pa.Field) -> pa.Array:
        return values.cast(field.type) if isinstance(values, pa.Array) else pa.array(values, field.type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(b for b in batches if b.num_rows):
            yield pa.RecordBatch.from_arrays([column(out[f.name], f) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """The same with batches as {column: list}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        return fn({c: b.column(i).to_pylist() for i, c in enumerate(b.schema.names)} for b in batches)

    return map_arrow(df, run, schema)


def held_out(column: str, parts: int, which: int):
    """crc32(column as text) mod parts equals which (null ids: false)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts == which, F.lit(False))
