"""Helpers shared by the training-data operators: shared-folder tables, whole-column batches, word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Entries that a per-worker word cache may hold before it starts anew; bounds a worker's memory on any vocabulary.
CACHE_ENTRIES = 400_000
#: 64-bit constants of a public finaliser (splitmix64) and odd multipliers.
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only where the session names none and runs on one machine a local one is set."""
    place = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        place = f"file://{tempfile.mkdtemp(prefix='kontolith-shared-')}"
        spark.conf.set(CHECKPOINT_KEY, place)
    return place.rstrip("/")


def new_place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kontolith/{name}-{uuid.uuid4().hex}"


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def cut(df: DataFrame, name: str = "cut", arrow_rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends there and survives lost executors.

    ``arrow_rows`` bounds the rows of an Arrow batch while it runs, for rows that are large.
    """
    spark = df.sparkSession
    place, was = new_place(spark, name), spark.conf.get(ARROW_ROWS)
    if arrow_rows:
        spark.conf.set(ARROW_ROWS, str(arrow_rows))
    try:
        df.write.parquet(place)
    finally:
        spark.conf.set(ARROW_ROWS, was)
    out = spark.read.schema(df.schema).parquet(place)
    out._kontolith_place = place
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete a table written by :func:`cut` once nothing reads it any more."""
    spark, place = df.sparkSession, df._kontolith_place
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None]], schema: str) -> DataFrame:
    """``mapInArrow`` with per-task state: ``make()`` runs once a task and returns what maps one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            out = step(batch)
            if out is None:
                continue
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list:
    """A string column as Python bytes (None stays None) without decoding it."""
    return column.cast(pa.binary()).to_pylist()


def as_texts(column: pa.Array) -> list:
    """A string column as Python strings (None stays None). Spark's strings hold any bytes; those that are not UTF-8 become U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [t if t is None else t.decode("utf-8", "replace") for t in as_bytes(column)]


def each_text(column: pa.Array) -> Iterator[str | None]:
    """The texts of :func:`as_texts` one after the other, so that no more than one is held as a Python string."""
    for t in column.cast(pa.binary()):
        t = t.as_py()
        yield t if t is None else t.decode("utf-8", "replace")


def struct_field(column: pa.StructArray, name: str) -> pa.Array:
    """A field of a struct column as strings, by position, so that other fields may have any names."""
    return column.field([f.name for f in column.type].index(name)).cast(pa.string())


class BoundedCache(dict):
    """A dictionary that computes missing entries and holds about ``limit`` of them, in two generations.

    When the younger one is full, it becomes the older one and what is used again moves back; so frequent entries stay.
    """

    def __init__(self, compute: Callable, limit: int = CACHE_ENTRIES):
        super().__init__()
        self.compute, self.half, self.older = compute, max(1, limit // 2), {}

    def __missing__(self, key):
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        value = self.older[key] if key in self.older else self.compute(key)
        self[key] = value
        return value


def mix64(x):
    """Splitmix64's finaliser over a numpy uint64 array."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX_1)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def most_frequent(counted: DataFrame, key: str, n: str, most: int) -> Column:
    """A condition for the rows with the largest counts ``n`` (at least 1), about ``most`` at most: whole frequency
    classes from the top, and of the class that would exceed ``most`` those with the smallest hashes of ``key``.

    Only a row per class (a sixteenth of a doubling) is gathered, however many partitions the table has.
    """
    level = F.floor(F.log2(F.col(n).cast("double")) * 16).cast("int")
    sizes = sorted(((r.level, r.k) for r in counted.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect()), reverse=True)
    held = 0
    for at, k in sizes:
        if held + k > most:
            share = int((most - held) / k * (1 << 30))
            return (level > at) | ((level == at) & (F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share))
        held += k
    return F.lit(True)


#: A key is hot with more than a ten-thousandth of all rows, so at most so many keys are; and with more than so few.
HOT_KEYS, HOT_LEAST = 10_000, 100


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, add: list[str]) -> DataFrame:
    """``left`` with the columns ``add`` of ``right``, inner. ``right``: a table with one row per key; ``weight``: the key's rows of ``left``.

    Rows of hot keys get ``add`` from a broadcast, at most ``HOT_KEYS`` rows by the definition of hot; all others by a
    shuffle, in which the former are spread by their content and match nothing. So no key's rows meet in one task.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    packed = right.select(*keys, weight, F.struct(*add).alias("_add"))
    hot = packed.where(F.col(weight) > max(HOT_LEAST, total // HOT_KEYS)).select(*keys, F.col("_add").alias("_hot"))
    marked = left.join(F.broadcast(hot), keys, "left")
    spread = F.when(F.col("_hot").isNull(), F.col(keys[0])).otherwise(F.xxhash64(*(F.col(c) for c in left.columns)))
    cold = packed.where(F.col(weight) <= max(HOT_LEAST, total // HOT_KEYS)).select(F.col(keys[0]).alias("_k0"), *(F.col(k).alias(f"_{k}") for k in keys[1:]), F.col("_add").alias("_cold"))
    same = F.col("_spread") == F.col("_k0")
    for k in keys[1:]:
        same = same & (F.col(k) == F.col(f"_{k}"))
    joined = marked.withColumn("_spread", spread).join(cold, same, "left").withColumn("_got", F.coalesce("_hot", "_cold")).where("_got is not null")
    return joined.select(*left.columns, *(F.col(f"_got.{c}").alias(c) for c in add))


#: Words of 64 bits of the filter that is sent to all tasks: its size is bounded whatever the number of keys.
FILTER_WORDS = 1 << 20


def _place(keys: list[str]) -> tuple[Column, Column]:
    h = "xxhash64({}, {})".format(", ".join(f"`{k}`" for k in keys), "{}")
    bits = [f"shiftleft(1L, cast(pmod({h.format(i)}, 64) as int))" for i in (2, 3)]
    return F.expr(f"pmod({h.format(1)}, {FILTER_WORDS})"), F.expr(f"({bits[0]} | {bits[1]})")


def split_by_keys(rows: DataFrame, keyed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose key may be in ``keyed``, and those whose key surely is not, by a filter of bounded size.

    Only the former need a shuffle to meet ``keyed``. With more keys than the filter tells apart the first part grows
    towards all rows; no row is ever in the wrong one. Null keys are in the first part.
    """
    word, bits = _place(keys)
    held = F.broadcast(keyed.groupBy(word.alias("_word")).agg(F.bit_or(bits).alias("_held")))  # FILTER_WORDS rows at most
    marked = rows.withColumn("_word", word).withColumn("_bits", bits).join(held, "_word", "left")
    sure = F.col("_held").isNull() | (F.col("_held").bitwiseAND(F.col("_bits")) != F.col("_bits"))
    return marked.where(~sure).select(*rows.columns), marked.where(sure).select(*rows.columns)


def fold_id(held: str = "doc_id"):
    """crc32 of the id's decimal text, modulo 3, as a Spark expression; 1 marks the held-out fold."""
    return F.crc32(F.col(held).cast("string").cast("binary")) % 3
