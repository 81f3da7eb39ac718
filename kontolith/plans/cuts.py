"""Where long plans are cut: a table in the shared folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "spark.checkpoint.dir"
BY_ESTIMATE, BY_MEASURE = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def shared_dir(spark) -> str:
    """The session's shared folder; a local one is set only where it names none and everything runs on one machine."""
    place = spark.conf.get(KEY, None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{KEY} must name a folder that all executors share")
        place = f"file://{tempfile.mkdtemp(prefix='kontolith-')}"
        spark.conf.set(KEY, place)
    return place.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: computed once for all its readers, and safe from lost executors.

    Only what a shuffle has measured as small is broadcast: before, Spark goes by the size of files, and a table of like
    texts is many times larger in memory, so all documents would go through the driver.
    """
    conf = df.sparkSession.conf
    place = f"{shared_dir(df.sparkSession)}/kontolith-ledger/{name}-{uuid.uuid4().hex}"
    estimate, measure = conf.get(BY_ESTIMATE), conf.get(BY_MEASURE, None)
    conf.set(BY_MEASURE, measure or estimate)
    conf.set(BY_ESTIMATE, "-1")
    try:
        df.write.parquet(place)
    finally:
        conf.set(BY_ESTIMATE, estimate)
        conf.set(BY_MEASURE, measure) if measure else conf.unset(BY_MEASURE)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def row_in_partition() -> Column:
    """The row's number within its partition."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """``rows`` as a table with ``name``: consecutive numbers from 1 in the order of ``by``.

    The order is made by a range sort and only a row per range is counted up, so nothing meets in one task; rows that
    differ in ``by`` are numbered alike however they are dealt.
    """
    placed = cut(rows.orderBy(*by).withColumn("_part", F.spark_partition_id()).withColumn("_row", row_in_partition()), "ordered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before")
