"""What happens to a run's source files: a text dump of what was parsed, and their move to an archive folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_text_dump(docs: DataFrame, path: str) -> None:
    """``quelle_pdf, ocr_text`` as one folder of text rows per document, for later runs and comparisons."""
    named = docs.select(F.regexp_replace("quelle_pdf", r"\.[A-Za-z0-9]+$", "").alias("quelle"), F.col("ocr_text").alias("value"))
    named.write.mode("overwrite").partitionBy("quelle").option("lineSep", "\x00").text(path)


def read_text_dump(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\x00").option("recursiveFileLookup", True).text(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/quelle=([^/]*)/", 1)
    return rows.select(F.url_decode(name).alias("quelle_pdf"), F.col("value").alias("ocr_text"))


def archive_files(spark: SparkSession, paths: list[str], folder: str) -> list[str]:
    """Move files to ``folder``; a name that is taken gets a number (``_2``, ``_3`` ...). Returns their new places."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    root = hadoop.Path(folder)
    store = root.getFileSystem(conf)
    store.mkdirs(root)
    out = []
    for source in map(hadoop.Path, sorted(paths)):
        stem, dot, end = source.getName().rpartition(".")
        stem, end = (stem, dot + end) if stem else (end, "")
        n, target = 1, hadoop.Path(root, source.getName())
        while store.exists(target):
            n += 1
            target = hadoop.Path(root, f"{stem}_{n}{end}")
        if not store.rename(source, target):
            raise OSError(f"{source} could not be moved to {target}")
        out.append(target.toString())
    return out
