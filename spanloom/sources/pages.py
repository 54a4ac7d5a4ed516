"""Readers and writers of page files, labelled files and raw texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE_SCHEMA = "ref string, segments array<struct<index:int,english:string,hebrew:string>>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Segments of page documents in JSON lines; a line that isn't one is kept with its text in ``_corrupt``."""
    raw = spark.read.text(path).withColumn("file", F.col("_metadata.file_name"))
    page = F.from_json("value", PAGE_SCHEMA, {"mode": "PERMISSIVE"})
    df = raw.withColumn("p", page)
    return df.select("file", "p.ref", F.explode_outer("p.segments").alias("s"), F.when(F.col("p.ref").isNull(), F.col("value")).alias("_corrupt")).select("file", "ref", F.col("s.index").alias("seg_idx"), "s.english", "s.hebrew", "_corrupt")


def write_pages(docs: DataFrame, path: str) -> None:
    """Page documents as JSON lines, one folder per corpus; Spark's commit protocol makes the write all or nothing."""
    docs.select("corpus", F.col("doc").alias("value")).repartition("corpus").write.mode("overwrite").partitionBy("corpus").text(path)


def unaccounted(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """``(file, state)``: files on disk that no register entry names, and entries (``file``) without a file."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.lit(True).alias("_d"))
    both = files.join(known.select("file").withColumn("_k", F.lit(True)), "file", "full_outer")
    return both.where("_d is null or _k is null").select("file", F.when(F.col("_d").isNull(), "missing").otherwise("unregistered").alias("state"))


def embedded_json(html: Column, script_id: str) -> Column:
    """The JSON text inside a page's script element of that id."""
    return F.nullif(F.regexp_extract(html, rf"(?is)<script[^>]*id=[\"']{script_id}[\"'][^>]*>(.*?)</script>", 1), F.lit(""))


def fill_headers(lines: DataFrame, doc: str, line_no: str, text: str, header: str) -> DataFrame:
    """Lines of running text with the last header line above them; header lines themselves, and lines before the first, go."""
    is_header = F.col(text).rlike(header)
    so_far = Window.partitionBy(doc).orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0)
    df = lines.withColumn("header", F.last(F.when(is_header, F.col(text)), True).over(so_far))
    return df.where(~is_header & F.col("header").isNotNull())


def latest_shapes(files: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows that several files give, the one of the last file."""
    rest = [c for c in files.columns if c != key]
    last = files.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return last.select(key, "_r.*")


def not_yet_fetched(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    return wanted.join(cached.select(key), key, "left_anti")
