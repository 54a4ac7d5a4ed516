"""Cutting lineage, and joins that hold up when one key owns a large part of the rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A key counts as heavy from this share of all rows on, so that there are at most 1 / share heavy keys: the bound of what is broadcast.
HEAVY_SHARE = 1 / 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's ``spark.checkpoint.dir``. Where none is set, a local session (tests, one machine) gets a folder of its own;
    on a cluster that is an error, as its machines don't share one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spanloom-"))


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed columnar table to the checkpoint folder and continue from the files, so a lost executor costs no
    lineage, later readers take only the columns they need, and the planner knows the true size: that of a checkpoint is
    estimated from its inputs', which over the rounds of a loop of joins grows without bound. It lies there until the folder is cleared.
    """
    path = scratch(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from there: for narrow rows, outside loops of joins (see ``store``)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``store``, with the number of rows, which is counted as they are written."""
    seen = Observation()
    stored = store(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return stored, seen.get["n"]


def heavy_keys(df: DataFrame, key: str, total: int, share: float = HEAVY_SHARE, least: int = 10_000) -> DataFrame:
    """The keys of ``df`` with at least ``max(least, share * total)`` rows: never more than ``1 / share`` of them."""
    return df.groupBy(key).count().where(F.col("count") >= max(least, int(total * share))).select(key)


def find_heavy(left: DataFrame, key: str, total: int) -> DataFrame | None:
    """The heavy keys of ``left``, materialized, or None if there are none; for lookups that are repeated on one table."""
    if total < 2 * 10_000:
        return None
    heavy = materialize(heavy_keys(left.where(F.col(key).isNotNull()), key, total))
    return None if heavy.isEmpty() else heavy


def lookup(left: DataFrame, right: DataFrame, key: str, heavy: DataFrame | None, how: str = "left") -> DataFrame:
    """``left`` joined to ``right`` (unique on ``key``), safe against keys that own a large part of ``left``.

    Rows of the ``heavy`` keys (see ``find_heavy``) meet their at most ``1 / HEAVY_SHARE`` partners by broadcast and are never
    shuffled; all others go through an ordinary shuffle join. ``left`` should be materialized: it is read twice when there are
    heavy keys. Null keys have no partner and are kept when ``how`` is ``left``.
    """
    if heavy is None:
        return left.join(right, key, how)
    hot = F.broadcast(heavy)
    partners = F.broadcast(right.join(hot, key, "left_semi"))
    cold = left.join(hot, key, "left_anti").join(right, key, how)
    return cold.unionByName(left.join(hot, key, "left_semi").join(partners, key, how))
