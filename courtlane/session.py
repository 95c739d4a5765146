"""Session helpers: table access, staging of intermediate tables, size-checked joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which the small side of a join is broadcast; the check runs on the data, beyond it the join is salted.
BROADCAST_ROWS = 100_000
#: Copies of a small side in a salted join.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a local one is set, but only for a session on one machine: on a cluster
    it would lose the data of other machines, so that is an error."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    import tempfile

    got = f"file://{tempfile.gettempdir()}/courtlane-checkpoints"
    spark.sparkContext.setCheckpointDir(got)
    return got


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, under one folder per application, which goes when the application ends or by `discard`."""
    base = f"{shared_dir(spark).rstrip('/')}/courtlane-{spark.sparkContext.applicationId}"
    fs, path = _hadoop(spark, base)
    fs.deleteOnExit(path)
    return f"{base}/{label}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def discard(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application. Results that still read them must be taken or written first."""
    fs, path = _hadoop(spark, f"{shared_dir(spark).rstrip('/')}/courtlane-{spark.sparkContext.applicationId}")
    fs.delete(path, True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: it cuts the lineage, survives lost executors, and is read
    by column, so that several consumers don't compute it again."""
    spark = df.sparkSession
    path = work_path(spark, f"staged-{label}")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of input up to which a plan that only filters, projects and aggregates one table is small without a count.
SMALL_INPUT = 1 << 20
_SHRINKING = {"Project", "Filter", "Aggregate", "LogicalRelation", "Relation", "LocalRelation", "Distinct", "Deduplicate"}


def _surely_small(df: DataFrame) -> bool:
    """Whether ``df`` does nothing but filter, project and aggregate one small table, by the statistics of its files; starts no job."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while True:
        if plan.nodeName().split(" ")[0] not in _SHRINKING:
            return False
        children = plan.children()
        if children.size() == 0:
            return int(str(plan.stats().sizeInBytes())) <= SMALL_INPUT
        plan = children.apply(0)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no further than that."""
    return df.limit(rows + 1).count() <= rows


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a table that has hot keys with one that is usually small and has one row per key.

    The small side is broadcast only after its size is known: from the files' statistics, else by a count (of at most ``rows`` rows) over the side, written
    once so that the join doesn't compute it again. Beyond that it is copied ``SALTS`` times and the big side is salted, so that a key with a third of the
    rows is spread over ``SALTS`` tasks. ``how``: left or inner.
    """
    if rows == BROADCAST_ROWS and _surely_small(small):
        return big.join(F.broadcast(small), keys, how)
    if small._jdf.queryExecution().optimizedPlan().children().size():
        small = staged(small, "small")
    if fits_broadcast(small, rows):
        return big.join(F.broadcast(small), keys, how)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(SALTS)).cast("int")
    return big.withColumn("__salt", spread).join(salted, [*keys, "__salt"], how).drop("__salt")


def match_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per match: fps, width and height of ``match_info`` (its repeated rows agree; the largest is taken)."""
    t = table(spark, sf_dir, "match_info")
    return t.where("match_id is not null").groupBy("match_id").agg(F.max("fps").alias("fps"), F.max("width").alias("width"), F.max("height").alias("height"))


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package: nothing to do where PYTHONPATH already has it, else it goes out by addPyFile."""
    import os
    import shutil
    import tempfile
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_courtlane_shipped", False):
        return
    made = shutil.make_archive(str(Path(tempfile.mkdtemp()) / "courtlane"), "zip", root, "courtlane")
    sc.addPyFile(made)
    sc._courtlane_shipped = True
