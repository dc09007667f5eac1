"""The folder that driver and executors share, and tables that cut lineage in it."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Setting with the local paths, parted by commas, at which every machine of the cluster mounts the same file system.
SHARED_MOUNTS = "spark.textloom.sharedMounts"
#: Folders of one machine by custom.
TEMPORARY = ("/tmp", "/var/tmp", "/dev/shm")


def _below(path: str, folders) -> bool:
    return any(path == f or path.startswith(f.rstrip("/") + "/") for f in folders)


#: Local paths of clusters by application, and whether driver and executors see each other's files there.
_SEEN: dict[tuple[str, str], bool] = {}
#: Temporary folders by application, of sessions on one machine that name none.
_MADE: dict[str, str] = {}


def _is_seen_by_all(spark, where: str) -> bool:
    """Whether a table that all executors write to ``where``, four tasks for each core, is whole for the driver and for those who read it."""
    told = (spark.sparkContext.applicationId, where)
    if told not in _SEEN:
        try:
            n, path = 4 * spark.sparkContext.defaultParallelism, f"{where.rstrip('/')}/textloom-{told[0]}/seen-{uuid.uuid4().hex}"
            spark.range(0, n, 1, n).write.parquet(path)
            _SEEN[told] = spark.read.schema("id long").parquet(path).agg(F.countDistinct("id")).first()[0] == n
        except Exception:  # a file or folder that some machine misses
            return False
    return _SEEN[told]


def shared_folder(spark) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where the session runs on one machine.

    On a cluster the setting has to name a store that all machines reach. A local path counts as one if it lies under a mount that
    ``spark.textloom.sharedMounts`` names and isn't a temporary folder, or if a table that the executors write there, once for an
    application, is found whole; else it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not spark.sparkContext.master.startswith("local"):
        if not where:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        parsed = urlparse(where)
        mounts = [urlparse(m.strip()).path for m in (spark.conf.get(SHARED_MOUNTS, None) or "").split(",") if m.strip()]
        if parsed.scheme in ("", "file") and (_below(parsed.path, (*TEMPORARY, tempfile.gettempdir())) or not _below(parsed.path, mounts)) and not _is_seen_by_all(spark, where):
            raise ValueError(f"{where} is a folder of one machine; name its mount in {SHARED_MOUNTS} if all machines share it")
    if not where:
        told = spark.sparkContext.applicationId
        if told not in _MADE:  # a running session takes no such setting
            _MADE[told] = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="textloom-"))
        where = _MADE[told]
    return f"{where.rstrip('/')}/textloom-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    The tables stay in one folder per application, for whoever runs the job to delete.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SALTS = 16


def join_salted(rows: DataFrame, few: DataFrame, keys: list[str], spread: str, how: str = "inner", salt: str = "_salt", salts: int = SALTS) -> DataFrame:
    """``rows`` joined with the smaller ``few``, whose rows repeat for each of ``salts``; ``spread`` is a hash that deals the rows of a key.

    A key that a third of the rows have goes to as many tasks. Where Spark finds ``few`` small, it broadcasts it. ``spread`` goes, and
    the salt too unless a semi join keeps it.
    """
    salted = rows.withColumn(salt, F.pmod(F.col(spread), F.lit(salts)).cast("int")).drop(spread)
    repeated = few.withColumn(salt, F.explode(F.array(*map(F.lit, range(salts)))))
    out = salted.join(repeated, [*keys, salt], how)
    return out if how == "left_semi" else out.drop(salt)


def not_first(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: whether another row of the same group comes before it by ``order``, nulls first. Null groups are a group.

    The first of each group of several comes from an aggregation and meets the rows in a salted join, so that a group of any size is no task.
    Rows that tie with the first are first too.
    """
    tags = [f"_nf_g{k}" for k in range(len(group))]
    keyed = rows.withColumns({t: F.struct(F.col(g).alias("x")) for t, g in zip(tags, group)}).withColumn("_nf_order", F.struct(*order))
    firsts = keyed.groupBy(*tags).agg(F.min("_nf_order").alias("_nf_first"), F.count("*").alias("_nf_n")).where("_nf_n > 1").drop("_nf_n")
    joined = join_salted(keyed.withColumn("_nf_spread", F.xxhash64(*order)), firsts, tags, "_nf_spread", "left", salt="_nf_salt")
    return joined.withColumn(name, F.coalesce(F.col("_nf_order") > F.col("_nf_first"), F.lit(False))).drop(*tags, "_nf_order", "_nf_first")


def dealt(table: DataFrame) -> DataFrame:
    """``table``, dealt anew where its files give fewer tasks than the cluster has cores; a table of many files stays as it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    tasks = table._jdf.queryExecution().toRdd().getNumPartitions()
    return table.repartition(cores) if tasks < cores else table


def dealt_finer(table: DataFrame, tasks: int) -> DataFrame:
    """``table``, its rows dealt by their place where it has fewer tasks than ``tasks``: the rows of a task aren't sorted for it, and copies part."""
    if table._jdf.queryExecution().toRdd().getNumPartitions() >= tasks:
        return table
    return table.withColumn("_dealt_row", F.monotonically_increasing_id()).repartition(tasks, "_dealt_row").drop("_dealt_row")


#: Rows and bytes of a batch between the JVM and Python; the session's defaults hold far more texts at once than a task needs.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session's batch settings are made smaller where they stand at their defaults; a setting of the user stays."""
    conf = df.sparkSession.conf
    for key, (default, ours) in BATCH.items():
        if conf.get(key, default) == default:
            conf.set(key, ours)
    return df
