"""Session helpers: local sessions for tests/bench and lineage cutting."""
from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session configured the way tests and the bench expect."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spendwise")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only when it is unset (tests,
    local runs) fall back to a fresh scratch folder."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not conf_dir:
        conf_dir = tempfile.mkdtemp(prefix="spendwise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


#: a side of a join is broadcast only up to this many bytes
BROADCAST_BYTES = 32 << 20


def size_checked(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows of at most ``row_bytes`` fit
    ``BROADCAST_BYTES``; unchanged (a shuffled join) beyond that.  Call it on staged
    tables, whose count comes from the file footers."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor
    loss, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SCOPES: dict[str, list[str]] = {}
_OPEN: list[str] = []


@contextmanager
def scratch_scope(name: str):
    """Notes the scratch tables written within, for :func:`release`."""
    _SCOPES.setdefault(name, [])
    _OPEN.append(name)
    try:
        yield
    finally:
        _OPEN.remove(name)


def read_folders(df: DataFrame) -> list[str]:
    """Root paths of the file tables that ``df`` reads."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            out += [roots.apply(k).toString() for k in range(roots.size())]
    return out


def release(spark: SparkSession, name: str, in_use: DataFrame) -> bool:
    """Deletes the scratch tables of a scope, unless ``in_use`` still reads one of them;
    tells whether they are gone."""
    folders = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path) for path in _SCOPES.get(name, ())]
    read = {f.rsplit("/", 1)[-1] for f in read_folders(in_use)}
    if any(f.getName() in read for f in folders):
        return False
    for folder in folders:
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _SCOPES.pop(name, None)
    return True


def scratch_table(spark: SparkSession, df: DataFrame, name: str, partition_by: str | None = None,
                  compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: a stage boundary that also survives executor loss.  ``compression`` is
    Parquet's codec (the session's unless given)."""
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, f"{name}-{uuid.uuid4().hex}")
    for scope in _OPEN:
        _SCOPES[scope].append(path)
    df.write.mode("overwrite").parquet(path, partitionBy=partition_by, compression=compression)
    if partition_by:  # a table without rows has no partition to tell its type from
        return spark.read.schema(df.schema).parquet(path)
    return spark.read.parquet(path)
