"""Session, table and working-folder helpers shared by every operator."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = 8, app: str = "acequia", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where the session names none and runs on one machine (tests) a temporary folder
    is made and registered; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        named = sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="acequia-")
        sc.setCheckpointDir(named)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/acequia/{label}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p.getParent())
    fs.deleteOnExit(p)
    return path


def state_path(spark: SparkSession, label: str, *tables: DataFrame) -> str:
    """The path under the shared folder where what was learned of ``tables`` stays.

    It is named after their files (path, size, time of change): the same tables find their
    state again, changed ones begin anew.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folders: dict[str, set[str]] = {}
    for name in {f for t in tables for f in t.inputFiles()}:  # addresses, so percent signs are resolved
        folder, _, own = name.rpartition("/")
        folders.setdefault(folder, set()).add(unquote(own))
    said = []
    for folder, own in sorted(folders.items()):  # one listing a folder, not one call a file
        p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        for status in p.getFileSystem(conf).listStatus(p):
            if status.getPath().getName() in own:
                said.append(f"{folder}/{status.getPath().getName()}|{status.getLen()}|{status.getModificationTime()}")
    said.sort()
    mark = hashlib.sha256("\n".join(said).encode()).hexdigest()[:24]
    return f"{shared_dir(spark).rstrip('/')}/acequia/{label}-{mark}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a result that is used more than once to the shared folder and read it back.

    Cuts the lineage; the copy survives the loss of executors.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, for deciding on a broadcast."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = 8 << 20) -> DataFrame:
    """Hint a broadcast only where the estimated size is within ``limit`` bytes.

    Anything larger keeps the shuffle join.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if plan_bytes(df) <= limit else df
