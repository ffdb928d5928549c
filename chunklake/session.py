"""Session helpers: settings, the shared folder, and lineage cuts that survive a lost executor."""

from __future__ import annotations

import contextlib
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int = 8, app: str = "chunklake", **extra: str) -> SparkSession:
    """A local session for tests and the bench. On a cluster pass your own session to every function instead."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = SETTINGS | {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (conf | extra).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Only where neither is set and the session runs on one machine (tests), a temporary folder is made and recorded in the session; on a
    cluster this is an error, since executors would write to and read from different disks.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return jdir.get().rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder all executors share: the session runs on {master}")
    made = "file://" + tempfile.mkdtemp(prefix="chunklake-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: computed once, lineage cut, no executor needed later."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fitted(df: DataFrame, most: int = 200_000, beyond: str = "merge") -> DataFrame:
    """df as a join's smaller side: counted, and broadcast up to `most` rows; beyond that both sides are shuffled, and sorted ("merge")
    or df hashed by partition ("shuffle_hash", which leaves wide rows of the other side unsorted).

    The planner weighs a written table by its bytes on disk, which an explode or a good compression leaves far below its size in
    memory. So the rows are counted (from the files' footers, where df is a written table as it is) and the choice is stated. For narrow rows only.
    """
    return F.broadcast(df) if df.count() <= most else df.hint(beyond)


def merged(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the data: never broadcast, whatever the planner takes its size for."""
    return df.hint("merge")


@contextlib.contextmanager
def job(spark: SparkSession, name: str):
    """Runs what is inside as one group of jobs, which cancel() ends and progress() follows, from any thread."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name, interruptOnCancel=True)
    try:
        yield
    finally:
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            sc.setLocalProperty(key, None)


def cancel(spark: SparkSession, name: str) -> None:
    """Cancels the running jobs of a group; what they had written under temporary names is removed by their writers."""
    spark.sparkContext.cancelJobGroup(name)


def progress(spark: SparkSession, name: str) -> tuple[int, int]:
    """(tasks done, tasks) of the stages of a group's jobs that are known so far; of a finished job all count as done, though it skips some."""
    t = spark.sparkContext.statusTracker()
    done = tasks = 0
    for j in t.getJobIdsForGroup(name):
        info = t.getJobInfo(j)
        there = [s for i in (info.stageIds if info else ()) if (s := t.getStageInfo(i))]
        n = sum(s.numTasks for s in there)
        tasks += n
        done += n if there and info.status == "SUCCEEDED" else sum(s.numCompletedTasks for s in there)
    return done, tasks


def drop_stages(spark: SparkSession) -> None:
    """Remove the tables stage() wrote; only for folders of this machine."""
    root = shared_dir(spark)
    if root.startswith("file://"):
        root = root[len("file://") :]
    if os.path.isdir(root):
        for name in os.listdir(root):
            if name.startswith("stage-"):
                full = os.path.join(root, name)
                shutil.rmtree(full, ignore_errors=True) if os.path.isdir(full) else os.remove(full)


def tidy(spark: SparkSession) -> None:
    """Collects the driver's garbage between two pieces of work: shuffle files and broadcasts that nothing uses are removed, and the driver
    gives back memory, of which Python's planning processes need a share."""
    spark.sparkContext._jvm.System.gc()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each context, so that they need neither its folder nor a PYTHONPATH."""
    sc = spark.sparkContext
    if getattr(sc, "_chunklake_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    made = os.path.join(tempfile.mkdtemp(prefix="chunklake-zip-"), "chunklake.zip")
    with zipfile.ZipFile(made, "w") as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("chunklake", os.path.relpath(full, here)))
    sc.addPyFile(made)
    sc._chunklake_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
