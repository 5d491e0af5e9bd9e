"""Opening the input tables and cutting lineage."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the dataset at ``sf_dir`` (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may run without it; it then gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="residuum-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Bytes of a row group of intermediates; a task holds one while it writes.
ROW_GROUP = 32 << 20


def materialize(df: DataFrame, tag: str, lent: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later plans start from the files, so a lost executor costs one task and
    not the stages before it, and a frame used twice is computed once. ``lent``
    files serve a frame that is handed out; ``reclaim`` deletes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/residuum/{tag}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._residuum_path = path
    if lent:
        spark.sparkContext.__dict__.setdefault("_residuum_lent", []).append(path)
    return found


def reclaim(spark: SparkSession, *used: DataFrame) -> None:
    """Delete lent files that none of the frames still in use reads."""
    lent = spark.sparkContext.__dict__.get("_residuum_lent", [])
    if not lent:
        return
    read = [f for df in used for f in df.inputFiles()]
    for path in list(lent):
        if not any(path.rpartition("/")[2] in f for f in read):
            _delete(spark, path)
            lent.remove(path)
    release(spark)


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that ``materialize`` made and no later plan reads."""
    for df in frames:
        _delete(df.sparkSession, df._residuum_path)
    release(frames[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished plans now.

    Spark deletes them once the driver's garbage collector finds that no plan
    holds them, which may otherwise be long after the next large shuffle.
    """
    gc.collect()
    spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def forget(spark: SparkSession) -> None:
    """Delete everything that ``materialize`` has left in the shared folder."""
    _delete(spark, f"{shared_dir(spark)}/residuum")


#: Bytes of rows that go to a Python worker at once. Rows of whole texts or pages fill the default of
#: 64 MB, which is held twice over on either side of every task.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once per context, and keep their batches small.

    Python stages refer to its functions by name, wherever the workers run. A
    batch size that is smaller already stays.
    """
    context = spark.sparkContext
    key, most = BATCH
    if int(spark.conf.get(key, str(most + 1)).rstrip("b")) > most:
        spark.conf.set(key, str(most))
    if getattr(context, "_residuum_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="residuum-"), f"residuum-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)
    context._residuum_shipped = True
