"""Session defaults for local work; a cluster brings its own settings."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with adaptive execution and UTC timestamps."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName("quillon")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A local session may lack it and gets a temporary one; a cluster may not."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that lost executors cost no lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df as Parquet in the shared folder, which takes less room than a checkpoint, read again, and its path."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


#: A side of at most so many rows, each an id, a few numbers and a short text, may be broadcast.
BROADCAST_ROWS = 50_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, kept, with a broadcast hint if it has at most so many rows, so that the texts it meets aren't shuffled; else for a shuffled join."""
    kept = durable(df)
    return F.broadcast(kept) if kept.limit(rows + 1).count() <= rows else kept


def removed(spark: SparkSession, path: str) -> None:
    """Deletes what lies at path and is not read any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def created_once(spark: SparkSession, path: str, content: bytes) -> bool:
    """Makes a file with this content and says so, or says no where it exists already; of several at once one is told yes.

    The content is written beside it first and put in place whole: by a link on a local or mounted file system, elsewhere
    by a rename that doesn't overwrite.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    at, beside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}"))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = at.getFileSystem(conf)
    out = files.create(beside, False)
    out.write(bytearray(content))
    out.close()
    try:
        if files.getUri().getScheme() == "file":
            os.link(beside.toUri().getPath(), at.toUri().getPath())
        else:
            kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(beside, at, gateway.new_array(kind, 0))
    except FileExistsError:
        return False
    except Exception as error:
        if "FileAlreadyExists" in str(error):
            return False
        raise
    finally:
        files.delete(beside, False)
    return True
