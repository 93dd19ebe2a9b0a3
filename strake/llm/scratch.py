"""Tables that cut lineage, in the folder that driver and executors share.

A step whose result several later steps read is written as Parquet under
``spark.checkpoint.dir`` and read again: a lost executor then costs a re-read,
not a recomputation of everything before. The setting is read from the session.
Only where it is unset and Spark runs in one process (tests) is a folder made.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

#: Stored bytes for each partition at most, whatever the session says.
PARTITION_BYTES = 128 * 1024 * 1024
#: Sizes from here on are the planner's word for not knowing.
UNKNOWN = 1 << 60
#: More partitions than this no driver plans, whatever a table's size.
MOST = 1 << 20

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="strake-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    The folder stays until ``clear`` or the end of the process, as results are
    lazy and may be read at any later time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strake-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a table; after the session's end what only Spark reaches is left and named in a warning."""
    if spark.sparkContext._jsc is not None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    elif "://" not in path and not path.startswith("file:/"):
        shutil.rmtree(path, ignore_errors=True)
    elif path.startswith("file:/"):
        shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
    else:
        warnings.warn(f"left behind: {path}", ResourceWarning, stacklevel=2)


def made() -> int:
    """How many tables ``cut`` has written so far: a mark for ``clear``."""
    return len(_made)


def clear(since: int = 0, until: int | None = None) -> None:
    """Delete the tables that ``cut`` wrote in this process, from one mark to another."""
    gone = _made[since:until]
    del _made[since:until]
    for spark, path in gone:
        _delete(spark, path)


def width(df: DataFrame, asked: int | None = None) -> int:
    """How many partitions to deal ``df`` to: as asked, else the session's setting, but at least one for each ``PARTITION_BYTES``.

    The size is that of the files which ``df`` reads, each scan counted once, and
    not the planner's guess of the result, which grows with every join. Nothing
    is read for it. Sources of unknown size count for nothing.
    """
    if asked:
        return asked
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(1, n, min(MOST, -(-sum(s for s in sizes if s < UNKNOWN) // PARTITION_BYTES)))


atexit.register(clear)
