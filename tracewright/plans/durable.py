"""Cutting lineage with tables in the shared checkpoint folder.

A long iterative plan is cut by writing its rows as parquet under the folder
named by ``spark.checkpoint.dir``.  Parquet is columnar and compressed, so a
cut costs a fraction of an RDD checkpoint, and every executor can read it
again after another one is lost.

A cut lives as long as a result may read it: :func:`discard` deletes one, :func:`release` all of a session
once its results were used, and what is left goes when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_written: dict[str, object] = {}  # path -> its Hadoop file system


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tracewright-"))
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, suffix: str = "") -> str:
    """A place in the shared folder for one cut or another table; it is deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}{suffix}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(p)  # by the JVM, also after the session was stopped
    _written[path] = fs
    return path


def _remove(path: str) -> None:
    fs = _written.pop(path, None)
    if fs is not None:
        from pyspark import SparkContext

        fs.delete(SparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it (lineage ends there)."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def observed(seen: Observation) -> dict:
    """What was observed; nothing where the plan was found to be empty before it ran."""
    try:
        return seen.get
    except Py4JJavaError:
        return {}


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """:func:`cut`, with the number of rows counted while they are written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, observed(seen).get("n", 0)


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`cut`, once nothing reads it any more."""
    _remove(getattr(df, "_cut_path", ""))


def release() -> None:
    """Delete all cuts.  Results made before must have been used or written."""
    for path in list(_written):
        _remove(path)


#: A side is broadcast only when its rows, at their width, stay below this many bytes.
BROADCAST_BYTES = 32 << 20
_WIDTHS = {T.BooleanType: 1, T.IntegerType: 4, T.FloatType: 4, T.LongType: 8, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8}


def row_bytes(schema: T.StructType) -> int:
    """Bytes of a row in a broadcast table: fixed types as they are, texts at a guess, and the table's own share."""
    return 32 + sum(8 + _WIDTHS.get(type(f.dataType), 48) for f in schema.fields)


def fits(df: DataFrame, rows: int, width: int | None = None) -> bool:
    """Whether ``rows`` of ``df`` may be broadcast; ``width`` gives the bytes of a row where types do not tell (arrays, long texts)."""
    return rows * (width or row_bytes(df.schema)) <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame, rows: int, width: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast when its bytes, by rows counted by the caller, are within the bound; else the join shuffles."""
    return F.broadcast(df) if fits(df, rows, width) else df


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
