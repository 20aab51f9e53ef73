"""What the corpus operators share: reading tables, cutting lineage, removing what was written for it, and checked broadcasts.

Arrow batches that carry texts are bounded by Spark itself (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless set).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many rows is broadcast; its rows here are a few numbers wide.
BROADCAST_ROWS = 200_000
#: ASCII white space as the contracts define words.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only on a local master."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="harborlight-")
        context.setCheckpointDir(named)
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


#: Where written() puts its tables, below the shared folder: the innermost scratch() of the thread's context, else a folder of the session.
_scratch: ContextVar[tuple[str, ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that written() makes inside are deleted at the end: for a job whose result is saved by then."""
    name = f"scratch-{uuid.uuid4().hex}"
    held = _scratch.set((*_scratch.get(), name))
    try:
        yield
    finally:
        _scratch.reset(held)
        removed(spark, f"{shared_folder(spark)}/{name}")


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever file system it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, outside: bool = False, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, lineage cut, safe when an executor is lost.

    A query's tables stay as long as its lazy result may need them; scratch() deletes them, but not those that are written
    `outside` of the innermost one.
    """
    spark = df.sparkSession
    open_ = [spark.sparkContext.applicationId, *_scratch.get()]
    path = f"{shared_folder(spark)}/{open_[-2 if outside and len(open_) > 1 else -1]}/written-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_small(big: DataFrame, small: DataFrame, on: Sequence[str], how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a written table: broadcast if a count proves it small, else a shuffle join that Spark may split."""
    return big.join(F.broadcast(small) if small.count() <= rows else small, list(on), how)


def carried(docs: DataFrame, columns: Sequence[str] | None) -> Column:
    """The columns to hand through, in one struct, so that no name of the input meets one of ours."""
    return F.struct(*(docs[c] for c in (columns or docs.columns))).alias("_row")


def unpacked(df: DataFrame, columns: Sequence[str], **more: Column) -> DataFrame:
    """The carried columns and ours; ours replace those of the same name."""
    ours = {c.lower() for c in more}
    return df.select(
        *(F.col("_row")[c].alias(c) for c in columns if c.lower() not in ours), *(v.alias(k) for k, v in more.items())
    )
