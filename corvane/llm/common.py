"""What the operators share: the shared folder, written tables, Arrow batches and word rules."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

#: A word is a run of anything but the six ASCII white-space bytes; bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a few plain columns that small() broadcasts at most: some 50 MB in each executor.
BROADCAST_ROWS = 500_000
#: Rows of an Arrow batch at most, and Spark's setting of it.
BATCH_ROWS, BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Spark's setting that drops the shuffle files of a query at its end.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of two numbers in a file of a written table whose size is known.
FILE_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where the context checkpoints to.

    Without either, a local master gets a temp folder; a cluster gets an error, as each executor would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='corvane-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/corvane-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and outlives lost executors. sweep() removes it.

    rows: how many narrow rows it has at most, where that is known; it then has a file for each FILE_ROWS of them.
    """
    path = f"{_own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP_SETTING, "false")
    # The table outlives its shuffles, so their files can go as soon as it is there.
    conf.set(CLEANUP_SETTING, "true")
    try:
        (df if rows is None else df.coalesce(1 + rows // FILE_ROWS)).write.parquet(path)
    finally:
        conf.set(CLEANUP_SETTING, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, a written table of a few plain columns, marked for a broadcast if it has at most so many rows; else as it is, to be shuffled."""
    return F.broadcast(df) if df.count() <= most else df


def frequent(rows: DataFrame) -> DataFrame:
    """(h, n) of the longs h of rows (h, n) whose n, counts of batches, add up to more than 1; summed in arrays by partition of h."""
    schema = StructType([StructField("h", LongType()), StructField("n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            found, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[n > 1]), pa.array(n[n > 1])], names=["h", "n"])

    shipped(rows.sparkSession)
    return rows.repartition("h").mapInArrow(run, schema)


def sweep(spark: SparkSession) -> None:
    """Deletes this application's written tables; results that aren't yet written out are lost with them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shipped(spark: SparkSession) -> None:
    """Readies a session for the operators' Python workers.

    Sends this package's code to the executors, once for each context, so that it need not be installed there. Arrow
    batches hold whole texts, so they get fewer rows than Spark's default of 10,000; a lower setting stays.
    """
    if int(spark.conf.get(BATCH_SETTING)) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, "_corvane_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    with tempfile.TemporaryDirectory() as top:
        shutil.copytree(package, Path(top, "in", package.name), ignore=shutil.ignore_patterns("__pycache__"))
        name = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="corvane-code-"), package.name)), "zip", Path(top, "in"))
    context.addPyFile(name)
    context._corvane_shipped = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Columns of documents; stages hold all others aside.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def aside(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs), with docs' columns in their order; those beyond DOCUMENT go under other names meanwhile, so none can clash."""
    names = docs.columns
    away = {c: f"__aside_{i}" for i, c in enumerate(names) if c not in DOCUMENT}
    out = work(docs.withColumnsRenamed(away))
    return out.select(*(F.col(away.get(c, c)).alias(c) for c in names))


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null; JVM side."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def map_batches(df: DataFrame, fn: Callable[..., list], schema: StructType, cut: int = 0) -> DataFrame:
    """fn(*columns as lists) -> a list of columns, one Arrow batch after another; cut > 0 slices batches to so many rows."""
    arrow = to_arrow_schema(schema)
    shipped(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = cut or max(1, whole.num_rows)
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                out = fn(*(c.to_pylist() for c in batch.columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)
