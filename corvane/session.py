"""Session defaults for local runs and tests; a cluster brings its own settings."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def local_session(cores: int | str = 8, memory: str = "12g", app: str = "corvane", shared: str | None = None) -> SparkSession:
    """A local[cores] session with AQE on, UTC and one shuffle partition a core; shared is its spark.checkpoint.dir."""
    n = 8 if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the provided Parquet tables; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's setting that drops the shuffle files of a query at its end.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """df worked out once, as a Parquet table in the shared folder, which outlives lost executors.

    For plans that are read more than once and must not come out differently (ranges are sampled), and to cut lineage.
    Readers prune its columns and see its sizes. swept() removes an application's tables.
    """
    path, conf = f"{_own_folder(df.sparkSession)}/{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(CLEANUP_SETTING, "false")
    conf.set(CLEANUP_SETTING, "true")  # the table outlives its shuffles
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP_SETTING, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/corvane-settled-{spark.sparkContext.applicationId}"


def swept(spark: SparkSession) -> None:
    """Deletes this application's settled tables; results that aren't yet written out are lost with them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, set as the context's checkpoint folder. Without one a local master gets a temp folder, a cluster an error."""
    context = spark.sparkContext
    if found := context.getCheckpointDir():
        return found
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='corvane-')}"
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def shipped(spark: SparkSession) -> None:
    """Sends this package's code to the executors, once for each context, so that it need not be installed there."""
    context = spark.sparkContext
    if getattr(context, "_corvane_shipped", False):
        return
    package = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as top:
        shutil.copytree(package, Path(top, "in", package.name), ignore=shutil.ignore_patterns("__pycache__"))
        name = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="corvane-code-"), package.name)), "zip", Path(top, "in"))
    context.addPyFile(name)
    context._corvane_shipped = True


#: Rows of a few plain columns that bounded() broadcasts at most.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, which has at most so many rows of a few plain columns, for a broadcast if these are few enough; else to be shuffled."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
