"""Session helpers: reliable materialisation and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "gridpanel", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; fall back to a temp folder only when local."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        shared = tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(shared)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and cut its lineage.

    Used where later steps must see exactly the same rows and partition ids even
    if an executor is lost, and where an iterative plan would otherwise grow.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only after counting; larger inputs are left to a shuffle join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def shuffled(df: DataFrame) -> DataFrame:
    """Hint a shuffle join for a side that grows with the tables.

    Spark broadcasts by the size of files or shuffled blocks, and millions of well compressed keys stay below its limit;
    the driver would then hold them all.
    """
    return df.hint("merge")


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Spread rows over all tasks before CPU-heavy work, round-robin or by key.

    Round-robin splits copies of one row as well; Spark sorts the rows first, so a
    retried task deals them out the same way.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *[F.col(c) for c in cols])


PACKAGE = "gridpanel"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    The driver's import path does not reach Python workers, so functions that are pickled
    by name would not be found there. The archive is served by the driver; nothing is read
    from an executor's disk.
    """
    context = spark.sparkContext
    if any(Path(name).name.startswith(f"{PACKAGE}-") for name in context._python_includes):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix=f"{PACKAGE}-")) / f"{PACKAGE}-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it again.

    Cuts the lineage like :func:`materialize`; later reads load only the columns they use.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
