"""Session settings and lineage cuts shared by every module."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Series are collected per item: keep hashing up to 4096 items per task (some 14 KB each at
    # 357 weeks) before the aggregate falls back to sorting.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    # No call-site capture per column expression: it doubles the time to build large plans.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # GBK ledgers: without this Spark accepts only its short list of charsets.
    "spark.sql.legacy.javaCharsets": "true",
}


def build_session(app_name: str = "granary", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the context's checkpoint folder, else ``spark.checkpoint.dir``."""
    context = spark.sparkContext
    chosen = context.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and chosen is None:
        raise RuntimeError("set spark.checkpoint.dir, or call setCheckpointDir, with a folder that all executors share")
    if chosen is None:
        context.setCheckpointDir(configured)
    return configured or chosen


def provide_folder(spark: SparkSession) -> None:
    """For tests, checks and benches on one machine: a new temporary folder where no folder is set."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="granary-"))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context: Python functions load it by name there."""
    context = spark.sparkContext
    if getattr(context, "_granary_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="granary-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as to:
        for path in sorted(root.rglob("*.py")):
            to.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._granary_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that lost executors cannot change it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
