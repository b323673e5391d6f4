"""Session building and the few settings that operators read from it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "matchloom", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings that tests and benchmarks use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("MATCHLOOM_DRIVER_MEMORY", "12g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of a shuffle; the unit by which operators scale their key ranges."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the session names; a private one is made only for a session that runs on this machine alone."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isDefined():
        return context._jsc.sc().getCheckpointDir().get()
    if not named and not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = named or tempfile.mkdtemp(prefix="matchloom-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df):
    """Write df to the shared checkpoint folder and read it from there from now on."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per session: their Python needs it for functions over Arrow batches."""
    context = spark.sparkContext
    if getattr(context, "_matchloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    # The folder is the driver's own; Spark's file server hands the archive to the executors.
    archive = Path(tempfile.mkdtemp(prefix="matchloom-package-")) / "matchloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._matchloom_shipped = True
