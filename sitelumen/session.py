"""Session settings and shipping of this package to the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def importable_on_workers() -> bool:
    """Whether Python workers inherit a path that holds the package."""
    places = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    return any(p and Path(p).resolve() == ROOT for p in places)


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, once an application, unless they can import it anyway."""
    context = spark.sparkContext
    if context.applicationId in _shipped or importable_on_workers():
        return
    _shipped.add(context.applicationId)
    target = Path(tempfile.mkdtemp(prefix="sitelumen-ship-")) / "sitelumen.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted((ROOT / "sitelumen").rglob("*.py")):
            out.write(path, path.relative_to(ROOT))
    context.addPyFile(str(target))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Take the folder from ``spark.checkpoint.dir``; one of our own, removed at the end, only where none is named, on one machine."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="sitelumen-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared checkpoint folder; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
