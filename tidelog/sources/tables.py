"""Reading the Parquet tables, and the folder that all executors share."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidelog.sources.storage import Files

SHARED = "spark.checkpoint.dir"
#: Bytes of a file that is broadcast.
MAX_FILE = 64 << 20


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package, by a zip in the shared folder, where they can't by themselves.

    They can if the package's folder is in PYTHONPATH or the working folder; then nothing is done.
    """
    root, context = Path(__file__).resolve().parents[2], spark.sparkContext
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in known or Path.cwd() == root or getattr(context, "_tidelog_shipped", False):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for path in sorted((root / "tidelog").rglob("*.py")):
            z.writestr(str(path.relative_to(root)), path.read_bytes())
    folder, name = shared_dir(spark), f"tidelog-{uuid.uuid4().hex}.zip"
    Files(spark, folder).write(name, data.getvalue())
    context.addPyFile(f"{folder}/{name}")
    context._tidelog_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints and written tables, as a URI.

    It is what ``spark.checkpoint.dir`` names. Where that is unset a local folder is made on one machine, as in tests; on
    a cluster that is an error.
    """
    context = spark.sparkContext
    at = context.getConf().get(SHARED) or context.getCheckpointDir()
    if not at:
        if not (context.master or "").startswith("local"):
            raise ValueError(f"{SHARED} must name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidelog-"))
        at = context.getCheckpointDir()
    return at.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder, until ``clean``."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    context._tidelog_scratch = {*getattr(context, "_tidelog_scratch", ()), path}
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table written below the shared folder: its lineage ends there, and it outlives executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidelog_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the folder of a table that ``written`` gave, once nothing reads it any more."""
    _delete(df.sparkSession, df._tidelog_path)


def clean(spark: SparkSession) -> int:
    """Deletes all folders that this application made by ``scratch``, when no result over them is in use any more;
    returns how many. What users named themselves stays."""
    gone = list(getattr(spark.sparkContext, "_tidelog_scratch", ()))
    for path in gone:
        _delete(spark, path)
    return len(gone)


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    Files(spark, path).delete("")
    context._tidelog_scratch = getattr(context, "_tidelog_scratch", set()) - {path}


def file_to_send(path: str) -> bytes:
    """A file for a broadcast, a vocabulary, at most MAX_FILE bytes long."""
    if os.path.getsize(path) > MAX_FILE:
        raise ValueError(f"{path} is longer than {MAX_FILE} bytes, too long to be sent to all executors")
    with open(path, "rb") as f:
        return f.read()
