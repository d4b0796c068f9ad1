"""SparkSession factory and the shared work folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

#: The folder made where the session names none, and work folders that are still there.
_OWN: dict[str, str] = {}
_LEFT: set[str] = set()


def build_session(app: str = "quillon", cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings every query assumes: UTC, AQE with skew-join handling, Arrow."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-warehouse-"))
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver tables as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset.
    What is still there when the driver ends is removed then."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = _OWN.setdefault("base", _OWN.get("base") or "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    path = spark._jvm.org.apache.hadoop.fs.Path(base)  # without a scheme, the cluster's own file system is meant
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if not _LEFT:
        atexit.register(lambda: [remove_folder(x) for x in list(_LEFT)])
    _LEFT.add(uri := f"{base.rstrip('/')}/quillon-{label}-{uuid.uuid4().hex}")
    return uri


def remove_folder(uri: str) -> None:
    """Deletes a work folder that nothing reads any more."""
    _LEFT.discard(uri)
    files, path = (fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)
    if files.get_file_info(path).type == fs.FileType.Directory:
        files.delete_dir(path)
