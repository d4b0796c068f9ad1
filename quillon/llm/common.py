"""What the operators of this subpackage share: the shared work folder and table readers."""

from __future__ import annotations

import atexit
import posixpath
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: The folder made where the session names none: one for the process.
_OWN: dict[str, str] = {}
#: Work folders of this driver that are still there; those that a returned DataFrame reads are removed when the driver ends.
_LEFT: set[str] = set()


def work_path(spark: SparkSession, label: str) -> str:
    """A new path, with its scheme, in the folder that driver and executors share (spark.checkpoint.dir).

    Only where the session names none, as in tests, a temporary folder is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = _OWN.setdefault("base", _OWN.get("base") or "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    path = spark._jvm.org.apache.hadoop.fs.Path(base)  # without a scheme, the cluster's own file system is meant
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if not _LEFT:
        atexit.register(_sweep)
    _LEFT.add(uri := f"{base.rstrip('/')}/quillon-{label}-{uuid.uuid4().hex}")
    return uri


def _sweep() -> None:
    for uri in list(_LEFT):
        remove(uri)


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI, on the driver or in a task."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Writes a file whole: under a name of its own first, then moved, so that a retried task leaves one full file."""
    files, path = store(uri)
    files.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as out:
        out.write(data)
    files.move(part, path)


def read_file(uri: str, start: int = 0, size: int | None = None) -> bytes:
    files, path = store(uri)
    with files.open_input_file(path) as src:
        if size is None:
            size = src.size() - start
        return src.read_at(size, start)


def remove(*uris: str) -> None:
    """Deletes work folders that nothing reads any more."""
    for uri in uris:
        _LEFT.discard(uri)
        files, path = store(uri)
        if files.get_file_info(path).type == fs.FileType.Directory:
            files.delete_dir(path)


def saved(df: DataFrame, uri: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: lineage ends there."""
    df.write.mode("overwrite").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, label: str) -> str:
    """label, with as many underscores after it as make it a name that no column of df has (in any case)."""
    taken = {c.lower() for c in df.columns}
    while label.lower() in taken:
        label += "_"
    return label


def join_split(many: DataFrame, one: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """many joined on key with one, which has one row for each key and in `weight` the number of many's rows with it.

    Keys with more than a 4 x tasks-th of the whole weight are fewer than 4 x tasks, however large the input: their rows of
    `one` are broadcast, so hot keys' rows of `many` stay where they are. All other keys meet by a shuffle. Both inputs are
    read more than once: they should be written tables.
    """
    total, top = one.agg(F.sum(weight), F.max(weight)).first()
    limit = (total or 0) / (4 * parallelism(many.sparkSession))
    if (top or 0) <= limit:
        return many.join(one, key, how)
    hot = one.where(F.col(weight) > limit)
    cold = many.join(F.broadcast(hot.select(key)), key, "left_anti").join(one.where(F.col(weight) <= limit), key, how)
    return many.join(F.broadcast(hot), key).unionByName(cold)
