"""Shared working storage, reached through Spark's own file-system layer.

Intermediate results that must outlive the loss of an executor are written to the
folder the cluster names in ``spark.checkpoint.dir``. A temporary folder of this
machine is used only in local mode, where driver and executors are one process.
"""

from __future__ import annotations

import atexit
import io
import logging
import math
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

log = logging.getLogger(__name__)

PACKAGE = Path(__file__).resolve().parent

INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
SPLIT_BYTES = "spark.sql.files.maxPartitionBytes"
MB = 1024 * 1024
# Compressed bytes of all columns; a shuffle mostly carries a few of them, decoded: ten times as much where values repeat.
STORED_BYTES_PER_PARTITION = 32 * MB
# Beyond this the number of map-to-reduce blocks costs more than larger partitions.
MAX_SHUFFLE_PARTITIONS = 20_000
MAX_SCAN_TASKS = 200_000
DEFAULT_SPLIT_BYTES = 128 * MB
MAX_SPLIT_BYTES = 512 * MB

_local_root: str | None = None


def _local_temp_root() -> str:
    global _local_root
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="trainscore-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a fresh temporary one in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return _local_temp_root()
    raise ValueError("spark.checkpoint.dir is not set: it must name a folder all executors can reach")


def fresh_path(spark: SparkSession, purpose: str) -> str:
    """A path under the shared folder that nothing has used yet."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


_job_paths: ContextVar[list[str] | None] = ContextVar("job_paths", default=None)


@contextmanager
def working_storage(spark: SparkSession) -> Iterator[None]:
    """Folders named by ``working_path`` inside go at the end."""
    paths: list[str] = []
    token = _job_paths.set(paths)
    try:
        yield
    finally:
        _job_paths.reset(token)
        for path in paths:
            delete_path(spark, path)


def working_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path for a table of the running job, or of this process where no job runs."""
    path, paths = fresh_path(spark, purpose), _job_paths.get()
    if paths is None:
        atexit.register(_forget, spark, path)
    else:
        paths.append(path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    try:
        delete_path(spark, path)
    except (Py4JError, OSError, AttributeError):
        pass  # the session is gone; the cluster's own cleaning remains


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give iterative estimators a place to cut their lineage, if they have none."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(fresh_path(spark, "checkpoints"))


def _hadoop_path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = _hadoop_path(spark, path)
    return fs.exists(target)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """What lies directly in a folder; nothing if there is none."""
    fs, target = _hadoop_path(spark, path)
    return sorted(status.getPath().getName() for status in (fs.listStatus(target) if fs.exists(target) else ()))


def create_file(spark: SparkSession, path: str) -> None:
    """An empty file, with the folders above it; there must be none yet."""
    fs, target = _hadoop_path(spark, path)
    fs.create(target, False).close()


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a file or a folder with all that is in it."""
    fs, target = _hadoop_path(spark, path)
    fs.delete(target, True)


def metadata_below(spark: SparkSession, path: str, leave: str) -> list[str]:
    """Folders below ``path``, at any depth, that hold a folder ``metadata``; not in folders that begin with ``leave``."""
    fs, target = _hadoop_path(spark, path)
    found, open_ = [], [target]
    while open_:
        for status in fs.listStatus(open_.pop()):
            folder = status.getPath()
            if not status.isDirectory() or folder.getName().startswith(leave):
                continue
            if folder.getName() == "metadata":
                found.append(folder.getParent().toString())
            else:
                open_.append(folder)
    return sorted(f for f in found if f.rstrip("/") != fs.makeQualified(target).toString().rstrip("/"))


def stored_bytes(spark: SparkSession, paths: Sequence[str]) -> int:
    """Size of the files under ``paths`` (globs allowed).

    What does not exist, or is no path at all (a plugin may load from anywhere),
    counts as nothing.
    """
    total = 0
    for path in paths:
        try:
            fs, target = _hadoop_path(spark, path)
            for status in fs.globStatus(target) or ():
                total += fs.getContentSummary(status.getPath()).getLength()
        except (Py4JJavaError, PySparkException) as err:
            log.info("size of %s is not known: %s", path, err)
    return total


def job_session(spark: SparkSession) -> SparkSession:
    """A session of its own for one job, with the caller's settings as they are now.

    What the job sets is not seen by the caller or by other jobs, and the other way round. Executors, catalogs
    and caches are shared; temporary views and functions of the caller are not.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.get(key, None) != value:  # static settings are the same in all sessions
            own.conf.set(key, value)
    return own


def _setting_for(spark: SparkSession, stored: int) -> dict[str, str]:
    wanted: dict[str, str] = {}
    if spark.conf.get(INITIAL_PARTITIONS, None) is None:
        partitions = min(math.ceil(stored / STORED_BYTES_PER_PARTITION), MAX_SHUFFLE_PARTITIONS)
        if partitions > int(spark.conf.get("spark.sql.shuffle.partitions")):
            wanted[INITIAL_PARTITIONS] = str(partitions)
    if spark.conf.get(SPLIT_BYTES).rstrip("b") == str(DEFAULT_SPLIT_BYTES):
        split = min(math.ceil(stored / MAX_SCAN_TASKS), MAX_SPLIT_BYTES)
        if split > DEFAULT_SPLIT_BYTES:
            wanted[SPLIT_BYTES] = str(split)
    return wanted


@contextmanager
def sized_for(spark: SparkSession, paths: Sequence[str]) -> Iterator[None]:
    """Size shuffles and scan splits for the data under ``paths`` while a job runs.

    The fixed number of shuffle partitions suits small data; at 100 TB it would put
    hundreds of gigabytes into each. Adaptive execution merges partitions that turn
    out small, so only the starting number matters. Scan splits grow once the usual
    size would make more than ``MAX_SCAN_TASKS`` of them, each reading few columns.
    What the session has set itself is respected.
    """
    wanted = _setting_for(spark, stored_bytes(spark, paths))
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    The code goes to the shared folder as a zip and from there to each executor.
    """
    sc = spark.sparkContext
    archive = f"{PACKAGE.name}.zip"
    if not PACKAGE.is_dir() or any(path.endswith(f"/{archive}") for path in sc.listFiles):
        return  # it came as an archive itself, or was shipped before
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as code:
        for file in sorted(PACKAGE.rglob("*.py")):
            code.write(file, file.relative_to(PACKAGE.parent))
    path = f"{fresh_path(spark, 'code')}/{archive}"
    fs, target = _hadoop_path(spark, path)
    stream = fs.create(target)
    try:
        stream.write(bytearray(buffer.getvalue()))
    finally:
        stream.close()
    sc.addPyFile(path)
