"""Where intermediate tables go."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}  # application -> the folder made for it


def work_base(spark: SparkSession) -> str:
    """Shared folder named by the session (``spark.checkpoint.dir``).

    Without the setting, a session in one process (``local[..]``) gets a
    temporary folder that goes when Python ends. Everywhere else a
    machine-local folder would be lost with its executor, so there the missing
    setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="driftspark-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path no other call uses, so concurrent runs never overwrite."""
    return f"{work_base(spark)}/{name}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def entries(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder. Any other trouble
    is an error."""
    files, where = _place(spark, path)
    return [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []


def remove_tree(spark: SparkSession, path: str) -> None:
    files, where = _place(spark, path)
    files.delete(where, True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes one table that ``new_path`` named."""
    if not path.startswith(work_base(spark) + "/"):
        raise ValueError(f"{path} is not in the work folder")
    remove_tree(spark, path)
