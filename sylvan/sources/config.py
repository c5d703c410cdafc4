"""Run settings from the session's configuration, then the environment."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

PREFIX = "sylvan."
_made: list[tuple[SparkSession, str]] = []


def setting(spark: SparkSession, name: str, default: str | None = None) -> str | None:
    """``sylvan.<name>`` of the session, or SYLVAN_<NAME>, or the default."""
    found = spark.conf.get(PREFIX + name, None)
    return found if found is not None else os.environ.get((PREFIX + name).replace(".", "_").upper(), default)


def read_env(spark: SparkSession, path: str) -> dict[str, str]:
    """The NAME=value lines of a settings file on any store that Spark reads;
    blank lines and comments go, as do quotes around a value."""
    out = {}
    for (line,) in spark.read.text(path).collect():  # a handful of lines
        name, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and not name.startswith("#"):
            value = value.strip()
            out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the session shares with executors.
    Where it names none, a local session uses a temporary folder and a
    cluster the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or setting(spark, "scratch")
    if not shared:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        shared = "file://" + tempfile.gettempdir() if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    path = f"{shared}/sylvan-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _remove() -> None:
    """Scratch folders go when the driver exits."""
    for spark, path in _made:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone already
            return
