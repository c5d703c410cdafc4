"""File sources and sinks with guards."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Header names that mean the tree's id.
ID_ALIASES = ("unique_id", "uniqueId", "uniqueID")
STATUS = "split string, train_status string, path string, required boolean, loaded boolean, n_rows long, message string"


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df``, or ValueError naming the columns that it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def repair_id(df: DataFrame) -> DataFrame:
    for name in ID_ALIASES:
        if name in df.columns and name != "uniqueID":
            return df.withColumnRenamed(name, "uniqueID")
    return df


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header and a declared schema; only ``columns`` are parsed."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.select(*columns) if columns else df


def read_folder(spark: SparkSession, folder: str, schema: T.StructType | str, required: Sequence[str] = ()) -> DataFrame:
    """All CSV files of a folder, with ``file`` as the key of their order.
    A folder without rows is an error."""
    df = require(spark.read.schema(schema).option("header", True).csv(f"{folder}/*.csv"), required)
    if df.isEmpty():
        raise ValueError(f"no rows in {folder}")
    return df.withColumn("file", F.input_file_name())


def load_or_status(spark: SparkSession, split: str, train_status: str, path: str, required: bool = False) -> tuple[DataFrame | None, DataFrame]:
    """(data or None, status row). A required source that fails raises."""
    try:
        df = spark.read.parquet(path)
        row = (split, train_status, path, required, True, df.count(), "ok")
    except Exception as e:
        if required:
            raise
        df, row = None, (split, train_status, path, required, False, 0, type(e).__name__)
    return df, spark.createDataFrame([row], STATUS)


def write_table(df: DataFrame, path: str, kind: str = "parquet", columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> None:
    """Write the chosen columns, overwriting; CSV files get a header."""
    out = (df.select(*columns) if columns else df).write.mode("overwrite")
    if kind == "csv":
        out = out.option("header", True)
    (out.partitionBy(*by) if by else out).format(kind).save(path)


def write_json(spark: SparkSession, path: str, meta: dict) -> None:
    """A metadata sidecar of one line."""
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_cache(df: DataFrame, path: str, tag: str) -> None:
    write_table(df, f"{path}/data")
    write_table(df.sparkSession.createDataFrame([(tag, ",".join(df.columns))], "tag string, columns string"), f"{path}/meta")


def read_cache(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """A cached table whose tag and columns are as they were written."""
    meta, df = spark.read.parquet(f"{path}/meta").first(), spark.read.parquet(f"{path}/data")
    if meta.tag != tag or meta.columns.split(",") != df.columns:
        raise ValueError(f"cache {path} is of tag {meta.tag!r}, not {tag!r}, or has other columns")
    return df


def save_model(model: PipelineModel, path: str, meta: dict) -> None:
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    write_json(spark, f"{path}/meta", meta)


def load_model(spark: SparkSession, path: str, tag: str) -> PipelineModel:
    found = json.loads(spark.read.text(f"{path}/meta").first().value)
    if found.get("tag") != tag:
        raise ValueError(f"model {path} is of tag {found.get('tag')!r}, not {tag!r}")
    return PipelineModel.load(f"{path}/model")
