"""Sinks: compressed parquet, CSV, line lists, JSON summaries and metrics."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a temporary one in local runs without it."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the driver and the executors")
        own = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        return own
    return f"{base.rstrip('/')}/quern-{uuid.uuid4().hex}"


def write_parquet(df: DataFrame, path: str, level: int = 9, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in a new shared folder: computed once, its lineage cut, and still there when an executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    write_parquet(df, path, level=3)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_parquet_and_csv(df: DataFrame, path: str) -> None:
    """The same rows as parquet and as CSV with a header; the CSV is made from the written parquet."""
    write_parquet(df, f"{path}.parquet")
    df.sparkSession.read.parquet(f"{path}.parquet").write.mode("overwrite").option("header", True).csv(f"{path}.csv")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).where("value is not null").write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row, for summaries of a row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Appends rows (name, value, step)."""
    metrics.select("name", "value", "step").write.mode("append").parquet(path)


def json_metadata(columns: list[Column], binary: tuple[str, ...] = (), names: list[str] | None = None) -> Column:
    """A JSON object of a row's metadata, binary fields in base 64."""
    named = [(F.base64(c) if n in binary else c).alias(n) for c, n in zip(columns, names or [], strict=True)]
    return F.to_json(F.struct(*named))


def tokens_from_metadata(metadata: Column, default: int = 0) -> Column:
    """tokens_seen of a JSON object, the default where it is missing."""
    return F.coalesce(F.get_json_object(metadata, "$.tokens_seen").try_cast("bigint"), F.lit(default).cast("bigint"))
