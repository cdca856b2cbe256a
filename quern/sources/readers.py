"""Sources: parquet by pattern or list, Arrow files, text lists, dictionaries, benchmarks, caches and freshness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import SourceConfig
from quern.operators.relational import require_columns
from quern.operators.sampling import cap_per_group, sample_n

CHOICE_FIELDS = ("encoder_input", "candidates", "correct_idx", "category", "benchmark")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern has files, on any file system that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def scan(spark: SparkSession, pattern: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Lazy scan of a pattern or a list of files; only the columns asked for are read."""
    df = spark.read.parquet(*([pattern] if isinstance(pattern, str) else pattern))
    return df.select(*columns) if columns else df


def load(spark: SparkSession, path: str) -> DataFrame:
    """A parquet path that must exist."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def scan_source(spark: SparkSession, source: SourceConfig) -> DataFrame:
    """A source with the columns that its fields name, those that its files have."""
    df = spark.read.parquet(source.pattern)
    return df.select(*(c for c in source.required_columns if c in df.columns))


def scan_all(spark: SparkSession, sources: list[SourceConfig], read: Callable[[SparkSession, SourceConfig], DataFrame] = scan_source) -> DataFrame:
    """All sources under each other with ``source_name``; columns that one lacks are null."""
    frames = [read(spark, s).withColumn("source_name", F.lit(s.name)) for s in sources]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def first_values(df: DataFrame, column: str, n: int, key: str) -> DataFrame:
    """The first n values of a column in key order."""
    return df.orderBy(key).limit(n).select(column)


def text_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed lines (value) without blanks; a repeat is an error."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")
    n = lines.agg(F.count("*").alias("n"), F.count_distinct("value").alias("d")).first()
    if n["n"] != n["d"]:
        raise ValueError(f"{path} has {n['n'] - n['d']} repeated lines")
    return lines


def dictionary_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of dictionary files with the file's priority (later ones win) and their position."""
    out = None
    for k, path in enumerate(paths):
        lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("position", "value"))
        lines = lines.withColumn("priority", F.lit(k))
        out = lines if out is None else out.unionByName(lines)
    return out.select("value", "priority", "position")


def benchmark(spark: SparkSession, paths: list[str], per_benchmark: int = 200, seed: int = 42, temporal: bool = False, key: str = "encoder_input") -> DataFrame:
    """Multiple-choice rows, capped per benchmark by a seeded sample; a file without the fields is an error."""
    fields = [*CHOICE_FIELDS, *(["true_year"] if temporal else [])]
    frames = [require_columns(spark.read.parquet(p), fields).select(*fields) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return cap_per_group(out, per_benchmark, "benchmark", key, seed)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at a path, written first if it is not there or not whole."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def cache_path(root: str, source: str, mode: str, host: int, split: str | None = None) -> str:
    """One place for one slice, for reading and for writing."""
    return "/".join([root.rstrip("/"), source, *([split] if split else []), f"{mode}-host{host}"])


def cached_with_count(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, int]:
    """A cached table and the number of its rows, kept beside it."""
    df = cached(spark, path, make)
    counts = cached(spark, f"{path}-rows", lambda: df.agg(F.count("*").alias("n")))
    return df, counts.first()["n"]


def sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return sample_n(df, n, key, seed)


def head(df: DataFrame, n: int, key: str) -> DataFrame:
    return df.orderBy(key).limit(n)


def smoke_rows(spark: SparkSession, n: int = 8) -> DataFrame:
    """Synthetic rows in the canonical columns, for a smoke run without files."""
    return spark.range(n).select(
        F.format_string("text %d. It has two sentences.", "id").alias("original_text"),
        F.format_string("연도: %d", F.col("id") + 1920).alias("metadata"),
        F.concat(F.lit("source"), (F.col("id") % 3).cast("string")).alias("source"),
        F.lit("mixed").alias("data_type"),
    )


def listing(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Rows (path, name, size) of the files at a path, from the scan's metadata: their contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("size"))


def stale_files(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Rows (name, state): missing, extra or changed in size."""
    joined = remote.withColumnRenamed("size", "r").join(local.withColumnRenamed("size", "l"), "name", "full_outer")
    state = F.when(F.col("l").isNull(), "missing").when(F.col("r").isNull(), "extra").when(F.col("r") != F.col("l"), "changed")
    return joined.select("name", state.alias("state")).where("state is not null")
