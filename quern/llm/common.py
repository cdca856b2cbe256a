"""Helpers that several operators share: scratch tables in the shared folder, word splitting, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps A-Z to a-z and every other ASCII byte that is not a digit or a-z to a space; bytes from 0x80 stay.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text as UTF-8 bytes; null has none.

    Every excluded character is ASCII, so splitting the UTF-8 bytes gives the same words as splitting code points.
    """
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder shared by the driver and the executors")
    spark_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if spark_dir.isDefined():
        return spark_dir.get().rstrip("/")
    own = tempfile.mkdtemp(prefix="quern-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def free_names(taken: list[str], names: tuple[str, ...]) -> tuple[str, ...]:
    """The names, each with as many underscores before it as keep it apart from those taken, whatever their case."""
    taken, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return tuple(out)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Folder:
    """Files of one folder, by its address; a file appears under its name only when it is whole."""

    def __init__(self, uri: str):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path, recursive=True)

    def write(self, name: str):
        temporary = f"{self.path}/.{name}.{uuid.uuid4().hex}"
        return temporary, self.fs.open_output_stream(temporary)

    def settle(self, temporary: str, name: str) -> None:
        self.fs.move(temporary, f"{self.path}/{name}")

    def read(self, name: str):
        return self.fs.open_input_stream(f"{self.path}/{name}", compression=None)


#: Spark's setting that removes the shuffle files of a query when it ends.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive a lost executor."""

    def __init__(self, spark: SparkSession, name: str, free_shuffles: bool = False):
        """free_shuffles: what was shuffled for a table goes as soon as the table is written, not when the driver next
        collects its garbage."""
        self.spark, self.name, self.paths, self.tables, self.free_shuffles = spark, name, [], {}, free_shuffles

    def keep(self, df: DataFrame) -> DataFrame:
        """Writes df once and returns the written table."""
        path = scratch_path(self.spark, self.name)
        before = self.spark.conf.get(_FREE, "false")
        if self.free_shuffles:
            self.spark.conf.set(_FREE, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            if self.free_shuffles:
                self.spark.conf.set(_FREE, before)
        self.paths.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(out)] = out, path
        return out

    def free(self, *tables: DataFrame) -> None:
        """Removes kept tables that no later step reads."""
        for table in tables:
            _, path = self.tables.pop(id(table))
            self.paths.remove(path)
            drop_path(self.spark, path)

    def drop(self, but_last: int = 0) -> None:
        """Removes the tables that no later step reads."""
        gone, self.paths = (self.paths[:-but_last], self.paths[-but_last:]) if but_last else (self.paths, [])
        for path in gone:
            drop_path(self.spark, path)


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (a, b): rows (node, root), root the smallest node of the component.

    Alternates large-star and small-star steps. Neighbour minima are partial aggregates and the rest are plain joins
    that adaptive execution splits, so a node with very many edges never meets one task. Each round is a written table.
    """
    pair = lambda x, y: (F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    stars = edges.where("a <> b").select(*pair(F.col("a"), F.col("b"))).distinct()
    stars = scratch.keep(stars)
    mark = None
    for _ in range(max_rounds):
        seen = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark or seen["n"] == 0:
            break
        mark = seen
        # large-star: every larger neighbour of x goes to the smallest of x and its neighbours
        both = stars.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
            stars.select(F.col("v").alias("x"), F.col("u").alias("y"))
        )
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small-star: x and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        stars = scratch.keep(
            small.unionByName(least.select("u", F.col("m").alias("v"))).select(*pair(F.col("u"), F.col("v"))).distinct()
        )
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return stars.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
