"""Structured Streaming: deduplication across epochs, running token counts, and the deficit mixer with state."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quern.operators.mixing import choose_source


def read_parquet_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def unseen_stream(stream: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Each key once; keys are forgotten when the watermark has passed them, so the state stays bounded."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def token_counts(stream: DataFrame, source: str, tokens: str, at: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Rows and tokens by source and time window; late rows beyond the delay are left out."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, window), source).agg(F.count("*").alias("n"), F.sum(tokens).alias("tokens"))


class Lane(StatefulProcessor):
    """The deficit mixer of one lane as state: tokens by source, the number of the next row, and the rows that wait.

    A row goes out while every source has one waiting, since only then the choice is what it would be with all rows known.
    A row without a key is the end of the lane: what waits goes out as sources run dry. So the order is that of one loop
    over all of the lane's rows, wherever batches end or a run is interrupted. Waiting rows are list state on disk;
    ``keep`` bounds them at the price of that order, and ``idle_ms`` lets them go where nothing more comes.
    """

    def __init__(self, targets: dict[str, float], columns: list[str], seed: int, keep: int | None, idle_ms: int | None):
        self.targets, self.columns, self.seed, self.keep, self.idle_ms = targets, columns, seed, keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("tokens", "source string", "tokens long")
        self.next = handle.getValueState("next", "row long")
        self.waiting = handle.getListState("waiting", "key long, source string, tokens long")

    def _mixed(self, lane, fresh: list[tuple], ended: bool) -> pd.DataFrame:
        used, queues = dict.fromkeys(self.targets, 0), {s: deque() for s in self.targets}
        used.update((k[0], v[0]) for k, v in self.counts.iterator())
        order = self.next.get()[0] if self.next.exists() else 0
        held = list(self.waiting.get()) if self.waiting.exists() else []
        for k, s, n in [*held, *fresh]:
            if s in queues:
                queues[s].append((k, n))
        out = []
        while any(queues.values()):
            if not (ended or all(queues.values()) or self.keep is not None and max(map(len, queues.values())) > self.keep):
                break
            draw = int(hashlib.md5(f"{self.seed}:{lane}:{order}".encode()).hexdigest()[:8], 16) / 2**32
            s = choose_source(self.targets, used, {x: len(q) for x, q in queues.items()}, draw)
            k, n = queues[s].popleft()
            used[s] += n
            out.append((lane, k, s, n, order))
            order += 1
        for s, n in used.items():
            self.counts.updateValue((s,), (n,))
        self.next.update((order,))
        rest = [(k, s, n) for s, q in queues.items() for k, n in q]
        if rest:
            self.waiting.put(rest)
        elif held:
            self.waiting.clear()
        return pd.DataFrame(out, columns=self.columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lane, fresh, ended = key[0], [], False
        for frame in rows:
            for k, s, n in frame[self.columns[1:4]].itertuples(index=False, name=None):
                if pd.isna(k):
                    ended = True
                else:
                    fresh.append((int(k), s, int(n)))
        yield self._mixed(lane, sorted(fresh, key=lambda r: r[0]), ended)
        if self.idle_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if self.waiting.exists():
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._mixed(key[0], [], True)

    def close(self) -> None:
        pass


STORE = "spark.sql.streaming.stateStore.providerClass"


def mixed_stream(
    stream: DataFrame, targets: dict[str, float], key: str, source: str = "source", tokens: str = "n_tokens", lane: str = "lane", seed: int = 42, keep: int | None = None, idle_ms: int | None = None
) -> DataFrame:
    """Rows (lane, key, source, tokens, order) as each lane's mixer yields them; rows of a lane come in the order of their keys
    from batch to batch, and one with a null key ends it. The state store must be RocksDB's (``rocksdb``)."""
    kept = stream.select(F.col(lane).cast("long"), F.col(key).cast("long"), source, F.col(tokens).cast("long"))
    return kept.groupBy(lane).transformWithStateInPandas(
        statefulProcessor=Lane(targets, [lane, key, source, tokens, "order"], seed, keep, idle_ms),
        outputStructType=f"`{lane}` long, `{key}` long, `{source}` string, `{tokens}` long, `order` long",
        outputMode="Append",
        timeMode="ProcessingTime" if idle_ms else "None",
    )


@contextmanager
def rocksdb(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """The state store of stateful processors, and so many partitions of state, for queries that start within."""
    wanted = {STORE: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what there is, from where its checkpoint ends, and appends its rows to parquet files, each once."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is into a table in memory; for tests and small checks."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return stream.sparkSession.table(name)
