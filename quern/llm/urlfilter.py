"""URL rules by a sort-merge range join over reversed-host keys.

A host's labels in reverse order, each followed by a low separator, make a canonical key in which a host and all its
subdomains are one interval. Rules and urls are dealt into key ranges (a rule goes to every range that its interval
meets, a url to one) and sorted; one sweep keeps the stack of rules whose intervals are open, which are always nested.
Each open host has its rules by path, so a url looks up its path's prefixes of the lengths that occur, however many rules
there are, and the longest fitting rule wins.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ends a label in a key, and the next character, which ends the interval of a key; both are escaped within hosts.
SEP, NEXT = "\x01", "\x02"
#: Keys drawn to place the ranges, in all; a url is drawn by a hash of its key, so the draw is the same in every run.
DRAWN_KEYS = 20_000


def host_of(url) -> F.Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url) -> F.Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def key_of(host) -> F.Column:
    """Labels in reverse order, each with its separator: the keys of a host and its subdomains have the host's as prefix.

    A separator that is part of a host is escaped, so it never ends a label.
    """
    plain = F.replace(F.replace(host, F.lit(NEXT), F.lit(NEXT + "b")), F.lit(SEP), F.lit(NEXT + "a"))
    return F.concat(F.array_join(F.reverse(F.split(plain, r"\.")), SEP), F.lit(SEP))


def _sweep(default: str):
    """For rows (key, kind, page, host, path, rule, verdict) in key order, rules first: one row per url."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # host key, its rules (name, verdict) by path, and the lengths of their paths, longest first
        stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []
        for batch in batches:
            rules, verdicts, keep = [], [], []
            keys, kinds, hosts, paths, names, said = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "kind", "host", "path", "rule", "verdict"))
            for i, (key, kind, host, path) in enumerate(zip(keys, kinds, hosts, paths, strict=True)):
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, []))
                    own, lengths = stack[-1][1:]
                    own[path] = max(own.get(path, ("", "")), (names[i], said[i]))
                    if len(path) not in lengths:
                        bisect.insort(lengths, len(path), key=lambda n: -n)
                    continue
                best = None
                for _, own, lengths in stack:
                    fit = next((own[path[:n]] for n in lengths if n <= len(path) and path[:n] in own), None)
                    if fit and (best is None or (len(fit[0]), fit[0]) >= (len(best[0]), best[0])):
                        best = fit
                keep.append(i)
                rules.append(best[0] if best else None)
                verdicts.append(best[1] if best else default)
            rows = batch.take(pa.array(keep, pa.int64()))
            kept = [rows.column(rows.schema.get_field_index(c)) for c in ("page_id", "host", "path")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return run


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", ranges: int | None = None) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict), one per row of pages.

    rules has host, path and verdict; a rule's name is its host and path. It fits its host and all subdomains where the
    url's path begins with its path; the rule with the most characters wins, ties by name. Without a fitting rule the
    verdict is default and the rule null. A rule with a null in any column is left out, a rule without a host fits every
    url; repeated rules count once, and of one with two verdicts the later in order counts. Urls of any length are read
    whole. Null ids are carried, repeated rows stay, an empty table gives no row,
    and other columns are not read.
    """
    spark: SparkSession = pages.sparkSession
    n = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    # the path and a hash of the id end a url's sort key, so that one host or one url never has to stay in one range
    salt = F.concat(key_of(F.col("host")), F.lit("\x00"), F.hex(F.xxhash64("path", "page_id")))
    urls = urls.withColumn("key", salt)
    total = pages.count()
    share = min(1_000_000, max(1, DRAWN_KEYS * 1_000_000 // max(total, 1)))
    drawn = urls.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < share).select("key").limit(4 * DRAWN_KEYS)
    keys = sorted(r["key"] for r in drawn.collect())
    bounds = [keys[len(keys) * i // n] for i in range(1, n)] if keys else []
    bounds = sorted(set(bounds))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect.bisect_right(bounds, k) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], names=["part", *batch.schema.names])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [(bisect.bisect_right(bounds, k), bisect.bisect_left(bounds, k[:-1] + NEXT) if k else len(bounds)) for k in batch.column(0).to_pylist()]
            take = [i for i, (lo, hi) in enumerate(ends) for _ in range(lo, hi + 1)]
            part = [p for lo, hi in ends for p in range(lo, hi + 1)]
            rows = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *rows.columns], names=["part", *batch.schema.names])

    columns = "key string, kind int, page_id long, host string, path string, rule string, verdict string"
    empty = F.lit(None).cast("string")
    url_rows = urls.select("key", F.lit(1).alias("kind"), "page_id", "host", "path", empty.alias("rule"), empty.alias("verdict"))
    known = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null").distinct()
    rule_key = F.when(F.col("host") == "", F.lit("")).otherwise(key_of(F.col("host")))
    rule_rows = known.select(rule_key.alias("key"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), "host", "path", F.concat("host", "path").alias("rule"), "verdict")
    both = url_rows.mapInArrow(place, f"part int, {columns}").unionByName(rule_rows.mapInArrow(spread, f"part int, {columns}"))
    # the ranges are known, so a partition holds its range alone and the sweep begins with an empty stack
    dealt = both.repartitionByRange(n, "part").sortWithinPartitions("part", F.encode("key", "UTF-8"), "kind", "rule")
    return dealt.mapInArrow(_sweep_ranges(default), "page_id long, host string, path string, rule string, verdict string")


def _sweep_ranges(default: str):
    """A partition may hold several ranges one after the other; each is swept on its own."""
    sweep = _sweep(default)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(first: pa.RecordBatch, part: int):
            nonlocal pending
            pending = None
            batch = first
            while batch is not None:
                parts = batch.column(0).to_pylist()
                if parts[0] != part:
                    pending = batch
                    return
                cut = bisect.bisect_right(parts, part)
                yield batch.slice(0, cut)
                if cut < len(parts):
                    pending = batch.slice(cut)
                    return
                batch = next((b for b in batches if b.num_rows), None)

        batches = iter(batches)
        pending = next((b for b in batches if b.num_rows), None)
        while pending is not None:
            yield from sweep(one(pending, pending.column(0)[0].as_py()))

    return run
