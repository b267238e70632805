"""Versioned tables on plain Parquet: appended changes, read as the latest row per key.

Layout under the table's folder::

    changes/batch=<id>/period=<p>/            one append; the same id again replaces it
    rows=<n>-<kind>-<unique>-<layout>/        one row per key, in period= and bucket= folders

Every write is one Spark job into a folder of its own, which counts from the moment Spark marks
it as finished. Of a period's rows the newest finished folder that has the period holds; a
folder of kind ``all`` replaces whatever is older. Folding writes the periods that open changes
touch into a new folder and then removes those changes; if it stops in between, folding them
again gives the same rows. A table has one maintenance job at a time; appends may go on beside
it, as a job folds only what it listed before it read anything.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from staysearch.operators.joins import ROW_BYTES
from staysearch.operators.latest import latest_by_key, latest_in_parts
from staysearch.session import shuffles_removed

# Digits of yyyymmdd that name a period.
PERIODS = {"year": 4, "month": 6, "day": 8}
UNDATED = 0
# Open changes up to this many bytes, on disk and in memory, are broadcast to the rows they change.
BROADCAST_BYTES = 16 << 20
# Open changes that a task should hold at once, in bytes on disk: some two million rows.
TASK_BYTES = 16 << 20
# Rows that a file should hold at most, and that it is worth a task of its own for.
FILE_ROWS, LEAST_ROWS = 2_000_000, 100_000


@dataclass(frozen=True)
class Held:
    """Which folder holds each period's rows; ``period`` and ``buckets`` of those folders."""

    number: int = 0
    period: str = "month"
    buckets: int = 1
    folders: dict[int, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Scope:
    """Where touched (placement_id, date) keys lie: folders of a layout, first and last date."""

    period: str
    buckets: int
    folders: frozenset[tuple[int, int]]
    dates: tuple[date, date] | None


def scopes(touched: DataFrame, tables: Sequence[VersionedTable]) -> list[Scope]:
    """The scope of the touched keys in each table; tables of one layout share a job.

    Calendar values and bucket numbers: short lists however many keys there are.
    """
    found: dict[tuple[str, int], Scope] = {}
    for layout in {(t.period, t.buckets) for t in tables}:
        period, buckets = layout
        rows = (
            touched.groupBy(
                period_of(F.col("date"), period).alias("period"),
                VersionedTable._bucket(F.col("placement_id"), buckets).alias("bucket"),
            )
            .agg(F.min("date").alias("first"), F.max("date").alias("last"))
            .collect()
        )
        dates = (min(r["first"] for r in rows), max(r["last"] for r in rows)) if rows else None
        found[layout] = Scope(period, buckets, frozenset((r["period"], r["bucket"]) for r in rows), dates)
    return [found[(t.period, t.buckets)] for t in tables]


def period_of(day: Column, period: str) -> Column:
    number = F.year(day) * 10_000 + F.month(day) * 100 + F.dayofmonth(day)
    return F.floor(number / F.lit(10 ** (8 - PERIODS[period]))).cast("int")


def period_number(day: date | str, period: str) -> int:
    return int(str(day).replace("-", "")[: PERIODS[period]])


class VersionedTable:
    """``changes`` and ``expand`` are for tables whose changes are kept in a shorter form:
    ``changes`` is their schema and key, ``expand`` makes rows of their latest ones."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        keys: Sequence[str],
        period: str = "month",
        buckets: int = 1,
        changes: tuple[T.StructType, Sequence[str]] | None = None,
        expand: Callable[[DataFrame], DataFrame] | None = None,
    ) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema
        self.keys = list(keys)
        self.period = period
        self.buckets = buckets
        self.dated = "date" in schema.fieldNames()
        self.change_schema, change_keys = changes or (schema, keys)
        self.change_keys = list(change_keys)
        self.expand = expand or (lambda rows: rows)
        folders = [T.StructField("period", T.IntegerType()), T.StructField("bucket", T.IntegerType())]
        self._stored = T.StructType([*schema.fields, *folders])

    # -- files -----------------------------------------------------------------

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, pattern: str) -> list[str]:
        """Names of the finished folders that match."""
        fs, path = self._fs(f"{pattern}/_SUCCESS")
        return sorted(status.getPath().getParent().getName() for status in fs.globStatus(path) or [])

    def _periods_in(self, folder: str) -> list[int]:
        fs, path = self._fs(f"{folder}/period=*")
        return [int(status.getPath().getName()[len("period=") :]) for status in fs.globStatus(path) or []]

    def held(self) -> Held:
        """The folders in use. Folders of another layout than the newest whole one's are older."""
        found = sorted((int(name[len("rows=") :].split("-")[0]), name) for name in self._names("rows=*"))
        if not found:
            return Held(period=self.period, buckets=self.buckets)
        whole = max([i for i, (_, name) in enumerate(found) if name.split("-")[1] == "all"], default=0)
        folders = {p: name for _, name in found[whole:] for p in self._periods_in(name)}
        *_, period, buckets = found[-1][1].split("-")
        return Held(found[-1][0], period, int(buckets), folders)

    def batches(self) -> list[str]:
        """Finished appends that are not folded yet."""
        return [name[len("batch=") :] for name in self._names("changes/batch=*")]

    def stored_bytes(self) -> int:
        """Bytes on disk of what a read of the whole table opens."""
        return self._bytes(sorted(set(self.held().folders.values()))) + self._change_bytes(self.batches())

    def stored_rows(self) -> int:
        """Stored rows, superseded ones included; files keep that number in their footers."""
        batches, held = self.batches(), self.held()
        parts = (self._held_rows(held, list(held.folders)), self._changes(batches))
        return sum(rows.count() for rows in parts if rows is not None)

    def _change_bytes(self, batches: Sequence[str], periods: tuple[int, int] | None = None) -> int:
        folders = [f"changes/batch={b}" for b in batches]
        if periods is not None:
            fs, path = self._fs("changes/batch=*/period=*")
            found = {status.getPath().getName() for status in fs.globStatus(path) or []}
            # Days without a date lie in a folder without a number.
            numbers = {name: int(name[len("period=") :]) for name in found if name[len("period=") :].isdigit()}
            folders = [f"{f}/{name}" for f in folders for name, n in numbers.items() if periods[0] <= n <= periods[1]]
        return self._bytes(folders)

    def _change_tasks(self, batches: Sequence[str], periods: tuple[int, int] | None = None) -> int:
        """Tasks that open changes are dealt out to before they are collapsed; 1 leaves them to
        the tasks of their scan, which Spark makes smaller only while there are idle cores."""
        size = self._change_bytes(batches, periods)
        return 1 if size <= TASK_BYTES * self.spark.sparkContext.defaultParallelism else -(-size // TASK_BYTES)

    def _few(self, batches: Sequence[str], periods: tuple[int, int] | None = None) -> bool:
        """Whether open changes may be broadcast. Sorted keys take two bytes a row on disk, so
        the rows count, which files keep in their footers."""
        if self._change_bytes(batches, periods) > BROADCAST_BYTES:
            return False
        return self._changes(batches, periods).count() * ROW_BYTES <= BROADCAST_BYTES

    def _bytes(self, folders: Sequence[str]) -> int:
        total = 0
        for folder in folders:
            fs, path = self._fs(folder)
            total += fs.getContentSummary(path).getLength() if fs.exists(path) else 0
        return total

    # -- reading ---------------------------------------------------------------

    def _held_rows(
        self,
        held: Held,
        periods: Sequence[int],
        placement_id: int | None = None,
        buckets: Sequence[int] | None = None,
    ) -> DataFrame | None:
        """Folded rows of the given periods and buckets. Only the periods' folders are listed,
        and only the buckets' are read."""
        by_folder: dict[str, list[int]] = {}
        for period in periods:
            if period in held.folders:
                by_folder.setdefault(held.folders[period], []).append(period)
        frames = []
        for folder, own in sorted(by_folder.items()):
            root = f"{self.path}/{folder}"
            rows = (
                self.spark.read.schema(self._stored)
                .option("basePath", root)
                .parquet(*[f"{root}/period={p}" for p in sorted(own)])
            )
            if placement_id is not None and held.buckets > 1:
                key = F.lit(placement_id).cast("bigint")
                rows = rows.where(F.col("bucket") == self._bucket(key, held.buckets))
            elif buckets is not None and len(buckets) < held.buckets:
                rows = rows.where(F.col("bucket").isin(list(buckets)))
            frames.append(rows.select(*self.schema.fieldNames()))
        return reduce(DataFrame.unionByName, frames) if frames else None

    def _changes(self, batches: Sequence[str], periods: tuple[int, int] | None = None) -> DataFrame | None:
        """Appended changes; ``periods`` (of this table's own kind) leaves other folders unread."""
        if not batches:
            return None
        folder = T.StructField("period", T.IntegerType())
        rows = (
            self.spark.read.schema(T.StructType([*self.change_schema.fields, folder]))
            .option("basePath", f"{self.path}/changes")
            .parquet(*[f"{self.path}/changes/batch={b}" for b in batches])
        )
        if periods is not None:
            rows = rows.where(F.col("period").between(*periods))
        return rows.select(*self.change_schema.fieldNames())

    def _bounds(self, dates: tuple[date | str, date | str] | None) -> tuple[int, int] | None:
        """First and last period of the dates, in folders of changes."""
        return tuple(period_number(d, self.period) for d in dates) if dates is not None and self.dated else None

    def _parts(
        self, dates: tuple[date | str, date | str] | None, placement_id: int | None
    ) -> tuple[DataFrame | None, DataFrame | None, list[str]]:
        """Wanted folded rows, wanted open changes, and the open batches.

        The batches are listed first: what is folded meanwhile is then read twice, not never.
        """
        batches, held = self.batches(), self.held()
        periods = list(held.folders)
        wanted, bounds = F.lit(True), self._bounds(dates)
        if dates is not None and self.dated:
            first, last = (period_number(d, held.period) for d in dates)
            periods = [p for p in periods if first <= p <= last]
            low, high = (F.lit(str(d)).cast("date") for d in dates)
            wanted = wanted & F.col("date").between(low, high)
        if placement_id is not None:
            wanted = wanted & (F.col("placement_id") == placement_id)
        rows, changes = self._held_rows(held, periods, placement_id), self._changes(batches, bounds)
        return (
            None if rows is None else rows.where(wanted),
            None if changes is None else changes.where(wanted),
            batches,
        )

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def log(
        self, dates: tuple[date | str, date | str] | None = None, placement_id: int | None = None
    ) -> DataFrame:
        """All stored rows, superseded ones included."""
        rows, changes, _ = self._parts(dates, placement_id)
        parts = [p for p in (rows, None if changes is None else self.expand(changes)) if p is not None]
        return reduce(DataFrame.unionByName, parts) if parts else self._empty()

    def candidates(self, scope: Scope) -> DataFrame:
        """Rows that can be the latest of their key, at least those of the touched
        (placement_id, date) keys that ``scope`` describes.

        Files of periods and buckets that no touched key lies in are not read, nor are row
        groups outside the touched dates. Changes are collapsed, so that a key changed very
        often holds two rows at most.
        """
        if scope.dates is None:
            return self._empty()
        batches, held = self.batches(), self.held()
        dates = F.col("date").between(*[F.lit(d) for d in scope.dates])
        inside = scope.folders if (held.period, held.buckets) == (scope.period, scope.buckets) else None
        periods = [p for p in held.folders if inside is None or p in {period for period, _ in inside}]
        rows = self._held_rows(held, periods, buckets=inside and sorted({bucket for _, bucket in inside}))
        bounds = self._bounds(scope.dates)
        changes = self._changes(batches, bounds)
        parts = [
            None if rows is None else rows.where(dates),
            None if changes is None else self._opened(changes.where(dates), self._change_tasks(batches, bounds)),
        ]
        parts = [p for p in parts if p is not None]
        return reduce(DataFrame.unionByName, parts) if parts else self._empty()

    def latest(
        self, dates: tuple[date | str, date | str] | None = None, placement_id: int | None = None
    ) -> DataFrame:
        """One row per key. Without open changes this is a plain scan of the folded files."""
        rows, changes, batches = self._parts(dates, placement_id)
        if changes is None:
            return self._empty() if rows is None else rows
        # One placement's changes are few, whatever files they lie in.
        tasks = 1 if placement_id is not None else self._change_tasks(batches, self._bounds(dates))
        if rows is None:
            return self._opened(changes, tasks)
        return self._merged(rows, changes, self._few(batches, self._bounds(dates)), tasks)

    def _collapsed(self, changes: DataFrame, tasks: int) -> DataFrame:
        """The latest change of each key."""
        if tasks > 1:
            return latest_in_parts(changes, self.change_keys, "version", tasks)
        return latest_by_key(changes, self.change_keys, "version", keep_version=True)

    def _opened(self, changes: DataFrame, tasks: int) -> DataFrame:
        """Rows of the latest change of each key."""
        kept = self._collapsed(changes, tasks)
        return self.expand(kept.select(*self.change_schema.fieldNames())).select(*self.schema.fieldNames())

    def _merged(self, rows: DataFrame, changes: DataFrame, few: bool, tasks: int) -> DataFrame:
        """Folded rows and changes, one row per key. Rows of unchanged keys pass by: with few
        changes they are neither shuffled nor sorted."""
        changed = self._collapsed(changes.select(*self.change_keys, "version"), tasks).select(*self.change_keys)
        changed = F.broadcast(changed) if few else changed
        rest = rows.join(changed, self.change_keys, "left_anti").select(*self.schema.fieldNames())
        hit = rows.join(changed, self.change_keys, "left_semi").select(*self.schema.fieldNames())
        both = latest_by_key(hit.unionByName(self._opened(changes, tasks)), self.keys, "version", keep_version=True)
        return rest.unionByName(both.select(*self.schema.fieldNames()))

    # -- writing ---------------------------------------------------------------

    def append(self, rows: DataFrame, batch: str) -> None:
        """Add changes as one batch. The same ``batch`` again replaces the earlier write."""
        period = period_of(F.col("date"), self.period) if self.dated else F.lit(UNDATED)
        rows = rows.select(*_typed(self.change_schema)).withColumn("period", period)
        if self.dated:
            rows = rows.hint("rebalance", F.col("period"))
        with shuffles_removed(rows.sparkSession):
            rows.write.mode("overwrite").partitionBy("period").parquet(f"{self.path}/changes/batch={batch}")

    def _foldered(self, rows: DataFrame) -> DataFrame:
        period = period_of(F.col("date"), self.period) if self.dated else F.lit(UNDATED)
        bucket = self._bucket(F.col("placement_id"), self.buckets)
        return rows.withColumn("period", period).withColumn("bucket", bucket)

    def arrange(self, rows: DataFrame) -> DataFrame:
        """Put rows into the folders and order of the files.

        Rebalancing sizes the files and splits a folder that one hot placement fills.
        """
        order = [k for k in self.keys if k in rows.columns]
        placed = self._foldered(rows).hint("rebalance", F.col("period"), F.col("bucket"))
        return placed.sortWithinPartitions("period", "bucket", *order)

    def arrange_weighted(self, rows: DataFrame, keys: DataFrame, weights: DataFrame) -> DataFrame:
        """Put rows that a later step multiplies into files of equal size *after* that step.

        ``weights`` (placement_id, weight) says how many rows each row of a placement becomes,
        ``keys`` has the rows' placements and dates and is cheaper to read. Every folder is
        cut into ranges of placements of equal weight, one task and file each. A placement
        that is heavier than a file spreads over several, by date.
        """
        counted = (
            self._foldered(keys.select("placement_id", "date"))
            .groupBy("period", "bucket", "placement_id")
            .agg(F.count("*").alias("n"))
            .join(weights, "placement_id")
            .select("period", "bucket", "placement_id", (F.col("n") * F.col("weight")).alias("w"))
        )
        counted = counted.persist(StorageLevel.MEMORY_AND_DISK)
        total = counted.agg(F.sum("w")).first()[0] or 0
        tasks = self.spark.sparkContext.defaultParallelism
        size = max(LEAST_ROWS, min(FILE_ROWS, -(-total // (2 * tasks))))
        upto = F.sum("w").over(Window.partitionBy("period", "bucket").orderBy("placement_id"))
        whole = F.sum("w").over(Window.partitionBy("period", "bucket"))
        # How many borders lie below a number of rows; the folder's end is none.
        borders = lambda x: F.floor(F.least(x, whole - 1) / size)
        cuts = (
            counted.select("period", "bucket", "placement_id", (borders(upto) - borders(upto - F.col("w"))).alias("k"))
            .groupBy("period", "bucket")
            .agg(
                F.array_sort(
                    F.flatten(F.collect_list(F.array_repeat("placement_id", F.greatest("k", F.lit(0)).cast("int"))))
                ).alias("cuts")
            )
        )
        # One row a folder, one number a file.
        first, table = 0, []
        for row in cuts.orderBy("period", "bucket").collect():
            table.append((row.period, row.bucket, first, row.cuts))
            first += len(row.cuts) + 1
        counted.unpersist()
        if not table:
            return self.arrange(rows)
        where = self.spark.createDataFrame(table, "period int, bucket int, first int, cuts array<bigint>")
        low = F.size(F.filter("cuts", lambda c: c < F.col("placement_id")))
        high = F.size(F.filter("cuts", lambda c: c <= F.col("placement_id")))
        part = F.col("first") + low + F.pmod(F.xxhash64("date"), high - low + 1)
        order = [k for k in self.keys if k in rows.columns]
        # Rows of placements without weight come to nothing; they may have no folder.
        placed = self._foldered(rows).join(F.broadcast(where), ["period", "bucket"])
        placed = placed.withColumn("part", part.cast("int")).drop("first", "cuts")
        return (
            placed.repartitionById(first, F.col("part"))
            .sortWithinPartitions("period", "bucket", *order)
            .drop("part")
        )

    def replace(self, rows: DataFrame, arranged: bool = False, batches: Sequence[str] | None = None) -> None:
        """Reload the table; ``rows`` must hold one row per key.

        ``batches`` are the appends that the rows are known to contain, listed before anything
        that the rows were made from was read; later ones stay open. ``arranged`` rows come
        from one of the arranging methods through steps that keep order and partitions, and
        are written as they are.
        """
        batches = self.batches() if batches is None else batches
        self._write(rows if arranged else self.arrange(rows), "all")
        self._drop(batches)

    def fold(self) -> None:
        """Rewrite the periods that open changes touch, changes included."""
        batches = self.batches()
        if not batches:
            return
        held, changes = self.held(), self._changes(batches)
        if (held.period, held.buckets) != (self.period, self.buckets):
            return self.replace(self.latest(), batches=batches)
        periods = self._periods_in("changes/batch=*")
        rows, tasks = self._held_rows(held, sorted(set(periods))), self._change_tasks(batches)
        if rows is None:
            arranged = self.arranged_changes(changes, tasks)
        else:
            arranged = self.arrange(self._merged(rows, changes, self._few(batches), tasks))
        self._write(arranged, "part")
        self._drop(batches)

    def arranged_changes(self, changes: DataFrame, tasks: int = 1) -> DataFrame:
        return self.arrange(self._opened(changes, tasks))

    def _write(self, arranged: DataFrame, kind: str) -> None:
        fs, path = self._fs("rows=*")
        numbers = [int(s.getPath().getName()[len("rows=") :].split("-")[0]) for s in fs.globStatus(path) or []]
        name = f"rows={max(numbers, default=0) + 1:08d}-{kind}-{uuid.uuid4().hex[:8]}-{self.period}-{self.buckets}"
        folders = [F.col("period"), F.col("bucket")]
        rows = arranged.select(*_typed(self.schema), *folders)
        with shuffles_removed(rows.sparkSession):
            rows.write.partitionBy("period", "bucket").parquet(f"{self.path}/{name}")

    def _drop(self, batches: Sequence[str]) -> None:
        for batch in batches:
            fs, path = self._fs(f"changes/batch={batch}")
            fs.delete(path, True)

    @staticmethod
    def _bucket(placement_id: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(placement_id), F.lit(buckets)).cast("int")


def _typed(schema: T.StructType) -> list[Column]:
    return [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
