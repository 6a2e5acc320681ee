"""Streams: file and Kafka sources, windows with watermarks, and micro-batches into versioned tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import StopStream
from ..operators import loaders
from ..operators.scd import deduplicated
from ..sources.table import VersionedTable


def files(spark: SparkSession, form: str, path: str, schema, files_per_batch: int = 1000, **options) -> DataFrame:
    """New files of a folder; the checkpoint knows which have been read."""
    return spark.readStream.format(form).schema(schema).options(maxFilesPerTrigger=files_per_batch, **options).load(path)


def kafka(spark: SparkSession, brokers: str, topic: str, schema: str, start: str = "earliest", **options) -> DataFrame:
    """JSON messages as rows (needs the connector's package)."""
    r = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": brokers, "subscribe": topic, "startingOffsets": start, **options})
    return r.load().select(F.from_json(F.col("value").cast("string"), schema).alias("v")).select("v.*")


@dataclass
class StreamResult:
    """What the batches of a stream came to; ``errors`` has the messages of failed ones."""

    batches: int = 0
    rows: int = 0
    skipped: int = 0
    failed: int = 0
    errors: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.failed


#: A change of a table by a batch's rows and change id.
Change = Callable[[VersionedTable, DataFrame, str], object]


def into_table(
    stream: DataFrame,
    table: VersionedTable,
    change: Change,
    checkpoint: str,
    name: str = "stream",
    keys: list[str] | None = None,
    deduplicate_by: str | None = None,
    on_batch: Callable[[int, int], None] | None = None,
    available_now: bool = True,
    max_batches: int | None = None,
    skip_failures: bool = False,
) -> tuple[StreamingQuery, StreamResult]:
    """Each micro-batch is one change of the table, ``change(table, rows, change id)``.

    The change id is the stream's name and batch number, so a batch that is run again
    after a failure changes nothing twice.  A failing batch fails the query, which
    repeats it when it starts again from its checkpoint; with ``skip_failures`` it is
    counted and left out.  ``on_batch`` gets the batch's number and rows.  After
    ``max_batches`` batches the query stops with an error of its own, before the next
    one changes anything; it goes on from there when it is started again.
    """
    seen = StreamResult()

    def each(rows: DataFrame, batch: int) -> None:
        if max_batches is not None and seen.batches >= max_batches:
            raise StopStream(f"{max_batches} batches are done")
        rows = rows.persist()
        try:
            n = rows.count()
            if not n:
                seen.skipped += 1
                return
            try:
                change(table, deduplicated(rows, keys, deduplicate_by) if deduplicate_by else rows, f"{name}-{batch}")
            except Exception as e:
                seen.failed += 1
                seen.errors.append(f"batch {batch}: {e}"[:1000])
                if not skip_failures:
                    raise
                return
            seen.batches += 1
            seen.rows += n
        finally:
            rows.unpersist()
        if on_batch:
            on_batch(batch, n)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if available_now else writer).start(), seen


def dimension(stream: DataFrame, table: VersionedTable, kind: int | str, nk: list[str], tracked, as_of: Callable[[], str], checkpoint: str, scd: dict | None = None, **options) -> tuple[StreamingQuery, StreamResult]:
    """A slowly changing dimension of type 1, 2, 3, 6 or "metadata", a batch at a time; ``as_of()`` gives each batch's time."""
    return into_table(stream, table, lambda t, rows, change: t.scd(kind, rows, nk, tracked, as_of(), change, **(scd or {})), checkpoint, keys=nk, **options)


def transactions(stream: DataFrame, table: VersionedTable, checkpoint: str, **options) -> tuple[StreamingQuery, StreamResult]:
    """Appends every batch."""
    return into_table(stream, table, lambda t, rows, change: t.write(rows, change), checkpoint, **options)


def snapshots(stream: DataFrame, table: VersionedTable, date: Callable[[], str], checkpoint: str, column: str = "snapshot_date", **options) -> tuple[StreamingQuery, StreamResult]:
    """Appends every batch with the date of its snapshot."""
    return into_table(stream, table, lambda t, rows, change: t.write(loaders.with_snapshot_date(rows, date(), column), change), checkpoint, **options)


@dataclass(frozen=True)
class Member:
    """A fact's reference: its key column, the dimension, and the dimension's key and surrogate-key columns."""

    fact_key: str
    dimension: VersionedTable
    dim_key: str
    sk: str = "id"
    name: str = ""


def facts(stream: DataFrame, table: VersionedTable, members: list[Member], as_of: Callable[[], str], checkpoint: str, **options) -> tuple[StreamingQuery, StreamResult]:
    """Appends facts with surrogate keys; keys that a dimension lacks become inferred members of it first."""

    def load(t: VersionedTable, rows: DataFrame, change: str) -> None:
        for m in members:
            known = m.dimension.read()
            missing = rows.select(m.fact_key).filter(F.col(m.fact_key).isNotNull()).join(known.select(F.col(m.dim_key).alias(m.fact_key)), m.fact_key, "left_anti")
            if not missing.isEmpty():
                m.dimension.overwrite(loaders.infer_members(rows, known, m.fact_key, m.dim_key, m.sk, as_of()), f"{m.fact_key}-inferred-{change}")
            rows = loaders.resolve(rows, m.dimension.read(), [(m.fact_key, m.dim_key)], m.sk, m.name or f"{m.fact_key}_sk")
        t.write(rows, change)

    return into_table(stream, table, load, checkpoint, **options)


def windowed(events: DataFrame, time: str, window: str, *aggregates: Column, slide: str | None = None, by: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    """(*by, start, end, aggregates) of tumbling or sliding windows; events later than ``late`` are dropped from streams."""
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(*by, F.window(time, window, slide).alias("_w")).agg(*aggregates).select("*", "_w.start", "_w.end").drop("_w")


def sessions(events: DataFrame, time: str, gap: str, *aggregates: Column, by: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    """(*by, start, end, aggregates) of runs of events less than ``gap`` apart."""
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(*by, F.session_window(time, gap).alias("_w")).agg(*aggregates).select("*", "_w.start", "_w.end").drop("_w")
