"""Live collection: parse, sample by the second, number sessions, save by day."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidebook.operators import ordered
from tidebook.operators.sessions import MAX_GAP_SECONDS
from tidebook.schema import LEVELS
from tidebook.sources import versions
from tidebook.sources.messages import parse_messages

from . import sampler


def read_folder(spark: SparkSession, path: str, files_per_trigger: int = 1, clean: bool = False) -> DataFrame:
    """Messages from segments of JSON lines ``{"received": ..., "message": ...}``
    (see :func:`tidebook.sources.websocket.record`): ``value`` and ``timestamp``.
    Which segments a batch has is in the stream's checkpoint, so a restart loses
    and repeats nothing; ``clean`` removes a segment when its batch is done."""
    lines = spark.readStream.schema("received timestamp, message string").option("maxFilesPerTrigger", files_per_trigger)
    if clean:
        lines = lines.option("cleanSource", "delete")
    return lines.json(path).select(F.col("message").alias("value"), F.col("received").alias("timestamp"))


def sample_seconds(rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The latest row of each second and symbol."""
    latest = Window.partitionBy("symbol", "timestamp").orderBy(*(F.col(c).desc() for c in order or ["event_time"]))
    return rows.withColumn("sample_rank", F.row_number().over(latest)).where("sample_rank = 1").drop("sample_rank")


def carry_forward(rows: DataFrame, most_seconds: int | None = None, bucket_us: int = ordered.BUCKET) -> DataFrame:
    """Sampled rows, each repeated in the quiet seconds after it: a sampler that
    does not clear its last message emits it again.  With ``most_seconds`` a
    longer silence counts as a lost connection, after which nothing is held.
    A symbol's timeline is walked in buckets, not in one task."""
    own = ordered.with_bucket(rows, F.unix_micros("timestamp"), bucket_us, "carry_bucket").withColumn("second", F.unix_seconds("timestamp"))
    later = Window.partitionBy("symbol", "carry_bucket").orderBy("second")
    firsts = own.groupBy("symbol", "carry_bucket").agg(F.min("second").alias("opens"))
    firsts = firsts.withColumn("next_opens", F.lead("opens").over(Window.partitionBy("symbol").orderBy("carry_bucket"))).drop("opens")
    own = own.withColumn("next_second", F.lead("second").over(later)).join(firsts, ["symbol", "carry_bucket"])
    ahead = F.coalesce("next_second", "next_opens") - F.col("second")
    repeats = F.when((ahead >= 2) & (ahead <= most_seconds if most_seconds is not None else F.lit(True)), ahead - 1).otherwise(0)
    held = own.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), repeats)))
    return held.withColumn("timestamp", F.timestamp_seconds(F.col("second") + F.col("step"))).select(*rows.columns)


def assign_sessions(rows: DataFrame, session: int = 1, last: dt.datetime | None = None, max_gap_seconds: float = MAX_GAP_SECONDS) -> DataFrame:
    """Sessions that go on from the saved (session, time): one more after every
    gap, the gap to the saved time included."""
    timed = rows.withColumn("own_us", F.unix_micros("timestamp"))
    limit = int(max_gap_seconds * 1_000_000)
    timed = ordered.gap_runs(timed, "own_us", limit, run="breaks")
    first = timed.agg(F.min("own_us")).head()[0] if last else None
    saved = int(last.replace(tzinfo=last.tzinfo or dt.UTC).timestamp() * 1_000_000) if last else None
    opening = int(first is not None and first - saved > limit)
    return timed.withColumn("session_id", (F.col("breaks") + session + opening).cast("long")).drop("own_us", "before_us", "breaks")


@dataclass
class Saver:
    """Saves batches of sampled rows as versions of the table.  ``left`` counts
    the samples still to take, and ``done`` is set when there are none."""

    path: str
    writer: str
    left: int | None = None

    @property
    def done(self) -> bool:
        return self.left is not None and self.left <= 0

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.done:
            return
        rows, taken = batch.persist(StorageLevel.DISK_ONLY), 0
        if self.left is not None:
            rows = rows.orderBy("timestamp", "symbol").limit(self.left)
            taken = rows.count()
        versions.upsert(rows, self.path, writer=self.writer, batch_id=batch_id)
        batch.unpersist()
        if self.left is not None:  # last, as the stream may be stopped for it
            self.left -= taken


def collect(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    symbol: str | None = None,
    exchange: str = "simulated",
    levels: int = LEVELS,
    carry_seconds: int | None = None,
    every_seconds: float = 60,
    once: bool = False,
    max_gap_seconds: float = MAX_GAP_SECONDS,
    limit_samples: int | None = None,
    live: bool = False,
) -> tuple[StreamingQuery, Saver]:
    """Start saving a stream of ``value, timestamp`` messages into a table of
    versions by day (:mod:`tidebook.sources.versions`).

    Sampling and sessions are a stateful operator (:mod:`.sampler`): quiet
    seconds repeat the last message, also across batches, until a message says
    that the connection was made anew; with ``carry_seconds`` only in silences of
    at most so many seconds (1: never).  ``live`` fills a silence while it lasts.
    ``once`` takes what is there and ends.  ``limit_samples`` bounds the rows
    sampled (see :func:`wait`).  A new checkpoint goes on from the sessions of
    the table; a batch that runs again is void.
    """
    spark = messages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    parsed = parse_messages(messages, exchange=exchange, symbol=symbol, levels=levels, markers=True)
    rows = sampler.sampled(parsed, versions.current(spark, path).last, levels, carry_seconds, max_gap_seconds, live)
    saver = Saver(path, checkpoint, limit_samples)
    writer = rows.writeStream.foreachBatch(saver).outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{every_seconds} seconds")
    return writer.start(), saver


def wait(query: StreamingQuery, saver: Saver, poll_seconds: float = 1.0) -> None:
    """Until the stream ends, or its samples are taken and it is stopped."""
    while not query.awaitTermination(poll_seconds):
        if saver.done:
            query.stop()


def windowed_last(messages: DataFrame, watermark: str = "10 seconds", **options) -> DataFrame:
    """A purely event-time form: the latest row of each second as a streaming
    aggregation, finished when the watermark passes."""
    parsed = parse_messages(messages, **options).withWatermark("timestamp", watermark)
    names = [c for c in parsed.columns if c not in ("timestamp", "symbol")]
    grouped = parsed.groupBy(F.window("timestamp", "1 second"), "symbol").agg(F.max_by(F.struct(*names), "event_time").alias("r"))
    return grouped.select(F.col("window.start").alias("timestamp"), "symbol", "r.*")
