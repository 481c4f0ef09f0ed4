"""Observation streams: keyed change detection, weekly windows, short-lived duplicates, guards.

What a stream knows of a key is keyed state on the RocksDB store: a micro-batch reads and writes the state of its own keys and
of no other.  The rows of a key in one micro-batch are ordered in memory, so the trigger (``per_trigger`` files) bounds them.
Every write of a micro-batch goes to its own ``batch=N`` folder and is overwritten on a retry, so a replayed batch changes
nothing.  Jobs run to the end of the available input and go on from their checkpoint when more has arrived.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..functions import calendar as cal
from ..session import shared_folder

LOCAL_TTL_MINUTES = 30
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_files(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", per_trigger: int | None = 1) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    return (reader if per_trigger is None else reader.option("maxFilesPerTrigger", per_trigger)).parquet(folder)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def use_keyed_state(spark: SparkSession) -> None:
    """Keyed processors need the RocksDB store; it is fixed in a query's checkpoint when the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _in_order(rows: Iterator[Row], order: Sequence[str]) -> list[Row]:
    """Rows along their order columns, nulls first."""
    return sorted(rows, key=lambda row: [(row[c] is not None, row[c]) for c in order])


class Follow(StatefulProcessor):
    """Gives every row the values of its predecessor of the same key; state ``last`` holds the last row of each key."""

    def __init__(self, order: Sequence[str], values: Sequence[str], state: StructType, result: StructType):
        self.order, self.values, self.state, self.names = tuple(order), tuple(values), state, tuple(result.names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.state)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.last.get() if self.last.exists() else None
        place = None if known is None else [(v is not None, v) for v in known[: len(self.order)]]
        previous = None if known is None else tuple(known[len(self.order) :])
        nothing, named = (None,) * len(self.values), Row(*self.names)
        newest = None
        for row in _in_order(rows, self.order):
            at, values = tuple(row[c] for c in self.order), tuple(row[c] for c in self.values)
            late = place is not None and [(v is not None, v) for v in at] <= place
            yield named(*key, *at, *values, *(nothing if late or previous is None else previous), not late and previous is not None, late)
            if not late:
                previous, newest = values, (*at, *values)
        if newest is not None:
            self.last.update(newest)

    def close(self) -> None:
        pass


def follow(stream: DataFrame, root: str, keys: Sequence[str], order: Sequence[str], values: Sequence[str],
           out: str, emit: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Store what ``emit`` keeps of the rows with their ``previous`` values under ``root/out``.

    Rows of one micro-batch are ordered among each other.  Rows no newer than their key's last row of an earlier micro-batch
    arrive too late to be ordered and go to ``root/late``.
    """
    use_keyed_state(stream.sparkSession)
    types = {f.name: f for f in stream.schema.fields}
    named = lambda names: StructType([StructField(n, types[n].dataType) for n in names])
    before = [StructField(f"__previous_{n}", types[n].dataType) for n in values]
    result = StructType([*named([*keys, *order, *values]).fields, *before, StructField("__known", BooleanType()), StructField("late", BooleanType())])
    lean = stream.select(*keys, *order, *values)
    followed = lean.groupBy(*keys).transformWithState(Follow(order, values, named([*order, *values]), result), result, "Update", "None")

    def store(batch: DataFrame, batch_id: int) -> None:
        previous = F.when(F.col("__known"), F.struct(*[F.col(f"__previous_{n}").alias(n) for n in values])).alias("previous")
        rows = batch.select(*keys, *order, *values, previous, "late").persist()
        rows.filter("late").drop("late", "previous").write.mode("overwrite").parquet(f"{root}/late/batch={batch_id}")
        emit(rows.filter("NOT late").drop("late")).write.mode("overwrite").parquet(f"{root}/{out}/batch={batch_id}")
        rows.unpersist()

    return followed.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def current_state(spark: SparkSession, root: str) -> DataFrame:
    """The last known row of every key as of the last finished micro-batch, read from the state store of a ``follow`` job."""
    rows = spark.read.format("statestore").option("path", f"{root}/checkpoint").option("stateVarName", "last").load()
    return rows.select("key.*", "value.*")


def price_changes(stream: DataFrame, root: str, keys: Sequence[str], order: Sequence[str], price: Sequence[str]) -> StreamingQuery:
    """Current state (``current_state``) and change-only history (``root/history``) of an observation stream; a first sighting is a change."""
    return follow(stream, root, keys, order, price, "history", lambda rows: rows.filter(~F.col("previous").eqNullSafe(F.struct(*price))))


def confirmed_misses(stream: DataFrame, root: str, keys: Sequence[str], order: Sequence[str]) -> StreamingQuery:
    """Reads (keys, order, seen): a miss right after a miss of the same key is a confirmed disappearance."""
    twice = ~F.col("seen") & F.coalesce(~F.col("previous.seen"), F.lit(False))
    return follow(stream, root, keys, order, ["seen"], "confirmed", lambda rows: rows.filter(twice).drop("previous"))


def weekly_counts(stream: DataFrame, ts: str, keys: Sequence[str], lateness: str = "1 day") -> DataFrame:
    """Tumbling local calendar weeks.  The week end follows daylight saving, which a fixed window cannot.

    A week is closed, and rows for it are refused, once a row has come whose own week ends more than ``lateness`` later.
    """
    ends = stream.withColumn("week_end", cal.week_end(F.col(ts))).withColumn("__end", F.col("week_end").cast("timestamp"))
    counts = ends.withWatermark("__end", lateness).groupBy("__end", "week_end", *keys).agg(F.count(F.lit(1)).alias("observations"))
    return counts.drop("__end")


def write_weeks(counts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Changed counts land in the folder of their week, a file set per micro-batch; a closed week is never written again."""
    def store(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("week", F.date_format("week_end", "yyyy-MM-dd")).withColumn("batch", F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week", "batch").parquet(out)

    return counts.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_weeks(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """The latest count of every week and key."""
    rows = spark.read.parquet(out)
    return rows.groupBy("week_end", *keys).agg(F.max_by("observations", "batch").alias("observations"))


class Usable(StatefulProcessor):
    """Keeps a row unless an earlier kept one of its key is younger than the limit; a timer forgets keys whose row has expired.

    ``micros`` is the time in microseconds, which a row and the state hold alike.
    """

    def __init__(self, micros: str, order: Sequence[str], minutes: int):
        self.micros, self.order, self.limit = micros, (micros, *order), minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.kept.get()[0] if self.kept.exists() else None
        at = before
        for row in _in_order(rows, self.order):
            if at is None or row[self.micros] >= at + self.limit:
                at = row[self.micros]
                yield row
        if at != before:
            if before is not None:
                self.handle.deleteTimer(self._expiry(before))
            self.handle.registerTimer(self._expiry(at))
            self.kept.update((at,))

    def _expiry(self, at: int) -> int:
        """Milliseconds from which the row is no longer usable, rounded up."""
        return -(-(at + self.limit) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def drop_repeats(stream: DataFrame, ts: str, keys: Sequence[str], order: Sequence[str] = (), minutes: int = LOCAL_TTL_MINUTES, lateness: str = "10 minutes") -> DataFrame:
    """One observation per key while an earlier kept one is younger than ``minutes``; ``ts`` is a TIMESTAMP, ``order`` breaks its ties.

    Rows that arrive more than ``lateness`` behind the newest one are refused.
    """
    use_keyed_state(stream.sparkSession)
    marked = stream.filter(F.col(ts).isNotNull()).withWatermark(ts, lateness).withColumn("__micros", F.unix_micros(ts))
    result = StructType([*stream.schema.fields, StructField("__micros", LongType())])
    return marked.groupBy(*keys).transformWithState(Usable("__micros", order, minutes), result, "Append", "EventTime").drop("__micros")


def write_table(stream: DataFrame, out: str, checkpoint: str, by: Sequence[str] = ()) -> StreamingQuery:
    """Appended results land per micro-batch, in folders ``by`` the given columns inside it."""
    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy(*by).parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.outputMode("append").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def verdict(ts: Column, now: Column) -> Column:
    """accepted / future (more than a minute ahead) / previous_week."""
    return F.when(cal.utc(ts) > cal.tolerated(now), "future").when(cal.week_end(ts) <= cal.utc(now), "previous_week").otherwise("accepted")


def guard(stream: DataFrame, ts: str, now: Column) -> DataFrame:
    """Every row with its verdict; written ``by`` verdict, rows that are not accepted lie in folders of their own."""
    return stream.withColumn("verdict", verdict(F.col(ts), now))
