"""Streaming queries over the event files; each runs to the end of the available input."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..streaming import jobs
from . import mapping as m
from .quotes import NOW, now
from .registry import Tables, query


DELIVERIES = 3


def _cuts(t: Tables) -> list:
    """Times that cut the events into ``DELIVERIES`` spans of equal length."""
    low, high = t.events.agg(F.min("ts"), F.max("ts")).first()
    return [] if low is None else [low + (high - low) * k / DELIVERIES for k in range(1, DELIVERIES)]


def _deliveries(t: Tables) -> list[DataFrame]:
    """The events as they would arrive: one span of time after the other."""
    cuts = [None, *_cuts(t), None]
    spans = []
    for low, high in zip(cuts, cuts[1:]):
        rows = t.events
        rows = rows if low is None else rows.filter(F.col("ts") >= F.lit(low).cast("timestamp_ntz"))
        spans.append(rows if high is None else rows.filter(F.col("ts") < F.lit(high).cast("timestamp_ntz")))
    return spans


def _deliver(t: Tables, spans: list[DataFrame], root: str, start) -> None:
    """After each delivery the job runs to its end and stops; its state waits in the checkpoint."""
    for rows in spans:
        rows.write.mode("append").parquet(f"{root}/in")
        _drain(start(jobs.read_files(t.spark, f"{root}/in", t.events.schema, per_trigger=None)))


def _drain(query_) -> None:
    query_.awaitTermination()
    if query_.exception():
        raise query_.exception()


_LAG = "WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)"


@query("stream_price_changes", f"""
SELECT user_id, event_type, event_id, price, previous_price FROM (SELECT *, CAST(floor(value / 10) AS BIGINT) AS price, lag(CAST(floor(value / 10) AS BIGINT)) OVER w AS previous_price, row_number() OVER w AS n FROM events {_LAG})
WHERE n = 1 OR price <> previous_price""")
def stream_price_changes(t: Tables):
    root = jobs.new_folder(t.spark)
    _deliver(t, _deliveries(t), root, lambda rows: _prices(rows, root))
    out = t.spark.read.parquet(f"{root}/history")
    return out.select("user_id", "event_type", "event_id", "price", F.col("previous.price").alias("previous_price"))


def _prices(rows: DataFrame, root: str):
    seen = rows.select("user_id", "event_type", "ts", "event_id", F.floor(F.col("value") / 10).alias("price"))
    return jobs.price_changes(seen, root, ["user_id", "event_type"], ["ts", "event_id"], ["price"])


@query("stream_current_state", """
SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(CAST(floor(value / 10) AS BIGINT), (ts, event_id)) AS price FROM events GROUP BY ALL""")
def stream_current_state(t: Tables):
    root = jobs.new_folder(t.spark)
    _deliver(t, _deliveries(t), root, lambda rows: _prices(rows, root))
    return jobs.current_state(t.spark, root).select("user_id", "event_type", "event_id", "price")


@query("stream_confirmed_misses", """
SELECT user_id, event_id FROM (SELECT *, event_type <> 'error' AND event_type <> 'click' AS seen, lag(event_type <> 'error' AND event_type <> 'click') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE NOT seen AND NOT before""")
def stream_confirmed_misses(t: Tables):
    root = jobs.new_folder(t.spark)

    def start(rows: DataFrame):
        seen = rows.select("user_id", "ts", "event_id", (~F.col("event_type").isin("error", "click")).alias("seen"))
        return jobs.confirmed_misses(seen, root, ["user_id"], ["ts", "event_id"])

    _deliver(t, _deliveries(t), root, start)
    return t.spark.read.parquet(f"{root}/confirmed").select("user_id", "event_id")


@query("stream_week_window", f"""
SELECT {m.sql_stamp(m.sql_week_end('ts'))} AS week_end, event_type, count(*) AS observations FROM events GROUP BY ALL""")
def stream_week_window(t: Tables):
    """The first delivery comes a second time at the end: its weeks are closed by then, so its rows are refused."""
    root, spans = jobs.new_folder(t.spark), _deliveries(t)

    def start(rows: DataFrame):
        return jobs.write_weeks(jobs.weekly_counts(rows, "ts", ["event_type"]), f"{root}/weeks", f"{root}/checkpoint")

    _deliver(t, [*spans, spans[0]], root, start)
    return jobs.read_weeks(t.spark, f"{root}/weeks", ["event_type"]).select(m.stamp(F.col("week_end")).alias("week_end"), "event_type", "observations")


@query("stream_dedupe_ttl", """
WITH RECURSIVE kept AS (
  SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
  UNION ALL SELECT k.user_id, min(e.ts) FROM kept k JOIN events e ON e.user_id = k.user_id AND e.ts >= k.ts + INTERVAL 30 MINUTE GROUP BY k.user_id, k.ts)
SELECT k.user_id, min(e.event_id) AS event_id FROM kept k JOIN events e ON e.user_id = k.user_id AND e.ts = k.ts GROUP BY k.user_id, k.ts""")
def stream_dedupe_ttl(t: Tables):
    root = jobs.new_folder(t.spark)

    def start(rows: DataFrame):
        seen = rows.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
        return jobs.write_table(jobs.drop_repeats(seen, "ts", ["user_id"], ["event_id"]), f"{root}/kept", f"{root}/checkpoint")

    _deliver(t, _deliveries(t), root, start)
    return t.spark.read.parquet(f"{root}/kept").select("user_id", "event_id")


@query("stream_guard", f"""
SELECT event_id, CASE WHEN ts > TIMESTAMP '{NOW}' + INTERVAL 60 SECOND THEN 'future' WHEN {m.sql_week_end('ts')} <= TIMESTAMP '{NOW}' THEN 'previous_week' ELSE 'accepted' END AS verdict FROM events""")
def stream_guard(t: Tables):
    root = jobs.new_folder(t.spark)
    rows = jobs.read_files(t.spark, t.folder, t.events.schema, "events.parquet").select("event_id", "ts")
    _drain(jobs.write_table(jobs.guard(rows, "ts", now()), f"{root}/guarded", f"{root}/checkpoint", ["verdict"]))
    return t.spark.read.parquet(f"{root}/guarded").select("event_id", "verdict")
