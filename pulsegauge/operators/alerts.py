"""Alert records: rate limit, messages, fan-out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegauge.config import DEFAULT_CHANNEL
from pulsegauge.functions import formatting as fmt
from pulsegauge.sources.sinks import stored

CHUNK_INTERVALS = 64
#: Chunks that one of the level above covers.
FAN_IN = 64


def _next_sendable(times: np.ndarray, interval: int) -> np.ndarray:
    """Index of the first alert that may follow each one; ``len(times)`` when none is left."""
    return np.searchsorted(times, times + interval, side="left")


def _transfer(interval: int):
    """What a chunk does to the last sent time, as a step function of the time it is entered with.

    The first alert sent in the chunk is the first one the incoming send time allows. That time lies
    before the chunk, so it blocks less than one interval from the chunk's first alert on, and only
    the alerts up to the first one beyond that can be entered at. From each of them the chain of
    sends is followed by repeated doubling; chains soon meet, so only a few different ends remain.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["at"].to_numpy())
        n = len(times)
        jump = np.append(_next_sendable(times, interval), n)
        last = np.arange(n + 1)
        # last[i]: final alert of the chain from i after 2^k steps; a step off the end stays put
        while True:
            target = jump[last]
            moved = target < n
            if not moved[:n].any():
                break
            last = np.where(moved, last[np.minimum(target, n)], last)
        entries = np.arange(min(n, int(jump[0]) + 1))
        ends = times[last[entries]]
        # keep the last entry of every run with the same end: entering at or before it gives that end
        keep = np.append(ends[1:] != ends[:-1], True)
        return pd.DataFrame(
            {
                "k": pdf["k"].iloc[0],
                "chunk": pdf["chunk"].iloc[0],
                "first": times[0],
                "entry_upto": times[entries][keep],
                "last_sent": ends[keep],
            }
        )

    return solve


def _compose(interval: int):
    """Consecutive chunks of a key as one: the step function of entering the first and leaving the last."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        first, upto, last = None, None, None
        for _, steps in pdf.sort_values(["chunk", "entry_upto"]).groupby("chunk"):
            next_upto, next_last = steps["entry_upto"].to_numpy(), steps["last_sent"].to_numpy()
            if first is None:
                first, upto, last = steps["first"].iloc[0], next_upto, next_last
                continue
            i = np.searchsorted(next_upto, last + interval, side="left")
            last = np.where(i < len(next_upto), next_last[np.minimum(i, len(next_upto) - 1)], last)
            if upto[-1] < first + interval:  # a later entry is possible only while all so far can be blocked
                upto, last = np.append(upto, next_upto), np.append(last, next_last)
        keep = np.append(last[1:] != last[:-1], True)
        return pd.DataFrame(
            {"k": pdf["k"].iloc[0], "chunk": pdf["above"].iloc[0], "first": first, "entry_upto": upto[keep], "last_sent": last[keep]}
        )

    return solve


def _entry_times(interval: int):
    """Walk the chunks below one of the level above and carry the last sent time from one to the next."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out, free_from = [], int(pdf["free_from"].iloc[0])
        for chunk, steps in pdf.sort_values(["chunk", "entry_upto"]).groupby("chunk"):
            upto = steps["entry_upto"].to_numpy()
            out.append((pdf["k"].iloc[0], chunk, free_from))
            # past the last entry means that every alert of the chunk is still blocked
            i = int(np.searchsorted(upto, free_from, side="left"))
            free_from = int(steps["last_sent"].iloc[i]) + interval if i < len(upto) else free_from
        return pd.DataFrame(out, columns=["k", "chunk", "free_from"])

    return solve


def _replay(interval: int):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        times = pdf["at"].to_numpy()
        jump = _next_sendable(times, interval)
        i = int(np.searchsorted(times, pdf["free_from"].iloc[0], side="left"))
        picked = []
        while i < len(times):
            picked.append(i)
            i = int(jump[i])
        return pdf.iloc[picked][["k", "at"]]

    return solve


def rate_limit(alerts: DataFrame, interval_us: int, at: str = "at", key: str | None = None, tie: str = "anomaly_id") -> DataFrame:
    """``alerts`` plus ``sent``: greedy minimum interval, one limiter per ``key`` (one for all without).

    An alert goes out when at least ``interval_us`` passed since the last one that went out; the
    first always does. Which alert is sent depends on all sends before it, yet no task walks the
    whole history: time is cut into chunks, each chunk is summed up as a step function from the
    incoming to the outgoing send time, and ``FAN_IN`` neighbours at a time are composed into chunks of
    the level above, up to one per key. On the way down each gives its parts the times they are entered
    with, and the chunks are then replayed in parallel. A group holds the steps of at most ``FAN_IN`` chunks.
    """
    if interval_us < 0:
        raise ValueError("interval must not be negative")
    if interval_us == 0:
        return alerts.withColumn("sent", F.lit(True))
    keyed = alerts.withColumn("k", F.lit("") if key is None else F.col(key).cast("string"))
    # of alerts at one instant only the first can be sent
    times = stored(keyed.groupBy("k", F.col(at).alias("at")).agg(F.min(tie).alias("first_tie")), "alert-times")
    span = times.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    width, lo = CHUNK_INTERVALS * interval_us, span["lo"] or 0
    chunked = times.select("k", "at", F.expr(f"(at - {lo}L) div {width}L").alias("chunk"))
    layout = "k string, chunk bigint, first bigint, entry_upto bigint, last_sent bigint"
    levels = [stored(chunked.groupBy("k", "chunk").applyInPandas(_transfer(interval_us), layout), "alert-steps")]
    chunks = ((span["hi"] or 0) - lo) // width + 1
    above = F.expr(f"chunk div {FAN_IN}").alias("above")
    while chunks > 1:
        composed = levels[-1].select("*", above).groupBy("k", "above").applyInPandas(_compose(interval_us), layout)
        levels.append(stored(composed, "alert-steps"))
        chunks = -(-chunks // FAN_IN)
    nothing_sent = F.lit(-(1 << 62)).cast("bigint").alias("free_from")
    entries = levels.pop().select("k", "chunk", nothing_sent).distinct()
    while levels:
        below = levels.pop().select("*", above).join(entries.toDF("k", "above", "free_from"), ["k", "above"])
        entries = below.groupBy("k", "above").applyInPandas(_entry_times(interval_us), "k string, chunk bigint, free_from bigint")
    sent = (
        chunked.join(entries, ["k", "chunk"])
        .groupBy("k", "chunk")
        .applyInPandas(_replay(interval_us), "k string, at bigint")
    )
    chosen = times.join(sent, ["k", "at"]).select("k", F.col("at").alias(at), F.col("first_tie").alias(tie), F.lit(True).alias("sent"))
    return keyed.join(chosen, ["k", at, tie], "left").fillna(False, ["sent"]).drop("k").select(*alerts.columns, "sent")


def alert_text(anomalies: DataFrame) -> DataFrame:
    return anomalies.select("anomaly_id", fmt.alert_subject().alias("subject"), fmt.alert_body().alias("body"))


def alert_details(anomalies: DataFrame) -> DataFrame:
    """The figures of a detailed alert: event time, values with two decimals, deviation with its σ label."""
    return anomalies.select(
        "anomaly_id",
        F.concat(F.lit("Anomaly Detected: "), "metric").alias("subject"),
        fmt.event_time_label().alias("detected"),
        fmt.two_decimals("value").alias("observed"),
        fmt.two_decimals("z_score").alias("z"),
        fmt.two_decimals("mean").alias("historical_mean"),
        fmt.two_decimals("stddev").alias("standard_deviation"),
        fmt.deviation().alias("deviation"),
        fmt.deviation_label().alias("deviation_label"),
    )


def display_rows(anomalies: DataFrame) -> DataFrame:
    """Screen texts: two decimals, ``N/A`` for a missing number, ``Unknown`` for a missing name."""
    return anomalies.select(
        "anomaly_id",
        fmt.display_name("metric").alias("metric_text"),
        *[fmt.display_number(c).alias(f"{c}_text") for c in ("value", "mean", "stddev", "z_score")],
    )


def fan_out(alerts: DataFrame, addresses: str) -> DataFrame:
    """One row per alert and recipient of a comma-separated address list."""
    return alerts.withColumn("recipient", F.explode(fmt.recipients(F.lit(addresses))))


def channel_messages(anomalies: DataFrame, channel: str = DEFAULT_CHANNEL) -> DataFrame:
    """One JSON message per anomaly for a named channel, with the record id as message key."""
    body = F.to_json(F.struct(*[c for c in anomalies.columns if c != "sent"]))
    return anomalies.select(F.lit(channel).alias("channel"), F.col("anomaly_id").alias("key"), body.alias("value"))


def alert_log(limited: DataFrame, publish: bool = True, email: bool = True) -> DataFrame:
    """Outcome per alert: published to the channel, mailed when the limiter let it pass."""
    published, emailed = F.lit(publish), F.col("sent") if email else F.lit(False)
    return limited.select(
        "anomaly_id",
        published.alias("published"),
        emailed.alias("emailed"),
        F.lit(0).alias("errors"),
        (published | emailed).alias("success"),
    )
