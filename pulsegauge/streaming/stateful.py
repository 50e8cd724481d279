"""Keyed stateful operators: sliding-window scores per metric, and the alert limiter.

State keeps the events a window can still need, as packed chunks in a map: an update writes the
new chunk and removes the expired ones, and does not rewrite the rest. However many rows of a metric a
micro-batch brings, a task holds a stretch of them: input is taken one Arrow batch at a time, rows that
wait for the watermark are kept and scored by slices of time, and rows in order of arrival are sorted in
runs and merged. The window survives a restart because it is part of the checkpoint.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pulsegauge.functions.ranges import range_moments
from pulsegauge.operators.percentiles import select_kth

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCORED_SCHEMA = (
    "metric string, event_id string, event_us bigint, event_ts timestamp, value double, meta_json string, "
    "window_count bigint, mean double, variance double, stddev double, lower_bound double, upper_bound double"
)
PAYLOAD = ("event_us", "value", "event_id", "meta_json")
PACK_ROWS = 50_000  # rows that are divided into slices and put into state at once
RUN_ROWS = 200_000  # rows that are sorted at once in arrival order
PIECE_ROWS = 5_000  # rows of a sorted run that are read at once


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB state store; set it unless the session has."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, STATE_STORE)


def _pack(rows: pd.DataFrame) -> bytes:
    """Rows as one Arrow stream, so that state holds a value per batch and not per event."""
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(packed).read_pandas()


def _unpack_numbers(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times and values only."""
    table = pa.ipc.open_stream(packed).read_all()
    return table["event_us"].to_numpy(), table["value"].to_numpy().astype(float)


def _gathered(batches: Iterator[pd.DataFrame], columns: list[str], least: int) -> Iterator[pd.DataFrame]:
    """The rows of batches in frames of at least ``least`` rows, but for the last."""
    held, size = [], 0
    for batch in batches:
        held.append(batch[columns])
        size += len(batch)
        if size >= least:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


class _Window(StatefulProcessor):
    """Shared parts: chunk storage, statistics of index ranges and the scored rows."""

    def __init__(self, window_us: int, percentiles: tuple[float, float] | None = None) -> None:
        self.window_us = window_us
        self.percentiles = percentiles

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chunks = handle.getMapState("chunks", "seq bigint", "times binary, numbers binary")

    def close(self) -> None:
        pass

    def load(self) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """Stored times and values in chunk order, with (chunk number, size) of each chunk."""
        found = sorted((key[0], bytes(v[0]), bytes(v[1])) for key, v in self.chunks.iterator())
        times = [np.frombuffer(t, dtype=np.int64) for _, t, _ in found]
        numbers = [np.frombuffer(n, dtype=np.float64) for _, _, n in found]
        sizes = [(seq, len(t)) for (seq, _, _), t in zip(found, times)]
        if not found:
            return np.empty(0, np.int64), np.empty(0), sizes
        return np.concatenate(times), np.concatenate(numbers), sizes

    def store(self, times: np.ndarray, numbers: np.ndarray, sizes: list[tuple[int, int]], dropped: int) -> None:
        """Keep a window of which ``dropped`` positions left: drop chunks wholly among them, add the new tail."""
        held = 0
        for seq, size in sizes:
            held += size
            if held <= dropped:
                self.chunks.removeKey((seq,))
        first_new = max(held - dropped, 0)
        if first_new < len(times):
            seq = sizes[-1][0] + 1 if sizes else 0
            self.chunks.updateValue((seq,), (times[first_new:].tobytes(), numbers[first_new:].tobytes()))

    def stats(self, numbers: np.ndarray, left: np.ndarray, right: np.ndarray) -> pd.DataFrame:
        n, mean, variance = range_moments(numbers, left, right)
        low = high = np.full(len(left), np.nan)
        if self.percentiles:
            lower, upper = self.percentiles
            ones = np.ones(len(numbers), dtype=np.int64)
            low = select_kth(numbers, ones, left, right, np.minimum(np.floor(n * lower / 100.0).astype(np.int64), n - 1))
            high = select_kth(numbers, ones, left, right, np.minimum(np.floor(n * upper / 100.0).astype(np.int64), n - 1))
        return pd.DataFrame(
            {"window_count": n, "mean": mean, "variance": variance, "stddev": np.sqrt(variance), "lower_bound": low, "upper_bound": high}
        )

    def scored(self, rows: pd.DataFrame, metric: str, stats: pd.DataFrame) -> pd.DataFrame:
        """Rows with the statistics of the same positions."""
        columns = {
            "metric": metric,
            "event_id": rows["event_id"].to_numpy(),
            "event_us": rows["event_us"].to_numpy(),
            "event_ts": pd.to_datetime(rows["event_us"].to_numpy(), unit="us"),
            "value": rows["value"].to_numpy(),
            "meta_json": rows["meta_json"].to_numpy(),
        }
        return pd.DataFrame({**columns, **{c: stats[c].to_numpy() for c in stats.columns}})


def _id_order(rows: pd.DataFrame) -> pd.Series:
    """Event ids for comparison; a missing one comes last, as in a sort."""
    return rows["event_id"].fillna("\U0010ffff")


def _in_arrival_order(batches: Iterator[pd.DataFrame], run_rows: int, piece_rows: int) -> Iterator[pd.DataFrame]:
    """The rows of all batches by arrival, time and id, in stretches, of which few are in memory.

    Runs of ``run_rows`` rows are sorted and, when there are several, kept in a file of the task. They are read
    back ``piece_rows`` at a time; rows up to the smallest last row of the pieces at hand are in their place.
    """
    order = ["arrival", "event_us", "event_id"]
    columns = ["arrival", *PAYLOAD]

    sorted_runs = (run.sort_values(order, kind="stable", ignore_index=True) for run in _gathered(batches, columns, run_rows))
    first, second = next(sorted_runs), next(sorted_runs, None)
    if second is None:
        yield first
        return
    kinds = pa.schema([("arrival", pa.int64()), ("event_us", pa.int64()), ("value", pa.float64()), ("event_id", pa.string()), ("meta_json", pa.string())])
    with tempfile.TemporaryFile() as file:
        todo, written = [], 0
        with pa.ipc.new_file(file, kinds, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
            while first is not None:
                writer.write_table(pa.Table.from_pandas(first, kinds, preserve_index=False), max_chunksize=piece_rows)
                pieces = -(-len(first) // piece_rows)
                todo.append(list(range(written, written + pieces)))
                written += pieces
                first, second = second, next(sorted_runs, None)
        file.seek(0)
        stored = pa.ipc.open_file(file)
        heads = [pd.DataFrame(columns=columns)] * len(todo)
        while True:
            heads = [stored.get_batch(left.pop(0)).to_pandas() if not len(h) and left else h for h, left in zip(heads, todo)]
            # a run that is not at its end may go on with rows after its last one here
            ends = [(h["arrival"].iat[-1], h["event_us"].iat[-1], _id_order(h).iat[-1]) for h, left in zip(heads, todo) if left]
            if not ends:
                rest = [h for h in heads if len(h)]
                if rest:
                    yield pd.concat(rest, ignore_index=True).sort_values(order, kind="stable", ignore_index=True)
                return
            arrival, us, event_id = min(ends)
            ready = []
            for i, h in enumerate(heads):
                if not len(h):
                    continue
                at, t = h["arrival"].to_numpy(), h["event_us"].to_numpy()
                same = (at == arrival) & (t == us)
                before = (at < arrival) | ((at == arrival) & (t < us)) | (same & (_id_order(h) <= event_id).to_numpy())
                ready.append(h[before])
                heads[i] = h[~before]
            yield pd.concat(ready, ignore_index=True).sort_values(order, kind="stable", ignore_index=True)


class ArrivalWindow(_Window):
    """Scores events as they come, those of one micro-batch in the order of ``arrival``.

    The window is what arrived and was not yet purged: purging stops at the first event that is
    still young enough, so a late event can outlive its time and is judged against newer ones.
    """

    run_rows, piece_rows = RUN_ROWS, PIECE_ROWS

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times, numbers, sizes = self.load()
        dropped = 0
        # rows of a key reach the task in the order of the shuffle, which says nothing about arrival
        for part in _in_arrival_order(rows, self.run_rows, self.piece_rows):
            old = len(times)
            times = np.concatenate((times, part["event_us"].to_numpy(np.int64)))
            numbers = np.concatenate((numbers, part["value"].to_numpy(float)))
            # the head moves to the first event at or after the largest cutoff seen so far
            newest = np.maximum.accumulate(times)
            head = np.searchsorted(newest, newest - self.window_us, side="left")
            right = np.arange(old, len(times)) + 1
            yield self.scored(part, key[0], self.stats(numbers, head[old:], right))
            keep_from = int(head[-1])
            times, numbers = times[keep_from:], numbers[keep_from:]
            dropped += keep_from
        self.store(times, numbers, sizes, dropped)


class EventTimeWindow(_Window):
    """Scores an event once the watermark has passed it, in time order.

    Equals the batch result over the events that were not dropped as late, up to the watermark.
    Events still ahead of the watermark wait in state by slices of two windows; one timer per metric wakes the earliest.
    """

    pack_rows = PACK_ROWS

    def __init__(self, window_us: int, percentiles: tuple[float, float] | None = None) -> None:
        super().__init__(window_us, percentiles)
        self.slice_us = 2 * window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.pending = handle.getMapState("pending", "slice bigint, seq bigint", "rows binary")
        self.next = handle.getValueState("next", "due_us bigint, seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due_us, seq = self.next.get() or (None, 0)
        for batch in _gathered(rows, list(PAYLOAD), self.pack_rows):
            first = int(batch["event_us"].min())
            due_us = first if due_us is None else min(due_us, first)
            for at, part in batch.groupby(batch["event_us"] // self.slice_us):
                self.pending.updateValue((int(at), seq), (_pack(part),))
            seq += 1
        yield from self.settle(key[0], timerValues, due_us, seq)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.settle(key[0], timerValues, *(self.next.get() or (None, 0)))

    def settle(self, metric: str, timerValues, due_us: int | None, seq: int) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        if due_us is not None and due_us <= passed:
            due_us = yield from self.score(metric, passed)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due_us is None:
            self.next.clear()
        else:
            self.next.update((due_us, seq))
            self.handle.registerTimer(-(-due_us // 1000))

    def score(self, metric: str, passed: int) -> Iterator[pd.DataFrame]:
        """Scored rows up to the watermark, slice by slice; returns the earliest time still ahead."""
        times, numbers, sizes = self.load()
        waiting: dict[int, list[int]] = {}
        for at, seq in self.pending.keys():
            waiting.setdefault(at, []).append(seq)
        dropped, ahead_us = 0, None
        for at in sorted(waiting):
            parts = [_unpack_numbers(self.pack_of(at, seq)) for seq in waiting[at]]
            us, values = (np.concatenate(c) for c in zip(*parts))
            due = us <= passed
            if not due.all():
                ahead_us = int(us[~due].min())
            if due.any():
                us, values = us[due], values[due]
                order = np.lexsort((values, us))
                times, numbers = np.concatenate((times, us[order])), np.concatenate((numbers, values[order]))
                instants = np.unique(us)
                left = np.searchsorted(times, instants - self.window_us, side="left")
                right = np.searchsorted(times, instants, side="right")
                stats = self.stats(numbers, left, right).set_index(instants)
                for seq in waiting[at]:
                    yield from self.take(metric, at, seq, passed, stats)
                keep_from = int(left[-1])
                times, numbers = times[keep_from:], numbers[keep_from:]
                dropped += keep_from
            if ahead_us is not None:
                break
        self.store(times, numbers, sizes, dropped)
        return ahead_us

    def pack_of(self, at: int, seq: int) -> bytes:
        return bytes(self.pending.getValue((at, seq))[0])

    def take(self, metric: str, at: int, seq: int, passed: int, stats: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """The due rows of one pack with their instants' statistics; the others go on waiting."""
        rows = _unpack(self.pack_of(at, seq))
        due = (rows["event_us"] <= passed).to_numpy()
        if not due.any():
            return
        now = rows[due].sort_values(["event_us", "event_id"])
        yield self.scored(now, metric, stats.loc[now["event_us"].to_numpy()])
        if due.all():
            self.pending.removeKey((at, seq))
        else:
            self.pending.updateValue((at, seq), (_pack(rows[~due]),))


def score_stream(
    events: DataFrame,
    window_us: int,
    mode: str = "event_time",
    delay: str = "10 minutes",
    percentiles: tuple[float, float] | None = None,
) -> DataFrame:
    """A stream of events to a stream of events with window statistics.

    ``mode`` is ``event_time`` (waits for the watermark, agrees with the batch operators) or
    ``arrival`` (scores at once, in the order of arrival: by micro-batch, inside one by ``row_num``, a
    Kafka offset or place in a file, and by event time for events that have none).
    """
    if mode not in ("event_time", "arrival"):
        raise ValueError(f"mode must be 'event_time' or 'arrival', got {mode!r}")
    arrival = F.coalesce("row_num", "event_us").alias("arrival")
    narrow = events.select("metric", "event_us", "event_ts", "value", "event_id", "meta_json", arrival)
    if mode == "event_time":
        keyed, processor, time_mode = narrow.withWatermark("event_ts", delay), EventTimeWindow(window_us, percentiles), "eventTime"
    else:
        keyed, processor, time_mode = narrow, ArrivalWindow(window_us, percentiles), "none"
    return keyed.groupBy("metric").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=SCORED_SCHEMA, outputMode="append", timeMode=time_mode
    )


class MinimumInterval(StatefulProcessor):
    """Passes an alert when enough time went by since the last one it passed."""

    def __init__(self, interval_us: int) -> None:
        self.interval_us = interval_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sent_us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "anomaly_id"])
        times = batch["at"].to_numpy(np.int64)
        held = self.last.get()
        free = np.iinfo(np.int64).min if held is None else held[0] + self.interval_us
        sent = np.zeros(len(times), dtype=bool)
        i = int(np.searchsorted(times, free, side="left"))
        while i < len(times):
            sent[i] = True
            self.last.update((int(times[i]),))
            i = int(np.searchsorted(times, times[i] + max(self.interval_us, 0), side="left")) if self.interval_us else i + 1
        yield pd.DataFrame({"anomaly_id": batch["anomaly_id"], "at": times, "sent": sent})

    def close(self) -> None:
        pass


def rate_limit_stream(alerts: DataFrame, interval_us: int, key: str | None = None) -> DataFrame:
    """Streaming limiter over ``anomaly_id, at``: alerts in, the same alerts with ``sent`` out.

    Within a micro-batch alerts are taken in time order. Only anomalies come this far, and the
    state of a limiter is one number.
    """
    limiter = F.lit("") if key is None else F.col(key).cast("string")
    return (
        alerts.select(limiter.alias("k"), "anomaly_id", "at")
        .groupBy("k")
        .transformWithStateInPandas(
            statefulProcessor=MinimumInterval(interval_us),
            outputStructType="anomaly_id string, at bigint, sent boolean",
            outputMode="append",
            timeMode="none",
        )
    )
