"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegauge.llm.tokens import encoder
from pulsegauge.sources.sinks import stored

#: Pieces of a shard, on average; a shard is packed by one ring of islands.
SHARD = 2000
ISLANDS = 2
EPOCHS = 2
#: Bins filled less than this are dealt out again, so many times in all.
LOOSE, ROUNDS = 0.97, 3
POPULATION = 4
CHILDREN = 6
#: A bin this full is passed on whole by a crossover.
WELL_FILLED = 0.98


class Bins:
    """Open bins of one solution, found by free space: bit s of a mask says that a bin has s free."""

    def __init__(self, capacity: int):
        self.items: list[list[int]] = []
        self._mask, self._by_space = 0, [[] for _ in range(capacity + 1)]
        self._capacity = capacity

    def add_bin(self, items: list[int], fill: int) -> None:
        self._put(len(self.items), self._capacity - fill)
        self.items.append(items)

    def _put(self, number: int, space: int) -> None:
        self._by_space[space].append(number)
        self._mask |= 1 << space

    def best_fit(self, item: int, length: int) -> None:
        """Put an item where the least space is left over, or into a new bin."""
        fitting = self._mask >> length
        if not fitting:
            self.add_bin([item], length)
            return
        space = length + (fitting & -fitting).bit_length() - 1
        numbers = self._by_space[space]
        number = numbers.pop()
        if not numbers:
            self._mask ^= 1 << space
        self.items[number].append(item)
        self._put(number, space - length)


def _filled(order, lengths: list[int], capacity: int, start: list[tuple[list[int], int]] = ()) -> list[list[int]]:
    bins = Bins(capacity)
    for items, fill in start:
        bins.add_bin(list(items), fill)
    for item in order:
        bins.best_fit(item, lengths[item])
    return bins.items


def crossover(a: list[list[int]], b: list[list[int]], lengths: list[int], capacity: int, rng) -> list[list[int]]:
    """A child of two solutions: the well-filled bins of ``a`` enter ``b`` whole; bins of ``b`` that held any of
    their items go, and the items these bins leave are best-fitted, longest first."""
    fills = [sum(lengths[i] for i in items) for items in a]
    floor = min(WELL_FILLED * capacity, max(fills))
    good = [k for k, fill in enumerate(fills) if fill >= floor]
    chosen = rng.choice(good, max(1, len(good) // 2), replace=False)
    start = [(a[k], fills[k]) for k in chosen]
    placed = {i for items, _ in start for i in items}
    displaced = []
    for items in b:
        if placed.isdisjoint(items):
            start.append((items, sum(lengths[i] for i in items)))
        else:
            displaced += [i for i in items if i not in placed]
    displaced.sort(key=lambda i: -lengths[i])
    return _filled(displaced, lengths, capacity, start)


def least_bins(lengths: list[int], capacity: int) -> int:
    """Sequences that any packing needs: by total length, and by items of which no two fit together."""
    large = [x for x in lengths if 2 * x > capacity]
    room = sum(capacity - x for x in large)
    small = sum(x for x in lengths if 2 * x <= capacity)
    return len(large) + max(0, -(-(small - room) // capacity))


def evolve(lengths: list[int], known: list[list[list[int]]], capacity: int, seed: int) -> list[list[int]]:
    """The best packing found from known ones and perturbed best-fit-decreasing ones."""
    rng = np.random.default_rng(seed)
    values = np.array(lengths)
    quality = lambda bins: (len(bins), -sum(sum(lengths[i] for i in items) ** 2 for items in bins))
    least = least_bins(lengths, capacity)
    people = list(known) or [_filled(np.argsort(-values, kind="stable").tolist(), lengths, capacity)]
    if min(map(len, people)) > least:
        while len(people) < POPULATION:
            noisy = values * rng.uniform(0.9, 1.1, len(values))
            people.append(_filled(np.argsort(-noisy).tolist(), lengths, capacity))
        people.sort(key=quality)
        for _ in range(CHILDREN):
            if len(people[0]) <= least:
                break
            a, b = rng.choice(len(people), 2, replace=False)
            people.append(crossover(people[a], people[b], lengths, capacity, rng))
            people = sorted(people, key=quality)[:POPULATION]
    return min(people, key=quality)


def _solution(bins: pd.Series) -> list[list[int]]:
    return [list(items) for items in pd.Series(np.arange(len(bins))).groupby(bins.to_numpy()).apply(list)]


def assign_sequences(pieces: DataFrame, capacity: int, islands: int = ISLANDS, epochs: int = EPOCHS, rounds: int = ROUNDS) -> DataFrame:
    """``item``, ``sequence_id`` and ``offset`` for ``item`` (unique) and ``length`` (1 to ``capacity``).

    Pieces as long as a sequence fill one each. The others are packed in shards, and what lies in bins that
    stayed loose is dealt to shards anew, so that the last bins of all shards fill each other up.
    """
    whole = pieces.filter(F.col("length") >= capacity).select("item", (F.col("item") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity).select("item", F.col("length").cast("int").alias("length"))
    for turn in range(rounds):
        packed = stored(pack_shards(rest, capacity, islands, epochs, turn), "packed")
        loose = (F.col("fill") < LOOSE * capacity) if turn < rounds - 1 else F.lit(False)
        whole = whole.union(packed.filter(~loose).select("item", "sequence_id", "offset"))
        rest = packed.filter(loose).select("item", "length")
    return whole


def pack_shards(rest: DataFrame, capacity: int, islands: int, epochs: int, turn: int) -> DataFrame:
    """``item``, ``length``, ``sequence_id``, ``offset`` and ``fill`` (of the sequence) for all items.

    Items are dealt to shards by a hash; each shard is packed by a ring of islands, populations with seeds
    of their own. After each epoch every island's elite moves on to the next island of its ring by a shuffle,
    where it takes part in crossovers. At the end a shard takes its best elite. Groups hold a shard's
    pieces once or twice, whatever the corpus's size.
    """
    shards = max(1, -(-rest.count() // SHARD))
    dealt = rest.select(F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(shards)).alias("shard"), "item", "length")
    layout = "shard bigint, island int, item bigint, length int, home int, bin int"
    rows = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "item", "length")
    rows = rows.select("shard", "island", "item", "length", F.col("island").alias("home"), F.lit(-1).alias("bin"))

    def epoch(number: int):
        return lambda frame: one_epoch(frame, number)

    def one_epoch(frame: pd.DataFrame, number: int) -> pd.DataFrame:
        frame = frame.sort_values(["home", "item"], kind="stable")
        shard, island = int(frame["shard"].iloc[0]), int(frame["island"].iloc[0])
        elites = [group for _, group in frame.groupby("home", sort=True)]
        lengths = elites[0]["length"].tolist()
        known = [_solution(e["bin"]) for e in elites if e["bin"].iloc[0] >= 0]
        best = evolve(lengths, known, capacity, zlib.crc32(f"{turn}/{shard}/{island}/{number}".encode()))
        bins = np.empty(len(lengths), np.int32)
        for k, items in enumerate(best):
            bins[items] = k
        return elites[0].assign(home=np.int32(island), bin=bins)

    for number in range(epochs):
        evolved = rows.groupBy("shard", "island").applyInPandas(epoch(number), layout)
        # each elite stays and also moves on to the next island
        targets = F.array(F.col("home"), (F.col("home") + 1) % islands) if islands > 1 else F.array("home")
        rows = evolved.select("shard", F.explode(targets if number < epochs - 1 else F.array(F.lit(0))).alias("island"), "item", "length", "home", "bin")

    def best_elite(frame: pd.DataFrame) -> pd.DataFrame:
        counts = frame.groupby("home")["bin"].nunique()
        home = counts.index[counts.to_numpy() == counts.min()].min()
        best = frame[frame["home"] == home].sort_values(["bin", "item"], kind="stable")
        by_bin = best.groupby("bin")["length"]
        sequence = (turn << 56) + best["shard"] * (1 << 24) + best["bin"]
        offset = (by_bin.cumsum() - best["length"]).astype("int64")
        return pd.DataFrame({"item": best["item"], "length": best["length"], "sequence_id": sequence, "offset": offset, "fill": by_bin.transform("sum")})

    return rows.groupBy("shard").applyInPandas(best_elite, "item bigint, length int, sequence_id bigint, offset bigint, fill bigint")


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """Every document's ids followed by ``end_id``, cut into pieces of at most ``capacity``, as stored rows:
    ``item`` (unique), ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end, width = encoder(vocabulary), np.array([end_id], "<u4").tobytes(), 4 * capacity
        item = TaskContext.get().partitionId() << 40
        for batch in batches:
            found = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = ids.encode(text.as_py()) + end
                for low in range(0, len(data), width):
                    part = data[low : low + width]
                    found.append((item, doc_id, low // width, low // 4, len(part) // 4, zlib.crc32(part)))
                    item += 1
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), kinds)] if found else [pa.array([], t) for t in kinds], names)

    names = ["item", "doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text"))
    return stored(rows.mapInArrow(cut, "item bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"), "pieces")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``.

    Null and empty texts are one piece of the end id alone; only documents longer than a sequence are cut;
    repeated rows are packed each; a null id is kept; an empty table gives no rows; other columns are
    not read. Offsets in a sequence are gapless from 0.
    """
    pieces = token_pieces(docs, vocabulary, capacity, end_id)
    return pieces.join(assign_sequences(pieces.select("item", "length"), capacity), "item").drop("item")
