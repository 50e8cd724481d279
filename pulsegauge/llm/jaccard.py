"""Similarity join of texts by exact Jaccard similarity of their word shingles, with set-relation skipping.

Every set is ordered by one global order, rare shingles first, and its prefix goes into an inverted index: two sets that
are similar enough share a shingle of their prefixes. Some pivots of every index list meet the rest of it first; what then still
has several labels is cut into blocks by size and position, and pairs of blocks whose sizes or positions rule out the
overlap asked for are skipped whole. Sets that were compared with one pivot
keep how they differ from it, so that further answers between them follow from these differences alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegauge.llm.rows import KEY, row_key
from pulsegauge.llm.simhash import components
from pulsegauge.sources.sinks import stored

SHINGLE, PERCENT = 3, 90
#: Counters that estimate how often a shingle occurs; they only choose the order, never the result.
COUNTERS = 1 << 18
#: Rounds in which pivots of every index list are compared with the rest of the list, and most pivots of a list.
STARS, PIVOTS = 2, 64
#: Members of a block, and partners of a pivot that meet one copy of its set.
MEMBERS, PARTNERS = 512, 256
#: Positions of one block of an index list.
POSITIONS = 8
#: Keys of 24 bytes that are sent to all tasks to pick texts by.
SENT = 1_000_000
#: Most cells of a set's parity sketch, as a power of two.
CELLS = 24
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit digests of a text's word shingles, A-Z lower-cased; a text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - shingle + 1)
    found = np.full(n, min(shingle, len(words)), np.uint64)
    for i in range(min(shingle, len(words))):
        found = (found ^ codes[i : i + n]) * _TIMES
        found ^= found >> np.uint64(32)
    return np.unique(found)


def parities(found: np.ndarray) -> np.ndarray:
    """A bit per hash cell, in words of 64: whether the set has an odd number of members there.

    Members common to two sets cancel out, so the sketches differ in no more bits than the sets do in members. There
    are one to two cells for each member, in powers of two, so that large sets are told apart as well as small ones.
    """
    cells = 1 << min(CELLS, max(6, (len(found) - 1).bit_length()))
    odd = np.bincount((found >> np.uint64(40)).astype(np.int64) & (cells - 1), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bits_apart(a: np.ndarray, b: np.ndarray) -> int:
    """In how many cells two sketches differ, the larger one folded to the cells of the smaller."""
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())  # unsigned, as the sign of a number is no bit to numpy


def needed(n: Column, m: Column, percent: int) -> Column:
    """Smallest intersection of two sets of these sizes that are similar enough."""
    return F.ceil((n + m) * F.lit(percent) / F.lit(100 + percent) - 1e-9)


def may_link(n: Column, pos: Column, m: Column, pos_m: Column, percent: int) -> Column:
    """Whether two sets with a shared shingle at these positions (from 0), the first shared one, can be similar enough."""
    sizes = (n * 100 >= m * percent) & (m * 100 >= n * percent)
    return sizes & (F.least(n - pos, m - pos_m) >= needed(n, m, percent))


def shingle_levels(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """Binary logarithm of each counter over all texts; ``COUNTERS`` numbers come to the driver, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += 0 if (found := shingle_set(text.as_py(), shingle)).size == 0 else np.bincount((found % COUNTERS).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["counter", "n"])

    counted = docs.select("text").mapInArrow(count, "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n"))
    known = counted.toArrow()
    levels = np.zeros(COUNTERS, np.uint8)
    levels[known["counter"].to_numpy()] = np.log2(known["n"].to_numpy()).astype(np.uint8)
    return levels


def set_rows(docs: DataFrame, levels: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """``doc_id``, the row key, ``code`` (128-bit digest of the set), ``n`` (its size), its sketch and ``prefix`` of every row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, sizes, prefixes, sketches = [], [], [], []
            for text in batch.column(3):
                found = shingle_set(text.as_py(), shingle)
                n = len(found)
                first = n - -(-percent * n // 100) + 1 if n else 0
                order = np.lexsort((found, levels[found % COUNTERS]))[:first]
                codes.append(xxhash.xxh3_128_digest(found.tobytes()))
                sizes.append(n)
                sketches.append(parities(found))
                prefixes.append(found[order].view(np.int64))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (sketches, prefixes)]
            yield pa.record_batch([*batch.columns[:3], pa.array(codes, pa.binary()), pa.array(sizes, pa.int64()), *lists], names)

    names = ["doc_id", *KEY, "code", "n", "sketch", "prefix"]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *row_key(), "text")
    return rows.mapInArrow(cut, f"doc_id bigint, {KEY[0]} bigint, {KEY[1]} bigint, code binary, n bigint, sketch array<bigint>, prefix array<bigint>")


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``cid`` and ``items`` (sorted digests) of the wanted classes, made again from one text of each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [shingle_set(x.as_py(), shingle).view(np.int64) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(items, pa.list_(pa.int64()))], ["cid", "items"])

    chosen = stored(classes.join(wanted, "cid", "left_semi").select("cid", *(F.col("key")[k].alias(k) for k in KEY)), "jaccard-wanted")
    # three numbers a row, so the count bounds the bytes sent; beyond it texts and keys are shuffled
    small = F.broadcast(chosen) if chosen.count() <= SENT else chosen
    texts = docs.select(*row_key(), "text").join(small, list(KEY)).groupBy(*KEY, "cid").agg(F.first("text").alias("text"))
    return stored(texts.select("cid", "text").mapInArrow(cut, "cid bigint, items array<bigint>"), "jaccard-sets")


def _numbers(column: pa.Array) -> Iterator[np.ndarray]:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (flat[low:high].view(np.uint64) for low, high in zip(ends[:-1], ends[1:]))


def _beside_first(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs with the columns that ``known`` has for their ``first``; a pivot with many partners is joined by copies,
    one per ``PARTNERS`` of them, so that its partners spread over tasks."""
    copies = pairs.groupBy("first").agg(F.ceil(F.count("*") / PARTNERS).alias("copies"))
    dealt = pairs.join(copies, "first").withColumn("copy", F.pmod(F.xxhash64("cid"), F.col("copies"))).drop("copies")
    every = known.join(copies, "first").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    return dealt.join(every, ["first", "copy"]).drop("copy")


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (``first``, ``cid``) whose sketches do not rule the link out: their sets differ in at least as many members
    as their sketches do in bits, and by the sizes at most in n + m - 2 * needed."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = zip(batch.column(2).to_pylist(), _numbers(batch.column(3)), _numbers(batch.column(4)))
            kept = pa.array([bits_apart(a, b) <= most for most, a, b in each], pa.bool_())
            yield batch.select(["first", "cid"]).filter(kept)

    own = classes.select("cid", "n", "sketch")
    met = _beside_first(pairs, own.toDF("first", "m", "sketch_first")).join(own, "cid")
    most = (F.col("n") + F.col("m") - 2 * needed(F.col("n"), F.col("m"), percent)).cast("bigint").alias("most")
    return stored(met.select("first", "cid", most, "sketch_first", "sketch").mapInArrow(near, "first bigint, cid bigint"), "jaccard-plausible")


def _compared(pairs: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """``first``, ``cid``, ``both`` (size of the intersection), ``minus`` (only in first) and ``plus`` (only in cid) of pairs."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, minus, plus = [], [], []
            for a, b in zip(_numbers(batch.column(2)), _numbers(batch.column(3))):
                only = np.setdiff1d(a, b, assume_unique=True), np.setdiff1d(b, a, assume_unique=True)
                both.append(len(a) - len(only[0]))
                # far sets keep no differences: nothing is derived from them
                far = len(only[0]) + len(only[1]) > both[-1]
                minus.append(None if far else only[0].view(np.int64))
                plus.append(None if far else only[1].view(np.int64))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (minus, plus)]
            yield pa.record_batch([*batch.columns[:2], pa.array(both, pa.int64()), *lists], ["first", "cid", "both", "minus", "plus"])

    sets = _sets(docs, classes, pairs.select("cid").union(pairs.select("first")).distinct(), shingle)
    met = _beside_first(pairs, sets.toDF("first", "a")).join(sets.toDF("cid", "b"), "cid").select("first", "cid", "a", "b")
    return stored(met.mapInArrow(compare, "first bigint, cid bigint, both bigint, minus array<bigint>, plus array<bigint>"), "jaccard-compared")


def _lists(members: DataFrame) -> DataFrame:
    """Members (``token``, ``cid``, ``n``, ``pos``, ``label``) of the index lists that hold more than one label, with ``pivots``,
    the smallest of each hash class of members.

    Of lists with the same members only the one of the first shingle is kept. All sets are in one order, so it is the first
    in each of them, and a pair that it rules out is ruled out by the others.
    """
    # two digests of 64 bits and the count tell the lists' members apart
    same = [F.bit_xor(F.xxhash64("cid")).alias("these"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("those"), F.count("*").alias("size")]
    ends = [F.min("label").alias("low"), F.max("label").alias("high")]
    first = F.min(F.struct("cid", "n", "pos", "label"))
    several = members.groupBy("token").agg(first.alias("first"), *same, *ends).filter("low < high")
    # lists of the same members have the same first one
    one = several.groupBy("these", "those", "size").agg(F.min(F.struct("first", "token")).alias("list"))
    kept = stored(members.join(stored(one.select("list.token"), "jaccard-lists"), "token"), "jaccard-kept")
    classed = kept.groupBy("token", F.pmod(F.xxhash64("cid"), F.lit(PIVOTS)).alias("class")).agg(first.alias("pivot"))
    pivots = classed.groupBy("token").agg(F.collect_list("pivot").alias("pivots"))
    return stored(kept.join(pivots, "token"), "jaccard-members")


def _block_pairs(members: DataFrame, percent: int) -> DataFrame:
    """``first`` < ``cid`` of different labels that meet in an index list and can be similar enough.

    A list is cut into blocks by size and position, of about ``MEMBERS`` rows each. Only pairs of blocks whose extremes
    allow the overlap are opened.
    """
    size = F.floor(F.log("n") / float(np.log(100 / percent)) + 1e-9) if percent < 100 else F.col("n")
    cells = members.withColumns({"size": size.cast("bigint"), "place": F.floor(F.col("pos") / POSITIONS)})
    parts = cells.groupBy("token", "size", "place").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    cells = cells.join(parts, ["token", "size", "place"])
    cells = cells.withColumn("block", F.xxhash64("size", "place", F.pmod(F.xxhash64("cid"), F.col("parts"))))
    cells = stored(cells.select("token", "block", "cid", "n", "pos", "label"), "jaccard-cells")
    blocks = cells.groupBy("token", "block").agg(*(f(c).alias(f"{name}_{c}") for c in ("n", "pos", "label") for name, f in (("least", F.min), ("most", F.max))))
    other = blocks.toDF("token", *(f"{c}2" for c in blocks.columns[1:]))
    overlap = F.least(F.col("most_n") - F.col("least_pos"), F.col("most_n2") - F.col("least_pos2"))
    open_ = (
        (F.col("block") <= F.col("block2"))
        & (F.col("most_n") * 100 >= F.col("least_n2") * percent) & (F.col("most_n2") * 100 >= F.col("least_n") * percent)
        & (overlap >= needed(F.col("least_n"), F.col("least_n2"), percent))
        & ~((F.col("least_label") == F.col("most_label2")) & (F.col("most_label") == F.col("least_label2")))
    )
    opened = stored(blocks.join(other, "token").filter(open_).select("token", "block", "block2"), "jaccard-opened")
    left = opened.join(cells, ["token", "block"])
    right = cells.toDF("token", "block2", "cid2", "n2", "pos2", "label2")
    ordered = (F.col("block") < F.col("block2")) | (F.col("cid") < F.col("cid2"))
    fit = may_link(F.col("n"), F.col("pos"), F.col("n2"), F.col("pos2"), percent) & (F.col("label") != F.col("label2")) & ordered
    met = left.join(right, ["token", "block2"]).filter(fit)
    return met.select(F.least("cid", "cid2").alias("first"), F.greatest("cid", "cid2").alias("cid")).distinct()


def _derived(pairs: DataFrame, answers: DataFrame, sizes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links among the pairs whose sets were compared with one pivot, and the pairs that have none in common.

    With r the pivot, the intersection is |r| less what either lacks of r, and what both have beyond it. Its bounds
    from the sizes alone settle most pairs; only the others look at the differences.
    """
    lead = answers.filter("minus IS NOT NULL").groupBy("cid").agg(F.max_by(F.struct("first", "both", "minus", "plus"), F.struct("both", "first")).alias("lead"))
    lead = stored(lead.join(sizes, "cid"), "jaccard-leads")
    a, b = (lead.toDF(c, f"lead_{c}", f"n_{c}") for c in ("first", "cid"))
    x, y = F.col("lead_first"), F.col("lead_cid")
    met = stored(pairs.join(a, "first", "left").join(b, "cid", "left").withColumn("same", F.coalesce(x["first"] == y["first"], F.lit(False))), "jaccard-met")
    pivot = x["both"] + F.size(x["minus"])
    need = needed(F.col("n_first"), F.col("n_cid"), percent)
    least = x["both"] + y["both"] - pivot
    most = F.least(x["both"], y["both"]) + F.least(F.size(x["plus"]), F.size(y["plus"]))
    exact = pivot - F.size(F.array_union(x["minus"], y["minus"])) + F.size(F.array_intersect(x["plus"], y["plus"]))
    linked = F.when(least >= need, True).when(most < need, False).otherwise(exact >= need)
    return met.filter("same").filter(linked).select("first", "cid"), met.filter("NOT same").select("first", "cid")


def similar_sets(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row; two link when 100 * intersection >= ``percent`` * union.

    ``component_id`` is the smallest id reachable over links, the own one included; null ids are no smallest id unless a
    component has no other. Null texts and texts without words have size 0, link with nothing and keep their own id.
    Repeated rows and equal sets are one class and one more row each. Other columns are not read. Texts of any
    length are read whole; an empty table gives no rows.
    """
    if not 1 <= percent <= 100:
        raise ValueError("the similarity is a percentage from 1 to 100")
    rows = stored(set_rows(docs, shingle_levels(docs, shingle), shingle, percent), "jaccard-rows")
    one = [F.min("doc_id").alias("first_id"), F.min(F.struct(*KEY)).alias("key"), *(F.first(c).alias(c) for c in ("n", "sketch", "prefix"))]
    classes = stored(rows.filter("n > 0").groupBy("code").agg(*one).withColumn("cid", F.monotonically_increasing_id()), "jaccard-classes")
    # numbered by the store; spread over tasks again, as a class multiplies into its prefix
    index = classes.select("cid", "n", F.posexplode("prefix").alias("pos", "token"))
    live = _lists(index.select("token", "cid", "n", F.col("pos").cast("bigint").alias("pos"), F.col("cid").alias("label")))
    sizes = classes.select("cid", "n")
    links = answers = labels = None

    def linked(compared: DataFrame) -> DataFrame:
        known = compared.join(sizes, "cid").join(sizes.toDF("first", "m"), "first")
        return known.filter(F.col("both") >= needed(F.col("n"), F.col("m"), percent)).select("first", "cid")

    for _ in range(STARS):
        if live.isEmpty():
            break
        fit = lambda p: (F.col("label") != p["label"]) & may_link(F.col("n"), F.col("pos"), p["n"], p["pos"], percent)
        met, p = live.select("cid", F.explode(F.filter("pivots", fit)).alias("p")), F.col("p")
        pairs = stored(met.select(F.least(p["cid"], "cid").alias("first"), F.greatest(p["cid"], "cid").alias("cid")).distinct(), "jaccard-pairs")
        compared = _compared(_plausible(pairs, classes, percent), docs, classes, shingle)
        answers = compared if answers is None else answers.union(compared)
        found = linked(compared)
        links = stored(found if links is None else links.union(found), "jaccard-links")
        labels = components(links.toDF("a", "b"))
        # a list's pivots have met all of their list; lists of one label have no more to tell
        rest = live.filter(~F.array_contains("pivots.cid", F.col("cid"))).select("token", "cid", "n", "pos")
        named = rest.join(labels.toDF("cid", "root"), "cid", "left")
        live = _lists(named.select("token", "cid", "n", "pos", F.coalesce("root", "cid").alias("label")))
    if not live.isEmpty():
        derived, others = _derived(stored(_block_pairs(live, percent), "jaccard-block-pairs"), answers, sizes, percent)
        links = stored(links.union(derived).union(linked(_compared(_plausible(others, classes, percent), docs, classes, shingle))), "jaccard-links")
        labels = components(links.toDF("a", "b"))
    roots = sizes.select("cid", F.col("cid").alias("root")).limit(0) if labels is None else labels.toDF("cid", "root")
    named = stored(classes.select("code", "cid", "first_id").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")), "jaccard-named")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # stored, so that the join has plain shuffles on both sides and adaptive execution can split a group of copies
    placed = stored(named.join(smallest, "root").select("code", "component_id"), "jaccard-components")
    alone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.filter("n > 0").select("doc_id", "code", "n").join(placed, "code").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(alone)
