"""Mixing sources to target weights: a golden-ratio schedule of equal-token blocks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegauge.sources.sinks import stored

WEIGHTS = (5, 2, 1)
#: Times a source may be repeated.
MOST = 3
#: Words per block, also the slot size of the schedule.
BLOCK = 1024
#: Shuffled cells per source; a source of any size is dealt out over them.
CELLS = 1024
#: Cells of the unit interval in which points meet sources.
ARCS = 4096
#: Slots ranked together.
STRETCH = 1 << 14
GOLDEN = 0.6180339887498949


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def placed_documents(docs: DataFrame, columns: list[str], seed: int = 0) -> DataFrame:
    """``row`` (the named columns), ``size`` and ``start`` (words before it in its source's shuffled order) of every document.

    The order is by a hash of id and text. Running sums are taken per (source, cell of the hash) and
    over the cells' totals, so no source, however large, is ordered in one task. A null source is told
    apart by ``no_source``.
    """
    rows = docs.select(
        F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("name"),
        F.struct(*columns).alias("row"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), word_count(F.col("text")).alias("size"),
    ).withColumn("cell", F.pmod(F.shiftrightunsigned("h", 20), F.lit(CELLS)))
    totals = rows.groupBy("no_source", "name", "cell").agg(F.sum("size").alias("cell_size"))
    earlier = Window.partitionBy("no_source", "name").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("no_source", "name", "cell", F.coalesce(F.sum("cell_size").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("no_source", "name", "cell").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(totals, ["no_source", "name", "cell"]).select(
        "no_source", "name", "row", "size", (F.col("before") + F.col("within")).alias("start")
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add ``number``, ``weight`` and ``target`` to one row per source (``no_source``, ``name``, ``source_size``).

    Sources in code point order, null last, get the weights in turn and share all words by weight. A target
    stops at ``most`` times the size and the excess goes to the others by weight. In ascending order of
    limit per weight, the sources that stop come first; one stops exactly if its share of what those
    before it leave reaches its limit, and the first that does not stop has the share of all the rest.
    """
    turn = F.array(*(F.lit(w) for w in weights))
    order = Window.orderBy("no_source", F.encode("name", "utf-8"))
    rows = sizes.withColumn("number", F.row_number().over(order) - 1)
    rows = rows.withColumns({
        "weight": F.element_at(turn, F.col("number") % len(weights) + 1),
        "limit": F.col("source_size") * most,
    })
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "number")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = lambda whole, gone: F.sum(whole).over(everything) - F.coalesce(F.sum(gone).over(before), F.lit(0))
    rows = rows.withColumn("share", rest("source_size", "limit") / rest("weight", "weight"))
    rows = rows.withColumn("stops", F.col("share") * F.col("weight") >= F.col("limit"))
    common = F.first(F.when(~F.col("stops"), F.col("share")), ignorenulls=True).over(everything)
    target = F.when(F.col("stops"), F.col("limit")).otherwise(common * F.col("weight")).cast("double")
    return rows.select("no_source", "name", "source_size", "number", "weight", target.alias("target"))


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Slots of the mix: ``slot`` (its place), ``number`` (of the source) and ``rank`` (among its source's slots).

    Point i is the fraction of i times the golden ratio; it falls to the source whose part of the cumulated
    targets holds it, so every stretch of slots has each source near its share. Points and the parts'
    starts meet in cells (arcs) of the unit interval, each told which part reaches into it: a running
    last value finds the source without a range join. A source gets exactly the slots its target needs:
    surplus slots are dropped, and the few that a source lacks follow at the end.
    """
    upto = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = targets.withColumns({
        "high": F.sum("target").over(upto), "sum": F.sum("target").over(everything), "sources": F.count("*").over(everything),
        "slots": F.ceil(F.sum("source_size").over(everything) / block), "need": F.ceil(F.floor("target") / block),
    }).filter("target > 0").select(
        "number", "need", "slots", "sources", ((F.col("high") - F.col("target")) / F.col("sum")).alias("low"), (F.col("high") / F.col("sum")).alias("high"),
    )
    arc = lambda x: F.floor(x * ARCS)
    no_slot = F.lit(None).cast("bigint").alias("slot")
    first, last = F.ceil(F.col("low") * ARCS), F.least(F.ceil(F.col("high") * ARCS), F.lit(ARCS)) - 1
    reach = parts.select("number", F.explode(F.when(last >= first, F.sequence(first, last))).alias("arc"))
    reach = reach.select((F.col("arc") / ARCS).alias("at"), "arc", F.lit(0).alias("kind"), "number", no_slot)
    starts = parts.select(F.col("low").alias("at"), arc(F.col("low")).alias("arc"), F.lit(1).alias("kind"), "number", no_slot)
    stretches = parts.groupBy("slots").count().select("slots", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / STRETCH))).alias("stretch"))
    slots = stretches.repartition("stretch").select("slots", F.explode(F.sequence(F.col("stretch") * STRETCH, F.least(F.col("slots"), (F.col("stretch") + 1) * STRETCH) - 1)).alias("slot"))
    turn = F.col("slot") * F.lit(GOLDEN)
    points = slots.select((turn - F.floor(turn)).alias("at"), "slot")
    points = points.select("at", arc(F.col("at")).alias("arc"), F.lit(2).alias("kind"), F.lit(None).cast("int").alias("number"), "slot")
    so_far = Window.partitionBy("arc").orderBy("at", "kind", "number").rowsBetween(Window.unboundedPreceding, 0)
    met = reach.union(starts).union(points).withColumn("found", F.last("number", ignorenulls=True).over(so_far))
    drawn = met.filter("kind = 2").select("slot", F.col("found").alias("number"), F.floor(F.col("slot") / STRETCH).alias("stretch"))
    # ranks by stretches of slots first, so that no source's slots are ordered in one task
    counts = drawn.groupBy("number", "stretch").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("number").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    inside = Window.partitionBy("number", "stretch").orderBy("slot")
    ranked = drawn.withColumn("within", F.row_number().over(inside) - 1).join(counts.select("number", "stretch", "before"), ["number", "stretch"])
    ranked = ranked.join(parts.select("number", "need"), "number").select("slot", "number", (F.col("before") + F.col("within")).alias("rank"), "need")
    given = counts.groupBy("number").agg(F.sum("n").alias("given"))
    short = parts.join(given, "number", "left").withColumn("given", F.coalesce("given", F.lit(0))).filter("given < need")
    tail = short.select("slots", "sources", "given", "number", F.explode(F.sequence("given", F.col("need") - 1)).alias("rank"))
    tail = tail.select((F.col("slots") + (F.col("rank") - F.col("given")) * F.col("sources") + F.col("number")).alias("slot"), "number", "rank")
    return ranked.filter("rank < need").select("slot", "number", "rank").union(tail)


class Mix:
    """A mix of documents (``doc_id``, ``text``, ``source``; other columns are not read).

    ``documents``: every document with ``doc_id``, ``size``, ``start``, its source's ``number``,
    ``source_size`` and ``target``. ``pieces``: what the mix takes, in slots of ``block`` words:
    ``slot``, ``number``, ``rank``, the document's ``start``, ``epoch`` (its pass over the source), ``at``
    (first word of the document) and ``words``. Null and wordless texts have size 0 and are never taken;
    repeated rows count each; a null id is kept; empty tables give empty results. The order and the schedule
    come from hashes and a fixed sequence, so reruns agree.
    """

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = 0):
        self._docs, self._seed = docs, seed
        placed = stored(placed_documents(docs, ["doc_id"], seed), "placed")
        sizes = placed.groupBy("no_source", "name").agg(F.sum("size").alias("source_size"))
        self.targets = stored(source_targets(sizes, weights, most), "targets")
        known = self.targets.select("no_source", "name", "number", "source_size", "target")
        self.documents = placed.join(known, ["no_source", "name"]).select("row.doc_id", "size", "start", "number", "source_size", "target")
        end = F.floor("target")
        passes = self.documents.filter("size > 0").select("number", "start", "size", end.alias("end"), "source_size", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("epoch"))
        passes = passes.withColumn("a", F.col("epoch") * F.col("source_size") + F.col("start")).filter("a < end").withColumn("b", F.least(F.col("a") + F.col("size"), F.col("end")))
        cut = passes.select("number", "start", "epoch", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))).alias("rank"))
        low, high = F.greatest(F.col("a"), F.col("rank") * block), F.least(F.col("b"), (F.col("rank") + 1) * block)
        cut = cut.select("number", "rank", "start", "epoch", (low - F.col("a")).alias("at"), (high - low).alias("words"))
        self.pieces = cut.join(schedule(self.targets, block), ["number", "rank"])

    def taken(self) -> DataFrame:
        """``documents`` with ``taken``: the words the mix takes of each, repeats counted."""
        words = self.pieces.groupBy("number", "start").agg(F.sum("words").alias("words"))
        # a document without words shares its start with the next one
        own = self.documents.withColumn("own", F.when(F.col("size") > 0, F.col("start")))
        found = own.join(words.toDF("number", "own", "words"), ["number", "own"], "left")
        return found.withColumn("taken", F.coalesce("words", F.lit(0)).cast("bigint")).drop("own", "words")

    def rows(self) -> DataFrame:
        """Whole rows of the given table, each as often as the mix takes its first word."""
        copies = self.pieces.filter("at = 0").groupBy("number", "start").agg(F.count("*").alias("copies"))
        copies = copies.join(self.targets.select("number", "no_source", "name"), "number").select("no_source", "name", "start", "copies")
        wide = placed_documents(self._docs, ["*"], self._seed).filter("size > 0")
        return wide.join(copies, ["no_source", "name", "start"]).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
