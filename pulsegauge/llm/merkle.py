"""Merkle manifest of a table: a hash tree per group and one over the groups, built by joins of siblings.

A node's siblings have the indices ``index - slot + (slot + k) mod FANOUT`` for offsets k of 1 and more (for two
children that is ``index XOR 1``). At every level nodes are joined with the nodes of those indices; of each run the row
of slot zero then emits the parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegauge.llm.rows import placed
from pulsegauge.sources.sinks import stored

FANOUT = 16
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left: string, right: string>>"


def encoded(values: list[Column]) -> Column:
    """The values as one string: ``-`` for null, else the UTF-8 byte count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def _hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def lower_ascii(text: Column) -> Column:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, capitals, capitals.lower())


def siblings(nodes: DataFrame, fanout: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """``tree``, ``run``, ``slot``, ``size``, ``h`` and the carried columns of every node, with the digests of the
    siblings before (``left``) and after it (``right``), each as one hex text.

    Siblings' indices differ in the slot only, so one exchange by (tree, run) serves both sides of the join, the
    grouping and a later join with the parents; a run has at most ``fanout`` rows.
    """
    slot = F.pmod("index", F.lit(fanout))
    known = nodes.withColumns({"slot": slot, "run": F.floor((F.col("index") - slot) / fanout).cast("bigint")})
    others = known.select("tree", "run", F.col("slot").alias("other"), F.col("h").alias("other_h"))
    offset = F.pmod(F.col("other") - F.col("slot"), F.lit(fanout))
    own = F.struct("size", "h", *carried)
    met = known.select("tree", "run", "slot", own.alias("own")).join(others, ["tree", "run"]).withColumn("offset", offset)
    # the node itself, at offset 0, only makes sure that a run of one is kept
    at = F.when(F.col("offset") > 0, F.struct("other", "other_h"))
    lists = met.groupBy("tree", "run", "slot").agg(F.first("own").alias("own"), F.array_sort(F.collect_list(at)).alias("found"))
    side = lambda keep: F.concat_ws("", F.transform(F.filter("found", keep), lambda x: _hex(x["other_h"])))
    left, right = side(lambda x: x["other"] < F.col("slot")), side(lambda x: x["other"] > F.col("slot"))
    return lists.select("tree", "run", "slot", "own.*", left.alias("left"), right.alias("right"))


def parents(level: DataFrame, fanout: int) -> DataFrame:
    """The next level's nodes: every row of slot zero emits its run's parent."""
    met = siblings(level.filter("size > 1"), fanout).filter("slot = 0")
    return met.select(
        "tree", F.col("run").alias("index"), F.ceil(F.col("size") / fanout).cast("bigint").alias("size"),
        F.unhex(_hash(F.concat(_hex(F.col("h")), F.col("right")))).alias("h"),
    )


def levels(leaves: DataFrame, fanout: int, name: str) -> list[DataFrame]:
    """Nodes (``tree``, ``index``, ``size``, ``h``) level by level up to the highest tree's root, each but the first stored."""
    size = leaves.agg(F.max("size")).first()[0] or 0
    found = [leaves]
    while size > 1:
        found.append(stored(parents(found[-1], fanout), name))
        size = -(-size // fanout)
    return found


def roots(found: list[DataFrame]) -> DataFrame:
    """``tree`` and ``h`` of the single node that each tree ends in."""
    ends = [level.filter("size = 1").select("tree", "h") for level in found]
    every = ends[0]
    for end in ends[1:]:
        every = every.union(end)
    return every


def paths(found: list[DataFrame], above: DataFrame, fanout: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """``path`` of the lowest level's nodes: the siblings from their own level up, then the path that ``above`` (``tree``,
    ``path`` and further columns) has for their tree; with ``h``, the further columns and the carried ones."""
    further = [c for c in above.columns if c not in ("tree", "path")]
    known = None
    for k in range(len(found) - 1, -1, -1):
        kept = ("h", *carried) if k == 0 else ("h",)
        ends = found[k].filter("size = 1").join(above, "tree").select("tree", "index", "path", *kept, *further)
        if known is not None:
            upper = known.drop("h").withColumnRenamed("index", "run")
            met = siblings(found[k].filter("size > 1"), fanout, carried if k == 0 else ()).join(upper, ["tree", "run"])
            path = F.concat(F.array(F.struct("left", "right")).cast(PATH), F.col("path"))
            index = (F.col("run") * fanout + F.col("slot")).alias("index")
            ends = ends.union(met.select("tree", index, path.alias("path"), *kept, *further))
        known = stored(ends, "paths") if k else ends
    return known


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's hex digest and its path give."""
    return F.aggregate(path, leaf, lambda node, at: _hash(F.concat(at["left"], node, at["right"])))


def proof_digest(path: Column) -> Column:
    """The hash of all siblings, level by level, left to right."""
    return _hash(F.concat_ws("", F.transform(path, lambda at: F.concat(at["left"], at["right"]))))


def manifest(docs: DataFrame, tampered: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row per document: ``doc_id``, ``leaf``, ``subroot`` (of its source), ``root``, ``path`` (siblings up to the
    root as ``left`` and ``right`` digests), and ``tampered_leaf``, which is null where ``tampered`` is not true.

    A leaf is the hash of ``LEAF_COLUMNS``; the tampered one has A-Z of the text lower-cased. Leaves of a source ascend
    by doc_id (nulls first), then by leaf; repeated rows are a leaf each. Sources ascend by UTF-8 bytes, null first, and
    a null source is one of its own. A null text differs from an empty one. Other columns are not read, whatever their
    names. Texts of any length are hashed whole. An empty table gives no rows.
    """
    if fanout < 2:
        raise ValueError("a node needs two children or more")
    plain = [F.col(c) for c in LEAF_COLUMNS]
    forged = _hash(encoded([*plain[:-1], lower_ascii(plain[-1])]))
    leaves = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.unhex(_hash(encoded(plain))).alias("h"),
        F.unhex(F.when(F.lit(False) if tampered is None else tampered, forged)).alias("tampered_h"),
    )
    low = levels(placed(stored(leaves, "leaves"), ["source"], ["doc_id", "h"], "ordered"), fanout, "nodes")
    tops = stored(roots(low).select(F.lit(0).alias("all"), F.col("tree").alias("source_tree"), "h"), "subroots")
    high = levels(placed(tops, ["all"], ["source_tree"], "subroots-ordered"), fanout, "top-nodes")
    whole = roots(high).first()
    root = F.lit(None if whole is None else whole["h"].hex()).alias("root")
    end = roots(high).select("tree", F.array().cast(PATH).alias("path"))
    above = stored(paths(high, end, fanout, ("source_tree",)), "top-paths")
    above = above.select(F.col("source_tree").alias("tree"), "path", F.col("h").alias("subroot_h"))
    found = paths(low, above, fanout, ("doc_id", "tampered_h"))
    return found.select(
        "doc_id", _hex(F.col("h")).alias("leaf"), _hex(F.col("subroot_h")).alias("subroot"), root, "path", _hex(F.col("tampered_h")).alias("tampered_leaf"),
    )
