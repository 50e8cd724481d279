"""Substring dedup: stretches of text that occur before, anywhere in the corpus, are cut out of later documents.

Units are lines, and inside them sentences: passages are often pasted into the middle of a line, where no
whole line repeats. A unit ends with a line end, with the space after a full stop, exclamation or question
mark, or with a space before a capital, which is where a pasted passage starts inside a sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from pulsegauge.llm.rows import KEY, row_key
from pulsegauge.sources.sinks import stored

#: Stretches of fewer words are left alone: they repeat by chance, or are headings and licence lines.
MIN_WORDS = 25
DIGEST = ("__digest_a", "__digest_b")
_UNIT_END = re.compile(r"\n+|(?<=[.!?]) |(?<=[^.!?\s]) (?=[A-ZÀ-ÖØ-Þ])")


def unit_bounds(text: str) -> list[int]:
    """Where units start and end, in characters; the units are the whole text without gaps."""
    return [0, *(m.end() for m in _UNIT_END.finditer(text)), len(text)]


def unit_words(text: str, bounds: list[int]) -> list[list[bytes]]:
    """The words of every unit, A-Z lower-cased: what units are compared by."""
    return [text[a:b].encode().lower().split() for a, b in zip(bounds, bounds[1:])]


def unit_digests(docs: DataFrame) -> DataFrame:
    """One row per unit that has words: its 128-bit digest, the document's row key and ``unit`` (its number from 0)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, numbers, counts = [], [], []
            for text in batch.column(2):
                value = text.as_py() or ""
                units = [(i, w) for i, w in enumerate(unit_words(value, unit_bounds(value))) if w]
                codes += [xxhash.xxh3_128_digest(b" ".join(w)) for _, w in units]
                numbers += [i for i, _ in units]
                counts.append(len(units))
            halves = np.frombuffer(b"".join(codes), "<i8").reshape(-1, 2)
            keys = [np.repeat(batch.column(i).to_numpy(), counts) for i in (0, 1)]
            columns = [halves[:, 0].copy(), halves[:, 1].copy(), *keys, np.array(numbers, np.int32)]
            yield pa.record_batch([pa.array(c) for c in columns], [*DIGEST, *KEY, "unit"])

    layout = ", ".join(f"{c} bigint" for c in (*DIGEST, *KEY))
    return docs.select(*row_key(), "text").mapInArrow(cut, f"{layout}, unit int")


def repeated_units(docs: DataFrame) -> DataFrame:
    """Per document (row key) the numbers of its units that occur earlier: ``units``.

    The earliest occurrence is that of the smallest doc_id (null ids first, then by a hash of the text),
    then the first unit. Counting combines in each task before the shuffle, and a very common unit is
    split among tasks when occurrences meet the earliest one. Only units that repeat are joined.
    """
    units = stored(unit_digests(docs), "units")
    first = F.min(F.struct(*KEY, "unit"))
    earliest = units.groupBy(*DIGEST).agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1").select(*DIGEST, "first")
    # stored, so that the join has plain shuffles on both sides and adaptive execution can split a common digest
    earliest = stored(earliest, "repeated")
    later = units.join(earliest, list(DIGEST)).filter(F.struct(*KEY, "unit") != F.col("first"))
    return later.groupBy(*KEY).agg(F.collect_set("unit").alias("units"))


def cut_units(text: str, later: list[int], min_words: int) -> tuple[str, list[dict]]:
    """The text without stretches of consecutive later units that have ``min_words`` words together, and the
    cut spans in the original (characters, end excluded)."""
    bounds = unit_bounds(text)
    words = unit_words(text, bounds)
    spans, start, count, known = [], None, 0, set(later)
    for i in range(len(words) + 1):
        if i in known:
            start = i if start is None else start
            count += len(words[i])
        elif start is not None:
            if count >= min_words:
                spans.append({"start": bounds[start], "end": bounds[i]})
            start, count = None, 0
    kept, at = [], 0
    for span in spans:
        kept.append(text[at : span["start"]])
        at = span["end"]
    return "".join([*kept, text[at:]]), spans


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``row`` (the whole original row), ``clean_text`` and ``removed`` (spans of the original text) of every row.

    Every row stays, also one whose text is all removed (its text is then empty). Null texts stay null.
    Rows equal in id and text are one document for the ranking and come out equal. The rest of the text is
    unchanged. Columns of any name travel inside ``row``. An empty table gives no rows.
    """

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts, removed = [], []
            for text, later in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                clean, cut = cut_units(text, later, min_words) if text is not None and later else (text, [])
                texts.append(clean)
                removed.append(cut)
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, kind)], ["row", "clean_text", "removed"])

    rows = docs.select(F.struct("*").alias("row"), *row_key())
    marked = rows.join(repeated_units(docs), list(KEY), "left").select("row", F.col("row.text").alias("text"), "units")
    span = StructType().add("start", "long").add("end", "long")
    return marked.mapInArrow(rebuild, StructType([marked.schema["row"]]).add("clean_text", "string").add("removed", ArrayType(span)))


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated stretches cut from ``text``; documents of which nothing but white space is left go."""
    rows = dedup_lines(docs, min_words)
    left = rows.filter((F.size("removed") == 0) | F.col("clean_text").rlike(r"[^\x20\x09-\x0D]"))
    columns = [F.col("clean_text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return left.select(*columns)
