"""Importance resampling towards a target corpus by hashed n-gram features.

Texts of a batch are joined with separators, one regular-expression pass finds all words, and the separators' places
tell by binary search which document a word is in, so that n-grams over two documents are masked before counting.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegauge.llm.rows import placed
from pulsegauge.sources.sinks import stored

BUCKETS = 10_000
LONGEST = 3
#: Documents of fewer words are never drawn.
LEAST_WORDS = 20
PERCENT = 5
#: Bytes of joined texts whose words are held at a time.
BLOCK = 1 << 20
_END = b"\0"
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 0 else b for b in range(256))
_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|\x00")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
_SPACE_CRC, _END_CRC = zlib.crc32(b" "), zlib.crc32(_END)
#: Longest stretch of bytes that a checksum is moved over at once.
STRIDE = 64


def _shift_table() -> np.ndarray:
    """What a CRC-32 becomes when 0 to ``STRIDE`` zero bytes follow, for each value of each of its four bytes."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = (byte >> 1) ^ np.where(byte & 1, np.uint32(0xEDB88320), np.uint32(0))
    rows = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    table = [np.concatenate(rows)]
    for _ in range(STRIDE):
        table.append(byte[table[-1] & 255] ^ (table[-1] >> 8))
    return np.concatenate(table)


_SHIFT = _shift_table()


def _moved(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksums moved over ``size`` bytes: crc(a + b) is crc(a) moved over b's size, xor crc(b)."""
    left = size
    while True:
        at = np.minimum(left, STRIDE) << 10
        crc = _SHIFT[at + (crc & 255)] ^ _SHIFT[at + 256 + (crc >> 8 & 255)] ^ _SHIFT[at + 512 + (crc >> 16 & 255)] ^ _SHIFT[at + 768 + (crc >> 24)]
        left = np.maximum(left - STRIDE, 0)
        if not left.any():
            return crc


def features(texts: list[bytes | None], longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Document number, CRC-32 and length in words of all runs of 1 to ``longest`` words, block by block.

    A block ends between words; its last words stand before the next one's, so no run is lost between two.
    """
    joined = _END.join([*((t or b"").translate(_CLEAN) for t in texts), b""])
    at, ended = 0, 0
    crc, size = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    space = np.ones(1, np.int64)
    while at < len(joined):
        gap = _GAP.search(joined, at + BLOCK)
        stop = gap.start() if gap else len(joined)
        tokens = _TOKEN.findall(joined, at, stop)
        at, old, n = stop, len(crc), len(tokens)
        crc = np.concatenate([crc, np.fromiter(map(zlib.crc32, tokens), np.uint32, n)])
        size = np.concatenate([size, np.fromiter(map(len, tokens), np.int64, n)])
        is_end = (size == 1) & (crc == _END_CRC)
        ends = np.flatnonzero(is_end)
        doc = ended + np.searchsorted(ends, np.arange(len(crc)))
        run = crc
        for words in range(1, longest + 1):
            if words > 1:
                run = _moved(_moved(run[:-1], space) ^ np.uint32(_SPACE_CRC), size[words - 1 :]) ^ crc[words - 1 :]
            # of a run that holds a separator, the last word is in a later document than the first, or is the separator
            whole = (doc[words - 1 :] == doc[: len(doc) - words + 1]) & ~is_end[words - 1 :]
            whole[: max(0, old - words + 1)] = False
            yield doc[words - 1 :][whole], run[whole], words
            if len(run) < 2:
                break
        keep = max(0, len(crc) - longest + 1)
        ended += int(np.searchsorted(ends, keep))
        crc, size = crc[keep:], size[keep:]


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``bucket`` and ``n`` (its features in all texts); each task counts for itself before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, codes, _ in features(_texts(batch, 0), longest):
                total += np.bincount(codes % buckets, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    return docs.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Thousandths of the smoothed log ratio of each bucket's share in the target to that in the documents.

    One number per bucket comes to the driver, whatever the size of the tables.
    """
    counted = {name: stored(bucket_counts(df, buckets, longest), f"{name}-buckets") for name, df in (("raw", docs), ("target", target))}
    raw, aim = (counted[name].agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for name in ("raw", "target"))
    known = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    for name, df in counted.items():
        known = known.join(df.select("bucket", F.col("n").cast("double").alias(name)), "bucket", "left")
    ratio = (F.coalesce("target", F.lit(0.0)) + 1) * F.lit(float(raw + buckets)) / ((F.coalesce("raw", F.lit(0.0)) + 1) * F.lit(float(aim + buckets)))
    rows = known.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).orderBy("bucket").collect()
    return np.array([r["gain"] for r in rows], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` (the sum of its features' gains) of every document."""
    buckets = len(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, count, total = (np.zeros(n, np.int64) for _ in range(3))
            for doc, codes, length in features(_texts(batch, 1), longest):
                found = np.bincount(doc, minlength=n)
                count += found
                words += found if length == 1 else 0
                # sums of whole numbers far below 2^53, so exact
                total += np.bincount(doc, gains[codes % buckets], minlength=n).astype(np.int64)
            yield pa.record_batch([batch.column(0), *map(pa.array, (words, count, total))], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate that depends on the seed and the id alone (a null id is an empty text)."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = 42, buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS
) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` of every document; those drawn have a rank.

    The draw takes ``percent`` of the documents of ``least_words`` words or more, by score, ties by doc_id. Null and
    empty texts have no features and weight 0; a null id draws its own number and ranks before others of its score;
    repeated rows rank one after another; other columns are not read. An empty target gives every bucket its smoothed
    share; an empty table gives no rows. Scores are ranked by ranges, not in one task.
    """
    scored = weighed(docs, bucket_gains(docs, target, buckets, longest), longest)
    fit = F.col("n_words") >= least_words
    scored = scored.select(
        "doc_id", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"), (~fit).alias("unfit"),
    ).withColumn("lowest", -F.col("score"))
    # stored, as dealing out by ranges reads its rows twice
    ranked = placed(stored(scored, "scored"), ["unfit"], ["lowest", "doc_id"], "scores-ordered")
    drawn = ~F.col("unfit") & (F.col("index") < F.floor(F.col("size") * percent / 100))
    rank = F.when(drawn, F.col("index") + 1).cast("bigint").alias("rank")
    return ranked.select("doc_id", "n_features", "weight", "score", rank)
