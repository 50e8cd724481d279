"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: Labelled rows learned from at most, and terms of the vector space at most: the bounds of the classifier.
LABELLED = 10_000
TERMS = 4096
#: A term is kept if at least so many labelled documents have it and its log-likelihood ratio is this high.
LEAST_DOCUMENTS, LEAST_RATIO = 4, 28.0
#: Word beginnings of these lengths are terms beside whole words, so that inflected forms meet.
BEGINNINGS = (4, 5, 6, 7, 8)
NEIGHBOURS = 10
BLOCK = 64
#: Words remembered per worker.
WORDS = 200_000
_WORD = re.compile(r"\w+")


def word_terms(word: str) -> list[str]:
    """Terms of a lower-case word: itself and its beginnings, marked by a star."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)]


class _Known(dict):
    """Word -> numbers of its terms in the vocabulary, worked out once per word."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self._vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(self._vocabulary[t] for t in word_terms(word) if t in self._vocabulary)
        if len(self) >= WORDS:
            self.clear()
        self[word] = found
        return found


def term_counts(text: str | None, known: _Known) -> Counter:
    """How often each term of the vocabulary occurs in a whole text."""
    hits = filter(None, map(known.__getitem__, _WORD.findall(text.lower()))) if text else ()
    return Counter(n for numbers in hits for n in numbers)


class BlockMaxIndex:
    """Labelled documents by term, in blocks of ``BLOCK`` with each term's largest weight per block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, doc_ids: np.ndarray, terms: int):
        heaviest = [int(t[np.argmax(w)]) if len(t) else terms for t, w in vectors]
        order = np.lexsort((doc_ids, heaviest))  # documents about the same term share blocks, which sharpens the bounds
        order = order[[len(vectors[i][0]) > 0 for i in order]] if len(order) else order
        self.labels, self.doc_ids = labels[order], doc_ids[order]
        n = max(1, -(-len(order) // BLOCK))
        self.tops = np.zeros((terms, n), np.float64)
        self.blocks = []
        for b in range(n):
            own = [vectors[i] for i in order[b * BLOCK : (b + 1) * BLOCK]]
            t = np.concatenate([v[0] for v in own]) if own else np.empty(0, np.int64)
            w = np.concatenate([v[1] for v in own]) if own else np.empty(0)
            np.maximum.at(self.tops[:, b], t, w)
            self.blocks.append((t, w, np.repeat(np.arange(len(own)), [len(v[0]) for v in own]) if own else t, len(own)))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the exact ``k`` nearest with a term in common (ties: smaller number).

        Blocks are opened by descending upper bound until none left can reach the k-th best.
        """
        if not len(terms) or not len(self.labels):
            return np.empty(0, np.int64), np.empty(0)
        bounds = weights @ self.tops[terms]
        dense = np.zeros(len(self.tops))
        dense[terms] = weights
        best, numbers = np.empty(0), np.empty(0, np.int64)
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] <= 0 or len(best) == k and bounds[b] < best[-1] - 1e-12:
                break
            t, w, place, count = self.blocks[b]
            scores = np.bincount(place, dense[t] * w, count)
            found = np.flatnonzero(scores > 0)
            best, numbers = np.append(best, scores[found]), np.append(numbers, found + b * BLOCK)
            if without >= 0:
                best, numbers = best[numbers != without], numbers[numbers != without]
            first = np.lexsort((numbers, -best.round(12)))[:k]
            best, numbers = best[first], numbers[first]
        return numbers, best


class ToxicityModel:
    """Index, term weights, and the calibration of distance-weighted votes."""

    def __init__(self, vocabulary: list[str], idf: np.ndarray, examples: list[tuple[int, int, dict[int, int]]], k: int = NEIGHBOURS):
        self.vocabulary, self.idf, self.k = vocabulary, idf, k
        vectors = [self._vector(counts) for _, _, counts in examples]
        labels = np.array([y for _, y, _ in examples], np.float64)
        self.index = BlockMaxIndex(vectors, labels, np.array([d for d, _, _ in examples], np.int64), len(vocabulary))
        empty = [y for (_, y, _), v in zip(examples, vectors) if not len(v[0])]
        rate = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 0.0
        #: What documents without any term get: the share among labelled ones like them.
        self.without_terms = (sum(empty) + rate) / (len(empty) + 1) if len(labels) else 0.0
        self._rate, self._slope, self._offset = rate, 1.0, 0.0
        place = {d: i for i, d in enumerate(self.index.doc_ids.tolist())}
        votes = [(self._vote(*self.index.nearest(*v, k, place[d])), y) for (d, y, _), v in zip(examples, vectors) if len(v[0])]
        if votes:
            self._calibrate(*np.array(votes).T)

    def _vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.array(sorted(counts), np.int64)
        weights = (1 + np.log([counts[t] for t in terms])) * self.idf[terms] if len(terms) else np.empty(0)
        return terms, weights / max(1e-12, np.linalg.norm(weights))

    def _vote(self, numbers: np.ndarray, cosines: np.ndarray) -> float:
        """Share of toxic neighbours, each by the inverse of its distance; neighbours that are missing vote the base rate."""
        weights = 1 / (1.05 - np.minimum(cosines, 1))
        missing = (self.k - len(numbers)) / self.k
        return float((weights @ self.index.labels[numbers] + missing * self._rate) / max(1e-12, weights.sum() + missing))

    def _calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Fit a logistic curve from leave-one-out votes to labels by damped Newton steps."""
        x = np.column_stack([votes - 0.5, np.ones(len(votes))])
        w = np.array([4.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ w))
            gradient = x.T @ (p - labels) + 0.1 * w
            hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
            w = w - np.clip(np.linalg.solve(hessian, gradient), -2, 2)
        self._slope, self._offset = max(0.0, w[0]), w[1]

    def judge(self, counts: dict[int, int]) -> tuple[float, list[dict]]:
        """Score and evidence (nearest examples) of a document's terms."""
        terms, weights = self._vector(counts)
        numbers, cosines = self.index.nearest(terms, weights, self.k)
        if not len(numbers):
            return self.without_terms, []
        score = 1 / (1 + np.exp(-(self._slope * (self._vote(numbers, cosines) - 0.5) + self._offset)))
        index = self.index
        return float(score), [{"doc_id": int(index.doc_ids[n]), "cosine": float(c), "toxic": int(index.labels[n])} for n, c in zip(numbers, cosines)]


def train_toxicity(docs: DataFrame, labels: DataFrame, learn, labelled: int = LABELLED, terms: int = TERMS) -> ToxicityModel:
    """A model from ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``toxic``) of ids for which ``learn`` holds.

    At most ``labelled`` labelled ids, those with the smallest hashes, are learned from: terms, examples and
    calibration. A document labelled more than once counts as toxic if any label says so; labels without
    a value, and ids with no document, teach nothing. How many documents have a term is counted over all rows of ``docs``.
    """
    spark = docs.sparkSession
    ids = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    found = docs.select("doc_id", "text").filter(learn(F.col("doc_id"))).join(F.broadcast(chosen), "doc_id")
    # of documents that share an id, always the same one
    texts = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "toxic")).alias("one")).select("doc_id", "one.text", "one.toxic")
    texts.persist()
    totals = {r["toxic"]: r["n"] for r in texts.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                words = set(_WORD.findall((text.as_py() or "").lower()))
                counts.update((t, label > 0) for t in {t for w in words for t in word_terms(w)})
        names = {t for t, _ in counts}
        columns = [pa.array(names, pa.string()), *(pa.array([counts[t, y] for t in names], pa.int64()) for y in (True, False))]
        yield pa.record_batch(columns, ["term", "toxic", "clean"])

    partial = texts.select("text", "toxic").mapInArrow(spread, "term string, toxic bigint, clean bigint")
    table = partial.groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).filter(F.col("a") + F.col("b") >= LEAST_DOCUMENTS)
    part = lambda seen, whole, other: F.when(seen > 0, seen * F.log(seen * (toxic + clean) / (whole * other))).otherwise(0.0)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    ratio = 2 * (part(a, a + b, F.lit(toxic)) + part(b, a + b, F.lit(clean)) + part(toxic - a, toxic + clean - a - b, F.lit(toxic)) + part(clean - b, toxic + clean - a - b, F.lit(clean)))
    share = a / (a + b)
    telling = (share >= 0.5) | (share < toxic / max(1, toxic + clean))  # clear for its label, not merely less rare
    picked = table.filter(telling).select("term", ratio.alias("ratio")).filter(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "term").limit(terms)
    vocabulary = [r["term"] for r in picked.collect()] if toxic and clean else []
    numbers = {t: i for i, t in enumerate(vocabulary)}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(numbers)
        for batch in batches:
            found = [term_counts(t.as_py(), known) for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([list(c) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["doc_id", "toxic", "terms", "counts"])

    rows = texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"), "text")
    examples = rows.mapInArrow(find, "doc_id bigint, toxic int, terms array<int>, counts array<int>").collect()
    texts.unpersist()

    def documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _Known(numbers), Counter()
        for batch in batches:
            seen[-1] += batch.num_rows
            for text in batch.column(0):
                seen.update(term_counts(text.as_py(), known).keys())
        yield pa.record_batch([pa.array(seen.keys(), pa.int32()), pa.array(seen.values(), pa.int64())], ["term", "documents"])

    counted = docs.select("text").mapInArrow(documents_with, "term int, documents bigint").groupBy("term").agg(F.sum("documents").alias("n"))
    frequency = {r["term"]: r["n"] for r in counted.collect()}  # a row per term of the vocabulary at most
    idf = np.array([np.log((1 + frequency.get(-1, 0)) / (1 + frequency.get(i, 0))) + 1 for i in range(len(vocabulary))])
    ordered = sorted(examples, key=lambda r: r["doc_id"])
    return ToxicityModel(vocabulary, idf, [(r["doc_id"], r["toxic"], dict(zip(r["terms"], r["counts"]))) for r in ordered])


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``row`` (the whole row), ``score`` and ``evidence`` of every row, from its whole text alone.

    Texts that are null, empty or without a known term get the share of toxic ones among labelled documents
    without one; a model without labelled rows gives 0. Repeated rows come out equal; nothing is shuffled.
    """
    # as bytes that hold the class as well: executors need no copy of this package
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = cloudpickle.loads(shared.value)
        known = _Known({t: i for i, t in enumerate(model.vocabulary)})
        for batch in batches:
            judged = [model.judge(term_counts(t.as_py(), known)) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([s for s, _ in judged], pa.float64()), pa.array([e for _, e in judged], kind)], ["row", "score", "evidence"])

    rows = docs.select(F.struct("*").alias("row"), F.col("text"))
    evidence = StructType().add("doc_id", "long").add("cosine", "double").add("toxic", "integer")
    return rows.mapInArrow(judge, StructType([rows.schema["row"]]).add("score", "double").add("evidence", ArrayType(evidence)))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose score is below the threshold."""
    return score_toxicity(docs, model).filter(F.col("score") < threshold).select("row.*")
