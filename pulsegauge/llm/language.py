"""Language identification: language family first, then one-versus-one linear SVMs inside the family."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegauge.sources.sinks import stored

#: Learned rows per language at most: the bound of the training sample.
PER_LANGUAGE = 1000
#: Hashed character trigrams.
DIMENSION = 4096
#: Weight of the margin losses, and steps of the solver.
COST, STEPS = 10.0, 150
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_KEPT = np.array([b if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in range(256)], np.uint32)


def trigram_counts(text: str) -> np.ndarray:
    """Counts of hashed byte trigrams of a whole text; A-Z lower-cased, anything but letters a space."""
    codes = _KEPT[np.frombuffer(f" {text} ".encode().lower(), np.uint8)]
    first, middle, last = codes[:-2], codes[1:-1], codes[2:]
    mixed = (first * np.uint32(0x9E3779B1)) ^ (middle * np.uint32(0x85EBCA77)) ^ (last * np.uint32(0xC2B2AE3D))
    mixed = (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(20)
    return np.bincount(mixed[middle != 32], minlength=DIMENSION)


def features(texts: list[str]) -> np.ndarray:
    """One row of unit length per text: square roots of trigram shares."""
    x = np.sqrt(np.array([trigram_counts(t) for t in texts], np.float32).reshape(-1, DIMENSION))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = COST, steps: int = STEPS) -> np.ndarray:
    """Weights and bias (last) of a linear SVM with squared hinge loss, by accelerated gradient steps.

    Both classes weigh the same however many rows each has; the order of rows does not matter.
    """
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    share = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum())) * cost
    rate = 1 / (1 + 2 * cost * 2 * 2)  # rows have squared length 2 and the shares sum to twice the cost
    w = ahead = np.zeros(x.shape[1])
    momentum = 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        step = ahead - rate * (ahead - 2 * x.T @ (share * y * slack))
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = step + (momentum - 1) / following * (step - w)
        w, momentum = step, following
    return w


def language_families(centroids: dict[str, np.ndarray]) -> list[list[str]]:
    """Families of related languages: the nearest groups merge (average cosine) down to the square root of their number."""
    groups = [[name] for name in sorted(centroids)]
    unit = {k: v / max(1e-12, np.linalg.norm(v)) for k, v in centroids.items()}
    nearness = lambda a, b: np.mean([unit[i] @ unit[j] for i in a for j in b])
    while len(groups) > max(1, round(len(centroids) ** 0.5)):
        a, b = max(combinations(range(len(groups)), 2), key=lambda p: nearness(groups[p[0]], groups[p[1]]))
        groups[a] += groups.pop(b)
    return [sorted(g) for g in groups]


class LanguageModel:
    """Families and the weights of one SVM per pair of families and per pair of languages of a family."""

    def __init__(self, families: list[list[str]], weights: dict[tuple[str, int, int], np.ndarray]):
        self.families = families
        self._pairs = sorted(weights)
        self._matrix = np.array([weights[p] for p in self._pairs]) if weights else np.zeros((0, DIMENSION + 1))

    @staticmethod
    def pairs(families: list[list[str]]) -> list[tuple[str, int, int]]:
        """Names of all SVMs: ("", a, b) for families, (number of the family, a, b) for languages of one."""
        inside = [(str(n), a, b) for n, f in enumerate(families) for a, b in combinations(range(len(f)), 2)]
        return [("", a, b) for a, b in combinations(range(len(families)), 2)] + inside

    def _choose(self, margins: np.ndarray, group: str, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The class most of its duels are won by (ties: larger margins), and a confidence by its closest duel."""
        wins, total = np.zeros((len(margins), count)), np.zeros((len(margins), count))
        closest = np.full((len(margins), count), np.inf)
        for k, (own, a, b) in enumerate(self._pairs):
            if own == group:
                for c, m in ((a, margins[:, k]), (b, -margins[:, k])):
                    wins[:, c] += m > 0
                    total[:, c] += np.clip(m, -1, 1)
                    closest[:, c] = np.minimum(closest[:, c], m)
        best = np.argmax(wins + total / (2 * count + 1), axis=1)
        return best, 1 / (1 + np.exp(-3 * np.clip(closest[np.arange(len(best)), best], -100, 100)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """A language and a score from 0 to 1 for each whole text; texts without a letter are unknown."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.families else []
        if known:
            margins = np.zeros((len(known), 0))
            if len(self._pairs):
                margins = features([texts[i] for i in known]) @ self._matrix[:, :-1].T + self._matrix[:, -1]
            family, sure = self._choose(margins, "", len(self.families))
            for number, languages in enumerate(self.families):
                own = np.flatnonzero(family == number)
                best, inside = self._choose(margins[own], str(number), len(languages))
                for i, language, score in zip(own, best, inside * sure[own]):
                    names[known[i]], scores[known[i]] = languages[language], score
        return names, scores


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text has the remainder; False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def train_language_model(learn: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """A model from ``text`` and ``lang``: rows without either or without a letter teach nothing.

    At most ``per_language`` rows of each language, those with the smallest hashes of their text, are used;
    this bounds every later step. Features are made, and each SVM is trained, in tasks of their own;
    the driver gets one row per language and one per SVM.
    """
    rows = learn.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count_distinct("h").alias("n")).collect()}
    if not counts:
        return LanguageModel([], {})
    # of distinct texts, the hash share first leaves about twice the rows wanted, so the exact choice sorts few
    shares = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2 * per_language / n))))
    near = rows.filter(F.pmod("h", F.lit(1 << 30)) < shares[F.col("lang")] * (1 << 30))
    chosen = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    smallest = chosen.groupBy("lang").agg(F.get(F.array_sort(F.collect_list("h")), F.lit(per_language)).alias("limit"))
    chosen = chosen.join(smallest, "lang").filter(F.col("limit").isNull() | (F.col("h") < F.col("limit")))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [(k, t) for k, t in zip(*(c.to_pylist() for c in batch.columns)) if _LETTER.search(t)]
            x = features([t for _, t in known])
            yield pa.record_batch([pa.array([k for k, _ in known], pa.string()), pa.array([r.astype("<f4").tobytes() for r in x], pa.binary())], ["lang", "x"])

    sample = stored(chosen.select("lang", "text").mapInArrow(describe, "lang string, x binary"), "languages")
    matrix = lambda column: np.frombuffer(b"".join(column), "<f4").reshape(-1, DIMENSION)

    def centroid(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": frame["lang"].iloc[:1], "x": [matrix(frame["x"]).mean(axis=0).tobytes()]})

    centroids = sample.groupBy("lang").applyInPandas(centroid, "lang string, x binary").collect()
    families = language_families({r["lang"]: np.frombuffer(r["x"], "<f4") for r in centroids})
    place = {language: (n, k) for n, f in enumerate(families) for k, language in enumerate(f)}
    parts = []
    for group, a, b in LanguageModel.pairs(families):
        for language, (n, k) in place.items():
            member = n if group == "" else k if group == str(n) else None
            if member in (a, b) and member is not None:
                parts.append((f"{group}/{a}/{b}", language, 1 if member == a else -1))
    weights = {}
    if parts:
        duels = sample.sparkSession.createDataFrame(parts, "duel string, lang string, side int")

        def fit(frame: pd.DataFrame) -> pd.DataFrame:
            order = frame.sort_values(["side", "lang", "x"])
            w = train_svm(matrix(order["x"]), order["side"].to_numpy(np.float64))
            return pd.DataFrame({"duel": frame["duel"].iloc[:1], "w": [w.astype("<f8").tobytes()]})

        for row in sample.join(F.broadcast(duels), "lang").groupBy("duel").applyInPandas(fit, "duel string, w binary").collect():
            group, a, b = row["duel"].split("/")
            weights[group, int(a), int(b)] = np.frombuffer(row["w"], "<f8")
    return LanguageModel(families, weights)


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every row, from its whole text alone.

    Texts that are null, empty or have no letter are ``und`` with score 0, as are all if the model learned
    no language. Rows are judged one by one: repeated rows come out equal, nothing is shuffled.
    """
    # as bytes that hold the class as well: executors need no copy of this package
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = cloudpickle.loads(shared.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                names, scores = known.predict(part.column(1).to_pylist())
                yield pa.record_batch([part.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(judge, "doc_id bigint, lang_pred string, score double")
