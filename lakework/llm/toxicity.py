"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

The features of a text are densities of a lexicon that is learned from the labelled rows (whole
words and word beginnings, in three strengths), how near its hits stand to second-person words,
and the rates of capitals, punctuation, repeated marks and obfuscated spellings. Neither the
labels of the row itself nor language, source or id enter a score.

Defined cases: a null text is scored as the empty text. Repeated rows and ids are scored row by
row. A label that is null or belongs to no document is left out. Of labels of one id that clash, toxic
counts; a document whose id repeats teaches once, by the least of its texts. Without labelled rows
of both classes every score is the share of toxic labels (0 without labels). An empty table gives an
empty result. Columns other than the named ones are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakework.llm.common import free_name, stored, table

FOLDS = 5
PREFIXES = (4, 5, 6, 7, 8)
TIERS = (0.35, 0.55, 0.8)  # shares from which a unit counts as weak, middling, strong
LEAST_TEXTS = 3  # toxic texts that hold a unit of the lexicon, or one in two hundred
PRIOR = 5.0  # texts of the common share that every unit starts with
WORD = re.compile(r"[^\W\d_]+")
OBFUSCATED = re.compile(r"[^\W\d_][@$!*0134|+]+[^\W\d_]|\b(?:[^\W\d_][.\-_ ]){3,}[^\W\d_]\b")
REPEATED = re.compile(r"([^\w\s])\1{2,}")
# Second-person words of English, French, German and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine euch ihr sie usted ustedes vos tus tú ti".split()
)
NEAR = 6
FEATURES = (
    "weak_density middling_density strong_density weight_density strongest near_second_person second_person_density "
    "capital_rate capital_word_rate punctuation_rate exclamation_rate repeated_rate obfuscation_rate digit_rate log_words"
).split()


def units(word: str) -> list[str]:
    """What the lexicon may hold of a word: the word and its beginnings."""
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


def count_units(texts: list[str], only: set[str] | None = None) -> Counter:
    """In how many of the texts each unit stands; ``only`` names the units that matter."""
    found: Counter = Counter()
    for text in texts:
        own = {u for w in set(WORD.findall(text.lower())) for u in units(w)}
        found.update(own if only is None else own & only)
    return found


def learn_lexicon(toxic: Counter, other: Counter, n_toxic: int, n_other: int) -> dict[str, float]:
    """Share of toxic texts among those that hold a unit, drawn to the common share; units from the weakest tier up.

    A unit that stands in most texts tells nothing, however often it was counted, so it is
    the share and not its significance that counts.
    """
    base = n_toxic / max(1, n_toxic + n_other)
    lexicon = {}
    for unit, a in toxic.items():
        share = (a + PRIOR * base) / (a + other.get(unit, 0) + PRIOR)
        if a >= max(LEAST_TEXTS, n_toxic // 200) and share >= TIERS[0]:
            lexicon[unit] = round(share, 4)
    return lexicon


class _Weights(dict):
    """Strength of a word by the lexicon, remembered up to a bound."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        weight = max((self.lexicon.get(u, 0.0) for u in units(word)), default=0.0)
        if len(self) > 200_000:
            self.clear()
        self[word] = weight
        return weight


def features(text: str | None, weights: _Weights) -> list[float]:
    text = text or ""
    words = WORD.findall(text.lower())
    n, chars = max(1, len(words)), max(1, len(text))
    strength = np.fromiter(map(weights.__getitem__, words), np.float64, len(words))
    hits = np.flatnonzero(strength)
    near = 0.0
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    if len(hits) and second:
        at = np.asarray(second)
        place = np.searchsorted(at, hits)
        gap = np.minimum(
            np.abs(hits - at[np.minimum(place, len(at) - 1)]), np.abs(hits - at[np.maximum(place - 1, 0)])
        )
        near = float((gap <= NEAR).sum()) / n
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(data, minlength=128)
    capitals = int(counts[65:91].sum())
    punctuation = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    shouted = len(re.findall(r"\b[A-Z]{3,}\b", text)) if capitals > 2 else 0
    odd = punctuation > 0
    return [
        *(float((strength >= t).sum()) / n for t in TIERS),
        float(strength.sum()) / n,
        float(strength.max(initial=0.0)),
        near,
        len(second) / n,
        capitals / chars,
        shouted / n,
        punctuation / chars,
        int(counts[33]) / chars,
        len(REPEATED.findall(text)) / n if odd else 0.0,
        len(OBFUSCATED.findall(text)) / n if odd or counts[48:58].any() else 0.0,
        int(counts[48:58].sum()) / chars,
        float(np.log1p(len(words))),
    ]


class BoostedTrees:
    """Logistic gradient boosting of shallow trees on binned features."""

    def __init__(self, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 64, least: float = 4.0, ridge: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)])
        rate = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        self.start = float(np.log(rate / (1 - rate)))
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree, leaf = self._grow(binned, y - p, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            margin += tree[2][leaf]
        return self

    def _grow(self, binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray):
        """A complete tree as (feature, threshold, value) by node; a node without a gain sends all left."""
        nodes = 2 ** (self.depth + 1) - 1
        feature, threshold, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        at = np.zeros(binned.shape[1], np.int64)
        for level in range(self.depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(at == node)
                g, h = gradient[rows], hessian[rows]
                best = (1e-6, -1, 0)
                for f, edges in enumerate(self.edges):
                    if not len(edges) or not len(rows):
                        continue
                    column = binned[f, rows]
                    left_g = np.cumsum(np.bincount(column, g, len(edges) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(column, h, len(edges) + 1))[:-1]
                    right_g, right_h = g.sum() - left_g, h.sum() - left_h
                    gain = left_g**2 / (left_h + self.ridge) + right_g**2 / (right_h + self.ridge) - g.sum() ** 2 / (h.sum() + self.ridge)
                    gain[(left_h < self.least / 4) | (right_h < self.least / 4)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
                if best[1] >= 0:
                    feature[node], threshold[node] = best[1], self.edges[best[1]][best[2]]
                    at[rows] = 2 * node + 1 + (binned[best[1], rows] > best[2])
                else:
                    at[rows] = 2 * node + 1
        g = np.bincount(at, gradient, nodes)
        h = np.bincount(at, hessian, nodes)
        value = self.rate * g / (h + self.ridge)
        return (feature, threshold, value), at

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                right = (f >= 0) & (x[rows, np.maximum(f, 0)] >= threshold[at])
                at = 2 * at + 1 + right
            total += value[at]
        return total


def isotonic(margins: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; gives the blocks' mean margins and smoothed rates, both increasing."""
    order = np.argsort(margins, kind="stable")
    blocks: list[list[float]] = []
    for m, y in zip(margins[order], labels[order]):
        blocks.append([float(m), float(y), 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            m2, y2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + m2, blocks[-1][1] + y2, blocks[-1][2] + n2]
    at = np.array([b[0] / b[2] for b in blocks])
    rate = np.maximum.accumulate([(b[1] + 0.01) / (b[2] + 0.02) for b in blocks])
    return at, rate


class ToxicityModel:
    """Lexicon, trees and calibration, fitted on texts and labels."""

    def __init__(self, texts: list[str], toxic: list[int]) -> None:
        y = np.asarray(toxic, np.float64)
        self.base = float(y.mean()) if len(y) else 0.0
        self.trees: BoostedTrees | None = None
        self.lexicon: dict[str, float] = {}
        if len(y) == 0 or y.min() == y.max():
            return
        # Positives and the rest are dealt apart over the folds, so that each has its share; copies stay together.
        fold = np.empty(len(y), np.int64)
        for label in (0, 1):
            rows = np.flatnonzero(y == label)
            order: dict[str, int] = {}
            fold[rows] = [order.setdefault(texts[i], len(order)) % FOLDS for i in rows]
        x = np.empty((len(y), len(FEATURES)))
        # Copies count once, or a text that is often copied would make a lexicon of its own.
        dealt = [[sorted({texts[i] for i in np.flatnonzero((fold == k) & (y == v))}) for v in (0, 1)] for k in range(FOLDS)]
        # Only units of several toxic texts can enter a lexicon, so the others are never held.
        seen: Counter = Counter()
        for own in dealt:
            seen.update(count_units(own[1]))
        several = {u for u, n in seen.items() if n >= LEAST_TEXTS}
        del seen
        parts = [[count_units(own[v], several) for v in (0, 1)] for own in dealt]
        sums = [sum((p[v] for p in parts), Counter()) for v in (0, 1)]
        distinct = [[len(own[v]) for v in (0, 1)] for own in dealt]
        sizes = [sum(d[v] for d in distinct) for v in (0, 1)]
        for k in range(FOLDS):
            # A row's features come from a lexicon that has not seen its label.
            left = [Counter(sums[v]) for v in (0, 1)]
            for v in (0, 1):
                left[v].subtract(parts[k][v])
            apart_sizes = [sizes[v] - distinct[k][v] for v in (0, 1)]
            weights = _Weights(learn_lexicon(left[1], left[0], apart_sizes[1], apart_sizes[0]))
            for i in np.flatnonzero(fold == k):
                x[i] = features(texts[i], weights)
        apart = np.empty(len(y))
        for k in range(FOLDS):
            rest = fold != k
            apart[~rest] = BoostedTrees().fit(x[rest], y[rest]).margin(x[~rest])
        self.at, self.rate = isotonic(apart, y)
        self.trees = BoostedTrees().fit(x, y)
        self.lexicon = learn_lexicon(sums[1], sums[0], sizes[1], sizes[0])

    def scorer(self):
        """A function from texts to scores, with its own word cache."""
        weights = _Weights(self.lexicon)

        def score(texts: list[str | None]) -> np.ndarray:
            if self.trees is None or not texts:
                return np.full(len(texts), self.base)
            margin = self.trees.margin(np.array([features(t, weights) for t in texts]))
            return np.interp(margin, self.at, self.rate)

        return score


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


MAX_ROWS, MAX_BYTES = 12_000, 64 << 20


def labelled_texts(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> pa.Table:
    """(doc_id, text, toxic) of the documents to learn from, one row per id, in the order of their ids.

    Of the labelled documents that are there, those with the first hashes of their id are taken, up to
    ``max_rows`` and as long as their texts fit ``max_bytes`` together; a text above a sixteenth of
    that is left out. Where labels of one id clash, toxic counts; where texts do, the least one.
    """
    told = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    there = docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    rows = told.join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = stored(rows, "toxicity-labels")  # at most max_rows rows of two numbers
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id")
    size = F.octet_length("text").cast("long")
    texts = texts.where(size <= max_bytes // 16).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    texts = stored(texts.select("doc_id", "text", "toxic", F.xxhash64("doc_id").alias("place")), "toxicity-texts")
    sizes = texts.select("place", "doc_id", size.alias("size")).toArrow().sort_by([("place", "ascending"), ("doc_id", "ascending")])
    fitting = int(np.searchsorted(np.cumsum(sizes["size"].to_numpy()), max_bytes, side="right"))
    if fitting < sizes.num_rows:
        last = sizes.slice(fitting, 1).to_pylist()[0]
        texts = texts.where((F.col("place") < last["place"]) | ((F.col("place") == last["place"]) & (F.col("doc_id") < last["doc_id"])))
    return texts.select("doc_id", "text", "toxic").toArrow().sort_by([("doc_id", "ascending")])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> ToxicityModel:
    """Fit on the rows of :func:`labelled_texts`, whose bounds it takes; held-out ids are never used."""
    rows = labelled_texts(docs, labels, max_rows, max_bytes)
    return ToxicityModel(rows["text"].to_pylist(), rows["toxic"].to_pylist())


def score_documents(docs: DataFrame, model: ToxicityModel, column: str = "toxic_score") -> DataFrame:
    """All columns of ``docs`` and the score of ``text`` in ``column`` (replaced where it is there)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name != column]
    docs = docs.select(*(F.col(f"`{f.name}`") for f in kept))
    schema = docs.select("*", F.lit(0.0).alias(column)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                scores = score(part.column(batch.schema.get_field_index("text")).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*batch.schema.names, column])

    return docs.mapInArrow(run, schema)


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that score below ``threshold``, with their own columns."""
    column = free_name(docs, "_toxic_score")
    scored = score_documents(docs, fit(docs, labels), column)
    return scored.where(F.col(column) < threshold).drop(column)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")), "score")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )
