"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other; each model sees the words and the probabilities of the categories before
it.  In training these are out-of-fold predictions, so a later model learns from probabilities as uncertain as those it
meets later.  Models are logistic regressions over selected words and word beginnings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.blocks import batched, begin, trim
from quern.storage import checkpoint, table

#: Labelled rows that the models are fitted on, at most: those whose text has the smallest hashes.
MOST_LABELLED = 8_000
#: Words and word beginnings that the models see, at most.
MOST_FEATURES = 1024
FOLDS = 5
#: Likelihood ratio statistic that a feature must reach against independence of a category.
LEAST_EVIDENCE = 12.0
#: Of the mean loss: weight of half the squared weights, the same for the bias, the gradient at which a fit ends, Newton steps at most.
PENALTY, BIAS_PENALTY, TOLERANCE, MOST_STEPS = 1e-3, 1e-8, 1e-8, 100
#: In the order of the chain; the last one decides.
CATEGORIES = ("low_quality", "toxic")

_LETTERS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5, 6, 7, 8)


def _words(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def _features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


@dataclass
class Chain:
    """Index of each feature and, for each category, weights over features and earlier probabilities, and a bias."""

    features: dict[str, int]
    categories: tuple[str, ...]
    weights: list[np.ndarray]
    biases: list[float]
    #: Probability of the last category from which a text is rejected; out-of-fold predictions chose it.
    threshold: float = 0.5

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse (row, feature, value); a value is 1 + log of how often the feature occurs in the text."""
        starts, index = {f[:3] for f in self.features}, self.features
        row, column, value = [], [], []
        for k, text in enumerate(texts):
            found = Counter(f for w, n in Counter(w for w in _words(text) if w[:3] in starts).items() for f in _features(w) * n if f in index)
            for f, n in found.items():
                row.append(k)
                column.append(index[f])
                value.append(1 + np.log(n))
        return np.array(row, np.int64), np.array(column, np.int64), np.array(value)

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities, one row per text and one column per category."""
        row, column, value = self.rows(texts)
        out = np.zeros((len(texts), len(self.categories)))
        for c, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            out[:, c] = _sigmoid(_scores(row, column, value, len(texts), w, len(self.features)) + out[:, :c] @ w[len(self.features) :] + b)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _scores(row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int, w: np.ndarray, d: int) -> np.ndarray:
    return np.bincount(row, value * w[:d][column], n) if len(row) else np.zeros(n)


def _fit(row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int, d: int, dense: np.ndarray, y: np.ndarray, penalty: float = PENALTY, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, each solved by conjugate gradients and shortened until the loss falls enough.

    ``dense`` holds the earlier categories' probabilities.  The mean loss with a penalty on the weights (and a far smaller
    one on the bias, so that labels of one kind have an optimum too) is strongly convex; its only minimum is reached within
    ``tolerance`` of a zero gradient, or this raises.
    """
    extra = dense.shape[1]
    weight = np.r_[np.full(d + extra, penalty), BIAS_PENALTY]

    def scores(w: np.ndarray) -> np.ndarray:
        return _scores(row, column, value, n, w, d) + dense @ w[d:-1] + w[-1]

    def back(u: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(column, value * u[row], d) if len(row) else np.zeros(d), dense.T @ u, [u.sum()]]) / n

    def loss(w: np.ndarray, z: np.ndarray) -> float:
        return float((np.logaddexp(0, z) - y * z).mean() + (weight * w * w).sum() / 2)

    square = np.concatenate([np.bincount(column, value**2, d) if len(row) else np.zeros(d), (dense**2).sum(0), [n]]) / n
    w = np.zeros(d + extra + 1)
    z = scores(w)
    for _ in range(MOST_STEPS):
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        slope = back(p - y) + weight * w
        size = np.linalg.norm(slope)
        if size <= tolerance:
            return w[:-1], float(w[-1])
        curve = p * (1 - p)
        scale = 1 / (square * curve.mean() + weight)
        step, rest = np.zeros_like(w), -slope
        along = scale * rest
        energy = rest @ along
        for _ in range(10 * len(w)):
            turned = back(curve * (scores(along))) + weight * along
            share = energy / (along @ turned)
            step, rest = step + share * along, rest - share * turned
            if np.linalg.norm(rest) <= min(0.1, size**0.5) * size:
                break
            new = rest @ (scale * rest)
            along, energy = scale * rest + new / energy * along, new
        now, gain, length = loss(w, z), slope @ step, 1.0
        moved = scores(step)
        while loss(w + length * step, z + length * moved) > now + 1e-4 * length * gain + 1e-15 and length > 1e-10:
            length /= 2
        w, z = w + length * step, z + length * moved
    raise ArithmeticError(f"the fit stopped at a gradient of {size:.3g}")


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """text and each category's label (0, 1 or null) of up to ``most`` labelled documents with different texts.

    ``labels`` has doc_id, toxic and, if known, quality.  Rows without a toxic label take no part; of several labels of a
    text the worst counts.
    """
    quality = 1 - F.col("quality") if "quality" in labels.columns else F.lit(None).cast("int")
    worst = [F.max(c).alias(c) for c in CATEGORIES]
    labels = labels.where("toxic is not null").select("doc_id", quality.alias("low_quality"), "toxic").groupBy("doc_id").agg(*worst)
    hashed = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("h"))
    once = hashed.join(labels, "doc_id").groupBy("h").agg(*worst, F.min("doc_id").alias("doc_id"))
    chosen = checkpoint(once.orderBy("h").limit(most).select("doc_id", *CATEGORIES))
    # A text stands for its document: of rows that repeat a doc_id one is kept.
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), *[F.first(c).alias(c) for c in CATEGORIES])
    return table(texts, "labelled")


def _chosen_features(sample: DataFrame) -> dict[str, int]:
    """The features that tell most about any category, half of the room for each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        seen: dict[tuple[int, int], Counter] = {(c, y): Counter() for c in range(len(CATEGORIES)) for y in (0, 1)}
        for batch in batches:
            for text, *marks in zip(*(batch.column(k).to_pylist() for k in range(1 + len(CATEGORIES))), strict=True):
                found = {f for w in set(_words(text)) for f in _features(w)}
                for c, mark in enumerate(marks):
                    if mark is not None:
                        seen[c, int(mark > 0)].update(found)
        schema = pa.schema([("category", pa.int32()), ("feature", pa.string()), ("n1", pa.int64()), ("n0", pa.int64())])
        for c in range(len(CATEGORIES)):
            ones, zeros = seen[c, 1], seen[c, 0]
            yield from batched(((c, f, ones[f], zeros[f]) for f in ones.keys() | zeros.keys()), schema, 50_000)

    sizes = sample.agg(*[F.count_if(F.col(c) > 0).alias(f"a{k}") for k, c in enumerate(CATEGORIES)], *[F.count_if(F.col(c) <= 0).alias(f"b{k}") for k, c in enumerate(CATEGORIES)]).first()
    counts = sample.select("text", *CATEGORIES).mapInArrow(count, "category int, feature string, n1 long, n0 long").groupBy("category", "feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    counts = table(counts.where("n1 > 2"), "counts")
    features: list[str] = []
    for k in range(len(CATEGORIES)):
        n1, n0 = sizes[f"a{k}"], sizes[f"b{k}"]
        if not n1 or not n0:
            continue
        share, a, b = n1 / (n1 + n0), F.col("n1"), F.col("n0")
        both = a + b
        term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
        best = counts.where((F.col("category") == k) & (a > both * share)).withColumn("g", 2 * (term(a, both * share) + term(b, both * (1 - share)))).where(F.col("g") >= LEAST_EVIDENCE)
        features += [r["feature"] for r in best.orderBy(F.desc("g"), "feature").limit(MOST_FEATURES // len(CATEGORIES)).collect()]
    return {f: k for k, f in enumerate(dict.fromkeys(features))}


def fit_chain(row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int, d: int, targets: list[np.ndarray]) -> tuple[list[np.ndarray], list[float], np.ndarray]:
    """Weights and biases of a model for each target, and the out-of-fold probabilities that the later ones were fed.

    A target is nan where a label is unknown; such rows teach that model nothing but get a probability from each fold's.
    """
    weights, biases, earlier = [], [], np.zeros((n, 0))
    fold = np.arange(n) % FOLDS

    def fitted(chosen: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        if not chosen.any():
            return np.zeros(d + earlier.shape[1]), 0.0
        inside = chosen[row]
        renumber = np.cumsum(chosen) - 1
        return _fit(renumber[row[inside]], column[inside], value[inside], int(chosen.sum()), d, earlier[chosen], y[chosen])

    for y in targets:
        known = ~np.isnan(y)
        outside = np.zeros(n)
        for f in range(FOLDS):
            w, bias = fitted(known & (fold != f), y)
            p = _sigmoid(_scores(row, column, value, n, w, d) + earlier @ w[d:] + bias)
            outside[fold == f] = p[fold == f]
        w, bias = fitted(known, y)
        weights.append(w)
        biases.append(bias)
        earlier = np.column_stack([earlier, outside])
    return weights, biases, earlier


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Chain:
    """Fit the chain low_quality, toxic: the last model sees how poor a text is thought to be, and its probability decides.

    Without toxic or without other labelled texts the chain finds nothing toxic; without quality labels the first model
    knows nothing and says one half.  A fit that doesn't reach its optimum raises.
    """
    sample = labelled_sample(docs, labels, most)
    kinds = sample.select(F.count_if(F.col("toxic") > 0).alias("a"), F.count_if(F.col("toxic") <= 0).alias("b")).first()
    if not kinds["a"] or not kinds["b"]:
        return Chain({}, CATEGORIES, [np.zeros(k) for k in range(len(CATEGORIES))], [-40.0] * len(CATEGORIES))
    features = _chosen_features(sample)
    chain = Chain(features, CATEGORIES, [], [])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int32()) for c in CATEGORIES), ("features", pa.list_(pa.int32())), ("amounts", pa.list_(pa.float64()))])

        def rows() -> Iterator[tuple]:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                row, column, value = chain.rows(texts)
                cut = np.searchsorted(row, np.arange(len(texts) + 1))
                for k, (doc, *marks) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, *range(2, 2 + len(CATEGORIES)))), strict=True)):
                    part = slice(cut[k], cut[k + 1])
                    yield doc, *(None if m is None else int(m > 0) for m in marks), column[part].tolist(), value[part].tolist()

        yield from batched(rows(), schema)

    # At most ``most`` rows of a few numbers each.
    kind = "doc_id long, " + "".join(f"{c} int, " for c in CATEGORIES) + "features array<int>, amounts array<double>"
    found = sample.select(F.col("doc_id").cast("long"), "text", *CATEGORIES).mapInArrow(sparse, kind).orderBy("doc_id").collect()
    n, d = len(found), len(features)
    order = [sorted(zip(r["features"], r["amounts"], strict=True)) for r in found]
    row = np.repeat(np.arange(n), [len(o) for o in order])
    column = np.array([c for o in order for c, _ in o], np.int64)
    value = np.array([v for o in order for _, v in o])
    targets = [np.array([np.nan if r[c] is None else r[c] for r in found], float) for c in CATEGORIES]
    chain.weights, chain.biases, outside = fit_chain(row, column, value, n, d, targets)
    chain.threshold = _threshold(outside[:, -1], targets[-1])
    return chain


def _threshold(p: np.ndarray, y: np.ndarray, clean_weight: float = 5.0) -> float:
    """Middle of the gap between probabilities where the hit rate less ``clean_weight`` times the false alarm rate is best."""
    order = np.argsort(-p, kind="stable")
    hits, alarms = np.cumsum(y[order]) / max(1.0, y.sum()), np.cumsum(1 - y[order]) / max(1.0, (1 - y).sum())
    last = np.r_[p[order][1:] < p[order][:-1], True]
    gain = np.where(last, hits - clean_weight * alarms, -np.inf)
    best = int(gain.argmax())
    below = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float(np.clip((p[order][best] + below) / 2, 0.05, 0.95))


def classify(docs: DataFrame, chain: Chain, threshold: float | None = None) -> DataFrame:
    """``docs`` with p_<category> for every category, ``toxic`` (p_toxic at or over ``threshold``, the chain's own if None) and ``kept`` (not toxic).

    Null or wordless text has no features and gets the models' base probabilities; whole texts are read, however long.
    Repeated rows are judged alike, a probability at the threshold is toxic, and an empty table stays empty.  Columns with
    these names are replaced; doc_id may have any type or be null.
    """
    names = [f"p_{c}" for c in chain.categories]
    docs = docs.drop(*names, "toxic", "kept")
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # MOST_FEATURES bounds it

    def predicted(texts: pa.Array) -> pa.Array:
        begin("toxicity")
        # The empty text stands in for null in features only; the row keeps its null.
        p = shared.value.predict(texts.to_pylist())
        trim()
        return pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64()))

    # Texts alone go to Python; the other columns stay where they are.
    judged = docs.withColumn("_p", F.arrow_udf(predicted, "array<double>")("text"))
    docs = judged.withColumns({n: F.get("_p", k) for k, n in enumerate(names)}).drop("_p")
    toxic = F.col("p_toxic") >= (chain.threshold if threshold is None else threshold)
    return docs.withColumns({"toxic": toxic, "kept": ~toxic})
