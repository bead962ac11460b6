"""Toxicity: character n-gram linear classifier with naive Bayes scaling.

A text's features are the distinct hashed character 4- and 5-grams of its
lower-cased form.  Each feature is scaled by its naive Bayes log-count ratio,
and a logistic regression with L2 penalty is trained on the scaled features
(limited-memory quasi-Newton steps, until the loss falls by less than a
millionth).  Its margin is turned into a probability
by a logistic curve fitted to margins of training texts that the model behind
each margin had not seen.  Scoring sums one weight per distinct n-gram of the
whole text.

Training uses a bounded sample of labelled rows: for each class at most
``max_rows`` rows and about ``max_chars`` characters, chosen by hashes of id and
text, repeated rows once.  The intercept is corrected for the classes' different
sampling shares.

Defined results: a null text is scored as an empty one, which has only the
intercept; an id with several labels counts as toxic if any of them says so;
null labels and null ids of labels are ignored; if only one class is labelled,
every score is that class; with no label at all every score is 0; an empty table
of documents gives no rows; repeated rows and null ids are scored row by row; a
score of exactly 0.5 is predicted as toxic; texts are scored whole; other
columns of either table take no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.langid import fold_of
from tessera.llm.textbatch import map_slices
from tessera.runtime import cut_lineage

BINS = 1 << 18
ORDERS = (4, 5)
MAX_ROWS = 4_000
MAX_CHARS = 5_000_000
CHUNK = 1 << 20
L2 = 0.1
#: Steps end where the loss falls by less than this share of itself.
TOLERANCE = 1e-6
FOLDS = 2


class GramSet:
    """Distinct hashed n-grams of texts; keeps one reusable bitmap."""

    def __init__(self) -> None:
        self.seen = np.zeros(BINS, dtype=bool)

    def __call__(self, text: str | None) -> np.ndarray:
        flat = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        used = []
        for order in ORDERS:
            if len(flat) < order:
                continue
            size = len(flat) - order + 1
            mixed = flat[:size] * np.uint32(0x9E3779B1) + np.uint32(order)
            for k in range(1, order):
                mixed ^= mixed >> np.uint32(15)
                mixed = (mixed + flat[k : k + size]) * np.uint32(0x85EBCA77)
            mixed ^= mixed >> np.uint32(13)
            mixed *= np.uint32(0xC2B2AE3D)
            used.append(mixed >> np.uint32(14))
        if not used:
            return np.zeros(0, dtype=np.int32)
        grams = np.concatenate(used)
        self.seen[grams] = True
        out = np.flatnonzero(self.seen).astype(np.int32)
        self.seen[out] = False
        return out


class Scorer:
    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights.astype(np.float32), float(intercept)
        self.grams: GramSet | None = None

    def score(self, text: str | None) -> float:
        if self.grams is None:
            self.grams = GramSet()
        z = self.intercept + float(self.weights[self.grams(text)].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _minimise(f, x: np.ndarray, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking, until the loss (which only falls) rests."""
    value, grad = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    while True:
        q, alphas = grad.copy(), []
        for s, y, rho in reversed(pairs):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * y
        if pairs:
            s, y, _ = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), alpha in zip(pairs, reversed(alphas), strict=True):
            q += (alpha - rho * (y @ q)) * s
        slope, step = -(grad @ q), 1.0 if pairs else 1.0 / max(1.0, float(np.abs(grad).sum()))
        while True:
            new = x - step * q
            new_value, new_grad = f(new)
            if new_value <= value + 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        s, y = new - x, new_grad - grad
        if s @ y > 1e-12:
            pairs = [*pairs[-memory + 1 :], (s, y, 1 / (s @ y))]
        if new_value > value:
            return x  # no shorter step lowers it
        done = value - new_value <= TOLERANCE * max(1.0, abs(value))
        x, value, grad = new, new_value, new_grad
        if done:
            return x


def train(bags: list[np.ndarray], labels: np.ndarray, *, shift: float = 0.0) -> Scorer:
    """Classifier from the distinct n-grams and 0/1 labels of sampled texts.

    ``shift`` is added to the intercept to undo unequal sampling of classes.
    """
    if not len(labels) or labels.min() == labels.max():
        return Scorer(np.zeros(BINS), -500.0 if not len(labels) or labels[0] == 0 else 500.0)
    weights, intercept = _fit_weights(bags, labels)
    margin, seen = np.zeros(len(labels)), np.zeros(len(labels), dtype=bool)
    place = np.zeros(len(labels), dtype=np.int64)
    for label in (0, 1):  # every fold gets its share of both classes
        place[labels == label] = np.arange((labels == label).sum()) % FOLDS
    for fold in range(FOLDS):
        rest = np.flatnonzero(place != fold)
        if len(np.unique(labels[rest])) < 2:
            continue
        w, b = _fit_weights([bags[i] for i in rest], labels[rest])
        for i in np.flatnonzero(place == fold):
            margin[i], seen[i] = w[bags[i]].sum() + b, True
    slope, offset = _logistic_curve(margin[seen], labels[seen]) if seen.any() else (1.0, 0.0)
    return Scorer(weights * slope, intercept * slope + offset + shift)


def _logistic_curve(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(1) over a margin, by damped Newton steps with smoothed targets."""
    ones, zeros = int((y == 1).sum()), int((y == 0).sum())
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    v = np.array([1.0, 0.0])
    X = np.column_stack([z, np.ones(len(z))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ v, -500, 500)))
        h = (X.T * (p * (1 - p))) @ X + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, X.T @ (target - p))
        v = v + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return (float(v[0]), float(v[1])) if v[0] > 0 else (1.0, 0.0)


def _fit_weights(bags: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    p = np.ones(BINS)
    q = np.ones(BINS)
    for bag, label in zip(bags, labels, strict=True):
        (p if label == 1 else q)[bag] += 1  # a bag holds each n-gram once
    ratio = np.log((p / (labels == 1).sum()) / (q / (labels == 0).sum()))
    kept = p + q >= 5  # at least three sampled texts hold it
    ratio[~kept] = 0
    scale = float(np.sqrt(max(1e-12, np.mean([(ratio[bag] ** 2).sum() for bag in bags]))))
    ratio /= scale
    chunks = _chunks([bag[kept[bag]] for bag in bags])
    sign = np.where(labels == 1, 1.0, -1.0)

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        scaled, grad = (v[:-1] * ratio).astype(np.float32), np.zeros(BINS)
        value, slope = L2 / 2 * float(v[:-1] @ v[:-1]), 0.0
        for first, lengths, starts, flat in chunks:
            full = lengths > 0
            z = np.full(len(lengths), v[-1])
            if len(flat):
                z[full] += np.add.reduceat(scaled[flat], starts[full])
            m = sign[first : first + len(lengths)] * z
            g = -sign[first : first + len(lengths)] / (1 + np.exp(np.clip(m, -500, 500)))
            value += float(np.logaddexp(0, -m).sum())
            slope += float(g.sum())
            grad += np.bincount(flat, weights=np.repeat(g, lengths), minlength=BINS)
        return value, np.append(grad * ratio + L2 * v[:-1], slope)

    v = _minimise(loss, np.zeros(BINS + 1))
    return (v[:-1] * ratio), float(v[-1])


def _chunks(bags: list[np.ndarray]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of bags with about ``CHUNK`` n-grams: first bag, lengths, starts, n-grams."""
    out, first = [], 0
    while first < len(bags):
        to, size = first, 0
        while to < len(bags) and (to == first or size + len(bags[to]) <= CHUNK):
            size += len(bags[to])
            to += 1
        lengths = np.array([len(b) for b in bags[first:to]])
        out.append((first, lengths, np.cumsum(lengths) - lengths, np.concatenate(bags[first:to])))
        first = to
    return out


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = MAX_ROWS,
    max_chars: int = MAX_CHARS,
) -> Scorer:
    """Classifier from the documents that ``labels`` marks 0 or 1."""
    marks = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).cast("int").alias("label"))
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    steps = 1 << 20
    draw = lambda *key: F.pmod(F.xxhash64(*key), F.lit(steps))
    have = {r[0]: r[1] for r in marks.groupBy("label").count().collect()}
    bound = {k: int(min(1.0, max_rows / n) * steps) for k, n in have.items()}
    limit = lambda of: F.when(F.col("label") == 1, of.get(1, 0)).otherwise(of.get(0, 0))
    drawn = marks.where(draw("id") < limit(bound))  # at most about 2 * max_rows ids
    # An id may stand in many rows: each different text of it counts, and is drawn again by that.
    sample = cut_lineage(texts.join(F.broadcast(drawn), "id").distinct())
    size = {r[0]: (r[1], r[2]) for r in sample.groupBy("label").agg(F.count(F.lit(1)), F.sum(F.length("text"))).collect()}
    share = {k: min(1.0, max_rows / n, max_chars / max(1, chars or 0)) for k, (n, chars) in size.items()}
    chosen = sample.where(draw(F.lit(1), "id", "text") < limit({k: int(v * steps) for k, v in share.items()}))
    fitting = {k: bound[k] * v for k, v in share.items()}

    def bag(batches):
        grams = GramSet()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [grams(t).tobytes() for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("label"), pa.array(sets, pa.binary())], names=["label", "grams"])

        yield from map_slices("text", work)(batches)

    bags, marks_of = [], []
    for r in chosen.select("text", "label").mapInArrow(bag, "label int, grams binary").toLocalIterator():
        bags.append(np.frombuffer(r.grams, dtype=np.int32))
        marks_of.append(r.label)
    shift = float(np.log(fitting[0] / fitting[1])) if fitting.get(0) and fitting.get(1) else 0.0
    # Of the negatives a share fitting[0] was taken, of the positives fitting[1].
    return train(bags, np.array(marks_of, dtype=np.int64), shift=shift)


def score(docs: DataFrame, model: Scorer, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(id_col, text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [shared.value.score(t) for t in batch.column(text_col).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(scores, pa.float64())], names=[id_col, "score"])

    return source.mapInArrow(map_slices(text_col, work), T.StructType([source.schema[id_col], T.StructField("score", T.DoubleType())]))


def toxicity_report(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", folds: int = 5, held_out: int = 0, **options) -> DataFrame:
    """Scores for all rows by a model that never saw the held-out fold's labels."""
    out = F.coalesce(fold_of(id_col, folds) == held_out, F.lit(False))
    model = fit(docs, labels.where(~out), id_col=id_col, **options)
    return score(docs, model, id_col=id_col).select(
        id_col, out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
