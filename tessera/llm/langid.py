"""Language identification by multilingual mixture inference.

A language is a smoothed distribution over hashed character trigrams, learnt
from labelled documents.  A document is a bag of trigrams drawn from a mixture
of languages; expectation-maximisation estimates the proportions until they
move by less than ``TOLERANCE``.  The language set is chosen by penalised
likelihood: sets grow in order of the proportions of the full mixture, as long
as a further language raises the log-likelihood by more than
``PENALTY * log(trigrams)``, up to all learnt languages.  The prediction is the
language with the largest proportion in the chosen set, the score that
proportion.

Training counts come from a bounded sample: at most about ``max_train`` labelled
documents, the same share of each language's rows chosen by a hash of id and
text, repeated rows once (a language with fewer than its share keeps all).
Nothing but text and label of these rows enters the model.

Defined results: a text that is null or has no letter gets ``und`` with score
0; with no labelled row at all every text is ``und``; an empty table gives no
rows; ties between languages go to the name that sorts first; repeated rows and
null ids are processed row by row; texts are processed whole, in memory that is
bounded by the trigrams there can be; ``identify`` keeps all other columns (one
named as its ``out_col`` is replaced), ``keep_identified`` all columns,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.textbatch import fresh, map_slices

BINS = 1 << 16
MAX_TRAIN = 20_000
PENALTY = 3.0
SMOOTHING = 0.05
TOLERANCE = 1e-3
#: Trigrams times languages of texts that are worked on at once.
HELD = 1 << 24
UNDETERMINED = "und"

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed trigrams of the letters of ``text`` and how often each occurs.

    Letters are lower-cased; every run of other characters is one space.
    """
    flat = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = letter_table()[flat]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    flat = np.where(letter, flat, np.uint32(32))[keep].astype(np.uint64)
    mixed = (flat[:-2] * np.uint64(0x9E3779B97F4A7C15) + flat[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (
        flat[2:] * np.uint64(0x165667B19E3779F9)
    )
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    grams = np.sort((mixed >> np.uint64(48)).astype(np.uint16), kind="stable")
    first = np.concatenate(([0], np.flatnonzero(np.diff(grams)) + 1))
    return grams[first].astype(np.int64), np.diff(np.append(first, len(grams)))


class Mixture:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: bins x languages."""
        self.languages = languages
        smooth = counts + SMOOTHING
        self.p = (smooth / smooth.sum(0)).astype(np.float32)
        self.log_p = np.log(self.p)

    def _climb(self, p: np.ndarray, c: np.ndarray, lengths: np.ndarray, n: np.ndarray, pi: np.ndarray) -> np.ndarray:
        """Proportions of each text from the start ``pi``, until none moves by ``TOLERANCE``."""
        pi, live = pi.copy(), np.arange(len(pi))
        doc, starts = np.repeat(live, lengths), np.cumsum(lengths) - lengths
        while len(live):
            w = p * pi[live][doc]
            w *= (c / w.sum(1))[:, None]
            new = np.add.reduceat(w, starts, axis=0) / n[live][:, None]
            moved = np.abs(new - pi[live]).max(1) >= TOLERANCE
            pi[live] = new
            if moved.all():
                continue
            # Texts that have come to rest leave.
            keep = np.repeat(moved, lengths)
            live, lengths, p, c = live[moved], lengths[moved], p[keep], c[keep]
            doc, starts = np.repeat(np.arange(len(live)), lengths), np.cumsum(lengths) - lengths
        return pi

    def _best_sets(self, grams: np.ndarray, c: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions in the chosen set of each text, and the size of the set."""
        starts, k = np.cumsum(lengths) - lengths, len(self.languages)
        n = np.add.reduceat(c, starts)
        rows = np.arange(len(lengths))
        p = self.p[grams]
        alone = np.add.reduceat(c[:, None] * self.log_p[grams], starts, axis=0)
        one = alone.argmax(1)
        mix = np.zeros((len(rows), k), dtype=np.float32)
        mix[rows, one] = 1
        value, size = alone.max(1).astype(np.float64), np.ones(len(rows), dtype=np.int64)
        if k == 1:
            return mix, size
        full = self._climb(p, c, lengths, n, np.full((len(rows), k), 1 / k, dtype=np.float32))
        full[rows, one] += 1  # the best single language heads every set
        order = np.argsort(-full, axis=1, kind="stable")
        full[rows, one] -= 1
        cost = PENALTY * np.log(n + 1)
        live = rows
        for m in range(2, k + 1):
            pi = np.zeros((len(live), k), dtype=np.float32)
            chosen = order[live, :m]
            np.put_along_axis(pi, chosen, np.take_along_axis(full[live], chosen, 1) + 1e-3, 1)
            pi /= pi.sum(1, keepdims=True)
            pi = self._climb(p, c, lengths, n[live], pi)
            doc, starts = np.repeat(np.arange(len(live)), lengths), np.cumsum(lengths) - lengths
            gain = np.add.reduceat(c * np.log((p * pi[doc]).sum(1)), starts) - cost[live] * (m - 1)
            better = gain > value[live]
            won = live[better]
            value[won], mix[won], size[won] = gain[better], pi[better], m
            if not better.any():
                break
            keep = np.repeat(better, lengths)
            live, lengths, p, c = won, lengths[better], p[keep], c[keep]
        return mix, size

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[int]]:
        """Language, its proportion and the size of the chosen set for each text."""
        names, scores, sizes = [UNDETERMINED] * len(texts), [0.0] * len(texts), [0] * len(texts)
        bags = [trigrams(t) for t in texts]
        rows = [i for i, b in enumerate(bags) if len(b[0])] if self.languages else []
        most, at = max(1, HELD // max(1, len(self.languages))), 0
        while at < len(rows):
            to, held = at, 0
            while to < len(rows) and (to == at or held + len(bags[rows[to]][0]) <= most):
                held += len(bags[rows[to]][0])
                to += 1
            part = [bags[i] for i in rows[at:to]]
            lengths = np.array([len(b[0]) for b in part])
            mix, size = self._best_sets(np.concatenate([b[0] for b in part]), np.concatenate([b[1] for b in part]).astype(np.float32), lengths)
            top = mix.argmax(1)
            for j, i in enumerate(rows[at:to]):
                names[i] = self.languages[int(top[j])]
                scores[i] = float(min(1.0, mix[j, top[j]]))
                sizes[i] = int(size[j])
            at = to
        return names, scores, sizes


def fit(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_train: int = MAX_TRAIN) -> Mixture:
    """Language models from rows with a label; unlabelled rows are ignored."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    have = {r[0]: r[1] for r in rows.groupBy(lang_col).count().toLocalIterator()}
    languages = sorted(have)
    if not languages:
        return Mixture([], np.zeros((BINS, 0)))
    share = max_train / len(languages)
    steps = 1 << 20
    bound = F.lit(0)
    for lang in languages:
        bound = F.when(F.col(lang_col) == lang, int(min(1.0, share / have[lang]) * steps)).otherwise(bound)
    # Repeated rows have one hash: once is enough, and the bound holds.
    sample = rows.select(id_col, text_col, lang_col).where(F.pmod(F.xxhash64(id_col, text_col), F.lit(steps)) < bound).distinct()
    place = {lang: i for i, lang in enumerate(languages)}

    def count(batches):
        total = np.zeros((len(place), BINS), dtype=np.int64)
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams, n = trigrams(text)
                total[place[lang], grams] += n
        which, gram = np.nonzero(total)
        for k in range(0, len(which), 10_000):
            part = slice(k, k + 10_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(which[part], pa.int32()), pa.array(gram[part], pa.int32()), pa.array(total[which[part], gram[part]])],
                names=["lang", "gram", "n"],
            )

    counted = sample.select(text_col, lang_col).mapInArrow(count, "lang int, gram int, n long")
    counts = np.zeros((BINS, len(languages)))
    for r in counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.gram, r.lang] = r.n
    return Mixture(languages, counts)


_PREDICTED = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("n_langs", T.IntegerType()),
    ]
)


def identify(docs: DataFrame, model: Mixture, *, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out_col`` (lang_pred, score, n_langs)."""
    docs = docs.drop(out_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores, sizes = shared.value.predict(batch.column(text_col).to_pylist())
        values = pa.StructArray.from_arrays(
            [pa.array(names), pa.array(scores, pa.float64()), pa.array(sizes, pa.int32())], names=_PREDICTED.names
        )
        return batch.append_column(out_col, values)

    return docs.mapInArrow(map_slices(text_col, work), T.StructType([*docs.schema.fields, T.StructField(out_col, _PREDICTED)]))


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def language_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2, **options) -> DataFrame:
    """Predictions for all rows by a model that never saw the held-out fold."""
    out = F.coalesce(fold_of(id_col, folds) == held_out, F.lit(False))
    model = fit(docs.where(~out), text_col=text_col, lang_col=lang_col, id_col=id_col, **options)
    column = fresh([id_col, text_col], "language")
    found = identify(docs.select(id_col, text_col), model, text_col=text_col, out_col=column)
    return found.select(id_col, out.alias("held_out"), *[F.col(column)[c].alias(c) for c in _PREDICTED.names])


def keep_identified(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", min_score: float = 0.5, **options) -> DataFrame:
    """``docs`` without rows whose language is undetermined or below ``min_score``."""
    model = fit(docs, text_col=text_col, lang_col=lang_col, id_col=id_col, **options)
    column = fresh(docs.columns, "language")
    found = identify(docs, model, text_col=text_col, out_col=column)
    got = F.col(column)
    return found.where((got["lang_pred"] != UNDETERMINED) & (got["score"] >= min_score)).drop(column)
