"""A quality classifier by co-training.

Two logistic classifiers see two views of a page. The content view is its words alone: hashed
pairs of letters, all else dropped. The metadata view is all else: source, language, length,
layout and signs. Both are fitted on labelled rows, and calibrated on others. In each round both
score every document, and those that one is sure of, by its calibrated score, become labelled rows
for the other, whose weights then take a Newton step; the sums over them that the step needs are
made on Spark, for each label by itself, so that both labels keep the weight that they have among
labelled rows. A view takes the step only if its loss on labelled rows that neither fit nor
calibration has seen clearly falls. At the end the calibrated log-odds of both are weighed by a
logistic fit on the rows that were held back, and score all documents; if that gains nothing
clear, the better view stands alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed_row, shared, unshared

#: Labelled rows that the classifiers are fitted on at most, in expectation.
FIT_ROWS = 4000
ROUNDS = 2
#: How sure a view must be of a pseudo-label.
SURE = 0.95
#: Ridge penalty; what pseudo-labels weigh at most beside the labelled rows together.
PENALTY, PSEUDO = 20.0, 0.5
THRESHOLD = 0.5
#: By how many standard errors a round, or both views together, must do better to count.
ERRORS = 2.0
_TEXT, _HASHED = 256, 16
#: Letters in lower case (and all bytes of other scripts) stay, what else there is becomes a space.
_LETTERS = bytes(b if b >= 128 else b | 32 if 97 <= (b | 32) <= 122 else 32 for b in range(256))


def text_view(text: str) -> np.ndarray:
    """Square roots of the shares of hashed pairs of letters."""
    b = np.frombuffer(text.encode("utf-8", "replace").translate(_LETTERS), np.uint8)
    if len(b) < 2:
        return np.zeros(_TEXT, np.float32)
    pairs = (b[:-1].astype(np.uint32) * np.uint32(2654435761) ^ b[1:].astype(np.uint32) * np.uint32(2246822519)) * np.uint32(3266489917)
    return np.sqrt(np.bincount(pairs >> np.uint32(24), minlength=_TEXT) / (len(b) - 1)).astype(np.float32)


def metadata_view(text: str, source: str | None, lang: str | None) -> np.ndarray:
    """Length, layout and signs, and the hashed names of source and language."""
    data = text.encode("utf-8", "replace")
    b = np.frombuffer(data, np.uint8)
    n, words, lines = max(1, len(b)), data.split(), data.count(b"\n") + 1
    upper = np.count_nonzero((b >= 65) & (b <= 90)) / n
    digit = np.count_nonzero((b >= 48) & (b <= 57)) / n
    alpha = np.count_nonzero(((b | 32) >= 97) & ((b | 32) <= 122) | (b >= 128)) / n
    space = np.count_nonzero((b == 32) | ((b >= 9) & (b <= 13))) / n
    distinct = len(set(words)) / max(1, len(words)) * np.log1p(len(words))
    layout = [np.log1p(len(b)), np.log1p(len(words)), np.log1p(lines), np.log1p(len(b) / lines), len(b) / max(1, len(words)), upper, digit, alpha, space, 1 - alpha - digit - space, distinct]
    names = np.zeros(2 * _HASHED)
    names[zlib.crc32((source or "").encode()) % _HASHED] = 1
    names[_HASHED + zlib.crc32((lang or "").encode()) % _HASHED] = 1
    return np.concatenate([layout, names]).astype(np.float32)


def _fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 8) -> np.ndarray:
    """Weights (the last is the intercept) by Newton's method; the intercept isn't penalized."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * curve[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class View:
    """A classifier on standardized features, with its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    #: This view's part in the combined log-odds.
    share: float = 0.5
    bias: float = 0.0

    @classmethod
    def fitted(cls, x, y, penalty):
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale = np.where(scale > 1e-9, scale, 1.0)
        return cls(mean, scale, _fit_logistic(np.clip((x - mean) / scale, -8, 8), y, penalty))

    def standard(self, x):
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def raw(self, x):
        return self.standard(x) @ self.weights[:-1] + self.weights[-1]

    def sums(self, x, y):
        """The number of rows and their gradient at these weights."""
        z = np.hstack([self.standard(x), np.ones((len(x), 1))])
        return np.concatenate([[len(x)], (y - _sigmoid(z @ self.weights)) @ z])

    def stepped(self, x, y, given: np.ndarray, penalty: float) -> View:
        """With the weights after a Newton step on labelled rows and the sums of pseudo-labelled ones of
        either label, whose curvature is taken to be that of labelled rows."""
        z, own, given = np.hstack([self.standard(x), np.ones((len(x), 1))]), self.sums(x, y), given.reshape(2, -1)
        n = given[:, 0]
        # both labels in the labelled rows' proportion; no pseudo-label weighs more than a true one
        weight = PSEUDO * own[0] * np.array([1 - y.mean(), y.mean()])
        scale = np.minimum(1.0, weight / np.maximum(n, 1.0))
        p, ridge = _sigmoid(z @ self.weights), np.full(len(self.weights), penalty)
        ridge[-1] = 1e-6
        curve = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z * (1 + scale @ n / own[0])
        step = np.linalg.solve(curve + np.diag(ridge), own[1:] + scale @ given[:, 1:] - ridge * self.weights)
        return View(self.mean, self.scale, self.weights + np.clip(step, -1, 1))

    def calibrate(self, x, y):
        w = _fit_logistic(self.raw(x)[:, None] / 4, y, 0.1)
        self.slope, self.shift = (float(w[0]) / 4, float(w[1])) if w[0] > 0 else (1.0, 0.0)

    def log_odds(self, x):
        return self.raw(x) * self.slope + self.shift

def _losses(odds: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log losses of log-odds."""
    return np.logaddexp(0, np.where(y >= 0.5, -odds, odds))


def _gains(before: np.ndarray, after: np.ndarray, y: np.ndarray) -> bool:
    """Whether log-odds lose less than those before by more than ERRORS standard errors of the mean."""
    gain = _losses(before, y) - _losses(after, y)
    return bool(gain.mean() > ERRORS * gain.std() / np.sqrt(len(gain)))


def exchanged(views: list[View], text: np.ndarray, meta: np.ndarray) -> list[np.ndarray]:
    """Each view's sums over the rows that the other view is sure of, with its labels: those of label 0,
    then of label 1."""
    p = [_sigmoid(v.log_odds(x)) for v, x in zip(views, (text, meta))]
    out = []
    for view, x, other in ((views[0], text, p[1]), (views[1], meta, p[0])):
        no, yes = other <= 1 - SURE, other >= SURE
        out.append(np.concatenate([view.sums(x[no], np.zeros(no.sum())), view.sums(x[yes], np.ones(yes.sum()))]))
    return out


def _views_of(texts, sources, langs) -> tuple[np.ndarray, np.ndarray]:
    text = [t or "" for t in texts]
    return np.array([text_view(t) for t in text], np.float64).reshape(-1, _TEXT), np.array([metadata_view(t, s, g) for t, s, g in zip(text, sources, langs)], np.float64).reshape(len(text), -1)


def _all_exchanged(docs: DataFrame, views: list[View]) -> list[np.ndarray]:
    """exchanged over all rows of docs (text, source, lang): each task's sums are added up once more,
    so that the driver gets two rows whatever the corpus."""
    given, size = shared(docs.sparkSession, views), [2 * (1 + len(v.weights)) for v in views]

    def sums(batches):
        views, total = unshared(given), [np.zeros(n) for n in size]
        for batch in batches:
            for k in range(0, len(batch), 256):
                b = batch.iloc[k : k + 256]
                for t, x in zip(total, exchanged(views, *_views_of(b.text, b.source, b.lang))):
                    t += x
        yield pd.DataFrame([(v, t.tobytes()) for v, t in enumerate(total)], columns=["view", "sums"])

    def added(batches):
        total: dict = {}
        for batch in batches:
            for r in batch.itertuples():
                total[r.view] = total.get(r.view, 0) + np.frombuffer(r.sums)
        yield pd.DataFrame([(v, x.tobytes()) for v, x in total.items()], columns=["view", "sums"])

    rows = docs.select("text", "source", "lang").mapInPandas(sums, "view int, sums binary").repartition("view").mapInPandas(added, "view int, sums binary").collect()
    out = [np.zeros(n) for n in size]
    for r in rows:
        out[r["view"]] += np.frombuffer(r["sums"])
    return out


def co_train(text, meta, y, pool, rounds: int = ROUNDS, penalty: float = PENALTY) -> list[View] | None:
    """Both views, from labelled rows in a stated order: of a seeded quarter one half calibrates and the
    other judges, the rest fits. pool(views): the sums of exchanged over all documents. A view that
    gains nothing by a round stays as it was; if neither gains, there is no further round."""
    part = np.random.default_rng(11).permutation(len(y)) % 8
    fits, tunes, judges = part < 6, part == 6, part == 7
    if any(len(set(y[rows])) < 2 for rows in (fits, tunes, judges)):
        return None
    x = [text, meta]
    views = [View.fitted(v[fits], y[fits], penalty) for v in x]
    for v, z in zip(views, x):
        v.calibrate(z[tunes], y[tunes])
    for _ in range(rounds):
        after = [v.stepped(z[fits], y[fits], given, penalty) for v, z, given in zip(views, x, pool(views))]
        for v, z in zip(after, x):
            v.calibrate(z[tunes], y[tunes])
        better = [_gains(v.log_odds(z[judges]), a.log_odds(z[judges]), y[judges]) for a, v, z in zip(after, views, x)]
        views = [a if won else v for a, v, won in zip(after, views, better)]
        if not any(better):
            break
    held = ~fits
    for v, z in zip(views, x):
        v.calibrate(z[held], y[held])
    odds = np.stack([v.log_odds(z[held]) for v, z in zip(views, x)], 1)
    w = _fit_logistic(odds / 4, y[held], 0.1)
    one = int(_losses(odds[:, 1], y[held]).mean() < _losses(odds[:, 0], y[held]).mean())
    if min(w[:2]) < 0 or not _gains(odds[:, one], odds @ w[:2] / 4 + w[2], y[held]):
        w = np.array([4.0 * (one == 0), 4.0 * (one == 1), 0.0])  # the better view says all that both do
    views[0].share, views[1].share, views[0].bias = w[0] / 4, w[1] / 4, w[2]
    views[1].bias = 0.0
    return views


def _features(batches):
    for batch in batches:
        text, meta = _views_of(batch.text, batch.source, batch.lang)
        yield pd.DataFrame({"id": batch.id, "y": batch.y, "text_view": [r.tobytes() for r in text], "meta_view": [r.tobytes() for r in meta]})


def _some(rows: DataFrame, expected: int) -> DataFrame:
    """About `expected` of the rows (all, if fewer), by a hash of the id."""
    share = min(1.0, expected / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> list[View] | None:
    """docs: id, text, source, lang; labels: id, y (0 or 1, null rows don't count). None without
    labels of both kinds. Only the bounded labelled sample's features and the sums of a round
    reach the driver; rounds exchange labels over all documents."""
    known = labels.where("id is not null and y is not null").groupBy("id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    chosen = _some(known, fit_rows)
    taught = docs.join(F.broadcast(chosen), "id")  # about fit_rows ids
    rows = taught.select(F.col("id").cast("string").alias("id"), "text", "source", "lang", "y")
    table = rows.mapInPandas(_features, "id string, y double, text_view binary, meta_view binary").toPandas().sort_values(["id", "text_view", "meta_view"], kind="stable")
    if not len(table):
        return None
    text, meta = (np.vstack([np.frombuffer(r) for r in table[c]]) for c in ("text_view", "meta_view"))
    return co_train(text, meta, table.y.to_numpy(), lambda views: _all_exchanged(docs, views), rounds)


def _scored(docs: DataFrame, views: list[View] | None, *given):
    """A column struct(score, text_score, meta_score, fitted) of text, source, lang."""
    held = shared(docs.sparkSession, views)

    @F.pandas_udf("score double, text_score double, meta_score double, fitted boolean")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        views = unshared(held)
        for texts, sources, langs in batches:
            blank = np.array([not (t and t.strip()) for t in texts], bool)
            if views is None:
                one = np.where(blank, 0.0, 1.0)
                yield pd.DataFrame({"score": one, "text_score": one, "meta_score": one, "fitted": False})
                continue
            odds = np.zeros((2, len(texts)))
            for k in range(0, len(texts), 256):
                part = slice(k, k + 256)
                odds[:, part] = [v.log_odds(x) for v, x in zip(views, _views_of(texts.iloc[part], sources.iloc[part], langs.iloc[part]))]
            share = lambda x: np.where(blank, 0.0, _sigmoid(x))
            both = sum(v.share * o + v.bias for v, o in zip(views, odds))
            yield pd.DataFrame({"score": share(both), "text_score": share(odds[0]), "meta_score": share(odds[1]), "fitted": True})

    return scored.asNondeterministic()(*given)


def score(docs: DataFrame, views: list[View] | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, keep..., score, text_score, meta_score, fitted of every row (docs: id, text, source, lang).

    Whole texts are scored, one row at a time in the input's partitions. A text without any
    word (or null) scores 0. Without a classifier (too few labels) every other text scores 1,
    and fitted is false. Null sources and languages are names like others. Equal rows score equally.
    """
    found = _scored(docs, views, "text", "source", "lang")
    return docs.select("id", *keep, found.alias("found")).select("id", *keep, "found.*")


def accepted(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", source_col="source", lang_col="lang", label_id="doc_id", label_col="quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, in the columns of docs. Without a
    classifier only texts without a word go."""
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"))
    views = fit(given, labels.select(F.col(label_id).alias("id"), F.col(label_col).alias("y")))
    found = _scored(docs, views, F.col(text_col), F.col(source_col).cast("string"), F.col(lang_col).cast("string"))
    return docs.select(packed_row(docs), found.alias("found")).where(F.col("found.score") >= threshold).select("row.*")
