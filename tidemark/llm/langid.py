"""Language identification by prediction by partial matching.

For each language, a byte context tree of variable order (0 to 3) holds symbol counts. A
context codes a symbol that it has seen with n / (t + u), t symbols in all and u distinct, and
escapes with u / (t + u) to the next shorter context, whose symbols are then only those that
weren't seen above (exclusion, renormalized), down to order -1, where all bytes are equal. So
each context's code lengths are those of a distribution. The statistics are frozen: a text's
code length under a language is the sum over its bytes, and the shortest wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared, unshared

#: Labelled documents a language is fitted on at most (all, if fewer); chosen by hash of the id.
FIT_DOCUMENTS = 1500
#: A context of order 2 or 3 needs such a share of its language's labelled symbols, so a language has 50,000
#: of either order at most, and all that occur if it has fewer symbols than that.
LEAST_SHARE = 2e-5
_PIECE = 1 << 20


def _bytes(text: str) -> np.ndarray:
    """Lower-cased UTF-8 behind three zero bytes, the contexts of a text's beginning."""
    return np.frombuffer(b"\0\0\0" + text.lower().encode("utf-8", "replace"), np.uint8)


def _gram_counts(batches):
    for batch in batches:
        for lang, texts in batch.groupby("lang").text:
            found: dict[int, int] = {}
            for text in texts:
                b = _bytes(text).astype(np.int64)
                if len(b) > 3:
                    grams, n = np.unique(b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:], return_counts=True)
                    for g, k in zip(grams.tolist(), n.tolist()):
                        found[g] = found.get(g, 0) + k
            yield pd.DataFrame({"lang": lang, "gram": list(found.keys()), "n": list(found.values())})


class Tree:
    """One language's context ids and code lengths: arrays, a row for each context that has LEAST_SHARE of
    the symbols, so bounded whatever the labelled texts are."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        sym, near, mid, far = gram & 255, gram >> 8 & 255, gram >> 16 & 255, gram >> 24 & 255
        order0 = self._coded(np.bincount(sym, n, 256), np.full(256, 1 / 256))
        two, three = near * 256 + mid, (near * 256 + mid) * 256 + far
        keep, least = [], LEAST_SHARE * n.sum()
        for order, code in ((2, two), (3, three)):
            ids, at = np.unique(code, return_inverse=True)
            total = np.bincount(at, n, len(ids))
            keep += [(order, int(c)) for c, t in zip(ids, total) if t >= least]
        chosen = set(keep)
        twos = sorted(c for order, c in chosen if order == 2)
        threes = sorted(c for order, c in chosen if order == 3 and (2, c // 256) in chosen)
        size = 256 + len(twos) + len(threes)
        self.second = np.repeat(np.arange(256, dtype=np.int32), 256)  # (near, mid) -> context
        self.third = np.repeat(np.arange(256 + len(twos), dtype=np.int32), 256)  # (context, far) -> context
        id2 = {c: 256 + k for k, c in enumerate(twos)}
        for c, k in id2.items():
            self.second[c] = k
        for k, c in enumerate(threes):
            self.third[id2[c // 256] * 256 + c % 256] = 256 + len(twos) + k
        ctx2 = self.second[two]
        ctx3 = self.third[ctx2 * 256 + far]
        table = np.zeros((size, 256))
        for ctx in (near, np.where(ctx2 >= 256, ctx2, -1), np.where(ctx3 >= 256 + len(twos), ctx3, -1)):
            use = ctx >= 0
            np.add.at(table, (ctx[use], sym[use]), n[use])
        p = np.zeros((size, 256))
        for c in range(256):
            p[c] = self._coded(table[c], order0)
        for c, i in id2.items():
            p[i] = self._coded(table[i], p[c // 256])
        for j, c in enumerate(threes):
            i = 256 + len(twos) + j
            p[i] = self._coded(table[i], p[id2[c // 256]])
        self.bits = (-np.log2(p)).astype(np.float32).ravel()

    @staticmethod
    def _coded(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """The distribution of a context: its own symbols, and the rest by escape."""
        total, distinct = counts.sum(), (counts > 0).sum()
        if not distinct:
            return shorter
        if distinct == 256:
            return counts / total
        rest = np.where(counts > 0, 0, shorter)
        return np.where(counts > 0, counts / (total + distinct), rest / rest.sum() * (distinct / (total + distinct)))


class Model:
    """A tree for each language, of its own contexts: a broadcast grows with the number of
    languages, and no language's contexts push another's out."""

    def __init__(self, langs: list[str], lang_of: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = langs
        trees = [Tree(gram[lang_of == k], n[lang_of == k]) for k in range(len(langs))]
        self.second, self.third = (np.concatenate([getattr(t, name) for t in trees]) for name in ("second", "third"))
        self.bits = np.concatenate([t.bits for t in trees])[:, None]
        self.ends = np.cumsum([[0, 0, 0], *[[len(t.second), len(t.third), len(t.bits)] for t in trees]], axis=0).tolist()

    def lengths(self, text: str) -> np.ndarray:
        """Bits of the whole text under each language."""
        b, out = _bytes(text), np.zeros(len(self.langs))
        for k in range(3, len(b), _PIECE):
            x = b[k - 3 : k + _PIECE].astype(np.int32)
            for lang, (begin, end) in enumerate(zip(self.ends, self.ends[1:])):
                second, third, bits = self.second[begin[0] : end[0]], self.third[begin[1] : end[1]], self.bits[begin[2] : end[2], 0]
                ctx = second[x[2:-1] * 256 + x[1:-2]]
                deep = np.where(ctx >= 256, third[ctx * 256 + x[:-3]], ctx)
                out[lang] += bits[deep * 256 + x[3:]].sum(dtype=np.float64)
        return out


def fit(labelled: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> Model | None:
    """labelled: id, text, lang. None without any usable row."""
    rows = labelled.where("lang is not null and text is not null and text != ''")
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(fit_documents)) / F.count("*")).alias("share"))
    point = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    # a row for each language; texts stay where they are until they are chosen
    some = rows.join(F.broadcast(share), "lang").where(point < F.col("share")).select("lang", "text")
    grams = some.mapInPandas(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = grams.toPandas()
    if not len(table):
        return None
    langs = sorted(table.lang.unique())
    return Model(langs, table.lang.map({x: k for k, x in enumerate(langs)}).to_numpy(), table.gram.to_numpy(np.int64), table.n.to_numpy(np.float64))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, keep..., lang_pred, score of every row; whole texts are scored.

    A null text, an empty one and one without a letter give `und` and score 0, as does every
    text when nothing was learned. score is the winner's share of probability among the
    learned languages, 0 to 1; ties go to the first language in code-point order. Rows are
    scored one by one, so repeated rows get equal results; the input is not shuffled.
    """
    given = shared(docs.sparkSession, model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = unshared(given)
        for texts in batches:
            out = []
            for text in texts:
                if m is None or text is None or not any(map(str.isalpha, text)):
                    out.append(("und", 0.0))
                    continue
                bits = m.lengths(text)
                k = int(bits.argmin())
                out.append((m.langs[k], float(1 / np.exp2(np.maximum(bits[k] - bits, -1000)).sum())))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), *keep, predict.asNondeterministic()(F.col(text_col)).alias("found"))
    return rows.select("id", *keep, "found.*")
