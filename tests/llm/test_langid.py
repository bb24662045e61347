"""A rare language keeps contexts of its own beside large ones."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import langid


def texts(seed, letters, n, size):
    """Words of a language, drawn often: many contexts of orders 2 and 3."""
    rng = random.Random(seed)
    words = ["".join(rng.choices(letters, k=rng.randrange(3, 8))) for _ in range(size)]
    return [" ".join(rng.choices(words, k=60)) for _ in range(n)]


def test_a_rare_language_keeps_its_contexts():
    large = {f"l{k}": texts(k, "abcdefghijklmnop", 60, 40) for k in range(4)}
    rare = {"rare": texts(9, "qrstuvwxyz", 6, 15)}
    batch = pd.DataFrame([(lang, t) for lang, ts in (large | rare).items() for t in ts], columns=["lang", "text"])
    table = pd.concat(langid._gram_counts([batch]))
    langs = sorted(table.lang.unique())
    model = langid.Model(langs, table.lang.map({x: k for k, x in enumerate(langs)}).to_numpy(), table.gram.to_numpy(np.int64), table.n.to_numpy(float))
    own = table[table.lang == "rare"]
    alone = langid.Model(["rare"], np.zeros(len(own), int), own.gram.to_numpy(np.int64), own.n.to_numpy(float))
    for text in rare["rare"]:
        assert np.isclose(model.lengths(text)[langs.index("rare")], alone.lengths(text)[0])
    assert all(langs[int(model.lengths(t).argmin())] == lang for lang, ts in (large | rare).items() for t in ts)


@pytest.mark.parametrize("share", [None, 0.004])
def test_code_lengths_against_ppm_by_hand(monkeypatch, share):
    """Contexts as dicts, excluded symbols renormalized, byte by byte. Little text keeps all its contexts."""
    if share:
        monkeypatch.setattr(langid, "LEAST_SHARE", share)
    taught, asked = texts(1, "abcdeé", 40, 30), texts(2, "abcdeé", 3, 30) + ["", "q", "Été 3"]
    table = pd.concat(langid._gram_counts([pd.DataFrame({"lang": "x", "text": taught})]))
    model = langid.Model(["x"], np.zeros(len(table), int), table.gram.to_numpy(np.int64), table.n.to_numpy(float))
    seen = Counter()
    for t in taught:
        b = bytes(3) + t.lower().encode()
        for k in range(3, len(b)):
            for order in range(4):
                seen[b[k - order : k], b[k]] += 1
    total = Counter()
    for (c, _), n in seen.items():
        total[c] += n
    kept = {c for c, n in total.items() if len(c) < 2 or n >= (share or 0) * total[b""]}
    assert (len(kept) == len(total)) == (share is None)
    kept = {c for c in kept if len(c) < 3 or c[1:] in kept}

    def p(context, symbol):
        if context is None:
            return 1 / 256
        own = {s: seen[context, s] for s in range(256) if seen[context, s]}
        shorter = context[1:] if context else None
        if context not in kept or not own:
            return p(shorter, symbol)
        t, u = sum(own.values()), len(own)
        if symbol in own:
            return own[symbol] / (t + u)
        return u / (t + u) * p(shorter, symbol) / (1 - sum(p(shorter, s) for s in own))

    for text in asked:
        b = bytes(3) + text.lower().encode()
        want = -sum(math.log2(p(b[k - 3 : k], b[k])) for k in range(3, len(b)))
        assert abs(model.lengths(text)[0] - want) < 1e-3 * max(1, want)
