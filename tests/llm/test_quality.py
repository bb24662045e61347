"""The exchange of pseudo-labels: its sums against a loop, and rounds that help or are refused."""

import numpy as np
import pytest

from tidemark.llm import quality


def made(n, seed=1, noise=1.0):
    """Two views of n rows, each telling the label in its own way."""
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.7).astype(float)
    text = rng.normal(size=(n, 6)) * noise + np.outer(2 * y - 1, [1.2, 0.6, 0, 0, 0, 0])
    meta = rng.normal(size=(n, 4)) * noise + np.outer(2 * y - 1, [0, 1.0, 0.5, 0])
    return text, meta, y


def told(views, x, y):
    odds = sum(v.share * v.log_odds(z) + v.bias for v, z in zip(views, x))
    return [np.mean((o >= 0) == (y == 1)) for o in (odds, *[v.log_odds(z) for v, z in zip(views, x)])]


def test_sums_of_the_exchange_are_those_of_a_loop():
    text, meta, y = made(300)
    views = quality.co_train(text, meta, y, None, rounds=0)
    got = quality.exchanged(views, text, meta)
    for k, (x, other, z) in enumerate(((text, views[1], meta), (meta, views[0], text))):
        want = np.zeros((2, 2 + x.shape[1]))
        for row, seen in zip(x, z):
            p = 1 / (1 + np.exp(-other.log_odds(seen[None])[0]))
            if max(p, 1 - p) < quality.SURE:
                continue
            label = int(p > 0.5)
            q = 1 / (1 + np.exp(-views[k].raw(row[None])[0]))
            want[label] += np.concatenate([[1], (label - q) * np.append(views[k].standard(row[None])[0], 1)])
        assert want[:, 0].min() > 0 and np.allclose(got[k], want.ravel())


@pytest.mark.parametrize("n", [400, 2000])
def test_a_harmful_exchange_is_refused(n):
    text, meta, y = made(n)
    more = made(4000, 2)[:2]
    alone = quality.co_train(text, meta, y, None, rounds=0)

    def wrong(views):
        sums = [s.reshape(2, -1) for s in quality.exchanged(views, *more)]
        return [np.hstack([s[:, :1], -20 * s[:, 1:] - 500]).ravel() for s in sums]

    after = quality.co_train(text, meta, y, wrong, rounds=3)
    assert all(np.array_equal(a.weights, b.weights) for a, b in zip(alone, after))


def test_a_helpful_exchange_is_taken():
    """Few labelled rows leave much to learn from what the other view is sure of."""
    rng = np.random.default_rng(5)
    n, wide = 800, 300
    y = (rng.random(20_000) < 0.5).astype(float)
    signs = rng.normal(size=wide) * 0.08
    text = rng.normal(size=(len(y), wide)) + np.outer(2 * y - 1, signs)
    meta = rng.normal(size=(len(y), 2)) + np.outer(2 * y - 1, [2.0, 2.0])
    pool = lambda views: quality.exchanged(views, text[n:], meta[n:])
    alone = quality.co_train(text[:n], meta[:n], y[:n], pool, rounds=0)
    after = quality.co_train(text[:n], meta[:n], y[:n], pool, rounds=4)
    x = (text[n:], meta[n:])
    assert not np.array_equal(alone[0].weights, after[0].weights)
    assert told(after, x, y[n:])[1] > told(alone, x, y[n:])[1]
    assert told(after, x, y[n:])[0] >= told(alone, x, y[n:])[0] - 0.002


@pytest.mark.parametrize("seed", range(4))
def test_both_views_are_no_worse_than_the_better(seed):
    text, meta, y = made(3000, seed)
    meta = meta + np.random.default_rng(seed).normal(size=meta.shape) * seed * 3
    views = quality.co_train(text[:1500], meta[:1500], y[:1500], None, rounds=0)
    both, *each = told(views, (text[1500:], meta[1500:]), y[1500:])
    assert both >= max(each) - 0.006


def test_too_few_of_a_label_give_no_classifier():
    text, meta, _ = made(40)
    assert quality.co_train(text, meta, np.ones(40), None, rounds=0) is None
