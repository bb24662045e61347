"""Fingerprints against the true share of phrases, and pieces against the model's own encoder."""

import os
import random

import numpy as np
import pytest

from tidemark.llm import fingerprints, pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SF = "/root/testdata/sf0.001"


def phrases(text):
    """LZ78 by hand: each phrase is the shortest that wasn't there before; an unfinished one doesn't count."""
    found, now = set(), b""
    for b in text.encode():
        now += bytes([b])
        if now not in found:
            found.add(now)
            now = b""
    return found


def prose(rng, n):
    known = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    return " ".join(rng.choice(known) for _ in range(n))


def test_likeness_is_near_the_share_of_phrases():
    rng, errors = random.Random(6), []
    for k in range(300):
        a = prose(rng, rng.choice([40, 200, 800]))
        cut = int(len(a) * rng.random())
        b = a[:cut] + prose(rng, 1 + (len(a) - cut) // 5)
        x, y = phrases(a), phrases(b)
        errors.append(fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(b)) - len(x & y) / len(x | y))
    errors = np.array(errors)
    # a bin agrees or not: 64 of them can't be off by more than 0.0625 in the root mean square; what
    # empty bins borrow makes short texts look a little less alike than they are
    assert np.sqrt((errors**2).mean()) < 0.0625 and -0.025 < errors.mean() < 0.01


def test_likeness_of_short_texts():
    one = lambda a, b: fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(b))
    assert one("", "") == 1 and one("a", "a") == 1 and one("", "a") == 0
    assert one("a", "b") < 0.05 and one("ab", "ab") == 1
    rng = random.Random(9)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randint(1, 6))), "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))) for _ in range(400)]
    errors = [one(a, b) - len(phrases(a) & phrases(b)) / len(phrases(a) | phrases(b)) for a, b in pairs]
    assert abs(np.mean(errors)) < 0.05  # few phrases fill many bins, so single ones vary more


@pytest.mark.skipif(not (os.path.isfile(MODEL) and os.path.isdir(SF)), reason="no model or no test data here")
def test_ids_are_those_of_the_models_own_encoder():
    import pyarrow.parquet as pq
    import sentencepiece

    own, v = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.Vocabulary.from_file(MODEL)
    texts = [t for t in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist() if t][:120]
    rng = random.Random(3)
    texts += ["".join(rng.choice("aab eéß\n0日") for _ in range(rng.randint(1, 400))) for _ in range(60)] + ["a" * 500, "ab" * 300, " x  y "]
    plain = [t for t in texts if own.decode(own.encode(t)) == t]  # the model's own normalizing changes the others
    assert len(plain) > 100
    assert sum(v.encode(t) != own.encode(t) for t in plain) == 0
    assert all(v.decode(v.encode(t)) == t for t in texts)
