"""Short stretches are searched abreast; their ids are those of merging and of the search one by one."""

import random

import pytest

from tidemark.llm import pieces

MERGES = ["th", "he", "in", "▁t", "▁th", "er", "the", "▁the", "an", "ing", "ther", "aa", "aaaa", "▁a", "hing", "thing", "▁an", "nth"]


def vocabulary():
    names = sorted(set("".join(MERGES))) + MERGES
    return pieces.Vocabulary({p: (k + 256, -float(k)) for k, p in enumerate(names)}, list(range(256)), 999, merged=True)


def merged(v, text):
    parts = list(text)
    while True:
        known = [(-v.pieces[a + b][1], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in v.pieces]
        if not known:
            return parts
        k = min(known)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def merged_ids(v, text):
    parts = merged(v, pieces.SPACE + text.replace(" ", pieces.SPACE)) if text else []
    return [i for p in parts for i in ([v.pieces[p][0]] if p in v.pieces else p.encode())]


def some_texts(letters, n=300):
    rng = random.Random(5)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(n)] + ["", "a" * 500, "  the  thing", "théthe"]


@pytest.mark.parametrize("small", [False, True])
def test_ids_are_those_of_merging(monkeypatch, small):
    if small:  # memories and groups that hold next to nothing
        for name, n in {"REMEMBERED": 4, "PAIRS": 4, "PLACES": 4, "WAITING": 3, "ABREAST": 9}.items():
            monkeypatch.setattr(pieces, name, n)
    v, texts = vocabulary(), some_texts(["t", "h", "e", "in", "er", "an", "g", " ", "aa", ".", "é", "\n", "x", "日"])
    found = v.packed(texts)
    assert [pieces.unpacked(x).tolist() for x in found] == [merged_ids(v, t) for t in texts]
    assert [v.encode(t) for t in texts] == [merged_ids(v, t) for t in texts]
    assert [v.decode(pieces.unpacked(x).tolist()) for x in found] == texts


def test_new_short_stretches_are_not_searched_one_by_one(monkeypatch):
    v, alone, one_by_one = vocabulary(), [], pieces.Vocabulary.viterbi
    monkeypatch.setattr(pieces.Vocabulary, "viterbi", lambda self, text: alone.append(text) or one_by_one(self, text))
    texts = some_texts(["t", "h", "e", "in", "er", "an", "g", " "])
    texts = [t for t in texts if "é" not in t and len(t) < 200]
    assert [v.encode(t) for t in texts] == [merged_ids(v, t) for t in texts]
    assert all(len(part) > pieces.LONGEST for part in alone)


def test_pairs_hold_as_merging_leaves_them():
    v = vocabulary()
    for a in v.pieces:
        for b in [*v.pieces, "é"]:
            assert v.holds(a, b) == (merged(v, a + b) == [a, b])
