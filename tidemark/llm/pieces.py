"""SentencePiece encoding by streaming Viterbi, and decoding.

The search goes through a text once, over its boundaries: each has the best path that reaches it
and points back to where its last piece began. It keeps the paths since the last committed
boundary; whenever those of all boundaries that pieces still reach lead through one, the pieces
up to it are final and their ids are committed.

For vocabularies of merged pairs, a step from one piece to the next is allowed if merging the
two pieces' characters leaves just these two, and forbidden otherwise. Pieces that pairwise
hold so are those that merging the whole text gives, so the path is the model's own encoding.
For vocabularies of likelihoods all steps are allowed and the highest sum of scores wins.

Where no piece of the vocabulary spans two neighbouring characters (between words, for usual
vocabularies), the paths always meet, so the stretches between such places are searched once
per task and remembered. Those of a few hundred texts that are new are searched abreast: their
first boundaries together, then their second ones, in numpy.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared, unshared

SPACE = "▁"
#: Stretches that a task remembers twice over at most, and the longest that it does.
REMEMBERED, LONGEST = 150_000, 64
#: Pairs of pieces that a task remembers at most, and places for those that are looked up in numpy (a power of 2).
PAIRS, PLACES = 400_000, 1 << 20
#: Characters that wait for a search, those that are searched abreast, and texts that go on at a time.
WAITING, ABREAST, TEXTS = 1 << 20, 1 << 18, 200
_NEVER = float("-inf")
_SLICE = 1 << 16
_UNKNOWN = "\u2047".encode()


def _pack(ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes()


def unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<i4")


def _cut(joined: set[str]) -> re.Pattern | None:
    """A pattern for stretches that no piece leaves: between runs of SPACE, and if possible also
    between letters and other characters. None where pieces join words."""
    if any(x[1] == SPACE and x[0] != SPACE for x in joined):
        return None
    # numerals such as a raised 2 are letters to a pattern, but stand with other characters
    odd = re.escape("".join(sorted({c for x in joined for c in x if c.isnumeric() and not c.isdecimal() and not c.isalpha()})))
    letter = rf"[^\W\d_{odd}]"
    if any(SPACE not in x and bool(re.match(letter, x[0])) != bool(re.match(letter, x[1])) for x in joined):
        return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
    return re.compile(rf"{SPACE}*(?:{letter}+|(?:[\d_{odd}]|[^\w{SPACE}])+)|{SPACE}+")


class Vocabulary:
    """Pieces with ids and scores. merged: scores are the order of merges, not likelihoods."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int] | None, unknown_id: int, merged: bool = False):
        self.pieces, self.byte_ids, self.unknown_id, self.merged = pieces, byte_ids, unknown_id, merged
        self.longest = max(map(len, pieces), default=1)
        #: unknown characters cost more than any piece
        self.unknown_score = min((s for _, s in pieces.values()), default=0.0) - 10.0
        if any(s > 0 for _, s in pieces.values()):
            raise ValueError("scores of pieces must not be positive")
        #: what ends a piece, and the pieces that end it in turn, longest first
        self.tails: dict[str, tuple[str, ...]] = {}
        same = {p: p for p in pieces}
        for tail in {p[k:] for p in pieces for k in range(len(p))}:
            self.tails[tail] = tuple(same[tail[k:]] for k in range(len(tail)) if tail[k:] in same)
        #: what ids stand for, in bytes
        self.data = {i: p.replace(SPACE, " ").encode() for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids or [])}
        #: neighbouring characters that some piece spans
        self.joined = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        self.cut = _cut(self.joined)
        self.start = "" if merged else 0.0
        #: stretches and their ids, the latest REMEMBERED and those before; pairs of pieces and whether they hold
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        #: how merging makes a piece
        self.grown: dict[str, list[tuple[float, str, str]] | None] = {}
        self.abreast = _Abreast(self) if merged else None

    def growth(self, piece: str) -> list[tuple[float, str, str]] | None:
        """The merges that make a piece of its characters: score, first and last part after each.
        The best score (of equal ones the leftmost) goes first. None where they don't make it."""
        parts, score, steps = list(piece), self.pieces.get, []
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = score(parts[k] + parts[k + 1])
                if found is not None and (best is None or found[1] > best):
                    best, at = found[1], k
            if best is None:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append((best, parts[0], parts[-1]))
        return steps

    def holds(self, before: str, piece: str) -> bool:
        """Whether a path may step from one piece to the next."""
        key = before, piece
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._apart(before, piece)
        return found

    def _apart(self, before: str, piece: str) -> bool:
        """Whether merging both pieces' characters leaves just the two: the merges of either take
        turns, and none across their border comes first."""
        if len(self.grown) >= PAIRS:  # unknown characters are pieces too
            self.grown.clear()
        for p in (before, piece):
            if p not in self.grown:
                self.grown[p] = self.growth(p)
        left, right = self.grown[before], self.grown[piece]
        if left is None or right is None:
            return False
        last, first, i, j = before[-1], piece[0], 0, 0
        while True:
            found = self.pieces.get(last + first)
            across = _NEVER if found is None else found[1]
            ours = left[i][0] if i < len(left) else _NEVER
            theirs = right[j][0] if j < len(right) else _NEVER
            if i < len(left) and ours >= across and ours >= theirs:
                last, i = left[i][2], i + 1
            elif j < len(right) and theirs > across:
                first, j = right[j][1], j + 1
            else:
                return found is None

    @classmethod
    def from_file(cls, path: str, merged: bool = True) -> Vocabulary:
        import sentencepiece

        return cls.from_processor(sentencepiece.SentencePieceProcessor(model_file=path), merged)

    @classmethod
    def from_processor(cls, m, merged: bool = True) -> Vocabulary:
        ids = range(m.get_piece_size())
        usual = {m.id_to_piece(i): (i, m.get_score(i)) for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        named = {m.id_to_piece(i): i for i in ids if m.is_byte(i)}
        return cls(usual, [named[f"<0x{b:02X}>"] for b in range(256)] if len(named) == 256 else None, m.unk_id(), merged)

    def viterbi(self, text: str) -> Iterator[list[int]]:
        """ids of the best path through a text whose spaces are already SPACE, as they become final.

        Boundaries from the last committed one, `done`, on are held. Paths are followed back after
        every `longest` boundaries, or a quarter of those held where they don't meet (as in a run of
        one repeated character), so that the work stays in proportion."""
        n, longest, done, end, checked = len(text), self.longest, 0, 0, 0
        best, back = [self.start], [0]
        while end < n:
            stop = min(n, end + longest)
            if self.merged:
                self._step(text, end + 1, stop, done, best)
                back += [e - len(best[e - done] or " ") for e in range(end + 1, stop + 1)]
            else:
                self._relax(text, end + 1, stop, done, best, back)
            end = stop
            if end < n and end - checked < (end - done) // 4:
                continue
            checked = end
            meet = n if end == n else self._meeting(back, best, done, max(done, end + 1 - longest), end)
            if meet > done:
                yield self._commit(text, back, done, meet)
                del best[: meet - done], back[: meet - done]
                done = meet

    def _step(self, text, first, stop, done, best) -> None:
        """best is the piece that leads to a boundary, None where no path does. At most one path
        leads to each, so the first piece that holds with the one before it is the one."""
        tails, pairs, holds, longest = self.tails, self.pairs.get, self.holds, self.longest
        for e in range(first, stop + 1):
            b, low = e - 1, max(done, e - longest)
            ending = text[b]
            if ending in tails:
                while b > low and (more := text[b - 1 : e]) in tails:
                    ending, b = more, b - 1
                found = tails[ending]
            else:
                found = ()
            if not found and best[-1] is not None:
                found = (text[e - 1],)  # an unknown character
            reached = None
            for piece in found:
                before = best[e - len(piece) - done]
                if before is not None:
                    fine = not before or pairs((before, piece))
                    if fine or (fine is None and holds(before, piece)):
                        reached = piece
                        break
            best.append(reached)

    def _relax(self, text, first, stop, done, best, back) -> None:
        """best is the greatest sum of scores. Ties stay with the longer piece."""
        for e in range(first, stop + 1):
            top, at = best[-1] + self.unknown_score, e - 1
            for b in range(e - 1, max(done, e - self.longest) - 1, -1):
                whole = self.tails.get(text[b:e])
                if whole is None:
                    break
                score = self.pieces.get(text[b:e])
                if score is not None and best[b - done] + score[1] >= top:
                    top, at = best[b - done] + score[1], b
            best.append(top)
            back.append(at)

    @staticmethod
    def _meeting(back, best, done, low, high) -> int:
        """The last boundary on the paths of all reached boundaries low..high: paths walk back,
        the farthest first, until one is left."""
        at = {p for p in range(low, high + 1) if best[p - done] is not None}
        while len(at) > 1:
            far = max(at)
            at.discard(far)
            at.add(back[far - done] if far > done else done)
        return at.pop()

    def _commit(self, text, back, done, meet) -> list[int]:
        found, at = [], meet
        while at > done:
            start = back[at - done]
            piece = self.pieces.get(text[start:at])
            if piece is not None:
                found.append(piece[0])
            elif self.byte_ids is None:
                found.append(self.unknown_id)
            else:
                found += [self.byte_ids[b] for b in reversed(text[start:at].encode("utf-8", "replace"))]
            at = start
        found.reverse()
        return found

    def encode(self, text: str) -> list[int]:
        """A leading space is added and spaces become SPACE; nothing else is normalized."""
        return unpacked(self.packed([text])[0]).tolist()

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers; none of an empty text."""
        out = [bytearray() for _ in texts]
        held, waiting = [], 0
        for known, text in zip(out, texts):
            for parts in self.stretches(SPACE + text.replace(" ", SPACE) if text else ""):
                held.append((known, parts))
                waiting += sum(map(len, parts))
                if waiting >= WAITING:
                    self._settle(held)
                    held, waiting = [], 0
        self._settle(held)
        return [bytes(known) for known in out]

    def _settle(self, held: list[tuple[bytearray, list[str]]]) -> None:
        """Each list of stretches becomes ids, which go to the end of what is known of its text."""
        if len(self.memory) >= REMEMBERED:
            self.older, self.memory = self.memory, {}
        memory, older = self.memory, self.older
        new = set().union(*(parts for _, parts in held)).difference(memory)
        fresh = []
        for part in new:
            ids = older.get(part)
            if ids is None:
                fresh.append(part)
            else:
                memory[part] = ids
        if self.abreast is not None:
            fresh = self.abreast.search(fresh, memory)
        for part in fresh:
            memory[part] = b"".join(map(_pack, self.viterbi(part)))
        for known, parts in held:
            known += b"".join(map(memory.__getitem__, parts))
        for part in fresh:
            if len(part) > LONGEST:
                del memory[part]

    def stretches(self, text: str) -> Iterator[list[str]]:
        """The text cut at places that no piece of this vocabulary spans: before runs of SPACE, and
        between letters and others. A list for each _SLICE characters."""
        if not self.cut:
            yield [text] if text else []
            return
        held = ""
        for k in range(0, len(text), _SLICE):
            *parts, held = self.cut.findall(held + text[k : k + _SLICE])
            yield parts
        yield [held] if held else []

    def decode(self, ids) -> str:
        """The text that ids stand for; bytes in a row are UTF-8, unknown ids U+2047."""
        text = b"".join(map(self.data.get, ids, repeat(_UNKNOWN))).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class _Abreast:
    """The search of Vocabulary.viterbi for merged pairs, over many short stretches at once.

    Pieces that end at a boundary are found by walking back from it through a trie of what ends
    pieces. A node is a place of two arrays: its child by a character is at `base` of the node plus
    the character's number, if `parent` there says so."""

    def __init__(self, v: Vocabulary):
        self.v, self.names = v, list(v.pieces)
        self.ids = np.array([v.pieces[p][0] for p in self.names], "<i4")
        self.sizes = np.array([len(p) for p in self.names] + [0], np.int64)
        #: characters that are pieces, numbered from 1; stretches with others are left to viterbi
        letters = {c: k for k, c in enumerate(sorted(p for p in self.names if len(p) == 1), 1)}
        self.numbers = np.zeros(0x110000, np.int32)
        self.numbers[[ord(c) for c in letters]] = list(letters.values())
        children: dict[str, list[str]] = {}
        for tail in v.tails:
            if all(c in letters for c in tail):
                children.setdefault(tail[1:], []).append(tail)
        size, rng, node = 1 << max(8, 2 + len(v.tails).bit_length()), random.Random(0), {"": 0}
        parent, base = np.full(size + len(letters) + 1, -1, np.int32), np.zeros(size + len(letters) + 1, np.int32)
        taken = bytearray(len(parent))
        taken[0] = 1
        places: dict[str, int] = {}
        for up, tails in sorted(children.items(), key=lambda x: (-len(x[1]), x[0])):
            steps, at = [letters[t[0]] for t in tails], 0
            while any(taken[at + k] for k in steps):
                at = rng.randrange(size)
            places[up] = at
            for t, k in zip(tails, steps):
                taken[at + k], node[t] = 1, at + k
        for up, tails in children.items():
            base[node[up]] = places[up]
            parent[[node[t] for t in tails]] = node[up]
        self.base, self.parent = base, parent
        self.piece = np.full(len(parent), -1, np.int32)
        for k, p in enumerate(self.names):
            if p in node:
                self.piece[node[p]] = k
        #: pairs of pieces, twice their number plus whether they hold; a later pair may take an earlier one's place
        self.kept: np.ndarray | None = None

    def search(self, parts: list[str], memory: dict[str, bytes]) -> list[str]:
        """Puts the ids of parts into memory. Gives those back that are too long, hold other characters or
        have no path."""
        left, group, n = [], [], 0
        for part in parts:
            if len(part) > LONGEST:
                left.append(part)
                continue
            group.append(part)
            n += len(part)
            if n >= ABREAST:
                left += self._search(group, memory)
                group, n = [], 0
        return left + self._search(group, memory) if group else left

    def _search(self, parts, memory) -> list[str]:
        sizes = np.array([len(p) for p in parts])
        letters = self.numbers[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")]
        starts = np.cumsum(sizes) - sizes
        whole = np.minimum.reduceat(letters, starts) > 0
        left = [p for p, fine in zip(parts, whole.tolist()) if not fine]
        if left:
            parts = [p for p, fine in zip(parts, whole.tolist()) if fine]
            letters, sizes = letters[np.repeat(whole, sizes)], sizes[whole]
            if not parts:
                return left
            starts = np.cumsum(sizes) - sizes
        # boundaries of all parts in a row: a part has one more than characters
        first = starts + np.arange(len(parts))
        place = np.arange(len(letters)) - np.repeat(starts, sizes) + 1
        reached = np.full(len(letters) + len(parts), -1, np.int64)
        reached[first] = len(self.names)
        target, piece, order = self._endings(letters, place)
        target += np.repeat(np.arange(1, len(parts) + 1), sizes)[target]
        source = target - self.sizes[piece]
        ends = np.flatnonzero(np.diff(order, append=-1)) + 1
        low = 0
        for high in ends.tolist():
            to, by, before = target[low:high], piece[low:high], reached[source[low:high]]
            fine = (reached[to] < 0) & (before >= 0)
            to, by, before = to[fine], by[fine], before[fine]
            fine = self._hold(before, by)
            reached[to[fine]] = by[fine]
            low = high
        whole = reached[first + sizes] >= 0
        if not whole.all():
            left += [p for p, fine in zip(parts, whole.tolist()) if not fine]
            parts, first, sizes = [p for p, fine in zip(parts, whole.tolist()) if fine], first[whole], sizes[whole]
        found, counts = self._back(reached, first, sizes)
        data, at = found.tobytes(), 0
        for part, n in zip(parts, (4 * counts).tolist()):
            memory[part] = data[at : at + n]
            at += n
        return left

    def _endings(self, letters, place):
        """The pieces that end after each character: its index, the piece and the order of the search,
        by boundaries and for each of them the longest first."""
        at, node, steps = np.arange(len(letters)), np.zeros(len(letters), np.int32), 0
        seen = np.zeros(len(letters), np.int64)
        ats, pieces, ranks = [], [], []
        while len(at):
            down = self.base[node] + letters[at - steps]
            fine = self.parent[down] == node
            at, node = at[fine], down[fine]
            piece = self.piece[node]
            fine = piece >= 0
            ats.append(at[fine])
            pieces.append(piece[fine])
            ranks.append(seen[ats[-1]])
            seen[ats[-1]] += 1
            steps += 1
            fine = place[at] > steps
            at, node = at[fine], node[fine]
        at, piece = np.concatenate(ats), np.concatenate(pieces).astype(np.int64)
        order = place[at] * (LONGEST + 1) + seen[at] - np.concatenate(ranks)
        by = np.argsort(order.astype(np.int16), kind="stable")
        return at[by], piece[by], order[by]

    def _hold(self, before, piece):
        """Vocabulary.holds for arrays; all pieces hold with a start."""
        if self.kept is None:
            self.kept = np.full(PLACES, -1, np.int64)
        pair = before * len(self.sizes) + piece
        slot = ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - PLACES.bit_length())).astype(np.int64)
        kept = self.kept[slot]
        new = np.flatnonzero(kept >> 1 != pair)
        if len(new):
            some, which = np.unique(pair[new], return_inverse=True)
            found = []
            for a, b in zip((some // len(self.sizes)).tolist(), (some % len(self.sizes)).tolist()):
                found.append(a == len(self.names) or self.v.holds(self.names[a], self.names[b]))
            kept[new] = 2 * pair[new] + np.array(found)[which]
            self.kept[slot[new]] = kept[new]
        return (kept & 1).astype(bool)

    def _back(self, reached, first, sizes):
        """The ids of each part's path, one after another, and how many each has."""
        rows, at, steps = np.arange(len(sizes)), sizes.copy(), []
        counts = np.zeros(len(sizes), np.int64)
        while len(rows):
            piece = reached[first[rows] + at[rows]]
            steps.append((rows, piece))
            counts[rows] += 1
            at[rows] -= self.sizes[piece]
            rows = rows[at[rows] > 0]
        out, last = np.empty(counts.sum(), "<i4"), np.cumsum(counts)
        for k, (rows, piece) in enumerate(steps, 1):
            out[last[rows] - k] = self.ids[piece]
        return out, counts


def _shared(df: DataFrame, path: str):
    """The vocabulary, read on the driver; its size is that of one model file."""
    return shared(df.sparkSession, Vocabulary.from_file(path))


def _few(batch: pd.Series) -> Iterator[list[str]]:
    """TEXTS texts at a time or WAITING characters, so that neither they nor their ids wait in numbers."""
    some, size = [], 0
    for t in batch:
        some.append(t or "")
        size += len(some[-1])
        if len(some) == TEXTS or size >= WAITING:
            yield some
            some, size = [], 0
    if some:
        yield some


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids, n_tokens, exact of every row, in the input's partitions.

    A null text counts as empty and gives no ids. exact: decoding gives the text back, as it
    does but where a text holds U+2581 itself, which reads as a space. Ties between segmentations go to
    the one whose last differing piece is longer. Rows are encoded one by one, so repeated rows
    get equal ids; other columns are left out. Ids of documents don't pass through Python.
    """
    given = _shared(docs, model_path)

    @F.pandas_udf("ids array<int>, exact boolean")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        v = unshared(given)
        for texts in (some for batch in batches for some in _few(batch)):
            ids = [unpacked(x) for x in v.packed(texts)]
            yield pd.DataFrame({"ids": ids, "exact": [v.decode(x.tolist()) == t for x, t in zip(ids, texts)]})

    rows = docs.select(F.col(id_col).alias("id"), encode.asNondeterministic()(F.col(text_col)).alias("found"))
    return rows.select("id", "found.ids", F.size("found.ids").cast("long").alias("n_tokens"), "found.exact")


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), n_chars,
    decoded_sha256, exact: whether decoding gives the text back."""
    given = _shared(docs, model_path)

    @F.pandas_udf("n_tokens long, ids_sha256 string, n_chars long, decoded_sha256 string, exact boolean")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        v = unshared(given)
        for texts in batches:
            out = []
            for some in _few(texts):
                for t, ids in zip(some, v.packed(some)):
                    back = v.decode(unpacked(ids).tolist())
                    out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), len(t), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest(), back == t))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "n_chars", "decoded_sha256", "exact"])

    return docs.select(F.col(id_col).alias("id"), digest.asNondeterministic()(F.col(text_col)).alias("found")).select("id", "found.*")


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """id, text of every row. Null ids give a null text."""
    given = _shared(encoded, model_path)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = unshared(given)
        for ids in batches:
            yield pd.Series([None if x is None else v.decode(x.tolist()) for x in ids], dtype=object)

    return encoded.select(F.col(id_col).alias("id"), decode(F.col(ids_col)).alias("text"))
