"""Fill-in-middle rows by content-defined chunks.

A rolling hash over a text's UTF-8 bytes ends a chunk wherever the bytes themselves say so, so
texts that share a passage share chunks. What a cut needs to know of a chunk (how many code
points begin in it, whether a mark stands in it, and its first and last two bytes, as marks may
lie across an edge) is worked out once and kept under the chunk's content. The summaries of a
text's chunks add up from left to right: the sums say in which chunk a cut lies, and only that
chunk is looked into.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the forms, and how many texts of 100 stay plain, and of the others come suffix first.
MARKS = ("<P>", "<S>", "<M>")
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20
#: Bytes that the rolling hash sees; chunks end at one place of 2^BITS, and are so long at least and at most.
WINDOW, BITS, LEAST, MOST = 16, 8, 64, 4096
#: Bytes that are hashed in one go, and of chunks that one generation of a task's cache holds.
SLAB, KEPT = 1 << 20, 16 << 20
#: Bytes of output that go on together.
BATCH = 16 << 20

_GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "big") for b in range(256)], np.uint32)
_MARKS = tuple(m.encode() for m in MARKS)
_INNER = bytes(range(0x80, 0xC0))  # bytes inside of a code point


def _rolling(data: np.ndarray) -> np.ndarray:
    """At each place the hash of the WINDOW bytes that end there (of fewer at the beginning)."""
    h, k = _GEAR[data], 1
    while k < WINDOW:
        h[k:] += h[:-k] << np.uint32(k)
        k *= 2
    return h


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of data end. Away from the edges of a text they depend on near bytes alone."""
    ends, last, n = [], 0, len(data)
    for at in range(0, n, SLAB):
        first = max(0, at - WINDOW + 1)
        h = _rolling(np.frombuffer(data, np.uint8, min(at + SLAB, n) - first, first))[at - first :]
        for end in (np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + (at + 1)).tolist():
            while end - last > MOST:
                last += MOST
                ends.append(last)
            if end - last >= LEAST:
                ends.append(end)
                last = end
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return ends if last == n else [*ends, n]


class Summaries:
    """What is known of chunks, by their content: a dictionary compares the bytes themselves, so
    chunks of equal hashes are never mixed up. Two generations of KEPT bytes bound its memory."""

    def __init__(self):
        self.new, self.old, self.size = {}, {}, 0

    def of(self, chunk: bytes) -> tuple[int, bool, bytes, bytes]:
        """Code points that begin in the chunk, whether it holds a mark, its first and last two bytes."""
        found = self.new.get(chunk)
        if found is None:
            found = self.old.get(chunk) or (len(chunk.translate(None, _INNER)), any(m in chunk for m in _MARKS), chunk[:2], chunk[-2:])
            if self.size >= KEPT:
                self.new, self.old, self.size = {}, self.new, 0
            self.new[chunk] = found
            self.size += len(chunk)
        return found


class Chunked:
    """A text as chunks and the running sums of their summaries."""

    def __init__(self, data: bytes, summaries: Summaries):
        self.data, self.ends, self.points, self.marked = data, chunk_ends(data), [0], False
        begin, tail = 0, b""
        for end in self.ends:
            n, marked, head, own_tail = summaries.of(data[begin:end])
            self.points.append(self.points[-1] + n)
            self.marked = self.marked or marked or any(m in tail + head for m in _MARKS)
            tail, begin = (tail + own_tail)[-2:], end

    def __len__(self) -> int:
        return self.points[-1]

    def byte_of(self, point: int) -> int:
        """The byte at which a code point begins; of one past the last: the end."""
        if point >= self.points[-1]:
            return len(self.data)
        k = bisect_right(self.points, point) - 1
        begin = self.ends[k - 1] if k else 0
        inside = np.frombuffer(self.data, np.uint8, self.ends[k] - begin, begin)
        return begin + int(np.flatnonzero((inside & 0xC0) != 0x80)[point - self.points[k]])


def arranged(name: str, data: bytes, summaries: Summaries, seed: str = "1", plain: int = PLAIN_PERCENT, suffix_first: int = SUFFIX_FIRST_PERCENT) -> tuple:
    """(n, form, code points of the prefix and of the middle or two None, output)."""
    text = Chunked(data, summaries)
    n, h = len(text), hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    if not data or text.marked or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, data
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    i, j = text.byte_of(a), text.byte_of(b)
    (p, s, m), prefix, middle, suffix = _MARKS, data[:i], data[i:j], data[j:]
    if h[3] % 100 < suffix_first:
        return n, "spm", a, b - a, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", a, b - a, b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", plain: int = PLAIN_PERCENT, suffix_first: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars, output of every row, whole texts.

    The two cuts and the form come from the seed and the id alone; a null id counts as an empty
    one. Null and empty texts, and texts that hold a mark already, stay plain. Repeated rows come
    as often as they are, other columns are ignored, an empty table gives no rows. No row needs
    another one: nothing is shuffled, and a lost task is run again by itself.
    """
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summaries = Summaries()

        def made(ids: pa.Array, out: list[tuple]) -> pa.RecordBatch:
            n, form, prefix, middle, output = zip(*out)
            columns = [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

        for batch in batches:
            ids, names, texts = batch.column("id"), batch.column("name"), batch.column("data")
            out, begin, size = [], 0, 0
            for k in range(len(batch)):
                out.append(arranged(names[k].as_py(), texts[k].as_py(), summaries, seed, plain, suffix_first))
                size += len(out[-1][4])
                if size >= BATCH:
                    yield made(ids.slice(begin, len(out)), out)
                    out, begin, size = [], k + 1, 0
            if out:
                yield made(ids.slice(begin, len(out)), out)

    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form. Each mark is found once: a text that holds one stays plain."""
    p, s, m = MARKS
    body = F.substring(output, len(p) + 1, F.length(output))
    outer, middle = F.substring_index(body, m, 1), F.substring_index(body, m, -1)
    psm = F.concat(F.substring_index(outer, s, 1), middle, F.substring_index(outer, s, -1))
    spm = F.concat(F.substring_index(outer, p, -1), middle, F.substring_index(outer, p, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
