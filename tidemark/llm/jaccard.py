"""N-gram Jaccard join by vertical partitioning, exact, without pairs inside groups.

The global order of n-grams (by 64-bit hash) is cut into fragments; a document's n-grams in one
fragment are its segment there. Documents of one size class that link differ in at most D
n-grams, so with more than D fragments they have an equal segment: equal segments are the
candidates. Documents with equal sets are one class from the start. In each bucket of classes
with an equal segment, the class with most support is the leader, and only (leader, member)
pairs are checked; what that leaves unconnected is checked across components. A check counts
the overlap of each fragment by itself and sums the counts per pair.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import packed_row, staged
from .graph import components

#: Fragments in which overlaps are counted separately.
FRAGMENTS = 8
#: Classes of one bucket that are compared in one go.
BUCKET_BLOCK = 512
#: Bits of the sketch that every set has; larger sets have a wider one too.
NARROW = 512
#: Keys of texts that are sent to all tasks at most, some 50 bytes each.
FEW = 100_000
#: Parts that the members of a leader are dealt in.
SALTS = 64
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of k words in a row; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(k, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - size + 1 + j])
    return np.unique(out)


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """A bit for each of at least as many cells as the set has n-grams (a power of two): whether
    an odd number of them falls there. Sets that differ in d n-grams differ in at most d bits."""
    bits = 1 << max(NARROW.bit_length() - 1, (len(s) - 1).bit_length() if len(s) else 0)
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch with fewer cells: cells that fall together add up."""
    while sketch.shape[-1] > words:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


class Partition:
    """Size classes and fragments for a threshold in percent."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("percent must be 50 to 100")
        self.t, self.limits, self.plans = percent, [1], {}
        self.ratio = max(1.05, (100 / percent) ** 3)

    def group(self, n: int) -> int:
        """The class of size n: sizes above limits[g - 1], up to limits[g]."""
        while self.limits[-1] < n:
            self.limits.append(max(self.limits[-1] + 1, int(self.limits[-1] * self.ratio)))
        return int(np.searchsorted(self.limits, n))

    def groups(self, n: int) -> list[int]:
        g = self.group(n)
        return [g, g + 1] if 100 * n >= self.t * (self.limits[g] + 1) else [g]

    def plan(self, g: int) -> tuple[int, int]:
        """(D, number of fragments). Some fragments more than D + 1, as some may be empty."""
        if g not in self.plans:
            while len(self.limits) <= g:
                self.group(self.limits[-1] + 1)
            most = self.limits[g]
            least = max(1, -(-self.t * ((self.limits[g - 1] if g else 0) + 1) // 100))
            d = (100 - self.t) * 2 * most // (100 + self.t)
            empty = (d + 1) * math.exp(-least / (d + 1))
            self.plans[g] = d, d + 1 + (math.ceil(1.3 * empty + 3 * math.sqrt(empty)) if d else 0)
        return self.plans[g]

    def keys(self, s: np.ndarray) -> np.ndarray:
        """The bucket keys of a set: its segments, by class and fragment. Empty segments make no
        key; a set with so many that D differences could spoil all its others is `unsafe`, and
        so adds a key for each n-gram of its prefix. Of any two sets that link, one is safe and
        they share a segment, or both are unsafe and share an n-gram of their prefixes."""
        n, mixed, out, unsafe = len(s), _mixed(s ^ np.uint64(0x5851F42D4C957F2D)), [], False
        for g in self.groups(n):
            d, f = self.plan(g)
            at = ((s >> np.uint64(32)) * np.uint64(f)) >> np.uint64(32)
            begin = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
            sums = np.add.reduceat(mixed, begin)
            out.append(_mixed(sums + _mixed(at[begin] + np.uint64(g << 32) + np.uint64(1))))
            unsafe |= len(begin) - d < 1
        if unsafe:
            out.append(_mixed(s[: n - -(-self.t * n // 100) + 1] + np.uint64(0x2545F4914F6CDD1D)))
        return np.unique(np.concatenate(out))


def _small(batches, rows: int = 500):
    """Arrow's batches in smaller ones, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


def _profile(batches, k, percent):
    part = Partition(percent)
    for batch in _small(batches):
        n, cls, keys, narrow, wide = [], [], [], [], []
        for text in batch.text:
            s = shingle_hashes(text, k)
            n.append(len(s))
            mixed = _mixed(s + np.uint64(len(s)))
            cls.append(int(_mixed(np.array([mixed.sum() + np.uint64(len(s))], np.uint64)).astype(np.int64)[0]) if len(s) else None)
            keys.append(part.keys(s).astype(np.int64) if len(s) else np.empty(0, np.int64))
            sketch = odd_sketch(s)
            narrow.append(_folded(sketch, NARROW // 64).astype(np.int64))
            wide.append(sketch.tobytes() if len(sketch) > NARROW // 64 else None)
        yield pd.DataFrame({"id": batch.id, "text_hash": batch.text_hash, "n": n, "cls": pd.array(cls, "Int64"), "keys": keys, "narrow": narrow, "wide": wide})


def _sets(batches, k):
    """cls, fragment, data: the n-grams of a class's document, cut at the fragments' borders."""
    for batch in _small(batches):
        out = []
        for r in batch.itertuples():
            s = shingle_hashes(r.text, k)
            at = np.searchsorted(s >> np.uint64(61), np.arange(FRAGMENTS + 1))
            out += [(r.cls, f, s[at[f] : at[f + 1]].tobytes()) for f in range(FRAGMENTS) if at[f] < at[f + 1]]
        yield pd.DataFrame(out, columns=["cls", "fragment", "data"])


def _led(batches, columns, compare):
    """Rows are sorted: a leader's own comes before those of its members, by what they are dealt by.
    Yields compare(leader's data, row) of each member's row where that isn't None."""
    leader, held = None, None
    for batch in batches:
        out = []
        for r in batch.itertuples():
            data = np.frombuffer(r.data, np.uint64)
            if r.own:
                leader, held = (r.leader, r.salt, r.fragment), data
            elif leader == (r.leader, r.salt, r.fragment):
                found = compare(held, data, r)
                if found is not None:
                    out.append((r.leader, r.member, *found))
        yield pd.DataFrame(out, columns=columns)


def _with_leaders(pairs: DataFrame, data: DataFrame) -> DataFrame:
    """pairs: leader, member, salt, n1, n2; data: cls, fragment, data. Members' data behind their
    leader's, which travels once for each part of its members."""
    own = pairs.select("leader", "salt").distinct().join(data.withColumnRenamed("cls", "leader").hint("merge"), "leader")
    own = own.select("leader", "salt", "fragment", F.lit(True).alias("own"), F.col("leader").alias("member"), F.lit(0).alias("n1"), F.lit(0).alias("n2"), "data")
    other = pairs.join(data.withColumnRenamed("cls", "member").hint("merge"), "member").select("leader", "salt", "fragment", F.lit(False).alias("own"), "member", "n1", "n2", "data")
    dealt = ["leader", "salt", "fragment"]
    return own.unionByName(other).repartition(*dealt).sortWithinPartitions(*dealt, F.desc("own"))


def _sized(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _near(differ, a, b, percent: int):
    """Sets that differ in d n-grams differ in at most d bits of their sketches."""
    return (100 + percent) * differ <= (100 - percent) * (a + b)


def _check(pairs: DataFrame, classes: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """The (leader, member) of pairs that link. Sizes and narrow sketches rule out most others,
    wide sketches those of large sets; the sets of the rest are made again from one document of
    each class. Joins are sort-merge at every size."""
    small = classes.select("cls", "n", "narrow").hint("merge")
    pairs = pairs.join(small.select(F.col("cls").alias("leader"), F.col("n").alias("n1"), F.col("narrow").alias("s1")), "leader")
    pairs = pairs.join(small.select(F.col("cls").alias("member"), F.col("n").alias("n2"), F.col("narrow").alias("s2")), "member")
    differ = sum((F.bit_count(F.col("s1")[i].bitwiseXOR(F.col("s2")[i])) for i in range(NARROW // 64)), F.lit(0))
    pairs = pairs.where(_sized("n1", "n2", percent) & _near(differ, F.col("n1"), F.col("n2"), percent))
    # a leader of very many members goes with each part of them
    pairs = staged(pairs.select("leader", "member", "n1", "n2", F.pmod(F.xxhash64("member"), F.lit(SALTS)).alias("salt")))
    large = F.least("n1", "n2") > NARROW

    def may(held, data, r):
        words = min(len(held), len(data))
        differ = int(np.bitwise_count(_folded(held, words) ^ _folded(data, words)).sum())
        return (r.n1, r.n2, r.salt) if _near(differ, r.n1, r.n2, percent) else None

    wide = classes.where("wide is not null").select("cls", F.lit(0).alias("fragment"), F.col("wide").alias("data"))
    near = _with_leaders(pairs.where(large), wide).mapInPandas(lambda b: _led(b, ["leader", "member", "n1", "n2", "salt"], may), "leader long, member long, n1 int, n2 int, salt long")
    pairs = staged(pairs.where(~large).unionByName(near))

    wanted = pairs.select(F.col("leader").alias("cls")).unionByName(pairs.select(F.col("member").alias("cls"))).distinct()
    wanted = staged(wanted.join(classes.select("cls", "of.id", "of.text_hash").hint("merge"), "cls"))
    texts = rows.select("id", "text_hash", "text")
    if wanted.count() <= FEW:
        # few texts are picked out where they lie; of many, all are dealt by key
        texts = texts.join(F.broadcast(wanted.select("id", "text_hash")), ["id", "text_hash"], "left_semi")
    sets = texts.join(wanted.hint("merge"), ["id", "text_hash"])
    sets = staged(sets.mapInPandas(lambda b: _sets(b, k), "cls long, fragment int, data binary").dropDuplicates(["cls", "fragment"]))
    overlap = lambda held, data, r: (len(np.intersect1d(held, data, assume_unique=True)), r.n1, r.n2)
    counted = _with_leaders(pairs, sets).mapInPandas(lambda b: _led(b, ["leader", "member", "overlap", "n1", "n2"], overlap), "leader long, member long, overlap long, n1 int, n2 int")
    summed = counted.groupBy("leader", "member").agg(F.sum("overlap").alias("overlap"), F.first("n1").alias("n1"), F.first("n2").alias("n2"))
    linked = summed.where(F.col("overlap") * 100 >= (F.col("n1") + F.col("n2") - F.col("overlap")) * percent)
    return linked.select(F.col("leader").alias("a"), F.col("member").alias("b"))


def _one_a_class(full: DataFrame, classes: DataFrame) -> DataFrame:
    """cls and keys of one document of each class, so that a text that many documents share makes no
    key hot. The other documents are left out where they lie if they are few; of many, one of each
    class is taken by dealing all. Repeated rows of the one document stay."""
    one = classes.select("cls", F.col("of.id").alias("one"), F.col("of.text_hash").alias("one_hash"))
    spare = full.select("cls", "id", "text_hash").join(one.hint("merge"), "cls").where("id != one or text_hash != one_hash").select("id", "text_hash").distinct()
    spare = staged(spare)
    if spare.count() <= FEW:
        return full.select("cls", "id", "text_hash", "keys").join(F.broadcast(spare), ["id", "text_hash"], "left_anti")
    return full.groupBy("cls").agg(F.first("keys").alias("keys"))


def _across(batches, percent):
    """Pairs of one bucket and size (of two of its blocks) in different components that sizes and
    narrow sketches don't rule out. A row stands with its own size (`home`) or as the lower
    neighbour of the next: two of the latter meet elsewhere."""
    key, rows = None, []

    def close(rows):
        if not rows:
            return
        cls, root, n, block, home = (np.array([r[j] for r in rows], np.int64) for j in (0, 1, 2, 4, 5))
        alone, bits = key[2] == key[3], np.stack([r[3] for r in rows]).astype(np.int64).view(np.uint64)
        for i in range(len(rows) - 1):
            rest = slice(i + 1, None)
            may = ((block[rest] != block[i]) | alone) & (root[rest] != root[i]) & ((home[rest] == 1) | (home[i] == 1))
            at = np.flatnonzero(may & (100 * np.minimum(n[i], n[rest]) >= percent * np.maximum(n[i], n[rest]))) + i + 1
            differ = np.bitwise_count(bits[i] ^ bits[at]).sum(axis=1, dtype=np.int64)
            at = at[_near(differ, n[i], n[at], percent)]
            yield from ((min(cls[i], cls[j]), max(cls[i], cls[j])) for j in at)

    for batch in batches:
        out = []
        for r in batch.itertuples():
            if (r.key, r.size, r.first, r.second) != key:
                out += close(rows)
                key, rows = (r.key, r.size, r.first, r.second), []
            rows.append((r.cls, r.root, r.n, r.narrow, r.block, r.home))
        yield pd.DataFrame(out, columns=["leader", "member"])
    yield pd.DataFrame(list(close(rows)), columns=["leader", "member"])


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash, n_shingles, component_id of every row.

    Two documents link when 100 * |A & B| >= percent * |A | B| of their sets of k words in a
    row (ASCII case folded). A text of fewer than k words is one n-gram; a text without words,
    or null, is empty, has 0 and is linked with nothing. component_id is the least id that
    links lead to. Repeated rows come as often as they are. A null id takes part as a negative
    number made from its text and is given as null. No set is cut and no bucket dropped.
    """
    kind = dict(docs.dtypes)[id_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("given"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    rows = rows.withColumn("id", F.coalesce("given", -F.pmod("text_hash", F.lit(1 << 61)) - F.lit(1 << 61)))
    profile = staged(rows.select("id", "text_hash", "text").mapInPandas(lambda b: _profile(b, k, percent), "id long, text_hash long, n int, cls long, keys array<long>, narrow array<long>, wide binary"))
    full = profile.where("n > 0")
    classes = staged(full.groupBy("cls").agg(F.min(F.struct("id", "text_hash")).alias("of"), F.first("n").alias("n"), F.first("narrow").alias("narrow"), F.first("wide").alias("wide")))

    # buckets of two classes or more, and what supports each class in them: most keys occur once
    # and go first, by the narrowest rows
    entries = _one_a_class(full, classes).select("cls", F.explode("keys").alias("key"))
    twice = staged(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    # sort-merge at every size: the rare keys grow with the corpus
    close = staged(entries.join(twice.hint("merge"), "key"))
    many = staged(close.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("key", "size"))
    shared = staged(close.join(many.hint("merge"), "key"))
    support = shared.groupBy("cls").agg(F.sum("size").alias("support"))
    ranked = shared.select("key", "cls").join(support.hint("merge"), "cls")
    leaders = ranked.groupBy("key").agg(F.max(F.struct("support", "cls")).alias("top")).select("key", F.col("top.cls").alias("leader"))
    # of its leaders a class is checked with the one that it shares most keys with; what the others
    # would have linked is found among the buckets that stay open
    stars = shared.select("key", "cls").join(leaders.hint("merge"), "key").where("cls != leader").groupBy("leader", F.col("cls").alias("member")).agg(F.count("*").alias("n"))
    stars = staged(stars.groupBy("member").agg(F.max(F.struct("n", "leader")).alias("top")).select(F.col("top.leader").alias("leader"), "member"))

    links = staged(_check(stars, classes, rows, k, percent))
    roots = components(links)

    # buckets that this leaves in several components
    open_ = shared.select("key", "cls").join(roots.withColumnRenamed("node", "cls").hint("merge"), "cls", "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))
    split = open_.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    left = open_.join(split.hint("merge"), "key").join(classes.select("cls", "n", "narrow").hint("merge"), "cls")
    # linked sets are of one size class or of two that follow each other
    own = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent + 0.01)) if percent < 100 else F.col("n").cast("long")
    left = left.withColumn("own", own).withColumn("size", F.explode(F.array(F.col("own"), F.col("own") + 1))).withColumn("home", (F.col("size") == F.col("own")).cast("int"))
    left = staged(left.drop("own"))
    # a bucket of many classes is cut into blocks, and each two blocks meet in a task of their own
    size = left.groupBy("key", "size").agg(F.ceil(F.count("*") / BUCKET_BLOCK).alias("blocks"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("home").alias("any")).where("lo < hi and any = 1").select("key", "size", "blocks")
    left = left.join(size.hint("merge"), ["key", "size"]).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("key", "size", "cls", "root", "n", "narrow", "block", "home", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    dealt = ["key", "size", "first", "second"]
    left = left.repartition(*dealt).sortWithinPartitions(*dealt, "cls")
    across = left.mapInPandas(lambda b: _across(b, percent), "leader long, member long").distinct()
    tested = stars.unionByName(stars.select(F.col("member").alias("leader"), F.col("leader").alias("member")))
    more = _check(staged(across.join(tested.hint("merge"), ["leader", "member"], "left_anti")), classes, rows, k, percent)
    roots = components(links.unionByName(staged(more)))

    ids = classes.select("cls", F.col("of.id").alias("first")).join(roots.withColumnRenamed("node", "cls").hint("merge"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = ids.join(ids.groupBy("root").agg(F.min("first").alias("component")).hint("merge"), "root").select("cls", "component")
    out = profile.select("id", "text_hash", "n", "cls").join(named.hint("merge"), "cls", "left")
    shown = lambda c: F.when(c > -(1 << 61), c).cast(kind)
    return out.select(shown(F.col("id")).alias("id"), "text_hash", F.col("n").cast("long").alias("n_shingles"), shown(F.coalesce("component", "id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies: of each component the row with the least id stays (of rows with equal
    id and text any one, whatever their other columns are), and every document that is linked with
    nothing."""
    found = jaccard_components(docs, k, percent, id_col, text_col)
    # equal ids, null among them, as equal values, so that rows are dealt once for both steps
    key = lambda c: [c.isNull().alias("no_id"), F.coalesce(c.cast("string"), F.lit("")).alias("name"), F.col("text_hash")]
    names = ["no_id", "name", "text_hash"]
    gone = staged(found.where(~F.col("component_id").eqNullSafe(F.col("id"))).select(*key(F.col("id"))).distinct())
    rows = docs.select(packed_row(docs), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    rows = rows.select("row", *key(F.col("id"))).dropDuplicates(names)
    return rows.join(gone.hint("merge"), names, "left_anti").select("row.*")
