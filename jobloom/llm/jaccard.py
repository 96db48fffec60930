"""Exact Jaccard join of word n-gram sets by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes, and fragments are ranges of it. Two uses:

Candidates. If J(x, y) >= t, x and y differ in at most d = (1 - t) / t * min(|x|, |y|) n-grams, so among the first d + 1 + m n-grams
of each, m + 1 are common to both (prefix filter). d and m are chosen by size class, a class reaching over a ratio
1 / t; a set uses its own class's prefix and that of the class below, so that any two similar sets meet in the
class of the smaller. Sets that share m + 1 entries of one class, directly or over others, form a candidate cluster.

Counting. Each cluster has a leader, the set that shares most entries. Every member's n-grams are cut once into the fragments of
the global order, fragments of member and leader are counted apart on Spark, and partial overlaps are summed per pair;
members that link with the leader need no further pairs among themselves, and, distances obeying the triangle inequality, none
with members that are far from it. What is left meets in blocks: a task counts the overlaps of one fragment between
two blocks, and the partial counts are summed per block pair. What leaves a block pair is a spanning forest of its
links, so neither copies nor near copies are ever written out as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settled, written
from .components import connected_components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shifts and odd multiplications)."""
    h = (h + np.uint64(salt & (1 << 64) - 1)).astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngram_sets(texts: list[str | None], n: int = 4, chunk: int = 1 << 20) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-grams of lower-cased words; of the whole text if it has fewer words.

    A gram's hash is a polynomial over its bytes, read off prefix sums of the whole chunk, then mixed.
    """
    out: list[np.ndarray] = []
    streams: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        data = np.frombuffer(b"\n".join(streams) + b"\n", np.uint8)
        with np.errstate(over="ignore"):
            power, inverse = np.full(len(data), _BASE, np.uint64), np.full(len(data), _BASE_INVERSE, np.uint64)
            power[0] = inverse[0] = 1
            np.multiply.accumulate(power, out=power)
            np.multiply.accumulate(inverse, out=inverse)
            coded = mixed(np.arange(256, dtype=np.uint64), 0x5851F42D4C957F2D)[data]
            prefix = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(coded * power)])
            blank = (data == 32) | (data == 10)  # streams hold no other white space
            begin = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
            stop = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
            line_end = np.flatnonzero(data == 10)
            upto = np.searchsorted(begin, line_end)  # words before each text's end
            first = 0
            for k in upto.tolist():
                m = k - first
                if m == 0:
                    out.append(np.zeros(0, np.uint64))
                else:
                    a = begin[first : max(first + 1, k - n + 1)]
                    b = stop[min(first + n - 1, k - 1) : k]
                    out.append(np.unique(mixed((prefix[b] - prefix[a]) * inverse[a])))
                first = k
        streams.clear()
        size = 0

    for text in texts:
        streams.append(b" ".join((text or "").encode().translate(_LOWER).split()))
        size += len(streams[-1]) + 1
        if size >= chunk:
            flush()
    if streams:
        flush()
    return out


class Fragments:
    """Size classes for a threshold of num / den, and the first stretch of the order in which similar sets of a class must meet.

    exact takes the plain prefix, in which one common n-gram suffices; the longer one asks for more and gives far fewer candidates.
    """

    def __init__(self, num: int, den: int, largest: int = 1 << 40, exact: bool = False):
        self.num, self.den, self.exact = num, den, exact
        bounds = [1.0]
        while bounds[-1] < largest:
            bounds.append(bounds[-1] * den / num)
        self.bounds = np.array(bounds)

    def size_class(self, n: int) -> int:
        return int(np.searchsorted(self.bounds, n, "right")) - 1

    def scheme(self, c: int) -> tuple[int, int, int]:
        """Most differing n-grams of a pair whose smaller set is in class c, the length of the prefixes, and how many entries beyond one they share."""
        least, largest = int(np.ceil(self.bounds[c])), int(np.ceil(self.bounds[c + 1])) - 1
        d = (self.den - self.num) * largest // self.num
        more = 0 if self.exact else max(0, min(max(6, d // 4), least - d - 1))
        return d, d + 1 + more, more

    def entries(self, grams: np.ndarray, s: int) -> np.ndarray:
        """The set's prefix entries in size class s."""
        d, length, _ = self.scheme(s) if s >= 0 else (0, 0, 0)
        if d == 0:
            return np.zeros(0, np.uint64)  # such sets link only if equal
        with np.errstate(over="ignore"):
            return mixed(grams[:length] + np.uint64(s << 32) * _BASE)


def _describe(n: int, num: int, den: int, exact: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fragments, seen, none = Fragments(num, den, exact=exact), set(), np.zeros(0, np.uint64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                sets = ngram_sets(some.column(1).to_pylist(), n)
                own, low, s1, s2, size = [], [], [], [], []
                for grams in sets:
                    with np.errstate(over="ignore"):
                        a, b = np.add.reduce(mixed(grams, 1), dtype=np.uint64), np.add.reduce(mixed(grams, 2), dtype=np.uint64)
                    s1.append(a)
                    s2.append(b)
                    c = fragments.size_class(len(grams)) if len(grams) else -1
                    size.append(c)
                    # copies within a task give their entries once
                    skip = len(grams) == 0 or a in seen
                    own.append(none if skip else fragments.entries(grams, c))
                    low.append(none if skip else fragments.entries(grams, c - 1))
                    seen.add(a)
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(e) for e in part])]).astype(np.int32)), pa.array(np.concatenate([none, *part]).view(np.int64)))
                    for part in (own, low)
                ]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([len(g) for g in sets], pa.int64()), pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)), pa.array(size, pa.int32()), *lists],
                    ["doc_id", "n_shingles", "s1", "s2", "class", "own", "low"],
                )

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray], grams_a_fragment: int = 1024) -> np.ndarray:
    """|x & y| for all x of left, y of right: partial overlaps of fragments of the common n-grams, summed."""
    lg, rg = np.concatenate(left), np.concatenate(right)
    li, ri = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    common = np.intersect1d(lg, rg)
    total = np.zeros((len(left), len(right)), np.float32)
    if len(common) == 0:
        return total

    def placed(grams: np.ndarray, rows: np.ndarray):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        hit = common[at] == grams
        at, rows = at[hit], rows[hit]
        order = np.argsort(at, kind="stable")
        return at[order], rows[order]

    (la, lr), (ra, rr) = placed(lg, li), placed(rg, ri)
    nl, nr = np.bincount(la, minlength=len(common)), np.bincount(ra, minlength=len(common))
    rare = nl * nr <= 64
    # rare n-grams: their few pairs one by one, so many left occurrences at a time
    start = np.cumsum(nr) - nr
    own = np.flatnonzero(rare[la])
    for lo in range(0, len(own), 1 << 16):
        at, row = la[own[lo : lo + (1 << 16)]], lr[own[lo : lo + (1 << 16)]]
        times = nr[at]
        each = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        pairs = np.repeat(row, times) * len(right) + rr[np.repeat(start[at], times) + each]
        total += np.bincount(pairs, minlength=total.size).reshape(total.shape).astype(np.float32)
    # the others: fragment by fragment as matrix products
    rank = np.cumsum(~rare) - 1
    (la, lr), (ra, rr) = ((rank[at[~rare[at]]], rows[~rare[at]]) for at, rows in ((la, lr), (ra, rr)))
    for lo in range(0, int((~rare).sum()), grams_a_fragment):
        width = min(grams_a_fragment, int((~rare).sum()) - lo)
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        a, b = np.searchsorted(la, [lo, lo + width])
        x[lr[a:b], la[a:b] - lo] = 1
        a, b = np.searchsorted(ra, [lo, lo + width])
        y[rr[a:b], ra[a:b] - lo] = 1
        total += x @ y.T
    return total


def _sum_of(grams: np.ndarray, salt: int = 1) -> np.uint64:
    """A hash of a set: the sum of its mixed n-grams."""
    with np.errstate(over="ignore"):
        return np.add.reduce(mixed(grams, salt), dtype=np.uint64)


def _cut(n: int):
    """doc_id, text, fragments, s1, extra columns -> a row a fragment with the text's n-grams in that range of the order, packed; empty ones too.

    Rows whose text isn't the set meant by s1 (another text of a repeated id) give none.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                sets = ngram_sets(some.column(1).to_pylist(), n)
                count, meant = some.column(2).to_numpy(), some.column(3).to_numpy().view(np.uint64)
                row, frag, data = [], [], []
                for k, (grams, f) in enumerate(zip(sets, count.tolist(), strict=True)):
                    if _sum_of(grams) != meant[k]:
                        continue
                    edges = [0, *np.searchsorted(grams, np.array([(i << 64) // f for i in range(1, f)], np.uint64)).tolist(), len(grams)]
                    for i in range(f):
                        row.append(k)
                        frag.append(i)
                        data.append(grams[edges[i] : edges[i + 1]].tobytes())
                take = some.take(pa.array(row, pa.int64()))
                extra = [take.column(c) for c in range(3, batch.num_columns)]
                names = batch.schema.names[3:]
                yield pa.RecordBatch.from_arrays([take.column(0), pa.array(frag, pa.int32()), pa.array(data, pa.binary()), *extra], ["doc_id", "fragment", "grams", *names])

    return run


def _common(batches: Iterator) -> Iterator:
    """A member's and its leader's n-grams of a fragment -> their partial overlap."""
    import pyarrow as pa

    for batch in batches:
        names = batch.schema.names
        left, right = (batch.column(names.index(c)).to_pylist() for c in ("grams", "leader_grams"))
        n = [len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True)) for a, b in zip(left, right, strict=True)]
        kept = ["component", "doc_id", "s1", "size", "fragment", "leader", "leader_size"]
        yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in kept), pa.array(n, pa.int64())], [*kept, "common"])


_PARTIAL = "component long, kind int, k1 int, k2 int, a array<long>, b array<long>, na array<long>, nb array<long>, common binary"


def _block_overlaps(key, pdf):
    """Partial overlaps of one fragment between two blocks, or within one (kind 0, k1 = k2)."""
    import pandas as pd
    import zstandard

    pdf = pdf.sort_values(["side", "doc_id", "s1"])
    side = pdf["side"].to_numpy()
    same = key[1] == 0 and key[2] == key[3]
    left = pdf if same else pdf[side == 0]
    right = left if same else pdf[side == 1]
    sets = lambda part: [np.frombuffer(x, np.uint64) for x in part["grams"]]
    names = [c.split()[0] for c in _PARTIAL.split(", ")]
    if not len(left) or not len(right):
        return pd.DataFrame([], columns=names)
    n = overlaps(sets(left), sets(right)).astype(np.uint32)
    packed = zstandard.ZstdCompressor(level=1).compress(n.tobytes())
    row = (*key[:4], left["doc_id"].tolist(), right["doc_id"].tolist(), left["size"].tolist(), right["size"].tolist(), packed)
    return pd.DataFrame([row], columns=names)


def _block_links(num: int, den: int):
    """Sums the partial overlaps of a block pair over fragments and gives a spanning forest of its links."""

    def run(key, pdf):
        import pandas as pd
        import zstandard

        x = zstandard.ZstdDecompressor()
        a, b = (np.array(pdf[c].iloc[0], np.int64) for c in ("a", "b"))
        na, nb = (np.array(pdf[c].iloc[0], np.int64) for c in ("na", "nb"))
        total = np.zeros((len(a), len(b)), np.int64)
        for part in pdf["common"]:
            total += np.frombuffer(x.decompress(part), np.uint32).reshape(total.shape)
        rows, cols = np.nonzero(total * den >= num * (na[:, None] + nb[None] - total))
        ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        left, right, label = place[: len(a)][rows], place[len(a) :][cols], np.arange(len(ids))
        while True:  # least ids spread over links until they rest
            before = label.copy()
            low = np.minimum(label[left], label[right])
            np.minimum.at(label, left, low)
            np.minimum.at(label, right, low)
            if (label == before).all():
                break
        moved = label != np.arange(len(ids))
        return pd.DataFrame({"a": ids[label[moved]], "b": ids[moved]})

    return run


def _shared_entries(met: DataFrame, total: int, most_hot: int = 10_000) -> DataFrame:
    """Rows (node, entry), total in number, whose entry two nodes have, once each, with the entry's least node `lo` and its rows `f`, null for hot entries.

    Entries that a sixty-fourth of the nodes, taken by hash, hold often are counted by aggregation, combined before the
    shuffle, so that no task gets a common entry's rows; at most about most_hot can be so common, and their table is
    broadcast. All others go by entry to a window.
    """
    often = max(32, total // most_hot // 64)
    some = met.filter(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(64)) == 0).groupBy("entry").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= often).select("entry")
    hot = settled(some)
    entry = Window.partitionBy("entry")
    usual = met.join(F.broadcast(hot), "entry", "left_anti").withColumn("lo", F.min("node").over(entry)).withColumn("hi", F.max("node").over(entry)).withColumn("f", F.count(F.lit(1)).over(entry))
    # rows of an entry are together already: each side is made distinct by itself, so the usual rows aren't shuffled once more
    usual = usual.filter("lo <> hi").select("node", "entry", "lo", "f").distinct()
    common = met.join(F.broadcast(hot), "entry", "left_semi")
    twice = common.groupBy("entry").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("entry", "lo")
    return usual.unionByName(common.join(F.broadcast(twice), "entry").select("node", "entry", "lo", F.lit(None).cast("long").alias("f")).distinct())


def _candidate_edges(shared: DataFrame, rare: int = 48) -> DataFrame:
    """Edges that connect any two nodes which share as many entries as a link needs: (node, need, entry, lo, f) -> a, b.

    Pairs that share an entry of at most `rare` rows are counted pair by pair, as many rows as entries have at most times rare / 2,
    and stay if those entries, with as many common ones as both could share, suffice. Pairs that share common entries
    alone need enough of them each; such nodes are tied over each common entry's least node, so a large group gives
    no pairs.
    """
    common = F.coalesce(F.col("f") > rare, F.lit(True))
    # a node has no more entries than its prefix is long, so its window is small
    told = shared.withColumn("c", F.count(F.when(common, 1)).over(Window.partitionBy("node")))
    stars = told.filter(common & (F.col("c") >= F.col("need")) & (F.col("node") != F.col("lo"))).select(F.col("lo").alias("a"), F.col("node").alias("b")).distinct()
    few = told.filter(~common)
    held = few.groupBy("entry").agg(F.sort_array(F.collect_list(F.struct("node", "c", "need"))).alias("_x"))
    held = held.filter("size(_x) > 1").select("_x", F.posexplode("_x").alias("_i", "_a"))
    pairs = held.select("_a", F.explode(F.slice("_x", F.col("_i") + 2, F.size("_x"))).alias("_b"))
    counted = pairs.groupBy(F.col("_a.node").alias("a"), F.col("_b.node").alias("b"), F.least("_a.c", "_b.c").alias("c"), F.col("_a.need").alias("need")).agg(F.count(F.lit(1)).alias("n"))
    return stars.unionByName(counted.filter("n + c >= need").select("a", "b"))


#: Kinds of block pairs of a large cluster: which members' blocks meet. Low members are of the cluster's size class, high ones of the class
#: above; loose ones did not link with the leader, near ones among them may link with a set that did.
_MEET = (("low_loose", "low_loose"), ("low_loose", "high_loose"), ("low_near", "low_tied"), ("low_near", "high_tied"), ("low_tied", "high_near"))
_ROLES = ("low_loose", "high_loose", "low_near", "high_near", "low_tied", "high_tied")


def _places(roles: DataFrame, block: int) -> DataFrame:
    """roles (component, doc_id, s1, upper, tied, near) with `places`, the block pairs in which a member meets others; members without any are left out.

    By the triangle inequality of Jaccard distances a set too far from the leader links with none that is tied to it, so
    tied sets meet near ones alone. A cluster within one block meets there at once.
    """
    low, tied, near = F.col("upper") == 0, F.col("tied"), F.col("near")
    is_role = {"low_loose": low & ~tied, "high_loose": ~low & ~tied, "low_near": low & near, "high_near": ~low & near, "low_tied": low & tied, "high_tied": ~low & tied}
    n = lambda c: F.count(F.when(c, 1))
    counts = roles.groupBy("component").agg(F.count(F.lit(1)).alias("_all"), n(~tied).alias("_loose"), n(near).alias("_near"), *(F.ceil(n(is_role[r]) / block).cast("int").alias(r) for r in _ROLES))
    counts = settled(counts.filter("_loose > 1 OR _near > 0"))
    rows = roles.join(counts, "component")
    mine = {r: F.pmod(F.xxhash64("s1"), F.greatest(F.lit(1), F.col(r))).cast("int") for r in _ROLES}
    upto = lambda m: F.when(m > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda kind, k1, k2, side: F.struct(F.lit(kind).alias("kind"), k1.cast("int").alias("k1"), k2.cast("int").alias("k2"), side.cast("int").alias("side"))
    none = F.array().cast("array<struct<kind:int,k1:int,k2:int,side:int>>")

    def own_sort(x: str) -> Column:
        return F.transform(upto(F.col(x)), lambda j: place(0, F.least(mine[x], j), F.greatest(mine[x], j), F.when(mine[x] <= j, 0).otherwise(1)))

    def meeting(kind: int, x: str, y: str) -> list[Column]:
        """Blocks of role x against those of role y."""
        left = F.transform(upto(F.col(y)), lambda j: place(kind, mine[x], j, F.lit(0)))
        right = F.transform(upto(F.col(x)), lambda j: place(kind, j, mine[y], F.lit(1)))
        return [F.when(is_role[x], left).otherwise(none), F.when(is_role[y], right).otherwise(none)]

    blocks = [F.when(is_role["low_loose"], own_sort("low_loose")).otherwise(none)]
    for kind, (x, y) in enumerate(_MEET[1:], 1):
        blocks += meeting(kind, x, y)
    once = F.when(~tied | (F.col("_near") > 0), F.array(place(0, F.lit(0), F.lit(0), F.lit(0)))).otherwise(none)
    placed = rows.withColumn("places", F.when(F.col("_all") <= block, once).otherwise(F.concat(*blocks)))
    return placed.select("component", "doc_id", "s1", "places").filter("size(places) > 0")


def jaccard_components(
    docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, doc_id: str = "doc_id", text: str = "text", block: int = 1024, group_bytes: int = 8 << 20, exact: bool = False,
) -> DataFrame:
    """`doc_id, n_shingles, component_id` per row: size of its set of word n-grams and the smallest linked id.

    Two documents link when den * |x & y| >= num * |x | y|. Null, empty and blank texts have no n-grams, link with
    nothing and are their own component; a null id has a null component; rows that repeat an id are one document
    of all their links; equal sets are one set until the end. No partner or candidate is ever dropped, and no link is missed. Entries are
    64-bit hashes: only a collision of hashes (about pairs / 2**64) could join other texts; exact takes shorter prefixes with more candidates. A task that counts holds the
    n-grams of at most two blocks of sets in one fragment, about group_bytes.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    described = rows.mapInArrow(_describe(n, num, den, exact), "doc_id long, n_shingles long, s1 long, s2 long, class int, own array<long>, low array<long>")
    # the entries are the widest table here: they stay on the workers' disks until it is known which are shared; lost parts are described again
    described = described.persist(StorageLevel.DISK_ONLY)
    facts = settled(described.select("doc_id", "n_shingles", "s1", "s2", "class", (F.size("own") + F.size("low")).alias("entries")))
    sets = settled(
        facts.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "s1", "s2", "class").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    )
    # sets that share an entry: each with the first of the entry. A pair meets in the class of its smaller set, so
    # the classes' clusters stay apart: a node is a set in a class, its own or the one below
    node = lambda of, scheme: F.xxhash64(of, scheme)
    schemes = Fragments(num, den, exact=exact)
    need = F.array(*(F.lit(schemes.scheme(c)[2] + 1) for c in range(len(schemes.bounds) - 1)))  # a number a size class, up to 2**40 n-grams
    lists = F.array(F.struct(F.col("class").alias("s"), F.col("own").alias("e")), F.struct((F.col("class") - 1).alias("s"), F.col("low").alias("e")))
    met = described.filter("size(own) + size(low) > 0").select("s1", F.explode(lists).alias("l")).filter("size(l.e) > 0")
    met = met.select(node("s1", "l.s").alias("node"), F.explode("l.e").alias("entry"))
    total = facts.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]
    shared = settled(_shared_entries(met, total))
    described.unpersist()
    # a set that shares fewer entries with all others than a link needs with one has no link
    needs = sets.select("s1", F.explode(F.array(F.col("class"), F.col("class") - 1)).alias("s")).select(node("s1", "s").alias("node"), F.get(need, F.col("s")).alias("need"))
    enough = settled(shared.groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(needs, "node").filter("n >= need").select("node", "n", "need").distinct())
    clusters = connected_components(_candidate_edges(shared.join(enough.select("node", "need"), "node")))
    roles = sets.withColumn("upper", F.explode(F.array(F.lit(0), F.lit(1)))).select(node("s1", F.col("class") - F.col("upper")).alias("node"), F.col("rep").alias("doc_id"), "s1", "upper", F.col("n_shingles").alias("size"))
    members = settled(clusters.join(roles, "node").join(enough.select("node", "n"), "node").select("component", "doc_id", "s1", "upper", "size", "n"))
    leaders = members.groupBy("component").agg(
        F.max_by(F.struct(F.col("doc_id").alias("leader"), F.col("s1").alias("leader_s1"), F.col("size").alias("leader_size")), F.struct("n", "doc_id", "s1")).alias("l"),
        F.max("size").alias("largest"), F.ceil(F.count(F.lit(1)) / 512).cast("int").alias("salts"),
    )
    leaders = settled(leaders.select("component", "l.*", "largest", "salts"))
    # each member's text is cut once, into fragments so many that two blocks of the cluster's largest set fit; repeated rows are one there
    fragments = F.greatest(F.lit(1), F.ceil(F.col("largest") * (16 * block) / group_bytes)).cast("int").alias("fragments")
    leads = (F.col("doc_id") == F.col("leader")) & (F.col("s1") == F.col("leader_s1"))
    wanted = members.join(leaders, "component").select("doc_id", fragments, "s1", "component", "size", "leader", "leader_size", leads.alias("leads"), "salts")
    wanted = rows.join(wanted, "doc_id").select("doc_id", "text", "fragments", "s1", "component", "size", "leader", "leader_size", "leads", "salts", F.xxhash64("text").alias("_t"))
    wanted = wanted.dropDuplicates(["doc_id", "s1", "component", "_t"]).drop("_t")
    own = written(wanted.mapInArrow(_cut(n), T.StructType([*_CUT, *wanted.schema.fields[3:]])))
    # a leader's fragments go to as many tasks as its cluster has 512 members
    lead = own.filter("leads").select("component", "fragment", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("grams").alias("leader_grams"))
    both = own.withColumn("salt", F.pmod(F.xxhash64("s1"), F.col("salts")).cast("int")).join(lead, ["component", "fragment", "salt"])
    both = both.select("component", "doc_id", "s1", "size", "fragment", "grams", "leader", "leader_size", "leader_grams")
    partial = both.mapInArrow(_common, "component long, doc_id long, s1 long, size long, fragment int, leader long, leader_size long, common long")
    key = ["component", "doc_id", "s1", "size", "leader", "leader_size"]
    # texts of one id and one set have equal fragments
    pairs = partial.groupBy(*key, "fragment").agg(F.max("common").alias("common")).groupBy(*key).agg(F.sum("common").alias("common"))
    union = F.col("size") + F.col("leader_size") - F.col("common")
    tied = F.col("common") * den >= num * union
    judged = settled(pairs.select("component", "doc_id", "s1", "leader", tied.alias("tied"), (~tied & (F.col("common") * den >= (2 * num - den) * union)).alias("near")))
    stars = judged.filter("tied AND doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b"))
    # what is left meets in blocks
    placed = _places(members.select("component", "doc_id", "s1", "upper").join(judged.drop("leader"), ["component", "doc_id", "s1"]), block)
    parts = own.select("component", "doc_id", "s1", "size", "fragment", "grams").join(placed, ["component", "doc_id", "s1"])
    parts = parts.withColumn("place", F.explode("places")).select("component", "place.*", "fragment", "doc_id", "s1", "size", "grams")
    counted = parts.groupBy("component", "kind", "k1", "k2", "fragment").applyInPandas(_block_overlaps, _PARTIAL)
    links = counted.groupBy("component", "kind", "k1", "k2").applyInPandas(_block_links(num, den), "a long, b long")
    merged = connected_components(settled(stars.unionByName(links)))
    merged = settled(sets.filter("copies > 1").select("rep").join(merged.withColumnRenamed("node", "rep"), "rep", "full").select("rep", F.coalesce("component", "rep").alias("component_id")))
    known = settled(sets.join(merged, "rep").select("n_shingles", "s1", "s2", "component_id"))
    out = facts.select("doc_id", "n_shingles", "s1", "s2").join(known, ["n_shingles", "s1", "s2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


_CUT = (T.StructField("doc_id", T.LongType()), T.StructField("fragment", T.IntegerType()), T.StructField("grams", T.BinaryType()))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(g, ' ') AS g FROM (
  SELECT doc_id, CASE WHEN len(words) < 4 THEN words ELSE words[i : i + 3] END AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
rare AS (SELECT g FROM sh GROUP BY g HAVING count(*) > 1),
s2 AS (SELECT doc_id, g FROM sh SEMI JOIN rare USING (g)),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s2 a JOIN s2 b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM inter JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS doc_id, x AS other FROM both_ways UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON r.other = b.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""
