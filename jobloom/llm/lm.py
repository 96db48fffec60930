"""Context-tree weighting over bytes, learnt on Spark and scored in blocks of documents.

A document is its words, lower-cased (A-Z), with one blank between and a newline behind: the token sequence of the
word base, byte by byte. A byte is coded as eight binary decisions; a node of the tree is a context of d bytes
(d = 0..depth) together with the bits of the byte seen so far, and keeps how often 0 and 1 followed in training. A
node's weighted probability is the even mixture of its own Krichevsky-Trofimov estimate and the product of its
children's (the contexts one byte longer), so all depths are mixed with posterior weights. Every training byte is
counted and every context that occurs has its nodes. The tree stays distributed: contexts of four bytes and more live
in the bucket of their last four, and blocks of documents ask the buckets for their distinct grams. Only the nodes of
contexts up to three bytes meet in one place, at most 255 * 256**3 of them whatever the corpus.

Packed grams hold the context most recent byte first, then the byte it predicts in the lowest place, so sorted grams
have the shorter contexts sorted too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, span_hashes, text_bytes, written

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
DEPTH = 7
#: Contexts this long share a bucket; shorter ones are rolled up from theirs.
_SPLIT = 4
_U8 = np.uint64(8)
_BYTE = np.uint64(255)


def streams(texts) -> list[bytes]:
    """Each text as words with single blanks between; b"" for null or blank texts."""
    return [b" ".join((t or "").encode().translate(_LOWER).split()) for t in texts]


def packed_grams(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A gram for each byte of each document and its newline (newlines stand before the start); and bytes a document."""
    pad = b"\n" * DEPTH
    raw = pad + pad.join([d + b"\n" for d in docs])
    n = len(raw) - DEPTH
    # eight bytes from each place on, the last of them turned to the lowest place
    window = np.ndarray((n,), "<u8", raw, 0, (1,))
    gram = window << _U8
    gram |= window >> np.uint64(56)
    sizes = np.array([len(d) + 1 for d in docs], np.int64)
    keep = np.ones(n, bool)
    stops = np.cumsum(sizes + DEPTH)[:-1] - DEPTH
    keep[(stops[:, None] + np.arange(DEPTH)).ravel()] = False
    return gram[keep], sizes


def shortened(grams: np.ndarray) -> np.ndarray:
    """The same byte (or bits) after a context without its oldest byte."""
    return grams >> np.uint64(16) << _U8 | grams & _BYTE


def counted(grams: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order and how often they occur."""
    if counts is None:
        return np.unique(grams, return_counts=True)
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, int)
    return grams[at], np.add.reduceat(counts, at) if len(at) else counts


def nodes_of(grams: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary nodes with at least that count, of grams: keys (context << 8 | leading 1 and bits so far), zeros, ones."""
    context, byte = grams & ~_BYTE, grams & _BYTE
    key, n0, n1 = [], [], []
    for bit in range(8):
        one = (byte >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
        key.append(context | byte >> np.uint64(8 - bit) | np.uint64(1 << bit))
        n0.append(np.where(one, 0, counts))
        n1.append(np.where(one, counts, 0))
    keys, n0, n1 = np.concatenate(key), np.concatenate(n0), np.concatenate(n1)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    if not len(at):
        return keys, n0, n1
    zeros, ones = np.add.reduceat(n0[order], at), np.add.reduceat(n1[order], at)
    kept = zeros + ones >= least
    return keys[at][kept], zeros[kept], ones[kept]


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""

    def log_gamma(x: np.ndarray) -> np.ndarray:
        shift = np.log(x * (x + 1) * (x + 2)) + np.log((x + 3) * (x + 4) * (x + 5))
        y = x + 6
        return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) - shift

    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - np.log(np.pi)


class ContextTree:
    """The weighted tree over kept nodes: sorted keys and predictions per depth.

    keys[d]: context << 8 | bits so far (with a leading 1). stay[d]: P(1) where that node is the deepest kept one on
    the path; what its children would say then comes from its child "other contexts".
    """

    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """nodes[d]: sorted keys with zeros and ones, d = 0..depth; a kept node's shorter contexts are kept too."""
        depth = len(nodes) - 1
        self.keys = [k for k, _, _ in nodes]
        parents = [None] + [np.searchsorted(self.keys[d - 1], shortened(self.keys[d])).astype(np.int32) for d in range(1, depth + 1)]
        weight, other = [None] * (depth + 1), [None] * (depth + 1)
        below = None
        for d in range(depth, -1, -1):  # weights, from the deepest contexts upwards
            zeros, ones = nodes[d][1].astype(float), nodes[d][2].astype(float)
            own = _log_kt(zeros, ones)
            if d == depth:
                below, weight[d] = own, np.ones(len(own))
                continue
            n, p = len(own), parents[d + 1]
            r0 = np.maximum(zeros - np.bincount(p, nodes[d + 1][1], n), 0)
            r1 = np.maximum(ones - np.bincount(p, nodes[d + 1][2], n), 0)
            split = np.bincount(p, below, n) + _log_kt(r0, r1)
            below = np.logaddexp(own, split) - np.log(2)
            weight[d] = np.exp(own - np.log(2) - below).astype(np.float32)
            other[d] = (r1 + 0.5) / (r0 + r1 + 1)
        self.stay: list[np.ndarray] = []
        given, left = np.zeros(len(self.keys[0])), np.ones(len(self.keys[0]))
        for d in range(depth + 1):  # predictions, from the root downwards: what shorter contexts give, what they leave
            if d:
                given, left = given[parents[d]], left[parents[d]]
            kt = (nodes[d][2] + 0.5) / (nodes[d][1] + nodes[d][2] + 1)
            given, left = given + left * weight[d] * kt, left * (1 - weight[d])
            self.stay.append(given if d == depth else given + left * other[d])

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 P(byte | context) of packed grams, best in sorted order."""
        total = np.zeros(len(grams))
        if not len(grams):
            return total
        at_depth = np.full(len(grams), DEPTH, np.int8)  # longer contexts without a node stay without for further bits
        for bit in range(8):
            path = grams >> np.uint64(8 - bit)  # neighbours with one context and one path so far are looked up once
            first = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
            own, depth = grams[first], at_depth[first]
            context, prefix = own & ~_BYTE, (own & _BYTE) >> np.uint64(8 - bit) | np.uint64(1 << bit)
            p = np.full(len(own), 0.5)
            for d in range(DEPTH, -1, -1):
                todo = np.flatnonzero(depth == d)
                if not len(todo):
                    continue
                want = context[todo] >> np.uint64(8 * (DEPTH - d)) & ~_BYTE | prefix[todo]
                keys = self.keys[d]
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = keys[at] == want
                p[todo[hit]] = self.stay[d][at[hit]]
                depth[todo[~hit]] = d - 1
            length = np.diff(first, append=len(grams))
            at_depth, p = np.repeat(depth, length), np.repeat(p, length)
            total += np.log10(np.where((grams >> np.uint64(7 - bit) & np.uint64(1)).astype(bool), p, 1 - p))
        return total


def _bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each gram by its last four bytes of context."""
    with np.errstate(over="ignore"):
        return ((grams >> np.uint64(8 * (DEPTH + 1 - _SPLIT))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)


def _chunks(texts: list[bytes], size: int = 3 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about that many bytes."""
    lo = 0
    while lo < len(texts):
        hi, n = lo, 0
        while hi < len(texts) and n < size:
            n += len(texts[hi]) + 1
            hi += 1
        yield lo, hi
        lo = hi


def _union(parts: list[np.ndarray]) -> np.ndarray:
    """Distinct values of sorted arrays, in order."""
    both = np.concatenate(parts)
    both.sort()
    return both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both


def _block_grams(texts: list[bytes], held: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a block in order, with their counts in its training documents (0: only held out)."""
    parts, sides = [], []
    for lo, hi in _chunks(texts):
        for side in (False, True):
            own = [t for t, h in zip(texts[lo:hi], held[lo:hi], strict=True) if h == side]
            if own:
                g, n = counted(packed_grams(own)[0])
                parts.append(g)
                sides.append(None if side else n.astype(np.uint32))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    grams = _union(parts)
    counts = np.zeros(len(grams), np.uint32)
    while parts:
        g, n = parts.pop(), sides.pop()
        if n is not None:
            counts[np.searchsorted(grams, g)] += n
    return grams, counts


class BlockPlaces:
    """Where the grams of a block's documents stand among its distinct ones: sorted once."""

    def __init__(self, texts: list[bytes]):
        self.parts = []
        for lo, hi in _chunks(texts):
            grams, sizes = packed_grams(texts[lo:hi])
            u, inverse = np.unique(grams, return_inverse=True)
            self.parts.append((lo, hi, u, inverse.astype(np.uint32), sizes))
        self.n = len(texts)
        self.grams = _union([p[2] for p in self.parts]) if self.parts else np.zeros(0, np.uint64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of the grams' values a document."""
        out = np.zeros(self.n)
        for lo, hi, u, inverse, sizes in self.parts:
            own = values[np.searchsorted(self.grams, u)].astype(float)
            out[lo:hi] = np.add.reduceat(own[inverse], np.cumsum(sizes) - sizes)
        return out


_KT = _log_kt(*np.meshgrid(np.arange(64.0), np.arange(64.0), indexing="ij"))


def _quick_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """_log_kt, small counts from a table."""
    out = _KT[np.minimum(zeros, 63), np.minimum(ones, 63)]
    big = np.flatnonzero((zeros > 63) | (ones > 63))
    out[big] = _log_kt(zeros[big].astype(float), ones[big].astype(float))
    return out


def _mixed(zeros: np.ndarray, ones: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted log probability of nodes, and the share of their own estimate in it."""
    own = _quick_kt(zeros, ones)
    below = np.logaddexp(own, split) - np.log(2)
    return below, np.exp(own - np.log(2) - below)


class Branches:
    """All nodes of a bucket's contexts, from DEPTH bytes down to _SPLIT; grams that only held-out documents have count 0."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        """Distinct sorted grams and their counts."""
        self.levels, self.ups = [(grams, counts)], []
        for _ in range(DEPTH, _SPLIT - 1, -1):
            short, up = np.unique(shortened(self.levels[-1][0]), return_inverse=True)
            self.ups.append(up)
            self.levels.append((short, np.bincount(up, self.levels[-1][1], len(short)).astype(np.int64)))

    def weighed(self, bit: int):
        """Per depth (node of each gram, zeros, ones, share, node one byte shorter); and keys, zeros, ones, children's log probability at _SPLIT - 1."""
        out, below, before, mask = [], None, None, np.uint64(7 - bit)
        for k, (grams, counts) in enumerate(self.levels):
            path = grams >> np.uint64(8 - bit)
            new = np.ones(len(grams), bool)
            new[1:] = path[1:] != path[:-1]
            first, node = np.flatnonzero(new), np.cumsum(new) - 1
            ones = np.add.reduceat(np.where((grams >> mask & np.uint64(1)).astype(bool), counts, 0), first)
            zeros = np.add.reduceat(counts, first) - ones
            if k:
                up = node[self.ups[k - 1][before]]
                split = np.bincount(up, below, len(first))
                out[-1] = (*out[-1], up)
            if k == len(self.levels) - 1:
                own = grams[first]
                return out, (own & ~_BYTE | (own & _BYTE) >> np.uint64(8 - bit) | np.uint64(1 << bit), zeros, ones, split)
            below, share = _mixed(zeros, ones, split) if k else (_quick_kt(zeros, ones), np.ones(len(first)))
            out.append((node, zeros, ones, share))
            before = first

    def roots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys, zeros, ones and children's log probability of the nodes of _SPLIT - 1 bytes, as far as this bucket adds to them."""
        keys, zeros, ones, split = (np.concatenate(x) for x in zip(*(self.weighed(bit)[1] for bit in range(8)), strict=True))
        return keys, zeros, ones, split

    def log10(self, stem: Stem) -> np.ndarray:
        """log10 P(byte | context) of the grams, in their order."""
        grams = self.levels[0][0]
        total = np.zeros(len(grams))
        for bit in range(8):
            depths, (keys, *_) = self.weighed(bit)
            at = np.searchsorted(stem.keys, keys)
            given, left = stem.given[at], stem.left[at]
            for _, zeros, ones, share, up in reversed(depths):
                given, left = given[up], left[up]
                given, left = given + left * share * (ones + 0.5) / (zeros + ones + 1), left * (1 - share)
            p = given[depths[0][0]]
            total += np.log10(np.where((grams >> np.uint64(7 - bit) & np.uint64(1)).astype(bool), p, 1 - p))
        return total


class Stem:
    """The nodes of contexts up to _SPLIT - 1 bytes: what they give to P(1) at each of the longest, and the weight they leave."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, split: np.ndarray):
        """Sorted keys with zeros, ones and the children's log probability."""
        self.keys, levels = keys, []
        for d in range(_SPLIT - 1, -1, -1):
            below, share = _mixed(zeros, ones, split)
            short, up = np.unique(shortened(keys), return_inverse=True) if d else (keys, None)
            levels.append((share * (ones + 0.5) / (zeros + ones + 1), share, up))
            if d:
                keys, split = short, np.bincount(up, below, len(short))
                zeros, ones = (np.bincount(up, x, len(short)).astype(np.int64) for x in (zeros, ones))
        self.given, self.left = np.zeros(len(keys)), np.ones(len(keys))
        for part, share, up in reversed(levels):
            if up is not None:
                self.given, self.left = self.given[up], self.left[up]
            self.given, self.left = self.given + self.left * part, self.left * (1 - share)


def _planes(values: np.ndarray) -> bytes:
    """Numbers as packed planes of equal bytes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes())


def _unplaned(raw: bytes, kind: type) -> np.ndarray:
    import zstandard

    width = np.dtype(kind).itemsize
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


def _unpacked(gaps: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(gaps, np.uint64), dtype=np.uint64)


def _merged_grams(gaps, counts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a bucket's blocks with their counts."""
    grams = _union([_unpacked(x) for x in gaps])
    n = np.zeros(len(grams), np.int64)
    for x, c in zip(gaps, counts, strict=True):
        n[np.searchsorted(grams, _unpacked(x))] += _unplaned(c, np.uint32)
    return grams, n


def _gram_values(shared):
    """log10 P of each block's grams in a bucket, in their order: (kind 1, bucket, block, values)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                grams, counts = _merged_grams(one["gaps"], one["n"])
                values = Branches(grams, counts).log10(shared.value).astype(np.float32)
                for block, gaps in zip(one["blocks"], one["gaps"], strict=True):
                    part = _planes(values[np.searchsorted(grams, _unpacked(gaps))])
                    yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([one["bucket"]], pa.int32()), pa.array([block], pa.int32()), pa.array([part], pa.binary())], ["kind", "bucket", "block", "data"])

    return run


def _stem(merged: DataFrame) -> Stem:
    """The short contexts' nodes, added up over buckets on Spark."""
    lists = merged.filter("kind = 1").select(F.explode(F.arrays_zip("keys", "zeros", "ones", "split")).alias("x"))
    sums = lists.groupBy("x.keys").agg(F.sum("x.zeros").alias("zeros"), F.sum("x.ones").alias("ones"), F.sum("x.split").alias("split")).toArrow()
    keys = sums.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return Stem(keys[order], *(sums.column(k).to_numpy()[order] for k in (1, 2, 3)))


class BlockWords:
    """A block's tokens as 64-bit hashes of their bytes: distinct ones in order, and each document's."""

    def __init__(self, texts: list[bytes]):
        self.parts = []
        for lo, hi in _chunks(texts):
            raw = b"\n".join(texts[lo:hi]) + b"\n"
            data = np.frombuffer(raw, np.uint8)
            white = (data == 32) | (data == 10)
            before = np.concatenate([[True], white[:-1]])
            begin, end = np.flatnonzero(~white & before), np.flatnonzero(white & ~before)
            sizes = np.array([len(t) + 1 for t in texts[lo:hi]], np.int64)
            doc = np.searchsorted(np.cumsum(sizes), begin, "right")
            u, inverse = np.unique(span_hashes(data, begin, end), return_inverse=True)
            self.parts.append((lo, hi, u, inverse.astype(np.uint32), doc))
        self.n = len(texts)
        self.words = _union([p[2] for p in self.parts]) if self.parts else np.zeros(0, np.uint64)

    def counts(self, train: np.ndarray) -> np.ndarray:
        """Occurrences of each word in training documents."""
        out = np.zeros(len(self.words), np.uint64)
        for lo, _, u, inverse, doc in self.parts:
            out[np.searchsorted(self.words, u)] += np.bincount(inverse[train[lo + doc]], minlength=len(u)).astype(np.uint64)
        return out

    def sums(self, value: np.ndarray) -> np.ndarray:
        """Sums of the words' values a document."""
        out = np.zeros(self.n)
        for lo, hi, u, inverse, doc in self.parts:
            out[lo:hi] = np.bincount(doc, value[np.searchsorted(self.words, u)][inverse], hi - lo)
        return out


def _by_bucket(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of a sorted array."""
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    return list(zip(bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True))


def _word_bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hashes: sorted words have sorted buckets."""
    return ((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _parts_of_block(buckets: int):
    """A block's distinct words (kind 0) and grams (kind 1) with their counts in its training documents (0: only held out), a row a bucket; ends of documents: kind 2."""

    def run(key, pdf):
        import pandas as pd

        texts, held = streams(pdf["text"].tolist()), pdf["held_out"].to_numpy(bool)
        block, rows = int(key[0]), []
        words = BlockWords(texts)
        n = words.counts(~held)
        for bucket, a, b in _by_bucket(_word_bucket(words.words, buckets)):
            rows.append((0, bucket, block, _planes(np.diff(words.words[a:b], prepend=np.uint64(0))), _planes(n[a:b])))
        rows.append((2, 0, block, b"", _planes(np.array([int((~held).sum())], np.uint64))))
        del words
        grams, counts = _block_grams(texts, held.tolist())
        bucket = _bucket_of(grams, buckets).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        grams, counts = grams[order], counts[order]
        for k, a, b in _by_bucket(bucket[order]):
            rows.append((1, k, block, _planes(np.diff(grams[a:b], prepend=np.uint64(0))), _planes(counts[a:b])))
        return pd.DataFrame(rows, columns=["kind", "bucket", "block", "data", "counts"])

    return run


_MERGED = (
    "kind int, bucket int, block int, data binary, tokens long, vocabulary long, "
    "blocks array<int>, gaps array<binary>, n array<binary>, keys array<long>, zeros array<long>, ones array<long>, split array<double>"
)


def _merge_bucket(key, pdf):
    """Words: corpus counts sent back to each block in its order, and sums as block -1. Grams: one row of all blocks' grams, with what they add to the short contexts."""
    import pandas as pd

    names = [x.split()[0] for x in _MERGED.split(", ")]
    kind, bucket = int(key[0]), int(key[1])
    none = (None,) * 7
    if kind == 2:
        ends = sum(int(_unplaned(x, np.uint64)[0]) for x in pdf["counts"])
        return pd.DataFrame([(2, 0, -1, b"", ends, int(ends > 0), *none)], columns=names)
    if kind:
        grams, counts = _merged_grams(pdf["data"], pdf["counts"])
        keys, zeros, ones, split = Branches(grams, counts).roots()
        row = (1, bucket, -1, b"", 0, 0, pdf["block"].tolist(), pdf["data"].tolist(), pdf["counts"].tolist(), keys.view(np.int64), zeros, ones, split)
        return pd.DataFrame([row], columns=names)
    each = [_unpacked(x) for x in pdf["data"]]
    words = _union(each)
    total = np.zeros(len(words), np.uint64)
    for w, n in zip(each, pdf["counts"], strict=True):
        total[np.searchsorted(words, w)] += _unplaned(n, np.uint64)
    rows = [(0, bucket, int(b), _planes(total[np.searchsorted(words, w)]), 0, 0, *none) for b, w in zip(pdf["block"], each, strict=True)]
    rows.append((0, bucket, -1, b"", int(total.sum()), int((total > 0).sum()), *none))
    return pd.DataFrame(rows, columns=names)


def _score_block(total: int, vocabulary: int, ends: int, buckets: int):
    """total, vocabulary: of training tokens, ends of documents among them; ends: how many these are."""

    def run(key, docs, found):
        import pandas as pd

        texts = streams(docs["text"].tolist())
        n_bytes = np.array([len(t) + 1 for t in texts], np.int64)
        scale = np.log10(total + 0.5 * (vocabulary + 1))
        own = BlockWords(texts)
        answers = found[found["kind"] == 0].sort_values("bucket")["data"]
        known = np.concatenate([np.zeros(0, np.uint64), *(_unplaned(x, np.uint64) for x in answers)]).astype(float)
        n_tokens = own.sums(np.ones(len(known))) + 1
        n_known = own.sums((known > 0).astype(float)) + (ends > 0)
        base = own.sums(np.log10(known + 0.5)) + np.log10(ends + 0.5) - n_tokens * scale
        del own, known
        places = BlockPlaces(texts)
        del texts
        answers = found[found["kind"] == 1].sort_values("bucket")["data"]
        log10 = np.empty(len(places.grams), np.float32)
        log10[np.argsort(_bucket_of(places.grams, buckets), kind="stable")] = np.concatenate([_unplaned(x, np.float32) for x in answers])
        score = places.sums(log10)
        return pd.DataFrame({
            "doc_id": docs["doc_id"].astype("Int64"), "held_out": docs["held_out"], "n_tokens": n_tokens.astype(np.int64), "n_known": n_known.astype(np.int64), "train_tokens": np.full(len(docs), total), "base_score": base,
            "score": score, "bits_per_byte": -score / np.log10(2) / n_bytes,
        })

    return run


def score_documents(docs: DataFrame, held_fold: int = 1, doc_id: str = "doc_id", text: str = "text", block_bytes: int = 12 << 20, bucket_bytes: int = 6 << 20) -> DataFrame:
    """Per row: fold, word counts, the word base and the tree's log10 probability and code length per byte.

    Words and grams are counted over all training documents in buckets and joined back per block of documents, so
    neither the vocabulary nor the tree meets in one place; the short contexts' nodes alone are broadcast. Words are told
    apart by 64-bit hashes. A gram's log10 P comes back as a 32-bit float and is added up in 64 bits. Null and blank texts are the end alone. Null ids
    train and are not held out. Repeated rows count each; other columns are not read. Without training documents all
    counts are 0 and the tree gives every bit one half. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("held_out", crc_fold("doc_id") == held_fold)
    size = text_bytes(rows)
    blocks, buckets = (max(1, -(-size // x)) for x in (block_bytes, bucket_bytes))
    # by id and text: copies of one text under many ids spread, and so do rows that repeat an id
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).cast("int"))
    parts = rows.groupBy("block").applyInPandas(_parts_of_block(buckets), "kind int, bucket int, block int, data binary, counts binary")
    merged = written(parts.groupBy("kind", "bucket").applyInPandas(_merge_bucket, _MERGED))
    sums = {r[0]: r for r in merged.filter("block = -1 AND kind <> 1").groupBy("kind").agg(F.sum("tokens"), F.sum("vocabulary")).collect()}
    ends = sums[2][1] if 2 in sums else 0
    total, vocabulary = (sum(r[k] for r in sums.values()) for k in (1, 2))
    shared = spark.sparkContext.broadcast(_stem(merged))
    values = merged.filter("kind = 1").select("bucket", "blocks", "gaps", "n").mapInArrow(_gram_values(shared), "kind int, bucket int, block int, data binary")
    found = merged.filter("kind = 0 AND block >= 0").select("kind", "bucket", "block", "data").unionByName(values)
    return (
        rows.groupBy("block").cogroup(found.groupBy("block"))
        .applyInPandas(_score_block(total, vocabulary, ends, buckets), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
    )


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
