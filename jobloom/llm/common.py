"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import positions, settled, shared_folder


#: ASCII white space that separates words, as a Java regex and as characters.
WS_REGEX = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; without one a local folder on one machine, an error on a cluster."""
    return shared_folder(spark)


def written(df: DataFrame) -> DataFrame:
    """df, computed once and kept as a compressed table in the shared folder; for wide results that are read several times."""
    import uuid

    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_fold(column: str, folds: int = 5) -> Column:
    """crc32 of the column as text modulo folds; null ids fall in fold -1, which no split holds out."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(folds)), F.lit(-1))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of text in df; sizes partitions, never cuts data."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0])


def words_of(text: Column) -> Column:
    """Array of words between ASCII white space; empty for null."""
    parts = F.split(F.coalesce(text, F.lit("")), WS_REGEX)
    return F.filter(parts, lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """Number of words without building them: white-space runs of the trimmed text, plus one."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WS_REGEX, " "))
    spaces = F.length(squeezed) - F.length(F.translate(squeezed, " ", ""))
    return F.when(squeezed == "", F.lit(0)).otherwise(spaces + 1).cast("long")


_BASE = 0x9E3779B97F4A7C15
_POWERS: list = []


def mixed(h, salt: int = 0):
    """A 64-bit finaliser (xor-shifts and odd multiplications) over a numpy array."""
    import numpy as np

    h = (h + np.uint64(salt & (1 << 64) - 1)).astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class SpanHasher:
    """64-bit hashes of data[begin:end] for many spans of a byte array: polynomials over mixed bytes, read off prefix sums, then mixed."""

    def __init__(self, data):
        import numpy as np

        n = len(data)
        with np.errstate(over="ignore"):
            if not _POWERS or len(_POWERS[0]) < n:
                powers = []
                for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                    p = np.full(max(n, 1 << 21), base, np.uint64)
                    p[0] = 1
                    powers.append(np.multiply.accumulate(p, out=p))
                _POWERS[:] = [*powers, mixed(np.arange(256, dtype=np.uint64), 0x5851F42D4C957F2D)]
            power, self.inverse, coded = _POWERS
            self.prefix = np.zeros(n + 1, np.uint64)
            np.cumsum(coded[data] * power[:n], out=self.prefix[1:])

    def __call__(self, begin, end):
        import numpy as np

        with np.errstate(over="ignore"):
            return mixed((self.prefix[end] - self.prefix[begin]) * self.inverse[begin])


def span_hashes(data, begin, end):
    return SpanHasher(data)(begin, end)


#: A word of Latin letters whose NFC form and lower case are one letter each, and a mark behind it.
LATIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]?)").fullmatch
#: White space besides blanks and newlines; two kinds in a row; separators that are white space to Python alone.
SPACES = re.compile(r"[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
SPACE_RUN = re.compile(r" \s").search
SEPARATORS = re.compile(r"[\x1c-\x1f]").search


def _byte_chars() -> dict[int, str]:
    """Byte-level vocabularies write a byte as its Latin-1 character if that prints, else as 256 + its rank among the rest."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTE_CHARS = _byte_chars()
LETTER_CHARS = {b: c for b, c in BYTE_CHARS.items() if b >= 0x7F}
MARK_CHARS = ".,;:!?"


def _byte_classes():
    """By byte: 2 for a text's end, blank and newline, 1 for other ASCII white space; a mark's rank from 1; whether it is an ASCII letter."""
    import numpy as np

    cuts, marks, letters = np.zeros(256, np.uint8), np.zeros(256, np.int64), np.zeros(256, bool)
    cuts[[9, 11, 12, 13]], cuts[[0, 10, 32]] = 1, 2
    marks[[ord(m) for m in MARK_CHARS]] = np.arange(1, len(MARK_CHARS) + 1)
    letters[[*range(65, 91), *range(97, 123)]] = True
    return cuts, marks, letters


_CUTS, _MARKS, _LETTERS = _byte_classes()


class CachedTokenizer:
    """Encodes texts with a tokenizers file, chunk by chunk through a bounded cache.

    Both supported layouts pre-split at white space, so a chunk between blanks always gets the same ids;
    texts where that would not hold (runs of blanks for the byte-level file, control separators, strings of
    special tokens) go through the library whole. A mark behind an ASCII letter ends its chunk in both layouts and is
    looked up by itself. Special-token strings in a text are ordinary text. Ids are returned as little-endian uint32
    bytes. The cache holds two generations of at most `keep` chunks each; a chunk found in the older one moves up.
    """

    def __init__(self, path: str, keep: int = 180_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.by_space = self.lib.normalizer is None  # byte level: a blank belongs to the chunk behind it
        self.packed = [i.to_bytes(4, "little") for i in range(self.lib.get_vocab_size(with_added_tokens=True))]
        self.mark = {m: self._ids([m])[0] for m in MARK_CHARS}
        self.newline = self._ids(["\n"])[0]
        #: Young and old chunks with a blank before them (bytes to bytes of ids), and without one.
        self.tails: list[dict[bytes, bytes]] = [{}, {}]
        self.heads: list[dict[bytes, bytes]] = [{}, {}]
        self.keep = keep

    def _ids(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _learned(self, new: list[bytes], lead: str) -> list[bytes]:
        """Ids of chunks: words straight from the library's model, others from the whole library."""
        packed, tokenize, mark = self.packed, self.lib.model.tokenize, self.mark
        begin, lower = (BYTE_CHARS[0x20] if lead else ""), not self.by_space
        out: list[bytes] = [b""] * len(new)
        other: list[int] = []
        for k, raw in enumerate(new):
            word = raw.decode()
            m = LATIN(word)
            if m is None:
                other.append(k)
                continue
            word, end = m.groups()
            if lower:
                word = word.lower()
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(LETTER_CHARS)
            found = [packed[t.id] for t in tokenize(begin + word)]
            if end:
                found.append(mark[end])
            out[k] = found[0] if len(found) == 1 else b"".join(found)
        for k, ids in zip(other, self._ids([lead + new[k].decode() for k in other]), strict=True):
            out[k] = ids
        return out

    def _odd(self, text: str) -> bool:
        """Whether chunks between blanks could get other ids than the whole text."""
        if "<|" in text or "\0" in text:
            return True
        if not self.by_space:
            return not text.isascii() and SPACES(text) is not None or SEPARATORS(text) is not None
        return "  " in text or "\n\n" in text or " \n" in text or text.endswith(" ") or SPACES(text) is not None and SPACE_RUN(text) is not None

    def _ids_of(self, chunks: list[bytes], cache: list[dict[bytes, bytes]], lead: str) -> list[bytes]:
        """Ids of distinct chunks."""
        found = list(map(cache[0].get, chunks))
        places = [k for k, f in enumerate(found) if f is None]
        if not places:
            return found
        if len(cache[0]) > self.keep:
            cache[:] = [{}, cache[0]]
        young, old = cache
        missing = [chunks[k] for k in places]
        again = list(map(old.get, missing))
        new = [c for c, f in zip(missing, again, strict=True) if f is None]
        fresh = iter(self._learned(new, lead))
        for k, c, f in zip(places, missing, again, strict=True):
            found[k] = young[c] = next(fresh) if f is None else f
        return found

    def _batch(self, texts: list[str]) -> list[bytes]:
        """Chunks are told apart by 64-bit hashes within the batch, so that each distinct one is looked up once; their ids are then laid out by places."""
        import numpy as np

        raw = "\0".join(texts).encode()
        data = np.frombuffer(raw + b"\0", np.uint8)
        cut = np.flatnonzero(_CUTS[data] == 2 if self.by_space else _CUTS[data] > 0)
        begin, end = np.concatenate([[0], cut[:-1] + 1]), cut
        before = np.concatenate([np.zeros(1, np.uint8), data[cut[:-1]]])
        doc = np.cumsum(before == 0) - 1
        kind = np.where(before == 32, 0, np.where(before == 10, 2, 1)).astype(np.uint8) if self.by_space else np.zeros(len(begin), np.uint8)
        if not self.by_space:
            full = end > begin
            begin, end, doc, kind = begin[full], end[full], doc[full], kind[full]
        # marks behind an ASCII letter: chunks of their own, of kind 3 and more
        marked = np.flatnonzero(end - begin > 1)
        last = _MARKS[data[end[marked] - 1]]
        marked = marked[(last > 0) & _LETTERS[data[end[marked] - 2]]]
        hashed = np.array(end)
        hashed[marked] -= 1
        keys = span_hashes(data, begin, hashed) + kind * np.uint64(0x9E3779B97F4A7C15)
        _, first, place = np.unique(keys, return_index=True, return_inverse=True)
        own = kind[first].tolist()
        chunks = [raw[a:b] for a, b in zip(begin[first].tolist(), hashed[first].tolist(), strict=True)]
        tails, heads = [k for k, o in enumerate(own) if o == 0], [k for k, o in enumerate(own) if o]
        ids: list[bytes] = [b""] * len(chunks)
        for where, cache, lead in ((tails, self.tails, " " if self.by_space else ""), (heads, self.heads, "")):
            for k, x in zip(where, self._ids_of([chunks[k] for k in where], cache, lead), strict=True):
                ids[k] = self.newline + x if own[k] == 2 else x
        if len(marked):  # each mark's place is right behind its word's
            n = len(ids)
            ids += [self.mark[m] for m in MARK_CHARS]
            at = marked + np.arange(1, len(marked) + 1)
            whole = np.empty(len(place) + len(marked), np.int64)
            whole[at] = n - 1 + _MARKS[data[end[marked] - 1]]
            word = np.ones(len(whole), bool)
            word[at] = False
            whole[word] = place
            owner = np.empty(len(whole), np.int64)
            owner[at], owner[word] = doc[marked], doc
            place, doc = whole, owner
        size = np.array([len(x) >> 2 for x in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), "<u4")
        start = np.cumsum(size) - size
        length = size[place]
        out_end = np.cumsum(length)
        total = int(out_end[-1]) if len(out_end) else 0
        tokens = flat[np.repeat(start[place] - (out_end - length), length) + np.arange(total)]
        bounds = np.concatenate([[0], out_end])[np.searchsorted(doc, np.arange(len(texts) + 1))]
        whole = tokens.tobytes()
        return [whole[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def encode(self, texts: list[str | None], batch_chars: int = 2 << 20) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        odd = [i for i, t in enumerate(texts) if t and self._odd(t)]
        skip, some, size = set(odd), [], 0
        for i, t in enumerate(texts):
            if t and i not in skip:
                some.append(i)
                size += len(t)
            if some and (size >= batch_chars or i == len(texts) - 1):
                for k, ids in zip(some, self._batch([texts[k] for k in some]), strict=True):
                    out[k] = ids
                some, size = [], 0
        for i, ids in zip(odd, self._ids([texts[i] for i in odd]), strict=True):
            out[i] = ids
        return out


def tokenizer_path(name: str) -> str:
    """A tokenizer file: a path as it is, a bare name from the installed package of public vocabularies."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: What a Python worker has loaded already; a worker serves many tasks.
_LOADED: dict[str, CachedTokenizer] = {}


def worker_tokenizer(name: str) -> CachedTokenizer:
    if name not in _LOADED:
        _LOADED[name] = CachedTokenizer(tokenizer_path(name))
    return _LOADED[name]


#: df with consecutive positions in a total order.
global_index = positions
