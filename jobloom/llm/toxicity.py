"""Toxicity of texts behind a noisy channel.

Writers hide words by digits and signs for letters, by blanks or marks between letters or halves, and by repeating letters.
Restoring decodes a lattice of what each character may stand for: Viterbi over states of the last two letters,
weighing channel costs against a character trigram model learnt from the corpus's own words. Plain words have one path
and stay as they are. The restored words are then scored: every word's surest sign (itself, its beginnings and
endings) by a lower confidence bound of the share of toxic documents among those that hold it, and documents by a
logistic fit on their strongest signs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SpanHasher, crc_fold, span_hashes

#: Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
MARKS = ".,;:!?\"'()[]{}<>*_-~#%&/\\|=$@+^`´…“”«»"
SEPARATORS = " .-_*~,|/"
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
_PLAIN = re.compile(rf"[{LETTERS}]+").fullmatch
_TRIPLE = re.compile(r"(.)\1\1").search
_DOUBLES = re.compile(r"(.)\1").findall
#: So many doubled letters in one word look stretched.
STRETCHED = 3
#: So many single characters in a row look spaced out, whatever white space is between them.
SPACED = 3

#: Channel costs in natural logarithms: a sign for a letter, a repeated letter dropped, a separator dropped or kept, a sign kept or dropped.
COST = {"leet": 1.5, "repeat": 0.7, "drop": 0.3, "keep": 2.0, "sign": 5.0}


class CharModel:
    """Interpolated character trigrams of words; "^" stands before and behind a word. At most 61**3 counts."""

    def __init__(self, counts: dict[str, int]):
        tri, bi, uni = Counter(counts), Counter(), Counter()
        for g, n in counts.items():
            bi[g[1:]] += n
            uni[g[2]] += n
        ctx2, ctx1 = Counter(), Counter()
        for g, n in tri.items():
            ctx2[g[:2]] += n
        for g, n in bi.items():
            ctx1[g[0]] += n
        total = sum(uni.values()) or 1
        self.tri, self.bi, self.uni, self.ctx2, self.ctx1, self.total = tri, bi, uni, ctx2, ctx1, total
        self.memo: dict[str, float] = {}

    def log(self, a: str, b: str, c: str) -> float:
        key = a + b + c
        p = self.memo.get(key)
        if p is None:
            n2, n1 = self.ctx2.get(a + b, 0), self.ctx1.get(b, 0)
            q = 0.1 / len(LETTERS) + 0.9 * self.uni.get(c, 0) / self.total
            if n1:
                q = 0.2 * q + 0.8 * self.bi.get(b + c, 0) / n1
            if n2:
                q = 0.2 * q + 0.8 * self.tri.get(key, 0) / n2
            p = self.memo[key] = math.log(q)
        return p


def _spelt(path: tuple | None) -> str:
    out = []
    while path is not None:
        path, x = path
        out.append(x)
    return "".join(reversed(out))


def restore(observed: str, model: CharModel) -> str:
    """The likeliest words behind a suspicious stretch: lower-cased letters, separated by blanks.

    Lattice: a letter stands for itself, or for nothing where it repeats the character before; a sign stands for one
    of its letters, for a word boundary, or, at an edge of a word, for nothing; a separator for nothing or a boundary.
    States are the last two letters written; equal states keep the cheaper path (ties: the earlier one). Paths are
    linked back, so time and memory grow with the length alone.
    """
    paths: dict[tuple[str, str], tuple[float, tuple | None]] = {("^", "^"): (0.0, None)}
    last, stretched = "", len(_DOUBLES(observed)) >= STRETCHED
    behind = len(observed.rstrip(MARKS + " "))  # from here on there are only marks
    for at, c in enumerate(observed):
        new: dict[tuple[str, str], tuple[float, tuple | None]] = {}

        def put(state: tuple[str, str], score: float, text: tuple | None, new=new) -> None:
            if state not in new or score > new[state][0]:
                new[state] = (score, text)

        own = c in LETTERS
        options = [(c, 0.0)] if own else [(x, COST["leet"]) for x in LEET.get(c, "")]
        edge = at == 0 or observed[at - 1] in SEPARATORS or at + 1 >= behind
        for (a, b), (score, text) in paths.items():
            for x, cost in options:
                put((b, x), score - cost + model.log(a, b, x), (text, x))
            if c == last:
                run = stretched or observed[at - 2 : at - 1] == c and at > 1 or observed[at + 1 : at + 2] == c
                put((a, b), score - COST["repeat" if run else "sign"], text)
            if c in SEPARATORS:
                put((a, b), score - COST["drop"], text)
                put(("^", "^"), score - COST["keep"] + (model.log(a, b, "^") if b != "^" else 0.0), (text, " ") if b != "^" else text)
            elif not own:
                put((a, b) if b == "^" or not edge else (b, "^"), score - (COST["drop"] if edge and (c == "!" or c not in LEET) else COST["sign"]), text)
        last, paths = c, new
    ended = [(score + (model.log(a, b, "^") if b != "^" else 0.0), text) for (a, b), (score, text) in paths.items()]
    top = max(score for score, _ in ended)
    return max(_spelt(text) for score, text in ended if score == top).strip()


def suspicious(token: str) -> bool:
    """Whether a lower-cased token's lattice has more than one path worth decoding: letters with signs within, a letter three times in a row, or many doubled ones."""
    core = token.strip(MARKS)
    if _PLAIN(core):
        # signs that are letters may also stand at an edge ("$tupid"): decoded unless they are a mark's usual place
        return _TRIPLE(core) is not None or len(_DOUBLES(core)) >= STRETCHED or any(ch in token for ch in "@$|+€£")
    return len(core) > 1 and any(ch in LETTERS for ch in core)


def words_behind(token: str, model: CharModel) -> tuple[str, ...]:
    """The restored words of a token, and the token itself without its marks."""
    core = token.strip(MARKS)
    found = tuple(dict.fromkeys(restore(token, model).split())) if suspicious(token) else ()
    return (*found, core) if core and core not in found else found


_ODD_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WHITE, _LOWER_CASE, _END_MARK, _TAIL = (np.zeros(256, bool) for _ in range(4))
_WHITE[[*range(9, 14), *range(28, 33)]] = True
_LOWER_CASE[range(97, 123)] = True
_END_MARK[[ord(m) for m in ".,;:!?"]] = True
_TAIL[[*range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = True  # behind 0xC3: small letters


class Tokens:
    """A batch of whole texts as distinct lower-cased tokens between white space, each with where it stands.

    An easy token is a word of small Latin letters, with at most one common mark behind it that isn't counted to it, and
    with no letters repeated so that it would have to be decoded; all others are odd. Tokens and words are told apart by
    64-bit hashes of their bytes.
    """

    def __init__(self, texts: list[str]):
        low = [t.lower() for t in texts]
        low = [t if t.isascii() or _ODD_SPACE.search(t) is None else _ODD_SPACE.sub(" ", t) for t in low]
        coded = [t.encode() for t in low]
        self.raw = b"\n".join(coded) + b"\n"
        self.data = data = np.frombuffer(self.raw, np.uint8)
        white = _WHITE[data]
        before = np.concatenate([[True], white[:-1]])
        begin, end = np.flatnonzero(~white & before), np.flatnonzero(white & ~before)
        starts = np.cumsum([0, *(len(c) + 1 for c in coded[:-1])])
        self.doc = np.searchsorted(starts, begin, "right") - 1
        end -= (end - begin > 1) & _END_MARK[data[end - 1]]
        easy = _LOWER_CASE[data]
        two = np.zeros(len(data), bool)
        two[1:] = (data[:-1] == 0xC3) & _TAIL[data[1:]]
        easy |= two
        easy[:-1] |= two[1:]
        again = np.zeros(len(data), np.int8)
        again[1:] = (data[1:] == data[:-1]) & _LOWER_CASE[data[1:]]
        again[3:] += two[3:] & two[1:-2] & (data[3:] == data[1:-2])
        count = lambda x: np.concatenate([[0], np.cumsum(x)])
        good, repeats = count(easy), count(again)
        simple = (good[end] - good[begin] == end - begin) & (repeats[end] - repeats[np.minimum(begin + 1, end)] < 2)
        # an odd token keeps its mark
        back = ~simple & (end < len(data)) & ~white[end]
        end[back] += 1
        self.begin, self.end, self.simple, self.hashes = begin, end, simple, SpanHasher(data)
        if len(begin):
            _, first, place, times = np.unique(self.hashes(begin, end), return_index=True, return_inverse=True, return_counts=True)
        else:
            first = place = times = np.zeros(0, np.int64)
        self.first, self.place, self.times = first, place, times

    def text(self, k: int) -> bytes:
        """A distinct token."""
        return self.raw[self.begin[self.first[k]] : self.end[self.first[k]]]

    def odd(self) -> list[int]:
        return np.flatnonzero(~self.simple[self.first]).tolist()


def trigram_counts(texts: list[str]) -> np.ndarray:
    """How often each trigram of the plain words occurs, "^^" before and "^" behind each; by rank of letters, base len(LETTERS) + 1."""
    base, t = len(LETTERS) + 1, Tokens(texts)
    easy = np.flatnonzero(t.simple[t.first])
    buffer, begin, end, times = t.raw, t.begin[t.first[easy]], t.end[t.first[easy]], t.times[easy]
    more = [(w.encode(), t.times[k]) for k in t.odd() if _PLAIN(w := t.text(k).decode().strip(MARKS))]
    if more:
        size = np.array([len(w) for w, _ in more])
        stop = len(buffer) + np.cumsum(size)
        begin, end, times = np.concatenate([begin, stop - size]), np.concatenate([end, stop]), np.concatenate([times, [n for _, n in more]])
        buffer += b"".join(w for w, _ in more)
    if not len(begin):
        return np.zeros(base**3, np.int64)
    # letters by rank, one place a letter: bytes that continue a letter are dropped
    n = end - begin
    at = np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)
    data = np.frombuffer(buffer, np.uint8)
    owner = np.repeat(np.arange(len(n)), n)
    lead = (data[at] & 0xC0) != 0x80
    wide = data[at] >= 0xC0
    follow = data[np.minimum(at + 1, len(data) - 1)]
    point = np.where(wide, (data[at].astype(np.int64) & 0x1F) << 6 | follow & 0x3F, data[at])
    rank, owner = _RANK[point[lead]], owner[lead]
    n = np.bincount(owner, minlength=len(n))
    # each word as two zeros, its letters, a zero
    stop = np.cumsum(n + 3)
    coded = np.zeros(int(stop[-1]), np.int64)
    coded[np.repeat(stop - n - 1, n) + np.arange(len(rank)) - np.repeat(np.cumsum(n) - n, n)] = rank
    grams = coded[:-2] * base * base + coded[1:-1] * base + coded[2:]
    weight = np.repeat(times, n + 3)[:-2]
    weight[stop[:-1] - 2] = weight[stop[:-1] - 1] = 0  # those over two words
    return np.bincount(grams, weight, base**3).astype(np.int64)


_RANK = np.full(0x800, -1)
_RANK[[ord(c) for c in LETTERS]] = np.arange(1, len(LETTERS) + 1)  # 0 is "^"


def restored_words(text: str, model: CharModel, memo: dict[bytes, tuple[str, ...]]) -> set[str]:
    """Distinct restored words of a whole text."""
    return set(Words([text], model, memo).texts())


class Words:
    """The distinct restored words of a batch of whole texts, and its distinct pairs (text, word), by text.

    Easy tokens are words as they are. Each distinct odd token is decoded once and kept in the memo, and runs of SPACED or
    more single characters are decoded together. halves (hashes of beginnings, ends and words): two easy neighbours that are
    a beginning and an end, and make up one of the words, are decoded together too.
    """

    def __init__(self, texts: list[str], model: CharModel, memo: dict[bytes, tuple[str, ...]], halves=None, keep: int = 200_000):
        t = Tokens(texts)
        if len(memo) > keep:
            memo.clear()
        docs, words = [], []  # of the pairs; words are places in the buffer's spans
        easy = t.simple[t.first]
        index = np.full(len(t.first), -1)
        index[easy] = np.arange(int(easy.sum()))
        word = index[t.place] if len(t.place) else t.place
        docs.append(t.doc[word >= 0])
        words.append(word[word >= 0])
        n_easy = int(easy.sum())
        extra: dict[str, int] = {}

        def decoded(key: bytes, restoring) -> list[int]:
            got = memo.get(key)
            if got is None:
                got = memo[key] = restoring(key.decode(), model)
            return [n_easy + extra.setdefault(w, len(extra)) for w in got]

        def add(d: int, stretch: bytes) -> None:
            own = decoded(stretch, lambda text, model: tuple(restore(text, model).split()))
            docs.append(np.full(len(own), d))
            words.append(np.array(own, np.int64))

        odd = t.odd()
        if odd:
            lists = [decoded(t.text(k), words_behind) for k in odd]
            size = np.zeros(len(t.first), np.int64)
            size[odd] = [len(x) for x in lists]
            start = np.zeros(len(t.first), np.int64)
            start[odd] = np.cumsum(size[odd]) - size[odd]
            flat = np.array([w for x in lists for w in x], np.int64)
            at = np.flatnonzero(size[t.place])
            times = size[t.place[at]]
            docs.append(np.repeat(t.doc[at], times))
            words.append(flat[np.repeat(start[t.place[at]] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))])
        continued = np.concatenate([[0], np.cumsum((t.data & 0xC0) == 0x80)])
        single = np.flatnonzero(t.end - t.begin - (continued[t.end] - continued[t.begin]) == 1)
        if len(single) >= SPACED:
            new = np.flatnonzero(np.concatenate([[True], (np.diff(single) > 1) | (np.diff(t.doc[single]) > 0)]))
            for a, n in zip(single[new].tolist(), np.diff(new, append=len(single)).tolist(), strict=True):
                if n >= SPACED:
                    add(int(t.doc[a]), b" ".join(t.raw[t.begin[i] : t.end[i]] for i in range(a, a + n)))
        if halves is not None and len(word) > 1:
            keys = t.hashes(t.begin[t.first[easy]], t.end[t.first[easy]])
            head, tail = np.isin(keys, halves[0]), np.isin(keys, halves[1])
            at = np.flatnonzero((word[:-1] >= 0) & (word[1:] >= 0) & (t.doc[:-1] == t.doc[1:]))
            for i in at[head[word[at]] & tail[word[at + 1]]].tolist():
                a, b = (t.raw[t.begin[j] : t.end[j]] for j in (i, i + 1))
                if a + b in halves[2]:
                    add(int(t.doc[i]), a + b" " + b)
        # one buffer with a span for each word; words that decoding and plain tokens share are one
        coded = [w.encode() for w in extra]
        size = np.array([len(c) for c in coded], np.int64)
        stop = len(t.raw) + np.cumsum(size)
        self.raw = t.raw + b"".join(coded)
        begin, end = np.concatenate([t.begin[t.first[easy]], stop - size]), np.concatenate([t.end[t.first[easy]], stop])
        self.data = np.frombuffer(self.raw, np.uint8)
        doc, word = np.concatenate(docs).astype(np.int64), np.concatenate(words).astype(np.int64)
        if len(begin):
            self.hashes = SpanHasher(self.data)
            keys = self.hashes(begin, end)
            self.keys, first, same = np.unique(keys, return_index=True, return_inverse=True)
            self.begin, self.end = begin[first], end[first]
            pairs = np.unique(doc * len(first) + same[word])
            self.doc, self.word = pairs // len(first), pairs % len(first)
        else:
            self.keys, self.begin, self.end, self.doc, self.word = np.zeros(0, np.uint64), begin, end, doc, word

    def texts(self) -> list[str]:
        return [self.raw[a:b].decode() for a, b in zip(self.begin.tolist(), self.end.tolist(), strict=True)]

    def signs(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the signs of each word, a row a word, and which of them it has: itself, its beginnings of 3 to 6 letters, its endings of 4 and 5."""
        begin, end = self.begin, self.end
        leads = (self.data & 0xC0) != 0x80
        before = np.concatenate([[0], np.cumsum(leads)])
        letter = before[begin]
        n = before[end] - letter
        lead = np.append(np.flatnonzero(leads), len(self.data))
        keys, has = np.empty((len(begin), 7), np.uint64), np.zeros((len(begin), 7), bool)
        keys[:, 0], has[:, 0] = self.keys, True
        for col, k in enumerate((3, 4, 5, 6), 1):
            has[:, col] = n > k
            keys[:, col] = self.hashes(begin, lead[letter + np.minimum(k, n)]) + np.uint64(1)
        for col, k in enumerate((4, 5), 5):
            has[:, col] = n > k
            keys[:, col] = self.hashes(lead[letter + n - np.minimum(k, n)], end) + np.uint64(2)
        return keys, has


def _count_trigrams(batches: Iterator) -> Iterator:
    import pandas as pd

    signs = "^" + LETTERS
    base = len(signs)
    total = np.zeros(base**3, np.int64)
    for batch in batches:
        texts = batch["text"].tolist()
        for lo, hi in _stretches(texts):
            total += trigram_counts(texts[lo:hi])
    seen = np.flatnonzero(total)
    grams = [signs[k // base**2] + signs[k // base % base] + signs[k % base] for k in seen.tolist()]
    yield pd.DataFrame({"gram": grams, "n": total[seen]}).astype({"gram": object, "n": "int64"})


def lower_bound(k: np.ndarray, n: np.ndarray, z: float = 2.5) -> np.ndarray:
    """Wilson's lower bound of a share."""
    p = k / n
    return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _hashes(parts: list[bytes]) -> np.ndarray:
    size = np.array([len(x) for x in parts], np.int64)
    stop = np.cumsum(size)
    return np.unique(span_hashes(np.frombuffer(b"".join(parts) + b"\0", np.uint8), stop - size, stop)) if len(parts) else np.zeros(0, np.uint64)


def _stretches(texts: list[str], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about that many characters; a longer text stands alone."""
    lo = n = 0
    for hi, text in enumerate(texts, 1):
        n += len(text)
        if n >= size or hi == len(texts):
            yield lo, hi
            lo, n = hi, 0


def train_char_model(train: DataFrame, text: str = "text") -> CharModel:
    """Trigram counts over every training text; combined per task and on Spark, at most one row a trigram of the fixed alphabet comes back."""
    rows = train.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = rows.mapInPandas(_count_trigrams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return CharModel({r["gram"]: r["n"] for r in counts.collect()})


def _count_signs(shared):
    """Per task and sign: documents that hold it, toxic ones among them, and the word if the sign is a whole word."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        memo: dict = {}
        held: list[pd.DataFrame] = []

        def out(frames: list) -> pd.DataFrame:
            both = pd.concat(frames)
            return both.groupby("sign", sort=False, as_index=False).agg({"n": "sum", "k": "sum", "word": "first"})

        for batch in batches:
            texts, toxic = batch["text"].tolist(), batch["toxic"].to_numpy(bool)
            for lo, hi in _stretches(texts):
                w = Words(texts[lo:hi], shared.value, memo)
                keys, has = w.signs()
                if not len(keys):
                    continue
                sign, first, same = np.unique(keys[has], return_index=True, return_inverse=True)
                row = np.flatnonzero(has.ravel())
                # (text, sign) once each
                number = np.full(has.size, -1)
                number[row] = same
                number = number.reshape(has.shape)[w.word]
                doc = np.repeat(w.doc, 7)[number.ravel() >= 0]
                pairs = np.unique(doc * len(sign) + number.ravel()[number.ravel() >= 0])
                doc, own = pairs // len(sign), pairs % len(sign)
                bad = toxic[lo:hi][doc]
                whole = row[first] % 7 == 0
                at = row[first] // 7
                word = [w.raw[w.begin[i] : w.end[i]].decode() if is_word else None for i, is_word in zip(at.tolist(), whole.tolist(), strict=True)]
                held.append(pd.DataFrame({"sign": sign.view(np.int64), "n": np.bincount(own, minlength=len(sign)), "k": np.bincount(own[bad], minlength=len(sign)), "word": word}).astype({"word": object}))
                if sum(map(len, held)) > 500_000:
                    held = [out(held)]
                    if len(held[0]) > 400_000:
                        yield held.pop()
        if held:
            yield out(held)

    return run


class Scorer:
    """Signs with their evidence (logit of the bound) and the logistic fit over a document's strongest signs."""

    def __init__(self, chars: CharModel, signs: np.ndarray, evidence: np.ndarray, floor: float, words: list[str] = ()):
        """signs: hashes; evidence: their values, none below floor; words: those that alone speak for toxicity."""
        order = np.argsort(signs)
        self.chars, self.signs, self.evidence, self.floor = chars, signs[order], evidence[order], floor
        self.weights = np.array([0.0, 1.0, 0.0, 0.0])
        self.memo: dict[bytes, tuple[str, ...]] = {}
        # for halves: each has two letters and more
        wholes = {w.encode() for w in words if len(w) > 3}
        parts = [(w[:k].encode(), w[k:].encode()) for w in words for k in range(2, len(w) - 1)]
        self.halves = (_hashes([a for a, _ in parts]), _hashes([b for _, b in parts]), wholes)

    def __getstate__(self):
        return {**self.__dict__, "memo": {}}

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: 1, strongest and second strongest evidence of its distinct words, logarithm of the number of words."""
        out = np.tile(np.array([1.0, self.floor, self.floor, 0.0]), (len(texts), 1))
        for lo, hi in _stretches(texts):
            w = Words(texts[lo:hi], self.chars, self.memo, self.halves)
            if not len(w.doc):
                continue
            keys, has = w.signs()
            value = np.full(keys.shape, self.floor)
            if len(self.signs):
                at = np.minimum(np.searchsorted(self.signs, keys), len(self.signs) - 1)
                hit = has & (self.signs[at] == keys)
                value[hit] = np.maximum(self.evidence[at[hit]], self.floor)
            own = value.max(1)[w.word]
            at = np.flatnonzero(np.concatenate([[True], w.doc[1:] != w.doc[:-1]]))
            size = np.diff(at, append=len(w.doc))
            top = np.maximum.reduceat(own, at)
            hits = np.flatnonzero(own == np.repeat(top, size))
            own[hits[np.unique(w.doc[hits], return_index=True)[1]]] = self.floor  # one of the strongest goes
            rows = lo + w.doc[at]
            out[rows, 1], out[rows, 2], out[rows, 3] = top, np.maximum.reduceat(own, at), np.log1p(size)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, prior: float = 1e-2, rounds: int = 50) -> None:
        """Newton's steps of a ridge logistic regression."""
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + prior * np.eye(len(w))
            step = np.linalg.solve(h, x.T @ (y - p) - prior * w)
            w = w + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -30.0, 30.0)))


def train_scorer(docs: DataFrame, labels: DataFrame, held_fold: int = 0, fit_rows: int = 30_000, doc_id: str = "doc_id", text: str = "text") -> Scorer:
    """Learns from documents whose fold is not held_fold: characters from all of them, signs and the fit from labelled ones.

    At most fit_rows labelled documents are used (the least hashes of their ids), the only bounded sample here: it
    bounds the sign table and the broadcast of the sample's ids (16 bytes each). One fold of the sample calibrates, the
    others count signs. Null labels and ids are left out; ids labelled more than once count as toxic if any label says so.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("fold", crc_fold("doc_id"))
    rows = rows.filter(F.col("fold") != held_fold)
    chars = spark.sparkContext.broadcast(train_char_model(rows))
    marks = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    marks = marks.filter(crc_fold("doc_id") != held_fold).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    sample = rows.join(F.broadcast(marks), "doc_id").select("fold", "text", "toxic")
    calibrating = (held_fold + 1) % 5
    signs = sample.filter(F.col("fold") != calibrating).select("text", "toxic").mapInPandas(_count_signs(chars), "sign long, n long, k long, word string")
    table = signs.groupBy("sign").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.first("word", ignorenulls=True).alias("word")).filter("k >= 2").toPandas()
    share = marks.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    share = min(max(share, 1e-3), 0.5)
    floor = math.log(share / (1 - share))
    low = np.clip(lower_bound(table["k"].to_numpy(float), table["n"].to_numpy(float)), 1e-6, 1 - 1e-6)
    logit = np.log(low / (1 - low))
    some = logit > floor
    strong = [w for w in table["word"][some & (logit > 0)] if isinstance(w, str)]
    scorer = Scorer(chars.value, table["sign"].to_numpy(np.int64)[some].view(np.uint64), logit[some], floor, sorted(strong))
    shared = spark.sparkContext.broadcast(scorer)

    def features(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            x = shared.value.features(batch["text"].tolist())
            yield pd.DataFrame({"a": x[:, 1], "b": x[:, 2], "c": x[:, 3], "y": batch["toxic"].astype(float)})

    known = sample.filter(F.col("fold") == calibrating).select("text", "toxic").mapInPandas(features, "a double, b double, c double, y double").toPandas()
    if known["y"].nunique() == 2:
        scorer.fit(np.column_stack([np.ones(len(known)), known[["a", "b", "c"]].to_numpy(float)]), known["y"].to_numpy(float))
    else:  # nothing to calibrate on: the evidence itself
        scorer.weights = np.array([0.0, 1.0, 0.0, 0.0])
    return scorer


def score_toxicity(docs: DataFrame, scorer: Scorer, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with `score` (0 to 1) and `predicted` (1 from 0.5); null and empty texts score as texts without words; all other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    keep = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                score = shared.value.scores([t or "" for t in some.column(keep.index(text)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    kept = docs.select(*keep)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs, train_scorer(docs, labels))
    return scored.select("doc_id", (crc_fold("doc_id") == 0).alias("held_out"), "score", "predicted")
