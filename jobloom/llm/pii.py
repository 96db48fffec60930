"""Personal data by candidate gradient boosting.

Strict patterns give base spans of four kinds. Generators propose many more, overlapping candidates: windows over groups of
digits, and local parts and domains around anything that may stand for an at sign. Boosted trees, one model a kind,
judge a candidate by its format and surroundings; probabilities are calibrated and cut where a precision is certified on rows
the trees haven't seen. Labels are weak: base spans in their surroundings, and the same spans rewritten (run together
with others, obfuscated, regrouped) are right; candidates that cut or overrun them, that fail their kind's check after a digit was
changed, or that stand where no pattern matched, are wrong.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never begins inside a run of digits, so each run is tried once
QUAD = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
DIGITS_APART = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
GROUP = re.compile(r"[0-9]+")


def passes_luhn(digits: str) -> bool:
    odd, even = sum(map(int, digits[-1::-2])), sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def octets_fit(parts: list[str]) -> bool:
    return all(len(p := x.lstrip("0")) < 3 or len(p) == 3 and int(p) <= 255 for x in parts)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, found from their at signs: a local part is the whole run before one, so no word is scanned twice."""
    at, floor = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1] in LOCAL:
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        floor = found.end() if found else at + 1
        if found:
            yield begin, floor
        at = text.find("@", floor)


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the strict patterns' valid matches, sorted, and those of the matches that failed their check."""
    good, bad = [(s, EMAIL, e) for s, e in _emails(text)], []
    if DIGIT.search(text):
        for kind, pattern in ((IP, QUAD), (CARD, DIGITS_APART), (PHONE, PLUS)):
            if kind == PHONE and "+" not in text:
                continue
            for m in pattern.finditer(text):
                if kind == IP:
                    ok = octets_fit(m[0].split("."))
                else:
                    digits = "".join(GROUP.findall(m[0]))
                    ok = 14 <= len(digits) <= 19 and passes_luhn(digits) if kind == CARD else 10 <= len(digits) <= 15
                (good if ok else bad).append((m.start(), kind, m.end()))
    return sorted(good), bad


# what may stand for an at sign or a dot, fixed values
AT_SIGNS = ("@", "＠", "(at)", "[at]", "{at}", "<at>", "(AT)", "[AT]", " at ", " AT ")
DOT = r"(?:\.|\s?[(\[{<]\s?(?:dot|DOT|\.)\s?[)\]}>]\s?|\x20(?:dot|DOT)\x20)"
LABELS = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{1,63}})*")
LABEL_DOT = re.compile(DOT)
GAP = re.compile(r"[\x20 .()\-/+\[\]]{1,3}|\s?[(\[{<]\s?(?:dot|DOT|\.)\s?[)\]}>]\s?|\x20(?:dot|DOT)\x20")
# words that speak for a kind when they stand before, and words that speak for other numbers
HINTS = (("mail", "contact"), ("ip", "host", "server", "addr"), ("card", "visa", "credit", "pay"), ("phone", "tel", "call", "fax", "mobile"))
OTHERS = ("version", "order", "isbn", "invoice", "serial", "page", "ref", "date")
NEAR = 24
FEATURES = 30

Candidate = tuple[int, int, int, list[float], str]


def _around(text: str, kind: int, start: int, end: int) -> list[float]:
    before = text[max(0, start - NEAR) : start].lower()
    left, right = text[start - 1 : start] if start else "", text[end : end + 1]
    after = text[end + 1 : end + 2]
    side = lambda c: 0.0 if c == "" or c.isspace() else 2.0 if c.isalpha() else 3.0 if c.isdigit() else 1.0
    return [side(left), side(right), side(after), float(right in ("", " ", "\n")), float(any(h in before for h in HINTS[kind])), float(any(h in before for h in OTHERS)), float(any(h in before for k, hs in enumerate(HINTS) if k != kind for h in hs))]


def _numeric(text: str) -> Iterator[Candidate]:
    """Windows over neighbouring groups of digits. A group has at most ten windows and none over 19 digits, so work follows the text."""
    groups = [m.span() for m in GROUP.finditer(text)]
    gaps = [text[a[1] : b[0]] for a, b in zip(groups, groups[1:])]
    joined = [len(g) <= 9 and GAP.fullmatch(g) is not None for g in gaps]
    run_end = len(groups)
    ends = [0] * len(groups)
    for i in range(len(groups) - 1, -1, -1):
        run_end = run_end if i < len(groups) - 1 and joined[i] else i + 1
        ends[i] = run_end
    run_start = 0
    for i, (begin, _) in enumerate(groups):
        if i and not joined[i - 1]:
            run_start = i
        total = 0
        for j in range(i, min(ends[i], i + 10)):
            total += groups[j][1] - groups[j][0]
            if total > 19:
                break
            if total < 4 or j == i and total < 7:
                continue
            sizes = [b - a for a, b in groups[i : j + 1]]
            inner = gaps[i:j]
            kinds = []
            if len(sizes) == 4 and max(sizes) <= 3:
                kinds.append(IP)
            if 13 <= total <= 19:
                kinds.append(CARD)
            if 7 <= total <= 15 and (len(sizes) > 1 or text[begin - 1 : begin] == "+" or text[begin : begin + 2] == "00"):
                kinds.append(PHONE)
            for kind in kinds:
                start, end = begin, groups[j][1]
                if kind == PHONE:
                    while start > 0 and text[start - 1] in "+(" and begin - start < 2:
                        start -= 1
                digits = "".join(text[a:b] for a, b in groups[i : j + 1])
                shape = "".join(inner)
                x = [
                    float(total), float(passes_luhn(digits)), float(len(sizes)), float(min(sizes)), float(max(sizes)), float(sizes[0]), float(sizes[-1]),
                    float(len(set(inner))), float(shape.count(" ")), float(shape.count(".")), float(shape.count("-")), float(sum(map(shape.count, "()"))), float("[" in shape or "dot" in shape.lower()),
                    float(text[start] == "+"), float(text[start] == "("), float(text[start:end].count("(") == text[start:end].count(")")),
                    float(min(9, i - run_start)), float(min(9, ends[i] - j - 1)), float(len(sizes) == 4 and octets_fit([text[a:b] for a, b in groups[i : j + 1]])),
                    float(sum(1 for a, b in groups[i : j + 1] if b - a > 1 and text[a] == "0")),
                    0.0 if i == run_start else 1.0 if gaps[i - 1] == " " else 2.0, 0.0 if j + 1 == ends[i] else 1.0 if gaps[j] == " " else 2.0,
                    *_around(text, kind, start, end),
                ]
                yield kind, start, end, x, GROUP.sub(lambda m: f"d{len(m[0])}", text[start:end])


def _addresses(text: str) -> Iterator[Candidate]:
    """Around each sign that may mean at: the run of local characters before it, with every number of labels from two on behind it."""
    for sign in AT_SIGNS:
        p = text.find(sign)
        while p >= 0:
            left = p - 1 if sign[0] != " " and text[p - 1 : p] == " " else p
            right = p + len(sign)
            right += sign[-1] != " " and text[right : right + 1] == " "
            begin = left
            while begin > 0 and left - begin < 64 and text[begin - 1] in LOCAL:
                begin -= 1
            found = LABELS.match(text, right) if begin < left else None
            dots = list(LABEL_DOT.finditer(text, found.start(), found.end())) if found else []
            for k in range(1, min(len(dots), 8) + 1):
                end = dots[k].start() if k < len(dots) else found.end()
                used = [d[0] for d in dots[:k]]
                last = text[dots[k - 1].end() : end]
                local = text[begin:left]
                x = [
                    float(AT_SIGNS.index(sign)), float(left < p) + float(right > p + len(sign)), float(len(local)), float(sum(map(str.isdigit, local))), float("." in local), float(local[-1] in "._%+-"),
                    float(k + 1), float(len(last)), float(last.isalpha()), float(sum(d == "." for d in used)), float(sum(d.strip().lower() == "dot" for d in used)), float(sum(d.strip()[:1] in ("(", "[", "{", "<") for d in used)),
                    float(len(dots) - k), float(len(set(used))), float(end - right), float(begin > 0 and text[begin - 1] in LOCAL), *[0.0] * 6, *_around(text, EMAIL, begin, end),
                ]
                yield EMAIL, begin, end, x, f"{sign.strip().lower()} {' '.join(d.strip().lower() for d in used)}"
            p = text.find(sign, p + len(sign))


def candidates(text: str) -> list[Candidate]:
    out = list(_addresses(text)) if any(s in text for s in AT_SIGNS) else []
    if DIGIT.search(text):
        out += _numeric(text)
    return out


def _check(kind: int, span: str) -> bool:
    parts = GROUP.findall(span)
    digits = "".join(parts)
    return kind == EMAIL or (octets_fit(parts) if kind == IP else 13 <= len(digits) <= 19 and passes_luhn(digits) if kind == CARD else 7 <= len(digits) <= 15)


def _rewritten(kind: int, span: str, salt: int) -> list[str]:
    """Other ways to write a span of a kind."""
    pick = lambda *xs: xs[salt % len(xs)]
    if kind == EMAIL:
        local, _, domain = span.partition("@")
        at, dot = pick(" at ", "(at)", " [at] ", " (at) ", " AT ", "[at]", "＠", " @ "), pick(" dot ", "(dot)", "[.]", " [dot] ", " DOT ", "[dot]", ".", ".")
        short = domain.partition(".")[2] if domain.count(".") > 1 else domain
        return [local + at + domain.replace(".", dot), local + at + domain, local + at + short.replace(".", dot), local + at + short]
    digits = "".join(GROUP.findall(span))
    if kind == IP:
        return [span.replace(".", pick("[.]", "(.)", " dot ", "(dot)", "[dot]", " . "))]
    if kind == CARD:
        return [pick(" ", "-", ".", " - ").join(digits[k : k + 4] for k in range(0, len(digits), 4))]
    area = [digits[:-10], digits[-10:-7], digits[-7:-4], digits[-4:]]
    local = pick("({1}) {2}-{3}", "{1}-{2}-{3}", "{1}.{2}.{3}", "({1}){2}-{3}").format(*area)
    whole = pick("00{0} {1} {2} {3}", "+{0}-{1}-{2}-{3}", "+{0}.{1}.{2}.{3}", "+{0} {1} {2} {3}").format(*area)
    return [local, whole]


def _spoilt(kind: int, span: str, salt: int) -> list[str]:
    """Texts that look like a span of its kind and are none: a failed check, other separators, other groups."""
    if kind == EMAIL:
        return [span.replace("@", " at ").replace(".", ". ")]
    digits = "".join(GROUP.findall(span))
    if kind == CARD:
        return [span[:-1] + str((int(span[-1]) + 1 + salt % 8) % 10), ("-", " ", ".")[salt % 3].join(digits[k : k + 2] for k in range(0, len(digits), 2))]
    if kind == IP:
        parts = span.split(".")
        wrong = [*parts]
        wrong[salt % 4] = str(256 + salt % 700)
        return [".".join(wrong), (" ", "-", "/", ", ")[salt % 4].join(parts), (". ", " - ")[salt % 2].join(parts)]
    return [span[: len(span) // 2], (".", " ", "-")[salt % 3].join([*digits[-7:-4], digits[-4:]]), ("-", " ", "/")[salt % 3].join(digits[k : k + 2] for k in range(0, len(digits), 2))]


def weak_examples(docs_text: list[str], each: int = 4, margin: int = 40) -> Iterator[tuple[int, int, list[float], str]]:
    """(kind, label, features, shape) of candidates around the texts' base spans and of decoys; at most `each` spans and 16 decoys a text."""
    last: list[tuple[int, str]] = []

    def judged(text: str, truth: set[tuple[int, int, int]]) -> Iterator[tuple[int, int, list[float], str]]:
        for kind, s, e, x, shape in candidates(text):
            yield kind, int((kind, s, e) in truth), x, shape

    for text in docs_text:
        salt = int.from_bytes(hashlib.blake2b(text[:256].encode("utf-8", "surrogatepass"), digest_size=4).digest(), "big")
        good, bad = base_spans(text)
        taken, decoys = [(s, e) for s, _, e in good + bad], 0
        if not good and not bad and not any(s in text for s in AT_SIGNS[:8]) and not DIGIT.search(text):
            continue
        for kind, s, e, x, shape in candidates(text):
            if decoys < 16 and (not any(a < e and s < b for a, b in taken) or not _check(kind, text[s:e]) and not any(a < e and s < b for a, _, b in good)):
                decoys += 1
                yield kind, 0, x, shape
        for n, (s, kind, e) in enumerate(good[:each]):
            if e - s > 100 or any(a < e and s < b for a, _, b in good if (a, b) != (s, e)):
                continue
            left, own, right = text[max(0, s - margin) : s], text[s:e], text[e : e + margin]
            left = re.sub(r"[0-9@+]", "", left)  # the surroundings hold no other data
            right = re.sub(r"[0-9@+]", "", right)
            made: list[tuple[str, set]] = [(left + own + right, {(kind, len(left), len(left) + len(own))})]
            for other, what in last[-3:]:
                sep = (" ", ", ", " ", "; ", "\n")[(salt + n) % 5]
                for (k1, a), (k2, b) in (((kind, own), (other, what)), ((other, what), (kind, own))):
                    p = len(left)
                    made.append((left + a + sep + b + right, {(k1, p, p + len(a)), (k2, p + len(a) + len(sep), p + len(a) + len(sep) + len(b))}))
            for k, new in enumerate([*_rewritten(kind, own, salt + n), *_rewritten(kind, own, salt + n + 3)]):
                pad = left if left[-1:].isspace() or not left else left + " "
                made.append((pad + new + (right if k % 2 or right[:1] in (" ", "\n", "") else " " + right), {(kind, len(pad), len(pad) + len(new))}))
            made += [(left + wrong + right, set()) for wrong in _spoilt(kind, own, salt + n)]
            last = [*last[-7:], (kind, own)]
            for snippet, truth in made:
                yield from judged(snippet, truth)


class KindModel:
    """Trees, calibration and threshold of one kind; shapes are encoded by their weight of evidence."""

    def __init__(self, shapes: dict[str, float], trees, slope: float, offset: float, threshold: float):
        self.shapes, self.trees, self.slope, self.offset, self.threshold = shapes, trees, slope, offset, threshold

    def probabilities(self, x: list[list[float]], shapes: list[str]):
        import numpy as np

        full = np.concatenate([np.array(x, float).reshape(len(x), -1), np.array([[self.shapes.get(s, 0.0), s in self.shapes] for s in shapes], float).reshape(-1, 2)], 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.trees.margins(full) + self.offset, -30, 30)))


def fit_kind(fold, x, y, shape, precision: float) -> KindModel | None:
    """Shapes from folds 0 to 2 of the documents, trees from 3 to 6, calibration and threshold from 7 to 9; None without both labels in each."""
    import numpy as np

    from .boosting import Boosted, calibrated, precise_threshold

    told, grown, held = fold < 3, (fold >= 3) & (fold < 7), fold >= 7
    if any(len(np.unique(y[m])) < 2 for m in (told, grown, held)):
        return None
    counts: dict[str, list[float]] = {}
    for s, v in zip(shape[told].tolist(), y[told].tolist(), strict=True):
        counts.setdefault(s, [0.0, 0.0])[int(v)] += 1
    evidence = {s: float(np.log((b + 0.5) / (a + 0.5))) for s, (a, b) in counts.items()}
    full = np.concatenate([x, np.array([[evidence.get(s, 0.0), s in evidence] for s in shape.tolist()], float)], 1)
    trees = Boosted().fit(full[grown], y[grown].astype(float))
    margin = trees.margins(full[held])
    slope, offset = calibrated(margin, y[held])
    p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
    return KindModel(evidence, trees, slope, offset, precise_threshold(p, y[held].astype(float), precision))


def train_pii(docs: DataFrame, fit_docs: int = 20_000, precision: float = 0.97, doc_id: str = "doc_id", text: str = "text") -> dict[int, KindModel]:
    """A model a kind, from the weak examples of at most fit_docs documents (those with least hashes of their ids), the only bounded sample.

    At most four spans and 16 decoys of a document count, so a kind's examples fit one task, in which it is fitted; kinds are fitted
    side by side. Models (some thousand numbers) come to the driver. A kind without enough examples has no model and adds nothing.
    """
    ids = docs.select(F.col(doc_id).alias("_id")).filter("_id IS NOT NULL").orderBy(F.xxhash64("_id"), "_id").limit(fit_docs).distinct()
    rows = docs.filter(F.col(text).rlike("[0-9@]")).select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(ids), "_id", "left_semi")
    rows = rows.select("text", F.pmod(F.xxhash64("_id"), F.lit(10)).cast("int").alias("fold"))

    def examples(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for fold, part in batch.groupby("fold"):
                found = list(weak_examples(part["text"].tolist()))
                if found:
                    kind, y, x, shape = zip(*found, strict=True)
                    yield pd.DataFrame({"fold": int(fold), "kind": kind, "y": y, "x": list(x), "shape": shape})

    def fit(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.assign(order=pdf["x"].map(tuple)).sort_values(["fold", "shape", "y", "order"])
        model = fit_kind(pdf["fold"].to_numpy(), np.array(pdf["x"].tolist(), float), pdf["y"].to_numpy(), pdf["shape"].to_numpy(), precision)
        return pd.DataFrame({"kind": [int(pdf["kind"].iloc[0])], "model": [pickle.dumps(model)]})

    made = rows.mapInPandas(examples, "fold int, kind int, y int, x array<double>, shape string")
    fitted = made.groupBy("kind").applyInPandas(fit, "kind int, model binary").collect()
    return {r["kind"]: m for r in fitted if (m := pickle.loads(bytes(r["model"]))) is not None}


def _added(base: list[tuple[int, int, int]], scored: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates from the likeliest on that overlap neither base spans nor chosen ones; equal ones by length, then place."""
    taken = []  # disjoint and sorted
    for s, _, e in base:
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    out = []
    for _, kind, s, e in sorted(scored, key=lambda c: (-round(c[0], 6), c[2] - c[3], c[2], c[1])):
        k = bisect_left(taken, (s, e))
        if (k == 0 or taken[k - 1][1] <= s) and (k == len(taken) or e <= taken[k][0]):
            insort(taken, (s, e))
            out.append((s, kind, e))
    return out


def _found(models: dict[int, KindModel], texts: list[str]) -> list[list[tuple[int, int, int, bool]]]:
    """Per text all spans (start, kind, end, whether base), sorted."""
    base = [base_spans(t)[0] for t in texts]
    pools: dict[int, list] = {k: [] for k in models}
    for n, t in enumerate(texts):
        for c in candidates(t):
            if c[0] in pools:
                pools[c[0]].append((n, c))
    scored: list[list] = [[] for _ in texts]
    for kind, pool in pools.items():
        for lo in range(0, len(pool), 20_000):
            some = pool[lo : lo + 20_000]
            p = models[kind].probabilities([c[3] for _, c in some], [c[4] for _, c in some])
            for (n, c), v in zip(some, p.tolist(), strict=True):
                if v >= models[kind].threshold:
                    scored[n].append((v, kind, c[1], c[2]))
    return [sorted([(*b, True) for b in own] + [(*a, False) for a in _added(own, more)]) for own, more in zip(base, scored, strict=True)]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))


def find_pii(docs: DataFrame, models: dict[int, KindModel], text: str = "text") -> DataFrame:
    """docs with `spans`: kind, begin and end (code points, end exclusive) and whether a strict pattern found it, by begin, kind and end.

    Base spans all stay; added ones overlap nothing. Null and empty texts have no spans; every row is judged by itself, so repeated rows and
    null ids are rows like others. A column named spans is replaced, all other columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kept = docs.select(*[c for c in docs.columns if c != "spans"])
    place = kept.columns.index(text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shape = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                spans = _found(shared.value, [t or "" for t in some.column(place).to_pylist()])
                made = pa.array([[{"kind": KINDS[k], "begin": s, "end": e, "base": b} for s, k, e, b in own] for own in spans], shape)
                yield pa.RecordBatch.from_arrays([*some.columns, made], [*some.schema.names, "spans"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("spans", SPANS)]))


def redacted(found: DataFrame, text: str = "text") -> DataFrame:
    """found with the text's spans replaced by their kinds in brackets; of overlapping spans the first stands for all of them."""
    piece = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(done: Column, span: Column) -> Column:
        plain = F.substring(F.col(text), done["at"] + 1, span["begin"] - done["at"])
        return F.when(span["begin"] < done["at"], F.struct(done["out"].alias("out"), F.greatest(done["at"], span["end"]).alias("at"))).otherwise(
            F.struct(F.concat(done["out"], plain, F.lit("["), F.upper(span["kind"]), F.lit("]")).alias("out"), span["end"].alias("at"))
        )

    done = F.aggregate("spans", piece, step)
    return found.withColumn(text, F.when(F.col(text).isNotNull(), F.concat(done["out"], F.substring(F.col(text), done["at"] + 1, F.length(text)))))


def span_digest(spans: Column) -> Column:
    """kind:start:end of the spans in order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs, train_pii(docs)).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_digest(base), 256).alias("base_sha256"), span_digest(F.col("spans")).alias("spans"))
