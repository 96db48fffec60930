"""Filter audit, ranked search and personal data: brute force on small tables and the odd cases each names in its docstring."""

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import filters, lexical, pii
from jobloom.llm.boosting import Boosted, calibrated, precise_threshold
from jobloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeXYZ") for _ in range(3)) for _ in range(40)]
    long_text = " ".join(rng.choice(vocab) for _ in range(30_000))
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 90, 150]))), rng.choice(["en", "de", None, ""]), "a", 1, "x") for i in range(60)]
    rows += [(100 + i, "the same text again #", "en", "a", 1, "x") for i in range(50)]
    rows += [(200, None, None, None, None, None), (201, "", "en", "a", 0, "x"), (202, " \n\t", "en", "a", 0, "x"), (203, long_text, "fr", "a", 0, "x"), (None, "the same text again #", "en", "a", 1, "x")]
    rows += [rows[3], rows[3], rows[65], (205, long_text, "fr", "b", 0, "y"), (206, "ÄÖ ÀÉ A", "de", "b", 0, "y"), (207, "x\U0001f600y B \U0001f600", "de", "b", 0, "y")]
    return rows


# 11


def plain_audit(rows, labels):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    marks = {}
    for i, q, x in labels:
        a, b = marks.get(i, (False, False))
        marks[i] = (a or q == 1, b or x == 1)
    docs = []
    for i, t, part, *_ in rows:
        t = t or ""
        w = WORDS.findall(t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and least[t] < i,
        }
        docs.append((part or "", {k for k, v in fails.items() if v}, *(marks.get(i, (False, False)) if i is not None else (False, False))))
    out, total = {}, {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                early = sum(f in d[1] for d in mine) - len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), early, sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                total[part, f] = total.get((part, f), 0) + len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_equals_plain_orders(spark, odd):
    labels = [(1, 1, 0), (1, 0, 1), (3, 0, 1), (100, 1, 0), (110, 1, 1), (None, 1, 1), (200, None, None), (999, 1, 1)]
    docs, marks = table(spark, odd), table(spark, labels, "doc_id long, quality int, toxic int")
    got = filters.audit_orders(filters.with_labels(filters.text_failures(docs), marks)).toPandas()
    assert {(r.part, r.filter_order, r.step): tuple(getattr(r, c) for c in COUNTS) for r in got.itertuples()} == plain_audit(odd, labels)
    assert len(got) == 600 * len({r[2] or "" for r in odd})


def test_hot_copies_are_dealt_out(spark, odd):
    rows = table(spark, odd).select("doc_id", "text")
    got = sorted(r[0] for r in filters.earlier_copies(rows, least_share=1_000_000, least_rows=7).collect())
    least = {}
    for i, t, *_ in odd:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    assert got == sorted(i for i, t, *_ in odd if i is not None and least[t or ""] < i)


def test_audit_clashing_columns_and_empty_tables(spark, odd):
    clash = {c: F.lit("z") for c in ("bits", "n", "key", "part", "good", "toxic", "_hash", "_n", "_salt", "_first")}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int, part string, bits string, _id string")
    docs = table(spark, odd)
    a = filters.audit_orders(filters.with_labels(filters.text_failures(docs), none)).toPandas()
    b = filters.audit_orders(filters.with_labels(filters.text_failures(docs.withColumns(clash)), none)).toPandas()
    key = ["part", "filter_order", "step"]
    assert a.sort_values(key).reset_index(drop=True).equals(b.sort_values(key).reset_index(drop=True)) and a["good_lost"].sum() == 0
    assert filters.audit_orders(filters.with_labels(filters.text_failures(docs.limit(0)), none)).count() == 0


def test_audit_of_other_filters(spark):
    rows = table(spark, [("p", 0, 2, False, False), ("p", 3, 5, True, False), ("p", 1, 1, False, True)], "part string, bits int, n int, good boolean, toxic boolean")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in filters.audit_orders(rows, "XY").collect()}
    assert got == {("XY", 1): (2, 6, 0, 7), ("XY", 2): (2, 0, 5, 5), ("YX", 1): (3, 5, 0, 5), ("YX", 2): (2, 1, 5, 7)}


# 12


def plain_search(docs, items, k=10):
    term = re.compile(lexical.TERM)
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    texts = [(i, term.findall(low(t))) for i, t, *_ in docs]
    n_docs, n_terms = sum(bool(t) for _, t in texts), sum(len(t) for _, t in texts)
    df = {}
    for _, t in texts:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    asked = {}
    for q, t, *_ in items:
        asked.setdefault(q, set()).update(term.findall(low(t)))
    out = set()
    for q, ts in asked.items():
        scores = []
        for i, t in texts:
            if t:
                m = 10 + (90 * len(t) * n_docs) // n_terms
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * t.count(w)) // (1000 * t.count(w) + 8 * m)) for w in ts if w in df and w in t)
                if s > 0:
                    scores.append((-s, i is None, i))
        for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out.add((q, r, i, -s))
    return out


@pytest.fixture(scope="module")
def searched(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdé1") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    text = lambda n: rng.choice([" ", "-", "\n", "_"]).join(rng.choices(vocab, weights, k=n))
    docs = [(i, text(rng.choice([2, 10, 60])), "en", "a", 1, "x") for i in range(300)]
    docs += [(500 + i, docs[7][1].upper(), "en", "a", 1, "x") for i in range(25)]  # ties; é stays as it is
    docs += [(900, None, None, None, None, None), (901, "", "en", "a", 0, "x"), (902, "!? \t", "en", "a", 0, "x"), (None, text(30), "en", "a", 0, "x"), docs[3], docs[3], (903, text(20_000), "en", "a", 0, "x")]
    items = [(i, text(rng.choice([1, 5, 30])), "x") for i in range(12)] + [(20, None, "x"), (21, "", "x"), (22, "zzzzz", "x"), (3, text(4), "x"), (23, docs[7][1], "x"), (None, vocab[0] + " " + vocab[50], "x")]
    return docs, items


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 16, "block_terms": 40}, {"shard_postings": 50}])
def test_search_equals_plain_scores(spark, searched, sizes):
    docs, items = searched
    found = lexical.ranked_search(table(spark, docs).repartition(3), table(spark, items, "item_id long, text string, rank string"), **sizes)
    assert {tuple(r) for r in found.collect()} == plain_search(docs, items)


def test_search_stops_making_accumulators():
    rng = np.random.default_rng(1)
    n = 4000
    doc, term, tf = [], [], []
    for t, share in enumerate((0.01, 0.3, 0.9, 1.0)):
        rows = np.flatnonzero(rng.random(n) < share)
        doc.append(rows), term.append(np.full(len(rows), t)), tf.append(rng.integers(1, 4, len(rows)))
    shard = lexical.Shard(np.arange(n), np.zeros(n, bool), np.full(n, 50), *map(np.concatenate, (doc, term, tf)), n, n * 50)
    weights = [4600, 1200, 100, 3]
    got = shard.top([0, 1, 2, 3], weights, 10)
    assert shard.stops in (1, 2)  # the two common terms make no accumulator
    score = np.zeros(n, np.int64)
    for d, t, i in zip(shard.doc, np.repeat(shard.terms, shard.end - shard.begin), shard.impact, strict=True):
        score[d] += weights[t] * i
    want = np.lexsort((np.arange(n), -score))[:10]
    assert got == [(int(r), int(score[r])) for r in want]
    assert shard.top([0, 1, 2, 3], weights, 10, floor=sum(weights) * int(shard.most.max()) + 1) == [] and shard.stops == 0


def test_search_empty_sides(spark, searched):
    docs, items = table(spark, searched[0]), table(spark, searched[1], "item_id long, text string, rank string")
    assert lexical.ranked_search(docs.limit(0), items).count() == 0 and lexical.ranked_search(docs, items.limit(0)).count() == 0


# 13


def plain_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(9)
    pieces = ["a", "é", "@", ".", "-", "+", " ", "1", "25", "300", "4111111111111111", "(", ")", "b.c", "%", "\n", "7", "x@y.z", "1.2.3.4", "+1 (415) 555-2671", "4242 4242 4242 4242", "\U0001f600", "0" * 30]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text)[0] == plain_base(text), text
    assert pii.base_spans("a" * 300_000 + "@")[0] == [] and pii.base_spans("1" * 300_000)[0] == [] and pii.base_spans("1." * 100_000)[0] != []


@pytest.fixture(scope="module")
def pii_models(spark):
    return pii.train_pii(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_added_spans(pii_models):
    """What the strict patterns miss or swallow; held-out forms are written with other words, numbers and hosts than the corpus has."""
    wanted = {
        "Ring +1 (826) 555-4081 190.137.223.204 today": ["phone:+1 (826) 555-4081"], "ids 7536784127813050 4845168114407329 both": ["card:7536784127813050", "card:4845168114407329"],
        "or joe [at] mail.example.org please": ["email:joe [at] mail.example.org"], "ask jane_doe AT corp dot co dot uk now": ["email:jane_doe AT corp dot co dot uk"],
        "log 10[.]20[.]30[.]40 seen": ["ip:10[.]20[.]30[.]40"], "card 4111.1111.1111.1111 used": ["card:4111.1111.1111.1111"], "Call (415) 555-2671 now": ["phone:(415) 555-2671"],
    }
    for text, spans in wanted.items():
        got = [f"{pii.KINDS[k]}:{text[s:e]}" for s, k, e, base in pii._found(pii_models, [text])[0] if not base]
        assert got == spans, text
    for text in ("order 1234567890123456 shipped", "on 2024-01-02 10:11:12", "version 1.2.3.4567 of it", "he was at home.Then came", "meet at noon. dot com", "isbn 978-3-16-148410-0", "12 34 56 78 90 12", "", "1 2 3 4 5 6 7 8 9 10 11"):
        assert pii._found(pii_models, [text])[0] == [], text


def test_held_out_accuracy(spark, pii_models):
    """Spans of documents outside the sample, run together or rewritten, against texts that only look like them."""
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text RLIKE '[0-9@]'").select(F.reverse("text")).collect()]
    y, p = [], []
    for kind, hit, x, shape in pii.weak_examples([t[::-1] for t in texts]):
        if kind in pii_models:
            y.append(hit), p.append(pii_models[kind].probabilities([x], [shape])[0] >= pii_models[kind].threshold)
    y, p = np.array(y), np.array(p)
    assert y.sum() > 100 and (y & p).sum() / p.sum() > 0.95 and (y & p).sum() / y.sum() > 0.8


def test_pii_rows_and_redaction(spark, pii_models):
    rows = [(1, "a.b@x.org and 1.2.3.4", "en", "a", 1, "x"), (2, None, None, None, None, None), (3, "", "en", "a", 1, "x"), (1, "a.b@x.org and 1.2.3.4", "en", "a", 1, "x"), (None, "\U0001f600 +1 415 555 2671 end", "en", "a", 1, "x"), (5, "word " * 50_000 + "z@y.xx", "en", "a", 1, "x")]
    found = pii.find_pii(table(spark, rows).withColumn("spans", F.lit("old")), pii_models)
    got = pii.redacted(found).collect()
    assert [r["text"] for r in got[:5]] == ["[EMAIL] and [IP]", None, "", "[EMAIL] and [IP]", "\U0001f600 [PHONE] end"] and got[5]["text"].endswith("word [EMAIL]")
    assert [len(r["spans"]) for r in got] == [2, 0, 0, 2, 1, 1] and got[0]["extra"] == "x"
    empty = table(spark, [])
    assert pii.train_pii(empty) == {} and pii.find_pii(empty, {}).count() == 0


def test_pii_query_equals_brute_force(spark):
    got = QUERIES["op13_pii"](spark, SF).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    assert len(got) == len(docs)
    for r in docs.itertuples():
        base = plain_base(r.text or "")
        row = got.loc[r.doc_id]
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(b[1] == k for b in base) for k in range(4)]
        shown = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert row["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest() and set(shown) <= {*row["spans"].split(",")}


def test_boosting_and_thresholds():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    margin = Boosted().fit(x[:3000], y[:3000]).margins(x[3000:])
    assert ((margin > 0) == (y[3000:] > 0)).mean() > 0.97
    slope, offset = calibrated(margin, y[3000:])
    p = 1 / (1 + np.exp(-(slope * margin + offset)))
    assert abs(p.mean() - y[3000:].mean()) < 0.02
    assert precise_threshold(p, y[3000:], 0.9) >= 0.5 and precise_threshold(p[:5], np.ones(5), 0.97) == math.inf
