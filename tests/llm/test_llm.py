"""Training-data operators: SQL or brute force on small tables, and the odd cases each names in its docstring."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from jobloom.llm import chat, components, html, jaccard, knn, lm, mixing, packing, quality, tokens, toxicity
from jobloom.llm.common import CachedTokenizer, tokenizer_path
from jobloom.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import duck, shown

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def small(spark, rows):
    return spark.createDataFrame([(*r, None, "x") if len(r) == 4 else r for r in rows], DOCS)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(300)]


@pytest.fixture(scope="module")
def odd(spark, words):
    """Nulls everywhere, empty, blank and very long texts, copies, near copies and repeated rows."""
    rng = random.Random(4)
    body = [rng.choice(words) for _ in range(200)]
    near = list(body)
    near[100] = "changed"
    rows = [
        (1, " ".join(body), "en", "a"), (2, " ".join(body).upper(), "en", "b"), (3, " ".join(near), None, None), (4, None, "en", "a"), (5, "", None, "a"), (6, " \n\t ", "en", "b"),
        (7, "one two", "de", "c"), (8, "one  two", "de", "c"), (None, "one two three four five", "en", "a"), (9, " ".join(rng.choice(words) for _ in range(20_000)), "en", "a"), (1, " ".join(body), "en", "a"),
    ]
    return small(spark, rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert shown(QUERIES[name](spark, SF).toPandas()) == shown(duck(ORACLE_SQL[name], SF))


# 1


def test_restores_hidden_words(spark):
    rows = small(spark, [(i, "loser stupid pathetic idiot moron trash the of and here there", "en", "a") for i in range(5)])
    model = toxicity.train_char_model(rows)
    for hidden, word in (("l0ser", "loser"), ("s t u p i d", "stupid"), ("looooser", "loser"), ("m0r0n", "moron"), ("p4thetic", "pathetic"), ("$tupid", "stupid"), ("t.r.a.s.h", "trash")):
        assert word in toxicity.restored_words(f"here {hidden} there", model, {}), hidden
    assert toxicity.restored_words("", model, {}) == set() and "there" in toxicity.restored_words("Here, there!", model, {})
    # doubled letters, white space of any kind and number, no limit on a token's length
    for hidden, word in (("sttuuppiidd", "stupid"), ("i\td\n i  o t", "idiot"), ("t r a\u00a0s h", "trash"), ("x." * 40 + "l.0.s.e.r", "loser")):
        assert any(word in w for w in toxicity.restored_words(f"here {hidden} there", model, {})), hidden
    assert toxicity.suspicious("a" * 10 + "1" + "b" * 90)
    long = toxicity.restored_words("l0ser" * 20_000, model, {})
    assert any(w.startswith("loserloser") for w in long)


def brute_restore(observed, model):
    """Every path of the lattice, one by one."""
    stretched = len(toxicity._DOUBLES(observed)) >= toxicity.STRETCHED
    behind = len(observed.rstrip(toxicity.MARKS + " "))
    best = {}

    def walk(at, a, b, score, text):
        if at == len(observed):
            total = score + (model.log(a, b, "^") if b != "^" else 0.0)
            best[text.strip()] = max(total, best.get(text.strip(), -1e300))
            return
        c, cost = observed[at], toxicity.COST
        own = c in toxicity.LETTERS
        for x, price in [(c, 0.0)] if own else [(x, cost["leet"]) for x in toxicity.LEET.get(c, "")]:
            walk(at + 1, b, x, score - price + model.log(a, b, x), text + x)
        if at and c == observed[at - 1]:
            run = stretched or (at > 1 and observed[at - 2] == c) or observed[at + 1 : at + 2] == c
            walk(at + 1, a, b, score - cost["repeat" if run else "sign"], text)
        if c in toxicity.SEPARATORS:
            walk(at + 1, a, b, score - cost["drop"], text)
            walk(at + 1, "^", "^", score - cost["keep"] + (model.log(a, b, "^") if b != "^" else 0.0), text + " " if b != "^" else text)
        elif not own:
            edge = at == 0 or observed[at - 1] in toxicity.SEPARATORS or at + 1 >= behind
            price = cost["drop"] if edge and (c == "!" or c not in toxicity.LEET) else cost["sign"]
            walk(at + 1, *((a, b) if b == "^" or not edge else (b, "^")), score - price, text)

    walk(0, "^", "^", 0.0, "")
    return best


def test_viterbi_equals_every_path(spark):
    rows = small(spark, [(i, "loser stupid idiot trash the of and here lost rest tide", "en", "a") for i in range(3)])
    model = toxicity.train_char_model(rows)
    rng = random.Random(12)
    for hidden in ["l0ser", "s.t u", "1d1ot", "tr@sh!", "looose", "$.s"] + ["".join(rng.choice("ls0 1.t!") for _ in range(rng.randint(1, 6))) for _ in range(60)]:
        best = brute_restore(hidden, model)
        got = toxicity.restore(hidden, model)
        assert abs(best[got] - max(best.values())) < 1e-9, (hidden, got)


def test_character_counts_equal_a_plain_loop():
    texts = ["The cat, sat. Ünïß l0ser don't", "", "ça élève... (word) a", "x" * 50 + " æøåœ, ee\x85ff\u3000gg"]
    want = {}
    for t in texts:
        for w in t.lower().split():
            w = w.strip(toxicity.MARKS)
            if toxicity._PLAIN(w):
                padded = "^^" + w + "^"
                for i in range(len(padded) - 2):
                    want[padded[i : i + 3]] = want.get(padded[i : i + 3], 0) + 1
    total, signs = toxicity.trigram_counts(texts), "^" + toxicity.LETTERS
    b = len(signs)
    assert {signs[k // b**2] + signs[k // b % b] + signs[k % b]: int(total[k]) for k in np.flatnonzero(total).tolist()} == want


def test_halves_of_a_known_word_are_decoded(spark):
    rows = small(spark, [(i, "stupid the of and here there", "en", "a") for i in range(3)])
    model = toxicity.train_char_model(rows)
    scorer = toxicity.Scorer(model, np.zeros(0, np.uint64), np.zeros(0), -3.0, ["stupid"])
    assert "stupid" in toxicity.Words(["here stu pid, there"], model, {}, scorer.halves).texts()
    assert "stupid" not in toxicity.Words(["here stu, there pid"], model, {}, scorer.halves).texts()
    assert toxicity.Scorer(model, np.zeros(0, np.uint64), np.zeros(0), -3.0).features(["", "a", " \n"])[:, 3].tolist() == [0.0, float(np.log1p(1)), 0.0]


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(5)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(plain) for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            text[7] = rng.choice(["wicked", "w1cked", "wiiiicked", "vile"])
        rows.append((i, " ".join(text), "en", "a"))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None, "en", "a"), (1001, "", "en", "a"), (None, "wicked", None, None), (0, rows[0][1], "en", "a")]
    docs, marks = small(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.train_scorer(docs, marks)).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and (got.extra == "x").all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    held = got[got.doc_id.notna() & (got.doc_id < 600)]
    held = held[[zlib.crc32(str(int(i)).encode()) % 5 == 0 for i in held.doc_id]]
    assert ((held.doc_id % 4 == 0) == (held.predicted == 1)).mean() > 0.95
    none = toxicity.train_scorer(docs, marks.limit(0))
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0


# 2


def test_preferences(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "q"), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (None, 0, "user", "q"), (3, None, None, None)],
        "conv_id long, turn long, role string, text string",
    )
    convs = {r["conv_id"]: r["turns"] for r in chat.conversation_turns(turns).collect()}
    assert len(convs) == 3 and len(convs[2]) == 2 and convs[3][0]["text"] == ""
    kind = "p long, chosen array<struct<turn:bigint,role:string,text:string>>, rejected array<struct<turn:bigint,role:string,text:string>>, prompt string"
    pairs = spark.createDataFrame([(1, convs[1], convs[2], "old"), (2, convs[1], convs[1], None), (3, convs[1], None, None), (4, convs[1][:1], convs[1], None)], kind)
    got = {r["p"]: r for r in chat.format_preferences(pairs).collect()}
    assert got[1]["prompt"] == "<|user|>\nq<|end|>\n" and got[1]["n_prefix"] == 1
    start, stop = got[1]["chosen_loss"][0]
    assert got[1]["chosen_completion"][start:stop] == "a<|end|>\n"
    assert got[2]["chosen_completion"] == "" == got[2]["rejected_completion"] and got[3]["n_prefix"] == 0 and got[4]["chosen_completion"] == ""


# 3


def test_context_tree_is_a_distribution_and_equals_a_plain_recursion():
    rng = random.Random(6)
    docs = ["".join(rng.choice("ab ") for _ in range(60)).split() for _ in range(20)]
    docs = [b" ".join(w.encode() for w in d) for d in docs]
    grams, counts = lm.counted(lm.packed_grams(docs)[0])
    nodes, level = [], (grams, counts)
    for _ in range(lm.DEPTH + 1):
        nodes.insert(0, lm.nodes_of(*level, 1))
        level = lm.counted(lm.shortened(level[0]), level[1])
    tree = lm.ContextTree(nodes)
    context = int.from_bytes(b"\nab ba "[::-1], "big")
    every = (np.full(256, context, np.uint64) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    assert abs((10 ** tree.log10(every)).sum() - 1) < 1e-9

    table = {}
    for doc in docs:
        s = b"\n" * lm.DEPTH + doc + b"\n"
        for i in range(lm.DEPTH, len(s)):
            for d in range(lm.DEPTH + 1):
                node = 1
                for bit in range(8):
                    one = s[i] >> (7 - bit) & 1
                    table.setdefault((s[i - d : i], node), [0, 0])[one] += 1
                    node = node << 1 | one

    from functools import cache
    from math import lgamma, log

    def kt(a, b):
        return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(np.pi)

    @cache
    def weighted(ctx, node):
        own = kt(*table[ctx, node])
        if len(ctx) == lm.DEPTH:
            return own, 1.0
        split = sum(weighted(bytes([c]) + ctx, node)[0] for c in b"\nab " if (bytes([c]) + ctx, node) in table)
        both = np.logaddexp(own, split) - np.log(2)
        return both, np.exp(own - np.log(2) - both)

    def probability(ctx, node):
        p, left = 0.0, 1.0
        for d in range(lm.DEPTH + 1):
            key = (ctx[len(ctx) - d :], node)
            a, b = table[key]
            deeper = d < lm.DEPTH and (ctx[len(ctx) - d - 1 :], node) in table
            w = weighted(*key)[1]
            if not deeper:
                # an unseen longer context is the empty child "other contexts": one half
                return p + left * (w * (b + 0.5) / (a + b + 1) + (1 - w) * 0.5)
            p, left = p + left * w * (b + 0.5) / (a + b + 1), left * (1 - w)

    s = b"\n" * lm.DEPTH + docs[0] + b"\n"
    want = 0.0
    for i in range(lm.DEPTH, len(s)):
        node = 1
        for bit in range(8):
            one = s[i] >> (7 - bit) & 1
            p = probability(s[i - lm.DEPTH : i], node)
            want += np.log10(p if one else 1 - p)
            node = node << 1 | one
    assert abs(tree.log10(lm.packed_grams(docs[:1])[0]).sum() - want) < 1e-4 * abs(want)


def test_word_base_and_odd_rows(spark, odd):
    got = lm.score_documents(odd).toPandas()
    frame = odd.toPandas()
    assert len(got) == len(frame) and np.isfinite(got.score).all() and (got.score < 0).all()
    counts = {}
    for i, t in zip(frame.doc_id, frame.text):
        if i != i or zlib.crc32(str(int(i)).encode()) % 5 != 1:
            for w in [*lm.streams([t])[0].split(), b"\n"]:
                counts[w] = counts.get(w, 0) + 1
    total, v = sum(counts.values()), len(counts)
    assert (got.train_tokens == total).all()
    base = lambda t: sum(np.log10((counts.get(w, 0) + 0.5) / (total + 0.5 * (v + 1))) for w in [*lm.streams([t])[0].split(), b"\n"])
    texts = {int(i): t for i, t in zip(frame.doc_id, frame.text) if i == i}
    for r in got[got.doc_id.notna()].itertuples():
        assert abs(r.base_score - base(texts[int(r.doc_id)])) < 1e-6
    assert lm.score_documents(odd.limit(0)).count() == 0


# 4


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 8))
    x[100:200] = x[100]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(900, None), (901, [None] + [0.0] * 7), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (None, [0.0] * 8), (5, [float(c) for c in x[5]])]
    vectors = knn.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = knn.top_k(vectors, vectors.filter("vec_id % 10 = 0"), 5, cell=20, group=4, block=64, part=4).toPandas().sort_values(["query_id", "rank"])
    q = np.floor(256 * x).astype(np.int64)
    for i in range(0, 300, 10):
        s = q @ q[i]
        best = sorted((-int(s[j]), j) for j in range(300) if j != i)[:5]
        own = got[got.query_id == i]
        assert [(-a, b) for a, b in best] == list(zip(own.score, own.vec_id)) and list(own["rank"]) == [1, 2, 3, 4, 5]
    few = vectors.filter("vec_id IN (0, 1, 2)")
    assert knn.top_k(few, few, 5).count() == 6 and knn.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_groups_that_cannot_matter_get_no_rows(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16)) * 4
    centres = 8 * centres / np.linalg.norm(centres, axis=1)[:, None]
    x = np.concatenate([c + rng.normal(size=(100, 16)) * 0.02 for c in centres])
    vectors = knn.quantised(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    sent: list[int] = []
    got = knn.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5, cell=20, group=1, block=64, sent_to=sent).toPandas()
    q = np.floor(256 * x).astype(np.int64)
    for i in range(0, 2000, 50):
        s = q @ q[i]
        best = sorted((-int(s[j]), j) for j in range(2000) if j != i)[:5]
        assert [(-a, b) for a, b in best] == list(got[got.query_id == i].sort_values("rank")[["score", "vec_id"]].itertuples(index=False, name=None))
    groups = 40
    assert sent[0] < 0.25 * groups * 2000
    assert groups <= sent[1] < 0.4 * groups * -(-2000 // 64)  # queries meet the blocks of the rows sent to their group, not all blocks


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [1e8, -1e8]), (50, [3e16, 0.0]), (1, [1e8]), (2, []), (3, [1e300, -1e300]), (4, [0.5, 0.5, 0.5]), (5, [0.5, 0.5, 0.5]), (50, [1.0, 1.0])]
    vectors = knn.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = knn.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 3).toPandas()
    own = got[got.query_id == 0].sort_values("rank")
    assert own.vec_id.tolist() == [1, 3, 50] and own.score.tolist() == [2**63 - 1] * 3
    assert set(got[got.query_id == 50].vec_id) <= {0, 1, 3, 4, 5} and (got["rank"] <= 3).all()
    tie = knn.top_k(vectors.filter("vec_id IN (2, 4, 5)"), vectors.filter("vec_id = 2"), 3).toPandas().sort_values("rank")
    assert tie.vec_id.tolist() == [4, 5] and tie.score.tolist() == [0, 0]


# 5


def test_main_text(spark):
    menu = "<div>home about contact us now or never again today</div>"
    rows = [
        (1, "http://h.x/1", f"<body>{menu}<div>alpha beta gamma</div></body>", "u"), (2, "http://h.x/2", f"{menu}<p>other &amp; more</p><div class='comments'>first!</div>", "u"), (3, None, None, None),
        (4, "http://g.x/", menu, "u"), (5, "http://g.x/5", "<header>x</header><main><h1>T</h1><script>'<p>no</p>'</script><p>a<b>b</b>\n c<br>d<aside>s</aside></main>tail", "u"), (6, "http://h.x/6", "", "u"),
        (None, "http://h.x/7", menu, "u"), (1, "http://h.x/1", f"<body>{menu}<div>alpha beta gamma</div></body>", "u"), (8, "http://h.x/8", "<article>" + "w " * 50_000 + "<p>open", "u"),
    ]
    got = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).toPandas()
    text = {(-1 if r.page_id != r.page_id or r.page_id is None else int(r.page_id)): r.text for r in got.itertuples()}
    assert len(got) == len(rows) and text[1] == "alpha beta gamma" and text[2] == "other & more" and text[3] == "" == text[6] and text[4].startswith("home") and text[5] == "T ab c d"
    assert text[-1].startswith("home") and len(text[8]) == 2 * 50_000 + 4 and (got.n_chars == got.text.map(len)).all()
    assert html.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeats_of_a_host_equal_brute_force(spark):
    rng = random.Random(13)
    menu, note = [f"m{i}" for i in range(20)], [f"n{i}" for i in range(9)]
    pages = []
    for c in range(12):
        body = [rng.choice("abcdef") + str(rng.randint(0, 400)) for _ in range(rng.randint(3, 60))]
        pages.append(("h" if c < 9 else "g", c, (menu if c % 2 else note) + body + (menu[:12] if c == 3 else [])))
    pages.append(("h", 20, pages[1][2]))
    got = {(r["host"], r["content"], r["at"]): (r["length"], r["pages"]) for r in html.host_repeats(spark.createDataFrame(pages, "host string, content long, tokens array<string>"), 8).collect()}
    want = {}
    for host, c, t in pages:
        for i in range(len(t) - 7):
            others = [o for h, o, u in pages if h == host and any(u[j : j + 8] == t[i : i + 8] for j in range(len(u) - 7))]
            if len(others) > 1:
                n = 8
                while i + 2 * n <= len(t) and any(o != c and h == host and any(u[j : j + 2 * n] == t[i : i + 2 * n] for j in range(len(u) - 2 * n + 1)) for h, o, u in pages):
                    n *= 2
                want[host, c, i] = (n, len(others))
    assert got == want and max(v[0] for v in got.values()) >= 32


def test_copies_and_mirrors_keep_their_articles(spark):
    body = " ".join(f"w{i}" for i in range(60))
    menu = "<div>" + " ".join(f"m{i}" for i in range(10)) + "</div>"
    rows = [(1, "http://a.x/1", f"{menu}<p>{body}</p>"), (2, "http://a.x/1?print", f"{menu}<p>{body}</p>")]
    rows += [(3 + i, f"http://b.x/{i}", f"{menu}<p>{' '.join(f'{i}v{j}' for j in range(30))}</p>") for i in range(6)] + [(20, "http://b.x/20", f"{menu}<p>0v0 0v1 0v2 0v3 0v4 0v5 0v6 0v7 0v8 0v9 own</p>")]
    rows += [(30, "http://c.x/1", f"<div>intro of the page</div><article><header><h1>T</h1></header><p class='related'>kept</p><div class='related'>gone</div></article><p>{body}</p>"), (31, "http://c.x/2", f"<p>{body}</p>")]
    got = {r["page_id"]: r["text"] for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert body in got[1] and body in got[2]
    assert got[3] == " ".join(f"0v{j}" for j in range(30)) and got[20].startswith("0v0") and got[20].endswith("own")
    assert got[30] == "T kept" and got[31] == ""


def test_pages_without_their_article_marks_give_the_same_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", "</?article[^>]*>", ""))
    a = {r["page_id"]: r["text"] for r in html.extract_main_text(pages).collect()}
    b = {r["page_id"]: r["text"] for r in html.extract_main_text(bare).collect()}
    assert sum(a[k] == b[k] for k in a) >= 0.9 * len(a)


def _plain_repeats(streams, least):
    """Runs of 8 tokens or more that `least` of the streams (tokens, and whether each stands in running text set aside) have, and whether they begin in such text somewhere."""
    grams = {}
    for c, (tokens, aside) in enumerate(streams):
        for i in range(len(tokens)):
            for n in range(8, len(tokens) - i + 1):
                have = grams.setdefault(tuple(tokens[i : i + n]), [set(), False])
                have[0].add(c)
                have[1] |= aside[i]
    return {run: aside for run, (have, aside) in grams.items() if len(have) >= least}


def test_main_text_of_all_pages_by_their_hosts_runs_equals_brute_force(spark):
    rng = random.Random(8)
    words = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    note, line = words("n", 12), words("l", 9)
    rows = []
    for i in range(14):
        body = "".join(f"<p>{' '.join(rng.choice('xyz') + str(rng.randint(0, 200)) for _ in range(rng.randint(4, 15)))}</p>" for _ in range(3))
        menu = "<ul>" + "".join(f"<li>m{k}</li>" for k in range(10 + i % 3)) + "</ul>"
        quoted = f"<div>{line} and more of page {i}</div>" if i % 2 else f"<div>{line}</div>"
        if i % 4 == 0:
            rows.append((i, f"http://h/{i}", f"{menu}<article>{body}<p>{note}</p><div>{line}</div></article><p>{words('c', 9)}</p>"))
        else:
            # all runs of 8 of the 30 words are shared by many pages, the 30 words by none
            parts = " ".join(f"e{k}" for k in (range(30) if i == 3 else range(20) if i % 2 else range(10, 30)))
            rows.append((i, f"http://h/{i}", f"<div>{words('d', 40 if i % 3 else 37)}</div><div>{menu}</div>{body}<p>{note}</p><div>{parts} {'' if i == 3 else i}</div>{quoted}<p>{words('c', 9)}</p>"))
    once = f"<div>{words('u', 20)}</div><p>own text</p>"
    rows += [(100 + i, f"http://h/{100 + i}", once) for i in range(9)] + [(200, "no url", rows[1][2]), (201, None, rows[1][2]), (None, "http://h/1", rows[1][2]), (202, "http://h/e", None)]
    got = {r["url"]: (r["text"], r["n_repeated"]) for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    pages = {url: html.page_blocks(h or "") for _, url, h in rows}
    contents = {}
    for page, url, _ in rows:
        texts, kinds = pages[url]
        if page is not None and page not in (200, 201) and texts:
            contents.setdefault(" ".join(texts), [k == "P" for t, k in zip(texts, kinds, strict=True) for _ in t.split()])
    runs = _plain_repeats([(c.split(), a) for c, a in contents.items()], max(2, 0.3 * len(contents)))
    for _, url, _ in rows[:-4]:
        (texts, kinds), kept, at = pages[url], [], 0
        if url == "http://h/1":
            continue  # the row without an id has the same url
        stream = " ".join(texts).split()
        for t, k in zip(texts, kinds, strict=True):
            end = at + len(t.split())
            over = [stream[at:end]] if end - at >= 8 else [stream[b : b + 8] for b in range(max(0, end - 8), min(at, len(stream) - 8) + 1)]
            gone = any(runs[tuple(r)] or k != "p" for r in over if tuple(r) in runs)
            if k == "a" or k in "po" and not gone:
                kept.append(t)
            at = end
        assert got[url] == (" ".join(kept), len({b + i for b in range(len(stream) - 7) if tuple(stream[b : b + 8]) in runs for i in range(8)}))
    # in a marked article repeats stay but are counted; elsewhere whole repeated blocks go, and what copies alone share stays
    assert note in got["http://h/0"][0] and got["http://h/0"][0].endswith(line) and "m0" not in got["http://h/0"][0] and got["http://h/0"][1] >= 12 + 9 + 10
    assert got["http://h/3"][0].endswith(f"{note} {words('e', 30)} {line} and more of page 3") and got["http://h/2"][0].endswith("e29 2") and note in got["http://h/2"][0]
    assert not any("d0" in got[f"http://h/{i}"][0] or "m0" in got[f"http://h/{i}"][0] for i in range(14) if i != 1)
    assert got["http://h/104"] == (f"{words('u', 20)} own text", 0) and got["no url"][1] == got[None][1] == 0 and got["http://h/e"] == ("", 0)


def test_no_page_loses_text_to_repeats_without_its_article_marks(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", "</?article[^>]*>", ""))
    want = {r["page_id"]: " ".join(t for t, k in zip(*html.page_blocks(r["html"] or ""), strict=True) if k == "a") for r in pages.collect()}
    got = {r["page_id"]: r for r in html.extract_main_text(bare).collect()}
    assert {k: r["text"] for k, r in got.items()} == want and sum(r["n_repeated"] > 0 for r in got.values()) > 10


# 6


def test_quality_measures_and_guarantee(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    got = quality.apply_quality_rules(odd, labels).toPandas()
    assert len(got) == 11 and got[got.doc_id == 4].n_words.iloc[0] == 0 and got[got.doc_id == 9].n_words.iloc[0] == 20_000 and not got[got.doc_id == 7].kept.iloc[0]
    sql = duck(ORACLE_SQL["op6_quality_rules"], documents=odd.toPandas(), labels=labels.toPandas().astype("Int64"))
    assert shown(got[list(sql.columns)].astype({"doc_id": "Int64"})) == shown(sql.astype({"doc_id": "Int64"}))
    clean = spark.createDataFrame([("en", 0)] * 990 + [("en", 3)] * 2 + [("de", 5)] * 5, "stratum string, passes int")
    assert [tuple(r) for r in quality.certified_levels(clean).collect()] == [("en", 0)]
    from math import comb

    for n, k in ((600, 0), (900, 2), (1000, 4)):
        want = sum(comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1))
        have = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), 0.01)).first()[0]
        assert abs(want - have) < 1e-9
    assert quality.apply_quality_rules(odd.limit(0), labels.limit(0)).count() == 0


# 7 and 10


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_tokenizer_equals_the_library(name):
    k = CachedTokenizer(tokenizer_path(name), keep=50)
    texts = ["a  b", " x", "x ", "a\n b", "", "  ", "foo's bar.\nBar <|endoftext|> z", "x  y\n  y", "Straße É été İ ﬁ", "a b  c", "1,5 don't re-do!", "\n\nq\n", None, "z" * 3000, "tab\tq\rw\x1cx", "\0a"]
    texts += [" ".join(f"w{i}x{j}." for j in range(40)) for i in range(20)]
    got = k.encode(texts)
    k.lib.encode_special_tokens = True
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == k.lib.encode(t or "", add_special_tokens=False).ids, t


def test_token_files_round_trip(spark, odd, tmp_path):
    path = tokens.write_token_ids(odd, f"file://{tmp_path}/ids", "byte_bpe_50k.json", 2, part_bytes=20_000)
    lib = CachedTokenizer(tokenizer_path("byte_bpe_50k.json")).lib
    back = tokens.read_token_ids(spark, path).toPandas().sort_values("start")
    assert len(back) == 11 and back.start.tolist() == (back.n_tokens.cumsum() - back.n_tokens).tolist()
    known = back[back.doc_id.notna()]
    assert known.doc_id.is_monotonic_increasing
    texts = {int(i): t for i, t in odd.select("doc_id", "text").collect() if i is not None}
    for r in known.itertuples():
        assert list(r.ids) == lib.encode(texts[int(r.doc_id)] or "", add_special_tokens=False).ids + [2]
    places = tokens.token_places(spark, path)
    assert "ids" not in places.columns and places.count() == 11
    assert "ids:array" not in str(places._jdf.queryExecution().executedPlan())
    digest = tokens.token_digests(spark, path).toPandas().sort_values("start")
    assert digest.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in back.ids]
    empty = tokens.write_token_ids(odd.limit(0), f"file://{tmp_path}/none", "byte_bpe_50k.json", 2)
    assert tokens.read_token_ids(spark, empty).count() == 0


def test_packing_is_exact(spark, odd):
    got = packing.pack_documents(odd, "word_bpe_49k.json", 2, window=256, segment=2000, part_bytes=30_000).toPandas()
    lib = CachedTokenizer(tokenizer_path("word_bpe_49k.json")).lib
    texts = {int(i): t for i, t in odd.select("doc_id", "text").collect() if i is not None}
    for d, own in got[got.doc_id.notna()].groupby("doc_id"):
        ids = np.array(lib.encode(texts[int(d)] or "", add_special_tokens=False).ids + [2], "<u4")
        copies = 2 if d == 1 else 1
        assert own.length.sum() == copies * len(ids) and (own.doc_tokens == len(ids)).all()
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    got = got.sort_values(["sequence_id", "offset"])
    sums = got.groupby("sequence_id").length
    assert (got.offset == sums.cumsum() - got.length).all() and sums.sum().max() <= 256
    assert packing.pack_documents(odd.limit(0), "word_bpe_49k.json", 2).count() == 0


def test_dynamic_programming_is_optimal():
    rng = random.Random(8)
    for _ in range(200):
        cuts, penalties = [0], [0.0]
        for _ in range(rng.randint(1, 9)):
            cuts.append(cuts[-1] + rng.randint(1, 16))
            penalties.append(rng.choice([0.0, 3.0]))
        pad = lambda n: 0 if n & (n - 1) == 0 else 16 - n

        def cost(chosen, cuts=cuts, penalties=penalties, pad=pad):
            ends = [0, *chosen]
            return sum(pad(b - a) for a, b in zip(ends, chosen)) + sum(penalties[cuts.index(c)] for c in chosen)

        best = float("inf")
        n = len(cuts)
        for mask in range(1 << n - 2) if n > 1 else []:
            chosen = [cuts[k] for k in range(1, n - 1) if mask >> (k - 1) & 1] + [cuts[-1]]
            if all(b - a <= 16 for a, b in zip([0, *chosen], chosen)):
                best = min(best, cost(chosen))
        assert abs(cost(packing.choose_cuts(cuts, penalties, 16)) - best) < 1e-9


# 8


def test_mixing_odd_rows(spark, odd):
    got = mixing.mix_counts(odd).toPandas()
    assert len(got) == 11 and (got.taken <= 3 * got["size"]).all() and (got[got["size"] == 0].taken == 0).all()
    again = mixing.mix_counts(odd).toPandas()
    assert shown(got) == shown(again)
    for _, own in got.groupby(got.source.fillna("none")):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= max(own["size"].max(), 1)
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() == int(got.copies.sum()) and mixing.mix_counts(odd.limit(0)).count() == 0


# 9


def brute_components(frame: pd.DataFrame, n: int, num: int, den: int) -> dict:
    sets = {}
    for i, t in zip(frame.doc_id, frame.text):
        w = (t or "").encode().translate(jaccard._LOWER).split()
        own = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
        if i == i and i is not None:
            sets.setdefault(int(i), []).append(own)
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if a < b and label[a] != label[b] and any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
                    low, high = sorted((label[a], label[b]))
                    label = {k: low if v == high else v for k, v in label.items()}
                    changed = True
    return label


def test_jaccard_components_equal_brute_force(spark, odd, words):
    rng = random.Random(9)
    rows = [tuple(r) for r in odd.filter("doc_id IS NULL OR doc_id < 9").collect()]
    for g in range(12):
        body = [rng.choice(words) for _ in range(rng.choice([3, 5, 6, 9, 15, 40, 120]))]
        for k in range(rng.randint(1, 6)):
            t = list(body)
            for _ in range(rng.randint(0, max(1, len(t) // 30))):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((100 + 10 * g + k, " ".join(t), "en", "a", None, "x"))
    frame = spark.createDataFrame(rows, DOCS)
    for n, num in ((4, 85), (5, 80)):
        got = jaccard.jaccard_components(frame, n=n, num=num, block=3).toPandas()
        want = brute_components(frame.toPandas(), n, num, 100)
        assert len(got) == len(rows)
        assert {int(r.doc_id): int(r.component_id) for r in got.itertuples() if r.doc_id == r.doc_id} == want
        fine = jaccard.jaccard_components(frame, n=n, num=num, block=2, group_bytes=64, exact=True).toPandas()
        assert {int(r.doc_id): int(r.component_id) for r in fine.itertuples() if r.doc_id == r.doc_id} == want
    assert jaccard.jaccard_components(frame.limit(0)).count() == 0


def test_chains_beyond_the_leader_and_common_entries(spark, monkeypatch):
    """Links that the leader of a cluster doesn't have: chains of texts, each like the next alone; and entries that most sets hold."""
    words = [f"w{i}" for i in range(1000)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 80]), "en", "a", None, "x") for i in range(60)]
    rows += [(100 + i, " ".join([*words[900:960], f"v{i}"]), "en", "a", None, "x") for i in range(80)]
    rows += [(5, " ".join([*words[900:960], "v5"]), "en", "a", None, "x"), (100, " ".join([*words[900:960], "v0"]), "en", "a", None, "x")]  # ids with another text, and a repeated row
    rows += [(300, "tail \x1c one\x1ctwo three four five", "en", "a", None, "x"), (301, "tail one two three four five", "en", "a", None, "x")]
    frame = spark.createDataFrame(rows, DOCS)
    want = brute_components(frame.toPandas(), 4, 85, 100)
    assert {want[i] for i in range(60)} == {want[100 + i] for i in range(80)} == {0} and want[301] == 301
    hot = jaccard._shared_entries
    for most_hot in (10_000, 1 << 40):
        monkeypatch.setattr(jaccard, "_shared_entries", lambda met, total, most_hot=most_hot: hot(met, total, most_hot))
        got = jaccard.jaccard_components(frame, block=8, group_bytes=2000).toPandas()
        assert {int(r.doc_id): int(r.component_id) for r in got.itertuples()} == want


def test_the_filter_misses_no_pair_near_the_threshold():
    """Recall of the fragments' entries among pairs at and just above the threshold, by size."""
    rng = np.random.default_rng(14)
    scheme = jaccard.Fragments(85, 100)
    for n in (7, 20, 40, 90, 150, 400, 1500):
        for _ in range(40):
            differ = 15 * n // 185  # the most that a linked pair of equal sizes can differ by
            base = rng.integers(0, 1 << 64, 3 * n, dtype=np.uint64)  # as hashes are: over all 64 bits
            x, y = np.sort(base[:n]), np.sort(np.concatenate([base[differ:n], base[n : n + differ]]))
            assert 100 * (n - differ) >= 85 * (n + differ)
            c = scheme.size_class(n)
            both = np.intersect1d(scheme.entries(x, c), scheme.entries(y, c))
            assert len(both) >= scheme.scheme(c)[2] + 1 or differ == 0 and scheme.scheme(c)[0] == 0


def test_components_of_long_paths(spark):
    rng = random.Random(10)
    ids = list(range(400))
    rng.shuffle(ids)
    edges = [(a, b) for a, b in zip(ids[:200], ids[1:200])] + [(5, 5), (None, 3)] + [(a, b) for a, b in zip(ids[200:], ids[201:])]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == min(ids[:200]) for i in ids[:200]) and all(got[i] == min(ids[200:]) for i in ids[200:])


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stage(spark, docs, SF).toPandas()
        assert len(kept) > 0
        if k == len(corpus_pipeline.STAGES) - 1:
            per_doc = kept.groupby("doc_id").length.sum()
            tokens_once = kept.groupby("doc_id").doc_tokens.first()
            copies = docs.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
            assert (per_doc == tokens_once * copies.reindex(per_doc.index)).all() and set(per_doc.index) == set(copies.index)
            break
        assert list(kept.columns) == columns
        if name != "mixing":
            assert len(kept) <= before and set(kept.doc_id) <= {r[0] for r in docs.select("doc_id").collect()}
        before = len(kept)
        docs = spark.createDataFrame(kept, docs.schema)


def test_usual_entries_are_shuffled_once(spark):
    """Repeated rows of an entry go where its rows are, without an exchange of their own; the result is distinct, common entries too."""
    from jobloom.llm.jaccard import _shared_entries

    rows = [(n, 1) for n in range(3000)] + [(n, 100 + n // 2) for n in range(40)] * 2 + [(7, 999)] * 2
    met = spark.createDataFrame(rows, "node long, entry long")
    shared = _shared_entries(met, len(rows))
    plan = shared._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Union")]  # nothing moves what both sides give
    got = shared.collect()
    assert len(got) == 3040 and {(r["node"], r["entry"]) for r in got} == set(rows) - {(7, 999)}


def test_entries_are_kept_until_the_shared_ones_are_known(spark, monkeypatch):
    """No table that stays holds the sets' entries, and nothing is cached when candidates are paired or afterwards."""
    cached = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before, kept, pairing = cached(), [], []
    settled, edges = jaccard.settled, jaccard._candidate_edges
    monkeypatch.setattr(jaccard, "settled", lambda df: kept.append(df.schema) or settled(df))
    monkeypatch.setattr(jaccard, "_candidate_edges", lambda shared: pairing.append(cached()) or edges(shared))
    got = jaccard.jaccard_components(small(spark, [(i, " ".join(f"w{k}" for k in range(i % 3, 60)), "en", "a") for i in range(9)])).collect()
    assert {r["component_id"] for r in got} == {0}
    assert not [f.name for schema in kept[:5] for f in schema if f.dataType.typeName() == "array"]
    assert pairing == [before] and cached() == before
