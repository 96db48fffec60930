"""Main text of web pages.

Every page becomes the stream of its block texts' tokens. A host's streams, one a distinct content, are compared by their
suffixes: beginnings of run_tokens tokens are ranked by hash, ranks double in length (the rank of 2n tokens is the pair of
the ranks of n) as long as a good share of the host's contents have them. A block that they have whole is boilerplate: it
is ranked by the longest doubled runs at its start and its end; a shorter block goes with a run around it. Only then
markup is asked: what stands in a marked article
(article, main, role main) stays, repeated or not; menus, forms, notices and the like, and what stands outside of a marked
article, go; and running text without a mark goes only if some page's markup sets that run aside as running text.

Suffixes are many, so only those are laid out that can count: two equal runs have equal halves, and so the same least
hash of a half (their anchor). Anchors that too few of the host's contents have are found first, and lose no run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SpanHasher, written

#: Elements without end tags, elements whose content is no text, inline elements, boilerplate elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas select".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
BOILER = frozenset("nav header footer aside form button dialog menu fieldset".split())
MAIN = frozenset(("article", "main"))
_BOILER_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|alerts?|sidebars?|menus?|nav\w*|breadcrumbs?|footers?|headers?|masthead"
    r"|comments?|replies|disqus|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|popups?|modal|overlay|toolbar|widgets?|pagination|skip)(?:$|[\s_-])",
    re.I,
)
_BOILER_ROLE = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-label)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


#: Elements of running text, which inside a marked article stay whatever their class says.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt pre blockquote figcaption header".split())
#: Elements of running text, which on pages without a marked article go only if markup sets them aside elsewhere.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 dd pre blockquote figcaption".split())


def page_blocks(html: str) -> tuple[list[str], str]:
    """Texts of all blocks in page order, and a letter for each: `a` in a marked article, else `p` running text or `o` other;
    `P` and `O` if markup sets them aside: boilerplate elements, and all outside of the article of a page that marks one.

    An end tag closes what is open above its start; end tags without a start and unclosed elements do no harm.
    Character references are decoded after the markup is gone; white space becomes single blanks. An article's own header and
    running text stay; a page's header and what is named a menu, notice and so on go.
    """
    from html import unescape

    texts, kinds, piece = [], [], []
    stack: list[tuple[str, bool, bool]] = [("", False, False)]  # name, in boilerplate, in an article
    marked, at = False, 0

    def flush() -> None:
        if piece:
            text = " ".join(unescape("".join(piece)).split())
            piece.clear()
            if text:
                _, boiler, inside = stack[-1]
                own = next((n for n, _, _ in reversed(stack) if n not in INLINE), "")
                texts.append(text)
                kind = "p" if own in PROSE else "o"
                kinds.append(kind.upper() if boiler else "a" if inside else kind)

    while True:
        m = _TAG.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            piece.append(text)
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name not in INLINE:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    flush()
                    del stack[k:]
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        if name == "p" and stack[-1][0] == "p":
            stack.pop()
        _, boiler, inside = stack[-1]
        if not boiler:
            names = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(m[3])} if m[3] else {}
            role = names.get("role", "").lower()
            own = inside and name in RUNNING
            named = name not in INLINE and not own and _BOILER_NAME.search(f"{names.get('class', '')} {names.get('id', '')}") is not None
            boiler = name in BOILER and not own or role in _BOILER_ROLE or "hidden" in names or named
            if not boiler and (name in MAIN or role == "main"):
                inside = marked = True
        if boiler != stack[-1][1] or inside != stack[-1][2]:
            flush()
        stack.append((name, boiler, inside))
    flush()
    return texts, "".join(k if k == "a" else k.upper() for k in kinds) if marked else "".join(kinds)


class _Runs:
    """Tokens of some pages, given as lists of block texts, and the run of run_tokens tokens that begins at each place.

    content: a page's hash (0 without tokens); first: its first token's place, with one place more at the end; at: places
    where a run begins, the page's own runs lying between runs[k] and runs[k + 1]; rank: the run's hash; anchor: the least
    hash of the half runs in it.
    """

    def __init__(self, pages: list[list[str]], run_tokens: int):
        import numpy as np

        data = np.frombuffer("".join(" ".join(texts) + "\n" for texts in pages).encode(), np.uint8)
        cut = np.flatnonzero((data == 32) | (data == 10))
        begin, page = np.concatenate([[0], cut[:-1] + 1]), np.concatenate([[0], np.cumsum(data[cut[:-1]] == 10)])
        word = cut > begin
        begin, end, page = begin[word], cut[word], page[word]
        hashes = SpanHasher(data)
        self.first = np.searchsorted(page, np.arange(len(pages) + 1))
        lo, hi = self.first[:-1], self.first[1:]
        self.content = np.zeros(len(pages), np.uint64)
        self.content[hi > lo] = hashes(begin[lo[hi > lo]], end[hi[hi > lo] - 1])
        self.at = np.arange(max(0, len(begin) - run_tokens + 1))
        self.at = self.at[page[self.at] == page[self.at + run_tokens - 1]]
        self.runs = np.searchsorted(self.at, self.first)
        self.rank = self.anchor = np.zeros(0, np.uint64)
        if len(self.at):
            half = max(1, run_tokens // 2)
            self.rank = hashes(begin[self.at], end[self.at + run_tokens - 1])
            halves = hashes(begin[: len(begin) - half + 1], end[half - 1 :])
            self.anchor = np.lib.stride_tricks.sliding_window_view(halves, run_tokens - half + 1).min(axis=1)[self.at]


def _some_pages(batches: Iterator, run_tokens: int, size: int = 512) -> Iterator:
    """Slices of the batches with their pages' texts, kinds and runs; html is the last column."""
    for batch in batches:
        for lo in range(0, batch.num_rows, size):
            some = batch.slice(lo, size)
            parsed = [page_blocks(html or "") for html in some.column(some.num_columns - 1).to_pylist()]
            yield some, [p[0] for p in parsed], [p[1] for p in parsed], _Runs([p[0] for p in parsed], run_tokens)


def _lists(values, sizes):
    """Arrow lists of the given sizes from all their values, one behind another."""
    import numpy as np
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)), values)


def _contents(pages: DataFrame, run_tokens: int) -> DataFrame:
    """`host, content` of each page with a token, from `host, html`."""

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for some, _, _, runs in _some_pages(batches, run_tokens):
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(runs.content.view("int64"))], ["host", "content"])

    return pages.select("host", "html").mapInArrow(each, "host long, content long").filter("content <> 0")


def _anchors(pages: DataFrame, run_tokens: int) -> DataFrame:
    """`host, content, anchors` of each page, each anchor once, from `host, html`."""

    def each(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for some, _, _, runs in _some_pages(batches, run_tokens):
            own = [np.unique(runs.anchor[lo:hi]) for lo, hi in zip(runs.runs[:-1], runs.runs[1:], strict=True)]
            anchors = _lists(pa.array(np.concatenate(own).view("int64")), [len(a) for a in own])
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(runs.content.view("int64")), anchors], ["host", "content", "anchors"])

    return pages.select("host", "html").mapInArrow(each, "host long, content long, anchors array<long>")


def common_anchors(pages: DataFrame, run_tokens: int, share: float) -> DataFrame:
    """`host, least, anchors` from `host, html`: the anchors that at least `least` of the host's distinct contents have.

    least is two, and the share of the host's contents. A content with m copies counts 1/m for each of them, so that no
    text meets its copies; a host keeps no more anchors than 1/share times those of its mean content, however many pages it has.
    """
    copies = written(_contents(pages, run_tokens).groupBy("host", "content").agg(F.count(F.lit(1)).alias("m")))
    least = F.greatest(F.lit(2.0), F.count(F.lit(1)) * share)
    hosts = written(copies.groupBy("host").agg(F.count(F.lit(1)).alias("_n"), least.alias("least")).filter("_n > 1").drop("_n"))
    several = written(copies.filter("m > 1"))
    own = _anchors(pages.join(hosts, "host", "left_semi"), run_tokens).join(several, ["host", "content"], "left")
    each = own.select("host", F.coalesce(1 / F.col("m"), F.lit(1.0)).alias("part"), F.explode("anchors").alias("anchor"))
    counted = each.groupBy("host", "anchor").agg(F.sum("part").alias("n")).filter("n > 1.5").join(hosts, "host").filter(F.round("n") >= F.col("least"))
    return written(counted.groupBy("host", "least").agg(F.collect_list("anchor").alias("anchors")))


def _candidates(pages: DataFrame, common: DataFrame, run_tokens: int) -> DataFrame:
    """`host, least, content, at, rank, block, aside` from `host, html`: suffixes of distinct contents whose run has a common anchor.

    rank is that of the first run_tokens tokens; block: the length of the block that begins there, or 0; aside: the suffix begins in running text that markup sets aside.
    """

    def each(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for some, texts, kinds, runs in _some_pages(batches, run_tokens):
            words = np.array([t.count(" ") + 1 for page in texts for t in page], np.int64)
            aside = np.repeat(np.frombuffer("".join(kinds).encode() + b" ", np.uint8)[:-1] == ord("P"), words)
            block = np.zeros(len(aside), np.int32)
            block[np.cumsum(words) - words] = words
            found = []
            for k in range(some.num_rows):
                lo, hi = runs.runs[k : k + 2]
                found.append(lo + np.flatnonzero(np.isin(runs.anchor[lo:hi].view("int64"), some.column(2)[k].values.to_numpy())))
            sizes, found = [len(f) for f in found], np.concatenate(found).astype(np.int64)
            at = runs.at[found]
            own = at - np.repeat(runs.first[:-1], sizes)
            lists = [_lists(pa.array(v), sizes) for v in (own.astype(np.int32), runs.rank[found].view("int64"), block[at], aside[at])]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(runs.content.view("int64")), *lists], ["host", "least", "content", "at", "rank", "block", "aside"])

    rows = pages.join(common, "host").select("host", "least", "anchors", "html")
    lists = rows.mapInArrow(each, "host long, least double, content long, at array<int>, rank array<long>, block array<int>, aside array<boolean>")
    # equal tokens may be cut into other blocks on another page, and set aside there: all cuts are kept
    lists = lists.filter(F.size("at") > 0).groupBy("host", "content", "block", "aside").agg(F.first("least").alias("least"), F.first("at").alias("at"), F.first("rank").alias("rank"))
    flat = lists.select("host", "least", "content", F.explode(F.arrays_zip("at", "rank", "block", "aside")).alias("s"))
    return flat.select("host", "least", "content", "s.at", "s.rank", "s.block", "s.aside").distinct()


def _suffixes(streams: DataFrame, run_tokens: int) -> DataFrame:
    """`host, least, content, at, rank, block, aside`: each suffix of at least run_tokens tokens of each distinct content, ranked by its first run_tokens tokens."""
    ranks = F.transform(F.sequence(F.lit(0), F.size("tokens") - run_tokens), lambda i: F.xxhash64(F.slice("tokens", i + 1, run_tokens)))
    return streams.filter(F.size("tokens") >= run_tokens).select("host", F.lit(2.0).alias("least"), "content", F.posexplode(ranks).alias("at", "rank"), F.lit(0).alias("block"), F.lit(False).alias("aside"))


def _with_partners(suffixes: DataFrame) -> DataFrame:
    """Suffixes whose rank at least `least` contents of their host have, with `pages`, how many, and `set_aside`, if any of these is set aside.

    A rank's contents are counted in two steps, so that a run of all pages of a host meets in no task.
    """
    each = suffixes.groupBy("host", "least", "rank", "content").agg(F.max("aside").alias("aside"))
    shared = each.groupBy("host", "least", "rank").agg(F.count(F.lit(1)).alias("pages"), F.max("aside").alias("set_aside")).filter("pages >= least").drop("least")
    return suffixes.join(shared, ["host", "rank"])


def _doubled(suffixes: DataFrame, run_tokens: int) -> Iterator[tuple[int, DataFrame]]:
    """Lengths run_tokens, twice that and so on, with the suffixes whose first so many tokens have partners; at the end none has."""
    length, live = run_tokens, written(_with_partners(suffixes))
    yield length, live
    while not live.isEmpty():
        ahead = live.select("host", "content", (F.col("at") - length).alias("at"), F.col("rank").alias("_r")).distinct()
        both = live.drop("pages", "set_aside").join(ahead, ["host", "content", "at"]).withColumn("rank", F.xxhash64("rank", "_r")).drop("_r")
        live = written(_with_partners(both))
        length *= 2
        yield length, live


def host_repeats(streams: DataFrame, run_tokens: int = 8) -> DataFrame:
    """`host, content, at, length, pages`: where a run of at least run_tokens tokens begins that another content of the host has too.

    streams: host, content, tokens; one row a distinct content of a host. length is the longest run found by doubling,
    pages the number of contents that share its first run_tokens tokens; the runs at a place and the ones behind it cover
    each maximal repeat. Rounds end when no suffix has a partner, after the logarithm of the longest repeat. Every step
    groups or joins by the suffix's rank or place, so no host meets in one task.
    """
    found = None
    for length, live in _doubled(_suffixes(streams, run_tokens), run_tokens):
        part = live.select("host", "content", "at", F.lit(length).alias("length"), F.when(F.lit(length == run_tokens), F.col("pages")).alias("pages"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("host", "content", "at").agg(F.max("length").alias("length"), F.max("pages").alias("pages"))


def repeated_blocks(suffixes: DataFrame, run_tokens: int) -> DataFrame:
    """`host, content, begin, end, aside, whole` from `host, least, content, at, rank, block, aside`, in tokens.

    whole: a block of run_tokens tokens or more that at least `least` contents have, as a block or within others; aside if
    it begins somewhere in running text that markup sets aside. Else an island: each run of run_tokens tokens in it is had by
    so many, once for all such runs and, as aside, once for those that are set aside somewhere. block is the length of
    the block that begins with the suffix, or 0.
    """
    at = None
    for length, live in _doubled(suffixes, run_tokens):
        part = live.withColumn("base", F.lit(length))
        runs, at = (part, part) if at is None else (runs, at.unionByName(part))
    ends = at.select("host", "content", "base", F.col("at").alias("_end"), F.col("rank").alias("_r")).distinct()
    asked = at.filter("block >= base AND block < 2 * base").select("host", "base", "rank", F.col("block").alias("length")).distinct()
    tried = at.drop("pages", "set_aside").join(asked, ["host", "base", "rank"]).withColumn("_end", F.col("at") + F.col("length") - F.col("base"))
    tried = tried.join(ends, ["host", "content", "base", "_end"]).withColumn("rank", F.xxhash64("base", "length", "rank", "_r"))
    whole = _with_partners(written(tried)).filter("block = length")
    whole = whole.select("host", "content", F.col("at").alias("begin"), (F.col("at") + F.col("length")).alias("end"), F.col("set_aside").alias("aside"), F.lit(True).alias("whole"))
    runs = runs.select("host", "content", "at", F.explode(F.array_distinct(F.array(F.lit(False), "set_aside"))).alias("aside")).distinct()
    order = F.row_number().over(Window.partitionBy("host", "content", "aside").orderBy("at"))
    islands = runs.withColumn("_k", F.col("at") - order).groupBy("host", "content", "aside", "_k").agg(F.min("at").alias("begin"), (F.max("at") + run_tokens).alias("end"))
    return whole.unionByName(islands.drop("_k").withColumn("whole", F.lit(False)))


def host_boilerplate(pages: DataFrame, run_tokens: int = 8, share: float = 0.3) -> DataFrame:
    """`host, content, runs` from `host, html`: what repeated_blocks finds, as one list a content.

    It counts if at least two, and at least that share, of the host's distinct contents have it. Equal contents count
    once, so copies of a page don't make it boilerplate; pages without a host are compared with none.
    """
    pages = pages.filter("host IS NOT NULL")
    found = repeated_blocks(written(_candidates(pages, common_anchors(pages, run_tokens, share), run_tokens)), run_tokens)
    return written(found.groupBy("host", "content").agg(F.sort_array(F.collect_list(F.struct("begin", "end", "aside", "whole"))).alias("runs")))


def _blocks(pages: DataFrame, run_tokens: int) -> DataFrame:
    """`page_id, url, host, content, blocks` from `page_id, url, host, html`; blocks: text, kind, and begin and end in the page's tokens."""

    def each(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for some, texts, kinds, runs in _some_pages(batches, run_tokens):
            words = np.array([t.count(" ") + 1 for page in texts for t in page], np.int64)
            sizes = [len(page) for page in texts]
            end = np.cumsum(words) - np.repeat(runs.first[:-1], sizes)
            columns = [pa.array([t for page in texts for t in page], pa.string()), pa.array([*"".join(kinds)], pa.string()), pa.array((end - words).astype(np.int32)), pa.array(end.astype(np.int32))]
            blocks = _lists(pa.StructArray.from_arrays(columns, ["text", "kind", "begin", "end"]), sizes)
            yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(runs.content.view("int64")), blocks], ["page_id", "url", "host", "content", "blocks"])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "host", "html").mapInArrow(
        each, f"page_id {kind}, url string, host long, content long, blocks array<struct<text:string,kind:string,begin:int,end:int>>"
    )


def extract_main_text(pages: DataFrame, run_tokens: int = 8, share: float = 0.3, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """`page_id, url, text, n_chars, n_repeated` per row: the main text, blocks joined by a blank; "" for null, empty and text-less pages.

    All pages are compared, marked articles too. n_repeated counts the page's tokens, in all its blocks, that lie in runs
    which are boilerplate by their number. Repeated rows are extracted each and count as one content when pages of a host
    are compared, and so do copies under other ids; hosts come from the url, without one, or without an id, a page is
    compared with none. Other columns are not read.
    """
    name = F.nullif(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("host", F.when(F.col("page_id").isNotNull() & name.isNotNull(), F.xxhash64(name)))
    runs = F.coalesce("runs", F.array().cast("array<struct<begin:int,end:int,aside:boolean,whole:boolean>>"))
    found = _blocks(rows, run_tokens).join(host_boilerplate(rows, run_tokens, share), ["host", "content"], "left").withColumn("runs", runs)

    def covered(b: Column) -> Column:
        short = b["end"] - b["begin"] < run_tokens
        fits = lambda r: (r["begin"] <= b["begin"]) & (r["end"] >= b["end"]) & F.when(short, ~r["whole"]).otherwise(r["whole"] & (r["begin"] == b["begin"]) & (r["end"] == b["end"]))
        return F.exists("runs", lambda r: (r["aside"] | (b["kind"] != "p")) & fits(r))

    kept = F.filter("blocks", lambda b: (b["kind"] == "a") | b["kind"].isin("p", "o") & ~covered(b))
    first = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    fresh = F.aggregate(F.filter("runs", lambda r: ~r["whole"]), first, lambda s, r: F.struct(r["end"].alias("end"), (s["n"] + r["end"] - F.greatest(s["end"], r["begin"])).alias("n")), lambda s: s["n"].cast("long"))
    texts = found.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), " ").alias("text"), fresh.alias("n_repeated"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
