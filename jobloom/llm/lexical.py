"""Ranked lexical search, term at a time with limited accumulators.

Documents are tokenised once into postings of the items' terms, kept in the shared folder, from which Spark counts the
collection. Each task then takes its documents as shards: per item the terms go from the rarest on, each adding its integer
impacts to accumulators. Once the bounds of the terms still to come can't lift a new document to the 10th best partial
score, no accumulator is created any more, and the survivors alone are updated, exactly. A document of the final ten is
among the ten of its shard, so shards need nothing from each other; the best of all shards are ranked by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import span_hashes, written

#: Bytes of terms: digits, letters and all bytes of characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
B_PARTS, SCALE = 90, 1_000_000_000
FAR = (1 << 63) - 1


def _term_tables():
    """By byte: whether it belongs to a term; its lower case for A-Z."""
    import numpy as np

    inside, lower = np.ones(256, bool), np.arange(256, dtype=np.uint8)
    for a, b in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        inside[a : b + 1] = False
    lower[65:91] += 32
    return inside, lower


def _terms(texts: list[str]):
    """Hashes of all terms of the texts, in order, and the text of each."""
    import numpy as np

    inside, lower = _term_tables()
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\0".join([*raw, b""]), np.uint8)  # each text ends with a zero, which is in no term
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    data = lower[data]
    is_in = inside[data]
    edge = np.flatnonzero(is_in[1:] != is_in[:-1]) + 1
    if is_in[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[::2], edge[1::2]
    ends = np.cumsum([len(r) + 1 for r in raw])
    return span_hashes(data, begin, end), np.searchsorted(ends, begin, "right")


def _slices(texts: list[str], size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Stretches of about so many characters; a longer text is one by itself."""
    lo, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > size:
            yield lo, k
            lo, held = k, 0
        held += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """`item_id, term`: the distinct terms of each item, those of repeated ids together; null texts have none."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return items.select(F.col(item_id).alias("item_id"), F.explode(F.regexp_extract_all(lowered, F.lit(f"({TERM})"))).alias("term")).distinct()


def collection_postings(docs: DataFrame, terms: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, n, terms, tfs` per row of docs: its number of terms, and the places in `terms` that occur in it with their counts.

    Terms are told apart by 64-bit hashes of their bytes. Null texts count as empty; rows without terms have n = 0.
    """
    import numpy as np

    keys = np.array([span_hashes(np.frombuffer(t.encode(), np.uint8), np.zeros(1, np.int64), np.array([len(t.encode())]))[0] for t in terms] or [], np.uint64)
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], order.astype(np.int64)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, number = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in _slices(texts):
                hashes, owner = _terms(texts[lo:hi])
                n = np.bincount(owner, minlength=hi - lo)
                if len(known) and len(hashes):
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    hit = known[at] == hashes
                    pairs, tf = np.unique(owner[hit] * len(known) + number[at[hit]], return_counts=True)
                else:
                    pairs, tf = np.empty(0, np.int64), np.empty(0, np.int64)
                ends = np.searchsorted(pairs, np.arange(hi - lo + 1) * max(1, len(known)))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.astype(np.int32))) for x in (pairs % max(1, len(known)), tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Shard:
    """Postings of some documents by term, with the impact of each and its maximum by term."""

    def __init__(self, ids, null, n, doc, term, tf, n_docs: int, n_terms: int):
        import numpy as np

        self.ids, self.null = ids, null
        m = 100 - B_PARTS + (B_PARTS * n * n_docs) // max(1, n_terms)
        impact = (SCALE * tf) // (1000 * tf + 8 * m[doc])
        order = np.argsort(term, kind="stable")
        self.doc, self.impact, term = doc[order], impact[order], term[order]
        self.terms, self.begin = np.unique(term, return_index=True)
        self.end = np.append(self.begin[1:], len(term))
        self.most = np.maximum.reduceat(self.impact, self.begin) if len(term) else np.empty(0, np.int64)
        self.place = {t: k for k, t in enumerate(self.terms.tolist())}

    def top(self, terms, weights, k: int, floor: int = 0) -> list[tuple[int, int]]:
        """(row, score) of the k best, equal scores by id; terms from the rarest on. Rows that end below floor may be left out.

        stops: at which term the creation of accumulators ended, for tests.
        """
        import numpy as np

        here = [(self.place[t], w) for t, w in zip(terms, weights, strict=True) if t in self.place and w > 0]
        left = np.cumsum([int(self.most[p]) * w for p, w in here][::-1])[::-1]
        score = np.zeros(len(self.ids), np.int64)
        live, alive, self.stops = np.zeros(len(self.ids), bool), None, None
        for i, (p, w) in enumerate(here):
            if alive is None:
                made = np.flatnonzero(live)
                least = max(floor, int(np.partition(score[made], len(made) - k)[len(made) - k]) if len(made) >= k else 0)
                if left[i] < least:
                    alive, self.stops = made, i
            doc, impact = self.doc[self.begin[p] : self.end[p]], self.impact[self.begin[p] : self.end[p]]
            if alive is None:
                score[doc] += w * impact
                live[doc] = True
            elif len(alive) * 8 < len(doc):
                at = np.minimum(np.searchsorted(doc, alive), len(doc) - 1)
                has = doc[at] == alive
                score[alive[has]] += w * impact[at[has]]
            else:
                has = live[doc]
                score[doc[has]] += w * impact[has]
        made = np.flatnonzero(live & (score > 0)) if alive is None else alive[score[alive] > 0]
        if len(made) > k:  # all that tie with the kth stay until the order by id
            made = made[score[made] >= np.partition(score[made], len(made) - k)[len(made) - k]]
        best = made[np.lexsort((self.ids[made], self.null[made], -score[made]))][:k]
        return [(int(r), int(score[r])) for r in best]


def _search(shared, k: int, shard_rows: int, shard_postings: int):
    """Scores the documents of a task shard by shard; a later shard starts from the kth score of the earlier ones."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        items, n_docs, n_terms = shared.value
        best: list[list[tuple[int, bool, int]]] = [[] for _ in items]

        def take(held: list) -> None:
            size = [b.column(2).value_lengths().to_numpy(zero_copy_only=False) for b in held]
            ids = np.concatenate([b.column(0).fill_null(FAR).to_numpy() for b in held])
            null = np.concatenate([b.column(0).is_null().to_numpy(zero_copy_only=False) for b in held])
            flat = lambda c: np.concatenate([b.column(c).flatten().to_numpy() for b in held]).astype(np.int64)
            n = np.concatenate([b.column(1).to_numpy() for b in held])
            doc = np.repeat(np.arange(len(ids)), np.concatenate(size))
            shard = Shard(ids, null, n, doc, flat(2), flat(3), n_docs, n_terms)
            for own, (_, terms, weights) in zip(best, items, strict=True):
                floor = own[k - 1][0] if len(own) >= k else 0
                own += [(s, bool(null[r]), int(ids[r])) for r, s in shard.top(terms, weights, k, floor)]
                own.sort(key=lambda x: (-x[0], x[1], x[2]))
                del own[k:]

        held, rows, postings = [], 0, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, shard_rows):
                some = batch.slice(lo, shard_rows)
                held.append(some)
                rows, postings = rows + some.num_rows, postings + len(some.column(2).flatten())
                if rows >= shard_rows or postings >= shard_postings:
                    take(held)
                    held, rows, postings = [], 0, 0
        if held:
            take(held)
        out = [(q, None if null else d, s) for q, own in enumerate(best) for s, null, d in own]
        q, d, s = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(d, pa.int64()), pa.array(s, pa.int64())], ["item", "doc_id", "score"])

    return run


def _search_block(docs: DataFrame, block: DataFrame, k: int, doc_id: str, text: str, shard_rows: int, shard_postings: int) -> DataFrame:
    spark = docs.sparkSession
    asked: dict = {}
    for r in block.select("item_id", "term").collect():
        asked.setdefault(r[0], []).append(r[1])
    terms = sorted({t for ts in asked.values() for t in ts})
    number = {t: i for i, t in enumerate(terms)}
    postings = written(collection_postings(docs, terms, doc_id, text))
    n_docs, n_terms = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    # weights by the same logarithm as the definition's: Spark's
    found = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2.0 * F.lit(n_docs) + 2.0) / (2.0 * F.col("df") + 1.0)))
    table = {r[0]: (r[1], r[2]) for r in found.select("term", "df", weight).collect()}
    items = []
    for item, own in asked.items():
        ranked = sorted((table[number[t]][0], t, number[t], table[number[t]][1]) for t in own if number[t] in table)
        items.append((item, [x[2] for x in ranked], [x[3] for x in ranked]))
    shared = spark.sparkContext.broadcast((items, n_docs, n_terms))
    best = postings.filter("size(terms) > 0").mapInArrow(_search(shared, k, shard_rows, shard_postings), "item int, doc_id long, score long")
    window = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, x[0]) for i, x in enumerate(items)], f"item int, item_id {dict(block.dtypes)['item_id']}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", block_terms: int = 1_000_000, shard_rows: int = 32_768, shard_postings: int = 2_000_000) -> DataFrame:
    """`item_id, rank, doc_id, score`: each item's k best documents with score above 0.

    Equal scores go by id, null ids last; rows that repeat an id rank one by one. Items without terms, or whose terms occur nowhere, have no
    rows; an empty side gives none. Items are taken in blocks of about block_terms (item, term) pairs, which bounds what the driver
    holds and broadcasts (a term's string and numbers a pair); an item is in one block. Every block reads all documents. Other columns are not read.
    """
    terms = written(item_terms(items))
    n = terms.count()
    blocks = max(1, -(-n // block_terms))
    out = None
    for b in range(blocks):
        block = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        found = _search_block(docs, block, k, doc_id, text, shard_rows, shard_postings)
        out = found if out is None else out.unionByName(found)
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return ranked_search(docs, items)


OP12_SQL = r"""WITH words AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
  item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
  size AS (SELECT rid, doc_id, len(ts) AS n FROM words WHERE len(ts) > 0),
  total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM size),
  post AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ts) AS term FROM words) WHERE term IN (SELECT term FROM item) GROUP BY ALL),
  weight AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM post GROUP BY term), total),
  impact AS (SELECT rid, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)) AS c FROM post JOIN size USING (rid), total),
  scored AS (SELECT item_id, rid, doc_id, sum(w * c)::BIGINT AS score FROM item JOIN impact USING (term) JOIN weight USING (term) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scored WHERE score > 0) WHERE rank <= 10
"""
