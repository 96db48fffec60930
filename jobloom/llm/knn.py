"""Exact top-k by inner product as a Voronoi join.

With M the largest norm among the data, a row x becomes the point (x, sqrt(M^2 - |x|^2)) and a query q the point (q, 0); then
|q - x|^2 = |q|^2 + M^2 - 2 q.x, so the nearest points are the best scores and the triangle inequality holds. One set of pivots
groups both sides: a row belongs to the pivot nearest to it, a query to the pivot nearest to it. What meets on the driver
are summaries alone: per data group its least and largest distance and the k + 1 smallest, per query group its radius and its
distance to the planes half way to other pivots. From them each query group gets a distance within which k rows besides
any query are sure to lie, and each pair of groups the span of distances in which a row can still matter. Only such rows are sent,
and each group is solved where it lies, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settled


def quantised(embeddings: DataFrame, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """`vec_id, v`: floor(scale * x) of every component as long, for rows whose id and vector hold no null or non-finite number.

    Components beyond a long stop at its limits.
    """
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    limit = float(1 << 63)
    whole = lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(limit)), F.lit(-limit))).cast("long")
    return embeddings.filter(F.col(vec_id).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


class Frame:
    """How vectors are packed and measured: their longest length, the width of a component, the largest norm; and the pivots."""

    def __init__(self, length: int, largest: int, norm2: float, pivots: np.ndarray):
        self.length, self.norm2 = length, norm2
        self.kind = next(t for t, top in ((np.int16, 1 << 15), (np.int32, 1 << 31), (np.int64, 1 << 63)) if largest < top or t is np.int64)
        #: Whether scores are exact in doubles.
        self.exact = float(largest) ** 2 * max(1, length) < 2.0**53
        self.pivots = pivots
        self.rest = np.sqrt(np.maximum(norm2 - (pivots * pivots).sum(1), 0))

    def padded(self, lists) -> np.ndarray:
        """A list column as a matrix; vectors shorter than the longest end in zeros."""
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.value_lengths().to_numpy(zero_copy_only=False)
        out = np.zeros((len(lists), self.length), np.int64)
        out[np.repeat(np.arange(len(lists)), ends), np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
        return out

    def pack(self, x: np.ndarray) -> list[bytes]:
        raw, width = x.astype(self.kind).tobytes(), self.length * np.dtype(self.kind).itemsize
        return [raw[a : a + width] for a in range(0, len(x) * width, width)] if width else [b""] * len(x)

    def unpack(self, rows) -> np.ndarray:
        return np.frombuffer(b"".join(rows), self.kind).reshape(len(rows), self.length)

    def distances(self, x: np.ndarray, as_query: bool) -> np.ndarray:
        """Distances of points to the pivots; a query's last coordinate is 0."""
        own2 = (x * x).sum(1)
        last = np.zeros(len(x)) if as_query else np.sqrt(np.maximum(self.norm2 - own2, 0))
        d2 = (own2 if as_query else self.norm2 * np.ones(len(x)))[:, None] + self.norm2 - 2 * (x @ self.pivots.T + last[:, None] * self.rest[None])
        return np.sqrt(np.maximum(d2, 0))


def _assign(shared, as_query: bool, of: int):
    """vec_id, packed vector, nearest of the first `of` pivots and the distance to it."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        frame = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                some = batch.slice(lo, 2048)
                x = frame.padded(some.column(1))
                d = frame.distances(x.astype(float), as_query)[:, :of]
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(frame.pack(x), pa.binary()), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell])], ["vec_id", "v", "cell", "dist"])

    return run


def _planes(shared):
    """Per task and pair of pivots the least distance of its queries to the plane half way, from their own pivot's side."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        frame = shared.value
        n, apart = len(frame.pivots), frame.distances(frame.pivots, False)
        least = np.full((n, n), np.inf)
        for batch in batches:
            if batch.num_rows:
                d2 = frame.distances(frame.unpack(batch.column(1).to_pylist()).astype(float), True) ** 2
                cell = batch.column(2).to_numpy()
                gap = (d2 - d2[np.arange(len(cell)), cell][:, None]) / np.maximum(2 * apart[cell], 1e-300)
                np.minimum.at(least, cell, gap)
        i, j = np.nonzero(np.isfinite(least))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(least[i, j])], ["i", "j", "gap"])

    return run


def _replicate(shared, count: bool = False):
    """Each row to the query groups it may matter to, once for each of a group's parts; with count only how many rows a group gets, batch by batch."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        frame, groups, low, high, reach, parts = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                cell, dist = some.column(2).to_numpy(), some.column(3).to_numpy()
                may = (dist[:, None] >= low[:, cell].T) & (dist[:, None] <= high[:, cell].T)
                row, g = np.nonzero(may)
                if not len(row):
                    continue
                seen, own = np.unique(row, return_inverse=True)
                near = frame.distances(frame.unpack(some.column(1).take(pa.array(seen)).to_pylist()).astype(float), False)[:, groups]
                keep = near[own, g] <= reach[g]
                row, g = row[keep], g[keep]
                if count:
                    hit, times = np.unique(groups[g], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(times.astype(np.int64))], ["g", "n"])
                    continue
                times = parts[g]
                row, c = np.repeat(row, times), np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                take = some.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(groups[g], times).astype(np.int32)), pa.array(c.astype(np.int32)), take.column(0), take.column(1)], ["g", "c", "vec_id", "v"])

    return run


def _solve(shared, k: int):
    """The k best rows of a block for each query of a part."""

    def run(key, data, queries):
        import pandas as pd

        frame = shared.value
        if len(data) == 0 or len(queries) == 0:
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")})
        order = np.argsort(data["vec_id"].to_numpy(), kind="stable")
        ids = data["vec_id"].to_numpy()[order]
        kind = float if frame.exact else object
        x = frame.unpack(data["v"].tolist())[order].astype(kind)
        out = []
        for lo in range(0, len(queries), 256):
            part = queries.iloc[lo : lo + 256]
            q = part["vec_id"].to_numpy()
            s = frame.unpack(part["v"].tolist()).astype(kind) @ x.T
            if not frame.exact:  # whole numbers of any size, held within a long
                s = np.clip(s, -(1 << 63), (1 << 63) - 1)
            s[q[:, None] == ids[None]] = -np.inf
            if not frame.exact:
                top = [sorted(range(len(ids)), key=lambda c, r=r: (-r[c], c))[:k] for r in s]
            elif len(ids) > 4 * k:
                # all that reach the kth best, so that ties go by id
                least = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                top = [c[np.argsort(-r[c], kind="stable")[:k]] for r, c in ((r, np.flatnonzero(r >= t)) for r, t in zip(s, least, strict=True))]
            else:
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            c = np.concatenate([np.asarray(t, np.int64) for t in top])
            r = np.repeat(np.arange(len(q)), [len(t) for t in top])
            good = s[r, c] != -np.inf
            r, c = r[good], c[good]
            out.append(pd.DataFrame({"query_id": q[r], "vec_id": ids[c], "score": s[r, c].astype(np.int64)}))
        return pd.concat(out)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, max_pivots: int = 1024, cell: int = 256, group: int = 128, block: int = 4096, part: int = 512, sent_to: list | None = None) -> DataFrame:
    """`query_id, rank, vec_id, score`: for each query its k best rows of vectors besides its own, ties to the smaller id.

    Both have `vec_id` and whole `v`; queries are rows of vectors. Vectors of other lengths count as filled up with zeros.
    Fewer than k others give all of them. Repeated (id, vector) rows count once; no row of
    the query's id is its partner. Scores that a long can't hold stop at its limits and tie there. Pivots are the
    least hashes of ids among distinct vectors, about one for `cell` rows and at most max_pivots; queries use the first of them, about one for
    `group` queries, since a row is sent once a query group. Their number changes the work and never the result. A group's rows and queries are cut into blocks by hash, so a crowded group is many tasks.
    A row is sent once a part of each query group it may matter to, a query once a block of the rows sent to its group: both follow the
    pruning. sent_to, if given, gets both numbers.
    """
    spark = vectors.sparkSession
    vectors = settled(vectors.dropDuplicates(["vec_id", "v"]))
    size = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    n, length, largest, norm2 = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda c: F.abs(c.cast("decimal(20,0)"))))), F.max(size)).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if n == 0 or queries.isEmpty():
        return empty
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(max_pivots, -(-n // cell)))).collect()
    pivots = np.array([[*r["v"], *[0] * (length - len(r["v"]))] for r in chosen], float).reshape(len(chosen), length)
    pivots = pivots[np.sort(np.unique(pivots, axis=0, return_index=True)[1])]
    frame = Frame(length, int(largest or 0), float(norm2), pivots)
    shared = spark.sparkContext.broadcast(frame)
    schema = "vec_id long, v binary, cell int, dist double"
    rows = settled(vectors.select("vec_id", "v").mapInArrow(_assign(shared, False, len(pivots)), schema))
    asked = queries.dropDuplicates(["vec_id", "v"]).select("vec_id", "v")
    asked = settled(asked.mapInArrow(_assign(shared, True, max(1, min(len(pivots), -(-asked.count() // group)))), schema))
    # summaries
    first = Window.partitionBy("cell").orderBy("dist", "vec_id")
    nearest = rows.groupBy("cell", "vec_id").agg(F.min("dist").alias("dist")).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).select("cell", "vec_id", "dist").collect()
    spans = {r["cell"]: (r["least"], r["most"]) for r in rows.groupBy("cell").agg(F.min("dist").alias("least"), F.max("dist").alias("most")).collect()}
    held = sorted((r["cell"], r["radius"], r["n"]) for r in asked.groupBy("cell").agg(F.max("dist").alias("radius"), F.count(F.lit(1)).alias("n")).collect())
    groups, radius = np.array([h[0] for h in held]), np.array([h[1] for h in held])
    slack = 1e-6 * np.sqrt(max(frame.norm2, 1.0)) + 1e-3
    apart = frame.distances(pivots[groups], False)
    ids, near_cell, near = np.array([r["vec_id"] for r in nearest]), np.array([r["cell"] for r in nearest]), np.array([r["dist"] for r in nearest])
    sure = np.full(len(groups), np.inf)
    for g in range(len(groups)):  # so near are k + 1 rows of different ids, whatever the group's query
        bound = apart[g, near_cell] + near
        order = np.argsort(bound)
        firsts = np.sort(np.unique(ids[order], return_index=True)[1])
        if len(firsts) > k:
            sure[g] = bound[order[firsts[k]]] + radius[g]
    reach = sure + radius + slack  # no row matters that is farther from the group's pivot than this
    low, high = apart - reach[:, None], apart + reach[:, None]
    for r in asked.select("vec_id", "v", "cell").mapInArrow(_planes(shared), "i int, j int, gap double").groupBy("i", "j").agg(F.min("gap").alias("gap")).collect():
        g = np.searchsorted(groups, r["i"])
        if r["i"] != r["j"] and r["gap"] > sure[g] + slack:  # all rows beyond the plane are too far
            low[g, r["j"]] = np.inf
    for j, (least, most) in spans.items():  # a whole data group is too near its pivot, or too far from it
        low[(most < low[:, j]) | (least > high[:, j]), j] = np.inf
    parts = np.array([-(-h[2] // part) for h in held])
    plan = spark.sparkContext.broadcast((frame, groups, low, high, reach, parts))
    sent = rows.mapInArrow(_replicate(plan), "g int, c int, vec_id long, v binary")
    # a group's blocks follow from the rows sent to it, so its queries meet those alone; one number a group
    got = {r["g"]: r["n"] for r in rows.mapInArrow(_replicate(plan, True), "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()}
    cuts = [max(1, -(-got.get(h[0], 0) // block)) for h in held]
    if sent_to is not None:
        sent_to += [sum(got[h[0]] * int(m) for h, m in zip(held, parts, strict=True) if h[0] in got), sum(h[2] * b for h, b in zip(held, cuts, strict=True))]
    of_group = lambda numbers, c: F.element_at(F.create_map(*(F.lit(int(x)) for h, m in zip(held, numbers, strict=True) for x in (h[0], m))), F.col(c))
    sent = sent.withColumn("b", F.pmod(F.xxhash64("vec_id"), of_group(cuts, "g")).cast("int"))
    own = asked.select(F.col("cell").alias("g"), F.pmod(F.xxhash64("vec_id", F.lit(1)), of_group(parts, "cell")).cast("int").alias("c"), "vec_id", "v")
    own = own.withColumn("b", F.explode(F.sequence(F.lit(0), of_group(cuts, "g") - 1)))
    found = sent.groupBy("g", "c", "b").cogroup(own.groupBy("g", "c", "b")).applyInPandas(_solve(shared, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_voronoi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
