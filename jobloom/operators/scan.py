"""Running sums and maxima per key when one key may hold most rows: sorted ranges, a summary a range, carried on and applied inside.

Rows are dealt by ranges of (key, order), so a hot key spreads over as many ranges as its rows fill. A window runs inside each
(range, key); what came before is the sum of the summaries of the key's earlier ranges. Only the first key of a range can have begun
before it, so what is carried has at most a row a range and is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settled


def in_ranges(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """rows sorted by key and order in ranges, with the range's number `_range`; kept in the shared folder, so that all readers see the same ranges.

    order must tell a key's rows apart. Null keys are a key. The number of ranges is spark.sql.shuffle.partitions.
    """
    cols = [F.col(c) for c in (*key, *order)]
    return settled(rows.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_range", F.spark_partition_id()))


def running(placed: DataFrame, key: list[str], order: list[str], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, before: bool = False) -> DataFrame:
    """placed (rows in ranges) with running sums and maxima of its key up to and with each row, or, with before, of the rows before it.

    Nulls count as nothing; a maximum of no values is null, a sum 0.
    """
    sums, maxima = sums or {}, maxima or {}
    rows = placed.withColumns({f"_v_{n}": c for n, c in (sums | maxima).items()})
    kinds = [(n, F.sum) for n in sums] + [(n, F.max) for n in maxima]
    whole = rows.groupBy("_range", *key).agg(*(f(f"_v_{n}").alias(f"_c_{n}") for n, f in kinds))
    earlier = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.withColumns({f"_c_{n}": f(f"_c_{n}").over(earlier) for n, f in kinds} | {"_n": F.count(F.lit(1)).over(earlier)}).filter("_n > 0").drop("_n")
    carried = carried.select(F.col("_range").alias("_r"), *(F.col(k).alias(f"_k_{k}") for k in key), *(f"_c_{n}" for n, _ in kinds))
    inside = Window.partitionBy("_range", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    rows = rows.withColumns({f"_i_{n}": f(f"_v_{n}").over(inside) for n, f in kinds})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key), F.col("_range") == F.col("_r"))
    out = rows.join(F.broadcast(carried), same, "left")
    total = lambda n: F.coalesce(F.col(f"_i_{n}") + F.col(f"_c_{n}"), F.col(f"_i_{n}"), F.col(f"_c_{n}"), F.lit(0)).alias(n)
    most = lambda n: F.greatest(f"_i_{n}", f"_c_{n}").alias(n)
    return out.select(*placed.columns, *(total(n) for n in sums), *(most(n) for n in maxima))


def first_by_steps(events: DataFrame, key: list[str], seconds: str, order: str, gap: float) -> DataFrame:
    """events of known keys in ranges, with `_rank` in their key and `_step`: whether a walk that begins at a key's first event and goes on to the first one at least gap later meets them.

    Each event's successor is found by one merge: its time plus gap, sorted among the events, counts those before it. An event that
    follows a pause of at least gap is met in any case, so walks are cut there. Then pointers are doubled: after round k all events
    within 2**k steps are known and pointers reach 2**k steps; those that leave their stretch go. Every table is keyed by (key, rank),
    so no task holds a key, and rounds are the logarithm of the longest walk without a pause. gap is positive.
    """
    known = events.dropna(subset=key).withColumn("_t", F.col(seconds).cast("double"))
    placed = running(in_ranges(known, key, ["_t", order]), key, ["_t", order], {"_rank": F.lit(1)}, {"_prev": F.col("_t")}, before=True)
    placed = settled(placed.withColumn("_root", F.coalesce(F.col("_t") - F.col("_prev") >= gap, F.lit(True))).drop("_prev"))
    here = placed.select(*key, "_t", F.lit(1).alias("_event"), F.col("_rank").cast("long").alias("_a"))
    # on equal times a probe comes first: an event exactly gap later is its successor
    probes = placed.select(*key, (F.col("_t") + gap).alias("_t"), F.lit(0).alias("_event"), F.col("_rank").cast("long").alias("_a"))
    merged = running(in_ranges(here.unionByName(probes), key, ["_t", "_event", "_a"]), key, ["_t", "_event", "_a"], {"_b": F.col("_event")})
    inner = placed.filter("NOT _root").select(*key, F.col("_rank").cast("long").alias("_b"))
    jumps = settled(merged.filter("_event = 0").select(*key, "_a", F.col("_b").cast("long").alias("_b")).join(inner, [*key, "_b"]).select(*key, "_a", "_b"))
    met = settled(placed.filter("_root").select(*key, F.col("_rank").cast("long").alias("_a")))
    while not jumps.isEmpty():
        met = settled(met.unionByName(met.join(jumps, [*key, "_a"]).select(*key, F.col("_b").alias("_a"))).distinct())
        ahead = jumps.select(*key, F.col("_a").alias("_b"), F.col("_b").alias("_c"))
        jumps = settled(jumps.join(ahead, [*key, "_b"]).select(*key, "_a", F.col("_c").alias("_b")))
    met = met.select(*key, F.col("_a").alias("_rank"), F.lit(True).alias("_met"))
    return placed.withColumn("_rank", F.col("_rank").cast("long")).join(met, [*key, "_rank"], "left").withColumn("_step", F.coalesce("_met", F.lit(False))).drop("_met", "_root")
