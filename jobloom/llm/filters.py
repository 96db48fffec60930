"""Filter interaction audit: what each of several filters removes in every order in which they can be applied.

A document's failures are one bit mask, so an order's outcome at a step depends on two masks alone: the filters before the
step and the filter itself. Documents are counted by mask once; states (filters before, filter) are summed over
those counts, and orders only look their states up.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_REGEX, settled, shared_dir

NAMES = "ABCDE"


def failure_bits(text: Column) -> Column:
    """Bits 1, 2, 4 and 8 of filters A to D: few words, repeated words, many capitals, symbols. Null counts as empty, which fails A alone."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, WS_REGEX), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(t, F.lit("[A-Z]")).cast("long")
    fails = (n < 100, distinct * F.lit(100) < n * F.lit(80), capitals * 100 > F.length(t) * F.lit(10), t.rlike("[#$%&*|]"))
    return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0))


def earlier_copies(rows: DataFrame, least_share: int = 4096, least_rows: int = 500) -> DataFrame:
    """rows (doc_id, text and others) whose text is that of a row with a smaller doc_id, without the text: a left-semi self-join on hash, exact text and smaller id.

    The right side holds one row a repeated text, its least id; equal texts are combined before the shuffle. A hash with more
    than a 1 / least_share of the rows (and least_rows) is hot: at most least_share such hashes exist, which bounds the broadcast. Its
    left rows are dealt out to salts and its few right rows copied to each. Null texts count as empty; null ids are
    neither smaller than others nor have smaller ones; rows that repeat an id aren't smaller than each other.
    """
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_hash", F.xxhash64("text")).filter("doc_id IS NOT NULL")
    counts = rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    counts = settled(counts)
    limit = max(least_rows, -(-rows.count() // least_share))
    hot = F.broadcast(counts.filter(F.col("_n") > limit).select("_hash", F.ceil(F.col("_n") / limit).alias("_salts")))
    left = rows.join(hot, "_hash", "left").withColumn("_salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_salts")), F.lit(0)))
    right = rows.groupBy("_hash", "text").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    right = right.join(hot, "_hash", "left").select("_hash", "text", "_first", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)).alias("_salt"))
    same = (left["_hash"] == right["_hash"]) & (left["_salt"] == right["_salt"]) & (left["text"] == right["text"]) & (right["_first"] < left["doc_id"])
    return left.join(right, same, "left_semi").drop("text", "_hash", "_salt", "_salts")


def text_failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """`doc_id, part, bits, n`: documents with the bits of the filters A to E that they fail.

    The ids that the self-join finds (bit 16) are united with the rows of the other filters and met by id, text hash and part.
    Rows that agree in all three are one row here, n their number; a null part is the empty one; other columns
    are not read. Only narrow rows are shuffled for it.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"))
    other = rows.select("doc_id", "key", "part", failure_bits(F.col("text")).alias("bits"), F.lit(1).alias("n"))
    copies = earlier_copies(rows).select("doc_id", "key", "part", F.lit(16).alias("bits"), F.lit(0).alias("n"))
    return other.unionByName(copies).groupBy("doc_id", "key", "part").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))


def with_labels(failures: DataFrame, labels: DataFrame) -> DataFrame:
    """failures with `good` (quality 1) and `toxic` (toxic 1) of their ids; an id has a mark if any of its labels has it, null ids none."""
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    marks = marks.select(F.col("doc_id").alias("_id"), F.lit(False).alias("_none"), "good", "toxic")
    # rows without an id are dealt by their text, as one null key would be one task
    rows = failures.withColumn("_key", F.coalesce("doc_id", "key")).withColumn("_null", F.col("doc_id").isNull())
    joined = rows.join(marks, (F.col("_key") == F.col("_id")) & (F.col("_null") == F.col("_none")), "left")
    return joined.select("doc_id", "part", "bits", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def audit_orders(failures: DataFrame, names: str = NAMES) -> DataFrame:
    """One row per part, order of the filters and step, with the counts of documents (see op11).

    failures: part, bits (bit k: fails names[k]), n, good, toxic. The number of rows out is parts * F! * F, for the few
    filters of an audit; every state is looked up by equality. Parts without documents have no rows.
    """
    spark, count = failures.sparkSession, len(names)
    combos = failures.groupBy("part", "bits", "good", "toxic").agg(F.sum("n").alias("n"))
    orders, states = [], set()
    for order in permutations(range(count)):
        before = 0
        for step, k in enumerate(order, 1):
            orders.append(("".join(names[i] for i in order), step, before, 1 << k))
            states.add((before, 1 << k))
            before |= 1 << k
    every = F.array(*(F.struct(F.lit(b).alias("before"), F.lit(f).alias("own")) for b, f in sorted(states)))
    rows = combos.select("*", F.inline(every))
    bits, own, before = F.col("bits"), F.col("own"), F.col("before")
    fails, clean = bits.bitwiseAND(own) != 0, bits.bitwiseAND(before) == 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0))).cast("long")
    # of all orders, a document's m failing filters come first equally often
    share = F.lit(factorial(count)) / F.bit_count(bits)
    summed = rows.groupBy("part", "before", "own").agg(
        total(clean & ~fails).alias("kept"), total(clean & fails).alias("removed"), total(~clean & fails).alias("redundant"), total(bits == own).alias("unique_fails"),
        total(clean & fails & F.col("good")).alias("good_lost"), total(clean & fails & F.col("toxic")).alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * share.cast("long")).otherwise(F.lit(0))).cast("long").alias("shapley"),
    )
    table = spark.createDataFrame(orders, "filter_order string, step int, before int, own int")
    return summed.join(F.broadcast(table), ["before", "own"]).drop("before", "own")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return audit_orders(with_labels(text_failures(docs), labels)).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


OP11_SQL = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
  f AS (SELECT doc_id, part, (CASE WHEN len(words) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN min(doc_id) OVER (PARTITION BY text) < doc_id THEN 16 ELSE 0 END) AS bits FROM d),
  l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
  c AS (SELECT part, bits, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
  nm AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
  o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bs FROM nm a, nm b, nm c, nm d, nm e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
  s AS (SELECT filter_order, step, bs[step] AS own, list_sum(bs[1:step]) - bs[step] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
  r AS (SELECT part, filter_order, step, own, n, good, toxic, (bits & before::BIGINT) = 0 AS clean, (bits & own) <> 0 AS fails, bits = own AS only_own FROM c, s),
  g AS (SELECT part, filter_order, step, own, sum(CASE WHEN clean AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN clean AND fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN NOT clean AND fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN only_own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN clean AND fails AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN clean AND fails AND toxic THEN n ELSE 0 END) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM g
"""
