"""Mixing sources to target weights by capped water-filling.

Targets share the total by weight; a source whose share exceeds its largest number of epochs is clamped there and the
excess is shared out among the rest, until nothing is above its clamp. That is one level L with target
min(epochs * size, L * weight). A document is then taken whole floor(target / size) times, and once more with the
fraction as probability, by a seeded systematic sample over documents of like size, so that source totals are met
closely and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import global_index, n_words_of, settled

#: Weights dealt to sources in code-point order, again and again.
WEIGHTS = (5, 2, 1)


def unit_hash(*parts: Column | str, seed: int) -> Column:
    """A number in [0, 1) from a seed and columns: the first 32 bits of an md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("\0")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = 3) -> DataFrame:
    """`source, source_size, weight, target` from `source, source_size` (one row a source).

    Sources are ranked by code point, a null source last. The level rises in rounds, each one sum over the source
    table; only two numbers a round come to the driver. Sources of size 0 get target 0; no rows give no rows.
    """
    ranked = global_index(sizes, [F.col("source").asc_nulls_last()], "_rank")
    table = F.array(*(F.lit(w) for w in weights))
    ranked = ranked.withColumn("weight", F.element_at(table, (F.col("_rank") % len(weights) + 1).cast("int"))).drop("_rank")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * epochs
    level = 0.0
    while True:
        over = cap < F.col("weight") * F.lit(level)
        held, free = ranked.agg(F.sum(F.when(over, cap).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        new = (total - held) / free if free else level
        if new <= level:
            break
        level = new
    return ranked.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level)))


def mix_counts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = 3, seed: int = 8, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How often each document is taken: `doc_id, source, size, source_size, target, copies, taken`.

    Documents over a hundredth of their source are sampled apart and the others make up for what those miss, so a
    source ends within about a hundredth of its target wherever the others allow. Null or empty texts have size 0 and
    are taken floor(target / size) = 0 times; a null source is a source; repeated rows count each. Sums are combined
    before they are shuffled and the sample works by position in one order, so a hot source is no hot task.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words_of(F.col(text)).alias("size"))
    sized = settled(sized)
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = settled(source_targets(sizes, weights, epochs))
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select(sized["*"], "source_size", "target")
    rows = rows.withColumn("_large", F.col("size") * 100 > F.col("source_size")).withColumn("_key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"))))
    rows = global_index(rows, [F.col("source").asc_nulls_last(), F.col("_large"), F.col("size"), F.col("_key")], "_at")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("_whole", F.floor(rate)).withColumn("_part", rate - F.floor(rate)).withColumn("_start", unit_hash("source", seed=seed))

    def drawn(share: Column) -> Column:
        return F.floor((F.col("_at") + 1) * share + F.col("_start")) > F.floor(F.col("_at") * share + F.col("_start"))

    # at most a hundred a source can be large: decided together, largest first, each so that the words taken stay nearest to its share
    large = rows.filter("_large").groupBy("source").agg(
        F.first("_part").alias("_p"), F.first("_start").alias("_s0"), F.sort_array(F.collect_list(F.struct("size", "_at")), False).alias("_docs")
    )

    def decide(a: Column, x: Column) -> Column:
        yes, no = a["e"] + (1 - F.col("_p")) * x["size"], a["e"] - F.col("_p") * x["size"]
        take = F.abs(yes) < F.abs(no)
        return F.struct(
            F.when(take, yes).otherwise(no).alias("e"), (a["n"] + F.when(take, x["size"]).otherwise(0)).alias("n"),
            F.when(take, F.array_append(a["at"], x["_at"])).otherwise(a["at"]).alias("at"),
        )

    begin = F.struct(
        ((F.col("_s0") - 0.5) * F.element_at("_docs", -1)["size"]).alias("e"), F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("at")
    )
    large = large.select(
        F.col("source").alias("_src"), F.aggregate("_docs", begin, decide).alias("_d"), F.aggregate("_docs", F.lit(0).cast("long"), lambda a, x: a + x["size"]).alias("_large_size")
    ).select("_src", "_large_size", F.col("_d.n").alias("_large_taken"), F.col("_d.at").alias("_taken_at"))
    rows = rows.join(large, F.col("source").eqNullSafe(F.col("_src")), "left").na.fill(0, ["_large_size", "_large_taken"])
    rows = rows.withColumn("_more", F.coalesce(F.array_contains("_taken_at", F.col("_at")), F.lit(False)))
    rest = F.col("source_size") - F.col("_large_size")
    share = F.when(rest > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_part") * F.col("source_size") - F.col("_large_taken")) / rest))).otherwise(0.0)
    rows = rows.withColumn("_share", F.when(F.col("_part") > 0, share).otherwise(0.0))
    extra = F.when(F.col("_large"), F.col("_more")).otherwise(drawn(F.col("_share")))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("_whole") + extra.cast("int")).cast("int")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = 3, seed: int = 8) -> DataFrame:
    """The mixed corpus: every document as many times as it is taken, with docs' own columns.

    Rows are joined to their counts by id and text hash, so repeated ids keep their own texts.
    """
    h, copies, rows, n = (name + "_" * max((len(c) for c in docs.columns), default=0) for name in "hcrn")  # longer than any column of docs
    keyed = docs.withColumn(h, F.xxhash64("doc_id", "text", "source"))
    counts = mix_counts(docs.select(F.struct("doc_id", F.xxhash64("doc_id", "text", "source").alias("h")).alias("doc_id"), "text", "source"), weights, epochs, seed)
    counts = counts.groupBy(F.col("doc_id.h").alias(h)).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows))
    each = keyed.join(counts.filter(F.col(copies) > 0), h)
    # equal rows are one row taken as often as all of them together
    once = each.filter(F.col(rows) == 1).unionByName(each.filter(F.col(rows) > 1).dropDuplicates([h]))
    return once.withColumn(n, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int")))).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_counts(docs).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM src),
r AS (SELECT *, 3.0::DOUBLE * source_size / weight AS ratio FROM w),
o AS (SELECT *, row_number() OVER (ORDER BY ratio, source) AS k,
  coalesce(sum(3 * source_size) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
  sum(weight) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM r),
lv AS (SELECT (((SELECT sum(source_size) FROM src) - held)::DOUBLE / free::DOUBLE) AS level FROM o
  WHERE ((SELECT sum(source_size) FROM src) - held)::DOUBLE / free::DOUBLE <= ratio ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * (SELECT level FROM lv)) AS target FROM w),
rows AS (SELECT s.doc_id, s.source, s.size, t.source_size, t.target, s.size * 100 > t.source_size AS large,
  CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  (('0x' || substr(md5('8|' || coalesce(s.source, chr(0))), 1, 8))::BIGINT)::DOUBLE / 4294967296.0 AS start
  FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
pos AS (SELECT *, floor(rate) AS whole, rate - floor(rate) AS part,
  row_number() OVER (ORDER BY source NULLS LAST, large, size, md5('8|' || doc_id)) - 1 AS loc FROM rows),
big AS (SELECT source, part, size, loc, start, row_number() OVER (PARTITION BY source ORDER BY size DESC, loc DESC) AS k,
  min(size) OVER (PARTITION BY source) AS least_size FROM pos WHERE large),
fold AS (
  SELECT source, 0::BIGINT AS k, (any_value(start) - 0.5) * any_value(least_size) AS e, -1::BIGINT AS loc, false AS take, 0::BIGINT AS size FROM big GROUP BY source
  UNION ALL
  SELECT b.source, b.k, CASE WHEN abs(f.e + (1 - b.part) * b.size) < abs(f.e - b.part * b.size) THEN f.e + (1 - b.part) * b.size ELSE f.e - b.part * b.size END,
    b.loc, abs(f.e + (1 - b.part) * b.size) < abs(f.e - b.part * b.size), b.size
  FROM fold f JOIN big b ON b.source IS NOT DISTINCT FROM f.source AND b.k = f.k + 1),
more AS (SELECT p.*, coalesce(f.take, false) AS more FROM pos p LEFT JOIN fold f ON p.loc = f.loc),
lg AS (SELECT source, sum(CASE WHEN large THEN size ELSE 0 END) AS large_size, sum(CASE WHEN more THEN size ELSE 0 END) AS large_taken FROM more GROUP BY source),
sh AS (SELECT m.*, CASE WHEN part > 0 AND source_size - large_size > 0
    THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (part * source_size - large_taken) / (source_size - large_size)::DOUBLE)) ELSE 0 END AS share
  FROM more m JOIN lg ON m.source IS NOT DISTINCT FROM lg.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE size * (whole +
  CASE WHEN (CASE WHEN large THEN more ELSE floor((loc + 1) * share + start) > floor(loc * share + start) END) THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM sh
"""
