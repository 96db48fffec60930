"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every rule compares one value of a text with a limit. The limits come in levels, from strict to loose, fixed before
any label is seen. For each stratum, the labelled documents that pass the base rules and are marked good are a holdout:
a level is certified if the exact binomial upper bound of its false rejections stays within the risk, at a confidence
divided by the number of levels and strata tested. The strictest certified level applies; a stratum without
one rejects nothing beyond the base rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CHARS, settled, words_of

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Upper limits of the rule values by level, strict to loose.
LEVELS: dict[str, tuple[float, ...]] = {
    "symbol_ratio": (0.05, 0.1, 0.2, 0.4, 0.8, 1.6),
    "dup_line_ratio": (0.1, 0.2, 0.3, 0.4, 0.6, 0.8),
    "repeat_ratio": (0.1, 0.15, 0.2, 0.3, 0.4, 0.5),
    "word_length": (7.0, 8.0, 9.0, 10.0, 12.0, 15.0),
    "word_shortness": (1 / 4, 1 / 3.5, 1 / 3, 1 / 2.5, 1 / 2, 1 / 1.5),
    "upper_ratio": (0.1, 0.15, 0.2, 0.3, 0.5, 0.8),
    "mark_ratio": (0.02, 0.05, 0.1, 0.2, 0.5, 1.0),
}
N_LEVELS = 6
RISK, CONFIDENCE = 0.01, 0.95


def _removed(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def with_text_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper and n_marks.

    Null and empty texts measure 0 everywhere. Repeated 3-word windows are found inside the row: windows become 64-bit
    hashes with their places, sorted; equal neighbours repeat, and each repeated window covers three places up to the
    next one. Nothing is shuffled and a long text is one row's arrays.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_words", words_of(t)).withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    windows = F.transform(
        F.slice("_hash", 1, F.greatest(F.size("_hash") - 2, F.lit(0))),
        lambda h, i: F.struct(F.xxhash64(h, F.get(F.col("_hash"), i + 1), F.get(F.col("_hash"), i + 2)).alias("h"), i.alias("i")),
    )
    df = df.withColumn("_windows", F.sort_array(windows))
    same = lambda i, x: F.coalesce(F.get(F.col("_windows"), i)["h"] == x["h"], F.lit(False))
    repeated = F.filter("_windows", lambda x, i: same(i - 1, x) | same(i + 1, x))
    df = df.withColumn("_starts", F.sort_array(F.transform(repeated, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("_starts", lambda s, k: F.least(F.lit(3), F.coalesce(F.get(F.col("_starts"), k + 1) - s, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    df = df.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: F.translate(x, WS_CHARS, "") != ""))
    bare = F.translate(t, WS_CHARS, "")
    return df.select(
        *[c for c in df.columns if not c.startswith("_") and c not in ("n_words",)],
        "n_words",
        F.length(bare).cast("long").alias("word_chars"),
        _removed(t, SYMBOLS).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        _removed(t, UPPER).cast("long").alias("n_upper"),
        _removed(t, "!?").cast("long").alias("n_marks"),
    )


def rule_values() -> dict[str, Column]:
    """Rule values from the measures; a text without words or lines has 0 in each."""

    def over(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "symbol_ratio": over("n_symbols", "n_words"), "dup_line_ratio": over("n_dup_lines", "n_lines"), "repeat_ratio": over("n_repeat_words", "n_words"),
        "word_length": over("word_chars", "n_words"), "word_shortness": over("n_words", "word_chars"), "upper_ratio": over("n_upper", "word_chars"),
        "mark_ratio": over("n_marks", "n_words"),
    }


def strictest_passed() -> Column:
    """The strictest level whose limits a text meets (0 is strict; N_LEVELS: it meets none): levels are nested."""
    needed = []
    for name, value in rule_values().items():
        limits = LEVELS[name]
        level = F.lit(N_LEVELS)
        for k in range(N_LEVELS - 1, -1, -1):
            level = F.when(value <= limits[k], F.lit(k)).otherwise(level)
        needed.append(level)
    return F.greatest(*needed)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exact up to rounding, for k <= n p; 1.0 beyond.

    The last term in logarithms times the sum of the others relative to it, downwards.
    """
    top = F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    log_last = F.aggregate(top, F.lit(0.0), lambda a, i: a + F.log((n - i + 1) / i)) + k * math.log(p) + (n - k) * math.log1p(-p)
    down = F.when(k > 0, F.sequence(k.cast("int"), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("s"))

    def step(a: Column, i: Column) -> Column:
        r = a["r"] * i * (1 - p) / ((n - i + 1) * p)
        return F.struct(r.alias("r"), (a["s"] + r).alias("s"))

    return F.when(k <= n * p, F.exp(log_last) * F.aggregate(down, start, step, lambda a: a["s"])).otherwise(F.lit(1.0))


def certified_levels(holdout: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE, stratum: str = "stratum") -> DataFrame:
    """`stratum, level`: the strictest level with certified false rejections among good documents, for strata that have one.

    holdout has one row per good document that passed the base rules: its stratum and `passes`, the strictest level it
    meets. Level l rejects those with passes > l. Counts are combined before the shuffle; one row a stratum is left.
    The tail of the exact binomial at the risk must be within (1 - confidence) / (levels * strata), so all
    statements hold together.
    """
    counts = holdout.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.when(F.col("passes") > k, 1).otherwise(0)).alias(f"k{k}") for k in range(N_LEVELS)))
    counts = settled(counts)
    tests = max(1, counts.count()) * N_LEVELS
    ok = [F.when(binomial_tail(F.col(f"k{k}"), F.col("n"), risk) <= (1 - confidence) / tests, F.lit(k)) for k in range(N_LEVELS)]
    return counts.select(stratum, F.coalesce(*ok).alias("level")).filter("level IS NOT NULL")


def apply_quality_rules(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per row of docs: doc_id, its stratum, a hash of text and stratum (text_hash), the measures, base_failed, level and kept.

    labels has doc_id and quality (1 good); documents with both marks count as good, null marks as none. A null
    stratum is a stratum of its own. Null, empty and short texts fail the base rules. Repeated rows keep a row each;
    labels never add rows. An empty table gives no rows. Measures are computed once and kept in the checkpoint folder.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(stratum).alias("stratum"), F.col(text).alias("text"), F.xxhash64(text, stratum).alias("text_hash"))
    measured = with_text_measures(rows).drop("text").withColumn("base_failed", base_failed()).withColumn("passes", strictest_passed())
    measured = settled(measured)
    good = labels.groupBy(F.col("doc_id").alias("doc_id")).agg(F.max("quality").alias("_q")).filter("_q = 1").select("doc_id")
    holdout = measured.filter(~F.col("base_failed")).select("doc_id", "stratum", "passes").join(good, "doc_id", "left_semi")
    levels = certified_levels(holdout, risk, confidence)
    out = measured.join(levels.withColumnRenamed("stratum", "_s"), F.col("stratum").eqNullSafe(F.col("_s")), "left").drop("_s")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("level").isNull() | (F.col("passes") <= F.col("level"))))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return apply_quality_rules(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _passes_sql() -> str:
    exprs = {
        "symbol_ratio": ("n_symbols", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words"),
        "word_length": ("word_chars", "n_words"), "word_shortness": ("n_words", "word_chars"), "upper_ratio": ("n_upper", "word_chars"), "mark_ratio": ("n_marks", "n_words"),
    }
    parts = []
    for name, (a, b) in exprs.items():
        value = f"(CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b}::DOUBLE ELSE 0 END)"
        parts.append("CASE " + " ".join(f"WHEN {value} <= {limit!r}::DOUBLE THEN {k}" for k, limit in enumerate(LEVELS[name])) + f" ELSE {N_LEVELS} END")
    return "greatest(" + ", ".join(parts) + ")"


def _measures_sql(table: str) -> str:
    return rf"""
  txt AS (SELECT doc_id, coalesce('=' || lang, 'none') AS stratum, coalesce(text, '') AS text, row_number() OVER () AS rid FROM {table}),
  arr AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM txt),
  win AS (SELECT rid, unnest(range(1, greatest(len(words) - 1, 1))) AS i, words FROM arr WHERE len(words) >= 3),
  tri AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM win),
  rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1),
  cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
  meas AS (SELECT a.doc_id, a.rid, a.stratum, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words, length(text) - length(translate(text, '{UPPER}', '')) AS n_upper, length(text) - length(translate(text, '!?', '')) AS n_marks
    FROM arr a LEFT JOIN cov c USING (rid)),
  judged AS (SELECT *, (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AS base_failed, {_passes_sql()} AS passes FROM meas),
  good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1),
  hold AS (SELECT stratum, passes FROM judged WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
  cnt AS (SELECT stratum, l.level, count(*) AS n, count(*) FILTER (WHERE passes > l.level) AS k
    FROM hold CROSS JOIN (SELECT unnest(range({N_LEVELS})) AS level) l GROUP BY ALL),
  tail AS (SELECT stratum, level, CASE WHEN k <= n * {RISK!r}::DOUBLE THEN list_sum(list_transform(range(0, k + 1),
      lambda i: exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({RISK!r}) + (n - i) * ln(1 - {RISK!r})))) ELSE 1 END AS p FROM cnt),
  lev AS (SELECT stratum, min(level) AS level FROM tail
    WHERE p <= {1 - CONFIDENCE!r} / ({N_LEVELS} * (SELECT count(DISTINCT stratum) FROM hold)) GROUP BY stratum),
  verdict AS (SELECT j.*, NOT base_failed AND (v.level IS NULL OR passes <= v.level) AS kept FROM judged j LEFT JOIN lev v USING (stratum))"""


OP6_SQL = f"""WITH {_measures_sql("documents")}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, kept FROM verdict
"""
