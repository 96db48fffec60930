"""Upserts, pruning, matching and merging of keyed snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import in_ranges, running


def match_existing(batch: DataFrame, existing: DataFrame, keys: list[str], target: str, scope: list[str] = ()) -> DataFrame:
    """batch with the target of the existing row of its scope (its source) that agrees in the first of keys that any does: one equi-join a key, no OR join.

    Of several existing rows with a key the least target counts. Null scopes are a scope.
    """
    out = batch
    for k in keys:
        one = existing.filter(F.col(k).isNotNull()).groupBy(*(F.col(c).alias(f"_s_{c}") for c in scope), F.col(k).alias("_k")).agg(F.min(target).alias(f"_{k}"))
        same = F.col(k) == F.col("_k")
        for c in scope:
            same = same & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
        out = out.join(one, same, "left").drop("_k", *(f"_s_{c}" for c in scope))
    return out.withColumn(target, F.coalesce(*(F.col(f"_{k}") for k in keys))).drop(*(f"_{k}" for k in keys))


def attach_posting(rows: DataFrame, postings: DataFrame, keys: list[str] = ("user_id", "dedup_key"), name: str = "posting") -> DataFrame:
    """rows with the stored posting of their key as a struct, null where there is none; postings have one row a key."""
    others = [c for c in postings.columns if c not in keys]
    return rows.join(postings.select(*keys, F.struct(*others).alias(name)), list(keys), "left")


def attach_preferences(rows: DataFrame, preferences: DataFrame, key: str = "user_id", name: str = "prefs") -> DataFrame:
    """rows with their user's preferences as a struct, null where the user stated none. Spark broadcasts the table if its size allows."""
    others = [c for c in preferences.columns if c != key]
    return rows.join(preferences.select(key, F.struct(*others).alias(name)), key, "left")


def orphan_parents(parents: DataFrame, children: list[tuple[DataFrame, str, str]], exempt: Column) -> DataFrame:
    """Parents that no child table refers to and that aren't exempt; children: (table, parent's key, child's key)."""
    out = parents.filter(~exempt)
    for child, key, ref in children:
        out = out.join(child.select(F.col(ref).alias("_ref")), F.col(key) == F.col("_ref"), "left_anti")
    return out


def stale_rows(held: DataFrame, survivors: DataFrame, complete_runs: DataFrame, keys: list[str], run_key: str) -> DataFrame:
    """Held rows whose identity did not survive, of sources whose run was complete."""
    return held.join(complete_runs.select(run_key).distinct(), run_key, "left_semi").join(survivors.select(*keys), keys, "left_anti")


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str], fields: list[str], now: Column) -> DataFrame:
    """New snapshot: batch's fields win; first_seen stays, last_seen moves for batch rows alone."""
    e = existing.select(*keys, *(F.col(f).alias(f"_{f}") for f in fields), F.col("first_seen").alias("_first"), F.col("last_seen").alias("_last"))
    b = batch.select(*keys, *fields, F.lit(True).alias("_in"))
    out = e.join(b, keys, "full")
    seen = F.col("_in").isNotNull()
    return out.select(
        *keys, *(F.when(seen, F.col(f)).otherwise(F.col(f"_{f}")).alias(f) for f in fields),
        F.coalesce("_first", now).alias("first_seen"), F.when(seen, now).otherwise(F.col("_last")).alias("last_seen"),
    )


def best_view(rows: DataFrame, key: list[str], order: list[str], score: str) -> DataFrame:
    """Per key the view that a running merge ends with, and its best score.

    A row replaces the view if it has no score, if no score came before, or if its score is at least the best one so
    far. In closed form: it is accepted if its score is null or not below the running maximum before it; the view is the
    last accepted row.
    """
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    accepted = rows.withColumn("_best", F.max(score).over(w)).filter(F.col(score).isNull() | F.col("_best").isNull() | (F.col(score) >= F.col("_best")))
    others = [c for c in rows.columns if c not in key]
    last = F.max_by(F.struct(*others), F.struct(*order))
    return accepted.groupBy(*key).agg(last.alias("view"), F.max(score).alias("best_score"))


def merge_postings(existing: DataFrame, batch: DataFrame, key: list[str], order: list[str], score: str = "match_score") -> DataFrame:
    """New snapshot of stored postings: each keeps or changes its view by best_view, seeded with the stored one.

    existing and batch share their columns but for order, which batch has alone. The score is the best so far.
    """
    columns = existing.columns
    seed = existing.select("*", F.lit(0).alias("_new"), *(F.lit(None).cast(dict(batch.dtypes)[c]).alias(c) for c in order))
    rows = seed.unionByName(batch.select(*columns, F.lit(1).alias("_new"), *order))
    merged = best_view(rows, key, ["_new", *order], score)
    kept = [F.col("best_score").alias(c) if c == score else F.col(c) if c in key else F.col(f"view.{c}").alias(c) for c in columns]
    return merged.select(*kept)


def child_counts(parents: DataFrame, children: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """parents with a count per child table, 0 for none; children: (table, parent's key, child's key, name of the count)."""
    out = parents
    for child, key, ref, name in children:
        counts = child.groupBy(F.col(ref).alias("_ref")).agg(F.count(F.lit(1)).alias("_n"))
        out = out.join(counts, F.col(key) == F.col("_ref"), "left").withColumn(name, F.coalesce("_n", F.lit(0))).drop("_ref", "_n")
    return out


def first_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


def first_by_traversal(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows that a walk meets first for their key; order: the places of the walk."""
    return first_by(rows, key, [F.asc(c) for c in order])


def next_version(existing: DataFrame, key: str, number: str = "version_no") -> DataFrame:
    """`key, number`: the number that a key's next version takes."""
    return existing.groupBy(key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias(number))


def latest_version(versions: DataFrame, key: str, number: str) -> DataFrame:
    return versions.groupBy(key).agg(F.max_by(F.struct(*[c for c in versions.columns if c != key]), number).alias("latest"))


def number_versions(new: DataFrame, existing: DataFrame, key: str, order: list[str], number: str = "version_no") -> DataFrame:
    """new with the numbers behind the largest existing one of its key."""
    top = next_version(existing, key, number).withColumnRenamed(number, "_next")
    row = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return new.join(top, key, "left").withColumn(number, (F.coalesce("_next", F.lit(1)) + row - 1).cast("long")).drop("_next")


def with_nested(parents: DataFrame, children: DataFrame, key: str, order: str, name: str) -> DataFrame:
    fields = [order, *[c for c in children.columns if c not in (key, order)]]
    nested = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(nested, key, "left")


def split_duplicates(batch: DataFrame, existing: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rejected rows have an existing key, or one that an earlier row of the batch takes."""
    known = existing.select(*keys).distinct().withColumn("_known", F.lit(True))
    ranked = batch.join(known, keys, "left").withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    good = F.col("_known").isNull() & (F.col("_r") == 1)
    return ranked.filter(good).drop("_known", "_r"), ranked.filter(~good).drop("_known", "_r")


def run_counters(statuses: DataFrame, by: list[str], status: str, names: list[str]) -> DataFrame:
    return statuses.groupBy(*by).agg(F.count(F.lit(1)).alias("fetched"), *(F.count_if(F.col(status) == n).alias(n) for n in names))


def usage_totals(usage: DataFrame, by: list[str], cost: str = "cost_usd") -> DataFrame:
    """Calls, tokens and cost per purpose, model, user or whatever by names; cost adds up in decimals."""
    return usage.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(cost).alias("cost_usd"))


def any_waiting(sources: DataFrame, by: list[str] = ()) -> DataFrame:
    """`waiting`: whether any active source was never fetched; of all sources or per by."""
    waiting = F.coalesce(F.bool_or((F.col("status") == "active") & F.col("last_fetched_at").isNull()), F.lit(False))
    return (sources.groupBy(*by) if by else sources).agg(waiting.alias("waiting"))


def survivors(statuses: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """Identities that stay: unchanged, kept, and those that could not be scored."""
    return statuses.filter(F.col(status).isin("unchanged", "kept", "scoring_failed")).select(*keys).distinct()


def split_failures(deliveries: DataFrame, ok: Column, message_id: str = "message_id") -> tuple[DataFrame, DataFrame]:
    """(done, failed): failed has the message ids to deliver again, one row each; unknown outcomes failed."""
    good = F.coalesce(ok, F.lit(False))
    return deliveries.filter(good), deliveries.filter(~good).select(message_id).distinct()


def owned_only(ids: DataFrame, owned: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ids that are among a user's own; keys name the user and the id in both."""
    return ids.join(owned.select(*keys), keys, "left_semi")


def drop_except(rows: DataFrame, user: str, key: str, commands: DataFrame) -> DataFrame:
    """rows without those of the users of commands (user, keep), but for the key each keeps; a null keep drops all of the user's.

    One command a user counts: of several the least kept key.
    """
    kept = commands.groupBy(F.col(user).alias("_user")).agg(F.min("keep").alias("_keep"))
    out = rows.join(kept, F.col(user) == F.col("_user"), "left")
    return out.filter(F.col("_user").isNull() | F.coalesce(F.col(key) == F.col("_keep"), F.lit(False))).drop("_user", "_keep")


def attach_rates(calls: DataFrame, prices: DataFrame, model: str, fallback: tuple[str, str]) -> DataFrame:
    """calls with input_rate and output_rate of the first price (by priority) whose model_prefix begins the model; else the fallback.

    Rows keep their number: the model names, not the calls, are matched, each by all of its own prefixes, so the price list may be long
    and the join is one of equal keys. A null model has the fallback; of equal priorities any counts.
    """
    models = calls.select(model).filter(F.col(model).isNotNull()).distinct()
    prefixes = models.withColumn("_n", F.explode(F.sequence(F.lit(0), F.length(model)))).select(model, F.substring(F.col(model), F.lit(1), F.col("_n")).alias("_prefix"))
    hits = prefixes.join(prices, F.col("_prefix") == F.col("model_prefix"))
    best = hits.groupBy(model).agg(F.min_by(F.struct("input_rate", "output_rate"), "priority").alias("_p"))
    rate = lambda f, v: F.coalesce(F.col(f"_p.{f}"), F.lit(v).cast("decimal(10,4)")).alias(f)
    return calls.join(best, model, "left").select(*calls.columns, rate("input_rate", fallback[0]), rate("output_rate", fallback[1]))
