"""Changes of stored tables: usage rows, cascades, last writes, patches, run outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import cost_usd
from ..functions.text import dedup_key, normalize_company, normalize_email, normalize_text
from .clustering import split_duplicates
from .gates import due


def usage_rows(calls: DataFrame, purpose: str, related_kind: str | None = None, related_id: str | None = None) -> DataFrame:
    """Usage rows of scorer calls (user_id, model, tokens, input_rate, output_rate): purpose, cost and a loose link to what they were for."""
    null = F.lit(None).cast("string")
    return calls.select(
        "user_id", F.lit(purpose).alias("purpose"), "model", "input_tokens", "output_tokens",
        cost_usd(F.col("input_tokens"), F.col("output_tokens"), F.col("input_rate"), F.col("output_rate")).alias("cost_usd"),
        F.lit(related_kind).cast("string").alias("related_kind"), (F.col(related_id).cast("string") if related_id else null).alias("related_id"),
    )


def append_usage(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def cascade_delete(gone: DataFrame, chain: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """What is left of each table of a chain of children when the parents in gone (one column, their key) go.

    chain: (table, its column of the parent's key, its own key), each the child of the one before. Every step is an
    anti-join; what goes from a table is handed on as the parents that go for the next.
    """
    left = []
    for table, ref, own in chain:
        keys = gone.select(F.col(gone.columns[0]).alias("_gone")).distinct()
        left.append(table.join(keys, F.col(ref) == F.col("_gone"), "left_anti"))
        gone = table.join(keys, F.col(ref) == F.col("_gone"), "left_semi").select(F.col(own).alias("_key"))
    return left


def null_links(rows: DataFrame, ref: str, gone: DataFrame) -> DataFrame:
    """rows with the link set to null where its target is in gone (one column)."""
    keys = gone.select(F.col(gone.columns[0]).alias("_gone")).distinct()
    return rows.join(keys, F.col(ref) == F.col("_gone"), "left").withColumn(ref, F.when(F.col("_gone").isNull(), F.col(ref))).drop("_gone")


def last_writes(commands: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Per key the last command's whole row: full replacement."""
    others = [c for c in commands.columns if c not in (key, *order)]
    return commands.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_v")).select(key, *(F.col(f"_v.{c}").alias(c) for c in others))


def with_default_preferences(users: DataFrame, preferences: DataFrame, key: str = "user_id") -> DataFrame:
    """One row a user: what it stated, else empty lists, no remote rule and nothing else."""
    out = users.select(key).join(preferences.withColumn("_stated", F.lit(True)), key, "left")
    for name, kind in preferences.dtypes:
        if name == key:
            continue
        default = F.array().cast(kind) if kind.startswith("array") else F.lit(False) if kind == "boolean" else None
        if default is not None:
            out = out.withColumn(name, F.when(F.col("_stated").isNull(), default).otherwise(F.col(name)))
    return out.drop("_stated")


def fold_patches(commands: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Per key each field's last value that isn't null: patches overwrite only what they give."""
    at = F.struct(*order)
    return commands.groupBy(key).agg(*(F.max_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields))


def get_or_create_verified(users: DataFrame, emails: DataFrame, now: Column, email: str = "email") -> DataFrame:
    """New snapshot of users (email, email_verified_at, others): unknown addresses of emails join, known ones are verified now if they weren't."""
    asked = emails.select(normalize_email(F.col(email)).alias("_e")).filter("_e <> ''").distinct()
    known = users.join(asked, F.col(email) == F.col("_e"), "left")
    verified = F.when(F.col("_e").isNotNull(), F.coalesce("email_verified_at", now)).otherwise(F.col("email_verified_at"))
    new = asked.join(users.select(email), F.col("_e") == F.col(email), "left_anti").select(F.col("_e").alias(email), now.alias("email_verified_at"))
    return known.withColumn("email_verified_at", verified).drop("_e").unionByName(new, allowMissingColumns=True)


def edit_documents(versions: DataFrame, edits: DataFrame, key: str, order: list[str]) -> DataFrame:
    """versions (key, structured, status, error, others) with the last manual edit of each: its structured, ready, no error. Edits of unknown versions do nothing."""
    last = last_writes(edits.select(key, *order, F.col("structured").alias("_new")), key, order).withColumn("_edited", F.lit(True))
    out = versions.join(last, key, "left")
    edited = F.col("_edited").isNotNull()
    return (
        out.withColumn("structured", F.when(edited, F.col("_new")).otherwise(F.col("structured"))).withColumn("status", F.when(edited, "ready").otherwise(F.col("status")))
        .withColumn("error", F.when(~edited, F.col("error"))).drop("_new", "_edited")
    )


def record_outcomes(sources: DataFrame, runs: DataFrame, order: list[str], max_failures: int = 5, key: str = "source_id") -> DataFrame:
    """sources with their runs written onto them: robots state, times, error, route, failures in a row, status.

    runs: key, order, at, error (null: success), route, vendor, robots_state. The last run sets state, times and error;
    the last one with a route sets the type. Failures add to those before unless a success came between; max_failures of
    them at the end of the runs stop the source. Sources without a run stay as they are.
    """
    place = F.struct(*order)
    good, routed = F.col("error").isNull(), F.col("route").isin("ats", "json_ld")
    last_good = F.max(F.when(good, place))
    per = runs.groupBy(key).agg(
        F.max_by(F.struct("at", "error", "robots_state"), place).alias("_last"), F.max_by(F.when(good, F.col("at")), F.when(good, place)).alias("_good_at"),
        F.max_by(F.when(routed, F.struct("route", "vendor")), F.when(routed, place)).alias("_route"), last_good.alias("_good"),
    )
    since = runs.join(per.select(F.col(key).alias("_k"), F.col("_good").alias("_g")), F.col(key) == F.col("_k"))
    streak = since.filter(~good & (F.col("_g").isNull() | (place > F.col("_g")))).groupBy(key).agg(F.count(F.lit(1)).alias("_streak"))
    out = sources.join(per, key, "left").join(streak, key, "left")
    ran = F.col("_last").isNotNull()
    new = lambda value, old: F.when(ran, value).otherwise(F.col(old))
    failures = F.coalesce("_streak", F.lit(0)) + F.when(F.col("_good").isNull(), F.coalesce("consecutive_failures", F.lit(0))).otherwise(0)
    kept = [c for c in sources.columns]
    return (
        out.withColumn("robots_state", new(F.col("_last.robots_state"), "robots_state")).withColumn("robots_checked_at", new(F.col("_last.at"), "robots_checked_at"))
        .withColumn("last_fetched_at", new(F.col("_last.at"), "last_fetched_at")).withColumn("last_error", new(F.col("_last.error"), "last_error"))
        .withColumn("last_success_at", F.coalesce("_good_at", "last_success_at")).withColumn("source_type", F.coalesce("_route.route", "source_type"))
        .withColumn("ats_vendor", F.when(F.col("_route").isNotNull(), F.col("_route.vendor")).otherwise(F.col("ats_vendor")))
        .withColumn("status", F.when(ran & (failures >= max_failures) & F.col("_last.error").isNotNull(), "error").otherwise(F.col("status")))
        .withColumn("consecutive_failures", new(failures, "consecutive_failures").cast(dict(sources.dtypes)["consecutive_failures"])).select(*kept)
    )


def manual_entries(batch: DataFrame, existing: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) postings typed in by hand: names trimmed, keys by names, source_type manual.

    batch has user_id, company_name, title, location and what else belongs to a posting; existing has user_id and
    dedup_key. A key that the user has, or that an earlier row of the batch takes, is rejected.
    """
    keyed = batch.withColumn("dedup_key", dedup_key(F.col("company_name"), F.col("title"), F.col("location"))).withColumn("source_type", F.lit("manual"))
    keyed = keyed.withColumn("company_name_normalized", normalize_company(F.col("company_name"))).withColumn("location_normalized", F.nullif(normalize_text(F.col("location")), F.lit("")))
    keyed = keyed.withColumn("company_name", F.trim("company_name")).withColumn("title", F.trim("title"))
    return split_duplicates(keyed, existing, ["user_id", "dedup_key"], order)


def build_payload(fields: list[Column], source_type: Column, vendor: Column, match: Column) -> Column:
    """A stored job's document as JSON: the posting's fields (nulls kept), its source type, and vendor and score where there are any."""
    base = F.to_json(F.struct(*fields, source_type.alias("source_type")), {"ignoreNullFields": "false"})
    more = F.to_json(F.struct(F.nullif(vendor, F.lit("")).alias("ats_vendor"), match.alias("match")))
    return F.when(more == "{}", base).otherwise(F.concat(F.substring(base, F.lit(1), F.length(base) - 1), F.lit(","), F.substring(more, F.lit(2), F.length(more))))


def source_type_of(document: Column) -> Column:
    """The source type inside a stored document."""
    return F.try_variant_get(F.try_parse_json(document), "$.source_type", "string")


def due_messages(sources: DataFrame, now: Column, task: str = "job_source.fetch") -> DataFrame:
    """`body`: one message for each due source (source_id, status, last_fetched_at, fetch_interval_hours), as its queue's envelope."""
    waiting = sources.filter(due(F.col("status"), F.col("last_fetched_at"), F.col("fetch_interval_hours"), now))
    payload = F.struct(F.col("source_id").cast("string").alias("source_id"))
    key = F.sha2(F.concat_ws("|", F.lit(task), F.col("source_id").cast("string"), now.cast("string")), 256)
    return waiting.select("source_id", F.to_json(F.struct(F.lit(task).alias("task"), payload.alias("payload"), key.alias("idempotency_key"), now.alias("enqueued_at"))).alias("body"))
