"""Incremental ingest: diff, rule filter, score gate, upsert, merge and prune, for the sources that a batch delivers.

Postings of a batch get one status each: unchanged, filtered, kept, below_threshold, scoring_failed, or unscored where
the scorer itself failed. A run with an error keeps what was scored but prunes nothing; nothing is written for a run with
an error that kept nothing. Every step is an equi-join or a column; no source is ever one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import parse_outcome
from ..functions.text import identity, normalize_company, normalize_text, posting_content, posting_key
from . import gates
from .clustering import attach_preferences, match_existing, merge_postings, orphan_parents, stale_rows, survivors
from .shared import settled
from .snapshots import build_payload, record_outcomes, source_type_of, usage_rows
from .store import Snapshot, SnapshotStore

__all__ = ["Scorer", "Snapshot", "SnapshotStore", "batch_usage", "ingest_batch", "ingest_status", "landed_scorer"]

#: Takes postings to score (with source_id, identity, prefs) and returns source_id, identity, status (of the call), body (its JSON), and the columns of CALL if it has them.
Scorer = Callable[[DataFrame], DataFrame]

FIELDS = ("title", "company_name", "location", "remote", "employment_type", "salary_min", "salary_max", "required_skills", "preferred_skills", "description", "apply_url", "needs_review")


def landed_scorer(outcomes: DataFrame) -> Scorer:
    """A scorer that looks its answers up in a landed table: source_id, identity, status, body."""

    def score(pending: DataFrame) -> DataFrame:
        return pending.select("source_id", "identity").join(outcomes, ["source_id", "identity"], "left")

    return score


def ingest_status(fetched: DataFrame, known: DataFrame, preferences: DataFrame, scorer: Scorer, threshold: int = 30, title_mode: str = "loose") -> DataFrame:
    """fetched with `identity, raw_text, digest, status, reason, match_score, outcome, call, error`.

    fetched: source_id, user_id, external_id, url, source_type, ats_vendor and a posting's FIELDS; one row an identity
    and source. known: source_id, identity, hash. Without preferences of its user a posting is kept unscored. A call that
    is to be retried, or refused, leaves its posting unscored and gives the run an error; an answer that is no outcome
    leaves it scoring_failed.
    """
    posting = F.struct(*FIELDS)
    rows = fetched.withColumn("identity", identity(F.col("external_id"), F.col("url"))).withColumn("raw_text", posting_content(posting)).withColumn("digest", F.sha2("raw_text", 256))
    rows = gates.attach_known_hash(rows, known, ["source_id", "identity"])
    rows = attach_preferences(rows, preferences)
    p = F.col("prefs")
    reason = gates.first_reason(
        type=gates.type_mismatch(F.col("employment_type"), p["employment_types"]),
        remote=gates.remote_mismatch(F.col("remote"), p["remote_required"], F.col("location"), p["locations"]),
        title=gates.title_rejected(F.col("title"), p["desired_roles"], title_mode),
    )
    rows = rows.withColumn("reason", F.when(p.isNotNull(), reason))
    gate = F.when(F.col("known_hash").eqNullSafe(F.col("digest")), "unchanged").when(F.col("reason").isNotNull(), "filtered").when(p.isNull(), "kept").otherwise("pending")
    rows = settled(rows.withColumn("_gate", gate).drop("known_hash"))
    told = scorer(rows.filter("_gate = 'pending'"))
    kinds = ("string", "long", "long", "decimal(10,4)", "decimal(10,4)")
    call = F.struct(*((F.col(c) if c in told.columns else F.lit(None)).cast(kind).alias(c) for c, kind in zip(CALL, kinds, strict=True)))
    answers = told.select("source_id", "identity", F.col("status").alias("_status"), F.col("body").alias("_body"), call.alias("call"))
    rows = rows.join(answers, ["source_id", "identity"], "left").withColumn("outcome", parse_outcome(F.col("_body")))
    told = gates.triage(F.col("_status"), F.try_parse_json("_body").isNotNull())
    score = F.col("outcome.score")
    judged = F.when(told != "ok", "unscored").when(score.isNull(), "scoring_failed").when(~gates.above_threshold(score, threshold), "below_threshold").otherwise("kept")
    error = F.when(told == "transient", "scoring is unavailable for now").when(told == "fatal", F.concat(F.lit("scoring is refused: "), gates.status_message(F.col("_body"), F.col("_status"), F.lit(None).cast("string"))))
    pending = F.col("_gate") == "pending"
    return (
        rows.withColumn("status", F.when(pending, judged).otherwise(F.col("_gate"))).withColumn("error", F.when(pending, error))
        .withColumn("match_score", F.when(pending & (F.col("status") == "kept"), score)).drop("_gate", "_status", "_body")
    )


#: Of a call, where the scorer tells: its model, tokens and rates per million tokens.
CALL = ("model", "input_tokens", "output_tokens", "input_rate", "output_rate")


def batch_usage(statuses: DataFrame) -> DataFrame:
    """Usage rows of a batch's scored and kept postings, linked to their source; none where the scorer tells no model."""
    calls = statuses.filter("status = 'kept' AND match_score IS NOT NULL AND call.model IS NOT NULL").select("user_id", "source_id", "call.*")
    return usage_rows(calls, "job_match", "job_source", "source_id")


def _latest(rows: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    """The last row of each key, combined before the shuffle."""
    names = [f"_k{i}" for i in range(len(key))]
    last = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*(k.alias(n) for k, n in zip(key, names, strict=True))).agg(last.alias("_r")).select("_r.*")


def ingest_batch(held: Snapshot, fetched: DataFrame, runs: DataFrame, preferences: DataFrame, scorer: Scorer, now: Column, applications: DataFrame | None = None, threshold: int = 30, title_mode: str = "loose", position: str | None = None) -> tuple[Snapshot, DataFrame]:
    """The new snapshot after a batch, and the statuses of its postings.

    runs: source_id, run (its order), at, error, route, vendor, robots_state; one run a source and batch. Sources that are missing or
    not active are skipped. applications: user_id, dedup_key, of postings that must stay though no job shows them. position: fetched's column
    of a posting's place in its listing; of postings for one job or address the last is stored (without a place, the last by identity and hash), so that
    (source, external id) and (source, url) stay unique. Every kept posting is a view of its own in the merge and has its usage row (batch_usage).
    """
    active = held.sources.filter("status = 'active'").select("source_id")
    runs, fetched = runs.join(active, "source_id", "left_semi"), fetched.join(active, "source_id", "left_semi")
    statuses = settled(ingest_status(fetched, held.jobs.select("source_id", "identity", "hash"), preferences, scorer, threshold, title_mode))
    failed = statuses.filter("error IS NOT NULL").groupBy("source_id").agg(F.min("error").alias("_scoring"))
    runs = settled(runs.join(failed, "source_id", "left").withColumn("error", F.coalesce("error", "_scoring")).drop("_scoring"))
    kept = statuses.filter("status = 'kept'").withColumn("dedup_key", posting_key(F.col("ats_vendor"), F.col("external_id"), F.col("company_name"), F.col("title"), F.col("location")))
    match = F.when(F.col("match_score").isNotNull(), F.col("outcome"))
    kept = kept.withColumn("structured", build_payload([F.col(f) for f in FIELDS], F.col("source_type"), F.col("ats_vendor"), match))
    # a kept posting takes the place of the job with its external id, else of the one with its address
    job = ["source_id", "user_id", "identity", "external_id", "url", "dedup_key", "hash", "structured", "match_score", "source_type", "ats_vendor", "raw_text", "needs_review"]
    rows = kept.withColumn("hash", F.col("digest")).withColumn("needs_review", F.coalesce(F.size("needs_review") > 0, F.lit(False))).withColumn("_at", F.col(position) if position else F.lit(0))
    batch = match_existing(rows.select(*job, "_at"), held.jobs.withColumn("_old", F.col("identity")), ["external_id", "url"], "_old", ["source_id"])
    # of postings that take one job's place, or share an address, the last stays
    order = ["_at", "identity", "hash"]
    batch = _latest(batch, [F.col("source_id"), F.coalesce(F.concat(F.lit("job "), F.col("_old")), F.concat(F.lit("new "), F.coalesce("url", "identity")))], order)
    batch = settled(_latest(batch, [F.col("source_id"), F.coalesce("url", "identity")], order))
    first = held.jobs.select("source_id", F.col("identity").alias("_old"), F.col("first_seen").alias("_first"))
    written = batch.join(first, ["source_id", "_old"], "left").select(*job, F.coalesce("_first", now).alias("first_seen"), now.alias("last_seen"))
    replaced = batch.select("source_id", F.explode(F.array_compact(F.array("_old", "identity"))).alias("identity")).distinct()
    stored = held.jobs.select(*(F.col(c) if c in held.jobs.columns else F.lit(None).cast(dict(written.dtypes)[c]).alias(c) for c in written.columns))
    stored = stored.join(replaced, ["source_id", "identity"], "left_anti").join(written.select("source_id", "url").distinct(), ["source_id", "url"], "left_anti")
    jobs = stored.unionByName(written)
    # what the source no longer lists or no longer matches goes, if its run was complete
    complete = runs.filter("error IS NULL").select("source_id")
    stay = survivors(statuses, ["source_id", "identity"])
    gone = stale_rows(jobs, stay, complete, ["source_id", "identity"], "source_id").select("source_id", "identity")
    jobs = settled(jobs.join(gone, ["source_id", "identity"], "left_anti"))
    views = kept.select(
        "user_id", "dedup_key", "company_name", normalize_company(F.col("company_name")).alias("company_name_normalized"), F.col("title").alias("canonical_title"),
        F.nullif(normalize_text(F.col("location")), F.lit("")).alias("location_normalized"), "structured", "match_score", "source_id", "identity",
    )
    postings = settled(merge_postings(held.postings, views, ["user_id", "dedup_key"], ["source_id", "identity"]))
    # orphans are looked for among the users whose sources had a complete run
    users = held.sources.join(complete, "source_id", "left_semi").select("user_id").distinct()
    mine = postings.join(users, "user_id", "left_semi").withColumn("_key", F.struct("user_id", "dedup_key"))
    children = [(t.select(F.struct("user_id", "dedup_key").alias("_ref")), "_key", "_ref") for t in (jobs, held.elsewhere, applications) if t is not None]
    orphans = orphan_parents(mine, children, F.coalesce(source_type_of(F.col("structured")) == "manual", F.lit(False)))
    postings = postings.join(orphans.select("user_id", "dedup_key"), ["user_id", "dedup_key"], "left_anti")
    sources = record_outcomes(held.sources, runs, ["run"])
    return Snapshot(jobs, postings, sources), statuses
