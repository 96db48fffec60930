"""As-of lookups and longest prefixes: joins of equal keys only, no task that holds a hot key."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import in_ranges, running


def left_by(rows: DataFrame, other: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """rows joined left with other by equal columns (of rows, of other; the names differ). Rows without a key are spread by all that they hold, where a plain join sends them to one task."""
    lost = reduce(or_, (rows[a].isNull() for a, _ in pairs))
    left = rows.withColumn("_spread", F.when(lost, F.pmod(F.xxhash64(*(rows[c] for c in rows.columns)), F.lit(1 << 20)) + 1).otherwise(0))
    # not a plain 0, which the optimizer would take out of the keys
    right = other.withColumn("_even", F.when(F.col(pairs[0][1]).isNull(), F.lit(-1).cast("long")).otherwise(0))
    same = reduce(and_, (left[a] == right[b] for a, b in pairs), left["_spread"] == right["_even"])
    return left.join(right, same, "left").drop("_spread", "_even")


def last_before(requests: DataFrame, versions: DataFrame, key: str, at: str, since: str, request: str, version: str, ttl_seconds: float | None = None) -> DataFrame:
    """requests with `version`: their key's last version that began at or before them and is at most ttl_seconds older; null if there is none.

    requests: key, at, and an id `request`; versions: key, since, and an id `version`. Both times are timestamps. Of versions of one time the
    largest id counts. A null key or time finds nothing; requests keep their number, repeated ids too. Both sides are sorted together in ranges of
    (key, time) and the last version is a running maximum carried between ranges, so a key with most of the rows is many tasks.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    asked = requests.select(F.col(key).alias("_key"), micros(at).alias("_at"), F.lit(1).alias("_asks"), F.col(request).alias("_id"), F.lit(None).cast(versions.schema[version].dataType).alias("_version")).distinct()
    given = versions.select(F.col(key).alias("_key"), micros(since).alias("_at"), F.lit(0).alias("_asks"), F.lit(None).cast(requests.schema[request].dataType).alias("_id"), F.col(version).alias("_version"))
    merged = asked.unionByName(given.distinct()).filter("_key IS NOT NULL AND _at IS NOT NULL")
    order = ["_at", "_asks", "_version", "_id"]
    found = running(in_ranges(merged, ["_key"], order), ["_key"], order, maxima={"_last": F.when(F.col("_asks") == 0, F.struct("_at", "_version"))}).filter("_asks = 1")
    young = F.lit(True) if ttl_seconds is None else F.col("_at") - F.col("_last._at") <= int(ttl_seconds * 1_000_000)
    found = found.select("_key", "_at", "_id", F.when(young, F.col("_last._version")).alias("_found"))
    same = (requests[key] == found["_key"]) & (micros(at) == found["_at"]) & requests[request].eqNullSafe(found["_id"])
    return requests.join(found, same, "left").select(*(requests[c] for c in requests.columns), F.col("_found").alias(version))


def longest_prefix(rows: DataFrame, rules: DataFrame, key: str, text: str, prefix: str, value: Column, name: str) -> DataFrame:
    """rows with `name`: the value of the longest of the key's prefixes that begins the text, the greatest value on ties; null if none does.

    value is an expression over rules' columns. Empty and null prefixes match nothing, and a null key or text finds nothing. The distinct (key, text) are cut to
    the lengths that the key's prefixes have, and joined with them by (key, hash, prefix): no loop over rules, no list of rules. A key's lengths
    are one row, of at most as many numbers as its longest prefix has characters; rows keep their number.
    """
    known = rules.filter(F.length(prefix) > 0).select(F.col(key).alias("_key"), F.col(prefix).alias("_prefix"), F.xxhash64(prefix).alias("_hash"), value.alias("_value"))
    known = known.groupBy("_key", "_hash", "_prefix").agg(F.max("_value").alias("_value"))
    lengths = known.groupBy("_key").agg(F.collect_set(F.length("_prefix")).alias("_lengths"))
    texts = rows.select(F.col(key).alias("_key"), F.col(text).alias("_text")).dropna().distinct()
    cut = texts.join(lengths, "_key").withColumn("_n", F.explode(F.filter("_lengths", lambda n: n <= F.length("_text"))))
    cut = cut.withColumn("_prefix", F.substring(F.col("_text"), F.lit(1), F.col("_n"))).withColumn("_hash", F.xxhash64("_prefix"))
    best = cut.join(known, ["_key", "_hash", "_prefix"]).groupBy("_key", "_text").agg(F.max(F.struct("_n", "_value")).alias("_best"))
    return left_by(rows, best, [(key, "_key"), (text, "_text")]).select(*rows.columns, F.col("_best._value").alias(name))
