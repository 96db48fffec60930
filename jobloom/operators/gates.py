"""Row gates: preference rules with reasons, the diff gate, routes, validity, addresses and crawl rules."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from ipaddress import ip_network
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NAT64_RANGES, fold_keys, folded_list, normalize_text, role_words
from .asof import last_before, left_by, longest_prefix

#: Words that name a level, and job families that are no engineering, product or data role.
LEVEL_WORDS = ("senior", "junior", "lead", "staff", "principal", "mid", "level", "i", "ii", "iii", "iv")
OTHER_FAMILIES = (
    "sales", "seller", "salesperson", "marketing", "recruiter", "recruiting", "sourcer", "accountant", "accounting",
    "payroll", "bookkeeper", "paralegal", "attorney", "receptionist", "concierge", "barista", "janitor",
)


def scoped(rows: DataFrame, user: str, value) -> DataFrame:
    """A tenant's own rows; tables partitioned by the column are pruned to its folder."""
    return rows.filter(F.col(user) == F.lit(value))


def due(status: Column, last_fetched: Column, interval_hours: Column, now: Column) -> Column:
    """Active and never fetched, or fetched at least its interval ago."""
    return (status == "active") & (last_fetched.isNull() | (F.expr("INTERVAL 1 HOUR") * interval_hours + last_fetched <= now))


def type_mismatch(job_type: Column, wanted: Column) -> Column:
    """Both sides known and no key in common. The job's value is cut at commas and blanks before its parts are folded."""
    own, want = fold_keys(F.split(job_type, r"(?U)[,\s]+")), fold_keys(wanted)
    return F.coalesce((F.size(own) > 0) & (F.size(want) > 0) & ~F.arrays_overlap(own, want), F.lit(False))


def remote_mismatch(remote: Column, required: Column, location: Column, wanted: Column) -> Column:
    """Remote work is required, the job says it is not remote, and no wanted place (folded) is in its location."""
    place = normalize_text(location)
    # the place rides along with each wanted one: a lambda must not call the folding UDF itself
    pairs = F.arrays_zip(fold_keys(wanted).alias("w"), F.array_repeat(place, F.size(fold_keys(wanted))).alias("p"))
    near = F.exists(pairs, lambda x: (x["w"] != "") & F.coalesce(x["p"].contains(x["w"]), F.lit(False)))
    return F.coalesce(required & (remote == F.lit(False)) & ~F.coalesce(near, F.lit(False)), F.lit(False))


def title_role_match(title: Column, roles: Column, n: int = 4) -> Column:
    """Some word of the title equals a word of a wanted role (3 letters and more), or shares its first n letters where both have n."""
    own = role_words(title, LEVEL_WORDS)
    want = role_words(F.array_join(folded_list(roles), " "), LEVEL_WORDS, 3)
    heads = lambda words: F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.substring(w, 1, n))
    return F.arrays_overlap(own, want) | F.arrays_overlap(heads(own), heads(want))


def title_rejected(title: Column, roles: Column, mode: str, families: tuple[str, ...] = OTHER_FAMILIES) -> Column:
    """off: never; strict: without a match; loose: without a match and with a word of another family. Without roles: never."""
    if mode == "off":
        return F.lit(False)
    miss = (F.size(F.coalesce(roles, F.array().cast("array<string>"))) > 0) & ~F.coalesce(title_role_match(title, roles), F.lit(False))
    if mode == "loose":
        miss = miss & F.arrays_overlap(role_words(title, LEVEL_WORDS), F.array(*(F.lit(f) for f in families)))
    return F.coalesce(miss, F.lit(False))


def first_reason(**rules: Column) -> Column:
    """Name of the first rule that fails; null for none."""
    return F.coalesce(*(F.when(failed, F.lit(name)) for name, failed in rules.items()), F.lit(None).cast("string"))


def attach_known_hash(now: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """now with the stored hash of its identity as known_hash; known has keys and hash, one row an identity."""
    return now.join(known.select(*keys, F.col("hash").alias("known_hash")), keys, "left")


def diff_status(hash: Column, known_hash: Column) -> Column:
    return F.when(known_hash.isNull(), "new").when(hash == known_hash, "unchanged").otherwise("changed")


def classify_route(url: Column, patterns: list[tuple[str, str]], reserved: tuple[str, ...], page: Column | None = None, embeds: list[tuple[str, str]] = ()) -> Column:
    """struct(vendor, board): the first pattern whose group names a board that isn't reserved; addresses come before embeds in the page."""

    def hit(subject: Column, vendor: str, pattern: str) -> Column:
        board = F.regexp_extract(subject, pattern, 1)
        return F.when((board != "") & ~board.isin(*reserved), F.struct(F.lit(vendor).alias("vendor"), board.alias("board")))

    place = F.concat(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    found = [hit(place, v, p) for v, p in patterns]
    if page is not None:
        found += [hit(page, v, p) for v, p in embeds]
    return F.coalesce(*found)


def url_allowed(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & (F.try_parse_url(url, F.lit("HOST")) != ""), F.lit(False))


#: IPv4 ranges that are not public (first address, prefix length).
CLOSED_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once a row however often then names it."""
    return F.get(F.transform(F.array(value), lambda x: then(x)), F.lit(0))


def v4_number(ip: Column) -> Column:
    """A dotted quad as a number; null for anything else."""
    parts = F.transform(F.split(ip, r"\."), lambda p: p.try_cast("long"))
    number = lambda p: F.when(F.array_max(p) <= 255, sum((p[i] * (1 << 8 * (3 - i)) for i in range(1, 4)), p[0] * (1 << 24)))
    return F.when(ip.rlike(r"\A\d{1,3}(\.\d{1,3}){3}\z"), _once(parts, number))


#: Addresses inside the ranges above that are public all the same; IPv6 ranges that are not public, and public parts of them.
OPEN_V4 = ("192.0.0.9/32", "192.0.0.10/32")
CLOSED_V6 = ("::/3", "2001::/23", "2001:db8::/32", "2002::/16", "4000::/2", "8000::/1")
OPEN_V6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28", "fec0::/10")


def _closed_number(n: Column) -> Column:
    within = lambda net: n.between(int(net.network_address), int(net.broadcast_address))
    closed = [within(ip_network(f"{first}/{bits}")) for first, bits in CLOSED_V4]
    return reduce(or_, closed) & ~reduce(or_, (within(ip_network(r)) for r in OPEN_V4))


def blocked_v4(ip: Column) -> Column:
    return F.coalesce(_once(v4_number(ip), _closed_number), F.lit(False))


def v6_digits(ip: Column) -> Column:
    """A literal IPv6 address, with or without a zone, as its 32 lower-case hexadecimal digits, which sort as addresses do; null for anything else.

    What is named more than once is computed once (`_once`): a lambda's body shares nothing by itself.
    """
    # digits alone: lower() goes by all of Unicode
    small = lambda x: F.translate(x, "ABCDEF", "abcdef")
    quad = lambda x: F.regexp_extract(x, r":([0-9]+(?:\.[0-9]+){3})\z", 1)
    halves = lambda d: F.concat(F.substring(d, 1, 4), F.lit(":"), F.substring(d, 5, 4))

    def whole(x: Column) -> Column:
        """x with a dotted end as two groups; without one that is an address, null."""
        last = lambda q: F.when(q == "", x).otherwise(F.concat(F.regexp_extract(x, r"\A(.*:)[^:]*\z", 1), _once(small(F.lpad(F.hex(_plain_v4(q)), 8, "0")), halves)))
        return F.when(x.contains("."), _once(quad(x), last)).otherwise(x)

    def groups(x: Column) -> Column:
        return F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(":"), F.lit(""))) + 1)

    def read(x: Column) -> Column:
        run = "(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)"
        listed = F.trim(F.replace(x, F.lit("::"), F.lit(":")), F.lit(":"))

        def padded(r: Column) -> Column:
            """r: all groups, how many they are, and how many stand before the gap."""
            digits = F.when(r["all"] == "", "").otherwise(F.array_join(F.transform(F.split(r["all"], ":"), lambda g: F.lpad(g, 4, "0")), ""))
            filled = lambda d: F.concat(F.substring(d, F.lit(1), r["left"] * 4), F.repeat(F.lit("0"), 32 - 4 * r["n"]), F.substring(d, r["left"] * 4 + 1, F.lit(32)))
            return F.when(F.when(x.contains("::"), r["n"] <= 7).otherwise(r["n"] == 8), _once(digits, filled))

        counted = _once(listed, lambda z: F.struct(z.alias("all"), groups(z).alias("n"), groups(F.substring_index(x, "::", 1)).alias("left")))
        return F.when((x != "") & x.rlike(rf"\A{run}?(?:::{run}?)?\z"), _once(counted, padded))

    bare = small(F.when(ip.contains("%"), F.regexp_replace(ip, r"\A([^%]*)%[^%]+\z", "$1")).otherwise(ip))
    # no address is longer than this, so long texts don't meet the pattern
    return _once(bare, lambda x: F.when(F.length(x) <= 45, _once(whole(x), read)))


def _plain_v4(ip: Column) -> Column:
    """v4_number without leading zeros."""
    return F.when(~ip.rlike(r"(\A|\.)0[0-9]"), v4_number(ip))


def closed_address(ip: Column) -> Column:
    """Whether a literal IPv4 or IPv6 address isn't public; null if it is no address. Addresses that hold an IPv4 one (mapped, translated) are judged by that.

    Expressions only: ranges are compared as digits of one length, so no row leaves the JVM.
    """
    ends = lambda r: tuple(f"{int(x):032x}" for x in (ip_network(r).network_address, ip_network(r).broadcast_address))

    def judge(d: Column) -> Column:
        among = lambda ranges: reduce(or_, (d.between(*map(F.lit, ends(r))) for r in ranges))
        inner = F.conv(F.substring(d, 25, 8), 16, 10).cast("long")
        return F.when(among(("::ffff:0:0/96", *NAT64_RANGES)), _once(inner, _closed_number)).otherwise(among(CLOSED_V6) & ~among(OPEN_V6))

    return F.when(ip.contains(":"), _once(v6_digits(ip), judge)).otherwise(_once(_plain_v4(ip), _closed_number))


def failed_rules(**rules: Column) -> Column:
    """Names of the rules that a row breaks; unknown counts as broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))


def triage(status: Column, has_block: Column) -> Column:
    """What to do with a scorer's answer: try again later, give up, or go on."""
    return (
        F.when(status.isNull() | (status == 429) | (status >= 500), "transient").when(status >= 400, "fatal").when(~F.coalesce(has_block, F.lit(False)), "transient").otherwise("ok")
    )


def status_message(body: Column, status: Column, fallback: Column) -> Column:
    """A refused call's own message: the body's error.message, else the client's text, else the status."""
    told = F.try_variant_get(F.try_parse_json(body), "$.error.message", "string")
    return F.coalesce(F.nullif(told, F.lit("")), F.nullif(fallback, F.lit("")), F.concat(F.lit("HTTP "), status.cast("string")))


def above_threshold(score: Column, threshold: int = 30) -> Column:
    """Whether a scored posting stays; one without a score isn't judged."""
    return score.isNull() | (score >= threshold)


def unexpired(rows: DataFrame, expires: str, now: Column) -> DataFrame:
    """Rows whose end is still to come; one that ends now has ended."""
    return rows.filter(F.col(expires) > now)


def owned_key(key: Column, user: Column, prefix: str = "resumes") -> Column:
    """Whether a stored object lies under its user's own prefix; null keys and users own nothing."""
    return F.coalesce(key.startswith(F.concat(F.lit(f"{prefix}/"), user, F.lit("/"))), F.lit(False))


def upload_error(key: Column, user: Column, size: Column, content_type: Column, cap: int, allowed: tuple[str, ...]) -> Column:
    """Why an upload isn't taken: another's key, no object, too large, a kind that isn't allowed; null if it is."""
    return (
        F.when(~owned_key(key, user), F.lit("not found")).when(size.isNull(), F.lit("not uploaded")).when(size > cap, F.lit("too large"))
        .when(~F.coalesce(content_type.isin(*allowed), F.lit(False)), F.lit("unsupported type"))
    )


#: What a row must meet, by kind of row. Each takes the row's columns by name.
LONGEST = {"company_name": 300, "title": 300, "location": 300, "employment_type": 60, "description": 20_000, "apply_url": 2000}
STATES = {
    "source_type": ("ats", "json_ld", "llm"), "source_status": ("active", "paused", "error"), "robots_state": ("allowed", "disallowed", "unknown"),
    "posting_status": ("new", "interested", "not_interested", "archived"),
    "application_status": ("applied", "screening", "first_interview", "final_interview", "offer", "rejected", "withdrawn"),
    "event_kind": ("status_change", "note", "interview", "reminder"), "version_source": ("upload", "form", "llm_extract", "tailored"),
    "version_status": ("pending", "extracting", "structuring", "ready", "failed"), "analysis_kind": ("gap_analysis", "resume_tailoring"),
    "analysis_status": ("pending", "running", "succeeded", "failed"),
}


def _unset_or(c: Column, rule: Column) -> Column:
    return c.isNull() | rule


def _salary_rules() -> dict[str, Column]:
    lo, hi = F.col("salary_min"), F.col("salary_max")
    return {"salary_min": _unset_or(lo, lo >= 0), "salary_max": _unset_or(hi, hi >= 0), "salary_order": lo.isNull() | hi.isNull() | (lo <= hi)}


def posting_rules() -> dict[str, Column]:
    """A posting typed in by hand: names given, lengths, pay."""
    within = {f"{n}_length": _unset_or(F.col(n), F.length(n) <= most) for n, most in LONGEST.items()}
    return {"company_name": F.length("company_name") >= 1, "title": F.length("title") >= 1, **within, **_salary_rules()}


def source_rules() -> dict[str, Column]:
    """A registered page: web address, label, hours between fetches."""
    hours = F.coalesce(F.col("fetch_interval_hours"), F.lit(24))
    return {"url": url_allowed(F.trim(F.col("url"))), "url_length": F.length("url") <= 2000, "label_length": _unset_or(F.col("label"), F.length("label") <= 200), "interval": hours.between(1, 168)}


def preference_rules() -> dict[str, Column]:
    return _salary_rules()


def document_rules() -> dict[str, Column]:
    """A document comes either as an uploaded object or as text of some length."""
    has_key, has_text = (F.coalesce(F.col(c) != "", F.lit(False)) for c in ("source_key", "raw_text"))
    return {"one_source": has_key != has_text, "text_length": _unset_or(F.col("raw_text"), F.length(F.trim("raw_text")) >= 40)}


def outcome_rules() -> dict[str, Column]:
    return {"score": F.col("score").between(0, 100)}


def code_rules() -> dict[str, Column]:
    return {"code": F.col("code").rlike(r"^\d{6}$")}


def state_rule(column: str, kind: str) -> Column:
    """Membership of a set of states."""
    return F.col(column).isin(*STATES[kind])


def quarantined(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): bad rows with `broken`, the names of the rules they break."""
    judged = rows.withColumn("broken", failed_rules(**rules))
    return judged.filter(F.size("broken") == 0).drop("broken"), judged.filter(F.size("broken") > 0)


def crawl_state(status: Column) -> Column:
    """What a host's rules file says by its status: 404 allows all, other failures and no answer leave it unknown, and allow."""
    return F.when(status.isNull(), "unknown").when(status == 404, "allowed").when(status >= 400, "unknown").otherwise("allowed")


def parsed_rules(files: DataFrame, agent: str, host: str = "host", body: str = "body") -> DataFrame:
    """`host, prefix, allow, crawl_delay` for an agent from rules files: its own groups, else those of "*".

    A group is a run of user-agent lines and the lines behind it up to the next such run. One row a rule; a group's delay
    stands on a row with a null prefix. A host's file is numbered line by line inside the host.
    """
    line = F.trim(F.regexp_replace(F.col("line"), "#.*$", ""))
    lines = files.select(host, F.posexplode(F.split(F.col(body), r"\r\n|\r|\n")).alias("at", "line"))
    lines = lines.select(host, "at", F.lower(F.trim(F.substring_index(line, ":", 1))).alias("field"), F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1)).alias("value"))
    lines = lines.filter(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    w = Window.partitionBy(host).orderBy("at")
    names = F.col("field") == "user-agent"
    starts = names & F.coalesce(F.lag("field").over(w) != "user-agent", F.lit(True))
    lines = lines.withColumn("_g", F.sum(starts.cast("int")).over(w)).filter("_g > 0")
    mine = F.lit(agent.lower()).contains(F.lower(F.col("value"))) & (F.col("value") != "")
    groups = lines.filter(names).groupBy(host, "_g").agg(F.max(mine).alias("own"), F.max(F.col("value") == "*").alias("any")).filter("own OR any")
    best = groups.groupBy(host).agg(F.max("own").alias("some"))
    chosen = groups.join(best, host).filter("own = some").select(host, "_g")
    rules = lines.filter(~names).join(chosen, [host, "_g"])
    delay = F.col("field") == "crawl-delay"
    return rules.filter(delay | (F.col("value") != "")).select(host, F.when(~delay, F.col("value")).alias("prefix"), F.when(~delay, F.col("field") == "allow").alias("allow"), F.when(delay, F.col("value").try_cast("double")).alias("crawl_delay"))


def crawl_decision(urls: DataFrame, rules: DataFrame, url: str = "url", host: str = "host", path: str = "path", hosts: DataFrame | None = None) -> DataFrame:
    """urls with `decision`: the longest rule of the host that begins the path, allowing ones first on ties; without a rule: allowed.

    rules: host, prefix, allow, and crawl_delay if known; they may be many, for paths meet them by equal prefixes. With hosts
    (host, status of its rules file, null if it gave none; one row a host) `robots_state` and `crawl_delay` (the longest) come too, and
    rules count only where the file was read.
    """
    own = urls.columns
    if hosts is not None:
        rules = rules.join(hosts.filter("status < 400").select(host), host, "left_semi")
    out = longest_prefix(urls, rules, host, path, "prefix", F.col("allow"), "_allow")
    out = out.withColumn("decision", F.when(F.coalesce("_allow", F.lit(True)), "allowed").otherwise("disallowed"))
    if hosts is None:
        return out.select(*own, "decision")
    delays = rules.groupBy(host).agg(F.max("crawl_delay").alias("crawl_delay")) if "crawl_delay" in rules.columns else rules.select(host, F.lit(None).cast("double").alias("crawl_delay")).distinct()
    known = hosts.select(host, "status").join(delays, host, "left").select(F.col(host).alias("_host"), F.col("status").alias("_status"), "crawl_delay")
    return left_by(out, known, [(host, "_host")]).withColumn("robots_state", crawl_state(F.col("_status"))).select(*own, "decision", "robots_state", "crawl_delay")


def crawl_decision_as_of(requests: DataFrame, files: DataFrame, agent: str, ttl_seconds: float = 86_400, host: str = "host", path: str = "path", at: str = "at", request: str = "request_id") -> DataFrame:
    """requests with `file_id, decision, robots_state, crawl_delay` by the rules that their host had when they were made.

    requests: request_id, host, path, at. files, the fetches of rules files: file_id, host, fetched_at, status (null: no answer), body. A request is judged by
    its host's last fetch that is at most ttl_seconds older; without one the state is unknown, and it is allowed. Requests keep their number.
    """
    dated = last_before(requests, files, host, at, "fetched_at", request, "file_id", ttl_seconds)
    read = files.select("file_id", "status", "body").dropDuplicates(["file_id"])
    rules = parsed_rules(read.filter("status < 400"), agent, host="file_id")
    return crawl_decision(dated, rules, host="file_id", path=path, hosts=read.select("file_id", "status"))


def route_sources(sources: DataFrame, patterns: list[tuple[str, str]], embeds: list[tuple[str, str]], reserved: tuple[str, ...], known_vendors: tuple[str, ...]) -> DataFrame:
    """sources with `route, vendor, board, robots_state, error, needs_manual`: the first way that gives postings.

    sources: url; api_failed (its vendor's board could not be read; null: it could); robots (allowed, disallowed, unknown
    or null), page_status (null: no answer), fetch_error, page_url (after redirects), page (its html), has_jsonld. The
    address itself comes first and needs no robots step; then robots; then the page; then an embed in it; then JSON-LD;
    else someone has to add the postings by hand.
    """
    vendor_of = lambda c: F.when(c["vendor"].isin(*known_vendors), c)
    direct = vendor_of(classify_route(F.col("url"), patterns, reserved))
    direct = F.when(~F.coalesce(F.col("api_failed"), F.lit(False)), direct)
    embedded = vendor_of(classify_route(F.coalesce("page_url", "url"), patterns, reserved, F.col("page"), embeds))
    embedded = F.when(~F.coalesce(F.col("api_failed"), F.lit(False)), embedded)
    banned = F.coalesce(F.col("robots") == "disallowed", F.lit(False))
    unread = F.col("fetch_error").isNotNull() | F.col("page_status").isNull()
    bad = F.col("page_status") >= 400
    step = (
        F.when(direct.isNotNull(), "direct").when(banned, "banned").when(unread, "unread").when(bad, "bad")
        .when(embedded.isNotNull(), "embedded").when(F.coalesce(F.col("has_jsonld"), F.lit(False)), "json_ld").otherwise("none")
    )
    out = sources.withColumn("_step", step).withColumn("_hit", F.when(F.col("_step") == "direct", direct).when(F.col("_step") == "embedded", embedded))
    is_step = lambda *names: F.col("_step").isin(*names)
    return (
        out.withColumn("route", F.when(is_step("direct", "embedded"), "ats").when(is_step("json_ld"), "json_ld"))
        .withColumn("vendor", F.col("_hit.vendor")).withColumn("board", F.col("_hit.board"))
        .withColumn("robots_state", F.when(is_step("direct"), "unknown").otherwise(F.coalesce("robots", F.lit("unknown"))))
        .withColumn(
            "error",
            F.when(is_step("banned"), "robots.txt disallows this URL").when(is_step("unread"), F.concat(F.lit("could not fetch the page: "), F.coalesce("fetch_error", F.lit("no answer"))))
            .when(is_step("bad"), F.concat(F.lit("the page returned HTTP "), F.col("page_status").cast("string"))).when(is_step("none"), "no job listings found"),
        )
        .withColumn("needs_manual", is_step("banned", "none")).drop("_step", "_hit")
    )


def fresh_rules(rules: DataFrame, now: Column, ttl_seconds: int, host: str = "host", fetched: str = "fetched_at") -> DataFrame:
    """Latest rules of each host that aren't older than the time to live, at one moment; `crawl_decision_as_of` takes each request's own."""
    young = rules.filter((F.col(fetched) <= now) & (F.unix_micros(now) - F.unix_micros(F.col(fetched)) <= ttl_seconds * 1_000_000))
    last = Window.partitionBy(host).orderBy(F.desc(fetched))
    return young.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")
