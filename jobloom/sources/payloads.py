"""Landed payloads: vendor boards, JSON-LD in pages, task envelopes, fetched bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.numbers import annual_salary
from ..functions.text import first_nonempty, html_to_text, identity, url_join
from ..operators.clustering import first_by_traversal

POSTING = "external_id string, url string, title string, company_name string, location string, remote boolean, employment_type string, salary_min bigint, salary_max bigint, description string, needs_review array<string>"
NODE = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "company", "location", "employment_type", "url", "external_id", "description", "currency", "unit", "lo", "hi", "single")]))

#: The type of a posting's object, the parts of an address in order.
JOB_TYPE = "JobPosting"
PLACE_PARTS = ("addressLocality", "addressRegion", "addressCountry")

Read = Callable[[], Column]


@dataclass(frozen=True)
class Board:
    """Where a vendor's payload holds what a posting needs: paths inside a job, of several the first that is there.

    remote, pay and employment stand on a job as variant `j`; pay is a struct(lo, hi, unit, currency) of doubles and texts, to be made annual.
    """

    jobs: str
    url: tuple[str, ...]
    title: str
    location: str
    html: str
    plain: str | None = None
    external_id: str = "$.id"
    company: str | None = None
    employment: str | None = None
    remote: Read | None = None
    pay: Read | None = None
    board_url: bool = False


_BOARDS: dict[str, Board] = {}


def register_board(vendor: str, board: Board) -> None:
    """Payloads of the vendor are read as board says; all vendors are read in one scan."""
    _BOARDS[vendor] = board


def normalise_boards(landed: DataFrame) -> DataFrame:
    """All vendors' postings: `source_id`, a posting's columns and `vendor`; payloads of vendors without a board give none.

    landed: source_id, vendor, board_id, body. One scan: a body is parsed once, its vendor's array is exploded, and each column is
    a CASE over vendors, so another vendor is another branch. Broken bodies, and those without the array, give no rows (see bad_payloads).
    """
    if not _BOARDS:
        raise ValueError("no board is registered")

    def by_vendor(of: Callable[[Board], Column | None], kind: str) -> Column:
        cases = [(v, c) for v, b in sorted(_BOARDS.items()) if (c := of(b)) is not None]
        out = F.lit(None).cast(kind)
        for vendor, c in reversed(cases):
            out = F.when(F.col("vendor") == vendor, c.cast(kind)).otherwise(out)
        return out

    text = lambda path: None if path is None else _get(path)
    items = by_vendor(lambda b: F.try_variant_get("_v", b.jobs, "array<variant>"), "array<variant>")
    jobs = landed.filter(F.col("vendor").isin(*_BOARDS)).select("source_id", "vendor", "board_id", F.try_parse_json("body").alias("_v"))
    jobs = jobs.select("source_id", "vendor", "board_id", F.explode(items).alias("j"))
    address = lambda b: F.coalesce(*map(_get, b.url), *([F.concat(F.lit("board:"), F.col("board_id"))] if b.board_url else []))
    company = lambda b: F.col("board_id") if b.company is None else first_nonempty(_get(b.company), F.col("board_id"))
    parts = "struct<lo:double,hi:double,unit:string,currency:string>"
    raw = jobs.select(
        "source_id", "vendor", "board_id", by_vendor(lambda b: text(b.external_id), "string").alias("external_id"), by_vendor(address, "string").alias("url"),
        by_vendor(lambda b: text(b.title), "string").alias("title"), by_vendor(company, "string").alias("company_name"), by_vendor(lambda b: text(b.location), "string").alias("location"),
        by_vendor(lambda b: b.remote and b.remote(), "boolean").alias("_remote"), by_vendor(lambda b: text(b.employment), "string").alias("employment_type"), by_vendor(lambda b: b.pay and b.pay(), parts).alias("_pay"),
        by_vendor(lambda b: text(b.plain), "string").alias("_plain"), by_vendor(lambda b: text(b.html), "string").alias("_html"),
    )
    # a job that says its text plainly needs none of its markup
    plain = F.nullif(F.trim("_plain"), F.lit(""))
    pay = annual_salary(F.col("_pay.lo"), F.col("_pay.hi"), F.lit(None).cast("double"), F.col("_pay.unit"), F.col("_pay.currency"), False, True)
    read = raw.withColumn("_made", html_to_text(F.when(plain.isNull(), F.col("_html")))).withColumn("_year", pay).withColumn("description", F.coalesce(plain, F.col("_made")))
    known = F.col("_year.salary_min").isNotNull() | F.col("_year.salary_max").isNotNull()
    return read.select(
        "source_id", "external_id", "url", _title(F.col("title")).alias("title"), "company_name", "location",
        F.when(F.col("_remote"), F.lit(True)).alias("remote"), "employment_type", F.col("_year.salary_min").alias("salary_min"), F.col("_year.salary_max").alias("salary_max"), "description",
        _review(F.col("description"), known).alias("needs_review"), "vendor",
    )


def bad_payloads(landed: DataFrame) -> DataFrame:
    """Landed rows whose body isn't JSON or lacks the vendor's array of jobs."""
    v = F.try_parse_json("body")
    shape = F.try_variant_get(v, "$.jobs", "variant")
    for vendor, board in sorted(_BOARDS.items()):
        shape = F.when(F.col("vendor") == vendor, F.try_variant_get(v, board.jobs, "variant")).otherwise(shape)
    return landed.filter(~F.coalesce(F.schema_of_variant(shape).startswith("ARRAY"), F.lit(False)))


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("j", path, kind)


def _review(description: Column, salary_known: Column) -> Column:
    return F.array_compact(F.array(F.when(~salary_known, F.lit("salary")), F.when(description == "", F.lit("description"))))


def _title(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("(untitled)"))


def _somewhere_remote() -> Column:
    """Whether the place or any office says so."""
    offices = F.coalesce(_get("$.offices", "array<struct<name:string>>"), F.array().cast("array<struct<name:string>>"))
    places = F.concat(F.array(_get("$.location.name")), F.transform(offices, lambda o: o["name"]))
    return F.exists(places, lambda p: F.coalesce(F.lower(p).contains("remote"), F.lit(False)))


def _first_in_yen() -> Column:
    """Of pay components the first in yen."""
    parts = _get("$.compensation.summaryComponents", "array<struct<currencyCode:string,interval:string,minValue:double,maxValue:double>>")
    yen = F.get(F.filter(parts, lambda c: c["currencyCode"] == "JPY"), 0)
    return F.struct(yen["minValue"].alias("lo"), yen["maxValue"].alias("hi"), yen["interval"].alias("unit"), yen["currencyCode"].alias("currency"))


#: Where the three kinds of boards hold their fields.
register_board("object", Board("$.jobs", ("$.absolute_url",), "$.title", "$.location.name", "$.content", company="$.company_name", remote=_somewhere_remote, board_url=True))
register_board("list", Board("$", ("$.hostedUrl", "$.applyUrl"), "$.text", "$.categories.location", "$.description", "$.descriptionPlain", employment="$.categories.commitment", remote=lambda: _get("$.workplaceType") == "remote"))
register_board("paid", Board("$.jobs", ("$.jobUrl", "$.applyUrl"), "$.title", "$.location", "$.descriptionHtml", "$.descriptionPlain", employment="$.employmentType", remote=lambda: _get("$.isRemote", "boolean"), pay=_first_in_yen))


@pandas_udf(NODE)
def jsonld_nodes(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Job nodes of one page: scripts in document order, lists from the end, objects with @graph opened; broken JSON skipped."""
    import json
    import re

    script = re.compile(r"<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", re.I | re.S)

    def name_of(value):
        """A text, an object's name, or the first of a list that has one."""
        queue = [value]
        while queue:
            v = queue.pop(0)
            if isinstance(v, list):
                queue = v + queue
            elif isinstance(v, dict):
                queue.insert(0, v.get("name"))
            elif isinstance(v, str) and v.strip():
                return v.strip()
        return None

    def address_of(spot):
        address = spot.get("address") if isinstance(spot, dict) else None
        if isinstance(address, dict):
            address = ", ".join(str(address[part]) for part in PLACE_PARTS if address.get(part))
        return address if isinstance(address, str) else ""

    def places(value):
        return "; ".join(dict.fromkeys(filter(None, map(address_of, value if isinstance(value, list) else [value])))) or None

    def amount(value):
        return repr(float(value)) if type(value) in (int, float) else None

    def kinds(value):
        listed = map(str, value) if isinstance(value, list) else [str(value)] if value else []
        return ", ".join(listed) or None

    def as_object(value):
        return value if isinstance(value, dict) else {}

    def posting(thing):
        """A job posting with a title as one record, else None."""
        declared = thing.get("@type")
        title = name_of(thing.get("title"))
        if title is None or JOB_TYPE not in (declared if isinstance(declared, list) else [declared]):
            return None
        pay = as_object(thing.get("baseSalary"))
        value = as_object(pay.get("value"))
        link, description, unit = name_of(thing.get("url")) or name_of(thing.get("@id")), thing.get("description"), value.get("unitText")
        return {
            "title": title, "company": name_of(thing.get("hiringOrganization")), "location": places(thing.get("jobLocation")), "employment_type": kinds(thing.get("employmentType")),
            "url": link, "external_id": name_of(thing.get("identifier")) or link, "description": description if isinstance(description, str) else None, "currency": pay.get("currency"),
            "unit": str(unit).lower() if unit else None, "lo": amount(value.get("minValue")), "hi": amount(value.get("maxValue")), "single": amount(value.get("value")),
        }

    def things(data):
        """All objects, graphs opened after their holder, lists from the end."""
        if isinstance(data, list):
            for item in reversed(data):
                yield from things(item)
        elif isinstance(data, dict):
            yield data
            yield from things(data.get("@graph"))

    def page(html):
        found = []
        for body in script.findall(html or ""):
            try:
                found += filter(None, map(posting, things(json.loads(body))))
            except (ValueError, RecursionError):
                continue
        return found

    for s in pages:
        yield pd.Series([page(h) for h in s], index=s.index)



def extract_job_postings(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Postings in JSON-LD scripts, one row a resolved url of a page: the first in traversal order. Pages without such a script stay out of Python."""
    found = pages.filter(F.col(html).contains("ld+json")).select(key, F.col(url).alias("_base"), F.posexplode(jsonld_nodes(F.col(html))).alias("place", "n"))
    link = F.coalesce(url_join(F.col("_base"), F.col("n.url")), F.col("_base"))
    pay = annual_salary(F.col("n.lo").cast("double"), F.col("n.hi").cast("double"), F.col("n.single").cast("double"), F.col("n.unit"), F.col("n.currency"))
    rows = found.select(
        key, "place", link.alias("url"), F.col("n.title").alias("title"), F.col("n.company").alias("company_name"), F.col("n.location").alias("location"), F.col("n.employment_type").alias("employment_type"),
        identity(F.col("n.external_id"), link).alias("external_id"), html_to_text(F.coalesce(F.col("n.description"), F.lit(""))).alias("description"), pay.alias("pay"),
    )
    return first_by_traversal(rows, [key, "url"], ["place"]).select(key, "url", "title", "company_name", "location", "employment_type", "external_id", "description", F.col("pay.salary_min").alias("salary_min"), F.col("pay.salary_max").alias("salary_max"))


def decode_envelopes(messages: DataFrame, body: str, place: Column, now: Column) -> DataFrame:
    """`task, payload, idempotency_key, enqueued_at` of JSON envelopes; a missing key is unique to the delivery (its place), a missing task gives null."""
    e = F.from_json(body, "task string, payload string, idempotency_key string, enqueued_at timestamp")
    return messages.withColumn("_e", e).select(
        *messages.columns, F.nullif(F.col("_e.task"), F.lit("")).alias("task"), F.coalesce(F.col("_e.payload"), F.lit("{}")).alias("payload"),
        F.coalesce(F.col("_e.idempotency_key"), F.sha2(place.cast("string"), 256)).alias("idempotency_key"), F.coalesce(F.col("_e.enqueued_at"), now).alias("enqueued_at"),
    )


def landed_error(status: Column, size: Column, cap: int) -> Column:
    """Why a fetched page can't be used; null if it can."""
    return F.when(status >= 400, F.concat(F.lit("http "), status.cast("string"))).when(size > cap, F.lit("too large"))


def charset_of(content_type: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(content_type, r"(?i)charset=\"?([A-Za-z0-9_-]+)", 1)), F.lit("")), F.lit("utf-8"))


@pandas_udf(T.StringType())
def decode_bytes(values: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Bytes as text in a named charset, bad bytes replaced; null for an unknown charset."""

    def one(raw, charset):
        try:
            return None if raw is None else bytes(raw).decode(charset, errors="replace")
        except LookupError:
            return None

    for raw, charset in values:
        yield pd.Series([one(r, c) for r, c in zip(raw, charset, strict=True)], index=raw.index)


def decoded(content: Column, content_type: Column) -> Column:
    """A fetched body as text: its charset (default utf-8), bad bytes replaced. Valid utf-8 takes built-ins; the UDF is handed nulls for it."""
    charset = charset_of(content_type)
    text = content.cast("string")
    plain = charset.isin("utf-8", "utf8", "us-ascii") & F.is_valid_utf8(text)
    return F.when(plain, text).otherwise(decode_bytes(F.when(~plain, content), charset))


Decoder = Callable[[bytes], str]
_DECODERS: dict[str, Decoder] = {}


def register_decoder(extension: str, fn: Decoder) -> None:
    """fn turns an uploaded file's bytes into text; errors it raises fail that file alone."""
    _DECODERS[extension.lower()] = fn


register_decoder("txt", lambda raw: raw.decode("utf-8", errors="replace"))
register_decoder("md", lambda raw: raw.decode("utf-8", errors="replace"))


def extract_texts(files: DataFrame, path: str = "path", content: str = "content", shortest: int = 40, cap: int = 60_000) -> DataFrame:
    """`path, status, error, text` of uploaded files (binaryFile rows): decoded by extension, then judged like text_gate."""
    decoders = dict(_DECODERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = [], []
            for name, raw in zip(batch[path], batch[content], strict=True):
                fn, text, error = decoders.get(str(name).rpartition(".")[2].lower()), None, None
                if fn is None:
                    error = "unsupported file"
                else:
                    try:
                        text = fn(bytes(raw) if raw is not None else b"")
                    except Exception as reason:
                        error = f"could not read the file: {reason}"
                texts.append(text)
                errors.append(error)
            yield pd.DataFrame({"path": batch[path], "raw": texts, "failed": errors}).astype(object)

    rows = files.select(path, content).mapInPandas(run, "path string, raw string, failed string")
    clean = F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")
    error = F.coalesce("failed", F.when(F.length(F.coalesce(clean, F.lit(""))) < shortest, F.lit("too little text")))
    return rows.select("path", F.when(error.isNull(), F.lit("structuring")).otherwise("failed").alias("status"), error.alias("error"), F.when(error.isNull(), F.substring(clean, 1, cap)).alias("text"))


def text_gate(name: Column, text: Column, shortest: int = 40, cap: int = 60_000) -> Column:
    """struct(status, error, text) of an uploaded document's text."""
    kind = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    clean = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    error = F.when(~kind.isin("pdf", "docx", "txt", "md"), F.lit("unsupported file")).when(F.length(F.coalesce(clean, F.lit(""))) < shortest, F.lit("too little text"))
    return F.struct(F.when(error.isNull(), F.lit("structuring")).otherwise("failed").alias("status"), error.alias("error"), F.when(error.isNull(), F.substring(clean, 1, cap)).alias("text"))
