"""Column functions for names, keys, HTML fragments and small lists."""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StringType

#: Company forms that say nothing about identity, written in Japanese (anywhere) and Latin (at the end).
JAPANESE_FORMS = ("株式会社", "有限会社", "合同会社", "合資会社", "合名会社", "(株)", "（株）")
LATIN_FORMS = ("inc", "incorporated", "llc", "ltd", "limited", "co", "corp", "corporation", "gmbh", "kk", "pllc", "plc")
#: A posting's fields that count as its content.
CONTENT_FIELDS = ("title", "company_name", "location", "remote", "employment_type", "salary_min", "salary_max", "description")
#: Closing tags that end a line, IPv6 ranges whose last 32 bits are an IPv4 address, telling key parts.
BLOCK_TAGS = "p|div|li|ul|ol|h[1-6]|br|tr|table|section"
NAT64_RANGES = ("64:ff9b::/96", "64:ff9b:1::/48")
SECRET_MARKERS = ("password", "code", "otp", "token", "session", "authorization", "cookie", "secret")


@pandas_udf(StringType())
def fold_unicode(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC and case folding, which no built-in offers."""
    import unicodedata

    for s in values:
        yield s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


@pandas_udf(StringType())
def unescape_html(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Character references, for texts with other than the common ones."""
    import html

    for s in values:
        yield s.map(lambda v: None if v is None else html.unescape(v))


@pandas_udf(StringType())
def keyed_hash(values: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """HMAC-SHA-256 of a value under a secret, in hexadecimal."""
    import hashlib
    import hmac

    for s, secret in values:
        yield pd.Series([None if v is None or k is None else hmac.new(k.encode(), v.encode(), hashlib.sha256).hexdigest() for v, k in zip(s, secret, strict=True)], index=s.index)


@pandas_udf(StringType())
def join_url(values: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Relative references that are neither absolute nor root-relative."""
    from urllib.parse import urljoin

    def one(base, link):
        try:
            return urljoin(base, link)
        except ValueError:
            return None

    for base, link in values:
        yield pd.Series([None if b is None or x is None else one(b, x) for b, x in zip(base, link, strict=True)], index=base.index)


@pandas_udf(BooleanType())
def blocked_v6(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether a literal IPv6 address, unwrapped from v4-mapped and NAT64 forms, isn't public; null if it is no address."""
    import ipaddress

    translated = tuple(map(ipaddress.ip_network, NAT64_RANGES))
    shared = ipaddress.ip_network("100.64.0.0/10")

    def one(v):
        try:
            a = ipaddress.ip_address(v)
        except (ValueError, TypeError):
            return None
        if a.version == 6 and a.ipv4_mapped:
            a = a.ipv4_mapped
        elif a.version == 6 and any(a in net for net in translated):
            a = ipaddress.ip_address(int(a) & 0xFFFFFFFF)
        return bool(a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved or a.is_unspecified or (a.version == 4 and a in shared))

    for s in values:
        yield s.map(one).astype("boolean")


#: Characters that NFKC leaves as they are and whose lower case, but for ß, is their case folding: ASCII, Latin-1 letters, common marks.
_PLAIN = r"^[\x00-\x7F\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF\u0152\u0153\u0160\u0161\u017D\u017E\u0178\u2013\u2014\u2018\u2019\u201C\u201D\u20AC]*$"
#: Stands between the values of a list while it is folded as one text; no text holds it.
_BETWEEN = "\u0001"


def folded(c: Column) -> Column:
    """NFKC and case folding. Plain texts take built-ins; the UDF is handed nulls for them, so they cost it nothing."""
    plain = c.rlike(_PLAIN)
    return F.when(plain, F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))).otherwise(fold_unicode(F.when(~plain, c)))


def folded_list(values: Column) -> Column:
    """folded for each value of an array that isn't blank; a null array is empty."""
    some = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.coalesce(F.regexp_replace(v, r"(?U)\s", "") != "", F.lit(False)))
    return F.when(F.size(some) > 0, F.split(folded(F.array_join(some, _BETWEEN)), _BETWEEN)).otherwise(F.array().cast("array<string>"))


def normalize_text(c: Column) -> Column:
    """Compatibility form, case folded, white space single and trimmed."""
    return F.trim(F.regexp_replace(folded(c), r"(?U)\s+", " "))


def normalize_company(c: Column) -> Column:
    """A company's name without its legal form: Japanese forms anywhere, Latin ones as long as any ends the name."""
    out = normalize_text(c)
    for form in JAPANESE_FORMS:
        out = F.replace(out, F.lit(form), F.lit(""))
    out = F.regexp_replace(F.trim(out), r"(?iU)(?:[\s,]*\b(?:" + "|".join(LATIN_FORMS) + r")\b\.?\s*)+$", "")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def dedup_key(company: Column, title: Column, location: Column) -> Column:
    parts = (normalize_company(company), normalize_text(title), normalize_text(location))
    return F.sha2(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)), 256)


def posting_key(vendor: Column, external_id: Column, company: Column, title: Column, location: Column) -> Column:
    """A vendor's own id where both vendor and id are known, else the key of names, under which postings of several boards meet."""
    known = (F.coalesce(vendor, F.lit("")) != "") & (F.coalesce(external_id, F.lit("")) != "")
    return F.when(known, F.concat_ws(":", vendor, external_id)).otherwise(dedup_key(company, title, location))


def posting_content(posting: Column) -> Column:
    """What makes a posting's content, as JSON with its nulls: eight fields and two sorted skill lists; the apply link and review marks stay out."""
    lists = (F.array_sort(F.coalesce(posting[n], F.array().cast("array<string>"))).alias(n) for n in ("required_skills", "preferred_skills"))
    return F.to_json(F.struct(*(posting[n].alias(n) for n in CONTENT_FIELDS), *lists), {"ignoreNullFields": "false"})


def posting_hash(posting: Column) -> Column:
    return F.sha2(posting_content(posting), 256)


def content_hash(content: Column) -> Column:
    """Hash of a struct with its nulls kept: equal structs and only those are equal."""
    return F.sha2(F.to_json(content, {"ignoreNullFields": "false"}), 256)


def identity(external_id: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(external_id, F.lit("")), url)


def first_nonempty(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for v in values), F.lit(""))


#: References that built-ins decode, the sign that begins them last.
COMMON_REFERENCES = ("lt", "gt", "quot", "copy", "middot", "nbsp", "amp")


def html_to_text(c: Column, references: tuple[str, ...] | None = None) -> Column:
    """Breaks and block ends as newlines, tags gone, then references decoded; lines trimmed at their ends, two newlines at most; "" for null.

    references: names of the only ones to decode, in that order and where they end in a semicolon; None: all that HTML has, also cut ones ("&amp{").
    Texts with common references only take built-ins; the UDF is handed nulls for them.
    """
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, rf"(?i)</(?:{BLOCK_TAGS})\s*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    plain = t
    for name in references or COMMON_REFERENCES:
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(unescape(f"&{name};")))
    simple = ~F.regexp_replace(t, rf"&(?:{'|'.join(COMMON_REFERENCES)});", "").contains("&") & ~t.rlike(r"&amp;[#a-zA-Z]")
    t = plain if references else F.when(simple, plain).otherwise(unescape_html(F.when(~simple, t)))
    t = F.regexp_replace(t, r"[ \t ]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def url_join(base: Column, link: Column) -> Column:
    """A link seen from base: absolute ones as they are, root-relative ones on base's host, others by the general rule."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    absolute, rooted = link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), link.rlike(r"^/[^/]") | (link == "/")
    return F.when(absolute, link).when(rooted, F.concat(root, link)).otherwise(join_url(base, F.when(~absolute & ~rooted, link)))


def _without_separators(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[\s_-]", "")


def fold_key(c: Column) -> Column:
    """A value folded, without blanks, underlines and hyphens."""
    return _without_separators(folded(c))


def fold_keys(values: Column) -> Column:
    """Keys of an array's values that aren't blank; a null array is empty."""
    return F.transform(folded_list(values), _without_separators)


def split_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def role_words(c: Column, noise: tuple[str, ...], shortest: int = 1) -> Column:
    """Distinct words of Latin letters and digits, at least that long, without words that name a level."""
    words = F.array_distinct(F.regexp_extract_all(folded(c), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.filter(F.array_except(words, F.array(*(F.lit(w) for w in noise))), lambda w: F.length(w) >= shortest)


def join_distinct(values: Column, sep: str = "; ") -> Column:
    return F.nullif(F.array_join(F.array_distinct(values), sep), F.lit(""))


def to_month(c: Column) -> Column:
    """YYYY-MM from YYYY-M and longer; else empty, also for null."""
    c = F.trim(F.coalesce(c, F.lit("")))
    year, month = F.regexp_extract(c, r"^(\d{4})-(\d{1,2})", 1), F.regexp_extract(c, r"^(\d{4})-(\d{1,2})", 2)
    return F.when(year != "", F.concat(year, F.lit("-"), F.lpad(month, 2, "0"))).otherwise("")


def null_if_blank(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def form_companies(companies: Column) -> Column:
    """A document's companies as a form takes them: periods as months, missing arrays empty."""
    empty = F.array().cast("array<string>")
    each = lambda c: c.withField("period_start", to_month(c["period_start"])).withField("period_end", to_month(c["period_end"])).withField("achievements", F.coalesce(c["achievements"], empty))
    return F.transform(F.coalesce(companies, F.array()), each)


def payload_companies(companies: Column) -> Column:
    """The same as it is stored: blank periods are unknown."""
    each = lambda c: c.withField("period_start", F.nullif(c["period_start"], F.lit(""))).withField("period_end", F.nullif(c["period_end"], F.lit("")))
    return F.transform(companies, each)


def hash_token(c: Column) -> Column:
    return F.sha2(c, 256)


def normalize_email(c: Column) -> Column:
    return F.lower(F.trim(c))


def hash_email(c: Column, secret: Column) -> Column:
    return keyed_hash(normalize_email(c), secret)


def mask_email(c: Column) -> Column:
    """First character of the name and all behind the first @ of an address; other texts as they are."""
    at = F.instr(c, "@")
    return F.when(at > 0, F.concat(F.substring(F.substring_index(c, "@", 1), 1, 1), F.lit("***@"), F.substr(c, at + 1))).otherwise(c)


def redact_map(m: Column, markers: tuple[str, ...] = SECRET_MARKERS) -> Column:
    """Values under telling keys hidden; addresses under the keys email and ip masked."""
    return F.transform_values(
        m, lambda k, v: F.when(F.lower(k).rlike("|".join(markers)), F.lit("***")).when(F.lower(k).isin("email", "ip"), mask_email(v)).otherwise(v)
    )


def first_forwarded(c: Column) -> Column:
    return F.trim(F.split(c, ",")[0])


def register_functions(spark) -> None:
    """The helpers that no built-in offers, by name for SQL."""
    for name, fn in (("fold_unicode", fold_unicode), ("unescape_html", unescape_html), ("keyed_hash", keyed_hash), ("join_url", join_url), ("blocked_v6", blocked_v6)):
        spark.udf.register(name, fn)
