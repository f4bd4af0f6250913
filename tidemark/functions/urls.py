"""URL, calendar-slot and key expressions over capture URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The archive's capture prefix, the characters a stored file name may not hold, the
# error codes that end all attempts, the code of a cached hit, and the URL form of each page type in
# the order in which they are tried.
ARCHIVE_PREFIX = "https://web.archive.org/web/"
UNSAFE_FILE_CHARS = r'[\\/*?:"<>|&=]'
FATAL_CODES = (3, 4, 5)
CACHED_CODE = 7
ERROR_NAMES = {
    0: "success",
    1: "timeout",
    2: "connection",
    3: "http",
    4: "ssl",
    5: "generic",
    6: "retries_exhausted",
    7: "cached",
}
PAGE_TYPE_PATTERNS = (
    ("moderators", r"^https?://(www\.|old\.)?reddit\.com/r/[^/?#]+/about/moderators/?$"),
    ("wiki", r"^https?://(www\.)?reddit\.com/r/[^/?#]+/wiki/index/?$"),
    ("homepage", r"^https?://(www\.)?reddit\.com/r/[^/?#]+/?$"),
    ("homepage_old", r"^https?://(old\.)?reddit\.com/r/[^/?#]+/?$"),
)


def url_from_template(template: Column, name: Column) -> Column:
    return F.replace(template, F.lit("{}"), name)


def capture_url(ts14: Column, original: Column) -> Column:
    return F.concat(F.lit(ARCHIVE_PREFIX), ts14, F.lit("/"), original)


def _stamp(url: Column) -> Column:
    return F.try_element_at(F.split(url, "/"), F.lit(5))


def _to_int(text: Column) -> Column:
    return text.try_cast("int")


def capture_year(url: Column) -> Column:
    return _to_int(F.substring(_stamp(url), 1, 4))


def capture_month(url: Column) -> Column:
    return _to_int(F.substring(_stamp(url), 5, 2))


def half_year(month: Column) -> Column:
    """1 for months 1..6, 2 for any other number, null for an unreadable month."""
    return F.when(month.between(1, 6), 1).when(month.isNotNull(), 2).cast("int")


def half_label(month: Column) -> Column:
    return F.concat(F.lit("S"), half_year(month).cast("string"))


def in_month_range(month: Column, first: int, last: int) -> Column:
    return F.coalesce((month != 0) & month.between(first, last), F.lit(False))


def original_url(url: Column) -> Column:
    shape = r"(?s)/web/[^/]*/(.*)"
    return F.when(url.rlike(shape), F.regexp_extract(url, shape, 1))


def url_path(url: Column) -> Column:
    """The path part, read leniently: no scheme, host, query, fragment or last-segment parameters."""
    text = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    text = F.regexp_replace(text, r"^[a-zA-Z][a-zA-Z0-9+.\-]*:", "")
    text = F.regexp_replace(text, r"^//[^/?#]*", "")
    return F.regexp_replace(F.regexp_replace(text, r"[?#][\s\S]*$", ""), r";[^/]*$", "")


def community_from_path(url: Column) -> Column:
    """Lower-cased path segment after the first segment ``r``; ``unknown`` when there is none."""
    path, shape = F.lower(url_path(url)), r"(?:^|/)r/([^/]*)"
    return F.when(path.rlike(shape), F.regexp_extract(path, shape, 1)).otherwise(F.lit("unknown"))


def community_from_text(url: Column) -> Column:
    """Text after the first ``/r/``, case kept; null when there is none."""
    return F.nullif(F.regexp_extract(url, r"/r/([^/]+)", 1), F.lit(""))


def sanitize_key(url: Column) -> Column:
    return F.regexp_replace(url, UNSAFE_FILE_CHARS, "_")


def storage_prefix(community: Column) -> Column:
    return F.when(community == "", F.lit("unk")).otherwise(F.substring(community, 1, 3))


def file_path(url: Column) -> Column:
    return F.concat(
        storage_prefix(community_from_path(url)), F.lit("/"), sanitize_key(url), F.lit(".html")
    )


def _json_string(text: Column) -> Column:
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), text, F.lit('"'))


def cache_key(url: Column, params: Column | None = None) -> Column:
    """md5 of the URL followed by its parameters as JSON with sorted keys (ASCII parameters)."""
    if params is None:
        return F.md5(F.concat(url, F.lit("{}")))
    entries = F.array_sort(F.map_entries(params))
    pairs = F.transform(
        entries, lambda e: F.concat(_json_string(e["key"]), F.lit(": "), _json_string(e["value"]))
    )
    return F.md5(F.concat(url, F.lit("{"), F.array_join(pairs, ", "), F.lit("}")))


def page_type(original: Column) -> Column:
    chain = None
    for name, pattern in PAGE_TYPE_PATTERNS:
        test = original.rlike(pattern)
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain


def redirect_ok(requested: Column, final: Column) -> Column:
    """A redirect may change the month, but neither the half-year nor the year."""
    same_half = half_year(capture_month(requested)) == half_year(capture_month(final))
    same_year = capture_year(requested) == capture_year(final)
    return (requested == final) | F.coalesce(same_half & same_year, F.lit(False))


def is_fatal(code: Column) -> Column:
    return code.isin(*FATAL_CODES)


def error_class(code: Column) -> Column:
    return (
        F.when(code == 0, "success")
        .when(code == CACHED_CODE, "cached")
        .when(is_fatal(code), "fatal")
        .otherwise("retryable")
    )


def error_name(code: Column) -> Column:
    chain = None
    for number, name in ERROR_NAMES.items():
        test = code == number
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain
