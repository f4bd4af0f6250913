"""Text cleaning, tokens, n-grams and small parsers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when text is stripped, and as line ends
# when text is split into lines (Unicode definitions).
SPACE_CODES = (
    *range(0x09, 0x0E),
    *range(0x1C, 0x21),
    0x85,
    0xA0,
    0x1680,
    *range(0x2000, 0x200B),
    0x2028,
    0x2029,
    0x202F,
    0x205F,
    0x3000,
)
SPACE_CHARS = "".join(map(chr, SPACE_CODES))
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\x{2028}\x{2029}]"
# A word is two or more letters, digits or underscores, in any script.
WORD = r"[\p{L}\p{N}_]{2,}"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def _bare(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    # The two patterns.
    out = F.regexp_replace(out, r"(?U)http\S+", "")
    return F.regexp_replace(out, r"(?U)[^a-z0-9\s]+", "")


def clean_text(text: Column) -> Column:
    """Lower case; links, then everything but a-z, 0-9 and white space removed; stripped."""
    return strip(_bare(text))


def clean_words(text: Column) -> Column:
    """``words`` of the cleaned text, which has no other letters than a-z."""
    return F.regexp_extract_all(_bare(text), F.lit("[a-z0-9]{2,}"), F.lit(0))


def label_encode(label: Column) -> Column:
    name = strip(label)
    return F.when(name == "rule", 1).when(name == "non-rule", 0).cast("int")


def digits_or_null(text: Column) -> Column:
    """Number of a text that holds digits only, else null."""
    bare = strip(text)
    return F.when(bare.rlike("^[0-9]+$"), bare.try_cast("bigint"))


def int_or_null(text: Column) -> Column:
    """Lenient integer: sign and surrounding white space allowed, else null."""
    bare = strip(text)
    return F.when(bare.rlike("^[+-]?[0-9]+$"), bare.try_cast("bigint"))


def rule_text(title: Column, description: Column | None = None) -> Column:
    """Text that is scored for a rule: title, then description after one space."""
    if description is None:
        return strip(title)
    return strip(F.concat(title, F.lit(" "), F.coalesce(description, F.lit(""))))


def dashed(title: Column, description: Column) -> Column:
    return F.when(F.coalesce(description, F.lit("")) != "", F.concat_ws(" - ", title, description)).otherwise(
        title
    )


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def bigrams(tokens: Column) -> Column:
    n = F.size(tokens)
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<string>"))


def hash_bucket(key: Column, seed: int, buckets: int = 100) -> Column:
    """Bucket 0..buckets-1 from the key alone, so a split survives repartitioning and retries."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets).cast("int")
