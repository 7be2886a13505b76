"""Text expressions: normalisation, tokens, ids, spans. All are columns that stay in the JVM, but for NFKC."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: runs of word characters, joined by single hyphens or slashes.
TOKEN = r"(?U)\b[\w]+(?:[-/][\w]+)*\b"


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility normal form; Spark has no builtin for it."""
    return pd.Series([None if t is None else unicodedata.normalize("NFKC", t) for t in texts], dtype=object)


def squeezed(text: Column) -> Column:
    """Blanks of any kind collapsed to one space, none at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


#: Characters that compatibility normalisation leaves as they are, alone or next to each other.
NORMAL = r"[\x00-\x7F\u00C0-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0400-\u0482\u2013-\u2015\u2018-\u201E\u3001-\u3029\u4E00-\u9FFF\uAC00-\uD7A3]"


def normal(text: Column) -> Column:
    """The text in compatibility normal form. Texts of NORMAL characters alone are in it and don't leave the JVM."""
    return F.coalesce(nfkc(F.when(~text.rlike(f"^{NORMAL}*+$"), text)), text)


def tokens(text: Column) -> Column:
    """Lower-cased tokens of the text in compatibility normal form; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(normal(text)), F.lit(f"({TOKEN})"), F.lit(1)), F.array().cast("array<string>"))


def text_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the squeezed text."""
    return F.substring(F.sha2(squeezed(text), 256), 1, 16)


def short_id(prefix: str, *parts: Column, digits: int = 24) -> Column:
    """prefix and the leading hex digits of the SHA-256 of the parts, joined by NUL."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, digits))


def unit_interval(seed: str, key: Column) -> Column:
    """Number in [0, 1) from the first 8 bytes of SHA-256(seed, unit separator, key)."""
    digits = F.substring(F.sha2(F.concat(F.lit(seed), F.lit("\x1f"), key), 256), 1, 16)
    return F.conv(digits, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def split_name(unit: Column, train: float = 0.9, dev: float = 0.05) -> Column:
    return F.when(unit < train, "train").when(unit < train + dev, "dev").otherwise("test")


def clean_identifier(value: Column) -> Column:
    """Trimmed id; '' for null and for spelled-out nulls; whole numbers lose a '.0'."""
    text = F.trim(F.coalesce(value, F.lit("")))
    known = F.when(F.lower(text).isin("nan", "none", "null", ""), "").otherwise(text)
    return F.regexp_replace(known, r"^(-?\d+)\.0$", "$1")


def title_of(text: Column) -> Column:
    """What stands before the first line feed, trimmed; the whole text if there is none."""
    plain = F.replace(text, F.lit("\r"), F.lit(""))
    cut = F.instr(plain, "\n")
    return F.trim(F.when(cut > 0, F.substring(plain, F.lit(1), cut - 1)).otherwise(plain))


def abstract_of(text: Column) -> Column:
    """What stands after the first line feed, trimmed; '' if there is none."""
    plain = F.replace(text, F.lit("\r"), F.lit(""))
    cut = F.instr(plain, "\n")
    return F.trim(F.when(cut > 0, F.substring(plain, cut + 1, F.length(plain))).otherwise(F.lit("")))


def article_text(title: Column, abstract: Column) -> Column:
    """Title and abstract in one, with a full stop between unless the title closes itself."""
    joint = F.when(title.rlike("[.!?:;]$"), F.lit(" ")).otherwise(F.lit(". "))
    return F.when(title == "", abstract).when(abstract == "", title).otherwise(F.concat(title, joint, abstract))


def duplicate_key(text: Column) -> Column:
    """Key under which two statements are the same: lower case, squeezed, closing marks dropped."""
    return F.regexp_replace(F.lower(squeezed(text)), r"[.?!]+$", "")


def preview(text: Column, limit: int = 240) -> Column:
    """Squeezed text of at most ``limit`` characters, the last an ellipsis if it was cut."""
    plain = squeezed(text)
    return F.when(F.length(plain) <= limit, plain).otherwise(F.concat(F.substring(plain, 1, limit - 1), F.lit("…")))


def exact_spans(text: Column, part: Column) -> Column:
    """Start offsets (from 0) of all occurrences of part, overlapping ones too."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    found = F.filter(starts, lambda i: F.substring(text, i, F.length(part)) == part)
    return F.when(F.length(part) > 0, F.transform(found, lambda i: i - 1)).otherwise(F.array().cast("array<int>"))


def exclusion_reason(kind: Column, section: Column, text: Column) -> Column:
    """Why a sentence can't be evidence, or null if it can."""
    closed = text.rlike("[.!?][\"'’”\\)\\]]*\\s*$")
    return (
        F.when(kind == "title", "title_sentence")
        .when(F.trim(text) == "", "empty_sentence")
        .when((section != "abstract") & ~closed, "unterminated_structured_section_fragment")
    )
