"""Scalar normalisers and bucket functions as column expressions, all inside code generation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StringType

# Texts that mean null.
NULL_WORDS = ("", "nan", "none", "null")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_words(c: Column | str) -> Column:
    """Null for the words that mean null, else the value as it is."""
    c = col(c)
    return F.when(~F.lower(F.trim(c)).isin(*NULL_WORDS), c)


def normalise(c: Column | str) -> Column:
    """Trimmed, lower-cased text; the null words are null."""
    return null_words(F.lower(F.trim(col(c))))


def digits(c: Column | str) -> Column:
    """ASCII digits only; null if there are none."""
    return F.nullif(F.regexp_replace(col(c), r"\D+", ""), F.lit(""))


def phone(c: Column | str) -> Column:
    """Digits; a national 11-digit number that begins with 8 begins with 7."""
    d = digits(c)
    return F.when((F.length(d) == 11) & d.startswith("8"), F.concat(F.lit("7"), F.substring(d, 2, 10))).otherwise(d)


def collapse_spaces(c: Column | str) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.trim(col(c))), r"\s+", " "), F.lit(""))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column | str) -> Column:
    """Compatibility composition. Spark has none, so texts with other than ASCII take an Arrow UDF; for ASCII it sees null."""
    plain = F.octet_length(col(c)) == F.char_length(col(c))
    return collapse_spaces(F.coalesce(F.when(plain, col(c)), _nfkc(F.when(~plain, col(c)))))


def date_ymd(c: Column | str) -> Column:
    return F.date_format(F.try_to_timestamp(col(c).cast("string")), "yyyy-MM-dd")


def sex(c: Column | str) -> Column:
    v = normalise(c)
    return F.when(v != "unknown", v)


def email_domain(c: Column | str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(col(c), r"@([^@]+)$", 1), F.lit("")), F.lit("missing_domain"))


def email_domain_last(c: Column | str) -> Column:
    """What follows the last @, the whole text if there is none."""
    return F.element_at(F.split(col(c), "@"), -1)


def email_domain_second(c: Column | str) -> Column:
    """What stands between the first and the second @; null if there is none."""
    return F.get(F.split(col(c), "@"), F.lit(1))


def email_local(c: Column | str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(col(c), r"^([^@]+)", 1), F.lit("")), F.lit("missing_local"))


def initial(c: Column | str, n: int) -> Column:
    return F.coalesce(F.nullif(F.substring(col(c), 1, n), F.lit("")), F.lit("missing"))


def hash_bucket(c: Column | str, n: int) -> Column:
    """First 32 bits of the MD5 modulo n, as text; null counts as empty."""
    head = F.substring(F.md5(F.coalesce(col(c), F.lit("")).cast("binary")), 1, 8)
    return (F.conv(head, 16, 10).cast("long") % n).cast("string")


def prefix6(c: Column | str) -> Column:
    return F.when(F.length(col(c)) >= 6, F.substring(col(c), 1, 6))


def _whole(c: Column) -> Column:
    return c.cast("string").try_cast("double").try_cast("int")


def daypart(c: Column | str) -> Column:
    """Part of the day of an hour given as text; null outside 0 to 23."""
    h = _whole(col(c))
    return (
        F.when(h.between(0, 5), "sleep_00_05").when(h.between(6, 10), "morning_06_10")
        .when(h.between(11, 17), "work_11_17").when(h.between(18, 23), "evening_18_23")
    )


def weekpart(c: Column | str) -> Column:
    d = _whole(col(c))
    return F.when(d.isin(5, 6), "weekend").when(d.between(0, 4), "weekday")


def registration_buckets(c: Column | str) -> Column:
    """The half-hour bucket of a time and the two before it, as text: times up to an hour apart share one."""
    half = F.floor(F.unix_timestamp(col(c).cast("timestamp")) / 1800) * 1800
    return F.transform(F.array(*[F.lit(k) for k in (0, 1800, 3600)]), lambda k: F.date_format(F.timestamp_seconds(half - k), "yyyy-MM-dd HH:mm"))


def rule_family(c: Column | str) -> Column:
    parts = F.split(col(c), "__")
    return F.when((F.size(parts) > 2) & (parts[0] == "rule"), parts[1]).otherwise("unknown")


def phone_area(c: Column | str) -> Column:
    """First three digits of a phone."""
    return F.nullif(F.substring(F.regexp_replace(col(c), r"\D", ""), 1, 3), F.lit(""))


def value_to_text(c: Column | str, kind: T.DataType) -> Column:
    """Any value as text, null kept: nested ones as JSON, scalars as they print."""
    nested = isinstance(kind, (T.ArrayType, T.MapType, T.StructType))
    return F.to_json(col(c)) if nested else col(c).cast("string")


def same_text(a: Column | str, b: Column | str) -> Column:
    """Equality in which null and empty are the same."""
    return F.coalesce(col(a), F.lit("")) == F.coalesce(col(b), F.lit(""))


def number_gap(a: Column | str, b: Column | str) -> Column:
    """Absolute difference, -1 where either is missing."""
    return F.coalesce(F.abs(col(a) - col(b)), F.lit(-1))


def finite_or(c: Column | str, fill: float) -> Column:
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")) | c.isNull(), F.lit(fill)).otherwise(c)


def thousands(n: float) -> str:
    return f"{int(round(n)):,}".replace(",", " ")


def percent(x: float | None) -> str:
    return "-" if x is None else f"{100 * x:.1f}%"
