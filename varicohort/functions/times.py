"""Times written in several notations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def instant_us(text: Column) -> Column:
    """Microseconds since 1970 UTC of a time in text.

    ISO dates with ``T`` or a blank, with or without fraction; offsets as ``Z``, ``+02:00`` or ``+0200``; no offset
    means UTC; digits only are seconds since 1970, however many zeros come first. Anything else, null, and seconds
    that do not fit into 64 bits as microseconds give null.
    """
    t = F.trim(text)
    iso = F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2")
    zoned = F.when(iso.rlike(r"(Z|z|[+-]\d{2}:\d{2})$"), F.upper(iso)).otherwise(F.concat(iso, F.lit("Z")))
    dated = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}|$)")
    seconds = F.regexp_replace(t, r"^0+(?=\d)", "").try_cast("bigint")
    digits = F.try_multiply(seconds, F.lit(1_000_000))
    return F.when(t.rlike(r"^\d+$"), digits).when(dated, F.unix_micros(zoned.try_cast("timestamp")))


def naive_us(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ that holds UTC, whatever the session's time zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
