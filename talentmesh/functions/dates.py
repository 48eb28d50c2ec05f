"""Date text of mixed formats to timestamps; expiry rules."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentmesh.functions.text import strip

ISO_PATTERN = (
    r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?)?"
    r"(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$"
)
ISO_COMPACT_PATTERN = r"^\d{8}$"
MAIL_PATTERN = (
    r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})\s+([A-Za-z]{3})[A-Za-z]*\s+(\d{4})\s+"
    r"(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([+-]\d{4}|[A-Za-z]{1,4})?.*$"
)


def as_literal(now: datetime | str) -> Column:
    """The clock is always a parameter; text is taken as UTC."""
    text = now if isinstance(now, str) else now.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp")


def _iso(raw: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(raw, ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2")
    hour_only = F.regexp_replace(clean, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(Z|[+-]\d{2}(?::\d{2})?)?$",
                                 "$1:00$2")
    full = F.regexp_replace(hour_only, r"(T|\s)(\d{2}:\d{2}.*?)([+-]\d{2})$", "$1$2$3:00")
    dated = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), raw).otherwise(full)
    return F.when(raw.rlike(ISO_PATTERN), dated.try_cast("timestamp")).when(
        raw.rlike(ISO_COMPACT_PATTERN), F.try_to_timestamp(raw, F.lit("yyyyMMdd"))
    )


def _mail(raw: Column) -> Column:
    part = lambda i: F.regexp_extract(raw, MAIL_PATTERN, i)
    zone = F.when(part(7).rlike(r"^[+-]\d{4}$"), part(7)).otherwise(
        F.coalesce(
            F.try_element_at(
                # fixed values: named zones of the mail date format
                F.create_map(*[F.lit(x) for kv in {
                    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
                    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
                }.items() for x in kv]),
                F.upper(part(7)),
            ),
            F.lit("+0000"),
        )
    )
    text = F.concat_ws(
        " ",
        F.lpad(part(1), 2, "0"),
        F.initcap(part(2)),
        part(3),
        F.concat_ws(":", F.lpad(part(4), 2, "0"), part(5),
                    F.coalesce(F.nullif(part(6), F.lit("")), F.lit("00"))),
        zone,
    )
    return F.when(
        raw.rlike(MAIL_PATTERN), F.try_to_timestamp(text, F.lit("dd MMM yyyy HH:mm:ss xx"))
    )


def posted_at(c: Column) -> Column:
    """ISO or mail-style date text to a UTC instant; anything else is null."""
    raw = strip(c)
    return F.coalesce(_iso(raw), _mail(raw))


def listed_at(c: Column) -> Column:
    """The listing sort's reading: ISO, ``Tue Jan 02 2024`` or ``02 Jan 2024``."""
    raw = strip(c)
    no_day = F.regexp_extract(raw, r"^[A-Za-z]{3} ([A-Za-z]{3} \d{1,2} \d{4})$", 1)
    return F.coalesce(
        _iso(raw),
        F.when(no_day != "", F.try_to_timestamp(no_day, F.lit("MMM d yyyy"))),
        F.when(raw.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4}$"),
               F.try_to_timestamp(raw, F.lit("d MMM yyyy"))),
    )


def epoch_to_iso(c: Column) -> Column:
    """Epoch seconds to ISO text, '' when absent."""
    stamp = F.timestamp_seconds(c.try_cast("long"))
    return F.coalesce(
        F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")), F.lit("")
    )


def offer_expired(valid_through: Column, now: Column) -> Column:
    """A date means the end of that day; unreadable text never expires a posting."""
    raw = strip(valid_through)
    until = _iso(raw)
    until = F.when(raw.contains("T"), until).otherwise(
        F.date_trunc("day", until) + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")
    )
    return F.coalesce(until < now, F.lit(False))


def feed_expired(value: Column, now: Column, offset: str = "+05:30") -> Column:
    """A bare date (or midnight) lasts through that local day; a time is an instant."""
    raw = strip(value)
    zoned = raw.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$") & raw.rlike(r"[T ]")
    stamp = _iso(raw)
    local_day = F.to_date(F.from_utc_timestamp(now, offset))
    at_midnight = ~zoned & (F.date_format(stamp, "HH:mm:ss.SSSSSS") == "00:00:00.000000")
    expired = (
        F.when(at_midnight, F.to_date(stamp) < local_day)
        .when(~zoned, F.to_utc_timestamp(stamp, offset) < now)
        .otherwise(stamp < now)
    )
    return F.coalesce(expired, F.lit(False))
