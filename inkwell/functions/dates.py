"""Dates as column expressions: stored as text in UTC with whole seconds, unknown forms as they came."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import strip

STORED = "yyyy-MM-dd'T'HH:mm:ssxxx"
_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?(?:[+-]\d{2}:\d{2})?|T\d{2}:\d{2})?$"
_MAIL = r"^(?:[A-Za-z]{3},\s*)?(\d{1,2}) ([A-Za-z]{3}) (\d{4}) (\d{2}:\d{2})(:\d{2})? ([+-]\d{4}|GMT|UTC?|Z)(?:\s*\(.*\))?$"


def stored(ts: Column) -> Column:
    return F.date_format(ts, STORED)


def timestamp(c: Column) -> Column:
    """The time of a feed's date (mail form or ISO form, no zone meaning UTC); null for other forms."""
    text = strip(c)
    part = lambda i: F.regexp_extract(text, _MAIL, i)
    zone = F.when(part(6).rlike("^[+-]"), part(6)).otherwise(F.lit("+0000"))
    mail = F.try_to_timestamp(F.concat_ws(" ", F.lpad(part(1), 2, "0"), F.initcap(part(2)), part(3), F.concat(part(4), F.when(part(5) == "", F.lit(":00")).otherwise(part(5))), zone), F.lit("dd MMM yyyy HH:mm:ss xx"))
    iso = F.regexp_replace(text, "Z", "+00:00")
    return F.coalesce(F.when(text.rlike(_MAIL), mail), F.when(iso.rlike(_ISO), iso.try_cast("timestamp")))


def published_at(c: Column) -> Column:
    text = strip(F.coalesce(c, F.lit("")))
    return F.coalesce(stored(timestamp(text)), text)


def normalized(c: Column, year: Column | None = None) -> Column:
    """A provider's date: a bare year is its first day, an unknown form is cut to 64 characters, nothing is null."""
    text = strip(F.coalesce(c, F.lit("")))
    text = text if year is None else F.when((text == "") & year.isNotNull(), year.cast("string")).otherwise(text)
    iso = F.regexp_replace(text, "Z", "+00:00")
    known = F.when(iso.rlike(_ISO) & ~iso.rlike(r"T\d{2}:\d{2}$"), stored(iso.try_cast("timestamp")))
    return F.when(text == "", F.lit(None).cast("string")).when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01T00:00:00+00:00"))).otherwise(F.coalesce(known, F.substring(text, 1, 64)))


def relative(day: Column, today: Column) -> Column:
    n = F.datediff(today, day)
    return F.when(n <= 0, F.lit("Today")).when(n == 1, F.lit("Yesterday")).when(n < 7, F.concat(n.cast("string"), F.lit(" days ago"))).otherwise(F.date_format(day, "yyyy-MM-dd"))
