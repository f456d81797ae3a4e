"""Column functions over identifiers, events, timestamps and ratios. An empty text and null are alike: no value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CONNECT, DISCONNECT = "connect", "disconnect"


def stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pick_first(*values: Column) -> Column:
    """The first value that is not blank, stripped."""
    return F.try_element_at(F.filter(F.transform(F.array(*values), stripped), lambda v: v != ""), F.lit(1))


def _paired(twelve: Column) -> Column:
    return F.regexp_replace(twelve, "(..)(?=.)", "$1:")


def normalise_mac(value: Column) -> Column:
    form = lambda c: F.when(c == "", F.lit(None)).when((F.length(c) == 12) & ~c.contains(":"), _paired(c)).otherwise(c)
    return let(stripped(value), lambda v: F.when(v != "", let(F.lower(F.translate(v, "-. ", ":")), form)))


def looks_like_mac(value: Column) -> Column:
    c = F.lower(F.translate(stripped(value), "-.", ":"))
    return F.coalesce(c.rlike("^(([0-9a-f]{2}:){5}[0-9a-f]{2}|[0-9a-f]{12})$"), F.lit(False))


def normalise_id(value: Column) -> Column:
    """Lower case and stripped; twelve hex digits once dots and blanks are out become a colon MAC, unless dashes or colons were in."""
    form = lambda v: F.when(v.isin("", "nan"), F.lit("")).otherwise(let(F.translate(v, "-. ", ":"), lambda c: F.when(c.rlike("^[0-9a-f]{12}$"), _paired(c)).otherwise(v)))
    return let(F.lower(stripped(F.coalesce(value.cast("string"), F.lit("")))), form)


def normalise_event(value: Column) -> Column:
    form = lambda v: F.when(v.isin(CONNECT, "1", "+1"), F.lit(CONNECT)).when(v.isin(DISCONNECT, "-1"), F.lit(DISCONNECT)).otherwise(F.lit(""))
    return let(F.lower(stripped(F.coalesce(value.cast("string"), F.lit("")))), form)


def compact(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]", "")


def partial_match(predicted: Column, truth: Column) -> Column:
    """Both present, and one holds the other, as normalised or with letters and digits alone."""
    return fits(normalise_id(predicted), normalise_id(truth))


def fits(predicted: Column, truth: Column) -> Column:
    """partial_match of normalised ids."""

    def held(x: Column) -> Column:
        p, t, pc, tc = (x[k] for k in ("p", "t", "pc", "tc"))
        return (p != "") & (t != "") & (p.contains(t) | t.contains(p) | ((pc != "") & (tc != "") & (pc.contains(tc) | tc.contains(pc))))

    both = let(F.struct(predicted.alias("p"), truth.alias("t")), lambda x: F.struct(x["p"].alias("p"), x["t"].alias("t"), compact(x["p"]).alias("pc"), compact(x["t"]).alias("tc")))
    return let(both, held)


def safe_div(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return F.when((precision > 0) & (recall > 0), 2.0 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


#: Tried in turn where a timestamp is text.
TIME_PATTERNS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/M/d H:m:s", "M/d/yyyy H:m:s", "d MMM yyyy H:m:s", "MMM d yyyy H:m:s", "yyyyMMdd HHmmss"]


def parse_time(value: Column) -> Column:
    """ISO first, then the patterns above; null where none fits."""
    return F.coalesce(value.try_cast("timestamp"), *[F.try_to_timestamp(value, F.lit(p)) for p in TIME_PATTERNS])


def normalise_time(value: Column) -> Column:
    """Second precision text in UTC (the session's zone), '' where there is none."""
    return F.coalesce(F.date_format(parse_time(value.cast("string")), "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def iso_time(ts: Column) -> Column:
    """As ISO text, microseconds only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def merge_time(year=None, month=None, date=None, time=None, minute=None, second=None, ampm=None, timestamp=None) -> Column:
    """A timestamp from its parts; a whole timestamp wins."""
    none = F.lit(None).cast("string")
    y, m, d, t, mi, s, a = (none if x is None else x for x in (year, month, date, time, minute, second, ampm))
    clock = F.when(mi.isNotNull() & s.isNull(), F.concat(t, F.lit(":"), mi)).when(s.isNotNull() & ~t.contains(":"), F.concat(t, F.lit(":"), s)).otherwise(t)
    text = F.trim(F.concat_ws(" ", F.nullif(F.concat_ws("-", y, m, d), F.lit("")), clock, a))
    parsed = F.coalesce(parse_time(text), F.try_to_timestamp(text, F.lit("yyyy-M-d h:m:s a")), F.try_to_timestamp(text, F.lit("yyyy-M-d H:m")))
    return parsed if timestamp is None else F.when(timestamp.isNotNull() & (timestamp != ""), parse_time(timestamp)).otherwise(parsed)


def naive_utc(ts: Column, zone: str = "UTC") -> Column:
    """Wall time of a zone as UTC without a zone."""
    return F.to_utc_timestamp(ts, zone).cast("timestamp_ntz")


def token_estimate(*texts: Column) -> Column:
    """About the tokens of chat messages: 4, and one for each four characters of role and content."""
    return sum((F.ceil(F.length(F.coalesce(t, F.lit(""))) / 4) for t in texts), F.lit(4))
