"""Times: provider text, buckets, labels and session names."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglantern.schema import MISSING_TIME, ntz

# --- fixed values -----------------------------------------------------------

# yyyyMMddHHmmss.ffffff and the offset from UTC in minutes; *** for no offset.
PROVIDER_TIME = r"^\d{14}\.\d{6}[+-](\d{3}|\*{3})$"

DAY_FIRST_FORMAT = "dd.MM.yyyy HH:mm:ss"
DAY_LABEL_FORMAT = "dd MMM"
HOUR_LABEL_FORMAT = "HH:mm"
JSON_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSS"
STAMP_FORMAT = "yyyyMMdd_HHmmss"

# Year, month and day, then perhaps a time, then perhaps Z or an offset.
JSON_TIME = r"^(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)?)(Z|[+-]\d{2}:\d{2})?$"
MONTH_FIRST_TIME = r"^(\d{2})/(\d{2})/(\d{4})( \d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)?$"

TIME_RANGES = {
    "Last hour": timedelta(hours=1),
    "Last 24 hours": timedelta(days=1),
    "Last 3 days": timedelta(days=3),
    "Last 7 days": timedelta(days=7),
}

# ----------------------------------------------------------------------------

HOUR = timedelta(hours=1)
DAY = timedelta(days=1)


def time_range(name: str) -> timedelta:
    if name not in TIME_RANGES:
        raise ValueError(f"unknown time range {name!r}; known: {', '.join(TIME_RANGES)}")
    return TIME_RANGES[name]


def interval(span: timedelta) -> Column:
    """A day-time interval literal."""
    whole = span.days * 86400 + span.seconds
    return F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.lit(f"{whole}.{span.microseconds:06d}").cast("decimal(18,6)")
    )


def to_zone(ts: Column, source: str, target: str) -> Column:
    """Wall clock of ``source`` to wall clock of ``target``."""
    return ts if source == target else F.convert_timezone(F.lit(source), F.lit(target), ts)


def utc_now() -> Column:
    """Current UTC wall clock; in a stream the time recorded for the batch.

    Built from the instant, so it does not run backwards when clocks are set back.
    """
    micros = F.unix_micros(F.current_timestamp()).cast("decimal(20,0)") / 1_000_000
    return ntz(datetime(1970, 1, 1)) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), micros.cast("decimal(18,6)"))


def local_now(zone: str | None = None) -> Column:
    """Current wall clock of ``zone``, by default of the session."""
    return F.localtimestamp() if zone is None else to_zone(utc_now(), "UTC", zone)


def parse_provider_time(text: Column, zone: str = "UTC") -> Column:
    """Provider time text to the wall clock of ``zone``; unreadable gives the year 1."""

    def part(start: int, length: int) -> Column:
        return F.substring(text, start, length)

    wall = F.concat(
        part(1, 4), F.lit("-"), part(5, 2), F.lit("-"), part(7, 2), F.lit(" "),
        part(9, 2), F.lit(":"), part(11, 2), F.lit(":"), part(13, 9),
    ).try_cast("timestamp_ntz")
    minutes = part(22, 4).try_cast("int")
    parsed = F.timestamp_add("MINUTE", F.coalesce(-minutes, F.lit(0)), wall)
    if zone != "UTC":
        parsed = F.when(minutes.isNull(), wall).otherwise(to_zone(parsed, "UTC", zone))
    return F.coalesce(F.when(text.rlike(PROVIDER_TIME), parsed), ntz(MISSING_TIME))


def cut_to_second(ts: datetime) -> datetime:
    return ts.replace(microsecond=0)


def check_width(width: timedelta) -> timedelta:
    if width < timedelta(minutes=1):
        raise ValueError("a bucket must be at least one minute wide")
    return width


def day_start(ts: Column) -> Column:
    return ts.cast("date").cast("timestamp_ntz")


def hour_start(ts: Column) -> Column:
    """Start of the hour, null for null: unlike ``time_bucket`` it drops no row."""
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.minute(ts), F.extract(F.lit("SECOND"), ts))


def time_bucket(ts: Column, width: timedelta = HOUR, aligned: bool = False) -> Column:
    """Start of the bucket of ``ts``.

    A width of a day or more gives days, of an hour or more hours, and below that
    whole minutes counted from the start of each hour. ``aligned`` gives buckets
    of the true width instead. A null ``ts`` drops the row.
    """
    check_width(width)
    step = width // timedelta(minutes=1)
    if not aligned:
        if width >= DAY:
            width = DAY
        elif width >= HOUR or 60 % step:
            width = HOUR
        else:
            width = timedelta(minutes=step)
    start = F.window(ts, f"{width // timedelta(microseconds=1)} microseconds").getField("start")
    if aligned or step >= 60 or 60 % step == 0:
        return start
    minute = F.minute(ts)
    return start + F.make_dt_interval(F.lit(0), F.lit(0), minute - minute % step)


def bucket_label(time: Column, width: timedelta = HOUR) -> Column:
    return F.date_format(time, DAY_LABEL_FORMAT if width >= DAY else HOUR_LABEL_FORMAT)


def json_time(ts: Column, zone: str | None = None) -> Column:
    """Round-trip time text with seven digits; ``zone`` adds that zone's offset."""
    text = F.date_format(ts, JSON_TIME_FORMAT)
    if zone is None:
        return text
    ahead = (ts - to_zone(ts, zone, "UTC")).cast("interval minute").cast("int")
    size = F.abs(ahead)
    return F.concat(
        text,
        F.when(ahead < 0, "-").otherwise("+"),
        F.lpad(F.floor(size / 60).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((size % 60).cast("string"), 2, "0"),
    )


def parse_json_time(text: Column, zone: str = "UTC") -> Column:
    """Wall clock of a JSON time text, or null when it is none.

    A text without an offset is a wall clock as it stands; ``Z`` or an offset makes it
    an instant, shown on the clock of ``zone``. A date alone is midnight; a year or a
    month alone is no time, and of month/day/year forms the time is optional too.
    """
    parts = F.regexp_extract(text, JSON_TIME, 1)
    wall = parts.try_cast("timestamp_ntz")
    offset = F.regexp_extract(text, JSON_TIME, 2)
    ahead = F.when(offset == "Z", 0).otherwise(
        (F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, -2, 2).cast("int"))
        * F.when(F.startswith(offset, F.lit("-")), -1).otherwise(1)
    )
    instant = to_zone(F.timestamp_add("MINUTE", -ahead, wall), "UTC", zone)
    slashed = F.regexp_replace(text, MONTH_FIRST_TIME, "$3-$1-$2$4").try_cast("timestamp_ntz")
    return (
        F.when(text.rlike(JSON_TIME), F.when(offset == "", wall).otherwise(instant))
        .when(text.rlike(MONTH_FIRST_TIME), slashed)
    )


def wall_seconds(ts: Column) -> Column:
    """Wall clock as seconds since 1970 with six decimals, free of any time zone."""
    return (ts - ntz(datetime(1970, 1, 1))).cast("interval second").cast("decimal(18,6)")


def event_time(ts: Column) -> Column:
    """TIMESTAMP that shows the same clock in UTC; watermarks need this type."""
    return F.timestamp_seconds(wall_seconds(ts))


def session_name(started: Column, channel: Column) -> Column:
    """``Session_<UTC start>_<channel>``."""
    return F.concat(
        F.lit("Session_"), F.date_format(started, STAMP_FORMAT), F.lit("_"), channel
    )
