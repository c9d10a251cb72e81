"""Text helpers: parsing numbers, rendering lines, JSON and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglantern.functions.times import DAY_FIRST_FORMAT, json_time

# --- fixed values -----------------------------------------------------------

# Every character that counts as white space.
BLANKS = (
    "\t\n\v\f\r \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

NOT_AVAILABLE = "N/A"

# Characters that may not stand in a file name.
FILE_NAME_STOPS = r'[<>:"/\\|?*\x00-\x1f]'

# Characters the older JSON output prints as \uXXXX: control, private, unassigned
# and separator characters but the space, and all beyond the BMP.
JSON_ESCAPED = r"[\p{Cc}\p{Co}\p{Cn}\p{Zl}\p{Zp}\p{Zs}\x{10000}-\x{10FFFF}&&[^ ]]"

JSON_FIELDS = {
    "Timestamp": "ts",
    "Level": "level",
    "Message": "message",
    "EventId": "event_code",
    "Source": "source",
}

LABEL_LENGTH = 20
ELLIPSIS = "..."

# ----------------------------------------------------------------------------

WHOLE_NUMBER = r"^\s*[+-]?\d+\s*$"


def trim_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: str | None) -> bool:
    """True for an argument that is missing, empty or white space only."""
    return text is None or not text.strip(BLANKS)


def whole_number(text: Column) -> Column:
    """The INT a text holds, or null; the guard refuses fractions and exponents."""
    return F.when(text.rlike(WHOLE_NUMBER), text.try_cast("int"))


def render_line(
    ts: Column, level: Column, message: Column, event_code: Column, source: Column
) -> Column:
    """``dd.MM.yyyy HH:mm:ss level [code] (source) message`` with fixed separators."""
    return F.concat(
        F.coalesce(F.date_format(ts, DAY_FIRST_FORMAT), F.lit(NOT_AVAILABLE)),
        F.lit(" "),
        F.coalesce(level, F.lit(NOT_AVAILABLE)),
        F.lit(" "),
        F.coalesce(F.concat(F.lit("["), event_code.cast("string"), F.lit("]")), F.lit("")),
        F.lit(" "),
        F.when(source != "", F.concat(F.lit("("), source, F.lit(")"))).otherwise(""),
        F.lit(" "),
        F.coalesce(message, F.lit("")),
    )


def _utf16_escape(char: Column) -> Column:
    return F.regexp_replace(F.hex(F.encode(char, "UTF-16BE")), "(.{4})", r"\\u$1")


def json_string(text: Column) -> Column:
    """A quoted JSON string with relaxed escaping; null gives JSON null.

    ``to_json`` escapes all that ASCII text can need but the delete character;
    only other texts are looked at character by character.
    """
    wrapped = F.to_json(F.struct(text.alias("x")), {"ignoreNullFields": "false"})
    quoted = F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)
    spelled = F.array_join(
        F.transform(
            F.regexp_extract_all(quoted, F.lit("(?s)(.)")),
            lambda c: F.when(c.rlike(JSON_ESCAPED), _utf16_escape(c)).otherwise(c),
        ),
        "",
    )
    unusual = (F.octet_length(text) > F.length(text)) | F.contains(text, F.lit("\x7f"))
    return F.when(unusual & quoted.rlike(JSON_ESCAPED), spelled).otherwise(quoted)


def render_json_object(
    ts: Column,
    level: Column,
    message: Column,
    event_code: Column,
    source: Column,
    newline: str = "\r\n",
    zone: str | None = None,
) -> Column:
    """The indented JSON object of one entry, nulls written."""
    values = {
        "ts": F.coalesce(
            F.concat(F.lit('"'), json_time(ts, zone), F.lit('"')), F.lit("null")
        ),
        "level": json_string(level),
        "message": json_string(message),
        "event_code": F.coalesce(event_code.cast("string"), F.lit("null")),
        "source": json_string(source),
    }
    members = [
        F.concat(F.lit(f'  "{key}": '), values[name]) for key, name in JSON_FIELDS.items()
    ]
    return F.concat(
        F.lit("{" + newline), F.concat_ws("," + newline, *members), F.lit(newline + "}")
    )


def render_json_line(
    ts: Column,
    level: Column,
    message: Column,
    event_code: Column,
    source: Column,
    newline: str = "\r\n",
    zone: str | None = None,
) -> Column:
    """The older ``.json`` output: a text line whose message is the JSON object."""
    body = render_json_object(ts, level, message, event_code, source, newline, zone)
    return render_line(ts, level, body, F.lit(None).cast("int"), F.lit(None).cast("string"))


def json_record(
    ts: Column,
    level: Column,
    message: Column,
    event_code: Column,
    source: Column,
    zone: str | None = None,
) -> Column:
    """One valid JSON object per entry on one line (NDJSON), nulls written."""
    columns = {
        "ts": json_time(ts, zone),
        "level": level,
        "message": message,
        "event_code": event_code,
        "source": source,
    }
    return F.to_json(
        F.struct(*[columns[name].alias(key) for key, name in JSON_FIELDS.items()]),
        {"ignoreNullFields": "false"},
    )


def short_label(text: Column, length: int = LABEL_LENGTH) -> Column:
    """Chart label cut to ``length`` UTF-16 units, the last three of them dots; a
    character of two units is not cut apart but left out."""
    if length <= len(ELLIPSIS):
        raise ValueError(f"length must be over {len(ELLIPSIS)}")
    units = F.encode(text, "UTF-16BE")
    room = 2 * (length - len(ELLIPSIS))
    split = F.hex(F.substring(units, room - 1, 1)).between("D8", "DB")
    cut = F.decode(F.substring(units, 1, room), "UTF-16BE")
    whole = F.decode(F.substring(units, 1, room - 2), "UTF-16BE")
    return F.when(F.octet_length(text) <= length, text).when(
        F.octet_length(units) > 2 * length,
        F.concat(F.when(split, whole).otherwise(cut), F.lit(ELLIPSIS)),
    ).otherwise(text)


def code_label(event_code: Column) -> Column:
    return F.concat(F.lit("ID: "), event_code.cast("string"))


def safe_file_name(text: Column) -> Column:
    return F.regexp_replace(text, FILE_NAME_STOPS, "_")
