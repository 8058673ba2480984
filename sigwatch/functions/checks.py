"""Validity tests and tolerant conversions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Seconds of the years 1 to 9999, the range a calendar date can hold.
_FIRST_SECOND, _LAST_SECOND = -62135596800, 253402300799

# Formats always accepted, whatever format the caller names, each with the shape of its
# texts: a failed parse is dear, a pattern test is not.
_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
_TIME = r"[0-9]{2}:[0-9]{2}:[0-9]{2}"
TIME_FORMATS = [
    ("yyyy-MM-dd HH:mm:ss", rf"{_DAY} {_TIME}\z"),
    ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", rf"{_DAY}T{_TIME}\.[0-9]{{1,6}}(?:Z|[+-][0-9]{{2}}:[0-9]{{2}})\z"),
    ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSxx", rf"{_DAY}T{_TIME}\.[0-9]{{1,6}}[+-][0-9]{{4}}\z"),
    ("yyyy-MM-dd'T'HH:mm:ssX", rf"{_DAY}T{_TIME}Z\z"),
]
# Stand-ins for a free parse.
EXTRA_TIME_FORMATS = [
    ("yyyy-MM-dd'T'HH:mm:ss", rf"{_DAY}T{_TIME}\z"),
    ("yyyy-MM-dd HH:mm:ss.SSSSSS", rf"{_DAY} {_TIME}\.[0-9]{{1,6}}\z"),
    ("yyyy-MM-dd HH:mm", rf"{_DAY} [0-9]{{2}}:[0-9]{{2}}\z"),
    ("yyyy-MM-dd", rf"{_DAY}\z"),
    ("yyyy/MM/dd", r"^[0-9]{4}/[0-9]{2}/[0-9]{2}\z"),
    ("MM/dd/yyyy", r"^[0-9]{2}/[0-9]{2}/[0-9]{4}\z"),
]


def valid_imsi(imsi: Column, length: int = 15) -> Column:
    """Exactly ``length`` ASCII digits; a float without fraction counts as its integer."""
    # A floating-point column would be spelt with an exponent; its whole numbers are not.
    number = imsi.try_cast("double")
    whole = F.when(number == F.floor(number), number.try_cast("decimal(38,0)").cast("string"))
    spelt = F.when(F.typeof(imsi).isin("double", "float"), whole).otherwise(imsi.cast("string"))
    text = F.regexp_replace(spelt, r"^([0-9]+)\.0+\z", "$1")
    return F.coalesce(text.rlike(rf"^[0-9]{{{length}}}\z"), F.lit(False))


# A cast to double also takes type suffixes and hexadecimal floats, which are no numbers here.
_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
_ENDLESS = r"(?i)^[+-]?inf(?:inity)?\z"


def _plain_number(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER) | text.rlike(_ENDLESS), text.try_cast("double"))


def parse_timestamp(value: Column, preferred: str | None = None) -> Column:
    """First reading that works: caller's format, common formats, epoch seconds."""
    text = value.cast("string")
    readings = [F.try_to_timestamp(text, F.lit(preferred))] if preferred else []
    readings += [F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(f)))
                 for f, shape in TIME_FORMATS + EXTRA_TIME_FORMATS]
    seconds = _plain_number(F.trim(text))
    in_range = (seconds >= _FIRST_SECOND) & (seconds <= _LAST_SECOND)
    epoch = F.when(in_range, F.timestamp_seconds(F.floor(seconds)))
    return F.coalesce(*readings, epoch)


def valid_timestamp(value: Column, preferred: str | None = None) -> Column:
    return parse_timestamp(value, preferred).isNotNull()


def to_number(value: Column) -> Column:
    """Number, or null where the text is none."""
    return _plain_number(F.trim(value.cast("string")))
