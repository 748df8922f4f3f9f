"""Event time: normalisation, integer clocks and the total order of events."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, functions as F

from runtime_insights.functions.fields import field

# The order key packs (ts, seq, pos) into one decimal(38,0): a fixed-width value, so
# "first" and "last" are plain min and max inside a hash aggregate. A struct or a
# min_by would turn each of those aggregates into a sort of all its input rows.
# Any timestamp fits (years 1 to 9999). Sequence numbers and positions beyond the key's
# digits sort like the largest it holds: they are ties, not errors.
_SEQ_DIGITS = 14
_POS_DIGITS = 6
MAX_SEQ = 10**_SEQ_DIGITS - 1
MAX_POS = 10**_POS_DIGITS - 1
_YEAR_ONE_US = 62_135_596_800_000_000  # microseconds from year 1 to the epoch


def _power(digits: int) -> Column:
    return F.expr(f"1{'0' * digits}BD")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a UTC timestamp."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def bucket(value: Column, width: int) -> Column:
    """Index of the grid cell of ``width`` that holds an integer ``value``."""
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width))


def millis(us: Column) -> Column:
    return bucket(us, 1000)


def order_key(ts_us: Column, seq: Column, pos: Column | None = None) -> Column:
    """One decimal that sorts like (ts, seq, pos); a null sequence number sorts as 0."""
    def held(value: Column, most: int) -> Column:
        return F.greatest(F.lit(0).cast("bigint"), F.least(value.cast("bigint"), F.lit(most).cast("bigint")))

    wide = "decimal(38,0)"
    time = held(ts_us + F.lit(_YEAR_ONE_US), 10**18 - 1).cast("decimal(18,0)")
    number = held(F.coalesce(seq, F.lit(0)), MAX_SEQ).cast("decimal(14,0)")
    key = (
        (time * _power(_SEQ_DIGITS + _POS_DIGITS)).cast(wide)
        + (number * _power(_POS_DIGITS)).cast(wide)
    )
    if pos is not None:
        key = key + held(pos, MAX_POS).cast("decimal(6,0)")
    return key.cast(wide)


def order_micros(key: Column) -> Column:
    return F.call_function("div", key, _power(_SEQ_DIGITS + _POS_DIGITS)) - F.lit(_YEAR_ONE_US)


def order_millis(key: Column) -> Column:
    return millis(order_micros(key))


def order_seq(key: Column) -> Column:
    rest = F.call_function("mod", key, _power(_SEQ_DIGITS + _POS_DIGITS))
    return F.call_function("div", rest, _power(_POS_DIGITS))


def order_pos(key: Column) -> Column:
    return F.call_function("mod", key, _power(_POS_DIGITS)).cast("int")


def order_event(key: Column) -> Column:
    """The key of the event itself (slot 0)."""
    return (key - F.call_function("mod", key, _power(_POS_DIGITS))).cast("decimal(38,0)")


# --------------------------------------------------------------- normalisation

def _iso(text: Column) -> Column:
    dashed = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text)
    return F.try_to_timestamp(dashed)


def _number(text: Column) -> Column:
    return F.when(text.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), text)


def metric_seconds(fields: Column, ingest_ts: Column) -> Column:
    """Whole seconds for the last-event gauge.

    ISO text first, then the number in ``evt.time`` by magnitude (above 1e12 taken as
    nanoseconds, above 1e9 as microseconds, else as seconds), else the ingest time.
    """
    iso = F.floor(micros(_iso(field(fields, "evt.time.iso8601"))) / F.lit(1_000_000))
    raw = _number(field(fields, "evt.time")).cast("double")
    number = (
        F.when(raw > 1e12, raw / F.lit(1e9)).when(raw > 1e9, raw / F.lit(1e6)).otherwise(raw)
    ).cast("bigint")
    return F.coalesce(iso.cast("bigint"), number, bucket(micros(ingest_ts), 1_000_000))


def event_time(time: Column, fields: Column, ingest_ts: Column) -> Column:
    """Event time as UTC wall clock: ``time`` text, else an integer field, else ingest.

    Integers are seconds below 1e11, milliseconds below 1e14, microseconds below 1e17,
    nanoseconds above.
    """
    def integer(key: str) -> Column:
        text = field(fields, key)
        return F.when(text.rlike(r"^\d{1,18}$|^[1-8]\d{18}$"), text).cast("bigint")

    number = F.coalesce(integer("evt.time.iso8601"), integer("evt.time"))
    us = (
        F.when(number < 10**11, number * 1_000_000)
        .when(number < 10**14, number * 1_000)
        .when(number < 10**17, number)
        .otherwise(bucket(number, 1_000))
    )
    text = F.coalesce(_iso(time), _iso(field(fields, "evt.time.iso8601")))
    return F.coalesce(text.cast("timestamp_ntz"), from_micros(us), ingest_ts.cast("timestamp_ntz"))


def epoch_micros(ts: datetime) -> int:
    """Microseconds since 1970 of a wall-clock time, as ``micros`` gives them."""
    return (ts - datetime(1970, 1, 1)) // timedelta(microseconds=1)
