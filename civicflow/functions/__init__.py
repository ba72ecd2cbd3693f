"""Column expressions: every helper returns a ``Column`` built from
``pyspark.sql.functions`` so it stays inside whole-stage codegen.

All helpers accept a column name or a ``Column``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the raw ticket timestamp format ("01/31/2023 10:15:00 PM").
TICKET_TS_FORMAT = "MM/dd/yyyy hh:mm:ss a"

MICROS_PER_DAY = 86_400_000_000.0


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- parsing

def parse_fixed_timestamp(c, fmt: str = TICKET_TS_FORMAT) -> Column:
    """B1: fixed-format parse, unparseable text -> null; result has no time zone."""
    return F.try_to_timestamp(col(c), F.lit(fmt)).cast("timestamp_ntz")


def parse_timestamp(c) -> Column:
    """B2: free-format parse (ISO-like text), bad -> null."""
    return col(c).try_cast("timestamp_ntz")


def to_int_or_null(c) -> Column:
    """Text -> nullable integer; '10001.0' -> 10001, '10001-123' -> null,
    '10001.5' -> null (not integral).  Whole numbers never pass through a
    double, which would change keys above 2^53; a number beyond a bigint is null."""
    text = col(c).cast("string")
    exact, wide = text.try_cast("decimal(38,18)"), text.try_cast("double")
    whole = ~F.isnan(wide) & (wide == F.rint(wide)) & F.coalesce(exact == F.floor(exact), F.lit(True))
    return F.coalesce(text.try_cast("long"), F.when(whole & (F.abs(wide) < 2.0 ** 63), F.coalesce(exact, wide.try_cast("decimal(38,0)")).try_cast("long")))


def digits_or_zero(c) -> Column:
    """All-digit text -> integer, anything else (null, or digits beyond a bigint) -> 0."""
    c = col(c)
    return F.coalesce(F.when(c.rlike("^[0-9]+$"), c.try_cast("long")), F.lit(0).cast("long"))


def to_number_or_null(c) -> Column:
    """Metric text -> double; unreadable and the text 'NaN' -> null."""
    d = col(c).try_cast("double")
    return F.when(~F.isnan(d), d)


# ---------------------------------------------------------------- cleaning

def is_missing_like(c) -> Column:
    """null, blank after trim, or the text 'nan' in any case."""
    c = col(c)
    return c.isNull() | (F.trim(c) == "") | (F.lower(c) == "nan")


def default_if_missing(c, default: str) -> Column:
    """Missing-like -> default, anything else unchanged (not trimmed)."""
    return F.when(is_missing_like(c), F.lit(default)).otherwise(col(c))


def present_key(c) -> Column:
    """B7 predicate: key neither null nor empty."""
    c = col(c)
    return c.isNotNull() & (c.cast("string") != "")


def clip(c, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Clip into [lo, hi]; null stays null (least/greatest skip nulls)."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def round_half_even(c, digits: int = 2) -> Column:
    """Numpy-style rounding: scale, round half to even on the binary value, unscale."""
    scale = float(10 ** digits)
    return F.rint(col(c) * F.lit(scale)) / F.lit(scale)


def normalize_key(c, suffix: str | None = None) -> Column:
    """Upper-case and trim a join key, without a closing ``suffix`` (any case)."""
    key = F.upper(F.trim(col(c)))
    if not suffix:
        return key
    end = suffix.upper()
    return F.when(F.endswith(key, F.lit(end)), F.trim(F.substring(key, F.lit(1), F.length(key) - len(end)))).otherwise(key)


def alias_or_self(c, aliases: dict[str, str]) -> Column:
    """Mapped value when the key is in ``aliases``, else the value itself."""
    if not aliases:
        return col(c)
    m = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(m[col(c)], col(c))


def binarize(c, cls) -> Column:
    """1 where the column equals ``cls`` else 0."""
    return (col(c) == F.lit(cls)).cast("int")


def space_to_underscore(name: str) -> str:
    """B12 applied to a single column name."""
    return name.replace(" ", "_")


# ---------------------------------------------------------------- dates

def hour_of(c) -> Column:
    return F.hour(col(c))


def month_of(c) -> Column:
    return F.month(col(c))


def weekday_of(c) -> Column:
    """Monday = 0 ... Sunday = 6 (not ``dayofweek``, which starts on Sunday = 1)."""
    return F.weekday(col(c))


def days_between(start, end) -> Column:
    """F2: fractional days from ``start`` to ``end``; exact microsecond
    difference, independent of the session time zone."""
    return F.timestamp_diff("MICROSECOND", col(start), col(end)) / F.lit(MICROS_PER_DAY)


def age_days(created, as_of=None) -> Column:
    """age in days at ``as_of`` (a literal timestamp text or Column;
    default: the query's current timestamp)."""
    ref = F.localtimestamp() if as_of is None else (
        F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else col(as_of))
    return days_between(created, ref)


# ---------------------------------------------------------------- hashing

def seeded_hash(key, seed: int) -> Column:
    """Deterministic, partitioning-independent order key: md5 of 'key:seed'.

    Hex text compares the same way in every engine, so the order is portable.
    """
    return F.md5(F.concat(col(key).cast("string"), F.lit(f":{seed}")))


def hash_unit(key, seed: int) -> Column:
    """Seeded hash mapped to [0, 1) from its first 8 hex digits."""
    return F.conv(F.substring(seeded_hash(key, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


# ---------------------------------------------------------------- vectors (I16)

def argmax_index(arr) -> Column:
    """0-based index of the first maximum of an array column."""
    a = col(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")
