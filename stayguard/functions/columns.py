"""Column-level helpers (JVM-side expressions only: no Python UDFs).

Dates (D1-D9), numeric coercion (P10-P12), bins (N11), season (D7), month
normalisation (P3). Every helper returns a ``Column``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import LEAD_TIME_EDGES, LEAD_TIME_LABELS, MONTH_NAMES

SENTINEL_TEXT = ["nan", "None", ""]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Helpers given a column *name* build the expression from SQL text: one parse on
# the JVM instead of one py4j call per expression node (plan building stays cheap).

def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def to_double(c: str | Column) -> Column:
    """Bad text to NULL (``try_cast`` never raises under ANSI mode)."""
    if isinstance(c, str):
        return F.expr(f"try_cast({_q(c)} AS DOUBLE)")
    return c.try_cast("double")


def num0(c: str | Column) -> Column:
    """P10: numeric coercion, NULL / NaN / bad text -> 0.0."""
    if isinstance(c, str):
        return F.expr(f"nanvl(coalesce(try_cast({_q(c)} AS DOUBLE), 0D), 0D)")
    return F.nanvl(F.coalesce(to_double(c), F.lit(0.0)), F.lit(0.0))


def floor0(c: str | Column) -> Column:
    if isinstance(c, str):
        return F.expr(f"greatest(nanvl(coalesce(try_cast({_q(c)} AS DOUBLE), 0D), 0D), 0D)")
    return F.greatest(num0(c), F.lit(0.0))


def round_binary(c: Column, digits: int) -> Column:
    """Round the binary double half away from zero: ``round(x * 10^d) / 10^d``.

    ``round(x, d)`` on a double rounds its shortest decimal text (69.195 -> 69.20),
    while numpy / pandas and C-based SQL engines round the stored binary value
    (69.19499... -> 69.19). This form gives the latter in every engine.
    """
    m = float(10 ** digits)
    return F.round(c * F.lit(m), 0) / F.lit(m)


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bounded value; NULL stays NULL (``greatest`` and ``least`` alone would skip it)."""
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


def finite0(c: str | Column) -> Column:
    """NULL, NaN, +inf, -inf -> 0."""
    if isinstance(c, str):
        x = f"try_cast({_q(c)} AS DOUBLE)"
        return F.expr(f"CASE WHEN {x} IS NULL OR isnan({x}) OR abs({x}) = double('inf') THEN 0D ELSE {x} END")
    x = to_double(c)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(x)


def unknown_if_missing(c: str | Column, sentinels=("nan", "None", "")) -> Column:
    """NULL and sentinel strings -> 'Unknown'."""
    if isinstance(c, str):
        x = f"CAST({_q(c)} AS STRING)"
        lits = ", ".join("'" + v + "'" for v in sentinels)
        return F.expr(f"CASE WHEN {x} IS NULL OR {x} IN ({lits}) THEN 'Unknown' ELSE {x} END")
    x = col(c).cast("string")
    return F.when(x.isNull() | x.isin(*sentinels), F.lit("Unknown")).otherwise(x)


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 int; NULL condition counts as 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))


# --- months ---------------------------------------------------------------

def _month_name_array() -> Column:
    return F.expr("array(" + ", ".join(f"'{m}'" for m in MONTH_NAMES) + ")")


def _month_from_text(t: Column) -> Column:
    """Month name of a text that is a month's name, or its first three letters, in any case."""
    names, low = _month_name_array(), F.lower(t)
    found = F.filter(names, lambda m: (F.lower(m) == low) | ((F.length(low) == 3) & F.startswith(F.lower(m), low)))
    return F.get(found, F.lit(0))


def month_name_from_num(m: Column) -> Column:
    mi = m.cast("int")
    return F.when((mi >= 1) & (mi <= 12), F.element_at(_month_name_array(), mi))


def month_num_from_name(name: Column) -> Column:
    return F.array_position(_month_name_array(), name).cast("int")


def normalize_month(c: Column, dtype: T.DataType) -> Column:
    """1..12, '8', 'aug', 'August' -> 'August'; anything else is kept as text."""
    if isinstance(dtype, T.NumericType):
        v = c.cast("double")
        return F.when(v.isNull() | F.isnan(v), F.lit(None).cast("string")).otherwise(
            F.coalesce(month_name_from_num(F.floor(v)), F.trim(c.cast("string"))))
    t = F.trim(c.cast("string"))
    as_int = F.when(t.rlike("^[0-9]+$"), t.try_cast("int"))
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(
        F.coalesce(month_name_from_num(as_int), _month_from_text(t), t))


def season(month_num: Column) -> Column:
    """Meteorological season; NULL -> 'unknown'."""
    m = month_num.cast("int")
    return (F.when(m.isNull(), "unknown")
            .when(m.isin(12, 1, 2), "winter")
            .when(m.isin(3, 4, 5), "spring")
            .when(m.isin(6, 7, 8), "summer")
            .otherwise("autumn"))


# --- dates ----------------------------------------------------------------

def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """Bad parts -> NULL (Feb 30 gives NULL; no exception under ANSI)."""
    y = year.cast("int").cast("string")
    m = F.lpad(month.cast("int").cast("string"), 2, "0")
    d = F.lpad(day.cast("int").cast("string"), 2, "0")
    return F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MM-dd")


def parse_date(c: Column, dtype: T.DataType) -> Column:
    """Date text -> DATE, bad text -> NULL (ISO formats)."""
    if isinstance(dtype, T.DateType):
        return c
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("date")
    return F.try_to_date(c.cast("string"))


def weekday_monday0(d: Column) -> Column:
    """Monday = 0 ... Sunday = 6; NULL -> 0."""
    return F.coalesce(F.weekday(d), F.lit(0))


def quarter_from_month(m: Column) -> Column:
    """D6"""
    return F.ceil(m / F.lit(3.0)).cast("int")


def year_month(d: Column) -> Column:
    """D9: '%Y-%m'"""
    return F.date_format(d, "yyyy-MM")


# --- bins -----------------------------------------------------------------

def right_closed_bin(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the bin (a, b]; values outside every bin -> NULL."""
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def lead_time_bin(lead: Column) -> Column:
    return right_closed_bin(lead, LEAD_TIME_EDGES, LEAD_TIME_LABELS)


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    """Sin / cos of 2*pi*x/period."""
    a = F.lit(2 * math.pi) * x / F.lit(float(period))
    return F.sin(a), F.cos(a)
