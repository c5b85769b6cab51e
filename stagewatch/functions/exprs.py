"""Column-expression helpers shared by the operators (all JVM built-ins)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import ERROR_LEVELS, FX_DEFAULT_RATE, FX_RATES

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
FLOATING_TYPES = (T.FloatType, T.DoubleType)
RATE_TYPE = "decimal(8,4)"


def quoted(name: str) -> Column:
    """The top-level column ``name``, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_null(df: DataFrame, name: str) -> Column:
    """Null test that also counts NaN on floating columns (pandas ``isna``)."""
    c = quoted(name)
    if isinstance(df.schema[name].dataType, FLOATING_TYPES):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def is_numeric(df: DataFrame, name: str) -> bool:
    return name in df.columns and isinstance(df.schema[name].dataType, NUMERIC_TYPES)


def fx_rate(currency: Column, rates: dict[str, float] | None = None) -> Column:
    """Exchange rate for a currency code as an inline CASE (no join, codegen'd).

    Unknown or null codes get the default rate.  Rates are decimals so money
    sums are exact and independent of partitioning; all of them have the scale
    of the one with most places (``RATE_TYPE`` at least), so no rate is cut.
    """
    rates = {c: Decimal(str(r)) for c, r in (FX_RATES if rates is None else rates).items()}
    default = Decimal(str(FX_DEFAULT_RATE))
    places = max([4, *(-r.normalize().as_tuple().exponent for r in rates.values())])
    digits = max([4, *(r.adjusted() + 1 for r in rates.values())])
    kind = f"decimal({digits + places},{places})"
    expr = None
    for code, rate in rates.items():
        lit = F.lit(str(rate)).cast(kind)
        expr = F.when(currency == code, lit) if expr is None else expr.when(currency == code, lit)
    default = F.lit(str(default)).cast(kind)
    return default if expr is None else expr.otherwise(default)


def rate_type(table_type: T.DataType) -> str:
    """The type that rates of a table are used in: their own decimal scale; 12 places for floats and texts."""
    if isinstance(table_type, T.DecimalType):
        places = max(4, table_type.scale)
        return f"decimal({min(38, max(table_type.precision - table_type.scale, 4) + places)},{places})"
    return RATE_TYPE if isinstance(table_type, T.IntegralType) else "decimal(18,12)"


def pct(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` as double; null when ``whole`` is 0."""
    return F.try_divide(part.cast("double") * 100.0, whole.cast("double"))


def safe_ratio(num: Column, den: Column, zero: float | None = 0.0) -> Column:
    """``num / den`` as double, ``zero`` when the denominator is 0 or null."""
    r = F.try_divide(num.cast("double"), den.cast("double"))
    return r if zero is None else F.coalesce(r, F.lit(zero))


def is_error_level(level: Column) -> Column:
    return level.isin(*ERROR_LEVELS)


def ordered_text(value: Column, order: Column, sep: str = "; ") -> Column:
    """Aggregate: values joined in ``order`` (ties broken by value)."""
    return F.concat_ws(sep, F.transform(
        F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))),
        lambda s: s["v"]))


def micros_since_epoch(ts: Column) -> Column:
    """Microseconds since 1970-01-01 for a TIMESTAMP_NTZ, independent of time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def ts_text(c: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss.ffffff`` for a TIMESTAMP_NTZ without any time-zone
    conversion (the string cast trims trailing fraction zeros; pad them back)."""
    s = c.cast("string")
    return F.when(F.instr(s, ".") > 0, F.rpad(s, 26, "0")).otherwise(F.concat(s, F.lit(".000000")))


def present(df: DataFrame) -> DataFrame:
    """Final projection for reports: dates and times as ISO text, decimals as
    double, small integers as bigint.  Applied once at the end of a query."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, T.DateType):
            c = c.cast("string")
        elif isinstance(t, T.TimestampNTZType):
            c = ts_text(c)
        elif isinstance(t, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(t, T.DecimalType):
            c = c.cast("double")
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(t, T.FloatType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def merge_rows(frames: list[DataFrame], key: str | None = None) -> DataFrame:
    """Combine small results that each hold some of the columns of one row
    (per ``key``, or a single row without one) — a union plus a
    ``first(ignorenulls)`` aggregate instead of a cross or nested-loop join."""
    cols: list[str] = []
    for f in frames:
        cols += [c for c in f.columns if c != key and c not in cols]
    types = {}
    for f in frames:
        for fld in f.schema.fields:
            types.setdefault(fld.name, fld.dataType)

    def widen(f: DataFrame) -> DataFrame:
        sel = ([F.col(key)] if key else []) + [
            (F.col(c) if c in f.columns else F.lit(None).cast(types[c])).alias(c) for c in cols]
        return f.select(*sel)
    u = widen(frames[0])
    for f in frames[1:]:
        u = u.unionByName(widen(f))
    aggs = [F.first(c, ignorenulls=True).alias(c) for c in cols]
    return u.groupBy(key).agg(*aggs) if key else u.agg(*aggs)
