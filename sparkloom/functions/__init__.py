"""Column expressions whose semantics differ from Spark's defaults, and the checks behind them.

Everything here builds Columns; nothing runs a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import from_name


def column(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def typed_literal(value, kind: str | T.DataType) -> Column:
    """A constant of the given type."""
    return F.lit(value).cast(from_name(kind) if isinstance(kind, str) else kind)


def type_of(df: DataFrame, c: Column) -> T.DataType:
    return df.select(c.alias("c")).schema[0].dataType


def require_same_type(df: DataFrame, a: Column, b: Column) -> None:
    """TypeError unless both have one type: comparisons under strict typing cast nothing."""
    left, right = type_of(df, a), type_of(df, b)
    if left != right:
        raise TypeError(f"types differ: {left.simpleString()} and {right.simpleString()}")


def require_boolean(df: DataFrame, *cs: Column) -> None:
    for c in cs:
        if not isinstance(type_of(df, c), T.BooleanType):
            raise TypeError(f"not boolean: {type_of(df, c).simpleString()}")


#: Comparison and logical operators by symbol.
COMPARISONS = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def compare(df: DataFrame, a: Column, op: str, b: Column, strict_types: bool = False) -> Column:
    """a op b; with strict_types both sides must have one type."""
    if op not in COMPARISONS:
        raise ValueError(f"unknown comparison {op!r}")
    if strict_types:
        require_same_type(df, a, b)
    return COMPARISONS[op](a, b)


def arithmetic(df: DataFrame, a: Column, op: str, b: Column) -> Column:
    """a op b for + - * /. Whole numbers stay whole and divide with truncation; 32-bit floats stay so unless the other side is double."""
    left, right = type_of(df, a), type_of(df, b)
    for kind in (left, right):
        if not isinstance(kind, T.NumericType):
            raise TypeError(f"not a number: {kind.simpleString()}")
    whole = isinstance(left, T.IntegralType) and isinstance(right, T.IntegralType)
    if op == "/" and whole:
        return int_div(a, b).cast(max(left, right, key=_WIDTHS.index))
    made = {"+": a + b, "-": a - b, "*": a * b, "/": a / b}.get(op)
    if made is None:
        raise ValueError(f"unknown arithmetic operator {op!r}")
    if T.FloatType() in (left, right) and T.DoubleType() not in (left, right):
        return made.cast("float")
    return made


_WIDTHS = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]


def int_div(a: Column, b: Column) -> Column:
    """Division of whole numbers that truncates toward zero, as bigint; a zero divisor raises."""
    return F.call_function("div", a, b)


def round_half_even(c: Column, digits: int = 0) -> Column:
    """Rounding in which halves go to the even neighbour."""
    return F.bround(c, digits)


def safe_cast(df: DataFrame, c: Column, kind: str | T.DataType) -> Column:
    """A cast that raises where it would lose a fraction (ANSI casts raise for the rest)."""
    to = from_name(kind) if isinstance(kind, str) else kind
    if isinstance(type_of(df, c), T.FractionalType) and isinstance(to, T.IntegralType):
        whole = F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c))
        return F.when(c != whole, F.raise_error(F.concat(F.lit("cast would lose a fraction: "), c.cast("string"))).cast(to)).otherwise(c.cast(to))
    return c.cast(to)


def is_valid(c: Column) -> Column:
    """True where c is not null."""
    return c.isNotNull()


def like(c: Column, pattern: str) -> Column:
    """SQL LIKE: % and _ as wildcards, the whole value must match."""
    return c.like(pattern)


def strict_and(a: Column, b: Column) -> Column:
    """AND that is null where either side is."""
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(a & b)


def strict_or(a: Column, b: Column) -> Column:
    """OR that is null where either side is."""
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(a | b)


# Scalar functions: those of text take text only, those of numbers numbers only.


def upper(df: DataFrame, c: Column) -> Column:
    return F.upper(_text(df, c))


def lower(df: DataFrame, c: Column) -> Column:
    return F.lower(_text(df, c))


def absolute(df: DataFrame, c: Column) -> Column:
    return F.abs(_number(df, c))


def rounded(df: DataFrame, c: Column, digits: int = 0) -> Column:
    return round_half_even(_number(df, c), digits)


def _text(df: DataFrame, c: Column) -> Column:
    if not isinstance(type_of(df, c), T.StringType):
        raise TypeError("a text function takes text")
    return c


def _number(df: DataFrame, c: Column) -> Column:
    if not isinstance(type_of(df, c), T.NumericType):
        raise TypeError("a numeric function takes numbers")
    return c


# The rest of the advertised expression syntax.
negate = lambda c: -c
concat = F.concat
length = F.length
coalesce = F.coalesce


def substring(c: Column, start: int, size: int) -> Column:
    """size characters from start, counted from 1."""
    return F.substring(c, start, size)


def output_name(c: Column, at: int) -> str | None:
    """None if c is a bare column or has an alias, else its automatic name, col_<position>."""
    node = c._jc.node().getClass().getSimpleName()
    return None if node in ("UnresolvedAttribute", "Alias", "UnresolvedStar") else f"col_{at}"
