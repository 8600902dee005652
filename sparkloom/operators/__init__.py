"""Relational operators as functions from DataFrame to DataFrame (usable with DataFrame.transform).

Each builds a logical plan only, but for ranked(), which sorts at once; Catalyst and AQE choose the physical one.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import column, output_name, require_boolean, type_of
from ..session import checkpoint


def _resolve(c: str | Column) -> Column:
    return column(c) if isinstance(c, str) else c


# Projection


def project(df: DataFrame, *exprs: str | Column) -> DataFrame:
    """The expressions as columns; one that is neither a bare column nor has an alias is named col_<position>."""
    if not exprs:
        raise ValueError("nothing to project")
    out = []
    for i, e in enumerate(map(_resolve, exprs)):
        name = output_name(e, i)
        out.append(e if name is None else e.alias(name))
    return df.select(*out)


def prune(df: DataFrame, *names: str) -> DataFrame:
    """The named columns in the order asked for; ValueError for none or an unknown one."""
    if not names:
        raise ValueError("no columns asked for")
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"column not found: {', '.join(missing)}")
    return df.select(*map(column, names))


# Filter, limit, distinct


def where(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which predicate is true; TypeError unless it is boolean."""
    require_boolean(df, predicate)
    return df.filter(predicate)


def limit(df: DataFrame, n: int) -> DataFrame:
    """At most n rows; ValueError for a negative n."""
    if n < 0:
        raise ValueError("a limit is not negative")
    return df.limit(n)


def distinct(df: DataFrame, *keys: str | Column) -> DataFrame:
    """The different values of keys (of all columns if none are given)."""
    return (project(df, *keys) if keys else df).distinct()


def distinct_on(df: DataFrame, keys: list[str | Column], order: list[Column] | None = None) -> DataFrame:
    """One whole row for each value of keys (nulls are one value): the first by order, else any.

    With an order a window's limit is pushed below the shuffle, so a hot key sends one row a task.
    """
    if not keys:
        raise ValueError("DISTINCT ON needs keys")
    keys = [_resolve(k) for k in keys]
    names = [f"__key_{i}" for i in range(len(keys))]
    keyed = df.withColumns(dict(zip(names, keys)))
    if order:
        place = F.row_number().over(Window.partitionBy(*names).orderBy(*order))
        return keyed.withColumn("__place", place).where("__place = 1").drop("__place", *names)
    return keyed.dropDuplicates(names).drop(*names)


# Joins


@dataclass(frozen=True)
class JoinClause:
    """Pairs of key expressions, each given by the name or expression of its own side."""

    left: tuple
    right: tuple

    def __post_init__(self):
        if len(self.left) != len(self.right) or not self.left:
            raise ValueError("a join takes as many left keys as right keys, one at least")


def join(left: DataFrame, right: DataFrame, clause: JoinClause, how: str = "inner", residual=None) -> DataFrame:
    """Equi-join on all key pairs; null keys match nothing.

    Names on both sides become left_<name> and right_<name>. residual: a function of
    (left column getter, right column getter) giving a further condition, which is part of ON.
    Keys given as Columns must refer to their own side's original names.
    """
    if how not in ("inner", "left", "right"):
        raise ValueError(f"unknown join type {how!r}")
    both = set(left.columns) & set(right.columns)
    keys_l, keys_r = [f"__lk_{i}" for i in range(len(clause.left))], [f"__rk_{i}" for i in range(len(clause.right))]
    lhs = left.withColumns({k: _resolve(e) for k, e in zip(keys_l, clause.left)}).withColumnsRenamed({c: f"left_{c}" for c in both})
    rhs = right.withColumns({k: _resolve(e) for k, e in zip(keys_r, clause.right)}).withColumnsRenamed({c: f"right_{c}" for c in both})
    condition = lhs[keys_l[0]] == rhs[keys_r[0]]
    for a, b in zip(keys_l[1:], keys_r[1:]):
        condition &= lhs[a] == rhs[b]
    if residual is not None:
        condition &= residual(lambda n: column(f"left_{n}" if n in both else n), lambda n: column(f"right_{n}" if n in both else n))
    return lhs.join(rhs, condition, how).drop(*keys_l, *keys_r)


# Aggregation

AGGREGATES = ("sum", "count", "avg", "min", "max")


@dataclass(frozen=True)
class Agg:
    """An aggregate over a column name or expression; COUNT(*) is Agg("count", "*")."""

    fn: str
    expr: object
    alias: str | None = None

    def name(self) -> str:
        """The alias, or <fn>_Column(<name>) and the like."""
        return self.alias or f"{self.fn}_{shown(self.expr)}"

    def build(self, df: DataFrame, zero_on_empty: bool = False) -> Column:
        if self.fn not in AGGREGATES:
            raise ValueError(f"unknown aggregate {self.fn!r}")
        if self.fn == "count" and isinstance(self.expr, str) and self.expr == "*":
            return F.count(F.lit(1)).cast("double").alias(self.name())
        c = _resolve(self.expr)
        if not isinstance(type_of(df, c), T.NumericType):
            raise TypeError(f"{self.fn} takes numbers, not {type_of(df, c).simpleString()}")
        made = F.count(c).cast("double") if self.fn == "count" else getattr(F, self.fn)(c.cast("double"))
        return (F.coalesce(made, F.lit(0.0)) if zero_on_empty else made).alias(self.name())


def shown(expr: str | Column) -> str:
    """How an expression reads in automatic names."""
    if isinstance(expr, str):
        return f"Column({expr})"
    node = expr._jc.node().getClass().getSimpleName()
    text = str(expr._jc.toString())
    return f"Column({text})" if node == "UnresolvedAttribute" else text


def aggregate(df: DataFrame, *aggs: Agg, zero_on_empty: bool = False) -> DataFrame:
    """One row of aggregates, all of type double. Without values they are null (count 0), or 0.0 with zero_on_empty."""
    if not aggs:
        raise ValueError("no aggregates")
    return df.agg(*(a.build(df, zero_on_empty) for a in aggs))


def group_by(df: DataFrame, keys: list, *aggs: Agg, zero_on_empty: bool = False) -> DataFrame:
    """A row for each value of keys (typed; nulls are one value): keys first, as group_Column(<name>) unless they have an alias, then aggregates."""
    if not keys or not aggs:
        raise ValueError("grouping takes keys and aggregates")
    return df.groupBy(*map(_named_key, keys)).agg(*(a.build(df, zero_on_empty) for a in aggs))


def _named_key(key: str | Column) -> Column:
    c = _resolve(key)
    node = c._jc.node().getClass().getSimpleName()
    return c if node == "Alias" else c.alias(f"group_{shown(key)}")


def join_count(left: DataFrame, right: DataFrame, clause: JoinClause, keys: list, alias: str | None = None, how: str = "inner", residual=None) -> DataFrame:
    """group_by(join(left, right, clause, how, residual), keys, Agg("count", "*", alias)), with equal rows of a side joined as one.

    Each side is reduced to its different rows and their numbers, and a pair counts as often as the product says; so
    time grows with the different rows, not with the pairs. Give sides of no more columns than keys and conditions need.
    """
    if not keys:
        raise ValueError("grouping takes keys")
    sides = [df.groupBy(*map(column, df.columns)).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "__left_n"), (right, "__right_n"))]
    # Decimals: the product of two counts can exceed 64 bits. A row without a partner counts itself.
    times = [F.coalesce(F.col(n), F.lit(1)).cast("decimal(19,0)") for n in ("__left_n", "__right_n")]
    pairs = F.sum(times[0] * times[1]).cast("double").alias(Agg("count", "*", alias).name())
    return join(*sides, clause, how, residual).groupBy(*map(_named_key, keys)).agg(pairs)


def having(df: DataFrame, predicate: Column) -> DataFrame:
    """Groups for which predicate (over the aggregates' names) is true."""
    return where(df, predicate)


# Sort


def sort_key(c: str | Column, asc: bool = False, nulls_first: bool | None = None) -> Column:
    """A sort key; descending unless asc. Null is the lowest value unless nulls_first says otherwise."""
    c = _resolve(c)
    if nulls_first is None:
        return c.asc() if asc else c.desc()
    if asc:
        return c.asc_nulls_first() if nulls_first else c.asc_nulls_last()
    return c.desc_nulls_first() if nulls_first else c.desc_nulls_last()


def sort(df: DataFrame, *keys: Column) -> DataFrame:
    """All rows in order of keys."""
    if not keys:
        raise ValueError("no sort keys")
    return df.orderBy(*keys)


def ranked(df: DataFrame, name: str, *keys: Column) -> DataFrame:
    """df with the place of each row in the order of keys, from 1, as column name.

    Rows are sorted by range and counted a partition; no task needs all rows. They come in that order; ties in any, but in one.
    """
    held = checkpoint(sort(df, *keys).withColumn("__at", F.monotonically_increasing_id()))
    part = F.call_function("shiftright", F.col("__at"), F.lit(33))
    counts = dict(held.groupBy(part.cast("int")).count().collect())  # a number a partition
    sizes = [counts.get(i, 0) for i in range(max(counts, default=0) + 1)]
    before = F.expr("array(" + ", ".join(f"{n}L" for n in itertools.accumulate([0, *sizes])) + ")")
    rank = F.get(before, part.cast("int")) + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return held.withColumn(name, rank).drop("__at")


#: Rows beyond which the first rows of an order are found by a sort by range; fewer fit the heap of one task.
HEAP_ROWS = 1_000_000


def top_k(df: DataFrame, k: int, *keys: Column) -> DataFrame:
    """The first k rows in order of keys: by a bounded heap in each task, or for a large k by a sort by range."""
    if k <= HEAP_ROWS:
        return limit(sort(df, *keys), k)
    return ranked(df, "__rank", *keys).where(F.col("__rank") <= k).drop("__rank")
