"""Filters, search, paging, grouped counts and nesting of child rows."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairway.operators.ordered import running_sum


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def equal_filters(skip: str = "none", **values: Any) -> Column:
    """Conjunction of equalities. skip 'none': a value of None is no filter; 'falsy': nor are 0 and ''."""
    if skip not in ("none", "falsy"):
        raise ValueError("skip is 'none' or 'falsy'")
    return all_of([F.col(k) == v for k, v in values.items() if (v is not None if skip == "none" else bool(v))])


def keyword(columns: list[str], word: str | None) -> Column:
    """Any of the columns contains the word, in any case; % and _ in it are wildcards. No word: all rows."""
    if not word:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{word}%") for c in columns])


def between_dates(column: str, start=None, end=None) -> Column:
    """Inclusive on both ends; a missing end is open."""
    return all_of(([F.col(column) >= F.lit(start)] if start is not None else []) + ([F.col(column) <= F.lit(end)] if end is not None else []))


def parent_is(column: str, value) -> Column:
    """Equality in which null stands for the top level."""
    return F.col(column).isNull() if value is None else F.col(column) == value


def under_parent_code(df: DataFrame, parents: DataFrame, code: str | None, on: str = "parent_code") -> DataFrame:
    """Children of the parent with this code; an unknown code drops the filter, so that all rows come back."""
    if code is None:
        return df
    known = parents.where(F.col("code") == code).select(F.lit(True).alias("__known")).distinct()
    return df.join(F.broadcast(known), F.lit(True), "left").where(F.col("__known").isNull() | (F.col(on).cast("string") == code)).drop("__known")  # one row at most


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """Rows of one page; the order must be total. Pages count from 1 and have 1 to 100 rows."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page >= 1 and 1 <= size <= 100")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_with_total(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """A page with the number of all rows in `total`: two passes, of which the first only counts."""
    total = df.agg(F.count("*").alias("total"))
    return page(df, order, number, size).crossJoin(F.broadcast(total))  # the total is one row


def _after(order: list[tuple[str, bool]], cursor: dict[str, Any]) -> Column:
    """Whether a row comes after the cursor; nulls first where ascending, last where descending, as Spark sorts."""
    out = F.lit(False)
    for column, descending in reversed(order):
        c, v = F.col(column), cursor[column]
        if descending:
            further = F.lit(False) if v is None else (c < F.lit(v)) | c.isNull()
        else:
            further = c.isNotNull() if v is None else c > F.lit(v)
        out = F.coalesce(further, F.lit(False)) | (c.eqNullSafe(F.lit(v)) & out)
    return out


def page_after(df: DataFrame, order: list[tuple[str, bool]], cursor: dict[str, Any] | None = None, size: int = 20) -> DataFrame:
    """The next `size` rows (1 to 100) after a cursor, in the order of (column, descending) pairs, which must be total.

    Unlike page(), no row before the cursor is sorted or skipped: every partition keeps its first `size` rows after it, and
    the first comparison reaches the scan. No cursor: the first page.
    """
    if not 1 <= size <= 100:
        raise ValueError("1 <= size <= 100")
    rows = df
    if cursor is not None:
        first, descending = order[0]
        if cursor[first] is not None:  # the part of the condition that a scan can use
            start = (F.col(first) <= F.lit(cursor[first])) | F.col(first).isNull() if descending else F.col(first) >= F.lit(cursor[first])
            rows = rows.where(start)
        rows = rows.where(_after(order, cursor))
    return rows.orderBy(*[F.desc(c) if d else F.asc(c) for c, d in order]).limit(size)


def cursor_of(rows: DataFrame, order: list[tuple[str, bool]]) -> dict[str, Any] | None:
    """The cursor behind the last row of a page, for page_after(); None for an empty page."""
    last = rows.orderBy(*[F.asc_nulls_first(c) if d else F.desc_nulls_last(c) for c, d in order]).select(*[c for c, _ in order]).first()
    return None if last is None else last.asDict()


def counts_with_zeros(df: DataFrame, column: str, kinds: list[str], total: str = "TOTAL") -> DataFrame:
    """(kind, n) for a fixed list of kinds, zero where there are none, and their total."""
    spark = df.sparkSession
    fixed = spark.createDataFrame([(k,) for k in kinds], "kind string")
    counts = df.where(F.col(column).isin(*kinds)).groupBy(F.col(column).alias("kind")).agg(F.count("*").alias("n"))
    out = fixed.join(counts, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return out.unionByName(out.agg(F.lit(total).alias("kind"), F.sum("n").cast("long").alias("n")))


def nested(parents: DataFrame, children: DataFrame, key: str, foreign: str, fields: list[str], name: str = "children") -> DataFrame:
    """Parents with an array of their children's fields, sorted by these; empty without children."""
    lists = children.groupBy(F.col(foreign).alias(key)).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    kind = lists.schema[name].dataType
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def nested_parts(parents: DataFrame, children: DataFrame, key: str, foreign: str, fields: list[str], name: str = "children", size: int = 10_000, slice_rows: int | None = None) -> DataFrame:
    """nested() for parents of any number of children: a row for every `size` of them, with its number in `part`, from 0.

    Children are in the order of their fields across the parts. They are counted in slices of the first field, so neither
    a window nor an array ever holds all children of a parent. A parent without children has one row and an empty array.
    """
    narrow = children.select(F.col(foreign).alias("__key"), *fields)
    placed = running_sum(narrow, ["__key"], fields, F.lit(1).cast("long"), "__nth", slice_rows)
    part = F.floor((F.col("__nth") - 1) / size).cast("int")
    lists = placed.groupBy(F.col("__key").alias(key), part.alias("part")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    kind = lists.schema[name].dataType
    return parents.join(lists, key, "left").withColumns({"part": F.coalesce("part", F.lit(0)), name: F.coalesce(name, F.array().cast(kind))})


def by_name_or_alias(nodes: DataFrame, aliases: DataFrame, word: str) -> DataFrame:
    """Nodes whose name or any alias contains the word."""
    named = nodes.where(F.col("name").ilike(f"%{word}%")).select("id")
    called = aliases.where(F.col("alias_name").ilike(f"%{word}%")).select(F.col("node_id").alias("id"))
    return nodes.join(named.unionByName(called).distinct(), "id", "left_semi")


def newest(df: DataFrame, key: str, value, order: list[Column], n: int = 50) -> DataFrame:
    """The first n rows of one key in this order."""
    return df.where(F.col(key) == value).orderBy(*order).limit(n)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of every key in this order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
