"""Rows in order within a key, for keys of any size: the row before, running sums, dense numbers.

A table is cut into slices of its order at bounds taken from the data, so that a slice has about SLICE_ROWS rows, whatever
keys these have. A window sees the rows of one key and slice; what a slice needs to know of those before it (the last row,
a sum) comes in as one more row at its head, from an aggregate by key and slice. So a key with a third of all rows
is many tasks, and only rows of one key that are equal in the first order column stay together. Small tables are one slice,
and then all this is a plain window.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a slice, about; numbers that one row of an aggregate may stand for at once.
SLICE_ROWS, RUN = 1_000_000, 65_536


def _as_double(df: DataFrame, column: str) -> Column | None:
    """A column that orders as doubles do, as one; None for texts and the like."""
    kind = df.schema[column].dataType.simpleString()
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    if kind == "date":
        return F.unix_date(column).cast("double")
    return F.col(column).cast("double") if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal") else None


def sliced(df: DataFrame, order: str, slice_rows: int | None = None) -> tuple[DataFrame, int]:
    """`df` with __slice, which never falls as `order` rises (null first), and the number of slices.

    Bounds are quantiles of the column; a column that is neither a number nor a time gives one slice. The bounds are
    values in the plan, so every evaluation cuts alike.
    """
    value = _as_double(df, order)
    parts = 1 if value is None else math.ceil(df.count() / (slice_rows or SLICE_ROWS))
    if parts <= 1:
        return df.withColumn("__slice", F.lit(0)), 1
    bounds = df.select(value.alias("v")).where("v IS NOT NULL AND NOT isnan(v)").approxQuantile("v", [k / parts for k in range(1, parts)], 1 / (4 * parts))
    splits = [-math.inf, *sorted(set(bounds)), math.inf]
    if len(splits) < 3:
        return df.withColumn("__slice", F.lit(0)), 1
    cut = Bucketizer(splits=splits, inputCol="__value", outputCol="__bucket", handleInvalid="keep").transform(df.withColumn("__value", value))
    place = F.when(F.col("__value").isNull(), -1).otherwise(F.col("__bucket").cast("int"))
    return cut.withColumn("__slice", place).drop("__value", "__bucket"), len(splits) - 1


def _headed(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows with one more at the head of a slice, marked by __real."""
    return heads.withColumn("__real", F.lit(False)).unionByName(rows.withColumn("__real", F.lit(True)), allowMissingColumns=True)


def with_prior(df: DataFrame, key: list[str], order: list[str], values: list[str], slice_rows: int | None = None) -> DataFrame:
    """`df` with __prior, the `values` of the row before in the order within its key; null for the first row of a key."""
    rows, parts = sliced(df, order[0], slice_rows)
    value, own = F.struct(*values), Window.partitionBy(*key, "__slice")
    if parts == 1:
        return rows.withColumn("__prior", F.lag(value).over(own.orderBy(*order))).drop("__slice")
    last = rows.groupBy(*key, "__slice").agg(F.max_by(value, F.struct(*order)).alias("__last"))
    heads = last.withColumn("__head", F.lag("__last").over(Window.partitionBy(*key).orderBy("__slice"))).where("__head IS NOT NULL").select(*key, "__slice", "__head")
    both = _headed(rows.withColumn("__head", value), heads)
    out = both.withColumn("__prior", F.lag("__head").over(own.orderBy("__real", *order))).where("__real")
    return out.select(*df.columns, "__prior")


def running_sum(df: DataFrame, key: list[str], order: list[str], value: Column, name: str, slice_rows: int | None = None) -> DataFrame:
    """`df` with the sum of `value` over the rows of its key up to and with its own; the order must be total."""
    rows, parts = sliced(df.withColumn("__add", value), order[0], slice_rows)
    own = Window.partitionBy(*key, "__slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if parts > 1:
        sums = rows.groupBy(*key, "__slice").agg(F.sum("__add").alias("__sum"))
        earlier = Window.partitionBy(*key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        heads = sums.select(*key, "__slice", F.sum("__sum").over(earlier).alias("__add")).where("__add IS NOT NULL")
        rows = _headed(rows, heads.withColumn("__add", F.col("__add").cast(rows.schema["__add"].dataType)))
    else:
        rows = rows.withColumn("__real", F.lit(True))
    out = rows.withColumn(name, F.sum("__add").over(own.orderBy("__real", *order))).where("__real")
    return out.select(*[c for c in df.columns if c != name], name)


def slices(df: DataFrame, slice_rows: int | None = None) -> int:
    """The number of parts of about SLICE_ROWS rows that a table makes."""
    return max(1, math.ceil(df.count() / (slice_rows or SLICE_ROWS)))


def numbered(df: DataFrame, name: str, slice_rows: int | None = None) -> DataFrame:
    """`df` with numbers from 1 to its number of rows, each once; which row gets which follows from the rows alone.

    Rows that are equal are counted first and get their numbers in runs of RUN, which are dealt to slots of about
    SLICE_ROWS numbers, a task each; so a third of all rows may be the same. Columns must be of kinds that can be grouped by.
    """
    fields = df.columns
    parts = slices(df, slice_rows)
    equal = df.groupBy(*fields).agg(F.count("*").alias("__many"))
    runs = equal.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__many") - 1) / RUN))))
    size = F.least(F.lit(RUN).cast("long"), F.col("__many") - F.col("__run") * RUN)
    content = F.xxhash64(*fields, "__run")
    dealt = runs.select(*fields, "__run", size.alias("__size"), F.pmod(content, F.lit(parts)).cast("int").alias("__slot"))
    upto = F.sum("__size").over(Window.partitionBy("__slot").orderBy(content, *fields, "__run").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = dealt.groupBy("__slot").agg(F.sum("__size").alias("__total"))
    before = totals.select("__slot", F.coalesce(F.sum("__total").over(Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row per SLICE_ROWS rows
    # By id and number: few runs stand for many rows, and adaptive execution would put them all into one task.
    placed = dealt.repartitionById(parts, F.col("__slot")).withColumn("__upto", upto).join(F.broadcast(before), "__slot")
    first = F.col("__before") + F.col("__upto") - F.col("__size")
    return placed.withColumn("__first", first).withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__size")))).select(*fields, (F.col("__first") + F.col("__i")).alias(name))
