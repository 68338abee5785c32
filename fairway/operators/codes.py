"""Hierarchical waterway codes WW-LL-NNN: basin, level, number among siblings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairway.operators.ordered import running_sum

#: The names that mark a basin, tested in this order; no name: the default.
BASINS = {
    "08": ["运河", "人工水道", "灌渠", "引水渠", "引水工程", "输水干线"],
    "07": ["海河", "永定河", "大清河", "子牙河", "漳卫河", "潮白河", "北运河"],
    "06": ["松花江", "嫩江", "牡丹江", "呼兰河", "拉林河"],
    "05": ["黑龙江", "乌苏里江", "图们江", "绥芬河", "额尔古纳河"],
    "04": ["珠江", "西江", "北江", "东江", "韩江", "桂江", "柳江", "郁江"],
    "03": ["黄河", "渭河", "汾河", "洛河", "湟水", "伊河", "无定河", "泾河"],
    "02": ["淮河", "颍河", "沙河", "涡河", "史河", "濉河"],
    "01": ["长江", "金沙江", "岷江", "嘉陵江", "汉江", "赣江", "湘江", "沱江", "乌江", "雅砻江", "大渡河", "清江", "资水", "沅江", "洞庭", "鄱阳"],
}
DEFAULT_BASIN = "01"


def basin(name: Column, parent_code: Column, basins: dict[str, list[str]] = BASINS, default: str = DEFAULT_BASIN) -> Column:
    """A well-formed parent code's basin; else the first whose names occur in the name; else the default."""
    own = F.lit(default)
    for code, words in reversed(basins.items()):
        own = F.when(reduce(lambda a, b: a | b, [name.contains(w) for w in words]), F.lit(code)).otherwise(own)
    return F.when(parent_code.rlike(r"^\d{2}-[^-]*-[^-]*$"), F.substring(parent_code, 1, 2)).otherwise(own)


def level_segment(level: Column, parent_id: Column) -> Column:
    return F.when(level == 3, "03").when(parent_id.isNull(), "01").otherwise("02")


def sequence_of(code: Column) -> Column:
    """The third part as a number; null where there is none."""
    return F.get(F.split(code, "-"), 2).try_cast("int")


def code(basin_: Column, level: Column, number: Column) -> Column:
    return F.format_string("%s-%s-%03d", basin_, level, number)


def single_code(name: Column, level: Column, parent_id: Column, parent_code: Column, max_sibling: Column) -> Column:
    """The code of one new row, given its siblings' largest code; one that doesn't parse restarts at 1."""
    return code(basin(name, parent_code), level_segment(level, parent_id), F.coalesce(sequence_of(max_sibling), F.lit(0)) + 1)


def allocate(new: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Codes for a batch of new rows (name, level, parent_id): numbers go on after the largest among the siblings, in this order.

    Numbers are taken from all siblings of a parent, whatever their basin and level, so codes are unique below a parent.
    A parent's new rows are counted in slices of the first order column, so a parent may have any number of them.
    """
    used = existing.groupBy("parent_id").agg(F.coalesce(F.max(sequence_of(F.col("code"))), F.lit(0)).alias("__used"))
    parents = existing.select(F.col("id").alias("__pid"), F.col("code").alias("__pcode"))
    rows = new.join(used.withColumnRenamed("parent_id", "__sid"), F.col("parent_id").eqNullSafe(F.col("__sid")), "left").join(parents, F.col("parent_id") == F.col("__pid"), "left")
    rows = running_sum(rows, ["parent_id"], order, F.lit(1).cast("long"), "__nth")
    number = F.coalesce("__used", F.lit(0)) + F.col("__nth")
    return rows.withColumn("code", code(basin(F.col("name"), F.col("__pcode")), level_segment(F.col("level"), F.col("parent_id")), number)).select(*new.columns, "code")


def repeated_codes(df: DataFrame) -> DataFrame:
    """Codes that occur more than once."""
    return df.groupBy("code").agg(F.count("*").alias("n")).where("n > 1")
