"""Changes to tables as joins: inserts, updates, deletes, upserts, replaced children, conflict checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairway.operators.ordered import numbered


def with_new_ids(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Fills null ids with the numbers after the largest id of both, each once and without gaps; rows with an id keep it."""
    fresh = numbered(rows.where("id IS NULL").drop("id"), "__number")
    top = existing.select("id").unionByName(rows.select("id")).agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    kind = rows.schema["id"].dataType
    made = fresh.crossJoin(F.broadcast(top)).withColumn("id", (F.col("__top") + F.col("__number")).cast(kind))  # the top is one row
    return rows.where("id IS NOT NULL").unionByName(made.select(rows.columns))


def absent(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key does not exist yet."""
    return rows.join(existing.select(*keys), keys, "left_anti")


def present(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key exists already: the conflicts of an insert, the accepted of a foreign key."""
    return rows.join(existing.select(*keys), keys, "left_semi")


def one_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows that repeat a key, the largest by its other columns in their order: a batch that names a key twice changes it once."""
    fields = [c for c in rows.columns if c not in keys]
    if not fields:
        return rows.distinct()
    return rows.groupBy(*keys).agg(F.max(F.struct(*fields)).alias("__row")).select(*keys, "__row.*").select(rows.columns)


def update_rows(df: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the changed values in place; null in a change leaves the old value. Of changes that repeat a key one_per_key() counts."""
    fields = [c for c in changed.columns if c not in keys]
    new = one_per_key(changed, keys).select(*keys, *[F.col(c).alias(f"__new_{c}") for c in fields])
    joined = df.join(new, keys, "left")
    return joined.select(*[F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns])


def delete_rows(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of their key; old keys without a new row stay as they are. Of new rows that repeat a key one_per_key() counts."""
    fields = [c for c in old.columns if c not in keys]
    renamed = one_per_key(new.select(*keys, *fields), keys).select(*keys, F.lit(True).alias("__is_new"), *[F.col(c).alias(f"__new_{c}") for c in fields])
    joined = old.join(renamed, keys, "full_outer")
    return joined.select(*keys, *[F.when(F.col("__is_new"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) for c in fields])


def replace_children(children: DataFrame, new: DataFrame, foreign: str, parents: DataFrame | None = None) -> DataFrame:
    """All children of the parents that the new list names (or of `parents`) give way to the new list."""
    touched = (parents if parents is not None else new).select(foreign).distinct()
    return children.join(touched, foreign, "left_anti").unionByName(new)
