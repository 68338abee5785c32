"""Keyword search by an index: which rows a pattern may match follows from the trigrams of its literal parts.

A posting table (bucket, gram, id) has every run of three letters of the lower-cased columns, once a row. It is kept in
folders by bucket and sorted by gram, so a search reads the few buckets of its grams and skips most of these by their
statistics. Rows that have all grams of a pattern are candidates, and only they meet the pattern itself.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairway.operators.relational import keyword

#: Letters of a gram; folders of a posting table.
GRAM, BUCKETS = 3, 64


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _grams(text: Column) -> Column:
    starts = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM)))


def postings(rows: DataFrame, columns: list[str], id_col: str = "id") -> DataFrame:
    """(bucket, gram, id) of the rows' columns; nulls and texts of less than a gram have none."""
    grams = [_grams(F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in columns]
    all_ = F.array_distinct(reduce(F.concat, grams) if len(grams) > 1 else grams[0])
    return rows.select(F.col(id_col).alias("id"), F.explode(all_).alias("gram")).select(_bucket(F.col("gram")).alias("bucket"), "gram", "id")


def write_postings(rows: DataFrame, columns: list[str], path: str, id_col: str = "id") -> DataFrame:
    """Writes the posting table; one bucket is the work of many tasks, each with grams of its own."""
    made = postings(rows, columns, id_col).repartition("bucket", "gram").sortWithinPartitions("bucket", "gram")
    made.write.mode("overwrite").partitionBy("bucket").parquet(path)
    return open_postings(rows.sparkSession, path, dict(made.dtypes)["id"])


def open_postings(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    return spark.read.schema(f"gram string, id {id_type}, bucket int").parquet(path)


def literal_grams(word: str) -> list[str]:
    """The grams that any match of a pattern has: those of the runs between its wildcards % and _. A backslash takes the next letter as it is."""
    runs = re.findall(r"(?:\\.|[^%_\\])+", word, re.S)
    plain = [re.sub(r"\\(.)", r"\1", r, flags=re.S).lower() for r in runs]
    return sorted({r[i : i + GRAM] for r in plain for i in range(len(r) - GRAM + 1)})


def candidate_ids(posted: DataFrame, word: str) -> DataFrame | None:
    """(id) of the rows that have all grams of a word; None if it has no gram, and so any row may match."""
    grams = literal_grams(word)
    if not grams:
        return None
    spark = posted.sparkSession
    numbers = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram"))).distinct().collect()]  # as many as the word has grams
    hits = posted.where(F.col("bucket").isin(*numbers) & F.col("gram").isin(*grams))
    return hits.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= len(grams)).select("id")


def search(rows: DataFrame, posted: DataFrame, columns: list[str], word: str | None, id_col: str = "id") -> DataFrame:
    """The rows of which any of the columns contains the word, as keyword() has it, from the candidates of the postings.

    The postings must be of the same rows and columns (more columns do no harm). A word whose literal parts are shorter
    than a gram is looked for in all rows.
    """
    match = keyword(columns, word)
    found = candidate_ids(posted, word) if word else None
    return rows.where(match) if found is None else rows.join(found.withColumnRenamed("id", id_col), id_col, "left_semi").select(rows.columns).where(match)


def by_name_or_alias_indexed(nodes: DataFrame, aliases: DataFrame, node_postings: DataFrame, alias_postings: DataFrame, word: str) -> DataFrame:
    """Nodes whose name or any alias contains the word, by the postings of both tables (names by id, aliases by their id)."""
    named = search(nodes, node_postings, ["name"], word).select("id")
    called = search(aliases, alias_postings, ["alias_name"], word).select(F.col("node_id").alias("id"))
    return nodes.join(named.unionByName(called).distinct(), "id", "left_semi").select(nodes.columns)
