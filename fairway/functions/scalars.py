"""Scalar functions on columns: text cleaning, phone and tonnage extraction, dates, distances, JSON."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType

from fairway.functions.similarity import block_ratios

EARTH_KM, WINDING = 6371.0, 1.5


def strip_unicode(c: Column) -> Column:
    """Strips all Unicode white space, which trim() does not."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """White space stripped and collapsed, full-width comma and stop replaced; null becomes empty."""
    flat = F.regexp_replace(strip_unicode(F.coalesce(c, F.lit(""))), r"(?U)\s+", " ")
    return F.translate(flat, "，。", ",.")


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """A group of the first match, null where there is none; the text is computed and searched once."""
    return F.get(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(0))


def extract_phone(c: Column) -> Column:
    """The first mobile number, also within a longer run of digits; null if there is none."""
    return first_match(c, r"(?U)1[3-9]\d{9}")


def normalize_tonnage(c: Column, mode: str = "compat") -> Column:
    """The first number as tons. compat: a unit after it appends its zeros to the text; fixed: the number times its unit."""
    if mode == "fixed":
        found = F.regexp_extract_all(F.regexp_replace(c, ",", ""), F.lit(r"\d+(?:\.\d+)?\s*[万千]?"), F.lit(0))
        tons = lambda t: F.regexp_replace(t, r"[^\d.]", "").try_cast("double") * F.when(t.endswith("万"), 10_000.0).when(t.endswith("千"), 1_000.0).otherwise(1.0)
        return F.round(F.get(F.transform(found, tons), F.lit(0)), 4)
    text = F.regexp_replace(F.regexp_replace(c, "万吨", "0000"), "千吨", "000")
    return first_match(text, r"\d+(?:\.\d+)?").try_cast("double")


def safe_date(c: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """The date, or null where the text is none."""
    return F.try_to_date(c, pattern)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2.0)
    return F.lit(EARTH_KM) * 2 * F.atan2(F.sqrt(a), F.sqrt(1.0 - a))


def waterway_km(straight: Column) -> Column:
    """Estimated distance by river."""
    return straight * F.lit(WINDING)


def json_rescue(c: Column, kind: str | DataType) -> Column:
    """The outermost JSON object in a text that may have fences or prose around it; null fields where it doesn't parse."""
    return F.from_json(F.regexp_extract(c, r"(?s)\{.*\}", 0), kind)


def percent_half_even(score: Column) -> Column:
    return F.bround(score * 100, 0).cast("int")


def percent_truncated(score: Column) -> Column:
    return (score * 100).cast("int")


def pair_mean(a: Column, b: Column) -> Column:
    return ((a + b) / 2).cast("int")


def mean_truncated(*scores: Column) -> Column:
    """Mean of confidences, cut to a whole number; null counts as 0."""
    return (sum((F.coalesce(s, F.lit(0)) for s in scores), F.lit(0)) / len(scores)).cast("int")


def override(new: Column, stored: Column) -> Column:
    """The new value, unless it is null, zero or empty, which never override."""
    text = new.cast("string")
    return F.when((text != "") & F.coalesce(text.try_cast("double") != 0, F.lit(True)), new).otherwise(stored)


def text_or_null(c: Column) -> Column:
    """A number as text; null where it is null or zero."""
    return F.when(c != 0, c.cast("string"))


def ratio_udf(least: float = 0.0):
    """The similarity as a function of two columns, first text first: it is not symmetric. 0 where either is empty or null; ratios below `least` may come out as 0."""

    @F.pandas_udf(DoubleType())
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        n, m = (x.str.len().fillna(0) for x in (a.astype("object"), b.astype("object")))
        asked = (n > 0) & (m > 0) & (2.0 * np.minimum(n, m) >= least * (n + m))
        out = np.zeros(len(a))
        out[asked.to_numpy(bool)] = block_ratios(a[asked].tolist(), b[asked].tolist())
        return pd.Series(out, dtype="float64")

    return similarity


similarity_ratio = ratio_udf()


def ratio_bound(a: Column, b: Column) -> Column:
    """No pair's similarity_ratio() exceeds this."""
    total = F.length(a) + F.length(b)
    return F.when(total > 0, 2.0 * F.least(F.length(a), F.length(b)) / total).otherwise(0.0)


def register(spark) -> None:
    """The functions for use in SQL text: similarity_ratio, haversine_km, waterway_km, tonnage_of and phone_of."""
    spark.udf.register("similarity_ratio", similarity_ratio)
    sql = {
        "haversine_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE": f"{EARTH_KM}D * 2 * atan2(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)), sqrt(1 - (pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))",
        "waterway_km(straight DOUBLE) RETURNS DOUBLE": f"straight * {WINDING}D",
        "tonnage_of(t STRING) RETURNS DOUBLE": r"try_cast(nullif(regexp_extract(regexp_replace(regexp_replace(t, '万吨', '0000'), '千吨', '000'), '([0-9]+([.][0-9]+)?)', 1), '') AS DOUBLE)",
        "phone_of(t STRING) RETURNS STRING": r"nullif(regexp_extract(t, '1[3-9][0-9]{9}', 0), '')",
    }
    for head, body in sql.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
