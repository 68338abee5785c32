"""Messages to cargo opportunities: extraction, matching, confidence, confirmation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairway.functions.scalars import clean_text, extract_phone, first_match, mean_truncated, normalize_tonnage, override, pair_mean, safe_date, text_or_null
from fairway.operators.match import candidates, match_entities, match_names

Extractor = Callable[[DataFrame], DataFrame]
FIELDS = ("origin", "dest", "commodity")

#: Messages of one text that are joined in one task, about.
PART_ROWS = 100_000


def extract_by_rules(messages: DataFrame) -> DataFrame:
    """The default extractor: adds origin_text, dest_text, commodity_text, tonnage, loading_date and contact_phone.

    A hosted model can take its place: any function that adds the same columns, for example by mapInPandas.
    """
    part = lambda pattern: first_match(F.col("__clean"), pattern, 1)
    return messages.withColumn("__clean", clean_text(F.col("raw_text"))).withColumns(
        {
            "origin_text": part(r"([^\s,.]+?)(?:到|至|->|→)"),
            "dest_text": part(r"(?:到|至|->|→)([^\s,.\d]+)"),
            "commodity_text": part(r"吨([^\s,.\d]+)"),
            "tonnage": normalize_tonnage(part(r"(\d[\d,.]*\s*(?:万|千)?吨)"), "fixed"),
            "loading_date": safe_date(part(r"(\d{4}-\d{2}-\d{2})")),
            "contact_phone": extract_phone(F.col("raw_text")),
        }
    ).drop("__clean")


def _heavy(out: DataFrame) -> DataFrame | None:
    """(__heavy, __parts): the texts of more than PART_ROWS fields and the parts that their messages make; None without such texts.

    They are at most three for PART_ROWS messages and become rows of the plan: a batch of a stream has no exchanges to
    reuse, and would count its texts anew for each use.
    """
    texts = _texts(out, *[f"{f}_text" for f in FIELDS]).where("text <> ''")
    found = texts.groupBy("text").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts")).where("parts > 1").collect()
    return out.sparkSession.createDataFrame([tuple(r) for r in found], "__heavy string, __parts long") if found else None


def _with_parts(df: DataFrame, text: str, heavy: DataFrame | None) -> DataFrame:
    one = F.lit(1).cast("long")
    if heavy is None:
        return df.withColumn("__parts", one)
    return df.join(F.broadcast(heavy), F.col(text) == F.col("__heavy"), "left").withColumn("__parts", F.coalesce("__parts", one)).drop("__heavy")


def _linked(out: DataFrame, found: dict[str, DataFrame], messages: DataFrame) -> DataFrame:
    """Messages with id, confidence and candidates of each field; `found` has a field's candidates() by text.

    A text that very many messages share meets them in parts, to which they are dealt by a hash of the columns of `messages`,
    so none is a task of its own; messages whose text is null or empty match nothing and are spread the same way.
    """
    heavy = _heavy(out)
    spread = F.xxhash64(*[c for c, kind in messages.dtypes if "map<" not in kind])  # maps have no hash
    for field, c in found.items():
        text = f"{field}_text"
        own = c.select(F.col("text").alias(text), F.col("matched_id").alias(f"{field}_id"), F.col("confidence").alias(f"{field}_confidence"), F.col("candidates").alias(f"{field}_candidates"))
        own = _with_parts(own, text, heavy).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1))).drop("__parts")
        part = F.when(F.coalesce(text, F.lit("")) == "", spread).otherwise(F.pmod(spread, F.col("__parts")))
        out = _with_parts(out, text, heavy).withColumn("__part", part).drop("__parts")
        out = out.join(own, [text, "__part"], "left").drop("__part").withColumn(f"{field}_confidence", F.coalesce(f"{field}_confidence", F.lit(0)))
    return out


def _texts(out: DataFrame, *columns: str) -> DataFrame:
    """The texts of some columns of all messages, to be matched in one pass; exploded, so that no filter computes them again."""
    return out.select(F.explode(F.array(*columns)).alias("text"))


def parse_messages(messages: DataFrame, nodes: DataFrame, commodities: DataFrame, extract: Extractor = extract_by_rules, threshold: int = 60) -> DataFrame:
    """Parse results of messages: texts, matches with candidates, overall confidence, status.

    Blank messages fail; others wait for confirmation, with confidence 0 where nothing matched. The distinct texts of
    origins and destinations meet the nodes once, those of goods the commodities.
    """
    out = extract(messages)
    ends = candidates(match_entities(_texts(out, "origin_text", "dest_text"), nodes, "text", threshold))
    goods = candidates(match_entities(_texts(out, "commodity_text"), commodities, "text", threshold))
    out = _linked(out, {"origin": ends, "dest": ends, "commodity": goods}, messages)
    overall = mean_truncated(*[F.col(f"{f}_confidence") for f in FIELDS])
    blank = clean_text(F.col("raw_text")) == ""
    return out.withColumn("overall_confidence", overall).withColumn("parse_status", F.when(blank, "PARSE_FAILED").otherwise("PENDING_CONFIRM"))


def parse_blended(messages: DataFrame, nodes: DataFrame, node_aliases: DataFrame, commodities: DataFrame, commodity_aliases: DataFrame, extract: Extractor) -> DataFrame:
    """Parse results of the older pipeline, over active entities and aliases of the second matcher.

    `extract` adds the texts, tonnage and the confidences origin_extracted, dest_extracted, commodity_extracted and
    tonnage_extracted; null counts as 0. A field's confidence is the mean of extraction and match where it matched, else
    the extraction's; the overall one is the mean of the three and the tonnage's, each cut to a whole number.
    """
    out = extract(messages)
    named = ("id", "name", "matched", "score", "priority")
    ends = candidates(match_names(_texts(out, "origin_text", "dest_text"), nodes, node_aliases, "node_id"), named)
    goods = candidates(match_names(_texts(out, "commodity_text"), commodities, commodity_aliases, "commodity_id"), named)
    out = _linked(out, {"origin": ends, "dest": ends, "commodity": goods}, messages)
    given = lambda f: F.coalesce(F.col(f"{f}_extracted"), F.lit(0)).cast("int")
    out = out.withColumns({f"{f}_confidence": blended_confidence(given(f), F.col(f"{f}_id"), F.col(f"{f}_confidence")) for f in FIELDS})
    overall = mean_truncated(*[F.col(f"{f}_confidence") for f in FIELDS], given("tonnage"))
    texts = {"tonnage_text": text_or_null(F.col("tonnage")), "tonnage_confidence": given("tonnage"), "overall_confidence": overall, "parse_status": F.lit("PENDING_CONFIRM")}
    return out.withColumns(texts)


def blended_confidence(extracted: Column, matched_id: Column, matched: Column) -> Column:
    """A field's confidence in the older pipeline: the mean of both where it matched, else the extraction's."""
    return F.when(matched_id.isNotNull(), pair_mean(extracted, matched)).otherwise(extracted)


def after_parse(messages: DataFrame, results: DataFrame) -> DataFrame:
    """Messages with their state after parsing."""
    r = results.select(F.col("id"), F.when(F.col("parse_status") == "PARSE_FAILED", "PARSE_FAILED").otherwise("PARSED").alias("__s")).dropDuplicates(["id"])
    return messages.join(r, "id", "left").withColumn("status", F.coalesce("__s", "status")).drop("__s")


def first_confirmations(results: DataFrame, confirmations: DataFrame, status: str = "parse_status") -> DataFrame:
    """The confirmation of each waiting result that counts: the first by confirmed_at, where there is such a column, then by all others; those after it find the result confirmed."""
    order = [c for c in ("confirmed_at", "operator_id") if c in confirmations.columns]
    fields = [*order, *[c for c in confirmations.columns if c not in ("id", *order)]]
    if not fields:
        return confirmations.distinct().join(results.where(F.col(status) == "PENDING_CONFIRM").select("id"), "id", "left_semi")
    first = confirmations.groupBy("id").agg(F.min(F.struct(*fields)).alias("__first")).select("id", "__first.*").select(confirmations.columns)
    return first.join(results.where(F.col(status) == "PENDING_CONFIRM").select("id"), "id", "left_semi")


def confirm(results: DataFrame, confirmations: DataFrame, fields: list[str], status: str = "parse_status") -> tuple[DataFrame, DataFrame]:
    """(opportunities, results) after confirmations (id, overriding fields and, if there are several of a result, confirmed_at).

    Only results that wait for confirmation are confirmed, each once, by the first of its confirmations; an override that
    is null, 0 or empty does not override. confirmation_records() has the audit records.
    """
    first = first_confirmations(results, confirmations, status)
    given = first.select("id", F.lit(True).alias("__hit"), *[F.col(f).alias(f"__o_{f}") for f in fields if f in first.columns])
    joined = results.join(given, "id", "left").withColumn("__ok", F.coalesce("__hit", F.lit(False)))
    merged = [(override(F.col(f"__o_{f}"), F.col(f)) if f in first.columns else F.col(f)).alias(f) for f in fields]
    opportunities = joined.where("__ok").select(F.col("id").alias("parse_result_id"), *merged, F.lit("ACTIVE").alias("status"), F.lit("AI").alias("input_type"))
    after = joined.withColumn(status, F.when(F.col("__ok"), "CONFIRMED").otherwise(F.col(status))).select(results.columns)
    return opportunities, after


def confirmation_records(opportunities: DataFrame, results: DataFrame, confirmations: DataFrame, status: str = "parse_status") -> DataFrame:
    """The audit record of each confirmation that counted, on the opportunity (parse_result_id, id) made of the result; `results` are those before."""
    first = first_confirmations(results, confirmations, status)
    pick = lambda c, kind: F.col(c) if c in first.columns else F.lit(None).cast(kind)
    made = first.select(F.col("id").alias("parse_result_id"), pick("operator_id", "long").alias("submitter_id"), pick("confirmed_at", "timestamp_ntz").alias("created_at")).join(opportunities.select("parse_result_id", F.col("id").alias("target_id")), "parse_result_id")
    data = F.to_json(F.struct(F.col("parse_result_id").alias("from_parse_result_id")))
    return made.select(F.lit("CARGO_OPPORTUNITY").alias("target_type"), "target_id", F.lit("CONFIRM").alias("action"), F.lit(None).cast("string").alias("before_data"), data.alias("after_data"), F.lit("APPROVED").alias("audit_result"), "submitter_id", "created_at")


def manual_opportunities(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) manual entries: nodes that are given must exist; accepted ones wait as PENDING."""
    known = nodes.select(F.col("id").alias("__id"), F.lit(True).alias("__known"))
    out = rows
    for c in ("origin_node_id", "dest_node_id"):
        out = out.join(known.withColumnRenamed("__known", f"__ok_{c}"), F.col(c) == F.col("__id"), "left").drop("__id")
    ok = (F.col("origin_node_id").isNull() | F.col("__ok_origin_node_id")) & (F.col("dest_node_id").isNull() | F.col("__ok_dest_node_id"))
    ok = F.coalesce(ok, F.lit(False))
    return out.where(ok).select(*rows.columns).withColumn("status", F.lit("PENDING")).withColumn("input_type", F.lit("MANUAL")), out.where(~ok).select(*rows.columns)
