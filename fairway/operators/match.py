"""Linking of free text to entities: two matchers with their own scores, thresholds and tie-breaks.

The dictionary is cut into shards, the distinct texts into parts, and each pair of a shard and a part is a cell: one task
builds an index over the shard's forms (fairway.functions.similarity) and streams the part's texts past it. The index
says which forms equal a text, contain it, are contained in it or may be similar to it; only the last are compared, many
pairs at once. A cell returns no more than the best few of a text, and Spark merges those of the shards. So no pair of a
text and an entity is ever a row, no letter or word is a key, and memory is that of a shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairway.functions.scalars import strip_unicode
from fairway.functions.similarity import FormIndex

#: Forms (names and aliases) of the dictionary in a shard; texts, and about as many pairs, that are compared in one go.
SHARD_ROWS, TOGETHER, PAIRS = 50_000, 256, 250_000

Best = Callable[[list[str]], Iterator[list[tuple]]]


def _cells(asked: DataFrame, rows: DataFrame, key: str, forms: Column) -> tuple[DataFrame, int]:
    """(cell, is_text, text, t, row...) sorted by cell, dictionary first, and the number of shards.

    `forms` is the number of a row's forms. All rows of an entity are in one shard, by a hash of `key`. Dictionary and
    texts are dealt to shards times parts, of which there are as many as shuffle partitions; a larger dictionary has more
    shards and each fewer parts.
    """
    spark = rows.sparkSession
    shards = max(1, -(-(rows.agg(F.sum(forms)).first()[0] or 0) // SHARD_ROWS))
    parts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    shard = F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")
    left = rows.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("__cell", shard * parts + F.col("__part"))
    right = asked.withColumn("__shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("__cell", F.col("__shard") * parts + F.pmod(F.hash("text"), F.lit(parts)))
    left, right = left.drop("__part").withColumn("__asks", F.lit(0)), right.drop("__shard").withColumn("__asks", F.lit(1))
    both = left.unionByName(right, allowMissingColumns=True)
    return both.repartitionById(shards * parts, F.col("__cell")).sortWithinPartitions("__cell", "__asks"), shards


def _stream(build: Callable[[pa.Table], Best], schema: pa.Schema):
    """Per cell: build() makes a function of the dictionary's rows, which finds the best of TOGETHER texts at a time."""

    def answers(best: Best, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, compared = batch.column("text").to_pylist(), batch.column("__t").to_pylist()
        for a in range(0, len(texts), TOGETHER):
            found = [(text, *r) for text, rows in zip(texts[a : a + TOGETHER], best(compared[a : a + TOGETHER])) for r in rows]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found), schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, best = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("__cell").to_numpy() * 2 + batch.column("__asks").to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(keys)) + 1, len(keys)].tolist()
            for a, b in zip(cuts[:-1], cuts[1:]):
                part, of = batch.slice(a, b - a), int(keys[a]) // 2
                if of != cell:
                    cell, held, best = of, [], None
                if keys[a] % 2 == 0:
                    held.append(part)
                elif held or best:
                    if best is None:
                        best, held = build(pa.Table.from_batches(held)), []
                    yield from answers(best, part)

    return run


def dictionary(entities: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """(id, name, aliases) of all entities, aliases in the order of their ids."""
    lists = aliases.groupBy(F.col(key).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "alias_name"))), lambda x: x["alias_name"]).alias("aliases"))
    return entities.select("id", "name").join(lists, "id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def _distinct_texts(texts: DataFrame, text_col: str) -> DataFrame:
    """(text, __t): the distinct texts that can match, and how they are compared."""
    asked = texts.select(F.col(text_col).alias("text")).where("text is not null and text <> ''").distinct()
    return asked.withColumn("__t", F.lower(strip_unicode(F.col("text"))))


def rule_score(text: Column, name: Column, aliases: Column) -> Column:
    """(score, via) by the rules alone, the first that applies; null where none does."""
    either = lambda a, b: F.contains(a, b) | F.contains(b, a)
    made = lambda score, via: F.struct(F.lit(score).alias("score"), F.lit(via).alias("via"))
    return (
        F.when(text == name, made(100, "exact"))
        .when(F.array_contains(aliases, text), made(95, "alias_exact"))
        .when(either(text, name), made(85, "contains"))
        .when(F.exists(aliases, lambda a: either(text, a)), made(80, "alias_contains"))
    )


def _owners(pairs: list[tuple[str | None, object]]) -> tuple[list[str], list[list]]:
    """Distinct forms, and what has each of them."""
    by_form: dict[str, list] = {}
    for form, owner in pairs:
        if form is not None:
            by_form.setdefault(form, []).append(owner)
    return list(by_form), list(by_form.values())


def _compared(index: FormIndex, texts: list[str], ask: Callable[[str], tuple[dict | list, np.ndarray]]) -> Iterator[tuple]:
    """(what ask() says, candidates, their similarities) of each text; some PAIRS at a time, as a text may meet the whole shard."""
    held, pairs = [], 0
    for text in texts:
        held.append((text, *ask(text)))
        pairs += len(held[-1][1]) + len(held[-1][2])
        if pairs >= PAIRS or len(held) >= TOGETHER:
            yield from _ratios(index, held)
            held, pairs = [], 0
    yield from _ratios(index, held)


def _ratios(index: FormIndex, held: list[tuple]) -> Iterator[tuple]:
    if held:
        asked, said, found = zip(*held)
        yield from zip(said, found, index.ratios(list(asked), list(found)))


def _entities(threshold: int, top_k: int, fuzzy: bool, least: float):
    """The first matcher over the rows (id, name, __n, __a) of a shard: (id, name, score, via) of the best of each text."""
    rule = {(True, True): (100, "exact"), (True, False): (95, "alias_exact"), (False, True): (85, "contains"), (False, False): (80, "alias_contains")}

    def build(t: pa.Table) -> Best:
        ids, names, lower, aliases = (t.column(c).to_pylist() for c in ("id", "name", "__n", "__a"))
        forms, owners = _owners([(n, (e, True)) for e, n in enumerate(lower)] + [(a, (e, False)) for e, al in enumerate(aliases) for a in al or ()])
        index = FormIndex(forms)

        def ask(text: str) -> tuple[dict[int, tuple[int, str]], np.ndarray]:
            equal, inside, count = index.related(text)
            scores: dict[int, tuple[int, str]] = {}
            for f in inside.tolist():
                for e, is_name in owners[f]:
                    scores[e] = max(scores.get(e, (0, "")), rule[f == equal, is_name])
            if not fuzzy:
                return scores, np.zeros(0, np.int64)
            enough = heapq.nlargest(top_k, (s for s, _ in scores.values()))
            floor = max(least, enough[-1] / 100 - 1e-9) if len(enough) == top_k and least > 0 else least  # what is below can't come in
            return scores, index.candidates(text, count, floor, inside)

        def best(texts: list[str]) -> Iterator[list[tuple]]:
            for scores, cand, ratios in _compared(index, texts, ask):
                near: dict[int, tuple[int, bool]] = {}
                for f, r in zip(cand.tolist(), ratios.tolist()):
                    for e, is_name in owners[f]:
                        if e not in scores:
                            near[e] = max(near.get(e, (-1, False)), (int(r * 100), is_name))
                scores |= {e: (s, "fuzzy" if is_name else "alias_fuzzy") for e, (s, is_name) in near.items()}
                top = heapq.nsmallest(top_k, ((-s, ids[e], e) for e, (s, _) in scores.items() if s >= threshold))
                yield [(ids[e], names[e], -s, scores[e][1]) for s, _, e in top]

        return best

    return build


def match_entities(texts: DataFrame, entities: DataFrame, text_col: str = "text", threshold: int = 60, top_k: int = 3, fuzzy: bool = True, prune: bool = True) -> DataFrame:
    """(text, id, name, score, via, rank): up to top_k entities of each distinct text, best first, ties by id.

    Exact name 100, exact alias 95, containment 85, alias containment 80, else the similarity in whole percent. Empty
    and null texts match nothing; a blank one is contained in every name. Only texts are stripped; case never counts.
    Null names and aliases match nothing, and of rows that repeat an id each counts. prune=False compares all pairs.
    """
    asked = _distinct_texts(texts, text_col)
    rows = entities.select("id", "name", F.lower("name").alias("__n"), F.transform("aliases", lambda a: F.lower(a)).alias("__a")).where("id IS NOT NULL")
    cells, shards = _cells(asked, rows, "id", 1 + F.coalesce(F.array_size("__a"), F.lit(0)))
    kind = {f.name: f.dataType.simpleString() for f in entities.schema.fields}
    schema = pa.schema([("text", pa.string()), ("id", _arrow(kind["id"])), ("name", pa.string()), ("score", pa.int32()), ("via", pa.string())])
    least = threshold / 100 - 1e-9 if prune else 0.0
    found = cells.mapInArrow(_stream(_entities(threshold, top_k, fuzzy, least), schema), f"text string, id {kind['id']}, name string, score int, via string")
    rank = F.row_number().over(Window.partitionBy("text").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top_k)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def _names(threshold: float, top_k: int, fuzzy: bool, least: float):
    """The second matcher over the rows of a shard: (id, name, matched, score, priority, kind, order) of the best of each text, the last two of the entity's first row."""

    def build(t: pa.Table) -> Best:
        ids, names, matched, priority, kind, order, form = (t.column(c).to_pylist() for c in ("id", "name", "matched", "priority", "__kind", "__order", "__m"))
        forms, owners = _owners([(form[k], k) for k in range(len(ids)) if matched[k] != ""])
        index = FormIndex(forms)

        def ask(text: str) -> tuple[list[tuple[int, float]], np.ndarray]:
            equal, inside, count = index.related(text)
            return [(f, 1.0 if f == equal else 0.85) for f in inside.tolist()], index.candidates(text, count, least, inside) if fuzzy else np.zeros(0, np.int64)

        def best(texts: list[str]) -> Iterator[list[tuple]]:
            for scored, cand, ratios in _compared(index, texts, ask):
                entities: dict = {}  # per entity: its best row as (-score, place, row), and its first place
                for f, r in [*scored, *zip(cand.tolist(), ratios.tolist())]:
                    if r < threshold:
                        continue
                    for k in owners[f]:
                        place = (kind[k], order[k])
                        row = (-round(r * 100), place, k)
                        old = entities.get(ids[k])
                        entities[ids[k]] = (row, place) if old is None else (min(row, old[0]), min(place, old[1]))
                top = heapq.nsmallest(top_k, ((s, -priority[k] if priority[k] is not None else 2**40, first, k) for (s, _, k), first in entities.values()))
                yield [(ids[k], names[k], matched[k], min(-s, 100), priority[k], *first) for s, _, first, k in top]

        return best

    return build


def match_names(texts: DataFrame, entities: DataFrame, aliases: DataFrame, key: str, text_col: str = "text", threshold: float = 0.5, top_k: int = 5, prune: bool = True, fuzzy: bool = True) -> DataFrame:
    """(text, id, name, matched, score, priority, rank): the second matcher, over active entities and active aliases.

    Alias rows come before name rows (priority 5): equal 1.0, containment 0.85, else the similarity; both sides are
    stripped. At 0.5 or more a row counts, in percent rounded half to even. Of an entity the first row of the best score
    stays; ranks go by score, priority (null last), then the place of the entity's first row. Null forms match nothing;
    an entity's rows are together in a task. prune=False compares all pairs.
    """
    names = entities.where("status = 1")
    rows = aliases.where("status = 1").join(names.select(F.col("id").alias(key), "name"), key).select(F.col(key).alias("id"), "name", F.col("alias_name").alias("matched"), "priority", F.lit(0).alias("__kind"), F.col("id").alias("__order"))
    rows = rows.unionByName(names.select("id", "name", F.col("name").alias("matched"), F.lit(5).alias("priority"), F.lit(1).alias("__kind"), F.col("id").alias("__order")))
    rows = rows.withColumn("__m", F.lower(strip_unicode(F.col("matched")))).where("id IS NOT NULL")
    cells, shards = _cells(_distinct_texts(texts, text_col), rows, "id", F.lit(1))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    fields = [("text", "string"), ("id", kind["id"]), ("name", "string"), ("matched", "string"), ("score", "int"), ("priority", kind["priority"]), ("__kind", "int"), ("__order", kind["__order"])]
    schema = pa.schema([(c, _arrow(k)) for c, k in fields])
    least = threshold - 1e-9 if prune else 0.0
    found = cells.mapInArrow(_stream(_names(threshold, top_k, fuzzy, least), schema), ", ".join(f"{c} {k}" for c, k in fields))
    rank = F.row_number().over(Window.partitionBy("text").orderBy(F.desc("score"), F.desc("priority"), "__kind", "__order"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top_k).drop("__kind", "__order")


def candidates(matches: DataFrame, fields: tuple[str, ...] = ("id", "name", "score")) -> DataFrame:
    """(text, matched_id, confidence, candidates): one row per text with its ranked candidates."""
    lists = matches.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("__c"))
    return lists.select("text", F.col("__c")[0]["id"].alias("matched_id"), F.col("__c")[0]["score"].alias("confidence"), F.transform("__c", lambda c: F.struct(*[c[f].alias(f) for f in fields])).alias("candidates"))
