"""URL filters: gradient-boosted trees on lexical features, under explicit host and path rules.

Everything is DataFrame columns and JVM-side trees: features are built-in functions, and the trees are trained on a
bounded sample of labelled URLs. Suffix statistics are the shares of bad URLs in that sample under the last label and
under the last two labels of the host; a training URL gets those of the other folds, and all URLs of a site are in one
fold, so that no label is read off its own site and the trees must carry over to hosts that they have not seen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairway.llm.common import LOWER, ascii_lower, materialise

#: Labelled URLs that the trees are trained on at most, folds of the suffix statistics, and URLs of the overall share that each suffix starts with.
SAMPLE, FOLDS, NEUTRAL = 20_000, 5, 10
SUFFIXES = ("top", "suffix")
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "host_entropy", "parameters", "query_length", "fragment", "top_rate", "suffix_rate")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits; rules are (action, host/path), for the host and all its subdomains."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _entropy(text: Column, characters: str) -> Column:
    """Bits a character of a lower-cased text; characters outside the set count as different ones."""
    n = F.greatest(F.length(text), F.lit(1))
    spread = reduce(lambda a, b: a + b, [F.when((c := _count(text, ch)) > 0, c * F.log2(c.cast("double"))).otherwise(0.0) for ch in characters])
    return F.log2(n.cast("double")) - spread / n


def lexical(df: DataFrame, url: Column) -> DataFrame:
    """Adds __host, __path, __top, __suffix, __site and the lexical features (f_...) of `url`."""
    df = df.withColumn("__url", F.coalesce(url, F.lit("")))
    host, path = host_path(F.col("__url"))
    df = df.withColumn("__host", host).withColumn("__path", path).withColumn("__low", ascii_lower(F.col("__url")))
    df = df.withColumn("__query", F.regexp_extract("__url", r"\?([^#]*)", 1))
    df = df.withColumn("__top", F.regexp_extract("__host", r"([^.]*)$", 1)).withColumn("__suffix", F.regexp_extract("__host", r"([^.]*\.?[^.]*)$", 1)).withColumn("__site", F.regexp_extract("__host", r"([^.]*\.?[^.]*\.?[^.]*)$", 1))
    found = {
        "length": F.length("__url"),
        "host_length": F.length("__host"),
        "path_length": F.length("__path"),
        "depth": _count(F.col("__path"), "/"),
        "labels": _count(F.col("__host"), "."),
        "digit_ratio": _count(F.col("__low"), "0123456789") / F.greatest(F.length("__low"), F.lit(1)),
        "entropy": _entropy(F.col("__low"), f"{LOWER}0123456789-./_=&?%:"),
        "host_entropy": _entropy(F.col("__host"), f"{LOWER}0123456789-."),
        "parameters": F.when(F.length("__query") > 0, _count(F.col("__query"), "&") + 1).otherwise(0),
        "query_length": F.length("__query"),
        "fragment": F.when(F.instr("__url", "#") > 0, 1).otherwise(0),
    }
    return df.withColumns({f"f_{k}": v.cast("double") for k, v in found.items()})


class UrlModel:
    """Trees over the lexical features and the suffix statistics; without both labels to learn from, a constant.

    rates: for each of SUFFIXES a written table (value, n, bad) of the training sample, SAMPLE rows at most.
    """

    def __init__(self, rates: dict[str, DataFrame], rate: float, trees=None):
        self.rates, self.rate, self.trees = rates, rate, trees

    def _share(self, bad: Column, n: Column) -> Column:
        """The share of bad URLs, drawn to the overall one."""
        return (F.coalesce(bad, F.lit(0.0)) + NEUTRAL * self.rate) / (F.coalesce(n, F.lit(0)) + NEUTRAL)

    def _vectors(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="__features", handleInvalid="keep").transform(df)

    def out_of_fold(self, picked: DataFrame) -> DataFrame:
        """The training sample with its suffix statistics, each row's from the other folds."""
        for k in SUFFIXES:
            own = picked.groupBy(f"__{k}", "__fold").agg(F.count("*").alias("__n1"), F.sum("label").alias("__bad1"))
            every = picked.groupBy(f"__{k}").agg(F.count("*").alias("__n"), F.sum("label").alias("__bad"))
            picked = picked.join(F.broadcast(own), [f"__{k}", "__fold"]).join(F.broadcast(every), f"__{k}")  # SAMPLE rows at most
            picked = picked.withColumn(f"f_{k}_rate", self._share(F.col("__bad") - F.col("__bad1"), F.col("__n") - F.col("__n1"))).drop("__n", "__bad", "__n1", "__bad1")
        return picked

    def blocked(self, df: DataFrame) -> DataFrame:
        """Adds __blocked to a lexical() frame."""
        if self.trees is None:
            return df.withColumn("__blocked", F.lit(self.rate > 0.5))
        for k in SUFFIXES:
            known = self.rates[k].select(F.col("value").alias(f"__{k}"), F.col("n").alias("__n"), F.col("bad").alias("__bad"))
            df = df.join(F.broadcast(known), f"__{k}", "left").withColumn(f"f_{k}_rate", self._share(F.col("__bad"), F.col("__n"))).drop("__n", "__bad")  # SAMPLE rows at most
        return self.trees.transform(self._vectors(df)).withColumn("__blocked", F.col("__prediction") > 0.5)


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", sample: int = SAMPLE, rounds: int = 20, depth: int = 4) -> UrlModel:
    """Trees from labelled URLs (1: block), on at most `sample` of them, the first by hash. Rows without label or URL don't count."""
    rows = labelled.select(F.col(url_col).alias("url"), F.col(label_col).cast("double").alias("label")).where("url is not null and label is not null")
    few = rows.orderBy(F.xxhash64("url"), "url", "label").limit(sample)
    fold = F.pmod(F.xxhash64("__site"), F.lit(FOLDS))
    picked = materialise(lexical(few, F.col("url")).withColumn("__fold", fold), "url-sample")
    n, bad = picked.agg(F.count("*"), F.sum("label")).first()
    model = UrlModel({}, (bad or 0.0) / max(1, n))
    if not n or bad in (0, n):
        return model
    model.rates = {k: materialise(picked.groupBy(F.col(f"__{k}").alias("value")).agg(F.count("*").alias("n"), F.sum("label").alias("bad")), f"url-{k}") for k in SUFFIXES}
    gbt = GBTClassifier(featuresCol="__features", labelCol="label", predictionCol="__prediction", maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=7)
    model.trees = gbt.fit(model._vectors(model.out_of_fold(picked)).select("__features", "label"))
    return model


def judge(df: DataFrame, model: UrlModel, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score columns) per row: the longest fitting rule decides, else the trees.

    Null URLs and URLs without `://` have an empty host and path, fit no rule, and are judged by the trees on their
    text. Null ids and repeated rows pass through; other columns are ignored.
    """
    seen = lexical(df.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("__given")), F.col("__given"))
    rule, action = rule_columns(F.col("__host"), F.col("__path"), rules)
    out = model.blocked(seen)
    own = F.when(F.col("__blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("__id").alias(id_col), F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"), F.coalesce(action, own).alias("verdict"), own.alias("model_verdict"))


def seeded_labels(df: DataFrame, words: list[str], url_col: str = "url") -> DataFrame:
    """(url, label) from a block list: words that mark known bad hosts. The trees carry it over to hosts that aren't listed."""
    host, _ = host_path(F.col(url_col))
    bad = reduce(lambda a, b: a | b, [host.contains(w) for w in words])
    return df.select(F.col(url_col).alias("url"), bad.cast("int").alias("label"))
