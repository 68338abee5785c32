"""URL filter, quality classifier and license scan: rules, held-out accuracy, brute force."""

import os
import random
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fairway.llm import importance, license_scan, registry, url_filter
from fairway.llm.licenses import TEMPLATES

DATA = "/root/testdata/sf0.1"
URLS = [None, "", "no scheme", "http://", "HTTP://Example.COM/en/7?q=1", "x://Sub.b.COM/en/", "https://com/en/9", "https://dotcom/en/9", "http://a.example.com/en/8", "http://example.net/de/8", "http://example.net/de/9#f", "http://www.example.net/de/80", "ftp://a.org?x://b/c", "a://b://c/d", "http://h.org/es", "http://h.org/es/ö?ü", "http://user@h:80/p;q#x?y", "http://É.com/en/"]


def host_path(u):
    if u is None or "://" not in u:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1])
    return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]


def rule_of(host, path, rules):
    best = None
    for action, text in rules:
        name, slash, rest = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + rest) and (best is None or len(text) > len(best[1])):
            best = (action, text)
    return best


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(None, "http://a.com/en/1", "x")], "page_id long, url string, host string")
    for rate, own in ((0.0, "allow"), (1.0, "block")):
        got = {r.page_id: r for r in url_filter.judge(df, url_filter.UrlModel({}, rate), registry.URL_RULES).collect()}
        for i, u in [*enumerate(URLS), (None, "http://a.com/en/1")]:
            h, p = host_path(u)
            rule = rule_of(h, p, registry.URL_RULES)
            assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (h, p, rule[1] if rule else None, rule[0] if rule else own), u
    assert url_filter.judge(df.limit(0), url_filter.train(df.limit(0).withColumn("label", F.lit(1))), registry.URL_RULES).count() == 0


def test_entropy(spark):
    u = "http://abc.example.com/aabb?x=1&y=2#z"
    r = url_filter.lexical(spark.createDataFrame([(u,)], "u string"), F.col("u")).first()
    _, n = np.unique(list(u), return_counts=True)
    assert abs(r.f_entropy + (n / n.sum() * np.log2(n / n.sum())).sum()) < 0.25  # '#' is outside its alphabet
    assert (r.f_depth, r.f_parameters, r.f_labels, r.f_length, r["__suffix"], r["__site"]) == (1, 2, 2, len(u), "example.com", "abc.example.com")


def figures(out):
    """(precision, recall, rows) of verdicts against labels."""
    hit = F.sum(F.when((F.col("verdict") == "block") & (F.col("label") == 1), 1).otherwise(0))
    hits, blocked, bad, n = out.agg(hit, F.sum((F.col("verdict") == "block").cast("int")), F.sum("label"), F.count("*")).first()
    return hits / max(1, blocked), hits / max(1, bad), n


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_trees_on_held_out_urls_and_hosts(spark):
    """Held-out URLs of known hosts, and URLs of bad hosts that no training URL has."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    labelled = url_filter.seeded_labels(pages, registry.BAD_HOSTS).withColumn("page_id", F.xxhash64("url"))
    half = F.pmod("page_id", F.lit(2))
    model = url_filter.train(labelled.where(half == 0))
    precision, recall, n = figures(url_filter.judge(labelled.where(half == 1), model, []).join(labelled.select("page_id", "label"), "page_id"))
    print("held-out urls", precision, recall, n)
    assert n > 500 and precision > 0.9 and recall > 0.9
    assert sum(x > 0.01 for x in model.trees.featureImportances) >= 3  # several features are in use
    site = F.xxhash64(F.regexp_extract("url", "([^./]*)[.][^./]*[.][^./]*/", 1))
    there = F.pmod(site, F.lit(2)) == 0
    model = url_filter.train(labelled.where(~there))
    precision, recall, n = figures(url_filter.judge(labelled.where(there), model, []).join(labelled.select("page_id", "label"), "page_id"))
    print("held-out hosts", precision, recall, n)
    base = labelled.where(there).agg(F.avg("label")).first()[0]
    assert n > 500 and precision > 2 * base and recall > 0.3  # six bad hosts are few to learn from


def test_suffix_statistics_are_out_of_fold(spark):
    """A suffix that only one site has says nothing about it; one that other bad sites have does."""
    rows = [(f"http://a.s{i}.one{i}.com/x", i % 2, i) for i in range(60)] + [(f"http://w.s{i}.bad.com/x", 1, i) for i in range(40)]
    model = url_filter.UrlModel({}, 0.5)
    picked = url_filter.lexical(spark.createDataFrame(rows, "url string, label int, i int"), F.col("url")).withColumn("__fold", F.pmod("i", F.lit(5)))
    got = {r.url: r.f_suffix_rate for r in model.out_of_fold(picked).collect()}
    assert len(got) == 100
    assert all(got[u] == 0.5 for u, _, _ in rows[:60]) and all(got[u] > 0.8 for u, _, _ in rows[60:])


def test_kth_largest(spark):
    rnd = random.Random(0)
    keys = [rnd.choice([rnd.randint(-(10**12), 10**12), 5, -3]) for _ in range(2000)]
    df = spark.createDataFrame([(k,) for k in keys], "key long").cache()
    for k in (1, 2, 700, 1000, 1999, 2000):
        assert importance.kth_largest(df, k) == sorted(keys, reverse=True)[k - 1]
    assert importance.kth_largest(df, 3000) == min(keys)
    assert importance.kth_largest(df, 0) is None
    assert importance.kth_largest(df.limit(0), 5) is None


def test_best_cut():
    assert importance.best_cut([(-9, 0), (-7, 0), (1, 1), (2, 1)]) == -3
    assert importance.best_cut([(1, 1)]) == importance.best_cut([]) == -np.inf
    assert importance.best_cut([(1, 0), (1, 1)]) == -np.inf


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    seen = F.pmod("doc_id", F.lit(2)) == 0
    out = importance.resample(docs, labels.where(seen))
    test = out.join(labels.where(~seen).select("doc_id", "quality"), "doc_id").groupBy("quality").agg(F.avg(F.col("__kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in test}
    assert kept[1] > 0.99 and kept[0] < 0.05


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "good words here", 1), (2, "bad ### junk $$$", 1), (None, None, 1), (4, "", 1), (1, "good words here", 1)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    kept = importance.resample(docs, labels)
    assert kept.columns == [*docs.columns, "__weight", "__kept"]
    clash = docs.withColumns({c: F.lit("x") for c in ("__weight", "__kept", "__lid", "__text", "id", "row", "key", "c0")})
    again = importance.resample(clash, labels)
    assert again.columns == [*docs.columns, "__lid", "__text", "id", "row", "key", "c0", "__weight", "__kept"]
    assert again.select(kept.columns).exceptAll(kept).count() == 0 and again.where("key = 'x' and row = 'x'").count() == 5
    got = [(r.doc_id, r["__kept"]) for r in kept.collect()]
    assert (2, False) in got and got.count((1, True)) == 2
    assert importance.resample(docs, labels.limit(0)).where("__kept").count() == 5
    assert importance.resample(docs.limit(0), labels).count() == 0


def brute_weights(rows, good):
    """id -> weight of texts by hand: counts of words, pairs and repeated words in buckets, and the log of their ratio."""
    R, M = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
        return x ^ (x >> 31)

    def buckets(text):
        t = [x.encode() for x in re.findall(r"[A-Za-z0-9\x80-\U0010FFFF]+|[!-/:-@\[-`{-~]+", text or "")]
        h = [mix(sum((b + 1) * pow(R, i, 1 << 64) for i, b in enumerate(x)) & M) for x in t]
        words = [x for x, s in zip(h, t) if s[:1].isalnum() or s[0] >= 128]
        out = [mix(x) >> 50 for x in h] + [mix((a * R + b) & M) >> 50 for a, b in zip(h, h[1:])]
        return out + [0 for a, b in zip(words, words[1:]) if a == b]

    raw, target = np.ones(1 << 14), np.ones(1 << 14)
    for i, t in rows:
        for b in buckets(t):
            raw[b] += 1
            target[b] += i in good
    prior = max(1.0, 0.01 * target.sum())
    ratio = np.log((target - 1 + prior * raw / raw.sum()) / (target.sum() - (1 << 14) + prior)) - np.log(raw / raw.sum())
    return {i: sum(ratio[b] for b in buckets(t)) for i, t in rows}


def test_weights_and_sample_by_hand(spark):
    rnd = random.Random(31)
    word = lambda v: "".join(rnd.choice(v) for _ in range(3))
    rows = [(i, " ".join(word("abc" if i % 3 else "bcd") + rnd.choice(["", ",", " ab ab"]) for _ in range(rnd.randint(0, 9)))) for i in range(300)] + [(300, None)]
    good = {i for i in range(0, 300, 5) if i % 3}
    bad = {i for i in range(0, 300, 5) if not i % 3}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in good] + [(i, 0) for i in bad], "doc_id long, quality int")
    want = brute_weights(rows, good)
    unit = lambda i: (xxhash.xxh64_intdigest(struct.pack("<q", i), seed=xxhash.xxh64_intdigest(struct.pack("<i", 11), seed=42)) % (1 << 52) + 0.5) / (1 << 52)
    for k, temperature in ((100, 1.0), (40, 3.0), (None, 1.0)):
        got = {r.doc_id: r for r in importance.resample(docs, labels, k, temperature).collect()}
        assert all(abs(got[i]["__weight"] - w) < 1e-5 for i, w in want.items())
        n = k or sum(w >= importance.best_cut([(want[i], int(i in good)) for i in good | bad]) for w in want.values())
        noisy = sorted(want, key=lambda i: -(want[i] / temperature - np.log(-np.log(unit(i)))))[:n]
        assert {i for i, r in got.items() if r["__kept"]} == set(noisy)
        assert set(noisy) != set(sorted(want, key=lambda i: -want[i])[:n])  # the noise decides
        drawn = {r.doc_id for r in importance.resample(docs, labels, k, temperature, share=0.2).where("__sampled").collect()}
        assert drawn == set(sorted(want, key=lambda i: -(want[i] / temperature - np.log(-np.log(unit(i)))))[:61])  # a fifth of 301 rows


def test_gumbel_follows_the_weights(spark):
    """Sampling one of two rows in proportion 1 : 3."""
    df = spark.range(20_000).select("id", importance.gumbel_key(F.lit(0.0), F.col("id") * 2, 1).alias("a"), importance.gumbel_key(F.lit(float(np.log(3))), F.col("id") * 2 + 1, 1).alias("b"))
    assert abs(df.agg(F.avg((F.col("b") > F.col("a")).cast("int"))).first()[0] - 0.75) < 0.02


def test_trees_carry_over_to_hosts_that_they_have_not_seen(spark):
    """A made set of 360 hosts: bad URLs tend to digits, parameters, depth and length, good ones to plain paths, with overlap; a third of the hosts is held out."""
    rnd = random.Random(5)
    word = lambda n, letters="abcdefghijklmnopqrstuvwxyz": "".join(rnd.choice(letters) for _ in range(n))
    rows = []
    for h in range(360):
        bad = h % 2
        host = f"{word(rnd.randint(4, 12))}.{word(rnd.randint(4, 9))}.{rnd.choice(['com', 'net', 'org'] + ['xyz'] * bad)}"
        for _ in range(5):
            odd = rnd.random() < (0.97 if bad else 0.03)  # some look like the other kind in every respect
            deep = rnd.randint(3, 7) if rnd.random() < 0.1 + 0.8 * odd else rnd.randint(1, 3)
            path = "/".join(word(rnd.randint(3, 8), "0123456789abcdef" if odd else "aeilnorst") for _ in range(deep))
            args = "&".join(f"{word(2)}={word(6, '0123456789')}" for _ in range(rnd.randint(1, 5) if odd else rnd.randint(0, 1)))
            rows.append((len(rows), f"https://{host}/{path}" + (f"?{args}" if args else ""), bad, h % 3 == 0))
    df = spark.createDataFrame(rows, "page_id long, url string, label int, held boolean").repartition(3)
    model = url_filter.train(df.where("NOT held"))
    precision, recall, n = figures(url_filter.judge(df.where("held"), model, []).join(df.select("page_id", "label"), "page_id"))
    assert n == 600 and precision >= 0.9 and recall >= 0.9
    used = dict(zip(url_filter.FEATURES, model.trees.featureImportances.toArray()))
    assert sum(used[k] > 0.01 for k in ("length", "depth", "digit_ratio", "entropy", "parameters", "query_length", "path_length")) >= 3


def brute_licenses(text):
    words = lambda t: re.findall(r"[^\W_]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    found = {" ".join(words(text)[i : i + 5]) for i in range(len(words(text)) - 4)}
    out = set()
    for name, t in TEMPLATES.items():
        w = words(t)
        own = {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}
        if len(own & found) >= 0.8 * len(own):
            out.add(name)
    return out


def test_license_scan(spark):
    rnd = random.Random(6)
    noise = lambda n: " ".join("".join(rnd.choice("abcdefg") for _ in range(4)) for _ in range(n))
    texts = [None, "", "one two", noise(3000)]
    for t in TEMPLATES.values():
        texts += [t, t.upper(), f"{noise(rnd.randint(0, 50))} {t} {noise(rnd.randint(0, 200))}", noise(33) + "\n" + re.sub(r"\W+", "  ", t)]
        w = t.split()
        w[len(w) // 2] = "changed"
        texts += [noise(7) + " " + " ".join(w), " ".join(w[: len(w) // 2])]
    texts.append(noise(9) + " ".join(f" {t} {noise(30)}" for t in TEMPLATES.values()) * 2)
    df = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)] + [(None, TEMPLATES["mit"], "y")], "doc_id long, text string, template string")
    got = license_scan.license_matches(df).collect()
    names = {}
    for r in got:
        names.setdefault(r.doc_id, set()).add(r.template)
        if r.doc_id is not None:
            words = re.findall(r"[^\W_]+", texts[r.doc_id].lower())
            assert license_scan.WORDS <= r.end_word - r.start_word and r.end_word <= len(words) and 0.8 <= r.containment <= 1
    for i, t in enumerate(texts):
        assert names.get(i, set()) == brute_licenses(t or ""), i
    assert "mit" in names[None]
    last = [r.template for r in got if r.doc_id == len(texts) - 1]
    assert all(last.count(n) >= 2 for n in TEMPLATES)
    assert license_scan.license_matches(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [8, 16, 32, 64, 128, 256])
def test_collisions_are_nearly_certain(size):
    assert min(license_scan.collision_probability(size, w) for w in range(max(5, size // 2 + 1), size + 1)) > 0.999


def test_license_scan_of_changed_texts(spark):
    """Exact copies are whole, and what still has 0.8 of the shingles is found wherever words are changed."""
    rnd = random.Random(16)
    noise = lambda n: ["".join(rnd.choice("abcdefg") for _ in range(4)) for _ in range(n)]
    texts = [(name, t) for name, t in TEMPLATES.items()]
    for name, t in TEMPLATES.items():
        for n in [2, 3, 4] * 30:
            w = re.findall(r"[^\W_]+", t)
            for i in rnd.sample(range(len(w)), min(n, len(w))):
                w[i] = "changed"
            texts.append((name, " ".join(noise(rnd.randint(0, 40)) + w + noise(rnd.randint(0, 40)))))
    header = TEMPLATES["gpl-3.0-header"]
    texts.append(("gpl-3.0-header", f"{header} GNU General Public License GNU General Public License {header}"))
    got = license_scan.license_matches(spark.createDataFrame(list(enumerate(x for _, x in texts)), "doc_id long, text string")).collect()
    found = {(r.doc_id, r.template): r for r in got}
    for i, (name, t) in enumerate(texts):
        assert {n for d, n in found if d == i} == brute_licenses(t), (i, name)
        if i < len(TEMPLATES):
            assert found[i, name].containment == 1 and (found[i, name].start_word, found[i, name].end_word) == (0, len(re.findall(r"[^\W_]+", t)))
    assert [r.containment for r in got if r.doc_id == len(texts) - 1 and r.template == "gpl-3.0-header"] == [1, 1]


def test_shuffled_sentences_quotes_and_templates_that_repeat_themselves(spark):
    rnd = random.Random(21)
    noise = lambda n: " ".join("".join(rnd.choice("abcdefg") for _ in range(4)) for _ in range(n))
    line = "the terms and conditions of this license apply"
    own = {"repeats": f"{noise(20)} {line} {noise(20)} {line} {noise(20)} {line}", "long": " ".join(noise(30) + f" {line}." for _ in range(180)), "mit": TEMPLATES["mit"]}
    mit = TEMPLATES["mit"].split(". ")
    quoted = TEMPLATES["mit"].split()
    texts = {"exact": own["repeats"], "whole": f"{noise(50)} {own['long']} {noise(5)}", "shuffled": ". ".join(rnd.sample(mit, len(mit))), "quoted": " ".join(quoted[:80] + "Permission is hereby granted, free of charge".split() + quoted[80:])}
    df = spark.createDataFrame(list(texts.items()), "path string, value string")
    templates = license_scan.read_templates(spark.createDataFrame([*own.items(), ("short", "one two"), (None, "x"), ("none", None)], "path string, value string"))
    assert templates == own
    got = {(r.path, r.template): r.containment for r in license_scan.license_matches(df, templates, id_col="path", text_col="value").collect()}
    assert {k for k in got} == {("exact", "repeats"), ("whole", "long"), ("shuffled", "mit"), ("quoted", "mit")}
    assert got["exact", "repeats"] == got["whole", "long"] == 1 and got["quoted", "mit"] > 0.95


def test_occurrences_do_not_shadow_each_other():
    copy = lambda at, ids: [(at + k, k) for k in ids]
    whole, part = list(range(10)), [0, 1, 2, 3, 5, 6, 7, 8]
    assert license_scan.occurrences(copy(0, part) + copy(10, whole), 8, 30, 10) == [(0, 8, 8), (10, 19, 10)]
    assert license_scan.occurrences(copy(0, whole) + copy(10, part), 8, 30, 10) == [(0, 9, 10), (10, 18, 8)]
    assert license_scan.occurrences([(0, 5), (1, 4), (2, 3), (40, 2)], 3, 30, 10) == [(0, 2, 3)]
    assert license_scan.occurrences([], 1, 30, 10) == []
