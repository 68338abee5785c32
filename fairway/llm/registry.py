"""Queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairway.llm import bpe_codec, exact_dedup, importance, license_scan, media, packing, runs, simhash, token_counts, topk, trie, url_filter, warc
from fairway.llm.bpe import VOCABULARY
from fairway.llm.common import materialise, table


#: Rules (action, host/path), and the hosts whose URLs label the training sample as bad.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
BAD_HOSTS = ["ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets"]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL under the rules and the trees."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.train(url_filter.seeded_labels(pages, BAD_HOSTS)), URL_RULES)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as PNG, read back and hashed."""
    return media.text_media(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log importance weight of every document, whether it is kept (all above the cut of the labels), and whether a sample of a quarter of all documents has it."""
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"], share=0.25)
    return out.select("doc_id", F.col("__weight").alias("log_weight"), F.col("__kept").alias("kept"), F.col("__sampled").alias("sampled"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), VOCABULARY, limit=2048)


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"), VOCABULARY)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of 4-word shingles of every document, linked at 4 or fewer differing bits."""
    out = simhash.simhash_components(table(spark, sf_dir, "documents"), words=4, bits=4)
    return out.select(F.col("id").alias("doc_id"), simhash.hex16(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices and texts in every document."""
    return license_scan.license_matches(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, keeper and digest of every document's text."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    archives = materialise(warc.write_archives(table(spark, sf_dir, "pages")), "warc")
    return warc.read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY, capacity=2048, end=0)


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for every 50th vector, by exact integer inner product."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return trie.conversation_trie(table(spark, sf_dir, "conversations"), every=100, kinds=6)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document."""
    return runs.run_digests(table(spark, sf_dir, "documents"), least=12, rewrite=True)


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_media": op2_media,
    "op3_quality": op3_quality,
    "op4_token_counts": op4_token_counts,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_simhash": op6_simhash,
    "op7_license_scan": op7_license_scan,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_warc": op9_warc,
    "op10_packing": op10_packing,
    "op11_topk": op11_topk,
    "op12_trie": op12_trie,
    "op13_runs": op13_runs,
}

#: A table (i, x) of the 256 remainders that CRC-32 looks up, in SQL.
_CRC = "SELECT i, i AS x FROM range(256) s(i)"
for _ in range(8):
    _CRC = f"SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END AS x FROM ({_CRC})"

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op8_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_NORM} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
    "op9_warc": """
        WITH t AS (SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS n FROM pages),
        g AS (SELECT *, CASE WHEN n >= 1000 AND page_id < max(page_id) OVER (PARTITION BY payload) THEN max(page_id) OVER (PARTITION BY payload) END AS top FROM t)
        SELECT page_id, n AS payload_bytes, sha1(payload) AS payload_digest, CASE WHEN top IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
               top AS refers_to, CAST(NULL AS VARCHAR) AS error
        FROM g""",
    "op11_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_trie": f"""
        WITH crc AS (SELECT list(x ORDER BY i) AS tab FROM ({_CRC})),
        l AS (SELECT conv_id AS c, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS label, length(coalesce(text, '')) AS chars
              FROM conversations WHERE conv_id IS NOT NULL),
        t AS (SELECT c, label, chars, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, label) - 1 AS i FROM l),
        n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
        k AS (SELECT c, n, c - c % 100 AS b,
                     xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda y: CAST(ascii(y) AS BIGINT))),
                                                 lambda acc, y: xor(acc >> 8, tab[(xor(acc, y) & 255) + 1]))) % 6 AS h
              FROM n, crc),
        v AS (SELECT k.c, k.b, k.h, least(k.h, coalesce(n.n, 0)) AS taken FROM k LEFT JOIN n ON n.c = k.b),
        r AS (SELECT v.c, t.i + 1 AS d, label, chars FROM v JOIN t ON t.c = v.b AND t.i < v.h
              UNION ALL SELECT v.c, t.i - v.h + v.taken + 1 AS d, label, chars FROM v JOIN t ON t.c = v.c AND t.i >= v.h
              UNION ALL SELECT c, 0, '', 0 FROM v),
        p AS (SELECT c, d, chars, md5(string_agg(label, '') OVER (PARTITION BY c ORDER BY d)) AS key FROM r),
        q AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS ends FROM p),
        m AS (SELECT key, d, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
                     sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM q GROUP BY key, d),
        kids AS (SELECT up, count(*) AS n FROM m GROUP BY up),
        s AS (SELECT DISTINCT a.key AS top, z.key FROM q a JOIN q z ON a.c = z.c AND z.d >= a.d),
        sums AS (SELECT s.top, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves, CAST(sum((m.n_convs - 1) * m.chars) AS BIGINT) AS saved_tokens
                 FROM s JOIN m ON m.key = s.key LEFT JOIN kids ON kids.up = s.key GROUP BY s.top)
        SELECT m.conv_id, m.d AS depth, o.conv_id AS parent_conv_id, m.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved_tokens, m.ends_sha256
        FROM m JOIN sums ON sums.top = m.key LEFT JOIN kids ON kids.up = m.key LEFT JOIN m o ON o.key = m.up""",
}
