"""Exact dedup by a Golomb-coded fingerprint exchange.

Each partition (sender) sorts the distinct fingerprints of its texts, marks those that it has more than once, and sends
every owner the part of its range as Rice-coded gaps. An owner decodes what it got, and answers each sender with a
bitmap of the fingerprints that stand for more than one row. Senders apply the bitmaps to their own rows, which are
written once and bucketed by sender: only rows under a marked fingerprint are suspects, whose texts are shuffled and
compared byte for byte. All other texts are known to be unique and never move; of them only ids and digests do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairway.llm.common import ascii_lower, group_bounds, in_place, materialise, small, sorted_groups, tidy

#: Bits of a fingerprint beyond the logarithm of the row count: a unique row is a suspect with a chance of 2**-SPARE.
SPARE = 12
#: Fingerprints in one coded piece at most, so that no row of the exchange grows with a partition; rows of an owner.
PIECE, OWNED = 1 << 16, 1 << 20


def rice_encode(values: np.ndarray, k: int) -> bytes:
    """Sorted distinct unsigned values as Rice-coded gaps: all quotients in unary, then the remainders of k bits."""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1)
    unary = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 1  # zeros, then a one
    rest = (gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(unary).tobytes() + np.packbits(rest.astype(np.uint8).ravel()).tobytes()


def rice_decode(data: bytes, n: int, k: int) -> np.ndarray:
    """The n values that rice_encode() wrote."""
    raw = np.frombuffer(data, np.uint8)
    split = len(raw) - -(-n * k // 8)
    quot = np.diff(np.flatnonzero(np.unpackbits(raw[:split]))[:n], prepend=-1) - 1
    rest = np.unpackbits(raw[split:])[: n * k].reshape(n, k).astype(np.uint64) << np.arange(k, dtype=np.uint64)
    return np.cumsum((quot.astype(np.uint64) << np.uint64(k)) | rest.sum(1, dtype=np.uint64), dtype=np.uint64)


def _send(bits: int, owners: int):
    """Per sender: pieces (owner, sender, piece, n, k, coded, own), own being the bitmap of fingerprints seen twice here."""
    width = -(-(1 << bits) // owners)

    def pieces(sender: int, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        seen, count = np.unique(h, return_counts=True)
        owner = seen // width
        edges = group_bounds(owner)
        for a, b in zip(edges[:-1], edges[1:]):
            for piece, s in enumerate(range(a, b, PIECE)):
                part, o = slice(s, min(b, s + PIECE)), int(owner[a])
                values = seen[part] - o * width
                k = max(0, int(np.log2(max(1, int(values[-1] - values[0]) // len(values)))))  # the code's parameter follows the mean gap
                yield pa.RecordBatch.from_pydict({"owner": [o], "sender": pa.array([sender], pa.int32()), "piece": [piece], "n": [len(values)], "k": [k], "coded": [rice_encode(values, k)], "own": [np.packbits(count[part] > 1).tobytes()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}  # a task of the bucketed table has the rows of few senders
        for b in batches:
            sender, h = b.column("sender").to_numpy(), b.column("h").to_numpy()
            for x in np.unique(sender).tolist():
                held.setdefault(x, []).append(h[sender == x])
        for x, parts in held.items():
            yield from pieces(x, np.concatenate(parts))

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per owner: the bitmap (sender, owner, piece, dup) of each piece's fingerprints that stand for more than one row."""
    for t in sorted_groups(batches, "owner"):
        ids = t.column("owner").to_numpy()
        for a, b in zip((e := group_bounds(ids))[:-1], e[1:]):
            rows = t.slice(a, b - a).to_pylist()
            flat = np.concatenate([rice_decode(r["coded"], r["n"], r["k"]) for r in rows])
            own = np.concatenate([np.unpackbits(np.frombuffer(r["own"], np.uint8))[: r["n"]] for r in rows]).astype(bool)
            _, back, count = np.unique(flat, return_inverse=True, return_counts=True)
            twice = count > 1
            twice[back[own]] = True
            dup, at = twice[back], 0
            for r in rows:
                got = dup[at : at + r["n"]]
                at += r["n"]
                if got.any():
                    yield pa.RecordBatch.from_pydict({"sender": pa.array([r["sender"]], pa.int32()), "owner": [r["owner"]], "piece": [r["piece"]], "dup": [np.packbits(got).tobytes()]})


def _marked(bits: int, owners: int):
    """Back at the sender: its fingerprints under the bitmaps that it received."""
    width = -(-(1 << bits) // owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                dup = np.unpackbits(np.frombuffer(r["dup"], np.uint8))[: r["n"]].astype(bool)
                values = rice_decode(r["coded"], r["n"], r["k"])[dup].astype(np.int64) + r["owner"] * width
                yield pa.RecordBatch.from_pydict({"sender": pa.array(np.full(len(values), r["sender"]), pa.int32()), "h": pa.array(values, pa.int64())})

    return run


def suspects(rows: DataFrame, n_rows: int) -> DataFrame:
    """(sender, h): the fingerprints of each sender that more than one of `rows` (sender, h) may share."""
    bits = fingerprint_bits(n_rows)
    owners = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // OWNED))
    schema = "owner long, sender int, piece long, n long, k long, coded binary, own binary"
    sent = materialise(rows.select("sender", "h").mapInArrow(tidy(_send(bits, owners)), schema), "golomb-sent")
    answers = sent.repartition("owner").sortWithinPartitions("owner").mapInArrow(tidy(_answer), "sender int, owner long, piece long, dup binary")
    marked = sent.join(answers, ["sender", "owner", "piece"])
    return materialise(marked.mapInArrow(tidy(_marked(bits, owners)), "sender int, h long"), "golomb-suspects")


def fingerprint_bits(n_rows: int) -> int:
    return min(52, max(16, int(np.ceil(np.log2(max(2, n_rows)))) + SPARE))


def _groups(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): `df` as a table in place with id, sha and its columns in `row`; (sha, keep, n) of the groups of two rows or more."""
    norm = lambda text: ascii_lower(F.coalesce(text.cast("string"), F.lit("")))
    n_rows = df.count()
    mask = (1 << fingerprint_bits(n_rows)) - 1
    slim = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[id_col].alias("id"), norm(df[text_col]).alias("norm"))
    hashed = slim.select("row", "id", F.unhex(F.sha2("norm", 256)).alias("sha"), F.xxhash64("norm").bitwiseAND(F.lit(mask).cast("long")).alias("h"))
    rows = in_place(hashed, "exact-rows", n_rows)
    marked = suspects(rows, n_rows)
    moved = rows.join(marked.hint("shuffle_hash"), ["sender", "h"], "left_semi").select("id", "sha", norm(F.col("row")[text_col]).alias("norm"))
    # the grouping key is the text itself: equal digests of unequal texts would give two rows here
    same = moved.groupBy("sha", "norm").agg(F.max("id").alias("keep"), F.count("*").alias("n"))
    groups = materialise(same.where("n > 1").select("sha", "keep", "n"), "exact-groups")
    if groups.groupBy("sha").count().where("count > 1").limit(1).count():
        raise ValueError("two texts share a SHA-256 digest; widen the digest")
    return rows, groups


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest id stays; rows
    that repeat both the id and the text of the row that stays are all `kept` (exact_dedup() leaves one of them). A row
    without an id is never kept unless its whole group has none; keep_id is then null and all of the group is kept. An
    empty table gives an empty result. Other columns are ignored.
    """
    rows, groups = _groups(df.select(df[id_col].alias("id"), df[text_col].alias("text")), "id", "text")
    out = rows.select("id", "sha").join(small(groups), "sha", "left")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` that stay, with all their columns: of equal texts the one with the largest id.

    Of rows that repeat the id and the text, one stays. Null texts count as empty, null ids as the smallest. The numbers
    of the rows that go are sent to their senders; the rows themselves don't move.
    """
    rows, groups = _groups(df, id_col, text_col)
    copies = materialise(rows.select("sender", "rid", "id", "sha").join(small(groups), "sha"), "exact-copies")
    stays = copies.where(F.col("id").eqNullSafe(F.col("keep"))).groupBy("sha").agg(F.min("rid").alias("stays"))
    gone = materialise(copies.join(stays, "sha").where("rid <> stays").select("sender", "rid"), "exact-gone")
    return rows.join(gone.hint("shuffle_hash"), ["sender", "rid"], "left_anti").select("row.*")
