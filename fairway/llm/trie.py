"""Prefix trie of conversations: a node for every distinct sequence of first turns, with counts rolled up from below.

1. Turns are numbered, each gets a digest of its role and text, and a prefix is known by the exclusive or of 128-bit
   hashes of (digest, depth): a running bit_xor, which also gives the parent. Texts don't move beyond the first exchange.
2. Nodes are an aggregate of prefixes. A node with more than `limit` rows below is heavy; each light child of a heavy
   node tops a shard, so a shard has at most `limit` nodes however hot a first turn or a conversation is.
3. Tasks build a succinct level-order trie (LOUDS: a bit string 1..10 per node, in level order, beside label arrays) over
   whole shards, and roll up leaves and savings by add.at from the last level to the first.
4. The heavy upper levels merge separately: chains of heavy nodes with the same members (they share smallest member and
   number) become one node, which leaves some 2 * rows / limit; the same trie is built over these, with the sums of the
   shards below. Along a chain, sums are a window over slices of SLICE levels.

Ids that end at a node are joined in chunks of at most 65,536 ids and hashed in a stream, so a node where a third of all
conversations end needs no memory for them. A prefix that another one's hash equals has a chance of 2**-128 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairway.llm.common import bounded, group_bounds, materialise, small, tidy

#: Turns of a conversation (and levels of a chain) that one window sees; nodes that a task builds into one trie at least.
SLICE, BUILT = 1 << 16, 1 << 16
#: Rows below a light node at most, whatever the size of the table, and at least.
LARGEST, LEAST = 1 << 18, 256

KEY = ["p0", "p1"]
EMPTY = hashlib.sha256(b"").hexdigest()


class Louds:
    """A forest in level order: one bit string, with node k's label at place k of any label array."""

    def __init__(self, degrees: np.ndarray, roots: int):
        zeros = np.cumsum(np.r_[roots, degrees] + 1) - 1  # a super-root, then the nodes: degree ones and a zero each
        self.bits = np.ones(int(zeros[-1]) + 1, bool)
        self.bits[zeros] = False

    def parents(self) -> np.ndarray:
        """Of each node, by rank: the zeros before its one, less that of the super-root; -1 for roots."""
        return np.cumsum(~self.bits)[self.bits] - 1

    def degrees(self) -> np.ndarray:
        """Of each node, by select: the ones between two zeros."""
        return np.diff(np.flatnonzero(~self.bits)) - 1


def level_order(own: np.ndarray, above: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, Louds, np.ndarray]:
    """Places of the nodes in level order, the trie, and where levels start; nodes are (n, 2) keys with their parents' keys.

    A node whose parent isn't among them is a root. Siblings are in order of their labels.
    """
    n = len(own)
    both = np.concatenate([own, above])
    order = np.lexsort((both[:, 1], both[:, 0]))
    sorted_ = both[order]
    group = np.empty(2 * n, np.int64)
    group[order] = np.cumsum(np.r_[False, (sorted_[1:] != sorted_[:-1]).any(1)]) if n else 0
    at = np.full(2 * n + 1, -1, np.int64)
    at[group[:n]] = np.arange(n)
    parent = at[group[n:]]
    by_parent = np.lexsort((label, parent))
    heads = parent[by_parent]
    first, last = np.searchsorted(heads, np.arange(-1, n)), np.searchsorted(heads, np.arange(-1, n), side="right")
    level, levels, starts, total = by_parent[: last[0]], [], [0], 0
    while len(level):
        levels.append(level)
        total += len(level)
        starts.append(total)
        sizes = last[level + 1] - first[level + 1]
        level = by_parent[np.repeat(first[level + 1] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
    places = np.concatenate(levels) if levels else np.zeros(0, np.int64)
    return places, Louds((last - first)[1:][places], int(last[0])), np.array(starts)


def roll_up(trie: Louds, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums over subtrees, in reverse level order."""
    out, parent = values.astype(np.int64), trie.parents()
    for a, b in zip(starts[1:-1][::-1].tolist(), starts[2:][::-1].tolist()):
        np.add.at(out, parent[a:b], out[a:b])
    return out


def _rolled(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, dict[str, np.ndarray], list]:
    """Level-order places and the new columns of a table of nodes; `more_*` are what hangs below besides."""
    col = {c: t.column(c).to_numpy() for c in t.schema.names}
    places, trie, starts = level_order(np.stack([col["p0"], col["p1"]], 1), np.stack([col["q0"], col["q1"]], 1), col["conv_id"])
    degree, parent, conv = trie.degrees(), trie.parents(), col["conv_id"][places]
    more = {k: col[k][places] if k in col else np.zeros(len(places), np.int64) for k in ("more_children", "more_leaves", "more_saved")}
    degree = degree + more["more_children"]
    leaves = roll_up(trie, starts, (degree == 0) + more["more_leaves"])
    saved = roll_up(trie, starts, col["own"][places] + more["more_saved"])
    above = pa.array(np.where(parent >= 0, conv[np.maximum(parent, 0)], 0), pa.int64(), mask=parent < 0)
    return places, {"n_children": degree, "n_leaves": leaves, "saved": saved}, above


def _build(passed: list[str], whole: bool = False):
    """Tries over batches sorted by shard (r0, r1): of all rows (whole), or of at least BUILT rows and whole shards."""

    def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        places, new, above = _rolled(t)
        kept = t.select(passed).take(pa.array(places))
        for name, x in new.items():
            kept = kept.append_column(name, pa.array(x, pa.int64()))
        yield from kept.append_column("above", above).to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if not whole and size >= BUILT:
                keys = np.stack([batch.column("r0").to_numpy(), batch.column("r1").to_numpy()], 1)
                new = (keys != np.concatenate([[last], keys[:-1]])).any(1)
                cut = int(np.argmax(new)) if new.any() else batch.num_rows
                held.append(batch.slice(0, cut))
                batch = batch.slice(cut)
                if batch.num_rows:
                    yield from out(held)
                    held, size = [], 0
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
                if not whole:
                    last = (batch.column("r0")[-1].as_py(), batch.column("r1")[-1].as_py())
        if held:
            yield from out(held)

    return run


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p0, p1, sha) of chunks sorted by node and chunk: a comma between chunks."""
    key, sha = None, None
    for batch in batches:
        done = []
        for p0, p1, text in zip(*(batch.column(c).to_pylist() for c in ("p0", "p1", "text"))):
            if (p0, p1) == key:
                sha.update(b",")
            else:
                if key:
                    done.append((*key, sha.hexdigest()))
                key, sha = (p0, p1), hashlib.sha256()
            sha.update(text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["p0", "p1", "ends_sha256"])
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, sha.hexdigest())], names=["p0", "p1", "ends_sha256"])


def numbered_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, i, label, chars): turns numbered from 0 by turn (null first), turns alike by label; label is the MD5 of role and text.

    A conversation is numbered in slices of SLICE turn values, which move the labels only. Rows without a conv_id take no part.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turn = F.col(turn_col).cast("long")
    label = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    part = F.when(turn.isNull(), F.lit(-(2**62))).otherwise(F.floor(turn / SLICE))
    rows = df.select(F.col(conv_col).cast("long").alias("conv_id"), turn.alias("turn"), part.alias("part"), label.alias("label"), F.length(text).cast("long").alias("chars")).where("conv_id IS NOT NULL")
    by_part = Window.partitionBy("conv_id", "part")
    local = F.row_number().over(by_part.orderBy(F.asc_nulls_first("turn"), "label")) - 1
    sizes = rows.groupBy("conv_id", "part").agg(F.count("*").alias("size"))
    before = sizes.select("conv_id", "part", F.coalesce(F.sum("size").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.withColumn("local", local).join(before, ["conv_id", "part"]).select("conv_id", (F.col("local") + F.col("before")).alias("i"), "label", "chars")


def rebuilt_turns(turns: DataFrame, every: int = 100, kinds: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns come from another one: (conv_id, d, label, chars, total) per turn, and (conv_id, total) per conversation.

    Conversation c has the first h turns of c - c % every (all, if there are fewer), then its own after the first h;
    h is crc32(decimal c) % kinds.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = convs.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % kinds, "base": F.col("conv_id") - F.col("conv_id") % every})
    sizes = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = convs.withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = materialise(convs.select("conv_id", "base", "h", "taken", "total"), "trie-conversations")
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("i") < kinds - 1)).withColumnRenamed("conv_id", "base")
    heads = heads.join(convs, "base").where("i < h").select("conv_id", (F.col("i") + 1).alias("d"), "label", "chars", "total")
    own = turns.join(convs, "conv_id").where("i >= h").select("conv_id", (F.col("i") - F.col("h") + F.col("taken") + 1).alias("d"), "label", "chars", "total")
    return heads.unionByName(own), convs.select("conv_id", "total")


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, d, p0, p1, q0, q1, chars, total): keys of each prefix and of its parent."""
    own = {"x0": F.xxhash64("label", "d"), "x1": F.xxhash64(F.lit("second"), "d", "label"), "part": F.floor((F.col("d") - 1) / SLICE)}
    running = Window.partitionBy("conv_id", "part").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.withColumns(own).withColumns({f"p{k}": F.bit_xor(f"x{k}").over(running) for k in (0, 1)})
    rows = materialise(rows.select("conv_id", "d", "part", *KEY, "x0", "x1", "chars", "total"), "trie-prefixes")
    if (rows.agg(F.max("total")).first()[0] or 0) > SLICE:  # later slices go on from the keys at the ends of those before
        ends = rows.where(F.col("d") % SLICE == 0).select("conv_id", (F.col("part") + 1).alias("part"), *KEY)
        carry = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        ends = ends.select("conv_id", "part", *(F.bit_xor(f"p{k}").over(carry).alias(f"c{k}") for k in (0, 1)))
        rows = rows.join(ends, ["conv_id", "part"], "left").withColumns({f"p{k}": F.col(f"p{k}").bitwiseXOR(F.coalesce(f"c{k}", F.lit(0))) for k in (0, 1)})
        rows = materialise(rows.drop("c0", "c1"), "trie-prefixes")
    return rows.select("conv_id", "d", *KEY, *(F.col(f"p{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"q{k}") for k in (0, 1)), "chars", "total")


def _ends(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(p0, p1, ends_sha256) of nodes where conversations end."""
    last = rows.where("d = total").select("conv_id", *KEY)
    last = last.unionByName(convs.where("total = 0").select("conv_id", F.lit(0).cast("long").alias("p0"), F.lit(0).cast("long").alias("p1")))
    chunks = last.groupBy(*KEY, F.shiftright("conv_id", 16).alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("text"))
    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").mapInArrow(tidy(_hash_ids), "p0 long, p1 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `turns` has (conv_id, d, label, chars, total), depths from 1 to total without gaps, `convs` every (conv_id, total)
    once, turnless ones too. Members of a node are the conversations that start with its turns; saved_tokens is, summed
    over the subtree, (members - 1) * chars of a node's last turn; ends_sha256 is of the members that end there, ascending.
    Without conversations there is no node, else the root is the node of depth 0. `limit` bounds a shard, not the result.
    """
    spark = bounded(turns.sparkSession)
    rows = _prefixes(turns)
    if limit is None:
        limit = max(LEAST, min(LARGEST, rows.count() // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    aggregates = [F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.first("q0").alias("q0"), F.first("q1").alias("q1"), F.sum(F.col("total") - F.col("d") + 1).alias("below")]
    nodes = rows.groupBy("d", *KEY).agg(*aggregates).withColumn("own", (F.col("n_convs") - 1) * F.col("chars")).drop("chars")
    nodes = materialise(nodes, "trie-nodes")
    heavy, light = nodes.where(F.col("below") > limit), nodes.where(F.col("below") <= limit)

    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("d"), "conv_id", "n_convs", *(F.lit(0).cast("long").alias(c) for c in ("p0", "p1", "own")), *(F.lit(None).cast("long").alias(c) for c in ("q0", "q1")))
    upper = materialise(heavy.select(root.columns).unionByName(root), "trie-upper")

    keys = small(upper.select(*KEY))
    first = rows.join(keys, KEY, "left_anti").join(keys.select(F.col("p0").alias("q0"), F.col("p1").alias("q1")), ["q0", "q1"], "left_semi")
    tops = first.select("conv_id", F.col("p0").alias("r0"), F.col("p1").alias("r1"))  # one per conversation at most
    sharded = light.join(tops, "conv_id").repartition("r0", "r1").sortWithinPartitions("r0", "r1")
    passed = ["d", "conv_id", "n_convs", *KEY, "q0", "q1"]
    kinds = ", ".join(f"{c} long" for c in [*passed, "n_children", "n_leaves", "saved", "above"])
    lower = materialise(sharded.select(*passed, "own", "r0", "r1").mapInArrow(tidy(_build(passed)), kinds), "trie-lower")

    # chains of heavy nodes with the same members, and what hangs below their last node
    path = ["conv_id", "n_convs"]
    chains = upper.groupBy(*path).agg(F.min("d").alias("d0"), F.max("d").alias("d1"), F.sum("own").alias("own"), F.min_by(F.struct("q0", "q1"), "d").alias("q"), F.max_by(F.struct(*KEY), "d").alias("p")).select(*path, "d0", "d1", "own", "q.q0", "q.q1", "p.p0", "p.p1")
    below = lower.where("above IS NULL").groupBy(F.col("q0").alias("p0"), F.col("q1").alias("p1")).agg(F.count("*").alias("more_children"), F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    chains = chains.join(below, KEY, "left").fillna(0, ["more_children", "more_leaves", "more_saved"])
    chains = chains.withColumns({"is_root": F.col("q0").isNull(), "q0": F.coalesce("q0", F.lit(-1)), "q1": F.coalesce("q1", F.lit(-1))})
    kept = [*path, "d0", "d1", "own"]
    kinds = ", ".join(f"{c} long" for c in [*kept, "n_children", "n_leaves", "saved", "above"])
    merged = chains.drop("is_root").repartition(1).mapInArrow(tidy(_build(kept, whole=True)), kinds).withColumnRenamed("own", "chain_own")
    merged = materialise(merged, "trie-chains")

    parts = upper.withColumn("part", F.floor(F.col("d") / SLICE))
    later = parts.groupBy(*path, "part").agg(F.sum("own").alias("own")).select(*path, "part", F.coalesce(F.sum("own").over(Window.partitionBy(*path).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("later"))
    down = F.sum("own").over(Window.partitionBy(*path, "part").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0))
    along = parts.withColumn("down", down).join(later, [*path, "part"]).join(small(merged), path)
    inside, last = F.col("d") > F.col("d0"), F.col("d") == F.col("d1")
    high = along.select("d", *path, *KEY, F.when(last, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves", (F.col("saved") - F.col("chain_own") + F.col("down") + F.col("later")).alias("saved"), F.when(inside, F.col("conv_id")).otherwise(F.col("above")).alias("above"))

    names = small(upper.select(F.col("p0").alias("q0"), F.col("p1").alias("q1"), F.col("conv_id").alias("of_upper")))
    low = lower.join(names, ["q0", "q1"], "left").withColumn("above", F.coalesce("above", "of_upper")).select(high.columns)
    out = high.unionByName(low).join(_ends(rows, convs), KEY, "left")
    return out.select("conv_id", F.col("d").alias("depth"), F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def conversation_trie(df: DataFrame, every: int = 100, kinds: int = 6, limit: int | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """prefix_trie() of the rebuilt_turns() of a table of turns. Null roles and texts count as empty; other columns are ignored."""
    return prefix_trie(*rebuilt_turns(numbered_turns(bounded_frame(df), conv_col, turn_col, role_col, text_col), every, kinds), limit)


def bounded_frame(df: DataFrame) -> DataFrame:
    bounded(df.sparkSession)
    return df


def plain_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The conversations as they are, for prefix_trie()."""
    turns = numbered_turns(bounded_frame(df), conv_col, turn_col, role_col, text_col)
    convs = materialise(turns.groupBy("conv_id").agg(F.count("*").alias("total")), "trie-conversations")
    return turns.join(convs, "conv_id").select("conv_id", (F.col("i") + 1).alias("d"), "label", "chars", "total"), convs
