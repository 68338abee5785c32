"""SimHash near-dedup: fingerprints, pigeonhole blocks, verified Hamming distance, connected components."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairway.llm.common import by_bytes, forget, group_bounds, materialise, rows_as_bytes, small, sorted_groups, tidy
from fairway.llm.textstream import mix, shingles, tokens

#: Members of a bucket that one task compares at once; larger buckets are dealt out as pairs of chunks.
CHUNK = 4096
#: Bytes of text, and hashes, that a task holds as objects or bits at once.
SEGMENT, BLOCK = 1 << 19, 1 << 15
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def segments(text: bytes, words: int, size: int = SEGMENT) -> Iterator[list[bytes]]:
    """The ASCII-lower-cased words of a text in segments of about `size` bytes that share words - 1 words, so that their shingles are the text's."""
    at, carry = 0, []
    while at < len(text):
        cut = _SPACE.search(text, at + size)
        end = cut.start() if cut else len(text)
        part = carry + text[at:end].lower().split()
        at = end
        if at >= len(text) or len(part) >= words:
            yield part
            carry = part[len(part) - words + 1 :] if words > 1 else []
        else:
            carry = part


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of ASCII-lower-cased words, repeats included, by segments; fewer words: of the whole sequence."""
    h = xxhash.xxh64_intdigest
    many = False
    for w in segments(text, words):
        if len(w) < words:
            if w and not many:
                yield np.array([h(b" ".join(w), seed)], np.uint64)
            return
        many = True
        joined = b" ".join(w)
        ends = (np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1).tolist()
        starts = [0, *[e + 1 for e in ends[:-1]]]
        yield np.array([h(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :])], np.uint64)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per run of `hashes` (starts and end in `bounds`): the bits set in over half of it; zero for an empty run."""
    n = np.diff(bounds)
    sums = np.zeros((len(n), 64), np.int64)
    full = np.flatnonzero(n)
    at = 0
    while at < len(full):  # some BLOCK hashes at a time
        first = bounds[full[at]]
        if n[full[at]] > BLOCK:
            for s in range(first, bounds[full[at] + 1], BLOCK):
                sums[full[at]] += _bits(hashes[s : min(s + BLOCK, bounds[full[at] + 1])]).sum(0, dtype=np.int64)
            at += 1
            continue
        stop = max(at + 1, int(np.searchsorted(bounds[full + 1], first + BLOCK, side="right")))
        part = full[at:stop]
        sums[part] = np.add.reduceat(_bits(hashes[first : bounds[part[-1] + 1]]), bounds[part] - first, axis=0, dtype=np.int32)
        at = stop
    return np.packbits(sums * 2 > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SEGMENT):
            lists = [list(shingle_hashes(x, words)) for x in rows_as_bytes(batch.column("text"))]
            bounds = np.r_[0, np.cumsum([sum(map(len, x)) for x in lists])].astype(np.int64)
            flat = np.concatenate([np.empty(0, np.uint64), *(h for x in lists for h in x)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(majority(flat, bounds).view(np.int64))], names=["id", "fp"])

    return run


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp) of each row: 64-bit SimHash of its word shingles as a signed long; null and wordless texts give zero."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(_fingerprints(words)), "id long, fp long")


def blocks_for(n: int, bits: int) -> int:
    """Number of blocks: the cheapest for n fingerprints, counting each key as 500 comparisons."""
    cost = lambda b: comb(b, b - bits) * n * (500 + n / 2 / 2 ** (64 * (b - bits) / b))
    return min(range(bits + 1, bits + 6), key=cost)


def block_masks(blocks: int, bits: int) -> list[int]:
    """Fingerprints that differ in `bits` bits at most agree on one of these masks: blocks - bits blocks stay equal."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(masks, blocks - bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(bits: int, signature: str):
    """Within each bucket (sorted by g): a spanning forest of the nodes whose signatures differ in `bits` bits at most."""

    def apart(x: np.ndarray) -> np.ndarray:
        n = np.bitwise_count(x)
        return n[..., 0] if x.shape[-1] == 1 else n.sum(-1, dtype=np.int32)

    def pairs(sig: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, (1 << 20) // sig.size)
        for s in range(0, len(sig), step):
            a, b = np.nonzero(apart(sig[s : s + step, None] ^ sig[None, :]) <= bits)
            a += s
            keep = a < b
            yield a[keep], b[keep]

    def forest(sig: np.ndarray, node: np.ndarray) -> tuple[list[int], list[int]]:
        src, dst, total, found = [], [], 0, []
        if len(sig) <= 2 * CHUNK:
            for a, b in pairs(sig):
                found.append((a, b))
                total += len(a)
                if total > 50_000:
                    break
            else:
                root = list(range(len(sig)))

                def find(x: int) -> int:
                    while root[x] != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    return x

                for a, b in found:
                    for x, y in zip(a.tolist(), b.tolist()):
                        x, y = find(x), find(y)
                        if x != y:
                            root[max(x, y)] = min(x, y)
                for x in range(len(sig)):
                    if (r := find(x)) != x:
                        src.append(int(node[x]))
                        dst.append(int(node[r]))
                return src, dst
        left = np.arange(len(sig))
        while len(left):  # a dense bucket: breadth first, comparing with what is not reached yet
            front, left = [left[0]], left[1:]
            first = front[0]
            while front and len(left):
                near = apart(sig[left] ^ sig[front.pop()]) <= bits
                got = left[near]
                left = left[~near]
                front.extend(got.tolist())
                src.extend(node[got].tolist())
                dst.extend([int(node[first])] * len(got))
        return src, dst

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, "g"):
            g, node, sig = t.column("g").to_numpy(), t.column("node").to_numpy(), t.column(signature)
            sig = np.frombuffer(b"".join(sig.to_pylist()), "<u8") if pa.types.is_binary(sig.type) else sig.to_numpy().view(np.uint64)
            sig = sig.reshape(len(g), -1)
            edges = group_bounds(g)
            src, dst = [], []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if b - a > 1:
                    s, d = forest(sig[a:b], node[a:b])
                    src += s
                    dst += d
            if src:
                yield pa.RecordBatch.from_pydict({"u": pa.array(src, pa.int64()), "v": pa.array(dst, pa.int64())})

    return run


def bucket_links(keyed: DataFrame, bits: int, signature: str) -> DataFrame:
    """Links (u, v) that connect all nodes of a bucket g of `keyed` (g, node, signature) at `bits` or fewer differing bits.

    Only a spanning forest of each bucket is returned, never all its pairs. A bucket of more than CHUNK members is dealt
    out as pairs of chunks over many tasks.
    """
    large = materialise(keyed.groupBy("g").agg(F.count("*").alias("m")).where(F.col("m") > CHUNK), "simhash-large")
    if large.limit(1).count():
        chunks = F.ceil(F.coalesce("m", F.lit(1)) / F.lit(CHUNK)).cast("int")
        mine = F.pmod(F.xxhash64("node"), F.col("c")).cast("int")
        keyed = keyed.join(small(large), "g", "left").withColumn("c", chunks).withColumn("i", mine)
        keyed = keyed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        keyed = keyed.withColumn("g", F.when(F.col("c") == 1, F.col("g")).otherwise(F.xxhash64("g", F.least("i", "j"), F.greatest("i", "j"))))
    return keyed.select("g", signature, "node").repartition("g").sortWithinPartitions("g").mapInArrow(tidy(_links(bits, signature)), "u long, v long")


def close_links(distinct: DataFrame, bits: int) -> DataFrame:
    """Links (u, v) between nodes of `distinct` (node, fp) that connect all at `bits` or fewer differing bits."""
    n = distinct.count()
    masks = block_masks(blocks_for(n, bits), bits)
    keyed = distinct.select("fp", "node", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in masks])).alias("mask", "key"))
    return bucket_links(keyed.withColumn("g", F.xxhash64("mask", "key")), bits, "fp")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that `links` (u, v) touch; root is the smallest node of the component.

    Large-star and small-star rounds until nothing changes; each round is written to the shared folder.
    """
    edges = materialise(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "links")
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        star = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        star = materialise(star, "large-star")
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        new = star.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        old, edges = edges, materialise(new, "small-star")
        after = state(edges)
        forget(old)
        forget(star)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """(id, fp, component) per row: component is the smallest id reachable over links of `bits` or fewer differing bits.

    Equal fingerprints are one node, so copies cost nothing. Null texts and texts without words have the fingerprint
    zero, linked like any other. A row without an id gets the component of its fingerprint, null if no row that shares
    it has an id. Repeated rows give repeated rows; an empty table gives none. Other columns are ignored.
    """
    fps = materialise(fingerprints(df, id_col, text_col, words), "simhash")
    distinct = materialise(fps.groupBy("fp").agg(F.min("id").alias("node")), "simhash-distinct")
    links = close_links(distinct.where("node is not null"), bits)
    roots = components(links)
    lookup = distinct.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component"))
    return fps.join(lookup, "fp").select("id", "fp", "component")


#: near_duplicates(): 64-bit lanes of the wide fingerprint, MinHash bands that retrieve pairs, MinHashes of a band and in all.
LANES, BANDS, ROWS, HASHES = 4, 24, 5, 60
#: Members of a bucket that meet each other as pairs; in larger ones all meet the first, and those that it doesn't settle meet all.
FEW = 16
#: Shingles on each side of a meeting of chunks of a larger bucket.
MEETING = 1 << 17
_ODD = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_FLIP = mix(np.arange(1001, HASHES + 1001, dtype=np.uint64))
#: The MinHashes of each band: each hash is dealt to as many bands, in an order fixed by its mixed number.
_DECK = np.concatenate([np.argsort(mix(np.arange(i * HASHES, (i + 1) * HASHES, dtype=np.uint64)), kind="stable") for i in range(-(-BANDS * ROWS // HASHES))])[: BANDS * ROWS].reshape(BANDS, ROWS)


def retrieval_probability(similarity: float, tries: int = 20_000) -> float:
    """Chance that two sets with this Jaccard similarity share a band; the bands share hashes, so it is counted over random draws."""
    same = np.random.default_rng(0).random((tries, HASHES)) < similarity
    return float(same[:, _DECK].all(2).any(1).mean())


def band_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per run of `hashes` (starts and end in `bounds`), one key for each band; zeros for an empty run."""
    out = np.zeros((len(bounds) - 1, BANDS), np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        least = np.stack([np.minimum.reduceat((hashes ^ f) * o, bounds[full]) for f, o in zip(_FLIP, _ODD)], axis=1)
        for band, own in enumerate(_DECK):
            key = np.zeros(len(full), np.uint64)
            for i in own:
                key = mix(key + least[:, i])
            out[full, band] = key
    return out


def expected_bits(similarity: float, size: int, spread: float = 3.3) -> int:
    """Differing bits of `size`-bit SimHashes of sets with this Jaccard similarity, plus `spread` standard deviations."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(size * p + spread * np.sqrt(size * p * (1 - p)))


def distinct_shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct shingles of each text, and their bounds; of fewer words the whole sequence is the one shingle."""
    t = tokens(texts, lower=True, punctuation=False)
    n = np.bincount(t.owner, minlength=t.rows)
    h, at = shingles(t, words)
    owner = t.owner[at]
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        own = np.searchsorted(t.owner, short)
        whole = np.array([np.bitwise_xor.reduce(mix(t.hashes[a : a + n[r]] + np.arange(n[r], dtype=np.uint64))) for a, r in zip(own, short)], np.uint64)
        owner, h = np.r_[owner, short], np.r_[h, whole]
        order = np.argsort(owner, kind="stable")
        owner, h = owner[order], h[order]
    edges = np.searchsorted(owner, np.arange(t.rows + 1)).tolist()
    for a, b in zip(edges, edges[1:]):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    owner, h = owner[keep], h[keep]
    return h, np.searchsorted(owner, np.arange(t.rows + 1))


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.ascontiguousarray(values).view(np.int64).ravel()))


def _wide(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SEGMENT):
            h, bounds = distinct_shingles(batch.column("text"), words)
            rows = np.arange(batch.num_rows + 1)
            wide = np.stack([majority(mix(h + np.uint64(i + 1)), bounds) for i in range(LANES)], axis=1)
            sizes = pa.array(np.diff(bounds).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), sizes, _lists(band_keys(h, bounds), rows * BANDS), _lists(wide, rows * LANES)], names=["id", "digest", "n", "keys", "wide"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SEGMENT):
            yield pa.RecordBatch.from_arrays([batch.column("node"), _lists(*distinct_shingles(batch.column("text"), words))], names=["node", "shingles"])

    return run


def _meetings(similarity: float, bits: int):
    """Within each meeting (sorted by k): links between side 0 and either side, each verified, until no two that are similar are apart."""

    def links(side, node, wide, sets) -> Iterator[tuple[int, int]]:
        label = np.unique(node, return_inverse=True)[1]  # nodes of one label are connected
        size = np.array([len(s) for s in sets])
        for i in np.flatnonzero(side == 0):
            near = (np.bitwise_count(wide ^ wide[i]).sum(1) <= bits) & (label != label[i])
            near &= np.minimum(size, size[i]) >= similarity * np.maximum(size, size[i]) - 1e-9
            for j in np.flatnonzero(near):
                if label[i] != label[j]:
                    x, y = (sets[i], sets[j]) if size[i] < size[j] else (sets[j], sets[i])
                    both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
                    if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                        label[label == label[j]] = label[i]
                        yield int(node[i]), int(node[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, "k"):
            k, side, node = (t.column(c).to_numpy() for c in ("k", "side", "node"))
            wide = t.column("wide").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(k), LANES)
            lists = t.column("shingles").combine_chunks()
            flat, ends = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            edges = group_bounds(k)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                sets = [flat[ends[x] : ends[x + 1]] for x in range(a, b)]
                found = list(links(side[a:b], node[a:b], wide[a:b], sets))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["u", "v"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets of shingles have at least this Jaccard similarity, counted exactly."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").withColumn("both", F.size(F.array_intersect("u_set", "v_set")))
    return both.where(F.col("both") >= similarity * (F.size("u_set") + F.size("v_set") - F.col("both")) - 1e-9).select("u", "v")


def near_links(distinct: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (u, v) that connect the nodes of `distinct` (node, n, keys, wide, id, digest) that share a band and are this similar.

    Only numbers of nodes are in the buckets. In a bucket of FEW members or fewer all meet; in a larger one all meet the
    first, and only those that it does not settle meet the others, dealt out as chunks over many tasks. What meets is
    compared by the Hamming distance of the SimHashes, then exactly by the sets of shingles.
    """
    bits = expected_bits(similarity, 64 * LANES)
    keyed = distinct.select("node", F.posexplode("keys").alias("band", "key")).select(F.xxhash64("band", "key").alias("g"), "node")
    buckets = materialise(keyed.groupBy("g").agg(F.count("*").alias("m"), F.min("node").alias("first")).where("m > 1"), "near-buckets")
    members = materialise(keyed.join(small(buckets), "g"), "near-members")
    few = members.where(F.col("m") <= FEW)
    pairs = few.select("g", F.col("node").alias("u")).join(few.select("g", F.col("node").alias("v")), "g").where("u > v").select("u", "v")
    stars = members.where((F.col("m") > FEW) & (F.col("node") != F.col("first"))).select(F.col("node").alias("u"), F.col("first").alias("v"))
    info = lambda c: distinct.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("wide").alias(f"{c}_wide"))
    met = pairs.unionByName(stars).distinct().join(info("u"), "u").join(info("v"), "v")
    apart = sum((F.bit_count(F.col("u_wide")[i].bitwiseXOR(F.col("v_wide")[i])) for i in range(LANES)), F.lit(0))
    sizes = F.least("u_n", "v_n") >= similarity * F.greatest("u_n", "v_n") - 1e-9
    close = materialise(met.where(sizes & (apart <= bits)).select("u", "v"), "near-close")

    def sets_of(nodes: DataFrame) -> DataFrame:
        who = materialise(distinct.join(nodes, "node", "left_semi").select("node", F.col("id").alias("__id"), F.col("digest").alias("__digest")), "near-wanted")
        rows = texts.join(small(who), (F.col("id") == F.col("__id")) & (F.col("digest") == F.col("__digest"))).select("node", "text")
        return materialise(rows.mapInArrow(tidy(_sets(words)), "node long, shingles array<long>").dropDuplicates(["node"]), "near-sets")

    sets = sets_of(close.select(F.col("u").alias("node")).unionByName(close.select(F.col("v").alias("node"))).distinct())
    one = materialise(_verified(close.groupBy("u").agg(F.min("v").alias("v")), sets, similarity), "near-links")
    # pairs that one node connects already need no check
    up = one.select(F.col("u").alias("node"), F.col("v").alias("up"))
    over = lambda df, c: df.join(small(up.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))), c, "left").withColumn(f"{c}_up", F.coalesce(f"{c}_up", c))
    rest = over(over(close, "u"), "v").where("u_up <> v_up").select("u", "v")
    links = materialise(one.unionByName(_verified(rest, sets, similarity)), "near-links")
    # what the first member of a larger bucket leaves open
    large = members.where(F.col("m") > FEW)
    settled = links.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("first")).distinct()
    open_ = over(over(large.where(F.col("node") != F.col("first")), "node"), "first").where("node_up <> first_up").join(small(settled), ["node", "first"], "left_anti")
    open_ = materialise(open_.select("g", "node"), "near-open")
    if not open_.limit(1).count():
        return links
    whole = materialise(large.join(open_.select("g").distinct(), "g", "left_semi").select("g", "node").join(distinct.select("node", "n", "wide"), "node"), "near-whole")
    chunks = lambda c: F.greatest(F.lit(1), F.ceil(F.sum("n") / F.lit(MEETING))).cast("int").alias(c)
    asking = open_.join(distinct.select("node", "n", "wide"), "node")
    dealt = materialise(whole.groupBy("g").agg(chunks("cs")).join(asking.groupBy("g").agg(chunks("rs")), "g"), "near-chunks")
    turn = lambda count, seed: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(count)).cast("int")
    rows = lambda df, side, own, other: df.join(small(dealt), "g").select("g", "node", "wide", F.lit(side).alias("side"), turn(own, side).alias("own"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("other"))
    meet = rows(asking, 0, "rs", "cs").withColumn("k", F.xxhash64("g", "own", "other")).unionByName(rows(whole, 1, "cs", "rs").withColumn("k", F.xxhash64("g", "other", "own")))
    more = sets_of(whole.select("node").distinct())
    full = meet.select("k", "side", "node", "wide").join(more, "node").select("k", "side", "node", "wide", "shingles")
    return links.unionByName(full.repartition("k").sortWithinPartitions("k").mapInArrow(tidy(_meetings(similarity, bits)), "u long, v long"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component) per row; rows are linked whose distinct `words`-word shingles have this Jaccard similarity or more.

    Pairs that share one of BANDS bands of ROWS MinHashes of the shingles are compared, over 0.999 of those at 0.8,
    whatever was edited: by a SimHash of LANES * 64 bits over the distinct shingles, of which at most as many bits may
    differ as at that similarity plus 3.3 standard deviations, then exactly. No pair below the similarity is linked.
    Words are runs of letters and digits, A-Z lower-cased; texts of fewer words are one shingle, and texts without any
    are linked to none. Null texts count as empty; rows without an id are never linked (component null). Rows that share
    an id but not the text are judged each for itself; component is the smallest id of its group. An empty table gives none.
    """
    return _near(df, id_col, text_col, words, similarity).select("id", "component")


def _near(df: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """(id, digest, component) of near_duplicates(), with the hash of the text."""
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("digest"))
    fps = materialise(texts.mapInArrow(tidy(_wide(words)), "id long, digest long, n int, keys array<long>, wide array<long>"), "near-fingerprints")
    # texts of the same shingles are one node; its number is given once, when the table is written
    same = fps.where("id is not null and n > 0").groupBy("keys", "wide").agg(F.min("id").alias("id"), F.min_by("digest", "id").alias("digest"), F.min("n").alias("n"))
    distinct = materialise(same.withColumn("node", F.monotonically_increasing_id()), "near-distinct")
    roots = components(near_links(distinct, texts, words, similarity))
    linked = materialise(distinct.select("node", F.col("id").alias("least")).join(roots, "node"), "near-linked")
    best = materialise(linked.groupBy("root").agg(F.min("least").alias("best")), "near-best")
    print_ = [F.xxhash64("keys", "wide").alias("p"), F.xxhash64(F.lit(1), "keys", "wide").alias("q")]
    lookup = distinct.select(*print_, "node", "id").join(linked.join(small(best), "root").select("node", "best"), "node", "left").select("p", "q", F.coalesce("best", "id").alias("component"))
    rows = fps.select("id", "digest", "n", *print_).join(lookup, ["p", "q"], "left")
    return rows.select("id", "digest", F.when(F.col("n") == 0, F.col("id")).when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `df` that stay, with all their columns: of each group of near duplicates the one with the smallest id.

    Rows without an id stay; rows of the group that repeat the id of the one that stays, stay with it. Of rows that share
    an id only those go whose own text is a near duplicate.
    """
    found = _near(df, id_col, text_col, words, similarity)
    gone = materialise(found.where("component is not null and id <> component").select(F.col("id").alias("id"), "digest").distinct(), "near-gone").alias("gone")
    kept = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[id_col].cast("long").alias("id"), F.xxhash64(df[text_col].cast("string")).alias("digest"))
    return kept.join(small(gone), ["id", "digest"], "left_anti").select("row.*")


def hex16(fp) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
