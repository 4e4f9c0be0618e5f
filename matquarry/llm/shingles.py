"""Near duplicates by SimHash of word shingles and BK-trees, with an exact check.

Two texts are alike if the Jaccard similarity of their sets of shingles is ``SIMILARITY``
or more. Texts with equal sets are one node. A node has a SimHash of ``BANDS`` x ``BITS`` bits, dealt into as many
shards as there are bands, by their values; the first 128 bits are the fingerprint that the BK-tree of a shard holds. Nodes of a
shard at most ``RADIUS`` bits apart are candidates, and candidates of a shard that hang together are a bucket.

A bit of two sets differs with probability arccos(2s / (1 + s)) / pi at similarity s: 0.152 at 0.8. So a pair at 0.8 shares
a shard with probability 1 - (1 - 0.848^16)^96, 0.999 (0.998 where sets are small), and is more than 34 of 128 bits apart with probability 0.0002; nearer pairs are
lost less often. The bits of small sets differ more often, so sets of at most ``SHORT`` shingles also share buckets with what is like them by
their least shingles, which loses none: of n shingles, n - ceil(0.8 n) + 1 must hold one in common.

Candidates are linked only if their whole sets are alike, and linked nodes form components.
A bucket is searched in rounds: its leaders meet all its nodes. Leaders are
those whose place in one order of all nodes is in a share of the bucket that holds about ``FIRST``
nodes at first and ``GROWTH`` times as many each round, so all of them in the end. Pairs that earlier rounds
put into one component are left out, and so are buckets inside one component: a bucket of many copies is settled by few leaders, and
only unlike nodes of a bucket are compared in full. The search ends when no bucket holds two components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bkforest
from .common import map_texts, materialise
from .simhash import connected_components, digest, keep_heads

SEED, WIDTH, SIMILARITY = 42, 5, 0.8
BANDS, BITS, RADIUS = 96, 16, 34
#: Sets that also meet by their least shingles.
SHORT = 16
#: Fingerprints of a shard beyond which it is cut; one of ``PROBED`` nodes is counted to find such shards.
SHARD_ROWS, PROBED = 4096, 16
#: Cut shards that are broadcast at most, and rows that a task searches at once (or one shard).
CUT_SHARDS, BLOCK = 100_000, 50_000
FIRST, GROWTH = 4, 8
LANES = np.arange(1, BANDS * BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words; A-Z count as a-z.

    A text of fewer words has its whole word sequence, which may be empty, as its one shingle."""
    words = text.lower().split()
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)) if words else ends
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    spans = zip(starts[: 1 - width or None].tolist(), ends[width - 1 :].tolist())
    return np.array(sorted({xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans}), np.uint64)


def compact(hashes: np.ndarray) -> bytes:
    """The set by its hashes' upper halves, for comparing whole sets: two texts' few thousand shingles hardly ever share one by chance."""
    return np.unique(hashes >> np.uint64(32)).astype(np.uint32).tobytes()


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: each bit of the result hangs on all of the number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def simhash_bits(hashes: np.ndarray) -> np.ndarray:
    """The SimHash as packed bytes: a bit is 1 if it is set in over half of the shingles' ``BANDS`` x ``BITS`` bits."""
    total = np.zeros(BANDS * BITS, np.int64)
    # so many rows at once that counts fit a byte
    for at in range(0, len(hashes), 255):
        lanes = mixed(hashes[at : at + 255, None] + LANES)
        total += np.unpackbits(lanes.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(hashes))


def least_shingles(hashes: np.ndarray, similarity: float = SIMILARITY) -> list[int]:
    """Of a set that a set of at most ``SHORT`` shingles may be like: so many least hashes that alike sets share one; else none."""
    if len(hashes) > SHORT / similarity:
        return []
    # rounded first: 0.8 * 5 and the like are whole
    needed = math.ceil(round(similarity * len(hashes), 9))
    return hashes[: len(hashes) - max(1, needed) + 1].view(np.int64).tolist()


def marks(text: bytes, width: int = WIDTH, similarity: float = SIMILARITY) -> tuple:
    """SHA-256 of the text, hash and size of its shingle set, both halves of its fingerprint, its bands' values, its least shingles."""
    hashes = shingle_set(text, width)
    node = np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64)
    bits = simhash_bits(hashes)
    halves = bits[:16].view(np.int64).tolist()
    return hashlib.sha256(text).digest(), int(node), len(hashes), *halves, bits.view(np.int16).tolist(), least_shingles(hashes, similarity)


def _search_shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) of the buckets of a partition that is sorted by shard; equal buckets of several shards have one key."""

    def found(rows: list[np.ndarray]) -> pa.RecordBatch:
        shard, late, node, first, second = rows
        label = bkforest.components(shard, late.astype(bool), (first.view(np.uint64), second.view(np.uint64)), RADIUS)
        times = np.bincount(label, minlength=len(label))
        some = np.flatnonzero(times[label] > 1)
        some = some[np.argsort(label[some], kind="stable")]
        key = np.zeros(len(label), np.uint64)
        np.add.at(key, label[some], mixed(node[some].view(np.uint64)))
        arrays = [pa.array(key[label[some]].view(np.int64)), pa.array(node[some])]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "node"])

    held, n = [], 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in batch.columns])
        n += batch.num_rows
        if n >= BLOCK:
            rows = [np.concatenate(c) for c in zip(*held)]
            whole = int(np.searchsorted(rows[0], rows[0][-1]))
            if whole:
                yield found([c[:whole] for c in rows])
            held = [[c[whole:] for c in rows]]
            n -= whole
    if n:
        yield found([np.concatenate(c) for c in zip(*held)])


def bucket_nodes(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(key, node): the buckets of ``nodes`` (node, first, second, bands, least).

    Shards of more than about ``shard_rows`` nodes are cut, and each pair of cuts is a tree probed by the other. How many cuts a shard
    has is judged from a share of the nodes; any number of cuts gives the same links."""
    dealt = nodes.select("node", "first", "second", F.posexplode("bands").alias("band", "value"))
    dealt = dealt.select((F.col("band") * 65536 + F.col("value") + 32768).cast("long").alias("shard"), "node", "first", "second")
    hot = dealt.where(F.pmod(F.xxhash64("node"), F.lit(PROBED)) == 0).groupBy("shard").agg(F.count("*").alias("n"))
    hot = materialise(hot.where(F.col("n") * PROBED > shard_rows))
    shard, late = F.col("shard"), F.lit(0)
    if many := hot.count():
        dealt = dealt.join(F.broadcast(hot) if many <= CUT_SHARDS else hot, "shard", "left")
        dealt = dealt.withColumn("cuts", F.coalesce(F.ceil(F.col("n") * PROBED / F.lit(shard_rows)), F.lit(1)).cast("int"))
        own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("cuts")).cast("int")
        dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        low, high = F.least("own", "other"), F.greatest("own", "other")
        late = (F.col("own") > low).cast("int")
        shard = (F.col("shard") * 65536 + low) * 65536 + high
    dealt = dealt.select(shard.cast("long").alias("shard"), late.alias("late"), "node", "first", "second")
    searched = dealt.repartition("shard").sortWithinPartitions("shard", "late").mapInArrow(_search_shards, "key long, node long")
    short = nodes.select(F.explode("least").alias("key"), "node")
    return searched.union(short).distinct()


def _alike(batches: Iterable[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(v.as_py(), np.uint32) for v in (a, b))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(shared >= similarity * (len(x) + len(y) - shared))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def alike_links(marked: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float, shard_rows: int) -> DataFrame:
    """(u, root): every node that is like another one with the smallest node of its component."""
    firsts = [F.first(c).alias(c) for c in ("size", "first", "second", "bands", "least")]
    nodes = materialise(marked.groupBy("node").agg(*firsts, F.min("digest").alias("digest")))
    banded = materialise(bucket_nodes(nodes, shard_rows))
    buckets = materialise(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    order = F.pmod(F.xxhash64("node"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    members = banded.join(buckets, "key").join(nodes.select("node", "size"), "node")
    members = materialise(members.select("node", "size", "key", "n", (order * F.col("n")).alias("place")))
    wanted = members.select("node").distinct().join(nodes, "node").select("node", F.col("digest").alias("__digest"))
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), digest(F.col(f"`{text_col}`")).alias("__own"))
    texts = texts.join(materialise(wanted), F.col("__own") == F.col("__digest")).select("node", "text")
    sets = map_texts(texts, "node", "text", "hashes binary", lambda: lambda text: (compact(shingle_set(text, width)),))
    # rows that repeat a text give the same set
    sets = materialise(sets.groupBy("doc_id").agg(F.first("hashes").alias("hashes")))

    low, high = 0, FIRST
    largest = buckets.agg(F.max("n")).first()[0] or 0
    stars = docs.sparkSession.createDataFrame([], "u long, root long")
    while low < largest:
        named = members.join(stars, members["node"] == stars["u"], "left")
        named = materialise(named.select("key", "node", "size", "n", "place", F.coalesce("root", "node").alias("root")))
        several = named.groupBy("key").agg((F.min("root") < F.max("root")).alias("several")).where("several").select("key")
        unlike = materialise(named.join(several, "key", "left_semi"))
        if unlike.isEmpty():
            break  # each bucket is inside one component: no pair is left
        members = unlike.drop("root")  # a bucket inside one component stays so
        leaders = unlike.where((F.col("place") >= low) & (F.col("place") < high))
        leaders = materialise(leaders.select("key", F.col("node").alias("head"), F.col("size").alias("head_size"), F.col("place").alias("head_place"), F.col("root").alias("head_root")))
        met = unlike.join(leaders, "key").where("root <> head_root AND (place > head_place OR (place = head_place AND node > head))")
        met = met.where(F.least("size", "head_size") >= F.lit(similarity) * F.greatest("size", "head_size"))
        pairs = materialise(met.select(F.least("node", "head").alias("u"), F.greatest("node", "head").alias("v")).distinct())
        left = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("hashes").alias("a")), "u")
        both = left.join(sets.select(F.col("doc_id").alias("v"), F.col("hashes").alias("b")), "v").select("u", "v", "a", "b")
        found = materialise(both.mapInArrow(lambda batches: _alike(batches, similarity), "u long, v long"))
        if not found.isEmpty():
            stars = connected_components(found.union(stars))
            stars = materialise(stars.union(stars.select(F.col("root").alias("u"), "root").distinct()))
        low, high = high, high * GROWTH
    return stars


def drop_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    similarity: float = SIMILARITY,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``docs`` with one row of each component of alike texts, as ``keep_heads`` picks it.

    Null and empty texts are alike; ids may be null or repeat; other columns pass through;
    an empty table gives an empty result."""
    schema = "digest binary, node long, size int, first long, second long, bands array<short>, least array<long>"
    marked = materialise(map_texts(docs, id_col, text_col, schema, lambda: lambda text: marks(text, width, similarity)))
    stars = alike_links(marked, docs, id_col, text_col, width, similarity, shard_rows).withColumnRenamed("u", "node")
    rows = marked.select("doc_id", "digest", "node").join(stars, "node", "left")
    return keep_heads(docs, rows.select("doc_id", "digest", F.coalesce("root", "node").alias("root")), id_col, text_col)
