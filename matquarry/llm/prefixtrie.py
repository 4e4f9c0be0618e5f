"""Prefix trie of conversations by union-find over sorted neighbours.

A conversation is the sequence of its turns' digests. Distinct sequences are sorted by ranges; the
longest common prefix (LCP) of each with its neighbour is an edge. In each range a union-find takes
the edges in descending depth: what one merge joins is a branching node, and the depths between it and the next merge are
the nodes of an unbranched path. Nodes that reach beyond the range, the prefixes shared with the last sequence before or the first after it,
are contracted to sums that add up across ranges; all others are finished where they are found.

Of a node's values, members, leaves and children are sums over its sequences. So are its saved tokens: the words of all
members from its depth on, less the words of distinct turns there, each counted at the first sequence that has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, n_words

#: Bytes of a turn's digest.
WIDTH = 16
#: Sequences that a range aims at: its forest is held by one task.
RANGE_ROWS = 20_000
#: Ids in one packed piece of a list of members.
PACK = 5_000
#: Open nodes that are sent to all tasks at most; beyond it they meet their children through a shuffle.
BROADCAST = 100_000
BATCH = 5_000
NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, "
    "open binary, parent_open binary"
)


def turn_digest(role: Column, text: Column) -> Column:
    """MD5 of a turn, its role's length first, so that other splits of the same characters differ."""
    return F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text)))


def rebuilt(turns: DataFrame, step: int = 20, cycle: int = 4) -> DataFrame:
    """(conv_id, digests binary, words array): each conversation with the first turns of the one at the multiple of ``step`` before it.

    Turns are in order of turn (null first), equal ones by their digests; null roles and texts are empty. Turns without a conv_id belong
    to no conversation. A conversation of c takes crc32(c) % ``cycle`` turns from there, and its own after as many."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    each = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", turn_digest(role, text).alias("digest"), n_words(F.col("text")).cast("int").alias("words"))
    own = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "digest", "words"))).alias("own"))
    own = materialise(own.select("conv_id", F.transform("own", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("own")))
    heads = own.select(F.col("conv_id").alias("head_id"), F.slice("own", 1, cycle - 1).alias("head"))
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(cycle)).cast("int")
    both = own.join(heads, F.col("conv_id") - F.col("conv_id") % step == F.col("head_id"), "left").withColumn("taken", taken)
    none = F.array().cast("array<struct<digest:binary,words:int>>")
    whole = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("taken")), F.slice("own", F.col("taken") + 1, F.greatest(F.size("own"), F.lit(1))))
    both = both.select("conv_id", whole.alias("whole"))
    joined = F.unhex(F.array_join(F.transform("whole", lambda t: F.hex(t["digest"])), ""))
    return both.select("conv_id", joined.alias("digests"), F.transform("whole", lambda t: t["words"]).alias("words"))


def member_digests(members: DataFrame, key: str, member: str) -> DataFrame:
    """(key, ends): SHA-256 of each key's members in ascending order, comma-joined.

    Members are sorted by ranges and packed there, so a key with very many of them is read by its last task as few pieces,
    one after the other. A hash of a sequence cannot be had otherwise than in its order."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.select(F.col(key).alias("key"), F.col(member).cast("long").alias("member")).repartitionByRange(parts, "key", "member").sortWithinPartitions("key", "member")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, members = batch.column(0), batch.column(1).to_numpy()
            codes = np.asarray(keys.to_pylist(), dtype=object)
            new = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, int)
            starts = np.unique(np.concatenate([np.arange(a, b, PACK) for a, b in zip(new, [*new[1:], len(codes)])] or [np.zeros(0, int)]).astype(int))
            texts = [",".join(map(str, members[a:b].tolist())) for a, b in zip(starts, [*starts[1:], len(codes)])]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(starts)), pa.array(members[starts], pa.int64()), pa.array(texts, pa.string())], names=["key", "first", "text"])

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, done = None, None, []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(2)):
                if key != at or state is None:
                    if state is not None:
                        done.append((at, state.hexdigest()))
                    at, state = key, hashlib.sha256(text.as_py().encode())
                else:
                    state.update(b"," + text.as_py().encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], names=["key", "ends"])
                done = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends"])

    packed = dealt.mapInArrow(pack, "key binary, first long, text string")
    return packed.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, "key binary, ends string")


def lcp(a: bytes, b: bytes) -> int:
    """Turns that two sequences have in common at their beginning."""
    n = min(len(a), len(b))
    unlike = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(unlike[0]) // WIDTH if len(unlike) else n // WIDTH


def open_key(sequence: bytes, depth: int) -> bytes:
    return hashlib.sha256(sequence[: depth * WIDTH]).digest()


class Forest:
    """The nodes of one range of sorted distinct sequences; ``left`` and ``right`` are the LCPs with their neighbours outside (-1: none)."""

    def __init__(self, sequences: list[bytes], words: list, counts: np.ndarray, members: np.ndarray, ends: list[str], left: int, right: int) -> None:
        self.sequences, self.members, self.ends, self.left, self.right = sequences, members, ends, left, right
        self.lengths = [len(s) // WIDTH for s in sequences]
        self.edges = [lcp(a, b) for a, b in zip(sequences, sequences[1:])]
        before, after = [left, *self.edges], [*self.edges, right]
        self.known = [max(0, b) for b in before]  # depths of a sequence's path that an earlier one has too
        self.upto = [np.concatenate(([0], np.cumsum(w, dtype=np.int64))) for w in words]  # words of the first turns
        totals = np.array([u[-1] for u in self.upto])
        new = totals - np.array([u[k] for u, k in zip(self.upto, self.known)])
        self.counts, self.spoken, self.new, self.leaves = (
            np.concatenate(([0], np.cumsum(x, dtype=np.int64))) for x in (counts, counts * totals, new, np.less(after, self.lengths))
        )

    def nodes(self) -> Iterator[tuple]:
        """Rows of NODE. Edges are taken in descending depth; when all of one depth are merged, the paths of what they joined are complete."""
        size = len(self.sequences)
        above = list(range(size))  # union-find; a component's root is its first sequence
        last, top, least, children = list(range(size)), list(self.lengths), self.members.tolist(), [0] * size

        def first_of(i: int) -> int:
            while above[i] != i:
                above[i] = above[above[i]]
                i = above[i]
            return i

        joined: list[tuple] = []
        order = sorted(range(size - 1), key=lambda e: -self.edges[e])
        for at, edge in enumerate(order):
            depth, a, b = self.edges[edge], first_of(edge), edge + 1
            grown = 0
            for c in (a, b):
                if top[c] > depth:
                    joined.append((c, last[c], top[c], least[c], children[c]))
                    grown += 1
                else:
                    grown += children[c]  # already the node of this depth
            above[b], last[a], top[a], least[a], children[a] = a, last[b], depth, min(least[a], least[b]), grown
            if at + 1 == len(order) or self.edges[order[at + 1]] < depth:
                for lo, hi, up, low_id, kids in joined:
                    node = first_of(lo)
                    yield from self.path(lo, hi, up, depth, low_id, kids, (node, last[node], least[node]))
                joined = []
        yield from self.path(0, last[0], top[0], -1, least[0], children[0], None)

    def is_open(self, lo: int, hi: int, depth: int) -> bool:
        return (lo == 0 and depth <= self.left) or (hi == len(self.sequences) - 1 and depth <= self.right)

    def path(self, lo: int, hi: int, top: int, fork: int, least: int, kids: int, parent: tuple[int, int, int] | None) -> Iterator[tuple]:
        """The nodes of the sequences lo to hi at depths from ``top``, where there are ``kids`` children, to ``fork`` + 1, below the node ``parent``."""
        sequence, upto, known = self.sequences[lo], self.upto[lo], self.known[lo]
        n, spoken, leaves = (int(x[hi + 1] - x[lo]) for x in (self.counts, self.spoken, self.leaves))
        others = int(self.new[hi + 1] - self.new[lo + 1])
        for depth in range(top, fork, -1):
            begun = lo == 0 and depth < self.left  # the first child, in an earlier range
            distinct = others + int(upto[-1] - upto[max(depth - 1, known, 0)])
            saved = spoken - n * int(upto[max(depth - 1, 0)]) - distinct
            up_lo, up_hi, up_least = parent if depth == fork + 1 and parent else (lo, hi, least)
            up_open = depth > 0 and self.is_open(up_lo, up_hi, depth - 1)
            yield (
                least, depth, None if up_open or not depth else up_least, n, (kids if depth == top else 1) - begun, leaves, saved,
                self.ends[lo] if self.lengths[lo] == depth else None,
                open_key(sequence, depth) if self.is_open(lo, hi, depth) else None, open_key(sequence, depth - 1) if up_open else None,
            )  # fmt: skip


def _forests(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The nodes of the one range that a task holds."""
    whole = pa.Table.from_batches(batches)
    if not whole.num_rows:
        return
    counts, members, left, right = (whole.column(c).to_numpy() for c in ("n", "member", "left", "right"))
    found = Forest(
        whole.column("digests").to_pylist(), [w.values.to_numpy() for w in whole.column("words")], counts, members, whole.column("ends").to_pylist(), int(left[0]), int(right[0])
    ).nodes()
    rows = []
    for row in found:
        rows.append(row)
        if len(rows) >= BATCH:
            yield _batch(rows, schema)
            rows = []
    if rows:
        yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def trie(turns: DataFrame, step: int = 20, cycle: int = 4) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node, the root's depth being 0.

    ``turns`` has conv_id, turn, role and text (see ``rebuilt``); other columns are not read. A table without
    conversations gives no rows. A conversation's digests, 16 bytes a turn, are one value; copies of a sequence are one row with a count."""
    spark = turns.sparkSession
    whole = rebuilt(turns, step, cycle).withColumn("key", F.unhex(F.md5("digests")))
    whole = materialise(whole)
    sequences = whole.groupBy("digests").agg(F.first("words").alias("words"), F.first("key").alias("key"), F.count("*").alias("n"), F.min("conv_id").alias("member"))
    sequences = sequences.join(member_digests(whole, "key", "conv_id"), "key").drop("key")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), whole.count() // RANGE_ROWS)
    dealt = sequences.repartitionByRange(parts, "digests").sortWithinPartitions("digests").withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt)

    @F.pandas_udf("long")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([-1 if x is None or y is None else lcp(x, y) for x, y in zip(a, b)], dtype="int64")

    ranges = dealt.groupBy("part").agg(F.min("digests").alias("low"), F.max("digests").alias("high"))
    ordered = Window.orderBy("part")  # a row a range
    ranges = ranges.select("part", "low", "high", F.lag("high").over(ordered).alias("before"), F.lead("low").over(ordered).alias("after"))
    ranges = ranges.select("part", common("before", "low").alias("left"), common("high", "after").alias("right"))
    from pyspark.sql.pandas.types import to_arrow_schema

    placed = dealt.join(F.broadcast(ranges), "part").select("digests", F.col("words").cast("array<bigint>").alias("words"), "n", "member", "ends", "left", "right")
    fields = spark.createDataFrame([], NODE).schema
    arrow = to_arrow_schema(fields)
    found = materialise(placed.mapInArrow(lambda batches: _forests(batches, arrow), fields))

    inside = found.where("open IS NULL")
    spread = found.where("open IS NOT NULL").groupBy("open", "depth", "parent_open")
    spread = materialise(
        spread.agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends").alias("ends"))
    )
    parents = spread.select(F.col("open").alias("parent_open"), F.col("conv_id").alias("up_id"))
    parents = F.broadcast(parents) if parents.count() <= BROADCAST else parents
    every = inside.unionByName(spread, allowMissingColumns=True).join(parents, "parent_open", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return every.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "up_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(nothing)).alias("ends_sha256"),
    )  # fmt: skip


#: The query in DuckDB's SQL: every prefix of every rebuilt conversation, grouped.
ORACLE_SQL = r"""
WITH bits AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc),
turns AS (
  SELECT conv_id, turn, md5(length(role) || ':' || role || ':' || text) AS digest, CAST(len(regexp_extract_all(text, '[^ 	-]+')) AS BIGINT) AS words
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id, list({'d': digest, 'w': words} ORDER BY turn NULLS FIRST, digest) AS own FROM turns GROUP BY conv_id),
taken AS (
  SELECT conv_id, own, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT)),
           lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 4 AS h
  FROM own, bits),
whole AS (
  SELECT t.conv_id, list_concat(coalesce(o.own, [])[1:h], t.own[h + 1:]) AS whole
  FROM taken t LEFT JOIN own o ON o.conv_id = t.conv_id - t.conv_id % 20),
paths AS (
  SELECT conv_id, depth, array_to_string(list_transform(whole[1:depth], lambda t: t.d), '') AS node,
         CASE WHEN depth > 0 THEN array_to_string(list_transform(whole[1:depth - 1], lambda t: t.d), '') END AS up,
         CASE WHEN depth > 0 THEN whole[depth].w ELSE 0 END AS words, len(whole) = depth AS ends
  FROM (SELECT conv_id, whole, unnest(range(len(whole) + 1)) AS depth FROM whole)),
nodes AS (
  SELECT node, any_value(up) AS up, CAST(any_value(depth) AS BIGINT) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * any_value(words) AS saved, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS members
  FROM paths GROUP BY node),
kids AS (SELECT up AS node, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (node)),
subtrees AS (
  SELECT substr(node, 1, 32 * CAST(d AS INTEGER)) AS node, sum(saved) AS saved_tokens, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
  FROM (SELECT node, saved, n_children, unnest(range(depth + 1)) AS d FROM full_nodes) GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(n.members) AS ends_sha256
FROM full_nodes n JOIN subtrees s USING (node) LEFT JOIN nodes p ON n.up = p.node
"""
