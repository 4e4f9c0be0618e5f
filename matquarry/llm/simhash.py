"""SimHash near-duplicate detection with BK-trees.

Each text gets a 64-bit fingerprint of its word shingles; fingerprints that differ
in at most ``radius`` bits are linked, and linked texts form components.

Distinct fingerprints are dealt into shards by the pigeonhole rule: of ``radius`` + 1
equal bit bands, two fingerprints within ``radius`` bits agree on at least one, so
every link lies inside the shard of some (band, value). A task builds the BK-tree of
a shard (children keyed by their Hamming distance to the parent) and follows, from
each node, only the edges whose distance is within the radius of the probe's own.
A shard above ``shard_rows`` fingerprints is cut into sub-shards, and each pair of
sub-shards is a tree probed by the other: no task holds more than two sub-shards.
Where there are no more than ``broadcast_rows`` distinct fingerprints, the trees of all shards are broadcast and each task
probes them with its own fingerprints. Trees grow with the corpus, so beyond that bound a tree
meets its probes through the shuffle. Links leave a task as a
spanning forest, never as all pairs, and components are joined by rounds of
large-star and small-star hooks over checkpointed edges.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialise

SEED = 42
CHUNK = 65_536


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the shingles of ``width`` words of a UTF-8 text, as a signed 64-bit number.

    A-Z count as a-z. A text of fewer words has its whole word sequence as its one
    shingle; a text without words has fingerprint 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: 1 - width or None], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(total * 2 > len(starts), bitorder="little")
    return int(bits.view(np.int64)[0])


class BKTree:
    """A Burkhard-Keller tree of distinct unsigned 64-bit numbers under Hamming distance."""

    def __init__(self, values: list[int] | None = None, children: list[dict[int, int]] | None = None) -> None:
        self.values = values or []
        self.children = children or []

    def add(self, value: int) -> None:
        new, at = len(self.values), 0
        self.values.append(value)
        self.children.append({})
        while new:
            edges = self.children[at]
            distance = (self.values[at] ^ value).bit_count()
            if distance not in edges:
                edges[distance] = new
                return
            at = edges[distance]

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the numbers at most ``radius`` bits away."""
        if not self.values:
            return []
        found, open_nodes = [], [0]
        while open_nodes:
            at = open_nodes.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            for edge, child in self.children[at].items():
                if -radius <= edge - distance <= radius:
                    open_nodes.append(child)
        return found


class Forest:
    """Spanning links of what was joined: (value, representative of its tree)."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent.setdefault(a, a)
        self.parent.setdefault(b, b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def links(self) -> list[tuple[int, int]]:
        return [(x, r) for x in self.parent if (r := self.root(x)) != x]


def shard_links(tree_values: list[int], probes: list[int], radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the shard.

    ``probes`` empty: the values are probed against each other as the tree grows."""
    tree, forest = BKTree(), Forest()
    for value in tree_values:
        if not probes:
            for at in tree.within(value, radius):
                forest.join(value, tree.values[at])
        tree.add(value)
    for value in probes:
        for at in tree.within(value, radius):
            forest.join(value, tree.values[at])
    return forest.links()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a long."""
    return map_texts(docs, id_col, text_col, "fp long", lambda: lambda text: (fingerprint(text, width),))


def banded(distinct: DataFrame, radius: int) -> DataFrame:
    """(fp, band, value): the shards of each fingerprint."""
    bands = radius + 1
    size = -(-64 // bands)
    mask = (1 << size) - 1
    keys = [
        F.struct(F.lit(b).alias("band"), F.shiftrightunsigned("fp", b * size).bitwiseAND(F.lit(mask)).alias("value"))
        for b in range(bands)
    ]
    return distinct.select("fp", F.inline(F.array(*keys)))


def fingerprint_links(distinct: DataFrame, radius: int = 3, shard_rows: int = 2048, broadcast_rows: int = 65_536) -> DataFrame:
    """(u, v): links that span every component of the distinct fingerprints ``fp`` at ``radius``."""
    dealt = banded(distinct, radius)
    counts = dealt.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    if distinct.count() <= broadcast_rows:
        return _probe_broadcast(dealt.join(counts, ["band", "value"]), radius).distinct()
    cuts = F.ceil(F.col("n") / F.lit(shard_rows)).cast("int")
    dealt = (
        dealt.join(counts, ["band", "value"])
        .withColumn("cuts", cuts)
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .select(
            "band",
            "value",
            F.least("own", "other").alias("a"),
            F.greatest("own", "other").alias("b"),
            (F.col("own") == F.least("own", "other")).alias("in_tree"),
            "fp",
        )
    )
    group = ["band", "value", "a", "b"]
    return (
        dealt.repartition(*group)
        .sortWithinPartitions(*group)
        .mapInArrow(lambda batches: _search_shards(batches, radius), "u long, v long")
        .distinct()
    )


def _unsigned(batch: pa.RecordBatch, column: str) -> list[int]:
    return batch.column(column).to_numpy(zero_copy_only=False).view(np.uint64).tolist()


def _links_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def _probe_broadcast(dealt: DataFrame, radius: int) -> DataFrame:
    """Links of few fingerprints: tasks build the trees of the shards, all trees are broadcast, and tasks probe them."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[tuple[int, int], BKTree] = {}
        for batch in batches:
            for *shard, value in zip(batch.column("band").to_pylist(), batch.column("value").to_pylist(), _unsigned(batch, "fp")):
                trees.setdefault(tuple(shard), BKTree()).add(value)
        plain = {shard: (tree.values, tree.children) for shard, tree in trees.items()}
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(plain)], pa.binary())], names=["trees"])

    dealt = materialise(dealt)
    built = dealt.repartition("band", "value").mapInArrow(build, "trees binary").collect()
    shared = dealt.sparkSession.sparkContext.broadcast([r["trees"] for r in built])

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = {shard: BKTree(*tree) for some in shared.value for shard, tree in pickle.loads(some).items()}
        forest = Forest()
        for batch in batches:
            for *shard, value in zip(batch.column("band").to_pylist(), batch.column("value").to_pylist(), _unsigned(batch, "fp")):
                tree = trees[tuple(shard)]
                for at in tree.within(value, radius):
                    forest.join(value, tree.values[at])
        yield _links_batch(forest.links())

    return dealt.select("fp", "band", "value").mapInArrow(probe, "u long, v long")


def _search_shards(batches: Iterable[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Search the shards of a partition that is sorted by shard."""

    def links(block: np.ndarray, in_tree: np.ndarray, pair: bool) -> list[tuple[int, int]]:
        values = block.tolist()
        if not pair:
            return shard_links(values, [], radius)
        return shard_links([v for v, t in zip(values, in_tree) if t], [v for v, t in zip(values, in_tree) if not t], radius)

    rest: tuple | None = None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
        trees = batch.column(4).to_numpy(zero_copy_only=False)
        values = batch.column(5).to_numpy(zero_copy_only=False).view(np.uint64)
        if rest is not None:
            keys, trees, values = (np.concatenate(x, axis=-1) for x in zip(rest, (keys, trees, values)))
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        bounds = [0, *cuts.tolist()]
        found = []
        for lo, hi in zip(bounds, bounds[1:]):
            found += links(values[lo:hi], trees[lo:hi], keys[2, lo] != keys[3, lo])
        if found:
            yield _links_batch(found)
        rest = tuple(x[..., bounds[-1] :] for x in (keys, trees, values))
    if rest is not None and rest[2].size:
        if found := links(rest[2], rest[1], rest[0][2, 0] != rest[0][3, 0]):
            yield _links_batch(found)


def _roots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(u, v)
    pairs = np.array(forest.links(), np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "root"])


def connected_components(links: DataFrame, few: int = 500_000) -> DataFrame:
    """(u, root): every node of the links (u, v) but the smallest of each component, with that one.

    At most ``few`` distinct links, whose number is checked, go through a union-find in one task. More take
    rounds of large-star and small-star: each hooks the neighbours of a node to the
    smallest of them, so edges shrink to stars in a logarithmic number of rounds in
    practice. Minima are combined before the shuffle and joined back, so a node with
    very many neighbours is never gathered in one place."""
    edges = materialise(links.where("u <> v").select("u", "v").distinct())
    if edges.count() <= few:
        return materialise(edges.coalesce(1).mapInArrow(_roots, "u long, root long"))
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(least, "u")
            .select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))))
            .where("u <> v")
            .distinct()
        )
        edges = materialise(small)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select("u", F.col("v").alias("root"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    radius: int = 3,
    shard_rows: int = 2048,
    broadcast_rows: int = 65_536,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, n_links.

    component_id is the smallest doc_id that links lead to, its own included; n_links
    is the number of spanning links at the row's fingerprint. Null and empty texts have fingerprint
    zero and link like any other; repeated rows each return their row; null ids are
    never a component_id while the component has another id. Other columns are ignored.
    An empty table gives an empty result."""
    marked = materialise(fingerprints(docs, id_col, text_col, width))
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    links = materialise(fingerprint_links(distinct, radius, shard_rows, broadcast_rows))
    stars = connected_components(links)
    member = stars.union(stars.select(F.col("root").alias("u"), "root").distinct()).withColumnRenamed("u", "fp")
    named = member.join(distinct, "fp").select("fp", "root", "first_id")
    heads = named.groupBy("root").agg(F.min("first_id").alias("head"))
    degree = links.select(F.explode(F.array("u", "v")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    resolved = named.join(heads, "root").select("fp", "head").join(degree, "fp", "left")
    # written first: a join of written tables can split the rows of a fingerprint that very many texts share
    components = materialise(
        distinct.join(resolved, "fp", "left").select(
            "fp", F.coalesce("head", "first_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
        )
    )
    return marked.join(components, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links"
    )


def digest(text: Column) -> Column:
    """SHA-256 of a text, null counting as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def keep_heads(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row of each component; ``rows`` is (doc_id, digest, root), a row for each of theirs.

    The first row of a component by id (null ids last) and digest stays. Of rows equal in both, which
    are in one component, the first by all its columns stays, so reruns keep the same."""
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    heads = rows.groupBy("root").agg(F.min(key).alias("head")).select("head.doc_id", "head.digest")
    times = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("times"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.digest") == F.col("b.digest"))
    heads = materialise(heads.alias("a").join(times.alias("b"), same).select("a.doc_id", "a.digest", "times"))

    def rows_of(some: DataFrame) -> DataFrame:
        some = some.select(F.col("doc_id").alias("__head"), F.col("digest").alias("__digest"))
        own = docs[f"`{id_col}`"].eqNullSafe(some["__head"]) & (digest(docs[f"`{text_col}`"]) == some["__digest"])
        return docs.join(some, own, "left_semi")

    kept = rows_of(heads.where("times = 1"))
    repeated = heads.where("times > 1")
    if repeated.isEmpty():
        return kept
    one = (
        rows_of(repeated)
        .select(F.struct("*").alias("__row"), F.col(f"`{id_col}`").alias("__head"), digest(F.col(f"`{text_col}`")).alias("__digest"))
        .groupBy("__head", "__digest")
        .agg(F.min_by("__row", F.to_json("__row")).alias("__row"))
    )
    return kept.unionByName(one.select("__row.*"))


def drop_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    radius: int = 3,
    shard_rows: int = 2048,
    broadcast_rows: int = 65_536,
) -> DataFrame:
    """``docs`` with one row of each component of fingerprints, as ``keep_heads`` picks it, whatever the ids are."""

    def per_text(text: bytes) -> tuple:
        return fingerprint(text, width), hashlib.sha256(text).digest()

    marked = materialise(map_texts(docs, id_col, text_col, "fp long, digest binary", lambda: per_text))
    links = materialise(fingerprint_links(marked.select("fp").distinct(), radius, shard_rows, broadcast_rows))
    stars = connected_components(links).withColumnRenamed("u", "fp")
    rows = marked.join(stars, "fp", "left").select("doc_id", "digest", F.coalesce("root", "fp").alias("root"))
    return keep_heads(docs, rows, id_col, text_col)
