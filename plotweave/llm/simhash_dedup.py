"""SimHash near-dedup (operator 10) with BK-trees.

Texts become 64-bit fingerprints, and only distinct ones are compared. Those that share a key form a group; within it a
BK-tree (children keyed by their integer Hamming distance to the parent) is searched, following only edges within the
radius. A group above ``shard_size`` is split into shards with a tree each, and all the group's fingerprints go to
every one of its shard trees, so the largest task holds one tree and a stream.

``near_duplicates`` links fingerprints with at most ``radius`` differing bits. Its keys are bit blocks: of ``blocks``
blocks, ``blocks - radius`` agree, so no link is missed. The number of blocks grows with the number of fingerprints, so
that a group of unrelated ones stays small. From each tree come links of a spanning kind (at most one per fingerprint).

``similar_documents`` links texts whose sets of word shingles have a Jaccard similarity of at least ``least``. At 0.8 two
fingerprints differ in 10 of 64 bits, which no bit blocks can key, so here the keys are ``BANDS`` bands of ``VALUES``
minima of shingle hashes. A pair at exactly 0.8 shares no band in 2 of 10,000 cases and differs in more than
``WIDE_RADIUS`` bits in about as many; a closer one less often. Every pair found is decided by its shingles. Most links are
those of a group's first text; what these leave apart is searched by families (texts that share keys, over others) in
tasks that hold a shard tree with the shingles of its texts and give spanning links only, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm import ragged
from plotweave.llm.common import Scratch, join_hot
from plotweave.llm.components import components

BITS = 64
#: Unrelated fingerprints in a group, at most, on average; more blocks are used beyond.
CROWD = 32
#: Keys of similar texts, and the differing bits up to which their shingles are compared.
BANDS, VALUES = 16, 4
WIDE_RADIUS = 20
#: Pairs of one text that one task compares.
SALT_PAIRS = 512
#: Shingles hashed at a time.
CHUNK = 1 << 16

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """Unsigned SimHash of the XXH64 of all shingles of ``shingle`` words, repeats included; no words: zero."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, CHUNK):
        part = words[at : min(at + CHUNK, n) + shingle - 1]
        grams = [part] if len(part) < shingle else zip(*(part[i:] for i in range(shingle)), strict=False)
        marks = np.array([digest(join(g), seed) for g in grams], np.uint64).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            ones[8 * byte : 8 * byte + 8] += np.bincount(marks[:, byte], minlength=256) @ _BYTE_BITS
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp long`` (the fingerprint's bits, signed) for each row; null and wordless texts have 0."""
    source = docs.select(id_col, text_col)
    id_type = source.schema[id_col].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t, shingle, seed) if t else 0 for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    return source.mapInArrow(mark, f"`{id_col}` {id_type}, fp long")


class BKTree:
    """Burkhard-Keller tree over distinct fingerprints; searches run for many queries at once, node by node."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[list[tuple[int, int]]] = [[] for _ in values]
        todo = [np.arange(len(values))] if len(values) else []
        while todo:
            members = todo.pop()
            root, rest = int(members[0]), members[1:]
            if len(rest):
                gap = np.bitwise_count(values[rest] ^ values[root])
                for d in np.unique(gap).tolist():
                    below = rest[gap == d]
                    self.children[root].append((d, int(below[0])))
                    todo.append(below)

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) positions of all pairs within ``radius``."""
        found_q, found_n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        todo = [(0, np.arange(len(queries)))] if len(self.values) else []
        while todo:
            node, who = todo.pop()
            gap = np.bitwise_count(queries[who] ^ self.values[node]).astype(np.int64)
            near = who[gap <= radius]
            found_q.append(near)
            found_n.append(np.full(len(near), node))
            for d, child in self.children[node]:
                go = who[np.abs(gap - d) <= radius]
                if len(go):
                    todo.append((child, go))
        return np.concatenate(found_q), np.concatenate(found_n)


def spanning_links(tree: BKTree, queries: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links, at most one per fingerprint, that connect exactly what the pairs within ``radius`` connect."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    q, n = tree.search(queries, radius)
    for a, b in zip(queries[q].tolist(), tree.values[n].tolist(), strict=True):
        if a != b and (a := top(a)) != (b := top(b)):
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in parent if (r := top(x)) != x]


def _searched(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    """Links (a, b) found in each group of sorted rows (key, shard, probe, fp, ...); a group may run over several batches.

    ``make(nodes)`` builds the tree of a group and gives a function from rows to pairs of arrays. A group's tree rows come
    first and are held; what follows is searched as it comes. A group without probes is searched with its own tree rows.
    """
    at: tuple[int, int] | None = None
    held: list[np.ndarray] = []
    find = None
    links: list[tuple[np.ndarray, np.ndarray]] = []

    def close() -> None:
        if find is None and held and sum(x.shape[1] for x in held) > 1:
            nodes = np.concatenate(held, axis=1)
            links.append(make(nodes)(nodes))

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in links]).view(np.int64)) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        key, shard, probe = (batch.column(i).to_numpy() for i in range(3))
        if not len(key):
            continue
        rest = np.stack([batch.column(i).to_numpy().view(np.uint64) for i in range(3, batch.num_columns)])
        cut = np.flatnonzero((key[1:] != key[:-1]) | (shard[1:] != shard[:-1])) + 1
        first, last = np.concatenate([[0], cut]), np.append(cut, len(key))
        # groups of one row need no search; the first and last may go on in other batches
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if b - a == 1 and 0 < a and b < len(key):
                continue
            if (this := (int(key[a]), int(shard[a]))) != at:
                close()
                at, held, find = this, [], None
            nodes = a + int(np.searchsorted(probe[a:b], 1))
            if nodes > a:
                held.append(rest[:, a:nodes])
            if b > nodes:
                find = find or make(np.concatenate(held, axis=1) if held else rest[:, :0])
                links.append(find(rest[:, nodes:b]))
        if links:
            yield batch_of()
            links = []
    close()
    if links:
        yield batch_of()


def tree_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of each group of sorted rows (key, shard, probe, fp)."""

    def make(nodes: np.ndarray):
        tree = BKTree(nodes[0])
        return lambda rows: tuple(np.array(spanning_links(tree, rows[0], radius), np.uint64).reshape(-1, 2).T)

    return _searched(batches, make)


class Family:
    """A shard tree over texts with their shingles, and which of them are connected so far."""

    def __init__(self, fps: np.ndarray, sims: np.ndarray, roots: np.ndarray, sets: list[np.ndarray]):
        self.tree, self.fps, self.roots = BKTree(sims), fps, roots.tolist()
        self.size = np.array([len(x) for x in sets])
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.shingles, self.first = np.unique(every[order], return_index=True)
        self.first = np.append(self.first, len(every))
        self.parent: dict[int, int] = {}

    def top(self, x: int) -> int:
        while self.parent.setdefault(x, x) != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def shared(self, shingles: np.ndarray) -> np.ndarray:
        """How many of these shingles each text of the tree has."""
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        at = at[self.shingles[at] == shingles]
        n = self.first[at + 1] - self.first[at]
        places = np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(self.owner[places], minlength=len(self.size))

    def links(self, fps: np.ndarray, sims: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], radius: int, least: float) -> list[tuple[int, int]]:
        """For texts that come by, links to similar ones in the tree that are not connected with them yet."""
        out = []
        q, n = self.tree.search(sims, radius)
        order = np.argsort(q, kind="stable")
        q, n = q[order], n[order]
        edges = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else q
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(q)], strict=True):
            i, near = int(q[a]), n[a:b]
            if all(self.top(self.roots[x]) == self.top(int(roots[i])) for x in near.tolist()):
                continue
            both = self.shared(sets[i])[near]
            for x in near[both >= least * (len(sets[i]) + self.size[near] - both)].tolist():
                one, two = self.top(int(roots[i])), self.top(self.roots[x])
                if one != two:
                    self.parent[max(one, two)] = min(one, two)
                    out.append((int(fps[i]), int(self.fps[x])))
        return out


def family_links(batches: Iterator[pa.RecordBatch], radius: int, least: float) -> Iterator[pa.RecordBatch]:
    """Links of each family's shard, in sorted rows (key, shard, probe, fp, sim, root, shingles): first the tree's texts, then
    those that are compared with them as they come."""
    at, held, family = None, [], None
    for batch in batches:
        columns = [batch.column(i).to_numpy() for i in range(6)]
        sets = [np.frombuffer(x, np.uint64) for x in batch.column(6).to_pylist()]
        key, shard, probe = columns[:3]
        cut = np.flatnonzero((key[1:] != key[:-1]) | (shard[1:] != shard[:-1]) | (probe[1:] != probe[:-1])) + 1
        links = []
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True):
            if a == b:
                continue
            if (this := (key[a], shard[a])) != at:
                at, held, family = this, [], None
            rows = (columns[3][a:b], columns[4][a:b].view(np.uint64), columns[5][a:b], sets[a:b])
            if not probe[a]:
                held.append(rows)
                continue
            if family is None:
                if not held:
                    continue
                family = Family(*(np.concatenate([h[i] for h in held]) for i in range(3)), [x for h in held for x in h[3]])
            links += family.links(*rows, radius, least)
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """``fp, shingles`` (sorted hashes, as bytes) of ``texts`` (fp, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in _sets(batch.column(1), width)], pa.binary())], names=["fp", "shingles"])

    return texts.select("fp", "text").mapInArrow(run, "fp long, shingles binary")


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    data, offsets = ragged.utf8(column)
    for a, b in ragged.blocks(offsets):
        h, n = word_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
        yield from (np.unique(x) for x in np.split(h, np.cumsum(n)[:-1]))


def _dealt(keyed: DataFrame, shard_size: int, *columns: str) -> DataFrame:
    """Rows (key, shard, probe, columns) as ``_searched`` wants them; probes exist for groups above ``shard_size`` only."""
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > shard_size)
    sized = keyed.join(large, "key", "left").withColumn("shards", F.coalesce(F.ceil(F.col("n") / F.lit(shard_size)), F.lit(1)).cast("int"))
    nodes = sized.select("key", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("shards")).cast("int").alias("shard"), F.lit(0).alias("probe"), *columns)
    probes = sized.where("shards > 1").select("key", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("probe"), *columns)
    return nodes.unionByName(probes).repartition("key", "shard").sortWithinPartitions("key", "shard", "probe", "fp")


def block_keys(fp, blocks: int, agree: int):
    """Array of (which blocks, their bits) for all choices of ``agree`` out of ``blocks`` bit blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    out = []
    for n, chosen in enumerate(combinations(range(blocks), agree)):
        mask = sum(((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in chosen)
        signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
        out.append(F.xxhash64(fp.bitwiseAND(F.lit(signed)), F.lit(n)))
    return F.array(*out)


def blocks_for(n: int, radius: int) -> int:
    """Bit blocks for ``n`` fingerprints: the fewest with which at most CROWD unrelated ones share a key, on average."""
    blocks = radius + 1
    while blocks < radius + 5 and n > CROWD * 2.0 ** (BITS * (blocks - radius) / blocks):
        blocks += 1
    return blocks


def link_fingerprints(distinct: DataFrame, radius: int, blocks: int, shard_size: int) -> DataFrame:
    """Spanning links ``a, b`` between the fingerprints (column fp, distinct) within ``radius`` bits of each other."""
    keyed = distinct.select("fp", F.explode(block_keys(F.col("fp"), blocks, blocks - radius)).alias("key"))
    return _dealt(keyed, shard_size, "fp").mapInArrow(lambda batches: tree_links(batches, radius), "a long, b long")


def _with_components(marked: DataFrame, distinct: DataFrame, roots: DataFrame, total: int) -> DataFrame:
    """``marked`` with ``component_id``, the smallest id (``first`` of ``distinct``: fp, first, n) of each root's rows."""
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = rooted.join(smallest, "root").select("fp", "component_id", "n")
    return join_hot(marked, by_fp, "fp", total)


def near_duplicates(
    docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42, blocks: int | None = None, shard_size: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, fp, component_id`` for each row: the smallest id reachable over links of at most ``radius`` bits.

    Null and wordless texts have fingerprint 0 and link like any other. Equal texts have equal fingerprints; rows that
    repeat an id fall into the components of their texts; a null id is never a component's id unless all of its ids are
    null. Only the id and text are read. Exact: no link within the radius is missed, and none is beyond it.
    """
    if blocks is not None and blocks <= radius:
        raise ValueError("more blocks than differing bits are needed")
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.save(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    distinct = scratch.save(marked.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("n")), "distinct")
    n = distinct.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    links = scratch.save(link_fingerprints(distinct.select("fp"), radius, blocks or blocks_for(n[0], radius), shard_size), "links")
    return _with_components(marked, distinct, components(links, scratch), n[1]).select(id_col, "fp", "component_id")


_ODD = np.random.default_rng(10).integers(0, 1 << 63, (BANDS * VALUES, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(29))


def word_shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, row by row, and how many each row has; a shorter text is one run."""
    _, starts, _, marks = ragged.words(data, offsets)
    words = ragged.per_row(starts, offsets)
    n = np.where(words > 0, np.maximum(words - width + 1, 1), 0)
    first = np.cumsum(words) - words
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    end = np.repeat(first + words, n)
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            there = at + i < end
            h[there] = _mix(h[there] * _STEP + marks[at[there] + i])
    return h, n


def signatures(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest of each row's shingles (no words: zero), its SimHash, and its keys."""
    digest, sim, keys = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64), np.zeros((len(n), BANDS), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return digest, sim, keys
    at = (np.cumsum(n) - n)[full]
    row, raw = np.repeat(np.arange(len(full)) * 256, n[full]), h.view(np.uint8).reshape(-1, 8)
    ones = np.empty((len(full), BITS))
    for byte in range(8):
        ones[:, 8 * byte : 8 * byte + 8] = np.bincount(row + raw[:, byte], minlength=256 * len(full)).reshape(-1, 256).astype(float) @ _BYTE_BITS.astype(float)
    sim[full] = np.packbits(2 * ones > n[full][:, None], axis=1, bitorder="little").view("<u8").ravel()
    with np.errstate(over="ignore"):
        digest[full] = np.add.reduceat(_mix(h * _STEP), at)
        for band in range(BANDS):
            key = np.full(len(full), band, np.uint64)
            for a, b in _ODD[band * VALUES : (band + 1) * VALUES]:
                key = _mix(key * _STEP + np.minimum.reduceat((h ^ b) * a, at))
            keys[full, band] = key
    return digest, sim, keys


def _marked(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``id, fp, sim, keys, text``; ``fp`` is the digest."""
    source = docs.select(id_col, text_col)
    id_type = source.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ragged.utf8(batch.column(1))
            for a, b in ragged.blocks(offsets):
                digest, sim, keys = signatures(*word_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(digest.view(np.int64)), pa.array(sim.view(np.int64)), lists, batch.column(1).slice(a, b - a)], names=[id_col, "fp", "sim", "keys", "__text"]
                )

    return source.mapInArrow(run, f"`{id_col}` {id_type}, fp long, sim long, keys array<long>, __text string")


def star_pairs(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Pairs of the first row of each run of equal keys with its others, if within the radius; rows are (key, fp, sim)."""
    last = None
    for batch in batches:
        key, fp, sim = (batch.column(i).to_numpy() for i in range(3))
        if not len(key):
            continue
        new = np.concatenate([[last is None or last[0] != key[0]], key[1:] != key[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        center, bits = np.where(first < 0, 0 if last is None else last[1], fp[first]), np.where(first < 0, 0 if last is None else last[2], sim[first])
        near = np.flatnonzero(~new & (np.bitwise_count(bits.view(np.uint64) ^ sim.view(np.uint64)) <= radius))
        last = key[-1], center[-1], bits[-1]
        if len(near):
            yield pa.RecordBatch.from_arrays([pa.array(center[near]), pa.array(fp[near])], names=["a", "b"])


def similar(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The ``pairs`` (a, b) whose ``texts`` (fp, text) have a Jaccard similarity of at least ``least``.

    A text with many partners is sent to several tasks, each with some of them.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_PAIRS).cast("int").alias("salts"))
    left = texts.join(salts, texts["fp"] == salts["a"]).select("a", F.col("text").alias("ta"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    dealt = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    both = dealt.join(left, ["a", "salt"]).select("a", "b", "ta").join(texts.select(F.col("fp").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_sets(batch.column(2), width), _sets(batch.column(3), width), strict=True):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= least * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, width: int = 5, least: float = 0.8, shard_size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, component_id`` for each row: the smallest id reachable over pairs of at least that similarity.

    In each group the first text is compared with all others. What that leaves apart is compared with the rest of its family
    unless it is connected with most of it; the work of a family is its size times the number of such texts. Null and wordless texts are alike. Rows that repeat
    an id fall into the components of their texts; a null id is never a component's id unless all of its ids are null.
    Only the id and text are read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash-similar")
    marked = scratch.save(_marked(docs, width, id_col, text_col), "marked")
    distinct = scratch.save(marked.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("n"), F.any_value("sim").alias("sim"), F.any_value("keys").alias("keys")), "distinct")
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    keyed = distinct.where("fp <> 0").select(F.explode("keys").alias("key"), "fp", "sim")
    stars = keyed.repartition("key").sortWithinPartitions("key", "sim", "fp").mapInArrow(lambda batches: star_pairs(batches, WIDE_RADIUS), "a long, b long")
    stars = scratch.save(stars.distinct(), "stars")

    def texts_of(pairs: DataFrame, name: str) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
        firsts = distinct.join(wanted, "fp", "left_semi").select("fp", F.col("first").alias("id"))
        held = marked.join(firsts, "fp").where(F.col(id_col).eqNullSafe(F.col("id")))  # one row of each, but for repeated ids
        return scratch.save(held.groupBy("fp").agg(F.any_value("__text").alias("text")), name)

    links = scratch.save(similar(stars, texts_of(stars, "star-texts"), width, least), "star-links")
    roots = components(links, scratch)
    # groups whose members are not all connected, and are more than one pair that has been compared
    rooted = keyed.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("key", "fp", "sim", F.coalesce("root", "fp").alias("root"))
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("many")).where("low <> high AND many > 2").select("key")
    left = scratch.save(rooted.join(open_keys, "key"), "open")
    if not left.isEmpty():
        firsts = left.groupBy("key").agg(F.min("fp").alias("a"))
        families = components(left.select("key", F.col("fp").alias("b")).join(firsts, "key").select("a", "b"), Scratch(spark, "simhash-families")).select(F.col("node").alias("fp"), F.col("root").alias("key"))
        members = scratch.save(left.select("fp", "sim", "root").distinct().join(families, "fp"), "members")
        # what is connected with most of its family need not come by: the others do
        most = members.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"))
        sized = members.join(most, "key").withColumn("shards", F.ceil(F.col("n") / F.lit(shard_size)).cast("int"))
        nodes = sized.select("key", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("shards")).cast("int").alias("shard"), F.lit(0).alias("probe"), "fp", "sim", "root")
        probes = sized.where("root <> main").select("key", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("probe"), "fp", "sim", "root")
        wanted = members.select("fp", F.col("fp").alias("a"), F.col("fp").alias("b"))
        sets = scratch.save(_shingle_sets(texts_of(wanted, "open-texts"), width), "shingles")
        dealt = nodes.unionByName(probes).join(sets, "fp").select("key", "shard", "probe", "fp", "sim", "root", "shingles")
        dealt = dealt.repartition("key", "shard").sortWithinPartitions("key", "shard", "probe", "fp")
        more = scratch.save(dealt.mapInArrow(lambda batches: family_links(batches, WIDE_RADIUS, least), "a long, b long"), "more-links")
        roots = components(links.unionByName(more), Scratch(spark, "simhash-components"))
    return _with_components(marked.select(id_col, "fp"), distinct, roots, total).select(id_col, "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", find=near_duplicates, **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose id is the smallest of their component, as ``find`` gives it.

    ``id`` is the key: rows that repeat the kept id all stay, rows with a null id stay too. No column's name can clash.
    """
    mine = "__id"
    while mine in docs.columns:
        mine = "_" + mine
    found = find(docs, id_col=id_col, **options).select(F.col(id_col).alias(mine), "component_id")
    dropped = found.where(F.col(mine) != F.col("component_id")).select(mine).distinct()
    return docs.join(dropped, docs[id_col] == dropped[mine], "left_anti")
