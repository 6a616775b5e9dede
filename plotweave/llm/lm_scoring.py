"""LM scoring (operator 7): a hierarchical Pitman-Yor bigram model with Chinese-restaurant seating by Gibbs sampling.

Restaurants. Every token of training, the end of a text included, is a context with its own restaurant, and a dish of
all of them. Their parent is one restaurant whose customers are their tables; half of its base lies on words that
training has not seen, the rest is uniform over those seen.

Where the work is. Tokens go to buckets by a hash of their context, so a bucket holds whole restaurants with all their
customers, and what is learned grows with the input. Contexts with more than a quarter of a bucket's tokens are dealt
to all buckets by context and word. In each sweep every customer of a word with two or more in its restaurant leaves its
table and is seated again given all others (a single customer's table is its own whatever it does); a customer's chances
depend on the sizes of its word's tables, the restaurant's tables and the word's probability in the parent. Then the
tables of each word go to the parent's shard of that word, which seats them in the same way, and what it has seated
comes back for the next sweep. Predictive probabilities are averaged over the sweeps kept.

What is not in turn. One customer of a restaurant moves at a time as long as it has ``SLICES`` customers or fewer; of a
larger one 1 / SLICES moves at once. Within a sweep the parent is that of the sweep before, and so are the tables that a
dealt-out context has in other buckets. A shard of the parent takes the others' tables to be as many as its own.

Between the steps only binary arrays move, byte planes compressed. The ``HEAD`` most frequent tokens, which every
executor knows, go as numbers, others as 63-bit hashes; results do not depend on which those are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm import ragged
from plotweave.llm.common import Scratch

#: Tokens that are sent as numbers.
HEAD = 1 << 18
#: The end of a text; no word contains white space.
END = " "
#: Bytes of text handled together, and tokens in a bucket (about).
BLOCK, BUCKET_TOKENS = 1 << 22, 1 << 21
SLICES = 256
BURN_IN, KEPT = 1, 2
#: Turns of the parent's customers in each sweep.
PARENT_TURNS = 2
STRENGTH = 1.0
UNSEEN_BASE = 0.5

_TAIL, _HOT = np.uint64(1) << np.uint64(63), np.uint64(1) << np.uint64(62)
ROWS = "bucket int, kind string, base long, payload binary"


def discount(ones: float, twos: float) -> float:
    """Estimate from how many dishes have one and two customers."""
    return float(np.clip(ones / (ones + 2 * twos), 0.1, 0.9)) if ones else 0.5


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; equal bytes of all values lie together."""
    import zstandard

    press, head, parts = zstandard.ZstdCompressor(level=1), [], []
    for name, x in arrays.items():
        if x.dtype.kind in "iu" and len(x) and x.min() >= 0:
            x = x.astype(np.min_scalar_type(int(x.max())))
        body = press.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())
        head.append([name, x.dtype.str, len(x), len(body)])
        parts.append(body)
    top = json.dumps(head).encode()
    return len(top).to_bytes(4, "little") + top + b"".join(parts)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    import zstandard

    press, out = zstandard.ZstdDecompressor(), {}
    at = 4 + int.from_bytes(data[:4], "little")
    for name, kind, n, size in json.loads(data[4:at]):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(press.decompress(data[at : at + size], max_output_size=max(1, n * width)), np.uint8)
        out[name] = np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()
        at += size
    return out


def _batch(rows: list[tuple[int, str, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["bucket", "kind", "base", "payload"])


def _rows(batches: Iterator[pa.RecordBatch]) -> dict[str, list[tuple[int, int, bytes]]]:
    """All rows of a partition by kind, as (bucket, base, payload) in that order."""
    out: dict[str, list] = {}
    for batch in batches:
        for bucket, kind, base, payload in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            out.setdefault(kind, []).append((bucket, base, payload))
    for rows in out.values():
        rows.sort(key=lambda r: r[:2])
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _places(keys: np.ndarray, n: int) -> np.ndarray:
    return (_mix(keys) >> np.uint64(20)) % np.uint64(n)


def _rank_in_runs(x: np.ndarray) -> np.ndarray:
    """Number of each element within its run of equal neighbours."""
    if not len(x):
        return np.zeros(0, np.int64)
    new = np.concatenate([[True], x[1:] != x[:-1]])
    first = np.flatnonzero(new)
    return np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))


class Seating:
    """Customers at tables in many restaurants. A cell is one dish in one restaurant; its customers lie together.

    Cells of one customer have one table always and take no part in the moves.
    """

    def __init__(self, n: np.ndarray, house: np.ndarray, houses: int, d: float, rng: np.random.Generator, seats: np.ndarray | None = None):
        self.n, self.house, self.houses, self.d, self.rng = n.astype(np.int64), house, houses, d, rng
        self.cells = np.flatnonzero(self.n >= 2)
        size = self.n[self.cells]
        self.first = np.cumsum(size) - size  # first customer of each moving cell; tables have places 0..n-1 there, too
        self.cell = np.repeat(np.arange(len(size)), size)
        self.size = size
        self.seat = self.first[self.cell] + (0 if seats is None else seats.astype(np.int64))
        self.at_table = np.bincount(self.seat, minlength=len(self.cell))
        empty = np.flatnonzero(self.at_table == 0)
        owner = self.cell[empty]
        self.free = np.zeros(len(self.cell), np.int64)  # per cell a stack of places without a table
        self.free[self.first[owner] + _rank_in_runs(owner)] = empty
        self.n_free = np.bincount(owner, minlength=len(size))
        home = house[self.cells][self.cell]
        order = np.argsort(home, kind="stable")
        turn = np.empty(len(home), np.uint16)
        turn[order] = _rank_in_runs(home[order]) % SLICES
        self.turn = turn
        self.order = np.argsort(turn, kind="stable")
        self.bounds = np.searchsorted(turn[self.order], np.arange(SLICES + 1))

    def tables(self) -> np.ndarray:
        """Tables of each cell."""
        out = np.minimum(self.n, 1)
        out[self.cells] = self.size - self.n_free
        return out

    def seats(self) -> np.ndarray:
        return self.seat - self.first[self.cell]

    def sweep(self, base: np.ndarray, less: np.ndarray | None = None, elsewhere: np.ndarray | None = None, times: float = 1.0) -> None:
        """Every customer leaves and is seated again. ``base``: probability of each cell's dish in the parent; ``less``: that
        once one of the cell's tables has gone from there; ``elsewhere``: further tables of each restaurant; ``times``: what its
        tables here stand for."""
        d, rng, first = self.d, self.rng, self.first
        held = np.bincount(self.house, weights=self.tables(), minlength=self.houses)
        more = np.zeros(self.houses) if elsewhere is None else elsewhere
        home, base = self.house[self.cells], base[self.cells]
        less = base if less is None else less[self.cells]
        for k in range(SLICES):
            who = self.order[self.bounds[k] : self.bounds[k + 1]]
            if not len(who):
                break
            cell, seat = self.cell[who], self.seat[who]
            several = bool((cell[1:] == cell[:-1]).any())
            np.subtract.at(self.at_table, seat, 1)
            closed = self.at_table[seat] == 0
            gone = seat[closed]
            if several:
                gone = np.unique(gone)
            if len(gone):
                owner = self.cell[gone]
                self.free[first[owner] + self.n_free[owner] + (_rank_in_runs(owner) if several else 0)] = gone
                np.add.at(self.n_free, owner, 1)
                np.subtract.at(held, home[owner], 1)
            size, tables = self.size[cell], self.size[cell] - self.n_free[cell]
            others = size - (np.bincount(cell, minlength=len(self.size))[cell] if several else 1)
            new = (STRENGTH + d * (times * held[home[cell]] + more[home[cell]])) * np.where(closed, less[cell], base[cell])
            opens = rng.random(len(who)) * (new + others - d * tables) < new
            opens |= others == 0
            to = np.empty(len(who), np.int64)
            # a table with a chance of its customers less d: that of a random other customer, or another try
            left = np.flatnonzero(~opens)
            while len(left):
                n, at = size[left], cell[left]
                place = who[left] - first[at] + 1 + (rng.random(len(left)) * (n - 1)).astype(np.int64)
                other = first[at] + place % n
                seats = self.seat[other]
                sure = (tables[left] == 1) | (tables[left] == others[left])
                taken = sure | (rng.random(len(left)) * self.at_table[seats] < self.at_table[seats] - d)
                if several:
                    taken &= self.turn[other] != k
                to[left[taken]] = seats[taken]
                left = left[~taken]
            opening = np.flatnonzero(opens)
            owner = cell[opening]
            to[opening] = self.free[first[owner] + self.n_free[owner] - 1 - (_rank_in_runs(owner) if several else 0)]
            np.subtract.at(self.n_free, owner, 1)
            np.add.at(held, home[owner], 1)
            np.add.at(self.at_table, to, 1)
            self.seat[who] = to


def _word_hashes(words: list[str]) -> np.ndarray:
    data, offsets = ragged.utf8(pa.array(words, pa.string()))
    return ragged.hashes(data, offsets[:-1], offsets[1:])


def _level(count):
    return F.floor(F.log2(count.cast("double")) * 16).cast("int")


def _with_end(marks: np.ndarray, starts: np.ndarray, offsets: np.ndarray, end: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens with the end of each text, and their rows."""
    per_row = ragged.per_row(starts, offsets)
    out = np.full(len(marks) + len(per_row), end, np.uint64)
    out[np.arange(len(marks)) + np.repeat(np.arange(len(per_row)), per_row)] = marks
    return out, np.repeat(np.arange(len(per_row)), per_row + 1)


def count_tokens(docs: DataFrame) -> DataFrame:
    """``h, c, a``: hash of each token of the first column of ``docs``, its number in rows whose second is true, and in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = _word_hashes([END])[0]
        for batch in batches:
            data, offsets = ragged.utf8(batch.column(0))
            learn = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in ragged.blocks(offsets, BLOCK):
                part = offsets[a : b + 1] - offsets[a]
                _, starts, _, marks = ragged.words(data[offsets[a] : offsets[b]], part)
                every, row = _with_end(marks, starts, part, end)
                order = np.argsort(every)
                sort = every[order]
                first = np.flatnonzero(np.concatenate([[True], sort[1:] != sort[:-1]]))
                yield pa.RecordBatch.from_arrays([pa.array(sort[first].view(np.int64)), pa.array(np.add.reduceat(learn[a:b][row[order]], first)), pa.array(np.diff(np.append(first, len(sort))))], names=["h", "c", "a"])

    return docs.mapInArrow(count, "h long, c long, a long").groupBy("h").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))


def _head(vocabulary: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int, int]:
    """Hashes and training counts of the most frequent tokens, at most HEAD, by whole levels of their logarithmic count; N, V and all tokens."""
    levels = vocabulary.groupBy(_level(F.col("a")).alias("level")).agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("v"), F.sum("a").alias("a")).orderBy(F.desc("level")).collect()
    least, room = 1 << 20, HEAD
    for r in levels:
        if r.n > room:
            break
        least, room = r.level, room - r.n
    rows = vocabulary.where(_level(F.col("a")) >= least).toArrow()
    marks, counts, every = (rows.column(name).to_numpy() for name in ("h", "c", "a"))
    order = np.lexsort((marks, -every))
    return marks[order].view(np.uint64), np.stack([counts[order], every[order]]), sum(r.c for r in levels), sum(r.v for r in levels), sum(r.a for r in levels)


def _base(c: np.ndarray, t: np.ndarray, totals: dict) -> np.ndarray:
    """Probability in the parent of words with c customers at t tables there."""
    whole = STRENGTH + totals["customers"]
    fresh = (STRENGTH + totals["d"] * totals["tables"]) / whole
    return np.where(c > 0, np.maximum(c - totals["d"] * t, 0) / whole + fresh * (1 - UNSEEN_BASE) / max(totals["types"], 1), fresh * UNSEEN_BASE)


def _base_less(c: np.ndarray, t: np.ndarray, totals: dict) -> np.ndarray:
    """The same once one of their customers has left."""
    return _base(c - 1, np.minimum(t, c - 1), totals | {"customers": max(totals["customers"] - 1, 0)})


def predictive(n: np.ndarray, tables: np.ndarray, house: np.ndarray, held: np.ndarray, customers: np.ndarray, base: np.ndarray, d: float) -> np.ndarray:
    """Probability of each cell's dish in its restaurant, which has ``held`` tables and ``customers``."""
    return (np.maximum(n - d * tables, 0) + (STRENGTH + d * held)[house] * base) / (STRENGTH + customers)[house]


def _ask(bucket: int, buckets: int, keys: np.ndarray, tables: np.ndarray, kind: str = "tables") -> list:
    """What a bucket tells each shard of the parent of its words; the keys are sorted by shard."""
    place = _places(keys, buckets).astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return [(int(place[a]), kind, bucket, pack(key=keys[a:b], t=tables[a:b])) for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(keys)], strict=True)]


def _tables_told(state: dict, seating: Seating) -> np.ndarray:
    """Tables of each word that the bucket asks for, and of each dealt-out context."""
    t = seating.tables()
    told = np.bincount(state["wi"], weights=t, minlength=len(state["key"]))
    held = np.bincount(seating.house, weights=t, minlength=seating.houses)
    told[state["hot_at"]] = held[state["hot"]]
    return told.astype(np.int64)


def score_corpus(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = (), seed: int = 7) -> DataFrame:
    """Learn from the rows of ``docs`` where ``learn`` is true, and score all rows.

    Gives ``id``, the columns ``also``, ``n_tokens, n_known, train_tokens, base_score, score, perplexity`` for each row. A null
    text counts as empty and is one token, its end. Scores are sums of log10 probabilities over a row's tokens;
    ``base_score`` is the add-one estimate, ``score`` the model's, ``perplexity`` 10 to the power of minus its mean. Rows are
    told apart by their place in the input, so repeated and null ids each give their row; the input's scan must give the
    same rows again if a task is repeated, as a table does. With no training rows every token is unseen; an empty table
    gives no rows. Columns of ``docs`` that are not named are not read. A null ``learn`` is false.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "language-model")
    source = docs.select(F.col(text_col).alias("__text"), F.coalesce(learn, F.lit(False)).alias("__learn"), id_col, *also)
    kept_fields = source.schema.fields[2:]
    vocabulary = scratch.save(count_tokens(source.select("__text", "__learn")), "vocabulary")
    marks, counts, tokens, types, every = _head(vocabulary)
    scratch.drop("vocabulary")
    buckets = max(1, -(-every // BUCKET_TOKENS))
    hot = int((counts[1] > every / (4 * buckets)).sum()) if buckets > 1 else 0
    held = spark.sparkContext.broadcast((marks, counts[0][:hot]))
    asides = max(1, buckets // 8)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, end = ragged.HashTable(held.value[0]), _word_hashes([END])[0]
        base = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = ragged.utf8(batch.column(0))
            learns = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in ragged.blocks(offsets, BLOCK):
                part = offsets[a : b + 1] - offsets[a]
                _, starts, _, found = ragged.words(data[offsets[a] : offsets[b]], part)
                h, row = _with_end(found, starts, part, end)
                at = table.find(h)
                w = np.where(at >= 0, at.view(np.uint64), h | _TAIL)
                u = np.concatenate([w[-1:], w[:-1]])  # before each text stands an end, and one is last
                mixed_u, mixed_w = _mix(u), _mix(w)
                bucket = (np.where(u < np.uint64(hot), _mix(mixed_u ^ w), mixed_u) >> np.uint64(20)) % np.uint64(buckets)
                key = (bucket << np.uint64(40)) | ((mixed_u & np.uint64(0xFFFFF)) << np.uint64(20)) | (mixed_w & np.uint64(0xFFFFF))
                order = np.argsort(key)
                u, w, bucket, told = u[order], w[order], bucket[order].astype(np.int64), (2 * row + learns[a:b][row])[order]
                new_u = np.concatenate([[True], (u[1:] != u[:-1]) | (bucket[1:] != bucket[:-1])])
                cell = np.flatnonzero(new_u | np.concatenate([[True], w[1:] != w[:-1]]))
                house = np.flatnonzero(new_u)
                ends = np.searchsorted(bucket, np.arange(buckets + 1))
                out = []
                for k in range(buckets):
                    x, y = ends[k], ends[k + 1]
                    if x < y:
                        c, g = cell[slice(*np.searchsorted(cell, [x, y]))], house[slice(*np.searchsorted(house, [x, y]))]
                        out.append((k, "blob", base, pack(u=u[g], ul=np.diff(np.append(np.searchsorted(c, g), len(c))), w=w[c], m=np.diff(np.append(c, y)), d=told[x:y])))
                sink = pa.BufferOutputStream()
                mine = batch.slice(a, b - a).select(range(2, batch.num_columns))
                with pa.ipc.new_stream(sink, mine.schema) as writer:
                    writer.write_batch(mine)
                out.append((buckets + base % asides, "rows", base, sink.getvalue().to_pybytes()))
                base += 1
                yield _batch(out)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _rows(batches)
        for bucket, base, payload in rows.get("rows", []):
            yield _batch([(bucket, "rows", base, payload)])
        if blobs := rows.get("blob"):
            bucket, parts = blobs[0][0], [unpack(p) for _, _, p in blobs]
            u = np.concatenate([np.repeat(p["u"], p["ul"]) for p in parts]).astype(np.uint64)
            w, m = (np.concatenate([p[x] for p in parts]) for x in ("w", "m"))
            told = np.concatenate([p["d"] for p in parts])
            m, w = m.astype(np.int64), w.astype(np.uint64)
            learned = np.add.reduceat((told & 1).astype(np.int64), np.cumsum(m) - m)
            houses, house = np.unique(u, return_inverse=True)
            keys, word = np.unique(w, return_inverse=True)
            code, cell = np.unique(house * len(keys) + word, return_inverse=True)
            n = np.bincount(cell, weights=learned, minlength=len(code)).astype(np.int64)
            # what is asked of the parent: all words, and the tables of dealt-out contexts, sorted by shard
            dealt = np.flatnonzero(houses < np.uint64(hot))
            asked = np.concatenate([keys, houses[dealt] | _HOT])
            by_shard = np.lexsort((asked, _places(asked, buckets)))
            rank = np.empty(len(asked), np.int64)
            rank[by_shard] = np.arange(len(asked))
            state = {"u": houses, "ul": np.bincount(code // len(keys), minlength=len(houses)), "key": asked[by_shard], "wi": rank[code % len(keys)], "hot": dealt, "hot_at": rank[len(keys) :], "n": n}
            order_of = [np.argsort(p["d"] >> 1, kind="stable") for p in parts]
            cells = np.split(np.repeat(cell, m), np.cumsum([len(p["d"]) for p in parts])[:-1])
            docs_of = [np.unique(p["d"] >> 1, return_counts=True) for p in parts]
            seen = pack(
                base=np.array([b for _, b, _ in blobs]), docs=np.array([len(d) for d, _ in docs_of]), doc=np.concatenate([d for d, _ in docs_of]), k=np.concatenate([k for _, k in docs_of]),
                cell=np.concatenate([c[o] for c, o in zip(cells, order_of, strict=True)]),
            )
            house = np.repeat(np.arange(len(houses)), state["ul"])
            first = Seating(np.minimum(n, 1), house, len(houses), 0.5, np.random.default_rng(0))
            yield _batch([(bucket, "seen", 0, seen), (bucket, "state", 0, pack(**state)), (bucket, "stats", 0, pack(s=np.array([(n == 1).sum(), (n == 2).sum()], float))), *_ask(bucket, buckets, state["key"], _tables_told(state, first))])

    def table(name: str, kind: str) -> DataFrame:
        return spark.read.schema(ROWS).parquet(scratch.path(name)).where(F.col("kind") == kind).select("bucket", "kind", "base", "payload")

    def write(name: str, rows: DataFrame) -> None:
        scratch.write(rows, name, partition_by="kind")

    def stats(name: str) -> np.ndarray:
        return sum((unpack(r.payload)["s"] for r in table(name, "stats").select("payload").collect()), np.zeros(4))

    write("dealt", source.mapInArrow(deal, ROWS).repartitionById(buckets + asides, "bucket").mapInArrow(gather, ROWS))
    ones, twos = (unpacked := sum((unpack(r.payload)["s"] for r in table("dealt", "stats").select("payload").collect()), np.zeros(2)))[0], unpacked[1]
    d = discount(ones, twos)

    def parent(name: str, told: DataFrame, step: int) -> dict:
        """Seat the parent's customers; what each bucket asked for goes to the table ``name``."""

        def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = _rows(batches).get("tables", [])
            if not rows:
                return
            shard, parts = rows[0][0], [unpack(p) for _, _, p in rows]
            keys, back = np.unique(np.concatenate([p["key"] for p in parts]).astype(np.uint64), return_inverse=True)
            c = np.bincount(back, weights=np.concatenate([p["t"] for p in parts]), minlength=len(keys)).astype(np.int64)
            word = (keys & _HOT == 0) | (keys >= _TAIL)
            n = np.where(word, c, 0)
            ones, twos = float((n == 1).sum()), float((n == 2).sum())
            seating = Seating(n, np.zeros(len(n), np.int64), 1, discount(ones, twos), np.random.default_rng([seed, step, shard, 1]))
            for _ in range(PARENT_TURNS):
                seating.sweep(np.full(len(n), (1 - UNSEEN_BASE) / max(types, 1)), times=float(buckets))
            t = seating.tables()
            sums = np.array([n.sum(), t.sum(), ones, twos], float)
            t = np.where(word, t, 0)
            ends = np.cumsum([0, *(len(p["key"]) for p in parts)])
            yield _batch([(shard, "stats", 0, pack(s=sums)), *((base, "parent", shard, pack(c=c[back[x:y]], t=t[back[x:y]])) for (_, base, _), x, y in zip(rows, ends[:-1], ends[1:], strict=True))])

        write(name, told.repartitionById(buckets, "bucket").mapInArrow(seat, ROWS))
        customers, tables, ones, twos = stats(name)
        return {"customers": customers, "tables": tables, "d": discount(ones, twos), "types": types}

    def visit(step: int, totals: dict):
        """Take the predictive probabilities of the seating as it is, if it counts, and seat the customers again."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = _rows(batches)
            for bucket, base, payload in rows.get("rows", []):
                yield _batch([(bucket, "rows", base, payload)])
            if "state" not in rows:
                return
            bucket, state = rows["state"][0][0], unpack(rows["state"][0][2])
            answers = [unpack(p) for _, _, p in rows["parent"]]
            c, t = (np.concatenate([a[x] for a in answers]).astype(np.int64) for x in "ct")
            houses, n, wi = len(state["u"]), state["n"].astype(np.int64), state["wi"].astype(np.int64)
            house = np.repeat(np.arange(houses), state["ul"])
            base = _base(c, t, totals)[wi]
            seating = Seating(n, house, houses, d, np.random.default_rng([seed, step, bucket]), state.get("seats"))
            tables = seating.tables()
            mine = np.bincount(house, weights=tables, minlength=houses)
            customers = np.bincount(house, weights=n, minlength=houses)
            elsewhere = np.zeros(houses)
            elsewhere[state["hot"]] = c[state["hot_at"]] - mine[state["hot"]]
            customers[state["hot"]] = held.value[1][state["u"][state["hot"]].astype(np.int64)]
            if step > BURN_IN:
                now = predictive(n, tables, house, mine + elsewhere, customers, base, d)
                state["p"] = state.get("p", np.zeros(len(n), np.float32)) + (now / KEPT).astype(np.float32)
            if step < BURN_IN + KEPT:
                seating.sweep(base, _base_less(c, t, totals)[wi], elsewhere)
                state["seats"] = seating.seats()
                yield _batch([(bucket, "state", 0, pack(**state)), *_ask(bucket, buckets, state["key"], _tables_told(state, seating))])
                return
            log_p, log_c, known = np.log10(state["p"].astype(float)), np.log10(customers + 1)[house], (customers > 0).astype(np.int64)[house]
            seen = unpack(rows["seen"][0][2])
            cell, k = seen["cell"].astype(np.int64), seen["k"].astype(np.int64)
            heads = np.cumsum(k) - k
            sums = [np.add.reduceat(x[cell], heads) for x in (log_p, log_c, known)]
            ends = np.cumsum(np.concatenate([[0], seen["docs"].astype(np.int64)]))
            yield _batch([(bucket, "sums", int(b), pack(doc=seen["doc"][x:y], k=k[x:y], score=sums[0][x:y].astype(np.float32), base=sums[1][x:y], known=sums[2][x:y])) for b, x, y in zip(seen["base"].tolist(), ends[:-1], ends[1:], strict=True)])

        return run

    totals = parent("parent-0", table("dealt", "tables"), 0)
    scratch.drop("dealt/kind=tables")
    last = "dealt"
    for step in range(1, BURN_IN + KEPT + 1):
        told = table(last, "state").unionByName(table(f"parent-{step - 1}", "parent"))
        if step == BURN_IN + KEPT:
            break
        write(f"seated-{step}", told.repartitionById(buckets, "bucket").mapInArrow(visit(step, totals), ROWS))
        scratch.drop(f"parent-{step - 1}", f"{last}/kind=state")
        last = f"seated-{step}"
        totals = parent(f"parent-{step}", table(last, "tables"), step)
        scratch.drop(f"{last}/kind=tables")
    write("scored", told.unionByName(table("dealt", "seen")).repartitionById(buckets, "bucket").mapInArrow(visit(step, totals), ROWS))
    scratch.drop("dealt/kind=seen", f"{last}/kind=state", f"parent-{step - 1}")

    smooth = float(np.log10(tokens + types + 1))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one block lie together, those of its texts first."""
        block: pa.RecordBatch | None = None
        of, found = -1, np.zeros((4, 0))

        def done() -> pa.RecordBatch:
            k, score, base, known = found
            columns = [pa.array(k.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(k), tokens, np.int64)), pa.array(base - k * smooth), pa.array(score), pa.array(10 ** (-score / np.maximum(k, 1)))]
            return pa.RecordBatch.from_arrays([*block.columns, *columns], names=[*block.schema.names, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

        for batch in batches:
            for kind, base, payload in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if kind == "rows":
                    if block is not None:
                        yield done()
                    block = pa.ipc.open_stream(payload).read_next_batch()
                    of, found = base, np.zeros((4, block.num_rows))
                    continue
                assert base == of, "a block's sums came before its rows"
                part = unpack(payload)
                for i, name in enumerate(("k", "score", "base", "known")):
                    found[i, part["doc"].astype(np.int64)] += part[name]
        if block is not None:
            yield done()

    every_row = table("scored", "sums").unionByName(table("dealt", "rows"))
    spread = max(1, -(-every // (1 << 20)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept_fields)
    return (
        every_row.repartition(spread, "base")
        .sortWithinPartitions("base", F.col("kind") != "rows", "bucket")
        .mapInArrow(finish, f"{fields}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
    )
