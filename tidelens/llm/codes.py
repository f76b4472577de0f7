"""Vectors as short codes: product quantisation by exact integer Lloyd rounds, assigned with trees over both parts and entries."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm.shared import freed, small_batches, table

#: Within this limit squared distances times the number of entries fit in 64 bits.
MOST = 2**20


class Tree:
    """A balanced tree over the points of every part at once: points (parts x n x width) are reordered so that node k of a level holds a run.

    order: where each point was; at: run bounds of each level; low, high: boxes of each level's nodes (parts x nodes x width);
    before: sums of all points ahead in their part.
    """

    def __init__(self, points: np.ndarray, leaf: int):
        parts, n, _ = points.shape
        self.points, self.order = points, np.broadcast_to(np.arange(n), (parts, n))
        self.at, self.low, self.high = [], [], []
        while True:
            nodes = 1 << len(self.at)
            at = n * np.arange(nodes + 1) // nodes
            self.at.append(at)
            self.low.append(np.minimum.reduceat(self.points, at[:-1], axis=1))
            self.high.append(np.maximum.reduceat(self.points, at[:-1], axis=1))
            if n <= leaf * nodes or 2 * nodes > n:
                break
            # every node is split where its box is widest, at the middle of the next level's run
            widest = np.argmax(self.high[-1] - self.low[-1], axis=2)
            size = np.diff(at)
            along = np.take_along_axis(self.points, np.repeat(widest, size, axis=1)[:, :, None], axis=2)[:, :, 0]
            move = np.lexsort((along, np.broadcast_to(np.repeat(np.arange(nodes), size), along.shape)), axis=1)
            self.points = np.take_along_axis(self.points, move[:, :, None], axis=1)
            self.order = np.take_along_axis(self.order, move, axis=1)
        self.before = np.concatenate([np.zeros_like(self.points[:, :1]), np.cumsum(self.points, axis=1)], axis=1)


def assign(tree: Tree, entries: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each point's nearest entry (ties: the first), in the tree's order (parts x n), and the sums and numbers of each entry's points.

    Pairs of nodes go down both trees together. A pair is dropped if its boxes are further apart than the farthest corners of some other
    entry node are from the same points. Where one entry is left for a node, the node's cached sum goes to it whole; points of
    leaves with more are compared one by one. All distances are integers, so bounds are exact.
    """
    parts, n, width = tree.points.shape
    n_entries = entries.points.shape[1]
    codes = np.zeros((parts, n), np.int16)
    sums, counts = np.zeros((parts, n_entries, width), np.int64), np.zeros((parts, n_entries), np.int64)
    part, node, entry = np.arange(parts), np.zeros(parts, np.int64), np.zeros(parts, np.int64)
    deep, deep_entries = len(tree.at) - 1, len(entries.at) - 1
    level = level_e = 0
    while True:
        low, high = tree.low[level][part, node], tree.high[level][part, node]
        low_e, high_e = entries.low[level_e][part, entry], entries.high[level_e][part, entry]
        apart = np.maximum(np.maximum(low_e - high, low - high_e), 0)
        far = np.maximum(high_e - low, high - low_e)
        nearest, farthest = squared(apart), squared(far)
        # pairs of one node lie together
        owner = part * len(tree.at[level]) + node
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        size = np.diff(np.append(first, len(owner)))
        hold = nearest <= np.repeat(np.minimum.reduceat(farthest, first), size)
        left = np.add.reduceat(hold, first)
        if level_e == deep_entries:
            alone = hold & np.repeat(left == 1, size)
            p, k, e = part[alone], node[alone], entries.order[part[alone], entry[alone]]
            a, b = tree.at[level][k], tree.at[level][k + 1]
            np.add.at(sums, (p, e), tree.before[p, b] - tree.before[p, a])
            np.add.at(counts, (p, e), b - a)
            codes.reshape(-1)[spread(p * n + a, b - a)] = np.repeat(e, b - a)
            hold &= ~alone
        part, node, entry = part[hold], node[hold], entry[hold]
        if level == deep and level_e == deep_entries:
            break
        wide, wide_e = 1 + (level < deep), 1 + (level_e < deep_entries)
        if not len(part):
            break
        level, level_e = min(level + 1, deep), min(level_e + 1, deep_entries)
        # children: a node's pairs first by its own child, then by the entries'
        owner = part * len(tree.at[level]) + node
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        size = np.diff(np.append(first, len(owner)))
        take = np.repeat(spread(np.repeat(first, wide), np.repeat(size, wide)), wide_e)
        child = np.repeat(np.tile(np.arange(wide), len(first)), np.repeat(size, wide) * wide_e)
        part, node, entry = part[take], node[take] * wide + child, entry[take] * wide_e + np.tile(np.arange(wide_e), len(take) // wide_e)
    if len(part):
        # uncertain leaves: each point with each entry left, the smallest distance first, then the smallest index
        owner = part * len(tree.at[deep]) + node
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        size = np.diff(np.append(first, len(owner)))
        a, b = tree.at[deep][node[first]], tree.at[deep][node[first] + 1]
        p, point, size = np.repeat(part[first], b - a), spread(a, b - a), np.repeat(size, b - a)
        first = np.repeat(first, b - a)
        for block in blocks(size, 1 << 18):
            n_left, who, at = size[block], p[block], point[block]
            pair = spread(first[block], n_left)
            of, which = part[pair], entry[pair]
            gap = np.repeat(tree.points[who, at], n_left, axis=0) - entries.points[of, which]
            key = squared(gap) * n_entries + entries.order[of, which]
            best = np.minimum.reduceat(key, np.cumsum(n_left) - n_left) % n_entries
            codes[who, at] = best
            np.add.at(sums, (who, best), tree.points[who, at])
            np.add.at(counts, (who, best), 1)
    return codes, sums, counts


def book_tree(books: np.ndarray) -> Tree:
    """A tree with an entry a leaf: up to the next power of two the last entry is repeated, under its own index."""
    n = books.shape[1]
    more = (1 << (n - 1).bit_length()) - n
    tree = Tree(np.concatenate([books, np.repeat(books[:, -1:], more, axis=1)], axis=1), 1)
    tree.order = np.minimum(tree.order, n - 1)
    return tree


def blocks(size: np.ndarray, most: int):
    """Slices of runs that together hold about `most`, as bounds of the work at a time."""
    at = np.flatnonzero(np.diff(np.cumsum(size) // most, prepend=-1))
    for x, y in zip(at, np.append(at[1:], len(size)), strict=True):
        yield slice(x, y)


def squared(gaps: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", gaps, gaps)


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each run, one run after the other."""
    ahead = np.cumsum(size) - size
    return np.repeat(first - ahead, size) + np.arange(size.sum())


def split(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """A batch's vectors of one length, as parts x rows x width."""
    q = batch.column("q")
    n = len(q)
    return np.ascontiguousarray(q.flatten().to_numpy().reshape(n, parts, -1).transpose(1, 0, 2))


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """vectors (vec_id, embedding, label) without those that are null or hold null or non-finite components, with integers q."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label"))
    v = v.where(F.col("x").isNotNull() & F.forall("x", lambda x: F.coalesce(fine(x), F.lit(False))))
    return v.select("vec_id", "label", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("q"))


def train(v: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, leaf: int = 16) -> np.ndarray | None:
    """Codebooks (parts x entries x width) of whole_vectors() rows of one length: Lloyd rounds from the rows of the smallest vec_ids.

    Rows without vec_id come last, equal vec_ids by their integers; fewer rows than entries make fewer entries. None if there is no
    vector whose length is a positive multiple of parts. Only codebooks, of a size that the data don't change, come to the driver: tasks
    add up their points by entry, Spark adds the tasks' sums.
    """
    usable = v.where((F.size("q") > 0) & (F.size("q") % parts == 0))
    start = usable.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    if not start:
        return None
    length = len(start[0].q)
    rows = v.where(F.size("q") == length)
    start = [r.q for r in (start if all(len(r.q) == length for r in start) else rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect())]
    books = np.array(start, np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2)
    width = books.shape[2]
    for _ in range(rounds):

        def added(batches, books=books):
            tree = book_tree(books)
            total, number = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for b in batches:
                if len(b):
                    _, sums, counts = assign(Tree(within(split(b, parts)), leaf), tree)
                    total += sums[:, : books.shape[1]]
                    number += counts[:, : books.shape[1]]
            p, e = np.nonzero(number)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(p, width), pa.int32()), pa.array(np.repeat(e, width), pa.int32()), pa.array(np.tile(np.arange(width), len(p)), pa.int32()), pa.array(total[p, e].ravel(), pa.int64()), pa.array(np.repeat(number[p, e], width), pa.int64())], ["part", "entry", "at", "total", "n"])

        sums = rows.select("q").mapInArrow(freed(added), "part int, entry int, at int, total long, n long").groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        books = books.copy()
        for r in sums.collect():  # one row for each number of the codebooks
            books[r.part, r.entry, r["at"]] = r.total // r.n
    return books


def within(points: np.ndarray) -> np.ndarray:
    if points.size and max(-int(points.min()), int(points.max())) > MOST:
        raise ValueError(f"components beyond {MOST} units don't fit in 64-bit sums; use a smaller scale")
    return points


def encode(v: DataFrame, books: np.ndarray, leaf: int = 16) -> DataFrame:
    """(vec_id, label, code, error): each vector's entries, a byte a part, and its squared distance to them; null where its length is another."""
    parts, _, width = books.shape

    def coded(batches):
        tree = book_tree(books)
        for b in batches:
            if not len(b):
                continue
            points = within(split(b, parts))
            sorted_ = Tree(points, leaf)
            found, _, _ = assign(sorted_, tree)
            codes = np.empty(found.shape, np.uint8)
            np.put_along_axis(codes, sorted_.order, found.astype(np.uint8), axis=1)
            gap = points - books[np.arange(parts)[:, None], codes]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([c.tobytes() for c in codes.T], pa.binary()), pa.array((gap * gap).sum(axis=(0, 2)))], ["vec_id", "label", "code", "error"])

    same = F.size("q") == parts * width
    label = v.schema["label"].dataType.simpleString()
    return v.where(same).mapInArrow(freed(coded), f"vec_id long, label {label}, code binary, error long").unionByName(
        v.where(~same).select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")))


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, salts: int = 16) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of vectors (vec_id, embedding, label), at most 256 entries a codebook.

    Rows whose vector is null or holds null or non-finite components are dropped. Others become floor(scale * x), cut into equal
    parts. The length is that of the smallest vec_id's vector among those that parts divide; vectors of another length, empty ones too,
    stay with a null code and error. label_error adds up the errors of equal labels, nulls together. Rows that repeat a vec_id are coded
    each; nearest entries and starts break ties by index and by (vec_id, integers). An empty table gives an empty result; components
    beyond 2^20 units are an error, as sums might not fit; other columns are ignored, whatever their names.
    codebooks_sha256 is that of all integers of the codebooks by part, entry and position, with commas between.

    Batches are bounded, each with a tree of its own. A label may hold any share of the rows: sums are pre-aggregated, and the rows that
    meet them are dealt by label and a salt.
    """
    small_batches(vectors.sparkSession, 16_384, "32m")
    v = whole_vectors(vectors, scale)
    books = train(v, parts, entries, rounds)
    if books is None:
        return v.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = table(encode(v, books), "codes").withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)))
    sums = table(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    sums = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))
    both = coded.alias("c").join(sums.alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")) & (F.col("c.salt") == F.col("s.salt")), "left")
    return both.select("vec_id", "c.label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
