"""Exact top-k inner products with a bit-sliced index: slices of quantised attributes, added with bitmap arithmetic."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelens.llm.shared import cut


def slices(values: np.ndarray, bits: int) -> np.ndarray:
    """values (rows x attributes, unsigned) as bitmaps of rows: attribute, bit, words of 64 rows."""
    rows, attributes = values.shape
    wide = -(-rows // 64) * 8
    out = np.zeros((attributes, bits, wide), np.uint8)
    for b in range(bits):
        part = np.packbits((values >> np.uint64(b) & np.uint64(1)).astype(bool).T, axis=1, bitorder="little")
        out[:, b, : part.shape[1]] = part
    return out.view(np.uint64)


def total(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The slices of a sum, from lists of bitmaps of weight 1, 2, 4, ...: full adders turn three of a weight into one and a carry."""
    out, k = [], 0
    while k < len(columns):
        now = columns[k]
        if k + 1 == len(columns) and len(now) > 1:
            columns.append([])
        while len(now) > 2:
            a, b, c = now.pop(), now.pop(), now.pop()
            half = a ^ b
            now.insert(0, half ^ c)
            columns[k + 1].append((a & b) | (half & c))
        if len(now) == 2:
            a, b = now
            columns[k + 1].append(a & b)
            now = [a ^ b]
        out.append(now[0] if now else None)
        k += 1
    return out


def top(sums: list[np.ndarray], alive: np.ndarray, k: int) -> np.ndarray:
    """Rows with the k greatest sums among the alive: from the most significant slice down, rows with a bit set are kept
    while they are at most k; of the rows at the boundary, all equal at the end, the first."""
    sure, open_ = np.zeros_like(alive), alive
    for s in reversed(sums):
        with_bit = open_ & s if s is not None else np.zeros_like(alive)
        n = int(np.bitwise_count(sure | with_bit).sum())
        if n > k:
            open_ = with_bit
        else:
            sure = sure | with_bit
            open_ = open_ & ~s if s is not None else open_
            if n == k:
                return bits_of(sure)
    equal = bits_of(open_)[: k - int(np.bitwise_count(sure).sum())]
    return np.sort(np.concatenate([bits_of(sure), equal]))


def bits_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def search(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64, block_rows: int = 16_384, query_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id, embedding) whose vec_id is divisible by every, the k
    rows of greatest integer inner product, of floor(scale * x) of each component x; ties go to smaller vec_id.

    A query's candidates are all rows but those of its own vec_id. Rows that are null, hold null or non-finite
    components, or have no vec_id take no part; vectors of different lengths don't meet. Rows that repeat a vec_id are
    candidates each and one query, by the least of their vectors. Products must fit in 64 bits. An empty table gives an empty
    result; vectors may be of any length. Other columns are ignored, whatever their names.

    Candidates are dealt to blocks of about block_rows rows by a hash of the row, so each block becomes one bit-sliced index;
    queries are dealt to groups of about query_rows. Each group meets each block once: what is shipped is an index for each
    query_rows queries and a row for each query and block, a small part of the query_rows * block_rows scores it serves, and k
    rows a query and block come back. A group and a block are bounded, whatever the data.
    """
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("x"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = v.where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda x: F.coalesce(fine(x), F.lit(False))))
    v = v.select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("q"), F.size("x").alias("dims"))
    asks = F.when(F.col("vec_id") % every == 0, 1)
    sizes = cut(v.groupBy("dims").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"), F.ceil(F.count(asks) / query_rows).cast("int").alias("parts")))
    deal = lambda salt, n: F.pmod(F.xxhash64("vec_id", "q", F.lit(salt)), F.col(n)).cast("int")
    candidates = v.join(sizes, "dims").select("vec_id", "q", "dims", deal(0, "blocks").alias("block"))
    queries = v.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dims", "q")).alias("own")).select("vec_id", "own.q", "own.dims")
    queries = queries.join(sizes.where("parts > 0"), "dims").select("vec_id", "q", "dims", deal(1, "parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    index_schema = pa.schema([("dims", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("low", pa.binary()), ("slices", pa.binary()), ("bits", pa.int32())])

    def table(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = rows.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        q = rows.column("q").combine_chunks()
        return ids[order], q.flatten().to_numpy().reshape(len(ids), -1)[order]

    def build(rows: pa.Table) -> pa.Table:
        ids, q = table(rows)
        low = q.min(axis=0)
        bits = max(1, int((q.max(axis=0) - low).max(initial=0)).bit_length())
        made = slices((q - low).astype(np.uint64), bits)
        first = rows.slice(0, 1).to_pylist()[0]
        return pa.Table.from_pylist([{"dims": first["dims"], "block": first["block"], "ids": ids.tobytes(), "low": low.tobytes(), "slices": made.tobytes(), "bits": bits}], schema=index_schema)

    found_schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def probe(rows: pa.Table, index: pa.Table) -> pa.Table:
        if not len(rows) or not len(index):
            return found_schema.empty_table()
        at = index.to_pylist()[0]
        ids, low = np.frombuffer(at["ids"], np.int64), np.frombuffer(at["low"], np.int64)
        own = np.frombuffer(at["slices"], np.uint64).reshape(len(low), at["bits"], -1 if len(low) else 0)
        wide = -(-len(ids) // 64)
        full = np.zeros(wide * 8, np.uint8)
        part = np.packbits(np.ones(len(ids), bool), bitorder="little")
        full[: len(part)] = part
        everyone, flipped = full.view(np.uint64), ~own
        out = []
        for query, q in zip(*table(rows), strict=True):
            # a negative factor takes the complement of an attribute, so that all terms are positive
            columns: list[list[np.ndarray]] = [[]]
            for d, w in enumerate(q.tolist()):
                source, w = (own, w) if w > 0 else (flipped, -w)
                shift = 0
                while w:
                    if w & 1:
                        while len(columns) < shift + at["bits"]:
                            columns.append([])
                        for b in range(at["bits"]):
                            columns[shift + b].append(source[d, b])
                    w >>= 1
                    shift += 1
            sums = total(columns)
            alive = everyone
            a, b = np.searchsorted(ids, [query, query + 1])
            if b > a:
                mask = np.unpackbits(everyone.view(np.uint8), bitorder="little")
                mask[a:b] = 0
                alive = np.packbits(mask, bitorder="little").view(np.uint64)
            best = top(sums, alive, k)
            constant = int((q * low).sum()) + int(q[q < 0].sum()) * ((1 << at["bits"]) - 1)
            score = np.full(len(best), constant, np.int64)
            for b, s in enumerate(sums):
                if s is not None:
                    score += (s[best >> 6] >> (best & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << b
            out.append((np.full(len(best), query), ids[best], score))
        return pa.Table.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], schema=found_schema)

    index = candidates.groupBy("dims", "block").applyInArrow(build, "dims int, block int, ids binary, low binary, slices binary, bits int")
    # each group of queries meets its copy of the block's index
    copies = index.join(sizes.where("parts > 0"), "dims").select("dims", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "ids", "low", "slices", "bits")
    found = queries.groupBy("dims", "block", "part").cogroup(copies.groupBy("dims", "block", "part")).applyInArrow(probe, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
