"""Repeated passages by fixed-block anchors: blocks of each document are indexed, every rolling window probes them,
and hits are extended to maximal repeats of whole windows."""

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelens.llm.shared import Words, freed_group, freed_groups, mix

NO_ID = 2**63 - 1


def packed(values: np.ndarray, delta: bool) -> bytes:
    """Unsigned integers, as differences if sorted, byte plane by byte plane, compressed."""
    if delta:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return pa.compress(np.ascontiguousarray(planes), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: type, delta: bool) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    values = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if delta else values


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts keys, and where in it each distinct key begins."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)


def anchor(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard and 32 bits within it."""
    return ((h >> np.uint64(32)) % np.uint64(shards) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def by_shard(shards: int, at: np.ndarray):
    """(shard, from, to) for sorted shard numbers."""
    edges = np.searchsorted(at, np.arange(shards + 1))
    return [(s, edges[s], edges[s + 1]) for s in range(shards) if edges[s + 1] > edges[s]]


def rows_of(rows: list, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(schema), schema.types, strict=True)], schema=schema)


def remove_repeats(docs: DataFrame, window: int = 13, block: int | None = None, batch_mb: float = 12, shard_words: int = 4_000_000, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of docs (doc_id, text); with texts, also kept_text and row, the row of docs but for its text.

    Words are runs of characters other than white space, unchanged. A word goes if it lies in a window of so many
    words whose sequence also starts in a document of smaller doc_id; windows are judged on the input.
    kept_sha256: of the kept words joined by one space. kept_text: those words, or the text as it is if nothing was removed. A
    null text has no words. Rows without doc_id are judged against all others and remove nothing. Rows that repeat
    a doc_id, with the same text or others, are judged each by its own text and don't remove each other. An empty table gives an empty
    result; very long texts are read whole. Other columns of docs are ignored, whatever their names.

    Documents are dealt once to batches. Every block-th word of a document starts an indexed block of
    block = (window + 1) / 2 words, so each window of the document holds one whole. Each batch sends the distinct hashes of
    all its rolling runs of block words to shards of the hash space, sorted and packed, and marks the indexed ones; a shard
    answers which hashes are indexed somewhere and occur in two documents. Only windows around such hits are
    extended: their 64-bit hashes go to shards with the least doc_id, and come back with the least of all batches.
    A passage in a third of the documents is one row of each batch, so no shard or batch grows with it.
    """
    spark = docs.sparkSession
    block = block or (window + 1) // 2
    rest = [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")] * texts
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *rest)
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    n_batches = max(1, int(-(-size // (batch_mb * 2**20))), -(-rows // 100_000))
    shards = max(1, -(-size // (6 * shard_words)))
    spread = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(n_batches)).cast("int")
    dealt = docs.withColumn("batch", spread).repartition(n_batches, "batch")
    probe_kind = "shard int, batch int, n int, keys binary, indexed binary, several binary"
    probe_schema = pa.schema([("shard", pa.int32()), ("batch", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("indexed", pa.binary()), ("several", pa.binary())])
    hit_schema = pa.schema([("batch", pa.int32()), ("shard", pa.int32()), ("n", pa.int32()), ("keys", pa.binary())])
    long_schema = pa.schema([("shard", pa.int32()), ("batch", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary())])

    def ids(t: pa.Table) -> np.ndarray:
        return t.column("doc_id").fill_null(NO_ID).to_numpy()

    def probes(t: pa.Table) -> pa.Table:
        words = Words(t.column("text"))
        at, h = words.runs(block)
        owner = np.repeat(np.arange(len(t)), np.diff(words.first))[at]
        where = anchor(h, shards)
        order, first = groups(where)
        out = []
        if len(order):
            doc = ids(t)[owner][order]
            lead = np.repeat(doc[first], np.diff(np.append(first, len(order))))
            several = np.logical_or.reduceat(doc != lead, first)
            indexed = np.logical_or.reduceat(((at - words.first[owner]) % block == 0)[order], first)
            keys = where[order][first]
            batch = t.column("batch")[0].as_py()
            for s, a, b in by_shard(shards, keys >> np.uint64(32)):
                out.append((s, batch, b - a, packed(keys[a:b].astype(np.uint32), True), np.packbits(indexed[a:b]).tobytes(), np.packbits(several[a:b]).tobytes()))
        return rows_of(out, probe_schema)

    def hits(t: pa.Table) -> pa.Table:
        sent = t.to_pylist()
        parts = [unpacked(r["keys"], r["n"], np.uint32, True) for r in sent]
        flag = [np.concatenate([np.unpackbits(np.frombuffer(r[c], np.uint8), count=r["n"]) for r in sent]).astype(bool) for c in ("indexed", "several")]
        keys = np.concatenate(parts)
        order, first = groups(keys)
        n = np.diff(np.append(first, len(keys)))
        live = np.logical_or.reduceat(flag[0][order], first) & ((n > 1) | np.logical_or.reduceat(flag[1][order], first))
        alive = np.empty(len(keys), bool)
        alive[order] = np.repeat(live, n)
        out, k = [], 0
        for r, p in zip(sent, parts, strict=True):
            found = p[alive[k : k + len(p)]]
            k += len(p)
            if len(found):
                out.append((r["batch"], r["shard"], len(found), packed(found, True)))
        return rows_of(out, hit_schema)

    def extended(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(t) or not len(answers):
            return rows_of([], long_schema)
        live = np.sort(np.concatenate([(np.uint64(r["shard"]) << np.uint64(32)) | unpacked(r["keys"], r["n"], np.uint32, True).astype(np.uint64) for r in answers.to_pylist()]))
        words = Words(t.column("text"))
        at, h = words.runs(block)
        where = anchor(h, shards)
        low = np.zeros(1 << 22, bool)
        low[(live & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        maybe = np.flatnonzero(low[(where & np.uint64((1 << 22) - 1)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(live, where[maybe]), len(live) - 1)
        hit = np.zeros(len(words.hashes) + 1, np.int32)
        hit[at[maybe[live[spot] == where[maybe]]] + 1] = 1
        before = np.cumsum(hit)
        start, long = words.runs(window)
        near = before[start + window - block + 1] > before[start]
        start, long = start[near], long[near]
        owner = np.repeat(np.arange(len(t)), np.diff(words.first))[start]
        order, first = groups(long)
        out = []
        if len(order):
            least = np.minimum.reduceat(ids(t)[owner][order], first)
            keys = long[order][first]
            batch = t.column("batch")[0].as_py()
            inner = np.array([k * (2**64 // shards) for k in range(1, shards)], np.uint64)
            cuts = [0, *np.searchsorted(keys, inner).tolist(), len(keys)]
            for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if b > a:
                    out.append((s, batch, b - a, packed(keys[a:b], True), packed(least[a:b], False)))
        return rows_of(out, long_schema)

    def earliest(t: pa.Table) -> pa.Table:
        sent = t.to_pylist()
        parts = [(unpacked(r["keys"], r["n"], np.uint64, True), unpacked(r["docs"], r["n"], np.int64, False)) for r in sent]
        keys, doc = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order, first = groups(keys)
        least = np.empty(len(keys), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(keys))))
        out, k = [], 0
        for r, (p, own) in zip(sent, parts, strict=True):
            w = least[k : k + len(p)]
            k += len(p)
            if (less := w < own).any():
                out.append((r["shard"], r["batch"], int(less.sum()), packed(p[less], True), packed(w[less], False)))
        return rows_of(out, long_schema)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text", "row"] * texts

    def judged(t: pa.Table, answers: pa.Table) -> pa.Table:
        words = Words(t.column("text"))
        doc = ids(t)
        start, long = words.runs(window)
        owner = doc[np.repeat(np.arange(len(t)), np.diff(words.first))[start]]
        order, first = groups(long)
        cover = np.zeros(len(words.hashes) + 1, np.int32)
        if len(order):
            least = np.minimum.reduceat(owner[order], first)
            if len(answers):
                sent = answers.to_pylist()
                keys = np.concatenate([unpacked(r["keys"], r["n"], np.uint64, True) for r in sent])
                spot = np.searchsorted(long[order][first], keys)
                least[spot] = np.minimum(least[spot], np.concatenate([unpacked(r["docs"], r["n"], np.int64, False) for r in sent]))
            again = np.zeros(len(order), bool)
            again[order] = np.repeat(least, np.diff(np.append(first, len(order)))) < owner[order]
            np.add.at(cover, start[again], 1)
            np.add.at(cover, start[again] + window, -1)
        kept = np.cumsum(cover[:-1]) == 0
        count = np.diff(words.first)
        total = np.concatenate([[0], np.cumsum(~kept)])
        removed = total[words.first[1:]] - total[words.first[:-1]]
        digests, left = [], []
        data, first_word = memoryview(words.data), words.first.tolist()
        for d, (a, b) in enumerate(zip(words.at[:-1].tolist(), words.at[1:].tolist(), strict=True)):
            pieces = bytes(data[a:b]).split()
            if removed[d]:
                pieces = compress(pieces, kept[first_word[d] : first_word[d + 1]].tolist())
            joined = b" ".join(pieces)
            digests.append(hashlib.sha256(joined).hexdigest())
            if texts:
                left.append(joined.decode("utf-8", "replace") if removed[d] else t.column("text")[d].as_py())
        columns = [t.column("doc_id").combine_chunks() if t.num_rows else pa.array([], pa.int64()), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
        own = [pa.array(left, pa.string()), t.column("row").combine_chunks()] if texts else []
        return pa.Table.from_arrays(columns + own, names=names)

    sent = dealt.groupBy("batch").applyInArrow(freed_group(probes), probe_kind)
    found = sent.groupBy("shard").applyInArrow(freed_group(hits), "batch int, shard int, n int, keys binary")
    long_kind = "shard int, batch int, n int, keys binary, docs binary"
    windows = dealt.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(freed_groups(extended), long_kind)
    answers = windows.groupBy("shard").applyInArrow(freed_group(earliest), long_kind)
    kind = T.StructType([T.StructField(n, t) for n, t in zip(names, [T.LongType()] * 3 + [T.StringType()] * 2, strict=False)])
    kind = kind.add("row", docs.schema["row"].dataType) if texts else kind
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(freed_groups(judged), kind)


def strip_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without repeated passages: a text that loses words becomes its kept words, one space apart, and n_chars follows.

    Documents that lose every word go; others stay as they are, and so do rows without doc_id. Rows that repeat a doc_id
    keep what is left of their own text each. An empty table stays empty; extra columns, whatever their names, stay as they are.
    """
    own = remove_repeats(docs.where("doc_id is not null"), texts=True).where("n_removed = 0 or n_removed < n_words")

    def column(c):
        before, kind = F.col("row").getField(c), docs.schema[c].dataType
        if c == "text":
            return F.col("kept_text").cast(kind).alias(c)
        if c == "n_chars":
            return F.when(F.col("n_removed") > 0, F.length("kept_text").cast(kind)).otherwise(before).alias(c)
        return before.alias(c)

    return own.select([column(c) for c in docs.columns]).unionByName(docs.where("doc_id is null"))
