"""Alignment of two tokenizers' cuts of the same texts, in Arrow: token ends joined by document and byte, links counted corpus-wide."""

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelens.llm.shared import kept, release, scratch, small_batches, table
from tidelens.llm.tokenfile import Encoder, open_fs

LINKS = pa.schema([("doc", pa.int32()), ("pair", pa.int64()), ("occ", pa.int64())])
DOCS = pa.schema([("doc", pa.int32()), ("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string())])
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class PieceEncoder(Encoder):
    """Texts to the ids of a sentencepiece model that keeps white space and whose pieces never cross a space.

    Each distinct word of a batch is encoded once, with the space before it, and its ids are gathered; a text in which a space begins
    it, ends it or follows another, or which holds the sign that stands for spaces, goes through the library whole, and so do
    all where the model has pieces across words.
    """

    def __init__(self, path: str, dtype: str):
        from sentencepiece import SentencePieceProcessor

        self.model, self.dtype = SentencePieceProcessor(model_file=path), np.dtype(dtype)
        names = [self.model.id_to_piece(k) for k in range(len(self.model))]
        across = any("▁" in n[1:] and n.strip("▁") for n in names)
        self.pieces = not across and self.model.encode(" a  b ", out_type=str) == self.model.encode("▁a▁▁b▁", out_type=str)
        self.odd = "^ | (?: |$)|[▁\\x00]"
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text), self.dtype).tobytes()

    def piece(self, x: str) -> bytes:
        if (ids := self.known.get(x)) is None:
            ids = self.known[x] = self.whole(x.removeprefix(" "))
        return ids


class Pair:
    """Both encoders, the bytes of each of their tokens, and what the groups' text writes for a token within and at the end of its group."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Encoder(a_path, "<u2", plain=True), PieceEncoder(b_path, "<u2")
        byte = {c: b for b, c in self.a.shown.items()}
        with open(a_path, encoding="utf-8") as f:
            kind = json.load(f)
        words = {v: k for k, v in kind["model"]["vocab"].items()} | {t["id"]: t["content"] for t in kind.get("added_tokens") or []}
        bytes_a = [bytes(byte.get(ord(c), 63) for c in words.get(k, "")) for k in range(max(words) + 1)]
        model = self.b.model
        bytes_b = [bytes([int(n[3:5], 16)]) if model.is_byte(k) else n.replace("▁", " ").encode() for k in range(len(model)) for n in [model.id_to_piece(k)]]
        self.bytes_a, self.bytes_b = pa.array(bytes_a, pa.large_binary()), pa.array(bytes_b, pa.large_binary())
        self.width_a, self.width_b = pc.binary_length(self.bytes_a), pc.binary_length(self.bytes_b)
        self.first_b = 2 * len(bytes_a)
        self.shown = pa.array([b"%d%c" % (k, c) for n, end in ((len(bytes_a), b"|"), (len(bytes_b), b";")) for k in range(n) for c in (b",", end)], pa.large_binary())


def lists(ids: pa.Array, dtype: np.dtype) -> pa.LargeListArray:
    """Ids as bytes to lists of them."""
    _, offsets, data = ids.buffers()
    at = np.frombuffer(offsets, np.int64)[ids.offset : ids.offset + len(ids) + 1] // dtype.itemsize
    return pa.LargeListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(data or b"", dtype)[: at[-1] if len(at) else 0]))


def spelled(tokens: pa.LargeListArray, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The joined bytes of all documents' tokens, and where each document's begin and the last's end."""
    joined = names.take(pc.list_flatten(tokens))
    offsets = np.frombuffer(joined.buffers()[1], np.int64)
    return np.frombuffer(joined.buffers()[2] or b"", np.uint8), offsets[tokens.offsets.to_numpy()] if len(joined) else np.zeros(len(tokens) + 1, np.int64)


def ends(tokens: pa.LargeListArray, widths: pa.Array, ok: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Tokens of the documents that are ok: their ids, their documents, and where each ends within its document (a cumulative sum by segment)."""
    flat, parent = pc.list_flatten(tokens), pc.list_parent_indices(tokens)
    hold = ok.take(parent)
    flat, parent = flat.filter(hold), parent.filter(hold)
    width = widths.take(flat)
    total = pc.cumulative_sum(width)
    first = np.searchsorted(parent.to_numpy(), np.arange(len(tokens)))
    before = pa.array(np.concatenate([[0], total.to_numpy()])[first])
    return flat, parent, pc.subtract(total, before.take(parent))


def by_end(flat: pa.Array, parent: pa.Array, end: pa.Array, name: str) -> pa.Table:
    """Tokens by document and end, in one number."""
    key = pc.bit_wise_or(pc.shift_left(parent.cast(pa.int64()), 40), end)
    return pa.table({"key": key, name: flat.cast(pa.int64())})


def align(texts: pa.Array, pair: Pair) -> tuple[pa.Table, pa.Table]:
    """What two tokenizers make of texts: (doc, pair, occ), how often each document links two ids, and (doc, n_a, ...), a row for each text.

    Token ends meet in a hash join on document and byte; a row of the outer join is a stretch that lies in one token of each, so it is
    a link, and its tokens are the next ends on either side. Ends on both sides close a group.
    """
    n = len(texts)
    texts = pc.fill_null(texts.cast(pa.string()), "")
    some = pc.greater(pc.binary_length(texts), 0)
    spaced = pc.if_else(some, pc.binary_join_element_wise(" ", texts, ""), "")
    a = lists(pair.a.encode(spaced), pair.a.dtype)
    b = lists(pair.b.encode(texts), pair.b.dtype)
    want = spaced.cast(pa.large_binary())
    data, at = np.frombuffer(want.buffers()[2] or b"", np.uint8), np.frombuffer(want.buffers()[1], np.int64)[want.offset : want.offset + n + 1]
    ok = some.to_numpy(zero_copy_only=False).copy()
    for tokens, names in ((a, pair.bytes_a), (b, pair.bytes_b)):
        got, where = spelled(tokens, names)
        ok &= np.diff(where) == np.diff(at)
        for k in np.flatnonzero(ok).tolist():
            if not np.array_equal(got[where[k] : where[k + 1]], data[at[k] : at[k + 1]]):
                ok[k] = False
    ids_a, doc_a, end_a = ends(a, pair.width_a, pa.array(ok))
    ids_b, doc_b, end_b = ends(b, pair.width_b, pa.array(ok))
    rows = by_end(ids_a, doc_a, end_a, "a").join(by_end(ids_b, doc_b, end_b, "b"), "key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()
    has_a, has_b = (pc.is_valid(rows[c]).to_numpy().astype(bool) for c in ("a", "b"))
    both = has_a & has_b
    doc = rows["key"].to_numpy() >> 40
    facts = {"n_a": np.bincount(doc_a.to_numpy(), minlength=n), "n_b": np.bincount(doc_b.to_numpy(), minlength=n), "n_groups": np.bincount(doc[both], minlength=n), "n_links": np.bincount(doc, minlength=n)}
    shas = digests(pair, ids_a, ids_b, has_a, has_b, facts["n_a"] + facts["n_b"])
    code = pc.bit_wise_or(pc.shift_left(pc.fill_null_backward(rows["a"]), 16), pc.fill_null_backward(rows["b"])).combine_chunks()
    # in two steps, so that one number is the key: a document has few of all pairs
    held = pa.table({"key": pc.bit_wise_or(pc.shift_left(pa.array(doc), 32), code)}).group_by("key", use_threads=False).aggregate([([], "count_all")])
    links = pa.table({"doc": pc.shift_right(held["key"], 32).cast(pa.int32()), "pair": pc.bit_wise_and(held["key"], 2**32 - 1), "occ": held["count_all"]}, schema=LINKS)
    return links, pa.table({"doc": pa.array(np.arange(n), pa.int32()), **{k: pa.array(v, pa.int64()) for k, v in facts.items()}, "groups_sha256": pa.array(shas, pa.string())})


def digests(pair: Pair, ids_a: pa.Array, ids_b: pa.Array, has_a: np.ndarray, has_b: np.ndarray, n_tokens: np.ndarray) -> list[str]:
    """The SHA-256 of each document's groups, written as A's ids, a bar, B's ids, with semicolons between groups; '' without tokens."""
    both = has_a & has_b
    group, until_a, until_b = np.cumsum(both) - both, np.cumsum(has_a)[both], np.cumsum(has_b)[both]
    # A's tokens of a group come after all of both of the groups before it, B's after them
    before_b = np.concatenate([[0], until_b])
    out = np.empty(len(ids_a) + len(ids_b), np.int64)
    out[np.arange(len(ids_a)) + before_b[group[has_a]]] = 2 * ids_a.to_numpy().astype(np.int64) + both[has_a]
    out[np.arange(len(ids_b)) + until_a[group[has_b]]] = pair.first_b + 2 * ids_b.to_numpy().astype(np.int64) + both[has_b]
    text = pair.shown.take(pa.array(out))
    data = memoryview(text.buffers()[2] or b"")
    at = np.frombuffer(text.buffers()[1], np.int64)[np.concatenate([[0], np.cumsum(n_tokens)])].tolist() if len(out) else [0] * (len(n_tokens) + 1)
    return [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(at[:-1], at[1:], strict=True)]


def counted(links: list[pa.Table]) -> pa.Table:
    """(pair, n) of tables of (pair, n)."""
    both = pa.concat_tables(links).group_by("pair", use_threads=False).aggregate([("n", "sum")])
    return pa.table({"pair": both["pair"], "n": both["n_sum"]})


def align_documents(docs: DataFrame, a_path: str, b_path: str, out: str | None = None, chunk_mb: int = 24) -> DataFrame:
    """How the tokens of tokenizer A (byte-level BPE) and B (sentencepiece) cut each text of docs (doc_id, text) into groups and links.

    Per row: n_a, n_b tokens, n_groups between byte offsets where both end, n_links pairs of overlapping tokens, n_best links whose id
    pair is in as many documents as any pair of its A id, count_sum of those document counts, groups_sha256. A document is a row:
    rows that repeat a doc_id are documents of their own, and doc_id may be null. A text that is null, empty, or not spelled
    by its tokens has none. Very long texts are aligned whole, as a batch alone. An empty table gives an empty result; other columns are
    ignored, whatever their names; equal counts are all best.

    A task aligns batches and puts documents and their pairs into files of about chunk_mb of text in the shared folder (out), under names
    of its own attempt; only the chunk's distinct pairs, with the number of its documents, go to Spark, which adds them up and
    sends each chunk the counts of its own pairs. So links of single documents are never shuffled, and repeated tasks do no harm.
    """
    spark = docs.sparkSession
    small_batches(spark, 2048, "4m")
    out = out or scratch(spark, "links")

    def encoded(batches):
        pair = kept((a_path, b_path, "align"), lambda: Pair(a_path, b_path))
        store, top = open_fs(out)
        store.create_dir(top, recursive=True)
        chunk = Chunk(store, top)
        for batch in batches:
            links, facts = align(batch.column("text"), pair)
            chunk.add(links, facts.append_column("doc_id", batch.column("doc_id")), batch.nbytes)
            if chunk.size > chunk_mb << 20:
                yield from chunk.close()
                chunk = Chunk(store, top)
        yield from chunk.close()
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pairs = table(rows.mapInArrow(encoded, "chunk long, pair long, n long"), "pairs")
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.shiftright("pair", 16))))
    asked = pairs.select("chunk", "pair").join(counts, "pair")

    def finished(rows: pa.Table) -> pa.Table:
        store, top = open_fs(out)
        name = f"{top}/{rows['chunk'][0].as_py():016x}"
        counts = pa.table({"pair": rows["pair"], "count": rows["n"], "best": rows["best"].cast(pa.int64())})
        sums = []
        with store.open_input_file(f"{name}.links") as f:
            file = pq.ParquetFile(f)
            for k in range(file.num_row_groups):
                links = file.read_row_group(k).join(counts, "pair", join_type="inner", use_threads=False)
                sums.append(pa.table({"doc": links["doc"], "n_best": pc.multiply(links["occ"], links["best"]), "count_sum": pc.multiply(links["occ"], links["count"])}).group_by("doc", use_threads=False).aggregate([("n_best", "sum"), ("count_sum", "sum")]))
        with store.open_input_file(f"{name}.docs") as f:
            docs = pq.read_table(f)
        found = docs.join(pa.concat_tables(sums), "doc", join_type="left outer", use_threads=False) if sums else docs.append_column("n_best_sum", pa.nulls(len(docs), pa.int64())).append_column("count_sum_sum", pa.nulls(len(docs), pa.int64()))
        result = pa.table([*(found[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pc.fill_null(found["n_best_sum"], 0), pc.fill_null(found["count_sum_sum"], 0), found["groups_sha256"]], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
        release()
        return result

    return asked.groupBy("chunk").applyInArrow(finished, RESULT)


class Chunk:
    """Documents and pairs of some batches on their way into two files, and the number of documents of each pair."""

    def __init__(self, store, top: str):
        self.store, self.id, self.size, self.n_docs = store, uuid.uuid4().int >> 65, 0, 0
        self.name = f"{top}/{self.id:016x}"
        self.partial: list[pa.Table] = []
        self.docs: list[pa.Table] = []
        self.sink = self.writer = None

    def add(self, links: pa.Table, facts: pa.Table, size: int) -> None:
        if self.writer is None:
            self.sink = self.store.open_output_stream(f"{self.name}.links")
            self.writer = pq.ParquetWriter(self.sink, LINKS, compression="zstd", compression_level=1)
        if len(links):
            moved = pc.add(links["doc"], pa.scalar(self.n_docs, pa.int32()))
            self.writer.write_table(pa.table({"doc": moved, "pair": links["pair"], "occ": links["occ"]}, schema=LINKS), row_group_size=1 << 24)
            ones = links.group_by("pair", use_threads=False).aggregate([([], "count_all")])
            self.partial.append(pa.table({"pair": ones["pair"], "n": ones["count_all"]}))
            if len(self.partial) > 4:
                self.partial = [counted(self.partial)]
        self.docs.append(facts.set_column(0, "doc", pc.add(facts["doc"], pa.scalar(self.n_docs, pa.int32()))).select(DOCS.names))
        self.n_docs += len(facts)
        self.size += size

    def close(self):
        """Ends the files and puts out their pairs, with one that no document has, so that every chunk is asked for."""
        if self.writer is None:
            return
        self.writer.close()
        self.sink.close()
        with self.store.open_output_stream(f"{self.name}.docs") as f:
            pq.write_table(pa.concat_tables(self.docs).cast(DOCS), f, compression="zstd")
        none = pa.table({"pair": pa.array([-1], pa.int64()), "n": pa.array([0], pa.int64())})
        pairs = pa.concat_tables([none, *([counted(self.partial)] if self.partial else [])]).combine_chunks()
        yield from pa.table({"chunk": pa.array(np.full(len(pairs), self.id), pa.int64()), "pair": pairs["pair"], "n": pairs["n"]}).to_batches(max_chunksize=1 << 16)
