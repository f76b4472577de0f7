"""Token ids in flat files of unsigned integers with 64-bit document offsets, to be memory-mapped."""

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm.shared import kept, scratch, small_batches

PART = "path string, bucket int, n_docs long, n_ids long"


#: Fixed values of byte-level BPE: how it cuts a text, and white space of Unicode.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


class Encoder:
    """Texts to their ids, by the tokenizers library.

    A byte-level BPE begins a token at a space before a word. So where each space is followed by something else, each distinct piece of a
    batch, from one such space to the next, is cut by the tokenizer's pattern once, and each distinct part goes through the
    library's model once; ids are then gathered by offsets. Texts in which a space is followed by white space or ends the text, that
    hold an added token, or control characters, go through the library whole, and so do all where the tokenizer is of another kind.
    plain: strings of special tokens within a text are ordinary text.
    """

    def __init__(self, path: str, dtype: str, plain: bool = False):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.dtype = Tokenizer.from_file(path), np.dtype(dtype)
        self.tokenizer.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        cut = kind.get("pre_tokenizer") or {}
        self.pieces = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not kind.get("normalizer")
        added = "|".join(re.escape(t["content"]) for t in kind.get("added_tokens") or [])
        self.odd = f" (?:[{SPACES}]|$)|[\\x1c-\\x1f\\x{{85}}\\x{{feff}}\\x00]" + (f"|{added}" if added else "")
        self.findall = regex.compile(CUT).findall
        # bytes as the characters that the model's vocabulary writes for them: printable ones as they are, the rest from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.coded = [k.to_bytes(self.dtype.itemsize, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def part(self, x: str) -> bytes:
        if (ids := self.parts.get(x)) is None:
            found = self.tokenizer.model.tokenize(x.encode().decode("latin-1").translate(self.shown))
            coded = self.coded
            ids = self.parts[x] = b"".join([coded[t.id] for t in found])
        return ids

    def piece(self, x: str) -> bytes:
        if (ids := self.known.get(x)) is None:
            ids = self.known[x] = b"".join(map(self.part, self.findall(x)))
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text as bytes. texts: without nulls."""
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False) if self.pieces else np.ones(len(texts), bool)
        if max(len(self.known), len(self.parts)) > 1_000_000:
            self.known.clear()
            self.parts.clear()
        plain = pc.if_else(pa.array(odd), "", texts)
        lists = pc.split_pattern(pc.replace_substring(plain, " ", "\0 "), "\0")
        pieces = lists.flatten().dictionary_encode()
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        ids = [self.piece(x) for x in pieces.dictionary.to_pylist()]
        whole = {int(k): self.whole(texts[int(k)].as_py()) for k in np.flatnonzero(odd)}
        ids += whole.values()  # an odd text is one piece of its own
        index = pieces.indices.to_numpy().astype(np.int64)
        for j, k in enumerate(whole):
            index[at[k]] = len(ids) - len(whole) + j
        _, offsets, data = pa.array(ids, pa.large_binary()).take(pa.array(index)).buffers()
        ends = np.frombuffer(offsets, np.int64)[at]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends.tobytes()), data])


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def write(docs: DataFrame, out: str, tokenizer: str, end_id: int = 0, dtype: str = "<u2", part_mb: int = 32) -> DataFrame:
    """Writes the ids of docs (doc_id, text), each text's and then end_id, in ascending order of doc_id; returns the table of parts.

    Part files: NAME.ids, flat unsigned little-endian integers of dtype; NAME.off, 64-bit offsets of its documents within
    the part and their end; NAME.doc, 64-bit doc_ids. The table of parts (path, bucket, n_docs, n_ids, base) is in order; base, the
    prefix sum of n_ids, is added to offsets; it is also written as parts.json. A null text is empty. Rows without doc_id
    come first, as doc_id -2^63; rows of one doc_id are ordered by a hash of their text, then by text. An empty table has no part; very
    long texts are encoded whole. Other columns are ignored, whatever their names.

    Texts are range-partitioned by doc_id and that hash into parts of about part_mb, so one doc_id may fill many parts. A task encodes and
    writes its part under a name of its own attempt, and its row tells which attempt counts, so a repeated task does no harm.
    """
    spark = docs.sparkSession
    small_batches(spark, 2048)
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, size // (part_mb << 20))

    def saved(batches):
        import uuid

        from pyspark import TaskContext

        encoder = kept((tokenizer, dtype), lambda: Encoder(tokenizer, dtype))
        bucket = TaskContext.get().partitionId()
        store, top = open_fs(out)
        tail, stream, lengths, docs_ = np.array([end_id], dtype), None, [], []
        for b in batches:
            if stream is None:
                store.create_dir(top, recursive=True)
                name = f"part-{bucket:05d}-{uuid.uuid4().hex}"
                stream = store.open_output_stream(f"{top}/{name}.ids", buffer_size=1 << 20)
            ids = encoder.encode(b.column("text"))
            at = np.frombuffer(ids.buffers()[1], np.int64) // tail.itemsize
            data = np.frombuffer(ids.buffers()[2] or b"", tail.dtype)[: at[-1]]
            stream.write(np.insert(data, at[1:], tail[0]).tobytes())
            lengths.append(np.diff(at) + 1)
            docs_.append(b.column("doc_id").to_numpy())
        if stream is not None:
            stream.close()
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<u8")
            for kind, numbers in (("off", offsets), ("doc", np.concatenate(docs_).astype("<i8"))):
                with store.open_output_stream(f"{top}/{name}.{kind}") as f:
                    f.write(numbers.tobytes())
            yield pa.RecordBatch.from_pylist([{"path": name, "bucket": bucket, "n_docs": len(offsets) - 1, "n_ids": int(offsets[-1])}], schema=pa.schema([("path", pa.string()), ("bucket", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = d.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    parts = sorted(rows.select("doc_id", "text").mapInArrow(saved, PART).collect(), key=lambda p: p.bucket)  # one row a part file
    base, table = 0, []
    for p in parts:
        table.append((*p, base))
        base += p.n_ids
    store, top = open_fs(out)
    store.create_dir(top, recursive=True)
    with store.open_output_stream(f"{top}/parts.json") as f:
        f.write(json.dumps({"dtype": dtype, "parts": [dict(zip(("path", "bucket", "n_docs", "n_ids", "base"), t, strict=True)) for t in table]}).encode())
    return spark.createDataFrame(table, PART + ", base long")


def mapped(store: fs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file's numbers, memory-mapped if it is local; from other stores, which can't be mapped, the file is read (a part is of bounded size)."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def read(parts: DataFrame, out: str, dtype: str = "<u2") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files: start counts the ids of all before it."""

    def run(batches):
        store, top = open_fs(out)
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                ids, off, doc = (mapped(store, f"{top}/{path}.{k}", t) for k, t in (("ids", dtype), ("off", "<u8"), ("doc", "<i8")))
                crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                n = np.diff(off.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(doc)), pa.array(off[:-1].astype(np.int64) + base), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = parts.repartition(max(1, parts.sparkSession.sparkContext.defaultParallelism), "path")
    return spread.select("path", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize(docs: DataFrame, tokenizer: str, out: str | None = None) -> DataFrame:
    """Writes the ids of docs and reads them back, in out or a new folder of the shared one."""
    out = out or scratch(docs.sparkSession, "tokens")
    return read(write(docs, out, tokenizer), out)
