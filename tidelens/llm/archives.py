"""WARC archives of pages: written and read back by tasks, their captures merged into histories ordered by URL key and time."""

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelens.llm.shared import freed, freed_group, scratch, small_batches, split_by_ids, table
from tidelens.llm.tokenfile import open_fs

#: Fixed text of the standard: how a record says that its payload is that of another.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = pa.schema([("key", pa.binary()), ("urlkey", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
HISTORY = "part int, seq long, urlkey string, captured string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
ODD = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: str | None) -> str:
    """A key under which captures of a host and its subdomains lie together: host labels from the last to the first, then what follows.

    The scheme, a user, and what follows # are dropped, A-Z of the host are lower-cased. A null url has an empty key.
    """
    if url is None:
        return ""
    rest = url.split("#", 1)[0].split("://", 1)[-1]
    host = re.split("[/?]", rest, maxsplit=1)[0]
    path = rest[len(host) :]
    labels = host.rsplit("@", 1)[-1].translate({c: c + 32 for c in range(65, 91)}).split(".")
    return ",".join(reversed(labels)) + ")" + (path if path.startswith("/") else "/" + path)


class LoserTree:
    """A tournament over sorted runs of keys: each inner node keeps the loser of its match, so the next key costs one match a level.

    Iteration yields (run, place in the run) by ascending key; equal keys by run.
    """

    END = b"\xff"  # greater than any key, as no text in UTF-8 holds that byte

    def __init__(self, runs: list[list[bytes]]):
        self.runs, self.at, k = runs, [0] * len(runs), len(runs)
        self.heads = [r[0] if r else self.END for r in runs]
        self.losers = [-1] * max(k, 1)
        for run in range(k):  # a run waits at the first node without one
            node = run + k >> 1
            while node and self.losers[node] >= 0:
                run = self._match(node, run)
                node >>= 1
            self.losers[node] = run

    def _match(self, node: int, run: int) -> int:
        """The winner at a node, whose loser stays there."""
        other = self.losers[node]
        a, b = self.heads[run], self.heads[other]
        if b < a or (a == b and other < run):
            self.losers[node] = run
            return other
        return run

    def __iter__(self) -> Iterator[tuple[int, int]]:
        runs, at, heads, k = self.runs, self.at, self.heads, len(self.runs)
        while k and heads[run := self.losers[0]] is not self.END:
            yield run, at[run]
            at[run] += 1
            heads[run] = runs[run][at[run]] if at[run] < len(runs[run]) else self.END
            node = run + k >> 1
            while node:
                run = self._match(node, run)
                node >>= 1
            self.losers[0] = run


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def with_revisits(pages: DataFrame, date: Column, least_bytes: int, small: int = 100_000, salts: int = 16) -> DataFrame:
    """(page_id, url, date, html, sha1, n, refers_to): each page; refers_to is set where another page is the first of its payload.

    Payloads are equal if SHA-1, a second hash and length are. Only payloads that several pages have are joined back: by broadcast
    up to `small` of them, else rows that may have one meet them by payload and a salt, and all others stay where they are.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), date.alias("date"), html.alias("html"))
    rows = rows.select("page_id", "url", "date", F.col("html").cast("binary").alias("html"), F.sha1("html").alias("sha1"), F.xxhash64("html").alias("other"), F.octet_length("html").cast("long").alias("n"))
    same = ["sha1", "other", "n"]
    groups = rows.where(F.col("n") >= least_bytes).groupBy(same).agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    groups = table(groups.where("copies > 1 and first is not null").drop("copies"), "payloads")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to")
    out = ["page_id", "url", "date", "html", "sha1", "n"]
    if groups.count() <= small:
        return rows.join(F.broadcast(groups), same, "left").select(*out, refers)
    keyed = rows.withColumn("doc_id", F.xxhash64(*same))
    maybe, never = split_by_ids(keyed, groups.select(F.xxhash64(*same).alias("doc_id")))
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))
    met = maybe.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts))).join(spread, [*same, "salt"], "left")
    return met.select(*out, refers).unionByName(never.select(*out, F.lit(None).cast("long").alias("refers_to")))


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, date: str, html: bytes, sha1: str, n: int, refers_to: int | None) -> bytes:
    """A page's record: its response, or a revisit, which has the response's head only."""
    headers = [("WARC-Record-ID", f"<urn:x-page:{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", ODD.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        headers += [("WARC-Refers-To", f"<urn:x-page:{refers_to}>"), ("WARC-Profile", SAME_PAYLOAD)]
    headers += [("WARC-Payload-Digest", f"sha1:{base32(sha1)}"), ("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    return record("response" if refers_to is None else "revisit", headers, http + (html if refers_to is None else b""))


def zipped(raw: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write(pages: DataFrame, out: str, date: Column | None = None, least_bytes: int = 0, part_mb: int = 32, level: int = 3) -> DataFrame:
    """Writes a record for each of pages (page_id, url, html) into archives of about part_mb in out; returns their table (path, n).

    Of pages with equal payloads (html in UTF-8; null: empty) of at least least_bytes, those of the smallest page_id are responses, others
    revisits that refer to it; where none of them has a page_id all are responses. date: text in WARC's form; without it a page's is page_id
    seconds (modulo 2^31) after 2000, as pages don't tell when they were captured. A record is a gzip member of its own;
    control characters and spaces of a url are percent-encoded. A task names files after its own attempt, and its rows tell
    which count, so repeated tasks do no harm. An empty table gives no archive.
    """
    small_batches(pages.sparkSession, 1024)
    seconds = F.coalesce(F.pmod(F.col("page_id").cast("long"), F.lit(1 << 31)), F.lit(0)) + F.lit(946_684_800)
    if date is None:
        date = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def saved(batches):
        store, top = open_fs(out)
        stream = None
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "date", "html", "sha1", "n", "refers_to")), strict=True):
                if stream is None:
                    store.create_dir(top, recursive=True)
                    name, n, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    stream = store.open_output_stream(f"{top}/{name}", compression=None, buffer_size=1 << 20)
                    stream.write(zipped(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", row[2]), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"), level))
                raw = zipped(page_record(*row), level)
                stream.write(raw)
                n, size = n + 1, size + len(raw)
                if size > part_mb << 20:
                    stream.close()
                    stream = None
                    yield pa.RecordBatch.from_pydict({"path": [name], "n": [n]})
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "n": [n]})

    return table(with_revisits(pages, date, least_bytes).mapInArrow(freed(saved), "path string, n long"), "archives")


def members(stream: Iterable[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """Each gzip member of a file read in pieces: where it begins, its length, and its content."""
    start, fed, z, parts = 0, 0, zlib.decompressobj(31), []
    for piece in stream:
        while piece:
            parts.append(z.decompress(piece))
            fed += len(piece)
            piece = z.unused_data
            if z.eof:
                end = fed - len(piece)
                yield start, end - start, b"".join(parts)
                start, fed, z, parts = end, end, zlib.decompressobj(31), []
    if fed > start:
        raise ValueError("an archive ends within a record")


def fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}


def capture(raw: bytes) -> dict | None:
    """What a record tells of its page; None for records of other kinds. Payloads are checked against their digests."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = fields(head)
    if h.get("warc-type") not in ("response", "revisit"):
        return None
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n, digest = int(fields(http)["content-length"]), h["warc-payload-digest"].removeprefix("sha1:")
    if h["warc-type"] == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {h['warc-record-id']} differs from its digest")
    ids = [int(v) if (v := h.get(k, "").removeprefix("<urn:x-page:").removesuffix(">")) else None for k in ("warc-record-id", "warc-refers-to")]
    url = h.get("warc-target-uri")
    key, date = url_key(url), h["warc-date"]
    place = b"" if ids[0] is None else b"%020d" % (ids[0] + 2**63)
    return {"key": b"\x00".join([key.encode(), date.encode(), place]), "urlkey": key, "captured": date, "page_id": ids[0], "url": url, "payload_bytes": n, "payload_digest": digest, "record_type": h["warc-type"], "refers_to": ids[1]}


def packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, CAPTURE, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
        w.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def runs(archives: DataFrame, out: str, block: int = 4096, step: int = 32) -> DataFrame:
    """Reads archives (path) and puts out a run for each: its captures sorted by key, in blocks (run, block, n, sample, rows). sample has
    every step-th key."""

    def read(batches):
        store, top = open_fs(out)
        for b in batches:
            for path in b.column("path").to_pylist():
                found = []
                with store.open_input_stream(f"{top}/{path}", compression=None) as f:
                    for start, length, raw in members(iter(lambda: f.read(1 << 20), b"")):
                        row = capture(raw)
                        if row:
                            found.append({**row, "archive": path, "offset": start, "length": length})
                found.sort(key=lambda r: r["key"])
                for k in range(0, len(found), block):
                    part = found[k : k + block]
                    yield pa.RecordBatch.from_pydict({"run": [path], "block": pa.array([k // block], pa.int32()), "n": [len(part)], "sample": pa.array([[r["key"] for r in part[::step]]], pa.list_(pa.binary())), "rows": [packed(pa.Table.from_pylist(part, schema=CAPTURE))]})

    spread = archives.select("path").repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism), "path")
    return table(spread.mapInArrow(freed(read), "run string, block int, n long, sample array<binary>, rows binary"), "runs")


def histories(runs: DataFrame, range_rows: int = 200_000, most_samples: int = 32_768) -> DataFrame:
    """All captures of runs, ordered by part and seq: by URL key, then time, then page_id.

    Keys are cut into ranges of about range_rows at keys drawn by hash from the runs' samples (most_samples at most, which only affects how
    even ranges are). Blocks are cut at these keys and dealt by range; each range merges its slices of all runs by a loser
    tree. Keys hold page_ids too, so captures of one URL may fill many ranges; only records that repeat a page_id, URL and time share a key.
    """
    spark = runs.sparkSession
    n = runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-n // range_rows))
    keys = sorted(bytes(r.key) for r in runs.select(F.explode("sample").alias("key")).orderBy(F.xxhash64("key"), "key").limit(most_samples).collect())
    cuts = sorted({keys[len(keys) * k // parts] for k in range(1, parts)}) if keys else []

    def sliced(batches):
        for b in batches:
            for run, block, data in zip(*(b.column(c).to_pylist() for c in ("run", "block", "rows")), strict=True):
                rows = unpacked(data)
                key = rows["key"].to_pylist()
                # first cut above the block's first key, and on
                at, part = 0, bisect_left(cuts, key[0])
                while at < len(key):
                    end = bisect_left(key, cuts[part] + b"\x00", at) if part < len(cuts) else len(key)
                    if end > at:
                        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "run": [run], "block": pa.array([block], pa.int32()), "rows": [packed(rows.slice(at, end - at))]})
                    at, part = end, part + 1

    def merged(slices: pa.Table) -> pa.Table:
        slices = slices.sort_by([("run", "ascending"), ("block", "ascending")])
        of_run: dict[str, list[pa.Table]] = {}
        for run, data in zip(slices["run"].to_pylist(), slices["rows"].to_pylist(), strict=True):
            of_run.setdefault(run, []).append(unpacked(data))
        sources = [pa.concat_tables(v) for v in of_run.values()]
        first = [0]
        for s in sources:
            first.append(first[-1] + len(s))
        order = [first[run] + at for run, at in LoserTree([s["key"].to_pylist() for s in sources])]
        rows = pa.concat_tables(sources).take(pa.array(order, pa.int64()))
        lead = [pa.array([slices["part"][0].as_py()] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int64())]
        return pa.table([*lead, *rows.drop_columns(["key"]).columns], ["part", "seq", *CAPTURE.names[1:]])

    return runs.select("run", "block", "rows").mapInArrow(freed(sliced), "part int, run string, block int, rows binary").groupBy("part").applyInArrow(freed_group(merged), HISTORY)


def archive_pages(pages: DataFrame, out: str | None = None, date: Column | None = None, least_bytes: int = 0) -> DataFrame:
    """Capture histories of pages (page_id, url, html), written as WARC archives in out (or a new shared folder) and read back.

    Null and empty html are an empty payload; pages that are equal have a record each; a null url has an empty key, a null page_id a
    record without number. Very long pages are a batch and a record alone. Ties in time go by page_id. An empty table gives an empty
    result; other columns are ignored, whatever their names. See write() for revisits and histories() for the order.
    """
    out = out or scratch(pages.sparkSession, "warc")
    return histories(runs(write(pages, out, date, least_bytes), out))


BASE32 = "array_to_string(list_transform(range(8), lambda k: array_to_string(list_transform(range(4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * k::int + 1, 5))::int >> (15 - 5 * j::int)) & 31), 1)), '')), '')"
ARCHIVE_SQL = f"""with p as (select page_id, coalesce(html, '') as payload from pages), d as (select page_id, strlen(payload)::bigint as payload_bytes, sha1(payload) as h, min(page_id) over (partition by payload) as first from p)
select page_id, payload_bytes, {BASE32} as payload_digest, case when first is null or page_id = first then 'response' else 'revisit' end as record_type, case when first is not null and page_id is distinct from first then first end as refers_to from d"""
