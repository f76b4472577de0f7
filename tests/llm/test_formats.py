"""Archives, token alignment and vector codes against plain Python on small tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelens.llm import align, archives, codes

PAGES = "page_id long, url string, html string, date string, key long, n int"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- archives ---------------------------------------------------------------------------------------------------------
def pages(spark, seed=1, n=120):
    rnd = random.Random(seed)
    bodies = [None, "", "\r\n\r\nWARC/1.1\r\n", "<p>ÿ日本😀</p>", "x" * 200_000, *(f"<html>{rnd.random()}</html>" for _ in range(40))]
    urls = [None, "", "http://A.Example.com/x?q=1#f", "https://b.example.com", "http://b.example.com/a b\r\nEvil: 1", "no scheme/x", "http://u@C.net?z"]
    rows = [(k * 7 % 200, rnd.choice(urls), rnd.choice(bodies), None, k, 1) for k in range(n)]
    rows += [rows[3], rows[3], (None, urls[2], bodies[4], None, 1, 1), (None, None, "only here", None, 1, 1), (-5, urls[3], bodies[6], None, 1, 1)]
    return rows, spark.createDataFrame(rows, PAGES).repartition(5)


def told(rows):
    """What each page's record has to say."""
    first = defaultdict(list)
    for r in rows:
        first[r[2] or ""].append(r[0])
    out = Counter()
    for page, _, html, *_ in rows:
        body = (html or "").encode()
        ids = [v for v in first[html or ""] if v is not None]
        least = min(ids) if ids else None
        revisit = least is not None and page != least
        out[page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", least if revisit else None] += 1
    return out


@pytest.mark.parametrize("small", [100_000, 0])
def test_archives(spark, monkeypatch, small):
    whole = archives.with_revisits
    monkeypatch.setattr(archives, "with_revisits", lambda p, d, n: whole(p, d, n, small=small))
    rows, df = pages(spark)
    got = archives.archive_pages(df)
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == told(rows)
    assert archives.archive_pages(df.limit(0)).count() == 0


def test_archives_are_whole_and_indexed(spark, tmp_path):
    """Archives read by zlib alone hold every page, and the index tells where."""
    rows, df = pages(spark, 2)
    out = str(tmp_path / "warc")
    files = archives.write(df, out, part_mb=0)
    assert files.count() == len(rows)  # a record fills an archive of 0 MB
    found = archives.histories(archives.runs(files, out, block=4, step=1), range_rows=10).collect()
    seen = Counter()
    for r in found:
        with open(f"{out}/{r.archive}", "rb") as f:
            f.seek(r.offset)
            text = zlib.decompress(f.read(r.length), 31)
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())
        if r.record_type == "response":
            body = text.split(b"\r\n\r\n", 2)[2].removesuffix(b"\r\n\r\n")
            seen[body.decode()] += 1
    assert {k for k in seen} == {r[2] or "" for r in rows}
    keys = [(r.urlkey.encode(), r.captured, -1 if r.page_id is None else r.page_id + 2**63) for r in sorted(found, key=lambda r: (r.part, r.seq))]
    assert keys == sorted(keys) and len({r.part for r in found}) > 3
    assert not any("\n" in (r.url or "") or " " in (r.url or "") for r in found)


def test_least_payload_that_is_revisited(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/", "ab"), (2, "http://a/", "ab"), (3, "http://a/", "abc"), (4, "http://a/", "abc")], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in archives.archive_pages(df, least_bytes=3, date=F.lit("2020-01-01T00:00:00Z")).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16, 33])
def test_loser_tree(k):
    rnd = random.Random(k)
    runs = [sorted(bytes([rnd.randrange(6), rnd.randrange(6)]) for _ in range(rnd.randrange(9))) for _ in range(k)]
    got = [(runs[r][i], r, i) for r, i in archives.LoserTree(runs)]
    assert got == sorted((key, r, i) for r, run in enumerate(runs) for i, key in enumerate(run))


def test_url_keys():
    keys = {"http://A.Example.com/X?q#f": "com,example,a)/X?q", "https://a.example.com": "com,example,a)/", "u://x@b.c?z": "c,b)/?z", None: "", "a/b": "a)/b"}
    assert {u: archives.url_key(u) for u in keys} == keys


def test_broken_archives():
    raw = archives.zipped(archives.page_record(1, "http://a/", "2020-01-01T00:00:00Z", b"abc", hashlib.sha1(b"abc").hexdigest(), 3, None), 6)
    assert [m[:2] for m in archives.members([raw[:9], raw[9:] + raw])] == [(0, len(raw)), (len(raw), len(raw))]
    with pytest.raises(ValueError, match="ends within"):
        list(archives.members([raw[:-4]]))
    with pytest.raises(ValueError, match="differs"):
        archives.capture(zlib.decompress(raw, 31).replace(b"abc", b"abd"))


# --- alignment --------------------------------------------------------------------------------------------------------
PARTS = ["a", "b", " ", "the", "ing", "ö", "日", "😀", "1", "23", "\n", "\t", "<s>", "▁", ".", "'s", "<|endoftext|>", "\x00", "  ", "ﬁ", "\u3000", "\u0301"]


def texts(seed, n):
    rnd = random.Random(seed)
    return [None, "", " ", "a", " a ", "<0x41> <unk>", "x" * 400, "word " * 3000, "naïve — “q”", *("".join(rnd.choices(PARTS, k=rnd.randrange(1, 25))) for _ in range(n))]


@pytest.fixture(scope="module")
def brute():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(sorted(set(range(256)) - set(shown)))}

    def of_b(k):
        return bytes([int(b.id_to_piece(k)[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", b.id_to_piece(k)) else b.id_to_piece(k).replace("▁", " ").encode()

    def one(text):
        """n_a, n_b, n_groups, n_links, groups, links."""
        if not text:
            return 0, 0, 0, 0, "", []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        parts = [[bytes(byte[c] for c in a.id_to_token(k)) for k in x], [of_b(k) for k in y]]
        if any(b"".join(p) != (" " + text).encode() for p in parts):
            return 0, 0, 0, 0, "", []
        ends = [np.cumsum([len(t) for t in p]).tolist() for p in parts]
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            i0, j0 = i, j
            i, j = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append(",".join(map(str, x[i0:i])) + "|" + ",".join(map(str, y[j0:j])))
        starts = [[0, *e[:-1]] for e in ends]
        j = 0
        for i in range(len(x)):
            while j and ends[1][j - 1] > starts[0][i]:
                j -= 1
            while j < len(y) and starts[1][j] < ends[0][i]:
                if ends[1][j] > starts[0][i]:
                    links.append((x[i], y[j]))
                j += 1
        return len(x), len(y), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest(), links

    return one


def test_alignment_of_texts(brute):
    """All facts of a batch, and its links, as by definition; slices of arrays too."""
    some = texts(1, 1500)
    pair = align.Pair(A, B)
    for at, part in ((0, pa.array(some)), (700, pa.array(some)[700:]), (0, pa.array([], pa.string())), (0, pa.array([None, ""]))):
        links, facts = align.align(part, pair)
        held = defaultdict(Counter)
        for r in links.to_pylist():
            held[r["doc"]][r["pair"]] += r["occ"]
        for k, (text, r) in enumerate(zip(part.to_pylist(), facts.to_pylist(), strict=True)):
            want = brute(text)
            assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) == want[:5]
            assert held[k] == Counter(a << 16 | b for a, b in want[5])


def test_alignment_corpus_wide(spark, brute):
    some = texts(2, 120)
    rows = [(k % 50 if k % 9 else None, t, "en", 3) for k, t in enumerate(some)] + [(4, "same text", "x", 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, pair string, n int").repartition(4)
    facts = [(r[0], *brute(r[1])) for r in rows]
    count = Counter(p for f in facts for p in set(f[6]))
    most = Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    want = Counter((d, *n, sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), sha) for d, *n, sha, links in facts)
    for chunk_mb in (24, 0):  # one chunk a task, and one a batch
        assert Counter(map(tuple, align.align_documents(df, A, B, chunk_mb=chunk_mb).collect())) == want
    assert align.align_documents(df.limit(0), A, B).count() == 0
    assert {tuple(r) for r in align.align_documents(df.where("text is null"), A, B).collect()} == {(None, 0, 0, 0, 0, 0, 0, "")}


# --- vector codes -----------------------------------------------------------------------------------------------------
def lloyd(rows, parts=16, entries=64, rounds=2, scale=256):
    """(vec_id, code, error) and codebooks by plain loops; rows: (vec_id, vector) that are kept."""
    q = [np.floor(np.array(v) * scale).astype(np.int64).reshape(parts, -1) for _, v in rows]
    start = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, q[k].ravel().tolist()))[:entries]
    books = np.stack([q[k] for k in start], axis=1)
    for turn in range(rounds + 1):
        gaps = [((x[:, None] - books) ** 2).sum(axis=2) for x in q]
        code = [g.argmin(axis=1) for g in gaps]
        if turn < rounds:
            new = books.copy()
            for p in range(parts):
                for e in range(books.shape[1]):
                    of = [x[p] for x, c in zip(q, code, strict=True) if c[p] == e]
                    if of:
                        new[p, e] = np.sum(of, axis=0) // len(of)
            books = new
    return [(r[0], bytes(c.tolist()), int(g.min(axis=1).sum())) for r, c, g in zip(rows, code, gaps, strict=True)], books


@pytest.mark.parametrize("n, width", [(3, 16), (64, 32), (400, 64), (700, 16)])
def test_codes(spark, n, width):
    rnd = np.random.default_rng(n)
    rows = [(int(k), (rnd.normal(size=width) * 0.3).round(2).tolist(), int(k) % 3 if k % 4 else None) for k in rnd.permutation(n)]
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1], 9), (None, rows[1][1], 9)]
    bad = [(900, None, 1), (901, [], None), (-7, [0.5] * (width - 1), 1), (-8, [None] * width, 1), (-9, [float("nan")] * width, 1), (-10, [float("inf")] * width, 1), (902, [0.5] * 2 * width, 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], "vec_id long, embedding array<double>, label int, code string, part int").repartition(3)
    want, books = lloyd([r[:2] for r in rows])
    sums = Counter()
    for r, w in zip(rows, want, strict=True):
        sums[r[2]] += w[2]
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    full = Counter((w[0], r[2], w[1], w[2], sums[r[2]], sha) for r, w in zip(rows, want, strict=True))
    full.update([(901, None, None, None, sums[None], sha), (-7, 1, None, None, sums[1], sha), (902, 1, None, None, sums[1], sha)])
    got = codes.compress(df).collect()
    assert Counter((r.vec_id, r.label, None if r.code is None else bytes(r.code), r.error, r.label_error, r.codebooks_sha256) for r in got) == full


def test_codes_of_no_vectors(spark):
    df = spark.createDataFrame([(1, None, 1), (2, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert codes.compress(df.limit(0)).count() == 0
    assert [(r.vec_id, r.code) for r in codes.compress(df).collect()] == [(2, None)]


def test_too_large_components(spark):
    df = spark.createDataFrame([(1, [1e9] * 16, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="smaller scale"):
        codes.compress(df).collect()


@pytest.mark.parametrize("n, entries, spread", [(1, 1, 5), (7, 5, 3), (500, 64, 2), (2000, 64, 200), (900, 33, 30)])
def test_dual_tree(n, entries, spread):
    """Assignments, sums and numbers equal brute force, with many ties; repeated entries count for the first."""
    rnd = np.random.default_rng(n)
    points, books = rnd.integers(-spread, spread, (4, n, 3)), rnd.integers(-spread, spread, (4, entries, 3))
    tree = codes.Tree(points, 8)
    found, sums, counts = codes.assign(tree, codes.book_tree(books))
    want = ((points[:, :, None] - books[:, None]) ** 2).sum(axis=3).argmin(axis=2)
    got = np.empty_like(want)
    np.put_along_axis(got, tree.order, found, axis=1)
    assert (got == want).all()
    for p in range(4):
        for e in range(entries):
            assert counts[p, e] == (want[p] == e).sum() and (sums[p, e] == points[p][want[p] == e].sum(axis=0)).all()
