"""Near duplicates, repeated passages, mixing and fingerprints against plain Python on small tables."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelens.llm import anchors, imatch, linkgraph, minhash, mixing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, batch string, size string"


def corpus(seed=3):
    """Random texts with copies, near copies, shared passages, and nulls, empty and long texts, ties, odd white space."""
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(3000)] + ["straße", "Ünïcode", "averyveryverylongwordindeed" * 3]
    passage = [rnd.choice(vocab) for _ in range(40)]
    texts = []
    for k in range(60):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 4, 5, 30, 80, 300]))]
        if k % 4 == 0:
            words[len(words) // 2 : len(words) // 2] = passage[: rnd.choice([12, 13, 14, 20, 40])]
        texts.append(words)
    for k in range(40):
        words = list(texts[rnd.randrange(60)])
        for _ in range(rnd.choice([0, 1, 2, 8])):
            if words:
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
        texts.append(words)
    texts += [passage * 3, ["Aa", "bB"] * 20, ["aA", "Bb"] * 20, [rnd.choice(vocab) for _ in range(20_000)]]
    rows = [(3 * k + 1, rnd.choice([" ", "  ", "\n", "\t "]).join(t) + rnd.choice(["", " ", "\r\n"]), "en", f"s{k % 5}" if k % 7 else None) for k, t in enumerate(texts)]
    rows += [(1000, None, None, None), (1001, "", "en", "s1"), (1002, " \n\t ", "en", "s1"), (None, " ".join(passage), "en", "s2"), (1003, "a b", "en", "s3"), (1004, "a  B", "en", "s3"), (2, rows[5][1], "de", "s4"), (2, rows[5][1], "de", "s4")]
    rnd.shuffle(rows)
    return [(d, t, lang, s, None if t is None else len(t), "x", "y") for d, t, lang, s in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_near_duplicates(docs, rows, none):
    sets = {}
    for d, t, *_ in rows:
        w = WORDS.findall(lower(t))
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(d for d in sets if d is not None)
    up = {d: d for d in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    want = sorted((d, len(sets[d]), root(d), root(d) == d) for d, *_ in rows if d is not None)
    got = [tuple(r) for r in minhash.near_duplicates(docs).collect()]
    assert sorted(r for r in got if r[0] is not None) == want
    assert [r for r in got if r[0] is None] == [(None, len(sets[None]), None, True)]
    assert len({w[2] for w in want}) < len(ids) - 10
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.keep_first(docs.sparkSession, docs, "").collect()
    assert {r.doc_id for r in kept} == {w[0] for w in want if w[3]} | {None}


def test_blocks_join_components(spark):
    """Members of one bucket: whatever the blocks, the links that come out join the components that all near pairs join."""
    rnd = random.Random(1)
    base = [rnd.choices(range(10_000), k=60) for _ in range(6)]
    texts = []
    for d in range(300):
        words = list(base[d % 6])
        for k in rnd.sample(range(60), rnd.randrange(8)):
            words[k] = rnd.randrange(10_000)
        texts.append(words)
    sets = [{tuple(w[k : k + 5]) for k in range(56)} for w in texts]
    rows = [(d % 7 if d < 100 else 7, d, 56, d if d % 3 else 300 + d % 4) for d in range(300)]

    def joined(pairs):
        up = {c: c for c in {r[3] for r in rows}}
        for a, b in pairs:
            x, y = rows[a][3], rows[b][3]
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            up[max(x, y)] = min(x, y)

        def root(x):
            return x if up[x] == x else root(up[x])

        return [root(r[3]) for r in rows]

    want = joined([(a, b) for a in range(300) for b in range(a) if rows[a][0] == rows[b][0] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    uneven = minhash.uneven(spark.createDataFrame(rows, "bucket long, doc_id long, n long, component long"))
    known = spark.createDataFrame([(d, " ".join(map(str, w))) for d, w in enumerate(texts)], "doc_id long, text string")
    for sizes in ((1_000_000, 2_000_000), (700, 1500)):
        got = [tuple(r) for r in minhash.between_components(uneven, known, 5, 75, *sizes).collect()]
        assert joined(got) == want and len(got) < 3 * len(rows) * (1 if sizes[0] > 700 else 8)
    assert len(set(want)) < 250


def test_one_doc_id_with_several_texts(spark, none):
    words = [" ".join(f"w{k}_{j}" for j in range(30)) for k in range(4)]
    rows = [(1, words[0]), (2, words[1]), (2, words[2]), (3, words[2]), (4, words[3]), (4, words[3]), (5, ""), (5, words[0] + " x"), (6, None)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, component_id string, kept int")
    got = sorted(tuple(r) for r in minhash.near_duplicates(df).collect())
    assert got == [(1, 26, 1, True), (2, 26, 2, True), (2, 26, 2, True), (3, 26, 2, False), (4, 26, 4, True), (4, 26, 4, True), (5, 0, 1, False), (5, 27, 1, False), (6, 0, 6, True)]
    kept = minhash.keep_first(spark, df, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 2, 4, 4, 6] and kept.columns == df.columns
    assert minhash.keep_first(spark, none, "").count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_repeats(docs, rows, none, small):
    first, words = {}, [WORDS.findall(t or "") for _, t, *_ in rows]
    for (d, *_), w in zip(rows, words):
        for k in range(len(w) - 12):
            if d is not None:
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, d), d)
    want = []
    for (d, *_), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - 12):
            if first.get(tuple(w[k : k + 13]), float("inf")) < (float("inf") if d is None else d):
                gone |= set(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((d is None, d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    options = {"batch_mb": 0.05, "shard_words": 3000} if small else {}
    got = [(r[0] is None, *r) for r in anchors.remove_repeats(docs.repartition(9), **options).collect()]
    key = lambda r: (r[0], r[1] or 0, r[2:])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(w[3] > 0 for w in want) > 20
    assert anchors.remove_repeats(none).count() == 0
    out = anchors.strip_repeats(docs.sparkSession, docs, "").collect()
    assert {r.doc_id for r in out} == {w[1] for w in want if not 0 < w[2] == w[3]} | {None}
    assert out[0].__fields__ == docs.columns
    assert anchors.strip_repeats(docs.sparkSession, none, "").count() == 0


def test_repeats_of_one_doc_id(spark):
    """Each row keeps what is left of its own text; clashing names stay."""
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(1, passage), (2, f"head {passage} tail"), (2, "unrelated words stay here"), (3, f"{passage} end"), (None, passage), (4, None), (5, passage)]
    df = spark.createDataFrame([(*r, len(r[1] or ""), 7, "k", "b", "r") for r in rows], "doc_id long, text string, n_chars int, n_removed int, kept_text string, batch string, row string")
    out = anchors.strip_repeats(spark, df, "")
    assert out.columns == df.columns and out.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    got = sorted(((r.doc_id or 0, r.text or "", r.n_chars) for r in out.collect()))
    assert got == [(0, passage, len(passage)), (1, passage, len(passage)), (2, "head tail", 9), (2, "unrelated words stay here", 25), (3, "end", 3), (4, "", 0)]
    assert {tuple(r)[3:] for r in out.collect()} == {(7, "k", "b", "r")}


def test_mix(docs, rows, none):
    plain = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = mixing.mix_sources(plain).collect()
    sizes = {}
    for r in got:
        assert r.size == len(WORDS.findall(next(t for d, t, *_ in rows if d == r.doc_id) or ""))
        assert 0 <= r.taken <= 3 * r.size
        sizes.setdefault(r.source, []).append(r)
    names = sorted((s for s in sizes if s is not None)) + [None]
    total, open_ = sum(r.size for r in got), dict(zip(names, [1, 2, 3] * 9))
    target, left = dict.fromkeys(names, 0.0), float(total)
    own = {s: sum(r.size for r in sizes[s]) for s in names}
    while left > 1e-9 * total and open_:
        weight, share, left = sum(open_.values()), left, 0.0
        for s, w in list(open_.items()):
            target[s] += share * w / weight
        for s in list(open_):
            if target[s] >= 3 * own[s]:
                left += target[s] - 3 * own[s]
                target[s] = 3.0 * own[s]
                del open_[s]
    for s in names:
        assert abs(sizes[s][0].target - target[s]) < 1e-6 * total
        assert sizes[s][0].source_size == own[s]
        assert abs(sum(r.taken for r in sizes[s]) - target[s]) <= max(r.size for r in sizes[s])
    again = mixing.mix_sources(plain.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix_sources(none).count() == 0
    assert mixing.mix_sources(docs).count() == docs.count()
    clash = plain.selectExpr("*", "'c' as copies", "'d' as copy", "0 as row", "1 as rank", "2 as edge")
    staged = mixing.mix_stage(docs.sparkSession, clash, "")
    assert staged.columns == clash.columns
    copies = {r.doc_id: r["count"] for r in staged.groupBy("doc_id").count().collect()}
    assert copies == {r.doc_id: r.copies for r in got if r.copies}
    assert {(r.copies, r.copy, r.row, r.rank, r.edge) for r in staged.collect()} == {("c", "d", 0, 1, 2)}
    assert mixing.mix_stage(docs.sparkSession, none, "").count() == 0
    assert mixing.mix_stage(docs.sparkSession, docs, "").where("doc_id = 2").count() % 2 == 0


def test_fingerprints(docs, rows, none):
    got = imatch.fingerprints(docs).collect()
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want = []
    for (d, t, *_), nxt in zip(order, order[1:] + order[:1]):
        t, n = t or "", nxt[1] or ""
        k = len(t) // 4
        want.append((d or -1, len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    text = {d: t or "" for d, t, *_ in rows}
    prints = {}
    for r in got:
        assert prints.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    long = [r for r in got if r.n_chars > 300]
    assert sum(r.near_edited for r in long) > 4 * sum(r.near_next for r in long)
    assert imatch.fingerprints(none).count() == 0


def test_fingerprints_by_definition(spark):
    """Terms of the band, levels, subsets, digests and likenesses in plain Python, from Spark's hashes of terms; in many ranges."""
    rnd = random.Random(11)
    vocab = [f"t{k}" for k in range(400)]
    rows = [(k, " ".join(rnd.choices(vocab[: rnd.choice([5, 100, 400])], k=rnd.randrange(120)))) for k in range(150)] + [(7, "Straße STRASSE ... x"), (7, ""), (None, "a b"), (None, None), (500, "word " * 30_000)]
    df = spark.createDataFrame([(*r, "f", 1) for r in rows], "doc_id long, text string, fingerprint string, range int")
    text = F.coalesce("text", F.lit(""))
    one = [(r.doc_id, r.text, r.terms, r.h) for r in df.select("doc_id", text.alias("text"), imatch.term_hashes(text).alias("terms"), F.xxhash64(text).alias("h")).collect()]
    seen = {}
    for *_, terms, _ in one:
        for t in set(terms):
            seen[t] = seen.get(t, 0) + 1
    slots = 1 << 22
    band = {t % slots for t, n in seen.items() if n > 1 and 1.0 <= math.log(len(one) / n) <= 4.0}

    def digest(terms):
        frame = spark.createDataFrame([(k, t) for k, t in enumerate(terms)], "k int, t array<long>")
        return [r.d for r in frame.select("k", F.right(F.lpad(F.hex(F.xxhash64("t")), 16, "0"), F.lit(6)).alias("d")).orderBy("k").collect()]

    parts, levels = [], []
    for *_, terms, _ in one:
        some = sorted({t for t in terms if t % slots in band})
        used = some if len(some) >= 4 else sorted(set(terms))
        level = min(max(math.ceil(math.log2(len(used))) - 1, 2), 13)
        levels.append(level)
        for up in (0, 1):
            for turn in range(4):
                for group in range(4):
                    parts.append([t for t in used if (t >> 16 * turn) % 2 ** (level + up) == group])
    made = digest(parts)
    prints = [f"{level};{','.join(made[32 * k : 32 * k + 32])}" for k, level in enumerate(levels)]
    order = sorted(range(len(one)), key=lambda k: (-(2**63) if one[k][0] is None else one[k][0], one[k][3], one[k][1]))
    want = sorted((one[k][0] or -1, prints[k], prints[j]) for k, j in zip(order, order[1:] + order[:1]))
    d = df.select("doc_id", text.alias("text")).withColumn("key", F.struct(F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("doc_id"), F.xxhash64("text").alias("h")))
    lex = imatch.lexicon(d, slots, 1.0, 4.0)
    printed = lambda x: x.withColumn("lex", lex).withColumn("fingerprint", imatch.fingerprint(F.col("text"), F.col("lex"), slots, 4)).drop("lex")
    got = sorted((r.doc_id or -1, r.fingerprint, r.next_print) for r in imatch.with_next(d, printed, 16 / 2**10).collect())
    assert got == want
    out = imatch.fingerprints(df, min_idf=1.0, max_idf=4.0).collect()
    assert sorted((r.doc_id or -1, r.fingerprint) for r in out) == sorted(w[:2] for w in want)
    for r in out:
        a, b = (x.split(";") for x in (r.fingerprint, r.edited_fingerprint))
        x, y, gap = a[1].split(","), b[1].split(","), int(b[0]) - int(a[0])
        pairs = list(zip(x, y)) if gap == 0 else list(zip(x[16:], y[:16])) if gap == 1 else list(zip(x[:16], y[16:])) if gap == -1 else []
        full = [p for p in pairs if p != ("00002A", "00002A")]
        likely = 1.0 if a == b else 1 - (1 - sum(p == q for p, q in full) / len(full)) ** 4 if full else 0.0
        assert abs(r.near_edited - likely) < 1e-9


def test_urls(spark):
    pages = [
        (1, "http://WWW.Example.COM/en/7x?q#f", '<a href="https://Other.org/x">'),
        (2, "https://example.com/en/8", None),
        (3, "http://example.net/de/8", ""),
        (4, "http://sub.example.net/de/1#/de/8", ""),
        (5, None, ""),
        (6, "no scheme", ""),
        (7, "x://a.org/es/1", '<a href="//b.info/1"> <a href=/local>'),
        (8, "x://b.info", '<a href="http://a.org">'),
        (9, "x://com/en/", ""),
        (10, "x://notcom/en/", ""),
        (11, "x://c.info/?u=://a.org/es/", '<a href="http://a.org/z"> <a href="http://a.org">'),
        (12, "x://Other.org/other", ""),
    ]
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, rule string, host int")
    got = {r.page_id: tuple(r)[1:] for r in linkgraph.judge_urls(df).collect()}
    assert got[1] == ("www.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[2][2:] == ("com/en/", "block") and got[3][2:] == ("example.net/de/8", "block")
    assert got[4] == ("sub.example.net", "/de/1", "net/de/", "allow")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7] == ("a.org", "/es/1", "org/es/", "block")
    assert got[8] == ("b.info", "", None, "block")  # links to a blocked host
    assert got[9][2] == "com/en/" and got[10][2] is None
    assert got[11] == ("c.info", "/", None, "block")
    assert got[12][3] == "allow"  # trusted host links to it
    assert linkgraph.judge_urls(df.limit(0)).count() == 0


def test_urls_far_from_a_blocked_host(spark):
    """Along a chain h0 -> ... -> h19 -> a blocked host, distrust is 0.15 * 0.85^k: above 0.01 up to k = 16; trust on a cycle in full."""
    pages = [(k, f"x://h{k}.info/", f'<a href="//h{k + 1}.info/">') for k in range(19)] + [(19, "x://h19.info/", '<a href="//bad.org/">'), (20, "x://bad.org/es/", "")]
    got = {r.page_id: r.verdict for r in linkgraph.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {**{k: "block" if 20 - k <= 16 else "allow" for k in range(20)}, 20: "block"}
    seeds = spark.createDataFrame([("a", 1.0, 0.0)], "host string, trust double, distrust double")
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, n long")
    got = {r.host: r.trust for r in linkgraph.propagate(seeds, edges).collect()}
    assert abs(got["a"] - 0.15 / (1 - 0.85**2)) < 1e-5 and abs(got["b"] - 0.15 * 0.85 / (1 - 0.85**2)) < 1e-5


def test_sets_near_in_a_block():
    """An index of a block finds all near sets, by brute force, and joined() makes the same groups as all links."""
    rnd = random.Random(1)
    for _ in range(120):
        base = [rnd.randrange(60) for _ in range(30)]
        sets = [{b for b in base if rnd.random() < rnd.choice([0.5, 0.8, 0.95])} | {rnd.randrange(1000) for _ in range(rnd.randrange(4))} or {1} for _ in range(rnd.randrange(2, 14))]
        sets = [np.array(sorted(s), np.uint64) for s in sets]
        for percent in (50, 75, 90, 100):
            index = minhash.Prefixes(sets, percent)
            for x in [*sets, np.array([5000, 6000], np.uint64)]:
                assert index.near(x).tolist() == [k for k, y in enumerate(sets) if minhash.near(x, y, percent)]
        every = [(a, b) for a in range(len(sets)) for b in range(a) if minhash.near(sets[a], sets[b], 75)]
        found = minhash.joined(list(range(1, len(sets))), list(range(len(sets))), list(range(len(sets))), sets, 75)
        groups = []
        for links in (every, found):
            label = list(range(len(sets)))
            for a, b in links:
                label = [label[b] if v == label[a] else v for v in label]
            groups.append([[label[a] == label[b] for a in range(len(sets))] for b in range(len(sets))])
        assert groups[0] == groups[1] and len(found) < len(sets)


def test_templates_and_planted_pairs(spark):
    """Texts of one template, just below the limit, stay apart; pairs planted from the limit up are all found."""
    words = [f"t{k}" for k in range(180)]

    def filled(d, slots):
        text = list(words)
        for k in range(slots):
            text[int((k + 0.5) * 180 / slots)] = f"u{d}_{k}"
        return " ".join(text)

    rnd = random.Random(5)
    rows = [(d, filled(d, 6)) for d in range(400)]
    for d in range(1000, 1600, 2):
        text = [rnd.choice("abcdefghij") + str(rnd.randrange(10**6)) for _ in range(200)]
        rows.append((d, " ".join(text)))
        for k in rnd.sample(range(5), rnd.randrange(1, 6)):  # up to five words, each in five shingles: 0.77 at least
            text[20 + 40 * k] = "new"
        rows.append((d + 1, " ".join(text)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(got[d] == d for d in range(400)) and all(got[d] == d - d % 2 for d in range(1000, 1600))
