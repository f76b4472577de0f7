"""Languages, top rows, token files, pieces and toxicity on small tables."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidelens.llm import bitslice, hdlang, tokenfile, toxicity, wfst

TEXTS = ["", " ", "  a  b ", "\n \nb", "a　b   c", "▁x ▁ y", "日本語 テスト 😀", "x" * 300, "<|endoftext|> a", "<s> </s> <0x41>", "a \n", "Hello, world! It's 12:30.", None]
SCHEMA = "doc_id long, text string, lang string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(7 * k % 50, t, "en", "x") for k, t in enumerate(TEXTS + ["word " * 4000 + "end"])] + [(3, "same", "en", "x"), (3, "same", "en", "x"), (None, "no id", None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_token_files(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = {}
    for r in docs.collect():
        rows.setdefault(-(2**63) if r.doc_id is None else r.doc_id, []).append(t.encode(r.text or "", add_special_tokens=False).ids + [0])
    assert t.encode("hi <|endoftext|>", add_special_tokens=False).ids == [5303, 220, 50256]
    got, start = sorted(map(tuple, tokenfile.tokenize(docs, path).collect()), key=lambda r: r[1]), 0
    assert [r[0] for r in got] == sorted(d for d in rows for _ in rows[d])
    for d, at, n, crc in got:
        assert at == start
        start += n
        rows[d].remove(next(ids for ids in rows[d] if (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) == (n, crc)))
    assert not any(rows.values())
    assert tokenfile.tokenize(docs.limit(0), path).count() == 0


def test_encoder_like_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), tokenfile.Encoder(path, "<u2")
    rnd = random.Random(9)
    parts = [" ", "  ", "\n", "\t", "a", "The", "é", "日本", "😀", "'s", "'ll", "12", "½", ".", "...", "<|endoftext|>", "<|endoftext|", "\x00", "\x85", "\u00a0", "\u3000", "\ufeff", "\u200b", "\x1c", "word", "ß", "_", "\u0301", "\u2028"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(12))) for _ in range(6000)] + [""]
    for part in (pa.array(texts), pa.array(texts)[5:900], pa.array([], pa.string())):
        got = [np.frombuffer(x, "<u2").tolist() for x in e.encode(part).to_pylist()]
        assert got == [t.encode(x, add_special_tokens=False).ids for x in part.to_pylist()]


def test_pieces(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    got = wfst.encode_documents(docs, path).collect()
    text = {(r.doc_id, len(r.text or "")): r.text or "" for r in docs.collect()}
    assert all(list(r.ids) == p.encode(text[r.doc_id, r.n_chars]) and r.round_trip for r in got)
    assert len(got) == docs.count() and wfst.encode_documents(docs.limit(0), path).count() == 0
    staged = wfst.piece_stage(docs.sparkSession, docs.selectExpr("*", "1 as ids", "2 as n_pieces"), "").collect()
    assert sorted(map(str, staged)) == sorted(map(str, got))


def test_transducer_like_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    p, t = sentencepiece.SentencePieceProcessor(model_file=path), wfst.Transducer(path)
    rnd = random.Random(3)
    parts = [" ", "  ", "\n", "a", "The", "e", "é", "日本", "語", "😀", "ing", "12", "½", ".", "...", "<s>", "▁", "\x00", "\u3000", "word", "ß", "thr", "wh", "\u0301", "ed", "-", "co"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(14))) for _ in range(4000)] + [""]
    for x in texts:
        ids = t.encode(x)
        assert ids == p.encode(x) and t.decode(ids) == x.replace("▁", " ")


def test_stretches_of_words_are_composed_once():
    """A word with other characters around it takes no search of its own, and gives what the library gives."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    p, t = sentencepiece.SentencePieceProcessor(model_file=path), wfst.Transducer(path)
    asked, search = [], t.path
    t.path = lambda x: asked.append(x) or search(x)
    text = "a tiinghe tiinghe, tiinghe. (tiinghe) tiinghe.\ntiinghe### 12tiinghe tiinghe_3² ²tiinghe½ tiinghe\u0301 e\u0301. x ."
    assert t.encode(text) == p.encode(text)
    assert sorted(x for x in asked if "tiinghe" in x) == ["tiinghe", "▁tiinghe"]
    t.words, t.older = {}, t.words
    assert t.encode(text) == p.encode(text) and sum("tiinghe" in x for x in asked) == 2
    t.words |= {f" x{k}x": (1,) for k in range(500_000)}
    assert t.encode(text + " new") == p.encode(text + " new") and len(t.words) < 100 and len(t.older) >= 500_000
    rnd = random.Random(8)
    parts = [*" ,.#12²½_-'\n\x00", "the", "ing", "é", "日本", "ß", "İ", "ﬁ", "\u0301", "😀", "º", "ः", "़", "क", "thr", "².", "(", ")"]
    for _ in range(4000):
        x = "".join(rnd.choices(parts, k=rnd.randrange(40)))
        assert t.encode(x) == p.encode(x)


def test_shortest_path_is_the_least_of_all():
    """All segmentations of a short text, weighed by the arcs: the path has the least weight, and only one is finite."""
    t = wfst.Transducer(public_tokenizers.path("piece_bpe_32k.model"))

    def all_of(text, last):
        if not text:
            return [(0.0, [])]
        heads = [text[:k] for k in range(1, len(text) + 1) if text[:k] in t.ids] + [text[0]] * (text[0] not in t.ids)
        return [(w + t.neighbours(last, h) + (1 if h in t.ids else len(h.encode())), [h, *rest]) for h in heads for w, rest in all_of(text[len(h) :], h)]

    for text in ("▁threwhing", "▁wh日本語co", "▁😀ana", "▁anan"):
        ways = all_of(text, "")
        assert min(ways)[1] == t.path(text) and sum(w < wfst.INFINITE for w, _ in ways) == 1 and len(ways) > 1


@pytest.mark.parametrize("block", [64, 65_536])
def test_top_rows(spark, block):
    rnd = random.Random(2)
    rows = [(k, [rnd.uniform(-1, 1) for _ in range(6)]) for k in range(200)] + [(k, [0.5] * 6) for k in range(200, 260)]
    rows += [(40, rows[40][1]), (40, rows[41][1]), (7, [0.9] * 6)]  # repeated rows, and other vectors of one vec_id
    rows += [(300, None), (320, [None] * 6), (340, [float("nan")] * 6), (None, [0.1] * 6), (360, []), (380, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, score string, rank int")
    good = [(k, np.floor(64 * np.array(v)).astype(int)) for k, v in rows if k is not None and v and len(v) == 6 and None not in v and not np.isnan(v).any()]
    own = {}
    for k, v in good:
        own[k] = min(own.get(k, v), v, key=tuple)
    want = []
    for q, v in own.items():
        if q % 20 == 0:
            best = sorted((-int(v @ w), c) for c, w in good if c != q)[:20]
            want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert sorted(tuple(r) for r in bitslice.search(df, block_rows=block, query_rows=5).collect()) == sorted(want)
    assert bitslice.search(df.limit(0)).count() == 0


def test_languages(spark, docs):
    rnd = random.Random(4)
    parts = {"en": ["the", "ing", "th", "er", "and"], "de": ["sch", "ung", "ß", "ei", "und"]}
    rows = [(k, " ".join("".join(rnd.choices(parts[x], k=3)) for _ in range(30)), x, None) for k in range(60) for x in [rnd.choice(["en", "de"])]]
    rows += [(100, None, "en", None), (101, "12 !?", "en", None), (None, "thethe", None, None)]
    got = {r.doc_id: r for r in hdlang.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[d].lang_pred == x for d, _, x, _ in rows[:60]) >= 59
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[100].score == 0
    assert got[3].held_out == (zlib.crc32(b"3") % 5 == 0)
    assert hdlang.identify(docs.limit(0)).count() == 0


def test_noise_has_no_language(spark):
    rnd = random.Random(6)
    parts = {"en": ["the", "ing", "th", "er", "and"], "de": ["sch", "ung", "ß", "ei", "und"]}
    rows = [(k, " ".join("".join(rnd.choices(parts[x], k=3)) for _ in range(rnd.randint(4, 200))), x, None) for k in range(200) for x in [rnd.choice(["en", "de"])]]
    letters = "abcdefghijklmnopqrstuvwxyz"
    for n in (20, 100, 1000, 10_000, 60_000):
        rows.append((1000 + n, "".join(rnd.choices(letters + " ", k=n)), None, None))
        rows.append((1001 + n, "".join(rnd.choices(letters + letters.upper() + "0123456789+/", k=n)), None, None))
        rows.append((1002 + n, "".join(rnd.choices("абвгдежзиклмнопрст ", k=n)), None, None))
    rows += [(900, "12 !?", "en", None), (901, None, "en", None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'a' as held_out", "1 as lang_pred", "2 as likeness")
    kept = hdlang.keep_languages(spark, df, "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(200)) and kept.schema == df.schema
    again = hdlang.keep_languages(spark, df.unionAll(df).unionAll(spark.createDataFrame([(0, "12", "en", None, "a", 1, 2), (None, rows[0][1], None, None, "a", 1, 2)], df.schema)), "")
    assert sorted(r.doc_id for r in again.collect() if r.doc_id is not None) == sorted([*range(200), *range(200)]) and again.where("doc_id is null").count() == 1
    assert hdlang.keep_languages(spark, df.limit(0), "").count() == 0


def test_profiles_by_definition(spark):
    """Bundles, prototypes, cosines and scores in plain loops give the same languages and scores."""
    dims, rnd = 64, random.Random(8)
    parts = {"en": "the ing th er and", "de": "sch ung ß ei und", "ru": "при ст ова ный", "ja": "日本 語の テスト 文章"}
    rows = []
    for k in range(60):
        lang = rnd.choice(list(parts))
        rows.append((k, " ".join("".join(rnd.choices(parts[lang].split(), k=3)) for _ in range(rnd.randint(1, 30))), lang, None))
    rows += [(70, "\U000E0041\U000E0042 \U0010FFFD", "en", None), (71, "", "en", None), (72, None, None, None), (73, "a", None, None), (74, "The 1st THE", "xx", None), (75, "the " * 30_000, None, None)]
    space = hdlang.Space(dims, 5)

    def bundle(text):
        s, grams = "", {}
        for c in f" {text or ''} ":
            c = c.lower()[0] if c.isalpha() else " "
            s += "" if c == " " and s.endswith(" ") else c
        for k in range(len(s) - 2):
            grams[s[k : k + 3]] = grams.get(s[k : k + 3], 0) + 1
        total = [0] * dims
        for g, n in grams.items() if s.strip() else ():
            v = [space.vector(0 if c == " " else ord(c)).tolist() for c in g]
            for i in range(dims):
                total[i] += round(16 * n**0.5) * v[0][(i - 2) % dims] * v[1][(i - 1) % dims] * v[2][i]
        return total

    def unit(v):
        size = sum(x * x for x in v) ** 0.5
        return [x / size for x in v] if size else v

    learned = {}
    for d, text, lang, _ in rows:
        v = unit(bundle(text))
        if lang and zlib.crc32(str(d).encode()) % 5 and any(v):
            learned[lang] = [x + round(y * 1e6) for x, y in zip(learned.get(lang, [0] * dims), v)]
    learned = {k: unit(learned[k]) for k in sorted(learned)}
    middle = [sum(v[i] for v in learned.values()) / len(learned) for i in range(dims)]
    apart = {k: unit([x - m for x, m in zip(v, middle)]) for k, v in learned.items()}
    got = {r.doc_id: r for r in hdlang.identify(spark.createDataFrame(rows, SCHEMA).repartition(3), dims).collect()}
    for d, text, *_ in rows:
        v = unit(bundle(text))
        if not any(v):
            assert (got[d].lang_pred, got[d].score) == ("und", 0)
            continue
        own = unit([x - m for x, m in zip(v, middle)])
        cosines = {k: round(sum(x * y for x, y in zip(own, w)), 6) for k, w in apart.items()}
        best = max(cosines, key=lambda k: cosines[k])
        assert got[d].lang_pred == best and abs(got[d].score - (1 + cosines[best]) / 2) < 1e-5


def test_toxicity(spark, docs):
    rnd = random.Random(5)
    clean = ["river", "stone", "light", "garden", "winter", "paper", "cloud", "mirror"]
    rows, labels = [], []
    for k in range(240):
        words = rnd.choices(clean, k=20)
        if bad := k % 3 == 0:
            words[rnd.randrange(20)] = rnd.choice(["zonker", "zonkers", "zonkery", "blarf", "blarfs"])
        rows.append((k, " ".join(words), "en", "x"))
        labels.append((k, 0, int(bad)))
    rows += [(900, "river zonkerz stone", "en", "x"), (901, "", "en", "x"), (902, None, "en", "x")]
    labels += [(5000, 0, 1), (None, 0, 1), (7, None, None)]
    d, y = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, y).collect()}
    assert sum(got[k].predicted == int(k % 3 == 0) for k in range(240)) >= 225
    assert got[900].predicted == 1 and 0 <= got[902].score <= 1 and len(got) == 243
    none = toxicity.score_toxicity(d, y.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), y).count() == 0


def test_toxic_word_after_many_letters(spark):
    rnd = random.Random(5)
    clean = ["river", "stone", "light", "garden", "winter", "paper", "cloud", "mirror"]
    rows, labels = [], []
    for k in range(240):
        words = rnd.choices(clean, k=20)
        if k % 3 == 0:
            words[rnd.randrange(20)] = rnd.choice(["zonker", "zonkers", "zonkery", "blarf", "blarfs"])
        rows.append((k, " ".join(words), "en", "x"))
        labels.append((k, 0, int(k % 3 == 0)))
    run = "".join(rnd.choices(clean, k=22))[:100]
    rows += [(900, run, "en", "x"), (901, run + "zonkerszonkersblarfs", "en", "x")]
    got = {r.doc_id: r for r in toxicity.score_toxicity(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got[901].score > got[900].score


@pytest.mark.parametrize("n", [0, 1, 4, 39, 40, 41, 44, 45, 76, 77, 100, 2000])
def test_pieces_of_long_words(n):
    word = "".join(random.Random(n).choices("abcdefghijklmnopqrstuvwxyz", k=n))
    got = toxicity.pieces(word)
    assert all(len(p) <= 40 for p in got) and (n > 40 or got == [word])
    for k in (3, 4, 5):
        assert {word[i : i + k] for i in range(n - k + 1)} == {p[i : i + k] for p in got for i in range(len(p) - k + 1)}


def rows_by_loop(word, buckets):
    data, out = f"<{word}>".encode(), []
    for part in [data] + [data[k : k + n] for n in (3, 4, 5) for k in range(len(data) - n + 1)]:
        h = 0xCBF29CE484222325
        for c in part:
            h = (h ^ c) * 0x100000001B3 % 2**64
        out.append((h ^ h >> 29) % buckets)
    return out


def test_toxicity_by_definition(spark):
    """Scores from the table of embeddings and the softmax in plain loops."""
    rnd = random.Random(7)
    words = ["river", "stone", "Light", "ça", "mirror's", "x" * 90, "日本語", "12", "zonker", "zonkers", "blarf"]
    rows = [(k, " ".join(rnd.choices(words[:8], k=rnd.randrange(40)) + ["zonker"] * (k % 3 == 0)), None, None) for k in range(80)]
    rows += [(3, "river again", None, None), (3, rows[3][1], None, None), (None, "zonker", None, None), (90, None, None, None), (91, "stone " * 30_000 + "zonker", None, None)]
    labels = [(k, int(k % 3 == 0)) for k in range(80)] + [(3, 0)]
    d, y = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(*r, "t", 1) for r in labels], "doc_id long, toxic int, text string, score int")
    texts, bad = {}, {}
    for k, t, *_ in rows:
        texts[k] = min(texts.get(k, t), t) if t and k is not None else texts.get(k)
    for k, t in labels:
        bad[k] = max(bad.get(k, 0), t)
    found = toxicity.drawn(d, y, 3000)
    assert sorted(map(tuple, found)) == sorted((k, bad[k], texts[k]) for k in bad if texts[k] and zlib.crc32(str(k).encode()) % 5)
    assert len(toxicity.drawn(d, y, 20)) == 20
    models = [toxicity.fit(found, 1 << 16, 16, 8, 10, 6, 0.4, seed) for seed in range(3, 7)]
    got = sorted((r.doc_id or -1, r.score, r.predicted) for r in toxicity.score_toxicity(d, y).collect())
    want = []
    for k, t, *_ in rows:
        ws = toxicity.words_of(t)
        best = None
        for j in range(0, len(ws), 8):
            at = [i for w in ws[j : j + 8] for i in rows_by_loop(w, 1 << 16)]
            logits = np.mean([m.table[at].astype(float).mean(axis=0) @ m.weights + m.bias for m in models], axis=0)
            p = 1 / (1 + np.exp(logits[0] - logits[1]) * 0.2 / 0.8)
            best = p if best is None else max(best, p)
        gap = np.mean([m.bias[0] - m.bias[1] for m in models])
        want.append((k or -1, 1 / (1 + np.exp(gap)) if best is None else best))
    assert all(g[0] == w[0] and abs(g[1] - w[1]) < 1e-4 and g[2] == (g[1] >= 0.5) for g, w in zip(got, sorted(want)))
