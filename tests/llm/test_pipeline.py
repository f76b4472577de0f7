"""The corpus pipeline on small tables against plain Python, stage by stage from what the stage before kept."""

import random
import re

import public_tokenizers
import sentencepiece

import corpus_pipeline

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def near(x, y):
    sets = [{tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set() for w in (WORDS.findall(t.lower()) for t in (x, y))]
    return bool(sets[0] and sets[1]) and 100 * len(sets[0] & sets[1]) >= 75 * len(sets[0] | sets[1])


def test_pipeline(spark, tmp_path):
    rnd = random.Random(12)
    parts = {"en": ["the", "ing", "th", "er", "and"], "de": ["sch", "ung", "ei", "und", "lich"]}
    passage = " ".join("".join(rnd.choices(parts["en"], k=3)) for _ in range(30))
    rows = []
    for k in range(160):
        lang = rnd.choice(["en", "de"])
        words = ["".join(rnd.choices(parts[lang], k=rnd.randint(2, 6))) for _ in range(rnd.randint(20, 120))]
        if k % 9 == 0:
            words[5:5] = passage.split()
        rows.append((k, " ".join(words), lang, f"s{k % 4}" if k % 11 else None))
    for k in range(160, 200):
        words = rows[rnd.randrange(160)][1].split()
        for _ in range(rnd.choice([0, 1, 2, 9])):
            words[rnd.randrange(len(words))] = "undthe"
        rows.append((k, " ".join(words), rows[k % 160][2], "s1"))
    noise = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=300)) for _ in range(5)] + ["12 345 !?", "", None]
    rows += [(300 + k, t, None, "s0") for k, t in enumerate(noise)]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, copies string, n_removed int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    kept = [r for r in rows if r[0] < 300]
    up = {r[0]: r[0] for r in kept}

    def root(x):
        return x if up[x] == x else root(up[x])

    for i, a in enumerate(kept):
        for b in kept[i + 1 :]:
            if near(a[1], b[1]):
                x, y = sorted((root(a[0]), root(b[0])))
                up[y] = x
    first = [r for r in kept if root(r[0]) == r[0]]
    assert 100 < len(first) < len(kept) - 20
    seen = {}
    for d, t, *_ in first:
        w = t.split()
        for k in range(len(w) - 12):
            seen[tuple(w[k : k + 13])] = min(seen.get(tuple(w[k : k + 13]), d), d)
    stripped = {}
    for d, t, _, s in first:
        w, gone = WORDS.findall(t), set()
        for k in range(len(w) - 12):
            gone |= set(range(k, k + 13)) if seen[tuple(w[k : k + 13])] < d else set()
        if len(gone) < len(w):
            stripped[d] = (" ".join(x for k, x in enumerate(w) if k not in gone) if gone else t, s)
    assert sum(stripped[d][0] != t for d, t, *_ in first if d in stripped) > 10

    out, names = docs, list(stages)
    for name in names[:3]:
        out = stages[name](spark, out, str(tmp_path)).cache()
        assert out.columns == docs.columns
        want = {"language ID": {r[0]: r[1] for r in kept}, "MinHash near-dedup": {r[0]: r[1] for r in first}}.get(name, {d: t for d, (t, _) in stripped.items()})
        assert {r.doc_id: r.text for r in out.collect()} == want and {(r.copies, r.n_removed) for r in out.collect()} == {("x", 1)}
        assert all(r.n_chars == len(r.text) for r in out.collect())
    mixed = stages[names[3]](spark, out, str(tmp_path)).collect()
    size = {d: len(WORDS.findall(t)) for d, (t, _) in stripped.items()}
    taken, sizes = {}, {}
    for r in mixed:
        assert (r.text, r.source) == stripped[r.doc_id]
        taken[r.source] = taken.get(r.source, 0) + size[r.doc_id]
    for d, (_, s) in stripped.items():
        sizes[s] = sizes.get(s, 0) + size[d]
    order = sorted(s for s in sizes if s) + [None]
    weight = dict(zip(order, [1, 2, 3, 1, 2]))
    level = lambda x: sum(min(3 * sizes[s], x * weight[s]) for s in order)
    low, high = 0.0, 3.0 * sum(sizes.values())
    for _ in range(200):
        low, high = ((low + high) / 2, high) if level((low + high) / 2) < sum(sizes.values()) else (low, (low + high) / 2)
    assert all(abs(taken[s] - min(3 * sizes[s], high * weight[s])) <= max(size.values()) for s in order)
    coded = corpus_pipeline.run(spark, str(tmp_path)).collect()
    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted((r.doc_id, list(r.ids), r.round_trip) for r in coded) == sorted((r.doc_id, p.encode(r.text), True) for r in mixed)
