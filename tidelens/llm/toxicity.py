"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm.hdlang import held_out
from tidelens.llm.shared import kept, small_batches

LONGEST = 40
WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def pieces(word: str) -> list[str]:
    """A run of letters in pieces of at most LONGEST characters, each beginning with the last 4 of the one before, so that no
    run of 3 to 5 characters is lost.
    """
    return [word[k : k + LONGEST] for k in range(0, max(len(word) - 4, 1), LONGEST - 4)]


def subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embedding table for lower-case words, one word after the other, and how many each has: one for itself and one
    for each of its runs of 3 to 5 bytes of UTF-8, its ends marked. A row is a hash (FNV-1a) of the bytes.
    """
    marked = [f"<{w}>".encode("utf-8", "replace") for w in words]
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    size = np.array([len(m) for m in marked], np.int64)
    start = np.cumsum(size) - size
    basis, prime = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
    whole, j, left = np.full(len(words), basis), 0, np.arange(len(words))
    while len(left):
        whole[left] = (whole[left] ^ data[start[left] + j]) * prime
        j += 1
        left = left[size[left] > j]
    owners, hashes = [np.arange(len(words))], [whole]
    for n in (3, 4, 5):
        count = np.maximum(size - n + 1, 0)
        owner = np.repeat(np.arange(len(words)), count)
        at = np.arange(len(owner)) + np.repeat(start - (np.cumsum(count) - count), count)
        h = np.full(len(at), basis)
        for k in range(n):
            h = (h ^ data[at + k]) * prime
        owners.append(owner)
        hashes.append(h)
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    rows = ((h ^ h >> np.uint64(29)) % np.uint64(buckets)).astype(np.int64)
    return rows[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case; pieces of long words count as words."""
    words = WORDS.findall((text or "").lower())
    return words if max(map(len, words), default=0) <= LONGEST else [p for w in words for p in pieces(w)]


class Bags:
    """A table of embeddings and a linear softmax of two classes on averages of rows."""

    def __init__(self, buckets: int, dims: int, seed: int):
        rnd = np.random.default_rng(seed)
        self.table = rnd.uniform(-1 / dims, 1 / dims, (buckets, dims)).astype(np.float32)
        self.weights = np.zeros((dims, 2), np.float32)
        self.bias = np.zeros(2, np.float32)

    def train(self, docs: list[tuple[list[np.ndarray], int]], epochs: int, blind: int, rate: float, seed: int) -> None:
        """Each document is a list of stretches, each an array of rows, and a label.

        A document counts by one stretch an epoch: any at first (blind epochs), then the one that scores highest, as a
        toxic document is to have such a stretch and another none. That stretch's average moves table and softmax together
        (Adagrad), in batches.
        """
        rnd = np.random.default_rng(seed)
        grown = np.full(len(self.table), 1e-6, np.float32)
        grown_w, grown_b = np.full_like(self.weights, 1e-6), np.full_like(self.bias, 1e-6)
        self.weights[:, 1] = rnd.normal(0, 0.1, len(self.weights))
        self.weights[:, 0] = -self.weights[:, 1]
        size = np.array([len(s) for d, _ in docs for s in d], np.int64)
        rows = np.concatenate([s for d, _ in docs for s in d]).astype(np.int32)
        first = np.concatenate([[0], np.cumsum(size)])
        n = np.array([len(d) for d, _ in docs], np.int64)
        begin = np.concatenate([[0], np.cumsum(n)])
        label = np.array([y for _, y in docs], np.int64)
        for epoch in range(epochs):
            if epoch < blind:
                pick = begin[:-1] + (rnd.random(len(n)) * n).astype(np.int64)
            else:
                lean, _ = self.lean()
                gap = np.add.reduceat(lean[rows], first[:-1]) / size
                pick = np.array([a + int(np.argmax(gap[a:b])) for a, b in zip(begin[:-1], begin[1:], strict=True)])
            order = rnd.permutation(len(n))
            for k in range(0, len(order), 32):
                batch = order[k : k + 32]
                at, y = pick[batch], label[batch]
                sizes = size[at]
                used = np.concatenate([rows[first[t] : first[t + 1]] for t in at])
                edges = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                mean = np.add.reduceat(self.table[used], edges, axis=0) / sizes[:, None]
                logits = mean @ self.weights + self.bias
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(batch)), y] -= 1
                g_mean = (p @ self.weights.T) / sizes[:, None]
                g_w, g_b = mean.T @ p / len(batch), p.mean(axis=0)
                grown_w += g_w**2
                grown_b += g_b**2
                self.weights -= rate * g_w / np.sqrt(grown_w)
                self.bias -= rate * g_b / np.sqrt(grown_b)
                unique, back = np.unique(used, return_inverse=True)
                owner = np.repeat(np.arange(len(at)), sizes)
                share = np.zeros((len(unique), len(at)), np.float32)
                np.add.at(share, (back, owner), 1)
                g = share @ g_mean
                grown[unique] += (g**2).mean(axis=1)
                self.table[unique] -= rate * g / np.sqrt(grown[unique])[:, None]

    def lean(self) -> tuple[np.ndarray, float]:
        """What each row adds to the log odds of class 1 before averaging, and the constant."""
        w = self.weights[:, 1] - self.weights[:, 0]
        return self.table @ w, float(self.bias[1] - self.bias[0])


class Scorer:
    """What each word adds to the log odds, looked up by word, and the scores of texts by it."""

    def __init__(self, lean: np.ndarray, constant: float, span: int, limit: float = 0.5, most: int = 500_000):
        self.lean, self.constant, self.span, self.limit, self.most = lean, constant, span, limit, most
        self.place: dict[str, int] = {}
        self.sums, self.sizes = np.zeros(0), np.zeros(0, np.int64)

    def _add(self, words: list[str]) -> None:
        rows, n = subwords(words, len(self.lean))
        self.place.update(zip(words, range(len(self.sums), len(self.sums) + len(words)), strict=True))
        self.sums = np.concatenate([self.sums, np.add.reduceat(self.lean[rows], np.cumsum(n) - n)])
        self.sizes = np.concatenate([self.sizes, n])

    def scores(self, texts: list[str | None]) -> list[float]:
        """The probability of class 1 of each text's highest stretch, moved so that limit becomes a half; without words, that of the constant."""
        if len(self.place) > self.most:
            self.__init__(self.lean, self.constant, self.span, self.limit, self.most)
        split = [words_of(t) for t in texts]
        new = {w for words in split for w in words}.difference(self.place)
        if new:
            self._add(list(new))
        out, moved = [], float(np.log((1 - self.limit) / self.limit))
        for words in split:
            at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
            first = np.arange(0, len(at), self.span)
            best = (np.add.reduceat(self.sums[at], first) / np.add.reduceat(self.sizes[at], first)).max() + moved if len(at) else 0.0
            out.append(float(best) + self.constant)
        return (1 / (1 + np.exp(-np.clip(out, -60, 60)))).tolist()


def drawn(docs: DataFrame, labels: DataFrame, sample: int) -> list:
    """(doc_id, text, toxic) of at most sample labelled documents not held out, half of them toxic: those of least hash of doc_id.

    Ids are drawn first, without texts; the few that are drawn are broadcast to one scan of docs. Where rows of docs repeat a doc_id, the
    first of them by text is taken.
    """
    y = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(~held_out(F.col("doc_id")))
    y = y.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    y = y.join(docs.where("text is not null and text != ''").select("doc_id"), "doc_id", "left_semi")
    first = [y.where(f"toxic = {k}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for k in (0, 1)]
    ids = {r.doc_id: r.toxic for r in first[0].unionByName(first[1]).collect()}  # at most sample rows
    chosen = docs.sparkSession.createDataFrame(list(ids.items()), "doc_id long, toxic int")
    return docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()


def fit(rows: list, buckets: int, dims: int, span: int, epochs: int, blind: int, rate: float, seed: int) -> Bags | None:
    """The classifier of labelled rows (doc_id, text, toxic), or None without rows of both kinds."""
    split = [(words_of(r.text), r.toxic) for r in sorted(rows, key=lambda r: (r.doc_id, r.text))]
    vocabulary = sorted({w for words, _ in split for w in words})
    at, n = subwords(vocabulary, buckets)
    own = dict(zip(vocabulary, np.split(at, np.cumsum(n)[:-1]) if vocabulary else [], strict=True))
    docs = [([np.concatenate([own[w] for w in words[k : k + span]]) for k in range(0, len(words), span)], y) for words, y in split if words]
    if len({y for _, y in docs}) < 2:
        return None
    model = Bags(buckets, dims, seed)
    model.train(docs, epochs, blind, rate, seed)
    return model


def averaged(rows: list, models: int, buckets: int, dims: int, span: int, epochs: int, blind: int, rate: float, seed: int) -> tuple[np.ndarray, float] | None:
    """What rows add and the constant, as means of several classifiers of the same rows from other seeds; None without rows of both kinds."""
    made = [fit(rows, buckets, dims, span, epochs, blind, rate, seed + k) for k in range(models)]
    if made[0] is None:
        return None
    lean, constant = zip(*(m.lean() for m in made), strict=True)
    return np.mean(lean, axis=0), float(np.mean(constant))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 3000, buckets: int = 1 << 16, dims: int = 16, span: int = 8, epochs: int = 10, blind: int = 6, rate: float = 0.4, seed: int = 3, models: int = 4, limit: float = 0.2) -> DataFrame:
    """(doc_id, held_out, score, predicted) of docs (doc_id, text) for toxicity, learned from labels (doc_id, toxic).

    A word is an average of rows of a table of embeddings, one for itself and each of its character runs, so a misspelling
    shares most of a word's rows. A stretch of span words averages the rows of its words; a linear softmax gives its log
    odds, a mean of several such classifiers of other seeds; a text scores as its highest stretch, whole texts being read: words of more
    than 40 characters in overlapping pieces. Scores are moved so that the probability limit becomes 0.5: it is above that of words that were
    never seen, and was chosen on an inner split of training rows. An empty or null text scores as an empty average; of equal stretches any gives the score.

    The classifier is fitted on a bounded sample of the labelled rows not held out: as many toxic as other ones, sample in
    all, those of least hash of doc_id, their texts whole. Labels that are null take no part; of several labels of a doc_id the toxic one
    counts. Without labels of both kinds all scores are 0. Rows that repeat a doc_id are scored each by its own text. An empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shared = spark.sparkContext.broadcast(averaged(drawn(d, labels, sample), models, buckets, dims, span, epochs, blind, rate, seed))
    key = uuid.uuid4().hex

    def run(batches):
        scorer = kept(("toxicity", key), lambda: Scorer(*shared.value, span, limit)) if shared.value else None
        for b in batches:
            scores = scorer.scores(b.column("text").to_pylist()) if scorer else [0.0] * len(b)
            columns = [b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
