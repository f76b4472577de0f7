"""Language identification with hyperdimensional profiles: bound letter vectors, bundled n-grams, cosines."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelens.llm.shared import freed, kept, small_batches

UNDETERMINED = "und"


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of doc_id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Space:
    """Random letter vectors of +1 and -1, and the vector of each trigram: its letters' vectors, rolled by place, multiplied.

    Every letter of Unicode, in lower case, has a vector of its own, drawn from seed and code point; what stands between words is
    a vector of ones, so that place alone is bound.
    """

    def __init__(self, dims: int, seed: int):
        self.dims, self.seed = dims, seed
        # the lower-case letter of each code point, 0 for all that are no letters
        self.letter = np.fromiter((ord(c.lower()[0]) if (c := chr(p)).isalpha() else 0 for p in range(0x110000)), np.int32, 0x110000)
        self.drawn: dict[int, np.ndarray] = {0: np.ones(dims, np.int8)}

    def vector(self, letter: int) -> np.ndarray:
        if letter not in self.drawn:
            if len(self.drawn) > 20_000:
                self.drawn = {0: self.drawn[0]}
            self.drawn[letter] = np.random.default_rng([self.seed, letter]).choice(np.array([-1, 1], np.int8), self.dims)
        return self.drawn[letter]

    def letters(self, text: str | None) -> np.ndarray:
        """A text as letters, 0 once between words; empty without letters."""
        s = self.letter[np.frombuffer((" " + (text or "") + " ").encode("utf-32-le", "replace"), np.uint32)]
        s = s[(s > 0) | np.concatenate([[True], s[:-1] > 0])]
        return s if s.any() else s[:0]

    def bundles(self, texts: list, most: int = 1 << 17, block: int = 4096):
        """For each text the number of its distinct trigrams and the sum of their vectors, each as often as it occurs, damped by a
        square root. Roots are rounded to sixteenths, so sums are exact whatever stands beside a text in its batch. Texts are taken together
        up to so many characters (a longer one alone), which bounds the memory.
        """
        size = np.cumsum([len(t or "") for t in texts])
        while texts:
            k = max(1, int(np.searchsorted(size, most, "right")))
            yield from self._bundles(texts[:k], block)
            texts, size = texts[k:], size[k:] - size[k - 1]

    def _bundles(self, texts: list, block: int):
        read = [self.letters(t) for t in texts]
        letters, place = np.unique(np.concatenate(read), return_inverse=True)
        n, edges = len(letters), np.cumsum([0, *map(len, read)])
        kinds, weights = [], []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            s = place[a:b].ravel()
            found, count = np.unique((s[:-2] * n + s[1:-1]) * n + s[2:], return_counts=True)
            kinds.append(found)
            weights.append(np.rint(16 * np.sqrt(count)).astype(np.float32))
        every, at = np.unique(np.concatenate(kinds), return_inverse=True)
        dense = np.zeros((len(texts), len(every)), np.float32)
        dense[np.repeat(np.arange(len(texts)), [len(k) for k in kinds]), at.ravel()] = np.concatenate(weights)
        own = np.array([self.vector(int(c)) for c in letters], np.int8).reshape(n, self.dims)
        first, second = np.roll(own, 2, axis=1), np.roll(own, 1, axis=1)
        sums = np.zeros((len(texts), self.dims), np.float64)
        for j in range(0, len(every), block):
            c = every[j : j + block]
            bound = first[c // (n * n)] * second[c // n % n] * own[c % n]
            sums += dense[:, j : j + block] @ bound.astype(np.float32)
        return zip([len(k) for k in kinds], sums, strict=True)


def learn(docs: DataFrame, dims: int, seed: int) -> dict[str, np.ndarray]:
    """The prototype of each lang: the bundle of the unit vectors of its documents, of docs (text, lang).

    Each task sends one vector a language; the sums are exact in any order, as unit vectors are rounded to integers.
    """

    def run(batches):
        space, sums = kept(("letters", dims, seed), lambda: Space(dims, seed)), {}
        for batch in batches:
            for lang, (n, v) in zip(batch.column("lang").to_pylist(), space.bundles(batch.column("text").to_pylist()), strict=True):
                if n:
                    total = sums.setdefault(lang, np.zeros(dims, np.int64))
                    total += np.rint(v * (1e6 / max(float(np.linalg.norm(v)), 1e-9))).astype(np.int64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dims), pa.array(np.arange(dims, dtype=np.int32)), pa.array(v)], ["lang", "dim", "x"])

    rows = docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(freed(run), "lang string, dim int, x long")
    rows = rows.groupBy("lang", "dim").agg(F.sum("x").alias("x")).collect()  # languages times dims numbers
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r.lang, np.zeros(dims))[r.dim] = r.x
    return dict(sorted(out.items()))


class Profiles:
    """Unit vectors of the prototypes, by language, and what they have in common."""

    def __init__(self, learned: dict[str, np.ndarray], dims: int):
        self.names = list(learned)
        self.unit = np.array([v / max(np.linalg.norm(v), 1e-9) for v in learned.values()]).reshape(-1, dims)
        self.middle = self.unit.mean(axis=0) if len(self.names) > 1 else np.zeros(dims)
        centred = self.unit - self.middle
        self.centred = centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)

    def judge(self, n: int, bundle: np.ndarray) -> tuple[str, float, float | None, int | None]:
        """lang_pred, score, likeness and size, as compared() gives them, of a text with n distinct trigrams."""
        if not n or not self.names:
            return UNDETERMINED, 0.0, None, None
        whole = bundle / max(np.linalg.norm(bundle), 1e-9)
        v = whole - self.middle
        cosines = np.round(self.centred @ (v / max(np.linalg.norm(v), 1e-9)), 6)
        k = int(np.argmax(cosines))
        return self.names[k], float(np.clip((1 + cosines[k]) / 2, 0, 1)), round(float(self.unit[k] @ whole), 3), n.bit_length() - 1


def identify(docs: DataFrame, dims: int = 1024, seed: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of docs (doc_id, text, lang).

    Prototypes are learned from text and lang of all documents that are not held out, lang not null. lang_pred: the language
    whose prototype has the greatest cosine, to six places, with the document's bundle of trigrams, both less the mean of the prototypes'
    directions; ties go to the first by code point. score: (1 + cosine) / 2. A text that is null or has no letters, and any text if nothing
    could be learned, is `und` with score 0. Rows that repeat a document count as often. Rows without doc_id are not held out.
    An empty table gives an empty result; very long texts are read whole. Other columns are ignored, whatever their names.
    """
    return compared(docs, profiles(docs, dims, seed), dims, seed).select("doc_id", "held_out", "lang_pred", "score")


def profiles(docs: DataFrame, dims: int = 1024, seed: int = 5) -> Profiles:
    """The prototypes of docs (doc_id, text, lang), those held out left aside."""
    small_batches(docs.sparkSession)
    d = docs.where(~held_out(F.col("doc_id").cast("long"))).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    return Profiles(learn(d, dims, seed), dims)


def compared(docs: DataFrame, found: Profiles, dims: int = 1024, seed: int = 5) -> DataFrame:
    """identify() with lang, likeness and size: the cosine with the prototype of lang_pred, nothing subtracted, rounded to
    three places, and the whole part of the binary logarithm of the number of distinct trigrams. Both are null for `und`.
    """

    def run(batches):
        space = kept(("letters", dims, seed), lambda: Space(dims, seed))
        for batch in batches:
            judged = [found.judge(n, v) for n, v in space.bundles(batch.column("text").to_pylist())]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.int32())
            out = [pa.array([j[k] for j in judged], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out", "lang")), *out], ["doc_id", "held_out", "lang", "lang_pred", "score", "likeness", "size"])

    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("lang").cast("string"))
    return d.mapInArrow(freed(run), "doc_id long, held_out boolean, lang string, lang_pred string, score double, likeness double, size int")


def limits(found: DataFrame, quantile: float, slack: float) -> dict[tuple[str, int], float]:
    """The least likeness of each (lang_pred, size): slack times a low quantile of the likeness of labelled documents, by language and size.

    Only documents that are not held out and are taken for the language of their label count. Sizes without any take the
    limit of the next smaller one; those below all others the limit of the smallest, less by the square root of the ratio of
    sizes, as likeness grows with the number of distinct trigrams. Likeness has three places, so a group has few distinct values.
    """
    told = found.where("not held_out and lang = lang_pred and size is not null")
    rows = told.groupBy("lang_pred", "size").agg((F.percentile("likeness", F.lit(quantile)) * slack).alias("least")).collect()  # languages times sizes
    by: dict[str, dict[int, float]] = {}
    for r in rows:
        by.setdefault(r.lang_pred, {})[r.size] = r.least
    full = {}
    for lang, known in sorted(by.items()):
        low = min(known)
        now = known[low]
        for size in range(40):
            now = known.get(size, now)
            full[lang, size] = now if size >= low else known[low] * 2 ** ((size - low) / 2)
    return full


def keep_languages(spark, docs: DataFrame, sf_dir: str, quantile: float = 0.01, slack: float = 0.6, dims: int = 1024, seed: int = 5) -> DataFrame:
    """docs whose language can be told: not those without letters, nor those too unlike the language they are taken for.

    Too unlike: a likeness below slack times the quantile of labelled documents of that language with about as many distinct trigrams, so
    letter noise, encoded data and languages not learned go. Where more than the quantile of the labelled documents are
    themselves such texts, the limit is no longer one between the two. A language without labelled documents that are
    recognised has no limit.

    Each row is judged by its own text as it passes, so rows that repeat a doc_id or have none are judged like others. An empty
    table stays empty; extra columns, whatever their names, stay as they are.
    """
    found = profiles(docs, dims, seed)
    least = limits(compared(docs, found, dims, seed), quantile, slack)
    at = docs.columns.index("text")

    def run(batches):
        space = kept(("letters", dims, seed), lambda: Space(dims, seed))
        for batch in batches:
            judged = [found.judge(n, v) for n, v in space.bundles(batch.column(at).cast(pa.string()).to_pylist())]
            yield batch.filter(pa.array([lang != UNDETERMINED and like >= least.get((lang, size), -1.0) for lang, _, like, size in judged], pa.bool_()))

    return docs.mapInArrow(freed(run), docs.schema)
