"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm.shared import components, cut, freed, kept, mix, small_batches, split_by_ids, table, Words

WIDTH, BANDS, ROWS, UNIVERSE = 5, 40, 5, 1 << 20


def shingles(words: Words, width: int) -> Iterator[np.ndarray]:
    """Each document's set of shingles as sorted 64-bit hashes: runs of so many words, or else all its words as one."""
    at, h = words.runs(width)
    edge = np.searchsorted(at, words.first)
    for d, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
        if b - a >= width:
            yield np.unique(h[edge[d] : edge[d + 1]])
        elif b > a:
            whole = words.hashes[a:b] * np.uint64(3)
            one = np.bitwise_xor.reduce(mix(whole, 7) * (2 * np.arange(b - a, dtype=np.uint64) + np.uint64(1)), keepdims=True)
            yield mix(one + np.uint64(b - a), 11)
        else:
            yield np.zeros(0, np.uint64)


def permuted(hashes: np.ndarray, seed: int, universe: int) -> np.ndarray:
    """The first permutation: a bijection of all 64-bit integers, whose upper bits give each shingle's position in the circle."""
    bits = universe.bit_length() - 1
    return (mix(hashes, seed + 2) >> np.uint64(64 - bits)).astype(np.int64)


def circulant(seed: int, universe: int, size: int) -> np.ndarray:
    """Row i holds what the second permutation, of the circle's positions, gives position i under each of so many shifts.

    Shift k of the permutation maps i to its value at i + k, so a position's values under all shifts lie side by
    side in the permutation.
    """
    values = np.random.default_rng(seed).permutation(universe).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[: size - 1]]), size)


def signatures(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, universe: int = UNIVERSE, seed: int = 1) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands) of docs (doc_id, text).

    set_a and set_b are two 64-bit sums over the set: with n_shingles they tell sets apart. bands: a hash of each
    band of the signature, null for an empty set. The signature has bands * rows coordinates: coordinate k is the least value of the
    second permutation, shifted by k, over the positions that the first one gives. Where a text has so many shingles that
    several share a position, its sketch is that of the set of positions; the full sets are verified all the same.
    """

    def run(batches):
        shifts = kept(("circulant", seed, universe, bands * rows), lambda: circulant(seed, universe, bands * rows))
        salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        odd = mix(np.arange(rows, dtype=np.uint64), 5) | np.uint64(1)  # multipliers without a common factor
        for batch in batches:
            sets = list(shingles(Words(batch.column("text"), lower=True), width))
            sums = np.array([[len(s), mix(s, 1).sum(), mix(s, 2).sum()] for s in sets], np.uint64).reshape(-1, 3).astype(np.int64)
            least = np.zeros((len(sets), bands * rows), np.int32)
            for d, s in enumerate(sets):
                places = permuted(s, seed, universe)
                for k in range(0, len(places), 8192):
                    low = shifts[places[k : k + 8192]].min(axis=0)
                    least[d] = np.minimum(least[d], low) if k else low
            parts = mix((least.reshape(-1, bands, rows).astype(np.uint64) * odd).sum(axis=2, dtype=np.uint64) + salt).astype(np.int64)
            listed = pa.ListArray.from_arrays(np.arange(0, parts.size + 1, bands, dtype=np.int32), parts.ravel(), mask=pa.array(sums[:, 0] == 0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, sums.T), listed], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(freed(run), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def near(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = np.intersect1d(x, y, assume_unique=True).size
    return 100 * both >= percent * (len(x) + len(y) - both)


def like_hub(pairs: DataFrame, texts: DataFrame, width: int, percent: int, chunk: int = 512) -> DataFrame:
    """Those of pairs (a, b) whose full sets of shingles are near. texts: (doc_id, text); with several texts of a doc_id, any will do.

    The partners of a hub a are dealt to chunks of about so many rows; the hub's text goes to each chunk once.
    """

    def run(batches):
        hub, sets = None, []
        for batch in batches:
            key = list(zip(batch.column("a").to_pylist(), batch.column("part").to_pylist(), strict=True))
            own, good = batch.column("own").to_pylist(), []
            for k, right in enumerate(shingles(Words(batch.column("text"), lower=True), width)):
                if key[k] != hub:
                    hub, sets = key[k], []
                if own[k] == 0:
                    sets.append(right)
                good.append(own[k] == 1 and any(near(left, right, percent) for left in sets))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    hubs = sizes.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = dealt.withColumn("own", F.lit(1)).unionByName(hubs.withColumn("own", F.lit(0)))
    rows = rows.join(texts.withColumnRenamed("doc_id", "b"), "b").repartition("a", "part").sortWithinPartitions("a", "part", "own")
    return rows.select("a", "b", "part", "own", "text").mapInArrow(freed(run), "a long, b long").distinct()


def uneven(rows: DataFrame) -> DataFrame:
    """Those of rows (bucket, doc_id, n, component) whose bucket holds several components, with its largest by members (main) and the
    sums of n of all members (all_n) and of those of other components (others_n)."""
    parts = rows.groupBy("bucket", "component").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    sizes = parts.groupBy("bucket").agg(F.count("*").alias("c"), F.sum("n").alias("all_n"), F.max(F.struct("k", "component", "n")).alias("top")).where("c > 1")
    return rows.join(sizes.select("bucket", F.col("top.component").alias("main"), "all_n", (F.col("all_n") - F.col("top.n")).alias("others_n")), "bucket")


def runs_of(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each run, one run after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Prefixes:
    """The sets of a block with their shingles from the rarest on, and an index of those that a near set has to share one of.

    Sets of n and m shingles are near only if they share `need` of them, and a set of n shares one of its first n - ceil(n * percent / 100) + 1
    with any that is near (in an order that both have). Where the first that both share lies at places i and j, no more than
    min(n - i, m - j) can be shared, so most pairs of texts made from one template end there.
    """

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.size = percent, np.array([len(s) for s in sets])
        self.first = np.cumsum(self.size) - self.size
        self.tokens, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.rank = np.empty(len(self.tokens), np.int64)
        self.rank[np.argsort(counts, kind="stable")] = np.arange(len(self.tokens))
        owner = np.repeat(np.arange(len(sets)), self.size)
        order = np.lexsort((self.rank[inverse], owner))
        self.ranks = self.rank[inverse][order]
        place = np.arange(len(owner)) - self.first[owner]
        held = place < self.prefix(self.size)[owner]
        by = np.argsort(self.ranks[held], kind="stable")
        self.owner, self.place = owner[held][by], place[held][by]
        self.at = np.searchsorted(self.ranks[held][by], np.arange(len(self.tokens) + 1))
        self.mark = np.zeros(len(self.tokens), bool)

    def prefix(self, n):
        return n + (-n * self.percent // 100) + 1

    def near(self, s: np.ndarray) -> np.ndarray:
        """The numbers of all sets near s, by their full sets."""
        n, percent = len(s), self.percent
        found = np.searchsorted(self.tokens, s)
        found = found[self.tokens[np.minimum(found, len(self.tokens) - 1)] == s]
        ranks = np.sort(self.rank[found])
        # shingles that no set of the block has are the rarest and come first
        i = np.arange(n - len(ranks), min(self.prefix(n), n))
        low, high = self.at[ranks[: len(i)]], self.at[ranks[: len(i)] + 1]
        hit = runs_of(low, high - low)
        owner, m = self.owner[hit], self.size[self.owner[hit]]
        most = np.minimum(n - np.repeat(i, high - low), m - self.place[hit])
        some = np.unique(owner[most * (100 + percent) >= percent * (n + m)])
        if not len(some):
            return some
        self.mark[ranks] = True
        m = self.size[some]
        both = np.add.reduceat(self.mark[self.ranks[runs_of(self.first[some], m)]], np.cumsum(m) - m, dtype=np.int64)
        self.mark[ranks] = False
        return some[100 * both >= percent * (n + m - both)]


def joined(active: list[int], others: list[int], label: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (x, y), x of active and y of others, whose sets are near, as many as join what is not yet of one label: label[x] is
    the component of x. No set is empty.
    """
    up: dict[int, int] = {}

    def root(c):
        while c in up:
            c = up[c]
        return c

    index = Prefixes([sets[y] for y in others], percent)
    out = []
    for x in active:
        for k in index.near(sets[x]).tolist():
            y = others[k]
            a, b = root(label[x]), root(label[y])
            if a != b:
                up[a] = b
                out.append((x, y))
    return out


def between_components(rows: DataFrame, texts: DataFrame, width: int, percent: int, active: int = 1_000_000, block: int = 2_000_000) -> DataFrame:
    """Links (a, b) between members of a bucket that are of different components: enough of them to join all that are near.

    rows: as uneven() gives them. In each bucket the members of all components but the largest are compared with all
    members on full sets, in blocks of bounded size (so many shingles each); a block puts out fewer links than
    it has members. Members are dealt to blocks first, and then joined with their texts.
    """
    r = rows.withColumns({"own": F.col("component") != F.col("main"), "c_a": F.ceil(F.col("others_n") / active).cast("int"), "c_b": F.ceil(F.col("all_n") / block).cast("int")})
    i, j = (F.pmod(F.xxhash64("doc_id", F.lit(k)), F.col(c)).cast("int") for k, c in enumerate(("c_a", "c_b")))
    spot = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    none = F.array().cast("array<struct<i:int,j:int,role:int>>")
    spots = F.when((F.col("c_a") == 1) & (F.col("c_b") == 1), F.array(spot(F.lit(0), F.lit(0), 2))).otherwise(
        F.concat(F.transform(every("c_a"), lambda x: spot(x, j, 1)), F.when(F.col("own"), F.transform(every("c_b"), lambda x: spot(i, x, 0))).otherwise(none))
    )
    r = r.select("bucket", F.explode(spots).alias("s"), "doc_id", "component", "own").select("bucket", "s.*", "doc_id", "component", "own")

    def run(batches):
        now, group = None, []

        def links():
            doc, label, role, own, sets = zip(*group, strict=True)
            first = [k for k in range(len(doc)) if role[k] != 1 and own[k] and len(sets[k])]
            second = [k for k in range(len(doc)) if role[k] > 0 and len(sets[k])]
            found = joined(first, second, label, sets, percent) if first and second else []
            return [(doc[x], doc[y]) for x, y in found]

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("bucket", "i", "j", "doc_id", "component", "role", "own"))
            out = []
            for *key, doc, label, role, own, s in zip(*columns, shingles(Words(batch.column("text"), lower=True), width), strict=True):
                if key != now:
                    out += links() if group else []
                    now, group = key, []
                group.append((doc, label, role, own, s))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        if group:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links()], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = r.join(texts, "doc_id").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "doc_id")
    return dealt.select("bucket", "i", "j", "doc_id", "component", "role", "own", "text").mapInArrow(freed(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = 75, bands: int = BANDS, rows: int = ROWS, universe: int = UNIVERSE, seed: int = 1) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): groups of documents linked by near-equal sets of word shingles.

    Words are lower-cased (A-Z) runs of characters other than white space; a document's set holds its distinct runs
    of width words (fewer words: all of them as one; none: empty, linked with nothing). Documents are linked if
    100 * intersection >= percent * union on full sets. component_id: the least doc_id that links reach; kept: it
    is the document's own. A null text is empty. A row without doc_id takes no part and is kept. Rows that repeat a
    doc_id get a row each, with the size of their own set; they are one document, linked by any of its texts. An empty table gives an
    empty result; very long texts are read whole. Other columns of docs are ignored, whatever their names.

    Documents of equal sets first become one. In each bucket of a band all members are verified against the least one, a
    pair a member at most. Where a bucket then still holds more than one component, the members outside its largest are
    compared with all members on full sets, in blocks of bounded size, which put out only links that join components.
    So no link between members of a bucket is lost, and what comes out grows with the members. Texts travel for verification only,
    those of documents that share a bucket with another.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = table(signatures(docs, width, bands, rows, universe, seed), "signatures")
    known = signed.where("n_shingles > 0 and doc_id is not null")
    equal = known.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"))
    members = table(known.select("doc_id", "set_a", "set_b", "n_shingles").join(equal, ["set_a", "set_b", "n_shingles"]).select("doc_id", "rep").distinct(), "members")
    one = known.join(members.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "set_a", "set_b", "n_shingles"])
    inside = one.select(F.explode("bands").alias("bucket"), "doc_id", F.col("n_shingles").alias("n"))
    heads = inside.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last").select("bucket", "hub")
    inside = table(inside.join(heads, "bucket"), "buckets")  # those with several members
    ids = inside.select("doc_id").distinct()
    texts = table(split_by_ids(docs, ids)[0].join(ids, "doc_id", "left_semi").distinct(), "texts")

    # texts of one doc_id that equal other documents' tie those together
    several = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc_id", "a")
    ties = members.join(several, "doc_id").where("rep != a").select("a", F.col("rep").alias("b"))

    hubs = inside.where("doc_id != hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = cut(like_hub(hubs, texts, width, percent).unionByName(ties).distinct())
    parts = labels(links)
    labelled = inside.select("bucket", "doc_id", "n").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    more = cut(between_components(uneven(labelled), texts, width, percent))
    if not more.isEmpty():
        parts = labels(links.unionByName(more))

    found = members.join(parts.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    out = signed.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def labels(links: DataFrame) -> DataFrame:
    """(node, component) of links (a, b), in the shared folder."""
    return links.sparkSession.createDataFrame([], "node long, component long") if links.isEmpty() else cut(components(links))


def keep_first(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the copies: of each group of near duplicates the document of least doc_id stays, with all rows of that doc_id.

    Rows without doc_id stay. An empty table stays empty. Extra columns, whatever their names, stay as they are. Only rows whose doc_id
    may be among those that go are joined with these.
    """
    gone = table(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "gone")
    maybe, sure = split_by_ids(docs, gone)
    gone = gone.withColumnRenamed("doc_id", "__gone")
    return sure.unionByName(maybe.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti"))
