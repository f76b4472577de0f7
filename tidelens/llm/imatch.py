"""I-Match fingerprints from terms of middling document frequency, in DataFrame functions only."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.llm.shared import table

SPLIT = r"[^\p{L}\p{N}]+"
EMPTY = "00002A"  # what Spark's hash of an empty array gives here


def term_hashes(text: Column) -> Column:
    """A hash of each term, a run of letters and digits in lower case."""
    return F.transform(F.split(F.lower(text), SPLIT), lambda t: F.xxhash64(t))


def lexicon(docs: DataFrame, slots: int, min_idf: float, max_idf: float) -> Column:
    """A bit for each slot of hashed terms: whether a term of the slot is in the band by ln(documents / those with the term).

    Frequencies are exact, of each term (64 bits of its hash) over all documents; only the terms of the band fall into slots. A term of the
    band is in one document of e^max_idf at least, so there are fewer of them than e^max_idf times the distinct terms of a document
    on average (some hundred thousand for prose), however many documents there are. slots should be several times as many: a term
    outside the band passes with the chance that its slot is taken. The table of slots has a fixed size, so it can go to every task.
    """
    seen = docs.select(F.explode(F.array_distinct(term_hashes(F.col("text")))).alias("term"))
    n = docs.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    df = table(seen.groupBy("term").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    chosen = df.where(F.log(n.scalar() / F.col("df")).between(min_idf, max_idf)).select(F.pmod("term", F.lit(slots)).cast("int").alias("slot"))
    words = chosen.groupBy(F.shiftright("slot", 6).cast("long").alias("id")).agg(F.expr("bit_or(shiftleft(1L, slot & 63))").alias("bits"))
    every = docs.sparkSession.range(slots // 64).join(words, "id", "left")
    row = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"]).alias("lexicon"))
    return table(row, "lexicon").scalar()


TURNS, GROUPS = 4, 4  # subsets: so many groups of each of so many 16-bit parts of a term's hash


def fingerprint(text: Column, lex: Column, slots: int, least: int) -> Column:
    """level;hashes: for each of two levels and each random subset of the lexicon a hash of the text's sorted distinct terms in the subset.

    Terms are those of the lexicon, or all where fewer than least are in it. A term's hash has four 16-bit parts; at level l
    a term is in subset (t, g) if the lowest l bits of part t are the number g, so with probability 2^-l (at most 2^-13), and the four
    subsets of a part are apart from each other. The subsets of level l + 1 lie within those of level l. The level makes one or two
    terms likely in a subset.
    """
    word = lambda h: F.get(lex, F.shiftright(F.pmod(h, F.lit(slots)), 6).cast("int"))
    inside = lambda all_: F.array_distinct(F.filter(all_, lambda h: F.getbit(word(h), F.pmod(h, F.lit(64)).cast("int")) == 1))
    terms = lambda all_, some: F.array_sort(F.when(F.size(some) >= least, some).otherwise(F.array_distinct(all_)))
    return once(term_hashes(text), lambda all_: once(inside(all_), lambda some: once(terms(all_, some), _hashes)))


def once(value: Column, use) -> Column:
    """use(value), value being evaluated one time however often use refers to it."""
    return F.transform(F.array(value), use)[0]


def _hashes(terms: Column) -> Column:
    level = F.least(F.greatest(F.ceil(F.log2(F.size(terms).cast("double"))) - 1, F.lit(2)), F.lit(13)).cast("int")

    def digest(part: Column) -> Column:
        return F.right(F.lpad(F.hex(F.xxhash64(part)), 16, "0"), F.lit(6))

    def both(level: Column) -> Column:
        # bits of a part that are 0 for its four subsets at a level: all below the level but the lowest two
        low, high = (F.call_function("shiftleft", F.lit(1).cast("long"), level + k) - F.lit(GROUPS) for k in (0, 1))

        def of_part(turn: int) -> Column:
            near = F.filter(terms, lambda h: F.shiftright(h, 16 * turn).bitwiseAND(low) == 0)
            further = lambda some: F.filter(some, lambda h: F.shiftright(h, 16 * turn).bitwiseAND(high) == 0)
            group = lambda some, g: digest(F.filter(some, lambda h: F.shiftright(h, 16 * turn).bitwiseAND(GROUPS - 1) == g))
            return once(near, lambda some: F.array(F.array(*(group(some, g) for g in range(GROUPS))), once(further(some), lambda few: F.array(*(group(few, g) for g in range(GROUPS))))))

        at = lambda k: lambda y: y[k]
        return once(F.array(*(of_part(t) for t in range(TURNS))), lambda x: F.concat(*(F.flatten(F.transform(x, at(k))) for k in (0, 1))))

    return F.concat(level.cast("string"), F.lit(";"), F.array_join(once(level, both), ","))


def likeness(a: Column, b: Column, subsets: int = TURNS * GROUPS, draws: int = 4) -> Column:
    """0 to 1: the chance that of so many subsets, drawn from those with terms, one agrees. Equal fingerprints: 1."""
    level = lambda x: F.substring_index(x, ";", 1).cast("int")
    hashes = lambda x: F.split(F.substring_index(x, ";", -1), ",")
    half = lambda x, up: F.when(up, F.slice(hashes(x), subsets + 1, subsets)).otherwise(F.slice(hashes(x), 1, subsets))
    gap = level(b) - level(a)
    pairs = F.when(gap == 0, F.arrays_zip(hashes(a).alias("x"), hashes(b).alias("y"))).when(F.abs(gap) == 1, F.arrays_zip(half(a, gap == 1).alias("x"), half(b, gap == -1).alias("y")))
    full = F.filter(pairs, lambda p: (p["x"] != EMPTY) | (p["y"] != EMPTY))
    same = F.size(F.filter(full, lambda p: p["x"] == p["y"])) / F.size(full)
    return F.when(a == b, 1.0).when(F.abs(gap) > 1, 0.0).when(F.size(full) == 0, 0.0).otherwise(1 - F.pow(1 - same, F.lit(draws)))


def with_next(docs: DataFrame, printed, range_mb: float = 16) -> DataFrame:
    """docs (doc_id, text, key) with fingerprint, that printed adds, next_text and next_print: those of the next document by key,
    the first's after the last.

    Documents are dealt to ranges of key, of about range_mb each: Spark range-partitions the keys alone, and the least key of each
    part is a bound (one a range comes to the driver). A row finds its range in two steps, among every so many-th bound and then among those
    between. Each range also gets the first document of the next one. One shuffle of the texts.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, int(size / (range_mb * 2**20)))
    kind = docs.schema["key"].dataType.simpleString()
    bounds = [r.key for r in docs.select("key").repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("key")).orderBy("key").collect()][1:]
    step = math.isqrt(len(bounds)) + 1
    listed = lambda x: docs.sparkSession.createDataFrame([(x,)], f"bounds array<{kind}>").scalar()
    below = lambda some: F.size(F.filter(some, lambda b: b <= F.col("key")))
    coarse = F.greatest(below(F.col("every")) - 1, F.lit(0)) * step
    docs = docs.withColumns({"bounds": listed(bounds), "every": listed(bounds[::step])})
    docs = docs.withColumn("coarse", coarse).withColumn("range", F.col("coarse") + below(F.slice("bounds", F.col("coarse") + 1, F.lit(step)))).drop("bounds", "every", "coarse").withColumn("extra", F.lit(0))
    first = table(docs.groupBy("range").agg(F.min("key").alias("key")), "first")
    order = Window.orderBy("range")
    before = first.withColumn("to", F.coalesce(F.lag("range").over(order), F.last("range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    heads = docs.join(before.select("range", "key", "to"), ["range", "key"])
    heads = heads.groupBy("to").agg(F.min("text").alias("text"), F.min("key").alias("key"))
    heads = printed(heads.select(F.lit(None).cast("long").alias("doc_id"), "text", "key", F.col("to").alias("range"), F.lit(1).alias("extra")))
    w = Window.partitionBy("range").orderBy("extra", "key", "text")
    both = printed(docs).select(heads.columns).unionByName(heads)
    return both.withColumns({"next_text": F.lead("text").over(w), "next_print": F.lead("fingerprint").over(w)}).where("extra = 0")


def fingerprints(docs: DataFrame, slots: int = 1 << 22, min_idf: float = 3.0, max_idf: float = 7.5, least: int = 4) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of docs (doc_id, text).

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many of the next document. A
    null text is empty. Equal texts have equal fingerprints. Rows without doc_id come first in the order; rows of one
    doc_id are ordered by a hash of their text, then by text, so they may fill many ranges. An empty table gives an empty result; very
    long texts are read whole. Other columns are ignored, whatever their names.
    """
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lex = lexicon(d, slots, min_idf, max_idf)
    printed = lambda x: x.withColumn("lex", lex).withColumn("fingerprint", fingerprint(F.col("text"), F.col("lex"), slots, least)).drop("lex")
    d = d.withColumn("key", F.struct(F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("doc_id"), F.xxhash64("text").alias("h")))
    e = with_next(d, printed).withColumn("n_chars", F.length("text").cast("long"))
    cut_ = F.floor(F.col("n_chars") / 4).cast("int")
    e = e.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut_).cast("int")), F.substring("next_text", F.lit(1), cut_)))
    e = e.withColumn("lex", lex).withColumn("edited_fingerprint", fingerprint(F.col("edited"), F.col("lex"), slots, least))
    e = e.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "next_print")
    return e.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"))
