"""Mixing sources to target weights by Pareto order sampling."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.llm.shared import WORD, table


def uniform(seed: int, key: Column) -> Column:
    """A number in (0, 1) from a hash of seed and key, so that reruns and other partitions agree."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")), 256), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def per_source(rows: DataFrame, facts: DataFrame, how: str = "inner", spread: int = 64) -> DataFrame:
    """rows (c) joined with their source's row of facts (s); each source is dealt by hashes of doc_id, so that a large one is not one task's."""
    salted = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(spread)).cast("int"))
    return dealt.alias("c").join(salted.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")) & (F.col("c.salt") == F.col("s.salt")), how)


def targets(sizes: DataFrame, cycle: int = 3, most: int = 3) -> DataFrame:
    """sizes (source, source_size) with target: a share of all sizes by weight, no more than most times source_size.

    Sources in order of code point, null last, weigh 1, 2, ..., cycle, 1, ...; what a source can't take is reshared by weight.
    Filling all sources in proportion to weight until they reach their limits gives target = least(most * size,
    weight * level): sources by size per weight reach their limits first, and the level follows from running sums.
    One row a source; the running sums are over that summary, not over documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % cycle + 1).cast("long"))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    whole = Window.partitionBy()
    w = w.withColumns({
        "full": F.coalesce(F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most,
        "open": F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(whole),
        "turn": F.row_number().over(fill),
    })
    level = (F.col("total") - F.col("full")) / F.col("open")
    # the first source that the level does not fill sets it for all; those before it are full
    w = w.withColumn("level", level).withColumn("turn", F.when(F.col("level") * F.col("weight") <= F.col("source_size") * most, F.col("turn")))
    w = w.withColumn("level", F.min_by("level", "turn").over(whole))
    return w.select("source", "source_size", "weight", F.least((F.col("source_size") * most).cast("double"), F.col("weight") * F.col("level")).alias("target"))


def plan(sizes: DataFrame, most: int, cycle: int, seed: int, bins: int, per_bin: int) -> DataFrame:
    """What the mix does with each source, a row a source: source, source_size, target, rate, n_bins, edge, last.

    sizes: (doc_id, source, size, bits). rate: expected copies of a document by its weight; edge: the bin of ranks in which the words run
    out; last: (rank, size, doc_id) of the last document that is taken in it.
    """
    classes = sizes.groupBy("source", "bits").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    sources = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), cycle, most)
    counts = classes.groupBy("source").agg(F.sum("n").alias("n_docs"))
    # the rate of each source: heavier classes reach the limit first
    c = classes.where("bits is not null").withColumn("w", (F.col("bits") + 1).cast("long"))
    same = F.col("c.source").eqNullSafe(F.col("s.source"))
    c = c.alias("c").join(sources.alias("s"), same).select("s.source", "bits", "words", "w", "target")
    down = Window.partitionBy("source").orderBy(F.col("w").desc())
    c = c.withColumns({
        "full": F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most,
        "open": F.sum(F.col("words") * F.col("w")).over(down.rowsBetween(0, Window.unboundedFollowing)),
    })
    rate = (F.col("target") - F.col("full")) / F.col("open")
    rates = c.withColumn("rate", rate).groupBy("source").agg(F.max_by("rate", F.when(F.col("rate") * F.col("w") <= most, F.col("w"))).alias("rate"))
    facts = sources.alias("s").join(rates.alias("c"), same, "left").select("s.*", F.coalesce("c.rate", F.lit(float(most))).alias("rate"))
    facts = facts.alias("s").join(counts.alias("c"), same).select("s.*", F.greatest(F.lit(bins), F.ceil(F.col("n_docs") / per_bin) * 16).cast("long").alias("n_bins"))
    facts = table(facts, "sources")

    e = ranked(with_facts(sizes, facts), most, seed)
    sums = e.groupBy("source", "bin").agg(F.sum(F.when(F.col("rank").isNotNull(), F.col("size")).otherwise(0)).alias("words"), F.sum(F.col("whole") * F.col("size")).alias("sure"), F.first("target").alias("target"))
    up = Window.partitionBy("source").orderBy("bin")
    sums = sums.withColumn("wanted", F.col("target") - F.sum("sure").over(Window.partitionBy("source")))
    sums = sums.where("bin is not null").withColumn("before", F.sum("words").over(up) - F.col("words"))
    edge = sums.where("before < wanted and before + words >= wanted").groupBy("source").agg(F.min("bin").alias("edge"), F.min("before").alias("before"), F.min("wanted").alias("wanted"))
    last = sums.groupBy("source").agg(F.max("wanted").alias("all_wanted"), F.max(F.col("before") + F.col("words")).alias("all_words"))
    edges = last.alias("s").join(edge.alias("c"), same, "left").select("s.source", "before", "wanted", F.coalesce("edge", F.when(F.col("all_words") < F.col("all_wanted"), F.lit(2**62)).otherwise(F.lit(-1))).alias("edge"))
    edges = table(edges, "edges")
    # only the bin at the edge is ordered; what is taken of it is a beginning, so its last document tells
    order = Window.partitionBy("source").orderBy("rank", "size", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    at = with_facts(e, edges).where("bin = edge").withColumn("sum", F.sum("size").over(order) + F.col("before"))
    taken = at.where(F.col("sum") - F.col("size") / 2 <= F.col("wanted")).groupBy("source").agg(F.max(F.struct("rank", "size", "doc_id")).alias("last"))
    edges = edges.alias("s").join(taken.alias("c"), same, "left").select("s.source", "edge", "last")
    return table(facts.alias("s").join(edges.alias("c"), same, "left").select("s.*", "edge", "last"), "plan")


def with_facts(rows: DataFrame, facts: DataFrame, small: int = 100_000) -> DataFrame:
    """rows with the columns of their source's row of facts: by broadcast if facts has at most so many rows, else by per_source()."""
    added = [f"s.{c}" for c in facts.columns if c != "source"]
    if facts.count() <= small:
        both = rows.alias("c").join(F.broadcast(facts).alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")), "left")
    else:
        both = per_source(rows, facts, "left")
    return both.select([f"c.{c}" for c in rows.columns] + added)


def ranked(e: DataFrame, most: int, seed: int) -> DataFrame:
    """e (doc_id, size, bits and its source's facts) with whole, the copies taken for certain, and for the rest rank and bin."""
    expected = F.when(F.col("size") > 0, F.least(F.lit(float(most)), F.col("rate") * (F.col("bits") + 1))).otherwise(F.lit(0.0))
    e = e.withColumn("expected", expected).withColumn("whole", F.floor("expected")).withColumn("p", F.col("expected") - F.col("whole"))
    u = uniform(seed, F.col("doc_id"))
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    return e.withColumn("rank", F.when(F.col("p") > 0, odds)).withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * F.col("n_bins")))


def copies_of(e: DataFrame, most: int, seed: int) -> DataFrame:
    """e (doc_id, size, bits and its source's row of plan()) with copies. Each row is judged on its own."""
    first = (F.col("bin") < F.col("edge")) | ((F.col("bin") == F.col("edge")) & (F.struct("rank", "size", "doc_id") <= F.col("last")))
    return ranked(e, most, seed).withColumn("copies", F.col("whole") + F.coalesce(first.cast("long"), F.lit(0)))


def sized(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_bits(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bits", F.when(F.col("size") > 0, F.length(F.bin("size"))))


def mix_sources(docs: DataFrame, most: int = 3, cycle: int = 3, seed: int = 7, bins: int = 1024, per_bin: int = 20_000) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): how often the mix takes each of docs (doc_id, text, source).

    size: words of the text (null: 0). A document's expected copies are its source's rate times its weight, one more
    than the bits of its size, at most `most`; the rate makes expected words meet the source's target. The whole part
    of that is taken for certain. The fraction p is an inclusion probability: documents are ranked by u/(1-u) over
    p/(1-p), u a hash of doc_id, and taken in that order up to the words that remain (Pareto order sampling, its fixed size
    counted in words); the document at the edge counts if half of it fits. So a source's words are within half a
    document of its target, or one document where limits bind. Empty documents are never taken; rows that repeat a doc_id
    share u and are ranked by size, equal ones being taken together; rows without doc_id are taken as often as is certain. An
    empty table gives an empty result; very long texts are counted whole. Other columns are ignored, whatever their names. A null
    source is a source of its own.

    A source of any size is never ranked whole: ranks are cut into bins (more for larger sources), and only the bin
    at the edge is ordered.
    """
    d = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), sized(F.col("text")).alias("size"))
    d = table(with_bits(d), "sizes")
    e = copies_of(with_facts(d, plan(d, most, cycle, seed, bins, per_bin)), most, seed)
    return e.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_stage(spark, docs: DataFrame, sf_dir: str, most: int = 3, cycle: int = 3, seed: int = 7, bins: int = 1024, per_bin: int = 20_000) -> DataFrame:
    """docs as the mix takes them: each row as often as it has copies, which follow from its own text, source and doc_id and the plan.

    Rows that repeat a doc_id are taken by their own sizes; rows without one as often as is certain. An empty table stays empty;
    extra columns, whatever their names, stay as they are.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    own = F.col("row")
    rows = with_bits(rows.select("row", own["doc_id"].cast("long").alias("doc_id"), own["source"].cast("string").alias("source"), sized(own["text"]).alias("size")))
    sizes = table(with_bits(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), sized(F.col("text")).alias("size"))), "sizes")
    taken = copies_of(with_facts(rows, plan(sizes, most, cycle, seed, bins, per_bin)), most, seed).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select([own[c].alias(c) for c in docs.columns])


#: The same mix for op2, in DuckDB's SQL.
MIX_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
b as (select *, case when size > 0 then length(bin(size)) end as bits from d),
src as (select source, sum(size)::bigint as source_size from b group by source),
w as (select *, ((row_number() over (order by source is null, source collate "C") - 1) % 3 + 1)::bigint as weight from src),
f as (select *, coalesce(sum(source_size) over (order by source_size / weight, source is null, source collate "C" rows between unbounded preceding and 1 preceding), 0) * 3 as full_,
  sum(weight) over (order by source_size / weight, source is null, source collate "C" rows between current row and unbounded following) as open_,
  sum(source_size) over () as total, row_number() over (order by source_size / weight, source is null, source collate "C") as turn from w),
g as (select *, arg_min((total - full_)::double / open_, case when (total - full_)::double / open_ * weight <= source_size * 3 then turn end) over () as level from f),
t as (select source, source_size, least((source_size * 3)::double, weight * level) as target from g),
c as (select b.source, bits, sum(size)::bigint as words, bits + 1 as w from b where bits is not null group by all),
c2 as (select c.*, t.target, coalesce(sum(words) over (partition by c.source order by w desc rows between unbounded preceding and 1 preceding), 0) * 3 as full_,
  sum(words * w) over (partition by c.source order by w desc rows between current row and unbounded following) as open_ from c join t on c.source is not distinct from t.source),
r as (select source, arg_max((target - full_) / open_, case when (target - full_) / open_ * w <= 3 then w end) as rate from c2 group by source),
e as (select b.doc_id, b.source, b.size, t.source_size, t.target,
  case when b.size > 0 then least(3.0::double, coalesce(r.rate, 3.0::double) * (b.bits + 1)) else 0.0::double end as expected
  from b join t on b.source is not distinct from t.source left join r on b.source is not distinct from r.source),
p as (select *, floor(expected)::bigint as whole, expected - floor(expected) as p,
  ((('0x' || substr(sha256('7|' || doc_id::varchar), 1, 13))::bigint)::double + 0.5) / 4503599627370496.0::double as u from e),
k as (select *, case when p > 0 then (u / (1 - u)) / (p / (1 - p)) end as rnk from p),
s as (select *, sum(whole * size) over (partition by source) as sure,
  case when rnk is not null then sum(size) over (partition by source order by rnk nulls last, size, doc_id rows between unbounded preceding and current row) end as run from k),
m as (select *, whole + case when run is not null and run - size < target - sure and run - size / 2.0::double <= target - sure then 1 else 0 end as copies from s)
select doc_id, size, source_size, target, (copies * size)::bigint as taken from m
"""
