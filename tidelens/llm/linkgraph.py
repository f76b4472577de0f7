"""URL filters from rules and link-graph propagation over hosts, in DataFrame functions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelens.llm.shared import cut

#: (rule, verdict): host, then the beginning of the path. The longest that fits wins.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
HREF = r"""(?i)href\s*=\s*["']?([^"'\s>]+)"""
TARGET = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest of a list of rules that fits, or null; ties go to the one listed first."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(reversed(rules), key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links of pages (host, html) from their host to another."""
    links = pages.where("host != ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("link"))
    links = links.select("src", F.translate(F.regexp_extract("link", TARGET, 1), UPPER, LOWER).alias("dst"))
    return links.where("dst != '' and dst != src").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, bound: float = 1e-5) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust) along edges (src, dst, n).

    Personalised PageRank: a host gets (1 - damping) of its seed and damping of what reaches it. A round moves on what
    the last one added. Rounds end when all that is still to come, to all hosts together, is below bound: a round adds at most
    damping of what the last one added, in all. The number of rounds grows with the logarithm of the number of hosts.
    Trust follows links in proportion to their number; distrust goes back from a host to those that link to it. Edges are one row a
    pair of hosts, so a round moves as many rows as there are such pairs; a host with many is a skewed key of a
    join that adaptive execution splits, before a sum that is pre-aggregated.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    back = edges.groupBy("dst").agg(F.sum("n").alias("all"))
    steps = edges.join(out, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("all")).alias("w"))
    steps = cut(steps.unionByName(edges.join(back, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), (F.col("n") / F.col("all")).alias("w"))))
    start = seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "seed")).where("seed > 0")
    start = cut(start.select("host", "kind", (F.col("seed") * (1 - damping)).alias("rank")))
    rank = start.withColumn("new", F.col("rank"))
    while not steps.isEmpty():
        moved = rank.where("new > 0").join(steps, ["host", "kind"]).select(F.col("to").alias("host"), "kind", (F.col("new") * F.col("w") * damping).alias("rank"))
        both = moved.withColumn("new", F.col("rank")).unionByName(rank.withColumn("new", F.lit(0.0)))
        rank = cut(both.groupBy("host", "kind").agg(F.sum("rank").alias("rank"), F.sum("new").alias("new")))
        if (rank.agg(F.sum("new")).first()[0] or 0.0) * damping / (1 - damping) < bound:
            break
    return rank.groupBy("host").agg(*(F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")))


def judge_urls(pages: DataFrame, rules=RULES, damping: float = 0.85, margin: float = 0.01) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each of pages (page_id, url, html).

    verdict: that of the longest rule that fits. Where none does, the host's: block if its distrust exceeds its trust by
    more than margin, else allow. Seeds of trust and distrust are the shares of a host's pages that rules allow and block;
    both are propagated over links between hosts until what is still to come is below a thousandth of margin. Null urls and those without :// have an empty host and path,
    no rule and no links, and are allowed. Null html has no links. Rows that repeat a page count as often. Other columns are ignored.
    """
    p = pages.select("page_id", "url", "html").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    p = p.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    given = F.lit(None).cast("string")
    for rule, verdict in rules:
        given = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(given)
    p = p.withColumn("given", given)
    share = lambda v: F.avg(F.when(F.col("given") == v, 1.0).otherwise(0.0))
    seeds = p.where("host != ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = propagate(seeds, host_edges(p), damping, margin / 1000)
    doomed = scores.where(F.col("distrust") - F.col("trust") > margin).select("host", F.lit("block").alias("doom"))
    out = p.select("page_id", "host", "path", "rule", "given").join(doomed, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", "doom", F.lit("allow")).alias("verdict"))


def judge_sql(rules=RULES, damping: float = 0.85, rounds: int = 8, margin: float = 0.01) -> str:
    """The same in DuckDB's SQL, a query a round."""
    when = " ".join(
        f"when (host = '{r.partition('/')[0]}' or ends_with(host, '.{r.partition('/')[0]}')) and starts_with(path, '/{r.partition('/')[2]}') then '{r}'"
        for r, _ in sorted(rules, key=lambda r: -len(r[0]))
    )
    given = " ".join(f"when '{r}' then '{v}'" for r, v in rules)
    steps = "".join(f"""
r{k + 1} as (select host, kind, sum(rank) as rank from (select s.dst as host, s.kind, rank * w * {damping}::double as rank from r{k} join steps s on s.src = r{k}.host and s.kind = r{k}.kind
  union all select * from r0) group by all),""" for k in range(rounds))
    return rf"""
with u as (select page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') as host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from pages),
p as (select *, case {when} end as rule from u),
q as (select *, case rule {given} end as given from p),
links as (select host as src, translate(regexp_extract(unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?([^"''\s>]+)', 1)), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1), '{UPPER}', '{LOWER}') as dst from q where host != ''),
edges as (select src, dst, count(*) as n from links where dst != '' and dst != src group by all),
steps as (select 'trust' as kind, src, dst, n / sum(n) over (partition by src) as w from edges union all select 'distrust', dst, src, n / sum(n) over (partition by dst) from edges),
seeds as (select host, avg(case given when 'allow' then 1.0::double else 0 end) as trust, avg(case given when 'block' then 1.0::double else 0 end) as distrust from q where host != '' group by host),
r0 as (select host, 'trust' as kind, trust * {1 - damping}::double as rank from seeds where trust > 0 union all select host, 'distrust', distrust * {1 - damping}::double from seeds where distrust > 0),{steps}
doom as (select host from r{rounds} group by host having sum(case kind when 'distrust' then rank else -rank end) > {margin}::double)
select page_id, host, path, rule, coalesce(given, case when host in (select host from doom) then 'block' else 'allow' end) as verdict from q
"""
