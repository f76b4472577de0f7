"""Operators on whole tables: joins, groupings, windows. Every one is a function from DataFrames to a DataFrame."""

import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelens.functions import values as V


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode, else an error."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is to name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tidelens-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path


def held(rows: DataFrame) -> DataFrame:
    """rows without their lineage, in the folder that driver and executors share."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def reconcile(cells: DataFrame, controls: DataFrame, group: str, weight: str, total: str) -> DataFrame:
    """cells with weight scaled so that each group meets its control total; groups without one stay."""
    sums = cells.groupBy(group).agg(F.sum(weight).alias("_now"))
    factor = F.coalesce(V.ratio(F.col(total), F.col("_now")), F.lit(1.0))
    return cells.join(sums.join(controls, group, "left").select(group, factor.alias("factor")), group).withColumn("scaled", F.col(weight) * F.col("factor"))


def demographics(cells: DataFrame, weight: str, shares: list[tuple[str, str, float]]) -> DataFrame:
    """A row for each cell, band and sex; the last fragment takes the remainder, so each cell conserves."""
    parts = F.array(*(F.struct(F.lit(k).alias("n"), F.lit(b).alias("age_band"), F.lit(s).alias("sex_code"), F.lit(p).alias("share")) for k, (b, s, p) in enumerate(shares)))
    last = len(shares) - 1
    before = sum((F.bround(F.col(weight) * p, 6) for _, _, p in shares[:-1]), F.lit(0.0))
    rows = cells.withColumn("part", F.explode(parts)).select(*cells.columns, "part.*")
    return rows.withColumn("weight", F.when(F.col("n") < last, F.bround(F.col(weight) * F.col("share"), 6)).otherwise(F.col(weight) - before)).drop("share")


def totals(persons: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Counts and weights by each of keys, in one grouping-sets pass."""
    rows = persons.select(F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), F.col(k).cast("string").alias("value")) for k in keys))).alias("d"), weight)
    return rows.groupBy("d.dimension", "d.value").agg(F.count("*").alias("n"), F.sum(weight).alias("weight"))


def quantiles(rows: DataFrame, keys: list[str], value: str, weight: str, at: list[float]) -> DataFrame:
    """Weighted inverse-ECDF quantiles by decimals: the least value whose running weight reaches q of all.

    Values are summed first, so the running sum is over distinct values of a key.
    """
    w = rows.groupBy(*keys, value).agg(F.sum(F.col(weight).cast("decimal(38,12)")).alias("_w"))
    run = Window.partitionBy(*keys).orderBy(value)
    w = w.withColumn("_run", F.sum("_w").over(run)).withColumn("_all", F.sum("_w").over(Window.partitionBy(*keys)))
    return w.groupBy(*keys).agg(*(F.min(F.when(F.col("_run") >= F.col("_all") * F.lit(q).cast("decimal(6,4)"), F.col(value))).alias(f"q{round(q * 100)}") for q in at))


def shares(rows: DataFrame, key: str, weight: str) -> DataFrame:
    """Count, weight and share of all weight by key."""
    g = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(weight).alias("weight"))
    return g.withColumn("share", V.ratio(F.col("weight"), F.sum("weight").over(Window.partitionBy())))


def ranked(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def admitted(people: DataFrame, key: str, order: str, weight: str, capacity: str) -> DataFrame:
    """How many of each row's whole people a destination takes, in order, by running sums."""
    n = F.greatest(F.bround(F.col(weight)), F.lit(1.0))
    before = F.coalesce(F.sum("people").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return people.withColumn("people", n).withColumn("taken", F.least(F.col("people"), F.greatest(F.col(capacity) - before, F.lit(0.0))))


def trips(activities: DataFrame, person: str, start: str, end: str, tie: str) -> DataFrame:
    """Consecutive activities of a person as trips."""
    w = Window.partitionBy(person).orderBy(start, tie)
    t = activities.withColumns({"origin": F.lag("purpose").over(w), "depart_s": F.lag(end).over(w), "seq": F.row_number().over(w) - 1})
    return t.where(F.col("origin").isNotNull()).select(person, "seq", "origin", F.col("purpose").alias("dest"), "depart_s", F.col(start).alias("arrive_s"))


def presence(activities: DataFrame, person: str, place: str, start: str, end: str, weight: str, step: int, tie: str) -> DataFrame:
    """Weight present by place and step; of a person's activities at a step the last counts."""
    steps = F.sequence((F.ceil(F.col(start) / step) * step).cast("long"), F.greatest(F.floor((F.col(end) - 1) / step) * step, F.ceil(F.col(start) / step) * step).cast("long"), F.lit(step).cast("long"))
    rows = activities.withColumn("time_s", F.explode(steps)).where((F.col("time_s") >= F.col(start)) & (F.col("time_s") < F.col(end)))
    one = rows.groupBy(person, "time_s").agg(F.max_by(F.struct(place, weight), F.struct(start, tie)).alias("last"))
    return one.groupBy("last." + place, "time_s").agg(F.sum("last." + weight).alias("total"), F.count("*").alias("people"))


def serialised(activities: DataFrame, person: str, start: str, end: str, tie: str, horizon: int = 86_400) -> DataFrame:
    """Each person's activities one after another: a later one starts when the one before ends; home fills the gaps."""
    items = F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(tie).alias("k"), F.col(end).alias("e"), F.col("purpose").alias("p"))))
    kind = "struct<at:bigint,out:array<struct<s:bigint,e:bigint,p:string>>>"
    piece = lambda s, e, p: F.array(F.struct(s.cast("long").alias("s"), e.cast("long").alias("e"), p.cast("string").alias("p")))
    none = F.array().cast("array<struct<s:bigint,e:bigint,p:string>>")

    def add(state, x):
        begin, stop = F.greatest(state["at"], x["s"]), F.least(x["e"], F.lit(horizon))
        gap = F.when(x["s"] > state["at"], piece(state["at"], F.least(x["s"], F.lit(horizon)), F.lit("home"))).otherwise(none)
        body = F.when(stop > begin, piece(begin, stop, x["p"])).otherwise(none)
        return F.struct(F.greatest(state["at"], F.least(F.greatest(x["e"], x["s"]), F.lit(horizon))).alias("at"), F.concat(state["out"], gap, body).alias("out")).cast(kind)

    day = activities.groupBy(person).agg(items.alias("items"))
    folded = day.select(person, F.aggregate("items", F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")).cast(kind), add).alias("f"))
    rest = F.when(F.col("f.at") < horizon, piece(F.col("f.at"), F.lit(horizon), F.lit("home"))).otherwise(none)
    return folded.select(person, F.posexplode(F.concat("f.out", rest)).alias("seq", "x")).select(person, "seq", F.col("x.s").alias("start_s"), F.col("x.e").alias("end_s"), F.col("x.p").alias("purpose"))


def auc(rows: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve by key, ties half; label 1 or 0, others left out. Null if a class is missing."""
    return auc_of(rows.where(F.col(label).isin(0, 1)).select(*keys, score, F.col(label).cast("double").alias("pos"), (1 - F.col(label)).cast("double").alias("neg")), keys, score)


def auc_of(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """The same of rows (keys, score, pos, neg) that count labels."""
    g = rows.groupBy(*keys, score).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    w = Window.partitionBy(*keys).orderBy(score)
    g = g.withColumn("below", F.sum("neg").over(w) - F.col("neg"))
    return g.groupBy(*keys).agg(V.ratio(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def toc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Hits and false alarms at each threshold, from the highest score down; running sums over distinct scores."""
    g = rows.where(F.col(label).isin(0, 1)).groupBy(score).agg(F.sum(F.col(label)).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    w = Window.orderBy(F.col(score).desc())
    return g.select(score, F.sum("pos").over(w).alias("hits"), F.sum("neg").over(w).alias("false_alarms"))


def contingency(rows: DataFrame, declared: Column, observed: Column) -> DataFrame:
    """Hits, misses, false alarms, and hit rate, false-alarm ratio, CSI, chance CSI and bias."""
    c = rows.agg(*(F.count_if(x).alias(n) for n, x in (("hits", declared & observed), ("misses", ~declared & observed), ("false_alarms", declared & ~observed), ("rest", ~declared & ~observed))))
    h, m, f, n = F.col("hits"), F.col("misses"), F.col("false_alarms"), F.col("hits") + F.col("misses") + F.col("false_alarms") + F.col("rest")
    chance = V.ratio((h + m) * (h + f), n)
    return c.withColumns({"hit_rate": V.ratio(h, h + m), "far": V.ratio(f, h + f), "csi": V.ratio(h, h + m + f), "csi_random": V.ratio(chance, h + m + h + f - chance), "bias": V.ratio(h + f, h + m)})


def sides(rows: DataFrame) -> tuple[int, int, int, int]:
    """Least bi and bj of blocks, and the sides of the grid between the least and the greatest; 0 without blocks."""
    r = rows.agg(F.min("bi").alias("i"), F.min("bj").alias("j"), (F.max("bi") - F.min("bi") + 1).alias("nx"), (F.max("bj") - F.min("bj") + 1).alias("ny")).first()
    return r.i or 0, r.j or 0, r.nx or 0, r.ny or 0


def shift_null(blocks: DataFrame, score: str, label: str, n: int = 999, seed: int = 1) -> DataFrame:
    """One row: the AUC of blocks (bi, bj) and its null of up to n shifts of the labels round the grid's torus; scores stay.

    Shifts (di, dj) are drawn without repetition from all but the zero shift, by hashes of seed. A shifted label counts where it
    lands on an evaluated block (label 0 or 1). Shifts that leave a class out are undefined. k shifts reach the
    observed AUC: p_ge_observed = (1 + k) / (1 + defined shifts), share_ge_observed = k / defined shifts. Both and auc are null if the observed
    AUC is undefined or no shift is defined. Also the ranges of prevalence and of the evaluated blocks over the defined shifts.

    The grid is cut into strips along its longer side. A task meets the scores of one strip with the labels of another and counts
    labels by score for each shift that brings them together, so no rows of single blocks and shifts are written.
    """
    i0, j0, nx, ny = sides(blocks)
    known = held(blocks.where(F.col(label).isin(0, 1)).select((F.col("bi") - i0).alias("i"), (F.col("bj") - j0).alias("j"), F.col(score).alias("score"), F.col(label).alias("label")))
    draws = blocks.sparkSession.range(1, max(nx * ny, 1)).orderBy(V.uniform(seed, "shift", F.col("id")), "id").limit(n)
    draws = [(r.id, r.id // max(ny, 1), r.id % max(ny, 1)) for r in draws.collect()]  # n of them
    axis, side, step = ("j", ny, 2) if ny >= nx else ("i", nx, 1)
    strips = max(1, min(side, max(8, -(-known.count() // 1_000_000))))
    width = -(-max(side, 1) // strips)
    here, each = F.floor(F.col(axis) / width).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(strips - 1)))

    def counts(scored: pa.Table, labelled: pa.Table) -> pa.Table:
        parts = []
        if len(scored) and len(labelled):
            at = scored["i"].to_numpy() * ny + scored["j"].to_numpy()
            order = np.argsort(at, kind="stable")
            at, codes = at[order], scored["score"].combine_chunks().dictionary_encode(null_encoding="encode")
            names, codes = codes.dictionary, codes.indices.to_numpy()[order]
            i, j, label = (labelled[c].to_numpy() for c in ("i", "j", "label"))
            to, of = scored["to"][0].as_py() * width, scored["of"][0].as_py() * width
            for draw in draws:
                gap = (of + draw[step] - to) % side
                if width <= gap <= side - width:
                    continue
                moved = (i + draw[1]) % nx * ny + (j + draw[2]) % ny
                first = np.searchsorted(at, moved)
                n = np.searchsorted(at, moved, "right") - first
                met = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                both, pos = (np.bincount(codes[met], weights=v, minlength=len(names)) for v in (None, np.repeat(label, n)))
                some = np.flatnonzero(both)
                parts.append(pa.table({"shift": pa.array(np.full(len(some), draw[0])), "score": names.take(pa.array(some)), "pos": pos[some].astype(float), "neg": (both - pos)[some].astype(float)}))
        return pa.concat_tables(parts) if parts else pa.table({c: pa.array([], t) for c, t in (("shift", pa.int64()), ("score", scored.schema.field("score").type if len(scored) else kind), ("pos", pa.float64()), ("neg", pa.float64()))})

    kind = known.select("score").limit(0).toArrow().schema.field("score").type
    at = lambda *names: known.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), *names)
    pairs = at("score", here.alias("to"), each.alias("of")).groupBy("to", "of").cogroup(at(F.col("label").cast("long").alias("label"), here.alias("of"), each.alias("to")).groupBy("to", "of"))
    null = auc_of(pairs.applyInArrow(counts, f"shift long, score {known.schema['score'].dataType.simpleString()}, pos double, neg double"), ["shift"], "score").where("auc is not null")
    observed = auc(known.withColumn("one", F.lit(1)), ["one"], "score", "label").select(F.col("auc").alias("observed"))
    all_ = F.col("n_pos") + F.col("n_neg")
    of = null.crossJoin(F.broadcast(observed)).agg(
        F.count("*").alias("defined"), F.count_if(F.col("auc") >= F.col("observed") - 1e-12).alias("k"),
        F.min(F.col("n_pos") / all_).alias("prevalence_low"), F.max(F.col("n_pos") / all_).alias("prevalence_high"), F.min(all_.cast("long")).alias("evaluable_low"), F.max(all_.cast("long")).alias("evaluable_high"))
    able = (F.col("defined") > 0) & F.col("auc").isNotNull()
    return of.crossJoin(observed.agg(F.max("observed").alias("auc"))).select(
        "auc", F.lit(seed).alias("seed"), F.lit(len(draws)).cast("long").alias("n"), (F.lit(len(draws)) - F.col("defined")).alias("n_undefined"),
        F.when(able, (1 + F.col("k")) / (1 + F.col("defined"))).alias("p_ge_observed"), F.when(able, V.ratio(F.col("k"), F.col("defined"))).alias("share_ge_observed"),
        "prevalence_low", "prevalence_high", "evaluable_low", "evaluable_high")


def correlogram(rows: DataFrame, value: str, least: int = 30, level: float = 0.05) -> DataFrame:
    """Correlation of neighbours at each lag along both axes, from 1 to half the shorter side of the grid, with the number of pairs.

    corr is null below least pairs. range_lag, the same in all rows: the first lag whose corr is at or below level; null if none is.
    """
    _, _, nx, ny = sides(rows)
    lags = rows.sparkSession.range(1, min(nx, ny) // 2 + 1).select(F.col("id").alias("lag"))
    a = rows.where(F.col(value).isNotNull()).select("bi", "bj", F.col(value).alias("v"))
    steps = lags.select("lag", F.explode(F.array(*(F.struct((F.col("lag") * d).alias("di"), (F.col("lag") * (1 - d)).alias("dj")) for d in (0, 1)))).alias("s"))
    b = a.crossJoin(F.broadcast(steps)).select((F.col("bi") + F.col("s.di")).alias("bi"), (F.col("bj") + F.col("s.dj")).alias("bj"), "lag", F.col("v").alias("w"))
    found = a.join(b, ["bi", "bj"]).groupBy("lag").agg(F.count("*").alias("pairs"), F.corr("v", "w").alias("corr"))
    out = lags.join(found, "lag", "left").select("lag", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.when(F.col("pairs") >= least, F.when(~F.isnan("corr"), F.col("corr"))).alias("corr"))
    return out.crossJoin(F.broadcast(out.agg(F.min(F.when(F.col("corr") <= level, F.col("lag"))).alias("range_lag"))))


def least_share(rows: DataFrame, draw: str, key: str, share: float, size: int = 10_000) -> DataFrame:
    """The share of rows of least draw, in [0, 1), ties by key. Draws are counted in bins of about size rows; bins below the
    last one needed are kept whole, and only that one is put in order.
    """
    total = rows.count()
    bins = max(1, -(-total // size))
    at = F.floor(F.col(draw) * bins)
    left, edge = int(total * share + 0.5), -1
    for r in sorted(rows.groupBy(at.alias("at")).count().collect(), key=lambda r: r["at"]):  # a number for each size rows
        edge = r["at"]
        if r["count"] >= left:
            break
        left -= r["count"]
    return rows.where(at < edge).unionByName(rows.where(at == edge).orderBy(draw, key).limit(left))


def window_tally(readings: DataFrame, schedule: DataFrame, key: str, value: str, inside: Column) -> DataFrame:
    """Readings that arrived in a window for each scheduled id: count, max, sum; none counts 0."""
    got = readings.where(inside & F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("arrived"), F.max(value).alias("peak"), F.sum(value).alias("total"))
    return schedule.join(got, key, "left").withColumn("arrived", F.coalesce("arrived", F.lit(0)))


def sensor_label(tally: DataFrame, wet: float = 0.15) -> DataFrame:
    """wet at a reading of wet metres or more; dry if at least nine of ten readings arrived; else unknown."""
    return tally.withColumn("label", F.when(F.col("peak") >= wet, "wet").when(F.col("arrived") * 10 >= F.col("scheduled") * 9, "dry").otherwise("unknown"))


def idw(points: DataFrame, gauges: DataFrame, power: int = 2, size: int = 16_384) -> DataFrame:
    """points with rain, the inverse-distance mean of all complete gauges (x, y, total); gauges at a point win.

    Points and gauges are dealt by hashes to groups of about size rows. Each pair of groups gives its points partial sums,
    which are added by point: no task holds more than two groups, however many gauges there are. A gauge without place
    or total is left out; a point without place, or with no gauge to weigh, has null rain. Rows that repeat a point count once.
    """
    whole = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    points = points.distinct()
    gauges = gauges.select(*(F.col(c).cast("double").alias(c) for c in ("x", "y", "total"))).where(whole("x") & whole("y") & whole("total"))
    n_p, n_g = (max(1, -(-df.count() // size)) for df in (points, gauges))
    deal = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    p = points.withColumn("_p", deal(points, n_p)).withColumn("_g", each(n_g))
    g = gauges.withColumn("_g", deal(gauges, n_g)).withColumn("_p", each(n_p))

    def sums(at, of):
        x, y = (at.column(c).cast("double").to_numpy(zero_copy_only=False) for c in ("x", "y"))
        order = of.sort_by([("x", "ascending"), ("y", "ascending"), ("total", "ascending")])
        gx, gy, total = (order.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "total"))
        got = np.zeros((4, len(at)))
        # blocks of pairs that fit in a core's cache
        for i in range(0, len(at), 16):
            for j in range(0, len(of), 2048):
                p, g = slice(i, i + 16), slice(j, j + 2048)
                d2 = (x[p, None] - gx[g]) ** 2 + (y[p, None] - gy[g]) ** 2
                if d2.min() > 1e-12:
                    w = 1 / d2 if power == 2 else d2 ** (-power / 2)
                else:  # some gauge is at a point, or a point has no place
                    on = d2 <= 1e-12
                    w = np.where(d2 > 1e-12, 1 / np.where(d2 > 1e-12, d2, 1.0) ** (power / 2), 0.0)
                    got[2, p] += on.sum(axis=1)
                    got[3, p] += on @ total[g]
                got[0, p] += w.sum(axis=1)
                got[1, p] += w @ total[g]
        out = at.drop_columns(["_p", "_g"])
        for name, v in zip(("_w", "_wt", "_n", "_nt"), got, strict=True):
            out = out.append_column(name, pa.array(v, pa.float64()))
        return out

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema] + [f"{c} double" for c in ("_w", "_wt", "_n", "_nt")])
    parts = p.groupBy("_p", "_g").cogroup(g.groupBy("_p", "_g")).applyInArrow(sums, schema)
    rain = F.coalesce(V.ratio(F.sum("_nt"), F.sum("_n")), V.ratio(F.sum("_wt"), F.sum("_w")))
    return parts.groupBy(*points.columns).agg(rain.alias("rain"))


def nearest(points: DataFrame, others: DataFrame, size: float, point_id: str, other_id: str) -> DataFrame:
    """Each point's nearest other within size metres, else null; ties by id. Points meet others in 3 x 3 buckets of that size."""
    cell = lambda c: F.floor(F.col(c) / size)
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    o = others.select(F.col(other_id).alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), near.alias("n")).select("other", "ox", "oy", (F.floor(F.col("ox") / size) + F.col("n.i")).alias("bx"), (F.floor(F.col("oy") / size) + F.col("n.j")).alias("by"))
    p = points.withColumns({"bx": cell("x"), "by": cell("y")})
    j = p.join(o.hint("merge"), ["bx", "by"], "left").withColumn("d", F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")))
    best = j.groupBy(point_id).agg(F.min(F.when(F.col("d") <= size, F.struct("d", "other"))).alias("b"))
    return best.select(point_id, F.col("b.other").alias("other"), F.col("b.d").alias("d"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, since: str, value: str, step: int) -> DataFrame:
    """left with the value of the latest right row at or before it, by key; right rows come at most step apart.

    A merge of both sides by key and time: the last value carried forward in one window.
    """
    both = left.select(*left.columns, F.col(at).alias("_t"), F.lit(1).alias("_o"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast(right.schema[since].dataType).alias("_s"))
    both = both.unionByName(right.select(key, F.col(since).alias("_t"), F.lit(0).alias("_o"), F.col(value).alias("_v"), F.col(since).alias("_s")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns({value: F.last("_v", True).over(w), since: F.last("_s", True).over(w)}).where("_o = 1").drop("_t", "_o", "_v", "_s")


def movement(edges: DataFrame, states: DataFrame) -> DataFrame:
    """Road kilometres by mode and state at one time: open, slowed, closed, unknown; edges (edge_id, mode, length_m)."""
    s = states.select("edge_id", "mode", V.road_state(F.col("closed"), F.col("speed_multiplier")).alias("state"))
    j = edges.join(s, ["edge_id", "mode"], "left").withColumn("state", F.coalesce("state", F.lit("unknown")))
    g = j.groupBy("mode", "state").agg(F.sum("length_m").alias("m"))
    return g.select("mode", "state", F.round(F.col("m") / 1000, 6).alias("km"), F.round(V.ratio(F.col("m"), F.sum("m").over(Window.partitionBy("mode"))), 6).alias("share"))


def edge_states(edges: DataFrame, times: DataFrame, thresholds: dict[int, tuple[float, float, float, float]]) -> DataFrame:
    """State of each edge, time and mode from its greatest depth: thresholds are those of speed_factor by mode."""
    modes = F.explode(F.array(*(F.lit(m) for m in thresholds))).alias("mode")
    # times of a scenario are steps of one flood; as one array they go to every edge, whatever their number
    steps = times.agg(F.sort_array(F.collect_list(F.struct(*times.columns)))).scalar()
    e = edges.select("*", modes).withColumn("_t", F.explode(steps)).select(*edges.columns, "mode", "_t.*").withColumn("depth_m", F.col("max_depth_m") * F.col("multiplier"))
    factor = F.lit(None).cast("double")
    closing = F.lit(None).cast("double")
    for m, t in thresholds.items():
        factor = F.when(F.col("mode") == m, V.speed_factor(F.col("depth_m"), *t)).otherwise(factor)
        closing = F.when(F.col("mode") == m, t[2]).otherwise(closing)
    e = e.withColumn("speed_multiplier", factor).withColumn("closed", F.col("depth_m") >= closing)
    return e.withColumn("reason", F.when(F.col("closed"), "depth_at_or_above_closing").when(F.col("speed_multiplier") < 1, "depth_slows").otherwise("dry"))


def check(rows: DataFrame, check_id: str, observed: Column, threshold: float = 0.0) -> DataFrame:
    """One row: check_id, threshold, observed, passed; nothing observed counts 0."""
    o = rows.agg(F.coalesce(observed.cast("double"), F.lit(0.0)).alias("observed"))
    return o.select(F.lit(check_id).alias("check_id"), F.lit(float(threshold)).alias("threshold"), F.round("observed", 6).alias("observed"), (F.col("observed") <= threshold).alias("passed"))


def distances(edges: DataFrame, sources: DataFrame, cutoff: float, per_job: int = 4) -> DataFrame:
    """(source, node, cost): least cost from each of sources (source, node) along both directions of edges (u, v, cost).

    Edges with an edge_id also give prev_edge, the edge by which the node is reached (null at the source; of ties the least id).
    Frontier relaxation: only nodes whose cost fell go on, several steps a job, until none falls, the state checkpointed
    in the shared folder. Costs must not be negative.
    """
    named = "edge_id" in edges.columns
    edges = edges if named else edges.withColumn("edge_id", F.lit(None).cast("string"))
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("to"), "cost", "edge_id").unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("to"), "cost", "edge_id"))
    both = held(both.groupBy("node", "to").agg(F.min(F.struct("cost", "edge_id")).alias("s")).select("node", "to", "s.*"))
    best = held(sources.select("source", "node", F.lit(0.0).alias("cost"), F.lit(None).cast(edges.schema["edge_id"].dataType).alias("prev_edge"), F.lit(True).alias("fresh")))
    while True:
        for _ in range(per_job):
            moved = best.where("fresh").alias("a").join(both.alias("b"), "node").select("a.source", F.col("b.to").alias("node"), (F.col("a.cost") + F.col("b.cost")).alias("cost"), F.col("b.edge_id").alias("prev_edge"), F.lit(True).alias("fresh")).where(F.col("cost") <= cutoff)
            all_ = best.withColumn("old", F.col("cost")).withColumn("fresh", F.lit(False)).unionByName(moved.withColumn("old", F.lit(None).cast("double")))
            best = all_.groupBy("source", "node").agg(F.min(F.struct("cost", "prev_edge")).alias("s"), F.min("old").alias("old")).select("source", "node", "s.*", "old")
            best = best.select("source", "node", "cost", "prev_edge", (F.col("old").isNull() | (F.col("cost") < F.col("old"))).alias("fresh"))
        best = held(best)
        if best.where("fresh").isEmpty():
            break
    return best.select("source", "node", "cost", *(["prev_edge"] if named else []))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): least node reached along edges (u, v), by minimum labels and jumps to the label's own label."""
    both = held(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = held(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.min("u")).alias("component")))
    while True:
        near = both.join(label, both.v == label.node).groupBy("u").agg(F.min("component").alias("c"))
        new = label.join(near.withColumnRenamed("u", "node"), "node").select("node", F.least("component", "c").alias("component"), F.col("component").alias("old"))
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("c2"))
        new = held(new.join(jump, "component", "left").select("node", F.least("component", F.coalesce("c2", "component")).alias("component"), "old"))
        label = new.select("node", "component")
        if new.where("component != old").isEmpty():
            return label


def largest_component(edges: DataFrame) -> DataFrame:
    """(node, component, size, largest) of edges (u, v): largest is the component of most nodes, of equal ones that of the least node."""
    of = held(components(edges))
    sizes = of.groupBy("component").agg(F.count("*").alias("size"))
    top = sizes.agg(F.min_by("component", F.struct(-F.col("size"), "component"))).scalar()
    return of.join(sizes, "component").select("node", "component", "size", (F.col("component") == top).alias("largest"))


def ordered_digest(rows: DataFrame, key: str, *values: str, bits: int = 12) -> DataFrame:
    """One row (rows, digest) of rows in the order of key (a non-negative number, 48 bits) with their values, whatever their partitions.

    Row hashes are joined in order by runs of 2^bits keys, run digests by runs of 2^bits runs, and so on, so no group holds more
    than that many (where keys repeat: more, ties by hash).
    """
    at = rows.select(F.col(key).cast("long").alias("k"), F.sha2(F.concat_ws("|", F.col(key).cast("string"), *(F.col(v).cast("string") for v in values)), 256).alias("h"))
    n = rows.agg(F.count("*")).scalar()
    for _ in range(48 // bits):
        at = at.groupBy(F.shiftright("k", bits).alias("k")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    return at.select(n.alias("rows"), F.col("h").alias("digest"))


def denominators(parts: dict[str, DataFrame], whole: str, key: str, weight: str) -> DataFrame:
    """(name, n, weight, share, holds) of named populations (key, weight): share of the whole's weight; holds: a part of it that weighs no more."""
    named = None
    for name, rows in parts.items():
        one = rows.select(F.lit(name).alias("name"), key, weight)
        named = one if named is None else named.unionByName(one)
    known = parts[whole].select(F.col(key).alias("_k")).distinct()
    judged = named.join(known, F.col(key) == F.col("_k"), "left")
    total = parts[whole].agg(F.sum(weight)).scalar()
    g = judged.groupBy("name").agg(F.count("*").alias("n"), F.sum(weight).alias(weight), F.count_if(F.col("_k").isNull()).alias("_out"))
    return g.select("name", "n", weight, V.ratio(F.col(weight), total).alias("share"), ((F.col("_out") == 0) & (F.col(weight) <= total)).alias("holds"))


def page(rows: DataFrame, key: str, after, n: int) -> DataFrame:
    """The first n of rows whose key is beyond after, in order, each with next_after, the last one's key; null if the page is the last."""
    ahead = held(rows.where(F.col(key) > F.lit(after)).orderBy(key).limit(n + 1))
    last = ahead.agg(F.when(F.count("*") > n, F.get(F.sort_array(F.collect_list(key)), F.lit(n - 1)))).scalar()  # of n + 1 rows
    return ahead.orderBy(key).limit(n).withColumn("next_after", last)


def common(a: DataFrame, b: DataFrame, layer: str) -> DataFrame:
    """(layer, k): the keys that both have; one row without a key where none is common."""
    both = held(a.intersect(b))
    none = a.sparkSession.range(1 if both.isEmpty() else 0).select(F.lit(None).cast(both.schema["k"].dataType).alias("k"))
    return both.unionByName(none).select(F.lit(layer).alias("layer"), "k")
