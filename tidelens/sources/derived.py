"""Domain tables derived from the given ones, as SQL that Spark and DuckDB read alike."""

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events".split()

SQL = {
    "cells": """select gx, gy, 660050 + 100 * gx as x, 1510050 + 100 * gy as y, pop, gx % 5 as control_group, concat('g_', cast(gx as string), '_', cast(gy as string)) as cell_id
        from (select c_custkey % 40 as gx, cast(floor(c_custkey / 40) as bigint) % 40 as gy, round(sum(abs(c_acctbal) / cast(100 as double)), 6) as pop from {customer} group by 1, 2)""",
    "persons": """select concat('p_', lpad(cast(c_custkey as string), 8, '0')) as person_id, c_custkey as k, cast(1 + c_custkey % 7 as double) as weight, c_mktsegment as mobility_profile,
        case when c_custkey % 3 = 0 then '0-14' when c_custkey % 3 = 1 then '15-64' else '65+' end as age_band, case when c_custkey % 2 = 0 then 'F' else 'M' end as sex_code,
        concat('g_', cast(c_custkey % 40 as string), '_', cast(cast(floor(c_custkey / 40) as bigint) % 40 as string)) as home_cell_id,
        100.5 + (c_custkey % 40) * 0.001e0 as lon, 13.7 + (cast(floor(c_custkey / 40) as bigint) % 40) * 0.001e0 as lat from {customer}""",
    "activities": """select user_id, event_id, event_type as purpose, cast(extract(hour from ts) * 3600 + extract(minute from ts) * 60 + floor(extract(second from ts)) as bigint) as start_s,
        cast(extract(hour from ts) * 3600 + extract(minute from ts) * 60 + floor(extract(second from ts)) as bigint) + 60 * (1 + event_id % 200) as end_s, cast(1 + user_id % 7 as double) as weight, user_id % 20 as place from {events}""",
    "edges": """select concat(e.way, cast(e.k as string)) as edge_id, e.k, e.k as u, e.v, cast(50 + e.p_size as double) as length_m, case e.k % 4 when 0 then 'residential' when 1 then 'primary' when 2 then 'footway' else 'motorway' end as highway,
        e.k % 4 <> 3 as walk_allowed, e.k % 4 <> 2 as vehicle_allowed, cast(1.25 as double) as speed_walk_mps, cast(case e.k % 4 when 0 then 5 when 1 then 10 else 20 end as double) as speed_vehicle_mps
        from (select p_partkey as k, p_size, p_partkey + 1 as v, 'r' as way from {part} where p_partkey % 50 < 49 union all select p_partkey, p_size, p_partkey + 50, 'u' from {part}) e
        join (select p_partkey as to_k from {part}) n on n.to_k = e.v""",
    "times": "select 64800 as time_s, cast(0.5 as double) as multiplier union all select 68400, cast(1 as double) union all select 72000, cast(0.5 as double)",
    "slices": """select concat('c', cast(p_partkey as string)) as cell_id, cast(50 * (p_partkey % 50) as double) as x, 50 * floor(p_partkey / 50) as y, t.time_s, p_size / cast(100 as double) * t.multiplier as depth_m,
        p_size / cast(100 as double) as peak_depth_m, 'scenario' as source_role from {part} cross join ({times}) t""",
    "edge_depths": "select edge_id, length_m, walk_allowed, vehicle_allowed, (k * 7 % 60) / cast(100 as double) as max_depth_m from ({edges})",
    "states": """select person, outcome_id, state, reason, event_time_s, weight, dest_id from (select l_orderkey as person, concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string)) as outcome_id,
        case l_linenumber % 5 when 0 then 'arrived' when 1 then 'arrived' when 2 then 'shelter_in_place' when 3 then 'unreachable' else 'refuge_full' end as state,
        case l_linenumber % 5 when 0 then null when 1 then null when 2 then 'not_warned' when 3 then 'no_path' else 'capacity' end as reason,
        64800 + l_partkey % 7200 as event_time_s, l_quantity as weight, l_suppkey as dest_id from {lineitem})""",
    "blocks": """select p_partkey % 50 as bi, cast(floor(p_partkey / 50) as bigint) as bj, cast(p_size as double) as score, cast(p_size as double) + p_partkey % 11 as score_b, case p_partkey % 3 when 0 then 1 when 1 then 0 else -1 end as label from {part}""",
    "gauges": "select s_suppkey as gauge_id, cast(500 * (s_suppkey % 10) as double) as x, 500 * floor(s_suppkey / 10) as y, abs(s_acctbal) / cast(100 as double) as total from {supplier}",
    "readings": "select user_id as sensor_id, ts, case when event_id % 11 = 0 then null else value / cast(1000 as double) end as depth_m, event_id from {events}",
    "schedule": "select user_id as sensor_id, count(*) + user_id % 3 as scheduled from {events} group by user_id",
    "pixels": "select 2010 + l_suppkey % 3 as year, l_orderkey % 200 as px_row, l_partkey % 200 as px_col, max(l_linenumber % 4) as code from {lineitem} group by 1, 2, 3",
    "trips": "select o_orderkey as trip_id, o_custkey as person, o_orderkey * 37 % 86400 as depart_s, case o_orderkey % 2 when 0 then 0 else 3 end as mode, o_totalprice as cost from {orders}",
    "tags": """select p_partkey as id, case p_partkey % 4 when 0 then concat(cast(p_size as string), ' ft') when 1 then concat(cast(p_size as string), '.5 m') when 2 then cast(p_size as string) else 'no' end as height_text,
        case p_partkey % 3 when 0 then cast(p_size % 30 as string) when 1 then concat(cast(p_size % 9 as string), ';2') else null end as level_text from {part}""",
    "ways": """select concat('w', cast(k as string)) as way_id, highway, cx + k * 7 % 41 as x0, cy + k * 13 % 37 as y0, cx + k * 7 % 41 + k * 17 % 160 - 60 as x1, cy + k * 13 % 37 + 3 * size - 40 as y1,
        cx + k * 7 % 41 + k * 17 % 160 - 60 + k * 29 % 140 - 80 as x2, cy + k * 13 % 37 + 3 * size - 40 + k * 31 % 120 - 30 as y2 from (select p_partkey as k, p_size as size, 60 * (p_partkey % 50) as cx, 60 * cast(floor(p_partkey / 50) as bigint) as cy,
        case p_partkey % 5 when 0 then 'residential' when 1 then 'primary' when 2 then 'footway' when 3 then 'motorway' else 'river' end as highway from {part})""",
    "wet_edges": "select e.edge_id, p.year from ({edges}) e join (select * from ({pixels}) q where code >= 2) p on p.px_row = cast(floor(e.k / 50) as bigint) % 200 and p.px_col = e.k % 50",
    "extents": """select p_partkey as id, 2010 + p_partkey % 3 as year, p_partkey % 2 = 0 as bent, cast(60 * (p_partkey % 50) + p_size % 7 as double) as x, cast(60 * floor(p_partkey / 50) + p_partkey % 11 as double) as y, cast(10 + 3 * p_size as double) as w, cast(20 + 2 * (p_partkey % 37) as double) as h from {part}""",
    "ponds": "select id, x, y, w, h from ({footprints}) f where id % 7 = 0",
    "outings": "select k, cast(100 * (k % 40) as double) as x, cast(100 * (cast(floor(k / 40) as bigint) % 40) as double) as y, cast(500 + k * 37 % 3000 as double) as preference from ({persons}) p",
    "homes": "select person_id, weight, (cast(floor(k / 40) as bigint) % 40) * 50 + k % 40 as place from ({persons}) p",
    "journeys": """select 10 * l_orderkey + l_linenumber as trip_id, l_orderkey * 37 % 86400 as depart_s, l_suppkey as origin, cast(500 * (l_suppkey % 10) as double) as ox, cast(500 * floor(l_suppkey / 10) as double) as oy,
        10 * l_partkey + l_linenumber as destination, cast(50 * (l_partkey % 50) + 20 * l_linenumber as double) as dx, cast(50 * floor(l_partkey / 50) + 130 * (l_linenumber % 3) as double) as dy from {lineitem}""",
    "carriers": "select p_partkey as id, p_partkey % 2 as dir, 100 * (p_partkey % 97) as off, p_partkey * 37 % 5000 as lo, p_partkey * 37 % 5000 + 20 + 7 * p_size as hi from {part}",
    "stretches": "select o_orderkey as id, o_orderkey % 2 as dir, 100 * (o_orderkey % 97) as off, o_orderkey * 53 % 5000 as lo, o_orderkey * 53 % 5000 + 30 + o_custkey % 90 as hi from {orders}",
    "footprints": "select p_partkey as id, cast(60 * (p_partkey % 50) as double) as x, 60 * floor(p_partkey / 50) as y, cast(5 + p_size % 40 as double) as w, cast(5 + p_partkey % 30 as double) as h, p_brand as use_class from {part}",
}


class Tables:
    """The given tables and the derived ones by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in SQL:
            names = [t for t in TABLES + list(SQL) if f"{{{t}}}" in SQL[name]]
            return self.spark.sql(re.sub(r"\(({\w+})\)", r"\1", SQL[name]), **{t: getattr(self, t) for t in names})
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def duck(text: str) -> str:
    """text with {name} for a given or derived table, as DuckDB's SQL."""
    for _ in range(4):
        for t in SQL:
            text = text.replace(f"({{{t}}})", f"({SQL[t]})").replace(f"{{{t}}}", f"({SQL[t]})")
        for t in TABLES:
            text = text.replace(f"{{{t}}}", t)
    return text
