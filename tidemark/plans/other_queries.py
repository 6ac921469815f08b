"""Queries of scalars, mapping, insights, vectors, graphs, text and relational operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import admin, graph, insight, mapping, vectors
from tidemark.plans import daily_queries
from tidemark.session import dealt
from tidemark.sources.readings import FILTERED, LAST_DAY, VALUES_OF_DAYS_SQL, daily_values, not_filtered, numeric, readings, table
from tidemark.sources.readings import READINGS_SQL as R

TARGET = "2024-01-28"
_D = f"DATE '{TARGET}'"


def _values(s, d):
    """One value a day, user and category, for the insight operators."""
    r = readings(s, d).where(not_filtered(F.col("task_id")))
    return r.groupBy("user_id", F.col("indicator").alias("category"), F.to_date("time").alias("day")).agg(F.avg(F.col("num").cast("double")).alias("value"))


_V = f"{R}, v AS (SELECT user_id, indicator AS category, CAST(time AS DATE) AS day, avg(CAST(num AS DOUBLE)) AS value FROM good GROUP BY 1, 2, 3)"


def _base(s, d):
    return insight.baselines(_values(s, d))


#: The baselines of v (user_id, category, day, value) for the SQL, day by day; dev has the days of those with 7 values.
_BASE = """o AS (SELECT *, row_number() OVER (PARTITION BY user_id, category ORDER BY day) AS r, count(*) OVER (PARTITION BY user_id, category) AS n FROM v),
sd AS (SELECT user_id, category, any_value(n) AS n, avg(value) AS m0, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS s FROM o WHERE r <= least(n, greatest(n // 3, 7)) AND n >= 3 GROUP BY 1, 2),
f AS (SELECT user_id, category, CAST(0 AS BIGINT) AS r, m0 AS mean, false AS frozen, 0 AS away, 0 AS near, s, n FROM sd
 UNION ALL SELECT user_id, category, r, CASE WHEN (NOT frozen AND z <= 2) OR (frozen AND z <= 1 AND near + 1 >= 7) THEN mean + 0.1 * (value - mean) ELSE mean END,
  CASE WHEN frozen THEN NOT (z <= 1 AND near + 1 >= 7) ELSE z > 2 AND away + 1 >= 3 END,
  CASE WHEN NOT frozen THEN CASE WHEN z > 2 THEN away + 1 ELSE 0 END WHEN z <= 1 AND near + 1 >= 7 THEN 0 ELSE away END,
  CASE WHEN frozen AND z <= 1 AND near + 1 < 7 THEN near + 1 ELSE 0 END, s, n
 FROM (SELECT f.user_id, f.category, o.r, f.mean, f.frozen, f.away, f.near, f.s, f.n, o.value, abs(o.value - f.mean) / f.s AS z FROM f JOIN o ON o.user_id = f.user_id AND o.category = f.category AND o.r = f.r + 1)),
base AS (SELECT user_id, category, n, mean, s AS sigma, frozen FROM f WHERE r = n),
dev AS (SELECT v.*, mean, sigma, (value - mean) / sigma AS z FROM v JOIN base ON base.user_id = v.user_id AND base.category = v.category WHERE n >= 7)"""
_DAYS = f"WITH RECURSIVE {VALUES_OF_DAYS_SQL}, {_BASE}"
_T = f"DATE '{LAST_DAY}'"
_BAD = "CASE category " + " ".join(f"WHEN '{c}' THEN {w}" for c, w in insight.BAD.items()) + " END"
_AMOUNT = "CASE category " + " ".join(f"WHEN '{c}' THEN {w}" for c, w in insight.SLOW.items()) + " END"


def _dev(s, d):
    return insight.scored(insight.baselines(daily_values(s, d)).where("n >= 7"))


def _rounded(df, *columns):
    """Rounded as the SQL does, which rounds the double after it is scaled; F.round(c, 6) rounds its shortest decimals, so
    41.979662499999996 goes down there and up here."""
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c) * 1e6) / 1e6)
    return df


def _trend(s, d):
    return insight.trend_findings(_dev(s, d), None, LAST_DAY)


_TREND_RULE = "(VALUES " + ", ".join(f"('{c}', {w}, {t}, {way})" for c, (w, t, way) in insight.TRENDS.items()) + ") AS rule(category, week, total, way)"
_WEEKS = f"w AS (SELECT user_id, category, CAST(floor(datediff('day', {_T} - 28, day) / 7) AS INT) AS week, avg(value) AS mean, count(*) AS n FROM v WHERE day < {_T} AND day >= {_T} - 28 GROUP BY 1, 2, 3), t AS (SELECT user_id, category, regr_slope(mean, week) AS slope, CAST(sum(n) AS BIGINT) AS n, count(*) AS weeks FROM w GROUP BY 1, 2 HAVING sum(n) >= 14 AND count(*) >= 3)"
_PATTERN = f"w AS (SELECT user_id, category, count(*) AS n, count(*) FILTER (WHERE isodow(day) < 6) AS a, count(*) FILTER (WHERE isodow(day) >= 6) AS b, avg(value) FILTER (WHERE isodow(day) < 6) AS weekdays, avg(value) FILTER (WHERE isodow(day) >= 6) AS weekends FROM v WHERE day BETWEEN {_T} - 28 AND {_T} GROUP BY 1, 2) SELECT user_id, category, n, round(weekdays, 6) AS weekdays, round(weekends, 6) AS weekends FROM w WHERE a >= 12 AND b >= 4 AND n >= 20 AND abs(weekdays - weekends) >= 0.3 * greatest(weekdays, weekends)"


def _units(s, d):
    r = readings(s, d).where("indicator in ('bloodGlucoses', 'steps')").select("event_id", "indicator", F.col("num").cast("double").alias("value"), F.when(F.col("indicator") == "bloodGlucoses", "mmol/L").when(F.col("event_id") % 3 == 0, "km").when(F.col("event_id") % 3 == 1, "degF").otherwise("weird").alias("unit"), F.when(F.col("indicator") == "bloodGlucoses", "mg/dL").when(F.col("event_id") % 3 == 1, "degC").otherwise("ft").alias("to_unit"))
    return scalars.convert(r).select("event_id", "unit", "to_unit", F.round("converted", 6).alias("converted"), "ok")


def _names(s, d):
    n = readings(s, d).select(F.concat(F.lit("dailyAvg"), F.upper(F.substring("indicator", 1, 1)), F.substring("indicator", 2, 99), F.lit("."), "source").alias("name")).distinct()
    return n.select("name", scalars.base_name(F.col("name")).alias("base"), scalars.base_indicator(F.col("name")).alias("indicator"))


def _ranges(s, d):
    start, end = scalars.calendar_range(F.col("name"), F.col("time"))
    r = readings(s, d).withColumn("name", F.element_at(F.array(F.lit("dailyX"), F.lit("weeklyX"), F.lit("hourlyX"), F.lit("x")), (F.col("event_id") % 4 + 1).cast("int")))
    return r.select("event_id", "name", start.alias("start_time"), end.alias("end_time"))


def _mapped(s, d):
    """Line items as rows to be mapped: the part's name of an indicator, the supplier's nation its code."""
    li = table(s, d, "lineitem").select("l_partkey", "l_suppkey").join(table(s, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return li.select((F.col("l_partkey") % 50).cast("string").alias("name"), F.when(F.col("l_partkey") % 50 % 3 == 0, F.lit(7)).when(F.col("l_suppkey") % 4 == 0, F.col("s_nationkey")).alias("id"))


_M = "m AS (SELECT CAST(l_partkey % 50 AS VARCHAR) AS name, CASE WHEN l_partkey % 50 % 3 = 0 THEN 7 WHEN l_suppkey % 4 = 0 THEN s_nationkey END AS id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"


def _unique(s, d):
    return mapping.unique_codes(_mapped(s, d).where("id is not null")).withColumn("id", F.col("id").cast("int"))


def _backfilled(s, d):
    rows = _mapped(s, d).select(F.concat("name", F.lit(".x")).alias("indicator"), F.col("id").cast("int").alias("fhir_id"))
    out = mapping.backfill(rows, mapping.history_dictionary(rows))
    return out.groupBy("indicator").agg(F.count("*").alias("n"), F.count("fhir_id").alias("mapped"))


def _upserted(s, d):
    o = table(s, d, "orders")
    old = o.where("o_orderkey % 3 <> 0").select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(1).alias("stamp"))
    new = o.where("o_orderkey % 2 = 0 or o_orderkey % 3 = 0").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"), F.lit(2).alias("stamp"))
    return mapping.upsert(old, new, ["o_orderkey"], ["o_orderstatus", "o_totalprice"], stamp="stamp")


def _nearby(s, d):
    p = table(s, d, "part").select(F.substring("p_brand", 7, 9).alias("grp"), (F.col("p_retailprice") * 10).cast("long").alias("position"), F.col("p_partkey").alias("id"))
    return mapping.nearby(p, p.where("id % 100 = 0"), reach=400, top=5)


def _topk(by=None):
    def run(s, d):
        e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label"))
        q = e.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
        out = vectors.top_k(e, q, 5, by)
        return out.select("query_id", "id", F.round("score", 5).alias("score"), *([F.col("grp").alias("label")] if by else []))

    return run


_COS = "SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS c FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0"


def _derived(s, d):
    from tidemark.operators import derived

    return derived.from_readings(readings(s, d)).withColumn("source", F.lit("derived"))


def _registry_backfilled(s, d):
    codes = table(s, d, "part").select((F.col("p_partkey") % 97).cast("string").alias("code"), F.col("p_brand").alias("short_name"), (F.col("p_partkey") % 50).alias("id"))
    rows = table(s, d, "supplier").select(F.concat((F.col("s_suppkey") % 120).cast("string"), F.lit(".x")).alias("indicator"), F.lit(None).cast("long").alias("fhir_id"))
    return mapping.backfill(rows, mapping.registry_dictionary(codes)).groupBy("indicator").agg(F.count("*").alias("n"), F.count("fhir_id").alias("mapped"))


def _variants(s, d):
    return table(s, d, "part").select(F.concat(F.lit("rs"), "p_partkey").alias("rsid"), F.substring("p_brand", 7, 9).alias("chromosome"), F.col("p_size").alias("position"), F.col("p_type").alias("genotype"))


def _summary_upserted(s, d):
    o = table(s, d, "orders")
    old = o.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("fhir_id"))
    new = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") + 1).alias("v"), F.when(F.col("o_orderkey") % 5 == 0, 1).cast(old.schema["fhir_id"].dataType).alias("fhir_id"))
    return mapping.upsert(old, new, ["k"], ["v", "fhir_id"], filled=["fhir_id"])


def _asked(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return e, e.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")


def _user_search(s, d):
    e, q = _asked(s, d)
    return vectors.user_search(e, table(s, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("id")), q, 5).withColumn("score", F.round("score", 5))


def _unmapped_search(s, d):
    e, q = _asked(s, d)
    rows = table(s, d, "lineitem").select(F.col("l_partkey").alias("id"))
    return vectors.unmapped_search(rows, e, q, 0.2).withColumn("score", F.round("score", 5))


def _mapped_readings(s, d):
    return readings(s, d).withColumn("fhir_id", F.col("event_id") % 11)


def _codes(s, d):
    """Suppliers and customers as codes of two systems whose concept is a nation and balance band."""
    a = table(s, d, "supplier").select(F.concat_ws("-", "s_nationkey", F.floor(F.col("s_acctbal") / 100)).alias("cui"), F.lit("S").alias("system"), F.col("s_suppkey").cast("string").alias("code"))
    b = table(s, d, "customer").select(F.concat_ws("-", "c_nationkey", F.floor(F.col("c_acctbal") / 100)).alias("cui"), F.lit("C").alias("system"), F.col("c_custkey").cast("string").alias("code"))
    return a.union(b)


def _tokens(s, d, t, key, name):
    return table(s, d, t).select(F.col(key).cast("long").alias("id"), scalars.tokens(F.col(name), ["small", "the"]).alias("tokens"))


def _tree(s, d):
    n = table(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    c = table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    r = table(s, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("world").alias("parent"))
    return n.union(c).union(r)


_TREE = "t AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region)"


def _summary_names(s, d):
    r = readings(s, d).select("user_id", "indicator", "source")
    made = r.select("user_id", F.concat(F.lit("dailyAvg"), F.upper(F.substring("indicator", 1, 1)), F.substring("indicator", 2, 99), F.lit("."), "source").alias("indicator"))
    return r.select("user_id", "indicator").union(made).distinct()


def _grouped(s, d):
    p = table(s, d, "part").select("p_partkey", "p_brand", "p_size")
    return p.select(F.col("p_brand").alias("g"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("m")).union(p.select(F.concat(F.lit("size"), "p_size"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")))


def _edges(s, d):
    c = table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    return c.union(table(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")))


def _guarded(s, d):
    text = F.when(F.col("p_partkey") % 5 == 0, F.col("p_partkey").cast("string")).when(F.col("p_partkey") % 5 == 1, "-3.5").when(F.col("p_partkey") % 5 == 2, "1e5").when(F.col("p_partkey") % 5 == 3, F.col("p_name")).otherwise("7.")
    return table(s, d, "part").select("p_partkey", numeric(text).cast("double").alias("number"))


def _hits(s, d):
    return table(s, d, "events").select(F.col("user_id").alias("id"), (F.col("value").cast("double") / 50).alias("score"), (F.col("event_type") == "view").alias("main"))


def _grep(s, d):
    lines = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.where(F.lower("text").rlike("license|gnu")).select("doc_id", F.col("line").cast("long").alias("line"), F.length("text").cast("long").alias("n"))


def _sessions(s, d):
    c = table(s, d, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("by_user"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"), F.sum(F.length("text")).alias("chars"))


def _sets(s, d):
    c, o = table(s, d, "customer").select("c_custkey"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.subtract(o).withColumn("kind", F.lit("never ordered")).union(o.distinct().withColumn("kind", F.lit("ordered"))).union(c.intersect(o).withColumn("kind", F.lit("both")))


def _exploded(s, d):
    e = table(s, d, "documents").select("doc_id", F.explode(F.split(F.concat_ws(",", "lang", "source"), ",")).alias("tag"))
    return e.groupBy("tag").agg(F.count("*").alias("n"))


def _range_default(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate")
    rows = dealt(table(s, d, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity"), 1_000_000, "l_suppkey")
    return rows.withColumn("run", F.sum(F.col("l_quantity").cast("long")).over(w)).groupBy("l_suppkey", "l_shipdate").agg(F.max("run").alias("run"), F.min("run").alias("same"))


QUERIES = {
    "unit_conversion": (_units, f"WITH {R}, x AS (SELECT event_id, indicator, CAST(num AS DOUBLE) AS v, CASE WHEN indicator = 'bloodGlucoses' THEN 'mmol/L' WHEN event_id % 3 = 0 THEN 'km' WHEN event_id % 3 = 1 THEN 'degF' ELSE 'weird' END AS unit, CASE WHEN indicator = 'bloodGlucoses' THEN 'mg/dL' WHEN event_id % 3 = 1 THEN 'degC' ELSE 'ft' END AS to_unit FROM readings WHERE indicator IN ('bloodGlucoses', 'steps')) SELECT event_id, unit, to_unit, round(CASE unit WHEN 'mmol/L' THEN v * 18.0182 WHEN 'km' THEN v * (3.28084 / 0.001) WHEN 'degF' THEN (v - 32) * 5 / 9 ELSE v END, 6) AS converted, unit <> 'weird' AS ok FROM x"),
    "range_validation": (lambda s, d: scalars.validate(readings(s, d)).groupBy("indicator", "reason").agg(F.count("*").alias("n")), f"WITH {R} SELECT indicator, CASE WHEN indicator = 'heartRates' AND num > 350 THEN '<=350.0' WHEN indicator = 'bloodGlucoses' AND num > 600 THEN '<=600.0' WHEN indicator = 'oxygenSaturations' AND num > 100 THEN '<=100.0' WHEN indicator = 'steps' AND num > 100000 THEN '<=100000.0' WHEN indicator = 'sleepAnalysis_InBed' AND num > 86400000 THEN '<=8.64E7' END AS reason, count(*) AS n FROM readings GROUP BY 1, 2"),
    "base_names": (_names, f"WITH {R} SELECT DISTINCT 'dailyAvg' || upper(substr(indicator, 1, 1)) || substr(indicator, 2) || '.' || source AS name, 'dailyAvg' || upper(substr(indicator, 1, 1)) || substr(indicator, 2) AS base, indicator FROM readings"),
    "calendar_ranges": (_ranges, f"WITH {R}, x AS (SELECT event_id, time, CASE event_id % 4 WHEN 0 THEN 'dailyX' WHEN 1 THEN 'weeklyX' WHEN 2 THEN 'hourlyX' ELSE 'x' END AS name FROM readings) SELECT event_id, name, CASE event_id % 4 WHEN 0 THEN date_trunc('day', time) WHEN 1 THEN date_trunc('week', time) WHEN 2 THEN date_trunc('hour', time) ELSE time END AS start_time, CASE event_id % 4 WHEN 0 THEN date_trunc('day', time) + INTERVAL 86399 SECOND WHEN 1 THEN date_trunc('week', time) + INTERVAL 604799 SECOND WHEN 2 THEN date_trunc('hour', time) + INTERVAL 3599 SECOND ELSE date_trunc('second', time) END AS end_time FROM x"),
    "code_packing": (lambda s, d: table(s, d, "part").select("p_partkey", scalars.pack(F.col("p_partkey") % 8, F.col("p_partkey") * 977).alias("packed")).withColumn("system", scalars.unpack(F.col("packed"))[0]).withColumn("code", scalars.unpack(F.col("packed"))[1]).where("p_partkey % 8 < 8").select("p_partkey", "system", "code"), "SELECT p_partkey, p_partkey % 8 AS system, p_partkey * 977 AS code FROM part"),
    "unique_codes": (_unique, f"WITH {_M} SELECT name, min(id) AS id FROM m WHERE id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT id) = 1"),
    "dominant_codes": (lambda s, d: mapping.dominant(_mapped(s, d), 6).withColumn("id", F.col("id").cast("int")), f"WITH {_M}, c AS (SELECT name, id, count(*) AS n FROM m WHERE id IS NOT NULL GROUP BY 1, 2), w AS (SELECT *, CAST(sum(n) OVER (PARTITION BY name) AS BIGINT) AS total, row_number() OVER (PARTITION BY name ORDER BY n DESC, id) AS r FROM c) SELECT name, id, n, total FROM w WHERE r = 1 AND n * 100 >= 6 * total"),
    "history_backfill": (_backfilled, f"WITH {_M}, u AS (SELECT name, min(id) AS one FROM m WHERE id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT id) = 1) SELECT m.name || '.x' AS indicator, count(*) AS n, count(coalesce(id, one)) AS mapped FROM m LEFT JOIN u ON u.name = m.name GROUP BY 1"),
    "placeholder_insert": (lambda s, d: mapping.placeholders(_mapped(s, d).select(F.col("name").alias("indicator"), F.col("id").alias("fhir_id")), s.range(20).select(F.col("id").cast("string").alias("indicator"))), f"WITH {_M} SELECT DISTINCT name AS indicator FROM m WHERE id IS NULL AND CAST(name AS INT) >= 20"),
    "upsert_orders": (_upserted, "WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice, 1 AS stamp FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0) SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice, CASE WHEN n.o_orderkey IS NOT NULL AND (o.o_orderkey IS NULL OR o.o_totalprice <> n.o_totalprice) THEN 2 ELSE 1 END AS stamp FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey"),
    "nearby_positions": (_nearby, "WITH p AS (SELECT substr(p_brand, 7) AS grp, CAST(p_retailprice * 10 AS BIGINT) AS position, p_partkey AS id FROM part), j AS (SELECT a.grp, a.id, b.id AS near, abs(b.position - a.position) AS distance FROM p a JOIN p b ON a.grp = b.grp AND abs(b.position - a.position) <= 400 WHERE a.id % 100 = 0 AND b.id % 100 <> 0) SELECT grp, id, near, distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, near) AS r FROM j) WHERE r <= 5"),
    "baselines": (lambda s, d: _rounded(_base(s, d).drop("days"), "mean", "sigma"), f"WITH RECURSIVE {_V}, {_BASE} SELECT user_id, category, n, round(mean, 6) AS mean, round(sigma, 6) AS sigma, frozen FROM base"),
    "baselines_of_days": (lambda s, d: _rounded(insight.baselines(daily_values(s, d)).drop("days"), "mean", "sigma"), f"{_DAYS} SELECT user_id, category, n, round(mean, 6) AS mean, round(sigma, 6) AS sigma, frozen FROM base"),
    "insight_density": (lambda s, d: insight.density(_values(s, d), TARGET), f"WITH {_V} SELECT user_id, category, count(DISTINCT day) AS n, CASE WHEN count(DISTINCT day) >= 12 THEN 'continuous' WHEN count(DISTINCT day) >= 7 THEN 'intermittent' ELSE 'sparse' END AS density FROM v WHERE day BETWEEN {_D} - 14 AND {_D} GROUP BY 1, 2"),
    "insight_multi_signal": (lambda s, d: insight.multi_signal(_dev(s, d), LAST_DAY), f"{_DAYS}, away AS (SELECT user_id, day, count(*) AS signals, max(round(abs(z), 2)) AS peak FROM dev WHERE day BETWEEN {_T} - 9 AND {_T} AND z * {_BAD} >= 2 GROUP BY 1, 2 HAVING count(*) >= 2), i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS island FROM away), r AS (SELECT user_id, island, count(*) AS run, arg_min(signals, day) AS signals, arg_min(peak, day) AS peak, max(day) AS stop FROM i GROUP BY 1, 2 HAVING count(*) >= 3) SELECT user_id, run, signals, peak, CASE WHEN peak >= 4 OR run >= 7 THEN 'severe' WHEN peak >= 3 OR run >= 5 THEN 'moderate' ELSE 'mild' END AS severity FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY run DESC, stop DESC) AS k FROM r) WHERE k = 1"),
    "insight_single_sustained": (lambda s, d: insight.single_sustained(_dev(s, d), LAST_DAY), f"{_DAYS}, d AS (SELECT *, row_number() OVER (PARTITION BY user_id, category ORDER BY day DESC) AS r FROM dev WHERE day BETWEEN {_T} - 29 AND {_T} AND abs(z) >= CASE WHEN {_AMOUNT} IS NULL THEN 2.5 ELSE 5 END), k AS (SELECT user_id, category, count(*) AS run, avg(abs(z)) FILTER (WHERE r <= 7) AS recent, avg(abs(z)) FILTER (WHERE r BETWEEN 8 AND 14) AS earlier, round(arg_max(abs(z), r), 2) AS distance, arg_max(abs(round(value, 2) - mean), r) AS change FROM d WHERE {_T} - day = r - 1 GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY run DESC, category) AS p FROM k WHERE run >= 5 AND NOT (run > 14 AND recent <= earlier * 1.1)) SELECT user_id, category, run, distance, CASE WHEN distance >= 4 OR run >= 10 THEN 'severe' WHEN distance >= 3 OR run >= 7 THEN 'moderate' ELSE 'mild' END AS severity FROM q WHERE p = 1 AND ({_AMOUNT} IS NULL OR change >= {_AMOUNT})"),
    "insight_trend": (lambda s, d: _rounded(insight.trend(daily_values(s, d), LAST_DAY), "slope"), f"WITH {VALUES_OF_DAYS_SQL}, {_WEEKS} SELECT user_id, category, round(slope, 6) AS slope, n, weeks FROM t"),
    "insight_trend_findings": (_trend, f"{_DAYS}, {_WEEKS}, x AS (SELECT t.user_id, t.category, slope, slope * 4 AS total, abs(slope * 4) / sigma AS change FROM t JOIN base b ON b.user_id = t.user_id AND b.category = t.category JOIN {_TREND_RULE} ON rule.category = t.category WHERE b.n >= 7 AND abs(slope) >= rule.week AND abs(slope * 4) >= rule.total AND (way = 0 OR sign(slope) = way) AND abs(slope * 4) / sigma >= 1.5), y AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY change DESC, category) AS r, category IN ('weight', 'bmi', 'bodyFat', 'visceralFat') AS slow FROM x) SELECT user_id, category, round(slope, 6) AS slope, round(total, 6) AS total, round(change, 6) AS change, CASE WHEN change >= CASE WHEN slow THEN 5 ELSE 3 END THEN 'severe' WHEN change >= CASE WHEN slow THEN 3.5 ELSE 2 END THEN 'moderate' ELSE 'mild' END AS severity FROM y WHERE r = 1"),
    "insight_recovery": (lambda s, d: insight.recovery(_dev(s, d), LAST_DAY), f"{_DAYS}, d AS (SELECT *, abs(z) AS s FROM dev WHERE category = 'heartRate' AND day BETWEEN {_T} - 59 AND {_T}), top AS (SELECT user_id, day AS top_day, s AS top_s, value AS top_value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, day DESC) AS k FROM d) WHERE k = 1), e AS (SELECT d.*, top_s, top_value, row_number() OVER (PARTITION BY d.user_id ORDER BY day DESC) AS r FROM d JOIN top ON top.user_id = d.user_id WHERE day >= top_day), g AS (SELECT user_id, count(*) AS days, avg(s) FILTER (WHERE r <= 5) AS recent, avg(s) FILTER (WHERE r BETWEEN 6 AND 10) AS earlier, any_value(top_s) AS top_s, any_value(top_value) AS top_value, arg_min(s, r) AS now_s, arg_min(value, r) AS now_value, any_value(sigma) AS sigma FROM e GROUP BY 1) SELECT user_id, round(top_s, 2) AS peak, round(now_s, 2) AS now, days FROM g WHERE top_s >= 2 AND days >= 10 AND recent < earlier * 0.8 AND abs(top_value - now_value) >= 2 * sigma AND NOT (now_s < 0.5 AND top_s < 3)"),
    "insight_weekday_pattern": (lambda s, d: insight.weekday_pattern(daily_values(s, d), LAST_DAY), f"WITH {VALUES_OF_DAYS_SQL}, {_PATTERN}"),
    "insight_weekday_steps": (lambda s, d: insight.weekday_pattern(daily_values(s, d).where("category = 'steps'"), LAST_DAY), f"WITH {VALUES_OF_DAYS_SQL}, {_PATTERN} AND category = 'steps'"),
    "insight_glucose": (lambda s, d: insight.glucose(_dev(s, d), LAST_DAY), f"{_DAYS}, d AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS island FROM dev WHERE category = 'bloodGlucose' AND day > {_T} - 30 AND z >= 1.5), r AS (SELECT user_id, island, max(day) AS stop, count(*) AS length, avg(z) AS mean FROM d GROUP BY 1, 2) SELECT user_id, length, round(mean, 6) AS mean, CASE WHEN mean >= 3 THEN 'severe' WHEN mean >= 2 THEN 'moderate' ELSE 'mild' END AS severity FROM r WHERE stop = {_T} AND length >= 7"),
    "insight_tags": (lambda s, d: insight.tags(insight.baselines(daily_values(s, d))), f"{_DAYS} " + " UNION ALL ".join(f"SELECT user_id, '{t}' AS tag FROM base WHERE category = '{c}' AND mean {x} AND n >= {days}" for t, c, x, days in insight.TAGS)),
    "insight_fresh": (lambda s, d: insight.fresh_users(daily_values(s, d), LAST_DAY), f"WITH {VALUES_OF_DAYS_SQL} SELECT user_id, count(*) AS n FROM v GROUP BY 1 HAVING max(day) >= {_T} - 7"),
    "insight_categories": (lambda s, d: insight.resolve_categories(_summary_names(s, d)), f"WITH {R}, n AS (SELECT DISTINCT user_id, indicator FROM readings UNION SELECT user_id, 'dailyAvg' || upper(substr(indicator, 1, 1)) || substr(indicator, 2) || '.' || source FROM readings), a AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {i}, '{x}')" for c, names in insight.ALIASES.items() for i, x in enumerate(names)) + ") AS a(category, rank, alias)), j AS (SELECT user_id, category, indicator, row_number() OVER (PARTITION BY user_id, category ORDER BY rank, indicator <> alias, indicator) AS r FROM n JOIN a ON split_part(indicator, '.', 1) = alias) SELECT user_id, category, indicator FROM j WHERE r = 1"),
    "insight_findings": (lambda s, d: insight.findings(daily_values(s, d), LAST_DAY).withColumn("target", F.col("target").cast("string")), None),
    "active_users": (lambda s, d: readings(s, d).where(F.col("time") >= F.lit(TARGET).cast("timestamp")).select("user_id").distinct(), f"WITH {R} SELECT DISTINCT user_id FROM readings WHERE time >= TIMESTAMP '{TARGET}'"),
    "cosine_top_k": (_topk(), f"WITH c AS ({_COS}) SELECT query_id, id, round(c, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 12) DESC, id) AS r FROM c) WHERE r <= 5"),
    "resolve_per_system": (_topk("label"), f"WITH c AS ({_COS}) SELECT query_id, id, round(c, 5) AS score, CAST(label AS BIGINT) AS label FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY round(c, 12) DESC, id) AS r FROM c) WHERE r <= 5"),
    "concept_bridges": (lambda s, d: graph.bridges(_codes(s, d), "S", "C"), "SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS left_code, CAST(c_custkey AS VARCHAR) AS right_code FROM supplier JOIN customer ON s_nationkey = c_nationkey AND floor(s_acctbal / 100) = floor(c_acctbal / 100)"),
    "concept_siblings": (lambda s, d: graph.siblings(_codes(s, d).where("system = 'C'"), "cui", "code").select("cui", F.array_join("members", "|").alias("members")), "SELECT CAST(c_nationkey AS VARCHAR) || '-' || CAST(CAST(floor(c_acctbal / 100) AS BIGINT) AS VARCHAR) AS cui, string_agg(CAST(c_custkey AS VARCHAR), '|' ORDER BY CAST(c_custkey AS VARCHAR)) AS members FROM customer GROUP BY 1 HAVING count(*) >= 2"),
    "token_bridges": (lambda s, d: graph.token_bridge(_tokens(s, d, "part", "p_partkey", "p_name")), "WITH t AS (SELECT p_partkey AS id, list_filter(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')), lambda x: x NOT IN ('small', 'the')) AS k FROM part), j AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.k, b.k)) AS c, len(a.k) AS na, len(b.k) AS nb FROM t a JOIN t b ON a.id < b.id WHERE len(a.k) >= 2 AND len(b.k) >= 2) SELECT a, b, round(c / (na + nb - c), 6) AS jaccard FROM j WHERE c >= 0.5 * na AND c >= 0.5 * nb AND c > 0"),
    "taxonomy_ancestors": (lambda s, d: graph.ancestors(s, _tree(s, d)), f"WITH RECURSIVE {_TREE}, up AS (SELECT node, parent AS ancestor, 1 AS depth FROM t UNION ALL SELECT u.node, t.parent, u.depth + 1 FROM up u JOIN t ON t.node = u.ancestor) SELECT node, ancestor, depth FROM up"),
    "merged_concepts": (lambda s, d: graph.merged_concepts(_codes(s, d).withColumnRenamed("cui", "name")), "WITH c AS (SELECT s_nationkey || '-' || CAST(floor(s_acctbal / 100) AS BIGINT) AS name, 'S' AS system, CAST(s_suppkey AS VARCHAR) AS code FROM supplier UNION ALL SELECT c_nationkey || '-' || CAST(floor(c_acctbal / 100) AS BIGINT), 'C', CAST(c_custkey AS VARCHAR) FROM customer) SELECT name, string_agg(DISTINCT system || ':' || code, '|' ORDER BY system || ':' || code) AS codes, count(DISTINCT system) AS systems FROM c GROUP BY 1"),
    "text_preview": (lambda s, d: table(s, d, "documents").select("doc_id", F.md5(scalars.preview(F.col("text"), 2, 80)).alias("preview")), "WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: substr(x, 1, 80)) AS l FROM documents) SELECT doc_id, md5(CASE WHEN len(l) <= 4 THEN array_to_string(l, chr(10)) ELSE array_to_string(l[1:2], chr(10)) || chr(10) || '...' || chr(10) || array_to_string(l[len(l) - 1:len(l)], chr(10)) END) AS preview FROM l"),
    "numeric_guard": (_guarded, "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey AS DOUBLE) WHEN p_partkey % 5 = 1 THEN -3.5 WHEN p_partkey % 5 = 4 THEN 7.0 END AS number FROM part"),
    "insert_ignored": (lambda s, d: mapping.insert_ignore(table(s, d, "orders").where("o_orderkey % 3 <> 0").select("o_orderkey", F.lit("old").alias("kind")), table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("new").alias("kind")), ["o_orderkey"]), "SELECT o_orderkey, 'old' AS kind FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT DISTINCT l_orderkey, 'new' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0)"),
    "merged_rank": (lambda s, d: vectors.merged_rank(_hits(s, d)).withColumn("score", F.round("score", 6)), "WITH h AS (SELECT user_id AS id, CAST(value AS DOUBLE) / 50 AS score, event_type = 'view' AS main FROM events), b AS (SELECT id, max(score) AS score, bool_or(main) AS main FROM h GROUP BY 1), l AS (SELECT greatest(min(score) FILTER (WHERE main AND score > 0), 0.6) AS least FROM b) SELECT id, round(score, 6) AS score, main FROM b, l WHERE main OR score >= least"),
    "pruned_concepts": (lambda s, d: graph.prune_broad(table(s, d, "part").select(F.col("p_size").alias("cui"), F.col("p_name").alias("name")), "small|large"), "SELECT p_size AS cui FROM part GROUP BY 1 HAVING NOT bool_and(regexp_matches(p_name, 'small|large'))"),
    "chained_bridges": (lambda s, d: graph.chained(table(s, d, "supplier").select(F.col("s_suppkey").alias("left_code"), F.col("s_nationkey").alias("right_code")), table(s, d, "nation").select(F.col("n_nationkey").alias("left_code"), F.col("n_regionkey").alias("right_code"))), "SELECT DISTINCT s_suppkey AS left_code, n_regionkey AS right_code FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "sibling_expansion": (lambda s, d: graph.sibling_expansion(_grouped(s, d), "g", "m", 5), "WITH x AS (SELECT p_brand AS g, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS m FROM part UNION SELECT 'size' || p_size, lpad(CAST(p_partkey AS VARCHAR), 9, '0') FROM part), p AS (SELECT a.m AS a, b.m AS b, CASE WHEN count(*) >= 2 THEN 1 ELSE 2 END AS distance FROM x a JOIN x b ON a.g = b.g AND a.m <> b.m GROUP BY 1, 2) SELECT a, b, distance FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS r FROM p) WHERE r <= 5"),
    "graph_neighbours": (lambda s, d: graph.neighbours(_edges(s, d), table(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))), "WITH e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation) SELECT DISTINCT dst AS node, src AS neighbour FROM e WHERE dst LIKE 'n%' UNION SELECT src, dst FROM e WHERE src LIKE 'n%'"),
    "sibling_relations": (lambda s, d: graph.relations(_grouped(s, d).where("g like 'size%'").withColumn("label", F.lit("size")), "g", "m", "label"), "WITH x AS (SELECT p_size AS g, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS m FROM part) SELECT DISTINCT a.m AS a, b.m AS b, 'size' AS labels FROM x a JOIN x b ON a.g = b.g AND a.m < b.m"),
    "grep_lines": (_grep, "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents) SELECT doc_id, line, length(text) AS n FROM l WHERE regexp_matches(lower(text), 'license|gnu')"),
    "session_lists": (_sessions, "SELECT conv_id, count(*) AS messages, count(*) FILTER (WHERE role = 'user') AS by_user, max(turn) AS last_turn, arg_max(role, turn) AS last_role, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1"),
    "set_operations": (_sets, "SELECT c_custkey, 'never ordered' AS kind FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'ordered' FROM orders UNION ALL SELECT c_custkey, 'both' FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)"),
    "tag_distribution": (_exploded, "SELECT unnest([lang, source]) AS tag, count(*) AS n FROM documents GROUP BY 1"),
    "running_sum_peers": (_range_default, "WITH w AS (SELECT l_suppkey, l_shipdate, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate) AS BIGINT) AS run FROM lineitem) SELECT l_suppkey, l_shipdate, max(run) AS run, min(run) AS same FROM w GROUP BY 1, 2"),
    "admin_stats": (lambda s, d: admin.stats(readings(s, d), F.lit("2024-01-29").cast("timestamp")), f"WITH {R} SELECT CASE WHEN source LIKE '%apple_health%' THEN 'apple_health' WHEN source LIKE 'theta.%' THEN split_part(source, '.', 2) WHEN source LIKE '%vital%' THEN 'vital' ELSE source END AS source, indicator, count(*) AS records, max(time) AS latest FROM readings WHERE time >= TIMESTAMP '2024-01-29' - INTERVAL 60 DAY GROUP BY 1, 2"),
    "user_window": (lambda s, d: admin.window(readings(s, d), F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"), ["heartRates", "steps"], ["apple_health"]).select("user_id", "indicator", "time", "value"), f"WITH {R} SELECT user_id, indicator, time, value FROM readings WHERE time >= TIMESTAMP '2024-01-10' AND time < TIMESTAMP '2024-01-17' AND indicator IN ('heartRates', 'steps') AND source = 'apple_health'"),
    "user_sources": (lambda s, d: admin.sources(readings(s, d)), f"WITH {R} SELECT user_id, source, records, first, last FROM (SELECT user_id, source, count(*) AS records, min(time) AS first, max(time) AS last, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, source) AS r FROM readings GROUP BY 1, 2) WHERE r <= 100"),
    "agent_fetch": (lambda s, d: admin.fetch(readings(s, d), readings(s, d).where("event_id % 3 = 0").select("event_id", F.lit("0").alias("value"), (F.col("time") + F.expr("INTERVAL 1 DAY")).alias("time")), 3), f"WITH {R}, t AS (SELECT user_id, event_id, indicator, CASE WHEN event_id % 3 = 0 THEN '0' ELSE value END AS value, CASE WHEN event_id % 3 = 0 THEN time + INTERVAL 1 DAY ELSE time END AS time FROM readings) SELECT user_id, indicator, event_id, value, time FROM (SELECT *, row_number() OVER (PARTITION BY user_id, indicator ORDER BY time DESC, event_id DESC) AS r FROM t) WHERE r <= 3"),
    "workspace_stats": (lambda s, d: admin.workspace(table(s, d, "documents").select(F.col("source").alias("workspace"), "text")), "SELECT source AS workspace, count(*) AS files, count(*) FILTER (WHERE coalesce(text, '') = '') AS empty, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM documents GROUP BY 1"),
    "newest_files": (lambda s, d: admin.newest(table(s, d, "orders").select(F.col("o_custkey").alias("file_key"), F.col("o_orderdate").alias("time"), F.col("o_orderkey").alias("version"))), "SELECT file_key, time, version FROM (SELECT o_custkey AS file_key, o_orderdate AS time, o_orderkey AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1"),
    "series_quality": (lambda s, d: admin.series_quality(readings(s, d)), f"WITH {R}, q AS (SELECT indicator, source, CAST(min(num) AS DOUBLE) AS low, CAST(max(num) AS DOUBLE) AS high, count(num) AS n, count(*) FILTER (WHERE task_id = '{FILTERED}') AS filtered FROM readings WHERE source NOT IN ('chat', 'journal') GROUP BY 1, 2) SELECT *, low < 0 AS negative_value FROM q"),
    "derived_trend": (lambda s, d: admin.derived_trend(_derived(s, d)), f"SELECT CAST(day AS DATE) AS day, count(*) AS records, count(DISTINCT indicator) AS indicators FROM ({daily_queries.QUERIES['derived_indicators'][1]}) GROUP BY 1"),
    "registry_backfill": (_registry_backfilled, "WITH c AS (SELECT CAST(p_partkey % 97 AS VARCHAR) AS key, p_partkey % 50 AS id FROM part UNION ALL SELECT p_brand, p_partkey % 50 FROM part WHERE p_brand <> ''), u AS (SELECT key, min(id) AS id FROM c GROUP BY 1 HAVING count(DISTINCT id) = 1), r AS (SELECT CAST(s_suppkey % 120 AS VARCHAR) AS k FROM supplier) SELECT r.k || '.x' AS indicator, count(*) AS n, count(id) AS mapped FROM r LEFT JOIN u ON u.key = r.k GROUP BY 1"),
    "genetic_lookup": (lambda s, d: mapping.genetic_lookup(_variants(s, d), [f"rs{i}" for i in range(0, 400, 7)], chromosome="3"), "SELECT 'rs' || p_partkey AS rsid, substr(p_brand, 7) AS chromosome, p_size AS position, p_type AS genotype FROM part WHERE p_partkey < 400 AND p_partkey % 7 = 0 AND substr(p_brand, 7) = '3'"),
    "delete_by_source": (lambda s, d: mapping.delete_by_source(readings(s, d), ["vital.garmin"]).groupBy("source").agg(F.count("*").alias("n")), f"WITH {R} SELECT source, count(*) AS n FROM readings WHERE source <> 'vital.garmin' GROUP BY 1"),
    "summary_upsert": (_summary_upserted, "WITH o AS (SELECT o_orderkey AS k, o_totalprice AS v, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS fhir_id FROM orders), n AS (SELECT o_orderkey AS k, o_totalprice + 1 AS v, CASE WHEN o_orderkey % 5 = 0 THEN 1 END AS fhir_id FROM orders WHERE o_orderkey % 3 = 0) SELECT o.k, coalesce(n.v, o.v) AS v, coalesce(n.fhir_id, o.fhir_id) AS fhir_id FROM o LEFT JOIN n ON n.k = o.k"),
    "user_search": (_user_search, f"WITH c AS ({_COS}), own AS (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_nationkey = 3), r AS (SELECT query_id, c.id, c, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 12) DESC, c.id) AS r FROM c JOIN own ON own.id = c.id) SELECT id, round(max(c), 5) AS score FROM r WHERE r <= 5 GROUP BY 1"),
    "fetch_by_ids": (lambda s, d: vectors.fetch_by_ids(_mapped_readings(s, d), [3, 5, 8]), f"WITH {R}, m AS (SELECT *, event_id % 11 AS fhir_id FROM readings) SELECT user_id, indicator, fhir_id, count(*) AS n, min(time) AS first, max(time) AS last FROM m WHERE fhir_id IN (3, 5, 8) GROUP BY 1, 2, 3"),
    "unmapped_search": (_unmapped_search, f"WITH c AS ({_COS}), cnt AS (SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1) SELECT id, any_value(n) AS n, round(max(c), 5) AS score FROM c JOIN cnt USING (id) WHERE c >= 0.2 GROUP BY 1"),
    "content_store": (lambda s, d: table(s, d, "documents").select(F.sha2("text", 256).alias("content_hash"), "doc_id").groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1"),
    "newest_page": (lambda s, d: mapping.page(table(s, d, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), "o_orderkey"], 2, 50), "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100"),
}


def _findings_sql() -> str:
    """The findings of the recipes that the data of a user allow, by the SQL of each recipe; all users have fresh values."""
    of = {"multi_signal_deterioration": "insight_multi_signal", "long_term_trend": "insight_trend_findings", "recovery_trend": "insight_recovery", "weekday_weekend_pattern": "insight_weekday_steps", "glucose_control": "insight_glucose"}
    parts = " UNION ALL ".join(f"SELECT user_id, '{recipe}' AS recipe, {'severity' if name in ('insight_multi_signal', 'insight_trend_findings', 'insight_glucose') else chr(39) + 'mild' + chr(39)} AS severity FROM ({QUERIES[name][1]})" for recipe, name in of.items())
    need = ", ".join(f"('{recipe}', {f"'{category}'" if category else 'NULL'}, {days})" for recipe, category, days, _ in insight.RECIPES)
    return f"""{_DAYS}, based AS (SELECT user_id, category FROM base WHERE n >= 7), held AS (SELECT v.user_id, v.category, count(DISTINCT day) AS have FROM v JOIN based ON based.user_id = v.user_id AND based.category = v.category WHERE day BETWEEN {_T} - 14 AND {_T} GROUP BY 1, 2),
able AS (SELECT u.user_id, recipe FROM (SELECT DISTINCT user_id FROM based) u CROSS JOIN (VALUES {need}) AS r(recipe, category, days) LEFT JOIN held ON held.user_id = u.user_id AND held.category = r.category WHERE r.category IS NULL OR have >= days),
finds AS ({parts})
SELECT finds.user_id, finds.recipe, '{LAST_DAY}' AS target, finds.severity FROM finds JOIN able ON able.user_id = finds.user_id AND able.recipe = finds.recipe JOIN (SELECT user_id FROM v GROUP BY 1 HAVING max(day) >= {_T} - 7) fresh ON fresh.user_id = finds.user_id"""


QUERIES["insight_findings"] = (QUERIES["insight_findings"][0], _findings_sql())
