"""Queries of streams over given tables, packing, prefixes, abbreviations, ranges, codes and vocabularies, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import ranges, registry, scalars
from tidemark.operators import concept_graph, daily, graph, packing
from tidemark.plans.other_queries import _BASE, _rounded
from tidemark.session import shared_folder
from tidemark.sources.readings import READINGS_SQL as R
from tidemark.sources import vocabularies
from tidemark.sources.readings import readings, table
from tidemark.streaming import baselines, raw


def _folder(s, name):
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


def _stream(s, d, name):
    path = f"{d}/{name}.parquet"
    return s.readStream.schema(s.read.parquet(path).schema).parquet(f"{path}*")  # a pattern, as a stream's path may be no file


def _streamed_baselines(s, d):
    """Line items as values of suppliers and return flags by day, the one with the largest order and line number the last."""
    stamp = F.timestamp_micros((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long"))
    rows = _stream(s, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("user_id"), F.col("l_returnflag").alias("category"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_quantity").cast("double").alias("value"), stamp.alias("update_time"))
    folder = _folder(s, "baselines")
    q = baselines.start(rows, folder, _folder(s, "state"), lookback=365)
    q.awaitTermination()
    return _rounded(baselines.current(s, folder), "mean", "sigma")


_STREAMED = f"""WITH RECURSIVE d AS (SELECT CAST(l_suppkey AS VARCHAR) AS user_id, l_returnflag AS category, CAST(l_shipdate AS DATE) AS day, arg_max(CAST(l_quantity AS DOUBLE), l_orderkey * 8 + l_linenumber) AS value FROM lineitem GROUP BY 1, 2, 3),
v AS (SELECT user_id, category, day, value FROM (SELECT *, max(day) OVER (PARTITION BY user_id, category) AS newest FROM d) WHERE day > newest - 365), {_BASE}
SELECT base.user_id, base.category, base.n, round(mean, 6) AS mean, round(sigma, 6) AS sigma, frozen, newest FROM base JOIN (SELECT user_id, category, max(day) AS newest FROM v GROUP BY 1, 2) x ON x.user_id = base.user_id AND x.category = base.category"""


def _stored(s, d):
    """Events as messages whose names come again and again."""
    payload = F.concat_ws("|", F.col("event_id").cast("string"), "event_type")
    rows = _stream(s, d, "events").select(F.concat(F.lit("m"), F.floor(F.col("event_id") / 3).cast("string")).alias("msg_id"), F.col("ts").cast("timestamp").alias("received"), payload.alias("payload"))
    store = raw.Messages(s, _folder(s, "messages"), "msg_id string, received timestamp, payload string")
    q = raw.start(rows, store, _folder(s, "state"))
    q.awaitTermination()
    return store.stored().groupBy("msg_id").agg(F.count("*").alias("stored"), F.count_if(F.col("payload") != "").alias("with_payload"))


def _packed(s, d):
    """Conversations packed into chunks of 200 words with a header and a footer, the turns in their order."""
    from pyspark.sql import Window

    c = table(s, d, "conversations")
    cost = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")) + 1
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return packing.pack(c.select("conv_id", place.alias("place"), cost.alias("cost")), "conv_id", packing.budget(200, 10, 6))


_PACKED = """WITH RECURSIVE c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, len(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> '')) + 1 AS cost FROM conversations),
w AS (SELECT conv_id, place, CASE WHEN cost <= 180 THEN place END AS chunk, CASE WHEN cost <= 180 THEN cost ELSE 0 END AS used FROM c WHERE place = 0
 UNION ALL SELECT c.conv_id, c.place, CASE WHEN cost > 180 THEN NULL WHEN w.chunk IS NULL OR used + cost > 180 THEN c.place ELSE w.chunk END, CASE WHEN cost > 180 THEN 0 WHEN w.chunk IS NULL OR used + cost > 180 THEN cost ELSE used + cost END FROM w JOIN c ON c.conv_id = w.conv_id AND c.place = w.place + 1)
SELECT conv_id, place, chunk FROM w WHERE chunk IS NOT NULL"""

_BLOCKED = ("small", "blue", "large")


def _prefixes(s, d):
    return concept_graph.prefix_groups(table(s, d, "part").select(F.col("p_partkey").alias("code"), F.concat_ws(" ", "p_name", F.substring_index("p_type", " ", 1)).alias("name")), blocked=_BLOCKED)


_PREFIXES = f"""WITH n AS (SELECT p_partkey AS code, list_filter(string_split(lower(p_name || ' ' || split_part(p_type, ' ', 1)), ' '), lambda x: x <> '') AS w FROM part),
p AS (SELECT code, i AS words, array_to_string(w[1:i], ' ') AS prefix FROM (SELECT code, w, unnest(generate_series(1, len(w))) AS i FROM n)),
g AS (SELECT prefix, count(*) AS n FROM p WHERE prefix NOT IN {_BLOCKED} GROUP BY 1 HAVING count(*) >= 2)
SELECT code, prefix, words, n FROM (SELECT code, p.prefix, words, n, row_number() OVER (PARTITION BY code ORDER BY words DESC) AS r FROM p JOIN g ON g.prefix = p.prefix) WHERE r = 1"""


def _expanded(s, d):
    """Whole texts with an abbreviation put before every line, so there is something to expand in each."""
    names = list(scalars.ABBREVIATIONS)
    pick = F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names) + 1).cast("int"))
    text = F.concat(pick, F.lit(" "), F.coalesce("text", F.lit("")), F.lit(" (IgE)"))
    return table(s, d, "documents").select("doc_id", F.md5(scalars.expanded(text)).alias("expanded"))


_NAMES = list(scalars.ABBREVIATIONS)
_EXPANDED = f"""WITH t AS (SELECT doc_id, {_NAMES}[doc_id % {len(_NAMES)} + 1] || ' ' || coalesce(text, '') || ' (IgE)' AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS w FROM t), m AS (SELECT MAP {{{", ".join(f"'{a}': '{a} ({n})'" for a, n in scalars.ABBREVIATIONS.items())}}} AS m)
SELECT doc_id, md5(array_to_string(list_transform(w, lambda x: coalesce(m[x], x)), '')) AS expanded FROM w, m"""


def _custom(s, d):
    """The spread of a day's heart rates and the number of its high glucose values, as rules of a caller."""
    own = [registry.Custom("heartRates", "spread", "count/min", lambda num, time: F.max(num) - F.min(num)), registry.Custom("bloodGlucoses", "high_count", "count", lambda num, time: F.count_if(num > 180), "dailyHighGlucose")]
    names = {c.target or registry.target(c.method, c.indicator) for c in own}
    return daily.summaries(readings(s, d), own).where(F.substring_index("indicator", ".", 1).isin(*names)).select("user_id", "indicator", "start_time", "value")


_CUSTOM = f"""WITH {R}, g AS (SELECT user_id, indicator, source, timezone, day, CAST(max(num) - min(num) AS DOUBLE) AS spread, CAST(count(*) FILTER (WHERE num > 180) AS DOUBLE) AS high FROM good GROUP BY ALL)
SELECT user_id, CASE indicator WHEN 'heartRates' THEN 'dailySpreadHeartRates.' ELSE 'dailyHighGlucose.' END || regexp_replace(source, '^vital\\.', '') AS indicator, CAST(day AS TIMESTAMP) AS start_time, CASE indicator WHEN 'heartRates' THEN spread ELSE high END AS value FROM g WHERE indicator IN ('heartRates', 'bloodGlucoses')"""

_B = list(ranges.BOUNDS.items())


def _ranges(s, d):
    """Line items as readings of all indicators that have a range, with values from tenths to tens of thousands."""
    name = F.element_at(F.array(*[F.lit(n) for n, _ in _B]), (F.col("l_partkey") % len(_B) + 1).cast("int"))
    num = (F.col("l_extendedprice").cast("double") - 5000) / F.pow(F.lit(10.0), F.col("l_linenumber") - 1)
    v = scalars.validate(table(s, d, "lineitem").select(name.alias("indicator"), num.alias("num")))
    return v.groupBy("indicator", F.substring("reason", 1, 2).alias("broken")).agg(F.count("*").alias("n"))


_RANGES = f"""WITH b AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{n}', {low}::DOUBLE, {high}::DOUBLE)" for i, (n, (low, high)) in enumerate(_B))}) AS t(k, indicator, low, high)),
v AS (SELECT l_partkey % {len(_B)} AS k, (CAST(l_extendedprice AS DOUBLE) - 5000) / power(10.0::DOUBLE, l_linenumber - 1) AS x FROM lineitem)
SELECT indicator, CASE WHEN x < low THEN '>=' WHEN x > high THEN '<=' END AS broken, count(*) AS n FROM v JOIN b USING (k) GROUP BY 1, 2"""


def _coded(s, d):
    """Parts as codes of numbered systems, some with dashes, so different codes meet in one number; and as hashed ones."""
    p, k = table(s, d, "part").select("p_partkey", "p_type"), F.col("p_partkey")
    loinc = p.select(F.lit("LOINC").alias("system"), F.when(k % 2 == 0, F.concat(F.floor(k / 20).cast("string"), F.lit("-"), (F.floor(k / 2) % 10).cast("string"))).otherwise(F.floor(k / 2).cast("string")).alias("code"))
    other = p.select(F.when(k % 3 == 0, "RXNORM").when(k % 3 == 1, "SNOMED_CT").otherwise("unknown").alias("system"), F.when(k % 10 == 0, "p_type").otherwise(k.cast("string")).alias("code"))
    return loinc.unionByName(other)


_CODED = """c AS (SELECT 'LOINC' AS system, 1 AS k, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey // 20) || '-' || (p_partkey // 2 % 10) ELSE CAST(p_partkey // 2 AS VARCHAR) END AS code FROM part
 UNION ALL SELECT CASE p_partkey % 3 WHEN 0 THEN 'RXNORM' WHEN 1 THEN 'SNOMED_CT' ELSE 'unknown' END, CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 END, CASE WHEN p_partkey % 10 = 0 THEN 'p_type' ELSE CAST(p_partkey AS VARCHAR) END FROM part),
i AS (SELECT system, code, k * 1152921504606846976 + TRY_CAST(replace(code, '-', '') AS BIGINT) AS id FROM c)"""


def _vocabulary(s, d):
    """Suppliers and customers written as files of names and read back: the concepts that both have."""
    from tidemark.plans.other_queries import _codes

    folder = _folder(s, "MRCONSO")
    none = F.lit("")
    cells = {"CUI": F.col("cui"), "LAT": F.lit("ENG"), "SAB": F.when(F.col("system") == "S", "SNOMEDCT_US").otherwise("LNC"), "CODE": F.col("code"), "STR": F.concat(F.lit('a "name" of '), "code"), "SUPPRESS": F.lit("N")}
    _codes(s, d).select(F.concat(*[x for n in vocabularies.COLUMNS["MRCONSO"].split() for x in (cells.get(n, none), F.lit("|"))]).alias("value")).write.text(folder)
    return graph.bridge_classes(vocabularies.concept_codes(vocabularies.rich(s, folder, "MRCONSO")), "snomed", "loinc")


_VOCABULARY = """WITH s AS (SELECT s_nationkey || '-' || CAST(floor(s_acctbal / 100) AS BIGINT) AS cui, CAST(s_suppkey AS VARCHAR) AS code FROM supplier), c AS (SELECT c_nationkey || '-' || CAST(floor(c_acctbal / 100) AS BIGINT) AS cui, CAST(c_custkey AS VARCHAR) AS code FROM customer),
a AS (SELECT cui, count(*) AS n FROM s GROUP BY 1), b AS (SELECT cui, count(*) AS n FROM c GROUP BY 1), k AS (SELECT cui, a.n AS na, b.n AS nb FROM a JOIN b USING (cui))
SELECT 'snomed' AS system, code, cui AS class_id, nb AS links FROM s JOIN k USING (cui) UNION ALL SELECT 'loinc', code, cui, na FROM c JOIN k USING (cui)"""

QUERIES = {
    "range_rules": (_ranges, _RANGES),
    "code_ids": (lambda s, d: scalars.code_ids(_coded(s, d)), f"WITH {_CODED} SELECT system, code, id FROM i"),
    "code_collisions": (lambda s, d: scalars.code_collisions(scalars.code_ids(_coded(s, d))), f"WITH {_CODED} SELECT id, string_agg(DISTINCT system || ':' || code, '|' ORDER BY system || ':' || code) AS codes FROM i WHERE id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT system || ':' || code) > 1"),
    "vocabulary_bridges": (_vocabulary, _VOCABULARY),
    "streamed_baselines": (_streamed_baselines, _STREAMED),
    "stored_messages": (_stored, "SELECT 'm' || (event_id // 3) AS msg_id, CAST(1 AS BIGINT) AS stored, CAST(1 AS BIGINT) AS with_payload FROM events GROUP BY 1"),
    "packed_conversations": (_packed, _PACKED),
    "name_prefixes": (_prefixes, _PREFIXES),
    "expanded_texts": (_expanded, _EXPANDED),
    "custom_summaries": (_custom, _CUSTOM),
}
