"""Queries of the concept graph, of labels on a DAG, and of merged concepts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import concept_graph, graph
from tidemark.session import written
from tidemark.sources.readings import table


def _part_codes(s, d):
    """Parts and suppliers as nodes of codes: P1 is node 1, S1 is node -2."""
    p = table(s, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("code"), F.col("p_partkey").cast("long").alias("node"))
    return p.unionByName(table(s, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("code"), (-1 - F.col("s_suppkey")).cast("long").alias("node")))


def _joined(df, by, code):
    return df.groupBy(by).agg(F.array_join(F.collect_list(code), "|").alias("codes"))


def _groups(s, d):
    """Siblings by brand, size and type; bridges of a size's parts with the suppliers of the nation of that number, and,
    as similarity bridges, of a brand's parts with those of another nation."""
    p = table(s, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("code"), "p_brand", F.col("p_size").cast("string").alias("size"), "p_type", (F.substring("p_brand", 7, 9).cast("int") % 25).cast("string").alias("brand_nation"))
    n = _joined(table(s, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("code"), F.col("s_nationkey").cast("string").alias("nation")), "nation", "code").withColumnRenamed("codes", "right")
    none = F.lit(None).cast("string")
    out = None
    for kind, column in (("brand", "p_brand"), ("size", "size"), ("type", "p_type")):
        g = _joined(p, column, "code").select(F.lit(kind).alias("kind"), F.col(column).alias("group"), F.col("codes").alias("left"), none.alias("right"))
        out = g if out is None else out.unionByName(g)
    size = _joined(p, "size", "code").join(n, F.col("size") == F.col("nation")).select(F.lit("cui").alias("kind"), F.col("size").alias("group"), F.col("codes").alias("left"), "right")
    brand = p.groupBy("p_brand", "brand_nation").agg(F.array_join(F.collect_list("code"), "|").alias("left")).join(n, F.col("brand_nation") == F.col("nation")).select(F.lit("jaccard").alias("kind"), F.col("p_brand").alias("group"), "left", "right")
    return out.unionByName(size).unionByName(brand)


def _graph(s, d):
    return written(concept_graph.build(_groups(s, d), _part_codes(s, d)))


def _asked(s, d):
    return table(s, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").cast("long").alias("node"))


_M = """sib AS (SELECT 'brand' AS kind, p_brand AS grp, CAST(p_partkey AS BIGINT) AS node FROM part UNION ALL SELECT 'size', CAST(p_size AS VARCHAR), p_partkey FROM part UNION ALL SELECT 'type', p_type, p_partkey FROM part),
sn AS (SELECT kind, grp, count(*) AS n FROM sib GROUP BY 1, 2 HAVING count(*) > 1),
bri AS (SELECT 'cui' AS kind, CAST(p_size AS VARCHAR) AS grp, 0 AS side, CAST(p_partkey AS BIGINT) AS node FROM part WHERE p_size IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT 'cui', CAST(s_nationkey AS VARCHAR), 1, -1 - s_suppkey FROM supplier WHERE s_nationkey IN (SELECT p_size FROM part)
 UNION ALL SELECT 'jaccard', p_brand, 0, p_partkey FROM part WHERE CAST(substr(p_brand, 7) AS INT) % 25 IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT 'jaccard', p_brand, 1, -1 - s_suppkey FROM (SELECT DISTINCT p_brand FROM part) JOIN supplier ON s_nationkey = CAST(substr(p_brand, 7) AS INT) % 25),
bn AS (SELECT kind, grp, count(*) FILTER (WHERE side = 0) AS n0, count(*) FILTER (WHERE side = 1) AS n1 FROM bri GROUP BY 1, 2 HAVING kind <> 'jaccard' OR count(*) <= 150)"""
_BUDGET = f"""{_M}, r AS (SELECT sib.node, sib.kind, sib.grp, n, row_number() OVER (PARTITION BY sib.node ORDER BY n, sib.kind, sib.grp) AS r FROM sib JOIN sn ON sn.kind = sib.kind AND sn.grp = sib.grp),
f AS (SELECT a.node, b.node AS other, min(r) AS r FROM r a JOIN sib b ON a.kind = b.kind AND a.grp = b.grp GROUP BY 1, 2),
t AS (SELECT node, r, count(*) AS new FROM f GROUP BY 1, 2),
u AS (SELECT node, r, CAST(coalesce(sum(new) OVER (PARTITION BY node ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM t),
bud AS (SELECT r.node, r.kind, r.grp, r.n, u.before FROM u JOIN r ON r.node = u.node AND r.r = u.r WHERE u.before < 50)"""


def _dag(s, d):
    """Parts below the parts of half and of a third of their number, some also below the one of double their number, so there are cycles."""
    p = table(s, d, "part").select(F.col("p_partkey").cast("long").alias("child"))
    up = F.array(F.floor(F.col("child") / 2), F.floor(F.col("child") / 3), F.when(F.col("child") % 50 == 7, F.col("child") * 2))
    return p.select("child", F.explode(up).alias("parent")).where("parent > 0")


def _labels(s, d):
    k = F.floor(F.col("p_partkey") / 97)
    return table(s, d, "part").where("p_partkey % 97 = 5").select(F.col("p_partkey").cast("long").alias("label"), F.when(k > 0, F.floor(k / 2) * 97 + 5).alias("parent"))


_DAG = """e AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part UNION ALL SELECT p_partkey, p_partkey // 3 FROM part UNION ALL SELECT p_partkey, p_partkey * 2 FROM part WHERE p_partkey % 50 = 7),
l AS (SELECT p_partkey AS label, CASE WHEN p_partkey // 97 > 0 THEN p_partkey // 97 // 2 * 97 + 5 END AS parent FROM part WHERE p_partkey % 97 = 5),
dep AS (SELECT label, 0 AS depth FROM l WHERE parent IS NULL UNION ALL SELECT l.label, depth + 1 FROM dep JOIN l ON l.parent = dep.label),
reach AS (SELECT label AS node, label FROM l UNION SELECT e.child, reach.label FROM reach JOIN e ON e.parent = reach.node WHERE e.parent > 0),
own AS (SELECT node, label, depth FROM (SELECT reach.node, reach.label, depth, row_number() OVER (PARTITION BY reach.node ORDER BY depth DESC, reach.label) AS r FROM reach JOIN dep ON dep.label = reach.label) WHERE r = 1)"""


def _found(s, d):
    labels = _labels(s, d)
    roots = concept_graph.label_depths(labels).select(F.col("label").alias("node"), "label", "depth")
    return concept_graph.labelled(_dag(s, d), roots)


def _assigned(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").cast("long").alias("node"), "p_size")
    sites = p.select("node", F.col("p_size").cast("long").alias("site"), F.lit(1).cast("long").alias("position")).unionByName(p.select("node", (F.col("node") % 13).alias("site"), F.lit(2).cast("long").alias("position")))
    li = table(s, d, "lineitem").groupBy((-1 - F.col("l_suppkey")).cast("long").alias("node"), F.col("l_partkey").cast("long").alias("other")).agg(F.min("l_linenumber").cast("long").alias("position"))
    nodes = p.select("node").unionByName(li.select("node").distinct())
    return concept_graph.assigned(nodes, _found(s, d), sites, li)


_ASSIGNED = f"""WITH RECURSIVE {_DAG},
st AS (SELECT p_partkey AS node, p_size AS site, 1 AS position FROM part UNION ALL SELECT p_partkey, p_partkey % 13, 2 FROM part),
bysite AS (SELECT node, label FROM (SELECT st.node, own.label, row_number() OVER (PARTITION BY st.node ORDER BY position, site) AS r FROM st JOIN own ON own.node = st.site WHERE st.node NOT IN (SELECT node FROM own)) WHERE r = 1),
al AS (SELECT node, label FROM own UNION ALL SELECT node, label FROM bysite),
br AS (SELECT -1 - l_suppkey AS node, l_partkey AS other, min(l_linenumber) AS position FROM lineitem GROUP BY 1, 2),
over_ AS (SELECT node, label FROM (SELECT br.node, al.label, row_number() OVER (PARTITION BY br.node ORDER BY position, other) AS r FROM br JOIN al ON al.node = br.other) WHERE r = 1)
SELECT node, label, 'descent' AS way FROM own WHERE node IN (SELECT p_partkey FROM part) UNION ALL SELECT node, label, 'site' FROM bysite UNION ALL SELECT node, label, 'bridge' FROM over_"""


def _links(s, d):
    p = table(s, d, "part").where("p_partkey % 3 <> 0")
    return p.select(F.col("p_partkey").cast("long").alias("a"), (F.col("p_partkey") + F.col("p_size")).cast("long").alias("b"))


def _names(s, d):
    p = table(s, d, "part").select(F.substring_index("p_name", " ", 2).alias("name"), "p_partkey", "p_name")
    k = F.col("p_partkey") % 3
    return p.select("name", F.when(k == 0, "snomed").when(k == 1, "loinc").otherwise("rxnorm").alias("system"), F.concat(F.when(k == 0, "S").when(k == 1, "L").otherwise("R"), "p_partkey").alias("code"), "p_partkey", "p_name")


def _bridge_rows(s, d):
    p = table(s, d, "part").select("p_partkey")
    row = lambda kind, left, right, step, every: p.where(F.col("p_partkey") % every[0] == every[1]).select(F.lit(kind).alias("kind"), F.lit(left[0]).alias("left_system"), F.concat(F.lit(left[1]), "p_partkey").alias("left_code"), F.lit(right[0]).alias("right_system"), F.concat(F.lit(right[1]), F.col("p_partkey") + step).alias("right_code"))
    a, b, c = ("snomed", "S"), ("loinc", "L"), ("rxnorm", "R")
    return row("icd", a, b, 1, (6, 0)).unionByName(row("jaccard", a, b, 4, (3, 0))).unionByName(row("rxnorm", a, c, 2, (9, 0))).unionByName(row("loinc_rxnorm", b, c, 1, (12, 1)))


def _merged(s, d):
    n = _names(s, d)
    core = n.where("p_partkey % 5 = 0").select(F.col("p_name").alias("name"), F.concat(F.lit("L"), "p_partkey").alias("code"))
    keep = n.where("system = 'snomed' and p_partkey % 4 = 0").select("code")
    return concept_graph.merged(n.select("name", "system", "code"), _bridge_rows(s, d), core, kept=keep)


_MERGED = """WITH p AS (SELECT p_partkey AS k, p_name, split_part(p_name, ' ', 1) || CASE WHEN p_name LIKE '% %' THEN ' ' || split_part(p_name, ' ', 2) ELSE '' END AS name FROM part),
own0 AS (SELECT DISTINCT name, CASE k % 3 WHEN 0 THEN 'snomed' WHEN 1 THEN 'loinc' ELSE 'rxnorm' END AS system, CASE k % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'L' ELSE 'R' END || k AS code FROM p),
own AS (SELECT * FROM own0 UNION SELECT p_name, 'loinc', 'L' || k FROM p WHERE k % 5 = 0 AND 'L' || k NOT IN (SELECT code FROM own0)),
b AS (SELECT 'S' || k AS x, 'loinc' AS system, 'L' || (k + 1) AS code FROM p WHERE k % 6 = 0 UNION ALL SELECT 'S' || k, 'rxnorm', 'R' || (k + 2) FROM p WHERE k % 9 = 0),
lr AS (SELECT 'L' || k AS x, 'R' || (k + 1) AS code FROM p WHERE k % 12 = 1),
one AS (SELECT name, b.system, b.code FROM own JOIN b ON own.code = b.x),
two AS (SELECT name, 'rxnorm' AS system, lr.code FROM (SELECT name, code FROM own WHERE system = 'loinc' UNION SELECT name, code FROM one WHERE system = 'loinc') o JOIN lr ON o.code = lr.x),
al AS (SELECT *, false AS bridged FROM own UNION ALL SELECT *, true FROM (SELECT * FROM one UNION SELECT * FROM two EXCEPT SELECT * FROM own))
SELECT * FROM al WHERE name IN (SELECT name FROM al WHERE system <> 'snomed' OR CAST(substr(code, 2) AS INT) % 4 = 0)"""


def _tokens(s, d):
    return table(s, d, "part").select(F.col("p_partkey").cast("long").alias("id"), scalars.tokens(F.col("p_name"), ["small", "the"]).alias("tokens"))


def _segments(s, d):
    """Merged concepts under names of several segments."""
    p = table(s, d, "part").select("p_partkey", "p_name", "p_brand", (F.col("p_partkey") % 40).cast("string").alias("c"))
    name = F.concat_ws("; ", F.substring_index("p_name", " ", 2), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")), F.when(F.col("p_partkey") % 7 == 0, F.col("p_name")))
    return p.select(name.alias("name"), F.when(F.col("p_partkey") % 2 == 0, "loinc").otherwise("snomed").alias("system"), F.col("c").alias("code"))


_SETS = "t AS (SELECT p_partkey AS id, list_sort(list_filter(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')), lambda x: x NOT IN ('small', 'the'))) AS k FROM part), c AS (SELECT k, CAST(min(id) AS BIGINT) AS id, count(*) AS n FROM t WHERE len(k) >= 2 GROUP BY 1), j AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, len(list_intersect(a.k, b.k)) AS c, len(a.k) AS la, len(b.k) AS lb FROM c a JOIN c b ON a.id < b.id)"
_CLASS_LINKS = "x AS (SELECT a, b, na, nb, round(c / (la + lb - c), 6) AS jaccard FROM j WHERE c >= 0.5 * la AND c >= 0.5 * lb UNION ALL SELECT id, id, n, n, 1.0 FROM c WHERE n > 1)"

QUERIES = {
    "concept_graph": (lambda s, d: _graph(s, d).withColumn("here", F.col("here").cast("long")).withColumn("there", F.col("there").cast("long")), f'WITH {_M} SELECT sib.kind, sib.grp AS "group", false AS bridge, 0 AS side, node, n AS here, n AS there FROM sib JOIN sn ON sn.kind = sib.kind AND sn.grp = sib.grp UNION ALL SELECT bri.kind, bri.grp, true, side, node, CASE side WHEN 0 THEN n0 ELSE n1 END, CASE side WHEN 0 THEN n1 ELSE n0 END FROM bri JOIN bn ON bn.kind = bri.kind AND bn.grp = bri.grp'),
    "sibling_budget": (lambda s, d: concept_graph.sibling_budget(_graph(s, d)), f'WITH {_BUDGET} SELECT node, kind, grp AS "group", n AS size, before FROM bud'),
    "budgeted_neighbours": (lambda s, d: concept_graph.neighbours(_graph(s, d), _asked(s, d)), f"WITH {_BUDGET}, al AS (SELECT bud.node, sib.node AS neighbour, false AS bridged FROM bud JOIN sib ON sib.kind = bud.kind AND sib.grp = bud.grp WHERE bud.node % 100 = 0 UNION ALL SELECT x.node, y.node, true FROM bri x JOIN bn ON bn.kind = x.kind AND bn.grp = x.grp JOIN bri y ON y.kind = x.kind AND y.grp = x.grp AND y.side <> x.side WHERE x.node % 100 = 0 AND x.node >= 0) SELECT node, neighbour, bool_or(bridged) AS bridged FROM al WHERE node <> neighbour GROUP BY 1, 2"),
    "dag_labels": (_found, f"WITH RECURSIVE {_DAG} SELECT node, label, depth FROM own"),
    "taxonomy_assignment": (_assigned, _ASSIGNED),
    "concept_components": (lambda s, d: concept_graph.components(_links(s, d)), "WITH RECURSIVE e AS (SELECT CAST(p_partkey AS BIGINT) AS a, CAST(p_partkey + p_size AS BIGINT) AS b FROM part WHERE p_partkey % 3 <> 0), t AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT x AS node, x AS c FROM t UNION SELECT t.y, r.c FROM r JOIN t ON t.x = r.node) SELECT node, min(c) AS component FROM r GROUP BY 1"),
    "merged_concept_codes": (_merged, _MERGED),
    "concepts_without_subsets": (lambda s, d: concept_graph.without_subsets(_segments(s, d)), None),
    "token_bridge_links": (lambda s, d: graph.token_links(graph.token_classes(_tokens(s, d))), f"WITH {_SETS}, {_CLASS_LINKS} SELECT a, b, na, nb, jaccard FROM x"),
    "token_bridge_members": (lambda s, d: graph.token_members(_tokens(s, d)), f"WITH {_SETS}, {_CLASS_LINKS}, k AS (SELECT id, sum(m) AS links FROM (SELECT a AS id, CASE WHEN a = b THEN na - 1 ELSE nb END AS m FROM x UNION ALL SELECT b, na FROM x WHERE a <> b) GROUP BY 1) SELECT CAST(t.id AS BIGINT) AS id, c.id AS class_id, CAST(coalesce(links, 0) AS BIGINT) AS links FROM t JOIN c ON c.k = t.k LEFT JOIN k ON k.id = c.id"),
    "concept_bridge_classes": (lambda s, d: graph.bridge_classes(_two_systems(s, d), "S", "C"), "WITH s AS (SELECT s_nationkey || '-' || CAST(floor(s_acctbal / 100) AS BIGINT) AS cui, CAST(s_suppkey AS VARCHAR) AS code FROM supplier), c AS (SELECT c_nationkey || '-' || CAST(floor(c_acctbal / 100) AS BIGINT) AS cui, CAST(c_custkey AS VARCHAR) AS code FROM customer), a AS (SELECT cui, count(*) AS n FROM s GROUP BY 1), b AS (SELECT cui, count(*) AS n FROM c GROUP BY 1), k AS (SELECT cui, a.n AS na, b.n AS nb FROM a JOIN b USING (cui)) SELECT 'S' AS system, code, cui AS class_id, nb AS links FROM s JOIN k USING (cui) UNION ALL SELECT 'C', code, cui, na FROM c JOIN k USING (cui)"),
}


def _two_systems(s, d):
    from tidemark.plans.other_queries import _codes

    return _codes(s, d)
