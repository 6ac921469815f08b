"""The concept graph against plain versions: budgets, labels on a DAG, components, merged concepts, classes of tokens."""

import random
from collections import defaultdict

import pytest

from tests.conftest import SF
from tidemark.operators import concept_graph, graph
from tidemark.plans import catalog

GROUPS, CODES = "kind string, group string, left string, right string", "code string, node long"


def plain_neighbours(groups, codes, most, limit=150):
    """Bridges and siblings of each node, by sets."""
    of = defaultdict(set)
    for c, n in codes:
        if n is not None:
            of[c].add(n)
    listed = lambda text: [c for c in (text or "").split("|") if c]
    nodes = lambda text: set().union(*(of[c] for c in listed(text))) if listed(text) else set()
    bridges, siblings = defaultdict(set), []
    for kind, group, left, right in groups:
        if right is None:
            if len(listed(left)) >= 2 and len(nodes(left)) >= 2:
                siblings.append((len(nodes(left)), kind, group, nodes(left)))
        elif not (kind == "jaccard" and len(listed(left)) + len(listed(right)) > limit) and nodes(left) and nodes(right):
            for a in nodes(left):
                bridges[a] |= nodes(right)
            for a in nodes(right):
                bridges[a] |= nodes(left)
    out = {}
    for n in {n for _, n in codes if n is not None}:
        got = set()
        for _, _, _, members in sorted(g for g in siblings if n in g[3]):
            if len(got) >= most:
                break
            got |= members
        for m in (got | bridges[n]) - {n}:
            out[n, m] = m in bridges[n]
    return out


def random_groups(r, n_groups, n_nodes):
    codes = [(f"c{i}", i) for i in range(n_nodes)] + [(f"c{i}", i + 1) for i in range(0, n_nodes, 9)] + [("ghost", None)]
    some = lambda most: "|".join(r.choice([*(f"c{r.randrange(n_nodes)}" for _ in range(6)), "unknown", "ghost", ""]) for _ in range(r.randint(0, most)))
    groups = [(r.choice(["a", "b"]), f"g{i}", some(r.choice([2, 6, 30])), None) for i in range(n_groups)]
    groups += [(r.choice(["cui", "jaccard"]), f"x{i}", some(8), some(8)) for i in range(n_groups // 3)]
    hub = [("a", f"h{i}", f"c0|c{1 + i % 40}", None) for i in range(90)]  # one node in very many groups that bring little
    return groups + hub + [("jaccard", "wide", "|".join(f"c{i}" for i in range(100)), "|".join(f"c{i}" for i in range(60)))], codes


@pytest.mark.parametrize(("seed", "most", "parts"), [(1, 50, 3), (2, 5, 1), (3, 2, 7), (4, 12, 2)])
def test_neighbours_within_the_budget(spark, seed, most, parts):
    groups, codes = random_groups(random.Random(seed), 60, 120)
    g = concept_graph.build(spark.createDataFrame(groups, GROUPS), spark.createDataFrame(codes, CODES)).cache()
    asked = spark.createDataFrame([(n,) for n in [*range(120), 120, 999, None, 3]], "node long")
    got = {(r["node"], r["neighbour"]): r["bridged"] for r in concept_graph.neighbours(g, asked, most).collect()}
    want = plain_neighbours(groups, codes, most)
    assert got == want and len(want) > 500
    # all at once, and the hub settled in several parts, the groups are the same
    every = {tuple(r) for r in concept_graph.sibling_budget(g, most, parts=parts).collect()}
    assert every == {tuple(r) for r in concept_graph.sibling_budget(g, most, asked).collect()}
    g.unpersist()


def test_graph_rows_are_linear_in_memberships(spark):
    codes = spark.createDataFrame([(f"c{i}", i) for i in range(500)], CODES)
    one = "|".join(f"c{i}" for i in range(500))
    g = concept_graph.build(spark.createDataFrame([("a", "all", one, None), ("cui", "all", one, one)], GROUPS), codes)
    assert g.count() == 1500 and concept_graph.sibling_budget(g).count() == 500
    assert concept_graph.build(spark.createDataFrame([], GROUPS), codes).count() == 0


def plain_labels(edges, roots):
    children = defaultdict(set)
    for c, p in edges:
        if c is not None and p is not None:
            children[p].add(c)
    label = {}
    for node, name, depth in sorted((x for x in roots if x[0] is not None), key=lambda x: (-x[2], x[1])):
        if node in label:
            continue
        label[node], stack = (name, depth), [node]
        while stack:
            for c in children[stack.pop()]:
                if c not in label:
                    label[c] = name, depth
                    stack.append(c)
    return label


@pytest.mark.parametrize("seed", range(3))
def test_labels_go_down_a_dag_with_cycles(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(110)] + [(5, 5), (None, 3), (4, None)]
    roots = [(r.randrange(80), 100 + i, r.randrange(4)) for i in range(7)] + [(None, 1, 1)]
    got = concept_graph.labelled(spark.createDataFrame(edges, "child long, parent long"), spark.createDataFrame(roots, "node long, label long, depth int"))
    assert {x["node"]: (x["label"], x["depth"]) for x in got.collect()} == plain_labels(edges, roots)
    assert concept_graph.labelled(spark.createDataFrame(edges, "child long, parent long"), spark.createDataFrame([], "node long, label long, depth int")).count() == 0


def test_sites_and_bridges_come_after_descent(spark):
    found = spark.createDataFrame([(1, 10, 1), (2, 20, 0)], "node long, label long, depth int")
    sites = spark.createDataFrame([(1, 2, 1), (3, 9, 0), (3, 2, 2), (3, 1, 2), (4, 9, 1)], "node long, site long, position int")
    bridge = spark.createDataFrame([(7, 4, 1), (7, 3, 2), (3, 2, 0), (8, 4, 1)], "node long, other long, position int")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 3, 4, 7, 8)], "node long")
    got = {(r["node"], r["label"], r["way"]) for r in concept_graph.assigned(nodes, found, sites, bridge).collect()}
    assert got == {(1, 10, "descent"), (2, 20, "descent"), (3, 10, "site"), (7, 10, "bridge")}


def test_label_depths(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 1), (5, 77), (6, 6)]
    assert {r["label"]: r["depth"] for r in concept_graph.label_depths(spark.createDataFrame(rows, "label long, parent long")).collect()} == {1: 0, 2: 1, 3: 2, 4: 1, 5: 0, 6: 0}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(90)] + [(1000 + i, 1001 + i) for i in range(60)] + [(3000, 3001 + i) for i in range(50)] + [(7, 7), (8000, 8000), (None, 4)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in concept_graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in top}
    assert concept_graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bridges_are_injected_once_and_in_order(spark):
    names = [("x", "snomed", "S1"), ("y", "snomed", "S2"), ("z", "loinc", "L9"), ("w", "snomed", "S3"), ("v", "rxnorm", "R1"), ("y", "loinc", "L2")]
    bridges = [("icd", "snomed", "S1", "loinc", "L1"), ("jaccard", "snomed", "S2", "loinc", "L7"), ("rxnorm", "snomed", "S2", "rxnorm", "R5"), ("mrrel", "snomed", "S2", "loinc", "L2"), ("loinc_rxnorm", "loinc", "L1", "rxnorm", "R2"), ("loinc_rxnorm", "loinc", "L8", "rxnorm", "R8"), ("icd", "loinc", "L9", "snomed", "S1")]
    core = [("orphan", "L8"), ("z", "L9"), ("other", "L2")]
    df = concept_graph.merged(spark.createDataFrame(names, "name string, system string, code string"), spark.createDataFrame(bridges, "kind string, left_system string, left_code string, right_system string, right_code string"), spark.createDataFrame(core, "name string, code string"), kept=spark.createDataFrame([("S2",)], "code string"))
    assert {tuple(r) for r in df.collect()} == {("x", "snomed", "S1", False), ("x", "loinc", "L1", True), ("x", "rxnorm", "R2", True), ("y", "snomed", "S2", False), ("y", "loinc", "L2", False), ("y", "rxnorm", "R5", True), ("z", "loinc", "L9", False), ("v", "rxnorm", "R1", False), ("orphan", "loinc", "L8", False), ("orphan", "rxnorm", "R8", True)}


def plain_without_subsets(rows):
    codes = defaultdict(set)
    for name, system, code in rows:
        codes[name].add((system, code))
    kept, by = set(), defaultdict(list)
    for name in sorted(codes, key=lambda n: (-len(n), n)):
        segments = [s for s in (x.strip(" ") for x in name.split(";")) if s]
        if not any(codes[name] <= other for s in segments for other in by[s]):
            kept.add(name)
            for s in segments:
                by[s].append(codes[name])
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_absorbed_names(spark, seed):
    r = random.Random(seed)
    rows = [("; ".join(r.choice(["a", "bb", "ccc", "d ", " e", ""]) + r.choice(["", "x"]) for _ in range(r.randint(1, 4))), r.choice("sl"), str(r.randrange(5))) for _ in range(120)]
    got = {x["name"] for x in concept_graph.without_subsets(spark.createDataFrame(rows, "name string, system string, code string")).collect()}
    assert got == plain_without_subsets(rows)


def test_absorbed_names_of_given_tables(spark):
    from tidemark.plans import graph_queries

    rows = [tuple(x) for x in graph_queries._segments(spark, SF).collect()]
    want = plain_without_subsets(rows)
    assert {x["name"] for x in catalog.queries()["concepts_without_subsets"](spark, SF).collect()} == want and 0 < len(want) < len({x[0] for x in rows})


def test_token_classes_say_what_the_pairs_say(spark):
    r = random.Random(5)
    rows = [(i, [r.choice("abcdefg") for _ in range(r.randint(0, 4))]) for i in range(150)] + [(900, None), (901, []), (902, ["a", "b"]), (903, ["b", "a"])]
    sets = {i: {*t} for i, t in rows if t is not None}
    ok = lambda s, t: 2 * len(s & t) >= max(len(s), len(t))
    # tokens come as sets
    df = spark.createDataFrame([(i, None if t is None else sorted({*t}, key=lambda _: r.random())) for i, t in rows], "id long, tokens array<string>")
    pairs = {(a, b) for a in sets for b in sets if a < b and min(len(sets[a]), len(sets[b])) >= 2 and ok(sets[a], sets[b])}
    assert {(x["a"], x["b"]) for x in graph.token_bridge(df).collect()} == pairs
    links = defaultdict(int)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    want = {(i, first[frozenset(s)], links[i]) for i, s in sets.items() if len(s) >= 2}
    assert {tuple(x) for x in graph.token_members(df).collect()} == want
