"""The concept graph with groups as nodes: memberships instead of pairs, neighbours within a budget, labels down a DAG.

A group is a node of its own. A bridge group has two sides, and a member's neighbours are the members of the other
side; the members of a sibling group are neighbours of each other. So the graph has a row for each membership, and
nothing is multiplied out until somebody asks for the neighbours of given nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written

#: Bridges by similarity with more codes than this are no bridges; siblings are gathered until there are so many.
SIMILARITY_CODES, MOST_SIBLINGS = 150, 50
#: Fixed value: parts that the members of a group are dealt into.
PARTS = 16
_GROUP = ["kind", "group"]


def _list(column: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(column), F.lit("")), r"\|"), lambda c: c != "")


def build(groups: DataFrame, codes: DataFrame, limited: tuple[str, ...] = ("jaccard",), most_codes: int = SIMILARITY_CODES) -> DataFrame:
    """(kind, group, bridge, side, node, here, there): the memberships of all groups, with the sizes of both sides.

    groups: (kind, group, left, right), codes joined by |; a null right makes it a group of siblings. codes: (code, node),
    a code may stand for several nodes. Groups of a limited kind with more than most_codes codes are left out, as are
    siblings of fewer than two codes or nodes and bridges with an empty side. Unknown and empty codes count for nothing,
    a node counts once however many of its codes a side names, and rows that share (kind, group) are one group."""
    g = groups.select(*_GROUP, F.col("right").isNotNull().alias("bridge"), _list("left").alias("l"), _list("right").alias("r"))
    n = F.size("l") + F.size("r")
    g = g.where((~F.col("kind").isin(*limited) | (n <= most_codes)) & (F.col("bridge") | (n >= 2)))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("l").alias("codes")), F.struct(F.lit(1).alias("side"), F.col("r").alias("codes")))
    m = g.select(*_GROUP, "bridge", F.explode(sides).alias("s")).select(*_GROUP, "bridge", "s.side", F.explode("s.codes").alias("code"))
    m = m.join(codes.select("code", "node").where("node is not null"), "code").select(*_GROUP, "bridge", "side", "node").distinct()
    size = m.groupBy(*_GROUP).agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"), F.max("bridge").alias("b"))
    size = size.where(F.when(F.col("b"), (F.col("n0") > 0) & (F.col("n1") > 0)).otherwise(F.col("n0") > 1))
    here, there = (F.when(F.col("side") == s, F.col("n0")).otherwise(F.col("n1")) for s in (0, 1))
    return m.join(size, _GROUP).select(*_GROUP, "bridge", "side", "node", here.alias("here"), F.when(F.col("bridge"), there).otherwise(F.col("n0")).alias("there"))


def sibling_budget(graph: DataFrame, most: int = MOST_SIBLINGS, asked: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(node, kind, group, size, before): the groups that a node's siblings come from, the smallest first, then by kind and
    group, until there are `most` different members, the node itself included; `before` counts those of the groups before.

    The last group is taken whole. Groups that add nobody new are left out. Only groups of fewer than `most` members are
    multiplied out, so this is at most `most` rows a membership; of the larger ones a node takes the first or none. A
    node in very many groups is settled in parts first: within a part, too, the groups behind `most` members aren't needed.
    With asked (node), only for these."""
    every = graph.where("not bridge").select(*_GROUP, "node", F.col("here").alias("size"))
    own = every if asked is None else every.join(asked.select("node").distinct(), "node", "left_semi")
    key = F.struct("size", *_GROUP)
    small = own.where(F.col("size") < most)
    pairs = small.join(every.where(F.col("size") < most).select(*_GROUP, F.col("node").alias("other")), _GROUP)
    new = pairs.groupBy("node", "other").agg(F.min(key).alias("k")).groupBy("node", "k").agg(F.count("*").alias("new"))
    # whichever large group comes first ends the list, whoever is in it
    large = own.where(F.col("size") >= most).groupBy("node").agg(F.min(key).alias("k")).select("node", "k", F.lit(most).cast("long").alias("new"))
    parts = parts or int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def within(df: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("before", F.coalesce(F.sum("new").over(w), F.lit(0))).where(F.col("before") < most)

    kept = within(within(new.unionByName(large).withColumn("part", F.pmod(F.xxhash64("k"), F.lit(parts))), "node", "part"), "node")
    return kept.select("node", "k.kind", "k.group", "k.size", F.col("before").cast("long").alias("before"))


def neighbours(graph: DataFrame, asked: DataFrame, most: int = MOST_SIBLINGS) -> DataFrame:
    """(node, neighbour, bridged): the neighbours of the asked nodes (node): all over bridges, siblings within the budget.

    A neighbour found in both ways is bridged. Nodes that are in no group, and nulls, have no neighbours. Both sides carry
    all of their groups, bridges first, so a pair is given once, where its first shared group is, and pairs aren't shuffled:
    they grow with the square of a group. A group's members are dealt into parts."""
    ask = asked.select("node").distinct()
    place = lambda side: F.struct((~F.col("bridge")).alias("sibling"), *_GROUP, side.cast("int").alias("side")).alias("k")
    near = sibling_budget(graph, most, ask).select("node", F.lit(False).alias("bridge"), *_GROUP).select("node", place(F.lit(0)))
    over = graph.where("bridge").join(ask, "node", "left_semi").select("node", place(1 - F.col("side")))
    own = near.unionByName(over).groupBy("node").agg(F.sort_array(F.collect_set("k")).alias("mine"))
    own = own.select("node", "mine", F.explode("mine").alias("k")).select("node", "mine", "k", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    them = graph.select(F.col("node").alias("neighbour"), place(F.col("side"))).groupBy("neighbour").agg(F.sort_array(F.collect_set("k")).alias("theirs"))
    them = them.select("neighbour", "theirs", F.explode("theirs").alias("k"), F.pmod(F.xxhash64("neighbour"), F.lit(PARTS)).cast("int").alias("part"))
    first = (F.element_at("mine", 1) == F.col("k")) | (F.element_at(F.array_intersect("mine", "theirs"), 1) == F.col("k"))
    return them.join(own.hint("shuffle_hash"), ["k", "part"]).where("node <> neighbour").where(first).select("node", "neighbour", (~F.col("k.sibling")).alias("bridged"))


def label_depths(labels: DataFrame) -> DataFrame:
    """(label, depth) of (label, parent): roots, and labels whose parent isn't one, have depth 0."""
    edges = labels.join(labels.select(F.col("label").alias("parent")), "parent", "left_semi").select("label", "parent").where("label <> parent")
    known = written(labels.select("label").distinct().join(edges, "label", "left_anti").withColumn("depth", F.lit(0)))
    front = known
    while not front.isEmpty():
        below = edges.join(front.select(F.col("label").alias("parent"), "depth"), "parent").groupBy("label").agg((F.min("depth") + 1).alias("depth"))
        front = written(below.join(known, "label", "left_anti"))
        known = written(known.unionByName(front))
    return known


def labelled(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, label, depth): of the labels whose root a node is or lies below, the deepest label, then the smallest.

    edges: (child, parent), a node may have many parents; roots: (node, label, depth), depth that of the label among
    labels. Labels go down as a frontier: a round joins only the nodes whose label has become better with their children,
    so an edge is looked at once for each time that its parent improves, and cycles end by themselves. Each round is
    written; the driver sees only whether it was empty."""
    rank = F.struct((-F.col("depth")).alias("depth"), "label")
    down = written(edges.select(F.col("parent").alias("node"), "child").where("node is not null and child is not null and node <> child").distinct())
    known = written(roots.where("node is not null").groupBy("node").agg(F.min(rank).alias("k")))
    front = known
    while not front.isEmpty():
        reached = front.join(down, "node").groupBy(F.col("child").alias("node")).agg(F.min("k").alias("new"))
        front = written(reached.join(known, "node", "left").where(F.col("k").isNull() | (F.col("new") < F.col("k"))).select("node", F.col("new").alias("k")))
        known = written(known.unionByName(front).groupBy("node").agg(F.min("k").alias("k")))
    return known.select("node", "k.label", (-F.col("k.depth")).alias("depth"))


def assigned(nodes: DataFrame, found: DataFrame, sites: DataFrame | None = None, bridge: DataFrame | None = None) -> DataFrame:
    """(node, label, way) of nodes (node): by descent, else by the first of its sites with a label, else over a bridge.

    sites: (node, site, position), a second kind of edge that counts only where descent gives nothing; bridge: (node,
    other, position) to nodes of another system, the first that descent or a site labels. Equal positions go by the name
    of what they lead to. Nodes without any label are left out."""
    label = found.select("node", "label")
    direct = nodes.select("node").distinct().join(label, "node").withColumn("way", F.lit("descent"))

    def first_of(steps: DataFrame, to: str, known: DataFrame) -> DataFrame:
        return steps.join(known.select(F.col("node").alias(to), "label"), to).groupBy("node").agg(F.min_by("label", F.struct("position", to)).alias("label"))

    every = label
    if sites is not None:
        by_site = first_of(sites.join(label, "node", "left_anti"), "site", label)
        every = label.unionByName(by_site)
        direct = direct.unionByName(nodes.select("node").distinct().join(by_site, "node").withColumn("way", F.lit("site")))
    if bridge is not None:
        over = first_of(bridge.join(every, "node", "left_anti"), "other", every)
        direct = direct.unionByName(nodes.select("node").distinct().join(over, "node").withColumn("way", F.lit("bridge")))
    return direct


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of (a, b) reaches, by large-star and small-star contraction.

    Every step groups by a node for its smallest neighbour, combined before the shuffle, and joins that one row back, so a
    hub's edges can be dealt out (adaptive execution splits them, as the other side has one row). Rounds grow with the
    logarithm of the longest path; each is written."""
    e = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    loops, e = e.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component")), written(e.where("a <> b"))
    state = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: whoever is larger than the centre joins the centre's smallest neighbour
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: the smaller neighbours and the centre join the smallest of them
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).where("a <> b")
        e = written(small.distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    found = e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).unionByName(loops)
    return found.groupBy("node").agg(F.min("component").alias("component"))


def merged(names: DataFrame, bridges: DataFrame, core: DataFrame | None = None, anchor: str = "snomed", middle: str = "loinc", far: str = "rxnorm", kept: DataFrame | None = None) -> DataFrame:
    """(name, system, code, bridged): the codes of each name, its own and those that bridges bring.

    names: (name, system, code). core: (name, code) of the middle system; codes that no name has come in under their own
    names. bridges: (kind, left_system, left_code, right_system, right_code); similarity bridges are never followed.
    Codes of the anchor bring those of the middle and the far system, then all codes of the middle bring the far ones; a
    code that a name has itself isn't bridged. Names with anchor codes only stay if one of these is in kept (code)."""
    own = names.select("name", "system", "code").distinct()
    if core is not None:
        orphans = core.join(own.where(F.col("system") == middle).select("code"), "code", "left_anti")
        own = own.unionByName(orphans.select("name", F.lit(middle).alias("system"), "code")).distinct()
    b = bridges.where(F.col("kind") != "jaccard").select("left_system", "left_code", "right_system", "right_code").distinct()

    def over(rows: DataFrame, left: str, rights: tuple[str, ...]) -> DataFrame:
        step = b.where((F.col("left_system") == left) & F.col("right_system").isin(*rights)).select(F.col("left_code").alias("code"), F.col("right_system").alias("to"), F.col("right_code").alias("brought"))
        return rows.where(F.col("system") == left).join(step, "code").select("name", F.col("to").alias("system"), F.col("brought").alias("code"))

    first = over(own, anchor, (middle, far)).distinct()
    second = over(own.unionByName(first), middle, (far,))
    brought = first.unionByName(second).distinct().join(own, ["name", "system", "code"], "left_anti")
    every = own.withColumn("bridged", F.lit(False)).unionByName(brought.withColumn("bridged", F.lit(True)))
    held = F.col("system") != anchor
    if kept is not None:
        mark = kept.select(F.lit(anchor).alias("system"), "code").distinct().withColumn("kept", F.lit(True))
        every = every.join(mark, ["system", "code"], "left")
        held = held | F.coalesce("kept", F.lit(False))
    good = every.groupBy("name").agg(F.bool_or(held).alias("good")).where("good").select("name")
    return every.join(good, "name", "left_semi").select("name", "system", "code", "bridged")


def without_subsets(concepts: DataFrame) -> DataFrame:
    """The names of (name, system, code) that no longer name absorbs.

    Longer names go first, of equally long ones the first. A name is absorbed if an earlier name that stays has one of its
    segments (split at ;) and all of its codes. A candidate that has all codes has the rarest one, too, so pairs are made
    on segment and rarest code only. What stays is settled in rounds: a name goes once one that absorbs it stays, and stays
    once all that would absorb it have gone."""
    n = concepts.select("name", F.struct("system", "code").alias("c")).distinct()
    df = n.groupBy("c").agg(F.count("*").alias("df"))
    rare = n.join(df, "c").groupBy("name").agg(F.min_by("c", F.struct("df", "c")).alias("c"), F.count("*").alias("n"))
    segment = F.explode(F.array_distinct(F.filter(F.transform(F.split("name", ";"), lambda s: F.trim(s)), lambda s: s != ""))).alias("seg")
    asks, has = rare.select("name", "c", "n", segment), n.select("name", "c", segment).withColumnRenamed("name", "by")
    before = (F.length("by") > F.length("name")) | ((F.length("by") == F.length("name")) & (F.col("by") < F.col("name")))
    near = asks.join(has, ["seg", "c"]).where(before).select("name", "n", "by").distinct()
    shared = near.join(n, "name").join(n.select(F.col("name").alias("by"), "c"), ["by", "c"]).groupBy("name", "by").agg(F.count("*").alias("common"), F.first("n").alias("n"))
    open_ = written(shared.where("common = n").select("name", "by"))
    stays = written(rare.select("name").join(open_, "name", "left_anti"))
    while not open_.isEmpty():
        gone = written(open_.join(stays.select(F.col("name").alias("by")), "by", "left_semi").select("name").distinct())
        left = open_.join(gone, "name", "left_anti").join(gone.select(F.col("name").alias("by")), "by", "left_anti")
        undecided = open_.select("name").distinct().join(gone, "name", "left_anti")
        stays = written(stays.unionByName(undecided.join(left, "name", "left_anti")))
        open_ = written(left)
    return stays


def prefix_groups(names: DataFrame, least: int = 2, blocked: tuple[str, ...] = ()) -> DataFrame:
    """(code, prefix, words, n): each name's longest prefix of whole words that at least `least` codes share.

    names: (code, name); words are parted by spaces, upper and lower case are the same, text behind a [ is left out, and
    of a prefix of several names with one code it counts once. Blocked prefixes group nobody, longer ones that begin with them may.
    A name is short, so its prefixes are few: they are the nodes of a trie, counted before they are shuffled."""
    words = F.filter(F.split(F.lower(F.trim(F.substring_index("name", "[", 1))), r"\s+"), lambda w: w != "")
    n = names.where("code is not null and name is not null").select("code", words.alias("w")).where(F.size("w") > 0)
    p = n.select("code", F.explode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.struct(i.alias("words"), F.array_join(F.slice("w", 1, i), " ").alias("prefix")))).alias("p")).select("code", "p.words", "p.prefix").distinct()
    p = p.where(~F.col("prefix").isin(*blocked)) if blocked else p
    shared = p.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return p.join(shared, "prefix").groupBy("code").agg(F.max(F.struct("words", F.col("n"), "prefix")).alias("r")).select("code", "r.prefix", F.col("r.words").cast("long").alias("words"), "r.n")
