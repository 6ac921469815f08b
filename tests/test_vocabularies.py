"""Vocabulary files written from given tables and read back, ids of codes, and the table of ranges."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.functions import ranges, scalars
from tidemark.operators import concept_graph
from tidemark.sources import vocabularies


def test_rich_format_split_at_any_byte(spark, tmp_path):
    rows = [(f"C{r['p_partkey']}", 'a "quoted" | name'.replace("|", "/") + r["p_name"], "LNC" if i % 2 else "SNOMEDCT_US", "N" if i % 5 else "O", r["p_brand"] if i % 7 else "") for i, r in enumerate(spark.read.parquet(f"{SF}/part.parquet").collect())]
    names = vocabularies.COLUMNS["MRCONSO"].split()
    line = lambda c, name, sab, s, code: "".join(f"{ {'CUI': c, 'LAT': 'ENG', 'SAB': sab, 'STR': name, 'SUPPRESS': s, 'CODE': code}.get(n, '')}|" for n in names)
    path = tmp_path / "MRCONSO.RRF"
    path.write_text("".join(line(*r) + "\n" for r in rows), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in (701, 1999, 10**6):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            df = vocabularies.rich(spark, str(path), "MRCONSO")
            assert size > 10**5 or df.rdd.getNumPartitions() > 5
            got = sorted((r["CUI"], r["STR"], r["SAB"], r["SUPPRESS"], r["CODE"] or "") for r in df.collect())
            assert got == sorted(rows)
    finally:
        for key, value in zip(("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"), before, strict=True):
            spark.conf.set(key, value)
    codes = {tuple(r) for r in vocabularies.concept_codes(df).collect()}
    assert codes == {(c, "loinc" if sab == "LNC" else "snomed", code, name) for c, name, sab, s, code in rows if s == "N" and code}


def test_release_format_feeds_the_labels(spark, tmp_path):
    header = "\t".join(vocabularies.COLUMNS["relationship"].split())
    row = lambda i, active, a, b, kind: f"{i}\t20240101\t{active}\tm\t{a}\t{b}\t0\t{kind}\tc\tx"
    lines = [header, row(1, 1, 11, 1, vocabularies.IS_A), row(2, 1, 111, 11, vocabularies.IS_A), row(3, 0, 12, 1, vocabularies.IS_A), row(10, 1, 50, 12, vocabularies.FINDING_SITE), row(9, 1, 50, 111, vocabularies.FINDING_SITE), row(8, 0, 50, 11, vocabularies.FINDING_SITE), row(7, 1, 112, 11, vocabularies.IS_A), row(6, 1, 5, 6, '"other')]
    path = tmp_path / "sct2_Relationship.txt"
    path.write_text("\n".join(lines) + "\n")
    r = vocabularies.release2(spark, str(path), "relationship")
    assert r.count() == len(lines) - 1
    assert {tuple(x) for x in vocabularies.is_a(r).collect()} == {("11", "1"), ("111", "11"), ("112", "11")}
    assert {tuple(x) for x in vocabularies.sites(r).collect()} == {("50", "111", 1), ("50", "12", 2)}
    assert {tuple(x) for x in vocabularies.child_groups(vocabularies.is_a(r)).collect()} == {("11", "111"), ("11", "112")}
    found = concept_graph.labelled(vocabularies.is_a(r), spark.createDataFrame([("1", 7, 0), ("11", 8, 1)], "node string, label long, depth int"))
    nodes = spark.createDataFrame([("50",), ("111",), ("12",)], "node string")
    assert {tuple(x) for x in concept_graph.assigned(nodes, found, vocabularies.sites(r)).collect()} == {("111", 8, "descent"), ("50", 8, "site")}
    plan = vocabularies.is_a(r)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(active), IsNotNull(typeId), EqualTo(active,1)" in plan


def test_quoted_cells(spark, tmp_path):
    path = tmp_path / "core.csv"
    path.write_text('"NUM","NAME"\n"1-2","a ""b"", c"\n"3-4","two\nlines"\n')
    assert [tuple(r) for r in vocabularies.quoted(spark, str(path)).orderBy("NUM").collect()] == [("1-2", 'a "b", c'), ("3-4", "two\nlines")]


def test_ids_of_codes_and_collisions(spark):
    rows = [("LOINC", "718-7"), ("LOINC", "7187"), ("SNOMED_CT", "900000000000207008"), ("RXNORM", "12-3"), ("CVX", "208"), ("DCM", "110100"), ("DCM", "Ü"), ("DCM", None), ("nobody", "1"), (None, "1"), ("RXNORM", "x1"), ("RXNORM", None), ("RXNORM", "9" * 30), ("RXNORM", str(1 << 60)), ("CVX", "208")]
    ids = scalars.code_ids(spark.createDataFrame(rows, "system string, code string"))
    got = {(r["system"], r["code"]): r["id"] for r in ids.collect()}
    digest = lambda c: int.from_bytes(hashlib.blake2b(c.encode(), digest_size=8).digest(), "big") >> 4
    n = scalars.SYSTEMS
    want = dict.fromkeys(rows) | {("LOINC", "718-7"): n["LOINC"] << 60 | 7187, ("LOINC", "7187"): n["LOINC"] << 60 | 7187, ("SNOMED_CT", "900000000000207008"): 900000000000207008, ("RXNORM", "12-3"): n["RXNORM"] << 60 | 123, ("CVX", "208"): n["CVX"] << 60 | 208, ("DCM", "110100"): n["DCM"] << 60 | digest("110100"), ("DCM", "Ü"): n["DCM"] << 60 | digest("Ü")}
    assert got == want and ids.count() == len(rows)
    assert [tuple(r) for r in scalars.code_collisions(ids).collect()] == [(n["LOINC"] << 60 | 7187, "LOINC:718-7|LOINC:7187")]
    assert scalars.code_collisions(ids.where("1 = 0")).count() == 0


def test_every_range_has_both_bounds(spark):
    assert len(ranges.BOUNDS) == 120 and all(float(a) < float(b) for a, b in ranges.BOUNDS.values())
    rows = [(name, x) for name, (a, b) in ranges.BOUNDS.items() for x in (float(a), float(b), float(a) - 1, float(b) + 1)] + [("unknown", -1e9), ("steps", None)]
    broken = defaultdict(list)
    for r in scalars.validate(spark.createDataFrame(rows, "indicator string, num double")).withColumn("op", F.substring("reason", 1, 2)).collect():
        broken[r["indicator"]].append(r["op"])
    assert all(sorted(broken[name], key=str) == sorted([None, None, "<=", ">="] + [None] * (name == "steps"), key=str) for name in ranges.BOUNDS) and broken["unknown"] == [None]
