"""Readers of vocabulary files: rich release format, release format 2, and tables with quoted multi-line cells.

They are Spark's own text readers with the formats' rules, so large files are read in ranges of bytes, and columns and
filters are pushed down. What stands on them gives the rows that the concept graph takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The columns of the files, in their order.
COLUMNS = {
    "MRCONSO": "CUI LAT TS LUI STT SUI ISPREF AUI SAUI SCUI SDUI SAB TTY CODE STR SRL SUPPRESS CVF",
    "MRREL": "CUI1 AUI1 STYPE1 REL CUI2 AUI2 STYPE2 RELA RUI SRUI SAB SL RG DIR SUPPRESS CVF",
    "relationship": "id effectiveTime active moduleId sourceId destinationId relationshipGroup typeId characteristicTypeId modifierId",
    "description": "id effectiveTime active moduleId conceptId languageCode typeId term caseSignificanceId",
}
#: The kinds of relationships, and the vocabularies by the names that the files give them.
IS_A, FINDING_SITE = "116680003", "363698007"
VOCABULARIES = {"SNOMEDCT_US": "snomed", "LNC": "loinc", "RXNORM": "rxnorm"}


def rich(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A file of the rich release format: cells end with |, nothing is quoted, all are text, and an empty cell is null."""
    names = COLUMNS[kind].split()
    return spark.read.csv(path, sep="|", quote="", escape="", schema=", ".join(f"`{n}` string" for n in [*names, "_end"])).select(*names)


def release2(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A file of release format 2: a header, cells parted by tabs, nothing is quoted."""
    return spark.read.csv(path, sep="\t", quote="", escape="", header=True, enforceSchema=True, schema=", ".join(f"`{n}` string" for n in COLUMNS[kind].split()))


def quoted(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header whose cells may be quoted, hold line feeds and doubled quotes."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')


def concept_codes(names: DataFrame, vocabularies: dict[str, str] = VOCABULARIES, language: str = "ENG") -> DataFrame:
    """(cui, system, code, name) of the names (MRCONSO) of some vocabularies that aren't suppressed."""
    system = F.create_map(*[F.lit(x) for kv in vocabularies.items() for x in kv])
    good = names.where(F.col("SAB").isin(*vocabularies) & (F.col("LAT") == language) & (F.col("SUPPRESS") == "N"))
    return good.select(F.col("CUI").alias("cui"), system[F.col("SAB")].alias("system"), F.col("CODE").alias("code"), F.col("STR").alias("name")).where("cui is not null and code is not null").distinct()


def is_a(relationships: DataFrame) -> DataFrame:
    """(child, parent) of the active is-a relationships."""
    return relationships.where((F.col("active") == "1") & (F.col("typeId") == IS_A)).select(F.col("sourceId").alias("child"), F.col("destinationId").alias("parent")).distinct()


def sites(relationships: DataFrame) -> DataFrame:
    """(node, site, position) of the active finding sites; positions go by the relationship's id."""
    s = relationships.where((F.col("active") == "1") & (F.col("typeId") == FINDING_SITE))
    w = Window.partitionBy("sourceId").orderBy(F.col("id").try_cast("decimal(38,0)"), "id", "destinationId")
    return s.select(F.col("sourceId").alias("node"), F.col("destinationId").alias("site"), F.row_number().over(w).cast("long").alias("position"))


def child_groups(edges: DataFrame, least: int = 2) -> DataFrame:
    """(group, code): the children of each parent that has several: siblings."""
    many = edges.groupBy("parent").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("parent")
    return edges.join(many, "parent").select(F.col("parent").alias("group"), F.col("child").alias("code"))
