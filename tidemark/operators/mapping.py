"""Code mapping and backfills, upserts, genotype lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import base_name


def unique_codes(names: DataFrame) -> DataFrame:
    """(name, id) of names that stand for one id only."""
    return names.where("name is not null and name <> ''").groupBy("name").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")


def backfill(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """rows (indicator, fhir_id, ...) with missing ids filled from dictionary (name, id) by the name before the first dot."""
    d = dictionary.select(F.col("name").alias("_name"), F.col("id").alias("_id"))
    return rows.join(d, base_name(rows.indicator) == d._name, "left").withColumn("fhir_id", F.coalesce("fhir_id", "_id")).drop("_name", "_id")


def history_dictionary(rows: DataFrame) -> DataFrame:
    return unique_codes(rows.where("fhir_id is not null").select(base_name(F.col("indicator")).alias("name"), F.col("fhir_id").alias("id")))


def dominant(rows: DataFrame, percent: int = 99) -> DataFrame:
    """(name, id, n, total) where one id has at least `percent` of a name's mapped rows; of equal ones the smallest."""
    n = rows.where("id is not null").groupBy("name", "id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("name")
    return n.withColumn("total", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "id"))).where(f"r = 1 and n * 100 >= {percent} * total").drop("r")


def placeholders(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Names without a code that the dimension does not have yet."""
    return rows.where("fhir_id is null and indicator not in ('', 'nan')").select("indicator").distinct().join(known.select("indicator").distinct(), "indicator", "left_anti")


def registry_dictionary(codes: DataFrame) -> DataFrame:
    """(name, id) of the codes and short names of a registry (code, short_name, id) that stand for one id only."""
    names = codes.select(F.col("code").alias("name"), "id").union(codes.select("short_name", "id"))
    return unique_codes(names)


def delete_by_source(rows: DataFrame, sources: list[str]) -> DataFrame:
    """rows without those of the sources; rows without a source stay."""
    return rows.where(F.col("source").isNull() | ~F.col("source").isin(sources))


def genetic_lookup(variants: DataFrame, rsids: list[str] | None = None, chromosome: str | None = None, position: int | None = None, genotype: str | None = None) -> DataFrame:
    """Variants (rsid, chromosome, position, genotype) by whatever is asked for."""
    out = variants.where(F.col("rsid").isin(rsids)) if rsids else variants
    for name, v in (("chromosome", chromosome), ("position", position), ("genotype", genotype)):
        out = out.where(F.col(name) == v) if v is not None else out
    return out


def upsert(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], order: str | None = None, stamp: str | None = None, filled: list[str] | None = None) -> DataFrame:
    """old merged with new by keys: the last new row of a key (by `order`) wins. With stamp, a row whose values stay
    the same keeps its old stamp. A null in the columns `filled` keeps the old value. Columns: keys, values, stamp."""
    cols = [*keys, *values, *([stamp] if stamp else [])]
    if order:
        w = Window.partitionBy(*keys).orderBy(F.desc(order))
        new = new.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    o, n = old.select(*cols).alias("o"), new.select(*cols).alias("n")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    fresh = F.col("n._here").isNotNull()
    both = old.select(*cols, F.lit(1).alias("_here")).alias("o").join(new.select(*cols, F.lit(1).alias("_here")).alias("n"), on, "full")
    changed = F.lit(False)
    for v in values:
        changed = changed | ~F.col(f"o.{v}").eqNullSafe(F.col(f"n.{v}"))
    out = [F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in keys]
    out += [(F.coalesce(F.col(f"n.{v}"), F.col(f"o.{v}")) if v in (filled or ()) else F.when(fresh, F.col(f"n.{v}")).otherwise(F.col(f"o.{v}"))).alias(v) for v in values]
    if stamp:
        out.append(F.when(fresh & (F.col("o._here").isNull() | changed), F.col(f"n.{stamp}")).otherwise(F.col(f"o.{stamp}")).alias(stamp))
    return both.select(*out)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def nearby(points: DataFrame, asked: DataFrame, reach: int, top: int) -> DataFrame:
    """For each asked (group, position, id) the `top` points of its group nearest within `reach`, not asked themselves.

    Positions are whole numbers, so of the points at one only the first `top` by id can be among the nearest, and a bin as
    wide as the reach is an array of at most reach * top points, however crowded it is. Each asked position looks into
    three bins, and takes the best of each within the row."""
    bin_ = lambda c: F.floor(c / reach)
    p = points.join(asked.select(F.col("id")), "id", "left_anti").select(F.col("grp").alias("g"), F.col("position").alias("at"), F.col("id").alias("near")).where("g is not null and at is not null")
    p = p.withColumn("r", F.row_number().over(Window.partitionBy("g", "at").orderBy("near"))).where(F.col("r") <= top)
    p = p.groupBy("g", bin_(F.col("at")).alias("bin")).agg(F.collect_list(F.struct("at", "near")).alias("points"))
    a = asked.select(F.col("grp").alias("g"), "position", "id", F.explode(F.array(*[bin_(F.col("position")) + i for i in (-1, 0, 1)])).alias("bin"))
    near = F.filter(F.transform("points", lambda x: F.struct(F.abs(x.at - F.col("position")).alias("distance"), x.near.alias("near"))), lambda x: x.distance <= reach)
    j = a.join(p, ["g", "bin"]).select("g", "id", F.explode(F.slice(F.sort_array(near), 1, top)).alias("n")).select("g", "id", "n.*")
    w = Window.partitionBy("g", "id").orderBy("distance", "near")
    return j.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).select(F.col("g").alias("grp"), "id", "near", "distance")


def page(df: DataFrame, order: list[Column | str], number: int, size: int) -> DataFrame:
    """One page of a list, which is what a caller asks for."""
    return df.orderBy(*order).offset(number * size).limit(size)
