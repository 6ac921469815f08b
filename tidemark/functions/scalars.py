"""Scalar operators: units, names, ranges, times. Every one is a column expression, so it stays in the JVM."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.ranges import RANGES

#: One base unit is so many of each other one.
LINEAR_UNITS = {
    "kg": {"g": 1000, "lb": 2.20462, "oz": 35.274}, "m": {"cm": 100, "mm": 1000, "km": 0.001, "ft": 3.28084, "in": 39.3701}, "ms": {"s": 0.001, "min": 1 / 60000, "h": 1 / 3600000, "rmssd": 1},
    "min": {"minutes": 1, "s": 60, "ms": 60000, "h": 1 / 60}, "s": {"seconds": 1, "ms": 1000, "min": 1 / 60, "h": 1 / 3600}, "h": {"hours": 1, "min": 60, "s": 3600, "ms": 3.6e6},
    "mmHg": {"kPa": 0.133322, "psi": 0.0193368}, "kcal": {"cal": 1000, "kJ": 4.184, "J": 4184}, "mg/dL": {"g/L": 0.01}, "g/L": {"mg/dL": 100, "mg/L": 1000},
    "count/min": {"bpm": 1, "/min": 1, "breaths/min": 1, "Hz": 1 / 60}, "%": {"ratio": 0.01, "spo2": 1, "percent": 1}, "L": {"mL": 1000, "ml": 1000, "cup": 4.22675}, "m/s": {"km/hr": 3.6}, "L/min/kg": {"mL/(min·kg)": 1000, "mL/kg/min": 1000},
}
#: Conversions of one indicator: value * scale + offset.
SPECIFIC = [("waters", "g", "L", 0.001, 0.0), ("waters", "kg", "L", 1.0, 0.0), ("oxygenSaturations", "mmHg", "%", 0.7, 30.0), ("bloodGlucoses", "mmol/L", "mg/dL", 18.0182, 0.0), ("totalCholesterols", "mg/dL", "mmol/L", 0.02586, 0.0), ("totalCholesterols", "g/L", "mmol/L", 2.586, 0.0)]


def unit_pairs() -> list[tuple[str, str, float]]:
    """(from, to, factor) for all pairs within a group of units; the first rule for a pair wins."""
    out: dict[tuple[str, str], float] = {}
    for base, others in LINEAR_UNITS.items():
        for u, f in others.items():
            out.setdefault((base, u), f)
            out.setdefault((u, base), 1 / f)
    for others in LINEAR_UNITS.values():
        for a, x in others.items():
            for b, y in others.items():
                if a != b:
                    out.setdefault((a, b), y / x)
    return [(a, b, float(f)) for (a, b), f in out.items()]


def units_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(unit_pairs(), "from_unit string, to_unit string, factor double")


def temperature(value: Column, unit: Column, to: Column) -> Column:
    """Celsius, Fahrenheit and kelvin, by any of their names."""
    kind = lambda u: F.when(u.isin("degC", "°C", "C"), "C").when(u.isin("degF", "°F", "F"), "F").when(u == "K", "K")
    celsius = F.when(kind(unit) == "C", value).when(kind(unit) == "F", (value - 32) * 5 / 9).when(kind(unit) == "K", value - 273.15)
    return F.when(kind(to) == "C", celsius).when(kind(to) == "F", celsius * 9 / 5 + 32).when(kind(to) == "K", celsius + 273.15)


def convert(df: DataFrame) -> DataFrame:
    """df (indicator, value, unit, to_unit) with converted and ok: same unit, the indicator's own rule, temperature, factor, in this order; else the value stays."""
    spark = df.sparkSession
    own = spark.createDataFrame(SPECIFIC, "_i string, _f string, _t string, scale double, shift double")
    df = df.join(F.broadcast(own), (df.indicator == own._i) & (df.unit == own._f) & (df.to_unit == own._t), "left")
    u = units_table(spark)
    df = df.join(F.broadcast(u), (df.unit == u.from_unit) & (df.to_unit == u.to_unit), "left").drop(u.to_unit)
    x = F.when(F.col("unit").isNull() | (F.col("unit") == "") | (F.col("unit") == F.col("to_unit")), F.col("value"))
    got = F.coalesce(x, F.col("value") * F.col("scale") + F.col("shift"), temperature(F.col("value"), F.col("unit"), F.col("to_unit")), F.col("value") * F.col("factor"))
    return df.withColumn("ok", got.isNotNull()).withColumn("converted", F.coalesce(got, F.col("value"))).drop("_i", "_f", "_t", "scale", "shift", "from_unit", "factor")


def percent_fix(value: Column, unit: Column, source: Column) -> Column:
    return F.when((source == "apple_health") & (unit == "%"), value * 100).otherwise(value)


def parse_rules(rules: Column) -> Column:
    """Text of comma-joined rules to an array of (op, bound); what is no rule is passed over."""
    one = lambda r: F.struct(F.regexp_extract(r, r"^\s*(>=|<=|>|<|=)", 1).alias("op"), F.regexp_extract(r, r"^\s*(?:>=|<=|>|<|=)\s*(-?[\d.]+)\s*$", 1).try_cast("double").alias("bound"))
    return F.filter(F.transform(F.split(rules, ","), one), lambda r: (r["op"] != "") & r["bound"].isNotNull())


def first_broken(value: Column, rules: Column) -> Column:
    """The first rule that a value breaks, or null; a null value or no rules break none."""
    broken = lambda r: ~F.when(r["op"] == ">=", value >= r["bound"]).when(r["op"] == "<=", value <= r["bound"]).when(r["op"] == ">", value > r["bound"]).when(r["op"] == "<", value < r["bound"]).otherwise(value == r["bound"])
    bad = F.get(F.filter(rules, broken), F.lit(0))
    return F.when(value.isNotNull() & bad.isNotNull(), F.concat(bad["op"], bad["bound"].cast("string")))


def validate(df: DataFrame) -> DataFrame:
    """df (indicator, num) with reason: the first rule of its indicator's range that the number breaks."""
    t = df.sparkSession.createDataFrame(list(RANGES.items()), "_i string, _rules string")
    df = df.join(F.broadcast(t), df.indicator == t._i, "left")
    return df.withColumn("reason", first_broken(F.col("num").cast("double"), parse_rules(F.col("_rules")))).drop("_i", "_rules")


def base_name(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def base_indicator(name: Column) -> Column:
    """The indicator that a summary's name is made from: daily_stats_x_Method, dailyMethodX, else without suffix."""
    n = base_name(name)
    inner = F.regexp_extract(n, r"^daily(?:Avg|Max|Min|Total|Last|Stddev|Count)([A-Z].*)$", 1)
    stats = F.regexp_extract(n, r"^daily_stats_(.*?)(?:Sum|Avg|Max|Min|Last)$", 1)
    return F.when(stats != "", stats).when(inner != "", F.concat(F.lower(F.substring(inner, 1, 1)), F.substring(inner, 2, 1000))).otherwise(n)


def vendor_time(text: Column) -> Column:
    """Seconds (to 1e10), milliseconds or ISO text to a timestamp; null where it is none of them."""
    n = text.try_cast("double")
    return F.when(n.isNotNull(), F.when(n <= 1e10, F.timestamp_micros((n * 1_000_000).cast("long"))).otherwise(F.timestamp_micros((n * 1000).cast("long")))).otherwise(F.try_to_timestamp(text))


#: Zones that fixed offsets in seconds stand for.
OFFSETS = {28800: "Asia/Shanghai", 32400: "Asia/Tokyo", 19800: "Asia/Kolkata", 25200: "Asia/Bangkok", 21600: "Asia/Dhaka", 14400: "Asia/Dubai", 10800: "Asia/Riyadh", 0: "UTC", 3600: "Europe/London", 7200: "Europe/Berlin", -18000: "America/New_York", -21600: "America/Chicago", -25200: "America/Denver", -28800: "America/Los_Angeles", -14400: "America/Halifax", -10800: "America/Sao_Paulo", 36000: "Australia/Sydney", 43200: "Pacific/Auckland"}


def zone_of(offset: Column) -> Column:
    """The zone of an offset in seconds, UTC for others and none."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in OFFSETS.items() for x in kv]), offset.cast("int")), F.lit("UTC"))


def smart_time(text: Column, zone: Column) -> Column:
    """ISO text to a UTC timestamp: an offset of its own counts; a date, or midnight without one, is local to the zone; else UTC."""
    offset = F.regexp_extract(text, r"T.*([+-]\d{2}:\d{2})$", 1)
    plain = F.regexp_replace(text, r"(Z|[+-]\d{2}:\d{2})$", "")
    naive = F.coalesce(F.try_to_timestamp(F.when(text.contains("T"), plain).otherwise(text)))
    midnight = F.date_format(naive, "HH:mm:ss") == "00:00:00"
    own = F.when(~offset.isin("", "+00:00", "-00:00"), offset)
    return F.when(own.isNotNull(), F.to_utc_timestamp(naive, own)).when(midnight, F.to_utc_timestamp(naive, zone)).otherwise(naive)


def widened(start: Column, end: Column) -> tuple[Column, Column]:
    """A day more on either side of a window: from the start of the day before to the end of the day after."""
    day = F.expr("INTERVAL 1 DAY")
    return F.date_trunc("day", start - day), F.date_trunc("day", end + day) + F.expr("INTERVAL 86399 SECONDS")


def component_base(component: Column) -> Column:
    """A component's name without what follows a caret (within brackets to their end) and its parts behind . and /."""
    text = F.regexp_replace(component, r"\^[^()]*?(?=\))", "")
    return F.lower(F.trim(F.regexp_extract(F.substring_index(text, "^", 1), r"^([^./]*)", 1)))


def calendar_range(name: Column, time: Column) -> tuple[Column, Column]:
    """Start and end that a summary's name gives its time: day, week from Monday, hour, or the moment itself."""
    low = F.lower(name)
    unit = F.when(low.contains("daily"), F.date_trunc("day", time)).when(low.contains("weekly"), F.date_trunc("week", time)).when(low.contains("hourly"), F.date_trunc("hour", time)).otherwise(time)
    span = F.when(low.contains("daily"), 86_399).when(low.contains("weekly"), 7 * 86_400 - 1).when(low.contains("hourly"), 3_599).otherwise(0)
    return unit, F.timestamp_seconds(F.unix_timestamp(unit) + span)


def age(birth: Column, on: Column) -> Column:
    return F.floor(F.months_between(on, birth) / 12).cast("int")


def pack(system: Column, code: Column) -> Column:
    """A code of 60 bits below its system of 3 bits."""
    return F.shiftleft(system.cast("long"), 60).bitwiseOR(code.cast("long").bitwiseAND(F.lit((1 << 60) - 1)))


def unpack(packed: Column) -> tuple[Column, Column]:
    return F.shiftright(packed, 60).bitwiseAND(F.lit(7)), packed.bitwiseAND(F.lit((1 << 60) - 1))


#: The numbers of systems in packed codes; codes of the hashed ones are no numbers.
SYSTEMS, HASHED = {"SNOMED_CT": 0, "LOINC": 1, "RXNORM": 2, "CVX": 3, "DCM": 4}, ("DCM",)


@F.pandas_udf(T.LongType())
def _digest60(code: pd.Series) -> pd.Series:
    """The upper 60 bits of the 8-byte blake2b digest of each code."""
    # as a list, since a series with nulls would become floats on its way
    return pd.Series([None if c is None else int.from_bytes(hashlib.blake2b(c.encode(), digest_size=8).digest(), "big") >> 4 for c in code], dtype="Int64")


def code_ids(rows: DataFrame, systems: dict[str, int] = SYSTEMS, hashed: tuple[str, ...] = HASHED) -> DataFrame:
    """rows (system, code) with id: the packed code, digests for hashed systems, else the number without dashes.

    An unknown system, a null, and a code of another system that is no number of at most 60 bits have a null id. Only the
    hashed rows go through Python, in Arrow batches."""
    number = F.regexp_replace("code", "-", "")
    plain = F.when(number.rlike("^[0-9]+$"), number.try_cast("long"))
    known = F.create_map(*[F.lit(x) for kv in systems.items() for x in kv])
    system = F.try_element_at(known, F.col("system"))
    hash_ = F.col("system").isin(*hashed) if hashed else F.lit(False)
    by_number = rows.where(~F.coalesce(hash_, F.lit(False))).withColumn("id", F.when(plain < (1 << 60), pack(system, plain)))
    by_digest = rows.where(hash_).withColumn("id", pack(system, _digest60(F.col("code").cast("string"))))
    return by_number.unionByName(by_digest)


def code_collisions(ids: DataFrame) -> DataFrame:
    """(id, codes): the ids of (system, code, id) that stand for several codes, with these, sorted."""
    one = ids.where("id is not null").select("id", F.concat_ws(":", "system", "code").alias("c")).distinct()
    return one.groupBy("id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("c")), "|").alias("codes")).where("n > 1").drop("n")


def tokens(text: Column, stop_words: list[str]) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))), F.array(*map(F.lit, stop_words)).cast("array<string>"))


def preview(text: Column, lines: int = 5, width: int = 1000) -> Column:
    """The first and last lines of a text, cut to a width."""
    parts = F.transform(F.split(text, "\n"), lambda x: F.substring(x, 1, width))
    return F.when(F.size(parts) <= 2 * lines, F.array_join(parts, "\n")).otherwise(F.concat_ws("\n", F.array_join(F.slice(parts, 1, lines), "\n"), F.lit("..."), F.array_join(F.slice(parts, -lines, lines), "\n")))


#: Abbreviations and what they stand for.
ABBREVIATIONS = {
    "Ab": "Antibody", "Ag": "Antigen", "AIDS": "Acquired immunodeficiency syndrome", "AJCC": "American Joint Committee on Cancer", "AP": "Anteroposterior", "ART": "Antiretroviral therapy", "BP": "Blood pressure", "CD": "Cluster of differentiation", "CDC": "Centers for Disease Control", "CNS": "Central nervous system",
    "CoA": "Coenzyme A", "CoV": "Coronavirus", "CSF": "Cerebrospinal fluid", "CT": "Computed tomography", "DNA": "Deoxyribonucleic acid", "ECG": "Electrocardiogram", "EDTA": "Ethylenediaminetetraacetic acid", "ENT": "Ear nose and throat", "FC": "Flow cytometry", "FH": "Family history",
    "FIGO": "International Federation of Gynecology and Obstetrics", "GE": "Gastroesophageal", "GP": "General practitioner", "Hct": "Hematocrit", "Hgb": "Hemoglobin", "HIV": "Human immunodeficiency virus", "HLA": "Human leukocyte antigen", "HTLV": "Human T-lymphotropic virus", "IA": "Immunoassay", "IgA": "Immunoglobulin A",
    "IgD": "Immunoglobulin D", "IgE": "Immunoglobulin E", "IgG": "Immunoglobulin G", "IgM": "Immunoglobulin M", "IV": "Intravenous", "MR": "Magnetic resonance", "MRA": "Magnetic resonance angiography", "MRI": "Magnetic resonance imaging", "NAA": "Nucleic acid amplification", "NM": "Nuclear medicine",
    "RAST": "Radioallergosorbent test", "RBC": "Red blood cells", "RF": "Rheumatoid factor", "RFA": "Radiofrequency ablation", "Rh": "Rhesus", "RNA": "Ribonucleic acid", "rRNA": "Ribosomal RNA", "SARS": "Severe acute respiratory syndrome", "TNM": "Tumor Node Metastasis", "UICC": "Union for International Cancer Control",
    "US": "Ultrasound", "WBC": "White blood cells", "WHO": "World Health Organization", "XR": "X-ray",
}


def expanded(text: Column, table: dict[str, str] = ABBREVIATIONS) -> Column:
    """The text with the full form in brackets behind each abbreviation that stands as a word; null stays null.

    One alternation, the longest first, finds them, so what is put in is not looked at again. The pieces between and the
    matches are two arrays that are zipped, which keeps it in the JVM. A word is of letters, digits and underscores."""
    at = r"(?<![\p{L}\p{N}_])(" + "|".join(f"\\Q{a}\\E" for a in sorted(table, key=len, reverse=True)) + r")(?![\p{L}\p{N}_])"
    full = F.create_map(*[F.lit(x) for a, name in table.items() for x in (a, f"{a} ({name})")])
    found = F.transform(F.regexp_extract_all(text, F.lit(at), F.lit(1)), lambda a: F.element_at(full, a))
    return F.array_join(F.flatten(F.zip_with(F.split(text, at), found, lambda piece, a: F.array(piece, F.coalesce(a, F.lit(""))))), "")
