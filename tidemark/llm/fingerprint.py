"""Order MinHash fingerprints, in DataFrame and SQL functions only.

A text's tokens are runs of at most TOKEN characters without white space. Of runs of more than LONG characters
(text without spaces), where such cuts would all move with one inserted character, the tokens are the TOKEN
characters from each position on; in shorter ones an edit moves the cuts to the run's end at most. Its k-mers are K tokens in a row,
numbered by their occurrence in the text, so repeats count. A numbered k-mer's hash falls in one of SLOTS
slots; of each slot the TUPLE smallest are selected, put back in text order, and hashed as a tuple. So two
texts share a slot's value where the same k-mers stand in the same order there: the share falls both with
other content and with content moved, as the edit distance does. The likeness of two fingerprints is the
share of equal slots among those that either fills.

Everything is computed within a row by array functions; sorting is on packed 64-bit numbers (a hash of 40
bits above a position of 24). Each step is a column of its own that the next one uses more than once, so
the optimizer computes it once a row.

Defined cases: null text is empty; a text without tokens has an empty fingerprint, like another empty one by
1.0 and any other by 0.0; fewer tokens than K make one k-mer; equal texts have equal fingerprints; the
positions of k-mers beyond 2**24 count as equal.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions_of, texts

K, SLOTS, TUPLE, TOKEN, LONG = 3, 64, 2, 12, 64
_PLACE = 24
_LOW = (1 << _PLACE) - 1
_SLOT_SHIFT = 64 - SLOTS.bit_length() + 1


def _tokens(text: str) -> str:
    plain = lambda x: f"regexp_extract_all({x}, '\\\\S{{1,{TOKEN}}}', 0)"
    runs = f"transform(regexp_extract_all({text}, '\\\\S+', 0), r -> if(length(r) > {LONG}, regexp_extract_all(r, '(?=(\\\\S{{{TOKEN}}}))\\\\S', 1), {plain('r')}))"
    return f"if({text} rlike '(?<!\\\\S)\\\\S{{{LONG + 1}}}', flatten({runs}), {plain(text)})"


def add_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the column `name`: an array of longs, one for each filled slot, in order of the slots."""
    a, b, c, d, e = (f"_{name}_{x}" for x in "abcde")
    follow = ", ".join(f"get(h, i + {j})" for j in range(1, K))
    df = df.withColumn(a, F.expr(f"sort_array(transform(array(transform({_tokens(text)}, t -> xxhash64(t))), h -> transform(slice(h, 1, if(size(h) < {K}, 1, size(h) - {K - 1})), (x, i) -> (xxhash64(x, {follow}) & {~_LOW}L) | least(i, {_LOW})))[0])"))
    # the first occurrence of each k-mer, and the others, numbered within their run
    df = df.withColumn(b, F.expr(f"filter({a}, (x, i) -> i > 0 and shiftright(x, {_PLACE}) = shiftright(get({a}, i - 1), {_PLACE}))"))
    first = f"transform(filter({a}, (x, i) -> i = 0 or shiftright(x, {_PLACE}) <> shiftright(get({a}, i - 1), {_PLACE})), x -> (xxhash64(shiftright(x, {_PLACE}), 0) & {~_LOW}L) | (x & {_LOW}L))"
    runs = f"filter(sequence(0, size({b}) - 1), j -> j = 0 or shiftright(get({b}, j), {_PLACE}) <> shiftright(get({b}, j - 1), {_PLACE}))"
    rest = f"if(size({b}) = 0, array(), flatten(transform(array({runs}), r -> transform(r, (s, j) -> transform(slice({b}, s + 1, coalesce(get(r, j + 1), size({b})) - s), (x, o) -> (xxhash64(shiftright(x, {_PLACE}), o + 1) & {~_LOW}L) | (x & {_LOW}L))))[0]))"
    df = df.withColumn(c, F.expr(f"sort_array(concat({first}, {rest}))"))
    slot = lambda x: f"shiftrightunsigned({x}, {_SLOT_SHIFT})"
    df = df.withColumn(d, F.expr(f"filter({c}, (x, i) -> i < {TUPLE} or {slot('x')} <> {slot(f'get({c}, i - {TUPLE})')})"))
    # of a slot the members in text order, hashed together
    df = df.withColumn(e, F.expr(f"filter(sequence(0, size({d})), j -> j < size({d}) and (j = 0 or {slot(f'get({d}, j)')} <> {slot(f'get({d}, j - 1)')}))"))
    members = f"array_sort(filter(slice({d}, j + 1, {TUPLE}), x -> {slot('x')} = {slot(f'get({d}, j)')}), (p, q) -> cast((p & {_LOW}L) - (q & {_LOW}L) as int))"
    value = f"transform({e}, j -> shiftleft({slot(f'get({d}, j)')}, 32) | (xxhash64(transform({members}, x -> shiftright(x, {_PLACE}))) & 4294967295L))"
    return df.withColumn(name, F.expr(value)).drop(a, b, c, d, e)


def as_text(column: str) -> Column:
    return F.expr(f"lower(array_join(transform({column}, x -> hex(x)), '.'))")


def likeness(a: str, b: str) -> Column:
    """Equal slots of two fingerprints among those that either fills; 1.0 for two empty ones."""
    union = f"size(array_union(transform({a}, x -> shiftright(x, 32)), transform({b}, x -> shiftright(x, 32))))"
    return F.expr(f"if(size({a}) = 0 and size({b}) = 0, 1.0D, size(array_intersect({a}, {b})) / cast({union} as double))")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, fingerprint) of the whole texts."""
    return add_fingerprint(texts(docs), "text", "fp").select("doc_id", as_text("fp").alias("fingerprint"))


def with_next(docs: DataFrame, columns: list[str], most_ranges: int = 65_536) -> DataFrame:
    """docs with `next`, a struct of the columns of the following row in descending doc_id, rows of one doc_id by text;
    after the last row comes the first. Rows without a doc_id are left out.

    Rows are dealt to ranges of ids of about equal size and follow each other by a window within a range. The
    first row of each range is sent to the range before, too; to know them, one id a range is broadcast."""
    ids = materialise(docs.where("doc_id is not null").select("doc_id").distinct(), "ids")
    ranges = min(most_ranges, max(8, 4 * partitions_of(docs)))
    cuts = sorted(set(ids.stat.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges))) or [0.0]
    cut = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="doc_id", outputCol="range")
    order = Window.orderBy("range")
    tops = cut.transform(ids).groupBy("range").agg(F.max("doc_id").alias("top"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.select("top", F.coalesce(F.lead("range").over(order), F.first("range").over(whole)).alias("above"))
    rows = cut.transform(docs.where("doc_id is not null")).join(F.broadcast(tops), F.col("doc_id") == F.col("top"), "left")
    copies = F.array_compact(F.array(F.struct(F.col("range"), F.lit(False).alias("copy")), F.when(F.col("top").isNotNull(), F.struct(F.col("above").alias("range"), F.lit(True).alias("copy")))))
    rows = rows.select(*docs.columns, F.explode(copies).alias("to")).select(*docs.columns, "to.range", "to.copy")
    within = Window.partitionBy("range").orderBy("copy", F.desc("doc_id"), "text")
    return rows.withColumn("next", F.lead(F.struct(*columns)).over(within)).where("not copy").drop("range", "copy")


def edited(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last third replaced by as many characters of the next document's beginning, in
    descending doc_id; after the last comes the first. Rows that share a doc_id follow each other in the order
    of their texts. A row without a doc_id has no next document: its edited text lacks the last third, and
    near_next is null."""
    own = add_fingerprint(texts(docs), "text", "fp")
    alone = own.where("doc_id is null").withColumn("next", F.lit(None).cast("struct<text:string,fp:array<bigint>>"))
    both = with_next(own, ["text", "fp"]).unionByName(alone)
    both = both.select("doc_id", "text", "fp", F.col("next.fp").alias("next_fp"), F.col("next.text").alias("head"), F.char_length("text").cast("long").alias("n_chars"))
    both = both.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 3 as int)), substring(coalesce(head, ''), 1, cast(n_chars div 3 as int)))"))
    out = add_fingerprint(both.select("doc_id", "n_chars", "fp", "next_fp", "edited", F.sha2("edited", 256).alias("edited_sha256")), "edited", "edited_fp")
    return out.select("doc_id", "n_chars", "edited_sha256", as_text("fp").alias("fingerprint"), as_text("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"), F.when(F.col("next_fp").isNotNull(), likeness("fp", "next_fp")).alias("near_next"))
