"""Chat formatting by grammar round trip: render, reparse, compare, escape until the turns come back as they were.

The template writes a turn as a piece <|im_start|>ROLE\\nTEXT<|im_end|>\\n. The parser is deterministic: the pieces of a
string are what stands between the end marks, a role ends at the first line feed, and in roles and texts every escape
is undone. A turn is first rendered as it is and parsed again; where the parser doesn't give back one turn with the
same role and text, what conflicts is escaped and the piece is tried again, ROUNDS times at most, and an error ends the
job if it still differs. Escaping puts one more backslash into each control string, so it can be undone from any depth:
  <|\\*im_start|> and <|\\*im_end|> get a backslash after "<|"; in roles a line feed becomes <|\\n|>, after <|\\*n|> got one.
Texts without conflict, nearly all, are written as they are.

Turns are rendered and verified row by row, before anything is grouped, so a conversation of any size is spread over
all tasks; one shuffle then brings a conversation's finished pieces together, as the formatted text is one value (of at
most 2 GB, Spark's bound of a string). Everything is built of DataFrame functions.

Defined cases: a null text is empty, a null role an empty role; turns go by turn, nulls first, then role, then text;
repeated rows are turns of their own; rows without a conv_id are one conversation with a null conv_id; other columns are
ignored, whatever their names; an empty table gives no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
#: Roles whose texts are trained on.
LEARNED = ("assistant",)
#: Renderings of a turn: as it is, then escaped.
ROUNDS = 2
_CONTROL, _LINE = r"<\|(\\*)(im_start|im_end)\|>", r"<\|(\\*)n\|>"


def escaped(text: Column) -> Column:
    """The text with one more backslash in each control string, escaped or not."""
    return F.regexp_replace(text, _CONTROL, r"<|\\$1$2|>")


def unescaped(text: Column) -> Column:
    """The text with one backslash less in each escaped control string."""
    return F.regexp_replace(text, r"<\|\\(\\*)(im_start|im_end)\|>", "<|$1$2|>")


def escaped_role(role: Column) -> Column:
    return F.replace(F.regexp_replace(escaped(role), _LINE, r"<|\\$1n|>"), F.lit("\n"), F.lit("<|n|>"))


def unescaped_role(role: Column) -> Column:
    """A line-feed mark without a backslash is a line feed; one with backslashes loses one."""
    return unescaped(F.regexp_replace(F.replace(role, F.lit("<|n|>"), F.lit("\n")), r"<\|\\(\\*)n\|>", "<|$1n|>"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def pieces(formatted: Column) -> Column:
    """The parser: an array of (role, text, learned, n_head, n_chars), roles and texts as they were, lengths as written; null if the string is no conversation."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    whole = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    head = len(START)

    def turn(p: Column) -> Column:
        at = F.locate("\n", p)
        role, text = unescaped_role(F.substring(p, F.lit(head + 1), at - head - 1)), F.substring(p, at + 1, F.length(p))
        return F.struct(role.alias("role"), unescaped(text).alias("text"), role.isin(*LEARNED).alias("learned"), at.alias("n_head"), F.length(text).alias("n_chars"))

    good = (F.element_at(parts, -1) == "") & F.forall(whole, lambda p: p.startswith(START) & (F.locate("\n", p) > head) & ~F.substring(p, F.lit(head + 1), F.length(p)).contains(START) & ~p.contains(END))
    return F.when(good, F.transform(whole, turn))


def _same(piece: Column, role: Column, text: Column) -> Column:
    """Whether the parser gives back exactly this turn."""
    back = pieces(piece)
    one = F.element_at(back, 1)
    return F.coalesce((F.size(back) == 1) & (one["role"] == role) & (one["text"] == text), F.lit(False))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, piece, escapes): each turn with its verified piece and how often it was escaped."""
    t = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tried, level = None, None
    for k in range(ROUNDS):
        role, text = (F.col("role"), F.col("text")) if k == 0 else (escaped_role(F.col("role")), escaped(F.col("text")))
        piece = rendered(role, text)
        good = _same(piece, F.col("role"), F.col("text"))
        tried, level = (F.when(good, piece), F.when(good, F.lit(0))) if tried is None else (tried.when(good, piece), level.when(good, F.lit(k)))
    failed = F.raise_error(F.concat(F.lit("a turn can't be written so that it is read back: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    return t.select("conv_id", "turn", "role", "text", tried.otherwise(failed.cast("string")).alias("piece"), level.alias("escapes"))


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, n_escaped): the formatted text of each conversation."""
    t = turns(conversations)
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn"), F.lit(-(2**63))).alias("turn"), "role", "text", "piece")))
    one = t.groupBy("conv_id").agg(ordered.alias("t"), F.sum("escapes").alias("n_escaped"))
    return one.select("conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), "n_escaped")


def parse(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): read back from the formatted text alone; an error ends the job where it is no conversation."""
    back = F.coalesce(pieces(F.col("formatted")), F.raise_error(F.lit("not a formatted conversation")).cast("array<struct<role:string,text:string,learned:boolean,n_head:int,n_chars:int>>"))
    return formatted.withColumn("turns", back)


def loss_spans(parsed: DataFrame) -> DataFrame:
    """(conv_id, start, n_chars): the code points of the formatted texts that are trained on, as they stand there, escapes included.

    A piece's start is the sum of the lengths before it, by a window over the conversation's pieces."""
    p = parsed.select("conv_id", F.posexplode("turns").alias("k", "t")).select("conv_id", "k", "t.*")
    before = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("n_head") + F.col("n_chars") + len(END) + 1).over(before), F.lit(0)) + F.col("n_head")
    return p.withColumn("start", start).where("learned").select("conv_id", F.col("start").cast("long").alias("start"), F.col("n_chars").cast("long").alias("n_chars"))


def digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the formatted texts."""
    p = parse(render(conversations))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: t["text"]), "")
    return p.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
