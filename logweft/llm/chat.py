r"""Chat formatting that is proved by reading it back.

A turn is written as its role's opening mark, its text and the closing mark.
Inside texts a backslash, ``<`` and ``[`` can be written ``\e``, ``\l`` and
``\b``.  A text is first left as it is; if it holds a control string or one of
these escapes, its backslashes and control strings are escaped; if the parser
still does not give the source back, every backslash, ``<`` and ``[`` is.  Then
the whole conversation is read back and compared, role by role and text by
text; one that is not identical has all its texts escaped in full and is
compared once more, and what still differs is an error, never a silent row.

The parser is one regular expression over the whole conversation, and it sees
nothing but the output.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running

#: The template's marks by role, fixed values; any other role is named in its mark.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<<ROLE ", ">>", "<</ROLE>>")
CONTROLS = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<<ROLE ", "<</ROLE>>"]
TURN = r"(?s)<<SYS>>.*?<</SYS>>|\[INST\].*?\[/INST\]|<s>.*?</s>|<<ROLE [^>]*>>.*?<</ROLE>>"
ESCAPES = [("\\", "\\e"), ("<", "\\l"), ("[", "\\b")]


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def unescaped(body: Column) -> Column:
    """The backslash last: an escaped one never makes another escape with what follows it."""
    return replaced(body, [("\\l", "<"), ("\\b", "["), ("\\g", ">"), ("\\e", "\\")])


def escaped_controls(text: Column) -> Column:
    return replaced(text, [("\\", "\\e"), *((c, c.replace("<", "\\l").replace("[", "\\b")) for c in CONTROLS)])


def escaped_all(text: Column) -> Column:
    return replaced(text, ESCAPES)


def any_of(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def opening(role: Column) -> Column:
    other = F.concat(F.lit(OTHER[0]), F.replace(escaped_all(role), F.lit(">"), F.lit("\\g")), F.lit(OTHER[1]))
    return reduce(lambda c, r: F.when(role == r, F.lit(MARKS[r][0])).otherwise(c), MARKS, other)


def closing(role: Column) -> Column:
    return reduce(lambda c, r: F.when(role == r, F.lit(MARKS[r][1])).otherwise(c), MARKS, F.lit(OTHER[2]))


def parsed_turn(turn: Column) -> Column:
    """struct(role, body): of one whole turn as the parser found it; the body is still escaped."""
    def between(a: str, b: str) -> Column:
        return F.substring(turn, F.lit(len(a) + 1), F.length(turn) - len(a) - len(b))

    rest = between(OTHER[0], OTHER[2])
    name = F.substring_index(rest, OTHER[1], 1)
    got = F.struct(unescaped(name).alias("role"), F.substring(rest, F.length(name) + len(OTHER[1]) + 1, F.length(rest)).alias("body"))
    for role, (a, b) in MARKS.items():
        got = F.when(F.startswith(turn, F.lit(a)), F.struct(F.lit(role).alias("role"), between(a, b).alias("body"))).otherwise(got)
    return got


def parse(formatted: Column) -> Column:
    """array<struct(role, body)> of a formatted conversation; null if any of it is not part of a turn."""
    turns = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))
    return F.when(F.array_join(turns, "") == formatted, F.transform(turns, parsed_turn))


def returns(written: Column, role: Column, text: Column) -> Column:
    """Whether the parser gives exactly this one turn back."""
    got = parse(written)
    return F.coalesce((F.size(got) == 1) & (got[0]["role"] == role) & (unescaped(got[0]["body"]) == text), F.lit(False))


def loss_text(formatted: Column, spans: Column) -> Column:
    """What the loss mask covers: the spans' pieces of ``formatted``, each unescaped, in their order."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")


TURNS = "array<struct<role:string,text:string>>"


def written(role: Column, text: Column) -> Column:
    """A turn's body: as little escaped as gives the turn back."""
    plain = ~any_of(text, [*CONTROLS, "\\e", "\\l", "\\b", "\\g"])
    first = F.when(plain, text).otherwise(escaped_controls(text))
    return let(first, lambda body: F.when(returns(F.concat(opening(role), body, closing(role)), role, text), body).otherwise(escaped_all(text)))


def read_back(formatted: Column) -> Column:
    """array<struct(role, text)> as the parser finds it, or null."""
    return F.transform(parse(formatted), lambda t: F.struct(t["role"].alias("role"), unescaped(t["body"]).alias("text"))).cast(TURNS)


def rendered(turns: Column, bodies: Column) -> Column:
    """struct(formatted, turns, loss_spans) of turns (role, text) with these bodies; turns are null where they are not read back."""
    pieces = F.flatten(F.zip_with(turns, bodies, lambda t, b: F.array(opening(t["role"]), b, closing(t["role"]))))

    def whole(p: Column) -> Column:
        def spans(ends: Column) -> Column:
            span = lambda t, i: F.when(t["role"] == "assistant", F.struct(F.get(ends, 3 * i).alias("start"), F.get(ends, 3 * i + 1).alias("end")))
            return F.filter(F.transform(turns, span), lambda s: s.isNotNull())

        text = F.array_join(p, "")
        return F.struct(text.alias("formatted"), let(running(F.transform(p, lambda x: F.length(x))), spans).alias("loss_spans"))

    made = let(pieces, whole)
    return let(made, lambda m: F.struct(m["formatted"].alias("formatted"), F.when(F.coalesce(read_back(m["formatted"]) == turns, F.lit(False)), turns).alias("turns"), m["loss_spans"].alias("loss_spans")))


def format_conversations(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_col``, formatted, turns (read back), loss_spans.

    turns is array<struct(role, text)>, parsed from ``formatted`` and unescaped;
    loss_spans is array<struct(start, end)>: the assistants' bodies as code
    point ranges of ``formatted``.  Rows go by turn; nulls come first and ties
    by role, then text.  Null texts and roles are empty; rows with a null
    conversation id form one conversation.  Repeated rows are turns of their
    own.  Other columns are not read, so they cannot clash.  A conversation
    is one string by definition, so its turns meet in one task.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    whole = rows.select(F.col(conv_col).alias("conv"), row.alias("row")).groupBy("conv").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    told = F.transform("rows", lambda r: F.struct(F.coalesce(r["role"], F.lit("")).alias("role"), F.coalesce(r["text"], F.lit("")).alias("text"))).cast(TURNS)
    first = whole.select("conv", told.alias("source")).withColumn("done", rendered(F.col("source"), F.transform("source", lambda t: written(t["role"], t["text"]))))
    again = rendered(F.col("source"), F.transform("source", lambda t: escaped_all(t["text"])))
    done = first.withColumn("done", F.when(F.col("done.turns").isNotNull(), F.col("done")).otherwise(again))
    lost = F.raise_error(F.lit("a conversation cannot be read back from its formatted text")).cast(TURNS)
    return done.select(F.col("conv").alias(conv_col), "done.formatted", F.coalesce("done.turns", lost).alias("turns"), "done.loss_spans")
