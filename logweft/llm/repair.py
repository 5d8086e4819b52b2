"""Repair of conversations: the cheapest edits that bring their turns into the order system?, then user and assistant in alternation.

The order is an automaton of four states.  What may be done to a turn (keep,
give another role, delete) is a 4 x 4 matrix over elements (cost, audit),
where the audit spells the edits; adding takes the smaller element, multiplying
adds costs and joins audits, and the matrix of a turn is closed under
insertions after it.  Two audits of equal cost over the same turns are never
one the start of the other (the longer one would hold insertions more, and
these cost), so their order survives joining: the products are associative and
a conversation is multiplied piece by piece, then by 16 pieces at a time, over
as many rounds as the longest conversation needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, group_key, numbered, places, saved

#: What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns in a piece, as a power of two, and pieces that meet in a round, too.
PIECE_BITS, ROUND_BITS = 8, 4
#: A turn's letter: the initial of its role (x: none that the order knows), in capitals where the text is cut off, a digit where the turn has to go.
PLAIN, CUT, GONE = "suax", "SUAX", "0123"
FAULTS = ("blank", "duplicate", "truncated")
ROLES = {"s": "system", "u": "user", "a": "assistant"}

# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.  A conversation may end in 0 and 3.
_START, _ENDS = 0, (0, 3)
_MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

Element = tuple[int, str]
Matrix = list[list[Element | None]]


def _smaller(a: Element | None, b: Element | None) -> Element | None:
    return b if a is None or b is not None and b < a else a


def times(a: Matrix, b: Matrix) -> Matrix:
    """The product of two matrices over (cost, audit)."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for k, x in enumerate(a[i]):
            if x is not None:
                for j, y in enumerate(b[k]):
                    if y is not None:
                        out[i][j] = _smaller(out[i][j], (x[0] + y[0], x[1] + y[1]))
    return out


def _insertions() -> Matrix:
    """What insertions alone reach: the closure of one inserted user or assistant turn."""
    one: Matrix = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
    for role in "ua":
        for i, j in _MOVES[role].items():
            one[i][j] = _smaller(one[i][j], (INSERT, "I"))
    return times(times(one, one), times(one, one))  # four steps pass every state


CLOSURE = _insertions()


@lru_cache(maxsize=None)  # twelve letters
def turn_matrix(letter: str) -> Matrix:
    """All that may be done with a turn, and insertions after it."""
    out: Matrix = [[(DELETE, "D") if i == j else None for j in range(4)] for i in range(4)]
    if letter not in GONE:
        own, extra = letter.lower(), TRUNCATED if letter in CUT else 0
        for role in "sua":
            for i, j in _MOVES[role].items():
                if role == own:
                    out[i][j] = _smaller(out[i][j], (extra, "K"))
                if role != "s":
                    out[i][j] = _smaller(out[i][j], (REROLE + extra, "R"))
    return times(out, CLOSURE)


class Piece(NamedTuple):
    """Neighbouring turns: their matrix, the initials at both ends, and how many neighbours inside do not follow each other."""

    matrix: Matrix
    first: str
    last: str
    illegal: int

    def text(self) -> str:
        """Written as ``first last illegal;cost audit,...``, as pieces travel between rounds."""
        cells = ("" if x is None else f"{x[0]} {x[1]}" for row in self.matrix for x in row)
        return f"{self.first}{self.last}{self.illegal};{','.join(cells)}"


def read_piece(text: str) -> Piece:
    head, cells = text.split(";")
    flat = [(int(c.split(" ")[0]), c.split(" ")[1]) if c else None for c in cells.split(",")]
    return Piece([flat[i : i + 4] for i in range(0, 16, 4)], head[0], head[1], int(head[2:]))


def _initial(letter: str) -> str:
    return PLAIN[GONE.index(letter)] if letter in GONE else letter.lower()


def _follows(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def joined(pieces: list[Piece]) -> Piece:
    """One piece of several, in order."""
    m = pieces[0].matrix
    for p in pieces[1:]:
        m = times(m, p.matrix)
    seams = sum(not _follows(a.last, b.first) for a, b in zip(pieces, pieces[1:]))
    return Piece(m, pieces[0].first, pieces[-1].last, sum(p.illegal for p in pieces) + seams)


@lru_cache(maxsize=20_000)  # of short texts only: at most some 100 MB of a worker
def _short_piece(letters: str) -> str:
    return joined([Piece(turn_matrix(c), _initial(c), _initial(c), 0) for c in letters]).text()


def piece_of(letters: str) -> str:
    """The piece of turns with these letters."""
    return _short_piece(letters) if len(letters) <= 12 else _short_piece.__wrapped__(letters)


def best(piece: Piece) -> Element:
    """The cheapest edits of a whole conversation."""
    row = times([CLOSURE[_START]] + [[None] * 4] * 3, piece.matrix)[0]
    return min(row[j] for j in _ENDS if row[j] is not None)


def _pieces(letters: pd.Series) -> pd.Series:
    return letters.map(piece_of)


def _together(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: joined([read_piece(t) for t in x]).text())


def _best(text: pd.Series) -> pd.DataFrame:
    pieces = [read_piece(t) for t in text]
    return pd.DataFrame([(*best(p), p.illegal) for p in pieces], columns=["cost", "audit", "illegal"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each edit of an audit; the order of roles follows from the number of turns that stay: an odd one starts with system."""
    block = 10_000
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, conv_id, audit in zip(*(batch[c].to_pylist() for c in ("conv", "conv_id", "audit"))):
            odd = (len(audit) - audit.count("D")) % 2
            place, out = 0, 0
            for start in range(0, len(audit), block):
                edits = audit[start : start + block]
                spots, roles = [], []
                for edit in edits:
                    spots.append(None if edit == "I" else place)
                    place += edit != "I"
                    roles.append(None if edit == "D" else ROLES["s" if odd and not out else "ua"[(out - odd) % 2]])
                    out += edit != "D"
                n = len(edits)
                columns = [pa.array([conv] * n, pa.string()), pa.array([conv_id] * n, kind), pa.array(range(start, start + n), pa.int64()), pa.array(spots, pa.int64()), pa.array(list(edits), pa.string()), pa.array(roles, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["conv", "conv_id", "step", "place", "edit", "due"])


class Repaired(NamedTuple):
    """``report``: a row for each conversation (``conv`` is the id as a text that is never null).

    ``turns``: a row for each turn of the repaired conversations (conv, conv_id, step, turn, role, text, edit); ``step`` is the place of its edit in the audit.
    """

    report: DataFrame
    turns: DataFrame


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repaired:
    """Faults, cheapest edits and repaired turns of every conversation.

    Turns are taken by number (nulls first), then role and text, so equal ones
    stand side by side.  A turn's first fault counts: ``blank`` (nothing but
    ASCII blanks), ``duplicate`` (role and text seen earlier in the
    conversation), ``truncated`` (the last character that is not blank is none
    of ``.!?``).  Null roles and texts are read as one space.  Roles are judged
    by their first letter, as the order is written in letters; a role that
    starts with another one, or is empty, has to change or go.  A null
    conversation id is an id of its own.  Kept turns keep their role and text,
    turns with another role keep their text, inserted ones are empty.  Of
    equally cheap repairs the one whose audit is least in ASCII is taken.
    ``gaps`` counts the numbers missing between the least and the largest turn,
    ``illegal`` the neighbours whose roles do not follow each other.

    A conversation may spread over any number of tasks; only its audit (a letter for
    each edit) stands in one row.  An empty table gives empty tables; further
    columns of ``rows`` are left aside, whatever their names.
    """
    plain = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    kept = numbered(plain.withColumn("conv", group_key(F.col("conv_id"))), "conv", ["turn", "role", "text"], "turns")
    coded = saved(_letters(kept), "turn-letters")

    faults = coded.groupBy("conv", "conv_id").agg(*(F.count_if(F.col("fault") == f).alias(f) for f in FAULTS))
    numbers = kept.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    cheapest = saved(_whole(coded).select("conv", "conv_id", F.pandas_udf(_best, "cost long, audit string, illegal long")("piece").alias("b")).select("conv", "conv_id", "b.*"), "audits")
    report = faults.join(numbers, "conv").join(cheapest.drop("conv_id"), "conv")

    schema = f"conv string, conv_id {kept.schema['conv_id'].dataType.simpleString()}, step long, place long, edit string, due string"
    edits = cheapest.select("conv", "conv_id", "audit").mapInArrow(_edits, schema)
    stay = edits.where("edit IN ('K', 'R')").join(coded.select("conv", "place", "_row"), ["conv", "place"]).drop("conv", "conv_id").join(kept, "_row")
    stay = stay.select("conv", "conv_id", "step", "turn", F.when(F.col("edit") == "K", F.col("role")).otherwise(F.col("due")).alias("role"), "text", "edit")
    new = edits.where("edit = 'I'").select("conv", "conv_id", "step", F.lit(None).cast(kept.schema["turn"].dataType).alias("turn"), F.col("due").alias("role"), F.lit("").alias("text"), "edit")
    return Repaired(report.select("conv", "conv_id", "gaps", *FAULTS, "illegal", "cost", "audit"), stay.unionByName(new))


def _letters(kept: DataFrame) -> DataFrame:
    """(conv, conv_id, place, of, _row, fault, letter) of every turn.

    What was said earlier is found without bringing equal turns together: each
    (conversation, role, text) is reduced to its first place, and turns meet
    that on (conversation, place), which is unique on both sides.
    """
    bare = F.rtrim(F.translate("text", BLANKS, " " * len(BLANKS)))
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(4)
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    slim = kept.select("conv", "conv_id", "_part", "_row", number.alias("role_number"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"), said.alias("said"))
    turns = saved(places(slim, "conv"), "turn-places")
    first = turns.groupBy("conv", "said").agg(F.min("place").alias("place")).select("conv", "place", F.lit(True).alias("fresh"))
    fault = F.when(F.col("blank"), "blank").when(F.col("fresh").isNull(), "duplicate").when(F.col("cut"), "truncated")
    letters = F.when(F.col("fault").isNull(), PLAIN).when(F.col("fault") == "truncated", CUT).otherwise(GONE)
    return turns.join(first, ["conv", "place"], "left").withColumn("fault", fault).select("conv", "conv_id", "place", "of", "_row", "fault", F.substring(letters, F.col("role_number"), F.lit(1)).alias("letter"))


def _whole(coded: DataFrame) -> DataFrame:
    """(conv, conv_id, piece) with one piece for each conversation: pieces of 256 turns, then 16 pieces in a round while any conversation has more than one."""

    def in_order(what: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct("at", what))), lambda x: x[what])

    ids = ["conv", "conv_id", "of"]
    bits = PIECE_BITS
    pieces = coded.withColumns({"in": F.shiftright("place", bits), "at": F.col("place")}).groupBy(*ids, "in").agg(F.array_join(in_order("letter"), "").alias("letters"))
    pieces = saved(pieces.select(*ids, "in", F.pandas_udf(_pieces, "string")("letters").alias("piece")), "pieces")
    done, longest = pieces.where(F.col("of") <= 2**bits), coded.agg(F.max("of")).first()[0] or 0
    while longest > 2**bits:
        more = pieces.where(F.col("of") > 2**bits).withColumns({"at": F.col("in"), "in": F.shiftright("in", ROUND_BITS)}).groupBy(*ids, "in").agg(in_order("piece").alias("row"))
        pieces = saved(more.select(*ids, "in", F.pandas_udf(_together, "string")("row").alias("piece")), "pieces")
        bits += ROUND_BITS
        done = done.unionByName(pieces.where(F.col("of") <= 2**bits))
    return done.select("conv", "conv_id", "piece")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation's turns, which come one after the other."""
    now, state, convs, out = None, sha256(), [], []
    for batch in batches:
        for conv, line in zip(batch["conv"].to_pylist(), batch["line"].to_pylist()):
            if conv != now:
                if now is not None:
                    convs.append(now)
                    out.append(state.hexdigest())
                now, state = conv, sha256()
            else:
                state.update(b"\n")
            state.update(line.encode())
        yield pa.RecordBatch.from_arrays([pa.array(convs, pa.string()), pa.array(out, pa.string())], ["conv", "sha256"])
        convs, out = [], []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["conv", "sha256"])


def digests(turns: DataFrame) -> DataFrame:
    """(conv, sha256) over ``role:text`` of a conversation's turns, joined by newlines.

    A digest is worked out in order, so a conversation's turns pass through one
    task, sorted and one at a time: memory does not grow with them.
    """
    lines = turns.select("conv", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv").sortWithinPartitions("conv", "step").mapInArrow(_hashes, "conv string, sha256 string")
