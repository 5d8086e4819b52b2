"""Merkle manifest of a table: a tree of digests for each group, a tree over their roots, and a proof for every row.

Leaves are read off the rows in one scan; from there on only digests move.
Building goes bottom up: a level's nodes are grouped by three neighbours into
their parents, and every level is written to the shared folder.  Proofs are
pushed top down: a level joins its parents, and each child puts its siblings
before the proof that the parent has got.  So both ways take as many joins as
the tallest tree has levels, over tables that shrink by three, and no task
holds more than the three children of a node and one proof.

Hexadecimal digests are hashed as text, as manifests print them; tables hold
them as 32 bytes.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import group_key, numbered, places, saved

#: How many neighbours make a parent.
ARITY = 3
_STEPS = "array<struct<left binary, right binary>>"


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def hashed(text: Column) -> Column:
    """The digest of a text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def leaf_of(*fields: Column) -> Column:
    """The digest of a row: of each field ``-`` if null, else its length in bytes, ``:`` and the value."""
    texts = [f.cast("string") for f in fields]
    return hashed(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)))


class Manifest(NamedTuple):
    """``rows``: the columns kept of each row, ``leaf``, ``subroot``, ``root`` (32 bytes each) and ``steps``, the proof: for each level up to the root
    the digests to the left and to the right of the row's own node, one after the other.  ``subroots``: ``group`` as a text, ``subroot``, ``place``."""

    rows: DataFrame
    subroots: DataFrame


def manifest(rows: DataFrame, group: Column, order: list[str], keep: list[str], leaf: str = "leaf") -> Manifest:
    """The trees over ``rows``, whose column ``leaf`` holds their digests; ``keep`` names the columns that the result has of them.

    Groups are ordered null first and then by their texts, bytewise; rows in a
    group by ``order`` (nulls first) and then by their leaf, so repeated rows
    are leaves of their own, side by side, and the root does not depend on how
    the table is stored.  A group with one row has that row's leaf as its
    subroot; a single group's subroot is the root.  An empty table gives empty
    tables.  Columns beyond ``keep`` and ``order``, whatever their names, do
    not matter.
    """
    spine = rows.select(F.struct(*keep).alias("kept"), F.struct(*order).alias("by"), F.col(leaf).alias("digest"), group_key(group).alias("tree"))
    leaves = places(numbered(spine, "tree", ["by", "digest"], "merkle-leaves"), "tree")
    levels = _levels(leaves.select("tree", "place", "of", "digest"))
    tops = levels[0].where("of = 1").select("tree", "digest")
    for level in levels[1:]:
        tops = tops.unionByName(level.where("of = 1").select("tree", "digest"))
    over = numbered(tops.select(F.lit("").alias("all"), F.col("tree").alias("name"), "digest"), "all", ["name"], "merkle-subroots")
    subroots = saved(places(over, "all"), "merkle-subroots")
    upper = _levels(subroots.select(F.col("all").alias("tree"), "place", "of", "digest"))

    top = upper[-1].where("of = 1").select("tree", "place", F.array().cast(_STEPS).alias("steps"), F.col("digest").alias("root"))
    for below, level in zip(upper[-2::-1], upper[:0:-1]):
        top = saved(_pushed(below, level, top, ["root"]), "merkle-proofs")
    known = subroots.join(top.drop("tree"), "place").select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("place"), "steps", "root", F.col("digest").alias("subroot"))
    known = saved(known, "merkle-proofs")
    carried = ["root", "subroot"]

    proofs = None
    for k in range(len(levels) - 1, -1, -1):
        ends = levels[k].where("of = 1").join(known.drop("place"), "tree").select("tree", "place", "steps", *carried)
        if proofs is not None:
            ends = ends.unionByName(_pushed(levels[k].where("of > 1"), levels[k + 1], proofs, carried))
        proofs = saved(ends, "merkle-proofs") if k else ends
    done = leaves.select("kept", "tree", "place", F.col("digest").alias("leaf")).join(proofs, ["tree", "place"])
    return Manifest(done.select("kept.*", "leaf", "subroot", "root", "steps"), subroots.select(F.expr("if(name = '', null, substr(name, 2))").alias("group"), F.col("digest").alias("subroot"), "place"))


def _levels(leaves: DataFrame) -> list[DataFrame]:
    """The levels of all trees (tree, place, of, digest, kids), from the leaves up; a tree's last level has one node."""
    level = saved(leaves.withColumn("kids", F.lit(None).cast("array<binary>")), "merkle-level")
    levels, most = [level], level.agg(F.max("of")).first()[0] or 0
    while most > 1:
        run = F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"])
        up = level.where("of > 1").groupBy("tree", F.expr(f"place div {ARITY}").alias("place"), F.expr(f"(of + {ARITY - 1}) div {ARITY}").alias("of")).agg(run.alias("kids"))
        text = F.array_join(F.transform("kids", hexed), "")
        level = saved(up.select("tree", "place", "of", hashed(text).alias("digest"), "kids"), "merkle-level")
        levels.append(level)
        most = -(-most // ARITY)
    return levels


def _pushed(children: DataFrame, parents: DataFrame, proofs: DataFrame, carried: list[str]) -> DataFrame:
    """The proofs of a level's children: their siblings before what their parent has got."""
    above = parents.select("tree", "place", "kids").join(proofs, ["tree", "place"]).select("tree", F.col("place").alias("up"), "kids", "steps", *carried)
    mine = children.select("tree", "place", F.expr(f"place div {ARITY}").alias("up"))
    at = (F.col("place") % ARITY).cast("int")
    joined = lambda a: F.concat(*(F.coalesce(F.get(a, F.lit(i)), F.lit(b"")) for i in range(ARITY - 1)))
    step = F.struct(joined(F.slice("kids", F.lit(1), at)).alias("left"), joined(F.slice("kids", at + 2, F.lit(ARITY))).alias("right"))
    return mine.join(above, ["tree", "up"]).select("tree", "place", F.concat(F.array(step), "steps").cast(_STEPS).alias("steps"), *carried)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(steps, leaf, lambda node, s: hashed(hexed(F.concat(s["left"], node, s["right"]))))


def proof_text(steps: Column) -> Column:
    """All siblings of a proof, level by level from the leaf up, left to right, in hexadecimal."""
    return F.array_join(F.transform(steps, lambda s: hexed(F.concat(s["left"], s["right"]))), "")
