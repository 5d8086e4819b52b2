"""Citations: [REF_...] marks in text against the rows they stand for."""

from __future__ import annotations

import re
from pathlib import PurePath
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules

REF = rules.CITATION


def cited(texts: DataFrame, refs: DataFrame, *, text_col: str = "text", key: str = "text_id") -> DataFrame:
    """(key, ref_id, position, and the columns of ``refs``): each citation with its row.

    Where an id is defined more than once the first definition (by ``ord``)
    wins; citations without one stay, with nulls.
    """
    one = refs.withColumn("_k", F.row_number().over(Window.partitionBy("ref_id").orderBy("ord"))).where("_k = 1").drop("_k")
    marks = texts.select(key, F.posexplode(F.regexp_extract_all(text_col, F.lit(REF), F.lit(1))).alias("position", "ref_id"))
    return marks.join(one, "ref_id", "left")


def line_reference(row: dict) -> str:
    """Error ranges, else ranges, else start and end, else that there are none."""
    if row.get("error_line_ranges"):
        return f"lines {row['error_line_ranges']}"
    if row.get("line_ranges"):
        return f"lines {row['line_ranges']}"
    a, b = row.get("start_line"), row.get("end_line")
    if a and b:
        return f"line {a}" if a == b else f"lines {a}-{b}"
    return "lines unavailable"


def line_reference_column() -> Column:
    a, b = F.col("start_line").cast("string"), F.col("end_line").cast("string")
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.coalesce(F.concat(F.lit("lines "), text("error_line_ranges")), F.concat(F.lit("lines "), text("line_ranges")), F.when(a == b, F.concat(F.lit("line "), a)).otherwise(F.concat(F.lit("lines "), a, F.lit("-"), b)), F.lit("lines unavailable"))


def file_uri(path: str) -> str:
    return PurePath(path).as_uri() if path.startswith("/") else "file://" + quote(path)


def editor_uri(path: str, line: int | None = None) -> str:
    return f"vscode://file{quote(path)}" + (f":{line}" if line else "")


def without_marks(line: str, known) -> str:
    """The line without the marks of ``known`` ids, and without the gaps that they leave."""
    bare = re.sub(REF, lambda m: "" if m[1] in known else m[0], line)
    return re.sub(r"\s{2,}", " ", re.sub(r"\s+([,.;:])", r"\1", bare)).strip()


def location(row: dict) -> str:
    """A list item that links to the file at its lines, if there is a path."""
    label = f"{row.get('source_file', 'unknown')}, {row.get('line_ref') or line_reference(row)}"
    path = row.get("source_path")
    return "- Original Log Reference: " + (f"[{label}]({editor_uri(path, row.get('start_line'))}) [\N{PAGE FACING UP}]({file_uri(path)})" if path else label)


def rewrite(text: str, refs: list[dict]) -> str:
    """Each line without its known marks, and below it the places they stand for, each (path, lines) once a line; unknown marks stay."""
    known: dict[str, dict] = {}
    for r in refs:
        known.setdefault(r["ref_id"], r)
    out: list[str] = []
    for line in text.splitlines():
        cited = [known[i] for i in dict.fromkeys(re.findall(REF, line)) if i in known]
        shown = without_marks(line, known) if cited else line
        places: dict[tuple[str, str], dict] = {}
        for r in cited:
            places.setdefault((r.get("source_path", ""), r.get("line_ref") or line_reference(r)), r)
        out += [*([shown] if shown or not cited else []), *map(location, places.values())]
    return "\n".join(out).strip() + "\n" if known else text


def strip_marks(text: str) -> str:
    """Every mark removed, known or not."""
    every = set(re.findall(REF, text))
    return "\n".join(without_marks(x, every) for x in text.splitlines()).strip() + "\n"


def space_causes(text: str) -> str:
    """A ranked cause after a blank line, each of its fields on a line of its own."""
    fields = re.sub(rules.CAUSE_FIELD, r"\n\1", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(rules.CAUSE_HEADING, r"\n\n\1", fields)).strip() + "\n"
