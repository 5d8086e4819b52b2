"""Log files as DataFrames of numbered lines, and the small driver-side readers around them."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules

#: File splits whose starts are broadcast (some 300 bytes each).
SPLITS = 200_000
#: Lines of a file that meet context ranges in one task.
BLOCK_LINES = 10_000
LINES = "source_path string, source_file string, line_no bigint, raw string"


def find_logs(path: str) -> list[str]:
    """A file as it is, or a folder's log files, recursively and sorted; inputs are not deduplicated."""
    p = Path(path)
    if p.is_file():
        return [str(p)]
    return sorted(str(f) for f in p.rglob("*") if f.is_file() and f.suffix.lower() in rules.LOG_SUFFIXES) if p.is_dir() else []


def split_by_size(paths: list[str], limit: int = rules.MAX_FILE_BYTES) -> tuple[list[str], list[str]]:
    """Files up to the limit, and those over it."""
    return [p for p in paths if os.path.getsize(p) <= limit], [p for p in paths if os.path.getsize(p) > limit]


def read_lines(spark: SparkSession, paths: str | list[str], *, recursive: bool = False, rotated: bool = False) -> DataFrame:
    r"""(source_path, source_file, line_no from 1, raw): the lines of text files, or of a folder's log files.

    Files are split and read in parallel (``\n``, ``\r`` and ``\r\n`` end lines,
    bad bytes become U+FFFD).  Ordinals need no pass over one whole file in one
    task: lines are counted per split, splits are added up, and a line's number
    is its place in its split plus what comes before.  That is a row for each
    split, broadcast while there are under ``SPLITS`` of them.

    ``rotated``: the files of one folder are one log, cut where it was rotated;
    its lines are numbered through all of them, in the order of their names,
    and source_path is the folder.
    """
    text = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(paths).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    if recursive:
        text = text.where(F.lower("source_file").rlike(r"\.(log|txt|out|err|msg)$"))
    # The id counts up within a task, and a split is read by one task.
    log = folder_of(F.col("source_path")) if rotated else F.col("source_path")
    sizes = text.groupBy("source_path", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(log).orderBy("source_path", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("source_path", "_block", "_first", before.alias("_before"))
    few = text.rdd.getNumPartitions() + len(text.inputFiles()) <= SPLITS
    joined = text.join(F.broadcast(starts) if few else starts, ["source_path", "_block"])
    return joined.select(log.alias("source_path"), "source_file", (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("line_no"), "raw")


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def sample(lines: DataFrame, n: int = 1_200) -> list[str]:
    """The first lines, for inference of the format."""
    return [r.raw for r in lines.where(F.col("line_no") <= n).orderBy("source_path", "line_no").limit(n).select("raw").collect()]


def samples(lines: DataFrame, key: str, n: int = 1_200) -> dict:
    """The first lines of several files by ``key``, in one job: a bounded number of each."""
    out: dict = {}
    for r in lines.where(F.col("line_no") <= n).select(key, "line_no", "raw").orderBy(key, "line_no").collect():
        out.setdefault(r[0], []).append(r.raw)
    return out


def window_around(lines: DataFrame, target: int, radius: int = 5) -> DataFrame:
    """Lines within ``radius`` of a line, marked; empty if the file ends before it."""
    if target < 1 or radius < 0:
        raise ValueError("the line starts at 1 and the radius at 0")
    near = lines.where(F.col("line_no").between(target - radius, target + radius))
    there = near.groupBy("source_path").agg(F.max("line_no").alias("_last")).where(F.col("_last") >= target)
    return near.join(there, "source_path").select("source_path", "line_no", "raw", (F.col("line_no") == target).alias("is_target"))


def term_hits(text: Column, terms: list[str]) -> Column:
    low = F.lower(text)
    out = F.lit(0)
    for t in terms:
        out = out + F.contains(low, F.lit(t.lower())).cast("int")
    return out


def _near(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lines within the ranges of ``wanted`` (_path, _from, _to, more): a join on the file and the block of lines.

    A range is told to every block that it touches, so a file's lines meet it
    block by block, in as many tasks as the file has blocks.
    """
    size = BLOCK_LINES
    told = wanted.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_from") / size), F.floor(F.col("_to") / size))))
    dealt = lines.withColumn("_b", F.floor(F.col("line_no") / size))
    return dealt.join(told, (F.col("source_path") == F.col("_path")) & (F.col("_b") == F.col("_block")) & F.col("line_no").between(F.col("_from"), F.col("_to"))).drop("_path", "_b", "_block", "_from", "_to")


def keyword_windows(lines: DataFrame, terms: list[str], *, before: int = 2, after: int = 2, most: int = 3) -> DataFrame:
    """(source_path, line_no, content): the first hits of each file with their context.

    The first hits are found by a bounded rank, and only they take part in the join.
    """
    order = Window.partitionBy("source_path").orderBy("line_no")
    hits = lines.where(term_hits(F.col("raw"), terms) > 0).select("source_path", "line_no").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most)
    hit = F.col("line_no")
    near = _near(lines, hits.select(F.col("source_path").alias("_path"), F.greatest(hit - before, F.lit(1)).alias("_from"), (hit + after).alias("_to"), hit.alias("_hit")))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"]), "\n")
    return near.groupBy("source_path", F.col("_hit")).agg(content.alias("content")).withColumnRenamed("_hit", "line_no")


def edges(lines: DataFrame, n: int = 7) -> DataFrame:
    """The first and last ``n`` lines of each file: what is shown where no keyword hits."""
    last = lines.groupBy("source_path").agg(F.max("line_no").alias("_last"))
    tail = F.col("_last") - n + 1
    ends = F.explode(F.when(tail > n + 1, F.array(F.struct(F.lit(1).alias("a"), F.lit(n).alias("z")), F.struct(tail.alias("a"), F.col("_last").alias("z")))).otherwise(F.array(F.struct(F.lit(1).alias("a"), F.col("_last").alias("z")))))
    wanted = last.select(F.col("source_path").alias("_path"), ends.alias("_e")).select("_path", F.col("_e.a").alias("_from"), F.col("_e.z").alias("_to"))
    return _near(lines, wanted)


# --- tickets and artifacts ---

def is_ticket(path: str) -> bool:
    stem, ext = os.path.splitext(os.path.basename(path).lower())
    return "ticket" in stem and ext in (".md", ".txt", ".markdown")


def find_tickets(paths: list[str]) -> list[str]:
    """Ticket files among and below the paths, each once, in order of discovery."""
    found: dict[str, None] = {}
    for p in paths:
        for f in [p] if os.path.isfile(p) else sorted(map(str, Path(p).rglob("*"))) if os.path.isdir(p) else []:
            if os.path.isfile(f) and is_ticket(f):
                found.setdefault(os.path.abspath(f), None)
    return list(found)


def ticket_text(paths: list[str], limit: int = rules.TICKET_CHARS) -> str:
    """All tickets under a header each, cut at the limit."""
    return "\n\n".join(f"=== {os.path.basename(p)} ===\n{Path(p).read_text(encoding='utf-8', errors='replace').strip()}" for p in paths)[:limit]


def debug_sections(text: str) -> dict[str, str]:
    """Sections of a debug artifact by their ``=== title ===`` lines."""
    parts = re.split(r"(?m)^=+ (.+?) =+$", text)
    return {t.strip(): body.strip() for t, body in zip(parts[1::2], parts[2::2], strict=True)}


def saved_name(name: str, taken: set[str]) -> str:
    """A safe base name for an upload, numbered if taken; an error if it is no log file."""
    base = re.sub(r"[^\w.\- ]", "_", os.path.basename(name.replace("\\", "/"))).strip(". ") or "upload.log"
    stem, ext = os.path.splitext(base)
    if ext.lower() not in rules.LOG_SUFFIXES:
        raise ValueError(f"{name}: not a log file")
    out, k = base, 2
    while out in taken:
        out, k = f"{stem}_{k}{ext}", k + 1
    return out


def save_uploads(files: dict[str, bytes], folder: str) -> list[str]:
    """Files written below ``folder`` and nowhere else."""
    home = Path(folder).resolve()
    home.mkdir(parents=True, exist_ok=True)
    out: list[str] = []
    for name, data in files.items():
        target = (home / saved_name(name, {os.path.basename(p) for p in out} | set(os.listdir(home)))).resolve()
        if target.parent != home:
            raise ValueError(f"{name}: outside the folder")
        target.write_bytes(data)
        out.append(str(target))
    return out


def size_text(n: float) -> str:
    """524.6 MB and the like."""
    units = ["B", "KB", "MB", "GB", "TB"]
    k = next((k for k in range(4) if n < 1024 ** (k + 1)), 4)
    return f"{n / 1024**k:.1f} {units[k]}"
