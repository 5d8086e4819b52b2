"""Benchmark decontamination: a broadcast hash set of benchmark word windows.

A word is a run of ``[0-9a-z]`` or non-ASCII characters after A-Z is
lower-cased.  A benchmark item's windows are all its runs of ``width`` words;
an item with fewer words is one window.  The windows of a block of items go to
every executor as sorted 64-bit hashes, each with where in the block it
stands; a document's windows are hashed the same way, and where hashes meet
the words themselves are compared.

The size of a block is bounded by ``block_words``, and with it what is
broadcast and what a worker holds (some 20 bytes a word besides the words).  A
benchmark with more words is taken in several blocks: documents get a number
and are written once, each block leaves the (number, spans, items) of its hits
only, and those are put together at the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HASHES, saved

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words of a benchmark in one block.
BLOCK_WORDS = 2_000_000
STEP = np.uint64(0x9E3779B97F4A7C15)
SPANS, ITEMS = T.ArrayType(T.ArrayType(T.LongType())), T.ArrayType(T.StringType())
#: In a Python worker: the table of the last broadcast block, which later tasks reuse.
_LAST: dict = {}


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "replace").lower()) if text else []


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` word hashes."""
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = out * STEP + h[i : len(h) - n + 1 + i]
    return out


class WindowSet:
    """The windows of some benchmark items; hashes find them, words decide."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        self.items = [(i, w) for i, text in items if (w := words(text))]
        #: By length in words: hashes of the different windows, ascending, an item and place of each, and all items of those that several share.
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, list[str]]]] = {}
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k, (_, w) in enumerate(self.items):
            n = min(width, len(w))
            h = window_hashes(np.fromiter(map(HASHES.__getitem__, w), np.uint64, len(w)), n)
            found.setdefault(n, []).append((h, np.full(len(h), k, np.int32), np.arange(len(h), dtype=np.int32)))
        for n, parts in found.items():
            h, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.by_width[n] = self._different(n, h[order], item[order], place[order])

    def _different(self, n: int, h: np.ndarray, item: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, list[str]]]:
        """One entry for each different window of ``n`` words, whatever the number of items that hold it."""
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        ends = np.append(starts[1:], len(h))
        kept, shared = list(starts[ends - starts == 1]), {}
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            groups: dict[tuple, list[int]] = {}
            for k in range(a, b):
                groups.setdefault(tuple(self.items[item[k]][1][place[k] : place[k] + n]), []).append(k)
            for ks in groups.values():
                kept.append(ks[0])
                shared[ks[0]] = sorted({self.items[item[k]][0] for k in ks})
        at = np.sort(np.array(kept, np.int64))
        return h[at], item[at], place[at], {k: shared[old] for k, old in enumerate(at.tolist()) if old in shared}

    def scan(self, w: list[bytes]) -> tuple[list[list[int]], list[str]]:
        """The hit word spans [start, end), merged, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if not w or not self.by_width:
            return [], []
        own = np.fromiter(map(HASHES.__getitem__, w), np.uint64, len(w))
        for n, (h, item, place, shared) in self.by_width.items():
            if len(w) < n:
                continue
            x = window_hashes(own, n)
            lo = np.searchsorted(h, x)
            met: set[int] = set()
            for a in np.flatnonzero(h[np.minimum(lo, len(h) - 1)] == x).tolist():
                window, k = w[a : a + n], int(lo[a])
                while k < len(h) and h[k] == x[a]:  # different windows of one hash
                    name, v = self.items[item[k]]
                    if v[place[k] : place[k] + n] == window:
                        spans.append((a, a + n))
                        if k not in met:
                            met.add(k)
                            items.update(shared.get(k, (name,)))
                        break
                    k += 1
        return merged(spans), sorted(items)


def window_set(held, width: int) -> WindowSet:
    if _LAST.get("block") is not held.value or _LAST.get("width") != width:
        _LAST.update(block=held.value, width=width, table=WindowSet(held.value, width))
    return _LAST["table"]


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of about ``block_words`` words, one block in the driver at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null")
    for r in rows.toLocalIterator():
        block.append((r.i, r.t))
        size += 1 + (len(r.t) // 2 if r.t else 0)
        if size >= block_words:
            yield block
            block, size = [], 0
    yield block


def scanned(held, width: int, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """n_words, spans and items of some texts."""
    table, found = window_set(held, width), []
    for text in texts:
        w = words(text.as_py())
        found.append((len(w), *table.scan(w)))
    n, spans, items = zip(*found, strict=True) if found else ((), (), ())
    return pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))


def found_in(docs: DataFrame, carry: list[str], benchmark: DataFrame, *, text_col: str, item_id_col: str, item_text_col: str, width: int, block_words: int) -> DataFrame:
    """(row, n_words, spans, items): the ``carry`` columns of each row of ``docs`` as a struct, and what the benchmark has in common with its text."""
    row = F.struct(*carry).alias("row")
    every = blocks(benchmark, item_id_col, item_text_col, block_words)
    first, second = next(every), next(every, None)
    if second is None:
        inside = carry.index(text_col) if text_col in carry else None  # a text that is carried is not sent twice
        sent = docs.select(row) if inside is not None else docs.select(row, F.col(text_col).cast("string").alias("text"))
        schema = T.StructType([T.StructField("row", sent.schema["row"].dataType), T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", ITEMS)])
        held = docs.sparkSession.sparkContext.broadcast(first)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(1) if inside is None else b.column(0).field(inside)
                yield pa.RecordBatch.from_arrays([b.column(0), *scanned(held, width, texts)], names=schema.names)

        return sent.mapInArrow(scan, schema)
    numbered = saved(docs.select(F.monotonically_increasing_id().alias("number"), F.col(text_col).cast("string").alias("text"), row), "decontam-docs")
    hits = [saved(block_hits(numbered, b, width), "decontam-block") for b in chain((first, second), every)]
    together = reduce(DataFrame.unionByName, hits).groupBy("number").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = numbered.select("number", "row", word_count("text").alias("n_words")).join(together, "number", "left")
    return joined.select("row", "n_words", merged_spans(F.coalesce("spans", F.array().cast(SPANS))).alias("spans"), F.coalesce("items", F.array().cast(ITEMS)).alias("items"))


def block_hits(numbered: DataFrame, block: list[tuple[str, str | None]], width: int) -> DataFrame:
    """(number, spans, items) of the rows that a block's windows hit."""
    schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", ITEMS)])
    held = numbered.sparkSession.sparkContext.broadcast(block)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, spans, items = scanned(held, width, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), spans, items], names=schema.names).filter(pa.array([len(x) > 0 for x in items], pa.bool_()))

    return numbered.select("number", "text").mapInArrow(scan, schema)


@F.pandas_udf(T.LongType())
def word_count(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: len(words(t)))


@F.pandas_udf(SPANS)
def merged_spans(spans: pd.Series) -> pd.Series:
    return spans.map(lambda s: merged([tuple(map(int, x)) for x in s]))


OPTIONS = {"item_id_col": "item_id", "item_text_col": "text", "width": 10, "block_words": BLOCK_WORDS}


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_words, n_hit, items (sorted strings), spans (word ranges).

    Null texts have no words; a null or repeated ``id_col`` is carried as it
    is, each row on its own.  Null item ids are left out; repeated item ids
    count as one item.  Other columns of ``docs`` are not read, so they cannot
    clash.  An empty benchmark hits nothing.  Options: item_id_col,
    item_text_col, width, block_words.
    """
    found = found_in(docs, [id_col], benchmark, text_col=text_col, **OPTIONS | options)
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(F.col("row")[id_col].alias(id_col), "n_words", length.alias("n_hit"), "items", "spans")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; rows and columns as they were."""
    found = found_in(docs, docs.columns, benchmark, text_col=text_col, **OPTIONS | options)
    return found.where(F.size("spans") == 0).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every hit word span, and what stands between its words, cut from the text."""
    found = found_in(docs, docs.columns, benchmark, text_col=text_col, **OPTIONS | options)
    cut = F.when(F.size("spans") > 0, without(F.col("row")[text_col], F.col("spans"))).otherwise(F.col("row")[text_col])
    return found.select(*((cut if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))


@F.pandas_udf(T.StringType())
def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([cut_spans(t, s) for t, s in zip(texts, spans, strict=True)])


def cut_spans(text: str | None, spans: list[list[int]]) -> str | None:
    """``text`` without the characters from the first to the last word of each span."""
    if text is None:
        return text
    raw = text.encode("utf-8", "replace")
    at = [m.span() for m in WORD.finditer(raw.lower())]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode()
