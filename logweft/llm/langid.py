"""Language identification by rank-order profiles of letter n-grams.

Texts are lower-cased; everything but letters is a boundary.  N-grams of one
to three characters (with boundaries at word edges) are ranked by frequency,
ties by code point.  A language's profile is the ranking of its ``size`` most
frequent n-grams; a document's distance from it is the sum over the document's
own ``size`` most frequent n-grams of how far each is out of place, and
``size`` where the profile lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


SIZE = 400
#: Learning reads about so many documents of a language at most, drawn by a hash of their id.
FIT_DOCS = 2_000
#: There are some 200 languages with enough text to tell them by; profiles of so many fit any worker.
MOST_LANGS = 1_000
UNKNOWN = "und"
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point: itself if a letter, else 0."""
    if not _LETTER:
        _LETTER.append(np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.int64))
    return _LETTER[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as 63-bit numbers, ascending, and how often each occurs."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    c = np.zeros(len(code) + 2, np.int64)
    c[1:-1] = letters()[code]
    edge = c == 0
    c = c[~(edge & np.roll(edge, 1) & (np.arange(len(c)) > 0))]  # one boundary between words
    one = c[c > 0]
    if not len(one):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = c[:-1], c[1:]
    mid = b[:-1] > 0
    two = (a << 21) | b | (1 << 62)
    three = ((a[:-1] << 42) | (b[:-1] << 21) | c[2:])[mid]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def ranked(g: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, best first."""
    if len(g) > size:
        cut = np.partition(n, len(n) - size)[len(n) - size]
        g, n = g[n >= cut], n[n >= cut]
    return g[np.argsort(-n, kind="stable")][:size]


class Profiles:
    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        """rows: language, n-gram, rank from 0."""
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[1] for r in rows}), np.int64)
        self.place = np.full((len(self.langs), len(self.grams) + 1), -1, np.int64)
        at = {g: i for i, g in enumerate(self.grams.tolist())}
        for lang, g, r in rows:
            self.place[self.langs.index(lang), at[g]] = r

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (ties: the first by name) and its nearness, from 0 to 1."""
        top = ranked(*grams(text), self.size)
        if not len(top) or not self.langs:
            return UNKNOWN, 0.0
        i = np.searchsorted(self.grams, top)
        i[(i == len(self.grams)) | (self.grams[np.minimum(i, len(self.grams) - 1)] != top)] = len(self.grams)
        place = self.place[:, i]
        away = np.where(place < 0, self.size, np.abs(place - np.arange(len(top)))).sum(axis=1)
        best = int(np.argmin(away))
        return self.langs[best], float(1 - away[best] / (self.size * len(top)))


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = SIZE, fit_docs: int = FIT_DOCS) -> list[tuple[str, int, int]]:
    """Profiles from labelled rows: those with a language and, by the id's crc32, not held out.

    At most about ``fit_docs`` documents of each language are read (all of a
    language that has no more), chosen by a hash of the id; whole texts.  More
    than ``MOST_LANGS`` different labels are an error: that column holds no
    languages, and the profiles of so many would not fit a worker.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("id").isNotNull())
    rows = rows.where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    share = rows.groupBy("lang").count().select("lang", (F.least(F.lit(1.0), F.lit(float(fit_docs)) / F.col("count")) * 1_000_000).cast("long").alias("_share"))
    if share.limit(MOST_LANGS + 1).count() > MOST_LANGS:
        raise ValueError(f"{lang_col} has more than {MOST_LANGS} values")
    drawn = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.col("_share"))
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total.setdefault(lang, []).append(grams(text.as_py()))
                if len(total[lang]) >= 256:
                    total[lang] = [summed(total[lang])]
        for lang, got in total.items():
            g, n = summed(got)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], names=schema.names)

    counts = drawn.select("lang", "text").mapInArrow(count, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    top = counts.withColumn("r", place).where(F.col("r") < size)
    return [(r.lang, r.gram, r.r) for r in top.collect()]  # ``size`` rows for each language


def summed(got: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    g, i = np.unique(np.concatenate([x for x, _ in got]), return_inverse=True)
    return g, np.bincount(i, np.concatenate([x for _, x in got]), len(g)).astype(np.int64)


def identify(docs: DataFrame, profiles: list[tuple[str, int, int]], *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """``id_col``, lang_pred and score of every whole text.

    ``und`` and 0 for null texts, texts without letters, and where nothing was
    learnt.  Null or repeated ids pass, each row on its own; other columns are
    not read, so they cannot clash.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(profiles)  # size x languages rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Profiles(held.value, size)
        for b in batches:
            got = [p.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=schema.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, profiles: list[tuple[str, int, int]], *, text_col: str = "text", lang_col: str | None = None, floor: float = 0.0, size: int = SIZE) -> DataFrame:
    """``docs``, columns as they were, without the rows whose language cannot be told.

    Those are the texts without a letter, and the texts whose nearness to the
    nearest language is not over ``floor``: at 0 those that share no n-gram
    with any profile, as texts in an unknown script.  A row that stays gets
    the language found where ``lang_col`` is named and null.  Where nothing
    was learnt every row stays as it is.
    """
    if not profiles:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(profiles)  # size x languages rows
    at, to = docs.columns.index(text_col), docs.columns.index(lang_col) if lang_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Profiles(held.value, size)
        for b in batches:
            got = [p.predict(t.as_py()) for t in b.column(at)]
            if to is not None:
                known = [x if x is not None else lang for x, (lang, _) in zip(b.column(to).to_pylist(), got, strict=True)]
                b = b.set_column(to, b.schema.field(to), pa.array(known, b.schema.field(to).type))
            yield b.filter(pa.array([lang != UNKNOWN and score > floor for lang, score in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
