"""Token counts of a unigram tokenizer: Viterbi that carries counts and no pieces.

An Aho-Corasick machine lists, for every end position, the vocabulary pieces
that end there, the longest first.  For each position the best score and the
number of tokens on its best path are kept, nothing else.  Ties go to the
longest last piece, as in the tokenizers library, which keeps the first of
equal paths in order of their start.  A character that no piece covers alone
costs ten below the lowest score; it counts as its UTF-8 bytes if the
vocabulary has all byte pieces, and else runs of such characters count as one
unknown token.

Blanks become U+2581, one is put in front, and words never join (the
library's Metaspace with a prefix always), so a word's count is reusable.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words a worker keeps counted; beyond it the table is emptied. It bounds memory and changes no result.
CACHE = 300_000
#: Longer words are never kept, so that the table is bounded in bytes too.
LONGEST = 64
_WORKER: dict = {}


class Counter:
    def __init__(self, vocab: list[tuple[str, float]]):
        self.machine = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.unknown = min((s for _, s in vocab), default=0.0) - UNKNOWN_PENALTY
        names = {p for p, _ in vocab}
        self.bytewise = all(f"<0x{b:02X}>" in names for b in range(256))
        self.cache: dict[str, tuple[int, float]] = {}

    def word(self, text: str) -> tuple[int, float]:
        """Token count and score of the best path over one word."""
        n = len(text)
        score, count = [0.0] + [None] * n, [0] * (n + 1)
        lost = [False] * (n + 1)  # the best path ends in an unknown character
        done = 0  # ends up to here have all their matches

        def settle(upto: int) -> None:
            """Ends whose matches are over: an unknown character competes where no single one fits."""
            nonlocal done
            while done < upto:
                done += 1
                if not single[done]:
                    s = score[done - 1] + self.unknown
                    if score[done] is None or s > score[done]:
                        score[done], lost[done] = s, True
                        count[done] = count[done - 1] + (len(text[done - 1].encode("utf-8", "replace")) if self.bytewise else not lost[done - 1])

        single = [False] * (n + 1)
        for end, (k, s) in self.machine.iter(text):
            end += 1
            if done < end - 1:
                settle(end - 1)
            s += score[end - k]
            if k == 1:
                single[end] = True
            if score[end] is None or s > score[end]:
                score[end], count[end], lost[end] = s, count[end - k] + 1, False
        settle(n)
        return count[n], score[n]

    def text(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        s = text.replace(" ", SPACE)
        parts = (s if s[0] == SPACE else SPACE + s).split(SPACE)
        get, cache, tokens, score = self.cache.get, self.cache, 0, 0.0
        for w in parts[1:]:
            if (got := get(w)) is None:
                if len(cache) >= CACHE:
                    cache.clear()
                got = self.word(SPACE + w)
                if len(w) <= LONGEST:
                    cache[w] = got
            tokens += got[0]
            score += got[1]
        return tokens, score


def counter(held) -> Counter:
    if _WORKER.get("vocab") is not held.value:
        _WORKER.update(vocab=held.value, counter=Counter(held.value))
    return _WORKER["counter"]


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())]


def count_tokens(docs: DataFrame, vocab: list[tuple[str, float]], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens and score (of the best path) of every whole text.

    Null and empty texts have 0 tokens.  Rows with null or repeated ids pass
    each on its own; other columns are not read, so they cannot clash.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocab)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(held)
        for b in batches:
            got = [c.text(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())], names=schema.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
