"""BPE encoding and decoding by dynamic programming over prefixes.

For each prefix of a piece exactly one token can stand last in its encoding.
It is found without replaying merges: the vocabulary's suffix automaton lists
the tokens that end at this position, longest first; the first one that is
compatible with the last token of the prefix before it is the answer.  Two
tokens are compatible when the merge table, replayed backwards over the edge
between them, never joins across that edge earlier than it made the tokens.
Following the stored last tokens from the end backwards gives the ids.

The vocabulary file is read once on the driver and broadcast (its size is
fixed by the tokenizer, about 1.5 MB); its path is a parameter.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The pre-tokenizer pattern of byte-level BPE (a fixed value of the format).
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for texts whose characters are ASCII or Latin letters up to U+017F; the plain engine is twice as fast.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
FAST_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+", re.ASCII)
BEYOND = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]")
#: Pieces that a worker keeps encoded; beyond it the table is emptied. It bounds memory and changes no result.
CACHE = 300_000
NEVER = 1 << 40
_WORKER: dict = {}


def byte_letters() -> dict[str, int]:
    """The format's visible letter for each byte: itself if printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, spec: str | bytes):
        j = json.loads(spec)
        letters = byte_letters()
        vocab = j["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        self.bytes: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in self.special and all(c in letters for c in t)}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in j["model"]["merges"]]
        #: Rank of the merge of two tokens, and for each token the rank and the halves of its own merge.
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((x, y), r)
            self.made.setdefault(z, (r, x, y))
        self.machine = ahocorasick.Automaton()
        self.whole: dict[bytes, int] = {}
        plain = [i for t, i in vocab.items() if t not in self.special]
        for i in plain:
            if i not in self.made or self.joins(*self.made[i][1:], self.made[i][0]):
                raw = self.bytes[i].decode("latin-1")
                self.machine.add_word(raw, (i, len(raw)))
                self.whole[self.bytes[i]] = i
        self.machine.make_automaton()
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.memo: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.table = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]

    def joins(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether ``a`` then ``b`` stay two tokens when only merges below rank ``before`` have run.

        The edge pair is taken apart from the latest merge to the earliest.
        ``until`` is the moment the present pair came to an end, in half
        steps: among equal merges the left one runs first, so a merge across
        the edge beats an equal one on its right and loses to one on its left.
        """
        until = 2 * before
        while True:
            r = self.rank.get((a, b))
            if r is not None and 2 * r < until:
                return False
            ra, rb = self.made.get(a), self.made.get(b)
            if ra is None and rb is None:
                return True
            if rb is None or (ra is not None and ra[0] > rb[0]):
                until, a = 2 * ra[0], ra[2]
            else:
                until, b = 2 * rb[0] + 1, rb[1]

    def ids(self, raw: bytes) -> list[int]:
        """The ids of one piece."""
        if (one := self.whole.get(raw)) is not None:
            return [one]
        n, memo = len(raw), self.memo
        last, length = [-1] * (n + 1), [0] * (n + 1)
        # Matches come by their end, and for one end the longest first.
        for end, (t, k) in self.machine.iter(raw.decode("latin-1")):
            if length[end + 1]:
                continue
            if before := end + 1 - k:
                key = last[before] << 20 | t
                if (ok := memo.get(key)) is None:
                    ok = memo[key] = self.joins(last[before], t)
                if not ok:
                    continue
            last[end + 1], length[end + 1] = t, k
        out, i = [], n
        while i:
            out.append(last[i])
            i -= length[i]
        return out[::-1]

    def piece(self, text: str) -> bytes:
        if len(self.cache) >= CACHE:
            self.cache.clear()
        if len(self.memo) >= CACHE:
            self.memo.clear()
        got = self.cache[text] = array("i", self.ids(text.encode("utf-8", "replace"))).tobytes()
        return got

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, as little-endian 32-bit integers."""
        if not text:
            return b""
        cache, piece, out = self.cache.get, self.piece, []
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                pattern = PIECE if BEYOND.search(part) else FAST_PIECE
                out += [cache(p) or piece(p) for p in pattern.findall(part)]
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")


def tokenizer(held) -> Bpe:
    """This worker's tokenizer for a broadcast vocabulary."""
    if _WORKER.get("spec") is not held.value:
        _WORKER.update(spec=held.value, bpe=Bpe(held.value))
    return _WORKER["bpe"]


def load(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``id_col``, ids (array of int) and, with ``decoded``, the text decoded again from those ids.

    Each row is encoded whole, on its own; null and empty texts have no ids.
    Special tokens in a text become their ids.  Rows with null or repeated ids
    pass unchanged; other columns are not read, so they cannot clash.
    """
    held = load(docs, path)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if decoded:
        schema = schema.add("decoded", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(held)
        for big in batches:
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                raw = [bpe.encode(t.as_py()) for t in b.column(1)]
                ends = np.cumsum([0, *(len(r) // 4 for r in raw)], dtype=np.int64)
                flat = np.frombuffer(b"".join(raw), "<i4")
                cols = [b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))]
                if decoded:
                    cols.append(pa.array([bpe.decode(flat[x:y].tolist()) for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and text: the bytes of the ids joined, bad UTF-8 replaced.

    A null list gives an empty text; null or unknown ids in a list add nothing.
    """
    held = load(tokens, path)
    schema = T.StructType([T.StructField("id", tokens.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(held)
        most = len(bpe.table)
        for b in batches:
            texts = [bpe.decode([i for i in ids.as_py() or [] if i is not None and 0 <= i < most]) for ids in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=schema.names)

    src = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)
