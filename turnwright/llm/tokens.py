"""Encoding with public tokenizers by monoid tree reduction.

The encoding of a text is reduced from the encodings of its halves: neighbours are joined by encoding anew only a window around the cut, which
grows on both sides to the next place where the text must divide whatever surrounds it. Tokens outside the window stay as they are. Decoding
maps tokens to bytes and concatenates up the same tree.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern that divides a text before merges, for the byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 4096


class Codec:
    """A byte-level rank file with tree encoding."""

    def __init__(self, name: str, folder: str = TOKENIZERS, leaf: int = LEAF):
        import tiktoken

        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.plain = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        self.width = np.array([len(x) for x in self.pieces], dtype=np.int64)
        self.leaf = max(2, leaf)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for an empty or null one."""
        return self._tree(text, 0, len(text)) if text else []

    def _tree(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.plain(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._tree(text, lo, mid), self._tree(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """left encodes text[lo:mid], right text[mid:hi]; both lists are used up."""
        a, b = mid - 1, mid + 1
        while a > lo and not divides(text, a):
            a -= 1
        while b < hi and not divides(text, b):
            b += 1
        a, b = max(a, lo), min(b, hi)
        drop = len(text[a:mid].encode())
        while drop > 0:
            drop -= len(self.pieces[left.pop()])
        gone, skip = 0, len(text[mid:b].encode())
        while skip > 0:
            skip -= len(self.pieces[right[gone]])
            gone += 1
        if drop or skip:
            raise AssertionError("a token crosses a place where the text must divide")
        left += self.plain(text[a:b])
        left += right[gone:]
        return left

    def decode(self, ids) -> str:
        """The text of ids, concatenated up the tree; bytes that are no text become replacement marks."""
        return self._bytes(ids, 0, len(ids)).decode("utf-8", "replace")

    def _bytes(self, ids, lo: int, hi: int) -> bytes:
        if hi - lo <= self.leaf:
            return b"".join([self.pieces[i] for i in ids[lo:hi]])
        mid = (lo + hi) // 2
        return self._bytes(ids, lo, mid) + self._bytes(ids, mid, hi)


def divides(text: str, x: int) -> bool:
    """True where every division of the text has a boundary: before a blank that follows no blank.

    No alternative of PATTERN holds a blank behind something else, so a match that covers text[x - 1] ends before x, and matching goes on from
    x with no regard to what came before. Only plain blanks count, which all versions of Unicode classify alike.
    """
    return text[x] in " \n\t\r" and not text[x - 1].isspace()


@lru_cache(maxsize=4)
def codec(name: str, folder: str = TOKENIZERS, leaf: int = LEAF) -> Codec:
    return Codec(name, folder, leaf)


def encode_column(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, leaf: int = LEAF) -> DataFrame:
    """(key, ids array<int>): one row for each row of df; empty and null texts have an empty list. Other columns are not read."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer, folder, leaf)
        for batch in batches:
            for part in slices(batch):
                ids = pa.array([c.encode(t) for t in part.column(1).to_pylist()], type=pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["k", "ids"])

    return df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def count_tokens(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, n_tokens): 0 for empty and null texts."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer, folder)
        for batch in batches:
            for part in slices(batch):
                n = pa.array([len(c.encode(t)) for t in part.column(1).to_pylist()], type=pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n], names=["k", "n_tokens"])

    return df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, n_tokens bigint").withColumnRenamed("k", key)


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Short runs of rows, so that texts and ids of a whole batch are not held as Python objects at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def decode_column(df: DataFrame, key: str, ids: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, text) back from ids; a null list gives null."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer, folder)
        for batch in batches:
            for part in slices(batch):
                t = pa.array([None if x is None else c.decode(x) for x in part.column(1).to_pylist()], type=pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), t], names=["k", "text"])

    return df.select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)
