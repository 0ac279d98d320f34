"""Pieces of oversized texts, cut at natural boundaries, with an overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwright.llm.tokens import TOKENIZERS, Codec, codec, slices

# Marks that end a line, a sentence and a clause. A place is the end of a match.
BREAK = re.compile(r"\[SEP\]")
SENTENCE = re.compile(r"[.!?…][\"'”’)\]]*(?=\s)|[。！？]")
CLAUSE = re.compile(r"[,;:](?=\s)|[，；、]")
#: By code point, the characters that are blanks of any kind; there are none behind these.
BLANK = np.array([chr(i).isspace() for i in range(0x3001)] + [False])


def places(text: str) -> tuple[list[np.ndarray], np.ndarray]:
    """Where a text divides, the strongest kind first (paragraph, line or [SEP], sentence, clause, word), each as rising numbers of characters; and
    where it must divide whatever surrounds it, see tokens.divides.

    A word ends where a blank follows a non-blank; it ends a line or paragraph too if the blanks behind it hold one line end, or more than one.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    blank = BLANK[np.minimum(code, len(BLANK) - 1)]
    word = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    again = np.append(np.flatnonzero(~blank[1:] & blank[:-1]) + 1, len(code))
    ends = np.concatenate([[0], np.cumsum(code == 10)])  # line ends before each character
    lines = ends[again[np.searchsorted(again, word, side="right")]] - ends[word] if len(word) else word
    found = lambda kind: np.array([m.end() for m in kind.finditer(text)], dtype=np.int64)
    must = word[np.isin(code[word], [32, 10, 9, 13])]
    return [word[lines > 1], np.union1d(found(BREAK), word[lines > 0]), found(SENTENCE), found(CLAUSE), word], must


def cut(text: str, c: Codec, limit: int, overlap: int) -> list[tuple[int, int, int, int, int, str]]:
    """Pieces (first character, end, first token, end, tokens of the piece on its own, kind of cut at its end) of a text.

    Token ends are prefix sums of token widths; a cut lies at the last place of the strongest kind within the limit that leaves the piece at
    least half full, else at the last place of any kind that moves on, else hard at the limit (kind 'hard'), never inside a character. The next
    piece begins overlap tokens before the cut, or up to three more where that would be inside a character. The tokens of a piece on its own are
    those of the whole text between the first and the last place in it where the text must divide; only its edges are encoded again.
    """
    ids = c.encode(text)
    if len(ids) <= limit:
        return [(0, len(text), 0, len(ids), len(ids), "end")]
    ends = np.concatenate([[0], np.cumsum(c.width[ids])])  # bytes before each token
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # the byte at which each character begins
    whole = np.isin(ends, starts)  # tokens that begin at a character
    found, must = places(text)
    kinds = []
    for characters in found:
        at = starts[characters]
        tok = np.searchsorted(ends, at)
        kinds.append(tok[ends[np.minimum(tok, len(ids))] == at])
    at_must = np.searchsorted(ends, starts[must]) if len(must) else must  # the tokens that begin there
    out, s, n = [], 0, len(ids)

    def alone(a: int, b: int) -> int:
        i, j = np.searchsorted(must, a), np.searchsorted(must, b, side="right") - 1
        if i > j:
            return len(c.encode(text[a:b]))
        first, last = must[i], must[j]
        return len(c.encode(text[a:first])) + int(at_must[j] - at_must[i]) + len(c.encode(text[last:b]))

    names = ("paragraph", "line", "sentence", "clause", "word")
    while True:
        room = limit
        while True:
            top = s + room
            e, kind = _last(kinds, names, s, top, overlap, limit, n, whole)
            a, b = (int(np.searchsorted(starts, ends[x])) for x in (s, e))
            own = alone(a, b)
            if own <= limit:
                break
            room = min(room, e - s) - max(1, own - limit)  # a piece read on its own may divide otherwise at its edges
        out.append((a, b, s, e, own, kind))
        if e >= n:
            return out
        s = e - overlap
        while not whole[s]:
            s -= 1


def _last(kinds, names, s: int, top: int, overlap: int, limit: int, n: int, whole) -> tuple[int, str]:
    if top >= n:
        return n, "end"
    least = s + overlap + 4  # the next piece must begin behind this one's beginning
    for floor in (max(least, s + limit // 2), least):
        for name, at in zip(names, kinds, strict=True):
            i = np.searchsorted(at, top, side="right") - 1
            if i >= 0 and at[i] >= floor:
                return int(at[i]), name
    while top > least and not whole[top]:
        top -= 1
    return top, "hard"


def split_texts(df: DataFrame, key: str, text: str, limit: int = 512, overlap: int = 64, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, piece_no, first_char, end_char, first_token, end_token, n_tokens, cut_kind, text): at least one piece for each row of df.

    No piece has more than limit tokens. A text within the limit is one piece; an empty or null text is one empty piece. Needs
    limit > 2 * overlap + 8. Other columns are not read.
    """
    if not limit > 2 * overlap + 8:
        raise ValueError("limit must exceed twice the overlap by more than 8")
    kind = df.schema[key].dataType.simpleString()
    names = ["k", "piece_no", "first_char", "end_char", "first_token", "end_token", "n_tokens", "cut_kind", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer, folder)
        for batch in batches:
            for part in slices(batch, 128):
                rows, owner = [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    for no, x in enumerate(cut(t or "", c, limit, overlap), 1):
                        owner.append(i)
                        rows.append((no, *x, (t or "")[x[0] : x[1]]))
                cols = [pa.array(x, type=y) for x, y in zip(zip(*rows, strict=True) if rows else [[]] * 8, [pa.int32()] * 6 + [pa.string()] * 2, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, type=pa.int64())), *cols], names=names)

    schema = f"k {kind}, piece_no int, first_char int, end_char int, first_token int, end_token int, n_tokens int, cut_kind string, text string"
    return df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)
