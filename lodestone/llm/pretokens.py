"""Pre-tokens of a SentencePiece model whose pieces hold white space at their start only.

No piece of such a model has a space mark after another character, or a line feed. So no
piece spans the place before a space or before a line feed, and a text's pieces are those of the
stretches between such places. A stretch is named by a key:

* ``word``: a stretch with one space (or the text's implied first space) before ``word``;
* ``''``: a lone space; ``'  word'``: three spaces before ``word``;
* ``'\\nword'``: a stretch that begins with a line feed and has no space mark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece

_STRETCH = re.compile(r"\n[^ \n]*| +[^ \n]*")


def load(path: str) -> sentencepiece.SentencePieceProcessor:
    """The model, if its pieces allow stretches to be handled alone."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if "\n" in piece or "▁" in piece.lstrip("▁"):
            raise ValueError("a piece spans white space: texts cannot be cut there")
    return model


def keys(text: str) -> list[str]:
    """The keys of a text's stretches, in order; none for an empty text."""
    if not text:
        return []
    if "  " not in text and " \n" not in text and text[0] != " " and text[-1] != " ":
        return text.replace("\n", " \n").split(" ")
    return [s if s[0] == "\n" else s[1:] for s in _STRETCH.findall(" " + text)]


def stretch(key: str) -> str:
    """The characters that a key stands for, with its first space."""
    return key if key[:1] == "\n" else " " + key


def texts(batch: pa.RecordBatch, column: int, size: int = 1 << 21) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, end row, texts) of parts of a batch with about ``size`` bytes; null texts are empty. Only a part's texts are Python strings at a time."""
    values, i = batch.column(column), 0
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    while i < len(values):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, "right")))
        yield i, j, [v or "" for v in values.slice(i, j - i).to_pylist()]
        i = j
