"""Encoding and decoding with a sentence-piece model through a table of distinct marked words.

The model writes each blank as a marker, and puts one before the text.  Where no
piece goes on past a marker that follows something else, a text falls apart before
every run of markers: such a marked word always has the same ids, whatever stands
beside it.  So a task keeps a table of the distinct marked words of its texts.  A
text becomes numbers into that table, words that are new to it are segmented by the
library, and the ids are joined back by position.

The table is of bounded size and begins anew when it is full.  Tables are not joined
over tasks: where most distinct words are rare, that moves more than the texts.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKER = "▁"
#: Words and characters of a task's table.
TABLE_WORDS, TABLE_CHARACTERS = 400_000, 1 << 24
#: Characters that are taken apart at once, that the library gets at once, and marked words put together at once.
SLICE, CALL_CHARACTERS, TOGETHER = 1 << 20, 1 << 20, 1 << 18
ANCHOR = "x"


def _library(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def check_model(path: str) -> None:
    """Raise if the model's texts do not fall apart at markers, or if it changes texts before it segments them."""
    model = _library(path)
    names = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    if crossing := [name for name in names if MARKER in name.lstrip(MARKER)]:
        raise ValueError(f"pieces cross whitespace markers: {crossing[:5]}")
    probe = "x  Y\tＡﬁ½ \n "
    if model.decode(model.encode(probe)) != probe or len(model.encode(ANCHOR)) != 1:
        raise ValueError("the model does not keep texts as they are")


def _numbered(text: str, numbers: dict[str, int]) -> np.ndarray:
    """The marked words of a text as numbers; each is given by what follows its first marker."""
    if not text:
        return np.zeros(0, dtype=np.uint32)
    marked = " " + text.replace(MARKER, " ")
    find = re.compile(" ( *[^ ]*)").findall
    parts, at = [], 0
    while at < len(marked):
        end = at + SLICE
        if end < len(marked):
            # Cut before a run of markers: at a blank that does not follow one.
            end = next((m.start() + 1 for m in re.compile("[^ ] ").finditer(marked, end)), len(marked))
        parts.append(np.fromiter(map(numbers.__getitem__, find(marked[at:end])), dtype=np.uint32))
        at = end
    return np.concatenate(parts)


class Table:
    """Distinct marked words and their ids; ``numbers`` gives unknown words the next number."""

    def __init__(self, model) -> None:
        self.model = model
        self.numbers: dict[str, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.begins, self.ids, self.characters = np.zeros(1, dtype=np.int64), np.zeros(0, dtype="<u4"), 0

    def full(self) -> bool:
        return len(self.numbers) >= TABLE_WORDS or self.characters >= TABLE_CHARACTERS

    def learn(self) -> None:
        """Segment the words that are new, each once, behind an anchor."""
        new = list(islice(self.numbers, len(self.begins) - 1, None))
        lengths, ids, part, size = [], [self.ids], [], 0
        for i, word in enumerate(new):
            part.append(f"{ANCHOR} {word}")
            size += len(word)
            if size >= CALL_CHARACTERS or i + 1 == len(new):
                found = self.model.encode(part, num_threads=1)
                lengths += [len(x) - 1 for x in found]
                ids.append(np.array([y for x in found for y in islice(x, 1, None)], dtype="<u4"))
                self.characters += size
                part, size = [], 0
        if new:
            self.begins = np.append(self.begins, self.begins[-1] + np.cumsum(lengths))
            self.ids = np.concatenate(ids)

    def joined(self, words: np.ndarray) -> bytes:
        """The ids of numbered words, one after the other."""
        parts = []
        for first in range(0, len(words), TOGETHER):
            own = words[first : first + TOGETHER]
            n = self.begins[own + 1] - self.begins[own]
            at = np.repeat(self.begins[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            parts.append(self.ids[at].tobytes())
        return b"".join(parts)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ends: bool = True) -> DataFrame:
    """``id_col`` (long) and ``ids``, the text's ids as little-endian unsigned 32-bit integers, for every row.

    They are those of the library for the whole text, with begin and end ids if
    ``ends``.  A null text counts as empty, a null id stays null, repeated rows stay
    repeated; other columns are not read, so their names do not matter.
    """
    check_model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _library(path)
        head, tail = (np.array([x], dtype="<u4").tobytes() if ends else b"" for x in (model.bos_id(), model.eos_id()))
        table = Table(model)
        keys, held, characters = [], [], 0

        def close() -> pa.RecordBatch:
            table.learn()
            ids = [b"".join((head, table.joined(words), tail)) for words in held]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.binary())], ["id", "ids"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                keys.append(key)
                held.append(_numbered(text, table.numbers))
                characters += len(text)
                if characters >= CALL_CHARACTERS:
                    yield close()
                    keys, held, characters = [], [], 0
                    table = Table(model) if table.full() else table
        if keys:
            yield close()

    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return texts.mapInArrow(run, "id long, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, ids, text``: the library's text of the ids of every row of :func:`encode`; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _library(path)
        for batch in batches:
            sizes, first = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)), 0
            while first < batch.num_rows:
                before = sizes[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(sizes, before + 4 * CALL_CHARACTERS, side="right")))
                part = batch.slice(first, last - first)
                ids = [None if x is None else np.frombuffer(x, dtype="<u4").tolist() for x in part.column(1).to_pylist()]
                texts = [None if x is None else model.decode(x) if x else "" for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["id", "ids", "text"])
                first = last

    return encoded.select(id_col, "ids").mapInArrow(run, "id long, ids binary, text string").withColumnRenamed("id", id_col)
