"""Benchmark passages in training text, found through an FM-index per shard.

A shard is a run of whole documents of one task.  Its words become symbols: the
words of the test phrases are numbered, every other word is a break, and stretches
between breaks that are shorter than the shortest phrase are left out, as no
phrase can lie in them.  The shard's text gets a suffix order, its Burrows-Wheeler
transform is kept in a wavelet matrix, and all phrases are searched backwards at
once through rank queries.  Rows of the matches are walked back to the nearest
sampled suffix position, which gives the places; places give byte spans, and
overlapping spans are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, LongType, StringType, StructField, StructType,
)

from personyear.llm import hashing, shared

WINDOW = 10
#: Words of a shard, and of the phrases searched in one block.
SHARD_WORDS = 1 << 22
BLOCK_BYTES = 16 << 20
#: Every so many text positions one suffix position is kept.
SAMPLE = 16


class WaveletMatrix:
    """Rank and access over integer symbols, one bit plane per level."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.size = bits, len(symbols)
        self.ones: list[np.ndarray] = []  # ones before each position
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(len(bit) - self.ones[-1][-1]))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        low, high = np.zeros_like(places), places
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbols >> (self.bits - 1 - level)) & 1
            low = np.where(bit, zeros + ones[low], low - ones[low])
            high = np.where(bit, zeros + ones[high], high - ones[high])
        return high - low

    def access(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before."""
        symbols, low, high = np.zeros_like(places), np.zeros_like(places), places
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[high + 1] - ones[high]
            symbols = symbols << 1 | bit
            low = np.where(bit, zeros + ones[low], low - ones[low])
            high = np.where(bit, zeros + ones[high], high - ones[high])
        return symbols, high - low


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling; only suffixes that still tie are sorted again."""
    size = len(symbols)
    order = np.argsort(symbols, kind="stable")
    changed = np.concatenate(([True], symbols[order][1:] != symbols[order][:-1])) if size else np.zeros(0, bool)
    rank = np.empty(size, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(changed, np.arange(size), 0))
    reach = 1
    while True:
        alone = changed & np.concatenate((changed[1:], [True])) if size else changed
        open_slots = np.flatnonzero(~alone)
        if not len(open_slots):
            return order
        tied = order[open_slots]
        ahead = np.where(tied + reach < size, rank[np.minimum(tied + reach, size - 1)], -1)
        turn = np.lexsort((ahead, rank[tied]))
        tied, ahead = tied[turn], ahead[turn]
        group = rank[tied]
        order[open_slots] = tied
        differs = np.concatenate(([True], (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])))
        changed[open_slots] = differs
        heads = np.maximum.accumulate(np.where(differs, np.arange(len(tied)), 0))
        rank[tied] = open_slots[heads]
        reach *= 2


class FmIndex:
    """Backward search over a text of symbols 1..n; 0 ends it."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        text = np.concatenate((symbols, [0])).astype(np.int64)
        order = suffix_order(text)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=alphabet + 1))))
        self.tree = WaveletMatrix(text[order - 1], max(1, int(alphabet).bit_length()))
        kept = (order % SAMPLE == 0) | (order == len(text) - 1)
        self.kept_before = np.concatenate(([0], np.cumsum(kept))).astype(np.int32)
        self.samples = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the phrases; a phrase fills the right end of its line."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.tree.size, dtype=np.int64)
        for step in range(1, phrases.shape[1] + 1):
            going = np.flatnonzero((lengths >= step) & (low < high))
            if not len(going):
                break
            symbol = phrases[going, phrases.shape[1] - step]
            low[going] = self.first[symbol] + self.tree.rank(symbol, low[going])
            high[going] = self.first[symbol] + self.tree.rank(symbol, high[going])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order."""
        found = np.empty(len(rows), dtype=np.int64)
        open_rows, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(open_rows):
            known = self.kept_before[rows + 1] > self.kept_before[rows]
            found[open_rows[known]] = self.samples[self.kept_before[rows[known]]] + steps
            open_rows, rows = open_rows[~known], rows[~known]
            symbols, before = self.tree.access(rows)
            rows, steps = self.first[symbols] + before, steps + 1
        return found


@dataclass
class Phrases:
    """Distinct phrases of a block of test items, as symbols, and the items that hold each."""

    vocabulary: np.ndarray  # sorted word hashes; symbol = place + 2, as 1 is the break
    symbols: np.ndarray  # phrases, filled to the right end
    lengths: np.ndarray
    item_from: np.ndarray  # of each phrase into items
    items: np.ndarray


def _phrases(column: pa.Array, items: np.ndarray, window: int) -> Phrases | None:
    powers, lines, lengths, owners = hashing.Powers(), [], [], []
    for piece in hashing.pieces(column, hashing.LETTERS, True, powers):
        hashes, counts = piece.hashes(), piece.counts()
        base = hashing.first_words(counts)
        for row in np.flatnonzero(counts):
            length = min(int(counts[row]), window)
            own = hashes[base[row] : base[row] + counts[row]]
            part = np.lib.stride_tricks.sliding_window_view(own, length)
            line = np.zeros((len(part), window), dtype=np.uint64)
            line[:, window - length :] = part
            lines.append(line)
            lengths.append(np.full(len(part), length))
            owners.append(np.full(len(part), items[piece.first + row]))
    if not lines:
        return None
    line, length, owner = np.concatenate(lines), np.concatenate(lengths), np.concatenate(owners)
    vocabulary = np.unique(line[line != 0])
    symbols = np.where(line != 0, np.searchsorted(vocabulary, line) + 2, 0)
    symbols, place = np.unique(np.column_stack((length, symbols)), axis=0, return_inverse=True)
    pairs = np.unique(np.column_stack((place.ravel(), owner)), axis=0)
    item_from = np.searchsorted(pairs[:, 0], np.arange(len(symbols) + 1))
    return Phrases(vocabulary, symbols[:, 1:], symbols[:, 0], item_from, pairs[:, 1])


def phrase_blocks(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcast blocks of phrases, each from at most ``block_bytes`` of item text (or one longer item).

    Items are read one partition at a time, so the driver holds one block.  An item
    without id takes part as item -1.
    """
    spark = items.sparkSession
    blocks, texts, ids, held = [], [], [], 0

    def close() -> None:
        nonlocal held
        block = _phrases(pa.array(texts, pa.string()), np.array(ids, dtype=np.int64), window)
        if block is not None:
            blocks.append(shared.send(spark, block))
        texts.clear()
        ids.clear()
        held = 0

    rows = items.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), F.col(text_col).cast("string"))
    for key, text in rows.toLocalIterator():
        if texts and held + len(text or "") > block_bytes:
            close()
        texts.append(text)
        ids.append(key)
        held += len(text or "")
    close()
    return blocks


def _search(words: list[np.ndarray], rows: list[np.ndarray], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word places, lengths and phrase numbers of all occurrences in a shard.

    ``words`` are the word hashes of the shard's documents and ``rows`` the
    document of each word.
    """
    word, row = np.concatenate(words), np.concatenate(rows)
    none = np.zeros(0, dtype=np.int64)
    if not len(word):
        return none, none, none
    place = np.minimum(np.searchsorted(phrases.vocabulary, word), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[place] == word
    # Stretches of known words in one document, at least as long as the shortest phrase.
    begins = known & np.concatenate(([True], ~known[:-1] | (row[1:] != row[:-1])))
    stretch = np.cumsum(begins)[known] - 1
    long_enough = np.bincount(stretch) >= phrases.lengths.min() if len(stretch) else np.zeros(0, bool)
    at = np.flatnonzero(known)[long_enough[stretch]] if len(stretch) else none
    if not len(at):
        return none, none, none
    joins = np.concatenate(([False], (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])))
    slots = np.arange(len(at)) + np.cumsum(joins)
    text = np.ones(slots[-1] + 1, dtype=np.int64)  # 1 is the break
    text[slots] = place[at] + 2
    origin = np.zeros(len(text), dtype=np.int64)
    origin[slots] = at
    index = FmIndex(text, len(phrases.vocabulary) + 1)
    low, high = index.search(phrases.symbols, phrases.lengths)
    hits = np.flatnonzero(high > low)
    times = (high - low)[hits]
    phrase = np.repeat(hits, times)
    matrix_rows = np.repeat(low[hits] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
    return origin[index.locate(matrix_rows)], phrases.lengths[phrase], phrase


class _Shard:
    """Documents of one task, searched together."""

    def __init__(self) -> None:
        self.words: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.batches: list[pa.RecordBatch] = []
        self.count = self.n_words = 0

    def add(self, batch: pa.RecordBatch, piece: hashing.Piece) -> None:
        self.words.append(piece.hashes())
        self.rows.append(piece.row + self.count)
        self.starts.append(piece.starts - piece.offsets[piece.row])
        self.ends.append(piece.ends - piece.offsets[piece.row])
        self.lengths.append(piece.counts())
        self.batches.append(batch.slice(piece.first, piece.rows))
        self.count += piece.rows
        self.n_words += len(piece.row)

    def found(self, blocks: list) -> pa.Table:
        counts = np.concatenate(self.lengths)
        base = hashing.first_words(counts)
        rows = np.concatenate(self.rows)
        covered = np.zeros(self.n_words + 1, dtype=np.int64)
        owners: list[np.ndarray] = []
        for block in blocks:
            phrases = shared.received(block)
            place, length, phrase = _search(self.words, self.rows, phrases)
            np.add.at(covered, place, 1)
            np.add.at(covered, place + length, -1)
            pairs = np.unique(np.column_stack((rows[place], phrase)), axis=0)
            times = (phrases.item_from[1:] - phrases.item_from[:-1])[pairs[:, 1]]
            offsets = np.repeat(phrases.item_from[pairs[:, 1]] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
            owners.append(np.unique(np.column_stack((np.repeat(pairs[:, 0], times), phrases.items[offsets])), axis=0))
        hit = np.cumsum(covered)[:-1] > 0
        n_hit = np.bincount(rows[hit], minlength=self.count)
        begins = np.flatnonzero(hit & np.concatenate(([True], ~hit[:-1] | (rows[1:] != rows[:-1]))))
        closes = np.flatnonzero(hit & np.concatenate((~hit[1:] | (rows[1:] != rows[:-1]), [True])))
        starts, ends = np.concatenate(self.starts), np.concatenate(self.ends)
        spans: list[list] = [[] for _ in range(self.count)]
        for a, z in zip(begins, closes, strict=True):
            spans[rows[a]].append({"start": int(starts[a]), "end": int(ends[z])})
        items: list[list] = [[] for _ in range(self.count)]
        for row, item in np.unique(np.concatenate(owners), axis=0) if owners else ():
            items[row].append(int(item))
        del base
        added = [
            pa.array(counts, pa.int64()),
            pa.array(n_hit, pa.int64()),
            pa.array([len(x) for x in items], pa.int64()),
            pa.array([_digest(x) for x in items], pa.string()),
            pa.array(n_hit > 0),
            pa.array(items, pa.list_(pa.int64())),
            pa.array(spans, pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))),
        ]
        table = pa.Table.from_batches(self.batches)
        for name, column in zip(ADDED, added, strict=True):
            table = table.append_column(name, column)
        return table


ADDED = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans")


def _digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def contamination(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All rows and columns of ``docs`` with what they share with the test items (clashing columns are replaced).

    A phrase is ``window`` consecutive words of an item, or all of a shorter one.
    Added: ``n_words``; ``n_hit``, words inside an occurrence; ``n_items`` and
    ``items``, the items with an occurring phrase; ``items_sha256`` over their ids,
    sorted as text; ``contaminated``; ``spans``, merged byte ranges from the first
    to the last word hit.  A null or empty text has no words and no hit.
    """
    docs = docs.select([c for c in docs.columns if c not in ADDED])
    blocks = phrase_blocks(items, item_id, item_text, window, block_bytes)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, shard = hashing.Powers(), _Shard()
        with np.errstate(over="ignore"):
            for batch in batches:
                for piece in hashing.pieces(batch.column(place), hashing.LETTERS, True, powers):
                    shard.add(batch, piece)
                    if shard.n_words >= shard_words:
                        yield from shard.found(blocks).to_batches()
                        shard = _Shard()
            if shard.count:
                yield from shard.found(blocks).to_batches()

    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    kinds = (LongType(), LongType(), LongType(), StringType(), BooleanType(), ArrayType(LongType()), ArrayType(span))
    added = [StructField(name, kind) for name, kind in zip(ADDED, kinds, strict=True)]
    return docs.mapInArrow(run, StructType(docs.schema.fields + added))


def without_spans(found: DataFrame, text_col: str = "text") -> DataFrame:
    """Cut the spans out of the texts and drop what ``contamination`` added.

    A document all of whose words were hit has nothing left and goes; every other
    document stays.
    """
    # Byte ranges begin and end between characters, so the pieces are text again.
    data = F.encode(text_col, "utf-8")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.col("spans.end"))
    ends = F.concat(F.col("spans.start"), F.array(F.octet_length(text_col).cast("long")))
    parts = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("z")), lambda x: data.substr(x["a"].cast("int") + 1, (x["z"] - x["a"]).cast("int")))
    cleaned = F.decode(F.aggregate(parts, F.lit(b""), lambda x, y: F.concat(x, y)), "utf-8")
    return (
        found.where("n_words = 0 or n_hit < n_words")
        .withColumn(text_col, F.when(F.col("contaminated"), cleaned).otherwise(F.col(text_col)))
        .drop(*ADDED)
    )
