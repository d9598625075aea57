"""Repeated passages by content-defined chunks.

A gear hash rolls over the bytes of a text; a chunk ends before a word where the
hash of the last 16 bytes falls under a threshold, so boundaries depend on nearby
content only and an insertion moves none but its own.  A passage that repeats a few
words over and over has few different hashes, often none under the threshold; where
the last words have none, the smallest hash among them ends a chunk, each time it
comes, so such a passage is cut once a period, at the same words in every copy.
Neighbouring chunks are taken together until they have enough words, onwards from each chunk and back
from each, and such a stretch carries a digest of its chunks.  The first copy of a
digest, by id and place, stays; later copies are cut from the text.

So all chunks of a stretch stood together in one earlier place.  A run of chunks
with enough words that stands in an earlier place is the union of its stretches:
those onwards from its first chunk and back from each later one lie inside it.

Words are what stands between blanks: a text without blanks is one word, and
nothing inside it is found.

Digests are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from personyear.llm import hashing
from personyear.session import written

GEAR_BYTES = 16
#: One word in so many begins a chunk.
CHUNK_WORDS = 4
#: Where so many words together begin no chunk, one with the smallest hash among them does.
CALM_WORDS = 12
#: Shortest run of repeats that is cut.
LEAST_WORDS = 20
#: Digests that one task compares before it hands them on.
LOCAL_CHUNKS = 1 << 21
#: A stretch is one number: its first word in the high bits, its count of words in the low ones.
PLACE_BITS = 32

SPANS = pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))


def _gear() -> np.ndarray:
    return (hashing.odd_constants(256, 77) >> np.uint64(20)).astype(np.uint32)


def _smallest(values: np.ndarray, count: int) -> np.ndarray:
    """The smallest of each value and the ``count - 1`` before it, fewer at the beginning."""
    found, reach = values.copy(), 1
    while reach < count:
        step = min(reach, count - reach)
        found[step:] = np.minimum(found[step:], found[:-step])
        reach += step
    return found


def _chunks(piece: hashing.Piece, gear: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per chunk: row, index of its first word, and digest of its words with the blanks between them."""
    starts, row = piece.starts, piece.row
    rolled = np.zeros(len(starts), dtype=np.uint32)
    begin = piece.offsets[row]
    for back in range(1, GEAR_BYTES + 1):
        at = starts - back
        rolled += np.where(at >= begin, gear[piece.data[np.maximum(at, 0)]] << np.uint32(back - 1), np.uint32(0))
    low = rolled & np.uint32(0xFFFF)
    cut = low < np.uint32(0x10000 // CHUNK_WORDS)
    smallest = _smallest(low, CALM_WORDS)
    inside = np.arange(len(starts)) - hashing.first_words(piece.counts())[row] >= CALM_WORDS - 1
    cut |= inside & (low == smallest)
    if len(cut):
        cut[0] = True
        cut[1:] |= row[1:] != row[:-1]
    first = np.flatnonzero(cut)
    last = np.concatenate((first[1:], [len(starts)])) - 1 if len(first) else first
    return row[first], first, piece.spans(starts[first], piece.ends[last])


def _stretches(piece: hashing.Piece, gear: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per stretch: row, place (see ``PLACE_BITS``), and digest of its chunks.

    A stretch has at least ``least_words`` words and would have fewer without its last chunk or without its first.
    """
    row, first, digest = _chunks(piece, gear)
    count = len(first)
    ends = np.append(first[1:], len(piece.starts)) if count else first
    last = np.searchsorted(ends, first + least_words)
    onwards = np.flatnonzero((last < count) & (row[np.minimum(last, count - 1)] == row)) if count else first
    begin = np.searchsorted(first, ends - least_words, side="right") - 1
    back = np.flatnonzero((begin >= 0) & (row[begin] == row) & (last[begin] != np.arange(count)))
    one, end = np.concatenate((onwards, begin[back])), np.concatenate((last[onwards], back)) + 1
    piece.powers.reach(count + 1)
    sums = np.zeros(count + 1, dtype=np.uint64)
    np.cumsum(digest * piece.powers.up[:count], out=sums[1:])
    together = hashing.mix((sums[end] - sums[one]) * piece.powers.down[one] + (end - one).astype(np.uint64))
    words = ends[end - 1] - first[one]
    place = first[one] - hashing.first_words(piece.counts())[row[one]]
    return row[one], place << PLACE_BITS | words, together


def _digests(docs: DataFrame, least_words: int) -> DataFrame:
    """``digest, id, text_key, place, repeat``: stretches that no earlier document of the same task has, or places known to repeat.

    A digest that is frequent leaves a task once, however many documents have it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear, powers = _gear(), hashing.Powers()
        held: list[tuple[np.ndarray, ...]] = []

        def handed() -> pa.RecordBatch:
            digest, key, text_key, place = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((place, text_key, key, digest))
            digest, key, text_key, place = (x[order] for x in (digest, key, text_key, place))
            repeat = _later(digest, key, text_key, place)
            return pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (digest.view(np.int64), key, text_key, place, repeat)],
                ["digest", "id", "text_key", "place", "repeat"],
            )

        with np.errstate(over="ignore"):
            for batch in batches:
                keys, text_keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                for piece in hashing.pieces(batch.column(2), hashing.NOT_BLANK, False, powers):
                    row, place, digest = _stretches(piece, gear, least_words)
                    held.append((digest, keys[piece.first + row], text_keys[piece.first + row], place))
                    if sum(len(x[0]) for x in held) >= LOCAL_CHUNKS:
                        yield handed()
            if held:
                yield handed()

    return docs.mapInArrow(run, "digest long, id long, text_key long, place long, repeat boolean")


def _later(digest: np.ndarray, key: np.ndarray, text_key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which of the rows, sorted by these columns, come later than the first of their digest.

    Rows of the same id, text and place are the same stretch of a repeated row; none is later than the other.
    """
    if not len(digest):
        return np.zeros(0, dtype=bool)
    begins = np.concatenate(([True], digest[1:] != digest[:-1]))
    at = np.maximum.accumulate(np.where(begins, np.arange(len(digest)), 0))
    return (key != key[at]) | (text_key != text_key[at]) | (place != place[at])


def _repeats(digests: DataFrame) -> DataFrame:
    """``id, text_key, places``: the stretches of a text that are later copies, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            digest, key, text_key, place, repeat = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            whole = [digest, key, text_key, place]
            if before is not None:
                whole = [np.concatenate((b, x)) for b, x in zip(before, whole, strict=True)]
            later = _later(*whole)
            first = 0 if before is None else 1
            begins = np.flatnonzero(np.concatenate(([True], whole[0][1:] != whole[0][:-1])))
            before = [x[begins[-1] : begins[-1] + 1] for x in whole]
            later = later[first:] | repeat
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[later]) for x in (key, text_key, place)], ["id", "text_key", "place"]
            )

    # Known repeats need no company: they go by their text, so that no digest gathers them.
    dealt = F.when(F.col("repeat"), F.xxhash64("id", "place")).otherwise(F.col("digest"))
    ordered = digests.repartition(dealt).sortWithinPartitions("digest", "id", "text_key", "place")
    places = ordered.mapInArrow(run, "id long, text_key long, place long")
    return places.groupBy("id", "text_key").agg(F.sort_array(F.collect_set("place")).alias("places"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """All rows and columns of ``docs`` with ``deduplicated`` and ``spans, n_words, n_removed`` (clashing columns are replaced).

    ``deduplicated`` is the text without the later copies of passages of at least
    ``least_words`` words that stand together in an earlier text, or earlier in the
    same one; ``spans`` are the byte ranges cut out of it (``start, end``),
    ``n_removed`` the words in them.  A passage is found through the whole chunks
    inside it, so up to a chunk at either end stays.  A null text
    stays null and an empty one empty.  Among rows with the same id and text none
    counts as the copy of another; a row without id comes before all others.
    """
    own = {"deduplicated", "spans", "n_words", "n_removed"}
    docs = docs.select([c for c in docs.columns if c not in own])
    names = docs.columns
    keyed = docs.withColumns(
        {"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), "__text_key": F.xxhash64(text_col)}
    )
    digests = _digests(keyed.select("__id", "__text_key", F.col(text_col).cast("string")), least_words)
    repeats = written(_repeats(digests), "repeats").toDF("__id", "__text_key", "__places")
    joined = keyed.join(repeats, ["__id", "__text_key"], "left").select(*names, "__places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = hashing.Powers()
        with np.errstate(over="ignore"):
            for batch in batches:
                texts, places = batch.column(names.index(text_col)), batch.column(len(names))
                for piece in hashing.pieces(texts, hashing.NOT_BLANK, False, powers):
                    some = slice(piece.first, piece.first + piece.rows)
                    spans, counts = _runs(piece, places[some])
                    cleaned = [_without(t, s) if s else t for t, s in zip(texts[some].to_pylist(), spans, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(column[some] for column in batch.columns[: len(names)]),
                            pa.array(cleaned, pa.string()),
                            pa.array([[{"start": a, "end": b} for a, b, _ in s] for s in spans], SPANS),
                            pa.array(counts, pa.int64()),
                            pa.array([sum(n for *_, n in s) for s in spans], pa.int64()),
                        ],
                        [*names, "deduplicated", "spans", "n_words", "n_removed"],
                    )

    added = [
        StructField("deduplicated", StringType()),
        StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))),
        StructField("n_words", LongType()),
        StructField("n_removed", LongType()),
    ]
    return joined.mapInArrow(run, StructType(docs.schema.fields + added))


def _runs(piece: hashing.Piece, places: pa.Array) -> tuple[list[list[tuple]], np.ndarray]:
    """Byte spans and words of what the repeated stretches of each text cover, and the words of each text."""
    counts = piece.counts()
    base = hashing.first_words(counts)
    spans: list[list[tuple]] = []
    for i, marked in enumerate(places.to_pylist()):
        found: list[tuple] = []
        if marked:
            marked = np.array(marked, dtype=np.int64)
            begins = marked >> PLACE_BITS
            reached = np.maximum.accumulate(begins + (marked & ((1 << PLACE_BITS) - 1)))
            new = np.flatnonzero(np.concatenate(([True], begins[1:] > reached[:-1])))
            for a, z in zip(begins[new], reached[np.append(new[1:], len(marked)) - 1], strict=True):
                start = int(piece.starts[base[i] + a] - piece.offsets[i])
                end = int((piece.offsets[i + 1] if z == counts[i] else piece.starts[base[i] + z]) - piece.offsets[i])
                found.append((start, end, int(z - a)))
        spans.append(found)
    return spans, counts


def _without(text: str, spans: list[tuple]) -> str:
    """The text without byte spans that begin and end between characters."""
    data, parts, at = text.encode(), [], 0
    for start, end, *_ in spans:
        parts.append(data[at:start])
        at = end
    parts.append(data[at:])
    return b"".join(parts).decode()
