"""Ranked lexical search the other way round: documents stream past an index of the items.

The items (the queries) are few and the documents many, so the inverted index is
built over the items' terms and broadcast, and every document is read once: its term
counts meet the index, which gives its scores for all items, and each item keeps its
best documents so far.  A task returns at most ``k`` rows per item; these are merged
by salted ranks.

A score is a sum over terms of ``w * ((10**9 * tf) div (1000 * tf + 12 * m))`` with
``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))`` and ``m = 75 + (25 * n * N) div L``.
``N`` documents with a term, ``L`` their terms and ``df`` are taken over all documents
in a pass before.

Items are handled in blocks of bounded terms, one broadcast at a time.  Terms are
compared as 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from personyear.llm import hashing, shared
from personyear.session import written

TOP = 20
#: Distinct terms of a block of items with their items, which bounds a broadcast (24 bytes each); a larger item is a block of its own.
BLOCK_POSTINGS = 1 << 20
#: Items of a block, which bounds the results a task holds.
BLOCK_ITEMS = 1 << 12
#: Scores computed at once.
CELLS = 1 << 20
#: Least share of a block's items for a term to be multiplied as a row.
FREQUENT_SHARE, FREQUENT = 0.05, 512
SALT = 64
NO_ID = -(2**63)
#: Digits, letters and all that is not ASCII.
TERMS = hashing.byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Sums of whole numbers below this are exact in doubles.
EXACT = 1 << 53


@dataclass
class Index:
    """Terms in ascending order with the items that hold them."""

    terms: np.ndarray  # hashes
    term_from: np.ndarray
    item: np.ndarray
    count: np.ndarray
    n_items: int
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def split(self) -> None:
        """Rows of counts for terms of many items; the other terms stay postings."""
        times = np.diff(self.term_from)
        often = np.flatnonzero(times >= max(2, FREQUENT_SHARE * self.n_items))
        often = np.sort(often[np.argsort(-times[often], kind="stable")[:FREQUENT]])
        self.line = np.full(len(self.terms), -1)
        self.line[often] = np.arange(len(often))
        of = np.repeat(np.arange(len(self.terms)), times)
        here = self.line[of] >= 0
        self.rows = np.zeros((len(often), self.n_items))
        self.rows[self.line[of[here]], self.item[here]] = self.count[here]

    def largest(self) -> float:
        """No score is larger: the sum of an item's weights times the most that a term gives."""
        of = np.repeat(np.arange(len(self.terms)), np.diff(self.term_from))
        sums = np.bincount(self.item, self.count * self.weight[of], self.n_items)
        return float(sums.max(initial=0)) * 1e6

    def postings(self, piece: hashing.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and count of those terms of a piece that are some item's."""
        words = piece.hashes()
        if not len(self.terms) or not len(words):
            return (np.zeros(0, dtype=np.int64),) * 3
        place = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        here = self.terms[place] == words
        packed, count = np.unique(piece.row[here].astype(np.int64) * len(self.terms) + place[here], return_counts=True)
        return packed // len(self.terms), packed % len(self.terms), count


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, term, n``: how often an item holds a term; rows of one id are one item, null is an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = hashing.Powers()
        with np.errstate(over="ignore"):
            for batch in batches:
                key = batch.column(0).to_numpy()
                for piece in hashing.pieces(batch.column(1), TERMS, True, powers):
                    cells = [key[piece.first + piece.row], piece.hashes().view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells], ["item", "term"])

    found = _texts(items, id_col, text_col).mapInArrow(run, "item long, term long")
    return found.groupBy("item", "term").agg(F.count("*").alias("n"))


def _blocks(terms: DataFrame, postings: int, items: int) -> Iterator[tuple[np.ndarray, Index]]:
    """Item ids and index of one block of items after the other; only one is held."""
    held: list[tuple[int, list[int], list[int]]] = []
    size = 0

    def close() -> tuple[np.ndarray, Index]:
        item = np.repeat(np.arange(len(held)), [len(t) for _, t, _ in held])
        term = np.concatenate([np.array(t, dtype=np.int64).view(np.uint64) for _, t, _ in held])
        count = np.concatenate([np.array(n, dtype=np.int64) for _, _, n in held])
        order = np.lexsort((item, term))
        distinct, first = np.unique(term[order], return_index=True)
        index = Index(distinct, np.append(first, len(order)), item[order], count[order], len(held))
        return np.array([key for key, _, _ in held], dtype=np.int64), index

    per_item = terms.groupBy("item").agg(F.collect_list("term").alias("terms"), F.collect_list("n").alias("ns"))
    for row in per_item.toLocalIterator():
        if held and (size + len(row.terms) > postings or len(held) >= items):
            yield close()
            held, size = [], 0
        held.append((row.item, row.terms, row.ns))
        size += len(row.terms)
    if held:
        yield close()


def _statistics(texts: DataFrame, sent, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents of each term of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, powers = shared.received(sent), hashing.Powers()
        found, totals = np.zeros(len(index.terms), dtype=np.int64), [0, 0]
        with np.errstate(over="ignore"):
            for batch in batches:
                for piece in hashing.pieces(batch.column(0), TERMS, True, powers):
                    totals[0] += int((piece.counts() > 0).sum())
                    totals[1] += len(piece.row)
                    found += np.bincount(index.postings(piece)[1], minlength=len(found))
        seen = np.flatnonzero(found)
        place = np.concatenate(([-2, -1], seen))
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.concatenate((totals, found[seen])))], ["place", "n"])

    counted = texts.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    totals, df = [0, 0], np.zeros(n_terms, dtype=np.int64)
    for row in counted.collect():  # a number per term of the block, and two more
        if row.place < 0:
            totals[row.place + 2] = row.n
        else:
            df[row.place] = row.n
    return totals[0], totals[1], df


class Best:
    """The best documents of every item so far; of equal scores the smaller ids stay."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k, self.n_items = k, n_items
        self.floor = np.ones(n_items)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        """Scores of documents (rows) for items (columns)."""
        row, item = np.nonzero(scores >= self.floor)
        self.held.append((item, scores[row, item].astype(np.int64), keys[row]))
        self.size += len(row)
        if self.size > 4 * self.k * self.n_items + CELLS:
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        item, score, key = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.zeros(0, dtype=np.int64),) * 3
        order = np.lexsort((key, -score, item))
        item, score, key = item[order], score[order], key[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = rank < self.k
        last = rank == self.k - 1
        self.floor[item[last]] = score[last]
        self.held = [(item[keep], score[keep], key[keep])]
        self.size = int(keep.sum())
        return self.held[0]


def _scored(texts: DataFrame, sent, keys: np.ndarray, n_docs: int, n_words: int, k: int) -> DataFrame:
    """``item, doc, score, salt``: at most ``k`` documents per item from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, powers = shared.received(sent), hashing.Powers()
        index.split()
        best = Best(index.n_items, k)
        kind = np.float64 if index.largest() < EXACT else np.int64
        rows = index.rows.astype(kind)
        step = max(1, CELLS // max(1, index.n_items))
        times = np.diff(index.term_from)

        def score(row: np.ndarray, term: np.ndarray, gain: np.ndarray, count: int) -> np.ndarray:
            line = index.line[term]
            dense = np.zeros((count, len(rows)), dtype=kind)
            dense[row[line >= 0], line[line >= 0]] = gain[line >= 0]
            found = dense @ rows
            row, term, gain = row[line < 0], term[line < 0], gain[line < 0]
            n = times[term]
            at = np.repeat(index.term_from[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            np.add.at(found, (np.repeat(row, n), index.item[at]), (np.repeat(gain, n) * index.count[at]).astype(kind))
            return found

        with np.errstate(over="ignore"):
            for batch in batches:
                key = batch.column(0).to_numpy()
                for piece in hashing.pieces(batch.column(1), TERMS, True, powers):
                    length = piece.counts().astype(np.int64)
                    norm = 75 + (25 * length * n_docs) // max(1, n_words)
                    row, term, tf = index.postings(piece)
                    gain = index.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * norm[row]))
                    for first in range(0, piece.rows, step):
                        count = min(step, piece.rows - first)
                        some = slice(*np.searchsorted(row, (first, first + count)))
                        if some.start < some.stop:
                            own = key[piece.first + first : piece.first + first + count]
                            best.add(score(row[some] - first, term[some], gain[some], count), own)
        item, found, doc = best.shrink()
        salt = np.full(len(item), TaskContext.get().partitionId() % SALT, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[item], doc, found, salt)], ["item", "doc", "score", "salt"])

    return texts.mapInArrow(run, "item long, doc long, score long, salt long")


def _ranked(found: DataFrame, k: int, *groups: str) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", k: int = TOP,
    block_postings: int = BLOCK_POSTINGS, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """``item_col, rank, id_col, score``: the ``k`` best documents of every item, scores above 0 only.

    Every row of ``docs`` is a document of its own, also where ids or texts repeat;
    equal scores go by ascending id, a null id first.  Null and empty texts have no
    terms and count in no statistics.  Rows of ``items`` with one id are one item with
    the terms of all of them; null is an id too.  An item without terms or without any
    document that shares one has no rows.  Other columns are not read.
    """
    spark, texts = docs.sparkSession, _texts(docs, id_col, text_col)
    parts = []
    # Written, as the items are read block by block.
    terms = written(item_terms(items, item_col, text_col), "item-terms")
    for keys, index in _blocks(terms, block_postings, block_items):
        sent = shared.send(spark, index)
        n_docs, n_words, df = _statistics(texts, sent, len(index.terms))
        sent.unpersist()
        index.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], dtype=np.int64)
        sent = shared.send(spark, index)
        found = _scored(texts, sent, keys, n_docs, n_words, k)
        parts.append(written(_ranked(_ranked(found, k, "item", "salt"), k, "item"), "best"))
        sent.unpersist()
    if not parts:
        return spark.createDataFrame([], f"{item_col} long, rank int, {id_col} long, score long")
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    no_id = lambda name: F.when(F.col(name) != NO_ID, F.col(name))
    return united.select(no_id("item").alias(item_col), "rank", no_id("doc").alias(id_col), "score")
