"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Labelled examples are fitted on a bounded sample per class (``SAMPLE_PER_CLASS``
examples, chosen by a hash of their id).  Terms are words and their first few
letters, so that the forms of a stem count together, each as "at least so many
times" in the text, as some tell only when repeated.  From the sample come the
vocabulary - terms much more frequent in toxic examples than in others - and an
inverted index of the examples over that vocabulary, in blocks that know the largest
weight of each term.
A text is scored against the blocks in the order of their upper bounds; blocks that
cannot hold one of its nearest examples are skipped, so the neighbours are exact.
Neighbours vote with a power of their cosine, weighted back to the class sizes before
sampling, and the share of toxic examples without any term of the vocabulary
stands for texts that have none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from personyear.llm import hashing, shared
from personyear.session import written

SAMPLE_PER_CLASS = 4_000
VOCABULARY = 2_048
NEIGHBOURS = 25
#: Power of the cosine that a neighbour votes with.
SHARPNESS = 3
BLOCK = 64
#: Lengths of the beginnings of words that are terms as well.
STEMS = (4, 5, 6, 7)
#: A term counts separately for each of these numbers of occurrences that it reaches.
LEVELS = (1, 2, 4)
#: Least share and number of toxic examples with a term, and how many times its share
#: of the other class that is, for the term to be in the vocabulary.
LEAST_SHARE = 0.01
LEAST_COUNT = 5
LEAST_RATIO = 8.0
#: Least log-likelihood ratio, so that none of many rare terms gets in by chance.
LEAST_GAIN = 10.0
#: Votes of the class shares, so that few neighbours do not give certainty.
PRIOR_VOTES = 0.5
CUT = 0.3


def _term_counts(column: pa.Array, keys: np.ndarray | None, powers: hashing.Powers) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, rows, and (row, term, count) of each piece; with ``keys``, terms as places in these sorted hashes."""
    for piece in hashing.pieces(column, hashing.LETTERS, True, powers):
        terms, rows = [piece.hashes()], [piece.row]
        for characters in STEMS:
            words, stems = piece.beginnings(characters)
            terms.append(stems)
            rows.append(piece.row[words])
        term, row = np.concatenate(terms), np.concatenate(rows)
        if keys is not None:
            place = np.minimum(np.searchsorted(keys, term), max(len(keys) - 1, 0))
            known = keys[place] == term if len(keys) else np.zeros(len(term), bool)
            term, row = place[known], row[known]
        order = np.lexsort((term, row))
        term, row = term[order], row[order]
        begins = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (row[1:] != row[:-1])))) if len(term) else np.zeros(0, int)
        counts = np.diff(np.concatenate((begins, [len(term)])))
        yield piece.first, piece.rows, row[begins], term[begins], counts


@dataclass
class Vocabulary:
    """Terms that tell the classes apart, each from some number of occurrences on."""

    keys: np.ndarray  # sorted hashes of the terms
    entry: np.ndarray  # by term and level, -1 where that is not in the vocabulary

    @property
    def size(self) -> int:
        return int(self.entry.max(initial=-1)) + 1

    def entries(self, column: pa.Array, powers: hashing.Powers) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """First row, rows, and (row, entry, count) of each piece, by row and entry."""
        for first, rows, row, term, count in _term_counts(column, self.keys, powers):
            found = [(row[count >= n], self.entry[term[count >= n], i], count[count >= n]) for i, n in enumerate(LEVELS)]
            row, entry, count = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((entry, row))
            order = order[entry[order] >= 0]
            yield first, rows, row[order], entry[order], count[order]


@dataclass
class Index:
    """Examples over the vocabulary as an inverted index with block maxima."""

    vocabulary: Vocabulary
    idf: np.ndarray
    ids: np.ndarray  # of the examples that have a word of it
    labels: np.ndarray
    post_from: np.ndarray  # of each word and block into the postings
    post_example: np.ndarray
    post_weight: np.ndarray
    block_max: np.ndarray  # word by block
    class_weight: np.ndarray  # rows before sampling for one sampled row
    prior: float  # of label 1 where no word is known

    def neighbours(self, words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples with the largest cosine, ties by place, and their cosines."""
        weight = (1 + np.log(counts)) * self.idf[words]
        weight = weight / np.sqrt((weight**2).sum())
        bounds = weight @ self.block_max[words]
        best_example, best = np.zeros(0, dtype=np.int64), np.zeros(0)
        for block in np.argsort(-bounds, kind="stable"):
            # A block that only reaches the last score may still win a tie; rounding gets a margin.
            if bounds[block] <= 0 or len(best) == k and bounds[block] < best[-1] - 1e-9:
                break
            scores = np.zeros(BLOCK)
            for word, own in zip(words, weight, strict=True):
                some = slice(self.post_from[word, block], self.post_from[word, block + 1])
                scores[self.post_example[some] - block * BLOCK] += own * self.post_weight[some]
            found = np.flatnonzero(scores)
            best_example = np.concatenate((best_example, found + block * BLOCK))
            best = np.round(np.concatenate((best, scores[found])), 12)
            order = np.lexsort((best_example, -best))[:k]
            best_example, best = best_example[order], best[order]
        return best_example, best

    def score(self, words: np.ndarray, counts: np.ndarray, k: int) -> tuple[float, list[int]]:
        """Share of toxic votes, and the ids of the neighbours."""
        if not len(words):
            return self.prior, []
        examples, cosines = self.neighbours(words, counts, k)
        labels = self.labels[examples]
        votes = cosines**SHARPNESS * self.class_weight[labels]
        toxic, total = votes[labels == 1].sum(), votes.sum()
        return float((toxic + PRIOR_VOTES * self.prior) / (total + PRIOR_VOTES)), self.ids[examples].tolist()


def fit(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS, vocabulary: int = VOCABULARY) -> Index:
    """The index of labelled texts: ``docs`` has ``id, text`` and ``labels`` has ``id, label`` (0 or 1, one row per id).

    At most ``sample_per_class`` examples of a class, by a hash of their id, are
    fitted; class sizes are counted over all labels.  Terms are counted by Spark;
    the vocabulary and the examples' counts over it reach the driver.  Of rows that
    share an id the smallest text is the example, and equal texts of a class are one
    in the counts.  Without examples of both classes no term tells them apart, and
    every text gets the share of label 1 (one half without any label).
    """
    sizes = dict(labels.groupBy("label").count().collect())
    totals = np.array([sizes.get(0, 0), sizes.get(1, 0)], dtype=float)
    sides = [labels.where(F.col("label") == x).orderBy(F.xxhash64("id"), "id").limit(sample_per_class) for x in (0, 1)]
    # At most two numbers for each of twice sample_per_class rows are broadcast.
    chosen = docs.join(F.broadcast(sides[0].union(sides[1])), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    chosen = written(chosen, "examples")
    terms = _vocabulary(chosen, vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = hashing.Powers()
        with np.errstate(over="ignore"):
            for batch in batches:
                for first, rows, row, places, counts in terms.entries(batch.column(2), powers):
                    cuts = np.searchsorted(row, np.arange(1, rows))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(first, rows),
                            batch.column(1).slice(first, rows),
                            pa.array([x.tolist() for x in np.split(places, cuts)], pa.list_(pa.int64())),
                            pa.array([x.tolist() for x in np.split(counts, cuts)], pa.list_(pa.int64())),
                        ],
                        ["id", "label", "places", "counts"],
                    )

    rows = chosen.select("id", "label", "text").mapInArrow(count, "id long, label int, places array<long>, counts array<long>").collect()
    rows.sort(key=lambda r: r.id)
    labels_of = np.array([r.label for r in rows], dtype=np.int64)
    vectors = [(np.array(r.places, dtype=np.int64), np.array(r.counts, dtype=np.int64)) for r in rows]
    class_weight = totals / np.maximum(np.bincount(labels_of, minlength=2), 1)
    class_weight = class_weight / max(class_weight.max(), 1e-300)
    has = np.array([len(p) > 0 for p, _ in vectors], dtype=bool)
    without = labels_of[~has]
    votes = class_weight[without]
    if len(without):
        prior = float((votes[without == 1].sum() + 0.5 * class_weight[1]) / (votes.sum() + class_weight.sum()))
    else:
        prior = float(totals[1] / totals.sum()) if totals.sum() else 0.5
    frequency = np.bincount(np.concatenate([p for p, _ in vectors] or [np.zeros(0, int)]), minlength=terms.size)
    idf = np.log((1 + len(rows)) / (1 + frequency)) + 1
    return _inverted(terms, idf, rows, labels_of, vectors, has, class_weight, prior)


def _vocabulary(examples: DataFrame, most: int) -> Vocabulary:
    """The terms that tell the classes apart, the best by the likelihood ratio.

    A term must be in a share of the toxic examples, and in a many times smaller
    share of the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = hashing.Powers()
        with np.errstate(over="ignore"):
            for batch in batches:
                labels = batch.column(0).to_numpy()
                for first, _, row, terms, counts in _term_counts(batch.column(1), None, powers):
                    for level, n in enumerate(LEVELS):
                        often = counts >= n
                        columns = labels[first + row[often]], terms[often].view(np.int64), np.full(often.sum(), level, dtype=np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["label", "term", "level"])

    distinct = examples.select("label", "text").distinct()
    sizes = dict(distinct.groupBy("label").count().collect())
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Vocabulary(np.zeros(0, dtype=np.uint64), np.zeros((0, len(LEVELS)), dtype=np.int64))
    found = distinct.mapInArrow(run, "label int, term long, level int").groupBy("term", "level")
    counted = found.agg(F.count_if(F.col("label") == 0).alias("h0"), F.count_if(F.col("label") == 1).alias("h1"))
    s0, s1 = (F.col("h0") + 0.5) / (n0 + 1), (F.col("h1") + 0.5) / (n1 + 1)
    pooled = (F.col("h0") + F.col("h1") + 0.5) / (n0 + n1 + 1)
    gain = sum(
        F.col(h) * F.ln(s / pooled) + (F.lit(n) - F.col(h)) * F.ln((1 - s) / (1 - pooled)) for h, s, n in (("h0", s0, n0), ("h1", s1, n1))
    )
    telling = counted.where((F.col("h1") >= max(LEAST_COUNT, LEAST_SHARE * n1)) & (s1 >= LEAST_RATIO * s0) & (gain >= LEAST_GAIN))
    best = telling.orderBy(gain.desc(), "term", "level").limit(most).select("term", "level").collect()
    chosen = sorted((r.term % (1 << 64), r.level) for r in best)
    keys = np.unique(np.array([t for t, _ in chosen], dtype=np.uint64))
    entry = np.full((len(keys), len(LEVELS)), -1, dtype=np.int64)
    for number, (term, level) in enumerate(chosen):
        entry[np.searchsorted(keys, np.uint64(term)), level] = number
    return Vocabulary(keys, entry)


def _inverted(terms, idf, rows, labels, vectors, has, class_weight, prior) -> Index:
    size = terms.size
    weighted = []
    for place, count in vectors:
        weight = (1 + np.log(count)) * idf[place]
        weighted.append((place, weight / np.sqrt((weight**2).sum()) if len(place) else weight))
    # Examples with the same words stand together, so that blocks have tight maxima.
    order = sorted(np.flatnonzero(has), key=lambda i: (weighted[i][0].tolist(), i))
    blocks = max(1, -(-len(order) // BLOCK))
    word = np.concatenate([weighted[i][0] for i in order] or [np.zeros(0, int)])
    weight = np.concatenate([weighted[i][1] for i in order] or [np.zeros(0)])
    example = np.repeat(np.arange(len(order)), [len(weighted[i][0]) for i in order])
    turn = np.lexsort((example, word))
    word, weight, example = word[turn], weight[turn], example[turn]
    cell = word * blocks + example // BLOCK
    limits = np.searchsorted(cell, np.arange(size * blocks + 1))
    block_max = np.zeros(size * blocks)
    np.maximum.at(block_max, cell, weight)
    post_from = np.column_stack((limits[:-1].reshape(size, blocks), limits[blocks::blocks])) if size else np.zeros((0, blocks + 1), int)
    ids = np.array([-1 if rows[i].id is None else rows[i].id for i in order], dtype=np.int64)
    return Index(
        terms, idf, ids, labels[order] if order else np.zeros(0, int), post_from, example, weight,
        block_max.reshape(size, blocks), class_weight, prior,
    )


SCORED = ("score", "predicted", "evidence")


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    neighbours: int = NEIGHBOURS, cut: float = CUT, **fitting: int,
) -> DataFrame:
    """All rows and columns of ``docs`` with ``score``, ``predicted`` and ``evidence`` (clashing columns are replaced).

    Learns from the rows of ``labels`` that are not held out and have label 0 or 1;
    an id with both is toxic.  Only the text is an input of the score.  ``evidence``
    lists the ids of the nearest examples, nearest first; it is empty where a text
    has no term of the vocabulary, as null and empty texts do.  The index has a
    bounded size and is broadcast.
    """
    docs = docs.select([c for c in docs.columns if c not in SCORED])
    names = docs.columns
    place = names.index(text_col)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    index = shared.send(docs.sparkSession, fit(texts, known, **fitting))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, fitted = hashing.Powers(), shared.received(index)
        with np.errstate(over="ignore"):
            for batch in batches:
                for first, rows, row, words, counts in fitted.vocabulary.entries(batch.column(place), powers):
                    limits = np.searchsorted(row, np.arange(rows + 1))
                    results = [fitted.score(words[a:z], counts[a:z], neighbours) for a, z in zip(limits[:-1], limits[1:], strict=True)]
                    scores = np.array([s for s, _ in results])
                    yield pa.RecordBatch.from_arrays(
                        [
                            *batch.slice(first, rows).columns,
                            pa.array(scores),
                            pa.array((scores >= cut).astype(np.int32)),
                            pa.array([e for _, e in results], pa.list_(pa.int64())),
                        ],
                        [*names, *SCORED],
                    )

    added = [StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("evidence", ArrayType(LongType()))]
    return docs.mapInArrow(run, StructType(docs.schema.fields + added))


def held_out(key: Column) -> Column:
    """Rows that no label is learnt from: the checksum of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))

