"""Spelling variants: words that differ by one letter, found in a trie of letter counts.

Letters are dealt into groups of about equal frequency, and a word becomes the vector
of how many letters of each group it has.  One insertion, deletion or replacement
moves at most one letter into a group and one out of a group.  So the words near a
word lie, in a trie over successive counts, on paths with a surplus of at most one
and a deficit of at most one in all; a depth-first search that spends these two
budgets finds them, and the words at its leaves are verified letter by letter.

The trie is spread over the cluster.  Its upper part, the prefixes of counts with
more words than a task should hold, is small and goes to all tasks; every word is
filed under the first prefix that is not among them and asked for under all such
prefixes within its budgets.  A prefix with very many words or questions is dealt
into cells by hash, each with a part of both.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from personyear.llm import hashing, shared
from personyear.session import written

LEAST_LENGTH, LEAST_COUNT, FORM_RATIO, DROP_MODULUS = 7, 2, 10, 31
#: Counts of a vector, bits of each count (larger counts are equal, which only adds candidates), bits for a prefix's depth.
GROUPS, BITS, DEPTH_BITS = 10, 5, 4
#: Words filed in a cell, unless the vocabulary is so large that this would make more than so many heavy prefixes a depth; questions of a cell.
CELL_WORDS, HEAVY_PREFIXES = 1 << 14, 1 << 12
CELL_QUESTIONS = 1 << 17
#: Words of a trie node that are compared without going deeper, and candidates verified at once.
LEAF_WORDS, TOGETHER = 4, 1 << 16
#: Words up to this length are compared as rows of bytes, longer ones one by one.
ROW_LENGTH = 32
#: Distinct words and their letters that a task counts before it hands them on.
HELD_WORDS, HELD_LETTERS = 1 << 17, 1 << 24


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` over all texts, after the planted deletions; only words of enough letters.

    A run of letters whose crc32 with the document's id is a multiple of 31 loses one
    letter, in all its places in that document.  A null id counts as no digits.
    """
    find = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        letters = 0

        def flush() -> pa.RecordBatch:
            cells = [pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())]
            words.clear()
            return pa.RecordBatch.from_arrays(cells, ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                small = hashing.LOWER[np.frombuffer(text.as_buffer(), dtype=np.uint8)].tobytes().decode()
                found = Counter(find.findall(small)) if len(small) <= 1 << 20 else Counter(m[0] for m in find.finditer(small))
                begin = zlib.crc32(f"{'' if key is None else key}:".encode())
                for word, n in found.items():
                    digest = zlib.crc32(word.encode(), begin)
                    if digest % DROP_MODULUS == 0:
                        at = digest % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_LENGTH:
                            continue
                    words[word] += n
                    letters += len(word)
                if len(words) >= HELD_WORDS or letters >= HELD_LETTERS:
                    yield flush()
                    letters = 0
        if words:
            yield flush()

    counted = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letter_groups(words: DataFrame) -> np.ndarray:
    """The group of each letter: from frequent to rare, each goes to the group with the fewest letters so far."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''")
    # A row per letter of the alphabet.
    counted = letters.groupBy("letter").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "letter").collect()
    group_of, load = np.zeros(256, dtype=np.int64), [0] * GROUPS
    for row in counted:
        group = load.index(min(load))
        group_of[ord(row.letter)] = group
        load[group] += row.n
    return group_of


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of words one after the other, all below 256, and the lengths of the words."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8), lengths


def vectors(data: np.ndarray, lengths: np.ndarray, group_of: np.ndarray) -> np.ndarray:
    """Letters of each group, one row per word."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    counts = np.bincount(row * GROUPS + group_of[data], minlength=len(lengths) * GROUPS)
    return np.minimum(counts.reshape(-1, GROUPS), (1 << BITS) - 1).astype(np.int8)


def prefix_keys(counts: np.ndarray, depth: int) -> np.ndarray:
    """A number for the first ``depth`` counts of each row."""
    key = np.zeros(len(counts), dtype=np.int64)
    for d in range(depth):
        key |= counts[:, d].astype(np.int64) << (DEPTH_BITS + BITS * d)
    return key | depth


def heavy_prefixes(words: DataFrame, group_of: np.ndarray, cell_words: int) -> np.ndarray:
    """Prefixes with more than ``cell_words`` words, sorted; at most one in ``cell_words`` words at each depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = vectors(*letters_of(batch.column(0).to_pylist()), group_of)
            keys = np.concatenate([prefix_keys(own, depth) for depth in range(GROUPS)])
            found, n = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["prefix", "n"])

    counted = words.select("word").mapInArrow(run, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") > cell_words).select("prefix").collect()
    return np.sort(np.array([row.prefix for row in rows], dtype=np.int64))


def _among(keys: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    if not len(heavy):
        return np.zeros(len(keys), dtype=bool)
    return heavy[np.minimum(np.searchsorted(heavy, keys), len(heavy) - 1)] == keys


def filed_under(counts: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The first prefix of each row that is not heavy, or its whole vector."""
    found, todo = np.empty(len(counts), dtype=np.int64), np.arange(len(counts))
    for depth in range(GROUPS + 1):
        keys = prefix_keys(counts[todo], depth)
        found[todo] = keys
        todo = todo[_among(keys, heavy)] if depth < GROUPS else todo[:0]
    return found


def asked_under(counts: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the prefixes, not heavy or whole, that they reach with a surplus and a deficit of one."""
    row, path = np.arange(len(counts)), np.zeros((len(counts), 0), dtype=np.int64)
    surplus, deficit = np.zeros(len(counts), dtype=np.int64), np.zeros(len(counts), dtype=np.int64)
    rows, keys = [], []
    for depth in range(GROUPS + 1):
        key = prefix_keys(path, depth)
        down = _among(key, heavy) if depth < GROUPS else np.zeros(len(key), dtype=bool)
        rows.append(row[~down])
        keys.append(key[~down])
        if not down.any():
            break
        row, path, surplus, deficit = row[down], path[down], surplus[down], deficit[down]
        own, parts = counts[row, depth], []
        for step in (-1, 0, 1):
            ok = (surplus + (step > 0) <= 1) & (deficit + (step < 0) <= 1) & (own + step >= 0) & (own + step < 1 << BITS)
            grown = np.column_stack((path[ok], own[ok] + step))
            parts.append((row[ok], grown, surplus[ok] + (step > 0), deficit[ok] + (step < 0)))
        row, path, surplus, deficit = (np.concatenate(x) for x in zip(*parts, strict=True))
    return np.concatenate(rows), np.concatenate(keys)


def one_apart(a: str, b: str) -> bool:
    """Whether ``b`` is ``a`` with one letter replaced or one put in."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))  # noqa: B905
    return len(b) == len(a) + 1 and a[at:] == b[at + 1 :]


class Words:
    """Words with their vectors and, for comparison, their letters from either end."""

    def __init__(self, words: list[str], n: np.ndarray, group_of: np.ndarray, sort: bool = False) -> None:
        if sort:
            order = np.lexsort(vectors(*letters_of(words), group_of).T[::-1])
            words, n = [words[i] for i in order], n[order]
        data, length = letters_of(words)
        self.words, self.n, self.length = words, n, length
        self.counts = vectors(data, length, group_of)
        # Longer words keep empty rows; they are compared one by one.
        row = np.repeat(np.arange(len(words)), length)
        column = np.arange(len(data)) - np.repeat(np.cumsum(length) - length, length)
        short = (length <= ROW_LENGTH)[row]
        row, column, data = row[short], column[short], data[short]
        self.left = np.zeros((len(words), ROW_LENGTH), dtype=np.uint8)
        self.right = np.zeros((len(words), ROW_LENGTH), dtype=np.uint8)
        self.left[row, column] = data
        self.right[row, length[row] - 1 - column] = data
        # Numbers in the order of the first letters, and sets of the letters as bits (of two letters some share one).
        self.begin = self.left[:, :8].copy().view(">u8")[:, 0].astype(np.uint64)
        self.letters = np.bitwise_or.reduce(np.where(self.left > 0, np.uint64(1) << (self.left % 64).astype(np.uint64), np.uint64(0)), axis=1)


def verified(asked: Words, filed: Words, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those candidates that are one letter apart; each pair from its shorter or else smaller word alone."""
    more = filed.length[b] - asked.length[a]
    fits = (more == 1) | ((more == 0) & (asked.begin[a] <= filed.begin[b]))
    long = filed.length[b] > ROW_LENGTH
    a, b, equal, long = a[fits], b[fits], more[fits] == 0, long[fits]
    one, two = asked.left[a], filed.left[b]
    other = one != two
    first = np.where(other.any(axis=1), other.argmax(axis=1), ROW_LENGTH)
    near = equal & (other.sum(axis=1) == 1)
    put_in = np.flatnonzero(~equal)
    back = asked.right[a[put_in]] != filed.right[b[put_in]]
    last = np.where(back.any(axis=1), back.argmax(axis=1), ROW_LENGTH)
    near[put_in] = first[put_in] + last >= asked.length[a[put_in]]
    at = np.minimum(first, ROW_LENGTH - 1)[:, None]
    smaller = np.take_along_axis(one, at, 1)[:, 0] < np.take_along_axis(two, at, 1)[:, 0]
    for i in np.flatnonzero(long):
        near[i] = one_apart(asked.words[a[i]], filed.words[b[i]])
        smaller[i] = asked.words[a[i]] < filed.words[b[i]]
    near &= ~equal | smaller
    return a[near], b[near]


def search_trie(filed: Words, asked: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates by depth-first search: filed words within a surplus and a deficit of one of asked words, none shorter than its asking word."""
    leaves, size = [], 0

    def compared() -> tuple[np.ndarray, np.ndarray]:
        who = np.concatenate([leaf for leaf, *_ in leaves])
        low, high = (np.repeat([leaf[i] for leaf in leaves], [len(leaf[0]) for leaf in leaves]) for i in (1, 2))
        n = high - low
        a, b = np.repeat(who, n), np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        # Shorter words find the longer ones, not the other way round.
        longer = filed.length[b] - asked.length[a]
        fits = np.flatnonzero((longer == 0) | (longer == 1))
        a, b = a[fits], b[fits]
        # One letter apart, sets of letters differ by two letters at most; words without a row have none.
        alike = (np.bitwise_count(asked.letters[a] ^ filed.letters[b]) <= 2) | (filed.length[b] > ROW_LENGTH)
        a, b = a[alike], b[alike]
        gap = filed.counts[b] - asked.counts[a]
        fits = (np.maximum(gap, 0).sum(axis=1) <= 1) & (np.maximum(-gap, 0).sum(axis=1) <= 1)
        return a[fits], b[fits]

    by_depth = np.ascontiguousarray(asked.counts.T)
    unspent = np.zeros(len(asked.words), dtype=bool)
    stack = [(0, 0, len(filed.words), np.arange(len(asked.words)), unspent, unspent)]
    while stack:
        depth, low, high, who, surplus, deficit = stack.pop()
        if depth == GROUPS or high - low <= LEAF_WORDS:
            for first in range(0, len(who), max(1, TOGETHER // (high - low))):
                some = who[first : first + max(1, TOGETHER // (high - low))]
                leaves.append((some, low, high))
                size += len(some) * (high - low)
                if size >= TOGETHER:
                    yield compared()
                    leaves, size = [], 0
            continue
        # In order of their own count, the words that a child takes are three slices: with its count, and one less or more if unspent.
        own = by_depth[depth][who]
        turn = np.argsort(own, kind="stable")
        who, surplus, deficit, own = who[turn], surplus[turn], deficit[turn], own[turn]
        more, less = np.flatnonzero(~surplus), np.flatnonzero(~deficit)
        steps = np.arange(-1, (1 << BITS) + 2)
        at, at_more, at_less = (np.searchsorted(x, steps) for x in (own, own[more], own[less]))
        level = filed.counts[low:high, depth]
        begins = np.flatnonzero(np.diff(level, prepend=-1))
        for first, last in zip(begins.tolist(), [*begins[1:].tolist(), len(level)], strict=True):
            # Places in ``steps`` are counts plus one.
            count = int(level[first]) + 1
            same = slice(at[count], at[count + 1])
            up, down = more[at_more[count - 1] : at_more[count]], less[at_less[count + 1] : at_less[count + 2]]
            taken = np.concatenate((who[same], who[up], who[down]))
            if len(taken):
                spent_up = np.concatenate((surplus[same], np.ones(len(up), dtype=bool), surplus[down]))
                spent_down = np.concatenate((deficit[same], deficit[up], np.ones(len(down), dtype=bool)))
                stack.append((depth + 1, low + first, low + last, taken, spent_up, spent_down))
    if size:
        yield compared()


def _routed(words: DataFrame, sent) -> DataFrame:
    """``prefix, asks, word, n``: where each word is filed, and where it is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group_of, heavy = shared.received(sent)
        for batch in batches:
            for first in range(0, batch.num_rows, 1 << 14):
                part = batch.slice(first, 1 << 14)
                own = vectors(*letters_of(part.column(0).to_pylist()), group_of)
                row, prefix = asked_under(own, heavy)
                for asks, at, key in ((False, np.arange(len(own)), filed_under(own, heavy)), (True, row, prefix)):
                    taken = part.take(pa.array(at))
                    cells = [pa.array(key), pa.array(np.full(len(at), asks)), *taken.columns]
                    yield pa.RecordBatch.from_arrays(cells, ["prefix", "asks", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "prefix long, asks boolean, word string, n long")


def _cells(routed: DataFrame, cell_words: int, cell_questions: int) -> DataFrame:
    """``prefix, cell, asks, word, n``; of a large prefix every cell has a part of the filed and a part of the asking words."""
    counted = routed.groupBy("prefix").agg(F.count_if(~F.col("asks")).alias("filed"), F.count_if("asks").alias("asked"))
    parts = lambda name, most: F.ceil(F.col(name) / most).cast("int")
    # Prefixes without a filed word are asked in vain.
    sizes = counted.where("filed > 0").select("prefix", parts("filed", cell_words).alias("down"), parts("asked", cell_questions).alias("across"))
    placed = routed.join(written(sizes, "cells"), "prefix")
    draw = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)
    own_row = F.transform(upto("across"), lambda c: draw("down") * F.col("across") + c)
    own_column = F.transform(upto("down"), lambda r: r * F.col("across") + draw("across"))
    placed = placed.where("across > 0")
    return placed.select("prefix", F.explode(F.when(F.col("asks"), own_column).otherwise(own_row)).alias("cell"), "asks", "word", "n")


def near_pairs(words: DataFrame, cell_words: int = CELL_WORDS, cell_questions: int = CELL_QUESTIONS) -> DataFrame:
    """``word, n, near, near_n``: all pairs of distinct words one letter apart, both ways round."""
    spark = words.sparkSession
    group_of = letter_groups(words)
    cell_words = max(cell_words, words.count() // HEAVY_PREFIXES)
    sent = shared.send(spark, (group_of, heavy_prefixes(words, group_of, cell_words)))
    routed = written(_routed(words, sent), "routed")
    dealt = _cells(routed, cell_words, cell_questions).repartition("prefix", "cell").sortWithinPartitions("prefix", "cell", "asks")
    names = ["word", "n", "near", "near_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, filed, parts, sizes = None, None, [], []

        def pairs(asked: Words) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def check() -> pa.RecordBatch:
                a, b = verified(asked, filed, *(np.concatenate(x) for x in zip(*held, strict=True)))
                one, two = [asked.words[i] for i in a.tolist()], [filed.words[i] for i in b.tolist()]
                n, m = asked.n[a], filed.n[b]
                cells = [one + two, np.concatenate((n, m)), two + one, np.concatenate((m, n))]
                types = [pa.string(), pa.int64()] * 2
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cells, types, strict=True)], names)

            for found in search_trie(filed, asked):
                held.append(found)
                size += len(found[0])
                if size >= TOGETHER:
                    yield check()
                    held, size = [], 0
            if size:
                yield check()

        for batch in batches:
            prefix, cell, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            changed = (np.diff(prefix) != 0) | (np.diff(cell) != 0) | (np.diff(asks.astype(np.int8)) != 0)
            limits = np.concatenate(([0], np.flatnonzero(changed) + 1, [batch.num_rows])) if batch.num_rows else []
            for first, last in zip(limits, limits[1:]):  # noqa: B905
                if (prefix[first], cell[first]) != at:
                    at, filed, parts, sizes = (prefix[first], cell[first]), None, [], []
                own = batch.slice(first, last - first)
                letters, n = own.column(3).to_pylist(), own.column(4).to_numpy()
                if not asks[first]:
                    parts += letters
                    sizes.append(n)
                elif parts:
                    filed = filed or Words(parts, np.concatenate(sizes), group_of, sort=True)
                    yield from pairs(Words(letters, n, group_of))

    return dealt.mapInArrow(run, "word string, n long, near string, near_n long")


def roots(forms: DataFrame, rounds: int) -> DataFrame:
    """``word, root`` of ``word, form``: the last of the forms that follow each other, by doubling steps."""
    reached = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        reached = written(reached.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return reached


def variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell_words: int = CELL_WORDS, cell_questions: int = CELL_QUESTIONS
) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    A word's form is the most frequent of its near words (of equal ones the first in
    code-point order) if that is at least ten times as frequent; forms of forms end in
    the root.  Null and empty texts have no words; rows that share an id are separate
    texts; other columns are not read.
    """
    words = written(word_counts(docs, id_col, text_col), "words")
    pairs = near_pairs(words, cell_words, cell_questions)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    near = written(pairs.groupBy("word", "n").agg(F.count("*").alias("n_near"), best), "near")
    worthy = -F.col("best.n") >= FORM_RATIO * F.col("n")
    near = near.select("word", "n_near", F.when(worthy, F.col("best.word")).alias("form"), F.when(worthy, -F.col("best.n")).alias("form_n"))
    # Each step multiplies the count by ten, so chains are short.
    largest = words.agg(F.max("n")).first()[0] or 1
    steps = len(str(largest))
    ends = roots(near.where("form is not null"), steps.bit_length())
    joined = words.join(near, "word", "left").join(ends, "word", "left")
    return joined.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )
