"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document is the set of its five-word shingles.  Its signature holds one minimum
per seeded permutation.  The forest is several orders of all documents: a tree
reads the signature in its own sequence of positions, and documents are sorted by
what it reads.  Documents with a long common prefix stand next to each other, so

* the documents of a region (the same prefix of ``least_depth`` values) are each
  paired with the first one of the region: a group of copies gives as many pairs
  as it has members;
* a document is paired with its ``reach`` followers in the order.  In a crowded
  region these are the ones with the longest common prefix, so the depth at which
  documents are compared adapts to how crowded the region is.

Pairs are confirmed on the full sets.  Regions are cut only where a range of the
sorted order ends, so a group of any size is spread over tasks.

The forest can miss pairs, above all in a crowd of texts just below the limit.  So
an exact join follows, over what it left in different components: shingles have
one order for all documents, the rarer first; a pair at the limit has its first
common shingle early in both documents, and is a candidate only by a shingle so
early in both.  In a crowd below the limit the early shingles are those that the
crowd does not share.  Frequencies come from a table of counts by hash: they decide
how many candidates there are, not which pairs are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from personyear.llm import hashing
from personyear.llm.components import components
from personyear.session import discard, written

WORDS = 5
PERMUTATIONS = 96
TREES = 20
DEPTH = 10
LEAST_DEPTH = 3
REACH = 4
#: Counters of shingles, by the low bits of the hash; written by the task in rows of so many.
COUNTER_BITS = 20
COUNTER_ROW = 1 << 14
#: Bits of the table of marked ids that every task holds, by the hash of the id.
MARK_BITS = 24


def _shingles(piece: hashing.Piece, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 48-bit hash of each distinct shingle of a piece, by row and hash.

    Sets are only ever compared within one document or between two, where 48 bits
    do not collide in practice.
    """
    hashes, counts = piece.hashes(), piece.counts()
    factors = hashing.odd_constants(words + 1, 5)
    whole = len(hashes) - words + 1
    rows, values = [], []
    if whole > 0:
        total = sum(hashes[j : whole + j] * factors[j] for j in range(words))
        inside = piece.row[:whole] == piece.row[words - 1 :]
        rows.append(piece.row[:whole][inside])
        values.append(total[inside])
    first = hashing.first_words(counts)
    for length in range(1, words):  # fewer words than a shingle: the whole sequence is one
        short = np.flatnonzero(counts == length)
        total = sum(hashes[first[short] + j] * factors[j] for j in range(length))
        rows.append(short)
        values.append(total + np.uint64(length) * factors[words] if len(short) else np.zeros(0, np.uint64))
    row, value = np.concatenate(rows), hashing.mix(np.concatenate(values).astype(np.uint64))
    packed = np.sort(row.astype(np.uint64) << np.uint64(48) | value >> np.uint64(16))
    packed = packed[np.concatenate(([True], packed[1:] != packed[:-1]))] if len(packed) else packed
    return (packed >> np.uint64(48)).astype(np.int64), packed & np.uint64((1 << 48) - 1)


def _signatures(row: np.ndarray, value: np.ndarray, rows: int, permutations: int) -> np.ndarray:
    """The low 16 bits of the least permuted hash, per row and permutation; rows without shingles keep zeros."""
    result = np.zeros((rows, permutations), dtype=">u2")
    if len(row) == 0:
        return result
    starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    own = row[starts]
    short = (value >> np.uint64(16)).astype(np.uint32)
    numbers = hashing.odd_constants(2 * permutations, 9)
    for k in range(permutations):
        turned = (short ^ np.uint32(numbers[2 * k] >> np.uint64(32))) * np.uint32(numbers[2 * k + 1] >> np.uint64(32) | np.uint64(1))
        turned ^= turned >> np.uint32(15)
        turned *= np.uint32(0x85EBCA6B)
        result[own, k] = np.minimum.reduceat(turned, starts) & np.uint32(0xFFFF)
    return result


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, permutations: int = PERMUTATIONS) -> DataFrame:
    """``id, n_shingles, set_key, signature`` of every row; ``set_key`` names the set (empty: null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = hashing.Powers()
        with np.errstate(over="ignore"):
            for batch in batches:
                for piece in hashing.pieces(batch.column(1), hashing.NOT_BLANK, True, powers):
                    row, value = _shingles(piece, words)
                    signature = _signatures(row, value, piece.rows, permutations)
                    sizes = np.bincount(row, minlength=piece.rows)
                    # Sums of two independent hashes of the elements name a set whatever its order.
                    keys = np.zeros((piece.rows, 2), dtype=np.uint64)
                    ends = np.cumsum(sizes)
                    for side, constant in enumerate(hashing.odd_constants(2, 21)):
                        sums = np.concatenate(([np.uint64(0)], np.cumsum(hashing.mix(value + constant), dtype=np.uint64)))
                        keys[:, side] = sums[ends] - sums[ends - sizes]
                    names = keys.tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(piece.first, piece.rows),
                            pa.array(sizes, pa.int64()),
                            pa.array([names[16 * i : 16 * i + 16] if n else None for i, n in enumerate(sizes)], pa.binary()),
                            pa.array([line.tobytes() for line in signature], pa.binary()),
                        ],
                        ["id", "n_shingles", "set_key", "signature"],
                    )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, "id long, n_shingles long, set_key binary, signature binary"
    )


def _tree_positions(trees: int, depth: int, permutations: int) -> np.ndarray:
    return np.stack([np.random.default_rng(1000 + t).permutation(permutations)[:depth] for t in range(trees)])


def candidates(
    sets: DataFrame, trees: int = TREES, depth: int = DEPTH, least_depth: int = LEAST_DEPTH, reach: int = REACH,
    similarity: float = 0.75,
) -> DataFrame:
    """``a, b, star``: pairs of ids (a < b) that meet in the forest; ``star`` marks pairs with the first of a region.

    Pairs whose sizes alone rule out the similarity are left out.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lines = np.array([np.frombuffer(x.as_py(), dtype=">u2") for x in batch.column(2)])
            for tree, places in enumerate(_tree_positions(trees, depth, lines.shape[1])):
                labels = pa.array([line.tobytes() for line in np.ascontiguousarray(lines[:, places])], pa.binary())
                number = pa.array(np.full(batch.num_rows, tree, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [number, labels, batch.column(0), batch.column(1)], ["tree", "label", "id", "n_shingles"]
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = hub = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, key, size = (batch.column(i).to_numpy() for i in (0, 2, 3))
            lines = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=">u2").reshape(len(tree), depth)
            values = np.column_stack([tree.astype(np.uint16), lines.astype(np.uint16)])
            if tail is not None:
                values, key, size = (np.concatenate(both) for both in zip(tail, (values, key, size), strict=True))
            new = 0 if tail is None else len(tail[1])
            prefix = values[:, : least_depth + 1]
            begins = np.concatenate(([True], (prefix[1:] != prefix[:-1]).any(axis=1)))
            at = np.maximum.accumulate(np.where(begins, np.arange(len(key)), 0))
            first_key, first_size = key[at], size[at]
            if hub is not None and (hub[0] == prefix[0]).all():  # the region began in an earlier batch
                first_key[at == 0], first_size[at == 0] = hub[1], hub[2]
            left, right, star, sizes = [first_key[new:]], [key[new:]], [np.ones(len(key) - new, bool)], [(first_size[new:], size[new:])]
            for step in range(1, reach + 1):
                later = np.arange(max(step, new), len(key))
                later = later[(prefix[later] == prefix[later - step]).all(axis=1)]
                left.append(key[later - step])
                right.append(key[later])
                star.append(np.zeros(len(later), bool))
                sizes.append((size[later - step], size[later]))
            one, two = np.concatenate(left), np.concatenate(right)
            n, m = (np.concatenate(x) for x in zip(*sizes, strict=True))
            possible = (one != two) & (np.minimum(n, m) >= similarity * np.maximum(n, m))
            if possible.any():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.minimum(one, two)[possible]),
                        pa.array(np.maximum(one, two)[possible]),
                        pa.array(np.concatenate(star)[possible]),
                    ],
                    ["a", "b", "star"],
                )
            hub = (prefix[-1], first_key[-1], first_size[-1])
            tail = values[-reach:], key[-reach:], size[-reach:]

    labelled = sets.select("id", "n_shingles", "signature").mapInArrow(
        label, "tree int, label binary, id long, n_shingles long"
    )
    ordered = labelled.repartitionByRange("tree", "label").sortWithinPartitions("tree", "label", "id")
    met = ordered.mapInArrow(meet, "a long, b long, star boolean")
    return met.groupBy("a", "b").agg(F.max("star").alias("star"))


def confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int, words: int = WORDS) -> DataFrame:
    """The pairs with ``100 * intersection >= percent * union``, measured on the full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = hashing.Powers()
        with np.errstate(over="ignore"):
            for batch in batches:
                sides = []
                for column in (2, 3):
                    found: list[np.ndarray] = []
                    for piece in hashing.pieces(batch.column(column), hashing.NOT_BLANK, True, powers):
                        row, value = _shingles(piece, words)
                        found += np.split(value, np.cumsum(np.bincount(row, minlength=piece.rows))[:-1])
                    sides.append(found)
                keep = []
                for one, two in zip(*sides, strict=True):
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(one) + len(two) - both))
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    joined = (
        pairs.select("a", "b")
        .hint("merge")
        .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        .hint("merge")
        .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )
    return joined.mapInArrow(run, "a long, b long")


def _frequencies(docs: DataFrame, words: int) -> np.ndarray:
    """How many documents have a shingle, summed over the shingles with the same low ``COUNTER_BITS`` bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, counters = hashing.Powers(), np.zeros(1 << COUNTER_BITS, dtype=np.int64)
        with np.errstate(over="ignore"):
            for batch in batches:
                for piece in hashing.pieces(batch.column(0), hashing.NOT_BLANK, True, powers):
                    low = (_shingles(piece, words)[1] & np.uint64((1 << COUNTER_BITS) - 1)).astype(np.int64)
                    counters += np.bincount(low, minlength=len(counters))
        lines = counters.reshape(-1, COUNTER_ROW)
        some = np.flatnonzero(lines.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array([lines[i].tobytes() for i in some], pa.binary())], ["line", "counts"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for line, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[line] = sums.get(line, 0) + np.frombuffer(counts.as_py(), dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["line", "counts"]
        )

    schema = "line int, counts binary"
    counters = np.zeros((1 << COUNTER_BITS) // COUNTER_ROW * COUNTER_ROW, dtype=np.int64).reshape(-1, COUNTER_ROW)
    for line, counts in docs.select("text").mapInArrow(count, schema).repartition("line").mapInArrow(add, schema).collect():
        counters[line] = np.frombuffer(bytes(counts), dtype=np.int64)
    return counters.reshape(-1)


def early_pairs(docs: DataFrame, frequencies: np.ndarray, percent: int, words: int = WORDS) -> DataFrame:
    """``a, b``: all pairs of ids (a < b) of different components whose sets can reach the limit.

    ``docs`` has ``id, component, text``.  Sets of n and m shingles reach it with at
    least t = percent (n + m) / (100 + percent) common ones, so the first of them
    stands before at least t - 1 others in both.
    """

    def early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = hashing.Powers()
        with np.errstate(over="ignore"):
            for batch in batches:
                keys, groups = (batch.column(i).to_numpy() for i in (0, 1))
                for piece in hashing.pieces(batch.column(2), hashing.NOT_BLANK, True, powers):
                    row, value = _shingles(piece, words)
                    value = value.astype(np.int64)
                    order = np.lexsort((value, frequencies[value & ((1 << COUNTER_BITS) - 1)], row))
                    sizes = np.bincount(row, minlength=piece.rows)
                    place = np.arange(len(row)) - hashing.first_words(sizes)[row]
                    size = sizes[row]
                    some = np.flatnonzero(100 * (size - place) >= percent * size)
                    at = piece.first + row[some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (value[order][some], size[some], keys[at], groups[at], place[some])],
                        ["shingle", "size", "id", "component", "place"],
                    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy() for i in range(5)]
            if held and held[0][0][0] == rows[0][-1]:  # one shingle goes on
                held.append(rows)
                continue
            rows = [np.concatenate(x) for x in zip(*held, rows, strict=True)]
            whole = int(np.searchsorted(rows[0], rows[0][-1]))
            held = [[x[whole:] for x in rows]]
            yield from pairs([x[:whole] for x in rows])
        if held:
            yield from pairs([np.concatenate(x) for x in zip(*held, strict=True)])

    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The pairs of rows with the same shingle, by distance in the order of shingle and size."""
        if not len(rows[0]):
            return
        begins = np.flatnonzero(np.concatenate(([True], rows[0][1:] != rows[0][:-1])))
        mixed = np.minimum.reduceat(rows[3], begins) < np.maximum.reduceat(rows[3], begins)
        among = np.repeat(mixed, np.diff(np.append(begins, len(rows[0]))))
        shingle, size, key, component, place = (x[among] for x in rows)
        one, step = np.arange(len(key)), 1
        while len(one):
            one = one[one + step < len(key)]
            two = one + step
            least = percent * (size[one] + size[two])
            # The sizes grow with the distance, and with them what is asked: a row that fails here is done.
            on = (shingle[one] == shingle[two]) & ((100 + percent) * (size[one] - place[one]) >= least)
            one, two, least = one[on], two[on], least[on]
            good = ((100 + percent) * (size[two] - place[two]) >= least) & (component[one] != component[two])
            if good.any():
                x, y = key[one[good]], key[two[good]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
            step += 1

    rows = docs.select("id", "component", "text").mapInArrow(
        early, "shingle long, size long, id long, component long, place long"
    )
    ordered = rows.repartition("shingle").sortWithinPartitions("shingle", "size")
    return ordered.mapInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_shingles, component_id, kept``.

    ``component_id`` is the smallest id reachable over links of at least
    ``percent``; ``kept`` marks the rows whose id is that.  A text without words is
    linked with nothing.  Rows that share an id are one document and are in one
    component.  A row without id is linked with nothing, has no component and is
    kept.  Other columns of ``docs`` are not read.

    Documents with equal sets are one point of the forest, named by their smallest
    id, so exact copies cost one row.  Pairs with the first of a region are
    confirmed first; of the others only those that would join two components.  The
    exact join then adds the pairs between components that the forest has missed.
    Texts are shuffled only where a pair or a component needs them; intermediate
    tables are deleted once the next ones are written.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = written(signatures(docs, "id", "text", words), "signatures")
    named = known.where("id is not null and set_key is not null")
    points = written(
        named.groupBy("set_key").agg(
            F.min("id").alias("id"), F.max("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
        ),
        "points",
    )
    pairs = written(candidates(points, similarity=percent / 100), "pairs")
    texts = written(_texts_of(pairs, docs), "texts")
    first = confirmed(pairs.where("star"), texts, "id", "text", percent, words)
    grouped = written(components(first), "components")
    rest = (
        pairs.where("not star")
        .join(grouped.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
        .join(grouped.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        .where("coalesce(ca, a) <> coalesce(cb, b)")
    )
    other = written(rest.select("a", "b"), "other-pairs")
    more = confirmed(other, texts, "id", "text", percent, words)
    pointed = written(
        known.join(points.select("set_key", F.col("id").alias("point")), "set_key", "left").select("id", "n_shingles", "point"),
        "pointed",
    )
    links = grouped.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more).union(_shared_ids(pointed))
    met = written(components(links), "met")
    for done in (known, pairs, texts, grouped, other):
        discard(done)
    early = written(early_pairs(_with_components(docs, points, pointed, met), _frequencies(docs, words), percent, words), "early-pairs")
    texts = written(_texts_of(early, docs), "early-texts")
    missed = confirmed(early, texts, "id", "text", percent, words)
    groups = written(components(met.select(F.col("component").alias("a"), F.col("node").alias("b")).union(missed)), "groups")
    for done in (points, met, early, texts):
        discard(done)
    return (
        pointed.join(groups.withColumnRenamed("node", "point"), "point", "left")
        .withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component", "point", "id")))
        .select(
            F.col("id").alias(id_col),
            "n_shingles",
            "component_id",
            F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )


def _marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` with ``marked``: true for every id in ``ids``, and for few others.

    A table of ``2^MARK_BITS`` bits by the hash of the id is broadcast, so rows can be
    kept from a shuffle without moving them.  Of very many ids it tells fewer apart.
    """

    def place() -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(1 << MARK_BITS))

    lines = ids.groupBy(F.bitmap_bucket_number(place()).alias("line")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place())).alias("bits"))
    joined = docs.withColumn("line", F.bitmap_bucket_number(place())).join(F.broadcast(lines), "line", "left")
    at = F.bitmap_bit_position(place())
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return joined.withColumn("marked", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("line", "bits")


def _with_components(docs: DataFrame, points: DataFrame, pointed: DataFrame, met: DataFrame) -> DataFrame:
    """``id, component, text`` of the rows whose id names a point.

    Most texts are a point without links, which is its own component, and stay where
    they are; the others, and the few marked with them, are joined with theirs.
    """
    own = met.select(F.col("node").alias("id")).union(pointed.where("id <> point").select("id"))
    marked = _marked(docs.where("id is not null"), own)
    grouped = points.select("id").distinct().join(met.withColumnRenamed("node", "id"), "id", "left")
    grouped = grouped.select("id", F.coalesce("component", "id").alias("component"))
    found = marked.where("marked").join(grouped.hint("merge"), "id").select("id", "component", "text")
    return found.union(marked.where("not marked").select("id", F.col("id").alias("component"), "text"))


def _texts_of(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The distinct texts of the ids that are in a pair."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # One plan whatever the number of ids: broadcast would hold all of a small table's.
    found = _marked(docs, ids).where("marked").drop("marked").join(ids.hint("merge"), "id", "left_semi")
    return found.groupBy("id", F.xxhash64("text")).agg(F.first("text").alias("text")).select("id", "text")


def _shared_ids(pointed: DataFrame) -> DataFrame:
    """Links between the points of rows that share an id but not a text."""
    named = pointed.where("id is not null and point is not null")
    split = named.groupBy("id").agg(F.min("point").alias("a"), F.max("point").alias("z")).where("a <> z")
    return named.join(split, "id").where("a <> point").select("a", F.col("point").alias("b"))
