"""Token ids as files: frequency-ranked, byte-aligned, with separate control bytes.

Texts are encoded with a public vocabulary; ids are renumbered by descending
frequency over all documents, so that frequent ids take one byte.  A record keeps
four lengths of two bits in a control byte and the bytes of the numbers apart from
them, so a table lookup over the control bytes gives every length at once.

The files are Parquet records in ascending id order (``part`` is the number of a
range of ids), with the ranking beside them.  They are written and read by Spark
alone, so any store will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from personyear.llm import hashing
from personyear.session import new_folder, written

END_ID = 1
#: Units that a worker remembers before it begins anew.
REMEMBERED = 1 << 21
#: Units of plain letters that are encoded as one line of text.
LINE_UNITS = 256
#: Bytes of each of the four numbers of a control byte.
_LENGTHS = ((np.arange(256)[:, None] >> np.arange(0, 8, 2)) & 3).astype(np.uint8) + 1
_MARKS = np.isin(np.arange(256), np.frombuffer(b".,;:!?", dtype=np.uint8))


def _plain_letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to letters of ASCII or Latin-1 written as C3 xx, and the bytes in lower case."""
    after = np.zeros(len(data), dtype=bool)
    after[1:] = data[:-1] == 0xC3
    second = after & (data >= 0x80) & (data <= 0xBF) & (data != 0x97) & (data != 0xB7)
    lower = hashing.LOWER[data]
    letter = ((lower >= 97) & (lower <= 122)) | second
    # A lead byte is a letter's if its second byte is.
    lead = np.zeros(len(data), dtype=bool)
    lead[:-1] = second[1:]
    return letter | lead, np.where(second & (data <= 0x9E), lower + 0x20, lower)


class WordEncoder:
    """Ids of texts whose vocabulary never joins characters across white space.

    A word of plain letters and closing marks is two units, the letters in lower
    case and the marks, which the vocabulary keeps apart; every other word is one
    unit as it stands.  Each distinct unit is encoded once by the library and
    remembered under a 64-bit hash.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Lower-case letters with blanks between them are what normalising and splitting would make of them.
        self.letters = Tokenizer(self.tokenizer.model)  # one model in memory for both
        added = [t for _, t in sorted(self.tokenizer.get_added_tokens_decoder().items())]
        self.letters.add_special_tokens([t for t in added if t.special])
        self.letters.add_tokens([t for t in added if not t.special])
        self.letters.normalizer = normalizers.Sequence([])
        by_blanks = [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(by_blanks)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(names.values()) + 1, dtype=bool)
        for name, number in names.items():
            self.ends[number] = name.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        # Unit 0 is empty; keys are sorted and name the other units.
        self.keys = np.zeros(0, dtype=np.uint64)
        self.units = np.zeros(0, dtype=np.int32)
        self.count = 1
        self.unit_from = np.zeros(1025, dtype=np.int64)
        self.ids = np.zeros(1 << 14, dtype=np.uint32)

    def _grown(self, array: np.ndarray, size: int) -> np.ndarray:
        if size <= len(array):
            return array
        wider = np.zeros((max(size, 2 * len(array)), *array.shape[1:]), dtype=array.dtype)
        wider[: len(array)] = array
        return wider

    def _learn(self, keys: np.ndarray, texts: list[str], plain: np.ndarray) -> None:
        """Remember new units, plain ones first in the order of units."""
        order = np.argsort(~plain, kind="stable")
        letters = int(plain.sum())
        lengths, ids = [], []
        lines = [[texts[i] for i in order[first : min(first + LINE_UNITS, letters)]] for first in range(0, letters, LINE_UNITS)]
        results = self.letters.encode_batch_fast([" ".join(line) for line in lines], add_special_tokens=False)
        for line, result in zip(lines, results, strict=True):
            found = np.array(result.ids, dtype=np.uint32)
            cuts = np.flatnonzero(self.ends[found]) + 1
            if len(cuts) == len(line):
                lengths.append(np.diff(cuts, prepend=0))
                ids.append(found)
            else:
                self._whole(line, lengths, ids)
        self._whole([texts[i] for i in order[letters:]], lengths, ids)
        size = np.concatenate(lengths)
        ends = self.unit_from[self.count] + np.cumsum(size)
        last = self.count + len(keys)
        self.unit_from = self._grown(self.unit_from, last + 1)
        self.unit_from[self.count + 1 : last + 1] = ends
        self.ids = self._grown(self.ids, int(ends[-1]))
        self.ids[ends[0] - size[0] : ends[-1]] = np.concatenate(ids)
        keys, units = keys[order], np.arange(self.count, last, dtype=np.int32)
        turn = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[turn])
        self.keys, self.units = np.insert(self.keys, at, keys[turn]), np.insert(self.units, at, units[turn])
        self.count = last

    def _whole(self, texts: list[str], lengths: list[np.ndarray], ids: list[np.ndarray]) -> None:
        """Encode units with all that the vocabulary's file says."""
        for result in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids.append(np.array(result.ids, dtype=np.uint32))
            lengths.append(np.array([len(ids[-1])]))

    def encode(self, piece: hashing.Piece) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a piece in a row, and how many each text has."""
        if self.count > REMEMBERED:
            self.forget()
        starts, ends = piece.starts, piece.ends
        letter, lower = _plain_letters(piece.data)
        # Where the closing marks of a word begin, and whether all before them is letters.
        held = np.maximum.accumulate(np.where(_MARKS[piece.data], 0, np.arange(1, len(piece.data) + 1))) if len(starts) else starts
        core = np.maximum(held[ends - 1], starts) if len(starts) else starts
        others = np.concatenate(([0], np.cumsum(~letter)))
        plain = (core > starts) & (others[core] == others[starts])
        folded = replace(piece, data=lower)
        # An ordinary word differs from the same bytes in lower case; both kinds and marks have hashes of their own.
        first = np.where(plain, folded.spans(starts, core), piece.spans(starts, ends) ^ np.uint64(0x5555555555555555))
        marks = np.flatnonzero(plain & (core < ends))
        second = folded.spans(core[marks], ends[marks])
        hashes, at, place = _distinct(np.concatenate((first, second)))
        found = np.minimum(np.searchsorted(self.keys, hashes), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[found] != hashes) if len(self.keys) else np.arange(len(hashes))
        if len(new):
            word = at[new]
            is_mark = word >= len(starts)
            word = np.where(is_mark, marks[np.maximum(word - len(starts), 0)] if len(marks) else 0, word)
            letters = plain[word] & ~is_mark
            begin = np.where(is_mark, core[word], starts[word])
            end = np.where(letters, core[word], ends[word])
            texts = _texts(np.where(letters, 1, 0), begin, end, piece.data, lower)
            self._learn(hashes[new], texts, letters)
            found = np.searchsorted(self.keys, hashes)
        units = np.zeros((len(starts), 2), dtype=np.int64)
        if len(starts):
            known = self.units[found][place]
            units[:, 0] = known[: len(starts)]
            units[marks, 1] = known[len(starts) :]
        units = units.ravel()
        low, high = self.unit_from[units], self.unit_from[units + 1]
        lengths = high - low
        total = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.ids[np.repeat(low - total[:-1], lengths) + np.arange(total[-1])]
        words = np.concatenate(([0], np.cumsum(piece.counts())))
        return ids, np.diff(total[2 * words])


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in ascending order, where one of each stands, and the number of each value's own."""
    coded = pa.array(values).dictionary_encode()
    found, place = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    at = np.zeros(len(found), dtype=np.int64)
    at[place] = np.arange(len(values))
    turn = np.argsort(found)
    number = np.empty(len(found), dtype=np.int64)
    number[turn] = np.arange(len(found))
    return found[turn], at[turn], number[place]


def _worker_encoder(kept: dict, path: str) -> WordEncoder:
    """The encoder that this worker has kept, or a new one."""
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def _texts(which: np.ndarray, begin: np.ndarray, end: np.ndarray, *buffers: np.ndarray) -> list[str]:
    """The text of each span of one of the buffers; spans hold no blank and are whole characters."""
    lengths = end - begin
    after = np.cumsum(lengths + 1)
    joined = np.full(int(after[-1]), 0x20, dtype=np.uint8)
    source = np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    target = np.repeat(after - lengths - 1 - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    own = np.repeat(which, lengths)
    for number, buffer in enumerate(buffers):
        some = own == number
        joined[target[some]] = buffer[source[some]]
    return joined[:-1].tobytes().decode().split(" ")


def pack_numbers(values: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of consecutive records; ``counts`` are their sizes."""
    lengths = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    as_bytes = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = as_bytes[np.arange(4) < lengths[:, None]].tobytes()
    data_to = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    groups = -(-counts // 4)
    slots = np.repeat(4 * (np.cumsum(groups) - groups) - (np.cumsum(counts) - counts), counts) + np.arange(len(values))
    codes = np.zeros(4 * int(groups.sum()), dtype=np.uint8)
    codes[slots] = lengths - 1
    control = (codes.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()
    value_to, group_to = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(groups)))
    cuts = data_to[value_to].tolist()
    return (
        [control[a:z] for a, z in zip(group_to[:-1], group_to[1:], strict=True)],
        [data[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)],
    )


def unpack_numbers(control: list[bytes], data: list[bytes], counts: np.ndarray) -> np.ndarray:
    """The numbers of consecutive records, by table lookup over the control bytes."""
    codes = np.frombuffer(b"".join(control), dtype=np.uint8)
    groups = -(-counts // 4)
    slots = np.repeat(4 * (np.cumsum(groups) - groups) - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    lengths = _LENGTHS[codes].ravel()[slots]
    raw = np.frombuffer(b"".join(data) + bytes(4), dtype=np.uint8)
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    values = raw[at].astype(np.uint32)
    for extra in range(1, 4):
        longer = np.flatnonzero(lengths > extra)
        values[longer] |= raw[at[longer] + extra].astype(np.uint32) << np.uint32(8 * extra)
    return values


def _texts_to_ids(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``id, n_tokens, ids`` with the ids of each text and the end id as little-endian 16- or 32-bit numbers."""
    # A worker has a broadcast value of its own for as long as it runs, so its later tasks know the units of earlier ones.
    kept = docs.sparkSession.sparkContext.broadcast({})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, powers = _worker_encoder(kept.value, tokenizer), hashing.Powers()
        kind = "<u2" if max(len(encoder.ends) - 1, end_id) < 1 << 16 else "<u4"
        with np.errstate(over="ignore"):
            for batch in batches:
                for piece in hashing.pieces(batch.column(1), hashing.NOT_BLANK, False, powers):
                    ids, counts = encoder.encode(piece)
                    ends = np.cumsum(counts)
                    ids = np.insert(ids, ends, end_id).astype(kind)
                    raw = ids.tobytes()
                    width = ids.itemsize
                    cuts = (np.concatenate(([0], ends + np.arange(1, len(ends) + 1))) * width).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(piece.first, piece.rows),
                            pa.array(counts + 1, pa.int64()),
                            pa.array([raw[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                            pa.array(np.full(piece.rows, width, dtype=np.int32)),
                        ],
                        ["id", "n_tokens", "ids", "width"],
                    )

    return docs.mapInArrow(run, "id long, n_tokens long, ids binary, width int")


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=f"<u{batch.column(3)[0].as_py()}").astype(np.int64)


def _parts(batch: pa.RecordBatch, ids: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about so many ids."""
    counts = np.cumsum(batch.column(1).to_numpy())
    first = 0
    while first < batch.num_rows:
        before = counts[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(counts, before + ids, side="right")))
        yield batch.slice(first, last - first)
        first = last


def _frequencies(encoded: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for part in _parts(batch):
                found = np.bincount(_numbers(part))
                wide = np.zeros(max(len(total), len(found)), dtype=np.int64)
                wide[: len(total)] += total
                wide[: len(found)] += found
                total = wide
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["token", "n"])

    return encoded.select("id", "n_tokens", "ids", "width").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID
) -> None:
    """Encode every text and write records and ranking below ``path``.

    A null text is empty and has the end id only.  Rows are ordered by id (null
    first), rows that share an id by their records.  At most as many numbers as the
    vocabulary has reach the driver, and are broadcast.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string"))
    encoded = written(_texts_to_ids(texts, tokenizer, end_id), "ids")
    ranking = sorted(_frequencies(encoded).collect(), key=lambda r: (-r.n, r.token))
    spark.createDataFrame([(i, r.token, r.n) for i, r in enumerate(ranking)], "rank long, token long, n long").coalesce(
        1
    ).write.parquet(f"{path}/ranking")
    rank = np.zeros(max((r.token for r in ranking), default=0) + 1, dtype=np.uint32)
    rank[[r.token for r in ranking]] = np.arange(len(ranking))
    shared = spark.sparkContext.broadcast(rank)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                control, data = pack_numbers(shared.value[_numbers(part)], part.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(control, pa.binary()), pa.array(data, pa.binary())],
                    ["id", "n_tokens", "control", "data"],
                )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            counts = batch.column(1).to_numpy()
            ends = before + np.cumsum(counts)
            columns = [pa.array(np.full(len(counts), number, dtype=np.int32)), pa.array(ends - counts), *batch.columns]
            yield pa.RecordBatch.from_arrays(columns, ["part", "start_in_part", "id", "n_tokens", "control", "data"])
            before = ends[-1] if len(ends) else before

    # Ranges of ids with about as many documents each, from the ids alone.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    bounds = encoded.agg(F.percentile_approx("id", shares, 100 * parts)).first()[0] if shares else None
    bounds = sorted(set(bounds or []))
    owner = F.lit(0)
    if bounds:
        owner = F.size(F.filter(F.lit(np.array(bounds)), lambda b: b < F.coalesce(F.col("id"), F.lit(-(2**63)))))
    short = encoded.select("id", "n_tokens", "ids", "width").mapInArrow(shorten, "id long, n_tokens long, control binary, data binary")
    ranged = short.repartitionById(max(1, len(bounds) + 1), owner.cast("int"))
    ordered = ranged.sortWithinPartitions(F.col("id").asc_nulls_first(), "n_tokens", "data")
    ordered.mapInArrow(
        place, "part int, start_in_part long, id long, n_tokens long, control binary, data binary"
    ).write.parquet(f"{path}/records")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` of every record, from the files.

    ``start`` is the number of ids of all records before; the checksum is that of
    the ids as little-endian 32-bit numbers.
    """
    ranking = spark.read.parquet(f"{path}/ranking").orderBy("rank").select("token").collect()
    shared = spark.sparkContext.broadcast(np.array([r.token for r in ranking], dtype=np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole):
                counts = batch.column(1).to_numpy()
                numbers = unpack_numbers(batch.column(2).to_pylist(), batch.column(3).to_pylist(), counts)
                raw = memoryview(shared.value[numbers].astype("<u4").tobytes())
                cuts = (4 * np.concatenate(([0], np.cumsum(counts)))).tolist()
                sums = [zlib.crc32(raw[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(4), batch.column(5), batch.column(1), pa.array(sums, pa.int64())],
                    ["id", "part", "start_in_part", "n_tokens", "ids_crc32"],
                )

    records = spark.read.parquet(f"{path}/records")
    sums = records.select("id", "n_tokens", "control", "data", "part", "start_in_part").mapInArrow(
        run, "id long, part int, start_in_part long, n_tokens long, ids_crc32 long"
    )
    # One row per range of ids; the ranges before it.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = records.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    offsets = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return sums.join(offsets, "part").select("id", (F.col("offset") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files into the shared folder and read them back."""
    path = new_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, id_col, text_col)
    return read_tokens(docs.sparkSession, path).withColumnRenamed("id", id_col)
