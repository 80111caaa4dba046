"""Token ids in directly addressable codes.

A segment holds the ids of consecutive documents. Each id is cut into 8-bit chunks; level k holds
the k-th chunk of every id that has one, in order, a bitmap tells which of them go on to level
k + 1, and a directory holds the bitmap's rank at each block of 512 bits. Any id is reached by one
rank per level; no block is decoded for it.

Segments are rows of Parquet files, written in ascending document order: documents are dealt over
files by ranges of doc_id and sorted inside, texts being what is shuffled, so encoding runs once.
Where each segment begins follows from one sum per file and a running sum inside files.

Null texts are empty and hold the end id alone. A null doc_id comes first. Repeated ids are kept as
rows of their own, in the order of their texts.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm.common import WordCache, dropped_by_worker, held_by_worker, map_rows, schema_of
from tallyloom.llm.token_counts import byte_symbols

BLOCK = 512
SEGMENT_TOKENS = 1_000_000
END_ID = 0
#: Units of one generation of a worker's cache.
CACHE_UNITS = 250_000
_MAGIC = b"DAC1"


class Codes:
    """Read access to a segment."""

    def __init__(self, blob: bytes):
        magic, self.size, levels = struct.unpack_from("<4sQI", blob, 0)
        if magic != _MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        at, self.levels = struct.calcsize("<4sQI"), []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", blob, at)
            at += 8
            chunks = np.frombuffer(blob, np.uint8, n, at)
            at += n
            bits = np.frombuffer(blob, np.uint8, -(-n // 8), at)
            at += len(bits)
            ranks = np.frombuffer(blob, np.uint32, n // BLOCK + 1, at)
            at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def _rank(self, level: int, place: int) -> int:
        """Set bits before `place`."""
        _, bits, ranks = self.levels[level]
        block = place // BLOCK
        first, whole = block * BLOCK // 8, place // 8
        n = int(ranks[block]) + int(np.bitwise_count(bits[first:whole]).sum())
        return n + (int(bits[whole]) & ((1 << place % 8) - 1)).bit_count() if place % 8 else n

    def __getitem__(self, place: int) -> int:
        """One id, without reading its neighbours."""
        if not 0 <= place < self.size:
            raise IndexError(place)
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[place]) << 8 * level
            if not bits[place // 8] >> place % 8 & 1:
                break
            place = self._rank(level, place)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids [start, stop) as unsigned 32-bit values."""
        out = np.zeros(max(0, stop - start), np.uint32)
        where = slice(None)
        for level, (chunks, bits, _) in enumerate(self.levels):
            if stop <= start:
                break
            part = chunks[start:stop].astype(np.uint32) << np.uint32(8 * level)
            out[where] |= part
            flags = np.unpackbits(bits[start // 8:-(-stop // 8)], bitorder="little")
            on = np.flatnonzero(flags[start % 8:start % 8 + stop - start])
            where = on if level == 0 else where[on]
            start = self._rank(level, start)
            stop = start + len(on)
        return out


def encode(ids: np.ndarray) -> bytes:
    """A segment of unsigned ids below 2**32."""
    values = ids.astype(np.uint32)
    parts, levels = [], 0
    while levels == 0 or len(values):
        more = values > 0xFF
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros((len(values) // BLOCK + 1) * BLOCK // 8, np.uint8)
        padded[:len(bits)] = bits
        per = np.bitwise_count(padded.reshape(-1, BLOCK // 8)).sum(1, dtype=np.uint32)
        ranks = np.concatenate(([0], np.cumsum(per)[:-1])).astype(np.uint32)
        parts += [struct.pack("<Q", len(values)), (values & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()]
        values = values[more] >> np.uint32(8)
        levels += 1
    return struct.pack("<4sQI", _MAGIC, len(ids), levels) + b"".join(parts)


#: A mark that does not follow a letter or digit, and white space other than blanks and line breaks.
_MARK = re.compile(r"[.,](?<=[\W_].)")
_OTHER = re.compile(r"[^\S \n]|\0")
_ASCII_OTHER = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\0"
_BATCH_BYTES = 4_000_000


def certain(text: str) -> bool:
    """Whether cutting at blanks, marks and line breaks surely agrees with the file's splitting rule."""
    return not (
        text[:1] in " .,\n" or text[-1:] in " \n" or "  " in text or " \n" in text or "\n " in text
        or "\n\n" in text or _MARK.search(text) or _has_other(text)
    )


#: Classes of bytes: 1 blank, 2 line break, 3 mark, 4 may be other white space, 5 begins characters that may be.
_CLASSES = np.zeros(256, np.uint8)
_CLASSES[[32, 10, 46, 44]] = 1, 2, 3, 3
_CLASSES[[*_ASCII_OTHER.encode(), 0xE1, 0xE2, 0xE3]] = 4
_CLASSES[0xC2] = 5
_LETTER_OR_DIGIT = np.array([chr(b).isalnum() and b < 128 for b in range(256)])


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the units of UTF-8 texts begin, and which texts `certain` must be asked about.

    The others are certain: what may make them not so is looked for in their bytes.
    """
    classes = _CLASSES[data]
    at = np.flatnonzero(classes)
    kind = classes[at]
    marks, lines, pairs = at[kind == 3], at[kind == 2], at[kind == 5]
    before, lead = data[marks - 1], data[marks - 2]
    # U+00C0 to U+00FF are letters but for the signs of multiplication and division
    latin = (lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
    white = kind <= 2
    doubtful = [
        at[kind == 4], marks[~(_LETTER_OR_DIGIT[before] | latin)],
        at[1:][white[1:] & white[:-1] & (at[1:] == at[:-1] + 1)],
        pairs[np.isin(data[np.minimum(pairs + 1, len(data) - 1)], (0x85, 0xA0))],
    ]
    full = np.flatnonzero(np.diff(offsets))
    first, last = offsets[full], offsets[full + 1] - 1
    ask = np.ones(len(offsets) - 1, bool)
    ask[full] = np.isin(classes[first], (1, 2, 3)) | np.isin(classes[last], (1, 2))
    ask[np.searchsorted(offsets, np.concatenate(doubtful), "right") - 1] = True
    begins = np.zeros(len(data) + 1, bool)
    begins[at[kind <= 3]] = begins[lines + 1] = begins[first] = True
    return np.flatnonzero(begins[:-1]), ask


def _has_other(text: str) -> bool:
    if text.isascii():
        return any(c in text for c in _ASCII_OTHER)
    return _OTHER.search(text) is not None


class UnitEncoder:
    """Ids of whole texts by the library, with each distinct unit encoded once and remembered.

    The file's splitting rule always parts before a lone blank, around a lone line break and
    between a letter or digit and a mark. So a text's ids are those of its units in turn; texts
    where this is not certain go to the library whole. A unit of letters is one pre-token, which
    the library's model takes without the rest of its chain.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model.tokenize
        self.units = WordCache(lambda units: list(map(self._unit, units)), CACHE_UNITS)
        symbols = byte_symbols()
        self.blank, self.symbols = symbols[32], str.maketrans({chr(b): c for b, c in symbols.items()})

    def _raw(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _unit(self, unit: str) -> bytes:
        if not unit.removeprefix(" ").isalpha():
            return self._raw([unit])[0]
        if unit.isascii():
            word = unit.replace(" ", self.blank)
        else:
            word = unit.encode().decode("latin-1").translate(self.symbols)
        return array("I", [p.id for p in self.model(word)]).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, counts = self.encode(pa.array(texts, pa.string()))
        return [part.tobytes() for part in np.split(ids, np.cumsum(counts)[:-1])] if texts else []

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and how many each has."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)
        offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        if offsets[0] == offsets[-1]:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
        offsets -= offsets[0]
        begins, ask = cut(data, offsets)
        whole = np.array([i for i in np.flatnonzero(ask) if not certain(texts[i].as_py())], np.int64)
        ends = np.append(begins, len(data))
        units = pa.Array.from_buffers(
            pa.large_string(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        if len(whole):
            kept = ~np.isin(np.searchsorted(offsets, begins, "right") - 1, whole)
            units, begins = units.filter(pa.array(kept)), begins[kept]
        coded = units.dictionary_encode()
        found = pa.array(self.units.values(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        after = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1) // 4
        ids = np.frombuffer(found.buffers()[2] or b"", "<u4")[:after[-1]]
        counts = np.diff(after[np.searchsorted(begins, offsets)])
        if len(whole):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i, raw in zip(whole, self._raw([texts[i].as_py() for i in whole])):
                parts[i] = np.frombuffer(raw, "<u4")
                counts[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, counts


def encoder(path: str) -> UnitEncoder:
    """The worker's encoder, with the units its earlier tasks have met; reading files back drops it."""
    return held_by_worker(("unit encoder", path), lambda: UnitEncoder(path))


SEGMENT = "part int, seq int, n_tokens long, doc_ids array<long>, lengths array<long>, codes binary"


def segments(docs: DataFrame, path: str, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Segments in ascending order of doc_id; a document is never split, so a segment may be longer."""
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(given.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)))
    place = F.coalesce(sum((F.when(F.col("doc_id") >= int(b), 1).otherwise(0) for b in bounds), F.lit(0)), F.lit(0))
    ordered = given.repartitionById(len(bounds) + 1, place).sortWithinPartitions("doc_id", "text")
    fields = schema_of(SEGMENT)
    def run(batches):
        work, part = encoder(path), TaskContext.get().partitionId()
        seq, total, held, ids, lengths = 0, 0, [], [], []

        def flush():
            values = np.concatenate(held)
            return pa.RecordBatch.from_pylist([{
                "part": part, "seq": seq, "n_tokens": len(values), "doc_ids": ids, "lengths": lengths, "codes": encode(values),
            }], schema=fields)

        for names, texts in slices(batches):
            found, counts = work.encode(texts)
            values = np.insert(found, np.cumsum(counts), end_id)
            first = last = 0
            for name, n in zip(names.to_pylist(), (counts + 1).tolist()):
                ids.append(name)
                lengths.append(n)
                total, last = total + n, last + n
                if total >= segment_tokens:
                    held.append(values[first:last])
                    yield flush()
                    seq, total, held, ids, lengths, first = seq + 1, 0, [], [], [], last
            held.append(values[first:])
        if ids:
            yield flush()

    return ordered.mapInArrow(run, SEGMENT)


def slices(batches):
    """Ids and texts of the batches in slices of bounded size."""
    for batch in batches:
        names, texts = batch.column("doc_id"), batch.column("text")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy())
        first = 0
        while first < len(names):
            before = sizes[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, before + _BATCH_BYTES, "right")))
            yield names[first:last], texts[first:last]
            first = last


def write_token_files(docs: DataFrame, folder: str, path: str, **settings) -> None:
    segments(docs, path, **settings).write.mode("errorifexists").parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document `doc_id, start, n_tokens, ids_crc32`, from the files alone."""
    files = spark.read.schema(SEGMENT).parquet(folder)
    sizes = files.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select(
        F.col("part").alias("_part"),
        F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("_inside")).join(
        before, F.col("part") == F.col("_part")
    ).select(F.col("part").alias("_part"), F.col("seq").alias("_seq"), (F.col("_before") + F.col("_inside")).alias("base"))
    return _documents(files).join(starts, (F.col("part") == F.col("_part")) & (F.col("seq") == F.col("_seq"))).select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def _documents(files: DataFrame) -> DataFrame:
    def make():
        dropped_by_worker("unit encoder")

        def step(rows):
            out = []
            for row in rows:
                codes, at = Codes(row["codes"]), 0
                raw = memoryview(codes.slice(0, codes.size).astype("<u4")).cast("B")
                for name, n in zip(row["doc_ids"], row["lengths"]):
                    out.append({"part": row["part"], "seq": row["seq"], "doc_id": name, "offset": at, "n_tokens": n, "ids_crc32": zlib.crc32(raw[4 * at:4 * (at + n)])})
                    at += n
            return out

        return step

    return map_rows(files, make, "part int, seq int, doc_id long, offset long, n_tokens long, ids_crc32 long")
