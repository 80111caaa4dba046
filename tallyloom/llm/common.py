"""Small helpers the operators share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Entries of one generation of a worker's word cache; it bounds memory, never results.
CACHE_ENTRIES = 400_000


class WordCache:
    """What was computed for words, in two generations of bounded size; the older one is dropped."""

    def __init__(self, compute: Callable[[list], list], entries: int = CACHE_ENTRIES):
        self.compute, self.entries = compute, entries
        self.now: dict = {}
        self.before: dict = {}

    def fill(self, lists: list[list]) -> dict:
        """A table that holds every word of `lists`."""
        words = set().union(*lists)
        missing = words - self.now.keys()
        if len(self.now) + len(missing) > self.entries:
            self.before, self.now, missing = self.now, {}, words
        before, now, fresh = self.before, self.now, []
        for word in missing:
            value = before.get(word)
            if value is None:
                fresh.append(word)
            else:
                now[word] = value
        now.update(zip(fresh, self.compute(fresh)))
        return now

    def values(self, words: list) -> list:
        """The values of distinct words, in their order."""
        found = list(map(self.now.get, words))
        missing = [i for i, value in enumerate(found) if value is None]
        if len(self.now) + len(missing) > self.entries:
            self.before, self.now = self.now, {}
        before, now, fresh = self.before, self.now, []
        for i in missing:
            value = found[i] = before.get(words[i])
            if value is None:
                fresh.append(i)
            else:
                now[words[i]] = value
        for i, value in zip(fresh, self.compute([words[i] for i in fresh])):
            found[i] = now[words[i]] = value
        return found


def held_by_worker(key, make: Callable[[], object]):
    """What `make` gave for a key when this process first asked; task functions, and with them the
    globals of their modules, are unpickled anew for each task, a module of the interpreter is not."""
    held = _worker()
    if key not in held:
        held[key] = make()
    return held[key]


def dropped_by_worker(kind: str) -> None:
    """Free what this process holds under keys that begin with `kind`."""
    held = _worker()
    for key in [k for k in held if isinstance(k, tuple) and k[0] == kind]:
        del held[key]


def _worker() -> dict:
    name = "_tallyloom_worker"
    return sys.modules.setdefault(name, ModuleType(name)).__dict__


def body(name: str = "text") -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the value written as text, modulo `modulus`; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def map_rows(df: DataFrame, make: Callable[[], Callable[[list[dict]], list[dict]]], schema: str, most_bytes: int | None = None) -> DataFrame:
    """Run `make()(rows)` over the Arrow batches of each partition; `make` runs once a task.

    With `most_bytes` the rows of a batch come in slices of about so many bytes on average.
    """
    fields = schema_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            size = len(batch) if most_bytes is None else max(1, len(batch) * most_bytes // max(1, batch.nbytes))
            for first in range(0, len(batch), size or 1):
                out = step(batch.slice(first, size).to_pylist())
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=fields)

    return df.mapInArrow(run, schema)


def ddl_of(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def schema_of(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def pack(values: np.ndarray) -> bytes:
    """Compress an array: its bytes by place, so that runs of high zero bytes cost nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    kind = np.dtype(dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


def pack_few(values: np.ndarray, codes: np.ndarray) -> bytes:
    """Compress `values[codes]` where few of the values are distinct: those that occur, then their numbers."""
    seen = np.bincount(codes, minlength=len(values)) > 0
    table = pack(values[seen])
    return len(table).to_bytes(4, "little") + table + pack((np.cumsum(seen) - 1)[codes].astype(_number_type(int(seen.sum()))))


def unpack_few(blob: bytes, dtype) -> np.ndarray:
    end = 4 + int.from_bytes(blob[:4], "little")
    values = unpack(blob[4:end], dtype)
    return values[unpack(blob[end:], _number_type(len(values)))]


def _number_type(n: int):
    return np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (xor-shift-multiply rounds)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
