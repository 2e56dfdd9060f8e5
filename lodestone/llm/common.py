"""Shared parts of the training-data operators: sizes, Arrow chunks, a vectorised tokeniser and connected components.

Everything that runs on executors works on bounded chunks of Arrow batches, so memory follows the chunk size (and the
longest single text), never the size of a partition or of a group of equal rows.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import bounded_batches, dropped, met, written

# ---------------------------------------------------------------- sizes

#: Bytes of input text for one partition of a shuffle.
PART_BYTES = 8_000_000


def text_total(docs: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


def shuffle_parts(spark: SparkSession, size: int = 0, each: int = PART_BYTES) -> int:
    """Partitions for `size` bytes of text, so that a task's share stays the same whatever the input; at least the session's number."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


# ---------------------------------------------------------------- Arrow chunks


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.Table]:
    """Tables of about `limit` bytes of column `text` (at least one row each)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)])
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(lengths, lengths[at] + limit - size, side="right")) - 1)
            stop = min(stop, batch.num_rows)
            held.append(batch.slice(at, stop - at))
            size += int(lengths[stop] - lengths[at])
            at = stop
            if size >= limit or at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                trimmed()
    if held:
        yield pa.Table.from_batches(held)


def trimmed() -> None:
    """Gives freed memory back to the system, so that a worker's size follows its chunk and not its history."""
    with contextlib.suppress(OSError, AttributeError):
        pa.default_memory_pool().release_unused()
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column as one array, and the n+1 row offsets; a null row is empty."""
    arr = pc.fill_null(column.cast(pa.large_string()), "")
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.large_string())
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


# ---------------------------------------------------------------- vectorised tokeniser and hashes

U = np.uint64
#: Words are runs of anything but these bytes.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes outside [0-9A-Za-z] and non-ASCII: separators for phrase matching.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x41:0x5B] = NOT_ALNUM[0x61:0x7B] = NOT_ALNUM[0x80:] = False

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_VALUE_LOWER = _VALUE.copy()
_VALUE_LOWER[0x41:0x5B] = _VALUE[0x61:0x7B]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the worker's life."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        p = np.full(size, base & (2**64 - 1), U)
        p[0] = 1
        with np.errstate(over="ignore"):
            np.cumprod(p, out=p)
        _powers[base] = have = p
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class Words:
    """All words of a chunk: starts and ends in bytes, 64-bit hashes, and `first` (n rows + 1 offsets into the words)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE, lower: bool = False, hashes: bool = True, block: int = 1 << 20):
        starts, ends, hs = [], [], []
        rows = len(offsets) - 1
        at = 0
        while at < rows:  # blocks of rows bound the temporary arrays
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block, side="right")) - 1)
            lo, hi = int(offsets[at]), int(offsets[stop])
            part, cut = data[lo:hi], offsets[at : stop + 1] - lo
            s, e = _bounds(part, cut, separators)
            if hashes:
                hs.append(_hashes(part, s, e, _VALUE_LOWER if lower else _VALUE))
            starts.append(s + lo)
            ends.append(e + lo)
            at = stop
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.starts, self.ends = cat(starts, np.int64), cat(ends, np.int64)
        self.hashes = cat(hs, U)
        self.first = np.searchsorted(self.starts, offsets).astype(np.int64)
        self.counts = np.diff(self.first)


def _bounds(part: np.ndarray, cut: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(part):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~separators[part]
    before = np.zeros(len(part), bool)
    before[1:] = word[:-1]
    before[cut[:-1][cut[:-1] < len(part)]] = False
    after = np.zeros(len(part), bool)
    after[:-1] = word[1:]
    after[cut[1:][cut[1:] > 0] - 1] = False
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def _hashes(part: np.ndarray, s: np.ndarray, e: np.ndarray, value: np.ndarray) -> np.ndarray:
    c = np.zeros(len(part) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(value[part] * powers(_BASE, len(part)), out=c[1:])
        return mix((c[e] - c[s]) * powers(_INVERSE, len(part) + 1)[s])


def sequence_keys(hashes: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    """One 64-bit key for each row's word sequence."""
    n = len(hashes)
    c = np.zeros(n + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(mix(hashes ^ U(salt)) * powers(_BASE, n), out=c[1:])
        keys = (c[first[1:]] - c[first[:-1]]) * powers(_INVERSE, n + 1)[first[:-1]]
        return mix(keys + U(0x2545F4914F6CDD1D) * np.diff(first).astype(U) + U(salt))


def gram_hashes(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of the n words from each position on (length: words - n + 1), whatever row they lie in."""
    size = max(0, len(hashes) - n + 1)
    out = np.full(size, U(salt), U)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * U(0xD6E8FEB86659FD93) + hashes[j : j + size]
    return mix(out)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, .. (counts[0] of them), starts[1], .."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = counts > 0
    starts, counts = starts[keep], counts[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    at = np.cumsum(counts)[:-1]
    step[at] = starts[1:] - (starts[:-1] + counts[:-1] - 1)
    return np.cumsum(step)


def union(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Root (smallest member) of each of n nodes under edges a-b; vectorised hooking with pointer jumps."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        alive = ra != rb
        a, b, ra, rb = a[alive], b[alive], ra[alive], rb[alive]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


# ---------------------------------------------------------------- filters of fixed size

#: Bits of a filter. When it fills up it lets more pass than needed, never less.
BLOOM = 1 << 23
_BLOOM_SLICES, BLOOM_TASKS = 16, 128


def bloom_bits(keys: np.ndarray) -> np.ndarray:
    """(n, 2) keys -> (n, 2) bit positions."""
    return (mix(keys) % U(BLOOM)).astype(np.int64)


def bloom_of(df: DataFrame, keys_of) -> np.ndarray:
    """Filter over the keys that `keys_of(batch)` gives as an (n, 2) array of 64-bit numbers; BLOOM / 8 bytes. `df` is a written table;
    at most BLOOM_TASKS tasks read it, so what they send doesn't grow with its files."""

    def one(batches):
        bits, some = np.zeros(BLOOM, bool), False
        for batch in batches:
            if batch.num_rows:
                bits[bloom_bits(keys_of(batch)).ravel()] = True
                some = True
        if some:
            parts = np.packbits(bits).reshape(_BLOOM_SLICES, -1)
            yield pa.record_batch([pa.array(range(_BLOOM_SLICES), pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(p.tobytes()) for p in parts], pa.binary())], names=["k", "b"])

    def join(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), np.uint8)
                total[k] = part | total[k] if k in total else part
        for k, part in total.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["k", "b"])

    bits = np.zeros((_BLOOM_SLICES, BLOOM // 8 // _BLOOM_SLICES), np.uint8)
    for r in df.coalesce(BLOOM_TASKS).mapInArrow(one, "k int, b binary").repartition(_BLOOM_SLICES, "k").mapInArrow(join, "k int, b binary").collect():
        bits[r.k] = np.frombuffer(r.b, np.uint8)
    return bits.ravel()


def maybe_in(bloom, a: str, b: str):
    """Column: whether the two 64-bit columns a and b may be a key of a broadcast filter. Python sees nothing but them."""

    @F.pandas_udf("boolean")
    def maybe(x: pd.Series, y: pd.Series) -> pd.Series:
        at = bloom_bits(np.stack([x.to_numpy(np.int64), y.to_numpy(np.int64)], 1).view(U))
        return pd.Series(((bloom.value[at >> 3] >> (7 - (at & 7))) & 1).all(1))

    return maybe(a, b)


# ---------------------------------------------------------------- counts in a hashed table of fixed size

#: Cells of the table: about one for each CELL_BYTES of text, within these bounds; it is sent in slices of SLICE cells.
CELL_BYTES, LEAST_CELLS, MOST_CELLS, SLICE = 256, 1 << 16, 1 << 24, 1 << 16


def cells_for(size: int) -> int:
    return 1 << min(MOST_CELLS, max(LEAST_CELLS, size // CELL_BYTES)).bit_length() - 1


def cell_slices(counts: np.ndarray) -> list[bytes]:
    """A task's table of 32-bit counts in packed slices."""
    return [zstandard.ZstdCompressor(level=1).compress(p.tobytes()) for p in counts.reshape(-1, SLICE)]


def _add_slices(batches):
    """Sum of each slice, as one byte a cell: 8 log2(1 + count)."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), np.uint32)
            total[k] = total.get(k, 0) + part.astype(np.int64)
    for k, part in total.items():
        logs = np.minimum(np.round(8 * np.log2(1 + part)), 255).astype(np.uint8)
        yield pa.record_batch([pa.array([k], pa.int32()), pa.array([int(part.sum())], pa.int64()), pa.array([logs.tobytes()], pa.binary())], names=["k", "n", "b"])


def size_classes(slices: DataFrame, cells: int) -> np.ndarray:
    """From (slice number, packed counts) of all tasks: a class from 0 (usual) to 15 (most frequent) of each cell, at most MOST_CELLS bytes."""
    logs, n = np.zeros((cells // SLICE, SLICE), np.uint8), 0
    for r in slices.toDF("k", "b").repartition(len(logs), "k").mapInArrow(_add_slices, "k int, n long, b binary").toLocalIterator():
        logs[r.k] = np.frombuffer(r.b, np.uint8)
        n += r.n
    usual = n / cells + 2 * (n / cells) ** 0.5 + 2
    return np.clip(np.ceil(2 * (np.arange(256) / 8 - np.log2(usual))), 0, 15).astype(np.uint8)[logs].ravel()


def ranked_by_class(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A number for each hash that puts frequent ones behind: its class in the top four bits, then its own bits."""
    return (hashes >> U(4)) | classes[(hashes & U(len(classes) - 1)).astype(np.int64)].astype(U) << U(60)


# ---------------------------------------------------------------- connected components


#: Edges that one task joins by itself (about 10 MB).
ALONE = 1 << 18


def _joined_alone(batches):
    """(node, component) of all edges of a small graph."""
    held = [b for b in batches if b.num_rows]
    if held:
        edges = pa.Table.from_batches(held)
        ends = pa.chunked_array([*edges["u"].chunks, *edges["v"].chunks])
        names = pc.unique(ends)
        names = names.take(pc.sort_indices(names))
        at = pc.index_in(ends, names).to_numpy()
        root = union(at[: edges.num_rows], at[edges.num_rows :], len(names))
        yield pa.record_batch([names, names.take(pa.array(root))], names=["node", "component"]).filter(pa.array(root != np.arange(len(root))))


def components(edges: DataFrame, limit: int = 60, alone: int = ALONE) -> DataFrame:
    """(node, component): component is the smallest node reachable; that node itself has no row. `edges` has src and dst of one orderable type.

    Up to `alone` distinct edges are joined by one task. More take alternating large-star and small-star steps: a step is one partial
    aggregation and one join, and a node with very many neighbours is neither gathered in a task (see met) nor paired with itself.
    Each round is written to the shared folder.
    """
    now = written(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    mark = _mark(now)
    if mark[0] <= alone:
        kind = now.schema["u"].dataType.simpleString()
        out = written(now.coalesce(1).mapInArrow(_joined_alone, f"node {kind}, component {kind}"))
        dropped(now)
        return out
    for _ in range(limit):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = written(met(both, low, "u", "n", 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = met(large, least, "u", "n", mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = written(small)
        dropped(large)
        new = _mark(after)
        dropped(now)
        now = after
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    """Content of an edge table: count and two order-free sums of hashes."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(20,0)")), F.sum(F.pmod(h, F.lit(1_000_003)))).first())
