"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A document is the set of its distinct word shingles. Two sets of sizes x and y have Jaccard similarity t or more only if
they share T = ceil(t x) shingles (and ceil(t y)): each occurs in T inverted lists of the other. DivideSkip sets the T - tau
longest lists aside; a partner then still occurs tau times in the short ones. Short lists are merged and occurrences counted,
long ones are only probed for documents that are left, and those that reach the overlap are kept.

* Which lists are short follows from a count of all shingles of all documents in a hashed table of fixed size: ordinary
  shingles by hash, frequent ones (a line in a third of all texts) last, by size class. As the order is the same for all documents, the
  tau occurrences lie in the short lists of both (`_short_lists`: the first x - T + tau of a document in that order).
* Short lists meet at the bucket of their shingle, where they are merged by sorting and each pair's occurrences are counted
  (`_merge`). Counts of all buckets are summed; pairs below tau go. Pairs are held against a bound as well: each set has a
  bitmap of about one bit a shingle, and a bit that is set in one bitmap only is a shingle that isn't shared (`_may_reach`).
* Long lists are built for the documents of a block of pairs, and each partner is searched in them by binary probes; pairs
  that reach T in all are links (`_probe`).
* A list of over `small` entries isn't turned into all its pairs: it gives no counts, so what a pair needs is lowered by the
  number of such lists that both lie in. A first round tries to link each entry to one document of its sizes, as near copies mostly
  are links. A second one looks at all pairs of such a list that still lie in different components; links inside a component can't
  change it, so nothing is lost. Pairs are never rows there: a block of a list tells which of its entries may have a link by sizes
  and bitmaps (`_may_link`); their sets travel to it, once a block and not once a pair, are searched there, and the links that join components
  come out (`_linked`). A pair that shares many lists is looked at in the first one: each entry names its smallest lists, and a pair
  that both name an earlier list is left to that one. Stripes, and a grid of blocks of two stripes, spread a hot list over many tasks.

Equal word sequences are one class from the start, named by 128 bits of hash. Shingles are told apart by 64 bits.

Defined cases: text without words (or null): n_shingles 0, links with nothing, component is its own id. Fewer words than a
shingle: the whole sequence is the one shingle. Repeated rows fall into one class. A null id never names a component that
has another id. Rows, not ids, are kept or removed by `keep_one`. Extra columns are kept by it (internal names start with
`_ng_`). An empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    U, Words, bloom_bits, bloom_of, cell_slices, cells_for, chunks, components, dropped, gram_hashes, maybe_in, met, mix, ranges, ranked_by_class, sequence_keys, shuffle_parts,
    size_classes, text_bytes, text_total, written,
)
from .substring_dedup import _pack, _unpack, _with

CHUNK = 2_000_000
#: Bits of the smallest bitmap.
BITS = 2048
#: Occurrences in short lists that a pair needs (fewer if T is smaller).
TAU = 3
#: Lists up to this length are turned into their pairs.
SMALL = 24
#: Entries of a long list in one stripe of its grid, and their shingles.
BLOCK, STRIPE = 512, 1 << 19
#: Lists that an entry names, the smallest first.
NAMED = 32


# ---------------------------------------------------------------- sets of a chunk


def _sets(table: pa.Table, text: str, n: int):
    """Shingle hashes of each row, back to back, with n_rows + 1 offsets, and two keys a row."""
    data, off = text_bytes(table[text])
    words = Words(data, off, lower=True)
    keys = np.stack([sequence_keys(words.hashes, words.first, 101), sequence_keys(words.hashes, words.first, 202)], 1)
    grams = gram_hashes(words.hashes, n, 11) if len(words.hashes) >= n else np.zeros(0, U)
    count = np.maximum(words.counts - n + 1, 0)
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    values = grams[ranges(words.first[:-1], count)]
    size = count.copy()
    size[short] = 1
    first = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(first[-1], U)
    body = np.ones(len(out), bool)
    body[first[short]] = False
    out[body] = values
    out[first[short]] = sequence_keys(words.hashes, words.first, 303)[short]
    return out, first, keys


def _sort(values: np.ndarray, first: np.ndarray) -> None:
    """Sorts each row's values in place."""
    for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if e - s > 1:
            values[s:e].sort()


def _distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts each row's values in place and drops repeats."""
    _sort(values, first)
    keep = np.ones(len(values), bool)
    if len(values):
        keep[1:] = values[1:] != values[:-1]
        starts = first[:-1][first[:-1] < first[1:]]
        keep[starts] = True
    c = np.concatenate([[0], np.cumsum(keep)])
    return values[keep], c[first]


def _firsts(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows with words that come first of their class in the chunk."""
    _, at = np.unique(np.ascontiguousarray(keys).view("V16").ravel(), return_index=True)
    at = np.sort(at)
    return at[first[at + 1] > first[at]]


def _picked(values: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    count = (first[1:] - first[:-1])[rows]
    return values[ranges(first[rows], count)], np.concatenate([[0], np.cumsum(count)])


def _binary(raw: np.ndarray, width: int) -> pa.Array:
    n = len(raw) // width if width else 0
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw).tobytes())])


def _keys_of(column) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array([np.frombuffer(x.as_py(), U) for x in arr]).reshape(-1, 2) if len(arr) else np.zeros((0, 2), U)


# ---------------------------------------------------------------- pass 1: classes, set sizes, counts of all shingles

_PROFILE = "_ng_a long, _ng_b long, n_shingles long, _ng_key binary, _ng_bits binary, _ng_slice int, _ng_counts binary"
_NAMES = ["_ng_a", "_ng_b", "n_shingles", "_ng_key", "_ng_bits", "_ng_slice", "_ng_counts"]


def _bitmap(values: np.ndarray) -> bytes:
    """2**k bits, at least one a shingle; a longer one folds to a shorter one by OR of its halves."""
    bits = np.zeros(max(BITS, 1 << (len(values) - 1).bit_length()), bool)
    bits[(values >> U(8)).astype(np.int64) & (len(bits) - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _bound(t: tuple[int, int], x: int, y: int, a: bytes, b: bytes) -> bool:
    """Whether sets of x and y shingles with bitmaps a and b may reach the threshold."""
    while len(a) > len(b):
        a = (int.from_bytes(a[: len(a) // 2], "little") | int.from_bytes(a[len(a) // 2 :], "little")).to_bytes(len(a) // 2, "little")
    while len(b) > len(a):
        b = (int.from_bytes(b[: len(b) // 2], "little") | int.from_bytes(b[len(b) // 2 :], "little")).to_bytes(len(b) // 2, "little")
    u, v = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    most = min(x - (u & ~v).bit_count(), y - (v & ~u).bit_count())
    return t[1] * most >= t[0] * (x + y - most)


def _least(size: int, t: tuple[int, int]) -> int:
    """Occurrences that a document of `size` shingles needs in short lists."""
    return min(TAU, -(-t[0] * size // t[1]))


def _may_reach(t: tuple[int, int]):
    """Drops pairs that occur too seldom in short lists (ha, hb: lists of a and b that weren't counted), or that can't reach the
    threshold by their sizes and bitmaps."""

    def run(batches):
        for batch in batches:
            keep = []
            for n, ha, hb, x, y, a, b in zip(*(batch.column(c).to_pylist() for c in ("n", "ha", "hb", "na", "nb", "ba", "bb")), strict=True):
                if n + min(ha, hb) < min(_least(x, t), _least(y, t)):
                    keep.append(False)
                    continue
                keep.append(_bound(t, x, y, a, b))
            yield pa.RecordBatch.from_arrays([batch.column("ka"), batch.column("kb")], ["ka", "kb"]).filter(pa.array(keep, pa.bool_()))

    return run


def _profile(text: str, id_col: str, n: int, cells: int):
    def run(batches):
        total = np.zeros(cells, np.uint32)
        id_type = None
        for table in chunks(batches, text, CHUNK):
            values, first, keys = _sets(table, text, n)
            values, first = _distinct(values, first)
            heads = _firsts(keys, first)
            mine, cut = _picked(values, first, heads)
            bits = [None] * table.num_rows
            for r, lo, hi in zip(heads.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                bits[r] = _bitmap(mine[lo:hi])
            total += np.bincount((mine & U(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint32)
            rows, id_type = table.num_rows, table[id_col].type
            size = np.diff(first)
            key = pa.array([k if s else None for k, s in zip(_binary(keys.view(np.uint8).ravel(), 16).to_pylist(), size.tolist(), strict=True)], pa.binary())
            yield pa.record_batch([*(table[c].combine_chunks() for c in (id_col, "_ng_a", "_ng_b")), pa.array(size, pa.int64()), key, pa.array(bits, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=[id_col, *_NAMES])
        if id_type is not None:
            parts = cell_slices(total)
            k = len(parts)
            yield pa.record_batch([pa.nulls(k, id_type), *[pa.nulls(k, pa.int64())] * 3, pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array(parts, pa.binary())], names=[id_col, *_NAMES])

    return run


# ---------------------------------------------------------------- pass 2: short lists


def _prefix(size: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    """Number of short lists of documents of `size` shingles."""
    need = (t[0] * size + t[1] - 1) // t[1]
    return size - need + np.minimum(need, TAU)


def _short_lists(text: str, n: int, t: tuple[int, int], parts: int, classes):
    def run(batches):
        rank = classes.value
        for table in chunks(batches, text, CHUNK):
            values, first, keys = _sets(table, text, n)
            rows = _firsts(keys, first)
            values, first = _picked(values, first, rows)
            values, first = _distinct(values, first)
            size = np.diff(first)
            values = ranked_by_class(values, rank)
            _sort(values, first)  # by size class, then hash
            take = _prefix(size, t)
            doc = np.repeat(np.arange(len(rows)), take)
            entry = values[ranges(first[:-1], take)]
            if not len(entry):
                continue
            with np.errstate(over="ignore"):
                part = ((entry * U(0x9E3779B97F4A7C15)) >> U(33)) % U(parts)
            order = np.argsort(part.astype(np.int32), kind="stable")
            part, doc, entry = part[order], doc[order], entry[order]
            cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
            out_part, out_blob, out_n = [], [], []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                docs, local = np.unique(doc[lo:hi], return_inverse=True)
                out_part.append(int(part[lo]))
                out_n.append(hi - lo)
                out_blob.append(_pack([keys[rows[docs]], size[docs].astype(np.int32), entry[lo:hi], np.diff(local, prepend=0).astype(np.uint8)]))  # documents come in order
            yield pa.record_batch([pa.array(out_part, pa.int32()), pa.array(out_n, pa.int64()), pa.array(out_blob, pa.binary())], names=["part", "n", "blob"])

    return run


#: Candidate pairs with their occurrences `n` in the lists of a bucket, or (kb null) entries of a long list that occurs `n` times.
_PAIR = "ka binary, kb binary, xa int, n int, list long"
#: Occurrences of a pair that is to be looked at in any case.
_ALWAYS = 1 << 20


def _fits(x: np.ndarray, y: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    return np.minimum(x, y).astype(np.int64) * t[1] >= np.maximum(x, y).astype(np.int64) * t[0]


def _pairs_out(ids: np.ndarray, n: np.ndarray, keys: np.ndarray):
    for lo in range(0, len(ids), 1 << 17):
        i, j = (ids[lo : lo + (1 << 17)] >> 32), ids[lo : lo + (1 << 17)] & 0xFFFFFFFF
        yield pa.record_batch([_binary(keys[i].view(np.uint8).ravel(), 16), _binary(keys[j].view(np.uint8).ravel(), 16), pa.nulls(len(i), pa.int32()), pa.array(n[lo : lo + (1 << 17)], pa.int32()), pa.nulls(len(i), pa.int64())], names=["ka", "kb", "xa", "n", "list"])


class _Occurrences:
    """Sum of the occurrences of each pair of documents over the lists seen so far."""

    def __init__(self, sizes: np.ndarray, t: tuple[int, int]):
        self.sizes, self.t, self.parts, self.held = sizes, t, [], 0

    def add(self, i: np.ndarray, j: np.ndarray, times: int = 1) -> None:
        fit = _fits(self.sizes[i], self.sizes[j], self.t) & (i != j)
        i, j = i[fit], j[fit]
        if len(i):
            ids, n = np.unique((np.minimum(i, j) << 32) | np.maximum(i, j), return_counts=True)
            self.parts.append((ids, n * times))
            self.held += len(ids)
        if self.held > 2_000_000 and len(self.parts) > 1:
            self.parts = [self.all()]
            self.held = len(self.parts[0][0]) // 2

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        ids, inverse = np.unique(ids, return_inverse=True)
        return ids, np.minimum(np.bincount(inverse, n, len(ids)), _ALWAYS).astype(np.int64)


def _stars(within: np.ndarray, docs: np.ndarray, sizes: np.ndarray, t: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect the entries of each list (in order of size): each with the first document of its span of sizes that may be
    links, and the ends of neighbouring spans. The first document is the same one in most lists of a group, so pairs repeat."""
    span = np.floor(np.log(np.maximum(sizes, 1)) / np.log(t[1] / t[0])).astype(np.int64)
    head = np.ones(len(docs), bool)
    head[1:] = (within[1:] != within[:-1]) | (span[1:] != span[:-1])
    group = np.cumsum(head) - 1
    pivot = np.minimum.reduceat(docs, np.flatnonzero(head))[group]
    near = np.flatnonzero(head[1:] & (within[1:] == within[:-1]))
    return np.concatenate([pivot, docs[near]]), np.concatenate([docs, docs[near + 1]])


def _merge(t: tuple[int, int], small: int):
    """Merges the short lists of one bucket and counts the occurrences of pairs; longer lists are given as they are."""

    def run(batches):
        keys, sizes, entries, docs, base = [], [], [], [], 0
        for batch in batches:
            for blob in batch.column("blob"):
                (k, size, entry, doc), _ = _unpack(blob.as_py(), (U, np.int32, U, np.uint8))
                keys.append(k.reshape(-1, 2)), sizes.append(size), entries.append(entry), docs.append(np.cumsum(doc, dtype=np.int64) + base)
                base += len(size)
        if not base:
            return
        keys, sizes, entries, docs = np.concatenate(keys), np.concatenate(sizes), np.concatenate(entries), np.concatenate(docs)
        order = np.lexsort((keys[:, 1], keys[:, 0]))  # one number a class, in the order of keys
        new = np.ones(len(order), bool)
        new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(1)
        ident = np.empty(len(order), np.int64)
        ident[order] = np.cumsum(new) - 1
        keys, sizes, docs = keys[order[new]], sizes[order[new]], ident[docs]
        order = np.argsort(entries, kind="stable")  # the merge: all lists of the bucket, one after the other
        entries, docs = entries[order], docs[order]
        alive = np.zeros(len(entries), bool)  # lists of one entry have no pair
        same = entries[1:] == entries[:-1]
        alive[1:] |= same
        alive[:-1] |= same
        entries, docs = entries[alive], docs[alive]
        if not len(entries):
            return
        group = np.cumsum(np.append(True, entries[1:] != entries[:-1])) - 1
        order = np.lexsort((docs, sizes[docs], group))
        group, docs = group[order], docs[order]
        keep = np.ones(len(docs), bool)
        keep[1:] = (group[1:] != group[:-1]) | (docs[1:] != docs[:-1])
        group, docs = group[keep], docs[keep]
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        many = np.diff(np.append(head, len(group)))
        seen = _Occurrences(sizes, t)
        for m in np.unique(many[(many > 1) & (many <= small)]).tolist():
            at = head[many == m]
            x, y = np.triu_indices(m, 1)
            step = max(1, 500_000 // len(x))
            for lo in range(0, len(at), step):
                block = docs[at[lo : lo + step, None] + np.arange(m)]
                seen.add(block[:, x].ravel(), block[:, y].ravel())
        starts, counts = head[many > small], many[many > small]
        if len(starts):
            # a list is named by what it holds, so equal ones (of all buckets) fall together: one of each is enough
            with np.errstate(over="ignore"):
                weight = keys[docs, 0] * U(3) + keys[docs, 1]
                c = np.concatenate([np.zeros(1, U), np.cumsum(weight * weight)])
                name = mix((c[starts + counts] - c[starts]) * U(0x9E3779B97F4A7C15) + counts.astype(U))
            _, one, times = np.unique(name, return_index=True, return_counts=True)
            at = ranges(starts[one], counts[one])
            within = np.repeat(np.arange(len(one)), counts[one])
            seen.add(*_stars(within, docs[at], sizes[docs[at]], t), _ALWAYS)
            named, times = name[one][within], times[within]
            for lo in range(0, len(at), 1 << 17):
                k = docs[at[lo : lo + (1 << 17)]]
                yield pa.record_batch([_binary(keys[k].view(np.uint8).ravel(), 16), pa.nulls(len(k), pa.binary()), pa.array(sizes[k], pa.int32()), pa.array(times[lo : lo + (1 << 17)], pa.int32()), pa.array(named[lo : lo + (1 << 17)].view(np.int64))], names=["ka", "kb", "xa", "n", "list"])
        ids, n = seen.all()
        if len(ids):
            yield from _pairs_out(ids, n, keys)

    return run


# ---------------------------------------------------------------- verification


def _wanted_sets(text: str, n: int, bloom):
    def run(batches):
        bits = None
        for table in chunks(batches, text, CHUNK):
            bits = np.unpackbits(bloom.value).astype(bool) if bits is None else bits
            values, first, keys = _sets(table, text, n)
            rows = _firsts(keys, first)
            rows = rows[bits[bloom_bits(keys[rows])].all(1)]
            values, first = _distinct(*_picked(values, first, rows))
            raw = values.tobytes()
            blobs = [raw[8 * s : 8 * e] for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.record_batch([_binary(keys[rows].view(np.uint8).ravel(), 16), pa.array(blobs, pa.binary())], names=["_ng_key", "_ng_set"])

    return run


def _probe(t: tuple[int, int]):
    """Keeps the pairs whose overlap reaches T. Inverted lists are built for the distinct documents `a` of a block of pairs; each of
    the shingles of `b` names a list, in which `a` is looked up by binary search."""

    def block(pairs):
        number: dict[bytes, int] = {}
        owner = np.array([number.setdefault(x[0], len(number)) for x in pairs])
        packed = {x[0]: x[2] for x in pairs}
        sets = [np.frombuffer(packed[k], U) for k in number]
        size_a = np.array([len(x) for x in sets])
        values = np.concatenate(sets)
        lists, inverse = np.unique(values, return_inverse=True)
        entries = np.sort(inverse.astype(np.int64) * len(sets) + np.repeat(np.arange(len(sets)), size_a))  # by list, then document
        probes = [np.frombuffer(x[3], U) for x in pairs]
        size_b = np.array([len(x) for x in probes])
        want, pair = np.concatenate(probes), np.repeat(np.arange(len(pairs)), size_b)
        at = np.minimum(np.searchsorted(lists, want), len(lists) - 1)
        there = lists[at] == want
        key, pair = at[there] * len(sets) + owner[pair[there]], pair[there]
        place = np.minimum(np.searchsorted(entries, key), len(entries) - 1)
        both = np.bincount(pair[entries[place] == key], minlength=len(pairs))
        return t[1] * both >= t[0] * (size_a[owner] + size_b - both)

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for x in zip(*(batch.column(c).to_pylist() for c in ("ka", "kb", "sa", "sb")), strict=True):
                held.append(x)
                size += len(x[2]) + len(x[3])
                if size > CHUNK:
                    yield from out(held)
                    held, size = [], 0
            if held:
                yield from out(held)

    def out(held):
        keep = block(held)
        if keep.any():
            yield pa.record_batch([pa.array([x[c] for x, k in zip(held, keep.tolist(), strict=True) if k], pa.binary()) for c in (0, 1)], names=["src", "dst"])

    return run


def _with_sets(docs: DataFrame, text: str, n: int, wanted: DataFrame, have: list[DataFrame]) -> DataFrame | None:
    """(_ng_key, _ng_set) of the classes in `wanted` (ka); `have` holds the tables of sets made so far, and gets one more if sets are missing."""
    wanted = written(wanted.distinct().withColumnRenamed("ka", "_ng_key"))
    if wanted.isEmpty():
        return None
    missing, first = wanted, not have
    for table in have:
        missing = missing.join(table.select("_ng_key"), "_ng_key", "left_anti")
    missing = wanted if first else written(missing)
    if not missing.isEmpty():
        bloom = docs.sparkSession.sparkContext.broadcast(bloom_of(missing, lambda batch: _keys_of(batch.column(0))))
        sets = docs.select(text).mapInArrow(_wanted_sets(text, n, bloom), "_ng_key binary, _ng_set binary")
        have.append(written(sets.join(missing, "_ng_key", "left_semi").groupBy("_ng_key").agg(F.first("_ng_set").alias("_ng_set"))))
        bloom.destroy()
    if first:
        return have[0]
    sets = have[0]
    for table in have[1:]:
        sets = sets.unionByName(table)
    return sets.join(wanted, "_ng_key", "left_semi")


def _verified(docs: DataFrame, text: str, n: int, pairs: DataFrame, bits: DataFrame, t: tuple[int, int], have: list[DataFrame]) -> DataFrame:
    """The pairs (ka, kb, n) that are links, as (src, dst). Only sets of pairs that pass the bound are dealt out."""
    a, b = (bits.select(F.col("_ng_key").alias(f"k{x}"), F.col("n_shingles").alias(f"n{x}"), F.col("_ng_bits").alias(f"b{x}"), F.col("_ng_long").alias(f"h{x}")) for x in "ab")
    left = written(pairs.join(b, "kb").join(a, "ka").select("ka", "kb", "n", "ha", "hb", "na", "nb", "ba", "bb").mapInArrow(_may_reach(t), "ka binary, kb binary"))
    sets = _with_sets(docs, text, n, left.select("ka").unionByName(left.select(F.col("kb").alias("ka"))), have)
    if sets is None:
        return left.select(F.col("ka").alias("src"), F.col("kb").alias("dst"))
    a, b = (sets.select(F.col("_ng_key").alias(f"k{x}"), F.col("_ng_set").alias(f"s{x}")) for x in "ab")
    links = written(left.join(b, "kb").join(a, "ka").select("ka", "kb", "sa", "sb").mapInArrow(_probe(t), "src binary, dst binary"))
    dropped(left)
    return links


# ---------------------------------------------------------------- blocks of long lists


def _folded(blobs: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of BITS bits."""
    return np.array([np.bitwise_or.reduce(np.frombuffer(x, U).reshape(-1, BITS // 64), 0) for x in blobs], U).reshape(-1, BITS // 64)


def _earlier(named: list[np.ndarray], name: int) -> np.ndarray:
    """For each entry, bits of the lists before `name` that it names."""
    count = np.array([int(np.searchsorted(x, name)) for x in named])
    lists, at = np.unique(np.concatenate([x[:c] for x, c in zip(named, count.tolist(), strict=True)]), return_inverse=True)
    if not len(lists):
        return np.zeros((len(named), 0), U)
    out = np.zeros((len(named), -(-len(lists) // 64) * 64), bool)
    out[np.repeat(np.arange(len(named)), count), at.ravel()] = True
    return np.packbits(out, axis=1).view(U).reshape(len(named), -1)


def _candidates(t: tuple[int, int], sizes: np.ndarray, comp: np.ndarray, bits: np.ndarray, side: np.ndarray | None, earlier: np.ndarray):
    """For each entry i of a block, in order of size, the ones behind it that may be links by size and bitmap, lie in another component
    (comp may change meanwhile), on the other side (off the diagonal of the grid) and in no earlier list that both name."""
    reach = np.searchsorted(sizes * t[0], sizes * t[1], side="right")
    for i in range(len(sizes)):
        other = comp[i + 1 : reach[i]] != comp[i]
        if side is not None:
            other &= side[i + 1 : reach[i]] != side[i]
        j = i + 1 + np.flatnonzero(other)
        if len(j) and earlier.shape[1]:
            j = j[~(earlier[j] & earlier[i]).any(1)]
        if len(j):
            most = np.minimum(sizes[i] - np.bitwise_count(bits[i] & ~bits[j]).sum(1, dtype=np.int64), sizes[j] - np.bitwise_count(bits[j] & ~bits[i]).sum(1, dtype=np.int64))
            j = j[t[1] * most >= t[0] * (sizes[i] + sizes[j] - most)]
        if len(j):
            yield i, j


def _blocks(batches, last: str):
    """(name of the cell, columns) of each block of entries sorted by list and block, in order of size; `last` is the column of bitmaps or sets."""
    columns = ("ka", "xa", "comp", "own", "named", last)

    def whole(cell, held):
        keys, sizes, comp, side, named, blobs = (sum(x, []) if k > 3 else np.concatenate(x) for k, x in enumerate(zip(*held, strict=True)))
        order = np.argsort(sizes, kind="stable")
        _, comp = np.unique(comp, axis=0, return_inverse=True)
        return cell, keys[order], sizes[order].astype(np.int64), comp.ravel()[order], side[order] if cell[1] != cell[2] else None, [named[k] for k in order], [blobs[k] for k in order]

    held, name = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("list", "x", "y")], 1)
        cut = np.append(np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]).any(1))), len(cell))
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if tuple(cell[lo].tolist()) != name:
                if held:
                    yield whole(name, held)
                held, name = [], tuple(cell[lo].tolist())
            ka, xa, comp, own, named, blob = (batch.column(c).slice(lo, hi - lo) for c in columns)
            lists, at = named.values.to_numpy(), named.offsets.to_pylist()
            held.append((_keys_of(ka), xa.to_numpy(), _keys_of(comp), own.to_numpy(), [lists[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], blob.to_pylist()))
    if held:
        yield whole(name, held)


def _may_link(t: tuple[int, int]):
    """The entries (list, x, y, ka) of each block that have a candidate in it."""

    def run(batches):
        for (name, x, y), keys, sizes, comp, side, named, blobs in _blocks(batches, "_ng_bits"):
            hit = np.zeros(len(keys), bool)
            if comp.any():
                for i, j in _candidates(t, sizes, comp, _folded(blobs), side, _earlier(named, name)):
                    if len(blobs[i]) > BITS // 8 or len(blobs[j[-1]]) > BITS // 8:  # folded bitmaps of long texts are full
                        j = j[[_bound(t, int(sizes[i]), int(sizes[k]), blobs[i], blobs[k]) for k in j.tolist()]]
                    if len(j):
                        hit[i] = hit[j] = True
            n = int(hit.sum())
            if n:
                yield pa.record_batch([pa.array([name] * n, pa.int64()), pa.array([x] * n, pa.int32()), pa.array([y] * n, pa.int32()), _binary(keys[hit].view(np.uint8).ravel(), 16)], names=["list", "x", "y", "ka"])

    return run


def _linked(t: tuple[int, int]):
    """Links (src, dst) between the entries of each block, as many as join its components. Shingles of a block are numbered; those of
    an entry are marked and looked up for its candidates, a few at first, as a link to a component settles all others in it."""

    def links(sizes, comp, bits, side, earlier, values, first):
        mark = np.zeros(int(values.max()) + 1, bool)
        for i, j in _candidates(t, sizes, comp, bits, side, earlier):
            mine, step = values[first[i] : first[i + 1]], 8
            mark[mine] = True
            while len(j):
                some, j = j[:step], j[step:]
                both = np.add.reduceat(mark[values[ranges(first[some], sizes[some])]], np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
                for k in some[t[1] * both >= t[0] * (sizes[i] + sizes[some] - both)].tolist():
                    if comp[k] != comp[i]:
                        yield i, k
                        comp[comp == comp[k]] = comp[i]
                j, step = j[comp[j] != comp[i]], min(2 * step, max(8, CHUNK // int(sizes[i])))
            mark[mine] = False

    def run(batches):
        for (name, _, _), keys, _, comp, side, named, blobs in _blocks(batches, "_ng_set"):
            sets = [np.frombuffer(b, U) for b in blobs]
            sizes = np.array([len(x) for x in sets])
            first, all_values = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(sets)
            bits = np.zeros((len(sets), BITS), bool)
            bits[np.repeat(np.arange(len(sets)), sizes), (all_values >> U(8)).astype(np.int64) & (BITS - 1)] = True
            bits = np.packbits(bits, axis=1, bitorder="little").view(U)
            values = np.unique(all_values, return_inverse=True)[1].ravel()
            found = np.array(list(links(sizes, comp, bits, side, _earlier(named, name), values, first)), np.int64).reshape(-1, 2)
            if len(found):
                yield pa.record_batch([_binary(keys[found[:, c]].view(np.uint8).ravel(), 16) for c in (0, 1)], names=["src", "dst"])

    return run


# ---------------------------------------------------------------- the operator


def _identified(docs: DataFrame, text: str) -> DataFrame:
    """docs with two hashes of the text, which name a row's text without Python."""
    return docs.withColumns({"_ng_a": F.xxhash64(F.lit(17), F.col(text)), "_ng_b": F.xxhash64(F.lit(71), F.col(text))})


def _grid(entries: DataFrame, comp: DataFrame) -> DataFrame:
    """Entries (list, ka, xa) of lists that lie in several components, dealt out to the blocks of their lists: a list is cut by hash
    into stripes of about BLOCK entries and STRIPE shingles, and a block (x, y) holds the stripes x and y. `named`: the entry's NAMED smallest of these lists, in order."""
    total = entries.count()
    labelled = written(entries.join(comp.withColumnRenamed("node", "ka"), "ka", "left").select("list", "ka", "xa", F.coalesce("component", "ka").alias("comp")))
    spread = labelled.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), F.sum(F.col("xa").cast("long")).alias("w")).where("lo <> hi").select("list", "m", "w")
    known = written(met(labelled, spread, "list", "m", max(total, 1)))
    dropped(labelled)
    named = known.groupBy("ka").agg(F.slice(F.array_sort(F.collect_set("list")), 1, NAMED).alias("named"))
    stripes = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("w") / STRIPE)).cast("int")
    striped = known.join(named, "ka").withColumn("own", F.pmod(F.xxhash64("ka"), stripes).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), stripes - 1)))
    return striped.select("list", "ka", "xa", "comp", "named", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))


def _across(docs: DataFrame, text: str, n: int, entries: DataFrame, comp: DataFrame, bits: DataFrame, t: tuple[int, int], parts: int, have: list[DataFrame]) -> DataFrame | None:
    """Links (src, dst) that join components which meet in long lists."""
    grid = written(_grid(entries, comp))

    def dealt(rows):
        return rows.repartition(parts, "list", "x", "y").sortWithinPartitions("list", "x", "y")

    maps = bits.select(F.col("_ng_key").alias("ka"), "_ng_bits")
    near = written(dealt(grid.join(maps, "ka")).mapInArrow(_may_link(t), "list long, x int, y int, ka binary"))
    sets = None if near.isEmpty() else _with_sets(docs, text, n, near.select("ka"), have)
    if sets is None:
        return None
    rows = grid.join(near, ["list", "x", "y", "ka"], "left_semi").join(sets.withColumnRenamed("_ng_key", "ka"), "ka")
    out = written(dealt(rows).mapInArrow(_linked(t), "src binary, dst binary"))
    dropped(grid), dropped(near)
    return out


def _classes(docs: DataFrame, text: str, id_col: str, n: int, t: tuple[int, int], small: int):
    """(profile rows, component of each class that has links)."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    size = text_total(docs, text)
    parts = shuffle_parts(spark, size)
    cells = cells_for(size)
    profile = written(_identified(docs.select(id_col, text), text).mapInArrow(_profile(text, id_col, n, cells), f"`{id_col}` {id_type}, {_PROFILE}"))
    classes = spark.sparkContext.broadcast(size_classes(profile.where("_ng_slice is not null").select("_ng_slice", "_ng_counts"), cells))
    lists = docs.select(text).mapInArrow(_short_lists(text, n, t, parts, classes), "part int, n long, blob binary")
    merged = written(lists.repartition(parts, "part").mapInArrow(_merge(t, small), _PAIR))
    classes.destroy()
    pairs = written(merged.where("kb is not null").groupBy("ka", "kb").agg(F.sum(F.col("n").cast("long")).alias("n")))
    entries = merged.where("kb is null")
    unseen = entries.groupBy("ka").agg(F.sum(F.col("n").cast("long")).alias("_ng_long"))
    entries = written(entries.dropDuplicates(["list", "ka"]).select("list", "ka", "xa"))
    # what is known of the documents that are in a pair or a long list
    found = pairs.select(F.col("ka").alias("_ng_key")).unionByName(pairs.select(F.col("kb").alias("_ng_key"))).unionByName(entries.select(F.col("ka").alias("_ng_key"))).distinct()
    bits = profile.where("_ng_bits is not null").select("_ng_key", "_ng_bits", "n_shingles").join(found, "_ng_key", "left_semi")
    bits = bits.groupBy("_ng_key").agg(F.first("_ng_bits").alias("_ng_bits"), F.first("n_shingles").alias("n_shingles"))
    bits = written(bits.join(unseen.withColumnRenamed("ka", "_ng_key"), "_ng_key", "left").withColumn("_ng_long", F.coalesce("_ng_long", F.lit(0))))
    dropped(merged)
    sets: list[DataFrame] = []
    comp = components(_verified(docs, text, n, pairs, bits, t, sets))
    late = None if entries.isEmpty() else _across(docs, text, n, entries, comp, bits, t, parts, sets)
    if late is not None and not late.isEmpty():
        # the components so far stand for their links
        comp = components(comp.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(late))
    for table in (bits, entries, *sets):
        dropped(table)
    return profile.where("_ng_slice is null").drop("_ng_bits", "_ng_slice", "_ng_counts"), comp


def _named(members: DataFrame, comp: DataFrame, low) -> DataFrame:
    """members (rows of the profile) with _ng_low: the least `low` of all rows in the component; null without words."""
    rows = members.where("_ng_key is not null")
    total = rows.count()
    ids = rows.groupBy("_ng_key").agg(F.min(low).alias("_ng_own"), F.count("*").alias("_ng_n"))
    roots = written(ids.join(comp.withColumnRenamed("node", "_ng_key"), "_ng_key", "left").withColumn("_ng_root", F.coalesce("component", "_ng_key")).drop("component"))
    least = roots.groupBy("_ng_root").agg(F.min("_ng_own").alias("_ng_low"), F.count("*").alias("_ng_m"))
    names = written(met(roots, least, "_ng_root", "_ng_m", max(total, 1)).select("_ng_key", "_ng_n", "_ng_low"))
    dropped(roots)
    return met(members, names, "_ng_key", "_ng_n", max(total, 1), "left").drop("_ng_n")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", n: int = 5, threshold: tuple[int, int] = (75, 100), small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable over links of similarity threshold or more) of every row."""
    members, comp = _classes(docs, text, id_col, n, threshold, small)
    named = _named(members, comp, F.col(id_col))
    return named.select(id_col, "n_shingles", F.coalesce("_ng_low", id_col).alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id", n: int = 5, threshold: tuple[int, int] = (75, 100), small: int = SMALL) -> DataFrame:
    """docs without near copies: one row of each component stays, that of the smallest id (rows without id come last; of one id, by
    a hash of the text), as do rows without words. Of equal ids only the row meant goes; of equal rows one stays."""
    members, comp = _classes(docs, text, id_col, n, threshold, small)
    row = F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).alias("i"), F.col("_ng_a").alias("a"), F.col("_ng_b").alias("b"))
    named = _named(members, comp, row).where("_ng_key is not null")
    judged = named.groupBy(id_col, "_ng_a", "_ng_b").agg(F.count("*").alias("_ng_rows"), F.min(row == F.col("_ng_low")).alias("_ng_stays"))
    # rows to look at again: those that go, and those that stay but once
    again = written(judged.where("NOT _ng_stays OR _ng_rows > 1").select(F.col(id_col).alias("_ng_id"), "_ng_a", "_ng_b", "_ng_stays"))
    keyed = _identified(docs, text)
    bloom = docs.sparkSession.sparkContext.broadcast(bloom_of(again.select("_ng_a", "_ng_b"), lambda x: np.stack([x.column(0).to_numpy(), x.column(1).to_numpy()], 1).view(U)))
    marked = keyed.withColumn("_ng_maybe", maybe_in(bloom, "_ng_a", "_ng_b"))
    same = marked["_ng_a"] == again["_ng_a"]
    known = marked.where("_ng_maybe").join(again, same & (marked["_ng_b"] == again["_ng_b"]) & marked[id_col].eqNullSafe(again["_ng_id"]), "left").drop(again["_ng_a"]).drop(again["_ng_b"])
    once = known.where("_ng_stays").dropDuplicates([id_col, "_ng_a", "_ng_b"])
    stay = known.where("_ng_stays IS NULL").unionByName(once).unionByName(marked.where("NOT _ng_maybe").withColumns({"_ng_id": F.lit(None).cast(docs.schema[id_col].dataType), "_ng_stays": F.lit(None).cast("boolean")}))
    return stay.select(*docs.columns)
