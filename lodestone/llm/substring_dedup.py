"""Substring dedup by super-k-mer partitioning.

A window is `window` consecutive words of one document. Each window belongs to its minimiser: the smallest hash among
its runs of `gram` words, where runs that are frequent in the corpus (by counts of all texts in a hashed table of fixed size) come
behind all others. So a phrase that is common in many contexts is the minimiser of few windows, and no bucket is hot. Consecutive windows of a document that share the minimiser are one super-k-mer, which travels
once, as a packed string, to the bucket of that minimiser. Equal windows have equal minimisers, so every bucket counts
its windows alone, by sorting them. A word is removed if any window that covers it starts more than once.

Copies are combined before the shuffle: of the equal super-k-mers of a map chunk one is sent, marked as repeated, and the
chunk itself gives the spans of all of them. A passage in a third of all rows thus reaches its bucket once a chunk.

Defined cases: null text has no words; texts under `window` words lose nothing; repeated rows (equal id and text) get
equal results; extra columns are kept by `remove_repeats` (internal names start with `_sk_`); an empty table gives an
empty result. Word identity rests on 64-bit hashes; windows with equal hashes are compared word by word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    _BASE, _INVERSE, U, Words, bloom_of, bounded_batches, cell_slices, cells_for, chunks, gram_hashes, maybe_in, mix, powers, ranges, ranked_by_class, shuffle_parts, size_classes,
    text_bytes, text_total, trimmed, written,
)

CHUNK = 4_000_000
#: A bucket is counted in so many parts, one after the other.
SUB = 4
_SPANS = pa.schema([("_sk_a", pa.int64()), ("_sk_b", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])
_PACKS = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("n", pa.int64()), ("blob", pa.binary())])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _gram_counts(text: str, gram: int, cells: int):
    def run(batches):
        total = np.zeros(cells, np.uint32)
        some = False
        for table in chunks(batches, text, CHUNK):
            words = Words(*text_bytes(table[text]))
            if len(words.hashes) >= gram:
                total += np.bincount((gram_hashes(words.hashes, gram, 5) & U(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint32)
                some = True
        if some:
            parts = cell_slices(total)
            yield pa.record_batch([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["k", "b"])

    return run


def _super_kmers(words: Words, window: int, gram: int, classes: np.ndarray):
    """First word, number of windows, document row and minimiser of each super-k-mer."""
    n = len(words.hashes)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, np.zeros(0, U)
    low = _sliding_min(ranked_by_class(gram_hashes(words.hashes, gram, 5), classes), window - gram + 1)
    count = np.maximum(words.counts - window + 1, 0)
    at = ranges(words.first[:-1], count)
    if not len(at):
        return none, none, none, np.zeros(0, U)
    row = np.repeat(np.arange(len(count)), count)
    low = low[at]
    head = np.ones(len(at), bool)
    head[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(head)
    return at[head], np.diff(np.append(head, len(at))), row[head], low[head]


def _pack(arrays: list[np.ndarray], tail: bytes = b"") -> bytes:
    head = np.array([len(arrays)] + [a.nbytes for a in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(a.tobytes() for a in arrays) + tail)


def _unpack(blob: bytes, types) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(types) + 1)
    at, out = sizes.nbytes, []
    for t, size in zip(types, sizes[1:], strict=True):
        out.append(np.frombuffer(raw, t, int(size) // np.dtype(t).itemsize, at))
        at += int(size)
    return out, raw[at:]


def _map(window: int, gram: int, parts: int, text: str, classes):
    def run(batches):
        for table in chunks(batches, text, CHUNK):
            data, off = text_bytes(table[text])
            words = Words(data, off)
            first, count, row, low = _super_kmers(words, window, gram, classes.value)
            if not len(first):
                continue
            a, b = (table[c].to_numpy().astype(np.int64) for c in ("_sk_a", "_sk_b"))
            # equal super-k-mers of the chunk: same words, so same hash of all their words
            size = count + window - 1
            c = np.zeros(len(words.hashes) + 1, U)
            with np.errstate(over="ignore"):
                np.cumsum(words.hashes * powers(_BASE, len(words.hashes)), out=c[1:])
                same = mix((c[first + size] - c[first]) * powers(_INVERSE, len(c))[first] + mix(size.astype(U)))
            order = np.argsort(same, kind="stable")
            run_head = np.ones(len(order), bool)
            run_head[1:] = same[order[1:]] != same[order[:-1]]
            group = np.cumsum(run_head) - 1
            heads = order[run_head]
            rep = heads[group]
            for j in np.flatnonzero(rep != order):  # word by word; a clash of hashes makes its row a group of its own
                x, y = order[j], rep[j]
                if size[x] != size[y] or not np.array_equal(words.hashes[first[x] : first[x] + size[x]], words.hashes[first[y] : first[y] + size[y]]):
                    rep[j] = x
            copies = np.bincount(rep, minlength=len(order))
            twice = copies > 1
            sent = np.flatnonzero(copies > 0)
            local = order[twice[rep]]
            if len(local):
                start = (first[local] - words.first[row[local]]).astype(np.int32)
                spans = _merge(row[local], start, start + size[local].astype(np.int32))
                yield pa.record_batch([pa.array([int(first[local[0]] * 7919 % parts)], pa.int32()), pa.array([0], pa.int8()), pa.array([len(spans[0])], pa.int64()), pa.array([_pack([a[spans[0]], b[spans[0]], spans[1], spans[2]])], pa.binary())], schema=_PACKS)
            bucket = (mix(low[sent]) % U(parts * SUB)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            sent, part, sub = sent[order], bucket[order] // SUB, (bucket[order] % SUB).astype(np.uint8)
            view = data.tobytes()
            s, e = words.starts[first[sent]], words.ends[first[sent] + size[sent] - 1]
            at = (first[sent] - words.first[row[sent]]).astype(np.int32)
            cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
            out = []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                text_part = b"\n".join([view[x:y] for x, y in zip(s[lo:hi].tolist(), e[lo:hi].tolist(), strict=True)])
                pick = sent[lo:hi]
                docs, doc = np.unique(row[pick], return_inverse=True)
                out.append((int(part[lo]), hi - lo, _pack([a[docs], b[docs], doc.astype(np.int32), at[lo:hi], count[pick].astype(np.int32), twice[pick].astype(np.uint8), sub[lo:hi], (e[lo:hi] - s[lo:hi]).astype(np.int32)], text_part)))
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int32()), pa.array([1] * len(out), pa.int8()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], schema=_PACKS)

    return run


_PACKED = (np.int64, np.int64, np.int32, np.int32, np.int32, np.uint8, np.uint8, np.int32)


def _merge(row: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Union of the spans of each row, as (row, start, end), where touching spans join."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order].astype(np.int64), end[order].astype(np.int64)
    lift = (row - (row.min() if len(row) else 0)).astype(np.int64) << 32  # rows apart, so one running maximum serves all
    reach = np.maximum.accumulate(end + lift)
    head = np.ones(len(row), bool)
    head[1:] = (start + lift)[1:] > reach[:-1]
    last = np.append(np.flatnonzero(head)[1:] - 1, len(row) - 1) if len(row) else np.zeros(0, np.int64)
    return row[head], start[head].astype(np.int32), (reach[last] - lift[last]).astype(np.int32)


def _reduce(window: int):
    def run(batches):
        held = []
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
                if kind:
                    held.append(blob.as_py())
                else:
                    (a, b, s, e), _ = _unpack(blob.as_py(), (np.int64, np.int64, np.int32, np.int32))
                    yield pa.record_batch([a, b, s, e], schema=_SPANS)
        opened = [_unpack(blob, _PACKED) for blob in held]
        held.clear()
        for sub in range(SUB):
            a, b, docs, ats, counts, twices, hashes, base = [], [], [], [], [], [], [], 0
            for (ka, kb, doc, at, count, twice, of, length), raw in opened:
                lo, hi = np.searchsorted(of, [sub, sub + 1])
                if lo == hi:
                    continue
                edge = np.concatenate([[0], np.cumsum(length + 1)])
                w = Words(np.frombuffer(raw, np.uint8)[edge[lo] : edge[hi] - 1], np.array([0, edge[hi] - 1 - edge[lo]]))
                a.append(ka), b.append(kb), docs.append(doc[lo:hi] + base), ats.append(at[lo:hi]), counts.append(count[lo:hi]), twices.append(twice[lo:hi]), hashes.append(w.hashes)
                base += len(ka)
            trimmed()
            if docs:
                yield from _repeats(window, *(np.concatenate(x) for x in (a, b, docs, ats, counts, twices, hashes)))

    return run


def _repeats(window: int, a, b, doc, at, count, twice, h):
    """Spans of the windows of one bucket that start more than once."""
    size = count.astype(np.int64) + window - 1
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    where = ranges(first, count.astype(np.int64))
    owner = np.repeat(np.arange(len(count)), count)
    key = gram_hashes(h, window, 9)[where]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.ones(len(order), bool)
    head[1:] = sorted_key[1:] != sorted_key[:-1]
    cut = np.flatnonzero(head)
    many = np.diff(np.append(cut, len(order)))
    group = np.repeat(np.arange(len(cut)), many)
    weight = np.add.reduceat((1 + twice[owner[order]]).astype(np.int64), cut)
    hit_group = weight > 1
    checked = np.flatnonzero((many > 1)[group] & ~head)  # equal hashes: compare with the group's first, word by word
    bad = np.zeros(len(cut), bool)
    lead = where[order[cut[group[checked]]]]
    mine = where[order[checked]]
    differ = np.zeros(len(checked), bool)
    for j in range(window):
        differ |= h[lead + j] != h[mine + j]
    bad[group[checked[differ]]] = True
    hit = np.zeros(len(order), bool)
    hit[order] = hit_group[group]
    for g in np.flatnonzero(bad):  # a clash of window hashes: count by the words themselves
        members = order[cut[g] : cut[g] + many[g]]
        seen: dict[bytes, int] = {}
        names = [h[where[m] : where[m] + window].tobytes() for m in members]
        for m, name in zip(members, names, strict=True):
            seen[name] = seen.get(name, 0) + 1 + int(twice[owner[m]])
        hit[members] = [seen[name] > 1 for name in names]
    hit &= twice[owner] == 0  # the map side gave the spans of marked ones
    hit = np.flatnonzero(hit)
    if len(hit):
        s = at[owner[hit]] + (where[hit] - first[owner[hit]])
        row, s, e = _merge(doc[owner[hit]], s, s + window)
        for lo in range(0, len(row), 1 << 18):
            cutout = slice(lo, lo + (1 << 18))
            yield pa.record_batch([a[row[cutout]], b[row[cutout]], s[cutout], e[cutout]], schema=_SPANS)


def repeated_spans(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = 35, gram: int = 5) -> DataFrame:
    """docs with all its columns and `_sk_spans`, array<struct<s,e>>: word ranges to remove, not merged across buckets.

    Only rows that may have spans (by a filter of fixed size over their keys) are dealt out again to meet them.
    """
    spark = docs.sparkSession
    size = text_total(docs, text)
    parts, cells = shuffle_parts(spark, size), cells_for(size)
    bounded_batches(spark)
    classes = spark.sparkContext.broadcast(size_classes(docs.select(text).mapInArrow(_gram_counts(text, gram, cells), "k int, b binary"), cells))
    keyed = docs.withColumns({n: F.xxhash64(F.lit(k), F.col(id_col), F.col(text)) for k, n in ((17, "_sk_a"), (71, "_sk_b"))})
    packs = keyed.select("_sk_a", "_sk_b", text).mapInArrow(_map(window, gram, parts, text, classes), "part int, kind byte, n long, blob binary")
    spans = written(packs.repartition(parts, "part").mapInArrow(_reduce(window), "_sk_a long, _sk_b long, s int, e int"))
    classes.destroy()
    bloom = spark.sparkContext.broadcast(bloom_of(spans.select("_sk_a", "_sk_b"), lambda x: np.stack([x.column(0).to_numpy(), x.column(1).to_numpy()], 1).view(U)))

    grouped = spans.groupBy("_sk_a", "_sk_b").agg(F.collect_list(F.struct("s", "e")).alias("_sk_spans"))
    marked = keyed.withColumn("_sk_maybe", maybe_in(bloom, "_sk_a", "_sk_b"))
    kind = grouped.schema["_sk_spans"].dataType
    met = marked.where("_sk_maybe").join(grouped, ["_sk_a", "_sk_b"], "left")
    rest = marked.where("not _sk_maybe").withColumn("_sk_spans", F.lit(None).cast(kind))
    return met.unionByName(rest).drop("_sk_a", "_sk_b", "_sk_maybe")


def kept_pieces(raw: bytes, spans) -> tuple[int, int, list[bytes]]:
    """Number of words, number removed, kept words."""
    words = raw.split()
    if not spans:
        return len(words), 0, words
    keep, at, removed = [], 0, 0
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if e <= at:
            continue
        s = max(s, at)
        keep += words[at:s]
        removed += e - s
        at = e
    return len(words), removed, keep + words[at:]


def _digest(text: str, id_col: str, id_type):
    def run(batches):
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for t, spans in zip(batch.column(text), batch.column("_sk_spans"), strict=True):
                n, removed, keep = kept_pieces((t.as_py() or "").encode(), spans.as_py())
                out[0].append(n), out[1].append(removed), out[2].append(hashlib.sha256(b" ".join(keep)).hexdigest())
            yield pa.record_batch([batch.column(id_col), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=[id_col, "n_words", "n_removed", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = 35, gram: int = 5) -> DataFrame:
    """docs with `text` replaced by its kept words joined by one space, and n_removed."""
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.drop("n_removed")
    schema = docs.schema
    target = to_arrow_schema(schema).append(pa.field("n_removed", pa.int64()))

    def run(batches):
        for batch in batches:
            kept, gone = [], []
            for t, spans in zip(batch.column(text), batch.column("_sk_spans"), strict=True):
                n, removed, keep = kept_pieces((t.as_py() or "").encode(), spans.as_py())
                kept.append(t.as_py() if t.as_py() is None else b" ".join(keep).decode())
                gone.append(removed)
            cols = [pa.array(kept, pa.string()) if f.name == text else batch.column(f.name) for f in schema.fields]
            yield pa.record_batch([*[c.cast(target.field(i).type) for i, c in enumerate(cols)], pa.array(gone, pa.int64())], names=target.names)

    spans = repeated_spans(docs, text, id_col, window, gram)
    return spans.mapInArrow(run, _with(schema, "n_removed long"))


def _with(schema, ddl: str):
    from pyspark.sql.types import StructType

    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def repeat_digests(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = 35, gram: int = 5) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    spans = repeated_spans(docs.select(id_col, text), text, id_col, window, gram).select(id_col, text, "_sk_spans")
    kind = docs.schema[id_col].dataType.simpleString()
    return spans.mapInArrow(_digest(text, id_col, kind), f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string")
