"""Benchmark decontamination with an FM-index of each training shard.

A shard is a chunk of whole texts. Its words become symbols of the phrases' vocabulary; every other word is one separator
symbol, and stretches between separators that are shorter than the shortest phrase hold no phrase and aren't indexed.
The shard's index is the Burrows-Wheeler transform of the symbols in a wavelet matrix, with suffix positions sampled. All phrases are searched backwards
together, a word a step; occurrences walk to the next sampled position; spans of hits are merged per document.

A phrase is `window` consecutive words of an item, or all words of a shorter item. Texts stay whole within a shard, so the
map side gives final rows and nothing is shuffled. Items come in blocks of bounded size, each broadcast by itself, and a pass over
the documents takes so many blocks; a benchmark beyond that takes more passes, with the rows written between them.

Defined cases: null text or item has no words and no hits; repeated rows are judged each. Item ids are of any type with an order;
rows of items with the same id are one item. The words of an item without id are hit like others, but it has no place in the list of
items. Extra columns are kept by `contamination` (its outputs replace columns of their names); empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType

from .common import NOT_ALNUM, U, Words, bounded_batches, chunks, dropped, ranges, text_bytes, written

CHUNK = 2_000_000


# ---------------------------------------------------------------- phrases


def phrases(item_ids: list, texts: list, window: int):
    """Sorted vocabulary (word hashes), distinct phrases as rows of symbols from 1 (0: none), the phrase of each owner, and owners' ids."""
    data, off = text_bytes(pa.chunked_array([pa.array(texts, pa.string())]))
    words = Words(data, off, NOT_ALNUM, lower=True)
    vocabulary = np.unique(words.hashes)
    symbols = np.searchsorted(vocabulary, words.hashes) + 1
    rows, owner = [], []
    for i, (s, e) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
        n = e - s
        for at in range(s, max(s + 1, e - window + 1)) if n else ():
            row = np.zeros(window, np.int32)
            row[: min(n, window)] = symbols[at : min(at + window, e)]
            rows.append(row)
            owner.append(i)
    if not rows:
        return vocabulary, np.zeros((0, window), np.int32), np.zeros(0, np.int64), []
    table, inverse = np.unique(np.array(rows), axis=0, return_inverse=True)
    return vocabulary, table, inverse.ravel(), [item_ids[i] for i in owner]


# ---------------------------------------------------------------- the index


class WaveletMatrix:
    """rank(symbol, i): occurrences of symbol before i, for arrays of symbols and positions."""

    def __init__(self, values: np.ndarray, bits: int):
        self.n, self.bits, self.rows, self.zeros = len(values), bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (values >> b) & 1
            self.rows.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(values) - self.rows[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(i), i
        for level, (row, zeros) in enumerate(zip(self.rows, self.zeros, strict=True)):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            lo = np.where(one, zeros + row[lo], lo - row[lo])
            hi = np.where(one, zeros + row[hi], hi - row[hi])
        return hi - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for row, zeros in zip(self.rows, self.zeros, strict=True):
            bit = row[i + 1] - row[i]
            out = out * 2 + bit
            i = np.where(bit == 1, zeros + row[i], i - row[i])
        return out


class FMIndex:
    """Over symbols from 1 to `separator`, which ends the text; every `sample`-th position and each stretch's first are kept."""

    def __init__(self, text: np.ndarray, separator: int, sample: int = 8):
        n = len(text)
        apart = text == separator
        rank = np.where(apart, separator + np.cumsum(apart), text)  # no two separators are equal: a true order of suffixes
        order, span = np.argsort(rank, kind="stable"), 1
        while True:  # doubling: each round, suffixes are sorted by twice as many symbols
            after = np.zeros(n, np.int64)
            after[: max(0, n - span)] = rank[span:] + 1
            key = rank * (int(rank.max()) + 2) + after
            order = np.argsort(key, kind="stable")
            change = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = change
            if change[-1] == n - 1 or span >= n:
                break
            span *= 2
        self.text_length = n
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=separator + 1))])
        self.wavelet = WaveletMatrix(text[order - 1], max(1, int(separator).bit_length()))
        marked = order % sample == 0
        head = np.append(True, apart[:-1])  # a walk never crosses a separator
        self.is_marked = marked | head[order]
        self.marks = np.concatenate([[0], np.cumsum(self.is_marked)])
        self.samples = order[self.is_marked]

    def search(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of each phrase (rows of symbols, 0 behind the end)."""
        lo, hi = np.zeros(len(table), np.int64), np.full(len(table), self.text_length, np.int64)
        for column in range(table.shape[1] - 1, -1, -1):
            c = table[:, column].astype(np.int64)
            on = np.flatnonzero((c > 0) & (lo < hi))
            lo[on] = self.first[c[on]] + self.wavelet.rank(c[on], lo[on])
            hi[on] = self.first[c[on]] + self.wavelet.rank(c[on], hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: steps back to the next sampled one."""
        out, steps, todo, at = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(todo):
            hit = self.is_marked[at]
            out[todo[hit]] = self.samples[self.marks[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            c = self.wavelet.access(at)
            at = self.first[c] + self.wavelet.rank(c, at)
            steps += 1
        return out


# ---------------------------------------------------------------- shards


def shard_hits(words: Words, block, window: int):
    """(row, word position, phrase) of each occurrence in a chunk of texts."""
    vocabulary, table, _, _ = block
    none = np.zeros(0, np.int64)
    if not len(table) or not len(words.hashes):
        return none, none, none
    at = np.searchsorted(vocabulary, words.hashes)
    at[at == len(vocabulary)] = 0
    symbol = np.where(vocabulary[at] == words.hashes, at + 1, 0)
    size = (table > 0).sum(1)
    row = np.repeat(np.arange(len(words.counts)), words.counts)
    known = symbol > 0
    head = known.copy()
    head[1:] &= ~known[:-1] | (row[1:] != row[:-1])
    start = np.flatnonzero(head)
    tail = known.copy()
    tail[:-1] &= ~known[1:] | (row[1:] != row[:-1])
    length = np.flatnonzero(tail) + 1 - start
    fit = length >= size.min()
    start, length = start[fit], length[fit]
    if not len(start):
        return none, none, none
    other = len(vocabulary) + 1  # the separator
    text = np.full(int(length.sum() + len(length)), other, np.int64)
    base = np.concatenate([[0], np.cumsum(length + 1)])[:-1]
    place, origin = ranges(base, length), ranges(start, length)
    text[place] = symbol[origin]
    where = np.zeros(len(text), np.int64)
    where[place] = origin
    index = FMIndex(text, other)
    lo, hi = index.search(table)
    count = hi - lo
    phrase = np.repeat(np.arange(len(table)), count)
    word = where[index.locate(ranges(lo, count))]
    return row[word], word - words.first[row[word]], phrase


def _judge(text: str, blocks: list, window: int, id_type: pa.DataType, finish=None):
    """Adds the hits of the blocks to n_words, hits and items; `finish` goes on with the batches in the same worker."""

    def run(batches):
        opened = None
        for table in chunks(batches, text, CHUNK):
            if opened is None:
                opened = []
                for block in (b.value for b in blocks):
                    owners: list[set] = [set() for _ in range(len(block[1]))]
                    for p, i in zip(block[2].tolist(), block[3], strict=True):
                        if i is not None:
                            owners[p].add(i)
                    opened.append((block, (block[1] > 0).sum(1), owners))
            data, off = text_bytes(table[text])
            words = Words(data, off, NOT_ALNUM, lower=True)
            spans = [[(x["s"], x["e"]) for x in h or ()] for h in table["hits"].to_pylist()]
            items = [set(x or ()) for x in table["items"].to_pylist()]
            for block, size, owners in opened:
                row, at, phrase = shard_hits(words, block, window)
                for r, s, p in zip(row.tolist(), at.tolist(), phrase.tolist(), strict=True):
                    spans[r].append((s, s + int(size[p])))
                    items[r] |= owners[p]
            merged = [[{"s": s, "e": e} for s, e in merge(x)] for x in spans]
            t = table.drop_columns(["n_words", "hits", "items"]).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(words.counts, pa.int64()), pa.array(merged, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array([sorted(x) for x in items], pa.list_(id_type))], [*t.schema.names, "n_words", "hits", "items"])

    return run if finish is None else lambda batches: finish(run(batches))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with n_words, hits (merged word spans) and items (ids of items with an occurring phrase); options as in `_passes`."""
    return _passes(docs, items, text, **options)


def _passes(docs: DataFrame, items: DataFrame, text: str, item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 4_000_000, pass_bytes: int = 64_000_000, finish=None, shape=None) -> DataFrame:
    """docs with their hits, or what `finish` makes of such batches, of schema `shape`.

    `items` is read through row by row, `block_bytes` of text to a block and `pass_bytes` to a pass over docs, so neither the
    driver nor a broadcast grows with the number of items.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = items.schema[item_id].dataType
    found = docs.drop("n_words", "hits", "items")
    found = found.withColumns({"n_words": F.lit(None).cast("long"), "hits": F.lit(None).cast("array<struct<s:int,e:int>>"), "items": F.lit(None).cast(ArrayType(kind))})
    blocks, done, last = [], False, None
    rows = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL").toLocalIterator()
    while not done:
        ids, texts, held = [], [], 0
        for r in rows:
            ids.append(r.i), texts.append(r.t)
            held += len(r.t.encode())
            if held >= block_bytes:
                break
        else:
            done = True
        blocks.append(spark.sparkContext.broadcast(phrases(ids, texts, window)))
        if done or len(blocks) * block_bytes >= pass_bytes:
            last_pass = done and finish is not None
            found = found.mapInArrow(_judge(text, blocks, window, to_arrow_type(kind), finish if last_pass else None), shape if last_pass else found.schema)
            if not done:
                found, before = written(found), last
                last = found
                for b in blocks:
                    b.destroy()
                blocks = []
                if before is not None:
                    dropped(before)
    return found


def contamination_digests(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    found = contamination(docs.select("doc_id", "text"), items, **options)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + (x["e"] - x["s"]))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without_hits(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with every hit word cut out of its text; texts without a hit are untouched, those with nothing left go."""
    columns, place = docs.columns, docs.columns.index(text)
    names = [f"_dc{i}" for i in range(len(columns))]
    shape = docs.toDF(*names).schema
    text = names[place]

    def run(batches):
        for batch in batches:
            data, off = text_bytes(batch.column(text))
            words = Words(data, off, NOT_ALNUM, hashes=False)
            out, keep = [], []
            for r, (t, hits) in enumerate(zip(batch.column(text), batch.column("hits").to_pylist(), strict=True)):
                if not hits:
                    out.append(t.as_py()), keep.append(True)
                    continue
                raw, base, f = t.as_py().encode(), off[r], words.first[r]
                pieces, at = [], 0
                for x in hits:
                    pieces.append(raw[at : words.starts[f + x["s"]] - base])
                    at = words.ends[f + x["e"] - 1] - base
                pieces.append(raw[at:])
                left = b"".join(pieces).decode().strip()
                out.append(left), keep.append(any(c.isalnum() for c in left))
            i = batch.schema.names.index(text)
            cols = [pa.array(out, batch.schema.types[i]) if k == i else batch.column(c) for k, c in enumerate(batch.schema.names)]
            kept = pa.RecordBatch.from_arrays(cols, batch.schema.names).filter(pa.array(keep, pa.bool_()))
            yield kept.select(names)

    return _passes(docs.toDF(*names), items, text, finish=run, shape=shape, **options).toDF(*columns)
