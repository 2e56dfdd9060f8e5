"""Supervised subword embeddings: hashed vectors of words and character n-grams, averaged per document, under a softmax.

The features of a word are itself and its byte n-grams (with its ends marked), each hashed to a row of a table. A document is
the mean of the rows of all features of all its words; a linear layer and softmax give class probabilities. All of it is
trained by mini-batch gradient descent (Adagrad steps) in numpy, on a bounded number of labelled rows. As the mean and the
layer are both linear, scoring needs only one number a class for each row of the table.

A text without words has the bias alone. Whole texts are scored, in chunks.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import U, WHITE, Words, mix, ranges, text_bytes, trimmed

GRAMS = (2, 3, 4)
BUCKETS = 1 << 17
#: Bytes of text, distinct words, and words of rows that are looked at together; temporary arrays follow these, not the sample.
BLOCK, WORDS, TOKENS = 1 << 19, 1 << 13, 1 << 16


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the features of each word, back to back, and the number of each word's features."""
    size = ends - starts
    marked = size + 2
    base = np.concatenate([[0], np.cumsum(marked)])
    text = np.full(base[-1], 0x20, np.uint8)
    text[ranges(base[:-1] + 1, size)] = data[ranges(starts, size)]
    parts, counts = [hashes], [np.ones(len(size), np.int64)]
    for n in GRAMS:
        h = np.full(max(0, len(text) - n + 1), U(n), U)
        with np.errstate(over="ignore"):
            for j in range(n):
                h = h * U(0x100000001B3) + text[j : j + len(h)]
        count = np.maximum(marked - n + 1, 0)
        parts.append(mix(h[ranges(base[:-1], count)]))
        counts.append(count)
    total = np.sum(counts, 0)
    first = np.concatenate([[0], np.cumsum(total)])[:-1]
    out = np.empty(int(total.sum()), np.int32)
    at = first
    for part, count in zip(parts, counts, strict=True):
        out[ranges(at, count)] = (part % U(BUCKETS)).astype(np.int32)
        at = at + count
    return out, total


def _cuts(offsets: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of rows of about `limit` units (at least one row each)."""
    out, at = [], 0
    while at < len(offsets) - 1:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        out.append((at, stop))
        at = stop
    return out


def vocabulary(column) -> tuple:
    """Words of a chunk: (features, features a word, word number of each token, row of each token, rows). Words are numbered in order of their hash."""
    data, off = text_bytes(column)
    rows = len(off) - 1
    hashes, starts, ends, tokens, counts = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)]
    for lo, hi in _cuts(off, BLOCK):
        words = Words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], WHITE)
        own, at, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        hashes.append(own), starts.append(words.starts[at] + off[lo]), ends.append(words.ends[at] + off[lo])
        tokens.append(inverse.ravel().astype(np.int32)), counts.append(words.counts)
    own, at, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    starts, ends = np.concatenate(starts)[at], np.concatenate(ends)[at]
    first = np.cumsum([len(x) for x in hashes])
    inverse = inverse.ravel().astype(np.int32)
    word = np.concatenate([np.zeros(0, np.int32), *(inverse[first[k] : first[k + 1]][x] for k, x in enumerate(tokens))])
    parts = [word_features(data, starts[lo : lo + WORDS], ends[lo : lo + WORDS], own[lo : lo + WORDS]) for lo in range(0, max(1, len(own)), WORDS)]
    features, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    return features, count, word, np.repeat(np.arange(rows, dtype=np.int32), np.concatenate(counts)), rows


def _tallied(row: np.ndarray, word: np.ndarray, rows: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens as (row, word, times), in order; `row` ascends."""
    out = [(np.zeros(0, np.int32),) * 3]
    edge = np.searchsorted(row, np.arange(rows + 1))
    for lo, hi in _cuts(edge, TOKENS):
        pair, times = np.unique(row[edge[lo] : edge[hi]].astype(np.int64) * (words + 1) + word[edge[lo] : edge[hi]], return_counts=True)
        out.append(((pair // (words + 1)).astype(np.int32), (pair % (words + 1)).astype(np.int32), times.astype(np.int32)))
    row, word, times = (np.concatenate(x) for x in zip(*out, strict=True))
    return row, word, times


def _by_word(values: np.ndarray, features: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sum of the rows of each word's features."""
    if not len(count):
        return np.zeros((0, values.shape[1]), values.dtype)
    return np.add.reduceat(values[features], np.concatenate([[0], np.cumsum(count)[:-1]]))


class Model:
    """table: a number for each bucket and class; bias: one a class."""

    def __init__(self, table: np.ndarray, bias: np.ndarray):
        self.table, self.bias = table, bias

    def probabilities(self, column) -> np.ndarray:
        features, count, word, row, rows = vocabulary(column)
        sums = _by_word(self.table, features, count)
        total = np.maximum(np.bincount(row, count[word], rows), 1)
        z = np.stack([np.bincount(row, sums[word, k], rows) / total for k in range(len(self.bias))], 1) + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(texts, labels: np.ndarray, classes: int, dims: int = 8, epochs: int = 6, rate: float = 0.3, batch: int = 64, seed: int = 1) -> Model:
    """Texts (an Arrow string column) and class numbers. Without texts: equal probabilities."""
    rng = np.random.default_rng(seed)
    if not len(labels):
        return Model(np.zeros((BUCKETS, classes), np.float32), np.zeros(classes))
    features, count, word, row, rows = vocabulary(texts)
    first = np.concatenate([[0], np.cumsum(count)])
    row, word, times = _tallied(row, word, rows, len(count))
    edge = np.searchsorted(row, np.arange(rows + 1))
    total = np.maximum(np.bincount(row, times * count[word], rows), 1)
    table = rng.uniform(-1 / dims, 1 / dims, (BUCKETS, dims)).astype(np.float32)
    weight, bias = np.zeros((dims, classes)), np.log(np.bincount(labels, minlength=classes) + 1.0)
    bias -= bias.mean()
    g_table, g_weight, g_bias = np.full(BUCKETS, 1e-6, np.float32), 1e-6, 1e-6
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(rows)
        for lo in range(0, rows, batch):
            docs = order[lo : lo + batch]
            n = edge[docs + 1] - edge[docs]
            at = ranges(edge[docs], n)
            local = np.repeat(np.arange(len(docs)), n)
            used, inverse = np.unique(word[at], return_inverse=True)
            f = features[ranges(first[used], count[used])]
            vectors = _by_word(table, f, count[used])
            share = times[at] / total[docs][local]
            mean = np.stack([np.bincount(local, share * vectors[inverse, k], len(docs)) for k in range(dims)], 1)
            z = mean @ weight + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(docs)), labels[docs]] -= 1
            d_mean, d_weight, d_bias = p @ weight.T, mean.T @ p / len(docs), p.mean(0)
            g_weight, g_bias = g_weight + d_weight**2, g_bias + d_bias**2
            weight -= step * d_weight / np.sqrt(g_weight)
            bias -= 0.1 * step * d_bias / np.sqrt(g_bias)
            d_word = np.stack([np.bincount(inverse, share * d_mean[local, k], len(used)) for k in range(dims)], 1)
            owner = np.repeat(np.arange(len(used)), count[used])
            grad = np.stack([np.bincount(f, d_word[owner, k], BUCKETS) for k in range(dims)], 1).astype(np.float32) / len(docs)
            g_table += (grad**2).mean(1)
            table -= step * grad / np.sqrt(g_table)[:, None]
    del features, count, first, word, row, times, edge
    trimmed()  # the driver goes on for long
    return Model((table @ weight).astype(np.float32), bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, id_col: str = "doc_id", text: str = "text", max_bytes: int = 8_000_000, least: int = 100, classes: int = 8):
    """At most `most` labelled rows of docs and about `max_bytes` of their whole texts, in order of a hash of id: (texts, class numbers).

    A row that doesn't fit any more is passed over, not the end of the sample; a class with fewer than `least` rows in the sample
    gets its next ones. `labels` has id_col and a class number `label` below `classes` (others count as none); ids with several
    labels take the largest one. What the driver holds is bounded by these numbers, whatever the tables.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col("label").between(0, classes - 1)).groupBy(F.col(id_col).alias("i")).agg(F.max("label").alias("label"))
    a = F.xxhash64(F.lit(19), F.col(text))
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("i"), a.alias("a"), F.octet_length(text).alias("size"))
    rows = rows.join(marks, "i").select("i", "a", "size", "label", F.xxhash64("i", F.lit(11)).alias("h")).distinct()
    by_class = Window.partitionBy("label").orderBy("h", "i", "a")
    found = rows.withColumn("r", F.row_number().over(by_class)).where(F.col("r") <= most).orderBy("h", "i", "a").limit(2 * most).collect()
    chosen, held, n = [], 0, Counter()
    for r in found:
        if len(chosen) < most and held + r.size <= max_bytes:
            chosen.append(r)
            held += r.size
            n[r.label] += 1
    taken = {(r.i, r.a) for r in chosen}
    for r in found:
        if (r.i, r.a) not in taken and n[r.label] < least and r.size <= max_bytes // least:
            chosen.append(r)
            n[r.label] += 1
    if not chosen:
        return pa.chunked_array([pa.array([], pa.string())]), np.zeros(0, np.int64)
    pick = docs.sparkSession.createDataFrame([(r.i, r.a, r.label, r.h) for r in chosen], StructType([StructField("i", docs.schema[id_col].dataType), *StructType.fromDDL("a long, label long, h long").fields]))
    texts = docs.select(F.col(id_col).alias("i"), a.alias("a"), F.col(text).alias("t")).join(F.broadcast(pick), ["i", "a"]).dropDuplicates(["i", "a"])
    got = sorted(texts.select("h", "i", "a", "t", "label").collect(), key=lambda r: (r.h, r.i, r.a))
    return pa.chunked_array([pa.array([r.t for r in got], pa.string())]), np.array([r.label for r in got], np.int64)
