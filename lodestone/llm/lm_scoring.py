"""LM scoring by context-tree weighting over bytes.

A text is its words (ASCII lower case), each followed by a space, then an end byte. Every byte is eight binary decisions;
the contexts of a decision are the preceding 0 to `depth` bytes and the bits already known. Each context holds a
Krichevsky-Trofimov estimate; a node's weighted probability is half its own estimate plus half the product of its
children's (its last byte made longer), so the tree mixes all depths. Counts come from all training rows; they are summed in
buckets, and the tree is built from the sums: bottom up for the weights, top down for the prediction in each node. A context
that was not seen in training predicts with the longest one that was.

Every context counts, however rare: the tree is never gathered in one place. It is dealt out by the last TOP bytes of the context, so
a bucket holds whole subtrees. Buckets send up the sums that the nodes above them need (at most 256 * 255 of them, whatever
the corpus), the driver weights those nodes and hands down each one's share. To score, texts are packed in groups; each
group asks the buckets once for its distinct (context, byte) pairs, and texts and answers meet again by group. A group closes
when it has more than `max_contexts` distinct pairs or GROUP_BYTES of text: that bounds a task's memory and changes no score.

`base_score` is the add-half unigram score. Counts of the most frequent words (bounded) go to the map side; all other
words travel, packed, to the bucket that holds their count.

Defined cases: null text is empty: it has one token, the end. A null id counts as the empty string where rows are split.
Repeated rows are scored each. Extra columns are dropped by `score` (join by id to keep them). An empty table gives none.
Words are told apart by 64 bits of hash.
"""

from __future__ import annotations

import math
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Words, bounded_batches, chunks, dropped, ranges, shuffle_parts, text_bytes, text_total, trimmed, written
from .substring_dedup import _pack, _unpack

CHUNK = 4_000_000
#: Distinct words or (context, byte) pairs that a task holds before it hands their counts on.
FLUSH = 1_500_000
#: Bytes of text in one group.
GROUP_BYTES = 32_000_000
_END, _SPACE = 0x0A, 0x20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def stream(data: np.ndarray, words: Words, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows' bytes, each row after `depth` end bytes as its first context, and n_rows + 1 offsets."""
    size = words.ends - words.starts
    n = len(words.counts)
    per_row = np.concatenate([[0], np.cumsum(size + 1)])
    length = per_row[words.first[1:]] - per_row[words.first[:-1]] + depth + 1
    first = np.concatenate([[0], np.cumsum(length)])
    out = np.full(first[-1], _END, np.uint8)
    row = np.repeat(np.arange(n), words.counts)
    at = first[row] + depth + per_row[:-1] - per_row[words.first[:-1]][row]
    out[ranges(at, size)] = _LOWER[data[ranges(words.starts, size)]]
    out[at + size] = _SPACE
    return out, first


def gram_keys(text: np.ndarray, first: np.ndarray, depth: int) -> np.ndarray:
    """For each scored byte: it and its `depth` predecessors, latest in the low byte."""
    key = np.zeros(len(text) - depth, U)
    for j in range(depth + 1):
        key |= text[depth - j : len(text) - j].astype(U) << U(8 * j)
    count = np.diff(first) - depth
    return key[ranges(first[:-1], count)]


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        keys = np.sort(keys)
        head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return keys[head], np.diff(np.append(head, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], (np.add.reduceat(counts, head) if len(head) else counts)


class _Sums:
    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys, counts):
        self.parts.append((keys, counts))
        self.size += len(keys)
        if len(self.parts) > 1 and self.size > 3_000_000:
            self.parts = [self.all()]
            self.size = 2 * len(self.parts[0][0]) - 3_000_000 if len(self.parts[0][0]) > 3_000_000 else len(self.parts[0][0])

    def held(self) -> int:
        """Distinct keys of the tables summed so far, the first of which holds all but the latest."""
        return len(self.parts[0][0]) if self.parts else 0

    def all(self):
        if not self.parts:
            return np.zeros(0, U), np.zeros(0, np.int64)
        return _summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))


#: The tree is dealt out by this many of the last bytes of a context.
TOP = 2


def _deal(kind: int, keys: np.ndarray, parts: int, depth: int):
    """(part, sorted positions of its keys): words by their hash, grams by the subtree that they lie in."""
    by = keys if kind == 0 else (keys >> U(8)) & U((1 << (8 * min(TOP, depth))) - 1)
    with np.errstate(over="ignore"):
        part = ((by * U(0x9E3779B97F4A7C15)) >> U(33)) % U(parts)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    return [(p, order[cut[p] : cut[p + 1]]) for p in np.flatnonzero(np.diff(cut)).tolist()]


#: kind 0: words; kind 1: (context, byte) pairs of the full depth, whose sums give all others.
_COUNTS = "part int, kind int, blob binary"


def _count(text: str, depth: int, parts: int):
    def out(kind: int, sums: _Sums):
        keys, counts = sums.all()
        for p, at in _deal(kind, keys, parts, depth):
            yield pa.record_batch([pa.array([p], pa.int32()), pa.array([kind], pa.int32()), pa.array([_pack([keys[at], counts[at].astype(np.int64)])], pa.binary())], names=["part", "kind", "blob"])

    def run(batches):
        sums = [_Sums(), _Sums()]
        for table in chunks(batches, text, CHUNK):
            data, off = text_bytes(table[text])
            words = Words(data, off, lower=True)
            sums[0].add(*_summed(words.hashes))
            raw, first = stream(data, words, depth)
            sums[1].add(*_summed(gram_keys(raw, first, depth)))
            for kind in (0, 1):
                if sums[kind].held() > FLUSH:
                    yield from out(kind, sums[kind])
                    sums[kind] = _Sums()
        for kind in (0, 1):
            yield from out(kind, sums[kind])

    return run


_BINS = 4096


def _sum_up(depth: int):
    """One row for each (part, kind): the summed table, and for words how many of the counts fall in each of _BINS bins, for grams
    what the nodes above the subtrees need."""

    def run(batches):
        sums: dict[tuple[int, int], _Sums] = {}
        for batch in batches:
            for p, k, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                (keys, counts), _ = _unpack(blob, (U, np.int64))
                sums.setdefault((p, k), _Sums()).add(keys, counts)
        for (p, k), s in sums.items():
            keys, counts = s.all()
            up = subtree_sums(keys, counts, depth) if k else [np.bincount(_bin(counts), minlength=_BINS).astype(np.int64)]
            yield pa.record_batch([pa.array([p], pa.int32()), pa.array([k], pa.int32()), pa.array([_pack([keys, counts])], pa.binary()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([_pack(up)], pa.binary())], names=["part", "kind", "blob", "n", "total", "up"])

    return run


def _bin(counts: np.ndarray) -> np.ndarray:
    """Order-keeping bin: exact to 1024, then logarithmic."""
    return np.where(counts < 1024, counts, np.minimum(1024 + (np.log2(np.maximum(counts, 1024) / 1024) * 64).astype(np.int64), _BINS - 1)).astype(np.int64)


def _least_bin(bins: np.ndarray, most: int) -> int:
    """Smallest bin from which on at most `most` entries lie."""
    above = np.cumsum(bins[::-1])[::-1]
    return int(np.flatnonzero(np.append(above, 0) <= most)[0])


def _add_up(batches):
    """Sums of the `up` column for each kind."""
    total: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for k, blob in zip(batch.column("kind").to_pylist(), batch.column("up"), strict=True):
            if k:
                more = _unpack(blob.as_py(), _UP)[0]
                total[k] = _by_node(*(np.concatenate(x) for x in zip(total[k], more, strict=True))) if k in total else more
            else:
                total[k] = [total.get(k, [0])[0] + _unpack(blob.as_py(), (np.int64,))[0][0]]
    for k, up in total.items():
        yield pa.record_batch([pa.array([k], pa.int32()), pa.array([_pack(up)], pa.binary())], names=["kind", "up"])


def _frequent(least: int):
    def run(batches):
        for batch in batches:
            for blob in batch.column("blob"):
                (keys, counts), _ = _unpack(blob.as_py(), (U, np.int64))
                pick = _bin(counts) >= least
                yield pa.record_batch([pa.array([_pack([keys[pick], counts[pick]])], pa.binary())], names=["blob"])

    return run


# ---------------------------------------------------------------- the tree

_LOG_PI = math.log(math.pi)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x > 0: shifted Stirling series."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] += np.log(y[low])
        y[low] += 1
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _log_kt(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    return _log_gamma(zero + 0.5) + _log_gamma(one + 0.5) - _log_gamma(zero + one + 1.0) - _LOG_PI


def _bits(levels, j: int):
    """Nodes of the j-th bit at each level, with their counts of zeros and ones."""
    ids, zero, one = [], [], []
    for g, c in levels:
        symbol = g & U(255)
        prefix = (U(1) << U(j)) | (symbol >> U(8 - j))
        node, inverse = np.unique(((g >> U(8)) << U(8)) | prefix, return_inverse=True)
        bit = ((symbol >> U(7 - j)) & U(1)).astype(bool)
        ids.append(node)
        zero.append(np.bincount(inverse[~bit], c[~bit], len(node)))
        one.append(np.bincount(inverse[bit], c[bit], len(node)))
    return ids, zero, one


def _parents(ids: np.ndarray, depth: int) -> np.ndarray:
    """Nodes of depth - 1 above nodes of `depth`."""
    return ((ids >> U(8)) & U((1 << (8 * (depth - 1))) - 1)) << U(8) | (ids & U(255))


def _weigh(zero: np.ndarray, one: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of a node's own estimate, and its weighted log probability; `below` is the sum of its children's."""
    own = _log_kt(zero, one)
    return 1 / (1 + np.exp(np.clip(below - own, -700, 700))), np.logaddexp(own, below) - math.log(2)


def _bottom_up(ids, zero, one, top: int):
    """Positions of the parents and shares of own estimates at each level, and weighted log probabilities of the first, which has depth `top`."""
    last = len(ids) - 1
    up = [None] + [np.searchsorted(ids[i - 1], _parents(ids[i], top + i)) for i in range(1, last + 1)]
    weighted, stop = _log_kt(zero[last], one[last]), [None] * last + [np.ones(len(ids[last]))]
    for i in range(last - 1, -1, -1):
        stop[i], weighted = _weigh(zero[i], one[i], np.bincount(up[i + 1], weighted, len(ids[i])))
    return up, stop, weighted


def _top_down(zero, one, up, stop, done: np.ndarray, left: np.ndarray):
    """Probability of a one in the nodes of each level; done and left are what the levels above settled and left over."""
    for i in range(len(zero)):
        if i:
            done, left = (done + left * stop[i - 1] * kt)[up[i]], (left * (1 - stop[i - 1]))[up[i]]
        kt = (one[i] + 0.5) / (zero[i] + one[i] + 1)
        yield done + left * kt


def _sorted_nodes(keys: list[np.ndarray], p: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, p = np.concatenate([np.zeros(0, U), *keys]), np.concatenate([np.zeros(0), *p])
    order = np.argsort(keys)
    return keys[order], p[order]


def build_tree(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted node keys (depth, context, bits so far) and each node's probability of a one, mixed over all depths, from
    (context, byte) pairs of all depths, the depth plus one in the top byte."""
    by_depth = (keys >> U(56)).astype(np.int64) - 1
    gram = keys & U((1 << 56) - 1)
    levels = [(gram[by_depth == d], counts[by_depth == d].astype(np.float64)) for d in range(depth + 1)]
    out_keys, out_p = [], []
    for j in range(8):
        ids, zero, one = _bits(levels, j)
        up, stop, _ = _bottom_up(ids, zero, one, 0)
        out_p += _top_down(zero, one, up, stop, np.zeros(len(ids[0])), np.ones(len(ids[0])))
        out_keys += [x | U(d << 56) for d, x in enumerate(ids)]
    return _sorted_nodes(out_keys, out_p)


def _levels(keys: np.ndarray, counts: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Summed pairs of the depths from TOP to `depth`, from those of `depth`."""
    out = [(keys, counts)]
    for d in range(depth, min(TOP, depth), -1):
        out.append(_summed(out[-1][0] & U((1 << (8 * d)) - 1), out[-1][1]))
    return [(k, c.astype(np.float64)) for k, c in reversed(out)]


_UP = (U, np.float64, np.float64, np.float64)


def _by_node(ids: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    node, inverse = np.unique(ids, return_inverse=True)
    return [node, *(np.bincount(inverse, v, len(node)) for v in values)]


def subtree_sums(keys: np.ndarray, counts: np.ndarray, depth: int) -> list[np.ndarray]:
    """For the nodes just above the subtrees: node, sum of its children's weighted log probabilities, zeros and ones."""
    top = min(TOP, depth)
    if not top:
        return [np.zeros(0, t) for t in _UP]
    out, levels = [], _levels(keys, counts, depth)
    for j in range(8):
        ids, zero, one = _bits(levels, j)
        out.append(_by_node(_parents(ids[0], top), _bottom_up(ids, zero, one, top)[2], zero[0], one[0]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def top_tree(ids: np.ndarray, below: np.ndarray, zero: np.ndarray, one: np.ndarray, depth: int):
    """((keys, probabilities) of all nodes above the subtrees, (node, done, left) for those just above them), from the sums of all buckets."""
    top = min(TOP, depth)
    levels = []
    ids, below, zero, one = _by_node(ids, below, zero, one)
    for d in range(top - 1, -1, -1):
        stop, weighted = _weigh(zero, one, below)
        levels.insert(0, (ids, zero, one, stop))
        if d:
            ids, below, zero, one = _by_node(_parents(ids, d), weighted, zero, one)
    if not top:
        return _sorted_nodes([], []), (np.zeros(0, U), np.zeros(0), np.zeros(0))
    ids, zero, one, stop = (list(x) for x in zip(*levels, strict=True))
    up = [None] + [np.searchsorted(ids[d - 1], _parents(ids[d], d)) for d in range(1, top)]
    p = list(_top_down(zero, one, up, stop, np.zeros(len(ids[0])), np.ones(len(ids[0]))))
    done, left = np.zeros(len(ids[0])), np.ones(len(ids[0]))
    for d in range(top):
        if d:
            done, left = done[up[d]], left[up[d]]
        done, left = done + left * stop[d] * (one[d] + 0.5) / (zero[d] + one[d] + 1), left * (1 - stop[d])
    return _sorted_nodes([x | U(d << 56) for d, x in enumerate(ids)], p), (ids[-1], done, left)


def subtree_nodes(keys: np.ndarray, counts: np.ndarray, depth: int, above, hand) -> tuple[np.ndarray, np.ndarray]:
    """Like build_tree, for the subtrees of a bucket and the nodes above all subtrees."""
    top = min(TOP, depth)
    levels = _levels(keys, counts, depth)
    out_keys, out_p = [above[0]], [above[1]]
    for j in range(8):
        ids, zero, one = _bits(levels, j)
        up, stop, _ = _bottom_up(ids, zero, one, top)
        done, left = np.zeros(len(ids[0])), np.ones(len(ids[0]))
        if top:
            at = np.searchsorted(hand[0], _parents(ids[0], top))
            done, left = hand[1][at], hand[2][at]
        out_p += _top_down(zero, one, up, stop, done, left)
        out_keys += [x | U((top + i) << 56) for i, x in enumerate(ids)]
    return _sorted_nodes(out_keys, out_p)


def _look(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, want)
    at[at == len(keys)] = 0
    return at, (keys[at] == want) if len(keys) else np.zeros(len(want), bool)


class HashTable:
    """Open addressing over 64-bit keys, all in arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, U(2**64 - 1)), np.zeros(size, values.dtype)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot] == U(2**64 - 1)
            self.keys[slot[free]] = keys[todo[free]]
            placed = self.keys[slot] == keys[todo]
            self.values[slot[placed]] = values[todo[placed]]
            todo, slot = todo[~placed], (slot[~placed] + 1) & (size - 1)

    def _slot(self, keys):
        with np.errstate(over="ignore"):
            return ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def get(self, want: np.ndarray, missing) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys are there."""
        slot = self._slot(want)
        out, found = np.full(len(want), missing, self.values.dtype), np.zeros(len(want), bool)
        todo = np.arange(len(want))
        for _ in range(self.probes):
            have = self.keys[slot]
            hit = have == want[todo]
            out[todo[hit]] = self.values[slot[hit]]
            found[todo[hit]] = True
            go = ~hit & (have != U(2**64 - 1))
            if not go.any():
                break
            todo, slot = todo[go], (slot[go] + 1) & (len(self.keys) - 1)
        return out, found


def byte_scores(nodes: np.ndarray, p_one: np.ndarray, want: np.ndarray, depth: int) -> np.ndarray:
    """log10 probability of each (context, byte), bit by bit, each bit in the longest context that was seen."""
    out = np.zeros(len(want))
    symbol, context = want & U(255), want >> U(8)
    for j in range(8):
        prefix = (U(1) << U(j)) | (symbol >> U(8 - j))
        bit = ((symbol >> U(7 - j)) & U(1)).astype(bool)
        p = np.full(len(want), 0.5)
        todo = np.arange(len(want))
        for d in range(depth, -1, -1):
            key = ((context[todo] & U((1 << (8 * d)) - 1)) << U(8)) | prefix[todo] | U(d << 56)
            at, hit = _look(nodes, key)
            p[todo[hit]] = p_one[at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        out += np.log10(np.where(bit, p, 1 - p))
    return out


# ---------------------------------------------------------------- scoring

_SCORED = "held_out boolean, n_tokens long, n_known long, base double, _lm_a long, _lm_b long, part int, kind int, blob binary"
#: Kinds of packed rows: requests for rare words and for grams, packed texts; for a group, its answers, sums of rare words and texts, read in this order.
_ASK_WORDS, _ASK_GRAMS, _ANSWER, _RARE, _TEXT = 2, 3, 4, 5, 6


def _score(text: str, id_col: str, depth: int, parts: int, model, tokens: int, vocabulary: int, group_pairs: int):
    norm = tokens + 0.5 * (vocabulary + 1)
    names = [id_col, "held_out", "n_tokens", "n_known", "base", "_lm_a", "_lm_b", "part", "kind", "blob"]

    def run(batches):
        known = id_type = None
        task, n_before, parts_asked, limit, held = secrets.randbits(63), 0, [], group_pairs, 0

        def packed(kind: int, blobs: list[tuple[int, bytes]]):
            k = len(blobs)
            return pa.record_batch([pa.nulls(k, id_type), pa.nulls(k, pa.bool_()), *[pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.float64())], pa.array([task] * k, pa.int64()), pa.nulls(k, pa.int64()), pa.array([p for p, _ in blobs], pa.int32()), pa.array([kind] * k, pa.int32()), pa.array([b for _, b in blobs], pa.binary())], names=names)

        def requests(asked):
            return packed(_ASK_GRAMS, [(p, _pack([asked[at]])) for p, at in _deal(1, asked, parts, depth)])

        for table in chunks(batches, text, CHUNK):
            if known is None:
                word_keys, word_counts = model.value
                known, id_type = HashTable(word_keys, word_counts), table[id_col].type
            rows = table.num_rows
            data, off = text_bytes(table[text])
            words = Words(data, off, lower=True)
            raw, first = stream(data, words, depth)
            parts_asked.append(_summed(gram_keys(raw, first, depth))[0])
            row = np.repeat(np.arange(rows), words.counts)
            count, seen = known.get(words.hashes, 0)
            # the end's own count is the number of training rows, kept under key 0
            end_count = word_counts[word_keys == U(0)].sum()
            log = np.log10((count + 0.5) / norm)
            log[~seen] = 0
            base = np.bincount(row, log, rows) + math.log10((end_count + 0.5) / norm)
            n_known = np.bincount(row, seen, rows).astype(np.int64) + int(end_count > 0)
            yield pa.record_batch([table[id_col].combine_chunks(), table["held_out"].combine_chunks(), pa.array(words.counts + 1), pa.array(n_known), pa.array(base), pa.array(np.full(rows, task)), pa.array(np.arange(n_before, n_before + rows)), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
            yield packed(_TEXT, [(0, _pack([raw, first, np.array([n_before], np.int64)]))])
            rare = np.flatnonzero(~seen)
            if len(rare):
                h, r = words.hashes[rare], row[rare]
                yield packed(_ASK_WORDS, [(p, _pack([h[at], r[at].astype(np.int32), np.array([task, n_before], np.int64)])) for p, at in _deal(0, h, parts, depth)])
            n_before += rows
            held += len(raw)
            if sum(map(len, parts_asked)) > limit or held > GROUP_BYTES:  # the distinct ones are found now and then, not for every chunk
                parts_asked = [np.unique(np.concatenate(parts_asked))]
                limit = 2 * len(parts_asked[0])
                if len(parts_asked[0]) > group_pairs or held > GROUP_BYTES:
                    yield requests(parts_asked[0])
                    task, n_before, parts_asked, limit, held = secrets.randbits(63), 0, [], group_pairs, 0
        if parts_asked:
            yield requests(np.unique(np.concatenate(parts_asked)))

    return run


def _answer(depth: int, model):
    """Meets requests for (context, byte) pairs with the subtrees of the same bucket."""

    def run(batches):
        tables, asked = {}, {}
        for batch in batches:
            for p, k, a, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if k == 1:
                    tables[p] = blob
                else:
                    asked.setdefault(p, []).append((a, blob))
        for p, blobs in asked.items():
            keys, counts = _unpack(tables[p], (U, np.int64))[0] if p in tables else (np.zeros(0, U), np.zeros(0, np.int64))
            nodes, p_one = subtree_nodes(keys, counts, depth, *model.value)
            want, held, size = np.zeros(0, U), [], 0
            for i, (_, blob) in enumerate(blobs):
                held.append(_unpack(blob, (U,))[0][0])
                size += len(held[-1])
                if size > 3_000_000 or i == len(blobs) - 1:
                    want, held, size = np.unique(np.concatenate([want, *held])), [], 0
            value = np.concatenate([np.zeros(0), *(byte_scores(nodes, p_one, want[lo : lo + (1 << 18)], depth) for lo in range(0, len(want), 1 << 18))])
            for a, blob in blobs:
                mine = _unpack(blob, (U,))[0][0]
                yield pa.record_batch([pa.array([a], pa.int64()), pa.array([_ANSWER], pa.int32()), pa.array([_pack([mine, value[np.searchsorted(want, mine)]])], pa.binary())], names=["_lm_a", "kind", "blob"])
            trimmed()

    return run


def _rare_words(tokens: int, vocabulary: int):
    """Meets requests for rare words with the counts of the same bucket."""
    norm = tokens + 0.5 * (vocabulary + 1)

    def run(batches):
        tables, asked = {}, {}
        for batch in batches:
            for p, k, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                (tables if k == 0 else asked).setdefault(p, []).append(blob)
        for p, blobs in asked.items():
            keys, counts = np.zeros(0, U), np.zeros(0, np.int64)
            for blob in tables.get(p, []):
                (keys, counts), _ = _unpack(blob, (U, np.int64))
            for blob in blobs:
                (h, r, at), _ = _unpack(blob, (U, np.int32, np.int64))
                where, hit = _look(keys, h)
                count = np.where(hit, counts[where], 0) if len(keys) else np.zeros(len(h))
                log = np.log10((count + 0.5) / norm)
                rows, inverse = np.unique(r, return_inverse=True)
                yield pa.record_batch([pa.array([at[0]]), pa.array([_RARE], pa.int32()), pa.array([_pack([rows.astype(np.int32), np.bincount(inverse, count > 0).astype(np.int32), np.bincount(inverse, log), at[1:]])], pa.binary())], names=["_lm_a", "kind", "blob"])

    return run


def _by_row(depth: int):
    """Scores of the rows of each group, whose answers and sums of rare words come before its texts."""

    def run(batches):
        group, answers, table, rare = None, [], None, {}
        for batch in batches:
            for a, kind, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if a != group:
                    group, answers, table, rare = a, [], None, {}
                blob = item.as_py()
                if kind == _ANSWER:
                    answers.append(_unpack(blob, (U, np.float64))[0])
                elif kind == _RARE:
                    (rows, known, base, at), _ = _unpack(blob, (np.int32, np.int32, np.float64, np.int64))
                    have = rare.setdefault(int(at[0]), [np.zeros(0, np.int64), np.zeros(0)])
                    size = max(len(have[0]), int(rows.max()) + 1)
                    for i, x in enumerate((known, base)):
                        have[i] = np.pad(have[i], (0, size - len(have[i])))
                        have[i][rows] += x
                else:
                    if table is None:
                        table = HashTable(*(np.concatenate(x) for x in zip(*answers, strict=True)))
                        answers = []
                    (raw, first, at), _ = _unpack(blob, (np.uint8, np.int64, np.int64))
                    value, found = table.get(gram_keys(raw, first, depth), 0)
                    if not found.all():
                        raise RuntimeError("a group of texts misses answers")
                    n = len(first) - 1
                    total = np.add.reduceat(value, np.concatenate([[0], np.cumsum(np.diff(first) - depth)])[:-1])
                    known, base = (np.pad(x, (0, n - len(x))) for x in rare.pop(int(at[0]), [np.zeros(0, np.int64), np.zeros(0)]))
                    yield pa.record_batch([pa.array(np.full(n, a)), pa.array(np.arange(n) + at[0]), pa.array(known), pa.array(base), pa.array(total), pa.array(-total * math.log2(10) / (np.diff(first) - depth))], names=["_lm_a", "_lm_b", "more_known", "more_base", "score", "bits_per_byte"])
                    trimmed()

    return run


def score(docs: DataFrame, text: str = "text", id_col: str = "doc_id", depth: int = 5, fold: tuple[int, int] = (5, 1), max_contexts: int = 1 << 20, frequent_words: int = 1 << 17) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) and bits_per_byte (code length over the bytes coded: words, a space
    behind each, and the end) of every row of docs.

    Rows whose crc32(id as text) mod fold[0] is fold[1] are held out of training.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = shuffle_parts(spark, text_total(docs, text))
    id_type = docs.schema[id_col].dataType.simpleString()
    held = (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % fold[0]) == fold[1]
    slim = docs.select(id_col, text, held.alias("held_out"))
    training = slim.where("not held_out")
    counted = training.select(text).mapInArrow(_count(text, depth, parts), _COUNTS)
    sums = written(counted.repartition(parts, "part").mapInArrow(_sum_up(depth), "part int, kind int, blob binary, n long, total long, up binary"))
    facts = {r.kind: r for r in sums.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    ends = training.count()
    bins, up = np.zeros(_BINS, np.int64), [np.zeros(0, t) for t in _UP]
    for r in sums.select("kind", "up").repartition(2, "kind").mapInArrow(_add_up, "kind int, up binary").collect():
        if r.kind:
            up = _unpack(r.up, _UP)[0]
        else:
            bins = _unpack(r.up, (np.int64,))[0][0]
    tokens = (facts[0].total if 0 in facts else 0) + ends
    vocabulary = (facts[0].n if 0 in facts else 0) + int(ends > 0)
    got = [_unpack(r.blob, (U, np.int64))[0] for r in sums.where("kind = 0").select("blob").mapInArrow(_frequent(_least_bin(bins, frequent_words)), "blob binary").toLocalIterator()]
    word_keys, word_counts = (np.concatenate([x[i] for x in got] + [np.array([v], t)]) for i, v, t in ((0, 0, U), (1, ends, np.int64)))
    words, tree = (spark.sparkContext.broadcast(x) for x in ((word_keys, word_counts), top_tree(*up, depth)))
    scored = written(slim.mapInArrow(_score(text, id_col, depth, parts, words, tokens, vocabulary, max_contexts), f"`{id_col}` {id_type}, {_SCORED}"))
    asked = scored.where(F.col("kind") == _ASK_WORDS).select("part", "kind", "blob").unionByName(sums.where("kind = 0").select("part", "kind", "blob"))
    more = asked.repartition(parts, "part").mapInArrow(_rare_words(tokens, vocabulary), "_lm_a long, kind int, blob binary")
    asked = scored.where(F.col("kind") == _ASK_GRAMS).select("part", "kind", "_lm_a", "blob").unionByName(sums.where("kind = 1").select("part", "kind", F.lit(None).cast("long").alias("_lm_a"), "blob"))
    more = more.unionByName(asked.repartition(parts, "part").mapInArrow(_answer(depth, tree), "_lm_a long, kind int, blob binary"))
    more = more.unionByName(scored.where(F.col("kind") == _TEXT).select("_lm_a", "kind", "blob"))
    # few large groups: with more partitions than groups, a task has one or two of them
    more = more.repartition(4 * parts, "_lm_a").sortWithinPartitions("_lm_a", "kind").mapInArrow(_by_row(depth), "_lm_a long, _lm_b long, more_known long, more_base double, score double, bits_per_byte double")
    out = scored.where("kind is null").join(more, ["_lm_a", "_lm_b"], "left")
    return out.select(
        id_col, "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        "score", "bits_per_byte",
    )
