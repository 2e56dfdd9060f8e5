"""Embedding near-dedup with an inverted multi-index.

Unit vectors are cut in two halves, each with a codebook of its own (k-means on a bounded sample); a vector's cell is the pair of
its nearest codewords, so k codewords a half make a grid of k * k cells. A query visits cells by multi-sequence traversal: of all
cells next to those visited, the one nearest by the sum of its halves' distances comes next. It stops when the target recall is
reached. Distances are least distances, by the planes between codewords, from the query's half to the cell's; with unit vectors
cosine >= c means a squared distance <= 2 - 2c, so recall 1 (the default) is reached with the first cell beyond that. For a
lower target the stop is the distance within which that share of the links of a sample lies, found by brute force. Candidates
are verified in double precision. Every vector is in the index.

Links are symmetric, so a query leaves out cells before its own: their vectors visit it. What travels is one copy of a vector
for each first codeword that it visits, with the list of second ones. Equal vectors of a label are one class with a count, so copies
cost one vector. What lies under a first codeword is split in a grid of stripes of at most `block` vectors; a block gives counts
and a spanning forest of its links, never its pairs.

Defined cases: null labels, null, empty or zero vectors and those with null or non-finite components link with nothing; vectors of
different lengths don't link; repeated rows are copies of each other; ids may be null (they name no component). Extra columns are
dropped, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, dropped, met, union, written

#: Rows that codebooks are fitted on, and on which recall is measured; codewords a half.
SAMPLE, MEASURED, MOST_WORDS = 16_384, 2_048, 2_048


def codebook(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means; fewer rows than k give fewer codewords."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _least_distances(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword, and a lower bound of the squared distance from x to each codeword's cell."""
    d = np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)
    near = d.argmin(1)
    square = (c**2).sum(1)
    apart = np.sqrt(np.maximum(square[:, None] - 2 * c @ c.T + square, 1e-300))
    plane = (d - d[np.arange(len(x)), near][:, None]) / (2 * apart[near])
    plane[np.arange(len(x)), near] = 0
    return near, np.maximum(plane - 1e-7, 0) ** 2


def traversal(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], radius2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cell of each unit vector, and the (row, cell) visits, step by step: first every row's nearest cell, then its next."""
    half, k2 = books[0].shape[1], len(books[1])
    near1, far1 = _least_distances(x[:, :half], books[0])
    near2, far2 = _least_distances(x[:, half:], books[1])
    order1, order2 = far1.argsort(1, kind="stable"), far2.argsort(1, kind="stable")
    sorted1, sorted2 = np.take_along_axis(far1, order1, 1), np.take_along_axis(far2, order2, 1)
    wide = int((sorted1 <= radius2).sum(1).max(initial=1))
    sorted2 = np.concatenate([sorted2, np.full((len(x), 1), np.inf)], 1)
    # ahead[i, a]: distance of the next cell of row i in line a; the next line opens with the first step in the one before
    row, upto, ahead = np.arange(len(x)), np.zeros((len(x), wide), np.int64), np.full((len(x), wide), np.inf)
    ahead[:, 0] = sorted1[:, 0] + sorted2[:, 0]
    rows, cells = [], []
    while len(row):
        a = ahead.argmin(1)
        at = np.arange(len(row))
        on = ahead[at, a] <= radius2
        row, upto, ahead, a = row[on], upto[on], ahead[on], a[on]
        at = np.arange(len(row))
        b = upto[at, a]
        rows.append(row)
        cells.append(order1[row, a] * k2 + order2[row, b])
        upto[at, a] = b + 1
        ahead[at, a] = sorted1[row, a] + sorted2[row, b + 1]
        opens = np.flatnonzero((b == 0) & (a + 1 < wide))
        ahead[opens, a[opens] + 1] = sorted1[row[opens], a[opens] + 1] + sorted2[row[opens], 0]
    return near1 * k2 + near2, np.concatenate(rows), np.concatenate(cells)


def stop_distance(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], cosine: float, recall: float) -> float:
    """Squared distance at which a traversal ends: all that links can need, or what `recall` of the links among x need."""
    exact = 2 - 2 * cosine + 1e-9
    if recall >= 1:
        return exact
    x = x[:MEASURED]
    a, b = np.nonzero(np.triu(x @ x.T >= cosine, 1))
    if not len(a):
        return exact
    half = books[0].shape[1]
    (near1, far1), (near2, far2) = _least_distances(x[:, :half], books[0]), _least_distances(x[:, half:], books[1])
    need = np.sort(far1[a, near1[b]] + far2[a, near2[b]])
    return min(exact, float(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) + 1e-12)


def _unit(column) -> np.ndarray:
    size = len(column[0]) if len(column) else 0
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = pa.concat_arrays(arr.chunks) if isinstance(arr, pa.ChunkedArray) else arr
    x = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(arr), size)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


_SLAB = 1024
#: Cells to visit under one first codeword.
_VISITS = "array<struct<line:int,cells:array<int>>>"


def _cells(books):
    """Home cell and visits of each vector, the latter by first codeword."""

    def one(x: np.ndarray, book, stop: float):
        home, row, cell = traversal(x, book, stop)
        k2 = len(book[1])
        keep = cell >= home[row]
        row, cell = row[keep], cell[keep]
        order = np.lexsort((cell, row))
        row, cell = row[order], cell[order]
        line = cell // k2
        head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (line[1:] != line[:-1]))) if len(row) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(row)), pa.int32()), pa.array(cell, pa.int32()))
        lines = pa.StructArray.from_arrays([pa.array(line[head], pa.int32()), lists], names=["line", "cells"])
        first = np.searchsorted(row[head], np.arange(len(x) + 1))
        return home, home // k2, pa.ListArray.from_arrays(pa.array(first, pa.int32()), lines)

    def run(batches):
        for batch in batches:
            size = batch.column("d").to_numpy()
            for d in np.unique(size).tolist():
                part = batch.filter(pa.array(size == d))
                for lo in range(0, part.num_rows, _SLAB):
                    slab = part.slice(lo, _SLAB)
                    if d in books.value:
                        home, line, visits = one(_unit(slab.column("v")), *books.value[d])
                    else:  # one cell
                        home = line = np.zeros(slab.num_rows, np.int64)
                        visits = pa.array([[{"line": 0, "cells": [0]}]] * slab.num_rows, pa.list_(pa.struct([("line", pa.int32()), ("cells", pa.list_(pa.int32()))])))
                    yield pa.RecordBatch.from_arrays([*slab.columns, pa.array(home, pa.int32()), pa.array(line, pa.int32()), visits], [*slab.schema.names, "cell", "line", "visits"])

    return run


def _block_links(cosine: float):
    schema = pa.schema([("node", pa.string()), ("links", pa.int64()), ("root", pa.string())])

    def run(key, homes, queries):
        if not homes.num_rows or not queries.num_rows:
            return schema.empty_table()
        homes, queries = homes.sort_by("cell"), queries.combine_chunks()
        hn, qn = homes["node"].to_pylist(), queries["q_node"].to_pylist()
        names = sorted({*hn, *qn})
        number = {x: i for i, x in enumerate(names)}
        hi, qi = np.array([number[x] for x in hn]), np.array([number[x] for x in qn])
        h, hm, cell = _unit(homes["v"]), homes["m"].to_numpy(), homes["cell"].to_numpy()
        q, qm, own = _unit(queries["q_v"]), queries["q_m"].to_numpy(), queries["q_cell"].to_numpy()
        lists = queries["q_cells"].combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        visit, who = lists.flatten().to_numpy(), np.repeat(np.arange(len(qn)), lists.value_lengths().to_numpy())
        order = np.argsort(visit, kind="stable")
        visit, who = visit[order], who[order]
        links, root = np.zeros(len(names), np.int64), np.arange(len(names))
        for c in np.unique(cell).tolist():
            lo, hi_ = np.searchsorted(cell, [c, c + 1])
            first, last = np.searchsorted(visit, [c, c + 1])
            for at in range(first, last, 512):
                w = who[at : min(last, at + 512)]
                hit = q[w] @ h[lo:hi_].T >= cosine
                hit &= qi[w, None] != hi[lo:hi_]
                if not hit.any():
                    continue
                np.add.at(links, qi[w], hit @ hm[lo:hi_])
                other = own[w] != c  # in its own cell a vector is met as a query too
                np.add.at(links, hi[lo:hi_], hit[other].T @ qm[w[other]])
                a, b = np.nonzero(hit)
                root = union(np.concatenate([qi[w][a], np.arange(len(names))]), np.concatenate([hi[lo:hi_][b], root]), len(names))
        out = np.flatnonzero((links > 0) | (root != np.arange(len(names))))
        return pa.table({"node": [names[i] for i in out], "links": links[out], "root": [names[i] for i in root[out]]}, schema=schema)

    return run


def linked(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = 8192, per_cell: int = 256, recall: float = 1.0) -> DataFrame:
    """id, n_links, component_id and kept of every row. `recall`: share of the links that the traversal has to find."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    good = F.col("l").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    name = F.concat_ws("-", F.hex(F.xxhash64(F.col("l"), F.lit(1), F.col("v"))), F.hex(F.xxhash64(F.lit(2), F.col("v"), F.col("l"))))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("l"), F.col(vector).alias("v")).select("id", "l", "v", F.when(good, name).alias("node"))
    classes = written(rows.where("node is not null").groupBy("node").agg(F.first("l").alias("l"), F.first("v").alias("v"), F.min("id").alias("low"), F.count("*").alias("m")).withColumn("d", F.size("v")))
    n, labels, total = classes.agg(F.count("*"), F.countDistinct("l"), F.coalesce(F.sum("m"), F.lit(0))).first()
    books: dict[int, tuple] = {}
    k = int(min(MOST_WORDS, max(2, round((n / max(1, labels) / per_cell) ** 0.5))))
    sample = classes.select("d", "v", F.xxhash64("node").alias("h")).orderBy("h").limit(SAMPLE).select("d", "v").toArrow()
    size = sample["d"].to_numpy()
    for d in np.unique(size).tolist():
        if d > 1:
            x = _unit(sample.filter(pa.array(size == d))["v"])
            pair = codebook(x[:, : d // 2], k, 1), codebook(x[:, d // 2 :], k, 2)
            books[d] = pair, stop_distance(x, pair, cosine, recall)
    shared = spark.sparkContext.broadcast(books)
    kind = {c: t.simpleString() for c, t in ((f.name, f.dataType) for f in classes.schema.fields)}
    slim = classes.select("node", "l", "v", "m", "d")
    indexed = written(slim.mapInArrow(_cells(shared), f"node string, l {kind['l']}, v {kind['v']}, m long, d int, cell int, line int, visits {_VISITS}"))
    shared.destroy()
    homes = indexed.select("l", "d", "line", "cell", "node", "v", "m")
    queries = indexed.select("l", "d", F.explode("visits").alias("x"), "cell", "node", "v", "m").select("l", "d", "x.line", "x.cells", "cell", "node", "v", "m")
    keys = ["l", "d", "line"]
    grid = homes.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("hs")).join(queries.groupBy(*keys).agg(F.ceil(F.count("*") / (2 * block)).cast("int").alias("qs")), keys)
    spread = lambda c, other, own: c.join(grid, keys).withColumns({own: F.pmod(F.xxhash64("node"), F.col(f"{own}s")).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))})
    full = [*keys, "h", "q"]
    h = spread(homes, "q", "h").select(*full, "cell", "node", "v", "m")
    q = spread(queries, "h", "q").select(*[F.col(c).alias(f"q_{c}") for c in ("l", "d", "line", "h", "q", "cells", "cell", "node", "v", "m")])
    found = written(h.groupBy(*full).cogroup(q.groupBy(*[f"q_{c}" for c in full])).applyInArrow(_block_links(cosine), "node string, links long, root string"))
    comp = components(found.where("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    ids = classes.select("node", "low", "m").join(links, "node", "left").join(comp, "node", "left")
    ids = written(ids.select("node", "low", "m", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "node").alias("root")))
    low = ids.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("members"))
    facts = written(met(ids, low, "root", "members", max(n, 1)).select("node", "m", "n_links", "component_id"))
    for table in (classes, indexed, found, ids):
        dropped(table)
    out = met(rows.select("id", "node"), facts, "node", "m", max(total, 1), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
