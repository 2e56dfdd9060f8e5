"""Token counts with a two-tier lookup on the map side.

The piece model never merges across the start of a run of spaces or around a line feed, so a text's tokens are the sum over
its pre-tokens (a run of spaces with the characters after it, or one line feed). The lengths of frequent pre-tokens
are broadcast as a compact table of at most `most` entries. They are those counted most often in all texts, by summaries of bounded
size that each task makes and sends once; what a summary leaves out changes speed, never a count. Other pre-tokens are encoded once and
kept in a cache of each worker, of bounded size. No pre-token is shuffled on that path.

Whether the rule holds for a model is checked from its pieces when the counter is made; else whole texts are encoded.

Defined cases: null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each. Extra columns are kept; an input
column named like an output is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches, dropped, written

_BAR = "▁"
_PRE = re.compile(f"{_BAR}*[^{_BAR}\n]+|{_BAR}+|\n")
CACHE = 150_000
OUT = "n_bytes long, n_tokens long, over_limit boolean"


def pre_tokens(text: str) -> list[str]:
    return _PRE.findall(_BAR + text.replace(" ", _BAR)) if text else []


class Counter32:
    """Token count of a text for one sentencepiece model."""

    def __init__(self, model: bytes, table: tuple[bytes, bytes] | None = None):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.splits = not any(_BAR in p.lstrip(_BAR) or "\n" in p for p in pieces) and sp.encode(f"a {_BAR} b  \nc ", out_type=str)[0] == f"{_BAR}a"
        outer = self

        class Lengths(dict):
            def __missing__(self, pre):
                n = outer._encode(pre)
                if len(self) >= outer.most:
                    self.clear()
                    self.update(outer.base)
                if len(pre) < 100:
                    self[pre] = n
                return n

        self.base = dict(zip(table[0].decode().split("\0"), np.frombuffer(table[1], np.uint16).tolist(), strict=True)) if table and table[1] else {}
        self.most = len(self.base) + CACHE
        self.lengths = Lengths(self.base)

    def _encode(self, pre: str) -> int:
        if pre == _BAR:
            return 1
        if pre[0] == _BAR:
            return len(self.sp.encode(pre[1:]))
        return len(self.sp.encode("\n" + pre)) - 2

    def count(self, text: str) -> int:
        if not self.splits:
            return len(self.sp.encode(text))
        return sum(map(self.lengths.__getitem__, pre_tokens(text)))


def _frequent(text: str, most: int):
    """The pre-tokens of a task that occur most often, with their counts; rare ones are forgotten whenever there are too many."""

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(text).to_pylist():
                if t:
                    seen.update(pre_tokens(t))
            if len(seen) > 8 * most:
                seen = Counter(dict(seen.most_common(2 * most)))
        top = [x for x in seen.most_common(most) if len(x[0]) < 100 and "\0" not in x[0]]
        yield pa.record_batch([pa.array([x[0] for x in top], pa.string()), pa.array([x[1] for x in top], pa.int64())], names=["pre", "n"])

    return run


def frequent_table(docs: DataFrame, model: bytes, text: str = "text", most: int = 1 << 15) -> tuple[bytes, bytes]:
    """Frequent pre-tokens (joined by NUL) and their lengths. Only those over the count that `most` of them reach come to the driver."""
    counter = Counter32(model)
    if not counter.splits:
        return b"", b""
    sums = written(docs.select(text).mapInArrow(_frequent(text, most), "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n")))
    size = F.floor(F.log2("n") * 16)
    bins = sorted(sums.groupBy(size.alias("b")).count().collect(), key=lambda r: -r.b)
    fits = [r.b for r, held in zip(bins, accumulate(r["count"] for r in bins), strict=True) if held <= most]
    top = sums.where(size >= fits[-1]).collect() if fits else []
    dropped(sums)
    top.sort(key=lambda r: (-r.n, r.pre))
    return "\0".join(r.pre for r in top).encode(), np.array([counter._encode(r.pre) for r in top], np.uint16).tobytes()


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", limit: int = 4096, most: int = 1 << 15) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    from pathlib import Path

    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    proto = Path(model_path).read_bytes()
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast((proto, frequent_table(docs, proto, text, most)))

    def run(batches):
        counter = None
        for batch in batches:
            counter = counter or Counter32(*model.value)
            n = [counter.count(t.as_py() or "") for t in batch.column(text)]
            size = pc.fill_null(pc.binary_length(batch.column(text)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], [*batch.schema.names, "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL(OUT).fields]))
