"""Passage encoders behind one protocol, and the registry that makes them by name."""

from __future__ import annotations

import functools
import hashlib
import importlib.metadata
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.text import normalize
from ..scratch import written


class EncoderUnavailable(RuntimeError):
    """The encoder's dependency or model isn't there."""


class Encoder(Protocol):
    @property
    def metadata(self) -> dict[str, Any]: ...

    @property
    def parameters(self) -> dict[str, Any]: ...

    @property
    def runtime_status(self) -> dict[str, Any]: ...

    def query(self, text: str) -> list[float]: ...

    def passages(self, text: Column) -> Column: ...


class HashingEncoder:
    """Signed hashes of character n-grams, scaled to unit length. Not a neural model.

    `digest` md5 is for comparisons with engines that lack blake2b; it has an identity of its own.
    """

    def __init__(self, dimensions: int = K.VECTOR_DIMENSIONS, widths: tuple[int, ...] = K.NGRAM_WIDTHS, digest: str = "blake2b"):
        self.dimensions, self.widths, self.digest = dimensions, widths, digest

    @property
    def metadata(self):
        named = {} if self.digest == "blake2b" else {"model": f"{self.digest}-character-ngram"}
        return K.HASHING_IDENTITY | named | {"dimensions": self.dimensions, "is_neural": False}

    @property
    def parameters(self):
        return {"dimensions": self.dimensions, "ngram_widths": list(self.widths), "normalization": "l2"}

    @property
    def runtime_status(self):
        return {"ready": True, "dependency": "python-standard-library", "dependency_version": "builtin"}

    def query(self, text: str) -> list[float]:
        return self._encoded([text])[0].tolist()

    def passages(self, text: Column) -> Column:
        encoder = self

        @F.pandas_udf("array<double>")
        def encode(batch: pd.Series) -> pd.Series:
            texts = [t or "" for t in batch]
            return pd.Series([v for lo, hi in _chunks(texts) for v in encoder._encoded(texts[lo:hi])], dtype=object)

        return encode(text)

    def cosines(self, text: Column, queries: list[str]) -> Column:
        """array<double>: the cosine with each query, 0 where there is nothing to compare; the vectors stay in the worker."""
        encoder = self

        @F.pandas_udf("array<double>")
        def encode(batch: pd.Series) -> pd.Series:
            asked = encoder.sums([_compact(q) for q in queries]).astype(float)
            size = np.sqrt((asked**2).sum(1))
            texts, out = [t or "" for t in batch], []
            for lo, hi in _chunks(texts):
                found = encoder.sums([_compact(t) for t in texts[lo:hi]]).astype(float)
                norm = np.sqrt((found**2).sum(1, keepdims=True))
                out += list(found @ asked.T / np.where(norm > 0, norm, 1) / np.where(size > 0, size, 1))
            return pd.Series(out, dtype=object)

        return encode(text)

    def _encoded(self, texts: list[str]) -> np.ndarray:
        """One row a text."""
        out = self.sums([_compact(t) for t in texts]).astype(float)
        norm = np.sqrt((out**2).sum(1, keepdims=True))
        return out / np.where(norm > 0, norm, 1)

    def sums(self, texts: list[str]) -> np.ndarray:
        """Signed numbers of n-grams in each bucket, one row a text. Works through CHUNK characters at a time, however long a text is."""
        joined, ends, size = "".join(texts), np.cumsum([len(t) for t in texts], dtype=np.int64), 2 * self.dimensions
        counts = np.zeros(len(texts) * size + 1, np.int64)  # the last one takes what isn't counted here
        for lo in range(0, len(joined), CHUNK):
            part = joined[lo : lo + CHUNK + max(self.widths) - 1]
            points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            row = np.repeat(np.arange(0, len(counts) - 1, size), np.diff(np.clip(ends, lo, lo + len(part)), prepend=lo))
            inner = ends[(ends > lo) & (ends < lo + len(part))] - lo
            high = np.flatnonzero(points > 0xFFFF)
            key, found = points, []
            for width in range(1, max(self.widths) + 1):
                if 1 < width <= _Places.MOST:
                    key = key[:-1] | points[width - 1 :] << np.uint64(16 * width - 16)
                n = min(CHUNK, len(points) - width + 1)  # n-grams that begin in this part
                if width not in self.widths or n < 1:
                    continue
                places = _places(width, self.dimensions, self.digest)
                across = _before(inner, width, n)
                if width > _Places.MOST or len(high):  # n-grams that don't fit a key
                    long = np.arange(n) if width > _Places.MOST else np.unique(_before(high + 1, width + 1, n))
                    for i in np.setdiff1d(long, across).tolist():
                        counts[row[i] + places.place(part[i : i + width])] += 1
                    across = np.concatenate([across, long])
                if width <= _Places.MOST:
                    at = row[:n] + places.found(key[:n])
                    at[across] = len(counts) - 1
                    found.append(at)
            if found:
                counts += np.bincount(np.concatenate(found), minlength=len(counts))
        counts = counts[:-1].reshape(len(texts), self.dimensions, 2)
        return counts[:, :, 1] - counts[:, :, 0]


def _before(places: np.ndarray, width: int, n: int) -> np.ndarray:
    """The width - 1 positions before each place, as far as they lie in 0..n-1."""
    at = (places[:, None] - np.arange(1, width)).ravel()
    return at[(at >= 0) & (at < n)]


#: Characters and texts that are worked on at a time.
CHUNK, TEXTS = 1 << 14, 256


def _chunks(texts: list[str]):
    """Ranges of at most TEXTS texts of together at most CHUNK characters, or of one longer text."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and (size + len(t) > CHUNK or i - lo == TEXTS):
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if texts:
        yield lo, len(texts)


def _compact(text: str) -> str:
    return " ".join(text.lower().split())


class _Places:
    """2 * bucket + sign (0 for minus) of n-grams of one width. Known ones lie in a table of fixed size with one slot for each; of two
    that want the same slot the later one has it, and the other is hashed again."""

    #: Characters of a key, and the bits of a slot's number.
    MOST, BITS = 4, 20

    def __init__(self, width: int, dimensions: int, digest: str):
        self.width, self.dimensions, self.digest = width, dimensions, digest
        self.table = np.zeros(2 << self.BITS, np.uint64)  # key and value by turns
        self.table[0] = 1  # key 0 belongs there and 1 elsewhere, so that no free slot has its key

    def place(self, gram: str) -> int:
        bucket, sign = _place(gram, self.dimensions, self.digest)
        return 2 * bucket + (sign > 0)

    def found(self, keys: np.ndarray) -> np.ndarray:
        """keys: n-grams as 16 bits a character, the first one lowest."""
        slot = ((keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)) << np.uint64(1)).view(np.int64)
        miss = np.flatnonzero(self.table.take(slot, mode="wrap") != keys)
        out = self.table.take(slot + 1, mode="wrap").view(np.int64)
        if len(miss):
            new, inverse = np.unique(keys[miss], return_inverse=True)
            letters = (new[:, None] >> np.arange(0, 16 * self.width, 16, dtype=np.uint64)) & np.uint64(0xFFFF)
            names = letters.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            values = np.array([self.place(names[i : i + self.width]) for i in range(0, len(names), self.width)], np.int64)
            out[miss] = values[inverse]
            _, first = np.unique(slot[miss], return_index=True)  # one key to a slot
            kept = miss[first]
            self.table[slot[kept]], self.table[slot[kept] + 1] = keys[kept], out[kept]
        return out


@functools.lru_cache(16)
def _places(width: int, dimensions: int, digest: str) -> _Places:
    """One for each worker."""
    return _Places(width, dimensions, digest)


def _place(gram: str, dimensions: int, digest: str = "blake2b") -> tuple[int, float]:
    if digest == "md5":
        found = hashlib.md5(gram.encode("utf-8", "surrogatepass")).digest()
        return int.from_bytes(found[:4], "big") % dimensions, 1.0 if found[0] & 1 else -1.0
    found = hashlib.blake2b(gram.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(found, "big") % dimensions, 1.0 if found[0] & 1 else -1.0


def _version(package: str) -> str:
    try:
        return importlib.metadata.version(package)
    except importlib.metadata.PackageNotFoundError:
        return "not-installed"


class E5Encoder:
    """Neural encoder with query and passage prefixes, at a pinned revision and pinned versions of its libraries. Loaded once in each
    worker, when first used; raises EncoderUnavailable without them. `factory` takes the place of the library's model class."""

    def __init__(self, factory=None, batch_size: int = 32, device: str = "cpu", local_files_only: bool = False, cache_folder: str = ""):
        if batch_size < 1:
            raise ValueError("batch_size must be at least 1")
        self.factory, self.batch_size, self.device, self.local, self.cache_folder = factory, batch_size, device, local_files_only, cache_folder

    @property
    def metadata(self):
        return dict(K.E5_IDENTITY)

    @property
    def parameters(self):
        versions = {"runtime_version": "sentence-transformers", "transformers_version": "transformers", "torch_version": "torch"}
        return {"runtime": "sentence-transformers", **{k: K.E5_VERSIONS[v] for k, v in versions.items()}} | {
            "query_prefix": K.E5_QUERY, "passage_prefix": K.E5_PASSAGE, "normalization": "l2", "batch_size": self.batch_size, "device": self.device,
            "local_files_only": self.local, "trust_remote_code": False, "max_sequence_tokens": K.E5_TOKENS,
        }

    @property
    def runtime_status(self):
        found = {p: "test-double" if self.factory is not None else _version(p) for p in K.E5_VERSIONS}
        ready = self.factory is not None or found == K.E5_VERSIONS
        return {"ready": ready, "dependencies": found, "required_versions": dict(K.E5_VERSIONS), "model_load": "lazy", "local_files_only": self.local}

    def _load(self):
        status = self.runtime_status
        if not status["ready"]:
            pins = lambda versions: ", ".join(f"{p}=={v}" for p, v in versions.items())
            raise EncoderUnavailable(f"the E5 encoder needs {pins(K.E5_VERSIONS)}; found {pins(status['dependencies'])}")
        factory = self.factory
        if factory is None:
            from sentence_transformers import SentenceTransformer as factory  # noqa: N813
        options = {"revision": K.E5_REVISION, "device": self.device, "trust_remote_code": False, "local_files_only": self.local}
        try:
            return factory(K.E5_MODEL, **options, **({"cache_folder": self.cache_folder} if self.cache_folder else {}))
        except Exception as e:
            raise EncoderUnavailable(f"{K.E5_MODEL} at revision {K.E5_REVISION} couldn't be loaded: {e}") from e

    @staticmethod
    def prepared(prefix: str, text: str) -> str:
        return prefix + " ".join(text.split())

    def _encoded(self, model, prefix: str, texts: list[str]) -> list[list[float]]:
        vectors = model.encode([self.prepared(prefix, t) for t in texts], batch_size=self.batch_size, show_progress_bar=False, convert_to_numpy=True, normalize_embeddings=True)
        return [[float(x) for x in v] for v in vectors]

    def query(self, text: str) -> list[float]:
        return self._encoded(self._load(), K.E5_QUERY, [text])[0]

    def passages(self, text: Column) -> Column:
        if not self.runtime_status["ready"]:
            self._load()
        encoder = self

        @F.pandas_udf("array<double>")
        def encode(batches):
            model = encoder._load()
            for batch in batches:
                yield pd.Series(encoder._encoded(model, K.E5_PASSAGE, [t or "" for t in batch]) if len(batch) else [], dtype=object)

        encode.__annotations__ = {}
        return encode(text)


class DisabledEncoder:
    """For rankings without a vector part; raises if it is used."""

    metadata = dict(K.DISABLED_IDENTITY)
    parameters: dict[str, Any] = {}
    runtime_status = {"ready": True, "dependency": "none"}

    def query(self, text: str):
        raise RuntimeError("vectors are disabled")

    def passages(self, text: Column):
        raise RuntimeError("vectors are disabled")


def encoder(name: str, **options) -> Encoder:
    made = {"hashing": HashingEncoder, "multilingual-e5-small": E5Encoder, "e5-small": E5Encoder, "disabled": DisabledEncoder}.get(name.strip().lower())
    if made is None:
        raise ValueError(f"no encoder is called {name}")
    return made(**options)


def _apart(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose key no other row has, the others); None if there are no others."""
    again = written(rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key).alias("_key")))
    if again.isEmpty():
        return rows, None
    same = F.col(key).eqNullSafe(F.col("_key"))
    return rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")


def _summed(rows: DataFrame, key: str, text: str, encoder: HashingEncoder, columns: str, make) -> DataFrame:
    """key and `columns` for each row; make(sums) gives the positions of texts and the columns, for a chunk of texts."""

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in _chunks(texts):
                at, *found = make(encoder.sums(texts[lo:hi]))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at + lo)), *[pa.array(x) for x in found]], names)

    kept = rows.select(key, normalize(text).alias("_text"))
    schema = T.StructType([kept.schema[0], *T.StructType.fromDDL(columns)])
    names = schema.names
    return kept.mapInArrow(run, schema)


def _nonzero(sums: np.ndarray):
    at, bucket = np.nonzero(sums)
    return at, bucket, sums[at, bucket]


def _squares(sums: np.ndarray):
    total = (sums.astype(float) ** 2).sum(1)
    at = np.flatnonzero(total)
    return at, total[at]


def md5_buckets(rows: DataFrame, key: str, text: str = "text", widths: tuple[int, ...] = K.NGRAM_WIDTHS, dimensions: int = K.VECTOR_DIMENSIONS) -> DataFrame:
    """key, bucket and the signed sum of n-grams in it: the encoder's sums with a hash that SQL has, over SQL's normalised text. A map, but
    for rows that share their key."""
    encoder = HashingEncoder(dimensions, widths, "md5")
    alone, others = _apart(rows, key)
    found = lambda part: _summed(part, key, text, encoder, "bucket bigint, value bigint", _nonzero)
    out = found(alone)
    return out if others is None else out.unionByName(found(others).groupBy(key, "bucket").agg(F.sum("value").alias("value")).where("value <> 0"))


def md5_norms(rows: DataFrame, key: str, text: str = "text", widths: tuple[int, ...] = K.NGRAM_WIDTHS, dimensions: int = K.VECTOR_DIMENSIONS) -> DataFrame:
    """key and the length of the vector that md5_buckets gives; keys without buckets have no row."""
    encoder = HashingEncoder(dimensions, widths, "md5")
    alone, others = _apart(rows, key)
    out = _summed(alone, key, text, encoder, "squares double", _squares)
    if others is not None:
        buckets = _summed(others, key, text, encoder, "bucket bigint, value bigint", _nonzero).groupBy(key, "bucket").agg(F.sum("value").alias("value")).where("value <> 0")
        out = out.unionByName(buckets.groupBy(key).agg(F.sum((F.col("value") * F.col("value")).cast("double")).alias("squares")))
    return out.select(key, F.sqrt("squares").alias("norm"))
