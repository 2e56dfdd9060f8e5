"""Quality classifier: subword embeddings (see subword.py) trained on labels.quality.

Bounds that are parameters: `sample_rows` labelled rows and about 8 MB of their text are used for training; every whole text
is scored. Labels come only from rows outside the held-out fold; label, language, source and id are never inputs of a score.

Defined cases: null and empty texts get the score of no evidence (the bias). Repeated rows are scored each. Labels other than 0
and 1 count as none. Without any usable label all scores are 0.5 and `trained` is false, so that a caller can tell a rejected text
from one that nothing is known of. Extra columns are kept; input columns named like an output are replaced. An empty table gives
an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches, chunks
from .subword import labelled_sample, train

CHUNK = 2_000_000


def held_out(id_col: str = "doc_id", fold: tuple[int, int] = (4, 2)):
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % fold[0]) == fold[1]


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", fold: tuple[int, int] = (4, 2), cut: float = 0.7, sample_rows: int = 6000) -> DataFrame:
    """docs with held_out, score (probability of quality 1), predicted (1 if score >= cut) and trained (whether there were labels)."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop("held_out", "score", "predicted", "trained")
    usable = labels.where(~held_out(id_col, fold)).select(id_col, F.col("quality").cast("int").alias("label"))
    texts, marks = labelled_sample(docs, usable, sample_rows, id_col, text, classes=2)
    trained = bool(len(marks))
    model = docs.sparkSession.sparkContext.broadcast(train(texts, marks, 2))

    def run(batches):
        for table in chunks(batches, text, CHUNK):
            score = model.value.probabilities(table[text])[:, 1]
            t = table.combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(score), pa.array((score >= cut).astype("int32")), pa.array([trained] * table.num_rows)], [*t.schema.names, "score", "predicted", "trained"])

    marked = docs.withColumn("held_out", held_out(id_col, fold))
    return marked.mapInArrow(run, StructType([*marked.schema.fields, *StructType.fromDDL("score double, predicted int, trained boolean").fields]))
