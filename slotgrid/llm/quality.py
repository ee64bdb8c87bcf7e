"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gbdt import Forest, fit
from .scratch import small_batches

#: Most labelled rows the trees are fitted on: those of smallest hash of the id.
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
FOLDS = 5

_KIND = np.zeros(256, np.int64)  # 0 other ASCII sign, 1 lower, 2 upper, 3 digit, 4 space, 5 newline, 6 common punctuation, 7 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[32, 9, 13]], _KIND[10], _KIND[128:] = 1, 2, 3, 4, 5, 7
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 6
FEATURES = ["log_bytes", "lower", "upper", "digit", "sign", "punctuation", "beyond", "log_words", "mean_word", "long_word", "distinct_words", "top_word", "top_pairs", "log_lines", "line_words", "repeated_lines", "ended_lines", "bang", "bar", "upper_words", "sign_words", "digit_words", "stop_lines", "short_words", "at_signs", "longest_run"]


def statistics(text: str | None) -> list[float]:
    """The features of one whole text, all finite; an empty or null text has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    data = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(_KIND[data], minlength=8) / n
    words = raw.split()
    w = max(1, len(words))
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    m = max(1, len(lines))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    change = np.flatnonzero(np.diff(data))
    runs = np.diff(np.concatenate([[-1], change, [n - 1]]))
    distinct = len(counts)
    return [
        np.log1p(n), kinds[1], kinds[2], kinds[3], kinds[0], kinds[6], kinds[7],
        np.log1p(len(words)), float(sizes.mean()), float((sizes > 15).mean()), distinct / w, max(counts.values(), default=0) / w,
        sum(c for c in pairs.values() if c > 1) / w, np.log1p(len(lines)), len(words) / m, 1 - len(set(lines)) / m,
        sum(line.rstrip().endswith((b".", b"!", b"?")) for line in lines) / m,
        raw.count(b"!") / w, raw.count(b"|") / w,
        sum(c for x, c in counts.items() if len(x) > 1 and x.isupper()) / w,
        sum(c for x, c in counts.items() if not x[-1:].isalnum() and x[-1] < 128 and x[-1:] not in b".,;:!?'\"()-") / w,
        sum(c for x, c in counts.items() if x.isdigit()) / w,
        sum(len(line) < 20 for line in lines) / m, float((sizes <= 2).mean()), raw.count(b"@") / w, float(runs.max()),
    ]


def fold(ids: pa.Array, folds: int) -> list[int | None]:
    return [None if i is None else zlib.crc32(str(i).encode()) % folds for i in ids.to_pylist()]


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, *, rows: int = TRAIN_ROWS, folds: int = FOLDS) -> Forest:
    """Trees from at most `rows` labelled documents whose crc32(id) mod `folds` is not 0; the driver gets their features alone.

    An id on several rows counts once for each different text, within the same bound.
    """
    marks = labels.where(f"`{id_col}` IS NOT NULL AND `{label_col}` IN (0, 1)").groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    marks = marks.where(F.crc32(F.encode(F.col("id").cast("string"), "UTF-8")) % folds != 0).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = [statistics(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(features, pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "y", "id"])

    found = texts.join(F.broadcast(marks), "id").select("text", F.col("label").cast("int"), "id").mapInArrow(run, "x array<double>, y int, id long")
    # an id may stand on many rows: rows alike count once, and the bound holds for what is left
    table = found.distinct().orderBy(F.xxhash64("id"), "id", "x").limit(rows).orderBy("id", "x").toArrow()
    x = np.array(table["x"].to_pylist(), float).reshape(len(table), len(FEATURES))
    return fit(x, np.array(table["y"].to_pylist(), float))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, threshold: float = THRESHOLD, folds: int = FOLDS, rows: int = TRAIN_ROWS) -> DataFrame:
    """`docs` plus a struct `quality_score`: held_out (boolean), score (0 to 1, higher: label 1 likelier), predicted (int).

    Only statistics of the whole text enter a score; null texts score as empty ones. held_out is null for a null id.
    Labels that are null or neither 0 nor 1 teach nothing; an id labelled twice counts as 1 if any label is.
    With no labels every score is 0.5. All columns pass through (one named quality_score is replaced); an empty table gives an empty one.
    """
    docs = docs.drop("quality_score")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, rows=rows, folds=folds))
    out = docs.withColumn("quality_score", F.lit(None).cast("struct<held_out:boolean,score:double,predicted:int>"))
    text_at, id_at = docs.columns.index(text_col), docs.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(text_at)], float).reshape(-1, len(FEATURES))
            scores = forest.score(x)
            held = [None if k is None else k == 0 for k in fold(batch.column(id_at), folds)]
            made = pa.StructArray.from_arrays([pa.array(held, pa.bool_()), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["held_out", "score", "predicted"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made.cast(batch.schema.field(batch.num_columns - 1).type)], schema=batch.schema)

    return out.mapInArrow(run, out.schema)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """`docs` without those the classifier rejects (predicted 0); the columns stay."""
    return score_documents(docs, labels, **options).where("quality_score.predicted = 1").drop("quality_score")
