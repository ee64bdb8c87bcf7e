"""SimHash near-duplicates by multi-index hashing over fingerprint segments."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components, relabel
from .scratch import Scratch, small_batches

BITS, SEGMENTS, DISTANCE = 64, 3, 4
WIDTH = 4
SEED = 42
#: Distinct fingerprints beyond which two segments are used: balls of radius 2 cost 16 times the look-ups, but a look-up then finds
#: 2,048 times fewer fingerprints, and those found by chance grow with the square of the table.
TWO_SEGMENTS_FROM = 30_000_000
#: Shingle hashes turned into bits at once.
SLICE = 16_384


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """64-bit SimHash of the word shingles of `text`, as a signed number; no words give 0.

    A-Z become lower case, words end at ASCII white space, each shingle counts as often as it occurs.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, SLICE):
        digests = b"".join(xxhash.xxh64_digest(b" ".join(words[i : i + width]), SEED) for i in range(at, min(n, at + SLICE)))
        votes += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big", signed=True)


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """(id, fp): one row per row of `docs`; whole texts go to the tasks in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), width) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["id", "fp"])

    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, "id long, fp long")


def segments(n: int = SEGMENTS) -> list[tuple[int, int]]:
    """(shift, width) of `n` near-equal segments of the fingerprint."""
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def balls(n: int = SEGMENTS, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(segment, mask) of each Hamming ball: of `n` segments, one differs in at most distance // n bits."""
    return [
        (s, sum(1 << b for b in bits))
        for s, (_, width) in enumerate(segments(n))
        for radius in range(distance // n + 1)
        for bits in combinations(range(width), radius)
    ]


def fingerprint_components(fps: DataFrame, scratch: Scratch, *, n_segments: int = SEGMENTS, distance: int = DISTANCE) -> DataFrame:
    """(node, component) of the distinct fingerprints `fps` (fp) that link to another one.

    The table holds each fingerprint under the value of each segment. First the fingerprints of one
    value link to the smallest of them, which joins most of a large group at the cost of a star.
    Then every fingerprint looks up all values in its balls, and each pair still apart is verified.
    """
    values = [F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)) for shift, width in segments(n_segments)]
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance

    def table(frame: DataFrame, *more: str) -> DataFrame:
        return frame.select(*more, F.col("fp").alias("other"), F.posexplode(F.array(*values)).alias("segment", "value"))

    heads = table(fps).groupBy("segment", "value").agg(F.min("other").alias("fp"), F.max("other").alias("last")).where("fp <> last")
    star = table(fps).join(heads.drop("last"), ["segment", "value"]).where(near & (F.col("fp") != F.col("other")))
    star = scratch.keep(star.select(F.col("fp").alias("a"), F.col("other").alias("b")).distinct())
    placed = scratch.keep(relabel(fps, connected_components(star, scratch), "fp"))
    ball = ", ".join(f"named_struct('s', {s}, 'm', {m}L)" for s, m in balls(n_segments, distance))
    probes = placed.select("fp", "component", F.array(*values).alias("own"), F.explode(F.expr(f"array({ball})")).alias("ball"))
    probes = probes.select("fp", "component", F.col("ball.s").alias("segment"), F.expr("own[ball.s] ^ ball.m").alias("value"))
    found = probes.join(table(placed, F.col("component").alias("there")), ["segment", "value"])
    found = found.where((F.col("fp") < F.col("other")) & (F.col("component") != F.col("there")) & near)
    more = scratch.keep(found.select(F.col("fp").alias("a"), F.col("other").alias("b")).distinct())
    return connected_components(star.union(more), scratch)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n_segments: int | None = None, distance: int = DISTANCE) -> DataFrame:
    """(id_col, fingerprint as 16 hex digits, component_id): one row per row of `docs`.

    component_id is the smallest id reachable over links of at most `distance` differing bits, so equal
    fingerprints share it; texts without words (null, blank) have fingerprint zero and link like any other.
    A component with no id but null has a null component_id; repeated rows repeat. An empty table
    gives an empty one, and other columns of `docs` are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.keep(with_fingerprints(docs, id_col, text_col))
    classes = scratch.keep(marked.groupBy("fp").agg(F.min("id").alias("least")))
    if n_segments is None:
        n_segments = SEGMENTS if classes.count() <= TWO_SEGMENTS_FROM else 2
    found = fingerprint_components(classes.select("fp"), scratch, n_segments=n_segments, distance=distance)
    placed = relabel(classes, found, "fp")
    leads = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of = scratch.keep(placed.join(leads, "component").select("fp", "component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(of, "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one document of each near-duplicate group: the one with the smallest id (rows equal in id and text: one of them).

    Groups are formed by text, so rows that share an id or have none but differ in text are told apart.
    A row with a null id stays only where no row of its group has an id. The columns stay.
    """
    digest = F.xxhash64(docs[text_col])
    groups = near_duplicates(docs.select(digest.alias("_hash"), docs[text_col].alias("_text")), "_hash", "_text", **options)
    groups = groups.select("_hash", "component_id").distinct()
    keys = docs.select(docs[id_col].alias("_id"), digest.alias("_hash"))
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_hash")).alias("first")
    stays = keys.join(groups, "_hash").groupBy("component_id").agg(first).select("first._id", "first._hash")
    stays = Scratch(docs.sparkSession, "stays").keep(stays)
    return docs.join(stays, docs[id_col].eqNullSafe(stays["_id"]) & (digest == stays["_hash"]), "left_semi").dropDuplicates([id_col, text_col])
