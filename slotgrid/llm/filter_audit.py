"""What a chain of document filters removes in every order, from a sparse document-term matrix with global word numbers.

Filters: A fewer than 50 words, B few distinct words, C many capitals, D odd characters, E a copy of a document with a smaller id.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, small_batches

FILTERS = "ABCDE"
#: The limits of the filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
ODD = b"#$%&*|"
#: Bytes of text and distinct words of one shard of the matrix, beyond which a further text starts the next one.
SHARD_BYTES, SHARD_WORDS = 40_000_000, 800_000
#: Bytes of text of one block of a shard's rows, and words of one row of its words: no row holds a whole shard, nor does a worker hold a shard's matrix.
BLOCK_BYTES, WORDS = 250_000, 30_000
#: Bytes that a document counts beside its text, so that blocks of empty texts end too.
DOC_BYTES = 80
#: Bytes of a row group of the stored shards, which a reader holds whole, and numbers that a task gathers before it hands them on.
GROUP_BYTES, HELD = 16_000_000, 500_000
#: Bytes of a long text that are cut into words at once.
PIECE = 1_000_000
#: Bits of a place that hold the position of a word in its shard, and the shards that one task may make.
AT_BITS, MOST_SHARDS = 28, 1 << 14
SPACE = re.compile(rb"[ \t-\r]")


def pieces(text: bytes) -> Iterator[bytes]:
    """Parts of a text of about `PIECE` bytes that end between two words."""
    at = 0
    while len(text) - at > PIECE:
        found = SPACE.search(text, at + PIECE)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


class Shard:
    """Rows of the matrix, handed on in blocks, with word numbers of the shard's own, in the order of first occurrence, and what the other filters need of each text."""

    def __init__(self, number: int) -> None:
        self.number, self.size = number, 0
        # a counter, as a dictionary whose default is its own length refers to itself and outlives its shard
        self.words: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.clear()

    def clear(self) -> None:
        self.held = 0
        self.ids, self.parts, self.points, self.capitals, self.odd, self.digests = [], [], [], [], [], []
        self.numbers = []

    def add(self, doc: int | None, part: str, text: bytes) -> None:
        self.numbers.append(np.concatenate([np.fromiter(map(self.words.__getitem__, found := p.split()), np.int64, len(found)) for p in pieces(text)]))
        if len(self.words) >> AT_BITS:
            raise ValueError("a text has too many distinct words")
        points = np.frombuffer(text, np.uint8)
        self.ids.append(doc)
        self.parts.append(part)
        self.points.append(int(np.count_nonzero((points & 0xC0) != 0x80)))
        self.capitals.append(int(np.count_nonzero((points >= 65) & (points <= 90))))
        self.odd.append(any(c in text for c in ODD))
        self.digests.append(xxhash.xxh3_128_digest(text))
        self.size += len(text) + DOC_BYTES
        self.held += len(text) + DOC_BYTES

    def block(self) -> pa.RecordBatch:
        """One row with the documents since the last block; a column of the matrix is stored as its difference from the one before it in the block."""
        rows = np.repeat(np.arange(len(self.ids)), [len(x) for x in self.numbers])
        cells, counts = np.unique(rows << AT_BITS | np.concatenate(self.numbers), return_counts=True)
        columns = (cells & ((1 << AT_BITS) - 1)).astype(np.int32)
        one = {
            "ids": self.ids, "parts": self.parts, "points": self.points, "capitals": self.capitals, "odd": self.odd, "digests": self.digests,
            "starts": np.searchsorted(cells >> AT_BITS, np.arange(len(self.ids) + 1)).astype(np.int32), "steps": np.diff(columns, prepend=np.int32(0)), "counts": counts.astype(np.int32),
        }
        self.clear()
        return _row(self.number, one)

    def dictionary(self) -> Iterator[pa.RecordBatch]:
        """Rows with the words of the shard, of which `first` is the number of the first."""
        rest = iter(self.words)
        for first in range(0, len(self.words), WORDS):
            yield _row(self.number, {"first": first, "words": list(islice(rest, WORDS))})


KINDS = {
    "shard": pa.int64(), "ids": pa.list_(pa.int64()), "parts": pa.list_(pa.string()), "points": pa.list_(pa.int64()), "capitals": pa.list_(pa.int64()), "odd": pa.list_(pa.bool_()),
    "digests": pa.list_(pa.binary()), "starts": pa.list_(pa.int32()), "steps": pa.list_(pa.int32()), "counts": pa.list_(pa.int32()), "first": pa.int32(), "words": pa.list_(pa.binary()),
}
SHARDS = (
    "shard long, ids array<long>, parts array<string>, points array<long>, capitals array<long>, odd array<boolean>, digests array<binary>, "
    "starts array<int>, steps array<int>, counts array<int>, first int, words array<binary>"
)


def _row(number: int, one: dict) -> pa.RecordBatch:
    """One row of the shards; what `one` lacks is null."""
    return pa.RecordBatch.from_arrays([pa.array([number if name == "shard" else one.get(name)], kind) for name, kind in KINDS.items()], names=list(KINDS))


def shards(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """Rows of shards of about `SHARD_BYTES` of text: blocks of documents, where `ids` is not null, and the words of the shard; no document is split."""
    most, most_words, most_block = SHARD_BYTES, SHARD_WORDS, BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(TaskContext.get().partitionId() * MOST_SHARDS)
        last = shard.number + MOST_SHARDS - 1
        for batch in batches:
            for doc, part, text in zip(*(column.to_pylist() for column in batch.columns)):
                if shard.ids and shard.held + len(text) > most_block:
                    yield shard.block()
                if shard.size and (shard.size + len(text) > most or len(shard.words) > most_words) and shard.number < last:
                    if shard.ids:
                        yield shard.block()
                    yield from shard.dictionary()
                    shard = Shard(shard.number + 1)
                shard.add(doc, part, text)
        if shard.ids:
            yield shard.block()
        yield from shard.dictionary()

    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    return plain.mapInArrow(run, SHARDS)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (place, number) gathered by shard, as (shard, at, number), both lists; a shard may have several."""
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        place, number = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(2))
        held.clear()
        order = np.argsort(place)
        place, number = place[order], number[order]
        shard, first = np.unique(place >> AT_BITS, return_index=True)
        offsets = pa.array(np.append(first, len(place)).astype(np.int32))
        at = pa.array((place & ((1 << AT_BITS) - 1)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(shard), pa.ListArray.from_arrays(offsets, at), pa.ListArray.from_arrays(offsets, pa.array(number))], names=["shard", "at", "number"])

    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= HELD:
            yield out()
            n = 0
    if n:
        yield out()


def numbered(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """Blocks of shards, each shard's in one partition behind rows with `at` and `number` for those of its words that a shard before has too.

    A word's global number is the smallest place (shard and position there) that it has, so one shuffle by word numbers all of them, and only words
    whose number is not their own place are sent back. A row is a distinct word of a shard, not an occurrence: a frequent word has a row a shard.
    Words are maximal runs without ASCII white space; a null text is empty.
    """
    # small row groups, as a reader holds the arrays of a whole one
    found = scratch.keep(shards(docs, id_col, text_col, part_col), **{"compression": "zstd", "parquet.block.size": str(GROUP_BYTES)})
    own = found.where("words IS NOT NULL").select("shard", "first", F.posexplode("words").alias("at", "word"))
    own = own.select((F.shiftleft("shard", AT_BITS) + F.col("first") + F.col("at")).alias("place"), "word")
    own = own.select("place", F.min("place").over(Window.partitionBy("word")).alias("number")).where("number <> place")
    codes = own.mapInArrow(_pack, "shard long, at array<int>, number array<long>")
    rows = found.where("ids IS NOT NULL").drop("first", "words").unionByName(codes, allowMissingColumns=True)
    return rows.repartition("shard").sortWithinPartitions("shard", F.col("ids").isNotNull())


def _global(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
    """For each block of numbered shards its `names` and its columns as global ones: the number sent back for a word, else its own place."""
    shard, at, number = None, [], []
    codes = np.zeros(0, np.int64)
    for batch in batches:
        for i in range(batch.num_rows):
            if (here := batch.column("shard")[i].as_py()) != shard:
                shard, at, number, codes = here, [], [], np.zeros(0, np.int64)
            if not batch.column("ids")[i].is_valid:
                at.append(batch.column("at").slice(i, 1).flatten().to_numpy())
                number.append(batch.column("number").slice(i, 1).flatten().to_numpy())
                continue
            if at:
                all_at = np.concatenate(at)
                codes = (shard << AT_BITS) + np.arange(all_at.max() + 1, dtype=np.int64)
                codes[all_at] = np.concatenate(number)
                at, number = [], []
            own = np.cumsum(batch.column("steps").slice(i, 1).flatten().to_numpy(), dtype=np.int64)
            columns = (shard << AT_BITS) + own
            back = own < len(codes)
            columns[back] = codes[own[back]]
            yield [batch.column(name).slice(i, 1) for name in names], columns


def document_term_matrix(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(ids, starts, columns, counts): `docs` as CSR blocks whose columns are global word numbers; row i of a block is the document ids[i]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, starts, counts), found in _global(batches, ["ids", "starts", "counts"]):
            columns = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found))
            yield pa.RecordBatch.from_arrays([ids, starts, columns, counts], names=["ids", "starts", "columns", "counts"])

    return numbered(docs, scratch, id_col, text_col, part_col).mapInArrow(run, "ids array<long>, starts array<int>, columns array<long>, counts array<int>")


def measures(found: DataFrame) -> DataFrame:
    """One row per document of numbered shards: row sums and nonzero counts of the matrix as n_words and n_distinct, and what the shard holds of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists, columns in _global(batches, ["starts", "counts", "ids", "parts", "points", "capitals", "odd", "digests"]):
            starts, counts, *same = (x.flatten() for x in lists)
            starts, filled = starts.to_numpy(), columns >= 0
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (counts.to_numpy().astype(np.int64), filled)]
            words, distinct = (pa.array((x[starts[1:]] - x[starts[:-1]]).astype(np.int64)) for x in sums)
            yield pa.RecordBatch.from_arrays([*same, words, distinct], names=["id", "part", "points", "capitals", "odd", "digest", "n_words", "n_distinct"])

    return found.mapInArrow(run, "id long, part string, points long, capitals long, odd boolean, digest binary, n_words long, n_distinct long")


def failures(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask): one row per row of `docs`; bit i of mask tells that it fails filter i."""
    known = scratch.keep(measures(numbered(docs, scratch, id_col, text_col, part_col)))
    # written apart, so that the join below has an exchange of its own for each side and can split a hot text
    copies = scratch.keep(known.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("digest", "first"))
    fails = [
        F.col("n_words") < LEAST_WORDS,
        100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"),
        100 * F.col("capitals") > MOST_CAPITALS * F.col("points"),
        F.col("odd"),
        F.coalesce(F.col("first") < F.col("id"), F.lit(False)),
    ]
    mask = sum((c.cast("int") * (1 << i) for i, c in enumerate(fails)), F.lit(0))
    return known.join(copies, "digest", "left").select("id", "part", mask.alias("mask"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step: what the step keeps and removes, and what that costs.

    part (string), filter_order, step (1 to 5), the letter of the step's filter, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley (long). Every part has all 600 rows. A null text is empty, a null part the empty string; a row without
    an id is a copy of none and makes none; repeated rows count each. Of several labels of one id any that is 1 counts;
    labels without an id count for none. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "filter-audit")
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(*[F.max((F.col(c) == 1).cast("long")).alias(c) for c in ("quality", "toxic")])
    rows = failures(docs, scratch, id_col, text_col, part_col).join(scratch.keep(marks), "id", "left")
    cells = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("quality", "toxic")])
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "quality", "toxic")).alias("cells"))  # 32 masks at most

    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)]))
    steps = parts.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = "aggregate(filter(split({}, ''), x -> x <> ''), 0, (a, x) -> a | shiftleft(1, ascii(x) - ascii('A')))"
    steps = steps.withColumns({"bit": F.expr(bits.format("substring(filter_order, step, 1)")), "before": F.expr(bits.format("substring(filter_order, 1, step - 1)"))})

    def total(condition: str, value: str) -> Column:
        return F.expr(f"aggregate(filter(cells, c -> {condition}), 0L, (a, c) -> a + c.{value})")

    here = "c.mask & before = 0 AND c.mask & bit <> 0"
    out = steps.select(
        "part", "filter_order", "step", F.substr("filter_order", F.col("step"), F.lit(1)).alias("letter"),
        total("c.mask & (before | bit) = 0", "n").alias("kept"), total(here, "n").alias("removed"),
        total("c.mask & before <> 0 AND c.mask & bit <> 0", "n").alias("redundant"), total("c.mask = bit", "n").alias("unique_fails"),
        total(here, "quality").alias("good_lost"), total(here, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter")))
