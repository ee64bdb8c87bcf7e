"""Near-duplicates by b-bit MinHash: bands of minima propose pairs, packed low bits estimate their similarity, full sets confirm it.

Between estimate and confirmation a parity bitmap of each set rules out pairs that differ in too many shingles; it never loses a link.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import connected_components, relabel
from .scratch import Scratch, small_batches

WIDTH, PERCENT = 2, 80
#: Minima a set, and low bits kept of each.
MINIMA, BITS = 128, 2
#: Two sets of similarity 0.8 share no band with a probability of 2e-6.
BANDS, BAND_ROWS = 25, 4
#: Standard deviations by which an estimate may fall short of the limit; a true link falls short of that once in some millions.
SLACK = 5
#: Rounds that compare each bucket with some of its sets; they save work and change no result. The first takes the set that shares most buckets
#: with others, each further one `HEADS` sets, while many pairs are still apart and a round joins a twentieth of them or more.
MOST_ROUNDS, HEADS = 8, 8
#: Pairs still apart, for each place of a set in a bucket, from which they are compared without further rounds.
APART = 0.25
#: 64-bit words of a set's mark, a parity bitmap of its shingles, and of the mark folded to fewer bits, which is compared first.
MARK, FOLD = 32, 4
#: Sets of a bucket compared with all of it by one task; a larger bucket is dealt to several.
SHARE = 500
#: A table of candidates of at most so many rows (16 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000
#: Shingles times minima that are multiplied at once, and word hashes that a task keeps.
SLICE, WORDS = 1_024, 500_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)]
_FACTORS = (np.random.default_rng(11).integers(0, 1 << 32, MINIMA, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]


class WordHashes(dict):
    """The 64-bit hash of each word seen."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def shingles(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the `width`-word shingles of `text`; fewer words are one shingle, no words none.

    A-Z become lower case and words end at ASCII white space.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(hashes) > WORDS:
        hashes.clear()
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.full(n, len(words[:width]), np.uint64)
    for i in range(min(width, len(words))):
        out = (out ^ each[i : i + n]) * _MIX[0]
        out ^= out >> np.uint64(29)
        out *= _MIX[1]
        out ^= out >> np.uint64(32)
    return np.unique(out)


def minima(found: np.ndarray) -> np.ndarray:
    """Least value of each of `MINIMA` hash functions over a set of shingles, as 32-bit numbers."""
    short = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), SLICE):
        np.minimum(out, (short[at : at + SLICE] * _FACTORS).min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key a band from its minima and its place."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[2]
    for column in least[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).T:
        out = (out ^ column) * _MIX[0]
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def pack(least: np.ndarray) -> np.ndarray:
    """The `BITS` low bits of all minima, one bit plane of `MINIMA` bits after the other, as 64-bit words.

    A minimum is mixed first: the low bits of a product depend on the low bits of the shingle alone.
    """
    mixed = least * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x85EBCA77)
    planes = [np.packbits((mixed >> np.uint32(31 - b)).astype(np.uint8) & 1) for b in range(BITS)]
    return np.concatenate(planes).view(">i8").astype(np.int64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(id, place, n, node, bands, bits) of each row of `docs` (id, text): place is the text's hash, node that of its whole set; both are null for no words."""
    kinds = pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for text in batch.column(2):
                found = shingles(text.as_py(), width, hashes)
                if not len(found):
                    rows.append((0, None, None, None))
                    continue
                least = minima(found)
                rows.append((len(found), set_number(found), band_keys(least), pack(least)))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds[2:])] if rows else [pa.array([], k) for k in kinds[2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "place", "n", "node", "bands", "bits"])

    return docs.select("id", "place", "text").mapInArrow(run, "id long, place long, n long, node long, bands array<long>, bits array<long>")


def set_number(found: np.ndarray) -> int:
    """A number of 64 bits that stands for a set of shingles."""
    return int.from_bytes(blake2b(found.tobytes(), digest_size=8).digest(), "big", signed=True)


def parity_mark(found: np.ndarray) -> np.ndarray:
    """For each of `MARK` * 64 bits whether an odd number of a set's shingles falls on it, as 64-bit words."""
    odd = np.bincount((found & np.uint64(MARK * 64 - 1)).astype(np.int64), minlength=MARK * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").astype(np.int64)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, members, mark): the shingle hashes of each row of `docs` (text), and their parity bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(text.as_py(), width, hashes) for text in batch.column(0)]
            longs = pa.list_(pa.int64())
            marks = [parity_mark(s) for s in sets]
            folds = [np.bitwise_xor.reduce(m.reshape(-1, FOLD), axis=0) for m in marks]
            columns = [pa.array([set_number(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], longs), pa.array(marks, longs), pa.array(folds, longs)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "members", "mark", "fold"])

    return docs.select("text").mapInArrow(run, "node long, members array<long>, mark array<long>, fold array<long>")


def estimate(a: str, b: str) -> Column:
    """Similarity by the packed bits `a` and `b`: the share of equal minima, less those that agree in their low bits by chance."""
    words = MINIMA // 64
    differ = " + ".join("bit_count(" + " | ".join(f"({a}[{p * words + w}] ^ {b}[{p * words + w}])" for p in range(BITS)) + ")" for w in range(words))
    chance = 2.0**-BITS
    return F.expr(f"(1 - ({differ}) / {MINIMA}D - {chance}D) / {1 - chance}D")


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes and marks allow the limit and the estimate does not rule it out; `a` and `b` are structs (n, bits, mark, fold).

    Shared shingles cancel out, so two marks differ in no more bits than the sets do in members, which at the limit is
    (100 - percent) / (100 + percent) of the sum of their sizes.
    """
    limit, chance = percent / 100, 2.0**-BITS
    equal = limit + (1 - limit) * chance
    slack = SLACK * (equal * (1 - equal) / MINIMA) ** 0.5 / (1 - chance)

    # a lambda for the long sum, since its code would be too long to be compiled
    fold = " + ".join(f"bit_count({a}.fold[{w}] ^ {b}.fold[{w}])" for w in range(FOLD))
    mark = f"aggregate(zip_with({a}.mark, {b}.mark, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)"
    first, second = (F.expr(f"{100 + percent} * ({bits}) <= {100 - percent} * ({a}.n + {b}.n)") for bits in (fold, mark))
    sizes = F.expr(f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n)")
    return sizes & first & (estimate(f"{a}.bits", f"{b}.bits") >= limit - slack) & second


def set_components(classes: DataFrame, docs: DataFrame, scratch: Scratch, width: int, percent: int) -> DataFrame:
    """(node, component) of the sets that link to another one; `classes` has a row per distinct set (node, n, bands, bits, id, place).

    First each bucket compares its sets with few of them, others each round, and what those stars join needs no further comparing. The text that many
    copies were made from is nearer to each than they are to each other, so it shares most buckets with others and is the first head. Then each set
    outside the largest component of its bucket is compared with all of the bucket that is still apart from it.
    """
    bucketed = classes.select("node", F.explode("bands").alias("band")).repartition("band")
    full = bucketed.groupBy("band").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    members = scratch.keep(bucketed.join(full, "band"))
    shared = scratch.keep(members.groupBy("node").agg(F.sum("k").alias("shared")))
    members, nodes = members.drop("k"), shared.select("node")
    wanted = scratch.keep(classes.join(nodes, "node", "left_semi").select("node", "n", "bits", "id", "place"))
    rows = wanted.select(F.col("id").alias("_id"), F.col("place").alias("_place"))
    rows = F.broadcast(rows) if wanted.count() <= BROADCAST_ROWS else rows
    texts = docs.join(rows, docs["id"].eqNullSafe(F.col("_id")) & (docs["place"] == F.col("_place")), "left_semi")
    sets = scratch.keep(full_sets(texts, width).dropDuplicates(["node"]))
    sketched = scratch.keep(wanted.join(sets.select("node", "mark", "fold"), "node").select("node", F.struct("n", "bits", "mark", "fold").alias("sketch")))

    def with_ends(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
        for end in "ab":
            pairs = pairs.join(table.select(F.col("node").alias(end), F.col(value).alias(f"{value}_{end}")), end)
        return pairs

    def step(pairs: DataFrame, placed: DataFrame) -> tuple[DataFrame, bool]:
        """Links the pairs (a, b, of_a, of_b) whose full sets reach the limit; the places with their new components, and whether any moved."""
        both = F.size(F.array_intersect("members_a", "members_b"))
        good = 100 * both >= percent * (F.size("members_a") + F.size("members_b") - both)
        found = scratch.keep(with_ends(pairs, sets, "members").where(good).select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
        if found.isEmpty():
            return placed, False
        return scratch.keep(relabel(placed.withColumnRenamed("component", "old"), connected_components(found, scratch), "old").drop("old")), True

    def pairs_apart(placed: DataFrame) -> int:
        """Pairs of sets in one bucket that are not joined yet, counted by components."""
        cells = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
        buckets = cells.groupBy("band").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
        return buckets.agg(F.coalesce(F.sum(F.col("n") * F.col("n") - F.col("same")), F.lit(0))).first()[0] // 2

    placed, tried, few, before = members.join(shared, "node").withColumn("component", F.col("node")), None, None, None
    for turn in range(MOST_ROUNDS):
        if turn:
            few = int(APART * placed.count()) if few is None else few
            left = pairs_apart(placed)
            if left <= few or (before is not None and left > 0.95 * before):
                break
            before = left
        order = [-F.col("shared")] if turn == 0 else [F.xxhash64(F.lit(turn * HEADS + i), "node") for i in range(HEADS)]
        each = F.array(*[F.min(F.struct(o.alias("turn"), "node", "component")) for o in order])
        heads = placed.groupBy("band").agg(each.alias("heads"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("band", F.explode("heads").alias("head"))
        pairs = placed.join(heads, "band").where("component <> head.component")
        pairs = pairs.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b"), F.col("component").alias("of_a"), F.col("head.component").alias("of_b")).dropDuplicates(["a", "b"])
        pairs = scratch.keep(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs.select("a", "b") if tried is None else tried.union(pairs.select("a", "b"))
        placed, more = step(with_ends(pairs, sketched, "sketch").where(may_link("sketch_a", "sketch_b", percent)).drop("sketch_a", "sketch_b"), placed)
        if not more:
            break
    cells = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("k"))
    apart = cells.groupBy("band").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.ceil(F.sum("k") / SHARE).cast("int").alias("shares"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    left_over = scratch.keep(placed.join(apart, "band").join(sketched, "node"))
    left = left_over.where("component <> main").select("band", F.col("node").alias("a"), F.col("component").alias("of_a"), F.col("sketch").alias("sketch_a"), F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("share"))
    right = left_over.select("band", F.col("node").alias("b"), F.col("component").alias("of_b"), F.col("sketch").alias("sketch_b"), "main", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    rest = left.join(right, ["band", "share"]).where("of_a <> of_b AND (of_b = main OR a < b)").where(may_link("sketch_a", "sketch_b", percent))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "of_a", "of_b").dropDuplicates(["a", "b"])
    placed, _ = step(rest.join(tried, ["a", "b"], "left_anti"), placed)
    return placed.where("node <> component").select("node", "component").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id_col, n_shingles, component_id, kept): one row per row of `docs`.

    A text's set holds its distinct `width`-word shingles (fewer words: all of them as one); sets link where the intersection is at
    least `percent` hundredths of the union. component_id is the smallest id reachable over links, and kept tells that it is the row's own. Texts
    without words (null, blank) link with nothing and are kept. A component with no id but null has a null component_id
    and is kept; repeated rows repeat. An empty table gives an empty one, and other columns of `docs` are not read.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("place"), F.col(text_col).cast("string").alias("text"))
    marked = scratch.keep(sketches(plain, width))
    known = marked.where("node IS NOT NULL")
    first = F.min(F.struct("id", "place")).alias("row")
    classes = known.groupBy("node").agg(first, F.min("id").alias("least"))
    classes = scratch.keep(classes.join(known.dropDuplicates(["node"]).select("node", "n", "bands", "bits"), "node").select("node", "n", "bands", "bits", "row.*", "least"))
    found = set_components(classes, plain, scratch, width, percent)
    placed = relabel(classes.select("node", "least"), found, "node")
    leads = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of = scratch.keep(placed.join(leads, "component").select("node", "component_id"))
    linked = known.join(of, "node").select("id", "n", "component_id")
    alone = marked.where("node IS NULL").select("id", "n", F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
