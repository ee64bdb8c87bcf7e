"""Fuzzy line deduplication: MinHash bands over character shingles, exact Jaccard, union-find.

DataFrame functions only; one line of each component stays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components, relabel
from .scratch import Scratch

SHINGLE = 10
BANDS, ROWS = 7, 3
#: Lines of at most so many characters are compared by shorter shingles as well: one changed character costs a shingle of 10
#: the limit below 99 characters, one of 5 below 49. Chance pairs share more of these, so a band takes more minima.
SHORT, SHORT_SHINGLE = 110, 5
SHORT_BANDS, SHORT_ROWS = 13, 5
#: Most rounds of comparing each bucket with some of its lines; they save work and change no result. After the first they go on
#: while many pairs are still apart, for each line of a bucket, and a round settles a twentieth of them or more.
MOST_ROUNDS = 14
APART = 20
HEADS = 8
#: 64-bit words of a line's mark, a parity bitmap of its distinct shingle hashes, and shingles of one row that makes it.
MARK, MARK_BLOCK = 32, 2
WORDS = [f"w{i}" for i in range(MARK)]
#: Lines of a bucket compared with all of it by one task; a larger bucket is dealt to several.
SHARE = 500
#: Places of a component beyond which it counts as hot.
HOT = 1_000
SIMILARITY = 0.8
#: Cells (shingles x minima) of one block in `signatures`; the code made for a block must stay small enough to be compiled.
BLOCK_CELLS = 84
#: Most minima of one aggregate.
MINIMA = 35
#: Lowest bits of a band that tell its scheme.
SCHEME_BITS = 2
#: A table of candidate line ids of at most so many rows (8 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_IDS = 500_000


def _normal(line: Column) -> Column:
    return F.lower(F.trim(line))


def _seed(j: int, n: int) -> int:
    """The j-th of n points spread evenly over the signed 32-bit numbers."""
    return (j << 32) // n - (1 << 31)


def with_chars(lines: DataFrame) -> DataFrame:
    """`lines` (line_id, line) as (line_id, chars, unit): bytes of `unit` a character, which are 2 (UTF-16) where every character has so many, else 4 (UTF-32)."""
    short = lines.select("line_id", "line", F.encode("line", "UTF-16BE").alias("chars"))
    fits = F.octet_length("chars") == 2 * F.char_length("line")
    return short.select("line_id", F.when(fits, F.col("chars")).otherwise(F.encode("line", "UTF-32")).alias("chars"), F.when(fits, 2).otherwise(4).alias("unit"))


def shingle_blocks(lines: DataFrame, shingle: int, wide: int) -> DataFrame:
    """(line_id, h0, h1 ...): 32-bit hashes of `wide` neighbouring shingles of `lines` (line_id, chars, unit) a row.

    A shorter line is one shingle. A hash is that of the shingle in UTF-16, whatever the unit. Places past the last shingle repeat it.
    """
    last = F.expr(f"greatest(1, octet_length(chars) - unit * {shingle} + 1)")
    blocks = lines.select("line_id", "chars", "unit", last.alias("last")).select("line_id", "chars", "unit", "last", F.explode(F.expr(f"sequence(1, last, unit * {wide})")).alias("at"))

    cut = blocks.select("line_id", "unit", *[F.expr(f"substring(chars, least(at + {i} * unit, last), {shingle} * unit)").alias(f"s{i}") for i in range(wide)])
    return cut.select("line_id", *[F.expr(f"hash(IF(unit = 2, s{i}, encode(decode(s{i}, 'UTF-32'), 'UTF-16BE')))").alias(f"h{i}") for i in range(wide)])


def signatures(lines: DataFrame, bands: int, rows: int, shingle: int, scheme: int = 0) -> DataFrame:
    """(line_id, band): one row per line and band, from `lines` (line_id, chars, unit); the lowest `SCHEME_BITS` of a band are its scheme.

    The j-th minimum is that of hash XOR c_j for points c_j spread over the hash range: the shingle
    nearest to c_j in the XOR order. Any shingle of a union is equally likely to be it, so two lines
    agree with a probability equal to their Jaccard similarity, and one hash a shingle serves all. Hashes of 32 bits make
    the minima half as long; where two shingles share one, a pair too many is compared.
    The least values of a block of neighbouring shingles are taken before any grouping.
    """
    n = bands * rows
    parts = -(-n // MINIMA)
    own = -(-bands // parts)
    wide = max(2, BLOCK_CELLS // (own * rows))
    hashed = shingle_blocks(lines, shingle, wide)
    point, keys = {}, ["line_id"]
    if parts > 1:
        # many minima in one aggregate make code too long to be compiled, so a part of the bands is a group of its own
        hashed, keys = hashed.withColumn("part", F.explode(F.array(*[F.lit(k) for k in range(parts)]))), ["line_id", "part"]
    for j in range(own * rows):
        point[j] = F.lit(_seed(j, n)).cast("int")
        for k in range(1, parts):
            point[j] = F.when(F.col("part") == k, F.lit(_seed(min(k * own * rows + j, n - 1), n)).cast("int")).otherwise(point[j])
    least = hashed.select(*keys, *[F.least(*[F.col(f"h{i}").bitwiseXOR(c) for i in range(wide)]).alias(f"m{j}") for j, c in point.items()])
    minima = least.groupBy(*keys).agg(*[F.min(f"m{j}").alias(f"m{j}") for j in point])
    place = F.col("part") if parts > 1 else F.lit(0)
    found = [F.when(place * own + i < bands, F.xxhash64(F.lit(shingle), place * own + i, *[f"m{i * rows + r}" for r in range(rows)])) for i in range(own)]
    bands_of = minima.select("line_id", F.explode(F.array(*found)).alias("band"))
    return bands_of.where("band IS NOT NULL").select("line_id", F.expr(f"shiftleft(band, {SCHEME_BITS}) | {scheme}L").alias("band"))


def _hashes(chars: str, shingle: int, as_utf16: bool = False) -> str:
    """SQL for the shingle hashes of a column of `unit` bytes a character, repeats included; the outer lambda reads the bytes once, not once a shingle.

    With `as_utf16` a hash is that of the shingle in UTF-16 whatever the unit, else lines of one unit alone compare.
    """
    def of(unit: int) -> str:
        own = f"substring(c, p, {unit * shingle})"
        own = f"encode(decode({own}, 'UTF-32'), 'UTF-16BE')" if as_utf16 and unit == 4 else own
        return f"transform(sequence(1, greatest(1, octet_length(c) - {unit * shingle} + 1), {unit}), p -> xxhash64({own}))"

    return f"transform(array({chars}), c -> IF(unit = 2, {of(2)}, {of(4)}))[0]"


def marks(lines: DataFrame, shingle: int) -> DataFrame:
    """(line_id, w0, w1 ..., n): per line (line_id, line) words of 64 bits, on hold for each bit whether an odd number of its distinct shingles falls on it; `n` counts them.

    A line's distinct shingles are an array of its row, so nothing is grouped by shingle; the words are made from blocks of that array.
    """
    chars = with_chars(lines).select("line_id", "chars", "unit")
    sets = chars.select("line_id", F.array_distinct(F.expr(_hashes("chars", shingle, True))).alias("hashes"))
    blocks = sets.select("line_id", "hashes", F.size("hashes").alias("n")).select("line_id", "hashes", "n", F.explode(F.expr(f"sequence(0, n - 1, {MARK_BLOCK})")).alias("at"))
    places = range(MARK_BLOCK)
    # past the last shingle stands a null, which sets no bit
    found = blocks.select("line_id", "n", *[F.expr(f"get(hashes, at + {i})").alias(f"h{i}") for i in places])
    cut = found.select(
        "line_id", "n", *[F.expr(f"coalesce(CAST(shiftrightunsigned(h{i}, 6) & {MARK - 1} AS INT), -1)").alias(f"word{i}") for i in places],
        *[F.expr(f"coalesce(shiftleft(1L, CAST(h{i} & 63 AS INT)), 0L)").alias(f"bit{i}") for i in places],
    )
    words = cut.select("line_id", "n", *[F.expr(" ^ ".join(f"IF(word{i} = {k}, bit{i}, 0L)" for i in places)).alias(w) for k, w in enumerate(WORDS)])
    return words.groupBy("line_id").agg(*[F.bit_xor(w).alias(w) for w in WORDS], F.max("n").alias("n"))


def may_be_similar(similarity: float) -> Column:
    """False only for lines that cannot reach the limit, told by their sizes `n_a`, `n_b` and the words of `mark_a`, `mark_b`.

    Shared shingles cancel out, so two marks differ in no more bits than the shingle sets differ in
    members, which at the limit is (1 - limit) / (1 + limit) of the sum of the sizes. A join's condition of
    all words once, in structs, is code short enough to be compiled.
    """
    apart = " + ".join(f"bit_count(mark_a.{w} ^ mark_b.{w})" for w in WORDS)
    return F.expr(f"least(n_a, n_b) >= {similarity}D * greatest(n_a, n_b) - 1e-6D AND {apart} <= {(1 - similarity) / (1 + similarity)}D * (n_a + n_b) + 1e-6D")


def each_once(pairs: DataFrame) -> DataFrame:
    """(a, b, scheme, of_a, of_b, n): each pair of lines once; `n` is the sum of their sizes."""
    return pairs.groupBy("a", "b", "scheme").agg(*[F.min(x).alias(x) for x in ("of_a", "of_b")], F.min(F.expr("n_a + n_b")).alias("n"))


@dataclass(frozen=True)
class Scheme:
    """How lines of `least` to `most` characters are compared: shingle size, bands and minima a band."""

    shingle: int
    bands: int
    rows: int
    least: int = 1
    most: int | None = None


def line_places(docs: DataFrame, text: str) -> DataFrame:
    """(doc, text_hash, at, line_id, line): the places of all lines that are not blank."""
    cut = docs.select("doc", "text_hash", F.posexplode(F.split(text, "\n")).alias("at", "line")).where("trim(line) <> ''").withColumn("line", _normal(F.col("line")))
    return cut.select("doc", "text_hash", "at", F.xxhash64("line").alias("line_id"), "line")


def line_components(lines: DataFrame, scratch: Scratch, schemes: list[Scheme], similarity: float) -> DataFrame:
    """(node, component) of the lines (line_id, line; copies allowed) that some scheme links to another line.

    In a first round every band bucket compares its lines with one of them, in further ones with several, its heads. A
    head has then met its whole bucket and leaves it, and a bucket of which one component is left is done, so
    pairs are done with after one round and later rounds see large buckets only. Then every pair of a bucket whose ends are
    still apart is compared as well, so no link between components is lost, and a group of near copies
    costs some stars, not a square. Pairs whose marks rule them out go first; the rest are read as whole lines.
    """
    size = F.char_length("line")
    bucketed = None
    for k, s in enumerate(schemes):
        source = lines.where((size >= s.least) & (F.lit(True) if s.most is None else size <= s.most))
        # copies of short lines are many and cheap to bring together
        source = source if s.most is None else source.dropDuplicates(["line_id"])
        rows = signatures(with_chars(source), s.bands, s.rows, s.shingle, k)
        bucketed = rows if bucketed is None else bucketed.union(rows)
    # one shuffle and one sort serve both windows; the second sees only the few buckets of several lines
    bucket = Window.partitionBy("band")
    full = bucketed.select("*", F.min("line_id").over(bucket).alias("x"), F.max("line_id").over(bucket).alias("y")).where("x <> y")
    members = scratch.keep(full.select("band", "line_id", F.min_by("line_id", F.xxhash64(F.lit(0), "line_id")).over(bucket).alias("head")))
    ids = scratch.keep(members.select("line_id").distinct())
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = scratch.keep(lines.join(wanted, "line_id", "left_semi").dropDuplicates(["line_id"]))
    scheme = F.col("band").bitwiseAND(F.lit((1 << SCHEME_BITS) - 1)).cast("int")
    marked = None
    for k, s in enumerate(schemes):
        made = marks(texts.where((size >= s.least) & (F.lit(True) if s.most is None else size <= s.most)), s.shingle).withColumn("scheme", F.lit(k))
        marked = made if marked is None else marked.union(made)
    marked = scratch.keep(marked)
    def mark_of(end: str) -> list[Column]:
        return [F.struct(*WORDS).alias(f"mark_{end}"), F.col("n").alias(f"n_{end}")]

    def linked(pairs: DataFrame) -> DataFrame:
        for end in "ab":
            pairs = pairs.join(texts.select(F.col("line_id").alias(end), F.col("line").alias(f"line_{end}")), end)
        pairs = pairs.withColumns({f"short_{end}": F.encode(f"line_{end}", "UTF-16BE") for end in "ab"})
        fits = F.expr(" AND ".join(f"octet_length(short_{end}) = 2 * char_length(line_{end})" for end in "ab"))
        pairs = pairs.withColumns({f"chars_{end}": F.when(fits, F.col(f"short_{end}")).otherwise(F.encode(f"line_{end}", "UTF-32")) for end in "ab"}).withColumn("unit", F.when(fits, 2).otherwise(4))
        sets = {end: F.expr("CASE " + " ".join(f"WHEN scheme = {k} THEN {_hashes(f'chars_{end}', s.shingle)}" for k, s in enumerate(schemes)) + " END") for end in "ab"}
        # a generator keeps the filter from taking the count into itself, where each use would build the sets anew
        pairs = pairs.select("a", "b", "of_a", "of_b", "n", F.explode(F.array(F.size(F.array_intersect(sets["a"], sets["b"])))).alias("shared"))
        return pairs.where(f"shared >= {similarity}D * (n - shared)").select("a", "b", "of_a", "of_b")

    def step(pairs: DataFrame, *frames: DataFrame) -> tuple[DataFrame, ...]:
        """Links the pairs (a, b, scheme, of_a, of_b, n_a, n_b) that are similar; the frames with their new components."""
        found = scratch.keep(linked(scratch.keep(each_once(pairs))))
        if found.isEmpty():
            return frames
        moved = connected_components(found.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")), scratch)
        return tuple(scratch.keep(relabel(x.withColumnRenamed("component", "old"), moved, "old").drop("old")) for x in frames)

    def pairs_apart(rows: DataFrame) -> int:
        """Pairs of lines in one bucket that are not joined yet, counted by components."""
        cells = rows.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
        buckets = cells.groupBy("band").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
        return buckets.agg(F.coalesce(F.sum(F.col("n") * F.col("n") - F.col("same")), F.lit(0))).first()[0] // 2

    def ordered(rows: DataFrame) -> DataFrame:
        """Pairs of a line and a head, smaller id first."""
        swap = F.col("line_id") > F.col("head")
        ends = [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(n) for x, y, n in (("line_id", "head", "a"), ("head", "line_id", "b"), ("component", "of_head", "of_a"), ("of_head", "component", "of_b"))]
        return rows.select(*ends, scheme.alias("scheme"), "n_a", "n_b")

    labels = ids.withColumn("component", F.col("line_id"))
    rows = members.where("line_id <> head")
    pairs = rows.select(F.least("line_id", "head").alias("a"), F.greatest("line_id", "head").alias("b"), scheme.alias("scheme")).distinct()
    for end in "ab":
        pairs = pairs.join(marked.select(F.col("line_id").alias(end), "scheme", *mark_of(end)), [end, "scheme"])
    pairs = pairs.where(may_be_similar(similarity)).withColumns({"of_a": F.col("a"), "of_b": F.col("b")})
    rows, labels = step(pairs, rows.select("band", "line_id", F.col("line_id").alias("component")), labels)
    ends = F.min("component").alias("x"), F.max("component").alias("y")
    split = rows.groupBy("band").agg(*ends).where("x <> y").select("band")
    rows = scratch.keep(rows.join(split, "band").withColumn("scheme", scheme).join(marked, ["line_id", "scheme"]).drop("scheme"))
    few, before = int(APART * members.count()), None
    for turn in range(1, MOST_ROUNDS):
        left = pairs_apart(rows)
        if left <= few or (before is not None and left > 0.95 * before):
            break
        before = left
        # several lines of a bucket are heads at once, and the marks are tested inside the join
        each = [F.min_by("line_id", F.xxhash64(F.lit(turn * HEADS + k), "line_id")) for k in range(HEADS)]
        heads = rows.groupBy("band").agg(F.array_distinct(F.array(*each)).alias("heads"), *ends).where("x <> y")
        heads = scratch.keep(heads.select("band", F.explode("heads").alias("line_id")))
        known = rows.join(heads, ["band", "line_id"]).select("band", F.col("line_id").alias("head"), F.col("component").alias("of_head"), *mark_of("b"))
        own = rows.select("band", "line_id", "component", *mark_of("a"))
        pairs = ordered(own.join(known, "band").where("component <> of_head").where(may_be_similar(similarity)))
        rows, labels = step(pairs, rows.join(heads, ["band", "line_id"], "left_anti"), labels)
    split = rows.groupBy("band").agg(*ends, F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares")).where("x <> y").select("band", "shares")
    apart = rows.join(split, "band").withColumn("scheme", scheme)
    left, right = (apart.select("band", "scheme", "shares", F.col("line_id").alias(n), F.col("component").alias(f"of_{n}"), *mark_of(n)) for n in "ab")
    left = left.withColumn("share", F.pmod(F.xxhash64("a"), F.col("shares")).cast("int")).drop("shares")
    right = right.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares", "scheme")
    rest = left.join(right, ["band", "share"]).where("of_a <> of_b AND a < b").where(may_be_similar(similarity))
    (labels,) = step(rest, labels)
    return labels.where("line_id <> component").select(F.col("line_id").alias("node"), "component")


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    bands: int = BANDS,
    rows: int = ROWS,
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """`docs` with repeated lines removed from the text, and the columns n_lines, n_dropped (long).

    Lines are compared trimmed and in lower case, as sets of all their `shingle`-character substrings;
    lines of at most `SHORT` characters also as sets of their substrings of `SHORT_SHINGLE`, of which either similarity links them.
    Of each component the first line stays: smallest id (nulls first), then text hash, then place.
    A line shorter than a short shingle is one shingle, so it links with its copies alone; blank lines always stay. A null text
    stays null with no lines; rows equal in id and text are one document and keep the same lines; all
    other columns pass through (n_lines and n_dropped are replaced). An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "lines", "zstd")
    plain = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("body")).withColumn("text_hash", F.xxhash64("body"))
    schemes = [Scheme(shingle, bands, rows, least=shingle), Scheme(SHORT_SHINGLE, SHORT_BANDS, SHORT_ROWS, most=max(SHORT, shingle))]
    places = scratch.keep(line_places(plain, "body"))
    found = line_components(places.select("line_id", "line"), scratch, schemes, similarity)
    places = scratch.keep(relabel(places, found, "line_id").select("doc", "text_hash", "at", "component"))
    place = F.struct("doc", "text_hash", "at")
    first = places.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    first = scratch.keep(first)
    hot = first.where(F.col("n") > HOT)
    # rows of components with many places meet their first place by broadcast, so that no task gets all of them
    if 0 < hot.count() <= BROADCAST_IDS:
        held = places.join(F.broadcast(hot), "component", "left")
        known = held.where("first IS NOT NULL").select("doc", "text_hash", "at", "first")
        others = held.where("first IS NULL").drop("n", "first").join(first.where(F.col("n") <= HOT), "component").select("doc", "text_hash", "at", "first")
        met = known.union(others)
    else:
        met = places.join(first, "component")
    drops = met.where(~place.eqNullSafe(F.col("first"))).groupBy(F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.collect_set("at").alias("_drops"))
    drops = scratch.keep(drops)
    joined = docs.join(drops, docs[id_col].eqNullSafe(drops["_doc"]) & (F.xxhash64(docs[text_col]) == drops["_hash"]), "left")
    cut = F.split(docs[text_col], "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), drops["_drops"])
    # The outer lambda cuts the text once, not once a line.
    kept = F.transform(F.array(F.struct(cut.alias("cut"), stay.alias("stay"))), lambda z: F.array_join(F.transform(z["stay"], lambda i: F.get(z["cut"], i)), "\n"))[0]
    text = F.when(drops["_drops"].isNull(), docs[text_col]).otherwise(kept)
    return joined.select(
        *[text.alias(c) if c == text_col else docs[c] for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.coalesce(F.when(docs[text_col].isNull(), 0).otherwise(F.size(cut)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(drops["_drops"]), F.lit(0)).cast("long").alias("n_dropped"),
    )
