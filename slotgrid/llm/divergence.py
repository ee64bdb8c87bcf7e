"""How far the sources of a language differ in their words: joint tables of count levels from one-hot level products.

A level is a count that a term has in a group, one source of one language. The indicator columns of all (group, level), a row a term,
times their transpose count the terms of every pair of levels; a divergence is the price of each pair of levels times its count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filter_audit import pieces
from .scratch import Scratch, small_batches

UNIT = 1_000_000_000
LEAST_DOCS, TERMS = 10, 10
#: Distinct (group, term) that a task counts before it hands them on.
HELD = 200_000
#: Terms of one block, dealt to one task, and of one product within it; a product has at most so many levels a group.
BLOCK, ROWS = 2_048, 64
#: Groups of one tile; each pair of tiles is a product of its own.
TILE = 32
#: A-Z in lower case, and a space for each other ASCII character that is no letter: bytes of other code points are all kept.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def count_terms(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; a row with a null term marks that the group occurs.

    Each task counts its texts and hands on sums, so no text and no single occurrence is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in groups.items():
                n = len(terms) + 1
                counts = np.array([(0, 0), *terms.values()], np.int64)
                columns = [pa.repeat(pa.scalar(lang), n), pa.repeat(pa.scalar(source), n), pa.array([None, *terms], pa.binary()), pa.array(counts[:, 0]), pa.array(counts[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            groups.clear()

        for batch in batches:
            for lang, source, text in zip(*(column.to_pylist() for column in batch.columns)):
                terms = groups.setdefault((lang, source), {})
                before, seen = len(terms), {}
                for piece in pieces(text.translate(LETTERS)):
                    for word in piece.split():
                        seen[word] = seen.get(word, 0) + 1
                for word, n in seen.items():
                    if (pair := terms.get(word)) is None:
                        terms[word] = [n, 1]
                    else:
                        pair[0] += n
                        pair[1] += 1
                held += len(terms) - before
            if held > HELD:
                yield from out()
                held = 0
        yield from out()

    small_batches(docs.sparkSession)
    empty = F.lit("")
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))], F.coalesce(F.col(text_col).cast("string"), empty).cast("binary").alias("text"))
    found = plain.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def level_price(levels: np.ndarray, total: int, v: int) -> np.ndarray:
    """The scaled smoothed share 1 + floor(UNIT * (level + 2) / (total + 2 * v)) of each level, in whole numbers of any size."""
    return np.array([1 + UNIT * (level + 2) // (total + 2 * v) for level in levels.tolist()], np.int64)


def one_hot(counts: np.ndarray, totals: list[int], v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indicator, group, price) of the levels of `counts` (terms by groups): a column per level of a group, in which the terms of that level are 1."""
    columns, group, price = [], [], []
    for g in range(counts.shape[1]):
        levels, at = np.unique(counts[:, g], return_inverse=True)
        columns.append(at + len(group))
        group += [g] * len(levels)
        price.append(level_price(levels, totals[g], v))
    indicator = np.zeros((len(counts), len(group)), np.float32)
    for at in columns:
        indicator[np.arange(len(counts)), at] = 1
    return indicator, np.array(group), np.concatenate(price)


def divergences(left: tuple, right: tuple, into: np.ndarray) -> None:
    """Adds floor((p - q)^2 / (p + q)) summed over the terms to `into` (left groups by right groups), by the joint tables of all pairs of groups."""
    (x, of_x, p), (y, of_y, q) = left, right
    joint = x.T @ y  # at most `ROWS` in a cell, exact in single precision
    i, j = np.nonzero(joint)
    gap = p[i] - q[j]
    np.add.at(into, (of_x[i], of_y[j]), gap * gap // (p[i] + q[j]) * joint[i, j].astype(np.int64))


def price_block(key: tuple, table: pa.Table, tile: int) -> pa.Table:
    """(lang, g, h, value, terms) of the pairs of groups of two tiles of `tile` groups over one block of terms, `terms` being those of the block that occur in the tiles.

    Rows without a term list the groups with their totals.
    """
    lang, _, first, second = (k.as_py() for k in key)
    marks = table.filter(table["term"].is_null()).to_pydict()
    places = {g: i for i, g in enumerate(sorted(marks["g"]))}
    groups, total = list(places), dict(zip(marks["g"], marks["total"]))
    rows = table.filter(table["term"].is_valid()).combine_chunks()
    v = marks["v"][0]
    term = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy()
    counts = np.zeros((term.max(initial=-1) + 1, len(groups)), np.int64)
    counts[term, [places[g] for g in rows["g"].to_pylist()]] = rows["n"].to_numpy()
    counts = counts[np.argsort(counts.sum(axis=1), kind="stable")]  # terms of like frequency share levels
    sides = [[i for i, g in enumerate(groups) if g // tile == t] for t in (first, second)]
    values = np.zeros((len(sides[0]), len(sides[1])), np.int64)
    for at in range(0, len(counts), ROWS):
        some = counts[at : at + ROWS]
        left, right = (one_hot(some[:, side], [total[groups[i]] for i in side], v) for side in sides)
        divergences(left, right, values)
    out = [(lang, groups[i], groups[j], int(values[a, b]), len(counts)) for a, i in enumerate(sides[0]) for b, j in enumerate(sides[1]) if groups[i] < groups[j]]
    kinds = pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], names=["lang", "g", "h", "value", "terms"])


def share(n: str, total: str, v: str) -> Column:
    """The same share as `level_price`, as a column; decimals hold what a long does not."""
    return F.expr(f"CAST(1 + (CAST({UNIT} AS DECIMAL(10,0)) * CAST({n} + 2 AS DECIMAL(20,0))) div CAST({total} + 2 * {v} AS DECIMAL(20,0)) AS BIGINT)")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", *, least_docs: int = LEAST_DOCS, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): the divergence of each source of a language from each other one, and its own leading terms.

    Terms are runs of ASCII letters and code points beyond ASCII, A-Z in lower case; a language keeps those in at least `least_docs`
    of its documents. Part `pair`: item is another source of the language. Part `term`: item is a kept term that the source
    has more often than its language, at most `terms` of them. rank counts from 1 in descending value, then by item.
    Null texts, languages and sources are empty strings; repeated rows count each; a source whose texts hold no kept term is still
    compared; a language with one source has no pairs, and one without kept terms has value 0. An empty table gives no rows.
    """
    scratch, tile_size = Scratch(docs.sparkSession, "divergence"), TILE

    def price(key: tuple, table: pa.Table) -> pa.Table:
        return price_block(key, table, tile_size)

    counted = scratch.keep(count_terms(docs, text_col, lang_col, source_col))
    # one shuffle serves the sums of each term and the join with them
    dealt = counted.where("term IS NOT NULL").repartition("lang", "term")
    whole = dealt.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("d")).where(F.col("d") >= least_docs).drop("d")
    kept = scratch.keep(dealt.drop("docs").join(whole, ["lang", "term"]))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    vocabulary = kept.select("lang", "term", "n_lang").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("total_lang"))
    groups = counted.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = groups.na.fill(0, ["total", "v", "total_lang"])
    per_lang = Window.partitionBy("lang")
    groups = groups.withColumns({"g": F.row_number().over(per_lang.orderBy("source")) - 1, "tiles": F.ceil(F.count(F.lit(1)).over(per_lang) / TILE).cast("int")})
    groups = scratch.keep(groups.withColumn("blocks", F.ceil(F.col("v") / BLOCK)))

    # each group meets every other one in the product of their tiles
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    tile = F.floor(F.col("g") / TILE).cast("int")
    placed = groups.where("blocks > 0").select("lang", "source", "g", "total", "v", "blocks", tile.alias("tile"), other)
    placed = placed.withColumns({"first": F.least("tile", "other"), "second": F.greatest("tile", "other")}).drop("tile", "other")
    marks = placed.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "first", "second", "g", "total", "v", F.lit(None).cast("binary").alias("term"), F.lit(0).cast("long").alias("n"))
    rows = kept.join(placed, ["lang", "source"]).select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "first", "second", "g", "total", "v", "term", "n")
    priced = rows.union(marks).groupBy("lang", "block", "first", "second").applyInArrow(price, "lang string, g int, h int, value long, terms long")
    priced = scratch.keep(priced.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms")))

    # terms that neither tile has are at level 0 in both groups, and need no row to be priced
    level = F.when(F.col("v") > 0, share("0", "total", "v")).otherwise(1)
    sides = groups.select("lang", "source", "g", "v", level.alias("p")), groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), level.alias("q"))
    pairs = sides[0].join(sides[1], "lang").where("g <> h").select("lang", "source", "item", "v", "p", "q", F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h"))
    value = F.coalesce("value", F.lit(0)) + (F.col("v") - F.coalesce("terms", F.lit(0))) * F.expr("(p - q) * (p - q) div (p + q)")
    pairs = pairs.join(priced, ["lang", "g", "h"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))

    own = kept.join(groups.select("lang", "source", "total", "total_lang", "v"), ["lang", "source"])
    own = own.withColumns({"p": share("n", "total", "v"), "q": share("n_lang", "total_lang", "v")}).where("p > q")
    value = F.expr("(p - q) * (p - q) div (p + q)")
    own = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), value.alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [frame.withColumn("rank", F.row_number().over(order)) for frame in (pairs, own)]
    return ranked[0].union(ranked[1].where(F.col("rank") <= terms))
