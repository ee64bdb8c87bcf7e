"""Delimited text files as they come: lines with their places, records that span lines, and quotes that are never closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch
from .tables import decode_csv

#: Lines that a quoted text may span; a quote that is not closed within them is broken and concerns its own line alone.
SPAN = 10


def odd_quotes(text: Column) -> Column:
    """Whether a text holds an odd number of double quotes."""
    return (F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2 == 1


def file_lines(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """(file, line_no, line): every line of the files below `path`, counted from 1 in each file.

    A file is read in splits by several tasks. Each split numbers its own lines, and a table of one row a split says at which line it begins;
    the numbered lines are written once, since a second reading could number them differently.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    stored = scratch.keep(read)
    splits = stored.groupBy("file", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split")) - F.col("n")
    splits = scratch.keep(splits.select("file", "split", (before - F.col("first") + 1).alias("shift")))
    return stored.join(splits, ["file", "split"]).select("file", (F.col("at") + F.col("shift")).alias("line_no"), "line")


def open_records(lines: DataFrame, span: int) -> DataFrame:
    """(file, line_no, first): the lines of records that span several, each with the first line of its record.

    Only lines with an odd number of quotes open or close a record, and only they are sorted. Such lines less than `span` apart form a run; in a run the first
    opens and the second closes, and so on; the last of a run with an odd number of them is broken.
    """
    place = Window.partitionBy("file").orderBy("line_no")
    odd = lines.where(odd_quotes(F.col("line"))).select("file", "line_no").withColumn("gap", F.col("line_no") - F.lag("line_no").over(place))
    runs = odd.withColumn("run", F.count_if(F.coalesce(F.col("gap") >= span, F.lit(True))).over(place))
    own = Window.partitionBy("file", "run").orderBy("line_no")
    pairs = runs.withColumns({"turn": F.row_number().over(own), "last": F.lead("line_no").over(own)}).where("turn % 2 = 1 AND last IS NOT NULL")
    return pairs.select("file", F.col("line_no").alias("first"), F.explode(F.sequence("line_no", "last")).alias("line_no"))


def read_records(spark: SparkSession, path: str, header: str, names: list[str], scratch: Scratch, *, span: int = SPAN) -> DataFrame:
    """(file, line_no, n_lines, record, odd_quote, row): the records of delimited files with their lineage, and `row` the fields as texts by name.

    Lines equal to `header` and lines of spaces alone, outside of a quoted text, are no records. A quoted text may hold commas, doubled quotes and, within
    `span` lines, line ends. odd_quote marks a record whose quotes do not pair; its fields are what the reader makes of it, with `_corrupt_record`
    set where fields lack or are too many.
    """
    lines = file_lines(spark, path, scratch)
    inner = scratch.keep(open_records(lines, span))
    marked = lines.join(inner, ["file", "line_no"], "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    joined = marked.where("first IS NOT NULL").groupBy("file", F.col("first").alias("line_no")).agg(F.count(F.lit(1)).alias("n_lines"), text.alias("record"))
    alone = marked.where(F.col("first").isNull() & (F.col("line") != header) & (F.trim("line") != "")).select("file", "line_no", F.lit(1).cast("long").alias("n_lines"), F.col("line").alias("record"))
    return joined.unionByName(alone).withColumns({"odd_quote": odd_quotes(F.col("record")), "row": decode_csv(F.col("record"), names)})
