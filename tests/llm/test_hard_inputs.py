"""Pages, labels, queries and items that are hard by their shape: long tags, repeated ids, repeated rows."""

import random
import time

from pyspark.sql import functions as F

from slotgrid.llm import decontam, gbdt, html_extract, quality, topk


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_html_hard_tags_take_linear_time():
    start = time.monotonic()
    for part in ("<a" + " " * 400_000, "<a " + "x" * 400_000, "<a " + 'b="' * 130_000 + "'", "<a " + "=" * 400_000, "<a " + "a b " * 100_000, "<a b='" * 70_000, "<" * 400_000):
        html_extract.main_text(f"<p>text {part}", None)
        assert html_extract.main_text(f"<p>text</p>{part}></a>", None).startswith("text")
    assert time.monotonic() - start < 20


def test_html_values_and_references():
    text = lambda page: html_extract.main_text(page, None)
    assert text("<p>a<b title=\"x>y\" data-z='>' hidden>b</b>c<br/>d</p>") == "abc\nd"
    assert text('<p>a<i title="no end>b</i>c</p>') == "abc"
    assert text("<p>&#" + "9" * 9_000 + "; &#" + "0" * 9_000 + "65; &#x41; &#X" + "F" * 9_000 + "; &#0abc &amp;amp; &#x" + "0" * 20 + "42;</p>") == "� A A � �abc &amp; B"


def test_quality_bound_holds_for_an_id_on_many_rows(spark, monkeypatch):
    """One labelled id stands on most rows; the driver gets no more rows than the bound, and copies count once."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(x)) or gbdt.fit(x, y))
    data = [(1, "same text")] * 3_000 + [(1, f"text number {'x' * i}") for i in range(300)] + [(i, f"other {'y ' * i}") for i in range(2, 40)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    assert quality.score_documents(docs, labels, rows=10_000).count() == len(data)
    assert quality.score_documents(docs, labels, rows=50).count() == len(data)
    assert 250 <= seen[0] <= 340 and seen[1] <= 50


def test_top_k_blocks_group_the_queries_once(spark):
    rng = random.Random(3)
    data = [(i % 90, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(120)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    queries = df.where("vec_id < 20")
    assert sorted(rows(topk.top_k(df, queries, block=4))) == sorted(rows(topk.top_k(df, queries, block=1_000)))


def test_repeated_benchmark_rows_are_one_item(spark):
    """Copies of an item neither change the result nor gather in one shard."""
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "before " + text + " after"), (2, "clean words")], "doc_id long, text string")
    bench = spark.createDataFrame([("q", text)] * 500 + [("r", " ".join(f"v{i}" for i in range(30)))], "item_id string, text string")
    many = list(decontam._shards(bench, "item_id", "text", 1_000))
    assert len(many) == 1 and sorted(many[0][1]) == sorted({("q", text), ("r", " ".join(f"v{i}" for i in range(30)))})
    found = decontam.find_contamination(docs, bench).select("doc_id", F.col("contamination.n_hit"), F.col("contamination.items"))
    assert sorted(rows(found)) == [(1, 30, ["q"]), (2, 0, [])]
