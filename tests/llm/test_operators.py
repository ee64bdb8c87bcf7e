"""Each text operator against a plain Python version, on real documents and on hard cases."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter
from functools import partial

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from slotgrid.llm import bpe, decontam, html_extract, license_scan, line_dedup, lm, pii, quality, simhash, topk
from slotgrid.llm.queries import ORACLE_SQL, QUERIES

HARD = [
    (1, "Mail a@b.co, x@y.z_w@q.org and 10.0.0.1 or 300.1.1.1; call +49 (30) 123-45 67.8 now. 4111 1111 1111 1111", "a"),
    (2, None, "b"),
    (3, "", "c"),
    (4, "MIT License\nmit license and GNU  General public LICENSE. CC-BY\nReleased under the MIT license.", "d"),
    (5, "MIT License\nmit license and GNU  General public LICENSE. CC-BY\nReleased under the MIT license.", "e"),
    (5, "MIT License\nmit license and GNU  General public LICENSE. CC-BY\nReleased under the MIT license.", "e"),
    (None, "A line without an id that is long enough to be compared with others.", "f"),
    (7, "x" * 30_000 + " é\U0001f600 4111111111111111 token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", None),
    (8, "A line without an id that is long enough to be compared with other!", "g"),
    (9, "1.2.3.4.5.6.7.8 +123456789 +1 2 3 4 5 6 7 8 9- 0000 0000 0000 0000 a.b+c%d@e-f.g.h", "h"),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, "doc_id long, text string, line string").withColumn("component", F.lit(1)).withColumn("_drops", F.lit("x"))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows(df):
    return [tuple(r) for r in df.collect()]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_pii(text):
    out = []
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    )
    for kind, pattern, good in kinds:
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if good(m[0])]
    return ",".join(out)


def test_pii_base(docs, hard):
    for df in (docs, hard):
        found = pii.find_pii(df).select("doc_id", pii.joined(F.col("base")), pii.joined(F.col("spans")))
        texts = Counter((r[0], plain_pii(r[1])) for r in rows(df.select("doc_id", "text")))
        got = rows(found)
        assert Counter((a, b) for a, b, _ in got) == texts
        assert all(set(b.split(",")) <= set(s.split(",")) for _, b, s in got if b)


def test_pii_sample_holds_more_than_copies(spark, monkeypatch):
    """Many copies of a few vectors leave room in the sample for the other kinds, and every candidate counts for the limits."""
    digest = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(120)]
    texts = ["mail me: a@b.co" if i % 2 else "ip 10.0.0.1 here" for i in range(1200)]
    texts += [f'api token = "{d}"' for d in digest[:60]] + [f"build {d} done" for d in digest[60:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(pii, "train", partial(pii.train, rows=200))
    got = dict(rows(pii.find_pii(df).select("doc_id", pii.joined(F.col("spans")))))
    assert sum("secret:" in got[i] for i in range(1200, 1260)) >= 55
    assert sum("secret:" in got[i] for i in range(1260, 1320)) <= 5


def test_pii_candidates_of_any_length(spark):
    rng = random.Random(5)
    key = lambda n: "".join(rng.choices("abcdefABCDEF0123456789+/", k=n - 1)) + "7"
    label = "x" * 45
    cases = [("secret", key(n)) for n in (40, 200, 300, 2_000, 50_000)] + [("secret", "q" * 60 + "7" * 3)]
    cases += [("number", "7" * n) for n in (30, 40, 200)] + [("number", "030 1234567 " * 2 + "89 123 45"), ("spoken_email", f"{label}(at){label}" + "(dot)abc" * 6), ("spoken_email", "me (at) here (dot) org")]
    df = spark.createDataFrame([(i, f"see: {found} and more") for i, (_, found) in enumerate(cases)], "doc_id long, text string")
    got = rows(df.orderBy("doc_id").select(*[F.transform(pii.matches(F.col("text"), p), lambda x: x["found"]).alias(k) for k, p in pii.GENERATORS.items()]))
    assert [dict(zip(pii.GENERATORS, r))[kind] for r, (kind, _) in zip(got, cases)] == [[found] for _, found in cases]


def plain_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    more = set(labels)
    for label, body in license_scan.TEMPLATES.items():
        t = set(license_scan.template_words(body))
        for line in lower(text).split("\n"):
            if len(t & set(re.findall(license_scan.WORD, line))) >= 0.8 * len(t) - 1e-9:
                more.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(more))


def test_licenses(docs, hard):
    for df in (docs, hard):
        got = Counter(r[:7] for r in rows(license_scan.scan(df)))
        assert got == Counter((r[0], *plain_licenses(r[1])) for r in rows(df.select("doc_id", "text")))


def plain_contamination(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    words, hit, names = split(text), set(), set()
    for name, body in items:
        item = split(body)
        n = min(10, len(item))
        if n and name is not None:
            windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)}
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    names.add(str(name))
    return len(words), len(hit), len(names), ",".join(sorted(names))


@pytest.mark.parametrize("shard", [decontam.SHARD_CHARS, 2000])
def test_decontamination(spark, docs, hard, sf, shard):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    extra = spark.createDataFrame([(901, "mit License"), (902, "license"), (None, "x"), (903, None), (904, ""), (901, "mit License")], "item_id long, text string")
    for df, items in ((docs, bench), (hard, extra)):
        found = decontam.find_contamination(df, items, shard_chars=shard).select("doc_id", "contamination.n_words", "contamination.n_hit", F.size("contamination.items"), F.array_join("contamination.items", ","))
        plain = rows(items.select("item_id", "text"))
        assert Counter(rows(found)) == Counter((r[0], *plain_contamination(r[1], plain)) for r in rows(df.select("doc_id", "text")))


def test_automaton_against_all_windows():
    rng = random.Random(3)
    for _ in range(400):
        items = [(f"i{k}", " ".join(rng.choices("abc", k=rng.randint(1, 9)))) for k in range(rng.randint(1, 5))]
        text = rng.choices("abcd", k=rng.randint(0, 40))
        hit, names = set(), set()
        for name, item in items:
            item = item.split()
            size = min(4, len(item))
            for window in {tuple(item[i : i + size]) for i in range(len(item) - size + 1)}:
                for at in range(len(text) - size + 1):
                    if tuple(text[at : at + size]) == window:
                        hit |= set(range(at, at + size))
                        names.add(name)
        spans, found = decontam.Automaton(items, 4).spans([w.encode() for w in text])
        assert found == names and [i for a, b in spans for i in range(a, b)] == sorted(hit)


def test_decontaminate_cuts_and_keeps(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    df = spark.createDataFrame([(1, "Keep this, ONE two three four five six seven eight nine ten eleven! and that part stays as it was, all of it here."), (2, "clean text"), (3, "one two three four five six seven eight nine ten"), (4, None)], "doc_id long, text string")
    got = dict(rows(decontam.decontaminate(df, bench)))
    assert got == {1: "Keep this, ! and that part stays as it was, all of it here.", 2: "clean text", 4: None}


def plain_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", lower(text)) if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(docs, hard):
    for df in (docs, hard):
        plain = [(r[0], plain_fingerprint(r[1])) for r in rows(df.select("doc_id", "text"))]
        fps = sorted({f for _, f in plain})
        parent = {f: f for f in fps}

        def root(f):
            while parent[f] != f:
                f = parent[f]
            return f

        for i, a in enumerate(fps):
            for b in fps[:i]:
                if (a ^ b).bit_count() <= 4:
                    parent[root(a)] = root(b)
        least = {}
        for d, f in plain:
            least[root(f)] = min((x for x in (least.get(root(f)), d) if x is not None), default=None)
        assert Counter(rows(simhash.near_duplicates(df))) == Counter((d, f"{f:016x}", least[root(f)]) for d, f in plain)
    kept = [r[0] for r in rows(simhash.keep_one(hard).select("doc_id"))]
    assert 4 in kept and 5 not in kept
    same = hard.sparkSession.createDataFrame([(None, "the first text of all that has no id"), (None, "quite another one, without an id too"), (3, "alpha beta gamma delta"), (3, "some words that stand elsewhere"), (3, "alpha beta gamma delta")], "doc_id long, text string")
    assert Counter(rows(simhash.keep_one(same))) == Counter(set(rows(same)))


def plain_lines(df):
    places = [(r[0], xxhash.xxh64_intdigest((r[1] or "").encode(), 42), at, line.strip(" ").lower()) for r in rows(df.select("doc_id", "text")) for at, line in enumerate((r[1] or "").split("\n"))]
    lines = sorted({x[3] for x in places if len(x[3]) >= 10})
    sets = {x: {x[i : i + 10] for i in range(len(x) - 9)} for x in lines}
    parent = {x: x for x in lines}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            k = len(sets[a] & sets[b])
            if k and k >= 0.8 * (len(sets[a]) + len(sets[b]) - k):
                parent[root(a)] = root(b)
    return {x: root(x) for x in lines}


def test_line_dedup(spark, docs, hard):
    small = docs.where("doc_id < 60").select("doc_id", "text", "source")
    for df in (small, hard):
        group = plain_lines(df)
        texts = rows(df.select("doc_id", "text"))
        total = Counter(group[x.strip(" ").lower()] for d, t in set(texts) for x in (t or "").split("\n") if x.strip(" ").lower() in group)
        out = rows(line_dedup.dedup_lines(df).select("doc_id", "text", "n_lines", "n_dropped"))
        assert len(out) == len(texts)
        kept = Counter(group[x.strip(" ").lower()] for d, t in {(o[0], o[1]) for o in out} for x in (t or "").split("\n") if x.strip(" ").lower() in group)
        assert set(kept) == set(total) and set(kept.values()) <= {1}
    assert line_dedup.dedup_lines(hard).columns[:5] == hard.columns


def test_top_k(spark, sf, docs):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    assert sorted(rows(QUERIES["op2_top_k"](spark, sf))) == sorted(con.execute(ORACLE_SQL["op2_top_k"]).fetchall())
    odd = spark.createDataFrame([(0, [1.0, -0.5]), (1, [1.0, -0.5]), (2, [1.0, -0.5]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [0.0, 0.0]), (7, []), (None, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(rows(topk.top_k(odd, odd.where("vec_id = 0"), k=3)))
    assert got == [(0, 1, 1, 81920), (0, 2, 2, 81920), (0, 3, 6, 0)]
    many = spark.range(3000).selectExpr("id AS vec_id", "array(1.0f, CAST(id % 3 AS FLOAT)) AS embedding")
    got = sorted(rows(topk.top_k(many, many.where("vec_id < 40"), block=16)))
    assert len(got) == 200 and [r[2] for r in got if r[0] == 2] == [5, 8, 11, 14, 17]
    assert topk.top_k(odd.limit(0), odd).count() == 0


def test_bpe_equals_library(docs, hard):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(bpe._path(None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for df in (docs, hard):
        want = []
        for d, t in rows(df.select("doc_id", "text")):
            ids = reference.encode(t or "", add_special_tokens=False).ids
            want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(reference.decode(ids, skip_special_tokens=False))))
        assert Counter(rows(bpe.encode_documents(df))) == Counter(want)


def test_lm(docs, hard):
    for df in (docs, hard):
        plain = rows(df.select("doc_id", "text"))
        words = {i: [*lm.words(t), b""] for i, (_, t) in enumerate(plain)}
        trains = [d is not None and zlib.crc32(str(d).encode()) % 7 != 2 for d, _ in plain]
        counts = Counter(w for i, ws in words.items() if trains[i] for w in ws)
        n, v = sum(counts.values()), len(counts)
        want = sorted(((d if d is not None else -1), len(words[i]), sum(counts[w] > 0 for w in words[i]), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words[i]), 6)) for i, (d, _) in enumerate(plain))
        for frequent in (20, lm.FREQUENT):
            got = rows(lm.score_documents(df, frequent=frequent))
            assert sorted((r[0] if r[0] is not None else -1, r[2], r[3], r[4], round(r[5], 6)) for r in got) == want
            assert all(r[6] < 0 for r in got)


def test_lattice_sums_all_segmentations():
    lattice = lm.Lattice({"▁": math.log(0.2), "a": math.log(0.3), "b": math.log(0.1), "▁a": math.log(0.25), "ab": math.log(0.15)})
    assert math.isclose(math.exp(lattice.marginal("ab")), 0.2 * 0.3 * 0.1 + 0.25 * 0.1 + 0.2 * 0.15)
    into = {}
    lattice.expect("ab", 2.0, into)
    total = 0.2 * 0.3 * 0.1 + 0.25 * 0.1 + 0.2 * 0.15
    assert math.isclose(into["ab"], 2 * 0.03 / total) and math.isclose(into["b"], 2 * (0.006 + 0.025) / total)


def test_quality(spark, docs, sf, hard):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.score_documents(docs, labels).select("doc_id", "quality_score.*")
    truth = dict(rows(labels.select("doc_id", "quality")))
    got = rows(out)
    assert all(r[1] == (zlib.crc32(str(r[0]).encode()) % 5 == 0) and r[3] == int(r[2] >= 0.3) for r in got)
    known = [(r[3], truth[r[0]]) for r in got if r[0] in truth]
    assert sum(a == b for a, b in known) / len(known) > 0.95
    assert quality.score_documents(hard, labels).count() == len(HARD)
    assert {r[0] for r in rows(quality.score_documents(hard, labels.limit(0)).select("quality_score.score"))} == {0.5}


def test_html():
    page = '<html><head><title>T</title></head><body><div class="menu12">Menu <a>x</a></div><div class="post-77"><h1>Head &amp; tail</h1><p>One\n  two<p><b>Three</b> four<br>five<div class="comments"><p>nice</p></div><script>var t="</p>";</script></div><footer>F</footer>'
    best = html_extract.best_container(html_extract.blocks(page))
    assert best.path == ">html>body>div.post-N"
    assert html_extract.main_text(page, best.path) == "Head & tail\nOne two\nThree four\nfive"
    assert html_extract.main_text(None, None) == "" and html_extract.main_text("plain <", None).startswith("plain")


def test_html_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    odd = spark.createDataFrame([(None, None, None), (1, "http://h/", ""), (1, "nonsense", "<p>text")], "page_id long, url string, html string")
    out = rows(html_extract.extract_pages(pages.select(*odd.columns).union(odd)))
    assert len(out) == pages.count() + 3 and all(r[3] == len(r[2]) for r in out)
    assert all(r[2] for r in out if r[1] not in (None, "http://h/"))


def test_empty_tables(spark, hard, sf):
    none = hard.limit(0)
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    for df in (line_dedup.dedup_lines(none), pii.find_pii(none), license_scan.scan(none), simhash.near_duplicates(none), bpe.encode_documents(none), lm.score_documents(none), decontam.find_contamination(none, bench), decontam.find_contamination(none, bench.limit(0)), quality.score_documents(none, labels)):
        assert df.count() == 0


def test_lm_takes_three_steps(spark):
    """The scores are those of three expectation steps, done here one word at a time."""
    import public_tokenizers

    texts = [(i, f"the cat number {i} sat on the mat and looked at the other cats") for i in range(30)]
    prior = logs = lm.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    counts = Counter(w.decode() for i, t in texts if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*lm.words(t), b""])
    for _ in range(3):
        lattice, expected = lm.Lattice(logs), {}
        for word, c in counts.items():
            if word:
                lattice.expect(word, c, expected)
            else:
                expected[lm.END] = expected.get(lm.END, 0.0) + c
        total = math.fsum(expected.values()) + lm.PRIOR
        logs = {piece: math.log((expected.get(piece, 0.0) + lm.PRIOR * math.exp(log)) / total) for piece, log in prior.items()}
    lattice = lm.Lattice(logs)
    got = rows(lm.score_documents(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id"))
    for (_, text), r in zip(texts, got):
        assert math.isclose(r[6], (sum(lattice.marginal(w.decode()) for w in lm.words(text)) + logs[lm.END]) / math.log(10), rel_tol=1e-9)


def test_bpe_of_special_tokens_alone(spark):
    got = rows(bpe.encode_documents(spark.createDataFrame([(1, "<|endoftext|>")], "doc_id long, text string")))
    assert [r[:2] for r in got] == [(1, 1)]


def test_line_dedup_of_short_and_nearly_equal_lines(spark):
    rng = random.Random(11)
    base = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=48)).join("xy") for _ in range(60)]
    near = [x[:25] + "#" + x[26:] for x in base]
    texts = ["\n".join(base), "\n".join(near), "les.\n\nand ornd.\n}\nles!", "Les.\n\nand ornd.\n}", "les. \nnew"]
    out = dict(rows(line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "text")))
    assert out[0] == texts[0] and len([x for x in out[1].split("\n") if x]) <= 2
    assert (out[2], out[3], out[4]) == (texts[2], "", "new")


def test_licenses_wrapped_over_lines(spark):
    """A notice is found however its lines are broken and marked."""
    cases = [(label, width, mark) for label in license_scan.TEMPLATES for width, mark in ((40, ""), (80, ""), (40, " * "), (72, "    # "))]
    around = "Some words of code before it\n\n%s\n\nand some words after it."
    texts = [around % "\n".join(mark + x for x in textwrap.wrap(license_scan.TEMPLATES[label], width)) for label, width, mark in cases]
    texts.append("\n".join(f"{w} stands far from any other of these words, as one line of many in a long text would" for w in license_scan.TEMPLATES["isc-notice"].split()))
    got = dict(rows(license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "labels")))
    assert all(label in got[i].split(",") for i, (label, _, _) in enumerate(cases))
    assert got[len(cases)] == ""


def test_html_wrappers_named_after_what_they_have():
    page = "<body><div class='nav'><a>Home</a> menu</div><div %s><h1>Head</h1><p>The text of the article is here, long enough.</p><div class='sidebar-left'>Other</div></div><div class='site-footer'>Foot</div></body>"
    for mark in ("class='content has-sidebar'", "id='page' class='no-sidebar'", "class='layout-with-nav'", "class='post-with-comments'", "class='entry social-enabled'", "class='builder-widget'"):
        assert html_extract.main_text(page % mark, None) == "Head\nThe text of the article is here, long enough.", mark
    ad = "<body><div class='ad'>An advertisement that is longer than all the rest of the page together.</div><article><p>Short text.</p></article></body>"
    assert html_extract.main_text(ad, None) == "Short text."


def test_html_keeps_the_whole_article():
    page = "<body><article><h1>Head</h1><p>Lead.</p><div class='body'><p>The long text of the first section stands here.</p></div><div class='more'><p>Second section.</p></div><div class='related'>Other</div></article><div class='x'>Out</div></body>"
    want = "Head\nLead.\nThe long text of the first section stands here.\nSecond section."
    assert html_extract.main_text(page, ">body>article>div.body") == want
    assert html_extract.main_text(page, None) == want


def test_bpe_hard_texts_equal_library():
    """Random texts of signs, marks, apostrophes, odd white space and special tokens, and words too long for a pair scan, in slices of one and many."""
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(bpe._path(None))
    coder, rng = bpe.load(bpe._path(None)), random.Random(1)
    alpha = "abcdefghijklmnop THE ing's''reéñßΣς中 \n\t\x1c\x1d\x85\xa0 😀12٣½.,;!?<>|\x00\x7f́"
    units = ["<|endoftext|>", "<|startoftext|>", "it's", "WE'LL", "''d've", "ΑΣ", "İ", "ﬁ", "x́", "가"]
    texts = ["", "  ", "<|endoftext|>", "x" * 5000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=100_000))]
    texts += ["".join(rng.choice(units) if rng.random() < 0.1 else rng.choice(alpha) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for start, size in [*bpe.slices(pa.array(texts), 20_000), (0, 3)]:
        ids, names = coder.encode(pa.array(texts[start : start + size]))
        for text, got, decoded in zip(texts[start:], ids.to_pylist(), names.to_pylist()):
            want = reference.encode(text, add_special_tokens=False).ids
            assert (got, decoded) == (" ".join(map(str, want)), reference.decode(want, skip_special_tokens=False)), text[:80]


def test_bpe_pair_check_equals_merging():
    coder, rng = bpe.load(bpe._path(None)), random.Random(2)
    inner = [i for i, name in enumerate(coder.names) if not name.endswith(coder.end)]
    pairs = [(rng.choice(inner), rng.randrange(coder.size)) for _ in range(3000)]
    pairs += [p for p in zip(coder.left.tolist(), coder.right.tolist()) if p[0] != p[1]][:2000]

    def spelled(i):
        name = coder.names[i]
        return coder.symbols(name.removesuffix(coder.end)) if name.endswith(coder.end) else [coder.number[c] for c in name]

    good = coder.compatible(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert good.tolist() == [coder.merge(spelled(a) + spelled(b)) == [a, b] for a, b in pairs]
    assert 0 < good.sum() < len(pairs)


def test_lattices_equal_the_plain_recursion():
    """Many words at once give the marginals and expected counts of one word at a time, odd characters and long words too."""
    import public_tokenizers

    logs = lm.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    scorer, plain, rng = lm.Scorer(lm.Trie(list(logs)), logs), lm.Lattice(logs), random.Random(4)
    words = ["", "a", "é😀中", "x" * 200, "\x01", "the", "the"] + ["".join(rng.choices("abcdeé中#", k=rng.randint(1, 30))) for _ in range(300)]
    for got, word in zip(scorer.marginals(words), words):
        assert math.isclose(got, plain.marginal(word) if word else logs[lm.END], rel_tol=1e-12)
    into, rest, want = np.zeros(len(scorer.values)), {}, {}
    scorer.expect(words, list(range(1, len(words) + 1)), into, rest)
    for n, word in enumerate(words, 1):
        if word:
            plain.expect(word, n, want)
        else:
            want[lm.END] = want.get(lm.END, 0.0) + n
    for i in np.flatnonzero(into).tolist():
        rest[scorer.trie.pieces[i]] = rest.get(scorer.trie.pieces[i], 0.0) + into[i]
    assert rest.keys() == {k for k, v in want.items() if v} | rest.keys() and all(math.isclose(rest.get(k, 0.0), v, rel_tol=1e-9, abs_tol=1e-12) for k, v in want.items())


def test_pii_many_matches_end_soon(spark):
    text = " ".join(f"user{i}@mail.example.org" for i in range(20_000))
    found = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(pii.joined(F.col("base"))).first()[0]
    assert found == plain_pii(text)


def test_quality_on_held_out_rows(spark, sf):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = dict(rows(labels.select("doc_id", "quality")))
    held = [(r[1], truth[r[0]]) for r in rows(quality.score_documents(docs, labels).where("quality_score.held_out").select("doc_id", "quality_score.score")) if truth.get(r[0]) in (0, 1)]
    good, bad = ([s for s, y in held if y == k] for k in (1, 0))
    assert good and bad
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.95


def test_html_gold_texts(spark):
    """Whole pages with nested boxes, an article's own header, names that only sound like boilerplate, and deep nesting."""
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header class='site-header'><a href='/'>Site</a></header><nav>Menu</nav>"
        "<article class='post-12'><header><h1>Own &lt;head&gt;</h1></header><div class='share-price'><p>The price of a share is 5&nbsp;&euro; today.</p></div>"
        "<p>Second   block\n of text.</p><div class='related-links'>Read more</div><form>Your mail</form></article><aside>Side</aside><div class='comments'>Nice!</div><footer>Foot</footer></body></html>"
    )
    want = "Own <head>\nThe price of a share is 5 € today.\nSecond block of text."
    deep = "<div>x" * 20_000
    df = spark.createDataFrame([(1, "http://a.org/1", page), (2, "http://a.org/2", page), (3, "http://b.org/1", deep), (4, None, None)], "page_id long, url string, html string").withColumn("path", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = {r[0]: r[2] for r in rows(html_extract.extract_pages(df))}
    assert got[1] == got[2] == want and got[3].count("x") == 20_000 and got[4] == ""
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_top_k_of_repeated_ids_and_long_vectors(spark):
    data = [(0, [1.0] * 300), (0, [0.5] * 300), (1, [1.0] * 300), (2, [1.0]), (3, [2.0] * 5)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(1))
    got = sorted(rows(topk.top_k(df, df.where("vec_id = 0"), k=3, block=1)))
    assert got == [(0, 1, 1, 300 * 128 * 256), (0, 2, 3, 5 * 128 * 512), (0, 3, 2, 128 * 256)]


def test_line_dedup_of_a_large_group_and_hot_buckets(spark, monkeypatch):
    """Near copies in chains, in buckets dealt to several tasks and with candidate ids joined by shuffle, leave one line."""
    monkeypatch.setattr(line_dedup, "SHARE", 7)
    monkeypatch.setattr(line_dedup, "BROADCAST_IDS", 10)
    rng = random.Random(8)
    base = "".join(rng.choices("abcdefghijklmnop ", k=260))
    near = [base[:k] + "#" + base[k + 1 :] for k in range(5, 250, 4)]
    other = ["".join(rng.choices("abcdefghijklmnop ", k=200)).strip() for _ in range(30)]
    df = spark.createDataFrame([(i, "\n".join([line, other[i % 30]])) for i, line in enumerate([base] * 40 + near)], "doc_id long, text string")
    out = rows(line_dedup.dedup_lines(df).select("doc_id", "text"))
    left = [x for _, t in out for x in t.split("\n") if x]
    assert sorted(left) == sorted([base, *other])


def test_line_dedup_settles_pairs_apart_by_their_marks(spark, monkeypatch):
    """Lines that share buckets and stay apart are told by their marks; only few pairs are read as whole lines."""
    rng = random.Random(5)
    base = "".join(rng.choices("abcdefghijklmnop ", k=258)).join("xy")
    near = []
    for _ in range(60):
        i, j = rng.sample(range(12, 245, 11), 2)
        near.append("".join(chr(rng.randrange(0x100, 0x400)) if k in (i, j) else c for k, c in enumerate(base)))
    compared, keep = [], line_dedup.Scratch.keep

    def counted(self, df):
        out = keep(self, df)
        if {"a", "b", "scheme"} <= set(df.columns):
            compared.append(out.count())
        return out

    monkeypatch.setattr(line_dedup.Scratch, "keep", counted)
    group = plain_lines(spark.createDataFrame(list(enumerate(near)), "doc_id long, text string"))
    out = rows(line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(near)), "doc_id long, text string")).select("doc_id", "text"))
    assert len([t for _, t in out if t]) == len(set(group.values())) > 1
    assert sum(compared) <= 120


def test_line_dedup_brings_each_bucket_together_once(spark, monkeypatch):
    """All bands are shuffled once to find the buckets of several lines, and meet no join; texts are cut into lines once before that."""
    plans, keep = [], line_dedup.Scratch.keep

    def noted(self, df):
        plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return keep(self, df)

    monkeypatch.setattr(line_dedup.Scratch, "keep", noted)
    texts = ["a line that stands here and there\nand another one", "A line that stands here and there", "nothing of the kind"]
    out = dict(rows(line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "text")))
    assert out == {0: texts[0], 1: "", 2: texts[2]}
    first = next(plan for columns, plan in plans if "band" in columns)
    assert first.count("Exchange hashpartitioning(band") == 1 and "Join" not in first and "split(" not in first


def test_line_dedup_code_is_short_enough_to_be_compiled(spark, monkeypatch):
    """The JVM interprets methods of over 8,000 bytes, as the comparison of all words of two marks inside a join was."""
    found, keep = [], line_dedup.Scratch.keep
    debug = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package")

    def noted(self, df):
        code = debug.codegenString(df._jdf.queryExecution().executedPlan())
        found.extend((int(x), df.columns) for x in re.findall(r"maxMethodCodeSize:(\d+)", code))
        return keep(self, df)

    monkeypatch.setattr(line_dedup.Scratch, "keep", noted)
    rng = random.Random(6)
    base = "".join(rng.choices("abcdefghijklmnop ", k=258)).join("xy")
    near = ["".join(chr(rng.randrange(0x100, 0x400)) if k % 30 == i else c for k, c in enumerate(base)) for i in range(20)]
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        assert len(rows(line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(near)), "doc_id long, text string")))) == 20
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(found) > 30 and max(found)[0] <= 8_000, max(found)


def test_line_dedup_of_characters_of_four_bytes(spark):
    """A line with a character outside the basic plane meets its near copies with and without one."""
    rng = random.Random(7)
    base = ["".join(rng.choices("abcdefghijklmnop \u00e9\u4e2d", k=n)).join("xy") for n in (140, 180, 300)]
    texts = ["\n".join(x[:k] + c + x[k + 1 :] for x in base) for k, c in ((20, "z"), (20, "\U0001f600"), (24, "\U00020000"))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group, out = plain_lines(df), dict(rows(line_dedup.dedup_lines(df).select("doc_id", "text")))
    assert out[0] == texts[0] and len(set(group.values())) == 3
    assert len([x for t in out.values() for x in t.split("\n") if x]) == len(set(group.values()))
