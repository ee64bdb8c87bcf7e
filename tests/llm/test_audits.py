"""MinHash near-duplicates, the filter audit and the divergence audit against plain Python versions."""

import gc
import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations, permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slotgrid.llm import divergence, filter_audit, license_scan, minhash
from slotgrid.llm.queries import ORACLE_SQL, QUERIES
from slotgrid.sources.shared import Scratch

COLUMNS = "doc_id long, text string, lang string, source string"
HARD = [
    (1, "The The the cat sat", "en", "a"), (2, None, "en", None), (3, "", None, "b"), (4, " \t\n\x0b\x0c\r ", "en", "a"), (5, "One", "en", "a"), (6, "one", "de", "a"),
    (6, "one", "de", "a"), (7, "é\U0001f600 x Ünï cödé $5 | 100%", "fr", ""), (8, "word " * 60, "en", "a"), (9, "word " * 60, "en", "b"), (None, "word " * 60, "en", "b"),
    (10, "A" * 30_000 + " b" * 30_000, "en", "a"), (11, " ".join(f"w{i}" for i in range(60)), "en", "c"), (12, " ".join(f"W{i}" for i in range(60)), "en", "c"), (13, "x\x00y the CAT", None, None),
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def hard(spark):
    clash = {c: F.lit("clash") for c in ("component", "node", "band", "term", "part", "mask", "shard", "n", "id", "rank", "value", "g", "place")}
    return spark.createDataFrame(HARD, COLUMNS).withColumns(clash)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()


def plain_near(rows):
    """(doc_id, n_shingles, component_id, kept) by all pairs of distinct sets."""
    sets = {}
    for doc, text in rows:
        sets.setdefault(frozenset(shingles(text)), []).append(doc)
    found = [s for s in sets if s]
    parent = list(range(len(found)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(found)), 2):
        both = len(found[i] & found[j])
        if 100 * both >= 80 * (len(found[i]) + len(found[j]) - both):
            parent[root(j)] = root(i)
    least = defaultdict(list)
    for i, s in enumerate(found):
        least[root(i)] += [d for d in sets[s] if d is not None]
    lead = {s: min(least[root(i)], default=None) for i, s in enumerate(found)}
    out = []
    for doc, text in rows:
        s = frozenset(shingles(text))
        top = lead[s] if s else doc
        out.append((doc, len(s), top, doc == top))
    return sorted(out, key=repr)


def near(df):
    return sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=repr)


def test_near_duplicates_of_documents(docs):
    assert near(docs) == plain_near([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("limit", [minhash.BROADCAST_ROWS, 0])
def test_near_duplicates_of_hard_texts(hard, monkeypatch, limit):
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", limit)
    assert near(hard) == plain_near([r[:2] for r in HARD])
    assert near(hard.limit(0)) == []


def test_near_duplicates_lose_no_pair_at_the_limit(spark):
    """1,500 pairs of texts with similarities from exactly 0.8 to 0.85, and as many just below, of 4 to 400 shingles."""
    rng, data = random.Random(2), []
    for i in range(3_000):
        n = rng.choice([4, 8, 20, 60, 400])
        base = [f"p{i}w{k}" for k in range(n + 1)]
        # words added at the end add as many shingles: n / (n + more)
        more = n // 4 if i % 2 == 0 else n // 4 + 1
        if i % 4 == 0:
            more = max(1, int(n / 0.85 - n))
        data += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + [f"q{i}w{k}" for k in range(more)]))]
    got = dict((d, c) for d, _, c, _ in near(spark.createDataFrame(data, "doc_id long, text string")))
    for i in range(3_000):
        a, b = shingles(data[2 * i][1]), shingles(data[2 * i + 1][1])
        assert (got[2 * i + 1] == 2 * i) == (100 * len(a & b) >= 80 * len(a | b)), (len(a), len(b))


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    """Texts that share most words, some of them in links and others just short of it, in buckets that several tasks compare."""
    monkeypatch.setattr(minhash, "SHARE", 5)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(80)]
    data = []
    for i in range(220):
        text = list(base)
        for k in rng.sample(range(80), rng.choice([1, 3, 5, 6, 7, 8, 9])):
            text[k] = f"e{i}x{k}"
        data.append((i, " ".join(text)))
    df = spark.createDataFrame(data + data[:50], "doc_id long, text string")
    assert near(df) == plain_near(data + data[:50])


def test_packed_bits_estimate_the_similarity():
    """Each estimate lies within five standard deviations, so the slack of `may_link` holds."""
    hashes, rng = minhash.WordHashes(), random.Random(1)
    for share in (0.2, 0.5, 0.8, 0.9):
        got = []
        for t in range(60):
            common = [f"{t}c{k}" for k in range(int(300 * share))]
            sets = [minhash.shingles(" ".join(common + [f"{t}{s}{rng.random()}" for _ in range(300 - len(common))]), 1, hashes) for s in "ab"]
            real = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
            a, b = (minhash.pack(minhash.minima(s)).view(np.uint64) for s in sets)
            half = minhash.MINIMA // 64
            differ = sum(int(((a[w] ^ b[w]) | (a[half + w] ^ b[half + w]))).bit_count() for w in range(half))
            got.append(((1 - differ / minhash.MINIMA - 0.25) / 0.75) - real)
        deviation = ((real + (1 - real) / 4) * (1 - real) * 0.75 / minhash.MINIMA) ** 0.5 / 0.75
        assert abs(np.mean(got)) < deviation and max(map(abs, got)) < 5 * deviation


def plain_audit(rows, labels):
    """All parts, orders and steps by running each chain over each document."""
    quality, toxic, first = {}, {}, {}
    for doc, q, t in labels:
        if doc is not None:
            quality[doc] = max(quality.get(doc, 0), int(q == 1))
            toxic[doc] = max(toxic.get(doc, 0), int(t == 1))
    for doc, text, _, _ in rows:
        if doc is not None:
            first[text or ""] = min(first.get(text or "", doc), doc)
    fails = []
    for doc, text, _, part in rows:
        t, w = text or "", words(text)
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": doc is not None and first[t] < doc}
        fails.append((part or "", {f for f, b in bad.items() if b}, quality.get(doc, 0), toxic.get(doc, 0)))
    out = {}
    for part in {f[0] for f in fails}:
        own, all_removed = [f for f in fails if f[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            gone = [False] * len(own)
            for step, letter in enumerate(order, 1):
                here = [letter in f[1] and not g for f, g in zip(own, gone)]
                redundant = sum(letter in f[1] and g for f, g in zip(own, gone))
                gone = [g or h for g, h in zip(gone, here)]
                all_removed[letter] += sum(here)
                out[part, order, step] = [gone.count(False), sum(here), redundant, sum(f[1] == {letter} for f in own), sum(f[2] for f, h in zip(own, here) if h), sum(f[3] for f, h in zip(own, here) if h), letter]
        for key in out:
            if key[0] == part:
                out[key][-1] = all_removed[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("size", [filter_audit.SHARD_BYTES, 3_000])
def test_filter_audit_of_hard_texts(spark, hard, monkeypatch, size):
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", size)
    labels = [(1, 1, 0), (8, 1, 1), (8, 0, 0), (9, None, 1), (None, 1, 1), (77, 1, 1), (6, 1, 0)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(3))
    out = filter_audit.audit(hard, marks).drop("letter").collect()
    assert {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in out} == plain_audit(HARD, labels)
    assert len(out) == 600 * 4
    assert filter_audit.audit(hard.limit(0), marks).count() == 0 and filter_audit.audit(hard, marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


@pytest.mark.parametrize("size", [filter_audit.SHARD_BYTES, 20_000])
def test_document_term_matrix_has_global_columns(spark, docs, monkeypatch, size):
    """Rows of the matrix have the counts of their words, and one word has one column in all shards."""
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", size)
    texts, column = {r["doc_id"]: r["text"] for r in docs.collect()}, {}
    seen = 0
    for shard in filter_audit.document_term_matrix(docs, Scratch(spark, "t")).collect():
        for i, doc in enumerate(shard["ids"]):
            own = Counter(words(texts[doc]))
            a, b = shard["starts"][i : i + 2]
            found = dict(zip(shard["columns"][a:b], shard["counts"][a:b]))
            assert len(found) == len(own) == b - a and sorted(found.values()) == sorted(own.values())
            for c, n in found.items():
                column.setdefault(c, set(own) if c not in column else column[c])
                column[c] &= {w for w, k in own.items() if k == n}
            seen += 1
    assert seen == len(texts) and all(column.values()) and len(column) == len({w for t in texts.values() for w in words(t)})


def test_no_row_holds_a_whole_shard(spark):
    """Texts of one task that together have many words are stored as many rows."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(20_000)), "s") for i in range(8)], "doc_id long, text string, source string").coalesce(1)
    most = filter_audit.shards(docs, "doc_id", "text", "source").select(*[F.max(F.size(c)) for c in ("counts", "words")]).first()
    assert max(most) < 100_000


def shard_rows(spark, monkeypatch, docs):
    """What a task makes of `docs` (id, text), in this process."""

    class Docs:
        sparkSession = spark  # noqa: N815
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run  # noqa: E731, N815

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 3)  # noqa: N815

    monkeypatch.setattr(filter_audit, "TaskContext", Task)
    ids, texts = zip(*docs)
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(["s"] * len(ids)), pa.array(texts, pa.binary())], names=["id", "part", "text"])
    return filter_audit.shards(Docs(), "doc_id", "text", "source")(iter([batch]))


def test_words_of_a_shard_are_freed_with_it(spark, monkeypatch):
    """Python's collector of cycles seldom runs in a worker, so the words of a shard that is done must go without it."""
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 2_000)
    rows = shard_rows(spark, monkeypatch, [(i, b" ".join(b"v%dx%d" % (i, j) for j in range(300))) for i in range(20)])
    gc.collect()
    gc.disable()
    try:
        assert len({row.column("shard")[0].as_py() for row in rows}) == 20
        left = [x for x in gc.get_objects() if isinstance(x, defaultdict) and any(isinstance(k, bytes) and k.startswith(b"v") for k in x)]
        assert len(left) <= 1
    finally:
        gc.enable()


def test_shards_end_after_many_words_and_blocks_after_many_texts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "SHARD_WORDS", 500)
    rows = list(shard_rows(spark, monkeypatch, [(i, b" ".join(b"%dx%d" % (i, j) for j in range(300))) for i in range(8)]))
    assert sorted(sum(len(x) for x in pa.Table.from_batches([row])["words"].to_pylist() if x) for row in rows if row.column("words")[0].is_valid) == [600] * 4
    rows = [row for row in shard_rows(spark, monkeypatch, [(i, b"") for i in range(10_000)]) if row.column("ids")[0].is_valid]
    assert len(rows) > 1 and [x for row in rows for x in row.column("ids")[0].as_py()] == list(range(10_000))


def test_numbers_sent_back_are_gathered_by_shard(monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD", 7)
    rng, bits = random.Random(5), filter_audit.AT_BITS
    want = {(rng.randrange(4) << bits) + at: rng.randrange(1 << 40) for at in rng.sample(range(1 << bits), 40)}
    items = list(want.items())
    batches = [pa.RecordBatch.from_pydict({"place": [p for p, _ in items[i : i + 3]], "number": [n for _, n in items[i : i + 3]]}) for i in range(0, len(items), 3)]
    rows = [r for b in filter_audit._pack(iter(batches)) for r in b.to_pylist()]
    assert {(r["shard"] << bits) + at: n for r in rows for at, n in zip(r["at"], r["number"], strict=True)} == want
    assert len(rows) > 4 and not list(filter_audit._pack(iter([])))


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(filter_audit, "PIECE", 10)
    for text in (b"", b" ", b"a" * 50, b"word " * 20, b"a" * 25 + b" b c\td" * 9):
        parts = list(filter_audit.pieces(text))
        assert b"".join(parts) == text and [w for p in parts for w in p.split()] == text.split()


def plain_divergence(rows, least=10, top=10):
    per, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        groups.add((lang, source))
        per[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in docs[lang].items() if d >= least]
        v, own = len(kept), sorted(s for x, s in groups if x == lang)
        whole = Counter()
        for s in own:
            whole.update(per[lang, s])

        def share(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (n + 2 * v) for t in kept}

        q, p = share(whole), {s: share(per[lang, s]) for s in own}
        for s in own:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t]), t) for t in kept if per[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out |= {(lang, s, part, item, value, i) for i, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1)}
    return out


def test_divergence_of_hard_texts(hard):
    assert {tuple(r) for r in divergence.audit(hard, least_docs=2, terms=3).collect()} == plain_divergence(HARD, 2, 3)
    assert {tuple(r) for r in divergence.audit(hard).collect()} == plain_divergence(HARD)
    assert divergence.audit(hard.limit(0)).count() == 0


def test_divergence_over_tiles_and_blocks(spark, monkeypatch):
    """23 sources in tiles of four, terms in several blocks, levels from 0 to thousands, one source with a third of all."""
    monkeypatch.setattr(divergence, "TILE", 4)
    monkeypatch.setattr(divergence, "BLOCK", 50)
    rng, data = random.Random(6), []
    vocabulary = [f"{a}{b}ü" for a in "abcdefghijklmnop" for b in "qrstuvwxyzäöß"]
    for i in range(900):
        lang = rng.choice(["en", "en", "de", None])
        source = "hot" if i % 3 == 0 else f"s{rng.randrange(22)}"
        data.append((i, " ".join(vocabulary[min(int(rng.expovariate(0.02)), len(vocabulary) - 1)].upper() for _ in range(rng.choice([0, 5, 60, 400]))), lang, source))
    df = spark.createDataFrame(data, COLUMNS)
    assert {tuple(r) for r in divergence.audit(df).collect()} == plain_divergence(data)


def test_level_products_are_exact():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 9, (64, 5)) ** 4
    totals, v = [10**15 + i for i in range(5)], 10**6
    side, got = divergence.one_hot(counts, totals, v), np.zeros((5, 5), np.int64)
    divergence.divergences(side, side, got)
    for g in range(5):
        for h in range(5):
            p, q = ([1 + 10**9 * (int(c) + 2) // (totals[k] + 2 * v) for c in counts[:, k]] for k in (g, h))
            assert got[g, h] == sum((a - b) ** 2 // (a + b) for a, b in zip(p, q))


def plain_license_labels(text):
    """Labels by phrases, by all lines, and by all windows that start at a word of a template."""
    t = lower(text)
    w, labels = re.findall(license_scan.WORD, t), set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        if any(w[i : i + len(p)] == p for i in range(len(w))):
            labels.add(label)
    for label, body in license_scan.TEMPLATES.items():
        own = license_scan.template_words(body)
        need, size = math.ceil(0.8 * len(own) - 1e-9), math.ceil(len(re.findall(license_scan.WORD, body)) / 0.8)
        blocks = [re.findall(license_scan.WORD, line) for line in t.split("\n")] + [w[i : i + size] for i, x in enumerate(w) if x in own]
        if any(len(set(own) & set(b)) >= need for b in blocks):
            labels.add(label)
    return ",".join(sorted(labels))


@pytest.mark.parametrize("limit", [license_scan.BROADCAST_ROWS, 0])
def test_licenses_equal_a_plain_version_with_windows(spark, docs, monkeypatch, limit):
    """Notices with words taken out, moved, and spread, at the limit and just below, in lines and over line ends."""
    monkeypatch.setattr(license_scan, "BROADCAST_ROWS", limit)
    rng, data = random.Random(3), []
    for i in range(400):
        body = re.findall(license_scan.WORD, rng.choice(list(license_scan.TEMPLATES.values())))
        for _ in range(rng.randrange(len(body) // 3 + 1)):
            body[rng.randrange(len(body))] = rng.choice(["other", "The", "license", "1"])
        for _ in range(rng.choice([0, 0, 2, 5, 30])):
            body.insert(rng.randrange(len(body) + 1), "x")
        data.append((i, "Some text\n" + "".join(x + rng.choice([" ", " ", ", ", "\n", "\n * "]) for x in body) + rng.choice(["", "MIT license", "and CC-BY"])))
    df = spark.createDataFrame(data, "doc_id long, text string").union(docs.select("doc_id", "text"))
    got = sorted((r["doc_id"], r["labels"]) for r in license_scan.scan(df).collect())
    assert got == sorted((r["doc_id"], plain_license_labels(r["text"])) for r in df.collect())


@pytest.mark.parametrize("name", ["op11_minhash", "op12_filter_audit", "op13_divergence"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = QUERIES[name](spark, sf)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(want, key=repr)
