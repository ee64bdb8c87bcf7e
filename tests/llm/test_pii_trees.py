"""Personal data beyond the base spans: recall of planted spans, clean texts, and a plain version of all spans."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotgrid.llm import pii

from test_operators import plain_pii, rows

BIG = "/root/testdata/sf0.01/documents.parquet"


def other_spans(cell):
    return [s.split(":")[0] for s in cell.split(",") if s]


@pytest.fixture(scope="module")
def found(spark):
    """Trees and limits learnt from the small documents, once."""
    docs = spark.read.parquet(BIG).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return pii.train(docs, "text")


def spans(spark, monkeypatch, found, texts):
    monkeypatch.setattr(pii, "train", lambda *_: found)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(rows(pii.find_pii(df).select("doc_id", pii.joined(F.col("spans")))))
    return [got[i] for i in range(len(texts))]


def test_planted_spans_are_found(spark, monkeypatch, found):
    """Formats and words of the test's own, in documents that taught nothing."""
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    letters = lambda n: "".join(rng.choices("abcdefghijklmnop", k=n))
    kinds = {
        "number": lambda: rng.choice([f"call {digits(3)}-{digits(3)}-{digits(4)}", f"my ssn is {digits(3)}-{digits(2)}-{digits(4)}", f"tel ({digits(3)}) {digits(3)}-{digits(4)}"]),
        "spoken_email": lambda: rng.choice([f"{letters(5)} (at) {letters(6)} (dot) com", f"{letters(8)}(at){letters(4)}.org", f"mail {letters(3)} [at] {letters(7)} (dot) net"]),
        "secret": lambda: rng.choice([f'api_key = "{letters(10)}{digits(14)}{letters(8)}"', f"token: {digits(6)}{letters(26)}", f"password={letters(4)}{digits(20)}"]),
    }
    held = [r[0].split() for r in spark.read.parquet(BIG).where("pmod(xxhash64(xxhash64(text)), 2) = 1").select("text").limit(200).collect()]
    want, texts = [], []
    for kind, make in kinds.items():
        for _ in range(60):
            words = [w for w in rng.choice(held)[:80] if not re.search("[0-9@+]", w)]
            at = rng.randrange(len(words) + 1)
            texts.append(" ".join([*words[:at], make(), *words[at:]]))
            want.append(kind)
    got = spans(spark, monkeypatch, found, texts)
    for kind in kinds:
        hits = [kind in other_spans(g) for g, w in zip(got, want) if w == kind]
        assert sum(hits) >= 0.9 * len(hits), (kind, sum(hits))
    probes = ["my ssn is 078-05-1120 thanks", "write to joe (at) mail (dot) com please", "joe (at) mail (dot) com", "call 555-867-5309 now"]
    assert all(other_spans(g) for g in spans(spark, monkeypatch, found, probes))


def test_clean_documents_are_left_alone(spark, monkeypatch, found):
    rng = random.Random(9)
    clean = [f"on {rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)} we met in the old town" for _ in range(60)]
    clean += [f"from {rng.randint(1900, 1950)} - {rng.randint(1951, 1999)} the house stood empty" for _ in range(60)]
    clean += [f"about 3.{rng.randint(1_000_000, 9_999_999)} of it, see section-of-the-{rng.randint(1, 99)}-part for more" for _ in range(60)]
    got = spans(spark, monkeypatch, found, clean)
    assert sum(bool(g) for g in got) <= 0.05 * len(clean)
    assert set(found[1]) == set(pii.GENERATORS) and all(np.isfinite(v) for v in found[1].values())
    split_on = {pii.FEATURES[f] for f in found[0].feature if f >= 0}
    assert {"hint", "equals"} & split_on


def plain_features(text, at, what):
    n, before = len(what), text[max(0, at - 24) : at]
    share = lambda p: len(re.findall(p, what)) / n
    return [
        n, share("[0-9]"), share("[A-Za-z]"), share("[A-Z]"), len(re.findall("[ /-]", what)), len(re.findall("[0-9]+", what)), share("[0-9a-f]"), what.count("."),
        len(re.findall(r"@|at[)}]|at\]", what)), bool(re.search(pii.HINTS, before)), bool(re.search(r"[=:]\s*\"?$", before)), before.endswith("+"),
    ]


def plain_spans(text, found):
    """All spans of one text: base ones, then per generator what overlaps none of them and reaches its limit."""
    forest, limits = found
    base = plain_pii(text)
    taken = [tuple(map(int, s.split(":")[1:])) for s in base.split(",") if s]
    out = [s for s in base.split(",") if s]
    for kind, pattern in pii.GENERATORS.items():
        last = 0
        for m in re.finditer(pattern, text):
            a, b = m.span()
            before = text[last:a]
            last = b
            if any(x < b and a < y for x, y in taken):
                continue
            x = np.array([plain_features(before, len(before), m[0])], float)
            if forest.raw(x)[0] >= limits[kind]:
                out.append(f"{kind}:{a}:{b}")
    return ",".join(out)


def test_spans_against_a_plain_version(spark, monkeypatch, found):
    texts = [r[0] for r in spark.read.parquet(BIG).select("text").limit(300).collect()]
    texts += ["", "call 555-867-5309 or +1 (743) 555-3824", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"' * 3, "joe (at) mail (dot) com, a@b.co 10.0.0.1", "é 😀 tel 555-867-5309 😀", "12 345 678 " * 50]
    got = spans(spark, monkeypatch, found, texts)
    assert got == [plain_spans(t or "", found) for t in texts]


def test_few_and_odd_rows(spark):
    """Tables too small to teach, null, empty and repeated texts."""
    df = spark.createDataFrame([(1, None, 1), (1, "", 2), (None, "a@b.co", 3), (2, "a@b.co", 4), (2, "a@b.co", 4)], "doc_id long, text string, hint int")
    got = sorted(rows(pii.find_pii(df).select("doc_id", pii.joined(F.col("spans")))), key=repr)
    assert got == sorted([(1, ""), (1, ""), (None, "email:0:6"), (2, "email:0:6"), (2, "email:0:6")], key=repr)
