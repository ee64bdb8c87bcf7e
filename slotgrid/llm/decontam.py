"""Benchmark decontamination with a generalised suffix automaton over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, small_batches

WINDOW = 10
#: Characters of item text in one automaton; a larger benchmark is split into several, one pass each.
SHARD_CHARS = 4_000_000
COVERAGE = 0.5

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters (A-Z lowered), digits and all characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Automaton:
    """Suffix automaton of all items: a state for each class of word sequences that end at the same places."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.length, self.link = [0], [-1]
        step: list[dict[int, int]] = [{}]
        ends: list[tuple[int, int, str]] = []
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            last = 0
            for at, word in enumerate(ids):
                last = self._extend(step, last, word)
                if at + 1 >= window or at + 1 == len(ids):
                    ends.append((last, min(window, at + 1), name))
        self.step = step
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, set[tuple[int, str]]] = {}
        for state, size, name in ends:
            while self.length[self.link[state]] >= size:
                state = self.link[state]
            if size == window:
                self.items.setdefault(state, set()).add(name)
            else:
                self.short.setdefault(state, set()).add((size, name))
        self._mark()

    def _extend(self, step: list[dict[int, int]], last: int, word: int) -> int:
        """Adds one word after state `last`, which ends the present item's prefix."""
        length, link = self.length, self.link
        if word in step[last]:
            q = step[last][word]
            return q if length[q] == length[last] + 1 else self._clone(step, last, word, q)
        new = len(length)
        length.append(length[last] + 1), link.append(0), step.append({})
        p = last
        while p >= 0 and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if p >= 0:
            q = step[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(step, p, word, q)
        return new

    def _clone(self, step: list[dict[int, int]], p: int, word: int, q: int) -> int:
        twin = len(self.length)
        self.length.append(self.length[p] + 1), self.link.append(self.link[q]), step.append(dict(step[q]))
        self.link[q] = twin
        while p >= 0 and step[p].get(word) == q:
            step[p][word] = twin
            p = self.link[p]
        return twin

    def _mark(self) -> None:
        """For each state: the state that holds its last `window` words, and the nearest ancestor or self with a short item."""
        n = len(self.length)
        self.full, self.brief = [-1] * n, [-1] * n
        for s in sorted(range(n), key=self.length.__getitem__):
            up = self.link[s]
            if up >= 0:
                self.full[s] = self.full[up]
                self.brief[s] = self.brief[up]
                if self.full[s] < 0 and self.length[s] >= self.window:
                    self.full[s] = s
            if s in self.short:
                self.brief[s] = s
        self.least = min([self.window, *(size for found in self.short.values() for size, _ in found)])

    def spans(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged [start, end) word spans inside any window of an item, and the names of the items found."""
        ids = np.fromiter((self.vocabulary.get(w, -1) for w in tokens), np.int64, len(tokens))
        known = np.flatnonzero(np.diff(np.concatenate([[0], ids >= 0, [0]])))
        found: list[tuple[int, int]] = []
        names: set[str] = set()
        step, link, length, window = self.step, self.link, self.length, self.window
        for start, stop in zip(known[::2].tolist(), known[1::2].tolist()):
            if stop - start < self.least:
                continue
            state = run = 0
            for at, word in enumerate(ids[start:stop].tolist(), start + 1):
                while state and word not in step[state]:
                    state = link[state]
                    run = length[state]
                if word in step[state]:
                    state, run = step[state][word], run + 1
                else:
                    run = 0
                    continue
                hit = 0
                if run >= window:
                    # the class of the last `window` words: this state unless they sit in a shorter ancestor
                    names |= self.items.get(self.full[state], set())
                    hit = window
                brief = self.brief[state]
                while brief >= 0:
                    for size, name in self.short[brief]:
                        if size <= run:
                            names.add(name)
                            hit = max(hit, size)
                    brief = self.brief[link[brief]] if link[brief] >= 0 else -1
                if hit:
                    first = at - hit
                    while found and first <= found[-1][1]:
                        first = min(first, found.pop()[0])
                    found.append((first, at))
        return found, names


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` without the words of `spans` and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    mask = np.frombuffer(raw.translate(_WORDS), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
    starts, stops = edges[::2], edges[1::2]
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : starts[a]])
        at = stops[b - 1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def _shards(benchmark: DataFrame, item_col: str, text_col: str, shard_chars: int) -> Iterator[tuple[int, list[tuple[str, str]]]]:
    """How many lists come and a list of items of about `shard_chars` characters, one on the driver at a time."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = max(1, -(-total // shard_chars))
    for shard in range(n):
        yield n, [tuple(r) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == shard).toLocalIterator()]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", *, window: int = WINDOW, shard_chars: int = SHARD_CHARS
) -> DataFrame:
    """`docs` plus a struct `contamination`: n_words, n_hit (long), items (sorted strings), spans ([start, end) word places).

    Words are lower-cased runs as in `words`; a document word is hit if it stands inside an occurrence of `window`
    consecutive words of an item, or of a whole item that has fewer. Texts stream through the automaton word by word.
    A benchmark of more than `shard_chars` characters is split over several automata, each a pass, whose spans are merged.
    Null and empty texts have no words; items with a null id or text or without words take no part; items repeated
    under one id count once; all columns of `docs` pass through (one named contamination is replaced). Empty tables give empty results.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:bigint,stop:bigint>>>"
    out = docs.drop("contamination").withColumn("contamination", F.lit(None).cast(kind))
    names = out.columns
    place = names.index(text_col)
    scratch = Scratch(spark, "decontam")
    for n_shards, items in _shards(benchmark, item_col, item_text, shard_chars):
        shared = spark.sparkContext.broadcast(Automaton(items, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, place=place) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in batches:
                made = []
                for text, before in zip(batch.column(place), batch.column(batch.num_columns - 1)):
                    tokens = words(text.as_py())
                    spans, found = automaton.spans(tokens)
                    if old := before.as_py():
                        spans = _merge(spans + [(s["start"], s["stop"]) for s in old["spans"]])
                        found |= set(old["items"])
                    made.append({"n_words": len(tokens), "n_hit": sum(b - a for a, b in spans), "items": sorted(found), "spans": [{"start": a, "stop": b} for a, b in spans]})
                column = pa.array(made, batch.schema.field(batch.num_columns - 1).type)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], schema=batch.schema)

        out = out.mapInArrow(run, out.schema)
        if n_shards > 1:
            # one automaton lives at a time: its pass is written before the next one is built
            out = scratch.keep(out)
            shared.unpersist()
    return out


def item_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE, **options) -> DataFrame:
    """`docs` without benchmark passages: spans over the length limit are cut out, documents covered to more than `coverage` go.

    The length limit is the window: any matched span of `window` words or more (or a whole shorter item).
    Columns stay those of `docs`; edge cases are those of `find_contamination`.
    """
    marked = find_contamination(docs, benchmark, id_col, text_col, **options)
    marked = marked.where("contamination.n_hit <= %r * contamination.n_words OR contamination.n_hit = 0" % coverage)
    place, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, found in zip(batch.column(place), batch.column(batch.num_columns - 1)):
                text, spans = text.as_py(), [(s["start"], s["stop"]) for s in found.as_py()["spans"]]
                texts.append(_cut(text, spans) if spans else text)
            columns = [pa.array(texts, c.type) if i == place else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return marked.mapInArrow(run, docs.schema)
