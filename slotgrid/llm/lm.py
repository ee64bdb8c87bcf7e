"""Language-model scoring: the marginal probability of a text over all its segmentations into vocabulary pieces."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

FOLDS, HELD_OUT = 7, 2
#: Words in the broadcast table of the most frequent ones; all others are joined by shuffle.
FREQUENT = 200_000
#: Distinct words or row keys that a task counts before it hands them on.
FLUSH = 200_000
#: Weight of the vocabulary's own scores, in pieces, against the counts of the corpus.
PRIOR = 1_000.0
#: Expectation steps over the distinct words of the corpus.
STEPS = 3
END = "</s>"
LN10 = math.log(10)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def vocabulary(path: str) -> dict[str, float]:
    """Natural log weights of the existing pieces: p is in proportion to 1 / (1 - score), since this vocabulary's scores are negative ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weights = {}
    for i in range(model.get_piece_size()):
        if not model.is_control(i) and not model.is_unknown(i):
            score = -float(model.get_piece_size()) if model.is_byte(i) else model.get_score(i)
            weights[model.id_to_piece(i)] = 1 / (1 + max(0.0, -score))
    weights[END] = 1 / (1 + len(weights))
    total = math.fsum(weights.values())
    return {piece: math.log(w / total) for piece, w in weights.items()}


class Lattice:
    """Forward and backward recursion in log space; a character that is no piece is spelled by its byte pieces.

    Pieces sit in a tree of characters, so the arcs from a place are found in one walk that ends where no piece goes on.
    """

    def __init__(self, logs: dict[str, float]):
        self.logs = logs
        self.tree: dict = {}
        for piece, log in logs.items():
            node = self.tree
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = log

    def arcs(self, text: str, start: int) -> list[tuple[int, float]]:
        """(stop, log weight) of the arcs from `start`."""
        node, out = self.tree, []
        for stop in range(start, len(text)):
            node = node.get(text[stop])
            if node is None:
                break
            log = node.get("")
            if log is not None:
                out.append((stop + 1, log))
        if not out or out[0][0] != start + 1:
            out.insert(0, (start + 1, sum([self.logs[s] for s in self.spelled(text[start])])))
        return out

    @staticmethod
    def spelled(char: str) -> list[str]:
        return [f"<0x{b:02X}>" for b in char.encode("utf-8", "surrogatepass")]

    def forward(self, text: str) -> tuple[list[float], list[list[tuple[int, float]]]]:
        """Log weight of all paths to each place, and the arcs from it."""
        n, exp, log = len(text), math.exp, math.log
        terms: list[list[float]] = [[] for _ in range(n + 1)]
        alpha, arcs = [0.0] * (n + 1), []
        for start in range(n):
            if start:
                here = terms[start]
                top = max(here)
                alpha[start] = top if len(here) == 1 else top + log(sum([exp(t - top) for t in here]))
            found = self.arcs(text, start)
            arcs.append(found)
            for stop, weight in found:
                terms[stop].append(alpha[start] + weight)
        top = max(terms[n])
        alpha[n] = top + log(sum([exp(t - top) for t in terms[n]]))
        return alpha, arcs

    def marginal(self, word: str) -> float:
        return self.forward("\u2581" + word)[0][-1]

    def expect(self, word: str, times: float, into: dict[str, float]) -> None:
        """Adds the expected piece counts of `times` occurrences of a word."""
        text, exp = "\u2581" + word, math.exp
        alpha, arcs = self.forward(text)
        whole, beta = alpha[-1], [0.0] * len(alpha)
        for start in range(len(arcs) - 1, -1, -1):
            paths = [beta[stop] + weight for stop, weight in arcs[start]]
            top = max(paths)
            beta[start] = top if len(paths) == 1 else top + math.log(sum([exp(t - top) for t in paths]))
            for (stop, _), path in zip(arcs[start], paths):
                share = times * exp(alpha[start] + path - whole)
                piece = text[start:stop]
                for part in [piece] if piece in self.logs else self.spelled(piece):
                    into[part] = into.get(part, 0.0) + share


#: Characters of a word beyond which it is taken alone; shorter ones are taken many at a time.
ALONE_FROM = 64
_POINTS = 0x110000


class Trie:
    """The pieces as a tree in arrays: `edges` are sorted keys of node and code point, `child` the nodes they lead to, `piece` the piece that ends at a node or -1."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        step: list[dict[int, int]] = [{}]
        piece = [-1]
        for i, name in enumerate(pieces):
            node = 0
            for char in map(ord, name):
                if char not in step[node]:
                    step[node][char] = len(step)
                    step.append({}), piece.append(-1)
                node = step[node][char]
            piece[node] = i
        found = sorted((node * _POINTS + char, to) for node, out in enumerate(step) for char, to in out.items())
        self.edges, self.child = np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64)
        self.piece = np.array(piece, np.int64)

    def go(self, node: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The nodes after one more code point each, -1 where no piece goes on."""
        keys = node * _POINTS + points
        at = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
        return np.where(self.edges[at] == keys, self.child[at], -1)


class Lattices:
    """The lattices of many words at once: all arcs as arrays, in one numbering of all places of all words."""

    def __init__(self, trie: Trie, words: list[str]):
        texts = ["\u2581" + w for w in words]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.repeat(np.cumsum(sizes), sizes)
        owner = np.repeat(np.arange(len(texts)), sizes)
        found, depth = [], 1
        unique, back = np.unique(points, return_inverse=True)
        active, node = np.arange(len(points)), self._roots(trie, unique)[back]
        single = np.zeros(len(points), bool)
        while True:
            active, node = active[node >= 0], node[node >= 0]
            if not len(active):
                break
            piece = trie.piece[node]
            ends_here = piece >= 0
            found.append((active[ends_here], np.full(int(ends_here.sum()), depth), piece[ends_here]))
            if depth == 1:
                single[active[ends_here]] = True
            inside = active + depth < ends[active]
            active, node = active[inside], node[inside]
            node = trie.go(node, points[active + depth])
            depth += 1
        spelled = np.flatnonzero(~single)
        found.append((spelled, np.ones(len(spelled), np.int64), -1 - points[spelled]))
        start, length, self.piece = (np.concatenate(c) for c in zip(*found))
        #: Place numbers: a word of n characters has n + 1 places.
        self.start = start + owner[start]
        self.stop = self.start + length
        self.first = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        self.last = self.first + sizes
        self.places = int(len(points) + len(texts))
        self.word = owner[start]
        self.depth = int(sizes.max(initial=0))

    @staticmethod
    def _roots(trie: Trie, points: np.ndarray) -> np.ndarray:
        return trie.go(np.zeros(len(points), np.int64), points)

    def weights(self, logs: np.ndarray, spelled: dict[int, float]) -> np.ndarray:
        """Log weight of each arc; a character without a piece weighs what its byte pieces weigh together."""
        out = logs[np.maximum(self.piece, 0)]
        odd = np.flatnonzero(self.piece < 0)
        if len(odd):
            chars, back = np.unique(-1 - self.piece[odd], return_inverse=True)
            out[odd] = np.array([spelled[c] for c in chars.tolist()])[back]
        return out

    def _sweep(self, begin: np.ndarray, source: np.ndarray, target: np.ndarray, distance: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Log sums over all paths from `begin` (one place a word) along arcs from `source` to `target`, which lies `distance` places from the begin."""
        total = np.full(self.places, -np.inf)
        total[begin] = 0.0
        order = np.argsort(distance * np.int64(self.places) + target, kind="stable")
        source, target, weight = source[order], target[order], weight[order]
        cuts = np.searchsorted(distance[order], np.arange(1, self.depth + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            ends, terms = target[a:b], total[source[a:b]] + weight[a:b]
            groups = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]]))
            top = np.maximum.reduceat(terms, groups)
            width = np.diff(np.concatenate([groups, [b - a]]))
            total[ends[groups]] = top + np.log(np.add.reduceat(np.exp(terms - np.repeat(top, width)), groups))
        return total

    def forward(self, weight: np.ndarray) -> np.ndarray:
        return self._sweep(self.first, self.start, self.stop, self.stop - self.first[self.word], weight)

    def marginals(self, weight: np.ndarray) -> np.ndarray:
        """Log weight of all segmentations of each word."""
        return self.forward(weight)[self.last]

    def expect(self, weight: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected uses of each arc in `times` occurrences of its word."""
        alpha = self.forward(weight)
        beta = self._sweep(self.last, self.stop, self.start, self.last[self.word] - self.start, weight)
        return times[self.word] * np.exp(alpha[self.start] + weight + beta[self.stop] - alpha[self.last][self.word])


class Scorer:
    """Weights of the pieces with what tasks need to apply them to batches of words."""

    def __init__(self, trie: Trie, logs: dict[str, float]):
        self.trie, self.logs = trie, logs
        self.values = np.array([logs[p] for p in trie.pieces])
        self.bytes = [logs[f"<0x{b:02X}>"] for b in range(256)]
        self.plain: Lattice | None = None

    def _spelled(self, lattices: Lattices) -> dict[int, float]:
        chars = np.unique(-1 - lattices.piece[lattices.piece < 0]).tolist()
        return {c: sum([self.bytes[b] for b in chr(c).encode("utf-8", "surrogatepass")]) for c in chars}

    def _long(self) -> Lattice:
        if self.plain is None:
            self.plain = Lattice(self.logs)
        return self.plain

    def marginals(self, words: list[str]) -> list[float]:
        out = [0.0] * len(words)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= ALONE_FROM]
        if short:
            lattices = Lattices(self.trie, [words[i] for i in short])
            for i, log in zip(short, lattices.marginals(lattices.weights(self.values, self._spelled(lattices))).tolist()):
                out[i] = log
        for i, w in enumerate(words):
            if len(w) > ALONE_FROM:
                out[i] = self._long().marginal(w)
            elif not w:
                out[i] = self.logs[END]
        return out

    def expect(self, words: list[str], times: list[int], into: np.ndarray, rest: dict[str, float]) -> None:
        """Adds expected piece counts of the words to `into`, by piece; those of byte pieces, long words and ends to `rest`, by name."""
        short = [i for i, w in enumerate(words) if 0 < len(w) <= ALONE_FROM]
        if short:
            lattices = Lattices(self.trie, [words[i] for i in short])
            counts = lattices.expect(lattices.weights(self.values, self._spelled(lattices)), np.array([times[i] for i in short], float))
            known = lattices.piece >= 0
            into += np.bincount(lattices.piece[known], counts[known], len(into))
            chars, back = np.unique(-1 - lattices.piece[~known], return_inverse=True)
            for char, n in zip(chars.tolist(), np.bincount(back, counts[~known], len(chars)).tolist()):
                for b in chr(char).encode("utf-8", "surrogatepass"):
                    rest[f"<0x{b:02X}>"] = rest.get(f"<0x{b:02X}>", 0.0) + n
        for w, n in zip(words, times):
            if len(w) > ALONE_FROM:
                self._long().expect(w, n, rest)
            elif not w:
                rest[END] = rest.get(END, 0.0) + n


def _trains(doc: int | None, folds: int, held_out: int) -> bool:
    return doc is not None and zlib.crc32(str(doc).encode()) % folds != held_out


def count_words(docs: DataFrame, folds: int, held_out: int) -> DataFrame:
    """(word, c): every distinct word of `docs` (id, text) with its count in the training rows; the end is the word ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            made = [pa.array([w.decode("utf-8", "surrogatepass") for w in counts]), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(made, names=["word", "c"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words(text.as_py())
                counts[b""] += 0
                if _trains(doc, folds, held_out):
                    counts.update(found)
                    counts[b""] += 1
                else:
                    counts.update(dict.fromkeys(found, 0))
                if len(counts) > FLUSH:
                    yield out()
        if counts:
            yield out()

    return docs.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def learn(counts: DataFrame, trie: Trie, logs: dict[str, float], prior: dict[str, float]) -> dict[str, float]:
    """Natural log probabilities of the pieces after an expectation step from `logs` over all training words; at most one row a piece reaches the driver."""
    shared = counts.sparkSession.sparkContext.broadcast(Scorer(trie, logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, rest = shared.value, {}
        expected = np.zeros(len(scorer.values))
        for batch in batches:
            scorer.expect(batch.column(0).to_pylist(), batch.column(1).to_pylist(), expected, rest)
        used = np.flatnonzero(expected)
        names, values = [scorer.trie.pieces[i] for i in used.tolist()] + list(rest), expected[used].tolist() + list(rest.values())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.float64())], names=["piece", "n"])

    rows = counts.where("c > 0").mapInArrow(run, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    expected = dict(zip(rows["piece"].to_pylist(), rows["n"].to_pylist()))
    total = math.fsum(expected.values()) + PRIOR
    return {piece: math.log((expected.get(piece, 0.0) + PRIOR * math.exp(log)) / total) for piece, log in prior.items()}


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, folds: int = FOLDS, held_out: int = HELD_OUT, frequent: int = FREQUENT) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per row of `docs`.

    Words (A-Z lowered, split at ASCII white space) and one end are tokens. base_score is the add-one word unigram
    in log10 over the training rows, crc32(id) mod `folds` not `held_out`. score is the log10 probability under the
    subword model: pieces of the existing vocabulary `path`, with probabilities from its scores and the
    training corpus, summed over all segmentations of each word (pieces do not cross words), times the end.
    Null texts have the end alone; a null id trains nothing and has a null held_out; rows with equal ids keep
    their own scores. Other columns are not read; an empty table gives an empty one.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = scratch.keep(count_words(plain, folds, held_out))
    train_tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    prior = logs = vocabulary(path)
    trie = Trie(list(prior))
    for _ in range(STEPS):
        logs = learn(counts, trie, logs, prior)
    shared_logs = spark.sparkContext.broadcast(Scorer(trie, logs))
    floor = train_tokens + distinct + 1

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array(shared_logs.value.marginals(batch.column(0).to_pylist())) / LN10
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["word", "c", "log"])

    weighed = scratch.keep(counts.mapInArrow(weigh, "word string, c long, log double"))
    top = weighed.orderBy(F.desc("c"), "word").limit(frequent).toArrow()
    table = {w.encode("utf-8", "surrogatepass"): (c, log) for w, c, log in zip(*(top[n].to_pylist() for n in ("word", "c", "log")))}
    end = weighed.where("word = ''").select("c", "log").first()
    table[b""] = tuple(end) if end else (0, 0.0)
    shared_table = spark.sparkContext.broadcast(table)
    rare_type = "array<struct<word:string,n:bigint>>"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared_table.value
        for batch in batches:
            made = []
            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = Counter(words(text.as_py()))
                found[b""] = 1
                n = n_known = 0
                base = score = 0.0
                rare = []
                for word, k in found.items():
                    n += k
                    hit = known.get(word)
                    if hit is None:
                        rare.append({"word": word.decode("utf-8", "surrogatepass"), "n": k})
                    else:
                        n_known += k * (hit[0] > 0)
                        base += k * math.log10((hit[0] + 1) / floor)
                        score += k * hit[1]
                held = None if doc is None else not _trains(doc, folds, held_out)
                made.append({"row": row, "id": doc, "held_out": held, "n_tokens": n, "n_known": n_known, "base": base, "score": score, "rare": rare})
            yield pa.RecordBatch.from_pylist(made, schema=arrow)

    rare_arrow = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))
    arrow = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", rare_arrow)])
    parts = scratch.keep(
        plain.select(F.monotonically_increasing_id().alias("row"), "id", "text").mapInArrow(
            split, f"row long, id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare {rare_type}"
        )
    )
    each = parts.select("row", F.explode("rare").alias("w")).select("row", F.col("w.word").alias("word"), F.col("w.n").alias("n"))
    sums = (
        each.join(weighed, "word")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"),
            F.sum(F.col("n") * F.log10((F.col("c") + 1) / F.lit(floor))).alias("more_base"),
            F.sum(F.col("n") * F.col("log")).alias("more_score"),
        )
    )
    return parts.drop("rare").join(sums, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
