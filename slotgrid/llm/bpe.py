"""BPE encoding by speculation: greedy longest match proposes, adjacent pairs are verified, failing words are merged exactly."""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches

#: Words in each of a worker's two generations of remembered ones, and characters of the longest one kept: the younger
#: generation takes the place of the older when full, which bounds the memory and changes no result.
REMEMBER, KEPT_CHARS = 60_000, 48
#: Symbols of a word beyond which merging keeps its pairs in a heap.
HEAP_FROM = 64
#: Bytes of text coded at once.
SLICE_BYTES = 1_000_000
NONE = 1 << 30
SPACE, LETTER, DIGIT, SIGN = range(4)
#: What may follow an apostrophe that begins a word, and forms one with it.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 characters stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Memory:
    """A bounded dictionary of two generations."""

    def __init__(self, room: int = REMEMBER):
        self.room, self.young, self.old = room, {}, {}

    def missing(self, keys: Iterable[str]) -> list[str]:
        """Those of `keys` that are not known; the known ones are young afterwards, so that none is lost before it is used."""
        if len(self.young) > self.room:
            self.young, self.old = {}, self.young
        young, old, out = self.young, self.old, []
        for key in keys:
            if key not in young:
                if key in old:
                    young[key] = old[key]
                else:
                    out.append(key)
        return out

    def forget(self, keys: list[str]) -> None:
        """Drops what is too long to be kept."""
        for key in keys:
            if len(key) > KEPT_CHARS:
                self.young.pop(key, None)


class WordBpe:
    """Encoder for a tokenizers file with word-end BPE: NFC, lower case, words split by a pattern, bytes as characters.

    Symbols are numbered by rank: first the single ones, then those made by the merges in order. So the merge of
    a pair with the lowest rank is the one that makes the smallest number.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end: str = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b for a, b in merges}
        self.names = [s for s in vocab if s not in made] + [a + b for a, b in merges]
        if len(set(self.names)) != len(self.names) or not made <= vocab.keys():
            raise ValueError(f"{path}: each merge must make one piece of its own")
        self.number = {s: i for i, s in enumerate(self.names)}
        self.decimals = [str(vocab[s]) for s in self.names]
        self.size = len(self.names)
        self.chars = _byte_chars()
        if any(c + e not in self.number for c in self.chars for e in ("", self.end)):
            raise ValueError(f"{path}: a byte has no symbol")
        self.spell = str.maketrans({chr(b): c for b, c in enumerate(self.chars)})
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if pattern != "|".join([*[f"'{s}" for s in SUFFIXES], r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"]):
            raise ValueError(f"{path}: words are cut in a way this encoder does not know: {pattern}")
        self.words = regex.compile(pattern)
        self.cuts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        first = self.size - len(merges)
        self.pairs = {self.number[a] * self.size + self.number[b]: first + i for i, (a, b) in enumerate(merges)}
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        self.left[first:], self.right[first:] = ([self.number[m[k]] for m in merges] for k in (0, 1))
        keys = np.array(list(self.pairs), np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_made = keys[order], np.array(list(self.pairs.values()), np.int64)[order]
        self.sizes = list(map(len, self.names))
        #: Per beginning of a piece within a word: the longest piece it starts with.
        self.starts: dict[str, int] = {}
        inner = {s: i for s, i in self.number.items() if not s.endswith(self.end)}
        for name in sorted(inner, key=len):
            for size in range(1, len(name) + 1):
                if name[:size] not in self.starts:
                    self.starts[name[:size]] = inner[name[:size]] if name[:size] in inner else self.starts[name[: size - 1]]
        self.final = {s.removesuffix(self.end): i for s, i in self.number.items() if s.endswith(self.end)}
        self.longest_final = max(map(len, self.final))
        makes = np.arange(first, self.size)
        self.sound = np.ones(self.size, bool)
        self.sound[makes] = self.compatible(self.left[makes], self.right[makes], makes)
        self.known = Memory()

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | int = NONE) -> np.ndarray:
        """Whether exact merging of the two symbols' spellings gives them back, for arrays of symbols that are sound alone.

        The merges that made both are undone from the last to the first. Each time, the symbols that then meet at the
        border must have no merge of their own that comes before the one undone; at equal ranks the left place merges first.
        """
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        limit = np.broadcast_to(np.asarray(limit, np.int64), a.shape)
        while len(at):
            keys = a * self.size + b
            place = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            bad = (self.pair_keys[place] == keys) & (self.pair_made[place] < limit)
            good[at[bad]] = False
            undone_a, undone_b = self.right[a], self.left[b]
            on_left = (a > b) & (undone_a != a) | (undone_b == b)
            more = ~bad & ~(on_left & (undone_a == a))
            limit = np.where(on_left, a, b + 1)[more]
            a, b = np.where(on_left, undone_a, a)[more], np.where(on_left, b, undone_b)[more]
            at = at[more]
        return good

    def merge(self, symbols: list[int]) -> list[int]:
        """Exact BPE: the adjacent pair of lowest rank, leftmost first, is joined until none is left."""
        if len(symbols) > HEAP_FROM:
            return self._merge_long(symbols)
        get, size = self.pairs.get, self.size
        made = [get(a * size + b, NONE) for a, b in zip(symbols, symbols[1:])]
        while made:
            best = min(made)
            if best == NONE:
                break
            i = made.index(best)
            symbols[i] = best
            del symbols[i + 1], made[i]
            if i < len(made):
                made[i] = get(best * size + symbols[i + 1], NONE)
            if i:
                made[i - 1] = get(symbols[i - 1] * size + best, NONE)
        return symbols

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same over linked places, in time near-linear in the word."""
        get, size, n = self.pairs.get, self.size, len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(made, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (made := get(a * size + b)) is not None]
        heapq.heapify(heap)
        while heap:
            made, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (new := get(made * size + symbols[k])) is not None:
                    heapq.heappush(heap, (new, i, made, symbols[k]))
            if (h := before[i]) >= 0 and (new := get(symbols[h] * size + made)) is not None:
                heapq.heappush(heap, (new, h, symbols[h], made))
        return [s for s in symbols if s >= 0]

    def symbols(self, spelled: str) -> list[int]:
        """The single symbols of a word, the last with the word end."""
        number = self.number
        return [*[number[c] for c in spelled[:-1]], number[spelled[-1] + self.end]]

    def propose(self, spelled: str) -> list[int]:
        """Greedy longest match over the vocabulary."""
        out, at, n = [], 0, len(spelled)
        starts, final, longest = self.starts, self.final, self.longest_final
        while True:
            if n - at <= longest and (whole := final.get(spelled[at:])) is not None:
                out.append(whole)
                return out
            found, stop = None, at + 1
            while stop < n and (next_found := starts.get(spelled[at:stop])) is not None:
                found, stop = next_found, stop + 1
            out.append(found)
            at += self.sizes[found]

    def learn(self, words: list[str]) -> None:
        """Encodes new words together: one vectorised check of all adjacent pairs of all proposals."""
        if not words:
            return
        spelled = [w if w.isascii() and w.isprintable() else w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.spell) for w in words]
        proposals = [self.propose(s) for s in spelled]
        sizes = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        bad = np.zeros(len(words), bool)
        bad[owner[~self.sound[flat]]] = True
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        bad[owner[inside[~self.compatible(flat[inside], flat[inside + 1])]]] = True
        decimals, names, known = self.decimals, self.names, self.known.young
        for word, spell, ids, failed in zip(words, spelled, proposals, bad.tolist()):
            if failed:
                ids = self.merge(self.symbols(spell))
            known[word] = (decimals[ids[0]], names[ids[0]]) if len(ids) == 1 else (" ".join([decimals[i] for i in ids]), " ".join([names[i] for i in ids]))

    def pieces(self, text: str) -> list[str]:
        """Words of a text in order; special tokens stay whole and keep their spelling."""
        out: list[str] = []
        for i, part in enumerate(self.cuts.split(text)):
            if i % 2:
                out.append(part)
            elif part:
                out.extend(self.words.findall(_normal(part)))
        return out

    def coded(self, words: list[str]) -> list[tuple[str, str]]:
        """Ids as decimals and tokens of each word, from memory or learnt together; special tokens are words of their own."""
        missing = self.known.missing(words)
        for name in self.special.keys() & set(missing):
            self.known.young[name] = (str(self.special[name]), name)
        self.learn([w for w in missing if w not in self.special])
        known = self.known.young
        out = [known[w] for w in words]
        self.known.forget(missing)
        return out

    def encode(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Per text: ids as decimals, and tokens, each joined by one space; the file names no decoder, and special tokens stay.

        The words of all texts are cut and numbered together, and each distinct one is coded once. A text with a special token is taken alone.
        """
        plain = texts.to_pylist()
        alone = {i: self.pieces(t) for i, t in enumerate(plain) if "<|" in t and self.cuts.search(t)}
        words, offsets = cut_words(["" if i in alone else t for i, t in enumerate(plain)])
        numbered = words.dictionary_encode()
        found = self.coded(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        offsets = pa.array(offsets, pa.int32())
        joined = [pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array([f[k] for f in found], pa.string()).take(numbered.indices)), " ") for k in (0, 1)]
        if alone:
            rows = [a.to_pylist() for a in joined]
            for i, own in alone.items():
                distinct = list(dict.fromkeys(own))
                parts = dict(zip(distinct, self.coded(distinct)))
                for k in (0, 1):
                    rows[k][i] = " ".join([parts[w][k] for w in own])
            joined = [pa.array(r, pa.string()) for r in rows]
        return joined[0], joined[1]


def _normal(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "\u03a3" in text:
            return "".join(map(str.lower, text))
    return text.lower()


@functools.cache
def _kinds() -> np.ndarray:
    """The kind of each code point in the terms of the word pattern: white space, letter, number, or neither."""
    kinds = np.full(0x110000, SIGN, np.uint8)
    for first, last in ((0, 0xD800), (0xE000, 0x110000)):
        every = np.arange(first, last, dtype=np.uint32).tobytes().decode("utf-32-le")
        for pattern, kind in ((r"\s+", SPACE), (r"\p{L}+", LETTER), (r"\p{N}+", DIGIT)):
            for run in regex.finditer(pattern, every):
                kinds[first + run.start() : first + run.end()] = kind
    kinds[0x1C:0x20] = SIGN
    return kinds


def cut_words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, as the word pattern cuts them after NFC and lower case, and where each text's words begin among them.

    A word is a run of letters, one number, or a run of signs; an apostrophe that begins a run of signs and stands before
    one of `SUFFIXES` forms a word with it.
    """
    texts = [_normal(t) for t in texts]
    points = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    kinds = _kinds()[points]
    first = np.concatenate([[True], kinds[1:] != kinds[:-1]]) | (kinds == DIGIT)
    marks = np.flatnonzero((points == 39) & first)
    padded = np.concatenate([points, np.zeros(2, np.uint32)])
    after, second = padded[marks + 1], padded[marks + 2]
    reach = np.zeros(len(marks), np.int64)
    for suffix in SUFFIXES:
        fits = (after == ord(suffix[0])) & (second == ord(suffix[1]) if len(suffix) == 2 else True)
        reach[fits & (reach == 0)] = len(suffix)
    formed = marks[reach > 0]
    ends = formed + 1 + reach[reach > 0]
    first[formed + 1] = False
    first[ends] |= kinds[ends] != SPACE
    starts = np.flatnonzero(first & (kinds != SPACE))
    # a word ends where the next place is white space or begins another one
    last = np.concatenate([(first | (kinds == SPACE))[1:], [True]]) & (kinds != SPACE)
    bytes_before = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), dtype=np.int64)])
    stops = np.flatnonzero(last) + 1
    inked = np.repeat(kinds != SPACE, np.diff(bytes_before))
    data = np.frombuffer((" ".join(texts) + " ").encode("utf-8", "surrogatepass"), np.uint8)[inked]
    places = np.concatenate([[0], np.cumsum(bytes_before[stops] - bytes_before[starts])]).astype(np.int32)
    made = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data))
    return made, np.searchsorted(starts, begins)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of neighbouring texts of about `most` bytes together; a longer text is alone."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)))
    start = 0
    while start < len(sizes):
        before = int(sizes[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield start, stop - start
        start = stop


def _path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return path


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One encoder per worker process and file."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256 [, ids]): one row per row of `docs`, whole texts.

    Hashes are lower-case hex of the decimal ids joined by one space and of the decoded text. Null texts count as
    empty: no tokens, hashes of the empty string. Ids may be null or repeat; each row gives its own. `path` names
    the vocabulary file on the executors. Other columns are not read; an empty table gives an empty one.
    """
    path = _path(path)
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    schema = f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def hashes(texts: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(t.as_buffer() or b"").hexdigest() for t in texts], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in batches:
            for start, size in slices(whole.column(1)):
                part = whole.slice(start, size)
                ids, names = bpe.encode(pc.fill_null(part.column(1), ""))
                sizes = np.where(pc.binary_length(ids).to_numpy() > 0, pc.count_substring(ids, " ").to_numpy() + 1, 0)
                columns = [part.column(0), pa.array(sizes, pa.int64()), hashes(ids), hashes(names)]
                if with_ids:
                    flat = np.fromstring(" ".join(filter(None, ids.to_pylist())), np.int32, sep=" ")
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text"))
    return plain.mapInArrow(run, schema)
