"""BPE encoding and decoding with forced-boundary splitting.

A merge can only join two symbols that stand side by side inside some vocabulary token. A pair of neighbouring bytes
that occurs inside no token therefore is a certain cut: no merge ever crosses it. Each word is cut at those pairs, the
fragments are merged independently, and the ids are concatenated. The pair that ends a word is judged apart, since the
last symbol carries the end-of-word mark. The fragments of all new words of some texts are merged side by side in arrays.

Defined results: a null text is an empty one; an empty text has no ids and decodes to ''; texts of any length are
encoded whole; the strings of added tokens inside a text become their ids. Repeated rows each get their result.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm.common import Recent, append

#: Blanks below U+0250, at which str.split() parts, too. Texts with higher characters, or with the four separators that
#: only str.split() takes for blanks, go through the tokenizer file's own normaliser and splitter.
LATIN_BLANK = r"\t-\r \x85\xa0"
#: Entries of each cache of a worker, at about 300 bytes.
CACHE = 128_000
#: Characters of texts that are looked up together; a longer text is alone.
GROUP = 1 << 20
#: Fragments of more bytes are merged one by one.
LONG = 60
#: The offer of neighbours that do not merge.
NONE = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        out.setdefault(b, chr(256 + b - sum(p < b for p in plain)))
    return [out[b] for b in range(256)]


def joined(parts: list[tuple[bytes, str]]) -> tuple[bytes, str]:
    ids, tokens = zip(*parts, strict=True) if parts else ((), ())
    return b"".join(ids), " ".join(tokens)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and how long they are."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return first, np.diff(np.r_[first, len(keys)])


class Codec:
    """Encoder and decoder for a lower-casing byte-level BPE file whose words end in a suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.added.items()}
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a] << 16 | self.vocab[b]] = rank << 16 | self.vocab[a + b]
        if len(self.vocab) >= 1 << 16:
            raise ValueError("ids of 16 bits are expected")
        self.symbols = byte_symbols()
        self.byte = {s: b for b, s in enumerate(self.symbols)}
        self.plain = np.array([self.vocab.get(s, -1) for s in self.symbols])
        self.last = np.array([self.vocab.get(s + self.suffix, -1) for s in self.symbols])
        self.pair_keys = np.array(sorted(self.merges))
        self.pair_made = np.array([self.merges[k] for k in self.pair_keys.tolist()])
        self.allowed = self._allowed()
        self.library = Tokenizer.from_file(path)
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.latin = regex.compile(pattern.replace(r"[^\s", f"[^{LATIN_BLANK}"))
        self.high = regex.compile("[^\\x00-\\x1b\\x20-ɏ]")
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.words, self.chunks, self.pieces = Recent(CACHE), Recent(CACHE), Recent(CACHE)

    def _allowed(self) -> np.ndarray:
        """Whether a token holds two neighbouring bytes: [0] before the last symbol of a word, [1] at its end."""
        out = np.zeros((2, 1 << 16), bool)
        for token in self.vocab:
            ends = bool(self.suffix) and token.endswith(self.suffix)
            body = [self.byte.get(c) for c in (token[: -len(self.suffix)] if ends else token)]
            for i, (x, y) in enumerate(zip(body, body[1:], strict=False)):
                if x is not None and y is not None:
                    out[int(ends and i == len(body) - 2), x << 8 | y] = True
        return out if self.suffix else out[[0, 0]]

    def _starts(self, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where the fragments of words begin that stand one after the other in raw."""
        ends = np.cumsum(sizes)
        start = np.ones(len(raw), bool)
        if len(raw) > 1:
            final = np.zeros(len(raw) + 1, np.int64)
            final[ends] = 1  # final[i + 1]: i is the last byte of its word
            pair = raw[:-1].astype(np.int64) << 8 | raw[1:]
            start[1:] = ~self.allowed[final[2:], pair]
        start[ends[:-1]] = True
        return np.flatnonzero(start)

    def fragments(self, word: str) -> list[str]:
        """word, given as byte symbols, cut at every pair of neighbours that no token holds."""
        raw = np.frombuffer(bytes(map(self.byte.__getitem__, word)), np.uint8)
        cuts = [*self._starts(raw, np.array([len(raw)])).tolist(), len(raw)]
        return [word[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]

    def _offers(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 16 | the token made, for each pair of neighbours; NONE where they do not merge."""
        key = left << 16 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_made[at], NONE)

    def merge_all(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Apply merges to all fragments side by side: in each round every fragment takes its pair of lowest rank, the
        leftmost among equals. Returns the ids that stay and the places among the given ones where they begin."""
        place = np.arange(len(ids))
        piece = np.zeros(len(ids), np.int64)
        piece[starts[1:]] = 1
        piece = np.cumsum(piece)
        offer = np.full(len(ids), NONE)
        inside = np.flatnonzero(piece[1:] == piece[:-1])
        offer[inside] = self._offers(ids[inside], ids[inside + 1])
        done = []
        while len(ids):
            first, counts = runs(piece)
            best = np.minimum.reduceat(offer, first)
            ready = np.repeat(best == NONE, counts)
            if ready.any():
                done.append((place[ready], ids[ready]))
                ids, place, piece, offer = (x[~ready] for x in (ids, place, piece, offer))
                best, counts = best[best != NONE], counts[best != NONE]
                if not len(ids):
                    break
            hit = np.flatnonzero(offer == np.repeat(best, counts))
            hit = hit[np.r_[True, piece[hit[1:]] != piece[hit[:-1]]]]
            ids[hit] = best & 0xFFFF
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            ids, place, piece, offer = (x[stay] for x in (ids, place, piece, offer))
            hit -= np.arange(len(hit))  # one symbol is gone for each fragment before
            last = len(ids) - 1
            offer[hit] = NONE
            after = hit[hit < last]
            after = after[piece[after] == piece[after + 1]]
            offer[after] = self._offers(ids[after], ids[after + 1])
            before = hit[hit > 0] - 1
            before = before[piece[before] == piece[before + 1]]
            offer[before] = self._offers(ids[before], ids[before + 1])
        if not done:
            return ids, place
        place, ids = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        order = np.argsort(place, kind="stable")
        return ids[order], place[order]

    def merge(self, ids: list[int]) -> list[int]:
        """The same for one long fragment, with a heap, in n log n."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int, j: int) -> None:
            if found := self.merges.get(ids[i] << 16 | ids[j]):
                heapq.heappush(heap, (found >> 16, i, ids[i], ids[j], found & 0xFFFF))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                offer(i, k)
            if before[i] >= 0:
                offer(before[i], i)
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, given as its bytes; no word is empty."""
        if not words:
            return []
        raw = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        ids = self.plain[raw]
        ids[ends - 1] = self.last[raw[ends - 1]]
        if ids.min() < 0:
            raise KeyError("the vocabulary lacks a byte of the text")
        starts = self._starts(raw, sizes)
        lengths = np.diff(np.r_[starts, len(raw)])
        short = np.repeat(lengths <= LONG, lengths)
        which = np.cumsum(lengths * (lengths <= LONG)) - lengths
        parts, places = self.merge_all(ids[short], which[lengths <= LONG])
        out, at = [parts], [np.flatnonzero(short)[places]]
        for x, n in zip(starts[lengths > LONG].tolist(), lengths[lengths > LONG].tolist(), strict=True):
            made = np.array(self.merge(ids[x : x + n].tolist()))
            out.append(made)
            at.append(x + np.arange(len(made)))
        flat, at = np.concatenate(out), np.concatenate(at)
        order = np.argsort(at, kind="stable")
        edges = [0, *np.searchsorted(at[order], ends).tolist()]
        flat = flat[order].tolist()
        return [flat[x:y] for x, y in zip(edges, edges[1:], strict=False)]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given as byte symbols."""
        return self.encode_words([bytes(map(self.byte.__getitem__, word))])[0]

    def _entries(self, words: list[str], raw: Callable[[str], bytes]) -> dict[str, tuple[bytes, str]]:
        """Ids as int32 bytes, and their tokens joined by spaces, of each word."""
        ids = self.encode_words(list(map(raw, words)))
        name = self.tokens.__getitem__
        return {w: (array("i", x).tobytes(), " ".join(map(name, x))) for w, x in zip(words, ids, strict=True)}

    def _chunks(self, chunks: list[str]) -> dict[str, tuple[bytes, str]]:
        """The same for what stands between blanks, its words together; () if it has none."""
        parts = list(map(self.latin.findall, chunks))
        words = self.words.fill(set().union(*parts), lambda new: self._entries(new, str.encode))
        return {c: words[ws[0]] if len(ws) == 1 else ws and joined([words[w] for w in ws]) for c, ws in zip(chunks, parts, strict=True)}

    def _split(self, text: str) -> tuple[bool, list[str]]:
        """Whether a text without added tokens is split at blanks alone, and its chunks; else the pieces of the library."""
        if not self.high.search(text):
            return True, text.lower().split()
        normal = self.library.normalizer.normalize_str(text)
        return False, [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)] if normal else []

    def _plan(self, text: str | None) -> list[tuple[bool, list[str]] | str]:
        """A text as splits, with the added tokens between them."""
        if not text:
            return []
        if not self.special or not self.special.search(text):
            return [self._split(text)]
        plan, at = [], 0
        for m in self.special.finditer(text):
            plan += [self._split(text[at : m.start()]), m[0]]
            at = m.end()
        return [*plan, self._split(text[at:])]

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[tuple[bytes, str]]:
        """Ids of each whole text as int32 bytes, and what decoding them gives. Texts of about GROUP characters are looked
        up, and their new words merged, together."""
        plans, size = [], 0
        for text in texts:
            plans.append(self._plan(text))
            size += len(text or "")
            if size >= GROUP:
                yield from self._encoded(plans)
                plans, size = [], 0
        yield from self._encoded(plans)

    def _encoded(self, plans: list) -> Iterator[tuple[bytes, str]]:
        keys: tuple[set, set] = set(), set()
        for plan in plans:
            for part in plan:
                if not isinstance(part, str):
                    keys[part[0]].update(part[1])
        pieces = self.pieces.fill(keys[0], lambda new: self._entries(new, lambda p: bytes(map(self.byte.__getitem__, p))))
        chunks = self.chunks.fill(keys[1], self._chunks)
        for plan in plans:
            found = []
            for part in plan:
                if isinstance(part, str):
                    found.append((array("i", [self.added[part]]).tobytes(), part))
                else:
                    found += filter(None, map((chunks if part[0] else pieces).__getitem__, part[1]))
            yield joined(found)

    def encode(self, text: str | None) -> tuple[bytes, str]:
        return next(self.encode_all([text]))

    def decode(self, ids) -> str:
        """Tokens joined by one space, special ones included, as a tokenizer without a decoder does it."""
        return " ".join(self.tokens[int(i)] for i in ids)


@lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """One codec for all tasks of a worker, so that its caches stay warm."""
    return Codec(path)


def encode_decode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", drop: tuple[str, ...] = ()) -> DataFrame:
    """df with the ids of each text (array of int) and the text decoded from them; no shuffle."""

    def make():
        codec = codec_of(path)

        def work(texts: pa.Array) -> list[pa.Array]:
            pairs = list(codec.encode_all(t.as_py() for t in texts))
            ends, total = array("i", [0]), 0
            for raw, _ in pairs:
                total += len(raw) // 4
                ends.append(total)
            flat = pa.Array.from_buffers(pa.int32(), total, [None, pa.py_buffer(b"".join([p[0] for p in pairs]))])
            offsets = pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends.tobytes())])
            return [pa.ListArray.from_arrays(offsets, flat), pa.array([p[1] for p in pairs], pa.string())]

        return work

    fields = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())]
    return append(df, [text], fields, make, drop=drop, rows=256)


def ids_sha256(ids: Column) -> Column:
    """Hex SHA-256 of decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)
