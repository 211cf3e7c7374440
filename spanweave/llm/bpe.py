"""BPE encoding and decoding: a transducer of frequent words, exact merges for all other words."""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import table
from spanweave.llm.lexicon import Lexicon

#: How byte-level BPE splits a text into words. A fixed value, but for L, N and X: letters, numbers and what is neither.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?X+|\s+(?!\S)|\s+"
#: Words of a process's cache, and characters of texts that are encoded together.
CACHE, CHUNK = 200_000, 500_000
#: In place of the rank of a pair that is not merged.
NO_MERGE = 1 << 63


@cache
def newer_characters() -> str:
    """The letters and numbers that the regex library knows and Python's own Unicode tables (15.1) don't.

    The tokenizers library takes them for neither.
    """
    unknown = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
    return "".join(regex.findall(r"[\p{L}\p{N}]", unknown))


def _class_of(characters: str) -> str:
    """A character set, in ranges."""
    points = np.array(sorted(map(ord, characters)))
    cuts = np.flatnonzero(np.diff(points) > 1) + 1
    return "".join(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in np.split(points, cuts))


def word_patterns() -> tuple[str, str, str]:
    """How to split texts without newer characters, how to split those with them, and those characters."""
    plain = WORDS.replace("X+", r"[^\s\p{L}\p{N}]+").replace("L+", r"\p{L}+").replace("N+", r"\p{N}+")
    if not (newer := newer_characters()):
        return plain, plain, ""
    new = _class_of(newer)
    exact = WORDS.replace("X+", rf"(?:[^\s\p{{L}}\p{{N}}]|[{new}])+").replace("L+", rf"[\p{{L}}--[{new}]]+").replace("N+", rf"[\p{{N}}--[{new}]]+")
    return plain, f"(?V1){exact}", newer


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Bpe:
    """A byte-level BPE vocabulary: bytes of each id, merges by rank (k, 3: the ids of both parts and of what they make), and special tokens."""

    def __init__(self, tokens: dict[int, bytes], merges: np.ndarray, special: dict[str, int], patterns: tuple[str, str, str], lexicon: bytes = b"") -> None:
        self.tokens, self.special = tokens, special
        ids = {t: i for i, t in tokens.items()}
        self.of_byte = [ids[bytes([b])] for b in range(256)]
        self.merges = {(a << 32) | b: (rank << 32) | made for rank, (a, b, made) in enumerate(merges.tolist())}
        self.lexicon = Lexicon.mapped(lexicon) if lexicon else None
        self.cache: dict[str, bytes] = {}
        self.plain, self.exact, self.newer = regex.compile(patterns[0]), regex.compile(patterns[1]), frozenset(patterns[2])
        names = sorted(special, key=lambda s: (-len(s), s))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.texts = [b""] * (1 + max([*tokens, *special.values()], default=-1))
        for i, t in [*tokens.items(), *((i, s.encode()) for s, i in special.items())]:
            self.texts[i] = t

    def words(self, text: str) -> list[str]:
        return (self.plain if text.isascii() or self.newer.isdisjoint(text) else self.exact).findall(text)

    def merged(self, word: bytes) -> list[int]:
        """The ids of a word by its merges: always the lowest-ranked pair, from the left."""
        ids, get = [self.of_byte[b] for b in word], self.merges.get
        pairs = [get((a << 32) | b, NO_MERGE) for a, b in pairwise(ids)]
        while pairs and (best := min(pairs)) != NO_MERGE:
            at, made = pairs.index(best), best & 0xFFFFFFFF
            ids[at : at + 2] = [made]
            del pairs[at]
            # Only the pairs beside it are new.
            if at:
                pairs[at - 1] = get((ids[at - 1] << 32) | made, NO_MERGE)
            if at < len(pairs):
                pairs[at] = get((made << 32) | ids[at + 1], NO_MERGE)
        return ids

    def merged_long(self, word: bytes) -> list[int]:
        """The same for words of any length: the pairs wait in a heap, and neighbours are linked."""
        ids = [self.of_byte[b] for b in word]
        n = len(ids)
        before, after, gone = list(range(-1, n - 1)), [*range(1, n), -1], [False] * n

        def pair(i: int) -> tuple | None:
            m = self.merges.get((ids[i] << 32) | ids[after[i]]) if after[i] >= 0 else None
            return None if m is None else (m >> 32, i, m & 0xFFFFFFFF, ids[i], ids[after[i]])

        heap = [p for i in range(n - 1) if (p := pair(i))]
        heapq.heapify(heap)
        while heap:
            _, i, made, left, right = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], gone[j] = made, True
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (p := pair(k)):
                    heapq.heappush(heap, p)
        return [x for x, g in zip(ids, gone, strict=True) if not g]

    def learn(self, words: list[str]) -> None:
        """Put the ids of these words into the cache: from the transducer, else by merging."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        numbers = self.lexicon.numbers(data).tolist() if self.lexicon is not None else [-1] * len(words)
        for word, raw, number in zip(words, data, numbers, strict=True):
            ids = self.lexicon.ids_of(number) if number >= 0 else self.merged(raw) if len(raw) < 64 else self.merged_long(raw)
            self.cache[word] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text as little-endian unsigned 32-bit integers."""
        split: list[list[tuple[bool, list[str] | bytes]]] = []
        wanted: set[str] = set()
        for text in texts:
            parts = []
            for piece in self.cut.split(text) if self.cut else [text]:
                if piece in self.special:
                    parts.append((True, np.array([self.special[piece]], dtype="<u4").tobytes()))
                elif piece:
                    words = self.words(piece)
                    wanted.update(words)
                    parts.append((False, words))
            split.append(parts)
        if len(self.cache) + len(wanted) > CACHE:
            self.cache = {w: c for w, c in self.cache.items() if w in wanted}
        self.learn([w for w in wanted if w not in self.cache])
        get = self.cache.__getitem__
        return [b"".join(p if done else b"".join(map(get, p)) for done, p in parts) for parts in split]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.texts.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def load(path: str) -> tuple[dict[int, bytes], np.ndarray, dict[str, int]]:
    """Tokens, merges and special tokens of a byte-level BPE file of the tokenizers library."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    letters = byte_letters()

    def raw(token: str) -> bytes:
        return bytes(letters[c] for c in token)

    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    tokens = {i: raw(t) for t, i in data["model"]["vocab"].items() if t not in special}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
    ids = {t: i for i, t in tokens.items()}
    merges = [(ids[raw(a)], ids[raw(b)], ids[raw(a) + raw(b)]) for a, b in pairs]
    return tokens, np.array(merges, dtype=np.uint32).reshape(-1, 3), special


def packed(tokens: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Ids, lengths and bytes of tokens, which take less room than the tokens by themselves."""
    return np.array(list(tokens), dtype=np.uint32), np.array([len(t) for t in tokens.values()], dtype=np.uint32), b"".join(tokens.values())


def unpacked(ids: np.ndarray, lengths: np.ndarray, data: bytes) -> dict[int, bytes]:
    ends = np.cumsum(lengths, dtype=np.int64)
    return {i: data[e - n : e] for i, n, e in zip(ids.tolist(), lengths.tolist(), ends.tolist(), strict=True)}


def frequent_words(bpe: Bpe) -> list[tuple[bytes, list[int]]]:
    """The vocabulary's tokens that are whole words, with their ids: what was frequent in the text it was made from.

    Their ids come from merging, as everything else's.
    """
    out = []
    for token in bpe.tokens.values():
        try:
            text = token.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if bpe.words(text) == [text]:
            out.append((token, bpe.merged(token)))
    return out


#: What a worker process has loaded, by a hash of the lexicon.
_LOADED: dict[str, Bpe] = {}


def with_tokens(docs: DataFrame, path: str, text: str = "text") -> Column:
    """Column struct<ids binary, decoded string> of a column of whole texts; a null text is an empty one.

    ``ids`` are little-endian unsigned 32-bit integers, as the tokenizers library gives them without added special
    tokens, truncation and padding; special tokens' strings inside a text are those tokens. ``decoded`` is the text
    of the ids, special tokens included. Repeated rows are encoded alike, very long texts whole; an empty table gives no rows.
    Only the driver reads ``path``.
    """
    tokens, merges, special = load(path)
    lexicon = Lexicon.compile(frequent_words(Bpe(tokens, merges, special, word_patterns()))).dump()
    shared = docs.sparkSession.sparkContext.broadcast((packed(tokens), merges, special, word_patterns(), lexicon))  # the size of the vocabulary

    key = hashlib.sha256(lexicon).hexdigest()

    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if (bpe := _LOADED.get(key)) is None:
            _LOADED.clear()
            small, *rest = shared.value
            bpe = _LOADED[key] = Bpe(unpacked(*small), *rest)
        for batch in batches:
            waiting: list[str] = []
            size = 0
            for n, value in enumerate(batch, 1):
                waiting.append(value or "")
                size += len(waiting[-1])
                if size >= CHUNK or n == len(batch):  # given out by the chunk, so that no batch of long texts is held three times over
                    ids = bpe.encode(waiting)
                    yield pd.DataFrame({"ids": ids, "decoded": [bpe.decode(i) for i in ids]})
                    waiting, size = [], 0

    return F.pandas_udf(coded, "struct<ids:binary,decoded:string>")(docs[text])


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs.select("doc_id", with_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).alias("c")), "c")


def digests(docs: DataFrame, coded: str) -> DataFrame:
    """``doc_id``, the number of ids and hashes of ids and decoded text, from a column of ``with_tokens``."""
    return docs.select(
        "doc_id",
        (F.octet_length(f"{coded}.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(f"{coded}.ids", 256).alias("ids_sha256"),
        F.sha2(F.col(f"{coded}.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
