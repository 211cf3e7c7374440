"""Token ids in seekable binary files: a zstandard frame a document, with a seek table and checksums at the end."""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanweave.llm.common import cut_lineage, shared_folder, shuffle_partitions, table

#: Documents of a file at most, about; a file is one task.
DOCS_PER_FILE = 100_000
#: Characters that are encoded, and bytes that are read or given out, at a time.
CHUNK = 1 << 22
#: Bytes of words and ids that a worker remembers, about.
REMEMBERED = 160 << 20

#: Words of letters that the library is asked for at once.
AT_ONCE = 64
#: Rule of a pre-tokenizer that parts letters from what follows them, apostrophes aside.
LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: ASCII letters and digits and Latin-1 letters (which no normal form and no other letter's case changes), then ASCII punctuation without apostrophes or what special tokens have.
PARTED = re.compile(rb"((?:[0-9A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]*)")

# Fixed values of the public seekable format of zstandard, and of skippable frames.
TABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80
INDEX_MAGIC = 0x184D2A50

ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])
FOOTER = struct.Struct("<IBI")
MANIFEST = "part long, path string, documents long, tokens long, first_id long, last_id long"


def checksum(data: bytes) -> int:
    """The lower half of the XXH64 of a frame's content, as the seekable format has it."""
    return xxhash.xxh64(data).intdigest() & 0xFFFFFFFF


class Writer:
    """Writes documents, one frame each, then an index of their ids (a skippable frame), then the seek table.

    Any zstandard reader gives the ids of all documents one after another. Only the table is held: 21 bytes a document.
    """

    def __init__(self, out, dtype: str, level: int = 3):
        self.out, self.dtype = out, np.dtype(dtype)
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.entries, self.ids, self.missing, self.tokens = bytearray(), bytearray(), bytearray(), 0

    def add(self, doc_id: int | None, tokens: bytes) -> None:
        """A document's ids as bytes of the file's type."""
        if len(tokens) >= 1 << 32:
            raise ValueError("a document's ids are 4 GB or more")
        packed = self.compressor.compress(tokens)
        self.out.write(packed)
        self.entries += np.array([(len(packed), len(tokens), checksum(tokens))], dtype=ENTRY).tobytes()
        self.ids += struct.pack("<q", 0 if doc_id is None else doc_id)
        self.missing.append(doc_id is None)
        self.tokens += len(tokens) // self.dtype.itemsize

    def close(self) -> None:
        head = json.dumps({"dtype": self.dtype.str, "documents": len(self.missing)}).encode()
        index = head + bytes(self.ids) + bytes(self.missing) + struct.pack("<I", len(head))
        table = bytes(self.entries) + FOOTER.pack(len(self.missing), WITH_CHECKSUMS, SEEKABLE_MAGIC)
        for magic, data in ((INDEX_MAGIC, index), (TABLE_MAGIC, table)):
            self.out.write(struct.pack("<II", magic, len(data)) + data)


class Reader:
    """Reads single documents of a file: the end of the file first, then only the frames that are asked for."""

    def __init__(self, file, size: int):
        self.file, self.bytes_read = file, 0
        n, flags, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        table = size - FOOTER.size - n * ENTRY.itemsize
        self.entries = np.frombuffer(self._at(table, n * ENTRY.itemsize), dtype=ENTRY)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        start = int(self.offsets[-1]) + 8
        index = self._at(start, table - 8 - start)
        (head,) = struct.unpack("<I", index[-4:])
        about = json.loads(index[:head])
        if about["documents"] != n:
            raise ValueError("index and seek table have unlike numbers of documents")
        self.dtype = np.dtype(about["dtype"])
        self.doc_ids = np.frombuffer(index, dtype="<i8", count=n, offset=head)
        self.missing = np.frombuffer(index, dtype=bool, count=n, offset=head + 8 * n)
        self.lengths = self.entries["size"] // self.dtype.itemsize
        self.decompressor = zstandard.ZstdDecompressor()

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError("the file ends too early")
        self.bytes_read += n
        return data

    def documents(self, which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Places and ids of the documents at these places in the file (ascending); neighbours are read together."""
        at = 0
        while at < len(which):
            first, end = which[at], at + 1
            while end < len(which) and which[end] == which[end - 1] + 1 and self.offsets[which[end] + 1] - self.offsets[first] <= CHUNK:
                end += 1
            base = int(self.offsets[first])
            data = memoryview(self._at(base, int(self.offsets[which[end - 1] + 1]) - base))
            for i in which[at:end]:
                yield int(i), self._tokens(int(i), data[self.offsets[i] - base : self.offsets[i + 1] - base])
            at = end

    def _tokens(self, i: int, frame: memoryview) -> np.ndarray:
        entry = self.entries[i]
        try:
            tokens = self.decompressor.decompress(frame, max_output_size=int(entry["size"]))
        except zstandard.ZstdError as error:
            raise ValueError(f"frame {i} is damaged: {error}") from error
        if len(tokens) != entry["size"] or checksum(tokens) != entry["checksum"]:
            raise ValueError(f"frame {i} does not have its checksum")
        return np.frombuffer(tokens, dtype=self.dtype)


class Encoder:
    """Texts to ids, as bytes, by the tokenizers library: no special tokens added, no truncation, no padding.

    ``by_words``: the library is asked once for each word (run of anything but ASCII white space), and its answer is
    remembered. That gives the same ids only where the tokenizer drops white space and no token or rule reaches over it.
    Where it also takes A-Z as a-z and parts by ``LETTERS_APART``, a plain word's letters and the punctuation at its end are asked for apart,
    and words of letters many at once: the last token of each has the tokenizer's suffix.
    """

    def __init__(self, data: str, dtype: str, by_words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task keeps to its core
        self.tokenizer, self.dtype, self.by_words = Tokenizer.from_str(data), np.dtype(dtype), by_words
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        rules = json.loads(data)
        self.parted = by_words and _parts_letters(rules)
        if self.parted:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(rules["model"]["end_of_word_suffix"])]] = True
        #: Words that were asked for lately, and before; a word that is asked for again is kept.
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.size = 0

    def _asked(self, texts: list[str]) -> list[bytes]:
        kind = {2: "H", 4: "I"}[self.dtype.itemsize]
        found = (e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))
        return [struct.pack(f"<{len(ids)}{kind}", *ids) for ids in found]

    def _asked_at_once(self, words: list[str]) -> list[bytes]:
        """The same for words, with those of letters only put together. A part with more ends than words is asked for word by word."""
        letters, rest = [w for w in words if w.isalpha()], [w for w in words if not w.isalpha()]
        parts, got = [letters[i : i + AT_ONCE] for i in range(0, len(letters), AT_ONCE)], {}
        for part, e in zip(parts, self.tokenizer.encode_batch_fast(list(map(" ".join, parts)), add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=self.dtype)
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize).tolist()
            if len(ends) != len(part):
                rest += part
                continue
            data = ids.tobytes()
            got.update((w, data[a:b]) for w, a, b in zip(part, [0, *ends], ends))
        got.update(zip(rest, self._asked(rest), strict=True))
        return [got[w] for w in words]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return self._asked(texts)
        split = [t.encode().split() for t in texts]
        if self.size > REMEMBERED // 2:
            self.known, self.before, self.size = {}, self.known, 0
        self._learn(set().union(*split))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def _learn(self, words: Iterable[bytes]) -> None:
        new = set(words).difference(self.known)
        found = {w: self.before[w] for w in new if w in self.before}
        parts = {w: p for w in new if w not in found and (p := self._parts(w))}
        if parts:
            self._learn(chain.from_iterable(parts.values()))  # these have no parts
            found.update((w, self.known[a] + self.known[b]) for w, (a, b) in parts.items())
        unknown = [w for w in new if w not in found and w not in self.known]
        ask = self._asked_at_once if self.parted else self._asked
        found.update(zip(unknown, ask([w.decode() for w in unknown]), strict=True))
        self.known.update(found)
        self.size += sum(map(len, found)) + sum(map(len, found.values())) + 150 * len(found)  # objects and their place in the table

    def _parts(self, word: bytes) -> tuple[bytes, bytes] | None:
        """Letters in lower case and punctuation of a word that has capitals or both."""
        if not self.parted or not (m := PARTED.fullmatch(word)) or (low := m[1].lower()) == word:
            return None
        return low, m[2]


def _parts_letters(rules: dict) -> bool:
    """Whether a tokenizer (its file's content) takes A-Z as a-z, and then parts by ``LETTERS_APART`` before all else."""
    normal, before, model = (rules.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    known = [x["type"] for x in normal.get("normalizers", [normal or {"type": None}])] == ["NFC", "Replace", "Lowercase"] and normal["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
    first = before.get("pretokenizers", [before])[0]
    apart = first.get("type") == "Split" and first["pattern"] == {"Regex": LETTERS_APART} and first["behavior"] == "Removed" and first["invert"]
    special = all(re.fullmatch(r"<\|.*\|>", x["content"]) for x in rules.get("added_tokens", []))
    return known and apart and special and model.get("type") == "BPE" and bool(model.get("end_of_word_suffix")) and not model.get("dropout") and not rules.get("post_processor")


#: The encoder that a worker process has, by what it was made of.
_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(data: str, dtype: str, by_words: bool) -> Encoder:
    key = (hashlib.sha256(data.encode()).digest(), dtype, by_words)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(data, dtype, by_words)
    return _ENCODERS[key]


def _place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder that the cluster shares, local or remote, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str]]]:
    """Documents in runs of about ``CHUNK`` characters."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            ids.append(None if pd.isna(doc_id) else int(doc_id))
            texts.append(text)
            size += len(text)
            if size >= CHUNK:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, by_words: bool = False, docs_per_file: int = DOCS_PER_FILE) -> DataFrame:
    """Encodes whole texts and writes the ids to files in ``folder``, in ascending order of ``doc_id``.

    Uses columns ``doc_id`` (a whole number) and ``text``; others are ignored. ``tokenizer`` is a file of the tokenizers library
    that only the driver reads. To each document ``end_id`` is appended; a null or empty text is that id alone, a very long one is
    one frame. Null doc_ids come first; repeated ids and rows are all written, in an order that follows from their texts, and
    may lie in several files. An empty table gives no files.

    Rows are dealt by ranges of ``doc_id``, each range is sorted and written by one task as it is read. Names are unique to an
    attempt, and a file counts if its row is in the result, so a task that is run again or twice does no harm. Returns that list
    of files: ``part`` (their order), ``path, documents, tokens, first_id, last_id``.
    """
    with open(tokenizer, encoding="utf-8") as file:
        data = file.read()
    vocabulary = Tokenizer.from_str(data).get_vocab_size(with_added_tokens=True)
    dtype = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    shared = docs.sparkSession.sparkContext.broadcast(data)  # the size of the vocabulary
    end = np.array([end_id], dtype=dtype).tobytes()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("row")]
    n = max(shuffle_partitions(docs), -(-rows.count() // docs_per_file))
    # The last two only part rows of one id, so that no id is one task.
    sorted_rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(n, *order).sortWithinPartitions(*order)

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, writer, first, last = None, None, None, None
        part = TaskContext.get().partitionId()
        system, base = _place(folder)
        path = f"{base}/part-{part:06d}-{uuid.uuid4().hex}.ids.zst"
        for ids, texts in _chunks(batches):
            if writer is None:
                encoder = _encoder(shared.value, dtype, by_words)
                writer, first = Writer(system.open_output_stream(path, compression=None), dtype), ids[0]
            for doc_id, tokens in zip(ids, encoder.encode(texts), strict=True):
                writer.add(doc_id, tokens + end)
            last = ids[-1]
        if writer is not None:
            writer.close()
            writer.out.close()
            row = {"part": part, "path": path, "documents": len(writer.missing), "tokens": writer.tokens, "first_id": first, "last_id": last}
            yield pd.DataFrame([row]).astype({"first_id": "Int64", "last_id": "Int64"})

    system, base = _place(folder)
    system.create_dir(base, recursive=True)
    return cut_lineage(sorted_rows.select("doc_id", "text").mapInPandas(written, MANIFEST))


def read_token_files(files: DataFrame, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """Documents of the files that ``write_token_files`` listed: ``doc_id, start, n_tokens, ids``.

    ``start`` counts the ids of all documents before it, over all files; ``ids`` are little-endian unsigned 32-bit integers. With
    ``wanted``, a list of ids, only files that may hold one are opened, and of these only the frames of those documents are
    read. A frame that does not have its checksum, or a file that ends early, is an error. No files give no rows.
    """
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = files.withColumn("start", before)  # one row a file
    if wanted is not None:
        asked = F.lit(sorted(wanted)) if wanted else F.array().cast("array<bigint>")
        within = F.exists(asked, lambda x: (x >= F.coalesce("first_id", F.lit(-(1 << 63)))) & (x <= F.coalesce("last_id", F.lit(-(1 << 63)))))
        listed = listed.filter(within)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system = _place(folder)[0]
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"], strict=True):
                with system.open_input_file(path) as file:
                    yield from _documents(Reader(file, file.size()), int(start), wanted)

    spread = listed.select("path", "start").repartition(shuffle_partitions(files))
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")


def _documents(reader: Reader, start: int, wanted: list[int] | None) -> Iterator[pd.DataFrame]:
    starts = start + np.concatenate([[0], np.cumsum(reader.lengths, dtype=np.int64)])
    places = np.arange(len(reader.lengths))
    if wanted is not None:
        places = places[np.isin(reader.doc_ids, wanted) & ~reader.missing]
    out, size = [], 0
    for i, tokens in reader.documents(places):
        out.append((None if reader.missing[i] else int(reader.doc_ids[i]), int(starts[i]), len(tokens), tokens.astype("<u4").tobytes()))
        size += len(out[-1][3])
        if size >= CHUNK:
            yield _frame(out)
            out, size = [], 0
    if out:
        yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids"]).astype({"doc_id": "Int64"})


def new_folder(spark: SparkSession) -> str:
    """A new folder for token files in the folder that the cluster shares."""
    return f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"


def op11_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark)
    # This tokenizer drops white space.
    files = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2, by_words=True)
    return read_token_files(files, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
