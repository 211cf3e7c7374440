"""Token files, centroid clusters and the filter audit: against plain versions, round trips, and hard rows."""

import hashlib
import io
import random
import re
import zlib
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanweave.llm import annulus, audit, tokenfiles
from spanweave.llm.queries import QUERIES
from tests.oracle import TESTDATA

SF = f"{TESTDATA}/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", "It's 12 o'clock NOW", " ".join(f"Word{i % 997}" for i in range(50_000)), "x" * 20_000, "a<|endoftext|>b", "é ́e ΑΣ İ\x85ß", "same", "same"]
ROWS = [(None, "null id", "x"), (None, None, "y"), (7, None, None), *((i, t, "z") for i, t in enumerate(TEXTS)), (3, "again", "a"), (3, "again", "a"), (-5, "low", "b")]
#: Columns that the operators have names for themselves.
SCHEMA = "doc_id long, text string, start string"


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(WORDS)
    found.no_truncation()
    found.no_padding()
    return found


def written(spark, rows, **kw):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"tie": F.lit("t"), "row": F.lit("r"), "part": F.lit(1)})
    folder = tokenfiles.new_folder(spark)
    return folder, tokenfiles.write_token_files(docs, folder, WORDS, 2, **kw)


def opened(path: str) -> tokenfiles.Reader:
    data = open(path, "rb").read()
    return tokenfiles.Reader(io.BytesIO(data), len(data))


def test_token_files_as_the_library(spark, library):
    rows = sorted(QUERIES["op11_token_files"](spark, SF).collect())
    docs = sorted((d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect())
    start = 0
    assert len(rows) == len(docs)
    for r, (doc_id, text) in zip(rows, docs, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("by_words", [False, True])
@pytest.mark.parametrize("partitions", [1, 5])
def test_token_files_of_hard_rows(spark, library, by_words, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        folder, files = written(spark, ROWS, by_words=by_words, docs_per_file=4 if partitions > 1 else 1000)
        got = tokenfiles.read_token_files(files, folder).orderBy("start").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys) and files.agg(F.sum("documents")).first()[0] == len(ROWS) == len(got)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    want = sorted((str(i), np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t, _ in ROWS)
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == want


def test_repeated_ids_lie_in_several_files(spark):
    """An id of many rows is no single task, even if the rows are alike."""
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    try:
        _, files = written(spark, [(1, "hot", "a")] * 4000)
        sizes = [r.documents for r in files.collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert sum(sizes) == 4000 and max(sizes) < 2500


def test_token_files_empty(spark):
    folder, files = written(spark, [])
    assert files.count() == 0 and tokenfiles.read_token_files(files, folder).count() == 0


def test_token_files_are_seekable_zstandard(spark):
    folder, files = written(spark, [(i, f"text number {i} " * 50, "a") for i in range(300)], docs_per_file=1000)
    paths = [r.path for r in files.orderBy("part").collect()]
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(open(p, "rb"), read_across_frames=True).read() for p in paths)
    got = tokenfiles.read_token_files(files, folder).orderBy("doc_id").collect()
    assert np.array_equal(np.frombuffer(whole, "<u2"), np.concatenate([np.frombuffer(r.ids, "<u4") for r in got]))
    asked = tokenfiles.read_token_files(files, folder, wanted=[17, 250, 10**9]).orderBy("doc_id").collect()
    assert asked == [got[17], got[250]] and tokenfiles.read_token_files(files, folder, wanted=[]).count() == 0
    reader = opened(paths[0])
    before = reader.bytes_read
    assert len([*reader.documents(np.array([1, 2, 5]))]) == 3
    assert reader.bytes_read - before == reader.entries["packed"][[1, 2, 5]].sum()


def test_damaged_token_files_are_errors(spark):
    folder, files = written(spark, [(i, f"some text {i}", "a") for i in range(20)])
    path = files.first().path
    data = bytearray(open(path, "rb").read())
    reader = opened(path)
    tail = len(data) - 9 - 12 * len(reader.entries)
    for at in [int(reader.offsets[1]) - 1, tail + 8]:
        spoiled = data.copy()
        spoiled[at] ^= 0x55
        with pytest.raises(ValueError, match="damaged|checksum"):
            [*tokenfiles.Reader(io.BytesIO(bytes(spoiled)), len(spoiled)).documents(np.array([0]))]
    for cut in (data[:-1], data[len(data) // 2 :], b""):
        with pytest.raises((ValueError, OSError)):
            tokenfiles.Reader(io.BytesIO(bytes(cut)), len(cut))
    with open(path, "wb") as file:
        file.write(data[:-3])
    with pytest.raises(PythonException):
        tokenfiles.read_token_files(files, folder).collect()


@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\x0b\x0c\r'sΣ́\x1c\x85<|>")), max_size=60), max_size=4))
@settings(max_examples=150, deadline=None)
def test_words_are_encoded_as_whole_texts(texts):
    data = open(WORDS, encoding="utf-8").read()
    assert tokenfiles.Encoder(data, "<u2", True).encode(texts) == tokenfiles.Encoder(data, "<u2", False).encode(texts)


def test_words_are_forgotten(library, monkeypatch):
    monkeypatch.setattr(tokenfiles, "REMEMBERED", 1000)
    encoder = tokenfiles.Encoder(open(WORDS, encoding="utf-8").read(), "<u2", True)
    for i in range(20):
        text = f"some words {i} and more{i}"
        assert np.frombuffer(encoder.encode([text])[0], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(encoder.known) + len(encoder.before) < 20


def plain_clusters(rows, k, rounds, dim, scale):
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centroids = [r[1] for r in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        found = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), f in zip(kept, found, strict=True) if f == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted((str(i), nearest(v)[1], nearest(v)[0]) for i, v in kept), centroids


def key():
    return F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)


@pytest.mark.parametrize("n", [0, 3, 200])
def test_clusters_as_plain(spark, n):
    rng = random.Random(n)
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.3, 1.0]) for _ in range(4)]) for i in range(n)]
    if n:
        rows += [rows[0], rows[0], (None, [0.1] * 4), (5, None), (6, []), (8, [1.0] * 5), (9, [1.0, None, 1.0, 1.0]), (10, [float("nan")] * 4), (11, [float("-inf")] * 4), (1, [9.0] * 4)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "id long, vector array<double>, cluster string, x int").repartition(3)
    found, centroids, inertia = annulus.clusters(df, 7, 3, 4, 64.0, key())
    want, want_centroids = plain_clusters(rows, 7, 3, 4, 64.0)
    got = sorted((str(r.id), r.cluster, r.distance) for r in found.collect())
    assert got == want and centroids.tolist() == want_centroids
    assert inertia == {c: sum(d for _, f, d in want if f == c) for c in {f for _, f, _ in want}}


@given(st.integers(0, 10**6), st.integers(1, 40), st.sampled_from([1, 2, 3, 1000, annulus.LARGEST]))
@settings(max_examples=80, deadline=None)
def test_annulus_finds_the_nearest(seed, k, size):
    rng = np.random.default_rng(seed)
    centroids, x = rng.integers(-size, size, (k, 3), endpoint=True), rng.integers(-size, size, (60, 3), endpoint=True)
    number, distance = annulus.Annulus(centroids).nearest(x)
    all_of_them = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert np.array_equal(number, all_of_them.argmin(axis=1)) and np.array_equal(distance, all_of_them.min(axis=1))


def test_annulus_compares_few():
    """Centroids far apart in norm: hardly any distance but the first is worked out."""
    search = annulus.Annulus(np.array([[10**i, 0] for i in range(8)]))
    asked, squared = [], search._squared
    search._squared = lambda x, at: asked.append(len(at)) or squared(x, at)
    x = np.array([[10 ** (i % 8) + 1, 1] for i in range(800)])
    assert np.array_equal(search.nearest(x)[0], np.arange(800) % 8)
    assert sum(asked) < 1300


def test_components_too_large_are_errors():
    with pytest.raises(OverflowError):
        annulus.kept(pa.array([[1e30, 0.0]]), 2, 64.0)
    rows, x = annulus.kept(pa.array([None, [1.0, 2.0], [3.0, None], [1.0]]).slice(1), 2, 2.0)
    assert rows.tolist() == [0] and x.tolist() == [[2, 4]]


def plain_audit(rows, labels):
    known = {i: (max(q == 1 for j, q, _ in labels if j == i), max(t == 1 for j, _, t in labels if j == i)) for i in {j for j, _, _ in labels if j is not None}}
    parts = {}
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        same = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)
        fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), same)
        parts.setdefault(source or "", []).append((fails, *known.get(i, (False, False))))
    out, shapley = [], {}
    for part, docs in parts.items():
        for order in permutations("ABCDE"):
            left = docs
            for step, letter in enumerate(order, 1):
                f = "ABCDE".index(letter)
                removed = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                failing = sum(d[0][f] for d in docs)
                alone = sum(d[0][f] and sum(d[0]) == 1 for d in docs)
                out.append((part, "".join(order), step, len(left), len(removed), failing - len(removed), alone, sum(d[1] for d in removed), sum(d[2] for d in removed)))
                shapley[part, letter] = shapley.get((part, letter), 0) + len(removed)
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_as_plain(spark):
    rng = random.Random(1)
    fill = [f"word{i}" for i in range(400)]
    texts = [None, "", "Same old TEXT #1", " ".join(fill), " ".join(fill) + " *", " ".join(fill[:20] * 20), " ".join(fill).upper(), "ß\U0001f600 " * 300, " \n\t", " ".join(fill * 40)]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["a", "a", "a", "b", "", None])) for _ in range(150)] + [(900, "alone", "only one")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(30), 3, 4, None, 77]]
    docs = spark.createDataFrame([(*r, "f", 1, "p") for r in rows], "doc_id long, text string, source string, flags string, digest int, part string").repartition(4)
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")
    got = audit.audit(docs, marks)
    assert sorted(got.columns) == sorted(COLUMNS)
    assert sorted(tuple(r) for r in got.select(COLUMNS).collect()) == plain_audit(rows, labels)
    assert audit.audit(docs.limit(0), marks).count() == 0
    assert sorted(tuple(r) for r in audit.audit(docs, marks.limit(0)).select(COLUMNS).collect()) == plain_audit(rows, [])


def test_bitmaps_count_as_rows():
    rng = np.random.default_rng(0)
    for n, m in [(1, 1), (8, 1), (9, 2), (1000, 7), (1000, 1000)]:
        parts, flags = np.array([f"p{i}" for i in rng.integers(0, m, n)], dtype=object), rng.integers(0, 32, n)
        got = audit.counted(parts, flags, 3, 2).set_index(["part", "subset"])
        for part in set(parts):
            own = flags[parts == part]
            for subset in range(8):
                left = own[(own & subset) == 0]
                assert got.loc[(part, subset)].tolist() == [len(left), (left >> 3 & 1).sum(), (left >> 4 & 1).sum()]
