"""Near-duplicates of the pipeline against brute force over all pairs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanweave.llm import common as common_module
from spanweave.llm import jaccard, linededup


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts):
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    label = {i: i for i in texts}
    while True:
        new = {i: min(label[j] for j in sets if i == j or len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4) for i in sets}
        if new == label:
            return label
        label = new


def texts_with_copies(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = rng.sample(words, 30)
    texts = []
    for n in (3, 8, 60, 150, 400):
        for _ in range(6):
            base = [rng.choice(words) for _ in range(n)] + passage * rng.randrange(2)
            for changes in (0, 0, 1, 2, 4, 8):
                copy = list(base)
                for _ in range(changes):
                    copy[rng.randrange(len(copy))] = rng.choice(words)
                texts.append(" ".join(copy))
    rng.shuffle(texts)
    return dict(enumerate([*texts, "", None, "  \n", "One two", "one  TWO"]))


def test_components_as_brute_force(spark, monkeypatch):
    texts = texts_with_copies()
    want = brute_components(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for common, few, hashes, rows in ((64, 1_000_000, 500_000, 50_000), (1, 1_000_000, 500_000, 50_000), (2, 0, 0, 0)):
        monkeypatch.setattr(jaccard, "COMMON", common)
        monkeypatch.setattr(jaccard, "BROADCAST_COMMON", few)  # with 0, common shingles are put last by joins
        monkeypatch.setattr(jaccard, "BROADCAST_HASHES", hashes)
        monkeypatch.setattr(jaccard, "FAN", 3)
        monkeypatch.setattr(common_module, "BROADCAST_ROWS", rows)
        assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == want


def test_stage_drops_copies_with_changed_words(spark):
    words = [f"a{i}" for i in range(200)]
    copy = [f"x{i}" if i % 45 == 20 else w for i, w in enumerate(words)]  # similarity 0.81, 7 bits
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy)), (3, " ".join(reversed(words)))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.copies_stage(spark, docs, "").collect()) == [1, 3]


def test_stage_with_one_id_for_two_texts(spark):
    """Each component keeps its first document, though another text has the same id."""
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = spark.createDataFrame([(1, one), (1, two), (1, two), (2, two), (None, one), (None, "c d e"), (None, "c d e")], "doc_id long, text string")
    kept = [tuple(r) for r in corpus_pipeline.copies_stage(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(1, one), (1, two), (None, "c d e")], key=str)


def edits(a, b):
    """Edit distance, the plain way."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("common", [20, 10_000])
def test_lines_with_common_pieces(spark, monkeypatch, common):
    """Lines that begin, end or go on in the same way are split further; no pair is lost, whatever the bound."""
    monkeypatch.setattr(linededup, "COMMON", common)
    rng, lines = random.Random(1), set()
    for head, tail in (("Copyright notice no. ", ""), ("", " and the same end of all lines"), ("#" * 24, ""), ("no ", "#" * 24)):
        for _ in range(25):
            line = head + "".join(rng.choice("01ab") for _ in range(rng.choice([3, 6, 12]))) + tail
            lines.add(line)
            for _ in range(2):
                at, new = rng.randrange(len(line) + 1), rng.choice(["", "z", "9"])
                lines.add(line[:at] + new + line[at + rng.randrange(2) :])
    lines = sorted(x for x in lines if len(x) >= 20)
    want = {(a, b) for a, b in itertools.combinations(lines, 2) if abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2}
    df = spark.createDataFrame([(x,) for x in lines], "line string").withColumns({"h": F.xxhash64("line"), "n": F.length("line")})
    name = {r.h: r.line for r in df.collect()}
    got = [tuple(sorted((name[r.a], name[r.b]))) for r in linededup.near_lines(df, 20).collect()]
    assert len(got) == len(set(got)) and set(got) == want
