"""Small cases of what the third round left open."""

import numpy as np

import corpus_pipeline
from spanweave.llm import bpe, jaccard, simhash, tokenfiles
from spanweave.operators import calibration, flatten, sweep


def test_sweep_places_its_boundaries_once(spark):
    """Totals and counts read what was written; a report that reads its sizes twice doesn't sweep twice (F15)."""
    df = spark.range(300).selectExpr("'p' AS process", "concat('k', id % 3) AS key", "id * 7 % 100 AS start_us", "id * 7 % 100 + id % 5 AS end_us")
    found = sweep.region_times(df, ["process"])
    assert "transform" not in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "aggregate(" not in plan and "__splits" not in plan
    sizes = spark.range(8).selectExpr("'p' AS process", "IF(id % 2 = 0, array('A'), array('A', 'B')) AS region", "id AS time_us").groupBy("process", "region").agg({"time_us": "sum"}).withColumnRenamed("sum(time_us)", "time_us")
    venn = calibration.legacy_venn(sizes, ["process"])
    assert "Range" not in venn._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((tuple(r.region), r.time_us) for r in venn.collect()) == [(("A",), -4), (("A", "B"), 16), (("B",), -16)]


def test_stage_finds_copies_by_golay_keys(spark, monkeypatch):
    """Fingerprints bring near copies together by themselves; what they bring together is compared, and only the rest is looked for (F4)."""
    words = [f"a{i}" for i in range(600)]
    copies = [" ".join("x" if i == at else w for i, w in enumerate(words)) for at in (None, 300, 77)]
    bits = [bin(simhash.fingerprint_of(copies[0]) ^ simhash.fingerprint_of(c)).count("1") for c in copies[1:]]
    assert all(0 < b <= simhash.RADIUS for b in bits)
    docs = spark.createDataFrame([*enumerate(copies), (7, " ".join(reversed(words))), (8, ""), (9, None)], "doc_id long, text string")
    whole = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert whole == {0: 0, 1: 0, 2: 0, 7: 7, 8: 8, 9: 8}
    shared = jaccard._shared
    monkeypatch.setattr(jaccard, "_shared", lambda *a: shared(*a).limit(0))  # the prefix join finds nothing
    assert sorted(r.doc_id for r in corpus_pipeline.copies_stage(spark, docs, "").collect()) == [0, 7, 8]
    # Fingerprints alike with texts that are not: compared, and left apart.
    apart = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(reversed(words)))], "doc_id long, text string")
    assert {r.component_id for r in jaccard.near_duplicates(apart, simhash.F.lit(5).cast("long"), simhash.candidates).collect()} == {0, 1}


class Counted(dict):
    asked = 0

    def get(self, *a):
        self.asked += 1
        return super().get(*a)


def test_merges_look_at_new_pairs_only():
    """A word's pairs are looked up once, and two for each merge (the check of op4_bpe)."""
    tokens = {i: bytes([i]) for i in range(256)} | {256: b"ab", 257: b"abab", 258: b"ba", 259: b"aa"}
    merges = np.array([(97, 98, 256), (256, 256, 257), (98, 97, 258), (97, 97, 259)], dtype=np.uint32)
    coder = bpe.Bpe(tokens, merges, {}, bpe.word_patterns())
    coder.merges = Counted(coder.merges)
    for word, ids in ((b"", []), (b"x", [120]), (b"abab", [257]), (b"babaab", [98, 256, 97, 256]), (b"aaa", [259, 97]), (b"ab" * 15, [257] * 7 + [256])):
        coder.merges.asked = 0
        assert coder.merged(word) == coder.merged_long(word) == ids
        coder.merges.asked = 0
        coder.merged(word)
        assert coder.merges.asked <= 3 * max(0, len(word) - 1)


def _executions(spark) -> int:
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def test_near_duplicate_stage_plans_few_jobs(spark):
    """The driver keeps something of each job it plans (the check of pipeline: 1500 MB); a chain's links take several rounds."""
    chain = spark.range(64).selectExpr("id AS a", "id + 1 AS b")
    before = _executions(spark)
    assert {r.root for r in simhash.components(chain).collect()} == {0}
    words = [f"a{i}" for i in range(600)]
    texts = [" ".join("x" if i == at else w for i, w in enumerate(words)) for at in (None, 300, 77)]
    docs = spark.createDataFrame([*enumerate(texts), (7, " ".join(reversed(words)))], "doc_id long, text string")
    chained, before = _executions(spark) - before, _executions(spark)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {0: 0, 1: 0, 2: 0, 7: 7}
    assert chained <= 28 and _executions(spark) - before <= 55  # 39 and 75 before


def test_words_are_asked_for_by_their_parts():
    """Letters and the punctuation at a word's end are asked for apart, capitals as small letters: fewer questions, the same ids (the check of op11)."""
    import itertools

    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        data = file.read()
    whole, parted = tokenfiles.Encoder(data, "<u2", False), tokenfiles.Encoder(data, "<u2", True)
    stems = ["Caja", "caja", "CAJA", "ñjarr", "Ñjarr", "it's", "IT'S", "x1", "12", "", "T̈", "ẗ", "Àé", "İ", "ß", "×", "a×", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|endoftext|>b", "ΑΣ", "ﬁ", "é", "Ⅷ", "x'", "漢字", "ªµ", "aİb", "ŉ"]
    tails = ["", ".", "&&&", "%.", "'", "'s", "'S.", "…", ".̸", "≠", "|>", ">", "́", "*a", "\xa0.", "#$%&*"]
    words = ["".join(x) for x in itertools.product(stems, tails)]
    texts = [*words, *(" ".join(words[i::7]) for i in range(7)), "".join(words)]
    for part in (texts, list(reversed(texts))):
        assert parted.encode(part) == whole.encode(part)
    asked, fresh = [], tokenfiles.Encoder(data, "<u2", True)
    real = fresh._asked_at_once
    fresh._asked_at_once = lambda words: (asked.extend(words), real(words))[1]
    fresh.encode(["Caja. caja, CAJA&&& caja Caja&&&"])
    assert sorted(asked) == ["&&&", ",", ".", "caja"]


def test_dense_intervals_are_not_copied_into_many_buckets(spark):
    """Buckets grow with what intervals hold and are dealt to all tasks, whatever the rows read (F10)."""
    at = [("a", i, i // 2) for i in range(4000)] + [("b", i, 5) for i in range(9)]
    spans = [("a", i, i, i + 999) for i in range(1000)] + [("b", 1, 5, 5), ("b", 2, 6, 9), ("a", 2000, 9, 3)]
    points = spark.createDataFrame(at, "g string, id long, at long")
    intervals = spark.createDataFrame(spans, "g string, span long, lo long, hi long")
    placed = flatten._sized_grid(intervals, points, ["g"]).place(intervals.filter("lo <= hi"), b1="lo", b2="hi")
    assert len(spans) < placed.selectExpr("sum(b2 - b1 + 1)").first()[0] < 7 * len(spans)  # 32 times before
    found = flatten._meetings(intervals, points, ["g"])
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = sorted((r.g, r.span, r.id) for r in found.collect())
    assert got == sorted((g, s, i) for g, s, lo, hi in spans for k, i, t in at if k == g and lo <= t <= hi)


def test_buckets_are_split_further(spark):
    """Where intervals hold few of very many points, the buckets of the first level are split, and none is lost (F10)."""
    points = spark.range(60_000).selectExpr("'a' AS g", "id", "id * 3 AS at")
    intervals = spark.range(0, 60_000, 7).selectExpr("'a' AS g", "id AS span", "id * 3 AS lo", "id * 3 + 30 AS hi")
    grids = flatten._sized_grid(intervals, points, ["g"])
    assert len(grids.levels) == 2 and grids.place(points, b="at").groupBy("b").count().selectExpr("max(count)").first()[0] < 200
    assert flatten._meetings(intervals, points, ["g"]).count() == sum(min(11, 60_000 - i) for i in range(0, 60_000, 7))
