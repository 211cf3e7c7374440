"""The pipeline's stages and the whole run against plain Python versions of their own."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_similar import brute_components
from tests.oracle import TESTDATA

SF = f"{TESTDATA}/sf0.001"


def within_two_edits(a, b):
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if sum(((ca := Counter(a)) - (cb := Counter(b))).values()) > 2 or sum((cb - ca).values()) > 2:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1] <= 2


def plain_lines(docs):
    """Documents {doc_id: text} without repeated and nearly repeated lines."""
    places = {}
    for d in sorted(docs):
        for i, line in enumerate((docs[d] or "").split("\n")):
            if line.strip(" \t\n\v\f\r") and len(line) >= 10:
                places.setdefault(line, []).append((d, i))
    label = {x: x for x in places}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    by_length = {}
    for x in places:
        if len(x) >= 40:
            by_length.setdefault(len(x), []).append(x)
    for n, some in by_length.items():
        for i, a in enumerate(some):
            for b in [*some[i + 1 :], *by_length.get(n + 1, []), *by_length.get(n + 2, [])]:
                if within_two_edits(a, b):
                    label[root(a)] = root(b)
    first = {}
    for x, where in places.items():
        first[root(x)] = min(first.get(root(x), where[0]), *where)
    out = {}
    for d, text in docs.items():
        lines = (text or "").split("\n")
        gone = {i for i, line in enumerate(lines) if line in places and (d, i) != first[root(line)]}
        worded = {i for i, line in enumerate(lines) if line.strip(" \t\n\v\f\r")}
        if not worded or worded - gone:
            out[d] = text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def plain_mix(docs):
    """How often each of {doc_id: (text, source)} is taken; those without a word once."""
    size = {d: len((t or "").split()) for d, (t, _) in docs.items()}
    sources = sorted({s for _, s in docs.values()}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[d] for d in docs if docs[d][1] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(sources)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * total[s]}
        if not full:
            target |= share
            break
        target |= {s: 2.0 * total[s] for s in full}
        left, open_ = left - sum(2.0 * total[s] for s in full), open_ - full
    times = {d: 1 for d in docs if not size[d]}
    for s in sources:
        own = sorted((hashlib.md5(f"mix|{d}".encode()).hexdigest()[:9], d) for d in docs if docs[d][1] == s and size[d])
        whole = int(target[s] // total[s]) if total[s] else 0
        budget, taken = target[s] - whole * total[s], 0
        for _, d in own:
            more = taken + size[d] <= budget or (taken <= budget and taken + size[d] - budget < budget - taken)
            times[d] = whole + more
            taken = taken + size[d] if more and taken + size[d] <= budget else float("inf")
    return times


def test_stages_as_plain_versions(spark):
    """Language ID is a model: what it keeps is taken as it is. The other stages are worked out anew from there."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = corpus_pipeline.language_stage(spark, docs, SF).collect()
    truth = {r.doc_id: r.text for r in docs.collect()}
    assert 0.9 * len(truth) <= len(known) <= len(truth) and all(truth[r.doc_id] == r.text for r in known)
    assert all(any(map(str.isalpha, r.text)) for r in known)

    source, lines = {r.doc_id: r.source for r in known}, plain_lines({r.doc_id: r.text for r in known})
    roots = brute_components(lines)
    firsts = {d: t for d, t in lines.items() if roots[d] == d}
    times = plain_mix({d: (t, source[d]) for d, t in firsts.items()})
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    want = Counter()
    for d, t in firsts.items():
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes()
        want[d, source[d], ids] += times[d]
    got = corpus_pipeline.run(spark, SF).collect()
    assert all(r.round_trip and 4 * r.n_tokens == len(r.ids) for r in got)
    assert Counter((r.doc_id, r.source, bytes(r.ids)) for r in got) == +want


def test_line_stage_as_plain_version(spark):
    rng = random.Random(12)
    words = [f"word{i}" for i in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(9)) for _ in range(20)]
    docs = {}
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            x = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                x[rng.randrange(len(x))] = rng.choice("xyz")
            lines.append("".join(x))
        docs[d] = "\n".join([*lines, *[""] * rng.randrange(2), *["short"] * rng.randrange(2)])
    df = spark.createDataFrame([(d, t, len(t), 1, "r") for d, t in docs.items()], "doc_id long, text string, n_chars long, counts int, row string")
    got = {r.doc_id: r for r in corpus_pipeline.line_stage(spark, df, "").collect()}
    assert {d: r.text for d, r in got.items()} == plain_lines(docs)
    assert all(r.n_chars == len(r.text) and (r.counts, r.row) == (1, "r") for r in got.values())


def test_stages_with_clashing_columns(spark):
    """Columns named like the stages' own come through."""
    names = ["row", "p", "counts", "size", "h", "whole", "threshold", "target", "version", "own", "line_dedup", "print", "root"]
    rows = [(i, f"the same words again and again in text number {i} of all these", "en", "a", *["x"] * len(names)) for i in range(4)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string", *(f"{n} string" for n in names)]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns, name
        assert all(r[n] == "x" for r in out.collect() for n in names), name
