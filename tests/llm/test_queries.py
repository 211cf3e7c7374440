"""The operators' queries on the driver's smallest tables, against SQL, brute force or held-out labels."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spanweave.llm import simhash
from spanweave.llm.queries import ORACLES, QUERIES
from tests.oracle import TESTDATA, differences

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), ORACLES[name], SF) == []


def test_language_held_out_accuracy(spark, documents):
    truth = {d.doc_id: d.lang for d in documents}
    rows = [r for r in QUERIES["op1_language_id"](spark, SF).collect()]
    assert len(rows) == len(documents) and all(0 <= r.score <= 1 for r in rows)
    judged = [(r.lang_pred, truth[r.doc_id]) for r in rows if r.held_out and truth[r.doc_id]]
    assert sum(a == b for a, b in judged) >= 0.9 * len(judged)


def test_toxicity_held_out(spark):
    """On held-out labelled rows of the larger table: ranks, catches and leaves alone."""
    sf = f"{TESTDATA}/sf0.1"
    rows = {r.doc_id: r for r in QUERIES["op2_toxicity"](spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    held = [(rows[r.doc_id], r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None and r.doc_id in rows and rows[r.doc_id].held_out]
    toxic, clean = [x for x, y in held if y == 1], [x for x, y in held if y == 0]
    above = sum((a.score > b.score) + (a.score == b.score) / 2 for a in toxic for b in clean)
    assert above >= 0.95 * len(toxic) * len(clean)
    assert sum(x.predicted for x in toxic) >= 0.85 * len(toxic) and sum(x.predicted for x in clean) <= 0.01 * len(clean)


def test_bpe_as_the_library(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op4_bpe"](spark, SF).collect()}
    for d in documents:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[d.doc_id] == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def brute_components(prints, ids, radius=3):
    """Component of each: labels spread over all pairs until nothing changes."""
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
    label = ids.copy()
    while True:
        new = np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (new == label).all():
            return label
        label = new


def test_simhash_as_brute_force(spark, documents):
    prints = np.array([simhash.fingerprint_of(d.text) for d in documents], dtype=np.uint64)
    ids = np.array([d.doc_id for d in documents], dtype=np.int64)
    want = {int(i): (f"{int(p):016x}", int(c)) for i, p, c in zip(ids, prints, brute_components(prints, ids), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op9_simhash_golay"](spark, SF).collect()} == want


def plain_host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def test_url_rules_as_plain_python(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    rows = QUERIES["op8_url_filter"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path = plain_host_path(pages[r.page_id])
        fits = [x for x in rules if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith(x[x.index("/") :])]
        best = max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, best)
        assert r.verdict == rules[best] if best else r.verdict in ("allow", "block")
