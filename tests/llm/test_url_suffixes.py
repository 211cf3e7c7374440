"""What the trees say of URLs that no rule decides, when rules give the labels."""

from pyspark.sql import functions as F

from spanweave.llm import urlfilter
from spanweave.llm.queries import QUERIES
from tests.oracle import TESTDATA


def test_no_suffix_decides_alone(spark):
    rows = QUERIES["op8_url_filter"](spark, f"{TESTDATA}/sf0.01").filter("rule is null")
    got = {(r.suffix, r.verdict) for r in rows.select(F.substring_index("host", ".", -1).alias("suffix"), "verdict").distinct().collect()}
    assert got >= {(s, v) for s in ("com", "org") for v in ("allow", "block")}


def test_a_suffix_with_both_verdicts_counts(spark):
    """Of two suffixes with the same other features, the one with more blocked URLs is blocked."""
    hosts = [f"{name}.{suffix}" for suffix in ("aaa", "bbb") for name in ("h0", "h1", "h2", "h3", "h4")]
    rules = [(h, "/", "block" if (h[-1] == "a") == (h[1] != "4") else "allow") for h in hosts]
    urls = [f"http://{h}/page{i:03}" for h in hosts for i in range(40)] + ["http://h9.aaa/page001", "http://h9.bbb/page001"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r.host: r.verdict for r in urlfilter.url_filter(pages, rules).filter("rule is null").collect()}
    assert rows == {"h9.aaa": "block", "h9.bbb": "allow"}
