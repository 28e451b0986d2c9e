"""URL filters against plain Python rules and against SQL."""

import random
import re

import duckdb
import pytest

from brokerlens.llm import url_filter
from brokerlens.llm.common import documents
from brokerlens.llm.url_filter import RULE, RULES, SQL, DigestArray, judge_urls, packed, q_op12

SCHEMA = "page_id long, url string, tag string, host string, verdict string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def expected(urls, rules, default="allow"):
    out = []
    for i, url in urls:
        host, path = split(url)
        fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        out.append((i, host, path, best and best[2], best[3] if best else default))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)


def test_all_pages(spark):
    want = expected([tuple(r) for r in documents(spark, SF, "pages").select("page_id", "url").collect()], RULES)
    assert {x[3] for x in want} >= {None, "net/", "example.net/en/"}
    assert found(q_op12(spark, SF)) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    assert sorted(con.sql(SQL).fetchall(), key=repr) == want


SF = "/root/testdata/sf0.01"
EDGES = [None, "", "net", "no scheme.net/en/", "http://", "http://net", "http://net/", "HTTP://A.NET/EN/", "x://example.net/en/a?b#c", "http://example.net/EN/",
         "http://notexample.net/en/", "http://example.net?/en/", "http://example.net#/", "http://a.b.example.com/de/x/", "http://example.com/de", "http://org/fr/",
         "http://örg.org/fr/é\nü", "http://u@x.net:80/en", "http://x.net./", "http://..net/", "a://b://c.net/", "http://e.net/" + "y" * 50_000, "http://ÄX.Net/"]


@pytest.mark.parametrize("shipped", [1 << 20, 0])
def test_edges(spark, shipped):
    rows = [(i, u, "x", "y", "z") for i, u in enumerate(EDGES)] + [(None, "http://a.net/", "x", "y", "z"), (3, "http://a.net/", None, None, None)] * 2
    got = found(judge_urls(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(RULES, RULE), shipped_bytes=shipped))
    assert got == expected([(i, u) for i, u, *_ in rows], RULES)


@pytest.mark.parametrize("shipped", [1 << 24, 0])
def test_many_rules(spark, shipped):
    """Nested rules on shared hosts, both by the array and, for lists too large to ship, by the join."""
    r = random.Random(2)
    hosts = [".".join(r.choice(["a", "b", "cc", "example"]) for _ in range(r.randrange(1, 4))) for _ in range(60)]
    paths = ["".join(r.choice(["/", "x", "yé", "/z"]) for _ in range(r.randrange(0, 5))) for _ in range(80)]
    rules = sorted({(r.choice(hosts), r.choice(paths)) for _ in range(900)})
    rules = [(h, p, r.choice(["allow", "block"])) for h, p in rules]
    urls = [(i, f"http://{r.choice(['', 'www.'])}{r.choice(hosts)}{r.choice(paths)}{r.choice(paths)}{r.choice(['', '?q', '#f'])}") for i in range(1500)]
    df = spark.createDataFrame([(i, u, "", "", "") for i, u in urls], SCHEMA)
    got = found(judge_urls(df, spark.createDataFrame(rules, RULE), default="block", shipped_bytes=shipped))
    assert got == expected(urls, rules, "block")


def test_colliding_digests(tmp_path, monkeypatch):
    """With all keys equal only the stored strings tell the entries apart."""
    import numpy as np
    monkeypatch.setattr(url_filter, "_digests", lambda keys: np.zeros(len(keys), np.uint64))
    f = tmp_path / "rules"
    f.write_bytes(packed(RULES))
    a = DigestArray(str(f))
    assert a.rule_of(["x.net", "example.net", "example.com", "q.org"], ["/", "/en/1", "/en/", "/fr/"]) == [
        ("net/", 2), ("example.net/en/", 1), (None, -1), ("org/fr/", 1)]


def test_equal_rules_and_empty(spark):
    urls = spark.createDataFrame([(1, "http://a.net/x", "", "", "")], SCHEMA)
    twice = spark.createDataFrame([("NET", "/", "allow"), ("net", "/", "block"), (None, None, "allow"), ("net", "/x", None)], RULE)
    assert found(judge_urls(urls, twice)) == [(1, "a.net", "/x", "net/", "block")]
    assert found(judge_urls(urls, spark.createDataFrame([], RULE))) == [(1, "a.net", "/x", None, "allow")]
    assert found(judge_urls(spark.createDataFrame([], SCHEMA), twice)) == []


def test_scratch_is_released(spark):
    """What an operator wrote to the shared folder goes once its result is done with."""
    from brokerlens.llm.common import Scratch, release_scratch
    judged = judge_urls(spark.createDataFrame([(1, "http://a.net/x", "", "", "")], SCHEMA), spark.createDataFrame(RULES, RULE))
    assert judged.count() == 1 and Scratch.bases
    left = list(Scratch.bases)
    release_scratch(spark)
    fs = spark._jvm.org.apache.hadoop.fs.Path(left[-1]).getFileSystem(spark._jsc.hadoopConfiguration())
    assert not Scratch.bases and not any(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p)) for p in left)
