"""Collocations against plain Python counts and against SQL."""

import re
from collections import Counter

import duckdb
import pytest

from brokerlens.llm import phrases
from brokerlens.llm.common import documents
from brokerlens.llm.phrases import SQL, count_phrases, mine_collocations, q_op13
from tests.llm.helpers import CLASH, SF, docs, edge_rows, words
from tests.llm.test_spelling import LOW


def grams(rows):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in (1, 2, 3, 4):
                f.update((lang, tuple(w[i:i + n])) for i in range(len(w) - n + 1))
    return f, total


def expected(rows, threshold=30, top=2000):
    f, total = grams(rows)
    f = {k: a for k, a in f.items() if a >= threshold}
    cand = {k: a for k, a in f.items() if len(k[1]) > 1}
    dropped = set()
    for (lang, p), b in cand.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                if 100 * b >= 80 * cand[lang, p[i:i + m]]:
                    dropped.add((lang, p[i:i + m]))
    out = {}
    for (lang, p), a in cand.items():
        if (lang, p) not in dropped:
            cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1): (x[2].decode(), -x[1], x[3], x[4], total[lang], -x[0])
            for lang, xs in out.items() for i, x in enumerate(sorted(xs)[:top])}


def found(df):
    return {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def test_all_documents(spark):
    want = expected([(r.lang, r.text) for r in documents(spark, SF).select("lang", "text").collect()])
    assert len(want) > 200
    assert found(q_op13(spark, SF)) == want


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    rel = con.sql(SQL)
    got = {(r["lang"], r["rank"]): tuple(r[c] for c in ("phrase", "a", "l", "r", "n", "score"))
           for r in (dict(zip(rel.columns, x)) for x in rel.fetchall())}
    assert got == expected([(r.lang, r.text) for r in documents(spark, SF).select("lang", "text").collect()])


@pytest.mark.parametrize("shards, slots, flush", [(1, 1 << 16, 10_000_000), (3, 1 << 16, 500), (4, 64, 10_000_000)])
def test_counts_are_whole_whatever_the_shards(spark, monkeypatch, shards, slots, flush):
    """With 64 slots every phrase shares its slot with others: it is activated too early, never counted wrongly."""
    text = [(i, words(200, seed=i % 7, vocab=12) + ". " + words(60, seed=i, vocab=6), "s") for i in range(60)]
    df = docs(spark, text)
    monkeypatch.setattr(phrases, "FLUSH_BYTES", flush)
    got = {(r.lang, tuple(r.phrase.split(" "))): r.a for r in count_phrases(df, 30, 4, shards, slots).where("n > 0").collect()}
    f, total = grams([("en", t) for _, t, _ in text])
    assert got == {k: a for k, a in f.items() if a >= 30}
    assert {r.a for r in count_phrases(df, 30, 4, shards, slots).where("n = 0").collect()} == {total["en"]}


def test_late_phrases(spark):
    """Words that cross the threshold only in the last shard are still counted whole."""
    rows = [(i, "rare pair of words", "s") for i in range(30)] + [(1000 + i, "other text here", "s") for i in range(29)]
    got = {r.phrase: r.a for r in count_phrases(docs(spark, rows), 30).where("n > 0").collect()}
    assert got == {p: 30 for p in ("rare", "pair", "of", "words", "rare pair", "pair of", "of words", "rare pair of", "pair of words", "rare pair of words")}


def test_edges(spark):
    many = [(50 + i, "New\tYork\x0bcity, New  York; a\x00b \x1c c! é É new york", None) for i in range(40)]
    rows = [*edge_rows(), *many, *many[:3]]
    df = docs(spark, rows, CLASH + ["phrase", "n", "a", "start", "slot", "shard", "new"])
    from pyspark.sql import functions as F
    df = df.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.lit(None).cast("string")).when(F.col("doc_id") % 3 == 0, "und").otherwise(F.col("lang")))
    lang = lambda i: "en" if i is None or (i % 2 and i % 3) else "und"
    want = expected([(lang(i), t) for i, t, _ in rows])
    assert any(p[0] == "new york" for p in want.values())
    assert found(mine_collocations(df)) == want


def test_top_and_empty(spark):
    assert mine_collocations(docs(spark, [])).collect() == []
    assert mine_collocations(docs(spark, [(1, None, "a"), (2, "", "a")])).collect() == []
    rows = [(i, "a b. c d. e f. c d.", "s") for i in range(40)]
    got = found(mine_collocations(docs(spark, rows), top=2))
    assert got == expected([("en", t) for _, t, _ in rows], top=2) and len(got) == 2
