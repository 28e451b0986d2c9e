"""Spelling variants against plain Python: every word's one-edit neighbours by deleting letters."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from brokerlens.llm.common import Scratch, documents
from brokerlens.llm.spelling import group_variants, near_words, q_op11
from tests.llm.helpers import CLASH, SF, docs, edge_rows

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vocabulary(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 3}


def neighbours(vocab):
    """Pairs at one replaced, inserted or deleted letter: they share a string with one letter out."""
    of = defaultdict(set)
    for w in vocab:
        for i in range(len(w)):
            of[w[:i] + w[i + 1:], i].add(w)      # replaced at i
    near = defaultdict(set)
    for same in of.values():
        for w in same:
            near[w] |= same - {w}
    for w in vocab:
        for i in range(len(w)):
            x = w[:i] + w[i + 1:]
            if x in vocab:
                near[w].add(x)
                near[x].add(w)
    return near


def expected(vocab):
    near, form, out = neighbours(vocab), {}, {}
    for w, n in vocab.items():
        best = min(near[w], key=lambda x: (-vocab[x], x), default=None)
        form[w] = best if best is not None and vocab[best] >= 2 * n else None
    for w, n in vocab.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), vocab[form[w]] if form[w] else None)
    return out


def found(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_all_documents(spark):
    want = expected(vocabulary([(r.doc_id, r.text) for r in documents(spark, SF).select("doc_id", "text").collect()]))
    assert sum(1 for x in want.values() if x[0]) > 100 and any(x[1] != x[0] for x in want.values() if x[0])
    assert found(q_op11(spark, SF)) == want


def random_words(r, n, letters, longest):
    return {"".join(r.choice(letters) for _ in range(r.randrange(5, longest + 1))) for _ in range(n)}


@pytest.mark.parametrize("crowd", [4096, 40, 2])
def test_dense_vocabulary(spark, crowd):
    """Few letters, so that runs of equal letters and large blocks occur; small blocks are refined to single positions."""
    r = random.Random(7)
    words = random_words(r, 1500, "ab", 11) | random_words(r, 400, "aé×z", 7) | {"a" * k for k in range(5, 40)} | {"x" * 300, "x" * 301, "x" * 300 + "y"}
    vocab = {w: r.randrange(3, 200) for w in words}
    near = neighbours(vocab)
    df = spark.createDataFrame(list(vocab.items()), "word string, n long")
    got = {x.word: (x.n_near, x.best, x.n_best) for x in near_words(df, Scratch(spark, "test"), crowd=crowd).collect()}
    want = {w: (len(near[w]), *(lambda b: (b, vocab[b]))(min(near[w], key=lambda x: (-vocab[x], x)))) for w in vocab if near[w]}
    assert got == want


def test_a_third_of_the_words_in_one_block(spark):
    """One long common beginning: the block of its first half is refined, nothing is lost."""
    r = random.Random(1)
    words = {"commonstem" + "".join(r.choice("abc") for _ in range(10)) for _ in range(3000)}
    vocab = {w: r.randrange(3, 9) for w in words}
    near = neighbours(vocab)
    df = spark.createDataFrame(list(vocab.items()), "word string, n long")
    got = {x.word: x.n_near for x in near_words(df, Scratch(spark, "test"), crowd=500).collect()}
    assert got == {w: len(near[w]) for w in vocab if near[w]}


def test_edges(spark):
    rows = [*edge_rows(), *[(100 + i, "ÀÉ×÷ÿ Àé×÷ÿ straße straßen Straße house houses hause", "a") for i in range(4)], (200, "house " * 50, None)]
    df = docs(spark, rows, CLASH + ["word", "n", "key", "core", "form", "near"])
    want = expected(vocabulary([(i, t) for i, t, _ in rows]))
    assert want["hause"][:2] == ("house", "house") and want["straßen"][3] == 1
    assert found(group_variants(df)) == want


def test_empty_and_wordless(spark):
    assert group_variants(docs(spark, [])).collect() == []
    assert group_variants(docs(spark, [(1, None, "a"), (2, "", "a"), (3, "ab 12 --", "a")])).collect() == []


def test_strings_as_ids(spark):
    df = spark.createDataFrame([("x1", "colour colour colour color color color color color color")], "doc_id string, text string")
    assert found(group_variants(df)) == expected(vocabulary([("x1", "colour colour colour color color color color color color")]))
