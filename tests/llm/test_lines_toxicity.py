"""Line dedup and toxicity against plain Python, planted cases and held-out labels."""

import math
import zlib

import pytest

from brokerlens.llm import toxicity
from brokerlens.llm.common import documents
from brokerlens.llm.line_dedup import (MIN_WORDS, RARE, common_blocks, dedup_lines, document_lines, overlapping, q_op8,
                                       segment_keys, shared_segments)
from tests.llm.helpers import CLASH, SF, docs, edge_rows, words


def shared_blocks(earlier, later, min_words=MIN_WORDS):
    """Numbers of the lines of ``later`` in any block of equal lines of that many words, by brute force."""
    a = [x.strip() for x in earlier.split("\n") if x.strip()]
    b = [(i, x.strip()) for i, x in enumerate(later.split("\n")) if x.strip()]
    gone = set()
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k][1]:
                k += 1
            if sum(len(x.split()) for _, x in b[j:j + k]) >= min_words:
                gone.update(n for n, _ in b[j:j + k])
    return gone


def test_common_blocks_are_all_common_blocks():
    import random
    r = random.Random(2)
    lines = [(i, r.choice([5, 20, 30, 60])) for i in range(12)]
    for _ in range(400):
        a, b = ([r.choice(lines) for _ in range(r.randrange(1, 14))] for _ in range(2))
        got = common_blocks([h for h, _ in a], [w for _, w in a], [h for h, _ in b], [w for _, w in b])
        text = lambda x: "\n".join(" ".join([f"l{h}"] * w) for h, w in x)
        assert got == shared_blocks(text(a), text(b))


def test_line_dedup_matches_brute_force(spark):
    texts = {r.doc_id: r.text or "" for r in documents(spark, SF).collect()}
    long = {i for i, t in texts.items() if any(len(x.split()) >= 1 for x in t.split("\n"))}
    by_line = {}
    for i in sorted(long):
        for x in {x.strip() for x in texts[i].split("\n") if x.strip()}:
            by_line.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in by_line.values() for k, b in enumerate(ids) for a in ids[:k]}
    want = {}
    for a, b in pairs:
        if g := shared_blocks(texts[a], texts[b]):
            want.setdefault(b, set()).update(g)
    rows = q_op8(spark, SF).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: set(r.gone_lines) for r in rows if r.n_gone} == want
    for r in rows:
        left = [x for i, x in enumerate(texts[r.doc_id].split("\n")) if i not in want.get(r.doc_id, ())]
        assert r.text == "\n".join(left)


def test_planted_passages_stay_once(spark):
    one, two = words(60, 1), words(70, 2)
    rows = [(1, f"{words(30, 3)}\n{one}\n{words(20, 4)}", "s"), (2, f"{two}\n{words(25, 5)}\n{one}", "s"),
            (3, f"{one}\n{words(9, 6)}\n{two}\n{one}", "s"), (4, words(49, 7), "s"), (5, words(49, 7), "s"), (None, one, "s")]
    got = {r.doc_id: r for r in dedup_lines(docs(spark, rows, CLASH), report=True).collect()}
    assert got[1].text == rows[0][1] and got[2].text == f"{two}\n{words(25, 5)}"
    assert got[3].text == words(9, 6) and list(got[3].earlier) == [1, 2]
    assert got[4].text == got[5].text == words(49, 7)
    assert got[None].text == "" and list(got[None].earlier) == [1]
    kept = dedup_lines(docs(spark, rows, CLASH))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5]


def test_blocks_that_go_on_beyond_the_first_holder(spark):
    import random
    p, q = words(55, 1), words(40, 2)
    rows = [(1, f"{p}\n{words(9, 3)}", "s"), (2, f"{words(9, 4)}\n{p}\n{q}", "s"), (3, f"{p}\n{q}\n{words(9, 5)}", "s")]
    got = {r.doc_id: r for r in dedup_lines(docs(spark, rows), report=True).collect()}
    assert got[1].text == rows[0][1] and got[2].text == f"{words(9, 4)}\n{q}" and got[3].text == words(9, 5)
    r = random.Random(8)
    lines = [words(n, 100 + i) for i, n in enumerate((5, 20, 30, 10, 40, 60, 25, 15))]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(1, 9))), "s") for i in range(150)]
    got = {r.doc_id: set(r.gone) for r in dedup_lines(docs(spark, rows), report=True).collect()}
    for i, text, _ in rows:
        assert got[i] == set().union(*[shared_blocks(earlier, text) for _, earlier, _ in rows[:i]])


@pytest.mark.parametrize("vocab,copies", [(400, 1), (90, 2), (30, 1)])
def test_rare_and_frequent_lines_find_every_block(spark, vocab, copies):
    import random
    r = random.Random(vocab)
    lines = [words(r.choice((3, 12, 26, 55)), 1000 + i) for i in range(vocab)]
    rows = []
    for i in range(70):
        at = r.randrange(vocab - 4)
        text = [r.choice(lines) for _ in range(r.randrange(4))] + lines[at:at + r.randrange(1, 5)] + [words(9, 5000 + i)] + [r.choice(lines)] * r.randrange(2)
        rows += [(i, "\n\n".join(text), "s")] * copies
    got = {r.doc_id: set(r.gone) for r in dedup_lines(docs(spark, rows), report=True).collect()}
    texts = dict((i, t) for i, t, _ in rows)
    for i, text in texts.items():
        assert got[i] == set().union(*[shared_blocks(texts[k], text) for k in range(i)])


def test_keys_are_rare_lines_and_runs_of_frequent_lines():
    keys = segment_keys([7, 8, 9, 7], [30, 30, 60, 30], [False, True, True, False])
    assert keys[(7, True)] == [0, 3] and (8, True) not in keys
    runs = [span for (_, rare), span in keys.items() if not rare]
    # 8+9 from line 1 on; 9 alone, from line 2 on and up to it
    assert sorted(runs) == [[1, 1], [2, 2]]


def test_pairs_carry_only_the_lines_around_their_keys(spark):
    passages = [words(60, 10 + i) for i in range(40)]
    heading = words(8, 9)
    rows = [(0, "\n".join(passages), "s")]
    rows += [(1 + i, f"{heading}\n{words(20, 100 + i)}\n{p}", "s") for i, p in enumerate(passages)]
    rows += [(100 + i, f"{passages[3]}\n{words(20, 200 + i)}", "s") for i in range(RARE + 3)]
    segments = shared_segments(document_lines(docs(spark, rows)))
    got = segments.collect()
    # the heading of 8 words stands in 40 documents and is no segment
    assert len(got) == 1 + 40 + RARE + 3 and all(len(r.hashes) == 1 for r in got if r.doc_id)
    pairs = overlapping(segments).collect()
    # one pair a passage, with the long document only, and one for each further holder of passage 3
    assert sorted((p.b.doc_id, p.a.doc_id) for p in pairs) == [(r[0], 0) for r in rows[1:]]
    assert all(min(p.a.n, p.b.n + p.high) - max(0, p.low) == 1 for p in pairs)
    out = {r.doc_id: r for r in dedup_lines(docs(spark, rows), report=True).collect()}
    assert all(list(out[r[0]].earlier) == [0] and passages[3] not in out[r[0]].text for r in rows[1:])


def test_line_dedup_edges(spark):
    d = docs(spark, edge_rows(), CLASH)
    got = dedup_lines(d)
    assert got.columns == d.columns
    # rows 5, 6, 6 hold the same 50 words: the two equal rows 6 are one document, later than 5
    left = sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect())
    assert left == sorted((i is None, i or 0) for i, _, _ in edge_rows() if i != 6)
    assert dedup_lines(d.limit(0)).count() == 0


def brute_marginals(model, factors):
    """P(state is toxic) per word, over all state sequences."""
    import itertools
    n, total, toxic = len(factors), 0.0, [0.0] * len(factors)
    for ys in itertools.product((0, 1), repeat=n):
        s = sum(y * (model.bias + f) for y, f in zip(ys, factors)) + ys[0] * model.start
        s += sum(model.moves[a][b] for a, b in zip(ys, ys[1:]))
        total += math.exp(s)
        for i, y in enumerate(ys):
            toxic[i] += y * math.exp(s)
    return [t / total for t in toxic]


@pytest.mark.parametrize("near", [0, 1, 8])
def test_marginals_are_exact(monkeypatch, near):
    monkeypatch.setattr(toxicity, "NEAR", near)
    model = toxicity.Model({}, -1.3, -0.4, ((0.5, -0.7), (-0.2, 0.9)))
    for factors in ([0, 0, 0, 2.5, 0, 0, 0, 0, 1.1, 0, 0], [3.0], [0, 4.0, 1.0], [0] * 9 + [2.0], [2.0] + [0] * 8):
        want = brute_marginals(model, factors)
        hits = [(i, f) for i, f in enumerate(factors) if f]
        for i, p in toxicity.Chain(model).marginals(len(factors), hits):
            assert p == pytest.approx(want[i], abs=1e-9)


def test_field_learns_its_labels():
    import random
    r = random.Random(0)
    seqs = []
    for _ in range(200):
        feats = [[r.randrange(3)] if r.random() < 0.3 else [] for _ in range(r.randrange(1, 20))]
        seqs.append((feats, [int(f == [0]) for f in feats]))
    w, bias, start, moves = toxicity.fit_field(seqs, 3)
    assert w[0] > 2 and w[0] > w[1] + 2 and bias < 0
    p = dict(toxicity.Chain(toxicity.Model({}, bias, start, moves)).marginals(5, [(1, w[0]), (3, w[1])]))
    assert p[1] > 0.9 > 0.2 > p[3]


INSULTS = ["vorpal", "snargle", "blunk"]


def labelled(spark, n=900):
    import random
    r = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = words(80, i, vocab=300).split()
        if toxic:
            for _ in range(r.randrange(1, 5)):
                w.insert(r.randrange(len(w)), r.choice(INSULTS) + r.choice(["", ",", "."]))
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 1, int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_spans(spark):
    rows, labels = labelled(spark)
    d = docs(spark, rows, CLASH)
    model = toxicity.train(d, labels)
    got = {r.doc_id: r for r in toxicity.score_documents(d, model).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert 200 < len(held) < 400
    assert sum((got[i].score >= 0.7) == (i % 5 == 0) for i in held) >= 0.99 * len(held)
    for i, text, _ in rows[:50]:
        want = [w for w in text.split() if any(w.startswith(x) for x in INSULTS)]
        assert [text[s.start:s.end] for s in got[i].spans] == want
    kept = {r.doc_id for r in toxicity.drop_toxic(d, model).collect()}
    assert kept == {i for i, r in got.items() if r.score < 0.7}


def test_toxicity_edges(spark):
    rows, labels = labelled(spark, 300)
    d = docs(spark, rows + edge_rows(), CLASH)
    model = toxicity.train(d, labels)
    assert toxicity.score_documents(d, model).count() == len(rows) + len(edge_rows())
    assert toxicity.drop_toxic(d, model).columns == d.columns
    empty = toxicity.train(d, labels.limit(0))
    assert {round(r.score, 9) for r in toxicity.score_documents(d, empty).collect()} == {0.0}
    only = toxicity.train(d, labels.where("toxic = 1"))
    assert {round(r.score, 6) for r in toxicity.score_documents(d, only).collect()} == {1.0}
    assert toxicity.score_documents(d.limit(0), model).count() == 0


def test_capped_sample_keeps_the_natural_share(spark):
    import random
    r, rows, labels = random.Random(11), [], []
    for i in range(3000):
        toxic, w = i % 8 == 0, words(20, i, vocab=300).split()
        if r.random() < (0.8 if toxic else 0.07):
            w.insert(r.randrange(len(w)), "vorpal")
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(toxic)))
    # 0.62 of the documents with the word are toxic, 0.92 where the classes are equally large
    held = [i for i, t, _ in rows if "vorpal" in t]
    share = sum(i % 8 == 0 for i in held) / len(held)
    assert 0.5 < share < 0.68
    labels += [(-i, 1) for i in range(1, 3000)]      # without a document
    d = docs(spark, rows)
    for sample in (toxicity.SAMPLE, 220):
        model = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, toxic int"), sample=sample)
        score = {x.doc_id: x.score for x in toxicity.score_documents(d, model).collect()}
        assert sum(score.values()) / 3000 == pytest.approx(1 / 8, abs=0.03), sample
        assert sum(score[i] for i in held) / len(held) == pytest.approx(share, abs=0.12), (sample, score[held[0]])
    plain = toxicity.train(docs(spark, [(i, "same words", "s") for i in range(800)]),
                           spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(800)], "doc_id long, toxic int"), sample=50)
    assert plain.score(0.0, 0.0) == pytest.approx(1 / 8, abs=0.03)


def test_toxicity_query(spark):
    rows = toxicity.q_op5(spark, SF).collect()
    assert len(rows) == documents(spark, SF).count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    label = {r.doc_id: r.toxic for r in documents(spark, SF, "labels").collect()}
    held = [(r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
    assert auc > 0.85 and not any(s >= 0.7 for s in neg)
