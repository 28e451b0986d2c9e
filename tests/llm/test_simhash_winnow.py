"""SimHash components and winnowing fingerprints against plain Python."""

import hashlib
import random

import xxhash

from brokerlens.llm import simhash, winnowing
from brokerlens.llm.common import Scratch, documents
from brokerlens.llm.graph import connected_components
from brokerlens.llm.simhash import q_op7, simhash_components
from brokerlens.llm.winnowing import GRAM_LOG, WINDOW_LOG, fingerprint_documents, q_op9, with_next_document
from tests.llm.helpers import CLASH, SF, WORD, docs, edge_rows, words


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def check(rows, texts):
    fp = {i: fingerprint(t) for i, t in texts.items()}
    got = {r.doc_id: r for r in rows}
    assert all(int(r.fingerprint, 16) == fp[i] and len(r.fingerprint) == 16 for i, r in got.items())
    distinct = sorted(set(fp.values()))
    comp = components(distinct, lambda a, b: bin(a ^ b).count("1") <= 2)
    least = {}
    for i in sorted(fp, reverse=True):
        least[comp[fp[i]]] = i
    assert {i: r.component_id for i, r in got.items()} == {i: least[comp[fp[i]]] for i in fp}


def test_simhash_matches_brute_force(spark):
    check(q_op7(spark, SF).collect(), {r.doc_id: r.text for r in documents(spark, SF).collect()})


def test_planted_fingerprints_all_link(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base:
        for _ in range(20):
            x = b
            for _ in range(r.randrange(1, 5)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    want = components(fps, lambda a, b: bin(a ^ b).count("1") <= 2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    for crowd in (2048, 3):
        old, simhash.CROWD = simhash.CROWD, crowd
        try:
            scratch = Scratch(spark, "test")
            # CROWD is read on the workers: the crowded route is forced by a point of its own below
            got = {r.node: r.root for r in connected_components(simhash.links(df, scratch), scratch).collect()}
        finally:
            simhash.CROWD = old
        groups = {}
        for x in fps:
            groups.setdefault(want[x], set()).add(signed(x))
        for g in groups.values():
            assert {got.get(x, x) for x in g} == {min(g)}


def test_crowded_points_link_all_the_same(spark):
    """More than CROWD fingerprints with equal popcounts: all are sent on and linked exactly."""
    r = random.Random(9)
    one = [x for x in (1, 2, 4, 8)]
    fps = set()
    while len(fps) < 3 * simhash.CROWD // 2:
        fps.add(sum(r.choice(one) << 4 * j for j in range(16)))
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    scratch = Scratch(spark, "test")
    got = {r.node: r.root for r in connected_components(simhash.links(df, scratch), scratch).collect()}
    index, near = set(fps), {}
    for x in fps:
        near[x] = [y for i in range(64) for j in range(i) if (y := x ^ 1 << i ^ 1 << j) in index]
    seen, signed = set(), lambda x: x - (1 << 64) if x >> 63 else x
    for x in fps:
        if x in seen:
            continue
        group, todo = set(), [x]
        while todo:
            y = todo.pop()
            if y not in group:
                group.add(y)
                todo += near[y]
        seen |= group
        if len(group) > 1:
            assert {got[signed(y)] for y in group} == {min(map(signed, group))}


def test_simhash_edges(spark):
    rows = edge_rows()
    d = docs(spark, rows, CLASH)
    got = simhash_components(d).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert simhash_components(d.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    n = 300
    r = random.Random(1)
    names = r.sample(range(10_000), n)
    e = spark.createDataFrame([(names[i], names[i + 1]) for i in range(n - 1)] + [(20_000, 20_001)], "a long, b long")
    got = {r.node: r.root for r in connected_components(e, Scratch(spark, "test")).collect()}
    assert got == {x: min(names) for x in names} | {20_000: 20_000, 20_001: 20_000}


def winnowed(spark, pairs):
    return {r.doc_id: r for r in fingerprint_documents(docs(spark, [(i, t, "s") for i, t in pairs])).collect()}


def test_winnowing_chooses_rightmost_minima(spark):
    k, w = 1 << GRAM_LOG, 1 << WINDOW_LOG
    text = words(200, 4, vocab=6)
    all_ = winnowed(spark, [(i, " ".join(text.split()[i:i + k])) for i in range(197)])
    gram = [all_[i].hashes[0] for i in range(197)]
    chosen = sorted({max((j for j in range(i, i + w) if gram[j] == min(gram[i:i + w]))) for i in range(197 - w + 1)})
    got = winnowed(spark, [(0, text)])[0]
    assert got.positions == chosen and got.hashes == [gram[j] for j in chosen]


def test_winnowing_match_guarantee(spark):
    run = words(19, 11)
    got = winnowed(spark, [(0, words(100, 1) + " " + run + " " + words(70, 2)), (1, words(33, 3) + " " + run + " " + words(44, 4)), (2, words(19, 5)),
                           (3, words(100, 1)), (4, words(100, 1).replace(" ", " \t\n")), (5, "two words"), (6, "two words"), (7, ""), (8, None)])
    assert set(got[0].hashes) & set(got[1].hashes)
    assert got[3].hashes == got[4].hashes and got[5].hashes == got[6].hashes and len(got[5].hashes) == 1
    assert got[7].hashes == got[8].hashes == []


def edited_of(texts):
    order = sorted(texts, reverse=True)
    out = {}
    for a, b in zip(order, order[1:] + order[:1]):
        t, third = texts[a], len(texts[a]) // 3
        out[a] = t[:len(t) - third] + texts[b][:third]
    return out


def test_winnowing_query(spark):
    texts = {r.doc_id: r.text or "" for r in documents(spark, SF).collect()}
    want = edited_of(texts)
    rows = q_op9(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_chars == len(texts[r.doc_id])
        assert r.edited_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    by_text = {}
    for r in rows:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    long = [r for r in rows if r.n_chars > 600]
    assert sum(r.near_edited for r in long) / len(long) > 0.4
    assert sum(r.near_edited > r.near_next for r in long) >= 0.97 * len(long)


def test_next_document_edges(spark):
    rows = edge_rows()
    d = docs(spark, rows, CLASH)
    got = with_next_document(d).collect()
    assert len(got) == len(rows)
    assert with_next_document(d.limit(0)).count() == 0
    one = with_next_document(docs(spark, [(7, "only one", "s")])).collect()
    assert one[0].next_text == "only one"


def in_order(rows):
    """(id, text) by falling id, null ids last, then by the hash of the text, then by text."""
    mix = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), seed=42))
    ids = sorted({i for i, _ in rows if i is not None}, reverse=True)
    rank = {i: n for n, i in enumerate(ids)} | {None: len(ids)}
    return sorted(rows, key=lambda r: (rank[r[0]], mix(r[1]), r[1]))


def check_next(spark, rows, df):
    want = in_order([(i, t or "") for i, t in rows])
    got = with_next_document(df).collect()
    pairs = sorted(((r.doc_id, r.text, r.next_text) for r in got), key=repr)
    assert pairs == sorted(((i, t, want[(n + 1) % len(want)][1]) for n, (i, t) in enumerate(want)), key=repr)
    chosen = {r.text: r.chosen for r in got}
    assert all(r.next_chosen == chosen[r.next_text] for r in got)


def test_next_document_of_every_edge_row(spark, monkeypatch):
    rows = [(i, t) for i, t, _ in edge_rows()]
    d = docs(spark, edge_rows(), CLASH + ["key", "bounds", "mix"])
    check_next(spark, rows, d)
    monkeypatch.setattr(winnowing, "RANGE_BYTES", 5_000)      # a range for every few rows
    check_next(spark, rows, d)
    many = [(i % 40, words(20, i)) for i in range(300)]       # equal ids in several ranges
    check_next(spark, many, docs(spark, [(*r, "s") for r in many]))


def test_ids_of_other_types(spark):
    rows = [(x, words(30, n)) for n, x in enumerate(["b", "a", "ab", "", "é", None, "b"])]
    check_next(spark, rows, spark.createDataFrame(rows, "doc_id string, text string"))
    rows = [(x, words(30, n)) for n, x in enumerate([1.5, -2.0, 3.25])]
    check_next(spark, rows, spark.createDataFrame(rows, "doc_id double, text string"))


def test_texts_without_white_space(spark):
    """Two thirds of a text are enough to see the likeness, also without spaces, and other texts are not alike."""
    r = random.Random(4)
    han = ["".join(chr(r.randrange(0x4E00, 0x6000)) for _ in range(300)) for _ in range(2)]
    thai = ["".join(chr(r.randrange(0x0E01, 0x0E2E)) for _ in range(300)) for _ in range(2)]
    solid = ["".join(r.choice("abcdefgh0123456789+/") for _ in range(3000)) for _ in range(2)]
    for a, b in (han, thai, solid):
        cut = a[:len(a) * 2 // 3] + b[:len(a) // 3]
        got = winnowed(spark, [(0, a), (1, cut), (2, b), (3, a)])
        like = lambda x, y: len(set(x.hashes) & set(y.hashes)) / len(set(x.hashes) | set(y.hashes))
        assert like(got[0], got[1]) > 0.3 and like(got[0], got[2]) < 0.05 and got[0].hashes == got[3].hashes
    mixed = winnowed(spark, [(0, "abc " + han[0] + " def " + words(40, 1)), (1, "abc " + han[0])])
    assert set(mixed[0].hashes) & set(mixed[1].hashes)


def test_edited_edges(spark):
    """The edited text and the likenesses of null, empty, short and very long texts, and of repeated rows."""
    from pyspark.sql import functions as F
    rows = [(i, t or "") for i, t, _ in edge_rows()]
    want = in_order(rows)
    d = with_next_document(docs(spark, edge_rows()))
    d = d.withColumn("edited", winnowing.edited(F.col("text"), F.col("next_text")))
    got = sorted(((r.doc_id, r.text, r.edited) for r in d.collect()), key=repr)
    assert got == sorted(((i, t, t[:len(t) - len(t) // 3] + want[(n + 1) % len(want)][1][:len(t) // 3]) for n, (i, t) in enumerate(want)), key=repr)
