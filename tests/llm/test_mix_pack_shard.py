"""Mixing, token counts, packing and sharding against plain Python on small tables."""

import zlib
from collections import Counter, defaultdict

import pytest

from brokerlens.llm.common import documents
from brokerlens.llm.mixing import mix_documents, mix_sources, q_op1
from brokerlens.llm.packing import END_ID, SEQ_LEN, first_fit_decreasing, pack_documents, q_op3
from brokerlens.llm.sharding import place, q_op4, shard_documents
from brokerlens.llm.token_count import count_tokens, q_op2
from tests.llm.helpers import CLASH, SF, WORD, docs, edge_rows


def expected_targets(sizes, share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        left, total = budget - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: left * weight[s] / total for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


def test_mix_matches_water_filling(spark):
    d = documents(spark, SF)
    rows = mix_sources(d).collect()
    text = {r.doc_id: r.text for r in d.collect()}
    sizes = defaultdict(int)
    for r in rows:
        assert r["size"] == len(WORD.findall(text[r.doc_id] or ""))
        sizes[r.source] += r["size"]
    want = expected_targets(sizes)
    taken = defaultdict(int)
    for r in rows:
        assert r.target == pytest.approx(want[r.source])
        assert r.source_size == sizes[r.source]
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s]
    again = {r.doc_id: r.taken for r in q_op1(spark, SF).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_mixed_documents_are_the_mix(spark):
    d = documents(spark, SF)
    mix = {r.doc_id: r.repeats for r in mix_sources(d).collect() if r.repeats}
    assert Counter(r.doc_id for r in mix_documents(d).select("doc_id").collect()) == mix


def test_mix_edges(spark):
    rows = edge_rows()
    d = docs(spark, rows, CLASH)
    got = mix_sources(d).collect()
    assert len(got) == len(rows)
    assert all(r.taken <= 2 * r["size"] for r in got)
    assert {r["size"] for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert mix_documents(d).columns == d.columns
    assert mix_documents(d).count() == sum(r.repeats for r in got)
    assert mix_sources(d.limit(0)).count() == 0
    blank = docs(spark, [(1, None, "a"), (2, "", None)])
    assert [r.target for r in mix_sources(blank).collect()] == [0.0, 0.0]


def test_mix_with_given_weights(spark):
    d = docs(spark, [(i, "w " * 10, "ab"[i % 2]) for i in range(200)])
    w = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    got = {r.source: r for r in mix_sources(d, w, budget_share=1.0, max_epochs=4.0).groupBy("source").agg(
        {"taken": "sum", "target": "max"}).collect()}
    assert got["a"]["max(target)"] == 1500.0 and got["b"]["max(target)"] == 500.0
    assert abs(got["a"]["sum(taken)"] - 1500) <= 10 and abs(got["b"]["sum(taken)"] - 500) <= 10


def plain_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts_are_the_librarys(spark):
    tok = plain_tokenizer()
    rows = [(r.doc_id, r.text, r.source) for r in documents(spark, SF).collect()][:300] + edge_rows()
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs(spark, rows, CLASH)).collect())
    want = Counter()
    for i, t, _ in rows:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 1024] += 1
    assert got == want
    assert q_op2(spark, SF).count() == documents(spark, SF).count()


def test_chunks_round_trip_against_whole_encoding():
    from hypothesis import given, settings, strategies as st
    from brokerlens.llm.bpe import Encoder, RankEncoder
    import numpy as np
    tok, encoders = plain_tokenizer(), [Encoder("byte_bpe_50k.json"), RankEncoder("byte_bpe_50k.json")]

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from([*"ab1'sl!?. \t\n\r\x0b\x1c\x85\xa0\u3000ßé中😀²<|>", "<|endoftext|>", "'ll", "  "])))
    def same(parts):
        text = "".join(parts)
        for enc in encoders:
            assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    same()


def test_long_text_is_cut_only_at_safe_places(monkeypatch):
    from brokerlens.llm import bpe
    import numpy as np
    monkeypatch.setattr(bpe, "SEGMENT", 50)
    text = "ab  cd\n\nef! gh" * 200 + "x" * 500 + "   tail  "
    enc = bpe.Encoder("byte_bpe_50k.json")
    assert "".join(enc.segments(text)) == text
    assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == plain_tokenizer().encode(text, add_special_tokens=False).ids


def check_packing(rows, texts):
    tok = plain_tokenizer()
    pieces = defaultdict(list)
    seqs = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    import numpy as np
    for i, t in texts.items():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, END_ID]
        at = 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            part = np.array(ids[at:at + p.length], "<u4").tobytes()
            assert zlib.crc32(part) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    for s in seqs.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= SEQ_LEN
    return len(seqs)


def test_packing_holds_every_id_once(spark):
    rows = q_op3(spark, SF).collect()
    texts = {r.doc_id: r.text for r in documents(spark, SF).collect()}
    n = check_packing(rows, texts)
    assert sum(r.length for r in rows) >= 0.98 * n * SEQ_LEN


def test_packing_edges(spark):
    rows = [(i, t, s) for i, (_, t, s) in enumerate(edge_rows())]
    d = docs(spark, rows, CLASH)
    got = pack_documents(d)
    assert "ids" in got.columns
    check_packing(got.collect(), {i: t for i, t, _ in rows})
    assert all(len(r.ids) == r.length for r in got.collect())
    assert pack_documents(d.limit(0)).count() == 0
    same = docs(spark, [(1, "a b c", "s")] * 50)
    assert pack_documents(same).count() == 50


def test_registered_packing_holds_the_ids(spark):
    import corpus_pipeline
    import numpy as np
    d = documents(spark, SF).limit(200)
    text, tok = {r.doc_id: r.text for r in d.collect()}, plain_tokenizer()
    for got in (q_op3(spark, SF), corpus_pipeline.packing(spark, d, SF)):
        rows = [r for r in got.collect() if r.doc_id in text]
        assert {r.doc_id for r in rows} == set(text)
        ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, END_ID] for i, t in text.items()}
        for r in rows:
            assert list(r.ids) == ids[r.doc_id][r.start:r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())


def test_first_fit_decreasing_is_first_fit():
    import random
    r = random.Random(1)
    sizes = [r.randrange(1, 101) for _ in range(300)]
    bins, offsets = first_fit_decreasing(sizes, 100)
    room = []
    for i in sorted(range(300), key=lambda i: -sizes[i]):
        b = next((j for j, x in enumerate(room) if x >= sizes[i]), len(room))
        if b == len(room):
            room.append(100)
        assert bins[i] == b and offsets[i] == 100 - room[b]
        room[b] -= sizes[i]


def test_shards_are_balanced_and_whole(spark, monkeypatch):
    from brokerlens.llm import sharding
    monkeypatch.setattr(sharding, "BLOCK", 100)
    monkeypatch.setattr(sharding, "FAN_IN", 3)
    d = documents(spark, SF)
    rows = sharding.shard_documents(d, shards=8).collect()
    text = {r.doc_id: r.text or "" for r in d.collect()}
    size, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        assert r["size"] == len(text[r.doc_id].encode()) + 16
        assert r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        where[text[r.doc_id]].add(r.shard)
    assert len(rows) == len(text) and set(size) == set(range(8))
    assert max(size.values()) <= 1.03 * min(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())


def test_shard_query_and_hot_group(spark, monkeypatch):
    from brokerlens.llm import sharding
    rows = q_op4(spark, SF).collect()
    assert {r.shard for r in rows} == set(range(40)) and {r.law for r in rows} == {"bytes"}
    size = Counter()
    for r in rows:
        size[r.shard] += r["size"]
    assert max(size.values()) <= 1.1 * sum(size.values()) / 40
    texts, where = {r.doc_id: r.text for r in documents(spark, SF).collect()}, defaultdict(set)
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    monkeypatch.setattr(sharding, "PART_ROWS", 7)
    few = docs(spark, [(i, "twice" if i < 40 else f"text number {i} " + "x " * (i % 50), "s") for i in range(1000)])
    got = sharding.shard_documents(few, shards=5).collect()
    assert len({r.shard for r in got if r.doc_id < 40}) == 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    hot = docs(spark, [(i, "same text here" if i % 3 == 0 else f"text number {i}", "s") for i in range(3000)])
    n = Counter(r.shard for r in shard_documents(hot, shards=10).collect())
    assert max(n.values()) <= 1.15 * 300
    assert shard_documents(docs(spark, edge_rows(), CLASH), shards=4).count() == len(edge_rows())
    assert shard_documents(hot.limit(0)).count() == 0


def test_placement_takes_the_best_residual():
    import numpy as np
    got = place([[4, 4, 4], [4, 4, 4], [2, 2, 2], [2, 2, 2], [2, 2, 2], [2, 2, 2]], 2)
    load = np.bincount(got, [4, 4, 2, 2, 2, 2])
    assert load.tolist() == [8, 8]
