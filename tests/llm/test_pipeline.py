"""The pipeline's stages, each on its own input, against plain Python."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline as P
from brokerlens.llm.common import documents
from brokerlens.llm.simhash import keep_one_of_each
from brokerlens.llm.toxicity import q_op5
from tests.llm.helpers import CLASH, SF, docs, edge_rows
from tests.llm.test_lines_toxicity import shared_blocks
from tests.llm.test_mix_pack_shard import check_packing, expected_targets
from tests.llm.test_simhash_winnow import components, fingerprint
from tests.llm.helpers import WORD


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage, written and read as the driver does."""
    top = tmp_path_factory.mktemp("stages")
    frames = [documents(spark, SF)]
    for name, f in P.STAGES:
        path = str(top / name)
        f(spark, frames[-1], SF).write.parquet(path)
        frames.append(spark.read.parquet(path))
    return frames


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_toxicity_stage(spark, stages):
    rejected = {r.doc_id for r in q_op5(spark, SF).collect() if r.predicted}
    before, after = ({r.doc_id: r for r in df.collect()} for df in stages[:2])
    assert rejected and after == {i: r for i, r in before.items() if i not in rejected}


def test_line_stage(stages):
    before, after = ({r.doc_id: r for r in df.collect()} for df in stages[1:3])
    order = sorted(before)
    lines = {i: {x.strip() for x in before[i].text.split("\n") if x.strip()} for i in order}
    holders = {}
    for i in order:
        for x in lines[i]:
            holders.setdefault(x, []).append(i)
    for i in order:
        earlier = {a for x in lines[i] for a in holders[x] if a < i}
        gone = set().union(*[shared_blocks(before[a].text, before[i].text) for a in earlier]) if earlier else set()
        want = "\n".join(x for n, x in enumerate(before[i].text.split("\n")) if n not in gone)
        if gone and not want.strip():
            assert i not in after
        else:
            assert after[i].text == want and after[i].n_chars == len(want)


def test_simhash_stage(stages):
    before, after = ({r.doc_id: r for r in df.collect()} for df in stages[2:4])
    fp = {i: fingerprint(r.text) for i, r in before.items()}
    comp = components(sorted(set(fp.values())), lambda a, b: bin(a ^ b).count("1") <= 2)
    keep = {}
    for i in sorted(before, reverse=True):
        keep[comp[fp[i]]] = i
    assert after == {i: before[i] for i in keep.values()}


def test_mixing_stage(stages):
    before = {r.doc_id: r for r in stages[3].collect()}
    times = Counter(r.doc_id for r in stages[4].collect())
    sizes, taken = Counter(), Counter()
    for i, r in before.items():
        n = len(WORD.findall(r.text or ""))
        sizes[r.source] += n
        taken[r.source] += n * times[i]
        assert times[i] <= 2
    for s, t in expected_targets(sizes).items():
        assert abs(taken[s] - t) <= 0.02 * t


def test_packing_stage(stages):
    mixed = stages[4].select("doc_id", "text").collect()
    times = Counter(r.doc_id for r in mixed)
    rows = stages[5].collect()
    once, seen = [], Counter()
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        seen[r.doc_id, r.start] += 1
    assert all(n == times[i] for (i, _), n in seen.items())
    firsts = {}
    for r in rows:
        firsts.setdefault((r.doc_id, r.start), r)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert sum(r.length for r in rows) >= 0.98 * 2048 * len(sequences)
    assert {i for i, _ in firsts} == set(times)


def test_run_agrees_with_the_stages(spark, stages):
    digest = lambda df: Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert digest(P.run(spark, SF)) == digest(stages[5])


def test_one_of_each_edges(spark):
    d = docs(spark, edge_rows(), CLASH)
    got = keep_one_of_each(d)
    assert got.columns == d.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect())
    # 1, 2, 3 and the null text share fingerprint zero; 5, 6, 6 are one text
    assert ids == [(False, i) for i in (1, 4, 5, 8, 9, 10, 11, 12)] + [(True, 0)]
    same = docs(spark, [(None, "a b c d", "s")] * 3 + [(None, "other words in here", "s")])
    assert sorted(r.text for r in keep_one_of_each(same).collect()) == ["a b c d", "other words in here"]
    assert keep_one_of_each(d.limit(0)).count() == 0


def test_stages_take_edge_rows(spark):
    d = docs(spark, edge_rows(), CLASH)
    for name, f in P.STAGES:
        d2 = f(spark, d, SF)
        if name != "packing":
            assert d2.columns == d.columns
        assert d2.count() >= 0 and f(spark, d.limit(0), SF).count() == 0
