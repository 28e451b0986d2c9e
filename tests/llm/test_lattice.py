"""E8 lattice hashing against brute force."""

import numpy as np
import pytest
from pyspark.sql import types as T

from brokerlens.llm import lattice
from brokerlens.llm.common import documents
from brokerlens.llm.lattice import cell_keys, nearest_point, probe_keys, q_op10, roots, search_plan, vector_links

VEC = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                    T.StructField("rid", T.StringType()), T.StructField("clump", T.StringType())])


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VEC)


def brute(rows, cosine=0.95):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for a in ok:
        for b in ok:
            x, y = rows[a][1], rows[b][1]
            if a != b and len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links[a].add(b)
    comp = {}
    for i in range(len(rows)):
        if i not in comp:
            group, todo = set(), [i]
            while todo:
                x = todo.pop()
                if x not in group:
                    group.add(x)
                    todo += links[x]
            ids = [rows[x][0] for x in group if rows[x][0] is not None]
            comp |= {x: min(ids) if ids else None for x in group}
    return links, comp


def cone(r, centre, cosine):
    t = r.normal(size=len(centre))
    t -= t @ centre * centre
    return cosine * centre + np.sqrt(1 - cosine ** 2) * t / np.linalg.norm(t)


def test_nearest_point_is_nearest():
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 8)) * 2
    c = nearest_point(x)
    assert len(roots()) == 240
    twice = 2 * c
    assert np.allclose(twice, np.rint(twice)) and np.all((twice % 2 == twice[:, :1] % 2)) and np.allclose(c.sum(1) % 2, 0)
    d = ((x - c) ** 2).sum(1)
    for v in roots():
        assert np.all(d <= ((x - c - v) ** 2).sum(1) + 1e-9)


def test_links_match_brute_force(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in documents(spark, "/root/testdata/sf0.01", "embeddings").collect()]
    links, comp = brute(rows)
    got = {r.vec_id: r for r in q_op10(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    for i, (v, _) in enumerate(rows):
        assert (got[v].n_links, got[v].component_id, got[v].kept) == (len(links[i]), comp[i], comp[i] == v)


@pytest.mark.parametrize("dim", [8, 16, 64, 200])
@pytest.mark.parametrize("n", [300, 10 ** 4, 10 ** 6, 10 ** 10])
def test_plan_keeps_the_recall_at_every_size(dim, n):
    """Pairs at the least cosine meet in one of the plan's tables, however many blocks a cell has."""
    blocks, tables = search_plan(n, dim)
    r = np.random.default_rng(2)
    x = r.normal(size=(800, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([cone(r, v, 0.95) for v in x])
    met = np.zeros(len(x), bool)
    for t in range(2, 2 + tables):
        met |= (probe_keys(x, t, blocks) == cell_keys(y, t, blocks)[:, None]).any(axis=1)
    assert met.mean() >= 0.97


def test_cells_of_strangers_do_not_grow():
    """Random vectors in one cell, per vector: the same few with ten times as many vectors."""
    r = np.random.default_rng(4)
    x = r.normal(size=(200_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for n in (2_000, 20_000, 200_000):
        blocks, _ = search_plan(n, 64)
        size = np.unique(cell_keys(x[:n], 2, blocks), return_counts=True)[1].astype(float)
        assert (size * (size - 1)).sum() / n <= 2 * lattice.STRANGERS
    plans = [search_plan(10 ** k, 64) for k in range(2, 13)]
    assert plans == sorted(plans) and plans[0][0] == 1 and plans[-1][0] <= 5
    assert search_plan(0, 64) == (plans[0][0], plans[0][1]) and search_plan(10 ** 9, 1)[0] == 1


@pytest.mark.parametrize("strangers", [4, 1e-3, 1e-6])
def test_recall_at_the_threshold(spark, monkeypatch, strangers):
    """With one block and with the blocks of much larger tables."""
    monkeypatch.setattr(lattice, "STRANGERS", strangers)
    r = np.random.default_rng(7)
    base = r.normal(size=(600, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, (3.5 * cone(r, v, 0.9501)).tolist()) for i, v in enumerate(base)]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = int((x @ x.T >= 0.95).sum()) - len(rows)
    got = {x.vec_id: x.n_links for x in vector_links(vectors(spark, rows)).collect()}
    assert 0.95 * want <= sum(got.values()) <= want


@pytest.mark.parametrize("strangers", [4, 1e-4])
def test_clumps_count_every_link(spark, monkeypatch, strangers):
    """Groups of near copies and a wide group whose members link in part."""
    monkeypatch.setattr(lattice, "STRANGERS", strangers)
    r = np.random.default_rng(3)
    rows = []
    for g, (n, least) in enumerate([(120, 0.9999), (60, 0.999), (80, 0.985)]):
        c = r.normal(size=64)
        c /= np.linalg.norm(c)
        rows += [(1000 * g + i, cone(r, c, r.uniform(least, 1)).tolist()) for i in range(n)]
    c = r.normal(size=64)
    c /= np.linalg.norm(c)
    d = cone(r, c, np.cos(np.radians(17.5)))
    rows += [(5000 + i, cone(r, c, np.cos(np.radians(r.uniform(0, 2)))).tolist()) for i in range(30)]
    rows += [(6000 + i, cone(r, d, np.cos(np.radians(r.uniform(0, 2)))).tolist()) for i in range(30)]
    links, comp = brute(rows)
    got = {x.vec_id: x for x in vector_links(vectors(spark, rows)).collect()}
    want = sum(map(len, links.values()))
    assert 0.99 * want <= sum(x.n_links for x in got.values()) <= want
    assert all(got[v].n_links <= len(links[i]) for i, (v, _) in enumerate(rows))
    assert all(got[v].component_id == comp[i] for i, (v, _) in enumerate(rows))


def test_vector_edges(spark, monkeypatch):
    monkeypatch.setattr(lattice, "SHARE", 2)
    one = [1.0, 2.0, 3.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (7, one), (8, [2.0, 4.0, 6.0]), (9, [1e300, 2e300, 3e300]), (9, one), (None, one), (10, [1.0, 2.0, 3.0, 0.0]), (11, [-1.0, -2.0, -3.0])]
    got = vector_links(vectors(spark, rows)).collect()
    assert len(got) == len(rows)
    n = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got)
    linked = [x for x in n if x[2]]
    assert linked == [(False, 7, 4, 7, True), (False, 8, 4, 7, False), (False, 9, 4, 7, False), (False, 9, 4, 7, False), (True, 0, 4, 7, False)]
    assert all(x[3] == x[1] and x[4] for x in n if not x[2] and not x[0])
    assert vector_links(vectors(spark, rows).limit(0)).count() == 0


def wide_group(n, seed=5):
    """Vectors around one centre, at about 20 degrees from each other: most meet, some link, none makes a clump."""
    r = np.random.default_rng(seed)
    c = r.normal(size=64)
    c /= np.linalg.norm(c)
    return [(i, (c + 0.032 * r.normal(size=64)).tolist()) for i in range(n)]


def written_rows(spark, monkeypatch, rows):
    """The result and the most rows of any scratch table."""
    from brokerlens.llm.common import Scratch
    most, real = [], Scratch.table

    def table(self, df, by=None):
        out = real(self, df, by)
        most.append(out.count())
        return out
    monkeypatch.setattr(Scratch, "table", table)
    got = {x.vec_id: x for x in vector_links(vectors(spark, rows)).collect()}
    monkeypatch.setattr(Scratch, "table", real)
    return got, max(most)


def test_a_wide_group_writes_no_pairs(spark, monkeypatch):
    per_vector = {}
    for n in (1500, 3000):
        rows = wide_group(n)
        got, most = written_rows(spark, monkeypatch, rows)
        per_vector[n] = most / n
        x = np.array([v for _, v in rows])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        links = (x @ x.T >= 0.95).sum(axis=1) - 1
        assert links.sum() > 20 * n
        found = np.array([got[i].n_links for i in range(n)])
        assert (found <= links).all() and found.sum() >= 0.999 * links.sum()
        assert {got[i].component_id for i in range(n) if links[i]} == {min(i for i in range(n) if links[i])}
    assert max(per_vector.values()) < 50


@pytest.mark.parametrize("block", [7, 1024])
def test_blocks_count_every_link_once(spark, monkeypatch, block):
    """Wide groups of single vectors, copies and clumps, in blocks of a few and of all."""
    monkeypatch.setattr(lattice, "BLOCK", block)
    r = np.random.default_rng(9)
    rows = wide_group(150, 1) + [(1000 + i, v) for i, v in wide_group(60, 2)]
    rows += [(2000 + i, (np.array(rows[i % 20][1]) * r.uniform(1, 3)).tolist()) for i in range(60)]          # copies
    rows += [(3000 + i, cone(r, np.array(rows[3][1]) / np.linalg.norm(rows[3][1]), 0.9995).tolist()) for i in range(25)]
    links, comp = brute(rows)
    got = {x.vec_id: x for x in vector_links(vectors(spark, rows)).collect()}
    want = sum(map(len, links.values()))
    assert 0.995 * want <= sum(x.n_links for x in got.values()) <= want
    assert all(got[v].n_links <= len(links[i]) for i, (v, _) in enumerate(rows))
    assert all(got[v].component_id == comp[i] for i, (v, _) in enumerate(rows))
