"""Embedding near-duplicates by E8 lattice hashing.

A unit vector is projected by random orthonormal rows onto 8 dimensions, scaled, and
decoded to the nearest point of the E8 lattice.  A cell is the lattice points of
one or more such blocks together; there are several tables of cells.  A vector
is filed under its own cell and asks for that cell and for those in which one block's
point is replaced by the nearest of its 240 neighbours.  Two vectors that meet in
any table, and whose random sign sketches do not rule a link out, are verified by
their cosine in double precision.

Growth.  The number of blocks grows with the logarithm of the number of vectors
(``search_plan``), so that the vectors of a cell that have nothing to do with each other
stay a few at every size; the number of tables follows from the blocks and the recall.

Clumps.  Vectors within ``CLUMP_DEGREES`` of a leader are filed as one clump, in two rounds,
first by one table's cells and then by another's.  Members of a clump are
all linked to each other.  Clumps of which members meet are compared through
their leaders and radii, then a member with the other leader, and only where
those leave a doubt are members compared.  So a group of near copies makes a
number of rows in proportion to its size.

Blocks.  Clumps within ``BLOCK_DEGREES`` of a leader are neighbours that may or may
not link; they form blocks of at most ``BLOCK`` clumps, which are filed and ask as one.
Two blocks that meet are compared in one task, as matrices, once: it counts the links of
every clump and passes on the counts and a spanning set of links, never the pairs.  Only
lone clumps, without such neighbours, are compared as rows.  So a wide group, in which most
vectors meet and few are close enough for a clump, makes rows in proportion to its size
times the number of its blocks.

Recall.  There are as many tables as it takes to find a pair at exactly the
least cosine with a probability of ``RECALL`` at every number of blocks, closer pairs more
often (measured in the tests against brute force); links found are exact.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are their own component; vectors of
different length never link; repeated rows are vectors of their own; a null
id takes part in links, but is never kept; an empty table gives no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brokerlens.llm.common import Scratch, documents
from brokerlens.llm.graph import connected_components

COSINE = 0.95
SCALE = 1.5            # of a projected unit vector; at a smaller scale cells hold more of their surroundings
PROBES = 4
RECALL = 0.99          # of pairs at exactly the least cosine
STRANGERS = 4          # unrelated vectors of a cell, at most, on average
TRIALS = 3000          # random pairs on which the plan of the search is measured
CLUMP_DEGREES = 9.0    # at most half the angle of the least cosine: members of a clump all link
CLUMP_SCALE = 1.5      # coarser cells than those of the search
BLOCK_DEGREES = 28.0   # clumps so near a leader are compared in blocks
BLOCK = 1024           # clumps of a block, about
SHARE = 4096           # vectors of a cell that one task clumps, on average
SKETCH_CUT = 36        # of 128 signs: a pair at 0.95 differs in 13 on average, deviation 3.4
SEED = 11


def roots():
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minuses."""
    import itertools
    import numpy as np
    ones = [[(a if k == i else b if k == j else 0) for k in range(8)]
            for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    halves = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array([*ones, *halves], float)


def nearest_point(x):
    """Nearest E8 points of the rows of ``x``: the nearer of the nearest in D8 and in D8 + 1/2."""
    import numpy as np

    def d8(y):
        f = np.rint(y)
        err = y - f
        odd = np.flatnonzero(f.sum(axis=1) % 2)
        k = np.abs(err[odd]).argmax(axis=1)
        f[odd, k] += np.where(err[odd, k] >= 0, 1.0, -1.0)
        return f

    a, b = d8(x), d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(near[:, None], a, b)


def _rng(*key):
    import numpy as np
    return np.random.default_rng([SEED, *key])


def projected(units, table: int, block: int, scale: float):
    """Rows of ``units`` on 8 random orthonormal axes, ``scale`` long on average (shorter rows are padded)."""
    import numpy as np
    if units.shape[1] < 8:
        units = np.pad(units, ((0, 0), (0, 8 - units.shape[1])))
    dim = units.shape[1]
    axes = np.linalg.qr(_rng(1, dim, table, block).normal(size=(dim, 8)))[0]
    return units @ axes * (scale * math.sqrt(dim / 8))


def point_keys(points, table: int, block: int, dim: int):
    """64-bit keys of lattice points (rows of 8 half-integers)."""
    import numpy as np
    odd = _rng(2).integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    twice = np.rint(2 * points).astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        h = (twice * odd).sum(axis=-1, dtype=np.uint64) + np.uint64((table * 1_009 + block) * 1_000_003 + dim)
        for _ in range(2):
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h.view(np.int64)


def cell_keys(units, table: int, blocks: int = 1, scale: float = SCALE):
    """Keys of the rows' own cells: the sum of the keys of their blocks' points."""
    return sum(point_keys(nearest_point(projected(units, table, b, scale)), table, b, units.shape[1]) for b in range(blocks))


def probe_keys(units, table: int, blocks: int = 1, scale: float = SCALE, probes: int = PROBES):
    """Keys of each row's own cell, first, and of the ``probes`` cells nearest to it that differ in one block."""
    import numpy as np
    r, own, gains, steps = roots(), 0, [], []
    for b in range(blocks):
        x = projected(units, table, b, scale)
        c = nearest_point(x)
        gain = (x - c) @ r.T
        best = np.argpartition(-gain, probes, axis=1)[:, :probes]
        here = point_keys(c, table, b, units.shape[1])
        own = own + here
        gains.append(np.take_along_axis(gain, best, axis=1))
        steps.append(point_keys(c[:, None] + r[best], table, b, units.shape[1]) - here[:, None])
    gain, step = np.concatenate(gains, axis=1), np.concatenate(steps, axis=1)
    first = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
    return np.concatenate([own[:, None], own[:, None] + np.take_along_axis(step, first, axis=1)], axis=1)


def search_plan(n: int, dim: int, cosine: float = COSINE, scale: float = SCALE, probes: int = PROBES,
                recall: float = RECALL) -> tuple[int, int]:
    """(blocks, tables) of a search among ``n`` vectors of ``dim`` components.

    Blocks: the fewest with which ``n`` random vectors share a cell with ``STRANGERS`` others at most; tables: the
    fewest that find pairs at exactly ``cosine`` with probability ``recall``.  Both chances are measured on random vectors from
    a fixed seed, so that equal arguments give equal plans."""
    import numpy as np

    def units(rng):
        x = rng.normal(size=(TRIALS, dim))
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    # more components than this do not change the chances
    dim = min(max(dim, 2), 64)
    x, t = units(_rng(4)), units(_rng(5))
    held = np.unique(cell_keys(x, 0, 1, scale), return_counts=True)[1]
    same = max(1.0, float((held * (held - 1)).sum())) / (TRIALS * (TRIALS - 1))
    blocks = 1
    while n * same ** blocks > STRANGERS and same < 0.5 and blocks < dim / 2:
        blocks += 1
    t -= (t * x).sum(axis=1, keepdims=True) * x
    y = cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * t / np.linalg.norm(t, axis=1, keepdims=True)
    found = np.mean([(probe_keys(x, k, blocks, scale, probes) == cell_keys(y, k, blocks, scale)[:, None]).any(axis=1).mean() for k in range(4)])
    found = min(max(float(found), 1 / TRIALS), 0.999)
    return blocks, max(1, math.ceil(math.log(1 - recall) / math.log(1 - found)))


def _by_dimension(column):
    """(row numbers, matrix) for each length among the vectors of an Arrow list column; null
    vectors are left out, null components are NaN."""
    import numpy as np
    import pyarrow.compute as pc
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(column.flatten().cast("float64"), float("nan")).to_numpy(zero_copy_only=False)
    start = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
    for dim in np.unique(length[length >= 0]):
        rows = np.flatnonzero(length == dim)
        yield rows, flat[start[rows][:, None] + np.arange(dim)]


def unit_vectors(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rid, vec_id, unit) of the vectors that can link, and (rid, vec_id) of the others."""
    kind = dict(vectors.dtypes)["vec_id"]

    def scaled(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            units: list = [None] * batch.num_rows
            for rows, x in _by_dimension(batch.column(2)):
                # by the largest component first: no overflow in the squares
                top = np.abs(x).max(axis=1, initial=0.0)
                ok = np.isfinite(top) & (top > 0)
                x = x[ok] / top[ok, None]
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                for r, u in zip(rows[ok], x):
                    units[r] = u
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(units, pa.list_(pa.float64()))],
                                             names=["rid", "vec_id", "unit"])

    rows = scratch.table(vectors.select(F.monotonically_increasing_id().alias("rid"), "vec_id", F.col("embedding"))
                                .mapInArrow(scaled, f"rid long, vec_id {kind}, unit array<double>"))
    return rows.where(F.col("unit").isNotNull()), rows.where(F.col("unit").isNull()).select("rid", "vec_id")


def _clump_round(clumps: DataFrame, table: int, scratch: Scratch, blocks: int, degrees: float = CLUMP_DEGREES) -> DataFrame:
    """(rid, leader, angle): for each of (rid, unit, radius) the leader within ``degrees`` whose clump it joins, itself if none."""
    def keyed(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            keys = np.zeros(batch.num_rows, np.int64)
            for rows, units in _by_dimension(batch.column(1)):
                keys[rows] = cell_keys(units, table, blocks, CLUMP_SCALE)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], names=["rid", "unit", "radius", "cell"])

    cells = scratch.table(clumps.select("rid", "unit", "radius").mapInArrow(keyed, "rid long, unit array<double>, radius double, cell long"))
    large = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARE)
    shares = F.coalesce(F.ceil(F.col("n") / SHARE), F.lit(1)).cast("long")
    dealt = cells.join(large, "cell", "left").withColumn("share", F.pmod(F.xxhash64("rid"), shares)).select(
        "rid", "unit", "radius", "cell", "share")

    def lead(batches):
        import numpy as np
        import pyarrow as pa
        widest, held, leaders, ids = math.radians(degrees), None, None, []
        for batch in batches:
            rid, radius = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            cell, share, unit = batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(1)
            to, angle = [], []
            for i in range(batch.num_rows):
                v = unit[i].values.to_numpy(zero_copy_only=False)
                if (cell[i], share[i], len(v)) != held:
                    held, leaders, ids = (cell[i], share[i], len(v)), np.zeros((4, len(v))), []
                n = len(ids)
                if n:
                    dots = leaders[:n] @ v
                    best = int(dots.argmax())
                    a = math.acos(min(1.0, max(-1.0, float(dots[best]))))
                if n and a + radius[i] <= widest:
                    to.append(ids[best])
                    angle.append(a)
                    continue
                if n == len(leaders):
                    leaders = np.concatenate([leaders, np.zeros_like(leaders)])
                leaders[n] = v
                ids.append(rid[i])
                to.append(rid[i])
                angle.append(0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to, pa.int64()), pa.array(angle, pa.float64())], names=["rid", "leader", "angle"])

    # the widest first: a leader's own radius must not be lost
    led = (dealt.repartition("cell", "share").sortWithinPartitions("cell", "share", F.desc("radius"), "rid")
                .mapInArrow(lead, "rid long, leader long, angle double"))
    out = scratch.table(led)
    scratch.drop(cells)
    return out


def clump(good: DataFrame, scratch: Scratch, blocks: int) -> tuple[DataFrame, DataFrame]:
    """(rid, clump) of every vector, and (rid, unit, radius, n, least) of the clumps by their leader's rid."""
    member = good.select("rid", F.col("rid").alias("clump"))
    clumps = good.select("rid", "unit", F.lit(0.0).alias("radius"), F.lit(1).cast("long").alias("n"), F.col("vec_id").alias("least"))
    for table in (0, 1):
        led = _clump_round(clumps, table, scratch, blocks)
        size = (clumps.select("rid", "radius", "n", "least").join(led, "rid").groupBy("leader")
                      .agg(F.max(F.col("angle") + F.col("radius")).alias("radius"), F.sum("n").alias("n"), F.min("least").alias("least")))
        clumps = scratch.table(clumps.select("rid", "unit").join(size, F.col("rid") == F.col("leader"))
                                     .select("rid", "unit", "radius", "n", "least"))
        member = scratch.table(member.join(led.select(F.col("rid").alias("clump"), "leader"), "clump").select("rid", F.col("leader").alias("clump")))
    return member, clumps


def _blocks(clumps: DataFrame, scratch: Scratch, blocks: int) -> tuple[DataFrame, DataFrame]:
    """(rid, block, solo) of every clump, and (block, unit, radius, solo) of the blocks around their leaders; a solo
    block is a single clump and has its rid."""
    led = _clump_round(clumps.select("rid", "unit", "radius"), 0, scratch, blocks, BLOCK_DEGREES)
    size = led.groupBy("leader").agg(F.count(F.lit(1)).alias("size"))
    dealt = led.join(size, "leader").withColumn("share", F.pmod(F.xxhash64("rid"), F.ceil(F.col("size") / BLOCK).cast("long")))
    dealt = scratch.table(dealt.join(clumps.select("rid", "radius"), "rid"))
    block = scratch.table(dealt.groupBy("leader", "share").agg(F.min("rid").alias("block"), F.max(F.col("angle") + F.col("radius")).alias("radius"),
                                                               F.count(F.lit(1)).alias("n")))
    of = dealt.select("rid", "leader", "share").join(block.select("leader", "share", "block", (F.col("n") == 1).alias("solo")), ["leader", "share"])
    centre = block.join(clumps.select(F.col("rid").alias("leader"), "unit", F.col("radius").alias("own")), "leader")
    # a block of one clump is that clump, around itself
    one = F.col("n") == 1
    lone = clumps.select(F.col("rid").alias("block"), F.col("unit").alias("u1"), F.col("radius").alias("r1"))
    centre = centre.join(lone, "block").select("block", F.when(one, F.col("u1")).otherwise(F.col("unit")).alias("unit"),
                                               F.when(one, F.col("r1")).otherwise(F.col("radius")).alias("radius"), one.alias("solo"))
    return scratch.table(of.select("rid", "block", "solo")), scratch.table(centre)


def near_blocks(member: DataFrame, centres: DataFrame, scratch: Scratch, cosine: float, scale: float, blocks: int,
                tables: int, probes: int) -> DataFrame:
    """(a, b, ra, rb, dot, solo): pairs of blocks, a < b, of which members meet in a table and may link.

    ``member``: (block, unit, lone).  Every member is filed and asks, but under its block: members of one block in one cell
    count once.  Sketches only rule out pairs of lone vectors."""
    def keyed(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            n = batch.num_rows
            keys, signs = np.zeros((n, tables, probes + 1), np.int64), np.zeros((n, 2), np.int64)
            for rows, units in _by_dimension(batch.column(1)):
                for t in range(tables):
                    keys[rows, t] = probe_keys(units, t + 2, blocks, scale, probes)
                bits = np.packbits(units @ _rng(3, units.shape[1]).normal(size=(units.shape[1], 128)) >= 0, axis=1)
                signs[rows] = np.ascontiguousarray(bits).view(np.int64)
            lone = batch.column(2).to_numpy(zero_copy_only=False)
            own = pa.array(list(keys[:, :, 0]), pa.list_(pa.int64()))
            asked = pa.array(list(keys.reshape(n, -1)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(signs[:, i], mask=~lone) for i in (0, 1)], own, asked],
                                             names=["block", "s0", "s1", "own", "asked"])

    k = scratch.table(member.select("block", "unit", "lone").mapInArrow(
        keyed, "block long, s0 long, s1 long, own array<long>, asked array<long>"))
    filed = k.select(F.col("block").alias("b"), F.col("s0").alias("b0"), F.col("s1").alias("b1"), F.explode("own").alias("key")).distinct()
    asked = k.select(F.col("block").alias("a"), F.col("s0").alias("a0"), F.col("s1").alias("a1"), F.explode("asked").alias("key")).distinct()
    differ = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    met = asked.join(filed, (asked["key"] == filed["key"]) & (F.col("a") != F.col("b"))
                     & F.coalesce(differ <= SKETCH_CUT, F.lit(True)))
    pairs = scratch.table(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    left = centres.select(F.col("block").alias("a"), F.col("unit").alias("ua"), F.col("radius").alias("ra"), F.col("solo").alias("sa"))
    right = centres.select(F.col("block").alias("b"), F.col("unit").alias("ub"), F.col("radius").alias("rb"), F.col("solo").alias("sb"))
    widest = math.acos(cosine)
    dot = F.aggregate(F.zip_with("ua", "ub", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    seen = (pairs.join(left, "a").join(right, "b").where(F.size("ua") == F.size("ub"))
                 .select("a", "b", "ra", "rb", dot.alias("dot"), (F.col("sa") & F.col("sb")).alias("solo")))
    apart = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("dot")))) - F.col("ra") - F.col("rb")
    return scratch.table(seen.where((F.col("dot") >= cosine) | (apart <= widest + 1e-9)))


COMPARED = "kind int, a long, b long"


def _compare_blocks(cosine: float):
    """Function over (key, clumps of one block, clumps of another): rows (0, clump, vectors of clumps that link with it whole),
    (1, a, b) for two clumps in doubt, (2, a, b) for links that span all links between whole clumps."""
    def compare(key, left, right):
        import numpy as np
        import pyarrow as pa

        def read(t, end=""):
            unit = t["unit" + end].combine_chunks()
            return (t["rid" + end].to_numpy(), unit.flatten().to_numpy().reshape(len(unit), -1) if len(unit) else np.zeros((0, 1)),
                    t["radius" + end].to_numpy(), t["n" + end].to_numpy())

        (ra, ua, wa, na), (rb, ub, wb, nb) = read(left), read(right, "2")
        own = key[0].as_py() == key[1].as_py()
        widest, eps = math.acos(cosine), 1e-9
        out: list = [[], [], []]

        def add(kind, a, b):
            for held, x in zip(out, (np.full(len(a), kind), a, b)):
                held.append(np.asarray(x, np.int64))

        to_a, to_b = np.zeros(len(ra), np.int64), np.zeros(len(rb), np.int64)
        root = np.arange(len(ra) + len(rb))      # of the links found, for the spanning set

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for at in range(0, len(ra), 512):
            rows = slice(at, at + 512)
            dots = ua[rows] @ ub.T if len(rb) else np.zeros((len(ra[rows]), 0))
            angle = np.arccos(np.clip(dots, -1.0, 1.0))
            width = wa[rows, None] + wb[None, :]
            single = width == 0
            whole = np.where(single, dots >= cosine, angle + width <= widest - eps)
            doubt = ~whole & ~single & (angle - width <= widest + eps)
            if own:      # every pair once, none with itself
                upper = ra[rows, None] < rb[None, :]
                whole, doubt = whole & upper, doubt & upper
            to_a[rows] += whole @ nb
            to_b += na[rows] @ whole
            i, j = np.nonzero(doubt)
            add(1, ra[rows][i], rb[j])
            for i in np.flatnonzero(whole.any(axis=1)):
                linked = np.flatnonzero(whole[i])
                x = top(at + i)
                tops = np.array([top(len(ra) + j) for j in linked])
                _, first = np.unique(tops, return_index=True)
                for f in first[tops[first] != x]:
                    add(2, [ra[at + i]], [rb[linked[f]]])
                    root[tops[f]] = x
        for rid, many in ((ra, to_a), (rb, to_b)):
            some = np.flatnonzero(many)
            add(0, rid[some], many[some])
        kind, a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        return pa.table([pa.array(kind.astype(np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])
    return compare


def compared_blocks(pairs: DataFrame, clumps: DataFrame, cosine: float, scratch: Scratch) -> DataFrame:
    """Rows of ``_compare_blocks`` for the block pairs (a, b); ``clumps``: (rid, block, unit, radius, n)."""
    pairs = scratch.table(pairs)
    left = pairs.join(clumps.select(F.col("block").alias("a"), "rid", "unit", "radius", "n"), "a").groupBy("a", "b")
    # named anew: both sides come from the same tables
    names = [F.col(c).alias(c + "2") for c in ("rid", "unit", "radius", "n")]
    right = pairs.select(F.col("a").alias("a2"), F.col("b").alias("b2")).join(clumps.select(F.col("block").alias("b2"), *names), "b2").groupBy("a2", "b2")
    return scratch.table(left.cogroup(right).applyInArrow(_compare_blocks(cosine), COMPARED))


def vector_links(vectors: DataFrame, cosine: float = COSINE, scale: float = SCALE, recall: float = RECALL,
                 probes: int = PROBES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of (vec_id, embedding)."""
    if 2 * CLUMP_DEGREES >= math.degrees(math.acos(cosine)):
        raise ValueError("CLUMP_DEGREES must be less than half the angle of the least cosine")
    scratch = Scratch(vectors.sparkSession, "lattice")
    good, bad = unit_vectors(vectors, scratch)
    size = good.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("unit")).alias("dim")).first()
    blocks, tables = search_plan(size["n"], size["dim"] or 64, cosine, scale, probes, recall)
    # a clump's surroundings are wider than a link's
    coarse = max(1, blocks - 1)
    member, clumps = clump(good, scratch, coarse)
    of, centres = _blocks(clumps, scratch, coarse)
    in_block = scratch.table(clumps.join(of, "rid"))
    sized = in_block.select(F.col("rid").alias("clump"), "block", ((F.col("n") == 1) & F.col("solo")).alias("lone"))
    placed = scratch.table(good.select("rid", "unit").join(member, "rid").join(sized, "clump"))
    near = near_blocks(placed, centres, scratch, cosine, scale, blocks, tables, probes)
    widest, eps = math.acos(cosine), 1e-9
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("dot"))))
    single = (F.col("ra") == 0) & (F.col("rb") == 0)
    all_ = F.when(single, F.col("dot") >= cosine).otherwise(angle + F.col("ra") + F.col("rb") <= widest - eps)
    lone = scratch.table(near.where("solo").withColumn("all", all_).where(F.col("all") | ~single).select("a", "b", "all"))
    # blocks with themselves and with each other
    wide = near.where(~F.col("solo")).select("a", "b").union(centres.where(~F.col("solo")).select(F.col("block").alias("a"), F.col("block").alias("b")))
    met = compared_blocks(wide, in_block, cosine, scratch)
    n = clumps.select(F.col("rid").alias("b"), F.col("n").alias("n_b"))
    turned = lambda d: d.union(d.select(F.col("b").alias("a"), F.col("a").alias("b")))
    whole = (turned(lone.where("all").select("a", "b")).join(n, "b").select("a", "n_b").union(met.where("kind = 0").select("a", F.col("b").alias("n_b")))
             .groupBy("a").agg(F.sum("n_b").alias("whole")))

    # clumps that may link in part: each member of one against the other's leader, then against its members
    m = placed.select("rid", "clump", "unit")
    doubt = scratch.table(turned(lone.where(~F.col("all")).select("a", "b").union(met.where("kind = 1").select("a", "b"))))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    lead = clumps.select(F.col("rid").alias("b"), F.col("unit").alias("ub"), F.col("radius").alias("rb"), F.col("n").alias("n_b"))
    one = (doubt.join(m.withColumnRenamed("clump", "a"), "a").join(lead, "b")
                .select("a", "b", "rid", "unit", "rb", "n_b", F.acos(F.least(F.lit(1.0), dot("unit", "ub"))).alias("apart")))
    one = one.where(F.col("apart") - F.col("rb") <= widest + eps)
    sure = F.col("apart") + F.col("rb") <= widest - eps
    other = m.select(F.col("clump").alias("b"), F.col("unit").alias("um"))
    tried = one.where(~sure).join(other, "b").where(dot("unit", "um") >= cosine)
    partly = scratch.table(one.where(sure).select("a", "b", "rid", "n_b")
                              .union(tried.groupBy("a", "b", "rid").agg(F.count(F.lit(1)).alias("n_b"))))
    extra = partly.groupBy("rid").agg(F.sum("n_b").alias("extra"))

    edges = lone.where("all").select("a", "b").union(met.where("kind = 2").select("a", "b")).union(partly.select("a", "b"))
    comp = connected_components(edges, scratch)
    rooted = scratch.table(clumps.select("rid", "n", "least").join(comp, F.col("rid") == F.col("node"), "left")
                                 .select("rid", "n", "least", F.coalesce("root", "rid").alias("root"))
                                 .join(whole.withColumnRenamed("a", "rid"), "rid", "left"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_clump = scratch.table(rooted.join(least, "root").select(F.col("rid").alias("clump"), "component_id",
                                                               (F.col("n") - 1 + F.coalesce("whole", F.lit(0))).alias("n0")))
    linked = (good.select("rid", "vec_id").join(member, "rid").join(by_clump, "clump").join(extra, "rid", "left")
                  .select("vec_id", (F.col("n0") + F.coalesce("extra", F.lit(0))).cast("long").alias("n_links"), "component_id"))
    out = linked.union(bad.select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def q_op10(spark, sf_dir: str) -> DataFrame:
    """op10: all embeddings, links at cosine 0.95 or more and their components."""
    return vector_links(documents(spark, sf_dir, "embeddings"))
