"""SimHash near-duplicates by segment-popcount embedding.

A document's fingerprint is the bitwise majority of the hashes of its word
shingles.  Fingerprints are embedded as the counts of set bits in their
16 segments of 4 bits: flipping one bit moves one count by one, so the
Manhattan distance of two embeddings is a lower bound of the Hamming
distance.  The grid range-join puts every fingerprint into its own grid
point and the points at Manhattan distance 1; two embeddings at distance 2
or less always share such a point.  The fingerprints of a point are then
verified exactly.  Links are kept as a spanning set per point, never as all
pairs: the number of rows stays in proportion to the fingerprints.

A point with more than ``CROWD`` fingerprints goes on to the same join with
64 segments of one bit, where fingerprints that share a point differ in at
most two bits, so that one aggregate links them, at any size.

Defined cases: null, empty and word-free texts have fingerprint zero, which
links like any other; repeated rows share fingerprint and component; a null
id takes part but is never a component's smallest id unless all are null; an
empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brokerlens.llm.common import Scratch, documents, parts
from brokerlens.llm.graph import connected_components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
CROWD = 2048        # fingerprints of a grid point that are compared in one task
SEGMENTS = 16       # of 4 bits each


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, mark: Column | None = None) -> DataFrame:
    """(doc_id, fp[, mark]): the 64-bit fingerprint (as a signed long) of every document row; ``mark`` passes through."""
    kind, marked = dict(docs.dtypes)["doc_id"], mark is not None

    def majority(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash
        digest, block = xxhash.xxh64_intdigest, 1 << 16

        def shingles(words):
            if len(words) < shingle:
                yield b" ".join(words)
                return
            for z in zip(*[words[i:] for i in range(shingle)]):
                yield b" ".join(z)

        def fp(data: bytes) -> int:
            words = data.lower().split()          # bytes: A-Z and [\x20\x09-\x0D] only
            if not words:
                return 0
            n = max(1, len(words) - shingle + 1)
            h = np.fromiter((digest(s, seed) for s in shingles(words)), np.uint64, n)
            ones = np.zeros(64, np.int64)
            for i in range(0, n, block):
                bits = np.unpackbits(h[i:i + block].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                ones += bits.sum(axis=0, dtype=np.int64)
            return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)

        for batch in batches:
            data = batch.column(1)
            out = [fp(data[i].as_py() or b"") for i in range(len(data))]
            more = [batch.column(2)] if marked else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64()), *more], names=["doc_id", "fp", "mark"][:2 + len(more)])

    more = [mark.alias("mark")] if marked else []
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), *more).mapInArrow(
        majority, f"doc_id {kind}, fp long" + ", mark long" * len(more))


def popcounts(fp: Column) -> Column:
    """The 16 segments' counts of set bits, one per 4-bit field of a long (each at most 4: no carry)."""
    ones = F.lit(0x1111111111111111)
    out = fp.bitwiseAND(ones)
    for k in (1, 2, 3):
        out = out + F.shiftrightunsigned(fp, k).bitwiseAND(ones)
    return out


def grid_points(counts: Column) -> Column:
    """The grid point of an embedding and those at Manhattan distance 1 (a count leaves 0..4 nowhere)."""
    near = [counts]
    for j in range(SEGMENTS):
        one = F.lit(1 << (4 * j))
        field = F.shiftrightunsigned(counts, 4 * j).bitwiseAND(F.lit(15))
        near += [F.when(field < 4, counts + one), F.when(field > 0, counts - one)]
    return F.array_compact(F.array(*near))


def _link_runs(max_bits: int):
    """Function over batches of (point, fp), sorted by both: rows (a, b) that span the links of each
    point, and (fp, null) for the members of a crowded point."""

    def spanning(fps):
        import numpy as np
        left = np.ones(len(fps), bool)
        a, b = [], []
        for i in range(len(fps)):
            if not left[i]:
                continue
            left[i] = False
            todo = [i]
            while todo:
                k = todo.pop()
                near = np.flatnonzero(left & (np.bitwise_count(fps ^ fps[k]) <= max_bits))
                left[near] = False
                todo += near.tolist()
                a += [fps[k]] * len(near)
                b += fps[near].tolist()
        return a, b

    def run(batches):
        import numpy as np
        import pyarrow as pa
        point, held, crowded = None, [], False

        def out(a, b):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.uint64).view(np.int64)), b], names=["a", "b"])

        def flush():
            fps = np.concatenate(held) if held else np.zeros(0, np.uint64)
            if len(fps) > 1:
                a, b = spanning(fps)
                if a:
                    yield out(a, pa.array(np.asarray(b, np.uint64).view(np.int64)))

        for batch in batches:
            pts = batch.column(0).to_numpy()
            fps = batch.column(1).to_numpy().view(np.uint64)
            if not len(pts):
                continue
            cut = np.concatenate([[0], np.flatnonzero(pts[1:] != pts[:-1]) + 1, [len(pts)]])
            size = np.diff(cut)
            last = len(size) - 1
            for r in sorted({0, last, *np.flatnonzero(size > 1).tolist()}):
                part = fps[cut[r]:cut[r + 1]]
                if point is None or pts[cut[r]] != point:
                    if not crowded:
                        yield from flush()
                    point, held, crowded = pts[cut[r]], [], False
                held.append(part)
                if crowded or sum(map(len, held)) > CROWD:
                    crowded = True
                    gone = np.concatenate(held)
                    held = []
                    yield out(gone, pa.nulls(len(gone), pa.int64()))
        if not crowded:
            yield from flush()

    return run


def links(fps: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fps`` (fp) at ``max_bits`` or fewer differing
    bits that span all such links."""
    if max_bits != 2:
        raise ValueError("max_bits must be 2: both sides of the join reach out by Manhattan distance 1")
    spark = fps.sparkSession
    pts = fps.select(F.explode(grid_points(popcounts(F.col("fp")))).alias("point"), "fp")
    found = scratch.table(pts.repartition(parts(spark), "point").sortWithinPartitions("point", "fp")
                             .mapInArrow(_link_runs(max_bits), "a long, b long"))
    crowd = found.where(F.col("b").isNull()).select(F.col("a").alias("fp")).distinct()
    # one-bit segments: the fingerprint itself and each with one bit flipped
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), j)) for j in range(64)]
    flat = scratch.table(crowd.select("fp", F.explode(F.array(*flips)).alias("point")))
    first = scratch.table(flat.groupBy("point").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("point", "b"))
    stars = flat.join(first, "point").select(F.col("fp").alias("a"), "b")
    return found.where(F.col("b").isNotNull()).union(stars).where(F.col("a") != F.col("b")).distinct()


def _by_fingerprint(rows: DataFrame, scratch: Scratch, max_bits: int) -> DataFrame:
    """(fp, root, component_id) of the distinct fingerprints of ``rows`` (doc_id, fp)."""
    fps = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comp = connected_components(links(fps.select("fp"), scratch, max_bits), scratch)
    rooted = scratch.table(fps.join(comp, F.col("fp") == F.col("node"), "left")
                              .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = scratch.table(rooted.join(least, "root").select("fp", "root", "component_id"))
    scratch.drop(fps, rooted)
    return by_fp


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id) per document row; ``component_id`` is the smallest doc_id reachable
    over links of ``max_bits`` or fewer differing bits."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(fingerprints(docs, shingle, seed))
    by_fp = _by_fingerprint(rows, scratch, max_bits)
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """The documents with all but one of each component gone, all columns.

    The one with the smallest id stays (a null id after all others, equal ids by the hash of their text);
    rows of equal id and text count as one."""
    scratch = Scratch(docs.sparkSession, "simhash")
    mark = F.xxhash64("text")
    rows = scratch.table(fingerprints(docs, shingle, seed, mark))
    by_fp = _by_fingerprint(rows, scratch, max_bits)
    placed = rows.join(by_fp.select("fp", "root"), "fp").select("root", "doc_id", "mark")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    first = scratch.table(placed.groupBy("root").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
                                .select("root", F.col("f.doc_id").alias("first_id"), F.col("f.mark").alias("first_mark")))
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark"))
    grouped = placed.join(first, "root")
    gone = scratch.table(grouped.where(~same).select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct())
    again = scratch.table(grouped.where(same).groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                                 .select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")))
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    on = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("mark") == F.col("gone_mark"))
    kept = docs.select(whole_row, F.col("doc_id").alias("id"), mark.alias("mark")).join(gone.hint("merge"), on, "left_anti")
    if not again.isEmpty():
        # repeated rows of a kept document: one of them stays
        repeated = kept.join(again, on, "left_semi").dropDuplicates(["id", "mark"])
        kept = kept.join(again, on, "left_anti").union(repeated)
    return kept.select("doc.*")


def q_op7(spark, sf_dir: str) -> DataFrame:
    """op7: SimHash fingerprints of all documents, 3-word shingles, components at 2 or fewer differing bits."""
    found = simhash_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
