"""Line dedup by pairwise alignment.

Each document is a sequence of line hashes (blank lines aside).  Lines that
one document holds are in no common block, so a document falls into the
segments between them; those with fewer than ``MIN_WORDS`` words go no further.
Overlapping segments are found through keys:

- a rare line, one that stands at ``RARE`` places at most over all documents,
  pairs each segment that holds it with the earlier ones;
- lines that stand at more places are made rare by their neighbours: the key
  is the hash of the shortest run of such lines from a given one on that has
  ``MIN_WORDS`` words, and that of the shortest such run up to it.  Every holder
  of a run is paired with the run's first holder only, so the pairs grow with
  the lines, however many documents hold one.

A common block with a rare line is found as a whole through that line.  In any
other block every line lies in a run within the block, so the first holders
of its runs hold all of it.

A pair carries the lines around its keys, as many as the shorter segment can
reach.  They are aligned by patience diff: lines that occur once in both, in their
longest increasing order, widened to equal neighbours, again between and
after those until nothing new aligns; blocks of lines that repeat within
a document are found by their runs.  Common blocks of ``MIN_WORDS`` words or more are
deleted from the later document, the one with the larger id.  The first
holder of a line never loses it.

Defined cases: null and empty texts are left as they are; a null id comes
after all others; rows of equal id and text are one document, which is not
aligned with itself; rows of equal id and other text come in the order of
their text hash; an empty table gives no rows; all other columns pass through,
whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brokerlens.llm.common import Scratch, documents

MIN_WORDS = 50
# places of a line, over all documents, up to which it is a key by itself
RARE = 3
# tasks that the holders of one line or run are dealt to
SALTS = 8


def run_keys(hashes, words, min_words: int = MIN_WORDS):
    """(start, end, key) of the shortest run of ``min_words`` words from each line on, where there is one."""
    import xxhash
    import numpy as np
    raw = np.asarray(hashes, np.int64).tobytes()
    out, end, total = [], 0, 0
    for start in range(len(hashes)):
        while end < len(hashes) and total < min_words:
            total += words[end]
            end += 1
        if total < min_words:
            break
        key = xxhash.xxh64_intdigest(raw[8 * start:8 * end], 7)
        out.append((start, end, key - (1 << 64) if key >> 63 else key))
        total -= words[start]
    return out


def block_keys(hashes, words, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """(start, key) of the shortest runs of ``min_words`` words from each line on and up to each line."""
    import xxhash
    import numpy as np
    raw, n = np.asarray(hashes, np.int64).tobytes(), len(hashes)
    runs = {(start, end) for start, end, _ in run_keys(hashes, words, min_words)}
    runs.update((n - end, n - start) for start, end, _ in run_keys(hashes[::-1], words[::-1], min_words))
    keys = [(start, xxhash.xxh64_intdigest(raw[8 * start:8 * end], 7)) for start, end in runs]
    return [(start, key - (1 << 64) if key >> 63 else key) for start, key in keys]


def segment_keys(hashes, words, frequent, min_words: int = MIN_WORDS) -> dict:
    """{(key, is a rare line): [first, last start]} of a segment's rare lines and runs of frequent lines."""
    found = [((h, True), i) for i, (h, often) in enumerate(zip(hashes, frequent)) if not often]
    at = 0
    for often, run in groupby(frequent):
        end = at + len(list(run))
        if often:
            found += [((key, False), at + i) for i, key in block_keys(hashes[at:end], words[at:end], min_words)]
        at = end
    out: dict = {}
    for key, i in found:
        span = out.setdefault(key, [i, i])
        span[0], span[1] = min(span[0], i), max(span[1], i)
    return out


def _anchors(a, b, open_b):
    """Increasing pairs (i, j) of lines that occur once in ``a`` and once among the open lines of ``b``."""
    once_a, once_b = {}, {}
    for i, h in enumerate(a):
        once_a[h] = -1 if h in once_a else i
    for j in open_b:
        once_b[b[j]] = -1 if b[j] in once_b else j
    pairs = [(j, once_a[h]) for h, j in once_b.items() if j >= 0 and once_a.get(h, -1) >= 0]
    pairs.sort()
    tails, last, back = [], [], [-1] * len(pairs)
    for k, (_, i) in enumerate(pairs):
        at = bisect_left(tails, i)
        back[k] = last[at - 1] if at else -1
        if at == len(tails):
            tails.append(i)
            last.append(k)
        else:
            tails[at], last[at] = i, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append((pairs[k][1], pairs[k][0]))
        k = back[k]
    return out[::-1]


def common_blocks(a, a_words, b, words, min_words: int = MIN_WORDS) -> set[int]:
    """Lines of ``b`` in blocks of ``min_words`` words or more that are aligned with ``a``."""
    gone: set[int] = set()
    open_b = list(range(len(b)))
    while True:
        taken = set()
        for i, j in _anchors(a, b, open_b):
            if j in taken:
                continue
            lo = 0
            while i - lo > 0 and j - lo > 0 and a[i - lo - 1] == b[j - lo - 1]:
                lo += 1
            hi = 1
            while i + hi < len(a) and j + hi < len(b) and a[i + hi] == b[j + hi]:
                hi += 1
            block = range(j - lo, j + hi)
            taken.update(block)
            if sum(words[x] for x in block) >= min_words:
                gone.update(block)
        if not taken:
            break
        open_b = [j for j in open_b if j not in taken]
    # the shortest runs forwards and backwards cover every common block
    held = {key for _, _, key in run_keys(a, a_words, min_words)}
    gone.update(j for start, end, key in run_keys(b, words, min_words) if key in held for j in range(start, end))
    n, held = len(b), {key for _, _, key in run_keys(a[::-1], a_words[::-1], min_words)}
    gone.update(n - 1 - j for start, end, key in run_keys(b[::-1], words[::-1], min_words) if key in held for j in range(start, end))
    return gone


def _text_key():
    return F.xxhash64("text").alias("mark")


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, lines): hash, words and line number of the non-blank lines of each document."""
    kind = dict(docs.dtypes)["doc_id"]

    def lines(batches):
        import pyarrow as pa
        import xxhash
        for batch in batches:
            hashes, words, numbers, ends = [], [], [], [0]
            for text in batch.column(2).to_pylist():
                for i, line in enumerate((text or "").split("\n")):
                    line = line.strip()
                    if line:
                        x = xxhash.xxh64_intdigest(line.encode(), 1)
                        hashes.append(x - (1 << 64) if x >> 63 else x)
                        words.append(len(line.split()))
                        numbers.append(i)
                ends.append(len(hashes))
            fields = pa.StructArray.from_arrays([pa.array(hashes, pa.int64()), pa.array(words, pa.int32()), pa.array(numbers, pa.int32())],
                                                names=["hash", "words", "number"])
            rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows], names=["doc_id", "mark", "lines"])

    return docs.select("doc_id", _text_key(), "text").mapInArrow(
        lines, f"doc_id {kind}, mark long, lines array<struct<hash: long, words: int, number: int>>")


def _meet(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with the one row of ``table`` for their key; the rows of a hot key are dealt to ``SALTS`` tasks.

    Always a sort-merge join: the rows move the same way whatever the input's size."""
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted.hint("merge"), [key, "salt"]).drop("salt")


def shared_segments(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, mark, part, hashes, words, numbers, keys) of the runs of lines, ``min_words`` words at
    least, that other documents hold too; ``part`` is the place of the first line."""
    kind = dict(lines.dtypes)["doc_id"]
    each = lines.select("doc_id", "mark", F.posexplode("lines").alias("at", "line")).select(
        "doc_id", "mark", "at", F.col("line.hash").alias("hash"), F.col("line.words").alias("words"), F.col("line.number").alias("number"))
    holder = F.xxhash64("doc_id", "mark")
    shared = (each.groupBy("hash").agg(F.count(F.lit(1)).alias("places"), F.min(holder).alias("one"), F.max(holder).alias("other"))
                  .where("one <> other").select("hash", (F.col("places") > RARE).alias("frequent")))
    # a set: rows of equal id and text count as one document
    held = _meet(each, shared, "hash").groupBy("doc_id", "mark").agg(
        F.sort_array(F.collect_set(F.struct("at", "hash", "words", "number", "frequent"))).alias("lines"))

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        longs = pa.list_(pa.int64())
        key_type = pa.list_(pa.struct([("key", pa.int64()), ("rare", pa.bool_()), ("lo", pa.int32()), ("hi", pa.int32())]))
        for batch in batches:
            col = batch.column(2)
            at, hashes, words, numbers, frequent = (np.asarray(x.to_numpy(zero_copy_only=False)) for x in col.flatten().flatten())
            ends = np.cumsum([len(x) for x in col])
            breaks = np.flatnonzero(np.diff(at) != 1) + 1
            cuts = np.union1d(np.concatenate([[0], ends]), breaks)
            of = np.searchsorted(ends, cuts[:-1], side="right")
            total = np.concatenate([[0], np.cumsum(words)])
            docs, rows = [], [[], [], [], [], []]
            for doc, a, b in zip(of, cuts[:-1], cuts[1:]):
                if total[b] - total[a] < min_words:
                    continue
                h, w = hashes[a:b].tolist(), words[a:b].tolist()
                keys = segment_keys(h, w, frequent[a:b].tolist(), min_words)
                docs.append(doc)
                for out, x in zip(rows, (int(at[a]), h, w, numbers[a:b],
                                         [{"key": k, "rare": rare, "lo": lo, "hi": hi} for (k, rare), (lo, hi) in keys.items()])):
                    out.append(x)
            take = pa.array(docs, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(rows[0], pa.int32()),
                 *[pa.array(x, longs) for x in rows[1:4]], pa.array(rows[4], key_type)],
                names=["doc_id", "mark", "part", "hashes", "words", "numbers", "keys"])

    return held.mapInArrow(cut, f"doc_id {kind}, mark long, part int, hashes array<long>, words array<long>, numbers array<long>, "
                                "keys array<struct<key: long, rare: boolean, lo: int, hi: int>>")


def overlapping(segments: DataFrame) -> DataFrame:
    """(a, b, low, high): segments ``b`` that share keys with an earlier document's segment ``a``, and the
    least and largest distance of a key's places in them."""
    seg = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "part", F.size("hashes").alias("n"))
    keys = segments.select("doc_id", "mark", seg.alias("seg"), F.explode("keys").alias("k")).select("doc_id", "mark", "seg", "k.*")
    holder = F.struct("seg", "lo", "hi")
    # a rare line has RARE holders at most
    rare = keys.where("rare").groupBy("key").agg(F.sort_array(F.collect_list(holder)).alias("held"))
    rare = rare.select(F.explode(F.flatten(F.transform("held", lambda b, i: F.transform(
        F.slice("held", 1, i), lambda a: F.struct(a.alias("a"), b.alias("b")))))).alias("p")).select("p.a", "p.b")
    runs = keys.where("NOT rare")
    first = runs.groupBy("key").agg(F.min(holder).alias("a"), F.count(F.lit(1)).alias("holders")).where("holders > 1").drop("holders")
    runs = _meet(runs, first, "key").select("a", holder.alias("b"))
    other = ~(F.col("a.seg.doc_id").eqNullSafe(F.col("b.seg.doc_id")) & (F.col("a.seg.mark") == F.col("b.seg.mark")))
    return (rare.unionByName(runs).where(other).groupBy(F.col("a.seg").alias("a"), F.col("b.seg").alias("b"))
                .agg(F.min(F.col("a.lo") - F.col("b.hi")).alias("low"), F.max(F.col("a.hi") - F.col("b.lo")).alias("high")))


def duplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, mark, gone, earlier) of the documents that lose lines: the numbers of those lines,
    and the ids of the earlier documents that hold them."""
    scratch = Scratch(docs.sparkSession, "lines")
    kind = dict(docs.dtypes)["doc_id"]
    lines = scratch.table(document_lines(docs))
    segments = scratch.table(shared_segments(lines, min_words))
    pairs = scratch.table(overlapping(segments))

    def around(side, start, end, *columns):
        """``pairs`` with the lines of that side from ``start`` to ``end``."""
        s = segments.select(F.col("doc_id").alias("i"), F.col("mark").alias("m"), F.col("part").alias("at"), *columns)
        met = lambda p: p.join(s.hint("merge"), F.col(f"{side}.doc_id").eqNullSafe(F.col("i"))
                               & (F.col(f"{side}.mark") == F.col("m")) & (F.col(f"{side}.part") == F.col("at")))
        cut = [F.slice(c, start + 1, end - start).alias(f"{side}_{c}") for c in columns]
        return lambda p: met(p).select(*[c for c in p.columns], *cut)

    low, high, zero = F.col("low"), F.col("high"), F.lit(0)
    later = around("b", F.greatest(zero, -high), F.least(F.col("b.n"), F.col("a.n") - low), "hashes", "words", "numbers")
    earlier = around("a", F.greatest(zero, low), F.least(F.col("a.n"), F.col("b.n") + high), "hashes", "words")
    joined = earlier(later(pairs)).select("b.doc_id", "b.mark", F.col("a.doc_id").alias("first_id"),
                                          "b_hashes", "b_words", "b_numbers", "a_hashes", "a_words")

    def align(batches):
        import pyarrow as pa
        for batch in batches:
            col = [batch.column(i) for i in range(8)]
            gone = []
            for i in range(batch.num_rows):
                h, w, n, ah, aw = (col[k][i].as_py() for k in range(3, 8))
                gone.append([n[j] for j in sorted(common_blocks(ah, aw, h, w, min_words))])
            yield pa.RecordBatch.from_arrays([*col[:3], pa.array(gone, pa.list_(pa.int64()))], names=["doc_id", "mark", "first_id", "gone"])

    found = scratch.table(joined.mapInArrow(align, f"doc_id {kind}, mark long, first_id {kind}, gone array<long>"))
    out = scratch.table(found.select("doc_id", "mark", "first_id", F.explode("gone").alias("line")).groupBy("doc_id", "mark")
                             .agg(F.sort_array(F.collect_set("line")).alias("gone"), F.sort_array(F.collect_set("first_id")).alias("earlier")))
    scratch.drop(lines, segments, pairs, found)
    return out


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, report: bool = False) -> DataFrame:
    """The documents without the lines they share with an earlier one, all columns.

    A document of which only white space is left goes.  With ``report`` all documents stay, as
    (doc_id, text, gone, earlier)."""
    gone = duplicate_lines(docs, min_words)
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    d = docs.select(whole_row, F.col("doc_id").alias("id"), F.col("text").alias("old"), _text_key()).alias("d")
    # always a sort-merge join: the texts move the same way whatever the input's size
    j = d.join(gone.alias("g").hint("merge"), F.col("d.id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.mark") == F.col("g.mark")), "left")
    # only changed texts are taken apart
    j = j.select("d.doc", "d.id", "d.old", "g.gone", "g.earlier",
                 F.when(F.col("g.gone").isNotNull(), F.split("d.old", "\n")).alias("lines"))
    numbers = F.array_except(F.sequence(F.lit(0).cast("long"), F.size("lines").cast("long") - 1), F.col("gone"))
    left = F.array_join(F.transform(numbers, lambda i: F.col("lines")[i.cast("int")]), "\n")
    j = j.select("doc", "id", "old", "gone", "earlier", F.when(F.col("gone").isNotNull(), left).alias("new"))
    text = F.when(F.col("gone").isNull(), F.col("old")).otherwise(F.col("new"))
    if report:
        empty = F.expr("CAST(array() AS array<long>)")
        return j.select(F.col("id").alias("doc_id"), text.alias("text"), F.coalesce("gone", empty).alias("gone"), F.col("earlier"))
    kept = j.where(F.col("gone").isNull() | (F.length(F.trim(F.regexp_replace("new", r"\s+", " "))) > 0))
    return kept.select(*[(text if c == "text" else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def q_op8(spark, sf_dir: str) -> DataFrame:
    """op8: all documents without the blocks of lines of 50 words or more that an earlier document holds."""
    d = dedup_lines(documents(spark, sf_dir), report=True)
    return d.select("doc_id", "text", F.size("gone").alias("n_gone"), F.col("gone").alias("gone_lines"), "earlier")
