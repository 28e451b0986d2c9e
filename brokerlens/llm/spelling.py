"""Spelling variants on a bit-sliced position index.

Words are near if they differ by exactly one inserted, deleted or replaced
character.  The index holds, for every (position, letter), a bitset over the
vocabulary: the words with that letter there.  A query word walks over its
letters and keeps four sets of 64 words at a time: those that agree so far,
those with one letter replaced, and, by the bitsets of the next and of the
previous position, those with one letter more or one less.

One index over all words would cost the square of their number, so words are
filed in blocks by what an edit leaves alone.  In the class of the shorter
length L of a pair, the edit lies in the first or in the second half of the
positions; all letters outside that window are equal and make the block's key,
and only the window's letters go into the block's index.  A word of m letters is
filed in the classes m and m - 1.  A block of more than ``CROWD`` words is filed
again with its window halved, down to one position, where a block holds no more
words than there are letters, or pairs of letters.  A pair is counted in the one
block whose window holds the length of the words' common beginning, so that
counts add up over blocks without any list of pairs.

Defined cases: a null or empty text has no words; a null doc_id counts as an
empty string in the hash of a run; repeated rows count again; an empty table
gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brokerlens.llm.common import Scratch, batches_by_bytes, documents, parts

SHORTEST = 5         # code points of a word
LEAST = 3            # occurrences of a word
DROP_EVERY = 97      # runs whose hash this divides lose a letter
CROWD = 4096         # words of a block, unless its window is one position
LANES = 1 << 20      # 64-word lanes that a task works on at once
CELLS = 1 << 23      # bitsets that a task holds at once


# ---- the vocabulary --------------------------------------------------------------------------------
def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, drop_every: int = DROP_EVERY) -> DataFrame:
    """(word, n): the words of all texts with their occurrences.

    Words are the maximal runs ``[A-Za-z\\u00C0-\\u00FF]+``, A-Z lower-cased; a run whose crc32 of
    ``<doc_id>:<run>`` is divisible by ``drop_every`` loses the letter at that hash modulo its length."""
    batches_by_bytes(docs.sparkSession)

    def count(batches):
        import re
        from collections import Counter
        from operator import itemgetter
        from zlib import crc32

        import pyarrow as pa
        runs, whole = re.compile("[a-zÀ-ÿ]+").finditer, itemgetter(0)
        for batch in batches:
            total: Counter = Counter()
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                low = text.as_buffer().to_pybytes().lower().decode()
                start = crc32(f"{doc_id}:".encode())
                for run, n in Counter(map(whole, runs(low))).items():
                    h = crc32(run.encode(), start)
                    if h % drop_every == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                    if len(run) >= shortest:
                        total[run] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id")
    found = docs.where("text IS NOT NULL").select(ids, "text").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# ---- blocks ----------------------------------------------------------------------------------------
def _filed(words: DataFrame) -> DataFrame:
    """Add (key, core, width) to (word, n, short, lo, hi): ``short`` is the class, the window is [lo, hi)."""
    tail = F.col("short") - F.col("hi")
    size = F.length("word")
    core = F.substring("word", F.col("lo") + 1, size - tail - F.col("lo"))
    key = F.concat_ws(":", "short", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), F.substring("word", size - tail + 1, tail))
    return words.select("word", "n", "short", "lo", "hi", key.alias("key"), core.alias("core"))


def _halved(rows: DataFrame) -> DataFrame:
    """(word, n, short, lo, hi) for both halves of every row's window."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.explode(F.array(F.struct("lo", mid.alias("hi")), F.struct(mid.alias("lo"), "hi"))).alias("w")
    return rows.select("word", "n", "short", halves).select("word", "n", "short", "w.lo", "w.hi")


def blocks(vocab: DataFrame, scratch: Scratch, shortest: int, crowd: int) -> DataFrame:
    """All words in their blocks, none above ``crowd`` words but those with a window of one position."""
    classes = vocab.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("short")).where(F.col("short") >= shortest)
    rows = _filed(_halved(classes.withColumn("lo", F.lit(0)).withColumn("hi", F.col("short"))))
    done = None
    while True:
        crowded = scratch.table(rows.where("hi - lo > 1").groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > crowd).select("key"))
        if crowded.isEmpty():
            return rows if done is None else done.union(rows)
        fine = rows.join(crowded, "key", "left_anti").select(*rows.columns)
        done = fine if done is None else done.union(fine)
        rows = _filed(_halved(scratch.table(rows.join(crowded, "key", "left_semi").select("word", "n", "short", "lo", "hi"))))


# ---- the index of a block, and all its words as queries -------------------------------------------
def _near_in_blocks():
    """Function over batches of (key, word, n, core, width, ends), sorted by width and key, the words of a block by
    falling n and then by word: (word, near, n_best, best) for the words with near words in their block."""

    def search(codes, length, block, ends, width):
        """Near words of each row and the first of them, among the rows of its block (-1: none).

        ``codes``: letters (row, position), 0 beyond the word's ``length`` (width or width + 1)."""
        import numpy as np
        n = len(codes)
        size = np.bincount(block)
        begin = np.cumsum(size) - size
        segments = (size + 63) // 64
        base = np.cumsum(segments) - segments
        inside = np.arange(n) - begin[block]
        segment, bit = base[block] + inside // 64, np.uint64(1) << (inside % 64).astype(np.uint64)
        letters = int(codes.max()) + 1
        slices = np.zeros((int(segments.sum()), width + 1, letters), np.uint64)
        for i in range(width + 1):
            np.bitwise_or.at(slices, (segment, i, codes[:, i]), bit)
        slices[:, :, 0] = 0
        same, longer = (np.zeros(len(slices), np.uint64) for _ in range(2))
        for mask, rows in ((same, length == width), (longer, length > width)):
            np.bitwise_or.at(mask, segment[rows], bit[rows])

        count = segments[block]                    # lanes of each row
        start = np.cumsum(count) - count
        q = np.repeat(np.arange(n), count)
        lane = np.repeat(base[block] - start, count) + np.arange(len(q))
        agree = (same | longer)[lane]
        replaced, more, less = (np.zeros(len(q), np.uint64) for _ in range(3))
        for i in range(width):
            c = codes[q, i]
            here = slices[lane, i, c]
            less = agree | (less & slices[lane, i - 1, c]) if i else agree.copy()
            replaced = (replaced & here) | (agree & ~here)
            more = (more | agree) & slices[lane, i + 1, c]
            agree = agree & here
        short = (length == width)[q]
        far = ends[block][q]                       # the window reaches the words' end
        over = np.where(far, agree, np.uint64(0))  # one letter more at the very end
        of_short = (replaced & same[lane]) | ((np.where(far, more, more & ~agree) | over) & longer[lane])
        last = agree | (less & slices[lane, width - 1, codes[q, width]])
        of_long = np.where(far, last, last & ~agree) & same[lane]
        near = np.where(short, of_short, of_long)
        many = np.add.reduceat(np.bitwise_count(near).astype(np.int64), start)
        low = np.bitwise_count((near & (~near + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        nth = np.where(near != 0, (lane - base[block][q]) * 64 + low, n)
        first = np.minimum.reduceat(nth, start)
        return many, np.where(first < n, begin[block] + first, -1)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def solve(t):
            """All blocks of a table with one width."""
            width = t["width"][0].as_py()
            cores = t["core"].to_pylist()
            codes = np.zeros((len(cores), width + 1), np.uint8)
            for i, c in enumerate(cores):
                codes[i, :len(c)] = np.frombuffer(c.encode("latin-1"), np.uint8)
            used = np.unique(codes)
            number = np.zeros(256, np.int64)
            rank = used[used > 0]
            number[rank] = np.arange(1, len(rank) + 1)
            codes = number[codes]
            keys = t["key"].combine_chunks().dictionary_encode()
            block, length = keys.indices.to_numpy(), np.array([len(c) for c in cores])
            ends = np.zeros(len(keys.dictionary), bool)
            ends[block] = t["ends"].to_numpy()
            size = np.bincount(block)
            lanes = np.cumsum(size * ((size + 63) // 64))
            cells = np.cumsum(((size + 63) // 64) * (width + 1) * (len(rank) + 1))
            word, n = t["word"].combine_chunks(), t["n"].combine_chunks()
            bounds, b0 = np.cumsum(size), 0
            while b0 < len(size):
                before = (lanes[b0 - 1], cells[b0 - 1], bounds[b0 - 1]) if b0 else (0, 0, 0)
                b1 = max(b0 + 1, min(int(np.searchsorted(lanes, before[0] + LANES, "right")), int(np.searchsorted(cells, before[1] + CELLS, "right"))))
                r0, r1 = int(before[2]), int(bounds[b1 - 1])
                many, best = search(codes[r0:r1], length[r0:r1], block[r0:r1] - b0, ends[b0:b1], width)
                rows = np.flatnonzero(many > 0)
                if len(rows):
                    there, best = pa.array(rows + r0), pa.array(best[rows] + r0)
                    yield pa.RecordBatch.from_arrays([word.take(there), pa.array(many[rows], pa.int64()), n.take(best), word.take(best)],
                                                     names=["word", "near", "n_best", "best"])
                b0 = b1

        def whole(t):
            """Tables of one width each from a table of whole blocks; blocks of a single word have nothing to find."""
            width = t["width"].to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(width[1:] != width[:-1]) + 1, [len(width)]])
            for a, b in zip(cut, cut[1:]):
                part = t.slice(a, b - a)
                block = part["key"].combine_chunks().dictionary_encode().indices.to_numpy()
                part = part.filter(pa.array(np.bincount(block)[block] > 1))
                if part.num_rows:
                    yield from solve(part)

        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            # the last block may go on in the next batch
            key = t["key"].combine_chunks().dictionary_encode().indices.to_numpy()
            other = np.flatnonzero(key != key[-1])
            end = int(other[-1]) + 1 if len(other) else 0
            held = t.slice(end)
            if end:
                yield from whole(t.slice(0, end))
        if held is not None and held.num_rows:
            yield from whole(held)

    return run


def near_words(vocab: DataFrame, scratch: Scratch, shortest: int = SHORTEST, crowd: int = CROWD) -> DataFrame:
    """(word, n_near, best, n_best) of the words of ``vocab`` (word, n) that have near words; ``best`` is the near
    word of largest n, the first in code-point order among equal ones."""
    filed = blocks(vocab, scratch, shortest, crowd)
    rows = filed.select("key", "word", "n", "core", (F.col("hi") - F.col("lo")).alias("width"), (F.col("hi") == F.col("short")).alias("ends"))
    rows = rows.repartition(parts(vocab.sparkSession), "key").sortWithinPartitions("width", "key", F.desc("n"), "word")
    found = rows.mapInArrow(_near_in_blocks(), "word string, near long, n_best long, best string")
    best = F.min(F.struct((-F.col("n_best")).alias("m"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", "b.best", (-F.col("b.m")).alias("n_best"))


def group_variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, ratio: int = 2, drop_every: int = DROP_EVERY,
                   crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word.  ``form``: the near word of largest n, if that is at least
    ``ratio`` times the word's own n; ``root``: the last word along forms."""
    scratch = Scratch(docs.sparkSession, "spelling")
    vocab = scratch.table(vocabulary(docs, shortest, least, drop_every))
    near = scratch.table(near_words(vocab, scratch, shortest, crowd))
    form = F.when(F.col("n_best") >= F.col("n") * F.lit(ratio), F.col("best"))
    formed = scratch.table(vocab.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                                  form.alias("form"), F.when(form.isNotNull(), F.col("n_best")).alias("form_n")))
    # forms at least double n, so that a chain is short; each round doubles the way that is known
    way = scratch.table(formed.where("form IS NOT NULL").select("word", F.col("form").alias("to")))
    while True:
        on = way.select(F.col("word").alias("to"), F.col("to").alias("next"))
        longer = scratch.table(way.join(on, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(way)
        way = longer
        if way.where("moved").isEmpty():
            break
        way = way.drop("moved")
        way._scratch_path = longer._scratch_path
    return formed.join(way.select("word", "to"), "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def q_op11(spark, sf_dir: str) -> DataFrame:
    """op11: spelling variants among the words of all documents."""
    return group_variants(documents(spark, sf_dir))
