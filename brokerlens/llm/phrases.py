"""Phrase collocations by dynamic itemset counting.

The pieces of all texts are dealt into ``SHARDS`` shards, which are scanned in
a cycle, one shard a step.  Words are counted from step 0.  A longer phrase
becomes active after the step in which the second of its two subphrases (all
words but the last, all but the first) reaches the threshold, and is counted
for one full cycle from then on, so every shard once: its count is exact.
Lengths are so interleaved in one cyclic scan; it ends when the last activated
phrase has had its cycle.

What a task must know to decide whether it counts a phrase is the step in which
each subphrase reached the threshold.  It gets this as an array of fixed size,
``SLOTS`` bytes, addressed by a hash of the subphrase.  Two phrases in one slot
share the earlier step, which at most activates phrases too early or in vain:
activation is a function of the phrase alone and never changes later, so any
activated phrase is still counted for exactly one full cycle.  Within a task
phrases are counted by the exact numbers of their words, between tasks by the
phrases themselves.

Defined cases: a null text is empty; a null lang is ``und`` (and joins a lang of
that name); texts without words add nothing; repeated rows count again; an empty
table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brokerlens.llm.common import Scratch, documents

THRESHOLD = 30
LONGEST = 4
SHARDS = 3
SLOTS = 1 << 24          # one byte each
FLUSH_BYTES = 16 << 20   # of text that a task holds before it sums up its words
NEVER = 255              # slot of phrases that have not reached the threshold

COUNTED = "key string, a long, state long"
# of a row's ``state``: the slot, above it the start, above that the number of words
SLOT_BITS, START_BITS = 32, 8


def dealt(docs: DataFrame, scratch: Scratch, shards: int) -> DataFrame:
    """(lang, text, shard): the texts, written in ``shards`` parts by the hash of id and text."""
    d = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"))
    return scratch.table(d.where("text IS NOT NULL"), by="shard")


def _counter(step: int, cycle: int, longest: int, reached, slots: int):
    """Function over batches of (lang, text): rows of ``COUNTED`` for the phrases active in this step.

    ``reached`` holds, compressed, the step in which the phrases of each slot reached the threshold.
    A row's key is the phrase, a line feed (which no word holds) and the lang."""

    def count(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import xxhash

        # breaks become a byte that no UTF-8 text holds, as a word of its own
        breaks, gap = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" "), b"\xff"
        at_step = np.frombuffer(zlib.decompress(reached.value), np.uint8)
        mask = np.uint64(slots - 1)
        held, size = {}, 0

        def numbered(text):
            """The distinct words of a text, and its words as numbers among them."""
            raw = np.frombuffer(text, np.uint8)
            space = raw == 32
            end = np.flatnonzero(space)
            length = np.diff(end, prepend=-1) - 1
            ends = np.cumsum(length[length > 0])
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [
                None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(raw[~space])])
            coded = words.dictionary_encode()
            return coded.dictionary, coded.indices.to_numpy().astype(np.int64)

        def joined(left, right):
            h = left * np.uint64(0x9E3779B97F4A7C15) + right
            return h ^ (h >> np.uint64(29))

        def steps_of(hashes):
            return at_step[hashes & mask].astype(np.int64)

        def rows(lang, words, seq):
            """Counts of the active phrases of one lang: ``seq`` has the numbers of its words."""
            names = words.to_pylist()
            none = names.index(gap)
            times = np.bincount(seq, minlength=len(names))
            times[none] = 0
            there = np.flatnonzero(times)
            seed = xxhash.xxh32_intdigest(lang)
            own = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in names), np.uint64, len(names))
            if step < cycle:
                yield out(lang, words.take(pa.array(there)), 1, times[there], np.zeros(len(there), np.int64), own[there])
                yield out(lang, pa.array([b""], pa.large_binary()), 0, times.sum(keepdims=True), np.zeros(1, np.int64), own[:1])
            when_word = steps_of(own)
            when_word[none] = NEVER
            # places whose first n - 1 words have reached the threshold: position, hash, step
            pos = np.flatnonzero((when_word != NEVER)[seq])
            hashes, when = own[seq[pos]], when_word[seq[pos]]
            for n in range(2, longest + 1):
                side = np.flatnonzero(pos[1:] == pos[:-1] + 1)
                pos, start, hashes = pos[side], np.maximum(when[side], when[side + 1]) + 1, joined(hashes[side], own[seq[pos[side] + n - 1]])
                now = np.flatnonzero((start <= step) & (step < start + cycle))
                if len(now):
                    # the exact number of the first words, and the last word's
                    key = seq[pos[now]]
                    for k in range(1, n - 1):
                        key = np.unique(key * len(words) + seq[pos[now] + k], return_inverse=True)[1]
                    key = key * len(words) + seq[pos[now] + n - 1]
                    if n == 2:
                        key, many = np.unique(key, return_counts=True)
                        parts = list(divmod(key, len(words)))
                        starts = np.maximum(when_word[parts[0]], when_word[parts[1]]) + 1
                        back = joined(own[parts[0]], own[parts[1]])
                    else:
                        _, first, many = np.unique(key, return_index=True, return_counts=True)
                        first = now[first]
                        parts = [seq[pos[first] + k] for k in range(n)]
                        starts, back = start[first], hashes[first]
                    yield out(lang, pc.binary_join_element_wise(*[words.take(pa.array(x)) for x in parts], pa.scalar(b" ", pa.large_binary())), n, many, starts, back)
                when = steps_of(hashes)
                frequent = np.flatnonzero(when != NEVER)
                when = np.maximum(when, start - 1)       # not before its own subphrases, whoever else is in the slot
                pos, hashes, when = pos[frequent], hashes[frequent], when[frequent]

        def out(lang, phrase, n, many, start, hashes):
            key = pc.binary_join_element_wise(phrase, pa.scalar(lang.encode(), pa.large_binary()), pa.scalar(b"\n", pa.large_binary())).cast(pa.string())
            state = (n << (SLOT_BITS + START_BITS)) | (start.astype(np.int64) << SLOT_BITS) | (hashes & mask).astype(np.int64)
            return pa.RecordBatch.from_arrays([key, pa.array(many.astype(np.int64)), pa.array(state)], names=["key", "a", "state"])

        def flush():
            for lang, texts in held.items():
                yield from rows(lang, *numbered(b"".join(texts)))

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_buffer().to_pybytes().lower().translate(breaks).replace(b"\n", b" \xff ") + b" \xff "
                held.setdefault(lang, []).append(raw)
                size += len(raw)
                if size >= FLUSH_BYTES:
                    yield from flush()
                    held, size = {}, 0
        if held:
            yield from flush()

    return count


def count_phrases(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(lang, phrase, n, a): all phrases of 1 to ``longest`` words that occur ``threshold`` times or more in their
    lang, and per lang one row with n = 0, the number of all its words.  ``slots``: a power of two, 64 to 2**32;
    ``shards`` times ``longest`` is at most 254."""
    import zlib

    import numpy as np
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    texts = dealt(docs, scratch, shards)
    at_step = np.full(slots, NEVER, np.uint8)
    n = F.shiftright("state", SLOT_BITS + START_BITS)
    start = F.shiftright("state", SLOT_BITS).bitwiseAND(F.lit((1 << START_BITS) - 1))
    slot = F.col("state").bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    state, step, last = None, 0, -1
    while step < max(shards, last + 1 + shards):
        reached = spark.sparkContext.broadcast(zlib.compress(at_step.tobytes(), 1))    # at most ``slots`` bytes
        shard = texts.where(F.col("shard") == step % shards).select("lang", "text")
        rows = shard.mapInArrow(_counter(step, shards, longest, reached, slots), COUNTED)
        total = (rows if state is None else rows.union(state)).groupBy("key").agg(F.sum("a").alias("a"), F.max("state").alias("state"))
        # a phrase below the threshold after its full cycle is done with
        kept = scratch.table(total.where((n == 0) | (F.col("a") >= threshold) | (start + F.lit(shards - 1) > step)))
        if state is not None:
            scratch.drop(state)
        state = kept
        over = state.where((F.col("a") >= threshold) & n.between(1, longest - 1)).select(slot.alias("slot"))
        bits = over.groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("b")).toArrow()
        words = np.zeros(max(1, slots // 64), np.uint64)                                # at most slots / 64 rows
        words[bits["w"].to_numpy()] = bits["b"].to_numpy().view(np.uint64)
        new = np.unpackbits(words.view(np.uint8), bitorder="little")[:slots].astype(bool) & (at_step == NEVER)
        if new.any():
            at_step[new], last = step, step
        reached.destroy()
        step += 1
    scratch.drop(texts)
    done = state.where((F.col("a") >= threshold) | (n == 0))
    return done.select(F.substring_index("key", "\n", 1).alias("phrase"), "key", n.cast("int").alias("n"), "a").select(
        F.expr("substring(key, length(phrase) + 2)").alias("lang"), "phrase", "n", "a")


def mine_collocations(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, top: int = 2000, covered: int = 80, **scan) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's best ``top`` phrases of 2 to ``longest`` words.

    A phrase's score is the least over its cuts of floor(2,000,000 a / (l + r)), in decimal arithmetic.  Phrases that
    stand inside a longer candidate with at least ``covered`` percent of their count are dropped."""
    counts = count_phrases(docs, threshold, longest, **scan)
    c = counts.where("n >= 2")
    words = F.split("phrase", " ")
    cut = c.select("lang", "phrase", "n", "a", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    piece = lambda start, size: F.array_join(F.slice(words, start, size), " ")
    cut = cut.select("*", piece(F.lit(1), F.col("k")).alias("head"), piece(F.col("k") + 1, F.col("n") - F.col("k")).alias("rest"))
    part = counts.where((F.col("n") >= 1) & (F.col("n") < longest))
    cut = cut.join(part.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"])
    cut = cut.join(part.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    score = F.expr("CAST(CAST(a AS DECIMAL(20, 0)) * CAST(2000000 AS DECIMAL(7, 0)) AS DECIMAL(38, 0)) div "
                   "CAST(CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)) AS DECIMAL(38, 0))")
    scored = cut.select("lang", "phrase", "a", F.struct(score.cast("long").alias("score"), "k", "l", "r").alias("cut"))
    scored = scored.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    # the largest count among the longer candidates around each phrase
    inner = c.where("n >= 3").select("lang", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("n") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("n") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))).alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = lambda x, by: F.col(x).cast("decimal(20,0)") * F.lit(by).cast("decimal(3,0)")
    left = scored.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer", 100) < wide("a", covered)))
    total = counts.where("n = 0").select("lang", F.col("a").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    best = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def q_op13(spark, sf_dir: str) -> DataFrame:
    """op13: the collocations of all documents, per lang."""
    return mine_collocations(documents(spark, sf_dir))


SQL = r"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
               FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts),
seqs AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM seqs GROUP BY lang),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM seqs WHERE len(w) > 0),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM spots, (VALUES (1), (2), (3), (4)) x(m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m >= 2),
cuts AS (SELECT c.lang, c.phrase, c.a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y
         FROM c, (VALUES (1), (2), (3)) z(k) WHERE k < m),
scores AS (SELECT cuts.lang, cuts.phrase, cuts.a, k, fx.a AS l, fy.a AS r, CAST((2000000::HUGEINT * cuts.a) // (fx.a + fy.a) AS BIGINT) AS score
           FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.phrase = x JOIN f fy ON fy.lang = cuts.lang AND fy.phrase = y),
least AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, a, array_to_string(w[i:i + s - 1], ' ') AS phrase
           FROM c, (VALUES (1), (2), (3)) p(i), (VALUES (2), (3)) q(s) WHERE s < m AND i + s - 1 <= m),
longer AS (SELECT lang, phrase, max(a) AS b FROM inside GROUP BY ALL),
stay AS (SELECT least.* FROM least LEFT JOIN longer USING (lang, phrase) WHERE b IS NULL OR 100::HUGEINT * b < 80::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM stay)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""
