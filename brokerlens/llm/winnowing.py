"""Document fingerprints by winnowing.  DataFrame functions only.

The words of a text are hashed, the hashes of ``2**GRAM_LOG`` consecutive
words are combined into k-gram hashes by doubling (a k-gram is the pair of
its halves), and of every ``2**WINDOW_LOG`` consecutive k-grams the least
hash is chosen, the rightmost among equal ones, again by doubling.  Hash and
position share one long, so that one ``least`` decides both; the distinct
minima are the fingerprint, with their word positions.

Match guarantee: two texts that share a run of k + w - 1 words share a
chosen k-gram.  A text with fewer words than that has all its k-grams
chosen, and one with fewer words than a k-gram is one k-gram as a whole.

Words are what stands between white space; each code point of a script that is written
without spaces is a word, and longer words are cut every ``LONGEST`` code points, so that
texts without white space have k-grams as well.

Defined cases: null and word-free texts have the empty fingerprint; two
empty fingerprints have likeness 1, one empty and one not have 0; equal
texts have equal fingerprints; an empty table gives no rows; other columns
are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brokerlens.llm.common import WORD_SPACE, WORD_SPACE_RE, Scratch, documents, parts

GRAM_LOG = 2           # k = 4 words
WINDOW_LOG = 4         # w = 16 k-grams
POSITION_BITS = 31     # of the 63 bits; the other 32 are the hash
LAST = (1 << POSITION_BITS) - 1
LONGEST = 32           # code points of a word
# fixed values: scripts written without spaces between words
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]"
RANGE_BYTES = 8 << 20  # of text in a range of ids
MAX_RANGES = 20_000


def _words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WORD_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_SPACE_RE))


def _to_cut(word: Column) -> Column:
    """Whether a word is long or holds an unspaced script, of which a code point has three bytes or more."""
    n = F.length(word)
    return (n > LONGEST) | ((F.octet_length(word) - n >= 2) & word.rlike(UNSPACED))


def _cut(text: Column) -> Column:
    """Text with white space around each code point of an unspaced script and after ``LONGEST`` code points of a word."""
    return F.regexp_replace(text, rf"({UNSPACED}|[^\x20\x09-\x0D]{{{LONGEST}}})", " $1 ")


def _paired(values: str, step: int, join) -> Column:
    """``join`` of each element and the one ``step`` places on; ``values`` itself if it has none."""
    a = F.col(values)
    n = F.size(a) - step
    return F.when(n > 0, F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(step + 1), n), join)).otherwise(a)


def _folded(values: str, join) -> Column:
    """All elements joined in order, as an array of one (of none if there are none)."""
    a = F.col(values)
    return F.when(F.size(a) > 1, F.array(F.aggregate(F.slice(a, 2, F.size(a)), F.element_at(a, 1), join))).otherwise(a)


def winnow(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the chosen k-grams of column ``text`` as longs, hash above LAST - position, by position."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    k, w = 1 << GRAM_LOG, 1 << WINDOW_LOG
    pair = lambda x, y: F.xxhash64(x, y)
    d = df.select(*cols, _words(F.col(f"`{text}`")).alias("_h"))
    d = d.withColumn("_h", F.when(F.exists("_h", _to_cut), _words(_cut(F.col(f"`{text}`")))).otherwise(F.col("_h")))
    d = d.withColumn("_h", F.transform("_h", lambda x: F.xxhash64(x)))
    d = d.withColumn("_n", F.size("_h"))
    d = d.withColumn("_h", F.when(F.col("_n") < k, _folded("_h", pair)).otherwise(F.col("_h")))
    for j in range(GRAM_LOG):
        d = d.withColumn("_h", F.when(F.col("_n") < k, F.col("_h")).otherwise(_paired("_h", 1 << j, pair)))
    d = d.withColumn("_h", F.transform("_h", lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 32), POSITION_BITS)
                                       .bitwiseOR(F.lit(LAST).cast("long") - i.cast("long"))))
    short = F.size("_h") < w
    d = d.withColumn("_m", F.col("_h"))
    for j in range(WINDOW_LOG):
        d = d.withColumn("_m", F.when(short, F.col("_m")).otherwise(_paired("_m", 1 << j, lambda x, y: F.least(x, y))))
    return d.select(*cols, F.array_distinct("_m").alias(out))


def gram_hashes(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftrightunsigned(x, POSITION_BITS)))


def gram_positions(chosen: Column) -> Column:
    """Word position of each chosen k-gram, from 0."""
    return F.transform(chosen, lambda x: (F.lit(LAST).cast("long") - x.bitwiseAND(F.lit(LAST).cast("long"))).cast("int"))


def fingerprint_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, hashes, positions): the chosen k-grams of every document row, by position."""
    d = winnow(docs.select("doc_id", F.col(f"`{text}`").alias("text")), "text", "chosen")
    return d.select("doc_id", F.transform("chosen", lambda x: F.shiftrightunsigned(x, POSITION_BITS)).alias("hashes"),
                    gram_positions(F.col("chosen")).alias("positions"))


def likeness(a: Column, b: Column) -> Column:
    """Share of common elements among all of two arrays of distinct values (both empty: 1)."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def _ranges(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """``rows`` (doc_id, text, mix) with their ``bucket``, a range of ids and hashes with about ``RANGE_BYTES`` of text or less, larger
    ids first, null ids last; and the number of buckets.

    The bounds are those of a range partitioning of the ids alone, of any type that can be ordered; they are written,
    so that the bucket is a function of the row."""
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = int(min(MAX_RANGES, max(2, 2 * parts(rows.sparkSession), -(-size // RANGE_BYTES))))
    key = F.struct("doc_id", F.bitwise_not("mix").alias("rest"))       # falling: by id falling, then by hash rising
    least = rows.select(key.alias("key")).repartitionByRange(n, F.desc("key")).groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("b"))
    bounds = scratch.table(least.select("b"))                           # at most MAX_RANGES rows
    every = bounds.agg(F.reverse(F.sort_array(F.collect_list("b"))).alias("all"))
    step = max(1, int(n ** 0.5))
    both = every.select(F.struct("all", F.filter("all", lambda _, i: i % step == 0).alias("heads")).alias("s")).scalar()
    d = rows.withColumn("key", key).withColumn("bounds", both)
    above = lambda arr: F.size(F.filter(arr, lambda b: b > F.col("key")))
    block = F.greatest(above(F.col("bounds.heads")) - 1, F.lit(0)) * step
    return d.withColumn("bucket", block + above(F.slice("bounds.all", block + 1, F.lit(step)))).drop("bounds"), n


def with_next_document(docs: DataFrame) -> DataFrame:
    """(doc_id, text, chosen, next_text, next_chosen): text and fingerprint of each document and of the
    next one by descending doc_id, after the last of the first.  Rows of equal id come by the hash of
    their text, then by text.

    Rows go to ranges of ids; each range also gets the first row of the range after it, so that
    one local ``lead`` serves every row, without a sort of all rows in one task."""
    scratch = Scratch(docs.sparkSession, "winnowing")
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base, n = _ranges(base.withColumn("mix", F.xxhash64("text")), scratch)
    order = [F.col("doc_id").desc_nulls_last(), F.col("mix"), F.col("text")]
    # the first row of each bucket; one row per bucket
    top = base.groupBy("bucket").agg(F.max("key").alias("top"))
    top = top.select("bucket", "top", F.lag("bucket").over(Window.orderBy("bucket")).alias("before"),
                     F.max("bucket").over(Window.partitionBy()).alias("end"))
    heads = base.join(F.broadcast(top), "bucket").where(F.col("key").eqNullSafe(F.col("top")))
    heads = heads.groupBy(F.coalesce("before", "end").alias("bucket"), "doc_id").agg(F.min(F.struct("mix", "text")).alias("h"))
    rows = base.select("bucket", "doc_id", "mix", "text", F.lit(0).alias("extra")).union(
        heads.select("bucket", "doc_id", "h.mix", "h.text", F.lit(1)))
    w = Window.partitionBy("bucket").orderBy("extra", *order)
    rows = winnow(rows, "text", "chosen").repartition(n, "bucket")
    rows = rows.withColumn("next_text", F.lead("text").over(w)).withColumn("next_chosen", F.lead("chosen").over(w))
    return rows.where("extra = 0").drop("extra", "mix", "bucket")


def edited(text: Column, next_text: Column) -> Column:
    """The last third of a text's code points replaced by the first as many of the next one."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(next_text, F.lit(1), third))


def _digest(chosen: Column) -> Column:
    """position:hash of each chosen k-gram, hexadecimal, by position."""
    p = F.transform(chosen, lambda x: F.concat_ws(":", F.hex(F.lit(LAST).cast("long") - x.bitwiseAND(F.lit(LAST).cast("long"))),
                                                  F.hex(F.shiftrightunsigned(x, POSITION_BITS))))
    return F.lower(F.array_join(p, ","))


def q_op9(spark, sf_dir: str) -> DataFrame:
    """op9: winnowing fingerprints of all documents, of their edited texts, and their likeness."""
    d = with_next_document(documents(spark, sf_dir))
    d = d.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    d = winnow(d, "edited", "edited_chosen")
    own, near, far = (gram_hashes(F.col(c)) for c in ("chosen", "edited_chosen", "next_chosen"))
    return d.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"),
                    _digest(F.col("chosen")).alias("fingerprint"), _digest(F.col("edited_chosen")).alias("edited_fingerprint"),
                    likeness(own, near).alias("near_edited"), likeness(own, far).alias("near_next"))
