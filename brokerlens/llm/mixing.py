"""Mixing sources to target weights: capped water-filling, then seeded
whole and fractional repetitions.  DataFrame functions only.

Every source gets a share of the budget by weight, clamped at
``max_epochs`` times its size; what a clamp frees is shared again among
the sources below their clamp, by weight, until none is above.  A source
with target t and size s is read t/s times: each document is taken
``floor(t/s)`` times, and the documents whose seeded draw lies under the
source's threshold once more.  The threshold is the last one at which the
extra words fit into the missing fraction, found in two grouped histograms of
the draw (coarse, then fine within the coarse cell where the fraction ends),
so no task sorts a source.  Two more rounds fill what is left with documents
that are small enough.

Defined cases: a null source is a source of its own, ranked last; a null
or empty text has size 0 and takes 0; an empty table gives no rows; a
source of size 0 has target 0; rows that agree in id and text share their
draw; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brokerlens.operators.basic import dense_codes
from brokerlens.llm.common import Scratch, documents, word_count

CELLS = 256      # cells of the coarse and of the fine histogram of draws


def pattern_weights(sources: DataFrame, pattern=(3, 1, 2)) -> DataFrame:
    """Weights ``pattern``, repeating, by the sources' code-point order, a null source last.

    The order comes from range-partitioned numbering, not from one sorted task."""
    codes = dense_codes(sources, "source")
    ranked = sources.select("source").distinct().join(codes, "source", "left")
    n = codes.agg(F.count(F.lit(1))).scalar()
    pos = F.pmod(F.coalesce(F.col("code").cast("long"), n), F.lit(len(pattern))).cast("int")
    return ranked.select("source", F.element_at(F.array(*[F.lit(float(w)) for w in pattern]), pos + 1).alias("weight"))


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to (source, source_size, weight): weight times the water level,
    at most ``max_epochs`` times the size.

    The level is raised until no more source reaches its clamp; each round is one aggregate
    of the sources, of which the driver sees four numbers."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, clamped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= cap
        r = sources.agg(F.count(F.when(full, 1)).alias("n"),
                        F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("used"),
                        F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open")).first()
        if r["n"] == clamped or r["open"] <= 0:
            break
        clamped, level = r["n"], max(level, (budget - r["used"]) / r["open"])
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap) if level > 0 else F.lit(0.0))


def _draw(seed: int):
    """Cell 0 .. CELLS**2 - 1 of a row: a hash of seed, id and text."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(CELLS * CELLS)).cast("int")


def _tag():
    """The source as a non-null join key."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def _thresholds(rows: DataFrame, weights: DataFrame | None, budget_share: float, max_epochs: float,
                scratch: Scratch, rounds: int = 3) -> DataFrame:
    """(tag, source_size, target, whole, need, cuts) per source of ``rows`` (source, size, draw);
    ``need`` is what the fractional repetitions leave open."""
    sizes = scratch.table(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    wts = pattern_weights(sizes) if weights is None else weights.select("source", F.col("weight").cast("double"))
    weighted = scratch.table(
        sizes.join(wts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
             .select("source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight")))
    total = weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    epochs = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    plan = scratch.table(
        water_fill(weighted, budget_share * total, max_epochs)
        .withColumn("whole", F.floor(epochs + F.lit(1e-9)).cast("long"))
        .withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
        .select(_tag().alias("tag"), "source_size", "target", "whole", "need",
                F.expr("CAST(array() AS array<struct<limit: double, cut: int>>)").alias("cuts")))
    scratch.drop(sizes, weighted)
    tagged = rows.select(_tag().alias("tag"), "size", "draw")
    for _ in range(rounds):
        plan = scratch.table(_fill(tagged, plan))
    return plan


def _fill(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add to ``cuts`` the draw up to which every row not yet taken, and no larger than what
    ``need`` leaves, fits into it; lower ``need`` by their words."""
    open_ = (rows.join(plan.select("tag", "need", "cuts"), "tag")
                 .where((F.col("size") > 0) & (F.col("size") <= F.col("need")) & ~_drawn())
                 .select("tag", "need", "size", "draw", F.floor(F.col("draw") / CELLS).cast("int").alias("cell")))
    coarse = open_.groupBy("tag", "need", "cell").agg(F.sum("size").alias("words"))
    coarse = coarse.withColumn("cum", F.sum("words").over(Window.partitionBy("tag").orderBy("cell")))
    whole = (coarse.groupBy("tag").agg(F.max(F.when(F.col("cum") <= F.col("need"), F.struct("cum", "cell"))).alias("w"),
                                       F.min(F.when(F.col("cum") > F.col("need"), F.col("cell"))).alias("edge")))
    whole = whole.select("tag", F.coalesce("w.cum", F.lit(0)).alias("have"), F.coalesce("w.cell", F.lit(-1)).alias("last"), "edge")
    fine = (open_.join(whole, "tag").where(F.col("cell") == F.col("edge"))
                 .groupBy("tag", "need", "have", "draw").agg(F.sum("size").alias("words")))
    fine = fine.withColumn("cum", F.col("have") + F.sum("words").over(Window.partitionBy("tag").orderBy("draw")))
    fine = (fine.where(F.col("cum") <= F.col("need")).groupBy("tag")
                .agg(F.max("cum").alias("got"), F.max("draw").alias("below")))
    up_to = F.when(F.col("edge").isNull(), F.lit(CELLS * CELLS)).otherwise(
        F.coalesce("below", (F.col("last") + 1) * CELLS - 1))
    found = whole.join(fine, "tag", "left").select("tag", up_to.cast("int").alias("cut"), F.coalesce("got", "have").alias("got"))
    return plan.join(found, "tag", "left").select(
        "tag", "source_size", "target", "whole", (F.col("need") - F.coalesce("got", F.lit(0))).alias("need"),
        F.when(F.col("cut").isNull(), F.col("cuts")).otherwise(F.array_append(
            "cuts", F.struct(F.col("need").alias("limit"), F.col("cut").alias("cut")))).alias("cuts"))


def _drawn():
    """Whether a row is among the fractional repetitions."""
    return F.exists("cuts", lambda c: (F.col("size") <= c["limit"]) & (F.col("draw") <= c["cut"]))


def _repeats():
    return F.col("whole") + F.when(_drawn(), 1).otherwise(0)


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, budget_share: float = 1.5,
                max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, repeats, taken), one per document row.

    ``weights`` has (source, weight); without it 3, 1, 2 repeat over the sources.  The mix has
    ``budget_share`` times the words of all documents.  ``repeats`` is how often the row goes into
    the mix and ``taken`` its words there.  Reruns agree: a draw is a hash of seed, id and text.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.table(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                                     _draw(seed).alias("draw")))
    cuts = _thresholds(rows, weights, budget_share, max_epochs, scratch)
    return (rows.withColumn("tag", _tag()).join(cuts, "tag")
                .select("doc_id", "source", "size", "source_size", "target", _repeats().alias("repeats"))
                .withColumn("taken", F.col("size") * F.col("repeats")))


def mix_documents(docs: DataFrame, weights: DataFrame | None = None, budget_share: float = 1.5,
                  max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """The mixed documents themselves, all columns: every row as often as ``mix_sources`` says (0: it goes)."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.table(docs.select("source", word_count(F.col("text")).alias("size"), _draw(seed).alias("draw")))
    cuts = _thresholds(rows, weights, budget_share, max_epochs, scratch)
    scratch.drop(rows)
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    taken = docs.select(whole_row, word_count(F.col("text")).alias("size"), _draw(seed).alias("draw"),
                        _tag().alias("tag")).join(cuts, "tag")
    copies = taken.where(_repeats() > 0).select("doc", F.explode(F.sequence(F.lit(1).cast("long"), _repeats())))
    return copies.select("doc.*")


def q_op1(spark, sf_dir: str) -> DataFrame:
    """op1: the mix of all documents, weights 3, 1, 2 repeating, 150 % of all words, at most two epochs."""
    mix = mix_sources(documents(spark, sf_dir), budget_share=1.5, max_epochs=2.0)
    return mix.select("doc_id", "size", "source_size", "target", "taken", "repeats")
