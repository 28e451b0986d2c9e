"""Toxicity by a linear-chain conditional random field over words.

Training.  The labels are on documents, so token labels are made first: of
a bounded sample of labelled documents, the words and word beginnings are
kept that occur in toxic documents far more often than chance (G statistic);
a word of a toxic document that has such a feature is a toxic token, all
others are not.  On windows around such words, and on as many plain ones, the
field's feature weights and transitions are fitted by maximum likelihood.  The
marginals of the sampled documents then fit a logistic function from the
highest marginal and the expected number of toxic words to the label, each class
weighted by its count among all usable labels over its count in the sample.

Scoring.  One pass over the documents: exact forward-backward marginals per
word.  Words without a kept feature all have the same factor, so a long run
of them is one power of a 2 x 2 matrix in closed form.  A document's score is
the logistic function of its marginals; words with a marginal of a half or
more are its offending spans.

Bounds: at most ``SAMPLE`` labelled documents per class, ``FEATURES``
features and ``SEQUENCES`` training windows reach the driver, whatever the input.

Defined cases: null, empty and word-free texts get the score of no evidence;
labels that are null, or of ids without a document, are not used, and an id
with several labels counts as toxic if one says so; without toxic and clean
labels, or without features, every score is the share of toxic labels (0
without labels); repeated rows get equal scores; an empty table gives no
rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brokerlens.llm.common import Scratch, batches_by_bytes, documents

SAMPLE = 4000
FEATURES = 4096
SEQUENCES = 8000
WINDOW = 10            # words on either side of a training window's word
LONGEST = 64           # words of a training window
MIN_G = 25.0
NEAR = 8               # plain words beside a feature word that are stepped through singly
THRESHOLD = 0.7
KNOWN = 100_000        # words whose factors a worker keeps
BEGINNINGS = (4, 5, 6)
EDGE = re.compile(r"^\W+|\W+$")
TOKEN = re.compile(r"\S+")


def word_features(word: str) -> list[str]:
    """The word itself without punctuation and case, and its beginnings."""
    w = EDGE.sub("", word.lower())
    if not w:
        return []
    return ["=" + w, *["^" + w[:n] for n in BEGINNINGS if len(w) > n]]


def is_held_out(doc_id):
    """crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


@dataclass
class Model:
    """Feature weights, bias of the toxic state, log transitions and the logistic function."""
    weights: dict
    bias: float = 0.0
    start: float = 0.0
    moves: tuple = ((0.0, 0.0), (0.0, 0.0))
    logistic: tuple = (0.0, 0.0, 0.0)       # constant; highest marginal; log(1 + expected toxic words)

    def factor(self, word: str) -> float:
        """Weight of a word's features, 0 for a plain word."""
        return sum(self.weights.get(f, 0.0) for f in word_features(word))

    def score(self, top: float, expected: float) -> float:
        c, a, b = self.logistic
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, c + a * top + b * math.log1p(expected)))))


class Chain:
    """Forward-backward marginals of one document's words."""

    def __init__(self, model: Model):
        e = math.exp
        (t00, t01), (t10, t11) = model.moves
        self.t = (e(t00), e(t01), e(t10), e(t11))
        self.plain, self.start = e(model.bias), e(model.start)
        # plain step: transition, then the plain factor; eigenvalues of the 2 x 2 matrix
        a, b, c, d = self.t[0], self.t[1] * self.plain, self.t[2], self.t[3] * self.plain
        root = math.sqrt((a - d) ** 2 + 4 * b * c)
        big, small = (a + d + root) / 2, (a + d - root) / 2
        self.ratio = small / big
        self.lead = tuple((x - small * i) / (big - small) for x, i in ((a, 1), (b, 0), (c, 0), (d, 1)))
        self.bias = model.bias

    def run(self, n: int):
        """The plain step to the power ``n``, up to a factor."""
        r = self.ratio ** n
        a, b, c, d = self.lead
        return a + r * (1 - a), b - r * b, c - r * c, d + r * (1 - d)

    def marginals(self, n: int, hits: list[tuple[int, float]]) -> list[tuple[int, float]]:
        """(position, probability of toxic) of the words at and near ``hits`` (position, factor) among ``n``."""
        factor = dict(hits)
        near = sorted({q for p in factor for q in range(max(0, p - NEAR), min(n, p + NEAR + 1))})
        steps, at = [], -1
        for p in near:
            skipped = p - at - 1
            f = math.exp(min(60.0, self.bias + factor.get(p, 0.0)))
            steps.append((skipped, f))
            at = p
        t00, t01, t10, t11 = self.t
        forward, x, y = [], 1.0, self.start
        first = True
        for skipped, f in steps:
            if skipped:
                if first:
                    y *= self.plain
                    skipped -= 1
                if skipped:
                    a, b, c, d = self.run(skipped)
                    x, y = x * a + y * c, x * b + y * d
                first = False
            if not first:
                x, y = x * t00 + y * t10, x * t01 + y * t11
            y *= f
            first = False
            s = x + y
            x, y = x / s, y / s
            forward.append((x, y))
        out, x, y = [], 1.0, 1.0
        tail = n - 1 - at
        if tail:
            a, b, c, d = self.run(tail)
            x, y = a + b, c + d
        for i in range(len(steps) - 1, -1, -1):
            u, v = forward[i][0] * x, forward[i][1] * y
            out.append((near[i], v / (u + v)))
            skipped, f = steps[i]
            y *= f
            x, y = t00 * x + t01 * y, t10 * x + t11 * y
            if skipped:
                a, b, c, d = self.run(skipped)
                x, y = a * x + b * y, c * x + d * y
            s = x + y
            x, y = x / s, y / s
        return out[::-1]


def fit_field(sequences, n_features: int, rounds: int = 200, l2: float = 0.01):
    """Maximum likelihood of (features per word, label per word) sequences: weights, bias, start, transitions.

    Gradient by forward-backward over all sequences at once, Adam steps."""
    import numpy as np
    n, longest = len(sequences), max(len(s[1]) for s in sequences)
    label, real = np.zeros((n, longest)), np.zeros((n, longest), bool)
    rows, cols = [], []
    for i, (feats, labels) in enumerate(sequences):
        label[i, :len(labels)] = labels
        real[i, :len(labels)] = True
        for j, fs in enumerate(feats):
            rows += [i * longest + j] * len(fs)
            cols += fs
    rows, cols = np.array(rows, np.int64), np.array(cols, np.int64)
    theta = np.zeros(n_features + 6)        # weights, bias, start, transitions 00 01 10 11
    theta[n_features] = -2.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    ends = real.sum(1) - 1
    pair = real[:, 1:]
    seen = np.array([[((label[:, :-1] == a) & (label[:, 1:] == b) & pair).sum() for b in (0, 1)] for a in (0, 1)], float)
    words = real.sum()
    for k in range(1, rounds + 1):
        w, bias, start, move = theta[:n_features], theta[n_features], theta[n_features + 1], np.exp(theta[n_features + 2:].reshape(2, 2))
        f = np.exp(np.clip(np.bincount(rows, w[cols], n * longest).reshape(n, longest) + bias, -30, 30))
        fw, bw = np.zeros((longest, n, 2)), np.ones((longest, n, 2))
        cur = np.stack([np.ones(n), np.exp(start) * f[:, 0]], 1)
        fw[0] = cur / cur.sum(1, keepdims=True)
        for j in range(1, longest):
            cur = fw[j - 1] @ move
            cur[:, 1] *= f[:, j]
            cur /= cur.sum(1, keepdims=True)
            fw[j] = np.where(real[:, j, None], cur, fw[j - 1])
        for j in range(longest - 2, -1, -1):
            nxt = bw[j + 1] * np.stack([np.ones(n), f[:, j + 1]], 1)
            cur = nxt @ move.T
            cur /= cur.sum(1, keepdims=True)
            bw[j] = np.where((j < ends)[:, None], cur, 1.0)
        post = fw * bw
        p = (post[..., 1] / post.sum(2)).T * real
        both = np.zeros((2, 2))
        for j in range(longest - 1):
            x = fw[j][:, :, None] * move[None] * (bw[j + 1] * np.stack([np.ones(n), f[:, j + 1]], 1))[:, None, :]
            x /= x.sum((1, 2), keepdims=True)
            both += x[pair[:, j]].sum(0)
        miss = (label - p) * real
        grad = np.concatenate([np.bincount(cols, miss.reshape(-1)[rows], n_features), [miss.sum(), miss[:, 0].sum()],
                               (seen - both).reshape(-1)]) / words - l2 * theta / max(1, n)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + 0.1 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
    t = theta[n_features + 2:].tolist()
    return theta[:n_features].tolist(), float(theta[n_features]), float(theta[n_features + 1]), ((t[0], t[1]), (t[2], t[3]))


def fit_logistic(tops, expected, labels, rounds: int = 60, l2: float = 1.0, shares=(1.0, 1.0)):
    """Constant and two coefficients of a ridge logistic regression, by Newton steps; ``shares``: weight of a row by its label."""
    import numpy as np
    x = np.column_stack([np.ones(len(labels)), tops, np.log1p(expected)])
    y, w = np.asarray(labels, float), np.zeros(3)
    weight = np.where(y > 0, shares[1], shares[0])
    ridge = np.diag([1e-3, l2, l2]) * 0.1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(c) for c in w)


def _marginals(model: Model):
    """Arrow function over (key, text): key, highest marginal, expected toxic words, spans."""
    def run(batches):
        import pyarrow as pa
        chain, known = Chain(model), {}
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

        def document(text):
            words = text.split()
            new = set(words).difference(known)
            if len(known) > KNOWN:
                known.clear()
                new = set(words)
            for w in new:
                known[w] = model.factor(w)
            hits = [(i, f) for i, f in enumerate(map(known.__getitem__, words)) if f]
            if not hits:
                return 0.0, 0.0, []
            found = chain.marginals(len(words), hits)
            bad = {i: p for i, p in found if p >= 0.5}
            spans = []
            if bad:
                spans = [{"start": m.start(), "end": m.end(), "probability": bad[i]}
                         for i, m in enumerate(TOKEN.finditer(text)) if i in bad]
            return max(p for _, p in found), sum(p for _, p in found), spans

        for batch in batches:
            out = [document(batch.column(1)[i].as_py() or "") for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.float64()),
                 pa.array([o[2] for o in out], spans_type)], names=["key", "top", "expected", "spans"])
    return run


SPANS = "array<struct<start: int, end: int, probability: double>>"


def _strong(counts: DataFrame, n0: int, n1: int) -> DataFrame:
    """Rows of (feature, clean, toxic) whose share of toxic documents is high beyond chance, with ``g``."""
    x, y, n = F.col("toxic"), F.col("clean"), n0 + n1
    part = lambda got, want: F.when(got > 0, got * F.log(got / want)).otherwise(F.lit(0.0))
    g = 2 * (part(x, (x + y) * n1 / n) + part(y, (x + y) * n0 / n))
    return counts.where(x / n1 > 8 * y / n0).withColumn("g", g).where(F.col("g") >= MIN_G)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the labelled rows that are not held out, on at most ``sample`` documents per class."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    usable = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
                    .where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    # the usable labels' documents, with the rows of each: ids without a document neither count nor take places in the sample
    held = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"))
    usable = scratch.table(usable.join(held, "doc_id"))
    all_rows = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.sum("n_rows").alias("n")).collect()}
    all0, all1 = all_rows.get(0, 0), all_rows.get(1, 0)
    if not all0 or not all1:
        scratch.drop(usable)
        share = all1 / (all0 + all1) if all0 + all1 else 0.0
        return Model({}, logistic=(math.log(max(share, 1e-13) / max(1 - share, 1e-13)), 0.0, 0.0))
    by_class = [usable.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    chosen = by_class[0].union(by_class[1]).select("doc_id", "toxic")
    # at most 2 * sample ids: a bounded broadcast
    texts = scratch.table(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
                              .select(F.col("toxic").alias("key"), "text").repartition(16))
    counts = {r["key"]: r["n"] for r in texts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = counts[0], counts[1]
    scratch.drop(usable)

    def document_counts(batches):
        from collections import Counter
        import pyarrow as pa
        seen = [Counter(), Counter()]
        for batch in batches:
            for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[c].update({f for w in set((t or "").split()) for f in word_features(w)})
        names = list(seen[0].keys() | seen[1].keys())
        for i in range(0, len(names), 50_000):
            part = names[i:i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *[pa.array([s[f] for f in part], pa.int64()) for s in seen]],
                                             names=["feature", "clean", "toxic"])

    df = (texts.mapInArrow(document_counts, "feature string, clean long, toxic long")
               .groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    strong = (_strong(df, n0, n1).orderBy(F.desc("g"), "feature").limit(4 * FEATURES)
              .select("feature", "clean", "toxic").collect())
    candidates = {r["feature"] for r in strong}

    def contexts(batches):
        import pyarrow as pa
        for batch in batches:
            seen = set()
            for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (t or "").split() if c else []
                for i, w in enumerate(words):
                    seen.update((f, " ".join(words[max(0, i - 1):i] + words[i + 1:i + 2])) for f in word_features(w) if f in candidates)
            pairs = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())],
                                             names=["feature", "context"])

    # words that many toxic documents copied from one another stand in one context: they count once
    varied = (texts.mapInArrow(contexts, "feature string, context string").groupBy("feature")
                   .agg(F.countDistinct("context").alias("contexts")))
    spark = docs.sparkSession
    strong = spark.createDataFrame([tuple(r) for r in strong], "feature string, clean long, toxic long")
    kept = _strong(strong.join(varied, "feature").withColumn("toxic", F.least("toxic", "contexts")), n0, n1)
    kept = kept.orderBy(F.desc("g"), "feature").limit(FEATURES).select("feature").collect()
    index = {f: i for i, f in enumerate(sorted(r["feature"] for r in kept))}
    if not index:
        scratch.drop(texts)
        return Model({}, logistic=(math.log(all1 / all0), 0.0, 0.0))

    def windows(batches):
        import zlib
        import pyarrow as pa
        for batch in batches:
            feats, tags = [], []
            for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (t or "").split()
                ids = {i: f for i, w in enumerate(words) if (f := [index[x] for x in word_features(w) if x in index])}
                centres = sorted(ids) or ([zlib.crc32((t or "").encode()) % len(words)] if words else [])
                at = -1
                for i in centres:
                    if i <= at:
                        continue
                    a = max(at + 1, i - WINDOW)
                    at = min(len(words), i + WINDOW + 1, a + LONGEST) - 1
                    feats.append([ids.get(j, []) for j in range(a, at + 1)])
                    tags.append([int(c and j in ids) for j in range(a, at + 1)])
            yield pa.RecordBatch.from_arrays([pa.array(feats, pa.list_(pa.list_(pa.int32()))), pa.array(tags, pa.list_(pa.int8()))],
                                             names=["feats", "tags"])

    seqs = (texts.mapInArrow(windows, "feats array<array<int>>, tags array<byte>")
                 .orderBy(F.xxhash64(F.to_json(F.struct("feats", "tags")), F.lit(3)), F.to_json("feats")).limit(SEQUENCES).collect())
    w, bias, start, moves = fit_field([(r["feats"], r["tags"]) for r in seqs], len(index))
    model = Model({f: w[i] for f, i in index.items()}, bias, start, moves)
    got = texts.mapInArrow(_marginals(model), f"key int, top double, expected double, spans {SPANS}").select("key", "top", "expected").collect()
    got = sorted(tuple(r) for r in got)
    model.logistic = fit_logistic([r[1] for r in got], [r[2] for r in got], [r[0] for r in got],
                                  shares=(all0 / n0, all1 / n1))
    scratch.drop(texts)
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, spans) per document row; spans are code-point offsets with their marginal."""
    kind = dict(docs.dtypes)["doc_id"]
    batches_by_bytes(docs.sparkSession)
    got = docs.select(F.col("doc_id").alias("key"), "text").mapInArrow(
        _marginals(model), f"key {kind}, top double, expected double, spans {SPANS}")
    c, a, b = model.logistic
    z = F.lit(c) + F.lit(a) * F.col("top") + F.lit(b) * F.log1p("expected")
    return got.select(F.col("key").alias("doc_id"), (1.0 / (1.0 + F.exp(-z))).alias("score"), "spans")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score under ``threshold``, all columns, in one pass without a join."""
    at = docs.columns.index("text")
    batches_by_bytes(docs.sparkSession)
    marginals = _marginals(model)

    def keep(batches):
        import pyarrow as pa
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), batch.column(at)], names=["key", "text"])
            for got in marginals(iter([texts])):
                score = [model.score(t, e) for t, e in zip(got.column(1).to_pylist(), got.column(2).to_pylist())]
                yield batch.filter(pa.array([s < threshold for s in score], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def q_op5(spark, sf_dir: str) -> DataFrame:
    """op5: toxicity of all documents, learned from the labelled rows that are not held out."""
    docs = documents(spark, sf_dir)
    got = score_documents(docs, train(docs, documents(spark, sf_dir, "labels")))
    return got.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
