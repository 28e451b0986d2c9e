"""E2 / E3 preparation: one frame with features, label and part.

Features and label stay in ONE DataFrame keyed by message id (the
reference aligned X and y by position).  Cleaning statistics are fitted on
the training part only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brokerlens.operators.cleaning import MODEL_FEATURES, fit_medians, impute_median, replace_infinite
from brokerlens.operators.basic import materialize
from brokerlens.operators.split import with_part

CUTOFF = "2024-01-25 00:00:00"      # of the fixture's messages, for the queries that are checked by SQL
TEST_SIZE = 0.2


def model_frame(labelled: DataFrame, features=MODEL_FEATURES, label: str = "is_ddos",
                keys=("mqtt_message_id", "ts")) -> DataFrame:
    have = set(labelled.columns)
    feats = [c for c in features if c in have]
    return labelled.select(*keys, *[F.col(c).cast("double").alias(c) for c in feats], F.col(label))


def time_split(df: DataFrame, cutoff: str, ts: str = "ts"):
    """Temporal hold-out: train before ``cutoff``, test from it on (a
    filter, pushed down to the scan).  A message without a time is no
    evidence of the future: it goes to the training part."""
    t = F.to_timestamp(F.lit(cutoff))
    return df.where(F.col(ts).isNull() | (F.col(ts) < t)), df.where(F.col(ts) >= t)


def clean_parts(train: DataFrame, test: DataFrame, features: list[str]):
    """inf -> null -> median of the TRAIN part, in both parts."""
    tr = replace_infinite(train, features)
    med = fit_medians(tr, features)
    return impute_median(tr, med), impute_median(replace_infinite(test, features), med)


def prepared_parts(labelled: DataFrame, features=MODEL_FEATURES, cutoff: str | None = None, test_size: float = TEST_SIZE, seed: int = 42):
    """(train, test, features), cleaned: a stratified random hold-out of ``test_size``, or with ``cutoff`` the
    messages from that time on.

    The parts of the random hold-out are written down, first labelled and ranked, then cleaned: medians, fits and
    scores pass over them many times, and each pass would label and rank all messages anew."""
    mf = model_frame(labelled, features)
    feats = [c for c in features if c in mf.columns]
    if cutoff is not None:
        return clean_parts(*time_split(mf, cutoff), feats) + (feats,)
    both = materialize(with_part(materialize(mf), "is_ddos", test_size, seed))
    tr, te = clean_parts(*(both.where(c).drop("in_test") for c in ("NOT in_test", "in_test")), feats)
    return materialize(tr), materialize(te), feats
