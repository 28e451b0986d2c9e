"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes and long texts are split at safe boundaries
(``bpe``).  One pass over the documents, no shuffle.

Defined cases: a null text counts as empty, an empty text has 0 tokens,
repeated rows give repeated rows, an empty table gives none; other columns
are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brokerlens.llm.common import batches_by_bytes, documents

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per document row, of the whole text.

    Tokens as the tokenizer file gives them by default: special strings inside texts become
    their token; none are added; no truncation or padding."""
    kind = dict(docs.dtypes)["doc_id"]
    batches_by_bytes(docs.sparkSession)

    def lengths(batches):
        import pyarrow as pa
        from brokerlens.llm.bpe import Encoder, byte_balanced
        enc = Encoder.get(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n: list[int] = []
            for a, b in byte_balanced(texts):
                n += [len(ids) >> 2 for ids in enc.encode([t or "" for t in texts[a:b]])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long"))
    counted = docs.select("doc_id", "text", n_bytes.alias("n_bytes")).mapInArrow(
        lengths, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def q_op2(spark, sf_dir: str) -> DataFrame:
    """op2: tokens of every document."""
    return count_tokens(documents(spark, sf_dir))
