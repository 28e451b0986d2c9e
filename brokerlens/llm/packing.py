"""Packing documents into fixed-length training sequences.

A document's ids (and its end id) are cut into full sequences and one rest.
The rests are packed by first-fit decreasing: longest first, each into
the first open sequence with room, found in a tournament tree of the
sequences' free places.  That runs independently in randomised groups of
pieces of bounded size, so the work is spread evenly however documents
repeat.

Defined cases: a null or empty text is its end id alone; repeated rows are
packed once per row; an empty table gives no rows; other columns are not
read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brokerlens.llm.common import Scratch, documents
from brokerlens.llm.token_count import TOKENIZER

SEQ_LEN = 2048
END_ID = 1
GROUP = 16384       # pieces in a randomised group, on average


class RoomTree:
    """Tournament tree over bins: each node holds the most room below it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.most = [room] * (2 * self.leaves)

    def first_fit(self, need: int) -> int:
        """Leftmost bin with ``need`` places; takes them."""
        most, node = self.most, 1
        while node < self.leaves:
            node *= 2
            if most[node] < need:
                node += 1
        bin_ = node - self.leaves
        most[node] -= need
        while node > 1:
            node //= 2
            left, right = most[2 * node], most[2 * node + 1]
            most[node] = left if left > right else right
        return bin_


def first_fit_decreasing(lengths, room: int):
    """Bin and offset of each length, longest first, ties in the given order."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    tree, used = RoomTree(len(lengths), room), {}
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in order:
        b = tree.first_fit(lengths[i])
        bins[i], offsets[i] = b, used.get(b, 0)
        used[b] = offsets[i] + lengths[i]
    return bins, offsets


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): every document's ids cut every ``seq_len``."""
    kind = dict(docs.dtypes)["doc_id"]

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        from brokerlens.llm.bpe import RankEncoder, byte_balanced
        enc, end, step = RankEncoder.get(tokenizer), int(end_id).to_bytes(4, "little"), 4 * seq_len
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in byte_balanced(texts):
                row, start, length, total, ids = [], [], [], [], []
                for i, data in enumerate(enc.encode([t or "" for t in texts[a:b]]), a):
                    data += end
                    ids.append(data)
                    for s in range(0, len(data), step):
                        row.append(i)
                        start.append(s >> 2)
                        length.append(min(step, len(data) - s) >> 2)
                        total.append(len(data) >> 2)
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, total)],
                     pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, start long, length long, doc_tokens long, ids array<int>")


def pack_pieces(pieces: DataFrame, seq_len: int = SEQ_LEN, group: int = GROUP) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``seq_len``.

    Only the lengths are packed in groups; the other columns are joined to their places."""
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    # a row number fixed by writing it down; its hash spreads rows evenly, also equal ones
    rows = scratch.table(pieces.withColumn("_row", F.monotonically_increasing_id()))
    n = rows.count()
    groups = max(1, -(-n // group))
    lengths = rows.select("_row", "length", F.pmod(F.xxhash64("_row"), F.lit(groups)).alias("_group"))

    def pack(table):
        import pyarrow as pa
        table = table.sort_by("_row")
        bins, offsets = first_fit_decreasing(table.column("length").to_pylist(), seq_len)
        gid = table.column("_group")[0].as_py() << 32
        return pa.table({"_row": table.column("_row"), "sequence_id": pa.array([gid + b for b in bins], pa.int64()),
                         "offset": pa.array(offsets, pa.int64())})

    places = lengths.groupBy("_group").applyInArrow(pack, "_row long, sequence_id long, offset long")
    # always a sort-merge join: the pieces move the same way whatever the input's size
    return rows.join(places.hint("merge"), "_row").drop("_row")


def with_digest(packed: DataFrame) -> DataFrame:
    """Add ``ids_crc32``, the checksum of a packed piece's ids as little-endian 32-bit words."""
    from pyspark.sql.types import LongType, StructType
    at = packed.columns.index("ids")
    schema = StructType([*packed.schema.fields]).add("ids_crc32", LongType())

    def digest(batches):
        import zlib
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            ids = batch.column(at)
            flat, ends = ids.values.to_numpy().astype("<i4", copy=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(np.ascontiguousarray(flat[a:b])) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(crc, pa.int64())], names=[*batch.schema.names, "ids_crc32"])

    return packed.mapInArrow(digest, schema)


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset): the pieces of all documents in their sequences."""
    packed = with_digest(pack_pieces(token_pieces(docs, tokenizer, seq_len, end_id), seq_len))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset")


def q_op3(spark, sf_dir: str) -> DataFrame:
    """op3: all documents packed into sequences of 2048 tokens."""
    return pack_documents(documents(spark, sf_dir))
