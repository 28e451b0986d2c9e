"""Memory of the kNN bounds does not grow with the number of parts."""

from brokerlens.operators import knn


def test_batches_are_cut_by_the_number_of_parts(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELLS", 6400)
    df = spark.createDataFrame([([float(i), 0.0],) for i in range(1000)], "vec array<double>").coalesce(1)

    def sizes(batch, X, pa):
        assert len(X) == batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([len(X)], pa.int32()), pa.array([float(X[:, 0].sum())])], names=["n", "total"])
    for width, most in ((1, 4096), (100, 64), (10 ** 9, 16)):
        got = knn._by_batch(df, "n int, total double", 2, sizes, width).collect()
        assert max(r.n for r in got) <= most and sum(r.n for r in got) == 1000 and sum(r.total for r in got) == 499500.0
