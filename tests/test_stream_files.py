"""A stream over a table has one micro-batch per value, of several files where rows are many."""

from pyspark.sql import functions as F

from catalog.queries import streams
from catalog.views import Tables
from strandline.streaming import consume as cs


def test_a_batch_of_many_rows_is_several_files(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    t = Tables(spark, "/root/testdata/sf0.001")
    seen = []

    def each(batch, n):
        rows = batch.select("o_orderkey", F.input_file_name()).collect()
        seen.append(({r[0] % 4 for r in rows}, len(rows), len({r[1] for r in rows})))

    cs.run(cs.start(streams.stream(t, "orders"), each))
    assert [s[0] for s in seen] == [{0}, {1}, {2}, {3}]
    assert sum(s[1] for s in seen) == t.orders.count()
    files = {s[2] for s in seen}
    assert len(files) == 1 and files.pop() > 1
