"""Counts by way of a stream: a file, a folder, files that arrive later, and none."""

from pyspark.sql import functions as F

from atalaia.streaming import ingest


def test_streamed_counts(spark, tmp_path):
    rows = lambda a, n: spark.createDataFrame([(i, a) for i in range(n)], "event_id long, event_type string")
    folder, own = str(tmp_path / "in"), str(tmp_path / "own")
    rows("a", 3).coalesce(1).write.parquet(folder)
    got = lambda path, at=None: sorted(map(tuple, ingest.streamed_event_counts(spark, path, at).collect()))
    assert got(folder, own) == [("a", 3, 3)]
    rows("b", 2).coalesce(1).write.mode("append").parquet(folder)
    assert got(folder, own) == [("a", 3, 3), ("b", 2, 1)] == got(folder)
    assert got(folder, own) == [("a", 3, 3), ("b", 2, 1)]  # nothing new
    one = next(f for f in (tmp_path / "in").iterdir() if f.suffix == ".parquet")
    odd = tmp_path / "odd" / "x[1]{2}.parquet"
    odd.parent.mkdir()
    odd.write_bytes(one.read_bytes())
    (odd.parent / "x1.parquet").write_bytes(one.read_bytes())
    want = sorted(map(tuple, ingest.event_counts(spark.read.parquet(str(one))).collect()))
    assert got(str(one)) == want
    stream = ingest.arrived(spark, str(odd), "event_id long, event_type string")
    seen = []
    ingest.run_once(stream.select(F.input_file_name().alias("f")).distinct(), lambda b, i: seen.extend(b.collect()), str(tmp_path / "c"), "update")
    assert len(seen) == 1
