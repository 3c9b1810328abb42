import datetime as dt

from folioloom.streaming import votes as S
from tests.conftest import rows


def _events(spark, path, data):
    spark.createDataFrame(data, "id long, ts timestamp, q string, v string").coalesce(1).write.mode("append").parquet(path)


def test_fold_equals_the_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    folder = str(tmp_path / "in")
    _events(spark, folder, [(1, t, "q", "a"), (2, t, "q", "b")])
    _events(spark, folder, [(3, t, "q", "a"), (4, t, "r", "a")])
    stream = spark.readStream.schema("id long, ts timestamp, q string, v string").option("maxFilesPerTrigger", 1).parquet(folder)
    S.run_once(S.vote_stream(stream, "q", "v"), "folded", "complete", str(tmp_path / "c"))
    assert rows(spark.table("folded")) == [("q", "a", 2), ("q", "b", 1), ("r", "a", 1)]


def test_repeated_deliveries_and_windows(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    folder = str(tmp_path / "in")
    _events(spark, folder, [(1, t, "q", "a"), (1, t, "q", "a"), (2, t + dt.timedelta(minutes=7), "q", "a"), (3, t + dt.timedelta(hours=5), "q", "a")])
    read = lambda: spark.readStream.schema("id long, ts timestamp, q string, v string").parquet(folder)
    S.run_once(S.first_deliveries(read(), "ts", "id", "1 hour"), "firsts", "append", str(tmp_path / "c1"))
    assert sorted(r.id for r in spark.table("firsts").collect()) == [1, 2, 3]
    S.run_once(S.windowed_counts(read(), "ts", "q", "10 minutes", "1 hour"), "windows", "complete", str(tmp_path / "c2"))
    assert sorted(r.n for r in spark.table("windows").collect()) == [1, 3]
