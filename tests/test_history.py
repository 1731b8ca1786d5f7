"""The bounded history: newest rows over many batches, and few versions of each bucket."""

from pathlib import Path

from verdure.streaming import events

SCHEMA = "owner string, n long"


def test_versions_stay_few(spark, tmp_path):
    for batch in range(5):
        rows = [("a", batch * 10 + i) for i in range(4)] + ([("b", batch)] if batch % 2 else [])
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = events.history_stream(spark, str(tmp_path), "i[n]", SCHEMA, "owner", ["n"], str(tmp_path / "out"), str(tmp_path / "checkpoint"), keep=6)
        kept = {k: sorted(r.n for r in got.collect() if r.owner == k) for k in "ab"}
        every = {"a": [b * 10 + i for b in range(batch + 1) for i in range(4)], "b": [b for b in range(batch + 1) if b % 2]}
        assert kept == {k: sorted(v)[-6:] for k, v in every.items()}
    folders = {}
    for p in Path(tmp_path, "out").glob("version=[0-9]*/bucket=*"):
        folders.setdefault(p.name, []).append(p)
    assert len(folders) == 2 and all(len(v) <= 2 for v in folders.values())
