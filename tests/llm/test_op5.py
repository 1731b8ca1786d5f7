"""Operator 5: one flipped byte loses one record, gaps cover what is lost, files are bounded by bytes, awkward rows."""

import gzip

import pytest

from verdure.llm import op5_warc

SCHEMA = "page_id long, url string, html string"


def test_a_flipped_byte_loses_one_record(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"{i} page " * 200) for i in range(50)], SCHEMA)
    op5_warc.write_archives(pages.coalesce(1), str(tmp_path / "w"))
    data = next((tmp_path / "w").rglob("part*.txt")).read_bytes()
    starts = [r[2] for r in op5_warc._rows("f", data, True)] + [len(data)]
    for k in (0, 17, 49):
        for at in (0, 12, 40, starts[k + 1] - starts[k] - 5):
            broken = bytearray(data)
            broken[starts[k] + at] ^= 0x10
            rows = list(op5_warc._rows("f", bytes(broken), True))
            assert len({r[7] for r in rows if r[1] == "record"}) == 49
            assert [(r[2] + r[3], r[4]) for r in rows if r[1] == "gap"] == [(starts[k], starts[k + 1] - starts[k])]


def test_gaps_of_one_long_member():
    """Records before the damage come back, and the gap begins within a few bytes behind them."""
    record = lambda i: b"WARC/1.0\r\nWARC-Record-ID: <%d>\r\nContent-Length: 900\r\n\r\n%s\r\n\r\n" % (i, bytes((i * 37 + j * j) % 251 for j in range(900)))
    data = bytearray(gzip.compress(b"".join(map(record, range(40)))))
    half = len(data) // 2
    data[half : half + 30] = b"\xff" * 30
    rows = list(op5_warc._rows("f", bytes(data), True))
    ids = [r[7] for r in rows if r[1] == "record"]
    (gap,) = [(r[2] + r[3], r[4]) for r in rows if r[1] == "gap"]
    assert 10 <= len(ids) < 40 and ids == [f"<{i}>" for i in range(len(ids))]
    assert 0 < gap[0] <= half + 30 and gap[0] + gap[1] == len(data)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch, compression):
    bound = 5000 if compression == "gzip" else 20_000
    monkeypatch.setattr(op5_warc, "FILE_BYTES", bound)
    monkeypatch.setattr(op5_warc, "BROADCAST", 0 if compression == "none" else 10)
    rows = [(i, "http://x", "".join(chr(33 + (i * 31 + j * j) % 90) for j in range(1500))) for i in range(60)] + [(99, "http://x", "b" * 50_000)]
    # Awkward: no id, no text, no address, repeated rows, two rows with the largest key.
    rows += [(None, None, None), (None, "http://x", "a" * 1200), (5, "http://y", "a" * 1200), (7, "http://z", "a" * 1200), (7, "http://z", "a" * 1200), (3, "", ""), (3, "", "")]
    pages = spark.createDataFrame(rows, SCHEMA)
    op5_warc.write_archives(pages.coalesce(2), str(tmp_path / "w"), compression)
    sizes = [f.stat().st_size for f in (tmp_path / "w").rglob("part*.txt")]
    assert len(sizes) > 2 and sorted(sizes)[-2] <= bound
    back = op5_warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert [r.kind for r in back] == ["record"] * len(rows)
    copies = sorted((r.record_id, r.warc_type, r.refers_to) for r in back if r.payload_bytes == 1200)
    assert copies == [("<urn:page:5>", "revisit", "<urn:page:7>"), ("<urn:page:7>", "response", None), ("<urn:page:7>", "response", None), ("<urn:page:>", "revisit", "<urn:page:7>")]
    assert sum(r.payload_bytes for r in back) == sum(len(h or "") for *_, h in rows)


def test_empty_table(spark, tmp_path):
    op5_warc.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "w"))
    assert op5_warc.read_archives(spark, str(tmp_path / "w")).count() == 0
