import hashlib
import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexivec.llm import archive, common


def test_round_trip(spark):
    long = "<p>é" + "x" * 200
    rows = [(5, "http://a/\r\nb", long), (2, "u", long), (9, None, long), (2, "u", long), (1, "u", "short"), (3, "u", "short"), (4, "u", None), (None, "u", long), (6, "u", "y" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit(1))
    out = archive.round_trip(pages, payload=True).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out), key=repr)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = html == long and i != 2
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert got == sorted(want, key=repr)
    assert all(r["payload"] == (None if r["record_type"] == "revisit" else bytes(r["payload"])) for r in out)
    assert archive.round_trip(pages.limit(0)).count() == 0


def test_text_ids_and_hot_digests(spark, monkeypatch):
    monkeypatch.setattr(common, "FREQUENT_LEAST", 10)
    same, ids = "<p>" + "same " * 60, ["", "b:1>\r\nx", "é", None, *(f"k{i:03}" for i in range(60))]
    pages = spark.createDataFrame([(i, "u", same) for i in ids] + [(f"z{i}", "u", f"other {i} " * 40) for i in range(5)], "page_id string, url string, html string")
    out = archive.round_trip(pages)
    assert archive.unresolved(out).count() == 0
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in out.collect()}
    assert got == {("", "response", None), *((i, "revisit", "") for i in ids if i != ""), *((f"z{i}", "response", None) for i in range(5))}
    wrong = out.withColumn("payload_digest", F.when(F.col("page_id") == "k001", "00").otherwise(F.col("payload_digest")))
    assert [r["page_id"] for r in archive.unresolved(wrong).collect()] == ["k001"]


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directories(wide, monkeypatch):
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a", b"A" * 50)
        z.writestr("deep/b", b"B" * 70)
        z.writestr("c", b"C" * 90, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 not the end"
    reader = archive.ZipReader(pa.BufferReader(sink.getvalue()))
    members = reader.members()
    assert {n: m.size for n, m in members.items()} == {"a": 50, "deep/b": 70, "c": 90}
    assert reader.range(reader.place(members["deep/b"]) + 3, 5) == b"BBBBB" and reader.range(reader.place(members["a"]), 50) == b"A" * 50
    with pytest.raises(ValueError):
        reader.place(members["c"])
    with pytest.raises(ValueError):
        archive.ZipReader(pa.BufferReader(b"nothing" * 10)).members()


def test_packages_roll_over(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"{i} " * 500) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    packages = archive.write_packages(pages, str(tmp_path / "p"), package_bytes=500)
    assert packages.count() > 3 and packages.agg(F.sum("records")).first()[0] == 40
    assert archive.read_records(archive.index_packages(packages)).select("page_id").distinct().count() == 40
