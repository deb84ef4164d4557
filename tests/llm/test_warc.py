import hashlib
import io

import zstandard
from pyspark.sql import functions as F

from groundq.llm.warc import BundleReader, manifest, read_record, read_records, write_bundles


def test_round_trip(spark, tmp_path):
    big, copy = "é\r\n\r\nx" * 400_000, "<p>" + "c" * 200
    html = [None, "", "short", "short", copy, big, copy, "WARC/1.1\r\n\r\n" * 30, copy, big, "\x00" * 120]
    rows = [(100 - i, f"http://a/{i}\r\nX: y" if i % 2 else None, h, "clash") for i, h in enumerate(html)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    index = write_bundles(df, key="page_id", url="url", payload=F.col("html"), path=f"file://{tmp_path}/w").cache()
    got = {r.page_id: r for r in read_records(index, key="page_id").collect()}
    assert len(got) == len(html)
    first = {}
    for i in reversed(range(len(html))):
        first.setdefault(html[i] or "", 100 - i)
    for i, h in enumerate(html):
        r, data = got[100 - i], (h or "").encode()
        revisit = len(data) >= 100 and first[h or ""] != 100 - i
        assert (r.warc_type, r.refers_to_key) == (("revisit", str(first[h])) if revisit else ("response", None))
        assert r.payload_digest == hashlib.sha256(data).hexdigest() and r.payload_length == len(data)
        assert bytes(r.payload) == (b"" if revisit else data)
        if revisit:
            assert bytes(read_record(spark, index, r.refers_to, key="page_id").first().payload) == data
    for b in (r.bundle for r in index.select("bundle").distinct().collect()):  # a plain decoder reads the whole file too
        reader = BundleReader(b)
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(open(b.removeprefix("file://"), "rb").read()), read_across_frames=True).read()
        assert whole == b"".join(reader.frame(i) for i in range(len(reader.sizes)))


def test_repeated_rows_null_keys_and_empty_table(spark):
    copy = "z" * 150
    df = spark.createDataFrame([(None, None, copy), (3, None, copy), (3, None, copy)], "page_id long, url string, html string")
    got = read_records(write_bundles(df, key="page_id", url="url", payload=F.col("html")), key="page_id").collect()
    assert sorted((r.page_id or 0, r.warc_type, r.refers_to_key or "") for r in got) == [(0, "revisit", "3"), (3, "response", ""), (3, "response", "")]
    assert read_records(write_bundles(df.limit(0), key="page_id", url="url", payload=F.col("html")), key="page_id").count() == 0


def test_a_page_does_not_revisit_itself_and_the_manifest_names_what_counts(spark, tmp_path):
    copy = "z" * 150
    df = spark.createDataFrame([(3, "http://b", copy), (3, "http://a", copy), (4, "http://c", copy)], "page_id long, url string, html string")
    index = write_bundles(df, key="page_id", url="url", payload=F.col("html"), path=f"file://{tmp_path}/w")
    got = {r.target_uri: (r.warc_type, r.refers_to_key, r.refers_to) for r in read_records(index, key="page_id").collect()}
    assert got["http://a"][0] == got["http://b"][0] == "response" and got["http://c"][:2] == ("revisit", "3")
    assert read_record(spark, index, got["http://c"][2], key="page_id").first().target_uri == "http://a"
    BundleReader(index.first().bundle).close()
    (tmp_path / "w" / "bundle-lost.warc.zst").write_bytes(b"of a lost attempt")
    manifest(index, str(tmp_path / "m"))
    assert {r.value for r in spark.read.text(str(tmp_path / "m")).collect()} == {r.bundle for r in index.collect()}
