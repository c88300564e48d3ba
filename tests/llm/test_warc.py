import base64
import hashlib

from kbspark.llm import warc

SCHEMA = "page_id long, url string, html string, key string, size string"


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def round_trip(spark, rows, **kw):
    return warc.archive_round_trip(spark.createDataFrame([(*r, "k", "s") for r in rows], SCHEMA), **kw).collect()


def test_payloads_revisits_and_transactions(spark):
    mark = "WARC/1.1\r\n"
    rows = [(1, "http://a/x", "same"), (4, "http://b", "same"), (2, None, ""), (3, "u", None), (5, "v\r\nw", "a" + mark + "b\\" + mark + "WARC/1.1\r\n\r\n\r\n"),
            (6, "z", "\r\n\r\nhead\r\n\r\n"), (7, "l", "é€\U0001F600" * 50_000), (8, "t", "ends in CR LF\r\n\r\n")]
    got = {r.record_id.split(":")[0]: r for r in round_trip(spark, rows)}
    assert len(got) == len(rows)
    for i, url, html in rows:
        r, text = got[str(i)], html or ""
        assert r.digest == digest(text)
        last = max(j for j, _, h in rows if (h or "") == text)
        assert (r.kind, r.refers_to) == (("response", None) if last == i else ("revisit", str(last)))
        if last == i:
            assert (r.payload_bytes, r.payload_digest) == (len(text.encode()), digest(text))
            assert r.response.startswith("HTTP/1.1 200 OK\r\n")
        assert r.request == f"GET {r.url} HTTP/1.1\r\n\r\n"
        assert f"X-Payload-Bytes: {len(text.encode())}\r\n" in r.metadata
    assert got["5"].url == "v%0A%0Aw"


def test_small_payloads_may_all_be_responses(spark):
    got = round_trip(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long enough"), (4, "u", "long enough")], least_bytes=5)
    assert {r.record_id.split(":")[0]: r.kind for r in got} == {"1": "response", "2": "response", "3": "revisit", "4": "response"}


def test_null_ids_repeated_rows_and_empty_tables(spark):
    got = round_trip(spark, [(None, "u", "x"), (1, "u", "x"), (2, "u", "y"), (2, "u", "y")])
    assert sorted((r.record_id.split(":")[0], r.kind) for r in got) == [("1", "response"), ("2", "response"), ("2", "response"), ("null", "revisit")]
    assert round_trip(spark, []) == []


def test_orphans_and_missing_parts(spark):
    records = spark.createDataFrame([("response", "r1", None, None, "u", "sha1:D", 1, "D", "b"), ("request", "q1", "r1", None, "u", None, None, None, "q"),
                                     ("request", "q0", "r1", None, "u", None, None, None, "first"), ("metadata", "m9", "r9", None, "u", None, None, None, "m"),
                                     ("request", "q2", None, None, "u", None, None, None, "lost")],
                                    "kind string, record_id string, concurrent_to string, refers_to string, url string, digest string, payload_bytes long, payload_digest string, block string")
    (one,) = warc.assemble(records).collect()
    assert (one.record_id, one.request, one.metadata, one.digest) == ("r1", "first", None, "D")


def test_the_version_at_the_end_of_a_payload_or_url(spark):
    rows = [(1, "http://a/x", "see WARC/1.1"), (2, "http://a/WARC/1.1", "b\\WARC/1.1"), (3, "u", "WARC/1.1"), (4, "v", "WARC/1.1\r\nWARC/1.1")]
    got = {r.record_id.split(":")[0]: r for r in round_trip(spark, rows)}
    assert {i: (r.payload_bytes, r.payload_digest) for i, r in got.items()} == {str(i): (len(h), digest(h)) for i, _, h in rows}
    assert got["2"].url == "http://a/WARC%2F1.1" and got["2"].request == "GET http://a/WARC%2F1.1 HTTP/1.1\r\n\r\n"
