"""One response a group of equal payloads whatever repeats; columns named as the operators' own."""

from pyspark.sql import functions as F

from meshlens.llm import substrings, warc


def test_one_response_of_tied_rows(spark):
    rows = [(7, "b", "x"), (7, "a", "x"), (7, None, "x"), (7, "a", "x"), (3, "c", "x"), (None, "d", "x"), (4, "e", "y"), (4, "e", "y"), (5, "f", "z"), (None, "g", None), (9, "h", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    want = [(False, 3, 1, "revisit", 7), (False, 4, 1, "response", None), (False, 4, 1, "revisit", 4), (False, 5, 1, "response", None)]
    want += [(False, 7, 1, "response", None), *[(False, 7, 1, "revisit", 7)] * 3, (False, 9, 0, "response", None), (True, 0, 0, "revisit", 9), (True, 0, 1, "revisit", 7)]
    assert got == want
    lead = warc.page_records(pages).where("record_id = '<urn:page:7>' AND record_type = 'response'").collect()
    assert [(r.target_uri, bytes(r.payload)) for r in lead] == [(None, b"x")]


def test_cuts_keep_columns_of_any_name(spark):
    shared = " ".join(f"word{i}" for i in range(60))
    rows = [(1, f"one {shared} end", "k1", 5), (2, f"two {shared} fin", "k2", 6), (3, None, None, 7), (3, "", "k3", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, _Spans long").withColumn("_least", F.lit(1)).withColumn("_n", F.lit("n"))
    out = substrings.cut_passages(docs)
    assert out.columns == docs.columns
    got = {(r.doc_id, r._key): r for r in out.collect()}
    assert {k: v["_Spans"] for k, v in got.items()} == {(1, "k1"): 5, (2, "k2"): 6, (3, None): 7, (3, "k3"): 8}
    assert sorted(len(got[k].text.split()) for k in ((1, "k1"), (2, "k2"))) == [2, 62]
