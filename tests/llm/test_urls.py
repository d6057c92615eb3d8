from eventloom.llm import urls


def test_query_and_port_are_part_of_a_url(spark):
    entries = ["h.example.com/item?id=7", "h.example.com:8080/p", "h.example.com:8080/q?a=b"]
    lists = spark.createDataFrame([("l", "url", e, "block", 0, 100) for e in entries], "list string, kind string, entry string, verdict string, valid_from long, valid_to long")
    yes = ["http://H.example.com/item?id=7#top", "http://u@h.example.com:8080/p", "h.example.com:8080/q?a=b", "h.example.com:8080/p?x"]
    no = ["http://h.example.com/item?id=8", "http://h.example.com/item", "http://h.example.com/p", "http://h.example.com/q?a=b"]
    got = urls.decide(spark.createDataFrame([(u, 10) for u in yes + no], "url string, fetched_at long"), lists)
    assert {r.url: (r.url_filter.blocked, r.url_filter.n_active) for r in got.collect()} == {u: (u in yes, int(u in yes)) for u in yes + no}
