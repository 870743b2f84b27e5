from pyspark.sql import functions as F

from loomline.llm import decontamination as D, url_filter as U


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "x.org/a", "http://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "ftp://badexample.org/es/", "a://b.com/fr/?x", "a://b.com#/fr/", "://com/de/x", "http://é.COM/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("HOST", F.lit(1))
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (1, None)], "id long, bad int")
    rows = {r.page_id: r for r in U.judged(pages, labels, U.RULES).collect()}
    got = {i: (r.host, r.path, r.rule) for i, r in rows.items()}
    assert got == {
        0: ("", "", None), 1: ("", "", None), 2: ("", "", None), 3: ("a.example.org", "/es/x", "example.org/es/"), 4: ("example.org", "/en/12", "example.org/en/1"),
        5: ("badexample.org", "/es/", "org/"), 6: ("b.com", "/fr/", "com/fr/"), 7: ("b.com", "", None), 8: ("com", "/de/x", "com/de/"), 9: ("é.com", "/de/", "com/de/"),
    }
    assert [rows[i].verdict for i in (3, 4, 5, 6, 8)] == ["block", "block", "allow", "allow", "block"]
    many = U.RULES + [("allow", f"h{i}.net", "/") for i in range(300)]
    assert {r.page_id: r.rule for r in U.judged(pages, labels, many).collect()} == {i: x[2] for i, x in got.items()}
    assert U.judged(pages.limit(0), labels, U.RULES).count() == 0


def test_bad_hosts_are_blocked_and_unknown_ones_shrink(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i < 60 else 'good'}{i % 3}.site{int(i < 60)}.net/") for i in range(120)] + [(999, "http://new.site0.net/")], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "id long, bad int")
    rows = {r.page_id: r for r in U.judged(pages, labels, []).collect()}
    assert all(rows[i].verdict == ("block" if i < 60 else "allow") for i in range(120)) and rows[999].verdict == "allow"
    assert rows[0].bad_rate < 1 and rows[100].bad_rate > 0


def test_contamination_of_odd_texts(spark):
    item = " ".join(f"w{i}" for i in range(15))
    bench = spark.createDataFrame([(1, item), (1, item), (2, "Short One"), (3, None), (4, "..."), (None, "x y")], "item_id long, text string")
    texts = [None, "", "!!", item.upper(), "a, " + item + " b", "short-ONE", "w0 w1", "x y", item, item]
    docs = spark.createDataFrame([(None if i > 7 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("N_hit", F.lit("s"))
    rows = D.judged(docs, bench).collect()
    assert len(rows) == len(texts)
    by = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in rows}
    assert by == {0: (0, 0, 0, False), 1: (0, 0, 0, False), 2: (0, 0, 0, False), 3: (15, 15, 1, True), 4: (17, 15, 1, True), 5: (2, 2, 1, True), 6: (2, 0, 0, False), 7: (2, 0, 0, False), None: (15, 15, 1, True)}
    assert D.judged(docs, bench.limit(0)).where("contaminated").count() == 0 and D.judged(docs.limit(0), bench).count() == 0


def test_join_without_broadcast_gives_the_same(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(str, D.judged(docs, bench).collect()))
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    assert sorted(map(str, D.judged(docs, bench).collect())) == one


def test_long_documents_and_hot_words_by_shuffle(spark, monkeypatch):
    text = " ".join(["the"] * 5000 + [f"w{i % 40}" for i in range(15000)])
    bench = spark.createDataFrame([(i, " ".join(f"w{(i + k) % 40}" for k in range(14))) for i in range(40)] + [(99, "the " * 13)], "item_id long, text string")
    docs = spark.createDataFrame([(1, text), (2, "the w1"), (3, None)], "doc_id long, text string")
    one = sorted(map(str, D.judged(docs, bench).collect()))
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    assert sorted(map(str, D.judged(docs, bench).collect())) == one and "n_hit=20000" in one[0]
