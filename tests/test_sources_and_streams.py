import json

from pyspark.sql import functions as F

from siftline.sources import connector as C, feeds as S
from siftline.streaming import state as ST


def pages(spark, *payloads):
    return spark.createDataFrame([(f"u{i}", p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)], "url string, payload string")


def test_registry(spark):
    assert C.adapter("paged").complete_listing and {"rss", "jsonld", "hits"} <= {r.name for r in C.adapters_table(spark).collect()}
    try:
        C.adapter("nope")
    except KeyError as e:
        assert "paged" in str(e)


def test_fetch_by_files(spark, tmp_path):
    (tmp_path / "site_a").write_text("payload A")
    df = C.fetch(spark, ["http://site/a", "http://site/b"], root=str(tmp_path))
    got = {r.url: r for r in df.collect()}
    assert got["http://site/a"].payload == "payload A" and got["http://site/b"].error
    assert C.decoded("ä".encode("windows-1252")) == "ä"


def test_json_feeds(spark):
    data = {"data": [{"slug": "a", "title": " Dev  one ", "company_name": "X", "location": "Berlin, Germany", "remote": True, "tags": ["t", "t"], "created_at": 1704164645}, {"slug": "a", "title": "again"}, {"title": "no id"}, "junk"]}
    got = C.adapter("paged").parse(pages(spark, data, "not json", {"data": 5})).collect()
    assert len(got) == 1 and (got[0].title, got[0].country, got[0].remote, got[0].tags) == ("Dev one", "DE", "remote", ["t"])
    notice = [{"legal": "x"}, {"id": 7, "position": "Dev", "company": "Y", "epoch": 1704164645}]
    assert [r.source_id for r in C.adapter("noticed").parse(pages(spark, notice)).collect()] == ["7"]


def test_dimension_and_languages(spark):
    places = spark.createDataFrame([("town", 1, "Tartu"), ("county", 2, "Tartumaa")], "kind string, id long, name string")
    r = S.parse_dimension(pages(spark, {"vacancies": [{"id": 1, "positionTitle": "Dev", "townId": 1, "countyId": 2, "salaryFrom": 1000, "salaryTo": 2000}]}), places).first()
    assert (r.city, r.location_raw, r.country, r.salary_text) == ("Tartu", "Tartu, Tartumaa", "EE", "1 000–2 000 EUR")
    m = S.parse_multilingual(pages(spark, {"content": [{"id": "z", "title": {"sv": "Utv", "en": "Dev", "fi": ""}, "location": {"countries": ["FI"]}}]})).first()
    assert m.title == "Dev" and m.country == "FI"


def test_xml(spark):
    rss = "<rss xmlns:tt='x'><channel><item><title>Acme: Dev &amp; Ops</title><link>http://j/1</link><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate><skills>Python, and Rust</skills><tt:region>Europe</tt:region></item><item><title>Plain</title><link>http://j/2</link></item></channel></rss>"
    got = {r.url: r for r in S.parse_rss(pages(spark, rss)).collect()}
    assert (got["http://j/1"].company, got["http://j/1"].title, got["http://j/1"].tags, got["http://j/1"].location_raw) == ("Acme", "Dev & Ops", ["Python", "Rust"], "Europe") and got["http://j/2"].company is None
    site = "<urlset xmlns=\"http://s\"><url><loc> http://a </loc></url><url><loc>http://b</loc></url><url><loc>http://a</loc></url><url><loc>x</loc></url></urlset>"
    assert [r.url for r in S.sitemap_urls(pages(spark, site)).orderBy("place").collect()] == ["http://a", "http://b"]


def test_html(spark):
    ld = {"@graph": [{"@id": "http://x/#org", "@type": "Organization", "name": "Org"}, {"@type": "JobPosting", "title": "Dev", "hiringOrganization": {"@id": "http://x/#org"}, "jobLocation": {"address": {"addressLocality": "Espoo", "addressCountry": "FI"}}, "datePosted": "2024-01-02", "baseSalary": {"currency": "EUR", "value": {"minValue": 10, "maxValue": 20, "unitText": "HOUR"}}}]}
    r = S.parse_json_ld(pages(spark, f"<html><script type='application/ld+json'>{json.dumps(ld)}</script>", "<script type='application/ld+json'>{bad</script>")).first()
    assert (r.title, r.company, r.country, r.city, r.salary_text) == ("Dev", "Org", "FI", "Espoo", "10–20 EUR / hour")
    c = S.cards(pages(spark, '<job-card title="A" url="/a"></job-card><job-card title="B" url="/b" is-promoted></job-card>'), "job-card", {"title": "title", "link": "url"}, "is-promoted").collect()
    assert [(x.title, x.link) for x in c] == [("A", "/a")]
    df = spark.createDataFrame([("indeed", '{"isJobExpired":true}', 200), ("x", "fine", 200), ("x", None, 404), ("x", "Just a moment", 200), ("x", None, None)], "s string, h string, c int")
    assert [r[0] for r in df.select(S.closed_page(F.col("s"), F.col("h"), F.col("c"))).collect()] == ["closed", "open", "gone", "unknown", "unknown"]


def test_hydrate_and_bad_rows(spark):
    light = spark.createDataFrame([("1", "t", "remote"), ("2", "u", "onsite")], "id string, body string, remote string")
    detail = spark.createDataFrame([("1", "full", "unknown"), ("2", "", "hybrid")], "id string, body string, remote string")
    assert sorted(map(tuple, C.hydrate(light, detail, "id", ["body", "remote"]).collect())) == [("1", "full", "remote"), ("2", "u", "hybrid")]
    good, bad = C.split_bad(light, F.col("body") == "t")
    assert (good.count(), bad.count()) == (1, 1)


def test_files(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id":"1","label":"good"}\n\n{broken\n{"id":"2","label":""}\n')
    assert sorted(r.id for r in C.read_labels(spark, str(tmp_path / "l.jsonl"), "id string, label string").collect() if r.id) == ["1", "2"]
    (tmp_path / "b.csv").write_text("name,url\nAcme Inc,u1\nacme-inc,u2\nOther,u3\n")
    assert {r.board_key: r.url for r in C.read_boards(spark, str(tmp_path / "b.csv"), "name").collect()} == {"acmeinc": "u1", "other": "u3"}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    for i in range(3):
        events.filter(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(source)
    table = ST.TableState(spark, state, "user_id", ["first_seen"], ["last_seen"])
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    shape = lambda b: b.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    q = stream.writeStream.foreachBatch(table.sink(shape)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(table.versions()) == 3
    assert {r.user_id for r in table.read().collect()} == {r.user_id for r in events.select("user_id").distinct().collect()}
    before = sorted(map(tuple, table.read().collect()))
    last = table.versions()[-1]
    table.merge(shape(events.limit(0)), last + 1)
    assert sorted(map(tuple, table.read().collect())) == before
