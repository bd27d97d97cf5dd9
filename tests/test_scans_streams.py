"""Data sources over recorded answers, status streams, downloads, observed components."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from quirelight.operators import downloads, fetching, retrieval, tracking
from quirelight.plans import observed
from quirelight.sources import scans
from quirelight.sources.snapshots import Store
from quirelight.streaming import statuses
from tests.answers import BODY

CATALOGUE, WORKS, FILES = ("tests.answers:catalogue", "tests.answers:works", "tests.answers:files")


@pytest.fixture(scope="module")
def known(spark):
    scans.register(spark)
    return spark


def formatted(df):
    return df._jdf.queryExecution().toString()


# ---- catalogues


def test_catalogue_pages(known):
    read = known.read.format("catalogue").option("transport", CATALOGUE).option("pause", 0)
    rows = read.load("https://host.org/publications").collect()
    assert sorted((r.page, r.nth) for r in rows) == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (2, 3), (3, 0), (3, 1), (5, 0), (5, 1)]  # page 4 fails
    one = next(r for r in rows if r.page == 5 and r.nth == 1)
    assert (one.title, one.pub_url, one.year) == ("Title 11", "https://host.org/publication/p11", 2011)
    assert [r.page for r in read.load("https://host.org/plain").select("page").distinct().collect()] == [1]  # no settings: one page
    assert read.load("https://host.org/gone").count() == 0
    some = read.load("https://host.org/publications").where("page in (2, 3)")
    assert some.rdd.getNumPartitions() == 2 and some.count() == 6


def test_catalogue_scan_with_a_limit(known):
    scan = lambda limit=0: scans.scan_catalogue(known, "https://host.org/publications", limit, transport=CATALOGUE, pause="0")
    assert sorted(r.title for r in scan().collect()) == sorted(f"Title {k}" for k in (*range(8), 10, 11))  # each once
    assert [r.title for r in scan(2).collect()] == ["Title 0", "Title 1"]
    assert {r.page for r in scan(20).collect()} == {1, 2}  # 20 are reckoned to be on two pages


def test_told_pages():
    assert scans.told_pages("") == 0 and scans.told_pages('<script>FWP_JSON = {"preload_data": 3};</script>') == 0
    assert scans.told_pages('FWP_JSON = {"preload_data": {"settings": {"pager": {"total_pages": 7}}}};</script>') == 7


# ---- works


def test_works_follow_the_cursor(known, tmp_path):
    read = known.read.format("works").option("transport", WORKS).option("pause", 0)
    rows = read.option("authors", "A7,A8").load(f"file://{tmp_path}")
    assert rows.rdd.getNumPartitions() == 2 and sorted((r.author, r.id[-2:]) for r in rows.collect()) == [(a, w) for a in ("A7", "A8") for w in ("W1", "W2", "W3")]
    with pytest.raises(Exception, match="status 500"):  # a part must not pass for the whole
        read.option("authors", "13").load(f"file://{tmp_path}").count()
    assert read.option("authors", "A14").load(f"file://{tmp_path}").count() == 3  # every status is tried again here


def test_filters_reach_the_address(known, tmp_path):
    read = known.read.format("works").option("transport", WORKS).option("pause", 0)
    asked = read.load(f"file://{tmp_path}").where("author = 'A7' and year = 2003 and version != 'submittedVersion'")
    asked.collect()
    lines = (tmp_path / "asked").read_text().splitlines()
    assert lines[0] == "filter=authorships.author.id:A7,publication_year:2003,primary_location.version:!submittedVersion&cursor=*&per-page=200"
    assert lines[-1].endswith("&cursor=b&per-page=200") and len(lines) == 3
    plan = formatted(read.load(f"file://{tmp_path}").where("author = 'A7' and year = 2003").select("id"))
    assert " Filter " not in plan.partition("Physical Plan")[2]  # they are the source's
    with pytest.raises(Exception, match="name the authors"):
        read.load(f"file://{tmp_path}").count()
    assert scans.works_address("b", "AA1", None, "v", None, None, "me@x") == "b/works?filter=authorships.author.id:AA1,primary_location.version:v&mailto=me@x&per-page=200"


def test_endless_empty_pages(tmp_path):
    reader = scans.WorksReader({"path": "x", "authors": "A1", "empty": "3"})
    reader.page = lambda author, cursor: ([], "next")
    with pytest.raises(OSError, match="3 empty pages"):
        list(reader.read(reader.partitions()[0]))


def test_works_as_a_stream(known, tmp_path):
    def go():
        rows = known.readStream.format("works").option("transport", WORKS).option("pause", 0).option("authors", "A7").load(f"file://{tmp_path}")
        rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start().processAllAvailable()
        for q in known.streams.active:
            q.stop()

    go()
    go()  # the cursor is at its end: nothing comes twice
    assert sorted(r.id[-2:] for r in known.read.parquet(f"{tmp_path}/out").collect()) == ["W1", "W2", "W3"]


# ---- statuses


EVENTS = "publication long, stage string, status string, error string, moment timestamp, tie long"


def test_status_stream_is_the_fold(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    done = F.col("value") >= 50
    rows = events.select(F.col("user_id").cast("long").alias("publication"), F.col("event_type").alias("stage"), F.when(done, "Done").otherwise("Failed").alias("status"), F.when(done, F.lit(None).cast("string")).otherwise(F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error"), F.col("ts").cast("timestamp").alias("moment"), F.col("event_id").cast("long").alias("tie")).persist()
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    go = lambda: statuses.update_stream(spark.readStream.schema(EVENTS).parquet(source), sink, state).awaitTermination()
    # in three batches, and within them in no order of time
    for part in (2, 0, 1):
        rows.where(F.pmod(F.xxhash64("tie"), F.lit(3)) == part).orderBy(F.xxhash64("tie", F.lit(1))).write.mode("append").parquet(source)
        go()
    go()  # started again from its checkpoint, nothing new
    want = tracking.folded(rows, ["publication", "stage"], "status", ["moment", "tie"], "error")
    columns = ["publication", "stage", "status", "attempts", "updated", "error"]
    got = Store(spark, sink).read("statuses").select(*columns)
    key = lambda r: (r.publication, r.stage)
    assert sorted(got.collect(), key=key) == sorted(want.select(*columns).collect(), key=key) and got.count() > 50


def test_status_batch_that_dies_after_publishing(spark, tmp_path, monkeypatch):
    from quirelight.sources import snapshots

    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = spark.createDataFrame([(1, "download", "Failed", "x", 1), (1, "download", "Done", None, 2)], "publication long, stage string, status string, error string, tie long").withColumn("moment", F.lit("2024-01-01").cast("timestamp"))
    rows.select(*[c.split()[0] for c in EVENTS.split(", ")]).write.parquet(source)
    go = lambda: statuses.update_stream(spark.readStream.schema(EVENTS).parquet(source), sink, state).awaitTermination()
    commit = snapshots.Transaction.commit

    def dies(self):
        commit(self)
        raise RuntimeError("killed")

    with monkeypatch.context() as m, pytest.raises(Exception):
        m.setattr(snapshots.Transaction, "commit", dies)
        go()
    version = Store(spark, sink).version()
    go()
    assert Store(spark, sink).version() == version
    assert [(r.status, r.attempts, r.error) for r in Store(spark, sink).read("statuses").collect()] == [("Done", 2, None)]


# ---- downloads


def test_download_executor(spark, tmp_path):
    names = ["a.pdf", "b.bin", "broken.pdf", "missing.pdf", "busy.pdf", "small.pdf", "resumed.pdf", "whole.pdf", "wrong.pdf", "norange.pdf", "there.pdf"]
    plan = spark.createDataFrame([(n, f"https://h{len(n) % 3}.org/{n}", f"docs/{n}") for n in names] + [("again", "https://h9.org/a.pdf", "docs/a.pdf")], "key string, url string, path string")
    os.makedirs(tmp_path / "docs")
    (tmp_path / "docs/resumed.pdf.part").write_bytes(BODY[:1000])
    (tmp_path / "docs/norange.pdf.part").write_bytes(b"other bytes")
    (tmp_path / "docs/whole.pdf.part").write_bytes(BODY)
    (tmp_path / "docs/wrong.pdf.part").write_bytes(BODY + b"more")
    (tmp_path / "docs/there.pdf").write_bytes(b"x" * 2000)
    go = lambda: {r.key: r for r in fetching.fetch_all(plan, str(tmp_path), FILES, tasks=4, pause=0.0).collect()}
    got = go()
    fine = {"a.pdf", "b.bin", "broken.pdf", "resumed.pdf", "whole.pdf", "wrong.pdf", "norange.pdf", "again"}
    assert {k for k, r in got.items() if r.success} == {*fine, "there.pdf"} and got["there.pdf"].cached
    assert all((tmp_path / got[k].path).read_bytes() == BODY for k in fine) and got["b.bin"].path == "docs/b.pdf"
    assert {k: r.error for k, r in got.items() if not r.success} == {"missing.pdf": "status 404", "busy.pdf": "status 503", "small.pdf": "too small"}
    assert not [f for f in os.listdir(tmp_path / "docs") if f.endswith(".part")]
    assert all(r.cached for k, r in go().items() if k in fine - {"b.bin"})  # nothing is asked for again
    rolled = downloads.rolled_up(fetching.fetch_all(plan, str(tmp_path), FILES, tasks=4, pause=0.0).withColumn("of", F.lit("p")), "of", "success", "error", "path").first()
    assert rolled.status == "Failed" and "status 404" in rolled.error


def test_partial_files_stay_after_a_failure(tmp_path):
    answer = lambda url, start: fetching.Answer(206 if start else 200, {"content-length": str(len(BODY) - start), "content-range": f"bytes {start}-/{len(BODY)}" if start else ""}, iter([BODY[start : start + 1500]]))
    got = fetching.fetch_one(answer, "u", str(tmp_path / "d/x.pdf"), tries=3, pause=0.0)
    assert got[1] is False and got[5] == f"4500 of {len(BODY)} bytes" and (tmp_path / "d/x.pdf.part").read_bytes() == BODY[:4500]
    assert fetching.fetch_one(answer, "u", str(tmp_path / "d/x.pdf"), tries=9, pause=0.0)[1] is True and (tmp_path / "d/x.pdf").read_bytes() == BODY
    shutil.rmtree(tmp_path / "d")


def test_hashed_plan(spark):
    rows = spark.createDataFrame([("W1", ["https://a.org/x/Paper.PDF?v=1#top", "https://a.org/x/Paper.PDF?v=2", "https://b.org/plain", "https://c.org"])], "id string, urls array<string>")
    got = [r.path for r in downloads.hashed_plan(rows, "id", "urls").collect()]
    import hashlib

    name = lambda url: hashlib.md5(url.encode()).hexdigest()
    folder = "raw/documents/openalex/W1/"
    assert got == [folder + name("https://a.org/x/Paper.PDF") + ".pdf"] * 2 + [folder + name("https://b.org/plain"), folder + name("https://c.org")]
    assert downloads.hashed_plan(rows, "id", "urls", ".pdf").collect()[2].path.endswith(".pdf")


# ---- what is observed


def test_observed_components(spark):
    run = observed.observed(spark, "count", lambda: {"rows": spark.range(1000).repartition(5).groupBy((F.col("id") % 7).alias("k")).count().count()})
    other = observed.observed(spark, "none", lambda: {})
    got, none = run()["spark"], other()["spark"]
    assert got["tasks"] >= 5 and got["stages"] >= 2 and got["shuffle_written_mb"] > 0 and got["seconds"] > 0 and got["begun"] < got["ended"] and got["driver_rss_mb"] > 10
    assert none["tasks"] == none["stages"] == 0
    table = observed.stage_table(spark, {"count": run, "none": other})
    assert table.where("component = 'count' and status = 'COMPLETE'").count() == got["stages"]

    def breaks():
        spark.range(10).count()
        raise ValueError("no")

    failing = observed.observed(spark, "fails", breaks)
    with pytest.raises(ValueError):
        failing()
    assert failing.stages


# ---- the agent


def test_agent_cites(spark):
    hits = spark.createDataFrame([(f"p{k}", 1.0 / k, k, f"Title {k}", 2000 + k) for k in (1, 2)], "id string, score double, rank int, document_title string, document_year int")
    cite = lambda query, found: spark.createDataFrame([(1, "", "q1"), (2, "Given", "q2"), (9, "", "q9")], "source_number int, document_title string, quote string")
    agent = retrieval.Agent(lambda *_: hits, cite=cite, fill=("document_title", "document_year", "absent"))
    told = agent.ask("x")
    assert {(r.source_number, r.document_title, r.document_year, r.quote) for r in told["citations"].collect()} == {(1, "Title 1", "2001", "q1"), (2, "Given", "2002", "q2"), (9, None, None, "q9")}

    def broken(*_):
        raise ValueError

    assert retrieval.Agent(lambda *_: hits, cite=broken).ask("x")["citations"] is None
    assert retrieval.Agent(lambda *_: hits, synthesise=broken).ask("x")["answer"] == "No answer could be made."
    assert retrieval.analysed("trade policy in Kenya and growth of exports; debt")[0] == ["trade policy in Kenya and growth of exports; debt", "trade policy in Kenya", "growth of exports"]
    assert retrieval.analysed("black and white")[0] == ["black and white"]
