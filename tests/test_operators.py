"""Operators without a query of their own, against literal expectations."""

import json
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirelight.functions import ids, paths, text
from quirelight.operators import catalog, chunking, downloads, ingest, metrics, retrieval, tracking, transcripts
from quirelight.plans import extensions, runner, service, stages
from quirelight.sources import readers, sql, storage, writers
from quirelight.sources.snapshots import Store
from quirelight.streaming import files

L = chunking.Limits


def one(spark, column, **values):
    """The value of a column over one row."""
    kinds = {int: "long", float: "double", str: "string", bytes: "binary", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


# ---- text

ODD = "a b　c d e\x1ff g"


def test_white_space_is_pythons(spark):
    docs = spark.createDataFrame([(1, ODD)], "doc_id long, text string")
    assert chunking.fixed_windows(docs, L(10, 0, 1)).first().n_tokens == len(ODD.split()) == 7
    assert [c.n_tokens for c in chunking.chunks(docs, "fixed", L(10, 0, 1)).collect()] == [7]
    for raw in (ODD, "  x  ", "\x85y\x1c", "  "):
        assert one(spark, text.strip(F.col("t")), t=raw) == raw.strip()
        assert one(spark, text.normalize_text(F.col("t")), t=raw) == re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", raw.lower())).strip()
        assert one(spark, text.clean_text(F.col("t")), t=raw) == chunking._clean(raw)
        assert one(spark, text.sentences(F.col("t")), t="One!　Two. " + raw) == chunking.split_sentences("One!　Two. " + raw)


def test_markers_end_at_line_feeds_only(spark):
    for raw in ("--- Page 1 ---\nab\x85--- Page 2 ---\ncd", "x\n--- Page 3 ---  \ny", "--- Page 4 ---"):
        assert one(spark, text.clean_text(F.col("t")), t=raw) == chunking._clean(raw)
        spans = one(spark, chunking.page_spans(F.col("t")), t=raw)
        pages = chunking.Pages(raw)
        assert [tuple(s) for s in spans] == list(zip(pages.numbers, pages.starts, pages.ends, strict=True))


def test_sparse_vectors_are_shuffled_once(spark):
    rows = [(1, "b a b C"), (1, "x b y z"), (1, "b q"), (2, ""), (3, None), (4, "ж! É"), (5, "a-a a1"), (None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = retrieval.sparse_vectors(docs)
    want = ingest.sparse_vectors(retrieval.document_vectors(docs))
    plain = lambda found: {r.id: [(x.term, pytest.approx(x.weight, rel=1e-15)) for x in r.sparse] for r in found.collect()}
    assert plain(got) == plain(want) and len(got.where("id = 1").first().sparse) == 8
    ids = spark.range(9).withColumnRenamed("id", "key")
    plan = ids.hint("merge").join(got, F.col("key") == F.col("id"), "left")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(id#") == 1 and "Generate" not in plan


def test_force_split_does_not_carry_a_text_to_each_window(spark):
    words = [f"w{k}" for k in range(50_001)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " " + ODD + " "), (3, ""), (4, None)], "doc_id long, text string")
    out = chunking.force_split(docs, 200, 20)
    got = {(r.doc, r.part): (r.n_tokens, r.text) for r in out.collect()}
    want = {(1, i): (len(words[s : s + 200]), (" " if s else "") + " ".join(words[s : s + 200])) for i, s in enumerate(range(0, len(words), 180))}
    assert got == want | {(2, 0): (7, " " + ODD)}
    assert "Generate" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("strategy", list(chunking.STRATEGIES))
def test_chunks_are_handed_on_before_a_batch_is_done(strategy):
    body = "# A\n" + "some words here. " * 2000 + "\n# B\n" + "more words there. " * 2000
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(202)]), pa.array([body] * 200 + ["", None])], names=["doc", "text"])
    out = list(chunking._attempted(iter([batch]), strategy, L(100, 20, 20, 200), chunking.plain_tokens))
    chars = [sum(len(t or "") for t in b.column(8).to_pylist()) for b in out]
    assert max(chars) < chunking._OUT_CHARS + 2 * len(body) and sum(chars) > 200 * 2000 * 20
    want = chunking.create_chunks(body, strategy, L(100, 20, 20, 200))
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["doc"], r["chunk_index"], r["text"]) for r in rows[:-2]] == [(str(k), i, c.text) for k in range(200) for i, c in enumerate(want)]
    assert [(r["doc"], r["error"]) for r in rows[-2:]] == [("200", "Empty text file"), ("201", "Empty text file")]


@pytest.mark.parametrize(("value", "shown"), [(10, "10 B"), (2048, "2.0 KB"), (3 * 1024 * 1024, "3.0 MB")])
def test_human_size(spark, value, shown):
    assert one(spark, text.human_size(F.col("n")), n=value) == shown


@pytest.mark.parametrize(("seconds", "shown"), [(5.25, "5.3s"), (65.0, "1m 5s"), (3720.0, "1h 2m")])
def test_human_duration(spark, seconds, shown):
    assert one(spark, text.human_duration(F.col("s")), s=seconds) == shown


@pytest.mark.parametrize(("raw", "bare"), [("https://doi.org/10.1/A", "10.1/a"), ("doi: 10.2/b", "10.2/b"), (" http://dx.doi.org/10.3/c ", "10.3/c"), ("x.org/1", None)])
def test_normal_doi(spark, raw, bare):
    assert one(spark, text.normal_doi(F.col("d")), d=raw) == bare


@pytest.mark.parametrize(("raw", "full"), [("/a", "https://x.org/a"), ("//y.org/a", "https://y.org/a"), ("http://z.org", "http://z.org")])
def test_absolute(spark, raw, full):
    assert one(spark, text.absolute(F.col("u"), "https://x.org"), u=raw) == full


def test_reference_line(spark):
    line = text.reference_line(F.array(F.lit("A"), F.lit("B")), F.lit(2020), F.lit("T"), F.lit("u"))
    assert one(spark, line, x="") == "A, B (2020). T. u"
    assert one(spark, text.reference_line(F.array().cast("array<string>"), F.lit(None).cast("int"), F.lit("T"), F.lit(None).cast("string")), x="") == "T."


@pytest.mark.parametrize(("authors", "names"), [("Last, F. & Other, G.", ["Last, F.", "Other, G."]), ("Last, F., Other, G.", ["Last, F.", "Other, G."]), ("", []), ("One", ["One"])])
def test_split_authors(spark, authors, names):
    assert one(spark, text.split_authors(F.col("a")), a=authors) == names


@pytest.mark.parametrize(("name", "kind", "fixed"), [("a.bin", "application/pdf", "a.pdf"), ("a.pdf", "application/msword; x", "a.doc"), ("a.pdf", "text/html", "a.pdf"), ("a", "application/vnd.ms-excel", "a.xls")])
def test_corrected_name(spark, name, kind, fixed):
    assert one(spark, downloads.corrected_name(F.col("n"), F.col("k")), n=name, k=kind) == fixed


@pytest.mark.parametrize(("status", "part", "size", "total", "action"), [(206, True, 5, 9, "append"), (200, True, 5, 9, "restart"), (416, True, 9, 9, "complete"), (416, True, 5, 9, "discard and restart"), (503, False, 0, 9, "retry"), (404, False, 0, 9, "fail")])
def test_resume(spark, status, part, size, total, action):
    assert one(spark, downloads.resume(F.col("s"), F.col("p"), F.col("z"), F.col("t")), s=status, p=part, z=size, t=total) == action


def test_pdf_predicate(spark):
    rows = spark.createDataFrame([("a.PDF", b""), ("b.bin", b"%PDF-1"), ("c.pdf.part", b"%PDF-1"), ("d.txt", b"x")], "path string, content binary")
    assert [r.path for r in rows.where(downloads.is_pdf(F.col("path"), F.col("content"))).collect()] == ["a.PDF", "b.bin"]


# ---- chunks


def test_limits():
    assert L(0, 50, 50, 2000).fitted() == L(1, 0, 1, 2000)
    assert L(500, 600, 50, 2000).fitted() == L(500, 50, 50, 2000)
    assert L(5000, 10, 50, 9000).fitted(8192) == L(5000, 10, 50, 8092) and L(9000, 10, 50, 9000).fitted(1100).size == 1000


SECTIONS = "# One\nalpha beta gamma\n\n# Two\ndelta epsilon zeta\n\n# Three\neta theta iota kappa"


def test_section_chunks_end_where_the_section_ends():
    got = chunking.create_chunks(SECTIONS, "structure", L(10, 0, 2, 20))
    assert [(c.title, c.start, c.end) for c in got] == [(None, 0, 24), ("# Two", 24, 50), ("# Three", 50, len(SECTIONS) + 1)]
    assert [c.text for c in got] == ["# One\nalpha beta gamma", "# Two\ndelta epsilon zeta", "# Three\neta theta iota kappa"]
    assert [c[1:4] for c in chunking.create_chunks(SECTIONS, "hybrid", L(10, 0, 2, 20))] == [c[1:4] for c in got]


def test_large_sections():
    words = " ".join(f"w{k}." for k in range(60))
    got = chunking.create_chunks(f"--- Page 7 ---\nTITLE:\nx y z\n# Big\n{words}", "structure", L(20, 5, 2, 40))
    assert [c.title for c in got][:2] == [None, "# Big"] and {(c.start, c.end, tuple(c.pages)) for c in got[1:]} == {(13, 13 + 6 + len(words) + 1, (7,))}
    assert all(len(c.text.split()) <= 40 for c in got)
    hybrid = chunking.create_chunks(f"TITLE:\nx y z\n# Big\n{words}", "hybrid", L(20, 5, 2, 40))
    assert all(c.end == c.start + len(c.text) for c in hybrid[1:])
    assert hybrid[2].text.split()[:5] == hybrid[1].text.split()[-5:]  # the overlap


def test_pages_of_every_strategy(spark):
    raw = "\n".join(f"--- Page {p} ---\n# Part {p}\n" + " ".join(f"p{p}w{k}." for k in range(30)) for p in (1, 2, 3))
    pages = chunking.Pages(raw)
    docs = spark.createDataFrame([(1, raw)], "doc_id long, text string")
    for strategy in chunking.STRATEGIES:
        rows = chunking.chunks(docs, strategy, L(20, 4, 5, 60)).orderBy("chunk_index").collect()
        assert [r.chunk_id for r in rows] == [f"1_chunk_{k:04d}" for k in range(len(rows))]
        for r in rows:
            want = sorted(n for n, a, b in zip(pages.numbers, pages.starts, pages.ends, strict=True) if r.char_start < b and r.char_end > a)
            assert r.pages == want
        assert {p for r in rows for p in r.pages} == {1, 2, 3}
    assert all(c.pages == [] for c in chunking.create_chunks("one two three", "fixed", L(2, 0, 1)))


def test_sentence_chunks_as_a_slow_fold_gives_them():
    """Sentences are added while their counts fit, each chunk opening with the last one's tail."""
    raw = " ".join(f"{'x ' * (k % 7)}s{k}{'.!?;'[k % 4]}" for k in range(200))
    limits, got, held = L(30, 6, 5, 100), [], ""
    for sentence in re.findall(r".*?[.!?;]+\s+|.+$", raw, re.S):
        if held and (len(held.split()) + len(sentence.split())) > limits.size:
            got.append(held.strip())
            held = " ".join(held.split()[-limits.overlap :]) + " " + sentence
        else:
            held += sentence
    got.append(held.strip())
    assert [" ".join(c.text.split()) for c in chunking.create_chunks(raw, "sentence", limits)] == [" ".join(g.split()) for g in got if len(g.split()) >= limits.least]


def test_statuses_and_tokenisers(spark):
    docs = spark.createDataFrame([(1, "one two. three"), (2, None), (3, " 　\n"), (4, "--- Page 1 ---")], "doc_id long, text string")
    got = {r.doc: (r.status, r.n_chunks, r.error) for r in chunking.statuses(chunking.attempts(docs, "hybrid", L(5, 0, 1))).collect()}
    assert got == {"1": ("SUCCESS", 1, None), "2": ("FAILED", 0, "Empty text file"), "3": ("FAILED", 0, "Empty text file"), "4": ("FAILED", 0, "No chunks")}
    with pytest.raises(ValueError):
        chunking.chunks(docs, "none")
    letters = chunking.chunks(docs.where("doc_id = 1"), "fixed", L(5, 0, 1), tokenise=list).collect()
    assert [r.text for r in letters] == ["one t", "wo. t", "hree"] and [r.n_tokens for r in letters] == [5, 5, 4]
    pieces = chunking.ranked_tokens("/opt/tokenizers/byte_bpe_50k.tiktoken")
    assert "".join(pieces("Zürich 漢字 is")) == "Zürich 漢字 is" and len(pieces("unbelievably")) > 1


def test_force_split_and_no_text(spark):
    docs = spark.createDataFrame([(1, " ".join("abcdefg")), (2, None), (3, "")], "doc_id long, text string")
    assert [r.text for r in chunking.force_split(docs, 3, 1).orderBy("part").collect()] == ["a b c", " c d e", " e f g", " g"]
    assert chunking.fixed_windows(docs, L(3, 0, 1)).count() == 3


# ---- retrieval


def test_retrieval_controls(spark):
    assert (retrieval.clamp(0), retrieval.clamp(99), retrieval.clamp(7)) == (1, 50, 7)
    assert retrieval.merged_filters({"year": 1, "a": 2}, {"year": 3, "b": None}) == {"year": 3, "a": 2} and retrieval.merged_filters({"year": 1}, {"a": 2}, 1) == {}
    rows = spark.createDataFrame([(1, 0, "x"), (2, 5, "")], "id long, year long, tag string")
    assert [r.id for r in retrieval.payload_filter(rows, {"year": 0, "tag": None}).collect()] == [1]
    assert retrieval.payload_filter(rows, {"year": 0, "tag": ""}, drop_falsy=True).count() == 2
    hits = spark.createDataFrame([(10, 1, "aaaa"), (20, 2, "bbbb"), (30, 3, "cccc")], "id long, rank int, t string")
    assert [r.id for r in retrieval.keep_listed(hits, [2, 0, 9, 2]).collect()] == [30, 10] and retrieval.keep_listed(hits, []).count() == 0
    assert retrieval.context(hits, "t", 2).first().context == "[0] aa\n\n[1] bb\n\n[2] cc"
    assert retrieval.analysed("growth in 1999") == (["growth in 1999"], {"year": 1999}) and retrieval.analysed("1999 to 2001")[1] == {} and retrieval.analysed("12001")[1] == {}


def test_merged_hits_keep_the_best_rows_payload(spark):
    hits = spark.createDataFrame([(1, 7, 0.5, 1, "low"), (2, 7, 0.9, 1, "high"), (2, 8, 0.5, 2, "b"), (1, 8, 0.5, 2, "a")], "query long, id long, score double, rank int, text string")
    assert [tuple(r) for r in retrieval.merged_queries(hits, 5).select("id", "score", "query", "text").collect()] == [(7, 0.9, 2, "high"), (8, 0.5, 1, "a")]


def test_agent(spark):
    calls = []
    hits = spark.createDataFrame([(5, 1)], "id long, rank int")

    def retrieve(queries, filters, k):
        calls.append((queries, filters, k))
        return hits if not filters else hits.limit(0)

    agent = retrieval.Agent(retrieve)
    found = agent.ask("trade in 2010", {"source": "a"}, 99)
    assert found["answer"] == "[1] 5" and calls == [(["trade in 2010"], {"year": 2010, "source": "a"}, 50), (["trade in 2010"], {}, 50)]

    def broken(_):
        raise RuntimeError

    assert retrieval.Agent(retrieve, analyse=broken, grade=broken).ask("x")["queries"] == ["x"]
    assert retrieval.Agent(lambda *a: hits.limit(0)).ask("x")["answer"] == "No relevant passages were found."
    for bad in ("", "x" * 2001):
        with pytest.raises(ValueError):
            agent.ask(bad)


# ---- points


def test_collection(spark, tmp_path):
    vectors = spark.createDataFrame([("c1", [1.0]), ("c2", [2.0]), ("c3", [3.0])], "key string, dense array<double>")
    chunks = spark.createDataFrame([("c1", "d", "t1", 1, 5, [2]), ("c2", "d", "t2", 0, 6, None)], "key string, doc string, text string, chunk_index int, token_count int, pages array<int>")
    publications = spark.createDataFrame([("d", "T", 2001, ["A"])], "doc string, title string, year int, authors array<string>")
    sparse = spark.createDataFrame([("c1", [("x", 0.5)])], f"id string, sparse {ingest.SPARSE}")
    collection = ingest.Collection(spark, str(tmp_path / "points"))
    assert collection.count() == 0 and collection.health()["status"] == "degraded"
    assert ingest.ingest(collection, vectors, chunks, publications, "key", "doc", sparse) == {"status": "COMPLETED", "points": 3, "without_chunk": 1}
    assert collection.health() == {"status": "healthy", "points": 3, "error": None}
    assert [r.text_content for r in collection.scroll("d").collect()] == ["t2", "t1"] and "dense" not in collection.scroll("d").columns
    got = {r.key: r for r in collection.read().collect()}
    assert got["c1"].page_numbers == [2] and got["c1"].document_authors == ["A"] and got["c1"].sparse == [("x", 0.5)]
    assert got["c2"].page_numbers == [] and got["c3"].sparse == [] and got["c3"].text_content == "" and got["c3"].document_year is None


def test_last_write_holds(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "first", 1), (2, "last", 2), (3, "x", 1)], "k long, v string, at int")
    assert sorted((r.k, r.v) for r in ingest.upserted(stored, new, "k", ["at"]).collect()) == [(1, "a"), (2, "last"), (3, "x")]


def test_batches_of_a_hot_label(spark):
    rows = spark.range(5000).select((F.col("id") % 7 == 0).cast("int").alias("label"), (F.col("id") * 17 % 5003).alias("n")).unionAll(spark.createDataFrame([(None, 5), (1, None)], "label int, n long"))
    got = ingest.batches(rows, "label", "n", 100).collect()
    for label in (0, 1, None):
        mine = sorted((r.n is not None, r.n or 0, r.batch) for r in got if r.label == label)
        assert [b for _, _, b in mine] == [k // 100 for k in range(len(mine))]


def test_rates_beyond_ten_thousand(spark):
    rates = spark.range(20_000).select(F.col("id").alias("m"), F.lit(1.0).alias("rate"))
    usage = spark.createDataFrame([(19_999, 2.0, 0.0), (50_000, 1.0, 0.0), (3, -5.0, 30.0)], "m long, h double, g double")
    assert tuple(metrics.cost(usage, rates, "m", "h", "g").first()) == (2.2, 0.02)
    judged = metrics.judged_cost(metrics.cost(usage, rates, "m", "h", "g"), 100).first()
    assert (judged.total, judged["each"], judged.rating) == (2.22, 0.0222, "fair")


def test_measured(spark):
    rows = spark.createDataFrame([("a", "--- Page 1 ---\nx y", 1.5, None), ("b", None, 0.1, "bad")], "path string, t string, s double, e string")
    got = {r.path: (r.chars, r.tokens, r.pages, r.success) for r in metrics.measured(rows, "t", "s", "e").collect()}
    assert got == {"a": (18, 6, 1, True), "b": (0, 0, 0, False)}


# ---- tracking


def test_validated(spark):
    rows = spark.createDataFrame([("1", "T"), ("", "T"), ("2", "　"), (None, "T")], "id string, title string")
    good, bad = tracking.validated(rows, "id", "title")
    assert [r.id for r in good.collect()] == ["1"] and sorted(r.reason for r in bad.collect()) == ["no id", "no id", "no title"]


def test_limits_of_work_lists(spark):
    rows = spark.createDataFrame([(k, "Pending") for k in (3, 1, 2)], "id long, download_status string")
    assert [r.id for r in tracking.work_list(rows, "download", "id", 2).collect()] == [1, 2] and tracking.work_list(rows, "download", "id", 0).count() == 3
    disk = spark.createDataFrame([(2,), (9,), (8,)], "id long")
    assert [(r.id, r.origin) for r in tracking.embedding_work(rows, disk, "id", limit=2).collect()] == [(2, "tracked"), (8, "disk")]
    assert [r.id for r in tracking.embedding_work(rows, disk, "id", requested=disk.where("id = 9")).collect()] == [9]


def test_sources_and_matching(spark):
    assert tracking.known_sources(["b", "a", "b"], ["a", "b"]) == ["b", "a"]
    with pytest.raises(ValueError, match="c"):
        tracking.known_sources(["c"], ["a"])
    with pytest.raises(ValueError):
        tracking.discovered({})
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    assert [r.id for r in tracking.matching(rows, v=None).collect()] == [2] and tracking.matching(rows, id=1, v="b").isEmpty()


# ---- records


def test_api_pages_and_cursor(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"results": [{"id": "a"}, {"id": "b"}], "meta": {"next_cursor": "x"}}, indent=1))
    (tmp_path / "2.json").write_text(json.dumps({"results": [], "meta": {"next_cursor": None}}))
    assert sorted(r.id for r in catalog.api_pages(spark, str(tmp_path), "struct<id:string>").collect()) == ["a", "b"]
    pages = {"*": {"results": [1], "meta": {"next_cursor": "p"}}, "p": {"results": [], "meta": {"next_cursor": "q"}}, "q": {"results": [2], "meta": {"next_cursor": None}}}
    assert list(catalog.cursor_pages(pages.__getitem__)) == [1, 2]
    with pytest.raises(KeyError):
        list(catalog.cursor_pages({}.__getitem__))
    assert catalog.api_url("https://x.org", "A1", "c") == "https://x.org/works?filter=author.id:A1,primary_location.version:!submittedVersion&per-page=200&cursor=c"


def test_page_count(spark):
    html = '<script>window.FWP_JSON = {"preload_data": {"settings": {"pager": {"total_pages": 31}}}};</script>'
    assert one(spark, catalog.page_count(F.col("h"), F.lit(5)), h=html) == 31
    assert one(spark, catalog.page_count(F.col("h"), F.lit(5)), h="<p>") == 1 and one(spark, catalog.page_count(F.col("h"), F.lit(0)), h="<p>") == 0


def test_enriched(spark):
    own = spark.createDataFrame([(1, None, "ab", ["A"]), (2, 2000, "abc", ["A", "B"])], "id long, year int, abstract string, authors array<string>")
    found = spark.createDataFrame([(1, 1999, "abc", ["X"]), (2, 1999, "ab", ["X", "Y", "Z"])], "id long, year int, abstract string, authors array<string>")
    assert sorted(map(tuple, catalog.enriched(own, found, "id").collect())) == [(1, 1999, "abc", ["A"]), (2, 2000, "abc", ["X", "Y", "Z"])]


def test_parsed_pages(spark):
    rows = spark.createDataFrame([(1, "<title> T </title><h1>H<br>i</h1><a href=x>y</a><a>z</a>"), (2, None)], "page_id long, html string")
    assert sorted(map(tuple, catalog.parsed_pages(rows).collect())) == [(1, "T", "Hi", 1), (2, "", "", 0)]


def test_entries_without_parts(spark):
    html = '<div class="biblio-entry"><span class="biblio-title">Only</span></div><div class="biblio-entry">none</div>'
    got = catalog.parsed_entries(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"), "https://x.org/repository").collect()
    assert [tuple(r) for r in got] == [(1, 0, "Only", None, [], None, None, [])]


def test_rejected_years(spark):
    rows = spark.createDataFrame([("W1", 1800), ("W2", None), ("W3", 0)], "paper_id string, year int")
    good, bad = catalog.coerced(rows)
    assert sorted(r.paper_id for r in good.collect()) == ["W2", "W3"] and bad.first().reason == "year out of range: 1800"


# ---- transcripts


def test_segments():
    raw = "a b c\n\nd e f\n\n" + " ".join(f"s{k} t{k}." for k in range(6))
    assert transcripts.segments("a b", 5) == ["a b"]
    got = transcripts.segments(raw, 6)
    assert got == ["a b c\n\nd e f", "s0 t0. s1 t1. s2 t2.", "s3 t3. s4 t4. s5 t5."]


def test_cleaning(spark):
    seen = []

    def clean(part, k, n, before):
        seen.append((k, n, before))
        return part.upper()

    assert transcripts.carried(transcripts.segments("a b.\n\nc d.", 2), clean) == "A B.\n\nC D." and seen == [(0, 2, None), (1, 2, "A B.")]
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = transcripts.clean_all(docs, lambda part, k, n, before: part * 2, "doc_id", "text").collect()
    assert sorted(map(tuple, got)) == [("1", 1, "a ba b", None), ("2", 1, "", None)]

    def breaks(part, k, n, before):
        if "bad" in part:
            raise ValueError("no answer")
        return part[:22]

    docs = spark.createDataFrame([(1, "x" * 100), (2, "bad"), (3, "fine")], "doc_id long, text string")
    made = transcripts.clean_all(docs, breaks, "doc_id", "text")
    assert {r.doc: (r.text, r.error) for r in made.collect()} == {"1": (None, "too short: 22 of 100 characters are left"), "2": (None, "no answer"), "3": ("fine", None)}


def test_spans_fit_and_tile():
    rng = random.Random(4)
    for _ in range(200):
        raw = "".join(rng.choice(["word ", "a. ", "\n\n", "b! ", "\n", "x" * 9 + " "]) for _ in range(rng.randrange(60)))
        found = transcripts.spans(raw, 5)
        assert [raw[a:b] for a, b in found] == [] if not raw else "".join(raw[a:b] for a, b in found) == raw
        for a, b in found:
            part = raw[a:b].strip()
            assert len(part.split()) <= 5 or not re.search(r"[.!?]\s|\n\s*\n", part)


def test_transcripts_are_published_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "talks"))
    rows = spark.createDataFrame([("01_intro", "a"), ("02_next", None)], "doc string, text string")
    facts = spark.createDataFrame([("01_intro", "Intro", 1)], "doc string, title string, number int")
    assert transcripts.publish(rows, store, facts) == 1
    assert transcripts.publish(rows.unionAll(spark.createDataFrame([("02_next", "late")], rows.schema)), store, facts) == 1
    assert transcripts.publish(rows, store) == 0
    assert {r.doc: json.loads(r.record) for r in store.read("records").collect()} == {"01_intro": {"doc": "01_intro", "title": "Intro", "number": 1, "n_chars": 1}, "02_next": {"doc": "02_next", "n_chars": 4}}
    assert {(r.doc, r.text) for r in store.read("texts").collect()} == {("01_intro", "a"), ("02_next", "late")}


# ---- sources and sinks


def test_files(spark, tmp_path):
    (tmp_path / "in/a").mkdir(parents=True)
    (tmp_path / "in/a/x.txt").write_text("one\ntwo")
    (tmp_path / "in/a/y.part").write_bytes(b"%PDF-")
    assert [r.text for r in readers.texts(spark, str(tmp_path / "in")).collect()] == ["one\ntwo"]
    assert readers.binaries(spark, str(tmp_path / "in")).count() == 1
    (tmp_path / "in/c.csv").write_text('id,authors,year\n1,"[\'A\', \'B\']",2001\n2,,x\n3,One,2002\n')
    got = readers.catalogue_csv(spark, str(tmp_path / "in/c.csv"), "id int, authors string, year int").collect()
    assert [(r.id, r.authors) for r in got] == [(1, ["A", "B"]), (3, ["One"])]
    for name, data in (("p", [{"chunk_id": "1"}]), ("q", {"chunks": [{"chunk_id": "2"}]})):
        (tmp_path / f"in/{name}.json").write_text(json.dumps(data))
    assert sorted(r.chunk_id for r in readers.chunk_files(spark, str(tmp_path / "in")).collect()) == ["1", "2"]
    listing = spark.createDataFrame([("a/x",), ("a/y",), ("b/x",)], "path string")
    assert [r.folder for r in readers.complete_folders(listing, "path", ("x", "y")).collect()] == ["a"]


def test_storage(spark, tmp_path):
    s = storage.Storage(spark, str(tmp_path))
    assert not s.exists("a/b.txt") and s.list("a").count() == 0
    s.put("a/b.txt", b"1")
    s.put("a/b.txt", b"\x00\xff2")
    assert s.get("a/b.txt") == b"\x00\xff2"
    s.copy("a/b.txt", "a/c.txt")
    s.move("a/b.txt", "a/d.bin")
    assert sorted(r.path.rpartition("/")[2] for r in s.list("a").collect()) == ["c.txt", "d.bin"] and s.list("a", "*.txt").count() == 1
    assert s.delete("a") and not s.exists("a")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a"], "x"), (2, None, "y")], "id long, l array<string>, s string")
    writers.parquet(rows, str(tmp_path / "p"), ("s",))
    writers.json_lines(rows, str(tmp_path / "j"))
    writers.csv(rows, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == spark.read.json(str(tmp_path / "j")).count() == 2
    assert sorted(r.l or "" for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).collect()) == ["", '["a"]']
    with pytest.raises(Exception, match="(?i)already exists"):
        writers.parquet(rows, str(tmp_path / "p"))
    assert writers.marked(rows, str(tmp_path / "m"), {"n": 2}) and not writers.marked(rows, str(tmp_path / "m"), {"n": 3})
    assert json.loads((tmp_path / "m/metadata.json").read_text()) == {"n": 2}
    assert writers.missing_documents(rows, str(tmp_path / "d"), "id", "s") == 2
    assert writers.missing_documents(rows.unionAll(rows.select((F.col("id") + 2), "l", "s")), str(tmp_path / "d"), "id", "s") == 2
    assert writers.only_new(rows, rows.where("id = 1"), "id").first().id == 2
    writers.report(rows, str(tmp_path / "r.json"), spark)
    assert json.loads((tmp_path / "r.json").read_text())[0]["l"] == ["a"]
    assert "| rate | 0.8 | at least 0.9 | no |" in writers.markdown("T", {"rate": 0.8, "n": 3}, {"rate": ("at least", 0.9)})


def test_sql(spark, tmp_path):
    script = "-- a; b\nCREATE OR REPLACE TEMP VIEW v1 AS SELECT ';' AS x, 2 - 1 AS y; ;\nCREATE OR REPLACE TEMP VIEW v2 AS SELECT * FROM v1"
    assert len(sql.statements(script)) == 2 and sql.run_script(spark, script) == 2
    assert tuple(sql.raw(spark, "SELECT x, y FROM v2 WHERE y = :n", n=1).first()) == (";", 1)
    assert {"v1", "v2"} <= set(sql.tables(spark)) and sql.columns(spark, "v2") == {"x": "string", "y": "int"}


def test_paths(spark):
    assert one(spark, paths.nested(F.col("d")), d="a__b__c") == "a__b/c" and one(spark, paths.nested(F.col("d")), d="ab") == "ab"
    listing = spark.createDataFrame([("x/b/chunks.json",), ("x/a/chunks.json",), ("x/a/b.txt",)], "path string")
    assert [r.document_id for r in paths.chunk_folders(listing, "path").collect()] == ["a", "b"]
    assert one(spark, paths.publication_of(F.col("p")), p="r/documents/17/a.pdf") == "17" and one(spark, paths.publication_of(F.col("p")), p="r/x/a.pdf") == "x"
    assert one(spark, ids.uuid5(F.col("n")), n="x") == str(__import__("uuid").uuid5(__import__("uuid").UUID(ids.POINT_NAMESPACE), "x"))


# ---- runs


def test_runner():
    def fails():
        raise RuntimeError("bad")

    def go(critical):
        return runner.Runner([("a", lambda: {"n": 1}), ("b", fails), ("c", dict)], frozenset(critical)).run()

    assert [r.status for r in go([])] == ["COMPLETED", "FAILED", "COMPLETED"] and [r.name for r in go(["b"])] == ["a", "b"]
    told = runner.report(go([]))
    assert told["failed"] == ["b"] and told["exit_code"] == 1 and told["components"][1]["error"] == "bad"
    assert [r.status for r in runner.Runner([("a", fails)], dry=True).run()] == ["SKIPPED"]
    assert runner.merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}, "e": 4}) == {"a": {"b": 9, "c": 2}, "d": 3, "e": 4}


def test_extension_points(spark):
    class Broken:
        def extract(self, content):
            raise RuntimeError("broken")

    rows = spark.createDataFrame([("a", b"x" * 20), ("b", b"short"), ("c", None)], "path string, content binary")
    got = {r.key: (r.status, r.error) for r in extensions.extracted(rows, Broken, extensions.EXTRACTORS["plain"], 10).collect()}
    assert got == {"a": ("Processed", None), "b": ("Failed", "text of 5 characters"), "c": ("Failed", "no content")}

    def make():
        def embed(texts):
            if len(texts) > 2 or "bad" in texts:
                raise MemoryError
            return [[float(len(t))] for t in texts]

        return embed

    assert extensions.halving(make(), ["a", "bad", "ccc", "dd"]) == [[1.0], None, [3.0], [2.0]]
    texts = spark.createDataFrame([("1", "aa"), ("2", None)], "k string, t string")
    assert sorted((r.key, r.dense) for r in extensions.embedded(texts, make, "k", "t").collect()) == [("1", [2.0]), ("2", [0.0])]
    tries, pauses = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "ok"

    assert extensions.retried(flaky, 3, 1.0, 1.5, 0.1, pauses.append) == "ok"
    assert 1.0 <= pauses[0] <= 1.1 and 1.5 <= pauses[1] <= 1.65
    with pytest.raises(OSError):
        tries.clear()
        extensions.retried(flaky, 2, sleep=pauses.append)


def test_stage_runner(spark, tmp_path):
    spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    told = stages.run(spark, "status", str(tmp_path / "in"), str(tmp_path / "out"))
    assert told["exit_code"] == 0 and told["components"][0]["metrics"]["rows"] == 2 and told["components"][0]["metrics"]["spark"]["tasks"] > 0
    assert stages.run(spark, "chunk", str(tmp_path / "none"), str(tmp_path / "out2"))["exit_code"] == 1


def test_stream(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    words = " ".join(f"w{k}" for k in range(60))
    spark.createDataFrame([(1, words)], "doc_id long, text string").write.parquet(source)
    files.chunk_stream(spark, source, "doc_id long, text string", sink, state).awaitTermination()
    spark.createDataFrame([(1, words), (2, words)], "doc_id long, text string").write.mode("append").parquet(source)
    files.chunk_stream(spark, source, "doc_id long, text string", sink, state).awaitTermination()
    assert sorted(r.doc for r in Store(spark, sink).read("chunks").collect()) == ["1", "2"]


def test_folders_of_texts(spark, tmp_path):
    words = " ".join(f"w{k}" for k in range(60))
    for name, body in (("d1/a", words), ("d1/b", words), ("d2/x", " "), ("d3/y", words)):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / f"{name}.txt").write_text(body)
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    assert stages.chunk_folder(spark, source, sink) == {"attempted": 4, "succeeded": 3, "failed": 1, "status": "COMPLETED"}
    assert sorted(r.doc for r in Store(spark, sink).read("chunks").collect()) == ["d1", "d1__b", "d3"]
    (tmp_path / "in/d4").mkdir()
    (tmp_path / "in/d4/z.txt").write_text("\n")
    assert stages.chunk_folder(spark, source, sink) == {"attempted": 1, "succeeded": 0, "failed": 1, "status": "FAILED"}
    assert stages.chunk_folder(spark, source, sink)["attempted"] == 0 and Store(spark, sink).read("statuses").count() == 5


def test_folders_of_files(spark, tmp_path):
    (tmp_path / "p1").mkdir()
    (tmp_path / "p1/a.pdf").write_bytes(b"--- Page 1 ---\none\n--- Page 2 ---\ntwo\n")
    (tmp_path / "p1/b.bin").write_bytes(b"%PDF-1.4 and more text")
    (tmp_path / "p1/c.bin").write_bytes(b"no mark here")
    (tmp_path / "p1/d.pdf").write_bytes(b"short")
    got = {r.path[-5:]: (r.document, r.text, r.status) for r in stages.extract_folder(spark, str(tmp_path), extensions.EXTRACTORS["plain"], least=10, most_pages=1).collect()}
    assert got == {"a.pdf": ("p1", "--- Page 1 ---\none\n", "Processed"), "b.bin": ("p1", "%PDF-1.4 and more text", "Processed"), "d.pdf": ("p1", None, "Failed")}


def test_configuration(tmp_path):
    assert stages.configuration(str(tmp_path / "none"), {"a": 1}) == {"a": 1}
    (tmp_path / "c.json").write_text('{"a": {"b": 1, "c": 2}}')
    assert stages.configuration(str(tmp_path / "c.json"), {"a": {"b": 9}}) == {"a": {"b": 9, "c": 2}}


def test_profiled_and_times(spark):
    rows, seen = stages.profiled(spark.range(7), "n")
    rows.collect()
    assert seen.get["rows"] == 7
    moment = spark.sql("select timestamp '2020-01-02 03:04:05.000006' as t").select(text.iso_time(F.col("t")).alias("x")).first().x
    assert moment == "2020-01-02T03:04:05.000006"


def test_service(spark, tmp_path):
    bodies = {"c1": "trade and growth", "c2": "birds and bees", "c3": "growth of trade in towns"}
    vectors = spark.createDataFrame([(k, [float("trade" in t), float("birds" in t)]) for k, t in bodies.items()], "key string, dense array<double>")
    chunks = spark.createDataFrame([(k, "d" + k, t, 0, 3, [4]) for k, t in bodies.items()], "key string, doc string, text string, chunk_index int, token_count int, pages array<int>")
    publications = spark.createDataFrame([("dc1", "One", 2001), ("dc2", "Two", 2002), ("dc3", "Three", 2003)], "doc string, title string, year int")
    collection = ingest.Collection(spark, str(tmp_path / "points"))
    ingest.ingest(collection, vectors, chunks, publications, "key", "doc")
    api = service.Service(collection, lambda queries: [[float("trade" in q), float("birds" in q)] for q in queries])
    hits = api.chunks(service.Request("trade", 2))
    assert {h.document_id for h in hits} == {"dc1", "dc3"} and hits[0].score >= hits[1].score and hits[0].pages == (4,)
    assert [h.title for h in api.chunks(service.Request("trade", 2, year=2003))] == ["Three"]
    answer = api.search(service.Request("birds in 2002", 1))
    assert answer.count == 1 and answer.hits[0].document_id == "dc2" and answer.queries == ("birds in 2002",) and answer.answer.startswith("[1]")
    assert service.Request("x", 99, document_id="d").body() == {"query": "x", "top_k": 50, "filters": {"document_id": "d"}}
    with pytest.raises(ValueError):
        service.Request("")
    assert api.health()["points"] == 3
