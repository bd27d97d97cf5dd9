"""Stored tables, indexes over them, and runs that die half way."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirelight.operators import dense, ingest, postings, retrieval
from quirelight.plans import stages
from quirelight.sources import snapshots
from quirelight.sources.snapshots import Conflict, Store
from quirelight.streaming import files


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def people(spark, *rows):
    return spark.createDataFrame(rows, "id long, name string")


def files_of(store, name):
    return {b: f for b, f in store.manifest()["tables"][name]["parts"].items()}


# ---- snapshots


def test_changes_by_key(spark, store):
    assert store.version() == 0 and not store.exists("t") and store.mark("m") is None
    with store.begin() as t:
        t.replace("t", spark.range(200).select("id", F.concat(F.lit("n"), "id").alias("name")), "id", 16)
    before = files_of(store, "t")
    with store.begin() as t:
        t.upsert("t", people(spark, (5, "a"), (5, "b"), (900, "new")), "id")
    after = files_of(store, "t")
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2  # the others' files are the same ones
    assert {(r.id, r.name) for r in store.read("t", values=[5, 900, 901]).collect()} == {(5, "b"), (900, "new")}
    assert len(store.read("t", values=[5]).inputFiles()) == 1 and len(store.read("t").inputFiles()) == 16
    assert store.read("t", 1).count() == 200 and store.read("t").count() == 201  # an older state can still be read
    with store.begin() as t:
        t.delete("t", people(spark, (7, ""), (5000, "")), "id")
        t.update("t", people(spark, (8, "eight"), (9, None)), "id")
        t.set_mark("m", {"n": 1})
    got = {r.id: r.name for r in store.read("t").collect()}
    assert len(got) == 200 and 7 not in got and got[8] == "eight" and got[9] == "n9" and store.mark("m") == {"n": 1}
    assert store.vacuum() > 0 and store.read("t").count() == 200 and store.vacuum() == 0


def test_all_or_nothing(spark, store):
    with store.begin() as t:
        t.replace("t", people(spark, (1, "a")), "id")
    with pytest.raises(RuntimeError), store.begin() as t:
        t.append("t", people(spark, (2, "b")))
        raise RuntimeError("killed")
    reader = store.read("t")
    with store.begin() as t:
        t.replace("t", people(spark, (3, "c")), "id")
    assert [r.id for r in reader.collect()] == [1] and [r.id for r in store.read("t").collect()] == [3]
    with pytest.raises(KeyError):
        store.read("none")
    with pytest.raises(ValueError), store.begin() as t:
        t.upsert("t", spark.createDataFrame([("x",)], "name string"), "name")
    with store.begin() as t:  # a new column; rows that were there have null
        t.merge("t", people(spark, (4, "d")), lambda old, new: old.unionByName(new).withColumn("more", F.lit(1)))
    assert {(r.id, r.more) for r in store.read("t").collect()} == {(3, None if len(files_of(store, "t")) == 2 else 1), (4, 1)}


def test_two_writers(spark, store):
    with store.begin() as t:
        t.replace("t", people(spark, *[(i, "x") for i in range(50)]), "id", 4)
    a, b, c, d = (store.begin() for _ in range(4))
    a.append("t", people(spark, (100, "a")))
    b.append("t", people(spark, (101, "b")))
    a.commit()
    b.commit()
    assert store.read("t").where("id >= 100").count() == 2
    c.delete("t", people(spark, *[(i, "") for i in range(50)]), "id")  # its buckets have new rows
    with pytest.raises(Conflict):
        c.commit()
    d.set_mark("m", 1)
    e = store.begin()
    e.set_mark("m", 2)
    e.commit()
    with pytest.raises(Conflict):
        d.commit()
    assert store.read("t").count() == 52 and store.mark("m") == 2


def test_odd_tables(spark, store):
    with store.begin() as t:
        t.replace("none", people(spark).limit(0), "id")
        t.append("log", people(spark, (1, "a")))
        t.append("log", people(spark, (1, "a")))
    assert store.read("none").count() == 0 and store.read("log").count() == 2
    with store.begin() as t:
        t.upsert("none", people(spark, (None, "null"), (1, "a")), "id")
        t.upsert("none", people(spark, (1, "b")), "id")
    assert {(r.id, r.name) for r in store.read("none").collect()} == {(None, "null"), (1, "b")}


# ---- runs that die


def texts(folder, **bodies):
    for name, body in bodies.items():
        (folder / name).mkdir(parents=True, exist_ok=True)
        (folder / name / "a.txt").write_text(body)


def test_chunk_run_killed_between_its_writes(spark, tmp_path, monkeypatch):
    words = " ".join(f"w{k}" for k in range(60))
    texts(tmp_path / "in", d1=words, d2=words)
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    append = snapshots.Transaction.append

    def dies(self, name, *rest):
        if name == "statuses":
            raise KeyboardInterrupt
        append(self, name, *rest)

    for point in ("append", "commit"):  # after the chunks are written; after both are
        with monkeypatch.context() as m:
            m.setattr(snapshots.Transaction, point, dies if point == "append" else lambda self: (_ for _ in ()).throw(KeyboardInterrupt))
            with pytest.raises(KeyboardInterrupt):
                stages.chunk_folder(spark, source, sink)
        assert not Store(spark, sink).exists("chunks") and not Store(spark, sink).exists("statuses")
    assert stages.chunk_folder(spark, source, sink)["succeeded"] == 2
    assert stages.chunk_folder(spark, source, sink)["attempted"] == 0
    assert sorted(r.doc for r in Store(spark, sink).read("chunks").collect()) == ["d1", "d2"]


def test_stream_batch_run_twice(spark, tmp_path, monkeypatch):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    words = " ".join(f"w{k}" for k in range(60))
    docs = lambda *ids: spark.createDataFrame([(i, words) for i in ids], "doc_id long, text string")
    docs(1, 1, 2).write.parquet(source)
    commit = snapshots.Transaction.commit

    def published_then_dies(self):
        commit(self)
        raise RuntimeError("killed")

    go = lambda: files.chunk_stream(spark, source, "doc_id long, text string", sink, state).awaitTermination()
    with monkeypatch.context() as m, pytest.raises(Exception):
        m.setattr(snapshots.Transaction, "commit", published_then_dies)
        go()
    assert Store(spark, sink).read("chunks").count() == 2  # what it published
    go()  # the same batch again
    docs(2, 3).write.mode("append").parquet(source)
    go()
    assert sorted(r.doc for r in Store(spark, sink).read("chunks").collect()) == ["1", "2", "3"]


# ---- the collection


def points_of(spark, n, year=2000):
    rows = [(f"p{i}", i, f"d{i % 40}", f"word{i % 7} text number{i}", i, 3, [1], "T", ["A"], year + i % 3, [float(i % 5 + 1), float(i % 11), 1.0], []) for i in range(n)]
    return spark.createDataFrame(rows, f"point_id string, key long, document_id string, text_content string, chunk_index long, token_count long, page_numbers array<int>, document_title string, document_authors array<string>, document_year int, dense array<double>, sparse {ingest.SPARSE}")


def test_collection_changes(spark, tmp_path):
    c = ingest.Collection(spark, str(tmp_path / "points"))
    assert c.recreate(points_of(spark, 400)) == 400 and not c.indexed()
    assert c.scroll("d3").count() == 10 and len(c.store.read("points", values=["d3"]).inputFiles()) == 1 < len(c.read().inputFiles())
    before = files_of(c.store, "points")
    c.upsert(points_of(spark, 401).where("key in (3, 400)").withColumn("text_content", F.lit("changed")))
    assert sum(before[b] != files_of(c.store, "points").get(b) for b in before) <= 2
    assert c.count() == 401 and c.read().where("text_content = 'changed'").count() == 2
    c.delete(spark.createDataFrame([("d3",)], "document_id string"))
    assert c.scroll("d3").count() == 0 and c.count() == 391


def test_collection_searches_its_index(spark, tmp_path):
    c = ingest.Collection(spark, str(tmp_path / "points"))
    c.recreate(points_of(spark, 300))
    asked = spark.createDataFrame([(1, "word3 number44", [1.0, 4.0, 0.5]), (2, "nothing known", [5.0, 0.0, 1.0]), (3, "word1", None)], "query long, text string, vector array<double>")
    ordered = lambda df: sorted((r.query, r.id, r.score, r["rank"]) for r in df.collect())
    plain = ordered(c.search(asked, 5))
    c.index()
    assert c.indexed() and ordered(c.search(asked, 5)) == plain and c.health()["points"] == 300
    assert {r.id for r in c.search(asked, 5, document="d3").collect()} <= {f"p{i}" for i in range(3, 300, 40)}
    c.delete(spark.createDataFrame([("d1",)], "document_id string"))
    assert not c.indexed() and c.search(asked, 5).count() > 0  # the index is of an older state


# ---- dense search


def slow_top(vectors, queries, k):
    out = []
    for q, v in queries:
        scored = [(round(float(np.dot(x, v) / np.linalg.norm(x) / np.linalg.norm(v)), 6), i) for i, x in vectors if x and v and None not in x and len(x) == len(v) and np.isfinite(x).all() and np.any(x)]
        out += [(q, i, s, n + 1) for n, (s, i) in enumerate(sorted(scored, key=lambda t: (-t[0], t[1]))[:k])]
    return sorted(out)


def test_dense_odd_rows(spark, store, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(f"v{i:03d}", [float(x) for x in rng.normal(size=6)]) for i in range(150)] + [(f"c{i:03d}", [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(60)]
    rows += [("null", None), ("empty", []), ("zero", [0.0] * 6), ("nan", [float("nan")] + [1.0] * 5), ("part", [None] + [1.0] * 5), ("short", [1.0, 2.0]), ("huge", [1e300, -1e300, 0.0, 0.0, 0.0, 1e299]), ("tiny", [1e-300] * 6)]
    asked = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(20)] + [(50, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]), (51, [2.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id string, embedding array<double>").repartition(3)
    q = spark.createDataFrame([*asked, (60, None)], "query long, vector array<double>")
    fine = [(i, x) for i, x in rows if i not in ("huge", "tiny")] + [("huge", [1.0, -1.0, 0.0, 0.0, 0.0, 0.1]), ("tiny", [1.0] * 6)]  # the same directions
    got = lambda df: sorted((r.query, r.id, r.score, r["rank"]) for r in df.collect())
    want = slow_top(fine, asked, 12)
    assert got(retrieval.dense_top_k(v, q, 12)) == want
    monkeypatch.setattr(dense, "BLOCK", 7)
    monkeypatch.setattr(dense, "ASKED", 3)
    assert got(retrieval.dense_top_k(v, q, 12)) == want
    index = dense.VectorIndex(store)
    assert index.build(v, lists=9, sample=80) == 9
    assert got(index.search(q, 12, probes=1, exact=True)) == [r for r in want if r[0] != 51]  # the index has vectors of one size
    with pytest.raises(ValueError):
        index.build(v.limit(0))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_index(spark, store, sf):
    e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    index = dense.VectorIndex(store)
    index.build(e)
    pairs = lambda df: {(r.query, r.id) for r in df.collect()}
    want = pairs(retrieval.dense_top_k(e, q, 10))
    assert len(want & pairs(index.search(q, 10))) >= 0.9 * len(want)
    assert pairs(index.search(q, 10, probes=1, exact=True)) == want


def test_no_list_is_ruled_out_wrongly():
    rng = np.random.default_rng(5)
    for _ in range(200):
        c, q = (x / np.linalg.norm(x) for x in rng.normal(size=(2, 5)))
        x = rng.normal(size=(30, 5)) + 2 * c
        x /= np.linalg.norm(x, axis=1)[:, None]
        angles = np.arccos(x @ c)
        assert (x @ q).max() <= dense.reachable(np.array([np.arccos(q @ c)]), angles.min(), angles.max())[0] + 1e-12


# ---- lexical search


def slow_lexical(docs, queries, k):
    import re
    from collections import Counter

    find = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    counts, df = [(i, Counter(find(t)), len(find(t))) for i, t in docs], Counter()
    for _, c, _ in counts:
        df.update(c.keys())
    out = []
    for q, t in queries:
        scored = []
        for i, c, n in counts:
            both = set(find(t)) & set(c)
            if both:
                scored.append((round(sum(c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * n / 256)) * np.log1p((len(docs) - df[w] + 0.5) / (df[w] + 0.5)) for w in both), 6), i))
        out += [(q, i, s, n + 1) for n, (s, i) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"SEGMENT_DOCS": 7, "ASKED": 2, "FIRST": 1, "AT_ONCE": 2}, {"SEGMENT_TOKENS": 30, "FEW": 0, "AT_ONCE": 0}, {"SEGMENT_TOKENS": 30, "ASKED": 1, "AT_ONCE": 1000}])
def test_lexical_odd_rows(spark, store, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(postings, name, value)
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(f"W{x}" for x in rng.zipf(1.3, 30) % 200)) for i in range(90)] + [(i, "same words here") for i in range(200, 230)]
    docs += [(300, None), (301, ""), (302, "!!!"), (303, "w1 " * 70_000), (304, "Ünïcode w5"), (305, "x")]
    queries = [(1, "w1 w2 w3"), (2, "W5 w5 same"), (3, None), (4, "unknown"), (5, "here x w150")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(queries, "query long, text string")
    want = slow_lexical(docs, queries, 8)
    got = lambda df: sorted((r.query, r.id, r.score, r["rank"]) for r in df.collect())
    segments = postings.segments
    if "SEGMENT_DOCS" in limits:
        monkeypatch.setattr(postings, "segments", lambda *a, **b: segments(*a, **b, segment_docs=limits["SEGMENT_DOCS"]))
    assert got(postings.sparse_top_k(d, q, 8)) == want
    index = postings.Index(store)
    index.build(d)
    assert got(index.search(q, 8)) == want
    few = index.lookup(["w1", "same"])
    assert {r.term for r in few.collect()} == {"w1", "same"} and few.select(F.sum("n")).first()[0] >= 31
    assert len(few.inputFiles()) <= 2 < len(store.read("postings").inputFiles())
    assert postings.sparse_top_k(d.limit(0), q, 8).count() == 0


def test_a_segment_is_inverted_in_little_memory():
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.2, 450) % 20_000) for _ in range(4096)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, a + 1024)), pa.array(texts[a : a + 1024])], names=["id", "text"]) for a in range(0, 4096, 1024)]
    tracemalloc.start()
    heads = pairs = 0
    for batch in postings.inverted(iter(batches), 0):
        heads += batch.column(1).null_count
        pairs += sum(len(x) for x in batch.column(4).to_pylist() if x) // 2
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    counted = postings._counted(("word " * 1000 + "other ") * 400)  # a long text
    long = tracemalloc.get_traced_memory()[1] - tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert (heads, pairs) == (1, sum(len(set(t.split())) for t in texts))
    assert counted == {"word": 400_000, "other": 400} and long < 10e6
    assert peak < 40 * pairs, peak / pairs
