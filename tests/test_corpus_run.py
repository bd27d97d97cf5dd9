"""The whole run over recorded downloads: goes on where it was, does nothing twice."""

import pytest
from pyspark.sql import functions as F

from quirelight.operators import chunking
from quirelight.plans.corpus import Corpus
from quirelight.sources import snapshots

SCHEMA = "paper_id string, title string, authors array<string>, year int, abstract string, pub_url string, file_urls array<string>"


class Words:
    """Text of the recorded bytes: enough words to cut."""

    def extract(self, content):
        return " ".join(f"word{b % 50}" for b in content[:700])


def make():
    return lambda texts: [[float(len(t)), 1.0] for t in texts]


def publications(spark, *rows):
    return spark.createDataFrame([(k, t, ["A"], 2000, "abs", f"https://h.org/{k}", urls) for k, t, urls in rows], SCHEMA)


@pytest.fixture
def corpus(spark, tmp_path):
    return Corpus(spark, str(tmp_path), "tests.answers:files", Words, None, make, "fixed", chunking.Limits(50, 10, 10, 200), tries=1)


def statuses(corpus):
    names = ("download", "processing", "embedding", "ingestion")
    return {r.paper_id: tuple(r[f"{s}_status"] for s in names) for r in corpus.store.read("tracked").collect()}


DONE = ("Downloaded", "Processed", "Embedded", "Ingested")


def test_run_goes_on(spark, corpus):
    first = publications(spark, ("p1", "One", ["https://a.org/a.pdf", "https://a.org/b.pdf"]), ("p2", "Two", ["https://a.org/missing.pdf"]), ("p3", "Three", []), ("p4", " ", []))
    assert corpus.run(first, dry=True)["waiting"] == {"download": 0, "processing": 0, "embedding": 0, "ingestion": 0} and not corpus.store.exists("tracked")
    told = corpus.run(first)
    assert told["exit_code"] == 0 and [c["name"] for c in told["components"]] == ["register", "download", "extract", "chunk", "embed", "ingest"]
    assert told["components"][0]["metrics"]["rejected"] == 1 and told["components"][1]["metrics"]["failed"] == 1 and told["components"][4]["metrics"]["spark"]["tasks"] > 0
    assert statuses(corpus) == {"p1": DONE, "p2": ("Failed", "Pending", "Pending", "Pending"), "p3": ("Pending",) * 4}
    n = corpus.collection.count()
    assert n == corpus.store.read("chunks").count() > 10 and corpus.collection.indexed()
    assert corpus.store.read("tracked").where("download_error is not null").first().download_error == "status 404"
    # again: only what failed is tried again, and no point comes twice
    again = corpus.run(first)
    assert again["exit_code"] == 1 and again["failed"] == ["download"]  # all that it tried failed
    assert corpus.collection.count() == n and corpus.store.read("tracked").where("paper_id = 'p2'").first().download_attempts == 2
    # a publication that changes goes through all stages again, a new one too
    later = publications(spark, ("p1", "One changed", ["https://a.org/a.pdf", "https://a.org/b.pdf"]), ("p5", "Five", ["https://a.org/broken.pdf"]))
    corpus.tries = 2
    assert corpus.run(later)["exit_code"] == 0
    assert statuses(corpus)["p1"] == statuses(corpus)["p5"] == DONE
    points = corpus.collection.read()
    assert points.select("point_id").distinct().count() == points.count() > n
    assert {r.document_title for r in points.where("document_id = 'p1'").collect()} == {"One changed"}
    assert corpus.waiting() == {"download": 2, "processing": 2, "embedding": 2, "ingestion": 2}


def test_run_killed_while_it_publishes(spark, corpus, monkeypatch):
    rows = publications(spark, ("p1", "One", ["https://a.org/a.pdf"]))
    corpus.register(rows)
    commit = snapshots.Transaction.commit
    for component in (corpus.download, corpus.extract, corpus.chunk, corpus.embed, corpus.ingest):
        version = corpus.store.version()
        with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
            m.setattr(snapshots.Transaction, "commit", lambda self: (_ for _ in ()).throw(KeyboardInterrupt))
            component()
        assert corpus.store.version() == version
        component()
        assert corpus.store.version() == version + 1 and snapshots.Transaction.commit is commit
    assert statuses(corpus) == {"p1": DONE} and corpus.collection.count() == corpus.store.read("chunks").count() == corpus.store.read("vectors").select("key").distinct().count()
    assert corpus.store.read("chunks").select(F.count_distinct("chunk_id"), F.count("*")).first()[:] == (corpus.collection.count(),) * 2
