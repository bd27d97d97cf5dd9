"""Periodic runs, importance resampling and HTML extraction against slow versions."""

import hashlib
import html
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quirelight.llm import dom_blocks, html_extraction, importance_resampling, layouts, periodic_runs, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_words string, score string, runs string, copies int, part int"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
extra = lambda rows: [(*r, "x", "x", "x", 1, 1) for r in rows]


# ---- periodic runs


def slow_runs(words, least=12, exp=2):
    """Every lag, every place; of equal spans the least period."""
    spans = {}
    for p in range(1, len(words) // exp + 1):
        i = 0
        while i < len(words) - p:
            j = i
            while j < len(words) - p and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, exp * p):
                spans.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return {(*s, p) for s, p in spans.items()}


def planted(seed):
    r = random.Random(seed)
    w = [r.choice("abcdefgh"[: r.choice([1, 2, 3, 8])]) for _ in range(r.randrange(150))]
    for _ in range(r.randrange(3)):
        if len(w) > 4:
            a, p = r.randrange(len(w)), r.randrange(1, 30)
            for i in range(a, min(len(w), a + r.randrange(1, 90))):
                w[i] = w[a + (i - a) % p]
    return w


def test_scan_of_all_lags():
    total = 0
    for seed in range(400):
        w = planted(seed)
        for least, exp in ((12, 2), (5, 3), (2, 2)):
            scan, want = periodic_runs.Scan(periodic_runs.word_ids([x.encode() for x in w]), least, exp), slow_runs(w, least, exp)
            assert scan.runs() == want
            parts = set().union(*(scan.runs(lo, hi) for lo, hi in scan.ranges(15)))
            assert periodic_runs.least_periods(parts) == want
            total += len(want)
    assert total > 1000
    with pytest.raises(ValueError):
        periodic_runs.Scan(np.zeros(3, np.int64), 12, 1)


def test_scan_of_long_texts():
    n = 400_000
    assert periodic_runs.Scan(np.zeros(n, np.int64)).runs() == {(0, n, 1)}
    assert periodic_runs.Scan(np.arange(n) % 1000).runs() == {(0, n, 1000)}
    far = np.arange(n)
    far[n // 2 :] = far[: n // 2]
    assert periodic_runs.Scan(far).runs() == {(0, n, n // 2)}
    scan = periodic_runs.Scan(far)
    assert len(scan.ranges(1 << 18)) > 8 and scan.ranges(1 << 18)[-1][1] == n // 2 + 1


def slow_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(slow_runs(words), key=lambda r: (r[0], r[2]))
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join("%d,%d,%d\n" % r for r in runs)
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


@pytest.fixture(scope="module")
def odd():
    rows = [(i, " ".join(planted(i))) for i in range(60)] + [(i, " ".join(planted(i % 7)) + " é x") for i in range(60, 120)]
    rows += [(200, None), (201, ""), (202, " \t\n\x0b"), (None, "a b " * 9), (None, None), (203, "x " * 30), (203, "x " * 30), (203, "x " * 29), (204, "w" * 5000 + " tail"), (-5, "a\tb\n" * 12)]
    return rows


@pytest.mark.parametrize("limits", [{}, {"long_bytes": 0, "work": 40}, {"long_bytes": 100, "work": 1 << 20}])
def test_op11_rows(spark, odd, tmp_path, monkeypatch, limits):
    spark.createDataFrame(extra(odd), DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    if limits:
        find = periodic_runs.find_runs
        monkeypatch.setattr(periodic_runs, "find_runs", lambda docs, **kw: find(docs, **kw, **limits))
    got = queries.op11_periodic_runs(spark, str(tmp_path)).drop("n_words")
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((slow_row(*r) for r in odd), key=key)


def test_op11_on_the_table(spark):
    table = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    got = {r.doc_id: tuple(r)[:-1] for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(table)
    for r in table:
        if len(r["text"] or "") < 6000:
            assert got[r["doc_id"]] == slow_row(r["doc_id"], r["text"])
    assert sum(r[1] > 0 for r in got.values()) >= 15


def test_op11_empty_table(spark, tmp_path):
    assert periodic_runs.find_runs(spark.createDataFrame([], DOCS)).count() == 0


# ---- importance resampling


def slow_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def slow_draw(rows, target, percent=25):
    s, t = np.zeros(10000), np.zeros(10000)
    for _, text in rows:
        np.add.at(s, slow_features(text)[1], 1)
    for text in target:
        np.add.at(t, slow_features(text)[1], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10000) / ((s[b] + 1) * (t.sum() + 10000)))) for b in range(10000)]
    out = []
    for doc_id, text in rows:
        n, f = slow_features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha(f"7:{'' if doc_id is None else doc_id}")[:8], 16)
        out.append((n, doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[0] >= 20), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2], r[3]))
    drawn = able[: len(able) * percent // 100]
    rest = able[len(drawn) :] + [r for r in out if r[0] < 20]
    return [(*r[1:], k + 1) for k, r in enumerate(drawn)] + [(*r[1:], None) for r in rest]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    text = lambda n: " ".join(r.choice(["Alpha", "beta", "ß-été", "x1", "don't", "%d" % r.randrange(200)]) for _ in range(n))
    rows = [(i, text(r.randrange(40))) for i in range(150)] + [(i, None) for i in range(3)] + [(999, ""), (None, text(30)), (None, text(30)), (-7, text(25))]
    return rows + [(500, "copy me " * 20)] * 40 + [(501, "copy me " * 20)] * 30  # many rows of one key


def test_op12_rows(spark, corpus, tmp_path):
    target = ["alpha beta x1 " * 5, None, "ß été"]
    spark.createDataFrame(extra(corpus), DOCS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op12_importance_resampling(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(slow_draw(corpus, target), key=key)


def test_op12_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.op12_importance_resampling(spark, SF)
    want = c.execute(queries.ORACLE_SQL["op12_importance_resampling"])
    assert [d[0] for d in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_op12_odd_tables(spark):
    empty, one = spark.createDataFrame([], DOCS), spark.createDataFrame(extra([(1, "a b " * 10)]), DOCS)
    assert importance_resampling.resample(empty, one).count() == 0
    assert importance_resampling.resample(one, empty).first()["rank"] is None  # a quarter of one row is none
    assert importance_resampling.resample(one, one, percent=100).first()["rank"] == 1


def test_radix_select(spark):
    r = random.Random(2)
    keys = [(r.choice([-(1 << 62), -1, 0, 7, 1 << 40]) + r.randrange(3), r.choice([5, -5, 1 << 33])) for _ in range(500)]
    df = spark.createDataFrame(keys, "a long, b long").repartition(5)
    for k in (1, 17, 250, 499, 500):
        prefix, nth = importance_resampling.radix_select(df, [F.col("a"), F.col("b")], k)
        at = sorted(keys)[k - 1]
        whole = [sum(d << s for d, s in zip(prefix[i : i + 4], (48, 32, 16, 0))) - (1 << 63) for i in (0, 4)]
        assert tuple(whole) == at and nth == k - sum(x < at for x in keys)


# ---- html extraction


@pytest.fixture(scope="module")
def model():
    return html_extraction.fit()


def test_blocks():
    page = """<!DOCTYPE html><title>no</title><body><!-- <p>no</p> --><div class="Side-barList" id=x hidden><p>a<b>b</b> &lt;c&gt;&nbsp;d
    <p>e<br>f <a href="/q" title='1>2'>link</a><script>"</p>"</script><ul><li>g<li>h</ul>i</div>5 < 6 <p title="open>rest <i>of</i></p>"""
    got = dom_blocks.blocks(page)
    assert [b.text for b in got] == ["ab <c> d", "e f link", "g", "h", "i", "5 < 6", "rest of"]
    assert {"c=side", "c=bar", "c=list", "hidden", "t=p", "near c=x"} <= got[0].around and got[1].linked == 4 and [b.tag for b in got[2:5]] == ["li", "li", "div"]
    assert "c=x" not in got[5].around and dom_blocks.blocks("<p>x<a b='") == [got[0]._replace(text="x", tag="p", around=frozenset({"t=p"}), linked=0)]
    assert dom_blocks.blocks("<script>x") == dom_blocks.blocks("") == dom_blocks.blocks("<!-- x") == []
    long = dom_blocks.blocks("<div class='k1 k2'>" * 50_000 + "x" + "</p></div>" * 60_000 + "y", known={"c=k"})
    assert [b.text for b in long] == ["x", "y"]


def test_gradient_and_viterbi():
    rng = np.random.default_rng(3)
    score, moves = rng.normal(size=(5, 3)), rng.normal(size=(3, 2))
    y = rng.integers(0, 2, (5, 3))
    y[3:, 1] = -1  # a shorter page

    def value(labels, p):
        return moves[2, labels[0]] + sum(score[k, p] * x for k, x in enumerate(labels)) + sum(moves[a, b] for a, b in zip(labels, labels[1:]))

    on, moved = html_extraction._gradient(score, moves, y)
    want, want_moved = np.zeros_like(on), np.zeros((3, 2))
    for p in range(3):
        size = int((y[:, p] >= 0).sum())
        paths = list(itertools.product((0, 1), repeat=size))
        weight = np.exp([value(x, p) for x in paths])
        for x, w in zip([*paths, tuple(y[:size, p])], [*weight / weight.sum(), -1.0]):
            for k in range(size):
                want[k, p] += w * x[k]
                want_moved[x[k - 1] if k else 2, x[k]] += w
        names = {f"f{k}": float(score[k, p]) for k in range(size)}
        found = [dom_blocks.Block("x", "p", frozenset({f"f{k}"}), 0) for k in range(size)]
        best = max(paths, key=lambda x: value(x, p))
        assert html_extraction.Model(names, moves).decode(found) == [bool(x) for x in best]
    np.testing.assert_allclose(on, want, atol=1e-9)
    np.testing.assert_allclose(moved, want_moved, atol=1e-9)


def test_held_out_layouts(model):
    exact = wrong = right = 0
    for page, main in layouts.labelled_pages(300, 4242):
        found = dom_blocks.blocks(page)
        labels, got = html_extraction.aligned(found, main), model.decode(found)
        exact += [bool(x) for x in labels] == got
        wrong += sum(bool(a) != b for a, b in zip(labels, got))
        right += sum(bool(a) == b for a, b in zip(labels, got))
    assert exact >= 280 and wrong / (wrong + right) < 0.01


def test_written_pages(model):
    """Pages in layouts of their own, not made by the generator."""
    cases = {
        '<header><a href="/">Site</a><p>All the news of the town.</p></header><main><article><h2>Head</h2><p>One.</p><div class="ad-slot">Buy this now, friends.</div><p>Two &amp; three.</p><form><label>Mail</label><button>Go</button></form></article></main><footer>&copy; us</footer>': "Head One. Two & three.",
        '<div id="wrapper"><ul class="menu"><li><a href="a">A</a></li></ul><div id="content"><p>First words of it.</p><p>Second words of it.</p></div><div id="sidebar"><p>See also what others wrote about this.</p></div><div id="comments"><p>I liked this very much, thank you.</p></div></div>': "First words of it. Second words of it.",
        '<div role="alert">We use cookies to serve you.</div><article>Bare text, no paragraph.</article><aside><p>Other pieces.</p></aside>': "Bare text, no paragraph.",
        '<nav><a href="x">x</a></nav><article><p>Body.</p><section class="comments"><article class="comment"><p>A reader says this at some length, with two commas, here.</p></article></section></article>': "Body.",
    }
    assert [model.main_text(p) for p in cases] == list(cases.values())


def test_op13_on_the_tables(spark):
    """The article of each page, heading and text, which is a document's text."""
    seen = 0
    for sf in ("sf0.001", "sf0.01"):
        want = {}
        for r in pq.read_table(f"/root/testdata/{sf}/pages.parquet").to_pylist():
            article = re.search(r"<article>(.*)</article>", r["html"], re.S).group(1)
            want[r["page_id"]] = (r["url"], " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split()))
        for r in queries.op13_html_extraction(spark, f"/root/testdata/{sf}").collect():
            assert (r.url, r.text) == want[r.page_id] and r.n_chars == len(r.text)
            seen += 1
    assert seen == 300


def test_op13_odd_rows(spark, model):
    page = "<article><p>" + "Tëxt \U0001f600 here. " * 3 + "</article>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "<nav>menu</nav>"), (4, "z", "<article>" + "<p>Some long text, again.</p>" * 300_000 + "</article>")]
    df = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id int, url string, html string, text string, n_chars int")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_extraction.extract(df, model).collect()}
    text = " ".join(["Tëxt \U0001f600 here."] * 3)
    assert got[1, "u"] == (text, len(text)) and got[2, None] == got[None, "v"] == got[3, "w"] == ("", 0) and got[4, "z"][1] == 23 * 300_000 - 1
    assert html_extraction.extract(df, model).count() == 6 and html_extraction.extract(df.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        html_extraction.fit([])
    with pytest.raises(ValueError):
        html_extraction.aligned(dom_blocks.blocks("<p>a</p>"), ["b"])
