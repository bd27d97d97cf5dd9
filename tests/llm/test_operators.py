"""Each operator against a brute-force version, on small fixtures with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirelight.llm import attention_model, embedding_dedup, fingerprints, jaccard_join, lm_scoring, mixing, packing, sharding, signature_tree, token_counts, toxicity, url_filters
from quirelight.llm.components import Forest, components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, row string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def text_of(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("w%d" % k for k in rng.integers(0, 5000, n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, nulls, blanks, a long text, repeated ids and rows."""
    out = [(i, text_of(i, 40 + i)) for i in range(30)]
    out += [(100 + i, " ".join([*text_of(3, 43).split()[: 42 - i], "x", "y"])) for i in range(5)]
    out += [(200, text_of(3, 43).upper().replace("W", "w")), (201, None), (202, ""), (203, " \t\n"), (204, "one two"), (205, "One  two"), (206, "two one")]
    out += [(207, text_of(9, 20_000)), (208, text_of(9, 20_000) + " end"), (None, text_of(5, 45)), (None, None), (5, text_of(77, 50)), (7, text_of(7, 47)), (7, text_of(7, 47))]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, "en", ["b", "a", None, "ä", "Z"][k % 5], len(t or ""), 1, "r") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("limits", [{}, {"often": 3, "block": 20_000}, {"often": 1, "block": 500}])
def test_jaccard_join(docs, rows, empty, limits):
    sets, forest = [shingles(t) for _, t in rows], Forest()
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                forest.join(i, j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[forest.root(k)] = min(i, least.get(forest.root(k), i))
    want = Counter((i, len(sets[k]), least.get(forest.root(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))
    assert Counter(map(tuple, jaccard_join.jaccard_components(docs, **limits).collect())) == want
    kept = jaccard_join.keep_one(docs, **limits)
    assert kept.columns == docs.columns
    blank = [t for i, t in rows if not sets[rows.index((i, t))]]
    assert kept.count() == len({forest.root(k) for k in range(len(rows)) if sets[k]}) + len(blank)
    assert jaccard_join.jaccard_components(empty, **limits).collect() == []


@pytest.mark.parametrize("exact", [True, False])
def test_signature_tree_misses_nothing(exact):
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64)) for _ in range(12)]
    sets = [np.unique(np.concatenate([rng.choice(b, len(b) - k, replace=False), rng.integers(0, 1 << 63, k).astype(np.uint64)])) for b in base for k in (0, 10, 30, 60)]
    forest = Forest()
    for i in range(len(sets)):
        for j in range(i):
            if signature_tree.enough(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                forest.join(i, j)
    found = Forest()
    bits, sizes, order = [signature_tree.bitmap_of(s) for s in sets], [len(s) for s in sets], [(int(s[0]), int(s[1])) for s in sets]
    for a, b in signature_tree.spanning_links(list(range(len(sets))), bits, sizes, order, sets if exact else None):
        found.join(a, b)
    for i in range(len(sets)):
        for j in range(i):
            if exact:
                assert (forest.root(i) == forest.root(j)) == (found.root(i) == found.root(j))
            elif forest.root(i) == forest.root(j):
                assert found.root(i) == found.root(j)


def test_large_clusters_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK_TOKENS", 300)
    base = text_of(1, 100).split()
    made = [(k, " ".join([*base[: 100 - 9 * k], *text_of(50 + k, 9 * k).split()])) for k in range(10)]
    sets, forest = [shingles(t) for _, t in made], Forest()
    for i in range(10):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                forest.join(i, j)
    got = jaccard_join.jaccard_components(spark.createDataFrame(made, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {k: forest.root(k) for k in range(10)}


def test_components(spark):
    rng, forest = np.random.default_rng(2), Forest()
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, 5000 + k) for k in range(1, 300)]
    for a, b in edges:
        forest.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {x: forest.root(x) for x in {y for e in edges for y in e} if forest.root(x) != x}


def test_embedding_dedup(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((6, 16))
    data = [(k, [float(x) for x in base[k % 6] + (0.03 if k < 90 else 0.2) * rng.standard_normal(16)], k % 2) for k in range(150)]
    data += [(200, data[0][1], 0), (201, [2 * x for x in data[0][1]], 0), (202, data[0][1], None), (203, None, 0), (204, [0.0] * 16, 0), (205, [math.nan] * 16, 0), (206, [None] * 16, 0), (207, data[0][1][:8], 0), (208, [], 0), (None, data[0][1], 0)]
    ok = lambda v, label: label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    links, forest = [0] * len(data), Forest()
    unit = [np.array(v) / np.linalg.norm(v) if ok(v, label) else None for _, v, label in data]
    for i in range(len(data)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and data[i][2] == data[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                forest.join(i, j)
    least = {}
    for k, (i, _, _) in enumerate(data):
        if i is not None:
            least[forest.root(k)] = min(i, least.get(forest.root(k), i))
    want = Counter((i, links[k], least.get(forest.root(k)), i is not None and i == least.get(forest.root(k))) for k, (i, _, _) in enumerate(data))
    got = embedding_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"))
    assert Counter(map(tuple, got.collect())) == want
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).collect() == []


def test_embedding_dedup_finds_planted_pairs(spark):
    """1500 pairs just above the threshold among vectors of 64 numbers, with one label and several."""
    rng = np.random.default_rng(12)
    base = rng.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((1500, 64))
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.9801, 0.985, (1500, 1))
    near = 3 * (cosine * base + np.sqrt(1 - cosine**2) * side)
    data = [(k, v.tolist(), k % 1500 % 3) for k, v in enumerate(np.concatenate([base, near]))]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()}
    found = sum(got[k].component_id == got[k + 1500].component_id == k for k in range(1500))
    assert found == 1500 and all(r.n_links == 1 for r in got.values())


def test_embedding_dedup_with_shared_ids(spark):
    a, b = np.eye(8)[0], np.eye(8)[1]
    near = lambda v: (v + 0.01 * np.eye(8)[7]).tolist()
    data = [(1, a.tolist(), 0), (1, b.tolist(), 0), (1, np.eye(8)[2].tolist(), 1), (2, near(a), 0), (3, near(b), 0), (4, near(np.eye(8)[2]), 1)]
    data += [(None, np.eye(8)[k].tolist(), 0) for k in (3, 4, 5)] + [(10 + k, near(np.eye(8)[k]), 0) for k in (3, 4, 5)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(3))
    want = [(1, 1, 1, True)] * 3 + [(k, 1, 1, False) for k in (2, 3, 4)] + [(None, 1, 10 + k, False) for k in (3, 4, 5)] + [(10 + k, 1, 10 + k, True) for k in (3, 4, 5)]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_fingerprints(spark, docs, rows, empty):
    chain = sorted(rows, key=lambda r: r[1] or "", reverse=True)
    chain.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = Counter()
    for k, (i, t) in enumerate(chain):
        following = chain[(k + 1) % len(chain)][1] or ""
        t = t or ""
        n = len(t) // 3
        want[i, len(t), hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest()] += 1
    got = fingerprints.compare_with_edits(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by = {}
    for r, t in [(r, t) for r in got for i, t in rows if i == r.doc_id and r.n_chars == len(t or "")]:
        by.setdefault(t or "", set()).add(r.fingerprint)
    assert by["" ] == {""} and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.compare_with_edits(empty).collect() == []


def slow_print(text, bins=512, bits=4):
    """The least hash of each bin, empty bins from the first full one that their probes meet; low bits."""
    part = np.frombuffer((text or "").encode(), np.uint8)
    sh, _ = fingerprints.shingle_hashes(*fingerprints.word_hashes(part, np.array([0, len(part)])))
    if not len(sh):
        return None
    own = {}
    for h in sh.tolist():
        own[h >> 55] = min(h, own.get(h >> 55, h))
    out = []
    for b in range(bins):
        at, attempt = b, 0
        while at not in own:
            attempt += 1
            at = int(fingerprints.mix(np.array([(b * 0x9E3779B97F4A7C15 + attempt) % 2**64], np.uint64))[0]) % bins
        mixed = lambda x: int(fingerprints.mix(np.array([x], np.uint64))[0])
        out.append((own[at] if at == b else mixed(own[at] ^ mixed(b + 1))) % 2**bits)  # a borrowed value is hashed with the bin
    return out


def test_fingerprints_against_slow_ones(spark, docs, rows):
    chain = sorted(rows, key=lambda r: r[1] or "", reverse=True)
    chain.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = Counter()
    alike = lambda x, y: float(x is y is None) if x is None or y is None else min(1, max(0, (sum(a == b for a, b in zip(x, y, strict=True)) / 512 - 1 / 16) / (1 - 1 / 16)))
    shown = lambda x: "" if x is None else bytes(x[k] | x[k + 1] << 4 for k in range(0, 512, 2)).hex()
    for k, (i, t) in enumerate(chain):
        t, following = t or "", chain[(k + 1) % len(chain)][1] or ""
        n = len(t) // 3
        own, other, after = slow_print(t), slow_print(t[: len(t) - n] + following[:n]), slow_print(following)
        want[i, shown(own), shown(other), round(alike(own, other), 9), round(alike(own, after), 9)] += 1
    got = fingerprints.compare_with_edits(docs).collect()
    assert Counter((r.doc_id, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want


def test_fingerprints_of_repeated_ids(spark):
    """Null ids and one id of very many rows are cut further; the order stays."""
    data = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, text_of(k % 400, 3 + k % 9)) for k in range(1500)]
    chain = sorted(data, key=lambda r: r[1].encode(), reverse=True)
    chain.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = Counter()
    for k, (i, t) in enumerate(chain):
        n = len(t) // 3
        want[i, hashlib.sha256((t[: len(t) - n] + chain[(k + 1) % len(chain)][1][:n]).encode()).hexdigest()] += 1
    got = fingerprints.compare_with_edits(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == want


def test_likeness_is_near_the_truth():
    a, b = text_of(1, 900).split(), text_of(2, 300).split()
    for cut in (0, 150, 450, 750):
        x, y = " ".join(a), " ".join([*a[: 900 - cut], *b[:cut]])
        true = len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y))
        prints = fingerprints.fingerprints(pa.array([x, y]))
        assert abs(fingerprints.likeness(prints[:1], prints[1:])[0] - true) < 0.12


def test_short_unrelated_texts_are_unlike():
    texts = [text_of(1000 + k, 1 + k % 10) for k in range(400)]
    prints = fingerprints.fingerprints(pa.array(texts))
    for k in range(1, 400):
        like = fingerprints.likeness(prints[k:], prints[:-k])
        apart = [not shingles(x) & shingles(y) for x, y in zip(texts[k:], texts[:-k], strict=True)]
        assert like[apart].max(initial=0) < 0.2
    few = [" ".join(f"s{i}" for i in range(n)) for n in range(5, 12)]
    near = fingerprints.fingerprints(pa.array(few))
    for i, j in combinations(range(len(few)), 2):
        a, b = shingles(few[i]), shingles(few[j])
        assert abs(fingerprints.likeness(near[i : i + 1], near[j : j + 1])[0] - len(a & b) / len(a | b)) < 0.3


def test_fingerprints_of_the_largest_id(spark):
    data = [(2**63 - 1, "w%d" % (k % 50)) for k in range(600)] + [(-(2**63), "x"), (1, "y")]
    got = fingerprints.compare_with_edits(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in data)


def test_mixing(spark, docs, rows, empty):
    got = mixing.plan(docs).collect()
    size = Counter()
    for r in got:
        size[r.mix_source] += r.size
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(size.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * size[s]}
        for s in over or free:
            target[s] = 3.0 * size[s] if over else weight[s] * level
            rest -= target[s]
        free -= over or free
    for r in got:
        assert r.source_size == size[r.mix_source] and r.target == pytest.approx(target[r.mix_source])
        rate = target[r.mix_source] / size[r.mix_source]
        assert r.copies in (math.floor(rate), math.floor(rate) + 1) and r.taken == r.copies * r.size and r.copies <= 3
    emitted = mixing.emit(docs)
    assert emitted.columns == docs.columns and emitted.count() == sum(r.copies for r in got)
    assert mixing.plan(empty).collect() == []
    same = mixing.plan(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.copies) for r in same) == Counter((r.doc_id, r.copies) for r in got)


def test_sharding(docs, rows, empty):
    got = sharding.place(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 8) for r in got) and all(0 <= r.shard < 8 for r in got)
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert sharding.place(empty).collect() == []


def test_shards_are_the_least_draws(docs):
    def draw(key, name, weight):
        return -math.log((int(hashlib.md5(f"{key}|{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weight

    def shard(key, tree):
        for level in ("region", "rack", "shard"):
            size = lambda x: sum(map(size, x.values())) if isinstance(x, dict) else x
            won = min(tree, key=lambda c: draw(key, f"{level}{c}", size(tree[c]))) if len(tree) > 1 else next(iter(tree))
            tree = tree[won]
        return won

    for r in sharding.place(docs).collect():
        key = "" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (shard(key, sharding.layout(8)), shard(key, sharding.layout(9)))


def test_sharding_follows_weights(spark):
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    weights = [1.0, 2.0, 1.0, 1.0, 1.0, 1.0, 1.0, 4.0]
    counts = {r["shard"]: r["count"] for r in sharding.place(keys, 8, weights).groupBy("shard").count().collect()}
    for s, w in enumerate(weights):
        assert counts[s] == pytest.approx(20_000 * w / sum(weights), rel=0.12)


def test_url_filters(spark):
    page = lambda k, url, *links: (k, url, "".join(f'<a href="{x}">x</a>' for x in links), "h")
    data = [page(1, "http://A.example.NET/en/x?q#f"), page(2, "http://a.example.net/de/x"), page(3, "https://example.com/de/"), page(4, "http://xexample.com/de/"), page(5, "http://b.org/fr/?z"), page(6, "http://b.org/en", "/de"), page(7, None), page(8, "no scheme"), page(9, "http://c.net"), page(9, "http://c.net")]
    data += [page(10, "http://b.org/fr?z"), page(11, "http://b.org/france"), page(12, "http://c.net:1/fr/")]
    data += [page(20 + k, f"http://farm.io/{k}", "http://bad.net/1", "http://bad.net/2") for k in range(3)] + [page(30 + k, f"http://bad.net/{k}", "http://bad.net/0") for k in range(3)] + [(40, "http://n.io/", None, None)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(spark.createDataFrame(data, "page_id long, url string, html string, host string")).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2][2:] == ("net/", "block") and got[3][2:] == ("example.com/de/", "block") and got[4][2:] == (None, "allow")
    assert got[5][2:] == ("org/fr/", "allow") and got[6][2:] == (None, "allow")
    assert got[10][2:] == got[11][2:] == (None, "allow") and got[12] == ("c.net:1", "/fr/", None, "allow")
    assert got[7] == ("", "", None, "allow") == got[8] and got[9] == ("c.net", "", None, "allow")
    assert got[20][2:] == (None, "block") and got[30][2:] == ("net/", "block") and got[40][3] == "allow"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filters.judge(empty).collect() == []
    long = spark.createDataFrame([(None, "x://h.org/fr/" + "a" * 100_000, "<a href='y://z.io/'>" * 5000), (None, "x://h.org/fr/" + "a" * 100_000, "")], "page_id long, url string, html string")
    assert [(r.page_id, r.host, len(r.path), r.verdict) for r in url_filters.judge(long).collect()] == [(None, "h.org", 100_004, "allow")] * 2


def solved(names, edges, seeds, others, turn):
    """The fixed point as a system of equations; ``others`` are the seeds of the other kind."""
    flow = np.zeros((len(names), len(names)))
    for a, b, n in edges:
        flow[names.index(a), names.index(b)] += n
    flow = flow.T if turn else flow
    total = flow.sum(axis=1, keepdims=True)
    flow = np.divide(flow, total, out=np.zeros_like(flow), where=total > 0)
    flow[np.array(others) > 0] = 0
    return np.linalg.solve(np.eye(len(names)) - 0.85 * flow.T, 0.15 * np.array(seeds))


def test_page_rank_matches_matrix(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "a", 1), ("c", "d", 1), ("d", "a", 1), ("e", "a", 3)]
    seeds = [("a", 0.0, 0.6), ("b", 1.0, 0.0), ("c", 0.0, 1.0), ("d", 0.0, 0.0), ("e", 0.0, 0.0)]
    got = {r.host: (r.trust, r.distrust) for r in url_filters.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, good double, bad double")).collect()}
    for kind in (0, 1):
        want = solved("abcde", edges, [s[1 + kind] for s in seeds], [s[2 - kind] for s in seeds], kind)
        assert [got.get(n, (0, 0))[kind] for n in "abcde"] == pytest.approx(list(want), abs=2e-5)


@pytest.mark.parametrize("farm", [1, 3, 40])
def test_url_verdicts_on_linked_hosts(spark, farm):
    """Hosts without rules get the verdict of ranks solved independently, however large the farm."""
    links = {"bad.net": ["f0.io"], "good.org": ["shop.io", "news.io"], "shop.io": ["news.io", "bad.net"], "news.io": ["good.org", "deep.io"], "deep.io": ["shop.io"], "far.io": ["deep.io"], "mixed.org": ["bad.net"]}
    links |= {f"f{k}.io": ["bad.net", f"f{(k + 1) % farm}.io"] for k in range(farm)}
    rows = [(h, p) for h in links for p in (("/fr/1", "/fr/2") if h == "good.org" else ("/fr/1", "/x", "/y") if h == "mixed.org" else ("/1", "/2"))]
    pages = [(k, f"http://{h}{p}", "".join(f'<A class=x HREF="http://{x.upper()}/z">' for x in [*links[h], h])) for k, (h, p) in enumerate(rows)]
    got = url_filters.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    names = sorted(links)
    edges = [(h, x, 1) for h in links for x in links[h] if x != h]
    good, bad = [float(h == "good.org") for h in names], [float(h.endswith(".net")) for h in names]
    trust, distrust = solved(names, edges, good, bad, False), solved(names, edges, bad, good, True)
    blocked = {h for h, t, d in zip(names, trust, distrust, strict=True) if d > 1e-4 and d / (t + d) > 0.5}
    assert {f"f{k}.io" for k in range(farm)} | {"mixed.org"} <= blocked and "news.io" not in blocked
    for r in got:
        if r.rule is None:
            assert (r.verdict == "block") == (r.host in blocked), r


def test_packing(docs, rows, empty):
    got = packing.pack(docs, (8, 64, 512)).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(i for i, _ in rows)
    assert sum(r.n_tokens for r in got) == sum(len(words(t)) for _, t in rows)
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
    for members in bins.values():
        members.sort(key=lambda r: (r.bin_offset, r.n_tokens))
        at = 0
        for r in members:
            assert r.bin_offset == at
            at += r.n_tokens
        assert at == members[0].bin_tokens <= members[0].bin_capacity == min(c for c in (8, 64, 512) if c >= at)
    assert packing.pack(empty).collect() == []


def slow_fit(sizes, lengths, cost):
    """(contents, length) of bins, with lists alone; ``cost`` names all lengths, ``lengths`` those to open."""
    bins, rest = [], list(sizes)
    while rest:
        size = rest.pop(0)
        fits = [b for b in bins if 0 < b[1] - b[0] >= size]
        if fits:  # of equal rooms the one touched last
            b = min(fits, key=lambda b: (b[1] - b[0], b[2]))
            b[0], b[2] = b[0] + size, len(rest)
            continue
        tried = []
        for c in [c for c in lengths if c >= size]:
            used = size
            for s in rest:
                if s and used + s <= c:
                    used += s
            tried.append((Fraction(cost[next(x for x in cost if x >= used)], used) if used else 0, -c))
        bins.append([size, -min(tried)[1] if size else lengths[0], len(rest)])
    return [(b[0], next(c for c in cost if c >= b[0])) for b in bins]


@pytest.mark.parametrize("lengths", [(16, 64), (8, 20, 32, 64)])
def test_best_fit_is_best_fit(lengths):
    for seed in range(30):
        rng = np.random.default_rng(seed)
        sizes = sorted(rng.choice(rng.integers(0, lengths[-1] + 1, 12), 80).tolist(), reverse=True)
        cost = {c: packing.cost_of(c, 2, 100) for c in lengths}
        of, used = packing._fill(sizes, lengths, cost)
        assert sorted(used) == sorted(n for n, _ in slow_fit(sizes, lengths, cost))
        assert [sum(s for s, b in zip(sizes, of, strict=True) if b == k) for k in range(len(used))] == used
        _, used, capacities = packing.best_fit(sizes, lengths, 2, 100)
        every = [slow_fit(sizes, (*x, lengths[-1]), cost) for k in range(len(lengths)) for x in combinations(lengths[:-1], k)]
        assert sum(cost[c] for c in capacities) == min(sum(cost[c] for _, c in bins) for bins in every)
        assert all(c == next(x for x in lengths if x >= n) for n, c in zip(used, capacities, strict=True))


def test_mixed_lengths_cost_less_than_any_single_one():
    sizes = sorted([1000] * 30 + [500] * 9 + [700] * 40 + [2048] * 7 + [1500] * 12, reverse=True)
    lengths = packing.LENGTHS
    cost = {c: packing.cost_of(c) for c in lengths}
    _, _, capacities = packing.best_fit(sizes)
    assert len(set(capacities)) > 1
    for c in (2048, 4096):  # the lengths that hold every piece
        assert sum(cost[c] for c in capacities) < 0.98 * sum(cost[c] for _, c in slow_fit(sizes, (c,), {c: cost[c]}))
    assert set(packing.best_fit(sorted([510] * 40 + [1020] * 20 + [2040] * 11 + [4000] * 5, reverse=True))[2]) == set(lengths)


def test_token_counts(spark, docs, rows, empty):
    pieces = token_counts.read_vocabulary(token_counts.VOCABULARY)
    known = set(pieces)

    def greedy(w):
        n = 0
        while w:
            w = w[max(k for k in range(1, min(len(w), 140) + 1) if w[:k] in known) :]
            n += 1
        return n

    got = Counter(map(tuple, token_counts.token_counts(docs, pieces).collect()))
    assert got == Counter((i, len((t or "").encode()), len(WORD.findall(t or "")), sum(greedy(b" " + w.encode()) for w in WORD.findall(t or ""))) for i, t in rows)
    assert token_counts.token_counts(empty, pieces).collect() == []


def test_longest_match_with_gaps():
    automaton = token_counts.LongestMatch([b"ab", b"abcd", b"c", b"a", b"bcx"])
    assert [automaton.count(w) for w in (b"abc", b"abcd", b"abcx", b"aab", b"zz", b"ab")] == [2, 1, 1, 2, 1, 1]


def test_levenshtein_lexicon():
    lexicon = toxicity.Lexicon([("idiot", False), ("vequ", True), ("scum", False)], {(0, 0): 0.9, (0, 1): 0.5, (1, 0): 0.9, (2, 0): 0.9}, 0.01)
    assert lexicon.match("idiot") == (0, 0) and lexicon.match("vequade") == (1, 0)
    for word in ("idoit", "idjot", "idiiot", "idiat", "idio", "xidiot"):
        assert (lexicon.match(word) == (0, 1)) == (word != "idoit")  # a swap is two edits
    assert lexicon.match("scam") is None and lexicon.match("") is None
    plain, quoted = (lexicon.score(t, {})[0] for t in ("you are an idiot there", 'they said “what an idiot” there'))
    assert plain > quoted > lexicon.score("a fine day", {})[0]


def test_links_are_those_that_a_page_shows(spark):
    pages = [
        '<a data-href="http://bad.net/x" href="http://good.org/">', '<!-- <a href="http://hidden.net/"> -->', "<a title='a>b' href=http://bare.org/x>", "<A\nclass=c\nHREF = 'http://single.org/'>",
        '<script>var s = "<a href=\'http://script.net/\'>"</script>', '<abbr href="http://abbr.net/">', '<a title=\'href="http://fake.net/"\' href="//noscheme.org/p">', '<a href="/own">', '<a x="' + "y" * 200_000, "<a " + "b " * 50_000 + ">", '<!-- open <a href="http://late.net/">',
    ]
    df = spark.createDataFrame([("http://host.com/", p) for p in pages], "url string, html string")
    assert {r.dst for r in url_filters.host_edges(df).collect()} == {"good.org", "bare.org", "single.org", "noscheme.org"}


def test_toxicity_sample_takes_an_id_once(spark, monkeypatch):
    rows = [(8, f"gromble text{k}") for k in range(3000)] + [(k, "gromble word") if k % 5 == 0 else (k, f"clean w{k}") for k in range(10, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0 or k == 8)) for k in (8, *range(10, 300))], "doc_id long, toxic int")
    seen, cover = [], toxicity._cover
    monkeypatch.setattr(toxicity, "_cover", lambda toxic, told: seen.append(toxic.count()) or cover(toxic, told))
    lexicon = toxicity.learn(docs, labels)
    assert seen[0] <= 60 and toxicity.score(docs.where("doc_id = 8"), lexicon).where("score >= 0.3").count() == 3000


def test_toxicity_learns(spark):
    rng = np.random.default_rng(5)
    def doc(k):
        text = text_of(k, 60).split()
        if k % 5 == 0:
            text[int(rng.integers(0, 60))] = ["gromble", "snackel", "zuppe" + "abc"[k % 3]][k % 3]
        return k, " ".join(text), "x"
    made = [doc(k) for k in range(600)] + [(900, None, "x"), (901, "", "x"), (None, "gromble", "x"), (902, "a gromblee b", "x")]
    docs = spark.createDataFrame(made, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(600)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.row.doc_id: r.score for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([(got[k] >= 0.3) == (k % 5 == 0) for k in held]) > 0.97
    assert got[900] == got[901] < 0.3 and got[902] >= 0.3
    assert toxicity.reject(docs, labels).columns == docs.columns
    lexicon = toxicity.learn(docs, labels)
    assert toxicity.score(docs.limit(0), toxicity.learn(docs.limit(0), labels)).collect() == []
    odd = spark.createDataFrame([(1, "gromble " + "w " * 300_000, "x"), (2, "a" * 1_000_000, "x"), (3, "gromble", "x"), (3, "gromble", "x")], "doc_id long, text string, score string")
    found = [(r.row.doc_id, r.score >= 0.3) for r in toxicity.score(odd, lexicon).collect()]
    assert sorted(found) == [(1, True), (2, False), (3, True), (3, True)]
    assert toxicity.reject(docs, labels.limit(0)).count() == docs.count()


def greedy(pieces, word):
    out, known = [], {p: k for k, p in enumerate(pieces)}
    while word:
        n = max(k for k in range(1, min(len(word), 140) + 1) if word[:k] in known)
        out.append(known[word[:n]])
        word = word[n:]
    return out


def slow_score(fitted, texts):
    """Log10 probabilities of texts, place by place, in double precision."""
    vocabulary, index, (outer, inner), n, other = fitted["shared"].value
    p = {k: v.astype(float) for k, v in attention_model.unflat(fitted["weights"].value, n).items()}
    classes, k = attention_model.layout(n)
    m, end = attention_model, len(vocabulary)

    def weight(bits):  # straight between the powers of two
        x = bits / 2**23 - 127
        return 2.0 ** math.floor(x) * (1 + x - math.floor(x))

    out, stream, starts = [], [], []
    for t in texts:
        starts.append(len(stream))
        stream += [index[r] for w in words(t) for r in greedy(vocabulary, b" " + w.encode())] + [index[end]]
    starts.append(len(stream))
    for a, b in zip(starts, starts[1:]):
        total = 0.0
        before = [n, *stream[a : b - 1]]
        x = p["of"][before]
        for i in range(b - a):
            least = max(0, i // m.STRIDE * m.STRIDE - m.REACH)
            scores = [x[i, m._Q] @ x[j, m._K] * m.KEY**-0.5 + p["near"][i - j] for j in range(least, i + 1)]
            share = np.array([weight(v * m._SCALE + m._ONE) for v in scores])
            c = (share / share.sum()) @ x[least : i + 1, m._V]
            z = np.maximum(c @ p["in"] + x[i, m._S] + p["shift"], 0)
            id_ = stream[a + i]
            c = id_ // k
            for bits, own in ((z @ p["out"] * m._SCALE + outer[before[i]], c), (z @ p["inner"][c] * m._SCALE + inner[before[i] * classes + c], id_ - c * k)):
                w = [weight(v) if v > 0 else 0.0 for v in bits]
                total += math.log(w[own] / sum(w))
            total += other if id_ == n - 1 else 0
        out.append(total / math.log(10))
    return out


def test_lm_scoring(spark, docs, rows, empty):
    pieces = token_counts.read_vocabulary(lm_scoring.VOCABULARY)
    fitted = lm_scoring.fit(docs, pieces, every=1)
    got = lm_scoring.score(docs, fitted).collect()
    code = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    tokens = lambda t: [*words(t), 0]
    counts = Counter(w for i, t in rows if code(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
    want = Counter((i, code(i) == 0, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(base(t), 6)) for i, t in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    found = {(r.doc_id, r.n_tokens): r.score for r in got}
    odd = spark.createDataFrame([(1000, "Zürich ﷽ 漢字 w1"), (1001, "w1 w2 w3 w4 w5")], "doc_id long, text string")
    alone = {r.doc_id: r.score for r in lm_scoring.score(odd, fitted).collect()}
    for i, t in ((1000, "Zürich ﷽ 漢字 w1"), (1001, "w1 w2 w3 w4 w5")):
        assert alone[i] == pytest.approx(slow_score(fitted, [t])[0], rel=1e-3)
    near = [(slow_score(fitted, [t])[0], found[i, len(tokens(t))]) for i, t in rows if i is not None and i < 5]
    assert all(a == pytest.approx(b, rel=1e-3) for a, b in near)
    assert lm_scoring.score(empty, lm_scoring.fit(empty, pieces)).collect() == []


@pytest.mark.parametrize("settings", [{"every": 1}, {}])
def test_lm_score_in_one_stream(spark, settings):
    texts = [(k, text_of(k, 30)) for k in range(3)]
    fitted = lm_scoring.fit(spark.createDataFrame([(1, text_of(9, 2000)), *texts], "doc_id long, text string"), token_counts.read_vocabulary(lm_scoring.VOCABULARY), **settings)
    got = {r.doc_id: r.score for r in lm_scoring.score(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), fitted).collect()}
    assert [got[k] for k in range(3)] == pytest.approx(slow_score(fitted, [t for _, t in texts]), rel=1e-3)


def test_lm_score_is_of_the_text_alone(spark, docs):
    fitted = lm_scoring.fit(docs, token_counts.read_vocabulary(lm_scoring.VOCABULARY))
    rows = [(k, text_of(k % 5, 7 + 13 * (k % 5))) for k in range(60)]
    by = {}
    for parts in (1, 3, 7):
        for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id"), fitted).collect():
            by.setdefault(r.doc_id % 5, []).append(r.score)
    assert len(by) == 5 and all(max(x) - min(x) <= 3e-6 * abs(x[0]) for x in by.values())  # single precision rounds


def test_lm_base_is_the_same_whatever_is_broadcast(docs):
    fitted = lm_scoring.fit(docs, token_counts.read_vocabulary(lm_scoring.VOCABULARY))
    scores = lambda most: sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 5), round(r.score, 5)) for r in lm_scoring.score(docs, fitted, top_words=most).collect())
    want = scores(400_000)
    for most in (500, 0):
        assert [x for g, w in zip(scores(most), want, strict=True) for x in g] == pytest.approx([x for w in want for x in w], abs=1e-4)


def test_model_learns_from_every_training_text(docs, rows):
    pieces = token_counts.read_vocabulary(lm_scoring.VOCABULARY)
    training = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    fitted = lm_scoring.fit(docs, pieces)
    assert fitted["trained"] == sum(1 + sum(len(greedy(pieces[: lm_scoring.RANKS], b" " + w.encode())) for w in words(t)) for t in training)
    _, _, _, n, _ = fitted["shared"].value
    assert not np.allclose(fitted["weights"].value, attention_model.flat(attention_model.initial(n)))


def test_model_learns_at_every_place(spark):
    pieces = token_counts.read_vocabulary(lm_scoring.VOCABULARY)
    docs = spark.createDataFrame([(k, text_of(k, 200)) for k in range(40)], "doc_id long, text string").coalesce(1)
    got, want, part = (lm_scoring.fit(docs, pieces, **s)["weights"].value for s in ({}, {"every": 1}, {"every": 3}))
    np.testing.assert_allclose(got, want, atol=1e-3)
    assert not np.allclose(got, part, atol=1e-3)


def test_model_beats_the_base_held_out(spark):
    """Two languages; a text keeps to one, so attention to earlier words tells which words can follow."""
    rng = np.random.default_rng(8)
    made = [(k, " ".join(("a%d" if k % 2 else "b%d") % x for x in rng.integers(0, 40, 60))) for k in range(1500)]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(2)
    got = lm_scoring.score(docs, lm_scoring.fit(docs, token_counts.read_vocabulary(lm_scoring.VOCABULARY), every=1)).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_pieces_are_greedy():
    pieces = token_counts.read_vocabulary(lm_scoring.VOCABULARY)[: lm_scoring.RANKS]
    texts = ["the Übung of  words\n", "", "x" * 3000, " ".join("q%x" % (k * 7919) for k in range(2000))]
    data = "".join(texts).encode()
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = lm_scoring.Texts(lm_scoring.Pieces(pieces), np.frombuffer(data, np.uint8), at)
    want = [[r for w in words(t) for r in greedy(pieces, b" " + w.encode())] + [got.end] for t in texts]
    assert got.ranks.tolist() == [r for t in want for r in t] and got.text.tolist() == [k for k, t in enumerate(want) for _ in t]
    assert got.before.tolist() == [r for t in want for r in [got.start, *t[:-1]]]


def test_one_text_of_many_distinct_words(spark):
    docs = spark.createDataFrame([(1, " ".join("%x" % (k * 2654435761 % 2**32) for k in range(500_000))), (2, "one two")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.score(docs, lm_scoring.fit(docs, token_counts.read_vocabulary(lm_scoring.VOCABULARY))).collect()}
    assert got[1].n_tokens == 500_001 and math.isfinite(got[1].score) and got[2].n_tokens == 3


def test_model_adds_up_a_place_once(monkeypatch):
    """Windows overlap; a place's row is scattered once, and the whole is the sum of the windows' own gradients."""
    rng, n = np.random.default_rng(6), 30
    text = np.repeat([0, 1, 2], [90, 3, 41])
    ids = rng.integers(0, n, len(text)).astype(np.int32)
    before = np.concatenate([[n], ids[:-1]]).astype(np.int32)
    before[[90, 93]] = n
    pairs, counts = np.unique(before.astype(np.int64) * n + ids, return_counts=True)
    fixed = attention_model.bigrams(n, pairs // n, pairs % n, counts.astype(float))
    p = {k: (v + 0.1 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in attention_model.initial(n).items()}
    scatter, sizes = attention_model._scatter, []
    monkeypatch.setattr(attention_model, "_scatter", lambda index, *rest: (sizes.append(len(index)), scatter(index, *rest)))
    for step in (1, 2):  # windows that follow one another, and windows with gaps
        chosen = attention_model.begins(text)[::step]
        ((place, rows, b, t),) = attention_model._slabs(before, text, chosen)
        sizes.clear()
        _, whole = attention_model.gradient(p, fixed, rows, b, t, ids[place])
        if step == 1:
            assert sizes == [16 * len(chosen)] * 2
        parts = [(len(r), attention_model.gradient(p, fixed, r, w, o, ids[at])[1]) for at, r, w, o in (next(attention_model._slabs(before, text, chosen[k : k + 1])) for k in range(len(chosen)))]
        for name in whole:
            assert np.allclose(whole[name], sum(m * g[name] for m, g in parts) / len(rows), atol=2e-6), name


def test_model_places_and_gradient(monkeypatch):
    rng = np.random.default_rng(6)
    n, lengths = 30, np.array([1, 60, 16, 13, 70])
    ids, text = rng.integers(0, n, 160), np.repeat(np.arange(5), lengths)
    before = np.concatenate([[n], ids[:-1]])
    before[np.cumsum(lengths)[:-1]] = n
    pairs, counts = np.unique(before * n + ids, return_counts=True)
    fixed = attention_model.bigrams(n, pairs // n, pairs % n, counts.astype(float))
    p = {k: (v + 0.05 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in attention_model.initial(n).items()}
    slabs = list(attention_model._slabs(before, text, attention_model.begins(text)))
    assert attention_model.begins(text).tolist() == [0, 1, 17, 33, 49, 61, 77, 90, 106, 122, 138, 154]
    assert np.concatenate([x for x, _, _, _ in slabs]).tolist() == list(range(160))
    (place, at, b, t), = slabs
    loss, grad = attention_model.gradient(p, fixed, at, b, t, ids[place])
    places = attention_model.log_probabilities(p, fixed, before, ids, text)
    assert -places.mean() == pytest.approx(loss, abs=1e-3)
    # shares sum to 1 whatever comes next
    last = [attention_model.log_probabilities(p, fixed, before[:77], np.concatenate([ids[:76], [k]]), text[:77])[-1] for k in range(n)]
    assert np.exp(last).sum() == pytest.approx(1, abs=1e-4)
    # the gradient is that of weights exp(x), which those used follow
    monkeypatch.setattr(attention_model, "_weights", lambda bits, least=0: np.exp((bits - attention_model._ONE) / attention_model._SCALE))
    p = {k: v.astype(float) for k, v in p.items()}
    loss, grad = attention_model.gradient(p, fixed, at, b, t, ids[place])
    assert -places.mean() == pytest.approx(loss, abs=0.05)
    for name in p:
        step = 1e-5 / np.linalg.norm(grad[name]) * grad[name]  # short, as the loss has kinks
        up, down = (attention_model.gradient(p | {name: p[name] + sign * step}, fixed, at, b, t, ids[place])[0] for sign in (1, -1))
        assert (up - down) / 2e-5 == pytest.approx(np.linalg.norm(grad[name]), rel=1e-3)


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{sf}/documents.parquet")
    columns, names = df.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 4
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, sf).persist()
        if name != names[-1]:
            assert out.columns == columns
            assert out.select("doc_id").distinct().join(df.select("doc_id"), "doc_id", "left_anti").count() == 0
            df = out
    assert out.where("piece = 0").count() == df.count()


def test_pipeline_with_odd_rows(spark, tmp_path):
    import corpus_pipeline

    data = [(k, text_of(k, 30), "en", "ab"[k % 2], 3, "x", 1) for k in range(40)]
    data += [(None, text_of(90, 30), "en", None, 3, "x", 1), (50, None, None, None, None, None, None), (51, "", "en", "a", 0, "x", 1), (52, text_of(5, 30), "en", "b", 3, "x", 1)]
    data += [(7, text_of(7, 30), "en", "b", 3, "x", 1), (60, text_of(60, 40_000), "en", "a", 3, "x", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, row string, size long")
    labels = spark.createDataFrame([(k, 0, 0) for k in range(40)] + [(None, 1, 1), (50, None, None)], "doc_id long, quality int, toxic int")
    for name, rows in (("full", docs), ("empty", docs.limit(0))):
        folder = str(tmp_path / name)
        rows.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == [c.split()[0] for c in packing.SCHEMA.split(", ")]
        ids = Counter(r.doc_id for r in out.where("piece = 0").collect())
        if name == "empty":
            assert not ids
        else:
            assert 52 not in ids and set(ids) <= {i for i, *_ in data} and sum(ids.values()) > 20
            assert out.agg(F.sum("n_tokens")).first()[0] == sum(n * len(words(next(t for i, t, *_ in data if i == k))) for k, n in ids.items())
