"""URL filters with link-graph propagation.

A url's host and path meet a fixed set of (host, path) rules; the longest
rule that fits decides.  A url without a rule gets its host's verdict.  A host
is a trusted (blocked) seed, with that share as its weight, if rules allow
(block) more than half of its pages.  Trust flows along links to other hosts
and distrust against them (a host that links to bad hosts is suspect), both as
personalised PageRank to its fixed point; links of a host to itself carry
nothing, blocked seeds hand on no trust and trusted ones no distrust.  A host is blocked if its distrust exceeds ``FLOOR`` and is more than
``THRESHOLD`` of its trust and distrust together, a share which does not hang
on how many other hosts there are.  What reaches a host without links onwards
ends there.

Defined results: a null url, or one without ``://``, has empty host and path
and no rule, and is allowed, since no host speaks against it; null html has no
links; repeated rows each give a row and count as pages of their host; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import kept

# fixed values: verdict, host, path of each rule
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
DAMPING, SETTLED, THRESHOLD, FLOOR = 0.85, 1e-5, 0.5, 1e-4
STORED = 6  # rounds between stored states
SALTS = 32  # parts into which a host's pages are dealt
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = None
    for verdict, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


# what holds no links, and an anchor up to its href, past other attributes and their quoted values (as many as a
# pattern can pass without growing its stack)
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
_OTHER = r"""[\s/]++(?!href\s*+=)[^\s"'>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+"""
_HREF = rf"""(?i)<a(?:{_OTHER}){{0,200}}+[\s/]++href\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)"""


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, n: links from hosts to other hosts."""
    shown = F.regexp_replace(F.coalesce(pages[html_col], F.lit("")), _HIDDEN, " ")
    links = F.transform(F.regexp_extract_all(shown, F.lit(_HREF), F.lit(1)), lambda x: F.btrim(x, F.lit("\"' \t\r\n")))
    rows = pages.select(host_of(pages[url_col]).alias("src"), links.alias("links")).where("src != ''")
    # a link without a host is one to its own
    absolute = F.transform(F.col("links"), lambda x: F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x))
    targets = F.filter(F.transform(absolute, host_of), lambda x: (x != "") & (x != F.col("src")))
    return rows.select("src", F.explode(targets).alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, settled: float = SETTLED) -> DataFrame:
    """host, trust, distrust at the fixed point; ``seeds`` has host, good, bad in 0..1.

    Both directions run as one graph whose nodes are (kind, host).  State is
    one row a host that anything has reached, stored every few rounds, which
    cuts the lineage.  A round shrinks what may still change by ``damping``.
    """
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "n").unionAll(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "n")
    )
    out = both.groupBy("kind", "a").agg(F.sum("n").alias("all"))
    weights = kept(both.join(out, ["kind", "a"]).select("kind", "a", "b", (F.col("n") / F.col("all")).alias("w")))
    start = seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("good"), F.lit("distrust"), F.col("bad"))).alias("kind", "seed"))
    start = kept(start.where("seed > 0").select("kind", F.col("host").alias("a"), (F.col("seed") * (1 - damping)).alias("seed")))
    other = F.when(F.col("kind") == "trust", "distrust").otherwise("trust")
    weights = kept(weights.join(start.select(other.alias("kind"), "a"), ["kind", "a"], "left_anti"))
    state = start.withColumnRenamed("seed", "rank")
    while True:
        for _ in range(STORED):
            old = state
            flow = old.join(weights, ["kind", "a"]).groupBy("kind", "b").agg(F.sum(F.col("rank") * F.col("w")).alias("flow"))
            state = start.join(flow.withColumnRenamed("b", "a"), ["kind", "a"], "full").select("kind", "a", (F.coalesce("seed", F.lit(0.0)) + F.coalesce("flow", F.lit(0.0)) * damping).alias("rank"))
        # the last round's change, of which later ones are at most damping / (1 - damping) together
        both = kept(state.join(old.withColumnRenamed("rank", "was"), ["kind", "a"], "full"))
        moved = both.agg(F.max(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0]
        state = both.where("rank is not null").select("kind", "a", "rank")
        if moved is None or moved * damping / (1 - damping) < settled:
            break
    value = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    return state.groupBy(F.col("a").alias("host")).agg(value("trust"), value("distrust"))


def judge(pages: DataFrame, rules: tuple = RULES, threshold: float = THRESHOLD, floor: float = FLOOR, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    url = pages[url_col].cast("string")
    rows = pages.select(pages[id_col].alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    share = lambda verdict: F.avg(F.coalesce(F.col("found.verdict") == verdict, F.lit(False)).cast("double"))
    most = lambda verdict: F.when(share(verdict) > 0.5, share(verdict)).otherwise(0.0)
    seeds = rows.where("host != ''").groupBy("host").agg(most("allow").alias("good"), most("block").alias("bad"))
    ranks = propagate(kept(host_edges(pages, url_col, html_col)), seeds)
    bad = ranks.where((F.col("distrust") > floor) & (F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))))
    # a host may hold a third of all pages: its rows are dealt into parts, each of which meets its verdict
    bad = bad.select(F.col("host").alias("bad_host"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("bad_salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    judged = salted.join(bad, (F.col("host") == F.col("bad_host")) & (F.col("salt") == F.col("bad_salt")), "left")
    method = F.when(F.col("bad_host").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.verdict"), method).alias("verdict"))
