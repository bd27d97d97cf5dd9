"""The registered queries of the document operators, and their SQL.

Each query runs over its whole tables.  Counts and indexes are longs on both
sides; scores are rounded to six digits before they are ranked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, paths, text, vectors
from ..operators import catalog as records
from ..operators import chunking, dense, downloads, ingest, metrics, postings, retrieval, tracking, transcripts
from ..sources.readers import literal_list
from ..sources.snapshots import Store
from ..sources.storage import work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

EVERY = 20  # rows whose id it divides are the query set of the searches
FIXED = chunking.Limits(500, 50, 50, 2000)
SMALL = chunking.Limits(100, 20, 20, 200)
_SP = text.SPACE
_STRIP = f"regexp_replace({{}}, '^[{_SP.replace('{', '{{').replace('}', '}}')}]+|[{_SP.replace('{', '{{').replace('}', '}}')}]+$', '', 'g')"
_NORMAL = f"regexp_replace(regexp_replace(lower({{}}), '{text.NOT_WORD.replace('{', '{{').replace('}', '}}')}', ' ', 'g'), '[{_SP.replace('{', '{{').replace('}', '}}')}]+', ' ', 'g')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(c) for c, kind in df.dtypes])


def query(name: str, sql: str | None = None):
    """Register a function of (read(table)) under ``name``, with its SQL."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: _long(f(lambda table: _table(spark, sf_dir, table)))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---- text and identifiers


@query("F1_normalize_text", "SELECT doc_id, " + _STRIP.format(_NORMAL.format("text")) + " AS normalized FROM documents")
def _(read):
    return read("documents").select("doc_id", text.normalize_text(F.col("text")).alias("normalized"))


_CLEAN = _STRIP.format(f"regexp_replace(regexp_replace(regexp_replace(text, '(?m)^--- Page \\d+ ---[{_SP}]*$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')")


@query("F11_clean_text", f"SELECT doc_id, {_CLEAN} AS cleaned FROM documents")
def _(read):
    return read("documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query(
    "F12_sentences",
    rf"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?;]+[{_SP}]+)', '\1' || chr(1), 'g'), chr(1)), lambda x: length("""
    + _STRIP.format("x")
    + r""") > 0) AS parts FROM documents)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS nth, parts[i] AS sentence FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM s)""",
)
def _(read):
    return read("documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("nth", "sentence"))


@query("F2_site_id", r"SELECT page_id, 'gl_url_' || substr(sha256(regexp_replace(split_part(split_part(regexp_replace(lower(url), '^.*://', 'x/publications/'), '?', 1), '#', 1)[16:], '/+$', '')), 1, 16) AS id FROM pages")
def _(read):
    url = F.regexp_replace(F.lower("url"), r"^.*://", "x/publications/")
    none = F.lit(None)
    return read("pages").select("page_id", ids.site_id(none.cast("string"), url, none.cast("string"), none.cast("array<string>"), none.cast("int")).alias("id"))


@query("F2_metadata_id", r"SELECT p_partkey, 'gl_' || p_size || '_' || substr(sha256('t:' || " + _STRIP.format(_NORMAL.format("p_name")) + r" || '_a:' || " + _STRIP.format(_NORMAL.format("p_brand")) + r" || '_y:' || p_size), 1, 16) AS id FROM part")
def _(read):
    none = F.lit(None).cast("string")
    return read("part").select("p_partkey", ids.site_id(none, none, F.col("p_name"), F.array("p_brand"), F.col("p_size")).alias("id"))


@query("F3_api_id", "SELECT o_orderkey, 'oa_doi_' || substr(sha256('10.1/' || o_orderkey), 1, 16) AS id FROM orders")
def _(read):
    none = F.lit(None).cast("string")
    doi = F.concat(F.lit("https://doi.org/10.1/"), F.col("o_orderkey").cast("string"), F.lit("/?x#y"))
    return read("orders").select("o_orderkey", ids.api_id(none, F.array(doi), none, none, F.array(none), F.lit(None).cast("int")).alias("id"))


@query("F4_content_hash", "SELECT p_partkey, sha256(p_name || '_[''' || p_brand || ''', ''' || p_type || ''']_' || p_size || '_None_' || 'u' || p_partkey || '_f1') AS hash FROM part")
def _(read):
    none = F.lit(None).cast("string")
    url = F.concat(F.lit("u"), F.col("p_partkey").cast("string"))
    return read("part").select("p_partkey", ids.content_hash(F.col("p_name"), F.array("p_brand", "p_type"), F.col("p_size"), none, url, F.array(F.lit("f1"))).alias("hash"))


_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query("F5_uuid5", f"SELECT doc_id, {_UUID} AS point_id FROM (SELECT doc_id, sha1(unhex('a1b2c3d4e5f67890abcdef1234567890') || encode(doc_id || '_chunk_0000')) AS h FROM documents)")
def _(read):
    return read("documents").select("doc_id", ids.uuid5(ids.chunk_id(F.col("doc_id"), F.lit(0))).alias("point_id"))


_SEGMENT = r"regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '([^/]*)$', 1)"
_EXT = f"CASE WHEN length(e) > 1 AND length(e) <= 10 THEN e ELSE '(no extension)' END AS extension FROM (SELECT *, lower(regexp_extract({_SEGMENT}, '(\\.[^.]*)$', 1)) AS e FROM pages)"


@query("F8_url_parts", f"SELECT page_id, {_SEGMENT} AS segment, {_EXT}")
def _(read):
    return read("pages").select("page_id", text.last_segment(F.col("url")).alias("segment"), text.extension(F.col("url")).alias("extension"))


@query("F6_split_authors", "SELECT s_suppkey, 'Last, F.|' || s_name || ', G.' AS authors, CAST(2 AS BIGINT) AS n FROM supplier")
def _(read):
    rows = read("supplier").select("s_suppkey", text.split_authors(F.concat(F.lit("Last, F. & "), F.col("s_name"), F.lit(", G. "))).alias("a"))
    return rows.select("s_suppkey", F.array_join("a", "|").alias("authors"), F.size("a").alias("n"))


@query("F7_lecture_slug", "SELECT o_orderkey, CASE WHEN o_orderkey < 10 THEN '0' || o_orderkey ELSE '' || o_orderkey END AS slug, '0' || o_orderkey || '_x_y' AS padded, CAST(o_orderkey AS BIGINT) AS number FROM orders")
def _(read):
    key = F.col("o_orderkey").cast("string")
    return read("orders").select("o_orderkey", text.lecture_slug(F.concat(key, F.lit("_intro"))).alias("slug"), text.lecture_slug(F.concat(F.lit("0"), key, F.lit("_x!!y_"))).alias("padded"), text.lecture_number(F.concat(key, F.lit("_a"))).alias("number"))


@query("DT1_year", r"SELECT event_id, CAST(regexp_extract(strftime(ts, 'at %d.%m, %Y'), '\b(\d{4})\b', 1) AS BIGINT) AS year FROM events")
def _(read):
    return read("events").select("event_id", text.year_in(F.date_format("ts", "'at' dd.MM, yyyy")).alias("year"))


@query("M7_json_lists", "SELECT c_custkey, c_name || '|' || c_mktsegment AS parsed, '[\"' || c_name || '\",\"' || c_mktsegment || '\"]' AS stored FROM customer")
def _(read):
    both = F.array("c_name", "c_mktsegment")
    printed = F.concat(F.lit("['"), F.array_join(both, "', '"), F.lit("']"))
    return read("customer").select("c_custkey", F.array_join(literal_list(printed), "|").alias("parsed"), F.to_json(both).alias("stored"))


@query("M12_backoff", "SELECT l_orderkey, l_linenumber, least(pow(2, l_linenumber), 30) AS delay FROM lineitem")
def _(read):
    return read("lineitem").select("l_orderkey", "l_linenumber", text.backoff(F.col("l_linenumber"), 1.0, 30.0).alias("delay"))


@query("M5_inverted_abstract", "SELECT p_partkey, p_name || '  ' || p_brand AS abstract FROM part")
def _(read):
    words = F.split("p_name", " ")
    spots = F.map_from_arrays(F.concat(F.transform(words, lambda w, i: F.concat(w, F.lit("~"), i.cast("string"))), F.array("p_brand")), F.concat(F.transform(words, lambda w, i: F.array(i)), F.array(F.array(F.size(words) + 1))))
    return read("part").select("p_partkey", F.regexp_replace(records.inverted_text(spots), r"~\d+( |$)", "$1").alias("abstract"))


@query("R13_tagged_reference", "SELECT s_suppkey, 'Ann ' || s_name AS authors, 'T ' || s_suppkey AS title, CAST(NULL AS VARCHAR) AS date, 'a b' AS abstract FROM supplier")
def _(read):
    note = F.concat(F.lit("%A "), F.col("s_name"), F.lit(", Ann\nx\n%T T "), F.col("s_suppkey").cast("string"), F.lit("\n%X <p>a <b>b</b></p>"))
    rows = read("supplier").select("s_suppkey", records.tagged_reference(note).alias("r"))
    return rows.select("s_suppkey", F.array_join("r.authors", "|").alias("authors"), "r.title", "r.date", "r.abstract")


@query("R14_html_parse")
def _(read):
    return records.parsed_pages(read("pages"))


# ---- chunks


def _windows(source: str, key: str, size: int, overlap: int, least: int) -> str:
    step = size - overlap
    return rf"""WITH t AS (SELECT {key} AS doc, regexp_extract_all({_CLEAN}, '{text.TOKEN}') AS t FROM {source}),
w AS (SELECT doc, t, unnest(CASE WHEN len(t) < {least} THEN [0] ELSE list_filter(range(0, len(t), {step}), lambda s: s = 0 OR len(t) - s >= {least}) END) AS s FROM t WHERE len(t) > 0),
c AS (SELECT doc, CAST(s // {step} AS BIGINT) AS chunk_index, length(array_to_string(t[1:s], '')) AS char_start, t[s + 1:s + {size}] AS part FROM w),
chunks AS (SELECT doc, chunk_index, doc || '_chunk_' || lpad(CAST(chunk_index AS VARCHAR), CAST(greatest(4, length(CAST(chunk_index AS VARCHAR))) AS INT), '0') AS chunk_id, CAST(char_start AS BIGINT) AS char_start,
  CAST(char_start + length(array_to_string(part, '')) AS BIGINT) AS char_end, CAST(len(part) AS BIGINT) AS n_tokens, array_to_string(part, '') AS text FROM c)
"""


@query("H1_fixed_chunks", _windows("documents", "doc_id", 500, 50, 50) + "SELECT * FROM chunks")
def _(read):
    return chunking.fixed_windows(read("documents"), FIXED)


@query(
    "H8_force_split",
    rf"""WITH t AS (SELECT doc_id AS doc, regexp_extract_all(text, '{text.TOKEN}') AS t FROM documents),
w AS (SELECT doc, t, unnest(range(0, len(t), 180)) AS s FROM t)
SELECT doc, CAST(s // 180 AS BIGINT) AS part, CAST(len(t[s + 1:s + 200]) AS BIGINT) AS n_tokens, array_to_string(t[s + 1:s + 200], '') AS text FROM w""",
)
def _(read):
    return chunking.force_split(read("documents"), 200, 20)


def _talks(read) -> DataFrame:
    """Conversations as paged, headed documents."""
    turn = F.concat(F.lit("--- Page "), (F.col("turn") + 1).cast("string"), F.lit(" ---\n# "), F.col("role"), F.lit("\n"), F.col("text"))
    rows = read("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))).alias("ts"))
    return rows.select("conv_id", F.array_join(F.transform("ts", lambda x: x["t"]), "\n").alias("text"))


_TALKS = "(SELECT conv_id, string_agg('--- Page ' || (turn + 1) || ' ---' || chr(10) || '# ' || role || chr(10) || text, chr(10) ORDER BY turn, '--- Page ' || (turn + 1) || ' ---' || chr(10) || '# ' || role || chr(10) || text) AS text FROM conversations GROUP BY conv_id)"


@query(
    "H3_sections",
    f"""WITH d AS (SELECT conv_id, {_CLEAN} AS text FROM {_TALKS}),
l AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM d),
f AS (SELECT *, regexp_matches({_STRIP.format("line")}, '^(#{{1,6}}[{_SP}]+|\\d+\\.[{_SP}]+|[A-Z][A-Z{_SP}]+:)') AND count(CASE WHEN length({_STRIP.format("line")}) > 0 THEN 1 END) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS head,
  coalesce(sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM l),
s AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS nth FROM f),
g AS (SELECT conv_id AS doc, CAST(nth AS BIGINT) AS nth, max(CASE WHEN head THEN {_STRIP.format("line")} END) AS title, CAST(min(pos) AS BIGINT) AS char_start, {_STRIP.format("string_agg(line, chr(10) ORDER BY i)")} AS text FROM s GROUP BY conv_id, nth)
SELECT * FROM g WHERE length(text) >= 50""",
)
def _(read):
    return chunking.sections(_talks(read).withColumn("text", text.clean_text(F.col("text"))), 50, "conv_id")


_J8 = (
    _windows(_TALKS, "conv_id", 50, 10, 10)
    + r""", l AS (SELECT conv_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM """
    + _TALKS
    + r"""),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM l),
m AS (SELECT conv_id, CAST(regexp_extract(line, '(\d+)', 1) AS INT) AS page, pos, coalesce(lead(pos) OVER (PARTITION BY conv_id ORDER BY i), length(text) + 1) AS until FROM o WHERE regexp_matches(line, '^--- Page \d+ ---\s*$'))
SELECT c.doc, c.chunk_index, c.char_start, c.char_end, coalesce(string_agg(DISTINCT CAST(page AS VARCHAR), ',' ORDER BY CAST(page AS VARCHAR)) , '') AS pages
FROM chunks c LEFT JOIN m ON m.conv_id = c.doc AND c.char_start < m.until AND c.char_end > m.pos GROUP BY ALL"""
)


@query("J8_interval_join", _J8)
def _(read):
    talks = _talks(read)
    chunks = chunking.fixed_windows(talks, chunking.Limits(50, 10, 10), "conv_id")
    pages = talks.select(F.col("conv_id").alias("doc"), F.inline(chunking.page_spans(F.col("text"))))
    out = chunking.chunk_pages(chunks, pages, ["doc"], ["chunk_index", "char_start", "char_end"])
    return out.withColumn("pages", F.array_join(F.array_sort(F.col("pages").cast("array<string>")), ","))


@query("J8_chunk_pages", _J8)
def _(read):
    talks = _talks(read)
    spans = talks.select(F.col("conv_id").alias("d"), chunking.page_spans(F.col("text")).alias("spans"))
    chunks = chunking.fixed_windows(talks, chunking.Limits(50, 10, 10), "conv_id").join(spans, F.col("doc") == F.col("d"))
    pages = chunking.pages_of(F.col("char_start"), F.col("char_end"), F.col("spans"))
    return chunks.select("doc", "chunk_index", "char_start", "char_end", F.array_join(F.array_sort(F.transform(pages, lambda p: p.cast("string"))), ",").alias("pages"))


def _listed(made: DataFrame) -> DataFrame:
    return made.withColumn("pages", F.array_join(F.transform("pages", lambda p: p.cast("string")), ","))


_FIXED_ROWS = _windows("documents", "doc_id", 100, 20, 20) + "SELECT CAST(doc AS VARCHAR) AS doc, chunk_index, chunk_id, 'fixed' AS strategy, CAST(NULL AS VARCHAR) AS title, char_start, char_end, n_tokens, text, '' AS pages FROM chunks"

_COUNT = f"len(regexp_extract_all({{}}, '{text.TOKEN.replace('{', '{{').replace('}', '}}')}'))"
_TAIL = f"array_to_string(regexp_extract_all({{0}}, '{text.TOKEN.replace('{', '{{').replace('}', '}}')}')[-20:], '')"
_FIXED_WINDOWS = _windows("documents", "doc_id", 100, 20, 20) + "SELECT * FROM chunks"
# sentence by sentence: what is held, where it begins, how many chunks are out, and what this step puts out
_SENTENCE_ROWS = rf"""WITH RECURSIVE cut AS (
  SELECT doc_id AS doc, list_filter(string_split(regexp_replace(t, '([.!?;]+[{_SP}]+)', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 0) AS s FROM (SELECT doc_id, {_CLEAN} AS t FROM documents)
), step AS (
  SELECT doc, s, CAST(0 AS BIGINT) AS i, '' AS held, CAST(0 AS BIGINT) AS ht, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS n_out, CAST(NULL AS VARCHAR) AS chunk, CAST(0 AS BIGINT) AS chunk_start FROM cut WHERE len(s) > 0
  UNION ALL
  SELECT doc, s, i + 1, CASE WHEN NOT full_ THEN held || one WHEN more > 0 THEN {_TAIL.format("whole")} || ' ' || one ELSE one END,
    CASE WHEN NOT full_ THEN ht + n WHEN more > 0 THEN {_COUNT.format("(" + _TAIL.format("whole") + " || ' ' || one)")} ELSE n END,
    CASE WHEN NOT full_ THEN start WHEN more > 0 THEN start + length(whole) - length({_TAIL.format("whole")}) ELSE place END,
    place + length(one), CASE WHEN full_ THEN more ELSE n_out END, CASE WHEN full_ AND kept THEN whole END, start
  FROM (SELECT *, n_out + CASE WHEN kept THEN 1 ELSE 0 END AS more FROM (SELECT *, {_COUNT.format("whole")} >= 20 AS kept FROM (
    SELECT *, held <> '' AND ht + n > 100 AS full_, {_STRIP.format("held")} AS whole FROM (SELECT *, coalesce(s[i + 1], '') AS one, {_COUNT.format("coalesce(s[i + 1], '')")} AS n FROM step WHERE i < len(s)))))
), out AS (
  SELECT doc, i, chunk, chunk_start FROM step WHERE chunk IS NOT NULL
  UNION ALL SELECT doc, i + 1, {_STRIP.format("held")}, start FROM step WHERE i = len(s) AND {_COUNT.format("held")} >= 20
), toks AS (SELECT doc, i, chunk_start, regexp_extract_all(chunk, '{text.TOKEN}') AS t FROM out
), parts AS (
  SELECT doc, i, k, 'sentence' AS strategy, chunk_start, array_to_string(t[k + 1:k + 200], '') AS part FROM (SELECT *, unnest(CASE WHEN len(t) <= 200 THEN [0] ELSE range(0, len(t), 180) END) AS k FROM toks)
  UNION ALL SELECT doc, chunk_index, 0, 'fixed', char_start, text FROM ({_FIXED_WINDOWS}) WHERE doc NOT IN (SELECT doc FROM out)
), numbered AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY i, k) - 1 AS chunk_index FROM parts)
SELECT CAST(doc AS VARCHAR) AS doc, CAST(chunk_index AS BIGINT) AS chunk_index, doc || '_chunk_' || lpad(CAST(chunk_index AS VARCHAR), CAST(greatest(4, length(CAST(chunk_index AS VARCHAR))) AS INT), '0') AS chunk_id, strategy, CAST(NULL AS VARCHAR) AS title,
  chunk_start AS char_start, CAST(chunk_start + length(part) AS BIGINT) AS char_end, CAST({_COUNT.format("part")} AS BIGINT) AS n_tokens, part AS text, '' AS pages FROM numbered"""

for _strategy in chunking.STRATEGIES:

    @query(f"H10_chunks_{_strategy}", {"fixed": _FIXED_ROWS, "sentence": _SENTENCE_ROWS}.get(_strategy))
    def _(read, strategy=_strategy):
        return _listed(chunking.chunks(read("documents"), strategy, SMALL))


@query("H5_hybrid_structured")
def _(read):
    return _listed(chunking.chunks(_talks(read), "hybrid", SMALL, "conv_id"))


@query("H14_statuses", _windows("documents", "doc_id", 100, 20, 20) + f"SELECT CAST(d.doc_id AS VARCHAR) AS doc, CASE WHEN n IS NULL THEN 'FAILED' ELSE 'SUCCESS' END AS status, CAST(coalesce(n, 0) AS BIGINT) AS n_chunks, CASE WHEN n IS NULL THEN 'Empty text file' END AS error FROM documents d LEFT JOIN (SELECT doc, count(*) AS n FROM chunks GROUP BY doc) ON doc = d.doc_id")
def _(read):
    return chunking.statuses(chunking.attempts(read("documents"), "fixed", SMALL))


@query("W1_targets", "SELECT source, doc_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1 THEN source ELSE source || '__' || doc_id END AS document_id FROM documents")
def _(read):
    return tracking.targets(read("documents"), "source", "doc_id")


# ---- catalogues and tracking


def _snapshots(read) -> tuple[DataFrame, DataFrame]:
    """Two states of a catalogue: customers in debt are new, one segment is gone, one is renamed."""
    c = read("customer")
    hash_ = lambda name: F.md5(name.cast("binary")).alias("content_hash")
    renamed = F.when(F.col("c_mktsegment") == "BUILDING", F.concat("c_name", F.lit("*"))).otherwise(F.col("c_name"))
    return c.where("c_acctbal >= 0").select("c_custkey", hash_(F.col("c_name"))), c.where("c_mktsegment <> 'MACHINERY'").select("c_custkey", hash_(renamed))


_SNAPSHOTS = "existing AS (SELECT c_custkey, md5(c_name) AS h FROM customer WHERE c_acctbal >= 0), incoming AS (SELECT c_custkey, md5(CASE WHEN c_mktsegment = 'BUILDING' THEN c_name || '*' ELSE c_name END) AS h FROM customer WHERE c_mktsegment <> 'MACHINERY')"


@query(
    "R2_refresh",
    f"WITH {_SNAPSHOTS} SELECT coalesce(e.c_custkey, i.c_custkey) AS c_custkey, CASE WHEN e.c_custkey IS NULL THEN 'new' WHEN i.c_custkey IS NULL THEN 'retained' WHEN e.h = i.h THEN 'unchanged' ELSE 'updated' END AS outcome, coalesce(i.h, e.h) AS content_hash FROM existing e FULL JOIN incoming i ON e.c_custkey = i.c_custkey",
)
def _(read):
    return tracking.refresh(*_snapshots(read), "c_custkey", "content_hash")


def _tracked(read) -> tuple[DataFrame, DataFrame]:
    """Publications and tracking rows: statuses after the balance, files after nation and segment."""
    old, new = _snapshots(read)
    c = read("customer").select(F.col("c_custkey").alias("k"), "c_acctbal", "c_nationkey", "c_mktsegment")
    level = lambda least, done: F.when(F.col("c_acctbal") >= least, done).otherwise("Pending")
    files = F.array(F.col("c_nationkey").cast("string"))
    tracked = old.join(c, F.col("c_custkey") == F.col("k")).select("c_custkey", "content_hash", files.alias("file_urls"), *[level(1000 * (i + 1), done).alias(f"{s}_status") for i, (s, done) in enumerate(tracking.STAGES.items())])
    more = F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.array(F.col("c_nationkey").cast("string"), F.lit("extra"))).otherwise(files)
    publications = new.join(c, F.col("c_custkey") == F.col("k")).select("c_custkey", "content_hash", more.alias("file_urls"))
    return publications, tracked


_PLAN = (
    "WITH "
    + _SNAPSHOTS
    + """, t AS (SELECT e.c_custkey, e.h, c_acctbal >= 1000 AS d, c_acctbal >= 2000 AS p, c_acctbal >= 3000 AS e, c_acctbal >= 4000 AS i FROM existing e JOIN customer c USING (c_custkey)),
j AS (SELECT n.c_custkey, c.c_nationkey, c.c_mktsegment, CASE WHEN t.c_custkey IS NULL THEN 'New publication' WHEN t.h <> n.h THEN 'Content hash changed' WHEN c.c_mktsegment = 'AUTOMOBILE' THEN 'Files changed' ELSE 'Status check' END AS reason, t.d, t.p, t.e, t.i
  FROM incoming n JOIN customer c USING (c_custkey) LEFT JOIN t ON t.c_custkey = n.c_custkey),
plan AS (SELECT c_custkey, reason <> 'Status check' OR NOT d AS needs_download, reason <> 'Status check' OR NOT (d AND p) AS needs_processing, reason <> 'Status check' OR NOT (d AND p AND e) AS needs_embedding, reason <> 'Status check' OR NOT (d AND p AND e AND i) AS needs_ingestion,
  CASE WHEN reason = 'Content hash changed' THEN CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN c_nationkey || '|extra' ELSE '' || c_nationkey END WHEN reason = 'Files changed' THEN 'extra' ELSE '' END AS files, reason FROM j)
"""
)


@query("R6_processing_plan", _PLAN + "SELECT * FROM plan")
def _(read):
    plan = tracking.processing_plan(*_tracked(read), "c_custkey")
    return plan.withColumn("files", F.array_join("files_to_reprocess", "|")).drop("files_to_reprocess")


@query(
    "R4_upsert",
    _PLAN
    + """SELECT coalesce(t.c_custkey, p.c_custkey) AS c_custkey, CASE WHEN p.c_custkey IS NULL THEN t.h ELSE n.h END AS content_hash,
CASE WHEN needs_download OR NOT coalesce(t.d, FALSE) THEN 'Pending' ELSE 'Downloaded' END AS download_status, CASE WHEN needs_processing OR NOT coalesce(t.p, FALSE) THEN 'Pending' ELSE 'Processed' END AS processing_status,
CASE WHEN needs_embedding OR NOT coalesce(t.e, FALSE) THEN 'Pending' ELSE 'Embedded' END AS embedding_status, CASE WHEN needs_ingestion OR NOT coalesce(t.i, FALSE) THEN 'Pending' ELSE 'Ingested' END AS ingestion_status
FROM t FULL JOIN plan p ON t.c_custkey = p.c_custkey LEFT JOIN incoming n ON n.c_custkey = p.c_custkey""",
)
def _(read):
    return tracking.upsert(*_tracked(read), "c_custkey").drop("file_urls")


for _stage, _where in {"download": "NOT d", "processing": "d AND NOT p", "embedding": "p AND NOT e", "ingestion": "e AND NOT i"}.items():

    @query(f"P1_work_list_{_stage}", f"{_PLAN} SELECT c_custkey FROM t WHERE {_where}")
    def _(read, stage=_stage):
        return tracking.work_list(_tracked(read)[1], stage, "c_custkey")


_STATUS = "CASE WHEN value >= 50 THEN 'Done' ELSE 'Failed' END"


@query("R7_status_fold", f"SELECT user_id, event_type, arg_max({_STATUS}, (ts, event_id)) AS status, count(*) AS attempts, max(ts) AS updated, nullif(arg_max(CASE WHEN value >= 50 THEN '' ELSE 'e' || event_id END, (ts, event_id)), '') AS error FROM events GROUP BY user_id, event_type")
def _(read):
    done = F.col("value") >= 50
    rows = read("events").withColumn("status", F.when(done, "Done").otherwise("Failed")).withColumn("error", F.when(done, "").otherwise(F.concat(F.lit("e"), F.col("event_id").cast("string"))))
    out = tracking.folded(rows, ["user_id", "event_type"], "status", ["ts", "event_id"], "error")
    return out.withColumn("error", F.nullif("error", F.lit("")))


@query("R9_embedding_work", "SELECT DISTINCT l_orderkey AS id, CASE WHEN o_orderkey IS NOT NULL THEN 'tracked' ELSE 'disk' END AS origin FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O') ON l_orderkey = o_orderkey")
def _(read):
    return tracking.embedding_work(read("orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("id")), read("lineitem").select(F.col("l_orderkey").alias("id")), "id")


@query("J5_missing", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(read):
    return tracking.missing(read("orders").select(F.col("o_orderkey").alias("id")), read("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")), "id")


@query("A9_first_wins", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def _(read):
    return tracking.first_wins(read("events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


# ---- downloads and metrics


@query("P12_download_plan", f"SELECT page_id, url, 'raw/documents/' || page_id || '/' || CASE WHEN contains(seg, '.') THEN seg ELSE substr(md5(url), 1, 8) || '.bin' END AS path FROM (SELECT *, {_SEGMENT} AS seg FROM pages)")
def _(read):
    return downloads.planned(read("pages").select("page_id", F.array("url").alias("urls")), "page_id", "urls")


@query("P11_corrected_name", f"SELECT page_id, CASE WHEN regexp_matches(seg, '\\.[^./]*$') THEN regexp_replace(seg, '\\.[^./]*$', '') ELSE seg END || '.pdf' AS name FROM (SELECT page_id, {_SEGMENT} AS seg FROM pages)")
def _(read):
    return read("pages").select("page_id", downloads.corrected_name(text.last_segment(F.col("url")), F.lit("Application/PDF; charset=x")).alias("name"))


@query("P10_validity", "SELECT page_id, CASE WHEN strlen(html) < 1024 THEN 'too small' WHEN strlen(html) > 104857600 THEN 'too large' ELSE 'HTML page' END AS verdict FROM pages")
def _(read):
    return read("pages").select("page_id", downloads.validity(F.octet_length("html"), text.last_segment(F.col("url")), F.col("html").cast("binary"), F.lit("text/plain")).alias("verdict"))


@query("A1_download_rollup", "SELECT l_orderkey, CASE WHEN bool_and(l_returnflag <> 'R') THEN 'Downloaded' ELSE 'Failed' END AS status, string_agg('line ' || l_linenumber, '; ' ORDER BY l_linenumber) FILTER (WHERE l_returnflag = 'R') AS error FROM lineitem GROUP BY l_orderkey")
def _(read):
    rows = read("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") != "R").alias("ok"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("e"))
    return downloads.rolled_up(rows, "l_orderkey", "ok", "e", "l_linenumber")


@query("A2_download_totals", "SELECT *, round(bytes / 1024 / 1024, 4) AS megabytes, round(100.0 * successful / greatest(attempted, 1), 4) AS success_rate FROM (SELECT count(*) AS attempted, count(*) FILTER (WHERE l_returnflag <> 'R') AS successful, count(*) FILTER (WHERE l_returnflag = 'R') AS failed, round(CAST(sum(l_quantity) FILTER (WHERE l_returnflag <> 'R') AS DOUBLE), 2) AS bytes FROM lineitem)")
def _(read):
    return downloads.totals(read("lineitem").withColumn("ok", F.col("l_returnflag") != "R"), "ok", "l_quantity")


@query("A3_extension_histogram", f"SELECT extension, count(*) AS n FROM (SELECT {_EXT}) GROUP BY extension")
def _(read):
    return downloads.extension_histogram(read("pages"), "url")


@query("A3_url_totals", "SELECT count(url) AS total, count(DISTINCT url) AS distinct_urls, count(url) - count(DISTINCT url) AS duplicates FROM pages")
def _(read):
    return downloads.url_totals(read("pages"), "url")


@query(
    "A4_stage_summary",
    """SELECT total, succeeded, skipped, failed, round(items, 4) AS items, round(seconds, 4) AS seconds, round(items / greatest(succeeded, 1), 4) AS items_each, CASE WHEN failed > 0 AND succeeded = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM (
SELECT count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'A') AS succeeded, count(*) FILTER (WHERE l_returnflag = 'N') AS skipped, count(*) FILTER (WHERE l_returnflag = 'R') AS failed, CAST(coalesce(sum(l_linenumber) FILTER (WHERE l_returnflag = 'A'), 0) AS DOUBLE) AS items, CAST(sum(l_quantity) AS DOUBLE) AS seconds FROM lineitem)""",
)
def _(read):
    return metrics.stage_summary(read("lineitem"), "l_returnflag", "l_linenumber", "l_quantity", "A", "N")


@query(
    "A6_benchmark",
    """WITH g AS (SELECT l_returnflag, list_sort(list(l_quantity) FILTER (WHERE l_linestatus = 'F')) AS q, count(*) AS n, avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0 END) AS s, avg(l_quantity) FILTER (WHERE l_linestatus = 'F') AS m FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, n, round(s, 3) AS success_rate, round(m, 3) AS mean, round(list_median(q), 3) AS median, round(q[CAST(least(floor(len(q) * 95 / 100), len(q) - 1) AS BIGINT) + 1], 3) AS p95, round(list_max(q), 3) AS most FROM g""".replace("list_median(q)", "list_aggregate(q, 'median')"),
)
def _(read):
    return metrics.benchmark(read("lineitem").withColumn("ok", F.col("l_linestatus") == "F"), "l_returnflag", "l_quantity", "ok")


@query("R19_log_flags", "SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(lower(event_type), 'error|exception|traceback')) AS errors, count(*) FILTER (WHERE contains(lower(event_type), 'warning')) AS warnings, bool_or(regexp_matches(lower(event_type), 'completed|finished')) AS done FROM events")
def _(read):
    return metrics.log_flags(read("events"), "event_type")


# ---- search


@query("M1_truncated_vectors", "SELECT vec_id, round(n, 6) AS norm, round(h[1] / n, 6) AS first, round(h[32] / n, 6) AS last, CAST(len(h) AS BIGINT) AS dims FROM (SELECT vec_id, h, sqrt(list_sum(list_transform(h, lambda x: x * x))) AS n FROM (SELECT vec_id, list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)) AS h FROM embeddings))")
def _(read):
    rows = read("embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("h"), vectors.truncated(F.col("embedding"), 32).alias("v"))
    return rows.select("vec_id", F.round(vectors.norm(F.col("h")), 6).alias("norm"), F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(31)), 6).alias("last"), F.size("v").alias("dims"))


_DENSE = f"SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % {EVERY} = 0"


def _ranked(scored: str, k: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM ({scored})) WHERE rank <= {k}"


def _queries(read) -> DataFrame:
    return read("embeddings").where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


@query("Q3_dense_top_k", _ranked(_DENSE, 10))
def _(read):
    return retrieval.dense_top_k(read("embeddings"), _queries(read), 10)


def _store(df: DataFrame) -> Store:
    return Store(df.sparkSession, work_folder(df.sparkSession))


@query("Q3_indexed_top_k", _ranked(_DENSE, 10))
def _(read):
    index = dense.VectorIndex(_store(read("embeddings")))
    index.build(read("embeddings"))
    return index.search(_queries(read), 10, exact=True)


@query("P5_filtered_top_k", _ranked(_DENSE + " AND e.label = 3", 10))
def _(read):
    return retrieval.dense_top_k(retrieval.payload_filter(read("embeddings"), {"label": 3, "year": None}), _queries(read), 10)


@query("P6_filtered_search", _ranked(_DENSE, 10))
def _(read):
    return retrieval.dense_top_k(retrieval.payload_filter(read("embeddings"), {"label": 0, "year": ""}, drop_falsy=True), _queries(read), 10)


_MERGED = f"SELECT query // 60 AS question, id, query, score, row_number() OVER (PARTITION BY query // 60, id ORDER BY score DESC, query) AS nth FROM ({_ranked(_DENSE, 30)})"


@query("A8_merged_queries", f"SELECT question, id, m.score, m.query, e.label AS payload, row_number() OVER (PARTITION BY question ORDER BY m.score DESC, id) AS rank FROM ({_MERGED}) m JOIN embeddings e ON e.vec_id = m.id WHERE nth = 1 QUALIFY row_number() OVER (PARTITION BY question ORDER BY m.score DESC, id) <= 10")
def _(read):
    hits = retrieval.dense_top_k(read("embeddings"), _queries(read), 30).join(read("embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("payload")), "id")
    return retrieval.merged_queries(hits.withColumn("question", F.floor(F.col("query") / 60)), 10, ("question",))


@query("P9_projection", f"SELECT h.query, h.id, h.score, h.rank, {_UUID} AS chunk_id, text_content, token_count FROM (SELECT h.*, coalesce(d.text, '') AS text_content, CAST(coalesce(d.n_chars, 0) AS BIGINT) AS token_count, sha1(unhex('a1b2c3d4e5f67890abcdef1234567890') || encode('' || h.id)) AS h FROM ({_ranked(_DENSE, 3)}) h LEFT JOIN documents d ON d.doc_id = h.id) h")
def _(read):
    hits = retrieval.dense_top_k(read("embeddings"), _queries(read), 3)
    payload = read("documents").select("doc_id", F.col("text").alias("text_content"), F.col("n_chars").cast("long").alias("token_count"))
    return retrieval.projected(hits, payload, "doc_id", {"text_content": "", "token_count": F.lit(0).cast("long")})


_TERMS = """terms AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents),
tf AS (SELECT id, len(t) AS n, unnest(t) AS term FROM terms), counts AS (SELECT id, n, term, count(*) AS tf FROM tf GROUP BY id, n, term),
weights AS (SELECT id, term, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 256.0)) AS weight FROM counts),
idf AS (SELECT term, count(*) AS df, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM counts GROUP BY term)"""
_SPARSE = "SELECT query, id, round(sum(weight * idf), 6) AS score FROM (SELECT DISTINCT item_id AS query, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark {}) JOIN weights USING (term) JOIN idf USING (term) GROUP BY query, id"


@query("M3_document_vectors", f"WITH {_TERMS} SELECT id, term, round(weight, 6) AS weight FROM weights")
def _(read):
    return retrieval.document_vectors(read("documents")).select("id", "term", F.round("weight", 6).alias("weight"))


@query("A17_inverse_frequency", f"WITH {_TERMS} SELECT term, df, round(idf, 6) AS idf FROM idf")
def _(read):
    return retrieval.inverse_frequency(retrieval.document_vectors(read("documents")), read("documents")).select("term", "df", F.round("idf", 6).alias("idf"))


@query("J11_sparse_top_k", f"WITH {_TERMS} {_ranked(_SPARSE.format(''), 10)}")
def _(read):
    return retrieval.sparse_top_k(read("documents"), read("benchmark").select(F.col("item_id").alias("query"), "text"), 10)


@query("J11_indexed_top_k", f"WITH {_TERMS} {_ranked(_SPARSE.format(''), 10)}")
def _(read):
    index = postings.Index(_store(read("documents")))
    index.build(read("documents"))
    return index.search(read("benchmark").select(F.col("item_id").alias("query"), "text"), 10)


def _asked(read) -> DataFrame:
    """query, text, vector: each stated vector with the benchmark text of its number, and texts without a vector."""
    texts = read("benchmark").select((F.col("item_id") * EVERY).alias("q"), "text")
    both = _queries(read).join(texts, F.col("query") == F.col("q"), "full")
    return both.select(F.coalesce("query", "q").alias("query"), "text", "vector")


def _hybrid_sql(dense: str, sparse: str) -> str:
    hits = f"SELECT query, id, rank FROM ({_ranked(dense, 30)}) UNION ALL SELECT query, id, rank FROM ({_ranked(sparse, 30)})"
    return _ranked(f"SELECT query, id, round(sum(1.0 / (60 + rank)), 6) AS score FROM ({hits}) GROUP BY query, id", 10)


_SPARSE_20 = f"SELECT query * {EVERY} AS query, id, score FROM ({_SPARSE.format('')})"


@query("T2_hybrid_rrf", f"WITH {_TERMS} " + _hybrid_sql(_DENSE, _SPARSE_20))
def _(read):
    return retrieval.hybrid_top_k(read("documents"), read("embeddings"), _asked(read), 10)


_LABELLED = "SELECT d.doc_id, d.text, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id"


@query(
    "T2_hybrid_filtered",
    f"WITH {_TERMS.replace('FROM documents)', 'FROM docs)').replace('count(*) FROM documents', 'count(*) FROM docs').replace('terms AS', f'docs AS (SELECT doc_id, text FROM ({_LABELLED}) WHERE quality = 1), terms AS', 1)} "
    + _hybrid_sql(_DENSE + f" AND e.vec_id IN (SELECT doc_id FROM ({_LABELLED}) WHERE quality = 1)", _SPARSE_20),
)
def _(read):
    quality = read("labels").select("doc_id", "quality").where("doc_id is not null")
    docs = read("documents").join(quality, "doc_id")
    vectors = read("embeddings").join(quality.withColumnRenamed("doc_id", "vec_id"), "vec_id")
    return retrieval.hybrid_top_k(docs, vectors, _asked(read), 10, filters={"quality": 1, "year": None})


@query("J9_citations", f"WITH top AS ({_ranked(_DENSE, 10)}), numbers AS (SELECT q.query, CAST(i AS BIGINT) AS source_number FROM (SELECT DISTINCT query FROM top) q, range(1, 13) t(i)) SELECT n.query, source_number, '' || top.id AS id FROM numbers n LEFT JOIN top ON top.rank = source_number AND top.query = n.query")
def _(read):
    hits = retrieval.dense_top_k(read("embeddings"), _queries(read), 10)
    numbers = _queries(read).select("query", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long"))).alias("source_number"), F.lit("").alias("id"))
    return retrieval.with_citations(numbers, hits, ["id"], ("query",))


@query(
    "Q12_points",
    f"SELECT {_UUID} AS point_id, vec_id, document_id, text_content, chunk_index, token_count, document_title, document_year, dims FROM (SELECT e.vec_id, d.doc_id AS document_id, coalesce(d.text, '') AS text_content, coalesce(CAST(d.n_chars AS BIGINT), 0) AS chunk_index, coalesce(length(d.text), 0) AS token_count, d.source AS document_title, CAST(l.quality AS BIGINT) AS document_year, CAST(len(e.embedding) AS BIGINT) AS dims, sha1(unhex('a1b2c3d4e5f67890abcdef1234567890') || encode('' || e.vec_id)) AS h FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)".replace("d.source AS document_title, CAST(l.quality AS BIGINT) AS document_year", "CASE WHEN l.doc_id IS NOT NULL THEN 'labelled' END AS document_title, CAST(l.quality AS BIGINT) AS document_year"),
)
def _(read):
    chunks = read("documents").select(F.col("doc_id").alias("vec_id"), "doc_id", "text", F.col("n_chars").alias("chunk_index"), F.length("text").alias("token_count"))
    publications = read("labels").select("doc_id", F.lit("labelled").alias("title"), F.col("quality").alias("year"))
    out = ingest.points(read("embeddings").select("vec_id", F.col("embedding").alias("dense")), chunks, publications, "vec_id", "doc_id")
    return out.withColumn("dims", F.size("dense")).drop("dense", "sparse", "page_numbers", "document_authors")


@query("Q12_sparse_points", f"WITH {_TERMS} SELECT e.vec_id, CAST(count(w.term) AS BIGINT) AS n_terms, round(coalesce(sum(w.weight), 0), 4) AS weight, CASE WHEN count(l.doc_id) > 0 THEN 'src' ELSE '' END AS authors FROM embeddings e LEFT JOIN weights w ON w.id = e.vec_id LEFT JOIN labels l ON l.doc_id = e.vec_id GROUP BY e.vec_id")
def _(read):
    chunks = read("documents").select(F.col("doc_id").alias("vec_id"), "doc_id", "text", F.lit(0).alias("chunk_index"), F.lit(1).alias("token_count"))
    publications = read("labels").select("doc_id", F.lit("t").alias("title"), F.col("quality").alias("year"), F.array(F.lit("src")).alias("authors"))
    sparse = retrieval.sparse_vectors(read("documents"))
    out = ingest.points(read("embeddings").select("vec_id", F.col("embedding").alias("dense")), chunks, publications, "vec_id", "doc_id", sparse)
    return out.select("vec_id", F.size("sparse").alias("n_terms"), F.round(F.aggregate("sparse", F.lit(0.0), lambda a, x: a + x["weight"]), 4).alias("weight"), F.array_join("document_authors", ",").alias("authors"))


@query("W7_batches", "SELECT label, vec_id, CAST((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 32 AS BIGINT) AS batch FROM embeddings")
def _(read):
    return ingest.batches(read("embeddings").select("label", "vec_id"), "label", "vec_id", 32)


@query("W7_batches_of_a_hot_label", "SELECT l_linestatus AS label, l_orderkey * 8 + l_linenumber AS nth, CAST((row_number() OVER (PARTITION BY l_linestatus ORDER BY l_orderkey * 8 + l_linenumber) - 1) // 50 AS BIGINT) AS batch FROM lineitem")
def _(read):
    rows = read("lineitem").select(F.col("l_linestatus").alias("label"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("nth"))
    return ingest.batches(rows, "label", "nth", 50)


_UPSERTED = "SELECT c_custkey, c_name AS name FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, c_name || '+3' FROM customer WHERE c_acctbal >= 0"


@query("K6_upserted", _UPSERTED)
def _(read):
    rows = read("customer")
    new = rows.where("c_acctbal >= 0").select("c_custkey", F.explode(F.array(*[F.lit(k) for k in (2, 3, 1)])).alias("written"), "c_name")
    new = new.select("c_custkey", "written", F.concat("c_name", F.lit("+"), F.col("written").cast("string")).alias("name"))
    return ingest.upserted(rows.select("c_custkey", F.col("c_name").alias("name")), new, "c_custkey", ["written"]).drop("written")


_UPDATED = "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE c_name END AS name FROM customer WHERE c_mktsegment <> 'MACHINERY'"


@query("K11_updated_deleted", _UPDATED)
def _(read):
    rows = read("customer")
    kept = ingest.deleted(rows.select("c_custkey", F.col("c_name").alias("name")), rows.where("c_mktsegment = 'MACHINERY'"), "c_custkey")
    return ingest.updated(kept, rows.where("c_acctbal < 0").select("c_custkey", F.lit("debt").alias("name")), "c_custkey")


@query("K6_stored_upsert", _UPSERTED)
def _(read):
    rows = read("customer")
    new = rows.where("c_acctbal >= 0").select("c_custkey", F.explode(F.array(*[F.lit(k) for k in (2, 3, 1)])).alias("written"), "c_name")
    store = _store(rows)
    with store.begin() as t:
        t.replace("customers", rows.select("c_custkey", F.col("c_name").alias("name")), "c_custkey")
    with store.begin() as t:
        t.upsert("customers", new.select("c_custkey", "written", F.concat("c_name", F.lit("+"), F.col("written").cast("string")).alias("name")), "c_custkey", ["written"])
    return store.read("customers")


@query("K11_stored_update_delete", _UPDATED)
def _(read):
    rows = read("customer")
    store = _store(rows)
    with store.begin() as t:
        t.replace("customers", rows.select("c_custkey", F.col("c_name").alias("name")), "c_custkey")
    with store.begin() as t:  # both changes are one state
        t.delete("customers", rows.where("c_mktsegment = 'MACHINERY'").select("c_custkey"), "c_custkey")
        t.update("customers", rows.where("c_acctbal < 0").select("c_custkey", F.lit("debt").alias("name")), "c_custkey")
    return store.read("customers")


# ---- records, reports, paths


_R2 = f"WITH {_SNAPSHOTS} SELECT coalesce(e.c_custkey, i.c_custkey) AS c_custkey, CASE WHEN i.c_custkey IS NULL OR e.h = i.h THEN 'old' ELSE 'new' END AS taken, coalesce(i.h, e.h) AS content_hash, CASE WHEN e.c_custkey IS NULL THEN 'new' WHEN i.c_custkey IS NULL THEN 'retained' WHEN e.h = i.h THEN 'unchanged' ELSE 'updated' END AS outcome FROM existing e FULL JOIN incoming i ON e.c_custkey = i.c_custkey"


@query("R2_merged", _R2)
def _(read):
    old, new = _snapshots(read)
    return tracking.merged(old.withColumn("taken", F.lit("old")), new.withColumn("taken", F.lit("new")), "c_custkey", "content_hash")


_R4 = _PLAN + "SELECT coalesce(t.c_custkey, p.c_custkey) AS c_custkey, CASE WHEN p.c_custkey IS NULL THEN 'stored' ELSE 'fresh' END AS title, CASE WHEN t.c_custkey IS NULL THEN NULL ELSE 'then' END AS discovered, CAST(CASE WHEN t.c_custkey IS NULL THEN 0 ELSE 4 END AS BIGINT) AS download_attempts FROM t FULL JOIN plan p ON t.c_custkey = p.c_custkey"


@query("R4_registered", _R4)
def _(read):
    publications, tracked = _tracked(read)
    good, _ = tracking.validated(publications.withColumn("title", F.lit("fresh")).unionByName(publications.withColumn("title", F.lit(" "))), "c_custkey", "title")
    stored = tracked.withColumn("title", F.lit("stored")).withColumn("discovered", F.lit("then")).withColumn("download_attempts", F.lit(4))
    return tracking.registered(good, stored, "c_custkey", ["title"]).select("c_custkey", "title", "discovered", F.coalesce("download_attempts", F.lit(0)).alias("download_attempts"))


@query("R2_stored_merge", _R2)
def _(read):
    old, new = _snapshots(read)
    store = _store(old)
    with store.begin() as t:
        t.replace("catalogue", old.withColumn("taken", F.lit("old")).withColumn("outcome", F.lit("retained")), "c_custkey")
    with store.begin() as t:
        t.merge("catalogue", new.withColumn("taken", F.lit("new")), lambda stored, incoming: tracking.merged(stored.drop("outcome"), incoming, "c_custkey", "content_hash"))
    return store.read("catalogue")


@query("R4_stored_registration", _R4)
def _(read):
    publications, tracked = _tracked(read)
    store = _store(tracked)
    with store.begin() as t:
        t.replace("tracked", tracked.withColumn("title", F.lit("stored")).withColumn("discovered", F.lit("then")).withColumn("download_attempts", F.lit(4)), "c_custkey")
    with store.begin() as t:
        t.merge("tracked", publications.withColumn("title", F.lit("fresh")), lambda stored, new: tracking.registered(new, stored, "c_custkey", ["title"]))
    return store.read("tracked").select("c_custkey", "title", "discovered", F.coalesce("download_attempts", F.lit(0)).alias("download_attempts"))


@query("X3_discovered", "SELECT 'a' AS source, s_suppkey AS key, s_name AS title, CAST(NULL AS VARCHAR) AS url FROM supplier UNION ALL SELECT 'b', c_custkey, NULL, c_name FROM customer")
def _(read):
    a = read("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("title"))
    return tracking.discovered({"a": a, "b": read("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("url"))})


@query("X4_distinct_union", "SELECT l_orderkey AS id FROM lineitem UNION SELECT o_orderkey FROM orders")
def _(read):
    return read("lineitem").select(F.col("l_orderkey").alias("id")).unionAll(read("orders").select("o_orderkey")).distinct()


@query("P4_get_or_create", "SELECT s_suppkey AS key, 's' AS name FROM supplier UNION ALL SELECT c_custkey, 'c' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def _(read):
    return tracking.get_or_create(read("supplier").select(F.col("s_suppkey").alias("key"), F.lit("s").alias("name")), read("customer").select(F.col("c_custkey").alias("key"), F.lit("c").alias("name")), ["key"])


@query("P2_status", f"{_PLAN} SELECT c_custkey, CASE WHEN d THEN 'Downloaded' ELSE 'Pending' END AS download_status, CASE WHEN p THEN 'Processed' ELSE 'Pending' END AS processing_status, CASE WHEN e THEN 'Embedded' ELSE 'Pending' END AS embedding_status, CASE WHEN i THEN 'Ingested' ELSE 'Pending' END AS ingestion_status FROM t WHERE c_custkey IN (1, 2, 3, 5, 8)")
def _(read):
    return tracking.status_of(_tracked(read)[1], "c_custkey", [1, 2, 3, 5, 8, 5])


@query("R8_stage_log", f"SELECT user_id, arg_max({_STATUS}, (ts, event_id)) AS download_status, count(*) AS download_attempts, max(ts) AS download_updated FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY user_id")
def _(read):
    first = read("events").agg(F.min("event_type").alias("least"))
    rows = read("events").join(first, F.col("event_type") == F.col("least")).withColumn("stage", F.lit("download")).withColumn("error", F.lit(None).cast("string"))
    rows = rows.withColumn("status", F.when(F.col("value") >= 50, "Done").otherwise("Failed"))
    return tracking.stage_transitions(rows, "user_id", "download", ["ts", "event_id"]).drop("error_message")


@query("J6_work_report", "SELECT r.id, CASE WHEN o.id IS NOT NULL AND l.id IS NOT NULL THEN 'tracked' WHEN l.id IS NOT NULL THEN 'disk' WHEN o.id IS NOT NULL THEN 'without chunks' ELSE 'missing' END AS found FROM (SELECT c_custkey AS id FROM customer) r LEFT JOIN (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'O') o ON o.id = r.id LEFT JOIN (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R') l ON l.id = r.id")
def _(read):
    of = lambda table, key, where="true": read(table).where(where).select(F.col(key).alias("id"))
    return tracking.embedding_report(of("orders", "o_orderkey", "o_orderstatus <> 'O'"), of("lineitem", "l_orderkey", "l_returnflag = 'R'"), of("customer", "c_custkey"), "id")


@query("W2_artifact_ids", "SELECT 'x/' || source || CASE WHEN nth = 1 THEN '' ELSE '/' || doc_id END || '/chunks.json' AS path, CASE WHEN nth = 1 THEN source ELSE source || '__' || doc_id END AS document_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents)")
def _(read):
    made = tracking.targets(read("documents"), "source", "doc_id")
    rows = made.select(F.concat(F.lit("x/"), F.regexp_replace("document_id", "__", "/"), F.lit("/chunks.json")).alias("path"))
    return tracking.artifact_ids(rows, "path")


@query("W10_guarded", "SELECT source, doc_id, CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY source) THEN 'path already claimed: ' || source END AS error FROM documents")
def _(read):
    return tracking.guarded(read("documents").select("source", "doc_id"), "source", "doc_id").select("source", "doc_id", "error")


@query("A7_scrape_stats", "SELECT (SELECT count(*) FROM lineitem) AS found, count(*) AS kept, (SELECT count(*) FROM lineitem) - count(*) AS duplicates, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END) AS BIGINT) AS files, round(avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0 END), 4) AS with_abstract, round(avg(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1.0 END), 4) AS with_year, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 4) AS with_files FROM orders")
def _(read):
    files = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("a"), F.lit("b"))).otherwise(F.expr("cast(array() as array<string>)"))
    kept = read("orders").select(files.alias("files"), F.when(F.col("o_orderstatus") == "O", "x").otherwise("").alias("abstract"), F.when(F.col("o_orderkey") % 3 != 0, 2000).alias("year"))
    return metrics.scrape_stats(read("lineitem"), kept, "files")


@query("A14_cost", "SELECT round(sum(CASE WHEN l_returnflag = 'R' THEN 0.2 ELSE 0.5 END * l_quantity), 4) AS compute, round(sum(l_linenumber) * 0.02 / 30, 4) AS storage FROM lineitem")
def _(read):
    spark = read("lineitem").sparkSession
    rates = spark.createDataFrame([("A", 0.5), ("N", 0.5), ("N", 0.1)], "l_returnflag string, rate double")
    return metrics.cost(read("lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("h"), F.col("l_linenumber").cast("double").alias("g")), rates, "l_returnflag", "h", "g")


@query("A16_stage_counts", "SELECT 'even' AS stage, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'odd', count(*) FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT 'none', 0")
def _(read):
    paths = read("orders").select(F.concat(F.lit("out/"), F.when(F.col("o_orderkey") % 2 == 0, "even/").otherwise("odd/"), F.col("o_orderkey").cast("string")).alias("path"))
    return metrics.stage_counts(paths, "path", {"even": "/even/", "odd": "/odd/", "none": "/none/"})


@query("A13_distinct_pages", "SELECT l_orderkey, count(DISTINCT l_linenumber % 3) AS pages FROM lineitem GROUP BY l_orderkey")
def _(read):
    return metrics.distinct_pages(read("lineitem").withColumn("page", F.col("l_linenumber") % 3), "l_orderkey", "page")


@query("P19_coerced", "SELECT 'W' || o_orderkey AS paper_id, 'https://openalex.org/W' || o_orderkey AS source_id, CAST(1850 + o_orderkey % 300 AS BIGINT) AS year FROM orders WHERE 1850 + o_orderkey % 300 BETWEEN 1900 AND 2100")
def _(read):
    key = F.concat(F.lit("W"), F.col("o_orderkey").cast("string"))
    rows = read("orders").select(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("https://openalex.org/"), key)).otherwise(key).alias("paper_id"), F.lit("").alias("source_id"), (1850 + F.col("o_orderkey") % 300).alias("year"))
    return records.coerced(rows)[0]


@query("DT2_corrected_years", "SELECT s_suppkey, 'u' || s_suppkey AS pub_url, CAST(CASE s_suppkey WHEN 3 THEN 1999 WHEN 5 THEN 2001 ELSE 2010 END AS BIGINT) AS year FROM supplier")
def _(read):
    rows = read("supplier").select("s_suppkey", F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("pub_url"), F.lit(2010).alias("year"))
    return records.corrected_years(rows, {"u3": 1999, "u5": 2001})


@query("M10_open_access", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'pdf' || o_orderkey WHEN 1 THEN 'page' WHEN 2 THEN 'second' END AS url FROM orders")
def _(read):
    k = F.col("o_orderkey") % 4
    first = F.when(k == 0, F.concat(F.lit('{"is_oa": true, "best_oa_location": {"url_for_pdf": "pdf'), F.col("o_orderkey").cast("string"), F.lit('", "url": "page"}}'))).when(k == 1, F.lit('{"is_oa": true, "best_oa_location": {"url_for_pdf": null, "url": "page"}}')).otherwise(F.lit('{"is_oa": false, "best_oa_location": null}'))
    second = F.when(k == 2, F.lit('{"data": [{"downloadUrl": "second"}]}')).otherwise(F.lit('{"data": []}'))
    return read("orders").select("o_orderkey", records.open_access(first, second).alias("url"))


@query("F15_paths", "SELECT doc_id, 'processed/chunks/' || source || '/' || doc_id || '/chunks.json' AS chunks, 'processed/embeddings/' || source || '/' || doc_id || '/embeddings.parquet' AS embeddings, '' || doc_id AS folder, source AS publication FROM documents")
def _(read):
    text_path = F.concat_ws("/", F.lit("processed/documents"), "source", F.col("doc_id").cast("string"), F.lit("a.txt"))
    chunk_path = paths.moved(text_path, "chunks")
    return read("documents").select("doc_id", chunk_path.alias("chunks"), paths.moved(chunk_path, "embeddings").alias("embeddings"), paths.folder_name(text_path).alias("folder"), paths.publication_of(text_path).alias("publication"))


@query("S18_first_match", "SELECT doc_id, 'processed/chunks/' || CASE WHEN doc_id % 2 = 0 THEN source || '__' || doc_id ELSE source || '/' || doc_id END || '/chunks.json' AS path FROM documents WHERE doc_id % 5 <> 0")
def _(read):
    rows = read("documents").select("doc_id", F.concat("source", F.lit("__"), F.col("doc_id").cast("string")).alias("name"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("deep"))
    at = lambda c: F.concat(F.lit("processed/chunks/"), F.col(c), F.lit("/chunks.json"))
    listing = rows.where("doc_id % 5 <> 0").select(F.explode(F.when(F.col("doc_id") % 2 == 0, F.array(at("name"), at("deep"))).otherwise(F.array(at("deep")))).alias("path"))
    return paths.first_match(rows.withColumn("options", paths.candidates(F.col("name"))), listing, "doc_id", "options", "path")


@query("F18_content_length", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey AS BIGINT) END AS n FROM orders")
def _(read):
    k = F.col("o_orderkey")
    return read("orders").select("o_orderkey", paths.content_length(F.when(k % 3 == 0, F.concat(F.lit(" "), k.cast("string"))).when(k % 3 == 1, F.lit("-7")).otherwise(F.lit("12x"))).alias("n"))


@query("F17_kept_enough", "SELECT doc_id, length(text) = 0 OR length(regexp_replace(text, '[a-m]', '', 'g')) >= 0.5 * length(text) AS enough FROM documents WHERE text IS NOT NULL")
def _(read):
    return read("documents").where("text is not null").select("doc_id", transcripts.kept_enough(F.col("text"), F.regexp_replace("text", "[a-m]", "")).alias("enough"))


@query("DT4_uptime", "SELECT user_id, round((max(epoch(ts)) - min(epoch(ts))) / 3600, 4) AS hours FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events) GROUP BY user_id")
def _(read):
    return read("events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select("user_id", F.round(metrics.uptime_hours(F.col("a"), F.col("b")), 4).alias("hours"))


@query("P10_validity_marks", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'not a PDF' WHEN 2 THEN 'ok' WHEN 3 THEN 'not a Word file' ELSE 'too small' END AS verdict FROM pages")
def _(read):
    k = F.col("page_id") % 5
    name = F.when(k <= 1, "a.pdf").when(k <= 3, "a.docx").otherwise("a.bin")
    mark = F.when(k == 0, F.unhex(F.lit("255044462D31"))).when(k == 2, F.unhex(F.lit("504B030400"))).otherwise(F.unhex(F.lit("00FF00FF")))
    return read("pages").select("page_id", downloads.validity(F.when(k == 4, 10).otherwise(5000), name, mark, F.when(k <= 1, "application/pdf")).alias("verdict"))


@query("P15_direct_download", "SELECT page_id, page_id % 4 <> 3 AS direct FROM pages")
def _(read):
    k = F.col("page_id") % 4
    kind = F.when(k == 0, "application/pdf; charset=x").when(k == 1, "application/msword").otherwise("text/html")
    return read("pages").select("page_id", downloads.is_direct(kind, F.when(k == 2, 'attachment; filename="a.pdf"')).alias("direct"))


@query("P13_long_enough", "SELECT doc_id, CASE WHEN length(coalesce(text, '')) >= 200 THEN 'Processed' ELSE 'Failed' END AS status FROM documents")
def _(read):
    return read("documents").select("doc_id", downloads.extraction_status(F.col("text"), 200).alias("status"))


@query("A11_download_counts", "SELECT count(*) AS attempted, count(*) FILTER (WHERE l_returnflag = 'N') AS cached, count(*) FILTER (WHERE l_linestatus = 'F') AS open_access, round(100.0 * count(*) FILTER (WHERE l_linestatus = 'F') / count(*), 1) AS open_share FROM lineitem")
def _(read):
    return downloads.counters(read("lineitem"), F.col("l_returnflag") == "N", F.col("l_linestatus") == "F")


@query("R14_entries", "SELECT CAST(page_id AS BIGINT) AS id, CAST(0 AS BIGINT) AS nth, 'T ' || page_id AS title, 'https://x.org/p/' || page_id AS pub_url, 'Last, F.|Other, G.' AS authors, CAST(2000 + page_id % 20 AS BIGINT) AS year, 'abs ' || page_id AS abstract, 'https://x.org/f.pdf' AS files FROM pages")
def _(read):
    k, odd = F.col("page_id").cast("string"), F.col("page_id") % 2 == 1
    year = (2000 + F.col("page_id") % 20).cast("string")
    new = F.concat(F.lit('<ul><li class="wp-block-post"><div class="cp-publication x"><h2 class="publication-title"><a href="/p/'), k, F.lit('"> T '), k, F.lit('</a></h2><p class="publication-authors">Last, F., Other, G.<span class="publication-year">, '), year, F.lit('</span></p><div class="publication-excerpt"><div>abs '), k, F.lit('</div></div><div class="publication-links"><a href="#x">no</a><a class="abstract" href="/z">no</a><a href="/f.pdf">f</a></div></div></li></ul>'))
    old = F.concat(F.lit('<div class="biblio-entry"><br><span class="biblio-title"><a href="/p/'), k, F.lit('">T '), k, F.lit('</a></span> <span class="biblio-authors">Last, F. &amp; Other, G.</span>. '), year, F.lit('.<div class="biblio-abstract-display">abs '), k, F.lit('</div><span class="file"><a href="https://x.org/f.pdf">f</a></span></div>'))
    entries = records.parsed_entries(read("pages").select("page_id", F.when(odd, new).otherwise(old).alias("html")), "https://x.org/publications")
    return entries.withColumn("authors", F.array_join("authors", "|")).withColumn("files", F.array_join("file_urls", "|")).drop("file_urls")


@query("M8_structured_data", "SELECT page_id, CAST(CASE WHEN page_id % 3 = 2 THEN NULL ELSE 2000 + page_id % 20 END AS BIGINT) AS year, CASE page_id % 3 WHEN 0 THEN 'A|B' WHEN 1 THEN 'C' ELSE '' END AS authors FROM pages")
def _(read):
    k, year = F.col("page_id") % 3, (2000 + F.col("page_id") % 20).cast("string")
    graph = F.concat(F.lit('<script type="application/ld+json">{"@graph": [{"@type": "Page"}, {"@type": "ScholarlyArticle", "datePublished": "'), year, F.lit('-01-02", "author": [{"name": "A"}, "B", {"name": ""}]}]}</script>'))
    single = F.concat(F.lit("<script type='application/ld+json'>{\"@type\": \"ScholarlyArticle\", \"datePublished\": \"May "), year, F.lit('", "author": {"name": "C"}}</script>'))
    html = F.when(k == 0, graph).when(k == 1, single).otherwise(F.lit('<script type="application/ld+json">not json</script>'))
    rows = read("pages").select("page_id", records.structured_data(html).alias("d"))
    return rows.select("page_id", "d.year", F.array_join("d.authors", "|").alias("authors"))


# ---- over the pages' own html, and functions on the tables' own values


@query(
    "R14_entries_of_pages",
    r"""WITH links AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS urls, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS titles FROM pages)
SELECT page_id AS id, CAST(i AS BIGINT) AS nth, trim(replace(titles[i + 1], '&amp;', '&')) AS title, 'https://x.org' || replace(urls[i + 1], '&amp;', '&') AS pub_url FROM (SELECT *, unnest(range(0, len(urls))) AS i FROM links)""",
)
def _(read):
    entry = '<div class="cp-publication"><h2 class="publication-title"><a href="$1">$2</a></h2></div>'
    pages = read("pages").withColumn("html", F.regexp_replace("html", r'<li><a href="([^"]*)">([^<]*)</a></li>', entry))
    return records.parsed_entries(pages, "https://x.org/publications").select("id", "nth", "title", "pub_url")


@query("M8_of_pages", """SELECT page_id, CAST(1900 + length(html) % 100 AS BIGINT) AS year, regexp_extract(html, 'lang="([a-z]+)"', 1) AS authors FROM pages""")
def _(read):
    said = F.struct(F.lit("ScholarlyArticle").alias("@type"), F.concat(F.lit("in "), (1900 + F.length("html") % 100).cast("string")).alias("datePublished"), F.array(F.struct(F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("name"))).alias("author"))
    html = F.regexp_replace("html", "</title>", F.concat(F.lit('</title><script type="application/ld+json">'), F.to_json(said), F.lit("</script>")))
    return read("pages").select("page_id", records.structured_data(html).alias("d")).select("page_id", "d.year", F.array_join("d.authors", "|").alias("authors"))


@query("F9_absolute", r"SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://base.org' || p WHEN 1 THEN 'https:' || regexp_replace(url, '^[a-z]+:', '') ELSE url END AS url FROM (SELECT *, '/' || regexp_extract(url, '^[a-z]+://[^/]*/(.*)$', 1) AS p FROM pages)")
def _(read):
    k = F.col("page_id") % 3
    path = F.concat(F.lit("/"), F.regexp_extract("url", "^[a-z]+://[^/]*/(.*)$", 1))
    url = F.when(k == 0, path).when(k == 1, F.regexp_replace("url", "^[a-z]+:", "")).otherwise(F.col("url"))
    return read("pages").select("page_id", text.absolute(url, "https://base.org").alias("url"))


@query("P14_normal_doi", "SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 THEN '10.' || p_partkey || '/' || replace(lower(p_name), ' ', '-') END AS doi FROM part")
def _(read):
    bare = F.concat(F.lit("10."), F.col("p_partkey").cast("string"), F.lit("/"), F.translate("p_name", " ", "-"))
    forms = [bare, F.concat(F.lit(" DOI: "), bare), F.concat(F.lit("http://dx.doi.org/"), F.upper(bare)), F.concat(F.lit("doi.org/"), bare, F.lit("\t")), F.col("p_name")]
    given = forms[4]
    for k, form in enumerate(forms[:4]):
        given = F.when(F.col("p_partkey") % 5 == k, form).otherwise(given)
    return read("part").select("p_partkey", text.normal_doi(given).alias("doi"))


@query("F19_reference_line", "SELECT c_custkey, c_name || ', ' || c_mktsegment || CASE WHEN c_custkey % 3 > 0 THEN ' (' || (1950 + c_custkey % 70) || ').' ELSE '' END || ' T ' || c_nationkey || '. u/' || c_custkey AS line FROM customer")
def _(read):
    key = F.col("c_custkey")
    year = F.when(key % 3 > 0, (1950 + key % 70).cast("int"))
    title = F.concat(F.lit("T "), F.col("c_nationkey").cast("string"))
    return read("customer").select("c_custkey", text.reference_line(F.array("c_name", "c_mktsegment"), year, title, F.concat(F.lit("u/"), key.cast("string"))).alias("line"))


@query(
    "M9_api_records",
    "SELECT 'W' || o_orderkey AS paper_id, o_orderstatus AS title, o_orderpriority || '|' || o_orderstatus AS authors, CAST(year(o_orderdate) AS BIGINT) AS year, o_orderstatus || ' of  ' || o_orderpriority AS abstract, 'https://l.org/' || o_orderkey AS pub_url, CASE WHEN o_orderkey % 2 = 0 THEN '10.1/' || o_orderkey ELSE '' END AS file_urls, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS BIGINT) AS cited_by_count FROM orders",
)
def _(read):
    key = F.col("o_orderkey")
    name = lambda c: F.struct(F.struct(c.cast("string").alias("display_name")).alias("author"))
    spots = F.map_from_arrays(F.array(F.concat(F.col("o_orderstatus"), F.lit(" of")), F.col("o_orderpriority")), F.array(F.array(F.lit(0)), F.array(F.lit(2))))
    raw = read("orders").select(
        F.concat(F.lit("https://openalex.org/W"), key.cast("string")).alias("id"), F.col("o_orderstatus").alias("title"), F.array(name(F.col("o_orderpriority")), name(F.lit(None)), name(F.col("o_orderstatus"))).alias("authorships"), F.year("o_orderdate").alias("publication_year"),
        spots.alias("abstract_inverted_index"), F.struct(F.concat(F.lit("https://l.org/"), key.cast("string")).alias("landing_page_url")).alias("primary_location"), F.when(key % 2 == 0, F.concat(F.lit("10.1/"), key.cast("string"))).alias("doi"), F.when(key % 3 != 0, F.col("o_custkey")).alias("cited_by_count"),
    )
    made = records.api_records(raw).drop("source_id")
    return made.withColumn("authors", F.array_join("authors", "|")).withColumn("file_urls", F.array_join("file_urls", "|"))
