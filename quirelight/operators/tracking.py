"""The lifecycle of publications: merge, plan, transitions, work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

PENDING = "Pending"
# fixed values: stages in order with the status that completes each
STAGES = {"download": "Downloaded", "processing": "Processed", "embedding": "Embedded", "ingestion": "Ingested"}


def first_wins(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row a key, the first in a total order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def refresh(existing: DataFrame, incoming: DataFrame, key: str, hash_col: str) -> DataFrame:
    """key, outcome (new, updated, unchanged, retained) and the surviving hash."""
    a = existing.select(F.col(key).alias("k1"), F.col(hash_col).alias("old"))
    b = incoming.select(F.col(key).alias("k2"), F.col(hash_col).alias("new"))
    both = a.join(b, F.col("k1") == F.col("k2"), "full")
    outcome = F.when(F.col("k1").isNull(), "new").when(F.col("k2").isNull(), "retained").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated")
    return both.select(F.coalesce("k1", "k2").alias(key), outcome.alias("outcome"), F.when(F.col("k2").isNull(), F.col("old")).otherwise(F.col("new")).alias(hash_col))


def merged(existing: DataFrame, incoming: DataFrame, key: str, hash_col: str) -> DataFrame:
    """The catalogue after a refresh: whole records, incoming ones over existing ones, with their outcome.

    A record that comes again unchanged keeps the stored row; one that no longer comes stays.
    """
    columns = [c for c in existing.columns if c != key]
    a = existing.select(F.col(key).alias("__k1"), F.struct(*columns).alias("__old"))
    b = incoming.select(F.col(key).alias("__k2"), F.struct(*[F.col(c) if c in incoming.columns else F.lit(None).cast(dict(existing.dtypes)[c]).alias(c) for c in columns]).alias("__new"))
    both = a.join(b, F.col("__k1") == F.col("__k2"), "full")
    same = F.col(f"__old.{hash_col}").eqNullSafe(F.col(f"__new.{hash_col}"))
    outcome = F.when(F.col("__k1").isNull(), "new").when(F.col("__k2").isNull(), "retained").when(same, "unchanged").otherwise("updated")
    rows = both.select(F.coalesce("__k1", "__k2").alias(key), outcome.alias("outcome"), "__old", "__new")
    taken = lambda c: F.when(F.col("outcome").isin("new", "updated"), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}")).alias(c)
    return rows.select(key, *[taken(c) for c in columns], "outcome")


def discovered(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources' rows, by column name, with their source; a source that cannot be planned fails the whole."""
    out = None
    for name, rows in sources.items():
        rows = rows.withColumn("source", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out


def known_sources(requested: list[str], valid: list[str]) -> list[str]:
    """The requested names, if all are valid."""
    if strange := sorted(set(requested) - set(valid)):
        raise ValueError(f"unknown sources: {', '.join(strange)}")
    return list(dict.fromkeys(requested))


def status_of(tracked: DataFrame, key: str, ids: list) -> DataFrame:
    """key and the stages' statuses of the given ids."""
    wanted = tracked.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(ids)], f"{key} {dict(tracked.dtypes)[key]}")
    return tracked.join(wanted, key, "left_semi").select(key, *[f"{s}_status" for s in STAGES])


def matching(rows: DataFrame, **values: object) -> DataFrame:
    """Rows with all of these values; None asks for null."""
    for name, value in values.items():
        rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
    return rows


def get_or_create(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with those of ``new`` whose keys they lack, one a key."""
    absent = new.dropDuplicates(keys).join(rows.select(*keys), keys, "left_anti")
    return rows.unionByName(absent, allowMissingColumns=True)


def processing_plan(publications: DataFrame, tracked: DataFrame, key: str) -> DataFrame:
    """key, needs_<stage>, files_to_reprocess, reason.

    Both have key, content_hash, file_urls; ``tracked`` also <stage>_status.
    New, changed hash, changed files: all stages; else those not complete and
    all after one that is not.
    """
    none = F.expr("cast(array() as array<string>)")
    p = publications.select(F.col(key).alias("p"), F.col("content_hash").alias("ph"), F.coalesce("file_urls", none).alias("pf"))
    t = tracked.select(F.col(key).alias("t"), F.col("content_hash").alias("th"), F.coalesce("file_urls", none).alias("tf"), *[f"{s}_status" for s in STAGES])
    both = p.join(t, F.col("p") == F.col("t"), "left")
    added, gone = F.array_except("pf", "tf"), F.array_except("tf", "pf")
    reason = (
        F.when(F.col("t").isNull(), "New publication")
        .when(~F.col("ph").eqNullSafe(F.col("th")), "Content hash changed")
        .when((F.size(added) > 0) | (F.size(gone) > 0), "Files changed")
        .otherwise("Status check")
    )
    both = both.withColumn("reason", reason)
    needs, so_far = [], F.col("reason") != "Status check"
    for stage, done in STAGES.items():
        so_far = so_far | ~F.col(f"{stage}_status").eqNullSafe(F.lit(done))
        needs.append(so_far.alias(f"needs_{stage}"))
    files = F.when(F.col("reason") == "Content hash changed", F.col("pf")).when(F.col("reason") == "Files changed", added).otherwise(none)
    return both.select(F.col("p").alias(key), *needs, files.alias("files_to_reprocess"), "reason")


def upsert(publications: DataFrame, tracked: DataFrame, key: str) -> DataFrame:
    """Tracking rows after adding ``publications``.

    Content comes from the publication; needed stages go back to Pending;
    attempts stay; rows without a publication stay as they are.
    """
    plan = processing_plan(publications, tracked, key).drop("files_to_reprocess", "reason")
    new = publications.select(key, F.col("content_hash").alias("h"), F.col("file_urls").alias("f")).join(plan, key)
    both = tracked.join(new, key, "full")
    mine = F.col("needs_download").isNotNull()
    out = [F.when(mine, F.col("h")).otherwise(F.col("content_hash")).alias("content_hash"), F.when(mine, F.col("f")).otherwise(F.col("file_urls")).alias("file_urls")]
    for stage in STAGES:
        out.append(F.when(F.coalesce(f"needs_{stage}", F.lit(False)), PENDING).otherwise(F.col(f"{stage}_status")).alias(f"{stage}_status"))
        if f"{stage}_attempts" in tracked.columns:
            out.append(F.coalesce(f"{stage}_attempts", F.lit(0)).alias(f"{stage}_attempts"))
    return both.select(key, *out)


def validated(publications: DataFrame, key: str, title: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason): an id and a title that are not blank, one row an id."""
    blank = lambda c: F.coalesce(F.length(strip(F.col(c).cast("string"))), F.lit(0)) == 0
    reason = F.when(blank(key), "no id").when(blank(title), "no title")
    judged = publications.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def registered(publications: DataFrame, tracked: DataFrame, key: str, metadata: list[str]) -> DataFrame:
    """``upsert`` with metadata: the publication's own over the stored; discovery time and attempts stay."""
    out = upsert(publications, tracked, key)
    new = publications.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in metadata], F.lit(True).alias("__mine"))
    rest = [c for c in tracked.columns if c not in out.columns]
    old = tracked.select(F.col(key).alias("__t"), *[F.col(c).alias(f"__old_{c}") for c in rest])
    rows = out.join(new, F.col(key) == F.col("__k"), "left").join(old, F.col(key) == F.col("__t"), "left")
    stored = lambda c: F.col(f"__old_{c}") if c in rest else F.lit(None)
    return rows.select(*out.columns, *[F.when(F.col("__mine"), F.col(f"__{c}")).otherwise(stored(c)).alias(c) for c in metadata], *[F.col(f"__old_{c}").alias(c) for c in rest if c not in metadata])


def stage_transitions(events: DataFrame, key: str, stage: str, order: list[str]) -> DataFrame:
    """key, <stage>_status, _attempts, _updated and the error of one stage's log."""
    own = events.where(F.col("stage") == stage)
    out = folded(own, [key], "status", order, "error")
    return out.select(key, F.col("status").alias(f"{stage}_status"), F.col("attempts").alias(f"{stage}_attempts"), F.col("updated").alias(f"{stage}_updated"), F.col("error").alias("error_message"))


def folded(transitions: DataFrame, keys: list[str], status: str, order: list[str], error: str) -> DataFrame:
    """keys, status, attempts, updated, error after a log of transitions.

    Every transition counts as an attempt; the last one's error holds, so a
    success clears it.
    """
    place = F.struct(*order)
    return transitions.groupBy(*keys).agg(F.max_by(status, place).alias("status"), F.count(F.lit(1)).alias("attempts"), F.max(order[0]).alias("updated"), F.max_by(error, place).alias("error"))


def work_list(tracked: DataFrame, stage: str, key: str, limit: int | None = None) -> DataFrame:
    """Ids whose stage is pending and whose earlier stage is complete; a limit of 0 is none."""
    names = list(STAGES)
    rows = tracked.where(F.col(f"{stage}_status") == PENDING)
    if before := names.index(stage):
        rows = rows.where(F.col(f"{names[before - 1]}_status") == STAGES[names[before - 1]])
    rows = rows.select(key)
    return rows.orderBy(key).limit(limit) if limit else rows


def embedding_work(tracked: DataFrame, on_disk: DataFrame, key: str, requested: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """key, origin: tracked ids that have chunks, then ids found on disk only."""
    disk = on_disk.select(key).distinct()
    mine = tracked.select(key).distinct().join(disk, key, "left_semi").withColumn("origin", F.lit("tracked"))
    other = disk.join(tracked.select(key), key, "left_anti").withColumn("origin", F.lit("disk"))
    rows = mine.unionByName(other)
    if requested is not None:
        rows = rows.join(requested.select(key).distinct(), key, "left_semi")
    return rows.orderBy(F.when(F.col("origin") == "tracked", 0).otherwise(1), key).limit(limit) if limit else rows


def embedding_report(tracked: DataFrame, on_disk: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """key, found of the requested ids: whether tracked, on disk, or neither (what a run leaves out)."""
    mark = lambda rows, name: rows.select(F.col(key).alias(f"__{name}")).distinct()
    rows = requested.select(key).distinct()
    rows = rows.join(mark(tracked, "t"), F.col(key) == F.col("__t"), "left").join(mark(on_disk, "d"), F.col(key) == F.col("__d"), "left")
    t, d = F.col("__t").isNotNull(), F.col("__d").isNotNull()
    return rows.select(key, F.when(t & d, "tracked").when(d, "disk").when(t, "without chunks").otherwise("missing").alias("found"))


def missing(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return wanted.join(have.select(key).distinct(), key, "left_anti")


def targets(files: DataFrame, directory: str, stem: str) -> DataFrame:
    """directory, stem, document_id: the first file of a directory has its name, others a suffix.

    A directory's files are counted by their order within it.
    """
    first = files.groupBy(directory).agg(F.min(stem).alias("__first"))
    # many files may share a directory, so no window gathers them: only the least is needed
    rows = files.join(first, directory)
    return rows.select(directory, stem, F.when(F.col(stem) == F.col("__first"), F.col(directory).cast("string")).otherwise(F.concat_ws("__", F.col(directory).cast("string"), F.col(stem).cast("string"))).alias("document_id"))


def artifact_ids(artifacts: DataFrame, path: str) -> DataFrame:
    """path, document_id of artifacts of one file name, as ``targets`` laid them out.

    A folder whose own parent holds an artifact is a second file's: ``a/b`` is ``a__b``.
    """
    folder = F.regexp_extract(F.col(path), r"^(.*)/[^/]*$", 1)
    up = F.regexp_extract("__folder", r"^(.*)/[^/]*$", 1)
    rows = artifacts.select(path, folder.alias("__folder")).withColumn("__up", up)
    holders = rows.select(F.col("__folder").alias("__holder")).distinct()
    joined = rows.join(holders, F.col("__up") == F.col("__holder"), "left")
    name = lambda c: F.substring_index(c, "/", -1)
    return joined.select(path, F.when(F.col("__holder").isNotNull(), F.concat(name("__up"), F.lit("__"), name("__folder"))).otherwise(name("__folder")).alias("document_id"))


def guarded(claims: DataFrame, path: str, order: str) -> DataFrame:
    """Claims on output paths: the first of a path holds, others have an error; no path's claims are gathered."""
    first = claims.groupBy(F.col(path).alias("__path")).agg(F.min(order).alias("__first"))
    joined = claims.join(first, F.col(path) == F.col("__path"))
    return joined.withColumn("error", F.when(F.col(order) != F.col("__first"), F.concat(F.lit("path already claimed: "), F.col(path)))).drop("__path", "__first")
