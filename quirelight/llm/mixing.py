"""Mixing sources to target weights.

A source's target is its share, by weight, of all words; a target over
``MOST`` times the source's size stops there and the excess is shared out
again by weight.  In sum this is one level L with target = min(weight * L,
MOST * size), found from running sums over the sources in the order in which
they reach their limit.  Each document is then taken floor(rate) times, rate
being target / size of its source, and once more if a number in [0, 1) drawn
from a hash of the seed, its id and its text is below the rate's fraction.

Defined results: null texts have size 0; a null source is a source of its
own, after all others; a source without words has target 0 and rate 0;
repeated rows draw alike; an empty table gives an empty result; extra columns
are kept by ``emit`` and not read by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = 3.0
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """mix_source, source_size, target, rate; ``sizes`` has mix_source, size.

    The windows run over one row a source, after the partial sums.
    """
    by_source = sizes.groupBy("mix_source").agg(F.sum("size").alias("source_size"))
    # the binary form of a string sorts by code point
    order = Window.orderBy(F.col("mix_source").cast("binary").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = by_source.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    limit = F.col("source_size") * F.lit(most)
    filled = Window.orderBy(limit / F.col("weight"), F.col("mix_source").cast("binary").asc_nulls_last())
    earlier = filled.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ranked.withColumn(
        "level",
        (F.sum("source_size").over(all_rows) - F.coalesce(F.sum(limit).over(earlier), F.lit(0.0)))
        / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))),
    )
    # the first source, in filling order, that stays below its limit fixes the level
    level = level.withColumn("nth", F.row_number().over(filled))
    fits = F.when(F.col("level") <= limit / F.col("weight"), F.struct("nth", "level"))
    level = level.withColumn("final", F.min(fits).over(all_rows)["level"])
    target = F.least(F.col("weight") * F.coalesce("final", F.lit(float("inf"))), limit)
    return level.select("mix_source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(most))).otherwise(0.0).alias("rate"))


def draw(seed: str, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) of 52 hash bits."""
    key = F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def plan(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False) -> DataFrame:
    """Sizes, targets and copies of every row; with ``keep`` beside its own columns."""
    mine = {"mix_source": docs[source_col].cast("string"), "size": word_count(docs[text_col])}
    targets = source_targets(docs.select(*[v.alias(k) for k, v in mine.items()])).withColumnRenamed("mix_source", "of_source")
    own = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if keep else []
    rows = docs.select(*own, docs[id_col].alias("doc_id"), *[v.alias(k) for k, v in mine.items()], draw(seed, docs[id_col], docs[text_col]).alias("drawn"))
    # one row a source; Spark broadcasts it only below its size threshold and else splits hot sources
    joined = rows.join(targets, F.col("mix_source").eqNullSafe(F.col("of_source")), "left")
    whole = F.floor("rate")
    copies = (whole + (F.col("drawn") < F.col("rate") - whole).cast("long")).cast("long")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("of_source", "drawn")


def emit(docs: DataFrame, seed: str = SEED, **columns: str) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    taken = plan(docs, seed, keep=True, **columns).where("copies > 0")
    return taken.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
