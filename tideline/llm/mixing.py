"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every source has a target number of words. A source first gives as many complete epochs as fit into its target; the
rest comes from a weighted sample without replacement: each document has the key -ln(u)/w, where u is a fixed hash of
its id and w its quality weight, and documents are taken in ascending key until their prefix sum reaches the rest. The
last places, `fits` at most, go to remaining documents, each the one whose size fits what is left best, as long as that
brings the source nearer.

A source with a third of all rows is no single task's to sort: its keys are cut into `buckets` ranges at their own quantiles,
so that ranges hold about as many documents whatever their weights, the ranges' sizes are prefix-summed, and the range in
which the rest is reached is cut up again, until it holds no more than `sort_rows` documents; these are sorted.

Defined cases: null text has size 0 and is never taken; a null source is a source of its own, last in order; null ids
are hashed by their text; rows equal in id and text share one fate; an empty table gives an empty plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import WORD, Scratch, hex_fraction, stage, text_or_empty

SYMBOLS = "[#*$%&|<>!]"


def quality_weight(text: Column) -> Column:
    """1 for text without symbols, falling by four times their share, 0.05 at least."""
    share = F.regexp_count(text, F.lit(SYMBOLS)) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.05), F.lit(1.0) - 4.0 * share)


def mix_columns(seed: int) -> dict[str, Column]:
    """What the plan needs of a document; the same expressions serve to apply it."""
    text = text_or_empty()
    identity = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(text)))
    u = hex_fraction(F.md5(F.concat(F.lit(f"{seed}:"), identity)))
    return {
        "mix_source": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("~")),
        "mix_size": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "mix_key": -F.log(u) / quality_weight(text),
    }


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """sizes: source (null allowed), source_size -> the same with target.

    Weights repeat over the sources in code point order, null last. Shares that exceed `cap` times the size stop there
    and the excess goes to the others by weight: sources are capped in ascending cap/weight, until the level of the
    rest is below the next one's ratio. One row per source.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = sizes.withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[(turn % len(weights)).cast("int")])
    full = F.col("source_size") * F.lit(float(cap))
    ordered = W.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (
        F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = weighted.withColumns({"full": full, "ratio": full / F.col("weight")}).withColumn("level", level)
    first_free = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(W.partitionBy())
    return levels.withColumn("free", first_free).select(
        "source", "source_size", F.least(F.coalesce(F.col("free.level") * F.col("weight"), F.col("full")), F.col("full")).alias("target")
    )


class Mix:
    """A plan: `documents` (one light row each), `sources` (targets) and `cuts` (what each source gives)."""

    def __init__(self, docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3, seed: int = 17, buckets: int = 128, fits: int = 5, sort_rows: int = 10_000):
        self.buckets, self.fits, self.sort_rows = buckets, fits, sort_rows
        self.columns = mix_columns(seed)
        light = docs.select("doc_id", "source", *[c.alias(n) for n, c in self.columns.items()])
        self.documents = stage(light, "mix-documents")
        sizes = self.documents.groupBy("mix_source").agg(F.first("source").alias("source"), F.sum("mix_size").alias("source_size"))
        targets = source_targets(sizes.select("source", "source_size"), weights, cap)
        whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0)).cast("long")
        rest = F.greatest(F.round("target").cast("long") - whole * F.col("source_size"), F.lit(0))
        full = (rest >= F.col("source_size")) & (F.col("source_size") > 0)  # a target half a word below one epoch more
        sources = targets.withColumn("mix_source", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("~")))
        self.sources = stage(sources.withColumns({"epochs": whole + full.cast("long"), "rest": F.when(full, F.lit(0)).otherwise(rest)}), "mix-sources")
        with Scratch(docs.sparkSession) as scratch:
            self.cuts = stage(self._cuts(scratch.stage), "mix-cuts")

    def _narrowed(self, stage: Callable[..., DataFrame] = stage) -> tuple[DataFrame, DataFrame]:
        """Per source that has a rest: the keys (over low, up to high; a null is no bound) among which the rest is reached, and
        the size of what comes before them; and the documents there."""
        spans = self.sources.where("rest > 0").select("mix_source", "rest", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(0).cast("long").alias("before"))
        shares = F.lit([k / self.buckets for k in range(1, self.buckets)])
        keys = self.documents.where("mix_size > 0").select("mix_source", "mix_key", "mix_size")
        while True:
            inside = keys.join(spans, "mix_source").where((F.col("low").isNull() | (F.col("mix_key") > F.col("low"))) & (F.col("high").isNull() | (F.col("mix_key") <= F.col("high"))))
            counts = inside.groupBy("mix_source").agg(F.count(F.lit(1)).alias("n"), F.min("mix_key").alias("least"), F.max("mix_key").alias("most"), F.percentile_approx("mix_key", shares, 10_000).alias("edges"))
            counts = stage(counts, "mix-ranges")
            wide = counts.where((F.col("n") > self.sort_rows) & (F.col("least") < F.col("most")))
            if not wide.limit(1).count():
                return spans, inside
            # the least key is an edge and the greatest none, so that no range is all of them
            edges = F.filter(F.concat(F.array("least"), F.col("edges")), lambda x: x < F.col("most"))
            placed = inside.join(wide.select("mix_source", edges.alias("edges")), "mix_source")
            ranges = placed.groupBy("mix_source", F.size(F.filter("edges", lambda x: x < F.col("mix_key"))).alias("range")).agg(F.sum("mix_size").alias("size"), F.max("mix_key").alias("top"))
            earlier = W.partitionBy("mix_source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
            ranges = ranges.withColumns({"so_far": F.coalesce(F.sum("size").over(earlier), F.lit(0)), "under": F.max("top").over(earlier)})
            reached = ranges.join(spans, "mix_source").where((F.col("before") + F.col("so_far") <= F.col("rest")) & (F.col("before") + F.col("so_far") + F.col("size") > F.col("rest")))
            found = reached.select("mix_source", "rest", F.coalesce("under", "low").alias("low"), F.col("top").alias("high"), (F.col("before") + F.col("so_far")).alias("before"))
            spans = stage(spans.join(wide.select("mix_source"), "mix_source", "left_anti").unionByName(found), "mix-spans")

    def _cuts(self, stage: Callable[..., DataFrame]) -> DataFrame:
        """Per source: the greatest key taken in the last epoch, and the keys of those that fit what is left best."""
        spans, inside = self._narrowed(stage)
        # range frame: documents with one key share one fate
        running = F.col("before") + F.sum("mix_size").over(W.partitionBy("mix_source").orderBy("mix_key"))
        taken = inside.withColumn("running", running).where("running <= rest").groupBy("mix_source").agg(F.max("mix_key").alias("last_key"), F.max("running").alias("taken_so_far"))
        last = spans.join(taken, "mix_source", "left")
        last = last.select("mix_source", F.coalesce("last_key", "low", F.lit(-1.0)).alias("last_key"), (F.col("rest") - F.coalesce("taken_so_far", "before")).alias("left_over"))
        last = stage(last, "mix-last")
        beyond = self.documents.join(last, "mix_source").where((F.col("mix_key") > F.col("last_key")) & (F.col("mix_size") > 0) & (F.col("mix_size") < 2 * F.col("left_over")))
        # of each size as many keys as may be taken, and a few of each are enough
        beyond = beyond.groupBy("mix_source", "mix_size", F.pmod(F.xxhash64("mix_key"), F.lit(self.fits)).alias("turn")).agg(F.min("mix_key").alias("mix_key"))
        beyond = stage(beyond.select("mix_source", "mix_size", "mix_key"), "mix-beyond")
        last = last.withColumn("fit_keys", F.array().cast("array<double>"))
        for _ in range(self.fits):
            open_ = beyond.join(last.select("mix_source", "left_over", "fit_keys"), "mix_source")
            open_ = open_.where((F.col("mix_size") < 2 * F.col("left_over")) & ~F.array_contains("fit_keys", F.col("mix_key")))
            best = open_.groupBy("mix_source").agg(F.min(F.struct(F.abs(F.col("mix_size") - F.col("left_over")).alias("off"), "mix_key", "mix_size")).alias("best"))
            last = last.join(best, "mix_source", "left").select(
                "mix_source",
                "last_key",
                (F.col("left_over") - F.coalesce("best.mix_size", F.lit(0))).alias("left_over"),
                F.when(F.col("best").isNull(), F.col("fit_keys")).otherwise(F.concat("fit_keys", F.array("best.mix_key"))).alias("fit_keys"),
            )
            last = stage(last, "mix-fit")
        return self.sources.drop("source", "rest").join(last.drop("left_over"), "mix_source", "left")

    def apply(self, docs: DataFrame) -> DataFrame:
        """row (all columns of docs) and mix_copies: how often the mix takes it (0: not at all)."""
        rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id", "text", "source").withColumns(self.columns)
        return self._copies(rows).select("row", "mix_copies")

    def decisions(self) -> DataFrame:
        """doc_id, size, source_size, target, taken."""
        rows = self._copies(self.documents)
        return rows.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", (F.col("mix_size") * F.col("mix_copies")).alias("taken"))

    def _copies(self, rows: DataFrame) -> DataFrame:
        taken = (F.col("mix_key") <= F.col("last_key")) | F.array_contains("fit_keys", F.col("mix_key"))
        copies = F.when(F.col("mix_size") > 0, F.col("epochs") + F.coalesce(taken, F.lit(False)).cast("int")).otherwise(F.lit(0)).cast("long")
        joined = rows.join(self.cuts, "mix_source", "left")
        return joined.withColumn("mix_copies", copies).drop("epochs", "last_key", "fit_keys")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with the columns it came with."""
    rows = Mix(docs, **options).apply(docs).where("mix_copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias("copy")).select("row.*")
