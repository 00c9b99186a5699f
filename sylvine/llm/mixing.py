"""Mixing sources to target weights by Pareto order sampling.

A source's words are to come to its target. Where the target exceeds the source, every document is first taken whole as
often as that fits (certain copies). The rest comes from a Pareto sample: document i has inclusion intensity
l_i = c * w_i with w_i the square root of its size, and documents are ranked by u/(1-u) divided by l_i/(1-l_i), u being
a hash of the document's id and the seed. The ranking is cut where its words reach what is missing, so the sample has a
fixed size in words; the document at the cut gives just the words still missing.

The cut is found without gathering a source in one task: words are summed by source and by one of BINS ranges of the
rank, a running sum over those few rows finds the range with the cut, and only that range's documents are sorted.

Rows of equal rank are ordered by id and size, so a tie at the cut is decided alike in every run. A very long text is one
value whose words are counted in the JVM. Null or empty text: size 0, nothing taken. Null source: a source of its own, the last. Repeated rows are documents of
their own. An empty table gives an empty result. Only the named columns are read, so others may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from sylvine.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, MOST, BINS, SEED = 1.5, 2, 4096, "mix-1"


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds weight and target to rows (source, source_size, ...), one a source.

    Targets are least(most * source_size, weight * level) with the level at which they sum to share * all sizes.
    Sources are in the order of their names' bytes, null last; weights repeat. One row a source is sorted.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    x = sources.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", cycle)
    x = x.withColumn("ratio", F.lit(float(most)) * F.col("source_size") / F.col("weight"))
    by = W.orderBy("ratio", "place")
    upto, every = by.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    x = x.select(
        "*",
        F.sum("source_size").over(every).alias("all_size"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0))).alias("free_weight"),
        (F.lit(most) * F.coalesce(F.sum("source_size").over(upto), F.lit(0))).alias("held"),
    )
    # Sources with smaller ratios are full: what is left is shared by weight among this one and those after it. From the
    # first source that isn't full on, these levels don't exceed the ratios and descend, so the largest is the level.
    x = x.withColumn("level", (F.lit(share) * F.col("all_size") - F.col("held")) / F.col("free_weight"))
    x = x.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
    full = F.col("level").isNull() | (F.col("ratio") <= F.col("level"))
    return x.withColumn("target", F.when(full, F.lit(float(most)) * F.col("source_size")).otherwise(F.col("weight") * F.col("level"))).drop("all_size", "free_weight", "held", "ratio", "place")


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=SHARE, most=MOST, seed=SEED, bins=BINS, carry: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row a document: its id (as doc_id), size, source, source_size, target, copies (whole ones, certain) and taken (words); and the column `carry`."""
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    unit = (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":" + seed))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    more = [F.col(carry).alias("carried")] if carry else []
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), unit.alias("unit"), *more)
    sized = scratch.table(sized.withColumn("w", F.floor(F.sqrt("size") * 16)), "sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("w")).alias("mass"))
    goal = targets(sums, weights, share, most)
    goal = goal.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.expr("nullif(source_size, 0)"))).otherwise(F.lit(0)).cast("long"))
    goal = scratch.table(goal.withColumn("missing", F.floor(F.col("target") - F.col("copies") * F.col("source_size")).cast("long")), "targets")

    same = sized.source.eqNullSafe(goal.source)
    odds = F.col("unit") / (1 - F.col("unit"))
    chance = F.col("missing") * F.col("w") / F.expr("nullif(mass, 0)").cast("double")
    key = F.when(F.coalesce(chance, F.lit(0.0)) <= 0, F.lit(1e300)).when(chance >= 1, F.lit(0.0)).otherwise(odds * ((1 - chance) / chance))
    x = sized.join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    x = x.withColumn("key", key).withColumn("bin", F.least(F.floor(F.col("key") / (1 + F.col("key")) * bins), F.lit(bins - 1)).cast("int"))
    by_bin = x.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    by_bin = by_bin.select(F.col("source").alias("of"), F.col("bin").alias("in_bin"), "words", before.alias("words_before"))
    # As a table its size is known, so that carried rows are joined with it where they are.
    by_bin = scratch.table(by_bin, "bins") if carry else by_bin
    x = x.join(by_bin, F.col("source").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("in_bin"))).drop("of", "in_bin")
    whole = F.col("words_before") + F.col("words") <= F.col("missing")
    none = F.col("words_before") >= F.col("missing")
    cut = W.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    at_cut = x.where(~whole & ~none)
    at_cut = at_cut.withColumn("rest", F.col("missing") - F.col("words_before") - F.coalesce(F.sum("size").over(cut), F.lit(0)))
    at_cut = at_cut.withColumn("extra", F.greatest(F.lit(0), F.least("size", "rest"))).drop("rest")
    x = x.where(whole | none).withColumn("extra", F.when(whole, F.col("size")).otherwise(F.lit(0))).unionByName(at_cut)
    return x.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("extra")).cast("long").alias("taken"), "source", "copies", *[c for c in ["carried"] if carry])


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS unit
  FROM documents),
w AS (SELECT *, floor(sqrt(size) * 16)::BIGINT AS w FROM sized),
sums AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * w)::BIGINT AS mass FROM w GROUP BY source),
placed AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM sums),
ratios AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio FROM placed),
lev AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS own_level FROM ratios),
levels AS (SELECT *, max(CASE WHEN own_level <= ratio THEN own_level END) OVER () AS level FROM lev),
goals AS (SELECT source, source_size, mass, CASE WHEN level IS NULL OR ratio <= level THEN 2.0::DOUBLE * source_size ELSE weight * level END AS target FROM levels),
copies AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM goals),
missing AS (SELECT *, floor(target - copies * source_size)::BIGINT AS missing FROM copies),
chances AS (SELECT w.doc_id, w.source, w.size, unit, source_size, target, copies, missing, coalesce((missing * w)::DOUBLE / nullif(mass, 0)::DOUBLE, 0.0) AS chance
  FROM w JOIN missing m ON w.source IS NOT DISTINCT FROM m.source),
keys AS (SELECT *, CASE WHEN chance <= 0 THEN 1e300 WHEN chance >= 1 THEN 0.0 ELSE unit / (1 - unit) * ((1 - chance) / chance) END AS key FROM chances),
runs AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keys)
SELECT doc_id, size::BIGINT AS size, source_size, target, (copies * size + greatest(0, least(size, missing - before)))::BIGINT AS taken, source, copies FROM runs
"""
