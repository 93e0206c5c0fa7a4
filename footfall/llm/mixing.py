"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Sizes are words; null text has none. A null source is a source of its own, the last. Ties: rows equal in
doc_id and size are interchangeable, so repeated rows give the same multiset on every run; rows with a
null doc_id are mixed like others. A document without words is never needed to reach a target: it is
taken once if its place comes before the cut, at no cost. If no document has words all targets are 0.
An empty table gives an empty result. Other columns are only carried along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from footfall.llm.common import around, parts_for, stored, table, with_offsets

#: Weights of the sources in the order of their names' code points, repeating.
WEIGHTS = (1, 2, 3)
#: A document is repeated so often at most.
REPEATS = 3
#: Finish times are summed in so many ranges a unit; all from LAST_TIME on are one range. By time 1 no source
#: has more than its target, so the cut lies beyond, and close to it.
BINS_PER_UNIT = 1 << 12
LAST_TIME = 2.0


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+: white space that a word follows, plus one if a word comes first.
    Without building the words: all but white space is dropped to one mark a word."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]++", "\u0001")
    return F.coalesce(F.length(F.regexp_replace(marks, r"[\x20\x09-\x0D]++", "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target: water-filling. Sources are capped in the order of cap / weight; the
    level for the others is what is left divided by their weights. One row a source goes through the
    window; the documents are summed before."""
    listed = F.array(*[F.lit(w) for w in weights])
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = W.orderBy(F.col("source").asc_nulls_last())
    weighed = by_source.withColumns({
        "weight": F.element_at(listed, (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"),
        "cap": F.col("source_size") * repeats})
    filled = W.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    whole = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    levels = weighed.withColumns({
        "total": F.sum("source_size").over(whole),
        "capped": F.coalesce(F.sum("cap").over(filled.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "open": F.sum("weight").over(filled.rowsBetween(W.currentRow, W.unboundedFollowing))}).withColumn(
        "level", (F.col("total") - F.col("capped")) / F.col("open"))
    # the level of the first source that stays below its cap holds for all after it
    below = F.col("level") * F.col("weight") <= F.col("cap")
    first = F.max(F.when(below, F.struct("open", "level"))).over(whole).getField("level")
    return levels.withColumn("first", first).select(
        "source", "source_size",
        F.when(F.col("first").isNull() | (F.col("cap") <= F.col("first") * F.col("weight")), F.col("cap").cast("double"))
        .otherwise(F.col("first") * F.col("weight")).alias("target"))


def fair_queue(rows: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Each row of (doc_id, size, source, ...) and `source_size`, `target` and `copies`: how often the mix
    takes it.

    Within a source documents stand in the order of the MD5 of their id. A copy's virtual finish time
    is the source's words up to its end, over all rounds before, divided by the source's target. Sources
    are cut into parts by the leading digits of the MD5, so a hot source is summed in many tasks. The cut
    is the largest finish time up to which all copies together fit the budget: copies are summed by time
    range first, then only the range with the cut is sorted, all sources together, by range partitions
    with prefix sums over them. No task holds more than its partition."""
    digits = max(2, len(f"{parts_for(rows.count()):x}"))
    # rows without an id are spread by their sizes
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("size "), F.col("size")))
    shuffled = stored(rows.withColumn("mark", F.md5(name)).withColumn("part", F.substring("mark", 1, digits)), "sizes")
    targets = stored(source_targets(shuffled, weights, repeats), "targets")
    order = [F.col("mark"), F.col("doc_id"), F.col("size")]
    summed = with_offsets(shuffled, "part", order, {"before": "size"}, within=["source"])
    named = targets.withColumnRenamed("source", "name")
    queued = summed.join(named, F.col("source").eqNullSafe(F.col("name")), "left").drop("name")
    queued = stored(queued.drop("mark", "part"), "queue")
    rounds = [((F.col("source_size") * k + F.col("before") + F.col("size")) / F.nullif(F.col("target"), F.lit(0.0))) for k in range(repeats)]
    copies = queued.select("size", F.explode(F.array(*rounds)).alias("time")).where("size > 0 AND time IS NOT NULL")
    budget = targets.agg(F.sum("source_size").alias("budget"))
    time_range = F.floor(F.least("time", F.lit(LAST_TIME)) * BINS_PER_UNIT)
    ranges = copies.groupBy(time_range.alias("bin")).agg(F.sum("size").alias("words"))
    # at most BINS_PER_UNIT * LAST_TIME + 1 ranges; the first that overflows has the cut
    up_to = ranges.withColumn("until", F.sum("words").over(W.orderBy("bin"))).join(F.broadcast(budget))
    cut = up_to.where("until > budget").agg(F.min_by(F.struct("bin", "words", "until", "budget"), "bin").alias("cut")).select(
        F.col("cut.bin"), (F.col("cut.budget") - F.col("cut.until") + F.col("cut.words")).alias("free"))
    inside = copies.join(F.broadcast(cut), time_range == F.col("bin")).groupBy("time", "free").agg(F.sum("size").alias("size"))
    parted = stored(inside.repartitionByRange("time").withColumn("part", F.spark_partition_id()), "inside")
    used = with_offsets(parted, "part", [F.col("time")], {"used": "size"})
    last = used.agg(F.min(F.when(F.col("used") + F.col("size") > F.col("free"), F.col("time"))).alias("stop"))
    taken = sum((F.when(t < F.coalesce(F.col("stop"), F.lit(float("inf"))), 1).otherwise(0) for t in rounds), F.lit(0))
    once = F.least(taken, F.when(F.col("size") == 0, F.lit(1)).otherwise(F.lit(repeats)))
    return queued.join(F.broadcast(last)).withColumn("copies", once.cast("int")).drop("stop", "before")


def mix(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The mixed documents: the input's columns and rows, each row as often as the mix takes it.

    The queue holds no texts; its counts are joined back by id, source, size and text hash. Rows equal in
    all four share their counts: a row for each count and how many of them take it, four at most. Only
    where these differ are equal rows numbered, by the partitions they stand in."""
    return around(docs, lambda own: _mix(own, weights, repeats))


def _mix(docs: DataFrame, weights, repeats: int) -> DataFrame:
    key = {"doc_id": F.col("doc_id"), "source": F.col("source"), "size": word_count(F.col("text")),
           "text_mark": F.xxhash64(F.col("text"))}
    names = list(key)
    dealt = fair_queue(docs.select(*[v.alias(k) for k, v in key.items()]), weights, repeats)
    each = dealt.groupBy(*names, "copies").agg(F.count("*").alias("rows"))
    counts = each.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("copies", "rows"))).alias("copies")) \
        .select(*[F.col(k).alias(f"_mix_{k}") for k in names], F.col("copies").alias("_mix_copies"))
    same = F.lit(True)
    for k, v in key.items():
        same = same & v.eqNullSafe(F.col(f"_mix_{k}"))
    joined = docs.join(counts, same)
    alike = joined.where(F.size("_mix_copies") == 1).withColumn("_mix_n", F.col("_mix_copies")[0]["copies"])
    mixed = stored(joined.where(F.size("_mix_copies") > 1).withColumns({"_mix_part": F.spark_partition_id(), "_mix_one": F.lit(1)}), "mixed")
    keyed = [f"_mix_{k}" for k in names]
    numbered = with_offsets(mixed, "_mix_part", [F.lit(0)], {"_mix_before": "_mix_one"}, within=keyed)
    # the first rows take the first count, and so on
    upto = F.aggregate("_mix_copies", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("n")), lambda at, c: F.struct(
        (at["seen"] + c["rows"]).alias("seen"), F.coalesce(at["n"], F.when(F.col("_mix_before") < at["seen"] + c["rows"], c["copies"])).alias("n")))
    dealt_out = numbered.withColumn("_mix_n", upto["n"]).drop("_mix_part", "_mix_one", "_mix_before")
    taken = alike.unionByName(dealt_out).where("_mix_n > 0")
    return taken.withColumn("_mix_round", F.explode(F.sequence(F.lit(1), F.col("_mix_n")))).select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dealt = fair_queue(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return dealt.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH sizes AS (
  SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), 'size ' || size)) AS mark FROM (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents)),
summed AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM summed),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (
      ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM weighed),
level AS (SELECT arg_max(level, open) AS level FROM levels WHERE level * weight <= cap),
targets AS (
  SELECT source, source_size, CASE WHEN (SELECT level FROM level) IS NULL OR cap <= (SELECT level FROM level) * weight
    THEN CAST(cap AS DOUBLE) ELSE (SELECT level FROM level) * weight END AS target FROM weighed),
queued AS (
  SELECT s.*, t.source_size, t.target,
    CAST(sum(size) OVER (PARTITION BY s.source ORDER BY mark, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS until
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT doc_id, size, (source_size * k + until) / nullif(target, 0) AS time FROM queued, range(3) r(k)),
used AS (SELECT time, sum(sum(size)) OVER (ORDER BY time) AS used FROM copies WHERE size > 0 AND time IS NOT NULL GROUP BY time),
stop AS (SELECT min(time) AS stop FROM used WHERE used > (SELECT sum(source_size) FROM targets))
SELECT doc_id, size, source_size, target,
  CAST(size * (SELECT count(*) FROM range(3) r(k)
    WHERE (source_size * k + until) / nullif(target, 0) < coalesce((SELECT stop FROM stop), 'inf'::DOUBLE)) AS BIGINT) AS taken
FROM queued
"""
