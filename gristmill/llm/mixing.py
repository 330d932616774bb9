"""Mixing sources to target weights by exponential keys.

Sources in code-point order (null last) weigh 5, 2, 1, repeating.  Together they get ``share`` times all words; a
source's target stops at ``most`` times its words and the excess goes to the others by weight until none is above:
with a common level L the targets are ``min(L * weight, most * size)``, so L follows from the sources sorted by
``most * size / weight`` and their running totals.

Within a source a document's key is ``-ln(u) / q`` (Efraimidis and Spirakis), u a hash of its id in (0, 1) and q its
quality weight, so that a prefix in key order is a weighted sample without replacement.  A target first takes complete
epochs of its source; what is left is filled from the front of the order as long as whole documents fit, then once
more from the documents behind that are no larger than the gap (else one long document would leave it open), and closed
with the one later document whose size is nearest to the gap, if it makes the gap smaller.

Ids that occur more than once and null ids are ordered by their texts' hash.  Equal rows are told apart by a number
they get in the staged table.

Defined results: a null text has size 0; sources without words get target 0; every row of the table is returned, with
``taken`` 0 where the mix leaves it out; reruns agree, as nothing depends on how rows are dealt to tasks (among equal
rows, which one is taken first is not defined and doesn't show).  Further columns are ignored by ``mix`` and kept by
``mixed``, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import running_sum
from gristmill.session import stage

# The weights that sources take in turn.
WEIGHTS = (5, 2, 1)

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))


def quality_weight(text: Column) -> Column:
    """From 0.1 to 1.1: the share of characters that are neither digits nor ASCII punctuation."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(F.regexp_replace(text, r"[!-@\[-`{-~]+", ""))
    return F.lit(0.1) + F.when(F.length(text) > 0, plain / F.length(text)).otherwise(F.lit(0.0))


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1) from the md5 of an id, the same in any engine."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, share: float, most: float) -> DataFrame:
    """``source``, ``source_size``, ``target`` from one row a source.

    The table has a row for each source, not for each document; ranks and running totals over it are taken by ranges.
    """
    named = sizes.withColumn("_null", F.col("source").isNull().cast("int")).withColumn("_all", F.lit(1)).withColumn("_one", F.lit(1))
    ranked = running_sum(named, "_all", ["_null", "source"], "_one", "_nth")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("_nth") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = ranked.withColumn("_weight", weight.cast("long")).withColumn("_ratio", F.lit(most) * F.col("source_size") / F.col("_weight"))
    ranked = running_sum(ranked, "_all", ["_ratio", "_nth"], "source_size", "_size_to")
    ranked = running_sum(ranked, "_all", ["_ratio", "_nth"], "_weight", "_weight_to")
    # Four numbers of the whole table decide the level.
    size_all, weight_all = (x or 0 for x in ranked.agg(F.sum("source_size"), F.sum("_weight")).first())
    # A source is full if its own level, with all sources up to it full, asks for no more than there is.
    asked = F.lit(most) * F.col("_size_to") + F.col("_ratio") * (F.lit(weight_all) - F.col("_weight_to"))
    marked = ranked.withColumn("_full", asked <= F.lit(share * size_all))
    size_full, weight_full = (x or 0 for x in marked.where("_full").agg(F.max("_size_to"), F.max("_weight_to")).first())
    level = (share * size_all - most * size_full) / (weight_all - weight_full) if weight_all > weight_full else 0.0
    target = F.when(F.col("_full"), F.lit(most) * F.col("source_size")).otherwise(F.lit(level) * F.col("_weight"))
    return marked.select("source", "source_size", F.least(target, F.lit(most) * F.col("source_size")).alias("target"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
    / (0.1 + CASE WHEN length(text) > 0
       THEN length(regexp_replace(text, '[!-@\[-`{-~]+', '', 'g'))::DOUBLE / length(text) ELSE 0.0 END) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM s),
w AS (SELECT *, CASE nth % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS weight FROM n),
r AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio FROM w),
c AS (
  SELECT *, sum(source_size) OVER o AS size_to, sum(weight) OVER o AS weight_to,
    sum(source_size) OVER () AS size_all, sum(weight) OVER () AS weight_all
  FROM r WINDOW o AS (ORDER BY ratio, nth ROWS UNBOUNDED PRECEDING)),
f AS (
  SELECT *, 2.0::DOUBLE * size_to + ratio * (weight_all - weight_to)::DOUBLE <= 1.5::DOUBLE * size_all AS is_full FROM c),
g AS (
  SELECT *, coalesce(max(CASE WHEN is_full THEN size_to END) OVER (), 0) AS size_full,
    coalesce(max(CASE WHEN is_full THEN weight_to END) OVER (), 0) AS weight_full FROM f),
t AS (
  SELECT source, source_size, least(CASE WHEN is_full THEN 2.0::DOUBLE * source_size ELSE
    (1.5::DOUBLE * size_all - 2.0::DOUBLE * size_full) / nullif(weight_all - weight_full, 0)::DOUBLE * weight END,
    2.0::DOUBLE * source_size) AS target FROM g),
x AS (
  SELECT d.doc_id, d.source, d.size, d.k, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS UNBOUNDED PRECEDING) AS size_to
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
l AS (SELECT *, target - epochs * source_size AS gap, size_to <= target - epochs * source_size AS fits FROM x),
p AS (SELECT * REPLACE (gap - sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap) FROM l),
q AS (SELECT *, CASE WHEN NOT fits AND size <= gap THEN size ELSE 0 END AS free FROM p),
u AS (SELECT *, free > 0 AND sum(free) OVER (PARTITION BY source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) <= gap AS more FROM q),
v AS (
  SELECT * REPLACE (gap - sum(CASE WHEN more THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap, fits OR more AS fits) FROM u),
o AS (
  SELECT *, NOT fits AND abs(gap - size) < gap AS closes FROM v),
e AS (
  SELECT *, closes AND row_number() OVER (PARTITION BY source, closes ORDER BY abs(gap - size), k, doc_id) = 1 AS closing FROM o)
SELECT doc_id, source, size, source_size, target,
  (size * (epochs + CASE WHEN fits OR closing THEN 1 ELSE 0 END))::BIGINT AS taken FROM e
"""


ORDER = ["_key", "_id", "_code"]


def _described(docs: DataFrame) -> DataFrame:
    """What the mix knows of a row: its size and its place in the order of its source, both from the row alone."""
    return docs.withColumns(
        {
            "size": word_count(F.col("text")).cast("long"),
            "_key": -F.log(uniform(F.col("doc_id"))) / quality_weight(F.col("text")),
            "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")),
            "_code": F.xxhash64("text"),
        }
    )


def _decided(docs: DataFrame, share: float, most: float) -> DataFrame:
    """A light row for each document with its source's ``_epochs`` and whether the first fill (``_in``), the second
    (``_more``, of sizes up to ``_limit``) or the closing (``_closes``) takes it once more."""
    light = _described(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size", *ORDER)
    light = stage(light.withColumn("_row", F.monotonically_increasing_id()), "sizes")
    per_source = targets(stage(light.groupBy("source").agg(F.sum("size").alias("source_size")), "sources"), share, most)
    per_source = stage(per_source, "targets").withColumnRenamed("source", "_source")
    order = [*ORDER, "_row"]
    summed = running_sum(light, "source", order, "size", "_to")
    joined = summed.join(per_source, F.col("source").eqNullSafe(F.col("_source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    joined = joined.withColumn("_epochs", epochs.cast("long"))
    joined = joined.withColumn("_gap", F.col("target") - F.col("_epochs") * F.col("source_size"))
    joined = _less(joined.withColumn("_in", F.col("_to") <= F.col("_gap")), "_in").withColumn("_limit", F.col("_gap"))
    joined = joined.withColumn("_open", F.when(~F.col("_in") & (F.col("size") <= F.col("_gap")), F.col("size")).otherwise(F.lit(0)))
    joined = running_sum(joined.drop("_to"), "source", order, "_open", "_to")
    more = (F.col("_open") > 0) & (F.col("_to") <= F.col("_gap"))
    joined = stage(_less(joined.withColumn("_more", more), "_more"), "fills")
    off = F.abs(F.col("_gap") - F.col("size"))
    nearest = F.struct(off.alias("off"), *(F.col(c) for c in order))
    taken = F.col("_in") | F.col("_more")
    last = joined.where(~taken & (off < F.col("_gap"))).groupBy("_source").agg(F.min(nearest).alias("_last"))
    last = last.select(F.col("_source").alias("_of"), F.col("_last._row").alias("_closing"))
    joined = joined.join(last, F.col("_source").eqNullSafe(F.col("_of")), "left")
    return joined.withColumn("_closes", F.coalesce(F.col("_row") == F.col("_closing"), F.lit(False)))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken`` (words); texts are read once and don't travel."""
    once = F.col("_in") | F.col("_more") | F.col("_closes")
    taken = F.col("size") * (F.col("_epochs") + F.when(once, 1).otherwise(0))
    return _decided(docs, share, most).select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it.

    A source's decision is a few places in its order, so there is one row a source and texts stay where they are.
    Rows equal in id and text have one place and share its decision.
    """
    place = F.struct(*(F.col(c) for c in ORDER))
    rules = _decided(docs, share, most).groupBy(F.col("source").alias("_source")).agg(
        F.max("_epochs").alias("_epochs"), F.max("_limit").alias("_limit"), F.max(F.when(F.col("_in"), place)).alias("_first"),
        F.max(F.when(F.col("_more"), place)).alias("_second"), F.max(F.when(F.col("_closes"), place)).alias("_closing"),
    )
    rows = _described(docs.select("doc_id", "source", "text", F.struct("*").alias("_whole"))).withColumn("_place", place)
    rows = rows.join(stage(rules, "rules"), F.col("source").eqNullSafe(F.col("_source")))
    no = F.lit(False)
    once = (
        F.coalesce(F.col("_place") <= F.col("_first"), no)
        | (F.coalesce(F.col("_place") <= F.col("_second"), no) & (F.col("size") <= F.col("_limit")) & (F.col("size") > 0))
        | F.coalesce(F.col("_place") == F.col("_closing"), no)
    )
    times = F.col("_epochs") + F.when(once, 1).otherwise(0)
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1))))).where(F.col("_copy") <= times)
    return rows.select("_whole.*")


def _less(rows: DataFrame, taken: str) -> DataFrame:
    """``_gap`` without what the rows marked ``taken`` have filled, for each source."""
    used = rows.groupBy("_source").agg(F.sum(F.when(F.col(taken), F.col("size")).otherwise(F.lit(0))).alias("_used"))
    used = used.select(F.col("_source").alias("_of"), "_used")
    joined = rows.join(used, F.col("_source").eqNullSafe(F.col("_of"))).withColumn("_gap", F.col("_gap") - F.col("_used"))
    return joined.drop("_of", "_used")

