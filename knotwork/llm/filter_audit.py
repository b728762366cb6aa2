"""Filter interaction audit by the Walsh-Hadamard transform, DataFrame functions only.

Every document has a mask with one bit for each filter that it fails. For each part of the
corpus and each pair of labels the scan keeps only signed sums, one for each set ``w`` of filters:
the documents that fail an even number of the filters in ``w`` minus those that fail an odd
number. With five filters that is 32 sums with map-side combine, whatever the input. The transform
is its own inverse up to a division by 32, which leaves no remainder, so the sums give the number
of documents of every mask exactly. Everything after that is arithmetic on 32 numbers a part:
what every filter removes at every step of every order, and the Shapley value. A document that
fails ``k`` filters is removed by each of them in ``1 / k`` of all orders, so a filter's value
summed over the ``n!`` orders is the sum of ``n! / k`` over the documents that fail it.

Duplicates are found over the whole table: a text is named by its sha256, names that occur once
are dropped by an aggregation, and the smallest id of each other name is joined back, hot names by
broadcast.

A null text is the empty text, and both are equal; a null source is the part of the empty string.
A row without an id is no duplicate and makes none; rows of one id and one text are no duplicates
of each other. Rows are counted one by one, repeated rows too. Several labels of an id count as
their maximum, and a missing or null one as 0. Words of any length and number are compared whole.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.operators.skew import lookup
from knotwork.storage import cut

WORD = r"[^\x20\x09-\x0D]+"
#: The letter of the filter that removes copies; its bit is set by a join and not by an expression.
COPY = "E"


def text_filters(text: Column, least_words: int = 200, least_distinct: int = 50, most_capitals: int = 2, symbols: str = "#$%&*|") -> dict[str, Column]:
    """The failure conditions of a single text: few words, repeated words, capitals, symbols.

    ``least_distinct`` and ``most_capitals`` are percentages of the words and of the code points.
    """
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < least_words,
        "B": 100 * F.size(F.array_distinct(words)) < least_distinct * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > most_capitals * F.char_length(text),
        "D": text.rlike("[" + "".join("\\" + c for c in symbols) + "]"),
    }


def _maximum(labels: DataFrame, id_col: str, names: tuple[str, str]) -> DataFrame:
    return labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c) for c in names))


def failure_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", filters: dict[str, Column] | None = None) -> DataFrame:
    """``(id, part, mask, quality, toxic, many)``: ``many`` equal rows, and the filters they fail.

    Bit ``k`` of the mask belongs to the k-th letter; the last one, for copies, is always there.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = text_filters(text) if filters is None else filters
    mask = sum((F.when(F.coalesce(f, F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(own.values())), F.lit(0))
    light = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("name"), mask.cast("int").alias("mask"))
    rows = cut(light.groupBy("id", "part", "name", "mask").agg(F.count("*").alias("many")))
    copies = cut(rows.groupBy("name").agg(F.min("id").alias("low"), F.count("*").alias("held")).where("held > 1"))
    most = copies.agg(F.max("held")).first()[0] or 0
    marked = lookup(rows, copies, ["name"], "held", rows.count(), most, how="left").withColumn(
        "mask", F.col("mask") + F.when(F.col("low") < F.col("id"), F.lit(1 << len(own))).otherwise(F.lit(0))
    ).select("id", "part", "mask", "many")
    known = marked.where("id is not null").join(_maximum(labels, id_col, ("quality", "toxic")), "id", "left")
    unknown = marked.where("id is null").select("*", F.lit(False).alias("quality"), F.lit(False).alias("toxic"))
    return known.unionByName(unknown).select("id", "part", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("quality", "toxic")), "many")


def parity_sums(masks: DataFrame, n: int) -> DataFrame:
    """``(part, quality, toxic, sums)``: for each set of the ``n`` filters the signed sum of the documents."""
    signed = lambda w: F.sum(F.when(F.bit_count(F.col("mask").bitwiseAND(w)) % 2 == 0, F.col("many")).otherwise(-F.col("many")))
    each = masks.groupBy("part", "quality", "toxic").agg(*(signed(w).alias(f"s{w}") for w in range(1 << n)))
    return each.select("part", "quality", "toxic", F.array(*(F.col(f"s{w}") for w in range(1 << n))).alias("sums"))


def mask_cells(sums: DataFrame, n: int) -> DataFrame:
    """``(part, quality, toxic, mask, many)``: the transform inverted, a row for each of the ``2 ** n`` masks."""
    inverse = F.expr(f"transform(sequence(0, {(1 << n) - 1}), m -> struct(m AS mask, aggregate(sequence(0, {(1 << n) - 1}), 0L, (a, w) -> a + sums[w] * (1 - 2 * (bit_count(m & w) % 2))) div {1 << n} AS many))")
    return sums.select("part", "quality", "toxic", F.explode(inverse).alias("c")).select("part", "quality", "toxic", "c.mask", "c.many")


def order_table(spark, letters: str) -> DataFrame:
    """``(filter_order, step, before, bit)``: the steps of all orders of the letters, with the mask of earlier filters."""
    rows = []
    for order in itertools.permutations(letters):
        before = 0
        for step, x in enumerate(order):
            bit = 1 << letters.index(x)
            rows.append(("".join(order), step + 1, before, bit))
            before |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, before int, bit int")


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order of the filters and step, from the documents of each mask.

    What a step does depends on its filter and the set of the filters before it, so it is worked out
    once for each such state (80 with five filters) and joined to the steps that reach it.
    """
    n = len(letters)
    every = math.factorial(n)
    whole = cells.groupBy("part", "mask").agg(F.sum("many").alias("docs"), F.sum(F.when(F.col("quality"), F.col("many")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("many")).otherwise(0)).alias("bad"))
    held = whole.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "docs", "good", "bad"))).alias("c"))
    states = held.withColumn("bit", F.explode(F.array(*(F.lit(1 << k) for k in range(n))))).withColumn("before", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1)))).where("before & bit = 0")

    def total(which: str, field: str = "docs", times: str = "1L") -> Column:
        return F.expr(f"aggregate(c, 0L, (a, x) -> a + if({which}, x.{field} * {times}, 0L))")

    fails, gone = "(x.mask & bit) <> 0", "(x.mask & before) <> 0"
    found = states.select(
        "part", "before", "bit", total(f"not ({fails}) and not ({gone})").alias("kept"), total(f"{fails} and not ({gone})").alias("removed"),
        total(f"{fails} and {gone}").alias("redundant"), total("x.mask = bit").alias("unique_fails"), total(f"{fails} and not ({gone})", "good").alias("good_lost"),
        total(f"{fails} and not ({gone})", "bad").alias("toxic_lost"), total(fails, times=f"({every} div bit_count(x.mask))").alias("shapley"),
    )
    steps = F.broadcast(order_table(cells.sparkSession, letters))
    return found.join(steps, ["before", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, **columns) -> DataFrame:
    """The audit of ``filters`` (five by default, with the one for copies last) over all documents.

    ``filters`` gives each letter a condition on the columns of ``docs``; the filter for copies is
    added with the letter ``E``. There are ``n!`` orders, so use few.
    """
    letters = "".join("ABCD" if filters is None else filters) + COPY
    masks = failure_masks(docs, labels, filters=filters, **columns)
    return audit(cut(mask_cells(parity_sums(masks, len(letters)), len(letters))), letters)


#: DuckDB SQL of the audit with its defaults over ``documents`` and ``labels``, by plain counting.
AUDIT_SQL = r"""
WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS low FROM d),
f AS (SELECT part, coalesce(quality, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS bad, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
             100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(low < w.doc_id, FALSE) AS e
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
g AS (SELECT part, good, bad, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS m),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.m, q.m, r.m, s.m, t.m] AS bits FROM x p, x q, x r, x s, x t
      WHERE p.m + q.m + r.m + s.m + t.m = 31 AND len(list_distinct([p.m, q.m, r.m, s.m, t.m])) = 5),
k AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
y AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 AND bad THEN n ELSE 0 END) AS toxic_lost
      FROM g, k GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM y
"""
