"""Merkle dataset manifest by superblock reduction, with a proof of every row.

Rows are leaves. The leaves of a part (say, a language) are in order of id and hashed in runs of
``FAN`` until one node, the part's root, is left; the roots of all parts, in order of their names,
are hashed in the same way to the root of the dataset. A row's proof is, level by level, what
stands to the left and to the right of its node in its run, so anybody can fold a leaf up to the
root with ``folded``, a plain column expression.

Leaves are numbered without a task that holds a part: ranges of (part, id, leaf) are partitions,
each numbers its rows, and only the partitions' sizes are summed. Then a round buckets the
numbers by ``FAN ** LEVELS`` and ``applyInPandas`` collapses that many levels of a bucket at once, so
every shuffle shrinks the table ``FAN ** LEVELS`` times and no group is larger, however hot its part.
Proofs go down the same way: a bucket works out its own levels again from its nodes, which
is cheaper than sending them, and appends what is above its root.

Equal rows are one row with a count until they are numbered; in a tie of ids the smaller leaf comes
first. A null in any column is hashed as ``-``, a null id comes first and a null part is a part of its
own that comes first. A run of one node is hashed too, but a part of one leaf is its own root, and an
empty table has no rows and no root. Texts are hashed whole. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from knotwork.functions.ranks import ranked
from knotwork.operators.skew import lookup
from knotwork.storage import cut, partitions

FAN, LEVELS = 8, 3
#: Copies of one row that a task numbers at once.
COPIES = 1 << 16


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """Lowercase hex sha256 of some fields."""
    return F.sha2(F.concat(*(field(v) for v in values)).cast("binary"), 256)


def folded(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""
    return F.aggregate(F.arrays_zip(lefts.alias("left"), rights.alias("right")), leaf, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]).cast("binary"), 256))


def proof_digest(lefts: Column, rights: Column) -> Column:
    """sha256 of all siblings of a proof, level by level and left to right."""
    return F.sha2(F.array_join(F.zip_with(lefts, rights, lambda a, b: F.concat(a, b)), "").cast("binary"), 256)


def _levels(nodes: list[str], n: int, fan: int, levels: int) -> list[list[str]]:
    """A bucket's nodes and the levels above them: ``levels`` of them, fewer if the bucket is the whole tree of ``n`` nodes."""
    out = [nodes]
    while len(out[-1]) > 1 if n <= fan**levels else len(out) <= levels:
        low = out[-1]
        out.append([hashlib.sha256("".join(low[i : i + fan]).encode()).hexdigest() for i in range(0, len(low), fan)])
    return out


def _raise(tree: DataFrame, fan: int, levels: int) -> DataFrame:
    """``tree(g, place, n, node)`` reduced by ``levels`` levels; ``n`` is the number of nodes of the group ``g``."""
    wide = fan**levels

    def run(key, pdf):
        pdf = pdf.sort_values("place")
        n = int(pdf["n"].iloc[0])
        top = _levels(pdf["node"].tolist(), n, fan, levels)[-1][0]
        return pd.DataFrame({"g": [key[0]], "place": [key[1]], "n": [-(-n // wide)], "node": [top]})

    return tree.select("g", "place", "n", "node", F.floor(F.col("place") / wide).alias("bucket")).groupBy("g", "bucket").applyInPandas(run, "g long, place long, n long, node string")


def _lower(tree: DataFrame, above: DataFrame, fan: int, levels: int) -> DataFrame:
    """``tree`` with ``(lefts, rights, subroot, root)``, from those of the bucket roots ``above(g, place, ...)``."""
    wide = fan**levels
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in tree.schema)}, lefts array<string>, rights array<string>, subroot string, root string"

    def run(key, here, top):
        here = here.drop_columns(["bucket"]).sort_by("place")
        m, left, right = here.num_rows, [], []
        for low in _levels(here.column("node").to_pylist(), here.column("n")[0].as_py(), fan, levels)[:-1] if m else []:
            left.append(["".join(low[i - i % fan : i]) for i in range(len(low))])
            right.append(["".join(low[i + 1 : i - i % fan + fan]) for i in range(len(low))])
        upper = {c: top.column(c)[0].as_py() for c in ("lefts", "rights", "subroot", "root")}
        for c, side in (("lefts", left), ("rights", right)):
            here = here.append_column(c, pa.array([[x[i // fan**k] for k, x in enumerate(side)] + upper[c] for i in range(m)], pa.list_(pa.string())))
        for c in ("subroot", "root"):
            here = here.append_column(c, pa.array([upper[c]] * m, pa.string()))
        return here

    here = tree.withColumn("bucket", F.floor(F.col("place") / wide)).groupBy("g", "bucket")
    return here.cogroup(above.select("g", F.col("place").alias("bucket"), "lefts", "rights", "subroot", "root").groupBy("g", "bucket")).applyInArrow(run, schema)


def _rounds(tree: DataFrame, largest: int, fan: int, levels: int) -> list[DataFrame]:
    """``tree`` and its reductions, the last with one node for each group."""
    out = [tree]
    while largest > 1:
        out.append(cut(_raise(out[-1], fan, levels)))
        largest = -(-largest // fan**levels)
    return out


def numbered(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``leaves(part, id, leaf, ..., many)`` as ``(g, place, n, node, id, ...)``, a row for each copy, and the parts ``(g, part, n)``.

    ``part`` is a string, null for the part without a name. Places count from 0 within a part in
    order of id and leaf.
    """
    spark, rest = leaves.sparkSession, [c for c in leaves.columns if c not in ("part", "id", "leaf", "many")]
    # a name that is never null and keeps the order: without a name comes first
    held = leaves.withColumn("part", F.coalesce(F.concat(F.lit("="), "part"), F.lit("")))
    held = cut(held.repartitionByRange(partitions(spark), "part", "id", "leaf").withColumn("at", F.spark_partition_id()))
    sizes = cut(held.groupBy("part", "at").agg(F.sum("many").alias("many"), F.count("*").alias("rows")))
    parts = cut(ranked(sizes.groupBy("part").agg(F.sum("many").alias("n")), "part", "g"))
    # a row for each part in each partition: no more than partitions and parts together
    before = sizes.withColumn("before", F.coalesce(F.sum("many").over(W.partitionBy("part").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    offsets = cut(before.join(parts, "part").select("part", "at", "before", "g", "n", "rows"))
    within = W.partitionBy("part", "at").orderBy("id", "leaf", *rest).rowsBetween(W.unboundedPreceding, -1)
    inner = held.withColumn("inner", F.coalesce(F.sum("many").over(within), F.lit(0)))
    total, most = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("rows"), F.lit(0))).first()
    placed = lookup(inner, offsets, ["part", "at"], "rows", total, most).select("g", (F.col("before") + F.col("inner")).alias("place"), "n", F.col("leaf").alias("node"), "id", *rest, "many")
    few, many = placed.where(F.col("many") <= COPIES), placed.where(F.col("many") > COPIES)
    blocks = many.withColumn("block", F.explode(F.expr(f"sequence(0L, (many - 1) div {COPIES})"))).repartition("g", "place", "block")
    blocks = blocks.withColumn("place", F.col("place") + F.col("block") * COPIES).withColumn("many", F.least(F.lit(COPIES).cast("long"), F.col("many") - F.col("block") * COPIES)).drop("block")
    copies = few.unionByName(blocks).withColumn("copy", F.explode(F.expr("sequence(0L, many - 1)")))
    names = parts.select("g", F.when(F.col("part") != "", F.expr("substring(part, 2)")).alias("part"), "n")
    return copies.select("g", (F.col("place") + F.col("copy")).alias("place"), "n", "node", "id", *rest), names


def merkle(docs: DataFrame, leaf: Column, id_col: str = "doc_id", part_col: str = "lang", carried: dict[str, Column] | None = None, fan: int = FAN, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """The proofs ``(id, part number g, place, leaf, lefts, rights, subroot, root, ...)``, a row for each row
    of ``docs``, and the manifest ``(part, n, subroot, root)``.

    ``carried`` columns are worked out in the scan, as leaves are, and come with the proofs.
    """
    extra = carried or {}
    light = docs.select(F.col(part_col).cast("string").alias("part"), F.col(id_col).alias("id"), leaf.alias("leaf"), *(x.alias(c) for c, x in extra.items()))
    tree, parts = numbered(light.groupBy(*light.columns).agg(F.count("*").alias("many")))
    tree = cut(tree)
    count, largest = parts.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    rounds = _rounds(tree, largest, fan, levels)
    # the parts' roots are the leaves of one more tree, whose root is its own proof's end
    roots = cut(rounds[-1].select(F.lit(0).cast("long").alias("g"), F.col("g").alias("place"), F.lit(count).cast("long").alias("n"), "node"))
    above = _rounds(roots, count, fan, levels)
    none = F.array().cast("array<string>")
    proof = above[-1].select("g", "place", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    for low in reversed(above[:-1]):
        proof = cut(_lower(low, proof, fan, levels).drop("n"))
    if len(above) == 1:
        proof = proof.withColumn("node", F.col("root"))
    proof = proof.select(F.col("place").alias("g"), F.lit(0).cast("long").alias("place"), "lefts", "rights", F.col("node").alias("subroot"), "root")
    manifest = cut(parts.join(proof.select("g", "subroot", "root"), "g").select("part", "n", "subroot", "root"))
    for low in reversed(rounds[1:-1]):
        proof = cut(_lower(low, proof, fan, levels))
    if len(rounds) > 1:
        proof = _lower(tree, proof, fan, levels)
    else:
        proof = tree.join(proof.drop("place"), "g")
    return proof.select("id", "g", "place", F.col("node").alias("leaf"), "lefts", "rights", "subroot", "root", *extra), manifest


#: DuckDB SQL of the query over ``documents``: plain levels of runs of eight, with crc32 bit by bit.
MERKLE_SQL = """
WITH RECURSIVE f AS (SELECT doc_id, lang, text, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END AS a, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END AS b,
  CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS c, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS d FROM documents),
r AS (SELECT doc_id, lang, sha256(a || b || c || d || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
  sha256(a || b || c || d || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) AS lower_leaf,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda h, x: list_reduce(list_prepend(xor(h, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295::BIGINT) AS crc FROM f),
l AS (SELECT *, coalesce(crc % 3 = 0, FALSE) AS hit, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM r),
t AS (SELECT 0 AS h, g, i, n, leaf AS node FROM l
  UNION ALL SELECT h + 1, g, i // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY h, g, i // 8, n),
s AS (SELECT h, g, node AS subroot, count(*) OVER () AS parts FROM t WHERE n = 1),
u AS (SELECT 0 AS h, g AS i, parts AS n, subroot AS node FROM s
  UNION ALL SELECT h + 1, i // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY h, i // 8, n),
tx AS (SELECT x.h, x.g, x.i, coalesce(string_agg(y.node, '' ORDER BY y.i) FILTER (WHERE y.i < x.i), '') AS a, coalesce(string_agg(y.node, '' ORDER BY y.i) FILTER (WHERE y.i > x.i), '') AS b
  FROM t x JOIN t y ON x.h = y.h AND x.g = y.g AND x.i // 8 = y.i // 8 WHERE x.n > 1 GROUP BY 1, 2, 3),
ux AS (SELECT x.h, x.i, coalesce(string_agg(y.node, '' ORDER BY y.i) FILTER (WHERE y.i < x.i), '') AS a, coalesce(string_agg(y.node, '' ORDER BY y.i) FILTER (WHERE y.i > x.i), '') AS b
  FROM u x JOIN u y ON x.h = y.h AND x.i // 8 = y.i // 8 WHERE x.n > 1 GROUP BY 1, 2),
p AS (SELECT l.g, l.i, tx.h AS h, tx.a, tx.b FROM l JOIN tx ON tx.g = l.g AND tx.i = l.i // CAST(8 ** tx.h AS BIGINT)
  UNION ALL SELECT l.g, l.i, s.h + ux.h, ux.a, ux.b FROM l JOIN s ON s.g = l.g JOIN ux ON ux.i = l.g // CAST(8 ** ux.h AS BIGINT)),
z AS (SELECT g, i, 0 AS h, CASE WHEN hit THEN lower_leaf ELSE leaf END AS node FROM l
  UNION ALL SELECT z.g, z.i, z.h + 1, sha256(p.a || z.node || p.b) FROM z JOIN p ON p.g = z.g AND p.i = z.i AND p.h = z.h),
e AS (SELECT g, i, max_by(node, h) AS folded FROM z GROUP BY 1, 2),
q AS (SELECT g, i, sha256(string_agg(a || b, '' ORDER BY h)) AS proof FROM p GROUP BY 1, 2),
top AS (SELECT node AS root FROM u WHERE n = 1)
SELECT l.doc_id, l.leaf, s.subroot, top.root, coalesce(q.proof, sha256('')) AS proof_sha256, e.folded AS folded_root, e.folded = top.root AS verified
FROM l JOIN s ON s.g = l.g JOIN e ON e.g = l.g AND e.i = l.i LEFT JOIN q ON q.g = l.g AND q.i = l.i, top
"""
