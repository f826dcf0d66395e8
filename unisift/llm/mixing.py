"""Operator 2: mixing sources to target weights by Poisson replication, in DataFrame operations only.

Every source named in `weights` is a component; all others, null too, form the component `"*"` (weight 0 if it isn't
named, which asks for none of its rows). A component's rate is weight / sum of weights * target size / size of the
component, where sizes are sums of `size` (1 a document, or a column of sizes) and the target is the size of all
components together unless given. A document appears Poisson(rate) times: a uniform number from an MD5 of seed and id
is looked up in the distribution's inverse. A rate above `SPLIT` is the sum of equal parts of at most `SPLIT`, each
with its own draw, so tables stay short at any rate. Copies are then dealt by a hash of seed, id and copy and sorted
by it within partitions: a global shuffle.

The table of rates has one row per component, so at most len(weights) + 1; it alone is broadcast. A hot source needs
no care: rows are dealt by the hash of id and copy, never by source.

Nulls: a null id draws as the word "null"; rows that share an id share their draws, each row is replicated alike; a
null or negative size counts 0; a component without size has no rows to draw from, or rate 0. An empty table gives
an empty result. All columns pass through; `mix_copy` and `mix_key` replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest rate of one draw.
SPLIT = 64
#: Entries of the inverse table beyond the rate: the chance of more is below 2**-53 for rates up to SPLIT.
BEYOND = 128


def _uniform(*parts: Column) -> Column:
    """52 bits of an MD5 of the parts joined by "|", in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(documents: DataFrame, weights: dict[str, float], target: float | None = None, source_column: str = "source", size: Column | None = None) -> DataFrame:
    """component, parts, inverse (cumulative probabilities of 0, 1, ... for rate / parts); one row per component with rows."""
    total = sum(weights.values())
    share = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]) / total)))[F.col("component")], F.lit(0.0))
    sized = documents.select(component(F.col(source_column), weights).alias("component"), F.greatest(F.coalesce(F.lit(1) if size is None else size, F.lit(0)), F.lit(0)).cast("long").alias("size"))
    sums = sized.groupBy("component").agg(F.sum("size").alias("size"))
    everything = Window.partitionBy(F.lit(0))  # at most len(weights) + 1 rows
    aim = F.sum("size").over(everything).cast("double") if target is None else F.lit(float(target))
    rated = sums.withColumn("rate", F.when(F.col("size") > 0, share * aim / F.col("size")).otherwise(F.lit(0.0)))
    rated = rated.withColumn("parts", F.greatest(F.ceil(F.col("rate") / SPLIT), F.lit(1)).cast("long")).withColumn("rate", F.col("rate") / F.col("parts"))
    terms = rated.select("component", "parts", "rate", F.explode(F.sequence(F.lit(0), F.lit(SPLIT + BEYOND))).alias("k"))
    up_to = Window.partitionBy("component").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log = F.sum(F.when(F.col("k") == 0, -F.col("rate")).otherwise(F.ln(F.col("rate") / F.col("k")))).over(up_to)
    terms = terms.withColumn("p", F.when(F.col("rate") > 0, F.exp(log)).otherwise(F.when(F.col("k") == 0, 1.0).otherwise(0.0)))
    terms = terms.withColumn("below", F.sum("p").over(up_to))
    return terms.groupBy("component", "parts").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "below"))), lambda x: x["below"]).alias("inverse"))


def component(source: Column, weights: dict[str, float]) -> Column:
    source = source.cast("string")
    return F.when(source.isin([w for w in weights if w != "*"]), source).otherwise(F.lit("*"))


def mix(documents: DataFrame, weights: dict[str, float], seed: int = 0, target: float | None = None, source_column: str = "source", size: Column | None = None, id_column: str = "doc_id") -> DataFrame:
    """The documents' columns, `mix_copy` (from 0) and `mix_key` (in [0, 1), the order of the shuffle)."""
    table = rates(documents, weights, target, source_column, size)
    rows = documents.select(F.struct(*(c for c in documents.columns if c not in ("mix_copy", "mix_key"))).alias("row"))
    key = F.coalesce(F.col(f"row.{id_column}").cast("string"), F.lit("null"))
    rows = rows.withColumn("component", component(F.col(f"row.{source_column}"), weights)).join(F.broadcast(table), "component")
    rows = rows.select("row", "inverse", key.alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    rows = rows.withColumn("draw", _uniform(F.lit(str(seed)), "key", F.col("part").cast("string")))
    rows = rows.withColumn("n", F.size(F.filter("inverse", lambda c: c <= F.col("draw")))).where("n > 0")
    copies = rows.select("row", "key", "part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    copies = copies.select("row", "key", (F.col("part") * (SPLIT + BEYOND + 1) + F.col("copy")).alias("mix_copy"))
    copies = copies.withColumn("mix_key", _uniform(F.lit("order"), F.lit(str(seed)), "key", F.col("mix_copy").cast("string")))
    return copies.repartition("mix_key").sortWithinPartitions("mix_key").select("row.*", "mix_copy", "mix_key")


def mix_sql(weights: dict[str, float], seed: int, size: str, columns: str) -> str:
    """The same as SQL for DuckDB over `documents`."""
    total = sum(weights.values())
    named = ", ".join(f"'{w}'" for w in weights if w != "*")
    shares = " ".join(f"WHEN '{w}' THEN {float(v) / total!r}::DOUBLE" for w, v in weights.items())
    return f"""
WITH docs AS (SELECT *, CASE WHEN source IN ({named}) THEN source ELSE '*' END AS component FROM documents),
sums AS (SELECT component, sum(greatest(coalesce({size}, 0), 0))::BIGINT AS size FROM docs GROUP BY component),
rated AS (SELECT component, CASE WHEN size > 0 THEN (CASE component {shares} ELSE 0.0::DOUBLE END) * (SELECT sum(size) FROM sums)::DOUBLE / size ELSE 0.0::DOUBLE END AS rate FROM sums),
parted AS (SELECT component, greatest(ceil(rate / {SPLIT}), 1)::BIGINT AS parts, rate / greatest(ceil(rate / {SPLIT}), 1) AS rate FROM rated),
terms AS (SELECT component, parts, rate, k, sum(CASE WHEN k = 0 THEN -rate WHEN rate > 0 THEN ln(rate / k) END) OVER (PARTITION BY component ORDER BY k ROWS UNBOUNDED PRECEDING) AS lp
          FROM parted, range(0, {SPLIT + BEYOND + 1}) r(k)),
inverse AS (SELECT component, parts, k, sum(CASE WHEN rate > 0 THEN exp(lp) WHEN k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY component ORDER BY k ROWS UNBOUNDED PRECEDING) AS below FROM terms),
lists AS (SELECT component, parts, list(below ORDER BY k) AS inverse FROM inverse GROUP BY component, parts),
parts AS (SELECT d.*, inverse, unnest(range(0, parts)) AS part FROM docs d JOIN lists USING (component)),
draws AS (SELECT *, ('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || part::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw FROM parts),
counted AS (SELECT *, len(list_filter(inverse, lambda c: c <= draw)) AS n FROM draws),
copies AS (SELECT *, part * {SPLIT + BEYOND + 1} + unnest(range(0, n)) AS mix_copy FROM counted WHERE n > 0)
SELECT {columns}, mix_copy::BIGINT AS mix_copy,
       ('0x' || substr(md5('order|{seed}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || mix_copy::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS mix_key
FROM copies"""
