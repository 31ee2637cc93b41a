"""A mixture of sources with target shares of the total size, by pivotal dependent rounding.

Every document of a source should be used the same expected number of times: the source's target size over its own
size. The whole part of that number is certain; the fractions are settled in pairs. Of two open documents, mass
(fraction times size) is moved from one to the other until one of them is used or left out for good; which way is
drawn so that both keep their expectations. The mass moved is counted in tokens, so the source's total does not
change at all until its very last open document is rounded: the shares come out exact to one document.

Pairing goes on along a reduction tree: first within groups of about group_size documents, all pairs of a group at once,
then the pairs of those left open, until at most one document of the group is; then among the documents left open, group
by group of groups, until a source has a single one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.runtime import staged

_ROW = "source string, node bigint, doc_id bigint, n_tokens bigint, copies bigint, mass double"


#: The target is read by the driver, a row per source; more rows than this are refused.
MOST_SOURCES = 100_000


def pivot(size_a, mass_a, size_b, mass_b, draw):
    """Masses after one step, of numbers or arrays: their sum is kept, their expectations too, and one of them is 0 or the size."""
    up = np.minimum(size_a - mass_a, mass_b)  # a gains, b loses
    down = np.minimum(mass_a, size_b - mass_b)
    gains = draw * (up + down) < down
    a = np.where(gains, np.where(up == size_a - mass_a, size_a, mass_a + up), np.where(down == mass_a, 0.0, mass_a - down))
    b = np.where(gains, np.where(up == mass_b, 0.0, mass_b - up), np.where(down == size_b - mass_b, size_b, mass_b + down))
    return a, b


def _settle(seed: int, last: bool):
    """The documents of a node: settled ones with null mass, and at most one that is still open (none, if last).

    Open documents are paired with their neighbours, all pairs at once; those left open are paired again, and so on.
    """

    def over(key: tuple, rows: pa.Table) -> pa.Table:
        source, node = (k.as_py() for k in key)
        rows = rows.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending")])
        size, copies, mass = (rows[c].to_numpy() for c in ("n_tokens", "copies", "mass"))
        mass = mass.copy()
        rng = np.random.default_rng([seed, zlib.crc32(source.encode()), node])
        opened = np.flatnonzero((mass > 0) & (mass < size))
        while len(opened) > 1:
            pairs = len(opened) // 2
            one, two, odd = opened[0 : 2 * pairs : 2], opened[1 : 2 * pairs : 2], opened[2 * pairs :]
            mass[one], mass[two] = pivot(size[one], mass[one], size[two], mass[two], rng.random(pairs))
            opened = np.concatenate([one, two, odd])
            opened = np.sort(opened[(mass[opened] > 0) & (mass[opened] < size[opened])])
        if last and len(opened):  # the source's last open document
            mass[opened] = np.where(rng.random(1) * size[opened] < mass[opened], size[opened], 0.0)
        done = (mass <= 0) | (mass >= size)
        kept = rows.select(["source", "node", "doc_id", "n_tokens"])
        return kept.append_column("copies", pa.array(copies + (mass >= size))).append_column("mass", pa.array(mass, mask=done))

    return over


def _targets(target: DataFrame) -> DataFrame:
    return (
        target.where("source IS NOT NULL AND target_weight > 0 AND NOT isnan(target_weight)")
        .groupBy("source")
        .agg(F.max("target_weight").alias("target_weight"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))
    )


def plan(sizes: DataFrame, target: DataFrame, total_tokens: int | None = None) -> list[dict]:
    """Per source of the target: tokens, documents, budget (tokens to use) and rate (uses per document).

    Without total_tokens, the total is the largest at which every source that has documents can give its weight.
    With it, each source gives its weight of it or all it may. One row per source of the target is collected.
    """
    have = sizes.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    rows = [r.asDict() for r in _targets(target).join(have, "source", "left").limit(MOST_SOURCES + 1).collect()]
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"a target has at most {MOST_SOURCES} sources")
    for r in rows:
        r["tokens"], r["documents"] = r["tokens"] or 0, r["documents"] or 0
        r["most"] = r["tokens"] * r["max_repeats"]
    if total_tokens is None:
        total_tokens = min((r["most"] / r["target_weight"] for r in rows if r["most"]), default=0)
    for r in rows:
        r["budget"] = min(r["most"], r["target_weight"] * total_tokens)
        r["rate"] = r["budget"] / r["tokens"] if r["tokens"] else 0.0
    return rows


def mix(sizes: DataFrame, target: DataFrame, total_tokens: int | None = None, seed: int = 20250701, group_size: int = 20_000, fan_in: int = 256) -> DataFrame:
    """doc_id, source, n_tokens and copies (at least 1) of the documents of the mixture.

    sizes: doc_id, source, n_tokens; target: source, target_weight, max_repeats. Each source's tokens are within one
    document of its budget (see plan), no document is used more than max_repeats times, and the same input and seed
    give the same mixture whatever the partitioning. Defined results: documents without source, without tokens or of
    sources that are no target are not used; a target source without documents gets nothing, and the others keep
    their proportions to each other; null or non-positive weights count as no target; of repeated target rows the
    greatest weight and repeats count; null max_repeats is 1; empty tables give an empty mixture.
    """
    spark = sizes.sparkSession
    sizes = staged(sizes.select("doc_id", "source", "n_tokens"), "sizes")  # what made them is not made again for the plan and the levels
    plans = [p for p in plan(sizes, target, total_tokens) if p["rate"] > 0]
    rates = spark.createDataFrame([(p["source"], p["rate"], max(1, -(-p["documents"] // group_size))) for p in plans], "source string, rate double, nodes bigint")
    nodes = max((-(-p["documents"] // group_size) for p in plans), default=1)
    start = (
        sizes.where("n_tokens > 0")
        .select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.col("n_tokens").cast("bigint").alias("n_tokens"))
        .join(F.broadcast(rates), "source")  # one row per target source, of which there are at most MOST_SOURCES
        .select(
            "source",
            F.pmod(F.xxhash64("doc_id"), "nodes").alias("node"),
            "doc_id",
            "n_tokens",
            F.floor("rate").alias("copies"),
            ((F.col("rate") - F.floor("rate")) * F.col("n_tokens")).alias("mass"),
        )
    )
    settled, level = [], 0
    while True:
        last = nodes == 1
        rows = start.groupBy("source", "node").applyInArrow(_settle(seed + level, last), _ROW)
        done = staged(rows, f"mix-{level}")
        settled.append(done.where("mass IS NULL"))
        if last:
            break
        start = done.where("mass IS NOT NULL").withColumn("node", F.floor(F.col("node") / fan_in))
        nodes, level = -(-nodes // fan_in), level + 1
    result = settled[0]
    for more in settled[1:]:
        result = result.unionByName(more)
    return result.where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def shares(mixture: DataFrame, target: DataFrame) -> DataFrame:
    """Per target source: what was wanted and what was reached."""
    used = mixture.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies")
    )
    total = used.agg(F.sum("tokens")).scalar()
    return _targets(target).join(used, "source", "left").select(
        "source",
        "target_weight",
        "max_repeats",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "documents", "most_copies")),
        F.coalesce(F.col("tokens") / total, F.lit(0.0)).alias("share"),
    )
