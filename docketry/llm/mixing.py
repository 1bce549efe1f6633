"""Mixing sources to target weights by balanced sampling (cube method, Deville and Tille, 2004)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.llm.common import begin, landed, view, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all sizes
CEILING = 2.0  # of a source's, and of a document's, own size
BLOCK = 4096  # documents whose fractions are moved together
# given tells a null id, which is 0 inside: a null among them would make pandas turn all ids into doubles
ROWS = "key string, block long, row long, id long, given boolean, size long, psi double, base long, target double, source_size long"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """``(key, source_size, n, target)`` per source.

    Weights go round the sources in code-point order, a missing source last.
    The fill level solves sum(min(ceiling * size, level * weight)) = share * all
    sizes: sources are taken by ceiling over weight, and the first whose ceiling
    is above the level that is left fixes it. The windows run over one row per
    source.
    """
    per = sizes.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    turn = F.pmod(F.row_number().over(Window.orderBy("last", "key")) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    per = per.withColumn("last", F.col("key") == "n").withColumn("weight", weight)
    per = per.withColumn("top", ceiling * F.col("source_size"))
    order = Window.orderBy(F.col("top") / F.col("weight"), "key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("top").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / weights_left)
    open_level = F.when(F.col("top") >= F.col("level") * F.col("weight"), F.col("level"))
    per = per.withColumn("fill", F.max(open_level).over(everything))
    target = F.least(F.col("top"), F.coalesce(F.col("fill") * F.col("weight"), F.col("top")))
    return per.select("key", "source_size", "n", target.alias("target"))


def flight(sizes: list[int], psi: list[float], draws: list[float]) -> list[float]:
    """Move fractions along the null space of (size, 1) until at most two are left.

    Three open units span a direction that keeps both the words and the
    documents expected; a step goes to the nearer or farther wall with the odds
    that keep every expectation, and closes one unit at least.
    """
    psi = list(psi)
    pool: list[int] = []
    for i in range(len(psi)):
        if not 0.0 < psi[i] < 1.0:
            continue
        pool.append(i)
        while len(pool) == 3:
            a, b, c = pool
            u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if not any(u):
                u = (1, -1, 0)
            ahead = behind = float("inf")
            for k, d in zip(pool, u):
                if d:
                    up, down = ((1 - psi[k]) / d, psi[k] / d) if d > 0 else (psi[k] / -d, (1 - psi[k]) / -d)
                    ahead, behind = min(ahead, up), min(behind, down)
            go = ahead if draws[i] * (ahead + behind) < behind else -behind
            for k, d in zip(pool, u):
                x = psi[k] + go * d
                psi[k] = 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
            pool = [k for k in pool if 0.0 < psi[k] < 1.0]
    return psi


def land(sizes: list[int], psi: list[float]) -> list[float]:
    """Close the last units: of all ways, the one whose words, then documents, miss least."""
    rest = [i for i, p in enumerate(psi) if 0.0 < p < 1.0]
    ways = [[(w >> j) & 1 for j in range(len(rest))] for w in range(1 << len(rest))]

    def misses(way):
        words = sum(sizes[i] * (z - psi[i]) for i, z in zip(rest, way))
        return abs(words), abs(sum(z - psi[i] for i, z in zip(rest, way))), way

    out = list(psi)
    for i, z in zip(rest, min(ways, key=misses)):
        out[i] = float(z)
    return out


def _moved(last: bool):
    def move(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["row", "given", "id", "size"], kind="stable")
        draws = ((rows["row"].to_numpy() & 0xFFFFFFFF) + 0.5) / 4294967296.0
        sizes = rows["size"].tolist()
        psi = flight(sizes, rows["psi"].tolist(), draws.tolist())
        return rows.assign(psi=land(sizes, psi) if last else psi)

    return move


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING, seed: int = 17) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row.

    A source is taken ``target / source_size`` times: the whole part falls on
    every document, the fraction becomes an inclusion probability. Probabilities
    move in blocks of a source that keep words and document counts; what a block
    leaves open (two units at most) meets the leftovers of other blocks, until
    one block per source is left and the landing closes it. A source's words
    then differ from its target by less than one large document.

    All draws are hashes of ids and texts sizes, so reruns agree. Null texts
    have size 0 and take 0; a null source is a source of its own; a null id is
    an id like any other; repeated rows are sampled one by one; an empty table
    gives an empty result.
    """
    begin(docs)
    rows = view(docs, id=id_col, text=text_col, source=source_col)
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    sizes = landed(rows.select("id", key.alias("key"), word_count("text").alias("size")), "sizes")
    per = landed(source_targets(sizes, weights, share, ceiling), "sources")
    largest = per.agg(F.max("n")).first()[0]
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    open_rows = sizes.join(per, "key").select(
        "key", F.lit(0).cast("long").alias("block"), F.xxhash64(F.lit(seed), "id", "size").alias("row"),
        F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), F.col("id").isNotNull().alias("given"), "size",
        F.when(F.col("size") > 0, ratio - F.floor(ratio)).otherwise(0.0).alias("psi"),
        F.floor(ratio).cast("long").alias("base"), F.col("target"), F.col("source_size"), "n")
    done = None
    left, level = largest or 0, 0
    while True:
        last = left <= BLOCK
        # blocks of this level: by the source's own size, so that a hot source has many
        share_left = F.ceil(F.col("n") / F.lit(float(BLOCK) * (BLOCK // 2) ** level))
        blocks = F.lit(1) if last else F.greatest(share_left, F.lit(1))
        mine = F.pmod(F.xxhash64(F.lit(seed + level + 1), "row", "id"), blocks)
        moved = open_rows.withColumn("block", mine.cast("long")).groupBy("key", "block").applyInPandas(
            _moved(last), ROWS + ", n long")
        moved = landed(moved, "moved")
        shut = moved.filter("psi in (0.0, 1.0)")
        done = shut if done is None else done.union(shut)
        if last:
            break
        open_rows = moved.filter("psi not in (0.0, 1.0)")
        left, level = -(-left // (BLOCK // 2)), level + 1
    taken = (F.col("size") * (F.col("base") + F.col("psi").cast("long"))).cast("long")
    return done.select(F.when(F.col("given"), F.col("id")).alias("doc_id"), "size", "source_size", "target", taken.alias("taken"))
