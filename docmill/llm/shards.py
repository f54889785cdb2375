"""Resharding by minimum-cost flow: the fewest bytes move from old shards to new capacities."""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, pick

#: Slices by hash of each size class of a shard, as many more as hold so many rows each; what the driver plans with is
#: a sum per shard, class and slice.
SLICES, CLASSES, SLICE_ROWS = 16, 32, 1 << 20
OVERHEAD = 16


def capacities(total: int, shards: int) -> list[int]:
    return [total * (k + 1) // shards - total * k // shards for k in range(shards)]


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Transfers (i, j) -> amount of least total cost by successive shortest paths with potentials.

    supply and demand have the same sum; cost(i, j) >= 0. Sizes of the graph are those of the shard lists.
    """
    n, m = len(supply), len(demand)
    left, need = list(supply), list(demand)
    flow: dict[tuple[int, int], int] = defaultdict(int)
    pot = [0] * (n + m)
    while any(left):
        dist, via, done = [float("inf")] * (n + m), [-1] * (n + m), set()
        heap = [(0, i) for i in range(n) if left[i]]
        for _, i in heap:
            dist[i] = 0
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            if u < n:
                steps = ((n + j, cost(u, j)) for j in range(m))
            else:
                steps = ((i, -cost(i, u - n)) for i in range(n) if flow.get((i, u - n)))
            for v, c in steps:
                if (e := d + c + pot[u] - pot[v]) < dist[v]:
                    dist[v], via[v] = e, u
                    heapq.heappush(heap, (e, v))
        end = min((n + j for j in range(m) if need[j]), key=lambda v: (dist[v] + pot[v], v))
        pot = [p + (d if d < float("inf") else 0) for p, d in zip(pot, dist, strict=True)]
        path = [end]
        while via[path[-1]] >= 0:
            path.append(via[path[-1]])
        path.reverse()
        amount = min(left[path[0]], need[end - n], *(flow[(v, u - n)] for u, v in zip(path, path[1:], strict=False) if u >= n))
        for u, v in zip(path, path[1:], strict=False):
            if u < n:
                flow[(u, v - n)] += amount
            else:
                flow[(v, u - n)] -= amount
        left[path[0]] -= amount
        need[end - n] -= amount
    return {k: v for k, v in flow.items() if v}


def transfers(old_sizes: list[int], new_capacities: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from old shard i to new shard j; what stays in its shard costs nothing, every other byte costs one."""
    return min_cost_flow(old_sizes, new_capacities, lambda i, j: 0 if i == j else 1)


def reshard(
    docs: DataFrame, old_shards: int, new_shards: int, old_shard: str | None = None, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None
) -> DataFrame:
    """Per row: doc_id, size, text_crc32, occurrence, old_shard, shard, slot. Sizes of new shards are near equal.

    old_shard is a SQL expression of a row's present shard; by default shards are by a hash of the id.
    Rows of a shard are ordered by size class from large to small, then by slice; the first bytes stay and the last
    ones, which are small rows, move. The driver sees only the sums of (shard, class, slice) blocks, one per SLICE_ROWS
    rows or fewer. A row goes where its middle byte lies in the plan.
    slot is a row's place in its new shard, from 0 without gaps. occurrence tells equal rows apart.
    The law is that of bytes alone: rows of equal texts are placed each on its own, since keeping a group of a third of
    all rows together would leave no shards of near equal size.

    Null text: no bytes. Null ids are hashed like a value. Empty table: no rows.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "shards")
    rows = pick(docs, doc_id=id_col, text=text_col)
    if old_shard is not None:
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.expr(old_shard).cast("int").alias("old"))
    else:
        rows = rows.withColumn("old", F.pmod(F.xxhash64("doc_id"), F.lit(old_shards)).cast("int"))
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long") + OVERHEAD
    sized = work.save(rows.select("doc_id", "old", size.alias("size"), F.crc32(text).alias("crc")), "sized")
    slices = max(SLICES, -(-sized.count() // (old_shards * SLICE_ROWS)))
    sized = sized.withColumns({"class": CLASSES * 2 - F.length(F.bin("size")), "slice": F.pmod(F.xxhash64("doc_id", "crc"), F.lit(slices)).cast("int")})
    blocks = sorted(tuple(r) for r in sized.groupBy("old", "class", "slice").agg(F.sum("size"), F.count(F.lit(1))).collect())
    sizes = [0] * old_shards
    base = []
    for old, kind, part, total, _ in blocks:
        base.append((old, kind, part, sizes[old]))
        sizes[old] += total
    moves = transfers(sizes, capacities(sum(sizes), new_shards))
    at, ranges = [0] * old_shards, []
    for i, j in sorted(moves, key=lambda m: (m[0], m[0] != m[1], m[1])):
        ranges.append((i, at[i], at[i] + moves[i, j], j))
        at[i] += moves[i, j]

    block = Window.partitionBy("old", "class", "slice").orderBy("doc_id", "crc")
    before = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.broadcast(spark.createDataFrame(base, "old int, class int, slice int, base long"))
    placed = sized.join(known, ["old", "class", "slice"]).withColumns(
        {"mid": F.col("base") + F.sum("size").over(before) - F.col("size") + F.floor(F.col("size") / 2), "n": F.row_number().over(block)}
    )
    target = F.broadcast(spark.createDataFrame(ranges, "old int, lo long, hi long, shard int"))
    placed = placed.join(target, "old").where("mid >= lo AND mid < hi").select("doc_id", "size", "crc", "old", "class", "slice", "n", "shard")
    placed = work.save(placed, "placed")

    runs = sorted(tuple(r) for r in placed.groupBy("shard", "old", "class", "slice").agg(F.min("n"), F.count(F.lit(1))).collect())
    filled, starts = [0] * new_shards, []
    for shard, old, kind, part, first, count in runs:
        starts.append((shard, old, kind, part, filled[shard] - first))
        filled[shard] += count
    shift = F.broadcast(spark.createDataFrame(starts, "shard int, old int, class int, slice int, shift long"))
    done = placed.join(shift, ["shard", "old", "class", "slice"])
    same = Window.partitionBy(F.xxhash64("doc_id", "crc", "size")).orderBy("doc_id", "crc", "size", "shard", "n")
    return done.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.row_number().over(same).alias("occurrence"), F.col("old").alias("old_shard"), "shard", (F.col("n") + F.col("shift")).alias("slot"))


def affected(placed: DataFrame) -> DataFrame:
    """The shards that gain or lose a row."""
    moved = placed.where("old_shard <> shard")
    return moved.select("shard").union(moved.select(F.col("old_shard").alias("shard"))).distinct()


def rewrite(docs: DataFrame, placed: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files of every shard that gains or loses rows, as shard=K folders of (doc_id, text, slot), and reads them.

    Shards with the same rows as before are left out. Rows meet their place by id, size, checksum and occurrence.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = pick(docs, doc_id=id_col, text=text_col).withColumns({"size": F.octet_length(text).cast("long") + OVERHEAD, "text_crc32": F.crc32(text)})
    key = F.xxhash64("doc_id", "text_crc32", "size")
    rows = rows.withColumn("key", key)
    rows = rows.withColumn("occurrence", F.row_number().over(Window.partitionBy("key").orderBy("doc_id", "text_crc32", "size")))
    where = placed.join(F.broadcast(affected(placed)), "shard").select("text_crc32", "size", "occurrence", "shard", "slot", key.alias("key"))
    # Differences, not equalities: the texts then stay partitioned by key alone, as the window has left them.
    same = "r.key = p.key AND r.occurrence - p.occurrence = 0 AND r.text_crc32 - p.text_crc32 = 0 AND r.size - p.size = 0"
    out = rows.alias("r").join(where.alias("p"), F.expr(same)).select("r.doc_id", "r.text", "p.slot", "p.shard")
    out.write.mode("overwrite").partitionBy("shard").option("compression", "zstd").parquet(folder)
    return spark.read.schema(out.schema).parquet(folder)
