"""Sharding by balanced label propagation, with DataFrame operations only.

Documents that share a text are linked through that text (a hub), so links stay linear in the rows.  Every document
begins in the shard of its key's hash.  In each round a hub asks its members into the shard where most of them are; a
shard grants requests up to its free capacity, as a share of the asking hubs that is drawn by hash (hubs of more than
1/SPLIT of a shard and of eight rows are granted by member instead, so that no group has to fit as a whole).  At the
end exact quotas hold: shards with too many rows give the rest to those with too few, unlinked rows first, then
members of those large groups, then others.

Law `rows`: the numbers of rows of two shards differ by one at most.

Only sums per shard reach the driver.  Ranks within a shard come from ranks within small hashed cells and the cells'
sums, so no task sorts a whole shard.  Hubs of many members are joined by broadcast (`join_hot`), so no task gets all
members of one.

Edge cases: null texts are linked with nothing, have size 8 and checksum 0; empty texts are equal texts; repeated rows
and rows without a key are placed each for itself; ties go by hash, and among rows of equal keys and texts it makes no
difference; texts of any length count by their whole size; an empty table gives no rows; fewer rows than shards leave
shards empty; other columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, hot_keys, join_hot

__all__ = ["cut_links", "place"]

ROUNDS, SLACK, SPLIT = 4, 1.02, 16
#: Rows of a ranking cell, about.
CELL = 20_000


def _pick(index: Column, values: list[int], kind: str = "long") -> Column:
    """values[index]; the list has a member per shard."""
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), index.cast("int") + 1)


def _sums(df: DataFrame, by: str, shards: int) -> list[int]:
    found = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    return [found.get(s, 0) for s in range(shards)]


def _ranked(df: DataFrame, cells: int, shard: str, first: Column, order: list[str], out: str) -> DataFrame:
    """Rank from 0 within each shard, rows with a smaller `first` (0 to 2) before others."""
    cell = df.withColumn("_first", first).withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    keys = [shard, "_first", "_cell"]
    before = Window.partitionBy(shard).orderBy("_first", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    # At most shards * 3 * cells rows of four numbers, and a cell stands for CELL rows.
    sums = cell.groupBy(*keys).count().select(*keys, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return cell.withColumn("_rank", inner).join(F.broadcast(sums), keys).withColumn(out, F.col("_before") + F.col("_rank") - 1).drop("_first", "_cell", "_rank", "_before")


def place(df: DataFrame, scratch: Scratch, shards: int = 24, rounds: int = ROUNDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard of every row."""
    known = F.coalesce(F.col(text), F.lit("")).cast("binary")
    nodes = scratch.save(
        df.select(
            F.col(key),
            (F.octet_length(known) + 8).cast("long").alias("size"),
            F.crc32(known).alias("text_crc32"),
            F.when(F.col(text).isNotNull(), F.md5(known)).alias("hub"),
            F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(shards)).cast("int").alias("shard"),
        ),
        "nodes",
    )
    total = nodes.count()
    hubs = scratch.save(nodes.where("hub is not null").groupBy("hub").agg(F.count("*").alias("members")).where("members > 1"), "hubs")
    hot = hot_keys(hubs.withColumnRenamed("members", "count"), "hub", total, scratch)
    marked = scratch.save(join_hot(nodes, hubs, "hub", hot).select(key, "size", "text_crc32", F.when(F.col("members") > 1, F.col("hub")).alias("hub"), "members", "shard"), "marked")
    scratch.drop(nodes)
    free_rows = marked.where("hub is null")
    lone = _sums(free_rows, "shard", shards)
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    linked = marked.where("hub is not null")
    for r in range(rounds):
        votes = linked.groupBy("hub", "members", "shard").agg(F.count("*").alias("n"))
        wish = votes.groupBy("hub", "members").agg(F.max(F.struct("n", F.xxhash64("hub", "shard").alias("tie"), "shard")).alias("best"), F.sum("n").alias("all"))
        wish = wish.select("hub", "members", F.col("best.shard").alias("wanted"), (F.col("all") - F.col("best.n")).alias("asking")).where("asking > 0")
        wish = scratch.save(wish, f"wish{r}")
        large = F.col("members") > max(8, total // shards // SPLIT)
        asked = {(x[0], x[1]): x[2] for x in wish.groupBy("wanted", large.alias("large")).agg(F.sum("asking")).collect()}
        if not asked:
            break
        here = _sums(linked, "shard", shards)
        leaving = {x[0]: x[1] for x in votes.join(wish.select("hub", "wanted"), "hub").where("shard <> wanted").groupBy("shard").agg(F.sum("n")).collect()}
        # Unlinked rows can make room at the end, and rows that ask to leave make room now.
        room = [max(0, int(quota[s] * SLACK) - here[s] + leaving.get(s, 0)) for s in range(shards)]
        # Small groups, which fit as a whole, come first; large ones share what room is left.
        few, many = ([asked.get((s, x), 0) for s in range(shards)] for x in (False, True))
        grant = [min(1 << 20, (room[s] << 20) // max(1, few[s])) for s in range(shards)]
        rest = [min(1 << 20, (max(0, room[s] - few[s]) << 20) // max(1, many[s])) for s in range(shards)]
        to = F.coalesce("wanted", F.lit(0))
        by_member, by_hub = (F.pmod(F.xxhash64(x, F.lit(r)), F.lit(1 << 20)) for x in (F.col(key), F.col("hub")))
        drawn = F.when(large, by_member < _pick(to, rest)).otherwise(by_hub < _pick(to, grant))
        moved = join_hot(linked, wish.select("hub", "wanted"), "hub", hot)
        takes = F.col("wanted").isNotNull() & drawn
        linked = scratch.save(moved.select(key, "size", "text_crc32", "hub", "members", F.when(takes, F.col("wanted")).otherwise(F.col("shard")).alias("shard")), f"round{r}")
    here = _sums(linked, "shard", shards)
    load = [a + b for a, b in zip(lone, here, strict=True)]
    surplus = [max(0, a - q) for a, q in zip(load, quota, strict=True)]
    lack = [max(0, q - a) for a, q in zip(load, quota, strict=True)]
    cells = max(1, total // shards // CELL)
    order = [key, "text_crc32"]
    columns = [key, "size", "text_crc32", "hub", "members", "shard"]
    bound = F.when(F.col("hub").isNull(), 0).when(F.col("members") > max(8, total // shards // SPLIT), 1).otherwise(2)
    ranked = _ranked(free_rows.select(*columns).unionByName(linked.select(*columns)), cells, "shard", bound, order, "rank")
    index = F.col("rank") + _pick(F.col("shard"), [sum(surplus[:s]) for s in range(shards)])
    to = F.lit(0)
    for s in range(1, shards):  # the shard whose range of lacking rows holds the index
        to = F.when(index >= sum(lack[:s]), F.lit(s)).otherwise(to) if lack[s] else to
    final = F.when(F.col("rank") < _pick(F.col("shard"), surplus), to).otherwise(F.col("shard"))
    settled = scratch.keep_only(scratch.save(ranked.select(key, "size", "text_crc32", "hub", final.cast("int").alias("shard")), "settled"))
    slotted = _ranked(settled, cells, "shard", F.lit(0), order, "slot")
    return slotted.select(key, "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("hub").alias("link_group"))


def cut_links(placed: DataFrame) -> DataFrame:
    """One row: linked rows, and those outside their group's fullest shard."""
    per = placed.where("link_group is not null").groupBy("link_group", "shard").count()
    return per.groupBy("link_group").agg(F.sum("count").alias("n"), F.max("count").alias("most")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("linked"), F.coalesce(F.sum(F.col("n") - F.col("most")), F.lit(0)).alias("cut"))
