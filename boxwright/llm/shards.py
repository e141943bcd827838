"""Sharding: minimax contiguous partition of ordered atomic groups.

Equal texts form a group, which is never split; groups are ordered by a 64-bit hash of their text. A group of at least one
`atoms`-th of all bytes is an atom of its own; the smaller ones are gathered into `atoms` ranges of the hash, in front of the
large groups of their range. A binary search finds the smallest capacity with which a greedy walk over the ordered atoms needs no
more shards than asked for; the cuts follow from it. Groups that alone exceed an even share (a hot text) come first in the
order, each with a shard of its own, so that they don't set the capacity for all others. The capacity is the least for the
atoms; for the groups themselves it could be less by at most the largest range of small groups, of the order of 1 / `atoms`
of all bytes.

Slots come without gathering a shard in one task: an atom's rows are dealt to cells of about CELL_ROWS by a hash of id and text,
equal rows as one with its count; sums over the cells of a shard give each cell's first slot, and only a cell's own rows are
ranked. What reaches the driver is bounded by three times `atoms`, whatever the size of the input.

Null texts count as empty ones; a null or repeated doc_id is a row like any other; rows of one id and text are told apart by their
slots only; an empty table gives an empty result. Texts are hashed and measured whole, however long. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxwright.llm.common import drop_stored, stored

#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Different rows of an atom that are put in order at once.
CELL_ROWS = 2000


def feasible(prefix: list[int], capacity: int, shards: int, start: int = 0) -> bool:
    """Can a greedy walk put the atoms from `start` on into so many shards of this capacity? prefix: sums, from 0."""
    at, last = start, len(prefix) - 1
    for _ in range(shards):
        if at >= last:
            return True
        after = bisect_right(prefix, prefix[at] + capacity) - 1
        if after == at:
            return False
        at = after
    return at >= last


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity with which at most so many contiguous shards hold all atoms."""
    prefix = [0]
    for s in sizes:
        prefix.append(prefix[-1] + s)
    low, high = max([*sizes, -(-prefix[-1] // shards)], default=0), prefix[-1]
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(prefix, middle, shards) else (middle + 1, high)
    return low


def cut(sizes: list[int], shards: int) -> list[int]:
    """Shard of each ordered atom: no shard exceeds the smallest capacity, and within it the cuts are as even as they can be."""
    capacity = smallest_capacity(sizes, shards)
    prefix = [0]
    for s in sizes:
        prefix.append(prefix[-1] + s)
    # need[i]: shards that a greedy walk from atom i takes
    n = len(sizes)
    need = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        need[i] = 1 + need[bisect_right(prefix, prefix[i] + capacity) - 1]
    out, at = [0] * n, 0
    for shard in range(shards):
        if at >= n:
            break
        left = shards - shard
        most = bisect_right(prefix, prefix[at] + capacity) - 1
        even = prefix[at] + (prefix[n] - prefix[at]) / left
        end = min(max(at + 1, bisect_right(prefix, even) - 1), most)
        if end < most and abs(prefix[end + 1] - even) < abs(even - prefix[end]):
            end += 1
        while end < most and need[end] > left - 1:
            end += 1
        for i in range(at, end):
            out[i] = shard
        at = end
    return out


def assign(sizes: list[int], shards: int) -> list[int]:
    """Shard of each atom, given in hash order: atoms above an even share first and alone, the others by cut()."""
    alone: list[int] = []
    rest = list(range(len(sizes)))
    while rest and len(alone) < shards - 1:
        share = sum(sizes[i] for i in rest) / (shards - len(alone))
        largest = sorted((i for i in rest if sizes[i] > share), key=lambda i: (-sizes[i], i))[: shards - 1 - len(alone)]
        if not largest:
            break
        alone += largest
        gone = set(largest)
        rest = [i for i in rest if i not in gone]
    out = [0] * len(sizes)
    for shard, i in enumerate(alone):
        out[i] = shard
    for i, shard in zip(rest, cut([sizes[i] for i in rest], shards - len(alone)), strict=True):
        out[i] = len(alone) + shard
    return out


def plan_shards(
    docs: DataFrame, shards: int, atoms: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and hash (of the text) of every row of docs; see the module's docstring."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
    )
    # equal rows are one from here on: a hot text without ids is one row for each task that has it
    by = ["hash", "size", "text_crc32", "doc_id"]
    rows = stored(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), "shard-rows")
    range_ = F.shiftrightunsigned("hash", 64 - (atoms.bit_length() - 1)).cast("int").alias("range")
    groups = rows.groupBy("hash").agg(F.sum(F.col("n") * F.col("size")).alias("bytes"), F.count(F.lit(1)).alias("rows"))
    groups = stored(groups.select(range_, "hash", "bytes", "rows"), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes") >= max(1, total // atoms)
    # at most `atoms` of either kind; a range's small groups come before its large ones
    single = [(r["range"], 1, r["hash"], r["bytes"], r["rows"]) for r in groups.where(large).collect()]
    small = groups.where(~large).groupBy("range").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect()
    found = sorted(single + [(r["range"], 0, 0, r["bytes"], r["rows"]) for r in small])
    shard_of = assign([r[3] for r in found], shards)
    plan = spark.createDataFrame(
        [(*r[:3], k, -(-r[4] // CELL_ROWS), shard) for k, (r, shard) in enumerate(zip(found, shard_of, strict=True))],
        "range int, own int, large_hash long, atom int, cells long, shard int",
    )
    of_large = plan.where("own = 1").select(F.col("large_hash").alias("hash"), "atom", "cells", "shard")
    of_small = plan.where("own = 0").select("range", *[F.col(c).alias(f"_{c}") for c in ("atom", "cells", "shard")])
    # both are bounded by `atoms` rows
    rows = rows.select("*", range_).join(F.broadcast(of_large), "hash", "left").join(F.broadcast(of_small), "range", "left")
    rows = rows.withColumns({c: F.coalesce(c, f"_{c}") for c in ("atom", "cells", "shard")})
    cell = F.pmod(F.xxhash64("hash", "doc_id"), "cells").cast("int")
    rows = stored(rows.select("doc_id", "size", "text_crc32", "hash", "n", "shard", "atom", cell.alias("cell")), "shard-cells")
    sums = rows.groupBy("shard", "atom", "cell").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("atom", "cell", before(Window.partitionBy("shard").orderBy("atom", "cell")).alias("start"))
    starts = stored(starts, "shard-starts")
    within = before(Window.partitionBy("atom", "cell").orderBy("doc_id", "hash", "text_crc32", "size"))
    first = F.col("start") + within
    drop_stored(groups)
    return (
        rows.join(starts, ["atom", "cell"])
        .withColumn("first", first)
        .withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
        .select("doc_id", "size", "text_crc32", "shard", "slot", "hash")
    )


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs with their shard as one folder for each, `_shard=k`, in the order of groups and ids.

    A row's shard depends on its text alone, so rows find theirs by the text, and null or repeated ids do no harm.
    """
    plan = plan_shards(docs, shards, id_col=id_col, text_col=text_col)
    by_text = ["_size", "_crc", "_hash"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = [(F.octet_length(text) + ROW_BYTES).cast("long"), F.crc32(text.cast("binary")), F.xxhash64(text)]
    rows = docs.withColumns(dict(zip(by_text, keys, strict=True)))
    hashed = plan.select(F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), F.col("hash").alias("_hash"), F.col("shard").alias("_shard"))
    (
        rows.join(hashed.distinct(), by_text)
        .repartitionByRange("_shard", "_hash", id_col)
        .sortWithinPartitions("_shard", "_hash", id_col)
        .drop(*by_text)
        .write.partitionBy("_shard")
        .parquet(path)
    )
