"""Sharding by best-fit-decreasing bin packing.

Groups of equal texts are indivisible unless one alone exceeds the capacity
of a shard. Sorted by size, each enters the shard with the tightest remaining
capacity that holds it, found in a balanced tree of remaining capacities.

Groups of one size are interchangeable, so the packing works on how many groups
each size has, and all groups of a size that enter one shard in succession do so
at once. Distinct sizes add up to no more than all bytes: there are at most
sqrt(2 * bytes) of them, and no more than the longest text has bytes, but for repeated texts.
Which groups of a size go where is then settled by their number among that size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import materialise

ROW_BYTES = 16
#: Rows that one task numbers.
PART_ROWS = 20_000
#: A group with more than this part of all rows is joined by broadcast; there are fewer such groups than this.
HOT = 1_000


class _Rooms:
    """A treap of (room, shard): a search tree by these, balanced by a hash of the shard."""

    def __init__(self) -> None:
        self.top: list | None = None  # node: [key, priority, left, right]

    def add(self, room: int, shard: int) -> None:
        low, high = self._split(self.top, (room, shard))
        node = [(room, shard), (shard + 1) * 0x9E3779B97F4A7C15 % 2**64, None, None]
        self.top = self._merged(self._merged(low, node), high)

    def take(self, size: int) -> tuple[int, int]:
        """Remove the least room that holds ``size``, of the smallest shard, or else the largest room."""
        low, high = self._split(self.top, (size, -1))
        first = high is not None
        path, node = [], high if first else low
        while node[2 if first else 3] is not None:
            path.append(node)
            node = node[2 if first else 3]
        rest = node[3 if first else 2]
        if path:
            path[-1][2 if first else 3] = rest
        elif first:
            high = rest
        else:
            low = rest
        self.top = self._merged(low, high)
        return node[0]

    def _split(self, node: list | None, key: tuple) -> tuple[list | None, list | None]:
        """The nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _merged(self, a: list | None, b: list | None) -> list | None:
        """One tree of two, all of ``a`` being below all of ``b``."""
        if a is None or b is None:
            return a if b is None else b
        if a[1] > b[1]:
            a[3] = self._merged(a[3], b)
            return a
        b[2] = self._merged(a, b[2])
        return b


def best_fit_decreasing(sizes: list[tuple[int, int]], shards: int, capacity: int) -> list[tuple[int, int, int]]:
    """Runs (size, first, shard) for ``sizes`` (size, number of groups): groups from number ``first`` of a size on go to ``shard``.

    The shard with the tightest room that holds a group is still the tightest after it has taken it, so it takes as many of the
    size as it can hold. A group that no shard can hold goes to the emptiest; since the shards together hold all
    bytes, fewer groups of a size than there are shards come to that.
    """
    rooms, out = _Rooms(), []
    for shard in range(shards):
        rooms.add(capacity, shard)
    for size, count in sorted(sizes, reverse=True):
        done = 0
        while done < count:
            room, shard = rooms.take(size)
            many = min(count - done, max(1, room // size))
            rooms.add(room - many * size, shard)
            out.append((size, done, shard))
            done += many
    return out


def even_capacity(sizes: list[tuple[int, int]], shards: int) -> int:
    """The capacity of each shard if groups that are larger get one of their own and the others share the rest evenly."""
    rest = sum(size * count for size, count in sizes)
    for size, count in sorted(sizes, reverse=True):
        for _ in range(count):
            if shards == 1 or size * shards <= rest:
                return -(-rest // shards) or 1
            rest, shards = rest - size, shards - 1
    return 1


def _numbered(rows: DataFrame, key: str, h: Column, order: list[str], name: str) -> DataFrame:
    """``rows`` with a gapless number from 0 among those of one ``key`` (of few values), dealt over tasks by the hash ``h``."""
    parts = rows.groupBy(key).agg(F.expr(f"cast(ceil(count(*) / {PART_ROWS}) as bigint)").alias("parts"))
    dealt = rows.join(F.broadcast(parts), key).withColumn("part", F.pmod(h, F.col("parts")))
    counts = dealt.groupBy(key, "part").agg(F.count("*").alias("n"))
    before = counts.select(key, "part", (F.sum("n").over(Window.partitionBy(key).orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy(key, "part").orderBy(*order))
    return dealt.withColumn("rank", rank).join(before, [key, "part"]).withColumn(name, F.col("before") + F.col("rank") - 1).drop("part", "parts", "rank", "before")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Place all ``docs`` (doc_id, text) into ``shards`` shards of nearly equal bytes.

    Returns doc_id, size (UTF-8 bytes of the text plus 16; a null text has
    none), text_crc32, law ('bytes'), shard, slot (gapless from 0 in a shard)
    and grown_shard (null). A null text groups with the empty one; rows that
    repeat a doc_id are documents of their own; a null doc_id is kept; an empty
    table gives no rows; other columns are not used. A very long text is measured and
    hashed where it is read and never moved.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # texts are read once; what follows works on these four numbers
    rows = materialise(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text, F.octet_length(text)).alias("grp"),
    ))
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    capacity = -(-(total or 0) // shards) or 1
    sizes = rows.groupBy("grp").agg(F.sum("size").alias("bytes"))
    # a group above the capacity is dealt over several chunks by a hash of doc_id; there are fewer than `shards` such groups
    over = [(r["grp"], -(-4 * r["bytes"] // capacity)) for r in sizes.filter(F.col("bytes") > capacity).collect()]
    chunk = F.lit(0)
    for grp, parts in over:
        chunk = F.when(F.col("grp") == grp, F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(parts))).otherwise(chunk)
    rows = rows.withColumn("item", F.xxhash64("grp", chunk.cast("long")) if over else F.col("grp"))
    items = materialise(rows.groupBy("item").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    histogram = [(r["bytes"], r["count"]) for r in items.groupBy("bytes").count().collect()]
    runs = best_fit_decreasing(histogram, shards, even_capacity(histogram, shards))
    # as many rows as distinct sizes, and a few for each shard; sizes of one run need no numbers
    of_size: dict[int, list] = {}
    for size, first, shard in runs:
        of_size.setdefault(size, []).append((first, shard))
    whole = spark.createDataFrame([(size, r[0][1]) for size, r in of_size.items() if len(r) == 1], "bytes long, shard int")
    split = spark.createDataFrame([(size, r) for size, r in of_size.items() if len(r) > 1], "bytes long, runs array<struct<first: long, shard: int>>")
    numbered = _numbered(items.join(F.broadcast(split.select("bytes")), "bytes"), "bytes", F.xxhash64("item", F.lit(3)), ["item"], "number")
    of_run = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("number")), -1)["shard"]
    placed = materialise(
        items.join(F.broadcast(whole), "bytes").select("item", "shard", "n")
        .union(numbered.join(F.broadcast(split), "bytes").select("item", of_run.alias("shard"), "n"))
    )
    hot = placed.filter(F.col("n") * HOT > n).select("item", F.col("shard").alias("hot_shard"))
    met = rows.join(F.broadcast(hot), "item", "left")
    put = materialise(
        met.filter("hot_shard is null").join(placed.select("item", "shard"), "item").select("doc_id", "size", "text_crc32", "grp", "shard")
        .union(met.filter("hot_shard is not null").select("doc_id", "size", "text_crc32", "grp", "hot_shard"))
    )
    return _numbered(put, "shard", F.xxhash64("doc_id", "grp"), ["doc_id", "text_crc32", "grp"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )
