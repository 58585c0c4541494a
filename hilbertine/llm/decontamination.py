"""Benchmark decontamination with DataFrame functions only.

The benchmark's windows of normalised words form a set whose size is checked
before it travels to the tasks as a hash set. Each document is split into
words once. A window can only occur where its anchor, its longest word, stands;
so words are first looked up among the anchors, and the exact windows around
an anchor are looked up only there. A benchmark beyond the bound is
matched by a shuffle join on window hashes instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialise

#: Words are runs of letters and digits of ASCII, and of anything beyond it.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
#: Most distinct windows that travel to the tasks, at 10 words some 100 bytes each.
SET_BOUND = 100_000


def words_of(text: Column) -> Column:
    """The words of a text, case kept; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), BETWEEN_WORDS), "")


def _window(words: str, start: str, size: int) -> str:
    return f"translate(array_join(slice({words}, {start} + 1, {size}), ' '), '{UPPER}', '{LOWER}')"


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """(item_id, size, win, anchor) of each distinct window of each item; a shorter item is one window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).filter("size(w) > 0")
    size = f"least(size(w), {n})"
    starts = items.select("item_id", F.expr(size).alias("size"), "w", F.expr(f"explode(sequence(0, size(w) - {size}))").alias("s"))
    at = starts.select("item_id", "size", F.expr("transform(slice(w, s + 1, size), x -> lower(x))").alias("low"), F.expr(f"translate(array_join(slice(w, s + 1, size), ' '), '{UPPER}', '{LOWER}')").alias("win"))
    longest = "array_max(transform(low, x -> struct(length(x) as l, xxhash64(x) as h, x as word))).word"
    return at.select("item_id", "size", "win", F.expr(longest).alias("anchor")).distinct()


def _in(value: str, members: list[str]) -> str:
    """Membership in a set of words and blanks, which hold no quotes or backslashes."""
    return f"{value} IN ({', '.join(repr(m) if m.isascii() else chr(39) + m + chr(39) for m in members)})"


def _hits_by_set(docs: DataFrame, sets: list[tuple[int, list[str]]], anchors: list[str]) -> DataFrame:
    """docs (with ``w``) and ``hits``: an array of (start, size, window hash).

    Words and anchors are bound inside one expression: a filter on hits, which the
    optimizer pushes down to where w is made, would else repeat their making.
    """
    at = f"array_remove(transform(v, (x, i) -> if({_in('lower(x)', anchors)}, i, -1)), -1)"
    parts = []
    for size, members in sets:
        last = f"size(v) - {size}"
        starts = f"array_distinct(flatten(transform(at, i -> sequence(greatest(0, i - {size - 1}), least(i, {last})))))"
        real = f"filter({starts}, s -> {_in(_window('v', 's', size), members)})"
        parts.append(f"if(size(at) = 0 or {last} < 0, array(), transform({real}, s -> struct(s as s, {size} as size, xxhash64({_window('v', 's', size)}) as win)))")
    found = f"cast(concat({', '.join(parts)}) as array<struct<s:int,size:int,win:bigint>>)"
    return docs.withColumn("hits", F.expr(f"get(transform(array(w), v -> get(transform(array({at}), at -> {found}), 0)), 0)"))


def _hits_by_join(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """The same by a shuffle join on window hashes, for a benchmark of any size."""
    key = docs.withColumn("text_key", F.expr("struct(size(w) as n, xxhash64(w) as a, hash(w) as b)"))
    texts = key.select("text_key", "w").dropDuplicates(["text_key"])
    parts = [f"if(size(w) < {size}, array(), transform(sequence(0, greatest(0, size(w) - {size})), s -> struct(s as s, {size} as size, xxhash64({_window('w', 's', size)}) as win)))" for size in sizes]
    each = texts.select("text_key", F.expr(f"explode(cast(concat({', '.join(parts)}) as array<struct<s:int,size:int,win:bigint>>))").alias("hit"))
    known = windows.select(F.xxhash64("win").alias("win"), "size", F.col("win").alias("exact")).distinct()
    met = each.join(known, (F.col("hit.win") == known["win"]) & (F.col("hit.size") == known["size"]))
    hit = met.groupBy("text_key").agg(F.collect_list(F.struct("hit.s", "hit.size", "hit.win", "exact")).alias("found"))
    # the text's own words verify what the hashes have found
    real = f"transform(filter(found, h -> {_window('w', 'h.s', 'h.size')} = h.exact), h -> struct(h.s as s, h.size as size, h.win as win))"
    return key.join(hit, "text_key", "left").withColumn("hits", F.expr(f"coalesce({real}, cast(array() as array<struct<s:int,size:int,win:bigint>>))")).drop("text_key", "found")


#: Words inside the union of the hits, which are sorted by their start.
COVERED = "aggregate(array_sort(hits), struct(0 as till, 0L as n), (a, h) -> struct(greatest(a.till, h.s + h.size) as till, a.n + greatest(0, h.s + h.size - greatest(a.till, h.s)) as n), a -> a.n)"


def with_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, set_bound: int = SET_BOUND) -> tuple[DataFrame, DataFrame]:
    """``docs`` (which has a word array ``w``) with ``hits`` added, and the benchmark's windows."""
    windows = materialise(benchmark_windows(benchmark, n))
    distinct = windows.select("size", "win", "anchor").distinct()
    if distinct.limit(set_bound + 1).count() > set_bound:
        return _hits_by_join(docs, windows, [r[0] for r in windows.select("size").distinct().collect()]), windows
    rows = distinct.collect()
    if not rows:
        return docs.withColumn("hits", F.expr("cast(array() as array<struct<s:int,size:int,win:bigint>>)")), windows
    sizes = sorted({r["size"] for r in rows})
    sets = [(k, sorted({r["win"] for r in rows if r["size"] == k})) for k in sizes]
    return _hits_by_set(docs, sets, sorted({r["anchor"] for r in rows})), windows


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, set_bound: int = SET_BOUND) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_hit (words inside any
    occurrence of a window), n_items (items with occurring windows),
    items_sha256 (of those item_ids, sorted as strings, comma-joined) and
    contaminated (n_hit > 0).

    A null or empty text has no words and no hits; items without words are
    never found; rows that repeat a doc_id or item_id are each worked on alike; a null
    item_id counts as one item and is left out of items_sha256; a null doc_id is kept; an empty benchmark gives no hits; other columns are
    not used.
    """
    base, windows = with_hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("w")), benchmark, n, set_bound)
    # what follows depends on the set of windows alone, so that equal sets are resolved once
    found = materialise(base.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.expr(COVERED).alias("n_hit"),
        F.expr("array_sort(array_distinct(hits.win))").alias("wins"),
    ).withColumn("set_key", F.xxhash64("wins")))
    sets = found.filter("n_hit > 0").select("set_key", "wins").distinct()
    by_win = windows.select(F.xxhash64("win").alias("win"), "item_id").distinct()
    items = (
        sets.select("set_key", "wins", F.explode("wins").alias("win")).join(by_win, "win")
        .groupBy("set_key", "wins").agg(F.array_sort(F.collect_set(F.struct("item_id"))).alias("items"))
    )
    # rows without hits, most of all, would meet under one key
    joined = found.filter("n_hit > 0").join(items, ["set_key", "wins"], "left").unionByName(found.filter("n_hit = 0").withColumn("items", F.expr("cast(null as array<struct<item_id:string>>)")))
    return joined.select(
        "doc_id", "n_words", "n_hit", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items.item_id", ","), F.lit("")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, set_bound: int = SET_BOUND) -> DataFrame:
    """``docs`` without the rows whose text holds a window of the benchmark; all columns are kept.

    A null or empty text holds none and stays; rows that repeat a doc_id are told apart by their
    texts; an empty benchmark drops nothing; an empty table gives an empty one.
    """
    whole = docs.select(F.struct("*").alias("doc"), words_of(F.col("text")).alias("w"))
    kept, _ = with_hits(whole, benchmark, n, set_bound)
    return kept.filter("size(hits) = 0").select("doc.*")


def cut_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, set_bound: int = SET_BOUND) -> DataFrame:
    """``docs`` with the hit words removed; a text that is hit is rewritten as its other words, blank-separated.

    All rows and columns stay; a text without hits, also a null or empty one, stays as it is.
    """
    whole = docs.select(F.struct("*").alias("doc"), words_of(F.col("text")).alias("w"))
    found, _ = with_hits(whole, benchmark, n, set_bound)
    rest = "array_join(filter(w, (x, i) -> not exists(hits, h -> i >= h.s and i < h.s + h.size)), ' ')"
    kept = [F.col(f"doc.`{c}`") for c in docs.columns]
    text = F.when(F.expr("size(hits) = 0"), F.col("doc.text")).otherwise(F.expr(rest)).alias("text")
    return found.select(*[text if c == "text" else k for c, k in zip(docs.columns, kept, strict=True)])
