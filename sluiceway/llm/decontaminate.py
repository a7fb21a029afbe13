"""Benchmark decontamination with DataFrame expressions only.

A window of a text is a run of as many five-word shingles as a benchmark item has. Its similarity with the
item is weighted Jaccard: a shingle weighs as often as it occurs. One of similarity 0.8 has 8/9 of its
shingles in common with the item, wherever they stand, so a sliding count over the places where a text has
a shingle of the item leaves the windows that can reach it. Sliding a window on to the next such place
loses nothing, so only windows that start at one, and the last one of a text, have to be looked at.

These windows and the items get a SimHash of their shingles, cut into ``RADIUS + 1`` blocks, so that two
fingerprints within the radius agree in at least one block. Windows meet the items whose shingles they
have by equal blocks, and those within the radius are verified by their exact similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import quoted, text_of
from sluiceway.llm.textops import SHINGLE_WORDS
from sluiceway.sources import lineage_cut

THRESHOLD = 0.8
# At similarity 0.8 two fingerprints differ in 9.7 of 64 bits on average (standard deviation 2.9).
RADIUS = 22
BITS = 64
BROADCAST_ROWS = 1_000_000

_BLANK = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    """Lower-cased words; an empty array for a text without any."""
    trimmed = F.btrim(F.lower(text), F.lit(_BLANK))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+")
    )


def gram_hashes(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order; empty for shorter texts."""
    starts = F.sequence(F.lit(1), F.size(words) - (size - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(size))))
    return F.when(F.size(words) >= size, hashes).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """64 bits: each is the majority of that bit over all hashes of the array."""
    ones = F.transform(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        lambda b: F.aggregate(
            hashes, F.lit(0),
            lambda n, h: n + F.call_function("shiftright", h, b).bitwiseAND(F.lit(1)).cast("int"),
        ),
    )
    return F.aggregate(
        F.transform(ones, lambda n, b: F.when(
            n * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)
        ).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"),
        lambda bits, bit: bits.bitwiseOR(bit),
    )


def blocks(fingerprint: Column) -> Column:
    """Array of (block, value) for the multi-index join."""
    n = RADIUS + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return F.array(*[
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, lo)
                 .bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value"))
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))
    ])


def marked(hashes: Column) -> Column:
    """The hashes in order, each made different from its earlier copies: what two such arrays have in
    common as sets, the plain ones have in common with repeats counted."""
    ordered = F.array_sort(hashes)
    return F.transform(ordered, lambda x, i: F.xxhash64(x, i - F.array_position(ordered, x)))


def least_shared(size: Column, window: Column) -> Column:
    """Fewest shingles that an item and a window of the given sizes share at the threshold."""
    return THRESHOLD / (1 + THRESHOLD) * (size + window) - 1e-9


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
                 ) -> DataFrame:
    """(id, item_id, similarity, hamming, first_word): the best window per text and item.

    Items of fewer than five words are one shingle of that many words. Null or wordless texts and
    items match nothing. A text shorter than an item is one window. Rows repeated in id and text give
    one result row; texts and items that share an id, or have none, have rows of their own. The item
    shingles are broadcast if they are few; else that join shuffles.
    """
    return _found(docs, benchmark, id_col, text_col, item_col, item_text).drop("key")


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(quoted(id_col), text_of(text_col))


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str,
           item_text: str) -> DataFrame:
    """The rows of ``contaminated`` with the text's ``key``, which is known without an id, too."""
    items = benchmark.select(quoted(item_col).alias("item_id"),
                             words_of(text_of(item_text)).alias("w")).filter("size(w) > 0").distinct()
    items = lineage_cut(items.withColumn("item", F.xxhash64("item_id", "w")))
    read = docs.select(
        _key(id_col, text_col).alias("key"), quoted(id_col).alias("id"),
        text_of(text_col).alias("text"),
    )
    found = None
    sizes = sorted(r[0] for r in items.select(F.least(F.size("w"), F.lit(SHINGLE_WORDS))).distinct()
                   .collect())
    for size in sizes:
        part = _matches(read, items.filter(F.least(F.size("w"), F.lit(SHINGLE_WORDS)) == size), size)
        found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame(
            [], f"key long, id {docs.schema[id_col].dataType.simpleString()}, item_id "
            f"{benchmark.schema[item_col].dataType.simpleString()}, similarity double, hamming int, "
            "first_word int")
    return found


def _matches(read: DataFrame, items: DataFrame, size: int) -> DataFrame:
    items = lineage_cut(items.select("item", "item_id", gram_hashes(F.col("w"), size).alias("grams"))
                        .select("*", F.size("grams").alias("m"), simhash(F.col("grams")).alias("fp"),
                                marked(F.col("grams")).alias("set")))
    grams = items.select("item", "m", F.explode(F.array_distinct("grams")).alias("gram"))
    if grams.count() <= BROADCAST_ROWS:
        grams = F.broadcast(grams)
    spread = (
        read.select("key", words_of(F.col("text")).alias("w"))
        .select("key", gram_hashes(F.col("w"), size).alias("g"))
        # The outer form: for the other one Spark derives a filter that splits the text per shingle.
        .select("key", F.size("g").alias("n"), F.posexplode_outer("g").alias("pos", "gram"))
    )
    # A repeated shingle of an item is one row here, so that a place counts once.
    hits = spread.join(grams, "gram").select("key", "item", "m", "n", "pos")
    windows = lineage_cut(window_starts(hits))
    texts = windows.select("key", "m", "start").distinct().join(read, "key").select(
        "key", "id", "m", "start", words_of(F.col("text")).alias("w")
    ).select("key", "id", "m", "start",
             F.slice("w", F.col("start") + 1, F.col("m") + (size - 1)).alias("w"))
    printed = lineage_cut(
        texts.select("key", "id", "m", "start", gram_hashes(F.col("w"), size).alias("grams"))
        .select("*", simhash(F.col("grams")).alias("fp"), marked(F.col("grams")).alias("set"))
    )
    probe = windows.join(printed.select("key", "start", "m", "fp"), ["key", "start", "m"]).select(
        "key", "start", "m", "fp", "item", F.explode(blocks(F.col("fp"))).alias("e"))
    target = items.select("item", F.col("fp").alias("item_fp"), F.explode(blocks(F.col("fp"))).alias("e"))
    near = (
        probe.join(target, ["item", "e"])
        .withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
        .filter(F.col("hamming") <= RADIUS)
        .select("key", "start", "m", "item", "hamming").distinct()
    )
    both = near.join(printed.select("key", "id", "start", "m", "set"), ["key", "start", "m"]).join(
        items.select("item", "item_id", F.col("set").alias("item_set")), "item"
    )
    shared = both.withColumn("common", F.size(F.array_intersect("set", "item_set")))
    alike = F.col("common") / (F.size("set") + F.size("item_set") - F.col("common"))
    best = F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("s"),
                          (-F.col("hamming")).alias("h")))
    return (
        shared.withColumn("similarity", alike).filter(F.col("similarity") >= THRESHOLD)
        .groupBy("key", "item").agg(best.alias("b"), F.first("id").alias("id"),
                                    F.first("item_id").alias("item_id"))
        .select("key", "id", "item_id", F.col("b.similarity").alias("similarity"),
                (-F.col("b.h")).cast("int").alias("hamming"),
                (-F.col("b.s")).cast("int").alias("first_word"))
    )


def window_starts(hits: DataFrame) -> DataFrame:
    """(key, item, m, start): the windows with enough places that have a shingle of the item.

    ``hits`` has a row (key, item, m, n, pos) for each such place of a text of n shingles. The places of
    one text and item are counted in windows of the item's length (in units of that length, as a
    frame's bounds cannot differ by row). The count is not below what window and item share.
    """
    own = Window.partitionBy("key", "item")
    need = least_shared(F.col("m"), F.least("m", "n"))
    enough = hits.select("*", F.count("*").over(own).alias("all")).filter(F.col("all") >= need)
    counted = enough.select("key", "item", "m", "n", "pos", (F.col("pos") / F.col("m")).alias("at")).select(
        "*", F.expr("count(*) over (partition by key, item order by at "
                    "range between current row and 0.9999995D following)").alias("within"))
    start = F.greatest(F.lit(0), F.least(F.col("pos"), F.col("n") - F.col("m")))
    return counted.filter(F.col("within") >= need).select(
        "key", "item", "m", start.cast("int").alias("start")).distinct()


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """The documents without a match, told apart by id and text; all columns stay, whatever their names."""
    hits = _found(docs, benchmark, id_col, text_col, "item_id", "text")
    bad = lineage_cut(hits.select("key", "id").distinct())
    rows = docs.select(_key(id_col, text_col).alias("key"), quoted(id_col).alias("id"),
                       F.struct(*[quoted(c) for c in docs.columns]).alias("row"))
    same = (rows["key"] == bad["key"]) & rows["id"].eqNullSafe(bad["id"])
    return rows.join(bad, same, "left_anti").select("row.*")
