"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

Test items are partitioned by the size of their shingle set. An item of up to SLOTS shingles is
searched by all of them; a larger one by a sketch of SLOTS MinHash slots, each slot being the item's
shingle with the least hash under its own function. The share of slots whose shingle occurs in
a document estimates containment without bias, whatever the document's length, which the ratio
of plain MinHash signatures does not. An item is a candidate when so many of its slots are hit that a
pair at the threshold is missed with a chance below MISS. Documents with a candidate are read again
and verified: the item's shingles that occur in the document, counted on the words themselves.

All runs of words, of every length that items have, come from one pass over a text. The sketch table meets them
inside the scan stage while its counted size stays below the broadcast bound, and then on the words. Beyond it the join is shuffled:
of a document only its key and two hashes of each run move, and of these only those that a sieve of the sketch table's
hashes of fixed size lets through. What is shuffled then is one row for each hit, pre-aggregated.

Edge cases: null or empty texts, on either side, match nothing. An item with fewer than K words is
one shingle of all its words. Repeated item rows count once; repeated documents give one result row
for each pair of ids, and ``clean`` keeps or drops all copies alike. Null ids are kept as null.
Empty tables give empty results. Extra columns are carried by ``clean`` and ignored elsewhere.
"""

from __future__ import annotations

from math import ceil, comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siloflow.llm.common import cut, fits_broadcast, lower_ascii, sieved, small, text_key, tidy, words

K = 5
THRESHOLD = 0.8
SLOTS = 16
MISS = 1e-6
DOC = ["doc_id", "_t1", "_t2"]


def least_hits(slots: int, threshold: float, miss: float = MISS) -> int:
    """The largest r for which a pair at the threshold hits fewer than r slots with a chance of ``miss`` at most."""
    below, r = 0.0, 0
    while r < slots:
        below += comb(slots, r) * threshold**r * (1 - threshold) ** (slots - r)
        if below > miss:
            break
        r += 1
    return max(r, 1)


def item_shingles(bench: DataFrame, k: int = K) -> DataFrame:
    """(item_id, _t1, _t2, k, size, shingle): the distinct shingles of each distinct item, as words joined by blanks."""
    w = words(lower_ascii(F.col("text")))
    items = bench.where(F.col("text").isNotNull()).select("item_id", *text_key(F.col("text")), w.alias("_w")).where(F.size("_w") > 0).dropDuplicates(["item_id", "_t1", "_t2"])
    items = items.withColumn("k", F.least(F.lit(k), F.size("_w")))
    parts = F.transform(F.sequence(F.lit(0), F.size("_w") - F.col("k")), lambda i: F.array_join(F.slice("_w", i + 1, F.col("k")), " "))
    items = items.withColumn("_s", F.array_distinct(parts))
    return items.select("item_id", F.col("_t1").alias("_i1"), F.col("_t2").alias("_i2"), "k", F.size("_s").alias("size"), F.explode("_s").alias("shingle"))


def sketches(shingles: DataFrame, threshold: float = THRESHOLD, slots: int = SLOTS) -> DataFrame:
    """(item, k, size, need, shingle, weight): what each item is searched by, and the weight of hits it needs.

    The size class decides: up to ``slots`` shingles all of them serve, above that the MinHash slots.
    """
    item = ["item_id", "_i1", "_i2", "k", "size"]
    few = shingles.where(F.col("size") <= slots).select(*item, F.ceil(F.col("size") * threshold - 1e-9).cast("int").alias("need"), "shingle", F.lit(1).alias("weight"))
    many = shingles.where(F.col("size") > slots).select(*item, "shingle", F.explode(F.sequence(F.lit(1), F.lit(slots))).alias("slot"))
    least = many.groupBy(*item, "slot").agg(F.min_by("shingle", F.xxhash64("slot", "shingle")).alias("shingle"))
    least = least.groupBy(*item, "shingle").agg(F.count("*").cast("int").alias("weight"))
    return few.unionByName(least.withColumn("need", F.lit(least_hits(slots, threshold))))


def doc_shingles(docs: DataFrame, keys: list[str], ks: list[int]) -> DataFrame:
    """(keys, _w, _i, k, _h): every run of k words of every text, for all ks, within the scan stage."""
    cut_up = docs.select(*keys, words(lower_ascii(F.col("text"))).alias("_w")).where(F.size("_w") >= min(ks))
    if len(ks) == 1:
        placed = cut_up.select(*keys, "_w", F.explode(F.sequence(F.lit(0), F.size("_w") - ks[0])).alias("_i"), F.lit(ks[0]).alias("k"))
    else:
        placed = cut_up.select(*keys, "_w", F.explode(F.sequence(F.lit(0), F.size("_w") - min(ks))).alias("_i"))
        placed = placed.select("*", F.explode(F.array(*map(F.lit, ks))).alias("k")).where(F.col("_i") + F.col("k") <= F.size("_w"))
    return placed.withColumn("_h", F.xxhash64("k", *_run(ks)))


def _run(ks: list[int]) -> list[Column]:
    """The k words from _i on; null beyond them."""
    return [F.get("_w", F.col("_i") + j) if j < min(ks) else F.when(F.col("k") > j, F.get("_w", F.col("_i") + j)) for j in range(max(ks))]


def _meet(docs: DataFrame, table: DataFrame, n_rows: int, ks: list[int], threshold: float, exact: bool) -> DataFrame:
    """The table's shingles (k, size, shingle, ...) that occur in each document, once for each occurrence.

    A shuffled join that need not be exact compares 128 bits of hashes.
    """
    said = F.split("shingle", " ")
    parts = [F.get(said, F.lit(j)) for j in range(max(ks))]
    own = table.withColumn("_h", F.xxhash64("k", *parts))
    runs, phrase = doc_shingles(docs, DOC, ks), F.concat_ws(" ", *_run(ks))
    large = F.col("_n") - (F.col("k") - 1) >= F.col("size") * threshold - 1e-9
    if fits_broadcast(n_rows, 256):
        met = runs.withColumn("_n", F.size("_w")).join(F.broadcast(own), ["k", "_h"]).where((phrase == F.col("shingle")) & large)
    else:
        runs = sieved(runs, own, lambda: F.col("_h"))
        if exact:
            met = runs.select(*DOC, F.size("_w").alias("_n"), "k", phrase.alias("shingle")).join(own, ["k", "shingle"]).where(large)
        else:
            met = runs.select(*DOC, F.size("_w").alias("_n"), "k", "_h", F.xxhash64(F.lit(7), *_run(ks)).alias("_g"))
            met = met.join(own.withColumn("_g", F.xxhash64(F.lit(7), *parts)), ["k", "_h", "_g"]).where(large)
    return met.select(*DOC, *table.columns)


@tidy
def search(docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD, k: int = K, slots: int = SLOTS) -> DataFrame:
    """(doc_id, _t1, _t2, item_id, n_shared, n_shingles, containment) of every document and item at or above the threshold."""
    shingles = cut(item_shingles(bench, k))
    sketch = cut(sketches(shingles, threshold, slots))
    counted = shingles.groupBy("k").count().collect()  # at most K rows
    ks, n_shingles, n_sketch = sorted(r["k"] for r in counted) or [k], sum(r["count"] for r in counted), sketch.count()
    docs = docs.where(F.col("text").isNotNull()).select("doc_id", *text_key(F.col("text")), "text")
    item = ["item_id", "_i1", "_i2", "size"]

    hits = _meet(docs, sketch, n_sketch, ks, threshold, False).groupBy(*DOC, *item, "need", "shingle").agg(F.max("weight").alias("weight"))
    candidates = hits.groupBy(*DOC, *item, "need").agg(F.sum("weight").alias("hit")).where(F.col("hit") >= F.col("need"))
    candidates = cut(candidates.select(*DOC).distinct())

    wanted = [F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}")) for c in DOC]
    suspects = docs.alias("d").join(small(candidates, candidates.count(), 64).alias("c"), wanted, "left_semi")
    shared = _meet(suspects, shingles, n_shingles, ks, threshold, True).groupBy(*DOC, *item, "shingle").agg(F.lit(1).alias("one"))
    found = shared.groupBy(*DOC, *item).agg(F.count("*").alias("n_shared"))
    found = found.withColumn("containment", F.col("n_shared") / F.col("size")).where(F.col("n_shared") >= F.col("size") * threshold - 1e-9)
    return found.select(*DOC, "item_id", "n_shared", F.col("size").cast("long").alias("n_shingles"), "containment")


@tidy
def clean(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The documents that hold no test item; all columns stay."""
    dirty = cut(search(docs, bench, **options).select(*DOC).distinct())
    named = docs.select(F.struct(*docs.columns).alias("_all"), "doc_id", *text_key(F.col("text")))
    wanted = [F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}")) for c in DOC]
    return named.alias("d").join(small(dirty, dirty.count(), 64).alias("c"), wanted, "left_anti").select("_all.*")


def op2(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment: one row for each pair of ids, its best containment."""
    best = F.max(F.struct("containment", "n_shared", "n_shingles"))
    pairs = search(docs, bench).groupBy("doc_id", "item_id").agg(best.alias("b"))
    return pairs.select("doc_id", "item_id", "b.n_shared", "b.n_shingles", "b.containment")
