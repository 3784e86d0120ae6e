"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Targets: every source gets its weight's share of the total, no more than ``max_epochs`` times its own
size; what a capped source cannot take goes to the others by weight, until none is above its cap. With sources in
order of size over weight, the capped ones are a prefix of that order, so one pass over the table of
sources finds the common level in closed form instead of by repetition.

Sampling: a target is so many whole epochs of the source and a fraction of one. The fraction is a
seeded sample of documents, drawn class by class from the largest documents down; each class
takes what is still open, in hash order, and ends at the document that comes nearest. So the total is near
the target even where single documents hold much of a source. Hash order is cut into slices whose sums are added
up first, so that no task ever sees a whole source: only the one slice in which the line falls is
ordered by document. The line is a hash for each source and class, so drawing needs no join by document.

Edge cases: a null source is a source of its own, last in order. Null texts have size 0 and
taken 0. Sources of size 0 have target 0. Repeated rows count and are drawn one by one. An empty
table gives an empty result. Extra columns are carried by ``repeat`` and ignored by ``op10``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siloflow.llm.common import BLANK_CHARS, cut, small, tidy

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Slices of a source's hash order; a power of 16, as slices are leading digits of the hash.
SLICE_DIGITS = 2
#: Classes of documents by size, from the largest down: at least so many words.
CLASSES = (4096, 1024, 256, 64, 0)


def n_words(text: Column) -> Column:
    """The number of words: blanks become one kind, then word starts are counted without making an array."""
    plain = F.translate(F.coalesce(text, F.lit("")), BLANK_CHARS, " " * len(BLANK_CHARS))
    return F.size(F.array_remove(F.split(plain, " "), "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) for a table (source, source_size) with one row for each source."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.lit(float(weights[-1]))
    for i, x in enumerate(weights[:-1]):
        w = F.when(F.pmod(F.col("_i"), F.lit(len(weights))) == i, F.lit(float(x))).otherwise(w)
    ranked = sizes.withColumn("_i", F.row_number().over(order) - 1).withColumn("_w", w)
    every = Window.partitionBy()
    line = Window.orderBy(F.col("_cap") / F.col("_w"), "_i")
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    ranked = ranked.withColumn("_total", F.sum("source_size").over(every) * F.lit(float(share)))
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    after = line.rowsBetween(0, Window.unboundedFollowing)
    # the level if this source and all that fill up later stay below their caps
    ranked = ranked.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    # levels fall after the first source whose share fits under its cap, so that one sets the level of all
    level = F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(every)
    capped = F.least(F.col("_cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("_w"))
    return ranked.select("source", "source_size", capped.alias("target"))


def _class() -> Column:
    out = F.lit(len(CLASSES) - 1)
    for i in range(len(CLASSES) - 2, -1, -1):
        out = F.when(F.col("size") >= CLASSES[i], F.lit(i)).otherwise(out)
    return out


def _named(docs: DataFrame, seed: str) -> DataFrame:
    """Append _sid, _class and _h, from doc_id, source and size."""
    shown = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.col("size").cast("string"))
    return docs.withColumns({"_sid": F.xxhash64(F.col("source").isNull(), "source"), "_class": _class(), "_h": F.md5(shown)})


def _line(rows: DataFrame, slices: DataFrame, wanted: DataFrame) -> DataFrame:
    """Where the line falls in one class: (_sid, _cut, _ties, _got) for rows (_sid, _h, size) and wanted (_sid, open).

    Rows with _h < _cut are in, and _ties of those with _h = _cut (0 unless equal rows lie on the line).
    _got is what all of them hold. A hash followed by g stands right behind that hash.
    """
    upto = Window.partitionBy("_sid").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = slices.withColumn("_before", F.coalesce(F.sum("_sum").over(upto), F.lit(0))).join(wanted, "_sid")
    # at most 16**SLICE_DIGITS rows for each source
    hit = sums.where((F.col("_before") < F.col("open")) & (F.col("_before") + F.col("_sum") > F.col("open")))
    all_in = sums.groupBy("_sid").agg(F.max("open").alias("open"), F.sum("_sum").alias("_got")).where(F.col("_got") <= F.col("open"))
    all_in = all_in.select("_sid", F.lit("g").alias("_cut"), F.lit(0).cast("long").alias("_ties"), "_got")
    near = rows.withColumn("_slice", F.substring("_h", 1, SLICE_DIGITS)).join(hit.select("_sid", "_slice", "_before", "open"), ["_sid", "_slice"])
    near = near.groupBy("_sid", "_slice", "_before", "open", "_h").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    last = Window.partitionBy("_sid", "_slice").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_before") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(last), F.lit(0))
    near = near.withColumn("_k", F.greatest(F.lit(0), F.least(F.col("n"), F.floor((F.col("open") - at) / F.col("size") + 0.5))).cast("long"))
    cut_at = F.max(F.when(F.col("_k") > 0, F.struct("_h", "_k", "n")))
    found = near.groupBy("_sid", "_slice").agg(cut_at.alias("c"), (F.max("_before") + F.sum(F.col("_k") * F.col("size"))).alias("_got"))
    split = F.coalesce(F.col("c._k") < F.col("c.n"), F.lit(False))
    line = F.when(split, F.col("c._h")).otherwise(F.coalesce(F.concat("c._h", F.lit("g")), F.col("_slice")))
    found = found.select("_sid", line.alias("_cut"), F.when(split, F.col("c._k")).otherwise(0).cast("long").alias("_ties"), "_got")
    exact = sums.where(F.col("_before") + F.col("_sum") == F.col("open")).join(all_in, "_sid", "left_anti")
    exact = exact.groupBy("_sid").agg(F.max("_slice").alias("_s"), F.max("open").cast("long").alias("_got"))
    exact = exact.select("_sid", F.concat("_s", F.lit("g")).alias("_cut"), F.lit(0).cast("long").alias("_ties"), "_got")
    return found.unionByName(all_in).unionByName(exact)


@tidy
def plan(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """A row for each source and class: (_sid, _class, source_size, target, _whole, _cut, _ties), _cut null where no document is drawn.

    ``docs`` has doc_id, source and size. Only these and a hash are kept; the result has
    len(CLASSES) rows for each source.
    """
    rows = cut(_named(docs.select("doc_id", "source", "size"), seed).select("source", "_sid", "_class", "_h", "size"))
    sizes = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    planned = targets(sizes, **options).withColumn("_sid", F.xxhash64(F.col("source").isNull(), "source"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    planned = cut(planned.drop("source").withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size")))
    filled = rows.where("size > 0")
    slices = cut(filled.groupBy("_sid", "_class", F.substring("_h", 1, SLICE_DIGITS).alias("_slice")).agg(F.sum("size").alias("_sum")))
    lines = None
    for c in range(len(CLASSES)):
        # the share of this class and all above, less what those above took
        upto = slices.where(F.col("_class") <= c).groupBy("_sid").agg(F.sum("_sum").alias("_upto"))
        wanted = planned.join(upto, "_sid").withColumn("open", F.col("_rest") * F.col("_upto") / F.col("source_size"))
        if lines is not None:
            above = lines.groupBy("_sid").agg(F.sum("_got").alias("_above"))
            wanted = wanted.join(above, "_sid", "left").withColumn("open", F.col("open") - F.coalesce(F.col("_above"), F.lit(0)))
        now = _line(filled.where(F.col("_class") == c), slices.where(F.col("_class") == c), wanted.where("open > 0").select("_sid", "open"))
        now = cut(now.withColumn("_class", F.lit(c)))
        lines = now if lines is None else lines.unionByName(now)
    every = planned.drop("_rest").crossJoin(docs.sparkSession.range(len(CLASSES)).select(F.col("id").cast("int").alias("_class")))
    return cut(every.join(lines.drop("_got"), ["_sid", "_class"], "left"))


@tidy
def draw(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """Append source_size, target and epochs (how often the row is in the mix) to rows with doc_id, source and size."""
    planned = plan(docs, seed, **options)
    n, tied = planned.count(), planned.where("_ties > 0")
    both = _named(docs, seed).join(small(planned, n, 120), ["_sid", "_class"])
    on_line = F.coalesce((F.col("_ties") > 0) & (F.col("_h") == F.col("_cut")), F.lit(False))
    below = F.coalesce(F.col("_h") < F.col("_cut"), F.lit(False))
    # equal hashes are repeated rows; where the line falls among them, they are told apart by a number
    numbered = F.row_number().over(Window.partitionBy("_sid", "_class", "_h").orderBy("_h"))
    away = both.where(~on_line).withColumn("_n", F.lit(0))
    if tied.isEmpty():
        marked = away
    else:
        marked = away.unionByName(both.where(on_line).withColumn("_n", numbered))
    extra = F.when(F.col("_n") > 0, (F.col("_n") <= F.col("_ties")).cast("long")).otherwise(below.cast("long"))
    epochs = F.when(F.col("size") > 0, F.col("_whole") + extra).otherwise(F.lit(0).cast("long"))
    return marked.select(*docs.columns, "source_size", "target", epochs.alias("epochs"))


def repeat(docs: DataFrame, text: str = "text", seed: str = SEED, **options) -> DataFrame:
    """The mix itself: each document as often as its epochs say, with its own columns whatever their names."""
    packed = docs.select(F.struct(*docs.columns).alias("_all"), "doc_id", "source", n_words(F.col(text)).alias("size"))
    drawn = draw(packed, seed, **options)
    return drawn.where("epochs > 0").withColumn("_e", F.explode(F.sequence(F.lit(1).cast("long"), F.col("epochs")))).select("_all.*")


def op10(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    sized = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    return draw(sized).select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size")).alias("taken"))
