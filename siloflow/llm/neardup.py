"""Near-duplicate documents by a chosen-path set similarity join.

Every text becomes the set of its distinct word shingles; equal sets are one class, found by exact
grouping, and only class representatives go on. A representative carries HASHES MinHash values. In
each of many independent trees a node chooses, from its own path, which MinHash values its members
branch on; members that agree go to the same child. Two sets of similarity s stay together with
chance s for each step, so a pair at the threshold is missed by all trees, over all levels of branching,
with a chance that ``missed`` states and that the number of trees is chosen by.

Members of a node are first compared with its head, the member that meets most others; the confirmed ones
bear one root from then on. Heads are taken anew, from outside the largest root, as long as that connects many.
What is left of a node is compared exhaustively where that takes at most NODE_PAIRS comparisons, else its members branch on.
A comparison is an expression of the join itself, and the join gives only pairs that can still be links: sizes, one bit of each
MinHash value, and an odd sketch: ODD_BITS parities of the set's hashes. Each parity in which two sketches
differ stands for at least one shingle that only one set has, so the count of them is a bound that loses no link; for long
texts, where parities cancel, the expected count and its spread give the tighter one.

Each pair that is left is confirmed on the full sets of the two texts. Components are then found by
alternating star contractions, all of it in tables.

Edge cases: null texts and texts without words have an empty set, link with nothing and stand alone
(component_id = doc_id, kept). A null doc_id takes part in links; its component is named by the least
non-null id, and null if there is none. Repeated rows have one class and, having one doc_id, get a
row each with the same answer. Empty tables give empty results. Extra columns are ignored by
``components`` and carried by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, comb, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siloflow.llm.common import cut, fits_broadcast, sieved, small, tidy

HASHES = 192
#: Similarity that unrelated texts stay below; the first look at a node comes after so many values that these rarely meet.
BACKGROUND = 0.1
LEAST_DEPTH = 4
#: Large nodes branch into paths of STEP more values each, for LEVELS times at most; so many that a pair at the threshold is
#: expected to stay together in SURVIVING of them.
STEP = 4
SURVIVING = 4
LEVELS = 2
#: Comparisons that are made at once in a node; what is larger branches on, until the last level.
NODE_PAIRS = 1 << 21
#: Nodes with more members outside their largest root get a further head, while the last ones connected a share GAIN of these members.
MANY = 32
GAIN = 0.1
MISS = 1e-6
#: Parities of an odd sketch, and spreads that a count of differing parities may lie above what is expected at the threshold.
ODD_BITS = 1024
SPREADS = 6.5
#: Bytes of a text that are hashed at once.
PIECE = 1 << 22
#: Counted tables of up to so many rows are kept in one partition while components are contracted.
FEW_ROWS = 200_000


@dataclass(frozen=True)
class Spec:
    """What a set is and when two sets are linked: num * |A and B| >= den * |A or B|, as whole numbers."""

    k: int = 5
    num: int = 100
    den: int = 80

    @property
    def threshold(self) -> float:
        return self.den / self.num

    @property
    def most_differences(self) -> int:
        """Of HASHES one-bit MinHash values, so many differ at most for a pair at the threshold, but for a chance of MISS / 10."""
        p, below = (1 - self.threshold) / 2, 1.0
        for i in range(HASHES + 1):
            below -= comb(HASHES, i) * p**i * (1 - p) ** (HASHES - i)
            if below <= MISS / 10:
                return i
        return HASHES


# ---- sets of hashed shingles, vectorised over a batch of texts

_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pieces(data: bytes) -> Iterator[bytes]:
    """The bytes in pieces that end at a blank."""
    at = 0
    while len(data) - at > PIECE:
        end = at + PIECE
        while end < len(data) and not _BLANK[data[end]]:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each blank-separated word: the sum of its bytes' values, each mixed with its place in the word."""
    out = []
    for piece in _pieces(data):
        b = np.frombuffer(piece, dtype=np.uint8)
        at = np.flatnonzero(~_BLANK[b])
        if not len(at):
            continue
        first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        length = np.diff(first, append=len(at))
        place = (np.arange(len(at)) - np.repeat(first, length)).astype(np.uint64)
        total = np.add.reduceat(_mix(_TABLE[b[at]] + place * _ODD), first)
        out.append(_mix(total + length.astype(np.uint64)))
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's k-word shingles; fewer words make one shingle."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(w):
        return w
    n = max(1, len(w) - k + 1)
    h = np.full(n, min(k, len(w)), dtype=np.uint64)
    for i in range(min(k, len(w))):
        h = _mix(h * _ODD + w[i : n + i])
    return np.unique(h)


_SEEDS = np.random.default_rng(7).integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SALTS = np.random.default_rng(8).integers(0, 2**32, HASHES, dtype=np.uint32)
SKETCH = tuple(f"k{i}" for i in range(HASHES // 64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of 32 bits."""
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    block = 512  # so that the products stay in the processor's cache
    for at in range(0, len(short), block):
        part = (short[None, at : at + block] ^ _SALTS[:, None]) * _SEEDS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def sketch(sig: np.ndarray) -> list[int]:
    """One bit of each MinHash value, in longs."""
    bits = (_mix(sig.astype(np.uint64)) & np.uint64(1)).reshape(-1, 64) << np.arange(64, dtype=np.uint64)
    return [int(x) for x in np.bitwise_or.reduce(bits, axis=1).view(np.int64)]


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """ODD_BITS parities: how many of the hashes fall to each place, even or odd, in longs."""
    odd = np.bincount((hashes % np.uint64(ODD_BITS)).astype(np.int64), minlength=ODD_BITS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


ODD = tuple(f"o{i}" for i in range(ODD_BITS // 64))
SET_SCHEMA = "n_shingles long, set_key binary, sig binary, " + ", ".join(f"{k} long" for k in SKETCH)


def with_sets(docs: DataFrame, k: int) -> DataFrame:
    """Replace ``text`` by n_shingles, a 128-bit fingerprint of the set, its MinHash values and their bits; null for empty sets."""

    @F.pandas_udf(SET_SCHEMA)
    def described(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for text in s:
                h = shingle_set(text, k)
                if len(h):
                    key = np.array([_mix(h).sum(dtype=np.uint64), _mix(h ^ _ODD).sum(dtype=np.uint64) + np.uint64(len(h))])
                    sig = signature(h)
                    rows.append((len(h), key.tobytes(), sig.tobytes(), *sketch(sig)))
                else:
                    rows.append((0, None, None, *(0 for _ in SKETCH)))
            yield pd.DataFrame(rows, columns=["n_shingles", "set_key", "sig", *SKETCH])

    return docs.withColumn("_s", described("text")).select(*(c for c in docs.columns if c != "text"), "_s.*")


# ---- paths through the trees


def first_depth(n: int) -> int:
    """So many values that two unrelated sets of n rarely share them all."""
    return max(LEAST_DEPTH, ceil(log(max(n, 2)) / log(1 / BACKGROUND)))


def children_for(threshold: float) -> int:
    return ceil(SURVIVING / threshold**STEP)


def missed(threshold: float, depth: int, trees: int) -> float:
    """Chance that a pair at the threshold meets in no tree, if every node it is in is large for all LEVELS.

    All trees draw on the same HASHES values, of which a pair shares a binomial number: the chance is
    averaged over it.
    """
    agree = np.arange(HASHES + 1) / HASHES
    spread = np.array([float(comb(HASHES, i)) * threshold**i * (1 - threshold) ** (HASHES - i) for i in range(HASHES + 1)])
    lost = np.zeros(HASHES + 1)  # by a tree's levels so far, seen from their top
    for _ in range(LEVELS):
        lost = (1 - agree**STEP * (1 - lost)) ** children_for(threshold)
    return float(spread @ (1 - agree**depth * (1 - lost)) ** trees)


def trees_for(threshold: float, depth: int, miss: float = MISS) -> int:
    """The least number of trees in which a pair at the threshold is missed with a chance of ``miss`` at most, over all levels."""
    if (1 - threshold) ** HASHES > miss / 2:
        raise ValueError(f"{HASHES} values are too few for a threshold of {threshold}")
    most = 1
    while missed(threshold, depth, most) > miss:
        most *= 2
    least = most // 2 + 1
    while least < most:
        middle = (least + most) // 2
        least, most = (least, middle) if missed(threshold, depth, middle) <= miss else (middle + 1, most)
    return most


def _walk(path: np.ndarray, sig: np.ndarray, steps: int) -> np.ndarray:
    """Extend paths (sets x branches) by ``steps`` values, each chosen by the path so far."""
    own = np.arange(len(sig))[:, None]
    for _ in range(steps):
        chosen = (_mix(path + _ODD) % np.uint64(HASHES)).astype(np.int64)
        path = _mix(path ^ (sig[own, chosen].astype(np.uint64) << np.uint64(16)))
    return path


def _matrix(sigs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), dtype=np.uint32).reshape(len(sigs), HASHES)


def _lists(path: np.ndarray) -> pd.Series:
    return pd.Series(list(path.view(np.int64)))


def roots(trees: int, depth: int):
    @F.pandas_udf("array<long>")
    def nodes(sigs: pd.Series) -> pd.Series:
        if not len(sigs):
            return pd.Series([], dtype=object)
        start = np.broadcast_to(_mix(np.arange(1, trees + 1, dtype=np.uint64) * _ODD), (len(sigs), trees))
        return _lists(_walk(start, _matrix(sigs), depth))

    return nodes


def children(branches: int):
    @F.pandas_udf("array<long>")
    def nodes(node: pd.Series, sigs: pd.Series) -> pd.Series:
        if not len(sigs):
            return pd.Series([], dtype=object)
        start = _mix(node.to_numpy().astype(np.int64).view(np.uint64)[:, None] + np.arange(1, branches + 1, dtype=np.uint64)[None, :] * _ODD)
        return _lists(_walk(start, _matrix(sigs), STEP))

    return nodes


# ---- the join


def measure(pairs: DataFrame, sets: DataFrame, spec: Spec) -> DataFrame:
    """(a, b, linked) of distinct pairs (a, b), from the full sets (cid, n, items)."""
    n = pairs.count()
    left = sets.select(F.col("cid").alias("a"), F.col("n").alias("an"), F.col("items").alias("_p")).join(small(pairs, n, 64), "a")
    both = left.join(sets.select(F.col("cid").alias("b"), F.col("n").alias("bn"), F.col("items").alias("_q")), "b")
    m = F.size(F.array_intersect("_p", "_q"))
    return both.select("a", "b", (spec.num * m >= spec.den * (F.col("an") + F.col("bn") - m)).alias("linked"))


def _differing(spec: Spec, p, q):
    """The most parities that differ between linked sets of sizes p and q."""
    most = (p + q) * float(spec.num - spec.den) / float(spec.num + spec.den)  # shingles that only one of the sets has
    expected = ODD_BITS / 2 * (1 - F.exp(most * (-2 / ODD_BITS)))
    spread = F.sqrt(ODD_BITS / 4 * (1 - F.exp(most * (-4 / ODD_BITS))))
    return F.least(most + 1e-6, expected + SPREADS * spread + 1)


def _close(spec: Spec, a: str, b: str):
    """Whether sizes, bits and odd sketches leave the pair a chance; a and b are the prefixes of either side's columns."""
    apart = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    bits = sum((apart(f"{a}{k}", f"{b}{k}") for k in SKETCH), F.lit(0))
    odd = sum((apart(f"{a}{k}", f"{b}{k}") for k in ODD), F.lit(0))
    p, q = F.col(f"{a}n"), F.col(f"{b}n")
    return (spec.num * F.least(p, q) >= spec.den * F.greatest(p, q)) & (bits <= spec.most_differences) & (odd <= _differing(spec, p, q))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs with the lesser first."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()


def _together(df: DataFrame, n: int) -> DataFrame:
    """Counted few rows in one partition, where grouping and joining take no shuffle; more are left as they are."""
    return df.coalesce(1) if n <= FEW_ROWS else df


def components(links: DataFrame) -> DataFrame:
    """(cid, root) of everything in links (a, b), distinct: the least that can be reached, by alternating large and small stars."""
    edges, before = cut(links), None
    n = edges.count()
    while True:
        # large star: the larger neighbours of a node are tied to its least neighbour
        held = _together(edges, n)
        both = held.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(held.select(F.col("b").alias("u"), F.col("a").alias("v")))
        both = _together(both, n)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = cut(_ordered(both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))))
        # small star: a node and its smaller neighbours are tied to the least of them
        held = _together(edges, n)
        least = held.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        tied = held.join(least, held["b"] == least["u"]).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b2")).withColumnRenamed("b2", "b")
        edges = cut(_ordered(tied))
        now = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
        if now == before:
            tops = edges.select("a").distinct()
            return edges.select(F.col("b").alias("cid"), F.col("a").alias("root")).unionByName(tops.select(F.col("a").alias("cid"), F.col("a").alias("root")))
        before, n = now, now["n"]


class Forest:
    """Who is known to be connected: (cid, root), grown by confirmed links; only pairs of roots go through a contraction."""

    def __init__(self) -> None:
        self.roots: DataFrame | None = None
        self.n = 0

    def named(self, df: DataFrame, column: str, into: str) -> DataFrame:
        """Add the root of a column; what is not connected is its own."""
        if self.roots is None:
            return df.withColumn(into, F.col(column))
        known = small(self.roots.select(F.col("cid").alias(column), F.col("root").alias("_r")), self.n, 16)
        return df.join(known, column, "left").withColumn(into, F.coalesce("_r", F.col(column))).drop("_r")

    def grow(self, links: DataFrame) -> None:
        pairs = self.named(self.named(links, "a", "ra"), "b", "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        new = cut(_ordered(pairs))
        if new.isEmpty():
            return
        more = cut(components(new)).select(F.col("cid").alias("old"), F.col("root").alias("new"))
        if self.roots is None:
            self.roots = cut(more.select(F.col("old").alias("cid"), F.col("new").alias("root")))
        else:
            held = self.roots.select("cid", F.col("root").alias("old")).unionByName(more.select(F.col("old").alias("cid"), "old"))
            moved = held.join(small(more, more.count(), 16), "old", "left").select("cid", F.coalesce("new", "old").alias("root"))
            self.roots = cut(moved.distinct())
        self.n = self.roots.count()


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cid, n, items, o0 and on): the full sets and odd sketches of the classes whose representative is named in wanted (cid, doc_id, _t1)."""

    @F.pandas_udf("items array<long>, odd array<long>")
    def described(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, k) for t in texts]
        return pd.DataFrame({"items": pd.Series([h.view(np.int64) for h in sets], dtype=object), "odd": pd.Series([odd_sketch(h) for h in sets], dtype=object)})

    n = wanted.count()
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("_t1"))
    if not fits_broadcast(n, 128):
        named = sieved(named, wanted, lambda: F.xxhash64("doc_id", "_t1"))
    key = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d._t1") == F.col("w._t1"))
    found = named.alias("d").join(small(wanted, n, 128).alias("w"), key).select("w.cid", "d.text").dropDuplicates(["cid"])
    return cut(found.select("cid", described("text").alias("_s")).select("cid", F.size("_s.items").alias("n"), "_s.items", *(F.col("_s.odd")[i].alias(k) for i, k in enumerate(ODD))))


def _unresolved(forest: Forest, members: DataFrame) -> DataFrame:
    """(node, cid, lab, hlab, n, rest): members of the nodes of several roots, with their own root, the root that most bear, the node's members and those of other roots."""
    named = forest.named(members.select("node", "cid"), "cid", "lab")
    per = named.groupBy("node", "lab").agg(F.count("*").alias("m"))
    state = per.groupBy("node").agg(F.max(F.struct("m", "lab")).alias("t"), F.sum("m").alias("n")).where(F.col("n") > F.col("t.m"))
    state = cut(state.select("node", F.col("t.lab").alias("hlab"), "n", (F.col("n") - F.col("t.m")).alias("rest")))
    return cut(named.join(small(state, state.count(), 96), "node"))


def join_classes(classes: DataFrame, docs: DataFrame, spec: Spec) -> Forest:
    """The components of the classes (cid, n_shingles, sig, the bits, doc_id, _t1).

    Members of a node bear the roots known so far; pairs of one root, and nodes of one root, need no look.
    No pair is confirmed twice.
    """
    n_classes = classes.count()
    depth = first_depth(n_classes)
    start = roots(trees_for(spec.threshold, depth), depth)
    branch = children(children_for(spec.threshold))
    members = classes.select("cid", F.explode(start("sig")).alias("node"))  # computed twice rather than written
    forest, sets, tested, met, n_met = Forest(), None, None, None, 0
    facts = lambda p: small(met.select(*(F.col(c).alias(f"{p}{c}" if c != "cid" else p) for c in ("cid", "n", *SKETCH, *ODD))), n_met, 512)

    def confirmed(pairs: DataFrame) -> None:
        nonlocal tested
        pairs = cut(pairs if tested is None else pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"))
        found = cut(measure(pairs, sets, spec))
        tested = found if tested is None else tested.unionByName(found)
        links = found.where("linked").select("a", "b")
        if not links.isEmpty():
            forest.grow(links)

    for level in range(LEVELS + 1):
        nodes = cut(members.groupBy("node").agg(F.count("*").alias("size")).where("size > 1").select("node"))
        members = cut(members.join(small(nodes, nodes.count(), 64), "node").select("node", "cid"))
        if members.isEmpty():
            break
        if sets is None:
            ids = cut(members.select("cid").distinct())
            of = classes.join(small(ids, ids.count(), 64), "cid")
            sets = _sets_of(docs, cut(of.select("cid", "doc_id", "_t1")), spec.k)
            met = cut(sets.select("cid", "n", *ODD).join(of.select("cid", "sig", *SKETCH), "cid"))
            n_met = met.count()
        open_, rest = _unresolved(forest, members), None
        while True:
            # a node's head is the member that meets most others over all nodes, so likely the one the others were edited from
            central = open_.groupBy("cid").agg(F.sum("n").alias("met"))
            outside = open_.where("lab <> hlab").join(central, "cid")
            heads = outside.groupBy("node").agg(F.max(F.struct("met", "cid")).alias("h")).select("node", F.col("h.cid").alias("head"))
            stars = _ordered(open_.join(heads, "node").select(F.col("cid").alias("a"), F.col("head").alias("b")))
            confirmed(stars.join(facts("a"), "a").join(facts("b"), "b").where(_close(spec, "a", "b")).select("a", "b"))
            open_ = _unresolved(forest, open_)
            before, rest = rest, open_.where(F.col("rest") > MANY).agg(F.coalesce(F.sum(F.when(F.col("lab") != F.col("hlab"), 1)), F.lit(0)).alias("n")).first()["n"]
            if not rest or before is not None and rest > (1 - GAIN) * before:
                break
        last = level == LEVELS
        fits = F.lit(True) if last else F.col("rest") * F.col("n") <= NODE_PAIRS
        now = open_.where(fits)
        one = now.where("lab <> hlab").select("node", F.col("cid").alias("a"), F.col("lab").alias("la"), "hlab").join(facts("a"), "a")
        two = now.select("node", F.col("cid").alias("b"), F.col("lab").alias("lb")).join(facts("b"), "b")
        # a pair of two members outside the largest root comes once
        across = one.join(two, "node").where((F.col("la") != F.col("lb")) & ((F.col("lb") == F.col("hlab")) | (F.col("a") < F.col("b"))) & _close(spec, "a", "b"))
        confirmed(_ordered(across.select("a", "b")))
        large = cut(open_.where(~fits).select("cid", "node"))
        if last or large.isEmpty():
            break
        members = large.join(small(met.select("cid", "sig"), n_met, 1024), "cid").select("cid", F.explode(branch("node", "sig")).alias("node"))
    return forest


# ---- results


@tidy
def with_components(docs: DataFrame, spec: Spec) -> DataFrame:
    """(doc_id, _t1, n_shingles, component_id, first) for every row of docs (doc_id, text).

    ``first`` marks the rows that stay if one document of each component does: those with its least id and text hash.
    """
    told = cut(with_sets(docs.select("doc_id", F.xxhash64("text").alias("_t1"), "text"), spec.k))
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_t1")).alias("r")
    every = told.where(F.col("set_key").isNotNull()).groupBy(F.col("set_key").alias("key"))
    classes = every.agg(lead, *(F.first(c).alias(c) for c in ("n_shingles", "sig", *SKETCH)))
    # a number for each class, fixed by writing it
    classes = cut(classes.select(F.monotonically_increasing_id().alias("cid"), "key", "n_shingles", "sig", *SKETCH, "r.doc_id", "r._t1", "r"))
    forest = join_classes(classes, docs, spec)
    rooted = cut(forest.named(classes.select("cid", "key", "r"), "cid", "root").select("key", "root", "r"))
    least = cut(rooted.groupBy("root").agg(F.min("r").alias("c")))
    answer = cut(rooted.join(least, "root").select("key", F.col("c.doc_id").alias("component_id"), F.col("c._t1").alias("_c1")))
    told = cut(told.select("doc_id", "_t1", "n_shingles", "set_key"))  # without the signatures
    out = told.join(answer, told["set_key"] == answer["key"], "left")
    first = F.col("key").isNull() | (F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("_t1").eqNullSafe(F.col("_c1")))
    return out.select("doc_id", "_t1", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), first.alias("first"))


@tidy
def op8(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: three-word shingles, linked at 85 of 100."""
    got = with_components(docs.select("doc_id", "text"), Spec(k=3, num=100, den=85))
    return got.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@tidy
def keep_one(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """The documents with one of each component left, the one with the least doc_id; of repeated rows one stays.

    Documents without words are all kept. Null ids yield to any other id of their component. All columns stay.
    """
    got = cut(with_components(docs.select("doc_id", "text"), spec))
    gone = cut(got.where(~F.col("first")).select("doc_id", "_t1").distinct())
    again = cut(got.where(F.col("first") & (F.col("n_shingles") > 0)).groupBy("doc_id", "_t1").count().where("count > 1").select("doc_id", "_t1"))
    key = F.col("d._id").eqNullSafe(F.col("g.doc_id")) & F.col("d._x").eqNullSafe(F.col("g._t1"))
    named = docs.select(F.struct(*docs.columns).alias("_all"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_x"))
    left = named.alias("d").join(small(gone, gone.count(), 32).alias("g"), key, "left_anti")
    n_again = again.count()
    if n_again:
        twice = small(again, n_again, 32).alias("g")
        once = left.alias("d").join(twice, key, "left_semi").groupBy("_id", "_x").agg(F.first("_all").alias("_all"))
        left = left.alias("d").join(twice, key, "left_anti").select("_all").unionByName(once.select("_all"))
    return left.select("_all.*")
