"""Logistic models over sites: local, federated-averaged and pooled, many experiments at once.

An experiment is a cell; all cells advance one round in one Spark job, keyed by (cell, site). What
leaves a site is an aggregate: weighted parameters, loss sums, moments. Mini-batch descent depends on order, each step on the one before, so
a site's rows pass through one task as a sorted stream of Arrow batches: an epoch's order is that of a hash of
the row, the epoch and the seed, sorting spills to disk, and no more than a batch is in memory, however large the site is. The steps are the same at every size. Full-batch
steps (with noise, or with a batch that no site fills, an epoch is one), objectives, clipped sums and the Newton optimum are plain aggregates: no order, no sorting, all tasks at once.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siloflow.operators import features as X
from siloflow.operators import metrics as M
from siloflow.privacy import accounting, wire
from siloflow.privacy.secagg import Aggregator, ProtocolError, Site

log = logging.getLogger(__name__)

#: Parameters whose objective is taken in one aggregate, and the gap below which a training has converged.
STRETCH, NEAR = 20, 1e-3
#: What a site may be asked for.
ALLOWED = ("moments", "train", "loss")


@dataclass(frozen=True)
class Config:
    rounds: int = 60
    epochs: int = 2
    rate: float = 0.2
    batch: int = 16
    l2: float = 0.05
    prox: float = 0.0
    weighting: str = "n_samples"
    folds: int = 5
    repeats: int = 3
    seed: int = 0

    def __post_init__(self) -> None:
        if self.weighting not in ("n_samples", "uniform"):
            raise ValueError("weighting must be n_samples or uniform")


# ---- the model as column expressions


def logit(names: list[str], theta: Iterable[float | Column]) -> Column:
    theta = [t if isinstance(t, Column) else F.lit(float(t)) for t in theta]
    return sum((F.col(n) * t for n, t in zip(names, theta, strict=False)), theta[-1])


def predicted(z: Column) -> Column:
    return F.when(z >= 0, 1.0 / (1.0 + F.exp(-z))).otherwise(F.exp(z) / (1.0 + F.exp(z)))


def loss(z: Column, y: Column) -> Column:
    """log(1 + e**z) - y z without overflow."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z


def gradient_sums(rows: DataFrame, names: list[str], y: str, theta: list[float] | list[Column], *by: str, clip: float | Column | None = None) -> DataFrame:
    """(by, n, g_0 ... g_d): sums of the rows' gradients, each first clipped to a norm if that is given (and not null); the last is the bias."""
    r = predicted(logit(names, theta)) - F.col(y).cast("double")
    rows = rows.withColumn("_r", r)
    parts = [F.col("_r") * F.col(n) for n in names] + [F.col("_r")]
    if clip is not None:
        norm = F.sqrt(sum((p * p for p in parts), F.lit(0.0)))
        rows = rows.withColumn("_c", F.greatest(F.lit(1.0), norm / clip))
        parts = [p / F.col("_c") for p in parts]
    return rows.groupBy(*by).agg(F.count("*").cast("double").alias("n"), *(F.sum(p).alias(f"g_{i}") for i, p in enumerate(parts)))


def objective(rows: DataFrame, names: list[str], y: str, theta: list[float], l2: float) -> float:
    """Mean loss plus half of l2 times the squared weights, the bias free."""
    mean = rows.agg(F.avg(loss(logit(names, theta), F.col(y).cast("double")))).first()[0]
    return float(mean) + 0.5 * l2 * float(np.dot(theta[:-1], theta[:-1]))


def optimum(rows: DataFrame, names: list[str], y: str, l2: float, steps: int = 30, tol: float = 1e-10) -> np.ndarray:
    """The exact minimiser by Newton's method; each step is one aggregate of (d+1)(d+2)/2 sums."""
    d = len(names) + 1
    theta, penalty = np.zeros(d), np.array([l2] * (d - 1) + [0.0])
    cols = [F.col(n) for n in names] + [F.lit(1.0)]
    for _ in range(steps):
        p = predicted(logit(names, theta))
        at = rows.withColumns({"_r": p - F.col(y).cast("double"), "_h": p * (1.0 - p)})
        sums = [F.sum(F.col("_r") * c) for c in cols] + [F.sum(F.col("_h") * cols[i] * cols[j]) for i in range(d) for j in range(i, d)]
        n, *v = at.agg(F.count("*"), *sums).first()
        g = np.array(v[:d]) / n + penalty * theta
        h = np.zeros((d, d))
        h[np.triu_indices(d)] = np.array(v[d:]) / n
        h = h + np.triu(h, 1).T + np.diag(penalty) + 1e-10 * np.eye(d)
        step = np.linalg.solve(h, g)
        theta = theta - step
        if np.linalg.norm(step) < tol:
            break
    return theta


# ---- local training


class Descent:
    """Epochs of mini-batch descent over rows that come in pieces; with noise, one full-batch step of clipped gradients an epoch.

    A batch's gradient is summed up as its rows come, so a batch may be larger than a piece.
    """

    def __init__(self, theta: np.ndarray, cfg: Config, rng: np.random.Generator, noise: accounting.Noise | None = None):
        self.theta, self.start, self.cfg, self.rng, self.noise = theta.copy(), theta.copy(), cfg, rng, noise
        self.free = np.array([1.0] * (len(theta) - 1) + [0.0])
        self.total, self.n = np.zeros(len(theta)), 0

    def feed(self, x: np.ndarray, y: np.ndarray) -> None:
        x1 = np.column_stack([x, np.ones(len(y))])
        at = 0
        while at < len(y):
            end = len(y) if self.noise else min(len(y), at + self.cfg.batch - self.n)
            z = np.clip(x1[at:end] @ self.theta, -500, 500)
            g = (1 / (1 + np.exp(-z)) - y[at:end])[:, None] * x1[at:end]
            if self.noise:
                g /= np.maximum(1.0, np.linalg.norm(g, axis=1, keepdims=True) / self.noise.clip)
            self.total += g.sum(axis=0)
            self.n += end - at
            at = end
            if not self.noise and self.n == self.cfg.batch:
                self._step()

    def end_epoch(self) -> None:
        if self.n:
            self._step()

    def resume(self, theta: np.ndarray, total: np.ndarray, n: int, epoch: int) -> None:
        """The one step of an epoch, from the parameters it begins with and the summed gradients of its rows; the noise of earlier epochs is drawn and left."""
        if self.noise:
            self.rng.normal(size=(epoch - 1, len(theta)))
        self.theta, self.total, self.n = theta.copy(), total, n
        self._step()

    def _step(self) -> None:
        if self.noise:
            self.total += self.rng.normal(0.0, self.noise.multiplier * self.noise.clip, len(self.theta))
        self.theta -= self.cfg.rate * (self.total / self.n + self.cfg.l2 * self.free * self.theta + self.cfg.prox * (self.theta - self.start))
        self.total, self.n = np.zeros(len(self.theta)), 0


def descend(theta: np.ndarray, x: np.ndarray, y: np.ndarray, cfg: Config, rng: np.random.Generator, noise: accounting.Noise | None = None) -> np.ndarray:
    """All epochs over rows in memory, in an order drawn anew for each."""
    run = Descent(theta, cfg, rng, noise)
    for _ in range(cfg.epochs):
        order = rng.permutation(len(y))
        run.feed(x[order], y[order])
        run.end_epoch()
    return run.theta


def start_theta(seed: int, d: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(0.0, 0.01, d + 1)


@dataclass
class Cell:
    """One training: which rows (a flag column), which settings, and where it stands."""

    name: str
    config: Config
    train: str | None = None
    noise: accounting.Noise | None = None
    theta: dict[str, np.ndarray] = field(default_factory=dict)
    history: list[dict] = field(default_factory=list)


def site_sizes(rows: DataFrame, site: str, cells: list[Cell]) -> dict[tuple[str, str], int]:
    """{(cell, site): number of rows that the cell trains on}, for every site."""
    counts = [F.count_if(F.col(c.train) if c.train else F.lit(True)).alias(f"n_{i}") for i, c in enumerate(cells)]
    told = rows.groupBy(F.col(site).cast("string").alias("site")).agg(*counts).collect()  # a row for each site
    return {(c.name, r["site"]): r[f"n_{i}"] for i, c in enumerate(cells) for r in told}


def in_one_step(cell: Cell, sizes: dict[tuple[str, str], int]) -> bool:
    """Whether an epoch is a single step over all rows, at every site."""
    return cell.noise is not None or all(n <= cell.config.batch for (c, _), n in sizes.items() if c == cell.name)


def hold(rows: DataFrame, names: list[str], y: str, site: str, row_id: str, cells: list[Cell], sizes: dict[tuple[str, str], int]) -> DataFrame:
    """The rows persisted, with the columns that training needs; _row names them where their order counts."""
    columns = list(dict.fromkeys([site, y, *names, *(c.train for c in cells if c.train)]))
    ordered = not all(in_one_step(c, sizes) for c in cells)
    return rows.select(*columns, *([F.col(row_id).alias("_row")] if ordered else [])).persist()


def one_round(rows: DataFrame, names: list[str], y: str, site: str, cells: list[Cell], round_id: int, sizes: dict[tuple[str, str], int], own: bool = False) -> pd.DataFrame:
    """Train every cell on every site for its epochs: a row (cell, site, n, theta) each.

    ``own`` continues each site's own parameters instead of the common ones. Order and noise follow from the seed, the
    site, the round and the epoch, which keeps a lost task's second run the same as its first.
    """
    whole = [c for c in cells if in_one_step(c, sizes)]
    rest = [c for c in cells if not in_one_step(c, sizes)]
    told = [way(rows, names, y, site, part, round_id, sizes, own) for way, part in ((_summed, whole), (_streamed, rest)) if part]
    return pd.concat(told).sort_values(["cell", "site"]).reset_index(drop=True)  # a row for each cell and site


def _asked(rows: DataFrame, names: list[str], y: str, site: str, cells: list[Cell], *more: str) -> DataFrame:
    """(cell, seed, epochs, site, more, names, _y): each row once for every cell that trains on it."""
    asked = [F.when(F.col(c.train) if c.train else F.lit(True), F.struct(F.lit(c.name).alias("cell"), F.lit(c.config.seed).alias("seed"), F.lit(c.config.epochs).alias("epochs"))) for c in cells]
    told = rows.withColumn("_c", F.explode(F.filter(F.array(*asked), lambda v: v.isNotNull())))
    return told.select("_c.*", F.col(site).cast("string").alias("site"), *more, *names, F.col(y).cast("double").alias("_y"))


def _start(cells: list[Cell], d: int, round_id: int, own: bool) -> Callable[[str, str], Descent]:
    """What makes the descent of a cell at a site, at the begin of a round."""
    by_name = {c.name: (c.config, c.noise, c.theta) for c in cells}

    def begun(cell: str, at: str) -> Descent:
        cfg, noise, theta = by_name[cell]
        return Descent(theta.get(at if own else "", start_theta(cfg.seed, d)), cfg, np.random.default_rng([cfg.seed, hash_site(at), round_id]), noise)

    return begun


def _summed(rows: DataFrame, names: list[str], y: str, site: str, cells: list[Cell], round_id: int, sizes: dict[tuple[str, str], int], own: bool) -> pd.DataFrame:
    """Epochs of one step each: gradients summed by cell and site, in as many tasks as there are, then the step where the sums are."""
    d, begun = len(names), _start(cells, len(names), round_id, own)
    at = {(c.name, s): begun(c.name, s).theta for c in cells for (k, s), n in sizes.items() if k == c.name and n}
    clips = {c.name: c.noise.clip if c.noise else None for c in cells}
    counted: dict[tuple[str, str], float] = {}
    for epoch in range(1, max(c.config.epochs for c in cells) + 1):
        live = [c for c in cells if epoch <= c.config.epochs]
        here = {k: t for k, t in at.items() if k[0] in {c.name for c in live}}
        now = rows.sparkSession.createDataFrame([(c, s, clips[c], *map(float, t)) for (c, s), t in here.items()], "_cell string, _site string, _clip double, " + ", ".join(f"_t_{i} double" for i in range(d + 1)))
        asked = _asked(rows, names, y, site, live)
        asked = asked.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in (*names, "_y")})  # a sum would pass over nulls
        met = asked.join(F.broadcast(now), (F.col("cell") == F.col("_cell")) & F.col("site").eqNullSafe(F.col("_site")))
        sums = gradient_sums(met, names, "_y", [F.col(f"_t_{i}") for i in range(d + 1)], "cell", "site", clip=F.col("_clip"))

        def step(pieces: Iterator[pd.DataFrame], here: dict = here, epoch: int = epoch) -> Iterator[pd.DataFrame]:
            for pdf in pieces:
                for r in pdf.itertuples(index=False):
                    run = begun(r.cell, r.site)
                    run.resume(here[r.cell, r.site], np.array([getattr(r, f"g_{i}") for i in range(d + 1)]), int(r.n), epoch)
                    yield pd.DataFrame({"cell": [r.cell], "site": [r.site], "n": [r.n], "theta": [run.theta.tolist()]})

        for r in sums.mapInPandas(step, "cell string, site string, n double, theta array<double>").collect():  # a row for each cell and site
            at[r["cell"], r["site"]] = np.asarray(r["theta"])
            counted[r["cell"], r["site"]] = r["n"]
    return pd.DataFrame([(c, s, counted[c, s], at[c, s].tolist()) for c, s in counted], columns=["cell", "site", "n", "theta"])


def _streamed(rows: DataFrame, names: list[str], y: str, site: str, cells: list[Cell], round_id: int, sizes: dict[tuple[str, str], int], own: bool) -> pd.DataFrame:
    """Epochs of many steps, each from the one before: a site's rows pass through one task in order."""
    told = _asked(rows, names, y, site, cells, "_row").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("epochs"))))
    place = F.xxhash64("seed", F.lit(round_id), "epoch", "_row")
    n_sites = len({s for _, s in sizes})
    dealt = told.withColumn("place", place).repartition(max(1, len(cells) * n_sites), "cell", "site").sortWithinPartitions("cell", "site", "epoch", "place", "_row")
    begun = _start(cells, len(names), round_id, own)

    def train(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, run, n, epoch = None, None, 0, 0

        def result() -> pd.DataFrame:
            run.end_epoch()
            return pd.DataFrame({"cell": [key[0]], "site": [key[1]], "n": [float(n)], "theta": [run.theta.tolist()]})

        for pdf in pieces:
            for (cell, at, e), part in pdf.groupby(["cell", "site", "epoch"], sort=True, dropna=False):
                if (cell, at) != key:
                    if run:
                        yield result()
                    key, run, n, epoch = (cell, at), begun(cell, at), 0, e
                elif e != epoch:
                    run.end_epoch()
                    epoch = e
                run.feed(part[names].to_numpy(float), part["_y"].to_numpy(float))
                n += len(part) if e == 1 else 0
        if run:
            yield result()

    return dealt.select("cell", "site", "epoch", *names, "_y").mapInPandas(train, "cell string, site string, n double, theta array<double>").toPandas()


def hash_site(site: str) -> int:
    """A small number that depends on the site's name only."""
    return sum((i + 1) * b for i, b in enumerate(str(site).encode())) % (1 << 31)


def average(told: pd.DataFrame, weighting: str, secure: Aggregator | None = None, numbers: dict[str, int] | None = None, lost: frozenset[str] = frozenset()) -> np.ndarray:
    """The weighted mean of the sites' parameters; with secure aggregation only their masked sums are seen."""
    weight = told["n"] if weighting == "n_samples" else pd.Series(1.0, index=told.index)
    vectors = {s: np.append(w * np.asarray(t), w) for s, t, w in zip(told["site"], told["theta"], weight, strict=True)}
    if secure:
        total = secure.sum({numbers[s]: v for s, v in vectors.items()}, frozenset(numbers[s] for s in lost))
    else:
        total = np.sum([v for s, v in vectors.items() if s not in lost], axis=0)
    return total[:-1] / total[-1]


def fit(rows: DataFrame, names: list[str], y: str, site: str, row_id: str, cells: list[Cell], secure: bool = False, lost: dict[int, frozenset[str]] | None = None) -> list[Cell]:
    """Federated averaging of all cells together; rows are standardised. In both modes a lost site leaves the cohort for good."""
    sizes = site_sizes(rows, site, cells)
    held = hold(rows, names, y, site, row_id, cells, sizes)
    try:
        sites = sorted({str(s) for _, s in sizes})
        numbers = {s: i for i, s in enumerate(sites)}
        safe = {c.name: Aggregator({i: Site(i, 2) for i in numbers.values()}) for c in cells} if secure else {}
        gone: set[str] = set()
        for c in cells:
            c.theta = {"": start_theta(c.config.seed, len(names))}
        for t in range(1, max(c.config.rounds for c in cells) + 1):
            live = [c for c in cells if t <= c.config.rounds]
            told = one_round(held.where(~F.col(site).isin(*gone)) if gone else held, names, y, site, live, t, sizes)
            now = (lost or {}).get(t, frozenset())
            for c in live:
                new = average(told[told["cell"] == c.name], c.config.weighting, safe.get(c.name), numbers, now)
                c.history.append({"cell": c.name, "round": t, "update_norm": float(np.linalg.norm(new - c.theta[""])), "participants": [numbers[s] for s in sites if s not in gone | now], "theta": new})
                c.theta = {"": new}
            gone |= now
    finally:
        held.unpersist()
    return cells


def fit_local(rows: DataFrame, names: list[str], y: str, site: str, row_id: str, cells: list[Cell], rounds: int = 1, begin: dict[str, np.ndarray] | None = None) -> list[Cell]:
    """Each site by itself, for rounds times epochs; ``begin`` starts from given parameters (personalisation)."""
    sizes = site_sizes(rows, site, cells)
    held = hold(rows, names, y, site, row_id, cells, sizes)
    try:
        for c in cells:
            c.theta = dict(begin) if begin else {}
        for t in range(1, rounds + 1):
            told = one_round(held, names, y, site, cells, t, sizes, own=True)
            for c in cells:
                c.theta = {s: np.asarray(th) for s, th in told[told["cell"] == c.name][["site", "theta"]].itertuples(index=False)}
    finally:
        held.unpersist()
    return cells


def fit_pooled(rows: DataFrame, names: list[str], y: str, row_id: str, cfg: Config) -> np.ndarray:
    """All rows as one site, with as many passes as the federated model gets."""
    return fit_pooled_cells(rows, names, y, row_id, [Cell("pooled", cfg)])["pooled"]


def fit_pooled_cells(rows: DataFrame, names: list[str], y: str, row_id: str, cells: list[Cell]) -> dict[str, np.ndarray]:
    """The same for several cells, each with its own rows, trained together."""
    fit_local(rows.withColumn("_all", F.lit("all")), names, y, "_all", row_id, cells, rounds=max(c.config.rounds for c in cells))
    return {c.name: c.theta["all"] for c in cells}


# ---- scoring and experiments


def score(rows: DataFrame, names: list[str], theta: np.ndarray, into: str = "p") -> DataFrame:
    return rows.withColumn(into, predicted(logit(names, theta)))


def score_by_site(rows: DataFrame, names: list[str], site: str, models: dict[str, np.ndarray], into: str = "p") -> DataFrame:
    """Each row by its own site's model; rows of other sites get 0.5."""
    out = F.lit(0.5)
    for s, theta in models.items():
        out = F.when(F.col(site) == s, predicted(logit(names, theta))).otherwise(out)
    return rows.withColumn(into, out)


def folds(rows: DataFrame, site: str, y: str, row_id: str, k: int, seed: int) -> DataFrame:
    """Add fold: within each site and label rows are shuffled by hash and dealt in turn, groups going on where the last one stopped.

    Numbering goes by slices of the hash, whose sizes are added up first, so no window holds a whole site.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))
    named = rows.withColumns({"_h": h, "_slice": F.substring(h, 1, 2)})
    sizes = named.groupBy(site, y, "_slice").agg(F.count("*").alias("_n"))
    before = Window.orderBy(site, y, "_slice").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows for each group
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(site, y, "_slice").orderBy("_h", row_id)
    out = named.join(sizes, [site, y, "_slice"]).withColumn("fold", F.pmod(F.col("_before") + F.row_number().over(inside) - 1, F.lit(k)).cast("int"))
    return out.drop("_h", "_slice", "_before")


def cross_validate(rows: DataFrame, names: list[str], y: str, site: str, row_id: str, cfg: Config) -> DataFrame:
    """(regime, repeat, site, metrics) from out-of-fold predictions of the local, federated and pooled regimes; all federated cells train together."""
    told = None
    for r in range(cfg.repeats):
        dealt = folds(rows, site, y, row_id, cfg.folds, cfg.seed + r)
        flagged = dealt.select("*", *((F.col("fold") != k).alias(f"_in_{k}") for k in range(cfg.folds))).persist()
        cells = [Cell(f"{k}", replace(cfg, seed=cfg.seed + r), f"_in_{k}") for k in range(cfg.folds)]
        fit(flagged, names, y, site, row_id, cells)
        anew = lambda: [Cell(f"{k}", replace(cfg, seed=cfg.seed + r), f"_in_{k}") for k in range(cfg.folds)]  # noqa: B023, E731
        alone = fit_local(flagged, names, y, site, row_id, anew(), rounds=cfg.rounds)
        pooled = fit_pooled_cells(flagged, names, y, row_id, anew())
        for k in range(cfg.folds):
            out = flagged.where(F.col("fold") == k).select(site, y, *names)
            for regime, scored in (
                ("federated", score(out, names, cells[k].theta[""])),
                ("local", score_by_site(out, names, site, alone[k].theta)),
                ("centralized", score(out, names, pooled[f"{k}"])),
            ):
                part = scored.select(F.lit(regime).alias("regime"), F.lit(r).alias("repeat"), F.col(site).alias("site"), F.col(y).cast("double").alias("y"), "p")
                told = part if told is None else told.unionByName(part)
    each = M.binary_metrics(told, "y", "p", "regime", "repeat", "site")
    every = M.binary_metrics(told, "y", "p", "regime", "repeat").withColumn("site", F.lit("overall"))
    return each.unionByName(every)


def select_l2(rows: DataFrame, names: list[str], y: str, site: str, row_id: str, cfg: Config, grid: list[float]) -> tuple[float, dict[float, float]]:
    """The strength with the least out-of-fold log-loss, the first of equals; all strengths and folds train together."""
    flagged = folds(rows, site, y, row_id, cfg.folds, cfg.seed)
    flagged = flagged.select("*", *((F.col("fold") != k).alias(f"_in_{k}") for k in range(cfg.folds))).persist()
    cells = [Cell(f"{i}/{k}", replace(cfg, l2=v), f"_in_{k}") for i, v in enumerate(grid) for k in range(cfg.folds)]
    fit(flagged, names, y, site, row_id, cells)
    losses = {}
    for i, v in enumerate(grid):
        p = F.lit(0.5)
        for k in range(cfg.folds):
            p = F.when(F.col("fold") == k, predicted(logit(names, cells[i * cfg.folds + k].theta[""]))).otherwise(p)
        losses[v] = M.calibration(flagged.withColumn("_p", p), y, "_p").first()["log_loss"]
    flagged.unpersist()
    return min(grid, key=lambda v: losses[v]), losses


def holdout(train: DataFrame, test: DataFrame, names: list[str], y: str, site: str, row_id: str, cfg: Config, seeds: Iterable[int] = range(5)) -> DataFrame:
    """(regime, seed, site, metrics) of the local, federated and pooled models on other rows, and ``local of X`` for X's model on all of them.

    The rows of a site under ``local of X`` are the cross-site areas.
    """
    anew = lambda: [Cell(f"{s}", replace(cfg, seed=s)) for s in seeds]
    common, pooled = fit(train, names, y, site, row_id, anew()), fit_pooled_cells(train, names, y, row_id, anew())
    alone = fit_local(train, names, y, site, row_id, anew(), rounds=cfg.rounds)
    told = None
    for c, own in zip(common, alone, strict=True):
        scored = [("federated", score(test, names, c.theta[""])), ("centralized", score(test, names, pooled[c.name])), ("local", score_by_site(test, names, site, own.theta))]
        scored += [(f"local of {place}", score(test, names, theta)) for place, theta in own.theta.items()]
        for regime, rows in scored:
            part = rows.select(F.lit(regime).alias("regime"), F.lit(int(c.name)).alias("seed"), F.col(site).cast("string").alias("site"), F.col(y).cast("double").alias("y"), "p")
            told = part if told is None else told.unionByName(part)
    return M.binary_metrics(told, "y", "p", "regime", "seed", "site").unionByName(M.binary_metrics(told, "y", "p", "regime", "seed").withColumn("site", F.lit("overall")))


def holdout_interval(train: DataFrame, test: DataFrame, names: list[str], y: str, site: str, row_id: str, cfg: Config, n_boot: int = 2000) -> DataFrame:
    """(n_boot, low, high): the bootstrap interval of the federated model's area on other rows."""
    theta = fit(train, names, y, site, row_id, [Cell("one", cfg)])[0].theta[""]
    return M.bootstrap_auc_ci(score(test, names, theta), y, "p", n_boot, cfg.seed)


def seed_stability(rows: DataFrame, names: list[str], y: str, site: str, row_id: str, cfg: Config, seeds: Iterable[int] = range(10)) -> dict:
    """How far the federated parameters of several seeds are from the optimum and from each other."""
    cells = fit(rows, names, y, site, row_id, [Cell(f"{s}", replace(cfg, seed=s)) for s in seeds])
    best = optimum(rows, names, y, cfg.l2)
    thetas = np.array([c.theta[""] for c in cells])
    objectives = [objective(rows, names, y, list(t), cfg.l2) for t in thetas]
    return {
        "objectives": objectives, "optimum": objective(rows, names, y, list(best), cfg.l2),
        "distance": [float(np.linalg.norm(t - best)) for t in thetas], "max_parameter_std": float(thetas.std(axis=0, ddof=1).max()) if len(thetas) > 1 else 0.0,
    }


def convergence(rows: DataFrame, names: list[str], y: str, site: str, row_id: str, cfg: Config, epochs: Iterable[int] = (1, 2, 5, 10)) -> list[dict]:
    """For each weighting and number of local epochs the gap to the optimum by round, the first round below NEAR, and update norms."""
    cells = [Cell(f"{w}/{e}", replace(cfg, epochs=e, weighting=w)) for w in ("n_samples", "uniform") for e in epochs]
    fit(rows, names, y, site, row_id, cells)
    best = list(optimum(rows, names, y, cfg.l2))
    least, *reached = objectives(rows, names, y, [best, *(list(h["theta"]) for c in cells for h in c.history)], cfg.l2)
    told = []
    for c in cells:
        gaps, reached = [v - least for v in reached[: len(c.history)]], reached[len(c.history) :]
        near = next((h["round"] for h, g in zip(c.history, gaps, strict=True) if g < NEAR), None)
        told.append({"cell": c.name, "gap": gaps[-1], "gaps": gaps, "first_near": near, "update_norms": [h["update_norm"] for h in c.history]})
    return told


def personalise(rows: DataFrame, names: list[str], y: str, site: str, row_id: str, cfg: Config, epochs: int = 2) -> dict[str, np.ndarray]:
    """Each site's model: the federated one, trained on at the site for some epochs."""
    common = fit(rows, names, y, site, row_id, [Cell("common", cfg)])[0].theta[""]
    sites = [r[0] for r in rows.select(site).distinct().collect()]
    return fit_local(rows, names, y, site, row_id, [Cell("own", replace(cfg, epochs=epochs))], begin={s: common for s in sites})[0].theta


def private_study(rows: DataFrame, names: list[str], y: str, site: str, row_id: str, cfg: Config, targets: Iterable[float] = (0.5, 1, 2, 4, 8), at_delta: float = 1e-3, test: DataFrame | None = None) -> list[dict]:
    """For each epsilon, and without noise (null), the noise it takes, both accounts of it, the objective, and area and Brier score on the test rows (or the own ones); all trained together."""
    steps = cfg.rounds * cfg.epochs
    noises = {e: accounting.multiplier_for(e, steps, at_delta) for e in targets} | {None: 0.0}
    cells = fit(rows, names, y, site, row_id, [Cell(f"{e}", cfg, noise=accounting.Noise(s)) for e, s in noises.items()])
    reached = objectives(rows, names, y, [list(c.theta[""]) for c in cells], cfg.l2)
    told = None
    for c in cells:
        part = score(rows if test is None else test, names, c.theta[""]).select(F.lit(c.name).alias("cell"), F.col(y).cast("double").alias("y"), "p")
        told = part if told is None else told.unionByName(part)
    scores = {r["cell"]: r for r in M.binary_metrics(told, "y", "p", "cell").collect()}
    return [
        {
            "epsilon": e, "sigma": s, "epsilon_exact": accounting.epsilon(s, steps, at_delta) if s else None, "epsilon_rdp": accounting.renyi_epsilon(s, steps, at_delta) if s else None,
            "objective": v, "auc": scores[c.name]["auc"], "brier": scores[c.name]["brier"],
        }
        for (e, s), c, v in zip(noises.items(), cells, reached, strict=True)
    ]


def secure_benchmark(rows: DataFrame, names: list[str], y: str, site: str, row_id: str, cfg: Config) -> dict:
    """Plain against secure aggregation: largest difference of the parameters, seconds, bytes that a site sends, and a run in which a site drops out half way."""
    out: dict = {}
    d = len(names) + 1
    sites = sorted(str(r[0]) for r in rows.select(site).distinct().collect())
    run = {}
    for name, secure, lost in (("plain", False, None), ("secure", True, None), ("dropout", True, {max(1, cfg.rounds // 2): frozenset(sites[-1:])})):
        began = time.perf_counter()
        run[name] = fit(rows, names, y, site, row_id, [Cell(name, cfg)], secure=secure, lost=lost)[0]
        out[f"seconds_{name}"] = time.perf_counter() - began
    out["max_abs_difference"] = float(np.abs(run["plain"].theta[""] - run["secure"].theta[""]).max())
    vector = np.zeros(d + 1)
    out["bytes_plain"] = cfg.rounds * len(wire.encode({"theta": vector[:-1], "n": 1}))
    # a masked vector, then shares of the own seed for every other site and for each site that is alive, each sealed
    out["bytes_secure"] = cfg.rounds * (len(wire.encode({"masked": vector.astype(np.uint64)})) + 2 * (len(sites) - 1) * len(wire.encode({"share": b"0" * 112})))
    out["rounds_with_dropout"] = len(run["dropout"].history)
    out["participants_after_dropout"] = run["dropout"].history[-1]["participants"]
    out["objective_with_dropout"] = objective(rows, names, y, list(run["dropout"].theta[""]), cfg.l2)
    return out


def final_model(rows: DataFrame, names: list[str], y: str, site: str, row_id: str, cfg: Config) -> tuple[Cell, str]:
    """The federated model under secure aggregation, or without it where the protocol fails (too few sites); and which it was."""
    try:
        return fit(rows, names, y, site, row_id, [Cell("final", cfg)], secure=True)[0], "secure"
    except ProtocolError as e:
        log.warning("secure aggregation failed (%s); training goes on without it", e)
        return fit(rows, names, y, site, row_id, [Cell("final", cfg)])[0], "plain"


def own_rows(rows: DataFrame, site: str, own: str) -> DataFrame:
    """The rows, all of which must be the site's own: one of another site, or of none, fails the job that meets it."""
    foreign = F.raise_error(F.concat(F.lit(f"foreign row at {own}: "), F.coalesce(F.col(site).cast("string"), F.lit("null")))).cast("boolean")
    return rows.where(F.when(F.col(site) == own, F.lit(True)).otherwise(foreign))


def objectives(rows: DataFrame, names: list[str], y: str, thetas: list[list[float]], l2: float) -> list[float]:
    """The objective at many parameters, STRETCH of them in one aggregate."""
    out: list[float] = []
    for at in range(0, len(thetas), STRETCH):
        part = thetas[at : at + STRETCH]
        means = rows.agg(*(F.avg(loss(logit(names, t), F.col(y).cast("double"))).alias(f"o{i}") for i, t in enumerate(part))).first()
        out += [float(m) + 0.5 * l2 * float(np.dot(t[:-1], t[:-1])) for m, t in zip(means, part, strict=True)]
    return out


def site_task(rows: DataFrame, task: str, names: list[str], y: str, site: str, theta: list[float] | None = None) -> DataFrame:
    """What a site's node answers: aggregates only; any other task is refused."""
    if task not in ALLOWED:
        raise ValueError(f"task {task!r} is not allowed; there are {ALLOWED}")
    if task == "moments":
        return X.moments(rows, names, site)
    if theta is None:
        raise ValueError("the task needs parameters")
    if task == "loss":
        return rows.groupBy(site).agg(F.sum(loss(logit(names, theta), F.col(y).cast("double"))).alias("loss"), F.count("*").cast("double").alias("n"))
    return gradient_sums(rows, names, y, theta, site)


def transport_log(messages: DataFrame, *by: str) -> DataFrame:
    """(direction, client, messages, bytes) sums over messages with direction, client, type and payload (text), or by other columns such as type."""
    return messages.groupBy(*(by or ("direction", "client"))).agg(F.count("*").alias("messages"), F.sum(F.octet_length("payload")).cast("long").alias("bytes"))
