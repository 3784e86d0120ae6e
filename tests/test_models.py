"""Features, federated models, privacy and scores."""

from math import erf, inf, sqrt
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siloflow.operators import evaluate, features, federated, metrics
from siloflow.privacy import accounting, crypto, secagg
from siloflow.sources import notes


def rows(spark, n=300, d=3, seed=0, sites=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ np.arange(1, d + 1) * 0.6 - 0.3)))).astype(int)
    names = [f"x{i}" for i in range(d)]
    data = [(i, f"S{i % sites}", int(y[i]), *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(data, "id int, site string, y int, " + ", ".join(f"{c} double" for c in names)), names, x, y


def test_moments_and_standardizer(spark):
    df = spark.createDataFrame([("a", 1.0, None, 2.0), ("a", 3.0, None, 2.0), ("b", None, None, 2.0), ("b", 8.0, None, 2.0)], "site string, u double, v double, w double")
    got = features.scaler_dict(features.standardizer(features.moments(df, ["u", "v", "w"], "site"), ["u", "v", "w"]))
    assert got["u"] == pytest.approx((4.0, np.std([1, 3, 8]))) and got["v"] == (0.0, 1.0) and got["w"] == (2.0, 1.0)
    z = [r["u"] for r in features.standardized(df, got).select("u").collect()]
    assert sum(z) == pytest.approx(0.0) and z[2] == 0.0


def test_feature_columns(spark):
    from siloflow.operators import extraction

    df = spark.createDataFrame([("A", "NOWHERE", "", None), ("B", "BERLIN_NODE", "Known hypertension. EF 40%", (0, "male", None, 2, True))], notes.INPUT_SCHEMA)
    got = features.with_features(extraction.extract(df), "extended").collect()
    assert got[0]["age_years"] is None and got[0]["site_BERLIN_NODE"] == 0.0 and got[0]["missing_lvef_percent"] == 1.0
    assert got[1]["age_years"] is None and got[1]["sex_male"] == 1.0 and got[1]["dx_hypertension"] == 1.0 and got[1]["lvef_percent"] == 40.0
    assert len(features.SETS["compact"]) == 13 and len(features.SETS["extended"]) == 30
    with pytest.raises(KeyError):
        features.with_features(df, "none")


def test_average_rule():
    import pandas as pd

    told = pd.DataFrame({"site": ["a", "b"], "n": [10.0, 30.0], "theta": [[1.0, 0.0], [4.0, 3.0]]})
    assert federated.average(told, "n_samples").tolist() == [3.25, 2.25] and federated.average(told, "uniform").tolist() == [2.5, 1.5]
    safe = secagg.Aggregator({0: secagg.Site(0, 2, Random(1)), 1: secagg.Site(1, 2, Random(2))})
    assert federated.average(told, "n_samples", safe, {"a": 0, "b": 1}) == pytest.approx([3.25, 2.25], abs=1e-6)


def test_optimum_and_gradient(spark):
    df, names, x, y = rows(spark)
    theta = federated.optimum(df, names, "y", 0.1)
    x1 = np.column_stack([x, np.ones(len(y))])
    g = x1.T @ (1 / (1 + np.exp(-x1 @ theta)) - y) / len(y) + 0.1 * np.append(theta[:-1], 0)
    assert np.abs(g).max() < 1e-8
    sums = federated.gradient_sums(df, names, "y", [0.1, 0.2, -0.3, 0.05]).first()
    want = x1.T @ (1 / (1 + np.exp(-x1 @ np.array([0.1, 0.2, -0.3, 0.05]))) - y)
    assert [sums[f"g_{i}"] for i in range(4)] == pytest.approx(want.tolist())
    clipped = federated.gradient_sums(df, names, "y", [0.0] * 4, clip=0.5).first()
    assert np.linalg.norm([clipped[f"g_{i}"] for i in range(4)]) <= 0.5 * len(y)


def test_rounds_converge_and_sites_can_drop_out(spark):
    df, names, _, _ = rows(spark)
    cfg = federated.Config(rounds=12, rate=0.3)
    best = federated.objective(df, names, "y", list(federated.optimum(df, names, "y", cfg.l2)), cfg.l2)
    cells = federated.fit(df, names, "y", "site", "id", [federated.Cell("n", cfg), federated.Cell("u", federated.replace(cfg, weighting="uniform"))])
    for c in cells:
        assert federated.objective(df, names, "y", list(c.theta[""]), cfg.l2) - best < 5e-3
        assert [h["round"] for h in c.history] == list(range(1, 13))
    short = federated.replace(cfg, rounds=3)
    plain = federated.fit(df, names, "y", "site", "id", [federated.Cell("n", short)], lost={2: frozenset({"S2"})})[0]
    safe = federated.fit(df, names, "y", "site", "id", [federated.Cell("n", short)], secure=True, lost={2: frozenset({"S2"})})[0]
    assert np.abs(plain.theta[""] - safe.theta[""]).max() < 1e-6
    assert [h["participants"] for h in safe.history] == [[0, 1, 2], [0, 1], [0, 1]]


def test_one_site_is_local_descent(spark):
    df, names, x, y = rows(spark, n=50, sites=1)
    cfg = federated.Config(rounds=1, epochs=3)
    got = federated.fit(df, names, "y", "site", "id", [federated.Cell("c", cfg)])[0].theta[""]
    theta, free = federated.start_theta(0, 3), np.array([1.0, 1.0, 1.0, 0.0])
    x1 = np.column_stack([x, np.ones(50)])
    for epoch in (1, 2, 3):  # the order is that of a hash of seed, round, epoch and row
        order = [r["id"] for r in df.orderBy(F.xxhash64(F.lit(0), F.lit(1), F.lit(epoch), "id")).select("id").collect()]
        for at in range(0, 50, cfg.batch):
            b = order[at : at + cfg.batch]
            g = x1[b].T @ (1 / (1 + np.exp(-x1[b] @ theta)) - y[b]) / len(b)
            theta = theta - cfg.rate * (g + cfg.l2 * free * theta)
    assert got == pytest.approx(theta)


def test_a_site_streams_through_in_pieces(spark):
    """Neither the size of the Arrow batches nor the number of rows of a site changes what is done."""
    df, names, _, _ = rows(spark)
    cells = lambda: [federated.Cell("a", federated.Config(rounds=2)), federated.Cell("b", federated.Config(rounds=2, epochs=1, batch=1000))]
    whole = federated.fit(df, names, "y", "site", "id", cells())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        pieces = federated.fit(df, names, "y", "site", "id", cells())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(p.theta[""] == pytest.approx(w.theta[""]) for p, w in zip(pieces, whole, strict=True))


def test_whole_batches_and_noise_are_sums(spark, monkeypatch):
    """Where an epoch is one step, rows are summed by Spark: Python gets a row for each cell and site at most, and the steps are those of a plain loop."""
    df, names, x, y = rows(spark)
    cfg = federated.Config(rounds=2, epochs=2, batch=100, prox=0.1)  # as many as the sites have
    seen, plain = [], type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, *a, **b: (seen.append(self.count()), plain(self, *a, **b))[1])
    noise = accounting.Noise(1.5, 0.5)
    flagged = df.withColumn("_half", F.col("id") < 150)
    anew = lambda: [federated.Cell("full", cfg), federated.Cell("noisy", federated.replace(cfg, batch=7), noise=noise), federated.Cell("half", federated.replace(cfg, epochs=1, seed=3), "_half")]
    got = {c.name: c.theta for c in federated.fit_local(flagged, names, "y", "site", "id", anew(), rounds=2)}
    assert seen and max(seen) <= 9
    for c in anew():
        for s in range(3):
            mine = [i for i in range(s, 150 if c.train else 300, 3)]
            theta = federated.start_theta(c.config.seed, 3)
            for t in (1, 2):
                run = federated.Descent(theta, c.config, np.random.default_rng([c.config.seed, federated.hash_site(f"S{s}"), t]), c.noise)
                for _ in range(c.config.epochs):
                    run.feed(x[mine], y[mine].astype(float))
                    run.end_epoch()
                theta = run.theta
            assert got[c.name][f"S{s}"] == pytest.approx(theta), (c.name, s)
    mixed = [federated.Cell("full", cfg), federated.Cell("small", federated.replace(cfg, batch=16))]
    alone = [federated.fit(df, names, "y", "site", "id", [federated.Cell(c.name, c.config)])[0].theta[""] for c in mixed]
    assert [c.theta[""] for c in federated.fit(df, names, "y", "site", "id", mixed)] == [pytest.approx(t) for t in alone]


def test_folds_deal_every_site_and_label(spark):
    df, *_ = rows(spark, n=97)
    dealt = federated.folds(df, "site", "y", "id", 5, 1).collect()
    assert {(r["site"], r["fold"]) for r in dealt} == {(f"S{s}", k) for s in range(3) for k in range(5)}
    sizes = np.bincount([r["fold"] for r in dealt])
    assert sizes.max() - sizes.min() <= 1


def test_experiments(spark):
    df, names, _, _ = rows(spark, n=120)
    cfg = federated.Config(rounds=2, epochs=1, folds=2, repeats=1)
    cv = federated.cross_validate(df, names, "y", "site", "id", cfg).collect()
    assert {(r["regime"], r["site"]) for r in cv} == {(a, b) for a in ("local", "federated", "centralized") for b in ("S0", "S1", "S2", "overall")}
    best, losses = federated.select_l2(df, names, "y", "site", "id", cfg, [0.01, 50.0])
    assert best == 0.01 and losses[0.01] < losses[50.0]
    assert set(federated.personalise(df, names, "y", "site", "id", cfg)) == {"S0", "S1", "S2"}
    study = federated.private_study(df, names, "y", "site", "id", cfg, targets=(1.0, 8.0))
    assert study[0]["sigma"] > study[1]["sigma"] and all(r["epsilon_exact"] <= r["epsilon_rdp"] for r in study[:2]) and study[2]["epsilon"] is None and study[2]["auc"] > 0.5
    assert len(federated.seed_stability(df, names, "y", "site", "id", cfg, range(2))["distance"]) == 2
    told = federated.convergence(df, names, "y", "site", "id", cfg, (1,))
    assert len(told) == 2 and all(len(c["gaps"]) == cfg.rounds and (c["first_near"] is None or c["gaps"][c["first_near"] - 1] < 1e-3) for c in told)
    assert {r["site"] for r in federated.holdout(df, df, names, "y", "site", "id", cfg, range(1)).collect()} == {"S0", "S1", "S2", "overall"}
    assert federated.secure_benchmark(df, names, "y", "site", "id", cfg)["max_abs_difference"] < 1e-6


def test_release_policy(spark):
    df, names, *_ = rows(spark, n=30)
    assert federated.site_task(df, "moments", names, "y", "site").count() == 3
    with pytest.raises(ValueError, match="not allowed"):
        federated.site_task(df, "rows", names, "y", "site")


# ---- privacy


def test_group_and_keys():
    assert f"{crypto.PRIME:X}".startswith("FFFFFFFFFFFFFFFFC90FDAA22168C234") and f"{crypto.PRIME:X}".endswith("15728E5A8AACAA68FFFFFFFFFFFFFFFF")
    a, b = crypto.key_pair(Random(1)), crypto.key_pair(Random(2))
    assert crypto.agree(a.secret, b.public, b"x") == crypto.agree(b.secret, a.public, b"x") != crypto.agree(a.secret, b.public, b"y")
    for bad in (0, 1, crypto.PRIME - 1, crypto.PRIME):
        with pytest.raises(crypto.CryptoError):
            crypto.agree(a.secret, bad, b"x")


def test_sealed_messages():
    blob = crypto.seal(b"k" * 32, b"hello", b"about")
    assert crypto.unseal(b"k" * 32, blob, b"about") == b"hello" and crypto.unseal(b"k" * 32, crypto.seal(b"k" * 32, b"", b""), b"") == b""
    for key, data, about in ((b"j" * 32, blob, b"about"), (b"k" * 32, blob[:-1] + bytes([blob[-1] ^ 1]), b"about"), (b"k" * 32, blob, b"other"), (b"k" * 32, b"", b"about")):
        with pytest.raises(crypto.CryptoError):
            crypto.unseal(key, data, about)


def test_shares():
    secret = 2**255 + 12345
    shares = crypto.split(secret, 5, 3)
    assert crypto.join(shares[:3]) == crypto.join(shares[2:]) == secret != crypto.join(shares[:2])
    with pytest.raises(ValueError):
        crypto.join([shares[0], shares[0]])
    with pytest.raises(ValueError):
        crypto.split(1, 2, 3)


def test_fixed_point(spark):
    v = np.array([-1234.5, -1e-3, 0, 3.14159, 1e6])
    assert np.abs(crypto.from_fixed(crypto.to_fixed(v)) - v).max() <= 2.0**-23
    for bad in (1e12, np.nan):
        with pytest.raises(ValueError):
            crypto.to_fixed(np.array([bad]))
    df = spark.createDataFrame([(float(x),) for x in v], "v double").withColumn("w", secagg.fixed_point(F.col("v")))
    assert [int(r["w"]) for r in df.collect()] == [int(w) for w in crypto.to_fixed(v)]
    total = secagg.ring_sum(df, "w").select(secagg.real_number(F.col("w")).alias("s")).first()["s"]
    assert total == pytest.approx(v.sum(), abs=1e-6)


def sites(n=3, t=2):
    return secagg.Aggregator({i: secagg.Site(i, t, Random(i)) for i in range(n)}, t)


def test_secure_sums_and_dropout():
    rng = np.random.default_rng(0)
    agg = sites()
    for _ in range(3):
        v = {i: rng.normal(size=16) for i in range(3)}
        assert agg.sum(v) == pytest.approx(sum(v.values()), abs=1e-6)
    v = {i: rng.normal(size=16) for i in range(3)}
    assert agg.sum(v, frozenset({2})) == pytest.approx(v[0] + v[1], abs=1e-6) and agg.cohort == [0, 1]
    assert agg.sum({0: v[0], 1: v[1]}) == pytest.approx(v[0] + v[1], abs=1e-6)
    with pytest.raises(secagg.ProtocolError):
        sites().sum(v, frozenset({0, 1}))


def test_protocol_refusals():
    agg = sites()
    agg.sum({i: np.ones(4) for i in range(3)})
    with pytest.raises(secagg.ProtocolError, match="revealed"):
        agg.sites[0].reveal(1, [], [1])
    with pytest.raises(secagg.ProtocolError, match="alive and gone"):
        agg.sites[0].reveal(2, [1], [1])
    blob = agg.sites[0].share_own_seed(9)[1]
    with pytest.raises(secagg.ProtocolError):
        agg.sites[1].receive(secagg.OWN, 8, {0: blob})
    with pytest.raises(secagg.ProtocolError):
        secagg.Site(0, 3).meet({0: {}, 1: {}})


def test_masks_are_fresh():
    s = crypto.mask(b"s", "own round 1", 4000)
    assert (s != crypto.mask(b"s", "own round 2", 4000)).all()
    assert abs(np.unpackbits(s.view(np.uint8)).mean() - 0.5) < 0.01


def test_accounting(spark):
    assert accounting.delta(1.0, 0.0) == pytest.approx(erf(0.5 / sqrt(2)))
    for s in (1.0, 3.0, 10.0):
        assert accounting.epsilon(s, 30, 1e-3) <= accounting.renyi_epsilon(s, 30, 1e-3)
    for e in (0.5, 1.0, 4.0, 8.0):
        assert accounting.epsilon(accounting.multiplier_for(e, 30, 1e-3), 30, 1e-3) == pytest.approx(e, rel=1e-3)
    assert accounting.epsilon(1e-3, 30, 1e-3) == inf
    table = {25.251: 0.584, 14.102: 1.150, 7.916: 2.271, 4.508: 4.489, 2.629: 8.873}
    got = {r["sigma"]: r["epsilon_rdp"] for r in accounting.renyi(spark, list(table), 30, 1e-3).collect()}
    assert {k: round(v, 3) for k, v in got.items()} == table
    assert {s: round(accounting.multiplier_for(e, 30, 1e-3), 3) for s, e in zip(table, (0.5, 1, 2, 4, 8), strict=True)} == {s: s for s in table}


def test_noise_free_steps_are_plain_descent():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(20, 2)), rng.integers(0, 2, 20).astype(float)
    cfg = federated.Config(epochs=4, batch=20)
    a = federated.descend(np.zeros(3), x, y, cfg, rng, accounting.Noise(0.0, 1e9))
    assert a == pytest.approx(federated.descend(np.zeros(3), x, y, cfg, rng))
    step = federated.descend(np.zeros(3), x, y, federated.Config(epochs=1, rate=1.0, l2=0.0), rng, accounting.Noise(0.0, 0.5))
    assert np.linalg.norm(step) <= 0.5


# ---- scores


def plain_auc(y, p):
    pos, neg = [b for a, b in zip(y, p, strict=True) if a], [b for a, b in zip(y, p, strict=True) if not a]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_ranking_with_ties(spark):
    rng = np.random.default_rng(3)
    y, p = rng.integers(0, 2, 200).tolist(), (rng.integers(0, 11, 200) / 10).tolist()
    df = spark.createDataFrame([(a, b, "ab"[i % 2]) for i, (a, b) in enumerate(zip(y, p, strict=True))], "y int, p double, s string")
    got = metrics.binary_metrics(df, "y", "p").first()
    assert got["auc"] == pytest.approx(plain_auc(y, p), abs=1e-12) and got["brier"] == pytest.approx(np.mean((np.array(p) - y) ** 2), abs=1e-6)
    for r in metrics.ranking(df, "y", "p", "s").collect():
        at = "ab".index(r["s"])
        assert r["auc"] == pytest.approx(plain_auc(y[at::2], p[at::2]), abs=1e-12)
    one = metrics.binary_metrics(df.where("y = 1"), "y", "p").first()
    assert one["auc"] is None and one["ap"] == 1.0
    ci = metrics.bootstrap_auc_ci(df, "y", "p", 50).first()
    assert ci["n_boot"] == 50 and ci["low"] < got["auc"] < ci["high"]


def test_small_scores(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, None), (1.0, None), (1.0, 6.0), (1.0, 50.0)], "t double, p double")
    got = metrics.numeric_field(df, "t", "p", 3.0).first()
    assert got["score"] == pytest.approx((1 + 1 + 0 + (1 - 2 / 6) + 0) / 5) and got["mae"] == pytest.approx((0 + 5 + 49) / 3)
    s = metrics.summarize(spark.createDataFrame([("a", 2.0), ("a", float("nan")), ("b", 1.0), ("b", 3.0), ("c", float("inf"))], "g string, v double"), "v", "g")
    assert {r["g"]: (r["mean"], r["std"]) for r in s.collect()} == {"a": (2.0, 0.0), "b": (2.0, pytest.approx(sqrt(2))), "c": (None, None)}
    x = spark.createDataFrame([(" A-b  C ",), (None,)], "x string").select(metrics.normal_token(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in x] == ["a_b c", "__NULL__"]
    n = spark.createDataFrame([("1.5",), ("x",), (None,), ("inf",)], "x string").select(metrics.numeric_value(F.col("x")).alias("v")).collect()
    assert [r["v"] for r in n] == [1.5, None, None, None]


def submission(spark):
    fields = (["hypertension"], ["ramipril"], None, None, None, None, None, "never", "none")
    note, spans, text = "Patient: Anna Keller", [(9, 20, "PATIENT_NAME")], "Patient: [PATIENT_NAME]"
    inputs = spark.createDataFrame([(i, "BERLIN_NODE", note, None) for i in ("X1", "X2")], notes.INPUT_SCHEMA)
    truth = spark.createDataFrame([(i, "BERLIN_NODE", spans, text, fields, y) for i, y in (("X1", 1), ("X2", 0))], notes.TRUTH_SCHEMA)
    pred = spark.createDataFrame([(i, spans, text, fields, p) for i, p in (("X1", 1.0), ("X2", 0.0))], notes.PREDICTION_SCHEMA)
    return inputs, truth, pred


def test_a_perfect_submission(spark):
    inputs, truth, pred = submission(spark)
    got = evaluate.evaluate(inputs, truth, pred)
    assert got["deidentification"]["composite"] == pytest.approx(1.0) and got["extraction"]["composite"] == pytest.approx(1.0)
    assert got["prediction"]["overall"]["composite"] == pytest.approx(1.0, abs=1e-6) and got["points"] == pytest.approx(40.0, abs=1e-5)
    labels = evaluate.label_f1(evaluate.join_all(inputs, truth, pred)).collect()
    assert len(labels) == 8 and labels[0]["macro_f1"] == pytest.approx(1 / 8)


def test_missing_and_doubled_rows(spark):
    inputs, truth, pred = submission(spark)
    got = evaluate.evaluate(inputs, truth, pred.where("case_id = 'X1'"))
    assert got["missing_predictions"] == 1 and got["deidentification"]["leakage_rate"] == pytest.approx(0.5)
    with pytest.raises(ValueError, match="twice"):
        evaluate.evaluate(inputs, truth, pred.unionByName(pred))
    with pytest.raises(ValueError, match="no input"):
        evaluate.evaluate(inputs.where("case_id = 'X1'"), truth, pred)
