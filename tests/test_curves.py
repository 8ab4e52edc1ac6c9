"""Identities of curve fits, models and windows on small literal panels."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratanet.functions import loadings as L
from stratanet.operators import arbfree as AF
from stratanet.operators import curvefit as C
from stratanet.operators import panel as P
from stratanet.operators import residuals as R
from stratanet.operators import windows as W
from stratanet.sources import store
from stratanet.sources import tables as S

YEARS = (0.5, 1, 2, 3, 5, 7, 10, 15, 20, 30)
DT = 1.0 / 252.0


def make_panel(spark, factors, noise=0.0, decay=1.0, terms=YEARS, seed=0):
    """factors: {issuer: (n_dates, 3)} -> long (source, date, term, rate)."""
    rng = np.random.default_rng(seed)
    rows = []
    for who, X in factors.items():
        for t, x in enumerate(X):
            for m in terms:
                g = np.exp(-m / decay)
                f1 = (1 - g) / (m / decay)
                y = x[0] + x[1] * f1 + x[2] * (f1 - g) + noise * rng.normal()
                rows.append((who, str(np.datetime64("2020-01-01") + t), f"{m:g}Y", float(y)))
    df = spark.createDataFrame(rows, "source string, date string, term string, rate double")
    return df.withColumn("date", F.col("date").cast("date")).cache()


def walk(n, seed):
    rng = np.random.default_rng(seed)
    return np.array([0.03, -0.01, 0.005]) + np.cumsum(rng.normal(0, 5e-4, (n, 3)), axis=0)


@pytest.fixture(scope="module")
def panel(spark):
    return make_panel(spark, {"a": walk(40, 1), "b": walk(40, 2)}, noise=1e-4)


def residual_map(df):
    return {(r["issuer"], r["date"], r["term"]): r["residual"] for r in df.collect()}


def test_exact_curve_leaves_no_residual(spark):
    X = walk(5, 3)
    fitted = C.ns_fit(make_panel(spark, {"a": X}))
    table = C.factor_table(fitted, ["source", "date"]).orderBy("date").collect()
    got = np.array([[r["level"], r["slope"], r["curvature"]] for r in table])
    np.testing.assert_allclose(got, X, atol=1e-12)
    assert max(r["rmse"] for r in table) < 1e-12


def test_fit_equals_least_squares(panel):
    rows = C.ns_fit(panel).where("source = 'a'").toPandas()
    for _, day in rows.groupby("date"):
        design = np.column_stack([np.ones(len(day)), day.f1, day.f1 - day.g])
        beta = np.linalg.lstsq(design, day.rate, rcond=None)[0]
        np.testing.assert_allclose(day.residual, day.rate - design @ beta, atol=1e-12)


def test_decay_search_recovers_the_decay(spark):
    exact = make_panel(spark, {"a": walk(4, 5)}, decay=C.DECAY_GRID[20])
    assert {round(r["decay"], 9) for r in C.search_decay(exact, ["source", "date"]).collect()} == {
        round(C.DECAY_GRID[20], 9)
    }


def test_zero_volatility_equals_plain_fit(panel):
    plain = residual_map(AF.fit_model(panel, AF.ModelSpec()).residuals)
    zero = residual_map(AF.fit_model(panel, AF.ModelSpec(model="afns", n_refit=0)).residuals)
    assert zero == pytest.approx(plain, abs=1e-15)


def test_two_step_equals_repeated_passes(panel):
    """One pass plus the fitted offset gives what refitting y - a gives."""
    fit = AF.fit_model(panel, AF.ModelSpec(model="afns", dt=DT))
    offset = fit.adjustment.select(F.col("issuer").alias("source"), "term", "adjustment")
    moved = panel.join(offset, ["source", "term"]).withColumn("rate", F.col("rate") - F.col("adjustment"))
    again = AF.fit_model(moved, AF.ModelSpec())
    assert residual_map(fit.residuals) == pytest.approx(residual_map(again.residuals), abs=1e-12)
    first = {r["issuer"]: r["s11"] for r in fit.sigma.collect()}
    second = AF.estimate_sigma(again.factors, AF.ModelSpec(model="afns", dt=DT), "issuer")
    assert {r["issuer"]: r["s11"] for r in second.collect()} == pytest.approx(first, rel=1e-6)


def test_constant_offset_keeps_the_networks(panel):
    base = C.residual_table(panel)
    shifted = panel.withColumn("rate", F.col("rate") + F.when(F.col("term") == "10Y", 0.002).otherwise(0.0))

    def edges(df):
        _, e = R.residual_networks(df, threshold=0.1)
        return {(r["label"], r["src"], r["dst"]): r["weight"] for r in e.collect()}

    assert edges(C.residual_table(shifted)) == pytest.approx(edges(base), abs=1e-7)


def test_adjustment_shape(spark):
    terms = spark.createDataFrame([(float(m),) for m in YEARS], "years double")
    shapes = L.afns_shapes(F.col("years"), 1.0)
    rows = terms.select("years", *[v.alias(k) for k, v in shapes.items()]).orderBy("years").collect()
    first = [r["s11"] for r in rows]
    assert first == pytest.approx([m * m / 6 for m in YEARS]) and first == sorted(first)
    assert all(r["s22"] > 0 and r["s33"] > 0 for r in rows)


def test_discrete_adjustment_converges_to_continuous(spark):
    terms = spark.createDataFrame(
        [("a", f"{m:g}Y", float(m), 1.0) for m in (1, 5, 10)],
        "source string, term string, years double, decay double",
    )
    smooth = AF.shape_table(terms, AF.ModelSpec(model="afns"), F.col("decay"))
    daily = AF.shape_table(terms, AF.ModelSpec(model="dtafns", dt=1 / 2520), F.col("decay"))
    for a, b in zip(smooth.orderBy("years").collect(), daily.orderBy("years").collect(), strict=True):
        for k in ("u_s11", "u_s22", "u_s33", "u_s12", "u_s13", "u_s23"):
            assert b[k] == pytest.approx(a[k], rel=5e-3)


def test_percent_panel_scales_residuals(panel):
    percent = panel.withColumn("rate", F.col("rate") * 100.0)
    spec = AF.ModelSpec(model="afns", dt=DT)
    small = residual_map(AF.fit_model(panel, spec).residuals)
    large = residual_map(AF.fit_model(percent, spec).residuals)
    assert P.detect_scale(percent).first()[0] == 0.01
    assert {k: v / 100 for k, v in large.items()} == pytest.approx(small, abs=1e-12)


def test_ragged_panel(panel):
    ragged = panel.where("source <> 'b' OR term IN ('1Y', '2Y', '3Y')")
    cube = C.residual_table(ragged)
    assert {r[0] for r in cube.select("issuer").distinct().collect()} == {"a"}
    assert [r[0] for r in C.skipped_issuers(ragged, cube).collect()] == ["b"]
    with pytest.raises(S.QueryError):
        C.check_cube(cube)


def test_kalman_never_worse_than_seed(panel):
    from stratanet.operators import statespace as K

    rows = K.choose_parameters(panel, AF.ModelSpec(model="afns", dt=DT)).collect()
    assert len(rows) == 2
    assert all(r["estimator"] == "kalman" and r["loglik"] >= r["seed_loglik"] for r in rows)


def test_short_history_keeps_two_step(panel):
    from stratanet.operators import statespace as K

    short = panel.where("date < '2020-01-20'")
    assert {r["estimator"] for r in K.choose_parameters(short, AF.ModelSpec(model="afns", dt=DT)).collect()} == {
        "two_step_fallback"
    }


def test_window_edges(spark):
    days = spark.createDataFrame([(i,) for i in range(10)], "dt int")
    index = W.date_index(days, "dt")
    assert W.window_table(index, "dt", W.Schedule(10, 1)).count() == 1
    assert W.window_table(index, "dt", W.Schedule(11, 1)).count() == 0
    assert W.assign_windows(days, "dt", W.Schedule(11, 1)).count() == 0
    growing = W.assign_windows(days, "dt", W.Schedule(4, 3, expanding=True))
    sizes = {r["window_idx"]: r["count"] for r in growing.groupBy("window_idx").count().collect()}
    assert sizes == {0: 4, 1: 7, 2: 10}
    with pytest.raises(ValueError):
        W.Schedule(2, 1)


def test_store_refuses_other_versions(spark, tmp_path):
    path = str(tmp_path / "store")
    store.save_results(spark, path, {"mln_nodes": spark.range(3)})
    assert store.load_results(spark, path)["mln_nodes"].count() == 3
    spark.createDataFrame([('{"format_version": 99, "frames": []}',)], "value string").coalesce(
        1
    ).write.mode("overwrite").text(f"{path}/_manifest")
    with pytest.raises(S.QueryError):
        store.load_results(spark, path)


def test_append_null_keys_and_bad_batches(spark):
    target = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    batch = spark.createDataFrame([(1, "z"), (2, "p"), (2, "q"), (None, "r")], "k int, v string")
    got = sorted((str(r["k"]), r["v"]) for r in S.append(target, batch, ["k"]).collect())
    assert got == [("1", "x"), ("2", "p"), ("2", "q"), ("None", "r"), ("None", "y")]
    with pytest.raises(S.QueryError):
        S.append(target, batch.withColumn("extra", F.lit(1)))


def test_detect_panel_spellings(spark):
    wide = spark.createDataFrame(
        [("2020-01-01", "us", 1.0, 2.0, 3.0, 4)], "date string, who string, `6M` double, Y010p0 double, `4W` double, n int"
    )
    roles = P.detect_panel(wide, "date")
    assert roles.issuer == "who" and roles.terms == ("4W", "6M", "Y010p0") and roles.usable
    with pytest.raises(ValueError):
        P.apply_transforms(wide, ["nope"], roles.roles(P.NetworkKind.ISSUER_BY_TERM))


def test_a_model_brings_its_own_adjustment():
    from stratanet.functions.loadings import ns_loadings
    from stratanet.operators import arbfree

    with pytest.raises(ValueError):
        arbfree.register_model("mine", ns_loadings)
    try:
        arbfree.register_model("mine", ns_loadings, arbfree.continuous_shapes)
        assert arbfree.SHAPES["mine"] is arbfree.continuous_shapes and "mine" in arbfree.MODELS
    finally:
        for table in (arbfree.LOADINGS, arbfree.SHAPES, arbfree.MODELS):
            table.pop("mine", None)
    assert arbfree.ModelSpec("afns", decay=0.5, estimator="kalman").name == "afns/per_issuer/kalman/d0.5"
    assert arbfree.ModelSpec("ns").name == "ns" and arbfree.ModelSpec("ns", decay=None).name == "ns"
