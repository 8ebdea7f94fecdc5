"""Association, agreement and audits against pandas and hand-made frames."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from armwave.operators import assoc, audit, columns, filters
from armwave.session import scratch_path


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 30)) + 100
    x[:, 1] = x[:, 0] * 2
    x[:, 5] = 0.9 * x[:, 0] + rng.normal(scale=0.1, size=500)
    x[:, 7] = 3.0
    x[rng.random(x.shape) < 0.15] = np.nan
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(30)])
    df = spark.createDataFrame(pdf).repartition(6)
    return pdf, df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in pdf.columns])


def test_correlation_matrix_is_pairwise_complete(wide):
    pdf, df = wide
    got = assoc.corr_matrix(df, list(pdf.columns)).toPandas()
    want = pdf.corr()
    assert len(got) == 30 * 29 // 2
    for r in got.itertuples():
        w = want.loc[r.left, r.right]
        assert (math.isnan(w) and (r.weight is None or math.isnan(r.weight))) or abs(r.weight - w) < 1e-9
        assert r.n == (pdf[r.left].notna() & pdf[r.right].notna()).sum()


def test_cosine_after_imputation(wide):
    pdf, df = wide
    x = pdf.fillna(pdf.mean()).to_numpy()
    x = x / np.linalg.norm(x, axis=0)
    want = pd.DataFrame(x.T @ x, index=pdf.columns, columns=pdf.columns)
    for r in assoc.cosine_matrix(df, list(pdf.columns)).toPandas().itertuples():
        assert abs(r.weight - want.loc[r.left, r.right]) < 1e-9


def test_graph_signs_and_isolated_nodes(spark):
    m = spark.createDataFrame([("a", "b", 0.9), ("a", "c", -0.8), ("b", "c", 0.1), ("a", "d", None)], "left string, right string, weight double")
    signed = assoc.similarity_graph(m, 0.5, signed=True)
    assert {(r["left"], r["right"], r["colour"]) for r in signed.collect()} == {("a", "b", "blue"), ("a", "c", "red")}
    assert {r["node"]: r["degree"] for r in assoc.graph_nodes(m, signed, "abcd").collect()} == {"a": 2, "b": 1, "c": 1, "d": 0}
    assert {r["colour"] for r in assoc.similarity_graph(m, 0.5).collect()} == {"blue"}


def test_correlation_selector(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=400)
    pdf = pd.DataFrame({"a": a, "b": a, "c": 0.9 * a + rng.normal(scale=0.2, size=400), "d": rng.normal(size=400)})
    df = spark.createDataFrame(pdf)
    model = Pipeline(stages=[assoc.CorrelationSelector(inputCols=list("abcd"), threshold=0.8)]).fit(df)
    assert model.stages[0].dropped == ["b", "c"] and model.transform(df).columns == ["a", "d"]
    path = scratch_path(spark, "selector")
    model.stages[0].write().save(path)
    assert assoc.CorrelationSelectorModel.load(path).dropped == ["b", "c"]


def test_icc3_known_ratings(spark):
    # six targets by four raters: the textbook table with ICC(3,1) = 0.71
    table = [[9, 2, 5, 8], [6, 1, 3, 2], [8, 4, 6, 8], [7, 1, 2, 6], [10, 5, 6, 9], [6, 2, 4, 7]]
    rows = [(t, f"r{j}", float(v)) for t, line in enumerate(table) for j, v in enumerate(line)]
    df = spark.createDataFrame(rows + [(9, "r0", 1.0)], "target long, rater string, value double")
    got = assoc.icc(df, "target", "rater", "value", ["r0", "r1", "r2", "r3"])
    assert abs(got["icc"] - 0.7148) < 1e-4 and abs(got["f"] - 11.027) < 1e-2 and got["df2"] == 15
    assert abs(got["ci_low"] - 0.3425) < 1e-3 and abs(got["ci_high"] - 0.9459) < 1e-3 and got["p"] < 0.001


def test_wilcoxon(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 2.0), (5.0, 3.0), (1.0, 4.0), (9.0, 5.0)], "a double, b double")
    row = assoc.wilcoxon(df, "a", "b").first()
    assert (row["n"], row["w_plus"], row["w_minus"], row["w"]) == (4, 7.0, 3.0, 3.0)
    assert abs(assoc.wilcoxon_p(4, 3.0) - 0.625) < 1e-12
    assert abs(assoc.wilcoxon_p(5, 0.0) - 0.0625) < 1e-12


def test_vif_and_p_values(wide, spark):
    pdf, df = wide
    cols = ["c2", "c3", "c4"]
    r = pdf[cols].corr().to_numpy()
    got = assoc.vif(df, cols)
    np.testing.assert_allclose(list(got.values()), np.diag(np.linalg.inv(r)), rtol=1e-9)
    assert abs(assoc.corr_p_value(0.5, 20) - 0.02476) < 1e-4
    row = assoc.with_corr_p(assoc.corr_with(df, "c2", ["c3"])).first()
    assert abs(row["p"] - assoc.corr_p_value(row["r"], row["n"])) < 1e-12
    t = spark.createDataFrame([(2.0, 10), (None, 3)], "t double, free int").withColumn("p", assoc.p_value_column("t", "free")).collect()
    assert abs(t[0]["p"] - 0.07339) < 1e-4 and t[1]["p"] is None


def test_raw_twins_and_names(spark):
    assert audit.raw_twins(["abcx", "abct", "defx", "ghi", "ghi_raw"]) == [("abcx", "abct"), ("ghi_raw", "ghi")] or \
        [p[0] for p in audit.raw_twins(["abcx", "abct", "defx", "ghi", "ghi_raw"])] == ["abcx", "ghi_raw"]
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], ["abcx", "abct", "defx", "ghi", "ghi_raw"])
    assert audit.drop_raw_twins(df).columns == ["abct", "defx", "ghi"]
    assert audit.drop_raw_twins(df, add=["ghi"], keep=["abcx"]).columns == ["abcx", "abct", "defx"]
    assert audit.dup_columns(df.select("ghi", "abct", "ghi")) == ["ghi"]
    assert audit.name_report(["ax", "bt", "craw"])["unusable"]


def test_profile_approximate(wide):
    pdf, df = wide
    exact = {r["column"]: r for r in audit.profile(df).collect()}
    rough = {r["column"]: r for r in audit.profile(df, approx=True).collect()}
    assert exact["c7"]["distinct"] == 1 and exact["c0"]["non_null"] == pdf["c0"].notna().sum()
    assert all(abs(rough[c]["distinct"] - exact[c]["distinct"]) <= 0.2 * exact[c]["distinct"] + 1 for c in exact)


def test_three_valued_flag(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 0, None), (4, None, None), (5, None, 1)], "id int, a int, b int")
    got = {r["id"]: r["f"] for r in df.select("id", filters.any_flag(["a", "b"]).alias("f")).collect()}
    assert got == {1: 0, 2: 1, 3: None, 4: None, 5: 1}


def test_missing_codes_have_text_twins(spark):
    df = spark.createDataFrame([(-999, -999.0, "-999"), (88, 88.0, "88"), (1, 1.5, None)], "i int, d double, s string")
    got = columns.null_codes(df, [-999, 88], skip={"i": [88]}).collect()
    assert [tuple(r) for r in got] == [(None, None, None), (88, None, None), (1, 1.5, None)]
    assert {tuple(r) for r in audit.verify_audit(df, [88]).collect()} == {("88", "i"), ("88", "s"), ("88.0", "d")}


def test_mask_rejects_unknown(spark):
    with pytest.raises(ValueError):
        filters.mask(spark.range(3), "id", "like", 1)
    assert filters.mask(spark.range(10), "id", "range", 5, 2).count() == 5
    assert filters.mask(spark.range(10), "id", "open", (3, 7)).count() == 3
