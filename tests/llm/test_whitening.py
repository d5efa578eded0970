"""Components, deviations and whitened values against a dense eigendecomposition in numpy."""

import numpy as np
import pytest

from pulsejobs.llm import whitening
from pulsejobs.llm.shared import table

DATA = "/root/testdata/sf0.001"


def dense(vectors: np.ndarray):
    """n, sums, eigenvalues (falling), eigenvectors as columns, of the distinct rows of whole numbers."""
    fit = np.unique(vectors, axis=0)
    centred = fit - fit.sum(axis=0) / len(fit)
    values, found = np.linalg.eigh(centred.T @ centred / len(fit))
    return len(fit), fit.sum(axis=0), values[::-1], found[:, ::-1]


def frame(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "x array<bigint>")


def aligned(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.abs(a - np.sign(a @ b) * b).max())


@pytest.mark.parametrize("shape", [(300, 12), (40, 64), (7, 5)])
def test_components_of_random_rows(spark, shape):
    x = (np.random.default_rng(5).standard_normal(shape) * np.arange(1, shape[1] + 1) * 40).astype(np.int64)
    w = whitening.fit_whitening(frame(spark, x.tolist()), "x", 4)
    n, sums, values, vectors = dense(x)
    assert w.n == n and (w.sums == sums).all()
    assert np.allclose(w.eigenvalues, values[:4], rtol=1e-12) and w.trace == pytest.approx(values.sum(), rel=1e-12)
    assert max(aligned(w.components[i], vectors[:, i]) for i in range(4)) < 1e-11
    assert w.identity_error < 1e-11


def test_equal_eigenvalues_are_all_found(spark):
    axes = np.eye(6, dtype=np.int64) * 100
    w = whitening.fit_whitening(frame(spark, [*axes.tolist(), *(-axes).tolist()]), "x", 4)
    assert np.allclose(w.eigenvalues, 2 * 100**2 / 12) and np.allclose(w.components @ w.components.T, np.eye(4))
    twice = [[9, 0, 0, 0, 0], [-9, 0, 0, 0, 0], [0, 9, 0, 0, 0], [0, -9, 0, 0, 0], [0, 0, 3, 0, 0], [0, 0, -3, 0, 0], [0, 0, 0, 2, 0], [0, 0, 0, -2, 0], [0, 0, 0, 0, 1], [0, 0, 0, 0, -1]]
    w = whitening.fit_whitening(frame(spark, twice), "x", 3)
    assert np.allclose(w.eigenvalues, [16.2, 16.2, 1.8]) and w.identity_error < 1e-12


def test_small_rank_and_nothing_that_varies(spark):
    line = whitening.fit_whitening(frame(spark, [[k, 2 * k, 5] for k in range(9)]), "x", 3)
    assert len(line.eigenvalues) == 1 and line.eigenvalues[0] == pytest.approx(line.trace)
    same = whitening.fit_whitening(frame(spark, [[4, 4]] * 5), "x", 3)
    assert (same.n, len(same.eigenvalues), same.identity_error) == (1, 0, None)
    assert whitening.fit_whitening(frame(spark, []), "x").n == 0


def test_other_columns_and_names_stay(spark):
    df = spark.createDataFrame([(1, [1, 5], "a", 0.5), (1, [1, 5], "a", 0.5), (None, [3, 4], None, None), (2, [-7, 2], "b", 1.0)], "vec_id long, x array<bigint>, `whit.ened` string, whitening double")
    w = whitening.fit_whitening(df, "x", 2)
    out = whitening.apply_whitening(df.drop("whitening"), w, "x").collect()
    assert len(out) == 4 and sorted(r["whit.ened"] or "" for r in out) == ["", "a", "a", "b"]
    for r in out:
        assert r["whitening"]["deviation"] == sum((3 * a - s) ** 2 for a, s in zip(r["x"], w.sums.tolist(), strict=True))


def test_deviation_beyond_64_bits_is_null(spark):
    big = 2**40
    df = frame(spark, [[big, 0], [0, 1], [-big, 3]])
    out = whitening.apply_whitening(df, whitening.fit_whitening(df, "x", 1), "x").collect()
    assert sorted(r["whitening"]["deviation"] is None for r in out) == [False, True, True]


def test_query_drops_what_is_no_vector(spark, tmp_path):
    rows = [(1, [0.5, 1.0]), (2, [0.25, -1.0]), (3, None), (4, []), (5, [1.0, float("nan")]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (9, [0.5, 1.0]), (None, [-3.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = whitening.op11_whitening(spark, str(tmp_path)).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in out) == sorted((i, c) for i in (0, 1, 2, 9) for c in (1, 2))
    assert {r["n"] for r in out} == {3}
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert whitening.op11_whitening(spark, str(tmp_path / "none")).collect() == []


def test_query_on_its_table(spark):
    out = whitening.op11_whitening(spark, DATA).collect()
    given = table(spark, DATA, "embeddings").select("vec_id", "embedding").collect()
    x = {r["vec_id"]: np.floor(256 * np.array(r["embedding"], float)).astype(np.int64) for r in given}
    n, sums, values, vectors = dense(np.array(list(x.values())))
    assert len(out) == 4 * len(given)
    by = {(r["vec_id"], r["component"]): r for r in out}
    for k in range(4):
        y = {i: (v - sums / n) @ vectors[:, k] / np.sqrt(values[k]) for i, v in x.items()}
        sign = np.sign(sum(y[i] * by[i, k + 1]["whitened"] for i in x))
        for i in x:
            r = by[i, k + 1]
            assert r["whitened"] == pytest.approx(sign * y[i], abs=1e-9)
            assert r["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-10)
            assert (r["n"], r["deviation"]) == (n, int(((n * x[i] - sums) ** 2).sum()))
            assert r["identity_error"] < 1e-10
