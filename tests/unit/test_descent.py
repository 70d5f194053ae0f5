"""Batch gradient descent against NumPy, on one task and on several."""

import random

import numpy as np
import pytest

from strandline.operators import descent


def by_numpy(x, y, steps, rate, ridge):
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) == 0, 1, x.std(axis=0))
    w = np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(w[0] + z @ w[1:], -50, 50)))
        g = np.concatenate([[(p - y).mean()], ((p - y)[:, None] * z).mean(axis=0) + ridge * w[1:] / len(y)])
        w = w - rate * g
    return w


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for _ in range(300):
        a, b = round(rng.gauss(0, 1), 1), rng.choice([1.0, 2.0, 5.0])
        out.append((a, b, 3.0, int(rng.random() < 1 / (1 + 2.0 ** -(2 * a - b)))))
    return out + out[:50]


@pytest.mark.parametrize(("task_rows", "steps"), [(1_000, 4_000), (130, 8)])
def test_equals_numpy(spark, rows, task_rows, steps):
    df = spark.createDataFrame([*rows, (None, 1.0, 3.0, 1), (1.0, 1.0, 3.0, None)], "a double, b double, c double, y int")
    m = descent.fit_descent(df, ["a", "b", "c"], "y", steps=steps, task_rows=task_rows)
    data = np.array(rows, dtype=float)
    want = by_numpy(data[:, :3], data[:, 3], steps, 0.05, 1.0)
    assert np.allclose(m.weights, want, rtol=0, atol=1e-9) and m.deviations[2] == 1.0


def test_no_rows(spark):
    m = descent.fit_descent(spark.createDataFrame([], "a double, y int"), ["a"], "y")
    assert m.weights == (0.0, 0.0) and spark.createDataFrame([(4.0,)], "a double").select(m.probability()).first()[0] == 0.5


def test_directions_and_gates(spark):
    rng = random.Random(2)
    rows = []
    for k in range(200):
        s, r = rng.gauss(0, 1), rng.gauss(0, 1)
        gain = 1 if s + 0.1 * rng.gauss(0, 1) > 0 else -1
        rows.append((k, "A" if k < 120 else "B", s, r, 10 * gain, -10 * gain))
    df = spark.createDataFrame([*rows, (900, "A", None, 1.0, 1, 1)], "k long, part string, s double, r double, up long, down long")
    m = descent.fit_directions(df.where("part = 'A'"), ["s", "r"], "up", "down", steps=500)
    x = np.array([[a * s, abs(s), a * r, abs(r)] for _, p, s, r, *_ in rows if p == "A" for a in (1, -1)])
    y = np.array([float(n > 0) for _, p, _, _, up, down in rows if p == "A" for n in (up, down)])
    assert np.allclose(m.weights, by_numpy(x, y, 500, 0.05, 1.0), rtol=0, atol=1e-9)
    scored = descent.best_direction(df, m, ["s", "r"], "up", "down")
    got = {r.k: r for r in scored.collect()}
    assert set(got) == set(range(200)) and sum(r.net > 0 for r in got.values()) > 180
    gates = {(r.gate, r.part): r for r in descent.top_gates(scored, "part", "A", {"T10": "0.90", "T05": "0.95"}).collect()}
    train = sorted(r.probability for r in got.values() if r.part == "A")
    for gate, p in (("T10", 0.9), ("T05", 0.95)):
        bound = float(np.quantile(train, p))
        for part in "AB":
            hit = [r for r in got.values() if r.part == part and r.probability >= gates[gate, part].threshold]
            assert gates[gate, part].threshold == pytest.approx(bound) and (gates[gate, part].trades, gates[gate, part].winners, gates[gate, part].net) == (len(hit), sum(r.net > 0 for r in hit), sum(r.net for r in hit))
