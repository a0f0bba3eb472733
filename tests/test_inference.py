"""Bootstrap and permutation inference against plain NumPy with the same weights, and worked cases."""

import hashlib
import math
import random

import numpy as np
import pytest

from trailmill.operators import inference as I
from trailmill.operators.sessionize import SEMANTIC_ACTIONS


def fmix(x):
    x ^= x >> 16
    x = x * 0x85EBCA6B % 2**32
    x ^= x >> 13
    x = x * 0xC2B2AE35 % 2**32
    return x ^ x >> 16


def drawn(keys, n, seed):
    """Hash of each key (row) in each replicate (column), one at a time."""
    out = np.zeros((len(keys), n))
    for i, k in enumerate(keys):
        d = hashlib.md5(str(k).encode()).hexdigest()
        a, b = int(d[:8], 16), int(d[8:16], 16)
        out[i] = [fmix(a ^ fmix(b ^ fmix(r ^ seed))) for r in range(n)]
    return out


def counts(h):
    return np.searchsorted([int(c * 2**32) for c in I.POISSON], h, side="right")


def jsd(p, q):
    p, q = np.asarray(p, float) + 1e-12, np.asarray(q, float) + 1e-12
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    return float(0.5 * (p * np.log(p / m)).sum() + 0.5 * (q * np.log(q / m)).sum())


def plain_metrics(real, synth, ids):
    """The eight metrics over a list of session ids in which an id may stand more than once; sides are {id: (actions, coherence, similarity)}."""
    def flags(a):
        return ["checkout" in a, "add" in a, all(x in ("detail", "explore-search", "explore-goto", "explore-back", "explore-stay", "terminate") for x in a), "add" in a and "checkout" not in a]

    def shares(side):
        c = np.array([sum(side[i][0].count(x) for i in ids) for x in SEMANTIC_ACTIONS], float)
        return c / max(c.sum(), 1)

    def matrix(side):
        m = np.zeros((9, 9))
        for i in ids:
            for x, y in zip(side[i][0], side[i][0][1:]):
                if x in SEMANTIC_ACTIONS and y in SEMANTIC_ACTIONS:
                    m[SEMANTIC_ACTIONS.index(x), SEMANTIC_ACTIONS.index(y)] += 1
        s = m.sum(1, keepdims=True)
        return m / np.where(s == 0, 1, s)

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1] / max(len(a), len(b))

    lengths = [[len(side[i][0]) for i in ids] for side in (real, synth)]
    size = max(map(max, lengths)) + 1
    hist = [np.bincount(n, minlength=size) / len(n) for n in lengths]
    coh = [[side[i][1] for i in ids if side[i][1] is not None] for side in (real, synth)]
    sim = [synth[i][2] for i in ids if synth[i][2] is not None]
    mean = lambda x: sum(x) / len(x) if x else 0.0
    return {
        "outcome_jsd": jsd(*(np.mean([flags(side[i][0]) for i in ids], 0) for side in (real, synth))),
        "action_freq_jsd": jsd(shares(real), shares(synth)),
        "session_length_jsd": jsd(*hist),
        "transition_matrix_L1": abs(matrix(real) - matrix(synth)).sum(),
        "trajectory_lev_distance": mean([edit(real[i][0], synth[i][0]) for i in ids]),
        "product_coherence_gap": abs(mean(coh[0]) - mean(coh[1])),
        "product_diversity_ratio": len(coh[1]) / len(coh[0]) - 1 if coh[0] else 0.0,
        "product_sim_per_session": mean(sim),
    }


@pytest.fixture(scope="module")
def sides():
    r = random.Random(3)
    kinds = [*SEMANTIC_ACTIONS, "Other"]

    def side(weights, ids):
        return {i: (r.choices(kinds, weights, k=r.randint(1, 9)), r.random() if r.random() < 0.6 else None, r.random() if r.random() < 0.7 else None) for i in ids}

    return {"real": side([9, 5, 4, 3, 2, 2, 2, 1, 1, 1], range(14)), "ours": side([8, 5, 4, 3, 2, 2, 2, 1, 1, 1], range(13)), "other": side([1] * 10, range(1, 14))}


def frames(spark, sides):
    steps = {n: spark.createDataFrame([(i, k, a) for i, (actions, _, _) in s.items() for k, a in enumerate(actions)], "session_id long, ord int, action string") for n, s in sides.items()}
    scores = {n: spark.createDataFrame([(i, c, m) for i, (_, c, m) in s.items()], "session_id long, coherence double, similarity double") for n, s in sides.items()}
    return steps, scores


def test_eight_metrics_of_resampled_sessions(spark, sides):
    steps, scores = frames(spark, sides)
    n, ids = 1_203, list(range(1, 13))
    got = {(r.replicate, r.metric): (r.ours, r.theirs) for r in I.metric_replicates(steps["real"], {"ours": steps["ours"], "other": steps["other"]}, "ours", scores, n, 42).collect()}
    assert len(got) == (n + 1) * 8
    w = counts(drawn(ids, n, 42))
    for r in [-1, *range(40), 999, 1_000, 1_202]:
        some = ids if r < 0 else [i for k, i in enumerate(ids) for _ in range(w[k, r])]
        ours, other = (plain_metrics(sides["real"], sides[m], some) for m in ("ours", "other"))
        for x in I.METRICS:
            assert got[r, x] == pytest.approx((ours[x], other[x]), abs=1e-9), (r, x)


def test_permutation_and_table(spark, sides):
    steps, scores = frames(spark, sides)
    n, ids = 301, list(range(1, 13))
    synths = {"other": steps["other"], "ours": steps["ours"]}
    flip = drawn(ids, n, 43) >= 2**31
    stars = []
    for r in range(n):
        a = {i: sides["other" if flip[k, r] else "ours"][i] for k, i in enumerate(ids)}
        b = {i: sides["ours" if flip[k, r] else "other"][i] for k, i in enumerate(ids)}
        stars.append((plain_metrics(sides["real"], a, ids), plain_metrics(sides["real"], b, ids)))
    w = counts(drawn(ids, n, 42))
    boots = [(plain_metrics(sides["real"], sides["ours"], s), plain_metrics(sides["real"], sides["other"], s)) for r in range(n) for s in [[i for k, i in enumerate(ids) for _ in range(w[k, r])]]]
    ours, other = (plain_metrics(sides["real"], sides[m], ids) for m in ("ours", "other"))
    table = {r.metric: r for r in I.fidelity_table(steps["real"], synths, "ours", scores, n, n).collect()}
    assert set(table) == set(I.METRICS)
    for x, r in table.items():
        d, star = ours[x] - other[x], np.array([a[x] - b[x] for a, b in stars])
        assert (r.method, r.ours_value, r.method_value, r.delta) == ("other", pytest.approx(ours[x], abs=1e-9), pytest.approx(other[x], abs=1e-9), pytest.approx(d, abs=1e-9))
        assert (r.ci_low, r.ci_high) == pytest.approx(tuple(np.percentile([a[x] - b[x] for a, b in boots], [2.5, 97.5])), abs=1e-9)
        if x == "product_sim_per_session":
            one = star >= d
        elif x == "product_diversity_ratio":
            one = np.array([abs(a[x]) - abs(b[x]) for a, b in stars]) <= abs(ours[x]) - abs(other[x])
        else:
            one = star <= d
        near = np.abs(np.abs(star) - abs(d)).min() < 1e-12 or np.abs(star - d).min() < 1e-12  # equal up to the order of sums
        assert r.p_two_sided == pytest.approx((1 + (abs(star) >= abs(d)).sum()) / (n + 1), abs=0.02 if near else 1e-12)
        assert r.p_one_sided == pytest.approx((1 + one.sum()) / (n + 1), abs=0.02 if near else 1e-12)
        assert r.significant_interval == (r.ci_low > 0 or r.ci_high < 0) and r.significant_permutation == (r.p_two_sided < 0.05)


def test_directions_of_one_sided_tests(spark):
    """Ours equals the real sessions, the other method never does: better in all that can be better, with the least p that the rounds allow."""
    real = {i: (["detail"] * (1 + i % 4) + ["add", "checkout"], 0.5, 0.9) for i in range(12)}
    bad = {i: (["explore-back"] * 7, 0.1, 0.2) for i in range(12)}
    steps, scores = frames(spark, {"real": real, "good": real, "bad": bad})
    table = {r.metric: r for r in I.fidelity_table(steps["real"], {"good": steps["good"], "bad": steps["bad"]}, "good", scores, 50, 400).collect()}
    for x, r in table.items():
        if x == "product_diversity_ratio":
            assert (r.delta, r.p_one_sided, r.p_two_sided) == (0, 1, 1)
        else:
            assert r.p_one_sided <= 3 / 401 and (r.delta > 0) == (x == "product_sim_per_session"), x


def test_ratio_and_permutation_of_10000(spark):
    from trailmill.plans import registry
    import trailmill.plans  # noqa: F401
    from trailmill.plans.fixtures import provider_events

    data = "/root/testdata/sf0.001"
    sums = {}
    for r in provider_events(spark, data).select("session_id", "price", "side").collect():
        x = sums.setdefault(r.session_id, [0, 0, 0])
        x[0], x[1], x[2] = x[0] + round((r.price or 0) * 100), x[1] + 1, x[2] + (1 if r.side == 0 else -1)
    keys = list(sums)[:400]
    some = spark.createDataFrame([(k, *sums[k]) for k in keys] + [(None, 5, 5, 5)], "k long, t long, c long, d long")
    t, c, d = np.array([sums[k] for k in keys]).T
    h = drawn(keys, 1_100, 7)
    w = counts(h)
    got = {r.replicate: r.value for r in I.bootstrap_ratio(some, "k", "t", "c", 1_100, 7).collect()}
    assert [got[k] for k in range(1_100)] == pytest.approx((t @ w) / (c @ w), rel=1e-14) and len(got) == 1_100
    zero = some.withColumn("z", some.d * 0)
    p = I.permutation_p(zero.where("k IS NOT NULL"), "k", "d", "z", 1_100, 7).first()
    star = d @ np.where(h >= 2**31, -1, 1)
    assert (p.difference, p.p) == pytest.approx((d.mean(), ((abs(star) >= abs(d.sum())).sum() + 1) / 1_101))
    assert len(registry.queries()["sta1_3_bootstrap"](spark, data).collect()) == 10_000


def test_contrasts(spark):
    r = random.Random(5)
    cells = {(m, c, s, g, e): r.random() for m in ("a", "b") for c in ("real_to_real", "x", "y") for s in (1, 2, 3) for g in range(9) for e in range(1 + g % 3)}
    rows = [(*k, v, float(v > 0.5)) for k, v in cells.items()] + [("lone", "x", 1, 0, 0, 0.5, 1.0)]
    scores = spark.createDataFrame(rows, "method string, condition string, seed long, session long, example long, rr double, hit double")
    n = 120
    w = counts(drawn(range(9), n, 42))
    size = np.array([1 + g % 3 for g in range(9)])

    def mean(m, c, f, weights, seeds=(1, 2, 3)):
        return np.mean([sum(weights[g] * f(cells[m, c, s, g, e]) for g in range(9) for e in range(size[g])) / (weights @ size) for s in seeds])

    found = {(x.replicate, x.method, x.condition, x.metric): x for x in I.contrast_replicates(scores, ["rr", "hit"], replicates=n).collect()}
    assert len(found) == (n + 1) * 2 * 2 * 2
    kinds = {"rr": lambda v: v, "hit": lambda v: float(v > 0.5)}
    for (rep, m, c, x), row in found.items():
        weights = np.ones(9) if rep < 0 else w[:, rep]
        assert (row.arm, row.base) == pytest.approx((mean(m, c, kinds[x], weights), mean(m, "real_to_real", kinds[x], weights)), abs=1e-12)
    table = I.contrast_table(I.contrast_replicates(scores, ["rr", "hit"], replicates=n)).collect()
    assert len(table) == 8
    for row in table:
        d = np.round([100 * (found[k, row.method, row.condition, row.metric].arm - found[k, row.method, row.condition, row.metric].base) for k in range(n)], 9)
        assert (row.ci_low, row.ci_high, row.lower_bound) == pytest.approx(tuple(np.percentile(d, [2.5, 97.5, 5])), abs=1e-9)
        assert row.se == pytest.approx(d.std(ddof=1)) and row.p == pytest.approx(min(1, 2 * min((d <= 0).mean(), (d >= 0).mean())))
        assert row.non_inferior == (row.lower_bound > -2) and row.equivalent == (row.ci_low > -2 and row.ci_high < 2)
    ordered = sorted(table, key=lambda t: (t.p, f"{t.method}|{t.metric}|{t.condition}"))
    running = 0.0
    for rank, row in enumerate(ordered):
        running = max(running, min(1.0, (8 - rank) * row.p))
        assert row.p_holm == pytest.approx(running)

    # Seeds drawn again: each mean is over three seeds of the arm, and all three in the data as they are.
    again = {(x.replicate, x.method, x.condition, x.metric): x for x in I.contrast_replicates(scores, ["rr"], replicates=n, resample_seeds=True).collect()}
    from itertools import combinations_with_replacement
    for rep in (-1, 0, 1, 2):
        weights = np.ones(9) if rep < 0 else w[:, rep]
        of_seed = [mean("a", "x", kinds["rr"], weights, (s,)) for s in (1, 2, 3)]
        can = [np.mean(of_seed)] if rep < 0 else [np.mean(c) for c in combinations_with_replacement(of_seed, 3)]
        assert min(abs(again[rep, "a", "x", "rr"].arm - c) for c in can) < 1e-12
    assert len({again[k, "a", "x", "rr"].arm - found[k, "a", "x", "rr"].arm for k in range(n)}) > n // 2

    with pytest.raises(ValueError, match="examples differ"):
        I.contrast_replicates(scores.where("NOT (method = 'a' AND condition = 'x' AND seed = 2 AND session = 3)"), ["rr"])
    assert I.contrast_replicates(scores.where("method = 'lone'"), ["rr"], replicates=3).count() == 0


def test_empty_and_odd_input(spark):
    none = spark.createDataFrame([], "k long, t long, c long")
    assert I.bootstrap_ratio(none, "k", "t", "c", 5).count() == 0
    with pytest.raises(ValueError):
        I.bootstrap_ratio(none, "k", "t", "c", 0)
    alone = spark.createDataFrame([(1, 2, 1)], "k long, t long, c long")
    got = [r.value for r in I.bootstrap_ratio(alone, "k", "t", "c", 200).collect()]
    assert set(got) == {None, 2.0} and math.isclose(got.count(None) / 200, math.exp(-1), abs_tol=0.1)
