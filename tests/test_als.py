"""L3: the fitted customer factors solve the last half-step's non-negative normal equations."""

import numpy as np

from cartwise.plans import models as MO

RANK, REG, ALPHA = 4, 0.15, 1.0


def test_factors_solve_the_last_half_step(spark):
    """Implicit feedback: over all products y, (sum y y' + sum over the bought of
    alpha r y y' + reg n I) x = sum over the bought of (1 + alpha r) y, with x >= 0: the
    slope vanishes where x is positive and isn't negative where x is zero."""
    r = np.random.default_rng(11)
    rows = [(u, i, float(np.float32(r.uniform(0.1, 1.0)))) for u in range(30) for i in range(20) if r.random() < 0.4]
    ratings = spark.createDataFrame(rows, "customer_id int, product_id int, minmax_scaled_rating float")
    model = MO.fit_als(ratings, rank=RANK, max_iter=6, reg=REG, alpha=ALPHA)
    x = {f.id: np.array(f.features, float) for f in model.userFactors.collect()}
    y = {f.id: np.array(f.features, float) for f in model.itemFactors.collect()}
    assert x.keys() == {u for u, _, _ in rows} and y.keys() == {i for _, i, _ in rows}
    every = sum(np.outer(v, v) for v in y.values())
    for u, own in x.items():
        bought = [(y[i], s) for c, i, s in rows if c == u]
        left = every + sum(ALPHA * s * np.outer(v, v) for v, s in bought) + REG * len(bought) * np.eye(RANK)
        right = sum((1 + ALPHA * s) * v for v, s in bought)
        slope, size = left @ own - right, np.abs(right).max()
        assert (own >= 0).all()
        assert np.abs(slope[own > 1e-6]).max(initial=0) < 1e-3 * size
        assert slope.min() > -1e-3 * size
