import numpy as np
import pytest

from seriesmill.operators import detectors as de


def waves(n, size=24, seed=0):
    r = np.random.default_rng(seed)
    t = np.arange(size + 1) + r.uniform(0, 8, (n, 1))
    return np.sin(2 * np.pi * t / 8) + 0.05 * r.normal(size=(n, size + 1))


@pytest.mark.parametrize("kind, options", [(de.ConvForecaster, {"channels": 3}), (de.PeriodForecaster, {"width": 4, "blocks": 2})])
def test_gradients_against_differences(kind, options):
    x = waves(5, 11)
    model = kind(x, epochs=0, **options)
    loss = lambda: ((model._forward(x[:, :-1])[0] - x[:, -1]) ** 2).mean()
    if kind is de.PeriodForecaster:  # strengths count as constants
        fixed = {}
        plain = de.top_periods

        def held(h, top, calls=[0]):
            calls[0] += 1
            return fixed.setdefault((calls[0] - 1) % options["blocks"], plain(h, top))

        de.top_periods, undo = held, plain
    try:
        forecast, kept = model._forward(x[:, :-1])
        grads = model._backward(2 * (forecast - x[:, -1]) / len(x), kept)
        r = np.random.default_rng(1)
        for p, g in zip(model.parameters, grads, strict=True):
            assert p.shape == g.shape
            for _ in range(4):
                at = tuple(r.integers(0, n) for n in p.shape)
                old = p[at]
                p[at] = old + 1e-5
                up = loss()
                p[at] = old - 1e-5
                down = loss()
                p[at] = old
                assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6, rel=1e-3)
    finally:
        if kind is de.PeriodForecaster:
            de.top_periods = undo


@pytest.mark.parametrize("kind, options, share", [(de.ConvForecaster, {"channels": 16, "epochs": 30}, 0.75), (de.PeriodForecaster, {"width": 8, "epochs": 60, "blocks": 1, "top": 2}, 0.5)])
def test_forecasters_learn_a_wave(kind, options, share):
    """The mean over the window leaves a convolution little but its ends to tell the phase from."""
    model, test = kind(waves(600), size=32, **options), waves(200, seed=1)
    odd = test.copy()
    odd[:, -1] += 3
    assert model(test).mean() < share * test[:, -1].var() and (model(odd) > model(test)).mean() > 0.95
    assert len(model(test[:0])) == 0


def test_top_periods():
    periods, weight = de.top_periods(waves(20)[:, :24, None], 2)
    assert periods[0] == 8 and weight.sum() == pytest.approx(1)
    assert de.top_periods(np.zeros((2, 1, 1)), 3)[0] == [1]


def test_outliers_score_higher():
    r = np.random.default_rng(2)
    x, odd = r.normal(size=(600, 3)), r.normal(size=(20, 3)) + 7
    for fit in (lambda v: de.IsolationForest(v), de.LocalOutlierFactor, de.OneClassBoundary, lambda v: de.AutoEncoder(v, epochs=20)):
        model = fit(x)
        assert np.median(model(odd)) > np.quantile(model(x), 0.95)


def test_isolation_forest_depth_against_a_plain_walk():
    assert de._path_length(1) == 0 and de._path_length(2) == 1
    assert de._path_length(256) == pytest.approx(2 * (np.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_local_outlier_factor_against_its_definition():
    r = np.random.default_rng(3)
    x, k = r.normal(size=(40, 2)), 5
    q = r.normal(size=(6, 2)) * 2
    z = lambda v: v
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :k]
    reach = np.sort(d, axis=1)[:, k - 1]
    density = 1 / np.array([np.maximum(reach[near[i]], d[i, near[i]]).mean() for i in range(len(x))])
    own = []
    for v in q:
        dv = np.linalg.norm(x - z(v), axis=1)
        n = np.argsort(dv)[:k]
        own.append(density[n].mean() * np.maximum(reach[n], dv[n]).mean())
    got = de.LocalOutlierFactor(x, k)(q)
    assert np.corrcoef(got, own)[0, 1] > 0.99
