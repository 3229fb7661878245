import numpy as np
import pytest

from helixbin.operators import network as N


def tiny():
    return N.Model({"composition": N.Branch((136,), (8, 4)), "coverage": N.Branch((9, 2), (8, 4), filters=2, kernel=3, stride=2)}, 2)


def inputs(rng, n):
    return {"composition": rng.normal(size=(n, 136)), "coverage": rng.normal(size=(n, 2, 9))}


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(0)
    m, a, b, y = tiny(), inputs(rng, 6), inputs(rng, 6), rng.integers(0, 2, 6).astype(float)
    _, grads = m.gradients(a, b, y)
    for k, v in m.parameters().items():
        i = tuple(rng.integers(0, s) for s in v.shape)
        old = v[i]
        v[i] = old + 1e-6
        up = m.loss(m.forward(a, b), y)
        v[i] = old - 1e-6
        down = m.loss(m.forward(a, b), y)
        v[i] = old
        assert (up - down) / 2e-6 == pytest.approx(grads[k][i], abs=1e-4)


def test_symmetry_and_shapes():
    rng = np.random.default_rng(1)
    m, a, b = tiny(), inputs(rng, 5), inputs(rng, 5)
    p, q = m.forward(a, b), m.forward(b, a)
    assert all(np.allclose(p[k], q[k]) for k in p) and set(p) == {"composition", "coverage", "combined"}
    assert m.latent("composition", a["composition"]).shape == m.latent("coverage", a["coverage"]).shape == (5, 8)


def test_training_learns_and_checkpoints(tmp_path):
    rng = np.random.default_rng(2)
    m = N.Model({"composition": N.Branch((10,), (16, 8))})
    centres = rng.normal(size=(4, 10)) * 3

    def batch(n):
        i, same = rng.integers(0, 4, n), rng.random(n) < 0.5
        j = np.where(same, i, (i + rng.integers(1, 4, n)) % 4)
        return {"composition": centres[i] + rng.normal(size=(n, 10))}, {"composition": centres[j] + rng.normal(size=(n, 10))}, (i == j).astype(float)

    test = batch(400)
    losses = N.train(m, lambda: (batch(64) for _ in range(400)), test, 5e-3, 50, 5, 400)
    assert losses[-1] < losses[0] and N.scores(m.forward(*test[:2]), test[2])["composition"]["acc"] > 0.9
    m.save(str(tmp_path / "m.npz"))
    other = N.Model({"composition": N.Branch((10,), (16, 8), seed=5)})
    other.load(str(tmp_path / "m.npz"))
    assert np.allclose(other.forward(*test[:2])["composition"], m.forward(*test[:2])["composition"])
    with pytest.raises(RuntimeError):
        tiny().load(str(tmp_path / "m.npz"))
