"""Hard negatives against plain Python, the product against numpy's, the heaps against sorting."""

from collections import Counter

import numpy as np
import pytest

from realcurve.llm import hard_negatives as hn


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 3, 7), (64, 64, 64), (101, 67, 90), (200, 1, 33), (130, 129, 131), (3, 0, 4)])
def test_strassen_equals_the_product(shape):
    rng = np.random.default_rng(sum(shape))
    m, k, n = shape
    a, b = rng.integers(-(2**24), 2**24, (m, k)), rng.integers(-(2**24), 2**24, (k, n))
    assert (hn.strassen(a, b, leaf=4) == a @ b).all() and (hn.strassen(a, b) == a @ b).all()


def test_heaps_equal_sorting():
    rng = np.random.default_rng(2)
    scores, fits = rng.integers(0, 12, (9, 400)), rng.random((9, 400)) < 0.3
    fits[3] = False
    fits[4, 1:] = False
    heaps = hn.Heaps(9, 5)
    for at in range(0, 400, 3):
        heaps.merge(scores[:, at : at + 3], fits[:, at : at + 3], at)
    for i in range(9):
        want = sorted((-s, k) for k, s in enumerate(scores[i]) if fits[i, k])[:5]
        assert [(-s, k) for s, k in zip(heaps.scores[i], heaps.places[i]) if k >= 0] == want


def brute(rows, every=50, moved=7):
    used = []
    for i, v, c in rows:
        if c is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        x = [int(np.floor(256 * float(np.float32(y)))) for y in v]
        if sum(y * y for y in x) < 2**56:
            used.append((i, (c + 1) % 10 if i is not None and i % moved == 0 else c, x))
    out = Counter()
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    for p, (i, c, x) in enumerate(used):
        if i is None or i % every:
            continue
        others = [(sum(a * b for a, b in zip(x, y)), j, d) for q, (j, d, y) in enumerate(used) if q != p and len(x) == len(y)]
        for s, j, _ in sorted((o for o in others if o[2] == c), key=order)[:5]:
            fits = sorted((o for o in others if o[2] != c and 50 * s <= 100 * o[0] <= 95 * s), key=order)[:3]
            out.update((i, j, r + 1, o[1], s, o[0]) for r, o in enumerate(fits))
    return out


def mined(spark, land, rows, **how):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "vec_id long, embedding array<float>, label int, id string, anchor string")
    return Counter(map(tuple, hn.mine(df, land, **how).collect()))


@pytest.mark.parametrize("block,tile", [(4096, 1024), (40, 16)])
def test_against_brute_force(spark, land, monkeypatch, block, tile):
    for name in ("ANCHOR_BLOCK", "CANDIDATE_BLOCK"):
        monkeypatch.setattr(hn, name, block // 4 if name[0] == "A" else block)
    monkeypatch.setattr(hn, "TILE", tile)
    rng = np.random.default_rng(6)
    near = rng.standard_normal((6, 9))
    vector = lambda: [float(x) for x in np.round(near[rng.integers(6)] + 0.4 * rng.standard_normal(9), 2)]
    rows = [(i, vector(), int(rng.integers(0, 10))) for i in range(240)]
    rows += [(300, None, 1), (301, [1.0] * 9, None), (302, [1.0, None] + [0.0] * 7, 1), (350, [float("nan")] + [1.0] * 8, 1), (400, [float("inf")] + [1.0] * 8, 1),
             (450, [0.0] * 9, 2), (500, [1e9] + [0.0] * 8, 3), (550, [], 1), (551, [], 1), (552, [], 2), (600, [1.0, 2.0], 4), (601, [1.0, 1.5], 4), (602, [1.0, 1.0], 5), (None, rows[50][1], rows[50][2]), (None, rows[3][1], 4)]
    rows += [rows[100]] * 9 + [rows[5]] * 8 + [(1000 + i, rows[100][1], i % 3) for i in range(30)]
    got = mined(spark, land, rows, every=10)
    assert got == brute(rows, every=10) and sum(got.values()) > 200


def test_without_rows(spark, land):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hn.mine(none, land).count() == 0
    assert mined(spark, land, [(1, [1.0], 1), (2, [1.0], 2)]) == Counter()
    assert mined(spark, land, [(50, [1.0], 1)]) == Counter()
