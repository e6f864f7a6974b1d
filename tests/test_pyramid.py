"""Coarse-to-fine alignment: planted shifts far beyond the window, pairs that cannot be aligned, scenes of different size."""

import numpy as np
import pytest
from helpers import pixel_frame

from terradrift.operators.align import best_shift, pyramid_shift, shift_scores


def texture(rng, n):
    """Random image with structure at every scale."""
    out = np.zeros((n, n))
    for size in (2, 4, 8, 16, 32):
        cells = rng.normal(size=(n // size + 2, n // size + 2))
        out += np.kron(cells, np.ones((size, size)))[:n, :n] * size**0.5
    return out + rng.normal(size=(n, n)) * 0.3


def shifted(image, dy, dx, n):
    return image[60 : 60 + n, 60 : 60 + n], image[60 - dy : 60 - dy + n, 60 - dx : 60 - dx + n]


def frame(spark, pairs):
    out = None
    for name, (a, b) in pairs.items():
        part = pixel_frame(spark, {"l1": a, "l2": b}, name)
        out = part if out is None else out.unionByName(part)
    return out


@pytest.fixture(scope="module")
def found(spark):
    rng = np.random.default_rng(2)
    image = texture(rng, 320)
    pairs = {"far": shifted(image, 37, -21, 200), "near": shifted(image, -1, 2, 96), "none": (texture(rng, 96), texture(rng, 96)),
             "flat": (np.ones((40, 40)), texture(rng, 40)), "small": shifted(image, 1, 1, 12)}
    holes = image[60:256, 60:256].copy(), image[80:276, 50:246].copy()
    holes[0][rng.random((196, 196)) < 0.05] = np.nan
    px = frame(spark, pairs | {"holes": holes})
    from pyspark.sql import functions as F

    px = px.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("l1", "l2")})
    return {r["scene_id"]: r for r in pyramid_shift(px, 48).collect()}, px


def test_planted_shifts_are_found(found):
    got, _ = found
    # l1[r, c] is l2[r + dy, c + dx].
    assert (got["far"]["dy"], got["far"]["dx"], got["far"]["status"]) == (37, -21, "OK") and got["far"]["score"] > 0.99
    assert (got["near"]["dy"], got["near"]["dx"], got["near"]["status"]) == (-1, 2, "OK")
    assert (got["small"]["dy"], got["small"]["dx"], got["small"]["status"]) == (1, 1, "OK")
    assert (got["holes"]["dy"], got["holes"]["dx"], got["holes"]["status"]) == (-20, 10, "OK")
    assert abs(got["far"]["dy_fine"] - 37) < 0.5 and abs(got["far"]["dx_fine"] + 21) < 0.5


def test_other_pairs_are_rejected(found):
    got, _ = found
    assert got["none"]["status"] == got["flat"]["status"] == "REJECTED_ALIGNMENT" and got["flat"]["score"] == 0
    assert len(got) == 6


def test_small_shifts_equal_the_direct_search(found):
    _, px = found
    near = px.filter("scene_id IN ('near', 'small')")
    keys = ["scene_id", "dy", "dx", "status"]
    want = {tuple(r[k] for k in keys): r["score"] for r in best_shift(shift_scores(near)).collect()}
    got = {tuple(r[k] for k in keys): r["score"] for r in pyramid_shift(near, 2).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
