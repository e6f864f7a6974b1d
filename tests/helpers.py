"""Small rasters and brute-force counterparts for checks."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd


def pixel_frame(spark, arrays: dict[str, np.ndarray], scene_id: str = "a"):
    """Pixel table of equally shaped 2-D arrays."""
    first = next(iter(arrays.values()))
    r, c = np.indices(first.shape)
    data = {"scene_id": scene_id, "row": r.ravel().astype("int32"), "col": c.ravel().astype("int32")}
    data.update({k: v.ravel() for k, v in arrays.items()})
    return spark.createDataFrame(pd.DataFrame(data))


def grid_of(rows, value: str, shape, fill=0.0) -> np.ndarray:
    out = np.full(shape, fill, dtype=float)
    for x in rows:
        out[x["row"], x["col"]] = x[value]
    return out


def scene_frame(spark, n_rows, n_cols, a=1e-4, lon=75.0, lat=25.0, scene_id="a", e=None):
    e = -a if e is None else e
    return spark.sql(
        f"SELECT '{scene_id}' AS scene_id, {n_rows} AS n_rows, {n_cols} AS n_cols, named_struct('a', {a!r}D, 'b', 0D, "
        f"'c', {lon!r}D, 'd', 0D, 'e', {e!r}D, 'f', {lat!r}D) AS affine, true AS is_geographic"
    )


def flood_labels(mask: np.ndarray) -> np.ndarray:
    """Smallest row-major position per 8-connected component; -1 outside the mask."""
    out = np.full(mask.shape, -1, dtype=np.int64)
    for i, j in zip(*np.nonzero(mask)):
        if out[i, j] >= 0:
            continue
        name, queue = (int(i) << 32) + int(j), deque([(i, j)])
        out[i, j] = name
        while queue:
            a, b = queue.popleft()
            for x in range(max(a - 1, 0), min(a + 2, mask.shape[0])):
                for y in range(max(b - 1, 0), min(b + 2, mask.shape[1])):
                    if mask[x, y] and out[x, y] < 0:
                        out[x, y] = name
                        queue.append((x, y))
    return out


def erode_dilate(mask: np.ndarray, k: int = 3) -> np.ndarray:
    """Opening by direct neighbourhood minimum and maximum, border pixels ignored."""
    r = k // 2

    def scan(m, pick):
        out = np.empty_like(m)
        for i in range(m.shape[0]):
            for j in range(m.shape[1]):
                out[i, j] = pick(m[max(i - r, 0) : i + r + 1, max(j - r, 0) : j + r + 1])
        return out

    return scan(scan(mask, np.min), np.max)


def haversine(lat1, lon1, lat2, lon2):
    lat1, lon1, lat2, lon2 = map(np.radians, (lat1, lon1, lat2, lon2))
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6371000.0 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))
