"""SQL text of the raster chain: pairs -> difference -> blur -> scale -> Otsu -> mask -> components."""

from __future__ import annotations

from checks.views import PX_SQL, SCENE_SQL

_B3 = ("b1", "b2", "b3")
PAIRS = (
    "pairs AS (SELECT scene_id, row, col, "
    + ", ".join(f"a.b{i} AS b{i}_t1, b.b{i} AS b{i}_t2" for i in (1, 2, 3, 4))
    + " FROM px1 a JOIN px2 b USING (scene_id, row, col))"
)
_ABS = " + ".join(f"abs({b}_t2::DOUBLE - {b}_t1)" for b in _B3)
DIFF = f"diff AS (SELECT scene_id, row, col, ({_ABS}) / 3 AS diff FROM pairs)"

_WEIGHTS = (0.0625, 0.25, 0.375, 0.25, 0.0625)


def _blur_axis(src: str, out: str, axis: str, size: str) -> str:
    across = "row" if axis == "col" else "col"
    cols = "scene_id, row, col, n_rows, n_cols"
    shifts = ", ".join(
        f"{'lag' if d < 0 else 'lead'}(diff, {abs(d)}) OVER w AS v{d + 2}" if d else "diff AS v2" for d in range(-2, 3)
    )
    terms = []
    for d in range(-2, 3):
        expr = f"v{d + 2}"
        for i in range(abs(d)):
            src_d = -2 * i - d if d < 0 else 2 * i - d
            edge = f"{axis} = {i}" if d < 0 else f"{size} - 1 - {axis} = {i}"
            expr = f"CASE WHEN {edge} THEN v{src_d + 2} ELSE {expr} END"
        terms.append(f"{_WEIGHTS[d + 2]}::DOUBLE * ({expr})")
    return (
        f"{out}_n AS (SELECT {cols}, {shifts} FROM {src} WINDOW w AS (PARTITION BY scene_id, {across} ORDER BY {axis})), "
        f"{out} AS (SELECT {cols}, {' + '.join(terms)} AS diff FROM {out}_n)"
    )


BLUR = (
    "sized AS (SELECT d.*, n_rows, n_cols FROM diff d JOIN scene USING (scene_id)), "
    + _blur_axis("sized", "bl1", "col", "n_cols") + ", " + _blur_axis("bl1", "blur", "row", "n_rows")
)
NORM = (
    "ends AS (SELECT scene_id, min(diff) AS lo, max(diff) AS hi FROM blur GROUP BY 1), "
    "nrm AS (SELECT scene_id, row, col, CASE WHEN hi - lo > 0 THEN (diff - lo) / (hi - lo) ELSE 0.0 END AS norm "
    "FROM blur JOIN ends USING (scene_id)), "
    "binned AS (SELECT *, CAST(floor(least(greatest(norm * 255.0::DOUBLE, 0), 255)) AS INT) AS bin FROM nrm)"
)
OTSU = (
    "hist AS (SELECT scene_id, bin, count(*) AS n FROM binned GROUP BY 1, 2), "
    "cum AS (SELECT scene_id, bin, CAST(sum(n) OVER w AS DOUBLE) AS w0, CAST(sum(n * bin) OVER w AS DOUBLE) AS s0, "
    "CAST(sum(n) OVER (PARTITION BY scene_id) AS DOUBLE) AS wt, "
    "CAST(sum(n * bin) OVER (PARTITION BY scene_id) AS DOUBLE) AS st "
    "FROM hist WINDOW w AS (PARTITION BY scene_id ORDER BY bin)), "
    "spread AS (SELECT scene_id, bin, round(CASE WHEN wt - w0 > 0 THEN w0 * (wt - w0) / (wt * wt) * "
    "(s0 / w0 - (st - s0) / (wt - w0)) * (s0 / w0 - (st - s0) / (wt - w0)) ELSE 0 END, 9) AS v FROM cum), "
    "otsu AS (SELECT scene_id, bin AS otsu_bin FROM "
    "(SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY v DESC, bin) AS k FROM spread) WHERE k = 1)"
)
SCORE = (
    "score AS (SELECT scene_id, row, col, CASE WHEN bin > otsu_bin THEN greatest(norm, otsu_bin / 255.0::DOUBLE) "
    "ELSE least(norm, otsu_bin / 255.0::DOUBLE * 0.5) END AS prob FROM binned JOIN otsu USING (scene_id))"
)


def opening_sql(src: str, out: str, flag: str) -> str:
    """3x3 opening by counting: a pixel erodes away unless every neighbour inside the raster is set."""
    step = "(SELECT unnest([-1, 0, 1]) AS dr)"
    cross = f"{step} x, (SELECT unnest([-1, 0, 1]) AS dc) y"
    return (
        f"{out}_e AS (SELECT s.scene_id, s.row + dr AS row, s.col + dc AS col, min({flag}) AS f "
        f"FROM {src} s, {cross} GROUP BY 1, 2, 3), "
        f"{out}_k AS (SELECT s.scene_id, s.row, s.col, e.f FROM {src} s JOIN {out}_e e USING (scene_id, row, col)), "
        f"{out}_d AS (SELECT scene_id, row + dr AS row, col + dc AS col, max(f) AS f FROM {out}_k, {cross} GROUP BY 1, 2, 3), "
        f"{out} AS (SELECT s.scene_id, s.row, s.col, d.f AS open_flag FROM {src} s JOIN {out}_d d USING (scene_id, row, col))"
    )


TAU = 0.70
MASK = (
    f"flagged AS (SELECT scene_id, row, col, prob, CAST(prob >= {TAU}::DOUBLE AS INT) AS flag FROM score), "
    + opening_sql("flagged", "opened", "flag")
    + ", mask AS MATERIALIZED (SELECT s.scene_id, s.row, s.col, s.prob FROM flagged s "
    "JOIN opened o USING (scene_id, row, col) WHERE o.open_flag = 1)"
)


def components_sql(src: str, out: str) -> str:
    return (
        f"{out}_nb AS MATERIALIZED (SELECT a.scene_id, a.row, a.col, b.row AS r2, b.col AS c2 FROM {src} a "
        f"JOIN {src} b ON a.scene_id = b.scene_id AND b.row BETWEEN a.row - 1 AND a.row + 1 "
        f"AND b.col BETWEEN a.col - 1 AND a.col + 1), "
        f"{out}_reach AS (SELECT scene_id, row, col, row::BIGINT * 4294967296 + col AS label FROM {src} "
        f"UNION SELECT n.scene_id, n.r2, n.c2, r.label FROM {out}_reach r "
        f"JOIN {out}_nb n ON n.scene_id = r.scene_id AND n.row = r.row AND n.col = r.col), "
        f"{out} AS (SELECT scene_id, row, col, min(label) AS label FROM {out}_reach GROUP BY 1, 2, 3)"
    )


TO_DIFF = (PX_SQL, SCENE_SQL, PAIRS, DIFF)
TO_SCORE = (*TO_DIFF, BLUR, NORM, OTSU, SCORE)
TO_MASK = (*TO_SCORE, MASK)
TO_COMPONENTS = (*TO_MASK, components_sql("mask", "comp"))
