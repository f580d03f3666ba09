"""Tracing masks to curves: polygons of fewest sides, rounded at their corners.

After P. Selinger, "Potrace: a polygon-based tracing algorithm" (2003). Kernels
are numpy functions of one region; the DataFrame operators run them on every
region's rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from inkframe.operators.boxes import BOX, pixels_in_boxes
from inkframe.operators.kernels import lanczos, outline_loops, rasterise, subpaths
from inkframe.operators.raster import IMG
from inkframe.operators.select import best_trial

#: The thresholds that a region is tuned over.
THRESHOLDS = (112, 128, 139, 148, 160, 172, 184)


def signed_area(loop: np.ndarray) -> float:
    x, y = loop[:, 0], loop[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2


def straight_reach(loop: np.ndarray) -> np.ndarray:
    """How many steps on from each vertex a straight side may end: the line to
    its end passes within half a pixel of all vertices between, that is through
    the unit squares around them, and not all four directions occur. A side ends
    three steps before the loop closes at the latest."""
    n = len(loop)
    walk = np.concatenate([loop, loop, loop[:1]]).astype(int).tolist()
    out = np.ones(n, int)
    for i in range(n):
        ox, oy = walk[i]
        low = high = None
        seen = set()
        for k in range(1, max(2, n - 2)):
            ax, ay = walk[i + k - 1]
            bx, by = walk[i + k]
            seen.add((bx - ax, by - ay))
            if len(seen) == 4:
                break
            px, py = bx - ox, by - oy
            if low is not None and (low[0] * py - low[1] * px < 0 or px * high[1] - py * high[0] < 0):
                break
            out[i] = k
            # The square's outermost corners, seen from the start, narrow the cone.
            if px and py:
                right = (px + (0.5 if py > 0 else -0.5), py + (-0.5 if px > 0 else 0.5))
                left = (px - (0.5 if py > 0 else -0.5), py - (-0.5 if px > 0 else 0.5))
            else:  # straight ahead: the near corners are the outermost
                right = (px - 0.5 * np.sign(px), -0.5 * np.sign(px)) if py == 0 else (0.5 * np.sign(py), py - 0.5 * np.sign(py))
                left = (right[0], -right[1]) if py == 0 else (-right[0], right[1])
            if low is None:
                low, high = right, left
            else:
                if low[0] * right[1] - low[1] * right[0] > 0:
                    low = right
                if left[0] * high[1] - left[1] * high[0] > 0:
                    high = left
    return out


def _moments(loop: np.ndarray) -> np.ndarray:
    """Prefix sums of 1, x, y, xx, xy, yy over two rounds of the loop."""
    x, y = np.concatenate([loop, loop, loop[:1]]).astype(float).T
    return np.concatenate([np.zeros((1, 6)), np.cumsum(np.stack([np.ones_like(x), x, y, x * x, x * y, y * y], axis=1), axis=0)])


def best_polygon(loop: np.ndarray) -> list[int]:
    """Vertices of the polygon of fewest straight sides through the first vertex;
    of those the least sum of each side's length times the root mean square
    distance of the vertices that it stands for."""
    n, reach, total = len(loop), straight_reach(loop), _moments(loop)
    walk = np.concatenate([loop, loop[:1]]).astype(float)
    sides, cost, came = np.full(n + 1, n + 1), np.full(n + 1, np.inf), np.zeros(n + 1, int)
    sides[0], cost[0] = 0, 0.0
    for i in range(n):
        j = np.arange(i + 1, min(n, i + reach[i]) + 1)
        s = total[j + 1] - total[i]
        c, sx, sy, sxx, sxy, syy = s.T
        p, d = walk[i], walk[j] - walk[i]
        ux, uy = -d[:, 1], d[:, 0]  # across the side
        off = ux * ux * (sxx - 2 * p[0] * sx + c * p[0] ** 2) + uy * uy * (syy - 2 * p[1] * sy + c * p[1] ** 2)
        off += 2 * ux * uy * (sxy - p[0] * sy - p[1] * sx + c * p[0] * p[1])
        price = cost[i] + np.sqrt(np.maximum(0, off) / c)
        better = (sides[i] + 1 < sides[j]) | ((sides[i] + 1 == sides[j]) & (price < cost[j]))
        at = j[better]
        sides[at], cost[at], came[at] = sides[i] + 1, price[better], i
    out, k = [], n
    while k:
        k = int(came[k])
        out.append(k)
    return out[::-1]


def fitted_vertices(loop: np.ndarray, polygon: list[int]) -> np.ndarray:
    """Each vertex moved to where the lines through its two sides' vertices are
    nearest, within the unit square around it."""
    n, total, out = len(loop), _moments(loop), []
    lines = []
    for a, b in zip(polygon, polygon[1:] + [polygon[0] + n], strict=True):
        c, sx, sy, sxx, sxy, syy = total[b + 1] - total[a]
        mx, my = sx / c, sy / c
        cov = np.array([[sxx / c - mx * mx, sxy / c - mx * my], [sxy / c - mx * my, syy / c - my * my]])
        across = np.linalg.eigh(cov)[1][:, 0]
        lines.append((across, float(across @ (mx, my))))
    for k, v in enumerate(polygon):
        at = loop[v].astype(float)
        (n0, c0), (n1, c1) = lines[k - 1], lines[k]
        form = np.outer(n0, n0) + np.outer(n1, n1)
        if abs(np.linalg.det(form)) > 1e-9:
            at = np.clip(np.linalg.solve(form, n0 * c0 + n1 * c1), at - 0.5, at + 0.5)
        out.append(at)
    return np.array(out)


def rounded(points: np.ndarray, alpha_max: float) -> list[tuple[str, list[tuple[float, float]]]]:
    """Path commands from one side's middle to the next one's: a cubic where the
    corner is round enough, else the corner itself and the middle."""
    n = len(points)
    out = []
    for k in range(n):
        a, b, c = points[k - 1], points[k], points[(k + 1) % n]
        m0, m1 = (a + b) / 2, (b + c) / 2
        if not k:
            out.append(("M", [tuple(m0)]))
        reach = np.abs(c - a).sum()  # the unit square's extent across the line from a to c
        away = abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) / reach if reach else np.inf
        alpha = max(0.0, 1 - 1 / away) / 0.75 if away > 0 else 0.0
        if alpha >= alpha_max:
            out.append(("L", [tuple(b)]))
            out.append(("L", [tuple(m1)]))
        else:
            alpha = min(1.0, max(0.55, alpha))
            out.append(("C", [tuple(m0 + alpha * (b - m0)), tuple(m1 + alpha * (b - m1)), tuple(m1)]))
    return out


def curves(mask: np.ndarray, turd: float = 2, alpha_max: float = 1.0, scale: float = 1.0) -> str:
    """A path of M, L, C and Z for the even-odd rule; boundaries of ``turd``
    pixels and fewer are left out, coordinates are divided by ``scale``."""
    out = []
    for loop in outline_loops(mask):
        loop = np.array(loop)
        if abs(signed_area(loop)) <= turd:
            continue
        corners = best_polygon(loop)
        points = fitted_vertices(loop, corners) if len(corners) > 2 else loop[corners].astype(float)
        if len(points) < 3:
            points = loop.astype(float)
        steps = [op + " " + " ".join(f"{x / scale:.4f} {y / scale:.4f}" for x, y in pts) for op, pts in rounded(points, alpha_max)]
        out.append(" ".join(steps) + " Z")
    return " ".join(out)


def trace_curves(ink: DataFrame, turd: float = 2, alpha_max: float = 1.0) -> DataFrame:
    """(image_id, width, height, path, n_curves): each image's ink as curves."""
    from inkframe.operators.kernels import _mask

    def run(pdf):
        import pandas as pd

        m = _mask(pdf)
        path = curves(m, turd, alpha_max)
        return pd.DataFrame([(int(pdf[IMG].iloc[0]), m.shape[1], m.shape[0], path, path.count("C"))], columns=[IMG, "width", "height", "path", "n_curves"])

    return ink.select(IMG, "y", "x", "ink").groupBy(IMG).applyInPandas(run, f"{IMG} long, width int, height int, path string, n_curves int")


TRIAL = "threshold int, path string, n_paths int, n_curves int, has_curve boolean, iou double, recall double, precision double, soft double, ink_ratio double"


def trial(gray: np.ndarray, threshold: int, upscale: int = 4, turd: float = 2, alpha_max: float = 1.0, invert: bool = False, level: float | None = None, ss: int = 8) -> tuple:
    """One trace of one region, and how well its fill covers the region again
    (percent): hard masks by IoU, recall and precision, coverages by soft IoU and
    the ratio of their sums. Of inverted regions the ground's complement is
    compared."""
    big = lanczos(gray, gray.shape[1] * upscale, gray.shape[0] * upscale)
    mask = big > threshold if invert else big < threshold
    if invert:
        from inkframe.operators.kernels import drop_edge_components

        mask = drop_edge_components(mask)
    path = curves(mask, max(1, round(turd * upscale * upscale)), alpha_max, upscale)
    parts = subpaths(path)
    cov = rasterise(parts, gray.shape[1], gray.shape[0], ss).astype(float)
    hard = gray > threshold if invert else gray < threshold
    if level is None:
        dark = gray[gray < 250]
        level = float(np.percentile(dark, 1)) if len(dark) else 0.0
    want = np.zeros(gray.shape) if level >= 254 else np.clip((255 - gray.astype(float)) / (255 - level), 0, 1)
    if invert:
        want = 1 - want
    got = cov >= 0.5
    pct = lambda a, b: 100.0 * a / b if b else 100.0
    both, either = (hard & got).sum(), (hard | got).sum()
    soft = pct(np.minimum(want, cov).sum(), np.maximum(want, cov).sum())
    ratio = float(cov.sum() / want.sum()) if want.sum() else 1.0
    n_curves = path.count("C")
    return (threshold, path, len(parts), n_curves, n_curves > 0, pct(both, either), pct(both, hard.sum()), pct(both, got.sum()), soft, ratio)


def trials(px: DataFrame, regions: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS, **settings) -> DataFrame:
    """Every region traced at every threshold: regions(image_id, region, x0, y0,
    x1, y1, invert). A task holds one region's pixels at a time."""

    def run(pdf):
        import pandas as pd

        r = pdf.iloc[0]
        gray = np.full((int(r.y1 - r.y0), int(r.x1 - r.x0)), 255, np.uint8)
        gray[pdf.y.to_numpy() - int(r.y0), pdf.x.to_numpy() - int(r.x0)] = pdf.gray.to_numpy()
        rows = [(int(r[IMG]), str(r.region), k, *trial(gray, t, invert=bool(r.invert), **settings)) for k, t in enumerate(thresholds)]
        return pd.DataFrame(rows, columns=[IMG, "region", "seq", *[c.split()[0] for c in TRIAL.split(", ")]])

    met = pixels_in_boxes(px.select(IMG, "y", "x", "gray"), regions.select(IMG, "region", "invert", *BOX))
    return met.groupBy(IMG, "region").applyInPandas(run, f"{IMG} long, region string, seq int, {TRIAL}")


def trace_all(px: DataFrame, regions: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS, **settings) -> DataFrame:
    """The best trial of every region."""
    return best_trial(trials(px, regions, thresholds, **settings), [IMG, "region"])
