"""Sheets in photographs: edges, the quadrilateral of a page, its upright picture and its enhancement.

Images are rows of red, green and blue arrays (row by row); an Arrow batch of them is worked on with numpy, image by image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.pixels import _blur

# Weights of the colours in gray (of 256), shares and levels by which a sheet is told from its background.
GRAY = (77, 150, 29)
LEAST_BLOB, MOST_BORDER, PAPER_LEVEL, PAPER_SHARES, EDGE_SHARE = 0.06, 900, 78, (0.08, 0.93), 0.22
RGB = "image_id long, width int, red array<double>, green array<double>, blue array<double>"


def gray(red: Column, green: Column, blue: Column) -> Column:
    """Gray levels, whole numbers from 0 to 255."""
    both = F.zip_with(red, green, lambda r, g: r * GRAY[0] + g * GRAY[1])
    return F.zip_with(both, blue, lambda v, b: F.floor((v + b * GRAY[2]) / 256).cast("int"))


def _gray(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (r * GRAY[0] + g * GRAY[1] + b * GRAY[2]) // 256


def sobel(image: np.ndarray) -> np.ndarray:
    """Gradient magnitude; 0 on the border. Squares of whole gradients are exact, so one root of their sum keeps ties at half the
    greatest, which hypot's last place doesn't."""
    out = np.zeros(image.shape)
    if min(image.shape) >= 3:
        p = image.astype(float)
        across = p[:, 2:] - p[:, :-2]
        down = p[:-2] - p[2:]
        gx = across[:-2] + 2 * across[1:-1] + across[2:]
        gy = down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]
        out[1:-1, 1:-1] = np.sqrt(gx * gx + gy * gy)
    return out


def dilated(mask: np.ndarray) -> np.ndarray:
    """The mask and its neighbours to the four sides; the border stays as it is."""
    out = mask.copy()
    if min(mask.shape) >= 3:
        out[1:-1, 1:-1] |= mask[1:-1, :-2] | mask[1:-1, 2:] | mask[:-2, 1:-1] | mask[2:, 1:-1]
    return out


def largest_blob(mask: np.ndarray) -> np.ndarray | None:
    """The largest 4-connected part, the first on a tie; null if it is under LEAST_BLOB of the image. Labels spread to
    neighbours and then along themselves until nothing changes."""
    n = mask.size
    label = np.where(mask, np.arange(n).reshape(mask.shape), n)
    while True:
        near = label.copy()
        near[:, 1:] = np.minimum(near[:, 1:], label[:, :-1])
        near[:, :-1] = np.minimum(near[:, :-1], label[:, 1:])
        near[1:] = np.minimum(near[1:], label[:-1])
        near[:-1] = np.minimum(near[:-1], label[1:])
        near = np.where(mask, near, n)
        near = np.append(near.ravel(), n)[near]
        if (near == label).all():
            break
        label = near
    counts = np.bincount(label[mask], minlength=1) if mask.any() else np.zeros(1, int)
    best = int(np.argmax(counts))
    return label == best if counts[best] and counts[best] >= n * LEAST_BLOB else None


def border_points(mask: np.ndarray) -> np.ndarray:
    """x, y of the mask's cells at its rim, row by row; every so many of them if they are more than MOST_BORDER."""
    padded = np.pad(mask, 1)
    inner = padded[1:-1, :-2] & padded[1:-1, 2:] & padded[:-2, 1:-1] & padded[2:, 1:-1]
    y, x = np.nonzero(mask & ~inner)
    points = np.column_stack((x, y)).astype(float)
    return points[:: -(-len(points) // MOST_BORDER)] if len(points) > MOST_BORDER else points


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull's corners, from the leftmost on; points on its sides fall out."""
    p = points[np.lexsort((points[:, 1], points[:, 0]))]
    if len(p) <= 2:
        return p

    def half(order) -> list:
        kept: list = []
        for q in order:
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (q[1] - kept[-2][1]) - (kept[-1][1] - kept[-2][1]) * (q[0] - kept[-2][0]) <= 0:
                kept.pop()
            kept.append(q)
        return kept[:-1]

    return np.array(half(p) + half(p[::-1]))


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """A line with fewer points: between two that stay, the farthest stays too if it is farther off than the tolerance."""
    stay = np.zeros(len(points), bool)
    stay[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = points[b] - points[a]
        length = np.hypot(*d)
        off = points[a + 1 : b] - points[a]
        far = np.hypot(off[:, 0], off[:, 1]) if length == 0 else np.abs(d[1] * off[:, 0] - d[0] * off[:, 1]) / length
        k = int(np.argmax(far))
        if far[k] > tolerance:
            stay[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[stay]


def ordered(quad: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left."""
    total, apart = quad.sum(axis=1), quad[:, 0] - quad[:, 1]
    return quad[[np.argmin(total), np.argmax(apart), np.argmax(total), np.argmin(apart)]]


def least_rectangle(corners: np.ndarray) -> np.ndarray:
    """The rectangle of least area around a hull: one of its sides lies along a side of the hull."""
    if len(corners) < 3:
        low, high = corners.min(axis=0), corners.max(axis=0)
        return ordered(np.array([low, (high[0], low[1]), high, (low[0], high[1])]))
    side = np.roll(corners, -1, axis=0) - corners
    u = side / np.where((n := np.hypot(side[:, 0], side[:, 1])) == 0, 1, n)[:, None]
    v = np.column_stack((-u[:, 1], u[:, 0]))
    along = ((corners[None, :, :] - corners[:, None, :]) * u[:, None, :]).sum(axis=2)
    away = ((corners[None, :, :] - corners[:, None, :]) * v[:, None, :]).sum(axis=2)
    k = int(np.argmin(np.ptp(along, axis=1) * np.ptp(away, axis=1)))
    at = lambda a, b: corners[k] + u[k] * a + v[k] * b
    a0, a1, b0, b1 = along[k].min(), along[k].max(), away[k].min(), away[k].max()
    return ordered(np.array([at(a0, b0), at(a1, b0), at(a1, b1), at(a0, b1)]))


def four_corners(corners: np.ndarray) -> np.ndarray:
    """A hull brought down to four corners by bisecting the tolerance; the least rectangle where that gives none."""
    if len(corners) < 3:
        return least_rectangle(corners)
    closed, low, high, four = np.vstack((corners, corners[:1])), 0.5, 80.0, None
    for _ in range(18):
        middle = (low + high) / 2
        kept = simplified(closed, middle)[:-1]
        if len(kept) > 4:
            low = middle
        else:
            four, high = kept if len(kept) == 4 else four, middle
    return ordered(four) if four is not None else least_rectangle(corners)


def clamped(quad: np.ndarray, width: int, height: int) -> np.ndarray:
    return np.clip(quad, 0, [max(0, width - 1), max(0, height - 1)])


def quad_of(mask: np.ndarray | None) -> np.ndarray | None:
    """A mask's four corners; null under eight rim cells."""
    if mask is None or len(points := border_points(mask)) < 8:
        return None
    corners = hull(points)
    return clamped(four_corners(corners), mask.shape[1], mask.shape[0]) if len(corners) >= 3 else None


def _rectangularity(q: np.ndarray) -> float:
    side = np.roll(q, -1, axis=0) - q
    length = np.hypot(side[:, 0], side[:, 1])
    alike = [1 - abs(length[k] - length[k + 2]) / max(length[k], length[k + 2], 1) for k in (0, 1)]
    unit = side / np.where(length == 0, 1, length)[:, None]
    square = 1 - np.abs((unit * np.roll(unit, 1, axis=0)).sum(axis=1))
    return float(np.clip((sum(alike) + square.mean()) / 3, 0, 1))


def mean_edge(quad: np.ndarray, edges: np.ndarray) -> float:
    """The mean gradient along the four sides, a sample for each pixel and eight at least."""
    seen = []
    for a, b in zip(quad, np.roll(quad, -1, axis=0)):
        steps = max(8, int(np.floor(np.hypot(*(b - a)) + 0.5)))
        at = np.floor(a + (b - a) * np.arange(steps + 1)[:, None] / steps + 0.5).astype(int)
        inside = (at >= 0).all(axis=1) & (at[:, 0] < edges.shape[1]) & (at[:, 1] < edges.shape[0])
        seen.append(edges[at[inside, 1], at[inside, 0]])
    seen = np.concatenate(seen)
    return float(seen.mean()) if len(seen) else 0.0


def quad_score(quad: np.ndarray, edges: np.ndarray) -> float:
    """Large, upright and along edges; 0 if it is too small, as large as the image, or skewed."""
    x, y = quad[:, 0], quad[:, 1]
    area = abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2 / edges.size
    upright = _rectangularity(quad)
    if not 0.1 <= area <= 0.98 or upright < 0.45:
        return 0.0
    return area * (0.55 + 0.45 * upright) * (0.25 + min(mean_edge(quad, edges), 180) / 180)


def _otsu(image: np.ndarray) -> int:
    n = np.bincount(image.ravel().astype(int), minlength=256).astype(float)
    w, s = np.cumsum(n), np.cumsum(n * np.arange(256))
    rest = w[-1] - w
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((w > 0) & (rest > 0), w * rest * (s / w - (s[-1] - s) / rest) ** 2, 0)
    return int(np.argmax(between))


def detect(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """The corners of the sheet in an image and how sure they are: the best of bright paper's blob, of the edges' blob, and
    of the image's own corners moved inwards."""
    level = np.floor(_blur(_gray(r, g, b), 1))
    edges = sobel(level)
    paper = level >= min(_otsu(level) - 4, PAPER_LEVEL)
    height, width = level.shape
    found = [quad_of(largest_blob(dilated(dilated(paper)))) if PAPER_SHARES[0] < paper.mean() < PAPER_SHARES[1] else None]
    found.append(quad_of(largest_blob(dilated(dilated(edges >= max(edges.max(), 1) * EDGE_SHARE)))))
    mx, my = width * 0.07, height * 0.07
    found.append(np.array([(mx, my), (width - mx, my), (width - mx, height - my), (mx, height - my)]))
    scores = [(quad_score(ordered(q), edges), -k, ordered(q)) for k, q in enumerate(found) if q is not None]
    best = max(scores, key=lambda x: x[:2])
    return clamped(best[2], width, height), float(np.clip(best[0], 0, 1))


def _stored(v: np.ndarray) -> np.ndarray:
    """Levels as an image keeps them: whole, halves to even, 0 to 255."""
    return np.clip(np.rint(v), 0, 255)


def unsharp(image: np.ndarray, amount: float) -> np.ndarray:
    blurred = np.stack([_stored(_blur(c, 1)) for c in image])
    return _stored(image + amount * (image - blurred))


def leveled(image: np.ndarray, clip: float) -> np.ndarray:
    """Each colour stretched between the levels at which a share `clip` of the pixels is reached from either end."""
    out = []
    for c in image:
        n, cut = np.bincount(c.ravel().astype(int), minlength=256), c.size * clip
        low, high = int(np.argmax(np.cumsum(n) >= cut)), 255 - int(np.argmax(np.cumsum(n[::-1]) >= cut))
        out.append(_stored((c - low) * 255 / (max(high, low + 1) - low)))
    return np.stack(out)


def contrasted(image: np.ndarray, gain: float, bias: float) -> np.ndarray:
    level = _stored((_gray(*image) - 128) * gain + 128 + bias)
    return np.stack([level] * 3)


def whiteboard(image: np.ndarray) -> np.ndarray:
    """Bright pixels to white, ink deeper, edges sharper."""
    level = _gray(*image)
    ink = _stored((image - 18) * np.where(level < 90, 0.55, 0.78) + 8)
    return unsharp(np.where(level > 168, 255.0, ink), 0.7)


def adaptive(image: np.ndarray) -> np.ndarray:
    """Black where a pixel is over 8 levels darker than the mean around it, else white."""
    level = _gray(*image)
    radius = max(8, int(np.floor(min(level.shape) / 28 + 0.5)))
    mean = _blur_square(level, radius)
    return np.stack([np.where(level < mean - 8, 0.0, 255.0)] * 3)


def _blur_square(image: np.ndarray, radius: int) -> np.ndarray:
    """The mean over the square around each pixel, cut at the borders: sums of a table, counted once."""
    table = np.pad(image.astype(float), ((1, 0), (1, 0))).cumsum(axis=0).cumsum(axis=1)
    y0, y1 = (np.clip(np.arange(image.shape[0]) + d, 0, image.shape[0]) for d in (-radius, radius + 1))
    x0, x1 = (np.clip(np.arange(image.shape[1]) + d, 0, image.shape[1]) for d in (-radius, radius + 1))
    total = table[np.ix_(y1, x1)] - table[np.ix_(y0, x1)] - table[np.ix_(y1, x0)] + table[np.ix_(y0, x0)]
    return total / ((y1 - y0)[:, None] * (x1 - x0)[None, :])


PRESETS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "color": lambda i: unsharp(leveled(i, 0.008), 0.55), "whiteboard": lambda i: whiteboard(leveled(i, 0.004)), "receipt": lambda i: unsharp(contrasted(i, 1.45, 8), 0.85), "bw": adaptive,
}


def warped(image: np.ndarray, quad: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """The sheet within a quadrilateral, upright: each pixel of the result is read between four of the image; black
    outside."""
    width, height = size
    corners = np.array([(0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)], float)
    zero, one = np.zeros((4, 3)), np.column_stack((corners, np.ones(4)))
    a = np.concatenate([np.column_stack((one, zero, -corners * quad[:, :1])), np.column_stack((zero, one, -corners * quad[:, 1:]))])
    h = np.append(np.linalg.solve(a, np.concatenate((quad[:, 0], quad[:, 1]))), 1.0).reshape(3, 3)
    x, y = np.meshgrid(np.arange(width), np.arange(height))
    p = h @ np.stack((x.ravel(), y.ravel(), np.ones(width * height)))
    px, py = np.where(p[2] == 0, 0, p[0] / p[2]).round(9), np.where(p[2] == 0, 0, p[1] / p[2]).round(9)
    rows, cols = image.shape[1:]
    inside = (px >= 0) & (py >= 0) & (px <= cols - 1) & (py <= rows - 1)
    cx, cy = np.where(inside, px, 0), np.where(inside, py, 0)
    x0, y0 = np.floor(cx).astype(int), np.floor(cy).astype(int)
    x1, y1, dx, dy = np.minimum(x0 + 1, cols - 1), np.minimum(y0 + 1, rows - 1), cx - x0, cy - y0
    mixed = [(c[y0, x0] * (1 - dx) + c[y0, x1] * dx) * (1 - dy) + (c[y1, x0] * (1 - dx) + c[y1, x1] * dx) * dy for c in image]
    return np.stack([_stored(np.where(inside, m, 0)).reshape(height, width) for m in mixed])


def upright_size(quad: np.ndarray, most: float = 1800.0) -> tuple[int, int]:
    side = np.hypot(*(np.roll(quad, -1, axis=0) - quad).T)
    w, h = (side[0] + side[2]) / 2, (side[1] + side[3]) / 2
    if min(w, h) < 8:
        return 8, 8
    scale = min(1.0, most / max(w, h))
    return max(32, int(np.floor(w * scale + 0.5))), max(32, int(np.floor(h * scale + 0.5)))


def _image(row) -> np.ndarray:
    return np.stack([np.asarray(c, float).reshape(-1, row.width) for c in (row.red, row.green, row.blue)])


def edges_of(images: DataFrame) -> DataFrame:
    """image_id, width, edges (gradient magnitudes of gray), grown (cells over half the greatest, dilated)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            edges = [sobel(_gray(*_image(r))) for r in batch.itertuples()]
            grown = [dilated(e >= max(e.max(), 1) / 2).astype(int) for e in edges]
            yield pd.DataFrame({"image_id": batch["image_id"], "width": batch["width"], "edges": [e.ravel() for e in edges], "grown": [g.ravel() for g in grown]})

    return images.mapInPandas(run, "image_id long, width int, edges array<double>, grown array<int>")


def detected(images: DataFrame) -> DataFrame:
    """image_id, quad (x, y of four corners), confidence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [detect(*_image(r)) for r in batch.itertuples()]
            yield pd.DataFrame({"image_id": batch["image_id"], "quad": [q.ravel() for q, _ in found], "confidence": [c for _, c in found]})

    return images.mapInPandas(run, "image_id long, quad array<double>, confidence double")


def processed(images: DataFrame, preset: str, turns: int = 0) -> DataFrame:
    """Each image with a column `quad` cut to its sheet, enhanced and turned clockwise; without one enhanced whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                image = _image(r)
                if hasattr(r, "quad") and r.quad is not None:
                    quad = clamped(np.asarray(r.quad, float).reshape(4, 2), image.shape[2], image.shape[1])
                    image = warped(image, quad, upright_size(quad))
                image = np.rot90(PRESETS[preset](image), -turns, axes=(1, 2))
                out.append((r.image_id, image.shape[2], *[c.ravel() for c in image]))
            yield pd.DataFrame(out, columns=["image_id", "width", "red", "green", "blue"])

    return images.mapInPandas(run, RGB)


def turned(pixels: Column, width: Column, turns: int) -> Column:
    """Pixels of one colour after quarter turns clockwise."""
    n = F.size(pixels)
    rows = F.floor(n / width).cast("int")
    w, h = (width, rows) if turns % 2 == 0 else (rows, width)
    at = lambda k: (F.floor(k / w).cast("int"), (k % w).cast("int"))

    def source(k: Column) -> Column:
        y, x = at(k)
        picked = {0: (y, x), 1: (h * 0 + rows - 1 - x, y), 2: (rows - 1 - y, width - 1 - x), 3: (x, width - 1 - y)}[turns % 4]
        return F.get(pixels, (picked[0] * width + picked[1]).cast("int"))

    return F.transform(F.sequence(F.lit(0), n - 1), source)


def punched(pixels: Column, width: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    """Pixels of one colour with a rectangle painted black."""
    x0, y0, w, h = box
    inside = lambda k: (k % width).between(x0, x0 + w - 1) & F.floor(k / width).between(y0, y0 + h - 1)
    return F.transform(pixels, lambda v, k: F.when(inside(k), F.lit(0.0)).otherwise(v))
