"""Image arithmetic on arrays: grey values, colours, thresholds, edges, scaling, components and holes.

Grey images are uint8 (height, width), colour images uint8 (height, width, 3) in the order blue, green, red.
Rounding and borders follow the usual conventions of image libraries, so that thresholds mean the same.
"""

from __future__ import annotations

from collections import deque

import numpy as np

#: Hue (0 to 179), saturation and value ranges of the colours that names are written in.
COLOURS = {
    "red": (((0, 100, 50), (4, 255, 235)), ((176, 100, 50), (179, 255, 235))),
    "blue": (((92, 80, 105), (114, 255, 255)),),
    "yellow": (((18, 110, 170), (40, 255, 255)),),
}


def grey(image: np.ndarray) -> np.ndarray:
    """Brightness of a colour image."""
    return np.rint(image.astype(np.float64) @ (0.114, 0.587, 0.299)).astype(np.uint8)


def hsv(image: np.ndarray) -> np.ndarray:
    """Hue from 0 to 179, saturation and value from 0 to 255."""
    b, g, r = np.moveaxis(image.astype(np.float64), -1, 0)
    v, low = image.max(axis=-1).astype(np.float64), image.min(axis=-1)
    spread = v - low
    safe = np.where(spread > 0, spread, 1)
    hue = np.select([spread == 0, v == r, v == g], [0, (g - b) / safe, 2 + (b - r) / safe], 4 + (r - g) / safe) * 30
    hue = np.rint(np.where(hue < 0, hue + 180, hue)) % 180
    return np.stack([hue, np.rint(np.where(v > 0, 255 * spread / np.where(v > 0, v, 1), 0)), v], axis=-1).astype(np.uint8)


def in_range(image: np.ndarray, low: tuple, high: tuple) -> np.ndarray:
    return ((image >= np.array(low)) & (image <= np.array(high))).all(axis=-1)


def blurred(image: np.ndarray) -> np.ndarray:
    """Binomial blur over 3 x 3; the border mirrors without repeating the edge."""
    if not image.size:
        return image
    p = np.pad(image.astype(np.int64), 1, mode="reflect" if min(image.shape) > 1 else "edge")
    rows = p[:-2] + 2 * p[1:-1] + p[2:]
    return ((rows[:, :-2] + 2 * rows[:, 1:-1] + rows[:, 2:] + 8) // 16).astype(np.uint8)


def otsu(image: np.ndarray) -> int:
    """The grey value that parts the image best: larger ones are foreground. The lowest of equally good ones."""
    n = np.bincount(image.ravel(), minlength=256).astype(np.float64)
    below, total = np.cumsum(n), n.sum()
    sums = np.cumsum(n * np.arange(256))
    above = total - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((below > 0) & (above > 0), below * above * (sums / below - (sums[-1] - sums) / above) ** 2, 0)
    return int(between.argmax()) if total else 0


def parted(image: np.ndarray, bias: float = 0.0) -> np.ndarray:
    """True above the Otsu threshold, moved by ``bias`` and kept from 0 to 255."""
    return image > min(255.0, max(0.0, otsu(image) + bias))


def dark_side(mask: np.ndarray, most: float) -> np.ndarray:
    """The mask, or its inverse where more than ``most`` of it is set."""
    return ~mask if mask.size and mask.mean() > most else mask


def nearest(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Scaled by taking the nearest pixel."""
    rows = np.minimum(np.arange(height) * image.shape[0] // height, image.shape[0] - 1)
    cols = np.minimum(np.arange(width) * image.shape[1] // width, image.shape[1] - 1)
    return image[rows][:, cols]


def _cubic_weights(n: int, size: int) -> np.ndarray:
    """(size, n) weights of a cubic through four neighbours, edges repeated."""
    at = (np.arange(size) + 0.5) * n / size - 0.5
    left = np.floor(at).astype(int)
    out, a = np.zeros((size, n)), -0.75
    for k in range(-1, 3):
        d = np.abs(at - (left + k))
        w = np.where(d <= 1, ((a + 2) * d - (a + 3)) * d * d + 1, np.where(d < 2, ((a * d - 5 * a) * d + 8 * a) * d - 4 * a, 0))
        np.add.at(out, (np.arange(size), np.clip(left + k, 0, n - 1)), w)
    return out


def cubic(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Scaled by bicubic interpolation."""
    out = _cubic_weights(image.shape[0], height) @ image.astype(np.float64) @ _cubic_weights(image.shape[1], width).T
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _around(cell: tuple[int, int], shape: tuple[int, int], eight: bool):
    y, x = cell
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if (dy or dx) and (eight or not (dy and dx)) and 0 <= y + dy < shape[0] and 0 <= x + dx < shape[1]:
                yield y + dy, x + dx


def components(mask: np.ndarray, eight: bool = True) -> list[np.ndarray]:
    """The connected parts of a mask in reading order, as arrays of (y, x); ``eight``: corners connect."""
    left, out = mask.astype(bool).copy(), []
    for start in zip(*np.nonzero(mask), strict=True):
        if not left[start]:
            continue
        left[start] = False
        queue, cells = deque([start]), []
        while queue:
            cells.append(cell := queue.popleft())
            for other in _around(cell, mask.shape, eight):
                if left[other]:
                    left[other] = False
                    queue.append(other)
        out.append(np.array(cells))
    return out


def hole_areas(mask: np.ndarray) -> list[float]:
    """Areas of the holes of a mask, each inside the polygon of the set pixels around it.

    The hole's pixels are the lattice points inside that polygon and the set pixels beside them those on it, so
    Pick's theorem gives the area.
    """
    out = []
    for cells in components(~mask.astype(bool), eight=False):
        if (cells == 0).any() or (cells == np.array(mask.shape) - 1).any():
            continue
        own = set(map(tuple, cells.tolist()))
        rim = {o for c in own for o in _around(c, mask.shape, False)} - own
        out.append(len(own) + len(rim) / 2 - 1)
    return out


def edges(image: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Edges by gradient: thinned to local maxima across the edge, and those above ``low`` that hang on one above ``high``."""
    p = np.pad(image.astype(np.int64), 1, mode="edge")
    smooth = lambda a, b, c: a + 2 * b + c
    dx = smooth(p[:-2, 2:], p[1:-1, 2:], p[2:, 2:]) - smooth(p[:-2, :-2], p[1:-1, :-2], p[2:, :-2])
    dy = smooth(p[2:, :-2], p[2:, 1:-1], p[2:, 2:]) - smooth(p[:-2, :-2], p[:-2, 1:-1], p[:-2, 2:])
    size = np.abs(dx) + np.abs(dy)
    m = np.pad(size, 1)
    at = lambda y, x: m[1 + y : m.shape[0] - 1 + y, 1 + x : m.shape[1] - 1 + x]
    flat, steep = np.abs(dy) < np.abs(dx) * np.tan(np.pi / 8), np.abs(dy) > np.abs(dx) * np.tan(3 * np.pi / 8)
    along = np.where(dx * dy < 0, (size > at(-1, 1)) & (size > at(1, -1)), (size > at(-1, -1)) & (size > at(1, 1)))
    thin = np.select([flat, steep], [(size > at(0, -1)) & (size >= at(0, 1)), (size > at(-1, 0)) & (size >= at(1, 0))], along) & (size > low)
    out = np.zeros(image.shape, dtype=bool)
    for cells in components(thin):
        y, x = cells.T
        if (size[y, x] > high).any():
            out[y, x] = True
    return out


def activity(image: np.ndarray) -> np.ndarray:
    """What moves in a feed: foreground or edges of the blurred image."""
    soft = blurred(image)
    return parted(soft) | edges(soft)


def reading_views(image: np.ndarray) -> dict[str, np.ndarray]:
    """Masks of a colour image at twice its size for a recogniser of text: one by brightness, one for each of COLOURS."""
    h, w = image.shape[:2]
    out = {"grayscale": dark_side(parted(blurred(cubic(grey(image), 2 * w, 2 * h))), 0.60)}
    colours = hsv(image)
    for name, ranges in COLOURS.items():
        mask = np.logical_or.reduce([in_range(colours, *r) for r in ranges])
        out[name] = dark_side(nearest(mask, 2 * w, 2 * h), 0.60)
    return out


def correlation(image: np.ndarray, template: np.ndarray) -> float:
    """Normalised correlation of a grey image, scaled to the template's size, with the template; 0 if either is flat."""
    a = cubic(image, template.shape[1], template.shape[0]).astype(np.float64)
    a, b = a - a.mean(), template - template.mean()
    size = float(np.sqrt((a * a).sum() * (b * b).sum()))
    return float((a * b).sum() / size) if size else 0.0


def shows_board(area: np.ndarray, header: np.ndarray, template: np.ndarray | None, least_fill: float = 0.03, least_similarity: float = 0.70) -> bool:
    """Whether a board is on screen: enough of its area is foreground and its header is like the template."""
    if not area.size or not header.size or template is None:
        return False
    return float(parted(grey(area)).mean()) >= least_fill and correlation(grey(header), template) >= least_similarity
