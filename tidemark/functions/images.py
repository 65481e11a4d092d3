"""Image features: hashes as SQL expressions, and pixel kernels in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def average_hash(pixels: Column) -> Column:
    """One bit for each pixel: whether it is over the mean."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x) / F.size(pixels)
    return F.transform(pixels, lambda x: (x > mean).cast("int"))


def difference_hash(pixels: Column, width: int = 8) -> Column:
    """Whether each pixel but a row's first is over the one to its left."""
    return F.filter(F.transform(pixels, lambda x, i: F.when(i % width > 0, (x > F.get(pixels, i - 1)).cast("int"))), lambda b: b.isNotNull())


def as_bits(bits: Column) -> Column:
    """Up to 64 bits as text of 0 and 1."""
    return F.array_join(F.transform(bits, lambda b: b.cast("string")), "")


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ in two whole numbers."""
    return F.bit_count(a.bitwiseXOR(b))


def cosine_transform(n: int) -> np.ndarray:
    return np.array([[2 * np.cos(np.pi * u * (2 * x + 1) / (2 * n)) for x in range(n)] for u in range(n)])


def perceptual_hash(pixels: np.ndarray, keep: int = 8) -> np.ndarray:
    """Low frequencies of the cosine transform of a square grey image, over their median."""
    d = cosine_transform(len(pixels))
    low = (d @ pixels @ d.T)[:keep, :keep]
    return (low > np.median(low)).reshape(-1)


def wavelet_hash(pixels: np.ndarray, keep: int = 8) -> np.ndarray:
    """Haar averages down to keep x keep, without the overall mean, over their median."""
    low = pixels.astype(float)
    while len(low) > keep:
        low = (low[::2, ::2] + low[1::2, ::2] + low[::2, 1::2] + low[1::2, 1::2]) / 4
    low = low - low.mean()
    return (low > np.median(low)).reshape(-1)


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 map that sends four points to four points."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)


def warp(image: np.ndarray, matrix: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image seen through the map, bilinear; outside it is transparent black."""
    ys, xs = np.mgrid[0:height, 0:width]
    x, y, w = np.tensordot(np.linalg.inv(matrix), np.stack([xs, ys, np.ones_like(xs)]), 1)
    x, y = np.round(x / w, 9), np.round(y / w, 9)
    left, top = np.floor(x).astype(int), np.floor(y).astype(int)
    out = np.zeros((height, width, image.shape[2]))
    for dx in (0, 1):
        for dy in (0, 1):
            share = (1 - np.abs(x - left - dx)) * (1 - np.abs(y - top - dy))
            inside = (left + dx >= 0) & (left + dx < image.shape[1]) & (top + dy >= 0) & (top + dy < image.shape[0])
            out += np.where((inside & (share > 0))[..., None], share[..., None] * image[np.clip(top + dy, 0, image.shape[0] - 1), np.clip(left + dx, 0, image.shape[1] - 1)], 0)
    return np.rint(out).astype(image.dtype)


def screen_image(image: np.ndarray, corners: np.ndarray, ratio: float | None = None) -> np.ndarray:
    """The quadrangle (tl, tr, bl, br) of a frame's image as a rectangle of its own size, or stretched to a ratio."""
    return warp(image, *screen_map(corners, ratio))


def screen_map(corners: np.ndarray, ratio: float | None = None) -> tuple[np.ndarray, int, int]:
    """The map from a frame to a screen with these corners (tl, tr, bl, br), and the screen's width and height.

    With ``ratio`` the screen is stretched along one side only, so that width / height comes to it and no side shrinks.
    """
    side = lambda a, b: int(np.hypot(*(corners[a] - corners[b])))
    w, h = max(side(0, 1), side(2, 3)), max(side(0, 2), side(1, 3))
    found = homography(corners, np.array([(0, 0), (w - 1, 0), (0, h - 1), (w - 1, h - 1)], float))
    if ratio is None:
        return found, w, h
    if not w or not h or not ratio:
        raise ValueError("sides and ratio must not be zero")
    wide, high = (round(h * ratio), h) if h * ratio > w else (w, round(w / ratio))
    return np.diag([wide / w, high / h, 1.0]) @ found, wide, high


def lab(image: np.ndarray) -> np.ndarray:
    """8-bit RGB as 8-bit CIE Lab under D65: lightness by 255 / 100, and the other two by 128 more."""
    share = image.astype(np.float64) / 255
    linear = np.where(share > 0.04045, ((share + 0.055) / 1.055) ** 2.4, share / 12.92)
    # Fixed values of sRGB: primaries to XYZ, and the white point.
    xyz = linear @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > (6 / 29) ** 3, np.cbrt(xyz), xyz * (29 / 6) ** 2 / 3 + 4 / 29)
    x, y, z = f[..., 0], f[..., 1], f[..., 2]
    out = np.stack([(116 * y - 16) * 255 / 100, 500 * (x - y) + 128, 200 * (y - z) + 128], -1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def mask_tensor(mask: np.ndarray) -> np.ndarray:
    """A mask as three equal channels from 0 to 1, channels first."""
    return np.repeat((mask.astype(np.float32) / 255)[None], 3, 0)


def tensor_mask(tensor: np.ndarray, width: int | None = None, height: int | None = None) -> np.ndarray:
    """Back to an 8-bit mask, of the first channel, in another size if one is given."""
    mask = np.clip(np.rint(tensor[0] * 255), 0, 255).astype(np.uint8)
    return mask if width is None or height is None else resize(mask[..., None], width, height)[..., 0]


def shrink(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Each pixel the mean of the area that it covers."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.arange(m + 1) * n / m
        low, high = np.maximum(edges[:-1, None], np.arange(n)), np.minimum(edges[1:, None], np.arange(1, n + 1))
        return np.maximum(0, high - low) * m / n

    mixed = np.einsum("yi,ijc,xj->yxc", weights(image.shape[0], height), image.astype(float), weights(image.shape[1], width), optimize=True)
    return np.rint(mixed).astype(image.dtype)


def page_image(draw: Callable[[float], np.ndarray], default: tuple[int, int], width: int, height: int) -> np.ndarray:
    """A page in a box of that size, its aspect ratio kept, between transparent margins.

    draw gives the page as RGBA at a zoom; default is its size at zoom 1. It is drawn so large that nothing has to grow, and
    shrunk by areas.
    """
    zoom = max(width / max(1, default[0] - 1), height / max(1, default[1] - 1))
    image = draw(zoom)
    ratio = min(width / image.shape[1], height / image.shape[0])
    w, h = max(1, round(image.shape[1] * ratio)), max(1, round(image.shape[0] * ratio))
    out = np.zeros((height, width, image.shape[2]), image.dtype)
    top, left = (height - h) // 2, (width - w) // 2
    out[top : top + h, left : left + w] = shrink(image, w, h) if ratio < 1 else resize(image, w, h)
    return out


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, pixel centres kept."""
    ys = np.clip((np.arange(height) + 0.5) * image.shape[0] / height - 0.5, 0, image.shape[0] - 1)
    xs = np.clip((np.arange(width) + 0.5) * image.shape[1] / width - 0.5, 0, image.shape[1] - 1)
    y0, x0 = ys.astype(int), xs.astype(int)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (ys - y0)[:, None, None], (xs - x0)[None, :, None]
    at = lambda y, x: image[y][:, x].astype(float)
    mixed = (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x1)) + fy * ((1 - fx) * at(y1, x0) + fx * at(y1, x1))
    return np.rint(mixed).astype(image.dtype)


def render(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """An RGBA image within a box of that size, its aspect ratio kept, centred between transparent margins."""
    ratio = min(width / image.shape[1], height / image.shape[0])
    w, h = round(image.shape[1] * ratio), round(image.shape[0] * ratio)
    out = np.zeros((height, width, image.shape[2]), image.dtype)
    top, left = (height - h) // 2, (width - w) // 2
    out[top : top + h, left : left + w] = resize(image, w, h)
    return out


def grey(image: np.ndarray, width: int = 381, height: int = 286) -> np.ndarray:
    """A rendered image's luma as float32."""
    return (render(image, width, height)[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.float32)


def mean_squared_error(a: np.ndarray, b: np.ndarray, wrap: bool = False) -> float:
    """Of two 8-bit images on the scale from 0 to 1; with wrap, differences are modulo 256."""
    gap = (a.astype(np.uint8) - b.astype(np.uint8)).astype(float) if wrap else a.astype(float) - b.astype(float)
    return float(((gap / 255) ** 2).mean())


def sliding(mask: np.ndarray, size: int, shrink: bool) -> np.ndarray:
    """Erodes or dilates a mask by a square, by running sums."""
    work = ~mask if shrink else mask
    for axis in (0, 1):
        before = (size - 1) // 2
        pad = [(0, 0), (0, 0)]
        pad[axis] = (before + 1, size - 1 - before)
        sums = np.pad(work.astype(int), pad).cumsum(axis)
        take = lambda a, n, s=sums, k=axis: np.take(s, np.arange(a, a + n), k)
        work = take(size, mask.shape[axis]) - take(0, mask.shape[axis]) > 0
    return ~work if shrink else work


def fill_polygon(points: list[tuple[float, float]], height: int, width: int) -> np.ndarray:
    """The mask of a polygon, even-odd, by pixel centres on whole numbers, its border included."""
    ys, xs = np.mgrid[0:height, 0:width].astype(float)
    inside = np.zeros((height, width), bool)
    border = np.zeros((height, width), bool)
    for (x0, y0), (x1, y1) in zip(points, points[1:] + points[:1], strict=True):
        if y0 != y1:
            crosses = (np.minimum(y0, y1) <= ys) & (ys < np.maximum(y0, y1))
            inside ^= crosses & (xs < x0 + (ys - y0) * (x1 - x0) / (y1 - y0))
        steps = int(max(abs(x1 - x0), abs(y1 - y0))) + 1
        line = np.rint(np.linspace((x0, y0), (x1, y1), steps)).astype(int)
        ok = (line[:, 0] >= 0) & (line[:, 0] < width) & (line[:, 1] >= 0) & (line[:, 1] < height)
        border[line[ok, 1], line[ok, 0]] = True
    return inside | border
