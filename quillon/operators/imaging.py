"""Raster transforms that are not row algebra: convolution, FFT, SSIM, components, perspective warps.

Each works on one row for each raster, an array of values row by row with its width. Rasters go to Python in Arrow
batches and are independent of each other, so a task holds one batch, never a group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The radial frequency bands of a texture.
BANDS = ((0.02, 0.06), (0.06, 0.14), (0.14, 0.3), (0.3, 0.5))


#: Fixed value: the stabiliser of the structure term.
STABLE = 1e-4


def gaussian(sigma: float, radius: int) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return k / k.sum()


def blur(img: np.ndarray, sigma: float, radius: int | None = None) -> np.ndarray:
    """Separable Gaussian blur; edges are mirrored without repeating the border."""
    r = min(radius or max(1, round(3 * sigma)), min(img.shape) - 1)
    k = gaussian(sigma, r)
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in (0, 1)]
        img = np.apply_along_axis(np.convolve, axis, np.pad(img, pad, mode="reflect"), k, "valid")
    return img


def sobel(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.pad(img, 1, mode="reflect")
    smooth = lambda a: a[:-2] + 2 * a[1:-1] + a[2:]
    gx = smooth(p[:, 2:]) - smooth(p[:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    return gx, gy


def laplacian_variance(img: np.ndarray) -> float:
    p = np.pad(img, 1, mode="reflect")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * img).var())


def band_energy(img: np.ndarray, valid: np.ndarray | None = None) -> list[float] | None:
    """Share of the energy in each band of radial frequency of the standardised raster under a Hann window; pixels that are
    not valid count as the mean. Null with fewer than 64 valid pixels, or where they are flat."""
    valid = np.ones(img.shape, bool) if valid is None else valid
    own = img[valid]
    if own.size < 64 or own.std() < 1e-5:
        return None
    standard = np.where(valid, (img - own.mean()) / own.std(), 0.0)
    power = np.abs(np.fft.fft2(standard * np.outer(np.hanning(img.shape[0]), np.hanning(img.shape[1])))) ** 2
    fy, fx = np.meshgrid(np.fft.fftfreq(img.shape[0]), np.fft.fftfreq(img.shape[1]), indexing="ij")
    radius = np.hypot(fx, fy)
    bands = np.array([power[(radius >= a) & (radius < b)].sum() for a, b in BANDS])
    return (bands / bands.sum()).tolist() if bands.sum() > 1e-6 else None


def texture_agreement(a: np.ndarray, b: np.ndarray, valid: np.ndarray | None = None) -> float | None:
    """1 less half the difference of the two rasters' band energies; null where one has none."""
    x, y = band_energy(a, valid), band_energy(b, valid)
    return None if x is None or y is None else float(1 - 0.5 * np.abs(np.array(x) - np.array(y)).sum())


def texture_peak(img: np.ndarray) -> tuple[float, float, float]:
    """(frequency, direction in degrees of [0, 180), strength) of the strongest frequency."""
    power = np.abs(np.fft.fft2(img - img.mean()))
    power[0, 0] = 0
    k = np.unravel_index(int(power.argmax()), power.shape)
    fy, fx = np.fft.fftfreq(img.shape[0])[k[0]], np.fft.fftfreq(img.shape[1])[k[1]]
    return float(np.hypot(fx, fy)), float(np.degrees(np.arctan2(fy, fx)) % 180), float(power[k] / max(power.sum(), 1e-12))


def structure(a: np.ndarray, b: np.ndarray, sigma: float = 1.5, valid: np.ndarray | None = None) -> float:
    """Mean of the structure term of SSIM (11 x 11 windows), clipped to -1..1: over the valid pixels whose whole window is
    valid, or over all valid ones where there are none such; 0 without a valid pixel."""
    valid = np.ones(a.shape, bool) if valid is None else valid
    ma, mb = blur(a, sigma, 5), blur(b, sigma, 5)
    va, vb, cov = blur(a * a, sigma, 5) - ma * ma, blur(b * b, sigma, 5) - mb * mb, blur(a * b, sigma, 5) - ma * mb
    term = (cov + STABLE) / (np.sqrt(np.maximum(va, 0) * np.maximum(vb, 0)) + STABLE)
    h, w = valid.shape
    framed = np.pad(valid, 5, constant_values=True)  # what lies outside the raster does not count against a window
    inner = np.logical_and.reduce([framed[y : y + h, x : x + w] for y in range(11) for x in range(11)])
    region = inner if inner.any() else valid
    return float(np.clip(term[region], -1, 1).mean()) if region.any() else 0.0


def components(mask: np.ndarray) -> np.ndarray:
    """Labels (0 outside, else 1 ..) of the 8-connected components of a mask, by spreading the least label until nothing changes."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    while True:
        p = np.pad(np.where(mask, label, big), 1, constant_values=big)
        least = np.min([p[y : y + mask.shape[0], x : x + mask.shape[1]] for y in range(3) for x in range(3)], axis=0)
        new = np.where(mask, least, 0)
        if (new == label).all():
            return np.unique(label, return_inverse=True)[1].reshape(mask.shape) if not mask.all() else np.ones(mask.shape, int)
        label = new


def homography(src: Sequence[Sequence[float]], dst: Sequence[Sequence[float]]) -> np.ndarray:
    """The 3 x 3 matrix that takes four points to four others."""
    rows, out = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        out += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(out, float)), 1.0).reshape(3, 3)


def warp(img: np.ndarray, quad: Sequence[Sequence[float]], height: int, width: int) -> np.ndarray:
    """The raster inside a quad (from the top left, clockwise) on a height x width grid, bilinear, border repeated."""
    to = [(0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)]
    h = homography(to, quad)
    y, x = np.mgrid[0:height, 0:width]
    u, v, w = h @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    u, v = np.clip(u / w, 0, img.shape[1] - 1), np.clip(v / w, 0, img.shape[0] - 1)
    x0, y0 = np.minimum(u.astype(int), img.shape[1] - 2), np.minimum(v.astype(int), img.shape[0] - 2)
    a, b = u - x0, v - y0
    got = (1 - b) * ((1 - a) * img[y0, x0] + a * img[y0, x0 + 1]) + b * ((1 - a) * img[y0 + 1, x0] + a * img[y0 + 1, x0 + 1])
    return got.reshape(height, width)


def quad_score(quad: np.ndarray, image_area: float, aspect: float = 0.718) -> float | None:
    """How much a convex quad looks like a card: area, aspect and rectangularity; null below 8 % of the image."""
    q = np.asarray(quad, float)
    edges = np.roll(q, -1, axis=0) - q
    turns = edges[:, 0] * np.roll(edges[:, 1], -1) - edges[:, 1] * np.roll(edges[:, 0], -1)
    area = abs(np.dot(q[:, 0], np.roll(q[:, 1], -1)) - np.dot(q[:, 1], np.roll(q[:, 0], -1))) / 2
    if not ((turns > 0).all() or (turns < 0).all()) or area < 0.08 * image_area:
        return None
    sides = np.hypot(*edges.T)
    w, h = (sides[0] + sides[2]) / 2, (sides[1] + sides[3]) / 2
    ratio = min(w, h) / max(w, h, 1e-9)
    box = np.ptp(q[:, 0]) * np.ptp(q[:, 1])
    return float(0.52 * min(area / image_area / 0.65, 1) + 0.30 * np.exp(-5 * abs(np.log(ratio / aspect))) + 0.18 * min(area / max(box, 1e-9), 1))


def order_quad(points: np.ndarray) -> np.ndarray:
    """Corners from the top left, clockwise."""
    p = np.asarray(points, float)
    s, d = p.sum(axis=1), p[:, 1] - p[:, 0]
    return p[[s.argmin(), d.argmin(), s.argmax(), d.argmax()]]


def per_raster(f: Callable[[np.ndarray], object], kind: str, values: Column, width: int) -> Column:
    """A column: f of each raster."""

    @F.pandas_udf(kind)
    def run(rasters):
        out = [None if v is None else f(np.asarray(v, float).reshape(-1, width)) for v in rasters]
        return pd.DataFrame(out) if kind.startswith("struct") else pd.Series(out)

    return run(values)


def per_pair(f: Callable[[np.ndarray, np.ndarray], object], kind: str, a: Column, b: Column, width: int) -> Column:
    @F.pandas_udf(kind)
    def run(left, right):
        return pd.Series([f(np.asarray(x, float).reshape(-1, width), np.asarray(y, float).reshape(-1, width)) for x, y in zip(left, right, strict=True)])

    return run(a, b)


def glare(df: DataFrame, frame: str, values: str, width: int, level: float, least: int) -> DataFrame:
    """Bright 8-connected regions of each raster with at least `least` pixels, largest first: frame, region, size."""

    def sizes(img: np.ndarray) -> list[int]:
        n = np.bincount(components(img >= level).ravel())[1:]
        return sorted((int(x) for x in n if x >= least), reverse=True)

    return df.select(frame, F.posexplode(per_raster(sizes, "array<int>", F.col(values), width)).alias("region", "size"))
