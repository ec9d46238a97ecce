"""Dense kernels over pixel columns (height, width, pixels as a flat array), run in Arrow batches.

Each batch of equally shaped images is one stack, so that a kernel is a few NumPy operations for the
whole of it. Null or misshapen pixels give nulls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

TILES = 4


def laplacian(stack: np.ndarray) -> np.ndarray:
    """The five-point Laplacian of each image's inside."""
    return stack[:, :-2, 1:-1] + stack[:, 2:, 1:-1] + stack[:, 1:-1, :-2] + stack[:, 1:-1, 2:] - 4 * stack[:, 1:-1, 1:-1]


def sharpness(stack: np.ndarray) -> np.ndarray:
    return laplacian(stack).var(axis=(1, 2))


def blurred(stack: np.ndarray, sigma: float = 2.0) -> np.ndarray:
    """A separable Gaussian blur with edges repeated."""
    r = max(1, int(3 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        wide = np.pad(stack, pad, mode="edge")
        stack = sum(w * np.take(wide, range(i, i + stack.shape[axis]), axis=axis) for i, w in enumerate(k))
    return stack


def blur_ratio(stack: np.ndarray) -> np.ndarray:
    """Sharpness over that of the blurred image; 0 where there is none."""
    soft = sharpness(blurred(stack))
    return np.divide(sharpness(stack), soft, out=np.zeros(len(stack)), where=soft > 1e-12)


def sharpest_tile(stack: np.ndarray, tiles: int = TILES) -> np.ndarray:
    """The largest sharpness among tiles of at least three pixels a side."""
    _, h, w = stack.shape
    best = np.zeros(len(stack))
    for i in range(tiles):
        for j in range(tiles):
            tile = stack[:, i * h // tiles : (i + 1) * h // tiles, j * w // tiles : (j + 1) * w // tiles]
            if min(tile.shape[1:]) >= 3:
                best = np.maximum(best, sharpness(tile))
    return best


def quality(mean: np.ndarray, std: np.ndarray, sharp: np.ndarray, clipped: np.ndarray) -> np.ndarray:
    """0 to 100 from exposure, contrast and detail, lowered by clipping; 2 places."""
    exposure = 100 * np.exp(-(((mean - 118.0) / 45.0) ** 2))
    contrast = 100 * np.clip((std - 25.0) / 55.0, 0, 1)
    detail = np.clip(42.0 * np.log10(1.0 + sharp) - 59.5, 0, 100)
    return np.round((0.36 * exposure + 0.28 * contrast + 0.36 * detail) * np.maximum(0.4, 1 - 3 * clipped), 2)


def phase_shift(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(dy, dx) of each pair of images by the peak of their phase correlation."""
    fa, fb = np.fft.fft2(a - a.mean(axis=(1, 2), keepdims=True)), np.fft.fft2(b - b.mean(axis=(1, 2), keepdims=True))
    cross = fa * np.conj(fb)
    peak = np.abs(np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-9))).reshape(len(a), -1).argmax(axis=1)
    y, x = np.unravel_index(peak, a.shape[1:])
    h, w = a.shape[1:]
    return np.stack([np.where(y > h // 2, y - h, y), np.where(x > w // 2, x - w, x)], axis=1)


def measure(df: DataFrame, key: str = "key") -> DataFrame:
    """(key, sharpness, blur_ratio, sharpest_tile, mean_luma, stddev_luma, clipped, quality) of (key, height, width, pixels)."""
    kind = dict(df.dtypes)[key]
    names = ["sharpness", "blur_ratio", "sharpest_tile", "mean_luma", "stddev_luma", "clipped", "quality"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = frame["pixels"].map(lambda p: -1 if p is None else len(p))
            out = pd.DataFrame({key: frame[key], **{n: np.nan for n in names}})
            fits = (sizes == frame["height"] * frame["width"]) & (frame["height"] >= 3) & (frame["width"] >= 3)
            for (h, w), own in frame[fits].groupby(["height", "width"]):
                stack = np.stack(own["pixels"].to_list()).astype(float).reshape(len(own), h, w)
                flat = stack.reshape(len(own), -1)
                sharp, clipped = sharpness(stack), ((flat >= 253) | (flat <= 2)).mean(axis=1)
                values = [sharp, blur_ratio(stack), sharpest_tile(stack), flat.mean(axis=1), flat.std(axis=1), clipped]
                values.append(quality(values[3], values[4], sharp, clipped))
                out.loc[own.index, names] = np.stack([np.round(v, 6) for v in values], axis=1)
            yield out.astype({n: float for n in names}).replace({np.nan: None})

    schema = f"{key} {kind}, " + ", ".join(f"{n} double" for n in names)
    return df.select(key, "height", "width", "pixels").mapInPandas(run, schema)


# Render curves over display values from 0 to 1; amounts from -100 to 100. `tones` has them as column expressions.
# Where highlights begin and shadows end, and how strong either curve is.
HIGHLIGHT_PIVOT, SHADOW_PIVOT, HIGHLIGHT_GAIN, SHADOW_GAIN = 0.72, 0.28, 0.9, 0.8


def highlights(display: np.ndarray, amount: float) -> np.ndarray:
    """Values above the pivot moved towards white (positive) or away, more the further above they are and the further from white."""
    above = np.clip((display - HIGHLIGHT_PIVOT) / (1 - HIGHLIGHT_PIVOT), 0, 1)
    return np.clip(display + above * (1 - display) * HIGHLIGHT_GAIN * amount / 100, 0, 1)


def shadows(display: np.ndarray, amount: float) -> np.ndarray:
    """Values below the pivot lifted (positive) or lowered, more the further below they are."""
    depth = np.maximum(SHADOW_PIVOT - display, 0)
    return np.clip(display + np.minimum(depth / SHADOW_PIVOT, 1) * depth * SHADOW_GAIN * amount / 100, 0, 1)


def contrast(display: np.ndarray, amount: float) -> np.ndarray:
    """A curve through the middle that leaves both ends in place."""
    off = display - 0.5
    return np.clip(display + off * (1 - 2 * np.abs(off)) * amount / 100, 0, 1)


def exposure(rgb: np.ndarray, ev: float, gamma: float = 2.2) -> np.ndarray:
    """8-bit values brightened by stops in linear light."""
    return np.clip(255 * np.clip((rgb / 255) ** gamma * 2.0**ev, 0, 1) ** (1 / gamma), 0, 255)


def grey_world(rgb: np.ndarray, damping: float = 0.5) -> np.ndarray:
    """Channel means drawn towards their mean, by half; dark channels are left alone."""
    mean = rgb.reshape(-1, 3).mean(axis=0)
    gain = 1 + damping * (np.where(mean > 1.0, mean.mean() / np.maximum(mean, 1.0), 1.0) - 1)
    return np.clip(rgb * gain, 0, 255)


def normalised(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay zero."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors, dtype=float), where=norm > 0)


def channel_percentiles(plane: np.ndarray, white: float, margin: float = 0.995) -> dict[str, float]:
    """A sensor channel's p01, p50, p99, p99.9, largest value and clipped share, and the headroom over p99.9 in stops."""
    p = np.percentile(plane, [1, 50, 99, 99.9])
    return dict(zip(("p01", "p50", "p99", "p999"), map(float, p), strict=True)) | {"max": float(plane.max()), "clipped": float((plane >= white * margin).mean()), "headroom": float(np.log2(white / max(p[3], 1e-6)))}


def burst_motion(df: DataFrame) -> DataFrame:
    """(clip, burst, pair, dx, dy, shear, difference) of neighbouring frames of (clip, burst, height, width, frames), frames being flat arrays of light in order.

    Movement is that of the phase correlation, shear the difference between the sideways movements of the upper and the lower half (0 for
    halves of fewer than 8 lines). Bursts are a few small frames, one row each; those of fewer than two frames give no rows.
    """
    kinds = dict(df.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if row.frames is None or len(row.frames) < 2:
                    continue
                stack = np.stack([np.asarray(f, dtype=float).reshape(row.height, row.width) for f in row.frames])
                a, b = stack[:-1], stack[1:]
                moved, half = phase_shift(a, b), row.height // 2
                shear = np.abs(phase_shift(a[:, :half], b[:, :half])[:, 1] - phase_shift(a[:, half:], b[:, half:])[:, 1]) if half >= 8 else np.zeros(len(a))
                differ = np.abs(a - b).mean(axis=(1, 2))
                out += [(row.clip, row.burst, i, float(moved[i, 1]), float(moved[i, 0]), float(shear[i]), round(float(differ[i]), 6)) for i in range(len(a))]
            yield pd.DataFrame(out, columns=["clip", "burst", "pair", "dx", "dy", "shear", "difference"])

    return df.select("clip", "burst", "height", "width", "frames").mapInPandas(run, f"clip {kinds['clip']}, burst {kinds['burst']}, pair int, dx double, dy double, shear double, difference double")


def _median3(stack: np.ndarray) -> np.ndarray:
    """The median of each 3 x 3 neighbourhood, edges repeated."""
    wide = np.pad(stack, ((0, 0), (1, 1), (1, 1)), mode="edge")
    h, w = stack.shape[1:]
    return np.median(np.stack([wide[:, i : i + h, j : j + w] for i in range(3) for j in range(3)]), axis=0)


def noise(stack: np.ndarray, tiles: int = 4) -> np.ndarray:
    """What whole light values differ from their median by, in the quietest third of the tiles; 0 for pictures under 16 pixels a side."""
    n, h, w = stack.shape
    if min(h, w) < 16:
        return np.zeros(n)
    rest = stack - _median3(np.floor(stack))
    spread = np.stack([rest[:, i * h // tiles : (i + 1) * h // tiles, j * w // tiles : (j + 1) * w // tiles].std(axis=(1, 2)) for i in range(tiles) for j in range(tiles)], axis=1)
    return np.round(np.sort(spread, axis=1)[:, : max(1, tiles * tiles // 3)].mean(axis=1), 3)


def anisotropy(stack: np.ndarray, sigma: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """How much more detail one direction has than the other (0 to 1), and the direction of the blur in degrees; 0 for small and flat pictures."""
    n, h, w = stack.shape
    if min(h, w) < 16:
        return np.zeros(n), np.zeros(n)
    soft = np.floor(blurred(np.floor(np.clip(stack, 0, 255)), sigma) + 0.5)
    gy, gx = soft[:, 2:, 1:-1] - soft[:, :-2, 1:-1], soft[:, 1:-1, 2:] - soft[:, 1:-1, :-2]
    across, down = np.diff(gx, axis=2).var(axis=(1, 2)), np.diff(gy, axis=1).var(axis=(1, 2))
    total = across + down
    share = np.divide(np.abs(across - down), total, out=np.zeros(n), where=total > 1e-9)
    return np.round(share, 4), np.where((across >= down) | (total <= 1e-9), 0.0, 90.0)
