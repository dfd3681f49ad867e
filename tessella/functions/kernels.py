"""Features of pictures and masks as functions of arrays, and the Arrow maps that apply them to rows.

A picture is raw RGB bytes, rows from the top, with its width and height; a mask has a byte for each pixel, over 0 where
the subject is. Luminance is that of Rec. 709.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values.
LUMA = (0.2126, 0.7152, 0.0722)
DARK, BRIGHT, SHADOW, HIGHLIGHT = 40.0, 220.0, 5.0, 250.0


def luminance(rgb: np.ndarray) -> np.ndarray:
    return rgb.astype(np.float32) @ np.array(LUMA, np.float32)


def laplacian_variance(gray: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian, edges repeated."""
    p = np.pad(gray.astype(np.float64), 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def gradient_energy(gray: np.ndarray) -> float:
    """Mean of the squared Sobel gradient."""
    p = np.pad(gray.astype(np.float64), 1, mode="edge")
    smooth = lambda a, axis: np.take(a, range(a.shape[axis] - 2), axis) + 2 * np.take(a, range(1, a.shape[axis] - 1), axis) + np.take(a, range(2, a.shape[axis]), axis)
    gx, gy = smooth(p[:, 2:] - p[:, :-2], 0), smooth(p[2:, :] - p[:-2, :], 1)
    return float((gx * gx + gy * gy).mean())


def area_resize(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas."""

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.linspace(0, n, m + 1)
        lo, hi = np.maximum(edge[:-1, None], np.arange(n)), np.minimum(edge[1:, None], np.arange(1, n + 1))
        w = np.clip(hi - lo, 0, None)
        return w / w.sum(axis=1, keepdims=True)

    return weights(gray.shape[0], height) @ gray @ weights(gray.shape[1], width).T


def long_side(gray: np.ndarray, side: int = 512) -> np.ndarray:
    """A picture whose longer side is `side` at most."""
    h, w = gray.shape
    scale = side / max(h, w)
    return gray if scale >= 1 else area_resize(gray, max(1, round(h * scale)), max(1, round(w * scale)))


def focus(rgb: np.ndarray, mask: np.ndarray | None = None) -> dict[str, float | None]:
    gray = long_side(luminance(rgb))
    return {"blur_score": laplacian_variance(gray), "gradient_energy": gradient_energy(gray)}


def exposure(rgb: np.ndarray, mask: np.ndarray | None = None) -> dict[str, float | None]:
    v = luminance(rgb)
    v = v[mask > 0] if mask is not None and (mask > 0).any() else v.reshape(-1)
    q = np.percentile(v, [1, 5, 50, 95, 99]) if v.size else [None] * 5
    share = lambda hit: float(hit.mean()) if v.size else None
    return {
        "mean_luminance": float(v.mean()) if v.size else None, "luminance_std": float(v.std()) if v.size else None, **{f"luminance_p{p:02d}": None if x is None else float(x) for p, x in zip((1, 5, 50, 95, 99), q, strict=True)},
        "dark_pixel_ratio": share(v <= DARK), "bright_pixel_ratio": share(v >= BRIGHT), "shadow_clip_ratio": share(v <= SHADOW), "highlight_clip_ratio": share(v >= HIGHLIGHT),
    }


def illumination(rgb: np.ndarray, mask: np.ndarray | None = None, cells: int = 3, least: int = 16) -> dict[str, float | None]:
    """Luminance by cells of a grid with enough pixels of the subject."""
    v = luminance(rgb).astype(np.float64)
    m = np.ones(v.shape) if mask is None else (mask > 0).astype(float)
    cut = lambda n: np.array([round(n * i / cells) for i in range(cells)])
    total = lambda a: np.add.reduceat(np.add.reduceat(a, cut(v.shape[0]), axis=0), cut(v.shape[1]), axis=1)
    n = total(m)
    ok = n >= least
    mean = np.where(ok, total(v * m) / np.maximum(n, 1), np.nan)
    if ok.sum() < 2:
        return {"valid_grid_cells": int(ok.sum()), "relative_luminance_range": None, "spatial_luminance_cv": None, "left_right_difference": None, "top_bottom_difference": None}
    x = mean[ok]

    def ends(axis: int) -> float | None:
        lines = [line[~np.isnan(line)].mean() for line in (mean if axis else mean.T) if (~np.isnan(line)).any()]
        return float(abs(lines[0] - lines[-1])) if len(lines) > 1 else None

    return {"valid_grid_cells": int(ok.sum()), "relative_luminance_range": float((x.max() - x.min()) / (x.mean() + 1e-6)), "spatial_luminance_cv": float(x.std() / (x.mean() + 1e-6)), "left_right_difference": ends(0), "top_bottom_difference": ends(1)}


def border_touch(mask: np.ndarray) -> dict[str, float | None]:
    m = mask > 0
    if not m.any():
        return dict.fromkeys(("left_touch_ratio", "right_touch_ratio", "top_touch_ratio", "bottom_touch_ratio", "border_touch_ratio"))
    sides = {"left": m[:, 0], "right": m[:, -1], "top": m[0], "bottom": m[-1]}
    return {f"{k}_touch_ratio": float(v.mean()) for k, v in sides.items()} | {"border_touch_ratio": float(sum(v.sum() for v in sides.values()) / (2 * sum(m.shape)))}


def components(mask: np.ndarray, eight: bool = True) -> np.ndarray:
    """Labels from 1 of connected parts: runs of rows, joined where they touch."""
    m = np.pad(mask > 0, ((0, 0), (1, 1))).astype(np.int8)
    d = np.diff(m, axis=1)
    row, start = np.nonzero(d == 1)
    _, end = np.nonzero(d == -1)
    parent = np.arange(len(row))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(mask.shape[0] + 1))
    reach = 1 if eight else 0
    for r in range(1, mask.shape[0]):
        i, j = first[r - 1], first[r]
        while i < first[r] and j < first[r + 1]:
            if start[i] < end[j] + reach and start[j] < end[i] + reach:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    roots = np.array([find(i) for i in range(len(row))], np.int64)
    names = np.unique(roots, return_inverse=True)[1] + 1 if len(roots) else roots
    out = np.zeros(mask.shape, np.int32)
    for r, s, e, k in zip(row.tolist(), start.tolist(), end.tolist(), np.asarray(names).tolist(), strict=True):
        out[r, s:e] = k
    return out


def largest_component(mask: np.ndarray, eight: bool = True) -> np.ndarray:
    parts = components(mask, eight)
    return (parts == np.bincount(parts[parts > 0]).argmax()).astype(np.uint8) if parts.any() else parts.astype(np.uint8)


def bounding_box(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """(x0, y0, x1, y1), the end excluded."""
    y, x = np.nonzero(mask > 0)
    return (int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1) if len(x) else None


def geometry(mask: np.ndarray) -> dict[str, float | None]:
    box = bounding_box(mask)
    parts = components(mask)
    sizes = np.bincount(parts[parts > 0]) if box else np.zeros(1)
    m = np.pad(mask > 0, 1)
    edge = float((m[1:] != m[:-1]).sum() + (m[:, 1:] != m[:, :-1]).sum())
    area = float((mask > 0).sum())
    return {
        "foreground_ratio": area / max(mask.size, 1), "component_count": int((sizes > 0).sum()), "largest_component_ratio": float(sizes.max() / area) if box else None,
        "bbox_width_ratio": (box[2] - box[0]) / mask.shape[1] if box else None, "bbox_height_ratio": (box[3] - box[1]) / mask.shape[0] if box else None,
        "extent": area / ((box[2] - box[0]) * (box[3] - box[1])) if box else None, "compactness": 4 * np.pi * area / (edge * edge) if box else None,
    }


def to_lab(rgb: np.ndarray) -> np.ndarray:
    """CIE L*a*b* under D65."""
    c = rgb.astype(np.float64) / 255
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    xyz = c @ np.array([[0.4124564, 0.2126729, 0.0193339], [0.3575761, 0.7151522, 0.1191920], [0.1804375, 0.0721750, 0.9503041]]) / np.array([0.95047, 1.0, 1.08883])
    f = np.where(xyz > (6 / 29) ** 3, np.cbrt(xyz), xyz / (3 * (6 / 29) ** 2) + 4 / 29)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def to_hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue in degrees, saturation and value in 0 to 1."""
    c = rgb.astype(np.float64) / 255
    top, low = c.max(axis=-1), c.min(axis=-1)
    d = top - low
    safe = np.where(d == 0, 1, d)
    r, g, b = c[..., 0], c[..., 1], c[..., 2]
    hue = np.where(top == r, ((g - b) / safe) % 6, np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4)) * 60
    return np.stack([np.where(d == 0, 0, hue), np.where(top == 0, 0, d / np.where(top == 0, 1, top)), top], axis=-1)


def color_cast(rgb: np.ndarray, mask: np.ndarray | None = None, most_chroma: float = 18.0, least_share: float = 0.02) -> dict[str, float | None]:
    """The mean a*, b* of nearly neutral pixels outside the subject; nothing where they are too few."""
    lab = to_lab(rgb)
    chroma = np.hypot(lab[..., 1], lab[..., 2])
    neutral = (chroma <= most_chroma) & (lab[..., 0] > 15) & (lab[..., 0] < 97)
    if mask is not None:
        neutral &= mask == 0
    share = float(neutral.mean())
    if share < least_share:
        return {"neutral_share": share, "cast_a": None, "cast_b": None, "cast_magnitude": None}
    a, b = float(lab[neutral, 1].mean()), float(lab[neutral, 2].mean())
    return {"neutral_share": share, "cast_a": a, "cast_b": b, "cast_magnitude": float(np.hypot(a, b))}


def holes(mask: np.ndarray) -> np.ndarray:
    """What is not the subject and does not reach the border."""
    outside = components(mask == 0, eight=False)
    at_border = np.unique(np.concatenate([outside[0], outside[-1], outside[:, 0], outside[:, -1]]))
    return (outside > 0) & ~np.isin(outside, at_border)


def occlusion(rgb: np.ndarray, mask: np.ndarray, hole_weight: float = 0.65, bright_weight: float = 0.35) -> dict[str, float | None]:
    """Holes within the subject and glaring pixels on it, as shares of it, and both weighed together."""
    m = mask > 0
    if not m.any():
        return {"hole_ratio": None, "bright_ratio": None, "occlusion_score": None}
    filled = m | holes(mask)
    hole, bright = float((filled & ~m).sum() / filled.sum()), float((luminance(rgb)[m] >= HIGHLIGHT).mean())
    return {"hole_ratio": hole, "bright_ratio": bright, "occlusion_score": hole_weight * hole + bright_weight * bright}


def difference_hash(rgb: np.ndarray) -> str:
    """16 hex digits: whether each of 8 x 8 cells is brighter than its left neighbour."""
    g = area_resize(luminance(rgb), 8, 9)
    return np.packbits((g[:, 1:] > g[:, :-1]).reshape(-1)).tobytes().hex()


def letterboxed(picture: np.ndarray, height: int, width: int, fill: int = 0) -> tuple[np.ndarray, tuple[int, int, int, int]]:
    """A picture in a frame by nearest pixels, and where it is: (top, left, height, width)."""
    h, w = picture.shape[:2]
    scale = min(width / w, height / h)
    nh, nw = max(1, round(h * scale)), max(1, round(w * scale))
    top, left = (height - nh) // 2, (width - nw) // 2
    out = np.full((height, width, *picture.shape[2:]), fill, picture.dtype)
    out[top : top + nh, left : left + nw] = picture[(np.arange(nh) * h // nh)[:, None], np.arange(nw) * w // nw]
    return out, (top, left, nh, nw)


def unletterboxed(probability: np.ndarray, place: tuple[int, int, int, int], height: int, width: int, threshold: float = 0.5) -> np.ndarray:
    """A mask of the first size from probabilities in the frame: the frame is cut off, then sizes change, then the threshold acts."""
    top, left, nh, nw = place
    inner = probability[top : top + nh, left : left + nw]
    return (area_resize(inner, height, width) >= threshold).astype(np.uint8)


def channel_cast(rgb: np.ndarray, gains: tuple[float, float, float]) -> np.ndarray:
    return np.clip(np.rint(rgb.astype(np.float64) * gains), 0, 255).astype(np.uint8)


def styled(rgb: np.ndarray, gamma: float = 1.0, exposure_: float = 1.0, contrast: float = 1.0) -> np.ndarray:
    v = (rgb.astype(np.float64) / 255) ** gamma * exposure_
    return np.clip(np.rint(((v - 0.5) * contrast + 0.5) * 255), 0, 255).astype(np.uint8)


def masked_fill(rgb: np.ndarray, mask: np.ndarray, fill: int = 0) -> np.ndarray:
    return np.where((mask > 0)[..., None], rgb, np.uint8(fill))


def padding_ratio(rgb: np.ndarray, most: int = 2) -> float:
    """The share of pixels that are black, as a frame is."""
    return float((rgb.max(axis=-1) <= most).mean())


def patch_heterogeneity(rgb: np.ndarray, cells: int = 4) -> dict[str, float]:
    """Variance of L*, a*, b* between patches, and how much the middle differs from the rest."""
    lab = to_lab(rgb)
    mean = np.stack([area_resize(lab[..., i], cells, cells) for i in range(3)], axis=-1)
    inner = mean[1:-1, 1:-1].reshape(-1, 3).mean(axis=0)
    rest = (mean.reshape(-1, 3).sum(axis=0) - mean[1:-1, 1:-1].reshape(-1, 3).sum(axis=0)) / max(cells * cells - (cells - 2) ** 2, 1)
    return {"patch_lab_variance": float(mean.reshape(-1, 3).var(axis=0).sum()), "center_edge_distance": float(np.linalg.norm(inner - rest))}


def header_size(content: bytes) -> tuple[str, int, int]:
    """(format, width, height) from the first bytes of a PNG, GIF, BMP or JPEG; anything else is an error."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return ("png", *struct.unpack(">II", content[16:24]))
    if content[:4] == b"GIF8":
        return ("gif", *struct.unpack("<HH", content[6:10]))
    if content[:2] == b"BM":
        w, h = struct.unpack("<ii", content[18:26])
        return "bmp", w, abs(h)
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(content):
            if content[at] != 0xFF:
                raise ValueError("a broken JPEG")
            kind, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", content[at + 5 : at + 9])
                return "jpeg", w, h
            at += 2 + size
    raise ValueError("not a picture of a known format")


FEATURES: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "focus": (focus, ("blur_score", "gradient_energy")),
    "exposure": (exposure, ("mean_luminance", "luminance_std", "luminance_p01", "luminance_p05", "luminance_p50", "luminance_p95", "luminance_p99", "dark_pixel_ratio", "bright_pixel_ratio", "shadow_clip_ratio", "highlight_clip_ratio")),
    "illumination": (illumination, ("valid_grid_cells", "relative_luminance_range", "spatial_luminance_cv", "left_right_difference", "top_bottom_difference")),
    "cast": (color_cast, ("neutral_share", "cast_a", "cast_b", "cast_magnitude")),
    "occlusion": (occlusion, ("hole_ratio", "bright_ratio", "occlusion_score")),
}


def features(pictures: DataFrame, kinds: tuple[str, ...] = tuple(FEATURES), key: str = "sample_id") -> DataFrame:
    """(key, features, error) of pictures(key, width, height, pixels, mask): a broken row has an error and no features."""
    names = [n for k in kinds for n in FEATURES[k][1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in (key, *names, "error")}
            for r in batch.to_pylist():
                found: dict = {}
                try:
                    rgb = np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], 3)
                    mask = np.frombuffer(r["mask"], np.uint8).reshape(rgb.shape[:2]) if r["mask"] is not None else np.ones(rgb.shape[:2], np.uint8)
                    for k in kinds:
                        found |= FEATURES[k][0](rgb, mask)
                    error = None
                except (TypeError, ValueError) as e:
                    error = str(e)
                rows[key].append(r[key])
                rows["error"].append(error)
                for n in names:
                    rows[n].append(found.get(n) if error is None else None)
            yield pa.RecordBatch.from_arrays([pa.array(rows[key], pa.string()), *[pa.array(rows[n], pa.float64()) for n in names], pa.array(rows["error"], pa.string())], names=[key, *names, "error"])

    schema = T.StructType([T.StructField(key, T.StringType()), *[T.StructField(n, T.DoubleType()) for n in names], T.StructField("error", T.StringType())])
    return pictures.select(F.col(key).cast("string").alias(key), "width", "height", "pixels", "mask").mapInArrow(run, schema)


def inspected(files: DataFrame) -> DataFrame:
    """(path, length, md5, format, width, height, error) of binary files; nothing raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for content in batch.column("content").to_pylist():
                try:
                    found = (*header_size(content or b""), None)
                except (ValueError, struct.error) as e:
                    found = (None, None, None, str(e))
                for to, v in zip(out, found, strict=True):
                    to.append(v)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), batch.column("md5"), *[pa.array(x, t) for x, t in zip(out, kinds, strict=True)]], names=["path", "length", "md5", "format", "width", "height", "error"])

    return files.select("path", "length", F.md5("content").alias("md5"), "content").mapInArrow(run, "path string, length long, md5 string, format string, width int, height int, error string")
