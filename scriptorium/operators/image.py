"""Page images as numpy arrays inside Arrow batches: gray values, thresholds, quality, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def gray(rgb: np.ndarray) -> np.ndarray:
    return rgb if rgb.ndim == 2 else np.rint(rgb[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def otsu_level(page: np.ndarray) -> int:
    n = np.bincount(page.ravel(), minlength=256).astype(float)
    w, s = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(all="ignore"):
        between = (s[-1] * w / w[-1] - s) ** 2 / (w * (w[-1] - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def box_mean(x: np.ndarray, size: int) -> np.ndarray:
    half = size // 2
    p = np.pad(x.astype(float), ((half + 1, half), (half + 1, half)), "edge").cumsum(0).cumsum(1)
    return (p[size:, size:] - p[:-size, size:] - p[size:, :-size] + p[:-size, :-size]) / size**2


def sauvola(page: np.ndarray, size: int = 31, k: float = 0.2, spread: float = 0.5) -> np.ndarray:
    x = page / 255.0
    mean = box_mean(x, size)
    deviation = np.sqrt(np.maximum(box_mean(x * x, size) - mean**2, 0))
    return np.where(x > mean * (1 + k * (deviation / spread - 1)), 255, 0).astype(np.uint8)


def sharpness(page: np.ndarray) -> float:
    """Variance of the Laplacian times the bonus for a likely share of dark pixels."""
    x = np.pad(page.astype(float), 1, "reflect")
    laplacian = x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]
    dark = float((page < 128).mean())
    return float(laplacian.var()) * (1.0 if 0.03 <= dark <= 0.25 else max(1 - 3 * abs(dark - 0.12), 0.05))


def ink_share(page: np.ndarray) -> float:
    return float((page <= otsu_level(page)).mean())


def components(ink: np.ndarray) -> np.ndarray:
    """Labels of 8-connected ink, by spreading the smallest place of each neighbourhood."""
    labels = np.where(ink, np.arange(1, ink.size + 1).reshape(ink.shape), 0)
    while True:
        p = np.pad(np.where(ink, labels, ink.size + 1), 1, constant_values=ink.size + 1)
        near = np.min([p[i : i + ink.shape[0], j : j + ink.shape[1]] for i in range(3) for j in range(3)], axis=0)
        after = np.where(ink, near, 0)
        if (after == labels).all():
            return labels
        labels = after


def measures(page: np.ndarray) -> dict[str, float]:
    """Connectivity and box heights of a page's ink."""
    ink = page <= otsu_level(page)
    labels = components(ink)
    found, area = np.unique(labels[labels > 0], return_counts=True)
    heights = []
    for label in found:
        rows, cols = np.nonzero(labels == label)
        h, w = np.ptp(rows) + 1, np.ptp(cols) + 1
        if 0.005 * page.shape[0] < h < 0.2 * page.shape[0] and w > 3:
            heights.append(h)
    spread = min(float(np.std(heights) / np.mean(heights)), 1.0) if len(heights) >= 5 else 0.5
    return {"connectivity": float(area.mean() / page.size) if len(area) else 0.0, "height_variance": spread, "ink": float(ink.mean())}


def red_margin_cut(rgb: np.ndarray, share: float = 0.04, extra: int = 12) -> np.ndarray:
    """The page with everything left of its red margin line white."""
    r, g, b = (rgb[..., i].astype(int) for i in range(3))
    red = (r > 100) & (r - np.maximum(g, b) > 50)
    cols = np.flatnonzero(red.sum(0) > share * rgb.shape[0])
    out = rgb.copy()
    if len(cols):
        out[:, : cols.max() + extra] = 255
    return out


def page_measures(pages: DataFrame) -> DataFrame:
    """(doc_id, page_idx, h, w, data) gray pages -> their measures, a row a page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                page = np.frombuffer(r.data, np.uint8).reshape(r.h, r.w)
                rows.append({"doc_id": r.doc_id, "page_idx": r.page_idx, "sharpness": sharpness(page), **measures(page)})
            yield pd.DataFrame(rows, columns=["doc_id", "page_idx", "sharpness", "connectivity", "height_variance", "ink"])

    return pages.mapInPandas(run, "doc_id long, page_idx int, sharpness double, connectivity double, height_variance double, ink double")
