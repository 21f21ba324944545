"""Numerics of automatic alignment: edge pyramids, coarse placements by FFT, affine refinement.

A placement is the affine matrix ``H`` that takes pixel centres of the colour frame to those of
the infrared frame, both at full size. Its quality at a pyramid level is the correlation of the infrared
edges with the colour edges under it, over the pixels that the colour frame covers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from framepair.functions.kernels import area_matrix, edge_stack

LEAST_SHARE = 0.15  # of the infrared frame that must be covered
BORDER = 2.0  # pixels at the colour frame's border whose edges come from mirrored content


@dataclass(frozen=True)
class Search:
    """What is searched: scales and shifts relative to the letterbox fit, in shares of the frame, angles in degrees."""

    scales: tuple[float, ...] = tuple(2.0 ** (i / 4) for i in range(-5, 6))
    angles: tuple[float, ...] = (-12.0, -8.0, -4.0, 0.0, 4.0, 8.0, 12.0)
    shift: float = 0.4
    coarsest: int = 40  # long side of the infrared frame at the top of the pyramid
    survivors: int = 8


@dataclass
class Level:
    """One pyramid level: colour and infrared edges and the maps from full-size pixels to its own."""

    rgb: np.ndarray
    ir: np.ndarray
    to_rgb: np.ndarray
    to_ir: np.ndarray
    grey: np.ndarray | None = None  # the colour frame itself, at the finest level
    valid: np.ndarray | None = None  # 1 where the colour edges may be compared


def shrink_map(src_hw: tuple[int, int], dst_hw: tuple[int, int]) -> np.ndarray:
    """Pixel centres of a frame to those of its resized version."""
    ky, kx = dst_hw[0] / src_hw[0], dst_hw[1] / src_hw[1]
    return np.array([[kx, 0, (kx - 1) / 2], [0, ky, (ky - 1) / 2], [0, 0, 1]])


def area(x: np.ndarray, hw: tuple[int, int]) -> np.ndarray:
    if x.shape == hw:
        return x
    return area_matrix(x.shape[0], hw[0]) @ x @ area_matrix(x.shape[1], hw[1]).T


def fit_scale(rgb_hw: tuple[int, int], ir_hw: tuple[int, int]) -> float:
    return min(ir_hw[1] / rgb_hw[1], ir_hw[0] / rgb_hw[0])


def level_sizes(rgb_hw: tuple[int, int], ir_hw: tuple[int, int], coarsest: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Sizes of both frames at every level, the finest first; the colour frame keeps half again the fitted resolution."""
    fit, out, half = fit_scale(rgb_hw, ir_hw), [], 1.0
    while True:
        k = min(1.0, 1.5 * fit * half)
        size = lambda hw, by: tuple(max(2, round(n * by)) for n in hw)
        out.append((size(rgb_hw, k), size(ir_hw, half)))
        if max(out[-1][1]) <= coarsest or min(out[-1][1]) < 16:
            return out
        half /= 2


def pyramid(rgb: np.ndarray, ir: np.ndarray, coarsest: int) -> list[Level]:
    """Levels of two grey frames, the finest first. Coarser edges are means of the finest ones."""
    sizes = level_sizes(rgb.shape, ir.shape, coarsest)
    grey = area(rgb.astype(float), sizes[0][0])
    edges = edges_of(grey), edges_of(ir.astype(float))
    out = [Level(area(edges[0], r), area(edges[1], i), shrink_map(rgb.shape, r), shrink_map(ir.shape, i)) for r, i in sizes]
    out[0].grey = grey
    return out


def edges_of(x: np.ndarray) -> np.ndarray:
    return edge_stack(x[None, :, :, None])[0, :, :, 0]


def about_centres(rgb_hw: tuple[int, int], ir_hw: tuple[int, int], scale: float, angle: float, shift: tuple[float, float]) -> np.ndarray:
    """The placement that turns, scales and shifts the fitted colour frame about the frames' centres."""
    k, a = scale * fit_scale(rgb_hw, ir_hw), np.deg2rad(angle)
    c, s = k * np.cos(a), k * np.sin(a)
    cx, cy = (rgb_hw[1] - 1) / 2, (rgb_hw[0] - 1) / 2
    tx, ty = (ir_hw[1] - 1) / 2 + shift[0], (ir_hw[0] - 1) / 2 + shift[1]
    return np.array([[c, -s, tx - c * cx + s * cy], [s, c, ty - s * cx - c * cy], [0, 0, 1]])


def sampled(stack: np.ndarray, back: np.ndarray, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Bilinear samples of ``stack`` [k, h, w] where ``back`` takes the pixels of an ``h x w`` frame, and which lie inside."""
    v, u = np.mgrid[0:h, 0:w].astype(float)
    x, y = back[0, 0] * u + back[0, 1] * v + back[0, 2], back[1, 0] * u + back[1, 1] * v + back[1, 2]
    sh, sw = stack.shape[1:]
    inside = (x >= BORDER) & (y >= BORDER) & (x <= sw - 1 - BORDER) & (y <= sh - 1 - BORDER)
    x0, y0 = np.clip(np.floor(x), 0, max(0, sw - 2)).astype(int), np.clip(np.floor(y), 0, max(0, sh - 2)).astype(int)
    fx, fy = np.clip(x - x0, 0, 1), np.clip(y - y0, 0, 1)
    flat, at = stack.reshape(len(stack), -1), y0 * sw + x0
    right, down = (1 if sw > 1 else 0), (sw if sh > 1 else 0)
    top = flat[:, at] * (1 - fx) + flat[:, at + right] * fx
    low = flat[:, at + down] * (1 - fx) + flat[:, at + down + right] * fx
    return top * (1 - fy) + low * fy, inside


def agreement(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    size = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / size) if size > 1e-12 else np.nan


def evidence(cc: np.ndarray | float, share: np.ndarray | float) -> np.ndarray | float:
    """Correlations over different shares of the frame made comparable: Fisher's z in units of its deviation."""
    return np.arctanh(np.clip(cc, -0.9999, 0.9999)) * np.sqrt(share)


def coarse_placements(level: Level, rgb_hw, ir_hw, scale: float, angle: float, search: Search, top: int = 3) -> list[tuple[float, np.ndarray]]:
    """The best shifts of one scale and angle, all shifts being tried at once by masked correlation."""
    ih, iw = level.ir.shape
    pad_y, pad_x = int(np.ceil(search.shift * ih)) + 1, int(np.ceil(search.shift * iw)) + 1
    h = level.to_ir @ about_centres(rgb_hw, ir_hw, scale, angle, (0, 0)) @ np.linalg.inv(level.to_rgb)
    to_canvas = np.array([[1, 0, pad_x], [0, 1, pad_y], [0, 0, 1.0]]) @ h
    ch, cw = ih + 2 * pad_y, iw + 2 * pad_x
    warped, inside = sampled(level.rgb[None], np.linalg.inv(to_canvas), ch, cw)
    mask = inside.astype(float)
    c = warped[0] * mask
    spectrum = lambda x: np.fft.rfft2(x, (ch, cw))
    fm, fc, fq = spectrum(mask), spectrum(c), spectrum(c * c)
    one, t, tt = (np.conj(spectrum(x)) for x in (np.ones((ih, iw)), level.ir, level.ir**2))
    at = lambda f: np.fft.irfft2(f, (ch, cw))[: 2 * pad_y + 1, : 2 * pad_x + 1]
    n = np.maximum(np.rint(at(fm * one)), 1)
    sc, sq, st, sq_t, cross = at(fc * one), at(fq * one), at(fm * t), at(fm * tt), at(fc * t)
    spread = (sq - sc * sc / n) * (sq_t - st * st / n)
    share = n / (ih * iw)
    fine = (share >= LEAST_SHARE) & (spread > 1e-9)
    cc = np.where(fine, (cross - sc * st / n) / np.sqrt(np.where(fine, spread, 1.0)), -1.0)
    score = np.where(fine, evidence(cc, share), -np.inf)
    out = []
    for _ in range(top):
        y, x = np.unravel_index(int(score.argmax()), score.shape)
        if not np.isfinite(score[y, x]):
            break
        moved = np.array([[1, 0, pad_x - x], [0, 1, pad_y - y], [0, 0, 1.0]]) @ h
        out.append((float(score[y, x]), np.linalg.inv(level.to_ir) @ moved @ level.to_rgb))
        score[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3] = -np.inf
    return out


def refine(level: Level, placement: np.ndarray, steps: int) -> tuple[float, float, np.ndarray]:
    """Affine Gauss-Newton ascent of the correlation: score, correlation and the best placement met.

    Each step sums the normal equations of the six entries over the covered pixels. A
    placement that covers too little, or whose system is singular, ends the ascent.
    """
    ih, iw = level.ir.shape
    stack = np.stack([level.rgb, np.gradient(level.rgb, axis=1), np.gradient(level.rgb, axis=0), *([] if level.valid is None else [level.valid])])
    h = level.to_ir @ placement @ np.linalg.inv(level.to_rgb)
    best = (-np.inf, np.nan, placement)
    if abs(np.linalg.det(h[:2, :2])) < 1e-9:
        return best
    back = np.linalg.inv(h)
    v, u = np.mgrid[0:ih, 0:iw].astype(float)
    corners = np.array([[0, 0, 1], [iw - 1, 0, 1], [0, ih - 1, 1], [iw - 1, ih - 1, 1]], float).T
    for step in range(steps + 1):
        (warped, gx, gy, *valid), inside = sampled(stack, back, ih, iw)
        if valid:
            inside &= valid[0] > 0.999
        share = inside.mean()
        if share < LEAST_SHARE:
            break
        w, t = warped[inside], level.ir[inside]
        cc = agreement(w, t)
        if not np.isfinite(cc):
            break
        full = np.linalg.inv(level.to_ir) @ np.linalg.inv(back) @ level.to_rgb
        best = max(best, (float(evidence(cc, share)), cc, full), key=lambda b: b[0])
        if step == steps:
            break
        w, t, gx, gy, x, y = w - w.mean(), t - t.mean(), gx[inside], gy[inside], u[inside], v[inside]
        j = np.stack([gx * x, gx * y, gx, gy * x, gy * y, gy])
        j -= j.mean(1, keepdims=True)
        normal = j @ j.T
        normal[np.diag_indices(6)] *= 1 + 1e-6
        try:
            on_w, on_t = np.linalg.solve(normal, np.stack([j @ w, j @ t], 1)).T
        except np.linalg.LinAlgError:
            break
        low = t @ w - (j @ t) @ on_w
        gain = (w @ w - (j @ w) @ on_w) / low if low > 0 else (t @ w) / (t @ t)
        move = (gain * on_t - on_w).reshape(2, 3)
        far = np.abs(move @ corners).max()
        if not np.isfinite(far):
            break
        # No step beyond what the local gradients can tell.
        back[:2] += move * min(1.0, 4.0 / far) if far > 0 else move
        if far < 0.01 or abs(np.linalg.det(back[:2, :2])) < 1e-9:
            break
    return best


def polish(level: Level, placement: np.ndarray, rounds: int = 3, steps: int = 15) -> tuple[float, float, np.ndarray]:
    """``refine`` with edges taken after warping, so that both frames' edges are equally wide whatever the scale."""
    ih, iw = level.ir.shape
    best = (-np.inf, np.nan, placement)
    for _ in range(rounds):
        h = level.to_ir @ placement @ np.linalg.inv(level.to_rgb)
        (warped,), inside = sampled(level.grey[None], np.linalg.inv(h), ih, iw)
        # The smoothing and the gradient reach three pixels.
        shut = np.pad(~inside, 3, constant_values=True)
        near = np.lib.stride_tricks.sliding_window_view(shut, (7, 7)).any((2, 3))
        eye = np.eye(3)
        score, cc, move = refine(Level(edges_of(warped), level.ir, eye, eye, valid=(~near).astype(float)), eye, steps)
        if not np.isfinite(score):
            break
        placement = np.linalg.inv(level.to_ir) @ move @ level.to_ir @ placement
        best = (score, cc, placement)
        if np.abs(move - eye)[:2].max() < 1e-4:
            break
    return best


def on_the_edge(placement: np.ndarray, rgb_hw, ir_hw, search: Search) -> bool:
    """Whether a placement lies outside what was searched or on its border, so that a better one may lie beyond."""
    a = placement[:2, :2] / fit_scale(rgb_hw, ir_hw)
    det = np.linalg.det(a)
    if det <= 0:
        return True
    scale, angle = np.sqrt(det), np.rad2deg(np.arctan2(a[1, 0] - a[0, 1], a[0, 0] + a[1, 1]))
    centre = placement @ np.array([(rgb_hw[1] - 1) / 2, (rgb_hw[0] - 1) / 2, 1])
    off = np.abs(centre[:2] - np.array([(ir_hw[1] - 1) / 2, (ir_hw[0] - 1) / 2])) / np.array([ir_hw[1], ir_hw[0]])
    # Singular values far apart: no rigid pair of cameras gives such a frame.
    stretched = np.linalg.svd(a, compute_uv=False)
    return bool(
        not min(search.scales) < scale < max(search.scales) or not min(search.angles) < angle < max(search.angles)
        or (off >= search.shift).any() or stretched[0] > 1.5 * stretched[1]
    )
