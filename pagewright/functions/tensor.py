"""Pictures as the input of a layout detector."""

from __future__ import annotations

import numpy as np

#: Side of the input, and the mean and deviation of each colour (fixed values).
SIDE = 640
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def image_tensor(pixels: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Float32 (1, 3, side, side) of RGB bytes (height, width, 3): stretched with linear interpolation between the centres of
    pixels, scaled to 0..1, and normalized by colour."""
    p = np.asarray(pixels, np.float32)[..., :3]
    h, w = p.shape[:2]
    at = lambda n: np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
    y, x = at(h), at(w)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None].astype(np.float32), (x - x0)[None, :, None].astype(np.float32)
    top = p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx
    low = p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx
    own = ((top * (1 - fy) + low * fy) / 255 - np.array(MEAN, np.float32)) / np.array(DEVIATION, np.float32)
    return own.transpose(2, 0, 1)[None].astype(np.float32)
