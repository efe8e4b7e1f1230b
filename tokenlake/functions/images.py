"""Numpy kernels on stacks of images, uint8[n, height, width, 3], RGB.

All of them work on a whole Arrow batch of images at once, as matrix products or reshapes.
Resampling is separable: weight matrices per axis, rounded half up to bytes after each axis.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Quantiser steps of the 8 x 8 transform, by zig-zag position.
LUMA_STEPS = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)

#: Rows of the RGB -> YCbCr matrix, and of the matrix back.
TO_YCBCR = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
TO_RGB = np.array([[1.0, 0.0, 1.402], [1.0, -0.344136, -0.714136], [1.0, 1.772, 0.0]])


def half_away(x: np.ndarray) -> np.ndarray:
    """Round halves away from zero."""
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


@lru_cache(maxsize=16)
def dct_basis(n: int) -> np.ndarray:
    """Rows are the orthonormal cosines of the DCT-II of n points."""
    k, x = np.mgrid[:n, :n]
    scale = np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))
    return scale * np.cos(np.pi * k * (2 * x + 1) / (2 * n))


@lru_cache(maxsize=16)
def zigzag(n: int) -> np.ndarray:
    """Raster index of each zig-zag position: by anti-diagonal, even ones upwards."""
    y, x = np.divmod(np.arange(n * n), n)
    return np.lexsort((np.where((x + y) % 2, y, x), x + y))


KERNELS = {
    "triangle": (1.0, lambda x: np.maximum(0, 1 - np.abs(x))),
    "box": (0.5, lambda x: ((x > -0.5) & (x <= 0.5)).astype(float)),
    "cubic": (2.0, lambda x: np.where(np.abs(x) < 1, (1.5 * np.abs(x) - 2.5) * x * x + 1, np.where(np.abs(x) < 2, ((-0.5 * np.abs(x) + 2.5) * np.abs(x) - 4) * np.abs(x) + 2, 0))),
    "lanczos": (3.0, lambda x: np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)),
}


@lru_cache(maxsize=128)
def weights(n_in: int, n_out: int, kernel: str = "triangle") -> np.ndarray:
    """n_out x n_in; when shrinking, the kernel is stretched so that every input counts."""
    support, f = KERNELS[kernel]
    scale = n_in / n_out
    stretch = max(1.0, scale)
    centre = (np.arange(n_out)[:, None] + 0.5) * scale
    w = f((np.arange(n_in)[None, :] + 0.5 - centre) / stretch) * (np.abs(np.arange(n_in)[None, :] + 0.5 - centre) <= support * stretch)
    return w


#: Weights up to which rows are taken as they lie in memory, by one matrix for all channels.
NARROW = 4096


@lru_cache(maxsize=128)
def _spread(n_in: int, n_out: int, kernel: str, channels: int) -> np.ndarray:
    return np.kron(weights(n_in, n_out, kernel).T, np.eye(channels))


def _rows(x: np.ndarray, width: int, kernel: str) -> np.ndarray:
    n, h, w, c = x.shape
    if w * width <= NARROW:
        out = (x.reshape(n * h, w * c).astype(float) @ _spread(w, width, kernel, c)).reshape(n, h, width, c)
    else:
        out = weights(w, width, kernel) @ x.astype(float)
    return out / weights(w, width, kernel).sum(1)[:, None]


def _columns(x: np.ndarray, height: int, kernel: str) -> np.ndarray:
    n, h, w, c = x.shape
    out = (weights(h, height, kernel) @ x.reshape(n, h, w * c).astype(float)).reshape(n, height, w, c)
    return out / weights(h, height, kernel).sum(1)[:, None, None]


def resize(images: np.ndarray, height: int, width: int, kernel: str = "triangle") -> np.ndarray:
    """Resample, rows' pixels first, then columns; sums are rounded to nine decimals before halves are rounded up, so their order is no matter."""
    out = images
    if images.shape[2] != width:
        out = np.clip(np.floor(np.round(_rows(out, width, kernel), 9) + 0.5), 0, 255)
    if images.shape[1] != height:
        out = np.clip(np.floor(np.round(_columns(out, height, kernel), 9) + 0.5), 0, 255)
    return out.astype(np.uint8)


def resize_crop(images: np.ndarray, size: int, kernel: str = "triangle") -> np.ndarray:
    """The short side becomes size, then the middle square is cut out."""
    h, w = images.shape[1:3]
    short = min(h, w)
    h, w = h * size // short, w * size // short
    out = resize(images, h, w, kernel)
    top, left = (h - size) // 2, (w - size) // 2
    return out[:, top : top + size, left : left + size]


def normalise(images: np.ndarray) -> np.ndarray:
    """Channel-first floats in [-1, 1]."""
    return (images.astype(np.float32).transpose(0, 3, 1, 2) / 255 - 0.5) / 0.5


def denormalise(planes: np.ndarray) -> np.ndarray:
    """Bytes from channel-first floats in [-1, 1]; fractions are cut off."""
    return (np.clip((planes + 1) / 2, 0, 1) * 255).astype(np.uint8).transpose(0, 2, 3, 1)


def to_ycbcr(images: np.ndarray) -> np.ndarray:
    """float[n, h, w, 3] centred on zero."""
    out = images.astype(float) @ TO_YCBCR.T
    out[..., 0] -= 128
    return out


def to_rgb(planes: np.ndarray) -> np.ndarray:
    """Bytes, fractions cut off after rounding to six decimals."""
    shifted = planes + np.array([128.0, 0, 0])
    return np.clip(np.round(shifted @ TO_RGB.T, 6), 0, 255).astype(np.uint8)


def to_blocks(images: np.ndarray, size: int) -> np.ndarray:
    """[n, blocks, size, size, channels], blocks in raster order."""
    n, h, w, c = images.shape
    return images.reshape(n, h // size, size, w // size, size, c).transpose(0, 1, 3, 2, 4, 5).reshape(n, -1, size, size, c)


def from_blocks(blocks: np.ndarray) -> np.ndarray:
    """The square image that blocks were cut from."""
    n, count, size, _, c = blocks.shape
    side = int(count**0.5)
    return blocks.reshape(n, side, side, size, size, c).transpose(0, 1, 3, 2, 4, 5).reshape(n, side * size, side * size, c)


def haar(planes: np.ndarray, levels: int) -> list:
    """[approximation, (h, v, d) coarsest, ..., (h, v, d) finest] of [..., height, width], orthonormal."""
    details = []
    for _ in range(levels):
        a, b, c, d = planes[..., ::2, ::2], planes[..., ::2, 1::2], planes[..., 1::2, ::2], planes[..., 1::2, 1::2]
        details.append(((a + b - c - d) / 2, (a - b + c - d) / 2, (a - b - c + d) / 2))
        planes = (a + b + c + d) / 2
    return [planes, *details[::-1]]


def unhaar(parts: list) -> np.ndarray:
    """Inverse of haar."""
    out = parts[0]
    for h, v, d in parts[1:]:
        up = np.empty((*out.shape[:-2], 2 * out.shape[-2], 2 * out.shape[-1]))
        up[..., ::2, ::2], up[..., ::2, 1::2] = (out + h + v + d) / 2, (out + h - v - d) / 2
        up[..., 1::2, ::2], up[..., 1::2, 1::2] = (out - h + v - d) / 2, (out - h - v + d) / 2
        out = up
    return out


def psnr(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per image, in dB."""
    mse = ((a.astype(float) - b.astype(float)) ** 2).reshape(len(a), -1).mean(1)
    return 10 * np.log10(255.0**2 / (mse + 1e-10))


def noise(n: int, size: int = 256, seed: int = 0) -> np.ndarray:
    """n images of uniform bytes, for speed tests."""
    return np.random.default_rng(seed).integers(0, 256, (n, size, size, 3)).astype(np.uint8)


def gradient(size: int = 256) -> np.ndarray:
    """Red grows over x, green over y, blue is 128."""
    ramp = np.linspace(0, 255, size).astype(np.uint8)
    return np.stack([np.tile(ramp, (size, 1)), np.tile(ramp[:, None], (1, size)), np.full((size, size), 128, np.uint8)], -1)[None]
