"""Image tokenizers and their inverses, over DataFrames of images.

An image row is (img_id, height, width, data): RGB bytes in raster order. A tokenizer turns a stack
of square images into a token matrix and back; `tokenize` and `detokenize` apply it to slices of Arrow
batches, so a task holds one batch and one slice, and tokens are array<int>. Presets are in PRESETS.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.functions import images as im
from tokenlake.functions.batches import PIECE, lists, pieces

SEPARATOR = 65535


def clamp(x: np.ndarray, vocab: int) -> np.ndarray:
    return np.clip(x, 0, vocab - 1).astype(np.int32)


@dataclass(frozen=True)
class Dct:
    """Block DCT, zig-zag, quantised, frequency first, channel by channel.

    Blocks of 8 with luma steps if `steps`, else one step for all frequencies, growing with the block.
    Levels are rounded to six decimals before halves are rounded away from zero, so sums in another order agree.
    """

    size: int = 256
    block: int = 8
    frequencies: int = 64
    bits: int = 10
    luma_only: bool = False
    steps: bool = True
    ycbcr: bool = True
    presize: str = "crop"

    @property
    def vocab(self) -> int:
        return 1 << self.bits

    @property
    def channels(self) -> int:
        return 1 if self.luma_only else 3

    @property
    def tokens_per_image(self) -> int:
        return (self.size // self.block) ** 2 * self.frequencies * self.channels

    def _scale(self) -> np.ndarray:
        if self.steps:
            return np.array(im.LUMA_STEPS[: self.frequencies]) * 0.5
        return np.full(self.frequencies, 16.0 * (self.block / 8) * 1.5)

    def encode(self, images: np.ndarray) -> np.ndarray:
        planes = (im.to_ycbcr(images) if self.ycbcr else images.astype(float) - 128)[..., : self.channels]
        blocks = im.to_blocks(planes, self.block)
        basis = im.dct_basis(self.block)
        c = np.einsum("ky,nbyxc,lx->nbklc", basis, blocks, basis, optimize=True)
        flat = c.reshape(*c.shape[:2], -1, self.channels)[:, :, im.zigzag(self.block)[: self.frequencies]]
        tokens = clamp(im.half_away(np.round(flat / self._scale()[:, None], 6) + self.vocab / 2), self.vocab)
        return tokens.transpose(0, 3, 2, 1).reshape(len(images), -1)

    def decode(self, tokens: np.ndarray) -> np.ndarray:
        count, f = (self.size // self.block) ** 2, self.frequencies
        t = tokens.reshape(len(tokens), self.channels, f, count).transpose(0, 3, 2, 1)
        flat = np.zeros((len(tokens), count, self.block**2, self.channels))
        flat[:, :, im.zigzag(self.block)[:f]] = (t - self.vocab / 2) * self._scale()[:, None]
        basis = im.dct_basis(self.block)
        c = flat.reshape(len(tokens), count, self.block, self.block, self.channels)
        planes = im.from_blocks(np.einsum("ky,nbklc,lx->nbyxc", basis, c, basis, optimize=True))
        if self.luma_only:
            return np.repeat(np.clip(np.round(planes + 128, 6), 0, 255).astype(np.uint8), 3, -1)
        return im.to_rgb(planes) if self.ycbcr else np.clip(np.round(planes + 128, 6), 0, 255).astype(np.uint8)


@dataclass(frozen=True)
class Haar:
    """Haar wavelet with fixed ranges: approximation, then `details` levels, h, v, d interleaved."""

    size: int = 256
    levels: int = 6
    details: int = 1
    bits: int = 10
    presize: str = "lanczos"

    @property
    def vocab(self) -> int:
        return 1 << self.bits

    def _sizes(self) -> list[int]:
        first = self.size >> self.levels
        return [first * first, *(3 * (first << k) ** 2 for k in range(self.details))]

    @property
    def tokens_per_image(self) -> int:
        return 3 * sum(self._sizes())

    def _range(self, k: int) -> tuple[float, float]:
        far = 75.0 * 2**self.levels
        return (-far, far) if k else (0.0, 255.0 * 2**self.levels)

    def encode(self, images: np.ndarray) -> np.ndarray:
        parts = im.haar(images.astype(float).transpose(0, 3, 1, 2), self.levels)
        out = []
        for k, part in enumerate(parts[: self.details + 1]):
            flat = (np.stack(part, -1) if k else part).reshape(len(images), 3, -1)
            lo, hi = self._range(k)
            out.append(clamp((np.clip(flat, lo, hi) - lo) / (hi - lo + 1e-8) * (self.vocab - 1), self.vocab))
        return np.concatenate(out, -1).reshape(len(images), -1)

    def decode(self, tokens: np.ndarray) -> np.ndarray:
        t = tokens.reshape(len(tokens), 3, -1).astype(float)
        parts, at = [], 0
        for k, n in enumerate(self._sizes()):
            lo, hi = self._range(k)
            values = t[..., at : at + n] / (self.vocab - 1) * (hi - lo) + lo
            side = int((n // (3 if k else 1)) ** 0.5)
            parts.append(tuple(np.moveaxis(values.reshape(len(t), 3, side, side, 3), -1, 0)) if k else values.reshape(len(t), 3, side, side))
            at += n
        while parts[-1][0].shape[-1] * 2 < self.size or len(parts) == 1:
            side = (self.size >> self.levels) << (len(parts) - 1)
            parts.append((np.zeros((len(t), 3, side, side)),) * 3)
        return np.clip(np.round(im.unhaar(parts).transpose(0, 2, 3, 1), 6), 0, 255).astype(np.uint8)


@dataclass(frozen=True)
class HaarTopK:
    """Haar wavelet with a range per image and channel; the largest details fill what the approximation leaves.

    The details' places are not part of the tokens, so decoding puts them first: a lossy form by design.
    `ranges` of encode_with_ranges are needed for exact levels; decode uses `usual` without them.
    """

    size: int = 256
    levels: int = 5
    per_channel: int = 85
    bits: int = 10
    presize: str = "lanczos"
    usual: tuple = ((255.0, 0.0), (150.0, -75.0), (150.0, -75.0))

    @property
    def vocab(self) -> int:
        return 1 << self.bits

    @property
    def tokens_per_image(self) -> int:
        return 3 * self.per_channel

    def encode_with_ranges(self, images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, (scale, least) of each image and channel)."""
        first, *rest = im.haar(images.astype(float).transpose(0, 3, 1, 2), self.levels)
        kept = first.reshape(len(images), 3, -1)[..., : self.per_channel]
        more = self.per_channel - kept.shape[-1]
        if more > 0:
            details = np.concatenate([np.stack(x, -1).reshape(len(images), 3, -1) for x in rest], -1)
            # the largest by magnitude, the earlier of equals, in their own order
            chosen = np.sort(np.argsort(-np.abs(details), -1, kind="stable")[..., :more], -1)
            kept = np.concatenate([kept, np.take_along_axis(details, chosen, -1)], -1)
        least = kept.min(-1, keepdims=True)
        scale = kept.max(-1, keepdims=True) - least + 1e-8
        tokens = clamp((kept - least) / scale * (self.vocab - 1), self.vocab)
        if tokens.shape[-1] < self.per_channel:
            tokens = np.pad(tokens, ((0, 0), (0, 0), (0, self.per_channel - tokens.shape[-1])), constant_values=self.vocab // 2)
        return tokens.reshape(len(images), -1), np.concatenate([scale, least], -1)

    def encode(self, images: np.ndarray) -> np.ndarray:
        return self.encode_with_ranges(images)[0]

    def decode(self, tokens: np.ndarray, ranges: np.ndarray | None = None) -> np.ndarray:
        t = tokens.reshape(len(tokens), 3, -1) / (self.vocab - 1)
        ranges = np.tile(np.array(self.usual), (len(tokens), 1, 1)) if ranges is None else ranges
        values = t * ranges[..., :1] + ranges[..., 1:]
        side = self.size >> self.levels
        parts = [values[..., : side * side].reshape(len(t), 3, side, side)]
        rest = values[..., side * side :]
        for k in range(self.levels):
            n, s = 3 * (side << k) ** 2, side << k
            own = np.zeros((len(t), 3, n))
            own[..., : min(n, rest.shape[-1])] = rest[..., :n]
            rest = rest[..., n:]
            parts.append(tuple(np.moveaxis(own.reshape(len(t), 3, s, s, 3), -1, 0)))
        return np.clip(np.round(im.unhaar(parts).transpose(0, 2, 3, 1), 6), 0, 255).astype(np.uint8)


@dataclass(frozen=True)
class Pyramid:
    """Pixels of bilinear reductions, coarse to fine; with `residual`, differences to what the coarser levels give.

    Closed loop: a level is coded against the reconstruction, so only clipping loses anything.
    Open loop: against the enlarged true level.
    """

    sides: tuple = (8, 16)
    residual: bool = False
    closed: bool = True
    output: int = 256
    size: int = 256
    presize: str = "lanczos"
    vocab: int = 256

    @property
    def tokens_per_image(self) -> int:
        return 3 * sum(s * s for s in self.sides)

    def encode(self, images: np.ndarray) -> np.ndarray:
        out, known = [], None
        for side in self.sides:
            level = im.resize(images, side, side).astype(np.int32)
            if self.residual and known is not None:
                up = im.resize(known.astype(np.uint8), side, side).astype(np.int32)
                coded = np.clip(level - up + 128, 0, 255)
                known = np.clip(up + coded - 128, 0, 255) if self.closed else level
            else:
                coded = known = level
            out.append(coded.reshape(len(images), -1))
        return np.concatenate(out, 1)

    def decode(self, tokens: np.ndarray) -> np.ndarray:
        at, known = 0, None
        for side in self.sides:
            n = 3 * side * side
            level = tokens[:, at : at + n].reshape(-1, side, side, 3).astype(np.int32)
            at += n
            if self.residual and known is not None:
                level = np.clip(im.resize(known.astype(np.uint8), side, side).astype(np.int32) + level - 128, 0, 255)
            known = level
        return im.resize(known.astype(np.uint8), self.output, self.output)


@dataclass(frozen=True)
class Color:
    """Mean colour of each block in `levels` steps per channel."""

    size: int = 256
    block: int = 16
    bits: int = 3
    presize: str = "lanczos"

    @property
    def levels(self) -> int:
        return 1 << self.bits

    @property
    def vocab(self) -> int:
        return self.levels**3

    @property
    def tokens_per_image(self) -> int:
        return (self.size // self.block) ** 2

    def encode(self, images: np.ndarray) -> np.ndarray:
        mean = im.to_blocks(images, self.block).mean((2, 3))
        q = clamp(mean * self.levels / 256, self.levels)
        return (q[..., 0] * self.levels + q[..., 1]) * self.levels + q[..., 2]

    def decode(self, tokens: np.ndarray) -> np.ndarray:
        q = np.stack([tokens // self.levels**2, tokens // self.levels % self.levels, tokens % self.levels], -1)
        colour = ((q + 0.5) * 256 / self.levels).astype(np.uint8)
        return im.from_blocks(np.broadcast_to(colour[:, :, None, None], (*colour.shape[:2], self.block, self.block, 3)))


@dataclass(frozen=True)
class Vq:
    """Nearest code of each block, the lowest of equals; the codebook is float[codes, block * block * 3]."""

    codebook: np.ndarray = field(hash=False, compare=False)
    size: int = 256
    presize: str = "lanczos"

    @property
    def block(self) -> int:
        return block_of(self.codebook.shape[1])

    @property
    def vocab(self) -> int:
        return len(self.codebook)

    @property
    def tokens_per_image(self) -> int:
        return (self.size // self.block) ** 2

    def encode(self, images: np.ndarray) -> np.ndarray:
        blocks = im.to_blocks(images, self.block).reshape(-1, self.codebook.shape[1]).astype(float)
        return nearest(blocks, self.codebook).reshape(len(images), -1)

    def decode(self, tokens: np.ndarray) -> np.ndarray:
        b = self.block
        blocks = np.clip(self.codebook[tokens], 0, 255).astype(np.uint8).reshape(*tokens.shape, b, b, 3)
        return im.from_blocks(blocks)


@dataclass(frozen=True)
class HierarchicalVq:
    """One Vq per level, coarse to fine, tokens one after the other; decoding takes the finest."""

    levels: tuple
    presize: str = "lanczos"

    @property
    def size(self) -> int:
        return self.levels[0].size

    @property
    def vocab(self) -> int:
        return max(v.vocab for v in self.levels)

    @property
    def tokens_per_image(self) -> int:
        return sum(v.tokens_per_image for v in self.levels)

    def encode(self, images: np.ndarray) -> np.ndarray:
        return np.concatenate([v.encode(images) for v in self.levels], 1)

    def decode(self, tokens: np.ndarray) -> np.ndarray:
        return self.levels[-1].decode(tokens[:, -self.levels[-1].tokens_per_image :])


def nearest(vectors: np.ndarray, codebook: np.ndarray, step: int = 4096) -> np.ndarray:
    """Index of the nearest code by squared distance, |c|^2 - 2 v.c; the lowest of equals."""
    out = np.empty(len(vectors), np.int32)
    norm = (codebook.astype(float) ** 2).sum(1)
    for k in range(0, len(vectors), step):
        out[k : k + step] = (norm - 2 * vectors[k : k + step] @ codebook.astype(float).T).argmin(1)
    return out


#: The tokenizers by preset name.
PRESETS = {
    "dct": Dct(),
    "dct-tiny": Dct(256, 32, 4, 10, True, False),
    "dct-small": Dct(256, 32, 4, 10, False, False),
    "dct-medium": Dct(256, 16, 4, 10, False, False),
    "dct-large": Dct(256, 8, 16, 10, False, False),
    "haar-tiny": Haar(256, 6, 0),
    "haar-small": Haar(256, 6, 1),
    "haar-medium": Haar(256, 5, 1),
    "haar-large": Haar(256, 4, 2),
    "haar-topk-tiny": HaarTopK(256, 5, 85),
    "haar-topk-small": HaarTopK(256, 4, 256),
    "haar-topk-medium": HaarTopK(256, 3, 1024),
    "haar-topk-large": HaarTopK(256, 2, 4096),
    "pyramid-tiny": Pyramid((4, 8)),
    "pyramid-small": Pyramid((8, 16)),
    "pyramid-medium": Pyramid((8, 16, 32)),
    "pyramid-large": Pyramid((16, 32, 64)),
    "residual-2": Pyramid((8, 16), True),
    "residual-3": Pyramid((8, 16, 32), True),
    "residual-4": Pyramid((8, 16, 32, 64), True),
    "residual-5": Pyramid((8, 16, 32, 64, 128), True),
    "residual-6": Pyramid((4, 8, 16, 32, 64, 128), True),
    "color-tiny": Color(256, 32, 3),
    "color-small": Color(256, 16, 3),
    "color-medium": Color(256, 8, 4),
    "color-large": Color(256, 4, 4),
}
#: Fixed values: (block, codes) of the vector quantisers, and (blocks, codes) of the hierarchical ones.
VQ_SHAPES = {"tiny": (32, 256), "small": (16, 512), "medium": (8, 1024), "large": (4, 2048)}
HVQ_SHAPES = {"tiny": ((32,), (256,)), "small": ((32, 16), (256, 256)), "medium": ((32, 16, 8), (256, 256, 256)), "large": ((16, 8), (512, 512))}


def grid_codebook(codes: int, block: int) -> np.ndarray:
    """Uniform colours on a grid, blue fastest, the first `codes` of them."""
    per = int(round(codes ** (1 / 3) - 0.5 + 1e-9)) + 1
    ramp = np.linspace(0, 255, per)
    colours = np.stack(np.meshgrid(ramp, ramp, ramp, indexing="ij"), -1).reshape(-1, 3)[:codes]
    return np.tile(colours, (1, block * block))


def random_codebook(codes: int, block: int, seed: int = 0) -> np.ndarray:
    """Bytes as good as drawn: the first byte of the MD5 digest of seed, code and place."""
    digest = lambda c, d: hashlib.md5(f"{seed}:{c}:{d}".encode()).digest()[0]
    return np.array([[digest(c, d) for d in range(block * block * 3)] for c in range(codes)], float)


def block_of(dimensions: int) -> int:
    """The first usual block size whose pixels fill a code of so many numbers."""
    return next(b for b in (4, 8, 16, 32) if b * b * 3 == dimensions)


def presized(image: np.ndarray, tokenizer) -> np.ndarray:
    """The image in the tokenizer's size: short side and crop, or both sides stretched."""
    if image.shape[:2] == (tokenizer.size, tokenizer.size):
        return image
    if tokenizer.presize == "crop":
        return im.resize_crop(image[None], tokenizer.size)[0]
    return im.resize(image[None], tokenizer.size, tokenizer.size, tokenizer.presize)[0]


def tokenize(images: DataFrame, tokenizer, on_bad: str = "skip", piece: int = PIECE) -> DataFrame:
    """(img_id, tokens, failed) of images(img_id, height, width, data).

    Rows whose bytes are null or too few are left out (`skip`) or get tokens 128 and failed (`placeholder`).
    Any object with size, presize, tokens_per_image and encode(images) will do, a neural model too.
    piece: bytes of pixels, or eight for each token, that encode gets at a time, one image at least.
    """
    each = max(tokenizer.size**2 * 3, tokenizer.tokens_per_image * 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 3, each, piece):
            good, bad, ids = [], [], batch.column(0).to_pylist()
            for i, (h, w, data) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                if data is None or not h or not w or len(data) != h * w * 3:
                    bad.append(i)
                else:
                    good.append((i, presized(np.frombuffer(data, np.uint8).reshape(h, w, 3), tokenizer)))
            where = [i for i, _ in good] + (bad if on_bad == "placeholder" else [])
            tokens = np.full((len(where), tokenizer.tokens_per_image), 128, np.int32)
            if good:
                tokens[: len(good)] = tokenizer.encode(np.stack([x for _, x in good]))
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in where], pa.int64()), lists(tokens), pa.array([k >= len(good) for k in range(len(where))], pa.bool_())], ["img_id", "tokens", "failed"])

    return images.select("img_id", "height", "width", "data").mapInArrow(run, "img_id long, tokens array<int>, failed boolean")


def detokenize(tokens: DataFrame, tokenizer, piece: int = PIECE) -> DataFrame:
    """(img_id, height, width, data) of tokens(img_id, tokens); rows of another length are left out. piece: as in tokenize."""
    each = getattr(tokenizer, "size", 1) ** 2 * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, each, piece):
            kept = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), tokenizer.tokens_per_image))
            if n := kept.num_rows:
                rows = kept.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                out = tokenizer.decode(rows.astype(np.int64))
                h, w = out.shape[1:3]
                yield pa.RecordBatch.from_arrays([kept.column(0), pa.array([h] * n, pa.int32()), pa.array([w] * n, pa.int32()), pa.array([x.tobytes() for x in out], pa.binary())], ["img_id", "height", "width", "data"])

    return tokens.select(F.col("img_id").cast("long").alias("img_id"), "tokens").mapInArrow(run, "img_id long, height int, width int, data binary")
