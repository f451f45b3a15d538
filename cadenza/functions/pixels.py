"""Geometry as column arithmetic, and pixel kernels on RGBA frames with numpy, a batch at a time."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CapabilityError, InputError
from ..model import half_up
from ..session import prepare

# ---- planning


def resize_plan(width: Column, height: Column, to_width: int, to_height: int, fit: str = "fill") -> Column:
    """Source and destination rectangles of a resize: struct(sx, sy, sw, sh, dx, dy, dw, dh)."""
    if to_width < 1 or to_height < 1:
        raise InputError.bad("resize needs a positive size")
    zero, w, h = F.lit(0).cast("bigint"), width.cast("bigint"), height.cast("bigint")
    full = lambda x: F.lit(x).cast("bigint")
    rect = lambda *v: F.struct(*[x.cast("bigint").alias(n) for n, x in zip(("sx", "sy", "sw", "sh", "dx", "dy", "dw", "dh"), v, strict=True)])
    if fit == "fill":
        return rect(zero, zero, w, h, zero, zero, full(to_width), full(to_height))
    if fit == "contain":
        scale = F.least(to_width / w, to_height / h)
        dw, dh = F.greatest(F.lit(1), half_up(w * scale)), F.greatest(F.lit(1), half_up(h * scale))
        return rect(zero, zero, w, h, F.floor((to_width - dw) / 2), F.floor((to_height - dh) / 2), dw, dh)
    if fit == "cover":
        scale = F.greatest(to_width / w, to_height / h)
        sw, sh = F.least(w, F.greatest(F.lit(1), half_up(to_width / scale))), F.least(h, F.greatest(F.lit(1), half_up(to_height / scale)))
        return rect(F.floor((w - sw) / 2), F.floor((h - sh) / 2), sw, sh, zero, zero, full(to_width), full(to_height))
    raise InputError.bad(f"unknown fit {fit!r}")


def crop_fits(width: Column, height: Column, x: int, y: int, w: int, h: int) -> Column:
    """Whether a crop rectangle is not empty and lies inside the frame."""
    return F.lit(x >= 0 and y >= 0 and w >= 1 and h >= 1) & (width >= x + w) & (height >= y + h)


def rotated_size(width: Column, height: Column, degrees: int) -> tuple[Column, Column]:
    if degrees not in (0, 90, 180, 270):
        raise InputError.bad("rotation must be 0, 90, 180 or 270")
    return (height, width) if degrees in (90, 270) else (width, height)


# ---- kernels on h x w x 4 arrays


def crop(image: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    if x < 0 or y < 0 or w < 1 or h < 1 or y + h > image.shape[0] or x + w > image.shape[1]:
        raise InputError.bad("crop lies outside the frame")
    return image[y : y + h, x : x + w]


def _bilinear(image: np.ndarray, h: int, w: int) -> np.ndarray:
    def axis(n: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(to) + 0.5) * (n / to) - 0.5, 0, n - 1)
        low = np.floor(at).astype(np.int64)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, ty = axis(image.shape[0], h)
    x0, x1, tx = axis(image.shape[1], w)
    src = image.astype(np.float64)
    tx, ty = tx[None, :, None], ty[:, None, None]
    row = lambda y: src[y][:, x0] + (src[y][:, x1] - src[y][:, x0]) * tx
    top, bottom = row(y0), row(y1)
    return np.floor(top + (bottom - top) * ty + 0.5).astype(np.uint8)


def resize(image: np.ndarray, w: int, h: int, fit: str = "fill") -> np.ndarray:
    """Bilinear between pixel centres, edges clamped; equal sizes copy; `contain` leaves bars transparent black."""
    ih, iw = image.shape[:2]
    r = lambda v: math.floor(v + 0.5)
    if fit == "cover":
        scale = max(w / iw, h / ih)
        sw, sh = min(iw, max(1, r(w / scale))), min(ih, max(1, r(h / scale)))
        image = image[(ih - sh) // 2 : (ih - sh) // 2 + sh, (iw - sw) // 2 : (iw - sw) // 2 + sw]
    dw, dh = (w, h)
    if fit == "contain":
        scale = min(w / iw, h / ih)
        dw, dh = max(1, r(iw * scale)), max(1, r(ih * scale))
    drawn = image if image.shape[:2] == (dh, dw) else _bilinear(image, dh, dw)
    if (dw, dh) == (w, h):
        return drawn
    out = np.zeros((h, w, 4), np.uint8)
    x, y = (w - dw) // 2, (h - dh) // 2
    out[y : y + dh, x : x + dw] = drawn
    return out


def rotate(image: np.ndarray, degrees: int) -> np.ndarray:
    if degrees not in (0, 90, 180, 270):
        raise InputError.bad("rotation must be 0, 90, 180 or 270")
    return np.rot90(image, -degrees // 90)


def flip(image: np.ndarray, axis: str) -> np.ndarray:
    if axis not in ("horizontal", "vertical"):
        raise InputError.bad("flip must be horizontal or vertical")
    return image[:, ::-1] if axis == "horizontal" else image[::-1]


# ---- colour

#: Xy chromaticities of red, green and blue; white is D65 for all.
PRIMARIES = {
    "srgb": ((0.64, 0.33), (0.3, 0.6), (0.15, 0.06)),
    "bt709": ((0.64, 0.33), (0.3, 0.6), (0.15, 0.06)),
    "bt601": ((0.63, 0.34), (0.31, 0.595), (0.155, 0.07)),
    "bt2020": ((0.708, 0.292), (0.17, 0.797), (0.131, 0.046)),
}
D65 = (0.3127, 0.329)
#: Spellings of a colour space once blanks, dots, underscores and hyphens are gone.
SPELLINGS = {
    "srgb": "srgb", "iec6196621": "srgb", "bt709": "bt709", "rec709": "bt709", "709": "bt709", "bt601": "bt601", "rec601": "bt601", "601": "bt601",
    "smpte170m": "bt601", "smptec": "bt601", "bt470bg": "bt601", "bt2020": "bt2020", "rec2020": "bt2020", "2020": "bt2020", "bt2020ncl": "bt2020",
}
#: BT.709, SMPTE ST 2084 and ARIB STD-B67 constants.
BT709_A, BT709_B = 1.09929682680944, 0.018053968510807
PQ_M1, PQ_M2, PQ_C1, PQ_C2, PQ_C3 = 2610 / 16384, 2523 / 4096 * 128, 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32
HLG_A = 0.17883277
HLG_B, HLG_C = 1 - 4 * HLG_A, 0.5 - HLG_A * math.log(4 * HLG_A)
#: Light of code value 1, with SDR white as 1.
PEAK = {"pq": 100.0, "hlg": 12.0}


def parse_colorspace(token: str) -> str | None:
    return SPELLINGS.get(re.sub(r"[\s._-]", "", token.lower()))


#: Names of transfers in a stream's colour description; any other is BT.709.
TRANSFERS = {"bt709": "bt709", "smpte170m": "bt709", "iec61966-2-1": "srgb", "pq": "pq", "hlg": "hlg", "linear": "linear"}


def source_color(primaries: str | None, transfer: str | None) -> tuple[str, str]:
    """Primaries and transfer of a source as its stream names them; what is unknown or missing is BT.709."""
    return (parse_colorspace(primaries) if primaries else None) or "bt709", TRANSFERS.get(transfer or "", "bt709")


def rgb_to_xyz(space: str) -> np.ndarray:
    xyz = lambda p: np.array([p[0] / p[1], 1, (1 - p[0] - p[1]) / p[1]])
    m = np.stack([xyz(p) for p in PRIMARIES[space]], 1)
    return m * np.linalg.solve(m, xyz(D65))


def gamut(source: str, target: str) -> np.ndarray:
    if PRIMARIES[source] == PRIMARIES[target]:
        return np.eye(3)
    return np.linalg.inv(rgb_to_xyz(target)) @ rgb_to_xyz(source)


def to_linear(transfer: str, x: np.ndarray) -> np.ndarray:
    if transfer == "linear":
        return x
    if transfer == "srgb":
        return np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)
    if transfer == "bt709":
        return np.where(x < 4.5 * BT709_B, x / 4.5, ((x + (BT709_A - 1)) / BT709_A) ** (1 / 0.45))
    if transfer == "pq":
        e = np.clip(x, 0, 1) ** (1 / PQ_M2)
        return (np.maximum(e - PQ_C1, 0) / (PQ_C2 - PQ_C3 * e)) ** (1 / PQ_M1) * PEAK["pq"]
    if transfer == "hlg":
        return np.where(x <= 0.5, x * x / 3, (np.exp((x - HLG_C) / HLG_A) + HLG_B) / 12) * PEAK["hlg"]
    raise InputError.bad(f"unknown transfer {transfer!r}")


def from_linear(transfer: str, x: np.ndarray) -> np.ndarray:
    if transfer == "linear":
        return x
    with np.errstate(invalid="ignore", divide="ignore"):
        if transfer == "srgb":
            return np.where(x <= 0.0031308, 12.92 * x, 1.055 * x ** (1 / 2.4) - 0.055)
        if transfer == "bt709":
            return np.where(x < BT709_B, 4.5 * x, BT709_A * x**0.45 - (BT709_A - 1))
        if transfer == "pq":
            y = np.clip(x / PEAK["pq"], 0, 1) ** PQ_M1
            return ((PQ_C1 + PQ_C2 * y) / (1 + PQ_C3 * y)) ** PQ_M2
        if transfer == "hlg":
            y = np.clip(x / PEAK["hlg"], 0, 1)
            return np.where(y <= 1 / 12, np.sqrt(3 * y), HLG_A * np.log(np.maximum(12 * y - HLG_B, 1e-300)) + HLG_C)
    raise InputError.bad(f"unknown transfer {transfer!r}")


def reinhard(light: np.ndarray, peak: float) -> np.ndarray:
    f = lambda x: x * (1 + x / peak**2) / (1 + x)
    return f(light) / f(peak)


def hable(light: np.ndarray, peak: float) -> np.ndarray:
    a, b, c, d, e, f_ = 0.15, 0.5, 0.1, 0.2, 0.02, 0.3
    f = lambda x: (x * (a * x + c * b) + d * e) / (x * (a * x + b) + d * f_) - e / f_
    return f(light) / f(peak)


def _convert(image: np.ndarray, transfer: str, matrix: np.ndarray, curve, out_transfer: str) -> np.ndarray:
    # 256 codes in, so the transfer is a table of 256 values.
    light = to_linear(transfer, np.arange(256) / 255)[image[..., :3]] @ matrix.T
    light = np.clip(light if curve is None else curve(light), 0, 1)
    out = image.copy()
    out[..., :3] = np.floor(np.clip(from_linear(out_transfer, light), 0, 1) * 255 + 0.5)
    return out


def colorspace(image: np.ndarray, primaries: str, transfer: str, to: str) -> np.ndarray:
    """Converts the gamut in linear light and encodes for the target's display; alpha stays."""
    target = parse_colorspace(to)
    if target is None:
        raise CapabilityError.miss(f"unknown colour space {to!r}", "filter")
    return _convert(image, transfer, gamut(primaries, target), None, "srgb" if target == "srgb" else "bt709")


def tonemap(image: np.ndarray, primaries: str, transfer: str, operator: str = "reinhard") -> np.ndarray:
    """HDR to BT.709, the source's peak to white; SDR input only changes its gamut."""
    peak = PEAK.get(transfer, 1.0)
    curve = None if peak <= 1 else (lambda x: (reinhard if operator == "reinhard" else hable)(x, peak))
    return _convert(image, transfer, gamut(primaries, "bt709"), curve, "bt709")


def split_alpha(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Opaque colour, and the alpha plane as grey."""
    color, grey = image.copy(), image.copy()
    color[..., 3] = 255
    grey[..., :3] = image[..., 3:]
    grey[..., 3] = 255
    return color, grey


def merge_alpha(color: np.ndarray, grey: np.ndarray) -> np.ndarray:
    out = color.copy()
    out[..., 3] = grey[..., 0]
    return out


Kernel = Callable[[np.ndarray, str, str], np.ndarray]


def apply_kernels(frames: DataFrame, kernels: list[Kernel]) -> DataFrame:
    """Runs a chain of kernels f(image, primaries, transfer) over frames in one pass, one frame at a time."""
    prepare(frames.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            images = []
            for w, h, rgba, primaries, transfer in zip(part.width, part.height, part.rgba, part.primaries, part.transfer, strict=True):
                if len(rgba) != w * h * 4:
                    raise InputError.bad("a frame's bytes don't match its size")
                image = np.frombuffer(rgba, np.uint8).reshape(h, w, 4)
                images.append(reduce(lambda i, k: k(i, primaries, transfer), kernels, image))  # noqa: B023
            yield part.assign(width=[i.shape[1] for i in images], height=[i.shape[0] for i in images], rgba=[np.ascontiguousarray(i).tobytes() for i in images])

    return frames.mapInPandas(run, frames.schema)


def steps(settings: dict) -> list[Kernel]:
    """Kernels of a video target in their fixed order: crop, resize, rotate, flip, colour space, tone map.

    crop (x, y, width, height); width and height (one alone takes the other from the frame) with fit;
    rotate degrees; flip axis; colorspace name; tonemap "sdr"."""
    unknown = set(settings) - {"crop", "width", "height", "fit", "rotate", "flip", "colorspace", "tonemap"}
    if unknown:
        raise InputError.bad(f"unknown video settings {sorted(unknown)}")
    out: list[Kernel] = []
    if settings.get("crop") is not None:
        x, y, w, h = settings["crop"]
        if w <= 0 or h <= 0:
            raise InputError.bad(f"crop {w} x {h} must be positive")
        out.append(lambda i, p, t: crop(i, x, y, w, h))
    width, height = settings.get("width"), settings.get("height")
    if width is not None or height is not None:
        if (width is not None and width <= 0) or (height is not None and height <= 0):
            raise InputError.bad("resize must be positive")
        out.append(lambda i, p, t: resize(i, width or i.shape[1], height or i.shape[0], settings.get("fit") or "fill"))
    if settings.get("rotate"):
        out.append(lambda i, p, t: rotate(i, settings["rotate"]))
    if settings.get("flip") is not None:
        out.append(lambda i, p, t: flip(i, settings["flip"]))
    if settings.get("colorspace") is not None:
        if not settings["colorspace"].strip():
            raise InputError.bad("a colour space needs a name")
        out.append(lambda i, p, t: colorspace(i, p, t, settings["colorspace"]))
    if settings.get("tonemap") is not None:
        if settings["tonemap"] != "sdr":
            raise InputError.bad(f"tone mapping to {settings['tonemap']!r} is not supported")
        out.append(lambda i, p, t: tonemap(i, p, t))
    return out


def render(frames: DataFrame, settings: dict) -> DataFrame:
    """Frames after a video target's steps, in one pass; unknown source colours count as BT.709.

    A tone map after a colour space takes the frame as that step left it."""
    chain = steps(settings)
    to = parse_colorspace(settings.get("colorspace") or "")

    def colours(kernel: Kernel, last: bool) -> Kernel:
        def run(image: np.ndarray, primaries: str, transfer: str) -> np.ndarray:
            if last and to is not None:
                return kernel(image, to, "srgb" if to == "srgb" else "bt709")
            return kernel(image, *source_color(primaries, transfer))

        return run

    tone = settings.get("tonemap") is not None
    out = apply_kernels(frames, [colours(k, tone and n + 1 == len(chain)) for n, k in enumerate(chain)])
    if to is None and not tone:
        return out
    return out.withColumns({"primaries": F.lit("bt709" if tone else to), "transfer": F.lit("bt709" if tone or to != "srgb" else "srgb")})
