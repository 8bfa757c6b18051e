"""Kernels over grey images (2-D uint8 arrays) of lines and pages, for use inside ``mapInPandas``.

Written with numpy only. Results are defined by the docstrings; they are not meant to equal those of
an image library pixel by pixel.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np

Polygon = Sequence[tuple[float, float]]


def shape_box(shape: Polygon) -> tuple[int, int, int, int]:
    """Least and greatest coordinates."""
    pts = np.asarray(shape)
    (x0, y0), (x1, y1) = pts.min(axis=0), pts.max(axis=0)
    return int(x0), int(y0), int(x1), int(y1)


def is_rectangular(shape: Polygon) -> bool:
    """Whether the corners are the four of an upright box."""
    x0, y0, x1, y1 = shape_box(shape)
    corners = {(int(x), int(y)) for x, y in shape}
    return corners == {(x0, y0), (x1, y0), (x1, y1), (x0, y1)}


def crop(image: np.ndarray, shape: Polygon) -> np.ndarray:
    """A copy of the part of the image in the shape's box; a ValueError if it lies outside."""
    x0, y0, x1, y1 = shape_box(shape)
    part = image[max(0, y0) : y1, max(0, x0) : x1].copy()
    if part.size == 0:
        raise ValueError(f"no part of the image in {x0},{y0} {x1},{y1}")
    return part


def polygon_mask(shape: Polygon, height: int, width: int) -> np.ndarray:
    """255 at pixels whose centre lies in the polygon (even-odd rule), 0 elsewhere."""
    pts = np.asarray(shape, dtype=float)
    x, y = np.arange(width) + 0.5, np.arange(height)[:, None] + 0.5
    inside = np.zeros((height, width), dtype=bool)
    for (ax, ay), (bx, by) in zip(pts, np.roll(pts, -1, axis=0), strict=True):
        if ay == by:
            continue
        crosses = (ay > y) != (by > y)
        inside ^= crosses & (x < ax + (y - ay) * (bx - ax) / (by - ay))
    return inside.astype(np.uint8) * 255


def otsu_threshold(image: np.ndarray) -> int:
    """The grey level that parts the histogram with the greatest variance between both sides."""
    hist = np.bincount(image.ravel(), minlength=256).astype(float)
    weight, total = np.cumsum(hist), hist.sum()
    sums = np.cumsum(hist * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (sums[-1] * weight / total - sums) ** 2 / (weight * (total - weight))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def smoothed(image: np.ndarray) -> np.ndarray:
    """A 3×3 binomial mean; the border is repeated."""
    p = np.pad(image.astype(float), 1, mode="edge")
    rows = p[:-2] + 2 * p[1:-1] + p[2:]
    return np.round((rows[:, :-2] + 2 * rows[:, 1:-1] + rows[:, 2:]) / 16).astype(np.uint8)


def binarized(image: np.ndarray) -> np.ndarray:
    """Black and white by the threshold of the smoothed image."""
    soft = smoothed(image)
    return np.where(soft > otsu_threshold(soft), 255, 0).astype(np.uint8)


def grey_reference(image: np.ndarray, threshold: int = 127) -> float:
    """Median of the pixels above the threshold; NaN if there are none."""
    bright = image[image > threshold]
    return float(np.median(bright)) if bright.size else float("nan")


def grey_range(image: np.ndarray | None = None, low: int = 168, width: int = 32) -> tuple[int, int, int]:
    """(low, high, middle) of the background's grey: around the image's reference, or fixed."""
    half = width // 2
    if image is None or np.isnan(ref := grey_reference(image)):
        return low, low + width, low + half
    return int(ref - half), int(ref + half), int(ref - half) + half


def grey_canvas(height: int, width: int, image: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """Softly noisy grey of the background's tone; the seed makes it repeatable."""
    low, high, _ = grey_range(image, width=8)
    return smoothed(np.random.default_rng(seed).integers(low, max(low + 1, high), (height, width)).clip(0, 255).astype(np.uint8))


def fit_to_shape(part: np.ndarray, shape: Polygon, seed: int = 0) -> np.ndarray:
    """The part with all outside the shape (in page coordinates) replaced by grey."""
    x0, y0, _, _ = shape_box(shape)
    mask = polygon_mask([(x - x0, y - y0) for x, y in shape], *part.shape) > 0
    return np.where(mask, part, grey_canvas(*part.shape, image=part, seed=seed)).astype(np.uint8)


def edge_bands(height: int, ratio: float | Sequence[float]) -> tuple[int, int]:
    """Rows above the first and below the second count as edge: shares of the height, one or (top, bottom)."""
    top, bottom = (ratio, ratio) if isinstance(ratio, int | float) else ratio
    return int(height * top), int(height - height * bottom)


def components(ink: np.ndarray) -> list[np.ndarray]:
    """Connected groups (8 neighbours) of true pixels as arrays of (row, column), by union of runs."""
    runs, parent = [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    before: list[int] = []
    for y, row in enumerate(ink):
        d = np.diff(np.concatenate(([0], row.astype(np.int8), [0])))
        now = []
        for a, b in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1), strict=True):
            k = len(runs)
            runs.append((y, int(a), int(b)))
            parent.append(k)
            for j in before:
                if runs[j][1] <= b and runs[j][2] >= a:
                    parent[root(j)] = root(k)
            now.append(k)
        before = now
    groups: dict[int, list[int]] = {}
    for k in range(len(runs)):
        groups.setdefault(root(k), []).append(k)
    return [np.concatenate([np.stack((np.full(runs[k][2] - runs[k][1], runs[k][0]), np.arange(runs[k][1], runs[k][2])), axis=1) for k in ks]) for ks in groups.values()]


def cleared_edges(part: np.ndarray, ratio: float | Sequence[float] = 0.1) -> tuple[np.ndarray, int, int]:
    """The part without ink that reaches in from above or below, and how many such groups there were.

    A group of dark pixels that touches the upper (lower) border and whose centre of mass lies in the
    edge band is painted over with the background's grey.
    """
    top, bottom = edge_bands(part.shape[0], ratio)
    out, grey, counts = part.copy(), grey_range(part)[2], [0, 0]
    for g in components(binarized(part) == 0):
        centre = g[:, 0].mean()
        for side, hit in enumerate((g[:, 0].min() == 0 and centre <= top, g[:, 0].max() == part.shape[0] - 1 and centre >= bottom)):
            if hit:
                counts[side] += 1
                out[g[:, 0], g[:, 1]] = grey
    return out, counts[0], counts[1]


def skew_angle(part: np.ndarray, most: float = 10.0, step: float = 0.1) -> float:
    """The angle in degrees by which the line's ink is turned, found by the sharpest row profile."""
    ys, xs = np.nonzero(binarized(part) == 0)
    if len(ys) < 2:
        return 0.0
    best, found = -1.0, 0.0
    for angle in np.arange(-most, most + step / 2, step):
        rows = np.round(ys - xs * np.tan(np.radians(angle))).astype(int)
        score = float((np.bincount(rows - rows.min()).astype(float) ** 2).sum())
        if score > best * (1 + 1e-9) or (score >= best * (1 - 1e-9) and abs(angle) < abs(found)):
            best, found = max(score, best), float(angle)
    return round(found, 6)


def rotated(part: np.ndarray, angle: float, fill: int) -> np.ndarray:
    """The part turned back by ``angle`` degrees about its centre, nearest pixel; new pixels are ``fill``."""
    h, w = part.shape
    cy, cx, a = (h - 1) / 2, (w - 1) / 2, np.radians(angle)
    y, x = np.mgrid[0:h, 0:w]
    sx = np.round((x - cx) * np.cos(a) - (y - cy) * np.sin(a) + cx).astype(int)
    sy = np.round((x - cx) * np.sin(a) + (y - cy) * np.cos(a) + cy).astype(int)
    ok = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full_like(part, fill)
    out[ok] = part[sy[ok], sx[ok]]
    return out


def padded(part: np.ndarray, padding: int) -> np.ndarray:
    """A border of the background's grey."""
    return np.pad(part, padding, constant_values=np.uint8(np.clip(grey_range(part)[2], 0, 255)))


def sanitized(part: np.ndarray, shape: Polygon, ratio: float | Sequence[float] = 0.1, turn_from: float = 0.1, padding: int = 0, seed: int = 0) -> np.ndarray:
    """Edges cleared, fitted to the shape unless it is a box, turned upright and padded."""
    out = cleared_edges(part, ratio)[0]
    if not is_rectangular(shape):
        out = fit_to_shape(out, shape, seed)
    angle = skew_angle(out)
    if abs(angle) >= turn_from:
        out = rotated(out, angle, int(np.clip(grey_range(out)[2], 0, 255)))
    return padded(out, padding) if padding > 0 else out


def centre_of_mass(weights: np.ndarray) -> tuple[float, float]:
    """(x, y) of the mass; (0, 0) without any."""
    total = float(weights.sum()) or 1.0
    y, x = np.mgrid[0 : weights.shape[0], 0 : weights.shape[1]]
    return float((x * weights).sum() / total), float((y * weights).sum() / total)


def painted(image: np.ndarray, shapes: Sequence[Polygon], colour: tuple[int, int, int], hidden: Sequence[Polygon] = (), fill: float = 0.4, strength: float = 0.8) -> np.ndarray:
    """A colour image with the shapes outlined and softly filled, but not where a hidden shape lies."""
    rgb = np.repeat(image[:, :, None], 3, axis=2) if image.ndim == 2 else image.copy()
    h, w = rgb.shape[:2]
    free = np.ones((h, w), dtype=bool)
    for s in hidden:
        free &= polygon_mask(s, h, w) == 0
    layer = rgb.astype(float)
    for s in shapes:
        inside = polygon_mask(s, h, w) > 0
        near = np.zeros_like(inside)
        near[1:-1, 1:-1] = inside[:-2, 1:-1] & inside[2:, 1:-1] & inside[1:-1, :-2] & inside[1:-1, 2:]
        border = inside & ~near
        layer[inside & free] += fill * (np.array(colour) - layer[inside & free])
        layer[border & free] = colour
    return np.round(rgb * (1 - strength) + layer * strength).astype(np.uint8)


def _grey(pixels: np.ndarray) -> np.ndarray:
    """Rows of pixels with 1 to 4 channels as grey; a last channel of transparency is left out."""
    if pixels.shape[2] < 3:
        return pixels[:, :, 0].copy()
    return np.round(pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def _png_pixels(content: bytes) -> np.ndarray:
    """Pixels of a PNG image of 8 bits a channel, without interlacing."""
    at, data, palette = 8, b"", None
    while at < len(content):
        size, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, woven = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big"), body[8], body[9], body[12]
            if depth != 8 or woven:
                raise ValueError("only PNG images of 8 bits without interlacing are read")
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
        at += size + 12
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width, channels), np.int32)
    above = np.zeros((width, channels), np.int32)
    for y in range(height):
        method, line = rows[y, 0], rows[y, 1:].reshape(width, channels).astype(np.int32)
        if method == 0:
            pass
        elif method == 1:
            line = np.cumsum(line, axis=0)
        elif method == 2:
            line = line + above
        else:  # these two need the pixel to the left, one by one
            left = corner = np.zeros(channels, np.int32)
            for x in range(width):
                if method == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    a, b, c = abs(p - left), abs(p - above[x]), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above[x], corner))
                corner, left = above[x], (line[x] + guess) % 256
                line[x] = left
        above = out[y] = line % 256
    return palette[out[:, :, 0]] if palette is not None and colour == 3 else out.astype(np.uint8)


def _tiff_tags(content: bytes) -> tuple[str, dict[int, list[int]]]:
    """Byte order and the whole-number tags of the first image of a TIFF file (of fractions: where they stand)."""
    order = "little" if content[:2] == b"II" else "big"
    num = lambda at, n: int.from_bytes(content[at : at + n], order)
    at, tags = num(4, 4), {}
    for k in range(num(at, 2)):
        e = at + 2 + 12 * k
        size, n = {1: 1, 3: 2, 4: 4}.get(num(e + 2, 2), 0), num(e + 4, 4)
        start = e + 8 if size * n <= 4 else num(e + 8, 4)
        tags[num(e, 2)] = [num(start + size * i, size) for i in range(n)] if size else [num(e + 8, 4)]
    return order, tags


def _tiff_pixels(content: bytes) -> np.ndarray:
    """Pixels of a TIFF image of 8 bits a channel in strips, plain or deflated."""
    _, tags = _tiff_tags(content)
    one = lambda tag, default: tags.get(tag, [default])[0]
    width, height, channels, packed = one(256, 0), one(257, 0), one(277, 1), one(259, 1)
    if any(b != 8 for b in tags.get(258, [1])) or packed not in (1, 8, 32946) or one(284, 1) != 1 or 273 not in tags or one(317, 1) != 1:
        raise ValueError("only plain or deflated TIFF images of 8 bits in strips are read")
    strips = [content[a : a + n] for a, n in zip(tags[273], tags[279], strict=True)]
    data = b"".join(strips if packed == 1 else map(zlib.decompress, strips))
    pixels = np.frombuffer(data, np.uint8, width * height * channels).reshape(height, width, channels)
    return 255 - pixels if one(262, 1) == 0 else pixels


def read_grey(content: bytes) -> np.ndarray:
    """A PNG, TIFF, binary PGM or PPM image as grey."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return _grey(_png_pixels(content))
    if content[:4] in (b"II*\0", b"MM\0*"):
        return _grey(_tiff_pixels(content))
    fields, at = [], 0
    while len(fields) < 4:
        end = at
        while content[end : end + 1] not in (b" ", b"\n", b"\t", b"\r", b""):
            end += 1
        word = content[at:end]
        if word.startswith(b"#"):
            end = content.index(b"\n", at)
        elif word:
            fields.append(word)
        at = end + 1
    kind, width, height, _ = fields[0], *map(int, fields[1:])
    if kind == b"P5":
        return np.frombuffer(content, np.uint8, width * height, at).reshape(height, width).copy()
    if kind == b"P6":
        rgb = np.frombuffer(content, np.uint8, 3 * width * height, at).reshape(height, width, 3)
        return np.round(rgb @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
    raise ValueError(f"unknown image format {kind!r}")


def write_image(image: np.ndarray, kind: str = "pnm", dpi: tuple[int, int] = (300, 300)) -> bytes:
    """An image of grey or colour as ``tif`` (deflated, with its resolution), ``png`` (likewise) or ``pnm``."""
    image = np.ascontiguousarray(image, dtype=np.uint8)
    height, width, channels = *image.shape[:2], 1 if image.ndim == 2 else 3
    if kind == "pnm":
        return (b"P5" if channels == 1 else b"P6") + b"\n%d %d\n255\n" % (width, height) + image.tobytes()
    if kind == "png":
        chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
        rows = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, -1)], axis=1)
        per_metre = [round(d / 0.0254) for d in dpi]
        return b"\x89PNG\r\n\x1a\n" + b"".join([
            chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0 if channels == 1 else 2, 0, 0, 0)),
            chunk(b"pHYs", struct.pack(">IIB", *per_metre, 1)), chunk(b"IDAT", zlib.compress(rows.tobytes())), chunk(b"IEND", b""),
        ])
    if kind != "tif":
        raise ValueError(f"unknown kind of image {kind!r}")
    data = zlib.compress(image.tobytes())
    # Header, one directory of 13 entries, its longer values, then the strip.
    more = 8 + 2 + 13 * 12 + 4
    entries = [
        (256, 4, 1, width), (257, 4, 1, height), (258, 3, channels, 8 if channels == 1 else more + 16), (259, 3, 1, 8), (262, 3, 1, 1 if channels == 1 else 2),
        (273, 4, 1, more + 22), (277, 3, 1, channels), (278, 4, 1, height), (279, 4, 1, len(data)), (282, 5, 1, more), (283, 5, 1, more + 8), (284, 3, 1, 1), (296, 3, 1, 2),
    ]
    table = b"".join(struct.pack("<HHII", *e) for e in entries)
    return b"II*\0" + struct.pack("<IH", 8, len(entries)) + table + struct.pack("<I", 0) + struct.pack("<IIII", dpi[0], 1, dpi[1], 1) + struct.pack("<HHH", 8, 8, 8) + data


def dots_per_inch(content: bytes, default: int = 300) -> tuple[int, int]:
    """Resolution in x and y from the header of a PNG, JPEG or TIFF file; the default without one."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        at = content.find(b"pHYs")
        if at > 0 and content[at + 12] == 1:
            return tuple(round(int.from_bytes(content[at + k : at + k + 4], "big") * 0.0254) for k in (4, 8))
    elif content[:2] == b"\xff\xd8" and content[6:11] == b"JFIF\0" and content[13] in (1, 2):
        scale = 2.54 if content[13] == 2 else 1
        return tuple(round(int.from_bytes(content[k : k + 2], "big") * scale) for k in (14, 16))
    elif content[:4] in (b"II*\0", b"MM\0*"):
        order = "little" if content[:2] == b"II" else "big"
        num = lambda at, n: int.from_bytes(content[at : at + n], order)
        at, found = num(4, 4), {}
        for k in range(num(at, 2)):
            e = at + 2 + 12 * k
            if num(e, 2) in (282, 283):
                v = num(e + 8, 4)
                found[num(e, 2)] = round(num(v, 4) / (num(v + 4, 4) or 1))
        if found:
            x = found.get(282, default)
            return x, found.get(283, x)
    return default, default
