"""Kernels on decoded pixels (numpy), and the facts that image bytes show without decoding."""

from __future__ import annotations

import struct

import numpy as np


def gray(rgb: np.ndarray) -> np.ndarray:
    """Luma by ITU-R 601-2, rounded down as in 8-bit images; rows x columns of uint8 from (h, w) or (h, w, channels)."""
    if rgb.ndim == 2:
        return rgb.astype(np.uint8)
    if rgb.shape[2] < 3:
        return rgb[:, :, 0].astype(np.uint8)
    weights = np.array([19595, 38470, 7471], np.int64)  # the three shares in 1/65536
    return ((rgb[:, :, :3].astype(np.int64) @ weights + 0x8000) >> 16).astype(np.uint8)


def quality(g: np.ndarray) -> dict[str, float]:
    """brightness (mean), contrast (population deviation), blur (variance of the four-neighbour Laplacian inside), blank."""
    x = g.astype(np.float64)
    spread = float(x.std())
    blur = 0.0
    if min(x.shape) >= 3:
        blur = float((x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]).var())
    return {"blur_score": blur, "brightness_score": float(x.mean()), "contrast_score": spread, "blank_score": float(spread <= 1)}


def detail(rgb: np.ndarray, g: np.ndarray) -> dict[str, float]:
    x = g.astype(np.float64)
    noise = 0.0
    if min(x.shape) >= 2:
        noise = min(1.0, float((np.abs(np.diff(x, axis=1)).mean() + np.abs(np.diff(x, axis=0)).mean()) / 510))
    channels = rgb.reshape(rgb.shape[0] * rgb.shape[1], -1)[:, :3].astype(np.float64)
    return {
        "dark_pixel_ratio": float((g <= 16).mean()),
        "bright_pixel_ratio": float((g >= 239).mean()),
        "clipped_pixel_ratio": float(((g <= 2) | (g >= 253)).mean()),
        "noise_score": noise,
        "mono_color_score": float(np.clip(1 - channels.std(0).mean() / 64, 0, 1)),
    }


def border(rgb: np.ndarray, near: int = 8, min_side_ratio: float = 0.08) -> dict[str, float | str]:
    """Padding of one colour around an image: its share of the area, the sides that have it, and its colour."""
    none = {"border_padding_ratio": 0.0, "border_padding_sides": "", "border_padding_color": "unknown"}
    x = rgb[:, :, None] if rgb.ndim == 2 else rgb
    x = np.repeat(x[:, :, :1], 3, 2) if x.shape[2] < 3 else x[:, :, :3]
    h, w = x.shape[:2]
    if not h or not w:
        return none
    edge = np.median(np.concatenate([x[0], x[-1], x[:, 0], x[:, -1]]), axis=0)
    same = (np.abs(x.astype(np.float64) - edge) <= near).all(2)
    run = lambda lines: int(np.argmin(np.append(lines, False)))
    rows, cols = same.all(1), same.all(0)
    depth = {"top": run(rows), "bottom": run(rows[::-1]), "left": run(cols), "right": run(cols[::-1])}
    least = max(2, int(min(h, w) * min_side_ratio))
    depth = {k: v if v >= least else 0 for k, v in depth.items()}
    if depth["top"] + depth["bottom"] >= h or depth["left"] + depth["right"] >= w or not any(depth.values()):
        return none
    inner = (h - depth["top"] - depth["bottom"]) * (w - depth["left"] - depth["right"])
    spread, mean = float(edge.max() - edge.min()), float(edge.mean())
    color = "unknown" if spread > 16 else "white" if mean >= 240 else "black" if mean <= 16 else "solid"
    return {"border_padding_ratio": 1 - inner / (h * w), "border_padding_sides": ",".join(k for k, v in depth.items() if v), "border_padding_color": color}


def _lanczos(size: int, out: int, a: int = 3) -> np.ndarray:
    """Weights (out x size) of the windowed-sinc resampler, its support widened when shrinking."""
    scale = max(size / out, 1.0)
    centre = (np.arange(out) + 0.5) * size / out
    x = (np.arange(size)[None, :] + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(x) < a, np.sinc(x) * np.sinc(x / a), 0.0)
    return w / w.sum(1, keepdims=True)


def phash(g: np.ndarray, side: int = 32, low: int = 8) -> str:
    """64 bits: whether each of the 8 x 8 lowest DCT coefficients reaches the median of all but the first."""
    h, w = g.shape
    small = np.clip(np.round(_lanczos(h, side) @ g.astype(np.float64) @ _lanczos(w, side).T), 0, 255)
    k, n = np.arange(side)[:, None], np.arange(side)[None, :]
    basis = np.sqrt(2 / side) * np.cos(np.pi * (2 * n + 1) * k / (2 * side))
    basis[0] = np.sqrt(1 / side)
    values = (basis @ small @ basis.T)[:low, :low].ravel()
    bits = values >= np.median(values[1:])
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def image_format(data: bytes) -> str:
    if data[:3] == b"\xff\xd8\xff":
        return "JPEG"
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "PNG"
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "GIF"
    if data[:2] == b"BM":
        return "BMP"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "WEBP"
    return ""


def _png_chunks(data: bytes):
    at = 8
    while at + 8 <= len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size


def _jpeg_segments(data: bytes):
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xDA:
            return
        (size,) = struct.unpack(">H", data[at + 2 : at + 4])
        yield kind, data[at + 4 : at + 2 + size]
        at += 2 + size


def _webp_chunks(data: bytes):
    at = 12
    while at + 8 <= len(data):
        kind, (size,) = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def frame_count(data: bytes) -> int:
    """Frames of an animation; 1 for still images, 0 for what is no image."""
    kind = image_format(data)
    if kind == "GIF" and len(data) > 13:
        at = 13 + (3 << (data[10] & 7) + 1 if data[10] & 0x80 else 0)
        n = 0

        def skip(at: int) -> int:
            while at < len(data) and data[at]:
                at += 1 + data[at]
            return at + 1

        while at < len(data):
            if data[at] == 0x21:
                at = skip(at + 2)
            elif data[at] == 0x2C and at + 9 < len(data):
                n += 1
                at += 10 + (3 << (data[at + 9] & 7) + 1 if data[at + 9] & 0x80 else 0)
                at = skip(at + 1)
            else:
                break
        return max(n, 1)
    if kind == "PNG":
        return next((struct.unpack(">I", c[:4])[0] for k, c in _png_chunks(data) if k == b"acTL" and len(c) >= 4), 1)
    if kind == "WEBP":
        return max(1, sum(k == b"ANMF" for k, _ in _webp_chunks(data)))
    return int(bool(kind))


def exif(data: bytes) -> dict[int, object]:
    """Tags of the first image directory, with those of the Exif and GPS directories under (directory tag, tag)."""
    kind = image_format(data)
    raw = b""
    if kind == "JPEG":
        raw = next((s[6:] for k, s in _jpeg_segments(data) if k == 0xE1 and s[:6] == b"Exif\0\0"), b"")
    elif kind == "PNG":
        raw = next((c for k, c in _png_chunks(data) if k == b"eXIf"), b"")
    elif kind == "WEBP":
        raw = next((c[6:] if c[:6] == b"Exif\0\0" else c for k, c in _webp_chunks(data) if k == b"EXIF"), b"")
    if raw[:4] not in (b"II*\0", b"MM\0*"):
        return {}
    order = "<" if raw[:2] == b"II" else ">"
    out: dict = {}
    sizes = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 7: ("s", 1), 9: ("i", 4), 10: ("ii", 8)}

    def directory(at: int, under: int | None) -> None:
        (n,) = struct.unpack_from(order + "H", raw, at)
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
            if kind not in sizes:
                continue
            code, size = sizes[kind]
            where = at + 10 + 12 * i
            if size * count > 4:
                (where,) = struct.unpack_from(order + "I", raw, where)
            if code == "s":
                value = raw[where : where + count].split(b"\0")[0].decode("latin-1").strip()
            else:
                values = [struct.unpack_from(order + code, raw, where + size * j) for j in range(count)]
                values = [v[0] if len(v) == 1 else (v[0] / v[1] if v[1] else None) for v in values]
                value = values[0] if count == 1 else values
            out[tag if under is None else (under, tag)] = value
            if under is None and tag in (0x8769, 0x8825) and isinstance(value, int):
                directory(value, tag)

    try:
        directory(struct.unpack_from(order + "I", raw, 4)[0], None)
    except (struct.error, IndexError, ZeroDivisionError):
        pass
    return out


def size_and_mode(data: bytes) -> tuple[int, int, int, str, bool] | None:
    """Width, height, channels, colour mode and whether there is an alpha channel, from the header; None where it does not say."""
    kind = image_format(data)
    try:
        if kind == "PNG":
            w, h, _, color = struct.unpack(">IIBB", data[16:26])
            channels, mode = {0: (1, "L"), 2: (3, "RGB"), 3: (1, "P"), 4: (2, "LA"), 6: (4, "RGBA")}[color]
            return w, h, channels, mode, mode in ("LA", "RGBA") or any(k == b"tRNS" for k, _ in _png_chunks(data))
        if kind == "JPEG":
            for k, s in _jpeg_segments(data):
                if 0xC0 <= k <= 0xCF and k not in (0xC4, 0xC8, 0xCC):
                    h, w, channels = struct.unpack(">HHB", s[1:6])
                    return w, h, channels, {1: "L", 3: "RGB", 4: "CMYK"}.get(channels, "RGB"), False
        if kind == "GIF":
            w, h = struct.unpack("<HH", data[6:10])
            return w, h, 1, "P", False
        if kind == "BMP":
            w, h, _, bits = struct.unpack("<iiHH", data[18:30])
            channels = {24: 3, 32: 4}.get(bits, 1)
            return w, abs(h), channels, {3: "RGB", 4: "RGBA"}.get(channels, "P"), channels == 4
        if kind == "WEBP":
            for k, c in _webp_chunks(data):
                if k == b"VP8X":
                    alpha = bool(c[0] & 0x10)
                    return 1 + int.from_bytes(c[4:7], "little"), 1 + int.from_bytes(c[7:10], "little"), 3 + alpha, "RGBA" if alpha else "RGB", alpha
                if k == b"VP8 ":
                    w, h = struct.unpack("<HH", c[6:10])
                    return w & 0x3FFF, h & 0x3FFF, 3, "RGB", False
                if k == b"VP8L":
                    bits = int.from_bytes(c[1:5], "little")
                    alpha = bool(bits >> 28 & 1)
                    return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, 3 + alpha, "RGBA" if alpha else "RGB", alpha
    except (struct.error, KeyError, IndexError):
        return None
    return None


def icc_and_dpi(data: bytes) -> tuple[bool, float | None, float | None]:
    kind = image_format(data)
    if kind == "JPEG":
        icc, dpi = False, (None, None)
        for k, s in _jpeg_segments(data):
            icc |= k == 0xE2 and s[:12] == b"ICC_PROFILE\0"
            if k == 0xE0 and s[:5] == b"JFIF\0" and len(s) >= 12:
                unit, x, y = struct.unpack(">BHH", s[7:12])
                factor = {1: 1.0, 2: 2.54}.get(unit)
                dpi = (x * factor, y * factor) if factor else dpi
        return icc, *dpi
    if kind == "PNG":
        icc, dpi = False, (None, None)
        for k, c in _png_chunks(data):
            icc |= k == b"iCCP"
            if k == b"pHYs" and len(c) == 9 and c[8] == 1:
                x, y = struct.unpack(">II", c[:8])
                dpi = (x * 0.0254, y * 0.0254)
        return icc, *dpi
    return False, None, None


def from_raster(data: bytes, raster: bytes) -> np.ndarray:
    """Rows of RGB from the samples that `rasters` hands out and the image's header. Alpha is dropped; a palette's colours are put in."""
    kind, x = image_format(data), np.frombuffer(raster, np.uint8)
    w, h, channels, mode, _ = size_and_mode(data)
    if kind == "GIF":
        return _gif(data, x, w, h)
    if len(x) == w * h * channels:
        x = x.reshape(h, w, channels)
        if channels < 3:
            x = x[:, :, :1]
        else:  # blue, green and red, after alpha where there is one
            x = x[:, :, :-4:-1]
        if mode == "P":
            return _palette(data)[x[:, :, 0]]
        return np.repeat(x, 3, 2) if x.shape[2] == 1 else x
    bits = data[24] if kind == "PNG" else 0
    if channels != 1 or bits not in (1, 2, 4):
        raise ValueError(f"unsupported samples of {kind}")
    x = _unpacked(x, w, h, bits)
    if mode == "P":
        return _palette(data)[x]
    return np.repeat((x.astype(np.uint16) * 255 // ((1 << bits) - 1)).astype(np.uint8)[:, :, None], 3, 2)


def _unpacked(x: np.ndarray, w: int, h: int, bits: int) -> np.ndarray:
    """Samples of fewer than 8 bits; lines begin at whole bytes."""
    ones = np.unpackbits(x.reshape(h, -1), axis=1)[:, : w * bits].reshape(h, w, bits)
    return (ones @ (1 << np.arange(bits - 1, -1, -1))).astype(np.uint8)


def _palette(data: bytes) -> np.ndarray:
    """256 colours of a PNG; those that it does not give are black."""
    out = np.zeros((256, 3), np.uint8)
    given = np.frombuffer(next(c for k, c in _png_chunks(data) if k == b"PLTE"), np.uint8).reshape(-1, 3)
    out[: len(given)] = given
    return out


def _gif(data: bytes, x: np.ndarray, w: int, h: int) -> np.ndarray:
    """The first frame on the screen, which has the background's colour where the frame does not reach."""

    def colours(at: int, flags: int) -> np.ndarray:
        out, n = np.zeros((256, 3), np.uint8), 2 << (flags & 7) if flags & 0x80 else 0
        out[:n] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3)
        return out

    screen = colours(13, data[10])
    at = 13 + (3 * (2 << (data[10] & 7)) if data[10] & 0x80 else 0)
    while data[at] == 0x21:  # extensions before the frame
        at += 2
        while data[at]:
            at += 1 + data[at]
        at += 1
    left, top, fw, fh, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
    if len(x) != fw * fh:
        x = _unpacked(x, fw, fh, next(b for b in (1, 2, 4) if -(-fw * b // 8) * fh == len(x)))
    frame = (colours(at + 10, flags) if flags & 0x80 else screen)[x.reshape(fh, fw)]
    if (left, top, fw, fh) == (0, 0, w, h):
        return frame
    out = np.empty((max(h, top + fh), max(w, left + fw), 3), np.uint8)
    out[:] = screen[data[11]]
    out[top : top + fh, left : left + fw] = frame
    return out[:h, :w]


def gps(tags: dict) -> tuple[float | None, float | None]:
    """Latitude and longitude in signed decimal degrees."""

    def decimal(value: object, side: object) -> float | None:
        if not isinstance(value, list) or len(value) != 3 or None in value:
            return None
        d = value[0] + value[1] / 60 + value[2] / 3600
        return -d if str(side).upper() in ("S", "W") else d

    return decimal(tags.get((0x8825, 2)), tags.get((0x8825, 1))), decimal(tags.get((0x8825, 4)), tags.get((0x8825, 3)))
