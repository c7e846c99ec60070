"""Decoding of media in Python workers. The decoders are optional libraries. A file that is itself at fault fails for good; without a
decoder it fails for now, and is tried again once the library is there."""

from __future__ import annotations

import io
import math
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


class ProcessingError(Exception):
    """The file itself is at fault: trying again is no use."""


class MissingDecoder(RuntimeError):
    """The library that reads such files isn't installed: the file may be fine."""


def image(data: bytes, largest: int = 768):
    """(the first frame in RGB, upright, no side over ``largest``; {width, height, format} of the file)."""
    try:
        from PIL import Image, ImageOps
    except ImportError as e:
        raise MissingDecoder("no image decoder") from e
    try:
        Image.open(io.BytesIO(data)).verify()
        im = Image.open(io.BytesIO(data))
        form, size = im.format, im.size  # as stored, before the picture is turned upright
        im.draft("RGB", (largest, largest))  # a JPEG is read at a fraction of its size
        im = ImageOps.exif_transpose(im).convert("RGB")
        im.thumbnail((largest, largest))
        return im, {"width": size[0], "height": size[1], "format": form}
    except Exception as e:
        raise ProcessingError(f"corrupt or unreadable image: {e}") from e


def video_frames(path: str, most: int = 60, fallback: int = 240, misses: int = 3):
    """(list of (t, frame), {duration, fps, width, height}) at the candidate times of a video."""
    try:
        import cv2
    except ImportError as e:
        raise MissingDecoder("no video decoder") from e
    cap = cv2.VideoCapture(path)
    if not cap.isOpened():
        raise ProcessingError("corrupt or unreadable video")
    try:
        fps = cap.get(cv2.CAP_PROP_FPS)
        fps = fps if 0 < fps <= 240 and math.isfinite(fps) else 25.0
        count = cap.get(cv2.CAP_PROP_FRAME_COUNT)
        duration = count / fps if count > 0 else 0.0
        step = max(1.0, duration / most)
        out = _sought(cap, cv2, duration, step, most, misses) if duration else []
        if not out:  # no length, or the file can't be sought in: read on from the start
            cap.set(cv2.CAP_PROP_POS_FRAMES, 0)
            out, seen = _read_on(cap, fps, step, most if duration else fallback)
            duration = duration or seen / fps
        if not out:
            raise ProcessingError("no frame could be decoded")
        return out, {"duration": duration, "fps": fps, "width": int(cap.get(3)), "height": int(cap.get(4))}
    finally:
        cap.release()


def _sought(cap, cv2, duration: float, step: float, most: int, misses: int) -> list:
    """(t, frame) at the candidate times, each sought; given up after so many misses in a row, keeping what was found."""
    out, missed = [], 0
    for i in range(min(most, int(duration / step) + 1)):
        cap.set(cv2.CAP_PROP_POS_MSEC, 1000.0 * i * step)
        ok, frame = cap.read()
        missed = 0 if ok else missed + 1
        if ok:
            out.append((i * step, frame))
        elif missed >= misses:
            break
    return out


def _read_on(cap, fps: float, step: float, most: int) -> tuple[list, int]:
    """(t, frame) at the candidate times by reading every frame, and the number of frames read."""
    out, n, due = [], 0, 0.0
    while len(out) < most and cap.grab():
        if n / fps >= due:
            ok, frame = cap.retrieve()
            if ok:
                out.append((n / fps, frame))
            due += step
        n += 1
    return out, n


def pdf_pages(data: bytes, most: int = 60, pictures: int = 6) -> tuple[list[str], list[np.ndarray], dict]:
    """(text of the first pages, pictures of the very first ones, {pages, title})."""
    try:
        import fitz
    except ImportError as e:
        raise MissingDecoder("no PDF decoder") from e
    try:
        doc = fitz.open(stream=data, filetype="pdf")
    except Exception as e:
        raise ProcessingError(f"corrupt or unreadable PDF: {e}") from e
    if doc.needs_pass:
        raise ProcessingError("encrypted PDF")
    if not doc.page_count:
        raise ProcessingError("PDF without pages")
    shown = []
    for i in range(min(pictures, doc.page_count)):
        pix = doc[i].get_pixmap(alpha=False)
        shown.append(np.frombuffer(pix.samples, np.uint8).reshape(pix.height, pix.width, -1)[:, :, :3])
    return [doc[i].get_text() for i in range(min(most, doc.page_count))], shown, {"pages": doc.page_count, "title": (doc.metadata or {}).get("title") or ""}


#: Samples a second of decoded sound, and seconds read of a file.
SAMPLES, SECONDS = 16_000, 180


def audio(path: str, most: int = SECONDS) -> np.ndarray:
    """The first seconds of a file's sound, mono at SAMPLES a second, from -1 to 1. What was read before damage is kept; a file without
    sound gives none. WAV files need no library."""
    if path.lower().endswith(".wav"):
        return _wave(path, most)
    try:
        import av
    except ImportError as e:
        raise MissingDecoder("no audio decoder") from e
    parts: list[np.ndarray] = []
    try:
        with av.open(path) as file:
            if not file.streams.audio:
                return np.zeros(0, np.float32)
            plain = av.AudioResampler(format="flt", layout="mono", rate=SAMPLES)
            for frame in file.decode(audio=0):
                parts += [x.to_ndarray().ravel() for x in plain.resample(frame)]
                if sum(map(len, parts)) >= most * SAMPLES:
                    break
    except Exception:  # noqa: BLE001 - damaged: keep what there is
        pass
    return np.concatenate(parts).astype(np.float32)[: most * SAMPLES] if parts else np.zeros(0, np.float32)


def _wave(path: str, most: int) -> np.ndarray:
    import wave

    try:
        with wave.open(path, "rb") as f:
            rate, width, channels = f.getframerate(), f.getsampwidth(), f.getnchannels()
            raw = f.readframes(most * rate)
    except (wave.Error, EOFError):
        return np.zeros(0, np.float32)
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float64) / 128 - 1
    elif width == 3:
        x = (np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32) @ np.array([1 << 8, 1 << 16, 1 << 24], np.int32)) / 2.0**31
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]) / 2.0 ** (8 * width - 1)
    x = x.reshape(-1, channels).mean(1)
    at = np.arange(int(len(x) * SAMPLES / rate)) * rate / SAMPLES
    return np.interp(at, np.arange(len(x)), x).astype(np.float32) if len(x) else np.zeros(0, np.float32)


def transcriber(model: Callable[[np.ndarray], list[tuple[str, float]]], most: int = SECONDS, silent: float = 0.6) -> Callable[[str], str]:
    """Reads the speech of a file by a model that gives (text, chance of no speech) of segments; under a second of sound there is none."""

    def read(path: str) -> str:
        sound = audio(path, most)
        return "" if len(sound) < SAMPLES else " ".join(t.strip() for t, none in model(sound) if none < silent)

    return read


def histogram(rgb: np.ndarray, bins: tuple[int, int, int] = (8, 4, 4)) -> np.ndarray:
    """The share of an image's pixels in each cell of hue, saturation and value, hue first."""
    x = np.asarray(rgb, np.float64).reshape(-1, 3) / 255.0
    high, low = x.max(1), x.min(1)
    spread = high - low
    safe = np.where(spread > 0, spread, 1.0)
    r, g, b = x.T
    hue = np.where(high == r, (g - b) / safe % 6, np.where(high == g, (b - r) / safe + 2, (r - g) / safe + 4)) / 6
    hue = np.where(spread > 0, hue, 0.0)
    saturation = np.where(high > 0, spread / np.where(high > 0, high, 1.0), 0.0)
    cell = [np.minimum((v * n).astype(int), n - 1) for v, n in zip((hue, saturation, high), bins, strict=True)]
    counts = np.bincount((cell[0] * bins[1] + cell[1]) * bins[2] + cell[2], minlength=int(np.prod(bins)))
    return counts / max(1, len(x))


def brightness(rgb: np.ndarray) -> float:
    """The mean luma of an image, 0 to 255."""
    return float(np.asarray(rgb, np.float64).reshape(-1, 3).mean(0) @ np.array([0.299, 0.587, 0.114])) if np.size(rgb) else 0.0


def thumbnail(rgb: np.ndarray, largest: int = 320) -> bytes:
    """The image with no side over ``largest``, by averaging blocks of pixels, as a PNG."""
    x = np.asarray(rgb, np.uint8)
    block = max(1, math.ceil(max(x.shape[:2]) / largest))
    h, w = max(1, x.shape[0] // block), max(1, x.shape[1] // block)
    x = x[: h * block, : w * block].reshape(h, min(block, x.shape[0]), w, min(block, x.shape[1]), 3).mean((1, 3)).astype(np.uint8)
    raw = b"".join(b"\0" + row.tobytes() for row in x)
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


@dataclass
class Part:
    """What a decoder gives of a file: a picture, a frame at time ``ref`` or a page ``ref``, each with pixels, text or both."""

    ref: float | None = None
    rgb: np.ndarray | None = None
    text: str | None = None


def read_image(path: str) -> tuple[list[Part], dict]:
    with open(path, "rb") as f:
        im, meta = image(f.read())
    return [Part(None, np.asarray(im))], meta


def read_video(path: str) -> tuple[list[Part], dict]:
    frames, meta = video_frames(path)
    return [Part(t, frame[:, :, ::-1]) for t, frame in frames], meta | {"candidates_checked": len(frames)}


def read_pdf(path: str) -> tuple[list[Part], dict]:
    with open(path, "rb") as f:
        pages, shown, meta = pdf_pages(f.read())
    return [Part(float(i), shown[i - 1] if i <= len(shown) else None, text) for i, text in enumerate(pages, 1)], meta


#: The decoder of each kind: from a path to parts and metadata.
DECODERS = {"image": read_image, "video": read_video, "pdf": read_pdf}
