"""Binary artifacts: target, latent and graph files, sound and pictures. Each codec checks what it reads."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

#: Magic bytes, version, and the widths of identifiers.
TARGET, LATENT, GRAPH, VERSION, SCENE_WIDTH, TASK_WIDTH = b"SFTT", b"SFLA", b"SFGR", 1, 32, 8


class CodecError(ValueError):
    pass


def _fixed(text: str, width: int) -> bytes:
    raw = text.encode()
    if len(raw) > width:
        raise CodecError(f"{text!r} is longer than {width} bytes")
    return raw.ljust(width, b"\0")


def _opened(data: bytes, magic: bytes) -> memoryview:
    if data[:4] != magic:
        raise CodecError("wrong magic bytes")
    if struct.unpack_from("<I", data, 4)[0] != VERSION:
        raise CodecError("unsupported version")
    return memoryview(data)[8:]


def _floats(body: memoryview, at: int, n: int) -> list[float]:
    if len(body) != at + 8 * n:
        raise CodecError("wrong length")
    values = list(struct.unpack_from(f"<{n}d", body, at))
    if not all(map(math.isfinite, values)):
        raise CodecError("a value is not finite")
    return values


def write_target(scene_id: str, task_id: str, rows: list[list[float]]) -> bytes:
    width = len(rows[0]) if rows else 0
    flat = [v for r in rows for v in r]
    if any(len(r) != width for r in rows) or not all(map(math.isfinite, flat)):
        raise CodecError("rows must be of one width and finite")
    return TARGET + struct.pack("<I", VERSION) + _fixed(scene_id, SCENE_WIDTH) + _fixed(task_id, TASK_WIDTH) + struct.pack(f"<II{len(flat)}d", len(rows), width, *flat)


def read_target(data: bytes) -> tuple[str, str, list[list[float]]]:
    body = _opened(data, TARGET)
    scene, task = (bytes(body[a:b]).rstrip(b"\0").decode() for a, b in ((0, 32), (32, 40)))
    n, width = struct.unpack_from("<II", body, 40)
    flat = _floats(body, 48, n * width)
    return scene, task, [flat[i * width : (i + 1) * width] for i in range(n)]


def write_latent(scene_id: str, values: list[float]) -> bytes:
    if not all(map(math.isfinite, values)):
        raise CodecError("a value is not finite")
    return LATENT + struct.pack("<I", VERSION) + _fixed(scene_id, SCENE_WIDTH) + struct.pack(f"<I{len(values)}d", len(values), *values)


def read_latent(data: bytes) -> tuple[str, list[float]]:
    body = _opened(data, LATENT)
    return bytes(body[:32]).rstrip(b"\0").decode(), _floats(body, 36, struct.unpack_from("<I", body, 32)[0])


def write_graph(nodes: int, edges: list[tuple[int, int, float]], lambda2: float, degrees: tuple[int, int, float]) -> bytes:
    body = struct.pack("<II", nodes, len(edges)) + b"".join(struct.pack("<IId", *e) for e in edges)
    return GRAPH + struct.pack("<I", VERSION) + body + struct.pack("<dIId", lambda2, *degrees)


def read_graph(data: bytes) -> tuple[int, list[tuple[int, int, float]], float, tuple[int, int, float]]:
    body = _opened(data, GRAPH)
    nodes, n = struct.unpack_from("<II", body, 0)
    if len(body) != 8 + 16 * n + 24:
        raise CodecError("wrong length")
    edges = [struct.unpack_from("<IId", body, 8 + 16 * i) for i in range(n)]
    if any(a >= nodes or b >= nodes or not math.isfinite(w) for a, b, w in edges):
        raise CodecError("an edge leaves the graph")
    lambda2, least, most, mean = struct.unpack_from("<dIId", body, 8 + 16 * n)
    return nodes, edges, lambda2, (least, most, mean)


def write_wav(samples: np.ndarray, rate: int) -> bytes:
    """16-bit PCM of samples (frames x channels)."""
    data = np.ascontiguousarray(samples, "<i2").tobytes()
    channels = samples.shape[1] if samples.ndim > 1 else 1
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def read_wav(data: bytes) -> tuple[int, np.ndarray]:
    if data[:4] != b"RIFF" or data[8:16] != b"WAVEfmt ":
        raise CodecError("no WAV file")
    kind, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", data, 20)
    size = struct.unpack_from("<I", data, 40)[0]
    if kind != 1 or bits != 16 or block != 2 * channels or len(data) != 44 + size or size % block:
        raise CodecError("no 16-bit PCM of whole frames")
    return rate, np.frombuffer(data, "<i2", offset=44).reshape(-1, channels)


def write_png(pixels: np.ndarray) -> bytes:
    """An RGB picture (height x width x 3 bytes)."""
    height, width, _ = pixels.shape
    rows = np.hstack([np.zeros((height, 1), np.uint8), np.ascontiguousarray(pixels, np.uint8).reshape(height, width * 3)])

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """A picture as write_png makes it."""
    at, size, parts = 8, None, []
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            size = struct.unpack_from(">II", data, at + 8)
        elif kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    if data[:8] != b"\x89PNG\r\n\x1a\n" or size is None:
        raise CodecError("no PNG file")
    return np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(size[1], 1 + 3 * size[0])[:, 1:].reshape(size[1], size[0], 3)
