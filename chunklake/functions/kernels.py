"""Byte kernels: content-defined cuts, min-hash features, compression and deltas. Numpy inside, one content at a time."""

from __future__ import annotations

import zlib

import numpy as np
import zstandard

#: Fixed values of the cut rule: least and largest block, size up to which the strict test holds, and the tests' shifts.
LEAST, NORMAL, LARGEST = 4_096, 16_384, 65_536
STRICT, LOOSE = 48, 52
#: Bytes that a rolling hash spans.
WINDOW = 64
#: Multipliers of the three features.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Blocks under this size aren't stored as deltas.
DELTA_LEAST = 1_024
_MASK = (1 << 64) - 1


def _table(seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """256 values of a xorshift generator (13, 7, 17), each taken after its step."""
    out, x = [], seed
    for _ in range(256):
        x ^= x << 13 & _MASK
        x ^= x >> 7
        x ^= x << 17 & _MASK
        out.append(x)
    return np.array(out, np.uint64)


GEAR = _table()


def rolling(raw: np.ndarray) -> np.ndarray:
    """At each byte the sum of gear values of the last 64 bytes, each shifted by its age: six doublings of the span."""
    h = GEAR[raw]
    for span in (1, 2, 4, 8, 16, 32):
        longer = h.copy()
        longer[span:] += h[:-span] << np.uint64(span)
        h = longer
    return h


def cut_points(data: bytes) -> list[int]:
    """Ends of the blocks of a content; none for an empty one. The hash starts afresh ``LEAST`` bytes into each block."""
    raw, ends, start = np.frombuffer(data, np.uint8), [], 0
    while start < len(raw):
        rest = min(len(raw) - start, LARGEST)
        end = start + rest
        if rest > LEAST:
            h = rolling(raw[start + LEAST : end])
            strict = np.flatnonzero(h[: NORMAL - LEAST] >> np.uint64(STRICT) == 0)
            loose = np.flatnonzero(h[NORMAL - LEAST :] >> np.uint64(LOOSE) == 0)
            if len(strict):
                end = start + LEAST + int(strict[0]) + 1
            elif len(loose):
                end = start + NORMAL + int(loose[0]) + 1
        ends.append(end)
        start = end
    return ends


def block_features(data: bytes) -> list[int]:
    """Three unsigned minima over all windows, as signed integers; all ones if the block is under a window."""
    if len(data) < WINDOW:
        return [-1] * len(MULTIPLIERS)
    h = rolling(np.frombuffer(data, np.uint8))[WINDOW - 1 :]
    out = []
    for m in MULTIPLIERS:
        x = h * np.uint64(m)
        out.append(int((x ^ x >> np.uint64(31)).min().astype(np.uint64).view(np.int64)))
    return out


def compress(data: bytes, level: int = 3) -> bytes:
    """Compressed bytes, copied: what the compressor returns keeps a buffer of the size of ``data`` behind it."""
    return bytes(memoryview(zstandard.ZstdCompressor(level=level).compress(data)))


def decompress(data: bytes, size: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, size))


def frame_form(data: bytes, level: int = 3) -> tuple[int, bytes]:
    """(codec, bytes) of a frame: compressed if that saves 2 % at least, else raw."""
    packed = compress(data, level)
    return (1, packed) if len(packed) * 100 < len(data) * 98 else (0, data)


def worth_compressing(data: bytes, probe: int = 32 << 10, whole: int = 256 << 10) -> bool:
    """Whether a frame is likely to shrink: small ones always; else if one of four probes does, or the whole at a fast level."""
    if len(data) <= whole:
        return True
    step = (len(data) - probe) // 3
    for k in range(4):
        part = data[k * step : k * step + probe]
        if len(compress(part, 1)) * 100 < len(part) * 97:
            return True
    return len(compress(data, 1)) * 100 < len(data) * 99


def encode_delta(block: bytes, base: bytes) -> bytes | None:
    """``block`` against ``base``; null unless it takes, with the base's name, under half and reads back."""
    if len(block) < DELTA_LEAST:
        return None
    like = zstandard.ZstdCompressionDict(base, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packed = bytes(memoryview(zstandard.ZstdCompressor(level=3, dict_data=like).compress(block)))
    return packed if 32 + len(packed) < len(block) // 2 and decode_delta(packed, base, len(block)) == block else None


def decode_delta(packed: bytes, base: bytes, size: int) -> bytes:
    like = zstandard.ZstdCompressionDict(base, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdDecompressor(dict_data=like).decompress(packed, max_output_size=max(1, size))


#: Levels that may have made a zlib stream, by the level bits of its header.
LEVELS = {0: (1, 0), 1: (2, 3, 4, 5), 2: (6,), 3: (9, 7, 8)}


def unzlib(data: bytes, most_in: int = 32 << 20, most_out: int = 128 << 20) -> tuple[bytes, int] | None:
    """(plain, level) if ``data`` is one zlib stream that compressing at a level makes again byte for byte."""
    if len(data) < 2 or len(data) > most_in or data[0] & 15 != 8 or data[0] >> 4 > 7 or int.from_bytes(data[:2], "big") % 31 or data[1] & 32:
        return None
    stream = zlib.decompressobj()
    try:
        plain = stream.decompress(data, most_out)
    except zlib.error:
        return None
    if not stream.eof or stream.unused_data:
        return None
    return next(((plain, level) for level in LEVELS[data[1] >> 6] if zlib.compress(plain, level) == data), None)
