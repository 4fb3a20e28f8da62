"""Whole numbers and words as compressed bytes, for blocks of coded text in tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_CODEC = "zstd"


def squeeze(a: np.ndarray) -> bytes:
    """Non-negative whole numbers, compressed: 8 bytes of length, then the numbers' bytes plane by plane."""
    a = np.asarray(a)
    width = 4 if not len(a) or int(a.max()) < 1 << 32 else 8
    planes = a.astype(np.uint32 if width == 4 else np.uint64).view(np.uint8).reshape(-1, width).T.tobytes()
    return (len(a) * 16 + width).to_bytes(8, "little") + pa.compress(planes, codec=_CODEC, asbytes=True)


def unsqueeze(data) -> np.ndarray:
    """The numbers of ``squeeze``, as longs."""
    head = int.from_bytes(bytes(memoryview(data)[:8]), "little")
    n, width = head // 16, head % 16
    raw = pa.decompress(memoryview(data)[8:], decompressed_size=n * width, codec=_CODEC, asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(np.uint32 if width == 4 else np.uint64).ravel().astype(np.int64)


def squeeze_words(words: list[bytes]) -> bytes:
    """Words of any bytes: 8 bytes of the sizes' length, the sizes, the bytes."""
    sizes, data = squeeze(np.array([len(w) for w in words], np.int64)), b"".join(words)
    return len(sizes).to_bytes(8, "little") + sizes + len(data).to_bytes(8, "little") + pa.compress(data, codec=_CODEC, asbytes=True)


def unsqueeze_words(data) -> list[bytes]:
    view = memoryview(data)
    k = int.from_bytes(bytes(view[:8]), "little")
    ends = np.cumsum(unsqueeze(view[8 : 8 + k])).tolist()
    size = int.from_bytes(bytes(view[8 + k : 16 + k]), "little")
    raw = pa.decompress(view[16 + k :], decompressed_size=size, codec=_CODEC, asbytes=True)
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Each word's number among the distinct ones, the distinct words (the commonest first), and their counts."""
    d = words.dictionary_encode()
    index = np.asarray(d.indices).astype(np.int64)
    counts = np.bincount(index, minlength=len(d.dictionary))
    order = np.argsort(-counts, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return number[index], d.dictionary.take(pa.array(order)), counts[order]


def gathered(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places begin[i] .. begin[i] + size[i] - 1 of all i, one after the other."""
    total = np.append(0, np.cumsum(size))
    return np.arange(total[-1]) - np.repeat(total[:-1] - begin, size)
