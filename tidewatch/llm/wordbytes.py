"""Words of many texts at once, as places in their UTF-8 bytes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled together; more than one text only up to here.
PART_BYTES = 4_000_000
#: Words up to this length are digested side by side, longer ones one by one.
SHORT = 48


def laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, null as empty, and where each begins (with the end)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n, _, places, data = len(texts), *texts.buffers()
    at = np.frombuffer(places, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def parts(texts: pa.Array, most: int = PART_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, places) of neighbouring texts that have ``most`` bytes together, or of one longer text."""
    flat, at = laid_out(texts)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, flat[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are ``inside``; no run goes on from one text to the next."""
    first = np.append(True, ~inside[:-1])[: len(inside)]
    last = np.append(~inside[1:], True)[: len(inside)]
    first[at[:-1][at[:-1] < len(inside)]] = True
    last[at[1:][at[1:] > 0] - 1] = True
    return np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1


def owners(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of the text in which each place lies."""
    return np.searchsorted(at, starts, "right") - 1


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def crc32(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Unsigned CRC-32 of the bytes of each word, going on from the values ``before``."""
    out = np.zeros(len(starts), np.uint32) if before is None else before.astype(np.uint32)
    order = np.argsort(-lengths, kind="stable")
    long = int(np.searchsorted(-lengths[order], -SHORT))
    for k in order[:long].tolist():
        out[k] = zlib.crc32(flat[starts[k] : starts[k] + lengths[k]], int(out[k]))
    order = order[long:]
    begin, n, state = starts[order], lengths[order], ~out[order]
    for i in range(int(n[0]) if len(n) else 0):
        k = int(np.searchsorted(-n, -i))  # the words that are longer than i
        state[:k] = CRC[(state[:k] ^ flat[begin[:k] + i]) & 255] ^ (state[:k] >> 8)
    out[order] = ~state
    return out
