"""Hashed character n-grams of text batches, as presence features."""
from __future__ import annotations

import numpy as np

CHUNK_CHARS = 1 << 19
# Cells of one matrix of ``presence``, one byte each.
MATRIX_CELLS = 1 << 23


def chunks(texts: list[str | None]):
    """(first text, code points, text index of each): lower-cased, texts apart by a 0, long ones cut into overlapping parts."""
    group, first, held = [], 0, 0
    for i, text in enumerate(texts):
        text = (text or "").replace("\x00", " ")
        if held and held + len(text) > CHUNK_CHARS:
            yield _points(group, first)
            group, held = [], 0
        if not held:
            first = i
            group = []
        if len(text) > CHUNK_CHARS:
            for at in range(0, len(text), CHUNK_CHARS):
                yield _points([text[max(0, at - 8):at + CHUNK_CHARS]], i)
            held = 0
            group = []
            continue
        group.append(text)
        held += len(text) + 1
    if held:
        yield _points(group, first)


def _points(group, first):
    points = np.frombuffer("\x00".join(group).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return first, points, np.cumsum(points == 0, dtype=np.int32)


def buckets(points: np.ndarray, owner: np.ndarray, sizes: tuple[int, ...], bits: int):
    """For each n in ``sizes``: (bucket, owner) of every n-gram that lies within one text."""
    rolled = points * np.uint32(0x9E3779B1)
    n = 1
    for size in sizes:
        while n < size:
            rolled = rolled[:-1] * np.uint32(0x85EBCA6B) + points[n:] * np.uint32(0xC2B2AE35)
            n += 1
        if len(rolled) == 0:
            return
        inside = (points[:len(rolled)] != 0) & (owner[:len(rolled)] == owner[n - 1:])
        mixed = rolled ^ (rolled >> np.uint32(15))
        mixed = (mixed + np.uint32(0x165667B1 * size & 0xFFFFFFFF)) * np.uint32(0x27D4EB2F)
        yield (mixed >> np.uint32(32 - bits))[inside].astype(np.int64), owner[:len(rolled)][inside]


def presence(texts: list[str | None], sizes: tuple[int, ...], bits: int, cells: int = MATRIX_CELLS):
    """Batches (slice of texts, boolean matrix text x bucket) with few enough texts for a matrix of ``cells``."""
    step = max(1, cells >> bits)
    for at in range(0, len(texts), step):
        part = texts[at:at + step]
        matrix = np.zeros((len(part), 1 << bits), bool)
        for first, points, owner in chunks(part):
            flat = matrix.reshape(-1)
            for bucket, own in buckets(points, owner, sizes, bits):
                flat[((own.astype(np.int64) + first) << bits) + bucket] = True
        yield slice(at, at + len(part)), matrix
