"""BLAKE3-256 from the published specification, on numpy arrays: all chunks of all inputs of a batch go through the
compression function together, and so do all parents of one level of their trees."""

from __future__ import annotations

import numpy as np

# Fixed values of the specification.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64
#: Bytes of an input that are hashed at a time, a power of two of chunks; each such part is one node of the tree.
PART = 1 << 20

W = np.uint32
_IV = np.array(IV, W)[:, None]
_NEXT = np.array(PERMUTATION)
_EVEN, _ODD = np.arange(0, 8, 2), np.arange(1, 8, 2)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> W(n)) | (x << W(32 - n))


def _quarter(a, b, c, d, x, y):
    a = a + b + x
    d = _turn(d ^ a, 16)
    c = c + d
    b = _turn(b ^ c, 12)
    a = a + b + y
    d = _turn(d ^ a, 8)
    c = c + d
    return a, _turn(b ^ c, 7), c, d


def _compress(cv: np.ndarray, m: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Chaining values (8, n) of n blocks m (16, n)."""
    n = m.shape[1]
    a, b, c = cv[:4], cv[4:], np.broadcast_to(_IV[:4], (4, n))
    d = np.stack([(counter & 0xFFFFFFFF).astype(W), (counter >> 32).astype(W), length.astype(W), flags.astype(W)])
    for _ in range(7):
        a, b, c, d = _quarter(a, b, c, d, m[_EVEN], m[_ODD])
        a, b, c, d = _quarter(a, np.roll(b, -1, 0), np.roll(c, -2, 0), np.roll(d, -3, 0), m[_EVEN + 8], m[_ODD + 8])
        b, c, d = np.roll(b, 1, 0), np.roll(c, 2, 0), np.roll(d, 3, 0)
        m = m[_NEXT]
    return np.concatenate([a ^ c, b ^ d])


def _leaves(words: np.ndarray, size: np.ndarray, counter: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Chaining values of chunks: words (n, 16 blocks, 16), bytes of each, its place in its input, whether it is all."""
    cv = np.repeat(_IV, len(words), 1)
    blocks = np.maximum(1, -(-size // BLOCK))
    for j in range(CHUNK // BLOCK):
        on = np.flatnonzero(blocks > j)
        if not len(on):
            break
        last = blocks[on] == j + 1
        flags = (CHUNK_START if j == 0 else 0) | np.where(last, CHUNK_END | np.where(root[on], ROOT, 0), 0)
        cv[:, on] = _compress(cv[:, on], np.ascontiguousarray(words[on, j].T), counter[on], np.minimum(BLOCK, size[on] - BLOCK * j), flags)
    return cv


def _trees(cv: np.ndarray, owner: np.ndarray, root: bool) -> np.ndarray:
    """One chaining value an owner from those of its parts in order: neighbours join, an odd last one waits a level."""
    while True:
        first = np.append(True, owner[1:] != owner[:-1])
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(owner)))
        if size.max(initial=1) == 1:
            return cv
        place = np.arange(len(owner)) - np.repeat(start, size)
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < np.repeat(size, size)))
        two = np.repeat(size, size)[left] == 2
        n = len(left)
        joined = _compress(np.repeat(_IV, n, 1), np.concatenate([cv[:, left], cv[:, left + 1]]), np.zeros(n, np.int64), np.full(n, BLOCK), PARENT | np.where(two & root, ROOT, 0))
        cv = cv.copy()
        cv[:, left] = joined
        stay = place % 2 == 0
        cv, owner = cv[:, stay], owner[stay]


def _nodes(parts: list[bytes], base: int, root: bool) -> np.ndarray:
    """One chaining value for each part, of at most PART bytes, whose first chunk has the number `base`."""
    n = np.array([max(1, -(-len(p) // CHUNK)) for p in parts])
    words = np.frombuffer(b"".join(bytes(p).ljust(int(k) * CHUNK, b"\0") for p, k in zip(parts, n, strict=True)), "<u4").reshape(-1, CHUNK // BLOCK, 16)
    owner = np.repeat(np.arange(len(parts)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(CHUNK, np.repeat([len(p) for p in parts], n) - place * CHUNK)
    return _trees(_leaves(words, size, place + base, np.repeat(n == 1, n) & root), owner, root)


class Blake3:
    """As hashlib's objects; memory does not follow the length of the input but for 32 bytes a PART."""

    def __init__(self, data: bytes = b""):
        self.held, self.done = bytearray(), []
        self.update(data)

    def update(self, data: bytes) -> None:
        self.held += data
        while len(self.held) > PART:  # the last part waits, as it may be all there is
            self.done.append(_nodes([bytes(self.held[:PART])], len(self.done) * (PART // CHUNK), False))
            del self.held[:PART]

    def digest(self) -> bytes:
        last = _nodes([bytes(self.held)], len(self.done) * (PART // CHUNK), not self.done)
        cv = np.concatenate([*self.done, last], 1)
        return _trees(cv, np.zeros(cv.shape[1], int), True).astype("<u4").T.tobytes()

    def hexdigest(self) -> str:
        return self.digest().hex()


def blake3(data: bytes) -> bytes:
    return Blake3(data).digest()


def blake3_many(items: list[bytes]) -> list[bytes]:
    """Digests of many inputs; those of at most PART bytes are hashed together, about a PART at a time."""
    out: list[bytes | None] = [blake3(x) if len(x) > PART else None for x in items]
    now, held = [], 0
    small = [i for i, d in enumerate(out) if d is None]
    for k, i in enumerate(small):
        now.append(i)
        held += max(CHUNK, len(items[i]))
        if held >= PART or k + 1 == len(small):
            cv = _nodes([items[j] for j in now], 0, True).astype("<u4").T
            for j, d in zip(now, np.ascontiguousarray(cv), strict=True):
                out[j] = d.tobytes()
            now, held = [], 0
    return out
