"""Words of many texts at once: places, hashes and hashes of word sequences, as numpy arrays."""

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_FACTORS = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(256)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: bytes hashed at once; bounds the memory of one very long text
_BLOCK = 1 << 18


def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(_BLOCK, base, np.uint64)]))


_WEIGHT, _BACK = _powers(_BASE), _powers(_INVERSE)


class Words:
    """The words of a list of texts (bytes or None), what ``space`` (by byte) parts: row, start, end and 64-bit hash of each.

    Words are ``[^\\x20\\x09-\\x0D]+`` unless told otherwise. ``buffer`` holds the texts joined by spaces, lower-cased (A-Z)
    on demand. A word's hash depends on its bytes only; equal hashes are taken as a hint, never as proof.
    """

    def __init__(self, texts: list, lower: bool = False, space: np.ndarray = _SPACE):
        self.buffer = b" ".join(t or b"" for t in texts)
        data = np.frombuffer(self.buffer, np.uint8)
        if lower:
            data = _LOWER[data]
            self.buffer = data.tobytes()
        self.data = data
        ink = np.zeros(len(data) + 2, bool)
        np.logical_not(space[data], out=ink[1:-1])
        edge = np.flatnonzero(ink[1:] != ink[:-1])
        del ink
        self.start, self.end = edge[::2], edge[1::2]
        sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.row = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.row, np.arange(len(texts) + 1))
        self.hash = self.prefix(None)

    def __len__(self):
        return len(self.start)

    def prefix(self, size: int | None) -> np.ndarray:
        """Hash of the first ``size`` bytes of each word, of the whole word if it is shorter or ``size`` is None."""
        end = self.end if size is None else np.minimum(self.end, self.start + size)
        out, i = np.empty(len(self), np.uint64), 0
        while i < len(self):
            base = int(self.start[i])
            j = int(np.searchsorted(end, base + _BLOCK, side="right"))
            if j <= i:  # a word longer than a block
                total = 0
                for at in range(base, int(end[i]), _BLOCK):
                    part = self.data[at:min(at + _BLOCK, int(end[i]))].astype(np.uint64) + np.uint64(1)
                    total += int((part * _WEIGHT[:len(part)]).sum()) * pow(_BASE, at - base, 1 << 64)
                out[i], i = total % (1 << 64), i + 1
                continue
            part = self.data[base:int(end[j - 1])].astype(np.uint64) + np.uint64(1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * _WEIGHT[:len(part)], out=total[1:])
            first = self.start[i:j] - base
            out[i:j] = (total[end[i:j] - base] - total[first]) * _BACK[first]
            i = j
        return mixed(out)

    def grams(self, n: int) -> np.ndarray:
        """Hash of the ``n`` words from each word on; sequences that leave their row have a hash too, see :meth:`inside`."""
        count = max(0, len(self) - n + 1)
        out = np.zeros(count, np.uint64)
        for k in range(n):
            out += self.hash[k:k + count] * _FACTORS[k % 256]
        return mixed(out)

    def inside(self, n: int) -> np.ndarray:
        """Whether the ``n`` words from each word on are all of one row."""
        count = max(0, len(self) - n + 1)
        return self.row[:count] == self.row[n - 1:n - 1 + count]

    def bytes_of(self, i: int) -> list[bytes]:
        """The words of row ``i``."""
        lo, hi = self.offsets[i], self.offsets[i + 1]
        return self.buffer[lo:hi].split()


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    have = 1
    out = values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out
