"""Words and their hashes for many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

from controlweave.llm.tables import CHUNK_BYTES

U64 = np.uint64
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Besides white space, ASCII marks that are neither letters nor digits end a word.
_MARKS = _SPACES.copy()
_MARKS[[i for i in range(128) if not chr(i).isalnum()]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_VALUES = mixed(np.arange(1, 257, dtype=U64))[_FOLD]
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        n = max(n, CHUNK_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(n, base, U64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


class Words:
    """The words of consecutive texts.

    ``starts`` and ``ends`` are byte positions in ``data``, ``text`` the index of each word's text,
    ``first`` the index of each text's first word (one more entry at the end), ``hashes`` 64-bit
    hashes that ignore the case of A-Z and don't depend on the position.
    """

    def __init__(self, texts: list[bytes], marks: bool = False) -> None:
        joined = b"\n".join([*texts, b""])
        self.data = data = np.frombuffer(joined, np.uint8)
        inside = ~(_MARKS if marks else _SPACES)[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edges = np.concatenate([[0], edges])
        self.starts, self.ends = edges[0::2], edges[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.begins = np.concatenate([[0], np.cumsum(lengths)])
        self.first = np.searchsorted(self.starts, self.begins)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            up, down = _power_tables(len(self.data) + 1)
            total = np.zeros(len(self.data) + 1, U64)
            np.cumsum(_VALUES[self.data] * up[: len(self.data)], out=total[1:])
            self._hashes = mixed((total[self.ends] - total[self.starts]) * down[self.starts])
        return self._hashes

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words of one text, and the index of each run's first word."""
        h = self.hashes
        if len(h) < n:
            return np.empty(0, U64), np.empty(0, np.int64)
        at = np.flatnonzero(self.text[: len(h) - n + 1] == self.text[n - 1 :])
        return combined([h[at + k] for k in range(n)]), at


def combined(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several, in their order."""
    out = np.zeros(len(parts[0]), U64)
    for part in parts:
        out = mixed(out * U64(_BASE) + part)
    return out


def text_hashes(text: bytes, marks: bool = False) -> np.ndarray:
    """Hashes of one text's words."""
    return Words([text], marks).hashes
