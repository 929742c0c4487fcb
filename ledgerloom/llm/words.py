"""Words of a text as numbers: runs of characters other than ASCII white space, A-Z in lower case."""

import numpy as np

#: Bytes of a text that are hashed at once.
_CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit numbers from 64-bit numbers."""
    values = values ^ (values >> np.uint64(30))
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _letters() -> np.ndarray:
    """A number for each byte, the same for A-Z and a-z; 0 for white space."""
    points = np.arange(256)
    upper = (points >= 65) & (points <= 90)
    numbers = mixed((points + 32 * upper + 1).astype(np.uint64) * _ODD)
    numbers[(points == 32) | ((points >= 9) & (points <= 13))] = 0
    return numbers


_LETTERS = _letters()
_POWERS = np.cumprod(np.full(256, _ODD))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, in order: a polynomial over the numbers of its bytes. Long texts are hashed in chunks that end between words."""
    data = text.encode() if isinstance(text, str) else b""
    if len(data) <= _CHUNK:
        return _hashes(data)
    out, at = [], 0
    while at < len(data):
        end = at + _CHUNK
        while end < len(data) and _LETTERS[data[end]]:
            end += 1
        out.append(_hashes(data[at:end]))
        at = end
    return np.concatenate(out)


def _hashes(data: bytes) -> np.ndarray:
    numbers = _LETTERS[np.frombuffer(data, np.uint8)]
    inner = numbers != 0
    begins = inner.copy()
    begins[1:] &= ~inner[:-1]
    first = np.flatnonzero(begins)
    if not len(first):
        return np.zeros(0, np.uint64)
    numbers, first = numbers[first[0] :], first - first[0]
    place = np.arange(len(numbers)) - np.repeat(first, np.diff(first, append=len(numbers)))
    most = int(place.max()) + 1
    powers = _POWERS if most <= len(_POWERS) else np.cumprod(np.full(most, _ODD))
    return mixed(np.add.reduceat(numbers * powers[place], first))
