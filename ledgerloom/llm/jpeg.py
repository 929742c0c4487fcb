"""Baseline JPEG frames in grey: writing blocks of one sample, and reading the luminance of any such frame.

``encode_samples`` stores each byte as an 8 x 8 block of one value. Its DC
coefficient is eight times the value less 128, which a quantiser of 8 keeps
whole, so every baseline decoder gives the byte back. The Huffman code of a DC
category of c bits has 9 - c bits, and the only AC symbol ends the block, so
each block has ten bits and whole scans are written and read as bit matrices.
"""

import struct

import numpy as np

from ledgerloom.llm.scratch import per_process

#: The DCT coefficients of a block in the order in which a JPEG scan lists them (row by row, as 8 * v + u).
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
_QUANT = 8
_BITS = 10


class NotAFrame(ValueError):
    """The bytes are no baseline frame that this reader knows."""


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">HH", 0xFF00 | marker, len(body) + 2) + body


def _table(kind: int, codes: dict[int, int]) -> bytes:
    """A DHT body: ``codes`` has the length of each symbol's code."""
    order = sorted(codes, key=lambda s: (codes[s], s))
    return bytes([kind]) + bytes(sum(n == k for n in codes.values()) for k in range(1, 17)) + bytes(order)


def _words() -> np.ndarray:
    """The ten bits of a block for each difference from -255 to 255: its category's code, its extra bits, the end of the block."""
    diff = np.arange(-255, 256)
    size = sum((np.abs(diff) >= 1 << c).astype(np.int64) for c in range(9))
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    return ((((1 << (9 - size)) - 2) << size) + extra) << 1  # 8 extra bits have the code 0, 7 have 10, 6 have 110, ...


def encode_samples(samples: np.ndarray) -> bytes:
    """A grey baseline frame with one 8 x 8 block for each sample of a matrix of bytes."""
    high, wide = samples.shape
    values = samples.reshape(-1).astype(np.int64) - 128
    n = len(values)
    words = np.full(-(-n // 4) * 4, (1 << _BITS) - 1)
    words[:n] = per_process("jpeg words", _words)[np.diff(values, prepend=0) + 255]
    fours = words.reshape(-1, 4) @ (1 << _BITS * np.arange(3, -1, -1))
    packed = (fours << 24).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5].reshape(-1)[: -(-n * _BITS // 8)]
    scan = packed.tobytes().replace(b"\xff", b"\xff\x00")
    frame = struct.pack(">BHHB", 8, 8 * high, 8 * wide, 1) + bytes([1, 0x11, 0])
    return b"".join([
        b"\xff\xd8", _segment(0xDB, bytes([0]) + bytes([_QUANT] * 64)), _segment(0xC0, frame),
        _segment(0xC4, _table(0x00, {c: 9 - c for c in range(9)}) + _table(0x10, {0: 1})),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])), scan, b"\xff\xd9",
    ])


def _segments(data: bytes):
    """(marker, body) of each segment; for the scan, its entropy-coded bytes with their stuffing too."""
    if data[:2] != b"\xff\xd8":
        raise NotAFrame("no start of image")
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise NotAFrame("no marker")
        marker = data[at + 1]
        if marker in (0xFF, 0x01):
            at += 1 + (marker == 0x01)
            continue
        if marker == 0xD9:
            return
        (n,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDA:
            end = at
            while (end := data.find(b"\xff", end)) >= 0 and (data[end + 1 : end + 2] == b"\x00" or 0xD0 <= data[end + 1 : end + 2][:1].ljust(1, b"\xd9")[0] <= 0xD7):
                end += 2
            end = len(data) if end < 0 else end
            yield marker, body + data[at:end]
            at = end
        else:
            yield marker, body


def _codes(body: bytes) -> dict[int, dict[tuple[int, int], int]]:
    """Tables of a DHT body by class and number: symbol of (length, code)."""
    out, at = {}, 0
    while at + 17 <= len(body):
        counts, table, code = body[at + 1 : at + 17], {}, 0
        symbols = iter(body[at + 17 : at + 17 + sum(counts)])
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                table[n, code] = next(symbols)
                code += 1
            code <<= 1
        out[body[at]] = table
        at += 17 + sum(counts)
    return out


def _constant(table: dict[tuple[int, int], int]) -> int:
    """Bits of any difference with its code, if all have as many; else 0."""
    lengths = {n + s for (n, _), s in table.items()}
    return lengths.pop() if len(lengths) == 1 else 0


def _uniform(scan: bytes, n: int, dc: dict[tuple[int, int], int], width: int) -> np.ndarray:
    """Differences of ``n`` blocks of DC code, extra bits and an end-of-block code, all of one width."""
    value = np.zeros(1 << width, np.int64)
    for (length, code), size in dc.items():
        extra = np.arange(1 << size)
        value[(code << size) + extra] = np.where(extra >= 1 << size >> 1, extra, extra - (1 << size) + 1) if size else 0
    bit = np.arange(n) * (width + 1)
    data = np.frombuffer(scan + bytes(4), np.uint8).astype(np.uint32)
    window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    return value[(window[bit >> 3] >> (32 - width - (bit & 7)).astype(np.uint32)) & ((1 << width) - 1)]


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)
        self.bits = f"{self.value:0{self.left}b}" if data else ""
        self.at = 0

    def take(self, n: int) -> int:
        self.at += n
        if self.at > len(self.bits):
            raise NotAFrame("the scan ends early")
        return int(self.bits[self.at - n : self.at] or "0", 2)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise NotAFrame("no such code")

    def number(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _basis() -> np.ndarray:
    k = np.arange(8)
    out = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    out[0] /= np.sqrt(2)
    return out


def luminance(data: bytes) -> np.ndarray:
    """The luminance of a frame: the mean of each 8 x 8 block where blocks have DC only and one component, else all samples."""
    quant, tables, frame, restart = {}, {}, None, 0
    for marker, body in _segments(data):
        if marker == 0xDB:
            at = 0
            while at < len(body):
                wide = body[at] >> 4
                quant[body[at] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, at + 1).astype(np.int64)
                at += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            tables |= _codes(body)
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body[:2])
        elif marker in (0xC0, 0xC1):
            frame = body
        elif 0xC0 < marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise NotAFrame("not a baseline frame")
        elif marker == 0xDA:
            if frame is None:
                raise NotAFrame("no frame header")
            return _scan(body, frame, quant, tables, restart)
    raise NotAFrame("no scan")


def _scan(body: bytes, frame: bytes, quant: dict, tables: dict, restart: int) -> np.ndarray:
    depth, high, wide, n_parts = struct.unpack_from(">BHHB", frame)
    if depth != 8 or body[0] != n_parts:
        raise NotAFrame("8-bit interleaved scans only")
    parts = [(frame[6 + 3 * k], frame[7 + 3 * k] >> 4, frame[7 + 3 * k] & 15, frame[8 + 3 * k]) for k in range(n_parts)]
    chosen = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(n_parts)}
    scan = body[1 + 2 * n_parts + 3 :]
    try:
        dc, ac = {p[0]: tables[chosen[p[0]][0]] for p in parts}, {p[0]: tables[16 + chosen[p[0]][1]] for p in parts}
    except KeyError as x:
        raise NotAFrame("a table is missing") from x
    if n_parts == 1 and not restart and (width := _constant(dc[parts[0][0]])) and ac[parts[0][0]] == {(1, 0): 0}:
        h, w = -(-high // 8), -(-wide // 8)
        plain = scan.replace(b"\xff\x00", b"\xff")
        if 8 * len(plain) < h * w * (width + 1):
            raise NotAFrame("the scan ends early")
        level = np.cumsum(_uniform(plain, h * w, dc[parts[0][0]], width)) * quant[parts[0][3]][0]
        return np.clip(((level + 4) >> 3) + 128, 0, 255).astype(np.uint8).reshape(h, w)
    return _general(scan, parts, dc, ac, quant, high, wide, restart)


def _general(scan: bytes, parts: list, dc: dict, ac: dict, quant: dict, high: int, wide: int, restart: int) -> np.ndarray:
    """All luminance samples, bit by bit: for frames of other writers."""
    h_most, v_most = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        parts, h_most, v_most = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    across, down = -(-wide // (8 * h_most)), -(-high // (8 * v_most))
    first, basis = parts[0], _basis()
    out = np.zeros((down * first[2] * 8, across * first[1] * 8), np.uint8)
    pieces, at = [], 0
    for k in range(len(scan) - 1):
        if scan[k] == 0xFF and 0xD0 <= scan[k + 1] <= 0xD7:
            pieces.append(scan[at:k])
            at = k + 2
    pieces = [_Bits(p.replace(b"\xff\x00", b"\xff")) for p in (*pieces, scan[at:])]
    each = restart or across * down
    for unit in range(across * down):
        if unit % each == 0:
            if unit // each >= len(pieces):
                raise NotAFrame("a restart interval is missing")
            bits, before = pieces[unit // each], dict.fromkeys(dc, 0)
        for name, h, v, q in parts:
            for b in range(h * v):
                block = np.zeros(64)
                before[name] += bits.number(bits.symbol(dc[name]))
                block[0] = before[name] * quant[q][0]
                k = 1
                while k < 64:
                    run, size = divmod(bits.symbol(ac[name]), 16)
                    if not size and run < 15:
                        break
                    k += run
                    if k > 63:
                        raise NotAFrame("too many coefficients")
                    block[ZIGZAG[k]] = bits.number(size) * quant[q][k]
                    k += 1
                if name == first[0]:
                    y, x = (unit // across * v + b // h) * 8, (unit % across * h + b % h) * 8
                    out[y : y + 8, x : x + 8] = np.clip(np.rint(basis.T @ block.reshape(8, 8) @ basis + 128), 0, 255)
    return out[:high, :wide]
