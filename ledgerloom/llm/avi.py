"""AVI files of motion-JPEG: writing bytes as grey frames, reading indexes and frames, and finding shots.

A table of media goes in, a table of timed clips comes out. Payloads are stored
as frames of ``ROW`` samples a row (see ``jpeg``), so that reading a file back
gives every byte.
"""

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.jpeg import NotAFrame, encode_samples, luminance
from ledgerloom.llm.scratch import small_batches

#: Samples in a row of a stored payload, and rows of its frames at most.
ROW, ROWS = 64, 128
_RATE = 25
_KEY = 0x10

CLIPS = "clip int, first_frame int, last_frame int, start_s double, end_s double, mean_luma double"


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, *chunks: bytes) -> bytes:
    return _chunk(b"LIST", kind + b"".join(chunks))


def write_avi(payload: bytes) -> bytes:
    """A motion-JPEG AVI of the payload, which is a positive multiple of ``ROW`` bytes; the last frame is filled with zeros."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    high = min(ROWS, len(rows))
    frames = []
    for at in range(0, len(rows), high):
        frame = rows[at : at + high]
        frames.append(encode_samples(np.pad(frame, ((0, high - len(frame)), (0, 0)))))
    most = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // _RATE, most * _RATE, 0, _KEY, len(frames), 0, 1, most, 8 * ROW, 8 * high, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, _RATE, 0, len(frames), most, 0, 0, 0, 0, 8 * ROW, 8 * high)
    picture = struct.pack("<IiiHH4sIiiII", 40, 8 * ROW, 8 * high, 1, 24, b"MJPG", most, 0, 0, 0, 0)
    heads = _list(b"hdrl", _chunk(b"avih", main), _list(b"strl", _chunk(b"strh", stream), _chunk(b"strf", picture)))
    info = _list(b"INFO", _chunk(b"ICMT", f"payload={len(payload)}".encode() + b"\0"))
    chunks, index, at = [], [], 4
    for frame in frames:
        chunks.append(_chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", _KEY, at, len(frame)))
        at += len(chunks[-1])
    return _chunk(b"RIFF", b"AVI " + heads + info + _list(b"movi", *chunks) + _chunk(b"idx1", b"".join(index)))


@dataclass
class Video:
    """What a file's headers and index say; ``frames`` are (start, length) in the file."""

    seconds_a_frame: float
    frames: list[tuple[int, int]]
    comment: str = ""


def _walk(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, length) of the chunks of a list; one that runs past the end is cut there."""
    while at + 8 <= end:
        name, n = struct.unpack_from("<4sI", data, at)
        yield name, at + 8, min(n, end - at - 8)
        at += 8 + n + n % 2


def parse_avi(data: bytes) -> Video:
    """The video stream of an AVI file, by its index; by walking the frames where it has none that fits."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise NotAFrame("not an AVI file")
    rate, movi, index, comment, stream, video = 1 / _RATE, None, b"", "", -1, None
    todo = [_walk(data, 12, len(data))]
    while todo:
        found = next(todo[-1], None)
        if found is None:
            todo.pop()
            continue
        name, at, n = found
        if name == b"LIST" and data[at : at + 4] in (b"hdrl", b"strl", b"INFO"):
            todo.append(_walk(data, at + 4, at + n))
        elif name == b"LIST" and data[at : at + 4] == b"movi":
            movi = (at, n)
        elif name == b"avih" and n >= 4:
            rate = struct.unpack_from("<I", data, at)[0] / 1e6 or rate
        elif name == b"strh" and n >= 28:
            stream += 1
            scale, per = struct.unpack_from("<II", data, at + 20)
            if data[at : at + 4] == b"vids" and video is None:
                video, rate = stream, scale / per if scale and per else rate
        elif name == b"ICMT":
            comment = data[at : at + n].rstrip(b"\0").decode("utf-8", "replace")
        elif name == b"idx1":
            index = data[at : at + n]
    if movi is None or video is None:
        raise NotAFrame("no video stream")
    tags = (f"{video:02d}dc".encode(), f"{video:02d}db".encode())
    entries = [e for e in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]) if e[0] in tags]
    for base in (movi[0], 0):  # offsets count from the list's name, in some files from the start of the file
        if entries and all(data[base + at : base + at + 4] == tag for tag, _, at, _ in entries):
            return Video(rate, [(base + at + 8, n) for _, _, at, n in entries], comment)
    frames = []
    todo = [_walk(data, movi[0] + 4, movi[0] + movi[1])]
    while todo:
        found = next(todo[-1], None)
        if found is None:
            todo.pop()
        elif found[0] == b"LIST":
            todo.append(_walk(data, found[1] + 4, found[1] + found[2]))
        elif found[0] in tags:
            frames.append(found[1:])
    return Video(rate, frames, comment)


def frames_of(data: bytes, video: Video) -> Iterator[np.ndarray]:
    """The luminance of each frame; an empty frame repeats the one before it."""
    last = None
    for at, n in video.frames:
        if n or last is None:
            last = luminance(data[at : at + n])
        yield last


def read_payload(data: bytes) -> bytes:
    """The bytes that ``write_avi`` stored."""
    video = parse_avi(data)
    _, _, length = video.comment.partition("payload=")
    whole = b"".join(f.tobytes() for f in frames_of(data, video))
    return whole[: int(length)] if length.isdigit() else whole


def shots(frames: Iterator[np.ndarray], seconds_a_frame: float, *, reach: int = 8, times: float = 3.0, least: float = 0.05) -> list[tuple]:
    """Clips (clip, first_frame, last_frame, start_s, end_s, mean_luma) between cuts.

    A frame starts a shot if the difference of its 64-bin histogram from the
    frame before is over ``least`` and over the mean plus ``times`` the standard
    deviation of the differences of the last ``reach`` frames of its shot (over
    0.4 where there are none).
    """
    out, recent, before, k = [], [], None, -1
    for k, frame in enumerate(frames):
        now = np.bincount(frame.reshape(-1) >> 2, minlength=64) / frame.size
        cut = before is None
        if before is not None:
            diff = float(np.abs(now - before).sum()) / 2
            bound = np.mean(recent) + times * np.std(recent) if recent else 0.4
            cut = diff > max(least, bound)
            recent = [] if cut else [*recent, diff][-reach:]
        if cut:
            out.append([len(out), k, k, 0.0, 0])
        out[-1][2] = k
        out[-1][3] += float(frame.mean(dtype=np.float64))
        before = now
    return [(c, a, b, round(a * seconds_a_frame, 6), round((b + 1) * seconds_a_frame, 6), round(luma / (b - a + 1), 6)) for c, a, b, luma, _ in out]


def clips_of(data: bytes | None) -> list[tuple]:
    """The clips of a file; none where it is missing, no AVI or has a frame that can't be decoded."""
    try:
        video = parse_avi(data or b"")
        return shots(frames_of(data, video), video.seconds_a_frame)
    except (NotAFrame, struct.error):
        return []


def timed_clips(media: DataFrame) -> DataFrame:
    """A row per clip of each row of ``media`` (media_id, avi): media_id and the clip's columns.

    Rows whose ``avi`` is null, empty or no readable motion-JPEG file have no
    clips. Repeated rows have their clips again. Other columns are not read.
    """
    small_batches(media.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(m, *clip) for m, data in zip(batch["media_id"], batch["avi"], strict=True) for clip in clips_of(data)]
            yield pd.DataFrame(rows, columns=["media_id", "clip", "first_frame", "last_frame", "start_s", "end_s", "mean_luma"]).astype({"media_id": "Int64"})

    return media.select(F.col("media_id").cast("long").alias("media_id"), F.col("avi").cast("binary").alias("avi")).mapInPandas(run, f"media_id long, {CLIPS}")


def stored_texts(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as media (media_id, n_bytes, avi): each text in UTF-8, zeros up to a positive multiple of ``ROW``.

    A null text is empty and is stored as ``ROW`` zeros; a very long one has as
    many frames as it needs. A null doc_id stays null; repeated rows are stored
    again, alike; an empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t.encode() if isinstance(t, str) else b"" for t in batch["text"]]
            avi = [write_avi(t.ljust(max(1, -(-len(t) // ROW)) * ROW, b"\0")) for t in texts]
            yield pd.DataFrame({"media_id": batch["doc_id"].astype("Int64"), "n_bytes": [len(t) for t in texts], "avi": avi})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "media_id long, n_bytes long, avi binary")


FEATURES = "media_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """A row per row of ``media`` (media_id, n_bytes, avi): digests of the payload that is read back, and its clips as one string.

    A file that doesn't say how long its payload is has all of its frames as
    payload. Where ``avi`` is no motion-JPEG file that can be read to its end, what
    would be read from it is null, and the digest is that of the bytes there are; a
    null ``avi`` has nulls only. Repeated rows have equal results; an empty table
    gives no rows; other columns are not read.
    """
    small_batches(media.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import zlib

        for batch in batches:
            rows = []
            for media_id, n_bytes, data in zip(batch["media_id"], batch["n_bytes"], batch["avi"], strict=True):
                whole = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
                try:
                    video = parse_avi(data or b"")
                    frames = list(frames_of(data, video))
                except (NotAFrame, struct.error):
                    rows.append((media_id, n_bytes, None, None, None, *whole, None))
                    continue
                _, _, length = video.comment.partition("payload=")
                payload = b"".join(f.tobytes() for f in frames)
                payload = payload[: int(length)] if length.isdigit() else payload
                clips = shots(iter(frames), video.seconds_a_frame)
                said = ";".join(f"{start:.2f}-{end:.2f}:{luma:.4f}" for _, _, _, start, end, luma in clips)
                rows.append((media_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *whole, f"frames={len(frames)};{said}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")]).astype({c: "Int64" for c in ("media_id", "n_bytes", "payload_bytes", "tail_crc32", "media_bytes")})

    return media.select("media_id", "n_bytes", "avi").mapInPandas(run, FEATURES)
