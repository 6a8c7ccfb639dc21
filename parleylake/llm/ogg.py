"""Media columns: an Ogg container reader and writer over binary columns.

``encode`` stores bytes as 8-bit PCM samples in one logical stream beside a second stream of
comment packets; ``decode`` checks every page's checksum, reassembles packets from the lacing
values, demultiplexes the streams and turns granule positions into timestamps.

Defined results: a null payload is stored as an empty one; an empty payload gives header pages and
one empty data page; null or damaged media gives ``error`` text and nulls, and never an exception.
Rows stay independent, so repeated rows and columns of any other name pass through untouched.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_slice, map_arrow

# Fixed values of the container format.
CAPTURE = b"OggS"
HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1
MAX_SEGMENTS = 255

PCM_MAGIC, NOTE_MAGIC = b"PCM8\0\0\0\1", b"NOTE\0\0\0\1"
PCM_SERIAL, NOTE_SERIAL = 1, 2
RATE = 8000
PACKET = 4096

_FLIP = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC-32 (0x04c11db7, not reflected, zero start), by zlib's reflected one over flipped bits."""
    reflected = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_FLIP), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing))
    crc = checksum(head + lacing + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + lacing + body


class _Stream:
    """Packs one logical stream's packets into pages."""

    def __init__(self, serial: int):
        self.serial, self.number = serial, 0

    def pages(self, packets: list[tuple[bytes, int]], first: bool = False, last: bool = False):
        """``packets``: (bytes, granule at the packet's end). A page's granule is that of its last ended packet."""
        segments = []  # (length, body, granule or None)
        for body, granule in packets:
            whole, rest = divmod(len(body), 255)
            segments += [(255, body[i * 255 : i * 255 + 255], None) for i in range(whole)]
            segments.append((rest, body[whole * 255 :], granule))
        runs = [segments[i : i + MAX_SEGMENTS] for i in range(0, len(segments), MAX_SEGMENTS)]
        for at, run in enumerate(runs):
            ended = [g for _, _, g in run if g is not None]
            flags = CONTINUED * (at > 0 and runs[at - 1][-1][2] is None)
            flags |= FIRST * (first and at == 0) | LAST * (last and at == len(runs) - 1)
            yield _page(flags, ended[-1] if ended else NO_GRANULE, self.serial, self.number, bytes(s[0] for s in run), b"".join(s[1] for s in run))
            self.number += 1


def encode(payload: bytes, note: bytes = b"", rate: int = RATE, packet: int = PACKET) -> bytes:
    """The payload as 8-bit samples and the note as a comment packet, multiplexed."""
    pcm, notes = _Stream(PCM_SERIAL), _Stream(NOTE_SERIAL)
    out = [
        *pcm.pages([(PCM_MAGIC + struct.pack("<IHH", rate, 8, 1), 0)], first=True),
        *notes.pages([(NOTE_MAGIC, 0)], first=True),
    ]
    parts = [(payload[i : i + packet], min(i + packet, len(payload))) for i in range(0, len(payload), packet)] or [(b"", 0)]
    data = list(pcm.pages(parts, last=True))
    comment = list(notes.pages([(note, len(payload))], last=True))
    out += data[:1] + comment + data[1:]
    return b"".join(out)


@dataclass
class Logical:
    """One demultiplexed stream."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    ends: list[int | None] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    part: list[bytes] = field(default_factory=list)


def parse(media: bytes) -> dict[int, Logical]:
    """Streams by serial number; ValueError names what is damaged."""
    streams: dict[int, Logical] = {}
    at = 0
    while at < len(media):
        if len(media) - at < HEAD.size:
            raise ValueError("cut page header")
        capture, version, flags, granule, serial, number, crc, count = HEAD.unpack_from(media, at)
        if capture != CAPTURE or version:
            raise ValueError("lost page boundary")
        body = at + HEAD.size + count
        lacing = media[at + HEAD.size : body]
        end = body + sum(lacing)
        if len(lacing) < count or end > len(media):
            raise ValueError("cut page")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError("page checksum")
        if (serial in streams) == bool(flags & FIRST):
            raise ValueError("stream start")
        stream = streams.setdefault(serial, Logical(serial))
        if stream.ended or number != stream.pages or bool(flags & CONTINUED) != bool(stream.part):
            raise ValueError("page order")
        stream.pages += 1
        stream.ended = bool(flags & LAST)
        done = len(stream.packets)
        for length in lacing:
            stream.part.append(media[body : body + length])
            body += length
            if length < 255:
                stream.packets.append(b"".join(stream.part))
                stream.ends.append(None)
                stream.part = []
        if len(stream.packets) > done:
            stream.ends[-1] = granule
        at = end
    for stream in streams.values():
        if not stream.ended or stream.part:
            raise ValueError("stream end")
    return streams


def samples(streams: dict[int, Logical]) -> tuple[bytes, int, list[int]]:
    """Payload, sample rate and the time in microseconds at the end of each data page of the PCM stream."""
    pcm = next((s for s in streams.values() if s.packets and s.packets[0].startswith(PCM_MAGIC)), None)
    if pcm is None:
        raise ValueError("no PCM stream")
    rate, bits, channels = struct.unpack_from("<IHH", pcm.packets[0], len(PCM_MAGIC))
    if bits != 8 or channels != 1 or not rate:
        raise ValueError("sample format")
    payload = b"".join(pcm.packets[1:])
    marks = [g for g in pcm.ends[1:] if g is not None]
    if marks != sorted(marks) or (marks and marks[-1] != len(payload)):
        raise ValueError("granule position")
    return payload, rate, [g * 1_000_000 // rate for g in marks]


def pad(raw: bytes, unit: int = 192) -> bytes:
    """The bytes with spaces appended up to a positive multiple of ``unit``."""
    return raw + b" " * (-len(raw) % unit if raw else unit)


def encode_column(df: DataFrame, text: str = "text", media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of ``keep`` columns with ``media``: the padded UTF-8 text as an Ogg file."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = []
        for raw in batch.column("__text").to_pylist():
            raw = raw or b""
            made.append(encode(pad(raw), note=str(len(raw)).encode()))
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(made, pa.binary())], names=[*keep, media])

    source = df.select(*keep, F.col(text).cast("binary").alias("__text"))
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep), f"`{media}` binary"])
    return map_arrow(source, each_slice(work, "__text"), schema)


DECODED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, page_us array<long>, error string"


def sample_features(payload: bytes) -> str:
    """Mean, root mean square and peak about the middle of 8-bit samples, and how often they cross it."""
    values = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    if not len(values):
        return "samples=0"
    crossings = int(np.count_nonzero((values[1:] < 0) != (values[:-1] < 0)))
    return f"samples={len(values)};mean={values.sum() / len(values):.4f};rms={(float((values * values).sum()) / len(values)) ** 0.5:.4f};peak={int(np.abs(values).max())};crossings={crossings}"


def decode_column(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """What the stored bytes hold: sizes, digests, a line of container and sample features, the time at each page's end, or ``error``."""

    def read(raw: bytes | None) -> tuple:
        if raw is None:
            return (None,) * 8 + ("no media",)
        stored = (len(raw), hashlib.sha256(raw).hexdigest())
        try:
            streams = parse(raw)
            payload, rate, marks = samples(streams)
            note = next(s for s in streams.values() if s.packets[0] == NOTE_MAGIC)
            n_bytes = int(note.packets[1])
        except (ValueError, StopIteration, IndexError, struct.error) as broken:
            return (None, None, None, None, *stored, None, None, str(broken) or type(broken).__name__)
        container = f"ogg;streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={sum(len(s.packets) for s in streams.values())};rate={rate};duration_us={marks[-1] if marks else 0}"
        return (n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *stored, f"{container};{sample_features(payload)}", marks, None)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string()]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(zip(*map(read, batch.column(media).to_pylist()), strict=True))
        names = [part.split()[0] for part in DECODED.split(", ")]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[*keep, *names])

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep), DECODED])
    return map_arrow(df.select(*keep, media), each_slice(work, media), schema)
