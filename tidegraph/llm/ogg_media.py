"""Media columns in Ogg: pack payloads as logical streams of pages, and read them back with all checks.

The container is Ogg as published in RFC 3533: pages with a checksum (polynomial 0x04c11db7, not
reflected), lacing values, logical streams told apart by serial number, granule positions. Stream 1
holds 8-bit samples, stream 2 a packet for each packet of samples that says how much of it is text; their pages
take turns. The reader verifies each
page, puts packets together across pages, takes the streams apart and turns granule positions into
timestamps. One pass, no shuffle; equal texts give equal bytes.

Defined results: null and empty texts are one block of zeros; damaged media raise ``OggError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

RATE, PACKET, SAMPLES, BOUNDS = 8000, 8192, 1, 2
HEAD, BOUND_HEAD = b"tgpcm8\x00\x01", b"tgbound\x01"
_NONE = (1 << 64) - 1
_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBQIIIB")


class OggError(ValueError):
    pass


def page_crc(data: bytes) -> int:
    """Ogg's checksum by way of zlib's: mirror each byte, run the mirrored polynomial, mirror the sum."""
    x = zlib.crc32(data.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_FLIP), "big")


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def stream_pages(serial: int, groups: list[list[tuple[bytes, int]]], most: int = 255) -> list[list[bytes]]:
    """Pages of one logical stream, those of each group of packets apart; the first group is the header.

    A packet: content and granule position at its end. A packet goes on over pages where it must.
    """
    out, number = [], 0
    for g, group in enumerate(groups):
        segments = []  # (lacing value, ends a packet, its granule)
        for body, granule in group:
            whole, rest = divmod(len(body), 255)
            segments += [(255, False, 0)] * whole + [(rest, True, granule)]
        body, at, pos, inside, pages = b"".join(b for b, _ in group), 0, 0, False, []
        while at < len(segments):
            part = segments[at : at + most]
            size = sum(x[0] for x in part)
            ended = [x[2] for x in part if x[1]]
            last = g == len(groups) - 1 and at + most >= len(segments)
            kind = inside | 2 * (number == 0) | 4 * last
            pages.append(_page(kind, ended[-1] if ended else _NONE, serial, number, bytes(x[0] for x in part), body[pos : pos + size]))
            inside, at, pos, number = not part[-1][1], at + most, pos + size, number + 1
        out.append(pages)
    return out


def pad(raw: bytes, unit: int = 64) -> bytes:
    return raw + bytes(-len(raw) % unit or (0 if raw else unit))


def encode(raw: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """The Ogg file of one payload: headers of both streams first, then their pages by turns, in order of time.

    A page of samples holds as many whole packets as its 255 lacing values allow (a longer packet goes on);
    the page of bounds after it says for each of them how many bytes of the text have gone by.
    """
    payload = pad(raw)
    each = max(1, 255 // (packet // 255 + 1))
    ends = [min(i + packet, len(payload)) for i in range(0, len(payload), packet)]
    samples = [(payload[i * packet : e], e) for i, e in enumerate(ends)]
    bounds = [(struct.pack("<Q", min(e, len(raw))), e) for e in ends]
    deal = lambda head, packets: [[(head, 0)], *(packets[i : i + each] for i in range(0, len(packets), each))]
    a, b = stream_pages(SAMPLES, deal(HEAD + struct.pack("<I", rate), samples)), stream_pages(BOUNDS, deal(BOUND_HEAD, bounds))
    return b"".join(page for x, y in zip(a, b, strict=True) for page in (*x, *y))


@dataclass
class Stream:
    """A logical stream: packets, and for each the time in microseconds at its end where a page gives one."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    last: int = 0
    ended: bool = False
    open: list[bytes] = field(default_factory=list)

    def times_us(self, rate: int) -> list[int | None]:
        return [None if g is None else g * 1_000_000 // rate for g in self.granules]


def demultiplex(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number. Raises OggError for any page or packet that is not whole."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise OggError("a page header is cut off")
        magic, version, kind, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError("no page starts here")
        lacing = data[at + 27 : at + 27 + n]
        body = at + 27 + n
        end = body + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError("a page is cut off")
        if page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError("a page's checksum is wrong")
        if (serial not in streams) != bool(kind & 2):
            raise OggError("a stream begins twice or without its first page")
        s = streams.setdefault(serial, Stream())
        if s.ended or number != s.pages or bool(s.open) != bool(kind & 1):
            raise OggError("a stream's pages are not in order")
        s.pages += 1
        size, before = 0, len(s.packets)
        for x in lacing:
            size += x
            if x < 255:
                s.open.append(data[body : body + size])
                s.packets.append(b"".join(s.open))
                s.granules.append(None)
                s.open, body, size = [], body + size, 0
        if size or (n and lacing[-1] == 255):
            s.open.append(data[body : body + size])
        if (granule != _NONE) != (len(s.packets) > before):
            raise OggError("a granule position without the end of a packet, or the end of one without it")
        if granule != _NONE:
            if granule < s.last:
                raise OggError("a stream's time runs backward")
            s.granules[-1] = s.last = granule
        s.ended, at = bool(kind & 4), end
    if any(s.open or not s.ended for s in streams.values()):
        raise OggError("a stream has no end")
    return streams


@dataclass
class Media:
    payload: bytes
    n_bytes: int
    rate: int
    end_us: int
    pages: int
    packets: int


def decode(data: bytes) -> Media:
    """Payload and bounds of a file of ``encode``. Raises OggError for anything that is not whole."""
    streams = demultiplex(data)
    if set(streams) != {SAMPLES, BOUNDS}:
        raise OggError("a logical stream is missing")
    a, b = streams[SAMPLES], streams[BOUNDS]
    if len(a.packets) < 2 or a.packets[0][:-4] != HEAD or b.packets[:1] != [BOUND_HEAD]:
        raise OggError("a header is missing or of another kind")
    rate = struct.unpack("<I", a.packets[0][-4:])[0]
    if not rate:
        raise OggError("a rate of 0")
    payload = b"".join(a.packets[1:])
    if a.last != len(payload):
        raise OggError("the last granule position is not the number of samples")
    if len(b.packets) != len(a.packets) or any(len(x) != 8 for x in b.packets[1:]):
        raise OggError("bounds and samples are not of the same number")
    passed = [struct.unpack("<Q", x)[0] for x in b.packets[1:]]
    n, ends = passed[-1], accumulate(map(len, a.packets[1:]))
    if b.last != a.last or passed != [min(e, n) for e in ends] or len(payload) != max(64, -(-n // 64) * 64) or any(payload[n:]):
        raise OggError("the bounds do not fit the samples")
    return Media(payload, n, rate, a.times_us(rate)[-1], a.pages + b.pages, len(a.packets) + len(b.packets))


def describe(m: Media) -> str:
    """Features of the samples around their zero of 128: duration, peak, energy, sign changes."""
    x = np.frombuffer(m.payload, np.uint8).astype(np.int64) - 128
    return f"us={m.end_us};pages={m.pages};packets={m.packets};peak={int(np.abs(x).max())};mean={int(x.sum() * 1000 // len(x))};energy={int((x * x).sum() // len(x))};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def with_media(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` columns and the binary column ``media``."""
    schema = docs.select(*keep).schema.add("media", "binary")

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                media = [encode((t or "").encode("utf-8", "surrogatepass")) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(media, pa.binary())], names=schema.fieldNames())

    return docs.select(F.col(text_col).alias("_text_of_media"), *keep).mapInArrow(tidy(run), schema)


def with_features(media: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """What the stored bytes of column ``media`` hold."""
    schema = media.select(*keep).schema
    for name, kind in (("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")):
        schema = schema.add(name, kind)

    def run(batches):
        for b in batches:
            rows = []
            for data in b.column(0).to_pylist():
                m = decode(data)
                rows.append((m.n_bytes, len(m.payload), hashlib.sha256(m.payload).hexdigest(), zlib.crc32(m.payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), describe(m)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=schema.fieldNames())

    return media.select("media", *keep).mapInArrow(tidy(run), schema)


def op4_ogg_media(spark, sf_dir: str) -> DataFrame:
    return with_features(with_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
