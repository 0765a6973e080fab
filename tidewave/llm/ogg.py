"""Ogg media columns: multiplexing, and reading back with checksums, lacing, logical streams and timestamps.

Values fixed by the public Ogg and OggPCM descriptions: the capture pattern, the page header's layout, header-type bits,
lacing of packets in segments of up to 255 bytes, the CRC polynomial 0x04C11DB7 (start 0, not reflected) and the PCM header.

Defined results: null text counts as empty and is stored as 64 zero bytes; null doc_id stays null; null or damaged media
give a row with `error` set and no payload; repeated rows give repeated rows; empty tables give none; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewave.llm._common import clean_ids, spread, table, text_pieces

RATE = 8000
#: Samples in a packet: half a second.
PACKET = 4000
UNIT = 64
AUDIO, INDEX = 0x50434D31, 0x494E4458  # serial numbers of the two logical streams
CONTINUED, FIRST, LAST = 1, 2, 4
_HEADER = struct.Struct("<4sBBqIIIB")
#: magic, major and minor version, format (1: unsigned 8-bit), samples a second, significant bits, channels, max. packet, header packets
_PCM = struct.Struct(">8sHHIIBBHI")
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(data: bytes) -> int:
    """Ogg's CRC-32 is zlib's over mirrored bytes without its inversions, mirrored back."""
    reflected = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_MIRROR), "big")


def page(body: bytes, lacing: bytes, kind: int, granule: int, serial: int, number: int) -> bytes:
    head = _HEADER.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", checksum(head + body)) + head[26:] + body


def pages_of(serial: int, packets: list[tuple[bytes, int]], apart: int = 1) -> Iterator[bytes]:
    """Pages of a logical stream. packets: (bytes, granule position at its end); the first `apart` get pages of their own."""
    lacing, body, granule, number, kind = bytearray(), bytearray(), -1, 0, FIRST
    for k, (packet, at) in enumerate(packets):
        place = 0
        while True:
            step = packet[place : place + 255]
            lacing.append(len(step))
            body += step
            place += 255
            done = len(step) < 255
            if done:
                granule = at
            end = done and k == len(packets) - 1
            if end or len(lacing) == 255 or (done and k < apart):
                yield page(bytes(body), bytes(lacing), kind | (LAST if end else 0), granule, serial, number)
                lacing, body, granule, number, kind = bytearray(), bytearray(), -1, number + 1, 0 if done else CONTINUED
            if done:
                break


def store(payload: bytes, n_bytes: int) -> bytes:
    """Samples as one Ogg file of two logical streams: 8-bit PCM, and an index that tells the length before padding."""
    head = _PCM.pack(b"PCM     ", 0, 0, 1, RATE, 8, 1, PACKET, 0)
    audio = [(head, 0)] + [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    index = [(b"INDEX   " + struct.pack("<Q", n_bytes), 0), (b"END     " + struct.pack("<Q", len(payload)), len(payload))]
    a, b = pages_of(AUDIO, audio), pages_of(INDEX, index)
    return b"".join([next(a), next(b), *a, *b])  # every stream's first page stands before all others


class Packet(NamedTuple):
    serial: int
    data: bytes
    granule: int  # at the end of the page on which the packet ends; -1 if not known
    last: bool


def packets(media: bytes) -> Iterator[Packet]:
    """All packets of all logical streams in the order in which they end; ValueError on damage."""
    at, parts, wanted = 0, {}, {}
    while at < len(media):
        if len(media) < at + 27:
            raise ValueError(f"the page at {at} is cut off")
        magic, version, kind, granule, serial, number, crc, segments = _HEADER.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at {at}")
        lacing = media[at + 27 : at + 27 + segments]
        body = at + 27 + segments
        end = body + sum(lacing)
        if len(lacing) < segments or end > len(media):
            raise ValueError(f"the page at {at} is cut off")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"the checksum of the page at {at} is wrong")
        if bool(kind & FIRST) != (serial not in wanted) or number != wanted.get(serial, number if kind & FIRST else -1):
            raise ValueError(f"the page at {at} is out of sequence")
        if bool(kind & CONTINUED) != bool(parts.get(serial)):
            raise ValueError(f"the page at {at} does not go on where its stream stopped")
        wanted[serial] = number + 1
        held = parts.setdefault(serial, [])
        ending = [i for i, x in enumerate(lacing) if x < 255]
        place = begin = body
        for i, x in enumerate(lacing):
            place += x
            if x < 255:
                held.append(media[begin:place])
                yield Packet(serial, b"".join(held), granule if i == ending[-1] else -1, bool(kind & LAST) and i == ending[-1])
                held.clear()
                begin = place
        if begin < end:
            held.append(media[begin:end])
        at = end
    if any(parts.values()):
        raise ValueError("a packet does not end")


class Stream(NamedTuple):
    serial: int
    codec: str
    rate: int
    packets: int
    data: bytes
    seconds: list[float]  # when each packet ends


def demultiplex(media: bytes) -> dict[int, Stream]:
    """Logical streams by serial number: header told apart from data, each packet's end in seconds from granule positions."""
    rows: dict[int, list[Packet]] = {}
    for p in packets(media):
        rows.setdefault(p.serial, []).append(p)
    out = {}
    for serial, found in rows.items():
        head = found[0].data
        if head[:8] == b"PCM     ":
            codec, rate, body = "pcm", _PCM.unpack(head)[4], found[1:]
        else:
            codec, rate, body = head[:8].decode("latin-1").strip().lower(), 0, found
        ends: list[float] = []
        granule = 0
        pending: list[int] = []
        for p in body:
            granule += len(p.data)  # one byte a sample
            if p.granule >= 0 and codec == "pcm":
                if p.granule != granule:
                    raise ValueError("a granule position disagrees with the samples before it")
            pending.append(granule)
            ends.append(granule / rate if rate else max(p.granule, 0) / RATE)
        if body and not body[-1].last:
            raise ValueError("a stream does not end")
        out[serial] = Stream(serial, codec, rate, len(found), b"".join(p.data for p in body), ends)
    return out


def feature(samples: bytes, seconds: float) -> str:
    """Length, mean, root mean square about the middle, crossings of the middle, and shares of 8 equal ranges of level."""
    x = np.frombuffer(samples, np.uint8)
    level = x.astype(np.int32) - 128
    n = max(len(x), 1)
    shares = np.bincount(x >> 5, minlength=8) / n
    return ";".join([f"{seconds:.4f}", f"{level.sum() / n:.4f}", f"{(float((level * level).sum()) / n) ** 0.5:.4f}", str(int(np.count_nonzero((level[1:] >= 0) != (level[:-1] >= 0)))), *(f"{s:.4f}" for s in shares)])


def stored_texts(docs: DataFrame) -> DataFrame:
    """Each text as Ogg media: doc_id, n_bytes, media."""

    def run(batches):
        for part in text_pieces(batches):
            texts = [t.encode("utf-8") for t in part.column("text").to_pylist()]
            media = [store(t + bytes(-len(t) % UNIT or (0 if t else UNIT)), len(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return spread(clean_ids(docs, "doc_id", "text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets int, seconds double, error string"


def read_media(stored: DataFrame, keep: bool = True) -> DataFrame:
    """What a media column holds: digests and feature, and with keep the payload and each audio packet's end in seconds."""

    def one(media: bytes | None):
        if media is None:
            return (None,) * 4 + (None, None, None, None, None, "no media") + (None, None) * keep
        own = (len(media), hashlib.sha256(media).hexdigest())
        try:
            streams = {s.codec: s for s in demultiplex(media).values()}
            audio, index = streams["pcm"], streams["index"]
        except (ValueError, KeyError, struct.error) as why:
            return (None, None, None, None, *own, None, None, None, str(why) or "damaged") + (None, None) * keep
        payload = audio.data
        seconds = audio.seconds[-1] if audio.seconds else 0.0
        n_bytes = struct.unpack_from("<Q", index.data, 8)[0]
        return (n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), *own, feature(payload, seconds), audio.packets, seconds, None) + (payload, audio.seconds) * keep

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.string(), *[pa.binary(), pa.list_(pa.float64())] * keep]
    names = [x.split()[0] for x in _READ.split(", ")] + ["payload", "packet_seconds"] * keep

    def run(batches):
        for batch in batches:
            rows = [one(m.as_py()) for m in batch.column("media")]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return clean_ids(stored, "doc_id", "media").mapInArrow(run, _READ + ", payload binary, packet_seconds array<double>" * keep)


def op6_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(stored_texts(table(spark, sf_dir, "documents")), keep=False)
