"""Media columns in the Ogg container: write, verify and read back.

A payload is cut into frames of 576 samples of 8 bits.  Frames go in turn to two
logical streams, whose pages are multiplexed in one physical stream.  Reading
checks each page's CRC, splits the stream by serial number, rebuilds packets
from the lacing values (packets may span pages), checks page order, derives each
frame's time from the granule positions, and puts the frames of the streams back
in order of time.

Defined cases: a null text is an empty one; a payload is padded with bytes 255
to a positive multiple of 576, so an empty text is one frame of 255; a damaged
stream raises ``OggError``; repeated rows are each written; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

FRAME = 576
RATE = 48_000
STREAMS = 2
#: Packets on a page: 255 lacing values at three a frame.
PER_PAGE = 255 // (FRAME // 255 + 1)
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_head = struct.Struct("<4sBBqIIIB")


class OggError(ValueError):
    pass


def crc(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 0x04C11DB7, most significant bit first, start 0).

    zlib has the same polynomial with bits in the other order: over bytes with
    reversed bits it gives the reversed register.
    """
    reg = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reg.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _head.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    page = head + lacing + body
    return page[:22] + crc(page).to_bytes(4, "little") + page[26:]


def _lacing(length: int) -> bytes:
    return b"\xff" * (length // 255) + bytes([length % 255])


def _id_packet(stream: int) -> bytes:
    """Stream header: magic, version, 8-bit unsigned samples, rate, frame length, place among the streams."""
    return struct.pack("<8sHHIHBB", b"PCM     ", 1, 8, RATE, FRAME, stream, STREAMS)


def mux(payload: bytes) -> bytes:
    """The physical stream of a payload whose length is a positive multiple of FRAME."""
    if not payload or len(payload) % FRAME:
        raise OggError("a payload is a positive number of whole frames")
    frames = len(payload) // FRAME
    streams = min(STREAMS, frames)
    out = [_page(2, 0, s + 1, 0, _lacing(len(p := _id_packet(s))), p) for s in range(streams)]
    body = np.frombuffer(payload, np.uint8).reshape(frames, FRAME)
    one = _lacing(FRAME)
    number = [1] * streams
    own = [body[s::streams] for s in range(streams)]
    for at in range(0, len(own[0]), PER_PAGE):
        for s in range(streams):
            part = own[s][at : at + PER_PAGE]
            if not len(part):
                continue
            last = at + len(part) - 1
            # The granule position is the end, in samples of the whole payload, of the page's last packet.
            granule = (last * streams + s + 1) * FRAME
            flags = 4 if at + PER_PAGE >= len(own[s]) else 0
            out.append(_page(flags, granule, s + 1, number[s], one * len(part), part.tobytes()))
            number[s] += 1
    return b"".join(out)


@dataclass
class Stream:
    serial: int
    packets: list[bytes]
    #: End of each packet in samples; -1 until a later page tells.
    ends: list[int]
    pages: int = 0
    ended: bool = False


def demux(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number; every page checksum is verified."""
    streams: dict[int, Stream] = {}
    open_packet: dict[int, list[bytes]] = {}
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise OggError("cut page header")
        magic, version, flags, granule, serial, number, want, segments = _head.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        lacing = data[at + 27 : at + 27 + segments]
        end = at + 27 + segments + sum(lacing)
        if len(lacing) < segments or end > len(data):
            raise OggError("cut page")
        page = data[at:end]
        if crc(page[:22] + b"\0\0\0\0" + page[26:]) != want:
            raise OggError(f"checksum of page {number} in stream {serial}")
        if flags & 2:
            if serial in streams:
                raise OggError(f"stream {serial} begins twice")
            streams[serial] = Stream(serial, [], [])
        if serial not in streams or streams[serial].ended:
            raise OggError(f"page outside stream {serial}")
        s = streams[serial]
        if number != s.pages:
            raise OggError(f"page {s.pages} of stream {serial} is missing")
        s.pages += 1
        parts = open_packet.setdefault(serial, [])
        if bool(flags & 1) != bool(parts):
            raise OggError("continued packet without its other part")
        body = at + 27 + segments
        start = body
        for value in lacing:
            body += value
            if value < 255:
                parts.append(data[start:body])
                s.packets.append(parts[0] if len(parts) == 1 else b"".join(parts))
                s.ends.append(-1)
                parts.clear()
                start = body
        if start < body:
            parts.append(data[start:body])
        if granule >= 0 and s.ends and s.ends[-1] == -1:
            s.ends[-1] = granule
        s.ended = bool(flags & 4)
        at = end
    if any(open_packet.values()):
        raise OggError("the last packet is cut")
    return streams


def timed(stream: Stream) -> tuple[list[bytes], np.ndarray]:
    """Data packets of a stream and each one's end in samples, filled in backwards from the pages' granule positions."""
    magic, _, bits, _, frame, _, of = struct.unpack("<8sHHIHBB", stream.packets[0])
    if magic != b"PCM     " or bits != 8:
        raise OggError("unknown stream header")
    ends = np.array(stream.ends[1:], dtype=np.int64)
    step = frame * (of if len(ends) else 1)
    if len(ends):
        if ends[-1] < 0:
            raise OggError("no granule position at the end")
        known = np.flatnonzero(ends >= 0)
        nxt = known[np.searchsorted(known, np.arange(len(ends)))]
        ends = ends[nxt] - (nxt - np.arange(len(ends))) * step
    return stream.packets[1:], ends


def read_payload(data: bytes) -> tuple[bytes, dict]:
    """The payload of ``mux`` and what was seen of the container."""
    streams = demux(data)
    packets: list[bytes] = []
    ends: list[np.ndarray] = []
    alone = len(streams) == 1
    for s in streams.values():
        p, e = timed(s)
        packets += p
        ends.append(e)
    order = np.argsort(np.concatenate(ends), kind="stable")
    when = np.concatenate(ends)[order]
    if not np.array_equal(when, np.arange(1, len(when) + 1) * FRAME):
        raise OggError("frames are missing or out of time")
    payload = b"".join([packets[i] for i in order])
    return payload, {"streams": len(streams), "pages": sum(s.pages for s in streams.values()), "packets": len(packets), "samples": int(when[-1]), "alone": alone}


def feature(payload: bytes, seen: dict) -> str:
    """Container and signal figures in one string."""
    x = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n = len(payload)
    mean = float(x @ np.arange(256)) / n
    power = float(x @ (np.arange(256.0) - 128) ** 2) / n
    return (
        f"streams={seen['streams']};pages={seen['pages']};packets={seen['packets']};"
        f"ms={seen['samples'] * 1000 // RATE};mean={mean:.3f};rms={power ** 0.5:.3f};levels={int((x > 0).sum())}"
    )


def padded(text: bytes | None) -> bytes:
    text = text or b""
    frames = max(1, -(-len(text) // FRAME))
    return text + b"\xff" * (frames * FRAME - len(text))


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the stored form) of every whole text."""

    def run(batch):
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        return {"doc_id": batch.column(0), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "media": pa.array([mux(padded(t)) for t in texts], pa.binary())}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.map_texts(docs, ["doc_id", "text"], run, f"doc_id {kind}, n_bytes long, media binary")


def inspect(media: DataFrame) -> DataFrame:
    """Digests and features of the stored bytes of ``encode``, read back."""

    def run(batch):
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for data in batch.column(2).to_pylist():
            payload, seen = read_payload(data)
            for k, v in (
                ("payload_bytes", len(payload)), ("payload_sha256", hashlib.sha256(payload).hexdigest()), ("tail_crc32", zlib.crc32(payload[-32:])),
                ("media_bytes", len(data)), ("media_sha256", hashlib.sha256(data).hexdigest()), ("feature", feature(payload, seen)),
            ):
                out[k].append(v)
        longs = ("payload_bytes", "tail_crc32", "media_bytes")
        return {"doc_id": batch.column(0), "n_bytes": batch.column(1)} | {k: pa.array(v, pa.int64() if k in longs else pa.string()) for k, v in out.items()}

    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return common.map_texts(media, ["doc_id", "n_bytes", "media"], run, schema, text="media")
