"""Ogg media columns: payload bytes as 8-bit samples in an Ogg container, and back.

Writing: samples are cut into packets of ``PACKET`` bytes; packets are laced into pages (segments of 255
bytes and a shorter last one; a packet may run over pages), each page with its checksum.  Two
logical streams are multiplexed: the samples, and an index stream with a packet a page of samples, whose
granule positions tell the time too.  The granule position of a sample page is the number of samples
at the end of the last packet that ends on it (-1 when none does).

Reading trusts nothing but the bytes: pages are found by their capture pattern, their checksums verified,
streams told apart by serial number, page numbers checked for gaps, packets put together from the lacing values,
and times derived from granule positions.

The page checksum is CRC-32 with polynomial 0x04C11DB7, unreflected, initial value 0.  It is the
bit-reversal of the usual reflected CRC over bit-reversed bytes, so zlib computes it.

Nulls: a null text is an empty payload, which is padded to 64 bytes.  Every row, repeated or not, is
encoded by its bytes alone, so equal texts have equal results.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cellweave.llm.training import by_row

PAD = 64
PACKET = 4096
RATE = 8000
SAMPLES, INDEX = 0x5AA5_0001, 0x5AA5_0002
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """The Ogg checksum of a page whose checksum field is zero."""
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{reflected:032b}"[::-1], 2)


def page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = b"OggS" + struct.pack("<BBqIIIB", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    whole = head + body
    return whole[:22] + struct.pack("<I", page_crc(whole)) + whole[26:]


class _Stream:
    """Laces packets of one logical stream into pages."""

    def __init__(self, serial: int):
        self.serial, self.number, self.lacing, self.body, self.size = serial, 0, bytearray(), [], 0
        self.granule, self.continued = -1, False

    def flush(self, last: bool = False, open_packet: bool = False) -> bytes:
        flags = (1 if self.continued else 0) | (2 if self.number == 0 else 0) | (4 if last else 0)
        out = page(self.serial, self.number, self.granule, flags, bytes(self.lacing), b"".join(self.body))
        self.number, self.lacing, self.body, self.granule, self.continued = self.number + 1, bytearray(), [], -1, open_packet
        return out

    def add(self, packet: bytes, granule: int) -> list[bytes]:
        """Take a packet; return the pages that became full."""
        out, at = [], 0
        values = [255] * (len(packet) // 255) + [len(packet) % 255]
        while values:
            room = 255 - len(self.lacing)
            if not room:
                out.append(self.flush(open_packet=at > 0))
                continue
            taken, values = values[:room], values[room:]
            n = sum(taken)
            self.lacing += bytes(taken)
            self.body.append(packet[at : at + n])
            at += n
        self.granule = granule
        return out


def mux(payload: bytes, rate: int = RATE) -> bytes:
    """Payload bytes -> an Ogg file with a sample stream and an index stream."""
    samples, index = _Stream(SAMPLES), _Stream(INDEX)
    out = []
    samples.add(b"PCM8" + struct.pack("<I", rate), 0)
    out.append(samples.flush())
    index.add(b"INDX", 0)
    out.append(index.flush())
    done = 0
    for at in range(0, len(payload), PACKET):
        part = payload[at : at + PACKET]
        pages = samples.add(part, at + len(part))
        for p in pages:
            out.append(p)
            index.add(struct.pack("<QI", at, zlib.crc32(p)), at)
            out.append(index.flush())
        done = at + len(part)
    out.append(samples.flush(last=True))
    index.add(struct.pack("<QI", done, 0), done)
    out.append(index.flush(last=True))
    return b"".join(out)


@dataclass
class Logical:
    """One logical stream as read back."""

    packets: list[bytes] = field(default_factory=list)
    times: list[float | None] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False


def demux(data: bytes, rate: int = RATE) -> dict[int, Logical]:
    """Ogg bytes -> its logical streams by serial number.  Damaged or missing pages raise ``ValueError``."""
    streams: dict[int, Logical] = {}
    partial: dict[int, list[bytes]] = {}
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"OggS" or at + 27 > len(data):
            raise ValueError(f"no page at byte {at}")
        _, flags, granule, serial, number, crc, n = struct.unpack_from("<BBqIIIB", data, at + 4)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        whole = data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]
        if end > len(data) or page_crc(whole) != crc:
            raise ValueError(f"checksum of the page at byte {at}")
        stream = streams.setdefault(serial, Logical())
        if number != stream.pages:
            raise ValueError(f"page {stream.pages} of stream {serial:#x} is missing")
        open_ = partial.pop(serial, [])
        if bool(flags & 1) != bool(open_):
            raise ValueError(f"continuation of stream {serial:#x} at byte {at}")
        pos = at + 27 + n
        length, ends = 0, 0
        for value in lacing:
            length += value
            if value < 255:
                open_.append(data[pos : pos + length])
                stream.packets.append(b"".join(open_))
                open_, pos, length, ends = [], pos + length, 0, ends + 1
        if length:
            open_.append(data[pos : pos + length])
        if open_:
            partial[serial] = open_
        if ends:
            stream.granules.append(granule)
            stream.times += [None] * (ends - 1) + [granule / rate]
        elif granule != -1:
            raise ValueError("a page on which no packet ends has a granule position")
        stream.pages += 1
        stream.ended = bool(flags & 4)
        at = end
    if partial:
        raise ValueError("a packet is cut off")
    return streams


def encode(text: str | None) -> tuple[int, bytes]:
    """A text's unpadded size and its Ogg file."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), mux(raw + b"\0" * (-len(raw) % PAD or (PAD if not raw else 0)))


def decode(media: bytes) -> tuple[bytes, dict[int, Logical]]:
    """The payload read back, and the streams it came from."""
    streams = demux(media)
    return b"".join(streams[SAMPLES].packets[1:]), streams


def features(payload: bytes, streams: dict[int, Logical]) -> str:
    """Duration, level, peak, zero crossings and packets of the samples read back."""
    x = np.frombuffer(payload, np.uint8)
    mean = float(x.sum(dtype=np.int64)) / len(x)
    power = float((x.astype(np.uint32) ** 2).sum(dtype=np.int64)) / len(x)
    above = x >= 64
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    s = streams[SAMPLES]
    return f"ms={round(1000 * s.times[-1])};mean={mean:.4f};rms={power**0.5:.4f};peak={int(x.max())};crossings={crossings};packets={len(s.packets) - 1};pages={s.pages}"


def media_columns(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, n_bytes, media)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [encode(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": [m[0] for m in made], "media": [m[1] for m in made]})

    return by_row(docs, run, "n_bytes long, media binary", "text")


def digest(media: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)`` -> what the stored bytes hold when read back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, n, m in zip(pdf["doc_id"], pdf["n_bytes"], pdf["media"], strict=True):
                payload, streams = decode(m)
                rows.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(m), hashlib.sha256(m).hexdigest(), features(payload, streams)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return by_row(
        media, run, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", "n_bytes", "media"
    )
