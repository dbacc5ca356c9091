"""Media columns of MPEG audio: bytes stored in the ancillary data of valid Layer III streams, and a parser for such streams.

Stored form: an ID3v2.4 tag (TXXX frames), a frame with a Xing table (frame count, byte count, 100-point seek table), then
CRC-protected mono frames at 48 kHz. Their side information describes silence, so a player plays silence, and the main data
that no granule claims is ancillary data, which carries the payload one byte a unit. Frames take the highest bitrate; the last
takes the lowest that fits, so the stream has a variable bitrate.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_rows

# Fixed values of the MPEG audio frame header (ISO/IEC 11172-3 and 13818-3): kbit/s by index 1 to 14, and sample rates.
_V1 = {
    1: (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    2: (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    3: (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
}
_V2 = {
    1: (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    2: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    3: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
# Fixed values of Layer II: bits of allocation of each subband, as (bits, subbands) runs, by the kind of table.
_ALLOCATION = {"wide": ((4, 11), (3, 12), (2, 7)), "middle": ((4, 11), (3, 12), (2, 4)), "low": ((4, 2), (3, 6)), "low32": ((4, 2), (3, 10)), "lsf": ((4, 4), (3, 7), (2, 19))}

RATE, SIDE, UNIT = 48000, 17, 64
_HEAD = 4 + 2 + SIDE


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        table.append(c)
    return table


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """The checksum of MPEG audio: polynomial 0x8005, initial value 0xFFFF."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG 1, 2: MPEG 2, 0: MPEG 2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    length: int
    samples: int
    joint: int | None = None  # the mode extension of joint stereo

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


def _decode_header(word: int) -> Header | None:
    version, layer, bitrate, rate = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or bitrate in (0, 15) or rate == 3:
        return None
    kbps, hz, pad = (_V1 if version == 3 else _V2)[layer][bitrate - 1], _RATES[version][rate], word >> 9 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    length = (12000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
    mode = word >> 6 & 3
    return Header(version, layer, not word >> 16 & 1, kbps, hz, mode == 3, length, samples, word >> 4 & 3 if mode == 1 else None)


_KNOWN: dict[int, Header | None] = {}


def header(data: bytes, at: int) -> Header | None:
    """The frame header at an offset, if there is a valid one (free-format bitrates are not supported)."""
    if at + 4 > len(data) or data[at] != 0xFF:
        return None
    word = int.from_bytes(data[at : at + 4], "big")
    if word not in _KNOWN:
        if len(_KNOWN) > 4096:
            _KNOWN.clear()
        _KNOWN[word] = _decode_header(word)
    return _KNOWN[word]


def _checked_bits(data: bytes, at: int, h: Header) -> int | None:
    """How many bits behind the checksum it covers: side information, or the allocation and, in Layer II, scale factor selection."""
    channels = 1 if h.mono else 2
    bound = 32 if h.joint is None else 4 * (h.joint + 1)
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        return 4 * (32 if channels == 1 else bound + 32)
    each = h.kbps // channels
    kind = "lsf" if h.version != 3 else ("low32" if h.rate == 32000 else "low") if each <= 48 else "middle" if each <= 80 or h.rate == 48000 else "wide"
    widths = [bits for bits, n in _ALLOCATION[kind] for _ in range(n)]
    word, left = int.from_bytes(data[at + 6 : at + h.length], "big"), 8 * max(h.length - 6, 0)
    used = selected = 0
    for k, bits in enumerate(widths):
        for _ in range(channels if k < bound else 1):
            used += bits
            if used > left:
                return None
            if word >> left - used & (1 << bits) - 1:
                selected += 1 if k < bound else channels
    return used + 2 * selected


def crc16_bits(head: bytes, body: bytes, bits: int) -> int:
    """The checksum of whole bytes and of the first ``bits`` of others."""
    c = crc16(head + body[: bits // 8])
    for k in range(7, 7 - bits % 8, -1):
        c = (c << 1 ^ (0x8005 if (c >> 15) ^ (body[bits // 8] >> k & 1) else 0)) & 0xFFFF
    return c


def _checksum_ok(data: bytes, at: int, h: Header) -> bool | None:
    """None where there is none."""
    if not h.protected:
        return None
    bits = _checked_bits(data, at, h)
    if bits is None or at + 6 + -(-bits // 8) > len(data):
        return False
    if bits % 8 == 0:
        found = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + bits // 8])
    else:
        found = crc16_bits(data[at + 2 : at + 4], data[at + 6 : at + 7 + bits // 8], bits)
    return found == int.from_bytes(data[at + 4 : at + 6], "big")


def _frame_head(index: int) -> bytes:
    head = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0))
    return head + crc16(head[2:] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE)


_HEADS = {i: _frame_head(i) for i in range(1, 15)}
_ROOM = {i: 144_000 * _V1[3][i - 1] // RATE - _HEAD for i in range(1, 15)}


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """Zeros appended up to a positive multiple of the unit."""
    return data + bytes(-len(data) % unit if data else unit)


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _tag(fields: dict[str, str]) -> bytes:
    body = b""
    for k, v in fields.items():
        text = b"\x03" + k.encode() + b"\x00" + v.encode()
        body += b"TXXX" + _synchsafe(len(text)) + b"\x00\x00" + text
    return b"ID3\x04\x00\x00" + _synchsafe(len(body)) + body


def pack(payload: bytes, tags: dict[str, str] | None = None) -> bytes:
    """The stored form of a payload. Equal payloads and tags give equal bytes."""
    room, parts, offsets = _ROOM[14], [], []
    xing_length = _ROOM[5] + _HEAD
    at = xing_length
    for i in range(0, len(payload), room):
        piece = payload[i : i + room]
        k = 14 if len(piece) == room else next(k for k in range(1, 15) if _ROOM[k] >= len(piece))
        offsets.append(at)
        parts.append(_HEADS[k] + piece + bytes(_ROOM[k] - len(piece)))
        at += _ROOM[k] + _HEAD
    n = len(offsets)
    toc = bytes(min(255, offsets[min(n - 1, p * n // 100)] * 256 // at) if n else 0 for p in range(100))
    xing = b"Xing" + struct.pack(">III", 7, n, at) + toc
    tag = _tag({"payload_bytes": str(len(payload))} | (tags or {}))
    return tag + _HEADS[5] + xing + bytes(_ROOM[5] - len(xing)) + b"".join(parts)


@dataclass
class Table:
    """What a variable-bitrate table says: counts (None: not said) and (frame, byte offset from the table's frame, slack) points."""

    kind: str
    at: int
    frames: int | None = None
    size: int | None = None
    points: list[tuple[int, int, int]] = field(default_factory=list)

    def agrees(self, offsets: list[int], end: int) -> bool:
        """Are the counts those of the frames found, and do seek points lie where the frames do?"""
        if self.frames not in (None, len(offsets)) or self.size not in (None, end - self.at):
            return False
        spots = [*(o - self.at for o in offsets), end - self.at]
        return all(k < len(spots) and abs(spots[k] - x) <= slack for k, x, slack in self.points)


@dataclass
class Stream:
    """What a stream holds. Offsets (of every frame) and samples leave out the frame that carries the table."""

    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    skipped: int = 0
    checked: int = 0
    failed: int = 0
    table: Table | None = None
    table_ok: bool = False
    ancillary: list[bytes] = field(default_factory=list)


def parse(data: bytes) -> Stream:
    """Parse any MPEG audio stream: ID3v2 in front, ID3v1 behind, frames found again after bytes that are none.

    A header counts if it chains to another one, to the tag behind or to the end, or if its checksum holds; a checksum that
    fails is counted, and the frame kept if its header chains. Bytes passed over while searching are counted. Streams of
    free-format bitrates have no frames. An empty stream has nothing.
    """
    s, at, end, last = Stream(), 0, len(data), 0
    if data[:3] == b"ID3" and end >= 10:
        size = _from_synchsafe(data[6:10])
        s.tags, at = _read_tag(data[10 : 10 + size], data[3], data[5]), 10 + size + (10 if data[5] & 0x10 else 0)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        s.tags.setdefault("title", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    first = True
    while at < end:
        h = header(data, at)
        if h and at + h.length <= end:
            ok = _checksum_ok(data, at, h)
            chained = at + h.length == end or header(data, at + h.length) is not None
            if chained or ok:
                body = at + 4 + 2 * h.protected + (h.side if h.layer == 3 else 0)
                table = (_xing(data, at, body) or _vbri(data, at)) if first and h.layer == 3 else None
                s.checked += ok is not None
                s.failed += ok is False
                if table:
                    s.table = table
                else:
                    s.offsets.append(at)
                    s.samples += h.samples
                    s.rate = s.rate or h.rate
                    if h.layer == 3:
                        s.ancillary.append(data[body : at + h.length])
                at, first = at + h.length, False
                last = at
                continue
        nxt = data.find(b"\xff", at + 1, end)
        nxt = end if nxt < 0 else nxt
        s.skipped, at = s.skipped + nxt - at, nxt
    s.table_ok = s.table is not None and s.table.agrees(s.offsets, last)
    return s


def _xing(data: bytes, at: int, body: int) -> Table | None:
    if data[body : body + 4] not in (b"Xing", b"Info") or len(data) < body + 8:
        return None
    flags, spot, table = int.from_bytes(data[body + 4 : body + 8], "big"), body + 8, Table("xing", at)
    if flags & 1:
        table.frames, spot = int.from_bytes(data[spot : spot + 4], "big"), spot + 4
    if flags & 2:
        table.size, spot = int.from_bytes(data[spot : spot + 4], "big"), spot + 4
    if flags & 4 and table.frames and table.size:
        unit = table.size / 256
        table.points = [(p * table.frames // 100, int(b * unit), int(unit) + 1) for p, b in enumerate(data[spot : spot + 100])]
    return table


def _vbri(data: bytes, at: int) -> Table | None:
    """The other kind of table: 32 bytes behind the frame header, seek steps of some frames each."""
    spot = at + 36
    if data[spot : spot + 4] != b"VBRI" or len(data) < spot + 26:
        return None
    size, frames, n, scale, width, step = struct.unpack(">IIHHHH", data[spot + 10 : spot + 26])
    table, upto = Table("vbri", at, frames, size), 0
    if width in (1, 2, 3, 4) and step:
        for k in range(n):
            entry = data[spot + 26 + k * width : spot + 26 + (k + 1) * width]
            upto += int.from_bytes(entry, "big") * scale
            if (k + 1) * step <= frames:
                table.points.append(((k + 1) * step, upto, (k + 1) * scale + 2880))
    return table


def _from_synchsafe(raw: bytes) -> int:
    return sum((b & 0x7F) << k for b, k in zip(raw, (21, 14, 7, 0)))


def _read_tag(body: bytes, major: int, flags: int) -> dict[str, str]:
    """Text frames of an ID3v2 tag of version 2.2 to 2.4, unsynchronisation undone, an extended header passed over."""
    tags, at, short = {}, 0, major <= 2
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\0", b"\xff")
    if flags & 0x40 and not short and len(body) >= 4:
        at = _from_synchsafe(body[:4]) if major >= 4 else 4 + int.from_bytes(body[:4], "big")
    id_, head = (3, 6) if short else (4, 10)
    while at + head <= len(body) and body[at] != 0:
        name, raw = body[at : at + id_].decode("latin-1"), body[at + id_ : at + 2 * id_]
        size = _from_synchsafe(raw) if major >= 4 else int.from_bytes(raw, "big")
        text, marks = body[at + head : at + head + size], 0 if major < 4 else body[at + 9]
        if marks & 1:
            text = text[4:]
        if marks & 2 or flags & 0x80 and major >= 4:
            text = text.replace(b"\xff\0", b"\xff")
        if name[0] == "T" and text:
            value = text[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(text[0], "utf-8"), "replace")
            key, _, rest = value.partition("\0")
            tags |= {key: rest.rstrip("\0")} if name in ("TXXX", "TXX") else {name: value.rstrip("\0")}
        at += head + size
    return tags


def unpack(stream: Stream) -> bytes:
    """The payload of a stream that ``pack`` made; empty for others, whose tags don't say how long it is."""
    size = stream.tags.get("payload_bytes", "")
    return b"".join(stream.ancillary)[: int(size)] if size.isascii() and size.isdigit() and len(size) < 19 else b""


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text (null: empty) in UTF-8, padded to a positive multiple of 64, as a stream."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), lambda: lambda r: (r[0], len(r[1] or b""), pack(padded(r[1] or b""))), f"doc_id {kind}, n_bytes long, media binary")


FEATURES = "n_frames long, samples long, sample_rate int, duration_us long, skipped_bytes long, crc_checked long, crc_failed long, table_frames long, table_bytes long, table_ok boolean, seek_offsets array<long>"
STORED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def features(media: bytes) -> tuple:
    """A stream's payload digests and features, in the order of STORED and FEATURES; seek offsets are those of all frames."""
    s = parse(media)
    payload = unpack(s)
    duration = s.samples * 1_000_000 // s.rate if s.rate else 0
    said = (s.table.frames or 0, s.table.size or 0) if s.table else (0, 0)
    return (
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(),
        len(s.offsets), s.samples, s.rate, duration, s.skipped, s.checked, s.failed, *said, s.table_ok, s.offsets,
    )


def inspect(media: DataFrame, *keep: str) -> DataFrame:
    """Parse the binary column ``media``; a null is an empty stream. ``keep`` names columns of simple types to carry along."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in media.select(*keep).schema)
    return map_rows(media.select(*keep, "media"), lambda: lambda r: (*r[:-1], *features(r[-1] or b"")), ", ".join(x for x in (kinds, STORED, FEATURES) if x))
