"""Media columns: MPEG transport streams that carry a payload losslessly, written and parsed here."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise

# Fixed values of ISO/IEC 13818-1.
PACKET = 188
SYNC = 0x47
PAT_PID = 0x0000
PMT_PID = 0x0100
DATA_PID = 0x0101
PROGRAM = 1
STREAM_TYPE_PRIVATE_PES = 0x06
STREAM_ID_PRIVATE_1 = 0xBD
CLOCK = 90_000
MASK = (1 << 33) - 1

#: Payload bytes of an access unit, ticks between units, and units between random-access points.
UNIT = 16_384
TICKS = CLOCK // 25
ACCESS = 8


class StreamError(ValueError):
    """A stream that breaks the format: sync, section checksum, continuity, length or timestamp."""


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        table.append(c & 0xFFFFFFFF)
    return table


_TABLE = _crc_table()


def section_crc(data: bytes) -> int:
    """The CRC-32 of program tables: polynomial 04C11DB7, most significant bit first."""
    c = 0xFFFFFFFF
    for byte in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _TABLE[(c >> 24) ^ byte]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes, count: int) -> bytes:
    body = b"\x00" + section
    return bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | count & 15]) + body + b"\xff" * (PACKET - 4 - len(body))


_ASSOCIATION = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_MAP = _section(0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE_PRIVATE_PES]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, (pts >> 14) & 0xFE | 1, (pts >> 7) & 0xFF, (pts << 1) & 0xFE | 1])


def _clock(base: int) -> bytes:
    """A program clock reference of a 33-bit base, extension 0."""
    return (base << 15 | 0x7E00).to_bytes(6, "big")


def mux(payload: bytes) -> bytes:
    """A single-program stream: one elementary packet an access unit, its first packet with the program clock.

    A unit is presented a tick after the clock at which it comes. Program tables stand before each random-access point, so
    that a reader can begin there.
    """
    out, count, tables = [], 0, 0
    for unit, at in enumerate(range(0, len(payload), UNIT)):
        access = unit % ACCESS == 0
        if access:
            out += [_table_packet(PAT_PID, _ASSOCIATION, tables), _table_packet(PMT_PID, _MAP, tables)]
            tables += 1
        data, clock = payload[at : at + UNIT], unit * TICKS & MASK
        pes = b"\x00\x00\x01" + bytes([STREAM_ID_PRIVATE_1]) + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(clock + TICKS & MASK) + data
        place = 0
        while place < len(pes):
            start = place == 0
            field = b"\x07" + bytes([0x10 | access << 6]) + _clock(clock) if start else b""
            room = PACKET - 4 - len(field)
            if (pad := room - (len(pes) - place)) > 0:  # the last packet is filled up by its adaptation field
                if field:
                    field = bytes([field[0] + pad]) + field[1:] + b"\xff" * pad
                else:
                    field = b"\x00" if pad == 1 else bytes([pad - 1]) + b"\x00" + b"\xff" * (pad - 2)
                room -= pad
            out.append(bytes([SYNC, start << 6 | DATA_PID >> 8, DATA_PID & 255, (0x30 if field else 0x10) | count]))
            out.append(field)
            out.append(pes[place : place + room])
            place += room
            count = (count + 1) & 15
    return b"".join(out)


def _read_section(payload: bytes, table_id: int) -> bytes:
    at = 1 + payload[0]
    size = 3 + (int.from_bytes(payload[at + 1 : at + 3], "big") & 0x0FFF)
    section = payload[at : at + size]
    if section[0] != table_id or len(section) != size or section_crc(section):
        raise StreamError("a program table fails its checksum")
    return section[8:-4]


def demux(stream: bytes) -> tuple[bytes, dict]:
    """The payload of the first program's first stream, and what the stream's structure says.

    Follows the program association and map tables, checks sync bytes, section checksums and, for each PID,
    the continuity counter of every packet with payload, reassembles elementary packets by their lengths, and reads each
    one's timestamp, the clock it came at and whether it is a random-access point. No unit may be due before its clock.
    """
    if len(stream) % PACKET:
        raise StreamError("not a whole number of packets")
    map_pid = data_pid = None
    last: dict[int, int] = {}
    parts, units, stamps, clocks, access = [], [], [], [], []

    def close() -> None:
        pes = b"".join(parts)
        if not pes.startswith(b"\x00\x00\x01") or len(pes) != 6 + int.from_bytes(pes[4:6], "big") or pes[7] & 0xC0 != 0x80:
            raise StreamError("an elementary packet is broken")
        stamps.append((pes[9] & 0x0E) << 29 | pes[10] << 22 | (pes[11] & 0xFE) << 14 | pes[12] << 7 | pes[13] >> 1)
        units.append(pes[9 + pes[8] :])
        parts.clear()

    for at in range(0, len(stream), PACKET):
        if stream[at] != SYNC:
            raise StreamError(f"no sync byte at {at}")
        pid = (stream[at + 1] & 0x1F) << 8 | stream[at + 2]
        control = stream[at + 3]
        begin, random_access, clock = at + 4, False, None
        if control & 0x20:
            size = stream[begin]
            random_access = size > 0 and bool(stream[begin + 1] & 0x40)
            if size > 6 and stream[begin + 1] & 0x10:
                clock = int.from_bytes(stream[begin + 2 : begin + 8], "big") >> 15
            begin += 1 + size
        start = bool(stream[at + 1] & 0x40)
        if control & 0x10:
            if pid in last and control & 15 != (last[pid] + 1) & 15:
                raise StreamError(f"continuity breaks at packet {at // PACKET}")
            last[pid] = control & 15
        if pid == data_pid:
            if start:
                if parts:
                    close()
                access.append(random_access)
                clocks.append(clock)
            parts.append(stream[begin : at + PACKET])
        elif pid == PAT_PID:
            map_pid = int.from_bytes(_read_section(stream[begin : at + PACKET], 0x00)[2:4], "big") & 0x1FFF
        elif pid == map_pid:
            body = _read_section(stream[begin : at + PACKET], 0x02)
            skip = 4 + (int.from_bytes(body[2:4], "big") & 0x0FFF)
            data_pid = int.from_bytes(body[skip + 1 : skip + 3], "big") & 0x1FFF
    if parts:
        close()
    if data_pid is None or any((b - a) % (1 << 33) > 1 << 32 for a, b in zip(stamps, stamps[1:], strict=False)):
        raise StreamError("no program, or timestamps that run back")
    if any(c is not None and (s - c) % (1 << 33) > 1 << 32 for s, c in zip(stamps, clocks, strict=True)):
        raise StreamError("a unit is due before its clock")
    points = [s for s, a in zip(stamps, access, strict=True) if a]
    return b"".join(units), {"pid": data_pid, "packets": len(stream) // PACKET, "units": len(units), "timestamps": stamps, "random_access": points}


def payload_of(text: bytes | None) -> tuple[int, bytes]:
    """A text's length in UTF-8 bytes, and its payload: the bytes with zeros up to a positive multiple of 64."""
    data = text or b""
    size = max(64, -(-len(data) // 64) * 64)
    return len(data), data.ljust(size, b"\x00")


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): every row's whole text as a transport stream. Null counts as empty."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [payload_of(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in both], pa.int64()), pa.array([mux(p) for _, p in both], pa.binary())], ["key", "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps array<long>, random_access array<long>"


def decode(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Parse the stored streams again: payload digests and the structure's features, timestamps and random-access points."""
    bounded_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stream in batch.column(2).to_pylist():
                payload, seen = demux(stream)
                points, stamps = seen["random_access"], seen["timestamps"]
                feature = f"pid={seen['pid']};packets={seen['packets']};units={seen['units']};pts={stamps[0]}-{stamps[-1]};access={len(points)}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), feature, stamps, points))
            names = [f.split()[0] for f in FEATURES.split(", ")]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], ["key", "n_bytes", *names])

    kind = media.schema[key].dataType.simpleString()
    return media.select(F.col(key), "n_bytes", "media").mapInArrow(run, f"key {kind}, n_bytes long, {FEATURES}").withColumnRenamed("key", key)


def media_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as a transport stream in a media table, read the table back and parse it.

    Null and empty texts become 64 zero bytes; equal texts give equal streams and features; equal
    rows each keep their row; other columns are ignored; an empty table gives an empty result. A broken
    stream raises StreamError.
    """
    return decode(materialise(encode(docs, key, text), "media"), key)
