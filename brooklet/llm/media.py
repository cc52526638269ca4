"""Media columns: byte payloads stored as MPEG transport streams (ISO/IEC 13818-1) and read back.

``mux`` writes a payload as one program with one private elementary stream: access units of UNIT_BYTES, each a PES
packet with a presentation time stamp; every GROUP-th unit is a random-access point, is preceded by the program
association and program map tables, and carries a clock reference. ``demux`` takes nothing for granted about the
stream but the packet length: it finds the elementary stream through the two tables (checking their CRC), checks the
continuity counters, reassembles the PES packets and returns payload, time stamps and random-access points.

Both work on whole arrays of packets with numpy; memory is a few times the largest single payload.

Defined results: null and empty payloads are stored as one padded unit by ``op10`` (``mux`` itself stores an empty
payload as a stream without units); equal payloads give equal streams; extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_arrow, slices, stored, texts_as_bytes

PACKET, SYNC = 188, 0x47
PAD_TO, UNIT_BYTES, GROUP = 192, 192 * 16, 16
PMT_PID, STREAM_PID, PROGRAM = 0x1000, 0x100, 1
PRIVATE_DATA, PRIVATE_STREAM_1 = 0x06, 0xBD
#: 90 kHz ticks between two units.
TICKS = 3600
PES_HEADER = 14


@lru_cache
def _crc_table() -> tuple[int, ...]:
    out = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return tuple(out)


def section_crc(data: bytes) -> int:
    c, lookup = 0xFFFFFFFF, _crc_table()
    for byte in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ lookup[(c >> 24) ^ byte]
    return c


def _section_packet(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    section = head + body
    section += section_crc(section).to_bytes(4, "big")
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


@lru_cache
def _tables() -> np.ndarray:
    pat = _section_packet(0, 0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    stream = bytes([PRIVATE_DATA]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = _section_packet(PMT_PID, 2, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + stream)
    return np.frombuffer(pat + pmt, np.uint8).reshape(2, PACKET)


@lru_cache(maxsize=64)
def _template(size: int, access: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Packets of a unit of `size` bytes without payload and stamps, the flat places of its payload, and of its PES header."""
    adaptation = 8 if access else 0
    first = min(PACKET - 4 - adaptation - PES_HEADER, size)
    count = 1 + -(-(size - first) // (PACKET - 4))
    out = np.full((count, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = SYNC, STREAM_PID >> 8, STREAM_PID & 255, 0x10
    out[0, 1] |= 0x40
    places, left, start = [], size, 0
    for k in range(count):
        head = PES_HEADER if k == 0 else 0
        room = PACKET - 4 - (adaptation if k == 0 else 0) - head
        take = min(room, left)
        stuffing = room - take
        if k == 0 and access:
            out[k, 3], out[k, 4], out[k, 5] = 0x30, 7 + stuffing, 0x50
            at = 12 + stuffing
        elif stuffing:
            out[k, 3], out[k, 4] = 0x30, stuffing - 1
            if stuffing > 1:
                out[k, 5] = 0
            at = 4 + stuffing
        else:
            at = 4
        if k == 0:
            start = at
            header = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (size + PES_HEADER - 6).to_bytes(2, "big") + b"\x84\x80\x05"
            out[0, at : at + 9] = np.frombuffer(header, np.uint8)
        places.append(np.arange(at + head, at + head + take) + k * PACKET)
        left -= take
    return out, np.concatenate(places), start


def _units(payload: np.ndarray, first: int, size: int, access: np.ndarray) -> list[np.ndarray]:
    """Packets of equal units; unit k of the stream is payload row k - first."""
    out: list = [None] * len(payload)
    for kind in (True, False):
        rows = np.flatnonzero(access == kind)
        if not len(rows):
            continue
        template, places, start = _template(size, kind)
        made = np.repeat(template.reshape(1, -1), len(rows), 0)
        made[:, places] = payload[rows]
        pts = (rows + first).astype(np.int64) * TICKS
        stamp = ((0x2 << 36) | ((pts >> 30 & 7) << 33) | (1 << 32) | ((pts >> 15 & 0x7FFF) << 17) | (1 << 16) | ((pts & 0x7FFF) << 1) | 1)
        for k in range(5):
            made[:, start + 9 + k] = (stamp >> (8 * (4 - k))) & 255
        if kind:
            clock = (pts << 15) | (0x3F << 9)
            for k in range(6):
                made[:, 6 + k] = (clock >> (8 * (5 - k))) & 255
        for row, packets in zip(rows.tolist(), made.reshape(len(rows), -1, PACKET), strict=True):
            out[row] = packets
    return out


def mux(payload: bytes) -> bytes:
    data = np.frombuffer(payload, np.uint8)
    whole, rest = divmod(len(data), UNIT_BYTES)
    access = np.arange(whole + bool(rest)) % GROUP == 0
    units = _units(data[: whole * UNIT_BYTES].reshape(whole, UNIT_BYTES), 0, UNIT_BYTES, access[:whole])
    if rest:
        units += _units(data[whole * UNIT_BYTES :].reshape(1, rest), whole, rest, access[whole:])
    parts, is_table = [], []
    for k, unit in enumerate(units):
        if access[k]:
            parts.append(_tables())
            is_table.append(np.ones(2, bool))
        parts.append(unit)
        is_table.append(np.zeros(len(unit), bool))
    if not parts:
        parts, is_table = [_tables()], [np.ones(2, bool)]
    out, is_table = np.concatenate(parts), np.concatenate(is_table)
    counters = np.where(is_table, np.cumsum(is_table) - 1 >> 1, np.cumsum(~is_table) - 1) & 15
    out[:, 3] |= counters.astype(np.uint8)
    return out.tobytes()


def _section(packet: np.ndarray) -> tuple[bytes, bool]:
    raw = packet.tobytes()
    at = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
    at += 1 + raw[at]
    size = 3 + (int.from_bytes(raw[at + 1 : at + 3], "big") & 0xFFF)
    section = raw[at : at + size]
    return section, section_crc(section) == 0


def demux(stream: bytes) -> dict:
    """payload, pts (ticks of each unit), random_access (units), discontinuities, bad_sections, packets.

    Raises ValueError for a stream without sync bytes or without a program.
    """
    packets = np.frombuffer(stream, np.uint8)
    if len(packets) % PACKET:
        raise ValueError("length is no multiple of the packet length")
    packets = packets.reshape(-1, PACKET)
    if not (packets[:, 0] == SYNC).all():
        raise ValueError("sync byte missing")
    pid = ((packets[:, 1].astype(np.int32) & 0x1F) << 8) | packets[:, 2]
    bad, pmt_pid, stream_pid = 0, None, None
    known: dict[bytes, tuple[bytes, bool]] = {}
    for k in np.flatnonzero(pid == 0).tolist():
        key = packets[k, 4:].tobytes()
        section, good = known.get(key) or known.setdefault(key, _section(packets[k]))
        bad += not good
        if good and pmt_pid is None:
            pmt_pid = int.from_bytes(section[10:12], "big") & 0x1FFF
    for k in np.flatnonzero(pid == pmt_pid).tolist() if pmt_pid is not None else []:
        key = packets[k, 4:].tobytes()
        section, good = known.get(key) or known.setdefault(key, _section(packets[k]))
        bad += not good
        if good and stream_pid is None:
            at = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
            if len(section) >= at + 9:
                stream_pid = int.from_bytes(section[at + 1 : at + 3], "big") & 0x1FFF
    if stream_pid is None:
        raise ValueError("no program found")
    own = packets[pid == stream_pid]
    has_adaptation, has_payload = (own[:, 3] & 0x20) > 0, (own[:, 3] & 0x10) > 0
    counter = (own[:, 3] & 15).astype(np.int16)
    steps = (np.diff(counter) - has_payload[1:]) & 15
    offset = 4 + np.where(has_adaptation, 1 + own[:, 4].astype(np.int32), 0)
    offset = np.where(has_payload, np.minimum(offset, PACKET), PACKET)
    elementary = own[np.arange(PACKET) >= offset[:, None]]
    starts = np.cumsum(PACKET - offset) - (PACKET - offset)
    begins = np.flatnonzero((own[:, 1] & 0x40) > 0)
    at = starts[begins]
    if len(at):
        head = elementary[at[:, None] + np.arange(PES_HEADER)]
        if (head[:, :3] != (0, 0, 1)).any():
            raise ValueError("a unit starts without a start code")
        wide = head.astype(np.int64)
        pts = ((wide[:, 9] >> 1 & 7) << 30) | (wide[:, 10] << 22) | ((wide[:, 11] >> 1) << 15) | (wide[:, 12] << 7) | (wide[:, 13] >> 1)
        heads = 9 + wide[:, 8]
        keep = np.ones(len(elementary) + 1, np.int8)
        keep[:] = 0
        np.add.at(keep, at, 1)
        np.add.at(keep, at + heads, -1)
        payload = elementary[np.cumsum(keep[:-1]) == 0]
        sizes = np.diff(np.append(at, len(elementary))) - 6
        bad += int((sizes != (wide[:, 4] << 8 | wide[:, 5])).sum())
    else:
        pts, payload = np.empty(0, np.int64), elementary
    access = has_adaptation[begins] & (own[begins, 4] > 0) & ((own[begins, 5] & 0x40) > 0)
    return {"payload": payload.tobytes(), "pts": pts, "random_access": np.flatnonzero(access), "discontinuities": int((steps != 0).sum()), "bad_sections": bad, "packets": len(packets)}


def media_column(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the padded text of each document as a transport stream."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            texts = texts_as_bytes(batch.column("text"))
            media = [mux(x.ljust(max(1, -(-len(x) // PAD_TO)) * PAD_TO, b" ")) for x in texts]
            yield pa.record_batch([batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return documents.select("doc_id", "text").transform(in_arrow, make, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, units long, random_access_pts array<long>"


def media_features(media: DataFrame) -> DataFrame:
    """What demux finds in each stored stream, with digests of payload and stream."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            rows = []
            for stream in batch.column("media").to_pylist():
                got = demux(stream)
                payload, access = got["payload"], got["pts"][got["random_access"]]
                rows.append((
                    len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stream), hashlib.sha256(stream).hexdigest(),
                    f"packets={got['packets']};units={len(got['pts'])};random_access={len(access)};last_pts={got['pts'][-1] if len(got['pts']) else -1};discontinuities={got['discontinuities']};bad_sections={got['bad_sections']}",
                    len(got["pts"]), access.tolist(),
                ))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *columns], [x.split()[0] for x in FEATURES.split(", ")])

    return media.transform(in_arrow, read, FEATURES)


def op10(documents: DataFrame) -> DataFrame:
    """Stores every text as a transport stream in the shared folder, reads the streams back and returns their features."""
    return media_features(stored(media_column(documents), "media"))
