"""Media column: MPEG transport streams (ISO/IEC 13818-1).

``mux`` writes a payload as one private elementary stream: a program
association table, a program map table, then packetised elementary packets
(PES) with presentation timestamps.  Every ``RANDOM_ACCESS``-th PES begins at a
random-access point with a clock reference, the tables repeat before it.
``demux`` trusts nothing but the stream: it finds the program's packets by its
tables, checks section CRCs and continuity counters, reassembles the PES and
returns payload, timestamps and random-access points.

A payload is padded with blanks to a positive multiple of 192 bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import short_batches, whole_text

UNIT = 192
PACKET = 188
SYNC = 0x47
PMT_PID, STREAM_PID, PROGRAM, STREAM_TYPE = 0x1000, 0x0100, 1, 0x06
PES_DATA = 48 * UNIT  # payload bytes of a PES
RANDOM_ACCESS = 8  # PES from one random-access point to the next
TICKS = 3600  # of the 90 kHz clock, from one PES to the next


def padded(data: bytes) -> bytes:
    """``data`` with blanks up to a positive multiple of 192 bytes."""
    size = max(1, -(-len(data) // UNIT)) * UNIT
    return data.ljust(size, b" ")


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1
        table.append(crc)
    return table


_CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    """The CRC-32 of program tables."""
    crc = 0xFFFFFFFF
    for b in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC[crc >> 24 ^ b]
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section.ljust(PACKET - 5, b"\xff")


_PAT = _table_packet(0, _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(0x02, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\0"))


def _timestamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 255, 0x01 | pts << 1 & 0xFE])


def mux(payload: bytes) -> bytes:
    """A transport stream of ``payload``."""
    out: list[bytes] = []
    counter = tables = 0
    for n, start in enumerate(range(0, len(payload), PES_DATA)):
        data = payload[start : start + PES_DATA]
        pes = b"\0\0\1\xbd" + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(n * TICKS & (1 << 33) - 1) + data
        first = b""
        if n % RANDOM_ACCESS == 0:
            for table in (_PAT, _PMT):
                out.append(table[:3] + bytes([0x10 | tables & 15]) + table[4:])
            tables += 1
            clock = n * TICKS & (1 << 33) - 1
            first = bytes([7, 0x50]) + (clock << 15 | 0x7E00).to_bytes(6, "big")
        head = min(len(pes), PACKET - 4 - len(first))
        whole, tail = divmod(len(pes) - head, PACKET - 4)
        count = 1 + whole + (tail > 0)
        block = np.zeros((count, PACKET), np.uint8)
        block[:, 0], block[:, 1], block[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 255
        block[:, 3] = 0x10 | (counter + np.arange(count)) & 15
        counter += count
        block[0, 1] |= 0x40
        raw = np.frombuffer(pes, np.uint8)
        _fill(block[0], first, raw[:head])
        if whole:
            block[1 : 1 + whole, 4:] = raw[head : head + whole * (PACKET - 4)].reshape(whole, PACKET - 4)
        if tail:
            _fill(block[-1], b"", raw[-tail:])
        out.append(block.tobytes())
    return b"".join(out)


def _fill(packet: np.ndarray, field_: bytes, data: np.ndarray) -> None:
    """Adaptation field, stuffing and data of one packet."""
    spare = PACKET - 4 - len(data)
    if spare:
        if not field_ and spare > 1:
            field_ = b"\0\0"
        field_ = bytes([spare - 1]) + field_[1:].ljust(spare - 1, b"\xff")
        packet[3] |= 0x20
        packet[4 : 4 + spare] = np.frombuffer(field_, np.uint8)
    packet[4 + spare :] = data


@dataclass
class Stream:
    """What ``demux`` finds."""

    payload: bytes = b""
    packets: int = 0
    stream_type: int = 0
    pid: int = 0
    timestamps: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)  # packet numbers
    breaks: int = 0  # of the continuity counters
    crc_errors: int = 0


def _tables(packets: np.ndarray, pid: int, found: Stream) -> Iterator[bytes]:
    """Bodies of the sections that begin in packets of ``pid``."""
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    for row in packets[(pids == pid) & (packets[:, 1] & 0x40 > 0)]:
        raw = row.tobytes()
        at = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
        at += 1 + raw[at]
        size = int.from_bytes(raw[at + 1 : at + 3], "big") & 0xFFF
        section = raw[at : at + 3 + size]
        if crc_mpeg(section):
            found.crc_errors += 1
        else:
            yield section[8:-4]


def demux(stream: bytes) -> Stream:
    """Read a transport stream; raises ``ValueError`` where it has none."""
    if not stream or len(stream) % PACKET:
        raise ValueError("not a whole number of packets")
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("lost synchronisation")
    found = Stream(packets=len(packets))
    pmt = next((int.from_bytes(b[2:4], "big") & 0x1FFF for b in _tables(packets, 0, found)), None)
    body = None if pmt is None else next(_tables(packets, pmt, found), None)
    if body is None:
        raise ValueError("no program table")
    at = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF)
    found.stream_type, found.pid = body[at], int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    where = np.flatnonzero(pids == found.pid)
    own = packets[where]
    counters = own[:, 3].astype(np.int32) & 15
    has_data, has_field = (own[:, 3] & 0x10) > 0, (own[:, 3] & 0x20) > 0
    found.breaks = int(((counters[1:] - counters[:-1] - has_data[1:]) & 15 != 0).sum())
    offsets = 4 + np.where(has_field, 1 + own[:, 4].astype(np.int32), 0)
    offsets[~has_data] = PACKET
    flagged = has_field & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)
    found.random_access = where[flagged].tolist()
    data = own[np.arange(PACKET) >= offsets[:, None]].tobytes()
    ends = np.cumsum(PACKET - offsets)
    starts = (ends - (PACKET - offsets))[(own[:, 1] & 0x40) > 0].tolist()
    parts = []
    for begin, end in zip(starts, [*starts[1:], len(data)], strict=True):
        if data[begin : begin + 3] != b"\0\0\1":
            raise ValueError("no elementary packet where one begins")
        size = int.from_bytes(data[begin + 4 : begin + 6], "big")
        if data[begin + 7] & 0x80:
            b = data[begin + 9 : begin + 14]
            found.timestamps.append((b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1)
        parts.append(data[begin + 9 + data[begin + 8] : begin + 6 + size if size else end])
    found.payload = b"".join(parts)
    return found


def feature(s: Stream) -> str:
    """A stream's summary: pid, type, packets, timestamps, random-access points, faults."""
    pts = f"{s.timestamps[0]}-{s.timestamps[-1]}" if s.timestamps else "-"
    return f"pid={s.pid};type={s.stream_type};packets={s.packets};pes={len(s.timestamps)};pts={pts};rap={','.join(map(str, s.random_access))};breaks={s.breaks};crc_errors={s.crc_errors}"


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each text as a transport stream.

    Defined cases: null counts as empty, and an empty text is 192 blanks; ids
    may be null or repeated; an empty table gives an empty result; other
    columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                raw = [x.as_py().encode() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([mux(padded(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return short_batches(docs).select(docs[id_col].alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, n_bytes long, media binary")


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def read_media(media: DataFrame) -> DataFrame:
    """Digests, features, timestamps and random-access points of a media column, from its stored bytes alone.

    ``timestamps`` are those of the elementary packets on the 90 kHz clock,
    ``random_access`` the numbers of the packets at which decoding can begin,
    ``continuity_breaks`` and ``table_errors`` count faults.

    Defined cases: null and empty text are stored as 192 blanks; null or
    repeated ids are passed on; a null or damaged stream gives a row whose
    ``error`` says what is wrong, with nulls for what can't be read; an empty
    table gives an empty result.
    """
    id_type = media.schema["doc_id"].dataType.simpleString()
    kinds = {
        "payload_bytes": pa.int64(),
        "payload_sha256": pa.string(),
        "tail_crc32": pa.int64(),
        "media_bytes": pa.int64(),
        "media_sha256": pa.string(),
        "feature": pa.string(),
        "timestamps": pa.list_(pa.int64()),
        "random_access": pa.list_(pa.int64()),
        "continuity_breaks": pa.int64(),
        "table_errors": pa.int64(),
        "error": pa.string(),
    }

    def read(stored: bytes | None) -> tuple:
        whole = (None, None) if stored is None else (len(stored), hashlib.sha256(stored).hexdigest())
        try:
            s = demux(stored or b"")
        except (ValueError, IndexError) as e:
            return (None, None, None, *whole, None, None, None, None, None, str(e) or "damaged")
        return (len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]), *whole, feature(s), s.timestamps, s.random_access, s.breaks, s.crc_errors, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read(value.as_py()) for value in batch.column(2)]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True))], ["doc_id", "n_bytes", *kinds])

    schema = f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps array<long>, random_access array<long>, continuity_breaks long, table_errors long, error string"
    return short_batches(media).select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
