"""Media columns as MPEG transport streams.

``mux`` stores a payload as the private data stream of a one-program transport
stream: a program association and a program map table, then one PES packet for
each access unit with a presentation time stamp, all cut into packets of 188
bytes with continuity counters.  Every ``gop``-th access unit is a random-access
point.  ``demux`` reads any such stream: it finds the sync bytes, parses the
tables (with their checksums), checks continuity counters, reassembles PES
packets and keeps time stamps and random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import at, col, free_name, map_rows

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID, NULL_PID = 0, 0x1000, 0x100, 0x1FFF
PRIVATE_STREAM_1, PRIVATE_DATA = 0xBD, 0x06
CLOCK = 90_000


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_TABLE = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32 as program tables use it; 0 over a section that includes its own."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) ^ _TABLE[(c >> 24) ^ b]) & 0xFFFFFFFF
    return c


def _section_packet(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    section = bytes([table_id, 0xB0 | length >> 8, length & 0xFF]) + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    section += section_crc(section).to_bytes(4, "big")
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
    return packet + b"\xff" * (PACKET - len(packet))


@lru_cache(None)
def _tables() -> bytes:
    pat = _section_packet(PAT_PID, 0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section_packet(PMT_PID, 2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
    return pat + pmt


def _stamp(pts: int) -> bytes:
    pts &= (1 << 33) - 1
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def _clock(ticks: int) -> bytes:
    base = ticks & ((1 << 33) - 1)
    return (base << 15 | 0x3F << 9).to_bytes(6, "big")


def mux(payload: bytes, unit: int = 16 * 1024, ticks: int = 3600, gop: int = 8) -> bytes:
    """The payload as a transport stream; access units of ``unit`` bytes, ``ticks`` of 1/90000 s apart."""
    out, counter = [_tables()], 0
    for n, a in enumerate(range(0, len(payload), unit)):
        data = payload[a : a + unit]
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(n * ticks) + data
        # the first packet has an adaptation field with the clock, and the random-access flag where due
        first = min(len(pes), PACKET - 12)
        pad = PACKET - 12 - first
        head = bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 0xFF, 0x30 | counter, 7 + pad, 0x50 if n % gop == 0 else 0x10]) + _clock(n * ticks)
        out.append(head + b"\xff" * pad + pes[:first])
        counter = (counter + 1) & 15
        rest = np.frombuffer(pes, np.uint8)[first:]
        whole, tail = divmod(len(rest), PACKET - 4)
        if whole:
            packets = np.empty((whole, PACKET), np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
            packets[:, 3] = 0x10 | (counter + np.arange(whole)) & 15
            packets[:, 4:] = rest[: whole * (PACKET - 4)].reshape(whole, PACKET - 4)
            out.append(packets.tobytes())
            counter = (counter + whole) & 15
        if tail:
            stuffing = PACKET - 5 - tail
            head = bytes([SYNC, DATA_PID >> 8, DATA_PID & 0xFF, 0x30 | counter, stuffing])
            out.append(head + (b"\x00" + b"\xff" * (stuffing - 1) if stuffing else b"") + rest[-tail:].tobytes())
            counter = (counter + 1) & 15
    return b"".join(out)


@dataclass
class Unit:
    """One access unit.  ``pts`` is None where the packet has none; ``packet`` is the number of its first."""

    pid: int
    pts: int | None
    random_access: bool
    packet: int
    data: bytes
    complete: bool = True


@dataclass
class Stream:
    packets: int = 0
    lost_bytes: int = 0  # skipped in search of sync
    crc_errors: int = 0
    continuity_errors: int = 0
    transport_errors: int = 0
    duplicates: int = 0
    programs: dict[int, int] = field(default_factory=dict)  # program: PID of its map
    streams: dict[int, int] = field(default_factory=dict)  # PID: stream type
    units: list[Unit] = field(default_factory=list)
    clocks: list[tuple[int, int]] = field(default_factory=list)  # packet, program clock in 1/27000000 s

    @property
    def payload(self) -> bytes:
        return b"".join(u.data for u in self.units)


def _aligned(data: bytes) -> tuple[np.ndarray, int]:
    """Whole packets that start with a sync byte, and the number of bytes skipped between them."""
    n = len(data) // PACKET
    packets = np.frombuffer(data, np.uint8, n * PACKET).reshape(n, PACKET)
    if (packets[:, 0] == SYNC).all():
        return packets, len(data) - n * PACKET
    found, at, lost = [], 0, 0
    while at + PACKET <= len(data):
        # a sync byte counts right after a packet, or if another follows a packet later, or the data end there
        if data[at] == SYNC and ((found and found[-1] + PACKET == at) or at + PACKET >= len(data) or data[at + PACKET] == SYNC):
            found.append(at)
            at += PACKET
        else:
            at, lost = at + 1, lost + 1
    lost += len(data) - at
    rows = np.array(found, np.int64)[:, None] + np.arange(PACKET)
    return np.frombuffer(data, np.uint8)[rows] if found else np.zeros((0, PACKET), np.uint8), lost


def demux(data: bytes) -> Stream:
    """Parses a transport stream; damage is counted, never raised."""
    packets, lost = _aligned(data)
    out = Stream(packets=len(packets), lost_bytes=lost)
    raw = packets.tobytes()
    pids = ((packets[:, 1].astype(np.int32) & 0x1F) << 8) | packets[:, 2]
    last: dict[int, tuple[int, int]] = {}
    open_: dict[int, tuple[int, bool, list[bytes]]] = {}
    tables: dict[int, bytes] = {}  # what was read of a table's current section

    def close(pid: int) -> None:
        if (was := open_.pop(pid, None)) is None:
            return
        packet, access, parts = was
        pes = b"".join(parts)
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
            return
        size = int.from_bytes(pes[4:6], "big")
        begin = 9 + pes[8]
        stop = 6 + size if size else len(pes)
        pts = None
        if pes[7] & 0x80 and len(pes) >= 14:
            p = pes[9:14]
            pts = (p[0] >> 1 & 7) << 30 | p[1] << 22 | (p[2] >> 1) << 15 | p[3] << 7 | p[4] >> 1
        out.units.append(Unit(pid, pts, access, packet, pes[begin:stop], len(pes) >= stop))

    def read_section(section: bytes) -> None:
        if len(section) < 12 or section_crc(section):
            out.crc_errors += 1
        elif section[0] == 0:
            for k in range(8, len(section) - 4, 4):
                if number := int.from_bytes(section[k : k + 2], "big"):
                    out.programs[number] = int.from_bytes(section[k + 2 : k + 4], "big") & 0x1FFF
        elif section[0] == 2:
            k = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
            while k + 5 <= len(section) - 4:
                out.streams[int.from_bytes(section[k + 1 : k + 3], "big") & 0x1FFF] = section[k]
                k += 5 + (int.from_bytes(section[k + 3 : k + 5], "big") & 0xFFF)

    def read_table(pid: int, body: bytes, starts: bool) -> None:
        if starts:
            before = body[1 : 1 + body[0]]  # the end of the section that the packets before began
            if pid in tables and before:
                read_table(pid, before, False)
            tables[pid], body = b"", body[1 + body[0] :]
        if pid not in tables:
            return
        data = tables.pop(pid) + body
        while data and data[0] != 0xFF:
            size = 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)
            if len(data) < max(size, 3):
                tables[pid] = data
                return
            read_section(data[:size])
            data = data[size:]

    for i, pid in enumerate(pids.tolist()):
        at = i * PACKET
        b1, b3 = raw[at + 1], raw[at + 3]
        if b1 & 0x80:
            out.transport_errors += 1
            continue
        if pid == NULL_PID:
            continue
        start, access, jump = 4, False, False
        if b3 & 0x20:
            n = raw[at + 4]
            start = 5 + n
            if n:
                access, jump = bool(raw[at + 5] & 0x40), bool(raw[at + 5] & 0x80)
                if raw[at + 5] & 0x10 and n >= 7:
                    clock = int.from_bytes(raw[at + 6 : at + 12], "big")
                    out.clocks.append((i, (clock >> 15) * 300 + (clock & 0x1FF)))
        if not b3 & 0x10 or start >= PACKET:
            continue
        counter = b3 & 15
        before = last.get(pid)
        if before is not None and not jump:
            if counter == before[0] and raw[at : at + PACKET] == raw[before[1] : before[1] + PACKET]:
                out.duplicates += 1
                continue
            if counter != (before[0] + 1) & 15:
                out.continuity_errors += 1
        last[pid] = (counter, at)
        body = raw[at + start : at + PACKET]
        if pid == PAT_PID or pid in out.programs.values():
            if jump or (before is not None and counter != (before[0] + 1) & 15):
                tables.pop(pid, None)  # what is missing broke the section
            read_table(pid, body, bool(b1 & 0x40))
        elif pid in out.streams:
            if b1 & 0x40:
                close(pid)
                open_[pid] = (i, access, [body])
            elif pid in open_:
                open_[pid][2].append(body)
    for pid in list(open_):
        close(pid)
    out.crc_errors += len(tables)  # sections without their end
    return out


def features(s: Stream) -> str:
    """A digest of the stream: counts, errors, the range of time stamps, random-access packets."""
    stamps = [u.pts for u in s.units if u.pts is not None]
    access = [u.packet for u in s.units if u.random_access]
    return (
        f"programs={len(s.programs)};streams={','.join(f'{p}:{t}' for p, t in sorted(s.streams.items()))};packets={s.packets};units={len(s.units)};"
        f"pts={min(stamps, default=0)}-{max(stamps, default=0)};clocks={len(s.clocks)};access={','.join(map(str, access))};"
        f"errors={s.continuity_errors + s.crc_errors + s.transport_errors + s.lost_bytes};incomplete={sum(not u.complete for u in s.units)}"
    )


# --------------------------------------------------------------------------- columns


def padded(text: bytes, block: int = 64) -> bytes:
    """With bytes 0 up to a positive multiple of ``block``."""
    return text + bytes(max(block, -(-len(text) // block) * block) - len(text))


def add_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with one more column, the last: the text in UTF-8, padded and stored as a transport stream.

    It is called ``media``, with underscores before it where ``docs`` has such a
    column.  Null counts as empty.
    """
    place = at(docs, text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                made = pa.array([mux(padded((t or "").encode())) for t in part.column(place).to_pylist()], pa.binary())
                yield pa.record_batch([*part.columns, made], [*part.schema.names, "added"])

    return map_rows(docs, run, free_name(docs, media), "binary")


_READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(docs: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Reads the stored streams: ``keep`` and payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, units.

    Where ``keep`` has such a name, the read one has underscores before it.
    ``units`` has pts, random_access, packet and bytes of every access unit.  A
    null stream gives nulls; a damaged one gives what can be read of it, with
    its errors counted in ``feature``.
    """
    read = [x.split()[0] for x in _READ.split(", ")] + ["units"]
    kept = docs.select(*map(col, keep), col(media).alias("media")).toDF(*[f"c{i}" for i in range(len(keep))], "media")
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept.schema[:-1])
    kinds += _READ + ", units array<struct<pts:long,random_access:boolean,packet:int,bytes:int>>"
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("pts", pa.int64()), ("random_access", pa.bool_()), ("packet", pa.int32()), ("bytes", pa.int32())]))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for value in batch.column(len(keep)):
                if (data := value.as_py()) is None:
                    rows.append((None,) * len(types))
                    continue
                s = demux(data)
                payload = s.payload
                units = [{"pts": u.pts, "random_access": u.random_access, "packet": u.packet, "bytes": len(u.data)} for u in s.units]
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(s), units))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.record_batch([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], *read])

    return kept.mapInArrow(run, kinds).toDF(*keep, *[_free(keep, x) for x in read])


def _free(have: tuple[str, ...], name: str) -> str:
    while name.lower() in {h.lower() for h in have}:
        name = "_" + name
    return name


def sizes(text: str = "text"):
    """Bytes of the text in UTF-8, null as empty."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
