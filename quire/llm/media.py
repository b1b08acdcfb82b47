"""MPEG transport streams: write payloads as packetised streams, read program tables, packets and timestamps back.

The reader checks sync bytes, table checksums, continuity counters and packet lengths, reassembles sections (several in
a packet, or one over several packets) and elementary packets, and lists each access unit's timestamps, whether it can
be entered at random, and the byte from which a reader that starts there finds the tables and the unit. The writer
repeats the tables before every random-access packet, so a stream can be cut at each. Runs of plain packets of one
stream are gathered as arrays; only packets with an adaptation field, a start or another stream are parsed one by one.

Defined cases: a null text is an empty one, whose payload is 64 zero bytes; equal texts give equal streams; lost,
repeated or damaged packets are counted and their elementary packet is marked as broken, not dropped; sections that are
damaged or never completed are counted, as are elementary packets of streams that no table names, which are kept;
bytes before the first sync byte and a cut last packet are skipped and counted.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_arrow, raw, table

PACKET, BODY, SYNC = 188, 184, 0x47
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x1000, 0x0100
PRIVATE_TYPE, PRIVATE_STREAM, UNIT, CLOCK = 0x06, 0xBD, 32_768, 3_600  # bytes and 90 kHz ticks of one elementary packet


@cache
def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else (c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


def crc_mpeg(data: bytes) -> int:
    c, t = 0xFFFFFFFF, _crc_table()
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ t[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc_mpeg(head + body))


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10 | counter) + b"\0" + section).ljust(PACKET, b"\xff")


@cache
def _tables(counter: int) -> bytes:
    pat = _section(0x00, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
    pmt = _section(0x02, 1, struct.pack(">HH", 0xE000 | DATA_PID, 0xF000) + struct.pack(">BHH", PRIVATE_TYPE, 0xE000 | DATA_PID, 0xF000))
    return _table_packet(PAT_PID, pat, counter) + _table_packet(PMT_PID, pmt, counter)


def _stamp(ticks: int) -> bytes:
    t = ticks & 0x1FFFFFFFF
    return bytes([0x21 | (t >> 29) & 0x0E, (t >> 22) & 0xFF, 0x01 | (t >> 14) & 0xFE, (t >> 7) & 0xFF, 0x01 | (t << 1) & 0xFE])


def write_stream(payload: bytes) -> bytes:
    """A single-program transport stream: elementary packets of UNIT bytes, each with timestamp, clock and random-access mark, and the tables before it."""
    out, counter = [], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        body = payload[at : at + UNIT]
        pes = struct.pack(">IHBBB", 0x00000100 | PRIVATE_STREAM, len(body) + 8, 0x84, 0x80, 5) + _stamp(k * CLOCK) + body
        base = (k * CLOCK) & 0x1FFFFFFFF
        first = BODY - 8
        fill = max(0, first - len(pes))
        field_ = bytes([7 + fill, 0x50]) + struct.pack(">IH", base >> 1, (base & 1) << 15 | 0x7E00) + b"\xff" * fill
        out += [_tables(k & 15), struct.pack(">BHB", SYNC, 0x4000 | DATA_PID, 0x30 | counter), field_, pes[:first]]
        counter = (counter + 1) & 15
        rest = memoryview(pes)[first:]
        full = len(rest) // BODY
        if full:
            packets = np.empty((full, PACKET), np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
            packets[:, 3] = 0x10 | ((counter + np.arange(full)) & 15)
            packets[:, 4:] = np.frombuffer(rest[: full * BODY], np.uint8).reshape(full, BODY)
            out.append(packets.tobytes())
            counter = (counter + full) & 15
        if len(rest) > full * BODY:
            tail = bytes(rest[full * BODY :])
            gap = BODY - len(tail)
            stuffing = b"\0" if gap == 1 else bytes([gap - 1, 0]) + b"\xff" * (gap - 2)
            out += [struct.pack(">BHB", SYNC, DATA_PID, 0x30 | counter), stuffing, tail]
            counter = (counter + 1) & 15
    return b"".join(out)


@dataclass
class Unit:
    """One elementary packet."""

    pid: int
    stream_id: int
    pts: int | None
    dts: int | None
    random_access: bool
    data: bytes
    broken: bool
    offset: int = 0  # byte at which a reader may begin to get this unit: that of the tables right before it, else its own


@dataclass
class Stream:
    """What a transport stream holds."""

    programs: dict[int, int] = field(default_factory=dict)  # program number -> PID of its map
    streams: dict[int, int] = field(default_factory=dict)  # PID -> stream type
    clock_pid: int | None = None
    units: list[Unit] = field(default_factory=list)
    clocks: list[int] = field(default_factory=list)  # 27 MHz
    packets: int = 0
    gaps: int = 0  # continuity counters that do not follow
    repeats: int = 0
    bad_tables: int = 0  # sections with a wrong checksum, or cut off
    unnamed: int = 0  # elementary packets of streams that no table names
    flagged: int = 0  # transport errors
    skipped: int = 0  # bytes outside packets


def _ticks(b: bytes) -> int:
    return ((b[0] >> 1) & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def _unit(pid: int, parts: list[bytes], random_access: bool, broken: bool, offset: int) -> Unit:
    data = b"".join(parts)
    if len(data) < 9 or data[:3] != b"\0\0\1":
        return Unit(pid, 0, None, None, random_access, data, True, offset)
    length, flags, head = struct.unpack(">H", data[4:6])[0], data[7] >> 6, data[8]
    pts = _ticks(data[9:14]) if flags & 2 and head >= 5 and len(data) >= 14 else None
    dts = _ticks(data[14:19]) if flags == 3 and head >= 10 and len(data) >= 19 else pts
    end = 6 + length if length else len(data)
    return Unit(pid, data[3], pts, dts, random_access, data[9 + head : end], broken or len(data) < end, offset)


class Sections:
    """Sections of one PID, put together from packet payloads."""

    def __init__(self) -> None:
        self.data: bytes | None = None  # begun section, None while none is

    def broken(self) -> bool:
        """Forget a begun section; whether there was one."""
        lost, self.data = bool(self.data), None
        return lost

    def feed(self, payload: bytes, begins: bool) -> tuple[list[bytes], int]:
        """Sections that the payload completes, and how many it shows to be cut off."""
        found: list[bytes] = []
        lost = 0
        if begins:
            # The bytes that the pointer skips end the section before; new ones follow.
            pointer = payload[0] if payload else 0
            if self.data is not None:
                self.data += payload[1 : 1 + pointer]
                self._take(found)
                lost = self.broken()
            self.data = payload[1 + pointer :]
        elif self.data is not None:
            self.data += payload
        self._take(found)
        return found, int(lost)

    def _take(self, found: list[bytes]) -> None:
        while self.data and self.data[0] != 0xFF and len(self.data) >= 3:
            size = 3 + (struct.unpack(">H", self.data[1:3])[0] & 0xFFF)
            if len(self.data) < size:
                return
            found.append(self.data[:size])
            self.data = self.data[size:]
        if self.data is not None and (not self.data or self.data[0] == 0xFF):
            self.data = None


def read_stream(stream: bytes) -> Stream:
    """Demultiplex a whole stream."""
    out = Stream()
    start = 0
    while start < len(stream) and not (stream[start] == SYNC and (start + PACKET >= len(stream) or stream[start + PACKET] == SYNC)):
        start += 1
    n = (len(stream) - start) // PACKET
    out.skipped, out.packets = len(stream) - n * PACKET, n
    packets = np.frombuffer(stream, np.uint8, n * PACKET, start).reshape(n, PACKET)
    pids = (packets[:, 1] & 0x1F).astype(np.int32) << 8 | packets[:, 2]
    counters = packets[:, 3] & 15
    # A plain packet goes on where the one before it stopped: same stream, next counter, payload only.
    plain = np.zeros(n, bool)
    if n > 1:
        plain[1:] = (packets[1:, 0] == SYNC) & (pids[1:] == pids[:-1]) & (counters[1:] == (counters[:-1] + 1) % 16) & (packets[1:, 1] & 0xC0 == 0) & (packets[1:, 3] & 0xF0 == 0x10)
    border = np.concatenate((np.flatnonzero(~plain), [n]))
    seen: dict[int, int] = {}
    open_: dict[int, list] = {}  # PID -> parts, random access, broken, offset
    sections: dict[int, Sections] = {}
    tables_at: int | None = None  # where the tables since the last elementary packet begin

    def close(pid: int) -> None:
        if pid in open_:
            out.units.append(_unit(pid, *open_.pop(pid)))

    for a, b in zip(border.tolist(), border[1:].tolist()):
        at = start + a * PACKET
        head, pid = stream[at : at + 4], int(pids[a])
        if head[0] != SYNC or head[1] & 0x80:
            out.flagged += 1
            if pid in open_:
                open_[pid][2] = True
            continue
        control, counter = head[3] >> 4 & 3, head[3] & 15
        body, mark, jump = 4, False, False
        if control & 2:
            size = stream[at + 4]
            body = 5 + size
            if size:
                flags = stream[at + 5]
                jump, mark = bool(flags & 0x80), bool(flags & 0x40)
                if flags & 0x10 and size >= 7:
                    high, low = struct.unpack(">IH", stream[at + 6 : at + 12])
                    out.clocks.append((high << 1 | low >> 15) * 300 + (low & 0x1FF))
        if control & 1 and pid != 0x1FFF:
            last = seen.get(pid)
            if last is not None and not jump and counter != (last + 1) % 16:
                if counter == last and a and pids[a - 1] == pid and np.array_equal(packets[a], packets[a - 1]):
                    out.repeats += 1
                    if b - a > 1:
                        open_.get(pid, [[]])[0].append(packets[a + 1 : b, 4:].tobytes())
                        seen[pid] = int(counters[b - 1])
                    continue
                out.gaps += 1
                if pid in open_:
                    open_[pid][2] = True
                if pid in sections:
                    out.bad_tables += sections[pid].broken()
            seen[pid] = int(counters[b - 1])
        if not control & 1 or body >= PACKET:
            continue
        first = stream[at + body : at + PACKET]
        rest = packets[a + 1 : b, 4:].tobytes() if b - a > 1 else b""
        begins = bool(head[1] & 0x40)
        if pid == PAT_PID or pid in out.programs.values():
            if pid == PAT_PID and begins and tables_at is None:
                tables_at = at
            own = sections.setdefault(pid, Sections())
            found, lost = own.feed(first, begins)
            if rest:
                found += own.feed(rest, False)[0]
            out.bad_tables += lost
            for section in found:
                _read_section(out, pid, section)
        elif begins and (pid in out.streams or first[:3] == b"\0\0\1"):
            close(pid)
            open_[pid] = [[first, rest], mark, False, at if tables_at is None else tables_at]
            tables_at = None
        elif pid in open_:
            open_[pid][0] += [first, rest]
            tables_at = None
    for pid in sorted(open_):
        close(pid)
    out.bad_tables += sum(own.broken() for own in sections.values())
    out.unnamed = sum(u.pid not in out.streams for u in out.units)
    return out


def _read_section(out: Stream, pid: int, own: bytes) -> None:
    if crc_mpeg(own) != 0:
        out.bad_tables += 1
        return
    if own[0] == 0x00 and pid == PAT_PID:
        for at in range(8, len(own) - 4, 4):
            number, target = struct.unpack(">HH", own[at : at + 4])
            if number:
                out.programs[number] = target & 0x1FFF
    elif own[0] == 0x02:
        clock, size = struct.unpack(">HH", own[8:12])
        out.clock_pid = clock & 0x1FFF
        at = 12 + (size & 0xFFF)
        while at + 5 <= len(own) - 4:
            kind, target, info = struct.unpack(">BHH", own[at : at + 5])
            out.streams[target & 0x1FFF] = kind
            at += 5 + (info & 0xFFF)


def padded(text: bytes | None) -> bytes:
    """The text's bytes with zeros up to a positive multiple of 64."""
    data = text or b""
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


UNITS = "array<struct<pid: int, pts: long, dts: long, random_access: boolean, bytes: long, broken: boolean, offset: long>>"


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """Each text as a stream: n_bytes, the stream, and what reading it back gives: payload digest, units with timestamps, faults."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {c: [] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "gaps", "bad_tables", "packets", "units", "media")}
        for text in raw(batch.column(1)):
            media = write_stream(padded(text))
            found = read_stream(media)
            payload = b"".join(u.data for u in found.units)
            values = [len(text or b""), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), found.gaps, found.bad_tables + found.flagged + found.unnamed, found.packets]
            values += [[{"pid": u.pid, "pts": u.pts, "dts": u.dts, "random_access": u.random_access, "bytes": len(u.data), "broken": u.broken, "offset": u.offset} for u in found.units], media]
            for name, value in zip(out, values):
                out[name].append(value)
        unit = pa.list_(pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_()), ("bytes", pa.int64()), ("broken", pa.bool_()), ("offset", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), unit, pa.binary()]
        names = list(out)[: 11 if with_media else 10]
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[c], k) for c, k in zip(names, kinds)]], ["id", *names])

    schema = f"id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, gaps long, bad_tables long, packets long, units {UNITS}" + ", media binary" * with_media
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), rows, schema)


def op4_transport_stream(spark, sf_dir: str) -> DataFrame:
    """Each text of ``documents`` as a stream: digests of what is read back, and its units as ``pts@offset``, with a star where the stream can be entered."""
    found = stored(table(spark, sf_dir, "documents"), with_media=False)
    entries = F.size(F.filter("units", lambda u: u["random_access"]))
    feature = F.concat_ws(";", F.concat(F.lit("packets="), "packets"), F.concat(F.lit("units="), F.size("units")), F.concat(F.lit("random_access="), entries), F.concat(F.lit("last_pts="), F.coalesce(F.array_max(F.transform("units", lambda u: u["pts"])), F.lit(-1))), F.concat(F.lit("gaps="), "gaps"), F.concat(F.lit("bad="), F.col("bad_tables") + F.size(F.filter("units", lambda u: u["broken"]))))
    times = F.transform("units", lambda u: F.concat(F.coalesce(u["pts"].cast("string"), F.lit("-")), F.lit("@"), u["offset"], F.when(u["random_access"], "*").otherwise("")))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), F.array_join(times, ",").alias("timestamps"))
