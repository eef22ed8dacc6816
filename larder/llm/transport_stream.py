"""Media columns as MPEG transport streams.

``write_streams`` wraps bytes losslessly in a transport stream of one programme: a program
association table, a program map table, and elementary packets with timestamps, clock references
and random-access points. ``read_streams`` takes any such stream apart: it parses the tables with
their checksums, checks continuity counters, drops repeated packets, reassembles the elementary
packets and reports each access unit with its timestamp, random-access mark and place.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from larder.llm.common import slices

# Fixed values of the transport stream format.
PACKET = 188
SYNC = 0x47
PAT_PID = 0x0000
PRIVATE_DATA = 0x06
PRIVATE_STREAM = 0xBD
CLOCK = 90_000
TIMESTAMP_MODULUS = 1 << 33

# Layout of the streams written here.
PMT_PID = 0x0100
DATA_PID = 0x0101
PROGRAM = 1
UNIT_BYTES = 4096
UNITS_PER_ACCESS_POINT = 8
TICKS_PER_UNIT = CLOCK // 25
ALIGN = 64


def _checksum_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = ((value << 1) ^ 0x04C11DB7 if value & 0x80000000 else value << 1) & 0xFFFFFFFF
        table.append(value)
    return table


_CHECKSUMS = _checksum_table()


def section_checksum(data: bytes) -> int:
    """The 32-bit checksum of table sections; 0 over a section with its checksum."""
    value = 0xFFFFFFFF
    for byte in data:
        value = ((value << 8) & 0xFFFFFFFF) ^ _CHECKSUMS[(value >> 24) ^ byte]
    return value


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", section_checksum(head + body))


def _table_packet(pid: int, section: bytes) -> bytes:
    head = struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0"
    return head + section + b"\xff" * (PACKET - len(head) - len(section))


_TABLES = _table_packet(PAT_PID, _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))) + _table_packet(
    PMT_PID,
    _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, PRIVATE_DATA, 0xE000 | DATA_PID, 0xF000)),
)


def _timestamp(ticks: int) -> bytes:
    return struct.pack(
        ">BHH", 0x21 | (ticks >> 29) & 0x0E, (ticks >> 14) & 0xFFFE | 1, (ticks << 1) & 0xFFFE | 1
    )


def _clock(ticks: int) -> bytes:
    return struct.pack(">IH", ticks >> 1, (ticks & 1) << 15 | 0x7E00)


def mux(payload: bytes) -> bytes:
    """A transport stream that carries ``payload`` in units of ``UNIT_BYTES``."""
    out, counter = [_TABLES], 0
    for number, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        ticks = (number * TICKS_PER_UNIT) % TIMESTAMP_MODULUS
        unit = payload[at : at + UNIT_BYTES]
        packet = (
            struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM, len(unit) + 8, 0x84, 0x80, 5) + _timestamp(ticks) + unit
        )
        field_ = b"\x50" + _clock(ticks) if number % UNITS_PER_ACCESS_POINT == 0 else b""
        first, place = 0x4000, 0
        while place < len(packet):
            room = PACKET - 4 - (len(field_) + 1 if field_ else 0)
            rest = len(packet) - place
            if rest < room:  # stuffing in the adaptation field fills the last packet
                spare = room - rest
                if field_:
                    field_ += b"\xff" * spare
                else:
                    field_ = b"\0" + b"\xff" * (spare - 2) if spare > 1 else None
                room = rest
            adaptation = b"\0" if field_ is None else bytes([len(field_)]) + field_ if field_ else b""
            out.append(struct.pack(">BHB", SYNC, first | DATA_PID, (0x30 if adaptation else 0x10) | counter))
            out.append(adaptation)
            out.append(packet[place : place + room])
            place += room
            counter = (counter + 1) & 15
            first, field_ = 0, b""
    return b"".join(out)


@dataclass
class Unit:
    pid: int
    ticks: int | None
    random_access: bool
    data: bytes


@dataclass
class Stream:
    """What a transport stream holds."""

    programs: dict[int, int] = field(default_factory=dict)  # program number to the PID of its map
    streams: dict[int, int] = field(default_factory=dict)  # PID to stream type
    packets: int = 0
    lost_sync: int = 0
    continuity_errors: int = 0
    repeated: int = 0
    bad_sections: int = 0
    units: list[Unit] = field(default_factory=list)

    def payload(self) -> bytes:
        return b"".join(unit.data for unit in self.units)


class _Demuxer:
    def __init__(self):
        self.found = Stream()
        self._last: dict[int, tuple[int, bytes]] = {}
        self._sections: dict[int, bytearray] = {}
        self._open: dict[int, tuple[bytearray, bool]] = {}
        self._order: list[int] = []

    def run(self, data: bytes) -> Stream:
        at = 0
        while at + PACKET <= len(data):
            if data[at] != SYNC:
                self.found.lost_sync += 1
                at = data.find(SYNC, at + 1)
                if at < 0:
                    break
                continue
            self._packet(data[at : at + PACKET])
            at += PACKET
        for pid in list(self._open):
            self._close(pid)
        return self.found

    def _packet(self, packet: bytes) -> None:
        self.found.packets += 1
        pid = (packet[1] & 0x1F) << 8 | packet[2]
        starts, flags, counter = packet[1] & 0x40, packet[3] & 0x30, packet[3] & 15
        if pid == 0x1FFF or packet[1] & 0x80:
            return
        begin, access, broken = 4, False, False
        if flags & 0x20:
            if packet[4]:
                access, broken = bool(packet[5] & 0x40), bool(packet[5] & 0x80)
            begin = 5 + packet[4]
        if not flags & 0x10:
            return
        last = self._last.get(pid)
        if last is not None and not broken:
            if counter == last[0] and packet == last[1]:
                self.found.repeated += 1
                return
            if counter != (last[0] + 1) & 15:
                self.found.continuity_errors += 1
        self._last[pid] = (counter, packet)
        if pid in self.found.streams:
            if starts:
                self._close(pid)
                self._open[pid] = (bytearray(), access)
            if pid in self._open:
                self._open[pid][0].extend(packet[begin:])
        elif pid == PAT_PID or pid in self.found.programs.values():
            self._table(pid, packet[begin:], bool(starts))

    def _table(self, pid: int, part: bytes, starts: bool) -> None:
        if starts:
            self._sections.setdefault(pid, bytearray()).extend(part[1 : 1 + part[0]])
            self._take_sections(pid)
            self._sections[pid] = bytearray(part[1 + part[0] :])
        elif pid in self._sections:
            self._sections[pid].extend(part)
        self._take_sections(pid)

    def _take_sections(self, pid: int) -> None:
        held = self._sections.get(pid, bytearray())
        while len(held) >= 3 and held[0] != 0xFF:
            size = 3 + ((held[1] & 0x0F) << 8 | held[2])
            if len(held) < size:
                return
            section = bytes(held[:size])
            del held[:size]
            if size < 12 or section_checksum(section):
                self.found.bad_sections += 1
            elif section[0] == 0 and pid == PAT_PID:
                for i in range(8, size - 4, 4):
                    number, place = struct.unpack_from(">HH", section, i)
                    if number:
                        self.found.programs[number] = place & 0x1FFF
            elif section[0] == 2:
                i = 12 + (struct.unpack_from(">H", section, 10)[0] & 0x0FFF)
                while i + 5 <= size - 4:
                    kind, stream, more = struct.unpack_from(">BHH", section, i)
                    self.found.streams[stream & 0x1FFF] = kind
                    i += 5 + (more & 0x0FFF)

    def _close(self, pid: int) -> None:
        held, access = self._open.pop(pid, (b"", False))
        if len(held) < 9 or held[:3] != b"\0\0\1":
            return
        ticks = None
        if held[7] & 0x80 and len(held) >= 14:
            ticks = (held[9] & 0x0E) << 29 | held[10] << 22 | (held[11] & 0xFE) << 14 | held[12] << 7 | held[13] >> 1
        size = held[4] << 8 | held[5]
        end = 6 + size if size else len(held)
        self.found.units.append(Unit(pid, ticks, access, bytes(held[9 + held[8] : end])))


def demux(data: bytes) -> Stream:
    """Parse a transport stream. Broken packets are counted, never raised."""
    return _Demuxer().run(data)


def padded(payload: bytes) -> bytes:
    """``payload`` with zero bytes up to a positive multiple of ``ALIGN``."""
    return payload + b"\0" * (-len(payload) % ALIGN if payload else ALIGN)


def write_streams(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: each row's text as UTF-8, padded with zeros to a positive
    multiple of 64 bytes, in a transport stream. A NULL text is empty; equal texts give equal media.

    NULL ids stay NULL, repeated rows repeat, other columns are not read and no rows give none.
    """

    def write(batches):
        for batch in slices(batches, "text", 1 << 20):
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            media = [mux(padded(x)) for x in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())],
                names=["doc_id", "n_bytes", "media"],
            )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(write, "doc_id bigint, n_bytes bigint, media binary")


_UNIT = "struct<pid:int,ticks:bigint,random_access:boolean,start:bigint,n_bytes:bigint>"
_STREAM = (
    "struct<programs:int,program_map_pid:int,stream_pid:int,stream_type:int,packets:bigint,lost_sync:bigint,"
    f"continuity_errors:bigint,repeated:bigint,bad_sections:bigint,payload:binary,units:array<{_UNIT}>>"
)


def read_streams(rows: DataFrame, media: str = "media", result: str = "stream") -> DataFrame:
    """``rows`` with a struct of what each transport stream holds, in place of a column ``result``.

    The struct has the tables, the counts of faults, the payload put together again, and an entry
    for each elementary packet: PID, timestamp, random-access mark, place and size in the payload.
    NULL media give a NULL struct. All other columns stay as they are; no rows give none.
    """

    kept = rows.drop(result)
    kind = to_arrow_type(T.DataType.fromDDL(_STREAM))

    def read(batches):
        for batch in slices(batches, media, 1 << 20):
            found = pa.array([_described(data) for data in batch.column(media).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, result])

    return kept.mapInArrow(read, T.StructType([*kept.schema.fields, T.StructField(result, T.DataType.fromDDL(_STREAM))]))


def _described(data: bytes | None) -> dict | None:
    if data is None:
        return None
    found, units, start = demux(data), [], 0
    for u in found.units:
        units.append(
            {"pid": u.pid, "ticks": u.ticks, "random_access": u.random_access, "start": start, "n_bytes": len(u.data)}
        )
        start += len(u.data)
    return {
        "programs": len(found.programs),
        "program_map_pid": min(found.programs.values(), default=None),
        "stream_pid": min(found.streams, default=None),
        "stream_type": found.streams[min(found.streams)] if found.streams else None,
        "packets": found.packets,
        "lost_sync": found.lost_sync,
        "continuity_errors": found.continuity_errors,
        "repeated": found.repeated,
        "bad_sections": found.bad_sections,
        "payload": found.payload(),
        "units": units,
    }


def feature_text(stream: Column) -> Column:
    """One line on a parsed stream: tables, packets, faults, timestamps and random-access points."""
    units = stream["units"]
    entry = F.filter(units, lambda u: u["random_access"])
    return F.concat_ws(
        ";",
        F.concat(F.lit("programs="), stream["programs"]),
        F.concat(F.lit("stream_type="), F.coalesce(stream["stream_type"], F.lit(-1))),
        F.concat(F.lit("packets="), stream["packets"]),
        F.concat(F.lit("continuity_errors="), stream["continuity_errors"]),
        F.concat(F.lit("units="), F.size(units)),
        F.concat(F.lit("first_ticks="), F.coalesce(F.get(units, F.lit(0))["ticks"], F.lit(-1))),
        F.concat(F.lit("last_ticks="), F.coalesce(F.get(units, F.size(units) - 1)["ticks"], F.lit(-1))),
        F.concat(F.lit("random_access="), F.array_join(F.transform(entry, lambda u: u["start"].cast("string")), ",")),
    )
