"""MPEG transport streams as a column: payloads in PES packets with timestamps, and a parser that checks them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeweave.llm.arrowtext import grown, slices

# Fixed values of the container (ISO/IEC 13818-1): sizes, table and stream ids.
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x1000, 0x0100
PRIVATE_DATA, PRIVATE_STREAM_1 = 0x06, 0xBD
#: What fits the 1,021 bytes that a map section may have behind its length.
MOST_STREAMS = (1021 - 13) // 5
PROGRAM = 1

#: Payload bytes of an access unit; its PES length field has 16 bits.
UNIT = 61440
#: 90 kHz clock ticks from one access unit to the next, and the first one's time.
TICKS, FIRST_PTS = 3600, 90000


def crc32_mpeg(data: bytes) -> int:
    """CRC-32 as program tables carry it: no reflection, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255]) + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packets(pid: int, section: bytes) -> bytes:
    """A section behind its pointer byte, over as many packets as it takes."""
    body, out = b"\x00" + section, []
    for k, at in enumerate(range(0, len(body), PACKET - 4)):
        part = body[at : at + PACKET - 4]
        out.append(bytes([SYNC, (0x40 if k == 0 else 0) | pid >> 8, pid & 255, 0x10 | k & 15]) + part + b"\xff" * (PACKET - 4 - len(part)))
    return b"".join(out)


def _pid(value: int) -> bytes:
    return bytes([0xE0 | value >> 8, value & 255])


@lru_cache(maxsize=64)
def program_tables(streams: int) -> bytes:
    """Association table and map table of one program with that many streams of private data."""
    if not 0 < streams <= MOST_STREAMS:
        raise ValueError(f"a program map holds 1 to {MOST_STREAMS} streams")
    listed = b"".join(bytes([PRIVATE_DATA]) + _pid(DATA_PID + k) + b"\xf0\x00" for k in range(streams))
    pat = _section(0, PROGRAM, PROGRAM.to_bytes(2, "big") + _pid(PMT_PID))
    return _table_packets(PAT_PID, pat) + _table_packets(PMT_PID, _section(2, PROGRAM, _pid(DATA_PID) + b"\xf0\x00" + listed))


def _clock(marker: int, value: int) -> bytes:
    return bytes([
        marker << 4 | (value >> 30 & 7) << 1 | 1, value >> 22 & 255, (value >> 15 & 127) << 1 | 1, value >> 7 & 255, (value & 127) << 1 | 1
    ])


def _pcr(value: int) -> bytes:
    return bytes([value >> 25 & 255, value >> 17 & 255, value >> 9 & 255, value >> 1 & 255, (value & 1) << 7 | 0x7E, 0])


def _unit_packets(unit: bytes, pts: int, pid: int, counter: int) -> tuple[bytes, int]:
    """The packets of one access unit as a PES packet, and the continuity counter after them.

    The first packet has a random access mark and a clock reference; adaptation fields stuff the packets that
    the unit's ends leave short.
    """
    pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _clock(2, pts) + unit
    # First packet: 8 bytes of adaptation field; the last one is stuffed to its length.
    first = min(len(pes), PACKET - 4 - 8)
    rest = len(pes) - first
    full, tail = divmod(rest, PACKET - 4)
    n = 1 + full + (tail > 0)
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, pid >> 8, pid & 255
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    out[0, 3] |= 0x20
    out[0, 4], out[0, 5] = PACKET - 5 - first, 0x50
    out[0, 6:12] = np.frombuffer(_pcr(pts - TICKS), np.uint8)
    raw = np.frombuffer(pes, np.uint8)
    out[0, PACKET - first :] = raw[:first]
    if full:
        out[1 : 1 + full, 4:] = raw[first : first + full * (PACKET - 4)].reshape(full, -1)
    if tail:
        out[-1, 3] |= 0x20
        out[-1, 4] = PACKET - 5 - tail
        if PACKET - 5 - tail > 0:
            out[-1, 5] = 0
        out[-1, PACKET - tail :] = raw[len(raw) - tail :]
    return out.tobytes(), (counter + n) & 15


def mux_streams(payloads: list[bytes]) -> bytes:
    """A transport stream of program tables and one elementary stream per payload, their access units by turns."""
    parts, counters = [program_tables(len(payloads))], [0] * len(payloads)
    for at in range(0, max(map(len, payloads)), UNIT):
        for k, payload in enumerate(payloads):
            if at < len(payload):
                found, counters[k] = _unit_packets(payload[at : at + UNIT], FIRST_PTS + at // UNIT * TICKS, DATA_PID + k, counters[k])
                parts.append(found)
    return b"".join(parts)


def mux(payload: bytes) -> bytes:
    """A transport stream of one elementary stream."""
    return mux_streams([payload])


@dataclass
class Stream:
    """An elementary stream: its payload, a timestamp per access unit (None where a PES packet has none), the
    packets of the transport stream where decoding may start, and faults of its counters."""

    payload: bytes
    packets: int
    timestamps: list[int | None]
    access_points: list[int]
    gaps: int
    program: int = 0
    pid: int = 0
    kind: int = 0
    access_times: list[int | None] = field(default_factory=list)


def _body_starts(packets: np.ndarray) -> np.ndarray:
    """Where each packet's own bytes begin, behind header and adaptation field; its end if it has none."""
    begin = np.where(packets[:, 3] & 0x20, 5 + packets[:, 4].astype(int), 4)
    if (begin > PACKET).any():
        raise ValueError("an adaptation field is longer than its packet")
    return np.where(packets[:, 3] & 0x10, begin, PACKET)


def _section_at(packets: np.ndarray, pids: np.ndarray, pid: int) -> bytes:
    """The first whole section on a PID, over as many packets as it takes."""
    own = packets[pids == pid]
    starts = np.flatnonzero(own[:, 1] & 0x40)
    raw, need = b"", 0
    for k, begin in zip(range(starts[0], len(own)) if starts.size else (), _body_starts(own[starts[0] :]) if starts.size else ()):
        part = own[k, begin:].tobytes()
        raw += part[1 + part[0] :] if k == starts[0] else part
        if len(raw) >= 3:
            need = 3 + ((raw[1] & 15) << 8 | raw[2])
            if len(raw) >= need:
                return raw[:need]
    raise ValueError(f"no table on PID {pid}")


def _checked(section: bytes) -> bytes:
    if crc32_mpeg(section):
        raise ValueError("broken program table")
    return section[8:-4]


@lru_cache(maxsize=256)
def _programs(section: bytes) -> list[tuple[int, int]]:
    """Programs of an association table with the PIDs of their maps; program 0 names the network instead."""
    body = _checked(section)
    found = [(int.from_bytes(body[i : i + 2], "big"), (body[i + 2] & 31) << 8 | body[i + 3]) for i in range(0, len(body), 4)]
    return [(program, pid) for program, pid in found if program]


@lru_cache(maxsize=256)
def _streams_of(section: bytes) -> list[tuple[int, int]]:
    """PIDs and kinds of the elementary streams of a map table."""
    body = _checked(section)
    at, found = 4 + ((body[2] & 15) << 8 | body[3]), []
    while at < len(body):
        found.append(((body[at + 1] & 31) << 8 | body[at + 2], body[at]))
        at += 5 + ((body[at + 3] & 15) << 8 | body[at + 4])
    return found


def _time(t: bytes) -> int:
    return (t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1


def _elementary(packets: np.ndarray, at: np.ndarray, program: int, pid: int, kind: int) -> Stream:
    """Reassemble the PES packets of one PID, whose packets are ``at``.

    A packet sent twice counts once. A counter that does not go on by one is a gap, unless the packet announces
    the break; packets without bytes of their own do not count on.
    """
    own = packets[at]
    held = (own[:, 3] & 0x10) > 0
    again = np.zeros(len(own), bool)
    again[1:] = held[1:] & (own[1:, 3] == own[:-1, 3]) & (own[1:] == own[:-1]).all(axis=1)
    own, at, held = own[~again], at[~again], held[~again]
    begin = _body_starts(own)
    adapted = ((own[:, 3] & 0x20) > 0) & (own[:, 4] > 0)
    counted = np.flatnonzero(held)
    steps = np.diff(own[counted, 3].astype(int) & 15) & 15
    announced = adapted[counted[1:]] & ((own[counted[1:], 5] & 0x80) > 0)
    gaps = int(((steps != 1) & ~announced).sum())
    keep = np.arange(PACKET) >= begin[:, None]
    flat = own[keep].tobytes()
    offsets = np.concatenate([[0], np.cumsum(PACKET - begin)])
    starts = np.flatnonzero(((own[:, 1] & 0x40) > 0) & held)
    stops = np.append(offsets[starts[1:]], len(flat)) if starts.size else []
    payload, times = [], []
    for a, b in zip(offsets[starts].tolist(), list(stops)):
        pes = flat[a:b]
        size = int.from_bytes(pes[4:6], "big")
        if pes[:3] != b"\x00\x00\x01" or len(pes) < 9 or (size and size != len(pes) - 6):
            raise ValueError("broken PES packet")
        times.append(_time(pes[9:14]) if pes[7] & 0x80 else None)
        payload.append(pes[9 + pes[8] :])
    marked = np.flatnonzero(adapted & ((own[:, 5] & 0x40) > 0))
    # A mark belongs to the access unit that its packet is part of, or that starts in it.
    unit = np.searchsorted(starts, marked, "right") - 1
    return Stream(
        b"".join(payload), len(packets), times, at[marked].tolist(), gaps, program, pid, kind,
        [times[u] if u >= 0 else None for u in unit.tolist()],
    )


def elementary_streams(media: bytes) -> list[Stream]:
    """All elementary streams of all programs, in the order of the tables.

    Raises on lost synchronisation, broken tables and broken PES packets. Packets of PIDs that no table names
    are passed over; a stream without packets is empty.
    """
    if len(media) % PACKET:
        raise ValueError("the stream is cut inside a packet")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if not len(packets) or (packets[:, 0] != SYNC).any():
        raise ValueError("lost synchronisation")
    pids = (packets[:, 1].astype(np.int32) & 31) << 8 | packets[:, 2]
    return [
        _elementary(packets, np.flatnonzero(pids == pid), program, pid, kind)
        for program, map_pid in _programs(_section_at(packets, pids, PAT_PID))
        for pid, kind in _streams_of(_section_at(packets, pids, map_pid))
    ]


def demux(media: bytes) -> Stream:
    """The elementary stream of a transport stream that has one; raises if it has several or none."""
    found = elementary_streams(media)
    if len(found) != 1:
        raise ValueError(f"{len(found)} elementary streams where one was expected")
    return found[0]


def padded(text: bytes, to: int = 64) -> bytes:
    """The text with bytes 0 up to a positive multiple of ``to``."""
    return text + b"\x00" * (max(1, -(-len(text) // to)) * to - len(text))


def encode_streams(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Adds the transport stream of every text (null: empty) and its size in bytes before padding.

    The stream stores the UTF-8 text, padded with bytes 0 to a positive multiple of 64, without loss. Columns
    named like the added ones are replaced; the text column goes.
    """
    kept = docs.drop(out, "n_bytes")
    names = kept.columns
    others = [c for c in names if c != text]
    schema = grown(kept.select(*others).schema, n_bytes="bigint", **{out: "binary"})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index(text)).cast(pa.binary())
            for a, b in slices(batch.column(names.index(text)), limit=1 << 23):
                raw = [x or b"" for x in texts.slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(names.index(c)).slice(a, b - a) for c in others],
                        pa.array([len(x) for x in raw], pa.int64()), pa.array([mux(padded(x)) for x in raw], pa.binary()),
                    ],
                    [*others, "n_bytes", out],
                )

    return kept.mapInArrow(encode, schema)


#: An elementary stream in a column. Access points: packet of the transport stream, and the time of its unit.
STREAM_TYPE = (
    "struct<program: int, pid: int, kind: int, payload: binary, timestamps: array<bigint>, "
    "access_points: array<struct<packet: bigint, pts: bigint>>, gaps: bigint>"
)


def parse_streams(stored: DataFrame, media: str = "media", out: str = "streams") -> DataFrame:
    """Parses the transport streams: adds ``packets`` and an array of all elementary streams, each with payload,
    timestamps, random access points and counter gaps; the stream column goes.

    A null stream gives null columns; a broken one raises. Columns named like the added ones are replaced. A
    task holds the streams of some 8 MB, or of one longer row.
    """
    kept = stored.drop(*[c for c in ("packets", out) if c != media])
    names = kept.columns
    others = [c for c in names if c != media]
    schema = grown(kept.select(*others).schema, packets="bigint", **{out: f"array<{STREAM_TYPE}>"})
    point = pa.struct([("packet", pa.int64()), ("pts", pa.int64())])
    stream = pa.struct([
        ("program", pa.int32()), ("pid", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary()), ("timestamps", pa.list_(pa.int64())),
        ("access_points", pa.list_(point)), ("gaps", pa.int64()),
    ])

    def row(s: Stream) -> dict:
        points = [{"packet": p, "pts": t} for p, t in zip(s.access_points, s.access_times)]
        return {
            "program": s.program, "pid": s.pid, "kind": s.kind, "payload": s.payload, "timestamps": s.timestamps, "access_points": points,
            "gaps": s.gaps,
        }

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index(media))
            for a, b in slices(column, limit=1 << 23):
                raw = column.slice(a, b - a).to_pylist()
                found = [None if x is None else [row(s) for s in elementary_streams(x)] for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(names.index(c)).slice(a, b - a) for c in others],
                        pa.array([None if x is None else len(x) // PACKET for x in raw], pa.int64()), pa.array(found, pa.list_(stream)),
                    ],
                    [*others, "packets", out],
                )

    return kept.mapInArrow(parse, schema)


def access_before(stream: Column, pts: Column) -> Column:
    """Byte of the transport stream where decoding has to start to reach the time ``pts``; null if none is early enough."""
    early = F.filter(stream["access_points"], lambda p: p["pts"] <= pts)
    return F.try_element_at(F.transform(F.array_sort(early), lambda p: p["packet"] * PACKET), F.lit(-1))


FEATURES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def stream_features(stored: DataFrame, media: str = "media") -> DataFrame:
    """Sizes, digests and the feature of each transport stream, of the first elementary stream; the column goes.

    The feature counts packets, access units, random access points and counter gaps, and gives the first and
    last timestamp. A null stream has null features; a broken one raises. Columns named like the added ones are
    replaced.
    """
    kept = stored.drop(*[c for c in FEATURES if c != media])
    others = [c for c in kept.columns if c != media]
    sized = kept.select(
        F.struct(*others, F.lit(None).cast("int").alias("_")).alias("_row"), F.length(media).cast("bigint").alias("media_bytes"),
        F.sha2(media, 256).alias("media_sha256"), F.col(media).alias("_media"),
    )
    parsed = parse_streams(sized, "_media", "_streams").withColumn("_s", F.get("_streams", F.lit(0)))
    payload, times = F.col("_s.payload"), F.col("_s.timestamps")
    text = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    feature = F.when(F.col("packets").isNotNull(), F.concat(
        F.lit("ts packets="), text(F.col("packets")), F.lit(" units="), text(F.array_size(times)), F.lit(" pts="), text(F.get(times, F.lit(0))),
        F.lit("-"), text(F.try_element_at(times, F.lit(-1))), F.lit(" access="), text(F.array_size("_s.access_points")), F.lit(" gaps="), text(F.col("_s.gaps")),
    ))
    return parsed.select(
        *[F.col("_row")[c].alias(c) for c in others], F.length(payload).cast("bigint").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"), "media_bytes", "media_sha256",
        feature.alias("feature"),
    )
