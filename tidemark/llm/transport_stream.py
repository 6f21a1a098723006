"""Media columns: MPEG transport streams (ISO/IEC 13818-1).

A payload is cut into access units; each is a PES packet with a presentation timestamp on one
elementary stream of private data, carried in 188-byte packets after a program association table
and a program map table. Reading back finds the packets (again, after lost or extra bytes), puts the
tables' sections together over as many packets as they take and checks their CRC, checks the continuity
counters, reassembles the PES packets and lists timestamps and random-access points. A packet sent
twice is read once, a signalled discontinuity is none, a PES packet of length 0 lasts until the next.

Defined cases: null payload -> null stream and null fields; an empty payload -> tables only, no
access unit; null and empty texts are one block of blanks; very long texts are many access units;
repeated rows get equal streams; an empty table gives no rows; extra columns stay as they are, whatever
their names, but those named n_bytes and media are replaced. A stream that breaks a rule (sync byte,
CRC, flagged or lost packet, short section or PES) is reported in `errors` and its readable units are
still returned.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PACKET, SYNC, PAT_PID, PMT_PID, ES_PID = 188, 0x47, 0x0000, 0x1000, 0x0101
PROGRAM, STREAM_TYPE, STREAM_ID = 1, 0x06, 0xBD
#: bytes of an access unit: a whole number of 192-byte blocks, below the 16-bit length of a PES packet
UNIT = 192 * 170
#: ticks of the 90 kHz clock between access units, and how often one is a random-access point
TICKS, ACCESS_EVERY = 3600, 8
BLOCK = 192


def _mpeg_crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _mpeg_crc_table()


def mpeg_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    n = 5 + len(body) + 4
    head = struct.pack(">BHHBBB", table_id, 0xB000 | n, ident, 0xC1, 0, 0) + body
    return head + struct.pack(">I", mpeg_crc(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    head = struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0"
    return head + section + b"\xff" * (PACKET - len(head) - len(section))


_PAT = _table_packet(PAT_PID, _section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID)))
_PMT = _table_packet(PMT_PID, _section(0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, STREAM_TYPE, 0xE000 | ES_PID, 0xF000)))


def _timestamp(pts: int) -> bytes:
    pts &= (1 << 33) - 1
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def mux(payload: bytes | None, unit: int = UNIT, ticks: int = TICKS, access_every: int = ACCESS_EVERY) -> bytes | None:
    """The payload as a transport stream."""
    if payload is None:
        return None
    out, counter = [_PAT, _PMT], 0
    for k, at in enumerate(range(0, len(payload), unit)):
        data = payload[at : at + unit]
        pes = np.frombuffer(b"\0\0\1" + struct.pack(">BHBBB", STREAM_ID, len(data) + 8, 0x84, 0x80, 5) + _timestamp(k * ticks) + data, np.uint8)
        # the first packet has an adaptation field with the random-access flag; the last one stuffing
        n = -(-(len(pes) + 2) // 184)
        p = np.full((n, PACKET), 0xFF, np.uint8)
        p[:, 0], p[:, 1], p[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
        p[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        p[0, 1] |= 0x40
        counter = (counter + n) & 15
        spare = n * 184 - len(pes)  # at least 2: the flags of the first packet
        flags = 0x40 if k % access_every == 0 else 0
        first = spare if n == 1 else 2
        p[0, 3] |= 0x20
        p[0, 4], p[0, 5] = first - 1, flags
        p[0, 4 + first :] = pes[: 184 - first]
        body, rest = pes[184 - first :], spare - first
        if n > 1:
            whole = n - 2 if rest else n - 1
            p[1 : 1 + whole, 4:] = body[: whole * 184].reshape(whole, 184)
            if rest:
                p[-1, 3] |= 0x20
                p[-1, 4] = rest - 1
                if rest > 1:
                    p[-1, 5] = 0
                p[-1, 4 + rest :] = body[whole * 184 :]
        out.append(p.tobytes())
    return b"".join(out)


def packets(stream: bytes) -> tuple[np.ndarray, list[str]]:
    """The stream's packets, one a row. Where the rhythm of sync bytes breaks, it is looked for anew."""
    b = np.frombuffer(stream, np.uint8)
    if len(b) % PACKET == 0 and (b[::PACKET] == SYNC).all():
        return b.reshape(-1, PACKET), []
    marks = np.flatnonzero(b == SYNC)
    marked = np.zeros(len(b) + 2 * PACKET, bool)
    marked[marks] = True
    marked[len(b) :] = True  # behind the end nothing contradicts
    good = marks[(marks + PACKET <= len(b)) & marked[np.minimum(marks + PACKET, len(marked) - 1)]]
    starts, at, errors = [], 0, []
    while True:
        k = np.searchsorted(good, at)
        if k == len(good):
            break
        if good[k] != at:
            errors = ["sync"]
        starts.append(int(good[k]))
        at = starts[-1] + PACKET
    if at != len(b):
        errors.append("length")
    return b[np.array(starts, np.int64)[:, None] + np.arange(PACKET)], errors


def _payload_at(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each packet: where its payload begins, and whether it has one."""
    return np.where(q[:, 3] & 0x20, np.minimum(5 + q[:, 4].astype(np.int32), PACKET), 4), q[:, 3] & 0x10 > 0


def sections(q: np.ndarray) -> tuple[list[bytes], list[str]]:
    """Bodies of the sections that one PID's packets carry, between the header and the CRC."""
    out, errors, held = [], [], b""

    def finish(data: bytes) -> None:
        while len(data) >= 3 and data[0] != 0xFF:
            n = 3 + ((data[1] & 0x0F) << 8 | data[2])
            if n > len(data):
                errors.append("section")
                return
            if n < 12 or mpeg_crc(data[:n]) != 0:  # the CRC over a section and its own CRC is 0
                errors.append("crc")
            else:
                out.append(data[8 : n - 4])
            data = data[n:]

    start, has = _payload_at(q)
    for row, at in zip(q[has], start[has], strict=True):
        data = row[at:].tobytes()
        if row[1] & 0x40 and data:
            finish(held + data[1 : 1 + data[0]])
            held = data[1 + data[0] :]
        elif held:
            held += data
    finish(held)
    return out, errors


def demux(stream: bytes | None) -> dict | None:
    """payload, pts and random_access (one entry per access unit), pids, errors."""
    if stream is None:
        return None
    p, errors = packets(stream)
    flagged = p[:, 1] & 0x80 > 0
    if flagged.any():
        errors.append("transport")
        p = p[~flagged]
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    elementary: set[int] = set()
    tables, bad = sections(p[pid == PAT_PID])
    errors += bad
    maps = {where & 0x1FFF for body in tables for number, where in struct.iter_unpack(">HH", body[: len(body) // 4 * 4]) if number}
    for where in sorted(maps):
        found, bad = sections(p[pid == where])
        errors += bad
        for info in found:
            i = 4 + (struct.unpack_from(">H", info, 2)[0] & 0xFFF) if len(info) >= 4 else len(info)
            while i + 5 <= len(info):
                es, skip = struct.unpack_from(">HH", info, i + 1)
                elementary.add(es & 0x1FFF)
                i += 5 + (skip & 0xFFF)
    units: list[tuple[int, bool, bytes]] = []
    for es in sorted(elementary):
        q = p[pid == es]
        if len(q):  # a packet may be sent twice in a row
            q = q[np.r_[True, ~((q[1:] == q[:-1]).all(1) & (q[1:, 3] & 0x10 > 0))]]
        start, has = _payload_at(q)
        counter = q[:, 3] & 15
        flags = np.where((q[:, 3] & 0x20 > 0) & (q[:, 4] > 0), q[:, 5], 0)
        if (((counter[1:] - counter[:-1] - has[1:]) & 15 > 0) & (flags[1:] & 0x80 == 0)).any():
            errors.append("continuity")
        begins = np.flatnonzero(q[:, 1] & 0x40)
        if len(q) and (not len(begins) or begins[0]) and has[: begins[0] if len(begins) else len(q)].any():
            errors.append("pes")  # bytes without a beginning
        for a, b in zip(begins, np.r_[begins[1:], len(q)][: len(begins)], strict=True):
            # payload bytes: those behind each packet's header and adaptation field
            pes = q[a:b][(np.arange(PACKET) >= start[a:b, None]) & has[a:b, None]].tobytes()
            if pes[:3] != b"\0\0\1" or len(pes) < 9:
                errors.append("pes")
                continue
            n, skip = struct.unpack_from(">H", pes, 4)[0], 9 + pes[8]
            if n + 6 > len(pes):
                errors.append("short")
            t = pes[9:14]
            pts = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1 if pes[7] & 0x80 and len(t) == 5 else -1
            units.append((pts, bool(flags[a] & 0x40), pes[skip : 6 + n if n else None]))
    return {"payload": b"".join(u[2] for u in units), "pts": [u[0] for u in units], "random_access": [u[1] for u in units], "starts": np.cumsum([0, *(len(u[2]) for u in units)])[:-1].tolist(), "pids": sorted(elementary), "packets": len(p), "errors": sorted(set(errors))}


def _mux_series(payload: pd.Series) -> pd.Series:
    return payload.map(mux, na_action="ignore")


READ = "payload binary, pts array<long>, random_access array<boolean>, starts array<long>, pids array<int>, packets int, errors array<string>"


def _demux_series(stream: pd.Series) -> pd.DataFrame:
    names = [c.split()[0] for c in READ.split(", ")]
    return pd.DataFrame([demux(s) or dict.fromkeys(names) for s in stream], columns=names)


def to_stream(payload: Column) -> Column:
    """A binary column as transport streams."""
    return F.pandas_udf(_mux_series, "binary")(payload)


def from_stream(stream: Column) -> Column:
    """A column of transport streams as a struct of READ."""
    return F.pandas_udf(_demux_series, READ)(stream)


def pad(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def _store_text(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in text], "media": [mux(pad(t)) for t in text]})


def store_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """df + n_bytes, media: the text padded to 192-byte blocks, stored as a transport stream."""
    common.bound_batches(df.sparkSession)
    kept = [c for c in df.columns if c.lower() not in ("n_bytes", "media")]
    # the table's own columns travel as one, so no name of theirs meets one of these
    stored = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("own"), F.pandas_udf(_store_text, "n_bytes long, media binary")(F.col(f"`{text}`")).alias("m"))
    return stored.select(*[F.col(f"own.`{c}`").alias(c) for c in kept], "m.n_bytes", "m.media")


DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<long>"

_KINDS = np.full(256, 4)
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\v\f\r", bytes(range(128, 256)))):
    _KINDS[list(_bytes)] = _k


def content_feature(data: bytes) -> str:
    """Entropy in bits a byte, distinct bytes, shares of letters, digits, white space, bytes over 127 and others, and lines."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = counts[counts > 0] / max(len(data), 1)
    shares = np.bincount(_KINDS, counts, 5) / max(len(data), 1)
    names = ("letters", "digits", "blanks", "high", "other")
    return ";".join([f"entropy={abs(float((p * np.log2(p)).sum())):.6f}", f"distinct={len(p)}", *(f"{n}={x:.6f}" for n, x in zip(names, shares, strict=True)), f"lines={int(counts[10]) + 1}"])


def digest(stream: bytes) -> tuple:
    """Values of DIGEST, all from the stored stream; random_access: payload bytes before each such point."""
    got = demux(stream)
    data = got["payload"]
    feature = content_feature(data) + f";units={len(got['pts'])};packets={got['packets']};errors={','.join(got['errors'])}"
    points = [at for at, r in zip(got["starts"], got["random_access"], strict=True) if r]
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(stream), hashlib.sha256(stream).hexdigest(), feature, got["pts"], points


def _digest_series(stream: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([digest(s) for s in stream], columns=[c.split()[0] for c in DIGEST.split(", ")])


def op2_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_texts(common.read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "media")
    return stored.withColumn("d", F.pandas_udf(_digest_series, DIGEST)("media")).select("doc_id", "n_bytes", "d.*")
