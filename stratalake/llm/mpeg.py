"""MPEG audio columns: payloads kept in MPEG-1 layer III streams.

Writing: an ID3v2.3 tag, a VBR header frame (Xing, with frame and byte counts
and the 100-entry seek table), then frames of 48 kHz mono with a CRC.  A frame
whose side information announces no coded samples plays as silence, and all of
its main data is ancillary data, which is where the payload goes: one to four
units of 192 bytes, told by the frame's bit rate.

Reading trusts only the bytes: it parses ID3v1 and ID3v2 tags (unsynchronised
ones and extended headers too), resynchronises on frame headers (a header counts
when its successor, or the end, stands where its length says; a free-format
frame's length is told by its successor), parses Xing and VBRI tables, verifies
every frame's CRC and the payload's, takes the payload back and gives exact
durations and the seek offset of every frame.

Defined results: a null or empty text is the empty one, whose payload is 192
blanks; a null or empty stream has no frames, an empty payload and duration 0;
equal texts give equal streams; bytes that no tag or frame holds are counted
and skipped; repeated rows are converted each on its own; an empty table gives
an empty one; other input columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as T
from .cluster import arrow, pick

UNIT = 192
# The standard's tables of bit rates (kbit/s, layer III of MPEG-1, then of MPEG-2), rates (Hz) and samples.
BITRATES = {3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {3: 1152, 2: 576, 0: 576}
CRC_POLYNOMIAL, CRC_START = 0x8005, 0xFFFF
SIDE_BYTES = {(3, True): 17, (3, False): 32, (2, True): 9, (2, False): 17}
#: Index of the bit rate by units in a frame: 80, 160, 224 and 320 kbit/s, frames of 240, 480, 672 and 960 bytes.
RATE_OF_UNITS = {1: 6, 2: 10, 3: 12, 4: 14}
UNITS_OF_RATE = {rate: units for units, rate in RATE_OF_UNITS.items()}
OVERHEAD = 4 + 2 + SIDE_BYTES[3, True]


def _crc_table() -> np.ndarray:
    out = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1 ^ CRC_POLYNOMIAL if value & 0x8000 else value << 1) & 0xFFFF
        out.append(value)
    return np.array(out, np.uint16)


CRC_TABLE = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC of each row of a byte matrix, all rows at once."""
    value = np.full(len(rows), CRC_START, np.uint16)
    for k in range(rows.shape[1]):
        value = (value << np.uint16(8)) ^ CRC_TABLE[(value >> np.uint16(8)) ^ rows[:, k]]
    return value


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    protected: bool
    bitrate_index: int
    rate: int
    padding: int
    mono: bool

    @property
    def length(self) -> int:
        """Bytes; of a free-format frame 0, for its header doesn't tell."""
        if not self.bitrate_index:
            return 0
        kbit = BITRATES[3 if self.version == 3 else 2][self.bitrate_index]
        return SAMPLES[self.version] // 8 * kbit * 1000 // self.rate + self.padding

    @property
    def samples(self) -> int:
        return SAMPLES[self.version]

    @property
    def side(self) -> int:
        return SIDE_BYTES[3 if self.version == 3 else 2, self.mono]

    @property
    def data_at(self) -> int:
        return 4 + 2 * self.protected + self.side


def parse_header(data: bytes, at: int) -> Header | None:
    """The layer III frame header at a place, or None."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = data[at + 1] >> 3 & 3, data[at + 1] >> 1 & 3
    index, rate = data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if version == 1 or layer != 1 or index == 15 or rate == 3 or data[at + 3] & 3 == 2:
        return None
    return Header(version, not data[at + 1] & 1, index, RATES[version][rate], data[at + 2] >> 1 & 1, data[at + 3] >> 6 == 3)


def _header_bytes(units: int) -> bytes:
    return bytes([0xFF, 0xFA, RATE_OF_UNITS[units] << 4 | 1 << 2, 0xC0])


def _frame_length(units: int) -> int:
    return parse_header(_header_bytes(units), 0).length


def _frames(payload: np.ndarray, units: int) -> np.ndarray:
    """Frames of `units` units each, one row a frame."""
    body = payload.reshape(-1, units * UNIT)
    out = np.zeros((len(body), _frame_length(units)), np.uint8)
    head = np.frombuffer(_header_bytes(units), np.uint8)
    out[:, :4] = head
    protected = np.concatenate([head[2:4], np.zeros(SIDE_BYTES[3, True], np.uint8)])[None]
    out[:, 4:6] = np.frombuffer(int(crc16(protected)[0]).to_bytes(2, "big"), np.uint8)
    out[:, OVERHEAD : OVERHEAD + units * UNIT] = body
    return out


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def id3v2(texts: dict[str, str]) -> bytes:
    body = b""
    for name, value in texts.items():
        value = b"\x00" + value.encode("latin-1")
        body += name.encode() + struct.pack(">IH", len(value), 0) + value
    return b"ID3\x03\x00\x00" + _synchsafe(len(body)) + body


def encode(payload: bytes) -> bytes:
    """A payload of a positive multiple of UNIT bytes as a stream; equal payloads give equal streams."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 192 bytes")
    units = np.frombuffer(payload, np.uint8)
    whole = len(units) // (4 * UNIT) * 4 * UNIT
    rest = (len(units) - whole) // UNIT
    music = _frames(units[:whole], 4).tobytes() + (_frames(units[whole:], rest).tobytes() if rest else b"")
    count = whole // (4 * UNIT) + bool(rest)
    first = _frames(np.zeros(UNIT, np.uint8), 1)[0].copy()
    total, longest = len(first) + len(music), _frame_length(4)
    seek = [min(255, 256 * (len(first) + min(percent * count // 100, count) * longest) // total) for percent in range(100)]
    table = b"Xing" + struct.pack(">III", 7, count, total) + bytes(seek)
    first[OVERHEAD : OVERHEAD + len(table)] = np.frombuffer(table, np.uint8)
    tag = id3v2({"TIT2": "payload", "TLEN": str(count * 24), "TSSE": f"crc32={zlib.crc32(payload):08x}"})
    return tag + first.tobytes() + music


@dataclass(frozen=True)
class Stream:
    tags: dict[str, str]
    vbr_frames: int | None
    vbr_bytes: int | None
    vbr_seek: bytes
    rate: int
    frames: int
    samples: int
    offsets: np.ndarray  # of each audio frame in the stream
    crc_errors: int
    skipped: int  # bytes that no tag or frame holds
    payload: bytes

    @property
    def intact(self) -> bool | None:
        """Whether the payload is the one that the writer's tag names; None where no tag does."""
        named = re.fullmatch(r"crc32=([0-9a-f]{8})", self.tags.get("TSSE", ""))
        return int(named[1], 16) == zlib.crc32(self.payload) if named else None

    @property
    def duration(self) -> Fraction:
        """Seconds, exactly."""
        return Fraction(self.samples, self.rate) if self.rate else Fraction(0)

    def seek(self, seconds: Fraction | float) -> int:
        """The place of the frame that plays at a time."""
        frame = int(Fraction(seconds) * self.rate / (self.samples // max(self.frames, 1) or 1))
        return int(self.offsets[min(frame, self.frames - 1)])


def _tag(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of a leading ID3v2 tag, and where it ends."""
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    end = 10 + _number(data[6:10], 7)
    version, flags = data[3], data[5]
    found, at, behind = {}, 10, end + 10 * bool(version == 4 and flags & 0x10)  # a footer
    if flags & 0x80 and version < 4:  # unsynchronised as a whole
        data = data[:10] + data[10:end].replace(b"\xff\x00", b"\xff")
        end = len(data)
    if flags & 0x40:  # an extended header, which in version 4 counts itself
        at += _number(data[10:14], 7) if version == 4 else 4 + _number(data[10:14], 8)
    while at + 10 <= min(end, len(data)) and data[at]:
        size = _number(data[at + 4 : at + 8], 7 if version == 4 else 8)
        name, body = data[at : at + 4].decode("latin-1"), data[at + 10 : at + 10 + size]
        if name[0] == "T" and body:
            found[name] = body[1:].decode("utf-16" if body[0] == 1 else "utf-8" if body[0] == 3 else "latin-1", "replace").rstrip("\0")
        at += 10 + size
    return found, behind


def _number(digits: bytes, bits: int) -> int:
    """A big-endian number with so many bits a byte."""
    return functools.reduce(lambda n, b: n << bits | b, digits, 0)


#: Length of an ID3v1 tag, and its fields: name, first byte, length.
ID3V1, ID3V1_FIELDS = 128, (("title", 3, 30), ("artist", 33, 30), ("album", 63, 30), ("year", 93, 4), ("comment", 97, 30))


def _free_length(data: bytes, at: int) -> int:
    """Of a free-format frame: how far the next header with the same fixed fields is, less the padding; 0 if there is none."""
    first, place = parse_header(data, at), at + 4
    while (place := data.find(data[at : at + 1], place)) >= 0:
        other = parse_header(data, place)
        if other and (other.version, other.bitrate_index, other.rate, other.protected) == (first.version, 0, first.rate, first.protected):
            return place - at - first.padding
        place += 1
    return 0


def _vbr(data: bytes, frame: int, header: Header) -> tuple[int | None, int | None, bytes] | None:
    """(frames, bytes, seek table) of a first frame that holds a Xing, Info or VBRI table."""
    start = frame + header.data_at
    if data[start : start + 4] in (b"Xing", b"Info"):
        flags, place, fields = _number(data[start + 4 : start + 8], 8), start + 8, []
        for bit, size in ((1, 4), (2, 4), (4, 100)):
            fields.append(data[place : place + size] if flags & bit else b"")
            place += size if flags & bit else 0
        return _number(fields[0], 8) if fields[0] else None, _number(fields[1], 8) if fields[1] else None, fields[2]
    start = frame + 36
    if data[start : start + 4] == b"VBRI":
        entries, width = _number(data[start + 18 : start + 20], 8), _number(data[start + 22 : start + 24], 8)
        return _number(data[start + 14 : start + 18], 8), _number(data[start + 10 : start + 14], 8), data[start + 26 : start + 26 + entries * width]
    return None


def _run_of_equal(data: np.ndarray, at: int, end: int, header: bytes, length: int) -> int:
    """How many frames with this very header follow each other from `at`; looked up over a growing stride."""
    count, step = 1, 64
    want = np.frombuffer(header, np.uint8)
    while True:
        room = min(step, (end - at - count * length) // length)
        if room <= 0:
            return count
        part = data[at + count * length : at + (count + room) * length].reshape(room, length)
        same = (part[:, :4] == want).all(axis=1)
        if not same.all():
            return count + int(np.argmin(same))
        count, step = count + room, step * 4


def decode(data: bytes) -> Stream:
    """Parse a stream of any layer III frames; the payload is what `encode` would have put there."""
    tags, at = _tag(data)
    end, last = len(data), len(data) - ID3V1
    view = np.frombuffer(data, np.uint8)
    frames = samples = errors = skipped = rate = 0
    offsets, payload = [], []
    vbr, free = None, 0
    while at < end:
        if at == last and data[at : at + 3] == b"TAG":  # only behind the last frame; a payload may hold these bytes too
            tags = {name: text for name, a, n in ID3V1_FIELDS if (text := data[at + a : at + a + n].split(b"\0")[0].decode("latin-1").rstrip())} | tags
            break
        header = parse_header(data, at)
        step = header.length if header else 0
        if header and not header.bitrate_index:
            free = free or _free_length(data, at)
            step = free and free + header.padding
        follows = header and step and (at + step == end or (at + step == last and data[last : last + 3] == b"TAG") or at + step + 4 <= end and parse_header(data, at + step))
        if not follows:
            nearest = data.find(b"\xff", at + 1, end)
            nearest = end if nearest < 0 else nearest
            skipped, at = skipped + nearest - at, nearest
            continue
        count = _run_of_equal(view, at, end, data[at : at + 4], step) if header.bitrate_index else 1
        block = view[at : at + count * step].reshape(count, step)
        if header.protected:
            want = block[:, 4].astype(np.uint16) << np.uint16(8) | block[:, 5]
            good = crc16(np.concatenate([block[:, 2:4], block[:, 6 : 6 + header.side]], axis=1)) == want
            errors += int((~good).sum())
        first = 0
        if vbr is None and not frames:
            vbr = _vbr(data, at, header)
            first = int(vbr is not None)
        units = UNITS_OF_RATE.get(header.bitrate_index, 0) if header.version == 3 and header.mono and header.rate == 48000 else 0
        if units:
            payload.append(block[first:, header.data_at : header.data_at + units * UNIT].tobytes())
        offsets.append(at + step * np.arange(first, count, dtype=np.int64))
        frames, samples, rate = frames + count - first, samples + header.samples * (count - first), header.rate
        at += count * step
    found = vbr or (None, None, b"")
    return Stream(tags, found[0], found[1], found[2], rate, frames, samples, np.concatenate(offsets) if offsets else np.zeros(0, np.int64), errors, skipped, b"".join(payload))


PAYLOAD = {True: "ok", False: "differs", None: "unnamed"}


def feature(stream: Stream, size: int) -> str:
    """What a stream's columns sum up to: frames, exact duration, errors, agreement with the VBR table, and a digest of the seek offsets."""
    seconds = stream.duration
    agrees = stream.vbr_frames == stream.frames and len(stream.vbr_seek) == 100
    return f"frames={stream.frames};seconds={seconds.numerator}/{seconds.denominator};rate={stream.rate};crc_errors={stream.crc_errors};payload={PAYLOAD[stream.intact]};skipped={stream.skipped};vbr={'ok' if agrees else 'differs'};bytes={size};seek_crc32={zlib.crc32(stream.offsets.astype('<i8').tobytes()):08x}"


def pad(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT or (0 if text else UNIT))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media binary): each text, padded with blanks, as a stream. A null text is the empty one."""
    narrow = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in T.slices(batches, "text"):
            texts = [data[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array([encode(pad(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return narrow.transform(arrow, run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


READ = "duration_s double, frames long, sample_rate int, crc_errors long, payload_intact boolean, skipped_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = (), offsets: bool = True) -> DataFrame:
    """Parse a column of streams: durations, checks and digests and, with `offsets`, seek_offsets, the place of each frame. A null stream is the empty one."""
    narrow = pick(media, doc_id=id_col, media=media_col, **{k: k for k in keep})
    kinds = [pa.float64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, places in T.slices(batches, "media"):
            rows, seeks = [], []
            for a, b in zip(places, places[1:], strict=False):
                raw = data[a:b].tobytes()
                s = decode(raw)
                rows.append((float(s.duration), s.frames, s.rate, s.crc_errors, s.intact, s.skipped, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(s, len(raw))))
                seeks.append(s.offsets if offsets else None)
            kept = [batch.column(batch.schema.get_field_index(k)) for k in ("doc_id", *keep)]
            more = [pa.array(seeks, pa.list_(pa.int64()))] if offsets else []
            yield pa.RecordBatch.from_arrays(kept + [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] + more, names=["doc_id", *keep, *names] + ["seek_offsets"] * offsets)

    kept = ", ".join(f"{k} {narrow.schema[k].dataType.simpleString()}" for k in ("doc_id", *keep))
    return narrow.transform(arrow, run, f"{kept}, {READ}" + ", seek_offsets array<long>" * offsets)
