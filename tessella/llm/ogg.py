"""Media columns: payloads in Ogg files, written and read in Arrow batches.

`to_ogg` stores a text's bytes as unsigned 8-bit samples of one logical stream, beside a second
logical stream that tells how many of the samples are text. `from_ogg` verifies every page's
checksum, takes packets together from the lacing values, parts the logical streams and turns
granule positions into times. `packets` gives all packets of a table of files as rows.

Null and empty: a null text is stored as the empty text (64 samples of 0). A null file reads as
null. A file with damaged, missing or cut pages is read as far as its sound pages go; `bad_pages`
and `gaps` count what is amiss, a packet that lost a part is left out. Headers and notes of other
lengths than those written here give no rate or no size: no times, a null text size.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import BinaryType

from tessella.llm.common import text_bytes

#: Samples a second that the header of a sample stream states.
RATE = 8000
#: Samples in one packet; 16 lacing values of 255 and one of 16.
PACKET = 4096
PAD = 64
#: First bytes of the header packets of the two kinds of stream.
SAMPLES, NOTES = b"\x01samples", b"\x01notes\x00\x00"

HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
#: Each byte with its bits in reverse order.
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, register 0 at the start, not inverted at the end.

    It is the mirror image of zlib's CRC over mirrored bytes, so zlib does the work.
    """
    mirrored = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(REVERSED), "big")


def _page(body: bytes, lacing: bytes, kind: int, granule: int, serial: int, number: int) -> bytes:
    head = HEAD.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def pages_of(stream: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """Pages of one logical stream of (packet, granule position) pairs; the first packet has a page of its own."""
    out: list[bytes] = []
    body, lacing, granule, held = bytearray(), bytearray(), -1, 0

    def flush(more: bool, end: bool) -> None:
        nonlocal body, lacing, granule, held
        kind = held | (0 if out else FIRST) | (LAST if end else 0)
        out.append(_page(bytes(body), bytes(lacing), kind, granule, serial, len(out)))
        body, lacing, granule, held = bytearray(), bytearray(), -1, CONTINUED if more else 0

    for k, (packet, at) in enumerate(stream):
        values, done = bytes([255]) * (len(packet) // 255) + bytes([len(packet) % 255]), 0
        while done < len(values):
            take = values[done : done + 255 - len(lacing)]
            lacing += take
            body += packet[done * 255 : (done + len(take)) * 255]
            done += len(take)
            if done == len(values):
                granule = at
            last = k == len(stream) - 1 and done == len(values)
            if len(lacing) == 255 or k == 0 or last:
                flush(done < len(values), last)
    return out


def encode(raw: bytes) -> bytes:
    """An Ogg file of `raw`, filled up with bytes 0 to a positive multiple of 64."""
    size = max(PAD, -(-len(raw) // PAD) * PAD)
    payload = raw.ljust(size, b"\0")
    serial = zlib.crc32(payload) & 0x7FFFFFFE
    samples = [(SAMPLES + struct.pack("<IBQ", RATE, 8, size), 0)]
    samples += [(payload[i : i + PACKET], min(i + PACKET, size)) for i in range(0, size, PACKET)]
    notes = [(NOTES + struct.pack("<I", 1), 0), (struct.pack("<Q", len(raw)), 0)]
    a, b = pages_of(samples, serial), pages_of(notes, serial + 1)
    return b"".join([a[0], *b[:1], *a[1:-1], *b[1:], *a[-1:]])


def read_pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes] | None]:
    """(serial, number, kind, granule, lacing, body) of each sound page; None for each damaged one."""
    at, end = 0, len(media)
    while at < end:
        found = media.find(b"OggS", at)
        if found != at:
            yield None  # bytes that belong to no page
            if found < 0:
                return
            at = found
        if end - at < HEAD.size:
            yield None
            return
        _, version, kind, granule, serial, number, crc, n = HEAD.unpack_from(media, at)
        start = at + HEAD.size + n
        lacing = media[at + HEAD.size : start]
        stop = start + sum(lacing)
        if version or stop > end or page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : stop]) != crc:
            at += 4  # the next capture pattern is looked for
            yield None
            nxt = media.find(b"OggS", at)
            if nxt < 0:
                return
            at = nxt
            continue
        yield serial, number, kind, granule, lacing, media[start:stop]
        at = stop


def decode(media: bytes) -> dict:
    """Logical streams by serial number, each a list of (packet, granule position or None, seconds or None)."""
    streams: dict[int, dict] = {}
    pages = bad = gaps = 0
    for page in read_pages(media):
        if page is None:
            bad += 1
            continue
        pages += 1
        serial, number, kind, granule, lacing, body = page
        s = streams.setdefault(serial, {"next": number, "part": None, "packets": [], "rate": 0})
        if number != s["next"]:
            gaps += 1
            s["part"] = None
        s["next"] = number + 1
        part = s["part"] if kind & CONTINUED else None
        skip = bool(kind & CONTINUED) and part is None  # the rest of a packet whose start is lost
        begin = size = 0
        new: list[bytes] = []
        part = part or b""
        for v in lacing:
            size += v
            if v < 255:
                if skip:
                    skip = False
                else:
                    new.append(part + body[begin : begin + size])
                part, begin, size = b"", begin + size, 0
        s["part"] = None if skip else part + body[begin : begin + size] if size else None
        if new and not s["packets"] and new[0].startswith(SAMPLES) and len(new[0]) >= len(SAMPLES) + 4:
            s["rate"] = struct.unpack_from("<I", new[0], len(SAMPLES))[0]
        # a page's granule position is that of the last packet that ends on it
        for k, packet in enumerate(new):
            own = granule if k == len(new) - 1 and granule >= 0 else None
            s["packets"].append((packet, own, own / s["rate"] if own is not None and s["rate"] else None))
    return {"streams": streams, "pages": pages, "bad": bad, "gaps": gaps}


def _summary(media: bytes | None) -> dict | None:
    if media is None:
        return None
    found = decode(media)
    payload, text_size, end = b"", None, 0.0
    for s in found["streams"].values():
        head = s["packets"][0][0] if s["packets"] else b""
        if head.startswith(SAMPLES):
            payload = b"".join(p for p, _, _ in s["packets"][1:])
            end = max([0.0, *(t for _, _, t in s["packets"] if t is not None)])
        elif head.startswith(NOTES) and len(s["packets"]) > 1 and len(s["packets"][1][0]) == 8:
            text_size = struct.unpack("<q", s["packets"][1][0])[0]
    x = np.frombuffer(payload, np.uint8)
    loud = float(np.sqrt(np.square(x, dtype=np.float64).mean())) if len(x) else 0.0
    turns = int(np.count_nonzero((x[1:] >= 96) != (x[:-1] >= 96)))
    return {
        "payload": payload, "text_bytes": text_size, "streams": len(found["streams"]), "pages": found["pages"],
        "packets": sum(len(s["packets"]) for s in found["streams"].values()), "bad_pages": found["bad"],
        "gaps": found["gaps"], "seconds": end, "rms": round(loud, 4), "crossings": turns,
    }


_READ = pa.struct([("payload", pa.binary()), ("text_bytes", pa.int64()), ("streams", pa.int32()), ("pages", pa.int32()), ("packets", pa.int32()), ("bad_pages", pa.int32()), ("gaps", pa.int32()), ("seconds", pa.float64()), ("rms", pa.float64()), ("crossings", pa.int64())])


@F.arrow_udf(BinaryType())
def to_ogg(texts: pa.Array) -> pa.Array:
    """The Ogg file of each text."""
    return pa.array([encode(raw) for raw in text_bytes(texts)], pa.binary())


@F.arrow_udf(from_arrow_type(_READ))
def from_ogg(media: pa.Array) -> pa.Array:
    """What each Ogg file holds: payload, size of the text in it, counts, length in seconds, two features."""
    return pa.array([_summary(m) for m in media.to_pylist()], _READ)


def packets(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """A row for each packet of each file: key, serial, packet, granule, seconds, data.

    An empty table, a null file and a file without a sound page give no rows. Other columns of `files` are left out.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for serial, s in sorted(decode(m)["streams"].items() if m is not None else ()):
                    out += [(k, serial, n, g, t, p) for n, (p, g, t) in enumerate(s["packets"])]
                    if len(out) > 2000:
                        yield made(out, batch.schema.field(0).type)
                        out = []
            yield made(out, batch.schema.field(0).type)

    def made(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 6
        kinds = [kind, pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    names = [key, "serial", "packet", "granule", "seconds", "data"]
    kind = files.schema[key].dataType.simpleString()
    return files.select(key, media).mapInArrow(rows, f"`{key}` {kind}, serial bigint, packet int, granule bigint, seconds double, data binary")
