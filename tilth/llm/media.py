"""Media columns: what binary values really are.

An Aho-Corasick automaton over the magic bytes finds where a medium may start; a validator per format then walks its
structure (chunks, boxes, pages, check sums, lengths) and says where it ends. A value whose first byte starts a medium
that fills it has that type, whatever was declared; media found elsewhere in it are carved out as spans.

Defined cases: null is no bytes, which have no type and no spans. Spans are listed by start; of two that start together
the longer wins, and a span inside one already listed is kept only where the outer one is not an exact structure of its
own type (uncompressed samples may hold another medium, so spans inside them are listed too). Repeated rows each give
a row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAD = 192


def _riff(data: bytes, at: int, kind: bytes) -> int | None:
    """RIFF: chunks of even length that fill the stated size."""
    if len(data) < at + 12 or data[at + 8 : at + 12] != kind:
        return None
    end, k, seen = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little"), at + 12, set()
    if end > len(data):
        return None
    while k + 8 <= end:
        seen.add(data[k : k + 4])
        n = int.from_bytes(data[k + 4 : k + 8], "little")
        k += 8 + n + n % 2
    need = {b"fmt ", b"data"} if kind == b"WAVE" else {b"VP8 "}
    return end if k == end and (need <= seen or (kind == b"WEBP" and seen & {b"VP8L", b"VP8X"})) else None


def _wav(data: bytes, at: int) -> int | None:
    return _riff(data, at, b"WAVE")


def _webp(data: bytes, at: int) -> int | None:
    return _riff(data, at, b"WEBP")


def _png(data: bytes, at: int) -> int | None:
    """PNG: IHDR first, each chunk's check sum right, IEND last."""
    k, first = at + 8, True
    while k + 12 <= len(data):
        n, name = int.from_bytes(data[k : k + 4], "big"), data[k + 4 : k + 8]
        stop = k + 12 + n
        if stop > len(data) or (first and (name != b"IHDR" or n != 13)) or zlib.crc32(data[k + 4 : k + 8 + n]) != int.from_bytes(data[stop - 4 : stop], "big"):
            return None
        if name == b"IEND":
            return stop
        k, first = stop, False
    return None


def _gif(data: bytes, at: int) -> int | None:
    """GIF: screen, then extensions and images made of sub-blocks, up to the trailer."""
    if len(data) < at + 13:
        return None
    k = at + 13 + (3 << ((data[at + 10] & 7) + 1) if data[at + 10] & 0x80 else 0)
    images = 0
    while k < len(data):
        mark = data[k]
        if mark == 0x3B:
            return k + 1 if images else None
        if mark == 0x21:
            k += 2
        elif mark == 0x2C and k + 10 < len(data):
            k += 11 + (3 << ((data[k + 9] & 7) + 1) if data[k + 9] & 0x80 else 0)
            images += 1
        else:
            return None
        while k < len(data) and data[k]:
            k += 1 + data[k]
        k += 1
    return None


def _jpeg(data: bytes, at: int) -> int | None:
    """JPEG: segments with lengths; after a scan starts, on to the next marker that isn't stuffing or a restart."""
    k, scans = at + 2, 0
    while k + 4 <= len(data):
        if data[k] != 0xFF:
            return None
        mark = data[k + 1]
        if mark == 0xFF:
            k += 1
            continue
        k += 2 + int.from_bytes(data[k + 2 : k + 4], "big")
        if mark == 0xDA:
            scans += 1
            while (k := data.find(b"\xff", k)) >= 0 and k + 1 < len(data) and (data[k + 1] == 0 or 0xD0 <= data[k + 1] <= 0xD7):
                k += 2
            if k < 0 or k + 1 >= len(data):
                return None
            if data[k + 1] == 0xD9:
                return k + 2
    return None


def _bmp(data: bytes, at: int) -> int | None:
    """BMP: a known header size, one plane, a usual depth, and pixels inside the stated size."""
    if len(data) < at + 54:
        return None
    size, pixels, header = struct.unpack_from("<I4xII", data, at + 2)
    planes, depth = struct.unpack_from("<HH", data, at + 26)
    return at + size if header in (40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and 54 <= pixels <= size <= len(data) - at else None


def _pdf(data: bytes, at: int) -> int | None:
    """PDF: a version, an object and the last end mark before another header."""
    if not (data[at + 5 : at + 6].isdigit() and data[at + 6 : at + 7] == b"."):
        return None
    nxt = data.find(b"%PDF-", at + 5)
    end = data.rfind(b"%%EOF", at, nxt if nxt >= 0 else len(data))
    return end + 5 if end >= 0 and b" obj" in data[at:end] else None


def _zip(data: bytes, at: int) -> int | None:
    """ZIP: the end record whose directory lies where it says, counted from the first local header."""
    k = at
    while (k := data.find(b"PK\5\6", k)) >= 0:
        if k + 22 <= len(data):
            size, offset, note = struct.unpack_from("<IIH", data, k + 12)
            if at + offset + size == k and k + 22 + note <= len(data) and data[at + offset : at + offset + 4] == b"PK\1\2":
                return k + 22 + note
        k += 4
    return None


def _gzip(data: bytes, at: int) -> int | None:
    """gzip: a member that inflates whole, with its check sum."""
    stream, k = zlib.decompressobj(31), at
    try:
        while not stream.eof and k < len(data):
            stream.decompress(data[k : k + 65536])
            k += 65536
    except zlib.error:
        return None
    return min(k, len(data)) - len(stream.unused_data) if stream.eof else None


def _ogg(data: bytes, at: int) -> int | None:
    """Ogg: pages of one stream, the first flagged as its start, up to the one flagged as its end."""
    k, serial, end = at, None, None
    while data[k : k + 4] == b"OggS" and k + 27 <= len(data):
        flags, own = data[k + 5], data[k + 14 : k + 18]
        if serial is None and not flags & 2 or serial not in (None, own):
            break
        serial, n = own, data[k + 26]
        k += 27 + n + sum(data[k + 27 : k + 27 + n])
        if k > len(data):
            break
        if flags & 4:
            end = k
            break
    return end


def _flac(data: bytes, at: int) -> int | None:
    """FLAC: STREAMINFO first, metadata blocks in range, then a frame's sync code; frames run to the end."""
    k, first = at + 4, True
    while k + 4 <= len(data):
        head, n = data[k], int.from_bytes(data[k + 1 : k + 4], "big")
        if first and (head & 0x7F or n != 34):
            return None
        k, first = k + 4 + n, False
        if head & 0x80:
            return len(data) if data[k : k + 1] == b"\xff" and data[k + 1 : k + 2] in (b"\xf8", b"\xf9") else None
    return None


def _mp4(data: bytes, at: int) -> int | None:
    """MP4: boxes with fitting sizes from ftyp on; moov must be among them. The magic stands four bytes in."""
    k, seen = at, set()
    while k + 8 <= len(data):
        n, name = int.from_bytes(data[k : k + 4], "big"), data[k + 4 : k + 8]
        if n < 8 or k + n > len(data) or not name.isalnum():
            break
        seen.add(name)
        k += n
    return k if {b"ftyp", b"moov"} <= seen else None


#: Magic bytes, how far they are from the medium's start, its type and its validator. Fixed values of the formats.
FORMATS = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"BM", 0, "image/bmp", _bmp),
    (b"RIFF", 0, "audio/wav", _wav),
    (b"RIFF", 0, "image/webp", _webp),
    (b"fLaC", 0, "audio/flac", _flac),
    (b"OggS", 0, "audio/ogg", _ogg),
    (b"ftyp", 4, "video/mp4", _mp4),
    (b"%PDF-", 0, "application/pdf", _pdf),
    (b"PK\3\4", 0, "application/zip", _zip),
    (b"\x1f\x8b\x08", 0, "application/gzip", _gzip),
)


def automaton() -> ahocorasick.Automaton:
    found: dict[str, list] = {}
    for magic, back, kind, check in FORMATS:
        found.setdefault(magic.decode("latin-1"), []).append((back, kind, check))
    out = ahocorasick.Automaton()
    for magic, formats in found.items():
        out.add_word(magic, (len(magic), formats))
    out.make_automaton()
    return out


def media_in(data: bytes, find: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(type, start, end) of every valid medium, by start, the longer first."""
    out = set()
    for last, (n, formats) in find.iter(data.decode("latin-1")):
        for back, kind, check in formats:
            start = last + 1 - n - back
            if start >= 0 and (end := check(data, start)) is not None:
                out.add((kind, start, end))
    held: list[tuple[str, int, int]] = []
    for kind, start, end in sorted(out, key=lambda x: (x[1], -x[2], x[0])):
        inside = any(s <= start and end <= e and k not in ("audio/wav", "image/bmp") for k, s, e in held)
        if not inside and not any(s == start for _, s, _ in held):
            held.append((kind, start, end))
    return held


SPANS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def sniff(df: DataFrame, media_col: str = "media", declared_col: str | None = None) -> DataFrame:
    """df with `media_spans` (all media in the value), `sniffed_type` (of the value as a whole; null if none fills it),
    `type` (the sniffed one, else the declared one) and `corrected` (a declared type was wrong). Columns of these names
    are replaced."""
    df = df.drop("media_spans", "sniffed_type", "type", "corrected") if declared_col != "type" else df.withColumnRenamed("type", "__declared").drop("media_spans", "sniffed_type", "corrected")
    declared = F.col("__declared" if declared_col == "type" else declared_col) if declared_col else F.lit(None).cast("string")
    place = df.columns.index(media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton()
        spans_type = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [[{"type": k, "start": a, "end": b} for k, a, b in media_in(x.as_buffer().to_pybytes(), find)] if x.is_valid else [] for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, spans_type)], names=[*batch.schema.names, "media_spans"])

    out = df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("media_spans", SPANS)]))
    first = F.try_element_at("media_spans", F.lit(1))
    sniffed = F.when((first["start"] == 0) & (first["end"] == F.octet_length(media_col)), first["type"])
    out = out.withColumn("sniffed_type", sniffed).withColumn("type", F.coalesce("sniffed_type", declared)).withColumn("corrected", F.coalesce(F.col("sniffed_type") != declared, F.lit(False)))
    return out.drop("__declared")


def carve(df: DataFrame, media_col: str = "media") -> DataFrame:
    """A row for each medium inside a sniffed value but not the value itself: its type, span and bytes."""
    span = F.explode("media_spans").alias("span")
    inner = df.select("*", span).where((F.col("span.start") > 0) | (F.col("span.end") < F.octet_length(media_col)))
    return inner.withColumns({"type": F.col("span.type"), "start": F.col("span.start"), "end": F.col("span.end")}).withColumn(media_col, F.substring(F.col(media_col), F.col("span.start").cast("int") + 1, (F.col("span.end") - F.col("span.start")).cast("int"))).drop("span", "media_spans", "sniffed_type", "corrected")


def _little(n: Column) -> Column:
    """Four bytes, the lowest first."""
    wide = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(wide, k, 2) for k in (7, 5, 3, 1)]))


def to_wav(payload: Column) -> Column:
    """The bytes as the samples of an 8-bit mono recording; an odd number gets the format's pad byte."""
    n = F.octet_length(payload)
    data = F.when(n % 2 == 0, payload).otherwise(F.concat(payload, F.unhex(F.lit("00"))))
    ascii_ = lambda s: F.lit(s).cast("binary")
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8)
    return F.concat(ascii_("RIFF"), _little(n + n % 2 + 36), ascii_("WAVE"), F.unhex(F.lit(head.hex())), ascii_("data"), _little(n), data)


def samples(media: Column) -> Column:
    """The samples of a recording that to_wav made, as many as its data chunk states."""
    size = F.conv(F.concat(*[F.hex(F.substring(media, k, 1)) for k in (44, 43, 42, 41)]), 16, 10).cast("int")
    return F.substring(media, F.lit(45), size)


def padded(text: Column) -> Column:
    """UTF-8 with spaces up to a positive multiple of PAD."""
    n = F.octet_length(text)
    size = F.greatest(F.lit(1), F.ceil(n / PAD)) * PAD
    return F.concat(text.cast("binary"), F.repeat(F.lit(" "), (size - n).cast("int")).cast("binary"))


def stored_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: its text stored as a recording declared as plain text, sniffed, and read back."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    made = df.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), to_wav(padded(text)).alias("media"), F.lit("text/plain").alias("declared"))
    found = sniff(made, "media", "declared").withColumn("payload", samples(F.col("media")))
    listed = F.array_join(F.transform("media_spans", lambda s: F.concat_ws(":", s["type"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        id_col,
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), F.octet_length("payload") - 15, F.lit(16))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.col("type"), F.lit(";"), listed).alias("feature"),
        F.col("corrected"),
    )
