"""GIF columns: encode samples as frames, decode any GIF, frames with colour histograms.

The decoder reads palettes, LZW code streams of any code size, interlacing, disposal and
transparency, and gives timed frames on the full canvas. The encoder writes 8-bit samples under a
grey palette as LZW streams with a growing table; a frame whose samples leave a value free has it as
its transparent colour, and frames take the ways of disposal in turn.

An LZW string is what its code's predecessor gave and one sample more, so it lies in the output already: at the
place where the predecessor's string starts. A run of codes up to a clear code is so decoded at once:
code widths follow from a code's number in the run, lengths and sources from the codes, and samples by
following sources to literals.

Cases: null text counts as empty; payloads are padded with spaces to a positive multiple of
the row width, so an empty text is one row; long payloads become several frames; a damaged or
cut GIF raises ValueError, null media have no frames; repeated rows give equal values; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WIDTH = 192
#: Rows of one frame at most.
FRAME_ROWS = 2048
DELAY_CS = 10
BINS = 16
#: Codes of a run after which the encoder clears the table: the last entry is then 4095.
_RUN = 3838


@dataclass
class Frame:
    delay_ms: int
    disposal: int
    transparent: int | None
    left: int
    top: int
    palette: np.ndarray
    indices: np.ndarray


def _widths(first: int, size: int, n: int) -> np.ndarray:
    """Bits of n codes of a run from number `first` on, the code after a clear code being number 0: the
    table that the reader has by then, 2 + 2**size entries and one a code but the first, sets them."""
    entries = (1 << size) + 1 + np.maximum(np.arange(first, first + n), 1)
    return np.minimum(np.maximum(np.floor(np.log2(entries)).astype(np.int64) + 1, size + 1), 12)


def lzw_codes(samples: bytes) -> list[list[int]]:
    """Runs of codes of 8-bit samples, each to follow a clear code."""
    runs: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}
    known, emit = table.get, codes.append
    more, last = 258, samples[0]
    for sample in samples[1:]:
        longer = known(last << 8 | sample)
        if longer is not None:
            last = longer
            continue
        emit(last)
        table[last << 8 | sample] = more
        more += 1
        last = sample
        if more == 258 + _RUN:
            runs.append(codes)
            codes, more = [], 258
            emit = codes.append
            table.clear()
    codes.append(last)
    return [*runs, codes]


def lzw_stream(samples: bytes) -> bytes:
    """LZW code stream of 8-bit samples, with a clear code before each run and an end code."""
    codes, widths = [np.array([256])], [np.array([9])]
    runs = lzw_codes(samples)
    for i, run in enumerate(runs):
        codes += [np.array(run), np.array([257 if i == len(runs) - 1 else 256])]
        widths.append(_widths(0, 8, len(run) + 1))
    c, w = np.concatenate(codes).astype("<u2"), np.concatenate(widths)
    bits = np.unpackbits(c.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < w[:, None]], bitorder="little").tobytes()


def _sub_blocks(data: bytes) -> bytes:
    full = len(data) // 255
    blocks = np.empty((full, 256), np.uint8)
    blocks[:, 0] = 255
    blocks[:, 1:] = np.frombuffer(data, np.uint8, full * 255).reshape(full, 255)
    rest = data[full * 255 :]
    return blocks.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode(payload: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS) -> bytes:
    """Grey GIF of a payload whose length is a positive multiple of width."""
    if not payload or len(payload) % width:
        raise ValueError("payload must be a positive multiple of the width")
    size, rows = width * frame_rows, len(payload) // width
    grey = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
    parts = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, frame_rows), 0xF7, 0, 0), grey]
    for number, at in enumerate(range(0, len(payload), size)):
        frame = payload[at : at + size]
        free = np.flatnonzero(np.bincount(np.frombuffer(frame, np.uint8), minlength=256) == 0)
        packed = (1 + number % 3) << 2 | (len(free) > 0)
        parts.append(b"\x21\xf9\x04" + struct.pack("<BHB", packed, DELAY_CS, int(free[0]) if len(free) else 0) + b"\0")
        parts.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(frame) // width, 0) + b"\x08")
        parts.append(_sub_blocks(lzw_stream(frame)))
    return b"".join(parts) + b"\x3b"


def _read_codes(bits: np.ndarray, at: int, widths: np.ndarray) -> np.ndarray:
    """Codes of the given widths from a bit on, as many as are whole."""
    starts = at + np.cumsum(widths) - widths
    whole = int(np.searchsorted(starts + widths, len(bits), side="right"))
    starts, widths = starts[:whole], widths[:whole]
    padded = bits[np.minimum(starts[:, None] + np.arange(12), len(bits) - 1)] if whole else np.zeros((0, 12), np.uint8)
    return (padded * (np.arange(12) < widths[:, None])).astype(np.int64) @ (1 << np.arange(12))


def _resolve(source: np.ndarray) -> np.ndarray:
    """Where each place's chain of sources ends; an end is its own source."""
    while True:
        further = source[source]
        if (further == source).all():
            return source
        source = further


def expand_run(codes: np.ndarray, size: int) -> np.ndarray:
    """Samples of the codes of a run. Entry number i of the run holds the string of code i and the sample
    after it; a code can use the entries of all codes before it."""
    first = (1 << size) + 2
    number = np.arange(len(codes))
    entry = codes - first
    literal = codes < first - 2
    if not literal[:1].all() or (~literal & ((entry < 0) | (entry >= number) | (entry >= 4096 - first))).any():
        raise ValueError("code is not in the table")
    # A string is one longer than that of its entry's code: lengths by doubling the steps back to a literal.
    back, steps = np.where(literal, number, entry), np.where(literal, 0, 1)
    while (back[back] != back).any():
        steps = steps + steps[back]
        back = back[back]
    lengths = steps + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    code_of = np.repeat(number, lengths)
    place = np.arange(ends[-1] if len(ends) else 0)
    source = np.where(literal[code_of], place, place - starts[code_of] + starts[np.where(literal, number, entry)[code_of]])
    return codes[code_of[_resolve(source)]].astype(np.uint8)


def lzw(data: bytes, min_size: int, pixels: int) -> np.ndarray:
    """Samples of an LZW code stream; ValueError if it is damaged or too short."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    out, made, at, run = [], 0, 0, 4096 - clear
    held: list[np.ndarray] = []
    while made < pixels:
        have = sum(map(len, held))
        # No more codes than the bits that are left can hold; fewer than a run are then the last.
        widths = _widths(have, min_size, min(run, (len(bits) - at) // (min_size + 1) + 1))
        codes = _read_codes(bits, at, widths)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        whole = int(stop[0]) if len(stop) else len(codes)
        held.append(codes[:whole])
        at += int(widths[: whole + 1 if len(stop) else whole].sum())
        if len(stop) or len(codes) < run:
            out.append(expand_run(np.concatenate(held), min_size))
            made, held = made + len(out[-1]), []
            if not len(stop) or codes[whole] == end:
                break
    if made < pixels:
        raise ValueError("code stream has too few samples")
    return np.concatenate(out)[:pixels] if out else np.zeros(0, np.uint8)


def _deinterlace(rows: np.ndarray) -> np.ndarray:
    out, at = np.empty_like(rows), 0
    for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)):
        n = len(range(start, len(rows), step))
        out[start::step] = rows[at : at + n]
        at += n
    return out


def decode(data: bytes) -> tuple[tuple[int, int], list[Frame]]:
    """((width, height), frames in order) of a GIF."""
    try:
        return _decode(data)
    except (IndexError, struct.error) as e:
        raise ValueError("GIF is cut off") from e


def _decode(data: bytes):
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, palette = 13, np.zeros((0, 3), np.uint8)

    def colours(flags: int, at: int):
        n = 2 << (flags & 7)
        return np.frombuffer(data, np.uint8, n * 3, at).reshape(n, 3), at + n * 3

    def blocks(at: int):
        parts, view = [], memoryview(data)
        while n := data[at]:
            if at + n + 1 > len(data):
                raise ValueError("GIF is cut off")
            parts.append(view[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    if flags & 0x80:
        palette, at = colours(flags, at)
    frames: list[Frame] = []
    delay, disposal, transparent = 0, 0, None
    while data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = blocks(at + 2)
            if label == 0xF9:
                packed, delay, index = struct.unpack("<BHB", body[:4])
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
        elif data[at] == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            own = palette
            if flags & 0x80:
                own, at = colours(flags, at)
            min_size = data[at]
            if not 1 <= min_size <= 8:
                raise ValueError("bad code size")
            body, at = blocks(at + 1)
            rows = lzw(body, min_size, w * h).reshape(h, w)
            frames.append(Frame(delay * 10, disposal, transparent, left, top, own, _deinterlace(rows) if flags & 0x40 else rows))
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError("unknown GIF block")
    return (width, height), frames


def render(size: tuple[int, int], frames: list[Frame]) -> Iterator[np.ndarray]:
    """The full RGB canvas as each frame shows it. Areas never drawn are black."""
    width = max([size[0], *(f.left + f.indices.shape[1] for f in frames)])
    height = max([size[1], *(f.top + f.indices.shape[0] for f in frames)])
    canvas = np.zeros((height, width, 3), np.uint8)
    for f in frames:
        h, w = f.indices.shape
        area = (slice(f.top, f.top + h), slice(f.left, f.left + w))
        saved = canvas.copy() if f.disposal == 3 else None
        if len(f.palette) <= int(f.indices.max(initial=0)):
            raise ValueError("sample is outside the palette")
        colours = f.palette[f.indices]
        if f.transparent is None:
            canvas[area] = colours
        else:
            shown = f.indices != f.transparent
            canvas[area][shown] = colours[shown]
        yield canvas
        if f.disposal == 2:
            canvas[area] = 0
        elif f.disposal == 3:
            canvas = saved


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Counts of each channel's values in 16 bins: (3, 16)."""
    return np.stack([np.bincount(canvas[..., c].reshape(-1) >> 4, minlength=BINS) for c in range(3)])


def pad(text: bytes, width: int = WIDTH) -> bytes:
    return text + b" " * (max(width, -(-len(text) // width) * width) - len(text))


_STEP = 200


def _mapped(df: DataFrame, schema: T.StructType, one) -> DataFrame:
    """One dict a row in, any number out, in small batches."""
    arrow_names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                rows = [out for row in batch.slice(at, _STEP).to_pylist() for out in one(row)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(arrow_names, arrow.types)], schema=arrow)

    return df.mapInArrow(run, schema)


def store_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded, as a GIF."""
    rows = df.select(df[doc_id].alias("doc_id"), df[text].alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def one(r):
        raw = (r["text"] or "").encode()
        yield {"doc_id": r["doc_id"], "n_bytes": len(raw), "media": encode(pad(raw))}

    return _mapped(rows, schema, one)


def timed_frames(media: bytes) -> Iterator[dict]:
    """Place, time, size, samples and colour histograms of each frame as it is shown."""
    size, got = decode(media)
    start = 0
    for i, (f, canvas) in enumerate(zip(got, render(size, got))):
        red, green, blue = histogram(canvas).tolist()
        yield {"frame": i, "start_ms": start, "delay_ms": f.delay_ms, "width": f.indices.shape[1], "height": f.indices.shape[0], "samples": f.indices.tobytes(), "red": red, "green": green, "blue": blue}
        start += f.delay_ms


def frames(df: DataFrame, doc_id: str = "doc_id", media: str = "media") -> DataFrame:
    """One row a frame: place, time, size, samples and colour-histogram columns."""
    rows = df.select(df[doc_id].alias("doc_id"), df[media].alias("media"))
    long, counts = T.LongType(), T.ArrayType(T.LongType())
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(k, long) for k in ("frame", "start_ms", "delay_ms", "width", "height")], T.StructField("samples", T.BinaryType()), *[T.StructField(k, counts) for k in ("red", "green", "blue")]])

    def one(r):
        for f in timed_frames(r["media"]) if r["media"] is not None else ():
            yield {"doc_id": r["doc_id"], **f}

    return _mapped(rows, schema, one)


def read_back(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, payload, tail_crc32, feature) of stored media: the samples of
    all frames in order; their number, length in ms, and the summed histograms of what they show."""
    schema = T.StructType([*df.select("doc_id", "n_bytes", "media").schema.fields, T.StructField("payload", T.BinaryType()), T.StructField("tail_crc32", T.LongType()), T.StructField("feature", T.StringType())])

    def one(r):
        got = list(timed_frames(r["media"]))
        payload = b"".join(f["samples"] for f in got)
        shown = np.array([[f[c] for c in ("red", "green", "blue")] for f in got]).sum(axis=0)
        feature = f"{len(got)};{got[-1]['start_ms'] + got[-1]['delay_ms']};" + ";".join(",".join(map(str, channel)) for channel in shown.tolist())
        yield {**r, "payload": payload, "tail_crc32": zlib.crc32(payload[-16:]), "feature": feature}

    return _mapped(df.select("doc_id", "n_bytes", "media"), schema, one)
