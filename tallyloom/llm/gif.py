"""Media columns: GIF files in binary columns, written and decoded with numpy.

The encoder compresses with LZW: the longest known string at each place is a code, codes grow
from 9 to 12 bits, and a full table is cleared. Its palette is a colour cube, three bits of red
and green and two of blue, so each byte value has a colour of its own. The decoder reads any GIF87a/89a:
LZW code streams (variable width, deferred clears), global and local palettes, interlacing, transparency,
disposal 0-3 and frame delays; a payload is read back from the colours of the rendered
frames.

Defined results: null or empty payloads are stored as 64 zero bytes by ``store_texts``;
a null or broken file (a stream that ends before its frame is full, too) decodes to null columns,
and so does one whose frame or canvas claims more than MAX_PIXELS pixels; repeated rows are decoded
row by row; payloads above a frame's size go on in further timed frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WIDTH = 64
ROWS = 4096  # of a frame; a longer payload takes several
DELAY_CS = 4
CODES = 4096
#: Bound of the memory that one file may take.
MAX_PIXELS = 1 << 26
CUBE = np.stack([np.arange(256) // 32 * 36, np.arange(256) // 4 % 8 * 36, np.arange(256) % 4 * 85], 1).astype("u1")


def steps(bits: int) -> list[tuple[int, int]]:
    """(width, codes) after a clear: how many codes are read at each width; the last has no end."""
    out, read = [], 0
    for width in range(bits + 1, 12):
        upto = max(0, (1 << width) - (1 << bits) - 2) + 1
        out.append((width, upto - read))
        read = upto
    return [*out, (12, 1 << 62)]


def lzw_codes(data: bytes) -> list[list[int]]:
    """The codes of the data between two clears, run after run."""
    runs, table, run, free = [], {}, [], 258
    known = table.get
    word = -1
    for c in data:
        if word < 0:
            word = c
            continue
        key = word << 8 | c
        code = known(key)
        if code is not None:
            word = code
            continue
        run.append(word)
        word = c
        if free < CODES:
            table[key] = free
            free += 1
        else:
            runs.append(run)
            run, free = [], 258
            table.clear()
    if word >= 0:
        run.append(word)
    return [*runs, run]


def packed(runs: list[list[int]]) -> bytes:
    """A clear before each run and the end code at last, lowest bit first."""
    bits, width = [], 9
    for k, run in enumerate(runs):
        bits.append(spelled([256], width))
        codes, at = (run + [257] if k == len(runs) - 1 else run), 0
        for width, n in steps(8):
            bits.append(spelled(codes[at : at + n], width))
            at += n
            if at > len(codes):  # the next code, a clear, has this width as well
                break
    return np.packbits(np.concatenate(bits), bitorder="little").tobytes()


def spelled(codes: list[int], width: int) -> np.ndarray:
    return (np.array(codes, "u2")[:, None] >> np.arange(width, dtype="u2") & 1).astype("u1").reshape(-1)


def blocks(data: bytes) -> bytes:
    whole = len(data) // 255
    a = np.empty((whole, 256), "u1")
    a[:, 0] = 255
    a[:, 1:] = np.frombuffer(data[: whole * 255], "u1").reshape(whole, 255)
    rest = data[whole * 255 :]
    return a.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """A GIF whose palette indices are the payload, frame after frame; its length must be
    a positive multiple of width."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must be a positive multiple of the width")
    high = len(payload) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(high, rows), 0xF7, 0, 0), CUBE.tobytes()]
    for top in range(0, high, rows):
        n = min(rows, high - top)
        body = packed(lzw_codes(payload[top * width : (top + n) * width]))
        out += [b"!\xf9\x04\x04", struct.pack("<HB", delay_cs, 0), b"\0,", struct.pack("<HHHHB", 0, 0, width, n, 0), b"\x08", blocks(body)]
    return b"".join([*out, b";"])


def unpacked(bits: np.ndarray, first: int) -> Iterator[list[int]]:
    """The codes of each run that a clear opens, without clears; the last run ends at the end code."""
    clear, at, end = 1 << first, 0, False
    while not end:
        run, cut = [], False
        for width, n in steps(first):
            n = min(n, (len(bits) - at) // width)
            codes = bits[at : at + n * width].reshape(n, width) @ (1 << np.arange(width))
            marks = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(marks):
                cut, end = True, codes[marks[0]] == clear + 1
                codes, n = codes[: marks[0]], marks[0] + 1
            run.append(codes)
            at += n * width
            if cut:
                break
            if len(bits) - at < width:
                end = True
                break
        yield np.concatenate(run).tolist()


def lzw(data: bytes, first: int, n: int) -> np.ndarray:
    """The n indices of a code stream whose colours have this many bits."""
    if not 1 <= first <= 11 or n > MAX_PIXELS:
        raise ValueError("a frame or its code size is too large")
    clear, parts, made = 1 << first, [], 0
    start = [bytes([k & 255]) for k in range(clear)] + [b"", b""]
    for run in unpacked(np.unpackbits(np.frombuffer(data, "u1"), bitorder="little"), first):
        if run and run[0] >= clear:
            raise ValueError("a run starts with a code that is not in the table")
        words, free, last = list(start), clear + 2, b""
        for at in range(0, len(run), CODES):
            out = []
            for code in run[at : at + CODES]:
                if code < free:
                    word = words[code]
                elif code == free < CODES:
                    word = last + last[:1]
                else:
                    raise ValueError("a code is beyond the table")
                if free < CODES and last:
                    words.append(last + word[:1])
                    free += 1
                last = word
                out.append(word)
            parts.append(b"".join(out))
            made += len(parts[-1])
            if made >= n:
                return np.frombuffer(b"".join(parts), "u1")[:n]
    raise ValueError("the stream ends before the frame is full")


def frames(gif: bytes) -> Iterator[dict]:
    """Each frame: left, top, width, height, delay_cs, disposal, transparent, palette, indices."""
    if gif[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    flags, at = gif[10], 13
    common = None
    if flags & 128:
        n = 3 << (flags & 7) + 1
        common, at = np.frombuffer(gif[at : at + n], "u1").reshape(-1, 3), at + n
    control = (0, 0, None)

    def chained(at: int) -> tuple[bytes, int]:
        out = []
        while gif[at]:
            out.append(gif[at + 1 : at + 1 + gif[at]])
            at += 1 + gif[at]
        return b"".join(out), at + 1

    while gif[at] != 0x3B:
        if gif[at] == 0x21:
            label = gif[at + 1]
            data, at = chained(at + 2)
            if label == 0xF9:
                control = (struct.unpack("<H", data[1:3])[0], data[0] >> 2 & 7, data[3] if data[0] & 1 else None)
        elif gif[at] == 0x2C:
            left, top, w, h, flags = struct.unpack("<HHHHB", gif[at + 1 : at + 10])
            at, palette = at + 10, common
            if flags & 128:
                n = 3 << (flags & 7) + 1
                palette, at = np.frombuffer(gif[at : at + n], "u1").reshape(-1, 3), at + n
            bits = gif[at]
            data, at = chained(at + 1)
            indices = lzw(data, bits, w * h).reshape(h, w)
            if flags & 64:
                order = np.r_[0:h:8, 4:h:8, 2:h:4, 1:h:2]
                whole = np.empty_like(indices)
                whole[order] = indices
                indices = whole
            yield {"left": left, "top": top, "width": w, "height": h, "delay_cs": control[0], "disposal": control[1], "transparent": control[2], "palette": palette, "indices": indices}
            control = (0, 0, None)
        else:
            raise ValueError("an unknown block")


def rendered(gif: bytes) -> Iterator[tuple[dict, np.ndarray]]:
    """Each frame with the RGBA canvas on which it is shown; the canvas is drawn on by the next frame."""
    w, h = struct.unpack("<HH", gif[6:10])
    if w * h > MAX_PIXELS:
        raise ValueError("the canvas is too large")
    canvas = np.zeros((h, w, 4), "u1")
    for f in frames(gif):
        box = np.s_[f["top"] : f["top"] + f["height"], f["left"] : f["left"] + f["width"]]
        before = canvas.copy() if f["disposal"] == 3 else None
        part = canvas[box]
        px = f["indices"][: part.shape[0], : part.shape[1]]
        colours = f["palette"] if f["palette"] is not None else np.stack([np.arange(256)] * 3, 1).astype("u1")
        rgba = np.full((256, 4), 255, "u1")
        rgba[:, :3] = colours[np.minimum(np.arange(256), len(colours) - 1)]
        shown = rgba.view("u4")[:, 0][px].view("u1").reshape(*px.shape, 4)
        if f["transparent"] is None:
            part[:] = shown
        else:
            np.copyto(part, shown, where=(px != f["transparent"])[..., None])
        yield f, canvas
        if f["disposal"] == 2:
            canvas[box] = 0
        elif f["disposal"] == 3:
            canvas = before


def histogram(rgba: np.ndarray) -> list[int]:
    """Counts of visible pixels by the two upper bits of red, green and blue: 64 colours."""
    px = rgba.reshape(-1, 4)
    colour = px[:, 0] >> 2 & 48 | px[:, 1] >> 4 & 12 | px[:, 2] >> 6
    seen = px[:, 3] > 0
    return np.bincount(colour if seen.all() else colour[seen], minlength=64).tolist()


FRAMES = "array<struct<frame_no:int,start_cs:bigint,delay_cs:int,disposal:int,width:int,height:int,colours:array<bigint>>>"


def store_texts(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, media: each text as UTF-8, zero-padded and stored as a GIF."""

    def run(batches):
        for b in batches:
            raw = [(t or "").encode() for t in b["text"]]
            yield pd.DataFrame({"key": b["key"], "n_bytes": [len(x) for x in raw], "media": [encode(x + b"\0" * (-len(x) % 64 if x else 64)) for x in raw]})

    kind = df.schema[key].dataType.simpleString()
    return df.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInPandas(run, f"key {kind}, n_bytes bigint, media binary").withColumnRenamed("key", key)


def timed_frames(gif: bytes) -> Iterator[tuple[dict, np.ndarray]]:
    """Each frame's row of FRAMES and the canvas that it shows."""
    start = 0
    for k, (f, rgba) in enumerate(rendered(gif)):
        yield {"frame_no": k, "start_cs": start, "delay_cs": f["delay_cs"], "disposal": f["disposal"], "width": f["width"], "height": f["height"], "colours": histogram(rgba)}, rgba[f["top"] : f["top"] + f["height"], f["left"] : f["left"] + f["width"]]
        start += f["delay_cs"]


BROKEN = (ValueError, IndexError, struct.error, TypeError)


def decode_frames(df: DataFrame, media: str = "media") -> DataFrame:
    """df with ``frames``: the timed frames of each file with the colour histogram of the
    canvas that each shows; null for a null or broken file. A column of that name is replaced."""

    @F.pandas_udf(FRAMES)
    def run(col: pd.Series) -> pd.Series:
        def one(gif):
            try:
                return [row for row, _ in timed_frames(bytes(gif))]
            except BROKEN:
                return None

        return col.map(one)

    return df.withColumn("frames", run(df[media]))


RED, GREEN, BLUE = ((np.arange(256) // n << up).astype("u1") for n, up in ((36, 5), (36, 2), (85, 0)))


def payload_of(shown: np.ndarray) -> bytes:
    """The bytes whose colours of the cube a canvas shows."""
    return (RED[shown[..., 0]] | GREEN[shown[..., 1]] | BLUE[shown[..., 2]]).tobytes()


def read_payloads(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """The payload that each stored file shows, read back from its rendered frames as digests, with
    a feature: frames, hundredths of a second, and the colours' counts, colour:count. A file that is
    broken has nulls."""

    def one(gif) -> tuple:
        try:
            found = [(row, payload_of(shown)) for row, shown in timed_frames(bytes(gif))]
        except BROKEN:
            return None, None, None, None, None, None
        payload = b"".join(x for _, x in found)
        colours = np.sum([row["colours"] for row, _ in found], 0)
        feature = f"{len(found)}f{sum(row['delay_cs'] for row, _ in found)}cs:" + "-".join(f"{k}:{n}" for k, n in enumerate(colours.tolist()) if n)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(gif), hashlib.sha256(gif).hexdigest(), feature

    def run(batches):
        for b in batches:
            out = pd.DataFrame([one(gif) for gif in b["media"]], columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"], index=b.index)
            numbers = ["payload_bytes", "tail_crc32", "media_bytes"]
            yield pd.concat([b[["key", "n_bytes"]], out.astype(dict.fromkeys(numbers, "Int64"))], axis=1)

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return df.selectExpr(f"`{key}` AS key", "n_bytes", "media").mapInPandas(run, schema).withColumnRenamed("key", key)


def op2_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_payloads(store_texts(table(spark, sf_dir, "documents")))


QUERIES = {"op2_gif_media": op2_gif_media}
SQL: dict[str, str] = {}
