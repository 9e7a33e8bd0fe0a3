"""GIF media columns: LZW code streams, palettes, disposal, transparency and timed frames with colour histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import documents, small_batches, tidy

#: Payload bytes are rows of this many pixels, and a frame has at most so many rows.
WIDTH, FRAME_ROWS = 64, 4096


def _pack(codes: list[int], widths: list[int]) -> bytes:
    """Codes of the given bit widths, least significant bit first."""
    import numpy as np

    c, w = np.array(codes, np.int64), np.array(widths, np.int64)
    at = np.concatenate([[0], np.cumsum(w)[:-1]])
    bits = np.zeros(int(w.sum()), np.uint8)
    for k in range(int(w.max())):
        has = w > k
        bits[at[has] + k] = c[has] >> k & 1
    return np.packbits(bits, bitorder="little").tobytes()


def lzw_encode(data: bytes, min_size: int = 8) -> bytes:
    """A GIF code stream: clear code, codes that grow to 12 bits, a clear code whenever the table is full, end code."""
    clear = 1 << min_size
    codes, runs, since = [clear], [], 1  # codes of each run between two clear codes; their widths follow from the place in the run
    table: dict[int, int] = {}
    find, put = table.get, codes.append
    new = clear + 2
    rest = iter(data)
    prefix = next(rest, -1)
    for b in rest:
        key = prefix << 8 | b
        known = find(key)
        if known:
            prefix = known
            continue
        put(prefix)
        prefix = b
        if new < 4096:
            table[key] = new
            new += 1
        else:
            put(clear)
            runs.append(len(codes) - since)
            since = len(codes)
            table.clear()
            new = clear + 2
    if prefix >= 0:
        put(prefix)
    put(clear + 1)
    runs.append(len(codes) - since)
    widths = [min_size + 1]
    for n in runs:
        widths.extend(_widths(n, min_size))
    return _pack(codes, widths)


_width_lists: dict[int, list[int]] = {}


def _widths(n: int, min_size: int) -> list[int]:
    """Widths of the codes after a clear code: the k-th (from 0) is read when k - 1 entries have been added."""
    full = _width_lists.get(min_size)
    if full is None:
        first = (1 << min_size) + 2
        full = _width_lists[min_size] = [min(12, max(min_size + 1, (first + max(0, k - 1)).bit_length())) for k in range(4098 - first)]
    return full[:n] if n <= len(full) else full + [12] * (n - len(full))


def lzw_decode(stream: bytes, min_size: int, n_pixels: int) -> bytes:
    """The indexes of a GIF code stream, n_pixels at most.

    Between two clear codes the width of each code follows from its place, so a run's codes are unpacked at once; an entry is the output of
    its first code and one index more, so it is copied from the output itself. A damaged stream ends where it stops making sense."""
    import numpy as np

    clear, end = 1 << min_size, (1 << min_size) + 1
    bits = np.unpackbits(np.frombuffer(stream, np.uint8), bitorder="little")
    total, at, out = len(bits), 0, bytearray()
    base = clear + 2
    done = False
    while not done and at + min_size + 1 <= total:
        codes: list[int] = []
        k, width = 0, min_size + 1
        while at + width <= total:  # one stretch of codes of equal width after the other
            first_wider = (1 << width) - base + 1 if width < 12 else None  # the k at which a code needs one bit more
            n = (total - at) // width if first_wider is None else min(first_wider - k, (total - at) // width)
            if n <= 0:
                break
            some = bits[at : at + n * width].reshape(n, width).astype(np.int64) @ (1 << np.arange(width))
            stop = np.flatnonzero((some == clear) | (some == end))
            if len(stop):
                s = int(stop[0])
                codes.extend(some[:s].tolist())
                at += (s + 1) * width
                done = int(some[s]) == end
                break
            codes.extend(some.tolist())
            at, k = at + n * width, k + n
            if first_wider is not None and k >= first_wider:
                width += 1
        else:
            done = True
        starts: list[int] = []
        mark = starts.append
        for code in codes:
            here = len(out)
            if code < clear:
                mark(here)
                out.append(code)
                continue
            j = code - base
            if j < 0 or j >= len(starts) or not starts:
                done = True
                break
            a = starts[j]
            b = (starts[j + 1] if j + 1 < len(starts) else here) + 1
            mark(here)
            if b <= here:
                out += out[a:b]
            else:  # the entry that this very code completes
                out += out[a:here]
                out.append(out[a])
        if len(out) >= n_pixels:
            break
    return bytes(out[:n_pixels])


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(x)]) + x for x in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


GREY = bytes(x for i in range(256) for x in (i, i, i))


def encode_gif(payload: bytes, width: int = WIDTH, rows: int = FRAME_ROWS, delay: int = 4) -> bytes:
    """Bytes as the grey levels of an animation: one pixel a byte, frames of at most `rows` rows, all the bytes. payload fills whole rows."""
    size = width * rows
    frames = [payload[i : i + size] for i in range(0, len(payload), size)]
    height = max((len(x) // width for x in frames), default=0)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), GREY]
    for frame in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, delay, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(frame) // width, 0) + b"\x08" + _blocks(lzw_encode(frame)))
    return b"".join(out) + b"\x3b"


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and (n := data[at]):
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def decode_gif(data: bytes) -> list[dict]:
    """Frames of a GIF: start and delay in hundredths of a second, place, disposal, transparent index, `indexes` (height x width) and `canvas`, the RGBA
    screen when the frame shows. Interlaced rows are put in order; local palettes go before the global one. Empty or foreign data give no frame."""
    import numpy as np

    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        return []
    width, height, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    at, palette = 13, None
    colours = lambda a, n: np.frombuffer(data[a : a + 3 * n].ljust(3 * n, b"\0"), np.uint8).reshape(-1, 3)
    if flags & 0x80:
        n = 2 << (flags & 7)
        palette, at = colours(at, n), at + 3 * n
    canvas = np.zeros((height, width, 4), np.uint8)
    frames, clock = [], 0
    disposal, delay, transparent = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            block, at = _sub_blocks(data, at + 2)
            if label == 0xF9 and len(block) >= 4:
                packed, delay, index = struct.unpack("<BHB", block[:4])
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
            continue
        if data[at] != 0x2C or at + 10 > len(data):
            break
        left, top, w, h, packed = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        own = palette
        if packed & 0x80:
            n = 2 << (packed & 7)
            own, at = colours(at, n), at + 3 * n
        min_size = data[at]
        stream, at = _sub_blocks(data, at + 1)
        flat = np.frombuffer(lzw_decode(stream, min_size, w * h).ljust(w * h, b"\0"), np.uint8)
        indexes = flat.reshape(h, w)
        if packed & 0x40:
            order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(indexes)
            straight[order] = indexes
            indexes = straight
        lookup = np.full((256, 4), (0, 0, 0, 255), np.uint8)
        if own is not None:
            lookup[: len(own), :3] = own
        before = canvas.copy() if disposal == 3 else None
        y1, x1 = min(height, top + h), min(width, left + w)
        shown = indexes[: max(0, y1 - top), : max(0, x1 - left)]
        region = canvas[top:y1, left:x1]
        if transparent is None:
            region[:] = lookup[shown]
        else:
            seen = shown != transparent
            region[seen] = lookup[shown[seen]]
        frames.append({"start": clock, "delay": delay, "left": left, "top": top, "width": w, "height": h, "disposal": disposal, "transparent": transparent, "indexes": indexes, "canvas": canvas.copy()})
        if disposal == 2:
            region[:] = 0
        elif disposal == 3:
            canvas = before
        clock += delay
        disposal, delay, transparent = 0, 0, None
    return frames


def colour_histogram(canvas, bins: int = 8) -> list[int]:
    """Pixels of each brightness bin of red, then green, then blue, over what isn't transparent."""
    import numpy as np

    seen = canvas.reshape(-1, 4)
    if not seen[:, 3].all():
        seen = seen[seen[:, 3] > 0]
    levels = np.arange(256) * bins // 256
    return [int(x) for c in range(3) for x in np.bincount(levels, np.bincount(seen[:, c], minlength=256), bins)]


FRAME_SCHEMA = "frame int, start_cs int, delay_cs int, left int, top int, width int, height int, disposal int, transparent int, rgba binary, histogram array<long>"


def decode_frames(media: DataFrame, key: str, column: str) -> DataFrame:
    """A row a frame of each GIF in a binary column: its time, place, screen in RGBA and colour histogram.

    A null, empty or damaged value gives the frames that can be read, or none. Other columns are left out."""
    small_batches(media.sparkSession)
    kind = media.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                for n, f in enumerate(decode_gif(data or b"")):
                    values = {"frame": n, "start_cs": f["start"], "delay_cs": f["delay"], "left": f["left"], "top": f["top"], "width": f["width"], "height": f["height"], "disposal": f["disposal"], "transparent": f["transparent"], "rgba": f["canvas"].tobytes(), "histogram": colour_histogram(f["canvas"])}
                    types = [*[pa.int32()] * 9, pa.binary(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array([v], t) for v, t in zip(values.values(), types))], names=[key, *values])

    return media.select(key, column).mapInArrow(tidy(run), f"{key} {kind}, {FRAME_SCHEMA}")


def media_digests(docs: DataFrame) -> DataFrame:
    """Each text as a grey animation, read back: lengths, checksums and a feature string of frames, time and histogram.

    A null text is empty, and an empty one is 64 zero bytes. Rows that repeat give equal rows; other columns are left out."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch["doc_id"].to_pylist(), batch["raw"].to_pylist()):
                raw = raw or b""
                media = encode_gif(raw + b"\0" * (-len(raw) % WIDTH or (0 if raw else WIDTH)))
                read, counts, clock, n = [], np.zeros(24, np.int64), 0, 0
                for f in decode_gif(media):
                    screen = f["canvas"][: f["height"]]
                    read.append(screen[:, :, 0].tobytes())
                    counts += colour_histogram(screen)
                    clock, n = f["start"] + f["delay"], n + 1
                payload = b"".join(read)
                share = ",".join(f"{x / len(payload):.4f}" for x in counts[:8])
                rows.append((doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"frames={n};cs={clock};grey={share}"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 8, types)], names=names)

    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("raw"))
    return raw.mapInArrow(tidy(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(documents(spark, sf_dir))
