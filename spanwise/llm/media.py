"""Media columns: Netpbm and BMP bytes to arrays, area resizing, NPY tiles, difference hashes.

Decoding is plain numpy inside Arrow batches: an image is one row, so no shuffle is needed and a lost executor only
repeats its own partitions. Sums for the area resize come from an integral image, so a resize costs one pass over the
pixels whatever the target size. The integral image is summed in bands of rows, of which only the rows at cell edges are
kept, so memory beyond the image itself is a band and a few rows.

Defined results: null bytes, empty bytes and bytes that aren't a whole image (a sample out of range or of no such format
included) give null fields and the reason in ``error``; repeated rows give repeated results; an empty table gives no
rows; a very long text is one tall image, stored whole; means that lie between two values round half up; equal
brightness sets no bit of a difference hash; other columns pass through untouched, unless one has the name of a result,
which then replaces it.
"""

from __future__ import annotations

import functools
import hashlib
import io
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import bounded_batches

BLOCK = 576  # payload unit: one 24 x 24 tile of 8-bit samples
SIDE = 24
BAND = 1 << 18  # samples that are summed at a time: 2 MB


def decode(data: bytes) -> np.ndarray:
    """Height x width x channels, uint8 or uint16. Raises ValueError for anything that isn't a whole image."""
    if data[:2] == b"BM":
        return _decode_bmp(data)
    if len(data) > 2 and data[:1] == b"P" and data[1:2] in b"123456":
        return _decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def _header(data: bytes, n: int) -> tuple[list[int], int]:
    """The n numbers of a Netpbm header (comments skipped) and the offset just after the last."""
    found, at = [], 2
    while len(found) < n:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            at = at + 1 if data[at : at + 1] != b"#" else (data.find(b"\n", at) + 1 or len(data))
        start = at
        while at < len(data) and data[at : at + 1].isdigit():
            at += 1
        if start == at:
            raise ValueError("broken Netpbm header")
        found.append(int(data[start:at]))
    return found, at


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind = int(data[1:2])
    bitmap, plain, channels = kind in (1, 4), kind < 4, 3 if kind in (3, 6) else 1
    numbers, at = _header(data, 2 if bitmap else 3)
    width, height, top = numbers[0], numbers[1], 1 if bitmap else numbers[2]
    if not 0 < top < 65536 or not width * height:
        raise ValueError("broken Netpbm header")
    n = width * height * channels
    if plain:
        body = b"\n".join(line.split(b"#", 1)[0] for line in data[at:].split(b"\n"))
        if bitmap:
            digits = np.frombuffer(b"".join(body.split()), np.uint8)[:n]
            if not np.isin(digits, (48, 49)).all():
                raise ValueError("bitmap sample other than 0 and 1")
            samples = digits - 48
        else:
            samples = np.array(body.split()[:n], dtype=np.int64)
            if samples.min(initial=0) < 0:
                raise ValueError("negative sample")
    elif bitmap:
        row = (width + 7) // 8
        raw = np.frombuffer(data, np.uint8, offset=at + 1)
        if len(raw) < row * height:
            raise ValueError("too few samples")
        samples = np.unpackbits(raw[: row * height].reshape(height, row), axis=1)[:, :width].ravel()
    else:
        raw = np.frombuffer(data[at + 1 : at + 1 + n * (2 if top > 255 else 1)], ">u2" if top > 255 else np.uint8)
        samples = raw
    if len(samples) < n:
        raise ValueError("too few samples")
    if bitmap:  # 1 is black
        samples = (1 - samples.astype(np.uint8)) * 255
    if samples.max(initial=0) > (255 if bitmap else top):
        raise ValueError("sample above the maximum")
    return samples.astype(np.uint16 if top > 255 else np.uint8).reshape(height, width, channels)


def _decode_bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("broken BMP header")
    (start,) = struct.unpack_from("<I", data, 10)
    size, width, height, _, bits, packing, _, _, _, colours = struct.unpack_from("<IiiHHIIiiI", data, 14)
    if packing not in (0, 3) or bits not in (8, 24, 32) or packing and bits != 32 or width <= 0 or height == 0:
        raise ValueError("BMP kind not supported")
    row = (width * bits // 8 + 3) // 4 * 4
    raw = np.frombuffer(data, np.uint8, offset=min(start, len(data)))
    if len(raw) < row * abs(height):
        raise ValueError("too few samples")
    rows = raw[: row * abs(height)].reshape(abs(height), row)[:, : width * bits // 8]
    rows = rows if height < 0 else rows[::-1]  # stored from the bottom up, unless the height is negative
    if bits == 8:
        table = np.frombuffer(data, np.uint8, count=4 * (colours or 256), offset=14 + size).reshape(-1, 4)[:, 2::-1]
        if rows.max(initial=0) >= len(table):
            raise ValueError("colour outside the table")
        return table[rows]
    if packing:
        return _masked(rows, width, data)
    return np.ascontiguousarray(rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1])


def _masked(rows: np.ndarray, width: int, data: bytes) -> np.ndarray:
    """32-bit pixels by the three masks after the header: runs of up to 8 bits, stretched to 8 where they are shorter."""
    if len(data) < 66:
        raise ValueError("broken BMP header")
    pixels, out = np.ascontiguousarray(rows).view("<u4"), np.empty((len(rows), width, 3), np.uint8)
    for i, mask in enumerate(struct.unpack_from("<III", data, 54)):
        shift = (mask & -mask).bit_length() - 1
        top = mask >> max(0, shift)
        if not mask or top & top + 1 or top > 255:
            raise ValueError("BMP mask not supported")
        out[:, :, i] = ((pixels & np.uint32(mask)) >> np.uint32(shift)).astype(np.uint32) * 255 // top
    return out


@functools.lru_cache(4096)
def _cells(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """For the edges of ``size`` equal cells of 0..n: the whole numbers around them, where among these each edge's lower and
    upper neighbour stand, and how far it is from the lower one (None where every edge is a whole number)."""
    edges = np.arange(size + 1) * n / size
    low = np.minimum(edges.astype(np.int64), n - 1)
    part = edges - low
    if ((part == 0) | (part == 1)).all():
        low, part = edges.astype(np.int64), None
    needed = np.unique(low if part is None else np.append(low, low + 1))
    return needed, np.searchsorted(needed, low), np.searchsorted(needed, low + 1), part


def _at_edges(sums: np.ndarray, low: np.ndarray, high: np.ndarray, part: np.ndarray | None, axis: int) -> np.ndarray:
    lower = sums.take(low, axis)
    if part is None:
        return lower
    part = part[:, None, None] if axis == 0 else part[None, :, None]
    return lower * (1 - part) + sums.take(high, axis) * part


def area_resize(image: np.ndarray, height: int, width: int, grey: bool = False) -> np.ndarray:
    """Mean over each target cell's (fractional) area, from an integral image; rounds half up. ``grey`` takes the mean of
    the channels, rounded down, first. A mean within 1e-9 of a half counts as the half.

    The integral image is built in bands of rows; of each band only those rows stay between which a cell's edge lies.
    """
    h, w, channels = image.shape
    needed, low, high, part = _cells(h, height)
    kept, above = np.zeros((len(needed), w, 1 if grey else channels)), None
    band = max(1, BAND // (w * channels))
    for start in range(0, h, band):
        block = image[start : start + band]
        if grey and channels > 1:
            block = np.floor(block.mean(axis=2, keepdims=True))
        sums = np.cumsum(block, axis=0, dtype=np.float64)
        if above is not None:
            sums += above
        first, last = needed.searchsorted((start + 1, start + len(block) + 1))
        kept[first:last] = sums[needed[first:last] - (start + 1)]
        above = sums[-1]
    rows = _at_edges(kept, low, high, part, 0)
    across = np.zeros((height + 1, w + 1, kept.shape[2]))
    np.cumsum(rows, axis=1, out=across[:, 1:])
    needed, low, high, part = _cells(w, width)
    cells = _at_edges(across, needed[low], needed[high] if part is not None else low, part, 1)
    sums = np.diff(np.diff(cells, axis=0), axis=1)
    return np.floor(sums / (h / height * w / width) + 0.5 + 1e-9).clip(0, np.iinfo(image.dtype).max).astype(image.dtype)


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether brightness grows from each cell of an 8 x 9 grid to its right neighbour."""
    grid = area_resize(image, 8, 9, grey=True)[:, :, 0].astype(np.int64)
    return np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes().hex()


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def encode_pgm(samples: np.ndarray) -> bytes:
    """Binary grey map of 8-bit samples."""
    height, width = samples.shape[:2]
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(samples, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit BMP, bottom up."""
    height, width, _ = pixels.shape
    row = (width * 3 + 3) // 4 * 4
    body = np.zeros((height, row), np.uint8)
    body[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, -1)
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + body.size, 0, 54, 40, width, height, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


TILES = "height int, width int, channels int, tile binary, dhash string, error string"


def decode_tiles(df: DataFrame, column: str = "image", side: int = SIDE) -> DataFrame:
    """Adds the decoded image's shape, its ``side`` x ``side`` NPY tile and its difference hash to each row."""

    @F.pandas_udf(TILES)
    def tiles(images: pd.Series) -> pd.DataFrame:
        rows = []
        for data in images:
            try:
                image = decode(b"" if data is None else bytes(data))
                rows.append((*image.shape, npy_bytes(area_resize(image, side, side)), difference_hash(image), None))
            except (ValueError, OverflowError, struct.error) as e:
                rows.append((None, None, None, None, None, str(e)))
        out = pd.DataFrame(rows, columns=["height", "width", "channels", "tile", "dhash", "error"])
        return out.astype({"height": "Int32", "width": "Int32", "channels": "Int32"})

    names = ["height", "width", "channels", "tile", "dhash", "error"]
    kept = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return bounded_batches(df).select(*kept, tiles(F.col(f"`{column}`")).alias("__t")).select(*kept, *[F.col(f"__t.{n}").alias(n) for n in names])


def write_tiles(df: DataFrame, path: str) -> None:
    """Tiles as a table of NPY bytes: one splittable Parquet data set in place of a file for each image."""
    df.where("tile is not null").select("dhash", "height", "width", "channels", "tile").write.mode("overwrite").parquet(path)


def padded(data: bytes) -> bytes:
    return data.ljust(max(1, -(-len(data) // BLOCK)) * BLOCK, b"\xff")


STORED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(text: Column) -> Column:
    """Stores each text as a 24-wide grey map, reads the stored bytes back and describes both.

    Null counts as the empty text, which gives one block of bytes 255. The feature is the difference hash of the image
    that was read back, then the CRC of its NPY tile.
    """

    @F.pandas_udf(STORED)
    def stored(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            data = b"" if t is None else t.encode("utf-8")
            n = len(data)
            media = encode_pgm(np.frombuffer(padded(data), np.uint8).reshape(-1, SIDE))
            image = decode(media)
            payload = memoryview(np.ascontiguousarray(image)).cast("B")
            tile = npy_bytes(area_resize(image, SIDE, SIDE))
            feature = f"{difference_hash(image)}:{zlib.crc32(tile):08x}"
            rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in STORED.split(", ")])

    return stored(text)


def media_digests(docs: DataFrame) -> DataFrame:
    return bounded_batches(docs).select("doc_id", text_media(F.col("text")).alias("m")).select("doc_id", "m.*")
