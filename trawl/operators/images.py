"""Image rows: exact and near duplicates by stored hashes, perceptual hashes of pixels, colours, containers and EXIF.

What works on stored columns is expressions and aggregates; pixels and file bytes go through Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from math import cos, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_groups(rows: DataFrame, digest: str, doc: str) -> DataFrame:
    """digest, first_doc, n of digests that two or more documents have; null and all-zero digests are none."""
    own = rows.filter(F.col(digest).isNotNull() & ~F.col(digest).rlike("^0*$"))
    return own.groupBy(F.col(digest).alias("digest")).agg(F.min(doc).alias("first_doc"), F.count("*").alias("n")).filter("n > 1")


def duplicate_bytes(rows: DataFrame, digest: str, doc: str, size: Column) -> DataFrame:
    """One row: bytes of all but the first document of each digest."""
    each = rows.filter(F.col(digest).isNotNull()).groupBy(digest).agg(F.sum(size).alias("all"), F.min_by(size, F.col(doc)).alias("first"))
    return each.agg(F.coalesce(F.sum(F.col("all") - F.col("first")), F.lit(0)).alias("redundant_bytes"))


def hash_near(rows: DataFrame, hash_col: str, doc: str, probe: int, most: int) -> DataFrame:
    """doc_id, distance of rows whose 64-bit hash is within `most` bits of the probe, nearest first."""
    distance = F.bit_count(F.col(hash_col).bitwiseXOR(F.lit(probe)))
    return rows.select(F.col(doc).alias("doc_id"), distance.alias("distance")).filter(F.col("distance") <= most).orderBy("distance", "doc_id")


# pixels: (h, w, 3) arrays of bytes


def luma(rgb: np.ndarray) -> np.ndarray:
    return rgb.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def box_scale(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    """Mean of the area that each cell covers, edges counted by their share."""

    def shares(n: int, to: int) -> np.ndarray:
        edges = np.arange(to + 1) * n / to
        at = np.arange(n)
        return np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None) * to / n

    return shares(gray.shape[0], height) @ gray @ shares(gray.shape[1], width).T


def dct(values: np.ndarray) -> np.ndarray:
    n = len(values)
    basis = np.array([[cos(pi * (2 * x + 1) * u / (2 * n)) for x in range(n)] for u in range(n)]) * sqrt(2 / n)
    basis[0] /= sqrt(2)
    return basis @ values @ basis.T


def _bits(flags: np.ndarray) -> int:
    out = sum(1 << i for i, x in enumerate(flags.ravel()) if x)
    return out - (1 << 64) if flags.size <= 64 and out >> 63 else out


def ahash(rgb: np.ndarray) -> int:
    cells = box_scale(luma(rgb), 8, 8)
    return _bits(cells > cells.mean() + 1e-9)


def dhash(rgb: np.ndarray) -> int:
    cells = box_scale(luma(rgb), 9, 8)
    return _bits(cells[:, :-1] > cells[:, 1:] + 1e-9)


def phash(rgb: np.ndarray) -> int:
    """Of the 8 x 8 low frequencies of a 32 x 32 DCT without the mean, which are over their median; a flat picture is 0."""
    cells = box_scale(luma(rgb), 32, 32)
    if np.ptp(cells) < 1e-6:
        return 0
    low = dct(cells)[:8, :8].copy()
    middle = np.median(low.ravel()[1:])
    flags = low > middle + 1e-6  # frequencies that a picture lacks are rounding noise about 0
    flags[0, 0] = False
    return _bits(flags)


def pdq(rgb: np.ndarray) -> list[int]:
    """256 bits as four longs, from frequencies 1 to 16 of a 64 x 64 DCT."""
    cells = box_scale(luma(rgb), 64, 64)
    if np.ptp(cells) < 1e-6:
        return [0] * 4
    low = dct(cells)[1:17, 1:17]
    flags = (low > np.median(low) + 1e-6).ravel()
    return [_bits(flags[i * 64 : (i + 1) * 64]) for i in range(4)]


def hashes(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The id, ahash, dhash, phash, pdq of rows with pixels (binary, 3 bytes each), width and height; bad sizes give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for data, w, h in zip(*(batch.column(c).to_pylist() for c in ("pixels", "width", "height")), strict=True):
                if not data or not w or not h or len(data) != 3 * w * h:
                    out.append((None,) * 4)
                    continue
                rgb = np.frombuffer(data, np.uint8).reshape(h, w, 3)
                out.append((ahash(rgb), dhash(rgb), phash(rgb), pdq(rgb)))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.int64()))], names=["id", "ahash", "dhash", "phash", "pdq"])

    read = rows.select(F.col(id_col).cast("long").alias("id"), "pixels", "width", "height")
    return read.mapInArrow(run, "id long, ahash long, dhash long, phash long, pdq array<long>").withColumnRenamed("id", id_col)


# colours, as column expressions

#: Linear light to cone response, and that to OKLab.
TO_CONE = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
#: Chroma under which a colour is neutral, cuts of lightness and chroma, and the degrees at which the first hue begins.
NEUTRAL, NEUTRAL_CUTS, LIGHT_CUTS, VIVID, HUES, FIRST_HUE = 0.04, (0.20, 0.40, 0.62, 0.85), (0.45, 0.72), 0.12, 12, 15.0
#: Names of neutral bands, lightness, chroma and hues.
NEUTRAL_NAMES = ("black", "dark-grey", "grey", "light-grey", "white")
LIGHT_NAMES, CHROMA_NAMES = ("dark", "mid", "light"), ("muted", "vivid")
HUE_NAMES = ("red", "orange", "amber", "yellow", "green", "teal", "cyan", "azure", "blue", "violet", "magenta", "pink")


def linear(channel: Column) -> Column:
    v = channel / F.lit(255.0)
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    light = [linear(c) for c in (r, g, b)]
    cone = [F.cbrt(sum((k * c for k, c in zip(row, light, strict=True)), F.lit(0.0))) for row in TO_CONE]
    a, b_, c = (sum((k * x for k, x in zip(row, cone, strict=True)), F.lit(0.0)) for row in TO_LAB)
    return a, b_, c


def _times(rows, values: list[Column]) -> list[Column]:
    return [sum((float(k) * x for k, x in zip(row, values, strict=True)), F.lit(0.0)) for row in rows]


def oklab_to_srgb(lightness: Column, a: Column, b: Column) -> tuple[Column, ...]:
    """The way back to bytes: the inverse matrices, cubes between them; what lies outside the gamut is clipped."""
    cone = [x * x * x for x in _times(np.linalg.inv(np.array(TO_LAB)), [lightness, a, b])]
    light = _times(np.linalg.inv(np.array(TO_CONE)), cone)
    coded = (F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055) for x in light)
    return tuple(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 255).cast("int") for c in coded)


def oklch(lightness: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Lightness, chroma and hue in degrees from 0 to under 360."""
    return lightness, F.sqrt(a * a + b * b), F.pmod(F.degrees(F.atan2(b, a)) + 360.0, F.lit(360.0))


def _band(value: Column, cuts: tuple[float, ...]) -> Column:
    return sum(((value >= c).cast("int") for c in cuts), F.lit(0))


def colour_bucket(lightness: Column, a: Column, b: Column) -> Column:
    """0 to 4: neutral by lightness; 5 to 76: three bands of lightness, two of chroma, twelve hues. NaN is black."""
    _, chroma, hue = oklch(lightness, a, b)
    sane = ~F.isnan(chroma) & ~F.isnan(lightness) & (chroma >= NEUTRAL)
    sector = F.least(F.floor(F.pmod(hue + (360.0 - FIRST_HUE), F.lit(360.0)) / (360.0 / HUES)), F.lit(HUES - 1))
    coloured = len(NEUTRAL_NAMES) + (_band(lightness, LIGHT_CUTS) * len(CHROMA_NAMES) + _band(chroma, (VIVID,))) * HUES + sector
    return F.when(sane, coloured).otherwise(F.when(F.isnan(lightness), 0).otherwise(_band(lightness, NEUTRAL_CUTS))).cast("int")


def bucket_name(bucket: Column) -> Column:
    """col:grey, col:blue-mid-vivid and so on; null for what is no bucket."""
    names = [*NEUTRAL_NAMES, *(f"{h}-{light}-{c}" for light in LIGHT_NAMES for c in CHROMA_NAMES for h in HUE_NAMES)]
    return F.concat(F.lit("col:"), F.get(F.array(*map(F.lit, names)), bucket))


def palette_terms(rows: DataFrame, id_col: str, palette_col: str) -> DataFrame:
    """The id, term and weight of each colour bucket of a palette (array of l, a, b, weight); equal buckets add up."""
    each = rows.select(F.col(id_col), F.explode(palette_col).alias("c"))
    term = bucket_name(colour_bucket(F.col("c.l"), F.col("c.a"), F.col("c.b")))
    return each.select(id_col, term.alias("term"), F.col("c.weight").alias("weight")).groupBy(id_col, "term").agg(F.round(F.sum("weight"), 9).alias("weight"))


def palette_distance(x: Column, y: Column) -> Column:
    """Mean of both directions of: each colour's distance to the nearest of the other palette, by its weight.

    Two empty palettes are 0 apart, an empty one is infinitely far from others.
    """

    def apart(s: Column, t: Column) -> Column:
        return F.sqrt((s["l"] - t["l"]) * (s["l"] - t["l"]) + (s["a"] - t["a"]) * (s["a"] - t["a"]) + (s["b"] - t["b"]) * (s["b"] - t["b"]))

    def directed(frm: Column, to: Column) -> Column:
        return F.aggregate(F.transform(frm, lambda s: s["weight"] * F.array_min(F.transform(to, lambda t: apart(s, t)))), F.lit(0.0), lambda n, v: n + v)

    none, other = F.size(x) == 0, F.size(y) == 0
    return F.when(none & other, 0.0).when(none | other, F.lit(float("inf"))).otherwise((directed(x, y) + directed(y, x)) / 2)


def palette(rgb: np.ndarray, k: int = 6, rounds: int = 32) -> list[tuple[float, float, float, float]]:
    """Up to k colours (OKLab) with their share: k-means from farthest points, over at most 64 x 64 samples."""
    step = max(1, -(-max(rgb.shape[:2]) // 64))
    px = rgb[::step, ::step].reshape(-1, 3) / 255
    lin = np.where(px <= 0.04045, px / 12.92, ((px + 0.055) / 1.055) ** 2.4)
    lab = np.cbrt(lin @ np.array(TO_CONE).T) @ np.array(TO_LAB).T
    centres = [lab.mean(0)]
    centres = [lab[((lab - centres[0]) ** 2).sum(1).argmin()]]
    while len(centres) < k:
        far = np.min([((lab - c) ** 2).sum(1) for c in centres], axis=0)
        if far.max() < 1e-6:
            break
        centres.append(lab[far.argmax()])
    centre = np.array(centres)
    for _ in range(rounds):
        own = ((lab[:, None] - centre[None]) ** 2).sum(2).argmin(1)
        new = np.array([lab[own == i].mean(0) if (own == i).any() else centre[i] for i in range(len(centre))])
        if np.allclose(new, centre, atol=1e-9):
            break
        centre = new
    share = np.bincount(own, minlength=len(centre)) / len(own)
    order = np.lexsort((np.arange(len(centre)), -share))
    return [(*map(float, centre[i]), float(share[i])) for i in order if share[i] > 0]


# files


def container(content: Column) -> Column:
    """jpeg, png, gif, webp, heif, tiff, bmp or unknown, by the first bytes."""
    lead = F.hex(F.substring(content, 1, 12))
    return (
        F.when(lead.startswith("FFD8FF"), "jpeg")
        .when(lead.startswith("89504E470D0A1A0A"), "png")
        .when(lead.rlike("^474946383[79]61"), "gif")
        .when(lead.rlike("^52494646.{8}57454250"), "webp")
        .when(lead.rlike("^.{8}66747970(68656963|68656978|6D696631|61766966|68657663)"), "heif")
        .when(lead.rlike("^(49492A00|4D4D002A)"), "tiff")
        .when(lead.startswith("424D"), "bmp")
        .otherwise("unknown")
    )


def size_of(data: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG, GIF, WebP, JPEG or HEIF file, None if the header doesn't say."""
    if data[4:8] == b"ftyp":
        return next((struct.unpack(">II", body[4:12]) for kind, body in boxes(data) if kind == b"ispe" and len(body) >= 12), None)
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:4] == b"GIF8" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        kind = data[12:16]
        if kind == b"VP8X":
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if kind == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        w, h = struct.unpack("<HH", data[26:30])
        return w & 0x3FFF, h & 0x3FFF
    if data[:2] == b"\xff\xd8":
        for marker, body in jpeg_segments(data):
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
                h, w = struct.unpack(">HH", body[1:5])
                return w, h
    return None


def boxes(data: bytes, deep: tuple[bytes, ...] = (b"meta", b"iprp", b"ipco"), depth: int = 8) -> Iterator[tuple[bytes, bytes]]:
    """Kind and body of the boxes of an ISO media file, with those inside `deep` ones, in order. A bad size ends a list."""
    at = 0
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        head = 8
        if size == 1 and at + 16 <= len(data):
            head, size = 16, struct.unpack(">Q", data[at + 8 : at + 16])[0]
        elif size == 0:
            size = len(data) - at
        if size < head or at + size > len(data):
            return
        body = data[at + head : at + size]
        yield kind, body
        if kind in deep and depth:
            yield from boxes(body[4:] if kind == b"meta" else body, deep, depth - 1)
        at += size


def quantisation_tables(data: bytes) -> list[tuple[int, int, list[int]]]:
    """Destination, precision (0 or 1) and the 64 values of each quantisation table of a JPEG; eight at most."""
    out: list[tuple[int, int, list[int]]] = []
    for marker, body in jpeg_segments(data) if data[:2] == b"\xff\xd8" else ():
        at = 0
        while marker == 0xDB and at < len(body):
            precision, to, size = body[at] >> 4, body[at] & 15, 64 * (1 + (body[at] >> 4))
            if precision > 1 or to > 3 or at + 1 + size > len(body):
                break
            out.append((to, precision, np.frombuffer(body, ">u2" if precision else "u1", 64, at + 1).tolist()))
            at += 1 + size
    return out[:8]


def table_fingerprint(tables: list[tuple[int, int, list[int]]]) -> int | None:
    """64-bit FNV-1a over the tables in order (destination, precision, values as two bytes); None without any."""
    h = 0xCBF29CE484222325
    for to, precision, values in tables:
        for byte in bytes([to, precision]) + np.array(values, ">u2").tobytes():
            h = (h ^ byte) * 0x100000001B3 % (1 << 64)
    return (h - (1 << 64) if h >> 63 else h) if tables else None


def tiff_block(data: bytes) -> bytes | None:
    """The EXIF block of a JPEG (APP1), PNG (eXIf chunk) or WebP (EXIF chunk), or a TIFF file itself."""
    found = None
    if data[:2] == b"\xff\xd8":
        found = next((b[6:] for m, b in jpeg_segments(data) if m == 0xE1 and b[:6] == b"Exif\0\0"), None)
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while found is None and at + 8 <= len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            found = data[at + 8 : at + 8 + size] if kind == b"eXIf" else None
            at += 12 + size
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        at = 12
        while found is None and at + 8 <= len(data):
            kind, size = struct.unpack("<4sI", data[at : at + 8])
            found = data[at + 8 : at + 8 + size].removeprefix(b"Exif\0\0") if kind == b"EXIF" else None
            at += 8 + size + size % 2
    else:
        found = data
    return found if found and found[:4] in (b"II*\0", b"MM\0*") else None


def jpeg_segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Marker and body of each segment before the scan."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xDA:
            return
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + size


#: EXIF tags that become columns.
TAGS = {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x0132: "taken", 0x9003: "taken", 0xA434: "lens", 0x829A: "exposure", 0x829D: "fnumber", 0x8827: "iso", 0x920A: "focal"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def exif(data: bytes) -> dict[str, object]:
    """Tags of a file's EXIF block: make, model, lens, orientation, taken, year, month, day, exposure, fnumber, iso, focal,
    lat, lon, altitude, and the bytes of a thumbnail.
    """
    block = tiff_block(data)
    out: dict[str, object] = {}
    if not block:
        return out
    e = "<" if block[:2] == b"II" else ">"

    def values(at: int) -> tuple[int, list]:
        tag, kind, n = struct.unpack(e + "HHI", block[at : at + 8])
        size = SIZES.get(kind, 1) * n
        start = at + 8 if size <= 4 else struct.unpack(e + "I", block[at + 8 : at + 12])[0]
        raw = block[start : start + size]
        if len(raw) < size:
            return tag, []
        if kind == 2:
            return tag, [raw.split(b"\0")[0].decode("utf-8", "replace").strip()]
        if kind in (5, 10):
            pairs = struct.unpack(e + ("I" if kind == 5 else "i") * 2 * n, raw)
            return tag, [a / b if b else None for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
        return tag, list(struct.unpack(e + {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}.get(kind, "B") * n, raw))

    def directory(at: int, seen: set[int]) -> dict[int, list]:
        if at in seen or at + 2 > len(block):
            return {}
        seen.add(at)
        (n,) = struct.unpack(e + "H", block[at : at + 2])
        return dict(values(at + 2 + 12 * i) for i in range(n) if at + 14 + 12 * i <= len(block))

    seen: set[int] = set()
    start = struct.unpack(e + "I", block[4:8])[0]
    main = directory(start, seen)
    if start + 2 <= len(block):  # the second directory is the thumbnail's
        after = start + 2 + 12 * struct.unpack(e + "H", block[start : start + 2])[0]
        thumb = directory(struct.unpack(e + "I", block[after : after + 4])[0], seen) if after + 4 <= len(block) and any(block[after : after + 4]) else {}
        if thumb.get(0x0201) and thumb.get(0x0202) and thumb[0x0201][0] + thumb[0x0202][0] <= len(block):
            out["thumbnail"] = block[thumb[0x0201][0] : thumb[0x0201][0] + thumb[0x0202][0]]
    more = directory(main[0x8769][0], seen) if main.get(0x8769) else {}
    gps = directory(main[0x8825][0], seen) if main.get(0x8825) else {}
    for tag, got in (main | more).items():
        if tag in TAGS and got and got[0] is not None:
            out[TAGS[tag]] = got[0]
    if isinstance(out.get("taken"), str) and len(out["taken"]) >= 10:
        date = out["taken"][:10].replace("-", ":").split(":")
        if len(date) == 3 and all(x.isdigit() for x in date) and 1826 <= int(date[0]) <= 2200 and 1 <= int(date[1]) <= 12 and 1 <= int(date[2]) <= 31:
            out |= dict(zip(("year", "month", "day"), map(int, date), strict=True))
    for name, ref, tag, minus in (("lat", 1, 2, "S"), ("lon", 3, 4, "W")):
        if len(gps.get(tag, [])) == 3 and None not in gps[tag]:
            d, m, s = gps[tag]
            out[name] = (d + m / 60 + s / 3600) * (-1 if (gps.get(ref) or [""])[0] == minus else 1)
    if gps.get(6) and gps[6][0] is not None:
        out["altitude"] = gps[6][0] * (-1 if (gps.get(5) or [0])[0] == 1 else 1)
    return out


PROBED = "path string, container string, bytes long, sha256 string, width int, height int, make string, model string, lens string, orientation int, taken string, year int, month int, day int, exposure double, fnumber double, iso int, focal double, lat double, lon double, altitude double, quantisation long, thumbnail binary"


def probe(files: DataFrame) -> DataFrame:
    """One row for each row of a binaryFile frame (path, content): container, size, digest, dimensions and EXIF columns."""
    names = [x.split()[0] for x in PROBED.split(", ")][4:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "long": pa.int64(), "binary": pa.binary()}
        cast = {pa.string(): str, pa.int32(): int, pa.int64(): int, pa.float64(): float, pa.binary(): bytes}
        types = {x.split()[0]: kinds[x.split()[1]] for x in PROBED.split(", ")[4:]}
        for batch in batches:
            rows = []
            for data in batch.column("content").to_pylist():
                size = size_of(data or b"") or (None, None)
                rows.append({"width": size[0], "height": size[1], "quantisation": table_fingerprint(quantisation_tables(data or b""))} | exif(data or b""))
            made = [pa.array([None if (v := r.get(n)) is None else cast[types[n]](v) for r in rows], types[n]) for n in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "container", "bytes", "sha256")), *made], names=["path", "container", "bytes", "sha256", *names])

    read = files.select("path", container(F.col("content")).alias("container"), F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")
    return read.mapInArrow(run, PROBED)


def exif_terms(probed: DataFrame) -> DataFrame:
    """path, field, value: the words by which pictures are filtered (make, model, camera, lens, date); absent ones have no row.

    A camera is its model if that begins with the maker's first word, else both.
    """
    make, model = F.trim("make"), F.trim("model")
    brand = F.lower(F.split(make, r"\s+")[0])
    camera = F.when((brand != "") & F.lower(model).startswith(brand), model).otherwise(F.concat_ws(" ", make, model))
    date = F.format_string("%04d-%02d-%02d", "year", "month", "day")
    fields = {"make": make, "model": model, "camera": F.when(make.isNotNull() & model.isNotNull(), camera), "lens": F.trim("lens"), "date": F.when(F.col("year").isNotNull(), date)}
    rows = F.array(*(F.struct(F.lit(f"exif.{k}").alias("field"), v.alias("value")) for k, v in fields.items()))
    return probed.select("path", F.explode(rows).alias("t")).select("path", "t.field", "t.value").filter("value <> ''")


def exif_numbers(probed: DataFrame) -> DataFrame:
    """path, field, value: the numbers for ranges; absent and non-finite ones have no row."""
    names = ("lat", "lon", "altitude", "year", "month", "day", "orientation", "iso", "fnumber", "exposure", "focal")
    rows = F.array(*(F.struct(F.lit(f"exif.{n}").alias("field"), F.col(n).cast("double").alias("value")) for n in names))
    return probed.select("path", F.explode(rows).alias("t")).select("path", "t.field", "t.value").filter("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('Infinity')")


def image_documents(docs: DataFrame, embeddings: DataFrame, doc: str = "doc_id", vec: str = "vec_id") -> DataFrame:
    """docs with their embedding (null for those without) and has_embedding. Of several embeddings of a document, any one."""
    own = embeddings.groupBy(F.col(vec).alias("_vec")).agg(F.first("embedding").alias("embedding"))
    return docs.join(own, F.col(doc) == F.col("_vec"), "left").drop("_vec").withColumn("has_embedding", F.col("embedding").isNotNull())


def distance256(a: Column, b: Column) -> Column:
    """Bits that differ between two hashes of several longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, v: n + v)


def near_slice(rows: DataFrame, hash_col: str, probe: list[int], most: int) -> DataFrame:
    """Rows whose hash of several longs is within `most` bits of the probe, in no order of their own."""
    return rows.filter(distance256(F.col(hash_col), F.array(*(F.lit(x).cast("long") for x in probe))) <= most)


def first_of_digest(rows: DataFrame, digest: str, doc: str) -> DataFrame:
    """rows with duplicate_of: the least document of the same digest; null for a null or all-zero digest.

    The least is an aggregate, so a digest with many documents combines before it is shuffled.
    """
    own = rows.filter(F.col(digest).isNotNull() & ~F.col(digest).rlike("^0*$"))
    least = own.groupBy(F.col(digest).alias("_digest")).agg(F.min(doc).alias("duplicate_of"))
    return rows.join(least, F.col(digest) == F.col("_digest"), "left").drop("_digest")
