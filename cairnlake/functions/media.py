"""File types from their first bytes, content headers, image dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading bytes in hexadecimal, category, subtype and mime type; the first that fits wins.
SIGNATURES = [
    ("25504446", "pdf", "", "application/pdf"),
    ("89504E470D0A1A0A", "image", "PNG", "image/png"),
    ("FFD8FF", "image", "JPEG", "image/jpeg"),
    ("47494638", "image", "GIF", "image/gif"),
    ("424D", "image", "BMP", "image/bmp"),
    ("49492A00", "image", "TIFF", "image/tiff"),
    ("4D4D002A", "image", "TIFF", "image/tiff"),
    ("00000100", "image", "ICO", "image/x-icon"),
    ("2E71D4122F7DD6084934", "ecu", "KESSv2", "application/octet-stream"),
    ("ECBB560C9C59E942414F0005F8E8BF8D", "ecu", "KESSv3", "application/octet-stream"),
    ("ECBB560C9C59E942414F8005F06DBF8D", "ecu", "KESSv3", "application/octet-stream"),
    ("4D4D5346010000000001", "ecu", "FlexMagic", "application/octet-stream"),
    ("A53BFB19AC26", "ecu", "KTag", "application/octet-stream"),
    ("45420304", "ecu", "ZPR", "application/octet-stream"),
    ("504D0304", "ecu", "ECU", "application/octet-stream"),
    ("58420304", "ecu", "XPR", "application/octet-stream"),
    ("58490304", "ecu", "XP2", "application/octet-stream"),
    ("504B0304", "binary", "ZIP", "application/zip"),
]
# Longest side of each image variant.
VARIANTS = {"thumb": 150, "sm": 400, "md": 800, "lg": 1200}


def file_type(content: Column) -> Column:
    """"category|subtype|mime" of binary content."""
    size, hexed = F.octet_length(content), F.hex(F.substring(content, 1, 16))
    head = lambda n: F.decode(F.substring(content, 1, n), "ISO-8859-1")
    rules = [(hexed.startswith(p), f"{kind}|{sub}|{mime}") for p, kind, sub, mime in SIGNATURES]
    rules += [
        (hexed.startswith("52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250"), "image|WebP|image/webp"),
        (head(100).contains("<svg") | head(100).contains("<?xml"), "image|SVG|image/svg+xml"),
        ((size < 120) & head(120).contains("gaia_fake_file"), "binary|Fake|application/octet-stream"),
        (head(1000).startswith("sep=,") & head(1000).contains("Service Tool") & head(1000).contains("INSITE") & head(1000).contains("ECM Code"), "text|Cummins|text/csv"),
        (head(1000).contains("Software Group Part Number") & head(1000).rlike(r"C\d+(\.\d+)?"), "text|CAT|text/plain"),
        ((size < 12000) & F.lower(head(12000)).contains("ident") & ~F.lower(head(12000)).contains("fake"), "binary|Ident|application/octet-stream"),
    ]
    out = F.lit("binary||application/octet-stream")
    for holds, result in reversed(rules):
        out = F.when(holds, F.lit(result)).otherwise(out)
    return out


def disposition(mime: Column) -> Column:
    inline = mime.rlike("^(image|video|audio)/") | mime.isin("application/pdf", "text/plain")
    return F.when(inline, "inline").otherwise("attachment")


def compression(mode: Column, raw: Column, compressed: Column, least: float = 10.0) -> Column:
    """The algorithm that a blob is kept with: in auto mode zstd where it saves enough, else what is asked for, else none."""
    m = F.lower(mode)
    saved = F.when(raw != 0, (raw - compressed) / raw * 100)
    return F.when(m == "auto", F.when(saved >= least, "zstd").otherwise("none")).when(m.isin("gzip", "zstd"), m).otherwise("none")


def fitted(width: Column, height: Column, most_w: Column, most_h: Column) -> tuple[Column, Column]:
    """Width and height scaled into a box, truncated; unchanged where they fit."""
    ratio = F.least(most_w.cast("double") / width, most_h.cast("double") / height)
    inside = (width <= most_w) & (height <= most_h)
    return tuple(F.when(inside, x).otherwise((x.cast("double") * ratio).cast("int")) for x in (width, height))


def image_quality(longest: Column) -> Column:
    return F.when(longest <= 150, 85).when(longest <= 400, 88).otherwise(90)


def image_output(mime: Column) -> Column:
    return F.when(mime.contains("png"), "image/png").otherwise("image/jpeg")
