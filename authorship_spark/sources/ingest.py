"""Whole files to texts: sniff, decode, set aside what isn't text. Map-only."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.helpers import decode_utf16

EXTENSIONS = ("txt", "md", "csv", "tsv", "log", "json", "xml", "html", "htm")
SNIFFED = 4096
# Formats and how their first bytes look in hexadecimal; the first match counts.
SIGNATURES = [
    ("PNG", "^89504E47.{8}"), ("JPEG", "^FFD8FF"), ("GIF", "^47494638"), ("WebP", "^52494646.{8}57454250"), ("WAV", "^52494646.{8}57415645"),
    ("BMP", "^424D.{24}(0C|28|34|38|40|6C|7C)000000"), ("TIFF", "^(49492A00|4D4D002A)"), ("ICO", "^00000100"), ("PDF", "^255044462D"), ("ZIP", "^504B0[357]0[468]"),
    ("RAR", "^526172211A07"), ("7Z", "^377ABCAF271C"), ("GZIP", "^1F8B"), ("OGG", "^4F676753"), ("FLAC", "^664C6143"), ("MP4/MOV", "^.{8}66747970.{8}"),
    ("MP3", "^(494433|FFFB|FFF3|FFF2)"), ("ELF", "^7F454C46"), ("MS Office", "^D0CF11E0.{8}"), ("SQLite", "^53514C69.{24}"),
]
#: The upper half of windows-1251; the byte without a character becomes U+FFFD.
WINDOWS_1251 = bytes(range(0x80, 0x100)).decode("cp1251", "replace")
_HIGH = "".join(map(chr, range(0x80, 0x100)))


def read_text_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, modificationTime, length, content) of the files under ``path`` with one of ``extensions`` (all if empty).

    Files without a byte are texts too, of no characters; their time isn't known.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if extensions:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    files = reader.load(path)
    return files.unionByName(_without_bytes(files))


def _without_bytes(files: DataFrame) -> DataFrame:
    """The listed files that the reader leaves out, since it reads no file of no bytes: those without a row.

    Their paths are held against the listing, which Spark keeps on the driver anyway; no content is read for it.
    """
    alike = lambda p: re.sub(r"^([A-Za-z][\w+.-]*):/{2,}(?=/)", r"\1:", unquote(p))
    listed = files.sparkSession.createDataFrame([(alike(p),) for p in files.inputFiles()], "path string")
    there = files.select(F.regexp_replace("path", r"^([A-Za-z][\w+.-]*):/{2,}(?=/)", "$1:").alias("path"))
    none = F.lit(None).cast("timestamp").alias("modificationTime")
    return listed.join(there, "path", "left_anti").select("path", none, F.lit(0).cast("long").alias("length"), F.unhex(F.lit("")).alias("content"))


def binary_signature(content: Column) -> Column:
    """Name of the binary format that the first bytes tell; null for none."""
    head = F.hex(F.substring(content, 1, 18))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SIGNATURES):
        if name == "MS Office":  # after it in order: programs of at least 64 bytes
            out = F.when(head.rlike(pattern), F.lit(name)).otherwise(out)
            out = F.when(head.rlike("^4D5A") & (F.octet_length(content) >= 64), F.lit("PE")).otherwise(out)
        else:
            out = F.when(head.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def looks_binary(content: Column) -> Column:
    """NUL or control bytes in the first 4096 bytes beyond what texts have: null if not, else which."""
    head = F.decode(F.substring(content, 1, SNIFFED), "ISO-8859-1")
    n = F.length(head)
    nul, control = F.regexp_count(head, F.lit(r"\x00")), F.regexp_count(head, F.lit(r"[\x01-\x08\x0B\x0C\x0E-\x1F]"))
    return F.when((nul > 0) & (nul * 50 >= n), "NUL bytes").when((n > 0) & (control * 20 >= n), "control bytes")


def detect_and_decode(files: DataFrame) -> DataFrame:
    """Adds text, charset and reject_reason (null for texts) to files with ``content``.

    Byte order marks first; then what looks binary is refused; then strict UTF-8;
    then windows-1251 where it gives a Cyrillic letter; else ISO-8859-1. KOI8-R is
    never chosen: each byte that is Cyrillic there is Cyrillic in windows-1251 too,
    and on a tie windows-1251 goes first.
    """
    content = F.col("content")
    head = F.hex(F.substring(content, 1, 3))
    mark = F.when(head.startswith("EFBBBF"), "UTF-8").when(head.startswith("FFFE"), "UTF-16LE").when(head.startswith("FEFF"), "UTF-16BE")
    rows = files.withColumn("_mark", mark)
    named = F.when(F.col("_mark").isNull(), F.coalesce(binary_signature(content), looks_binary(content)))
    rows = rows.withColumn("reject_reason", named)
    raw = F.when(F.col("_mark") == "UTF-8", F.substring(content, 4, 1 << 30)).otherwise(content)
    latin = F.decode(content, "ISO-8859-1")
    cyrillic = F.translate(latin, _HIGH, WINDOWS_1251)
    charset = (
        F.when(F.col("reject_reason").isNotNull(), F.lit(None))
        .when(F.col("_mark").isNotNull(), F.col("_mark"))
        .when(F.is_valid_utf8(content.cast("string")), "UTF-8")
        .when(cyrillic.rlike(r"[\x{0400}-\x{04FF}]"), "windows-1251")
        .otherwise("ISO-8859-1")
    )
    rows = rows.withColumn("charset", charset)
    wide = decode_utf16(F.when(F.col("charset").startswith("UTF-16"), content))
    text = F.when(F.col("charset") == "UTF-8", F.make_valid_utf8(raw.cast("string"))).when(F.col("charset") == "windows-1251", cyrillic).when(F.col("charset") == "ISO-8859-1", latin)
    return rows.withColumn("text", F.coalesce(wide, text)).drop("_mark")


def quarantine(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts, and what was refused with the reason why."""
    return decoded.where("reject_reason IS NULL"), decoded.where("reject_reason IS NOT NULL").drop("text", "charset")
