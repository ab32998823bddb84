"""Text encodings: names, detection per file, lossy decoding, and the sources that need them."""

from __future__ import annotations

import codecs

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that detection looks at, and the default cap of a whole-document read.
SAMPLE, CAP = 64 << 10, 4 << 20
#: Fixed value: the bytes of a preview's read.
PREVIEW_BYTES = 8192
#: Id, name, note, group, BOM as hex, and Python's codec for it.
ENCODINGS = [
    ("utf-8", "UTF-8", "Unicode", "unicode", "EFBBBF", "utf-8"),
    ("utf-16le", "UTF-16 LE", "Unicode", "unicode", "FFFE", "utf-16-le"),
    ("utf-16be", "UTF-16 BE", "Unicode", "unicode", "FEFF", "utf-16-be"),
    ("gb18030", "GB18030", "GBK / GB2312", "chinese", "", "gb18030"),
    ("gbk", "GBK", "ANSI 936", "chinese", "", "gb18030"),
    ("big5", "Big5", "ANSI 950", "chinese", "", "big5hkscs"),
    ("shift_jis", "Shift_JIS", "ANSI 932", "japanese", "", "cp932"),
    ("euc-jp", "EUC-JP", "", "japanese", "", "euc_jp"),
    ("euc-kr", "EUC-KR", "ANSI 949", "korean", "", "cp949"),
    ("windows-1252", "Windows-1252", "ANSI 1252 / Latin-1", "western", "", "cp1252"),
    ("windows-1251", "Windows-1251", "ANSI 1251", "western", "", "cp1251"),
    ("windows-1250", "Windows-1250", "ANSI 1250", "western", "", "cp1250"),
]
#: Other names of the ids.
ALIASES = {
    "utf8": "utf-8", "utf-8-bom": "utf-8", "utf8-bom": "utf-8",
    "unicode": "utf-16le", "utf16": "utf-16le", "utf-16": "utf-16le", "utf-16-le": "utf-16le", "utf16le": "utf-16le",
    "utf-16-be": "utf-16be", "utf16be": "utf-16be",
    "ansi": "gb18030", "gb2312": "gbk", "gb-2312": "gbk", "cp936": "gbk", "936": "gbk",
    "cp950": "big5", "950": "big5", "cp932": "shift_jis", "932": "shift_jis", "sjis": "shift_jis", "cp949": "euc-kr", "949": "euc-kr",
    "cp1252": "windows-1252", "1252": "windows-1252", "latin1": "windows-1252", "latin-1": "windows-1252", "iso-8859-1": "windows-1252", "8859-1": "windows-1252",
    "cp1251": "windows-1251", "1251": "windows-1251", "cp1250": "windows-1250", "1250": "windows-1250",
}
FALLBACK = "gb18030"
_CODECS = {e[0]: e[5] for e in ENCODINGS}


def encodings(spark: SparkSession) -> DataFrame:
    """The table of encodings."""
    return spark.createDataFrame([e[:4] for e in ENCODINGS], "id string, name string, note string, `group` string")


def encoding_id(name: Column) -> Column:
    """The id that a name, in any case and with _ or -, stands for; null if it is unknown."""
    raw = F.lower(F.trim(name))
    key = F.replace(raw, F.lit("_"), F.lit("-"))
    ids = [e[0] for e in ENCODINGS]
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.when(raw.isin(ids), raw), F.when(key.isin(ids), key), F.try_element_at(alias, key), F.try_element_at(alias, raw))


def begins_utf8(data: bytes | None) -> bool:
    """Whether bytes are the beginning of valid UTF-8; a cut character at the end is allowed."""
    try:
        codecs.getincrementaldecoder("utf-8")("strict").decode(data or b"", False)
    except UnicodeDecodeError:
        return False
    return True


#: The last bytes, as hex, that begin a character of UTF-8 and don't end it.
_CUT = "(C[2-9A-F]|D[0-9A-F]|E0([AB].)?|E[1-9A-F]([89AB].)?|F0([9AB].([89AB].)?)?|F[123]([89AB].([89AB].)?)?|F4(8.([89AB].)?)?)"


def _utf8_start(sample: Column) -> Column:
    """begins_utf8() of a column; null begins it."""
    cut = F.length(F.regexp_extract(F.hex(F.substring(sample, -3, 3)), rf"\A(?:..)*?{_CUT}\z", 1)) / 2
    whole = F.substr(sample, F.lit(1), (F.octet_length(sample) - cut).cast("int"))
    return F.coalesce(F.is_valid_utf8(whole.cast("string")), F.lit(True))


def detect_bytes(head: bytes) -> str:
    """The id that detected() finds, of bytes at hand in a task."""
    for e in ENCODINGS:
        if e[4] and head.startswith(bytes.fromhex(e[4])):
            return e[0]
    return "utf-8" if begins_utf8(head[:SAMPLE]) else FALLBACK


def bom_of(content: Column) -> Column:
    """The id that a byte order mark names, else null."""
    start = F.hex(F.substring(content, 1, 3))
    return F.coalesce(*[F.when(F.startswith(start, F.lit(e[4])), e[0]) for e in ENCODINGS if e[4]])


def detected(content: Column) -> Column:
    """struct<id, source, bom> of a file's bytes: by its mark, as valid UTF-8, else the fallback."""
    bom = bom_of(content)
    utf8 = F.when(_utf8_start(F.substring(content, 1, SAMPLE)), F.lit("utf-8"))
    source = F.when(bom.isNotNull(), "bom").when(utf8.isNotNull(), "utf8").otherwise("fallback")
    return F.struct(F.coalesce(bom, utf8, F.lit(FALLBACK)).alias("id"), source.alias("source"), bom.isNotNull().alias("bom"))


def with_encoding(files: DataFrame, choice: Column | str = "auto", content_col: str = "content") -> DataFrame:
    """``files`` with encoding: struct<choice, id, name, note, group, source, bom>. An empty, ``auto`` or
    unknown choice is detected."""
    choice = F.coalesce(F.lit(choice) if isinstance(choice, str) else choice, F.lit(""))
    content = F.col(content_col)
    named = files.withColumn("_found", detected(content)).withColumn("_named", F.when(F.lower(F.trim(choice)) != "auto", encoding_id(choice)))
    own_bom = F.coalesce(*[F.when((F.col("_named") == e[0]), F.startswith(F.hex(F.substring(content, 1, 3)), F.lit(e[4])) if e[4] else F.lit(False)) for e in ENCODINGS])
    pick = lambda mine, other: F.when(F.col("_named").isNotNull(), mine).otherwise(other)
    infos = F.create_map(*[x for e in ENCODINGS for x in (F.lit(e[0]), F.struct(*[F.lit(v).alias(n) for n, v in zip(("name", "note", "group"), e[1:4], strict=True)]))])
    id_ = pick(F.col("_named"), F.col("_found.id"))
    info = infos[id_]
    return named.withColumn(
        "encoding",
        F.struct(
            choice.alias("choice"), id_.alias("id"), info["name"].alias("name"), info["note"].alias("note"), info["group"].alias("group"),
            pick(F.lit("manual"), F.col("_found.source")).alias("source"), pick(own_bom, F.col("_found.bom")).alias("bom"),
        ),
    ).drop("_found", "_named")


def _as_byte(error: UnicodeError) -> tuple[str, int]:
    """Single-byte code pages leave a few bytes open; they stand for themselves."""
    return "".join(map(chr, error.object[error.start : error.end])), error.end


codecs.register_error("linework-byte", _as_byte)


def decode_bytes(data: bytes | None, encoding: str) -> str | None:
    """Lossy text: what can't be decoded becomes U+FFFD."""
    if data is None:
        return None
    codec = _CODECS[encoding]
    return bytes(data).decode(codec, "linework-byte" if codec.startswith("cp125") else "replace")


#: Not in Arrow's batches, which have thousands of whole files: rows go to Python a hundred at a time.
_decode = F.udf(decode_bytes, T.StringType(), useArrow=False)


def decode(content: Column, encoding: Column) -> Column:
    """Lossy decoding of bytes by encoding id; valid UTF-8 is text as it stands."""
    plain = (encoding == "utf-8") & F.is_valid_utf8(content.cast("string"))
    return F.when(plain, content.cast("string")).otherwise(_decode(F.when(~F.coalesce(plain, F.lit(False)), content), encoding))


def without_bom(content: Column, id_: Column) -> Column:
    """Bytes without the mark of their encoding."""
    size = F.coalesce(*[F.when((id_ == e[0]) & F.startswith(F.hex(F.substring(content, 1, 3)), F.lit(e[4])), len(e[4]) // 2) for e in ENCODINGS if e[4]], F.lit(0))
    return F.substr(content, size + 1)


def decoded(files: DataFrame, content_col: str = "content") -> DataFrame:
    """``files`` (with encoding) with text."""
    content, id_ = F.col(content_col), F.col("encoding.id")
    return files.withColumn("text", decode(without_bom(content, id_), id_))


def preview_lines(text: Column, truncated: Column, n: int = 14) -> Column:
    """The first lines of a text; at the end of a cut read, marks of a cut character go."""
    clean = F.regexp_replace(text, r"\A\x{FEFF}", "")
    clean = F.when(truncated, F.regexp_replace(clean, r"\x{FFFD}+\z", "")).otherwise(clean)
    lines = F.split(clean, r"\r\n|\r|\n", -1)
    lines = F.when((F.size(lines) > 1) & (F.element_at(lines, -1) == ""), F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.slice(lines, 1, n))


def preview(content: Column, encoding: Column, n: int = 14) -> Column:
    """The first lines of a file's bytes, read no further than PREVIEW_BYTES and decoded with replacement."""
    text = decode(F.substring(content, 1, PREVIEW_BYTES), encoding)
    return preview_lines(text, F.octet_length(content) > PREVIEW_BYTES, n)


def garbled(text: Column) -> Column:
    """At least four replacement characters, and one character in twenty."""
    bad = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    return F.coalesce((bad >= 4) & (bad * 20 >= F.length(text)), F.lit(False))
