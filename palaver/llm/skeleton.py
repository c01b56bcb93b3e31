"""Visually identical text: the confusables skeleton.

skeleton(x) = D(prototype(D(x))): decompose, drop what is invisible, replace every
character by the prototype of its look-alikes, decompose again. Texts that read and
look the same have equal skeletons; letter case, other letters, digits, words and line
layout stay visible.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.session import join_side, materialise

# Look-alike letters of other alphabets and their Latin prototypes,
# after the public confusables data of the Unicode Consortium.
LOOK_ALIKE = {
    # Cyrillic small
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    # Cyrillic capital
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "Ӏ": "I", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y",
    # Greek
    "α": "a", "γ": "y", "ι": "i", "ϳ": "j", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "υ": "u", "ϲ": "c", "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z",
    # Armenian
    "ա": "w", "ց": "g", "հ": "h", "ո": "n", "օ": "o", "զ": "q", "ս": "u", "Ս": "U", "Օ": "O", "Լ": "L",
    # Latin letters outside ASCII, with no decomposition
    "ı": "i", "ȷ": "j", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʋ": "v", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ƽ": "s", "Ɩ": "l", "ǀ": "l",
    # punctuation
    "։": ":", "׃": ":", "∶": ":", "꞉": ":", "‚": ",", "٪": "%", "․": ".", ";": ";", "⁄": "/", "∕": "/",
}
HYPHENS = "‐‑‒–−˗۔⁃﹘﹣－֊"
#: Compatibility decompositions that only change width, font or joining, not the look of a letter.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}
_ASCII_LOOK = re.compile("[\x00-\x08\x0b\x0e-\x1f\x7f\t\x0c\r]")


def _invisible(ch: str) -> bool:
    code = ord(ch)
    return (
        unicodedata.category(ch) == "Cf"
        or 0xFE00 <= code <= 0xFE0F
        or 0xE0100 <= code <= 0xE01EF
        or code in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5, 0x2065)
        or (unicodedata.category(ch) == "Cc" and ch not in "\t\n\r\x0b\x0c\x85")
    )


@lru_cache(maxsize=65536)
def prototype(ch: str) -> str:
    """What one (already decomposed) character looks like; '' if it is invisible."""
    if ch in "\r\x85  \x0b\x0c":
        return "\n"
    if ch == "\n" or (" " < ch <= "~"):
        return ch
    if _invisible(ch):
        return ""
    if ch == "\t" or unicodedata.category(ch) == "Zs":
        return " "
    if ch in HYPHENS:
        return "-"
    if ch in LOOK_ALIKE:
        return LOOK_ALIKE[ch]
    parts = unicodedata.decomposition(ch).split()
    if parts and parts[0] in SAME_LOOK:
        whole = "".join(chr(int(x, 16)) for x in parts[1:])
        # spacing accents such as U+00B4 decompose to blank and accent: they are visible as they are
        return "".join(prototype(x) for x in unicodedata.normalize("NFD", whole)) if not whole.startswith(" ") else ch
    return ch


class _Table(dict):
    def __missing__(self, code: int) -> str:
        self[code] = value = prototype(chr(code))
        return value


_TABLE = _Table()


def skeleton(text: str | None) -> str | None:
    """The skeleton of one text; null stays null, CR LF counts as one line end."""
    if text is None:
        return None
    if text.isascii() and not _ASCII_LOOK.search(text):
        return text
    text = unicodedata.normalize("NFD", text.replace("\r\n", "\n"))
    return unicodedata.normalize("NFD", text.translate(_TABLE))


def with_skeleton(df: DataFrame, text: str = "text", out: str = "skeleton") -> DataFrame:
    """Add the skeleton of column ``text``. Every batch is an Arrow batch; rows are independent."""
    keep = [c for c in df.columns if c != out]
    schema = df.select(*keep, F.lit(None).cast("string").alias(out)).schema
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([skeleton(x) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*keep, out])

    return df.select(*keep).mapInArrow(run, schema)


def look_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (id, look, form): ``look`` is equal for equal-looking texts,
    ``form`` for equal texts. Keys are 128-bit digests, so only they are shuffled.
    A null text looks like nothing and gets null keys."""
    keyed = with_skeleton(df.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text")
    digest = lambda c: F.unhex(F.md5(F.encode(c, "UTF-8")))
    return keyed.select("id", digest("skeleton").alias("look"), digest("text").alias("form"))


def look_classes(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document whose text looks like a different one: ``id_col``, ``class_id`` (first
    document of its look), ``form_id`` (first document of its very text) and ``links``, the
    number of documents that look the same and differ. It grows as the documents do, however
    many copies there are; ``equal_looking_pairs`` is its expansion. Documents without a
    look-alike, and null texts, have no row; rows of one id count one by one."""
    return _members(materialise(look_groups(df, id_col, text))).select(F.col("id").alias(id_col), "class_id", "form_id", "links")


def _members(rows: DataFrame) -> DataFrame:
    forms = rows.where("look is not null").groupBy("look", "form").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("form_id"))
    # a look with two forms: one partial aggregation, no collected sets
    looks = forms.groupBy("look").agg(F.sum("copies").alias("size"), F.min("form_id").alias("class_id"), F.count(F.lit(1)).alias("forms")).where("forms > 1")
    mixed = materialise(forms.join(looks, "look").select("look", "form", "form_id", "class_id", "size", (F.col("size") - F.col("copies")).alias("links")))
    return rows.join(join_side(mixed, mixed.count()), ["look", "form"])


def equal_looking_pairs(df: DataFrame, id_col: str = "doc_id", text: str = "text", portion: int = 4096) -> DataFrame:
    """Pairs (id_1 < id_2) of documents whose texts differ but look the same.

    A look with one form only (exact copies, however many) never reaches the join. Looks
    with several forms are joined within themselves; one of more than ``portion`` documents is
    spread over as many parts as it has portions: one side goes to one part by its id, the
    other, to all of them, so a hot look is many tasks and no other look is repeated.
    Pairs of equal texts are no result; null texts look like nothing.
    """
    held = materialise(_members(materialise(look_groups(df, id_col, text))).select("id", "class_id", "form_id", F.ceil(F.col("size") / portion).alias("parts")))
    a = held.select("class_id", F.col("id").alias("doc_id_1"), F.col("form_id").alias("form_1"), F.pmod(F.xxhash64("id"), "parts").alias("part"))
    b = held.select("class_id", F.col("id").alias("doc_id_2"), F.col("form_id").alias("form_2"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return a.join(b, ["class_id", "part"]).where("doc_id_1 < doc_id_2 and form_1 <> form_2").select("doc_id_1", "doc_id_2").distinct()
