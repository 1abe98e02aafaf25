"""One form for texts that look the same: the skeleton of look-alike characters.

A text is decomposed, every character is replaced by its prototype, and the result is decomposed again; texts look the
same if their skeletons are equal. Prototypes come from rules over the Unicode data that Python has (width forms,
ligatures, styled letters, kinds of blank, characters that show nothing), from Unicode's own confusables data, which is
part of the ICU library that Spark brings, and from the few letters below that it lacks. Case, accents, punctuation,
kana marks, raised digits and fractions keep apart what they keep apart to the eye.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters of other scripts, or special forms, that look like a Latin letter; they go before what ICU says.
LOOK_ALIKE = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "κ": "k", "γ": "y", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ӏ": "I", "Ԁ": "D", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ӏ": "l", "ԍ": "g",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Ս": "U", "Լ": "L", "Տ": "S",
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ı": "i", "ȷ": "j", "ʋ": "u", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}
#: Characters beside those of category Cf and Cc that show nothing.
NOTHING = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
#: Compatibility forms that look like what they decompose to.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>")


def prototype(char: str) -> str:
    """What stands for a (decomposed) character in a skeleton; empty for one that shows nothing."""
    if char in LOOK_ALIKE:
        return LOOK_ALIKE[char]
    code, kind = ord(char), unicodedata.category(char)
    if kind in ("Zs", "Zl", "Zp") or char in "\t\n\v\f\r\x85":
        return " "
    if kind in ("Cf", "Cc") or code in NOTHING:
        return ""
    form = unicodedata.decomposition(char)
    ligature = 0xFB00 <= code <= 0xFB06 or 0x2160 <= code <= 0x217F
    if form.startswith(SAME_LOOK) or (ligature and form.startswith("<compat>")):
        parts = "".join(chr(int(x, 16)) for x in form.split(" ")[1:])
        return "".join(prototype(c) for c in unicodedata.normalize("NFD", parts))
    return char


class _Prototypes(dict):
    def __missing__(self, code: int) -> str:
        self[code] = p = prototype(chr(code))
        return p


_TABLE = _Prototypes()


def confusables(spark: SparkSession) -> dict[str, str]:
    """Letters and numbers that Unicode's confusables data gives the look of a Latin letter or digit, with that character.

    Where one shape stands for several (l, I, 1; O, 0), capitals go to the capital, digits to the digit, and letters
    without case to the one in their name. Every character
    of the first two planes is asked, in one call. A session without ICU is an error: with fewer look-alikes, pairs would
    be missing unnoticed.
    """
    asked = [chr(c) for c in range(0x80, 0x20000) if unicodedata.category(chr(c))[0] in "LN" or 0x2100 <= c < 0x2150]
    asked = [c for c in asked if unicodedata.normalize("NFD", c) == c]
    plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    try:
        checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        forms = checker.getSkeleton("\n".join([*plain, *asked])).split("\n")
    except Exception as e:  # no such library, or no such session
        raise RuntimeError("Unicode's confusables data is not at hand: the session needs the ICU library among Spark's jars") from e
    shapes: dict[str, list[str]] = {}
    for c, form in zip(plain, forms, strict=False):
        shapes.setdefault(form, []).append(c)
    out = {}
    for c, form in zip(asked, forms[len(plain) :], strict=True):
        if same := shapes.get(form):
            kind = unicodedata.category(c)
            want = str.isupper if kind in ("Lu", "Nl") else str.isdigit if kind == "Nd" else str.islower
            called = unicodedata.name(c, "").split(" ")[-1]
            out[c] = called if kind == "Lo" and called in same else next((x for x in same if want(x)), same[0])
    return out


def skeleton(text: str | None, table: dict[int, str] = _TABLE) -> str | None:
    """The form in which equal-looking texts are equal; null for null."""
    if text is None:
        return None
    if text.isascii() and text.isprintable():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(table))


def _map(more: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Prototypes({ord(c): p for c, p in (more | LOOK_ALIKE).items()})
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("text"), pa.array([skeleton(x, table) for x in b.column("text").to_pylist()], pa.string())], ["text", "form"])

    return run


def skeletons(df: DataFrame, text: str) -> DataFrame:
    """(text, form) of every distinct non-null text."""
    texts = df.select(F.col(text).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    return texts.mapInArrow(_map(confusables(df.sparkSession)), "text string, form string")


def look_alikes(left: DataFrame, left_key: str, left_text: str, right: DataFrame, right_key: str, right_text: str) -> DataFrame:
    """(left_key, right_key) of rows whose texts look the same but are not the same characters.

    Distinct originals are grouped by equal skeleton and compared once; keys come in at the end, so a text that very
    many rows share costs no comparison of its own. Null keys and texts take no part; repeated rows and keys with
    several texts give a pair once; empty tables give none; texts of any length count whole; other columns are ignored.
    """
    a = left.select(F.col(left_key).alias("ka"), F.col(left_text).cast("string").alias("ta")).dropna().distinct()
    b = right.select(F.col(right_key).alias("kb"), F.col(right_text).cast("string").alias("tb")).dropna().distinct()
    fa = skeletons(a, "ta").select(F.col("text").alias("ta"), F.col("form"))
    fb = skeletons(b, "tb").select(F.col("text").alias("tb"), F.col("form"))
    texts = fa.join(fb, "form").where("ta <> tb").select("ta", "tb")
    return a.join(texts, "ta").join(b, "tb").select(F.col("ka").alias(left_key), F.col("kb").alias(right_key)).distinct()
