"""Texts that look the same but are made of other characters.

Method: compatibility normalisation in composed form, full case folding, one
kind of blank, look-alike letters and removal of default-ignorable characters,
computed once per distinct value of a batch. Texts of one common form are one
class; what a reader tells apart (case, accents, raised digits, the number of
blanks) then divides a class, as the exact check behind the method.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that are drawn like a Latin one, each
# with that letter.
LOOK_ALIKES = {
    # Cyrillic, small
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    # Cyrillic, capital
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W",
    # Greek
    "ο": "o", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ϲ": "c", "ϳ": "j",
    # Armenian
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "զ": "q", "ց": "g", "Օ": "O", "Տ": "S", "Ս": "U", "Լ": "L",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Latin letters of phonetic alphabets
    "ɑ": "a", "ɡ": "g",
    # hyphens
    "‐": "-", "‑": "-",
}

# Ranges of default-ignorable code points (Unicode, DerivedCoreProperties).
IGNORABLE = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F),
    (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)


@cache
def _rules() -> dict[str, str]:
    """Every character that changes, with what it becomes."""
    become = dict(LOOK_ALIKES)
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        kind = unicodedata.decomposition(c).partition(" ")[0]
        if kind[:1] == "<" and kind not in ("<super>", "<sub>", "<fraction>"):
            become.setdefault(c, "".join(LOOK_ALIKES.get(x, x) for x in unicodedata.normalize("NFKC", c)))
        if unicodedata.category(c) == "Zs":
            become[c] = " "
    return become | {chr(code): "" for low, high in IGNORABLE for code in range(low, high + 1)}


def seen(text: str) -> str:
    """What a reader sees: width, look-alikes, kinds of blanks and invisible characters made one; case, accents and raised digits kept."""
    if not text.isascii():
        become = _rules()
        # Accents come off first, as a look-alike letter may carry one. A text
        # has few different characters, so each is replaced in one sweep.
        text = unicodedata.normalize("NFD", text)
        for c in become.keys() & set(text):
            text = text.replace(c, become[c])
        text = unicodedata.normalize("NFC", text)
    return text.replace("\r\n", "\n")


def folded(text: str) -> str:
    """The text after compatibility decomposition, with look-alikes and blanks made one and ignorables gone, case folded, composed; line breaks stay."""
    if text.isascii():
        return text.lower().replace("\r\n", "\n")
    text = unicodedata.normalize("NFKD", text)
    become = _letters()
    for c in become.keys() & set(text):
        text = text.replace(c, become[c])
    # Folding can bring back a decomposed letter, so the composition comes last.
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).replace("\r\n", "\n")


@cache
def _letters() -> dict[str, str]:
    """The characters of ``_rules`` that a compatibility decomposition leaves."""
    return {c: to for c, to in _rules().items() if unicodedata.normalize("NFKD", c) == c}


def common_form(text: str) -> str:
    """The common form of a text: ``folded``, with each line break and control blank as one blank."""
    return _blanks(folded(text))


def _blanks(text: str) -> str:
    for c in "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85\u2028\u2029":
        text = text.replace(c, " ")
    return text


def _forms(key: str, text: str, with_form: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            code, values = pd.factorize(b[text])
            forms = [common_form(v) for v in values]
            shown = [seen(v) for v in values]
            digest = {
                "form_key": [xxhash.xxh3_128_digest(v.encode("utf-8", "surrogatepass")) for v in forms],
                "seen_key": [xxhash.xxh3_128_digest(v.encode("utf-8", "surrogatepass")) for v in shown],
                "text_key": [xxhash.xxh3_128_digest(v.encode("utf-8", "surrogatepass")) for v in values],
            }
            keep = code >= 0
            out = pd.DataFrame({"row_key": b[key].to_numpy()[keep]})
            for name, of in (digest | ({"form": forms} if with_form else {})).items():
                out[name] = [of[c] for c in code[keep]]
            out["n_chars"] = [len(values[c]) for c in code[keep]]
            out["blank"] = [not forms[c].strip() for c in code[keep]]
            yield out

    return run


def text_forms(df: DataFrame, key: str, text: str, with_form: bool = False) -> DataFrame:
    """``row_key, form_key, seen_key, text_key[, form], n_chars, blank`` of every row with a text.

    The keys are 128-bit hashes of the common form, of what a reader sees, and
    of the text itself; each distinct text of a batch is worked on once. Null texts give no row; empty and invisible ones have
    ``blank`` set. Whole texts are read; other columns are not.
    """
    schema = f"row_key {dict(df.dtypes)[key]}, form_key binary, seen_key binary, text_key binary, "
    schema += ("form string, " if with_form else "") + "n_chars bigint, blank boolean"
    return df.select(key, text).mapInPandas(_forms(key, text, with_form), schema)


def look_alike_classes(forms: DataFrame) -> DataFrame:
    """``row_key, class_key, text_key, n_texts, n_rows`` of rows whose class holds two different texts or more.

    The common form makes the classes; only those with two different texts go
    on, and each is divided by what a reader tells apart. Exact copies are
    members of their text; they are counted per text before any grouping by
    class, so a text that is a third of all rows stays one row there.
    ``forms`` is read several times: pass a written table.
    """
    lit = forms.filter(~F.col("blank"))
    texts = lit.groupBy("form_key", "seen_key", "text_key").agg(F.count(F.lit(1)).alias("n"))
    mixed = texts.groupBy("form_key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("form_key")
    classes = (
        texts.join(mixed, "form_key", "left_semi").groupBy("form_key", "seen_key")
        .agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("n_rows"))
        .filter("n_texts > 1")
    )
    return lit.join(classes, ["form_key", "seen_key"]).select(
        "row_key", F.hex(F.xxhash64("form_key", "seen_key")).alias("class_key"), "form_key", "seen_key", "text_key", "n_texts", "n_rows"
    )


def look_alike_pairs(classes: DataFrame) -> DataFrame:
    """``row_a, row_b`` (a < b) of rows in one class with different texts.

    Pairs are made between the classes' texts, of which copies are one; rows are
    put in for each text at the end, since the result asks for them.
    """
    texts = classes.select("form_key", "seen_key", "text_key").distinct()
    a, b = (texts.withColumnRenamed("text_key", f"text_{side}") for side in "ab")
    pairs = a.join(b, ["form_key", "seen_key"]).filter("text_a < text_b").select("text_a", "text_b")
    x, y = (classes.select(F.col("text_key").alias(f"text_{side}"), F.col("row_key").alias(f"row_{side}")) for side in "ab")
    rows = pairs.join(x, "text_a").join(y, "text_b").filter("row_a <> row_b")
    return rows.select(F.least("row_a", "row_b").alias("row_a"), F.greatest("row_a", "row_b").alias("row_b"))
