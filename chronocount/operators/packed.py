"""Several values packed in one field: one row per value with its position.

Quoted spans are replaced by indexed placeholders, what is left is split at the
delimiters, and the spans are put back by array lookup. All of it is built-in
string and array work, so a field never leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that stand for "no value".
NONE_WORDS = ("0", "nan", "none", "null", "n/a")

#: Delimiters of plain names: commas, semicolons, bars, slashes, "&", "+", the word "and", any white space.
NAME_DELIMITERS = r"[,;|/&+]|\s+and\s+|\s+"
#: Delimiters of references, in which "/", "&" and "+" occur inside a value: those count only between blanks.
REFERENCE_DELIMITERS = r"[,;|]|(?:^|\s)\s*[/&+](?=\s|$)|\s+and\s+|\s+"

# A quote opens only at the start of the field or after a delimiter or bracket,
# and closes only before one, so an apostrophe inside a word stays text.
_SPAN = r"""(?<=^|[\s,;|/&+\[({])("(?:[^"]|"")*"|'(?:[^']|'')*')(?=$|[\s,;|/&+\])}])"""

# A character of the private use area marks placeholders. Where it stands in the
# data it is first doubled by a suffix, so no field can imitate a placeholder.
_MARK = "\ue000"
_HELD = _MARK + "0"
_EDGES = r"(?s)^[\s\u00a0]+|[\s\u00a0]+$"
_BRACKETS = r"(?s)^\[(.*)\]$|^\((.*)\)$|^\{(.*)\}$"


def split_packed(field: Column | str, delimiters: str = NAME_DELIMITERS) -> Column:
    """Array of the values in ``field``, in order.

    * null, empty and blank fields give an empty array;
    * brackets around the field or a value, quotes around a value and blanks at
      the ends are not part of values; what is quoted is one value, and a
      doubled quote in it stands for one;
    * an unbalanced quote is an ordinary character;
    * empty pieces and the words of ``NONE_WORDS`` (any case) are no values;
      a value that occurs twice stays twice.
    """
    raw = F.coalesce(F.col(field) if isinstance(field, str) else field, F.lit(""))
    text = _inside(F.replace(raw, F.lit(_MARK), F.lit(_HELD)))
    spans = lambda t: F.struct(t.alias("text"), F.regexp_extract_all(t, F.lit(_SPAN), F.lit(1)).alias("spans"))
    return _let(text, lambda t: _let(spans(t), lambda v: _values(v["text"], v["spans"], delimiters)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once, also where ``body`` uses it for each of many elements."""
    return F.transform(F.array(value), body)[0]


def _values(text: Column, spans: Column, delimiters: str) -> Column:
    held = F.array_join(
        F.transform(
            F.split(F.regexp_replace(text, _SPAN, _MARK + "1"), _MARK + "1", -1),
            lambda rest, i: F.when(i == 0, rest).otherwise(F.concat(F.lit(_MARK + "<"), i.cast("string"), F.lit(">"), rest)),
        ),
        "",
    )
    pieces = F.transform(F.split(F.when(F.size(spans) > 0, held).otherwise(text), delimiters, -1), _inside)
    values = F.transform(
        pieces,
        lambda x: F.when(x.startswith(_MARK + "<"), _unquoted(spans[F.regexp_extract(x, r"<(\d+)>", 1).cast("int") - 1])).otherwise(x),
    )
    return F.filter(
        F.transform(values, lambda x: F.regexp_replace(F.replace(x, F.lit(_HELD), F.lit(_MARK)), _EDGES, "")),
        lambda x: (x != "") & ~F.lower(x).isin(*NONE_WORDS),
    )


def _inside(x: Column) -> Column:
    """Without blanks at the ends and one pair of brackets."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, _EDGES, ""), _BRACKETS, "$1$2$3"), _EDGES, "")


def _unquoted(span: Column) -> Column:
    quote = F.substring(span, 1, 1)
    return F.replace(F.regexp_replace(span, r"(?s)^.|.$", ""), F.concat(quote, quote), quote)


def explode_packed(
    df: DataFrame, key: str, fields: dict[str, str], distinct: bool = True
) -> DataFrame:
    """``field_name, row_key, n_items, pos, item`` for every value of the named fields.

    ``fields`` maps a column to its delimiters. Rows delivered twice (same key,
    same field text) count once with ``distinct``; where one key comes with
    different texts each text gives its rows. Rows without a key are kept with
    a null ``row_key``. An empty table gives no rows; other columns, whatever
    their names, are not looked at.
    """
    parts = [
        F.struct(F.lit(name).alias("field_name"), F.col(name).cast("string").alias("packed"), split_packed(name, d).alias("items"))
        for name, d in fields.items()
    ]
    one = df.select(F.col(key).cast("bigint").alias("row_key"), F.explode(F.array(*parts)).alias("f")).select(
        "row_key", "f.field_name", "f.packed", "f.items"
    )
    if distinct:
        one = one.dropDuplicates(["field_name", "row_key", "packed"])
    return one.select(
        "field_name", "row_key", F.size("items").alias("n_items"), F.posexplode("items").alias("p", "item")
    ).select("field_name", "row_key", "n_items", (F.col("p") + 1).alias("pos"), "item")
