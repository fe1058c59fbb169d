"""Mapping free-entered names to a reference list.

Method: token-level repair. Each distinct token of the values is joined to the
vocabulary of all tokens of the reference list by edit distance, over their
deletion variants, so it is an equi-join; corrected tokens are then combined
with soft TF-IDF to rank the complete entries, of which those below a score
don't count. Behind it stands an exact check: value and entry agree in every
number and, but for a slip or two, in their letters.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from chronocount.llm.lookalike import seen
from chronocount.session import cut

# Words put around a name that are no part of it.
DECORATION = frozenset(("gene", "symbol", "sym", "name", "id", "protein", "mrna", "rna", "mouse", "human", "rat", "hs", "mm", "hsa", "mmu"))
# Single letters that software puts before a name.
PREFIX_LETTERS = frozenset(("g", "x"))
# Months as spreadsheets write them, and Greek letters as words.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta", "ι": "iota", "κ": "kappa", "λ": "lambda", "μ": "mu",
    "ν": "nu", "ξ": "xi", "π": "pi", "ρ": "rho", "σ": "sigma", "τ": "tau", "υ": "upsilon", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega",
}

_DAY_MONTH = re.compile(rf"\W*0*(\d{{1,2}})[-./\s]+({'|'.join(MONTHS)})[a-z]*\W*")
_MONTH_DAY = re.compile(rf"\W*({'|'.join(MONTHS)})[a-z]*[-./\s]+0*(\d{{1,2}})\W*")
_TOKEN = re.compile(r"[a-z]+|\d+")


def name_tokens(value: str) -> list[str]:
    """The letter and number tokens of a name, without decoration; the first is its stem, all its leading letters.

    Case, width, look-alike letters, accents, blanks and punctuation don't
    count, but two numbers stay two. A date that a spreadsheet made of a name is
    turned back. Without a stem there are no tokens.
    """
    text = "".join(c for c in unicodedata.normalize("NFKD", seen(value)) if unicodedata.category(c) != "Mn").lower()
    for letter in GREEK.keys() & set(text):
        text = text.replace(letter, GREEK[letter])
    if day := _DAY_MONTH.fullmatch(text):
        return [day[2], day[1]]
    if day := _MONTH_DAY.fullmatch(text):
        return [day[1], day[2]]
    tokens = [t for t in _TOKEN.findall(text) if t not in DECORATION]
    if len(tokens) > 1 and tokens[0] in PREFIX_LETTERS and tokens[1].isalpha():
        tokens = tokens[1:]
    n = next((i for i, t in enumerate(tokens) if not t.isalpha()), len(tokens))
    return ["".join(tokens[:n]), *tokens[n:]] if n else []


def osa_within(a: str, b: str, most: int = 1) -> bool:
    """Whether ``most`` (0, 1 or more) insertions, deletions, substitutions or swaps of neighbours at most make ``b`` of ``a``."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most or not most:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[i:], b[i:]
    # The first difference is the place of a slip; each kind of it is tried.
    return (
        osa_within(a[1:], b[1:], most - 1) or osa_within(a[1:], b, most - 1) or osa_within(a, b[1:], most - 1)
        or (len(a) > 1 and a[:2] == b[:2][::-1] and osa_within(a[2:], b[2:], most - 1))
    )


def _allowed(length: int, second_slip_from: int) -> int:
    return 2 if length >= second_slip_from else 1


def same_name(value: list[str], entry: list[str], second_slip_from: int) -> bool:
    """Whether all numbers are equal and the letters are within the slips allowed for their number."""
    if [t for t in value if t.isdigit()] != [t for t in entry if t.isdigit()]:
        return False
    a, b = ("".join(t + "-" * t.isdigit() for t in name) for name in (value, entry))
    return osa_within(a, b, _allowed(sum(c.isalpha() for c in a), second_slip_from))


def _all_tokens(values: pd.Series) -> pd.Series:
    return values.map(name_tokens)


def _tokens(column: str) -> Column:
    return pandas_udf(_all_tokens, "array<string>")(column)


def _same_name(a: str, b: str, second_slip_from: int) -> Column:
    def both(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([same_name(list(v), list(e), second_slip_from) for v, e in zip(x, y)], dtype=bool)

    return pandas_udf(both, "boolean")(a, b)


def _close(a: str, b: str, second_slip_from: int) -> Column:
    def both(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([osa_within(v, e, _allowed(len(v), second_slip_from)) for v, e in zip(x, y)], dtype=bool)

    return pandas_udf(both, "boolean")(a, b)


def _deletions(word: Column) -> Column:
    """The word and all that one deletion makes of it."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.when(F.length(word) > 0, F.array_distinct(F.concat(F.array(word), cut))).otherwise(F.array(word))


def _variants(word: Column, second_slip_from: int | Column) -> Column:
    """What up to one deletion makes of the word, up to two from a length on."""
    twice = F.array_distinct(F.flatten(F.transform(_deletions(word), _deletions)))
    return F.when(F.length(word) >= second_slip_from, twice).otherwise(_deletions(word))


def repair_tokens(tokens: DataFrame, vocabulary: DataFrame, min_length: int = 2, second_slip_from: int = 16) -> DataFrame:
    """``token, known, similarity`` from ``token`` and ``known``, one column each.

    A token of the vocabulary stands for itself alone, and so does a number. Any
    other token of ``min_length`` letters or more stands for every word of the
    vocabulary within one slip (two from ``second_slip_from`` letters on), each
    with 1 - 1 / length. Null and empty tokens stand for nothing.
    """
    same = tokens.join(vocabulary, F.col("token") == F.col("known")).select("token", "known", F.lit(1.0).alias("similarity"))
    letters = vocabulary.filter(~F.col("known").rlike("^[0-9]*$"))
    longest = letters.agg(F.coalesce(F.max(F.length("known")), F.lit(0)).alias("longest"))
    odd = tokens.join(vocabulary, F.col("token") == F.col("known"), "left_anti").filter((F.length("token") >= min_length) & ~F.col("token").rlike("^[0-9]*$"))
    # A token longer than any known one by more than the slips needs no variants.
    odd = odd.join(F.broadcast(longest)).filter(F.length("token") <= F.col("longest") + 2)
    a = odd.select("token", F.explode(_variants(F.col("token"), second_slip_from)).alias("d"))
    b = letters.filter(F.length("known") >= min_length - 1).select("known", F.explode(_variants(F.col("known"), second_slip_from - 2)).alias("d"))
    near = a.join(b, "d").select("token", "known").distinct().filter(_close("token", "known", second_slip_from))
    length = F.greatest(F.length("token"), F.length("known"))
    return same.unionByName(near.select("token", "known", (1 - 1 / length).alias("similarity")))


def match_names(values: DataFrame, reference: DataFrame, ref_id: str, ref_name: str, least_score: float = 0.5, second_slip_from: int = 16) -> DataFrame:
    """``value, ref_id, score`` for each distinct ``value`` (a column of ``values``) that is neither null nor blank.

    ``score`` is the soft TF-IDF cosine of the value's repaired tokens and the
    entry's tokens. ``ref_id`` is null where no entry reaches ``least_score`` and
    agrees with the value in every number and, but for the slips allowed, in
    every letter. Of several the highest score stands, then the smaller id. A
    name that the reference has twice has the smaller id; reference rows without
    a name are not looked at.

    Values meet entries by repaired stem and all numbers together, so an entry
    list in which one stem has a third of all names is still met name by name.
    """
    distinct = values.select("value").filter(F.trim(F.regexp_replace("value", r"[\s\p{Z}\p{Cf}]+", "")) != "").distinct()
    read = cut(distinct.withColumn("tokens", _tokens("value")))
    entries = (
        reference.filter(F.col(ref_name).isNotNull()).groupBy(F.col(ref_name).alias("name")).agg(F.min(ref_id).alias("ref"))
        .withColumn("entry", _tokens("name")).filter(F.size("entry") > 0)
    )
    entries = cut(entries)
    # How rare a token is among the entries weighs it; one that no entry has is the rarest.
    n = entries.agg(F.count(F.lit(1)).cast("double").alias("n"))
    known = entries.select(F.explode(F.array_distinct("entry")).alias("known")).groupBy("known").agg(F.count(F.lit(1)).alias("df"))
    known = cut(known.join(F.broadcast(n)).select("known", F.log(1 + F.col("n") / F.col("df")).alias("known_w")))
    tokens = read.select(F.explode("tokens").alias("token")).distinct()
    repaired = (
        repair_tokens(tokens, known.select("known"), second_slip_from=second_slip_from).join(known, "known")
        .groupBy("token").agg(F.collect_list(F.struct("known", (F.col("similarity") * F.col("known_w")).alias("w"), "similarity", "known_w")).alias("fits"))
    )
    rarest = F.log(1 + F.col("n"))
    # The weight of a token that was repaired is that of the rarest one, like that of an unknown one.
    own = F.coalesce(F.get(F.filter("fits", lambda f: f["similarity"] == 1.0), F.lit(0))["known_w"], rarest)
    named = read.filter(F.size("tokens") > 0)
    parts = named.select("value", F.posexplode("tokens").alias("at", "token")).join(repaired, "token", "left").join(F.broadcast(n))
    v = parts.groupBy("value").agg(F.sort_array(F.collect_list(F.struct("at", own.alias("w"), F.col("fits").alias("fits")))).alias("parts"))
    numbers = lambda c: F.concat_ws("-", F.filter(c, lambda t: t.rlike("^[0-9]"))).alias("numbers")
    v = named.join(v, "value").select("value", "tokens", "parts", numbers("tokens"), F.explode(F.col("parts")[0]["fits"]).alias("f")).withColumn("stem", F.col("f.known")).drop("f")
    each = entries.select("ref", "entry", F.posexplode("entry").alias("at", "known")).join(known, "known").groupBy("ref", "entry").agg(F.sum(F.col("known_w") * F.col("known_w")).alias("square"))
    e = each.select("ref", "entry", "square", numbers("entry"), F.col("entry")[0].alias("stem"))
    pairs = v.join(e, ["stem", "numbers"])
    best = lambda p: F.coalesce(F.array_max(F.transform(F.filter(p["fits"], lambda f: F.array_contains(F.col("entry"), f["known"])), lambda f: f["w"])), F.lit(0.0))
    product = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["w"] * best(p))
    norm = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["w"] * p["w"])
    scored = pairs.select("value", "tokens", "ref", "entry", F.round(product / F.sqrt(norm * F.col("square")), 9).alias("score")).filter(F.col("score") >= least_score)
    ranked = scored.filter(_same_name("tokens", "entry", second_slip_from)).groupBy("value").agg(F.max_by(F.struct("ref", "score"), F.struct("score", -F.col("ref"))).alias("m"))
    return distinct.join(ranked, "value", "left").select("value", F.col("m.ref").alias("ref_id"), F.col("m.score").alias("score"))
