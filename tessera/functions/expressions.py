"""Scalar expressions over built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def namespace(node_id: Column | str) -> Column:
    """Text before the first ':', or all of it."""
    return F.split_part(col(node_id), F.lit(":"), F.lit(1))


def absent(x: Column | str) -> Column:
    """Null or empty."""
    return col(x).isNull() | (col(x) == "")


def present(x: Column | str) -> Column:
    return col(x).isNotNull() & (col(x) != "")


def readable(predicate: Column | str, prefix: str) -> Column:
    """A predicate in words: without its prefix, underscores as spaces."""
    return F.replace(F.replace(col(predicate), F.lit(prefix), F.lit("")), F.lit("_"), F.lit(" "))


def normalised(x: Column | str) -> Column:
    """Lower case without white space at either end."""
    return F.lower(F.regexp_replace(col(x), r"^\s+|\s+$", ""))


def dot(a: Column | str, b: Column | str) -> Column:
    pairs = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity in doubles; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def human(label: Column | str, species: str) -> Column:
    """No label counts as the wanted species."""
    return F.coalesce(col(label), F.lit(species)) == species


def parse_synonyms(field: Column | str) -> Column:
    """The items of a bracketed list, such as [red, "light, dark", 'blue'], as an array.

    The text must begin with '['; its last character is dropped. A quote of either kind opens a quoted stretch that
    the same quote closes; quotes go, commas outside split, items are trimmed and empty ones dropped. Null or any other
    text gives an empty array. The text is read as quoted stretches, bare runs and commas; commas outside become a mark, and
    what looks like the mark is written otherwise meanwhile."""
    text, mark, escape = col(field), "\u0001", "\u0002"
    inner = F.substring(text, 2, F.greatest(F.length(text) - 2, F.lit(0)))
    inner = F.replace(F.replace(inner, F.lit(escape), F.lit(f"{escape}b")), F.lit(mark), F.lit(f"{escape}a"))
    tokens = F.regexp_extract_all(inner, F.lit(r"""'[^']*(?:'|\z)|"[^"]*(?:"|\z)|,|[^,'"]+"""), F.lit(0))
    plain = F.transform(tokens, lambda t: F.when(t == ",", mark).when(F.startswith(t, F.lit("'")), F.replace(t, F.lit("'"), F.lit(""))).when(F.startswith(t, F.lit('"')), F.replace(t, F.lit('"'), F.lit(""))).otherwise(t))
    items = F.split(F.array_join(plain, ""), mark, -1)
    restored = F.transform(items, lambda x: F.replace(F.replace(x, F.lit(f"{escape}a"), F.lit(mark)), F.lit(f"{escape}b"), F.lit(escape)))
    trimmed = F.transform(restored, lambda x: F.regexp_replace(x, r"^\s+|\s+\z", ""))
    return F.when(F.startswith(text, F.lit("[")), F.filter(trimmed, lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """df with the columns of a global aggregate, which has one row by construction."""
    return df.join(F.broadcast(row))
