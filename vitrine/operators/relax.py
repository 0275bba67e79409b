"""Relaxed names for targets: from a supplied table, or by rules, and what can be checked of either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

CELLS = ["normalized_search_query", *(f"normalized_product_name{k}" for k in range(1, 6))]


def numbers(c: Column) -> Column:
    """Sorted distinct numbers of a name, digits folded."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(t.fold_digits(c), F.lit("[0-9]+"), F.lit(0))))


def query_ok(query: Column) -> Column:
    """A search query must hold no code or volume."""
    return F.size(numbers(query)) == 0


def names_ok(title: Column, *names: Column) -> Column:
    """No variant may add or drop a code or volume of the title."""
    return F.forall(F.array(*names), lambda n: numbers(n) == numbers(title))


def parse_results(json: Column) -> Column:
    """The six texts of a result, null if one is missing."""
    found = F.from_json(json, ", ".join(f"{c} string" for c in CELLS))
    whole = F.forall(F.array(*(found[c] for c in CELLS)), lambda x: x.isNotNull())
    return F.when(whole, found)


def from_table(targets: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Targets with the supplied cells; targets without a result stay, their cells empty."""
    return targets.drop(*CELLS).join(results.select(key, *CELLS), key, "left")


def by_rules(targets: DataFrame, title: str = "title") -> DataFrame:
    """Deterministic cells: the query without numbers and units, and five spellings that keep all numbers."""
    clean = F.trim(F.regexp_replace(t.fold_digits(t.persian_letters(F.replace(F.col(title), F.lit(t.ZWNJ), F.lit(" ")))), r"(?U)\s+", " "))
    query = F.trim(F.regexp_replace(F.regexp_replace(t.standard_units(clean), r"\S*[0-9]\S*", " "), " +", " "))
    units = F.trim(F.regexp_replace(t.standard_units(clean), " +", " "))
    names = [clean, units, F.lower(clean), F.upper(units), F.array_join(F.array_distinct(F.split(clean, " ")), " ")]
    return targets.drop(*CELLS).withColumns(dict(zip(CELLS, [query, *names], strict=True)))
