"""Score adjustments from metadata, and symbol classification."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .paths import is_test_path
from .text import ascii_lower, contains_ascii_ci

# Multiplicative score adjustments and the kinds that count as definitions.
NAME_BOOST = 1.15
DEFINITION_BOOST = 1.10
TEST_PATH_PENALTY = 0.80
DEFINITION_KINDS = ["function", "method", "class", "struct", "enum", "trait", "impl", "interface"]


def normalize_symbol(text: Column) -> Column:
    return F.translate(F.lower(text), "_-", "")


def boost(query: str, name: Column, kind: Column, file_path: Column) -> Column:
    wanted = normalize_symbol(F.lit(query))
    own = normalize_symbol(name)
    # a name made of separators only says nothing about the query
    named = (own != "") & (F.contains(wanted, own) | F.contains(own, wanted))
    return (
        F.when(named, F.lit(NAME_BOOST)).otherwise(F.lit(1.0))
        * F.when(kind.isin(*DEFINITION_KINDS), F.lit(DEFINITION_BOOST)).otherwise(F.lit(1.0))
        * F.when(is_test_path(file_path), F.lit(TEST_PATH_PENALTY)).otherwise(F.lit(1.0))
    )


def is_definition(name: Column, kind: Column, symbol: str) -> Column:
    same = ascii_lower(name) == ascii_lower(F.lit(symbol))
    return F.coalesce(same & kind.isNotNull(), F.lit(False))


def is_reference(name: Column, kind: Column, content: Column, symbol: str) -> Column:
    return ~is_definition(name, kind, symbol) & contains_ascii_ci(content, symbol)
