"""Text normalisers as native Column expressions.

NFKC has no Spark built-in. Characters that NFKC folds to plate characters (letters, digits,
separators and spaces: full-width forms, circled and mathematical letters, unit signs, ligatures,
Roman numerals, ...) are found from ``unicodedata`` by rule. Those that become one character are
applied with ``translate``. Those that become several are looked up character by character in a
map, only in texts that hold one. Every other effect of NFKC (composed letters, reordered marks)
leaves a character that is no plate character, before and after, so the verdict is the same.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INVALID_REG_NO = "ERROR_REG_NO"
# Separators removed from plates, and the two valid plate shapes.
PLATE_SEPARATORS = "-‐‑–‒—―."
PLATE_PATTERN = r"^[A-Z0-9]{1,2}[A-Z]{1,3}\d{3,6}[A-Z]?$"
FOREIGN_PLATE_PATTERN = r"^\d{5}(NN|NG|QT|CV)\d{2}$"
_PLATE_ALPHABET = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789 " + PLATE_SEPARATORS)


@lru_cache(maxsize=1)
def nfkc_table() -> dict[str, str]:
    """Every non-ASCII character whose NFKC form consists of characters of the plate alphabet."""
    out = {}
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        if not 0xD800 <= cp <= 0xDFFF and (n := unicodedata.normalize("NFKC", ch)) != ch and _PLATE_ALPHABET.issuperset(n):
            out[ch] = n
    return out


def nfkc_fold(c: Column) -> Column:
    table = nfkc_table()
    single = {k: v for k, v in table.items() if len(v) == 1}
    several = {k: v for k, v in table.items() if len(v) > 1}
    wide = F.create_map(*[F.lit(x) for kv in several.items() for x in kv])
    # one lookup a character is the longest match: no folded form depends on a character's neighbours
    spelled = F.array_join(F.transform(F.split(c, ""), lambda ch: F.coalesce(F.element_at(wide, ch), ch)), "")
    held = c.rlike("[" + "".join(several) + "]")
    return F.translate(F.when(held, spelled).otherwise(c), "".join(single), "".join(single.values()))


def standardize_reg_no(c: Column) -> Column:
    """null/blank → ERROR_REG_NO; trim, upper, NFKC, drop dashes/dots and all whitespace;
    keep it if it matches one of the plate shapes, else ERROR_REG_NO."""
    s = c.cast("string")
    trimmed = F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    x = nfkc_fold(F.upper(trimmed))
    x = F.regexp_replace(x, "[" + PLATE_SEPARATORS.replace("-", r"\-").replace(".", r"\.") + "]", "")
    x = F.regexp_replace(x, r"(?U)\s+", "")
    valid = x.rlike("(?U)" + PLATE_PATTERN) | x.rlike("(?U)" + FOREIGN_PLATE_PATTERN)
    return (F.when(s.isNull() | (trimmed == ""), F.lit(INVALID_REG_NO))
             .when(valid, x).otherwise(F.lit(INVALID_REG_NO)))


def coverage_prefix(c: Column) -> Column:
    """Prefix ``0`` unless the text already starts with ``0`` followed by a character."""
    s = c.cast("string")
    return F.when(s.rlike("^0."), s).otherwise(F.concat(F.lit("0"), s))


def coverage_codes(settings: DataFrame) -> DataFrame:
    """From settings rows (standard_name, import_name, variable_type, ordinal) of type
    VARS_AC: code ``AC\\d+`` from the standard name → description from the import name with the
    ``NUM_CLAIMS_`` / ``CLAIM_PMT_`` prefix removed; identical description skipped; the last row
    per code wins; sorted by code."""
    s = settings.filter(F.col("variable_type") == "VARS_AC")
    code = F.regexp_extract(F.col("standard_name"), r"(AC\d+)", 1)
    desc = F.regexp_replace(F.col("import_name"), r"^(NUM_CLAIMS_|CLAIM_PMT_)", "")
    s = s.withColumns({"code": code, "description": desc}).filter((F.col("code") != "") & (F.col("description") != F.col("code")))
    return (s.groupBy("code").agg(F.max_by("description", "ordinal").alias("description"))
             .orderBy("code"))
