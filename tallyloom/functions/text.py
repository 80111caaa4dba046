"""Text clean-up, shingling and code extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

THINK_BLOCK = r"(?s)<think>.*?</think>"
FENCED_BLOCK = r"(?s)```(?:python|py)?\s*\n(.*?)(?:```|\z)"
FIRST_CODE_LINE = r"(?s)(?:\A|\n)((?:def |import |from |@).*)\z"

# Fixed patterns of the heuristic personal-data scan (not a compliance-grade scan).
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "phone": r"\+?[0-9]{1,3}[ -][0-9]{3}[ -][0-9]{3}[ -][0-9]{4}\b",
    "card": r"\b[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}\b",
    "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
}


def strip_think(text: Column, keep: bool = False) -> Column:
    return text if keep else F.regexp_replace(text, THINK_BLOCK, "")


def has_closed_think(text: Column) -> Column:
    return F.rlike(text, F.lit(THINK_BLOCK))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bind(value: Column, use) -> Column:
    """use(value) with `value` computed once per row, however often `use` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingles(text: Column, n: int = 3, unit: str = "word") -> Column:
    """Sorted distinct 64-bit hashes of the text's n-grams; a shorter text is one gram, an empty one none."""
    if unit == "word":
        items = words(text)
    elif unit == "char":
        items = F.split(F.lower(text), "")
    else:
        raise ValueError(f"unit must be word or char, got {unit!r}")

    def grams(parts: Column) -> Column:
        starts = F.when(
            F.size(parts) >= n, F.sequence(F.lit(0), F.size(parts) - n)
        ).otherwise(F.array().cast("array<int>"))
        hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(parts, i + k) for k in range(n)]))
        whole = F.array(F.xxhash64(F.array_join(parts, " "), F.size(parts)))
        short = (F.size(parts) > 0) & (F.size(parts) < n) & (F.array_join(parts, "") != "")
        return F.when(short, whole).otherwise(F.sort_array(F.array_distinct(hashed)))

    return bind(items, grams)


def has_shingles(text: Column, unit: str = "word") -> Column:
    """Whether `shingles` gives any, without making them."""
    return F.rlike(F.lower(text), F.lit(r"[\p{L}\p{N}]")) if unit == "word" else text != ""


def extract_code(text: Column, function: str = "transform") -> Column:
    """Source in a model answer: first fenced block, else from the first code line on.

    Null unless it defines `function`; a null is a format failure, not a wrong answer.
    """
    answer = strip_think(text)
    fenced = F.rlike(answer, F.lit(FENCED_BLOCK))
    candidate = F.when(fenced, F.regexp_extract(answer, FENCED_BLOCK, 1)).otherwise(
        F.regexp_extract(answer, FIRST_CODE_LINE, 1)
    )
    return F.when(F.rlike(candidate, F.lit(rf"(?m)^\s*def {function}\s*\(")), candidate)


def scrub_pii(text: Column, patterns: dict[str, str] = PII_PATTERNS) -> Column:
    for name, pattern in patterns.items():
        text = F.regexp_replace(text, pattern, f"[{name.upper()}]")
    return text


def count_pii(text: Column, patterns: dict[str, str] = PII_PATTERNS) -> dict[str, Column]:
    return {
        name: F.regexp_count(text, F.lit(pattern)).cast("long")
        for name, pattern in patterns.items()
    }


def trim(value: Column) -> Column:
    """Strip any whitespace, not only blanks."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")
