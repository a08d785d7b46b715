"""Text, identifier and citation expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that count as white space, spelled out because engines differ.
SPACES = r"[\x09-\x0D\x1C-\x20\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: Fixed value: labels such as ``E Art. 5.2`` or ``B Rec. 12``.
LABEL = r"^([A-Z]+) (Art|Rec)\. ([0-9A-Za-z.]+)$"


def clean_text(text: Column) -> Column:
    """Null becomes empty, runs of white space one space, ends are stripped."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))


def joined(*parts: Column) -> Column:
    """Non-empty parts joined by a space and cleaned."""
    return clean_text(F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts)))


def answer_unit(label: Column) -> Column:
    """The article or recital of a label; an article's number is cut at its first point. Other labels are an error."""
    kind, number = F.regexp_extract(label, LABEL, 2), F.regexp_extract(label, LABEL, 3)
    cut = F.when(kind == "Art", F.split(number, r"\.")[0]).otherwise(number)
    made = F.concat(F.regexp_extract(label, LABEL, 1), F.lit(" "), kind, F.lit(". "), cut)
    return F.when(label.rlike(LABEL), made).otherwise(F.raise_error(F.concat(F.lit("not a unit label: "), label)))


def chunk_id(config: Column, unit: Column) -> Column:
    """Configuration and unit, with runs of other than letters and digits as one underscore and none at the ends."""
    return F.concat(config, F.lit("_"), F.regexp_replace(F.regexp_replace(unit, r"[^0-9A-Za-z]+", "_"), r"^_+|_+$", ""))


def source_document(unit: Column) -> Column:
    return F.split_part(unit, F.lit(" "), F.lit(1))


def band(score: Column) -> Column:
    """low below 0.5, mid below 0.8, high up to 1; anything else is an error."""
    return (
        F.when((score >= 0) & (score < 0.5), "low").when((score >= 0.5) & (score < 0.8), "mid").when((score >= 0.8) & (score <= 1), "high")
        .otherwise(F.raise_error(F.lit("score outside 0 to 1")))
    )


def coverage_band(share: Column) -> Column:
    return F.when(share == 0, "zero").when(share <= 0.5, "up_to_half").when(share < 1, "over_half").otherwise("full")


def bounded(score: Column) -> Column:
    """A number in 0 to 1; not-a-number is an error."""
    return F.when(F.isnan(score), F.raise_error(F.lit("not a number"))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def csv_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def passage(place: Column, unit: Column, text: Column) -> Column:
    return F.concat(F.lit("["), place.cast("string"), F.lit("] Reference: "), unit, F.lit("\n"), text)
