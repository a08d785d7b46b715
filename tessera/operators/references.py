"""References between units and citations of units, with their places in the text.

Matches and their places come from two built-in expressions: what a pattern matches,
and what lies between its matches. The lengths of both, added up, are the places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The patterns of references between units.
NUMBER = r"\d+[a-z]?"
LIST_ITEM = r"\d+[a-z]?(?:\(\d+\))?"
BETWEEN = r"\s*(?:,|\band\b|\bor\b)\s*"
RANGE = r"(?i)\bArticles\s+(\d+)\s+(?:to|-)\s+(\d+)"
LIST = rf"(?i)\bArticles\s+({LIST_ITEM}(?:{BETWEEN}{LIST_ITEM})+)"
SINGLE = r"(?i)\bArticle\s+(\d+[a-z]?)(?:\((\d+)\))?(?:\(([a-z])\))?"
RECITALS = rf"(?i)\brecitals\s+(\d+(?:{BETWEEN}\d+)+)"
RECITAL = r"(?i)\brecital\s+(\d+)"
PARAGRAPH = r"(?i)\bparagraphs?\s+(\d+)"
#: Words by which a reference is to another instrument, words that take this back, and the characters in which they are looked for.
EXTERNAL = r"(?i)\b(Directive|Treaty|TFEU|TEU|Convention|Charter|Decision\s+\d|Regulation\s+\([A-Z]{2,}\))\b"
OWN = r"(?i)\b(of\s+)?this\s+(Regulation|Framework Decision)\b"
BEFORE, AFTER, OWN_AFTER = 80, 100, 80
#: Fixed value: the longest range that is expanded.
LONGEST_RANGE = 50

#: The patterns of citations in answers; a document code may stand in front.
CITED_NUMBER = r"\d+[a-zA-Z]?(?:\.\d+[a-zA-Z]?)*(?:\s*\([0-9a-zA-Z]+\))*"
CITED = r"(?i)\b(?:({codes})\s+)?(Art\.?|Article|Rec\.?|Recital)\s*(" + CITED_NUMBER + ")"
CITED_LIST = r"(?i)\b(?:({codes})\s+)?(Articles?|Arts?\.?|Recitals?|Recs?\.?)\s+(" + CITED_NUMBER + r"(?:(?:\s*,\s*(?:and\s+|or\s+)?|\s+(?:and|or)\s+)" + CITED_NUMBER + ")+)"


def places(text: Column, pattern: str) -> Column:
    """Every match of ``pattern`` as ``raw, start, stop``, in order; the work grows with the square of the matches in one text."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def length(parts: Column, n: Column) -> Column:
        return F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda s, x: s + F.length(x))

    def place(raw: Column, i: Column) -> Column:
        start = length(gaps, i + 1) + length(found, i)
        return F.struct(raw.alias("raw"), start.alias("start"), (start + F.length(raw)).alias("stop"))

    return F.coalesce(F.transform(found, place), F.array().cast("array<struct<raw:string,start:int,stop:int>>"))


def _targets(kind: str, raw: Column) -> Column:
    """The ends of the ids that a match names: article numbers with paragraph and point, or recitals."""
    if kind == "range_expanded":
        low, high = (F.regexp_extract(raw, RANGE, n).cast("int") for n in (1, 2))
        numbers = F.when((high >= low) & (high - low <= LONGEST_RANGE), F.transform(F.sequence(low, high), lambda n: n.cast("string")))
        return F.transform(F.coalesce(numbers, F.array().cast("array<string>")), lambda n: F.concat(F.lit("Art. "), n))
    if kind == "list":
        items = F.regexp_extract_all(F.regexp_extract(raw, LIST, 1), F.lit("(?i)" + LIST_ITEM), F.lit(0))
        return F.transform(items, lambda x: F.concat(F.lit("Art. "), F.regexp_replace(F.regexp_replace(x, r"\(", "."), r"\)", "")))
    if kind == "single":
        parts = F.array(*(F.nullif(F.regexp_extract(raw, SINGLE, n), F.lit("")) for n in (1, 2, 3)))
        return F.array(F.concat(F.lit("Art. "), F.array_join(parts, ".")))
    if kind == "recitals":
        return F.transform(F.regexp_extract_all(raw, F.lit(r"\d+"), F.lit(0)), lambda n: F.concat(F.lit("Rec. "), n))
    if kind == "recital":
        return F.array(F.concat(F.lit("Rec. "), F.regexp_extract(raw, RECITAL, 1)))
    return F.array(F.concat(F.lit("."), F.regexp_extract(raw, PARAGRAPH, 1)))


def normalized(unit: Column) -> Column:
    """The article or recital of an id: an article's number is cut at its first point."""
    return F.regexp_replace(unit, r"^([A-Z]+ Art\. [^.]+)\..*$", "$1")


def candidates(units: DataFrame, *, id_col: str = "unit_id", text_col: str = "text") -> DataFrame:
    """``id_col, kind, raw, start, stop, targets, external``: every reference in the text of a unit.

    Six families are looked for, each over the whole text, so matches of two may
    overlap. Paragraphs without an article count in units of an article only. A
    reference is external if another instrument is named nearby, unless the act
    itself is named close behind it. Null texts have none.
    """
    text = F.col(text_col)
    families = [("range_expanded", "range_expanded", RANGE), ("list", "list_expanded", LIST), ("single", "single", SINGLE), ("recitals", "list_expanded", RECITALS), ("recital", "recital", RECITAL), ("relative", "relative_paragraph", PARAGRAPH)]
    none = F.array().cast("array<struct<raw:string,start:int,stop:int>>")

    def family(name: str, kind: str, pattern: str) -> Column:
        found = places(text, pattern)
        if name == "relative":
            found = F.when(F.contains(F.col(id_col), F.lit(" Art. ")), found).otherwise(none)
        return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["raw"].alias("raw"), m["start"].alias("start"), m["stop"].alias("stop"), _targets(name, m["raw"]).alias("targets")))

    each = F.concat(*(family(*f) for f in families))
    rows = units.select(id_col, text_col, F.explode(each).alias("m")).select(id_col, text_col, "m.*")
    behind = F.substr(text, F.col("stop") + 1, F.lit(OWN_AFTER))
    first = F.greatest(F.lit(0), F.col("start") - BEFORE)
    window = F.substr(text, first + 1, F.col("stop") + AFTER - first)
    return rows.withColumn("external", ~behind.rlike(OWN) & window.rlike(EXTERNAL)).drop(text_col)


def edges(found: DataFrame, known: DataFrame, *, id_col: str = "unit_id") -> DataFrame:
    """``source, target, target_normalized, kind, raw``: references that lead to a unit of ``known`` (``unit_id``).

    External references are left out. An id that is not known gives way to its
    article, if that is. Of equal references of one source to one target the first
    in the text counts; references of a unit to its own article do not.
    """
    document = F.split_part(id_col, F.lit(" "), F.lit(1))
    own = normalized(F.col(id_col))
    target = F.when(F.startswith("end", F.lit(".")), F.concat(own, "end")).otherwise(F.concat(document, F.lit(" "), "end"))
    named = found.where(~F.col("external")).select("*", F.explode("targets").alias("end")).select(F.col(id_col).alias("source"), "kind", "raw", "start", "stop", own.alias("own"), target.alias("named"))
    named = named.withColumn("article", normalized(F.col("named")))
    exact = known.select(F.col("unit_id").alias("named"), F.lit(True).alias("exact"))
    article = known.select(F.col("unit_id").alias("article"), F.lit(True).alias("near"))
    led = named.join(exact, "named", "left").join(article, "article", "left").withColumn("target", F.when(F.col("exact"), F.col("named")).when(F.col("near"), F.col("article")))
    kept = led.where("target IS NOT NULL").withColumn("target_normalized", normalized(F.col("target"))).where("target_normalized <> own")
    first = kept.groupBy("source", "target", "raw").agg(F.min_by(F.struct("target_normalized", "kind"), F.struct("start", "stop")).alias("m"))
    return first.select("source", "target", "m.target_normalized", "m.kind", "raw")


def citations(answers: DataFrame, codes: list[str], known: DataFrame | None = None, *, id_col: str = "answer_id", text_col: str = "text", allowed_col: str = "allowed") -> DataFrame:
    """``id_col, place, raw, unit, inferred``: the legal citations of a text in order of ``place``.

    Lists are found first and give one citation an item; single citations inside a
    list are not counted again, and ranges are not expanded. A number is cut at its
    first point or bracket. A citation without a document takes the only allowed one,
    or the only allowed one that has such a unit in ``known``; else ``unit`` is null.
    """
    text, joined = F.col(text_col), "|".join(codes)
    single, many = CITED.format(codes=joined), CITED_LIST.format(codes=joined)

    def read(m: Column, pattern: str, number: Column, place: Column) -> Column:
        kind = F.when(F.startswith(F.lower(F.regexp_extract(m["raw"], pattern, 2)), F.lit("art")), "Art").otherwise("Rec")
        cut = F.regexp_extract(F.regexp_replace(number, r"\s+", ""), r"^([^.(]*)", 1)
        document = F.nullif(F.regexp_extract(m["raw"], pattern, 1), F.lit(""))
        return F.struct(place.alias("place"), F.trim(m["raw"]).alias("raw"), document.alias("document"), F.concat(kind, F.lit(". "), cut).alias("end"))

    def items(m: Column) -> Column:
        body = F.regexp_extract(m["raw"], many, 3)
        return F.transform(places(body, CITED_NUMBER), lambda x: read(m, many, x["raw"], m["stop"] - F.length(body) + x["start"]))

    rows = answers.select(id_col, allowed_col, text_col, places(text, many).alias("lists"))
    alone = F.filter(places(text, single), lambda s: ~F.exists("lists", lambda m: (m["start"] <= s["start"]) & (s["stop"] <= m["stop"])))
    every = F.concat(F.flatten(F.transform("lists", items)), F.transform(alone, lambda s: read(s, single, F.regexp_extract(s["raw"], single, 3), s["start"])))
    found = rows.select(id_col, allowed_col, F.explode(every).alias("c")).select(id_col, F.array_distinct(allowed_col).alias("allowed"), "c.*")
    only = F.when(F.size("allowed") == 1, F.col("allowed")[0])
    if known is not None:
        # One row a citation without a document; the allowed documents that have the unit.
        open_ = found.where("document IS NULL AND size(allowed) > 1").select("end", F.explode("allowed").alias("code"), "allowed").distinct()
        units = known.select(F.col("unit_id").alias("unit"))
        fits = open_.withColumn("unit", F.concat("code", F.lit(" "), "end")).join(units, "unit").groupBy("end", "allowed").agg(F.count(F.lit(1)).alias("m"), F.first("code").alias("fit"))
        found = found.join(fits.where("m = 1").drop("m"), ["end", "allowed"], "left")
        only = F.coalesce(only, F.col("fit"))
    code = F.coalesce("document", only)
    return found.select(id_col, "place", "raw", F.concat(code, F.lit(" "), "end").alias("unit"), (F.col("document").isNull() & code.isNotNull()).alias("inferred"))


def citation_order(found: DataFrame, id_col: str = "answer_id") -> DataFrame:
    return found.withColumn("number", F.row_number().over(W.partitionBy(id_col).orderBy("place")))
