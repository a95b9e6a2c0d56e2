"""Text rules: white space, classification labels, plans and options, value grammars, hashes and output forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers that feeds print where a value is missing.
MISSING = ["", "-", "--", "NA", "N/A", "N.A.", "na", "n/a"]


def collapsed(text: Column) -> Column:
    """Trimmed, with runs of white space as one blank."""
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def folded(text: Column) -> Column:
    return F.lower(collapsed(text))


# Presentation drift of classification labels and the form that counts, in the order of use.
BRACKETS = (("\\s*\\(\\s*", " ( "), ("\\s*\\)\\s*", " )"))
TERMS = (("(?i)\\b(Equity|Hybrid) Schemes(?=\\s*-)", "$1 Scheme"), ("(?i)\\bMidcap\\b", "Mid Cap"), ("(?i)\\bLarge\\s+and\\s+Mid\\s+Cap\\b", "Large & Mid Cap"))
TERM_MARKS = ("equity schemes -", "hybrid schemes -", "midcap", " large and mid cap")
# How labels of each structure begin, and what marks a product.
STRUCTURES = {"open_ended": "open ended schemes", "close_ended": "close ended schemes", "interval": "interval fund schemes"}
ETF_MARKS = ("exchange traded fund", "gold etf", "other etf", "other  etf")


def replaced(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, *r), rules, text)


def canonical_label(text: Column) -> Column:
    """A classification label without drift of white space, brackets and known terms; its case stays."""
    return replaced(collapsed(replaced(collapsed(text), BRACKETS)), TERMS)


def label_key(text: Column) -> Column:
    """What labels of one classification have in common."""
    return F.lower(canonical_label(text))


def label_id(text: Column) -> Column:
    """The classification's identifier; null for a blank label."""
    return F.when(collapsed(text) != "", F.concat(F.lit("amfi-"), F.substring(F.sha2(label_key(text), 256), 1, 32)))


def label_match(text: Column) -> Column:
    """How a raw label comes to its canonical form: exact, terminology or formatting."""
    shown = canonical_label(text)
    marked = reduce(lambda a, b: a | b, (F.lower(x).contains(m) for x in (text, shown) for m in TERM_MARKS))
    return F.when(collapsed(text) == "", None).when(text == shown, "exact").when(marked, "terminology").otherwise("formatting")


def structure_of(label: Column) -> Column:
    key = label_key(label)
    return reduce(lambda c, x: c.when(key.startswith(x[1]), x[0]), list(STRUCTURES.items())[1:], F.when(key.startswith(STRUCTURES["open_ended"]), "open_ended")).otherwise("other")


def product_of(label: Column) -> Column:
    key = label_key(label)
    etf = reduce(lambda a, b: a | b, (key.contains(m) for m in ETF_MARKS))
    return F.when(etf, "etf").when(key.contains("index fund"), "index_fund").otherwise("mutual_fund")


def spaced(text: Column) -> Column:
    """Lower-cased words apart by one blank, hyphens as blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "-", " "), "\\s+", " "))


def plan_of(name: Column) -> Column:
    words = spaced(name)
    return F.when(words.rlike("\\bdirect\\b"), "direct").when(words.rlike("\\bregular\\b"), "regular").otherwise("unknown")


def option_of(name: Column, *, stated: bool = False) -> Column:
    """The payout option that a scheme's name implies, or that a feed states in a field of its own."""
    words = spaced(name)
    idcw = words.rlike("\\b(idcw|idwc|dcw|dividend)\\b") | words.contains("income distribution") if stated else words.rlike("\\b(idcw|dividend)\\b")
    return F.when(idcw, "idcw").when(words.rlike("\\bgrowth\\b"), "growth").when(words.rlike("\\bbonus\\b"), "bonus").otherwise("unknown")


def plan_and_option(name: Column, plan: Column, option: Column) -> Column:
    """struct(plan, option, method): what the feed states counts before what the name implies."""
    how = lambda c: F.when(c.isNotNull(), "explicit").otherwise("name_heuristic")
    method = F.concat(F.lit("amfi_plan_"), how(plan), F.lit("_option_"), how(option), F.lit("_v1"))
    return F.struct(
        F.when(plan.isNotNull(), plan_of(plan)).otherwise(plan_of(name)).alias("plan"),
        F.when(option.isNotNull(), option_of(option, stated=True)).otherwise(option_of(name)).alias("option"),
        method.alias("method"),
    )


def tokens(text: Column) -> Column:
    """Distinct lower-cased words of letters and digits, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays; two empty ones are not alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def decimal_text(text: Column, kind: str = "decimal(28,10)") -> Column:
    """A number from feed text: thousands commas go, missing markers and junk are null."""
    return F.when(~F.trim(text).isin(MISSING), F.regexp_replace(F.trim(text), ",", "").try_cast(kind))


def date_text(text: Column, formats: tuple[str, ...] = ("dd-MMM-yyyy", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy-MM-dd", "dd MMM yyyy")) -> Column:
    """A date from feed text in any of the formats."""
    return F.coalesce(*[F.try_to_date(F.trim(text), f) for f in formats])


def is_isin(text: Column) -> Column:
    return text.rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$")


NUMBER = "(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)"
# The two forms of a percentage beside an amount.
ANNOTATED = (f"(?i)^({NUMBER})%\\s+\\(Rs\\s+({NUMBER})/-\\s+Per Unit\\)?$", f"(?i)^({NUMBER})%\\s*-\\s*Rs\\s+({NUMBER})\\s+Per Unit$")
RATIO = "^([1-9][0-9]*):([1-9][0-9]*)$"
SCALAR = f"^\\+?({NUMBER}(?:[eE][+-]?[0-9]+)?)\\s*%?$"


def value_grammar(text: Column) -> Column:
    """struct(kind, value, annotated, ratio_from, ratio_to) of a payout text.

    kind is annotated (a percentage beside an amount above zero), ratio, percent, scalar or invalid.
    """
    t = F.trim(text)
    part = lambda p, i: F.regexp_extract(t, p, i).try_cast("decimal(28,10)")
    both = t.rlike(ANNOTATED[0]) | t.rlike(ANNOTATED[1])
    beside = F.coalesce(part(ANNOTATED[0], 2), part(ANNOTATED[1], 2))
    number = part(SCALAR, 1)
    kind = (
        F.when(both, F.when(beside > 0, "annotated").otherwise("invalid")).when(t.rlike(RATIO), "ratio")
        .when(t.rlike(SCALAR) & number.isNotNull(), F.when(t.endswith("%"), "percent").otherwise("scalar")).otherwise("invalid")
    )
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "annotated", F.coalesce(part(ANNOTATED[0], 1), part(ANNOTATED[1], 1))).when(kind.isin("percent", "scalar"), number).alias("value"),
        F.when(kind == "annotated", beside).alias("annotated"),
        F.when(kind == "ratio", F.regexp_extract(t, RATIO, 1).try_cast("long")).alias("ratio_from"),
        F.when(kind == "ratio", F.regexp_extract(t, RATIO, 2).try_cast("long")).alias("ratio_to"),
    )


UNIT_CUTOFF = "2009-04-06"  # scalars up to this day are percentages of face value


def payout_unit(grammar: Column, day: Column) -> Column:
    kind = grammar["kind"]
    old = F.when(day <= F.lit(UNIT_CUTOFF).cast("date"), "percentage").otherwise("amount")
    return F.when(kind == "ratio", "ratio").when(kind.isin("annotated", "percent"), "percentage").when(kind == "scalar", old)


def noise_repaired(value: Column, places: int = 10, residual: float = 1e-12) -> Column:
    """A decimal that a binary float blurred: rounded if the residual is tiny, else null."""
    rounded = F.round(value, places)
    return F.when(F.abs(value - rounded) <= F.lit(residual).cast("decimal(38,18)"), rounded)


def row_hash(*columns: Column) -> Column:
    """sha256 of the values as one text, apart by a separator; null and empty differ."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns]), 256)


def json_hash(*columns: Column) -> Column:
    """sha256 of the values as a compact JSON array of texts; null and empty differ."""
    values = F.transform(F.array(*[c.cast("string") for c in columns]), lambda x: F.when(x.isNull(), "null").otherwise(F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))))
    return F.sha2(F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")), 256)


def trimmed_number(value: Column, places: int = 6) -> Column:
    """A number with at most so many decimals and no trailing zeros."""
    text = F.format_string(f"%.{places}f", value)
    return F.when(value.isNotNull(), F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", ""))


def safe_cell(text: Column) -> Column:
    """A spreadsheet cell that no program takes for a formula."""
    return F.when(text.rlike("^[=+\\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def titled(*parts: Column) -> Column:
    return F.initcap(F.regexp_replace(F.concat_ws(" ", *parts), "_", " "))
