"""What scheme and fund names have in common across sources: core words, plans, variants, frequencies, short labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapsed, replaced

# Spellings that registrars use, and words that do not tell schemes apart.
REGISTRAR_SPELLINGS = (
    ("(?is)\\b(?:formerly(?:\\s+known\\s+as)?|erstwhile)\\b.*$", ""),
    ("(?i)^\\s*(?:aditya\\s+)?birla\\s+sun\\s+life\\b", "ABSL"),
    ("\\+", " plus "),
    ("(?i)\\bre[\\s_-]+inv(?:e(?:st(?:ment)?)?)?\\b", " "),
    ("(?i)\\b(?:qidcw|qly|qtly)\\b", "quarterly"),
    ("(?i)\\bhalfyerarly\\b", "half yearly"),
    ("(?i)\\bsep(?:t)?\\b", "september"),
    ("(?i)\\bindex\\s+fund\\b", "index"),
)
REGISTRAR_STOP = (
    "direct regular plan option idcw dividend payout reinvestment reinvest reinv reinve exchange exch ex re rein dir reg pl and the income distribution cum capital withdrawal"
).split()
# The same of a third party.
THIRD_PARTY_WORDS = {
    "advtg": "advantage", "dir": "direct", "fortn": "fortnightly", "gr": "growth", "hly": "halfyearly", "mkt": "market", "mly": "monthly", "qly": "quarterly", "reg": "regular", "wly": "weekly",
}
THIRD_PARTY_STOP = (
    "annual daily direct fortnightly fund halfyearly regular plan option idcw dividend monthly payout quarterly reinvestment reinvest reinv weekly"
).split()
FREQUENCY_WORDS = {
    "annual": "annual", "annually": "annual", "daily": "daily", "fortn": "fortnightly", "fortnightly": "fortnightly", "hly": "half_yearly", "monthly": "monthly",
    "mly": "monthly", "qly": "quarterly", "quarterly": "quarterly", "weekly": "weekly", "wly": "weekly",
}
# The wrapper of classification labels, and prefixes before a leaf's own name.
WRAPPER = "(?i)^(?:Open Ended Schemes|Close Ended Schemes|Interval Fund Schemes)\\s*\\(\\s*(.*?)\\s*\\)$"
LEAF_PREFIXES = (
    "children", "debt scheme", "equity scheme", "exchange traded funds", "fund of funds scheme", "hybrid scheme", "income/debt oriented schemes", "index funds",
    "life cycle funds", "other scheme", "overseas fund of funds", "solution oriented scheme", "solution oriented schemes",
)


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def mapped(table: dict[str, str], word: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), word)


def registrar_core(name: Column) -> Column:
    """A scheme's name as registrars and the catalogue share it."""
    return F.array_join(F.filter(words(replaced(name, REGISTRAR_SPELLINGS)), lambda w: ~w.isin(REGISTRAR_STOP)), " ")


def third_party_core(name: Column) -> Column:
    full = F.transform(words(name), lambda w: F.coalesce(mapped(THIRD_PARTY_WORDS, w), w))
    return F.array_join(F.filter(full, lambda w: ~w.isin(THIRD_PARTY_STOP)), " ")


def house_core(name: Column) -> Column:
    return F.array_join(F.filter(words(name), lambda w: ~w.isin("mutual", "fund")), " ")


def registrar_plan(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("direct"), "direct").when(low.rlike("regular|retail|institutional"), "regular").otherwise("unknown")


def registrar_variant(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("reinvest"), "reinvestment").when(low.rlike("payout|idcw|dividend"), "payout").otherwise("unknown")


def third_party_plan(*names: Column) -> Column:
    low = F.concat(F.lit(" "), F.lower(F.concat_ws(" ", *names)), F.lit(" "))
    direct, regular = low.rlike(" (direct|dir) "), low.rlike(" (regular|reg) ")
    return F.when(direct & regular, "unknown").when(direct, "direct").when(regular, "regular").otherwise("unknown")


def third_party_variant(*names: Column) -> Column:
    found = words(F.concat_ws(" ", *names))
    again = F.exists(found, lambda w: w.startswith("reinvest") | (w == "reinv"))
    paid = F.exists(found, lambda w: w.isin("pay", "payment", "payout"))
    return F.when(again & paid, "mixed").when(again, "reinvestment").when(paid, "payout").otherwise("unknown")


def third_party_frequency(name: Column) -> Column:
    """The one frequency that a name states, multiple or unknown."""
    found = words(name)
    kinds = F.filter(F.transform(found, lambda w: mapped(FREQUENCY_WORDS, w)), lambda k: k.isNotNull())
    half = F.when(F.array_join(found, " ").rlike("half yearly|halfyearly"), F.array(F.lit("half_yearly"))).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(kinds, half))
    return F.when(F.size(every) > 1, "multiple").when(F.size(every) == 1, F.get(every, 0)).otherwise("unknown")


def plans_agree(a: Column, b: Column) -> Column:
    return (a == "unknown") | (b == "unknown") | (a == b)


def qualifiers_agree(variant: Column, frequency: Column, other_variant: Column, other_frequency: Column) -> Column:
    """Whether stated variants and frequencies do not contradict each other."""
    vague = lambda c, *x: c.isin("unknown", *x)
    return (vague(variant, "mixed") | vague(other_variant, "mixed") | (variant == other_variant)) & (
        vague(frequency, "multiple") | vague(other_frequency, "multiple") | (frequency == other_frequency)
    )


def context_name(label: Column) -> Column:
    """A classification label without the wrapper of its structure."""
    whole = collapsed(label)
    return collapsed(F.when(whole.rlike(WRAPPER), F.regexp_extract(whole, WRAPPER, 1)).otherwise(whole))


def short_name(label: Column) -> Column:
    """The leaf of a classification label."""
    inner = context_name(label)
    behind = F.regexp_replace(inner, "^.*?\\)\\s*-\\s*", "")
    leaf = F.when(behind != inner, behind).otherwise(F.regexp_replace(inner, "^[^-]+\\s+-\\s+", ""))
    prefixed = reduce(lambda a, b: a | b, (F.lower(inner).startswith(p) for p in LEAF_PREFIXES))
    shown = F.when(prefixed, leaf).otherwise(inner)
    return collapsed(replaced(shown, (("\\s*\\(\\s*", " ("), ("\\s*\\)\\s*", ")"))))
