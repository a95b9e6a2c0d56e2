"""What a payout row's labels and value allow: the kind of option that a label states, and the gate of the row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import collapsed

# Patterns of the words that state an option.
IDCW = "(?i)\\bidcw\\b|\\bincome\\s+distribution\\s+cum\\s+capital\\s+withdrawal\\b"
DIVIDEND = "(?i)\\b(dividend|div)\\b"
BONUS = "(?i)\\bbonus\\b"
GROWTH = "(?i)\\b(growth|cumulative)\\b"
ENDS_IN_DIVIDEND = "(?i)(?:\\bdiv(?:idend)?|\\bidcw)(?:\\s+(?:opt(?:ion)?|payout|reinvestment))?\\s*$"
ENDS_IN_BONUS = "(?i)\\bbonus(?:\\s+option)?\\s*$"
ENDS_IN_GROWTH = "(?i)\\b(?:growth|cumulative)(?:\\s+option)?\\s*$"
PAIR = "(?i)\\bbonus\\b\\s*/\\s*(?:\\bdividend\\b|\\bidcw\\b)"
DIVIDEND_OPTION = "(?i)\\bdividend\\s+(?:opt(?:ion)?|plan|payout|reinvestment)\\b"
EDGE = "[ \\-:;/()\\[\\]]+"
# The gate of each kind of label; and all gates in order.
GATE_OF = {
    "distribution": "cash_amount_candidate",
    "bonus": "explicit_bonus_option",
    "growth_or_cumulative": "explicit_growth_or_cumulative_option",
    "bonus_or_distribution": "ambiguous_bonus_or_distribution_option",
    "conflicting": "conflicting_option_labels",
    "unknown": "unknown_option_label",
}
GATES = (
    "cash_amount_candidate", "unmatched_option_identifier", "non_positive_scalar", "percentage_source_value", "ratio_source_value", "explicit_bonus_option",
    "explicit_growth_or_cumulative_option", "ambiguous_bonus_or_distribution_option", "conflicting_option_labels", "unknown_option_label",
)


# The kind by whether growth, payout and bonus are stated, as a number of three bits.
KINDS = ("unknown", "bonus", "distribution", "bonus_or_distribution", "growth_or_cumulative", "conflicting", "conflicting", "conflicting")


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of a value that is worked out once, however often then names it: a filter that the optimizer moves below repeats no pattern."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def with_option_kind(rows: DataFrame, scheme: str, label: str, kind: str = "kind") -> DataFrame:
    """rows with the kind of option that a label states, and its descriptor.

    The descriptor is what the label says after its scheme's whole name; null where the name does not
    stand before it, or ends inside a word. Words of the scheme's own name count only where no descriptor
    can be told apart, and then only in forms that no proper name has: at the label's end, as a pair, or
    beside the word option. Each step is bound, so that no pattern is matched twice.
    """

    def apart(x: Column) -> Column:
        name, whole = x["name"], x["whole"]
        after = F.substring(whole, F.length(name) + 1, F.length(whole))
        stands = (name != "") & (whole != "") & F.lower(whole).startswith(F.lower(name)) & ~after.rlike("^[\\p{L}\\p{N}]")
        own = F.when(stands, F.regexp_replace(F.regexp_replace(after, f"^{EDGE}", ""), f"{EDGE}$", ""))
        return F.struct(name.alias("name"), whole.alias("whole"), own.alias("own"), F.regexp_replace(whole, f"{EDGE}$", "").alias("end"), whole.rlike(PAIR).alias("pair"))

    def judged(x: Column) -> Column:
        name, whole, own, end, pair = (x[k] for k in ("name", "whole", "own", "end", "pair"))
        told = F.coalesce(own != "", F.lit(False))
        payout = F.when(told, own.rlike(IDCW) | own.rlike(DIVIDEND)).otherwise(
            whole.rlike(IDCW) | (whole.rlike(DIVIDEND) & ~name.rlike(DIVIDEND)) | end.rlike(ENDS_IN_DIVIDEND) | pair | whole.rlike(DIVIDEND_OPTION)
        )
        bonus = F.when(told, own.rlike(BONUS)).otherwise((whole.rlike(BONUS) & ~name.rlike(BONUS)) | end.rlike(ENDS_IN_BONUS) | pair)
        growth = F.when(told, own.rlike(GROWTH)).otherwise((whole.rlike(GROWTH) & ~name.rlike(GROWTH)) | end.rlike(ENDS_IN_GROWTH))
        bit = lambda c: F.coalesce(c, F.lit(False)).cast("int")
        place = bit(growth) * 4 + bit(payout) * 2 + bit(bonus) + 1
        return F.struct(F.element_at(F.array(*map(F.lit, KINDS)), place).alias("kind"), F.when(own != "", own).alias("descriptor"))

    spelled = F.struct(collapsed(F.col(scheme)).alias("name"), collapsed(F.col(label)).alias("whole"))
    said = rows.withColumn("__said", bound(bound(spelled, apart), judged))
    return said.withColumns({kind: F.col("__said.kind"), "descriptor": F.col("__said.descriptor")}).drop("__said")


def gate(known: Column, unit: Column, value: Column, kind: Column) -> Column:
    """The first gate that holds a row of a known or unknown option back, or cash_amount_candidate.

    A scalar without a value, or of a unit other than amount and percentage, has no gate: null.
    """
    by_label = F.element_at(F.create_map(*[F.lit(x) for pair in GATE_OF.items() for x in pair]), kind)
    return (
        F.when(~known, "unmatched_option_identifier").when(unit == "ratio", "ratio_source_value").when(value.isNull(), None)
        .when(value <= 0, "non_positive_scalar").when(unit == "percentage", "percentage_source_value").when(unit == "amount", by_label)
    )
