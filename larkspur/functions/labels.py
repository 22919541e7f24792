"""Values as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are written in capitals.
ACRONYMS = ["ok", "json", "ld", "rss", "api", "html", "hr", "uk", "soc", "rqf", "fte", "nhs"]


def money(amount: Column) -> Column:
    """STR-29: whole pounds; a dash for none."""
    return F.coalesce(F.concat(F.lit("£"), F.format_number(amount, 0)), F.lit("—"))


def salary_range(low: Column, high: Column) -> Column:
    """STR-29: a floor or ceiling of nothing is none."""
    low, high = F.nullif(low, F.lit(0)), F.nullif(high, F.lit(0))
    return (
        F.when(low.isNotNull() & high.isNotNull(), F.when(low == high, money(low)).otherwise(F.concat(money(low), F.lit(" – "), money(high))))
        .when(high.isNotNull(), F.concat(F.lit("Up to "), money(high))).when(low.isNotNull(), F.concat(F.lit("From "), money(low))).otherwise("—")
    )


def humanise(value: Column) -> Column:
    """STR-29: words of a constant's name, the first with a capital, acronyms in capitals."""
    words = F.filter(F.split(F.lower(value), r"[_\s]+"), lambda w: w != "")
    said = F.transform(words, lambda w, k: F.when(w.isin(ACRONYMS), F.upper(w)).when(k == 0, F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))).otherwise(w))
    return F.array_join(said, " ")


def truncate(value: Column, limit: int) -> Column:
    """STR-29: cut at the last space if that is beyond three fifths of the limit, with an ellipsis."""
    cut = F.substring(value, 1, limit)
    at = F.length(cut) - F.locate(" ", F.reverse(cut))  # characters before the last space
    whole = F.when((F.locate(" ", F.reverse(cut)) > 0) & (at > limit * 0.6), F.substring(cut, F.lit(1), at)).otherwise(cut)
    return F.when(F.length(value) <= limit, value).otherwise(F.concat(F.rtrim(whole), F.lit("…")))
