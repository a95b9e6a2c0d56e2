"""Instruments and their listings over time: who a price belongs to, and what a day adds to the tables.

An instrument is (provider, kind, identifier, name, family, isin, symbol, series); an exchange-traded one is
told by its ISIN, an index by its trading name and the kind of its values. A listing is (exchange, security_id, isin,
symbol, series) of an instrument, whose key is its ISIN here. Security ids are given to others in time, so several listings
of one id stay apart and then say nothing about a price.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INSTRUMENT = "provider string, kind string, identifier string, name string, family string, isin string, symbol string, series string"
LISTING = "exchange string, security_id string, isin string, symbol string, series string"
# Kinds of an index's instruments and what their names end in; the family of a listing without category.
INDEX_KINDS = {"price_index": "", "gross_total_return_index": " TRI", "net_total_return_index": " NTR"}
NO_CATEGORY = "BSE ETF (underlying not published in market watch)"
LABELS = ("name", "family", "symbol")


def merged(stored: DataFrame, found: DataFrame, key: list[str], overwrite: tuple[str, ...] = ()) -> DataFrame:
    """stored with the found of new keys; of known ones only the columns of overwrite are taken over."""
    rest = [c for c in stored.columns if c not in key]
    both = stored.select(*key, F.struct(*rest).alias("__old")).join(found.select(*key, F.struct(*rest).alias("__new")), key, "full")
    pick = lambda c: F.when(F.col("__old").isNull() | (F.lit(c in overwrite) & F.col("__new").isNotNull()), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}"))
    return both.select(*[F.col(c) if c in key else pick(c).alias(c) for c in stored.columns])


def with_indices(instruments: DataFrame, indices: DataFrame) -> DataFrame:
    """instruments with the three of each index (trading_name, display_name): known ones stay as they are."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("suffix")) for k, v in INDEX_KINDS.items()])).alias("k")
    found = indices.dropDuplicates(["trading_name"]).select("trading_name", "display_name", kinds).select(
        F.lit("nifty_indices").alias("provider"), F.col("k.kind").alias("kind"), F.col("trading_name").alias("identifier"), F.concat("display_name", "k.suffix").alias("name"), F.col("display_name").alias("family"),
        *[F.lit(None).cast("string").alias(c) for c in ("isin", "symbol", "series")],
    )
    return merged(instruments, found, ["provider", "kind", "identifier"])


def by_isin(instruments: DataFrame, found: DataFrame, overwrite: tuple[str, ...]) -> DataFrame:
    """instruments with exchange-traded ones of found merged by ISIN."""
    etf = F.col("kind") == "etf"
    return instruments.where(~etf).unionByName(merged(instruments.where(etf), found.select(*instruments.columns), ["isin"], overwrite))


def with_master(instruments: DataFrame, master: DataFrame) -> DataFrame:
    """instruments with those of the listing file (isin, name, underlying, symbol), whose labels hold from now on."""
    found = master.dropDuplicates(["isin"]).select(
        F.lit("nse").alias("provider"), F.lit("etf").alias("kind"), F.col("isin").alias("identifier"), "name", F.col("underlying").alias("family"), "isin", "symbol", F.lit(None).cast("string").alias("series")
    )
    return by_isin(instruments, found, LABELS)


def with_daily(instruments: DataFrame, daily: DataFrame) -> DataFrame:
    """instruments with those of the membership file's rows that have an ISIN (isin, name, underlying, symbol, series); known ones stay as they are."""
    found = daily.where("isin is not null").dropDuplicates(["isin"]).select(
        F.lit("nse").alias("provider"), F.lit("etf").alias("kind"), F.col("isin").alias("identifier"), "name", F.col("underlying").alias("family"), "isin", "symbol", "series"
    )
    return by_isin(instruments, found, ())


def resolved(prices: DataFrame, instruments: DataFrame, listings: DataFrame, roster: DataFrame) -> DataFrame:
    """prices (exchange, security_id, isin, symbol, series, d) with instrument (an ISIN), identity, found_by and issue.

    A price's instrument is that of its ISIN, else that of the only listing of its security id, else,
    if the roster has the security id and the price an ISIN, one made for that ISIN. The roster (security_id, name,
    category, alias, day) is of one day: an identity is official if the roster has the security id and is of the price's day,
    whatever has found the instrument, else provisional. Of the prices without an instrument those on the roster are
    unresolved; others are not exchange-traded funds and have no identity.
    """
    known = instruments.where("kind = 'etf' and isin is not null").select("isin", F.col("isin").alias("__i1")).distinct()
    one = listings.groupBy("exchange", "security_id").agg(F.count("*").alias("n"), F.max("isin").alias("__i2")).where("n = 1").drop("n")
    listed = roster.groupBy("security_id").agg(F.max("day").alias("__day"))
    out = prices.join(known, "isin", "left").join(one, ["exchange", "security_id"], "left").join(listed, "security_id", "left")
    on = F.col("__day").isNotNull()
    made = F.when(on, F.col("isin"))
    instrument = F.coalesce("__i1", "__i2", made)
    by = F.when(F.col("__i1").isNotNull(), "isin").when(F.col("__i2").isNotNull(), "listing").when(made.isNotNull(), "roster")
    identity = F.when(instrument.isNull(), F.when(on, "identity_unresolved")).when(on & (F.col("__day") == F.col("d")), "official").otherwise("provisional_current_mapping")
    return out.withColumns({"instrument": instrument, "found_by": by, "identity": identity, "issue": F.when(instrument.isNull() & on, "identity_unresolved")}).drop("__i1", "__i2", "__day")


def with_roster(instruments: DataFrame, told: DataFrame, roster: DataFrame) -> DataFrame:
    """instruments with those that ``resolved`` has made, under the roster's names; of several rows of an ISIN the first by security id and day counts."""
    first = told.where("found_by = 'roster'").groupBy("isin").agg(F.min(F.struct("security_id", "d", "series")).alias("x")).select("isin", "x.security_id", "x.series")
    names = roster.groupBy("security_id").agg(F.max(F.struct("day", "name", "category", "alias")).alias("r"))
    found = first.join(names, "security_id").select(
        F.lit("bse").alias("provider"), F.lit("etf").alias("kind"), F.col("security_id").alias("identifier"), F.col("r.name").alias("name"),
        F.when(F.col("r.category").isNotNull(), F.concat(F.lit("BSE "), "r.category", F.lit(" ETF"))).otherwise(NO_CATEGORY).alias("family"), "isin", F.col("r.alias").alias("symbol"), "series",
    )
    return by_isin(instruments, found, ())


def with_prices(listings: DataFrame, told: DataFrame) -> DataFrame:
    """listings with those of resolved prices that have an ISIN: (exchange, security_id, instrument) is the key, the latest day's labels hold."""
    rows = told.where("instrument is not null and isin is not null").groupBy("exchange", "security_id", "instrument").agg(F.max(F.struct("d", "symbol", "series")).alias("x"))
    found = rows.select("exchange", "security_id", F.col("instrument").alias("isin"), "x.symbol", "x.series")
    return merged(listings, found, ["exchange", "security_id", "isin"], ("symbol", "series"))


def identity_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """exchange, security_id, isin and prior (the other ISINs so far, in order) of listings that are new under an id that others had."""
    new = after.join(before, ["exchange", "security_id", "isin"], "left_anti").select("exchange", "security_id", "isin")
    prior = before.groupBy("exchange", "security_id").agg(F.array_join(F.sort_array(F.collect_set("isin")), "|").alias("prior"))
    return new.join(prior, ["exchange", "security_id"])
