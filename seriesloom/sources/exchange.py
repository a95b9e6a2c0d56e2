"""Daily files of exchanges: price files in their layouts over time, rosters of exchange-traded funds, identities.

A file is a row (source, exchange, day, payload): the exchange and day that were asked for. Every row of
a layout is typed and checked as its form demands; the first thing that breaks it is its error.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import bound
from .feeds import AMOUNT, blank

UNIFIED_FROM, ISIN_FROM = "2024-07-08", "2011-06-22"
# The columns of each layout, in the files' own names and order.
LEGACY = ["SYMBOL", "SERIES", "OPEN", "HIGH", "LOW", "CLOSE", "LAST", "PREVCLOSE", "TOTTRDQTY", "TOTTRDVAL", "TIMESTAMP", "TOTALTRADES", "ISIN"]
LAYOUTS = {
    "unified": (
        "TradDt BizDt Sgmt Src FinInstrmTp FinInstrmId ISIN TckrSymb SctySrs XpryDt FininstrmActlXpryDt StrkPric OptnTp FinInstrmNm OpnPric HghPric LwPric ClsPric LastPric PrvsClsgPric "
        "UndrlygPric SttlmPric OpnIntrst ChngInOpnIntrst TtlTradgVol TtlTrfVal TtlNbOfTxsExctd SsnId NewBrdLotQty Rmks Rsvd1 Rsvd2 Rsvd3 Rsvd4"
    ).split(),
    "nse": [*LEGACY, ""],
    "nse_compact": LEGACY,
    "nse_old": [*LEGACY[:-2], ""],
    "bse": "SC_CODE SC_NAME SC_GROUP SC_TYPE OPEN HIGH LOW CLOSE LAST PREVCLOSE NO_TRADES NO_OF_SHRS NET_TURNOV TDCLOINDI".split(),
}
MASTER = ["Symbol", "Underlying Asset", "SecurityName", "DateofListing", "MarketLot", "ISINNumber", "FaceValue", "ETF Underlying", "Underlying Key"]
DAILY = [
    "MARKET", "SERIES", "SYMBOL", "SECURITY", "PREVIOUS CLOSE PRICE", "OPEN PRICE", "HIGH PRICE", "LOW PRICE", "CLOSE PRICE", "NET TRADED VALUE", "NET TRADED QTY", "TRADES", "52 WEEK HIGH",
    "52 WEEK LOW", "UNDERLYING",
]
ISIN = "^[A-Z]{2}[A-Z0-9]{10}$"
FIELDS = {  # of the common table: the column of each layout that has it
    "unified": {"security_id": "FinInstrmId", "symbol": "TckrSymb", "series": "SctySrs", "name": "FinInstrmNm", "isin": "ISIN", "open": "OpnPric", "high": "HghPric", "low": "LwPric", "close": "ClsPric",
                "last": "LastPric", "previous": "PrvsClsgPric", "volume": "TtlTradgVol", "traded": "TtlTrfVal", "trades": "TtlNbOfTxsExctd", "day": "TradDt"},
    "nse": {"security_id": "SYMBOL", "symbol": "SYMBOL", "series": "SERIES", "name": "SYMBOL", "isin": "ISIN", "open": "OPEN", "high": "HIGH", "low": "LOW", "close": "CLOSE", "last": "LAST",
            "previous": "PREVCLOSE", "volume": "TOTTRDQTY", "traded": "TOTTRDVAL", "trades": "TOTALTRADES", "day": "TIMESTAMP"},
    "bse": {"security_id": "SC_CODE", "symbol": "SC_NAME", "series": "SC_GROUP", "name": "SC_NAME", "open": "OPEN", "high": "HIGH", "low": "LOW", "close": "CLOSE", "last": "LAST",
            "previous": "PREVCLOSE", "volume": "NO_OF_SHRS", "traded": "NET_TURNOV", "trades": "NO_TRADES"},
}
FIELDS["nse_compact"] = FIELDS["nse"]
FIELDS["nse_old"] = {k: v for k, v in FIELDS["nse"].items() if k not in ("isin", "trades")}


HEADER = "^\\uFEFF?( *\\r?\\n)*([^\\r\\n]*)"  # lines of blanks, and the first other line


def file_lines(files: DataFrame) -> DataFrame:
    """files with line and raw, for each line of a payload below its header that is not blank; the header's place is told once for a file."""
    above = F.size(F.split(F.regexp_extract("payload", HEADER, 0), "\\r?\\n")) - 1
    rows = files.withColumn("__first", above).select("*", F.posexplode(F.split(F.regexp_replace("payload", "^\\uFEFF", ""), "\\r?\\n")).alias("line", "raw"))
    return rows.drop("payload").where((F.col("line") > F.col("__first")) & ~blank(F.col("raw"))).drop("__first")


def parsed(rows: DataFrame, cells: int) -> DataFrame:
    """rows with row, a struct of the cells of raw as c0, c1 and so on, one more than asked for: the reader drops what is beyond, so that a row of another number of cells can be told."""
    short = F.greatest(cells + 1 - F.size(F.split("raw", ",")), F.lit(0))
    plain = (F.size(F.split("raw", '"')) % 2 == 1) & ~F.contains("raw", F.lit("\\"))  # no cell stays open at the end
    full = F.when(plain, F.concat("raw", F.repeat(F.lit(","), short))).otherwise(F.col("raw"))  # empty cells are null; a row that lacks cells costs the reader an exception
    return rows.withColumn("row", F.from_csv(full, ", ".join(f"c{i} string" for i in range(cells + 1)), {"mode": "PERMISSIVE"}))


def has_header(columns: list[str]) -> Column:
    """Whether a payload's header has exactly these columns, quoted or not."""
    found = F.split(F.regexp_extract("payload", HEADER, 2), ",")
    return F.transform(found, lambda c: F.regexp_replace(c, '^"|"$', "")) == F.array(*map(F.lit, columns))


def csv_rows(files: DataFrame, columns: list[str]) -> DataFrame:
    """files with line and row, the cells of payloads under exactly this header."""
    return parsed(file_lines(files.where(has_header(columns))), len(columns))


def cell(columns: list[str], name: str, row: Column | None = None) -> Column:
    return F.trim(F.coalesce((F.col("row") if row is None else row)[f"c{columns.index(name)}"], F.lit("")))


def number(c: Column) -> Column:
    """A decimal from zero on, null for anything else."""
    return F.when(c.rlike(AMOUNT), c.try_cast("double"))


def whole(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("long"))


def first_of(*tests: tuple[Column, str]) -> Column:
    """The name of the first test that holds."""
    return reduce(lambda c, t: c.when(F.coalesce(t[0], F.lit(True)), t[1]), tests[1:], F.when(F.coalesce(tests[0][0], F.lit(True)), tests[0][1]))


def typed_prices(files: DataFrame) -> DataFrame:
    """The common table of files whose layout is known, all layouts in one reading.

    Steps are bound: written out as columns they are one generated method that is too long to be compiled.
    """
    none = F.lit(None).cast("string")
    held = sorted({k for fields in FIELDS.values() for k in fields})
    prices = ("open", "high", "low", "close", "last", "previous")

    def by(layout: Column, value: Callable[[str], Column]) -> Column:
        return reduce(lambda c, k: c.when(layout == k, value(k)), list(LAYOUTS)[1:], F.when(layout == next(iter(LAYOUTS)), value(next(iter(LAYOUTS)))))

    def texts(x: Column) -> Column:
        row, layout = x["row"], x["layout"]
        each = by(layout, lambda name: F.struct(*[(cell(c := LAYOUTS[name], f[k], row) if k in (f := FIELDS[name]) else none).alias(k) for k in held], *[(cell(LAYOUTS[name], k, row) if name == "unified" else none).alias(k) for k in ("Src", "BizDt")]))
        short = by(layout, lambda name: row[f"c{len(c := LAYOUTS[name]) - 1 - (c[-1] == '')}"].isNull() & (F.size(F.split(x["raw"], ",")) < len(LAYOUTS[name])))
        return F.struct(x["exchange"].alias("exchange"), x["day"].alias("asked"), layout.alias("layout"), each.alias("t"), (by(layout, lambda name: row[f"c{len(LAYOUTS[name])}"].isNotNull()) | short).alias("columns"))

    def values(x: Column) -> Column:
        t, layout = x["t"], x["layout"]
        day, isin = t["day"], F.upper(t["isin"])
        own = F.coalesce(F.when(day.rlike("^\\d{2}-[A-Za-z]{3}-\\d{4}$"), F.try_to_date(day, "dd-MMM-yyyy")), F.when(day.rlike("^\\d{2}-[A-Za-z]{3}-\\d{2}$"), F.try_to_date(day, "dd-MMM-yy")))
        d = F.when(layout == "bse", x["asked"]).when(layout == "unified", F.try_to_date(day, "yyyy-MM-dd")).otherwise(own)
        known = F.when(layout.startswith("nse") & isin.isin("DUMMY", "INE"), None).otherwise(isin)
        return F.struct(
            x.alias("of"), d.alias("d"), known.alias("isin"), *[number(t[k]).alias(k) for k in prices], whole(t["volume"]).alias("volume"), number(t["traded"]).alias("traded"), whole(t["trades"]).alias("trades"),
        )

    def judged(v: Column) -> Column:
        x, t = v["of"], v["of"]["t"]
        unified, bse = x["layout"] == "unified", x["layout"] == "bse"
        optional = lambda k: (t[k] == "") | v[k].isNotNull()
        any_of = lambda tests: reduce(lambda a, b: a | b, tests)
        tests = [
            (x["columns"], "columns"),
            (unified & (F.upper(t["Src"]) != x["exchange"]), "exchange"),
            (v["d"].isNull() | (v["d"] != x["asked"]) | (unified & (t["BizDt"] != F.date_format(x["asked"], "yyyy-MM-dd"))), "day"),
            (blank(t["security_id"]) | blank(t["series"]) | (~bse & blank(t["symbol"])) | (unified & blank(t["name"])), "no_name"),
            (v["isin"].isNotNull() & ~v["isin"].rlike(ISIN), "isin"),
            (any_of(v[k].isNull() for k in ("open", "high", "low", "close")) | F.when(unified, ~optional("last")).otherwise(v["last"].isNull()) | F.when(bse, ~optional("previous")).otherwise(v["previous"].isNull()), "price"),
            (unified & any_of(v[k] <= 0 for k in ("open", "high", "low", "close")), "price"),
            (v["volume"].isNull() | v["traded"].isNull() | (by(x["layout"], lambda name: F.lit("trades" in FIELDS[name])) & v["trades"].isNull()), "volume"),
        ]
        text_or_null = lambda c: F.when(c != "", c)
        return F.struct(
            v["d"].alias("d"), t["security_id"].alias("security_id"), text_or_null(t["symbol"]).alias("symbol"), t["series"].alias("series"), text_or_null(t["name"]).alias("name"),
            *[v[k].alias(k) for k in ("isin", *prices, "volume", "traded", "trades")], first_of(*tests).alias("error"),
        )

    rows = parsed(file_lines(files), max(map(len, LAYOUTS.values())))
    read = bound(bound(bound(F.struct("exchange", "day", "layout", "raw", "row"), texts), values), judged)
    return rows.select("source", "line", "layout", "exchange", read.alias("__x")).select("source", "line", "layout", "exchange", "__x.*")


def prices(files: DataFrame) -> DataFrame:
    """All rows of price files of any layout, with bar_issue and close_issue; a file of no layout, or of one that its day does not have, is one row with an error.

    A close of zero is no price: the row stays with its issue. Open, high and low that contradict each
    other or the close are left out. Of rows of one security the first stays.
    """
    layout = F.regexp_replace(F.regexp_extract("payload", HEADER, 2), '"', "")
    names = F.create_map(*[F.lit(x) for name, columns in LAYOUTS.items() for x in (",".join(columns), name)])
    told = files.withColumn("layout", F.try_element_at(names, layout))
    since = lambda day: F.col("day") >= F.lit(day).cast("date")
    allowed = (
        F.when(F.col("layout") == "unified", since(UNIFIED_FROM)).when(F.col("layout") == "bse", (F.col("exchange") == "BSE") & ~since(UNIFIED_FROM))
        .when(F.col("layout") == "nse_old", (F.col("exchange") == "NSE") & ~since(ISIN_FROM)).otherwise((F.col("exchange") == "NSE") & ~since(UNIFIED_FROM))
    )
    told = told.withColumn("fits", F.col("layout").isNotNull() & F.coalesce(allowed, F.lit(False)))
    rows = typed_prices(told.where("fits").drop("fits"))
    wrong = told.where("not fits").select("source", "layout", "exchange", F.col("day").alias("d"), F.when(F.col("layout").isNull(), "unknown_layout").otherwise("layout_of_another_day").alias("error"))
    own = ["source", "security_id"] + ["series"]
    again = F.row_number().over(Window.partitionBy(*own, F.col("error").isNull()).orderBy("line")) > 1
    rows = rows.withColumn("error", F.coalesce("error", F.when(again, "repeated")))
    zero = F.col("error").isNull() & (F.col("close") == 0)
    bad = F.col("error").isNull() & ~zero & ((F.least("open", "high", "low") <= 0) | (F.col("high") < F.greatest("open", "low", "close")) | (F.col("low") > F.least("open", "high", "close")))
    rows = rows.withColumns({"close_issue": F.when(zero, "zero_close"), "bar_issue": F.when(bad, "inconsistent_bar")})
    rows = rows.withColumns({k: F.when(F.col("bar_issue").isNull(), F.col(k)) for k in ("open", "high", "low")})
    return rows.unionByName(wrong, allowMissingColumns=True)


def etf_master(files: DataFrame) -> DataFrame:
    """symbol, underlying, name, listed, lot, isin, face of the listing file (source, payload); of rows of one isin the first stays."""
    rows = csv_rows(files, MASTER)
    get = lambda k: cell(MASTER, k)
    listed, isin = F.try_to_date(get("DateofListing"), "dd-MMM-yy"), F.upper(get("ISINNumber"))
    tests = [
        (F.col(f"row.c{len(MASTER)}").isNotNull(), "columns"), (~isin.rlike(ISIN), "isin"), (~F.coalesce(whole(get("MarketLot")) > 0, F.lit(False)), "lot"), (listed.isNull(), "day"),
        (blank(get("Symbol")) | blank(get("Underlying Asset")) | blank(get("SecurityName")), "no_name"), (~F.coalesce(number(get("FaceValue")) > 0, F.lit(False)), "face"),
    ]
    out = rows.select("source", F.col("line").alias("position"), get("Symbol").alias("symbol"), get("Underlying Asset").alias("underlying"), get("SecurityName").alias("name"), listed.alias("listed"), whole(get("MarketLot")).alias("lot"), isin.alias("isin"), number(get("FaceValue")).alias("face"), first_of(*tests).alias("error"))
    again = F.row_number().over(Window.partitionBy("source", "isin", F.col("error").isNull()).orderBy("position")) > 1
    return out.withColumn("error", F.coalesce("error", F.when(again, "repeated")))


def etf_daily(files: DataFrame) -> DataFrame:
    """symbol, series, name, underlying of the daily membership file (source, payload); its figures are checked, not kept."""
    rows = csv_rows(files, DAILY)
    get = lambda k: cell(DAILY, k)
    positive = [~F.coalesce(number(get(k)) > 0, F.lit(False)) for k in DAILY if k.endswith("PRICE") or k.startswith("52 ")]
    tests = [
        (F.col(f"row.c{len(DAILY)}").isNotNull(), "columns"), (get("MARKET") != "N", "market"), (blank(get("SYMBOL")) | blank(get("SERIES")) | blank(get("SECURITY")) | blank(get("UNDERLYING")), "no_name"),
        (reduce(lambda a, b: a | b, positive), "price"), (number(get("NET TRADED VALUE")).isNull() | whole(get("NET TRADED QTY")).isNull() | whole(get("TRADES")).isNull(), "volume"),
    ]
    out = rows.select("source", F.col("line").alias("position"), get("SYMBOL").alias("symbol"), get("SERIES").alias("series"), get("SECURITY").alias("name"), get("UNDERLYING").alias("underlying"), first_of(*tests).alias("error"))
    again = F.row_number().over(Window.partitionBy("source", "symbol", "series", F.col("error").isNull()).orderBy("position")) > 1
    return out.withColumn("error", F.coalesce("error", F.when(again, "repeated")))


def resolved_by_membership(daily: DataFrame, prices: DataFrame) -> DataFrame:
    """One exchange's day: daily (d, symbol, series, name) with the price row's isin and close; without a price or isin the identity is unresolved."""
    own = prices.where("error is null").select("d", "symbol", "series", "isin", "close", "close_issue")
    both = daily.join(own, ["d", "symbol", "series"], "left")
    return both.withColumn("identity", F.when(F.col("isin").isNull(), "identity_unresolved").otherwise("official"))


def identity_changes(listings: DataFrame) -> DataFrame:
    """exchange, security_id and isins of securities that have been listed under more than one ISIN, with the first day of each."""
    first = listings.where("isin is not null").groupBy("exchange", "security_id", "isin").agg(F.min("d").alias("since"))
    return first.groupBy("exchange", "security_id").agg(F.count("*").alias("isins"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("since", "isin"))), lambda x: F.concat_ws(" ", x["since"], x["isin"])), "|").alias("history")).where("isins > 1")
