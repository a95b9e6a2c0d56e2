"""Readers of text, JSON and CSV feeds into typed rows, strict where a feed's form is fixed.

A reader takes a DataFrame of whole payloads (source, payload) and returns rows with an ``error``
column that is null where the row is good, so that good and quarantined rows split without a second
read. Drift of a whole payload (an unknown header, say) gives one row with an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# The headers of the value feed's four forms, with the place of each field.
VALUE_HEADERS = {
    "Scheme Code;ISIN Div Payout/ ISIN Growth;ISIN Div Reinvestment;Scheme Name;Net Asset Value;Date": {"code": 0, "isin": 1, "isin2": 2, "name": 3, "value": 4, "day": 5, "n": 6},
    "Scheme Code;ISIN Div Payout/ ISIN Growth;ISIN Div Reinvestment;Scheme Name;Plan;Option;Net Asset Value;Date": {"code": 0, "isin": 1, "isin2": 2, "name": 3, "plan": 4, "option": 5, "value": 6, "day": 7, "n": 8},
    "Scheme Code;Scheme Name;ISIN Div Payout/ISIN Growth;ISIN Div Reinvestment;Net Asset Value;Repurchase Price;Sale Price;Date": {"code": 0, "name": 1, "isin": 2, "isin2": 3, "value": 4, "day": 7, "n": 8},
    "Scheme Code;NAV Name;Plan;Option;ISIN Div Payout/ISIN Growth;ISIN Div Reinvestment;Net Asset Value;Date": {"code": 0, "name": 1, "plan": 2, "option": 3, "isin": 4, "isin2": 5, "value": 6, "day": 7, "n": 8},
}


def payloads(spark, paths: str | list[str]) -> DataFrame:
    """source and payload of whole text files, without a byte order mark."""
    raw = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("payload"))
    return raw.withColumn("payload", F.regexp_replace("payload", "^\\uFEFF", ""))


# How the value feed says that it failed for now, and that it has no rows.
FAILED_MARKS = ("View/Download NAV History", "Application Error! Please try again later")
EMPTY_MARK = "No data found on the basis of selected parameters for this report"
CLASS_MARK = "^(openendedschemes|closeendedschemes|intervalfundschemes)\\("  # of a section line without blanks
VALUE = "^\\+?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?$"


def payload_state(payload: Column) -> Column:
    """failed for the application's own error page, empty for its report without rows, else data."""
    failed = F.lower(payload).contains("<html") & payload.contains(FAILED_MARKS[0]) & payload.contains(FAILED_MARKS[1])
    return F.when(failed, "failed").when(payload.contains(EMPTY_MARK), "empty").otherwise("data")


def field(name: str) -> Column:
    """The trimmed field of the split line under the payload's header, null where the header lacks it."""
    choices = None
    for header, at in VALUE_HEADERS.items():
        if name in at:
            hit = F.col("header") == header
            value = F.trim(F.get("parts", F.lit(at[name])))
            choices = F.when(hit, value) if choices is None else choices.when(hit, value)
    return choices


def value_feed(files: DataFrame) -> DataFrame:
    """source, line, class, house, code, isin, isin2, name, plan, option, value, raw_value, day, error of a ';' feed.

    Lines without ';' open a section: a structure with brackets names the class, any other the house; a
    house before any class is an error, as are another number of fields than the header's, a row before
    its sections and a repeated (code, day), of which the first stays. A value that is no finite number
    from zero on leaves a row with its text and an error, so that it can be kept apart.
    """
    lines = files.select("source", F.posexplode(F.split("payload", "\\r?\\n")).alias("line", "raw")).withColumn("raw", F.trim("raw")).where("raw <> ''")
    keep = Window.partitionBy("source").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    section = ~F.col("raw").contains(";")
    is_class = F.regexp_replace(F.lower("raw"), " ", "").rlike(CLASS_MARK)
    rows = lines.withColumns(
        {
            "header": F.first_value("raw").over(keep),
            "class": F.last(F.when(section & is_class, F.col("raw")), ignorenulls=True).over(keep),
            "house": F.last(F.when(section & ~is_class, F.col("raw")), ignorenulls=True).over(keep),
        }
    )
    lost = section & ~is_class & F.col("class").isNull()
    rows = rows.where((~section | lost) & (F.col("raw") != F.col("header"))).withColumn("parts", F.split("raw", ";")).withColumn("lost", lost)
    size = None
    for header, at in VALUE_HEADERS.items():
        hit = F.col("header") == header
        size = F.when(hit, at["n"]) if size is None else size.when(hit, at["n"])
    present = lambda name: F.when(~field(name).isin("", "-"), field(name)).alias(name)
    out = rows.select(
        "source", "line", "class", "house", field("code").alias("code"), present("isin"), present("isin2"), field("name").alias("name"),
        F.when(field("plan") != "", field("plan")).alias("plan"), F.when(field("option") != "", field("option")).alias("option"),
        F.when(field("value").rlike(VALUE), field("value").try_cast("decimal(18,8)")).alias("value"), field("value").alias("raw_value"), text.date_text(field("day"), ("dd-MMM-yyyy",)).alias("day"),
        size.alias("__n"), F.size("parts").alias("__have"), "lost",
    )
    early = (
        F.when(F.col("__n").isNull(), "unknown_header")
        .when(F.col("lost"), "lost_section")
        .when(F.col("class").isNull() | F.col("house").isNull(), "no_section")
        .when(F.col("__n") != F.col("__have"), "field_count")
        .when(~F.col("code").rlike("^[0-9]+$"), "bad_code")
        .when(F.col("name") == "", "no_name")
        .when(F.col("day").isNull(), "bad_date")
    )
    out = out.withColumn("__early", early).drop("__n", "__have", "lost")  # told before rows are sorted again, so that columns that nobody asks for are not held for it
    again = F.row_number().over(Window.partitionBy("source", "code", "day").orderBy("line")) > 1
    return out.withColumn("error", F.coalesce("__early", F.when(again, "repeated").when(F.col("value").isNull(), "bad_value"))).drop("__early")


def isin_warnings(rows: DataFrame) -> DataFrame:
    """code, day and issue of identifiers that are not of the standard form."""
    each = F.explode(F.array(F.struct(F.lit("INVALID_ISIN_PAYOUT_OR_GROWTH").alias("issue"), F.col("isin").alias("value")), F.struct(F.lit("INVALID_ISIN_REINVESTMENT").alias("issue"), F.col("isin2").alias("value"))))
    return rows.where("error is null").select("code", "day", each.alias("x")).where(F.col("x.value").isNotNull() & ~text.is_isin(F.col("x.value"))).select("code", "day", "x.*")


def json_rows(files: DataFrame, schema: str, keys: list[str], *, wrapper: str | None = None, optional: list[str] = ()) -> DataFrame:
    """source, position, the schema's columns, raw and error of a JSON array, bare or under a wrapper key.

    Every object has exactly the keys, with all or none of the optional ones; others, and what is no
    array, are errors.
    """
    array = F.get_json_object("payload", f"$.{wrapper}") if wrapper else F.col("payload")
    items = F.from_json(array, "array<string>")
    bare = F.coalesce(array.rlike("^\\s*\\[\\s*\\]\\s*$"), F.lit(False))
    told = files.select("source", items.alias("items"), bare.alias("__empty"))  # once for a file, not for each of its rows
    rows = told.select("source", F.posexplode_outer("items").alias("position", "raw"), "__empty")
    found = F.coalesce(F.sort_array(F.json_object_keys("raw")), F.array().cast("array<string>"))
    forms = [F.array(*map(F.lit, sorted(k))) for k in ([*keys], [*keys, *optional])[: 1 + bool(optional)]]
    parsed = rows.withColumn("__row", F.from_json("raw", schema))
    error = F.when(F.col("raw").isNull() & ~F.col("__empty"), "no_array").when(F.col("raw").isNotNull() & ~reduce(lambda a, b: a | b, (found == f for f in forms)), "keys")
    return parsed.select("source", "position", "__row.*", "raw", error.alias("error")).where("raw is not null or error is not null")


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def kind_of(key: str) -> Column:
    """The JSON type of a key of raw, as STRING, BIGINT, VOID and so on."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json("raw"), f"$.{key}", "variant"))


def signature() -> Column:
    """sha256 of raw as compact JSON with its keys in order."""
    return F.sha2(F.coalesce(F.to_json(F.try_parse_json("raw")), F.col("raw")), 256)


def first_stays(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the error repeated where an earlier good row of the source has the same keys."""
    again = F.row_number().over(Window.partitionBy("source", *keys, F.col("error").isNull()).orderBy("position")) > 1
    return rows.withColumn("error", F.coalesce("error", F.when(again, "repeated")))


SCHEME_KEYS = ["scheme_id", "scheme_name"]


def scheme_list(files: DataFrame) -> DataFrame:
    """scheme_id and scheme_name of the universe; identifiers are texts of digits and do not repeat, names are not blank."""
    rows = json_rows(files, "scheme_id string, scheme_name string", SCHEME_KEYS)
    bad = F.when((kind_of("scheme_id") != "STRING") | ~F.col("scheme_id").rlike("^[0-9]+$"), "bad_code").when((kind_of("scheme_name") != "STRING") | blank(F.col("scheme_name")), "no_name")
    return first_stays(rows.withColumns({"error": F.coalesce("error", bad), "scheme_name": F.trim("scheme_name")}), ["scheme_id"])


PAYOUT_KEYS = ["MF_ID", "SD_ID", "scheme_id", "Scheme_Name", "Nav_name", "Div_year", "year", "Rate_of_div"]
MIDNIGHT = "^\\d{4}-\\d{2}-\\d{2}T00:00(:00(\\.0+)?)?(Z|[+-]\\d{2}:\\d{2})$"


def payout_feed(files: DataFrame) -> DataFrame:
    """Payout records with the value's grammar and unit, with or without the feed's own Plan and Option.

    Records that break the form carry an error and a signature of what they say; of records of one
    option and day the first stays.
    """
    names = [*PAYOUT_KEYS, "Plan", "Option"]
    rows = json_rows(files, ", ".join(f"`{k}` string" for k in names), PAYOUT_KEYS, wrapper="data", optional=["Plan", "Option"])
    day = F.when(F.col("Div_year").rlike(MIDNIGHT), F.substring("Div_year", 1, 10).try_cast("date"))
    out = rows.withColumns({"day": day, "grammar": text.value_grammar(F.col("Rate_of_div")), "signature": signature()})
    out = out.withColumns({"unit": text.payout_unit(F.col("grammar"), F.col("day")), **{k: F.when(~blank(F.col(k)), F.trim(k)) for k in ("Plan", "Option")}})
    digits = [~F.coalesce(F.col(k).rlike("^[0-9]+$"), F.lit(False)) for k in ("MF_ID", "SD_ID", "scheme_id")]
    stated = [F.col(k).isNull() | F.coalesce(kind_of(k), F.lit("VOID")).isin("STRING", "VOID") for k in ("Plan", "Option")]  # a record is parsed for its kinds only where it has the key
    error = (
        F.when(digits[0] | digits[1] | digits[2], "bad_code").when(F.col("day").isNull(), "bad_date").when(F.col("year") != F.date_format("day", "yyyy"), "year")
        .when(~stated[0], "Plan").when(~stated[1], "Option").when(F.col("grammar.kind") == "invalid", "bad_value").when(blank(F.col("Scheme_Name")) | blank(F.col("Nav_name")), "no_name")
    )
    return first_stays(out.withColumn("error", F.coalesce("error", error)), ["SD_ID", "day"])


CAPTURE = "schema_version int, provider string, source_url string, captured_at string, fund struct<code: string, name: string>, scheme struct<code: string, name: string, plan_type: string, option_variant: string, latest_nav_date: string, latest_nav_value: string>, source_payload_sha256 string, source_payload string, records array<struct<record_date: string, individual_amount: string, non_individual_amount: string, ex_nav: string, cum_nav: string, source_terminology: string>>"
# The host that each registrar's captures come from.
HOSTS = {"cams": "www.camsonline.com", "kfintech": "mfs.kfintech.com"}


CAPTURE_KEYS = ["schema_version", "provider", "source_url", "captured_at", "fund", "scheme", "source_payload_sha256", "source_payload", "records"]
SCHEME_FIELDS = ["code", "name", "plan_type", "option_variant", "latest_nav_date", "latest_nav_value"]
RECORD_FIELDS = ["record_date", "individual_amount", "non_individual_amount", "ex_nav", "cum_nav", "source_terminology"]
AWARE = "^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}(:\\d{2}(\\.\\d+)?)?(Z|[+-]\\d{2}:\\d{2})$"
AMOUNT = "^\\s*\\+?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$"


def has_keys(json: Column, keys: list[str]) -> Column:
    return F.coalesce(F.sort_array(F.json_object_keys(json)) == F.array(*map(F.lit, sorted(keys))), F.lit(False))


def captures(lines: DataFrame) -> DataFrame:
    """Registrar captures of JSON lines (source, value), with an error for what breaks the contract."""
    c = lines.select("source", F.from_json("value", CAPTURE).alias("c"), F.col("value").alias("raw")).select("source", "c.*", "raw")
    hosts = F.create_map(*[F.lit(x) for pair in HOSTS.items() for x in pair])
    per_file = Window.partitionBy("source")
    again = F.count("*").over(Window.partitionBy("source", "provider", "fund.code", "scheme.code", "captured_at"))
    part = lambda k: F.get_json_object("raw", f"$.{k}")
    records = F.from_json(part("records"), "array<string>")
    pair = F.col("scheme.latest_nav_date").isNull() != F.col("scheme.latest_nav_value").isNull()
    number = lambda v: v.isNull() | v.rlike(AMOUNT)
    fits = lambda r: (
        r["record_date"].try_cast("date").isNotNull() & F.coalesce(r["individual_amount"].rlike(AMOUNT) & (r["individual_amount"].try_cast("decimal(38,18)") > 0), F.lit(False))
        & number(r["non_individual_amount"]) & number(r["ex_nav"]) & number(r["cum_nav"]) & ~blank(r["source_terminology"])
    )
    error = (
        F.when(~has_keys(F.col("raw"), CAPTURE_KEYS), "keys")
        .when(F.coalesce("schema_version", F.lit(0)) != 1, "schema_version")
        .when(F.try_element_at(hosts, F.col("provider")).isNull(), "provider")
        .when((F.parse_url("source_url", F.lit("PROTOCOL")) != "https") | (F.parse_url("source_url", F.lit("HOST")) != F.try_element_at(hosts, F.col("provider"))), "host")
        .when(~F.coalesce(F.col("captured_at").rlike(AWARE), F.lit(False)), "naive_time")
        .when(~has_keys(part("fund"), ["code", "name"]) | ~has_keys(part("scheme"), SCHEME_FIELDS), "keys")
        .when(blank(F.col("fund.code")) | blank(F.col("fund.name")) | blank(F.col("scheme.code")) | blank(F.col("scheme.name")), "no_name")
        .when(~F.col("scheme.plan_type").isin("direct", "regular", "unknown"), "plan")
        .when(~F.col("scheme.option_variant").isin("payout", "reinvestment", "unknown"), "variant")
        .when(pair | ~number(F.col("scheme.latest_nav_value")), "latest")
        .when(F.sha2("source_payload", 256) != F.col("source_payload_sha256"), "checksum")
        .when(records.isNull(), "records")
        .when(F.exists(records, lambda r: ~has_keys(r, RECORD_FIELDS)) | F.exists("records", lambda r: ~fits(r)), "record")
        .when(F.size(F.array_distinct("records")) != F.size("records"), "repeated_record")
        .when(F.size(F.collect_set("provider").over(per_file)) > 1, "mixed_providers")
        .when(again > 1, "repeated")
    )
    return c.withColumn("error", error)


def capture_records(good: DataFrame) -> DataFrame:
    """One typed row for each payout record of good captures; amounts with binary noise are repaired."""
    rows = good.where("error is null").select("provider", "fund", "scheme", "captured_at", F.posexplode("records").alias("position", "r"))
    amount = text.decimal_text(F.col("r.individual_amount"), "decimal(38,18)")
    return rows.select(
        "provider", F.col("fund.code").alias("fund_code"), F.col("scheme.code").alias("scheme_code"), "captured_at", "position", text.date_text(F.col("r.record_date")).alias("d"),
        F.when(F.col("provider") == "cams", text.noise_repaired(amount)).otherwise(amount).alias("amount"), text.decimal_text(F.col("r.ex_nav"), "decimal(18,8)").alias("ex_value"), text.decimal_text(F.col("r.cum_nav"), "decimal(18,8)").alias("cum_value"),
    )


def evidence(good: DataFrame) -> DataFrame:
    """Distinct (capture, d, value, kind) that tell a capture's series: its latest value, and values without and with each payout."""
    rows = good.where("error is null")
    key = F.concat_ws("|", "provider", "fund.code", "scheme.code", "captured_at").alias("capture")
    latest = rows.select(key, F.to_date("scheme.latest_nav_date").alias("d"), text.decimal_text(F.col("scheme.latest_nav_value"), "decimal(18,8)").alias("value"), F.lit("latest_nav").alias("kind"))
    each = rows.select(key, F.explode("records").alias("r")).select("capture", F.to_date("r.record_date").alias("d"), *[text.decimal_text(F.col(f"r.{k}"), "decimal(18,8)").alias(k) for k in ("ex_nav", "cum_nav")])
    paid = each.unpivot(["capture", "d"], ["ex_nav", "cum_nav"], "kind", "value").select("capture", "d", "value", "kind")
    return latest.unionByName(paid).where("d is not null and value is not null").distinct()


def yield_holds(amount: Column, value: Column, shown: Column, *, rounded: bool = True) -> Column:
    """Whether a shown yield is the amount over the value: to two places half up, or within 1e-10."""
    exact = amount / value * 100
    return F.round(exact, 2) == shown if rounded else F.abs(exact - shown) <= F.lit(1e-10)


def index_names(files: DataFrame) -> DataFrame:
    """trading_name and display_name of the index catalogue; trading names do not repeat."""
    keys = ["Trading_Index_Name", "Index_long_name"]
    rows = json_rows(files, ", ".join(f"`{k}` string" for k in keys), keys)
    out = rows.select("source", "position", F.trim(keys[0]).alias("trading_name"), F.trim(keys[1]).alias("display_name"), F.coalesce("error", F.when(blank(F.col(keys[0])) | blank(F.col(keys[1])), "no_name")).alias("error"))
    return first_stays(out, ["trading_name"])


def index_prices(files: DataFrame) -> DataFrame:
    """Index prices; a bar whose open, high or low cannot be is kept by its close, with an issue. "-" is a value that is not known."""
    keys = ["RequestNumber", "Index Name", "INDEX_NAME", "HistoricalDate", "OPEN", "HIGH", "LOW", "CLOSE"]
    rows = json_rows(files, ", ".join(f"`{k}` string" for k in keys), keys)
    o, h, lo, c = (text.decimal_text(F.col(k), "double") for k in ("OPEN", "HIGH", "LOW", "CLOSE"))
    typed = rows.select("source", "position", F.trim("INDEX_NAME").alias("index"), text.date_text(F.col("HistoricalDate"), ("dd MMM yyyy",)).alias("d"), o.alias("open"), h.alias("high"), lo.alias("low"), c.alias("close"), "error")
    error = F.coalesce("error", F.when(blank(F.col("index")), "no_name").when(F.col("d").isNull(), "bad_date").when(~F.coalesce(F.col("close") > 0, F.lit(False)), "bad_value"))
    return checked_bar(first_stays(typed.withColumn("error", error), ["index", "d"]))


def checked_bar(rows: DataFrame) -> DataFrame:
    """open, high and low null where they contradict each other or the close; a close of zero is an issue, not a price."""
    bad = (F.col("low") > F.least("open", "high", "close")) | (F.col("high") < F.greatest("open", "low", "close"))
    out = rows.withColumn("issue", F.when(F.col("close").isNull() | (F.col("close") <= 0), "close").when(F.coalesce(bad, F.lit(False)), "bar"))
    return out.withColumns({k: F.when(F.col("issue").isNull(), F.col(k)) for k in ("open", "high", "low")}).withColumn("close", F.when(F.coalesce("issue", F.lit("")) != "close", F.col("close")))


def total_returns(files: DataFrame) -> DataFrame:
    """index, d, basis, value, error: gross rows, and net ones where the feed has them; of rows of one index and day the first stays."""
    keys = ["RequestNumber", "Index Name", "Date", "TotalReturnsIndex", "NTR_Value"]
    rows = json_rows(files, ", ".join(f"`{k}` string" for k in keys), keys)
    number = lambda k: text.decimal_text(F.col(k), "double")
    typed = rows.select("source", "position", F.trim("Index Name").alias("index"), text.date_text(F.col("Date"), ("dd MMM yyyy",)).alias("d"), number("TotalReturnsIndex").alias("gross"), number("NTR_Value").alias("net"), F.coalesce("NTR_Value", F.lit("-")).isin("", "-").alias("none"), "error")
    bad = F.when(blank(F.col("index")), "no_name").when(F.col("d").isNull(), "bad_date").when(~F.coalesce(F.col("gross") > 0, F.lit(False)) | (~F.col("none") & ~F.coalesce(F.col("net") > 0, F.lit(False))), "bad_value")
    checked = first_stays(typed.withColumn("error", F.coalesce("error", bad)), ["index", "d"])
    return checked.unpivot(["source", "position", "index", "d", "error"], ["gross", "net"], "basis", "value").where("value is not null or (error is not null and basis = 'gross')")


def notice_rows(texts: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Rows that a pattern finds in extracted texts (source, payload), one column for each group."""
    whole = F.regexp_extract_all("payload", F.lit(pattern), F.lit(0))
    rows = texts.select("source", F.posexplode(whole).alias("position", "hit"))
    return rows.select("source", "position", *[text.collapsed(F.regexp_extract("hit", pattern, i + 1)).alias(n) for i, n in enumerate(names)])
