"""Catalogues of funds, schemes and instruments, and strict histories of third parties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .feeds import AWARE, blank, first_stays, has_keys, json_rows, kind_of
from .markup import select_options, table_rows

# Keys of the detail records and of market-watch rows, and the form of fund pairs in pages.
DETAIL_KEYS = [
    "MF_Name", "Scheme_Name", "Scheme_Objective", "SchemeType_Desc", "SchemeCat_Desc", "Launch_Date", "Scheme_load", "Scheme_min_amt", "AMC_Website", "scheme_Id", "MF_Id",
]
WATCH_KEYS = (
    "Scrip_cd EtfAlias_Name TYPE Ltradert change_val HighRate LowRate prevDayClose OpenRate Wtdavg totalVol Turnover TwoWeekAvg Uchklmt Lchklmt week_High week_Low Month_High Month_Low "
    "52Week_High 52Week_Low URL DT_TM Nsurl Best_Buy_Rate Best_Sale_Rate Total_Sale_Qty Total_Buy_Qty Change_Percentage"
).split()
WATCH_VARIANTS = {"ScripName": "broad_market_watch", "ETFNAME": "categorized_subset"}  # by the key that each has beside the others
FUND_PAIR = '\\\\"mf_id\\\\":\\\\"(\\d+)\\\\",\\\\"mf_name\\\\":\\\\"(.*?)\\\\",\\\\"amc_name\\\\":'
MISSING_FILE_MARKS = ("live stock/share market", "bse sensex", "bseindia.com")


def fund_catalogue(pages: DataFrame, least: int = 10) -> DataFrame:
    """source, fund_id, fund_name, error of the escaped JSON pairs in pages, one for each fund.

    A fund with two names is a conflict, a name whose escapes are no JSON an error; a page with fewer
    funds than the least is an error as a whole.
    """
    hits = pages.select("source", F.explode_outer(F.regexp_extract_all("payload", F.lit(FUND_PAIR), F.lit(0))).alias("hit"))
    raw = F.regexp_extract("hit", FUND_PAIR, 2)
    name = F.get(F.from_json(F.concat(F.lit('["'), raw, F.lit('"]')), "array<string>"), 0)
    rows = hits.select("source", F.regexp_extract("hit", FUND_PAIR, 1).try_cast("long").alias("fund_id"), F.trim(name).alias("fund_name")).distinct()
    funds = rows.groupBy("source", "fund_id").agg(F.count_distinct("fund_name").alias("names"), F.min("fund_name").alias("fund_name"))
    size = F.count("fund_id").over(Window.partitionBy("source"))
    error = F.when(size < least, "too_few").when(F.col("names") > 1, "conflict").when(F.col("names") == 0, "bad_name")
    return funds.select("source", "fund_id", "fund_name", error.alias("error"))


def scheme_details(files: DataFrame) -> DataFrame:
    """Detail records, at least one; the launch day is null or carries the feed's own offset, identifiers are digits."""
    rows = json_rows(files, ", ".join(f"`{k}` string" for k in DETAIL_KEYS), DETAIL_KEYS, wrapper="data")
    none = files.join(rows.select("source").distinct(), "source", "left_anti").select("source", F.lit("no_records").alias("error"))
    launch = F.col("Launch_Date")
    fits = launch.isNull() | launch.rlike("^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}(:\\d{2}(\\.\\d+)?)?\\+05:30$")
    day = F.when(fits, F.substring(launch, 1, 10).try_cast("date"))
    digits = lambda k: F.coalesce(F.col(k).rlike("^[0-9]+$"), F.lit(False))
    names = [blank(F.col(k)) for k in ("MF_Name", "Scheme_Name", "SchemeType_Desc", "SchemeCat_Desc")]
    error = F.when(~digits("MF_Id") | ~digits("scheme_Id"), "bad_code").when(~fits | (launch.isNotNull() & day.isNull()), "launch_date").when(names[0] | names[1] | names[2] | names[3], "no_name")
    return rows.withColumns({"launch_day": day, "error": F.coalesce("error", error)}).unionByName(none, allowMissingColumns=True)


def market_watch(files: DataFrame) -> DataFrame:
    """source, position, variant, code, alias, name, category, as_of, error of market-watch rosters.

    A payload has rows of one variant and one day only; else all its rows are in error. Of rows of one
    code the first stays.
    """
    keys = {v: sorted([*WATCH_KEYS, k]) for k, v in WATCH_VARIANTS.items()}
    whole = F.json_object_keys("payload")
    items = F.from_json(F.get_json_object("payload", "$.Table"), "array<string>")
    told = files.select("source", items.alias("items"), (whole == F.array(F.lit("Table"))).alias("bare"))
    rows = told.select("source", F.posexplode_outer("items").alias("position", "raw"), "bare")
    found = F.coalesce(F.sort_array(F.json_object_keys("raw")), F.array().cast("array<string>"))
    variant = F.lit(None).cast("string")
    for name, k in keys.items():
        variant = F.when(found == F.array(*map(F.lit, k)), name).otherwise(variant)
    get = lambda k: F.get_json_object("raw", f"$.{k}")
    stamp = get("DT_TM")
    as_of = F.when(stamp.rlike("^\\d{4}-\\d{2}-\\d{2}([T ]\\d{2}:\\d{2}.*)?$"), F.substring(stamp, 1, 10).try_cast("date"))
    out = rows.withColumn("variant", variant).select(
        "source", "position", "raw", "bare", "variant", get("Scrip_cd").alias("code"), F.trim(get("EtfAlias_Name")).alias("alias"),
        F.trim(F.when(F.col("variant") == "broad_market_watch", get("ScripName")).otherwise(get("EtfAlias_Name"))).alias("name"), F.when(~blank(get("TYPE")), F.trim(get("TYPE"))).alias("category"), as_of.alias("as_of"),
    )
    own = Window.partitionBy("source")
    code_kind, type_kind = kind_of("Scrip_cd"), F.coalesce(kind_of("TYPE"), F.lit("VOID"))
    error = (
        F.when(~F.coalesce("bare", F.lit(False)) | F.col("raw").isNull(), "no_table").when(F.col("variant").isNull(), "keys")
        .when(~code_kind.isin("BIGINT", "TINYINT", "SMALLINT", "INT") | ~F.col("code").rlike("^[1-9][0-9]*$"), "bad_code").when(F.col("as_of").isNull(), "bad_date")
        .when(~type_kind.isin("STRING", "VOID"), "category").when(blank(F.col("alias")) | blank(F.col("name")), "no_name")
        .when(F.size(F.collect_set("as_of").over(own)) > 1, "as_of").when(F.size(F.collect_set("variant").over(own)) > 1, "mixed_variants")
    )
    return first_stays(out.withColumn("error", error), ["code"]).drop("raw", "bare")


# The third party's provider name, table, headings and paths.
THIRD_PARTY = "advisorkhoj"
HISTORY_TABLE, HISTORY_HEADING, AMC_SELECT = "tbl_dividend_history", "Historical Dividends of ", "sel_amcCompanies"
HISTORY = {"d": ["dividend record date"], "amount": ["dividend unit"], "value": ["nav"], "shown": ["dividend yield"]}
SCHEME_LITERAL = "var\\s+scheme_name\\s*=\\s*'([^']+)'\\s*;"
DETAIL_PATH, HISTORY_PATH = "/mutual-funds-research/getSchemeDividendDetails", "/mutual-funds-research/mutual-funds-historical-dividends/"
PAGE_KEYS = ["schema_version", "provider", "requested_url", "source_url", "captured_at", "amc_name", "requested_scheme_name", "source_payload_sha256", "source_payload"]
API_KEYS = ["schema_version", "provider", "catalog_sha256", "source_url", "captured_at", "amc_name", "category", "requested_scheme_name", "source_payload_sha256", "source_payload"]
ROW_KEYS = ["dividend_date", "net_asset_value", "dividend_value", "dividend_yield"]
HEX = "^[0-9a-f]{64}$"


def ordered(rows: DataFrame) -> Column:
    """repeated_day or order where a history's days do not fall from row to row."""
    before = F.lag("d").over(Window.partitionBy("source").orderBy("row"))
    return F.when(before == F.col("d"), "repeated_day").when(before < F.col("d"), "order")


def history_pages(pages: DataFrame) -> DataFrame:
    """source, row, d, amount, value, shown, error of payout histories in pages: one table, falling days, true yields."""
    rows = table_rows(pages, HISTORY, table_id=HISTORY_TABLE, exact=True)
    number = lambda n: text.decimal_text(F.col(n), "decimal(18,8)")
    shown = F.when(F.col("shown").rlike("^(0|[1-9][0-9]*)(\\.[0-9]+)?%$"), F.regexp_replace("shown", "%", "").try_cast("decimal(18,8)"))
    typed = rows.select("source", "row", text.date_text(F.col("d"), ("dd-MM-yyyy",)).alias("d"), number("amount").alias("amount"), number("value").alias("value"), shown.alias("shown"), F.col("error").alias("__e"))
    wrong = F.round(F.col("amount") / F.col("value") * 100, 2) != F.col("shown")
    bad = ~F.coalesce((F.col("amount") >= 0) & (F.col("value") > 0) & F.col("shown").isNotNull(), F.lit(False))
    error = F.coalesce("__e", F.when(F.col("d").isNull(), "bad_date").when(bad, "bad_value"), ordered(typed), F.when(wrong, "yield"))
    return typed.withColumn("error", error).drop("__e")


def history_json(files: DataFrame) -> DataFrame:
    """The same of the API's payloads: a JSON array, or null for an empty history; yields hold to 1e-10, values may be zero."""
    schema = "dividend_date string, net_asset_value decimal(38,15), dividend_value decimal(38,15), dividend_yield decimal(38,15)"
    rows = json_rows(files.where("trim(payload) <> 'null'"), schema, ROW_KEYS)
    typed = rows.select("source", F.col("position").alias("row"), text.date_text(F.col("dividend_date"), ("dd-MM-yyyy",)).alias("d"), F.col("dividend_value").alias("amount"), F.col("net_asset_value").alias("value"), F.col("dividend_yield").alias("shown"), F.col("error").alias("__e"))
    exact = F.col("amount").cast("double") / F.col("value").cast("double") * 100
    wrong = (F.col("value") > 0) & (F.abs(exact - F.col("shown").cast("double")) > 1e-10)
    bad = F.col("amount").isNull() | F.col("value").isNull() | F.col("shown").isNull() | (F.col("value") < 0)
    error = F.coalesce("__e", F.when(F.col("d").isNull(), "bad_date").when(bad, "bad_value"), ordered(typed), F.when(wrong, "yield"))
    return typed.withColumn("error", error).drop("__e")


def third_party_captures(lines: DataFrame) -> DataFrame:
    """source, line, version, house, name, captured_at, catalogue, payload, error of captures as JSON lines (source, value), pages and API answers."""
    fields = {k: "string" for k in [*PAGE_KEYS, *API_KEYS]} | {"schema_version": "int"}
    rows = lines.select("source", F.monotonically_increasing_id().alias("line"), F.from_json("value", ", ".join(f"`{k}` {t}" for k, t in fields.items())).alias("c"), F.col("value").alias("raw"))
    c = rows.select("source", "line", "c.*", "raw")
    page = F.col("schema_version") == 1
    api = F.col("schema_version") == 2
    keys = F.when(api, has_keys(F.col("raw"), API_KEYS)).otherwise(has_keys(F.col("raw"), PAGE_KEYS))
    host = lambda k, path: (F.parse_url(k, F.lit("PROTOCOL")) == "https") & F.parse_url(k, F.lit("HOST")).endswith(f"{THIRD_PARTY}.com") & F.parse_url(k, F.lit("PATH")).startswith(path)
    fits = F.when(api, host("source_url", DETAIL_PATH)).otherwise(host("source_url", HISTORY_PATH) & host("requested_url", HISTORY_PATH))
    asked = F.lower(text.collapsed(F.url_decode(F.regexp_replace(F.parse_url("requested_url", F.lit("PATH")), f"^{HISTORY_PATH}", ""))))
    said = F.array_distinct(F.transform(F.regexp_extract_all("source_payload", F.lit(SCHEME_LITERAL), F.lit(1)), text.collapsed))
    per_file = Window.partitionBy("source")
    again = F.count("*").over(Window.partitionBy("source", "source_url", "captured_at", F.when(api, F.col("requested_scheme_name"))))
    named = F.lower(F.trim("requested_scheme_name"))
    error = (
        F.when(~(page | api) | ~keys, "keys").when(F.col("provider") != THIRD_PARTY, "provider").when(~F.coalesce(fits, F.lit(False)), "url")
        .when(~F.coalesce(F.col("captured_at").rlike(AWARE), F.lit(False)), "naive_time").when(blank(F.col("amc_name")) | blank(F.col("requested_scheme_name")) | blank(F.col("source_payload")), "no_name")
        .when(F.sha2("source_payload", 256) != F.col("source_payload_sha256"), "checksum").when(api & ~F.coalesce(F.col("catalog_sha256").rlike(HEX), F.lit(False)), "catalogue")
        .when(page & (asked != named), "requested").when(page & (F.size(said) != 1), "scheme_literal").when(page & (F.lower(F.get(said, 0)) != named), "rendered")
        .when(F.size(F.collect_set(F.coalesce("catalog_sha256", F.lit("none"))).over(per_file)) > 1, "mixed_catalogues").when(page & (again > 1), "repeated")
    )
    return c.select("source", "line", F.col("schema_version").alias("version"), F.col("amc_name").alias("house"), F.trim("requested_scheme_name").alias("name"), "captured_at", F.col("catalog_sha256").alias("catalogue"), F.col("source_payload").alias("payload"), error.alias("error"))


CATALOGUE_KEYS = ["schema_version", "provider", "captured_at", "source_url", "source_payload_sha256", "source_payload", "queries", "schemes"]
CATALOGUE = (
    "schema_version int, provider string, captured_at string, source_url string, source_payload_sha256 string, source_payload string, "
    "queries array<struct<amc_name: string, categories_payload_sha256: string, categories_payload: string, scheme_queries: array<struct<category: string, source_payload_sha256: string, source_payload: string>>>>, "
    "schemes array<struct<amc_name: string, category: string, scheme_name: string>>"
)


def third_party_catalogue(files: DataFrame) -> DataFrame:
    """source, house, category, scheme, error of the catalogue (source, payload): every checksum, each house and category asked once, declared as derived.

    What is wrong with a whole catalogue is one row with the error and no scheme.
    """
    c = files.select("source", F.from_json("payload", CATALOGUE).alias("c"), F.col("payload").alias("raw")).select("source", "c.*", "raw")
    houses = select_options(files.select("source", F.from_json("payload", CATALOGUE)["source_payload"].alias("payload"))).where(F.col("field") == AMC_SELECT).where("value <> '' and label <> ''")
    listed = houses.groupBy("source").agg(F.sort_array(F.collect_list("value")).alias("houses"), F.max(F.col("value") != F.col("label")).alias("odd"))
    c = c.join(listed, "source", "left")
    asked = F.sort_array(F.transform("queries", lambda q: q["amc_name"]))
    strings = lambda x: F.from_json(x, "array<string>")
    said_once = lambda x: F.to_json(F.struct(x["amc_name"], x["scheme_name"]))  # texts are hashed, structs would be compared pair by pair
    sums = F.forall("queries", lambda q: (F.sha2(q["categories_payload"], 256) == q["categories_payload_sha256"]) & F.forall(q["scheme_queries"], lambda s: F.sha2(s["source_payload"], 256) == s["source_payload_sha256"]))
    complete = F.forall("queries", lambda q: F.sort_array(strings(q["categories_payload"])) == F.sort_array(F.transform(q["scheme_queries"], lambda s: s["category"])))
    derived = F.flatten(F.transform("queries", lambda q: F.flatten(F.transform(q["scheme_queries"], lambda s: F.transform(strings(s["source_payload"]), lambda n: F.struct(q["amc_name"].alias("amc_name"), s["category"].alias("category"), n.alias("scheme_name")))))))
    c = c.withColumn("derived", derived)
    error = (
        F.when(~has_keys(F.col("raw"), CATALOGUE_KEYS), "keys").when(F.col("schema_version") != 2, "schema_version").when(F.col("provider") != THIRD_PARTY, "provider")
        .when(~F.coalesce(F.col("captured_at").rlike(AWARE), F.lit(False)), "naive_time").when(F.sha2("source_payload", 256) != F.col("source_payload_sha256"), "checksum")
        .when(F.col("houses").isNull() | F.col("odd") | (F.size(F.array_distinct("houses")) != F.size("houses")), "houses").when(asked != F.col("houses"), "queries")
        .when(~F.coalesce(sums, F.lit(False)), "checksum").when(~F.coalesce(complete, F.lit(False)), "categories").when(F.col("derived") != F.col("schemes"), "schemes")
        .when(F.size(F.array_distinct(F.transform("derived", said_once))) != F.size("derived"), "repeated")
    )
    told = c.withColumn("error", error)
    good = told.where("error is null").select("source", F.explode("schemes").alias("s")).select("source", F.col("s.amc_name").alias("house"), F.col("s.category").alias("category"), F.col("s.scheme_name").alias("scheme"), F.lit(None).cast("string").alias("error"))
    none = F.lit(None).cast("string")
    return good.unionByName(told.where("error is not null").select("source", none.alias("house"), none.alias("category"), none.alias("scheme"), "error"))


def row_quality(value: Column, amount: Column) -> Column:
    """The status of a third party's row; the first that holds counts."""
    return F.when(value == 0, "zero_reference_nav").when(amount > 0, "valid").when(amount == 0, "zero_amount").otherwise("negative_amount")


def row_counters(rows: DataFrame, today: str) -> DataFrame:
    """One row of counts over a third party's rows (d, amount, value): positive, zero and negative amounts, implausible and future days."""
    day = F.col("d")
    return rows.agg(
        F.count("*").alias("rows"), F.count_if(F.col("amount") > 0).alias("positive"), F.count_if(F.col("amount") == 0).alias("zero"), F.count_if(F.col("amount") < 0).alias("negative"),
        F.count_if(F.col("value") == 0).alias("zero_reference"), F.count_if(day < F.lit("1964-01-01").cast("date")).alias("implausible"), F.count_if(day > F.lit(today).cast("date")).alias("future"),
    )


def completeness(declared: DataFrame, captured: DataFrame, keys: list[str]) -> DataFrame:
    """keys and side of what a catalogue declares and no capture has, or the other way round."""
    d, c = declared.select(*keys).distinct(), captured.select(*keys).distinct()
    return d.join(c, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(c.join(d, keys, "left_anti").withColumn("side", F.lit("extra")))


def is_missing_file_page(payload: Column) -> Column:
    """Whether the exchange answered with its own home page where a file would be."""
    head = F.lower(F.regexp_replace(F.substring(payload, 1, 32768), "^\\s+", ""))
    return head.startswith("<!doctype html") & head.contains(MISSING_FILE_MARKS[0]) & head.contains(MISSING_FILE_MARKS[1]) & head.contains(MISSING_FILE_MARKS[2])


# Marks of a fund house's payout notice and of its scheme summary.
NOTICE_MARKS = ("HDFC Asset Management Company Limited", "Distribution cum Capital Withdrawal")
NOTICE_TABLE = "(?s)(Name of the Scheme / Plan\\(s\\) / Option\\(s\\).*?)#Amount of distribution per unit"
NOTICE_DAY = "(?i)(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday),\\s*([A-Za-z]+ +[0-9]{1,2}, +[0-9]{4}).*?fixed as the Record Date"
NOTICE_OPTION = "(?i)(HDFC\\s+.+?)\\s*-\\s*(Regular|Direct)\\s+Plan\\s*-\\s*IDCW\\s+Option\\s*\\(Payout\\s+and\\s+Reinvestment\\)(?:\\s*([0-9]+\\.[0-9]{3,6}))?"
NOTICE_AMOUNT = "(?<![0-9.])([0-9]+\\.[0-9]{2,6})(?![0-9.])"
FACE_VALUE = "10.00"
SUMMARY_SECTION = "(?i)AMFI Codes \\(To be phased out\\)\\s*(.+?)30\\s+SEBI Codes"
SUMMARY_CODE = "([0-9]{6})\\s*-\\s*(.+?)(?=\\s*[0-9]{6}\\s*-|$)"


def clean_name(c: Column) -> Column:
    return F.regexp_replace(text.collapsed(c), "^[ -]+|[ -]+$", "")


def notices(texts: DataFrame) -> DataFrame:
    """source, name, plan, d, amount, error of extracted notices (source, payload): a row for each option, which share one amount."""
    t = texts.select("source", text.collapsed(F.regexp_replace("payload", "`", "₹")).alias("t"))
    t = t.withColumns({"table": F.regexp_extract("t", NOTICE_TABLE, 1), "day": F.regexp_extract("t", NOTICE_DAY, 1)})
    t = t.withColumns({"hits": F.regexp_extract_all("table", F.lit(NOTICE_OPTION), F.lit(0)), "rest": F.regexp_replace("table", NOTICE_OPTION, " ")})
    amounts = F.filter(F.regexp_extract_all("rest", F.lit(NOTICE_AMOUNT), F.lit(1)), lambda x: x.cast("decimal(18,6)") != F.lit(FACE_VALUE).cast("decimal(18,6)"))
    t = t.withColumns({"amounts": amounts, "d": F.try_to_date(text.collapsed(F.col("day")), "MMMM d, yyyy")})
    bare = F.exists("hits", lambda h: F.regexp_extract(h, NOTICE_OPTION, 3) == "")
    error = (
        F.when(~F.col("t").contains(NOTICE_MARKS[0]), "issuer").when(~F.col("t").contains(NOTICE_MARKS[1]), "no_declaration").when(F.col("d").isNull(), "bad_date")
        .when((F.col("table") == "") | ~F.col("table").contains("Amount of Distribution") | ~F.col("table").contains("Face Value"), "table").when(F.size("hits") == 0, "no_options")
        .when(bare, "no_value").when(F.size("amounts") != 1, "amounts").when(F.get("amounts", 0).cast("decimal(18,6)") <= 0, "bad_value")
    )
    rows = t.withColumn("error", error).select("source", "d", F.get("amounts", 0).try_cast("decimal(18,6)").alias("amount"), "error", F.explode_outer(F.when(error.isNull(), F.col("hits"))).alias("hit"))
    return rows.select("source", clean_name(F.regexp_extract("hit", NOTICE_OPTION, 1)).alias("name"), F.lower(F.regexp_extract("hit", NOTICE_OPTION, 2)).alias("plan"), "d", F.when(F.col("error").isNull(), F.col("amount")).alias("amount"), "error")


def scheme_codes(texts: DataFrame) -> DataFrame:
    """source, code, name, plan, option, error of the code section in extracted scheme summaries."""
    t = texts.select("source", text.collapsed(F.regexp_replace("payload", "`", "₹")).alias("t")).withColumn("section", F.regexp_extract("t", SUMMARY_SECTION, 1))
    hits = F.regexp_extract_all("section", F.lit(SUMMARY_CODE), F.lit(0))
    error = F.when(~F.col("t").contains("SCHEME SUMMARY DOCUMENT") | ~F.col("t").contains("HDFC"), "issuer").when(F.col("section") == "", "section").when(F.size(hits) == 0, "no_codes")
    rows = t.withColumn("error", error).select("source", "error", F.explode_outer(F.when(error.isNull(), hits)).alias("hit"))
    label = F.trim(F.regexp_extract("hit", SUMMARY_CODE, 2))
    name = clean_name(F.regexp_replace(label, "(?i)\\s*-\\s*(?:IDCW|Growth) Plan(?:\\s*-\\s*Direct Plan)?\\s*$", ""))
    up = F.upper(label)
    return rows.select("source", F.regexp_extract("hit", SUMMARY_CODE, 1).alias("code"), name.alias("name"), F.when(up.contains("DIRECT PLAN"), "direct").otherwise("regular").alias("plan"), F.when(up.contains("IDCW"), "idcw").otherwise("growth").alias("option"), "error")
