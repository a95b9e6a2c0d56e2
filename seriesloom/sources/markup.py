"""Tables of web pages and members of ZIP files, through Arrow batches."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import date, datetime
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, text

# Texts that a page shows instead of rows.
EMPTY_MARKERS = ("no record found", "no data found", "no records found", "no dividend records found")
FUND_LINK, FUND_TITLE = re.compile(r"Dividend\.aspx\?Fund=([A-Za-z0-9_-]+)", re.I), "comptitle"
# The columns of a registrar's payout table, by their headings.
PAYOUT_COLUMNS = {
    "record_date": ["record date", "recorded date"], "individual": ["individual", "dividend rate individual"], "non_individual": ["non individual", "dividend rate non individual"],
    "ex_nav": ["ex nav"], "cum_nav": ["cum nav"],
}
# Rows of cells without attributes or references, as long tables have them: read at once where no tag, script or cell is open.
PLAIN_ROWS = re.compile("(?:<tr>(?:<td>[^<&]*+(?:<br>[^<&]*+)*+</td>)++</tr>)++")
ROWS_AT_ONCE = 20_000  # of a batch that goes back to Spark


class Page(HTMLParser):
    """Headings, tables as rows of cell texts with their identifiers, select options, hidden fields and links of a page."""

    CELLS = ("td", "th", "h1", "h2", "option")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[tuple[str, list[list[str]]]] = []
        self.open: list[tuple[str, list[list[str]]]] = []
        self.options: list[tuple[str, str, str]] = []
        self.hidden: dict[str, str] = {}
        self.headings: list[str] = []
        self.funds: list[tuple[str, str]] = []
        self.text: list[str] | None = None
        self.select, self.value, self.code, self.title = "", "", "", ""

    def read(self, html: str) -> None:
        """What feed and close do, but that plain rows are split, not parsed."""
        at = 0
        for run in PLAIN_ROWS.finditer(html):
            self.feed(html[at : run.start()])
            if self.rawdata or self.cdata_elem is not None or self.text is not None or not self.open:
                self.feed(run[0])
            else:
                cells = (row.replace("<br>", " ")[4:-5].split("</td><td>") for row in run[0][4:-5].split("</tr><tr>"))
                self.open[-1][1].extend([" ".join(c.split()) for c in row] for row in cells)
                self.code = self.title = self.value = ""
            at = run.end()
        self.feed(html[at:])
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "table":
            self.open.append((a.get("id", ""), []))
        elif tag == "tr":
            self.code = self.title = ""
            if self.open:
                self.open[-1][1].append([])
        elif tag in self.CELLS:
            self.text, self.value = [], a.get("value", "") if tag == "option" else a.get("class", "")
        elif tag == "br" and self.text is not None:
            self.text.append(" ")
        elif tag == "select":
            self.select = a.get("id") or a.get("name", "")
        elif tag == "input" and a.get("type", "").lower() == "hidden":
            self.hidden[a.get("name", "")] = a.get("value", "")
        elif tag == "a" and (m := FUND_LINK.search(a.get("href", ""))):
            self.code = m[1]

    def handle_data(self, data: str) -> None:
        if self.text is not None:
            self.text.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.open:
            name, rows = self.open.pop()
            self.tables.append((name, [r for r in rows if any(r)]))
        elif tag == "tr" and self.code and self.title:
            self.funds.append((self.code, self.title))
            self.code = ""
        if self.text is None or tag not in self.CELLS:
            return
        value = " ".join("".join(self.text).split())
        if tag in ("td", "th"):
            if FUND_TITLE in self.value.split():
                self.title = value
            if self.open and self.open[-1][1]:
                self.open[-1][1][-1].append(value)
        elif tag in ("h1", "h2"):
            self.headings.append(value)
        else:
            self.options.append((self.select, self.value, value))
        self.text = None


def parsed(html: str | None) -> Page:
    page = Page()
    page.read(html or "")
    return page


def heading(cell: str) -> str:
    return " ".join(re.sub("[^a-z0-9]+", " ", cell.lower()).split())


def found_table(page: Page, index: dict[str, str], required: set[str], table_id: str | None, exact: bool) -> tuple[list[str | None], list[list[str]], str | None]:
    """The columns of the first row that names the required ones, the rows after it, and what is wrong."""
    tables = [rows for name, rows in page.tables if table_id is None or name == table_id]
    if exact and len(tables) != 1:
        return [], [], "tables"
    for rows in tables:
        for i, row in enumerate(rows[:1] if exact else rows):
            columns = [index.get(heading(c)) for c in row]
            if exact and (None in columns or len(set(columns)) != len(columns)) or not required <= set(columns):
                continue
            return columns, rows[i + 1 :], None
    return [], [], "headers"


def table_rows(pages: DataFrame, headers: dict[str, list[str]], *, required: list[str] | None = None, table_id: str | None = None, exact: bool = False) -> DataFrame:
    """source, row, one column for each header, error: the rows of the page's first table with the required headers.

    headers has the synonyms of each column, as words; columns of other headings are left out. exact asks
    for one table whose first row has just these headers. A page without rows that says so gives none.
    Rows of another number of cells are errors; rows that repeat are one, but not where exact.
    """
    names = list(headers)
    index = {heading(s): n for n, synonyms in headers.items() for s in synonyms}
    needed = set(required or names)
    schema = pa.schema([("source", pa.string()), ("row", pa.int32()), *[(n, pa.string()) for n in names], ("error", pa.string())])
    none = [None] * len(names)

    def found(source: str, html: str | None) -> list[tuple]:
        columns, rows, error = found_table(parsed(html), index, needed, table_id, exact)
        if error:
            told = not exact and any(m in (html or "").lower() for m in EMPTY_MARKERS)
            return [] if told else [(source, 0, *none, error)]
        at = {n: i for i, n in enumerate(columns)}  # the last of columns of one name
        places = [at.get(n, len(columns)) for n in names]  # a place behind the cells holds a null
        out, seen = [], set()
        for i, cells in enumerate(rows):
            if len(cells) != len(columns):
                out.append((source, i, *none, "columns"))
            elif exact or tuple(cells) not in seen:
                if not exact:
                    seen.add(tuple(cells))
                row = [*cells, None]
                out.append((source, i, *[row[p] for p in places], None))
        return out

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for source, html in zip(batch.column("source"), batch.column("payload"), strict=True):
                out += found(source.as_py(), html.as_py())
                if len(out) >= ROWS_AT_ONCE:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    return pages.select("source", "payload").mapInArrow(run, f"source string, row int, {', '.join(f'`{n}` string' for n in names)}, error string")


def registrar_payouts(pages: DataFrame) -> DataFrame:
    """source, row, d, individual, non_individual, ex_nav, cum_nav, error of a registrar's payout pages."""
    rows = table_rows(pages, PAYOUT_COLUMNS, required=["record_date", "individual"])
    number = lambda n: text.decimal_text(F.col(n), "decimal(20,10)")
    wrong = lambda n: ~F.coalesce(F.trim(n), F.lit("")).isin("", "-", "--", "NA", "N/A") & ~F.coalesce(number(n) >= 0, F.lit(False))
    d = text.date_text(F.col("record_date"), ("dd/MM/yyyy", "dd/MMM/yyyy", "dd-MM-yyyy", "dd-MMM-yyyy", "dd MMM yyyy"))
    error = F.coalesce("error", F.when(d.isNull(), "bad_date").when(~F.coalesce(number("individual") > 0, F.lit(False)) | wrong("non_individual") | wrong("ex_nav") | wrong("cum_nav"), "bad_value"))
    return rows.select("source", "row", d.alias("d"), *[number(n).alias(n) for n in ("individual", "non_individual", "ex_nav", "cum_nav")], error.alias("error"))


def registrar_funds(pages: DataFrame) -> DataFrame:
    """source, code, name, error of the funds that a registrar's landing page links; a page without any is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for source, html in zip(batch["source"], batch["payload"], strict=True):
                funds = parsed(html).funds
                codes = [c for c, _ in funds]
                out += [(source, c, n, "repeated" if codes.count(c) > 1 else None) for c, n in funds] or [(source, None, None, "no_funds")]
            yield pd.DataFrame(out, columns=["source", "code", "name", "error"])

    return pages.select("source", "payload").mapInPandas(run, "source string, code string, name string, error string")


def scheme_options(pages: DataFrame, field: str = "ctl00$ContentPlaceHolder1$SelScheme") -> DataFrame:
    """source, code, name, aliases, plan, error of a registrar's scheme list: labels of one code are one scheme.

    Its name is the first label that states the plan; labels that state different plans are in conflict.
    """
    rows = select_options(pages).where(F.col("field") == field).where(~F.col("value").isin("", "0") & (F.col("label") != ""))
    each = rows.groupBy("source", F.trim("value").alias("code"), F.col("label").alias("name")).agg(F.min("place").alias("place")).withColumn("plan", names.registrar_plan(F.col("name")))
    known = F.col("plan") != "unknown"
    best = F.min(F.struct(~known, "place", "name"))
    out = each.groupBy("source", "code").agg(best.alias("b"), F.sort_array(F.collect_list(F.struct("place", "name"))).alias("all"), F.count_distinct(F.when(known, F.col("plan"))).alias("plans"), F.max(F.when(known, F.col("plan"))).alias("plan"), F.min("place").alias("place"))
    aliases = F.filter(F.transform("all", lambda x: x["name"]), lambda n: n != F.col("b.name"))
    return out.select("source", "code", F.col("b.name").alias("name"), aliases.alias("aliases"), F.coalesce("plan", F.lit("unknown")).alias("plan"), F.when(F.col("plans") > 1, "plan_conflict").alias("error"), "place")


def select_options(pages: DataFrame) -> DataFrame:
    """source, place, field, value, label of every option of every select."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(s, i, *o) for s, html in zip(batch["source"], batch["payload"], strict=True) for i, o in enumerate(parsed(html).options)]
            yield pd.DataFrame(rows, columns=["source", "place", "field", "value", "label"])

    return pages.select("source", "payload").mapInPandas(run, "source string, place int, field string, value string, label string")


def safe_member(name: str) -> bool:
    return not (name.startswith(("/", "\\")) or ".." in name.replace("\\", "/").split("/") or ":" in name)


# Names of the members that hold a day's file, and when the membership file began.
LARGEST_PRICES, LARGEST_MEMBERS, MEMBERS_FROM = 20_000_000, 5_000_000, date(2010, 3, 8)
DATED_MEMBER = re.compile(r"(?:nupr(\d{6})/)?etf(\d{6}|\d{8})\.csv", re.I)


def decoded(content: bytes) -> str:
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("cp1252", "replace")


def price_member(z: zipfile.ZipFile, kind: str, day: date) -> tuple[str | None, str | None]:
    """The member that holds a price file of the day, or what is wrong."""
    files = [i for i in z.infolist() if not i.is_dir()]
    if kind == "bse":
        hits = [i for i in files if i.filename.lower() == f"eq{day:%d%m%y}.csv"]
    else:
        hits = files
    if len(hits) != 1:
        return None, "members"
    name = hits[0].filename.lower()
    wanted = f"cm{day:%d%b%Y}bhav.csv".lower()
    fits = name in (wanted, f"{wanted}/{wanted}") if kind == "nse" else "/" not in name and name.endswith(".csv")
    if "\\" in name or not fits or not safe_member(hits[0].filename):
        return None, "unsafe_member"
    return (None, "too_large") if hits[0].file_size > LARGEST_PRICES else (hits[0].filename, None)


def membership_member(z: zipfile.ZipFile, kind: str, day: date) -> tuple[str | None, str | None]:
    """The member that lists the day's exchange-traded funds; a report of before there were any is empty, one of another day not published."""
    files = {i.filename.lower(): i for i in z.infolist() if not i.is_dir()}
    short = f"{day:%d%m%y}"
    hits = [n for n in (f"etf{short}.csv", f"etf{day:%d%m%Y}.csv", f"nupr{short}/etf{short}.csv") if n in files]
    if len(hits) == 1:
        return (None, "too_large") if files[hits[0]].file_size > LARGEST_MEMBERS else (files[hits[0]].filename, None)
    dated = [m for m in map(DATED_MEMBER.fullmatch, files) if m and m[1] in (None, m[2])]
    if not hits and not dated and day < MEMBERS_FROM and f"pr{short}.csv" in files:
        return None, "empty"
    if not hits and len(dated) == 1:
        try:
            datetime.strptime(dated[0][2], "%d%m%y" if len(dated[0][2]) == 6 else "%d%m%Y")
        except ValueError:
            return None, "members"
        return None, "not_published"
    return None, "members"


def zip_members(files: DataFrame) -> DataFrame:
    """source, kind, day, payload, error of binary files (path, content, kind, day): the one safe member that the day's file is.

    kind is unified, nse or bse for price files, which may also come bare, and members for the list of
    exchange-traded funds, which may not.
    """

    def one(content: bytes, kind: str, day: date) -> tuple[str | None, str | None]:
        if not content.startswith(b"PK"):
            return (None, "no_zip") if kind == "members" else (decoded(content), None)
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                name, error = (membership_member if kind == "members" else price_member)(z, kind, day)
                return (decoded(z.read(name)), None) if name else (None, error)
        except zipfile.BadZipFile:
            return None, "no_zip"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [one(bytes(c), k, d) for c, k, d in zip(batch["content"], batch["kind"], batch["day"], strict=True)]
            yield pd.DataFrame({"source": batch["path"], "kind": batch["kind"], "day": batch["day"], "payload": [x for x, _ in found], "error": [e for _, e in found]})

    return files.select("path", "content", "kind", "day").mapInPandas(run, "source string, kind string, day date, payload string, error string")
