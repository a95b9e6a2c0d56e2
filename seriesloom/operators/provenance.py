"""Payout events with their revisions and, under each revision, the source rows behind it: from four kinds of sources.

The chains differ in depth. A regulator's row was seen in batches, a notice also rests on a batch that proves the identity;
a registrar's row comes by a capture and its mapping's review; a third party's also by a scheme of a
catalogue. All end in one typed record, so that a reader need not know the kinds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What providers and kinds of sources are called in records.
REGULATOR, REGULATOR_KIND, NOTICE_KIND = "amfi", "amfi_distribution_api", "amc_distribution_notice"
REGISTRAR_KIND, THIRD_PARTY, THIRD_PARTY_KIND = "rta_distribution_history", "advisorkhoj", "third_party_distribution_history"
FIELDS = {
    "provider": "string", "kind": "string", "seq": "long", "fund": "string", "scheme": "string", "option": "string", "scheme_name": "string", "shown_name": "string", "d": "date", "raw": "string", "unit": "string", "signature": "string",
    "batch": "string", "url": "string", "retrieved_at": "timestamp", "parser": "string", "sha256": "string", "identity_batch": "string", "identity_url": "string", "identity_sha256": "string", "identity_evidence": "string",
}


def record(rows: DataFrame, **columns: Column | str) -> DataFrame:
    """revision_key and the record of rows; fields that are not given are null."""
    found = {k: F.lit(None) if k not in columns else F.col(v) if isinstance(v := columns[k], str) else v for k in FIELDS}
    return rows.select("code", "event_day", "revision", F.struct(*[c.cast(FIELDS[k]).alias(k) for k, c in found.items()]).alias("source"))


def of_kind(links: DataFrame, kind: str) -> DataFrame:
    return links.where(F.col("source") == kind).select("seq", "code", F.col("d").alias("event_day"), "revision")


def from_regulator(links: DataFrame, rows: DataFrame, seen: DataFrame, batches: DataFrame) -> DataFrame:
    """Records of rows (seq, fund, scheme, option, scheme_name, shown_name, d, raw, unit, signature), one for each batch that they were seen in (seq, batch)."""
    both = of_kind(links, "regulator").join(rows, "seq").join(seen.select("seq", "batch"), "seq").join(batches, "batch")
    same = ("seq", "fund", "scheme", "option", "scheme_name", "shown_name", "d", "raw", "unit", "signature", "batch", "url", "retrieved_at", "parser", "sha256")
    return record(both, provider=F.lit(REGULATOR), kind=F.lit(REGULATOR_KIND), **{c: c for c in same})


def from_notices(links: DataFrame, rows: DataFrame, seen: DataFrame, batches: DataFrame) -> DataFrame:
    """Records of rows (seq, provider, option, scheme_name, plan, label, d, raw, unit, signature, identity_batch)."""
    proof = batches.select(F.col("batch").alias("identity_batch"), F.col("url").alias("identity_url"), F.col("sha256").alias("identity_sha256"))
    both = of_kind(links, "fund_house").join(rows, "seq").join(seen.select("seq", "batch"), "seq").join(batches, "batch").join(proof, "identity_batch", "left")
    name = F.concat("scheme_name", F.lit(" - "), F.initcap("plan"), F.lit(" Plan - "), "label")
    same = ("provider", "seq", "option", "scheme_name", "d", "raw", "unit", "signature", "batch", "url", "retrieved_at", "parser", "sha256", "identity_batch", "identity_url", "identity_sha256")
    return record(both, kind=F.lit(NOTICE_KIND), shown_name=name, **{c: c for c in same})


def from_registrars(links: DataFrame, rows: DataFrame, captures: DataFrame, reviews: DataFrame, batches: DataFrame) -> DataFrame:
    """Records of rows (seq, capture, d, raw, signature), their captures (capture, provider, fund, scheme, scheme_name, plan, variant, url, captured_at, batch) and the captures' reviews (capture, evidence)."""
    proof = batches.select("batch", "parser", "sha256")
    both = of_kind(links, "registrar").join(rows, "seq").join(captures, "capture").join(reviews.select("capture", "evidence"), "capture", "left").join(proof, "batch")
    name = F.concat_ws(" - ", "scheme_name", F.initcap("plan"), F.initcap("variant"))
    same = ("provider", "seq", "fund", "scheme", "scheme_name", "d", "raw", "signature", "batch", "url", "parser", "sha256")
    return record(both, kind=F.lit(REGISTRAR_KIND), option="scheme", shown_name=name, unit=F.lit("inr_per_unit"), retrieved_at="captured_at", identity_batch="batch", identity_url="url", identity_sha256="sha256", identity_evidence="evidence", **{c: c for c in same if c != "option"})


def from_third_party(links: DataFrame, rows: DataFrame, captures: DataFrame, catalogue: DataFrame, reviews: DataFrame, batches: DataFrame) -> DataFrame:
    """Records of rows (seq, capture, d, raw, signature), captures (capture, entry, plan, variant, frequency, url, captured_at, batch), the catalogue's schemes (entry, scheme_name) and reviews (capture, evidence)."""
    proof = batches.select("batch", "parser", "sha256")
    both = of_kind(links, "third_party").join(rows, "seq").join(captures, "capture").join(catalogue.select("entry", "scheme_name"), "entry").join(reviews.select("capture", "evidence"), "capture", "left").join(proof, "batch")
    name = F.concat_ws(" - ", "scheme_name", F.initcap("plan"), F.initcap("variant"), F.initcap("frequency"))
    same = ("seq", "scheme_name", "d", "raw", "signature", "batch", "url", "parser", "sha256")
    return record(both, provider=F.lit(THIRD_PARTY), kind=F.lit(THIRD_PARTY_KIND), option="entry", shown_name=name, unit=F.lit("inr_per_unit"), retrieved_at="captured_at", identity_batch="batch", identity_url="url", identity_sha256="sha256", identity_evidence="evidence", **{c: c for c in same})


def page_of(revisions: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """code, d, place and total of a page of each series' events, the latest first."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("a page has 1 to 200 events, and its offset is not negative")
    events = revisions.select("code", "d").distinct()
    place = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("d")))
    return events.withColumns({"place": place, "total": F.count("*").over(Window.partitionBy("code"))}).where((F.col("place") > offset) & (F.col("place") <= offset + limit))


def drill_down(revisions: DataFrame, records: list[DataFrame], coverage: DataFrame | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """code, total, d, place and revisions of a page of each series' events, the latest first, with the series' coverage where it is given.

    revisions (code, d, revision, amount, current, at) become an array, the latest first, each with its sources in order of
    retrieval. The page is cut before the records join, so that only what is shown is gathered; an
    array holds the rows of one event. Chains of very many rows are made of the page's rows alone, by page_of.
    """
    page = page_of(revisions, limit, offset)
    every = reduce(DataFrame.unionByName, records).withColumnRenamed("event_day", "d").join(page.select("code", "d"), ["code", "d"], "left_semi")
    order = F.struct(F.col("source.retrieved_at").alias("t"), F.col("source.batch").alias("b"), F.col("source.kind").alias("k"), F.col("source.seq").alias("s"), "source")
    sources = every.groupBy("code", "d", "revision").agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["source"]).alias("sources"))
    shown = revisions.join(page, ["code", "d"]).join(sources, ["code", "d", "revision"], "left")
    item = F.struct("revision", "amount", "current", "at", F.coalesce("sources", F.array().cast(sources.schema["sources"].dataType)).alias("sources"))
    out = shown.groupBy("code", "total", "d", "place").agg(F.reverse(F.array_sort(F.collect_list(item), lambda a, b: a["revision"] - b["revision"])).alias("revisions"))
    return out if coverage is None else out.join(coverage.select("code", F.struct(*[c for c in coverage.columns if c != "code"]).alias("coverage")), "code", "left")
