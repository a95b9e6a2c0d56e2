"""Publication of payouts from sources of three tiers into events with one current amount each.

An *event* is a (code, d) with amount (null where a conflict of equals has retired it), tier (of the
current amount, or the highest ever attached where none is current) and revision. Source rows come in
order of arrival, seq. Each publisher returns its rows with the action taken and the issue that holds
a row back; ``after`` folds them into the events that follow. The regulator's and the fund houses' rows
are tier 1, registrars' 2, third parties' 3.

What a row meets depends on the rows before it, but in each case only on whether the amounts so far
agree, so windows over (code, d) in order of seq express it, without a fold in Python.

A row that stands behind a revision is *linked* to it, in a ledger (source, seq, code, d, revision) that
outlives the run; seq is the row's identity there. A publisher that is given the links of earlier runs
passes linked rows over as unchanged, with the revision in the column tied, so that a second run
of the same rows changes nothing. ``new_links`` and ``new_issues`` are what a run adds to the ledgers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels, names

OLDEST_DAY = "1964-01-01"  # no fund paid before
LEAST_MATCHES, LEAST_SPAN = 3, 30
EVENT = "code long, d date, amount double, tier int, revision int"
LINK = "source string, seq long, code long, d date, revision int"
ISSUE = "source string, seq long, review string, issue string"
REGULATOR, REGISTRAR, THIRD_PARTY = "regulator", "registrar", "third_party"
ORIGIN = ("capture", "raw", "other_raw", "ex_nav", "cum_nav")  # what a registrar's row was read from; a table may have fewer


def too_old(day: Column) -> Column:
    return day < F.lit(OLDEST_DAY).cast("date")


def against(rows: DataFrame, events: DataFrame) -> DataFrame:
    """rows with the event's amount, tier and revision as of before."""
    before = events.select("code", "d", F.col("amount").alias("was"), F.col("tier").alias("was_tier"), F.col("revision").alias("was_revision"), F.lit(True).alias("there"))
    return rows.join(before, ["code", "d"], "left").withColumn("there", F.coalesce("there", F.lit(False)))


def in_order() -> Window:
    return Window.partitionBy("code", "d").orderBy("seq")


def so_far() -> Window:
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


def numbered(rows: DataFrame) -> DataFrame:
    """rows with the revision that each row leaves current."""
    new = F.sum(F.when(F.col("action").isin("inserted", "revised"), 1).otherwise(0)).over(so_far())
    return rows.withColumn("revision", (F.coalesce("was_revision", F.lit(0)) + new).cast("int"))


def tied_rows(rows: DataFrame, links: DataFrame | None, source: str, how: str = "left") -> DataFrame:
    """rows with tied: the revision that an earlier run has linked a row to, else null."""
    if links is None:
        return rows.withColumn("tied", F.lit(None).cast("int"))
    return rows.join(links.where(F.col("source") == source).select("seq", F.col("revision").alias("tied")), "seq", how)


def normalise(rows: DataFrame, known: DataFrame, events: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """The regulator's rows (code, d, seq, unit, value, scheme, label), all that are stored, with gate, action, revision and tied.

    A row that passes the gate sets the event's amount, whatever tier it had: inserted, revised or
    unchanged; others are blocked. Where rows that pass and rows that do not meet in one event of a
    known option, all are refused: their identity is in doubt. A row linked before is unchanged; one
    that does not pass any more, or is gone, fails the job.
    """
    rows = tied_rows(rows, links, REGULATOR, "full")
    gated = labels.with_option_kind(rows.join(known.select("code", F.lit(True).alias("known")), "code", "left"), "scheme", "label")
    gated = gated.withColumn("gate", labels.gate(F.coalesce("known", F.lit(False)), F.col("unit"), F.col("value"), F.col("kind")))
    passes = F.col("gate") == "cash_amount_candidate"
    whole = Window.partitionBy("code", "d")
    mixed = F.coalesce("known", F.lit(False)) & (F.max(F.coalesce(passes, F.lit(False))).over(whole)) & (F.max(~F.coalesce(passes, F.lit(False))).over(whole))
    met = against(gated.withColumn("mixed", mixed), events)
    acts, tied = passes & F.col("tied").isNull(), F.col("tied").isNotNull()
    last = F.coalesce(F.last(F.when(acts, F.col("value")), ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, -1)), F.col("was"))
    none_yet = ~F.col("there") & (F.sum(F.when(acts, 1).otherwise(0)).over(so_far()) == 1)
    lost = tied & ~F.coalesce(passes & F.col("code").isNotNull(), F.lit(False))
    action = (
        F.when(lost, F.raise_error(F.concat_ws(" ", F.lit("a linked row is no longer a cash amount candidate:"), "seq"))).when(F.col("mixed"), "refused").when(tied, "unchanged")
        .when(passes, F.when(last == F.col("value"), "unchanged").when(none_yet, "inserted").otherwise("revised")).otherwise("blocked")
    )
    out = numbered(met.withColumn("action", action)).withColumn("revision", F.coalesce("tied", "revision"))
    return out.withColumns({"amount": F.when(passes & ~F.col("mixed"), F.col("value")), "tier": F.lit(1), "issue": F.lit(None).cast("string")})


def standing(rows: DataFrame, events: DataFrame, links: DataFrame, stored: DataFrame | None) -> DataFrame:
    """code, d and origin of the rows that are linked to the current revision and have its amount."""
    every = rows if stored is None else rows.select("seq", "origin", "amount").unionByName(stored.select("seq", "origin", "amount"))
    tied = links.where(F.col("source") == REGISTRAR).select("seq", "code", "d", "revision").join(every.select("seq", "origin", "amount"), "seq")
    return tied.join(events.where("amount is not null").select("code", "d", "revision", "amount"), ["code", "d", "revision", "amount"]).select("code", "d", "origin").distinct()


def publish_registrar(rows: DataFrame, events: DataFrame, links: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """A registrar's rows (code, state, d, seq, amount, and ORIGIN) with action, issue, revision and tied.

    state is the mapping's: only mapped rows are published. A row that agrees with the current amount is
    linked to it; one that differs is a conflict, which retires an amount of the registrar's own tier, so
    that no later row is published; a third party's amount is replaced. A row whose origin is that of one
    behind the current amount was read anew: it is no conflict but a revision. Rows linked before are
    unchanged; stored has those that are not among rows.
    """
    issue = F.when(F.col("tied").isNotNull(), None).when(too_old(F.col("d")), "implausible_record_date").when(F.col("state") == "mapped", None).when(F.col("state") == "ambiguous", "ambiguous_scheme").otherwise("unmapped_scheme")
    with_origin = lambda df: df.withColumn("origin", F.to_json(F.struct(*[c for c in ORIGIN if c in rows.columns])))
    judged = tied_rows(with_origin(rows), links, REGISTRAR).withColumn("issue", issue).withColumn("acts", F.col("issue").isNull() & F.col("tied").isNull())
    met = against(judged, events)  # rows that do not act go the same way, in windows of their own
    in_turn = Window.partitionBy("code", "d", "acts").orderBy("seq")
    until = in_turn.rowsBetween(Window.unboundedPreceding, 0)
    if links is None:
        met = met.withColumn("stands", F.lit(False))
    else:
        behind = standing(with_origin(rows), events, links, None if stored is None else with_origin(stored))
        met = met.join(behind.withColumn("stands", F.lit(True)), ["code", "d", "origin"], "left").withColumn("stands", F.coalesce("stands", F.lit(False)))
    own = F.coalesce(F.col("was_tier") == 2, F.lit(False)) & F.col("was").isNotNull()
    first = F.row_number().over(in_turn) == 1
    before = F.when(first, F.when(own, F.col("was"))).otherwise(F.lag("amount").over(in_turn))
    met = met.withColumns({"own": own, "first": first, "turns": F.coalesce(before != F.col("amount"), F.lit(False))})
    met = met.withColumn("part", F.sum(F.col("turns").cast("int")).over(until))
    same = Window.partitionBy("code", "d", "acts", "origin").orderBy("seq")
    again = F.col("turns") & (F.coalesce(F.lag("part").over(same) == F.col("part") - 1, F.lit(False)) | ((F.col("part") == 1) & F.col("own") & F.col("stands")))
    met = met.withColumn("again", again)
    broken = F.max(F.col("turns") & ~F.col("again")).over(until)
    primary = F.coalesce(F.col("was_tier") == 1, F.lit(False)) & F.col("was").isNotNull()
    settled = F.col("there") & F.col("was").isNull() & (F.col("was_tier") <= 2)  # a conflict of before stays one
    action = (
        F.when(~F.col("acts"), F.when(F.col("tied").isNull(), "blocked").otherwise("unchanged")).when(primary, F.when(F.col("was") == F.col("amount"), "linked").otherwise("conflict")).when(settled | broken, "conflict").when(F.col("again"), "revised")
        .when(F.col("first") & ~F.col("own"), F.when(~F.col("there"), "inserted").when(F.col("was") == F.col("amount"), "linked").otherwise("revised")).otherwise("linked")
    )
    out = numbered(met.withColumn("action", action).withColumn("issue", F.when(F.col("action") == "conflict", "amount_conflict").otherwise(F.col("issue"))))
    out = out.withColumn("revision", F.when(F.col("acts"), F.col("revision")).otherwise(F.col("tied")))
    retires = (F.col("action") == "conflict") & (F.coalesce("was_tier", F.lit(2)) != 1)
    return out.select(*rows.columns, "issue", "action", "revision", "tied", F.lit(2).alias("tier"), retires.alias("retires"))


def publish_third_party(rows: DataFrame, events: DataFrame, links: DataFrame | None = None, issues: DataFrame | None = None, most_options: int | None = None) -> DataFrame:
    """A third party's rows (code, d, seq, amount, and review, the mapping's) with action, issue, revision and tied.

    Its rows of a day that disagree among themselves, or with the current amount, are all held back; a
    conflict with an amount of its own tier retires that. Where a conflict has left no amount, none comes.
    Rows linked before are unchanged, and rows with an issue under the same review are skipped. Of
    the others only the first most_options options' are published, if that is given; the rest wait.
    """
    review = F.col("review").cast("string") if "review" in rows.columns else F.lit(None).cast("string")
    judged = tied_rows(rows, links, THIRD_PARTY).withColumn("__review", F.coalesce(review, F.lit("")))
    if issues is None:
        judged = judged.withColumn("__told", F.lit(False))
    else:
        told = issues.where(F.col("source") == THIRD_PARTY).select("seq", F.coalesce("review", F.lit("")).alias("__review"), F.lit(True).alias("__told")).distinct()
        judged = judged.join(told, ["seq", "__review"], "left").withColumn("__told", F.coalesce("__told", F.lit(False)))
    idle = F.when(F.col("tied").isNotNull(), "unchanged").when(F.col("__told"), "skipped")
    judged = judged.withColumn("__idle", idle).drop("__review", "__told")
    if most_options is not None:
        if most_options < 1:
            raise ValueError("at least one option is published")
        turn = judged.where("__idle is null").select("code").distinct().orderBy("code").limit(most_options).withColumn("__turn", F.lit(True))
        judged = judged.join(turn, "code", "left").withColumn("__idle", F.when(F.col("__idle").isNull() & F.col("__turn").isNull(), "waiting").otherwise(F.col("__idle"))).drop("__turn")
    rows, aside = judged.where("__idle is null").drop("__idle"), judged.where("__idle is not null")
    day = rows.groupBy("code", "d").agg(F.min("amount").alias("least"), F.max("amount").alias("most"))
    met = against(day, events)
    old, apart = too_old(F.col("d")), F.col("least") != F.col("most")
    differs = F.col("was").isNotNull() & (F.col("was") != F.col("least"))
    issue = (
        F.when(old, "implausible_record_date").when(apart, "same_priority_conflict").when(differs & (F.col("was_tier") < 3), "higher_priority_conflict")
        .when(differs | (F.col("there") & F.col("was").isNull()), "same_priority_conflict")
    )
    retires = ~old & ~apart & differs & (F.col("was_tier") == 3)
    told = met.select(
        "code", "d", issue.alias("issue"), F.when(issue.isNotNull(), "blocked").when(F.col("there"), "linked").otherwise("inserted").alias("action"), retires.alias("retires"),
        (F.coalesce("was_revision", F.lit(0)) + F.when(issue.isNull() & ~F.col("there"), 1).otherwise(0)).cast("int").alias("revision"),
    )
    done = rows.join(told, ["code", "d"])
    rest = aside.withColumns({"issue": F.lit(None).cast("string"), "retires": F.lit(False), "revision": F.col("tied")}).withColumnRenamed("__idle", "action")
    return done.unionByName(rest.select(*done.columns)).withColumn("tier", F.lit(3))


def new_links(published: DataFrame, source: str) -> DataFrame:
    """What a publisher's result adds to the ledger of links."""
    took = F.col("action").isin("inserted", "revised", "linked", "unchanged") & F.col("tied").isNull()
    return published.where(took).select(F.lit(source).alias("source"), "seq", "code", "d", F.col("revision").cast("int").alias("revision"))


def new_issues(published: DataFrame, source: str) -> DataFrame:
    """What a publisher's result adds to the ledger of issues."""
    review = F.col("review").cast("string") if "review" in published.columns else F.lit(None).cast("string")
    return published.where("issue is not null").select(F.lit(source).alias("source"), "seq", review.alias("review"), "issue")


def require_stored(rows: DataFrame, stored: DataFrame, keys: list[str], what: str) -> DataFrame:
    """rows, once it is sure that all of them are stored, which resuming a publication or refreshing a mapping takes for granted."""
    absent = rows.select(*keys).distinct().join(stored.select(*keys).distinct(), keys, "left_anti")
    if few := absent.limit(3).collect():
        raise ValueError(f"{what} has to be imported first: missing {absent.count()}, among them {[tuple(r) for r in few]}")
    return rows


def publish_notice(rows: DataFrame, events: DataFrame) -> DataFrame:
    """A fund house's own notices (code, d, seq, amount) with action and revision; one that contradicts a current amount fails the job."""
    met = against(rows, events)
    clash = F.coalesce(F.col("was") != F.col("amount"), F.lit(False)) | F.coalesce(F.min("amount").over(Window.partitionBy("code", "d")) != F.col("amount"), F.lit(False))
    checked = F.when(clash, F.raise_error(F.concat_ws(" ", F.lit("a notice contradicts the current amount of"), "code", "d"))).otherwise(F.col("amount"))
    fresh = F.col("was").isNull() & (F.row_number().over(in_order()) == 1)
    out = numbered(met.withColumn("amount", checked).withColumn("action", F.when(fresh, "inserted").otherwise("linked")))
    return out.withColumns({"tier": F.lit(1), "issue": F.lit(None).cast("string"), "retires": F.lit(False)}).drop("was", "was_tier", "was_revision", "there")


def after(events: DataFrame, rows: DataFrame) -> DataFrame:
    """The events that published rows leave: (code, d, amount, tier, revision)."""
    took = F.col("action").isin("inserted", "revised", "linked", "unchanged")
    if "tied" in rows.columns:
        took &= F.col("tied").isNull()  # what an earlier run has linked says nothing new
    retires = F.col("retires") if "retires" in rows.columns else F.lit(False)
    news = rows.groupBy("code", "d").agg(
        F.max(F.when(took, F.struct("seq", "amount"))).alias("last"), F.max(retires).alias("retired"), F.max("revision").alias("rev"), F.min(F.when(took, F.col("tier"))).alias("own"),
        F.max(F.col("action").isin("inserted", "revised")).alias("replaced"), F.max(F.when(F.col("action") == "refused", True)).alias("refused"),
    )
    both = events.join(news, ["code", "d"], "full")
    amount = F.when(F.col("retired"), None).when(F.col("last").isNotNull() & F.col("refused").isNull(), F.col("last.amount")).otherwise(F.col("amount"))
    tier = F.least("tier", "own")
    out = both.select("code", "d", amount.alias("amount"), tier.cast("int").alias("tier"), F.greatest(F.coalesce("revision", F.lit(0)), F.coalesce("rev", F.lit(0))).cast("int").alias("revision"))
    return out.where("tier is not null")


def registrar_candidates(captures: DataFrame, metadata: DataFrame) -> DataFrame:
    """capture and code of payout options (code, name, plan, option) whose name's core, and plan where the capture states one, agree."""
    meta = metadata.where("option = 'idcw'").select("code", F.col("plan").alias("their_plan"), names.registrar_core(F.col("name")).alias("core"))
    own = captures.select("capture", "plan", names.registrar_core(F.col("name")).alias("core"))
    return own.join(meta, "core").where((F.col("plan") == "unknown") | (F.col("plan") == F.col("their_plan"))).select("capture", "code").distinct()


def map_registrar(captures: DataFrame, evidence: DataFrame, metadata: DataFrame, nav: DataFrame) -> DataFrame:
    """capture, state, code and matches: a candidate with any exact value of the evidence (capture, d, value) qualifies.

    Only days of candidates' series are read: candidates come first, evidence second.
    """
    points = registrar_candidates(captures, metadata).join(evidence.select("capture", "d", "value").distinct(), "capture")
    hits = points.join(nav.select("code", "d", F.col("v").alias("value")), ["code", "d", "value"]).groupBy("capture", "code").agg(F.count("*").alias("matches"))
    return states(captures, hits)


def states(captures: DataFrame, qualified: DataFrame) -> DataFrame:
    """capture, state, code and matches from the qualified (capture, code, matches): one is mapped, more are ambiguous."""
    found = qualified.groupBy("capture").agg(F.count("*").alias("n"), F.min("code").alias("one"), F.sum("matches").alias("matches"))
    state = F.when(F.col("n") == 1, "mapped").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    out = captures.select("capture").join(found, "capture", "left")
    return out.select("capture", state.alias("state"), F.when(F.col("n") == 1, F.col("one")).alias("code"), F.coalesce("matches", F.lit(0)).alias("matches"))


def option_keys(metadata: DataFrame) -> DataFrame:
    """code, house_core, core, plan, variant and frequency of payout options, as a third party's captures are compared with them."""
    return metadata.where("option = 'idcw'").select(
        "code", names.house_core(F.col("house")).alias("house_core"), names.third_party_core(F.col("name")).alias("core"), F.col("plan").alias("their_plan"),
        names.third_party_variant(F.col("name")).alias("their_variant"), names.third_party_frequency(F.col("name")).alias("their_frequency"),
    )


def capture_keys(captures: DataFrame) -> DataFrame:
    return captures.select(
        "capture", names.house_core(F.col("house")).alias("house_core"), names.third_party_core(F.col("name")).alias("core"), names.third_party_plan(F.col("name")).alias("plan"),
        names.third_party_variant(F.col("name")).alias("variant"), names.third_party_frequency(F.col("name")).alias("frequency"),
    )


def third_party_candidates(captures: DataFrame, sampled: DataFrame, metadata: DataFrame, nav: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The options that can be a capture's: those of exactly its name (capture, code), and others (capture, code, matches, span, points).

    An option can be one with the same house and no contradiction of plan or stated qualifiers. Options whose whole core
    agrees are a capture's only ones where there are any. For the other captures an option counts that has one of their
    sampled values on its day, since none qualifies without; so both joins are on equal keys, and the options of a house are
    never paired off with its captures. matches and span are those of its values that agree, points is the number of the capture's.
    """
    meta, own = option_keys(metadata).distinct(), capture_keys(captures).distinct()
    fits = names.plans_agree(F.col("plan"), F.col("their_plan")) & names.qualifiers_agree(F.col("variant"), F.col("frequency"), F.col("their_variant"), F.col("their_frequency"))
    exact = own.join(meta, ["house_core", "core"]).where(fits).select("capture", "code").distinct()
    others = own.join(exact, "capture", "left_anti").join(sampled.select("capture", "d", "value"), "capture").drop("core").where("d is not null and value is not null")
    valued = nav.select("code", "d", F.col("v").alias("value")).join(meta.drop("core"), "code")
    hits = others.withColumn("points", F.count("*").over(Window.partitionBy("capture"))).join(valued, ["value", "d", "house_core"]).where(fits)  # sorted by what tells most
    broad = hits.groupBy("capture", "code").agg(F.count("*").alias("matches"), F.datediff(F.max("d"), F.min("d")).alias("span"), F.max("points").alias("points"))
    return exact, broad


def third_party_pairs(captures: DataFrame, sampled: DataFrame, metadata: DataFrame, nav: DataFrame) -> DataFrame:
    """capture, code and exact of all options that can be a capture's."""
    exact, broad = third_party_candidates(captures, sampled, metadata, nav)
    return exact.withColumn("exact", F.lit(True)).unionByName(broad.select("capture", "code", F.lit(False).alias("exact")))


def compared(pairs: DataFrame, points: DataFrame, nav: DataFrame) -> DataFrame:
    """pairs with matches, conflicts and span of the points (capture, d, value) against nav (code, d, v)."""
    keys = pairs.columns
    both = pairs.join(points, "capture").join(nav.select("code", "d", "v"), ["code", "d"])
    same = F.col("value") == F.col("v")
    span = F.datediff(F.max(F.when(same, F.col("d"))), F.min(F.when(same, F.col("d"))))
    return both.groupBy(*keys).agg(F.count_if(same).alias("matches"), F.count_if(~same).alias("conflicts"), F.coalesce(span, F.lit(0)).alias("span"))


def map_third_party(captures: DataFrame, sampled: DataFrame, metadata: DataFrame, nav: DataFrame) -> DataFrame:
    """capture, state, code and matches; sampled (capture, d, value) has the rows that are compared.

    A candidate qualifies without any conflict, and with enough matches over enough days, or one match
    under exactly its name. captures has a row for each capture, metadata for each code, nav for each code and day. Others than
    those of the name are compared once more only if they match enough, and only where a point is left that can conflict.
    """
    exact, broad = third_party_candidates(captures, sampled, metadata, nav)
    enough = (F.col("matches") >= LEAST_MATCHES) & (F.col("span") >= LEAST_SPAN)
    broad = broad.where(enough)
    whole = F.col("matches") == F.col("points")
    pairs = exact.withColumn("exact", F.lit(True)).unionByName(broad.where(~whole).select("capture", "code", F.lit(False).alias("exact")))
    found = compared(pairs, sampled, nav).where((F.col("conflicts") == 0) & (enough | (F.col("exact") & (F.col("matches") >= 1))))
    return states(captures, found.select("capture", "code", "matches").unionByName(broad.where(whole).select("capture", "code", "matches")))


def pilot_report(captures: DataFrame, rows: DataFrame, metadata: DataFrame, nav: DataFrame) -> DataFrame:
    """What a third party's captures would be mapped to, publishing nothing: a verdict for each.

    captures has (capture, name, house, plan, source_frequency, display_frequency), name as displayed; rows
    has (capture, d, value, positive), all of them compared. Candidates have the house and exactly the core of the
    name and no other plan; one qualifies with enough matches over enough days and no conflict. A capture
    whose names state different frequencies stays unresolved, whatever qualifies.

    capture, source_rows, positive_rows, zero_rows, candidates, qualified, matches, conflicts, missing (of all
    candidates together), state, code and reason.
    """
    meta = metadata.where("option = 'idcw'").select("code", "house", names.third_party_core(F.col("name")).alias("core"), F.col("plan").alias("their_plan"))
    own = captures.select("capture", "house", "plan", names.third_party_core(F.col("name")).alias("core"))
    pairs = own.join(meta, ["house", "core"]).where(names.plans_agree(F.col("plan"), F.col("their_plan"))).select("capture", "code").distinct()
    points = rows.select("capture", "d", "value")
    judged = pairs.join(compared(pairs, points, nav), ["capture", "code"], "left").fillna(0, ["matches", "conflicts", "span"])
    good = (F.col("matches") >= LEAST_MATCHES) & (F.col("span") >= LEAST_SPAN) & (F.col("conflicts") == 0)
    by = judged.groupBy("capture").agg(F.count("*").alias("candidates"), F.count_if(good).alias("qualified"), F.min(F.when(good, F.col("code"))).alias("one"), F.sum("matches").alias("matches"), F.sum("conflicts").alias("conflicts"))
    had = rows.groupBy("capture").agg(F.count("*").alias("source_rows"), F.count_if("positive").alias("positive_rows"))
    out = captures.join(had, "capture", "left").join(by, "capture", "left").fillna(0, ["source_rows", "positive_rows", "candidates", "qualified", "matches", "conflicts"])
    stated = [F.col(c).isin("unknown", "multiple") for c in ("source_frequency", "display_frequency")]
    at_odds = ~stated[0] & ~stated[1] & (F.col("source_frequency") != F.col("display_frequency"))
    state = F.when(at_odds, "unresolved").when(F.col("qualified") == 1, "mapped").when(F.col("qualified") > 1, "ambiguous").otherwise("unresolved")
    reason = (
        F.when(at_odds, "frequency_conflict").when(F.col("qualified") == 1, "one_candidate_qualifies").when(F.col("qualified") > 1, "several_candidates_qualify").when(F.col("candidates") == 0, "no_name_and_plan_candidate")
        .when(F.col("source_rows") < LEAST_MATCHES, "too_few_source_rows").otherwise("no_candidate_qualifies")
    )
    missing = F.col("candidates") * F.col("source_rows") - F.col("matches") - F.col("conflicts")
    return out.select(
        "capture", "source_rows", "positive_rows", (F.col("source_rows") - F.col("positive_rows")).alias("zero_rows"), "candidates", "qualified", "matches", "conflicts", missing.alias("missing"), state.alias("state"),
        F.when(state == "mapped", F.col("one")).alias("code"), reason.alias("reason"),
    )


def coverage(options: DataFrame, sources: DataFrame, links: DataFrame, events: DataFrame) -> DataFrame:
    """For every payout option (code): its source rows, those linked to events, events and bounds, and the status.

    sources (code, d) and links (code) have a row for each source row; events is as elsewhere here.
    """
    rows = sources.groupBy("code").agg(F.count("*").alias("source_rows"), F.min("d").alias("first_day"), F.max("d").alias("last_day"))
    tied = links.groupBy("code").agg(F.count("*").alias("linked_rows"))
    held = events.where("amount is not null").groupBy("code").agg(F.count("*").alias("events"))
    out = options.select("code").join(rows, "code", "left").join(tied, "code", "left").join(held, "code", "left").fillna(0, ["source_rows", "linked_rows", "events"])
    status = F.when(F.col("events") > 0, "events_present").when(F.col("source_rows") > 0, "blocked_source_rows").otherwise("unverified_empty")
    wrong = F.when(F.col("linked_rows") > F.col("source_rows"), "links exceed source rows of").when(F.col("events") > F.col("linked_rows"), "events exceed links of")
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat_ws(" ", wrong, "code"))).otherwise(status)
    return out.withColumn("blocked_rows", F.col("source_rows") - F.col("linked_rows")).withColumn("status", checked)


def blocked_options(assessed: DataFrame, gated: DataFrame, metadata: DataFrame) -> DataFrame:
    """The options whose rows are all held back, the most rows first: their counts, the regulator's rows by gate, and rows of other sources.

    metadata has (code, name); gated the regulator's rows (code, gate). gates is a map of the gates that hold any. More rows of the
    regulator's than are known in all fail the job.
    """
    mine = assessed.where("status = 'blocked_source_rows'")
    by = gated.join(mine.select("code"), "code", "left_semi").groupBy("code", "gate").agg(F.count("*").alias("n"))
    gates = by.groupBy("code").agg(F.sum("n").alias("regulator_rows"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("gate", "n")))).alias("gates"))
    out = mine.join(metadata.select("code", "name"), "code", "left").join(gates, "code", "left").fillna(0, ["regulator_rows"])
    other = F.col("source_rows") - F.col("regulator_rows")
    other = F.when(other < 0, F.raise_error(F.concat_ws(" ", F.lit("the regulator's rows exceed the accepted rows of"), "code")).cast("long")).otherwise(other)
    none = F.create_map().cast("map<string,bigint>")
    return out.select("code", "name", "source_rows", "blocked_rows", "regulator_rows", other.alias("other_rows"), "first_day", "last_day", F.coalesce("gates", none).alias("gates")).orderBy(F.desc("blocked_rows"), "code")


def blockers(assessed: DataFrame, gated: DataFrame) -> DataFrame:
    """Each gate with the rows and options that it holds, over the options whose coverage is blocked; gates without any too."""
    spark = assessed.sparkSession
    every = spark.createDataFrame([(i, g) for i, g in enumerate(labels.GATES)], "place int, gate string")
    inside = gated.join(assessed.where("status = 'blocked_source_rows'").select("code"), "code", "left_semi")
    found = inside.groupBy("gate").agg(F.count("*").alias("rows"), F.count_distinct("code").alias("options"))
    return every.join(found, "gate", "left").fillna(0, ["rows", "options"])


def backlog_reason(provider: Column, state: Column, evidence: Column) -> Column:
    """Why a capture is not mapped, from its review's evidence (JSON); an error where evidence and state contradict each other."""
    size = lambda key: F.coalesce(F.size(F.from_json(F.get_json_object(evidence, f"$.{key}"), "array<string>")), F.lit(0))
    candidates, qualified = size("candidate_codes"), size("qualifying_codes")
    third = provider == "advisorkhoj"
    conflicts = F.from_json(F.get_json_object(evidence, "$.candidates"), "array<struct<conflicts: array<string>>>")
    clash = F.coalesce(F.exists(conflicts, lambda c: F.size(c["conflicts"]) > 0), F.lit(False))
    count = F.when(third, qualified).otherwise(candidates)
    wrong = ((state == "ambiguous") & (count < 2)) | ((state == "unresolved") & (count > 0))
    told = F.when(
        third, F.when(state == "ambiguous", "multiple_qualifying_nav_candidates").when(candidates == 0, "no_metadata_candidate").when(clash, "comparable_nav_conflict").otherwise("insufficient_nav_evidence")
    ).otherwise(F.when(state == "ambiguous", "multiple_exact_name_plan_nav_candidates").otherwise("no_exact_name_plan_nav_candidate"))
    return F.when(wrong, F.raise_error(F.lit("a review's evidence contradicts its state"))).otherwise(told)


def backlog(captures: DataFrame, reviews: DataFrame) -> DataFrame:
    """Captures (capture, provider, name, rows) whose latest review (capture, reviewed_at, id, state, evidence) is open, with the reason."""
    latest = reviews.groupBy("capture").agg(F.max_by(F.struct("state", "evidence"), F.struct("reviewed_at", "id")).alias("r")).select("capture", "r.*")
    open_ = captures.join(latest, "capture").where(F.col("state").isin("unresolved", "ambiguous"))
    return open_.withColumn("reason", F.when(F.col("rows") > 0, backlog_reason(F.col("provider"), F.col("state"), F.col("evidence")))).drop("evidence")


def backlog_summary(open_: DataFrame) -> DataFrame:
    """By provider: captures and rows of each state, those without rows apart."""
    counts = []
    for state in ("unresolved", "ambiguous"):
        mine, full = F.col("state") == state, F.col("rows") > 0
        counts += [F.count_if(mine & full).alias(f"{state}_captures"), F.coalesce(F.sum(F.when(mine, F.col("rows"))), F.lit(0)).alias(f"{state}_rows"), F.count_if(mine & ~full).alias(f"{state}_empty")]
    return open_.groupBy("provider").agg(*counts)


def backlog_ranked(open_: DataFrame, most: int = 100) -> DataFrame:
    """The captures with most rows, so many of them."""
    if not 1 <= most <= 1000:
        raise ValueError("between 1 and 1000 captures are ranked")
    return open_.where("rows > 0").orderBy(F.desc("rows"), "provider", "name", "capture").limit(most)


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """Counts of several kinds as rows of (section, item, n), from tables of (item, n)."""
    rows = [df.select(F.lit(name).alias("section"), F.col("item").cast("string").alias("item"), F.col("n").cast("long").alias("n")) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)
