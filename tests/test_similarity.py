"""Label proposals against every pair."""

import itertools
import random
import re
from difflib import SequenceMatcher

from seriesloom.operators import classification, similarity

NOTHING = {"open", "close", "ended", "scheme", "schemes", "fund", "funds", "oriented"}
MARKS = ({"open ended": 1, "close ended": 2, "interval": 3}, {"equity": 1, "debt": 2, "hybrid": 3, "solution oriented": 4, "other scheme": 5})


def conflict(a, b):
    kinds = [[next((k for m, k in marks.items() if m in x.lower()), None) for x in (a, b)] for marks in MARKS]
    return any(x and y and x != y for x, y in kinds)


def test_proposals_are_those_of_brute_force(spark):
    rng = random.Random(3)
    known = ["Largecap", "Large-cap", "cold bolt", "old plate", "", "--", "-- -", "é😀x", "a b", "b a", "b-A", "Open Ended Schemes ( Equity Scheme - Mid Cap Fund )", "Open Ended Schemes ( Equity Scheme - Midcap Fund )"]
    known += ["Close Ended Schemes ( Equity Scheme - Mid Cap Fund )", "Open Ended Schemes ( Debt Scheme - Mid Cap Fund )", "Interval Fund Schemes ( Income )", "Open Ended Schemes ( Income )", "Scheme Fund"]
    known += ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    df = spark.createDataFrame([(x,) for x in [*known, None, "Largecap"]], "label string")
    shown = {x: " ".join(w for w in re.findall("[a-z0-9]+", x.lower()) if w not in NOTHING) for x in known}
    for threshold in (0.6, 0.82):
        wanted = {}
        for a, b in itertools.permutations(sorted(set(known)), 2):
            if a.encode() < b.encode() and not conflict(a, b):
                x, y = set(shown[a].split()), set(shown[b].split())
                lexical, token = SequenceMatcher(None, shown[a], shown[b]).ratio(), len(x & y) / max(1, len(x | y))
                if max(lexical, token) >= threshold:
                    wanted[a, b] = (round(lexical, 6), round(token, 6))
        found = similarity.proposals(df, threshold).collect()
        assert {(r.a, r.b): (r.lexical, r.token) for r in found} == wanted and len(found) == len(wanted)
        assert ("Large-cap", "Largecap") in wanted


def test_names_of_aliases(spark):
    labels = ["Open Ended Schemes ( Equity Scheme - Mid Cap Fund )", "Open Ended Schemes ( Hybrid Scheme - Mid Cap Fund )", "Open Ended Schemes ( Debt Scheme - Gilt Fund )", "Close Ended Schemes ( Debt Scheme - Gilt Fund )", "  ", "Open Ended Schemes(Debt Scheme - Gilt Fund)"]
    found = classification.labelled(spark.createDataFrame([(x,) for x in labels], "label string"))
    rows = {r.label: r for r in found.collect()}
    assert rows[labels[0]].match == "exact" and rows[labels[5]].match == "formatting" and rows[labels[5]].classification == rows[labels[2]].classification and rows["  "].classification is None
    taken = spark.createDataFrame([("close_ended", "gilt  FUND")], "structure string, name string")
    names = {r.classification: r.name for r in classification.alias_names(classification.definitions(found), taken).collect()}
    by = {x: names[rows[x].classification] for x in labels[:4]}
    assert by == {labels[0]: "Equity Scheme - Mid Cap Fund", labels[1]: "Hybrid Scheme - Mid Cap Fund", labels[2]: "Gilt Fund", labels[3]: "Debt Scheme - Gilt Fund"}
