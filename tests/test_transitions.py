"""Range joins, boundaries and first versions against plain versions of the rules."""

import random
from datetime import date, timedelta

import pytest

from plumbline.operators import transitions as X
from plumbline.plans.registry import Tables
from plumbline.plans.transitions import first_inputs, first_snapshot_versions

DAY = timedelta(days=1)
SPANS, NOTES = "s int, k int, d_old date, d_new date, inferred boolean", "k int, day date, law string, foot boolean"
ACTS, EXCEPTIONS = "law string, day date, effective date", "law string, day date, k int, effective date, partial boolean"


@pytest.mark.parametrize("seed", range(3))
def test_range_join_meets_each_pair_once(spark, seed):
    rng = random.Random(seed)
    day = lambda: date(1, 1, 1) + timedelta(rng.choice([rng.randrange(40), rng.randrange(3_000_000), rng.randrange(700_000, 700_900)]))
    spans = [(i, rng.choice([1, 2, None]), *((a, b) if rng.random() < 0.9 else (b, a))) for i in range(60) for a, b in [sorted((day(), day()))]] + [(60, 1, None, day()), (61, 1, date(1, 1, 1), date(9999, 12, 31))]
    notes = [(i, rng.choice([1, 2, None]), day()) for i in range(200)] + [(200, 1, None), (201, 1, date(9999, 12, 31)), (202, 1, date(1, 1, 1))]
    got = X.notes_in_spans(spark.createDataFrame(spans, "s int, k int, a date, b date"), spark.createDataFrame(notes, "n int, k int, day date"), "k", "a", "b", "day")
    want = sorted((s, n) for s, k, a, b in spans for n, j, d in notes if k is not None and k == j and d and a and a < d <= b)
    assert sorted((r["s"], r["n"]) for r in got.collect()) == want and len(want) > 100


def days_of(act, exceptions):
    """(days, basis) or None."""
    if act is None or any(e is None for e, _ in exceptions):
        return None
    whole, part = {e for e, p in exceptions if not p}, {e for e, p in exceptions if p}
    base = whole or ({act[0]} if act[0] else set())
    return (base | part, "partial" if part else "exception" if whole else "act") if base else None


def plain_boundary(d_old, d_new, inferred, notes, find):
    """(old_to, new_from, gap reason, basis, warnings) of one span."""

    def fallback(reason):
        return d_old + DAY, d_new, reason if d_old + DAY < d_new else None, "fallback", reason

    window = [(d, law, foot) for d, law, foot in notes if d_old < d <= d_new]
    pairs = {(d, law) for d, law, foot in window if not foot}
    if not pairs:
        return fallback(X.UNEXPLAINED)
    found = [find(d, law) for d, law in pairs]
    if None in found:
        return fallback(X.UNKNOWN)
    days, bases, wider = set().union(*(f[0] for f in found)), {f[1] for f in found}, False
    for d, law in {(d, law) for d, law, foot in window if foot} - pairs:
        other = find(d, law)
        if other is None:
            return fallback(X.MANY)
        later = {x for x in other[0] if x > d_old}
        days, wider = days | later, wider or bool(later)
    if min(days) <= d_old or (max(days) > d_new and not inferred):
        return fallback(X.OUTSIDE)
    own = bases != {"act"}
    split = None if min(days) == max(days) else X.MANY if len(pairs) > 1 or wider else X.PARTIAL if "partial" in bases else X.SPLIT
    return min(days), max(days), split, "exception" if own else "act", ",".join(filter(None, [X.EXCEPTION if own else None, split]))


def test_boundaries(spark):
    rng = random.Random(11)
    day = lambda n=400: date(2010, 1, 1) + timedelta(rng.randrange(n))
    spans, number = [], 0
    for k in range(80):
        ends = sorted({day() for _ in range(5)})
        for a, b in zip(ends, ends[1:]):
            spans.append((number, k, a, b, rng.random() < 0.4))
            number += 1
    notes = [(rng.randrange(80), day(), rng.choice("ABCDEFGH"), rng.random() < 0.25) for _ in range(500)]
    notes += rng.sample(notes, 40)  # repeated notes
    known = sorted({(law, d) for _, d, law, _ in notes})
    acts = {x: ((x[1] + timedelta(rng.randrange(30)) if rng.random() < 0.9 else None),) for x in known if rng.random() < 0.92}
    exceptions = [(law, d, k, d + timedelta(rng.randrange(40)) if rng.random() < 0.9 else None, rng.random() < 0.5) for k, d, law, _ in notes for _ in range(rng.choice([0, 0, 0, 1, 2]))]

    def find(k):
        return lambda d, law: days_of(acts.get((law, d)), [(e, p) for a, b, c, e, p in exceptions if (a, b, c) == (law, d, k)])

    got = X.explained(spark.createDataFrame(spans, SPANS), spark.createDataFrame(notes, NOTES), spark.createDataFrame([(*x, *e) for x, e in acts.items()], ACTS), spark.createDataFrame(exceptions, EXCEPTIONS), "k", ["s", "k"])
    want = {s: plain_boundary(a, b, i, [n[1:] for n in notes if n[0] == k], find(k)) for s, k, a, b, i in spans}
    found = {r["s"]: (r["old_to"], r["new_from"], r["gap_reason"], r["basis"], r["warnings"]) for r in got.collect()}
    assert found == want
    assert {X.UNEXPLAINED, X.UNKNOWN, X.MANY, X.OUTSIDE, X.SPLIT, X.EXCEPTION} <= {w for *_, warnings in want.values() for w in warnings.split(",")}
    empty = X.explained(spark.createDataFrame(spans, SPANS), spark.createDataFrame([], NOTES), spark.createDataFrame([], ACTS), spark.createDataFrame([], EXCEPTIONS), "k", ["s", "k"])
    assert {r["warnings"] for r in empty.collect()} == {X.UNEXPLAINED}


def plain_first(first, notes, find):
    """(notes, valid_from, change kind, basis, gap from, gap reason, warnings) of one key."""
    snapshot, added, repealed, law, law_day = first
    real = [n for n in notes if n[2] != "kabul"]
    original = find(law_day, law) if law_day else None
    law_from = min(original[0]) if original else None
    if real:
        warnings, basis, found = [], "act", [find(d, law) for d, law, *_ in real]
        if None in found:
            start, basis = snapshot, "fallback"
            warnings.append(X.UNKNOWN)
        else:
            basis = "act" if all(f[1] == "act" for f in found) else "exception"
            start = max(max(f[0]) for f in found)
            if start > snapshot:
                start, basis = snapshot, "fallback"
                warnings.append(X.OUTSIDE)
            elif basis == "exception":
                warnings.append(X.EXCEPTION)
        heads = sorted((d, law) for d, law, kind, scope, place in real if kind == "ek" and not scope and (added or place == 0))
        head = heads[0] if heads and (added or len({n[:2] for n in real}) == 1) else None
        add = find(*head) if head else None
        gap, reason = min(add[0]) if add else law_from, X.BEFORE_FIRST
        if add and start == max(add[0]) and min(add[0]) < start:
            reason = X.PARTIAL
        kind = "repealed" if repealed else "amended"
        if gap is None or gap < start:
            warnings += [reason, *([X.UNKNOWN] if gap is None else [])]
            return len(real), start, kind, basis, gap, reason, ",".join(warnings)
        return len(real), start, "added" if add and not repealed else kind, basis, None, None, ",".join(warnings)
    if added:
        there = law_from != snapshot
        return 0, snapshot, "original", "fallback", law_from if there else None, X.BEFORE_FIRST if there else None, X.UNVERIFIED
    if law_from is None:
        return 0, snapshot, "original", "fallback", None, X.BEFORE_FIRST, X.UNKNOWN
    return 0, law_from, "original", "act", None, None, ""


def test_first_versions_query(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    firsts, notes, acts, exceptions = (x.collect() for x in first_inputs(t))
    known = {(a["law"], a["day"]): (a["effective"],) for a in acts}
    own = {}
    for e in exceptions:
        own.setdefault((e["law"], e["day"], e["o_custkey"]), []).append((e["effective"], e["partial"]))
    by_key = {}
    for n in notes:
        by_key.setdefault(n["o_custkey"], []).append((n["day"], n["law"], n["kind"], n["scope"], n["place"]))
    text = lambda d: None if d is None else str(d)
    want = {}
    for f in firsts:
        k = f["o_custkey"]
        r = plain_first((f["snapshot"], f["added"], f["repealed"], f["law"], f["law_day"]), by_key.get(k, []), lambda d, law: days_of(known.get((law, d)), own.get((law, d, k), [])))
        want[k] = (r[0], text(r[1]), *r[2:4], text(r[4]), *r[5:])
    columns = ("notes", "valid_from", "change_kind", "basis", "gap_from", "gap_reason", "warnings")
    from plumbline.plans.catalogue import QUERIES

    got = {r["o_custkey"]: tuple(r[c] for c in columns) for r in QUERIES["first_snapshot_versions"](spark, "/root/testdata/sf0.01").collect()}
    assert got == want and len({w[2:4] for w in want.values()}) >= 5
    assert first_snapshot_versions(Tables(spark, "/root/testdata/sf0.001")).columns == ["o_custkey", *columns]
