"""Folds that are cut, verdicts along dependencies, holdings and metrics against plain versions."""

import random
from datetime import date, timedelta

import pytest

from plumbline.operators import gates as G
from plumbline.operators import intervals as I


def plain_timeline(rows, tolerance):
    out, keys = [], {}
    for k, d, t in rows:
        if d is not None:
            keys.setdefault(k, []).append((d, t is not None, t or ""))
    for k, own in keys.items():
        run, last = None, None
        for d, there, t in sorted(own):
            t = t if there else None
            if run is None and t is not None:
                run = [d, t, "original" if last is None else "added"]
            elif run is not None and (t is None or I._share_changed(run[1], t) > tolerance):
                out.append((k, "version", run[0], last, run[1], run[2]))
                if t is None or last < d:
                    out.append((k, "gap", last, d, None, "removed" if t is None else "changed"))
                run = None if t is None else [d, t, "amended"]
            last = d
        if run:
            out.append((k, "version", run[0], None, run[1], run[2]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "ranges", "tolerance"), [(0, 1, 0.0), (1, 12, 0.0), (2, 25, 0.2), (3, 40, 0.35)])
def test_timelines_are_the_same_however_they_are_cut(spark, seed, ranges, tolerance):
    rng = random.Random(seed)
    words = "abcdefgh"
    rows = []
    for k, n in ((1, 150), (None, 60), (2, 3), (3, 1)):  # key 1 spans many ranges
        text = [rng.choice(words) for _ in range(8)]
        for i in range(n):
            if rng.random() < 0.4:
                text[rng.randrange(8)] = rng.choice(words)
            rows.append((k, date(2000, 1, 1) + timedelta(i), None if rng.random() < 0.05 else " ".join(text)))
    rows += [(9, date(2000, 1, 1) + timedelta(i), "never changes") for i in range(60)] + [(4, None, "lost"), (1, date(2000, 1, 5), "same day")]
    rng.shuffle(rows)
    got = I.timeline(spark.createDataFrame(rows, "k int, snapshot date, text string"), "k", tolerance, ranges)
    assert sorted(map(tuple, got.collect()), key=str) == plain_timeline(rows, tolerance)


def test_timeline_of_nothing(spark):
    assert I.timeline(spark.createDataFrame([], "k int, snapshot date, text string"), "k").count() == 0


def plain_settled(nodes, needs):
    value = {n: own for n, own, _ in nodes}
    on = {}
    for n, m in needs:
        on.setdefault(n, set()).add(m)
    while True:
        new = {n: min(own, (max if rule == "any" else min)(value.get(m, 0) for m in on[n])) if n in on else own for n, own, rule in nodes}
        if new == value:
            return value
        value = new


@pytest.mark.parametrize("seed", range(3))
def test_verdicts_travel(spark, seed):
    rng = random.Random(seed)
    nodes = [(str(i), rng.choice([0, 1, 2, 2, 2, 2]), rng.choice(["all", "any"])) for i in range(120)]
    needs = [(str(i), str(rng.randrange(max(1, i)) if seed < 2 else rng.randrange(125))) for i in range(1, 120) for _ in range(rng.randrange(3))]
    needs += [(str(i), "0") for i in range(60, 120)] + [("5", "missing")]
    got = G.settled(spark.createDataFrame(nodes, "node string, own int, rule string"), spark.createDataFrame([*needs, *needs[:20]], "node string, on string"))
    assert {r["node"]: r["verdict"] for r in got.collect()} == plain_settled(nodes, needs)


def test_chains_deeper_than_the_bound_are_refused(spark):
    nodes = [(str(i), 0 if i == 0 else 2, "all") for i in range(9)]
    df = spark.createDataFrame(nodes, "node string, own int, rule string")
    needs = spark.createDataFrame([(str(i), str(i - 1)) for i in range(1, 9)], "node string, on string")
    assert {r["verdict"] for r in G.settled(df, needs).collect()} == {0}
    with pytest.raises(ValueError, match="deeper"):
        G.settled(df, needs, rounds=5)


def test_holdings(spark):
    day = date(2015, 1, 1)
    row = lambda i, source, quote, **x: (1, i, source, quote, x.get("condition", "şart"), x.get("value"), x.get("result", "met"), x.get("depends"), day)
    rows = [
        row(1, "a", "the quick  brown"), row(2, "b", "the quick brown"), row(3, "old", "the quick brown"), row(4, "a", "quick brown"), row(5, "a", "the slow brown"), row(6, "a", "the quick brown", condition="süre geçiyor"),
        row(7, "a", "the quick brown", depends=["wage"]), row(8, "a", "the quick brown", depends=["day"]), row(9, "a", "the quick brown", depends=["absent"], result="info"), row(10, "a", None), row(11, "a", "the quick brown", value="bekliyor"), row(12, "ends", "the quick brown"),
    ]
    rows = spark.createDataFrame(rows, "draft int, row int, source string, quote string, condition string, fact_value string, result string, depends array<string>, day date")
    reads = spark.createDataFrame([(1, "a", "x the quick\nbrown fox", date(2010, 1, 1), None), (2, "b", "the quick brown", None, None), (1, "old", "the quick brown", date(2016, 1, 1), None), (1, "ends", "the quick brown", None, day)], "draft int, source string, text string, valid_from date, valid_to date")
    facts = spark.createDataFrame([(1, "day", "known"), (1, "wage", "unknown"), (2, "wage", "known")], "draft int, key string, status string")
    got = {r["row"]: (r["fate"], r["outcome"]) for r in G.holdings(rows, reads, facts).collect()}
    want = {1: "kept", 2: "unread", 3: "not_in_force", 4: "short_quote", 5: "not_quoted", 6: "informal", 7: "kept", 8: "kept", 9: "kept", 10: "short_quote", 11: "informal", 12: "not_in_force"}
    assert {k: v[0] for k, v in got.items()} == want
    assert {k: v[1] for k, v in got.items() if v[1]} == {1: "met", 7: "unknown", 8: "met", 9: "info"}


def test_metrics_of_nothing_expected_and_nothing_said(spark):
    schema = "id int, valid boolean, status string, headline string, text string, disclaimer string, refs array<string>, sources array<string>, read array<string>, asked array<string>, want_status string, want_headline array<string>, must_cite array<string>, must_ask array<string>, must_not array<string>"
    rows = [(1, None, None, None, None, None, None, None, None, None, "x", None, None, None, None), (2, True, "x", "Çok Güzel", "ok", "D", ["1 m.2 f.3"], ["s"], ["s"], None, "x", ["cok guzel"], ["1 m.2"], ["k"], ["bad"])]
    got = {r["id"]: r for r in G.answer_metrics(spark.createDataFrame(rows, schema), "D").collect()}
    assert [got[1][m] for m in G.METRICS] == [0, 0, 1, 1, 0, 1, 1, 1, 0]
    assert [got[2][m] for m in G.METRICS] == [1, 1, 1, 1, 1, None, 1, 1, 1] and got[2]["total"] == 1.0
