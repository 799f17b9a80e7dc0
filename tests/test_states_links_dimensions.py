"""Stateful streams, chains of links, dated dimensions and cover density against plain versions."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta, timezone

import pytest

from plumbline.operators import dimensions as D
from plumbline.operators import links as L
from plumbline.operators import postings as P
from plumbline.plans.catalogue import QUERIES
from plumbline.session import shared_dir
from plumbline.streaming import events as E
from plumbline.streaming import states as S

SF = "/root/testdata/sf0.001"


def streamed(spark, parts, schema, shape):
    root = shared_dir(spark, "test")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        with S.timers_allowed(spark):
            out = E.run_once(shape(E.event_stream(spark, f"{root}/in", spark.createDataFrame([], schema).schema)), f"{root}/out", f"{root}/state")
    return out


def cut(rows, parts):
    """Rows by time in so many parts, shuffled within a part."""
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    size = -(-len(rows) // parts)
    out = [rows[i : i + size] for i in range(0, len(rows), size)]
    for part in out:
        random.Random(1).shuffle(part)
    return out


BEGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.mark.parametrize("parts", [1, 3])
def test_stuck_jobs(spark, parts):
    rng = random.Random(3)
    rows = [(rng.randrange(12), BEGIN + timedelta(minutes=rng.randrange(1_500), microseconds=rng.randrange(10**6)), i, rng.choice(["claim", "claim", "claim", "done", "reset", "other"])) for i in range(300)]
    rows.append((99, max(r[1] for r in rows) + timedelta(days=2), 1_000, "other"))  # all timers end
    want, jobs = [], defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        jobs[r[0]].append(r)
    for key, own in jobs.items():
        started, attempts, failed = None, 0, False
        for _, at, _, kind in [*own, (key, datetime(2100, 1, 1, tzinfo=timezone.utc), 0, "end")]:
            if started and at > started + timedelta(minutes=15):
                want.append((key, (started + timedelta(minutes=15)).replace(tzinfo=None), "failed" if attempts >= 3 else "queued", attempts))
                started, failed = None, attempts >= 3
            if kind == "reset":
                started, attempts, failed = None, 0, False
            elif kind == "claim" and not started and not failed:
                started, attempts = at, attempts + 1
            elif kind == "done" and started:
                started, attempts = None, 0
    out = streamed(spark, cut(rows, parts), "job long, at timestamp, number long, kind string", lambda s: S.stuck_jobs(s, "job"))
    got = [tuple(r) for r in out.selectExpr("job", "cast(at as timestamp_ntz) as at", "status", "attempts").collect()]
    assert sorted(got) == sorted(want) and {w[2] for w in want} == {"queued", "failed"}


@pytest.mark.parametrize("parts", [1, 4])
def test_locks(spark, parts):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, 3, None]), BEGIN + timedelta(minutes=rng.randrange(300)), i) for i in range(150)] + [(1, BEGIN + timedelta(days=5), 500)]
    want = []
    for key in (1, 2, 3):
        times = []
        for _, at, number in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            times = [x for x in times if x > at - timedelta(minutes=15)] + [at]
            want.append((number, key, (times[-3] + timedelta(minutes=15)).replace(tzinfo=None) if len(times) >= 3 else None))
    out = streamed(spark, cut(rows, parts), "user long, at timestamp, number long", lambda s: S.locks(s, "user", most=3))
    got = [tuple(r) for r in out.selectExpr("number", "user", "cast(locked_until as timestamp_ntz) as u").collect()]
    assert sorted(got) == sorted(want) and sum(w[2] is not None for w in want) > 10


def plain_links(rows):
    """Links one by one in the order of the nodes."""
    nodes, made, taken, why = {n for n, _ in rows}, {}, set(), {}
    for n, p in sorted(rows):
        if p is None:
            continue
        ahead, ring = p, False
        while ahead is not None and not ring:
            ring = ahead == n
            ahead = made.get(ahead)
        why[n] = L.SAME if p == n else L.MISSING if p not in nodes else L.TAKEN if p in taken else L.CYCLE if ring else None
        if why[n] is None:
            made[n] = p
            taken.add(p)
    out = []
    for n, _ in rows:
        root, depth = n, 0
        while root in made:
            root, depth = made[root], depth + 1
        out.append((n, made.get(n), root, depth, why.get(n)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_links_equal_links_made_one_by_one(spark, seed):
    rng = random.Random(seed)
    n = 120
    rows = [(i, rng.choice([None, rng.randrange(n + 5), (i * 7 + 3) % n, i - 1 if i else None, (i + 1) % n])) for i in range(n)]
    if seed == 3:
        rows = [(i, (i + 1) % 50) for i in range(50)] + [(i, i - 1 if i > 50 else None) for i in range(50, 150)] + [(200, 0), (201, 201), (202, 999)]
    got = L.linked_chains(spark.createDataFrame([*rows, (None, 3)], "n long, p long"), "n", "p")
    assert sorted(map(tuple, got.collect())) == plain_links(rows)
    assert L.linked_chains(spark.createDataFrame([], "n long, p long"), "n", "p").count() == 0


def test_links_query(spark):
    keys = [r[0] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()]
    rows = [(k, k // 100 * 100 + ((k * 7 + 3) if k // 100 % 2 == 0 else (k * k + 3 * k + 7)) % 100 if k % 9 else None) for k in keys]
    got = sorted(map(tuple, QUERIES["linked_versions"](spark, SF).collect()))
    assert got == plain_links(rows) and {None, L.TAKEN, L.CYCLE} <= {g[4] for g in got}


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_dated_dimension_with_a_hot_key(spark, ranges):
    rng = random.Random(ranges)
    day = lambda: date(2020, 1, 1) + timedelta(rng.randrange(300))
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    facts = [(i, key(), day() if rng.random() < 0.95 else None) for i in range(400)] + [(500, "hot", date(2030, 1, 1)), (501, "unknown", day())]
    facts += facts[:20]  # repeated rows stay
    dims = [(key(), day() if rng.random() < 0.9 else None, rng.randrange(1000)) for _ in range(30)] + [("z", day(), 1)]
    want = []
    for i, k, d in facts:
        own = [(s or date.min, v) for c, s, v in dims if k is not None and d is not None and c == k and (s is None or s <= d)]
        want.append((i, k, d, max(own)[1] if own else None))
    got = D.in_force(spark.createDataFrame(facts, "i int, k string, d date").repartition(3), spark.createDataFrame(dims, "k string, since date, v int"), "k", "d", "since", "v", ranges)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and got.columns == ["i", "k", "d", "v"]
    none = D.in_force(spark.createDataFrame(facts, "i int, k string, d date"), spark.createDataFrame([], "k string, since date, v int"), "k", "d", "since", "v", ranges)
    assert none.filter("v is not null").count() == 0 and none.count() == len(facts)


def plain_covers(words, terms):
    """Every shortest stretch with all terms, by trying all."""
    at = [i for i, w in enumerate(words, 1) if w in terms]
    holds = lambda a, b: {words[i - 1] for i in at if a <= i <= b} >= set(terms)
    found = [(a, b) for a in at for b in at if a <= b and holds(a, b) and not any(holds(x, y) for x in at for y in at if a <= x <= y <= b and (x, y) != (a, b))]
    return sum(0.1 / (1 + (b - a + 1) - sum(a <= i <= b for i in at)) for a, b in found)


def test_cover_density_equals_plain_covers(spark):
    rng = random.Random(7)
    texts = {i: " ".join(rng.choice(["x", "y", "z", "other", "more"]) for _ in range(rng.randrange(25))) for i in range(60)}
    df = spark.createDataFrame([*texts.items(), (100, None), (101, ""), (None, "x y z")], "row long, text string")
    index = P.write_index(df, "row", "text")
    for terms in (["x"], ["x", "y"], ["x", "y", "z", "x"], ["x", "absent"]):
        want = {i: round(plain_covers(t.split(), terms), 9) for i, t in texts.items()}
        got = {r["row"]: r["score"] for r in P.cover_density(index, terms, every=True).collect()}
        assert got == pytest.approx({i: s for i, s in want.items() if s > 0}, abs=2e-9)
        any_of = {r["row"]: r["score"] for r in P.cover_density(index, terms).collect()}
        assert any_of == pytest.approx({i: 0.1 * n for i, t in texts.items() if (n := sum(w in terms for w in t.split()))})


def test_index_is_read_by_term_and_folder_and_filters_hold_below_the_budget(spark):
    rows = [(i, "common " + ("rare" if i % 50 == 0 else "word"), "decision" if i % 2 else "statute") for i in range(500)]
    df = spark.createDataFrame(rows, "row long, text string, category string")
    index = P.write_index(df, "row", "text", ["category"])
    plan = index.of(["rare"]).filter("category = 'statute'")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,rare)]" in plan and "PartitionFilters: [isnotnull(category" in plan
    allowed = df.filter("row >= 490")
    found = P.hybrid(index, None, "v", allowed, ["common"], None, 20).collect()
    assert sorted(r["row"] for r in found) == list(range(490, 500)) and {r["mode"] for r in found} == {"fulltext"}
    assert P.hybrid(index, None, "v", allowed, [], None).count() == 0
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(500)], "row long, v array<float>")
    both = P.hybrid(index, vectors, "v", allowed, ["absent"], [6.0, 1.0], 3).collect()
    assert [r["row"] for r in both] == [496, 495, 494] and {r["mode"] for r in both} == {"hybrid"}
