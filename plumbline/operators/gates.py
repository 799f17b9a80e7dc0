"""Verdicts that travel along dependencies, holdings held against what was read, and answer metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators.skew import joined
from plumbline.session import stored

DROPPED, UNKNOWN, KEPT = 0, 1, 2
#: A shorter quote is found in any text and proves nothing. Fixed value.
MIN_QUOTE_WORDS = 3


def settled(nodes: DataFrame, needs: DataFrame, rounds: int = 32) -> DataFrame:
    """node, verdict: what each node is worth once its dependencies are.

    nodes: node (unique), own (0 dropped, 1 unknown, 2 kept), rule; needs: node, on. A node of rule ``all``
    is worth no more than the least of what it needs, one of rule ``any`` no more than the best of it (a
    node of rule ``any`` that needs something and finds nothing is dropped). What is not among the nodes
    is dropped. Nodes that need nothing keep their own verdict.

    The greatest fixed point: verdicts begin at the nodes' own and only fall, so rings settle too. A round
    moves them one dependency on; ``rounds`` bounds the depth, beyond which it raises. A node that a third
    of all depend on is broadcast to them.
    """
    links = stored(needs.select("node", "on").distinct(), "needs")
    wanted = stored(links.groupBy("on").agg(F.count("*").alias("n")).withColumnRenamed("on", "node").join(nodes.select("node", F.lit(True).alias("_there")), "node", "left"), "needs")
    values = stored(nodes.select("node", F.col("own").cast("int").alias("own"), "rule", F.col("own").cast("int").alias("verdict")), "verdicts")
    for _ in range(rounds):
        facts = wanted.join(values.select("node", "verdict"), "node", "left").select(F.col("node").alias("on"), F.coalesce("verdict", F.lit(DROPPED)).alias("_v"), "n")
        given = joined(links, facts, ["on"], "n").groupBy("node").agg(F.min("_v").alias("_least"), F.max("_v").alias("_best"))
        bound = F.when(F.col("rule") == "any", F.col("_best")).otherwise(F.col("_least"))
        new = values.join(given, "node", "left").select("node", "own", "rule", F.least("own", bound).alias("verdict"), (F.least("own", bound) != F.col("verdict")).alias("_moved"))
        new = stored(new, "verdicts")
        values = new.drop("_moved")
        if new.filter("_moved").isEmpty():
            return values.select("node", "verdict")
    raise ValueError(f"dependencies are deeper than {rounds} rounds")


def holdings(rows: DataFrame, reads: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` with ``fate`` and ``outcome``: which rows of a map of holdings stand, and what they say.

    rows: draft, row, source, quote, condition, fact_value, result, depends (array of fact keys), day (the
    day of the law applied); reads: draft, source (unique together), text, valid_from, valid_to; facts:
    draft, key, status. A row stands on a source that was read, in force on its day, with a quote of
    enough words that the source holds, and in formal wording; the first failing rule is its fate. A
    standing row that says met or not_met while a fact it depends on is unknown or absent is unknown.
    """
    known = facts.filter("status <> 'unknown'").groupBy("draft").agg(F.collect_set("key").alias("_known"))
    out = rows.join(reads.select("draft", "source", F.col("text").alias("_text"), "valid_from", "valid_to", F.lit(True).alias("_read")), ["draft", "source"], "left").join(known, "draft", "left")
    in_force = F.coalesce(F.col("valid_from") <= F.col("day"), F.lit(True)) & F.coalesce(F.col("day") < F.col("valid_to"), F.lit(True))
    quote = F.trim(F.coalesce("quote", F.lit("")))
    informal = F.size(T.progressive_forms(F.concat_ws(" ", "condition", "fact_value"))) > 0
    fate = (
        F.when(F.col("_read").isNull(), "unread").when(~in_force, "not_in_force").when(T.word_count(quote) < MIN_QUOTE_WORDS, "short_quote")
        .when(~T.holds_quote(F.coalesce("_text", F.lit("")), quote), "not_quoted").when(informal, "informal").otherwise("kept")
    )
    open_ = F.size(F.array_except(F.coalesce("depends", F.array().cast("array<string>")), F.coalesce("_known", F.array().cast("array<string>")))) > 0
    outcome = F.when(open_ & F.col("result").isin("met", "not_met"), "unknown").otherwise(F.col("result"))
    return out.withColumns({"fate": fate, "outcome": F.when(fate == "kept", outcome)}).drop("_text", "valid_from", "valid_to", "_read", "_known")


def _share(wanted: Column, hit: Column) -> Column:
    """The share of ``wanted`` among which ``hit`` are; 1 where nothing is wanted."""
    return F.coalesce(F.try_divide(hit, F.size(wanted)), F.lit(1.0)).cast("double")


#: The names of the metrics.
METRICS = ("schema", "status", "headline", "must_cite", "citation_validity", "must_ask", "must_not", "formal_mode", "disclaimer")


def answer_metrics(answers: DataFrame, disclaimer: str) -> DataFrame:
    """``answers`` with nine metrics from 0 to 1 and their mean (``total``) over those that can be measured.

    answers: valid, status, headline, text, disclaimer, refs and sources (arrays, one of each for each
    citation), read (array of sources), asked (array, null where nothing was asked back), and what is
    expected: want_status, want_headline, must_cite, must_ask, must_not (arrays; null expects nothing).
    A reference covers what it names and its parts. Nothing to ask back counts as 1; something to ask
    and no question at all cannot be measured. An answer without citations has no valid ones.
    """
    texts = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    within = lambda wanted, text: F.size(F.filter(texts(F.col(wanted)), lambda w: F.contains(T.fold(text), T.fold(w))))
    wanted = lambda c: texts(F.col(c))
    refs, sources = texts(F.col("refs")), texts(F.col("sources"))
    covered = F.size(F.filter(wanted("must_cite"), lambda m: F.exists(refs, lambda r: T.covers(T.normal_space(r), T.normal_space(m)))))
    valid = F.size(F.filter(sources, lambda s: F.array_contains(texts(F.col("read")), s)))
    asked = F.size(F.array_intersect(F.array_distinct(wanted("must_ask")), texts(F.col("asked"))))
    metrics = {
        "schema": F.coalesce(F.col("valid"), F.lit(False)).cast("double"),
        "status": F.col("status").eqNullSafe(F.col("want_status")).cast("double"),
        "headline": _share(wanted("want_headline"), within("want_headline", F.coalesce("headline", F.lit("")))),
        "must_cite": _share(wanted("must_cite"), covered),
        "citation_validity": F.coalesce(F.try_divide(valid, F.size(sources)), F.lit(0.0)).cast("double"),
        "must_ask": F.when(F.col("asked").isNotNull() | (F.size(wanted("must_ask")) == 0), _share(F.array_distinct(wanted("must_ask")), asked)),
        "must_not": _share(wanted("must_not"), F.size(wanted("must_not")) - within("must_not", F.coalesce("text", F.lit("")))),
        "formal_mode": (F.size(T.progressive_forms(F.concat_ws(" ", "headline", "text"))) == 0).cast("double"),
        "disclaimer": F.col("disclaimer").eqNullSafe(F.lit(disclaimer)).cast("double"),
    }
    measured = answers.withColumns({f"_{m}": c for m, c in metrics.items()})
    total = reduce(lambda a, b: a + b, [F.coalesce(f"_{m}", F.lit(0.0)) for m in METRICS]) / reduce(lambda a, b: a + b, [F.col(f"_{m}").isNotNull().cast("int") for m in METRICS])
    return measured.select(*[c for c in answers.columns if c not in METRICS], *[F.col(f"_{m}").alias(m) for m in METRICS], total.alias("total"))
