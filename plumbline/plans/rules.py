"""Rule tables over orders and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import rules as R
from plumbline.plans.registry import Tables, query

#: Rules for orders as records: status is the outcome, priority the court, the year of the key the printed year.
_RULES = [
    ("outcome_unmapped", "unmapped", "medium", 1), ("court_missing", "court = ''", "low", 2), ("karar_year_ne_date_year", "printed <> year(day)", "medium", 3), ("price_missing", "o_totalprice IS NULL OR o_totalprice < 2000", "low", 4), ("early", "day < DATE '1996-01-01'", "high", 5),
]


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 12 = 0 THEN '' ELSE o_orderpriority END AS court, 1995 + o_orderkey % 7 AS printed, CAST(o_orderdate AS DATE) AS day, o_totalprice, o_orderkey % 15 = 0 AS tip FROM orders),
c AS (SELECT *, CASE WHEN s IN ('final', 'open') THEN s ELSE '' END AS outcome, list_filter([CASE WHEN tip THEN 'unknown_code:x' END, CASE WHEN s NOT IN ('final', 'open', '') THEN 'outcome_unmapped' END, CASE WHEN court = '' THEN 'court_missing' END, CASE WHEN printed <> year(day) THEN 'karar_year_ne_date_year' END, CASE WHEN o_totalprice IS NULL OR o_totalprice < 2000 THEN 'price_missing' END, CASE WHEN day < DATE '1996-01-01' THEN 'early' END], lambda x: x IS NOT NULL) AS codes FROM r)
SELECT o_orderkey, outcome, array_to_string(codes, ',') AS codes, CASE WHEN list_has_any(codes, ['court_missing', 'price_missing']) THEN 'low' WHEN list_has_any(codes, ['outcome_unmapped', 'karar_year_ne_date_year']) THEN 'medium' ELSE 'high' END AS band, CASE WHEN court = '' THEN 'court' ELSE '' END || CASE WHEN court = '' AND outcome = '' THEN ',' ELSE '' END || CASE WHEN outcome = '' THEN 'outcome' ELSE '' END AS missing FROM c""")
def rule_bands(t: Tables) -> DataFrame:
    """Orders normalised, with the codes that a table of rules raises, their band, and the fields that are missing."""
    table = t.spark.createDataFrame(_RULES, R.RULES)
    outcome, unmapped = R.mapped(F.col("o_orderstatus"), ["final", "open"], {"F": "final", "O": "open"})
    key = F.col("o_orderkey")
    rows = t.orders.select(key, outcome.alias("outcome"), unmapped.alias("unmapped"), F.when(key % 12 == 0, "").otherwise(F.col("o_orderpriority")).alias("court"), (1995 + key % 7).alias("printed"), F.to_date("o_orderdate").alias("day"), "o_totalprice", F.when(key % 15 == 0, F.array(F.lit("unknown_code:x"))).alias("found"))
    out = R.judged(rows, R.checked(table), "found")
    return out.select("o_orderkey", "outcome", F.array_join("codes", ",").alias("codes"), "band", F.array_join(R.missing({"court": F.lit(True), "outcome": F.lit(True)}), ",").alias("missing"))
