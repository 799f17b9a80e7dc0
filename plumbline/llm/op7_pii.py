"""Personal data: pattern-found entities, and the terms that reveal them by corpus co-occurrence.

Entities are e-mail addresses, IP addresses, card numbers and phone numbers. A term near an entity
discloses it in the measure in which seeing the term makes the entity likelier:

    PMI(term; entity) = log2( p(term | near entity) / p(term) ),  entity's information = -log2 p(entity)

with all probabilities counted over the whole corpus. A term whose PMI reaches ``disclosure`` times
the entity's information is a span of its own (kind ``term``) wherever it stands in a document that
holds the entity; from ``removal`` times on it is to be removed, below that generalised. An entity is
protected both as a value (this address) and as a class (any address). Only contexts that differ
count, so copies of a document are one observation, and a term counts only if it stands in more of
the entity's contexts than chance would put it in (at least two; Chernoff's bound on the tail of the
number expected from the term's share of the corpus, below ``chance``).

The scan is one map over the texts; it stores per document its spans, the terms near them and, where
it has spans, its text, and per task its word counts. Terms near entities are counted by joins that
copies and hot sources cannot blow up: counts are combined before they are shuffled. A second map
over the stored texts gives the occurrences of terms that disclose one of the document's entities,
picked by a filter of bounded size and then by an exact join in which hot pairs are broadcast.

Defined results: null text = empty text = no spans; repeated or null ``doc_id`` rows stay separate
(each row carries its own key), in the sanitised texts too; spans of one start are in order of kind;
a very long text is scanned in time linear in its length; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import ids_and_texts, joined, key_filter, passes, stored, table
from plumbline.llm.shingles import mixed

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match that fails from the start of a digit run fails from inside it, so runs are tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ outwards (linear in the text)."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def entities(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; offsets in code points, end exclusive."""
    found = [("email", *x) for x in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(x[-9:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdecimal() for c in m[0]) <= 15]
    return found


#: Terms on each side of an entity that make its context, and the characters within which they lie.
WORDS, REACH = 6, 160
FILTERED = 1 << 25  # pairs of entity and term up to which a broadcast filter, 16 bits for each, is used


def nearby_terms(text: str, start: int, end: int, words: int = WORDS, reach: int = REACH) -> list[tuple[str, int, int]]:
    """Up to ``words`` whole terms on each side of a span, on its own line."""
    low = max(0, start - reach)
    while 0 < low < start and text[low - 1].isalpha() and text[low].isalpha():
        low += 1
    low = max(low, text.rfind("\n", low, start) + 1)
    high = min(len(text), end + reach)
    while end < high < len(text) and text[high - 1].isalpha() and text[high].isalpha():
        high -= 1
    line = text.find("\n", end, high)
    before = [m for m in _TERM.finditer(text, low, start)][-words:]
    after = [m for _, m in zip(range(words), _TERM.finditer(text, end, high if line < 0 else line))]
    return [(m[0].lower(), *m.span()) for m in before + after]


class Covered:
    """Places that some spans cover, looked up by halving."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end) - 1
        return at >= 0 and self.ends[at] > start


def _key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_NEAR = pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("context", pa.int64())])
_WORD = pa.struct([("term", pa.int64()), ("n", pa.int64())])
_SCAN = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("entities", pa.list_(pa.int64())), ("spans", pa.list_(_SPAN)), ("near", pa.list_(_NEAR)), ("words", pa.list_(_WORD))])
SCAN = "row long, doc_id long, text string, entities array<long>, spans array<struct<kind:string,start:int,end:int>>, near array<struct<entity:long,term:long,context:long>>, words array<struct<term:long,n:long>>"


def scan(docs: DataFrame, all_texts: bool = False) -> DataFrame:
    """One row per document (row, doc_id, entities, spans, near; text where it has spans, or always)
    and word counts in rows without ``row``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, row = Counter(), TaskContext.get().partitionId() << 36

        def counted() -> pa.RecordBatch:
            words = [{"term": _key(w), "n": n} for w, n in counts.items()]
            counts.clear()
            return pa.RecordBatch.from_pylist([{"words": words[i : i + 50_000]} for i in range(0, len(words), 50_000)], schema=_SCAN)

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                row += 1
                counts.update(_TERM.findall(text.lower()))
                spans, near, keys = entities(text), [], {}
                taken = Covered([(s, e) for _, s, e in spans])
                for kind, start, end in spans:
                    value = f"{kind}:{text[start:end].lower()}"
                    own = [keys.setdefault(x, _key(x)) for x in (kind, value)]
                    terms = [t for t, s, e in nearby_terms(text, start, end) if not taken.meets(s, e)]
                    context = _key(" ".join(terms))
                    near += [{"entity": x, "term": _key(term), "context": context} for term in terms for x in own]
                rows.append({"row": row, "doc_id": doc_id, "text": text if spans or all_texts else None, "entities": list(keys.values()), "spans": [{"kind": k, "start": s, "end": e} for k, s, e in spans], "near": near})
            yield pa.RecordBatch.from_pylist(rows, schema=_SCAN)
            if len(counts) > 400_000:
                yield counted()
        yield counted()

    return ids_and_texts(docs).mapInArrow(run, SCAN)


def disclosing_terms(found: DataFrame, disclosure: float = 0.8, removal: float = 0.95, chance: float = 1e-6) -> DataFrame:
    """(entity, term, pair, n, share, remove): terms whose PMI reaches ``disclosure`` of the entity's
    information; n: how often they stand near it."""
    near = found.select(F.explode("near").alias("x")).select("x.entity", "x.term", "x.context")
    pairs = near.groupBy("entity", "term", "context").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n"), F.count("*").alias("contexts"))
    # The class of an entity has few values and each value few pairs, so sums are combined in the map.
    around = near.groupBy("entity").agg(F.count("*").alias("around"))
    spots = near.select("entity", "context").distinct().groupBy("entity").agg(F.count("*").alias("spots"))
    words = found.select(F.explode("words").alias("x")).groupBy(F.col("x.term").alias("term")).agg(F.sum("x.n").alias("n_term"))
    total = found.select(F.explode("words").alias("x")).agg(F.sum("x.n").alias("total"))
    expected = F.col("spots") * F.least(F.lit(1.0), 2 * WORDS * F.col("n_term") / F.col("total"))
    bound = F.col("contexts") * F.log(F.col("contexts") / expected) - F.col("contexts") + expected
    scored = (
        pairs.filter("contexts >= 2")
        .join(around.join(spots, "entity"), "entity")
        .join(words, "term")
        .crossJoin(F.broadcast(total))  # one row
        .filter((F.col("contexts") > expected) & (bound >= -math.log(chance)))
        .withColumn("pmi", F.log2(F.col("n") / F.col("around")) - F.log2(F.col("n_term") / F.col("total")))
        .withColumn("share", F.col("pmi") / -F.log2(F.col("around") / F.col("total")))
    )
    return scored.filter(F.col("share") >= disclosure).select("entity", "term", _pair("entity", "term").alias("pair"), "n", "share", (F.col("share") >= removal).alias("remove"))


def _pair(entity: str, term: str):
    return F.xxhash64(entity, term)


def _occurrences(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """row, entity, term, start, end: terms of documents with entities, at least those in ``pairs``."""
    n = pairs.count()
    mix = lambda e, t: (mixed(mixed(e.astype(np.uint64)) + t.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(mix(batch.column("entity").to_numpy(), batch.column("term").to_numpy()))], names=["at"])

    few = found.sparkSession.sparkContext.broadcast(key_filter(pairs.select("entity", "term").mapInArrow(keyed, "at long"), "at", n)) if n <= FILTERED else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [[np.zeros(0, np.int64)] for _ in range(5)]
            for row, text, own, spans in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "entities", "spans")), strict=True):
                taken = Covered([(s["start"], s["end"]) for s in spans])
                places: dict[str, list[tuple[int, int]]] = {}
                for m in _TERM.finditer(text):
                    if not taken.meets(*m.span()):
                        places.setdefault(m[0].lower(), []).append(m.span())
                entity, terms = np.array(own, np.int64), np.array([_key(t) for t in places], np.int64)
                spots = list(places.values())
                for low in range(0, len(entity), 1_000):  # a text of very many entities, some at a time
                    some = entity[low : low + 1_000]
                    e, t = np.repeat(some, len(terms)), np.tile(np.arange(len(terms)), len(some))
                    if few is not None:
                        use = passes(few.value, mix(e, terms[t]))
                        e, t = e[use], t[use]
                    if len(e):
                        times = np.array([len(spots[i]) for i in t.tolist()])
                        at = np.array([x for i in t.tolist() for x in spots[i]], np.int64)
                        for held, new in zip(parts, (np.full(len(at), row), np.repeat(e, times), np.repeat(terms[t], times), at[:, 0], at[:, 1]), strict=True):
                            held.append(new)
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in parts], names=["row", "entity", "term", "start", "end"])

    return found.filter(F.size("spans") > 0).select("row", "text", "entities", "spans").mapInArrow(run, "row long, entity long, term long, start long, end long")


def find_personal_data(docs: DataFrame, all_texts: bool = False, **thresholds: float) -> DataFrame:
    """row, doc_id, text (see ``scan``), spans (entities) and terms (struct start, end, remove) per document."""
    found = stored(scan(docs, all_texts), "personal-data")
    pairs = stored(disclosing_terms(found, **thresholds), "disclosing")
    hits = joined(_occurrences(found, pairs).withColumn("pair", _pair("entity", "term")).select("row", "pair", "start", "end"), pairs.select("pair", "n", "remove"), "pair")
    terms = hits.groupBy("row", "start", "end").agg(F.max("remove").alias("remove")).groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "remove"))).alias("terms"))
    return found.filter(F.col("row").isNotNull()).select("row", "doc_id", "text", "spans").join(terms, "row", "left")


def sanitised(docs: DataFrame, **thresholds: float) -> DataFrame:
    """doc_id, text of every row, with entities as ``<kind>``, disclosing terms as ``<term>`` or taken
    out. The texts are stored once beside their spans, so each row gets its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans, terms in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "terms")), strict=True):
                cuts = [(s["start"], s["end"], f"<{s['kind']}>") for s in spans]
                cuts += [(t["start"], t["end"], "" if t["remove"] else "<term>") for t in terms or ()]
                parts, at = [], 0
                for start, end, put in sorted(cuts):
                    if start >= at:
                        parts += [text[at:start], put]
                    at = max(at, end)
                out.append("".join([*parts, text[at:]]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return find_personal_data(docs, all_texts=True, **thresholds).select("doc_id", "text", "spans", "terms").mapInArrow(run, "doc_id long, text string")


def span_text(spans) -> F.Column:
    """kind:start:end of each span, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = span_text(F.col("spans"))
    terms = F.transform(F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,remove:boolean>>")), lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    return found.select("doc_id", *map(count, KINDS), F.sha2(base, 256).alias("base_sha256"), span_text(F.concat("spans", terms)).alias("spans"), F.size(terms).cast("long").alias("n_term"))
