"""Secret scans over a trigram inverted index.

Each rule's regular expression yields a Boolean trigram query: alternatives, each a set of trigrams
that a match must contain. Postings (trigram, doc_id) are written once, the queries intersect
them, and the rule's expression verifies the candidates. Rules without mandatory trigrams scan fully.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, column_name, load, quoted, staged

parser = re._parser  # the standard library's own regular-expression parser

#: Strings or alternatives beyond this weaken a query (more candidates, never fewer).
MOST = 64
ANYTHING: frozenset = frozenset([frozenset()])


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``shortest`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    shortest: int = 1
    base: bool = False


#: The base rules as agreed, then well-known token formats. In ``access`` and ``hex`` the
#: length stands in the pattern; both take whole runs, so that drops just the matches that are too short.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, base=True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


# --- Boolean trigram queries -------------------------------------------------------------------


def either(a: frozenset, b: frozenset) -> frozenset:
    """a or b, without alternatives that ask for more than another."""
    every = a | b
    return frozenset(x for x in every if not any(y < x for y in every))


def both(a: frozenset, b: frozenset) -> frozenset:
    made = reduce(either, (frozenset([x | y]) for x in a for y in b))
    return made if len(made) <= MOST else a


def any_of(strings: set[str]) -> frozenset:
    if any(len(s) < 3 for s in strings):
        return ANYTHING
    return reduce(either, (frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings))


def read(item) -> tuple[set[str] | None, frozenset]:
    """All strings that a parsed item can match (None: too many), and the query for it."""
    kind, value = str(item[0]), item[1]
    if kind == "LITERAL":
        return {chr(value).lower()}, ANYTHING
    if kind == "IN" and all(str(k) == "LITERAL" for k, _ in value) and len(value) <= 8:
        return {chr(v).lower() for _, v in value}, ANYTHING
    if kind == "SUBPATTERN":
        return read_all(value[-1])
    if kind == "BRANCH":
        parts = [read_all(x) for x in value[1]]
        queries = reduce(either, (q if s is None else any_of(s) for s, q in parts))
        if all(s is not None for s, _ in parts) and len(strings := set().union(*(s for s, _ in parts))) <= MOST:
            return strings, queries
        return None, queries
    if kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, inner = value
        strings, query = read_all(inner)
        if (least, most) == (0, 1):
            return (None if strings is None else strings | {""}), ANYTHING
        if least == 0:
            return None, ANYTHING
        return None, query if strings is None else any_of(strings)
    if kind == "AT":
        return {""}, ANYTHING
    return None, ANYTHING


def read_all(items) -> tuple[set[str] | None, frozenset]:
    run, query, whole = {""}, ANYTHING, True
    for item in items:
        strings, own = read(item)
        if strings is not None and len(run) * len(strings) <= MOST:
            run = {a + b for a in run for b in strings}
            continue
        query, whole = both(query, any_of(run)), False
        if strings is None:
            query, run = both(query, own), {""}
        else:
            run = strings
    return (run if whole else None), (any_of(run) if whole else both(query, any_of(run)))


def trigram_query(pattern: str) -> frozenset:
    """Alternatives, each a set of lower-case trigrams that a match contains; ``ANYTHING`` if there are none."""
    return read_all(parser.parse(pattern))[1]


# --- the index ---------------------------------------------------------------------------------


def postings(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """(trigram, doc_id) for each text that has the trigram, ASCII case folded.

    The index holds the trigrams that the rules' queries name: no query would read another posting.
    A posting list is rows of a table, so one that covers a third of all documents is no large value.
    """
    have = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("folded"), t))
    folded = docs.select("doc_id", ascii_lower(F.col("text")).alias("folded"))
    return folded.select(F.explode(have).alias("trigram"), "doc_id")


def candidates(index: DataFrame, queries: dict[str, frozenset]) -> DataFrame:
    """(doc_id, kinds): the rules whose query a document's postings satisfy."""
    wanted = [(t, kind, n, len(alternative)) for kind, q in queries.items() for n, alternative in enumerate(sorted(map(sorted, q))) for t in alternative]
    asked = index.sparkSession.createDataFrame(wanted, "trigram string, kind string, alternative int, needs int")
    met = index.join(F.broadcast(asked), "trigram").groupBy("doc_id", "kind", "alternative").agg(F.count_distinct("trigram").alias("n"), F.max("needs").alias("needs"))
    return met.where("n = needs").groupBy("doc_id").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


# --- verification ------------------------------------------------------------------------------


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running_sums(values: Column, block: int = 256) -> Column:
    """Sums of an array up to each place, by blocks, so that long arrays stay cheap."""
    zero = F.lit(0).cast("int")
    total = lambda part: F.aggregate(part, zero, lambda a, x: a + x)

    def with_blocks(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(block))
        sums = F.transform(starts, lambda s: total(F.slice(v, s + 1, F.lit(block))))
        before = let(sums, lambda b: F.transform(b, lambda _, i: total(F.slice(b, F.lit(1), i))))
        return let(before, lambda b: F.transform(v, lambda _, i: F.get(b, F.floor(i / block).cast("int")) + total(F.slice(v, i - i % block + 1, i % block + 1))))

    return let(values, with_blocks)


def matches(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, order, kind, end>>: leftmost non-overlapping matches, code points, end exclusive."""
    found = F.struct(
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("m"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("v"),
        F.split(text, rule.pattern, -1).alias("between"),
    )

    def spans(s: Column) -> Column:
        m, v, between = s.getField("m"), s.getField("v"), s.getField("between")
        steps = F.transform(m, lambda _, i: F.length(F.get(between, i)) + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(0))
        all_spans = let(
            running_sums(steps),
            lambda starts: F.transform(
                m,
                lambda x, i: F.struct(
                    F.get(starts, i).alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), (F.get(starts, i) + F.length(x)).alias("end"), F.length(F.get(v, i)).alias("size")
                ),
            ),
        )
        kept = F.filter(all_spans, lambda x: x.getField("size") >= rule.shortest)
        return F.transform(kept, lambda x: x.dropFields("size"))

    return let(found, spans)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` plus ``secret_spans``: array<struct<start, order, kind, end>> by start, then rule order.

    A null text is empty and has no spans. A null doc_id is indexed like any other id; rows that
    share an id share candidates and are verified each on its own text. Existing columns stay, and
    one named secret_spans (in any case) makes the new one ``_secret_spans``. Empty in, empty out.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q != ANYTHING}
    spans, kinds, key = (column_name(docs, n) for n in ("secret_spans", "secret_kinds", "secret_id"))
    text = F.coalesce(docs["text"], F.lit(""))
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    if indexed:
        grams = sorted({t for q in indexed.values() for a in q for t in a})
        index = staged(postings(docs.select("doc_id", "text"), grams), "trigram-index")
        cands = staged(candidates(index, indexed), "secret-candidates").select(F.col("doc_id").alias(key), F.col("kinds").alias(kinds))
        probed = docs.join(cands, docs["doc_id"].eqNullSafe(cands[key]), "left")
    else:
        probed = docs.withColumn(kinds, F.lit(None).cast("array<string>"))
    each = []
    for order, rule in enumerate(rules):
        asked = F.array_contains(F.col(kinds), rule.kind) if rule.kind in indexed else text.rlike(rule.pattern)
        each.append(F.when(asked, matches(text, rule, order)).otherwise(none))
    return probed.select(*[F.col(quoted(c)) for c in docs.columns], F.array_sort(F.concat(*each)).alias(spans))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secret_spans")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = [r.kind for r in RULES if r.base]
    return found.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(joined(F.filter("secret_spans", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("secret_spans")).alias("spans"),
    )


def kind_sql(order: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, n, {order} AS ord, '{rule.kind}' AS kind, {str(rule.base).lower()} AS base,
         CAST(list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0) AS BIGINT) AS s,
         len(m[i]) AS size
  FROM (SELECT doc_id, n, p, m, v, unnest(generate_series(1, len(m))) AS i
        FROM (SELECT doc_id, n, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS m,
                     regexp_extract_all(t, '{pattern}', {rule.group}) AS v FROM d))
  WHERE len(v[i]) >= {rule.shortest}"""


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS n FROM documents),
found AS ({" UNION ALL ".join(kind_sql(i, r) for i, r in enumerate(RULES))}),
parts AS (SELECT *, kind || ':' || s || ':' || (s + size) AS part FROM found)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
       count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(part, ',' ORDER BY s, ord) FILTER (base), '')) AS base_sha256,
       coalesce(string_agg(part, ',' ORDER BY s, ord), '') AS spans
FROM d LEFT JOIN parts USING (n) GROUP BY d.n, d.doc_id
"""

QUERIES = {"op1_secrets": op1_secrets}
ORACLE_SQL = {"op1_secrets": ORACLE}
