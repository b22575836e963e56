"""Secret scans through a trigram inverted index (DataFrame functions only).

Method: each rule is a regular expression. Its parse tree gives a Boolean query over
trigrams that every match must hold (AND of the trigrams of mandatory literal runs, OR over
alternatives; texts and trigrams are lower-cased). The index holds postings
(trigram, doc_id) for the trigrams that the queries name; a rule's candidates are found by
intersecting postings (AND) and uniting the results (OR). Only candidates are verified by
the rule. A rule without mandatory trigrams scans every text.

Kinds assign, access and hex are the base rules (leftmost non-overlapping matches; those too
short are dropped afterwards, as their text stays consumed). Further kinds add spans.

Defined results: null text is empty (no spans); repeated rows each keep their row; rows whose
doc_id is null stand in no posting list; every rule scans them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

try:
    from re import _constants as sre_c
    from re import _parser as sre_p
except ImportError:  # Python before 3.11
    import sre_constants as sre_c
    import sre_parse as sre_p

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, without


@dataclass(frozen=True)
class Rule:
    """pattern in the syntax that Java and Python share; least: code points that `group` needs."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: In the order in which kinds are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    # maximal runs: the same spans as matching [0-9a-f]+ and dropping those under 24
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: A Boolean query: frozenset of conjunctions, each a frozenset of trigrams. EVERY matches all.
EVERY = frozenset([frozenset()])
#: Alternatives beyond this many collapse to a weaker query.
MOST = 64


def _and(a: frozenset, b: frozenset) -> frozenset:
    if len(a) * len(b) > MOST:
        return min(a, b, key=lambda q: (q == EVERY, len(q)))
    return frozenset(x | y for x in a for y in b)


def _or(a: frozenset, b: frozenset) -> frozenset:
    both = a | b
    both = frozenset(x for x in both if not any(y < x for y in both))
    return both if len(both) <= MOST else EVERY


def trigram_query(pattern: str) -> frozenset:
    """The trigrams that every match of the pattern holds, in disjunctive form."""

    def strings(node) -> list[str] | None:
        """All strings of a short fixed node, lower-cased, or None."""
        op, arg = node
        if op is sre_c.LITERAL:
            return [chr(arg).lower()]
        if op is sre_c.IN and len(arg) <= 8 and all(o is sre_c.LITERAL for o, _ in arg):
            return sorted({chr(a).lower() for _, a in arg})
        if op is sre_c.MAX_REPEAT and arg[:2] == (0, 1) and len(arg[2]) == 1 and (inner := strings(arg[2][0])):
            return ["", *inner]
        return None

    def grams(runs: list[str]) -> frozenset:
        out = None
        for s in runs:
            q = frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))])
            out = q if out is None else _or(out, q)
        return EVERY if out is None else out

    def walk(seq) -> frozenset:
        query, runs = EVERY, [""]
        for node in seq:
            op, arg = node
            options = strings(node)
            if options and len(runs) * len(options) <= MOST:
                runs = [r + o for r in runs for o in options]
                continue
            query, runs = _and(query, grams(runs)), [""]
            if op is sre_c.SUBPATTERN:
                query = _and(query, walk(arg[3]))
            elif op is sre_c.BRANCH:
                alt = None
                for branch in arg[1]:
                    q = walk(branch)
                    alt = q if alt is None else _or(alt, q)
                query = _and(query, alt)
            elif op is sre_c.MAX_REPEAT and arg[0] >= 1:
                query = _and(query, walk(arg[2]))
        query = _and(query, grams(runs))
        return frozenset(x for x in query if not any(y < x for y in query))

    return walk(sre_p.parse(pattern))


def postings(docs: DataFrame, grams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(trigram, id) of the named trigrams: the part of the inverted index that the queries read."""
    # the inner array binds the lower-cased text once
    found = F.transform(F.array(F.lower(F.col(text_col))), lambda low: F.filter(F.array(*[F.lit(g) for g in grams]), lambda g: F.contains(low, g)))
    return docs.select(F.col(id_col).alias("id"), F.explode(F.flatten(found)).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, frozenset]) -> DataFrame:
    """id and one Boolean per rule: the posting lists of each conjunction are intersected (ids that
    as many of its lists hold as it has trigrams), and the intersections of a rule united."""
    parts = [(kind, conj) for kind, query in queries.items() for conj in sorted(query, key=sorted)]
    of = {}  # trigram -> numbers of the conjunctions that name it
    for i, (_, conj) in enumerate(parts):
        for g in conj:
            of.setdefault(g, []).append(i)
    asked = F.create_map(*[c for g, some in sorted(of.items()) for c in (F.lit(g), F.array(*[F.lit(i) for i in some]))])
    lists = index.select("id", "trigram").select("id", F.explode(F.element_at(asked, F.col("trigram"))).alias("part"))
    # a posting list is never gathered: an id counts its lists, combined before the shuffle; repeated
    # ids count theirs together, which can only add candidates
    need = F.array(*[F.lit(len(conj)) for _, conj in parts])
    met = lists.groupBy("id", "part").agg(F.count("*").alias("n")).where(F.col("n") >= F.get(need, F.col("part")))
    rule = F.get(F.array(*[F.lit(kind) for kind, _ in parts]), F.col("part"))
    return met.groupBy("id").agg(*[F.max(rule == k).alias(f"maybe_{k}") for k in queries])


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start,end>> in code points. The pieces between matches and the matches
    alternate, so running sums of their lengths are the positions."""
    pat = F.lit(rule.pattern)
    pieces, whole = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pat, F.lit(0))
    kept = F.regexp_extract_all(text, pat, F.lit(rule.group)) if rule.group else whole
    both = F.zip_with(whole, kept, lambda w, k: F.struct(w.alias("w"), k.alias("k")))
    steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(whole)), both, lambda p, b: F.struct(F.char_length(p).alias("gap"), F.char_length(b["w"]).alias("len"), F.char_length(b["k"]).alias("key")))
    return F.transform(F.filter(_placed(steps), lambda s: s["key"] >= rule.least), lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["len"]).alias("end")))


def _running(items: Column) -> Column:
    """struct<at, out> for items array<struct<gap,len,key>>: out has their `start`, a running sum of
    gap and len; at is the sum of all. out grows by copying, so items should be few."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,len:int,key:int>>)").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        a = acc["at"] + s["gap"]
        return F.struct((a + s["len"]).alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), s["len"].alias("len"), s["key"].alias("key")))).alias("out"))

    return F.aggregate(items, start, add)


def _placed(steps: Column) -> Column:
    """The steps with their start in the text: running sums within blocks of about sqrt(n) steps, then
    over the blocks."""

    def by_blocks(st: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(st))).cast("int"), F.lit(1))
        firsts = F.sequence(F.lit(1), F.greatest(F.size(st), F.lit(1)), size)
        return F.transform(firsts, lambda i: _running(F.slice(st, i, size)))

    def shift(blocks: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        before = F.aggregate(blocks, zero, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, before, lambda b, at: F.transform(b["out"], lambda s: F.struct((s["start"] + at).alias("start"), s["len"].alias("len"), s["key"].alias("key")))))

    # the outer arrays bind steps and blocks once
    return F.transform(F.transform(F.array(steps), by_blocks), shift)[0]


def _named(hits: Column, order: int, kind: str) -> Column:
    return F.transform(hits, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with `found`: array<struct<start,order,kind,end>> sorted by start, then
    kind. A column of that name in docs is replaced."""
    docs = without(docs, ["found"])
    queries = {r.kind: q for r in rules if EVERY != (q := trigram_query(r.pattern)) and frozenset() not in q}
    docs = docs.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
    rows = docs
    if queries:
        grams = sorted({g for q in queries.values() for c in q for g in c})
        may = candidates(postings(docs.where(F.col(id_col).isNotNull()), grams, id_col, text_col), queries)
        may = may.select(F.col("id").alias("_dl_id"), F.lit(0).cast("long").alias("_dl_part"), *[F.col(f"maybe_{k}").alias(f"_dl_{k}") for k in queries])
        # rows without an id have no postings; they are dealt out by their text
        keyed = docs.withColumn("_dl_part", F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.lit(0)))
        rows = keyed.join(may, (F.coalesce(keyed[id_col], F.lit(0)) == may["_dl_id"]) & (keyed["_dl_part"] == may["_dl_part"]), "left")
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    each = []
    for order, r in enumerate(rules):
        hits = spans(F.col(text_col), r)
        if r.kind in queries:
            hits = F.when((F.col(id_col).isNull() | F.col(f"_dl_{r.kind}")) & F.regexp_like(F.col(text_col), F.lit(r.pattern)), hits).otherwise(none)
        else:
            hits = F.when(F.regexp_like(F.col(text_col), F.lit(r.pattern)), hits).otherwise(none)
        each.append(_named(hits, order, r.kind))
    return rows.select(*docs.columns, F.array_sort(F.concat(*each)).alias("found"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    base = [r.kind for r in RULES if r.base]
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in base],
        F.sha2(F.encode(_joined(F.filter("found", lambda s: s["kind"].isin(base))), "UTF-8"), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The digest in DuckDB: matches and the pieces between them give the positions."""
    lists = []
    for order, r in enumerate(rules):
        p = "'" + r.pattern.replace("(?<![0-9a-f])", "").replace("'", "''") + "'"
        at = "list_sum(list_transform(c[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0)"
        one = f"{{'a': ({at})::BIGINT, 'o': {order}, 'k': '{r.kind}', 'b': ({at} + length(w[i]))::BIGINT, 'n': length(g[i])}}"
        lists.append(
            f"(select list_filter(list_transform(range(1, len(w) + 1), lambda i: {one}), lambda s: s.n >= {r.least}) "
            f"from (select regexp_extract_all(t, {p}) as w, regexp_extract_all(t, {p}, {r.group}) as g, string_split_regex(t, {p}) as c))"
        )
    text = lambda keep: f"coalesce(array_to_string(list_transform(list_sort(list_filter(f, lambda s: {keep})), lambda s: s.k || ':' || s.a || ':' || s.b), ','), '')"
    base = [r.kind for r in rules if r.base]
    counts = ", ".join(f"len(list_filter(f, lambda s: s.k = '{k}'))::BIGINT as n_{k}" for k in base)
    kinds = ", ".join(f"'{k}'" for k in base)
    return (
        f"with d as (select doc_id, coalesce(text, '') as t from documents), "
        f"e as (select doc_id, {' || '.join(lists)} as f from d) "
        f"select doc_id, {counts}, sha256({text(f's.k in ({kinds})')}) as base_sha256, {text('true')} as spans from e"
    )


OP2_SQL = _sql()
