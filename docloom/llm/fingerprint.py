"""Document fingerprints by consistent weighted sampling (DataFrame functions only).

Method: improved consistent weighted sampling. A document is a weighted set, word -> number
of occurrences. For sample j and word k, hashes give r, c ~ Gamma(2, 1) and b ~ U(0, 1);
with weight w: t = floor(ln w / r + b), ln a = ln c - r (t - b) - r. The sample is the
(k, t) of least a. Two documents agree on a sample with probability
sum(min(w)) / sum(max(w)), the generalised Jaccard similarity, so the share of equal
samples estimates it. The Gamma draws come from a quantile table of 512 steps.

Each (document, word) has a row for every CHUNK samples, so that plan and compiled code stay
small whatever the number of samples; a word that a text and its edited form hold equally often
is drawn once for both.

Neighbours: distinct (doc_id, hash of the text) rows without texts are range-partitioned and
sorted by Spark, numbered across the parts, and joined with their successors. The texts are
shuffled once, by that key; each document's head goes to its predecessor, and all words of a
document are grouped where its text lies.

Defined results: null text is empty; a text without words has a fixed fingerprint, equal to
that of any other such text; rows with equal doc_id are ordered by a hash of the text;
repeated rows follow each other and keep a row each; null doc_id sorts last. An empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, input_bytes, materialize, table

SAMPLES = 64
STEPS = 512
#: Bytes of texts in one task of the shuffle; more where that would give over MOST_TASKS tasks.
TASK_BYTES = 2 << 20
MOST_TASKS = 200_000
#: Bytes of rows without texts in one part of the order.
ORDER_BYTES = 8 << 20
#: Samples that a row of a (document, word) draws; their columns stand in the plan.
CHUNK = 2


def gamma2_quantiles(n: int = STEPS, below: float = 1.0) -> list[float]:
    """n quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x), up to
    the share `below`."""
    out, x = [], math.sqrt(below / n)
    for i in range(n):
        q = (i + 0.5) / n * below
        for _ in range(60):
            step = (1 - (1 + x) * math.exp(-x) - q) / (x * math.exp(-x))
            x = max(x - step, x / 2)
            if abs(step) < 1e-12:
                break
        out.append(x)
    return out


def _doubles(values: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{v:.6g}" for v in values)), ",").cast("array<double>")


def samples(key: Column, first: Column, weight: Column, lnw: Column, n: int) -> list[Column]:
    """One long for each of the samples first, ..., first + n - 1: ln a in the upper bits (so that
    min() finds the winner), 16 bits of the winner's identity (key, t) below."""
    # the least c win, so the first step of their table is cut into STEPS steps of its own
    q, low = gamma2_quantiles(), gamma2_quantiles(STEPS, 1 / STEPS)
    r_of, lnc_of, lnc_low = _doubles(q), _doubles([math.log(x) for x in q]), _doubles([math.log(x) for x in low])
    out = []
    for s in range(n):
        x = F.xxhash64(key, first + F.lit(s))
        place = lambda by: F.shiftrightunsigned(x, by).bitwiseAND(F.lit(STEPS - 1)).cast("int")  # noqa: E731,B023
        r = F.get(r_of, place(0))
        ln_c = F.when(place(9) > 0, F.get(lnc_of, place(9))).otherwise(F.get(lnc_low, place(18)))
        b = F.shiftrightunsigned(x, 27).cast("double") / F.lit(float(1 << 37))
        t = F.when(weight == 1, F.lit(0.0)).otherwise(F.floor(lnw / r + b).cast("double"))
        ln_a = ln_c - r * (t - b + 1.0)
        # the low bits of b say nothing about who wins; ln a lies well inside (-500, 100), and 38
        # bits of fraction keep ties to equal draws
        who = (F.shiftrightunsigned(x, 27) + t.cast("long") * 40503).bitwiseAND(F.lit(0xFFFF))
        out.append(F.shiftleft(((ln_a + 512.0) * float(1 << 37)).cast("long"), 16).bitwiseOR(who))
    return out


def words_of(text: Column) -> Column:
    """Words are runs without ASCII white space, A-Z lower-cased."""
    return F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+")


def signatures(df: DataFrame, keys: list[str], text: str, other: str | None = None, n: int = SAMPLES) -> DataFrame:
    """keys, sig0 array<int> and, for a second text column, sig1: the samples of each text (null for
    a text without words), for rows with words. keys must identify rows; where df is already
    partitioned by some of them, nothing is shuffled."""
    texts = F.array(*[F.struct(F.lit(k).alias("side"), F.col(t).alias("t")) for k, t in enumerate([text, other or text][: 2 if other else 1])])
    terms = df.select(*keys, F.explode(texts).alias("s")).select(*keys, "s.side", F.explode(words_of(F.col("s.t"))).alias("term")).where("term != ''")
    terms = terms.groupBy(*keys, F.xxhash64("term").alias("k")).agg(F.count_if(F.col("side") == 0).alias("w0"), F.count_if(F.col("side") == 1).alias("w1"))
    # a word that both hold equally often (side 2) is drawn once
    one = lambda side, w: F.struct(F.lit(side).alias("side"), F.col(w).alias("w"), F.ln(F.col(w).cast("double")).alias("lnw"))
    held = F.when(F.col("w1") == F.col("w0"), F.array(one(2, "w0"))).when(F.col("w1") == 0, F.array(one(0, "w0"))).when(F.col("w0") == 0, F.array(one(1, "w1"))).otherwise(F.array(one(0, "w0"), one(1, "w1")))
    terms = terms.select(*keys, "k", F.inline(held))
    rows = terms.select("*", F.explode(F.array(*[F.lit(i) for i in range(0, n, CHUNK)])).alias("first"))
    mins = rows.groupBy(*keys, "side", "first").agg(*[F.min(m).alias(f"m{s}") for s, m in enumerate(samples(F.col("k"), F.col("first"), F.col("w"), F.col("lnw"), CHUNK))])
    # the samples of a row, in order; of each the least of its sides
    least = mins.select(*keys, "side", "first", F.array(*[f"m{s}" for s in range(CHUNK)]).alias("m"))
    whole = least.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", "side", "m"))).alias("all"))

    def sig(side: int) -> Column:
        mine = F.filter("all", lambda p: p["side"] != 1 - side)
        pick = lambda which: F.flatten(F.transform(F.filter(mine, lambda p: p["side"] == which), lambda p: p["m"]))
        both = F.arrays_zip(pick(side).alias("x"), pick(2).alias("y"))
        codes = F.transform(both, lambda p: F.least(p["x"], p["y"]).bitwiseAND(F.lit(0xFFFF)).cast("int"))
        return F.when(F.size(mine) > 0, F.slice(codes, 1, n)).alias(f"sig{side}")

    return whole.select(*keys, *[sig(k) for k in range(2 if other else 1)])


def as_text(sig: Column) -> Column:
    """Four hexadecimal digits a sample; "-" for a text without words."""
    return F.coalesce(F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), ""), F.lit("-"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; 1 for two texts without words, 0 if one has words."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.size(a))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SAMPLES) -> DataFrame:
    """Per row: id, sig array<int>, fingerprint string."""
    keyed = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    keyed = keyed.repartition("_row")
    sig = signatures(keyed, ["_row"], "_text", n=n)
    return keyed.select("_row", "_id").join(sig, "_row", "left").select(F.col("_id").alias(id_col), F.col("sig0").alias("sig"), as_text(F.col("sig0")).alias("fingerprint"))


def successors(rows: DataFrame) -> DataFrame:
    """Of (doc_id, h, n_chars, copies), one row for each (doc_id, h): the same with idx, the place
    in the order of descending doc_id (null last), then h, and before_id, before_h,
    before_chars, before_idx of the row before it (the last for the first)."""
    n = min(MOST_TASKS, max(1, -(-input_bytes(rows) // ORDER_BYTES)))
    order = [F.desc_nulls_last("doc_id"), F.asc("h")]
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed.select("*", F.shiftright("at", 33).alias("part")), "op10-order")
    # one row a part: how many rows are before it
    shift = placed.groupBy("part").agg(F.count("*").alias("n"))
    shift = shift.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("shift"))
    idx = (F.col("shift") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("idx")
    rows = materialize(placed.join(F.broadcast(shift), "part").select("doc_id", "h", "n_chars", "copies", idx), "op10-order")
    discard(placed)
    total = max(rows.count(), 1)
    before = rows.select(F.pmod(F.col("idx") + 1, F.lit(total)).alias("idx"), F.col("doc_id").alias("before_id"), F.col("h").alias("before_h"), F.col("n_chars").alias("before_chars"), F.col("idx").alias("before_idx"))
    return rows.join(before, "idx")


def _known(id_col: str, h: str) -> list[Column]:
    """Join key without nulls: the id (0 for null) and the hash of the text (others for null)."""
    return [F.coalesce(F.col(id_col), F.lit(0).cast("long")), F.when(F.col(id_col).isNull(), F.xxhash64(h)).otherwise(F.col(h))]


def with_next(docs: DataFrame, n: int = SAMPLES) -> DataFrame:
    """Fingerprints of each document, of its text whose last third is replaced by the head
    of the next document (descending doc_id, the first after the last), and likenesses."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    small = rows.groupBy("doc_id", "h").agg(F.first(F.char_length("text")).alias("n_chars"), F.count("*").alias("copies"))
    small = materialize(small, "op10-ids")
    repeated = bool(small.where("copies > 1").limit(1).count())
    order = materialize(successors(small), "op10-next")
    discard(small)

    key = ["k1", "k2"]
    texts = rows.select(*[k.alias(a) for k, a in zip(_known("doc_id", "h"), key)], "text")
    if repeated:
        texts = texts.dropDuplicates(key)
    texts = texts.repartition(min(MOST_TASKS, max(1, -(-input_bytes(docs) // TASK_BYTES))), *key)
    place = order.select(*[k.alias(a) for k, a in zip(_known("doc_id", "h"), key)], *[k.alias(a) for k, a in zip(_known("before_id", "before_h"), ("b1", "b2"))], "doc_id", "n_chars", "copies", "idx", "before_chars")
    whole = texts.join(place, key)
    third = lambda c: F.floor(F.col(c) / 3).cast("int")
    heads = whole.select(F.col("b1").alias("k1"), F.col("b2").alias("k2"), F.substring("text", F.lit(1), third("before_chars")).alias("head"))
    pairs = whole.join(heads, key).withColumn("own", F.lit(0)).withColumn("rows", F.lit(1).cast("long"))
    if repeated:  # all but the last of equal rows are followed by their own text
        pairs = pairs.unionByName(whole.where("copies > 1").select("*", F.col("text").alias("head"), F.lit(1).alias("own"), (F.col("copies") - 1).alias("rows")))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - third("n_chars")).cast("int")), F.substring("head", F.lit(1), third("n_chars")))
    pairs = pairs.select(*key, "own", "rows", "idx", "doc_id", "n_chars", "text", edited.alias("edited"))
    sig = signatures(pairs, [*key, "own"], "text", "edited", n)
    meta = pairs.select(*key, "own", "rows", "idx", "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    full = materialize(meta.join(sig, [*key, "own"], "left").drop(*key), "op10-signatures")

    # the sample of the row after, by its place
    after = order.select("idx", "before_idx").join(full.where("own = 0").select("idx", F.col("sig0").alias("next")), "idx").select(F.col("before_idx").alias("idx"), "next")
    full = full.join(after, "idx")
    nxt = F.when(F.col("own") == 1, F.col("sig0")).otherwise(F.col("next"))
    out = full.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256",
        as_text(F.col("sig0")).alias("fingerprint"), as_text(F.col("sig1")).alias("edited_fingerprint"),
        likeness(F.col("sig0"), F.col("sig1")).alias("near_edited"), likeness(F.col("sig0"), nxt).alias("near_next"), "rows",
    )
    if repeated:
        out = out.select(*out.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("_copy")).drop("_copy")
    return out.drop("rows")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents"))
