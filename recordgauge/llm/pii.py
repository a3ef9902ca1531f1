"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the matches of four base patterns (email, ip, card, phone) and, for a fifth kind,
secrets, tokens that look like a hex digest. Candidates are tokens that hold a digit or an
'@' and are no mere part of a base match. The surroundings of seeds and candidates are their
lexical patterns, from the narrowest to the widest: the two words before, the word on either
side, the word before, the word after, and the classes of the two words before (runs of
letters and of digits as one mark each).

Patterns and instances form a graph whose distinct edges are scored in rounds, until no
score changes or ROUNDS have passed: a pattern by the share of its instances believed to be
of a kind (those of no kind yet, but of its shape, speak against it by half), an instance by
the patterns that extract it (noisy or); seeds stay at one.
A pattern is believed from BELIEF on, with at least MIN_SEEDS believed instances, or
WIDE_SEEDS if it sees one side or classes only, as those say less. Candidates that score
ACCEPT or more and have a fitting shape become further spans of that kind, wherever they
occur. Base spans always stay; a secret is a span only if believed patterns extract it.

All texts are scanned once, each pattern by one split and one extraction, and offsets are
running sums; only short rows (offsets, values, hashes of patterns) are shuffled. The base
patterns are rewritten with possessive quantifiers and run anchors, which match the same
spans in linear time and without deep recursion.

Scale: edges are made distinct and sums are partially aggregated before each shuffle, so a
hot pattern or instance is a few rows per task; joins on patterns read plain tables, whose
skewed partitions adaptive execution splits; rounds are cut in the shared folder; believed
patterns and instances are broadcast only if counted to be few.

Defined cases: a null text is empty; each row is a document of its own (a repeated row gives
a repeated result); without spans both digests are those of ''; further spans never overlap
base spans, and each is listed once, as the kind of the best score and of equals the first
listed; a neighbour counts by its CONTEXT code points next to the match; very long texts are
scanned whole; an empty table gives an empty table; other columns are not read, whatever
their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordgauge.session import cut

KINDS = ("email", "ip", "card", "phone", "secret")
#: Number of the kind of secrets in spans; in matches, of candidates that are of no kind yet.
SECRET = 4
_LOCAL = "[A-Za-z0-9._%+-]"
#: Of each kind, and of candidate tokens: the pattern, and a test that quickly rules texts out.
PATTERNS = (
    (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    (r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9][\x20-]?[0-9]"),
    (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    (r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+", "[0-9@]"),
)
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"
#: A candidate's edges that are no part of an identifier.
LEAD, TRAIL = "\"'([{<#*$%&!?,;:=.", "\"')]}>#*$%&!?,;:=."
#: Shapes of discovered identifiers by kind: wider than the base patterns.
SHAPES = (r"\A[^@]+@[^@]+\z", r"\A[0-9]{1,3}(?:[.:_-][0-9]{1,3}){3}\z", r"\A[0-9][0-9.-]{11,24}\z", r"\A[+(]?[0-9][0-9().-]{5,20}\z", r"\A(?=.*[0-9])(?=.*[a-z])[a-z0-9+/_=.-]{12,}\z")
#: Lower-cased hex of 32, 40 or 64 digits: seeds of secrets.
DIGEST = r"\A(?=.*[0-9])(?=.*[a-f])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})\z"
CONTEXT, ROUNDS, MIN_SEEDS, WIDE_SEEDS, UNKNOWN, BELIEF, ACCEPT = 48, 6, 3, 10, 0.5, 0.8, 0.9
BROADCAST_PATTERNS = 100_000


def occurrences(text: Column, k: int) -> Column:
    """array<struct<kind,i,gap,before,after,value>>: matches of pattern k and the text before each; a last element without value holds the tail."""
    pattern, quick = PATTERNS[k]
    found = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    rows = F.transform(found, lambda x, i: F.struct(F.lit(k).alias("kind"), i.alias("i"), F.char_length(x["p"]).alias("gap"), F.right(x["p"], F.lit(CONTEXT)).alias("before"), F.left(x["p"], F.lit(CONTEXT)).alias("after"), x["m"].alias("value")))
    return F.when(text.rlike(quick), rows)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check."""

    def worth(d: Column, i: Column) -> Column:
        v = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    each = F.transform(F.split(F.reverse(digits), "", -1), lambda d, i: F.when(d == "", 0).otherwise(worth(d, i)))
    return F.aggregate(each, F.lit(0), lambda a, v: a + v) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    digits = F.translate(value, " -().+", "")
    n = F.char_length(digits)
    card = F.when(n.between(16, 19), luhn(digits)).otherwise(False)
    return F.when(value.isNull(), False).when(kind == 0, True).when(kind == 1, value.rlike(rf"\A{PART}\.{PART}\.{PART}\.{PART}\z")).when(kind == 2, card).when(kind == 3, n.between(8, 15)).otherwise(False)


def word(text: Column, pattern: str, group: int = 1) -> Column:
    """A neighbouring word, lower-cased, digits as 0, marks aside."""
    return F.regexp_replace(F.lower(F.regexp_extract(text, pattern, group)), r"[0-9]", "0")


def word_class(w: Column) -> Column:
    """A word with each run of letters as 'a' and of digits as '0'."""
    return F.regexp_replace(F.regexp_replace(w, r"\p{L}+", "a"), "0+", "0")


def extract(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows (row, doc_id, kind, start, end, good, value, patterns): matches and candidates with the hashes of their patterns, in the order of the docstring; a row of nulls for a text without any."""
    t = F.coalesce(F.col(text), F.lit(""))
    empty = F.array().cast("array<struct<kind:int,i:int,gap:int,before:string,after:string,value:string>>")
    every = F.concat(*[F.coalesce(occurrences(t, k), empty) for k in range(len(PATTERNS))])
    numbered = df.select(F.monotonically_increasing_id().alias("row"), "doc_id", every.alias("every"))
    rows = numbered.select("row", "doc_id", F.explode_outer("every").alias("x")).select("row", "doc_id", "x.*")
    order = Window.partitionBy("row", "kind").orderBy("i")
    gaps = F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0))
    earlier = F.coalesce(F.sum(F.char_length("value")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = rows.select("row", "doc_id", "kind", "value", "before", F.lead("after").over(order).alias("after"), (gaps + earlier).alias("at"), F.row_number().over(order).alias("nth"))
    # a text whose patterns all fail still gives one row: the tail of its first kind
    at = at.filter(F.col("value").isNotNull() | F.col("kind").isNull() | (F.col("nth") == 1))
    candidate = F.col("kind") == 4
    bare = F.ltrim(F.col("value"), F.lit(LEAD))
    shift = F.when(candidate, F.char_length("value") - F.char_length(bare)).otherwise(0)
    value = F.when(candidate, F.rtrim(bare, F.lit(TRAIL))).otherwise(F.col("value"))
    at = at.withColumns({"start": F.col("at") + shift, "value": value})
    at = at.withColumns({"left1": word("before", r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*\z"), "left2": word("before", r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+[^\x20\x09-\x0D]+[\x20\x09-\x0D]*\z"), "right1": word("after", r"\A[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)")})
    has1, has2, has3 = F.col("left1") != "", F.col("left2") != "", F.col("right1") != ""
    patterns = F.array(
        F.when(has1 & has2, F.xxhash64(F.lit(1), "left2", "left1")),
        F.when(has1 & has3, F.xxhash64(F.lit(2), "left1", "right1")),
        F.when(has1, F.xxhash64(F.lit(3), "left1")),
        F.when(has3, F.xxhash64(F.lit(4), "right1")),
        F.when(has1 & has2, F.xxhash64(F.lit(5), word_class(F.col("left2")), word_class(F.col("left1")))),
    )
    return at.select("row", "doc_id", "kind", F.col("start").cast("int").alias("start"), (F.col("start") + F.char_length("value")).cast("int").alias("end"), valid(F.col("kind"), F.col("value")).alias("good"), F.lower("value").alias("value"), patterns.alias("patterns"))


def few(df: DataFrame, rows: int = BROADCAST_PATTERNS) -> DataFrame:
    """`df`, to be broadcast if it is counted to have few rows (of some 20 bytes)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def graph(found: DataFrame, min_seeds: int = MIN_SEEDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct edges (inst, pattern, fit), patterns (pattern, needed, total, open) and seeds (inst, kind).

    Bit k of `fit` says that an instance is no seed and has the shape of kind k; `open[k]`
    counts such instances of a pattern, `total` all."""
    seen = found.filter(f"value is not null and (good or kind = {SECRET})")
    # a group of a seed that is written in groups is no instance of its own
    order, ends = Window.partitionBy("row").orderBy("start"), F.when(F.col("good"), F.col("end"))
    earlier, upto = (F.max(ends).over(order.rangeBetween(Window.unboundedPreceding, k)) for k in (-1, 0))
    part = F.coalesce(earlier >= F.col("end"), F.lit(False)) | F.coalesce(upto > F.col("end"), F.lit(False))
    seen = seen.withColumn("part", part).filter("good or not part")
    seed = F.col("good") | F.col("value").rlike(DIGEST)
    seeds = cut(seen.filter(seed).select(F.xxhash64("value").alias("inst"), "kind").distinct())
    fit = reduce(lambda a, k: a + F.when(F.col("value").rlike(SHAPES[k]), 1 << k).otherwise(0), range(len(KINDS)), F.lit(0))
    edges = seen.select(F.xxhash64("value").alias("inst"), F.when(seed, 0).otherwise(fit).alias("fit"), F.posexplode("patterns").alias("place", "pattern")).filter("pattern is not null")
    # a value may be a base match here and a candidate there
    edges = cut(edges.groupBy("inst", "pattern").agg(F.min("fit").alias("fit"), F.max(F.when(F.col("place") < 2, min_seeds).otherwise(WIDE_SEEDS)).alias("needed")))
    opened = F.array(*[F.sum(F.col("fit").bitwiseAND(1 << k).cast("boolean").cast("long")) for k in range(len(KINDS))])
    # patterns with fewer instances than seeds are needed can't be believed: most go here
    patterns = edges.groupBy("pattern").agg(F.first("needed").alias("needed"), F.count("*").alias("total"), opened.alias("open")).filter("total >= needed")
    patterns = cut(patterns)
    return cut(edges.select("inst", "pattern", "fit").join(few(patterns.select("pattern")), "pattern")), patterns, seeds


def believed_patterns(edges: DataFrame, patterns: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, belief: float = BELIEF) -> DataFrame:
    """(pattern, kind, conf) of the patterns whose instances are mostly of one kind.

    An instance speaks for a kind by its score and against it by the rest, which weighs
    UNKNOWN if it is of no kind yet but has the kind's shape."""
    sure = seeds.withColumn("score", F.lit(1.0))
    known, believed, before = sure, None, None
    opened = F.expr("shiftright(fit, kind) & 1")
    for _ in range(rounds):
        sums = edges.join(known, "inst").groupBy("pattern", "kind").agg(F.sum("score").alias("pos"), F.sum(F.col("score") * opened).alias("pos_open"))
        against = F.col("total") - (1 - UNKNOWN) * F.element_at("open", F.col("kind") + 1) - F.col("pos") + (1 - UNKNOWN) * F.col("pos_open")
        conf = F.col("pos") / (F.col("pos") + F.greatest(against, F.lit(0.0)))
        scored = sums.join(patterns, "pattern").filter(F.col("pos") >= F.col("needed")).select("pattern", "kind", conf.alias("conf"))
        believed = cut(scored.filter(F.col("conf") >= belief))
        now = believed.agg(F.count("*"), F.sum(F.xxhash64("pattern", "kind", F.round("conf", 6)) % 1_000_003)).first()
        if now == before or not now[0]:
            break
        before = now
        known = instances(edges, believed).join(seeds, ["inst", "kind"], "left_anti").unionByName(sure)
    return believed


def instances(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """(inst, kind, score) of the instances that the patterns extract: noisy or."""
    doubt = F.sum(F.log(1 - F.least(F.col("conf"), F.lit(0.999))))
    return edges.join(few(patterns), "pattern").groupBy("inst", "kind").agg((1 - F.exp(doubt)).alias("score"))


def discover(found: DataFrame, edges: DataFrame, patterns: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(row, kind, start, end) of the candidates whose value is a believed instance of a kind that its shape fits."""
    taken = few(cut(instances(edges, patterns).filter(F.col("score") >= accept)))
    candidates = found.filter(f"kind = {SECRET} and value <> ''").select("row", "start", "end", "value", F.xxhash64("value").alias("inst"))
    fits = reduce(lambda a, k: a | ((F.col("kind") == k) & F.col("value").rlike(SHAPES[k])), range(len(KINDS)), F.lit(False))
    best = F.max(F.struct("score", (-F.col("kind")).alias("order")))
    hit = candidates.join(taken, "inst").filter(fits).groupBy("row", "start", "end").agg(best.alias("best"))
    return hit.select("row", (-F.col("best.order")).cast("int").alias("kind"), "start", "end")


def find_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, base, more): sorted arrays of struct<kind,start,end> of each row of `df`; kind is a place in KINDS."""
    found = cut(extract(df, text))
    edges, patterns, seeds = graph(found)
    extra = discover(found, edges, believed_patterns(edges, patterns, seeds))
    span = F.struct("kind", "start", "end")
    rows = found.select("row", "doc_id", F.when(F.col("good"), span).alias("base"), F.lit(None).cast("struct<kind:int,start:int,end:int>").alias("more"))
    rows = rows.unionByName(extra.select("row", F.lit(None).cast(found.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("struct<kind:int,start:int,end:int>").alias("base"), span.alias("more")))
    by = rows.groupBy("row").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.sort_array(F.collect_list("base")).alias("base"), F.collect_list("more").alias("more"))
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return by.select("doc_id", "base", F.sort_array(apart).alias("more"))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def op2(documents: DataFrame) -> DataFrame:
    found = find_pii(documents.select("doc_id", "text"))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS) if k != SECRET]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.sort_array(F.concat("base", "more"))).alias("spans"), F.size("more").cast("long").alias("n_discovered"))


def brute(text: str | None) -> list[tuple[str, int, int]]:
    """The base spans of a text by Python's patterns: for tests."""
    import re

    t, out = text or "", []
    for kind, p in zip(KINDS[:SECRET], (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"), strict=True):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
                if not 16 <= len(d) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out
