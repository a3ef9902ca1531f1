"""The registered queries over the driver's tables and their DuckDB twins.

Gold and predicted records are derived inside each query by arithmetic that both engines
share: a report is an order, a finding is one of its line items.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordgauge.functions import dates, equality, fields, jsonx, nulls, schema, slots, text
from recordgauge.operators import audits, bootstrap, decoder, generation, matching, metrics, reports, scoring
from recordgauge.session import table
from recordgauge.sources import readers

ITERATIONS = 200
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def as_long(sql: str) -> str:
    """The SQL with each count_if(...) cast to BIGINT: DuckDB counts conditions in HUGEINT."""
    out, at = [], 0
    while (k := sql.find("count_if(", at)) >= 0:
        end, depth = k + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out.append(f"{sql[at:k]}CAST({sql[k:end]} AS BIGINT)")
        at = end
    return "".join(out) + sql[at:]


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = as_long(sql)
        return f

    return add


def load() -> None:
    """The other modules of queries register themselves when imported."""
    from recordgauge.plans import pipelines, records, storage  # noqa: F401


def queries() -> dict:
    load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(ORACLES)


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- scalar semantics -------------------------------------------------------------------


@register(
    "null_prune_counts",
    """
    WITH v AS (SELECT lang, CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'null' WHEN 2 THEN ' None ' WHEN 3 THEN 'N/A' WHEN 4 THEN 'absent' WHEN 5 THEN '0' WHEN 6 THEN NULL ELSE lang END AS v FROM documents)
    SELECT lang, count(*) AS n, count_if(v IS NULL OR lower(trim(v)) IN ('', 'null', 'none', 'n/a')) AS n_null,
      CAST(sum(CASE WHEN v IS NULL OR lower(trim(v)) IN ('', 'null', 'none', 'n/a') THEN 1 ELSE 2 END) AS BIGINT) AS kept_keys,
      count_if(v IS NULL OR lower(trim(v)) IN ('', 'null', 'none', 'n/a')) AS pruned_structs
    FROM v GROUP BY lang""",
)
def null_prune_counts(spark: SparkSession, d: str) -> DataFrame:
    """Semantic nulls, one-level cleaning of maps and recursive pruning of structs."""
    k = F.col("doc_id") % 8
    v = F.when(k == 0, "").when(k == 1, "null").when(k == 2, " None ").when(k == 3, "N/A").when(k == 4, "absent").when(k == 5, "0").when(k == 6, None).otherwise(F.col("lang"))
    rows = table(spark, d, "documents").select("lang", v.alias("v"))
    rows = rows.select("lang", "v", nulls.clean_map(F.create_map(F.lit("a"), F.col("v"), F.lit("b"), F.lit("kept"))).alias("m"), F.struct(F.struct("v").alias("inner"), F.array("v").alias("list")).alias("s"))
    pruned = nulls.prune(F.col("s"), rows.schema["s"].dataType)
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(nulls.is_null(F.col("v"))).alias("n_null"), F.sum(F.size("m")).alias("kept_keys"), F.count_if(pruned.isNull()).alias("pruned_structs"))


@register(
    "date_keys",
    r"""
    WITH t AS (SELECT CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%-m/%-d/%y') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN strftime(o_orderdate, '%-m/%Y')
      WHEN 3 THEN strftime(o_orderdate, '%Y') WHEN 4 THEN '2/29/' || strftime(o_orderdate, '%Y') ELSE '13/1/' || strftime(o_orderdate, '%Y') END AS s FROM orders),
    p AS (SELECT s, string_split(s, '/') AS a FROM t),
    k AS (SELECT s, CASE WHEN len(a) = 3 THEN 'day' WHEN len(a) = 2 THEN 'month' ELSE 'year' END AS precision,
      CASE WHEN length(a[-1]) = 2 THEN CASE WHEN CAST(a[-1] AS INT) <= 68 THEN 2000 ELSE 1900 END + CAST(a[-1] AS INT) ELSE CAST(a[-1] AS INT) END AS y,
      CASE WHEN len(a) > 1 THEN CAST(a[1] AS INT) END AS m, CASE WHEN len(a) = 3 THEN CAST(a[2] AS INT) END AS d FROM p),
    g AS (SELECT *, precision <> 'day' OR try_cast(printf('%04d-%02d-%02d', y, m, d) AS DATE) IS NOT NULL AS good FROM k)
    SELECT CASE WHEN good THEN precision ELSE 'none' END AS precision, count(*) AS n, CAST(coalesce(sum(CASE WHEN good THEN y END), 0) AS BIGINT) AS sum_y, CAST(coalesce(sum(CASE WHEN good THEN m END), 0) AS BIGINT) AS sum_m, CAST(coalesce(sum(CASE WHEN good THEN d END), 0) AS BIGINT) AS sum_d
    FROM g GROUP BY 1""",
)
def date_keys(spark: SparkSession, d: str) -> DataFrame:
    """Precision-preserving keys of rendered dates, impossible ones among them."""
    o, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    year = F.date_format(o, "yyyy")
    s = F.when(k == 0, F.date_format(o, "M/d/yy")).when(k == 1, F.date_format(o, "MM/dd/yyyy")).when(k == 2, F.date_format(o, "M/yyyy")).when(k == 3, year).when(k == 4, F.concat(F.lit("2/29/"), year)).otherwise(F.concat(F.lit("13/1/"), year))
    keys = table(spark, d, "orders").select(s.alias("s")).select(dates.date_key(F.col("s")).alias("k"))
    return keys.groupBy(F.coalesce("k.precision", F.lit("none")).alias("precision")).agg(F.count("*").alias("n"), F.coalesce(F.sum("k.y"), F.lit(0)).alias("sum_y"), F.coalesce(F.sum("k.m"), F.lit(0)).alias("sum_m"), F.coalesce(F.sum("k.d"), F.lit(0)).alias("sum_d"))


def arms(spark: SparkSession, d: str) -> DataFrame:
    """Line items with the predicted values beside the gold ones."""
    x = table(spark, d, "lineitem")
    return x.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice", "l_shipdate",
        (F.col("l_quantity") + F.when(F.col("l_partkey") % 5 == 0, 1.0).otherwise(0.0)).alias("p_quantity"),
        (F.col("l_discount") + F.when(F.col("l_suppkey") % 3 == 0, 0.005).otherwise(0.0)).alias("p_discount"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax")).alias("p_tax"),
        F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit(" "), F.lower("l_returnflag"), F.lit(" "))).otherwise(F.col("l_returnflag")).alias("p_returnflag"),
    )


SQL_ARMS = """
    SELECT *, l_quantity + CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END AS p_quantity, l_discount + CASE WHEN l_suppkey % 3 = 0 THEN 0.005::DOUBLE ELSE 0::DOUBLE END AS p_discount,
      CASE WHEN l_orderkey % 7 <> 0 THEN l_tax END AS p_tax, CASE WHEN l_suppkey % 2 = 0 THEN ' ' || lower(l_returnflag) || ' ' ELSE l_returnflag END AS p_returnflag FROM lineitem"""
FIELDS = ("quantity", "discount", "tax", "returnflag")


def equal(name: str, g: Column | None = None, p: Column | None = None) -> Column:
    g, p = g if g is not None else F.col(f"l_{name}"), p if p is not None else F.col(f"p_{name}")
    if name == "returnflag":
        return F.lower(text.collapse_ws(g)).eqNullSafe(F.lower(text.collapse_ws(p)))
    return equality.numbers_equal(g, p)


def sql_equal(name: str, g: str = "", p: str = "") -> str:
    g, p = g or f"l_{name}", p or f"p_{name}"
    if name == "returnflag":
        return f"(lower(trim({g})) IS NOT DISTINCT FROM lower(trim({p})))"
    return f"(CASE WHEN {g} IS NULL AND {p} IS NULL THEN true WHEN {g} IS NULL OR {p} IS NULL THEN false ELSE abs({g} - {p}) <= 0.01 END)"


@register("tolerant_equality", f"SELECT l_returnflag, count(*) AS n, {', '.join(f'count_if({sql_equal(f)}) AS equal_{f}' for f in FIELDS)} FROM ({SQL_ARMS}) GROUP BY l_returnflag")
def tolerant_equality(spark: SparkSession, d: str) -> DataFrame:
    """Numeric tolerance, white space and case, one-sided nulls; values as text take the general rule."""
    x = arms(spark, d)
    general = {f: equality.values_equal(F.col(f"l_{f}").cast("string"), F.col(f"p_{f}").cast("string"), f) for f in ("returnflag",)}
    return x.groupBy("l_returnflag").agg(F.count("*").alias("n"), *[F.count_if(general.get(f, equal(f))).alias(f"equal_{f}") for f in FIELDS])


def four_fields() -> list[tuple[str, Column, Column, Column]]:
    return [(f, F.col(f"l_{f}").isNotNull(), F.col(f"p_{f}").isNotNull(), equal(f)) for f in FIELDS]


def sql_events(source: str, keep: str = "") -> str:
    parts = []
    for f in FIELDS:
        g, p, e = f"l_{f} IS NOT NULL", f"p_{f} IS NOT NULL", sql_equal(f)
        parts.append(f"SELECT {keep}'{f}' AS feature, ({g})::INT AS s, ({g} AND {p} AND {e})::INT AS tp, ({p} AND NOT ({g} AND {p} AND {e}))::INT AS fp, ({g} AND NOT ({g} AND {p} AND {e}))::INT AS fn FROM ({source})")
    return " UNION ALL ".join(parts)


@register(
    "scalar_feature_scores",
    f"""
    WITH e AS ({sql_events(SQL_ARMS)} UNION ALL SELECT 'comment', 0, 0, 0, 0),
    s AS (SELECT feature, CAST(sum(s) AS BIGINT) AS gold_appearances, CAST(sum(tp) AS BIGINT) AS "TP", CAST(sum(fp) AS BIGINT) AS "FP", CAST(sum(fn) AS BIGINT) AS "FN" FROM e GROUP BY feature)
    SELECT *, round(coalesce("TP" / nullif("TP" + "FP", 0), 0), 6) AS precision, round(coalesce("TP" / nullif("TP" + "FN", 0), 0), 6) AS recall, round(coalesce(2 * "TP" / nullif(2 * "TP" + "FP" + "FN", 0), 0), 6) AS f1 FROM s""",
)
def scalar_feature_scores(spark: SparkSession, d: str) -> DataFrame:
    """Exact scores by feature; a feature without events appears too."""
    events = scoring.feature_events(arms(spark, d), four_fields(), [])
    done = scoring.feature_scores(events, readers.features(spark, [*FIELDS, "comment"]))
    return done.select("feature", "gold_appearances", "TP", "FP", "FN", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


# --- matching ---------------------------------------------------------------------------

ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax")


def positioned(x: DataFrame) -> DataFrame:
    return x.withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)).cast("long"))


SQL_POS = f"SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}) AS pos FROM ({SQL_ARMS})"
SQL_MATCH = f"""
    WITH x AS ({SQL_POS}),
    g AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY pos) AS rk FROM x),
    p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY pos) AS rk FROM x WHERE l_partkey % 6 <> 0),
    m AS (SELECT g.l_orderkey, g.pos AS gold_pos, p.pos AS pred_pos FROM g JOIN p USING (l_orderkey, l_linenumber, rk))"""


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = positioned(arms(spark, d))
    return x, x.filter(F.col("l_partkey") % 6 != 0)


@register(
    "direct_key_match",
    f"{SQL_MATCH} SELECT l_orderkey, count(*) AS n, CAST(sum(gold_pos) AS BIGINT) AS gold_sum, CAST(sum(pred_pos) AS BIGINT) AS pred_sum, CAST(sum(gold_pos * pred_pos) AS BIGINT) AS cross_sum FROM m GROUP BY l_orderkey",
)
def direct_key_match(spark: SparkSession, d: str) -> DataFrame:
    """The first unused prediction of equal key, by rank join."""
    gold, pred = sides(spark, d)
    m = matching.key_matches(gold, pred, ["l_orderkey"], ["l_linenumber"], "pos")
    return m.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("gold_pos").alias("gold_sum"), F.sum("pred_pos").alias("pred_sum"), F.sum(F.col("gold_pos") * F.col("pred_pos")).alias("cross_sum"))


@register(
    "partial_key_match",
    """
    WITH x AS (SELECT l_orderkey, CASE WHEN l_suppkey % 4 <> 0 THEN l_linenumber END AS a, CASE WHEN l_suppkey % 3 <> 0 THEN l_quantity END AS b, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) AS pos FROM lineitem),
    g AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, a, b ORDER BY pos) AS rk FROM x WHERE a IS NOT NULL OR b IS NOT NULL),
    p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, a, b ORDER BY pos) AS rk FROM x WHERE l_partkey % 6 <> 0 AND (a IS NOT NULL OR b IS NOT NULL))
    SELECT g.l_orderkey, count(*) AS n, CAST(sum(g.pos * p.pos) AS BIGINT) AS cross_sum FROM g JOIN p ON g.l_orderkey = p.l_orderkey AND g.a IS NOT DISTINCT FROM p.a AND g.b IS NOT DISTINCT FROM p.b AND g.rk = p.rk GROUP BY g.l_orderkey""",
)
def partial_key_match(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the parts that are present; the same parts must be present on both sides."""
    x = positioned(table(spark, d, "lineitem"))
    x = x.select("l_orderkey", "pos", "l_partkey", F.when(F.col("l_suppkey") % 4 != 0, F.col("l_linenumber")).alias("a"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_quantity")).alias("b"))
    x = x.filter("a is not null or b is not null")
    m = matching.key_matches(x, x.filter(F.col("l_partkey") % 6 != 0), ["l_orderkey"], ["a", "b"], "pos", complete=False)
    return m.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("gold_pos") * F.col("pred_pos")).alias("cross_sum"))


WEIGHTS = {"quantity": 10.0, "discount": 4.0, "tax": 3.0, "returnflag": 2.0}


def similarity(g, p) -> Column:
    return matching.weighted_similarity([(g(f"l_{f}").isNotNull(), equal(f, g(f"l_{f}"), p(f"p_{f}")), w) for f, w in WEIGHTS.items()])


_SQL_SIM = "(" + " + ".join(f"CASE WHEN g.l_{f} IS NOT NULL AND {sql_equal(f, f'g.l_{f}', f'p.p_{f}')} THEN {w} ELSE 0 END" for f, w in WEIGHTS.items()) + ") / nullif(" + " + ".join(f"CASE WHEN g.l_{f} IS NOT NULL THEN {w} ELSE 0 END" for f, w in WEIGHTS.items()) + ", 0)"


@register("similarity_pairs", f"WITH x AS ({SQL_ARMS}) SELECT g.l_orderkey, count(*) AS n, round(sum(coalesce(CAST({_SQL_SIM} AS DOUBLE), 0)), 6) AS total, round(max(coalesce(CAST({_SQL_SIM} AS DOUBLE), 0)), 6) AS best FROM x g JOIN x p ON g.l_orderkey = p.l_orderkey AND g.l_linenumber <> p.l_linenumber GROUP BY g.l_orderkey")
def similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Weighted similarity of the findings of a report."""
    x = arms(spark, d)
    g = x.select("l_orderkey", "l_linenumber", *[F.col(f"l_{f}").alias(f"g_l_{f}") for f in FIELDS])
    p = x.select("l_orderkey", F.col("l_linenumber").alias("other"), *[F.col(f"p_{f}").alias(f"p_p_{f}") for f in FIELDS])
    s = similarity(lambda c: F.col(f"g_{c}"), lambda c: F.col(f"p_{c}"))
    pairs = g.join(p, "l_orderkey").filter(F.col("l_linenumber") != F.col("other"))
    return pairs.groupBy("l_orderkey").agg(F.count("*").alias("n"), r6(F.sum(s)).alias("total"), r6(F.max(s)).alias("best"))


@register("assignment_scores")
def assignment_scores(spark: SparkSession, d: str) -> DataFrame:
    """Both phases over the turns of a conversation, then partial-credit scores."""
    x = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), "role", F.char_length("text").alias("size"), F.sha2("text", 256).alias("digest"))
    gold = x.withColumn("key", F.when(F.col("pos") % 3 == 0, F.col("pos")))
    pred = x.select("conv_id", "pos", F.when(F.col("pos") % 5 != 4, F.col("role")).alias("role"), (F.col("size") + F.when(F.col("pos") % 2 == 0, 1).otherwise(0)).alias("size"), "digest").withColumn("key", F.when(F.col("pos") % 3 == 0, F.col("pos")))
    names = {"role": 4.0, "size": 3.0, "digest": 2.0}

    def sim(g, p):
        return matching.weighted_similarity([(g(f).isNotNull(), g(f).eqNullSafe(p(f)), w) for f, w in names.items()])

    m = matching.align(gold, pred, ["conv_id"], ["key"], "pos", sim)
    g = gold.select("conv_id", F.col("pos").alias("gold_pos"), *[F.col(f).alias(f"g_{f}") for f in names])
    p = pred.select("conv_id", F.col("pos").alias("pred_pos"), *[F.col(f).alias(f"p_{f}") for f in names])
    rows = m.join(g, ["conv_id", "gold_pos"], "full").join(p, ["conv_id", "pred_pos"], "full")
    parts = scoring.total([scoring.partial_credit(F.col(f"g_{f}").isNotNull(), F.col(f"p_{f}").isNotNull(), F.col(f"g_{f}").eqNullSafe(F.col(f"p_{f}"))) for f in names])
    scored = scoring.case_scores(rows.select("conv_id", *[v.alias(k) for k, v in parts.items()]), ["conv_id"])
    return scored.select("conv_id", "tp", "fp", "fn", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "iou")])


def _sql_credit(g: str, p: str, e: str) -> tuple[str, str, str]:
    return (
        f"CASE WHEN {g} AND {p} THEN CASE WHEN {e} THEN 2.0 ELSE 1.0 END ELSE 0 END",
        f"CASE WHEN {g} AND {p} AND NOT {e} THEN 0.5 WHEN {p} AND NOT {g} THEN 2.0 ELSE 0 END",
        f"CASE WHEN {g} AND {p} AND NOT {e} THEN 0.5 WHEN {g} AND NOT {p} THEN 2.0 ELSE 0 END",
    )


_CREDITS = [_sql_credit(f"(g.l_{f} IS NOT NULL)", f"(p.p_{f} IS NOT NULL)", sql_equal(f, f"g.l_{f}", f"p.p_{f}")) for f in FIELDS]
_SQL_CREDIT = ", ".join(f"CAST({' + '.join(c[k] for c in _CREDITS)} AS DOUBLE) AS {n}" for k, n in enumerate(("tp", "fp", "fn")))


@register(
    "casewise_micro",
    f"""{SQL_MATCH}, rows AS (SELECT {_SQL_CREDIT} FROM g FULL JOIN p USING (l_orderkey, l_linenumber, rk)),
    s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM rows)
    SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp + fn), 6) AS iou FROM s""",
)
def casewise_micro(spark: SparkSession, d: str) -> DataFrame:
    """A1-A3: partial credit over matches and remainders, by case, then over all cases."""
    gold, pred = sides(spark, d)
    keys = ["l_orderkey", "l_linenumber", "__rank"]
    g = matching.ranked(gold, ["l_orderkey"], ["l_linenumber"], "pos").select(*keys, *[F.col(f"l_{f}").alias(f"g_{f}") for f in FIELDS])
    p = matching.ranked(pred, ["l_orderkey"], ["l_linenumber"], "pos").select(*keys, *[F.col(f"p_{f}").alias(f"q_{f}") for f in FIELDS])
    both = g.join(p, keys, "full")
    parts = scoring.total([scoring.partial_credit(F.col(f"g_{f}").isNotNull(), F.col(f"q_{f}").isNotNull(), equal(f, F.col(f"g_{f}"), F.col(f"q_{f}"))) for f in FIELDS])
    cases = scoring.case_scores(both.select("l_orderkey", *[v.alias(k) for k, v in parts.items()]), ["l_orderkey"])
    return scoring.micro(cases).select("tp", "fp", "fn", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "iou")])


# --- metrics ----------------------------------------------------------------------------


def label_events(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents: source as feature, lang as model; two arms of predictions of `quality`."""
    x = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    g = F.col("quality") == 1
    one = {"a": F.col("toxic") == 1, "b": F.col("n_chars") > 1000}
    out = [scoring.exact(g, p, F.lit(True)) for p in one.values()]
    return x.select("doc_id", "lang", F.col("source").alias("feature"), "quality", *[v.alias(f"{k}_{a}") for a, s in zip(one, out, strict=True) for k, v in s.items()])


SQL_LABELS = """
    SELECT l.doc_id, lang, source AS feature, quality, (quality = 1)::INT AS g,
      (quality = 1 AND toxic = 1)::INT AS tp_a, (quality <> 1 AND toxic = 1)::INT AS fp_a, (quality = 1 AND toxic <> 1)::INT AS fn_a,
      (quality = 1 AND n_chars > 1000)::INT AS tp_b, (quality <> 1 AND n_chars > 1000)::INT AS fp_b, (quality = 1 AND NOT n_chars > 1000)::INT AS fn_b
    FROM documents JOIN labels l USING (doc_id)"""


def sql_features(arm: str, by: str = "feature") -> str:
    return f"""SELECT {by}, CAST(sum(g) AS BIGINT) AS gold_appearances, CAST(sum(tp_{arm}) AS BIGINT) AS tp, CAST(sum(fp_{arm}) AS BIGINT) AS fp, CAST(sum(fn_{arm}) AS BIGINT) AS fn,
      coalesce(sum(tp_{arm}) / nullif(sum(tp_{arm}) + sum(fp_{arm}), 0), 0) AS precision, coalesce(sum(tp_{arm}) / nullif(sum(tp_{arm}) + sum(fn_{arm}), 0), 0) AS recall,
      coalesce(2 * sum(tp_{arm}) / nullif(2 * sum(tp_{arm}) + sum(fp_{arm}) + sum(fn_{arm}), 0), 0) AS f1 FROM ({SQL_LABELS}) GROUP BY {by}"""


def arm_features(events: DataFrame, arm: str, by: list[str]) -> DataFrame:
    sums = events.groupBy(*by).agg(*[F.sum(f"{c}_{arm}").alias(c) for c in ("gold_appearances", "TP", "FP", "FN")])
    r = scoring.ratios(F.col("TP"), F.col("FP"), F.col("FN"))
    return sums.select("*", *[r[k].alias(k) for k in ("precision", "recall", "f1")])


@register(
    "micro_macro_weighted",
    f"""WITH f AS ({sql_features("a", "lang, feature")}) SELECT lang, CAST(sum(tp) AS BIGINT) AS "TP", CAST(sum(fp) AS BIGINT) AS "FP", CAST(sum(fn) AS BIGINT) AS "FN", round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
      round(coalesce(sum(f1 * gold_appearances) / nullif(sum(gold_appearances), 0), 0), 6) AS weighted_f1, count(*) AS n_features, CAST(sum(CASE WHEN gold_appearances = 0 THEN fp ELSE 0 END) AS BIGINT) AS zero_support_fp, round(coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0), 6) AS micro_f1 FROM f GROUP BY lang""",
)
def micro_macro_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Micro, macro and support-weighted means by model."""
    done = metrics.summary(arm_features(label_events(spark, d), "a", ["lang", "feature"]), ["lang"])
    return done.select("lang", "TP", "FP", "FN", *[r6(c).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1", "weighted_f1")], "n_features", "zero_support_fp", r6("micro_f1").alias("micro_f1"))


@register(
    "supported_metrics",
    f"""WITH f AS ({sql_features("b", "lang, feature")}) SELECT lang, count(*) AS n_features, round(avg(f1), 6) AS macro_f1, round(coalesce(sum(f1 * gold_appearances) / nullif(sum(gold_appearances), 0), 0), 6) AS weighted_f1, round(coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0), 6) AS micro_f1 FROM f WHERE gold_appearances > 0 GROUP BY lang""",
)
def supported_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The supported universe only."""
    done = metrics.summary(arm_features(label_events(spark, d), "b", ["lang", "feature"]), ["lang"], "supported")
    return done.select("lang", "n_features", *[r6(c).alias(c) for c in ("macro_f1", "weighted_f1", "micro_f1")])


@register(
    "paired_delta_topk",
    f"""WITH a AS ({sql_features("a")}), b AS ({sql_features("b")}),
    c AS (SELECT feature, round(a.f1, 6) AS f1_a, round(b.f1, 6) AS f1_b, b.f1 - a.f1 AS delta, CASE WHEN a.f1 <> 0 THEN 100 * (b.f1 - a.f1) / a.f1 END AS rel FROM a JOIN b USING (feature))
    SELECT feature, f1_a, f1_b, round(delta, 6) AS delta, round(100 * delta, 6) AS points, round(rel, 6) AS relative_pct, CASE WHEN delta > 1e-12 THEN 'improved' WHEN delta < -1e-12 THEN 'worsened' ELSE 'unchanged' END AS label FROM c WHERE round(delta, 9) > 0 ORDER BY round(delta, 9) DESC, feature LIMIT 10""",
)
def paired_delta_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten features that gain most, ties by name."""
    e = label_events(spark, d)
    c = metrics.compare_features(arm_features(e, "a", ["feature"]), arm_features(e, "b", ["feature"]))
    top = reports.top_changes(c.withColumn("by", F.round("delta", 9)), 10, "by")
    return top.select("feature", *[r6(x).alias(x) for x in ("f1_a", "f1_b", "delta", "points", "relative_pct")], "label")


@register(
    "largest_changes",
    f"""WITH a AS ({sql_features("a")}), b AS ({sql_features("b")}) SELECT feature, round(b.f1 - a.f1, 6) AS delta FROM a JOIN b USING (feature) ORDER BY abs(round(b.f1 - a.f1, 9)) DESC, feature LIMIT 20""",
)
def largest_changes(spark: SparkSession, d: str) -> DataFrame:
    """O3: the twenty greatest absolute changes."""
    e = label_events(spark, d)
    c = metrics.compare_features(arm_features(e, "a", ["feature"]), arm_features(e, "b", ["feature"]))
    return reports.top_changes(c.withColumn("by", F.round("delta", 9)), 20, "by", which="absolute").select("feature", r6("delta").alias("delta"))


@register(
    "token_stats_nearest_rank",
    """SELECT lang, CAST(sum(n_chars) AS BIGINT) AS total, round(avg(n_chars), 6) AS mean, round(median(n_chars), 6) AS median, min(n_chars) AS min, max(n_chars) AS max, count(n_chars) AS n, list_sort(list(n_chars))[CAST(round_even((count(*) - 1) * 0.95, 0) AS INT) + 1] AS p95 FROM documents GROUP BY lang""",
)
def token_stats_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank P95 with a half-even index, from value frequencies."""
    s = metrics.token_stats(table(spark, d, "documents").select("lang", "n_chars"), ["lang"], "n_chars")
    return s.withColumns({"mean": r6("mean"), "median": r6("median")})


@register(
    "token_stats_linear",
    """SELECT lang, min(n_chars) AS min, round(avg(n_chars), 6) AS mean, round(median(n_chars), 6) AS median, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.95), 6) AS p95, round(quantile_cont(n_chars, 0.99), 6) AS p99, max(n_chars) AS max FROM documents GROUP BY lang""",
)
def token_stats_linear(spark: SparkSession, d: str) -> DataFrame:
    """Linear percentiles."""
    s = metrics.length_stats(table(spark, d, "documents"), ["lang"], "n_chars")
    return s.withColumns({c: r6(c) for c in ("mean", "median", "p90", "p95", "p99")})


@register(
    "context_recommendation",
    """WITH s AS (SELECT source, max(n_chars) AS max_prompt, max(length(lang) * 700) AS max_gold FROM documents GROUP BY source)
    SELECT *, CAST(ceil((max_prompt + 1536 + 128) / 256) * 256 AS BIGINT) AS recommended, ceil((max_prompt + 1536 + 128) / 256) * 256 BETWEEN 1 AND 9999999 AS plausible, ceil((max_prompt + 1536 + 128) / 256) * 256 <= 8192 AS fits_native, max_gold <= 1536 AS cap_covers_gold FROM s""",
)
def context_recommendation(spark: SparkSession, d: str) -> DataFrame:
    """A19, M-1, M-2: the context a source needs."""
    x = table(spark, d, "documents").select("source", "n_chars", (F.char_length("lang") * 700).cast("long").alias("gold"))
    return metrics.recommend_context(x, ["source"], "n_chars", "gold", 1536, 128, 256, 8192)


# --- JSON, records and validation -------------------------------------------------------


@register("flatten_json", """SELECT event_type, count(*) AS n, CAST(sum(CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS k_sum, count_if(props ->> '$.absent.x' IS NULL) AS absent FROM events GROUP BY event_type""")
def flatten_json(spark: SparkSession, d: str) -> DataFrame:
    """Dotted paths of JSON text, and structs flattened to columns."""
    v = table(spark, d, "events").select("event_type", F.from_json("props", "k bigint").alias("props"), F.get_json_object("props", "$.absent.x").alias("x"))
    flat = reports.flatten_columns(v)
    return flat.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("`props.k`").alias("k_sum"), F.count_if(F.col("x").isNull()).alias("absent"))


def noisy(spark: SparkSession, d: str) -> DataFrame:
    """Customers as noisy record texts, with what they should parse to."""
    k = F.col("c_custkey")
    body = F.concat(F.lit('{"Number of Nodules": "'), (k % 3).cast("string"), F.lit('", "Overall Lung-RADS": '), F.when(k % 2 == 0, '" none "').otherwise('"2"'), F.lit(', "Nodules": []}'))
    raw = F.when(k % 5 == 0, F.concat(F.lit("<json>"), body, F.lit("</json>"))).when(k % 5 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n``` done"))).when(k % 5 == 2, F.concat(F.lit("so: "), body, F.lit(" ok"))).when(k % 5 == 3, F.substring(body, F.lit(1), F.char_length(body) - 4)).otherwise(body)
    return table(spark, d, "customer").select("c_custkey", raw.alias("raw"))


@register(
    "json_recovery",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 3 THEN '{}' ELSE '{' || array_to_string(list_filter([CASE WHEN c_custkey % 3 <> 0 THEN '"Number of Nodules":' || (c_custkey % 3) END, CASE WHEN c_custkey % 2 = 1 THEN '"Overall Lung-RADS":"2"' END], lambda x: x IS NOT NULL), ',') || '}' END AS record,
      c_custkey % 5 <> 3 AS parsed FROM customer""",
)
def json_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Objects from tags, fences and prose; pruned, coerced, count zero dropped."""
    return noisy(spark, d).select("c_custkey", jsonx.normalise_json(F.col("raw")).alias("record"), jsonx.payload_json(F.col("raw")).isNotNull().alias("parsed"))


FLAT_SCHEMA = {
    "properties": {
        "c_nationkey": {"type": "integer", "minimum": 0, "maximum": 20},
        "c_acctbal": {"anyOf": [{"type": "number", "minimum": 0}, {"type": "null"}]},
        "c_mktsegment": {"type": "string", "enum": ["BUILDING", "MACHINERY", "AUTOMOBILE"]},
        "c_name": {"type": "string", "pattern": "[A-Za-z]+#[0-9]*[02468]"},
    }
}


@register(
    "schema_validate_flat",
    r"""WITH f AS (SELECT c_custkey, (NOT c_nationkey BETWEEN 0 AND 20)::INT + (c_acctbal < 0)::INT + (c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE'))::INT + (NOT regexp_full_match(c_name, '[A-Za-z]+#[0-9]*[02468]'))::INT AS n FROM customer)
    SELECT CAST(n AS INT) AS faults, count(*) AS customers FROM f GROUP BY n""",
)
def schema_validate_flat(spark: SparkSession, d: str) -> DataFrame:
    """V1 on flat records, in generated code."""
    n = schema.flat_faults({c: F.col(c) for c in FLAT_SCHEMA["properties"]}, FLAT_SCHEMA)
    return table(spark, d, "customer").groupBy(n.cast("int").alias("faults")).agg(F.count("*").alias("customers"))


# --- text -------------------------------------------------------------------------------


def _phrases(marks: tuple[str, ...]) -> str:
    return ". ".join(marks)


_SQL_INSTRUCTION = f"CASE doc_id % 4 WHEN 0 THEN '{_phrases(fields.SPARSE_MARKS)}' WHEN 1 THEN '{_phrases(fields.DENSE_MARKS)}' WHEN 2 THEN '{_phrases(fields.SPARSE_MARKS)} {_phrases(fields.DENSE_MARKS)}' ELSE '' END || ' ' || lang"


@register(
    "policy_classify",
    f"""SELECT source, count(*) AS records, count_if(doc_id % 4 = 0) AS sparse_omit_null, count_if(doc_id % 4 = 1) AS dense_nullable, count_if(doc_id % 4 = 2) AS conflicting_sparse_and_dense, count_if(doc_id % 4 = 3) AS unrecognized, count(DISTINCT sha256({_SQL_INSTRUCTION})) AS unique_instructions FROM documents GROUP BY source""",
)
def policy_classify(spark: SparkSession, d: str) -> DataFrame:
    """T-13, T-14, A21: instruction policies and distinct digests."""
    k = F.col("doc_id") % 4
    s, p = _phrases(fields.SPARSE_MARKS), _phrases(fields.DENSE_MARKS)
    t = F.concat(F.when(k == 0, s).when(k == 1, p).when(k == 2, f"{s} {p}").otherwise(""), F.lit(" "), F.col("lang"))
    return metrics.instruction_summary(table(spark, d, "documents").select("source", t.alias("t")), "t", ["source"])


@register(
    "literal_rewrite_once",
    """SELECT conv_id, turn, role, CASE WHEN turn % 3 = 1 THEN sha256(text || ' [dense]') WHEN turn % 3 = 0 AND conv_id % 2 = 0 THEN sha256(text || ' [dense]') END AS sha FROM conversations""",
)
def literal_rewrite_once(spark: SparkSession, d: str) -> DataFrame:
    """T-15: a phrase that occurs once is replaced; rewritten texts stay; others give null."""
    k = F.col("turn") % 3
    t = F.concat("text", F.when(k == 1, " [sparse]").when(k == 2, " [sparse] [sparse]").when(F.col("conv_id") % 2 == 0, " [dense]").otherwise(""))
    new = text.rewrite_once(t, [("[sparse]", "[dense]")], forbidden=("[sparse]",), required=("[dense]",), strict=False)
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.sha2(new, 256).alias("sha"))


@register(
    "chat_text",
    """SELECT conv_id, turn, role, sha256(trim(CASE WHEN turn % 2 = 0 THEN ' ' || role || ' ' ELSE '' END) || CASE WHEN turn % 3 = 0 THEN '' ELSE chr(10) || chr(10) || 'x' || turn END) AS sha, coalesce(NULL, CAST(conv_id AS VARCHAR)) AS case_id FROM conversations""",
)
def chat_text(spark: SparkSession, d: str) -> DataFrame:
    """Instruction and input as one text; the case's id."""
    x = table(spark, d, "conversations")
    t = text.user_text(F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" "), "role", F.lit(" "))), F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.concat(F.lit(" x"), F.col("turn").cast("string"))))
    return x.select("conv_id", "turn", "role", F.sha2(t, 256).alias("sha"), text.case_id(["ID", "case_id", "conv_id"], x.columns, F.col("turn")).alias("case_id"))


def ladder(spark: SparkSession, d: str) -> DataFrame:
    """Pages with an id value and a text that holds it in one form or another."""
    n, k = F.regexp_extract("url", r"/([0-9]+)", 1), F.col("page_id") % 8
    value = F.when(k == 0, n).when(k == 1, F.concat(F.lit("ab "), n)).when(k == 2, F.concat(F.lit("Ab"), n)).when(k == 3, F.concat(F.lit("a-b"), n)).when(k == 4, F.concat(F.lit("img "), n)).when(k == 5, F.concat(F.lit("x"), n, F.lit("y"))).when(k == 6, F.concat(F.lit("q00"), n)).otherwise(F.lit("'.'"))
    there = F.when(k == 0, n).when(k == 1, F.concat(F.lit("ab   "), n)).when(k == 2, F.concat(F.lit("aB"), n)).when(k == 3, F.concat(F.lit("A B"), n)).when(k.isin(4, 5, 6), n).otherwise(F.lit("none"))
    # after the value stands ' ; ', so that the compact form keeps its boundary
    return table(spark, d, "pages").select("page_id", n.alias("n"), value.alias("value"), F.concat(F.lit(". "), there, F.lit(" ; end")).alias("text"))


@register(
    "id_presence_ladder",
    """WITH k AS (SELECT page_id, page_id % 8 AS k, regexp_extract(url, '/([0-9]+)', 1) AS n FROM pages),
    m AS (SELECT *, CASE k WHEN 0 THEN 'strict_token' WHEN 1 THEN 'strict_ws_token' WHEN 2 THEN 'relaxed_casefold' WHEN 3 THEN 'relaxed_compact' WHEN 4 THEN 'relaxed_prefix_stripped' WHEN 5 THEN 'relaxed_digits' WHEN 6 THEN 'relaxed_digits_no_zeros' ELSE 'none' END AS matched_by FROM k)
    SELECT page_id, CASE WHEN k = 0 THEN 'numeric' WHEN k IN (2, 5, 6) THEN 'alphanumeric' WHEN k = 7 THEN 'empty' ELSE 'other' END AS id_format, matched_by, CAST(CASE WHEN k IN (3, 7) THEN -1 ELSE 2 END AS INT) AS span_start FROM m""",
)
def id_presence_ladder(spark: SparkSession, d: str) -> DataFrame:
    """T-1 to T-11: the first rung on which an id occurs in a text."""
    x = text.match_ladder(ladder(spark, d), "text", "value")
    return x.select("page_id", text.id_format(F.col("id_clean")).alias("id_format"), "matched_by", F.coalesce("span_start", F.lit(-1)).cast("int").alias("span_start"))


@register(
    "presence_summary",
    """WITH k AS (SELECT page_id % 8 AS k, page_id % 3 AS file FROM pages)
    SELECT file, count(*) AS total_occurrences, count_if(k = 0) AS strict_present_n, round(100.0 * count_if(k = 0) / count(*), 3) AS strict_present_pct, count_if(k <= 1) AS strict_plus_ws_n, count_if(k BETWEEN 1 AND 6) AS relaxed_only_n, count_if(k <= 6) AS any_present_n, count_if(k IN (2, 5, 6)) AS alphanumeric_n FROM k GROUP BY file""",
)
def presence_summary(spark: SparkSession, d: str) -> DataFrame:
    """Presence by file."""
    x = text.match_ladder(ladder(spark, d), "text", "value")
    x = x.select((F.col("page_id") % 3).alias("file"), text.id_format(F.col("id_clean")).alias("id_format"), "matched_by")
    return metrics.presence_summary(x, ["file"]).select("file", "total_occurrences", "strict_present_n", "strict_present_pct", "strict_plus_ws_n", "relaxed_only_n", "any_present_n", "alphanumeric_n")


@register(
    "format_distribution",
    """WITH f AS (SELECT lang, CASE WHEN v = '' THEN 'empty' WHEN regexp_full_match(v, '[0-9]+') THEN 'numeric' WHEN regexp_full_match(v, '[A-Za-z0-9]+') AND regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]') THEN 'alphanumeric' ELSE 'other' END AS id_format
      FROM (SELECT lang, CASE doc_id % 4 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN source WHEN 2 THEN lang ELSE '' END AS v FROM documents))
    SELECT lang, id_format, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY lang), 3) AS pct FROM f GROUP BY lang, id_format""",
)
def format_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Id formats and their share within a group."""
    k = F.col("doc_id") % 4
    v = F.when(k == 0, F.col("doc_id").cast("string")).when(k == 1, F.col("source")).when(k == 2, F.col("lang")).otherwise("")
    return metrics.share_within(table(spark, d, "documents").select("lang", text.id_format(v).alias("id_format")), ["lang"], "id_format")


@register(
    "runaway_suffix",
    """WITH t AS (SELECT doc_id, right(CASE WHEN doc_id % 5 = 0 THEN text || repeat('3', 70) WHEN doc_id % 5 = 1 THEN text || repeat('2022/1 ', 12) WHEN doc_id % 5 = 2 THEN text || repeat(' ', 200) WHEN doc_id % 5 = 3 THEN text || repeat('3', 40) ELSE text END, 4096) AS t FROM documents)
    SELECT doc_id, len(list_filter(range(1, 33), lambda p: length(t) >= p * greatest(8, ceil(64 / p)::INT) AND trim(right(t, p)) <> '' AND right(t, p * greatest(8, ceil(64 / p)::INT)) = repeat(right(t, p), greatest(8, ceil(64 / p)::INT)))) > 0 AS runaway FROM t""",
)
def runaway_suffix(spark: SparkSession, d: str) -> DataFrame:
    """T-17: endings that repeat a short block."""
    k = F.col("doc_id") % 5
    t = F.when(k == 0, F.concat("text", F.lit("3" * 70))).when(k == 1, F.concat("text", F.lit("2022/1 " * 12))).when(k == 2, F.concat("text", F.lit(" " * 200))).when(k == 3, F.concat("text", F.lit("3" * 40))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.runaway_suffix(t).alias("runaway"))


@register("first_difference", """SELECT conv_id, turn, role, CAST(CASE WHEN turn % 2 = 0 THEN -1 ELSE length(text) END AS BIGINT) AS at FROM conversations""")
def first_difference(spark: SparkSession, d: str) -> DataFrame:
    """T-16: where two texts begin to differ."""
    other = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("+")))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce(text.first_difference(F.col("text"), other), F.lit(-1)).cast("long").alias("at"))


# --- audits -----------------------------------------------------------------------------


def two_arms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.char_length("text").alias("tokens"))
    b = x.filter(F.col("turn") % 5 != 4).withColumns({"text": F.when(F.col("conv_id") % 3 == 0, F.upper("text")).otherwise(F.col("text")), "tokens": F.when(F.col("conv_id") % 7 == 0, None).otherwise(F.col("tokens") + F.when(F.col("turn") == 1, 1).otherwise(0))})
    return x, b


@register(
    "pair_audit",
    """WITH a AS (SELECT conv_id, turn, role, text, length(text) AS tokens FROM conversations), b AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 3 = 0 THEN upper(text) ELSE text END AS text, CASE WHEN conv_id % 7 <> 0 THEN length(text) + CASE WHEN turn = 1 THEN 1 ELSE 0 END END AS tokens FROM conversations WHERE turn % 5 <> 4)
    SELECT count_if(a.conv_id IS NOT NULL AND b.conv_id IS NOT NULL) AS common, count_if(b.conv_id IS NULL) AS only_a, count_if(a.conv_id IS NULL) AS only_b, count_if(a.conv_id IS NOT NULL AND b.conv_id IS NOT NULL AND a.text IS DISTINCT FROM b.text) AS differs_text, count_if(a.conv_id IS NOT NULL AND b.conv_id IS NOT NULL AND a.tokens IS DISTINCT FROM b.tokens) AS differs_tokens
    FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.role = b.role""",
)
def pair_audit(spark: SparkSession, d: str) -> DataFrame:
    """Two arms by key: one-sided rows and differing values."""
    return audits.pair_audit(*two_arms(spark, d), ["conv_id", "turn", "role"], ["text", "tokens"])


@register(
    "prompt_token_equality",
    """SELECT count(*) AS n, count_if(turn % 5 = 4 OR conv_id % 7 = 0) AS missing, count_if(turn % 5 <> 4 AND conv_id % 7 <> 0 AND turn = 1) AS mismatched FROM conversations""",
)
def prompt_token_equality(spark: SparkSession, d: str) -> DataFrame:
    """X11."""
    return audits.prompt_tokens(*two_arms(spark, d), ["conv_id", "turn", "role"], "tokens")


@register(
    "positional_zip",
    """WITH a AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM documents), b AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS pos FROM documents)
    SELECT source, count(*) AS n, count_if(a.doc_id = b.doc_id) AS same FROM a FULL JOIN b USING (source, pos) GROUP BY source""",
)
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """Rows of equal position in two orders."""
    x = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    z = audits.zip_join(audits.numbered(x, ["doc_id"], ["source"]), audits.numbered(x, ["n_chars", "doc_id"], ["source"]), ["source"], ["doc_id"])
    return z.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("a_doc_id") == F.col("b_doc_id")).alias("same"))


@register(
    "truncation_hits",
    """SELECT lang, count(*) AS n, count_if(CASE WHEN doc_id % 9 = 0 AND lang <> 'de' THEN n_chars >= 3000 ELSE doc_id % 4 = 0 END) AS hits, CASE WHEN bool_and(NOT (doc_id % 9 = 0 AND lang <> 'de')) THEN 'finish_reason' ELSE 'completion_limit_proxy' END AS measured_by FROM documents GROUP BY lang""",
)
def truncation_hits(spark: SparkSession, d: str) -> DataFrame:
    """Length limit hits, by reason or by proxy."""
    reason = F.when((F.col("doc_id") % 9 == 0) & (F.col("lang") != "de"), None).when(F.col("doc_id") % 4 == 0, "length").otherwise("stop")
    return metrics.truncation(table(spark, d, "documents").select("lang", "n_chars", reason.alias("reason")), ["lang"], "reason", "n_chars", 3000)


@register("gate_checks", """SELECT bool_and(n_chars > 0) AS sized, bool_and(coalesce(lang IN ('en', 'de', 'fr', 'es'), false)) AS known, bool_and(doc_id % 2 = 0) AS even FROM documents""")
def gate_checks(spark: SparkSession, d: str) -> DataFrame:
    """Named checks that must hold in every row."""
    x = audits.checks(table(spark, d, "documents").select("n_chars", "lang", "doc_id"), {"sized": F.col("n_chars") > 0, "known": F.col("lang").isin("en", "de", "fr", "es"), "even": F.col("doc_id") % 2 == 0})
    return metrics.gate(x, ["sized", "known", "even"])


@register(
    "acceptance_rules",
    """SELECT n_regionkey, count(*) AS n, count_if(NOT (n_nationkey % 3 = 0) OR n_regionkey = 1) AS accepted, count_if(n_nationkey % 3 = 0 AND n_regionkey = 1) AS waived FROM nation GROUP BY n_regionkey""",
)
def acceptance_rules(spark: SparkSession, d: str) -> DataFrame:
    """A rule table with one documented exemption."""
    x = audits.rule_table(table(spark, d, "nation"), [("not_third", F.col("n_nationkey") % 3 != 0, F.col("n_regionkey") == 1), ("named", F.char_length("n_name") > 0, None)])
    return x.groupBy("n_regionkey").agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"), F.count_if(F.size("waived") > 0).alias("waived"))


@register(
    "set_guards",
    """WITH a AS (SELECT DISTINCT c_nationkey AS v FROM customer WHERE c_nationkey % 3 <> 0), b AS (SELECT DISTINCT n_nationkey AS v FROM nation WHERE n_regionkey <> 2) SELECT count_if(b.v IS NULL) AS only_a, count_if(a.v IS NULL) AS only_b, count_if(a.v IS NOT NULL AND b.v IS NOT NULL) AS common FROM a FULL JOIN b ON a.v = b.v""",
)
def set_guards(spark: SparkSession, d: str) -> DataFrame:
    """Two value sets against one another."""
    a = table(spark, d, "customer").filter(F.col("c_nationkey") % 3 != 0).select(F.col("c_nationkey").alias("v"))
    b = table(spark, d, "nation").filter(F.col("n_regionkey") != 2).select(F.col("n_nationkey").alias("v"))
    return audits.set_checks(a, b, "v")


@register(
    "histogram_arrays",
    """WITH n AS (SELECT user_id % 10 AS bucket, event_type AS value, count(*) AS n FROM events GROUP BY ALL) SELECT bucket, string_agg(value || '=' || n, ',' ORDER BY value) AS histogram FROM n GROUP BY bucket""",
)
def histogram_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Counts by value over lists."""
    h = metrics.histogram(table(spark, d, "events").select((F.col("user_id") % 10).alias("bucket"), F.array("event_type").alias("v")), ["bucket"], F.col("v"))
    return h.select("bucket", F.array_join(F.transform("histogram", lambda x: F.concat(x["value"], F.lit("="), x["n"].cast("string"))), ",").alias("histogram"))


TYPES = ("click", "view", "purchase", "signup", "error")


@register(
    "evidence_lists",
    """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rn FROM documents) SELECT source, count(*) AS n, string_agg(CASE WHEN rn <= 5 THEN doc_id::VARCHAR END, ',' ORDER BY rn) AS first FROM r GROUP BY source""",
)
def evidence_lists(spark: SparkSession, d: str) -> DataFrame:
    """The first five ids of each group."""
    e = reports.evidence(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], "n_chars", "doc_id", 5)
    return e.select("source", "n", F.array_join(F.col("first").cast("array<string>"), ",").alias("first"))


@register(
    "pivot_feature_model",
    """WITH v AS (SELECT event_type AS feature, user_id % 3 AS model, avg(value) AS v FROM events GROUP BY ALL) SELECT feature, round(max(CASE WHEN model = 0 THEN v END), 6) AS m0, round(max(CASE WHEN model = 1 THEN v END), 6) AS m1, round(max(CASE WHEN model = 2 THEN v END), 6) AS m2, round(avg(v), 6) AS mean FROM v GROUP BY feature""",
)
def pivot_feature_model(spark: SparkSession, d: str) -> DataFrame:
    """Long to wide by model, rows by mean."""
    v = table(spark, d, "events").groupBy(F.col("event_type").alias("feature"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model")).agg(F.avg("value").alias("v"))
    w = reports.wide_by(v, "feature", "model", "v", ["m0", "m1", "m2"])
    return w.select("feature", *[r6(c).alias(c) for c in ("m0", "m1", "m2", "mean")])


@register(
    "unpivot_metrics",
    """SELECT lang, metric, CAST(value AS DOUBLE) AS value FROM (SELECT lang, CAST(count(*) AS DOUBLE) AS n, CAST(sum(n_chars) AS DOUBLE) AS chars FROM documents GROUP BY lang) UNPIVOT (value FOR metric IN (n, chars))""",
)
def unpivot_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Wide to long."""
    w = table(spark, d, "documents").groupBy("lang").agg(F.count("*").cast("double").alias("n"), F.sum("n_chars").cast("double").alias("chars"))
    return reports.long_by(w, ["lang"], ["n", "chars"])


@register(
    "regime_effects",
    """WITH v AS (SELECT source, avg(CASE WHEN doc_id % 3 = 0 THEN n_chars END) AS s, avg(CASE WHEN doc_id % 3 = 1 THEN n_chars END) AS d, avg(CASE WHEN doc_id % 3 = 2 THEN n_chars END) AS c FROM documents GROUP BY source)
    SELECT source, round(s, 6) AS sparse, round(d, 6) AS dense, round(c, 6) AS constrained, round(d - s, 6) AS prompt_effect, round(c - d, 6) AS constraint_effect, round(c - s, 6) AS end_to_end_effect FROM v""",
)
def regime_effects(spark: SparkSession, d: str) -> DataFrame:
    """Effects between regimes."""
    k = F.col("doc_id") % 3
    v = table(spark, d, "documents").groupBy("source", F.when(k == 0, "sparse").when(k == 1, "dense").otherwise("constrained").alias("regime")).agg(F.avg("n_chars").alias("v"))
    e = reports.effects(v, ["source"], "regime", "v")
    return e.select("source", *[r6(c).alias(c) for c in e.columns if c != "source"])


@register(
    "arm_summary",
    """SELECT lang, count(*) AS n, count_if(doc_id % 2 = 0) AS exact_tags, count_if(doc_id % 3 <> 0) AS json_valid, count_if(doc_id % 6 = 1) AS schema_valid, CAST(sum(doc_id % 4) AS BIGINT) AS nulls, 0::BIGINT AS status_both_omitted, count_if(doc_id % 2 = 0) AS status_consistent, count_if(doc_id % 2 = 1) AS status_inconsistent, 0::BIGINT AS status_uncheckable, CAST(sum(n_chars) AS BIGINT) AS completion_tokens, CAST(sum(least(doc_id % 8, 5)) AS BIGINT) AS listed_errors FROM documents GROUP BY lang""",
)
def arm_summary(spark: SparkSession, d: str) -> DataFrame:
    """An arm's validity summary."""
    k = F.col("doc_id")
    errors = F.array_repeat(F.lit("e"), (k % 8).cast("int"))
    return metrics.arm_summary(table(spark, d, "documents"), ["lang"], k % 2 == 0, k % 3 != 0, k % 6 == 1, k % 4, F.when(k % 2 == 0, "consistent").otherwise("inconsistent"), F.col("n_chars"), errors)


# --- resampling -------------------------------------------------------------------------


def contributions(spark: SparkSession, d: str, only: int | None = None) -> tuple[DataFrame, int]:
    """Labelled documents numbered from 0 by doc_id, and how many; a cohort of reports is small."""
    e = label_events(spark, d)
    if only is not None:
        e = e.filter(F.col("quality") == only)
    e = audits.numbered(e, ["doc_id"]).withColumnRenamed("pos", "idx")
    return e, e.count()


def arm(e: DataFrame, name: str, *keep: str) -> DataFrame:
    return e.select("idx", *keep, *[F.col(f"{c}_{name}").alias(c) for c in ("gold_appearances", "TP", "FP", "FN")])


def _sql_boot(where: str = "true") -> str:
    return f"""WITH e AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM ({SQL_LABELS}) WHERE {where}), n AS (SELECT count(*) AS n FROM e),
    s AS (SELECT b.range AS iter, CAST('0x' || substr(md5(b.range || '-' || k.range), 1, 8) AS BIGINT) % n AS idx FROM n, range({ITERATIONS}) b, range((SELECT n FROM n)) k),
    w AS (SELECT iter, idx, count(*) AS w FROM s GROUP BY ALL)"""


_SQL_F1 = "2 * sum(w * tp_{0}) / nullif(2 * sum(w * tp_{0}) + sum(w * fp_{0}) + sum(w * fn_{0}), 0)"
_SQL_CI = "round(quantile_cont(f1, 0.025), 6) AS ci_low, round(quantile_cont(f1, 0.975), 6) AS ci_high, count(f1) AS n_valid"


def rounded(ci: DataFrame) -> DataFrame:
    return ci.withColumns({"ci_low": r6("ci_low"), "ci_high": r6("ci_high")})


@register("bootstrap_micro_ci", f"{_sql_boot()}, f AS (SELECT iter, {_SQL_F1.format('b')} AS f1 FROM w JOIN e USING (idx) GROUP BY iter) SELECT {_SQL_CI} FROM f")
def bootstrap_micro_ci(spark: SparkSession, d: str) -> DataFrame:
    """Percentile interval of micro F1 under portable draws."""
    e, n = contributions(spark, d)
    dist = bootstrap.micro_distribution(arm(e, "b"), bootstrap.draws(spark, ITERATIONS, n))
    return rounded(dist.agg(*bootstrap.interval()))


@register("bootstrap_paired_delta", f"{_sql_boot()}, f AS (SELECT iter, {_SQL_F1.format('b')} - {_SQL_F1.format('a')} AS f1 FROM w JOIN e USING (idx) GROUP BY iter) SELECT {_SQL_CI} FROM f")
def bootstrap_paired_delta(spark: SparkSession, d: str) -> DataFrame:
    """Replicate-wise difference under shared weights."""
    e, n = contributions(spark, d)
    w = bootstrap.draws(spark, ITERATIONS, n)
    a, b = (bootstrap.micro_distribution(arm(e, x), w) for x in "ab")
    return rounded(bootstrap.paired_delta(a, b).agg(*bootstrap.interval()))


@register(
    "bootstrap_feature_weighted",
    f"""{_sql_boot()}, t AS (SELECT iter, lang, {_SQL_F1.format("b")} AS f, sum(w * g) AS g FROM w JOIN e USING (idx) GROUP BY iter, lang), f AS (SELECT iter, sum(f * g) / nullif(sum(g), 0) AS f1 FROM t GROUP BY iter) SELECT {_SQL_CI} FROM f""",
)
def bootstrap_feature_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Support-weighted mean of feature F1, support re-estimated in each replicate."""
    e, n = contributions(spark, d)
    c = arm(e, "b", "lang").withColumnRenamed("lang", "feature")
    return rounded(bootstrap.weighted_distribution(c, bootstrap.draws(spark, ITERATIONS, n)).agg(*bootstrap.interval()))


@register("case_mix_sensitivity", f"{_sql_boot('quality = 1')}, f AS (SELECT iter, {_SQL_F1.format('b')} AS f1 FROM w JOIN e USING (idx) GROUP BY iter) SELECT {_SQL_CI} FROM f")
def case_mix_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Positives only, with draws of their own."""
    e, n = contributions(spark, d, 1)
    return rounded(bootstrap.micro_distribution(arm(e, "b"), bootstrap.draws(spark, ITERATIONS, n)).agg(*bootstrap.interval()))


@register("bootstrap_matrix")
def bootstrap_matrix(spark: SparkSession, d: str) -> DataFrame:
    """R1, R3 by matrix product, 10,000 seeded replicates."""
    e, n = contributions(spark, d)
    return bootstrap.matrix_distribution(arm(e, "b"), n).agg(*bootstrap.interval())


@register(
    "stratified_sample",
    """WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('7-' || doc_id), doc_id) AS round FROM documents) SELECT doc_id, lang, source, round FROM r WHERE round <= 20 ORDER BY round, lang, source, doc_id LIMIT 20""",
)
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Twenty rows, round-robin over strata (the limit is the operator's)."""
    return bootstrap.stratified_sample(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 20).select("doc_id", "lang", "source", F.col("round").cast("long").alias("round"))


@register(
    "topp_mask",
    """WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS logit, unnest(range(len(embedding))) AS tok FROM embeddings), m AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS w FROM l), p AS (SELECT *, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM m),
    c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY logit ASC, tok DESC ROWS UNBOUNDED PRECEDING) AS c, max(p) OVER (PARTITION BY vec_id) AS mx FROM p)
    SELECT vec_id, count_if(round(c, 9) > 0.1 AND p >= 0.2 * mx) AS kept FROM c GROUP BY vec_id""",
)
def topp_mask(spark: SparkSession, d: str) -> DataFrame:
    """Top-p and min-p masks of each vector's values as logits."""
    x = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("tok", "logit")).withColumn("logit", F.col("logit").cast("double"))
    return decoder.top_p_mask(x, "vec_id", "logit", "tok", 0.9, 0.2).groupBy("vec_id").agg(F.count_if("kept").alias("kept"))


@register("prompt_filter", """SELECT count(*) AS n, count_if(len(list_filter(string_split_regex('<s>' || lang || chr(10) || chr(10) || trim(regexp_replace(text, '\\s+', ' ', 'g')) || '</s>', '\\s+'), lambda t: t <> '')) > 300) AS skipped FROM documents""")
def prompt_filter(spark: SparkSession, d: str) -> DataFrame:
    """L1: rendered prompts and those that are too long."""
    x = table(spark, d, "documents").select("lang", text.collapse_ws(F.col("text")).alias("given"))
    p = generation.render_prompts(x, "lang", "given", lambda t: F.concat(F.lit("<s>"), t, F.lit("</s>")), generation.white_space_tokens, 400, 100)
    return p.agg(F.count("*").alias("n"), F.count_if("skipped").alias("skipped"))


@register("generation_stub", """SELECT conv_id, turn, role, upper(role) || '!' AS completion FROM conversations""")
def generation_stub(spark: SparkSession, d: str) -> DataFrame:
    """L2: the generation stage with a stub client."""
    x = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return generation.generate(x, lambda p: p.upper() + "!", prompt="role")


@register(
    "template_slot_check",
    r"""WITH v AS (SELECT l_linenumber, CAST(l_quantity AS INT)::VARCHAR AS q, printf('%.2f', l_extendedprice) AS e, CASE WHEN l_suppkey % 3 = 0 THEN '0' ELSE '' END || l_suppkey AS i,
      CASE l_suppkey % 5 WHEN 0 THEN strftime(l_shipdate, '13/%-d/%Y') WHEN 1 THEN strftime(l_shipdate, '%m/%d/%y') WHEN 2 THEN strftime(l_shipdate, '%-m/%Y') WHEN 3 THEN 'null' ELSE strftime(l_shipdate, '%-m/%-d/%Y') END AS s FROM lineitem)
    SELECT l_linenumber, count(*) AS n, count_if(regexp_full_match(q, '0|[1-9]|[1-4][0-9]')) AS counts, count_if(regexp_full_match(e, '(0|[1-9][0-9]{0,7})([.][0-9]{1,4})?|null')) AS decimals, count_if(regexp_full_match(i, '0|[1-9][0-9]{0,7}|null')) AS integers,
      count_if(regexp_full_match(s, '(0?[1-9]|1[0-2])/(0?[1-9]|[12][0-9]|3[01])/([0-9]{4}|[0-9]{2})|null')) AS dates, count_if(regexp_full_match(s, '(0?[1-9]|1[0-2])/((0?[1-9]|[12][0-9]|3[01])/([0-9]{4}|[0-9]{2})|[0-9]{4})|null')) AS follow_ups FROM v GROUP BY l_linenumber""",
)
def template_slot_check(spark: SparkSession, d: str) -> DataFrame:
    """V4-V7: complete words of typed slots."""
    k = F.col("l_suppkey") % 5
    s = F.when(k == 0, F.date_format("l_shipdate", "'13'/d/yyyy")).when(k == 1, F.date_format("l_shipdate", "MM/dd/yy")).when(k == 2, F.date_format("l_shipdate", "M/yyyy")).when(k == 3, "null").otherwise(F.date_format("l_shipdate", "M/d/yyyy"))
    x = table(spark, d, "lineitem").select("l_linenumber", F.col("l_quantity").cast("int").cast("string").alias("q"), F.format_string("%.2f", "l_extendedprice").alias("e"), F.concat(F.when(F.col("l_suppkey") % 3 == 0, "0").otherwise(""), F.col("l_suppkey").cast("string")).alias("i"), s.alias("s"))
    n = lambda marker, c: F.count_if(slots.slot_complete(marker, F.col(c)))
    return x.groupBy("l_linenumber").agg(F.count("*").alias("n"), n("num_nodule", "q").alias("counts"), n("long_axis", "e").alias("decimals"), n("series", "i").alias("integers"), n("comparison_date", "s").alias("dates"), n("follow_up_date", "s").alias("follow_ups"))


@register(
    "schema_validate_nested",
    """SELECT count(*) AS n, count_if(c_custkey % 5 <> 3 AND c_custkey % 2 = 1 AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0) AS valid, count_if(c_custkey % 5 = 3) AS not_objects,
      CAST(sum(CASE WHEN c_custkey % 5 = 3 THEN 1 ELSE (c_custkey % 2 = 0)::INT + (c_custkey % 7 = 0)::INT + 2 * (c_custkey % 11 = 0)::INT END) AS BIGINT) AS faults FROM customer""",
)
def schema_validate_nested(spark: SparkSession, d: str) -> DataFrame:
    """V1 on nested record texts: categories, additional properties, faults inside the list."""
    k = F.col("c_custkey")
    item = F.when(k % 11 == 0, '{"Image ID": -1, "Lobe": "hilum"}').otherwise('{"Image ID": 7, "Lobe": "lingula"}')
    raw = F.concat(F.lit('{"Number of Nodules": 1, "Nodules": ['), item, F.lit('], "Overall Lung-RADS": '), F.when(k % 2 == 0, '" none "').otherwise('"2"'), F.when(k % 7 == 0, ', "Extra": 1').otherwise(""), F.lit("}"))
    v = table(spark, d, "customer").select(schema.validate_json(F.when(k % 5 == 3, "[1]").otherwise(raw), fields.raw_schema()).alias("v"))
    return v.agg(F.count("*").alias("n"), F.count_if("v.valid").alias("valid"), F.count_if(F.exists("v.errors", lambda e: e["validator"].isNull())).alias("not_objects"), F.sum("v.error_count").alias("faults"))


@register(
    "reported_totals",
    """WITH a AS (SELECT source, count(*) AS n, CAST(sum(CASE WHEN doc_id % 50 <> 0 THEN n_chars END) AS BIGINT) AS s, count_if(doc_id % 50 = 0) AS missing FROM documents GROUP BY source) SELECT source, n, s AS summed, missing, s + n % 2 AS reported, n % 2 = 0 AND missing = 0 AS agrees FROM a""",
)
def reported_totals(spark: SparkSession, d: str) -> DataFrame:
    """Reported totals against the sums of the cases, some of which have no count."""
    x = table(spark, d, "documents").select("source", F.when(F.col("doc_id") % 50 != 0, F.col("n_chars")).alias("tokens"))
    n = x.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("s"))
    reported = n.select("source", "n", (F.col("s") + F.col("n") % 2).alias("reported"))
    return audits.token_totals(x, reported, ["source"], "tokens").select("source", "n", "summed", "missing", "reported", "agrees")


@register(
    "conversion_safety",
    """WITH a AS (SELECT conv_id, turn, role FROM conversations), b AS (SELECT conv_id, turn, CASE WHEN conv_id % 10 = 3 THEN 'x' ELSE role END AS role FROM conversations WHERE turn <> 2) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS lost, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS gained""",
)
def conversion_safety(spark: SparkSession, d: str) -> DataFrame:
    """A conversion of one column that also changed another and lost rows."""
    x = table(spark, d, "conversations")
    after = x.filter("turn <> 2").withColumns({"text": F.upper("text"), "role": F.when(F.col("conv_id") % 10 == 3, "x").otherwise(F.col("role"))})
    return audits.conversion_safe(x, after, ["text"])


@register(
    "negative_rate_ci",
    f"{_sql_boot('quality <> 1')}, f AS (SELECT iter, sum(w * (fp_b > 0)::INT) / sum(w) AS f1 FROM w JOIN e USING (idx) GROUP BY iter) SELECT {_SQL_CI} FROM f",
)
def negative_rate_ci(spark: SparkSession, d: str) -> DataFrame:
    """The share of negative reports with any false positive, under draws of their own."""
    e, n = contributions(spark, d, 0)
    dist = bootstrap.any_fp_rate(arm(e, "b"), bootstrap.draws(spark, ITERATIONS, n))
    return rounded(dist.agg(*bootstrap.interval()))


@register(
    "supported_point_check",
    f"""WITH f AS ({sql_features("b", "lang")}) SELECT lang, gold_appearances > 0 AS supported, CAST(CASE WHEN gold_appearances > 0 THEN tp END AS BIGINT) AS "TP" FROM f""",
)
def supported_point_check(spark: SparkSession, d: str) -> DataFrame:
    """The features that gold supports in the full cohort, and their totals."""
    e, _ = contributions(spark, d)
    c = arm(e, "b", "lang").withColumnRenamed("lang", "feature")
    kept = bootstrap.supported_only(c).groupBy("feature").agg(F.sum("TP").alias("TP"))
    every = c.select("feature").distinct()
    return every.join(kept.withColumn("supported", F.lit(True)), "feature", "left").select(F.col("feature").alias("lang"), F.coalesce("supported", F.lit(False)).alias("supported"), "TP")
