"""One-to-one alignment of predicted with expected findings.

Phase 1 is relational: equal keys, matched by rank within (report, key), which is what taking
the first unused prediction in order amounts to. Phase 2 is an optimal assignment per report
on what is left, in a grouped function: a report has at most some dozens of findings.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordgauge.functions import jsonx
from recordgauge.functions.equality import plain_equal
from recordgauge.functions.fields import DIRECT_KEY, MIN_SIMILARITY, WEIGHTS
from recordgauge.session import cut


def ranked(df: DataFrame, group: list[str], key: list[str], order: str) -> DataFrame:
    """`__rank` of each row among those of its group and key; rows without a key have none."""
    has = F.greatest(*[F.col(k).isNotNull() for k in key]) if len(key) > 1 else F.col(key[0]).isNotNull()
    w = Window.partitionBy(*group, *key).orderBy(order)
    return df.withColumn("__rank", F.when(has, F.row_number().over(w)))


def key_matches(gold: DataFrame, pred: DataFrame, group: list[str], key: list[str], order: str, complete: bool = True) -> DataFrame:
    """(group, gold_pos, pred_pos) of pairs of equal keys.

    complete=True: X1, every part of the key must be there. complete=False: X2, the same
    parts must be there on both sides, and at least one."""
    if complete:
        there = F.lit(True)
        for k in key:
            there = there & F.col(k).isNotNull()
        gold, pred = gold.filter(there), pred.filter(there)
    g = ranked(gold, group, key, order).filter("__rank is not null").select(*[F.col(c).alias(f"g_{c}") for c in [*group, *key, "__rank"]], F.col(order).alias("gold_pos"))
    p = ranked(pred, group, key, order).filter("__rank is not null").select(*[F.col(c).alias(f"p_{c}") for c in [*group, *key, "__rank"]], F.col(order).alias("pred_pos"))
    on = [F.col(f"g_{c}") == F.col(f"p_{c}") for c in [*group, "__rank"]] + [F.col(f"g_{k}").eqNullSafe(F.col(f"p_{k}")) for k in key]
    return g.join(p, on).select(*[F.col(f"g_{c}").alias(c) for c in group], "gold_pos", "pred_pos")


def unmatched(rows: DataFrame, matches: DataFrame, group: list[str], order: str, side: str) -> DataFrame:
    """The rows of one side ('gold_pos' or 'pred_pos') that no match holds."""
    return rows.join(matches.select(*group, F.col(side).alias(order)), [*group, order], "left_anti")


def weighted_similarity(terms: list[tuple[Column, Column, float]]) -> Column:
    """(gold value present, values equal, weight) of each field to a share of the gold's weight."""
    total, same = F.lit(0.0), F.lit(0.0)
    for present, equal, weight in terms:
        total = total + F.when(present, weight).otherwise(0.0)
        same = same + F.when(present & equal, weight).otherwise(0.0)
    return F.coalesce(F.try_divide(same, total), F.lit(0.0))


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost pairs of a rectangular matrix by shortest augmenting paths with potentials; lowest index on ties."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    row_of = np.full(m, -1)
    u, v = np.zeros(n), np.zeros(m)
    for start in range(n):
        dist, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        row, low, seen = start, 0.0, []
        while True:
            seen.append(row)
            reach = low + c[row] - u[row] - v
            better = ~done & (reach < dist)
            dist[better], back[better] = reach[better], row
            j = int(np.where(done, np.inf, dist).argmin())
            low = dist[j]
            done[j] = True
            if row_of[j] < 0:
                break
            row = int(row_of[j])
        col_of_row = {int(row_of[k]): k for k in range(m) if row_of[k] >= 0}
        u[start] += low
        for r in seen[1:]:
            u[r] += low - dist[col_of_row[r]]
        inside = done.copy()
        inside[j] = False
        v[inside] -= low - dist[inside]
        while True:
            r = int(back[j])
            row_of[j] = r
            if r == start:
                break
            j = col_of_row[r]
    pairs = sorted((int(r), k) for k, r in enumerate(row_of) if r >= 0)
    return sorted((k, r) for r, k in pairs) if flip else pairs


PAIR = T.StructType([T.StructField("gold_pos", T.LongType()), T.StructField("pred_pos", T.LongType()), T.StructField("similarity", T.DoubleType())])


def assign_pairs(candidates: DataFrame, group: list[str], minimum: float = MIN_SIMILARITY) -> DataFrame:
    """(group, gold_pos, pred_pos, similarity) of the best assignment in each group.

    candidates: (group, gold_pos, pred_pos, similarity) for the leftovers of either side; a
    pair that isn't listed has similarity 0. Pairs below `minimum` are dropped afterwards."""
    schema = T.StructType([candidates.schema[c] for c in group] + PAIR.fields)

    def solve(key, rows):
        import pandas as pd

        golds, preds = np.unique(rows.gold_pos), np.unique(rows.pred_pos)
        s = np.zeros((len(golds), len(preds)))
        s[np.searchsorted(golds, rows.gold_pos), np.searchsorted(preds, rows.pred_pos)] = rows.similarity
        found = [(*key, int(golds[i]), int(preds[j]), float(s[i, j])) for i, j in assign(-s) if s[i, j] >= minimum]
        return pd.DataFrame(found, columns=schema.names)

    return candidates.groupBy(*group).applyInPandas(solve, schema)


def match_values(gold: list[dict], pred: list[dict], minimum: float = MIN_SIMILARITY) -> list[tuple[int, int, float]]:
    """X1, X3, X5 of one report's parsed records: (gold_pos, pred_pos, similarity)."""
    same = lambda g, p, f: f in g and f in p and plain_equal(g[f], p[f], f)
    out, used = [], set()
    for i, g in enumerate(gold):
        for j, p in enumerate(pred):
            if j not in used and all(not jsonx.is_null_value(g.get(f)) and same(g, p, f) for f in DIRECT_KEY):
                out.append((i, j, 1.0))
                used.add(j)
                break
    left, rest = [i for i in range(len(gold)) if i not in {m[0] for m in out}], [j for j in range(len(pred)) if j not in used]
    if left and rest:
        s = np.zeros((len(left), len(rest)))
        for a, i in enumerate(left):
            there = {f: w for f, w in WEIGHTS.items() if not jsonx.is_null_value(gold[i].get(f))}
            for b, j in enumerate(rest):
                s[a, b] = sum(w for f, w in there.items() if same(gold[i], pred[j], f)) / sum(there.values()) if there else 0.0
        out += [(left[a], rest[b], float(s[a, b])) for a, b in assign(-s) if s[a, b] >= minimum]
    return sorted(out)


def match_records(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """`df` with `matches`: the pairs of two array<string> columns of record texts, row by row."""
    kind = "array<struct<gold_pos:int,pred_pos:int,similarity:double>>"

    def run(golds, preds):
        import pandas as pd

        read = lambda side: [x if isinstance(x := jsonx.loads(t), dict) else {} for t in (side if side is not None else [])]
        return pd.Series([[{"gold_pos": i, "pred_pos": j, "similarity": s} for i, j, s in match_values(read(g), read(p))] for g, p in zip(golds, preds, strict=True)])

    import pandas as pd

    run.__annotations__ = {"golds": pd.Series, "preds": pd.Series, "return": pd.Series}
    return df.withColumn("matches", F.pandas_udf(run, kind)(gold, pred))


def align(gold: DataFrame, pred: DataFrame, group: list[str], key: list[str], order: str, similarity, minimum: float = MIN_SIMILARITY, complete: bool = True) -> DataFrame:
    """(group, gold_pos, pred_pos, similarity): both phases.

    similarity(g, p) -> Column from functions that give a side's column by name."""
    direct = cut(key_matches(gold, pred, group, key, order, complete).withColumn("similarity", F.lit(1.0)))
    g = unmatched(gold, direct, group, order, "gold_pos")
    p = unmatched(pred, direct, group, order, "pred_pos")
    g = g.select(*group, *[F.col(c).alias(f"g_{c}") for c in g.columns if c not in group])
    p = p.select(*group, *[F.col(c).alias(f"p_{c}") for c in p.columns if c not in group])
    pairs = g.join(p, group).select(*group, F.col(f"g_{order}").cast("long").alias("gold_pos"), F.col(f"p_{order}").cast("long").alias("pred_pos"), similarity(lambda c: F.col(f"g_{c}"), lambda c: F.col(f"p_{c}")).alias("similarity"))
    direct = direct.withColumns({"gold_pos": F.col("gold_pos").cast("long"), "pred_pos": F.col("pred_pos").cast("long")})
    return direct.unionByName(assign_pairs(pairs, group, minimum))
