"""Paired bootstrap (R1-R9): relational with portable draws, and block-matrix with numpy draws.

Relational: draw `slot` of replicate `b` is the first eight hex digits of md5('b-slot') mod n,
which any SQL engine can repeat. Weights are aggregated before they meet the reports, so the
join carries one row for each (replicate, report) drawn.

Published: numpy's draws in a fixed order from one seed; replicates run in blocks over an
Arrow function, each beginning at its own place of the generator's stream.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordgauge.operators.audits import numbered
from recordgauge.operators.metrics import f1_or_null
from recordgauge.session import cut, free

ITERATIONS, SEED = 10_000, 20260822
#: Cells (configurations x features x 4) of one report up to which they stand in a row.
MATRIX_CELLS = 5_000_000


def draws(spark: SparkSession, iterations: int, n: int) -> DataFrame:
    """R1, portable: (iter, idx, w): how often report idx (0..n-1) is drawn in each replicate."""
    slots = spark.range(iterations * n).select(F.floor(F.col("id") / n).cast("long").alias("iter"), (F.col("id") % n).alias("slot"))
    digest = F.md5(F.concat_ws("-", F.col("iter").cast("string"), F.col("slot").cast("string")))
    idx = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n
    return slots.select("iter", idx.alias("idx")).groupBy("iter", "idx").agg(F.count("*").alias("w"))


def weights(rng: np.random.Generator, iterations: int, n: int) -> np.ndarray:
    """Multiplicities (iterations, n) of one call to a generator."""
    drawn = rng.integers(0, n, size=(iterations, n), dtype=np.int32)
    flat = drawn + (np.arange(iterations, dtype=np.int64) * n)[:, None]
    return np.bincount(flat.ravel(), minlength=iterations * n).reshape(iterations, n).astype(np.int32)


def weight_sets(iterations: int, n: int, positives: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """R2: the weights of all, of the positive and of the negative reports, drawn in this order from one generator."""
    rng = np.random.default_rng(seed)
    return tuple(weights(rng, iterations, k) if k else np.zeros((iterations, 0), dtype=np.int32) for k in (n, positives, n - positives))


def _f1(t: np.ndarray) -> np.ndarray:
    """F1 over a last axis of TP, FP, FN; NaN without events."""
    den = 2 * t[..., 0] + t[..., 1] + t[..., 2]
    return np.divide(2 * t[..., 0], den, out=np.full(den.shape, np.nan), where=den > 0)


def _weighted(t: np.ndarray) -> np.ndarray:
    """Support-weighted mean of feature F1 over axes (..., feature, [support, TP, FP, FN])."""
    f1, support = np.nan_to_num(_f1(t[..., 1:])), t[..., 0]
    total = support.sum(axis=-1)
    return np.divide((f1 * support).sum(axis=-1), total, out=np.full(total.shape, np.nan), where=total > 0)


def _interval(x: np.ndarray) -> tuple[float | None, float | None, int]:
    good = x[np.isfinite(x)]
    return (float(np.percentile(good, 2.5)), float(np.percentile(good, 97.5)), len(good)) if len(good) else (None, None, 0)


PUBLISHED = "model string, config string, metric string, feature string, point double, ci_low double, ci_high double, n_valid bigint"

#: Words of the generator's stream worked on at once, and cells of kinds x columns that travel to a task at once.
CHUNK, PART_CELLS = 1 << 22, 2_000_000


def words(seed: int, first: int, count: int) -> np.ndarray:
    """Words of 32 bits of a seeded generator's stream, from the given place on: each output gives its low half, then its high half."""
    bits = np.random.PCG64(seed)
    bits.advance(first // 2)
    return bits.random_raw((first % 2 + count + 1) // 2).astype("<u8").view("<u4")[first % 2 : first % 2 + count]


def drawn_from(x: np.ndarray, n: int) -> np.ndarray:
    """The draws below n that the generator makes of these words; whether it passes over a word depends on that word alone."""
    m = x.astype(np.uint64) * np.uint64(n)
    draws = (m >> np.uint64(32)).astype(np.int32)
    least = ((1 << 32) - n) % n
    return draws[m.astype(np.uint32) >= np.uint32(least)] if least else draws


def places(spark: SparkSession, seed: int, first: int, iterations: int, n: int, block: int) -> tuple[list[tuple[int, int, int]], int]:
    """(block, word, draws to pass from there on) of each block of replicates of one call for (iterations, n) draws, and the word after the call.

    The words that the generator passes over are counted chunk by chunk, in parallel; a chunk's count is all that reaches the driver."""
    blocks = range(-(-iterations // block))
    if n <= 1:  # such a call takes no word
        return [(b, first, 0) for b in blocks], first
    if not ((1 << 32) - n) % n:
        return [(b, first + b * block * n, 0) for b in blocks], first + iterations * n

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids = b.column("id")
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(drawn_from(words(seed, first + k * CHUNK, CHUNK), n)) for k in ids.to_pylist()], pa.int64())], names=["id", "kept"])

    kept, wanted, tasks = [], iterations * n, 4 * spark.sparkContext.defaultParallelism
    while (lacking := wanted - sum(kept)) > 0:
        more = lacking // CHUNK + 1
        found = spark.range(len(kept), len(kept) + more, 1, min(more, tasks)).mapInArrow(run, "id bigint, kept bigint").collect()  # a row a chunk
        kept += [r["kept"] for r in sorted(found)]
    before = np.concatenate([[0], np.cumsum(kept)])
    at = [int(np.searchsorted(before, b * block * n, "right")) - 1 for b in blocks]
    last = int(np.searchsorted(before, wanted, "left")) - 1
    m = words(seed, first + last * CHUNK, CHUNK) * np.uint32(n)
    end = int(np.flatnonzero(m >= np.uint32(((1 << 32) - n) % n))[wanted - before[last] - 1]) + 1
    return [(b, first + c * CHUNK, int(b * block * n - before[c])) for b, c in zip(blocks, at, strict=True)], first + last * CHUNK + end


def kind_counts(seed: int, first: int, skip: int, size: int, kinds: np.ndarray, width: int) -> np.ndarray:
    """(size, width): how many of each replicate's draws fall on reports of each kind."""
    n, out, done = len(kinds), np.zeros((size, width), dtype=np.int64), 0
    if n == 1:
        out[:, kinds[0]] = 1
        return out
    while done < size * n:
        x = drawn_from(words(seed, first, CHUNK), n)
        first += CHUNK
        passed = min(skip, len(x))
        skip -= passed
        of = kinds[x[passed : passed + size * n - done]]
        at = 0
        while at < len(of):
            k = done // n
            part = of[at : at + (k + 1) * n - done]
            out[k] += np.bincount(part, minlength=width)
            at, done = at + len(part), done + len(part)
    return out


def replicate_sums(spark: SparkSession, seed: int, first: int, iterations: int, kinds: np.ndarray, values: np.ndarray, block: int | None = None) -> tuple[np.ndarray, int]:
    """R1, R3 for the published draws: (iterations, columns), weighted sums over the reports, whose kind's values are summed; and the word after the call.

    A task makes the draws of its own replicates, chunk by chunk, and counts them by kind."""
    n = len(kinds)
    block = block or max(1, -(-iterations // (4 * spark.sparkContext.defaultParallelism)))
    jobs, after = places(spark, seed, first, iterations, n, block)
    if not n:
        return np.zeros((iterations, values.shape[1])), after
    width = len(values) + 1  # the last kind is of other parts

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k, word, skip in zip(*[b.column(c).to_pylist() for c in ("block", "word", "skip")], strict=True):
                size = min(block, iterations - k * block)
                sums = kind_counts(seed, word, skip, size, kinds, width)[:, :-1].astype(np.float64) @ values
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=["block", "sums"])

    todo = spark.createDataFrame(jobs, "block long, word long, skip long").repartition(len(jobs))
    got = sorted((r["block"], r["sums"]) for r in todo.mapInArrow(run, "block bigint, sums binary").collect())  # iterations x columns, whatever the reports
    return np.concatenate([np.frombuffer(x, dtype=np.float64).reshape(-1, values.shape[1]) for _, x in got]), after


#: Cells of all kinds up to which their table is broadcast.
KIND_CELLS = 1_000_000


def kinds_of(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(idx, kind), (entries, kind) and the number of kinds of rows (idx, entries): reports of equal entries are of one kind."""
    table = cut(numbered(rows.select("entries").distinct(), ["entries"]).withColumnRenamed("pos", "kind"))
    size = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("entries") + 1), F.lit(0)).alias("cells")).first()
    side = F.broadcast(table) if size["cells"] <= KIND_CELLS else table.hint("merge")
    return cut(rows.join(side, "entries").select("idx", F.col("kind").cast("int").alias("kind"))), table, size["n"]


def column(df: DataFrame, *names: str) -> list[np.ndarray]:
    """Number columns of a table as arrays, by Arrow."""
    got = df.select(*names).toArrow()
    return [got.column(c).to_numpy() for c in names]


def parts(rows: DataFrame, n: int, width: int):
    """(kind of each report 0..n-1, values of the kinds) in parts of at most PART_CELLS cells; reports of other parts are of a last kind without values."""
    of, table, total = kinds_of(rows)
    idx, kind = column(of, "idx", "kind")
    each = max(1, PART_CELLS // width)
    for low in range(0, max(total, 1), each):
        size = min(each, total - low)
        kinds = np.full(n, size, dtype=np.int32)
        here = (kind >= low) & (kind < low + size)
        kinds[idx[here]] = kind[here] - low
        values = np.zeros((size, width))
        cells = table.filter(F.col("kind").between(low, low + size - 1)).select("kind", F.explode("entries").alias("e")).select("kind", "e.cell", "e.v")
        k, cell, v = column(cells, "kind", "cell", "v")
        np.add.at(values, (k - low, cell), v)
        yield kinds, values
    free(of, table)


def entries(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, entries): the cells (cell, v) of each report that are not 0, in order."""
    sums = cells.groupBy(*by, "cell").agg(F.sum("v").cast("double").alias("v"))
    kept = F.filter(F.sort_array(F.collect_list(F.struct(F.col("cell").cast("int").alias("cell"), "v"))), lambda e: e["v"] != 0)
    return sums.groupBy(*by).agg(kept.alias("entries"))


def published(contributions: DataFrame, n: int, contrasts: dict[str, tuple[str, str]], iterations: int = ITERATIONS, seed: int = SEED, limit: int = MATRIX_CELLS) -> DataFrame:
    """R1-R8 as published: points and intervals of every arm and contrast, by model.

    contributions: (model, config, idx 0..n-1, positive, feature, gold_appearances, TP, FP,
    FN). Metrics: micro_f1 over the supported features, weighted_f1 with support re-estimated
    in each replicate, feature_f1, positive_f1 and negative_fp_rate under draws of their own,
    and delta:<name> of a contrast (first, second): second minus first, replicate by
    replicate. All draws come from one generator, and are the same in every task. A feature
    is supported if any gold of the cohort holds it. A report's cells (configurations x
    features x 4) are checked; the number of reports is not bounded (`published_rows`)."""
    names = ("gold_appearances", "TP", "FP", "FN")
    features = sorted(r["feature"] for r in contributions.select("feature").distinct().limit(10_001).collect())  # a schema's features
    arms = sorted(tuple(r) for r in contributions.select("model", "config").distinct().limit(1001).collect())
    if len(features) > 10_000 or len(arms) > 1000 or len(arms) * len(features) * 4 > limit:
        raise ValueError("too many arms or features for one row a report: use micro_distribution")
    at = {f: k for k, f in enumerate(features)}
    out = None
    for model in sorted({m for m, _ in arms}):
        configs = [c for m, c in arms if m == model]
        own = contributions.filter(F.col("model") == model)
        place = F.create_map(*[F.lit(x) for f, k in at.items() for x in (f, k)])
        arm = F.create_map(*[F.lit(x) for k, c in enumerate(configs) for x in (c, k)])
        base = (arm[F.col("config")] * len(features) + place[F.col("feature")]) * 4
        cells = own.select("idx", "positive", F.explode(F.array(*[F.struct((base + k).alias("cell"), F.col(c).cast("double").alias("v")) for k, c in enumerate(names)])).alias("e")).select("idx", "positive", "e.cell", "e.v")
        rows = cut(entries(cells.select("idx", "cell", "v"), ["idx"]).join(own.groupBy("idx").agg(F.bool_or("positive").alias("positive")).hint("merge"), "idx"))
        done = published_rows(rows, n, model, configs, features, contrasts, iterations, seed)
        free(rows)
        out = done if out is None else out.unionByName(done)
    return out if out is not None else contributions.sparkSession.createDataFrame([], PUBLISHED)


def published_rows(rows: DataFrame, n: int, model: str, configs: list[str], features: list[str], contrasts: dict[str, tuple[str, str]], iterations: int = ITERATIONS, seed: int = SEED) -> DataFrame:
    """`published` of one model from a row a report: (idx, positive, entries), the cells being (configuration, feature, count) in order.

    Reports of equal cells are of one kind. A task counts its replicates' draws by kind, so
    that neither weights (replicates x reports) nor all reports' cells are held anywhere;
    4 bytes a report are. Many kinds are taken in parts, each with the same draws."""
    spark, shape, wide = rows.sparkSession, (len(configs), len(features), 4), len(configs) * len(features) * 4
    positive = np.zeros(n, dtype=bool)
    (plus,) = column(rows.filter("positive"), "idx")
    positive[plus] = True
    whole = np.zeros(wide)
    for cell, v in rows.select(F.explode("entries").alias("e")).groupBy("e.cell").agg(F.sum("e.v")).collect():  # at most `wide` rows
        whole[cell] = v
    whole = whole.reshape(shape)
    held = whole[0, :, 0] > 0
    of_all, of_plus, of_minus = np.zeros((iterations, wide)), np.zeros((iterations, len(configs) * 3)), np.zeros((iterations, len(configs)))
    plus_point, flagged = np.zeros((len(configs), 3)), np.zeros(len(configs))
    for kinds, values in parts(rows.select("idx", "entries"), n, wide):
        x = values.reshape(-1, *shape)
        per_case = x[:, :, held, 1:].sum(axis=2)
        flag = (per_case[:, :, 1] > 0).astype(float)
        sums, word = replicate_sums(spark, seed, 0, iterations, kinds, values)
        of_all += sums
        sums, word = replicate_sums(spark, seed, word, iterations, kinds[positive], per_case.reshape(len(x), -1))
        of_plus += sums
        sums, _ = replicate_sums(spark, seed, word, iterations, kinds[~positive], flag)
        of_minus += sums
        plus_point += np.tensordot(np.bincount(kinds[positive], minlength=len(x) + 1)[:-1], per_case, 1)
        flagged += np.bincount(kinds[~positive], minlength=len(x) + 1)[:-1] @ flag
    totals, negatives, out, boots = of_all.reshape(iterations, *shape), int(n - positive.sum()), [], {}
    for k, c in enumerate(configs):

        def say(metric, point, boot, feature=None, c=c):
            boots[c, metric, feature] = (point, boot)
            out.append((model, c, metric, feature, None if not np.isfinite(point) else float(point), *_interval(boot)))

        say("micro_f1", float(_f1(whole[k, held, 1:].sum(axis=0))), _f1(totals[:, k, held, 1:].sum(axis=1)))
        say("weighted_f1", float(_weighted(whole[k, held])), _weighted(totals[:, k, held]))
        points, by_feature = _f1(whole[k, :, 1:]), _f1(totals[:, k, :, 1:])
        for f in np.flatnonzero(held):
            say("feature_f1", float(points[f]), by_feature[:, f], features[f])
        say("positive_f1", float(_f1(plus_point[k])), _f1(of_plus.reshape(iterations, -1, 3)[:, k]))
        if negatives:
            say("negative_fp_rate", float(flagged[k] / negatives), of_minus[:, k] / negatives)
    for name, (first, second) in contrasts.items():
        if first not in configs or second not in configs:
            continue
        for metric, feature in [("micro_f1", None), ("weighted_f1", None), *[("feature_f1", features[f]) for f in np.flatnonzero(held)]]:
            (pa, a), (pb, b) = boots[first, metric, feature], boots[second, metric, feature]
            point = pb - pa
            out.append((model, name, f"delta:{metric}", feature, float(point) if np.isfinite(point) else None, *_interval(b - a)))
    return spark.createDataFrame(out, PUBLISHED)


def poisson_totals(contributions: DataFrame, iterations: int, by: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """R1, R3 for cohorts of any size: weighted sums by replicate, every report's weight an independent Poisson(1) draw.

    The draw is the inverse distribution function at a hash of (seed, replicate, report), so
    that it needs no numbering, no join and no shuffle of draws: rows meet their replicates
    in place and sums are partial. Its totals have the multinomial's mean and, but for the
    cohort's size, its spread."""
    u = F.pmod(F.xxhash64(F.lit(seed), "iter", "idx"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    steps, mass, below = [], math.exp(-1.0), 0.0
    for k in range(12):
        below += mass
        steps.append(below)
        mass /= k + 1
    w = sum([(u >= s).cast("int") for s in steps], F.lit(0))
    drawn = contributions.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))).withColumn("w", w).filter("w > 0")
    sums = [F.sum(F.col("w") * F.col(c)).alias(c) for c in ("gold_appearances", "TP", "FP", "FN") if c in contributions.columns]
    return drawn.groupBy("iter", *(by or [])).agg(*sums)


def replicate_totals(contributions: DataFrame, drawn: DataFrame, by: list[str]) -> DataFrame:
    """Weighted sums of TP, FP, FN (and support) by replicate and `by`.

    The reports are few against the draws, or the other way round: either side's rows are
    spread over (idx), and sums are partial before they are shuffled."""
    sums = [F.sum(F.col("w") * F.col(c)).alias(c) for c in ("gold_appearances", "TP", "FP", "FN") if c in contributions.columns]
    return drawn.join(contributions, "idx").groupBy("iter", *by).agg(*sums)


def micro_distribution(contributions: DataFrame, drawn: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(iter, by, f1): F1 of each replicate; null without events."""
    t = replicate_totals(contributions, drawn, by or [])
    return t.select("iter", *(by or []), f1_or_null(F.col("TP"), F.col("FP"), F.col("FN")).alias("f1"))


def weighted_distribution(contributions: DataFrame, drawn: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(iter, by, f1): support-weighted mean of feature F1, with support re-estimated in each replicate."""
    by = by or []
    t = replicate_totals(contributions, drawn, [*by, "feature"])
    f1 = f1_or_null(F.col("TP"), F.col("FP"), F.col("FN"))
    sums = t.withColumn("__f", f1).groupBy("iter", *by).agg(F.sum(F.col("__f") * F.col("gold_appearances")).alias("__s"), F.sum("gold_appearances").alias("__g"))
    return sums.select("iter", *by, F.try_divide(F.col("__s"), F.col("__g").cast("double")).alias("f1"))


def any_fp_rate(contributions: DataFrame, drawn: DataFrame) -> DataFrame:
    """(iter, f1): the share of drawn reports with any false positive."""
    flags = contributions.groupBy("idx").agg((F.sum("FP") > 0).cast("int").alias("any"))
    t = drawn.join(flags, "idx").groupBy("iter").agg(F.sum(F.col("w") * F.col("any")).alias("hit"), F.sum("w").alias("n"))
    return t.select("iter", F.try_divide(F.col("hit").cast("double"), F.col("n").cast("double")).alias("f1"))


def interval(c: str = "f1") -> list[Column]:
    """95 % percentile interval over the finite replicates, and their number."""
    finite = F.when(~F.isnan(c), F.col(c))
    q = F.percentile(finite, F.array(F.lit(0.025), F.lit(0.975)))
    return [q[0].alias("ci_low"), q[1].alias("ci_high"), F.count(finite).alias("n_valid")]


def paired_delta(a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Replicate by replicate difference b - a under shared weights."""
    y = b.withColumnRenamed("f1", "__b")
    return a.join(y, ["iter", *(by or [])]).select("iter", *(by or []), (F.col("__b") - F.col("f1")).alias("f1"))


def supported_only(contributions: DataFrame) -> DataFrame:
    """The features that gold supports in the full cohort."""
    good = contributions.groupBy("feature").agg(F.sum("gold_appearances").alias("n")).filter("n > 0").select("feature")
    return contributions.join(good, "feature", "left_semi")


def matrix_distribution(contributions: DataFrame, n: int, iterations: int = ITERATIONS, seed: int = SEED, block: int | None = None) -> DataFrame:
    """R1, R3 with numpy's draws: (iter, f1) of `weights` of one seed; contributions hold idx 0..n-1. Any number of reports (`published_rows`)."""
    spark = contributions.sparkSession
    cells = contributions.select("idx", F.explode(F.array(*[F.struct(F.lit(k).alias("cell"), F.col(c).cast("double").alias("v")) for k, c in enumerate(("TP", "FP", "FN"))])).alias("e")).select("idx", "e.cell", "e.v")
    t = np.zeros((iterations, 3))
    for kinds, values in parts(cut(entries(cells, ["idx"])), n, 3):
        t += replicate_sums(spark, seed, 0, iterations, kinds, values, block)[0]
    f1 = _f1(t)
    return spark.createDataFrame([(k, None if np.isnan(x) else float(x)) for k, x in enumerate(f1)], "iter bigint, f1 double")


def stratified_sample(df: DataFrame, strata: list[str], id_col: str, k: int, seed: int = 7) -> DataFrame:
    """K rows, round-robin over the strata, each stratum in the order of a digest of (seed, id)."""
    from pyspark.sql import Window

    order = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(id_col).cast("string")))
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*strata).orderBy(order, id_col)))
    return ranked.filter(F.col("__rn") <= k).orderBy("__rn", *strata, id_col).limit(k).withColumnRenamed("__rn", "round")
