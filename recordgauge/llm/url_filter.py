"""URL filter: rules first, then logistic regression on hashed character n-grams.

Each URL is split into host (lower-cased) and path. The longest rule whose host is the URL's
host or a parent domain of it, and whose path starts the URL's path, decides. Otherwise a
logistic regression over hashed character 3- to 5-grams of host and path decides, trained
on `TRAINING`, a small labelled table of invented URLs in this module (the test data have no
URL labels).

Training is a few hundred numpy steps on the driver; the weights (2**12 doubles, a fixed
32 kB) travel with the function. Scoring is one Arrow pass over the url column, no shuffle.

Defined cases: a null URL, or one without '://', has an empty host and path, and goes to the
model like any other (an all-zero row: the bias decides, which comes out as allow); a URL of
any length is read whole; repeated rows are judged alike; other columns pass through
`judge_urls`, but those named like one of its results give way to it; an empty table gives
an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordgauge.llm.line_dedup import LOWER, UPPER

BITS, GRAMS = 12, (3, 4, 5)
#: (host, path, verdict); the host is matched with all its subdomains.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Host stems of the labelled table, none of them a host or a word of the test tables; each stands in a few URL shapes.
BAD = "hot-deals quick-loans diet-miracle clone-phones link-exchange best-casino lucky-slots pills-online win-cash bet-now poker-bonus adserver click-track popup-ads loan-fast replica-watches viagra-shop seo-links spamlinks free-money cash-farm track-pixel banner-ads slots-win meds-cheap".split()
GOOD = "news.library garden history.museum weather kitchen.recipes school.math river.travel open.data health.care astronomy city.council music.archive bakery orchard lighthouse harbour meadow clinic theatre weaving pottery kindergarten cathedral botany mountains wikitext poetry.review science.daily local.paper farmers.market books.corner thenews homepage forum.club library.archive railway.history gardening.tips photo.album village.school hiking.trails choir.notes chess.club bird.watch parents.guide".split()
SHAPES = ("www.{}.example.com/en/12", "{}.example.org/de/401.html", "m.{}.example.net/es/7/", "blog.{}.example.com/fr/933", "{}.example.org/en/58")


def training_table() -> list[tuple[str, str, int]]:
    """(host, path, 1 to block): 345 rows, from the lists above."""
    rows = []
    for label, stems in ((1, BAD), (0, GOOD)):
        for stem in stems:
            for shape in SHAPES:
                host, _, path = shape.format(stem).partition("/")
                rows.append((host, f"/{path}", label))
    return rows


def gram_ids(host: str, path: str) -> list[int]:
    """Buckets of the distinct n-grams; host and path grams are kept apart."""
    out = set()
    for side, text in (("h", f"^{host}$" if host else ""), ("p", f"^{path}$" if path else "")):
        data = text.encode()
        for n in GRAMS:
            for i in range(len(data) - n + 1):
                out.add(zlib.crc32(data[i : i + n], ord(side)) & (2**BITS - 1))
    return sorted(out)


def train(rows: list[tuple[str, str, int]], steps: int = 400, rate: float = 2.0, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    x = np.zeros((len(rows), 2**BITS))
    for k, (host, path, _) in enumerate(rows):
        ids = gram_ids(host, path)
        x[k, ids] = 1 / np.sqrt(max(1, len(ids)))
    y = np.array([r[2] for r in rows], dtype=float)
    w, b = np.zeros(2**BITS), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        w -= rate * (x.T @ (p - y) / len(y) + l2 * w)
        b -= rate * float(np.mean(p - y))
    return w, b


def split_url(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url)))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's name and verdict, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, f"{h}{p}").otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def judge_urls(df: DataFrame, url: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """`df` with __host, __path, __rule, __score (of the model) and __verdict."""
    weights, bias = train(training_table())
    host, path = split_url(F.col(url))

    @F.pandas_udf("double")
    def score(hosts, paths):
        import pandas as pd

        out = []
        for h, p in zip(hosts, paths, strict=True):
            ids = gram_ids(h, p)
            z = bias + (weights[ids].sum() / np.sqrt(len(ids)) if ids else 0.0)
            out.append(float(1 / (1 + np.exp(-z))))
        return pd.Series(out, dtype="float64")

    parts = df.drop("__host", "__path", "__rule", "__ruled", "__score", "__verdict").withColumns({"__host": host, "__path": path})
    name, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    parts = parts.withColumns({"__rule": name, "__ruled": verdict, "__score": score("__host", "__path")})
    by_model = F.when(F.col("__score") >= threshold, "block").otherwise("allow")
    return parts.withColumn("__verdict", F.coalesce("__ruled", by_model)).drop("__ruled")


def op10(pages: DataFrame) -> DataFrame:
    judged = judge_urls(pages.select("page_id", "url"))
    return judged.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict"), F.round("__score", 6).alias("score"))
