"""Quality of documents: what a text says, combined with what is known of its site.

A logistic model on surface features gives each text its own evidence. Labels, aggregated by
host and by path, give each site a posterior rate of good documents: a path is shrunk towards
its host and a host towards the corpus, by as many pseudo-documents as the spread of rates
between hosts, and between paths of a host, calls for (empirical Bayes). Evidence and site rate
add up as log odds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentmesh.llm.common import body, fold_of, stable, tidy

#: Labelled rows on which the text model is fitted, at most.
SAMPLE = 20_000
RIDGE = 1e-2
FEATURES = (
    "log_bytes", "upper", "digits", "exclaims", "bars", "other_marks", "not_ascii", "blanks", "line_ends",
    "word_bytes", "long_words", "distinct_words", "commonest_word", "distinct_lines", "stops",
)


def features(text: bytes) -> list[float]:
    """Shares and means that tell prose from shouting, tables, lists and noise; zeros for no text."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    upper, lower, digits, high = count[65:91].sum(), count[97:123].sum(), count[48:58].sum(), count[128:].sum()
    ends, blanks = count[10], count[[9, 11, 12, 13, 32]].sum()
    marks = n - upper - lower - digits - high - ends - blanks
    words = text.lower().split()
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = text.split(b"\n")
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    k = max(1, len(words))
    return [
        float(np.log1p(n)), upper / max(1, upper + lower), digits / n, count[33] / n, count[124] / n,
        (marks - count[33] - count[124] - count[44] - count[46]) / n, high / n, blanks / n, ends / n,
        float(sizes.sum() / k), float((sizes > 20).sum() / k), len(seen) / k, max(seen.values(), default=0) / k,
        len(set(lines)) / len(lines), (count[44] + count[46]) / k,
    ]


def described(docs: DataFrame, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, x): the features of every whole text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py().encode("utf-8", "surrogatepass")) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("doc_id", "host", "path")), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "host", "path", "x"]
            )

    text_of = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(host).alias("host"), text_of(path).alias("path"), body().alias("text"))
    return rows.mapInArrow(tidy(read), "doc_id long, host string, path string, x array<double>")


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Weights and constant of a ridge logistic model, by Newton's method on scaled features."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], RIDGE * len(x) / 100)
    ridge[-1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9), z.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(rate: float, spread: float | None, groups: int, rows: int) -> float:
    """Pseudo-documents of a prior: few if rates differ by more than chance between groups, else many."""
    chance = rate * (1 - rate)
    between = max((spread or 0.0) / rows - chance * groups / rows, chance / 1e6)
    return float(min(max(chance / between - 1, 1.0), 1e6))


def judge(docs: DataFrame, labels: DataFrame, host: Column, path: Column, label: str = "quality") -> DataFrame:
    """The probability that each document is good, from its text and its site.

    ``labels`` has doc_id and ``label`` (1 good, 0 bad; null says nothing; a document labelled
    several times counts with the mean). Documents of fold 1 are held out: their labels teach
    nothing. A document's own label does not count for its own site either. Returns one row per
    input row: doc_id, held_out, evidence (log odds of the text against the corpus), host_rate,
    path_rate, quality (0 to 1), kept (quality at least 0.5). Null text is empty; a null host or
    path is a site of its own. Without labels, or with labels of one kind, evidence is 0. Only
    doc_id, text and the two site expressions are read. An empty table gives an empty result.
    """
    rows = stable(described(docs, host, path), "features")
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    held = F.coalesce(fold_of() == 1, F.lit(False))
    taught = stable(rows.join(known.where(~held), "doc_id").select("doc_id", "host", "path", "x", "y"), "taught")

    drawn = taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("x", "y").toArrow()
    y = drawn.column("y").to_numpy()
    weights, constant = np.zeros(len(FEATURES)), 0.0
    if len(y) and 0 < y.mean() < 1:
        x = np.asarray(drawn.column("x").combine_chunks().flatten()).reshape(len(y), -1)
        weights, constant = fit(x, y)
        constant -= float(np.log(y.mean() / (1 - y.mean())))

    by_path = taught.groupBy("host", "path").agg(F.count("*").alias("n_path"), F.sum("y").alias("s_path"))
    by_host = by_path.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.sum("s_path").alias("s_host"))
    paths = stable(by_path.join(by_host, "host"), "site-counts")
    hosts = paths.select("host", "n_host", "s_host").distinct()
    total = hosts.agg(F.sum("n_host").alias("n"), F.sum("s_host").alias("s"), F.count("*").alias("groups")).head()
    n = total["n"] or 0
    rate = ((total["s"] or 0.0) + 1) / (n + 2)
    share = lambda level: F.col(f"s_{level}") / F.col(f"n_{level}")
    host_spread = hosts.agg(F.sum(F.col("n_host") * (share("host") - rate) ** 2)).head()[0]
    spread = paths.agg(F.sum(F.col("n_path") * (share("path") - share("host")) ** 2), F.count("*")).head()
    of_host = _strength(rate, host_spread, total["groups"], max(n, 1))
    of_path = _strength(rate, spread[0], spread[1], max(n, 1))

    terms = F.zip_with("x", F.lit(weights.tolist()), lambda a, b: a * b)
    evidence = F.aggregate(terms, F.lit(constant), lambda s, t: s + t)
    own = taught.groupBy("doc_id").agg(F.count("*").alias("own_n"), F.first("y").alias("own_y"))
    told = (
        rows.select("doc_id", held.alias("held_out"), "host", "path", evidence.alias("evidence"))
        .join(own, "doc_id", "left")
        .join(hosts, "host", "left")
        .join(by_path, ["host", "path"], "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    lone = F.when(zero("own_n") > 0, 1.0).otherwise(0.0)
    host_rate = (zero("s_host") - lone * zero("own_y") + of_host * rate) / (zero("n_host") - lone + of_host)
    path_rate = (zero("s_path") - lone * zero("own_y") + of_path * F.col("host_rate")) / (zero("n_path") - lone + of_path)
    odds = F.col("evidence") + _logit(F.least(F.greatest("path_rate", F.lit(1e-9)), F.lit(1 - 1e-9)))
    return (
        told.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
        .withColumn("quality", 1 / (1 + F.exp(-odds)))
        .select("doc_id", "held_out", "evidence", "host_rate", "path_rate", "quality", (F.col("quality") >= 0.5).alias("kept"))
    )
