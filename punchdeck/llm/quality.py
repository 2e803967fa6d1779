"""Quality classifier with hierarchical empirical Bayes.

1. Fit, on a bounded sample of labelled rows (``sample`` rows, first by a hash of the id): marker words whose
   document rates differ most between bad and good rows (counted on one half by a grouped aggregation), then a
   logistic regression over style measures and marker counts (on the other half).
2. Score every whole text: the classifier's log-odds less those of its base rate, which is the evidence of the text
   alone.
3. Count over all documents, by grouped aggregation with map-side combine, the expected number of good documents
   of each host and each (host, path); shrink the host's share toward the global one and the path's toward the
   host's. The prior weights are method-of-moments estimates over hosts and over paths.
4. Posterior log-odds = evidence + log-odds of the shrunken share of the document's path, with the document's own
   vote taken out of the counts. A document is kept if the posterior reaches ``keep_at``.

Cases: a null text counts as empty; texts without words have neutral evidence; null hosts and paths are groups of
their own; labels that are null, contradict each other or name unknown documents are not used; without labels
of both kinds the evidence is 0 everywhere and all documents are kept; repeated rows are scored each for itself;
documents of equal posterior are judged alike, one at ``keep_at`` is kept; a very long text is scored whole;
an empty table gives an empty result; other columns are carried along in ``judged``, and ``classify`` puts its own in
the place of columns with their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punchdeck.llm.common import cut, hash_sample, lean, small_batches, text_or_empty, written

SAMPLE = 6_000
MARKERS = 400
WORD = re.compile(r"[^\W_]+")
STYLE = ("letters", "digits", "upper", "odd", "spaces", "distinct", "word_length", "line_repeats", "log_words", "endings")
#: Bound on |evidence|, so that no text outweighs every site.
EVIDENCE = 12.0
#: Rows of the table of paths, about 100 bytes each, up to which it is broadcast.
BROADCAST_PATHS = 100_000


def style(text: str, words: list[str]) -> list[float]:
    n, lines = max(1, len(text)), text.split("\n")
    letters = sum(map(len, words))
    upper = sum(1 for w in words if w.isupper() and len(w) > 1)
    digits = sum(1 for w in words if w[0].isdigit())
    ends = text.count(".") + text.count("?")
    total = max(1, len(words))
    odd = n - letters - text.count(" ") - len(lines) - ends - text.count(",")
    return [letters / n, digits / total, upper / total, odd / n, text.count(" ") / n, len(set(words)) / total**0.8, letters / total, 1 - len(set(lines)) / len(lines), np.log1p(total), ends / total]


@dataclass
class Model:
    markers: dict[str, float] = field(default_factory=dict)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    base: float = 0.0

    def features(self, text: str) -> list[float]:
        words = WORD.findall(text)
        found = Counter(filter(self.markers.__contains__, map(str.lower, words)))
        bad = [self.markers[w] for w in found if self.markers[w] > 0]
        good = [self.markers[w] for w in found if self.markers[w] < 0]
        rate = sum(v for w, v in found.items() if self.markers[w] > 0) / max(20, len(words))
        return [*style(text, words), max(bad, default=0.0), np.log1p(len(bad)), np.sqrt(rate), -sum(good) / 10]

    def evidence(self, texts: list[str]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.zeros(len(texts))
        x = (np.array([self.features(t) for t in texts]) - self.mean) / self.scale
        odds = np.clip(x, -8, 8) @ self.weights[1:] + self.weights[0] - self.base
        return np.where([bool(WORD.search(t)) for t in texts], np.clip(odds, -EVIDENCE, EVIDENCE), 0.0)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights, the intercept first, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled(documents: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` labelled texts with ``good`` and ``half``; the sample's ids are broadcast under that bound."""
    one = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    one = one.filter("q = q2").select("doc_id", ((F.col("q") == 1) & (F.col("t") == 0)).alias("good"))
    chosen = hash_sample(one, sample, "doc_id")
    texts = documents.select("doc_id", text_or_empty("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("good").alias("good")).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, markers: int = MARKERS, least: int = 5) -> Model:
    """The driver receives at most ``markers`` words and, of each sampled row, its features."""
    rows = cut(labelled(documents, labels, sample))
    first = rows.filter("half = 0")
    sizes = {r.good: r.n for r in first.groupBy("good").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(True) or not sizes.get(False):
        return Model()
    words = first.select("good", F.explode(F.array_distinct(F.expr(r"regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1)"))).alias("word"))
    counts = words.groupBy("word").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b")).filter(F.col("g") + F.col("b") >= least)
    score = F.log((F.col("b") + 0.5) / (sizes[False] + 1)) - F.log((F.col("g") + 0.5) / (sizes[True] + 1))
    told = counts.withColumn("score", score).filter("abs(score) > 0.7")
    told = told.orderBy(F.desc(F.abs("score") * F.sqrt(F.col("g") + F.col("b"))), "word").limit(markers)
    model = Model({r.word: float(r.score) for r in told.collect()})

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"good": f["good"].to_numpy(bool), "x": [model.features(t) for t in f["text"]]})

    found = rows.filter("half = 1").select("good", "text").mapInPandas(measure, "good boolean, x array<double>").toPandas()
    if found["good"].nunique() < 2:
        return Model()
    x, y = np.array(found["x"].tolist()), found["good"].to_numpy(float)
    model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    model.weights = logistic(np.clip((x - model.mean) / model.scale, -8, 8), y)
    model.base = float(np.log(y.mean() / (1 - y.mean())))
    return model


def scored(documents: DataFrame, model: Model, text_column: str, carried: Sequence[str], batch: int = 512) -> DataFrame:
    """``(host, path, row, evidence)`` of ``documents(host, path, row)``; ``row`` then holds the columns ``carried`` alone."""
    fields = T.StructType([documents.schema["row"].dataType[c] for c in carried])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, batch):
                part = b.slice(start, batch)
                row = part.column("row")
                texts = [t or "" for t in pc.struct_field(row, [row.type.get_field_index(text_column)]).to_pylist()]
                left = pa.StructArray.from_arrays([pc.struct_field(row, [row.type.get_field_index(c)]) for c in carried], fields=[row.type.field(row.type.get_field_index(c)) for c in carried])
                yield pa.RecordBatch.from_arrays([part.column("host"), part.column("path"), left, pa.array(model.evidence(texts), pa.float64())], names=["host", "path", "row", "evidence"])

    types = T.StructType([documents.schema["host"], documents.schema["path"], T.StructField("row", fields), T.StructField("evidence", T.DoubleType())])
    return documents.mapInArrow(lean(run), types)


def odds(p):
    return F.log(p / (1 - p))


def posterior(votes: DataFrame, rows: DataFrame, prior: float, keep_at: float = 0.5) -> DataFrame:
    """``rows`` and ``votes`` have ``host, path, evidence``; votes: all documents. Adds ``host_share, path_share, posterior, kept``."""
    vote = 1 / (1 + F.exp(-(F.col("evidence") + float(np.log(prior / (1 - prior))))))
    paths = votes.groupBy("host", "path").agg(F.sum(vote).alias("k"), F.count("*").alias("n"))
    paths = cut(paths)  # a row for each path of a site
    hosts = paths.groupBy("host").agg(F.sum("k").alias("hk"), F.sum("n").alias("hn"))
    top = hosts.agg(F.sum("hk"), F.sum("hn")).first()
    mean = min(1 - 1e-6, max(1e-6, (top[0] or 0.0) / (top[1] or 1)))
    weight = lambda df, k, n, m: _weight(df.select(F.avg(F.pow(k / n - m, 2)), F.avg(m * (1 - m) / n), F.avg(m * (1 - m))).first())
    wh = weight(hosts, F.col("hk"), F.col("hn"), F.lit(mean))
    both = paths.join(hosts.withColumnRenamed("host", "h_host"), F.col("host").eqNullSafe(F.col("h_host"))).drop("h_host")
    share = F.least(F.greatest((F.col("hk") + wh * mean) / (F.col("hn") + wh), F.lit(1e-6)), F.lit(1 - 1e-6))
    wp = weight(both, F.col("k"), F.col("n"), share)
    stats = both.select(  # a row for each path, broadcast while there are few
        F.col("host").alias("s_host"), F.col("path").alias("s_path"), "k", "n", "hk", "hn")
    if paths.count() <= BROADCAST_PATHS:
        stats = F.broadcast(stats)
    out = rows.join(stats, F.col("host").eqNullSafe(F.col("s_host")) & F.col("path").eqNullSafe(F.col("s_path"))).drop("s_host", "s_path")
    # without the document's own vote
    h = (F.col("hk") - vote + wh * mean) / (F.col("hn") - 1 + wh)
    out = out.withColumn("host_share", F.least(F.greatest(h, F.lit(1e-4)), F.lit(1 - 1e-4)))
    p = (F.col("k") - vote + wp * F.col("host_share")) / (F.col("n") - 1 + wp)
    out = out.withColumn("path_share", F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))).drop("k", "n", "hk", "hn")
    out = out.withColumn("posterior", 1 / (1 + F.exp(-(F.col("evidence") + odds(F.col("path_share"))))))
    return out.withColumn("kept", F.col("posterior") >= keep_at)


def _weight(found) -> float:
    """Pseudo-count m(1-m)/tau^2 - 1 where tau^2 is the spread of shares beyond that of sampling; within [1, 1000]."""
    if found is None or found[0] is None:
        return 1000.0
    between = max(0.0, found[0] - found[1])
    return float(min(1000.0, max(1.0, found[2] / between - 1))) if between > 0 else 1000.0


def judged(documents: DataFrame, labels: DataFrame, host_column: str = "source", path_column: str = "lang", text_column: str = "text", keep_at: float = 0.5, sample: int = SAMPLE, carried: Sequence[str] | None = None) -> DataFrame:
    """``(row, host, path, evidence, host_share, path_share, posterior, kept)``; ``row`` holds the columns ``carried``, all by default.

    Each text is scored once: the scored rows are written to the shared folder, and the counts read the columns
    that they need of them. Texts are never shuffled while the table of site shares is small enough to be broadcast;
    else that join is shuffled and a hot site is split by adaptive skew handling.
    """
    small_batches(documents.sparkSession)
    model = fit(documents, labels, sample)
    rows = documents.select(F.col(host_column).alias("host"), F.col(path_column).alias("path"), F.struct("*").alias("row"))
    rows = written(scored(rows, model, text_column, list(carried or documents.columns)), "scored")
    prior = float(1 / (1 + np.exp(-model.base)))
    return posterior(rows.select("host", "path", "evidence"), rows, prior, keep_at)


def classify(documents: DataFrame, labels: DataFrame, carried: Sequence[str] | None = None, **options) -> DataFrame:
    """The columns ``carried`` of ``documents``, all by default, with ``evidence, host_share, path_share, posterior, kept``."""
    made = ["evidence", "host_share", "path_share", "posterior", "kept"]
    out = judged(documents, labels, carried=carried, **options)
    return out.select(*(F.col("row")[c].alias(c) for c in carried or documents.columns if c not in made), *made)
