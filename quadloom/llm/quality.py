"""Operator 2: a regularised quadratic discriminant over transformed document statistics.

Every whole text gives a short vector of log-scaled statistics. Class means and covariances come from sums over all labelled
training rows; covariances are shrunk towards the pooled one and towards a multiple of the identity. A score compares the two
classes' log densities, whose Mahalanobis distances use the inverses of cached Cholesky factors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm.common import saved, slices, small_batches, table, text_of

#: Share of the pooled covariance in each class's, and of the identity (times the mean variance) in the result.
POOLED, RIDGE = 0.1, 0.02
#: Ratios are taken as log(ratio + FLOOR).
FLOOR = 0.01
#: A log-density difference of SCALE gives a score of 0.75; scores stay apart however far the difference goes.
SCALE = 8.0
N_FEATURES = 15
#: Differences are counted up to this when the cut is chosen.
LIMIT = 400
#: Added to the denominators of repetition ratios, so that one repeat in a short text says little.
FEW_WORDS, FEW_LINES = 50, 10


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text; an empty text has those of no words."""
    raw = np.frombuffer(text.encode(), np.uint8)
    count = np.bincount(raw, minlength=256)
    words = text.split()
    n, w = max(1, len(text)), max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    seen: dict[str, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    letters = max(1, n - int(count[:65].sum()))
    of = lambda s: int(count[list(s.encode())].sum())
    ratios = (
        of("#*$%&") / w,
        of("|<>=_~^\\{}[]") / w,
        of("!?") / w,
        of(".") / w,
        of(",;:") / w,
        int(count[48:58].sum()) / n,
        int(count[65:91].sum()) / letters,
        int((raw >= 192).sum()) / n,
        1 - len(seen) / w,
        max(seen.values(), default=0) / w,
        (len(words) - 1 - pairs) / (w + FEW_WORDS),
        (len(lines) - len(set(lines))) / (len(lines) + FEW_LINES),
    )
    return [float(np.log1p(len(words))), float(np.log1p(len(text) / w)), float(np.log1p(w / max(1, len(lines)))), *(float(np.log(max(0.0, x) + FLOOR)) for x in ratios)]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, x: the statistics of each row's whole text (null: empty). No other column is read."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("x", T.ArrayType(T.DoubleType(), False))])

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "x"])

    return small_batches(docs).select("doc_id", text_of(docs).alias("text")).mapInArrow(run, schema)


@dataclass
class Model:
    """Per class: prior log share, mean, inverse Cholesky factor and log determinant. None of it grows with the input."""

    log_prior: list[float]
    mean: list[np.ndarray]
    whiten: list[np.ndarray]
    log_det: list[float]
    #: Added to the differences, so that 0 is where the training rows are told apart best.
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density times prior of class 1 less that of class 0."""
        out = [p - 0.5 * (((x - m) @ w.T) ** 2).sum(1) - 0.5 * d for p, m, w, d in zip(self.log_prior, self.mean, self.whiten, self.log_det, strict=True)]
        return out[1] - out[0] + self.shift

    def score(self, x: np.ndarray) -> np.ndarray:
        d = self.difference(x)
        return 0.5 + 0.5 * d / (SCALE + np.abs(d))


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = POOLED, ridge: float = RIDGE) -> Model | None:
    """sums: per class its rows, sum of vectors, sum of outer products. None unless both classes have rows."""
    if any(sums.get(c, (0,))[0] < 1 for c in (0, 1)):
        return None
    total = sum(sums[c][0] for c in (0, 1))
    mean = [sums[c][1] / sums[c][0] for c in (0, 1)]
    scatter = [sums[c][2] - sums[c][0] * np.outer(mean[c], mean[c]) for c in (0, 1)]
    common = (scatter[0] + scatter[1]) / total
    whiten, log_det = [], []
    for c in (0, 1):
        s = (1 - pooled) * scatter[c] / sums[c][0] + pooled * common
        s = (1 - ridge) * s + ridge * max(np.trace(s) / len(s), 1e-6) * np.eye(len(s))
        low = np.linalg.cholesky(s)
        whiten.append(np.linalg.inv(low))
        log_det.append(2 * float(np.log(np.diag(low)).sum()))
    return Model([float(np.log(sums[c][0] / total)) for c in (0, 1)], mean, whiten, log_det)


def best_shift(counts: dict[int, tuple[int, int]]) -> float:
    """counts: rows of class 0 and 1 by floor(difference). The shift with the fewest training errors, mid-way between equals."""
    lowest, highest = min(counts), max(counts) + 1
    errors, best = sum(counts[k][0] for k in counts), []  # with everything predicted 1
    least = errors
    for cut in range(lowest, highest + 1):
        if cut > lowest:
            below = counts.get(cut - 1, (0, 0))
            errors += below[1] - below[0]
        if errors < least:
            least, best = errors, []
        if errors == least:
            best.append(cut)
    return -sum(best) / len(best)


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is kept from learning: crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(vectors: DataFrame, labels: DataFrame) -> Model | None:
    """The model of all labelled rows that are not held out; each label row counts, rows with null ids or labels do not."""

    def moments(batches):
        import pyarrow as pa

        sums: dict = {}
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            q = batch.column(0).to_numpy()
            for c in np.unique(q):
                own = x[q == c]
                new = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
                sums[int(c)] = sums.get(int(c), 0) + new
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], ["quality", "m"])

    known = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    rows = vectors.join(known, "doc_id").where(~held_out(F.col("doc_id"))).select("quality", "x")
    parts = rows.mapInArrow(moments, "quality int, m array<double>")
    got = parts.select("quality", F.posexplode("m").alias("i", "v")).groupBy("quality", "i").agg(F.sum("v").alias("v")).collect()  # 2 x (1 + k + k^2) numbers
    flat: dict[int, dict[int, float]] = {}
    for c, i, v in got:
        flat.setdefault(c, {})[i] = v
    sums = {}
    for c, own in flat.items():
        m = np.array([own[i] for i in range(len(own))])
        sums[c] = (m[0], m[1 : 1 + N_FEATURES], m[1 + N_FEATURES :].reshape(N_FEATURES, N_FEATURES))
    model = fit(sums)
    if model is None:
        return None

    def differences(batches):
        import pyarrow as pa

        for batch in batches:
            d = np.clip(np.floor(model.difference(np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, N_FEATURES))), -LIMIT, LIMIT)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d.astype(np.int32))], ["quality", "d"])

    counts: dict[int, list[int]] = {}
    for c, d, n in rows.mapInArrow(differences, "quality int, d int").groupBy("quality", "d").count().collect():  # at most 4 LIMIT + 2 rows
        counts.setdefault(d, [0, 0])[c] += n
    model.shift = best_shift(counts)
    return model


def score(vectors: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score of each row of `vectors`; 0.5 where there was nothing to learn from."""
    schema = T.StructType([vectors.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x) if model else np.full(len(x), 0.5))], ["doc_id", "score"])

    return vectors.select("doc_id", "x").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; repeated rows repeat, rows with a null id are scored as well. Null texts
    are empty. A document with several label rows counts once for each of them."""
    vectors = saved(features(docs))
    scored = score(vectors, train(vectors, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted 1, columns as they are. Texts are scored where they lie, so none is shuffled.

    Null and empty texts are scored as texts without words, rows with a null id like others; repeated rows go or stay together. A score
    of exactly 0.5 counts as 1, so all rows stay where there was nothing to learn from.
    """
    model = train(saved(features(docs.join(labels.where("quality in (0, 1)").select("doc_id").distinct(), "doc_id", "left_semi"))), labels)
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [statistics(t or "") for t in batch.column(at).to_pylist()]
            good = model.score(np.array(rows).reshape(-1, N_FEATURES)) >= 0.5 if model else np.ones(len(rows), bool)
            yield batch.filter(pa.array(good))

    return small_batches(docs).mapInArrow(run, schema)


def op2_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
