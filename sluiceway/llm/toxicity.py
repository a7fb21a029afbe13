"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are the distinct hashed words and word beginnings of a text, each scaled by the log ratio of
its document frequencies in toxic and other sample rows and by the size of the text's feature set.
One weight vector serves all thresholds: P(grade >= k) = sigmoid(w.x - t_k) with t_1 < t_2 < ...; the expected severity is the
sum of these probabilities. The fit uses a bounded, stratified sample of the labelled rows, weighted
back to all of them; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluiceway.llm import textops
from sluiceway.llm.common import quoted, text_of

FEATURE_BITS = 18
STEMS = (4, 5, 6)
SAMPLE_PER_GRADE = 2500
REJECT_FROM = 0.3
SMOOTHING = 3.0
#: Entries of the sample matrix that the fit expands at a time, to wide index and product arrays.
ENTRIES_AT_ONCE = 1 << 19


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray  # float32, one per hashed feature
    thresholds: np.ndarray  # float64, increasing; one per grade above 0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers, ``1 + len(STEMS)`` for every word (short words repeat themselves), and the
    texts' word offsets."""
    starts, ends, words = textops.word_spans(data, offsets)
    prefix = textops.prefix_hash(textops.lower(data))
    shift = np.uint64(64 - FEATURE_BITS)
    columns = [textops.span_hash(prefix, starts, ends)]
    for k, stem in enumerate(STEMS):
        cut = np.minimum(starts + stem, ends)
        columns.append(textops.mix(textops.span_hash(prefix, starts, cut) + np.uint64(k + 1)))
    return (np.stack(columns, axis=1) >> shift).astype(np.int32), words


def presence(features_in_text: np.ndarray | int) -> np.ndarray | float:
    """Value of a feature in a text with so many distinct ones: long texts don't outweigh others."""
    return 8.0 / np.sqrt(features_in_text + 20.0)


def _row_blocks(rows: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to ``ENTRIES_AT_ONCE`` entries; a longer row is a range of its own."""
    lo = 0
    while lo < len(rows) - 1:
        hi = int(np.searchsorted(rows, rows[lo] + ENTRIES_AT_ONCE, side="right")) - 1
        hi = max(hi, lo + 1)
        yield lo, hi
        lo = hi


def log_ratio(numbers: np.ndarray, rows: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """Smoothed log ratio of every feature's document frequency above grade 0 and in grade 0."""
    size = 1 << FEATURE_BITS
    n_toxic, n_clean = int((grades > 0).sum()), int((grades == 0).sum())
    high, low = np.full(size, SMOOTHING), np.full(size, SMOOTHING)
    for lo, hi in _row_blocks(rows):
        part = numbers[rows[lo] : rows[hi]]
        toxic = np.repeat(grades[lo:hi] > 0, np.diff(rows[lo : hi + 1]))
        high += np.bincount(part[toxic], minlength=size)
        low += np.bincount(part[~toxic], minlength=size)
    return np.log(high / (n_toxic + 2 * SMOOTHING)) - np.log(low / (n_clean + 2 * SMOOTHING))


def fit(numbers: np.ndarray, values: np.ndarray, rows: np.ndarray, grades: np.ndarray,
        row_weights: np.ndarray, top: int, steps: int = 60, l2: float = 1e-4) -> OrdinalModel:
    """Weighted maximum likelihood by Adam over a sparse matrix in row order.

    ``rows`` are the n + 1 offsets of the rows' entries, which are expanded in blocks of rows only. The
    gap between thresholds stays positive
    by its logarithm; a grade nobody has is held near its neighbour's threshold by the penalty.
    """
    size, n = 1 << FEATURE_BITS, len(grades)
    w, base, gaps = np.zeros(size), np.zeros(1), np.zeros(max(top - 1, 0))
    if n == 0:
        return OrdinalModel(w.astype(np.float32), np.full(top, 4.0) + np.arange(top))
    seen = np.zeros(size, bool)
    seen[numbers] = True
    used = np.flatnonzero(seen)
    place = np.zeros(size, np.int32)
    place[used] = np.arange(len(used))
    local = place[numbers]
    blocks, lengths = list(_row_blocks(rows)), np.diff(rows)
    share = row_weights / row_weights.sum()
    above = (grades[:, None] >= np.arange(1, top + 1)[None, :]).astype(float)
    w = np.zeros(len(used))
    parts = [w, base, gaps]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
    for step in range(1, steps + 1):
        score = np.zeros(n)
        for lo, hi in blocks:
            own = slice(rows[lo], rows[hi])
            owner = np.repeat(np.arange(hi - lo), lengths[lo:hi])
            score[lo:hi] = np.bincount(owner, values[own] * w[local[own]], hi - lo)
        limits = base[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        reach = 1.0 / (1.0 + np.exp(-np.clip(score[:, None] - limits[None, :], -40, 40)))
        # P(grade = k) is a difference of neighbouring reaches.
        edge = np.concatenate([np.ones((n, 1)), reach, np.zeros((n, 1))], axis=1)
        p = np.take_along_axis(edge, grades[:, None], 1) - np.take_along_axis(
            edge, grades[:, None] + 1, 1)
        p = np.maximum(p[:, 0], 1e-12)
        slope = reach * (1 - reach)
        own = np.zeros((n, top))
        index = np.arange(n)
        has_low, has_up = grades > 0, grades < top
        own[index[has_low], grades[has_low] - 1] += slope[index[has_low], grades[has_low] - 1]
        own[index[has_up], grades[has_up]] -= slope[index[has_up], grades[has_up]]
        pull = own / p[:, None] * share[:, None]  # d log-likelihood / d (score - limit)
        d_score = pull.sum(axis=1)
        d_limit = -pull.sum(axis=0)
        towards = np.zeros(len(used))
        for lo, hi in blocks:
            own = slice(rows[lo], rows[hi])
            np.add.at(towards, local[own], values[own] * np.repeat(d_score[lo:hi], lengths[lo:hi]))
        grads = [
            -towards + l2 * w,
            np.array([-d_limit.sum()]),
            -np.array([d_limit[k + 1 :].sum() for k in range(len(gaps))]) * np.exp(gaps)
            + 1e-3 * gaps if len(gaps) else gaps,
        ]
        rate = 0.02 / (1 + step / 100)
        for part, grad, (m, v) in zip(parts, grads, moments, strict=True):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad * grad
            part -= (rate if part is w else 5 * rate) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    del above
    full = np.zeros(size, np.float32)
    full[used] = w
    return OrdinalModel(full, base[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def severity_grade(toxic: str = "toxic", quality: str = "quality") -> Column:
    """Severity of a label: 0 not toxic, 1 toxic in good text, 2 toxic in low-quality text."""
    return F.when(quoted(toxic) > 0, 2 - F.coalesce(quoted(quality), F.lit(1))).otherwise(0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          grade: Column | None = None, top: int = 2, per_grade: int = SAMPLE_PER_GRADE,
          seed: int = 7) -> OrdinalModel:
    """Fits on at most ``per_grade`` labelled documents of each grade, chosen by a seeded hash.

    The counts that weight the sample back come from all labels. Labels without a document, null
    ids and null toxicity are left out; of several labels of one document the severest counts.
    """
    grade = severity_grade() if grade is None else grade
    who = docs.select(quoted(id_col).alias("_id")).distinct()
    graded = (
        labels.filter(quoted("toxic").isNotNull()).groupBy(quoted(id_col).alias("_id"))
        .agg(F.max(grade).cast("int").alias("_grade")).join(who, "_id", "left_semi")
    )
    counts = {r._grade: r["count"] for r in graded.groupBy("_grade").count().collect()}
    order = F.xxhash64(F.lit(seed), "_id")
    picked = None
    for g in sorted(counts):
        part = graded.filter(F.col("_grade") == g).orderBy(order, "_id").limit(per_grade)
        picked = part if picked is None else picked.union(part)
    if picked is None:
        empty = np.empty(0)
        return fit(empty, empty, np.zeros(1, int), empty.astype(int), empty, top)
    texts = docs.select(quoted(id_col).alias("_id"), text_of(text_col).alias("_text"))
    sample = texts.join(F.broadcast(picked), "_id").dropDuplicates(["_id"])
    sparse = sample.select("_grade", "_text").mapInArrow(
        _entries, "_grade int, numbers array<int>, share float"
    ).toArrow()
    grades = sparse["_grade"].to_numpy().astype(int)
    numbers = sparse["numbers"].combine_chunks()
    rows = np.concatenate([[0], np.cumsum(numbers.value_lengths().to_numpy().astype(np.int64))])
    shares = sparse["share"].to_numpy().astype(np.float64)
    drawn = np.bincount(grades, minlength=top + 1)
    back = np.array([counts.get(g, 0) / max(drawn[g], 1) for g in range(top + 1)])
    flat = numbers.flatten().to_numpy()
    del sparse, numbers
    ratio = log_ratio(flat, rows, grades)
    values = ratio[flat]
    values *= np.repeat(shares, np.diff(rows))
    model = fit(flat, values, rows, grades, back[grades], top)
    return OrdinalModel((model.weights * ratio).astype(np.float32), model.thresholds)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = textops.batch_bytes(batch.column(1))
        numbers = []
        for lo, hi in textops.slices(offsets, textops.SHORT_SLICE_BYTES):
            part = data[offsets[lo] : offsets[hi]]
            found, words = features(part, offsets[lo : hi + 1] - offsets[lo])
            for i in range(hi - lo):
                own = np.unique(found[words[i] : words[i + 1]])
                numbers.append(own)
        shares = presence(np.array([len(own) for own in numbers], np.int64)).astype(np.float32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(numbers, pa.list_(pa.int32())), pa.array(shares)],
            ["_grade", "numbers", "share"])


def reaches(column: pa.Array, model: OrdinalModel) -> np.ndarray:
    """P(grade >= k) of every text of a batch, one column per threshold."""
    data, offsets = textops.batch_bytes(column)
    sums = np.zeros(len(offsets) - 1)
    for lo, hi in textops.slices(offsets, textops.SHORT_SLICE_BYTES):
        part = data[offsets[lo] : offsets[hi]]
        found, words = features(part, offsets[lo : hi + 1] - offsets[lo])
        for i in range(hi - lo):
            own = np.sort(found[words[i] : words[i + 1]], axis=None)
            own = own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
            sums[lo + i] = model.weights[own].sum(dtype=np.float64) * presence(len(own))
    return 1.0 / (1.0 + np.exp(-np.clip(sums[:, None] - model.thresholds[None, :], -40, 40)))


def _scorer(model: OrdinalModel):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reach = reaches(batch.column(batch.num_columns - 1), model)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(reach.sum(axis=1)), pa.array(reach[:, 0]),
                 pa.array((reach >= 0.5).sum(axis=1).astype(np.int32))],
                [*batch.schema.names[:-1], "expected_severity", "p_toxic", "severity_grade"])

    return score


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id",
          text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Row by row: the id, the ``keep`` columns, expected_severity, p_toxic and severity_grade.

    Null and empty texts have no features and score the thresholds alone. Nothing is shuffled.
    """
    columns = list(dict.fromkeys([id_col, *keep]))
    read = docs.select(*[quoted(c) for c in columns], text_of(text_col).alias("_scored_text"))
    fields = StructType([f for f in read.schema.fields if f.name != "_scored_text"])
    schema = (fields.add("expected_severity", "double").add("p_toxic", "double")
              .add("severity_grade", "integer"))
    return read.mapInArrow(_scorer(model), schema)


def keep_clean(docs: DataFrame, model: OrdinalModel, text_col: str = "text",
               reject_from: float = REJECT_FROM) -> DataFrame:
    """The documents whose probability of any toxicity is below ``reject_from``, all columns as is.

    Only texts go to Python, and one flag a row comes back: rows with whole texts are not sent back.
    """
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array(reaches(texts, model)[:, 0] < reject_from)

    return docs.filter(clean(text_of(text_col)))
