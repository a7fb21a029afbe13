"""Resampling towards a target distribution by hashed n-grams.

A text is normalised to its words, joined by one space, and scanned once for running CRCs. The CRC of
any n-gram follows from the two running CRCs at its ends: CRC is linear over GF(2), so shifting the
earlier one over the n-gram's length (a product of per-bit operators) and adding it cancels all that
stands before. N-grams of any length cost the same and none is ever built.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import quoted, ranked, split_count, text_of
from sluiceway.llm.textops import SLICE_BYTES, batch_bytes, lower, slices
from sluiceway.sources import lineage_cut

ROWS_PER_PART = 1_000_000


@dataclass(frozen=True)
class Rule:
    """Features are runs of 1 to ``grams`` words; ``percent`` of the texts of ``least_words`` or
    more are drawn."""

    grams: int = 1
    buckets: int = 10_000
    seed: int = 2024
    least_words: int = 20
    percent: int = 10


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text: str = "text", rule: Rule | None = None) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank), one row per document, undrawn ones too.

    ``weight`` is the floored mean of the bucket gains of a text's features, ``score`` adds Gumbel
    noise that follows from seed and id, ``rank`` counts the drawn texts from 1 by falling score,
    ties by rising id; it is null for the others. Null texts have no words and weight 0. Null ids
    count as no digits in the noise and come first among ties. Repeated rows are ranked one by one.
    An empty target gives all features the gain of unseen ones. Other columns are not looked at. A
    very long text is worked on in pieces.
    """
    rule = rule or Rule()
    gain = gain_array(bucket_gains(docs, target, text_col, target_text, rule), rule)
    read = docs.select(quoted(id_col).alias("id"), text_of(text_col).alias("text"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            words, features, total = (np.zeros(rows, np.int64) for _ in range(3))
            for owner, size, bucket in feature_buckets(batch.column("text"), rule):
                counts = np.bincount(owner, minlength=rows)
                features += counts
                if size == 1:
                    words += counts
                # Whole numbers, summed for one piece: exact in doubles.
                total += np.bincount(owner, gain[bucket], rows).astype(np.int64)
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(words), pa.array(features), pa.array(weight)],
                ["id", "n_words", "n_features", "weight"])

    id_type = read.schema["id"].dataType.simpleString()
    weighed = read.mapInArrow(weigh, f"id {id_type}, n_words long, n_features long, weight long")
    able = F.col("n_words") >= rule.least_words
    score = F.col("weight") + gumbel(F.col("id"), rule.seed)
    # One order over all rows: those that may be drawn first, by falling score.
    scored = lineage_cut(weighed.select("*", score.alias("score")).select(
        "*", F.when(able, 0).otherwise(1).alias("_late"), (-F.col("score")).alias("_down")))
    n = scored.agg(F.count_if(F.col("_late") == 0).alias("able"), F.count("*").alias("all")).first()
    place = ranked(scored, ["_late", "_down", "id"], split_count(scored, ROWS_PER_PART, n["all"]),
                   "_place")
    drawn = F.col("_place") < rule.percent * n["able"] // 100
    return place.select("id", "n_words", "n_features", "weight", "score",
                        F.when(drawn, F.col("_place") + 1).alias("rank"))


def gumbel(id_: Column, seed: int) -> Column:
    """Whole thousandths of standard Gumbel noise from sha256 of ``seed:id``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def bucket_counts(df: DataFrame, text_col: str, rule: Rule) -> DataFrame:
    """(bucket, n) of all features of all texts; a task gives each bucket once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(rule.buckets, np.int64)
        for batch in batches:
            for _, _, bucket in feature_buckets(batch.column("text"), rule):
                total += np.bincount(bucket, minlength=rule.buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    counted = df.select(text_of(text_col).alias("text")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str, target_text: str,
                 rule: Rule) -> DataFrame:
    """(bucket, gain): floored thousandths of the log ratio of smoothed shares, for all buckets."""
    both = bucket_counts(docs, text_col, rule).withColumnRenamed("n", "s").join(
        bucket_counts(target, target_text, rule).withColumnRenamed("n", "t"), "bucket", "full"
    )
    spark = docs.sparkSession
    all_ = spark.range(rule.buckets).withColumnRenamed("id", "bucket").join(both, "bucket", "left")
    all_ = lineage_cut(all_.na.fill(0, ["s", "t"]))
    sums = all_.agg(F.sum("s").cast("double").alias("S"), F.sum("t").cast("double").alias("T")).first()
    smooth = float(rule.buckets)
    ratio = ((F.col("t") + 1).cast("double") * F.lit(sums["S"] + smooth)) / (
        (F.col("s") + 1).cast("double") * F.lit(sums["T"] + smooth))
    return all_.select("bucket", "s", "t", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def gain_array(gains: DataFrame, rule: Rule) -> np.ndarray:
    """The gains by bucket; their number is a parameter, so they go through the driver."""
    out = np.zeros(rule.buckets)
    for row in gains.select("bucket", "gain").collect():
        out[row["bucket"]] = row["gain"]
    return out


# --- kernels ---------------------------------------------------------------------------------

_POLYNOMIAL = 0xEDB88320
_LANE = 256
# Between words: all ASCII characters but digits and lower-case letters.
_APART = np.zeros(256, bool)
_APART[:0x80] = True
_APART[0x30:0x3A] = _APART[0x61:0x7B] = False


def _byte_steps() -> np.ndarray:
    code = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        code = (code >> np.uint32(1)) ^ (np.uint32(_POLYNOMIAL) * (code & np.uint32(1)))
    return code


_STEP = _byte_steps()


def _operators(bits: int) -> np.ndarray:
    """``[k, i, v]``: byte i of a CRC with value v, shifted over 2^k zero bytes."""
    value = np.arange(256, dtype=np.uint32)
    places = [value << np.uint32(8 * i) for i in range(4)]
    out = np.empty((bits, 4, 256), np.uint32)
    out[0] = [_STEP[p & np.uint32(255)] ^ (p >> np.uint32(8)) for p in places]
    for k in range(1, bits):
        out[k] = [_apply(out[k - 1], _apply(out[k - 1], p)) for p in places]
    return out


def _apply(operator: np.ndarray, code: np.ndarray) -> np.ndarray:
    low = np.uint32(255)
    return (operator[0][code & low] ^ operator[1][(code >> np.uint32(8)) & low]
            ^ operator[2][(code >> np.uint32(16)) & low] ^ operator[3][code >> np.uint32(24)])


_SHIFT = _operators(32)


def shifted(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Every CRC after as many zero bytes as its length says."""
    out = codes.copy()
    longest = int(lengths.max(initial=0))
    for bit in range(longest.bit_length()):
        at = np.flatnonzero(lengths >> bit & 1)
        out[at] = _apply(_SHIFT[bit], out[at])
    return out


def running_crcs(stream: np.ndarray, places: np.ndarray) -> np.ndarray:
    """CRC (of zero start, not inverted) of the first ``place`` bytes, for each place.

    The stream is scanned once, as lanes side by side; what stands before a lane is summed up over
    the lanes in doubling steps and shifted to the places that are asked for.
    """
    lanes = -(-len(stream) // _LANE) or 1
    columns = np.zeros(lanes * _LANE, np.uint8)
    columns[: len(stream)] = stream
    columns = np.ascontiguousarray(columns.reshape(lanes, _LANE).T)
    local = np.empty((_LANE, lanes), np.uint32)
    code = np.zeros(lanes, np.uint32)
    for k in range(_LANE):
        code = _STEP[(code ^ columns[k]) & np.uint32(255)] ^ (code >> np.uint32(8))
        local[k] = code
    total = code.copy()
    reach, bit = 1, _LANE.bit_length() - 1
    while reach < lanes:
        total[reach:] ^= _apply(_SHIFT[bit], total[:-reach])
        reach, bit = 2 * reach, bit + 1
    before = np.concatenate([np.zeros(1, np.uint32), total[:-1]])
    lane, k = np.divmod(np.maximum(places - 1, 0), _LANE)
    out = local[k, lane] ^ shifted(before[lane], k + 1)
    out[places == 0] = 0
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of lower-cased bytes, and the offsets of the texts' words."""
    inside = ~_APART[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def gram_codes(data: np.ndarray, offsets: np.ndarray, grams: int, skip: int = 0
               ) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(text numbers, words, CRCs) of all n-grams by size; those within the first ``skip`` words
    are left out."""
    data = lower(data)
    starts, ends, texts = words(data, offsets)
    if not len(starts):
        return
    length = ends - starts
    end = np.cumsum(length + 1) - 1
    start = end - length
    stream = np.full(int(end[-1]), 0x20, np.uint8)
    stream[np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)] = data[
        ~_APART[data]]
    at_start, at_end = running_crcs(stream, start), running_crcs(stream, end)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(texts))
    ones = np.uint32(0xFFFFFFFF)
    for size in range(1, grams + 1):
        i = np.flatnonzero(owner[: len(owner) - size + 1] == owner[size - 1 :])
        i = i[i + size - 1 >= skip]
        j = i + size - 1
        code = at_end[j] ^ shifted(at_start[i] ^ ones, end[j] - start[i]) ^ ones
        yield owner[i], size, code


def _pieces(data: np.ndarray, offsets: np.ndarray, grams: int
            ) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """A slice as it is, or one long text in pieces that end between words.

    Each piece begins with the last words of the one before, as many as an n-gram may reach back,
    and comes with their number.
    """
    if len(offsets) > 2 or len(data) <= 2 * SLICE_BYTES:
        yield data, offsets, 0
        return
    back, skip, fresh = 0, 0, 0
    while fresh < len(data):
        stop = min(fresh + SLICE_BYTES, len(data))
        while stop < len(data) and not _APART[lower(data[stop - 1 : stop])[0]]:
            stop += 1
        piece = data[back:stop]
        yield piece, np.array([0, len(piece)]), skip
        starts, _, _ = words(lower(piece), np.array([0, len(piece)]))
        skip = min(grams - 1, len(starts))
        back = back + int(starts[-skip]) if skip else stop
        fresh = stop


def feature_buckets(column: pa.Array, rule: Rule) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(row numbers, words, buckets) of the features of a column of texts, piece by piece."""
    data, offsets = batch_bytes(column)
    for lo, hi in slices(offsets):
        own = offsets[lo : hi + 1] - offsets[lo]
        for piece, ends, skip in _pieces(data[offsets[lo] : offsets[hi]], own, rule.grams):
            for owner, size, code in gram_codes(piece, ends, rule.grams, skip):
                yield lo + owner, size, code % np.uint32(rule.buckets)
