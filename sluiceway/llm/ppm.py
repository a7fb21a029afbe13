"""Language-model scores by prediction by partial matching over bytes.

The trie of byte contexts is kept as one table per order in the shared folder, a row for each context: a
gram is a context and the byte that followed it, in one integer. A byte is predicted by the longest known
context; if it was never seen there, the model escapes to the next shorter one (escape estimate D: every
symbol seen gives half a count to what was not seen), where the symbols of the longer context are
excluded. The model is trained on all training texts and then fixed, and no gram is left out of it; what
depends on the context alone is summed up along the suffixes in advance.

The probability of a byte depends on its code alone. Tasks hold the values of the most frequent quarter
of the grams, up to a bound; all other codes are collected per text, scored once each by joins with the
tables of all orders, and summed up per text. How many grams tasks hold changes no result, and as it is
a share of them, what is left to the joins grows with the input.

Texts are worked on in slices, a long one in pieces, so that a task holds arrays of a piece only.

Texts are modelled as their lower-cased words, each followed by a space, the last by the end symbol,
a byte that UTF-8 never uses. So the score is comparable with the word base, which adds one to the
counts of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from sluiceway.llm import textops
from sluiceway.llm.common import quoted, text_of
from sluiceway.sources import lineage_cut

ORDER = 5
KNOWN_SHARE = 4  # every task holds the values of one gram, and the count of one word, in so many
KNOWN_MOST = 1 << 20  # but not more than so many
TALLY_SYMBOLS = 1 << 23  # counted together in a task
TALLY_CODES = 1 << 21  # different codes a task holds before it hands them on
END = 0xFF
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Lookup:
    """Open-addressing hash table from codes to row numbers, filled and read by whole arrays."""

    slots: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray) -> Lookup:
        bits = max(4, int(2 * len(codes)).bit_length())
        slots, rows = np.full(1 << bits, _NONE), np.zeros(1 << bits, np.int32)
        left, at = np.arange(len(codes), dtype=np.int32), _slot(codes, bits)
        while len(left):
            free = slots[at] == _NONE
            tried, place = left[free], at[free]
            _, first = np.unique(place, return_index=True)
            slots[place[first]], rows[place[first]] = codes[tried[first]], tried[first]
            lost = slots[at] != codes[left]
            left, at = left[lost], (at[lost] + 1) & ((1 << bits) - 1)
        return cls(slots, rows)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Row numbers, -1 for codes that are not there."""
        size = len(self.slots) - 1
        at = _slot(codes, size.bit_length())
        got = self.slots[at]
        out = np.where(got == codes, self.rows[at], -1)
        open_ = np.flatnonzero((got != codes) & (got != _NONE))
        at = at[open_]
        while len(open_):
            at = (at + 1) & size
            got = self.slots[at]
            hit = got == codes[open_]
            out[open_[hit]] = self.rows[at[hit]]
            more = ~hit & (got != _NONE)
            open_, at = open_[more], at[more]
        return out


def _slot(codes: np.ndarray, bits: int) -> np.ndarray:
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def streams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols one after another and their ``n + 1`` offsets."""
    starts, ends, words = textops.word_spans(data, offsets)
    n_words = np.diff(words)
    lengths = ends - starts
    empty = n_words == 0
    before = np.cumsum(empty) - empty  # lone end symbols of earlier texts
    owner = np.repeat(np.arange(len(n_words)), n_words)
    stop = np.cumsum(lengths + 1) + before[owner] - 1  # where a word's separator goes
    out = np.full(int(lengths.sum() + len(starts) + empty.sum()), 0x20, np.uint8)
    inner = np.arange(int(lengths.sum())) + np.repeat(
        stop - lengths - (np.cumsum(lengths) - lengths), lengths)
    source = np.arange(int(lengths.sum())) + np.repeat(
        starts - (np.cumsum(lengths) - lengths), lengths)
    out[inner] = textops.lower(data)[source]
    sizes = np.zeros(len(n_words) + 1, np.int64)
    sizes[1:] = np.bincount(owner, lengths + 1, len(n_words)).astype(np.int64) + empty
    upto = np.cumsum(sizes)
    out[upto[1:] - 1] = END
    return out, upto


def grams(stream: np.ndarray, upto: np.ndarray, order: int) -> np.ndarray:
    """For every symbol the code of itself and the ``order`` symbols before; before a text: END."""
    code = stream.astype(np.uint64)
    for back in range(1, order + 1):
        code[back:] |= stream[:-back].astype(np.uint64) << np.uint64(8 * back)
    starts, sizes = upto[:-1], np.diff(upto)
    for t in range(order):
        pad = sum(END << (8 * j) for j in range(t + 1, order + 1))
        code[starts[sizes > t] + t] |= np.uint64(pad)
    return code


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << (8 * (order + 1))) - 1)


_COUNTS = "kind int, code long, n long"


class _Tally:
    """Counts of codes, summed up within a task."""

    def __init__(self, kind: int):
        self.kind, self.held, self.size = kind, [], 0
        self.codes, self.n = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, codes: np.ndarray) -> None:
        if not len(codes):
            return
        self.held.append(codes)
        self.size += len(codes)
        if self.size > TALLY_SYMBOLS:
            self.settle()

    def settle(self) -> None:
        if self.held:
            codes, n = np.unique(np.concatenate(self.held), return_counts=True)
            self.held, self.size = [], 0
            codes, n = np.concatenate([self.codes, codes]), np.concatenate([self.n, n])
            at = np.argsort(codes, kind="stable")
            codes, n = codes[at], n[at]
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            self.codes, self.n = codes[first], np.add.reduceat(n, first)

    def rows(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if len(self.codes) > least:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(self.codes), self.kind, np.int32)),
                pa.array(self.codes.view(np.int64)), pa.array(self.n)], ["kind", "code", "n"])
            self.codes, self.n = self.codes[:0], self.n[:0]


def coded(data: np.ndarray, offsets: np.ndarray, order: int) -> Iterator[tuple]:
    """(first text, end, codes, their texts, word hashes, their texts), slice by slice.

    Text numbers count from the slice's first. A long text comes in pieces that end between words;
    codes reach back into the piece before.
    """
    for lo, hi in textops.slices(offsets):
        part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if hi - lo == 1 and len(part) > 2 * textops.SLICE_BYTES:
            for code, hashes in _coded_pieces(part, order):
                yield lo, hi, code, np.zeros(len(code), int), hashes, np.zeros(len(hashes), int)
            continue
        stream, upto = streams(part, own)
        hashes, words = textops.word_hashes(part, own)
        numbers = np.arange(hi - lo)
        yield (lo, hi, grams(stream, upto, order), np.repeat(numbers, np.diff(upto)), hashes,
               np.repeat(numbers, np.diff(words)))


def _coded_pieces(text: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    end = len(text)
    while end and textops._SPACE[text[end - 1]]:
        end -= 1  # the last piece ends with a word, which the end symbol follows
    tail, fresh = np.empty(0, np.uint8), 0
    while fresh < end or not end:
        stop = min(fresh + textops.SLICE_BYTES, end)
        while stop < end and not textops._SPACE[text[stop - 1]]:
            stop += 1
        piece, own = text[fresh:stop], np.array([0, stop - fresh])
        stream, _ = streams(piece, own)
        hashes, _ = textops.word_hashes(piece, own)
        if stop < end:
            stream = stream[:-1] if not len(hashes) else np.append(stream[:-1], np.uint8(0x20))
        both = np.concatenate([tail, stream])
        yield grams(both, np.array([0, len(both)]), order)[len(tail):], hashes
        if not end:
            return
        tail, fresh = both[len(both) - min(order, len(both)) :], stop


def _count(order: int):
    """Kind 0: grams of the highest order, kind 1: words, with their counts in a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = _Tally(0), _Tally(1)
        for batch in batches:
            for _, _, code, _, hashes, _ in coded(*textops.batch_bytes(batch.column(0)), order):
                tallies[0].add(code)
                tallies[1].add(hashes)
                for tally in tallies:
                    yield from tally.rows(TALLY_CODES)
        for tally in tallies:
            tally.settle()
            yield from tally.rows()

    return run


def _largest(counts: DataFrame, most: int | None, value: str = "n") -> tuple[np.ndarray, np.ndarray]:
    """The codes with the largest counts, about ``most`` at the most; ties at the limit are out."""
    rows = counts.count()
    most = min(rows // KNOWN_SHARE, KNOWN_MOST) if most is None else most
    if rows > most:
        least = F.percentile_approx("n", 1 - most / rows, 10_000)
        counts = counts.filter(F.col("n") > counts.agg(least).first()[0])
    top = counts.select("code", value).toArrow()
    return top["code"].to_numpy().view(np.uint64), top[value].to_numpy()


@dataclass(frozen=True)
class Model:
    nodes: list[DataFrame]  # per order all contexts: context, total, kinds, symbols, seen, down
    top_grams: tuple[np.ndarray, np.ndarray]  # of the highest order: codes, log10 of probabilities
    symbols: int  # different symbols in all training texts
    words: DataFrame  # code, n: all training words
    top_words: tuple[np.ndarray, np.ndarray]
    tokens: int  # all training tokens, end tokens included
    kinds: int
    ends: int

    @property
    def order(self) -> int:
        return len(self.nodes) - 1

    @property
    def unit(self) -> float:
        """Log10 of the base's denominator."""
        return float(np.log10(self.tokens + self.kinds + 1))


def _context(code: Column, order: int, k: int) -> Column:
    """The ``k`` symbols before the last one."""
    part = code if k == order else code.bitwiseAND(F.lit(int(_mask(k))))
    return F.shiftrightunsigned(part, 8)


def _joined(left: DataFrame, node: DataFrame, k: int, key: Column, how: str) -> DataFrame:
    """``left`` with the contexts of ``k`` symbols. There are at most 256 of one symbol."""
    node = node.withColumnRenamed("context", "_context")
    return left.join(F.broadcast(node) if k < 2 else node, key == F.col("_context"), how)


def _grams_of(node: DataFrame) -> DataFrame:
    """code, n, value: a row for each gram, with log10 of its probability in its own context."""
    rows = node.select("context", "total", F.explode("symbols").alias("symbol", "n"))
    return rows.select(
        F.shiftleft("context", 8).bitwiseOR(F.col("symbol")).alias("code"), "n",
        F.log10((2 * F.col("n") - 1) / (2 * F.col("total"))).alias("value"),
    )


def _node(level: DataFrame, k: int, shorter: DataFrame | None) -> DataFrame:
    """All contexts of ``k`` symbols: their counts, and in ``down`` the log10 of what escapes from them
    to the empty context give, in ``seen`` that of what is left in the next shorter context."""
    entry = F.struct(F.col("code").bitwiseAND(F.lit(255)).alias("s"), "n")
    node = level.groupBy(F.shiftrightunsigned("code", 8).alias("context")).agg(
        F.sum("n").alias("total"), F.count("*").alias("kinds"),
        F.map_from_entries(F.collect_list(entry)).alias("symbols"),  # at most 256
    )
    zero = F.lit(0.0)
    if shorter is None:
        return lineage_cut(node.withColumns({"seen": zero, "down": zero}))
    up = shorter.select("context", *[F.col(c).alias(f"_{c}")
                                     for c in ("total", "kinds", "symbols", "down")])
    short = F.col("context").bitwiseAND(F.lit(int(_mask(k - 2)) if k > 1 else 0))
    taken = F.aggregate(F.map_keys("symbols"), F.lit(0).cast("long"),
                        lambda n, s: n + F.col("_symbols")[s])
    new = F.col("_kinds") - F.col("kinds")
    both = _joined(node, up, k - 1, short, "inner").withColumn(
        "seen", F.log10(F.greatest(2 * (F.col("_total") - taken), F.lit(1))))
    step = F.when(new > 0, F.log10(new) - F.col("seen")).otherwise(zero)
    return lineage_cut(both.select("context", "total", "kinds", "symbols", "seen",
                                   (F.col("_down") + step).alias("down")))


def train(texts: DataFrame, text_col: str = "text", order: int = ORDER,
          most: int | None = None) -> Model:
    """Counts all texts. All grams are in the model; tasks hold the values of about ``most`` of them
    (by default of a quarter, up to 2^20), and the counts of as many words.

    Null texts are empty; repeated rows are counted as often as they occur."""
    read = texts.select(text_of(text_col).alias("text"))
    counted = read.mapInArrow(_count(order), _COUNTS)
    counts = lineage_cut(counted.groupBy("kind", "code").agg(F.sum("n").alias("n")))
    words = counts.filter("kind = 1").select("code", "n")
    levels = [counts.filter("kind = 0").select("code", "n")]
    for k in range(order - 1, -1, -1):
        code = F.col("code").bitwiseAND(F.lit(int(_mask(k))))
        levels.append(lineage_cut(
            levels[-1].groupBy(code.alias("code")).agg(F.sum("n").alias("n"))))
    nodes: list[DataFrame] = []
    for k, level in enumerate(levels[::-1]):
        nodes.append(_node(level, k, nodes[-1] if nodes else None))
    sums = words.agg(F.count("*").alias("kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    ends = int(read.count())
    return Model(nodes, _largest(_grams_of(nodes[-1]), most, "value"), levels[-1].count(),
                 words, _largest(words, most), sums.n + ends, sums.kinds + (ends > 0), ends)


def _by_text(code: np.ndarray, owner: np.ndarray, texts: int) -> tuple[list, list]:
    """Per text: its different codes, and how often each occurs."""
    at = np.lexsort((code, owner))
    code, owner = code[at], owner[at]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(code)))
    cuts = np.searchsorted(owner[first], np.arange(texts + 1))
    code = code[first].view(np.int64)
    return ([code[cuts[i] : cuts[i + 1]] for i in range(texts)],
            [many[cuts[i] : cuts[i + 1]] for i in range(texts)])


def _score(model: Model):
    """A row with the sums of every text, and rows with the codes and words that are left to joins:
    one per text, or per piece of a long text."""
    order, (gram_codes, values) = model.order, model.top_grams
    (codes, counts), has_end = model.top_words, int(model.ends > 0)
    lists = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Lookup.of(gram_codes)
        known = Lookup.of(codes)
        logs = np.log10(counts + 1.0)
        for batch in batches:
            data, offsets = textops.batch_bytes(batch.column(batch.num_columns - 1))
            n = len(offsets) - 1
            score, base, n_words, n_known = np.zeros(n), np.zeros(n), np.zeros(n, int), np.zeros(n, int)
            for lo, hi, code, owner, hashes, word_owner in coded(data, offsets, order):
                row = held.find(code)
                hit = row >= 0
                score[lo:hi] += np.bincount(owner[hit], values[row[hit]], hi - lo)
                other, times = _by_text(code[~hit], owner[~hit], hi - lo)
                row = known.find(hashes)
                hit = row >= 0
                base[lo:hi] += np.bincount(word_owner[hit], logs[row[hit]], hi - lo)
                n_known[lo:hi] += np.bincount(word_owner[hit], minlength=hi - lo)
                n_words[lo:hi] += np.bincount(word_owner, minlength=hi - lo)
                rare, rare_times = _by_text(hashes[~hit], word_owner[~hit], hi - lo)
                part = batch.slice(lo, hi - lo)
                yield _rows(part, lists, rare=rare, rare_times=rare_times, other=other, times=times)
            yield _rows(batch, lists, n_tokens=n_words + 1, n_known=n_known + has_end, base_part=base,
                        score_part=score)

    return run


_SUMS = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base_part": pa.float64(),
         "score_part": pa.float64()}
_LISTS = ("rare", "rare_times", "other", "times")


def _rows(batch: pa.RecordBatch, lists: pa.DataType, **made) -> pa.RecordBatch:
    kinds = _SUMS | dict.fromkeys(_LISTS, lists)
    return pa.RecordBatch.from_arrays(
        [*batch.columns[:-1],
         *[pa.array(made[c], t) if c in made else pa.nulls(batch.num_rows, t) for c, t in kinds.items()]],
        [*batch.schema.names[:-1], *kinds])


def _logs(codes: DataFrame, model: Model) -> DataFrame:
    """code, value: log10 of the probability of every code's last symbol, from all orders' tables.

    Codes that an order finishes are taken out before the next. ``_open``: no context was known yet.
    ``_leave``: what the next longer context, if it is known, takes off a count in this one.
    """
    symbol = F.col("code").bitwiseAND(F.lit(255))
    out = codes.select("code", F.lit(0.0).alias("value"), F.lit(True).alias("_open"),
                       F.lit(0.0).alias("_leave"))
    finished = []
    for k in range(model.order, -1, -1):
        code = F.col("code")
        node = model.nodes[k].select("context", "total", "kinds", "symbols",
                                     F.col("seen").alias("_seen"), F.col("down").alias("_down"))
        both = _joined(out, node, k, _context(code, model.order, k), "left")
        both = both.withColumn("_n", F.col("symbols")[symbol])
        open_, n, total = (F.col(c) for c in ("_open", "_n", "total"))
        value, known = F.col("value"), total.isNotNull()
        own = F.log10((2 * n - 1) / (2 * total))
        after = value + F.log10(2 * n - 1) - F.col("_leave")
        tried = lineage_cut(both.select(
            "code",
            F.when(n.isNotNull(), F.when(open_, own).otherwise(after))
            .when(open_ & known, F.log10(F.col("kinds") / (2 * total)) + F.col("_down"))
            .otherwise(value).alias("value"),
            n.isNotNull().alias("_done"),
            (open_ & ~known).alias("_open"),
            F.when(known, F.col("_seen") + F.col("_down")).otherwise(F.col("_leave")).alias("_leave"),
        ))
        finished.append(tried.filter("_done").select("code", "value"))
        out = tried.filter("not _done").drop("_done")
    unseen = -float(np.log10(max(256 - model.symbols, 1)))
    finished.append(out.select("code", (F.col("value") + unseen).alias("value")))
    return reduce(DataFrame.union, finished)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",),
          text_col: str = "text") -> DataFrame:
    """Row by row: the ``keep`` columns, n_tokens, n_known, base_score, score.

    A null text is an empty one: its end token alone is scored. Without training texts every symbol
    is equally likely. Words and codes outside of the tables that every task holds are exact, too: they
    are joined with the tables of all words and all contexts, and come back as one sum per document.
    Repeated rows are scored one by one. Kept columns may have any name but those of the results.
    """
    names = [c for c in keep if c in docs.columns]
    clash = {"n_tokens", "n_known", "base_score", "score"} & set(names)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be there twice")
    read = docs.select(F.monotonically_increasing_id().alias("row"),
                       F.struct(*[quoted(c) for c in names]).alias("kept") if names
                       else F.lit(None).cast("string").alias("kept"),
                       text_of(text_col).alias("text"))
    schema = StructType(read.schema.fields[:-1]).add("n_tokens", "long").add("n_known", "long").add(
        "base_part", "double").add("score_part", "double")
    for name in _LISTS:
        schema = schema.add(name, ArrayType(LongType()))
    made = lineage_cut(read.mapInArrow(_score(model), schema))  # freezes the row numbers
    rows = made.filter(F.col("n_tokens").isNotNull())
    zero = F.lit(0.0)

    def listed(codes: str, times: str) -> DataFrame:
        return made.select("row", F.explode(F.arrays_zip(codes, times)).alias("e")).select(
            "row", F.col(f"e.{codes}").alias("code"), F.col(f"e.{times}").alias("times"))

    rare = listed("rare", "rare_times").join(model.words, "code").select(
        "row", F.col("times").alias("more"), (F.col("times") * F.log10(F.col("n") + 1)).alias("base"),
        zero.alias("score"))
    other = listed("other", "times")
    other = other.join(_logs(other.select("code").distinct(), model), "code").select(
        "row", F.lit(0).cast("long").alias("more"), zero.alias("base"),
        (F.col("times") * F.col("value")).alias("score"))
    sums = rare.union(other).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("more", "base", "score")])
    base = (F.col("base_part") + F.coalesce("base", zero) + float(np.log10(model.ends + 1.0))
            - F.col("n_tokens") * model.unit)
    return rows.join(sums, "row", "left").select(
        *[F.col("kept").getField(c).alias(c) for c in names], "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        base.alias("base_score"), (F.col("score_part") + F.coalesce("score", zero)).alias("score"),
    )


def held_out(id_col: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether a document is kept from training: its id's CRC-32 modulo ``folds``; null as ``null``."""
    name = F.coalesce(id_col.cast("string"), F.lit("null"))
    return F.crc32(name.cast("binary")) % folds == fold
