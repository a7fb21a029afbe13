"""Removal of byte strings of ``LENGTH`` bytes that occur more than once in a corpus.

1. Screening. The hash-minimal 64-byte gram of every 400-byte string is its anchor; equal strings have
   equal anchors at equal places. Neighbouring strings with one anchor gram make up a context, also
   where the gram stands at another place for each of them: a periodic stretch is one context, not
   one per byte. Contexts whose anchor gram occurs once in the corpus hold no repeated string and are
   left out; of equal contexts one is kept with its count. Long texts are screened in overlapping
   slices, so that the arrays of this step do not grow with a text; the text itself is in memory.
2. Suffix arrays. Contexts are dealt to shards by anchor, so that equal strings meet. Every shard's
   suffixes are sorted by Larsson-Sadakane refinement, and common prefixes follow by Kasai's rule, one
   chain of shrinking prefixes per context.
3. Merging. An anchor with more contexts than a shard may hold is spread over shards. These hand on
   their distinct strings as sorted runs of fingerprints by range, and strings that another shard has
   are found by binary search in the merged run.
4. Marks go back to the documents along contexts, and covered bytes are removed.

Within a shard neighbours in the suffix array are compared byte by byte if the later one is a string
start. By 64-bit hashes other neighbours are compared, contexts of one anchor told apart, and strings
of different shards found equal: among ``n`` distinct ones, some two have the same
hash with a probability of about ``n * n / 2 ** 65`` if hashes are evenly spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm import textops
from sluiceway.llm.common import packed, quoted, text_of, unpacked
from sluiceway.sources import lineage_cut

LENGTH = 400
GRAM = 64
SHARD_BYTES = 1 << 21  # context bytes of a shard on average
SPREAD_BYTES = 1 << 20  # an anchor with more context bytes is spread over shards
SLICE_STARTS = 1 << 18  # string starts that a long text is screened by, and so of a context at most
CHAIN = 512  # starts that share one chain of shrinking prefixes
_WINDOW = LENGTH - GRAM + 1  # gram positions of a string


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def contexts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Contexts of a batch: text number, first and last string start, anchor hash, context hash.

    ``places`` is 1, or 2 where the anchor gram stands at more than one place of the context, which may
    then repeat its own strings.
    """
    names = ("text", "first", "last", "places", "anchor", "context")
    if len(data) < LENGTH:
        return {n: np.empty(0, np.uint64 if n in names[4:] else np.int64) for n in names}
    prefix = textops.prefix_hash(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = textops.span_hash(prefix, at, at + GRAM)
    # High half of the hash, then the place: the minimum is the leftmost smallest gram.
    ranked = (gram & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    anchor = (sliding_min(ranked, _WINDOW) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offsets)
    count = np.maximum(sizes - LENGTH + 1, 0)  # string starts per text
    text = np.repeat(np.arange(len(sizes)), count)
    start = np.arange(int(count.sum())) + np.repeat(offsets[:-1] - (np.cumsum(count) - count), count)
    own = anchor[start]
    held = gram[own]
    new = np.ones(len(own), bool)
    new[1:] = (held[1:] != held[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(own)) - 1
    first, last, who = start[head], start[tail], text[head]
    base = offsets[who]
    places = np.where(own[head] == own[tail], 1, 2)
    return {"text": who, "first": first - base, "last": last - base, "places": places, "anchor": held[head],
            "context": textops.span_hash(prefix, first, last + LENGTH)}


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``LENGTH`` bytes or more, and every suffix's rank.

    Larsson-Sadakane: sort by eight bytes, then refine only the groups that are still equal, by the
    rank of the suffix as far behind as the known depth, which doubles it.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : n + k]
    order = np.argsort(key, kind="stable").astype(np.int32)
    ordered = key[order]
    rank = np.empty(n, np.int32)

    def heads(changed: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Place of the first member of each group, for the places ``where`` in order."""
        return np.maximum.accumulate(np.where(changed, where, 0))

    changed = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    group = heads(changed, np.arange(n, dtype=np.int64))
    rank[order] = group
    single = changed & np.append(changed[1:], True)
    open_ = np.flatnonzero(~single)
    del key, ordered, changed
    depth = 8
    while len(open_):
        member = order[open_]
        behind = member.astype(np.int64) + depth
        next_rank = np.where(behind < n, rank[np.minimum(behind, n - 1)].astype(np.int64) + 1, 0)
        packed = (rank[member].astype(np.int64) << 32) | next_rank
        at = np.argsort(packed, kind="stable")
        packed, member = packed[at], member[at]
        order[open_] = member
        changed = np.concatenate([[True], packed[1:] != packed[:-1]])
        rank[member] = heads(changed, open_)
        single = changed & np.append(changed[1:], True)
        open_ = open_[~single]
        depth *= 2
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, rank: np.ndarray, first: np.ndarray,
                    count: np.ndarray) -> np.ndarray:
    """Common prefix, at most ``LENGTH``, of each string start with the suffix before it.

    Kasai's rule along the starts ``first[i] .. first[i] + count[i] - 1`` of every chain: going one
    byte on, the prefix shrinks by one at most. All chains take a step together.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(LENGTH + 8, np.uint8)])
    word = np.zeros(n + LENGTH, np.uint64)
    for k in range(8):
        word |= padded[k : n + LENGTH + k].astype(np.uint64) << np.uint64(8 * k)
    out = np.zeros(int(count.sum()), np.int16)
    at_out = np.cumsum(count) - count
    alive = np.arange(len(first))
    held = np.zeros(len(first), np.int64)
    for step in range(int(count.max(initial=0))):
        alive = alive[count[alive] > step]
        here = first[alive] + step
        place = rank[here]
        before = order[np.maximum(place - 1, 0)].astype(np.int64)
        h = np.maximum(held[alive] - 1, 0)
        h[place == 0] = 0
        more = np.flatnonzero((place > 0) & (h < LENGTH))
        while len(more):
            a, b = here[more] + h[more], before[more] + h[more]
            ends = np.minimum(n - a, n - b)
            differ = word[np.minimum(a, n)] ^ word[np.minimum(b, n)]
            low = differ & (~differ + np.uint64(1))
            equal = np.where(differ == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)) // 8)
            gain = np.minimum(equal.astype(np.int64), np.maximum(ends, 0))
            h[more] += gain
            more = more[(gain == 8) & (h[more] < LENGTH)]
        held[alive] = np.minimum(h, LENGTH)
        out[at_out[alive] + step] = held[alive]
    return out


def repeated_starts(parts: list[np.ndarray], copies: np.ndarray) -> list[np.ndarray]:
    """For every context whether each of its string starts has an equal string anywhere in the shard.

    A context with copies counts for all of them. Equal strings stand side by side in the suffix
    array, so a start is repeated if its common prefix with a neighbouring start reaches ``LENGTH``.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.concatenate(parts)
    first = np.cumsum(sizes) - sizes
    count = sizes - LENGTH + 1
    order, rank = suffix_array(data)
    links = -(-count // CHAIN)
    nth = np.arange(int(links.sum())) - np.repeat(np.cumsum(links) - links, links)
    lcp = common_prefixes(data, order, rank, np.repeat(first, links) + CHAIN * nth,
                          np.minimum(np.repeat(count, links) - CHAIN * nth, CHAIN))
    owner = np.repeat(np.arange(len(parts)), count)
    start = np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)
    # Only starts of strings count; other suffixes may stand between equal ones, also with a common
    # prefix of LENGTH: classes are runs of suffixes joined by such prefixes.
    full = np.zeros(len(data) + 1, bool)
    full[rank[start]] = lcp >= LENGTH
    inner = np.ones(len(data), bool)
    inner[start] = False
    loose = np.flatnonzero(inner)
    if len(loose):  # suffixes that are no string starts: compare them with their neighbour directly
        place = rank[loose]
        whole = (place > 0) & (loose + LENGTH <= len(data))
        loose, place = loose[whole], place[whole]
        before = order[place - 1].astype(np.int64)
        fits = before + LENGTH <= len(data)
        loose, place, before = loose[fits], place[fits], before[fits]
        prefix = textops.prefix_hash(data)
        same = textops.span_hash(prefix, loose, loose + LENGTH) == textops.span_hash(
            prefix, before, before + LENGTH)
        full[place[same]] = True
    run = np.cumsum(~full[: len(data)])
    weight = np.zeros(int(run[-1]) + 1, np.int64)
    np.add.at(weight, run[rank[start]], copies[owner])
    repeated = weight[run[rank[start]]] > 1
    return np.split(repeated, np.cumsum(count)[:-1])


_CONTEXTS = "id long, key long, first int, last int, places int, anchor long, context long"


def _stretches(offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Texts from, to, and bytes from, to: ranges of whole texts, or of one long text a part.

    Parts overlap so that every string of ``LENGTH`` bytes starts in exactly one of them.
    """
    for lo, hi in textops.slices(offsets):
        begin, end = int(offsets[lo]), int(offsets[hi])
        if hi - lo > 1 or end - begin < SLICE_STARTS + LENGTH:
            yield lo, hi, begin, end
            continue
        for at in range(begin, end - LENGTH + 1, SLICE_STARTS):
            yield lo, hi, at, min(at + SLICE_STARTS + LENGTH - 1, end)


def _find_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = textops.batch_bytes(batch.column(2))
        for lo, hi, begin, end in _stretches(offsets):
            own = np.clip(offsets[lo : hi + 1], begin, end) - begin
            got = contexts(data[begin:end], own)
            rows, skipped = pa.array(got["text"] + lo), begin - int(offsets[lo])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(rows), batch.column(1).take(rows),
                pa.array((got["first"] + skipped).astype(np.int32)),
                pa.array((got["last"] + skipped).astype(np.int32)), pa.array(got["places"].astype(np.int32)),
                pa.array(got["anchor"].view(np.int64)), pa.array(got["context"].view(np.int64)),
            ], ["id", "key", "first", "last", "places", "anchor", "context"])


_BYTES = "shard long, anchor long, context long, copies long, spread boolean, data binary"


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for data, wanted in zip(unpacked(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            for w in wanted:
                piece = data[w["first"] : w["last"] + LENGTH]
                rows.append((w["shard"], w["anchor"], w["context"], w["copies"], w["spread"], piece))
                size += len(piece)
            if size > 1 << 23:
                yield _byte_rows(rows)
                rows, size = [], 0
        yield _byte_rows(rows)


def _byte_rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _BYTES.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.bool_(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


_MARKS = "kind int, part int, anchor long, context long, runs array<int>, strings binary"


def _runs(flags: np.ndarray) -> np.ndarray:
    """First and last place of every run of true values, one after the other."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], axis=1).ravel()


def _mark_shard(ranges: int):
    """Kind 0: runs of repeated starts by context. Kind 1, for spread anchors: the shard's distinct
    strings as (fingerprint, context, start or -1 if it is marked here already), sorted, by range."""

    def run(table: pa.Table) -> pa.Table:
        anchors = table["anchor"].to_numpy()
        names = table["context"].to_numpy()
        spread = table["spread"].to_numpy()
        parts = [np.frombuffer(x.as_buffer(), np.uint8) for x in table["data"].combine_chunks()]
        flags = repeated_starts(parts, table["copies"].to_numpy())
        rows: list[tuple] = []
        strings: list[tuple[np.ndarray, ...]] = []
        for i, own in enumerate(flags):
            if own.any():
                rows.append((0, 0, int(anchors[i]), int(names[i]), _runs(own).tolist(), None))
            if spread[i]:
                at = np.arange(len(own))
                print_ = textops.mix(textops.span_hash(
                    textops.prefix_hash(parts[i]), at, at + LENGTH
                ) ^ np.array([anchors[i]]).view(np.uint64))
                strings.append((print_, np.full(len(own), anchors[i]), np.full(len(own), names[i]),
                                np.where(own, -1, at)))
        if strings:
            prints, anchor, name, start = (np.concatenate(c) for c in zip(*strings, strict=True))
            _, once = np.unique(prints, return_index=True)
            prints, anchor, name, start = (c[once] for c in (prints, anchor, name, start))
            part = ((prints >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            for p in np.unique(part):
                own = part == p
                packed = np.stack([prints[own].view(np.int64), anchor[own], name[own], start[own]])
                rows.append((1, int(p), 0, 0, None, packed.tobytes()))
        return _table(rows)

    return run


def _table(rows: list[tuple]) -> pa.Table:
    names = [x.split()[0] for x in _MARKS.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _merge_range(table: pa.Table) -> pa.Table:
    """Of one range of fingerprints: the starts whose string a second shard has as well."""
    shards = [np.frombuffer(x, np.int64).reshape(4, -1) for x in table["strings"].to_pylist()]
    merged = np.sort(np.concatenate([s[0].view(np.uint64) for s in shards]))
    rows: list[tuple] = []
    for own in shards:
        prints = own[0].view(np.uint64)
        found = (np.searchsorted(merged, prints, "right") - np.searchsorted(merged, prints)) > 1
        found &= own[3] >= 0
        anchor, name, start = (c[found] for c in own[1:])
        at = np.lexsort((start, name, anchor))
        anchor, name, start = anchor[at], name[at], start[at]
        cuts = np.flatnonzero(np.concatenate([
            [True], (anchor[1:] != anchor[:-1]) | (name[1:] != name[:-1])])) if len(at) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(at)], strict=True) if len(at) else []:
            flags = np.zeros(int(start[hi - 1]) + 1, bool)
            flags[start[lo:hi]] = True
            rows.append((0, 0, int(anchor[lo]), int(name[lo]), _runs(flags).tolist(), None))
    return _table(rows)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, marks = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        kept, spans, sizes = [], [], []
        for data, lists in zip(unpacked(texts), marks, strict=True):
            sizes.append(len(data))
            found: list[list[int]] = []
            if lists.is_valid:
                pairs = np.concatenate([
                    np.asarray(x["runs"], np.int64).reshape(-1, 2) + x["first"] for x in lists.as_py()
                ])
                for lo, hi in np.unique(pairs, axis=0).tolist():
                    if found and lo <= found[-1][1]:
                        found[-1][1] = max(found[-1][1], hi + LENGTH)
                    else:
                        found.append([lo, hi + LENGTH])
            at, pieces = 0, []
            for lo, hi in found:
                pieces.append(data[at:lo])
                at = hi
            kept.append(b"".join([*pieces, data[at:]]))
            spans.append([x for span in found for x in span])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-2], pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.int32())),
             pa.array(kept, pa.binary())],
            [*batch.schema.names[:-2], "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, spans (begin, end, begin, end ...) and the kept bytes.

    A byte goes if a string of ``LENGTH`` bytes over it also starts anywhere else in the input, be it
    in the same text; all copies go. Texts count as UTF-8 bytes, so what is kept may begin or end
    within a character. Null and short texts stay as they are. Rows may repeat; a repeated row of
    ``LENGTH`` bytes or more loses everything, as any copy does.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    read = docs.select(quoted(id_col).cast("long").alias("id"),
                       F.xxhash64(quoted(id_col), text).alias("key"), text.alias("text"))
    found = lineage_cut(read.mapInArrow(_find_contexts, _CONTEXTS))
    twice = found.groupBy("anchor").agg(F.sum("places").alias("n")).filter("n > 1").select("anchor")
    cand = lineage_cut(found.join(twice, "anchor"))
    unique = lineage_cut(cand.groupBy("anchor", "context").agg(
        F.count("*").alias("copies"), F.min(F.struct("key", "id", "first", "last")).alias("at")
    ).withColumn("bytes", (F.col("at.last") - F.col("at.first") + LENGTH).cast("long")))
    sized = unique.groupBy("anchor").agg(F.sum("bytes").alias("all"))
    large = F.col("all") > SPREAD_BYTES
    total = sized.agg(F.coalesce(F.sum("all"), F.lit(0)).alias("bytes"),
                      F.coalesce(F.sum(F.when(large, F.col("all"))), F.lit(0)).alias("spread")).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total["bytes"] // SHARD_BYTES)
    ranges = max(1, total["spread"] // SHARD_BYTES)
    share = F.pmod(F.col("context"), F.ceil(F.col("all") / SPREAD_BYTES))
    shard = F.when(large, F.xxhash64("anchor", share)).otherwise(
        F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    wanted = (
        unique.join(sized, "anchor")
        .groupBy(F.col("at.key").alias("key"), F.col("at.id").alias("id"))
        .agg(F.collect_list(F.struct(
            shard.alias("shard"), "anchor", "context", "copies", large.alias("spread"),
            F.col("at.first").alias("first"), F.col("at.last").alias("last"))).alias("wanted"))
    )
    # A document is named by its id, null or not, and the hash of id and text.
    small = packed(read)
    here = (F.col("l.key") == F.col("r.key")) & F.col("l.id").eqNullSafe(F.col("r.id"))
    pieces = (
        small.alias("l").join(wanted.alias("r"), here).select("l.key", "l.id", "text", "wanted")
        .dropDuplicates(["key", "id"]).select("text", "wanted").mapInArrow(_cut_contexts, _BYTES)
    )
    marks = lineage_cut(
        pieces.groupBy("shard").applyInArrow(_mark_shard(ranges), _MARKS)
    )
    runs = marks.filter("kind = 0")
    if total["spread"]:
        across = marks.filter("kind = 1").groupBy("part").applyInArrow(_merge_range, _MARKS)
        runs = runs.union(across)
    runs = lineage_cut(runs.select("anchor", "context", "runs"))
    by_document = (
        cand.join(runs, ["anchor", "context"]).groupBy("key", "id")
        .agg(F.collect_list(F.struct("first", "runs")).alias("marks"))
    )
    joined = small.alias("l").join(by_document.alias("r"), here, "left").select("l.id", "text", "marks")
    return joined.mapInArrow(_removed, "id long, n_bytes long, spans array<int>, kept binary")
