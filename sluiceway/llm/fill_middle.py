"""Fill-in-the-middle samples by displacement scatter.

A text is cut at two code points into prefix, middle and suffix, which are put in another order behind
sentinels. Every byte moves by a shift that is constant within its part, so a difference array with
one entry per part and its running sum give the place of every byte of a batch, and one scatter
writes all outputs. ``restore`` finds the sentinels and gathers the bytes back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import quoted, text_of
from sluiceway.llm.textops import SLICE_BYTES, batch_bytes, slices


@dataclass(frozen=True)
class Rule:
    """Sentinels and shares: of 100 texts ``plain_from`` are cut, ``spm_below`` of 100 of them
    suffix first. The draws of a text follow from the seed and its id alone."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: int = 1
    plain_from: int = 90
    spm_below: int = 20

    def __post_init__(self):
        marks = self.marks
        if len(set(marks)) < 3 or not all(marks) or any(m[0] != marks[0][0] for m in marks) or any(
            m[0] in m[1:] for m in marks
        ):
            # Then none can arise where a part and a sentinel meet.
            raise ValueError("sentinels must differ and start with one character that none repeats")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draws(id_: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from sha256 of ``seed:id``; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                rule: Rule | None = None) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output), one row per document.

    ``n`` counts code points. ``form`` is plain (the text itself; the two lengths are null), psm or
    spm. Null texts are empty and plain, as are texts that contain a sentinel. Rows repeated in id
    and text give equal rows; rows without id share their draws. Other columns are not looked at.
    A batch is worked on in slices; beside a very long text and its output a task holds arrays of a
    slice only.
    """
    rule = rule or Rule()
    marks = [m.encode() for m in rule.marks]
    read = docs.select(
        quoted(id_col).alias("id"),
        *[h.alias(f"h{k}") for k, h in enumerate(draws(quoted(id_col), rule.seed))],
        text_of(text_col).alias("text"),
    )
    id_type = read.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = batch_bytes(batch.column("text"))
            h = [batch.column(f"h{k}").to_numpy() for k in range(4)]
            for lo, hi in slices(offsets):
                part = data[offsets[lo] : offsets[hi]]
                drawn = [x[lo:hi] for x in h]
                own = offsets[lo : hi + 1] - offsets[lo]
                n, form, first, second, out, ends = _cut(part, own, drawn, marks, rule)
                cut = form > 0
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(lo, hi - lo),
                    pa.array(n),
                    pa.array(np.array(["plain", "psm", "spm"])[form]),
                    pa.array(first, mask=~cut),
                    pa.array(second - first, mask=~cut),
                    _strings(out, ends),
                ], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return read.mapInArrow(
        run, f"id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restore(samples: DataFrame, output_col: str = "output", form_col: str = "form",
            name: str = "restored", rule: Rule | None = None) -> DataFrame:
    """The samples with their texts, rebuilt from output and form alone, as column ``name``.

    A column of that name is replaced. A null output is an empty text; a null form counts as plain.
    An output of another form that has not one of each sentinel fails the job: it is no sample.
    """
    marks = [m.encode() for m in (rule or Rule()).marks]
    kept = [c for c in samples.columns if c != name]
    rest = samples.select(*[quoted(c) for c in kept])
    fields = ", ".join(f"`{c}` {t}" for c, t in rest.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = batch_bytes(batch.column(output_col))
            forms = np.array(batch.column(form_col).fill_null("plain").to_pylist(), object)
            form = np.where(forms == "psm", 1, np.where(forms == "spm", 2, 0))
            for lo, hi in slices(offsets):
                part = data[offsets[lo] : offsets[hi]]
                text, ends = _rebuild(part, offsets[lo : hi + 1] - offsets[lo], form[lo:hi], marks)
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*rows.columns, _strings(text, ends)],
                                                 [*kept, name])

    return rest.mapInArrow(run, f"{fields}, `{name}` string")


# --- kernels ---------------------------------------------------------------------------------


def _strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    wide = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)),
                                           pa.py_buffer(data)])
    return wide.cast(pa.large_string()).cast(pa.string())


def _moved(size: int, starts: np.ndarray, shifts: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """For each block of positions, where they lie after the shifts.

    ``starts`` ascend; a shift holds from its start to the next one. Of empty parts, which start
    where the next one does, nothing is left in the sum.
    """
    jumps = np.diff(shifts, prepend=0)
    carry = 0
    for lo in range(0, size, SLICE_BYTES):
        hi = min(lo + SLICE_BYTES, size)
        a, b = np.searchsorted(starts, [lo, hi])
        step = np.zeros(hi - lo, np.int64)
        np.add.at(step, starts[a:b] - lo, jumps[a:b])
        step[0] += carry
        shift = np.cumsum(step)
        carry = int(shift[-1])
        yield slice(lo, hi), shift + np.arange(lo, hi)


def _point_starts(first: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Byte positions of the code points of the given ascending ranks; the end for those beyond."""
    out = np.full(len(ranks), len(first), np.int64)
    seen = 0
    for lo in range(0, len(first), SLICE_BYTES):
        at = np.flatnonzero(first[lo : lo + SLICE_BYTES]) + lo
        a, b = np.searchsorted(ranks, [seen, seen + len(at)])
        out[a:b] = at[ranks[a:b] - seen]
        seen += len(at)
    return out


def _found(data: np.ndarray, offsets: np.ndarray, mark: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Position and text number of every occurrence of a sentinel within a text."""
    span = len(data) - len(mark) + 1
    if span <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    same = data[:span] == mark[0]
    for k in range(1, len(mark)):
        same &= data[k : k + span] == mark[k]
    at = np.flatnonzero(same)
    text = np.searchsorted(offsets, at, "right") - 1
    inside = at + len(mark) <= offsets[text + 1]
    return at[inside], text[inside]


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Set flags per text."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = np.diff(offsets) > 0
    if full.any():
        out[full] = np.add.reduceat(flags.view(np.uint8), offsets[:-1][full], dtype=np.int64)
    return out


def _cut(data, offsets, drawn, marks, rule):
    """Code points, form, first and second cut (code points), output bytes and their offsets."""
    first = (data & 0xC0) != 0x80
    n = _sums(first, offsets)
    marked = np.zeros(len(n), bool)
    for mark in marks:
        marked[_found(data, offsets, mark)[1]] = True
    plain = (n == 0) | marked | (drawn[2] % 100 >= rule.plain_from)
    form = np.where(plain, 0, np.where(drawn[3] % 100 < rule.spm_below, 2, 1))
    one, two = drawn[0] % (n + 1), drawn[1] % (n + 1)
    one, two = np.minimum(one, two), np.maximum(one, two)
    before = np.cumsum(n) - n
    # Ranks ascend: both cuts of a text lie between its start and the start of the next.
    cuts = _point_starts(first, np.stack([before + one, before + two], 1).ravel()).reshape(-1, 2)
    p, m, s = cuts[:, 0] - offsets[:-1], cuts[:, 1] - cuts[:, 0], offsets[1:] - cuts[:, 1]
    lp, ls, lm = (len(x) for x in marks)
    extra = np.where(form > 0, lp + ls + lm, 0)
    ends = np.concatenate([[0], np.cumsum(p + m + s + extra)])
    base = ends[:-1]
    psm, spm = form == 1, form == 2
    to_p = base + np.where(psm, lp, np.where(spm, ls + s + lp, 0))
    to_s = base + np.where(psm, lp + p + ls, np.where(spm, ls, p + m))
    to_m = base + np.where(form > 0, p + s + lp + ls + lm, p)
    out = np.empty(ends[-1], np.uint8)
    starts = np.stack([offsets[:-1], cuts[:, 0], cuts[:, 1]], 1).ravel()
    shifts = np.stack([to_p, to_m, to_s], 1).ravel() - starts
    for at, to in _moved(len(data), starts, shifts):
        out[to] = data[at]
    done = form > 0
    for mark, to in zip(marks, (to_p, to_s, to_m), strict=True):
        places = to[done] - len(mark)
        for k, byte in enumerate(mark):
            out[places + k] = byte
    return n, form, one, two, out, ends


def _rebuild(data, offsets, form, marks):
    """Text bytes and their offsets."""
    at = []
    for mark in marks:
        place, text = _found(data, offsets, mark)
        real = form[text] > 0
        own = np.full(len(form), -1, np.int64)
        own[text[real]] = place[real]
        if np.count_nonzero(real) != np.count_nonzero(form) or (own[form > 0] < 0).any():
            raise ValueError(f"an output has not one {mark.decode()}")
        at.append(own)
    lp, ls, lm = (len(x) for x in marks)
    done, psm = form > 0, form == 1
    size = np.diff(offsets)
    from_p = np.where(done, at[0] + lp, offsets[:-1])
    from_s = np.where(done, at[1] + ls, offsets[1:])
    from_m = np.where(done, at[2] + lm, offsets[1:])
    p = np.where(done, np.where(psm, at[1], at[2]) - from_p, size)
    s = np.where(done, np.where(psm, at[2], at[0]) - from_s, 0)
    m = np.where(done, offsets[1:] - from_m, 0)
    ends = np.concatenate([[0], np.cumsum(p + m + s)])
    starts = np.stack([ends[:-1], ends[:-1] + p, ends[:-1] + p + m], 1).ravel()
    shifts = np.stack([from_p, from_m, from_s], 1).ravel() - starts
    out = np.empty(ends[-1], np.uint8)
    for to, source in _moved(len(out), starts, shifts):
        out[to] = data[source]
    return out, ends
