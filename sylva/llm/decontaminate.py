"""Benchmark decontamination: the q-gram lemma over overlapping diagonal bands, then banded alignment.

An item is cut into overlapping windows. A window of m bytes that occurs in a text with at most e edits shares at least
m + 1 - q (e + 1) q-grams with it, all on diagonals (place in text less place in window) that lie within e of each
other. So a stretch of text with fewer shared q-grams is passed over, then a band of diagonals with fewer is, and what
is left is aligned within its band. Equal windows are one, so that repetitive items do not multiply, and shared q-grams
are counted run by run along the text, so that memory does not grow with how often text and items repeat themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import byte_slices, read

Q, WINDOW, EDITS, SHORTEST = 8, 96, 0.08, 24
#: Bytes from one window's start to the next; a passage between two of them is half as far from the nearer, within the edits.
STEP = 8
#: Benchmark text that one pass over the documents takes (its index is some 170 times as large); more is taken in several
#: passes. Shared q-grams counted at a time, and bands aligned at a time.
PASS_BYTES, RUN, BATCH = 1 << 20, 1 << 17, 2_048
_FOLD = bytes(32 if c in b"\t\n\v\f\r" else c for c in range(256))
_MIX, _BITS, _GAP = np.uint64(0x9E3779B97F4A7C15), 22, b"\x00" * Q


def folded(text: str) -> bytes:
    """Lower case, ASCII white space as spaces, as UTF-8; offsets are those of the lowered text."""
    return text.lower().encode("utf-8", "replace").translate(_FOLD)


def grams(data: bytes) -> np.ndarray:
    return np.ndarray((max(0, len(data) - Q + 1),), "<u8", data, 0, (1,))


def aligned(windows: np.ndarray, places: np.ndarray, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(edits, end) of each window (a row of bytes) in data, on the width diagonals from its place on, from begin to end.

    Text before and after the window is free. A row of the table is kept, for all windows at once, by diagonal: a letter
    of the window alone comes from one diagonal further, one of the text alone from the diagonal before.
    """
    columns = np.arange(width, dtype=np.int16)
    row = np.zeros((len(windows), width), np.int16)
    at = places[:, None] + columns
    last, least, limit = len(data) - 1, begins[:, None], ends[:, None]
    for i in range(windows.shape[1]):
        text = data[np.clip(at + i, 0, last)]
        differ = (text != windows[:, i, None]) | (at + i < least) | (at + i >= limit)
        step = row + differ
        np.minimum(step[:, :-1], row[:, 1:] + 1, out=step[:, :-1])
        row = np.minimum.accumulate(step - columns, axis=1) + columns
    best = row.argmin(axis=1)
    return row[np.arange(len(row)), best], np.clip(places + best + windows.shape[1], begins, ends)


class Windows:
    """The different windows of some items, and where each q-gram stands in them."""

    def __init__(self, items: list[tuple[object, str]], window: int, edits: float, shortest: int = SHORTEST):
        found: dict[bytes, dict[object, int]] = {}
        for key, text in items:
            data = folded(text).strip()
            if len(data) >= shortest:
                last = max(0, len(data) - window)
                for at in sorted({*range(0, last + 1, STEP), last}):
                    held = found.setdefault(data[at : at + window], {})
                    held[key] = held.get(key, 0) + 1
        self.text, self.items = list(found), list(found.values())
        self.size = np.array([len(t) for t in self.text], np.int64)
        budget = (self.size * edits).astype(np.int64)
        self.budget = np.maximum(0, np.minimum(budget, (self.size + 1) // Q - 2))  # beyond it the lemma tells nothing
        self.need = self.size + 1 - Q * (self.budget + 1)
        each = [grams(t) for t in self.text]
        all_grams = np.concatenate([*each, np.zeros(0, "<u8")])
        order = np.argsort(all_grams, kind="stable")
        self.owner = np.repeat(np.arange(len(each), dtype=np.int32), [len(g) for g in each])[order]
        self.place = np.concatenate([*(np.arange(len(g), dtype=np.int32) for g in each), np.zeros(0, np.int32)])[order]
        self.known, self.first, self.times = np.unique(all_grams[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self._slot(self.known)] = True
        self.least = int(self.need.min()) if len(each) else 1
        self.reach = int((self.size + self.budget).max()) if len(each) else 0
        self.wide = int(self.budget.max()) + 1 if len(each) else 1

    @staticmethod
    def _slot(g: np.ndarray) -> np.ndarray:
        return ((g * _MIX) >> np.uint64(64 - _BITS)).astype(np.int64)

    def shared(self, g: np.ndarray) -> np.ndarray:
        """The places of g that hold a q-gram of some window."""
        out = []
        for lo in range(0, len(g), 1 << 18):
            part = g[lo : lo + (1 << 18)]
            at = np.flatnonzero(self.seen[self._slot(part)])
            slot = np.minimum(np.searchsorted(self.known, part[at]), len(self.known) - 1)
            out.append(at[self.known[slot] == part[at]] + lo)
        return np.concatenate([*out, np.zeros(0, np.int64)])

    def dense(self, at: np.ndarray) -> np.ndarray:
        """Those of the places at which some window's least number of q-grams can stand within its reach."""
        k = self.least - 1
        if len(at) <= k:
            return at[:0]
        good = at[k:] - at[: len(at) - k] <= self.reach
        marks = np.zeros(len(at) + 1, np.int32)
        np.add.at(marks, np.flatnonzero(good), 1)
        np.add.at(marks, np.flatnonzero(good) + k + 1, -1)
        return at[np.cumsum(marks[:-1]) > 0]

    def bands(self, g: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows, bands) that share enough q-grams; a band is 2 * wide diagonals, and each begins amid another.

        Counts of a run are added to those still open; a band is closed once the text has passed it.
        """
        slot = np.searchsorted(self.known, g[at])
        total = np.cumsum(self.times[slot])
        band, base = 2 * self.wide, len(g) // self.wide + 2 * self.reach + 8
        key, votes, done = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while done < len(at):
            upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + RUN, "right")))
            own, places = slot[done:upto], at[done:upto]
            times = self.times[own]
            entry = np.repeat(self.first[own] - np.cumsum(times) + times, times) + np.arange(times.sum())
            owner, diagonal = self.owner[entry].astype(np.int64), np.repeat(places, times) - self.place[entry] + self.reach
            half = diagonal // self.wide  # band n covers halves n and n + 1
            new = np.concatenate([owner * base + half, owner * base + half - 1])
            key, back = np.unique(np.concatenate([key, new]), return_inverse=True)
            weight = np.concatenate([votes, np.ones(len(new), np.int64)])
            votes, done = np.bincount(back, weight, len(key)).astype(np.int64), upto
            w, n = key // base, key % base
            open_ = n * self.wide + band + self.size[w] > at[done] + self.reach if done < len(at) else np.zeros(len(key), bool)
            ok = ~open_ & (votes >= self.need[w])
            yield w[ok], n[ok] * self.wide - self.reach
            key, votes = key[open_], votes[open_]

    def find(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, window, edits, start, end), ends in bytes, for the best place of each window in each band of each text."""
        if not self.text:
            return
        joined = _GAP.join(texts)
        g = grams(joined)
        at = self.dense(self.shared(g))
        if not len(at):
            return
        data = np.frombuffer(joined, np.uint8)
        starts = np.cumsum([0, *(len(t) + Q for t in texts)])
        for window, lo in self.bands(g, at):
            # A band may reach over the ends of texts: it is looked at in each text of which it holds enough.
            first = np.searchsorted(starts, np.maximum(0, lo - self.wide), "right") - 1
            last = np.minimum(np.searchsorted(starts, lo + 3 * self.wide + self.size[window], "right") - 1, len(texts) - 1)
            more = last - first + 1
            d = np.repeat(first, more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
            window, lo = np.repeat(window, more), np.repeat(lo, more)
            for size in np.unique(self.size[window]):
                of = np.flatnonzero(self.size[window] == size)
                for part in (of[i : i + BATCH] for i in range(0, len(of), BATCH)):
                    yield from self._align(window[part], lo[part], d[part], data, starts, texts)

    def _align(self, window: np.ndarray, lo: np.ndarray, d: np.ndarray, data: np.ndarray, starts: np.ndarray, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        budget = int(self.budget[window[0]])
        begin, stop = starts[d], starts[d] + np.array([len(texts[i]) for i in d])
        rows = np.frombuffer(b"".join(self.text[w] for w in window), np.uint8).reshape(len(window), -1)
        edits, end = aligned(rows, lo - budget, data, begin, stop, 2 * self.wide + 2 * budget + 1)
        end -= begin
        for j in np.flatnonzero(edits <= budget):
            yield int(d[j]), int(window[j]), int(edits[j]), max(0, int(end[j]) - rows.shape[1]), int(end[j])


def _parts(benchmark: DataFrame, item_id: str, item_text: str, shortest: int) -> Iterator[Broadcast]:
    """The items, broadcast in parts of about PASS_BYTES; all texts of an item are in one part."""
    items = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).where(F.octet_length("text") >= shortest)
    passes = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PASS_BYTES))
    for n in range(passes):
        some = items.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == n) if passes > 1 else items
        yield benchmark.sparkSession.sparkContext.broadcast([tuple(r) for r in some.orderBy("item", "text").collect()])


def contaminated(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, edits: float = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, item_id, n_windows, edits, first_byte, last_byte), a row for each document that holds a passage of an item.

    A passage is a window of 96 bytes of the item (all of a shorter one) with at most 8 % edits; case and kinds of white
    space do not count. Windows start every 8 bytes: of a longer item 96 bytes in a row are found wherever they start, as
    long as their edits and the up to 4 bytes to the nearest window are at most 7, and 103 bytes with up to 7 edits always.
    edits is the fewest of its windows, first_byte and last_byte are about what they cover,
    in bytes of the lowered text.
    Null and empty texts hold nothing. Items under shortest bytes are too short to tell by default (24) and are left out;
    with a smaller one (from 8, a q-gram) they are found exactly where they stand, in any text. Null items are left out.
    Repeated rows of docs come back each, as do rows with a null id; rows of one item_id are one item of several texts.
    An empty benchmark finds nothing. Other columns are not read. A text is searched whole, in memory of some tens of
    times its length.
    """
    if shortest < Q:
        raise ValueError(f"items need {Q} bytes to be found")
    kinds = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_id].dataType)
    schema = f"id {kinds[0]}, item {kinds[1]}, n_windows long, edits int, first_byte long, last_byte long"
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    out = None
    for shared in _parts(benchmark, item_id, item_text, shortest):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            windows = Windows(shared.value, window, edits, shortest)
            types = None
            for b in byte_slices(batches, "text", 1 << 20):
                ids = b.column("id")
                types = types or [ids.type, item_type, pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                found: dict[tuple, list] = {}
                for d, w, e, lo, hi in windows.find([folded(t or "") for t in b.column("text").to_pylist()]):
                    for item in windows.items[w]:
                        got = found.setdefault((d, item), [set(), e, lo, hi])
                        got[0].add(w)
                        got[1:] = min(got[1], e), min(got[2], lo), max(got[3], hi)
                rows = [(ids[d].as_py(), item, sum(windows.items[w][item] for w in ws), e, lo, hi) for (d, item), (ws, e, lo, hi) in found.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["id", "item", "n_windows", "edits", "first_byte", "last_byte"])

        part = own.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out.withColumnsRenamed({"id": doc_id, "item": item_id})


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, edits: float = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """The rows of docs in which contaminated() finds nothing, each judged by itself in place, whatever its id."""
    for shared in _parts(benchmark, item_id, item_text, shortest):

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            windows = Windows(shared.value, window, edits, shortest)
            for b in byte_slices(batches, text, 1 << 20):
                ok = np.ones(b.num_rows, bool)
                for d, *_ in windows.find([folded(t or "") for t in b.column(text).to_pylist()]):
                    ok[d] = False
                yield b.filter(pa.array(ok))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
