"""Substring dedup: words covered by a window that also starts in a document with a smaller id are removed.

Method, in three passes over the texts.
1. Documents are parsed by recompression (see ``recompression``). A long symbol, one of level LONG with WIDTH words or more,
   stands for its whole stretch of words: if a smaller document has it too, by its name and a second hash of its words (128
   bits), all windows in the stretch repeat, and no more is asked about them. Besides, each window of WIDTH words has one
   shorter symbol, equal for equal windows, and stretches of windows with one such symbol make a row (symbol, document,
   stretch). Symbols that only one document has reveal that their windows don't repeat. The rest, a small part, go on.
2. For these stretches, apart from windows in known long repeats, the hashes of their windows are joined by symbol; symbol
   and hash, 128 bits, verify equality. A window repeats if the least document that has it comes before. The least document
   of a window is never left out, as its long symbols have no smaller document.
3. Documents with repeated windows drop the words they cover.

Symbols and windows that very many documents hold would make large groups. They are found in a sample of the documents,
lists bounded by LISTED over a document's rows; frequent symbols need no test in step 1 and are dealt by window in step
2, and for frequent windows each task gives its least document, so a few rows each settle them. The lists only choose
between exact ways. Symbols of GROUP_ROWS rows or more that no list has are dealt by window too, and groups of one window go
through their task in parts, so no group is held in memory.

Both passes that need the texts beside their findings read one shuffle of the texts.

Defined results: a null text has no words; rows without id neither lose words nor cause losses; rows with one id don't
affect each other, whether their texts are equal or not; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import groups_in_parts
from .common import WORD, read, staged
from .recompression import mixed, rounds, window_symbols

WIDTH = 13
ROUNDS = 5
LONG = 11
LONG_BITS = 20
GROUP_ROWS = 50_000
SAMPLE_DOCS = 4000
LISTED = 0.005
BATCH_CHARS = 3_000_000
STRETCH = 63
PLACE_BITS = 6
MOST_IDS = 100_000

_GAPS = np.zeros(256, bool)
_GAPS[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(13).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_P = np.uint64(0xD6E8FEB86659FD93)
_Q = np.uint64(0xA0761D6478BD642F)
_POWERS = np.cumprod(np.full(256, _P, np.uint64))


def word_names(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name for every word of all texts, and each text's number of words."""
    raw = [t.encode() if t else b"" for t in texts]
    b = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    gap = _GAPS[b]
    inside = ~gap
    first = np.flatnonzero(inside & np.append(True, gap[:-1])) if len(b) else np.zeros(0, np.int64)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    end = np.flatnonzero(gap & np.append(False, inside[:-1])) if gap[-1:].all() else np.append(np.flatnonzero(gap & np.append(False, inside[:-1])), len(b))
    size = end - first
    at = np.flatnonzero(inside)
    nth = at - np.repeat(first, size)
    v = _BYTE[b[at]]
    v *= _POWERS[nth & 255]
    far = nth > 255
    if far.any():
        v[far] = mixed(v[far], nth[far] >> 8)
    word_start = np.cumsum(size) - size
    names = mixed(np.add.reduceat(v, word_start), size)
    text_end = np.cumsum([len(r) + 1 for r in raw])
    return names, np.diff(np.searchsorted(first, np.append(0, text_end)))


def window_hashes(names: np.ndarray, width: int, factor: np.uint64 = _P) -> np.ndarray:
    """A hash of the ``width`` names from each place on."""
    n = len(names) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = names[:n].copy()
    for k in range(1, width):
        h *= factor
        h += names[k : n + k]
    return mixed(h, int(factor >> np.uint64(3)))


class Frequent:
    """Frequent symbols, long symbols, and windows by both their hashes, each list sorted."""

    def __init__(self, symbols: np.ndarray, windows: np.ndarray, longs: np.ndarray):
        self.symbols, self.longs = np.sort(symbols), np.sort(longs)
        self.windows = windows[np.argsort(windows[:, 0], kind="stable")] if len(windows) else np.zeros((0, 2), np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.windows[:, 0] >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def has(listed: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        if not len(listed):
            return np.zeros(len(symbols), bool)
        k = np.minimum(np.searchsorted(listed, symbols), len(listed) - 1)
        return listed[k] == symbols

    def number(self, names: np.ndarray, w: np.ndarray) -> np.ndarray:
        """For each window hash its number in the list, or -1; the second hash is worked out where the first is listed."""
        out = np.full(len(w), -1, np.int64)
        if len(self.windows):
            at = np.flatnonzero(self.maybe[(w >> np.uint64(44)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.windows[:, 0], w[at]), len(self.windows) - 1)
            same = self.windows[k, 0] == w[at]
            at, k = at[same], k[same]
            if len(at):
                w2 = second_hashes(names, at)
                same = self.windows[k, 1] == w2
                out[at[same]] = k[same]
        return out


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(max(n - 1, 0), base, np.uint64)))[:n]


def long_symbols(s, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a level's symbols with WIDTH words or more: their index, their name and a second hash of their words."""
    size = s.end - s.start
    k = np.flatnonzero((size >= WIDTH) & (size < 1 << LONG_BITS))
    sums = np.append(np.uint64(0), np.cumsum(mixed(names, 7) * _powers(_Q, len(names))))
    part = (sums[s.end[k]] - sums[s.start[k]]) * _powers(np.uint64(pow(int(_Q), -1, 1 << 64)), len(names) + 1)[s.start[k]]
    return k, s.name[k], mixed(part, size[k].astype(np.uint64))


def second_hashes(names: np.ndarray, at: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The other hash of the windows from places ``at`` on."""
    h = names[at].copy()
    for k in range(1, width):
        h *= _Q
        h += mixed(names[at + k], k)
    return mixed(h, 5)


def _batches(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of the batches with some BATCH_CHARS characters each."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(b[text]), 0))
        part = np.cumsum(size) // BATCH_CHARS
        edge = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() + [b.num_rows]
        for a, z in zip(edge, edge[1:]):
            yield b.slice(a, z - a)


def _parsed(b: pa.RecordBatch):
    """Names of words, each text's first word, the document of each word, and the words at which a whole window starts."""
    names, n = word_names(b["text"].to_pylist())
    doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
    begin = np.cumsum(n) - n
    starts = np.flatnonzero(doc[: max(0, len(doc) - WIDTH + 1)] == doc[WIDTH - 1 :])
    return names, begin, doc, starts


def _stretches(symbol: np.ndarray, doc: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and length of the stretches of windows with one symbol, of STRETCH windows at most."""
    if not len(starts):
        return starts, starts
    s = symbol[starts]
    new = np.append(True, (s[1:] != s[:-1]) | (starts[1:] != starts[:-1] + 1) | (doc[starts[1:]] != doc[starts[:-1]]))
    group = np.flatnonzero(new)
    nth = np.arange(len(s)) - np.repeat(group, np.diff(np.append(group, len(s))))
    group = np.flatnonzero(nth % STRETCH == 0)
    return starts[group], np.diff(np.append(group, len(s)))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's distinct symbols (kind 0), windows (kind 1) and long symbols (kind 3)."""
    for b in _batches(batches):
        names, begin, doc, starts = _parsed(b)
        if not len(starts):
            continue
        levels = rounds(names, doc, LONG)
        symbol = window_symbols(levels[: ROUNDS + 1], WIDTH)
        at, long_, check = long_symbols(levels[-1], names)
        first, _ = _stretches(symbol, doc, starts)
        w = window_hashes(names, WIDTH)[starts]
        w2 = second_hashes(names, starts)
        for kind, key, key2, d in ((0, symbol[first], np.zeros(len(first), np.uint64), doc[first]), (1, w, w2, doc[starts]), (3, long_, check, levels[-1].doc[at])):
            o = np.lexsort((d, key))
            o = o[np.append(True, (key[o][1:] != key[o][:-1]) | (d[o][1:] != d[o][:-1]))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(o), kind, np.int32)), pa.array(key[o].view(np.int64)), pa.array(key2[o].view(np.int64))], ["kind", "key", "key2"])


def frequent(docs: DataFrame) -> Frequent:
    """Symbols, long symbols and windows that at least LISTED of the sampled documents hold (8 documents at least)."""
    n = docs.count()
    deal = max(1, n // SAMPLE_DOCS)
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(deal)) == 0)
    least = max(8, int(LISTED * n / deal))
    rows = some.mapInArrow(_sampled, "kind int, key long, key2 long").groupBy("kind", "key", "key2").count().where(F.col("count") >= least).collect()
    symbols = np.array([r["key"] for r in rows if r["kind"] == 0], np.int64).view(np.uint64)
    windows = np.array([(r["key"], r["key2"]) for r in rows if r["kind"] == 1], np.int64).reshape(-1, 2).view(np.uint64)
    return Frequent(symbols, windows, np.array([r["key"] for r in rows if r["kind"] == 3], np.int64).view(np.uint64))


FOUND = "key long, kind int, doc_id long, row long, place long, check long"


def _rows(key, kind: int, doc, row, place, check=None) -> pa.RecordBatch:
    n = len(doc)
    cols = [np.asarray(key).view(np.int64), np.full(n, kind, np.int32), doc, row, place, np.zeros(n, np.int64) if check is None else check.view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "kind", "doc_id", "row", "place", "check"])


def _reveal(sent):
    """Rows FOUND: kind 0 a symbol's stretch, 1 the same of a frequent symbol, 2 a frequent window, 3 a long symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        none = np.iinfo(np.int64).max
        least = np.full(len(f.windows), none)
        for b in _batches(batches):
            names, begin, doc, starts = _parsed(b)
            if not len(starts):
                continue
            ids, own = b["doc_id"].to_numpy(), b["row"].to_numpy()
            levels = rounds(names, doc, LONG)
            top = levels[-1]
            at, long_, check = long_symbols(top, names)
            use = ~f.has(f.longs, long_)  # of frequent long symbols all windows are listed
            at, d = at[use], top.doc[at[use]]
            yield _rows(long_[use], 3, ids[d], own[d], (top.start[at] - begin[d]).astype(np.int64) << LONG_BITS | (top.end[at] - top.start[at]), check[use])
            symbol = window_symbols(levels[: ROUNDS + 1], WIDTH)
            first, n = _stretches(symbol, doc, starts)
            d = doc[first]
            often = f.has(f.symbols, symbol[first])
            place = (first - begin[d]) << PLACE_BITS | n
            for kind, k in ((0, np.flatnonzero(~often)), (1, np.flatnonzero(often))):
                key = symbol[first[k]]
                yield _rows(mixed(key, ids[d[k]].view(np.uint64)) if kind else key, kind, ids[d[k]], own[d[k]], place[k])
            if len(f.windows) and often.any():
                sure = np.repeat(often, n)
                number = f.number(names, _spread(window_hashes(names, WIDTH)[starts], starts, len(names)))[starts[sure]]
                hot = np.flatnonzero(number >= 0)
                np.minimum.at(least, number[hot], ids[doc[starts[sure]][hot]])
        hot = np.flatnonzero(least < none)  # one row a task for each
        yield _rows(hot, 2, least[hot], np.zeros(len(hot), np.int64), np.zeros(len(hot), np.int64))

    return run


def _spread(w: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    out[starts] = w
    return out


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, check, kind, doc_id): stretches of symbols of two documents or more, all of kind 1, the least
    of kind 2, and long symbols that a smaller document has. Stretches of large groups become kind 1."""
    low_before = 0
    for t, at, goes_on, open_ in groups_in_parts(batches, ["key", "check", "kind"], GROUP_ROWS):
        kind, doc = t["kind"].to_numpy().copy(), t["doc_id"].to_numpy()
        size = np.diff(at)
        low, high = doc[at[:-1]].copy(), doc[at[1:] - 1]
        if goes_on:
            low[0] = low_before
        large = np.zeros(len(size), bool)
        large[:1], large[-1:] = goes_on or (open_ and len(size) == 1), open_ or (goes_on and len(size) == 1)
        low_before = low[-1]
        low_row, large = np.repeat(low, size), np.repeat(large, size)
        first = np.zeros(len(doc), bool)
        first[at[:-1]] = True
        keep = (kind == 1) | (kind == 0) & (np.repeat(low != high, size) | large) | (kind == 3) & (doc > low_row) | (kind == 2) & first
        kind[large & (kind == 0)] = 1
        keep = np.flatnonzero(keep)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (doc, t["row"].to_numpy(), kind, t["key"].to_numpy(), t["place"].to_numpy())], ["doc_id", "row", "kind", "key", "place"])


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers of the ranges of n numbers from first on."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _asked(sent):
    """Rows (key, doc_id, row, place, windows) of a document's stretches: its windows' hashes, by symbol or second hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        for b in _batches(batches):
            names, begin, doc, starts = _parsed(b)
            w = window_hashes(names, WIDTH)
            found = b["found"]
            per = np.diff(found.offsets.to_numpy())
            flat = found.flatten()
            kind, key, place = (flat.field(i).to_numpy() for i in range(3))
            of = np.repeat(np.arange(b.num_rows), per)
            # windows inside known long repeats
            k = np.flatnonzero(kind == 3)
            first, size = begin[of[k]] + (place[k] >> LONG_BITS), place[k] & ((1 << LONG_BITS) - 1)
            known = np.zeros(len(names) + 1, np.int32)
            np.add.at(known, first, 1)
            np.add.at(known, first + size - WIDTH + 1, -1)
            known = np.cumsum(known) > 0
            k = np.flatnonzero(kind < 2)
            n = place[k] & ((1 << PLACE_BITS) - 1)
            at, of_stretch = _ranges(begin[of[k]] + (place[k] >> PLACE_BITS), n), np.repeat(k, n)
            ask = ~known[at]
            at, of_stretch = at[ask], of_stretch[ask]
            # stretches of frequent symbols go window by window, frequent windows not at all
            one = kind[of_stretch] == 1
            wide, wide_of = at[one], of[of_stretch[one]]
            if len(wide):
                rest = f.number(names, w)[wide] < 0
                wide, wide_of = wide[rest], wide_of[rest]
            at, of_stretch = at[~one], of_stretch[~one]
            new = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (of_stretch[1:] != of_stretch[:-1]))) if len(at) else at
            n = np.diff(np.append(new, len(at)))
            at, of_stretch = at[new], of_stretch[new]
            raw = w.tobytes()
            packed = [raw[8 * a : 8 * (a + m)] for a, m in zip(at.tolist(), n.tolist())] + [raw[8 * a : 8 * a + 8] for a in wide.tolist()]
            row = np.concatenate([of[of_stretch], wide_of])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([key[of_stretch], second_hashes(names, wide).view(np.int64)]) if len(wide) else key[of_stretch]),
                    pa.array(b["doc_id"].to_numpy()[row]),
                    pa.array(b["row"].to_numpy()[row]),
                    pa.array(np.concatenate([at, wide]) - begin[row]),
                    pa.array(packed, pa.binary()),
                ],
                ["key", "doc_id", "row", "place", "windows"],
            )

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, doc_id): (doc_id, row, place, n) of stretches of windows that a smaller document has.

    Of a group in several parts only its distinct windows and their least documents are kept from part to part.
    """
    before_w, before_low = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for t, at, goes_on, open_ in groups_in_parts(batches, ["key"], GROUP_ROWS):
        raw = t["windows"].to_pylist()
        n = np.fromiter(map(len, raw), np.int64, len(raw)) // 8
        w = np.frombuffer(b"".join(raw), np.uint64)
        row = np.repeat(np.arange(len(raw)), n)
        group = np.repeat(np.repeat(np.arange(len(at) - 1), np.diff(at)), n)
        doc, own, place = t["doc_id"].to_numpy(), t["row"].to_numpy(), t["place"].to_numpy()
        d = doc[row]
        more = len(before_w) if goes_on else 0  # what the group's earlier parts had, as rows in front
        all_w, all_d, all_g = (np.concatenate([x[:more], y]) for x, y in ((before_w, w), (before_low, d), (np.zeros(more, np.int64), group)))
        o = np.lexsort((all_d, all_w, all_g))
        new = np.append(True, (all_w[o][1:] != all_w[o][:-1]) | (all_g[o][1:] != all_g[o][:-1])) if len(o) else np.zeros(0, bool)
        low = all_d[o][new][np.cumsum(new) - 1] if len(o) else all_d
        again = np.zeros(len(all_w), bool)
        again[o] = all_d[o] > low
        if open_:
            before_w, before_low = all_w[o][new], all_d[o][new]
        k = np.flatnonzero(again[more:])
        if len(k):
            start = np.append(True, (k[1:] != k[:-1] + 1) | (row[k[1:]] != row[k[:-1]]))
            s = k[start]
            size = np.diff(np.append(np.flatnonzero(start), len(k)))
            nth = s - (np.cumsum(n) - n)[row[s]]
            yield pa.RecordBatch.from_arrays([pa.array(doc[row[s]]), pa.array(own[row[s]]), pa.array(place[row[s]] + nth), pa.array(size)], ["doc_id", "row", "place", "n"])


def _dropped(sent, hot_sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, least = sent.value, hot_sent.value
        for b in _batches(batches):
            ids, texts = b["doc_id"].to_pylist(), b["text"].to_pylist()
            again: dict[int, list] = {i: x for i, x in enumerate(b["again"].to_pylist()) if x}
            hot: dict[int, np.ndarray] = {}
            if len(f.windows):
                names, begin, doc, starts = _parsed(b)
                number = f.number(names, _spread(window_hashes(names, WIDTH)[starts], starts, len(names)))
                at = starts[number[starts] >= 0]
                if len(at):
                    id_of = np.array([np.iinfo(np.int64).min if i is None else i for i in ids])
                    at = at[least[number[at]] < id_of[doc[at]]]
                    for d in np.unique(doc[at]).tolist():
                        hot[d] = at[doc[at] == d] - begin[d]
            n_words, n_removed, kept = [], [], []
            for i, t in enumerate(texts):
                ws = t.encode().split() if t else []
                n_words.append(len(ws))
                if i in again or i in hot:
                    gone = np.zeros(len(ws) + 1, np.int64)
                    for r in again.get(i, ()):
                        gone[r["place"]] += 1
                        gone[r["place"] + r["n"] + WIDTH - 1] -= 1
                    for p in hot.get(i, ()):
                        gone[p] += 1
                        gone[p + WIDTH] -= 1
                    stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()
                    n_removed.append(len(ws) - len(stay))
                    ws = [ws[k] for k in stay]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(ws).decode())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def _with_row(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with a row key, and the columns that name a text. Where unequal texts have one id, the key is a hash of the
    text; it is 0 for all others, which takes hardly any room, and where there is no such id doc_id alone names a text."""
    of = F.xxhash64("text")
    several = docs.groupBy("doc_id").agg(F.min(of).alias("low"), F.max(of).alias("high")).where("low <> high").select("doc_id", F.lit(True).alias("several"))
    several = staged(several, "repeated-ids")
    n = several.count()
    if not n:
        return docs.withColumn("row", F.lit(0).cast("long")), ["doc_id"]
    docs = docs.join(F.broadcast(several) if n <= MOST_IDS else several, "doc_id", "left")
    return docs.select("doc_id", "text", F.when(F.col("several"), of).otherwise(F.lit(0)).cast("long").alias("row")), ["doc_id", "row"]


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the remaining words joined by one space. Takes doc_id and text."""
    sc = docs.sparkSession.sparkContext
    if docs.schema["doc_id"].dataType.simpleString() != "bigint":  # a cast that changes nothing would hide that both joins read alike
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    nameless, (known, of) = docs.where("doc_id is null"), _with_row(docs.where("doc_id is not null"))
    texts = known.select(*of, "text")  # one shuffle of it serves both joins below
    row = F.col("row") if "row" in of else F.lit(0).cast("long").alias("row")
    f = frequent(known)
    sent = sc.broadcast(f)
    rows = known.mapInArrow(_reveal(sent), FOUND).repartition("key", "kind").sortWithinPartitions("key", "check", "kind", "doc_id")
    found = staged(rows.mapInArrow(_shared, "doc_id long, row long, kind int, key long, place long"), "substrings")
    least = np.full(len(f.windows), np.iinfo(np.int64).max)
    for r in found.where("kind = 2").groupBy("key").agg(F.min("doc_id").alias("d")).collect():  # one row a listed window
        least[r["key"]] = r["d"]
    hot = sc.broadcast(least)
    lists = found.where("kind <> 2").groupBy(*of).agg(F.collect_set(F.struct("kind", "key", "place")).alias("found"))  # equal rows of one id give equal findings
    asked = texts.join(lists, of).select("doc_id", row, "text", "found").mapInArrow(_asked(sent), "key long, doc_id long, row long, place long, windows binary")
    again = asked.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(_verified, "doc_id long, row long, place long, n long")
    size = F.col("place").bitwiseAND(F.lit((1 << LONG_BITS) - 1))
    again = again.union(found.where("kind = 3").select("doc_id", "row", F.shiftright("place", LONG_BITS), size - WIDTH + 1))
    again = again.groupBy(*of).agg(F.collect_set(F.struct("place", "n")).alias("again"))
    both = texts.join(again, of, "left").select("doc_id", "text", "again")
    both = both.union(nameless.select("doc_id", "text", F.lit(None).cast(both.schema["again"].dataType)))
    return both.mapInArrow(_dropped(sent, hot), "doc_id long, n_words long, n_removed long, kept string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


_WORDS_SQL = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"
OP1_SQL = rf"""
WITH w AS (
  SELECT doc_id, {_WORDS_SQL} AS ws FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {WIDTH - 1}], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WIDTH - 2})) AS i FROM w WHERE len(ws) >= {WIDTH})
), again AS (
  SELECT DISTINCT doc_id, i + k AS at FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM g), (SELECT unnest(range({WIDTH})) AS k)
  WHERE least < doc_id
), kept AS (
  SELECT w.doc_id, count(again.at) AS n_removed, coalesce(string_agg(w.word, ' ' ORDER BY w.i) FILTER (again.at IS NULL), '') AS kept
  FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w) w LEFT JOIN again ON again.doc_id = w.doc_id AND again.at = w.i
  GROUP BY w.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
