"""Token ids of whole texts by the tokenizers library, with a cache of words.

Arrow splits the texts of a batch at white space and numbers their distinct words. Words of Latin letters count alike in
either case, with or without one mark behind them, as the tokenizer lowers letters and never joins letters with marks. What
is left of them is encoded by the library once per worker while it stays in the cache; a full cache keeps the words it met
first. A vocabulary whose file doesn't promise these rules is used on whole texts instead, without a cache.
"""

from __future__ import annotations

import json
import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS = 600_000
CACHE_KEPT = 150_000
JOINED = 2000
BATCH_CHARS = 4_000_000
MARKS = ".,;:!?"
LATIN = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}"  # letters below U+0250 whose lower case is one letter
PLAIN = f"^[{LATIN}]+$"
MARKED = f"^[{LATIN}]+[{MARKS}]$"
WORD_END = "</w>"


def by_words(tok) -> bool:
    """Whether the tokenizer lowers letters, drops white space, parts letters from marks and closes each part by WORD_END."""
    told = json.loads(tok.to_str())
    norm, pre = told.get("normalizer") or {}, told.get("pre_tokenizer") or {}
    norms = {n["type"] for n in norm.get("normalizers", [norm]) if n}
    steps = pre.get("pretokenizers") or [pre]
    split = steps[0]
    whole = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and r"|[\p{L}]+|" in split["pattern"].get("Regex", "") and r"[^\s\p{L}\p{N}]+" in split["pattern"]["Regex"]
    return bool(whole) and "Lowercase" in norms and norms <= {"NFC", "Replace", "Lowercase"} and told["model"].get("end_of_word_suffix") == WORD_END and [s.get("type") for s in steps[1:]] == ["ByteLevel"]


class Coder:
    def __init__(self, vocabulary: str = VOCABULARY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        vocab = self.tok.get_vocab()
        self.wide = np.uint16 if len(vocab) <= 1 << 16 else np.uint32
        self.cached = by_words(self.tok)
        if self.cached:
            self.closes = np.zeros(max(vocab.values()) + 1, bool)
            self.closes[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True
            marks = [self.tok.encode(m, add_special_tokens=False).ids for m in MARKS]
            self.cached = all(len(m) == 1 for m in marks)
            self.mark_ids = np.array([m[0] for m in marks], np.uint32)
            # lower-case letters need no normalizing and no pattern: the same merges after a split at blanks
            self.merges = Tokenizer(self.tok.model)
            self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 0
        self.first, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _trim(self) -> None:
        """Keeps the words met first, which are mostly the frequent ones."""
        n = min(CACHE_KEPT, len(self.number))
        ids, size = self._of(np.arange(n)), self.size[:n].copy()
        kept = [w for w, i in self.number.items() if i < n]
        self._clear()
        self._keep(kept, ids, size)

    def _keep(self, words: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        n = len(self.number)
        while n + len(words) > len(self.first):
            self.first, self.size = np.resize(self.first, 2 * len(self.first)), np.resize(self.size, 2 * len(self.size))
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.size[n : n + len(words)] = size
        self.first[n : n + len(words)] = self.n_ids + np.cumsum(size) - size
        self.n_ids += len(flat)
        self.number.update(zip(words, range(n, n + len(words))))

    def _of(self, p: np.ndarray) -> np.ndarray:
        """Ids of the words numbered ``p``, one after another."""
        n = self.size[p]
        return self.ids[np.repeat(self.first[p] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def _learn_plain(self, words: list[str]) -> None:
        """Words of letters: many in one call, each of them one part, so the tokens that close a part divide them."""
        for at in range(0, len(words), JOINED):
            part = words[at : at + JOINED]
            ids = np.array(self.merges.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            self._keep(part, ids, np.diff(np.flatnonzero(self.closes[ids]), prepend=-1))

    def _learn_other(self, words: list[str]) -> None:
        for at in range(0, len(words), JOINED):
            part = words[at : at + JOINED]
            ids = [e.ids for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
            self._keep(part, np.array([i for x in ids for i in x], np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _numbers(self, words: pa.Array, learn) -> np.ndarray:
        """Cache numbers of distinct words, after learning the new ones."""
        words = words.to_pylist()
        got = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(got < 0)
        if len(new):
            got[new] = len(self.number) + np.arange(len(new))  # learnt words are numbered in order
            learn([words[i] for i in new.tolist()])
        return got

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each word of all texts its ids, one after another, and its number of ids."""
        coded = words.dictionary_encode()
        distinct, at = coded.dictionary, coded.indices.to_numpy()
        marked = pc.match_substring_regex(distinct, MARKED)
        plain = pc.or_(marked, pc.match_substring_regex(distinct, PLAIN))
        marked, is_plain = np.asarray(marked), np.asarray(plain)
        base = np.zeros(len(distinct), np.int64)
        own = pc.utf8_lower(pc.utf8_rtrim(distinct.filter(plain), characters=MARKS)).dictionary_encode()
        base[is_plain] = self._numbers(own.dictionary, self._learn_plain)[own.indices.to_numpy()]
        base[~is_plain] = self._numbers(distinct.filter(pc.invert(plain)), self._learn_other)
        mark = np.zeros(len(distinct), np.uint32)
        if marked.any():
            last = pc.utf8_slice_codeunits(distinct.filter(pa.array(marked)), -1)
            mark[marked] = self.mark_ids[pc.index_in(last, value_set=pa.array(list(MARKS))).to_numpy()]
        b, m = base[at], marked[at]
        n = self.size[b] + m
        out = np.empty(int(n.sum()), np.uint32)
        ends = np.cumsum(n)
        at_mark = np.zeros(len(out), bool)
        at_mark[ends[m] - 1] = True
        out[at_mark] = mark[at][m]
        out[~at_mark] = self._of(b)
        return out, n

    def encode(self, texts: pa.Array | list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and each text's first place in them (one place more than texts)."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not self.cached:
            each = [e.ids for e in self.tok.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            flat, sizes = np.array([i for x in each for i in x], np.uint32), np.fromiter(map(len, each), np.int64, len(each))
        else:
            if len(self.number) > CACHE_WORDS:
                self._trim()
            split = pc.ascii_split_whitespace(texts)
            per = pc.list_value_length(split).to_numpy()
            flat, n = self._word_ids(split.flatten()) if int(per.sum()) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            words = np.append(0, np.cumsum(per))
            sizes = np.diff(np.append(0, np.cumsum(n))[words])
        starts = np.append(0, np.cumsum(sizes)).astype(np.int64)
        if end is not None:
            flat = np.insert(flat, starts[1:], np.uint32(end))
            starts += np.arange(len(starts))
        return flat.astype(np.uint32), starts


def batches_by_size(batch: pa.RecordBatch, text: str = "text", chars: int = BATCH_CHARS):
    """Parts of a batch with some ``chars`` bytes of text each."""
    if batch.num_rows:
        part = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy().astype(np.int64)) // chars
        edge = [*np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist(), batch.num_rows]
        for a, z in zip(edge, edge[1:]):
            yield batch.slice(a, z - a)


_coders: dict[str, Coder] = {}


def coder(vocabulary: str = VOCABULARY) -> Coder:
    """This worker's coder."""
    if vocabulary not in _coders:
        _coders[vocabulary] = Coder(vocabulary)
    return _coders[vocabulary]
