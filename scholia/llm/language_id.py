"""Language identification in two steps: the family first, then linear support vector machines within it.

Method. A text's features are hashed byte trigrams of its lower-cased letters over the whole text, as the square root
of their frequencies. A family classifier picks the language family; within it, one-versus-one machines, one for each
pair of its languages, vote by their margins. All are linear machines with a squared hinge loss, trained on some
TRAIN_ROWS documents, at most twice as many, drawn by a hash of the id, evenly by language. Prediction runs in Arrow batches over all rows.

Defined results: null texts and texts without a letter give ``und`` with score 0; without any labelled row all give
``und``; rows with null ids count as id ''; repeated rows are predicted each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, read, shared_dir

DIM = 2048
TRAIN_ROWS = 6000
BROADCAST_LANGS = 10_000
ROUNDS = 200
DECAY = 1e-4
# fixed values: languages by family; any other language is a family of its own
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "pl", "cs", "sk", "uk", "bg", "sr", "hr", "sl"),
}
LETTER = re.compile(r"[^\W\d_]")
_BLANK = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), f"only-{lang}")


def features(text: str) -> np.ndarray | None:
    """DIM frequencies, or None for a text without a letter."""
    if not text or not LETTER.search(text):
        return None
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_BLANK) + b" ", np.uint8).astype(np.uint32)
    code = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
    kept = code[(b[1:-1] != 32)]
    n = np.bincount((kept * np.uint32(0x27D4EB2F)) >> np.uint32(21), minlength=DIM)
    return np.sqrt(n / max(1, n.sum())).astype(np.float32)


def _machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear machine for labels -1 and 1: squared hinge, accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = y.astype(np.float32)  # one type throughout: else the whole matrix would be converted in every round
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    ahead, rate = w.copy(), np.float32(0.2)
    for k in range(ROUNDS):
        slack = np.maximum(np.float32(0), 1 - y * (x @ ahead))
        new = ahead - rate * (np.float32(DECAY) * ahead - 2 * ((share * y * slack) @ x))
        ahead, w = new + np.float32(k / (k + 3)) * (new - w), new
    return w


class Model:
    """Family machines (one against the rest) and, within each family, one machine for each pair of languages."""

    def __init__(self, langs: list[str], x: np.ndarray):
        of = np.array([family(v) for v in langs])
        langs_ = np.array(langs)
        self.families = sorted(set(of))
        self.langs = {f: sorted(set(langs_[of == f])) for f in self.families}
        self.family_w = [_machine(x, np.where(of == f, 1.0, -1.0)) for f in self.families] if len(self.families) > 1 else []
        self.pairs = {}
        for f in self.families:
            for i, a in enumerate(self.langs[f]):
                for b in self.langs[f][i + 1 :]:
                    rows = (langs_ == a) | (langs_ == b)
                    self.pairs[a, b] = _machine(x[rows], np.where(langs_[rows] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        soft = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -20, 20)))
        out, score = np.empty(len(x), object), np.ones(len(x))
        chosen = np.zeros(len(x), int)
        if self.family_w:
            margins = np.stack([x @ w for w in self.family_w], 1)
            chosen = margins.argmax(1)
            score *= soft(margins[np.arange(len(x)), chosen])
        for k, f in enumerate(self.families):
            rows, langs = np.flatnonzero(chosen == k), self.langs[f]
            votes = np.zeros((len(rows), len(langs)))
            for i, a in enumerate(langs):
                for j in range(i + 1, len(langs)):
                    p = soft(x[rows] @ self.pairs[a, langs[j]])
                    votes[:, i] += p
                    votes[:, j] += 1 - p
            best = votes.argmax(1)
            out[rows] = np.array(langs, object)[best]
            if len(langs) > 1:
                score[rows] *= votes[np.arange(len(rows)), best] / (len(langs) - 1)
        return list(out), score


def train(docs: DataFrame, text: str, lang: str, key: str, train_rows: int = TRAIN_ROWS) -> Model | None:
    """A model of the labelled rows of ``docs``; at most 2 * ``train_rows`` feature rows reach the driver, by a hash's order."""
    shared_dir(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("v"), F.xxhash64(F.col(key), F.lit(11)).alias("h"))
    counts = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    n_langs = counts.count()
    if not n_langs:
        return None
    share = counts.select("v", (F.lit(max(1, train_rows // n_langs)) / F.col("n")).alias("share"))
    drawn = rows.join(F.broadcast(share) if n_langs <= BROADCAST_LANGS else share, "v").where(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(h, v, features(t)) for t, v, h in zip(b["t"].to_pylist(), b["v"].to_pylist(), b["h"].to_pylist(), strict=True)]
            got = [(h, v, f.tobytes()) for h, v, f in got if f is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.binary())], ["h", "v", "f"])

    found = sorted((r["v"], bytes(r["f"])) for r in drawn.mapInArrow(make, "h long, v string, f binary").orderBy("h", "v", "f").limit(2 * train_rows).collect())
    if not found:
        return None
    return Model([v for v, _ in found], np.stack([np.frombuffer(f, np.float32) for _, f in found]))


def identify(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs``, lang_pred and score."""
    own = fresh(docs, "text")
    kept = docs.select(*keep, F.col(text).alias(own))
    names = [f.name for f in kept.schema.fields][:-1]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            for at in range(0, b.num_rows if model else 0, 2000):
                got = [(at + i, f) for i, t in enumerate(b[own].slice(at, 2000).to_pylist()) if (f := features(t)) is not None]
                if got:
                    rows = [i for i, _ in got]
                    langs[rows], scores[rows] = model.predict(np.stack([f for _, f in got]))
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), pa.array(list(langs), pa.string()), pa.array(scores)], [*names, "lang_pred", "score"])

    schema = kept.drop(own).schema.add("lang_pred", "string").add("score", "double")
    return kept.mapInArrow(apply, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    model = train(docs.where(~held), "text", "lang", "doc_id")
    return identify(docs.withColumn("held_out", held), model, ["doc_id", "held_out"])
