"""Language identification: averaged hashed subword embeddings under a linear softmax.

A word's features are its byte n-grams with end marks, hashed into BUCKETS rows of an embedding
table; a text is the average of its words' feature embeddings, and a linear layer with softmax gives
its language. Both are trained by stochastic gradient descent in numpy on whole texts of a bounded sample of labelled rows, which each
language fills alike. A part of the sample is kept out of training: on it a temperature is fitted (calibration), and the least score with
which the accepted part keeps the wanted precision becomes the rejection threshold.
"""

from __future__ import annotations

import pickle
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import by_bytes, filtered, pieces
from quarry.llm.tokens import caches, claim

UNKNOWN = "und"
#: Rows of the embedding table (a power of two), its width, the n-gram lengths in bytes.
BUCKETS, WIDTH, GRAMS = 1 << 15, 16, (2, 3, 4)
#: Bound of the training sample in labelled rows. A row comes as the counts of its buckets: 6 bytes a bucket, whatever its length.
SAMPLE_ROWS = 1_500
#: Rows whose hash of the id is small are looked at: so many times the rows that a language has in the sample, on average.
SPARE = 4
#: Least number of steps of gradient descent.
STEPS = 900
CACHE_WORDS = 300_000
_LIVE: dict = {}
caches("langid", _LIVE.clear)


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # BUCKETS x languages: embeddings times the linear layer
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all words' n-grams, and for each id the place of its word."""
    marked = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8)
    size = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), size)
    ids, own = [], []
    h = marked.astype(np.uint64)
    for n in range(2, max(GRAMS) + 1):
        if len(marked) < n:
            break
        h = h[: len(marked) - n + 1] * np.uint64(0x100000001B3) + marked[n - 1 :]
        if n in GRAMS:
            inside = owner[n - 1 :] == owner[: len(owner) - n + 1]
            ids.append((((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))[inside])
            own.append(owner[n - 1 :][inside])
    return (np.concatenate(ids), np.concatenate(own)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _counts(text: str) -> bytes:
    """Counts of a whole text's buckets: their ids (2 bytes each), then their shares (4 bytes each)."""
    words, n = Counter(text.lower().encode().split()), np.zeros(BUCKETS, np.int64)
    words, times = list(words), np.fromiter(words.values(), np.int64, len(words))
    for at in range(0, len(words), 50_000):
        ids, own = features(words[at : at + 50_000])
        n += np.bincount(ids, times[at : at + 50_000][own], BUCKETS).astype(np.int64)
    ids = np.flatnonzero(n)
    return ids.astype("<u2").tobytes() + (n[ids] / max(n.sum(), 1)).astype("<f4").tobytes()


def _sample(docs: DataFrame, training: Column, rows: int) -> list:
    """(lang, bucket ids, their shares) of at most `rows` labelled rows: of each language those with the least hashes of their ids, rare
    languages with all their rows; if there are more languages than rows, the most frequent languages."""
    labelled = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()
    if not found:
        return []
    quota = rows // len(found)
    share = docs.sparkSession.createDataFrame([(r.lang, min(1.0, SPARE * quota / r.n)) for r in found], "_lang string, _share double")
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    near = labelled.select("doc_id", "lang", "text").join(F.broadcast(share), F.col("lang") == F.col("_lang")).where(draw < F.col("_share"))

    def run(batches):
        for batch in batches:
            keep = [(i, lang, _counts(text)) for i, lang, text in zip(*(c.to_pylist() for c in batch.columns)) if has_letter(text)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([k[0] for k in keep], pa.int64()), "lang": pa.array([k[1] for k in keep], pa.string()), "f": pa.array([k[2] for k in keep], pa.binary())})

    made = near.select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(run, "doc_id long, lang string, f binary")
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "f")
    chosen = made.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= quota).select("lang", "f").collect()
    out = []
    for lang, f in sorted((r.lang, bytes(r.f)) for r in chosen):
        n = len(f) // 6
        out.append((lang, np.frombuffer(f, "<u2", n).astype(np.int32), np.frombuffer(f, "<f4", n, 2 * n)))
    return out


def fit(docs: DataFrame, training: Column, rows: int = SAMPLE_ROWS, epochs: int = 12, rate: float = 8.0, precision: float = 0.99, seed: int = 11) -> Model:
    """Train on at most `rows` labelled rows of docs (doc_id, text, lang) for which training holds. Rows without a label, text or
    letter are left out; without any others (an empty table, say) the model knows no language. Of repeated rows each
    counts; which rows are taken depends on ids and texts only, ties included."""
    found = [x for x in _sample(docs, training, rows) if len(x[1])]
    langs = sorted({x[0] for x in found})
    if not found:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(found))
    held = order[: len(found) // 5] if len(found) >= 50 else order[:0]
    learn = order[len(held) :]
    emb = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out = np.zeros((WIDTH, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    y = np.array([langs.index(x[0]) for x in found])
    size = 16
    epochs = max(epochs, -(-STEPS * size // len(learn)))  # a small sample is gone through more often
    steps, step = epochs * -(-len(learn) // size), 0
    for _ in range(epochs):
        rng.shuffle(learn)
        for at in range(0, len(learn), size):
            batch = learn[at : at + size]
            lr = rate * (1 - step / steps)
            step += 1
            ids = np.concatenate([found[i][1] for i in batch])
            share = np.concatenate([found[i][2] for i in batch])[:, None]
            n = np.array([len(found[i][1]) for i in batch])
            mean = np.add.reduceat(emb[ids] * share, np.append(0, np.cumsum(n)[:-1]), axis=0)
            p = _softmax(mean @ out + bias)
            p[np.arange(len(batch)), y[batch]] -= 1
            back = p @ out.T / len(batch)
            out -= lr * mean.T @ p / len(batch)
            bias -= lr * 0.1 * p.mean(0)
            # a bucket occurs once in a document: one pass a document adds up what several of them say of it
            for i, b in zip(batch, back):
                emb[found[i][1]] -= lr * found[i][2][:, None] * b
    model = Model(langs, (emb @ out).astype(np.float32), bias)
    if len(held):
        logits = np.array([found[i][2] @ model.scores[found[i][1]] + bias for i in held])
        model.temperature, model.threshold = calibrated(logits, y[held], precision)
    return model


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def calibrated(logits: np.ndarray, y: np.ndarray, precision: float) -> tuple[float, float]:
    """The temperature with the least log loss, and the least score from which on all accepted held-out
    rows are right with the wanted precision (0 if all rows together are)."""
    grid = np.geomspace(0.25, 5, 60)
    t = float(min(grid, key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean()))
    p = _softmax(logits / t)
    best, right = p.max(1), p.argmax(1) == y
    by = np.argsort(-best)
    good = np.cumsum(right[by]) / np.arange(1, len(by) + 1) >= precision
    if good[-1]:
        return t, 0.0
    return t, float(best[by][np.flatnonzero(good)[-1]]) if good.any() else 1.0


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, lang_pred, score, accepted.

    A null or empty text, or one without a letter, is UNKNOWN with score 0 and not accepted; so is every
    text if the model learned no language. Of equally likely languages the first by name wins. Texts are read whole, however
    long. Null and repeated ids pass through; an empty table gives an empty table; other columns, lang and source too, are never read.
    """
    judge = _judge(docs, model)

    def run(batches):
        for batch in batches:
            lang, score, ok = judge(batch)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64()), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "accepted": pa.array(ok, pa.bool_())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def _judge(docs: DataFrame, model: Model):
    """A function from a batch (doc_id, text) to languages, scores and whether each is accepted."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    stamp = uuid.uuid4().hex

    def judge(batch):
        claim("langid")
        if _LIVE.get("stamp") != stamp:
            _LIVE.update(stamp=stamp, model=pickle.loads(sent.value), words={}, table=None)
        model, lang, score = _LIVE["model"], [], []
        for part in by_bytes(batch):
            a, b = predict(model, part.column(1).to_pylist())
            lang, score = lang + a, score + b
        return lang, score, [name != UNKNOWN and s >= model.threshold for name, s in zip(lang, score)]

    return judge


def accepted_only(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns as they are, whose language is recognised and not rejected: identify()'s accepted ones. Null
    and repeated ids stay or go by their texts; an empty table gives an empty table."""
    judge = _judge(docs, model)
    return filtered(docs, lambda batch: judge(batch)[2])


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and calibrated probability of each text. Words' summed scores are kept for the next batch."""
    k = len(model.langs)
    known, table = _LIVE.get("words"), _LIVE.get("table")
    if known is None or table is None or len(known) > CACHE_WORDS or _LIVE.get("model") is not model:
        known, table = {}, np.zeros((65_536, k + 1), np.float64)
        _LIVE.update(words=known, table=table, rows=0, model=model)
    langs, scores = [], []
    for text in texts:
        total, some = np.zeros(k + 1), False
        for piece in pieces(text) if k and has_letter(text) else ():
            words = piece.lower().encode().split()
            new = list(dict.fromkeys(w for w in words if w not in known))
            if new:
                rows = np.zeros((len(new), k + 1))
                for at in range(0, len(new), 50_000):
                    part = new[at : at + 50_000]
                    ids, own = features(part)
                    for c in range(k):
                        rows[at : at + len(part), c] = np.bincount(own, model.scores[ids, c], len(part))
                    rows[at : at + len(part), k] = np.bincount(own, minlength=len(part))
                held = _LIVE["rows"]
                if held + len(new) > len(table):
                    table = _LIVE["table"] = np.concatenate([table, np.zeros((max(len(table), len(new)), k + 1))])
                table[held : held + len(new)] = rows
                known.update(zip(new, range(held, held + len(new))))
                _LIVE["rows"] = held + len(new)
            if words:
                some = True
                total += table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(0)
        if not some:
            langs.append(UNKNOWN)
            scores.append(0.0)
            continue
        p = _softmax(((total[:k] / max(total[k], 1) + model.bias) / model.temperature)[None])[0]
        best = int(p.argmax())
        langs.append(model.langs[best])
        scores.append(float(p[best]))
    return langs, scores
