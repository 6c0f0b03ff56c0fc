"""Language ID: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy, with calibration.

A text is the average of the embeddings of its character n-grams (2 to 4, within words and across one word edge),
hashed into 2 ** BITS rows. Training takes at most `per_lang` labelled rows of each language (the least hashes of the
id), whose n-gram counts the executors make; everything else (prediction, the share of each language) covers all
rows. Every fifth of them calibrates: a temperature, and the score under which a prediction is not to be trusted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _arrays as A
from ._pack import pack, unpack

BITS, DIM, NGRAMS, EPOCHS, RATE = 16, 16, (2, 3, 4), 6, 0.5
#: Bounds of the training sample: labelled rows of each language, and languages (those of the most rows).
PER_LANG, MOST_LANGS = 800, 256
#: Characters whose n-grams are held at once, and groups that a language's rows are dealt to before they meet.
PIECE, DEALT = 1 << 20, 64

_alpha = np.array([chr(i).isalpha() for i in range(0x3000)])


def _letters(chars: np.ndarray) -> np.ndarray:
    if not len(chars) or chars.max() < len(_alpha):
        return _alpha[chars]
    kinds, of = np.unique(chars, return_inverse=True)
    return np.array([chr(c).isalpha() for c in kinds])[of]


def pieces(text: str | None, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about `size` characters, cut at characters that are no letters, which no n-gram goes over."""
    at, text = 0, text or ""
    while len(text) - at > size:
        end = next((i for i in range(at + size, len(text)) if not text[i].isalpha()), len(text))
        yield text[at:end]
        at = end + 1
    yield text[at:]


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of all n-grams of each text, one text after the other, and where each text's begin."""
    parts = [("\0" + (t or "").lower() + "\0").encode("utf-32-le", "surrogatepass") for t in texts]
    first = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])])
    chars = np.frombuffer(b"".join(parts), np.uint32)
    letter = _letters(chars)
    chars = np.where(letter, chars, 0).astype(np.uint64)
    rows, places = [], []
    for n in NGRAMS:
        if len(chars) < n:
            continue
        size = len(chars) - n + 1
        ok = letter[:size] | letter[n - 1 :]
        for k in range(1, n - 1):
            ok &= letter[k : size + k]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * A.U64(0x9E3779B97F4A7C15) + chars[at + k]
        rows.append((A.mix(h) >> A.U64(64 - BITS)).astype(np.int32))
        places.append(at)
    if not places:  # no texts: a text has two characters at least, those at its ends
        return np.zeros(0, np.int32), np.zeros(len(first), np.int64)
    place = np.concatenate(places)
    order = np.argsort(place, kind="stable")
    return np.concatenate(rows)[order], np.searchsorted(place[order], first)


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # of each embedding row, under the softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    least_score: float = 0.0

    def raw(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of each text, before the temperature (0 for a text without n-grams), and how many n-grams it has.

        Long texts come in pieces, so what is held at once is bounded.
        """
        out, count = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)

        def add(part: list[str], of: list[int]) -> None:
            rows, begins = features(part)
            sizes = np.diff(begins)
            some = np.flatnonzero(sizes)
            if len(some):
                np.add.at(out, np.array(of)[some], np.add.reduceat(self.logits[rows], begins[some], axis=0))
                np.add.at(count, np.array(of)[some], sizes[some])

        part: list[str] = []
        of: list[int] = []
        held = 0
        for k, text in enumerate(texts):
            for piece in pieces(text):
                part.append(piece)
                of.append(k)
                held += len(piece)
                if held >= PIECE:
                    add(part, of)
                    part, of, held = [], [], 0
        if part:  # none if the last piece filled what is held
            add(part, of)
        some = count > 0
        out[some] = out[some] / count[some, None] + self.bias
        return out, count

    def scores(self, raw: np.ndarray) -> np.ndarray:
        x = raw / self.temperature
        x = np.exp(x - x.max(1, keepdims=True))
        return x / x.sum(1, keepdims=True)


def train(samples: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 1) -> Model:
    """A model of (language, embedding rows, counts); every fifth sample only calibrates."""
    langs = sorted({lang for lang, _, _ in samples})
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (1 << BITS, DIM))
    weights, bias = rng.normal(0, 0.1, (DIM, len(langs))), np.zeros(len(langs))
    place = {lang: i for i, lang in enumerate(langs)}
    data = [(place[lang], rows, (counts / counts.sum())[:, None]) for lang, rows, counts in samples if len(rows)]
    fit, held = [x for i, x in enumerate(data) if i % 5], data[::5]
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fit)):
            lang, rows, share = fit[i]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = (emb[rows] * share).sum(0)
            x = mean @ weights + bias
            g = np.exp(x - x.max())
            g /= g.sum()
            g[lang] -= 1
            back = weights @ g
            weights -= rate * np.outer(mean, g)
            bias -= rate * g
            emb[rows] -= (rate * len(rows) ** 0.5) * share * back
    model = Model(langs, emb @ weights, bias)
    if held and len(langs) > 1:
        raw = np.stack([(model.logits[rows] * share).sum(0) + bias for _, rows, share in held])
        truth = np.array([lang for lang, _, _ in held])
        grid = np.geomspace(0.05, 20, 60)
        loss = [-np.log(np.maximum(Model(langs, model.logits, bias, t).scores(raw)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        scores = model.scores(raw)
        right = scores.argmax(1) == truth
        # the least score from which on 99 % of the predictions are right
        order = np.argsort(-scores.max(1))
        ok = np.cumsum(right[order]) >= 0.99 * np.arange(1, len(order) + 1)
        model.least_score = float(scores.max(1)[order][np.flatnonzero(ok)[-1]]) if ok.any() else 1.0
    return model


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in A.blocks(batches):
        out = []
        for text in block.column("text").to_pylist():
            total = np.zeros(1 << BITS, np.int64)
            for piece in pieces(text):
                total += np.bincount(features([piece])[0], minlength=1 << BITS)
            rows = np.flatnonzero(total)
            out.append((rows, total[rows]))
        yield pa.RecordBatch.from_arrays([block.column("lang"), block.column("order"), pa.array([pack(r, np.int32) for r, _ in out], pa.binary()), pa.array([pack(c, np.int32) for _, c in out], pa.binary())], names=["lang", "order", "rows", "counts"])


def fit(docs: DataFrame, use: Column, per_lang: int = PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Trains on at most per_lang rows of each non-null language that `use` is true of, and at most MOST_LANGS languages;
    None if there is none.

    A row's features have at most 2 ** BITS entries, however long its text, so what comes to the driver is bounded.
    """
    read = docs.filter(use).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("order")).filter("text IS NOT NULL AND lang IS NOT NULL")
    langs = read.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(MOST_LANGS)
    # the least hashes of each of some groups of a language first, so that no task has a whole language
    dealt = read.select("lang", "order", F.pmod(F.xxhash64("order"), F.lit(DEALT)).alias("g")).join(F.broadcast(langs.select("lang")), "lang")
    some = dealt.withColumn("n", F.row_number().over(Window.partitionBy("lang", "g").orderBy("order"))).filter(F.col("n") <= per_lang)
    first = some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("order"))).filter(F.col("n") <= per_lang)
    limits = first.groupBy(F.col("lang").alias("l")).agg(F.max("order").alias("most"))
    chosen = read.join(F.broadcast(limits), (F.col("lang") == F.col("l")) & (F.col("order") <= F.col("most"))).select("text", "lang", "order")
    rows = chosen.mapInArrow(_sampled, "lang string, order long, rows binary, counts binary").collect()  # per_lang rows of each of MOST_LANGS at most
    if not rows:
        return None
    rows.sort(key=lambda r: (r.order, r.lang, bytes(r.rows)))
    return train([(r.lang, unpack(bytes(r.rows), np.int32), unpack(bytes(r.counts), np.int32).astype(float)) for r in rows])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, lang_pred, score (0 to 1) and accepted of each row of docs, from the whole text.

    A null text and one without a letter are `und` with score 0, as is everything without a model. accepted: the score
    is at least what calibration asks for.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for block in A.blocks(batches, max_bytes=2 << 20):
            n = block.num_rows
            langs, scores, accepted = ["und"] * n, np.zeros(n), np.zeros(n, bool)
            if own is not None:
                raw, count = own.raw(block.column("text").to_pylist())
                prob, some = own.scores(raw), count > 0
                best = prob.argmax(1)
                langs = [own.langs[b] if s else "und" for b, s in zip(best, some, strict=True)]
                scores = np.where(some, prob.max(1), 0.0)
                accepted = some & (scores >= own.least_score)
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(langs), pa.array(scores), pa.array(accepted)], names=["id", "lang_pred", "score", "accepted"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    return read.mapInArrow(run, f"id {kind}, lang_pred string, score double, accepted boolean").withColumnRenamed("id", id_col)
