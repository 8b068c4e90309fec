"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is lower-cased, what is no letter becomes a blank, and its byte n-grams of 2 to 4 bytes are
hashed to rows of an embedding table; the softmax reads the average. Table and weights are trained by
stochastic gradient descent in numpy on a bounded sample: at most ``per_lang`` labelled documents of
each language, those with the least hash of their id. A document of the sample is learned as a whole: it
goes to the driver as the shares that its n-grams of each bucket have in the whole text, so that its size
there is bounded by the number of buckets. A part of the sample that did not train sets the temperature,
which makes scores probabilities, and the threshold below which a text is rejected; both are fitted on
whole texts too.

Every whole text is scored; scores read nothing but the text. Null texts and texts without a letter
are ``und`` with score 0, and rejected; so are all if nothing is labelled. Repeated rows score alike;
an empty table gives an empty result; other columns pass through or are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkblot.llm.common import crc_mod, lean_batches, small_batches

BUCKETS, DIM, SIZES = 1 << 15, 16, (2, 3, 4)
PER_LANG = 1500
NONE = "und"
# lower-cased ASCII letters and all bytes of other letters stay; the rest becomes a blank
_TABLE = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_MIX = {2: np.uint32(0x9E3779B1), 3: np.uint32(0x85EBCA6B), 4: np.uint32(0xC2B2AE35)}


def plain(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_TABLE)


def has_letter(text: str, data: bytes) -> bool:
    if any(97 <= c <= 122 for c in data[:200]):
        return True
    return any(map(str.isalpha, set(text)))


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each byte, for as many bytes as have one."""
    value = data[: len(data) - n + 1].astype(np.uint32)
    for i in range(1, n):
        value = (value << np.uint32(8)) | data[i : len(data) - n + 1 + i]
    value ^= value >> np.uint32(15)
    value *= _MIX[n]
    value ^= value >> np.uint32(13)
    value *= np.uint32(0x27D4EB2F)
    return value >> np.uint32(32 - BUCKETS.bit_length() + 1)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # bucket x language: embedding times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Of each text, the average over its n-grams; each text has a blank before and after."""
        out = np.zeros((len(texts), len(self.langs)))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < 1 << 20):
                size += len(texts[end]) + 5
                end += 1
            some = texts[at:end]
            data = np.frombuffer(b"".join(b" " + t + b"    " for t in some), np.uint8)
            begins = np.concatenate(([0], np.cumsum([len(t) + 5 for t in some])[:-1]))
            for n in SIZES:
                index = grams(data, n)
                ends = begins + np.array([len(t) + 3 - n for t in some])  # up to the blank after the text
                for j in range(len(self.langs)):
                    sums = np.concatenate(([0.0], np.cumsum(self.table[:, j][index], dtype=np.float64)))
                    out[at:end, j] += sums[ends] - sums[begins]
            out[at:end] /= np.maximum(1, [sum(len(t) + 3 - n for n in SIZES) for t in some])[:, None]
            at = end
        return out + self.bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


Bag = tuple[np.ndarray, np.ndarray]  # buckets, each once, and the share of a text's n-grams that each has


def bag_of(text: str) -> Bag | None:
    """The whole text as a bag, with a blank before and after; none if it has no letter."""
    data = plain(text)
    if not has_letter(text, data):
        return None
    data = np.frombuffer(b" " + data + b" ", np.uint8)
    counts = sum(np.bincount(grams(data, n), minlength=BUCKETS) for n in SIZES)
    buckets = np.flatnonzero(counts)
    return buckets.astype(np.uint16), (counts[buckets] / counts.sum()).astype(np.float32)


def averaged(table: np.ndarray, bags: list[Bag]) -> np.ndarray:
    """Of each bag, the average of the rows that it holds."""
    return np.stack([share @ table[buckets] for buckets, share in bags]) if bags else np.zeros((0, table.shape[1]))


def train(bags: list[Bag | None], labels: list[str], epochs: int = 8, rate: float = 0.5, rows: int = 16, seed: int = 7) -> Model:
    """Fit on four fifths of the texts, calibrate on the rest."""
    langs = sorted(set(labels))
    number = {x: i for i, x in enumerate(langs)}
    rng = np.random.default_rng(seed)
    examples, held = [], []
    for i, (bag, lang) in enumerate(zip(bags, labels)):
        if bag is not None:
            (held if i % 5 == 4 else examples).append((bag, number[lang]))
    examples = examples or held
    embed = rng.normal(0, 0.1, (BUCKETS, DIM))
    weights, bias = rng.normal(0, 0.1, (DIM, len(langs))), np.zeros(len(langs))
    steps = epochs * -(-len(examples) // rows)
    done = 0
    for _ in range(epochs):
        order = rng.permutation(len(examples))
        for at in range(0, len(order), rows):
            some = [examples[i] for i in order[at : at + rows]]
            lr = rate * (1 - done / max(1, steps))
            done += 1
            hidden = averaged(embed, [bag for bag, _ in some])
            z = hidden @ weights + bias
            p = softmax(z)
            p[np.arange(len(some)), [y for _, y in some]] -= 1
            back = p @ weights.T * (lr * 20)
            weights -= lr * hidden.T @ p
            bias -= lr * p.sum(axis=0) / len(some)
            for ((buckets, share), _), step in zip(some, back):
                embed[buckets] -= share[:, None] * step
    model = Model(langs, (embed @ weights).astype(np.float32), bias)
    return calibrated(model, held)


def calibrated(model: Model, held: list[tuple[Bag, int]], lost: float = 0.002, most: float = 0.6) -> Model:
    """The temperature of least log loss on held-out texts; the threshold that rejects few of the right ones."""
    if not held or len(model.langs) < 2:
        return model
    z = averaged(model.table, [bag for bag, _ in held]) + model.bias
    y = np.array([i for _, i in held])

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    scores = softmax(z / model.temperature)
    right = scores.max(axis=1)[scores.argmax(axis=1) == y]
    model.threshold = float(min(most, np.quantile(right, lost))) if len(right) else 0.0
    return model


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """Train on documents whose crc32(doc_id) modulo 3 is not 1 and that have text and lang."""
    known = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null").where(crc_mod(F.col("doc_id"), 3) != 1)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    counts = known.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return None
    # twice the share that is wanted passes the filter, so that few rows are sorted for the limit
    wanted = F.lit(False)
    for row in counts:
        wanted = wanted | ((F.col("lang") == row["lang"]) & (place < int(min(1.0, 2 * per_lang / row["count"] + 1e-3) * (1 << 30))))
    first = Window.partitionBy("lang").orderBy(place, "doc_id")
    some = known.where(wanted).withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= per_lang)
    rows = some.select("lang", "turn", "text").mapInArrow(_sampled, "lang string, turn int, buckets binary, shares binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["turn"]))
    bags = [None if r["buckets"] is None else (np.frombuffer(r["buckets"], np.uint16), np.frombuffer(r["shares"], np.float32)) for r in rows]
    return train(bags, [r["lang"] for r in rows])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bags = [bag_of(t) for t in b.column(2).to_pylist()]
        packed = [pa.array([None if bag is None else bag[i].tobytes() for bag in bags], pa.binary()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *packed], names=["lang", "turn", "buckets", "shares"])


def predict(docs: DataFrame, model: Model | None, name: str = "_lang") -> DataFrame:
    """The rows of ``docs``, with a struct ``name``: pred, score, accepted."""
    small_batches(docs.sparkSession)
    kind = StructType().add("pred", "string").add("score", "double").add("accepted", "boolean")
    schema = StructType(list(docs.schema.fields)).add(name, kind)
    at = docs.columns.index("text")
    fields = pa.struct([("pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model  # travels with the plan; its size depends on buckets and languages only
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            data = [plain(t) for t in texts]
            real = np.array([has_letter(t, d) for t, d in zip(texts, data)], bool) & (m is not None)
            pred, best = [NONE] * len(texts), np.zeros(len(texts))
            rows = np.flatnonzero(real)
            if len(rows):
                s = m.scores([data[i] for i in rows])
                for i, j in zip(rows, s.argmax(axis=1)):
                    pred[i] = m.langs[j]
                best[rows] = s.max(axis=1)
            good = real & (best >= (m.threshold if m else 0))
            extra = pa.StructArray.from_arrays([pa.array(pred), pa.array(best), pa.array(good)], fields=list(fields))
            yield pa.RecordBatch.from_arrays([*b.columns, extra], names=[*b.schema.names, name])

    return docs.mapInArrow(lean_batches(score), schema)


def identify(docs: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every document."""
    model = fit(docs, **how)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select(
        "doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("_lang.pred").alias("lang_pred"),
        F.col("_lang.score").alias("score"), F.col("_lang.accepted").alias("accepted"),
    )
