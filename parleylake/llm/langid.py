"""Language identification with interpolated Kneser-Ney character models.

One model per language is trained on a bounded sample of labelled text, one piece of each language at least, stored in sorted hash
arrays (``ngram_lm``), and the language with the lowest cross-entropy per character wins. Texts
whose cross-entropy is above what ``reject_quantile`` of the calibration texts of that language
reach are marked ``rejected``; ``score`` is a posterior with a temperature fitted on the same texts.

Defined results: a null text, and one without a letter, is ``und`` with score 0; without any
learning row everything is ``und``; a tie goes to the first language by code point. Rows are
independent: repeated rows get equal answers, further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngram_lm
from .common import each_slice, map_arrow, ship
from .hashing import buffers

UNDETERMINED = "und"
ORDER = 4
#: Bound of the learning sample: characters a language, and those of the pieces that texts are cut into for it. A hash of id, text and
#: place chooses the pieces.
SAMPLE_CHARS, PIECE = 1_000_000, 8_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters of all texts with one border for each run of anything else; first and past-last place of each text.

    Every text begins and ends with a border.
    """
    lowered = pc.utf8_lower(pc.fill_null(column, ""))
    raw, _ = buffers(lowered)
    lengths = pc.utf8_length(lowered).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    spaced = np.full(len(points) + 2 * len(lengths), ngram_lm.BORDER, np.uint32)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    spaced[np.arange(len(points)) + 2 * doc + 1] = points
    letter = _letters()[spaced]
    spaced[~letter] = ngram_lm.BORDER
    first, last = starts + 2 * np.arange(len(lengths)), ends + 2 * np.arange(len(lengths)) + 2
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[first] = True
    keep[first + 1] &= letter[first + 1]
    place = np.concatenate([[0], np.cumsum(keep)])
    return spaced[keep], place[first], place[last]


@dataclass
class LanguageModel:
    languages: list[str]
    model: ngram_lm.Model | None
    temperature: float
    limits: np.ndarray

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character under each language; number of letters and borders scored (0: no letter)."""
        text, first, last = codes(column)
        length = last - first - 1  # the leading border is context only
        values = ngram_lm.score(self.model, text)
        total = ngram_lm.sums(values, np.minimum(first + 1, last), last)
        return -total / np.maximum(length, 1)[:, None], np.maximum(length, 0)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, posterior, whether rejected, cross-entropy of the winner."""
        if self.model is None:
            nothing = np.zeros(len(column))
            return [UNDETERMINED] * len(column), nothing, nothing.astype(bool), nothing
        entropy, length = self.entropies(column)
        best = np.argmin(entropy, axis=1)
        lowest = entropy[np.arange(len(best)), best]
        margin = (lowest[:, None] - entropy) * (self.temperature * np.sqrt(np.maximum(length, 1)))[:, None]
        posterior = 1.0 / np.exp(np.maximum(margin, -700)).sum(axis=1)
        some = length > 0
        names = [self.languages[b] if s else UNDETERMINED for b, s in zip(best.tolist(), some.tolist(), strict=True)]
        return names, np.where(some, posterior, 0.0), some & (lowest > self.limits[best]), np.where(some, lowest, 0.0)


def learn(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", order: int = ORDER, sample_chars: int = SAMPLE_CHARS, reject_quantile: float = 0.995) -> LanguageModel:
    """Fit on rows with a text and a language; of each language at most ``sample_chars`` characters are read, in pieces of PIECE.

    Equal pieces count once. Which pieces are learned from depends on the rows alone, not on their order.
    """
    rows = rows.where((F.length(text) > 0) & F.col(lang).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    rows = rows.withColumn("h", F.xxhash64("k", "t"))
    draw = F.pmod(F.xxhash64("h", "at"), F.lit(1 << 53)) / float(1 << 53)
    piece = F.substr("t", F.col("at") * PIECE + 1, F.lit(PIECE))
    first = F.struct(draw.alias("draw"), piece.alias("t"))
    sizes = rows.withColumn("at", F.lit(0)).groupBy("l").agg(F.sum(F.length("t")).alias("n"), F.min(first).alias("least")).collect()
    if not sizes:
        return LanguageModel([], None, 1.0, np.zeros(0))
    # somewhat more than the budget is drawn, and cut to it here
    rate = F.coalesce(*(F.when(F.col("l") == r["l"], min(1.0, 1.2 * sample_chars / r["n"])) for r in sizes))
    pieces = rows.withColumn("at", F.explode(F.sequence(F.lit(0), ((F.length("t") - 1) / PIECE).cast("int"))))
    drawn = pieces.withColumn("draw", draw).where(F.col("draw") < rate).select("l", "draw", piece.alias("t")).groupBy("l", "t").agg(F.min("draw").alias("draw"))
    sample: dict[str, list[tuple[float, str]]] = {r["l"]: [(r["least"]["draw"], r["least"]["t"])] for r in sizes}
    for r in drawn.collect():
        sample[r["l"]].append((r["draw"], r["t"]))
    languages = sorted(sample)
    train, check = [], []
    for name in languages:
        kept, held = [], 0
        for _, own in sorted(set(sample[name])):
            if held >= sample_chars:
                break
            kept.append(own)
            held += len(own)
        texts = pa.array(kept, pa.string())
        text_codes, begin, end = codes(texts)
        each = [text_codes[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        fifth = len(each) // 5
        check.append(texts[len(each) - fifth :])
        train.append(each[: len(each) - fifth])
    model = LanguageModel(languages, ngram_lm.train(train, order, "kn"), 1.0, np.full(len(languages), np.inf))
    _calibrate(model, check, reject_quantile)
    return model


def _calibrate(model: LanguageModel, check: list[pa.Array], quantile: float) -> None:
    gaps, lengths, gold = [], [], []
    for c, texts in enumerate(check):
        if not len(texts):
            continue
        entropy, length = model.entropies(texts)
        own = entropy[length > 0, c]
        if len(own) >= 20:
            model.limits[c] = np.quantile(own, quantile) + own.std()
        gaps.append(entropy[length > 0])
        lengths.append(length[length > 0])
        gold.append(np.full(int((length > 0).sum()), c))
    if not gaps or len(model.languages) < 2:
        return
    entropy, length, gold = np.concatenate(gaps), np.concatenate(lengths), np.concatenate(gold)
    best, chosen = np.inf, 1.0
    for temperature in (0.05, 0.1, 0.2, 0.4, 0.8, 1.6, 3.2, 6.4):
        logits = -entropy * (temperature * np.sqrt(length))[:, None]
        logits -= logits.max(axis=1, keepdims=True)
        loss = float(np.mean(np.log(np.exp(logits).sum(axis=1)) - logits[np.arange(len(gold)), gold]))
        if loss < best - 1e-12:
            best, chosen = loss, temperature
    model.temperature = chosen


def identify(df: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with lang_pred, score, rejected and entropy (nats a character)."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, posterior, rejected, entropy = shared.value.predict(batch.column("__text"))
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(names, pa.string()), pa.array(posterior, pa.float64()), pa.array(rejected, pa.bool_()), pa.array(entropy, pa.float64())], names=[*keep, "lang_pred", "score", "rejected", "entropy"])

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep), "lang_pred string, score double, rejected boolean, entropy double"])
    return map_arrow(df.select(*keep, F.col(text).alias("__text")), each_slice(work, "__text"), schema)
