"""Language identification with a string kernel: presence of n-grams, Nyström landmarks, kernel ridge regression.

The kernel of two texts is the number of character n-grams (a blend of lengths 1 to 3, hashed to
``BUCKETS``) that both hold, over the geometric mean of the numbers that each holds. A bounded sample of
labelled rows is drawn per language; some of it serve as landmarks. Kernel values against the landmarks,
whitened by their own kernel matrix (Nyström), are the inputs of one ridge regression per language
against the rest. A text's scores are one matrix product per batch of texts; no label is read there.

Bounds: every language is learned, from ``PER_LANGUAGE`` sampled rows, or fewer once all of them would be over
``SAMPLED`` (but ``FEWEST`` at least), each sent to the driver as BUCKETS / 8 bytes; ``LANDMARKS`` landmarks; the model
that tasks get has LANDMARKS x BUCKETS bits. Whole texts are read, in training as in prediction.

Defined results: null text, and text without a letter, is ``und`` with score 0; so is everything if no
labelled row has a letter; ties go to the language that sorts first; rows without a language, or with a
null id, are never learned from; texts of any length are read whole; of rows equal in id, language and text one is
learned from; repeated rows and extra columns, whatever their names, pass through; an empty table gives an empty result.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import free_names, give_back, materialise

BUCKETS = 1 << 14
LENGTHS = (1, 2, 3)
PER_LANGUAGE, SAMPLED, FEWEST = 400, 25_600, 4
LANDMARKS = 128
RIDGE = 1e-2
UNDETERMINED = "und"
_AT_ONCE = 128
_PIECE = 1 << 20


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def presence(text: str) -> np.ndarray | None:
    """Which n-gram buckets a text fills, as a boolean vector; None without a letter.

    Letters are lower-cased; each run of anything else counts as one blank, so marks and digits carry
    no weight. Long texts are read in pieces that overlap by the longest n-gram.
    """
    letter, found, any_letter = _letters(), np.zeros(BUCKETS, bool), False
    for at in range(0, max(len(text), 1), _PIECE):
        piece = text[max(0, at - max(LENGTHS)) : at + _PIECE].lower()
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        own = letter[codes]
        if not own.any():
            continue
        any_letter = True
        codes = np.where(own, codes, 32)
        keep = own.copy()
        keep[0] |= at > 0
        keep[1:] |= own[:-1]
        codes = codes[keep]
        ends = ([32] if at == 0 else []), ([32] if at + _PIECE >= len(text) and codes[-1] != 32 else [])
        codes = np.concatenate([ends[0], codes, ends[1]]).astype(np.uint32)
        gram = np.zeros(len(codes), np.uint32)
        for n in range(1, max(LENGTHS) + 1):
            if n > len(codes):
                break
            gram = gram[: len(codes) - n + 1] * np.uint32(0x9E3779B1) + codes[n - 1 :] + np.uint32(n)
            if n in LENGTHS:
                mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                found[mixed >> np.uint32(32 - 14)] = True
    return found if any_letter else None


@dataclass
class Model:
    """Landmarks as packed bits, their sizes, and a weight for each landmark and language."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def score(self, present: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Scores of the rows of a 0/1 matrix: kernel values against all landmarks times the weights."""
        return kernel(present, marks) @ self.weights


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Kernel values of all rows of two 0/1 float matrices."""
    sizes = np.sqrt(a.sum(1)[:, None] * b.sum(1)[None, :])
    return (a @ b.T) / np.maximum(sizes, 1)


def _unpacked(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits, axis=1).astype(np.float32)


def fit(rows: list[tuple[str, int, bytes]]) -> Model | None:
    """A model of (language, hash, packed presence) rows; None without any."""
    languages = sorted({lang for lang, _, _ in rows})
    if not languages:
        return None
    bits = np.array([np.frombuffer(b, np.uint8) for _, _, b in rows])
    target = np.array([[1.0 if lang == own else -1.0 for own in languages] for lang, _, _ in rows])
    by_lang = [[i for i, (lang, _, _) in enumerate(rows) if lang == own] for own in languages]
    turns = sorted((k, g) for g, own in enumerate(by_lang) for k in range(len(own)))
    chosen = [by_lang[g][k] for k, g in turns][:LANDMARKS]
    marks = _unpacked(bits[chosen])
    value, vector = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    good = value > 1e-6 * value.max()
    whiten = vector[:, good] / np.sqrt(value[good])
    features = np.concatenate([kernel(_unpacked(bits[i : i + _AT_ONCE]), marks) for i in range(0, len(bits), _AT_ONCE)]) @ whiten
    share = np.maximum((target > 0).sum(0), 1)
    weight = np.where(target > 0, len(rows) / (2 * share), len(rows) / (2 * np.maximum(len(rows) - share, 1)))
    solved = []
    for c in range(len(languages)):  # rows of a rare language weigh as much as all others together
        weighted = features * weight[:, c, None]
        solved.append(np.linalg.solve(features.T @ weighted + RIDGE * len(rows) * np.eye(features.shape[1]), weighted.T @ target[:, c]))
    return Model(languages, bits[chosen], (whiten @ np.array(solved).T).astype(np.float32))


def _packed_column(text: Column) -> Column:
    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        found = (presence(t.as_py()) for t in texts)
        return pa.array([None if p is None else np.packbits(p).tobytes() for p in found], pa.binary())

    return packed(F.coalesce(text, F.lit("")))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """Learn from the labelled rows of ``df``, a sample drawn by the hash of the id.

    A language's rows with the least hashes are drawn. The number of its distinct rows, estimated, says below
    which hash about four times as many lie, so ranks are taken over a bounded number of rows however frequent
    it is; the texts of the rows drawn are then read by a join with that bounded list.
    """
    labelled = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("id is not null and lang is not null")
    labelled = labelled.withColumn("place", F.xxhash64("id", "text").bitwiseAND(F.lit((1 << 52) - 1)))
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("place").alias("count"))
    quota = max(FEWEST, min(per_language, SAMPLED // max(1, counts.count())))
    near = F.col("place") < F.lit(4.0 * quota * (1 << 52)) / F.col("count")  # four times what is drawn, about
    keys = labelled.select("lang", "place").join(counts, "lang").filter(near).select("lang", "place").distinct()
    by_hash = Window.partitionBy("lang").orderBy("place")
    drawn = materialise(keys.withColumn("rank", F.row_number().over(by_hash)).filter(F.col("rank") <= quota).select("lang", "place"), "drawn-rows")
    rows = labelled.join(F.broadcast(drawn), ["lang", "place"]).select("lang", "place", _packed_column(F.col("text")).alias("bits")).filter("bits is not null")
    once = rows.groupBy("lang", "place").agg(F.first("bits").alias("bits"))
    return fit(sorted((r.lang, r.place, bytes(r.bits)) for r in once.toLocalIterator()))


def predictor(model: Model | None) -> Callable[[Column], Column]:
    """A function from a text column to struct<lang_pred, score>."""

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        marks = _unpacked(model.landmarks) if model else None
        buffer = np.zeros((_AT_ONCE, BUCKETS), np.float32)
        try:
            for texts in batches:
                lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                where: list[int] = []

                def flush(where: list[int] = where, lang: list[str] = lang, score: np.ndarray = score) -> None:
                    if where:
                        out = model.score(buffer[: len(where)], marks)
                        best = out.argmax(1)
                        for k, i in enumerate(where):
                            lang[i], score[i] = model.languages[best[k]], min(1.0, max(0.0, (float(out[k, best[k]]) + 1) / 2))
                        where.clear()

                for i, t in enumerate(texts):
                    if model and (p := presence(t.as_py())) is not None:
                        buffer[len(where)] = p
                        where.append(i)
                        if len(where) == _AT_ONCE:
                            flush()
                flush()
                yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang_pred", "score"])
        finally:
            buffer = marks = None
            give_back()

    return lambda text: predict(F.coalesce(text, F.lit("")))


def identify(df: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", out: str = "language") -> DataFrame:
    """``df`` with a column ``out``, struct<lang_pred, score>, learned from ``training``."""
    return df.withColumn(out, predictor(train(training, id_col, text_col, lang_col))(F.col(text_col)))


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` whose language can be told, by a model of ``df``'s own labelled rows."""
    (name,) = free_names(df, "language")
    found = identify(df, df, id_col, text_col, lang_col, name)
    return found.filter(F.col(f"{name}.lang_pred") != UNDETERMINED).select(*df.columns)
