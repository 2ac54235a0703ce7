"""Language of documents in which languages mix: every word is labelled by a conditional random field over the whole text."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import columns_of, filtered, text_pieces, written
from .crf import Model, fit, posteriors

#: What a text without letters, or one that no model was learned for, is labelled.
UNKNOWN = "und"
#: Labelled documents per language that the model is fitted on, and the longest text taken, in characters.
SAMPLE_DOCS = 250
SAMPLE_CHARS = 20_000
#: Distinct words whose weights a worker remembers before it starts afresh.
REMEMBERED = 150_000
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters of the whole text."""
    return _WORDS.findall(text.lower()) if text else []


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = SAMPLE_DOCS, max_chars: int = SAMPLE_CHARS,
) -> Model:
    """A model fitted on at most ``per_language`` labelled documents of each language, chosen by a hash of their id.

    The sample is bounded: languages x ``per_language`` x ``max_chars``
    characters reach the driver. Rows without text or label are not learned
    from; without any labelled row the model has no labels.
    """
    usable = columns_of(docs, [id_col, text_col, lang_col]).where(
        F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) <= max_chars)
    )
    by_hash = [F.xxhash64(id_col), F.col(id_col)]
    by_lang = Window.partitionBy(lang_col)
    chosen = usable.select(id_col, lang_col).withColumn("_place", F.row_number().over(by_lang.orderBy(*by_hash)))
    chosen = chosen.where(F.col("_place") <= per_language).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang")).distinct()
    chosen = written(chosen, "training-ids")  # small, and its size known, so the texts need no shuffle
    rows = usable.join(chosen, (F.col(id_col) == F.col("_id")) & (F.col(lang_col) == F.col("_lang")), "left_semi")
    # once more, as rows may share an id
    rows = rows.withColumn("_place", F.row_number().over(by_lang.orderBy(*by_hash, text_col)))
    rows = rows.where(F.col("_place") <= per_language).orderBy(lang_col, "_place").collect()
    names = sorted({r[lang_col] for r in rows})
    return fit([words_of(r[text_col]) for r in rows], [names.index(r[lang_col]) for r in rows], names)


class _Labeller:
    def __init__(self, model: Model):
        self.model = model
        self._known: dict[str, int] = {}
        self._weights = np.zeros((0, len(model.labels)), np.float32)

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Words per text and the share of each label among them, by posterior probability."""
        words = [words_of(t) for t in texts]
        begins = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
        sums = np.zeros((len(texts), len(self.model.labels)))
        if begins[-1] and self.model.labels:
            if len(self._known) > REMEMBERED:
                self._known.clear()
                self._weights = self._weights[:0]
            known = self._known
            new = list({w for own in words for w in own}.difference(known))
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self._weights = np.concatenate([self._weights, self.model.emissions(new)])
            ids = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, int(begins[-1]))
            found, _ = posteriors(self._weights[ids], begins, self.model.transition)
            has = np.flatnonzero(np.diff(begins))
            sums[has] = np.add.reduceat(found, begins[has], axis=0, dtype=np.float64)
        return np.diff(begins), sums / np.maximum(sums.sum(1, keepdims=True), 1e-30)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score: the language of most words, by posterior probability, and its share.

    Texts that are null or have no letter get ``und`` and 0.0, as do all texts
    if the model has no labels. Ties go to the first label in order. Result
    columns replace columns of the same name; all others stay.
    """
    docs = docs.drop("lang_pred", "score")
    columns_of(docs, [text_col])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _Labeller(shared.value)
        names = [*shared.value.labels, UNKNOWN]
        for piece, texts in text_pieces(batches, text_col):
            counts, shares = labeller.shares(texts)
            best = shares.argmax(1) if len(names) > 1 else np.zeros(len(texts), np.int64)
            score = shares.max(1, initial=0.0)
            best[(counts == 0) | (score == 0)] = len(names) - 1
            pred = pa.array([names[i] for i in best], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, pred, pa.array(np.clip(score, 0, 1), pa.float64())], names=[*piece.schema.names, "lang_pred", "score"]
            )

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.4, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a language whose share is at least ``min_score``, all columns as they were."""
    found = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)
    return filtered(docs, lambda d: identify(d, model, text_col), ["lang_pred", "score"], found)
