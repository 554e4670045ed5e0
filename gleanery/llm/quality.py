"""Quality by co-training: a classifier of the text and one of the page's metadata teach each other.

The text view reads nothing but the text (hashed byte trigrams, and its shape: shares of capitals,
signs and blanks, lines and their lengths), the metadata view nothing but the columns beside it
(source, language, both together, the recorded length). Both are naive Bayes models, so a model is a table of integer
sums, which do not depend on the order of rows. In each round every document outside the labelled
sample is scored by both views; where one is confident, the document counts for the other one's
sums. Views are calibrated on labelled rows of their own, and a calibrated combination scores all documents.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import dropped, written

#: Buckets of trigrams, kinds and levels of the text's shape, buckets of the metadata view.
TRIGRAMS, KINDS, LEVELS, META = 1 << 14, 6, 48, 1 << 10
TEXT = TRIGRAMS + KINDS * LEVELS
ROUNDS, CONFIDENT = 2, 0.95
#: Bounds on the labelled rows that train and that calibrate. All others count like those without a label.
TRAIN_ROWS, CALIBRATION_ROWS = 50_000, 20_000
#: Sums are kept in whole units: a labelled document counts for two shares of this size, one with a pseudo-label for one.
UNIT = 1 << 20
LABELLED, PSEUDO = 2, 1

_FACTOR = np.uint32(2_654_435_761)
_UPPER, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _BLANK[32] = True, True
_SIGN = np.zeros(256, bool)
_SIGN[33:48], _SIGN[58:65] = True, True


def text_view(text: str | None) -> np.ndarray:
    """Shares of a text's byte trigrams by bucket, then for each kind of shape the share 1 at its level."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(TEXT)
    if len(b) >= 3:
        x = b.astype(np.uint32)
        code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
        out[:TRIGRAMS] = np.bincount((code * _FACTOR) >> np.uint32(18), minlength=TRIGRAMS) / len(code)
    n, lines = max(len(b), 1), 1 + int((b == 10).sum())
    shares = [round(20 * float(of[b].sum()) / n) for of in (_UPPER, _SIGN, _BLANK)]
    sizes = [int(2 * np.log2(1 + v)) for v in (len(b), lines, len(b) / lines)]
    for kind, level in enumerate((*shares, *sizes)):
        out[TRIGRAMS + kind * LEVELS + min(level, LEVELS - 1)] = 1
    return out


def meta_view(columns: Sequence[str], length_col: str | None) -> Column:
    """The buckets of a document's metadata: each column, all of them together, and the recorded length's order of magnitude."""
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in columns]
    made = [F.concat(F.lit(f"{i}="), v) for i, v in enumerate(said)] + [F.concat_ws("\x01", F.lit("all"), *said)]
    if length_col:
        made.append(F.concat(F.lit("length="), F.coalesce(F.floor(2 * F.log2(F.lit(1) + F.abs(F.col(f"`{length_col}`").cast("double")))).cast("string"), F.lit("?"))))
    return F.array(*[F.pmod(F.xxhash64(m), F.lit(META)).cast("int") for m in made]).alias("meta")


@dataclass(frozen=True)
class Model:
    """Sums by class of both views, the documents behind each (in shares), and the calibrations:
    bias and slopes of the text view, the metadata view and both."""

    text: np.ndarray
    meta: np.ndarray
    docs: np.ndarray
    fits: tuple = ((0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (0.0, 1.0, 1.0))

    def ratios(self) -> tuple[np.ndarray, np.ndarray]:
        grams, shape = self.text[:, :TRIGRAMS] / UNIT, self.text[:, TRIGRAMS:] / UNIT
        total = grams.sum(axis=1, keepdims=True)
        g = (grams + 1e-6 * total + 1e-9) / (total + 1e-9)
        s = (shape + 0.5) / (shape.sum(axis=1, keepdims=True) / KINDS + 1)
        m = (self.meta + 0.5) / (self.docs[:, None] + 1)
        # the kinds of shape weigh together as much as all trigrams
        return np.concatenate([np.log(g[1] / g[0]), np.log(s[1] / s[0]) / KINDS]), np.log(m[1] / m[0])


def raw(ratios: tuple[np.ndarray, np.ndarray], text: np.ndarray, meta: list[int]) -> tuple[float, float]:
    return float(text @ ratios[0]), float(ratios[1][meta].mean())


def chance(fit: tuple, a, b):
    return 1 / (1 + np.exp(-np.clip(fit[0] + fit[1] * a + fit[2] * b, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    scale = x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), x / scale])
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w)), z.T @ (y - p) - 0.1 * w)
    return np.concatenate([w[:1], w[1:] / scale])


_SUMS = T.StructType([T.StructField("slot", T.LongType()), T.StructField("v", T.LongType())])
#: Places of the sums in one row space: text of class 0, of class 1, metadata likewise, documents.
_PLACES = (0, TEXT, 2 * TEXT, 2 * TEXT + META, 2 * TEXT + 2 * META, 2 * TEXT + 2 * META + 2)


def _summed(rows: DataFrame, model: Model | None) -> np.ndarray:
    """Sums over ``rows`` (text, meta, y): by the label ``y``, or with a model by what the other view is sure of."""
    ratios = model.ratios() if model else None
    fits = model.fits if model else None

    def summed(batches):
        at = np.zeros(_PLACES[-1], np.int64)
        for b in batches:
            for t, m, y in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                x = text_view(t.as_py())
                for_text, for_meta, weight = y, y, LABELLED
                if ratios is not None:
                    a, c = raw(ratios, x, m)
                    by_text, by_meta = chance(fits[0], a, c), chance(fits[1], a, c)
                    sure = lambda p: 1 if p >= CONFIDENT else 0 if p <= 1 - CONFIDENT else None
                    for_text, for_meta, weight = sure(by_meta), sure(by_text), PSEUDO
                if for_text is not None:
                    at[for_text * TEXT : (for_text + 1) * TEXT] += weight * np.rint(x * UNIT).astype(np.int64)
                if for_meta is not None:
                    np.add.at(at, [_PLACES[2 + for_meta] + i for i in m], weight)
                    at[_PLACES[4] + for_meta] += weight
        slots = np.flatnonzero(at)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(at[slots])], names=_SUMS.names)

    at = np.zeros(_PLACES[-1], np.int64)
    # one number for each slot, whatever the input: about 35 000
    for slot, v in rows.select("text", "meta", "y").mapInArrow(summed, _SUMS).groupBy("slot").agg(F.sum("v")).collect():
        at[slot] = v
    return at


def _model(at: np.ndarray, fits: tuple = Model.fits) -> Model:
    cut = [at[a:b].astype(float) for a, b in zip(_PLACES, _PLACES[1:])]
    return Model(np.stack(cut[:2]), np.stack(cut[2:4]), cut[4], fits)


def _scored(rows: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """``names`` of ``rows`` with the raw scores ``a`` and ``b`` of both views."""
    ratios = model.ratios()
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())])

    def scored(batches):
        for x in batches:
            got = [raw(ratios, text_view(t.as_py()), m) for t, m in zip(x.column(0), x.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*x.columns[2:], pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64())], names=schema.names)

    return rows.select("text", "meta", *names).mapInArrow(scored, schema)


def _fold(ident: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(ident.cast("string"), "UTF-8")), F.lit(5)), F.lit(0))


def co_train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    rounds: int = ROUNDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    meta_cols: Sequence[str] = ("source", "lang"),
    length_col: str | None = "n_chars",
    label_col: str = "quality",
    train_rows: int = TRAIN_ROWS,
    calibration_rows: int = CALIBRATION_ROWS,
) -> DataFrame:
    """``id_col``, ``held_out``, ``content_score``, ``metadata_score``, ``score`` (each 0 to 1, higher: better), ``predicted``.

    Rows whose crc32 of the id as text leaves 0 modulo 5 are held out: their labels are never read.
    Those that leave 1 calibrate, the others train; of each, the ids with the least hashes up to the bounds. All
    remaining documents take part in the rounds without a label and all are scored, over whole texts
    of any length. Labels of one id are one, the smaller; null labels count for none. Rows that
    repeat an id train or calibrate once (the row whose text has the least hash), and each is scored
    by itself. A null in a metadata column is a category of its own; null and empty texts have no
    trigrams. Without labels of both classes the scores stay as the sums have them, 0.5 without any. Columns
    that are not named do not matter, whatever their names. An empty table gives none.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), meta_view(meta_cols, length_col))
    marks = labels.where(F.col(f"`{label_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.min(F.col(f"`{label_col}`")).cast("int").alias("y"))
    marks = marks.where("id is not null").withColumn("fold", _fold(F.col("id")))
    parts = [(marks.where("fold > 1"), train_rows), (marks.where("fold = 1"), calibration_rows)]
    picked = written(parts[0][0].orderBy(F.xxhash64("id"), "id").limit(parts[0][1]).unionByName(parts[1][0].orderBy(F.xxhash64("id"), "id").limit(parts[1][1])), "picked")
    # both bounds together prove the size of this broadcast
    with_label = rows.join(F.broadcast(picked), "id")
    one = with_label.groupBy("id").agg(F.first("y").alias("y"), F.first("fold").alias("fold"), F.min(F.struct(F.xxhash64("text").alias("h"), "text", "meta")).alias("r"))
    sample = written(one.select("id", "y", "fold", "r.text", "r.meta"), "sample")
    rest = rows.join(F.broadcast(picked.select("id")), "id", "left_anti").withColumn("y", F.lit(None).cast("int"))

    def calibrated(model: Model) -> Model:
        got = np.array([tuple(r) for r in _scored(sample.where("fold = 1"), model, ["id", "y"]).orderBy("id").drop("id").collect()], dtype=float).reshape(-1, 3)
        y, x = got[:, 0], got[:, 1:]
        if len(set(y.tolist())) < 2:
            return model
        a, b, both = _logistic(x[:, :1], y), _logistic(x[:, 1:], y), _logistic(x, y)
        return replace(model, fits=((a[0], a[1], 0.0), (b[0], 0.0, b[1]), tuple(both)))

    known = _summed(sample.where("fold > 1"), None)
    model = calibrated(_model(known))
    for _ in range(rounds):
        model = calibrated(_model(known + _summed(rest, model), model.fits))
    dropped(sample)
    dropped(picked)
    fits = [[float(v) for v in f] for f in model.fits]
    p = [1 / (1 + F.exp(-(F.lit(f[0]) + f[1] * F.col("a") + f[2] * F.col("b")))) for f in fits]
    return _scored(rows, model, ["id"]).select(
        F.col("id").alias(id_col), (_fold(F.col("id")) == 0).alias("held_out"), p[0].alias("content_score"), p[1].alias("metadata_score"),
        p[2].alias("score"), (p[2] >= 0.5).cast("int").alias("predicted"),
    )
