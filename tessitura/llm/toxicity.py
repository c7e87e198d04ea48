"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text.

All dictionaries come from zstandard's trainer. The ground is trained on ordinary texts, then on the words of
further ordinary texts that it leaves uncompressed. What the ground leaves of toxic texts trains a toxic
dictionary, what it leaves of ordinary ones an ordinary dictionary, in each of a few folds of the texts. Each window of
a text is compressed with either dictionary in front of the same ground, so what all texts share costs both the same
and the difference of the lengths says which kind the rest is nearer to; the mean over the folds evens out what a
dictionary matches by chance. A logistic model of a text's differences, fitted on labelled texts that trained
no dictionary, sets the thresholds and turns differences into a probability.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, checked_broadcast, numbered, without, worker_state, written
from .words import text_column

#: Labelled texts of each kind that are sampled at most (lowest hash of their id first), and bytes of a text that may train a dictionary.
TOXIC_SAMPLE, ORDINARY_SAMPLE, SAMPLE_BYTES = 2000, 6000, 1 << 14
#: One sampled text of so many sets the thresholds, whatever its length; the others train the dictionaries.
SET_ASIDE = 4
#: Folds of the texts that train class dictionaries; bytes of the ground's two parts, of a class dictionary, and of the trainer's segments in texts and in words.
FOLDS, GROUND, MORE, DICTIONARY, SEGMENT, WORD_SEGMENT = 3, 112 << 10, 32 << 10, 700, 64, 12
#: Bytes of a window, of a shortest match, of the shortest word that may be left, and of a piece of a longer one.
WINDOW, MATCH, SHORT, PIECE = 48, 5, 4, 24
#: Ridge of the logistic weights.
RIDGE = 0.1
#: What stands before and after each window, so that blocks always compress and matches can end at the window's end.
_BEFORE, _AFTER = b"\n" * 64, b"\n" * 16
#: Words whose savings are kept at a time.
_KNOWN = 200_000


def prepared(text: bytes) -> bytes:
    return b" " + text.lower()


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """Consecutive windows that cover a whole text, cut at a blank where one is near."""
    out, i = [], 0
    while i < len(text):
        j = i + size
        if j < len(text):
            k = text.find(b" ", j, j + 32)
            j = k if k > 0 else j
        out.append(text[i:j])
        i = j
    return out


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary of zstandard's trainer; of samples that are too few for it, their last bytes."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6, split_point=1.0, level=1).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    # the fast strategy leaves literals as they are, so lengths differ only by what the dictionary matches
    how = zstandard.ZstdCompressionParameters(
        window_log=19, chain_log=14, hash_log=18, search_log=4, min_match=MATCH, target_length=1, strategy=zstandard.STRATEGY_FAST, write_content_size=False, write_dict_id=False, write_checksum=False
    )
    data = zstandard.ZstdCompressionDict(content.rjust(64, b"\x01"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=data)


def _length(by: zstandard.ZstdCompressor, part: bytes) -> int:
    return len(by.compress(_BEFORE + part + _AFTER))


def leftovers(texts: Iterable[bytes], ground: bytes) -> list[bytes]:
    """Of each text the distinct words, in order, that the ground doesn't shorten; texts without any are left out."""
    plain, by = compressor(b""), compressor(ground)
    known: dict[bytes, bool] = {}
    out = []
    for text in texts:
        pieces = dict.fromkeys(w[k : k + PIECE] for w in text.split() for k in range(0, len(w), PIECE))
        if len(known) > _KNOWN:
            known.clear()
        for w in pieces:
            if w not in known:
                known[w] = len(w) >= SHORT and _length(plain, b" " + w + b" ") <= _length(by, b" " + w + b" ")
        left = [w for w in pieces if known[w]]
        if left:
            out.append(b" " + b" ".join(left) + b" ")
    return out


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[tuple[bytes, ...], tuple[bytes, ...], bytes]:
    """(toxic dictionaries, ordinary dictionaries, ground) of prepared texts; of the ordinary ones a third each trains the ground, its second part, and the dictionaries."""
    ground = trained(ordinary[::3], GROUND, SEGMENT)
    ground = trained(leftovers(ordinary[1::3], ground), MORE, WORD_SEGMENT) + ground
    left = [leftovers(texts, ground) or texts for texts in (toxic, ordinary[2::3])]
    own = [tuple(trained(texts[k::FOLDS], DICTIONARY, WORD_SEGMENT) for k in range(FOLDS)) for texts in left]
    return own[0], own[1], ground


@dataclass(frozen=True)
class Model:
    toxic: tuple[bytes, ...]
    ordinary: tuple[bytes, ...]
    ground: bytes
    weights: tuple[float, ...]

    def measure(self):
        """A function from a text to the features of its windows."""
        # of equal length, so that the ground is indexed at the same places behind both
        size = max(map(len, self.ordinary + self.toxic), default=0)
        by = [tuple(compressor(d.rjust(size, b"\x01") + self.ground) for d in pair) for pair in zip(self.ordinary, self.toxic, strict=True)]

        def of(text: bytes) -> np.ndarray:
            blocks = [_BEFORE + w + _AFTER for w in windows(prepared(text))]
            saved = [sum([len(o.compress(b)) - len(t.compress(b)) for o, t in by]) for b in blocks]
            return features(np.array(saved) / len(by))

        return of

    def scorer(self):
        """A function from a text to its probability."""
        of, weights = self.measure(), np.array(self.weights)
        return lambda text: float(1 / (1 + np.exp(-np.clip(of(text) @ weights, -30, 30))))


def features(gains: np.ndarray) -> np.ndarray:
    """Of the bytes that the toxic dictionary saves over the ordinary one in each window: the most, the sums, how many
    windows save enough, the number of windows, and the mean; what grows with a text's length on a log scale."""
    if not len(gains):
        gains = np.zeros(1)
    several = [np.log1p(np.count_nonzero(gains >= k)) for k in (2, 3)]
    return np.array([1.0, min(gains.max(), 12), np.log1p(gains[gains > 1].sum()), np.log1p(len(gains)), np.clip(gains.sum(), -20, 40) / 10, *several, np.clip(gains, -5, 5).mean()])


N_FEATURES = 8


def weigh(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Logistic weights; either kind counts as much as it has of all labels (share: of toxic ones), not as much as was sampled."""
    rate = float(np.clip(share, 1e-6, 1 - 1e-6))
    weights = np.zeros(N_FEATURES)
    weights[0] = np.log(rate / (1 - rate))
    if 0 < y.sum() < len(y):
        count = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean()))
        ridge = np.r_[0.0, np.full(N_FEATURES - 1, RIDGE)]

        def loss(w: np.ndarray) -> float:
            return float((count * np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w))).sum() + (ridge * w * w).sum() / 2)

        for _ in range(100):  # Newton steps, halved until they help
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            slope = x.T @ (count * (p - y)) + ridge * weights
            step = np.linalg.solve((x * (count * p * (1 - p))[:, None]).T @ x + np.diag(ridge) + 1e-9 * np.eye(N_FEATURES), slope)
            at, size = loss(weights), 1.0
            while size > 1e-6 and loss(weights - size * step) > at:
                size /= 2
            weights = weights - size * step
            if np.abs(size * step).max() < 1e-6:
                break
    return weights


def held_out(id_col: Column) -> Column:
    """Rows whose label must not be learnt."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from labelled rows that are not held out, at most TOXIC_SAMPLE toxic and ORDINARY_SAMPLE ordinary ones.

    One of SET_ASIDE, of any length, is measured by the executors and sets the thresholds; of the others those of at
    most SAMPLE_BYTES train the dictionaries on the driver. The rates of the kinds are those of all labelled documents
    that are not held out, at every size. With labels of one kind, or none, the score is the rate. Rows without an id or
    a label are not learnt from; of labels that repeat an id the larger counts, of texts the least.
    """
    bound_batches(docs.sparkSession)
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null")
    marked = marked.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    marked = written(marked.join(docs.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi"), "labelled")
    ordinary_rows, toxic_rows = marked.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
    share = toxic_rows / max(ordinary_rows + toxic_rows, 1)
    picked = []
    for kind, most in ((0, ORDINARY_SAMPLE), (1, TOXIC_SAMPLE)):
        some = marked.where(F.col("y") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
        picked += [(r["doc_id"], kind, k % SET_ASIDE == 0) for k, r in enumerate(some)]
    chosen = docs.sparkSession.createDataFrame(picked, f"doc_id {marked.schema['doc_id'].dataType.simpleString()}, y int, aside boolean")
    texts = docs.select(F.col(id_col).alias("doc_id"), text_column(F.col(text_col)).alias("text"))
    sample = written(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y", "aside").agg(F.min("text").alias("text")), "sample")

    rows = sample.where(~F.col("aside") & (F.octet_length("text") <= SAMPLE_BYTES)).select("doc_id", "y", "text").collect()
    rows.sort(key=lambda r: r["doc_id"])
    kinds = ([prepared(r["text"].encode()) for r in rows if r["y"] == y] for y in (1, 0))
    model = Model(*dictionaries(*kinds), (0.0,) * N_FEATURES)

    def run(batches):
        worker_state("toxicity")
        of = model.measure()
        for batch in batches:
            x = [of(t.as_buffer().to_pybytes()).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    measured = sample.where("aside").select("y", "text").mapInArrow(run, "y int, x array<double>").collect()
    x = np.array([r["x"] for r in measured]).reshape(-1, N_FEATURES)
    weights = weigh(x, np.array([r["y"] for r in measured], float), share)
    return Model(model.toxic, model.ordinary, model.ground, tuple(float(w) for w in weights))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, held_out, score, predicted.

    Scores come from the text alone. Null counts as empty; an empty text has no window and gets the
    score that the model gives to texts without signs. A null id is not held out. Rows that repeat
    an id get a row each. Other columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        worker_state("toxicity")
        of = model.scorer()
        for batch in batches:
            values = [of(t.as_buffer().to_pybytes()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(F.col(text_col)).alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def toxic_rows(rows: DataFrame, model: Model, row_col: str, text_col: str = "text") -> DataFrame:
    """Numbers (of the column that numbers the rows) of the rows whose text the model finds toxic."""
    return score(rows, model, row_col, text_col).where("predicted = 1").select(F.col("doc_id").alias(row_col))


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the model doesn't find toxic."""
    rows, at = numbered(docs, *docs.columns)
    return without(rows, checked_broadcast(written(toxic_rows(rows, model, at, text_col), "toxic")), at)
