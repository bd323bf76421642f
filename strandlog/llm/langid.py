"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import ship, slices, text_bytes

ORDERS = (2, 3, 4)
UNDETERMINED = "und"


def _fold() -> np.ndarray:
    """ASCII letters in lower case, other ASCII bytes a space, bytes of longer characters as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 32
    for b in range(ord("a"), ord("z") + 1):
        table[b] = table[b - 32] = b
    return table


_FOLD = _fold()


def subwords(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of each order, whether each counts, and the texts' starts in the padded bytes.

    Each text stands between a space and enough of them that no n-gram reaches into the next text; n-grams that begin
    with two spaces don't count.
    """
    n, room = len(offsets) - 1, max(ORDERS)
    padded = np.full(len(raw) + room * n + room, 32, np.uint8)
    start = offsets[:-1] + room * np.arange(n)
    place = np.arange(len(raw)) + np.repeat(room * np.arange(n) + 1, np.diff(offsets))
    padded[place] = _FOLD[raw]
    size = len(raw) + room * n
    b = padded.astype(np.uint32)
    gram = b[:-1] | (b[1:] << np.uint32(8))
    counts = gram[:size] != 0x2020
    shift = np.uint32(32 - (buckets - 1).bit_length())
    out = []
    for order in ORDERS:
        key = gram[:size] if order == 2 else gram[:size] | (b[2 : size + 2] << np.uint32(16)) if order == 3 else gram[:size] | (b[2 : size + 2] << np.uint32(16)) | (b[3 : size + 3] << np.uint32(24))
        out.append((key * np.uint32(0x9E3779B1)) >> shift)
    return out, counts, start


@dataclass
class LanguageModel:
    """scores[o, bucket, class] is the embedding of a bucket times the softmax weights; bias, temperature, and the least
    score that isn't rejected for texts of 2**k subword places and more."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    least: np.ndarray

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, probability and whether the model rejects it, of each text."""
        logits, places = self.logits(raw, offsets)
        best, score = _softmax(logits / self.temperature)
        return best, score, score < self.least[size_class(places, len(self.least))]

    def logits(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits before the temperature and the number of subword places of each text."""
        n = len(offsets) - 1
        if not n:
            return np.zeros((0, len(self.languages))), np.zeros(0, np.int64)
        grams, counts, start = subwords(raw, offsets, self.scores.shape[1])
        total = np.zeros((n, len(self.languages)))
        for o, g in enumerate(grams):
            own = self.scores[o][g]
            own[~counts] = 0
            total += np.add.reduceat(own, start, axis=0)
        places = np.add.reduceat(counts.astype(np.int64), start)
        return total / np.maximum(1, len(ORDERS) * places)[:, None] + self.bias, places


def size_class(places: np.ndarray, classes: int) -> np.ndarray:
    """The binary logarithm of the number of subword places, 0 to classes - 1."""
    return np.minimum(np.log2(np.maximum(places, 1)).astype(np.int64), classes - 1)


def _softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.exp(z - z.max(1, keepdims=True, initial=-np.inf))
    best = p.argmax(1)
    return best, p[np.arange(len(p)), best] / p.sum(1)


#: Sizes in bytes of the spans that whole texts are cut into for training, one after the other, and of those that calibrate.
_SPANS, _CUTS = (400, 60, 150, 24, 300), (12, 24, 48, 96, 192, 384, 768)
_SIZE_CLASSES = 14


def spans_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts every whole text into spans of _SPANS in turn: (offsets of the spans, the text of each)."""
    begin, text = [], []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        k = i
        while a < b:
            begin.append(a)
            text.append(i)
            a, k = a + _SPANS[k % len(_SPANS)], k + 1
    return np.append(begin, offsets[-1]).astype(np.int64), np.array(text, np.int64)


def sgd_step(embed: np.ndarray, weight: np.ndarray, bias: np.ndarray, flat: np.ndarray, size: np.ndarray, y: np.ndarray, rate: float, embed_rate: float) -> None:
    """One step of stochastic gradient descent on the mean log loss of a batch, in place.

    flat[order, place] are the embedding rows of the examples' subwords, one example after the other, of size places each.
    """
    orders = len(flat)
    first = np.cumsum(size) - size
    mean = sum(np.add.reduceat(embed[f], first, axis=0) for f in flat) / (orders * size)[:, None]
    z = mean @ weight + bias
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    back = (p @ weight.T) / (orders * size)[:, None]
    weight -= _clipped(rate * (mean.T @ p))
    bias -= _clipped(rate * p.sum(0))
    touched, place = np.unique(flat.ravel(), return_inverse=True)
    owner = np.tile(np.repeat(np.arange(len(y)), size), orders)
    change = np.stack([np.bincount(place.ravel(), back[owner, d], len(touched)) for d in range(embed.shape[1])], 1)
    embed[touched] -= _clipped(rate * embed_rate * len(y) * change).astype(embed.dtype)


def _clipped(step: np.ndarray, most: float = 1.0) -> np.ndarray:
    """Steps no longer than `most` a row, so that texts of few different subwords can't make the training diverge."""
    size = np.sqrt((step * step).sum(-1, keepdims=True))
    return step * (most / np.maximum(size, most))


def fit(texts: list[str], labels: list[str], *, buckets: int = 1 << 14, dim: int = 16, least_steps: int = 330, rate: float = 1.5, batch: int = 128, calibration: float = 0.2, rejected: float = 0.001, seed: int = 7) -> LanguageModel | None:
    """Trains on all of the given texts, cut into spans, by stochastic gradient descent; a share of the texts only calibrates.

    Every span is used once, and again in whole rounds while there are fewer than least_steps batches. The calibrating
    texts, whole and cut to several sizes, set the temperature (least log loss) and, for each class of sizes, the
    rejection score: the share `rejected` of them would be rejected, less a margin of two in the log odds.
    """
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    y_all = np.searchsorted(languages, labels)
    order = rng.permutation(len(texts))
    held, used = order[: int(calibration * len(texts))], order[int(calibration * len(texts)) :]
    raw, offsets = text_bytes(pa.array([texts[i] for i in used], pa.string()))
    edges, text = spans_of(offsets)
    y = y_all[used][text]
    embed = rng.normal(0, 1 / dim, (len(ORDERS) * buckets, dim)).astype(np.float32)
    weight, bias = rng.normal(0, 0.1, (dim, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    rounds = -(-len(y) // batch)
    epochs = max(1, -(-least_steps // rounds)) if rounds else 0
    done = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), rounds):
            size = edges[rows + 1] - edges[rows]  # subwords are cut a batch at a time
            at = np.append(0, np.cumsum(size))
            place = np.arange(at[-1]) + np.repeat(edges[rows] - at[:-1], size)
            grams, counts, start = subwords(raw[place], at, buckets)
            size = np.add.reduceat(counts.astype(np.int64), start)
            if (size > 0).any():
                flat = np.stack([g[counts].astype(np.int64) + o * buckets for o, g in enumerate(grams)])
                sgd_step(embed, weight, bias, flat, size[size > 0], y[rows][size > 0], rate * (1 - done / (epochs * rounds)), 1.5)
            done += 1
    model = LanguageModel(languages, (embed @ weight).reshape(len(ORDERS), buckets, -1), bias, 1.0, np.zeros(_SIZE_CLASSES))
    if len(held):
        _calibrate(model, [texts[i].encode() for i in held], y_all[held], rejected, rng)
    return model


def _calibrate(model: LanguageModel, texts: list[bytes], y: np.ndarray, rejected: float, rng: np.random.Generator) -> None:
    logits, places, truth = [], [], []
    for i, data in enumerate(texts):
        cuts = [(0, len(data)), *[(int(rng.integers(0, len(data) - size + 1)), size) for size in _CUTS if size < len(data)]]
        parts = [data[a : a + n] for a, n in cuts]
        z, n = model.logits(np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum([len(p) for p in parts])))
        logits.append(z)
        places.append(n)
        truth.append(np.full(len(z), y[i]))
    logits, places, truth = (np.concatenate(v) for v in (logits, places, truth))
    best = None
    for t in np.geomspace(0.05, 8, 24):
        c, s = _softmax(logits / t)
        loss = -np.log(np.clip(np.where(c == truth, s, (1 - s) / max(1, len(model.languages) - 1)), 1e-9, 1)).mean()
        if best is None or loss < best[0]:
            best = loss, t, s
    model.temperature = float(best[1])
    kind = size_class(places, len(model.least))
    for k in range(len(model.least)):
        own = best[2][kind == k]
        if len(own) >= 20:
            edge = np.clip(np.quantile(own, rejected), 1e-9, 1 - 1e-9)
            model.least[k] = edge / (edge + (1 - edge) * np.e**2)
        elif k and not (kind > k).any():  # larger than any seen
            model.least[k] = model.least[k - 1]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, may_learn: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500, most_bytes: int = 24 << 20, **options) -> LanguageModel | None:
    """Fits on the whole texts of at most per_language labelled rows of each language, and most_bytes of text in all (documented bounds).

    Rows are chosen by a hash of their id and text among those that may_learn allows and whose text has a letter; a row
    whose text would pass its language's share of most_bytes is passed over.
    """
    rows = docs.where(may_learn & F.col(lang_col).isNotNull() & has_letter(F.col(text_col)))
    draw = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    counts = rows.groupBy(F.col(lang_col).alias("l")).agg(F.count("*").alias("n")).collect()  # a row a language, as the model has
    if not counts:
        return None
    # half as many again as wanted by chance, of which the first by the draw are taken; rows that repeat count once
    share = F.create_map(*[x for r in counts for x in (F.lit(r.l), F.lit(int(min(1.0, 1.5 * per_language / r.n) * (1 << 30))))])
    likely = rows.where(F.pmod(draw, F.lit(1 << 30)) < share[F.col(lang_col)]).groupBy(F.col(lang_col).alias("lang"), draw.alias("draw")).agg(F.min(F.octet_length(text_col)).alias("size"))
    offered, taken = [], {}
    for r in sorted(likely.collect(), key=lambda r: (r.lang, r.draw % (1 << 30), r.draw)):
        taken[r.lang] = taken.get(r.lang, 0) + 1
        if taken[r.lang] <= per_language:
            offered.append(r)
    room = dict.fromkeys({r.lang for r in offered}, most_bytes // max(1, len({r.lang for r in offered})))
    chosen = set()
    for r in offered:
        if r["size"] <= room[r.lang]:
            room[r.lang] -= r["size"]
            chosen.add((r.lang, r.draw))
    if not chosen:
        return None
    wanted = docs.sparkSession.createDataFrame(sorted(chosen), "l string, d long")
    found = rows.join(F.broadcast(wanted), (F.col(lang_col) == F.col("l")) & (draw == F.col("d"))).select("l", "d", F.col(text_col).alias("text")).groupBy("l", "d").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: (r.l, r.d))
    return fit([r.text for r in found], [r.l for r in found], **options)


def identify(docs: DataFrame, model: LanguageModel | None, *, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "lang_score", rejected_out: str = "lang_rejected") -> DataFrame:
    """Appends the language of each whole text, its probability and whether the model rejects it: as less sure than nearly all known texts of its size.

    Only the text is looked at. A null text, or one without a letter, is `und` with score 0 and rejected; without a
    model (no labelled rows) every text is. Columns that already have one of the new names are replaced; all others
    stay, whatever they are called. Rows that repeat stay; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    docs = docs.drop(lang_out, score_out, rejected_out)
    flagged = docs.withColumn(rejected_out, ~has_letter(F.col(text_col)))
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType()), T.StructField(rejected_out, T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        own = shared.value
        for whole in batches:
            for part in slices(whole, text_col):
                none = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
                if own is None:
                    lang, score, gone = np.full(len(none), UNDETERMINED, object), np.zeros(len(none)), np.ones(len(none), bool)
                else:
                    best, score, unsure = own.predict(*text_bytes(part.column(at)))
                    lang = np.where(none, UNDETERMINED, np.array(own.languages, object)[best])
                    score = np.where(none, 0.0, score)
                    gone = none | unsure
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(gone)], names=schema.names)

    return flagged.mapInArrow(run, schema)
