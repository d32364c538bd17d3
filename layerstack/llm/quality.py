"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages: its lines, long ones cut every `PASSAGE` bytes. Each passage is
encoded as shares of byte classes and figures on its words (repetition, length, distinctness). A
tanh layer embeds it; gated attention, softmax(w . (tanh(V h) * sigmoid(U h))), weighs a document's
passages; the logistic score is that of the weighted representation. Only documents have labels;
which passages matter is learnt.

The model is fitted on the driver to a bounded sample of labelled documents (`SAMPLE` documents and
`SAMPLE_BYTES` of features, parameters; those with the smallest hash of their id), and scores whole texts of all documents in tasks. It
never sees id, language or source.

Defined results: a null, empty or blank text is one passage without words, and is scored; rows are
kept one to one; with labels of one class only (or none) the score is their mean (or 0.5); null
labels and unmatched ids are not learnt from; input columns named like result columns are
replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    DoubleType,
    IntegerType,
    StructField,
    StructType,
)

from layerstack.llm.common import index_of, stored, with_arrow, without

#: Most labelled documents that a model is fitted to.
SAMPLE = 6000
#: Bytes of these documents' passages (as features) that are fitted to, at most.
SAMPLE_BYTES = 128 << 20
#: Bytes of a passage at most.
PASSAGE = 400
#: Bytes handled at once; longer texts are encoded in slices.
SLICE = 1 << 20
THRESHOLD = 0.3

_MARKS = b".,!?;:'\"#%&*$|@()-_/=+<>[]{}~^`\\"


def _classes() -> np.ndarray:
    table = np.zeros(256, np.int64)  # 0: other control bytes
    table[list(b" \t\n\r\x0b\x0c")] = 1
    table[ord("a") : ord("z") + 1] = 2
    table[ord("A") : ord("Z") + 1] = 3
    table[ord("0") : ord("9") + 1] = 4
    table[0x80:0xC0] = 5
    table[0xC0:] = 6
    for i, b in enumerate(_MARKS):
        table[b] = 7 + i
    return table


CLASS = _classes()
N_CLASSES = 7 + len(_MARKS)
N_FEATURES = N_CLASSES + 9
_RANDOM = np.random.default_rng(20240).integers(0, 2**63, (2, 256), np.uint64) | np.uint64(1)


def passage_features(data: bytes) -> np.ndarray:
    """One row of features per passage with anything but white space."""
    buf = np.frombuffer(data, np.uint8)
    n = len(buf)
    if not n:
        return np.empty((0, N_FEATURES), np.float32)
    at = np.arange(n)
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = buf[:-1] == 10
    line = np.maximum.accumulate(np.where(start, at, 0))
    start = (at - line) % PASSAGE == 0
    passage = np.cumsum(start) - 1
    count = int(passage[-1]) + 1
    kind = CLASS[buf]
    shares = np.bincount(passage * N_CLASSES + kind, minlength=count * N_CLASSES)
    shares = shares.reshape(count, N_CLASSES).astype(np.float64)
    length = shares.sum(1)
    solid = kind != 1
    first = solid.copy()
    first[1:] &= ~solid[:-1] | start[1:]
    begins = np.flatnonzero(first)
    words = np.zeros((5, count))
    if len(begins):
        place = at - np.maximum.accumulate(np.where(first, at, 0))
        with np.errstate(over="ignore"):
            value = _RANDOM[0][buf] * _RANDOM[1][place & 255]
            h = np.add.reduceat(np.where(solid, value, np.uint64(0)), begins)
        of = passage[begins]
        words[0] = np.bincount(of, minlength=count)
        for k, gap in ((1, 1), (2, 2)):
            same = (h[gap:] == h[:-gap]) & (of[gap:] == of[:-gap])
            words[k] = np.bincount(of[gap:][same], minlength=count)
        order = np.lexsort((h, of))
        new = np.ones(len(h), bool)
        new[1:] = (np.diff(of[order]) != 0) | (np.diff(h[order]) != 0)
        words[3] = np.bincount(of[order][new], minlength=count)
        words[4] = np.bincount(of[kind[begins] == 3], minlength=count)
    number = np.maximum(words[0], 1)
    letters = np.maximum(shares[:, 2] + shares[:, 3], 1)
    more = np.stack(
        [
            words[1] / number,
            words[2] / number,
            words[3] / number,
            words[4] / number,
            (length - shares[:, 1]) / number / 10,
            np.log1p(words[0]),
            shares[:, 3] / letters,
            shares[:, 7:].sum(1) / number,
            shares[:, 7:].sum(1) / length,
        ],
        1,
    )
    out = np.concatenate([shares / length[:, None], more], 1).astype(np.float32)
    return out[shares[:, 1] < length]


def encode_text(text: str | None) -> np.ndarray:
    """Features of all passages of a text: at least one row, of zeros where there is no word."""
    data = (text or "").encode()
    parts, at = [], 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            end = data.rfind(b"\n", at, end) + 1 or end
        parts.append(passage_features(data[at:end]))
        at = end
    rows = np.concatenate(parts) if parts else np.empty((0, N_FEATURES), np.float32)
    return rows if len(rows) else np.zeros((1, N_FEATURES), np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class AttentionModel:
    """Parameters of the classifier; `constant` is the score where nothing could be learnt."""

    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: dict[str, np.ndarray] | None = None
    constant: float | None = None

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        """Scores of documents from the features of their passages."""
        if self.constant is not None:
            return np.full(len(bags), self.constant)
        starts = np.cumsum([0, *map(len, bags)])[:-1]
        x = (np.concatenate(bags) - self.mean) / self.scale
        return _sigmoid(_forward(np.clip(x, -8, 8), starts, self.weights)["logit"]).astype(float)

    def attention(self, bag: np.ndarray) -> np.ndarray:
        """Weights of one document's passages."""
        x = np.clip((bag - self.mean) / self.scale, -8, 8)
        return _forward(x, np.array([0]), self.weights)["a"]


def _forward(x, starts, p) -> dict[str, np.ndarray]:
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (t * g) @ p["w"]
    sizes = np.diff(np.append(starts, len(x)))
    doc = np.repeat(np.arange(len(starts)), sizes)
    e = np.exp(e - np.maximum.reduceat(e, starts)[doc])
    a = e / np.add.reduceat(e, starts)[doc]
    z = np.add.reduceat(a[:, None] * h, starts)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "doc": doc, "logit": z @ p["u"] + p["c"]}


def _gradients(x, starts, y, p) -> dict[str, np.ndarray]:
    f = _forward(x, starts, p)
    d = (_sigmoid(f["logit"]) - y) / len(y)
    dz = d[:, None] * p["u"]
    row = dz[f["doc"]]
    da = (row * f["h"]).sum(1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[f["doc"]])
    dt = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
    dg = de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
    dh = f["a"][:, None] * row + dt @ p["V"].T + dg @ p["U"].T
    dh *= 1 - f["h"] ** 2
    return {
        "W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
        "w": (f["t"] * f["g"]).T @ de, "u": f["z"].T @ d, "c": d.sum(),
    }


def fit_bags(
    bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gate: int = 8,
    epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7,
) -> AttentionModel:
    """Adam on the cross-entropy of documents' labels."""
    labels = np.asarray(labels, float)
    if len(set(labels.tolist())) < 2:
        return AttentionModel(constant=float(labels.mean()) if len(labels) else 0.5)
    rows = np.concatenate(bags)
    mean, scale = rows.mean(0), rows.std(0) + 1e-3
    bags = [np.clip((b - mean) / scale, -8, 8) for b in bags]
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, s[0] ** -0.5, s).astype(np.float32)
    p = {
        "W": draw(N_FEATURES, hidden), "b": np.zeros(hidden, np.float32), "V": draw(hidden, gate),
        "U": draw(hidden, gate), "w": draw(gate), "u": draw(hidden), "c": np.float32(0),
    }
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    step, total = 0, epochs * -(-len(bags) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(bags), batch):
            pick = order[i : i + batch]
            chosen = [bags[j] for j in pick]
            starts = np.cumsum([0, *map(len, chosen)])[:-1]
            grads = _gradients(np.concatenate(chosen), starts, labels[pick], p)
            step += 1
            now = rate * (1 - step / total) + 1e-5
            for k, v in grads.items():
                v = v + decay * p[k] * (k in ("W", "V", "U", "u"))
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.999 * s[k] + 0.001 * v * v
                move = m[k] / (1 - 0.9**step) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
                p[k] = (p[k] - now * move).astype(np.float32)
    return AttentionModel(mean, scale, p)


def fold(doc_id, folds: int):
    """Which fold an id is in: crc32 of its text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "quality",
    sample: int = SAMPLE,
    sample_bytes: int = SAMPLE_BYTES,
) -> AttentionModel:
    """Fit to at most `sample` labelled documents and `sample_bytes` of features, by a hash of their id.

    The ids are chosen from the labels alone, so the join broadcasts `sample` rows at most and the
    documents are not shuffled. Features of those documents' passages go to the driver, in order of the hash as
    long as they fit.
    """
    chosen = (
        labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").alias("_label"))
        .dropna()
        .orderBy(F.xxhash64("_id"), "_id", "_label")
        .limit(sample)
    )
    found = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    found = found.join(F.broadcast(chosen), "_id")

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        at = index_of_name(batch, "_text")
        texts = batch.column(at).to_pylist()
        return [pa.array([encode_text(t).tobytes() for t in texts], pa.binary())]

    added = StructType([StructField("bag", BinaryType())])
    rows = stored(with_arrow(found, added, make).select("_id", "_label", "bag"), "quality-bags")
    # As many rows as the sample has, so one task can order them.
    in_order = Window.orderBy(F.xxhash64("_id"), "_id", "_label", F.xxhash64("bag"))
    size = F.sum(F.octet_length("bag").cast("long")).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("size", size).where(F.col("size") <= sample_bytes).collect()
    rows.sort(key=lambda r: (r["_id"], r["_label"], bytes(r["bag"])))
    bags = [np.frombuffer(bytes(r["bag"]), np.float32).reshape(-1, N_FEATURES) for r in rows]
    return fit_bags(bags, np.array([float(r["_label"] > 0) for r in rows]))


def index_of_name(batch: pa.RecordBatch, name: str) -> int:
    return batch.schema.get_field_index(name)


def score(
    df: DataFrame, model: AttentionModel, text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Adds `score` (0 to 1, higher: label 1 is likelier) and `predicted` (1 from the threshold)."""
    at = index_of(df, text)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        scores = [
            model.score([encode_text(t) for t in batch.column(at).slice(i, 256).to_pylist()])
            for i in range(0, batch.num_rows, 256)
        ]
        flat = np.concatenate([np.empty(0), *scores])
        return [pa.array(flat), pa.array((flat >= threshold).astype(np.int32))]

    added = StructType(
        [StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    )
    return with_arrow(df, added, make)


def keep_good(
    df: DataFrame, model: AttentionModel, text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows that the classifier does not reject, with their own columns only."""
    base = without(df, "score", "predicted")
    if base.columns != df.columns:  # the input has columns of these names: score beside them
        renamed = df.select(
            *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(df.columns)]
        )
        at = df.columns[index_of(df, text)]
        scored = score(renamed, model, f"_c{df.columns.index(at)}", threshold)
        kept = scored.where("predicted = 1")
        return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(df.columns)])
    return score(df, model, text, threshold).where("predicted = 1").drop("score", "predicted")
