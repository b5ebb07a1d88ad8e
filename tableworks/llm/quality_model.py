"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. A passage is encoded by the mean of learned embeddings of
its hashed words and by shares of byte classes, distinct words and the like; a gated attention learned
from document labels alone weighs the passages; the weighted mean is scored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableworks.llm.batches import arrow_schema, keyed, labelled_sample, map_texts, utf8

#: Words of a passage, hash buckets and size of embeddings, hidden units, labelled documents at most, steps.
PASSAGE, BUCKETS, SIZE, HIDDEN, TRAIN_ROWS, STEPS = 64, 4096, 8, 12, 4000, 160
#: A document is taken as good from this score on.
LEAST_SCORE = 0.3

_SPACES = b" \t\n\x0b\x0c\r"
_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,", b"!?", b"#*$%&", b"|<>", b"@/:=_+-", b"'\"()[];"]
_CLASS = np.full(256, len(_GROUPS) + 1, np.int64)
for _n, _group in enumerate(_GROUPS):
    _CLASS[list(_group)] = _n
_CLASS[:33] = len(_GROUPS)
_CLASSES = len(_GROUPS) + 2
#: Plain features of a passage: byte classes, distinct words, mean word length, new words, words in
#: capitals, words said twice in a row, words (in shares of a full passage).
_PLAIN = _CLASSES + 6
_SHAPES = {"e": (BUCKETS, SIZE), "w": (SIZE + _PLAIN, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, HIDDEN),
           "u": (HIDDEN, HIDDEN), "a": (HIDDEN,), "o": (HIDDEN,), "c": (1,)}


def passages(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, first word of each passage, and plain features of each passage; a text without words
    is one passage without features."""
    numbers: dict[bytes, int] = {}
    number = numbers.setdefault
    found = data.split()
    sequence = np.array([number(w, len(numbers)) for w in found], np.int64)
    n = len(sequence)
    if not n:
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros((1, _PLAIN))
    codes = np.fromiter((zlib.crc32(w) for w in numbers), np.int64, len(numbers)) % BUCKETS
    starts = np.arange(0, n, PASSAGE)
    owner = np.arange(n) // PASSAGE
    count = np.bincount(owner).astype(float)
    sizes = np.fromiter(map(len, found), np.int64, n)
    dense = np.frombuffer(data.translate(None, _SPACES), np.uint8)
    size = np.add.reduceat(sizes, starts)
    classes = np.bincount(np.repeat(np.arange(len(starts)), size) * _CLASSES + _CLASS[dense],
                          minlength=len(starts) * _CLASSES).reshape(-1, _CLASSES)
    pairs = np.unique(owner * len(numbers) + sequence) // len(numbers)
    first = np.zeros(n)
    first[np.unique(sequence, return_index=True)[1]] = 1
    heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    capital = (_CLASS[dense[heads]] == 1) & ((_CLASS[dense[heads + sizes - 1]] == 1) | (_CLASS[dense[heads + (sizes - 1) // 2]] == 1)) & (sizes > 1)
    twice = np.append(0.0, sequence[1:] == sequence[:-1])
    plain = np.column_stack([
        classes / size[:, None] * 3, np.bincount(pairs, minlength=len(starts)) / count, size / count / 10,
        np.add.reduceat(first, starts) / count, np.add.reduceat(capital.astype(float), starts) / count,
        np.add.reduceat(twice, starts) / count, count / PASSAGE])
    return codes[sequence], starts, plain


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _bag_sum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def forward(model: dict, x: np.ndarray, bags: np.ndarray) -> dict:
    """Scores of bags of encoded passages; ``bags`` has the first passage of each bag."""
    h = np.tanh(x @ model["w"] + model["b"])
    t, s = np.tanh(h @ model["v"]), _sigmoid(h @ model["u"])
    logit = np.clip((t * s) @ model["a"], -20, 20)
    weight = np.exp(logit)
    owner = np.repeat(np.arange(len(bags)), np.diff(np.append(bags, len(x))))
    attention = weight / _bag_sum(weight, bags)[owner]
    z = _bag_sum(attention[:, None] * h, bags)
    return {"h": h, "t": t, "s": s, "attention": attention, "owner": owner, "z": z, "p": _sigmoid(z @ model["o"] + model["c"][0])}


def encode(model: dict, words: np.ndarray, starts: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Inputs of the passages: mean embedding and plain features."""
    if not len(words):
        return np.concatenate([np.zeros((len(plain), SIZE)), plain], axis=1)
    ends = np.append(starts[1:], len(words))
    mean = _bag_sum(model["e"][words], starts) / (ends - starts)[:, None]
    return np.concatenate([mean, plain], axis=1)


def _gradients(model: dict, x: np.ndarray, bags: np.ndarray, label: np.ndarray, out: dict) -> tuple[dict, np.ndarray]:
    """Gradients of the mean log loss, and with respect to the inputs."""
    owner, h, attention = out["owner"], out["h"], out["attention"]
    error = (out["p"] - label) / len(label)
    g = {"c": np.array([error.sum()]), "o": out["z"].T @ error}
    dz = (error[:, None] * model["o"])[owner]
    pull = (dz * h).sum(1)
    dlogit = attention * (pull - _bag_sum(attention * pull, bags)[owner])
    g["a"] = (out["t"] * out["s"]).T @ dlogit
    gate = dlogit[:, None] * model["a"]
    dt, ds = gate * out["s"] * (1 - out["t"] ** 2), gate * out["t"] * out["s"] * (1 - out["s"])
    g["v"], g["u"] = h.T @ dt, h.T @ ds
    dh = (attention[:, None] * dz + dt @ model["v"].T + ds @ model["u"].T) * (1 - h ** 2)
    g["w"], g["b"] = x.T @ dh, dh.sum(0)
    return g, dh @ model["w"].T


def fit(texts: list[bytes], labels: np.ndarray, steps: int = STEPS) -> dict | None:
    """The model by adaptive gradient steps over all bags; None if only one label occurs."""
    if len(set(labels.tolist())) < 2:
        return None
    words, firsts, plains, bags, at, row = [], [], [], [], 0, 0
    for data in texts:
        w, starts, plain = passages(data)
        # a passage without words reads one word of a bucket of its own
        w = w if len(w) else np.zeros(1, np.int64)
        words.append(w)
        firsts.append(starts + at)
        plains.append(plain)
        bags.append(row)
        at, row = at + len(w), row + len(starts)
    words, firsts, plain, bags = np.concatenate(words), np.concatenate(firsts), np.concatenate(plains), np.array(bags)
    count = np.diff(np.append(firsts, len(words)))
    owner = np.repeat(np.arange(len(firsts)), count)
    random = np.random.default_rng(7)
    model = {k: random.normal(0, 0.3 if k != "e" else 0.05, s) for k, s in _SHAPES.items()}
    m = {k: np.zeros(s) for k, s in _SHAPES.items()}
    v = {k: np.zeros(s) for k, s in _SHAPES.items()}
    for step in range(1, steps + 1):
        x = encode(model, words, firsts, plain)
        out = forward(model, x, bags)
        g, dx = _gradients(model, x, bags, labels, out)
        each = (dx[:, :SIZE] / count[:, None])[owner]
        g["e"] = np.stack([np.bincount(words, each[:, d], BUCKETS) for d in range(SIZE)], axis=1)
        for k in _SHAPES:
            g[k] = g[k] + 1e-5 * model[k]
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.02 * (g[k] ** 2 - v[k])
            model[k] -= 0.05 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.98 ** step)) + 1e-8)
    return model


def _packed(model: dict | None) -> bytes:
    return b"" if model is None else b"".join(model[k].astype(np.float64).tobytes() for k in _SHAPES)


def _unpacked(data: bytes) -> dict | None:
    if not data:
        return None
    values, at, model = np.frombuffer(data), 0, {}
    for k, shape in _SHAPES.items():
        size = int(np.prod(shape))
        model[k], at = values[at:at + size].reshape(shape), at + size
    return model


def _held(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_model(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> bytes:
    """The model fitted in one task on at most ``rows`` labelled documents outside the held-out fold."""
    sample = labelled_sample(docs, labels.filter(~_held(F.col("doc_id").cast("long"))), "quality", rows).coalesce(1)
    schema = arrow_schema(docs.sparkSession, "model binary")

    def run(batches):
        got = sorted(x for b in batches for x in zip(
            b.column("doc_id").to_pylist(), b.column("label").to_pylist(), utf8(b, "text")))
        model = fit([x[2] for x in got], np.array([x[1] for x in got], float)) if got else None
        yield pa.RecordBatch.from_arrays([pa.array([_packed(model)], pa.binary())], schema=schema)

    # 0.5 MB whatever the input; a sample without rows runs no task
    found = sample.mapInArrow(run, "model binary").collect()
    return found[0][0] if found else _packed(None)


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    train_rows: int = TRAIN_ROWS, least: float = LEAST_SCORE,
) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Labels are learned only from documents whose crc32(doc_id as text) mod 5 is not 0; only the text is
    scored. A null text counts as empty and is scored like any other. Without labels of both kinds every
    score is 1. Repeated rows are scored each; a null identifier is not held out; an empty table gives an
    empty result; other columns are ignored.
    """
    texts = keyed(docs, id_col, text_col)
    packed = docs.sparkSession.sparkContext.broadcast(fit_model(texts, labels, train_rows))

    def judge(batch):
        model = _unpacked(packed.value)
        scores = []
        for data in utf8(batch, "text"):
            words, starts, plain = passages(data)
            scores.append(1.0 if model is None else float(
                forward(model, encode(model, words, starts, plain), np.zeros(1, np.int64))["p"][0]))
        return {"doc_id": batch.column("doc_id"), "score": pa.array(scores, pa.float64())}

    scored = map_texts(texts, judge, "doc_id long, score double")
    return scored.select("doc_id", _held(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= least).cast("int").alias("predicted"))
