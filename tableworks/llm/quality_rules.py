"""Quality rules: base counts, and a hashed n-gram logistic regression with calibrated probabilities.

Features are hashed single words, word pairs and byte 4-grams, each kind as shares of the text. The
weights are fitted on a bounded sample of labelled documents inside one task, the probability is
calibrated on a part of the sample that the weights have not seen, and every document is then scored
in Arrow batches against fixed thresholds.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tableworks.llm.batches import arrow_schema, begin_task, keyed, labelled_sample, map_texts, slices, utf8

#: Hash buckets of each kind of feature, and labelled documents the model is fitted on at most.
BITS, TRAIN_ROWS = 15, 4000
#: Documents whose calibrated probability of being good is lower are rejected.
LEAST_PROBABILITY = 0.25
#: Base thresholds: fewest words, and largest share of words in repeated windows of three.
LEAST_WORDS, MOST_REPEATED = 50, 50

_SPACES, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_numbers(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as numbers in order of first use, and the distinct words."""
    numbers: dict[bytes, int] = {}
    number = numbers.setdefault
    sequence = [number(w, len(numbers)) for w in data.split()]
    return np.array(sequence, np.int64), list(numbers)


def _dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def repeated_words(sequence: np.ndarray, distinct: int) -> int:
    """Words that stand in a window of three words found at least twice."""
    n = len(sequence)
    if n < 4:
        return 0
    pairs = sequence[:-1] * distinct + sequence[1:]
    if distinct > 2_000_000:  # three numbers would not fit 64 bits
        pairs, distinct = _dense(pairs), n
        triples = pairs[:-1] * distinct + _dense(sequence)[2:]
    else:
        triples = pairs[:-1] * distinct + sequence[2:]
    order = np.argsort(triples, kind="stable")
    ranked = triples[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(triples), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:shift + len(again)] |= again
    return int(covered.sum())


def base_counts(data: bytes, sequence: np.ndarray, distinct: int) -> tuple[int, int, int, int, int, bool]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` of a text in UTF-8."""
    dense = data.translate(None, _SPACES)
    word_chars = len(dense) if dense.isascii() else len(dense.decode())
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(_SPACES)]
    n, repeats = len(sequence), repeated_words(sequence, distinct)
    failed = n < LEAST_WORDS or 100 * repeats > MOST_REPEATED * n
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeats, failed


def _bucket(values: np.ndarray, kind: int) -> np.ndarray:
    return ((values * _MIX) >> np.uint64(64 - BITS)).astype(np.int64) + (kind << BITS)


def features(data: bytes, sequence: np.ndarray, distinct: list[bytes]):
    """Buckets of the three kinds of features of a text, one entry per occurrence."""
    codes = np.fromiter(map(zlib.crc32, distinct), np.uint64, len(distinct))[sequence] if len(sequence) else np.zeros(0, np.uint64)
    yield _bucket(codes, 0)
    # a word said twice is the same pair whatever the word
    yield _bucket(np.where(codes[:-1] == codes[1:], np.uint64(1), codes[:-1] * np.uint64(31) + codes[1:]), 1)
    signs = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(signs) >= 4:
        yield _bucket(signs[:-3] | signs[1:-2] << np.uint64(8) | signs[2:-1] << np.uint64(16) | signs[3:] << np.uint64(24), 2)


def raw_score(data: bytes, sequence: np.ndarray, distinct: list[bytes], weights: np.ndarray) -> float:
    """Sum over the kinds of the mean weight of a text's features."""
    return sum(float(weights[b].mean()) for b in features(data, sequence, distinct) if len(b))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _adam(gradient, start: np.ndarray, rate: float, steps: int) -> np.ndarray:
    """Minimise with adaptive steps; ``gradient`` maps parameters to their gradient."""
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(w)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return w


def fit(texts: list[bytes], labels: np.ndarray) -> np.ndarray:
    """Weights, then bias and the two numbers of the calibration; NaN if only one label occurs.

    Four of five texts (by order) fit the weights, the others the calibration; classes count alike.
    """
    size = 3 << BITS
    if len(set(labels.tolist())) < 2:
        return np.full(size + 3, np.nan, np.float32)
    row, column, value = [], [], []
    for n, data in enumerate(texts):
        sequence, distinct = word_numbers(data)
        for buckets in features(data, sequence, distinct):
            if len(buckets):
                found, times = np.unique(buckets, return_counts=True)
                row.append(np.full(len(found), n, np.int32))
                column.append(found.astype(np.int32))
                value.append((times / len(buckets)).astype(np.float32))
    row = np.concatenate(row) if row else np.zeros(0, np.int32)
    column = np.concatenate(column) if column else np.zeros(0, np.int32)
    value = np.concatenate(value) if value else np.zeros(0, np.float32)
    held = np.arange(len(texts)) % 5 == 4
    if len(set(labels[held].tolist())) < 2 or len(set(labels[~held].tolist())) < 2:
        held[:] = False
    share = np.where(labels == 1, 0.5 / max(1, (labels[~held] == 1).sum()), 0.5 / max(1, (labels[~held] == 0).sum()))
    share[held] = 0

    def spread(values, places):
        # one array as long as the features, not two
        x = values[places]
        x *= value
        return x

    def scores(w):
        return np.bincount(row, spread(w, column), len(texts)) + w[size]

    def gradient(w):
        error = (_sigmoid(scores(w)) - labels) * share
        g = np.bincount(column, spread(error, row), size + 1) + 1e-6 * w
        g[size] = error.sum()
        return g

    w = _adam(gradient, np.zeros(size + 1), 0.5, 60)
    fit_on = held if held.any() else ~held
    z, y = scores(w)[fit_on], labels[fit_on]
    # soft targets keep the slope finite where the classes are apart
    good, bad = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = max(z.std(), 1e-6)

    def calibration(ab):
        error = (_sigmoid(ab[0] * z / scale + ab[1]) - target) / len(z)
        return np.array([(error * z / scale).sum(), error.sum()])

    a, b = _adam(calibration, np.array([1.0, 0.0]), 0.1, 400)
    return np.concatenate([w, [a / scale, b]]).astype(np.float32)


def probability(raw: float, model: np.ndarray) -> float:
    """Calibrated probability of a good text; 1 where no model could be fitted."""
    bias, a, b = (float(x) for x in model[-3:])
    return 1.0 if np.isnan(a) else float(_sigmoid(a * (raw + bias) + b))


def fit_model(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """The model fitted in one task on at most ``rows`` labelled documents."""
    sample = labelled_sample(docs, labels, "quality", rows).coalesce(1)
    schema = arrow_schema(docs.sparkSession, "model binary")

    def run(batches):
        begin_task()
        got = sorted((x for b in batches for x in zip(
            b.column("doc_id").to_pylist(), b.column("label").to_pylist(), utf8(b, "text"))), key=lambda x: zlib.crc32(b"%d" % x[0]))
        model = fit([x[2] for x in got], np.array([x[1] for x in got], np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([model.tobytes()], pa.binary())], schema=schema)

    # 0.4 MB whatever the input; a sample without rows runs no task
    found = sample.mapInArrow(run, "model binary").collect()
    return np.frombuffer(found[0][0], np.float32) if found else fit([], np.zeros(0))


def _judged(texts: list[bytes], weights: np.ndarray, least: float) -> list[tuple]:
    """Base counts, whether a base rule fails, the verdict and the probability of each text."""
    rows = []
    for data in texts:
        sequence, distinct = word_numbers(data)
        counts = base_counts(data, sequence, len(distinct))
        p = probability(raw_score(data, sequence, distinct, weights), weights)
        rows.append((*counts, not counts[-1] and p >= least, p))
    return rows


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    train_rows: int = TRAIN_ROWS, least: float = LEAST_PROBABILITY,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, probability``.

    ``kept`` is false for documents that fail a base rule or whose probability is below ``least``. A
    null or empty text has no words and fails. Without labels of both kinds the base rules decide.
    Repeated rows are judged each; a null identifier stays null; an empty table gives an empty result;
    other columns are ignored.
    """
    texts = keyed(docs, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(fit_model(texts, labels, train_rows))

    def judge(batch):
        rows = _judged(utf8(batch, "text"), model.value, least)
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"]
        columns = list(zip(*rows)) or [()] * len(names)
        return {"doc_id": batch.column("doc_id")} | dict(zip(names, columns))

    return map_texts(texts, judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                   "n_repeat_words long, base_failed boolean, kept boolean, probability double")


def good_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    train_rows: int = TRAIN_ROWS, least: float = LEAST_PROBABILITY,
) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns whatever their names.

    Null and empty texts fail; repeated rows are judged each; an empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_model(keyed(docs, id_col, text_col), labels, train_rows))

    def run(batches):
        for piece in slices(batches):
            kept = [row[-2] for row in _judged(utf8(piece, text_col), model.value, least)]
            yield piece.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
