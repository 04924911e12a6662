"""Language identification by a bidirectional gated recurrent network over bytes.

A text is cut into windows of ``WINDOW`` bytes; two gated recurrent units read each window, one
from either end, and a softmax over both states labels every byte with a language. A document's
probabilities are the mean over all bytes of letters in all its windows, so whole texts count.
The network is trained in numpy by backpropagation through time, with Adam, on the driver.

Training rows: non-null doc_id and lang, a text that is not empty, and crc32(doc_id) mod ``FOLDS``
other than ``HELD_OUT``. Every language among them is learned: ``ROWS`` rows are divided among the
languages, at least one and at most ``ROWS_PER_LANGUAGE`` of each, those with the smallest hash of
doc_id, and ``WINDOWS_PER_ROW`` windows of a row, spread evenly over its text. Of rows with the same
doc_id and language one is learned from, that whose text has the smallest hash. Bounded are also the
network, ``UNITS`` units a direction, and its training, ``STEPS`` batches of ``BATCH`` windows, whatever
the number of languages.

Defined cases: ``und`` with score 0 for null text, text without a letter, and every text if no
row can be learned from; the score is else the mean probability of the language, its first in
alphabetical order if two are alike; repeated rows are each scored; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tablecare.llm.common import crc_remainder, documents, least_hashed, one_text, staged

FOLDS, HELD_OUT = 4, 2
ROWS, ROWS_PER_LANGUAGE, WINDOWS_PER_ROW = 76_800, 600, 4
WINDOW, UNITS = 64, 8
STEPS, BATCH, RATE = 300, 512, 0.02
UNKNOWN = "und"
#: Windows that pass through the network together: the arrays of a step fit a core's cache. Fewer of
#: them, if there are more languages than ``MANY``, each of which has a probability for every byte.
TOGETHER, MANY = 1024, 128

LETTER = regex.compile(r"\p{L}")
#: Bytes that letters are made of.
IS_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


@dataclass
class Network:
    """Weights; per direction the input table (256, 3u) and the recurrent matrix (u, 3u).

    The three parts are update gate, reset gate and candidate.
    """

    languages: list[str]
    weights: dict[str, np.ndarray]

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(n, WINDOW, languages) for bytes (n, WINDOW)."""
        columns = np.ascontiguousarray(windows.T)
        u = self.weights["ref"].shape[0]
        states = np.empty((*columns.shape, 2 * u), np.float32)
        for k, d in enumerate("fb"):
            _states(self.weights, d, columns, states[:, :, k * u : (k + 1) * u])
        return _softmax(states @ self.weights["out"] + self.weights["bias"]).swapaxes(0, 1)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _order(direction: str, steps: int) -> range:
    return range(steps) if direction == "f" else range(steps - 1, -1, -1)


def _forward(w: dict[str, np.ndarray], direction: str, windows: np.ndarray, keep: bool = False):
    """States (n, steps, u) of one direction; with ``keep``, what the way back needs."""
    table, matrix = w["in" + direction], w["re" + direction]
    n, steps = windows.shape
    u = matrix.shape[0]
    h = np.zeros((n, u), np.float32)
    out, kept = np.empty((n, steps, u), np.float32), {}
    for t in _order(direction, steps):
        x, a = table[windows[:, t]], h @ matrix
        gates = np.tanh((x[:, : 2 * u] + a[:, : 2 * u]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
        update, reset = gates[:, :u], gates[:, u:]
        candidate = np.tanh(x[:, 2 * u :] + reset * a[:, 2 * u :])
        if keep:
            kept[t] = (h, update, reset, candidate, a[:, 2 * u :])
        h = h + update * (candidate - h)
        out[:, t] = h
    return out, kept


def _states(w: dict[str, np.ndarray], direction: str, columns: np.ndarray, out: np.ndarray) -> None:
    """The states of ``_forward`` for bytes (steps, n), into (steps, n, u), in arrays that are used again."""
    table, matrix = w["in" + direction], w["re" + direction]
    u, n = matrix.shape[0], columns.shape[1]
    # Gates are halved logistic functions, which the hyperbolic tangent gives.
    half = np.float32(0.5)
    gate_table, gate_matrix = table[:, : 2 * u] * half, matrix[:, : 2 * u] * half
    next_table, next_matrix = table[:, 2 * u :].copy(), matrix[:, 2 * u :].copy()
    h, (gates, add) = np.zeros((n, u), np.float32), (np.empty((n, 2 * u), np.float32) for _ in range(2))
    candidate, back = (np.empty((n, u), np.float32) for _ in range(2))
    for t in _order(direction, len(columns)):
        np.take(gate_table, columns[t], 0, gates, "clip")
        np.take(next_table, columns[t], 0, candidate, "clip")
        gates += np.matmul(h, gate_matrix, out=add)
        np.tanh(gates, out=gates)
        gates *= half
        gates += half
        np.matmul(h, next_matrix, out=back)
        back *= gates[:, u:]
        candidate += back
        np.tanh(candidate, out=candidate)
        candidate -= h
        candidate *= gates[:, :u]
        h += candidate
        out[t] = h


def _backward(w: dict[str, np.ndarray], direction: str, windows: np.ndarray, kept: dict, grad: np.ndarray):
    """Gradients of the table and the matrix, given those of the states."""
    table, matrix = w["in" + direction], w["re" + direction]
    n, steps = windows.shape
    u = matrix.shape[0]
    d_inputs = np.empty((n, steps, 3 * u), np.float32)
    d_matrix = np.zeros_like(matrix)
    d_h = np.zeros((n, u), np.float32)
    for t in reversed(_order(direction, steps)):
        h, update, reset, candidate, a = kept[t]
        d_h = d_h + grad[:, t]
        d_candidate = d_h * update * (1 - candidate * candidate)
        d_update = d_h * (candidate - h) * update * (1 - update)
        d_reset = d_candidate * a * reset * (1 - reset)
        d_a = np.concatenate([d_update, d_reset, d_candidate * reset], 1)
        d_inputs[:, t] = np.concatenate([d_update, d_reset, d_candidate], 1)
        d_matrix += h.T @ d_a
        d_h = d_h * (1 - update) + d_a @ matrix.T
    d_table = np.zeros_like(table)
    np.add.at(d_table, windows.ravel(), d_inputs.reshape(-1, 3 * u))
    return d_table, d_matrix


def gradients(w: dict[str, np.ndarray], windows: np.ndarray, labels: np.ndarray):
    """Mean cross entropy over the bytes of letters, and its gradients."""
    forward = {d: _forward(w, d, windows, keep=True) for d in "fb"}
    states = np.concatenate([forward[d][0] for d in "fb"], 2)
    p = _softmax(states @ w["out"] + w["bias"])
    counted = IS_LETTER[windows]
    total = max(1, counted.sum())
    own = np.take_along_axis(p, labels[:, None, None], 2)[..., 0]
    loss = float(-(np.log(own + 1e-9) * counted).sum() / total)
    d = p.copy()
    np.put_along_axis(d, np.broadcast_to(labels[:, None, None], (*windows.shape, 1)), own[..., None] - 1, 2)
    d *= (counted / total)[..., None].astype(np.float32)
    g = {"out": np.tensordot(states, d, ([0, 1], [0, 1])), "bias": d.sum((0, 1))}
    d_states = d @ w["out"].T
    u = w["ref"].shape[0]
    for k, direction in enumerate("fb"):
        g["in" + direction], g["re" + direction] = _backward(
            w, direction, windows, forward[direction][1], d_states[..., k * u : (k + 1) * u]
        )
    return loss, g


def initial(languages: int, units: int, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {"out": rng.normal(0, 0.3, (2 * units, languages)), "bias": np.zeros(languages)}
    for d in "fb":
        w["in" + d] = rng.normal(0, 0.3, (256, 3 * units))
        w["re" + d] = rng.normal(0, 1 / np.sqrt(units), (units, 3 * units))
    return {k: v.astype(np.float32) for k, v in w.items()}


def train(
    windows: np.ndarray, labels: np.ndarray, languages: list[str], units: int = UNITS, steps: int = STEPS
) -> Network:
    """Adam over random batches with every language alike often; the same input gives the same weights."""
    w = initial(len(languages), units)
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    rng = np.random.default_rng(2)
    by_language = [np.flatnonzero(labels == k) for k in range(len(languages))]
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(by_language[k]) for k in rng.integers(0, len(languages), BATCH)])
        batch = windows[pick].copy()
        # Some windows are cut short, as the last of a text is.
        short = rng.random(BATCH) < 0.1
        batch[short[:, None] & (np.arange(WINDOW) >= rng.integers(4, WINDOW, BATCH)[:, None])] = 0
        _, g = gradients(w, batch, labels[pick])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for k in w:
            x = g[k] * min(1.0, 1 / (norm + 1e-9))
            mean[k] += 0.1 * (x - mean[k])
            square[k] += 0.01 * (x * x - square[k])
            w[k] -= (rate * mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)).astype(
                np.float32
            )
    return Network(languages, w)


def _cut(raw: bytes) -> bytes:
    return raw.ljust(-(-len(raw) // WINDOW) * WINDOW, b"\0")


def training_windows(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, the number of each one's language, and the languages: a bounded sample."""
    known = (
        docs.where(F.col("text").cast("string") != "")
        .select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("lang").cast("string").alias("lang"),
            F.col("text").cast("string").alias("text"),
        )
        .where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
        .where(crc_remainder("doc_id", FOLDS) != HELD_OUT)
    )
    ids = staged(known.select("doc_id", "lang"), "known")
    chosen = least_hashed(ids, "lang", "doc_id", lambda n: min(ROWS_PER_LANGUAGE, ROWS // max(1, n)))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                raw = text.encode()
                last = max(0, len(raw) - WINDOW)
                for k in range(min(WINDOWS_PER_ROW, -(-len(raw) // WINDOW))):
                    at = last * k // max(1, WINDOWS_PER_ROW - 1)
                    out.append((lang, raw[at : at + WINDOW].ljust(WINDOW, b"\0")))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.binary()))],
                ["lang", "window"],
            )

    rows = (
        one_text(known.join(F.broadcast(chosen), ["lang", "doc_id"]), "lang", "doc_id")
        .select("lang", "text")
        .mapInArrow(some, "lang string, window binary")
        .collect()
    )
    rows.sort()
    languages = sorted({r.lang for r in rows})
    number = {x: k for k, x in enumerate(languages)}
    windows = np.frombuffer(b"".join(bytes(r.window) for r in rows), np.uint8).reshape(-1, WINDOW)
    return windows, np.array([number[r.lang] for r in rows], np.int64), languages


def fit(docs: DataFrame) -> Network | None:
    windows, labels, languages = training_windows(docs)
    return train(windows, labels, languages) if languages else None


def document_probabilities(network: Network, texts: list[str | None]) -> np.ndarray:
    """(documents, languages): the mean over the bytes of letters; 0 where there are none."""
    raw = [(t or "").encode() for t in texts]
    owner = np.repeat(np.arange(len(raw)), [-(-len(x) // WINDOW) for x in raw])
    windows = np.frombuffer(b"".join(map(_cut, raw)), np.uint8).reshape(-1, WINDOW)
    total, n = np.zeros((len(raw), len(network.languages))), np.zeros(len(raw))
    together = max(1, TOGETHER * MANY // max(MANY, len(network.languages)))
    for first in range(0, len(windows), together):
        some, own = windows[first : first + together], owner[first : first + together]
        counted = IS_LETTER[some]
        np.add.at(total, own, np.einsum("ntk,nt->nk", network.probabilities(some), counted.astype(np.float32)))
        np.add.at(n, own, counted.sum(1))
    return total / np.maximum(n, 1)[:, None]


def score(texts: DataFrame, network: Network | None, key: list[str], text_name: str = "text") -> DataFrame:
    """``texts`` (key columns, among them the text or not) -> key columns, lang_pred, score."""

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                text = part.column(text_name).to_pylist()
                found = [UNKNOWN] * len(text)
                best = np.zeros(len(text))
                if network is not None:
                    p = document_probabilities(network, text)
                    best = np.clip(p.max(1), 0, 1)
                    found = [network.languages[k] for k in p.argmax(1)]
                known = [t is not None and LETTER.search(t) is not None for t in text]
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in key]
                    + [
                        pa.array([x if k else UNKNOWN for x, k in zip(found, known)]),
                        pa.array(np.where(known, best, 0.0)),
                    ],
                    [*key, "lang_pred", "score"],
                )

    kinds = StructType([texts.schema[k] for k in key]).add("lang_pred", "string").add("score", "double")
    return texts.select(*dict.fromkeys([*key, text_name])).mapInArrow(labelled, kinds)


def predict(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score."""
    network = network or fit(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(rows, network, ["doc_id"]).select(
        "doc_id", (crc_remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score"
    )


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows whose language is known with a mean probability of ``least`` or more, all columns kept."""
    network = fit(docs)
    names = docs.columns
    # Columns travel under their positions, so no name can clash.
    flat = docs.select([F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(names)])
    key = flat.columns
    text_name = f"c{[c.lower() for c in names].index('text')}"
    return (
        score(flat, network, key, text_name)
        .where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
        .select([F.col(c).alias(name) for c, name in zip(key, names)])
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(documents(spark, sf_dir))
