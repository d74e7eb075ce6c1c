"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Strings are the words of a text (lower-cased, cut into windows of ``LENGTH`` bytes if longer) and runs of single characters joined to one string
("i d i o t"). The kernel k(s, t) sums, over all subsequences of ``ORDER`` characters that s and t share, DECAY to the power of the places they
span in both; it is normalised to k(s, s) = 1. Gaps and inserted characters lower it only gradually.

Landmarks are the strings whose share of toxic training texts most exceeds their share of the others (by z score). A text's kernel values are, landmark by
landmark, the largest over its strings and log(1 + the sum of those of ``LIKE`` or more); Nystroem features are these times K^(-1/2) of the
landmarks' own kernel matrix. A linear support
vector machine with squared hinge loss on these features, and a logistic curve on its margins, give the score. Kernel values with landmarks are exact
for every string: the ordered triples of a string that some landmark holds too are found in a prefix tree of the landmarks' triples, and a string
without such a triple has the value 0.

Training uses at most ``sample`` labelled texts (those of the smallest hashes of doc_id); scoring reads whole texts. A text's label, language,
source and id are never features.

Defined results: null and empty texts have no strings, so all their kernel values are 0; without both labels among the training rows every score is
the share of toxic rows (0 without rows); repeated rows are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyops.llm.common import SLICE_BYTES, slices, stage, texts
from skyops.llm.features import sample_ids
from skyops.llm.words import LOWER, hash_spans, spans

ORDER, DECAY, LENGTH, LIKE = 3, 0.6, 24, 0.6
#: shared triples that are held at once
HELD = 1 << 20


def strings(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct strings of a slice as rows of ``LENGTH`` bytes (0: none), and (document, string) of all occurrences."""
    starts, ends, words = spans(data, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(words))
    size = ends - starts
    lead = data[starts]
    single = size == 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)  # one code point
    # windows of long words: steps of half a window
    pieces = np.where(size <= LENGTH, 1, np.maximum(1, -(-(size - LENGTH) // (LENGTH // 2)) + 1))
    which = np.repeat(np.arange(len(starts)), pieces)
    step = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    a = starts[which] + step * (LENGTH // 2)
    b = np.minimum(a + LENGTH, ends[which])
    hashes = hash_spans(data, a, b)
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    rows = _gather(data, a[first], b[first])
    docs, ids = doc[which], inverse
    # runs of three single characters or more
    change = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
    joined, owner = [], []
    for x, y in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
        for d0, d1 in _by_doc(doc, x, y) if y - x >= ORDER else ():
            if d1 - d0 >= ORDER:
                text = b"".join(bytes(LOWER[data[starts[i]: ends[i]]]) for i in range(d0, d1))
                for k in range(0, max(1, len(text) - LENGTH // 2), LENGTH // 2):
                    joined.append(text[k: k + LENGTH].ljust(LENGTH, b"\0"))
                    owner.append(int(doc[d0]))
    if joined:
        docs = np.concatenate([docs, owner])
        ids = np.concatenate([ids, len(rows) + np.arange(len(joined))])
        rows = np.concatenate([rows, np.frombuffer(b"".join(joined), np.uint8).reshape(-1, LENGTH)])
    return rows, docs, ids


def _by_doc(doc: np.ndarray, x: int, y: int) -> list[tuple[int, int]]:
    cuts = [x, *(x + 1 + np.flatnonzero(np.diff(doc[x:y]))).tolist(), y]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _gather(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    at = a[:, None] + np.arange(LENGTH)
    inside = at < b[:, None]
    return np.where(inside, LOWER[data[np.minimum(at, max(len(data) - 1, 0))]], 0).astype(np.uint8) if len(a) else np.zeros((0, LENGTH), np.uint8)


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Unnormalised kernel of rows of s with rows of t (same number, or one row of t for all). 0 bytes match nothing."""
    n, width = len(s), int(_lengths(t).max()) if len(t) else 0
    long = int(_lengths(s).max()) if n else 0
    s, t = s[:, :long], t[:, :width]
    d = np.float32(DECAY)
    prefix = np.ones((width + 1, n), np.float32)  # K' of the order below, for the prefix of s so far, by prefix of t
    table = np.ones((long + 1, width + 1, n), np.float32)
    match = [(s[:, i] == t[:, j]) & (s[:, i] != 0) for i in range(long) for j in range(width)] if width else []
    for _ in range(ORDER - 1):
        new = np.zeros((long + 1, width + 1, n), np.float32)
        for i in range(1, long + 1):
            run = np.zeros(n, np.float32)  # K'' along t
            for j in range(1, width + 1):
                run = d * run + np.where(match[(i - 1) * width + j - 1], d * d * table[i - 1, j - 1], 0)
                new[i, j] = d * new[i - 1, j] + run
        table = new
    del prefix
    total = np.zeros(n, np.float32)
    for i in range(1, long + 1):
        for j in range(1, width + 1):
            total += np.where(match[(i - 1) * width + j - 1], d * d * table[i - 1, j - 1], 0)
    return total


def _lengths(rows: np.ndarray) -> np.ndarray:
    """Places up to the last character."""
    return np.where((rows != 0).any(1), LENGTH - np.argmax(rows[:, ::-1] != 0, axis=1), 0)


def own_kernel(s: np.ndarray) -> np.ndarray:
    """Kernel of rows with themselves. Without repeated characters, each triple of places meets itself alone."""
    plain = np.array([sum((size - span + 1) * (span - 2) * DECAY ** (2 * span) for span in range(ORDER, size + 1)) for size in range(LENGTH + 1)])
    length = _lengths(s)
    out = plain[length]
    order = np.sort(s, axis=1)
    again = np.flatnonzero(((order[:, 1:] == order[:, :-1]) & (order[:, 1:] != 0)).any(1) | ((s != 0).sum(1) < length))
    out[again] = kernel(s[again], s[again])
    return out


class Landmarks:
    """Landmark strings with what their kernel values need."""

    def __init__(self, words: list[bytes]):
        self.rows = np.frombuffer(b"".join(w.ljust(LENGTH, b"\0") for w in words), np.uint8).reshape(-1, LENGTH)
        self.own = kernel(self.rows, self.rows)
        used = np.unique(self.rows[self.rows > 0])
        self.code = np.zeros(256, np.int32)
        self.code[used] = np.arange(1, len(used) + 1)
        # the prefix tree: first characters, pairs and triples of the landmarks, each numbered from 1 (0: in no landmark)
        pairs: dict[tuple[int, int], int] = {}
        triples: dict[tuple[int, int], int] = {}
        cells: dict[tuple[int, int], float] = {}
        for mark, row in enumerate(self.code[self.rows].tolist()):
            for i, j, k in combinations([at for at, c in enumerate(row) if c], ORDER):
                pair = pairs.setdefault((row[i], row[j]), len(pairs) + 1)
                triple = triples.setdefault((pair, row[k]), len(triples) + 1)
                cells[triple, mark] = cells.get((triple, mark), 0.0) + DECAY ** (k - i + 1)
        self.pair = np.zeros((len(used) + 1, len(used) + 1), np.int32)
        self.triple = np.zeros((len(pairs) + 1, len(used) + 1), np.int32)
        for tree, known in ((self.pair, pairs), (self.triple, triples)):
            for place, number in known.items():
                tree[place] = number
        # the landmarks of each triple, with its weight there
        held = sorted(cells)
        self.first = np.searchsorted(np.array([t for t, _ in held], np.int64), np.arange(len(triples) + 2)).astype(np.int32)
        self.mark = np.array([m for _, m in held], np.int32)
        self.weight = np.array([cells[c] for c in held])

    def _shared(self, rows: np.ndarray) -> np.ndarray:
        """Unnormalised kernel of rows, longest first, with all landmarks: (string, landmark)."""
        n, size = len(rows), len(self.rows)
        out = np.zeros(n * size)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        code, length, width = self.code[rows], _lengths(rows), self.pair.shape[1]
        power = DECAY ** np.arange(LENGTH + 1)

        def add():
            string, triple, weight = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            for x in range(0, len(string), HELD):
                t = triple[x: x + HELD]
                many = self.first[t + 1] - self.first[t]
                at = np.repeat(self.first[t] - np.cumsum(many) + many, many) + np.arange(many.sum())
                cell = np.repeat(string[x: x + HELD] * size, many) + self.mark[at]
                out[:] += np.bincount(cell, np.repeat(weight[x: x + HELD], many) * self.weight[at], len(out))

        waiting = 0
        for i in range(LENGTH - 2):
            for j in range(i + 1, LENGTH - 1):
                m = int(np.searchsorted(-length, -(j + 1)))  # strings of more than j + 1 places
                if not m:
                    break
                pair = self.pair.ravel().take(code[:m, i] * width + code[:m, j])
                string = np.flatnonzero(pair)
                triple = self.triple.ravel().take((pair.take(string) * width)[:, None] + code[:, j + 1: length[0]].take(string, 0)).ravel()
                at = np.flatnonzero(triple)
                if len(at):
                    a, k = np.divmod(at, length[0] - j - 1)
                    found.append((string.take(a), triple.take(at), power.take(k + (j - i + 2))))
                    waiting += len(at)
                    if waiting > HELD:
                        add()
                        waiting = 0
        if found:
            add()
        return out.reshape(n, size)

    def table(self, rows: np.ndarray, chunk: int = 2048) -> np.ndarray:
        """Normalised kernel of all strings with all landmarks: (string, landmark)."""
        out = np.zeros((len(rows), len(self.rows)), np.float32)
        order = np.argsort(-_lengths(rows), kind="stable")
        for x in range(0, len(order), chunk):
            part = order[x: x + chunk]
            both = self._shared(rows[part])
            held = np.flatnonzero(both.any(1))
            own = own_kernel(rows[part[held]])
            out[part[held]] = both[held] / np.sqrt(own[:, None] * self.own)
        return out

    def of_texts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Documents x (landmarks twice): largest kernel value over a document's distinct strings, and log(1 + the sum of the large ones)."""
        rows, docs, ids = strings(data, off)
        size = len(self.rows)
        out = np.zeros((len(off) - 1, 2 * size), np.float32)
        if not len(rows):
            return out
        value = np.ascontiguousarray(self.table(rows).T)
        pairs = np.sort(docs.astype(np.int64) * len(rows) + ids)  # by document
        pairs = pairs[np.diff(pairs, prepend=-1) > 0]
        doc, string = pairs // len(rows), pairs % len(rows)
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        for mark in range(size):
            own = value[mark].take(string)
            out[doc[first], mark] = np.maximum.reduceat(own, first)
            like = np.flatnonzero(own >= LIKE)
            out[:, size + mark] = np.log1p(np.bincount(doc.take(like), own.take(like), len(out)))
        return out


@dataclass
class Model:
    """Landmarks, Nystroem projection times weights, bias, and the logistic curve of the margins."""

    marks: Landmarks | None
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        margin = np.full(len(off) - 1, self.bias)
        if self.marks is not None:
            margin = margin + self.marks.of_texts(data, off) @ self.weights
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -700, 700)))


def choose_landmarks(training: DataFrame, m: int, least: int = 3) -> list[bytes]:
    """The ``m`` strings of highest z score between toxic and other training texts (text, label), each in ``least`` toxic texts or more."""

    def count(batches):
        seen: dict[bytes, list[int]] = {}
        for batch in batches:
            label = np.asarray(batch.column("label"))
            for i, j, data, off in slices(batch.column("text"), 4 * SLICE_BYTES):
                rows, docs, ids = strings(data, off)
                for string, d in np.unique(np.stack([ids, docs], 1), axis=0).tolist():
                    seen.setdefault(rows[string].tobytes().rstrip(b"\0"), [0, 0])[label[i + d]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (0, 1))], names=["s", "n0", "n1"])

    size = training.agg(F.sum(1 - F.col("label")), F.sum("label")).first()
    n0, n1 = size[0] or 0, size[1] or 0
    rows = training.select("text", "label").mapInArrow(count, "s binary, n0 bigint, n1 bigint").groupBy("s").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    share = (F.col("n0") + F.col("n1")) / (n0 + n1)
    z = (F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-12)
    best = rows.where((F.length("s") >= ORDER) & (F.col("n1") >= least)).orderBy(z.desc(), "s").limit(m).collect()
    return [bytes(r.s) for r in best]


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, by Newton steps. y: -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    reg = np.eye(x.shape[1]) / c
    reg[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        active = y * (x @ w) < 1
        new = np.linalg.solve(reg + x[active].T @ x[active], x[active].T @ y[active])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def fit_curve(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve of the margins, lightly regularised."""
    x = np.stack([margin, np.ones_like(margin)], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (y - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` rows (text, label), one for each sampled id."""
    known = labels.where(F.col("toxic").isin(0, 1))
    ids = sample_ids(known, F.lit(True), sample)
    wanted = docs.sparkSession.createDataFrame([(int(i),) for i in ids], "doc_id bigint")
    chosen = known.join(F.broadcast(wanted), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "label")).alias("row")  # one text an id, so at most ``sample`` rows
    return stage(texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(one).select("row.text", "row.label"), "toxic-training")


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 20_000, landmarks: int = 96) -> Model:
    """Fit on at most ``sample`` rows of ``labels`` (doc_id, toxic), joined to their texts; of rows that share a doc_id, the text of the least hash counts."""
    training = training_rows(docs, labels, sample)
    share = training.agg(F.avg("label")).first()[0]
    if not share or share == 1:
        return Model(None, np.zeros(0), 0.0, 0.0, float(np.clip(np.log(share / (1 - share)), -30, 30)) if share == 0.5 else (30.0 if share else -30.0))
    words = choose_landmarks(training, landmarks)
    if not words:
        return Model(None, np.zeros(0), 0.0, 0.0, float(np.log(share / (1 - share))))
    marks = Landmarks(words)

    def run(batches):
        for batch in batches:
            for i, j, data, off in slices(batch.column("text"), 4 * SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(list(marks.of_texts(data, off).astype(np.float32)), pa.list_(pa.float32())), batch.column("label").slice(i, j - i)],
                                                 names=["x", "label"])

    rows = training.mapInArrow(run, "x array<float>, label int").toPandas()
    raw, label = np.stack(rows["x"].to_numpy()).astype(float), rows["label"].to_numpy()
    size = len(words)
    gram = marks.table(marks.rows).astype(float)
    gram = (gram + gram.T) / 2
    lam, vec = np.linalg.eigh(gram)
    root = vec @ np.diag(1 / np.sqrt(np.maximum(lam, 1e-2))) @ vec.T
    root = np.kron(np.eye(2), root)
    w, bias = fit_svm(raw @ root, np.where(label == 1, 1.0, -1.0))
    weights = root @ w
    return Model(marks, weights, bias, *fit_curve(raw @ weights + bias, label))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Rows: doc_id, score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for i, j, data, off in slices(batch.column("text"), 4 * SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(shared.value.score(data, off))], names=["doc_id", "score"])

    return texts(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
