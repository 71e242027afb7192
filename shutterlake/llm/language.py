"""Language identification by error-correcting output codes.

Each language has a codeword; a binary classifier over hashed character n-grams predicts each of its bits. Decoding
takes the codeword of least loss, each bit's loss weighted by how well that bit was learned for that language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.common import read
from shutterlake.llm.kernels import LETTERS, groups, mix, text_bytes

#: Size of the hashed feature space, and the most training rows of one language and of all (documented bounds).
DIMENSIONS, ROWS_PER_LANGUAGE, TRAINING_ROWS = 2048, 500, 20_000
#: Parts of the training rows, each of which is held back once to measure how far the bit classifiers can be trusted.
FOLDS = 3
#: A prediction scoring less than this is flagged as ambiguous.
AMBIGUOUS_BELOW = 0.1
UNDETERMINED = "und"


def features(data: np.ndarray, offsets: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit vectors of the square roots of hashed byte 1- to 4-gram counts; all but letters count as one space."""
    n = len(offsets) - 1
    out = np.zeros((n, dimensions), np.float32)
    for a, b in groups(offsets, 1 << 19):
        part = data[offsets[a] : offsets[b]]
        own = offsets[a : b + 1] - offsets[a]
        stream = np.where(LETTERS[part], part, 32).astype(np.uint64)
        row = np.repeat(np.arange(b - a), np.diff(own))
        gram = stream + np.uint64(1)
        for size in range(1, 5):
            if size > 1:
                if len(part) < size:
                    break
                gram = gram[:-1] * np.uint64(257) + stream[size - 1 :] + np.uint64(1)
            whole = row[: len(gram)] == row[size - 1 : size - 1 + len(gram)]
            cell = (mix(gram) % np.uint64(dimensions)).astype(np.int64) + row[: len(gram)] * dimensions
            out[a:b] += np.bincount(cell[whole], minlength=(b - a) * dimensions).reshape(b - a, dimensions)
    np.sqrt(out, out=out)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-12)


def codewords(classes: int) -> np.ndarray:
    """One row of -1 and 1 per class: the exhaustive code for few classes, else rows of a fixed random dense code."""
    if classes <= 1:
        return np.ones((classes, 1))
    if classes <= 6:
        bits = [[1 if (c >> k) & 1 else -1 for k in range(classes)] for c in range(1, 1 << (classes - 1))]
        return np.array(bits).T.astype(float)
    n = int(np.ceil(10 * np.log2(classes)))
    best, gap = None, -1
    for seed in range(64 if classes <= 1000 else 4):
        code = np.where(np.random.default_rng(seed).random((classes, n)) < 0.5, -1.0, 1.0)
        far = n
        for a in range(0, classes, 1000):
            apart = (n - code[a : a + 1000] @ code.T) / 2
            apart[np.arange(len(apart)), np.arange(a, a + len(apart))] = n
            far = min(far, int(apart.min()))
        if far > gap and (np.abs(code.sum(axis=0)) < classes).all():
            best, gap = code, far
    if best is None:
        raise ValueError("no dense code separates the classes")
    return best


@dataclass
class Model:
    """Languages, their codewords, the bit classifiers and the decoding weights."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and score of each row: 1 minus the least loss's ratio to the next one."""
        if len(self.languages) == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margin = x @ self.weights + self.bias
        # A bit's exponential loss is one of two values, by the sign that the codeword wants.
        loss = np.exp(-2 * margin) @ (self.trust * (self.code > 0)).T + np.exp(2 * margin) @ (self.trust * (self.code < 0)).T
        best = loss.argmin(axis=1)
        two = np.partition(loss, 1, axis=1)
        return best, 1 - two[:, 0] / two[:, 1]


def _bits(x: np.ndarray, y: np.ndarray, code: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of the bit classifiers: regularised least squares, each class weighing the same."""
    share = np.bincount(y, minlength=len(code))
    weight = (1.0 / np.maximum(share, 1))[y] * len(y) / max(1, len(code))
    target = code[y]
    mean = (x * weight[:, None]).sum(axis=0) / weight.sum()
    centre = (target * weight[:, None]).sum(axis=0) / weight.sum()
    z = (x - mean).astype(np.float64)
    gram = z.T @ (z * weight[:, None]) + ridge * np.eye(x.shape[1])
    w = np.linalg.solve(gram, z.T @ ((target - centre) * weight[:, None]))
    return w, centre - mean @ w


def held_back_trust(x: np.ndarray, y: np.ndarray, code: np.ndarray, ridge: float, folds: int = FOLDS) -> np.ndarray:
    """How often each bit is right for each class, on rows that its classifier wasn't fitted on.

    Rows are dealt to the folds class by class; a class of fewer rows than folds is judged by those it has, and one
    row more wrong and one more right keep a class of few rows from being trusted fully or not at all.
    """
    fold = np.empty(len(y), np.int64)
    order = np.argsort(y, kind="stable")
    fold[order] = np.arange(len(y)) % folds
    right, seen = np.ones(code.shape), np.full((len(code), 1), 2.0)
    for k in range(folds):
        back = fold == k
        if back.all() or not back.any():
            continue
        w, bias = _bits(x[~back], y[~back], code, ridge)
        hit = (x[back] @ w + bias) * code[y[back]] > 0
        np.add.at(right, y[back], hit)
        seen += np.bincount(y[back], minlength=len(code))[:, None]
    return right / seen


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], ridge: float = 1.0) -> Model:
    """Bit classifiers on all rows; the decoding weights from their accuracy on rows held back."""
    code = codewords(len(languages))
    w, bias = _bits(x, y, code, ridge)
    trust = held_back_trust(x, y, code, ridge)
    return Model(languages, code, w.astype(np.float32), bias.astype(np.float32), trust / trust.sum(axis=1, keepdims=True))


_SAMPLE = "lang string, doc_id long, x binary"


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(*text_bytes(pc.utf8_lower(batch.column("text").cast(pa.large_string()))))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "doc_id", "x"])


def _chosen(known: DataFrame, rows_per_language: int, training_rows: int) -> list[tuple[str, int]]:
    """Of each language the (language, doc_id) of least hash, as many as the bounds allow."""
    # One row per language; a language needs a training row, so that training_rows bounds them as well.
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(training_rows).collect()}
    if not counts:
        return []
    most = max(1, min(rows_per_language, training_rows // len(counts)))
    known = known.withColumn("h", F.xxhash64("doc_id", "lang").bitwiseAND((1 << 53) - 1).cast("double") / float(1 << 53))
    # A threshold that keeps somewhat more than the bound; where repeated ids leave too few, a higher one.
    cut, taken = {lang: min(1.0, 2.0 * most / n) for lang, n in counts.items()}, {}
    while cut:
        limit = F.element_at(F.create_map(*[F.lit(v) for pair in cut.items() for v in pair]), F.col("lang"))
        found: dict[str, list[tuple[float, int]]] = {lang: [] for lang in cut}
        for r in known.where(F.col("lang").isin(*cut) & (F.col("h") <= limit)).select("lang", "doc_id", "h").distinct().collect():
            found[r.lang].append((r.h, r.doc_id))
        for lang, rows in found.items():
            if len(rows) >= most or cut[lang] >= 1.0:
                taken[lang] = [i for _, i in sorted(rows)[:most]]
        cut = {lang: min(1.0, 16 * c) for lang, c in cut.items() if lang not in taken}
    return [(lang, i) for lang in sorted(taken) for i in taken[lang]]


def train(docs: DataFrame, may_learn: F.Column, rows_per_language: int = ROWS_PER_LANGUAGE, training_rows: int = TRAINING_ROWS) -> Model:
    """Fits on the rows of docs(doc_id, text, lang) that may be learned from and have a doc_id, text and lang.

    The bound is on the rows of the fit: of every language the rows_per_language documents whose hashed doc_id comes
    first, and evenly fewer where all languages together would have more than training_rows (of more languages than
    that, the commonest ones get a row each). Rows that repeat a
    language and doc_id count as one, by the first of their texts in order. Without any row nothing is learned.
    """
    usable = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    chosen = _chosen(usable.select("doc_id", "lang"), rows_per_language, training_rows)
    if not chosen:
        return Model([], codewords(0), np.zeros((DIMENSIONS, 1)), np.zeros(1), np.ones((0, 1)))
    ids = docs.sparkSession.createDataFrame(chosen, "lang string, doc_id long")  # at most training_rows
    rows = usable.join(F.broadcast(ids), ["lang", "doc_id"], "left_semi").groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    # In one order, and so with the same folds and fit, however the rows arrive.
    got = sorted(rows.select("lang", "doc_id", "text").mapInArrow(_sampled, _SAMPLE).collect(), key=lambda r: (r.lang, r.doc_id))
    languages = sorted({r.lang for r in got})
    x = np.stack([np.frombuffer(r.x, np.float32) for r in got])
    number = {lang: k for k, lang in enumerate(languages)}
    y = np.array([number[r.lang] for r in got])
    return fit(x, y, languages)


_PREDICTED = "lang_pred string, score double, ambiguous boolean"


def _predicted(model: Model, ambiguous_below: float):
    has_letter = regex.compile(r"\p{L}").search

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").cast(pa.large_string())
            letters = np.array([t.is_valid and has_letter(t.as_py()) is not None for t in text], bool)
            pred, score = np.full(len(text), UNDETERMINED, object), np.zeros(len(text))
            data, offsets = text_bytes(pc.utf8_lower(text))
            for a in range(0, len(text) if model.languages else 0, 256):
                b = min(a + 256, len(text))
                best, s = model.decode(features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                pred[a:b], score[a:b] = np.array(model.languages, object)[best], s
            pred[~letters], score[~letters] = UNDETERMINED, 0.0
            extra = [batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*extra, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(score < ambiguous_below, pa.bool_())], names=[*batch.schema.names, "lang_pred", "score", "ambiguous"])

    return predict


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, ambiguous_below: float = AMBIGUOUS_BELOW) -> DataFrame:
    """Adds lang_pred, score (0 to 1) and ambiguous to docs(text, ...), one row for each of its rows.

    Null and empty texts and those without a letter are `und` with score 0; so is everything if nothing was learned. A
    text of any length is read whole, its n-grams counted piece by piece. Of codewords of equal loss the language first
    in order is told, with score 0. Repeated rows are told the same; an empty table gives no rows. Columns of these
    names in the input are replaced; other columns, named by `keep` or all, pass unchanged.
    """
    keep = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score", "ambiguous", "text")]
    rows = docs.select(*keep, "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), _PREDICTED])
    return rows.mapInArrow(_predicted(model, ambiguous_below), schema)


def held_out(column: str, parts: int, which: int) -> F.Column:
    """Whether crc32 of a column as text leaves this remainder; false for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts == which, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the language of every document, learned without those whose crc32(doc_id) leaves 1 modulo 3."""
    docs = read(spark, sf_dir, "documents")
    rest = held_out("doc_id", 3, 1)
    out = identify(docs.withColumn("held_out", rest), train(docs, ~rest), keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
