"""Quality classification by co-training two views of a document.

The text view holds measures of the text's shape and the presence of chosen
words; the metadata view holds the other columns (source, language, length).
Each view has its own logistic regression. Over some rounds each classifier
labels the unlabelled documents that it is confident about, and these
pseudo-labels, at a lower weight, join the training rows of the other view.
The two final scores are combined by a calibrator fitted on labelled rows that
no view was trained on, and all documents are scored, whole. Every label
column has such a pair (a head) of its own.

Views are computed once for every document and written (about a hundred bytes
a document). All labelled and all unlabelled documents take part: Newton's
method for the text view and the calibrator adds up gradients and Hessians in
the tasks; the metadata view has META_CODES values at most, so counts by value
are all of its data. Only the choice of words reads a bounded sample: the
``labelled_rows`` labelled documents of the smallest id hash, in which Spark
counts the chi-square between presence and label; the ``text_words`` highest
(``least_chi2`` at least) are taken. Models have text_words + 10 and 65
weights at most, so what goes to the executors is bounded as well.

Defined cases: null and blank texts have no words; nulls in metadata are a
value of their own; a null doc_id is unlabelled; rows that repeat an id are
documents with the same label; of repeated labels of a document the mean
counts as 1 from 0.5 on, and null labels do not count; a head without labels
of both classes scores the share of positive labels (0.5 without any); an
empty table gives an empty result; other columns are not read, and a column
of docs named like a label is not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import written
from sparkloom.llm.wordhash import hash_words, raw

SHAPE = 9
SOURCES, LANGS, SIZES = 32, 12, 20
META_CODES, META_COLUMNS = SOURCES * LANGS * SIZES, SOURCES + LANGS + SIZES
#: Tasks that add up the sums of all others; the driver adds theirs.
ADDERS = 16


@dataclass(frozen=True)
class Head:
    """Weights of one label's views (the last is the intercept); the calibrated
    log-odds are cal[0] * text + cal[1] * meta + cal[2]. Words are 64-bit hashes."""

    label: str
    words: np.ndarray
    text: np.ndarray
    meta: np.ndarray
    cal: tuple[float, float, float]


# ---- features of an Arrow batch

_LETTER = np.full(256, 32, np.uint8)
_LETTER[128:] = np.arange(128, 256)
for _c in range(97, 123):
    _LETTER[_c] = _LETTER[_c - 32] = _c


def bare_words(texts) -> tuple:
    """Words of lower-cased letters only (bytes above 127 count as letters), with each one's text."""
    buf, off = raw(texts)
    arr = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(_LETTER[buf])])
    w = hash_words(arr.view(pa.large_string()), lower=False)
    return w, np.repeat(np.arange(len(off) - 1), np.diff(w.doc))


def distinct_words(w, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the distinct words of each text."""
    order = np.lexsort((w.hash, doc))
    h, d = w.hash[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[first], d[first]


def shape(texts, n_distinct: np.ndarray, n_bare: np.ndarray) -> np.ndarray:
    """Measures of each text, one row a text."""
    buf, off = raw(texts)
    n = np.diff(hash_words(texts).doc)

    def total(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask)))
        return c[off[1:]] - c[off[:-1]]

    count = lambda chars: total(np.isin(buf, np.frombuffer(chars, np.uint8)))
    chars = total((buf & 0xC0) != 0x80)
    after = np.concatenate((buf[1:], [0])) if len(buf) else buf
    upper = total(((buf >= 65) & (buf <= 90)) | ((buf == 0xC3) & (after >= 0x80) & (after <= 0x9E)))
    per = lambda x, y: x / np.maximum(y, 1)
    return np.stack([np.log1p(n), per(chars, n), per(n_distinct, n_bare), per(upper, chars), per(count(b"#*$%&<>"), n), per(count(b"|"), n), per(count(b"!"), n), per(count(b"\n"), n), (n == 0).astype(float)], axis=1)


def meta_codes(source: list, lang: list, n_chars: list) -> np.ndarray:
    """The metadata's value: hashed source and language, and the length's power of two."""
    part = lambda values, width: np.array([zlib.crc32(repr(v).encode()) % width for v in values], np.int32).reshape(-1)
    size = np.array([min(int(v).bit_length(), 18) if v is not None and v > 0 else 19 for v in n_chars], np.int32).reshape(-1)
    return (part(source, SOURCES) * LANGS + part(lang, LANGS)) * SIZES + size


def meta_matrix() -> np.ndarray:
    """The one-hot row of every metadata value."""
    code = np.arange(META_CODES)
    x = np.zeros((META_CODES, META_COLUMNS))
    x[code, code // (LANGS * SIZES)] = 1
    x[code, SOURCES + code // SIZES % LANGS] = 1
    x[code, SOURCES + LANGS + code % SIZES] = 1
    return x


def text_matrix(texts, heads_words: list[np.ndarray]) -> list[np.ndarray]:
    """For each list of (sorted) word hashes: shape measures and presence, a row a text."""
    w, doc = bare_words(texts)
    h, d = distinct_words(w, doc)
    n = len(texts)
    s = shape(texts, np.bincount(d, minlength=n), np.diff(w.doc))
    out = []
    for words in heads_words:
        x = np.zeros((n, SHAPE + len(words)))
        x[:, :SHAPE] = s
        if len(words) and len(h):
            at = np.minimum(np.searchsorted(words, h), len(words) - 1)
            hit = words[at] == h
            x[d[hit], SHAPE + at[hit]] = 1
        out.append(x)
    return out


# ---- fitting


def newton(b: np.ndarray, hessian: np.ndarray, gradient: np.ndarray, pen: np.ndarray) -> tuple[np.ndarray, float]:
    """The next weights of a ridge regression, and the largest step."""
    step = np.linalg.solve(hessian + np.diag(pen), gradient + pen * b)
    most = float(np.abs(step).max())
    return b - step * min(1.0, 10 / max(most, 1e-12)), most


def derivatives(z: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(z @ b, -35, 35)))
    v = np.maximum(w * p * (1 - p), 1e-9)
    return (z * v[:, None]).T @ z, z.T @ (w * (p - y))


def penalty(columns: int, strength: float) -> np.ndarray:
    return np.append(np.full(columns, strength), 1e-9)  # the intercept goes free


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float, times: np.ndarray | None = None, rounds: int = 25) -> np.ndarray:
    """Weights and intercept of a ridge logistic regression on columns
    standardised over the rows, each counted `times` times."""
    n = np.ones(len(x)) if times is None else times
    mean = n @ x / n.sum()
    sd = np.sqrt(n @ (x - mean) ** 2 / n.sum())
    inv = np.where(sd > 1e-9, 1 / np.where(sd > 1e-9, sd, 1), 0.0)
    z = np.hstack([(x - mean) * inv, np.ones((len(x), 1))])
    b, pen = np.zeros(z.shape[1]), penalty(x.shape[1], l2 * w.sum())
    for _ in range(rounds):
        b, most = newton(b, *derivatives(z, y, w, b), pen)
        if most < 1e-6:
            break
    return raw_weights(b, mean, inv)


def raw_weights(b: np.ndarray, mean: np.ndarray, inv: np.ndarray) -> np.ndarray:
    """Weights for columns as they are, from those for standardised columns."""
    out = b[:-1] * inv
    return np.append(out, b[-1] - out @ mean)


def logit(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.clip(x @ weights[:-1] + weights[-1], -35, 35)


# ---- Spark


def _rows(docs: DataFrame, text_col: str, *more: str) -> DataFrame:
    have = set(docs.columns)
    opt = lambda c, t: (F.col(c).cast(t) if c in have else F.lit(None).cast(t)).alias(f"_{c}")
    return docs.select("doc_id", F.coalesce(F.col(text_col), F.lit("")).alias("_text"), opt("source", "string"), opt("lang", "string"), opt("n_chars", "long"), *more)


def _words_by_label(sample: DataFrame, labels: list[str], text_words: int, least_chi2: float) -> list[np.ndarray]:
    """For each label, the hashes of the words that tell most about it (sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, d = distinct_words(*bare_words(b.column(0)))
            ys = [b.column(k + 1).take(pa.array(d)) for k in range(len(labels))]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *ys], names=["word", *labels])

    out = []
    seen = sample.select("_text", *labels).mapInArrow(run, "word long, " + ", ".join(f"{c} double" for c in labels))
    counts = written(seen.groupBy("word").agg(*[f(F.col(c)).alias(f"{k}_{c}") for c in labels for k, f in (("n", F.count), ("a", F.sum))]), "cotrain-words")
    for c in labels:
        n, pos = sample.agg(F.count(c), F.coalesce(F.sum(c), F.lit(0.0))).first()
        if not 0 < pos < n:
            out.append(np.zeros(0, np.uint64))
            continue
        a, m = F.coalesce(F.col(f"a_{c}"), F.lit(0.0)), F.col(f"n_{c}")
        chi2 = n * (a * n - m * pos) ** 2 / (m * (n - m) * pos * (n - pos))
        best = counts.where((m > 0) & (m < n)).select("word", chi2.alias("chi2")).where(F.col("chi2") >= least_chi2)
        top = best.orderBy(F.desc("chi2"), "word").limit(text_words).collect()
        out.append(np.sort(np.array([r["word"] for r in top], np.int64).view(np.uint64)))
    return out


@dataclass(frozen=True)
class Trained:
    """The heads, and the views of all documents they were trained on (to score without reading texts again)."""

    heads: list[Head]
    views: DataFrame


def views(docs: DataFrame, heads_words: list[np.ndarray], text_col: str = "text") -> DataFrame:
    """doc_id, shape (float32), meta (code) and, for each list of words, its bits of presence."""
    k = len(heads_words)
    names = ["doc_id", "shape", "meta", *[f"bits_{i}" for i in range(k)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        binary = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                b = big.slice(at, 1000)
                meta = meta_codes(*[b.column(c).to_pylist() for c in ("_source", "_lang", "_n_chars")])
                xs = text_matrix(b.column("_text"), heads_words or [np.zeros(0, np.uint64)])
                bits = [binary(np.packbits(x[:, SHAPE:] > 0, axis=1)) for x in xs[:k]]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), binary(xs[0][:, :SHAPE].astype(np.float32)), pa.array(meta), *bits], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _rows(docs, text_col).mapInArrow(run, f"doc_id {kind}, shape binary, meta int" + "".join(f", {n} binary" for n in names[3:]))


def _text_view(b: pa.RecordBatch, i: int, n_words: int) -> np.ndarray:
    n = b.num_rows
    plain = lambda c, t: np.frombuffer(b"".join(b.column(c).to_pylist()), t).reshape(n, -1)
    x = np.zeros((n, SHAPE + n_words))
    if n:
        x[:, :SHAPE] = plain("shape", np.float32)
    if n and n_words:
        x[:, SHAPE:] = np.unpackbits(plain(f"bits_{i}", np.uint8), axis=1)[:, :n_words]
    return x


def _sums(rows: DataFrame, compute: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The vectors that compute gives for batches, added up over all rows: in
    every task, then in ADDERS tasks, then here. None without rows."""

    def add(values: Iterator[np.ndarray]) -> np.ndarray | None:
        total = None
        for v in values:
            total = v.copy() if total is None else np.add(total, v, out=total)
        return total

    def give(part: int, total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "v"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (b.slice(k, 4000) for b in batches for k in range(0, b.num_rows, 4000))
        yield from give(TaskContext.get().partitionId(), add(compute(b) for b in pieces))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from give(TaskContext.get().partitionId(), add(np.frombuffer(v.as_py()) for b in batches for v in b.column(1)))

    parts = rows.mapInArrow(first, "part int, v binary").repartition(ADDERS).sortWithinPartitions("part").mapInArrow(second, "part int, v binary").collect()
    return add(np.frombuffer(r["v"]) for r in sorted(parts, key=lambda r: r["part"]))


def _cut(v: np.ndarray, *sizes: int) -> list[np.ndarray]:
    return np.split(v, np.cumsum(sizes)[:-1])


def _fit(rows: DataFrame, of: Callable[[pa.RecordBatch, int], tuple], start: dict[int, np.ndarray], l2: float, rounds: int = 15) -> dict[int, np.ndarray]:
    """Newton's method for several regressions at once. of(batch, i) gives (z with intercept, y, w) of regression i."""
    b, open_ = dict(start), sorted(start)
    for _ in range(rounds):
        if not open_:
            break
        now, todo = dict(b), tuple(open_)

        def compute(batch: pa.RecordBatch, now=now, todo=todo) -> np.ndarray:
            out = []
            for i in todo:
                z, y, w = of(batch, i)
                h, g = derivatives(z, y, w, now[i])
                out += [h.ravel(), g, [w.sum()]]
            return np.concatenate(out)

        total = _sums(rows, compute)
        at = 0
        for i in todo:
            d = len(b[i])
            h, g, w = _cut(total[at : at + d * d + d + 1], d * d, d, 1)
            at += d * d + d + 1
            b[i], most = newton(b[i], h.reshape(d, d), g, penalty(d - 1, l2 * w[0]))
            if most < 1e-4:
                open_.remove(i)
    return b


def fit_heads(rows: DataFrame, label_cols: tuple[str, ...], words: list[np.ndarray], rounds: int, confident: float, pseudo_weight: float, l2: float = 1e-3) -> list[Head]:
    """Co-training over written views with y_<i> (null where unlabelled) and fold (0 is held out for the calibrator)."""
    ks = range(len(label_cols))
    n_words = [len(w) for w in words]
    d = [SHAPE + n for n in n_words]

    def labels(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
        return b.column(f"y_{i}").to_numpy(zero_copy_only=False).astype(float), b.column("fold").to_numpy()

    def overview(b: pa.RecordBatch) -> np.ndarray:
        out = [[b.num_rows]]
        for i in ks:
            x, (y, fold) = _text_view(b, i, n_words[i]), labels(b, i)
            own, tr = ~np.isnan(y), fold != 0
            out += [x.sum(axis=0), (x * x).sum(axis=0), [m.sum() for m in (own, y[own], own & tr, y[own & tr], own & ~tr, y[own & ~tr])]]
        return np.concatenate(out).astype(float)

    seen = _sums(rows, overview)
    if seen is None:
        return [Head(c, w, np.zeros(SHAPE + len(w) + 1), np.zeros(META_COLUMNS + 1), (0.0, 0.0, 0.0)) for c, w in zip(label_cols, words, strict=True)]
    total, *rest = _cut(seen, 1, *[x for k in d for x in (k, k, 6)])
    mean = [rest[3 * i] / total for i in ks]
    sd = [np.sqrt(np.maximum(rest[3 * i + 1] / total - mean[i] ** 2, 0)) for i in ks]
    inv = [np.where(s > 1e-6, 1 / np.where(s > 1e-6, s, 1), 0.0) for s in sd]
    tally = [rest[3 * i + 2] for i in ks]
    ready = [i for i in ks if 0 < tally[i][3] < tally[i][2]]
    bound = float(np.log(confident / (1 - confident)))
    onehot = meta_matrix()
    text: dict[int, np.ndarray] = {i: np.zeros(d[i] + 1) for i in ready}  # for standardised columns
    meta: dict[int, np.ndarray] = {}

    for r in range(rounds + 1 if ready else 0):
        told = {i: logit(onehot, meta[i]) for i in meta}  # of the round before
        taught = {i: raw_weights(text[i], mean[i], inv[i]) for i in meta}

        def text_rows(b: pa.RecordBatch, i: int, told=told) -> tuple:
            y, fold = labels(b, i)
            own = ~np.isnan(y) & (fold != 0)
            w, t = own.astype(float), np.where(own, y, 0.0)
            if i in told:  # what the other view is sure of
                s = told[i][b.column("meta").to_numpy()]
                sure = np.isnan(y) & (np.abs(s) >= bound)
                w[sure], t[sure] = pseudo_weight, s[sure] > 0
            use = w > 0
            x = _text_view(b.filter(pa.array(use)), i, n_words[i])
            return np.hstack([(x - mean[i]) * inv[i], np.ones((len(x), 1))]), t[use], w[use]

        def meta_counts(b: pa.RecordBatch, taught=taught) -> np.ndarray:
            out, code = [], b.column("meta").to_numpy()
            for i in ready:
                y, fold = labels(b, i)
                own, t = ~np.isnan(y) & (fold != 0), np.nan_to_num(y)
                groups = [own & (t > 0), own & (t == 0)]
                if i in taught:
                    s = logit(_text_view(b, i, n_words[i]), taught[i])
                    groups += [np.isnan(y) & (s >= bound), np.isnan(y) & (s <= -bound)]
                else:
                    groups += [np.zeros(len(y), bool)] * 2
                out += [np.bincount(code[g], minlength=META_CODES) for g in groups]
            return np.concatenate(out).astype(float)

        counts = _sums(rows, meta_counts).reshape(len(ready), 4, META_CODES)
        labelled = rows if told else rows.where(" or ".join(f"y_{i} is not null" for i in ready))
        text = _fit(labelled, text_rows, text, l2)
        for i, (pos, neg, more, less) in zip(ready, counts, strict=True):
            n = np.concatenate([pos + more, neg + less])
            w = np.concatenate([pos + pseudo_weight * more, neg + pseudo_weight * less])
            y = np.repeat([1.0, 0.0], META_CODES)
            meta[i] = logistic(np.vstack([onehot, onehot])[n > 0], y[n > 0], w[n > 0], l2, n[n > 0])

    weights = {i: raw_weights(text[i], mean[i], inv[i]) for i in ready}
    told = {i: logit(onehot, meta[i]) for i in ready}

    def pairs(b: pa.RecordBatch, i: int) -> tuple:
        y, fold = labels(b, i)
        use = ~np.isnan(y) & (fold == 0)
        part = b.filter(pa.array(use))
        z = np.stack([logit(_text_view(part, i, n_words[i]), weights[i]), told[i][part.column("meta").to_numpy()], np.ones(use.sum())], axis=1)
        return z, y[use], np.ones(use.sum())

    held = [i for i in ready if 0 < tally[i][5] < tally[i][4]]
    cal = _fit(rows.where("fold = 0"), pairs, {i: np.array([0.5, 0.5, 0.0]) for i in held}, 1e-4)
    out = []
    for i in ks:
        share = min(max(float(tally[i][1] / tally[i][0]) if tally[i][0] else 0.5, 1e-6), 1 - 1e-6)
        if i not in ready:
            out.append(Head(label_cols[i], words[i], np.zeros(d[i] + 1), np.zeros(META_COLUMNS + 1), (0.0, 0.0, float(np.log(share / (1 - share))))))
        else:
            c = cal.get(i, (0.5, 0.5, 0.0))
            out.append(Head(label_cols[i], words[i], weights[i], meta[i], (float(c[0]), float(c[1]), float(c[2]))))
    return out


def train(
    docs: DataFrame, labels: DataFrame, label_cols: tuple[str, ...] = ("quality", "toxic"), text_col: str = "text", labelled_rows: int = 12_000,
    rounds: int = 2, confident: float = 0.95, pseudo_weight: float = 0.3, text_words: int = 256, least_chi2: float = 25.0,
) -> Trained:
    ys = [f"y_{i}" for i in range(len(label_cols))]
    mean = [F.avg(F.col(c).cast("double")) for c in label_cols]
    mean = [F.when(m >= 0.5, 1.0).when(m < 0.5, 0.0).alias(y) for m, y in zip(mean, ys, strict=True)]
    per_doc = written(labels.where("doc_id is not null").groupBy("doc_id").agg(*mean), "cotrain-labels").withColumnRenamed("doc_id", "_labelled")
    chosen = per_doc.join(docs.select("doc_id").distinct(), F.col("_labelled") == F.col("doc_id"), "left_semi").orderBy(F.xxhash64(F.lit(3), "_labelled"), "_labelled").limit(labelled_rows)
    # labelled_rows rows at most
    sample = written(_rows(docs, text_col).join(F.broadcast(written(chosen, "cotrain-ids")), F.col("doc_id") == F.col("_labelled")), "cotrain-sample")
    words = _words_by_label(sample, ys, text_words, least_chi2)
    seen = written(views(docs, words, text_col), "cotrain-views")
    known = seen.join(per_doc, F.col("doc_id") == F.col("_labelled"), "left").drop("_labelled")
    known = known.withColumn("fold", F.coalesce(F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(5)), F.lit(1)).cast("int"))
    known = written(known.select("shape", "meta", *[f"bits_{i}" for i in range(len(words))], *ys, "fold"), "cotrain-rows")
    return Trained(fit_heads(known, label_cols, words, rounds, confident, pseudo_weight), seen)


def score_views(seen: DataFrame, heads: list[Head]) -> DataFrame:
    """doc_id and, for each head, p_<label>, text_<label> and meta_<label> (calibrated and single views' probabilities)."""
    names = [f"{k}_{h.label}" for h in heads for k in ("p", "text", "meta")]
    sigmoid = lambda x: pa.array(1 / (1 + np.exp(-x)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = [logit(meta_matrix(), h.meta) for h in heads]
        for big in batches:
            for k in range(0, big.num_rows, 4000):
                b = big.slice(k, 4000)
                cols = []
                for i, h in enumerate(heads):
                    lt, lm = logit(_text_view(b, i, len(h.words)), h.text), told[i][b.column("meta").to_numpy()]
                    cols += [sigmoid(np.clip(h.cal[0] * lt + h.cal[1] * lm + h.cal[2], -35, 35)), sigmoid(lt), sigmoid(lm)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", *names])

    return seen.mapInArrow(run, f"doc_id {seen.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names))


def score(docs: DataFrame, heads: list[Head], text_col: str = "text") -> DataFrame:
    """score_views of any documents."""
    return score_views(views(docs, [h.words for h in heads], text_col), heads)
