"""Quality classifier by co-training.

Two logistic regressions see different views of a document: its text (words, endings, repetition and
layout), and the metadata of its page (language, source and length as the table gives them, nothing
read from the text). Over some rounds each scores all unlabelled documents, and the ones that it is
most sure about are labelled for the other to learn from. Both are then calibrated on labelled
documents that neither has learnt from, and a last regression combines the calibrated views.

Both views of every document are computed once and kept as narrow features in the shared folder;
rounds and scores read these. Only labelled rows that are learnt from (a stated bound) and the
rounds' picks come to the driver. The models are a few hundred kilobytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, pieces, release_memory, scratch

WIDTH = 1 << 16  # hashed features of the text view
META, LENGTHS = 64, 24  # hashed features of the metadata view, and classes of length after them
#: Bound of the labelled documents that are learnt from, chosen by the hash of their ids.
MAX_LABELLED = 4_000
#: Rounds; documents that a view labels in a round for the other, at most, of either class; how sure it must be.
ROUNDS, PER_ROUND, SURE, HELD_OUT = 3, 300, 0.9, 0.25
SEEN = 300_000  # remembered words of a partition; it only saves work


class _Hashed(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > SEEN:
            self.clear()
        self[word] = h = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) % WIDTH
        return h


def layout(text: str) -> list[str]:
    """Classes of a text's shares of capitals, digits, symbols and spaces, of repeated lines, and of its lines' length."""
    n = max(1, len(text))
    seen = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=128)[:128]
    symbols = seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum()
    lines = text.split("\n")
    shares = {"upper": seen[65:91].sum() / n, "digit": seen[48:58].sum() / n, "symbol": symbols / n, "space": (seen[9:14].sum() + seen[32]) / n, "again": 1 - len(set(lines)) / len(lines)}
    return [*(f"\n{k}{int(min(0.99, x) * 25)}" for k, x in shares.items()), f"\nline{int(np.log2(1 + n / len(lines)))}"]


def text_view(text: str | None, hashed: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, word endings, repetitions and layout of a whole text, with shares of all words (square roots) as values."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.uint16), np.zeros(0, np.float16)
    find = hashed.__getitem__
    at = np.fromiter(map(find, words), np.int32, len(words))
    ends = np.fromiter(map(find, ["\n" + w[-2:] for w in words]), np.int32, len(words))
    again = np.full(int((at[1:] == at[:-1]).sum()), find("\nsame"), np.int32)  # words that repeat the one before
    old = np.full(len(at) - len(np.unique(at)), find("\nseen"), np.int32)  # words that occurred before
    index, count = np.unique(np.concatenate((at, ends, again, old)), return_counts=True)
    form = np.array(sorted({find(x) for x in layout(text)}), np.int32)
    new = form[~np.isin(form, index)]
    value = np.concatenate((np.sqrt(count / len(words)), np.full(len(new), 0.2)))
    return np.concatenate((index, new)).astype(np.uint16), (value / np.sqrt((value * value).sum())).astype(np.float16)


def meta_view(lang: str | None, source: str | None, length: int | None) -> np.ndarray:
    """Places of language, source and length class among the metadata's features; null is a value of its own."""
    named = [xxhash.xxh32_intdigest(f"{k}={v}".encode("utf-8", "surrogatepass")) % META for k, v in (("lang", lang), ("source", source))]
    return np.array([*named, META + (LENGTHS - 1 if length is None else min(LENGTHS - 2, int(max(0, length)).bit_length()))], np.uint16)


class Sparse:
    """Rows of (index, value) pairs."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.width = width
        self.count = np.array([len(i) for i, _ in rows], np.int64)
        self.index = np.concatenate([*(i for i, _ in rows), np.zeros(0, np.uint16)])
        self.value = np.concatenate([*(v for _, v in rows), np.zeros(0, np.float16)]).astype(np.float64)
        self.row = np.repeat(np.arange(len(rows)), self.count)

    def __len__(self) -> int:
        return len(self.count)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.index], minlength=len(self))

    def tdot(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, self.value * g[self.row], minlength=self.width)


class Dense:
    def __init__(self, rows: np.ndarray):
        self.rows = rows.astype(np.float64)
        self.width = rows.shape[1]

    def __len__(self) -> int:
        return len(self.rows)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.rows @ w

    def tdot(self, g: np.ndarray) -> np.ndarray:
        return self.rows.T @ g


def view(number: int, rows: list) -> Sparse:
    """The rows (text index, text value, meta places) as one view sees them: 0 the text, 1 the metadata."""
    if number == 0:
        return Sparse([(i, v) for i, v, _ in rows], WIDTH)
    return Sparse([(m, np.full(len(m), 1.0)) for _, _, m in rows], META + LENGTHS)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x, y: np.ndarray, weight: np.ndarray, steps: int = 120, penalty: float = 1e-4) -> np.ndarray:
    """Weights and a bias (last) of a logistic regression, by full-batch AdaGrad; classes weigh as they occur."""
    w = np.zeros(x.width + 1)
    square = np.full(x.width + 1, 1e-8)
    weight = weight / weight.sum()
    for _ in range(steps):
        g = (sigmoid(x.dot(w[:-1]) + w[-1]) - y) * weight
        grad = np.append(x.tdot(g) + penalty * w[:-1], g.sum())
        square += grad * grad
        w -= 0.5 * grad / np.sqrt(square)
    return w


def fit_platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) such that sigmoid(a z + b) is calibrated, with smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        g = np.array([((p - target) * z).sum(), (p - target).sum()])
        h = p * (1 - p) + 1e-9
        m = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


@dataclass
class Model:
    """Both views' weights, their calibrations and the last regression; ``prior`` alone where nothing could be learnt."""

    prior: float
    views: list[np.ndarray] = field(default_factory=list)
    platt: list[tuple[float, float]] = field(default_factory=list)
    mix: np.ndarray | None = None

    def scores(self, rows: list) -> np.ndarray:
        """Columns: calibrated probability of the text view, of the metadata view, and of both."""
        if not self.views:
            return np.full((len(rows), 3), self.prior)
        t, m = (a * raw(view(v, rows), self.views[v]) + b for v, (a, b) in enumerate(self.platt))
        return sigmoid(np.stack([t, m, self.mix[0] * t + self.mix[1] * m + self.mix[2]], axis=1))


def raw(x, w: np.ndarray) -> np.ndarray:
    return x.dot(w[:-1]) + w[-1]


#: What a round asks for: given both views' weights and the ids that each view has been taught, new documents as
#: (view that is sure, id, label, row), the surest of each view and class.
Offer = Callable[[list[np.ndarray], list[set]], list[tuple[int, str, int, tuple]]]


def cotrain(ids: list[str], rows: list, y: np.ndarray, offer: Offer, *, rounds: int = ROUNDS) -> Model:
    """Fit a model from labelled rows (in random order) and what each view offers the other."""
    if not len(y) or y.min() == y.max() or min((y > 0).sum(), (y <= 0).sum()) < 4:
        return Model(prior=float(y.mean()) if len(y) else 0.5)
    held = np.zeros(len(y), bool)
    for c in (0, 1):  # of either class the same share is held out
        own = np.flatnonzero((y > 0) == c)
        held[own[: max(1, int(len(own) * HELD_OUT))]] = True
    taught = [{ids[k]: (float(y[k]), 1.0, rows[k]) for k in np.flatnonzero(~held).tolist()} for _ in range(2)]
    fitted: list[np.ndarray] = [np.zeros(0)] * 2
    for r in range(rounds + 1):
        for v in range(2):
            target, weight, own = zip(*taught[v].values(), strict=True)
            fitted[v] = fit_logistic(view(v, own), np.array(target), np.array(weight))
        new = offer(fitted, [set(t) for t in taught]) if r < rounds else []
        for v, name, label, row in new:
            taught[1 - v].setdefault(name, (float(label), 0.5, row))
        if not new:
            break
    out = [rows[k] for k in np.flatnonzero(held).tolist()]
    zs = [raw(view(v, out), fitted[v]) for v in range(2)]
    platt = [fit_platt(z, y[held]) for z in zs]
    views = Dense(np.stack([a * z + b for z, (a, b) in zip(zs, platt, strict=True)], axis=1))
    mix = fit_logistic(views, y[held].astype(float), np.ones(len(out)), steps=300, penalty=1e-2)
    return Model(float(y.mean()), fitted, platt, mix)


def surest(names: list, rows: list, fitted: list[np.ndarray], known: list[set], per_round: int, sure: float) -> list[tuple[int, int, float, str]]:
    """Of some documents the surest of each view and class, but none that the other view was taught: (view, label, doubt, id)."""
    out = []
    for v in range(2):
        p = sigmoid(raw(view(v, rows), fitted[v]))
        fresh_to = np.array([n not in known[1 - v] for n in names], bool)
        for label, doubt in ((0, p), (1, 1 - p)):
            found = np.flatnonzero((doubt < 1 - sure) & fresh_to)
            best = sorted((float(doubt[k]), names[k]) for k in found)[:per_round]
            out += [(v, label, d, n) for d, n in best]
    return out


FEATURES = ("index", "value", "meta")


def _rows(batch: pa.RecordBatch, first: int) -> list:
    kinds = (np.uint16, np.float16, np.uint16)
    return list(zip(*([np.frombuffer(x.as_buffer(), k) for x in batch.column(first + c)] for c, k in enumerate(kinds)), strict=True))


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", length_col: str = "n_chars", carry: list[str] | None = None) -> DataFrame:
    """Both views of every document, landed in the shared folder: the carried columns, ``id`` (string) and the views as
    binary ``index``, ``value`` and ``meta``, under names that clash with no carried one (the last four columns)."""
    keep = [c for c in docs.columns if carry is None or c in carry]
    names = fresh(keep, "id", *FEATURES)
    length = F.col(length_col).cast("long") if length_col in docs.columns else F.lit(None).cast("long")
    read = [F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.col(lang_col).cast("string"), F.col(source_col).cast("string"), length]
    given = docs.select(*[F.col(f"`{c}`") for c in keep], *(c.alias(n) for c, n in zip(read, fresh(keep, "in_id", "in_text", "in_lang", "in_source", "in_length"), strict=True)))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(None).cast("string").alias(names[0]), *(F.lit(b"").alias(n) for n in names[1:])).schema
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _Hashed()
        for whole in batches:
            for batch in pieces(whole, k + 1):
                text, lang, source, size = (batch.column(k + c) for c in (1, 2, 3, 4))
                texts = [text_view(t.as_py(), hashed) for t in text]
                metas = [meta_view(*x).tobytes() for x in zip(lang.to_pylist(), source.to_pylist(), size.to_pylist(), strict=True)]
                views = [pa.array([i.tobytes() for i, _ in texts], pa.binary()), pa.array([v.tobytes() for _, v in texts], pa.binary()), pa.array(metas, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in range(k + 1)] + views, names=[*keep, *names])
            release_memory()

    target = scratch(docs.sparkSession, "views")
    given.mapInArrow(run, schema).write.parquet(target)
    return docs.sparkSession.read.parquet(target)


def offers(seen: DataFrame, fitted: list[np.ndarray], known: list[set], *, per_round: int = PER_ROUND, sure: float = SURE) -> list[tuple[int, str, int, tuple]]:
    """One round over all unlabelled documents in ``seen`` (id, index, value, meta): what each view is surest about.

    Every partition gives its own surest, ids and numbers only; their surest ``per_round`` of each view and class are
    fetched with their features. Equal doubts go by id; of rows that repeat an id one counts.
    """
    weights = [w.astype(np.float32) for w in fitted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = surest(batch.column(0).to_pylist(), _rows(batch, 1), weights, known, per_round, sure)
            columns = list(zip(*found, strict=True)) or [()] * 4
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["view", "label", "doubt", "id"])

    each = cut(seen.mapInArrow(run, "view int, label int, doubt double, id string").groupBy("view", "label", "id").agg(F.min("doubt").alias("doubt")))
    picked = [r for v in (0, 1) for c in (0, 1) for r in each.filter((F.col("view") == v) & (F.col("label") == c)).orderBy("doubt", "id").limit(per_round).collect()]
    if not picked:
        return []
    wanted = seen.sparkSession.createDataFrame([(n,) for n in sorted({r["id"] for r in picked})], "wanted string")
    held: dict[str, tuple] = {}
    for r in sorted(seen.join(F.broadcast(wanted), F.col("id") == F.col("wanted"), "left_semi").collect(), key=lambda r: tuple(bytes(r[c]) for c in FEATURES)):
        held.setdefault(r["id"], _row(r))
    return [(r["view"], r["id"], r["label"], held[r["id"]]) for r in picked]


def _row(r) -> tuple:
    return np.frombuffer(r["index"], np.uint16), np.frombuffer(r["value"], np.float16), np.frombuffer(r["meta"], np.uint16)


def fit_features(viewed: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", max_labelled: int = MAX_LABELLED, per_round: int = PER_ROUND) -> Model:
    """``fit`` on the result of ``features``."""
    names = viewed.columns[-4:]
    seen = viewed.select(*(F.col(f"`{n}`").alias(c) for n, c in zip(names, ("id", *FEATURES), strict=True))).filter("id is not null")
    given = labels.select(F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    given = given.groupBy("id").agg(F.max("label").alias("label"))
    found = given.join(seen.select("id").distinct(), "id", "left_semi")
    # Bounded, so it may be broadcast and its features collected.
    chosen = cut(found.orderBy(F.md5(F.col("id").cast("binary")), "id").limit(max_labelled).withColumnRenamed("id", "of"))
    got = seen.join(F.broadcast(chosen), F.col("id") == F.col("of")).collect()
    once = {}
    for r in sorted(got, key=lambda r: (xxhash.xxh64_hexdigest(r["id"].encode()), r["id"], *(bytes(r[c]) for c in FEATURES))):
        once.setdefault(r["id"], r)  # a repeated id is one labelled document
    y = np.array([1 if r["label"] > 0 else 0 for r in once.values()])
    rest = seen.join(F.broadcast(chosen), F.col("id") == F.col("of"), "left_anti")
    return cotrain(list(once), [_row(r) for r in once.values()], y, lambda fitted, known: offers(rest, fitted, known, per_round=per_round))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", max_labelled: int = MAX_LABELLED, per_round: int = PER_ROUND, **columns) -> Model:
    """Fit on at most ``max_labelled`` labelled documents, those with the least md5 of their ids, and on all others as unlabelled ones.

    Of several labels of a document the greatest counts; null labels and ids do not. Labels without a document do
    not count either. Documents without an id are neither. ``columns``: the other columns' names, as of ``features``.
    """
    return fit_features(features(docs, id_col=id_col, carry=[], **columns), labels, id_col=id_col, label_col=label_col, max_labelled=max_labelled, per_round=per_round)


OWN = ("text_score", "meta_score", "score", "kept")


def _score(viewed: DataFrame, model: Model) -> DataFrame:
    keep = [c for c in viewed.columns[:-4] if c.lower() not in OWN]
    schema = viewed.select(*[F.col(f"`{c}`") for c in keep], *(F.lit(0.0).alias(c) for c in OWN[:3]), F.lit(True).alias("kept")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = model.scores(_rows(batch, len(keep)))
            columns = [pa.array(out[:, k]) for k in range(3)] + [pa.array(out[:, 2] >= 0.5)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in range(len(keep))] + columns, names=[*keep, *OWN])

    return viewed.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{c}`") for c in viewed.columns[-3:]]).mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, *, carry: list[str] | None = None, **columns) -> DataFrame:
    """Every document with ``text_score`` and ``meta_score`` (calibrated probabilities of either view), ``score`` and ``kept``.

    ``kept``: score of 0.5 or more. A model that could not learn gives its prior everywhere. Columns of these names are
    replaced; ``carry`` names the columns to keep (default: all). Null texts are scored as empty text; null languages,
    sources and lengths, and a missing column of lengths, as values of their own. Repeated rows are separate documents.
    Empty table: no rows. ``columns``: the other columns' names, as of ``features``.
    """
    return _score(features(docs, carry=[c for c in docs.columns if carry is None or c in carry], **columns), model)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", carry: list[str] | None = None, **columns) -> DataFrame:
    """``fit`` and ``score`` over the same documents, whose texts are read once."""
    viewed = features(docs, id_col=id_col, carry=carry, **columns)
    return _score(viewed, fit_features(viewed, labels, id_col=id_col, label_col=label_col))
