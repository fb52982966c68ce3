"""Quality classifier by co-training of two views of a document.

Text view: which (hashed) words occur.  Metadata view: language, source, length and layout of the
page (shares of symbols, capitals, digits and repeated lines, words per line, word length), but no
words.  Each view has a logistic classifier of its own.  Over ``ROUNDS`` rounds each labels those
unlabelled rows of the whole table that it is most sure of, in the proportion of the training rows,
and hands them to the other one's training rows.  At the end both views are calibrated on labelled
rows held out, and a third logistic fit on those rows combines the calibrated views.  The combination
scores every document of the table.  ``quality`` and ``toxic`` are two such classifiers.

The fit takes a bounded sample of the labels, for each target and class by a hash of doc_id: about
``MAX_LABELLED`` rows for a target, all rows of the rarer class up to half of that.  Calibration
weighs the held-out rows back to the proportions of all labels.  In each round Spark scores every unlabelled row; only the
surest rows of each class, ``PER_ROUND`` of the training rows, go to the driver.  Feature numbers, not
texts, go there, packed in 16 bits; they are computed once, in a pass without a shuffle, and kept in
a shared table.  Scoring is one pass over all whole texts without a shuffle.  Results do not depend
on the partitioning.

Edge cases: null texts count as empty, null languages and sources as values of their own; rows with
a null label or doc_id do not train; of repeated labels the worse one holds (lower quality, higher
toxicity); of documents with the same doc_id the one with the fewest words trains; with fewer than
``LEAST`` labels of a class all documents get the labels' mean (0.5 without any); repeated documents
score alike; an empty table gives no rows; result columns must have new names, other columns pass
through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabfid.llm.common import fresh, shared_table

MAX_LABELLED = 12_000
ROUNDS, PER_ROUND, SURE, PSEUDO_WEIGHT = 3, 0.1, 0.9, 0.5
LEAST = 8
TEXT_DIM, META_DIM = 2**16, 2**10
STEPS, RATE, RIDGE, CLEAR = 80, 0.5, 2e-5, 2.0

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>!@^~=+_{}[]\\/", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_SHARES = np.array([0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4])


def text_features(text: str | None) -> np.ndarray:
    """Sorted numbers of the words that occur, without case and outer punctuation."""
    w = {x.strip(b".,;:!?\"'()[]") for x in text.encode("utf-8", "replace").translate(_LOWER).split()} if text else set()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x) % TEXT_DIM for x in w), np.int32, len(w)))


def meta_features(text: str | None, lang: str | None, source: str | None) -> np.ndarray:
    """Numbers of the metadata's values and bins."""
    raw = (text or "").encode("utf-8", "replace")
    n = max(len(raw), 1)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    words = max(len(raw.split()), 1)

    def share(x: float) -> int:
        return int(np.searchsorted(_SHARES, x))

    bins = [int(np.log2(n)), share(hist[_SYMBOLS].sum() / n), share(hist[_UPPER].sum() / n), share(hist[_DIGIT].sum() / n),
            share(1 - len(set(lines)) / max(len(lines), 1)), int(np.log2(words / max(len(lines), 1) + 1)),
            min(int(2 * (n - hist[_SPACE].sum()) / words), 30)]
    return np.array([xxhash.xxh32_intdigest(f"lang={lang}") % 64, 64 + xxhash.xxh32_intdigest(f"source={source}") % 512,
                     *(576 + 32 * k + min(b, 31) for k, b in enumerate(bins))], np.int32)


class Rows:
    """Sparse binary rows, worked on in blocks of about ``BLOCK`` entries."""

    BLOCK = 2**20

    def __init__(self, lists: list[np.ndarray]):
        self._set(np.array([len(x) for x in lists], np.int64),
                  np.concatenate(lists).astype(np.int32) if lists else np.empty(0, np.int32))

    def _set(self, sizes: np.ndarray, cols: np.ndarray) -> None:
        self.sizes, self.cols = sizes, cols
        ends = np.concatenate([[0], np.cumsum(sizes)])
        cut = np.unique(np.concatenate([np.searchsorted(ends, np.arange(0, ends[-1], self.BLOCK)), [len(sizes)]]))
        self.blocks = [(i, j, ends[i], ends[j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]

    def only(self, wanted: np.ndarray) -> Rows:
        """The same rows with the wanted columns alone."""
        stay = wanted[self.cols]
        out = Rows.__new__(Rows)
        out._set(np.diff(np.concatenate([[0], np.cumsum(stay)])[np.concatenate([[0], np.cumsum(self.sizes)])]), self.cols[stay])
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.sizes))
        for i, j, a, b in self.blocks:
            at = np.repeat(np.arange(j - i), self.sizes[i:j])
            out[i:j] = np.bincount(at, weights=w[self.cols[a:b]], minlength=j - i)
        return out

    def sums(self, values: np.ndarray, dim: int) -> np.ndarray:
        """For each column the sum of the values of its rows."""
        out = np.zeros(dim)
        for i, j, a, b in self.blocks:
            out += np.bincount(self.cols[a:b], weights=np.repeat(values[i:j], self.sizes[i:j]), minlength=dim)
        return out


def fit(rows: Rows, y: np.ndarray, weight: np.ndarray, dim: int) -> tuple[np.ndarray, float]:
    """Logistic weights and intercept.  A feature is scaled by what its log-odds between the classes
    have above ``CLEAR`` standard errors, so most rare words are left out."""
    pos = rows.sums(weight * y, dim) + 0.5
    neg = rows.sums(weight * (1 - y), dim) + 0.5
    a, b = (weight * y).sum() + 1, (weight * (1 - y)).sum() + 1
    scale = np.log((pos / a) / (neg / b))
    scale = np.sign(scale) * np.maximum(np.abs(scale) - CLEAR * np.sqrt(1 / pos + 1 / neg), 0)
    rows = rows.only(scale != 0)  # the others' weights stay 0
    w, c = np.zeros(dim), float(np.log(a / b))
    gw, gc = np.full(dim, 1e-8), 1e-8
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(rows.dot(w * scale) + c, -30, 30)))
        r = weight * (p - y)
        g = rows.sums(r, dim) * scale + RIDGE * weight.sum() * w
        gw += g * g
        gc += r.sum() ** 2
        w -= RATE * g / np.sqrt(gw)
        c -= RATE * r.sum() / np.sqrt(gc)
    return w * scale, c


def calibrate(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of each column of ``logits`` and an intercept: ridge logistic fit by Newton steps."""
    x = np.column_stack([logits, np.ones(len(y))])
    n1, n0 = weight[y > 0].sum(), weight[y == 0].sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))  # Platt's targets
    b = np.zeros(x.shape[1])
    ridge = np.diag([1e-2] * (x.shape[1] - 1) + [1e-6])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x + ridge
        b = b - np.linalg.solve(h, x.T @ (weight * (p - target)) + ridge @ b)
    return b


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights of both views, their calibrations and the combination; or a constant."""

    views: list[tuple[np.ndarray, float]]
    scales: list[np.ndarray]
    both: np.ndarray
    constant: float | None = None

    def score(self, features: list[Rows]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(features[0].sizes), self.constant)
        z = [s[0] * (r.dot(w) + c) + s[1] for r, (w, c), s in zip(features, self.views, self.scales, strict=True)]
        return _sigmoid(np.column_stack(z) @ self.both[:2] + self.both[2])


@dataclass
class Want:
    """Up to ``n`` free rows that a view is at least so sure to be of the class ``label``."""

    view: int
    label: int
    least: float
    n: int


class Training:
    """Co-training for one target.  ``labelled``: for each view the rows' feature numbers; ``counts``: labels of
    the classes 0 and 1 from which they are a sample, each class by its own share."""

    def __init__(self, labelled: list[list[np.ndarray]], y: np.ndarray, counts: tuple[int, int] | None = None):
        self.labelled, self.y = labelled, y
        n = np.array([(y == 0).sum(), (y == 1).sum()])
        counts = n if counts is None else np.array(counts)
        self.constant = None
        if min(n) < LEAST:
            self.constant = float(counts[1] / counts.sum()) if counts.sum() else 0.5
            return
        self.shares = counts / counts.sum()
        self.held = np.zeros(len(y), bool)
        for v in (0, 1):  # every fourth row of each class
            self.held[np.flatnonzero(y == v)[::4]] = True
        self.train = np.flatnonzero(~self.held)
        # held rows stand for all labels of their class; the class sampled least counts once
        self.stands = ((counts / n) / min(counts / n))[y[self.held]]
        self.calib = [Rows([view[i] for i in np.flatnonzero(self.held)]) for view in labelled]
        # for each view: row -> (its feature numbers, the label given by the other view)
        self.extra: list[dict[object, tuple[np.ndarray, int]]] = [{}, {}]

    def fit(self) -> None:
        self.views, self.scales = [], []
        for v, dim in enumerate((TEXT_DIM, META_DIM)):
            own = [x for _, x in sorted(self.extra[v].items())]
            x = Rows([self.labelled[v][i] for i in self.train] + [f for f, _ in own])
            t = np.concatenate([self.y[self.train], [k for _, k in own]]).astype(float)
            weight = np.concatenate([np.ones(len(self.train)), np.full(len(own), PSEUDO_WEIGHT)])
            w, c = fit(x, t, weight, dim)
            self.views.append((w, c))
            self.scales.append(calibrate((self.calib[v].dot(w) + c)[:, None], self.y[self.held], self.stands))

    def judges(self) -> list[tuple[np.ndarray, float]]:
        """Calibrated weights and intercept of each view."""
        return [(s[0] * w, s[0] * c + s[1]) for (w, c), s in zip(self.views, self.scales, strict=True)]

    def wants(self) -> list[Want]:
        # surer than a fixed bound, and with at most half the error of always giving this label
        return [Want(v, k, max(SURE, 1 - (1 - self.shares[k]) / 2),
                     int(np.ceil(PER_ROUND * len(self.train) * (self.y == k).mean()))) for v in (0, 1) for k in (1, 0)]

    def model(self) -> Model:
        if self.constant is not None:
            return Model([], [], np.zeros(3), self.constant)
        z = np.column_stack([s[0] * (x.dot(w) + c) + s[1]
                             for x, (w, c), s in zip(self.calib, self.views, self.scales, strict=True)])
        return Model(self.views, self.scales, calibrate(z, self.y[self.held], self.stands))


def cotrain(labelled: list[list[np.ndarray]], y: np.ndarray, pool: list[list[np.ndarray]], rounds: int = ROUNDS) -> Model:
    """``labelled`` and ``pool``: for each view the rows' feature numbers."""
    one = Training(labelled, y)
    if one.constant is not None:
        return one.model()
    unlabelled = [Rows(view) for view in pool]
    one.fit()
    for _ in range(rounds if len(pool[0]) else 0):
        p = [_sigmoid(x.dot(w) + c) for x, (w, c) in zip(unlabelled, one.judges(), strict=True)]
        for q in one.wants():
            other, sure = one.extra[1 - q.view], p[q.view] if q.label else 1 - p[q.view]
            ok = np.array([i for i in np.flatnonzero(sure >= q.least) if i not in other], np.int64)
            best = ok[np.argsort(-sure[ok], kind="stable")][:q.n]
            other.update((int(i), (pool[1 - q.view][i], q.label)) for i in best)
        one.fit()
    return one.model()


def _features(texts: pd.Series, langs: pd.Series, sources: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"t": [text_features(x) for x in texts],
                         "m": [meta_features(*x) for x in zip(texts, langs, sources, strict=True)]})


def _packed(texts: pd.Series, langs: pd.Series, sources: pd.Series) -> pd.DataFrame:
    return _features(texts, langs, sources).map(lambda x: x.astype("<u2").tobytes())


def _unpacked(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in column]


def feature_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                  source: str = "source") -> DataFrame:
    """(id, n, h, t, m) of all rows with a doc_id: size, hash and packed feature numbers of both views."""
    f = F.pandas_udf(_packed, "t binary, m binary")(F.col(text), F.col(lang).cast("string"), F.col(source).cast("string"))
    rows = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), f.alias("f"))
    return shared_table(rows.select("id", F.length("f.t").alias("n"), F.xxhash64("f.t", "f.m").alias("h"), "f.*"), "features")


def fetch(feats: DataFrame, some: DataFrame) -> pd.DataFrame:
    """The rows of the few ids in ``some``, one of each id, by id."""
    one = feats.join(F.broadcast(some), "id").groupBy(*some.columns).agg(F.min(F.struct("n", "h", "t", "m")).alias("r"))
    return one.select(*some.columns, "r.t", "r.m").toPandas().sort_values("id", ignore_index=True)


def sample_labels(known: DataFrame, targets: list[str], bound: int) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """About ``bound`` rows of ``known`` for each target, and the labels of its classes in all of ``known``.

    Rows outside a target's sample have null there.  The rarer class is whole up to half the bound.
    """
    row = known.agg(*[F.count_if(F.col(f"y_{c}") == k).alias(f"{c}_{k}") for c in targets for k in (0, 1)]).first()
    counts = {c: (row[f"{c}_0"], row[f"{c}_1"]) for c in targets}
    place = F.pmod(F.xxhash64(F.col("id"), F.lit(3)), F.lit(2**30))
    cols = []
    for c, n in counts.items():
        parts = []
        for k in (0, 1):
            room = max(bound - n[1 - k], bound // 2)
            parts.append(2**30 if n[k] <= room else int(2**30 * room / n[k]))
        y = F.col(f"y_{c}")
        cols.append(F.when(place < F.when(y == 1, parts[1]).otherwise(parts[0]), y).alias(f"y_{c}"))
    some = known.select("id", *cols)
    return some.filter(F.coalesce(*[F.col(f"y_{c}") for c in targets]).isNotNull()), counts


def surest(feats: DataFrame, known: DataFrame, jobs: dict[str, Training]) -> dict[str, list[tuple[Want, list]]]:
    """For each target and ``Want`` the ids of the surest rows of the whole table: without a label for the target
    in ``known`` and not yet given to the other view.  Ties go by a hash of the id; an id counts once."""
    sent = feats.sparkSession.sparkContext.broadcast([t.judges() for t in jobs.values()])  # some MB, whatever the input

    def run(texts: pd.Series, metas: pd.Series) -> pd.DataFrame:
        rows = [Rows(_unpacked(texts)), Rows(_unpacked(metas))]
        return pd.DataFrame({f"p{i}_{v}": _sigmoid(rows[v].dot(w) + c)
                             for i, views in enumerate(sent.value) for v, (w, c) in enumerate(views)})

    run.__annotations__ = {"texts": pd.Series, "metas": pd.Series, "return": pd.DataFrame}
    p = F.pandas_udf(run, ", ".join(f"p{i}_{v} double" for i in range(len(jobs)) for v in (0, 1)))("t", "m")
    one = feats.select("id", F.struct("n", "h", p.alias("p")).alias("r")).groupBy("id").agg(F.min("r").alias("r"))
    one = shared_table(one.join(known, "id", "left").select(
        "id", F.xxhash64(F.col("id"), F.lit(5)).alias("place"), *[f"y_{c}" for c in jobs], "r.p.*"), "sure")
    out: dict[str, list[tuple[Want, list]]] = {}
    for i, (c, t) in enumerate(jobs.items()):
        # the other class of the same round finds the rows given just now taken, too
        taken = [set(x) for x in t.extra]
        out[c] = []
        for q in t.wants():
            sure, gone = F.col(f"p{i}_{q.view}") if q.label else 1 - F.col(f"p{i}_{q.view}"), taken[1 - q.view]
            best = one.filter(F.col(f"y_{c}").isNull() & (sure >= q.least)).orderBy(sure.desc(), "place", "id")
            ids = [r[0] for r in best.select("id").limit(q.n + len(gone)).collect()]
            ids = [x for x in ids if x not in gone][:q.n]
            gone.update(ids)
            out[c].append((q, ids))
    return out


def train(docs: DataFrame, labels: DataFrame, targets: dict[str, bool], doc_id: str = "doc_id", text: str = "text",
          lang: str = "lang", source: str = "source", max_labelled: int = MAX_LABELLED) -> dict[str, Model]:
    """A model for each target column of ``labels`` (0 or 1; True where the higher label is the worse one)."""
    known = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(
        *[(F.max if worse else F.min)(c).alias(f"y_{c}") for c, worse in targets.items()])
    known = known.select("id", *[F.when(F.col(f"y_{c}").isin(0, 1), F.col(f"y_{c}").cast("int")).alias(f"y_{c}") for c in targets])
    known = shared_table(known.join(docs.select(F.col(doc_id).alias("id")).distinct(), "id", "left_semi"), "labels")
    some, counts = sample_labels(known, list(targets), max_labelled)
    if max(min(n) for n in counts.values()) < LEAST:
        return {c: Training([[], []], np.empty(0, np.int64), n).model() for c, n in counts.items()}
    feats = feature_table(docs, doc_id, text, lang, source)
    lab = fetch(feats, some)
    jobs = {}
    for c in targets:
        own = lab[lab[f"y_{c}"].notna()]
        jobs[c] = Training([_unpacked(own["t"]), _unpacked(own["m"])], own[f"y_{c}"].to_numpy(np.int64), counts[c])
    able = {c: t for c, t in jobs.items() if t.constant is None}
    for r in range(ROUNDS + 1):
        for t in able.values():
            t.fit()
        if r == ROUNDS or not able:
            break
        picks = surest(feats, known, able)
        ids = sorted({x for qs in picks.values() for _, xs in qs for x in xs})
        if not ids:
            break
        rows = fetch(feats, docs.sparkSession.createDataFrame([(x,) for x in ids], feats.select("id").schema))
        sides = [dict(zip(ids, _unpacked(rows[k]), strict=True)) for k in ("t", "m")]
        for c, qs in picks.items():
            for q, xs in qs:
                able[c].extra[1 - q.view].update((x, (sides[1 - q.view][x], q.label)) for x in xs)
    return {c: t.model() for c, t in jobs.items()}


def score(docs: DataFrame, models: dict[str, Model], text: str = "text", lang: str = "lang",
          source: str = "source") -> DataFrame:
    """``docs`` with the probability of each target in a column of its name."""
    if clash := {c.lower() for c in docs.columns} & {c.lower() for c in models}:
        raise ValueError(f"the input has columns named {sorted(clash)}")
    sent = docs.sparkSession.sparkContext.broadcast(models)  # some MB, whatever the input

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, langs, sources in batches:
            f = _features(texts, langs, sources)
            rows = [Rows(f["t"].tolist()), Rows(f["m"].tolist())]
            yield pd.DataFrame({c: m.score(rows) for c, m in sent.value.items()})

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    s = F.pandas_udf(run, ", ".join(f"`{c}` double" for c in models))(
        F.col(text), F.col(lang).cast("string"), F.col(source).cast("string"))
    (scores,) = fresh(docs, "s")
    d = docs.withColumn(scores, s)
    return d.select(*docs.columns, *[F.col(scores)[c].alias(c) for c in models])
