"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a row of numbers; each number is cut into bins at quantiles
of the training rows. Boosting goes round the features in a cycle: a step fits
a shallow tree to the gradients, summed by bin, of one feature, shrinks it and
adds it to that feature's lookup table. After the single features, the pairs
of features whose two-dimensional tables would lower the loss most are boosted
in the same way on a coarser grid. The rounds stop when rows set aside no
longer improve. A score is an intercept plus one table entry for each feature
and pair, looked up and added for a whole batch at once, then the logistic
function.

Texts are read once, by Spark, for all rows; the numbers are written and the
labels joined to them. The fit is of at most ``sample`` labelled rows, those
of smallest hash, which is the bound of what reaches the driver; everything
else covers all rows.

Null and empty texts have the numbers of no words and are scored like the
others; very long texts are read whole; repeated rows are scored alike, rows
that repeat a label count as often; labels other than 0 and 1 and null ids
teach nothing; without labels of both kinds the score is the (smoothed) share
of label 1, one half without any; other columns are ignored."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, written

SAMPLE = 20_000   # labelled rows that the model is fitted on, at most
THRESHOLD = 0.7
FEATURES = ("log_words", "word_length", "upper_share", "symbol_share", "exclaimed", "marks", "stops", "digits", "quotes", "high_bytes",
            "next_same", "distinct", "top_word", "window_repeats", "line_repeats", "log_line_words", "stopped_lines", "capitalised",
            "letterless", "compressed", "log_longest_word", "log_lines")
_BLANKS = " \t\n\v\f\r"
_SETS = {"symbol_share": b"#*$%&|<>", "exclaimed": b"!", "marks": b"|", "stops": b".,;:?", "digits": b"0123456789", "quotes": b"\"'()[]{}"}
_STOPPED = re.compile(r"[.!?:;\"'”»][ \t\v\f\r]*$")
_LETTER = re.compile(r"[^\W\d_]")


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def numbers_of(text: str) -> list[float]:
    """The numbers of FEATURES, from the whole text."""
    raw = text.encode()
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = [w for w in re.split(f"[{_BLANKS}]+", text) if w]
    n, size = len(words), len(raw)
    count = Counter(words)
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    upper, lower = int(byte[65:91].sum()), int(byte[97:123].sum())
    windows = Counter(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    packer = zlib.compressobj(1)
    packed = sum(len(packer.compress(raw[i:i + (1 << 20)])) for i in range(0, size, 1 << 20)) + len(packer.flush())
    shares = {k: int(byte[list(v)].sum()) for k, v in _SETS.items()}
    out = {
        "log_words": np.log1p(n), "word_length": _share(size - int(byte[list(_BLANKS.encode())].sum()), n),
        "upper_share": _share(upper, upper + lower), **{k: _share(v, size if k in ("symbol_share", "digits", "quotes") else n) for k, v in shares.items()},
        "high_bytes": _share(int(byte[128:].sum()), size), "next_same": _share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n),
        "distinct": _share(len(count), n), "top_word": _share(max(count.values(), default=0), n),
        "window_repeats": _share(sum(v - 1 for v in windows.values()), n), "line_repeats": _share(len(lines) - len(set(lines)), len(lines)),
        "log_line_words": np.log1p(_share(n, len(lines))), "stopped_lines": _share(sum(bool(_STOPPED.search(x)) for x in lines), len(lines)),
        "capitalised": _share(sum(v for w, v in count.items() if w[0].isupper()), n),
        "letterless": _share(sum(v for w, v in count.items() if not _LETTER.search(w)), n), "compressed": _share(packed, size),
        "log_longest_word": np.log1p(max(map(len, count), default=0)), "log_lines": np.log1p(len(lines))}
    return [float(out[k]) for k in FEATURES]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Gam:
    """Additive model over ``x`` (rows, features) and labels ``y`` of 0 and 1, fitted by cyclic boosting."""

    def __init__(self, bins: int = 64, grid: int = 12, pairs: int = 8, rounds: int = 400, rate: float = 0.1, least: int = 20,
                 patience: int = 25, smooth: float = 1.0):
        self.bins, self.grid, self.n_pairs, self.rounds, self.rate = bins, grid, pairs, rounds, rate
        self.least, self.patience, self.smooth = least, patience, smooth

    @staticmethod
    def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="inverted_cdf")) if len(x) else np.empty(0)

    def _binned(self, x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)])

    def _split(self, g: np.ndarray, h: np.ndarray, n: np.ndarray):
        """The best cut of a row of bins: (gain, place), by the second-order rule."""
        gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
        gain = gl ** 2 / (hl + self.smooth) + (g.sum() - gl) ** 2 / (h.sum() - hl + self.smooth) - g.sum() ** 2 / (h.sum() + self.smooth)
        gain[(nl < self.least) | (n.sum() - nl < self.least)] = 0
        return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (0.0, 0)

    def _tree(self, g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = 3) -> np.ndarray:
        """A step for each bin: a tree of at most ``leaves`` leaves over sums of gradients, curvatures and rows by bin."""
        parts = [(0, len(g))]
        while len(parts) < leaves:
            best = max(((*self._split(g[a:b], h[a:b], n[a:b]), a, b) for a, b in parts if b - a > 1), default=(0.0, 0, 0, 0))
            if best[0] <= 1e-9:
                break
            _, at, a, b = best
            parts.remove((a, b))
            parts += [(a, a + at), (a + at, b)]
        step = np.zeros(len(g))
        for a, b in parts:
            step[a:b] = g[a:b].sum() / (h[a:b].sum() + self.smooth)
        return step

    def _quadrants(self, g, h, n) -> tuple[float, np.ndarray]:
        """A tree of four leaves on a grid: the best cut of one side, then the best cut of the other in each half."""
        best = (0.0, np.full(g.shape, g.sum() / (h.sum() + self.smooth)))
        for flip in (False, True):
            G, Hs, N = (m.T if flip else m for m in (g, h, n))
            for at in range(1, len(G)):
                gain, step = 0.0, np.empty(G.shape)
                for part in (slice(0, at), slice(at, None)):
                    a, b, c = G[part].sum(0), Hs[part].sum(0), N[part].sum(0)
                    got, cut = self._split(a, b, c)
                    for side in ((slice(0, cut), slice(cut, None)) if got > 0 else (slice(None),)):
                        ga, ha = a[side].sum(), b[side].sum()
                        step[part, side] = ga / (ha + self.smooth)
                        gain += ga ** 2 / (ha + self.smooth)
                gain -= g.sum() ** 2 / (h.sum() + self.smooth)
                if gain > best[0] and min(N[:at].sum(), N[at:].sum()) >= self.least:
                    best = (gain, step.T if flip else step)
        return best

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        self.cuts = [self._cuts(x[:, k], self.bins) for k in range(x.shape[1])]
        self.coarse = [self._cuts(x[:, k], self.grid) for k in range(x.shape[1])]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int]] = []
        self.grids: list[np.ndarray] = []
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.intercept = float(np.log(p / (1 - p)))
        if len(set(y.tolist())) < 2:
            return self
        fine, rough = self._binned(x, self.cuts), self._binned(x, self.coarse)
        aside = np.arange(len(y)) % 8 == 7  # rows come in hash order
        self._boost(fine, [(k,) for k in range(x.shape[1])], self.tables, y, aside, fine, rough)
        g, h = self._gradients(fine, rough, y, ~aside)
        scored = []
        for a, b in combinations(range(x.shape[1]), 2):
            sums = self._sums(rough[~aside], (a, b), (len(self.coarse[a]) + 1, len(self.coarse[b]) + 1), g, h)
            scored.append((self._quadrants(*sums)[0], a, b))
        self.pairs = [(a, b) for gain, a, b in sorted(scored, key=lambda s: (-s[0], *s[1:]))[:self.n_pairs] if gain > 0]
        self.grids = [np.zeros((len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)) for a, b in self.pairs]
        self._boost(rough, self.pairs, self.grids, y, aside, fine, rough)
        for k, t in enumerate(self.tables):  # tables are centred, the intercept takes their means
            self.intercept += float(t[fine[:, k]].mean())
            t -= t[fine[:, k]].mean()
        return self

    def _margin(self, fine: np.ndarray, rough: np.ndarray) -> np.ndarray:
        out = np.full(len(fine), self.intercept)
        for k, t in enumerate(self.tables):
            out += t[fine[:, k]]
        for (a, b), t in zip(self.pairs, self.grids, strict=True):
            out += t[rough[:, a], rough[:, b]]
        return out

    def _gradients(self, fine, rough, y, rows):
        p = _sigmoid(self._margin(fine[rows], rough[rows]))
        return y[rows] - p, p * (1 - p)

    @staticmethod
    def _sums(binned, term, shape, g, h):
        at = np.ravel_multi_index(tuple(binned[:, k] for k in term), shape)
        size = int(np.prod(shape))
        return tuple(np.bincount(at, w, size).reshape(shape) for w in (g, h, None))

    def _boost(self, binned, terms, tables, y, aside, fine, rough) -> None:
        """Cycles over ``terms`` until the loss of the rows set aside has not fallen for ``patience`` cycles; the best is kept."""
        margin, learn = self._margin(fine, rough), ~aside

        def loss():
            return float(np.logaddexp(0, np.where(y[aside] > 0, -margin[aside], margin[aside])).mean()) if aside.any() else 0.0
        best, since, kept = loss(), 0, [t.copy() for t in tables]
        for _ in range(self.rounds):
            for term, table in zip(terms, tables, strict=True):
                p = _sigmoid(margin[learn])
                sums = self._sums(binned[learn], term, table.shape, y[learn] - p, p * (1 - p))
                step = self.rate * (self._tree(*sums) if len(term) == 1 else self._quadrants(*sums)[1])
                table += step
                margin += step[tuple(binned[:, k] for k in term)]
            now = loss()
            if now < best - 1e-6:
                best, since, kept = now, 0, [t.copy() for t in tables]
            else:
                since += 1
                if since >= self.patience:
                    break
        for t, k in zip(tables, kept, strict=True):
            t[...] = k

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row: table entries looked up by bin and added."""
        return _sigmoid(self._margin(self._binned(x, self.cuts), self._binned(x, self.coarse)))


def text_numbers(docs: DataFrame) -> DataFrame:
    """(id, x) of every row of ``docs`` (id, text); written once."""

    def read(batches):
        for b in batches:
            x = [numbers_of(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "x": pa.array(x, pa.list_(pa.float64()))})

    return written(docs.mapInArrow(read, "id long, x array<double>"), "quality-numbers")


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(numbers: DataFrame, labels: DataFrame, sample: int = SAMPLE, **kw) -> Gam:
    """The model of at most ``sample`` rows of ``numbers`` that ``labels`` (id, label) names, those of smallest hash."""
    known = labels.where("id is not null and label in (0, 1)")
    rows = known.select("id", F.col("label").cast("int").alias("y"), F.xxhash64("id", F.lit("fit")).alias("o"))
    share = min(1.0, 2 * sample / max(1, rows.count()))  # twice the sample is sorted, not every labelled row
    rows = rows.where(F.pmod("o", F.lit(1 << 30)) < int(share * (1 << 30)))
    got = numbers.join(rows, "id").orderBy("o", "id", "y", "x").limit(sample).select("x", "y").toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(got.num_rows, len(FEATURES))
    return Gam(**kw).fit(x, got["y"].to_numpy().astype(float))


def scored(numbers: DataFrame, model: Gam) -> DataFrame:
    """(id, score) of every row."""

    def add(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "score": pa.array(model.score(x), pa.float64())})

    return numbers.mapInArrow(add, "id long, score double")


def op13_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long").alias("id"), F.col("quality").alias("label"))
    numbers = text_numbers(docs)
    model = fitted(numbers, labels.where(~held_out(F.col("id"))))
    return scored(numbers, model).select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score",
                                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
