"""Operator 1: quality rules and an isolation forest on their statistics.

Base rules reject a document outright. On the others an isolation forest judges the rules' statistics: documents that
few random splits set apart are anomalous. The trees are grown from a bounded sample of labelled rows, most of them
good, so that what is bad is rare in each tree; the threshold is calibrated on labelled rows that no tree has seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the forest and its threshold are fitted on at most: those with the smallest hash of their id.
LABELLED_ROWS = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_NOT_START = bytes(range(0x80, 0xC0))
_SPACES = b" \t\n\v\f\r"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_open_lines", "n_upper", "n_marks", "n_bars", "n_distinct")
#: Rates of which only the excess over what is usual is a feature, so that what good texts differ in by chance splits
#: nothing; usual is what this share of the good rows that the trees are grown from stay within.
RULES = ("symbols per word", "duplicate lines", "repeated words", "open lines", "upper case", "marks per word", "bars per word")
USUAL = 0.999
FEATURES = ("chars per word", "lines per word", "distinct words", *RULES)


def statistics(text: bytes) -> tuple[int, ...]:
    """Counts of one UTF-8 text, as STATISTICS names them.

    Words are ``[^\\x20\\x09-\\x0D]+``; characters are code points. Open lines end without ``.``, ``!`` or ``?``.
    """
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, _NOT_START)) - sum(map(text.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    lines = [x for x in text.split(b"\n") if x.strip(_SPACES)]
    return (
        n,
        chars,
        symbols,
        len(lines) - len(set(lines)),
        _repeated(words),
        len(lines),
        sum(x.rstrip(_SPACES)[-1:] not in (b".", b"!", b"?") for x in lines),
        len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        text.count(b"!"),
        text.count(b"|"),
        len(set(words)),
    )


def _repeated(words: list[bytes], size: int = 3) -> int:
    """Words in windows of three words that the text has twice or more, the first included."""
    if len(words) <= size:
        return 0
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    number: dict[tuple[bytes, ...], int] = {}
    own = np.fromiter((number.setdefault(x, len(number)) for x in windows), np.int64, len(windows))
    twice = np.bincount(own)[own] > 1
    hit = np.zeros(len(words), bool)
    for i in range(size):
        hit[i : i + len(twice)] |= twice
    return int(hit.sum())


def rates(stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What of the counts doesn't depend on a text's length: its shape, and the rates of RULES."""
    n, chars, symbols, dup, repeat, lines, open_lines, upper, marks, bars, distinct = stats.T.astype(float)
    w, c, k = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    # Distinct words grow slower than a text: their number is told as a power of its length.
    shape = np.stack([chars / w, lines / w, np.log(np.maximum(distinct, 1)) / np.maximum(np.log(w), 1)], axis=1)
    return shape, np.stack([symbols / w, dup / k, repeat / w, open_lines / k, upper / c, marks / w, bars / w], axis=1)


def features(stats: np.ndarray, usual: np.ndarray) -> np.ndarray:
    shape, rate = rates(stats)
    return np.concatenate([shape, np.maximum(rate - usual, 0)], axis=1)


@dataclass
class Forest:
    """Trees as arrays: of each node the feature (-1: leaf), the split value, the child for smaller values (the other follows it) and a leaf's path length."""

    feature: np.ndarray
    value: np.ndarray
    child: np.ndarray
    length: np.ndarray
    normal: float
    threshold: float = math.inf
    usual: np.ndarray = field(default_factory=lambda: np.zeros(len(RULES)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (- mean path length / that of an unsuccessful search): near 1 is anomalous, under 0.5 is not."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, value, child, length in zip(self.feature, self.value, self.child, self.length, strict=True):
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                at = np.where(inner, child[at] + (x[rows, np.maximum(feature[at], 0)] >= value[at]), at)
            total += length[at]
        return 2.0 ** (-total / len(self.feature) / self.normal)


def _usual(n: int) -> float:
    """Mean path length of an unsuccessful search among n."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(good: np.ndarray, bad: np.ndarray, trees: int = 200, sample: int = 256, bad_share: float = 0.06, seed: int = 7) -> Forest:
    """Isolation trees, each over ``sample`` rows of which about ``bad_share`` are labelled bad."""
    rng = np.random.default_rng(seed)
    depth, grown = math.ceil(math.log2(sample)), []
    for _ in range(trees):
        n_bad = min(len(bad), int(rng.binomial(sample, bad_share)))
        n_good = min(len(good), sample - n_bad)
        rows = np.concatenate([good[rng.choice(len(good), n_good, replace=False)], bad[rng.choice(len(bad), n_bad, replace=False)]]) if len(bad) else good[rng.choice(len(good), n_good, replace=False)]
        nodes: list[list[float]] = [[-1, 0.0, 0, 0.0]]
        todo = [(0, rows, 0)]
        while todo:
            at, own, level = todo.pop()
            low, high = (own.min(0), own.max(0)) if len(own) else (np.zeros(0), np.zeros(0))
            can = np.flatnonzero(high > low) if len(own) else []
            if level >= depth or len(own) < 2 or not len(can):
                nodes[at][3] = level + _usual(len(own))
                continue
            f = int(rng.choice(can))
            split = float(rng.uniform(low[f], high[f]))
            nodes[at][:3] = [f, split, len(nodes)]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
            under = own[:, f] < split
            todo += [(len(nodes) - 2, own[under], level + 1), (len(nodes) - 1, own[~under], level + 1)]
        grown.append(np.array(nodes))
    columns = [[t[:, i] for t in grown] for i in range(4)]
    arrays = [[x.astype(np.int64) if i in (0, 2) else x for x in column] for i, column in enumerate(columns)]
    return Forest(*arrays, normal=_usual(sample))  # type: ignore[arg-type]


def calibrate(forest: Forest, good: np.ndarray, bad: np.ndarray, most_good_lost: float = 0.005) -> float:
    """The threshold that tells labelled rows apart best (share of bad over it less share of good over it), among those that lose at most such a share of the good ones, or a single one."""
    if not len(good) or not len(bad):
        return math.inf
    g, b = np.sort(forest.score(good)), np.sort(forest.score(bad))
    at = np.unique(np.concatenate([g, b]))
    cut = np.append((at[1:] + at[:-1]) / 2, at[-1] + 1e-6)
    lost, caught = 1 - np.searchsorted(g, cut) / len(g), 1 - np.searchsorted(b, cut) / len(b)
    return float(cut[np.argmax(np.where(lost <= max(most_good_lost, 1.5 / len(g)), caught - lost, -1))])


def _bytes_of(column: pa.Array) -> Iterator[bytes]:
    for text in column:
        yield text.as_py().encode() if text.is_valid else b""


def _table_of(column: pa.Array) -> np.ndarray:
    return np.array([statistics(x) for x in _bytes_of(column)], np.int64).reshape(-1, len(STATISTICS))


def _stat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stats = _table_of(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("quality"), *(pa.array(x) for x in stats.T)], ["quality", *STATISTICS])


def fit(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest | None:
    """A forest with its threshold from at most ``labelled_rows`` labelled rows; None without good and bad ones to learn from.

    The ids chosen, at most that many, are broadcast and the statistics of one text of each come to the driver: a bound that doesn't grow with the corpus.
    """
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("quality")).filter("id is not null and quality in (0, 1)")
    chosen = chosen.groupBy("id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("id"), "id").limit(labelled_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))  # of an id that repeats one text
    schema = "quality int, " + ", ".join(f"{x} long" for x in STATISTICS)
    rows = texts.select("quality", "text").mapInArrow(_stat_batches, schema).toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")
    stats = rows[list(STATISTICS)].to_numpy()
    return learn(stats, rows["quality"].to_numpy())


def learn(stats: np.ndarray, quality: np.ndarray) -> Forest | None:
    """A forest grown from half of the labelled rows that pass the base rules; the other half calibrates its threshold."""
    fine = ~base_failed(stats)
    good, bad = stats[fine & (quality == 1)], stats[fine & (quality == 0)]
    rng = np.random.default_rng(11)
    good, bad = good[rng.permutation(len(good))], bad[rng.permutation(len(bad))]
    if len(good) < 8 or len(bad) < 4:
        return None
    usual = np.quantile(rates(good[::2])[1], USUAL, axis=0, method="higher")
    forest = grow(features(good[::2], usual), features(bad[::2], usual))
    forest.usual = usual
    forest.threshold = calibrate(forest, features(good[1::2], usual), features(bad[1::2], usual))
    return forest


def base_failed(stats: np.ndarray) -> np.ndarray:
    n, repeat = stats[:, 0], stats[:, STATISTICS.index("n_repeat_words")]
    return (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)


def _verdicts(forest: Forest | None, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    failed = base_failed(stats)
    score = forest.score(features(stats, forest.usual)) if forest and len(stats) else np.zeros(len(stats))
    return failed, score, ~failed & (score <= (forest.threshold if forest else math.inf))


def judge(docs: DataFrame, forest: Forest | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the counts, base_failed, score and kept, in one pass without a shuffle.

    A null or empty text has no words and fails the base rules; a very long one is read whole. Repeated rows each get a
    row, ties and null ids too. Only the two named columns are read. Without a forest only the base rules judge. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = _table_of(batch.column(1))
            failed, score, kept = _verdicts(shared.value, stats)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in stats.T), pa.array(failed), pa.array(score), pa.array(kept)], ["id", *STATISTICS, "base_failed", "score", "kept"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, " + ", ".join(f"{x} long" for x in STATISTICS) + ", base_failed boolean, score double, kept boolean"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def keep(docs: DataFrame, forest: Forest | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that base rules and forest keep."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_verdicts(shared.value, _table_of(batch.column(text_col)))[2]))

    return docs.mapInArrow(run, docs.schema)
