"""Operator 10: benchmark decontamination with one Aho-Corasick automaton.

Test items are normalised to words (A-Z lower-cased, ASCII but letters and digits separates) and cut into windows of ten
consecutive words; an item of fewer words, but not none, is one window. All windows make up one automaton; a document is
normalised alike and scanned once, and the words inside any occurrence of a window are hit. Words map back to places in
the original text.

The automaton goes to every worker, so its size is checked: items whose windows exceed ``AUTOMATON_CHARS`` are dealt into
blocks of that size, each scanned by an automaton of its own, and their hits are merged per document.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from honeyframe.llm.common import kept

#: Characters of windows in one automaton (about 100 bytes of memory for each in a worker).
AUTOMATON_CHARS = 2_000_000
_UPPER = range(65, 91)
#: Letters of A-Z become small; other ASCII but digits and small letters becomes a space.
_TO_WORDS = bytes(b + 32 if b in _UPPER else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RESULT = "n_words long, n_hit long, items array<string>, hits array<struct<first: int, last: int>>"

_built: dict[int, object] = kept({})


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def windows(text: bytes, size: int = 10) -> set[bytes]:
    found = normal_words(text)
    if not found:
        return set()
    size = min(size, len(found))
    return {b" ".join(found[i : i + size]) for i in range(len(found) - size + 1)}


def _blocks(benchmark: DataFrame, size: int, most: int, id_col: str, text_col: str) -> Iterator[dict[bytes, tuple[str, ...]]]:
    """Windows with their items, as many as one automaton takes; rows stream to the driver, which holds one block."""
    block: dict[bytes, set[str]] = {}
    chars = 0
    for item, text in benchmark.select(F.col(id_col).cast("string"), text_col).toLocalIterator():
        for window in windows((text or "").encode(), size):
            if window not in block:
                chars += len(window)
            block.setdefault(window, set()).update(() if item is None else (item,))
        if chars >= most:
            yield {w: tuple(sorted(items)) for w, items in block.items()}
            block, chars = {}, 0
    yield {w: tuple(sorted(items)) for w, items in block.items()}


def build_automaton(block: dict[bytes, tuple[str, ...]]):
    import ahocorasick

    tree = ahocorasick.Automaton()
    for window, items in block.items():
        tree.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, len(window) + 2, items))
    if len(tree):
        tree.make_automaton()
    return tree


def scan(tree, text: bytes) -> tuple[int, list[tuple[int, int]], list[str]]:
    """The number of words, the merged ranges [first, last] of words that are hit, and the items found."""
    found = normal_words(text)
    if not found or not len(tree):
        return len(found), [], []
    items: set[str] = set()
    ranges: list[tuple[int, int]] = []
    starts: list[int] = []
    for end, (n, length, names) in tree.iter(f" {b' '.join(found).decode('latin-1')} "):
        if not starts:
            at = 0
            for w in found:
                starts.append(at)
                at += len(w) + 1
        first = bisect_right(starts, end - length + 1) - 1
        ranges.append((first, first + n - 1))
        items.update(names)
    return len(found), merge(ranges), sorted(items)


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words as code point offsets [start, end) in the original text."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b][1]) for a, b in hits]


def _tree(shared):
    """One automaton for each block and worker process."""
    key = shared.value["key"]
    if key not in _built:
        _built.clear()
        _built[key] = build_automaton(shared.value["block"])
    return _built[key]


def _shared(spark, block: dict[bytes, tuple[str, ...]]):
    return spark.sparkContext.broadcast({"key": hash(frozenset(block.items())), "block": block})


def _bytes_of(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    for text in batch.column(column):
        yield text.as_buffer().to_pybytes() if text.is_valid else b""


def _scanner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, items, hits = [], [], [], []
            for text in _bytes_of(batch, "text"):
                n, ranges, names = scan(_tree(shared), text)
                n_words.append(n)
                n_hit.append(sum(b - a + 1 for a, b in ranges))
                items.append(names)
                hits.append([{"first": a, "last": b} for a, b in ranges])
            hit_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(hits, hit_type)], ["id", "digest", "n_words", "n_hit", "items", "hits"])

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, automaton_chars: int = AUTOMATON_CHARS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_hit, items (sorted as strings), hits (merged ranges of word numbers, for original_spans).

    Null and empty texts have no words; very long ones are scanned whole. The windows of an item with a null id are hit
    like any other, but no items are named for them; items without words are never found. Repeated rows each get a row,
    ties and null ids too. Only the named columns are read. No benchmark, or an empty one, hits nothing; an empty table
    gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).cast("binary").alias("text"))
    key = f"id {dict(rows.dtypes)['id']}, digest long"
    parts = [rows.mapInArrow(_scanner(_shared(docs.sparkSession, block)), f"{key}, {RESULT}") for block in _blocks(benchmark, window, automaton_chars, item_col, item_text_col)]
    if len(parts) == 1:
        return parts[0].drop("digest").withColumnRenamed("id", id_col)
    # Each row once from the first block; what all blocks hit is merged per document and text.
    hit = parts[0].filter("n_hit > 0")
    for x in parts[1:]:
        hit = hit.unionByName(x.filter("n_hit > 0"))
    both = hit.dropDuplicates(["id", "digest", "items", "hits"]).groupBy("id", "digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("all_items"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("all_hits"))
    zero = F.expr("cast(array() as array<struct<first: int, last: int>>)")

    def joined(acc, x):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"))))
        return F.when((F.size(acc) > 0) & (x["first"] <= F.try_element_at(acc, F.lit(-1))["last"] + 1), grown).otherwise(F.concat(acc, F.array(x)))

    both = both.select(F.col("id").alias("i"), F.col("digest").alias("g"), "all_items", F.aggregate("all_hits", zero, joined).alias("all_hits"))
    out = parts[0].select("id", "digest", "n_words").join(both, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("g")), "left")
    n_hit = F.aggregate("all_hits", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce(n_hit, F.lit(0)).alias("n_hit"), F.coalesce("all_items", F.expr("cast(array() as array<string>)")).alias("items"), F.coalesce("all_hits", zero).alias("hits"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, automaton_chars: int = AUTOMATON_CHARS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that no window of the benchmark occurs in; nothing is shuffled."""
    out = docs
    for block in _blocks(benchmark, window, automaton_chars, item_col, item_text_col):
        shared = _shared(docs.sparkSession, block)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not t.is_valid or not scan(_tree(shared), t.as_py().encode())[1] for t in batch.column(text_col)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(keep, out.schema)
    return out
