"""Operators on training data against brute force, and on the odd rows that any table may have."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
import xxhash

from honeyframe.llm import chat_format, common, components, dac, decontaminate, encoding, hpylm, html_text, packing, quality, simhash, token_counts, url_filter
from honeyframe.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import rows_of

LONG = "lorem ipsum dolor " * 30_000
TEXTS = [None, "", "  \t\n", "one", "a b c", "same text here " * 20, "same text here " * 20, "Ünïcode  naïve\u3000wide <|endoftext|> end", LONG, "x\n\ny | z !!"]
DOCS = "doc_id long, text string, fingerprint string, key int, content binary, ids_crc32 long"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, repeated rows, ties, an id twice, and columns named like those that operators make."""
    rows = [(i, t, None, None, None, None) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 1, b"y", 2), (3, "one", None, None, None, None), (3, "other", None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(encoding.vocabulary("byte_bpe_50k.json"))


def library_ids(tokenizer, texts):
    return [x.ids for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def test_encoder_equals_the_library(tokenizer):
    rng = random.Random(1)
    parts = ["a", "Foo", " ", " ", "\n", "\t", "é", "12", "'s", ".", "!", "\u3000", "\xa0", "<|endoftext|>", "\x1c", "\u200b", "\0", "😀", "don't", "Ġ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(8000)] + TEXTS
    got = []
    for _, ids, n in encoding.encode_all(encoding.vocabulary("byte_bpe_50k.json"), texts):
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == library_ids(tokenizer, texts)
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        assert sum(len(n) for _, _, n in encoding.encode_all(encoding.vocabulary(name), ["a b", None])) == 2


def test_token_counts_and_cache(spark, docs, none, tokenizer):
    cache = common.scratch(spark, "test-cache")
    got = sorted(token_counts.count_tokens(docs, cache).collect(), key=repr)
    want = {t or "": len(i) for t, i in zip([*TEXTS, "no id", "other"], library_ids(tokenizer, [*TEXTS, "no id", "other"]), strict=True)}
    assert sorted(x.n_tokens for x in got) == sorted(want[r.text or ""] for r in docs.select("text").collect())
    assert spark.read.parquet(cache).count() == len(want) and all(x.over_limit == (x.n_tokens > 1024) for x in got)
    assert sorted(token_counts.count_tokens(docs, cache).collect(), key=repr) == got
    assert spark.read.parquet(cache).count() == len(want)  # nothing was encoded again
    assert token_counts.count_tokens(none, common.scratch(spark, "test-cache")).count() == 0


def test_dac_round_trip(spark, docs, none, tokenizer):
    rng = np.random.default_rng(2)
    ids = np.concatenate([rng.integers(0, 256, 700), rng.integers(0, 1 << 24, 700), [0, 255, 256, 65535, 65536, 2**32 - 1]]).astype("<u4")
    segment = dac.Segment(dac.build(ids, [4, None], np.array([1000, len(ids) - 1000])))
    assert (segment.ids() == ids).all() and [segment[i] for i in range(len(ids))] == ids.tolist() and segment.doc_ids == [4, None]
    some = rng.integers(0, len(ids), 500)
    assert segment.take(some).tolist() == ids[some].tolist() and segment.take(np.arange(len(ids))).tolist() == ids.tolist()
    assert segment.document(1).tolist() == ids[1000:].tolist() and dac.Segment(dac.build(ids[:0], [1], np.array([0]))).ids().tolist() == []
    with pytest.raises(IndexError):
        segment[len(ids)]
    path = common.scratch(spark, "test-dac")
    dac.write_dataset(docs, path, segment_ids=50)
    got = sorted(dac.read_directory(spark, path).collect(), key=lambda x: x.start)
    want = {(None if t is None else t): i for t, i in zip([*TEXTS, "no id", "other"], library_ids(tokenizer, [*TEXTS, "no id", "other"]), strict=True)}
    order = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    start = 0
    for row, source in zip(got, order, strict=True):
        own = [*want[source.text], 0]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (source.doc_id, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    flat = [i for source in order for i in (*want[source.text], 0)]
    for at in (0, 1, 49, 50, 51, len(flat) // 2, len(flat) - 1):
        assert dac.token_at(spark, path, at) == flat[at]
    with pytest.raises(IndexError):
        dac.token_at(spark, path, len(flat))
    for wanted in (None, 3, 8, 99):
        found = [x.ids for x in sorted(dac.documents(spark, path, wanted).collect())]
        assert found == [[*want[x.text], 0] for x in order if x.doc_id == wanted]
    empty = common.scratch(spark, "test-dac")
    dac.write_dataset(none, empty)
    assert dac.read_directory(spark, empty).count() == 0


def test_packing(spark, docs, none, tokenizer):
    got = packing.pack_documents(docs).collect()
    bins = collections.defaultdict(list)
    for x in got:
        bins[x.sequence_id].append(x)
    for own in bins.values():
        at = 0
        for x in sorted(own, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 1024
    total = sum(len(i) + 1 for i in library_ids(tokenizer, [r.text for r in docs.select("text").collect()]))
    assert sum(x.length for x in got) == total and len(bins) == -(-total // 1024)
    assert packing.pack_documents(none).count() == 0
    want = []
    for row, ids in zip(source := docs.select("doc_id", "text").collect(), library_ids(tokenizer, [r.text for r in source]), strict=True):
        ids = [*ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        want += [(row.doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got), key=repr) == sorted(want, key=repr)


def test_packing_of_rows_without_ids(spark):
    """Pieces that are alike in all columns are dealt over all partitions, none of which grows past its share."""
    pieces = spark.range(6000).selectExpr("cast(null as long) as doc_id", "0 as piece", "0L as start", "301 + id % 7 as length", "0L as ids_crc32")
    got = packing.pack(pieces, 1024, 500).toPandas()
    by = got.groupby("sequence_id")
    assert len(got) == 6000 and (by.length.sum() <= 1024).all() and 2000 <= by.ngroups <= 2012  # one bin more in each partition at most
    for _, own in by:
        assert sorted(own.offset) == [0, *np.cumsum(own.sort_values("offset").length)[:-1]]


def test_repacking_reaches_the_bound(spark):
    rng = random.Random(5)
    sizes = [rng.randint(1, 100) for _ in range(900)]
    pieces = spark.createDataFrame([(i, 0, 0, s, 0) for i, s in enumerate(sizes)], packing.PIECE_SCHEMA)
    got = packing.pack(pieces, 100, 300).toPandas()
    bound = packing.lower_bound(np.bincount(sizes, minlength=101), 100)
    assert len(got) == 900 and (got.groupby("sequence_id").length.sum() <= 100).all() and bound <= got.sequence_id.nunique() <= 1.03 * bound
    assert packing.lower_bound(np.bincount([51] * 7, minlength=101), 100) == 7 and packing.lower_bound(np.bincount([34] * 7, minlength=101), 100) == 4


def test_simhash_by_brute_force(spark, none):
    rng = random.Random(7)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(40)) for _ in range(12)]
    texts = [None, "", " ", "one", "one two"] + base
    for t in base:
        w = t.split()
        for _ in range(4):
            w = w.copy()
            w[rng.randrange(len(w))] = rng.choice("xyz")
            texts.append(" ".join(w))
    texts += base[:3]
    data = spark.createDataFrame([*enumerate(texts, 10), (None, "one")], "doc_id long, text string")

    def fingerprint(text):
        w = (text or "").lower().split()
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fingerprint(t) for t in texts]
    for tau, bucket in ((3, 8192), (8, 8192), (8, 10)):
        label = list(range(len(fps)))
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= tau and label[i] != label[j]:
                    old, new = max(label[i], label[j]), min(label[i], label[j])
                    label = [new if x == old else x for x in label]
        got = simhash.near_duplicates(data, tau, 3, bucket=bucket).select("doc_id", simhash.hex_digits("fp").alias("h"), "component_id").filter("doc_id is not null").orderBy("doc_id").collect()
        assert [x.h for x in got] == [f"{f:016x}" for f in fps]
        assert [x.component_id for x in got] == [x + 10 for x in label]
    assert simhash.near_duplicates(none).count() == 0


def test_wide_simhash_keeps_others(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [[word() for _ in range(300)] for _ in range(8)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        copy = w.copy()
        copy[150] = word()
        rows.append((100 + i, " ".join(copy)))
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 9, 5, 29).collect()}
    assert got == {i: i % 100 for i in got}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (201, 200), (200, 201), (300, 300)]
    got = {x.node: x.label for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in [*range(41), 100]}, 200: 200, 201: 200}


def test_quality_statistics():
    for text in [t or "" for t in TEXTS[:-2]] + ["a b c a b c x", "l\nl\n\nl \n"]:
        raw, w = text.encode(), text.encode().split()
        windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in raw.split(b"\n") if x.split()]
        assert quality.statistics(raw)[:5] == (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def test_quality_judges(spark, docs, none):
    rng = random.Random(3)
    good = [(i, " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 8))) for _ in range(120)) + ".", 1) for i in range(1500)]
    bad = [(5000 + i, " ".join("AB" + rng.choice("cdef") + rng.choice("***|$$$!!") for _ in range(120)), 0) for i in range(240)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    forest = quality.fit(table.select("doc_id", "text"), table.select("doc_id", "quality"))
    verdict = {x.doc_id: x.kept for x in quality.judge(table, forest).collect()}
    assert sum(verdict[i] for i, _, _ in good) >= 1480 and sum(verdict[i] for i, _, _ in bad) <= 12
    odd = quality.judge(docs, forest).collect()
    assert len(odd) == docs.count() and all(x.base_failed and not x.kept for x in odd if x.n_words < 50)
    assert quality.judge(none, forest).count() == 0 and quality.fit(none, table.select("doc_id", "quality")) is None
    assert quality.keep(docs, None).schema == docs.schema


def test_forest_by_walking_its_trees(spark, sf):
    """Scores, verdicts and the threshold against a plain walk of each tree; rows that pass the base rules by brute force."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    forest = quality.fit(docs, labels)
    text = {x.doc_id: x.text for x in docs.collect()}
    judged = quality.judge(docs, forest).collect()
    usual_length = 2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256
    for x in judged[::5]:
        found = quality.features(np.array([quality.statistics((text[x.doc_id] or "").encode())]), forest.usual)[0]
        lengths = []
        for feature, value, child, length in zip(forest.feature, forest.value, forest.child, forest.length, strict=True):
            at = 0
            while feature[at] >= 0:
                at = child[at] + (0 if found[feature[at]] < value[at] else 1)
            lengths.append(length[at])
        score = 2 ** -(sum(lengths) / len(lengths) / usual_length)
        failed = x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words
        assert x.score == pytest.approx(score) and x.base_failed == failed and x.kept == (not failed and score <= forest.threshold)
    bad = {x.doc_id for x in labels.filter("quality = 0").collect()}
    good = {x.doc_id for x in labels.filter("quality = 1").collect()}
    assert not any(x.kept for x in judged if x.doc_id in bad) and sum(not x.kept and not x.base_failed for x in judged if x.doc_id in good) <= 1


def test_repeated_ids_are_learnt_once(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i} " * 60) for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)] * 4, "doc_id long, quality int")
    assert quality.fit(docs, labels) is None  # three labelled rows, however often they occur


def test_decontamination(spark, docs, none):
    rng = random.Random(4)
    item = [rng.choice("abcdefghij") * 3 for _ in range(25)]
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, "Short, ITEM!"), (3, None), (4, "..."), (30, " ".join(item[:15]))], "item_id long, text string")
    rows = [(0, "x " + ", ".join(item[3:14]).upper() + " y"), (1, " ".join(item[3:12])), (2, "a short-item"), (3, "shortitem"), (4, None), (5, "x " + " ".join(item) + " short item")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = {0: (13, 11, ["1", "30"]), 1: (9, 0, []), 2: (3, 2, ["2"]), 3: (1, 0, []), 4: (0, 0, []), 5: (28, 27, ["1", "2", "30"])}
    for chars in (decontaminate.AUTOMATON_CHARS, 40):  # one automaton, and several blocks
        got = {x.doc_id: x for x in decontaminate.find_contamination(table, benchmark, automaton_chars=chars).collect()}
        assert {i: (x.n_words, x.n_hit, x["items"]) for i, x in got.items()} == want
        assert sorted(x.doc_id for x in decontaminate.drop_contaminated(table, benchmark, automaton_chars=chars).collect()) == [1, 3, 4]
    nameless = spark.createDataFrame([(None, "Short, ITEM!"), (7, "x y")], "item_id long, text string")
    got_null = {x.doc_id: x for x in decontaminate.find_contamination(table, nameless).collect()}
    assert (got_null[2].n_hit, got_null[2]["items"]) == (2, []) and got_null[0].n_hit == 0
    text = rows[0][1]
    (a, b), = decontaminate.original_spans(text, [(h.first, h.last) for h in got[0].hits])
    assert text[a:b] == ", ".join(item[3:14]).upper()
    assert decontaminate.find_contamination(docs, benchmark).count() == docs.count() and decontaminate.find_contamination(none, benchmark).count() == 0
    assert decontaminate.drop_contaminated(docs, none.select("doc_id", "text"), item_col="doc_id").count() == docs.count()


def test_language_model(spark, docs, none):
    rng = random.Random(6)
    names = ["".join(rng.choice("abcde") for _ in range(4)) for _ in range(60)]
    texts = {i: " ".join(names[min(int(rng.expovariate(0.1)), 59)] for _ in range(80)) for i in range(150)}
    table = spark.createDataFrame([*texts.items(), (500, None), (501, "")], "doc_id long, text string")
    got = {x.doc_id: x for x in hpylm.score_documents(table, chunk_tokens=1000).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in got}
    tokens = {i: [*texts.get(i, "").split(), None] for i in got}
    c = collections.Counter(t for i, own in tokens.items() if not held[i] for t in own)
    n, v = sum(c.values()), len(c)
    for i, x in got.items():
        base = sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens[i])
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[i], len(tokens[i]), sum(t in c for t in tokens[i]), n) and x.base_score == pytest.approx(base)
        assert x.score < 0
    one = {x.doc_id: x.score for x in hpylm.score_documents(table, chunk_tokens=10**6).collect()}
    assert all(got[i].score == pytest.approx(one[i], rel=1e-5) for i in one)
    assert hpylm.score_documents(docs).count() == docs.count() and hpylm.score_documents(none).count() == 0


def test_probabilities_sum_to_one():
    """Over the vocabulary and one unknown token, in the parent and in every context, for any seating."""
    rng = np.random.default_rng(3)
    words, contexts = 12, 5
    customers = rng.integers(0, 4, (contexts, words)) * rng.integers(0, 9, (contexts, words))
    tables = np.minimum(customers, rng.integers(1, 5, customers.shape))
    served = tables.sum(0)
    parent = np.minimum(served, rng.integers(1, 4, words))
    root, root_tables, vocabulary = served.sum(), parent.sum(), (served > 0).sum()
    known = hpylm.parent_predictive(served, parent, root, root_tables, vocabulary)[served > 0]
    unknown = hpylm.parent_predictive(np.zeros(1), np.zeros(1), root, root_tables, vocabulary)
    assert known.sum() + unknown[0] == pytest.approx(1)
    for c, t in zip(customers, tables, strict=True):
        every = hpylm.predictive(np.append(c[served > 0], 0), np.append(t[served > 0], 0), t.sum(), c.sum(), np.append(known, unknown))
        assert every.sum() == pytest.approx(1)


@pytest.mark.parametrize("customers,base,parent", [(2, 1.0, 0.3), (6, 5.0, 0.05), (6, 0.4, 0.9)])
def test_seating_by_enumeration(customers, base, parent):
    """The Metropolis chain's tables follow the restaurant's own distribution, which generalised Stirling numbers give."""
    d, n = 0.75, 20_000
    ways = {1: 1.0}
    for k in range(1, customers):
        ways = {t: ways.get(t - 1, 0) * (base + d * (t - 1)) * parent + ways.get(t, 0) * (k - d * t) for t in range(1, k + 2)}
    rng, tables, logs = np.random.default_rng(5), np.ones(n), np.full(n, -np.inf)
    for _ in range(20):
        tables, logs = hpylm.reseat(rng, np.full(n, float(customers)), np.full(n, base), d, np.full(n, parent), tables, logs)
    share = np.bincount(tables.astype(int), minlength=customers + 1)[1:] / n
    want = np.array([ways[t] for t in range(1, customers + 1)]) / sum(ways.values())
    assert np.abs(share - want).max() < 0.015


def test_language_model_over_many_buckets(spark):
    """A frequent token dealt over several buckets leaves counts exact; the bucket count changes the draws alone; what follows a word is learnt."""
    rng = random.Random(2)
    texts = ["the " + " the ".join(f"w{rng.randint(0, 300)} a{rng.randint(0, 5)}" for _ in range(40)) for _ in range(300)]
    table = spark.createDataFrame([*enumerate(texts), (None, "w1"), (7, None)], "doc_id long, text string")
    one = {(x.doc_id, x.n_tokens): x for x in hpylm.score_documents(table).collect()}
    many = {(x.doc_id, x.n_tokens): x for x in hpylm.score_documents(table, chunk_tokens=3000, bucket_bytes=20_000, hot_tokens=1000).collect()}
    assert one.keys() == many.keys() and len(one) == 302
    for key, x in one.items():
        y = many[key]
        assert (x.held_out, x.n_known, x.train_tokens) == (y.held_out, y.n_known, y.train_tokens) and x.base_score == pytest.approx(y.base_score)
        assert abs(x.score - y.score) < (0.02 * abs(x.score) if x.n_tokens > 100 else 0.5) and (x.score > x.base_score or x.n_tokens < 100)


def test_viterbi_and_marginals_by_enumeration():
    """The decoded labelling is the best of all, on pages of few blocks under random weights."""
    rng = np.random.default_rng(8)
    blocks = [html_text.Block(("body", tag), text, 0) for tag in ("p", "div", "li") for text in ("Short", "A longer sentence that ends.", "© us")]
    names = {f: i for i, f in enumerate(sorted({f for b in blocks for f in html_text.features(b)}))}
    for _ in range(40):
        field = html_text.Field(names)
        field.state, field.step, field.first = rng.normal(size=(len(names), 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
        field.settle()
        page = [blocks[i] for i in rng.integers(0, len(blocks), rng.integers(1, 8))]
        s = field.scores(page)

        def total(labels, s=s, field=field):
            return field.first[labels[0]] + sum(s[i, y] for i, y in enumerate(labels)) + sum(field.step[a, b] for a, b in zip(labels, labels[1:], strict=False))

        best = max(itertools.product((0, 1), repeat=len(page)), key=total)
        assert [int(x) for x in field.label(page)] == list(best)


def test_simhash_of_odd_rows(spark, docs):
    """Nulls, empty and very long texts, ties, an id twice and columns of any names: each row gets the fingerprint and component of brute force."""
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits("fp").alias("fp"), "component_id").collect()
    rows = docs.select("doc_id", "text").collect()

    def bits(text):
        w = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    want, label = [bits(x.text) for x in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (want[i] ^ want[j]).bit_count() <= 3:
                label = [label[j] if x == label[i] else x for x in label]
    least = [min((x.doc_id for x, k in zip(rows, label, strict=True) if k == own and x.doc_id is not None), default=None) for own in label]
    assert sorted(((x.doc_id, x.fp, x.component_id) for x in got), key=repr) == sorted(((x.doc_id, f"{w:016x}", c) for x, w, c in zip(rows, want, least, strict=True)), key=repr)


def test_url_rules(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/a?q#f", "https://example.com/en/x", "https://example.com/en", "http://a.net/es/1", "http://xnet/es/1", "http://b.com", "http://b.com?x=/", "a://b://c/d", "https://s.example.org/en/1"]
    table = spark.createDataFrame([*enumerate(urls), (3, urls[3])], "page_id long, url string").selectExpr("*", "1 as host", "2 as score")
    got = {x.page_id: x for x in url_filter.judge(table).collect()}
    assert [(got[i].host, got[i].path) for i in (0, 1, 2, 3, 8, 9, 10)] == [("", ""), ("", ""), ("", ""), ("www.example.com", "/en/a"), ("b.com", ""), ("b.com", ""), ("b:", "//c/d")]
    assert [got[i].rule for i in (3, 4, 5, 6, 7, 8, 11)] == ["www.example.com/en/", "example.com/en/", "com/", "net/es/", None, None, None]
    assert all(x.verdict in ("allow", "block") for x in got.values()) and url_filter.judge(table).count() == len(urls) + 1
    assert url_filter.judge(table.limit(0)).count() == 0
    long = "http://long.example/" + "segment/" * 20_000
    odd = spark.createDataFrame([(1, long, 0), (None, long, 1), (2, "http://x.com/", 2), (3, "http://x.net/es/", 3), (2, None, 4)], "page_id long, url string, gram int")
    found = url_filter.judge(odd).collect()
    assert len(found) == 5 and sum(x.path == "/" + "segment/" * 20_000 and x.rule is None and x.verdict in ("allow", "block") for x in found) == 2


def test_html(spark):
    field = html_text.trained_field(200)
    rng = random.Random(77)
    pages = [html_text._labelled_page(rng) for _ in range(60)]
    right = sum(a == b for p in pages for a, b in zip(field.label([b for b, _ in p]), [m for _, m in p], strict=True))
    assert right / sum(map(len, pages)) >= 0.97
    page = '<html><head><title>t</title><script>var a="</p><p>x";</script></head><body><nav><a href="/">Home</a></nav><!-- <p>no</p> --><article><h1>Title &amp; more</h1><p>First\n  para&shy;graph.<p>Second <b>one</b><br>on.</article><div class="comments"><p>Nice!</p></div><footer>&copy; us</footer>'
    assert html_text.main_text(field, page) == "Title & more\n\nFirst para\xadgraph.\n\nSecond one on."
    odd = '<article><p>A sum of <math><mi>x</mi></math> things.</p><p>One <svg/>two <svg><text>no</text></svg>three <button>no</button>four.</p><title-card>Five words of a card.</title-card><p>Six <select>is read.</p></article>'
    assert html_text.main_text(field, odd) == "A sum of x things.\n\nOne two three four.\n\nFive words of a card.\n\nSix is read."
    bare = "<body><p>" + "<p>".join(f"The {w} of the paragraph is a plain sentence. It has two." for w in ("first", "second", "third"))
    assert html_text.main_text(field, bare).count("plain sentence") == 3
    long = "<article>" + "".join(f"<p>Sentence {i} of a very long page.</p>" for i in range(20_000)) + "</article>"
    assert html_text.main_text(field, long).count("\n\n") == 19_999
    table = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p"), (1, "u", page)], "page_id long, url string, html string").selectExpr("*", "'x' as text")
    got = html_text.extract(table).collect()
    assert len(got) == 5 and all(x.n_chars == len(x.text) for x in got) and html_text.extract(table.limit(0)).count() == 0


def test_chat(spark):
    """Ties, repeated rows, nulls, names that would end a header and a long text, in all perspectives, against plain string building."""
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 3, None, "?"), (1, 3, "bob", "tie"), (1, 2, "bob", None), (1, None, "ann", "first"), (2, 0, "system", "alone"), (None, 0, "a|>\nb", "x"), (None, 1, "c", LONG)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as head", "2 as size", "3 as stretch")
    got = chat_format.rotate(table)
    whole = {(x.conv_id, x.perspective): x for x in chat_format.render(got).collect()}
    assert whole.keys() == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "a|>\nb"), (None, "c")} and got.count() == 3 * 7 + 2 * 2

    def build(conv, person):
        turns = sorted(((t is not None, t or 0, r or "unknown", (x or "").replace("<|", "< |")) for c, t, r, x in rows if c == conv))
        text, masks = "", []
        for _, _, who, said in turns:
            text += "<|system|>\n" if who == "system" else "<|assistant|>\n" if who == person else f"<|user name={who.replace('|', '_').replace('>', '_').replace(chr(10), '_')}|>\n"
            if who == person:
                masks.append((len(text), len(text + said + "<|end|>")))
            text += said + "<|end|>\n"
        return text, masks

    for (conv, person), x in whole.items():
        assert (x.text, [tuple(m) for m in x.masks]) == build(conv, person)
        assert [x.text[a:b] for a, b in x.masks] == [f"{(t or '').replace('<|', '< |')}<|end|>" for t in [x.text[a : b - 7] for a, b in x.masks]]
    assert chat_format.rotate(table.limit(0)).count() == 0


def test_pipeline_stages(spark, sf):
    """Each stage against plain rules on its own input."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [len(s) for s in P.STAGES] == [2] * 4
    first = P.quality_rules(spark, docs, sf)
    forest = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {x.doc_id for x in quality.judge(docs, forest).filter("kept").collect()}
    assert first.columns == docs.columns and {x.doc_id for x in first.collect()} == kept
    second = P.near_dedup(spark, first, sf)
    texts = [x.text for x in second.collect()]
    assert second.columns == docs.columns and len(set(texts)) == len(texts)
    assert {x.text for x in first.collect()} >= set(texts) and second.count() >= 0.7 * len({x.text for x in first.collect()})
    third = P.decontamination(spark, second, sf)
    dirty = {x.doc_id for x in decontaminate.find_contamination(second, spark.read.parquet(f"{sf}/benchmark.parquet")).filter("n_hit > 0").collect()}
    assert {x.doc_id for x in third.collect()} == {x.doc_id for x in second.collect()} - dirty
    assert {x.doc_id for x in P.packed(spark, third, sf).select("doc_id").distinct().collect()} == {x.doc_id for x in third.collect()}


def test_pipeline_of_odd_rows(spark):
    """Every stage on nulls in all columns, empty and long texts, repeated rows, an id twice, and columns named like those that stages make; and on no rows."""
    import corpus_pipeline as P

    words = lambda seed: " ".join(f"{random.Random(seed + i).randrange(10**9):x}." for i in range(80))
    rows = [(1, words(0), 1, "a"), (1, words(0), 1, "a"), (1, words(1000), 2, None), (None, words(2000), None, None), (None, words(0), 3, "b"), (2, None, None, None), (3, "", 4, "c"), (4, words(0), 5, "d"), (5, words(3000) + " " + LONG, 6, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, nd_node int, row string")
    benchmark = common.scratch(spark, "odd")
    spark.createDataFrame([(None, " ".join(words(2000).split()[5:30]))], "item_id long, text string").write.parquet(f"{benchmark}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{benchmark}/labels.parquet")
    for frame in (docs, docs.limit(0)):
        now = frame
        for name, stage in P.STAGES:
            now = stage(spark, now, benchmark)
            if name != "best-fit packing":
                assert now.columns == docs.columns
                now = common.materialise(now, "odd-stage")
            if frame is docs and name == "near-duplicate removal":
                found = sorted(((x.doc_id, x.text[:20]) for x in now.collect()), key=repr)
                assert found == sorted([(1, words(0)[:20]), (1, words(1000)[:20]), (None, words(2000)[:20]), (None, words(0)[:20])], key=repr)
            if frame is docs and name == "benchmark decontamination":
                assert sorted(repr(x.doc_id) for x in now.collect()) == ["1", "1", "None"]
        assert now.count() == (0 if frame is not docs else 3)


def test_dedup_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline as P

    text = " ".join(f"w{i}" for i in range(80))
    rows = [(5, text, "a"), (5, text, "a"), (7, text, None), (None, "null id", None), (9, "other words here", "b"), (3, None, None), (4, "", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted((x.doc_id for x in P.near_dedup(spark, table, "").collect()), key=repr) == sorted([3, 5, 9, None], key=repr)


def test_digest_is_of_the_file():
    assert token_counts.tokenizer_digest("byte_bpe_50k.json") == hashlib.sha256(open(encoding.vocabulary("byte_bpe_50k.json"), "rb").read()).digest()


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_by_exact_similarity(spark):
    """Pairs at 0.70 to 0.95, 120 on each side of the bound, and chains: groups are those of brute force."""
    import corpus_pipeline as P

    rng = random.Random(3)
    pairs = []
    for i in range(400):
        own = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        other = own.copy()
        for at in rng.sample(range(120), rng.randint(1, 5)):
            other[at] = f"x{rng.randrange(10**6)}"
        pairs.append((" ".join(own), " ".join(other)))
    s = np.array([len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a, b in pairs])
    assert (s >= 0.8).sum() > 120 and ((s >= 0.8) & (s < 0.87)).sum() > 40 and (s < 0.8).sum() > 120
    rows = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    kept = {x.doc_id for x in P.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert all(2 * i in kept for i in range(len(pairs)))
    assert [2 * i + 1 in kept for i in range(len(pairs))] == [bool(x < 0.8) for x in s]


def test_near_duplicates_of_a_large_group(spark):
    """More near copies than a bucket compares at once, some of them near only to some."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(150):
        w = base.copy()
        for at in rng.sample(range(100), rng.choice([0, 1, 2, 3, 6])):
            w[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    sets, label = [shingles(t) for t in texts], list(range(150))
    for i in range(150):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = label[i], label[j]
                label = [min(x, y) if z in (x, y) else z for z in label]
    from honeyframe.llm import jaccard

    found = {x.row.doc_id: x.nd_least for x in jaccard.near_duplicates(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), 5).collect()}
    assert [found[i] for i in range(150)] == label


def test_dedup_judges_rows_by_their_text(spark):
    """Two rows of one id with different texts, one of them a copy of an earlier document: the other stays."""
    import corpus_pipeline as P

    x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    rows = [(3, y), (7, x), (7, y), (8, "one text"), (8, "another one")]
    kept = P.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(3, y), (7, x), (8, "one text"), (8, "another one")])


def test_near_duplicates_give_back_what_others_kept():
    """A worker that has encoded texts or scanned for windows holds neither table once it looks for near duplicates."""
    from honeyframe.llm import jaccard

    path = encoding.vocabulary("byte_bpe_50k.json")
    for run in (jaccard._Meeter(0, 1), jaccard._verifier(5)):
        before = encoding.encoder(path).encode(["one two three"])[0].tolist()
        decontaminate._built[0] = object()
        assert list(run(iter([]))) == [] and not encoding._open and not decontaminate._built
        assert encoding.encoder(path).encode(["one two three"])[0].tolist() == before


def test_near_duplicates_by_fingerprints(spark, monkeypatch):
    """The SimHash index finds near copies without the bands; what it links is checked on the texts."""
    from pyspark.sql import functions as F

    from honeyframe.llm import jaccard

    rng = random.Random(6)
    own = [[f"w{rng.randrange(10**6)}" for _ in range(4000)] for _ in range(30)]
    texts = [" ".join(w) for w in own] + [" ".join([*w[:-1], "other"]) for w in own]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(jaccard, "_met", lambda rows, low, high: spark.createDataFrame([], "large boolean, a long, b long"))
    found = {x.row.doc_id: x.nd_least for x in jaccard.near_duplicates(docs, 5).collect()}
    assert [found[i] for i in range(60)] == [*range(30), *range(30)]
    far = "unlike " * 3 + "all of the others here"
    wrong = spark.createDataFrame([(0, texts[0]), (1, far), (2, texts[30])], "doc_id long, text string")
    everything = lambda distinct, tau: distinct.select(F.col("fp").alias("a")).crossJoin(distinct.select(F.col("fp").alias("b"))).filter("a < b")
    monkeypatch.setattr(jaccard.simhash, "links", everything)
    assert {x.row.doc_id: x.nd_least for x in jaccard.near_duplicates(wrong, 5).collect()} == {0: 0, 1: 1, 2: 0}
