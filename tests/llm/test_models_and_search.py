"""Search, tokenizer, classifier, line de-duplication and pipeline."""

import itertools
import math
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from runtime_insights.llm import exact_topk, line_dedup, queries
from runtime_insights.llm.exact_topk import OP4_SQL, top_k
from runtime_insights.llm.graph_ann import nearest
from runtime_insights.llm.quality import keep_good, score, train
from runtime_insights.llm.sentencepiece_fst import MODEL, Transducer, decode, encode

import harness

FOLDER = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(queries.TWINS))
def test_query_equals_sql(spark, name):
    assert harness.compare(spark, harness.duck(FOLDER), FOLDER, queries.QUERIES[name], queries.TWINS[name]) is None


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


# Vectors -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(5)
    data = [(i, [float(x) for x in r.normal(size=8)], "x") for i in range(300)]
    data += [(1000 + i, data[7][1], "copy") for i in range(60)]  # ties
    nan, inf = float("nan"), float("inf")
    data += [(2000, None, "n"), (2020, [None] * 8, "n"), (2040, [nan] * 8, "n"), (2060, [inf] + [0.0] * 7, "n"),
             (2080, [0.0] * 8, "zero"), (None, data[3][1], "n"), (2100, [1.0] * 7, "short"), (2120, [], "n")]
    data += [data[20]]  # a repeated row
    data += [(40, [float(x) for x in r.normal(size=8)], "again"), (41, [3.0] * 8, "again"), (41, [-3.0] * 8, "again")]
    data += [(43, [2.5] * 8, "often")] * 30
    data += [(2200, [1.0] * 12, "long"), (2201, [4.0] * 12, "long")]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, score string")


def brute(vectors, whole, k=20):
    kept = []
    for vec_id, e, _ in rows(vectors):
        if vec_id is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        if whole or any(e):
            kept.append((vec_id, [math.floor(64 * x) for x in e] if whole else e))
    out = []
    for q in sorted({v for v, _ in kept if v % 20 == 0}):
        asked = [e for v, e in kept if v == q]
        s = sorted((-sum(a * b for a, b in zip(e, f)), c) for e in asked for c, f in kept if c != q)[:k]
        out += [(q, i, c, -v) for i, (v, c) in enumerate(s, 1)]
    return sorted(out)


def test_exact_top_k(vectors):
    assert sorted(rows(top_k(vectors))) == brute(vectors, True)


def test_exact_top_k_of_large_values_few_rows_and_nothing(spark):
    few = spark.createDataFrame([(0, [1e6, -1e6]), (20, [1e6, 1e6]), (21, [-1e6, 1e6])], "vec_id long, embedding array<double>")
    got = sorted(rows(top_k(few)))
    assert [g[:3] for g in got] == [(0, 1, 20), (0, 2, 21), (20, 1, 0), (20, 2, 21)]
    assert rows(top_k(few.filter("false"))) == []
    assert rows(nearest(few.filter("false"))) == []


def test_exact_top_k_in_many_blocks(vectors, monkeypatch):
    monkeypatch.setattr(exact_topk, "CANDIDATES", 32)
    monkeypatch.setattr(exact_topk, "QUERIES", 4)
    assert sorted(rows(top_k(vectors))) == brute(vectors, True)


def test_rows_that_share_a_vec_id(spark):
    df = spark.createDataFrame(
        [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (2, [1.0, 1.0, 1.0])], "vec_id long, embedding array<double>"
    )
    assert sorted(rows(top_k(df))) == [(0, 1, 1, 64 * 192), (0, 2, 1, 64 * 128), (0, 3, 2, 4096)]
    assert sorted(rows(nearest(df))) == [(0, 1, 1, 3.0), (0, 2, 1, 2.0), (0, 3, 2, 1.0)]


def test_exact_top_k_equals_its_sql_on_repeated_rows(spark, vectors):
    even = vectors.filter("size(embedding) = 8 AND vec_id IS NOT NULL")
    con = duckdb.connect()
    con.register("embeddings", even.select("vec_id", "embedding").toArrow())
    assert sorted(rows(top_k(even))) == sorted(con.execute(OP4_SQL).fetchall())


def test_exact_top_k_up_to_64_bits(spark):
    schema = "vec_id long, embedding array<double>, score string"
    # The square of the longest vector is beyond 64 bits, no product of a query is.
    wide = spark.createDataFrame([(0, [4e5], ""), (1, [-5e9], ""), (2, [5e9], ""), (3, [1.0], ""), (4, [2.5], "")], schema)
    assert sorted(rows(top_k(wide.select("vec_id", "embedding")))) == brute(wide, True)
    with pytest.raises(Exception, match="beyond 64 bits"):
        rows(top_k(wide.union(spark.createDataFrame([(5, [5e10], "")], schema))))


def test_graph_search(vectors):
    got, want = sorted(rows(nearest(vectors))), brute(vectors, False)
    # Rows may share a vec_id, so hits are counted with their scores.
    found, wanted = (Counter((q, v, round(s, 9)) for q, _, v, s in x) for x in (got, want))
    assert len(got) == len(want) and (found & wanted).total() >= 0.99 * len(want)
    exact = {}
    for q, _, v, score_ in want:
        exact.setdefault((q, v), []).append(score_)
    assert all(
        any(math.isclose(s, e, rel_tol=1e-12, abs_tol=1e-14) for e in exact[q, v]) for q, _, v, s in got if (q, v) in exact
    )


def test_graph_recall_over_many_shards(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    con = harness.duck("/root/testdata/sf0.1")
    want = con.execute(
        "SELECT q.vec_id, c.vec_id FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 "
        "QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY "
        "list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id) <= 20"
    ).fetchall()
    got = {(r.query_id, r.vec_id) for r in nearest(df, shard=512).collect()}
    assert len(got & set(want)) >= 0.95 * len(want)


# SentencePiece ---------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")
def test_encoding_equals_the_library_and_round_trips(spark, odd_docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").union(odd_docs.select("doc_id", "text"))
    extra = ["  two  blanks   ", "tab\tand\nline", "漢字 🙂 ñandú", "▁mark", "x" * 3000, " nbsp", "<s> </s> <0x41>", " "]
    docs = docs.union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    text = {}
    for r in docs.collect():
        text.setdefault(r.doc_id, []).append(r.text or "")
    coded = encode(docs)
    for r in coded.collect():
        assert any(r.ids == library.encode(t) for t in text[r.doc_id]), r.doc_id
    for r in decode(coded).collect():
        assert any(r.text == t.replace("▁", " ") for t in text[r.doc_id]), r.doc_id


def _message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += bytes([number << 3, value]) if number < 16 else bytes([number << 3 & 127 | 128, number >> 4, value])
        elif isinstance(value, float):
            import struct
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        else:
            out += bytes([number << 3 | 2, len(value)]) + value
    return out


def test_unigram_shortest_path():
    """A small unigram model against all segmentations."""
    scores = {"▁": -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, "▁a": -3.2, "ba": -5.0, "bab": -6.5, "▁ab": -6.0}
    pieces = [(1, _message((1, b"<unk>"), (2, 0.0), (3, 2)))]
    pieces += [(1, _message((1, p.encode()), (2, s))) for p, s in scores.items()]
    model = _message(*pieces, (2, _message((3, 1))), (3, _message((3, 1), (4, 0))))
    t = Transducer(model)
    names = ["<unk>", *scores]
    for n in range(1, 7):
        for word in map("".join, itertools.product("ab", repeat=n)):
            text = "▁" + word
            best = max(
                sum(scores[p] for p in cut)
                for cut in (
                    [text[i:j] for i, j in zip((0, *c), (*c, len(text)))]
                    for k in range(len(text)) for c in itertools.combinations(range(1, len(text)), k)
                ) if all(p in scores for p in cut)
            )
            ids = t.encode_unit(text.replace("▁", " ").encode())
            assert math.isclose(sum(scores[names[i]] for i in ids), best) and "".join(names[i] for i in ids) == text


# Quality -------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen = labels.filter("doc_id % 3 > 0")
    model = train(docs, seen, sample=1500, exchange=100)
    truth = score(docs, model).alias("s").join(labels.filter("doc_id % 3 = 0").alias("l"), "doc_id").select(
        F.col("s.quality").alias("p"), F.col("l.quality").alias("y")
    ).collect()
    right = sum((r.p >= 0.5) == (r.y == 1) for r in truth) / len(truth)
    kept = sum(r.p >= 0.5 for r in truth if r.y == 1) / sum(r.y == 1 for r in truth)
    assert len(truth) == labels.filter('doc_id % 3 = 0').count() and right >= 0.97 and kept >= 0.98


def test_quality_of_awkward_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(1, 11)] + [(None, 1, 0), (3, None, 0), (1, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    model = train(odd_docs, labels, sample=10, exchange=2, rounds=1)
    got = rows(score(odd_docs, model))
    assert len(got) == odd_docs.count() and all(0 <= q <= 1 for _, q in got)
    none = train(odd_docs, labels.filter("false"))
    assert none is None and keep_good(odd_docs, none).count() == odd_docs.count()
    assert rows(score(no_docs, model)) == [] and keep_good(odd_docs, model, 0.0).schema == odd_docs.schema


def test_quality_learns_a_text_of_many_copies_once(spark, monkeypatch):
    """A third of all rows are one text, under many ids and under one: it is picked once."""
    from runtime_insights.llm import quality

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    first = docs.join(labels, "doc_id", "left_anti").filter("length(text) > 200").orderBy("doc_id").first()
    copies = spark.range(600).select(
        F.when(F.col("id") < 400, F.col("id") + 10**6).otherwise(10**7).alias("doc_id"), F.lit(first.text).alias("text"),
        F.lit(first.source).alias("source"), F.lit(first.lang).alias("lang"))
    taken, features = [], quality._features
    monkeypatch.setattr(quality, "_features", lambda df: taken.append(df.select("text", "y", "fold").collect()) or features(df))
    assert train(docs.union(copies), labels, sample=300, exchange=40) is not None
    for picked in taken[1:]:
        assert picked and len(picked) == len(set(picked))


def test_memory_of_scoring_does_not_grow_with_the_batch(prose):
    """Texts of a large batch are taken in blocks, so that what a worker holds beside the batch stays small."""
    import tracemalloc

    import pyarrow as pa
    from runtime_insights.llm import quality
    from runtime_insights.llm.arrays import chunks, text_bytes

    text = (prose(30_000, 3) * 2)[:200_000]
    batch = pa.RecordBatch.from_pydict({"text": [text] * 40, "source": ["a"] * 40, "lang": ["en"] * 40})
    model = quality.Model(np.zeros(1 << quality.TEXT_BITS), 0.0, np.zeros(7), np.zeros((2, 1 << quality.META_BITS)))
    tracemalloc.start()
    scored = 0
    for chunk in chunks([batch], "text"):
        data, offsets = text_bytes(chunk.column("text"))
        scored += len(model.text_scores(*quality.text_features(data, offsets)))
        quality.meta_features(chunk, data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert scored == 40 and peak < 60e6


def test_texts_go_to_python_in_short_batches(spark):
    """The stages of the pipeline shorten Arrow batches; what the session says stays."""
    from runtime_insights.llm.tables import short_batches

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        short_batches(spark)
        assert spark.conf.get(key) == "1000"
        spark.conf.set(key, "77")
        short_batches(spark)
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


# Lines ---------------------------------------------------------------------------------------


def shingles(line):
    w = [x for x in __import__("re").split("[ \t\x0b\x0c\r]+", line) if x]
    return {" ".join(w[i : i + 9])[:16] for i in range(len(w))}


def brute_lines(docs, least=0.8):
    """Kept text per row; links of all pairs of lines."""
    where = {}
    for doc_id, text in docs:
        for pos, line in enumerate((text or "").split("\n")):
            if shingles(line):
                where.setdefault(line, []).append((-1 if doc_id is None else doc_id, pos))
    lines = sorted(where)
    sets = [shingles(x) for x in lines]
    parent = list(range(len(lines)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= least * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    first = {}
    for i, line in enumerate(lines):
        first[root(i)] = min(first.get(root(i), (1 << 60, 0)), min(where[line]))
    group = {line: root(i) for i, line in enumerate(lines)}
    out = []
    for doc_id, text in docs:
        if text is None:
            out.append((doc_id, None))
            continue
        me = -1 if doc_id is None else doc_id
        out.append((doc_id, "\n".join(
            x for pos, x in enumerate(text.split("\n")) if x not in group or first[group[x]] == (me, pos)
        )))
    return sorted(out, key=repr)


def test_line_dedup(spark, odd_docs, no_docs, prose):
    r = np.random.default_rng(2)
    more = []
    for i in range(60):
        text = []
        for j in range(6):
            w = prose(30, 50 + int(r.integers(0, 40))).split()
            if r.random() < 0.5:
                w[int(r.integers(0, 30))] = f"new{i}{j}"
            text.append(" ".join(w))
        more.append((100 + i, "\n".join(text) + "\n\n"))
    # A hot near-duplicate line in many variants, more than a small bucket.
    hot = prose(60, 7).split()
    more += [(500 + i, " ".join(hot[:59] + [f"end{i}"])) for i in range(80)]
    df = odd_docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    docs = [(x.doc_id, x.text) for x in df.collect()]
    assert sorted(rows(line_dedup.dedup_lines(df)), key=repr) == brute_lines(docs)
    assert line_dedup.dedup_lines(odd_docs).schema == odd_docs.schema
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_line_dedup_recall_on_given_documents(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    docs = [(x.doc_id, x.text) for x in df.collect()]
    assert sorted(rows(line_dedup.dedup_lines(df)), key=repr) == brute_lines(docs)


def character_shingles(line):
    """All 16 characters from each word begin on, and from every place inside a longer word."""
    found = set()
    for m in re.finditer("[^ \t\x0b\x0c\r]+", line):
        found.add(" ".join(re.split("[ \t\x0b\x0c\r]+", line[m.start():].strip(" \t\x0b\x0c\r")))[:16])
        found.update(m.group()[k : k + 16] for k in range(len(m.group()) - 15))
    return found


def kept_lines(spark, lines):
    """The lines that stay, each line given as a document of its own."""
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    return {x.doc_id for x in line_dedup.dedup_lines(df).collect() if x.text}


def first_of_each(lines, shingles_of):
    """The same by comparing all pairs."""
    sets, parent = [shingles_of(x) for x in lines], list(range(len(lines)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i for i in range(len(lines)) if root(i) == i}


def test_line_dedup_of_urls_and_unspaced_lines(spark):
    r = __import__("random").Random(4)
    han = ["".join(chr(0x4E00 + r.randrange(3000)) for _ in range(300)) for _ in range(3)]
    lines = ["https://www.example.com/about-us", "https://www.example.com/books", "https://www.example.com/shop/item/12345"]
    lines += [han[0], han[0][:16] + han[1], han[0][:16] + han[2], han[0][:150] + "x" + han[0][150:]]
    key = "".join(r.choice("0123456789abcdef") for _ in range(700))
    lines += [key, key[:699] + "g", key[:16] + key[::-1], "see the " + key, "internationalisation-one day", "internationalisation-two day"]
    want = first_of_each(lines, character_shingles)
    assert {0, 1, 2, 4, 5, 9, 11, 12} <= want and {6, 8}.isdisjoint(want)
    assert kept_lines(spark, lines) == want


def test_line_dedup_of_chains_in_a_large_bucket(spark):
    """Chains of lines, each like the next one only, all with so much in common that they share buckets."""
    r = __import__("random").Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(15))
    shared = [word() for _ in range(30)]
    lines = []
    for _ in range(6):
        own = [word() for _ in range(15)]
        for _ in range(40):
            lines.append(" ".join(x for pair in zip(shared[::2], own, shared[1::2]) for x in pair))
            own[len(lines) % 15] = word()
    want = first_of_each(lines, character_shingles)
    assert len(lines) == 240 and len(want) < 30
    assert kept_lines(spark, lines) == want


def test_line_dedup_of_lines_that_share_one_large_bucket(spark, monkeypatch):
    """A chain whose lines agree in one band only, all in the same one."""
    made = line_dedup._signatures
    monkeypatch.setattr(line_dedup, "_signatures", lambda lines: made(lines).withColumns(
        {f"m{k}": F.xxhash64("lid", F.lit(k)) if k > 1 else F.lit(0).cast("long") for k in range(line_dedup.HASHES)}
    ))
    words = [f"w{i:014d}" for i in range(100)]
    lines = [" ".join(words[i : i + 30]) for i in range(40)]
    want = first_of_each(lines, character_shingles)
    assert want == {0} and kept_lines(spark, lines) == want


def test_line_dedup_of_a_large_bucket_makes_no_row_per_pair_of_tiles(spark, monkeypatch):
    """What the lines of a large bucket are exploded into grows with their shingles, not with their number."""
    made, stored, held = line_dedup._signatures, line_dedup.store, []
    monkeypatch.setattr(line_dedup, "_signatures", lambda lines: made(lines).withColumns(
        {f"m{k}": F.xxhash64("lid", F.lit(k)) if k > 1 else F.lit(0).cast("long") for k in range(line_dedup.HASHES)}
    ))

    def store(df, label):
        table = stored(df, label)
        held.append((label, df._jdf.queryExecution().optimizedPlan().toString(), table.count()))
        return table

    monkeypatch.setattr(line_dedup, "store", store)
    r = __import__("random").Random(12)
    shared = [f"s{i:014d}" for i in range(20)]
    lines = [" ".join(shared + [f"w{r.randrange(60):014d}" for _ in range(12)]) for _ in range(90)]
    lines += [line + " end" for line in lines[:20]]
    want = first_of_each(lines, character_shingles)
    assert len(want) < len(lines) and kept_lines(spark, lines) == want
    assert not [label for label, plan, _ in held if label == "lines-links" and "explode(sequence(" in plan]
    assert [n for label, _, n in held if label == "lines-rarest" and n <= len(lines) * 8]


def test_line_dedup_makes_no_pairs_of_lines_with_three_shingles_in_common(spark, monkeypatch):
    """Lines of a bucket have at least four shingles in common, short lines too; of these each similar pair meets."""
    r = __import__("random").Random(21)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(15))
    same, stored, pairs = [word() for _ in range(3)], line_dedup.store, []

    def store(df, label):
        table = stored(df, label)
        pairs.extend([table.count()] if label == "lines-pairs" else [])
        return table

    monkeypatch.setattr(line_dedup, "store", store)
    lines = [" ".join(x for w in same for x in (w, word(), word())) + " end" for _ in range(60)]
    assert kept_lines(spark, [" ".join([*same, *(word() for _ in range(6))]) for _ in range(60)] + lines) == set(range(120))
    assert pairs == [0]
    near = []
    for n in range(8, 30):
        words = [word() for _ in range(n)]
        near += [" ".join(words), " ".join(words[:-1] + [word() for _ in range(max(1, (n + 1) // 10))])]
    assert kept_lines(spark, near) == first_of_each(near, character_shingles)


def test_line_dedup_of_short_words(spark):
    """Shingles are full-width where four words are not."""
    r = __import__("random").Random(8)
    lines = []
    for _ in range(12):
        w = [str(r.randrange(100)) for _ in range(60)]
        for edits in (0, 1, 2, 3):
            changed = list(w)
            for k in r.sample(range(60), edits):
                changed[k] = "x"
            lines.append(" ".join(changed))
    want = first_of_each(lines, character_shingles)
    four = lambda line: {" ".join(line.split()[i : i + 4])[:16] for i in range(60)}
    assert want != first_of_each(lines, four)
    assert kept_lines(spark, lines) == want


def test_line_dedup_keeps_columns_with_any_name(spark):
    df = spark.createDataFrame([(1, "one same line of words here\nother", 5, 6, 7, 8, 9), (2, "one same line of words here", 1, 2, 3, 4, 5)],
                               "doc_id long, text string, _line_row int, _gone_doc int, _GONE int, _new_text int, lid int")
    got = {r.doc_id: tuple(r) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: (1, "one same line of words here\nother", 5, 6, 7, 8, 9), 2: (2, "", 1, 2, 3, 4, 5)}


def test_line_dedup_in_many_tiles(spark, monkeypatch):
    """Chains in buckets that are cut into tiles give the same as all pairs."""
    monkeypatch.setattr(line_dedup, "TILE", 16)
    monkeypatch.setattr(line_dedup, "SMALL", 4)
    r = __import__("random").Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(15))
    lines = []
    for _ in range(5):
        base = [word() for _ in range(30)]
        for _ in range(30):
            lines.append(" ".join(base))
            base = list(base)
            for k in r.sample(range(30), 2):
                base[k] = word()
    want = first_of_each(lines, character_shingles)
    assert 5 <= len(want) < 80 and kept_lines(spark, lines) == want


# Pipeline ------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    before = docs.count()
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        out = stage(spark, docs, SMALL)
        if number < len(corpus_pipeline.STAGES):
            assert out.columns == names
        path = str(tmp_path / str(number))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if number == 1:
            labels = spark.read.parquet(f"{SMALL}/labels.parquet")
            kept = labels.join(docs, "doc_id", "left_semi").groupBy("quality").count().rdd.collectAsMap()
            whole = labels.groupBy("quality").count().rdd.collectAsMap()
            assert kept[1] >= 0.97 * whole[1] and kept.get(0, 0) <= 0.2 * whole[0]
            assert docs.count() < before
    assert docs.count() >= docs.select("doc_id").distinct().count() > 0.7 * before


def test_pipeline_of_odd_rows(spark, odd_docs, no_docs):
    import corpus_pipeline

    for table in (odd_docs, no_docs):
        docs = table.withColumn("n_chars", F.length("text").cast("long"))
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
        docs.collect()


def test_a_path_that_has_reached_the_end_is_not_searched_on():
    with open(MODEL, "rb") as file:
        transducer = Transducer(file.read())
    assert transducer._shortest_bpe("▁the") == ["▁the"]
    assert {before for before, _ in transducer._pairs} == {""}  # no piece is asked what follows it
