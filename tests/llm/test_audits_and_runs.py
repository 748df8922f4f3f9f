"""URL filter, filter audit and periodic runs against brute force."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from runtime_insights.llm import filter_audit, url_filter
from runtime_insights.llm.arrays import mix
from runtime_insights.llm.periodic_runs import find_runs, op13_periodic_runs, planted_period, runs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def by_text(value):
    return sorted(value, key=repr)


# Periodic runs ---------------------------------------------------------------------------------


def brute_runs(w, least=12):
    number, found = {}, {}
    a = np.array([number.setdefault(x, len(number)) for x in w], dtype=np.int64)
    for q in range(1, len(a) // 2 + 1):
        step = np.diff(np.concatenate(([0], a[:-q] == a[q:], [0])).astype(int))
        for begin, end in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)):
            length = int(end - begin + q)
            if length >= max(least, 2 * q):
                found.setdefault((int(begin), length), q)
    return sorted((begin, length, q) for (begin, length), q in found.items())


def collapsed(w, runs):
    gone = set()
    for begin, length, q in runs:
        gone.update(range(begin + q, begin + length))
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def runs_in_texts(texts, least=12):
    first = np.cumsum([0] + [len(t) for t in texts])
    h = mix(np.array([x + 1 for t in texts for x in t], dtype=np.uint64))
    got = [tuple(map(int, r)) for r in zip(*runs_of(h, first, least))]
    return [
        sorted((s - a, n, q) for s, n, q in got if a <= s < b) for a, b in zip(first[:-1], first[1:])
    ]


def patterns(r):
    """Texts of few words with squares in squares, Fibonacci words, and periods that meet or nearly do."""
    few, kind = r.choice([1, 2, 2, 3]), r.randrange(5)
    make = lambda n: [r.randrange(few) for _ in range(n)]
    if kind == 0:
        return make(r.randrange(160))
    if kind == 1:
        p, q = make(r.randrange(1, 9)), make(r.randrange(1, 9))
        return (p * 30)[: r.randrange(80)] + (q * 30)[: r.randrange(80)] + (p * 30)[: r.randrange(80)]
    if kind == 2:
        a, b = [0], [0, 1]
        for _ in range(r.randrange(3, 9)):
            a, b = b, b + a
        return b[:150]
    if kind == 3:
        w = ([0] * r.randrange(1, 12) + [1]) * 20
        w = w[: r.randrange(60)]
        return w + w[r.randrange(3):] + w
    w = ([0, 0, 1] * 30)[: r.randrange(60)]
    return ((w + [0] * r.randrange(3) + w) * 2)[:200]


def test_runs_equal_brute_force():
    r = random.Random(11)
    for _ in range(250):
        texts = [patterns(r) for _ in range(r.randrange(1, 5))]
        assert runs_in_texts(texts) == [brute_runs(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.integers(12, 30))
def test_runs_of_any_text(text, least):
    assert runs_in_texts([text], least) == [brute_runs(text, least)]


@pytest.mark.parametrize("text", [
    [0] * 300_000, [0, 1, 2] * 100_000, [0] * 100_000 + [1] + [0] * 100_000, ([0] * 500 + [1]) * 400,
])
def test_runs_of_very_long_periodic_texts_in_time(text):
    start = time.time()
    (found,) = runs_in_texts([text])
    assert time.time() - start < 60
    assert found and max(length for _, length, _ in found) >= 100_000


def test_runs_of_the_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op13_periodic_runs(spark, folder).collect()
    assert len(got) == len(docs)
    planted = 0
    for row in got:
        w = docs[row.doc_id]
        h = zlib.crc32(str(row.doc_id).encode())
        if h % 10 == 0 and w:
            planted += 1
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda x: (x[0], x[2])))
        assert tuple(row) == (
            row.doc_id, len(runs),
            *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest(),
        )
    assert planted > 5


def test_runs_of_odd_documents(spark, odd_docs, no_docs):
    extra = spark.createDataFrame(
        [(70, " ".join(["a b"] * 9) + "\nx"), (70, " ".join(["a b"] * 9) + "\nx"), (None, "é " * 20), (-5, "z " * 30)],
        "doc_id long, text string",
    )
    docs = odd_docs.unionByName(extra, allowMissingColumns=True).withColumn("runs", F.lit(1)).withColumn("n_words", F.lit("x"))
    want = []
    for doc_id, text in [(r.doc_id, r.text) for r in docs.collect()]:
        w = words(text)
        runs = brute_runs(w)
        want.append((doc_id, len(w), sorted(runs, key=lambda x: (x[0], x[2])), collapsed(w, runs)))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in find_runs(docs).collect()]
    assert by_text(got) == by_text(want)
    assert find_runs(no_docs).collect() == []
    with pytest.raises(ValueError):
        find_runs(docs, least=5)


def test_documents_without_id_or_words_are_not_made_periodic():
    assert planted_period(None, 50) is None
    assert planted_period(3, 0) is None


# Filter audit ----------------------------------------------------------------------------------


def brute_audit(docs, labels):
    """By the definition: every order applied to every document."""
    docs = [(d, t or "", lang or "") for d, t, lang in docs]
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    smallest = {}
    for d, t, _ in docs:
        if d is not None:
            smallest[t] = min(d, smallest.get(t, d))
    fails = []
    for d, t, part in docs:
        w = words(t)
        fails.append((d, part, {
            letter for letter, failed in zip("ABCDE", (
                len(w) < 200, 100 * len(set(w)) < 50 * len(w),
                100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t),
                d is not None and smallest[t] < d,
            )) if failed
        }))
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in fails}:
        mine = [(d, f) for d, p, f in fails if p == part]
        for order in permutations("ABCDE"):
            left, before = mine, []
            for step, letter in enumerate(order, 1):
                gone = [(d, f) for d, f in left if letter in f]
                redundant = sum(letter in f and bool(f & set(before)) for _, f in mine)
                left = [(d, f) for d, f in left if letter not in f]
                before.append(letter)
                shapley[part, letter] += len(gone)
                out[part, "".join(order), step] = (
                    len(left), len(gone), redundant, sum(f == {letter} for _, f in mine),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone),
                )
    return by_text((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def label_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, None), (4, 1, 1), (None, 1, 1), (8, 0, 0), (99, 1, 1), (9, 1, 0)]


def audit_rows(df):
    names = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    return by_text(tuple(r) for r in df.select(*names).collect())


@pytest.mark.parametrize("blocks,bucket_words", [(1, 500_000), (7, 50)])
def test_audit_equals_brute_force(spark, odd_docs, prose, monkeypatch, blocks, bucket_words):
    monkeypatch.setattr(filter_audit, "_BUCKET_WORDS", bucket_words)
    more = [(20, prose(400, 9) + " #", "xx"), (21, "same words " * 150, "xx"), (22, "LOUD " * 250, None), (23, "", "xx"),
            (24, prose(300, 8) + "|", "xx"), (None, "", "xx"), (-3, None, "en"), (25, "é" * 70_000, "en")]
    more = spark.createDataFrame(more, "doc_id long, text string, lang string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True).repartition(blocks)
    docs = docs.withColumn("mask", F.lit(3)).withColumn("digest", F.lit("d")).withColumn("shard", F.lit(1))
    labels = label_rows(spark, LABELS).withColumn("good", F.lit("x"))
    want = brute_audit([(r.doc_id, r.text, r.lang) for r in docs.collect()], LABELS)
    assert audit_rows(filter_audit.audit(docs, labels)) == want


def test_audit_of_nothing(spark, no_docs):
    assert filter_audit.audit(no_docs, label_rows(spark, LABELS)).collect() == []


def test_document_term_matrix(odd_docs, monkeypatch):
    """Every word has one number in all shards, and the cells are the counts of the words."""
    monkeypatch.setattr(filter_audit, "_BUCKET_WORDS", 40)
    docs = odd_docs.repartition(5)
    stored = filter_audit.store(filter_audit.shards(docs), "test-shards")
    numbers = filter_audit.dictionary(stored, 9).collect()
    first = [w for r in numbers for w in r.new_words]
    assert sorted(first) == sorted({w for r in docs.collect() for w in words(r.text)})
    meant, cells = {}, Counter()
    matrix = filter_audit.document_term_matrix(docs).collect()
    assert len(matrix) > 1
    texts = Counter(tuple(sorted(Counter(words(r.text)).values())) for r in docs.collect())
    for row in matrix:
        for a, b in zip(row.indptr, row.indptr[1:]):
            assert len(set(row.indices[a:b])) == b - a
            cells[tuple(sorted(row.data[a:b]))] += 1
            for i in row.indices[a:b]:
                meant[i] = True
    assert cells == texts and len(meant) == len(first)


# URL filter ------------------------------------------------------------------------------------


NAME = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def micro(x):
    return math.floor(math.log(x) * 1e6 + 0.5)


def brute_split(name, counts):
    """The best of all ways to cut a name."""
    total, best = sum(counts.values()), None
    for cuts in range(1 << (len(name) - 1)):
        at = [0] + [i + 1 for i in range(len(name) - 1) if cuts >> i & 1] + [len(name)]
        parts = [name[a:b] for a, b in zip(at, at[1:])]
        cost = sum(micro(total + 10) + (-micro(counts[p]) if p in counts else micro(10) * len(p)) for p in parts)
        # Equal costs: fewer words, then the longer last word, then the longer one before it ...
        key = (cost, len(parts), at[-2::-1])
        if best is None or key < best[0]:
            best = key, parts
    return best[1]


def brute_judge(pages, texts, rules):
    counts = Counter(lower(w) for t in texts for w in NAME.findall(t or ""))
    read = []
    for page_id, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        raw = re.match(r"[^/?#]*", rest)[0]
        host, path = lower(raw), re.match(r"[^?#]*", rest[len(raw):])[0]
        fitting = [(-len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = min(fitting, default=None)
        tokens = []
        for name in NAME.findall(host):
            tokens += ["h:" + w for w in (brute_split(name, counts) if len(name) <= 63 else [name])]
        tokens += ["p:" + ("0" if re.fullmatch("[0-9]+", w) else w) for w in NAME.findall(lower(path))]
        read.append((page_id, host, path, rule, tokens))
    size, model = Counter(), {"block": Counter(), "allow": Counter()}
    for *_, rule, tokens in read:
        if rule:
            size[rule[2]] += 1
            model[rule[2]].update(tokens)
    known = set(model["block"]) | set(model["allow"])
    total = {a: max(sum(model[a].values()) + len(known), 1) for a in model}
    out = []
    for page_id, host, path, rule, tokens in read:
        odds = micro(size["block"] + 1) - micro(size["allow"] + 1)
        for t in tokens:
            odds += micro(model["block"][t] + 1) - micro(model["allow"][t] + 1) + micro(total["allow"]) - micro(total["block"])
        if rule:
            out.append((page_id, host, path, rule[1], rule[2], None))
        else:
            out.append((page_id, host, path, None, "block" if odds > 0 else "allow", odds))
    return by_text(out)


URLS = [
    (1, "http://GoodSite.example.com/en/7"), (2, "https://badsite.net/x?y://z"), (3, "badsite.net/x"), (4, None), (5, ""),
    (6, "://"), (7, "http://net/"), (8, "http://net"), (9, "http://a.example.net/en/1#top"), (10, "http://a.example.net/fr/1"),
    (11, "x://notnet/"), (12, "http://b.org/fr/a/B/33"), (12, "http://b.org/fr/a/B/33"), (None, "http://b.org/frx"),
    (13, "http://the-badgood.org?/fr/"), (14, "http://example.com/de/é漢字/de"), (15, "http://badgood.io/fr/a/44/"),
    (16, "http://goodgoodbad.io/x"), (17, "ftp://" + "ab" * 40 + ".io/x"), (18, "http://bad.io:80/x y\nz"), (19, "http://..//"),
]
TEXTS = ["good site good the GOOD", None, "", "bad site bad a b example", "good bad the the net org com"]


def urls(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string")


@pytest.mark.parametrize("salted", [False, True])
def test_judged_urls_equal_brute_force(spark, monkeypatch, salted):
    if salted:
        from runtime_insights.operators import skew
        monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(skew, "is_small", lambda dim: False)
    corpus = spark.createDataFrame([(t,) for t in TEXTS], "text string").withColumn("word", F.lit(1))
    pages = urls(spark, URLS).withColumn("row", F.lit("x")).withColumn("rule", F.lit(0)).withColumn("host", F.lit(0))
    got = url_filter.judge(pages, corpus).collect()
    assert by_text(tuple(r) for r in got) == brute_judge(URLS, TEXTS, url_filter.RULES)


def test_urls_under_many_rules_without_a_corpus(spark):
    rules = [("block", f"d{i}.org", "/") for i in range(300)] + [("allow", "d7.org", "/"), ("block", "b.org", "/fr/a")]
    corpus = spark.createDataFrame([], "text string")
    rows = URLS[:14] + [(30 + i, f"http://www.d{i}.org/x") for i in range(0, 300, 7)]
    short = [r for r in rows if len(r[1] or "") < 40]
    got = url_filter.judge(urls(spark, short), corpus, rules).collect()
    assert by_text(tuple(r) for r in got) == brute_judge(short, [], rules)


def test_no_urls(spark):
    corpus = spark.createDataFrame([("a",)], "text string")
    assert url_filter.judge(urls(spark, []), corpus).collect() == []


def test_model_tells_kinds_of_sites_apart(spark):
    """Held-out hosts made of words that only blocked, or only allowed, hosts have."""
    r = random.Random(3)
    bad, good, both = ["casino", "pills", "bets"], ["garden", "school", "museum"], ["the", "my", "online"]
    make = lambda kind: r.choice(both) + r.choice(kind) + r.choice(both)
    rows = [(i, f"http://{make(bad)}.net/{i}") for i in range(60)] + [(100 + i, f"http://{make(good)}.org/fr/{i}") for i in range(60)]
    asked = [(1000 + i, f"http://{make(bad)}.io/{i}") for i in range(30)] + [(2000 + i, f"http://{make(good)}.io/{i}") for i in range(30)]
    corpus = spark.createDataFrame([(" ".join(bad + good + both) + " ",)] * 40, "text string")
    got = {x.page_id: x.verdict for x in url_filter.judge(urls(spark, rows + asked), corpus).collect()}
    assert sum(got[i] == ("block" if i < 2000 else "allow") for i, _ in asked) >= 57
