"""URL filter: rules first, then naive Bayes over the words of host and path.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; the path what
then follows up to ``?``, ``#`` or the end. A rule (action, host, path) fits its host and all
subdomains if the path starts with the rule's; the longest rule that fits decides (of equally long
ones the smallest text; of one rule with both actions, allow). Where none fits, the model decides.

Model. Names are the parts of a host between characters that are neither letter nor digit (beyond ASCII all are
letters). Names concatenate words: a unigram model over all words of a corpus splits each into the words of
the smallest total cost, by Viterbi. A word seen c times of N costs ln(N + 10) - ln(c), an
unknown one of k characters ln(N + 10) + k ln(10); of equal costs fewer words win, then the longer last
word. Names beyond 63 characters are none (RFC 1035) and one word. Path words are the parts of the path in lower case; numbers are one word. Multinomial
naive Bayes with add-one smoothing learns from all urls that a rule decides, and blocks a url if
its log odds are above zero. All logarithms are integers of a millionth.

Plan. Urls are parsed and stored with a row number. Distinct hosts, their distinct names, and the substrings of
these are the only things met with the corpus's word counts; a host's words and rules come back to its urls
in a join that is broadcast if small, else salted, as hosts and words are hot. Word counts per class are
combined on the map side. Viterbi takes one name with its known substrings (at most 2,016) at a time.

Rows: one per input row: ``page_id``, ``host``, ``path``, ``rule`` (null if none fits), ``verdict``, ``log_odds`` (null
if a rule decides). Null urls and those without ``://`` have empty host and path: no rule fits, the model has no
words and goes by the classes' sizes. Repeated rows repeat, and count as often. Rows without page_id are like others.
Without any url that a rule decides, or without a corpus, all else is the same; equal odds allow. Other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from runtime_insights.llm.tables import columns_or_null, discard, store
from runtime_insights.operators.skew import salted_lookup

#: Action, host, path: the rules of the registered query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LONGEST_NAME = 63
#: Letters and digits; everything beyond ASCII counts as a letter.
_WORD = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _log(count) -> Column:
    return F.floor(F.log(count) * 1e6 + 0.5).cast("long")


def _lower(text) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _words(text) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(1))


def host_and_path(url) -> tuple[Column, Column]:
    found = F.instr(url, "://")
    rest = F.when(found > 0, F.substring(url, found + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return _lower(host), path


def word_counts(docs: DataFrame) -> DataFrame:
    """``word``, ``n``: all words of all texts, A-Z in lower case."""
    words = columns_or_null(docs, {"text": "string"}).select(F.explode(_words(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).groupBy(_lower("word").alias("word")).agg(
        F.sum("n").alias("n")
    )


def split_name(name: str, costs: dict[tuple[int, int], int], unknown: int, letter: int) -> list[str]:
    """The words of smallest total cost. ``costs``: of the known words, by start and end."""
    best = [(0, 0, 0)]
    for end in range(1, len(name) + 1):
        best.append(min(
            (best[start][0] + costs.get((start, end), unknown + letter * (end - start)), best[start][1] + 1, start)
            for start in range(end)
        ))
    out, end = [], len(name)
    while end:
        start = best[end][2]
        out.append(name[start:end])
        end = start
    return out[::-1]


def segment(names: DataFrame, counts: DataFrame) -> DataFrame:
    """``name``, ``words``: each distinct name of at most 63 characters, split by the unigram model."""
    names = store(names.select("name").distinct(), "url-names")
    substrings = names.select(
        "name", F.explode(F.sequence(F.lit(0), F.length("name") - 1)).alias("start")
    ).select(
        "name", "start", F.explode(F.expr("sequence(start + 1, length(name))")).alias("end")
    ).withColumn("word", F.expr("substring(name, start + 1, end - start)"))
    counts = store(counts, "url-word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    # Only words that are a substring of some name; both sides have each word once.
    known = store(
        counts.join(substrings.select("word").distinct(), "word").select("word", _log(F.col("n")).alias("gain")),
        "url-known-words",
    )
    unknown, letter = _micro_log(total + 10), _micro_log(10)
    edges = salted_lookup(substrings, known, ["word"], ["name", "start"], "inner").groupBy("name").agg(
        F.collect_list(F.struct("start", "end", "gain")).alias("edges")
    )

    def split(batches):
        for batch in batches:
            found = [
                split_name(name, {(e["start"], e["end"]): unknown - e["gain"] for e in edges or ()}, unknown, letter)
                for name, edges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.string()))], ["name", "words"]
            )

    return names.join(edges, "name", "left").mapInArrow(split, "name string, words array<string>")


def _host_facts(hosts: DataFrame, counts: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``host``, ``words`` in order, and ``rules`` of it and the domains it belongs to."""
    spark = hosts.sparkSession
    pieces = store(
        hosts.select("host", F.posexplode(_words(F.col("host"))).alias("place", "name")), "url-pieces"
    )
    short = F.length("name") <= LONGEST_NAME
    split = store(segment(pieces.filter(short), counts), "url-segments")
    words = salted_lookup(pieces, split, ["name"], ["host"]).select(
        "host", F.struct("place", F.coalesce("words", F.array("name")).alias("words")).alias("piece")
    ).groupBy("host").agg(F.array_sort(F.collect_list("piece")).alias("pieces")).select(
        "host", F.flatten("pieces.words").alias("words")
    )
    table = store(
        spark.createDataFrame(
            [(h, p, f"{h}{p}", a) for a, h, p in rules], "domain string, path string, rule string, action string"
        ).groupBy("domain").agg(F.collect_list(F.struct("path", "rule", "action")).alias("rules")), "url-rules",
    )
    # The host itself, and what follows each of its dots.
    labels = F.split("host", r"\.")
    domains = hosts.withColumn("labels", labels).select(
        "host", F.explode(F.expr("transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels)), '.'))"))
        .alias("domain"),
    )
    fitting = salted_lookup(domains, table, ["domain"], ["host"], "inner").groupBy("host").agg(
        F.flatten(F.collect_list("rules")).alias("rules")
    )
    return hosts.join(words, "host", "left").join(fitting, "host", "left")


def judge(
    pages: DataFrame, corpus: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES
) -> DataFrame:
    """The rule or else the model's verdict on every url; ``corpus`` has the texts of the unigram model."""
    host, path = host_and_path(F.col("url"))
    urls = store(
        columns_or_null(pages, {"page_id": "long", "url": "string"})
        .select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
        .withColumn("row", F.monotonically_increasing_id()), "urls",
    )
    hosts = store(urls.select("host").distinct(), "url-hosts")
    facts = store(_host_facts(hosts, word_counts(corpus), rules), "url-host-facts")
    # The longest rule whose path the url's begins with.
    decided = F.expr(
        "array_min(transform(filter(rules, r -> startswith(path, r.path)), "
        "r -> struct(-length(r.rule) as shorter, r.rule as rule, r.action as action)))"
    )
    path_words = F.transform(_words(_lower("path")), lambda w: F.when(w.rlike("^[0-9]+$"), "0").otherwise(w))
    tokens = F.concat(
        F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.concat(F.lit("h:"), w)),
        F.transform(path_words, lambda w: F.concat(F.lit("p:"), w)),
    )
    read = store(
        salted_lookup(urls, facts, ["host"], ["row"]).withColumn("decided", decided).select(
            "row", "page_id", "host", "path", "decided.rule", "decided.action", tokens.alias("tokens")
        ), "url-tokens",
    )
    discard(urls, hosts, facts)
    model, prior, per_word = train(read.filter("action IS NOT NULL"))
    scored = salted_lookup(
        read.filter("action IS NULL").select("row", F.explode("tokens").alias("token")), model, ["token"], ["row"], "left"
    ).groupBy("row").agg((F.sum(F.coalesce("weight", F.lit(0)) + per_word) + prior).alias("log_odds"))
    odds = F.when(F.col("action").isNull(), F.coalesce("log_odds", F.lit(prior)))
    return read.join(scored, "row", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("action", F.when(odds > 0, "block").otherwise("allow")).alias("verdict"),
        odds.cast("long").alias("log_odds"),
    )


def train(read: DataFrame) -> tuple[DataFrame, int, int]:
    """Naive Bayes of ``tokens`` by ``action``: the weight of each token (stored), the prior, and what
    every token, known or not, adds. All are log odds for blocking."""
    is_block = F.col("action") == "block"
    sizes = read.agg(F.count_if(is_block), F.count_if(~is_block)).head()
    counts = store(
        read.select(is_block.alias("b"), F.explode("tokens").alias("token"))
        .groupBy("token").agg(F.count_if("b").alias("block"), F.count_if(~F.col("b")).alias("allow")), "url-model",
    )
    n, block, allow = counts.agg(
        F.count("*"), F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("allow"), F.lit(0))
    ).head()
    prior = _micro_log(sizes[0] + 1) - _micro_log(sizes[1] + 1)
    per_word = _micro_log(max(allow + n, 1)) - _micro_log(max(block + n, 1))
    return counts.select("token", (_log(F.col("block") + 1) - _log(F.col("allow") + 1)).alias("weight")), prior, per_word


def _micro_log(x: float) -> int:
    return math.floor(math.log(x) * 1e6 + 0.5)


def op11_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH RECURSIVE rest AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest),
u AS (SELECT row_number() OVER () AS r, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM cut),
rules(action, domain, start) AS (
    VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
decided AS (SELECT r, page_id, host, path, first(domain || start ORDER BY length(domain || start) DESC, domain || start) AS rule,
                   first(action ORDER BY length(domain || start) DESC, domain || start) AS action
            FROM u LEFT JOIN rules ON starts_with(path, start) AND (host = domain OR ends_with(host, '.' || domain))
            GROUP BY r, page_id, host, path),
corpus AS (SELECT translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
           FROM (SELECT unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM documents) GROUP BY 1),
size AS (SELECT floor(ln(coalesce(sum(n), 0) + 10) * 1e6 + 0.5)::BIGINT AS unknown, floor(ln(10) * 1e6 + 0.5)::BIGINT AS letter FROM corpus),
hosts AS (SELECT host, unnest(names) AS name, generate_subscripts(names, 1) AS place
          FROM (SELECT host, regexp_extract_all(host, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS names FROM (SELECT DISTINCT host FROM u))),
names AS (SELECT DISTINCT name FROM hosts WHERE length(name) <= 63),
starts AS (SELECT name, unnest(range(0, length(name))) AS a FROM names),
subs AS (SELECT name, a, unnest(range(a + 1, length(name) + 1)) AS b FROM starts),
costs AS (SELECT name, map_from_entries(list((a * 64 + b, unknown + CASE WHEN n IS NULL THEN letter * (b - a)
                 ELSE -floor(ln(n) * 1e6 + 0.5)::BIGINT END))) AS cost
          FROM subs LEFT JOIN corpus ON w = substr(name, a + 1, b - a), size GROUP BY name),
viterbi AS (
    SELECT name, 0 AS i, [{'c': 0::BIGINT, 'k': 0::BIGINT, 'a': 0::BIGINT}] AS best, [[]::VARCHAR[]] AS words FROM names
    UNION ALL
    SELECT name, i + 1, list_append(best, s),
           list_append(words, list_append(words[s.a + 1], substr(name, (s.a + 1)::BIGINT, (i + 1 - s.a)::BIGINT)))
    FROM (SELECT v.*, list_min([{'c': best[a + 1].c + cost[a * 64 + v.i + 1], 'k': best[a + 1].k + 1, 'a': a}
                                FOR a IN range(0, v.i + 1)]) AS s
          FROM viterbi v JOIN costs USING (name) WHERE v.i < length(name))),
split AS (SELECT name, words[i + 1] AS words FROM viterbi WHERE i = length(name)),
host_words AS (SELECT host, 'h:' || unnest(coalesce(words, [hosts.name])) AS token FROM hosts LEFT JOIN split USING (name)),
path_words AS (SELECT r, unnest(regexp_extract_all(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM u),
tokens AS (SELECT r, token FROM u JOIN host_words USING (host)
           UNION ALL SELECT r, 'p:' || CASE WHEN regexp_full_match(w, '[0-9]+') THEN '0' ELSE w END FROM path_words),
model AS (SELECT token, count(*) FILTER (action = 'block') AS b, count(*) FILTER (action = 'allow') AS a
          FROM tokens JOIN decided USING (r) WHERE action IS NOT NULL GROUP BY token),
const AS (SELECT floor(ln(greatest(count(*) + coalesce(sum(a), 0), 1)) * 1e6 + 0.5)::BIGINT
                 - floor(ln(greatest(count(*) + coalesce(sum(b), 0), 1)) * 1e6 + 0.5)::BIGINT AS each FROM model),
prior AS (SELECT floor(ln(count(*) FILTER (action = 'block') + 1) * 1e6 + 0.5)::BIGINT
                 - floor(ln(count(*) FILTER (action = 'allow') + 1) * 1e6 + 0.5)::BIGINT AS prior FROM decided),
score AS (SELECT r, sum(each + coalesce(floor(ln(b + 1) * 1e6 + 0.5)::BIGINT - floor(ln(a + 1) * 1e6 + 0.5)::BIGINT, 0)) AS s
          FROM tokens LEFT JOIN model USING (token), const GROUP BY r),
odds AS (SELECT page_id, host, path, rule, action,
                CASE WHEN action IS NULL THEN (prior + coalesce(s, 0))::BIGINT END AS log_odds
         FROM decided LEFT JOIN score USING (r), prior)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN log_odds > 0 THEN 'block' ELSE 'allow' END) AS verdict, log_odds
FROM odds
"""
