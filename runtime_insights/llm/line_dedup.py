"""Fuzzy line de-duplication by windows of ordered hashes, in DataFrame operations only.

Lines are the parts of a text between newlines. A line's character shingles are, from the begin
of each of its words on, the next ``WIDTH`` characters of the words with one blank
between, and in words longer than ``WIDTH`` (URLs, unspaced scripts, keys) the ``WIDTH`` characters
from every further position that has as many: each character is in a shingle. Two lines are linked if the Jaccard similarity of their shingles is at least ``least``. Of each connected group of lines the first
occurrence (smallest doc_id, then position) stays, all others go. Lines without a word stay.

Plan. The distinct 64-bit hashes of a line's shingles, in order, are a ring; four in a row are a window, a line of
n hashes has n. Lines that share a window are in one bucket. Of two lines with c hashes in common and d in one only, a
window is lost to each of the d at most four times, so c - 3 * d or more of them are shared: some at similarity 0.8. Lines of
at most ``HASHES`` hashes are in the buckets of all their windows, so no pair of them is missed; longer ones in those of the
windows behind ``_POINTS`` points, where lines of similarity 0.8 share none with a chance of about 3 in 100,000. Lines
with fewer than four hashes in common never meet (but equal sets), those of similarity 0.3 at a point with one of 8 in
1,000; so chance meetings, whose number grows with the square of the number of lines, stay few. Copies become one line,
with their number and first occurrence, before lines meet. All pairs of a small bucket are candidates. In a bucket of more than ``SMALL`` lines
each line first meets two members, other ones in each bucket. Candidates are verified on all their
shingles (as 64-bit hashes), linked ones are joined by a distributed union-find. Lines of large
buckets that then hold more than one component meet by their rarest shingles: with all shingles in
one order, two lines that are similar enough share one of the first ``n - 0.8 * n + 1`` of each. Sizes and then
shingles are compared inside that join: only links are written, and rows grow with the shingles, not with the
square of a bucket. So every pair that shares a window is verified or joined already.

Only a line's own shingles are gathered. The members of a bucket, two numbers each, are counted in one task; all else
that is hot meets small tables in joins that adaptive execution splits. Lines are known by a 64-bit hash.

Rows: documents with ``text`` without the lines that go. A null text stays null. A document
whose lines all go keeps an empty text. Rows without doc_id come first. Equal rows are treated
alike. An empty table gives no rows. Other columns pass through ``dedup_lines`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from runtime_insights.llm.tables import components, discard, row_key, store, unused

WIDTH, HASHES, SMALL, SIMILAR = 16, 28, 16, 0.8
TILE = 512  # read by nothing any more; a test sets it
_RUN, _POINTS = 4, 20  # hashes of a window; windows of a line of more than HASHES hashes
_MARKS = ("\t", "\x0b", "\x0c", "\r")  # white space beside the blank
# Each match is a word of at most WIDTH characters with its blank, or one character of a longer one until WIDTH are
# left; seen ahead are the characters of the shingle that begins there.
_SHINGLES = f"(?s)(?=(.{{1,{WIDTH}}}))(?:[^ ]{{1,{WIDTH}}}+(?: |\\z)|[^ ])"


def _plain(line: Column) -> Column:
    """The words with one blank between; lines with single blanks only, the usual ones, without a regular expression."""
    odd = line.startswith(" ") | line.endswith(" ")
    for mark in ("  ", *_MARKS):
        odd = odd | line.contains(mark)
    every = F.array_remove(F.split(line, f"[ {''.join(_MARKS)}]+"), "")
    return F.when(odd, F.array_join(every, " ")).otherwise(line)


def _hashes(line: Column) -> Column:
    """The distinct hashes of all shingles, in order."""
    shingles = F.regexp_extract_all(_plain(line), F.lit(_SHINGLES), F.lit(1))
    return F.sort_array(F.array_distinct(F.transform(shingles, lambda x: F.xxhash64(x))))


def _lines(docs: DataFrame) -> DataFrame:
    """``doc`` (the smallest number for none), ``row``, ``pos``, ``line``, ``lid`` of all lines that hold a word."""
    return (
        docs.select(
            F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), "row",
            F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"),
        )
        .filter(F.trim(F.col("line"), F.lit(f" {''.join(_MARKS)}")) != "")
        .withColumn("lid", F.xxhash64("line"))
    )


def _place() -> Column:
    """A number for the place of a line, to pick one of its copies."""
    return F.xxhash64("doc", "pos")


def _signatures(lines: DataFrame) -> DataFrame:
    """One row per distinct line: ``lid``, ``copies``, ``doc`` (first), ``place`` (of one copy), m0, m1, ... (the
    hashes of its windows; null: no more)."""
    # The hashes are a ring, cut by points spread evenly over all numbers: a window begins behind each of them.
    points = [k * (2**64 // _POINTS) - 2**63 for k in range(_POINTS)]
    sets = lines.select("lid", "doc", _place().alias("place"), _hashes(F.col("line")).alias("s"))
    rings = sets.select(
        "lid", "doc", "place", "s", F.concat("s", F.slice("s", 1, _RUN)).alias("ring"),
        F.when(F.size("s") > HASHES, F.sort_array(F.concat("s", F.array(*[F.lit(p) for p in points])))).alias("cut"),
    )
    behind = [F.array_position("cut", F.lit(p)).cast("int") - k - 1 for k, p in enumerate(points)]
    begins = F.when(F.col("cut").isNull(), F.sequence(F.lit(0), F.size("s") - 1)).otherwise(F.array(*behind))
    window = ", ".join(f"get(ring, i + {j})" for j in range(_RUN))
    windows = rings.withColumn("begins", begins).select(
        "lid", "doc", "place", F.expr(f"transform(begins, i -> xxhash64({window}))").alias("windows")
    )
    return windows.groupBy("lid").agg(
        F.count("*").alias("copies"), F.min("doc").alias("doc"), F.min("place").alias("place"),
        *[F.min(F.get("windows", F.lit(k))).alias(f"m{k}") for k in range(HASHES)],
    )


def _banded(signatures: DataFrame) -> DataFrame:
    """``lid``, ``copies``, ``doc``, ``place`` and the ``buckets`` of the line (one may be null)."""
    windows = F.array(*[f"m{k}" for k in range(HASHES)])
    return signatures.select("lid", "copies", "doc", "place", F.array_distinct(windows).alias("buckets"))


def _all_pairs(members: DataFrame) -> DataFrame:
    """Pairs of the buckets with at most SMALL members: ``a`` < ``b``."""
    other = members.select("bucket", F.col("lid").alias("b"))
    return members.select("bucket", F.col("lid").alias("a")).join(other, "bucket").filter("a < b").select("a", "b")


def _candidates(signatures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs to verify first, and the members of the large buckets: ``bucket``, ``lid``."""
    # One shuffle serves both sides of the join.
    members = signatures.select("lid", F.explode("buckets").alias("bucket")).filter("bucket IS NOT NULL").repartition("bucket")
    # Other ends in each bucket: the lines whose numbers are least and greatest after xor with the bucket's.
    mixed = F.col("lid").bitwiseXOR(F.col("bucket"))
    sizes = members.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min(mixed).alias("low"), F.max(mixed).alias("high")
    ).filter("n > 1").withColumns({end: F.col(end).bitwiseXOR(F.col("bucket")) for end in ("low", "high")})
    shared = store(members.join(sizes.hint("shuffle_hash"), "bucket"), "lines-shared")
    small = _all_pairs(shared.filter(F.col("n") <= SMALL))
    large = shared.filter(F.col("n") > SMALL)
    ends = large.select("lid", F.explode(F.array("low", "high")).alias("end")).filter("lid <> end").select(
        F.least("lid", "end").alias("a"), F.greatest("lid", "end").alias("b")
    )
    pairs = store(small.union(ends).distinct(), "lines-pairs")
    large = store(large.select("bucket", "lid"), "lines-large")
    discard(shared)
    return pairs, large


def _links_in_large(large: DataFrame, links: DataFrame, shingles: DataFrame, least: float) -> DataFrame | None:
    """Links of the large buckets that ``links`` do not join yet: ``a`` < ``b``."""
    member = store(components(links, "lines-components"), "lines-met")
    named = large.join(member.withColumnRenamed("node", "lid"), "lid", "left").withColumn(
        "component", F.coalesce("component", "lid")
    )
    named = store(named, "lines-named")
    split = named.groupBy("bucket").agg(
        F.min("component").alias("least"), F.max("component").alias("most")
    ).filter("least <> most").select("bucket")
    whole = store(named.join(split, "bucket").select("lid", "component").distinct(), "lines-split")
    discard(member, named)
    if whole.isEmpty():
        return None
    sets = whole.join(shingles, "lid")
    firsts = store(_rarest(sets, least), "lines-rarest")
    left = firsts.join(sets, "lid").select("h", F.col("lid").alias("l"), F.col("component").alias("lc"), F.col("first").alias("lf"), F.col("s").alias("sl"))
    right = firsts.join(sets, "lid").select("h", F.col("lid").alias("r"), F.col("component").alias("rc"), F.col("first").alias("rf"), F.col("s").alias("sr"))
    # Two lines are compared once, where they meet by the first shingle that both have.
    pairs = left.join(right, "h").filter("lc <> rc AND l < r").filter(_near_sizes("sl", "sr", least)).filter(
        "array_intersect(lf, rf)[0] = h"
    ).filter(_similar("sl", "sr", least)).select(F.col("l").alias("a"), F.col("r").alias("b"))
    found = store(pairs, "lines-links")
    discard(whole, firsts)
    return found


def _rarest(sets: DataFrame, least: float) -> DataFrame:
    """``lid``, ``first``, ``h`` (each of them): of each line the shingles by which it can meet another component. With all shingles in one
    order, two lines that are similar enough share one of the first ``n - least * n + 1`` of each; the order
    is by the number of lines, so these are its rarest. Those of one component only are left out."""
    held = sets.select("lid", "component", F.explode("s").alias("h"))
    shared = held.groupBy("h").agg(
        F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")
    ).filter("n > 1").select("h", "n", F.expr("low <> high").alias("mixed"))
    # Shingles of no other line would come first of all; they only shorten what follows.
    ranked = held.select("lid", "h").join(shared, "h").groupBy("lid").agg(
        F.sort_array(F.collect_list(F.struct("n", "h", "mixed"))).alias("ranked")
    ).join(sets.select("lid", (1 - F.ceil(F.lit(least) * F.size("s") - 1e-9)).alias("rest")), "lid")
    length = F.greatest(F.lit(0), F.col("rest") + F.size("ranked")).cast("int")
    first = F.filter(F.slice("ranked", F.lit(1), length), lambda e: e["mixed"])
    return ranked.select("lid", F.transform(first, lambda e: e["h"]).alias("first")).select("lid", "first", F.explode("first").alias("h"))


def _near_sizes(a: str, b: str, least: float) -> Column:
    """Sizes can rule out that two sets are similar enough before they are met."""
    return (F.size(a) >= F.lit(least) * F.size(b)) & (F.size(b) >= F.lit(least) * F.size(a))


def _similar(a: str, b: str, least: float) -> Column:
    """Whether two sets are similar enough."""
    common = F.size(F.array_intersect(a, b))
    return _near_sizes(a, b, least) & (common >= F.lit(least) * (F.size(a) + F.size(b) - common))


def _shingles(wanted: DataFrame, signatures: DataFrame, lines: DataFrame) -> DataFrame:
    """``lid``, ``s`` (distinct hashes of all shingles) of the wanted lines, from one copy of each."""
    wanted = store(wanted.join(signatures.select("lid", "place"), "lid"), "lines-wanted")
    found = lines.select("lid", _place().alias("place"), "line").join(wanted.hint("shuffle_hash"), ["lid", "place"])
    once = found.dropDuplicates(["lid", "place"])
    shingles = store(once.select("lid", _hashes(F.col("line")).alias("s")), "lines-shingles")
    discard(wanted)
    return shingles


def _verified(pairs: DataFrame, shingles: DataFrame, least: float) -> DataFrame:
    links = (
        pairs.join(shingles.select(F.col("lid").alias("a"), F.col("s").alias("sa")), "a")
        .join(shingles.select(F.col("lid").alias("b"), F.col("s").alias("sb")), "b")
        .filter(_similar("sa", "sb", least)).select("a", "b").distinct()
    )
    return store(links, "lines-links")


def _lines_that_go(docs: DataFrame, least: float) -> DataFrame:
    """``doc``, ``row``, ``gone`` (positions). ``docs``: ``doc_id``, ``row``, ``text``."""
    lines = _lines(docs)
    signatures = store(_banded(_signatures(lines)), "lines-signatures")
    pairs, large = _candidates(signatures)
    # Each line of a large bucket is in a pair with an end of it.
    wanted = pairs.select(F.col("a").alias("lid")).union(pairs.select(F.col("b").alias("lid"))).distinct()
    shingles = _shingles(wanted, signatures, lines)
    links = _verified(pairs, shingles, least)
    more = None if large.isEmpty() else _links_in_large(large, links, shingles, least)
    discard(shingles)
    if more is not None:
        links = links.union(more)
    member = store(components(links, "lines-components"), "lines-members").withColumnRenamed("node", "lid")
    first = signatures.select("lid", "copies", "doc")
    groups = first.join(member, "lid")
    stays = groups.groupBy("component").agg(F.min("doc").alias("stays"))
    repeated = groups.join(stays, "component").select("lid", "component", "stays").union(
        first.filter("copies > 1").join(member, "lid", "left_anti").select(
            "lid", F.col("lid").alias("component"), F.col("doc").alias("stays")
        )
    )
    repeated = store(repeated, "lines-repeated")
    found = store(lines.select("doc", "row", "pos", "lid").join(repeated, "lid").drop("lid"), "lines-found")
    at = found.filter("doc = stays").groupBy("component").agg(F.min("pos").alias("at"))
    gone = found.join(at, "component").filter("doc <> stays OR pos <> at")
    gone = store(gone.groupBy("doc", "row").agg(F.collect_set("pos").alias("gone")), "lines-gone")
    discard(signatures, pairs, large, repeated, found)
    return gone


def dedup_lines(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """``docs`` with the remaining lines in ``text``; ``n_chars`` follows where there is one."""
    names = docs.columns
    # Work names that no column of the input has, in whatever case.
    key, id_name, gone_doc, gone_row, gone_at, new_text = unused(
        names, "line_row", "line_doc", "gone_doc", "gone_row", "gone", "new_text")
    keyed = docs.withColumn(id_name, F.col("doc_id").cast("long")).withColumn(key, row_key("doc_id", "text"))
    gone = _lines_that_go(keyed.select(F.col(id_name).alias("doc_id"), F.col(key).alias("row"), F.col("text")), least)
    gone = gone.select(F.col("doc").alias(gone_doc), F.col("row").alias(gone_row), F.col("gone").alias(gone_at))
    same_doc = F.coalesce(F.col(id_name), F.lit(-(2**63))) == F.col(gone_doc)
    joined = keyed.join(gone, (F.col(key) == F.col(gone_row)) & same_doc, "left")
    kept = F.array_join(
        F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone_at, i)), "\n"
    )
    text = F.when(F.col(gone_at).isNull(), F.col("text")).otherwise(kept)
    joined = joined.withColumn(new_text, text)
    columns = [
        F.col(new_text).alias(c) if c == "text"
        else F.length(new_text).cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars"
        else F.col(f"`{c}`") for c in names
    ]
    return joined.select(*columns)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    before = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    return dedup_lines(docs).select(
        "doc_id", before.cast("long").alias("n_lines"),
        F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("kept_sha256"),
    )
