"""Line dedup by content-defined chunks of lines, with DataFrame functions only.

Lines are hashed, and a rolling hash over WINDOW line hashes chooses boundaries: a
chunk ends after a line where the hash of the window that ends there is 0 modulo
DIVISOR, and begins before a line where that of the window that begins there is
1.  A line of more than LONG_CHARS characters stands alone.  A boundary depends on
the lines beside it alone, so lines put in or taken out elsewhere don't move it.

What is compared is a chunk of several lines and every two neighbouring chunks,
so that chunks that repeat together are found as one stretch, however long; and a
single line of more than LONG_WORDS words, as passages are often written on one
line.  Of such a stretch that occurs again anywhere in the table, all but the first
occurrence go.  Hashes only nominate: stretches are grouped by their bytes before
one is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import BitFilter, fresh, looked_up, row_key, stash, whole_text

WINDOW = 1
DIVISOR = 2
#: Lines and words that a stretch must have to be removed.
LEAST_LINES = 2
LEAST_WORDS = 4
#: Words above which a single line is removed too, and characters above which it may have them.
LONG_WORDS = 50
LONG_CHARS = 2 * LONG_WORDS
_BASE = 31
_PRIME = 2147483647

_WORD = r"[^\x20\x09-\x0D]+"


def _stretches(window: int, divisor: int) -> str:
    """SQL: the stretches (a first line from 0, n lines, h a hash) of the lines ``t``."""
    hashes = "transform(t, x -> cast(conv(substring(md5(x), 1, 8), 16, 10) as long))"
    rolled = " + ".join(f"pmod(get(h, i - {k}) * {_BASE**k}L, {_PRIME}L)" for k in range(window))
    turns = f"transform(h, (v, i) -> if(i < {window - 1}, null, pmod(pmod({rolled}, {_PRIME}L), {divisor}L)))"
    long = f"transform(t, x -> length(x) > {LONG_CHARS})"
    ends = f"filter(sequence(0, size(t) - 1), i -> i = size(t) - 1 or get(s, i) or get(s, i + 1) or get(r, i) = 0L or get(r, i + {window}) = {1 % divisor}L)"
    chunks = "transform(e, (to, k) -> named_struct('a', if(k = 0, 0, get(e, k - 1) + 1), 'n', to - if(k = 0, -1, get(e, k - 1))))"
    found = (
        "transform(concat(filter(c, x -> x.n > 1 or get(s, x.a)), transform(slice(c, 1, size(c) - 1), (x, k) -> named_struct('a', x.a, 'n', x.n + get(c, k + 1).n))),"
        " x -> named_struct('a', x.a, 'n', x.n, 'h', xxhash64(slice(t, x.a + 1, x.n))))"
    )
    for name, value in (("c", chunks), ("e", ends), ("s", long), ("r", turns), ("h", hashes)):
        found = f"transform(array({value}), {name} -> {found})[0]"
    return found


def stretches(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """row, doc_id, key (a hash of the text) and stretches of the rows that have any."""
    lines = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.split(whole_text(), "\n").alias("lines"))
    found = lines.select("row", "doc_id", "key", F.expr(f"transform(array(lines), t -> {_stretches(window, divisor)})[0]").alias("each"))
    return found.filter(F.size("each") > 0)


def _nominated(docs: DataFrame, window: int, divisor: int) -> DataFrame:
    """_id, _key, first row, copies and the stretches whose hash may occur again, one row per
    doc_id and text."""
    found = stash(stretches(docs, window, divisor), "stretches")
    hashes = stash(found.select(F.explode("each.h").alias("h")).groupBy("h").count().filter("count > 1").select("h"), "repeated-hashes")
    each = found.select("row", "doc_id", "key", F.explode("each").alias("x")).select("row", "doc_id", "key", "x.a", "x.n", "x.h")
    twice = BitFilter(hashes, "h", hashes.count()).told(each, F.col("h"), "may").filter("may")
    copies = twice.groupBy("doc_id", "key").agg(F.min("row").alias("row"), F.count("*").alias("n"), F.collect_set(F.struct("a", "n")).alias("each"))
    times = (F.col("n") / F.size("each")).cast("long").alias("copies")  # equal texts have equal stretches
    return stash(copies.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "row", times, "each"), "nominated")


def removed_lines(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, least_lines: int = LEAST_LINES, least_words: int = LEAST_WORDS) -> DataFrame:
    """_id, _key, copies, and the numbers (from 0) of the lines that go: ``gone`` in
    the first row with that doc_id and text, ``gone_again`` in its copies.

    The first occurrence, by (doc_id, nulls last, row, line), of every stretch stays.
    """
    docs = docs.select("doc_id", "text")
    found = looked_up(docs, _nominated(docs, window, divisor), "inner")
    texts = found.select("doc_id", row_key().alias("key"), "row", "copies", F.split(whole_text(), "\n").alias("lines"), F.explode("each").alias("x"))
    texts = texts.select("doc_id", "key", "row", "copies", "x.a", "x.n", F.expr("array_join(slice(lines, x.a + 1, x.n), '\n')").alias("text"))
    words = F.regexp_count("text", F.lit(_WORD))
    texts = texts.filter(((F.col("n") >= least_lines) & (words >= least_words)) | (words > LONG_WORDS)).withColumn("sha", F.unhex(F.sha2("text", 256)))
    texts = stash(texts, "stretch-texts")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").cast("long").alias("id"), "row", "a")
    same = texts.groupBy("sha", "text").agg(F.min(place).alias("first"), F.count("*").alias("times"))
    # one text per digest, or none of them is touched
    firsts = same.groupBy("sha").agg(F.count("*").alias("texts"), F.max("times").alias("times"), F.first("first").alias("first")).filter("texts = 1 and times > 1")
    # written, so that the join deals both sides itself and can split a stretch that a third of the rows share
    firsts = stash(firsts.select(F.col("sha").alias("_sha"), "first"), "firsts")
    both = texts.drop("text").join(firsts, F.col("sha") == F.col("_sha"))
    span = F.sequence("a", F.col("a") + F.col("n") - 1)
    each = both.select(F.col("doc_id").cast("long").alias("_id"), F.col("key").alias("_key"), "copies", F.when(place != F.col("first"), span).alias("gone"), F.when(F.col("copies") > 1, span).alias("gone_again"))
    rows = each.groupBy("_id", "_key", "copies").agg(*[F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in ("gone", "gone_again")])
    return stash(rows.filter((F.size("gone") > 0) | (F.size("gone_again") > 0)), "gone-lines")


def _with_gone(docs: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """``docs`` with the numbers of the lines that go (null: none) as ``column``."""
    id_, key, copies, again = fresh(docs.withColumn(column, F.lit(0)), "id", "key", "copies", "again")
    side = gone.toDF(id_, key, copies, column, again)
    repeated = side.filter(F.col(copies) > 1)
    once = looked_up(docs, side, "left")
    if repeated.isEmpty():
        return once.drop(copies, again)
    # rows that repeat both doc_id and text: the first keeps what ``gone`` leaves, the others what ``gone_again`` leaves
    at, least, first_at = fresh(once, "at", "least", "first_at")
    several = stash(once.filter(F.col(copies) > 1).withColumns({at: F.monotonically_increasing_id(), key: row_key()}), "repeated-rows")
    firsts = several.groupBy(F.col("doc_id").cast("long").alias(id_), F.col(key).alias(least)).agg(F.min(at).alias(first_at))
    first = several.join(firsts, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(least)))
    told = first.withColumn(column, F.when(F.col(at) == F.col(first_at), F.col(column)).otherwise(F.col(again))).select(*docs.columns, column)
    return once.filter(F.coalesce(F.col(copies), F.lit(1)) == 1).select(*docs.columns, column).unionByName(told)


def _kept(lines: str, gone: str) -> Column:
    """The lines that stay, in order."""
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    return F.transform(F.array(F.col(lines)), lambda t: F.transform(left, lambda i: F.get(t, i)))[0]


def drop_repeated_lines(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, least_lines: int = LEAST_LINES, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the texts that remain; all columns and rows are kept.

    A text that loses nothing is unchanged, null too; one that loses all its
    lines is empty.  Rows that repeat both doc_id and text are occurrences of their
    own, so one of them keeps what the others lose; null doc_ids come last.  Long
    texts are cut whole.  No rows give no rows.
    """
    lines, gone = fresh(docs, "lines", "gone")
    told = _with_gone(docs, removed_lines(docs, window, divisor, least_lines, least_words), gone)
    whole = told.withColumn(lines, F.when(F.size(gone) > 0, F.split(whole_text(), "\n")))
    return whole.withColumn("text", F.when(F.size(gone) > 0, F.array_join(_kept(lines, gone), "\n")).otherwise(F.col("text"))).select(*docs.columns)


def line_report(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, least_lines: int = LEAST_LINES, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed (lines), kept_sha256
    (of the remaining text, null as empty).  Ties, repeated rows, nulls and empty
    tables are as in drop_repeated_lines()."""
    docs = docs.select("doc_id", "text")
    told = _with_gone(docs, removed_lines(docs, window, divisor, least_lines, least_words), "gone")
    n_gone = F.coalesce(F.size(F.col("gone")), F.lit(0))
    n_gone = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(n_gone)
    whole = told.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), n_gone.cast("long").alias("n_removed"), "gone", F.when(n_gone > 0, F.split(whole_text(), "\n")).alias("lines"))
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    text = F.when(F.col("n_removed") > 0, F.array_join(_kept("lines", "gone"), "\n")).otherwise(F.col("text"))
    return whole.select("doc_id", n_lines.cast("long").alias("n_lines"), "n_removed", F.sha2(text, 256).alias("kept_sha256"))


#: DuckDB SQL for line_report() with its default parameters (a window of one line).
REPORT_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
g AS (SELECT *, length(line) > {LONG_CHARS} AS long, (CAST(CAST('0x' || substr(md5(line), 1, 8) AS UBIGINT) AS BIGINT) % {_PRIME}) % {DIVISOR} AS q FROM l),
e AS (SELECT *, CASE WHEN long OR q = 0 OR lead(long, 1, false) OVER w OR lead(q, 1, 0) OVER w = 1 THEN 1 ELSE 0 END AS ends FROM g WINDOW w AS (PARTITION BY r ORDER BY i)),
k AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM e),
c AS (SELECT r, doc_id, c, min(i) AS a, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS text FROM k GROUP BY r, doc_id, c),
p AS (SELECT r, doc_id, a, n + lead(n) OVER w AS n, text || chr(10) || lead(text) OVER w AS text FROM c WINDOW w AS (PARTITION BY r ORDER BY c)),
u AS (SELECT r, doc_id, a, n, text FROM c UNION ALL SELECT * FROM p WHERE n IS NOT NULL),
m AS (SELECT *, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM u),
o AS (SELECT r, a, n, row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST, r, a) AS k FROM m WHERE n >= {LEAST_LINES} AND words >= {LEAST_WORDS} OR words > {LONG_WORDS}),
x AS (SELECT DISTINCT r, unnest(range(a, a + n)) AS i, true AS gone FROM o WHERE k > 1)
SELECT doc_id, count(*) AS n_lines, count(gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (gone IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN x ON l.r = x.r AND l.i = x.i GROUP BY l.r, doc_id
"""
