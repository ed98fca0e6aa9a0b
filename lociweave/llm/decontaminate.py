"""Benchmark decontamination with DataFrame functions only.

The benchmark's windows of words are a broadcast hash set: a bit table of the hashes
of their ends (the first and the last word), which grows with the set, is broadcast,
and one narrow pass over the documents looks every window of their words up in it.
What it lets pass is verified by all its words, through a join with the benchmark's
windows: broadcast too up to BROADCAST_ROWS of them (they are counted), by a shuffle of
what was let pass beyond.  The documents' words are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, LOWER, UPPER, BitFilter, fresh, looked_up, row_key, stash, whole_text

WINDOW = 10
#: What isn't part of a word, in a text whose A-Z is in either case.
_NOT_WORD = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"


def _words(name: str = "text") -> Column:
    """The words with A-Z in lower case.  Letters beyond ASCII stay as they are, so
    lower() serves only where it finds none of them to change."""
    text = whole_text(name)
    plain = (F.octet_length(text) == F.char_length(text)) | ~text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, _NOT_WORD), "")


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """win (words, space-joined), len, ends (a hash of the first and the last word)
    and the items with that window."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), _words().alias("w")).filter(F.size("w") > 0)
    each = words.withColumn("len", F.least(F.size("w"), F.lit(n))).withColumn("at", F.explode(F.expr("sequence(1, size(w) - len + 1)")))
    one = each.select("item", "len", F.array_join(F.expr("slice(w, at, len)"), " ").alias("win"), _ends(F.col("w"), F.col("at") - 1, F.col("len")).alias("ends"))
    return one.groupBy("win", "len", "ends").agg(F.collect_set("item").alias("items"))


def _ends(words: Column, at: Column, n: Column) -> Column:
    return F.xxhash64(n, F.get(words, at), F.get(words, at + n - 1))


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_words, places (sorted, distinct
    (at, len) of verified windows, words counted from 1) and item_ids (strings).

    Null texts have no words.  An item of fewer than ``n`` words is one window;
    an item without words has none.  Items with a null item_id hit words too but
    aren't listed.  Rows that repeat a doc_id are told apart.  Long texts are
    searched whole.  Without items there are no hits, without rows no rows.
    """
    windows = stash(benchmark_windows(benchmark, n), "windows")
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect()) or [n]  # at most n of them
    count = windows.count()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("text_hash"), _words().alias("w"))
    each = rows.withColumn("n_words", F.size("w")).withColumn("at", F.explode(F.sequence(F.lit(0), "n_words")))  # the place after the last word stands for the row
    each = each.withColumn("len", F.explode(F.array(*[F.lit(x) for x in lengths])) if len(lengths) > 1 else F.lit(lengths[0]))
    each = each.withColumn("row_itself", (F.col("at") == F.col("n_words")) & (F.col("len") == lengths[0])).filter(F.col("row_itself") | (F.col("at") + F.col("len") <= F.col("n_words")))
    told = BitFilter(windows.select("ends"), "ends", count).told(each, _ends(F.col("w"), F.col("at"), F.col("len")), "may").filter(F.col("row_itself") | F.col("may"))
    # the rows themselves have a text that no window has, each its own, so that they don't meet in a join
    win = F.when(F.col("row_itself"), F.concat(F.lit("\0"), F.col("row"))).otherwise(F.array_join(F.expr("slice(w, at + 1, len)"), " "))
    found = told.select("row", "doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), (F.col("at") + 1).alias("at"), "len", win.alias("had"))
    known = windows.select("win", "items")
    both = found.join(F.broadcast(known) if count <= broadcast_rows else known, F.col("had") == F.col("win"), "left")
    place = F.when(F.col("win").isNotNull(), F.struct("at", "len"))
    by_row = both.groupBy("row", "doc_id", "text_hash", "n_words").agg(F.collect_set(place).alias("places"), F.collect_set("items").alias("items"))
    return by_row.select("doc_id", "text_hash", "n_words", F.array_sort("places").alias("places"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("item_ids"))


#: Words that sorted places (at, len) cover.
_COVERED = (
    "aggregate(places, named_struct('end', 0, 'n', 0L), (a, p) -> named_struct("
    "'end', greatest(a.end, p.at + p.len - 1), 'n', a.n + greatest(0, p.at + p.len - greatest(p.at, a.end + 1))), a -> a.n)"
)


def measure(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row."""
    found = find_hits(docs, benchmark, n, broadcast_rows).withColumn("n_hit", F.expr(_COVERED).cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` without contaminated documents (mode ``documents``) or without the
    hit words and what stands between them (mode ``spans``), all columns kept.

    A row is found again by doc_id and a hash of its text, so rows that share a
    doc_id or have none are told apart; equal rows end alike.  Texts without a hit
    aren't shuffled.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode!r}")
    id_, key, spans, parts, first = fresh(docs, "hit_id", "hit_key", "spans", "parts", "first")
    found = find_hits(docs, benchmark, n, broadcast_rows).filter(F.size("places") > 0).dropDuplicates(["doc_id", "text_hash"])
    found = stash(found.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(key), F.expr(_MERGED).alias(spans)), "hits")
    if mode == "documents":
        return looked_up(docs, found.select(id_, key), "left_anti").select(*docs.columns)
    held = looked_up(docs, found, "left").withColumn(parts, F.when(F.col(spans).isNotNull(), F.regexp_extract_all(whole_text(), F.lit(_PARTS), 0)))
    held = held.withColumn(first, F.when(F.col("text").rlike(_STARTS_WITH_WORD), 0).otherwise(1))
    kept = F.expr(_KEPT.format(spans=f"`{spans}`", parts=f"`{parts}`", first=f"`{first}`"))
    return held.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)


#: Sorted places as disjoint spans of words.
_MERGED = (
    "aggregate(places, cast(array() as array<struct<a:int,b:int>>), (s, p) -> if(size(s) > 0 and p.at <= element_at(s, -1).b + 1,"
    " concat(slice(s, 1, size(s) - 1), array(named_struct('a', element_at(s, -1).a, 'b', greatest(element_at(s, -1).b, p.at + p.len - 1)))),"
    " concat(s, array(named_struct('a', p.at, 'b', p.at + p.len - 1)))))"
)
#: A text as words and what separates them, in turn; same classes as _NOT_WORD before A-Z is lowered.
_PARTS = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
_STARTS_WITH_WORD = r"^[0-9A-Za-z\x{80}-\x{10FFFF}]"
#: Part i is word (i - first) div 2 + 1, or the separator after that word.
_KEPT = (
    "array_join(filter({parts}, (x, i) -> i < {first} or not exists({spans}, s -> (i - {first}) div 2 + 1 >= s.a"
    " and (i - {first}) div 2 + 1 + pmod(i - {first}, 2) <= s.b)), '')"
)
