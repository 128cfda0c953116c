"""Benchmark decontamination with DataFrame functions only: a broadcast hash set of test windows, scan, verify, remove.

A window is 13 consecutive words of an item (a shorter item is one window). The windows' hashes, and those of the three
words anywhere in them, make two hash sets of bounded size (common.passing), which travel to every executor. Each
document is scanned where it lies: as any window of 13 words holds one of every eleventh three words, only those are
looked up; around those found every window is, and what is found again carries its words on, to an exact join with the
test windows. Hits are folded to covered words by document. Whole texts move only where a text is to be cut or to go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import passing, spent, written

WINDOW, GRAM = 13, 3
#: What stands between the words of the contract, in lower-cased text, and a word in raw text.
BETWEEN, RAW_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of test windows with their items up to which they are broadcast to the hits; beyond, the join is merged.
BROADCAST_BYTES = 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text. Splitting takes an eighth of the time that matching words does."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), BETWEEN), "")


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(w, size, items): each distinct window, its words joined by a space, and the items that hold it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).where("size(words) > 0 and item is not null")
    items = items.withColumn("size", F.least(F.lit(window), F.size("words")))
    at = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1))
    rows = items.select("item", "size", "words", at.alias("at")).select("item", "size", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("w"))
    return rows.groupBy("w", "size").agg(F.collect_set("item").alias("items"))


def row_keys(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that tell a document by its doc_id and text; equal rows share them."""
    doc_id = doc_id.cast("string")
    return F.xxhash64(doc_id, text, F.octet_length(text)), F.xxhash64(F.lit(7), text, doc_id)


_AROUND = "array<struct<size:int,start:int,h:bigint,around:array<string>>>"


def _looked_up(size: int) -> Column:
    """(size, start, h, around) of the few words of `words` of which every window of `size` words holds one: their hash,
    and the words from `start` on of all windows that hold them."""
    words, gram = F.col("words"), min(GRAM, size)
    reach = size - gram

    def one(at: Column) -> Column:
        start = F.greatest(at - reach, F.lit(0))
        hashed = F.xxhash64(F.lit(size), *[F.get(words, at + k) for k in range(gram)])
        return F.struct(F.lit(size).alias("size"), start.alias("start"), hashed.alias("h"), F.slice(words, start + 1, at - start + size).alias("around"))

    places = F.sequence(F.lit(0), F.size(words) - gram, F.lit(reach + 1))
    return F.when(F.size(words) >= size, F.transform(places, one)).otherwise(F.array()).cast(_AROUND)


def _grams(windows: DataFrame) -> DataFrame:
    """The hashes that _looked_up may find in a window."""
    words, gram = F.split("w", " "), F.least(F.lit(GRAM), F.col("size"))
    parts = windows.select("size", gram.alias("gram"), words.alias("ws"), F.explode(F.sequence(F.lit(0), F.col("size") - gram)).alias("at"))
    # words beyond a shorter gram are null, which a hash passes over
    return parts.select(F.xxhash64("size", *[F.when(F.col("gram") > k, F.get("ws", F.col("at") + k)) for k in range(GRAM)]).alias("h"))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(rows, hits): rows has doc_id, k1, k2 and n_words for each row of docs; hits has for each (k1, k2) with a hit its
    spans (start, size; in words from 0) and items. k1 and k2 are row_keys, so repeated rows share their hits."""
    spark = docs.sparkSession
    windows = written(windows_of(benchmark, window), "windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # `window` rows at most
    text = F.col("text").cast("string")
    k1, k2 = row_keys(F.col("doc_id"), text)
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.coalesce(words_of(text), F.array().cast("array<string>")).alias("words"))
    # the first element, a null, stands for the document itself: one pass gives its row and its candidates. Its hash,
    # null, is put into the sets
    none = spark.range(1).select(F.lit(None).cast("long").alias("h"))
    every = F.concat(F.array(F.lit(None)).cast(_AROUND), *[_looked_up(size) for size in sizes])
    rows = split.select("doc_id", "k1", "k2", F.size("words").cast("long").alias("n_words"), F.explode(every).alias("x"))
    rows = passing(rows.withColumn("h", F.col("x.h")), _grams(windows).union(none), ["h"])
    first, size = F.col("x.start"), F.col("x.size")
    each = F.transform(F.sequence(F.lit(0), F.size("x.around") - size), lambda k: F.struct((first + k).alias("start"), F.array_join(F.slice(F.col("x.around"), k + 1, size), " ").alias("w")))
    each = F.when(F.col("x").isNull(), F.array(F.lit(None))).when(F.size("x.around") >= size, each).otherwise(F.array()).cast("array<struct<start:int,w:string>>")
    rows = rows.select("doc_id", "k1", "k2", "n_words", size.alias("size"), F.explode(each).alias("x"))
    rows = rows.withColumn("h", F.when(F.col("x").isNotNull(), F.xxhash64("size", "x.w")))
    found = passing(rows, windows.select(F.xxhash64("size", "w").alias("h")).union(none), ["h"])
    scanned = written(found.select("doc_id", "k1", "k2", "n_words", "size", "x.start", "x.w"), "scanned")
    weight = windows.agg(F.sum(F.octet_length("w") + 48 + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 16))).first()[0] or 0
    side = F.broadcast(windows) if weight <= BROADCAST_BYTES else windows.hint("merge")
    hits = scanned.where("w is not null").join(side, ["w", "size"]).groupBy("k1", "k2")
    hits = hits.agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hits = written(hits, "hits")
    spent(windows)
    return scanned.where("w is null").select("doc_id", "k1", "k2", "n_words"), hits


def merged(spans: Column) -> Column:
    """Spans (start, size), sorted, as runs (start, stop) that neither overlap nor touch."""
    kind = "array<struct<start:int,stop:int>>"

    def step(runs: Column, x: Column) -> Column:
        stop = x["start"] + x["size"]
        last = F.element_at(runs, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], stop).alias("stop"))
        touches = (F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["stop"] >= x["start"])
        return F.when(touches, F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(runs, F.array(F.struct(x["start"].alias("start"), stop.alias("stop")))))

    return F.aggregate(spans, F.array().cast(kind), step)


def covered(spans: Column) -> Column:
    """The words inside any of the spans, which are sorted by start."""
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))

    def step(acc: Column, x: Column) -> Column:
        end = x["start"] + x["size"]
        return F.struct((acc["hit"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["start"]))).alias("hit"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(spans, zero, step)["hit"]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, n_words, n_hit, items (sorted as strings), contaminated.

    Null and empty texts have no words, no hits and are clean; so is all where benchmark is empty. Null and repeated
    doc_ids stay as rows; items with a null id or no word have no window. Other columns are ignored.
    """
    rows, hits = find_hits(docs, benchmark, window)
    out = rows.join(hits, ["k1", "k2"], "left")
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long")
    out = out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs less contaminated rows; in the others the words of a hit go, with what stands between them.

    Columns stay as they are; n_chars follows a text that was cut. Rows without a hit are untouched and don't move; to
    tell them takes a filter of bounded size.
    """
    columns = docs.columns
    rows, hits = find_hits(docs, benchmark, window)
    spans = rows.join(hits.drop("items"), ["k1", "k2"]).select("k1", "k2", "spans", (20 * covered(F.col("spans")) >= F.col("n_words")).alias("bad")).dropDuplicates(["k1", "k2"])
    spans = written(spans.withColumnsRenamed({"k1": "__k1", "k2": "__k2", "spans": "__spans", "bad": "__bad"}), "spans")
    k1, k2 = row_keys(F.col("doc_id"), F.col("text"))
    keyed = docs.withColumns({"__k1": k1, "__k2": k2})
    far = passing(keyed, spans, ["__k1", "__k2"], keep=False).select(*columns)
    near = passing(keyed, spans, ["__k1", "__k2"]).join(spans.hint("merge"), ["__k1", "__k2"], "left").where("__bad is null or not __bad")
    hit = F.col("__spans").isNotNull()
    near = near.withColumn("__runs", F.when(hit, merged(F.col("__spans"))))
    kept, between = F.regexp_extract_all("text", F.lit(RAW_WORD), F.lit(0)), F.split("text", RAW_WORD, -1)
    # each word with what follows it; of a run that goes only what follows its last word stays
    near = near.withColumn("__between", F.when(hit, between)).withColumn("__parts", F.when(hit, F.zip_with(kept, F.slice(between, 2, F.size(between) - 1), lambda a, b: F.concat(a, b))))
    before = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("__runs", k - 1)["stop"])
    piece = lambda start, stop: F.array_join(F.slice("__parts", start + 1, stop - start), "")
    runs = F.transform("__runs", lambda r, k: F.concat(piece(before(k), r["start"]), F.get("__between", r["stop"])))
    last = F.element_at("__runs", -1)["stop"]
    cut = F.concat(F.get("__between", F.lit(0)), F.array_join(runs, ""), piece(last, F.size("__parts")))
    near = near.withColumn("text", F.when(hit, cut).otherwise(F.col("text")))
    if "n_chars" in columns:
        near = near.withColumn("n_chars", F.when(hit, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return far.unionByName(near.select(*columns))
