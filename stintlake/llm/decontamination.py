"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of ``words`` words (all its words, if it has fewer). A window is a set of placed shingles of
``shingle`` words, and a document contains it only if it holds them all, so one of them is enough to find candidates. The
join goes in these steps:

1. The documents' shingles meet the benchmark's in one pass over the texts. What is written is a row for each place where a
   shingle of the benchmark stands, and one for each document.
2. Shingles are ordered by how rare they are in the documents. A containment of all shingles needs a prefix of one: the
   rarest shingle of each window. Windows with a shingle that no document has are gone here.
3. The places of prefix shingles are joined with their windows. The shingle's place in the window says where the window
   would begin and end (positional and length bounds).
4. The other shingles of each candidate are looked up at their places. Shingles are compared as text and overlap, so a
   window whose shingles all stand where they should is contained word by word.

The benchmark's tables are broadcast only where their rows are counted first and are few; beyond that both sides are
shuffled by keys that carry a salt, so a passage that a third of all documents share is dealt to many tasks.

Defined results: null, empty and wordless texts have no words and no hits. Items without words or without an id take no
part; an id that several items have counts once. Each document is judged by its row, so null and repeated ids stay apart.
Columns other than doc_id, item_id and text are not looked at. No items: no hits; no documents: no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stintlake.llm.common import table
from stintlake.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of a table of the benchmark that may be broadcast, and the parts a key is dealt into beyond that.
BROADCAST_ROWS, SALTS = 200_000, 32


def words_of(text: str) -> Column:
    """Runs of digits, ASCII letters (in lower case) and characters past ASCII."""
    lowered = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def shingles_of(words: str, size: int) -> Column:
    """The runs of ``size`` words as texts, in order; none if there are fewer words."""
    last = F.size(words) - size
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(F.col(words), i + k) for k in range(size)]))
    return F.slice(runs, F.lit(1), F.greatest(last + 1, F.lit(0)))


def met(rows: DataFrame, small: DataFrame, on: str, salt: list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` joined with a table of the benchmark: broadcast if that has few rows, else by salted keys."""
    if small.count() <= limit:
        return rows.join(F.broadcast(small), on, how)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*salt), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    return dealt.join(copies, [on, "_salt"], how).drop("_salt")


def windows(items: DataFrame, words: int) -> DataFrame:
    """``item_id, window, w``: the windows of each item as arrays of w words."""
    each = items.filter("item_id IS NOT NULL").select("item_id", words_of("text").alias("all")).filter(F.size("all") > 0)
    w = F.least(F.size("all"), F.lit(words))
    starts = F.sequence(F.lit(1), F.size("all") - w + 1)
    return each.withColumn("w", w).select("item_id", "w", F.explode(starts).alias("at"), "all").select("item_id", "w", F.slice("all", F.col("at"), F.col("w")).alias("window")).distinct()


def placed(docs: DataFrame, shingles: DataFrame, sizes: list[int], limit: int) -> DataFrame:
    """``_row, doc_id, n_words, pos, sid``: each place of a known shingle, and with pos -1 one row a document."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", words_of("text").alias("words"))
    own = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("shingle")))
    of = [F.transform(shingles_of("words", size), lambda x, i: F.struct(i.alias("pos"), x.alias("shingle"))) for size in sizes]
    flat = rows.select("_row", "doc_id", F.size("words").alias("n_words"), F.inline(F.concat(own, *of)))
    return met(flat, shingles, "shingle", ["_row", "pos"], "left", limit).filter("sid IS NOT NULL OR pos = -1").drop("shingle")


def occurrences(hits: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """``_row, start, w, wid``: each place where a window stands. known: wid, w, i, sid with all shingles of the windows."""
    rarity = hits.filter("pos >= 0").groupBy("sid").agg(F.count("*").alias("places"))
    prefix = written(
        known.join(rarity, "sid", "left").groupBy("wid", "w").agg(
            F.min(F.struct(F.coalesce("places", F.lit(0)).alias("places"), "sid", "i")).alias("first"),
            F.transform(F.array_sort(F.collect_list(F.struct("i", "sid"))), lambda x: x["sid"]).alias("sids"))
        .filter("first.places > 0").select("wid", "w", F.col("first.sid").alias("sid"), F.col("first.i").alias("i"), "sids"),
        "prefixes",
    )
    start = F.col("pos") - F.col("i")
    candidates = met(hits.filter("pos >= 0").select("_row", "n_words", "pos", "sid"), prefix, "sid", ["_row", "pos"], limit=limit)
    candidates = candidates.withColumn("start", start).filter("start >= 0 AND start + w <= n_words")
    needed = candidates.select("_row", "start", "w", "wid", F.size("sids").alias("n"), F.posexplode("sids").alias("j", "sid")).withColumn("pos", F.col("start") + F.col("j"))
    found = needed.join(hits.filter("pos >= 0").select("_row", "pos", "sid"), ["_row", "pos", "sid"])
    return found.groupBy("_row", "start", "w", "wid", "n").count().filter("count = n").select("_row", "start", "w", "wid")


def covered(found: DataFrame) -> DataFrame:
    """``_row, n_hit``: how many places of each document lie in an occurrence."""
    ends = found.groupBy("_row", "start").agg(F.max(F.col("start") + F.col("w")).alias("end"))
    before = Window.partitionBy("_row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0))
    return ends.select("_row", fresh.alias("fresh")).groupBy("_row").agg(F.sum("fresh").cast("long").alias("n_hit"))


def contaminated(docs: DataFrame, items: DataFrame, words: int = 10, shingle: int = 3, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of each row of docs (doc_id, text) against items
    (item_id, text). limit: rows of a table of the benchmark that may be broadcast."""
    of_items = written(windows(items, words), "windows")
    numbered = written(of_items.select("window", "w").distinct().withColumn("wid", F.monotonically_increasing_id()), "numbered")
    item_windows = of_items.join(numbered, ["window", "w"]).select("wid", F.col("item_id").cast("string").alias("item"))
    sizes = [r["s"] for r in numbered.select(F.least("w", F.lit(shingle)).alias("s")).distinct().orderBy("s").collect()]  # at most `shingle`
    of_size = [numbered.filter(F.least("w", F.lit(shingle)) == s).select("wid", "w", F.posexplode(shingles_of("window", s)).alias("i", "shingle")) for s in sizes]
    if not of_size:  # no item has words
        none = docs.select("doc_id", F.size(words_of("text")).cast("long").alias("n_words"))
        return none.select("*", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))
    each = reduce(DataFrame.unionByName, of_size)
    shingles = written(each.select("shingle").distinct().withColumn("sid", F.monotonically_increasing_id()), "shingles")
    known = written(each.join(shingles, "shingle").drop("shingle"), "known")
    hits = written(placed(docs, shingles, sizes, limit), "hits")
    found = written(occurrences(hits, known, limit), "occurrences")
    names = met(found.select("_row", "wid").distinct(), item_windows, "wid", ["_row"], limit=limit).groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = hits.filter("pos = -1").select("_row", "doc_id", "n_words").join(covered(found), "_row", "left").join(names, "_row", "left")
    items_of = F.coalesce("items", F.expr("CAST(array() AS ARRAY<STRING>)"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select("doc_id", F.col("n_words").cast("long"), n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the benchmark: words that lie in windows of ten words of an item, and which items these are.

    A document without hits has n_hit and n_items 0, the hash of the empty text, and false. Odd rows as in the module.
    """
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = f"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"""
ORACLE = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(ws), 10) AS w, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') AS t
        FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM item WHERE len(ws) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
place AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, ws FROM doc),
hit AS (SELECT DISTINCT p.r, p.i, s.w, x.item
        FROM place p JOIN (SELECT DISTINCT w FROM win) s ON p.i + s.w - 1 <= len(p.ws)
        JOIN win x ON x.w = s.w AND x.t = array_to_string(list_slice(p.ws, p.i, p.i + s.w - 1), ' ')),
n AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(i, i + w)) AS spot FROM hit) GROUP BY r),
k AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN n USING (r) LEFT JOIN k USING (r)
"""
