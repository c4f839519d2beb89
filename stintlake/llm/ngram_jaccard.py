"""N-gram Jaccard join by filters under several global token orders.

A document is its set of distinct word 5-grams. If two sets have a Jaccard similarity of t or more, then under any one
order of all tokens their prefixes (the first ``n - ceil(t n) + 1`` tokens) share a token. So candidates must share a
prefix token under every one of several orders:

1. The order of the token hashes, with a longer prefix of which linked sets must share several tokens. Documents whose
   prefix tokens hardly occur elsewhere cannot link with anything and leave here; those are nearly all documents that
   have no copies. Only the hashes of the prefixes move. What stays is counted once more over whole sets, of whose
   tokens as many as an overlap needs must occur elsewhere.
2. For the rest, rare tokens first, ties by hash: candidates share a prefix token, at positions that leave room for the
   overlap needed.
3. and 4. Two orders by other hashes, which have nothing to do with how rare a token is: of longer prefixes again,
   candidates must share several tokens under each.

Every pair passes all of 2, 3 and 4 before its whole sets are verified. Links serve to find classes, so pairs within a
class that is known already are not looked at: every prefix token first pairs its documents with one pivot, the links found
merge into classes, and then only pairs across classes are formed: by token and size, each document with the sizes that
leave room only, in blocks where a token is frequent. No group of copies is expanded into all its pairs, and no pair that
could join two classes is left out.

Equal sets are one node (exact copies collapse first). Nodes are numbered by a 64-bit hash of their sets; a second hash
confirms it, and sets that share a number without sharing the second are numbered by the second. Shingles are 64-bit
hashes; two different ones of the same document or corpus agree with a probability near n * n / 2 ** 65.

Defined results: a document without words or text has no shingles and is its own class. One with fewer words than a
shingle has a single shingle of all its words. Rows with a null id take part; their class is the smallest id of those
they are linked with, null if there is none. Repeated ids are documents of their own that share a node or not by their
texts. An empty table gives no rows.

Near copies share tokens, so their sets and postings take a small part of their memory in files, and Spark, which goes by the
files, would broadcast them whole through the driver. Joins of sets, postings and what is exploded from them are therefore
hinted to be merges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintlake.llm.common import released, table
from stintlake.llm.graph import components
from stintlake.session import written

U64 = np.uint64
STEP = U64(0x9E3779B97F4A7C15)
#: Tokens (of 16 bytes with their node) in a bucket, postings of a token in a block, first hashes that may clash.
BUCKET_TOKENS, BLOCK_ROWS, CLASHES = 4_000_000, 4096, 100_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text (A-Z in lower case; words lie between ASCII white space)."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, U64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), U64, len(found))
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, U64(size))
    for i in range(size):
        out = out * STEP + h[i : i + len(out)]
    return np.unique(mixed(out))


def hash_of(data: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(data, seed) - (1 << 63)


def node_of(tokens: np.ndarray, clashing: frozenset[int] = frozenset()) -> int | None:
    """The number of a token set, None for the empty one; ``clashing``: first hashes that different sets share."""
    if not len(tokens):
        return None
    data = tokens.tobytes()
    first = hash_of(data, 0)
    return hash_of(data, 1) if first in clashing else first


def needed(n, percent: int):
    """The least overlap of a set of n tokens with any that it links with (ints or arrays)."""
    return -(-percent * n // 100)


def _binary(arrays) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def profile(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, text_key, n, node, other`` of each document; other: the second hash of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(text, words) for text in part.column(2).to_pylist()]
                other = [hash_of(s.tobytes(), 1) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(node_of, sets), pa.int64()), pa.array(other, pa.int64())], names=["doc_id", "text_key", "n", "node", "other"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, text_key long, n long, node long, other long")


def clashes(profiles: DataFrame) -> frozenset[int]:
    """First hashes that different sets share: of n sets, n * n / 2 ** 65 are to be expected (70 of 5e10)."""
    found = profiles.filter("n > 0").groupBy("node").agg(F.min("other").alias("a"), F.max("other").alias("b")).filter("a <> b").select("node").limit(CLASHES + 1).collect()
    if len(found) > CLASHES:
        raise ValueError("more sets share their hashes than chance allows")
    return frozenset(r["node"] for r in found)


def prefixes(docs: DataFrame, words: int, percent: int, extra: int, clashing: frozenset[int]) -> DataFrame:
    """``node, tokens`` of each document with shingles; tokens: its smallest hashes, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for at in range(0, batch.num_rows, 2048):
                sets = [s for text in batch.column(0).slice(at, 2048).to_pylist() if len(s := shingles(text, words))]
                heads = [s[: len(s) - needed(len(s), percent) + max(1, len(s) // extra)] for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s, clashing) for s in sets], pa.int64()), _binary(heads)], names=["node", "tokens"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "node long, tokens binary")


def buckets_for(docs: DataFrame, tokens: int) -> int:
    """How many buckets ``tokens`` (token, node) pairs are dealt to: of bounded size, and enough for all cores."""
    return max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tokens // BUCKET_TOKENS))


def shared_counts(sets: DataFrame, buckets: int) -> DataFrame:
    """``node, shared``: how many of a node's tokens (or more) other nodes hold too, from ``node, tokens`` (packed).

    Tokens are dealt to buckets in packed form. A batch sends each token of several of its nodes once only and credits
    those nodes itself, so a token that all documents hold takes a row's worth from each batch.
    """

    parts = max(1, buckets // 8)  # counts are far fewer than tokens

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            heads = [np.frombuffer(b, U64) for b in batch.column(1).to_pylist()]
            nodes = np.repeat(batch.column(0).to_numpy(), [len(h) for h in heads])
            tokens = np.concatenate(heads) if heads else np.empty(0, U64)
            tokens, nodes, many = pairs_of(tokens, nodes)
            credit, counts = np.unique(nodes[many], return_counts=True)
            once, known = ~many, np.unique(tokens[many])
            at, at_known, at_credit = (x % U64(buckets) for x in (tokens[once], known, credit.view(U64)))
            parts = [(split(at, buckets, tokens[once]), split(at, buckets, nodes[once]), split(at_known, buckets, known), split(at_credit, buckets, credit), split(at_credit, buckets, counts))]
            for columns in parts:
                some = pa.array([i for i in range(buckets) if len(columns[0][i]) or len(columns[3][i])], pa.int32())
                yield pa.RecordBatch.from_arrays([some, *(_binary(c).take(some) for c in columns)], names=["bucket", "tokens", "nodes", "known", "credit", "counts"])

    def count(group: pa.Table) -> pa.Table:
        tokens, nodes, known, credit, counts = (np.frombuffer(b"".join(group[c].to_pylist()), kind) for c, kind in (("tokens", U64), ("nodes", np.int64), ("known", U64), ("credit", np.int64), ("counts", np.int64)))
        tokens, nodes, many = pairs_of(tokens, nodes)
        many |= np.isin(tokens, known)
        all_nodes = np.concatenate([nodes[many], credit])
        node, shared = summed(all_nodes, np.concatenate([np.ones(many.sum(), np.int64), counts]))
        part = node.view(U64) % U64(parts)
        columns = [_binary(split(part, parts, v)) for v in (node, shared)]
        pa.default_memory_pool().release_unused()
        return pa.table([pa.array(np.arange(parts), pa.int32()), *columns], names=["part", "nodes", "counts"])

    def add(group: pa.Table) -> pa.Table:
        node, shared = summed(*(np.frombuffer(b"".join(group[c].to_pylist()), np.int64) for c in ("nodes", "counts")))
        return pa.table({"node": node, "shared": shared})

    dealt = sets.select("node", "tokens").mapInArrow(deal, "bucket int, tokens binary, nodes binary, known binary, credit binary, counts binary")
    counted = dealt.groupBy("bucket").applyInArrow(count, "part int, nodes binary, counts binary")
    return counted.groupBy("part").applyInArrow(add, "node long, shared long")


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sums of their values."""
    found, back = np.unique(keys, return_inverse=True)
    return found, np.bincount(back, values, len(found)).astype(np.int64)


def pairs_of(tokens: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (token, node) in token order, and whether the token has several nodes."""
    order = np.lexsort((nodes, tokens))
    tokens, nodes = tokens[order], nodes[order]
    fresh = np.ones(len(tokens), bool)
    fresh[1:] = (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])
    tokens, nodes = tokens[fresh], nodes[fresh]
    same = tokens[1:] == tokens[:-1]
    many = np.zeros(len(tokens), bool)
    many[1:] |= same
    many[:-1] |= same
    return tokens, nodes, many


def split(at: np.ndarray, buckets: int, values: np.ndarray) -> list[np.ndarray]:
    """The values of each bucket."""
    order = np.argsort(at, kind="stable")
    return np.split(values[order], np.searchsorted(at[order], np.arange(1, buckets, dtype=at.dtype)))


def token_sets(docs: DataFrame, picked: DataFrame, words: int, broadcast_rows: int) -> DataFrame:
    """``node, n, tokens`` (packed) of the nodes in picked (node, n, doc_id, text_key), from the texts again.

    Up to broadcast_rows picked rows (of 40 bytes or so) go to all tasks, so that no text moves; more are joined by a
    shuffle of the texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _binary([shingles(text, words) for text in part.column(2).to_pylist()])], names=["node", "n", "tokens"])

    d = docs.select(F.col("doc_id").cast("long").alias("d_id"), F.xxhash64("text").alias("d_key"), F.col("text").cast("string"))
    count = picked.count()
    side = F.broadcast(picked) if count <= broadcast_rows else picked
    hit = d.join(side, F.col("d_id").eqNullSafe(F.col("doc_id")) & (F.col("d_key") == F.col("text_key"))).select("node", "n", "text")
    sets = written(hit.mapInArrow(run, "node long, n long, tokens binary"), "sets")
    return sets if sets.count() == count else sets.dropDuplicates(["node"])  # whole rows can repeat


def as_arrays(sets: DataFrame) -> DataFrame:
    """The packed tokens as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                arrays = [np.frombuffer(b, np.int64) for b in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(arrays, pa.list_(pa.int64()))], names=["node", "n", "tokens"])

    return sets.select("node", "n", "tokens").mapInArrow(run, "node long, n long, tokens array<long>")


def orders(sets: DataFrame, percent: int, extra: int) -> DataFrame:
    """``node, n, at, k, first, second, third``: prefixes of shared tokens under three orders.

    first: rare tokens first; second and third: by hashes. Under all of them the tokens of one node only come before all
    others and can be in no other prefix; ``at`` of them lie before the tokens shown. Of second and third, which are longer
    by k - 1 tokens, linked sets share as many tokens as the smaller k says.
    """
    each = sets.select("node", "n", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    held = each.join(often.hint("merge"), "token").groupBy("node", "n").agg(F.collect_list(F.struct("df", "token")).alias("held"))
    length = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100.0)).cast("long") + 1
    k = F.greatest(F.floor(F.col("n") / extra), F.lit(1))
    keep = F.greatest(length - F.col("at"), F.lit(0)).cast("int")
    longer = F.greatest(length + F.col("k") - 1 - F.col("at"), F.lit(0)).cast("int")

    def by_hash(name: str) -> Column:
        return F.slice(F.array_sort(F.transform("held", lambda x: F.xxhash64(F.lit(name), x["token"]))), F.lit(1), longer).alias(name)

    return (
        held.withColumn("at", F.col("n") - F.size("held")).withColumn("k", k)
        .select("node", "n", "at", "k", F.slice(F.array_sort("held"), F.lit(1), keep)["token"].alias("first"), by_hash("second"), by_hash("third"))
        .filter(F.size("first") > 0)
    )


def largest_partner(percent: int) -> Column:
    """The largest set that a set of ``n`` tokens can link with, if the shared token is the first one that both hold.

    ``left`` counts a node's tokens after it, so the overlap is left + 1 at most. Before their first common token two sets
    have none in common, so a pair that links passes there; at its later common tokens it need not be met again.
    """
    most = F.floor((F.col("left") + 1) * (100 + percent) / F.lit(percent)) - F.col("n")
    return F.least(most, F.floor(F.col("n") * 100 / F.lit(percent)))


def size_class(n: Column) -> Column:
    """Sizes within about a twentieth of one another."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1.05))).cast("int")


def across(post: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of postings ``token, node, n, left, root`` of one token and different roots, where the sizes leave room.

    Of each token, all nodes but those of its largest root look for others: in the classes of the sizes that they can link
    with. Postings that can link with no size are left out. A frequent token's nodes are dealt to blocks on one side.
    """
    post = post.withColumn("most", largest_partner(percent)).withColumn("least", F.ceil(F.col("n") * percent / F.lit(100.0))).filter("most >= least").drop("left")
    sizes = post.groupBy("token", "root").agg(F.count("*").alias("m"))
    main = sizes.groupBy("token").agg(F.max(F.struct("m", "root"))["root"].alias("main"), F.count("*").alias("roots"), F.sum("m").alias("m")).filter("roots > 1")
    main = main.select("token", "main", F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("blocks"))
    mixed_tokens = written(post.join(main.hint("merge"), "token"), "across")
    x = mixed_tokens.filter("root <> main").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    x = x.withColumn("size", F.explode(F.sequence(size_class(F.col("least")), size_class(F.col("most"))))).alias("x")
    y = mixed_tokens.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("size", size_class(F.col("n"))).alias("y")
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.size") == F.col("y.size"))
    apart = (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
    fit = F.col("y.n").between(F.col("x.least"), F.col("x.most")) & F.col("x.n").between(F.col("y.least"), F.col("y.most"))
    return x.join(y.hint("merge"), same & apart & fit).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def filtered(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) that share enough tokens of their prefixes under the second and the third order."""
    for order in ("second", "third"):
        one, two = (known.select(F.col("node").alias(c), F.col(order).alias(f"s_{c}"), F.col("k").alias(f"k_{c}")).hint("merge") for c in "ab")
        both = F.size(F.array_intersect("s_a", "s_b")) >= F.least("k_a", "k_b")
        pairs = pairs.join(one, "a").join(two, "b").filter(both).select("a", "b")
    return pairs


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")).hint("merge")
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")).hint("merge")
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(one, "a").join(two, "b").withColumn("i", both).filter(F.col("i") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b")


def links(sets: DataFrame, percent: int, extra: int = 10) -> DataFrame:
    """Links (a, b) of distinct sets (node, n, tokens) whose components are those of all similar pairs."""
    known = written(orders(sets, percent, extra), "orders")
    post = known.select("node", "n", "at", F.posexplode("first").alias("i", "token"))
    post = written(post.select("token", "node", "n", "at", (F.col("n") - F.col("at") - F.col("i") - 1).alias("left")), "prefixes")
    # every prefix token pairs its nodes with the one that has fewest tokens of its own: the source of copies, if it is there
    pivots = post.groupBy("token").agg(F.min(F.struct("at", "node"))["node"].alias("b"), F.count("*").alias("m")).filter("m > 1").drop("m")
    stars = post.select("token", "node").join(pivots.hint("merge"), "token").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    found = written(verified(filtered(stars, known), sets, percent), "links")
    # then pairs across the classes found so far
    roots = components(found)
    post = post.join(roots, "node", "left").select("token", "node", "n", "left", F.coalesce("root", "node").alias("root"))
    return found.unionByName(verified(filtered(across(post, percent), known), sets, percent))


def classes(docs: DataFrame, words: int = 5, percent: int = 80, extra: int = 10, with_key: bool = False, broadcast_rows: int = 250_000) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row of ``doc_id, text``.

    percent: the least Jaccard similarity of a link, in hundredths. extra: the first order's prefixes are longer by one
    token in so many, and links must share as many of them. with_key: also ``class`` (a number of the class, null without
    shingles) and ``text_key`` (the text's xxhash64).
    """
    profiles = written(profile(docs, words), "profiles")
    clashing = clashes(profiles)
    if clashing:
        profiles = profiles.withColumn("node", F.when(F.col("node").isin(*clashing), F.col("other")).otherwise(F.col("node")))
    nodes = profiles.filter("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.min(F.struct("doc_id", "text_key")).alias("rep"), F.min("doc_id").alias("least_id"))
    nodes = written(nodes.select("node", "n", "least_id", "rep.doc_id", "rep.text_key"), "nodes")
    least = (F.col("n") * percent + 99 - (F.col("n") * percent + 99) % 100) / 100  # of the tokens of any set that it links with
    tokens = profiles.agg(F.sum("n")).first()[0] or 0
    shared = shared_counts(prefixes(docs, words, percent, extra, clashing), buckets_for(docs, tokens * (100 - percent + 100 // extra) // 100))
    picked = nodes.join(shared, "node").filter(F.col("shared") >= F.greatest(F.floor(least / extra), F.lit(1))).select("node", "n", "doc_id", "text_key")
    picked = written(picked, "picked")
    whole = token_sets(docs, picked, words, broadcast_rows)
    buckets = buckets_for(docs, picked.agg(F.sum("n")).first()[0] or 0)
    near = whole.join(shared_counts(whole, buckets), "node").filter(F.col("shared") >= least)
    sets = written(as_arrays(near), "sets")
    roots = components(written(links(sets, percent, extra), "links"))
    ids = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_ids = ids.groupBy("root").agg(F.min("least_id").alias("component_id"))
    class_of = ids.join(least_ids, "root").select("node", "root", "component_id")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    more = [F.col("root").alias("class"), "text_key"] if with_key else []
    return profiles.join(class_of, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), own, *more)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document: word 5-grams, similarity 0.8 or more."""
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
