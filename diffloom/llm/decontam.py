"""Benchmark decontamination by SimHash windows, in DataFrame expressions only.

Texts are lower-cased and cut into words of letters and digits; features are
weighted five-word shingles (an item of fewer words is one shingle).  For every
benchmark item the documents are looked through in windows of the item's own
size, at every place where one could reach the similarity: the document holds a
leading shingle of the item (its rarest shingles, up to the weight without
which the rest falls short of `percent`; a window that reaches it holds one),
and the item's shingles inside the window weigh at least `percent` of the item
(no window shares more than they weigh).  No window that reaches the similarity
is lost, however its parts are ordered.
Each window gets a 64-bit SimHash of its weighted shingles.  Fingerprints meet
the items' fingerprints through a multi-index of BLOCKS blocks: two
fingerprints within RADIUS bits differ by at most RADIUS // BLOCKS bits in one
block, and the items stand in the index under every such variant of every
block, so no pair within the radius is lost.  A pair that reaches the similarity
can still lie beyond the radius (about 2 % of those at exactly 0.8 do, as their
distance is 10 on average with a standard deviation under 3), so a window also
meets the item it stands there for.  All these pairs are then compared exactly: the weighted
Jaccard similarity of window and item must reach `percent` / 100.

A shingle's weight is 1 + log2 of the items per item that holds it, rounded to
whole numbers: what many items share weighs least, and so do shingles that no
item holds weigh most.  Leading shingles travel to the executors only in blocks
of at most SEED_BLOCK rows, one pass over the documents for each block; texts
are cut into shingles once more only for documents that hold one.

Null or empty text and text without words: no windows, no rows.  Null ids of
documents or items: ignored.  Several texts of one id, of documents or of
items, are each compared, and the best window counts; repeated rows count as
one.  Other columns are not read.  Empty tables give no rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_ids, cut
from .spans import let, running

SHINGLE, RADIUS, BLOCKS, PERCENT = 5, 15, 4, 80
SEED_BLOCK = 2_000_000
_WORDS = "filter(split(lower(_t), '[^\\\\p{L}\\\\p{N}]+', -1), w -> w != '')"


def _shingles(words: str) -> str:
    """SQL: 64-bit hashes of the word shingles in order; fewer words than a shingle make one."""
    spread = ", ".join(f"{words}[i + {k}]" if k else f"{words}[i]" for k in range(SHINGLE))
    return (
        f"case when size({words}) >= {SHINGLE} then transform(sequence(0, size({words}) - {SHINGLE}), i -> xxhash64({spread})) "
        f"when size({words}) > 0 then array(xxhash64(array_join({words}, ' '), size({words}))) else cast(array() as array<bigint>) end"
    )


def _texts(rows: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """(name, v, _t): v tells the texts of one id apart."""
    rows = rows.select(rows[id_col].cast("long").alias(name), rows[text_col].cast("string").alias("_t")).filter(f"{name} is not null and _t is not null")
    return rows.select(name, F.xxhash64("_t").alias(f"{name}_v"), "_t")


def _shingled(texts: DataFrame, name: str) -> DataFrame:
    """(name, v, words, hashes): number of words, and the shingles in order."""
    rows = texts.select(name, f"{name}_v", F.expr(_WORDS).alias("_w"))
    return rows.select(name, f"{name}_v", F.size("_w").alias("words"), F.expr(_shingles("_w")).alias("hashes"))


def _fingerprint(pairs: str) -> str:
    """SQL: SimHash of an array of (h, w): each bit is the weighted majority of the shingles' bits."""
    bit = f"aggregate({pairs}, 0L, (s, p) -> s + case when (shiftright(p.h, b) & 1) = 1 then p.w else -p.w end) > 0"
    return f"aggregate(sequence(0, 63), 0L, (f, b) -> f | case when {bit} then shiftleft(1L, b) else 0L end)"


def _variants(width: int, radius: int) -> list[int]:
    """All masks of `width` bits with at most `radius` set."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in itertools.combinations(range(width), r)]


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(item, item_v, size, weighted, heavy, sim) of each item's text, and (h, w) of the items' shingles.

    weighted: each shingle's hash, weight times its count, and weight; heavy: their sum.
    """
    items = cut(_shingled(_texts(benchmark, id_col, text_col, "item"), "item").filter("words > 0").dropDuplicates(["item", "item_v"]))
    n = items.select("item").distinct().count()
    spread = items.select("item", "item_v", F.explode("hashes").alias("h"))
    weights = cut(spread.groupBy("h").agg(F.countDistinct("item").alias("df")).select("h", F.expr(f"cast(1 + floor(log2({max(n, 1)} / double(df))) as bigint)").alias("w")))
    counted = spread.groupBy("item", "item_v", "h").agg(F.count(F.lit(1)).alias("k")).join(weights, "h")
    weighted = counted.groupBy("item", "item_v").agg(F.array_sort(F.collect_list(F.struct("h", (F.col("k") * F.col("w")).alias("w"), F.col("w").alias("one")))).alias("weighted"), F.sum(F.col("k") * F.col("w")).alias("heavy"))
    items = items.select("item", "item_v", F.col("words").alias("size")).join(weighted, ["item", "item_v"])
    return cut(items.withColumn("sim", F.expr(_fingerprint("weighted")))), weights


def _leading(items: DataFrame, percent: int) -> DataFrame:
    """(h, item, item_v): the rarest shingles of each item; one that shares none of them stays below `percent`."""
    rows = items.select("item", "item_v", F.inline("weighted"))
    order = Window.partitionBy("item", "item_v").orderBy(F.col("one").desc(), "h")
    rows = rows.withColumn("taken", F.sum("w").over(order) - F.col("w")).withColumn("total", F.sum("w").over(Window.partitionBy("item", "item_v")))
    return rows.filter(100 * (F.col("total") - F.col("taken")) >= percent * F.col("total")).select("h", "item", "item_v")


def _starts(percent: int) -> str:
    """SQL: the starts of the windows in which the item's shingles weigh enough; reads hashes, ones (weights by shingle), heavy and width.

    The weights of the places that hold one of the item's shingles are summed
    up once; a window's weight is the difference of two sums.
    """
    places = "transform(hashes, h -> named_struct('at', coalesce(element_at(ones, h), 0L)))"
    sums = running(f"concat(array(named_struct('at', 0L)), {places})", "struct<at:bigint>", "named_struct('at', x.at + y.at)")
    reach = f"filter(sequence(0, greatest(size(s) - 1 - width, 0)), i -> 100 * (s[least(i + width, size(s) - 1)].at - s[i].at) >= {percent} * heavy)"
    return let(sums, "s", reach)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", percent: int = PERCENT, radius: int = RADIUS, blocks: int = BLOCKS, seed_block: int = SEED_BLOCK) -> DataFrame:
    """(doc_id, item_id, start, n_words, hamming, similarity): the best window of each document and item that reaches `percent`.

    start and n_words count the document's words (letters and digits).
    """
    items, weights = items_of(benchmark, item_col, text_col)
    shingles = weights.count()
    top = F.lit(1 + max(items.select("item").distinct().count(), 1).bit_length() - 1)  # of a shingle that no item holds
    texts = _texts(docs, id_col, text_col, "doc")
    # Outer explodes below: an inner one would add a filter on the array, which Spark pushes down by computing the words anew inside the shingles.

    # Documents and items that share a leading shingle, in blocks of shingles of a checked size.
    leading = cut(_leading(items, percent), narrow=True)
    n = leading.count()
    parts = max(1, -(-n // seed_block))
    pairs = None
    for k in range(parts):
        some = F.broadcast(leading if parts == 1 else leading.filter(F.pmod("h", F.lit(parts)) == k))
        hit = _shingled(texts, "doc").select("doc", "doc_v", F.explode_outer("hashes").alias("h")).join(some, "h").select("doc", "doc_v", "item", "item_v").distinct()
        pairs = hit if pairs is None else pairs.union(hit).distinct()
    pairs = cut(pairs, narrow=True)

    # Windows: every place of such a document where such an item could be.
    marked = cut(_shingled(by_ids(texts, pairs.select("doc").distinct(), "doc"), "doc").dropDuplicates(["doc", "doc_v"]))
    small = items.count() <= seed_block
    known = items.select("item", "item_v", "size", F.map_from_arrays("weighted.h", "weighted.one").alias("ones"), "heavy", F.greatest(F.lit(1), F.col("size") - (SHINGLE - 1)).alias("width"))
    placed = marked.join(pairs, ["doc", "doc_v"]).join(F.broadcast(known) if small and shingles <= seed_block else known, ["item", "item_v"])
    placed = placed.select("doc", "doc_v", "item", "item_v", "size", F.explode_outer(F.expr(_starts(percent))).alias("start")).filter("start is not null")
    placed = cut(placed, narrow=True)

    # Fingerprints of the windows.
    windows = placed.select("doc", "doc_v", "start", "size").distinct()
    width = F.greatest(F.lit(1), F.col("size") - (SHINGLE - 1))
    cuts = marked.join(windows, ["doc", "doc_v"]).select("doc", "doc_v", "start", "size", F.slice("hashes", F.col("start") + 1, width).alias("hashes"))
    counted = cuts.select("doc", "doc_v", "start", "size", F.explode_outer("hashes").alias("h")).groupBy("doc", "doc_v", "start", "size", "h").agg(F.count(F.lit(1)).alias("k"))
    counted = counted.join(F.broadcast(weights) if shingles <= seed_block else weights, "h", "left")
    weighted = counted.groupBy("doc", "doc_v", "start", "size").agg(F.collect_list(F.struct("h", (F.col("k") * F.coalesce("w", top)).alias("w"))).alias("weighted"))
    prints = cut(weighted.withColumn("sim", F.expr(_fingerprint("weighted"))))

    # Multi-index: items under every variant of every block within the block's share of the radius.
    bits, place = 64 // blocks, ["doc", "doc_v", "start", "size"]
    masks = F.array(*[F.lit(m).cast("long") for m in _variants(bits, radius // blocks)])
    key = lambda b: F.shiftrightunsigned("sim", b * bits).bitwiseAND(F.lit((1 << bits) - 1))
    index = items.select("item", "item_v", F.col("sim").alias("isim"), "size", F.explode(F.array(*[F.struct(F.lit(b).alias("block"), key(b).alias("key")) for b in range(blocks)])).alias("e"))
    index = index.select("item", "item_v", "isim", "size", F.col("e.block").alias("block"), F.explode(F.transform(masks, lambda m: F.col("e.key").bitwiseXOR(m))).alias("key"))
    probes = prints.select(*place, "sim", F.explode(F.array(*[F.struct(F.lit(b).alias("block"), key(b).alias("key")) for b in range(blocks)])).alias("e"))
    probes = probes.select(*place, "sim", F.col("e.block").alias("block"), F.col("e.key").alias("key"))
    near = probes.join(index, ["block", "key", "size"]).filter(F.bit_count(F.col("sim").bitwiseXOR(F.col("isim"))) <= radius)
    near = cut(near.select(*place, "item", "item_v").union(placed.select(*place, "item", "item_v")).distinct(), narrow=True)

    # Exact weighted similarity of each such window and item.
    sums = "aggregate({a}, 0L, (s, p) -> s + p.w)"
    shared = "aggregate(a, 0L, (s, p) -> s + coalesce(aggregate(filter(b, q -> q.h = p.h), 0L, (t, q) -> t + least(q.w, p.w)), 0L))"
    both = near.join(prints.select(*place, "sim", F.col("weighted").alias("a")), place).join(items.select("item", "item_v", F.col("sim").alias("isim"), F.col("weighted").alias("b")), ["item", "item_v"])
    both = both.withColumn("hamming", F.bit_count(F.col("sim").bitwiseXOR(F.col("isim"))))
    both = both.withColumn("shared", F.expr(shared)).withColumn("all", F.expr(f"{sums.format(a='a')} + {sums.format(a='b')}") - F.col("shared"))
    found = both.filter(100 * F.col("shared") >= percent * F.col("all")).withColumn("similarity", F.col("shared") / F.col("all"))
    best = found.groupBy("doc", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "size", (-F.col("hamming")).alias("near"))).alias("m"))
    return best.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), (-F.col("m.back")).cast("long").alias("start"), F.col("m.size").cast("long").alias("n_words"), (-F.col("m.near")).cast("long").alias("hamming"), F.round("m.similarity", 9).alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the documents that hold a benchmark item."""
    found = cut(contaminated(docs, benchmark, id_col, text_col, **options).select(F.col("doc_id").alias("_doc")).distinct())
    return by_ids(docs, found, id_col, "left_anti")
