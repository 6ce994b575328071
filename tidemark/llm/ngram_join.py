"""N-gram Jaccard join: a blocked sparse product of documents by shingles, bounded by the sizes of the sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded_batches, discard, materialize, no_cache, slices, texts
from .graph import components
from .shingles import shingle_sets

#: Documents sampled to learn which shingles are frequent, the sample count from which one is, and the most that are kept.
#: They only order the shingles: any order gives the same links.
SAMPLE, FREQUENT, KEPT = 4000, 4, 50_000
#: Rows of one shingle that one task compares with one another; more are dealt out as pairs of blocks.
BLOCK = 1000
#: Pairs that a task holds before it adds them up and hands them on.
HELD = 1_000_000
#: Buckets of a set's counts, two bytes each; sets that could overflow one go without the bound they give.
BUCKETS, COUNTED = 128, 65_535
SIGNATURE = pa.schema([("doc", pa.int64()), ("size", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("prefix", pa.list_(pa.int64())), ("counts", pa.binary())])


def least_overlap(size: int, num: int, den: int) -> int:
    """What a set of this size shares at least with any partner."""
    return -(-num * size // den)


def prefix_length(size: int, num: int, den: int) -> int:
    """What a set can lack, plus one: two sets that link share one of so many shingles, in whatever order both go by."""
    return size - least_overlap(size, num, den) + 1 if size else 0


def spare_length(prefix: int, size: int) -> int:
    """Shingles read beyond the prefix, so that as many frequent ones can be left out: sets that link share one more for each."""
    return min(size - prefix, (prefix + 1) // 2)


def _signatures(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    no_cache()
    order = np.argsort(frequent)
    ranked = frequent[order]
    for batch in slices(batches, "text"):
        size, fp1, fp2, prefix, counts = [], [], [], [], []
        for found in shingle_sets(texts(batch, "text"), n):
            size.append(len(found))
            mark = xxhash.xxh3_128_intdigest(found.tobytes())
            fp1.append((mark >> 64) - (1 << 63))
            fp2.append((mark & (1 << 64) - 1) - (1 << 63))
            counts.append(np.minimum(np.bincount((found >> np.uint64(57)).astype(np.int64), minlength=BUCKETS), COUNTED).astype("<u2").tobytes())
            take = prefix_length(len(found), num, den)
            take += spare_length(take, len(found))
            if len(ranked) and len(found):
                at = np.minimum(np.searchsorted(ranked, found), len(ranked) - 1)
                known = ranked[at] == found
                late = found[known][np.argsort(-order[at[known]])]
                found = np.concatenate((found[~known], late))
            prefix.append(found[:take].view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(c, pa.int64()) for c in (size, fp1, fp2)), pa.array(prefix, pa.list_(pa.int64())), pa.array(counts, pa.binary())], schema=SIGNATURE)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    no_cache()
    for batch in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([s.tobytes() for s in shingle_sets(texts(batch, "text"), n)], pa.binary())], names=["doc", "hashes"])


def _shingles(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    no_cache()
    for batch in slices(batches, "text"):
        found = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(texts(batch, "text"), n)])
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["shingle"])


def _overlaps(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs of whole sets: the links among them."""
    for batch in batches:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.sort(np.concatenate((a, b)), kind="stable")
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            if den * shared >= num * (len(a) + len(b) - shared):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column("u").take(pa.array(keep, pa.int64())), batch.column("v").take(pa.array(keep, pa.int64()))], names=["u", "v"])


def _counts(column: pa.Array) -> np.ndarray:
    """Bucket counts as a matrix, a row a document."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, BUCKETS)


def _most(a: np.ndarray, b: np.ndarray, su: np.ndarray, sv: np.ndarray) -> np.ndarray:
    """The most that sets can share by their bucket counts, and by their sizes where counts may have overflowed."""
    return np.where(np.maximum(su, sv) < COUNTED, np.minimum(a, b).sum(1, dtype=np.int64), np.minimum(su, sv))


def _hopeful(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose bucket counts leave room for a link, with the most that they can share."""
    for batch in batches:
        su, sv = (batch.column(c).to_numpy() for c in ("su", "sv"))
        most = _most(_counts(batch.column("cu")), _counts(batch.column("cv")), su, sv) if len(su) else su
        keep = np.flatnonzero((num + den) * most >= num * (su + sv))
        yield pa.RecordBatch.from_arrays([batch.column("u").take(pa.array(keep)), batch.column("v").take(pa.array(keep)), pa.array(most[keep])], names=["u", "v", "most"])


def _summed(found: list[np.ndarray]) -> pa.RecordBatch:
    """Pairs (u, v, su, sv), each once, with how often it was found."""
    pairs, shared = np.unique(np.concatenate(found, 1), axis=1, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (*pairs, shared.astype(np.int64))], names=["u", "v", "su", "sv", "shared"])


def _block_pairs(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (column's first document, block pair, shingle): pairs of one block each, or of two, whose parts differ and whose sizes and
    bucket counts leave room for a link, with the overlap that this task has seen."""
    keys = ("head", "low", "high", "shingle")
    spare: tuple | None = None
    held: list[np.ndarray] = []
    size_held = 0
    for batch in _with_end(batches):
        if batch is not None:
            rows = np.stack([batch.column(c).to_numpy() for c in (*keys, "block", "doc", "size", "part")]), _counts(batch.column("counts"))
            rows = rows if spare is None else (np.concatenate((spare[0], rows[0]), 1), np.concatenate((spare[1], rows[1])))
            new = np.flatnonzero((rows[0][:4, -1:] != rows[0][:4]).any(0))
            cut = int(new[-1]) + 1 if len(new) else 0
            done, spare = (rows[0][:, :cut], rows[1][:cut]), (rows[0][:, cut:], rows[1][cut:])
        else:
            done = spare
        if done is not None and done[0].shape[1]:
            edges = np.flatnonzero((done[0][:4, 1:] != done[0][:4, :-1]).any(0)) + 1
            for group, counts in zip(np.split(done[0], edges, axis=1), np.split(done[1], edges), strict=True):
                for found in _pairs_of(group, counts, num, den):
                    held.append(found)
                    size_held += found.shape[1]
                    if size_held >= HELD:
                        yield _summed(held)
                        held, size_held = [], 0
    if held:
        yield _summed(held)


def _pairs_of(group: np.ndarray, counts: np.ndarray, num: int, den: int) -> Iterator[np.ndarray]:
    order = np.argsort(group[6], kind="stable")
    _, low, high, _, block, doc, size, part = group[:, order]
    counts = counts[order]
    # By size ascending: a partner of i is later and at most size * den / num long.
    reach = np.searchsorted(size, size * den // num, side="right")
    for i in range(len(doc) - 1):
        j = np.arange(i + 1, reach[i])
        j = j[(part[j] != part[i]) & ((low[0] == high[0]) | (block[j] != block[i]))]
        j = j[(num + den) * _most(counts[i], counts[j], size[i], size[j]) >= num * (size[i] + size[j])]
        if len(j):
            first, one = doc[j] > doc[i], np.full(len(j), i)
            u, v = np.where(first, one, j), np.where(first, j, one)
            yield np.stack((doc[u], doc[v], size[u], size[v]))


def _with_end(batches):
    yield from batches
    yield None


def _lengths(size: Column, num: int, den: int) -> tuple[Column, Column]:
    """prefix_length and spare_length, in whole numbers."""
    prefix = size - F.floor((num * size + (den - 1)) / F.lit(den)) + 1
    return prefix, F.least(size - prefix, F.floor((prefix + 1) / 2))


def _bound(shared: Column, su: Column, sv: Column, num: int, den: int) -> Column:
    """Whether so many shared shingles leave room for a link.

    What lies behind the shingles that were read adds at most the rest of the set whose reading ended first; of those that were read and are
    shared, at most as many were left out as the larger of both spares.
    """
    (pu, lu), (pv, lv) = (_lengths(s, num, den) for s in (su, sv))
    need = F.ceil((su + sv) * F.lit(num) / F.lit(den + num))
    return shared >= need - F.greatest(su - pu - lu, sv - pv - lv) - F.greatest(lu, lv)


def jaccard_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) a row: links are den * shared >= num * union; component_id is the smallest id reachable.

    A document's set: distinct n-word shingles of its lower-cased (A-Z) words between ASCII white space; with fewer words, the
    whole sequence as one; null or blank texts have the empty set and link with nothing. Rows of equal id are one node; rows
    with a null id have a null component. Shingles are compared as 64-bit hashes.

    1. Equal sets meet by fingerprint; their smallest id stands for them from here on.
    2. Of each set so many shingles are read, in the order of their hashes with frequent ones last, as it can lack, plus one, plus a spare;
       as many as the spare are left out again, those in the most documents. The others are its row of the incidence matrix: a set with enough
       shingles of its own has none that is shared.
    3. Within a shingle's column each row is multiplied with the column's first alone, and each document's most hopeful partner, by the
       counts of both sets in BUCKETS buckets, is verified. Links found so make parts.
    4. Columns that hold two parts or more are multiplied in blocks, across parts only; pairs that their sizes or bucket counts
       rule out are discarded on the spot, overlap counts of the others are added up, those below the bound that the sizes give
       go as well, and the rest is verified on whole sets. So a large group of copies
       costs as many pairs as it has documents, and no link between parts is missed.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    total = base.select("doc").count()
    sampled = base if total <= SAMPLE else base.sample(SAMPLE / total, 7)
    counts = sampled.mapInArrow(partial(_shingles, n=n), "shingle long").groupBy("shingle").count()
    frequent = np.array([r[0] for r in counts.where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "shingle").limit(KEPT).collect()], np.int64).view(np.uint64)
    signatures = base.mapInArrow(partial(_signatures, n=n, num=num, den=den, frequent=frequent), "doc long, size long, fp1 long, fp2 long, prefix array<long>, counts binary")
    signatures = materialize(signatures, "signatures")
    reps = signatures.where("doc is not null and size > 0").groupBy("fp1", "fp2").agg(F.min("doc").alias("doc"), F.any_value("size").alias("size"), F.any_value("prefix").alias("prefix"), F.any_value("counts").alias("counts"))
    read = reps.select("doc", "size", F.explode("prefix").alias("shingle"))
    several = read.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    prefix, spare = _lengths(F.col("size"), num, den)
    by_doc = W.partitionBy("doc")
    shared = read.join(several, "shingle").withColumns({"known": F.count("*").over(by_doc), "place": F.row_number().over(by_doc.orderBy("n", "shingle"))})
    kept = materialize(shared.where(F.col("place") <= F.col("known") - spare).select("shingle", "doc", "size"), "columns")
    first = kept.groupBy("shingle").agg(F.min("doc").alias("head"), F.max("doc").alias("last")).where("head <> last").drop("last")
    column = kept.join(first, "shingle")
    counts = reps.select("doc", "counts")
    sizes = column.where("doc = head").select(F.col("shingle"), F.col("size").alias("su"))
    star = column.where("doc <> head").join(sizes, "shingle").where(den * F.least("size", "su") >= num * F.greatest("size", "su"))
    star = star.select(F.col("head").alias("u"), F.col("doc").alias("v"), "su", F.col("size").alias("sv")).distinct()
    star = star.join(counts.select(F.col("doc").alias("u"), F.col("counts").alias("cu")), "u").join(counts.select(F.col("doc").alias("v"), F.col("counts").alias("cv")), "v")
    star = star.select("u", "v", "su", "sv", "cu", "cv").mapInArrow(partial(_hopeful, num=num, den=den), "u long, v long, most long")
    star = star.groupBy("v").agg(F.max_by("u", F.struct("most", -F.col("u"))).alias("u")).select("u", "v")
    links = _verify(materialize(star, "pairs"), base, n, num, den)
    part = components(links)
    discard(links)
    split = column.join(part, column.doc == part.node, "left").select("shingle", "doc", "size", F.coalesce("component", "doc").alias("part"))
    mixed = split.groupBy("shingle").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.count("*").alias("rows"), F.min("doc").alias("head")).where("a <> b")
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    # The columns of a first document go to as many tasks as their rows fill.
    mixed = mixed.select("shingle", "head", "rows", blocks.alias("blocks"))
    tasks = mixed.groupBy("head").agg(F.ceil(F.sum(F.col("rows") * F.col("blocks")) / (2 * BLOCK)).alias("tasks"))
    mixed = mixed.join(tasks, "head").withColumn("task", F.pmod(F.xxhash64("shingle"), F.col("tasks")))
    split = split.join(mixed.select("shingle", "head", "blocks", "task"), "shingle").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    split = split.withColumn("other", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x.cast("long"))))
    dealt = split.select("head", "task", "shingle", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "doc", "size", "part").join(counts, "doc")
    # A pair's columns mostly begin with the same document: dealt by that, most of its overlap is added up in one task.
    dealt = dealt.repartition("head", "task", "low", "high").sortWithinPartitions("head", "low", "high", "shingle")
    pairs = dealt.mapInArrow(partial(_block_pairs, num=num, den=den), "u long, v long, su long, sv long, shared long")
    pairs = pairs.groupBy("u", "v", "su", "sv").agg(F.sum("shared").alias("shared")).where(_bound(F.col("shared"), F.col("su"), F.col("sv"), num, den))
    pairs = materialize(pairs.select("u", "v"), "pairs")
    discard(kept)
    if pairs.isEmpty():
        whole = part
    else:
        more = _verify(pairs, base, n, num, den)
        whole = components(part.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
        discard(more)
    reps = reps.select("fp1", "fp2", F.col("doc").alias("head"))
    out = signatures.select("doc", "size", "fp1", "fp2").join(reps, ["fp1", "fp2"], "left").join(whole.withColumnRenamed("node", "head"), "head", "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component", "head", "doc")).alias("component_id"))


def _verify(pairs: DataFrame, base: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The linked ones among the pairs (u, v), on whole sets."""
    needed = pairs.select(F.explode(F.array("u", "v")).alias("doc")).distinct()
    found = base.join(needed, "doc", "left_semi").mapInArrow(partial(_sets, n=n), "doc long, hashes binary")
    found = materialize(found, "sets", "none")
    both = pairs.join(found.select(F.col("doc").alias("v"), F.col("hashes").alias("y")), "v").join(found.select(F.col("doc").alias("u"), F.col("hashes").alias("x")), "u")
    links = materialize(both.select("u", "v", "x", "y").mapInArrow(partial(_overlaps, num=num, den=den), "u long, v long"), "links")
    discard(pairs, found)
    return links
