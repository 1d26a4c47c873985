"""All pairs of records whose sets overlap above a Jaccard threshold, by T-occurrence list merging.

1. Sets are brought to sorted arrays of 64-bit value hashes, and identical sets are collapsed into one *class*, so a set
   that a third of all records share is compared once. The class is named by its smallest record id.
2. Values that occur in one class only can't be shared; they only count towards the set's size. A class whose remaining
   values can't reach the least overlap ``ceil(t * size)`` is dropped, exactly.
3. The inverted lists are partitioned by value. A class sends its remaining values to the partitions of its *prefix*,
   the ``size - ceil(t * size) + 1`` values of lowest frequency, one of which every partner shares. Where a prefix value
   is frequent (more than ``frequent`` classes), the lists are partitioned by pairs of values instead, of which partners
   share one if they share two values at all. Partitions with one member are dropped before the values are sent.
4. What is still larger than ``block`` members is cut into blocks, and each pair of blocks is a partition of its own:
   memory is bounded, and no pair is lost.
5. In a partition, each class probes the inverted lists of the smaller ones: the ``L`` longest lists are set aside, the
   others are merged with a heap that skips ids which can't occur ``T - L`` times, and the long lists are binary-searched
   for those that do. A pair is emitted in the partition of its first common value (or first two), so once.

Defined cases: null and repeated values don't count; sets below ``min_size`` (null and empty ones too) are in no pair; of
several rows with one id the union counts; a null id is no record. Value identity is that of 64-bit hashes: a pair of
sets of ``n`` values is judged wrongly with a probability below ``n * n / 2**64``.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweb.session import checkpointed

#: A value in more classes than this is frequent. Members of a partition at most.
FREQUENT, BLOCK = 256, 4096
#: What names a partition: the hash of its values, they themselves, and its pair of blocks.
PLACE = ("key", "t1", "t2", "bi", "bj")


def record_sets(df: DataFrame, record: str, values: str, min_size: int) -> DataFrame:
    """``(record, tokens)``: each record's set as a sorted array of value hashes."""
    held = F.filter(F.col(values), lambda x: x.isNotNull())
    rows = df.select(F.col(record).alias("record"), F.array_sort(F.array_distinct(F.transform(held, lambda x: F.xxhash64(x)))).alias("tokens"))
    rows = rows.where(F.col("record").isNotNull() & F.col("tokens").isNotNull())
    ids = df.select(F.col(record).alias("record")).where("record is not null")
    repeated = ids.groupBy("record").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("record")
    if not repeated.isEmpty():  # asked over the id column alone, so that the sets aren't read and shuffled where ids are unique
        united = rows.join(repeated, "record", "left_semi").select("record", F.explode("tokens").alias("t"))
        united = united.groupBy("record").agg(F.array_sort(F.collect_set("t")).alias("tokens"))
        rows = rows.join(repeated, "record", "left_anti").unionByName(united)
    return rows.where(F.size("tokens") >= min_size)


def merge_skip(lists: list[list[int]], starts: list[int], least: int) -> Iterator[tuple[int, int]]:
    """``(id, count)`` of the ids that occur in at least ``least`` of the sorted lists, from ``starts`` on."""
    heap = [(ids[s], i) for i, (ids, s) in enumerate(zip(lists, starts)) if s < len(ids)]
    heapq.heapify(heap)
    at = list(starts)
    while len(heap) >= least:
        top = heap[0][0]
        taken = []
        while heap and heap[0][0] == top:
            taken.append(heapq.heappop(heap)[1])
        if len(taken) >= least:
            yield top, len(taken)
            for i in taken:
                at[i] += 1
                if at[i] < len(lists[i]):
                    heapq.heappush(heap, (lists[i][at[i]], i))
            continue
        while heap and len(taken) < least - 1:  # skip: with these gone, no id below the next top can occur often enough
            taken.append(heapq.heappop(heap)[1])
        if not heap:
            return
        goal = heap[0][0]
        for i in taken:
            at[i] = bisect_left(lists[i], goal, at[i])
            if at[i] < len(lists[i]):
                heapq.heappush(heap, (lists[i][at[i]], i))


def partition_pairs(sizes: list[int], sets: list[list[int]], sides: list[int] | None, level: int, threshold: Fraction) -> Iterator[tuple[int, int, int]]:
    """``(i, j, overlap)`` of the similar members ``i < j`` of one partition, ordered by size.

    ``sets`` hold the shared values in the global order, the partition's key being ``level`` of them. ``sides`` tells the
    two blocks apart (only pairs across count), or is None within a block.
    """
    p, q = threshold.numerator, threshold.denominator
    lists: dict[int, list[int]] = {}
    n = len(sizes)
    if n == 2:
        a, b = set(sets[0]), set(sets[1])
        if (sides is None or sides[0] != sides[1]) and (o := len(a & b)) * (p + q) >= p * (sizes[0] + sizes[1]):
            yield 0, 1, o
        return
    for j in range(n):
        size, own = sizes[j], sets[j]
        low = bisect_left(sizes, -(-p * size // q), 0, j)
        least = -(-p * size // q)
        mine = [lists[t] for t in own if t in lists and lists[t][-1] >= low]
        if low < j and len(mine) >= least:
            mine.sort(key=len)
            spare = min(least - 1, len(mine) - 1)
            longest = mine[len(mine) - spare :] if spare else []
            short = mine[: len(mine) - spare]
            starts = [bisect_left(x, low) for x in short]
            for i, count in merge_skip(short, starts, least - spare):
                if sides is not None and sides[i] == sides[j]:
                    continue
                need = -(-p * (sizes[i] + size) // (p + q))
                left = spare
                for x in longest:
                    if count + left < need:
                        break
                    left -= 1
                    at = bisect_left(x, i)
                    if at < len(x) and x[at] == i:
                        count += 1
                if count >= need:
                    yield i, j, count
        for t in own:
            if t in lists:
                lists[t].append(j)
            else:
                lists[t] = [j]


def _probe(batches: Iterator[pa.RecordBatch], threshold: Fraction, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Partitions follow each other in the sorted rows; one at a time is held."""

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        key = [np.asarray(table[c]) for c in PLACE]
        change = np.any([k[1:] != k[:-1] for k in key], axis=0)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), table.num_rows]
        tokens = table["tokens"].chunk(0) if table["tokens"].num_chunks else pa.array([], table["tokens"].type)
        flat, offsets = np.asarray(tokens.flatten()), np.asarray(tokens.offsets) - tokens.offsets[0].as_py()
        size, block, t1, t2 = (np.asarray(table[c]) for c in ("size", "block", "t1", "t2"))
        left, right, overlap = [], [], []
        for s, e in zip(cuts, cuts[1:]):
            cross = key[3][s] != key[4][s]
            level = 1 if t1[s] == t2[s] else 2
            first, second = int(t1[s]), int(t2[s])
            sets = [flat[offsets[i] : offsets[i + 1]].tolist() for i in range(s, e)]
            for i, j, o in partition_pairs(size[s:e].tolist(), sets, block[s:e].tolist() if cross else None, level, threshold):
                other, common = set(sets[j]), []
                for t in sets[i]:
                    if t in other:
                        common.append(t)
                        if len(common) == level:
                            break
                if common == ([first] if level == 1 else [first, second]):
                    left.append(s + i)
                    right.append(s + j)
                    overlap.append(o)
        if left:
            a, b = pa.array(left), pa.array(right)
            columns = {"class_a": table["rep"].take(a), "class_b": table["rep"].take(b), "overlap": pa.array(overlap, pa.int32()), "size_a": table["size"].take(a), "size_b": table["size"].take(b)}
            out = pa.table([columns[f.name].cast(f.type) for f in schema], schema=schema)
            yield from out.combine_chunks().to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(c)[-1].as_py() for c in PLACE]
        same = np.all([np.asarray(batch.column(c)) == v for c, v in zip(PLACE, last)], axis=0)
        cut = batch.num_rows if not same.any() else int(np.argmax(same))  # rows of one partition are consecutive
        if cut:
            yield from pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        elif held and [held[-1].column(c)[-1].as_py() for c in PLACE] != last:
            yield from pairs(pa.Table.from_batches(held))
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield from pairs(pa.Table.from_batches(held))


def similar_sets(sets: DataFrame, threshold: Fraction, min_size: int, frequent: int = FREQUENT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(classes, pairs)`` of :func:`record_sets` rows.

    ``classes``: ``rep, tokens, copies``, one row per different set. ``pairs``: ``class_a, class_b, overlap, size_a,
    size_b``, one row per pair of similar classes, in no particular order within the pair.
    """
    p, q = threshold.numerator, threshold.denominator
    classes = sets.groupBy("tokens").agg(F.min("record").alias("rep"), F.count(F.lit(1)).alias("copies"))
    kind = dict(classes.dtypes)["rep"]
    postings = classes.select("rep", F.size("tokens").alias("size"), F.explode("tokens").alias("t"))
    # Counting rep, not rows, keeps both readers of the classes alike, so that Spark shuffles the sets once for both.
    shared = postings.groupBy("t").agg(F.count("rep").alias("n")).where("n > 1")
    least = f"cast(({p}L * size + {q - 1}) div {q} as int)"
    members = (
        postings.join(shared, "t").groupBy("rep", "size").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("held"))
        .where(F.expr(f"size(held) >= {least}"))
        .select("rep", "size", "held", F.expr(f"size - {least} + 1 - (size - size(held))").alias("prefix"))
    )
    members = checkpointed(members)
    # Keys: a rare prefix value alone, or a frequent one with each later value of the prefix that is one longer.
    two = -(-p * min_size // q) >= 2
    alone = f"transform(filter(slice(held, 1, prefix), x -> x.n <= {frequent if two else 1 << 62}L), x -> struct(x.t as t1, x.t as t2))"
    paired = f"""flatten(transform(slice(held, 1, prefix), (x, i) -> if(x.n <= {frequent}L, array(),
        transform(slice(held, i + 2, greatest(prefix - i, 0)), y -> struct(x.t as t1, y.t as t2)))))"""
    keys = members.select("rep", "size", F.explode(F.expr(f"concat({alone}, {paired})" if two else alone)).alias("k")).select("rep", "size", "k.*")
    keys = keys.withColumn("key", F.xxhash64("t1", "t2"))
    crowds = keys.groupBy("key", "t1", "t2").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    spread = (
        keys.join(crowds, ["key", "t1", "t2"])
        .withColumn("blocks", F.expr(f"cast((crowd + {block - 1}) div {block} as int)"))
        .withColumn("block", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("rep", "size", "key", "t1", "t2", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    )
    sent = spread.join(members.select("rep", F.col("held.t").alias("tokens")), "rep")
    placed = sent.repartition(*PLACE).sortWithinPartitions(*PLACE, "size", "rep")
    out = T.StructType([T.StructField("class_a", sent.schema["rep"].dataType), T.StructField("class_b", sent.schema["rep"].dataType), *[T.StructField(c, T.IntegerType()) for c in ("overlap", "size_a", "size_b")]])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    pairs = placed.mapInArrow(lambda batches: _probe(batches, threshold, arrow), out)
    assert kind == dict(pairs.dtypes)["class_a"]
    return classes, pairs


#: Copies of a class that meet in one task when pairs are expanded.
COPIES = 1024


def _named(sets: DataFrame, least: int) -> DataFrame:
    """``(record, rep, block, blocks)`` of the records of classes with at least ``least`` copies.

    Classes are told apart by 128 bits of their sets here, which are a fraction of the sets' size. A class is cut into blocks of about
    ``COPIES`` records, by their hash.
    """
    tagged = sets.select("record", F.xxhash64("tokens").alias("m1"), F.xxhash64(F.lit("member"), "tokens").alias("m2"))
    classes = tagged.groupBy("m1", "m2").agg(F.min("record").alias("rep"), F.count(F.lit(1)).alias("copies"))
    named = tagged.join(classes.where(F.col("copies") >= least) if least > 1 else classes, ["m1", "m2"])
    blocks = F.ceil(F.col("copies") / COPIES).cast("int")
    return named.select("record", "rep", F.pmod(F.xxhash64("record", F.lit("copy")), blocks).cast("int").alias("block"), blocks.alias("blocks"))


def members_of(sets: DataFrame) -> DataFrame:
    """:func:`_named` of the classes with several copies; a single record is its class's name."""
    return _named(sets, 2)


def _expanded(wide: DataFrame, rep: str, members: DataFrame, name: str, alone: bool) -> DataFrame:
    """``wide`` with ``name``: each record of the class ``rep``, block by block, so no task holds a large class.

    With ``alone`` classes without members stand for themselves.
    """
    large = members.where("blocks > 1").groupBy("rep").agg(F.max("blocks").alias("__blocks")).withColumnRenamed("rep", rep)
    spread = wide.join(large, rep, "left").withColumn("__block", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__blocks") - 1, F.lit(0)))))
    side = members.select(F.col("rep").alias(rep), F.col("block").alias("__block"), F.col("record").alias(name))
    if not alone:
        return spread.join(side, [rep, "__block"]).drop("__block", "__blocks")
    found = spread.join(side, [rep, "__block"], "left").where(F.col(name).isNotNull() | F.col("__blocks").isNull())  # an empty block has no record
    return found.withColumn(name, F.coalesce(name, rep)).drop("__block", "__blocks")


def expand_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(a, b)`` with a < b: all pairs of records, copies included. For results that ask for each pair of rows."""
    wide = pairs.select("class_a", "class_b")
    for name in ("a", "b"):
        wide = _expanded(wide, f"class_{name}", members, name, True)
    crossed = wide.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # Pairs of equal sets: the records of a block meet all of their class, in a task of their own for each block.
    within = members.select("rep", "block", F.col("record").alias("a"))
    others = members.select("rep", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("record").alias("b"))
    return crossed.unionByName(within.join(others, ["rep", "block"]).where("a < b").select("a", "b"))


def pairs_between(left: DataFrame, right: DataFrame, left_record: str, right_record: str, values: str, threshold: Fraction, min_size: int) -> DataFrame:
    """``(a, b)``: the records of ``left`` and of ``right`` with similar sets, copies expanded; pairs within one table are not."""
    sides = ((left, left_record), (right, right_record))
    tagged = [record_sets(d, r, values, min_size).select(F.struct(F.lit(i).alias("side"), F.col("record").alias("id")).alias("record"), "tokens") for i, (d, r) in enumerate(sides)]
    sets = tagged[0].unionByName(tagged[1])
    classes, pairs = similar_sets(sets, threshold, min_size)
    ways = pairs.select(F.col("class_a").alias("x"), F.col("class_b").alias("y")).unionByName(pairs.select(F.col("class_b").alias("x"), F.col("class_a").alias("y")))
    ways = ways.unionByName(classes.where("copies > 1").select(F.col("rep").alias("x"), F.col("rep").alias("y")))
    named = _named(sets, 1)
    both = _expanded(_expanded(ways, "x", named.where("record.side = 0"), "a", False), "y", named.where("record.side = 1"), "b", False)
    return both.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
