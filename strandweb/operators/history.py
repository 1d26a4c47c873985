"""Full history of changing attributes by tree-reduction coalescing.

Each snapshot is a unit interval of its entity. Neighbouring interval runs are merged pairwise, by entity and equal
payload, over logarithmic rounds of one tree:

* The rows are range-partitioned by (entity, time) and sorted, so an entity with a third of all rows covers many
  partitions. A partition is read in *chunks* of bounded rows and bytes; the runs of a chunk start as its single rows, and
  in each of ``log2(rows)`` rounds neighbouring segments are joined, the two runs that touch becoming one if they agree
  (:func:`coalesce`; the table of runs shrinks as they merge).
* What may still grow over a chunk's edges is its first and its last run. These go on up the tree: pairs of neighbouring
  chunks, of partitions, and of groups of ``fan_in ** k`` partitions are joined on the executors (:func:`join_all`), a
  group-by over a few small rows for each round. Each join says what it changes below: a run is absorbed by its
  left neighbour, a run grows or learns where its successor starts, the versions of an entity are counted on.

Nothing is collected by the driver; memory is bounded by the chunk.

Defined cases: rows without entity or time don't count; of rows with equal entity and time the one with the highest
sequence number counts; payload arrays compare as sets without nulls, null arrays equal empty ones, null scalars equal
each other; an entity with one snapshot has one version; an empty input gives an empty history.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandweb.session import checkpointed

#: A chunk ends with the batch that brings it to so many rows or bytes.
CHUNK_ROWS, CHUNK_BYTES = 1 << 17, 32 << 20
#: Nodes that one group of a round joins, in ``log2(FAN_IN)`` pairwise rounds.
FAN_IN = 32
#: So many rows of changes are broadcast at most (60 bytes each); beyond it the join shuffles.
BROADCAST_CHANGES = 200_000


def as_set(column: Column) -> Column:
    """An array column as a sorted set without nulls; null as the empty set."""
    kept = F.array_sort(F.array_distinct(F.filter(column, lambda x: x.isNotNull())))
    return F.coalesce(kept, F.array().cast("array<string>"))


def coalesce(entity: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``(first, last, snapshots, rounds)`` of the runs of equal neighbours: positions of their end rows, and how many they hold.

    Rows start as runs of their own. ``segments`` holds where each segment's runs begin; a round joins the segments 0 and 1,
    2 and 3 and so on. A segment takes part in one joint of a round, so no run is merged twice in it.
    """
    n = len(entity)
    first, last, snapshots = np.arange(n), np.arange(n), np.ones(n, np.int64)
    segments, rounds = np.arange(n), 0
    while len(segments) > 1:
        right = segments[1::2]  # runs to the right of the joints
        a, b = last[right - 1], first[right]
        merged = right[(entity[a] == entity[b]) & (h1[a] == h1[b]) & (h2[a] == h2[b])]
        segments = segments[0::2]
        if len(merged):
            last[merged - 1] = last[merged]
            snapshots[merged - 1] += snapshots[merged]
            keep = np.ones(len(first), bool)
            keep[merged] = False
            first, last, snapshots = first[keep], last[keep], snapshots[keep]
            segments = segments - np.searchsorted(merged, segments)
        rounds += 1
    return first, last, snapshots, rounds


#: A run at the edge of a node, as it goes up the tree. ``leaf`` names the chunk whose last (or only) run it began as.
EDGE = ("entity", "h1", "h2", "valid_from", "last_seen", "snapshots", "next_from", "number", "leaf")


class Node:
    """A range of the ordered rows: its first run and its last run, which are one run if ``single``."""

    def __init__(self, head: dict, tail: dict, single: bool):
        self.head, self.tail, self.single = head, tail, single


def join(left: Node, right: Node) -> tuple[Node, list[dict], tuple | None]:
    """The node of both, what changes in the leaves below, and ``(entity, add)`` for the version numbers on the right side."""
    a, b = left.tail, right.head
    head, tail, changes, counted = left.head, right.tail, [], None
    if a["entity"] != b["entity"]:
        return Node(head, tail, False), changes, counted
    merged = (a["h1"], a["h2"]) == (b["h1"], b["h2"])
    grown = dict(a)
    if merged:
        changes.append({"leaf": b["leaf"], "absorbed": True})
        grown.update(last_seen=b["last_seen"], snapshots=a["snapshots"] + b["snapshots"], next_from=None if right.single else b["next_from"])
        changes.append({"leaf": a["leaf"], "more": b["snapshots"], "seen": b["last_seen"], "next": grown["next_from"]})
    else:
        grown["next_from"] = b["valid_from"]
        changes.append({"leaf": a["leaf"], "next": b["valid_from"]})
    add = a["number"] - merged
    if add:
        counted = (a["entity"], add)
    if left.single:
        head = grown
    if right.single and merged:
        tail = grown
    elif tail["entity"] == a["entity"]:
        tail = dict(tail, number=tail["number"] + add)
    return Node(head, tail, left.single and right.single and merged), changes, counted


def join_all(nodes: list[Node]) -> tuple[Node, list[dict], list[tuple], int]:
    """Neighbours pairwise until one node is left: it, the changes, ``(child, entity, add)`` counts, and the number of rounds.

    Only children that begin with the entity that is counted on have versions of it.
    """
    level = [(n, [i]) for i, n in enumerate(nodes)]
    changes, counts, rounds = [], [], 0
    while len(level) > 1:
        above = []
        for i in range(0, len(level) - 1, 2):
            (left, own), (right, others) = level[i], level[i + 1]
            node, said, counted = join(left, right)
            changes.extend(said)
            if counted:
                counts.extend((c, *counted) for c in others if nodes[c].head["entity"] == counted[0])
            above.append((node, own + others))
        if len(level) % 2:
            above.append(level[-1])
        level, rounds = above, rounds + 1
    return level[0][0], changes, counts, rounds


def _chunks(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _runs(batches: Iterator[pa.RecordBatch], schema: pa.Schema, payload: list[str], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The runs of each chunk of a sorted partition; numbers and ``next_from`` hold within the chunk."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for chunk, table in enumerate(_chunks(batches, rows, size)):
        entity = table["entity"].combine_chunks()
        n = len(entity)
        fresh = np.ones(n, bool)
        fresh[1:] = ~np.asarray(pc.equal(entity.slice(1), entity.slice(0, n - 1)).to_numpy(zero_copy_only=False), bool)
        number_of = np.cumsum(fresh)
        first, last, snapshots, _ = coalesce(number_of, *(np.asarray(table[c]) for c in ("h1", "h2")))
        m, at = len(first), np.arange(len(first))
        new = np.append(True, number_of[first[1:]] != number_of[first[:-1]])
        opens, time = pa.array(first), table["time"].combine_chunks()
        begins = time.take(opens)
        after = pa.concat_arrays([begins.slice(1), pa.nulls(1, time.type)])
        columns = {c: table[c].take(opens) for c in ("entity", "h1", "h2", *payload)} | {
            "valid_from": begins,
            "next_from": pc.if_else(pa.array(np.append(new[1:], True)), pa.nulls(m, time.type), after),
            "last_seen": time.take(pa.array(last)),
            "snapshots": pa.array(snapshots),
            "number": pa.array(at - np.maximum.accumulate(np.where(new, at, -1)) + 1),
            "head": pa.array(at == 0),
            "tail": pa.array(at == m - 1),
            "part": pa.array(np.full(m, part, np.int64)),
            "leaf": pa.array(np.full(m, (part << 32) + chunk, np.int64)),
        }
        yield from pa.table([columns[f.name].cast(f.type) for f in schema], schema=schema).combine_chunks().to_batches(max_chunksize=10_000)


def _round(schema: pa.Schema) -> object:
    """For one group of neighbouring nodes: the node above them (its edge runs), and what changes below."""

    def joined(key: tuple, table: pa.Table) -> pa.Table:
        above, by_child = key[0].as_py(), {}
        for row in table.to_pylist():
            by_child.setdefault(row["child"], []).append(row)
        children = sorted(by_child)
        nodes = []
        for c in children:
            head = next(r for r in by_child[c] if r["head"])
            tail = next(r for r in by_child[c] if r["tail"])
            nodes.append(Node(*({k: r[k] for k in EDGE} for r in (head, tail)), head["tail"]))
        node, changes, counts, _ = join_all(nodes)
        out = [{"child": above, "head": True, "tail": node.single, **node.head}]
        if not node.single:
            out.append({"child": above, "head": False, "tail": True, **node.tail})
        out.extend({"change": True, **c} for c in changes)
        out.extend({"change": True, "below": children[c], "entity": entity, "add": add} for c, entity, add in counts)
        return pa.table([pa.array([r.get(f.name) for r in out], f.type) for f in schema], schema=schema)

    return joined


def rounds_above(partitions: int, fan_in: int = FAN_IN) -> int:
    """Rounds over groups of partitions until one node is left; the first round joins the chunks of each partition."""
    rounds, width = 1, 1
    while width < partitions:
        rounds, width = rounds + 1, width * fan_in
    return rounds


def _changes(runs: DataFrame, partitions: int, fan_in: int) -> DataFrame:
    """``leaf, absorbed, offset, more, seen, next, head_entity``: one row for each chunk that its neighbours change.

    ``offset`` is for the versions of the entity that the chunk begins with.
    """
    kinds = dict(runs.dtypes)
    leaves = runs.where("head").select("leaf", "part", F.col("entity").alias("head_entity"))
    edges = runs.where("head or tail").select(F.col("leaf").alias("child"), "head", "tail", *EDGE)
    moment = kinds["valid_from"]
    shape = ", ".join(["child long, head boolean, tail boolean", *(f"{c} {kinds[c]}" for c in EDGE), f"change boolean, absorbed boolean, more long, seen {moment}, next {moment}, below long, add long"])
    arrow = to_arrow_schema(runs.sparkSession.createDataFrame([], shape).schema)
    said, counts = [], []
    for k in range(rounds_above(partitions, fan_in)):
        above = F.shiftrightunsigned("child", 32) if not k else F.expr(f"child div {fan_in}")
        joined = checkpointed(edges.groupBy(above.alias("above")).applyInArrow(_round(arrow), shape))
        edges = joined.where("change is null").select("child", "head", "tail", *EDGE)
        said.append(joined.where("change and below is null").select("leaf", "absorbed", F.lit(0).cast("long").alias("offset"), "more", "seen", "next"))
        counted = joined.where("below is not null").select("below", "entity", "add")
        if not k:  # the children are chunks
            counts.append(counted.select(F.col("below").alias("leaf"), "add"))
        else:  # they are groups of partitions: the count is for all chunks in them that begin with the entity
            width = fan_in ** (k - 1)
            wide = counted.select(F.explode(F.sequence(F.col("below") * width, F.col("below") * width + (width - 1))).alias("part"), F.col("entity").alias("head_entity"), "add")
            counts.append(leaves.join(wide, ["part", "head_entity"]).select("leaf", "add"))
    nothing = [F.lit(None).cast("boolean").alias("absorbed"), F.col("add").alias("offset"), F.lit(None).cast("long").alias("more"), F.lit(None).cast(moment).alias("seen"), F.lit(None).cast(moment).alias("next")]
    rows = [*said, *(c.select("leaf", *nothing) for c in counts)]
    united = rows[0]
    for r in rows[1:]:
        united = united.unionByName(r)
    changed = united.groupBy("leaf").agg(F.max("absorbed").alias("absorbed"), F.sum("offset").alias("offset"), F.sum("more").alias("more"), F.max("seen").alias("seen"), F.max("next").alias("next"))
    return changed.join(leaves.select("leaf", "head_entity"), "leaf")


def version_history(
    df: DataFrame, entity: str, time: str, sequence: str, scalars: list[str], arrays: list[str], carried: list[str] = (),
    partitions: int | None = None, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES, fan_in: int = FAN_IN,
) -> DataFrame:
    """Versions of each entity: ``entity, version_no, valid_from, valid_to, opened_by, last_seen, snapshots``, then the
    payload (``scalars`` and ``arrays``) and ``carried`` columns of the row that opened the version.

    ``valid_to`` is the start of the next version, null for the current one. Two shuffles of the rows: one aggregation that keeps
    the counting row of each (entity, time), one range partitioning; the tree's rounds move two rows of each chunk.
    """
    values = [*scalars, *arrays, *carried]
    sets = [as_set(F.col(c)) for c in arrays]
    tagged = [F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(c).cast("string"))) for c in scalars]
    rows = df.where(F.col(entity).isNotNull() & F.col(time).isNotNull()).select(
        F.col(entity).alias("entity"), F.col(time).alias("time"), F.col(sequence).alias("opened_by"),
        F.xxhash64(*tagged, *sets).alias("h1"), F.xxhash64(F.lit("other"), *sets, *tagged).alias("h2"), *[F.col(c).alias(f"v_{c}") for c in values],
    )
    inner = ["opened_by", "h1", "h2", *[f"v_{c}" for c in values]]
    kept = rows.groupBy("entity", "time").agg(F.max_by(F.struct(*inner), F.col("opened_by")).alias("r")).select("entity", "time", "r.*")
    ordered = kept.repartitionByRange(*([partitions] if partitions else []), "entity", "time").sortWithinPartitions("entity", "time")

    fields = {f.name: f for f in ordered.schema}
    payload = ["opened_by", *[f"v_{c}" for c in values]]
    moment = fields["time"].dataType
    out = T.StructType(
        [fields["entity"], fields["h1"], fields["h2"], *[fields[c] for c in payload]]
        + [T.StructField(c, moment) for c in ("valid_from", "next_from", "last_seen")]
        + [T.StructField(c, T.LongType()) for c in ("snapshots", "number", "part", "leaf")]
        + [T.StructField(c, T.BooleanType()) for c in ("head", "tail")]
    )
    arrow = to_arrow_schema(out)
    runs = checkpointed(ordered.mapInArrow(lambda batches: _runs(batches, arrow, payload, chunk_rows, chunk_bytes), out))
    changes = checkpointed(_changes(runs, runs.rdd.getNumPartitions(), fan_in))
    if changes.count() <= BROADCAST_CHANGES:
        changes = F.broadcast(changes)
    tail = F.col("tail")
    return (
        runs.join(changes, "leaf", "left")
        .where(~(F.col("head") & F.coalesce("absorbed", F.lit(False))))
        .select(
            F.col("entity").alias(entity),
            (F.col("number") + F.when(F.col("entity") == F.col("head_entity"), F.coalesce("offset", F.lit(0))).otherwise(0)).alias("version_no"),
            "valid_from",
            F.when(tail, F.coalesce("next", "next_from")).otherwise(F.col("next_from")).alias("valid_to"),
            "opened_by",
            F.when(tail, F.coalesce("seen", "last_seen")).otherwise(F.col("last_seen")).alias("last_seen"),
            (F.col("snapshots") + F.when(tail, F.coalesce("more", F.lit(0))).otherwise(0)).alias("snapshots"),
            *[F.col(f"v_{c}").alias(c) for c in values],
        )
    )
