"""Flows from entry points, dependents and tests of symbols: bounded traversals by levels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.operators.order import numbered
from codelattice.sources.storage import drop, stored

#: Words of 64 entry points that are traced at a time, rows that a task merges at once, and rounds that bring entry points of one neighbourhood together.
WORDS = 128
ROWS = 20_000
ROUNDS = 4


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Words of binary or list rows, a row each."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, width)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, width)


def _ored(keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with all of its bits."""
    if not len(keys):
        return keys, bits
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
    return keys[order][first], np.bitwise_or.reduceat(bits[order], first, axis=0)


def _merged(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(id, bits) batches, merged by id about ROWS rows at a time."""
    keys, bits, n = [], [], 0
    for batch in batches:
        keys.append(batch.column(0).to_numpy(zero_copy_only=False))
        bits.append(_matrix(batch.column(1), width))
        n += batch.num_rows
        if n >= ROWS:
            yield _ored(np.concatenate(keys), np.concatenate(bits))
            keys, bits, n = [], [], 0
    if n:
        yield _ored(np.concatenate(keys), np.concatenate(bits))


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], pa.binary())


@dataclass
class FlowSets:
    """What entry points reach, in turns of so many entry points that their names can be broadcast.

    A turn is sets (node, depth, bits, and what is told of the node), bits having one for
    each entry point in `width` words, and names (word, entries, and alive: those of them
    that reach another node). Flows of a single node are left out of all that is read from them.
    """

    turns: list[tuple[DataFrame, DataFrame]]
    width: int

    def rows(self) -> DataFrame:
        """entry, node, depth of each pair of an entry point and a node."""
        parts = []
        for sets, names in self.turns:
            words = sets.select("node", "depth", F.posexplode("bits").alias("word", "set")).where("set <> 0").join(F.broadcast(names), "word")
            each = words.select("node", "depth", F.expr("set & alive").alias("set"), F.posexplode("entries").alias("pos", "entry"))
            parts.append(each.where("shiftright(set, pos) & 1 = 1").select("entry", "node", "depth"))
        return reduce(DataFrame.union, parts)

    def summed(self, *columns: str, distinct: str | None = None) -> DataFrame:
        """entry, n, depth (the greatest), the sums of told whole numbers over each entry point's nodes, and how many values of `distinct` they have.

        Each task adds up what it reads, and sends one row for each entry point.
        """
        width, parts = self.width, []
        kinds = ["n", *columns, "depth"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, depth = np.zeros((64 * width, len(kinds) - 1), np.int64), np.full(64 * width, -1, np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    some = batch.slice(at, 1000)
                    bits = np.unpackbits(_matrix(some.column(0), width).view(np.uint8), axis=1, bitorder="little")
                    worth = np.stack([np.ones(some.num_rows), *(some.column(i + 2).to_numpy().astype(float) for i in range(len(columns)))], 1)
                    sums += np.rint(bits.T.astype(np.float64) @ worth).astype(np.int64)
                    far = some.column(1).to_numpy()
                    for level in np.unique(far):
                        depth[bits[far == level].any(0)] = np.maximum(depth[bits[far == level].any(0)], level)
            used = np.flatnonzero(depth >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(x[used].astype(np.int64)) for x in (np.arange(64 * width), *sums.T, depth)], ["pos", *kinds])

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, bits = np.zeros(0, object), np.zeros((0, width), np.uint64)
            for key, more in _merged(batches, width):
                keys, bits = _ored(np.concatenate([keys, key]), np.concatenate([bits, more]))
            n = np.zeros(64 * width, np.int64)
            for at in range(0, len(bits), 1000):
                n += np.unpackbits(np.ascontiguousarray(bits[at : at + 1000]).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["pos", "n"])

        for sets, names in self.turns:
            sums = sets.select("bits", "depth", *columns).mapInArrow(run, "pos long, " + ", ".join(f"{c} long" for c in kinds))
            sums = sums.groupBy("pos").agg(*(F.sum(c).alias(c) for c in kinds[:-1]), F.max("depth").cast("int").alias("depth"))
            if distinct:
                found = sets.where(F.col(distinct).isNotNull()).select(distinct, "bits").repartition(distinct).mapInArrow(counted, "pos long, n long")
                sums = sums.join(found.groupBy("pos").agg(F.sum("n").alias(f"{distinct}s")), "pos", "left").na.fill(0, [f"{distinct}s"])
            living = names.select("word", "alive", F.posexplode("entries").alias("at", "entry")).where("shiftright(alive, at) & 1 = 1")
            parts.append(sums.join(living.select((F.col("word") * 64 + F.col("at")).alias("pos"), "entry"), "pos").drop("pos"))
        return reduce(DataFrame.union, parts)


def _traced(starts: DataFrame, step: DataFrame, depth: int, width: int) -> list[DataFrame]:
    """id, fresh, seen of each level: what the starts (id, pos) reach over step (id, next); fresh is empty where a level adds nothing."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos = batch.column(1).to_numpy()
            bits = np.zeros((len(pos), width), np.uint64)
            bits[np.arange(len(pos)), pos // 64] = np.uint64(1) << (pos % 64).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(bits), _binary(bits)], ["id", "fresh", "seen"])

    def less(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, bits in _merged(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array(keys), _binary(bits), pa.array(np.zeros(len(keys), bool))], ["id", "bits", "held"])

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a row of a node's set is told from what reaches it by the lowest bit of its key
        keys, bits = np.zeros(0, np.int64), np.zeros((0, width), np.uint64)
        told = (pa.RecordBatch.from_arrays([pa.array(2 * b.column(0).to_numpy() + b.column(2).to_numpy(zero_copy_only=False)), b.column(1)], ["id", "bits"]) for b in batches)
        for key, more in _merged(told, width):
            keys, bits = _ored(np.concatenate([keys, key]), np.concatenate([bits, more]))
        ids, at = np.unique(keys >> 1, return_inverse=True)
        seen, now = (np.zeros((len(ids), width), np.uint64) for _ in range(2))
        seen[at[keys & 1 == 1]] = bits[keys & 1 == 1]
        now[at[keys & 1 == 0]] = bits[keys & 1 == 0]
        fresh = now & ~seen
        seen |= fresh
        for k in range(0, len(ids), ROWS):
            some = pa.array([x.tobytes() if x.any() else b"" for x in fresh[k : k + ROWS]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + ROWS]), some, _binary(seen[k : k + ROWS])], ["id", "fresh", "seen"])

    levels = [stored(starts.select("id", "pos").mapInArrow(own, "id long, fresh binary, seen binary"), "traced")]
    for _ in range(depth):
        found = levels[-1].where("length(fresh) > 0").join(step, "id").select("next", "fresh").mapInArrow(less, "id long, bits binary, held boolean")
        both = found.union(levels[-1].select("id", "seen", F.lit(True))).repartition("id")
        levels.append(stored(both.mapInArrow(grown, "id long, fresh binary, seen binary"), "traced"))
        if levels[-1].where("length(fresh) > 0").isEmpty():
            break
    return levels


def flow_sets(entries: DataFrame, calls: DataFrame, depth: int = 15, about: DataFrame | None = None) -> FlowSets:
    """What each entry point (qualified_name) reaches over resolved calls in `depth` steps at most, itself included.

    about: node and what is to be told of it; nodes that it lacks are left out then.
    64 * WORDS entry points are traced at a time, so that no more than their sets move at once.
    """
    plain = stored(calls.where("not is_bare and source is not null and target is not null").select("source", "target").distinct(), "calls")
    starts = stored(entries.where("qualified_name is not null").select("qualified_name").distinct(), "entries")
    known = plain.select(F.col("source").alias("node")).union(plain.select("target")).union(starts).distinct()
    ids = stored(numbered(known, [F.col("node")], "id"), "names")
    step = stored(plain.join(ids.toDF("source", "id"), "source").join(ids.toDF("target", "next"), "target").select("id", "next"), "steps")
    near = stored(ids.select("id", F.col("id").alias("home")), "homes")
    for _ in range(ROUNDS):
        met = step.union(step.select("next", "id")).join(near, "id").select(F.col("next").alias("id"), "home")
        last, near = near, stored(met.union(near).groupBy("id").agg(F.min("home").alias("home")), "homes")
        drop(last)
    placed = numbered(starts.join(ids.toDF("qualified_name", "id"), "qualified_name").join(near, "id"), [F.col("home"), F.col("id")])
    placed = stored(placed.select("id", F.col("qualified_name").alias("entry"), "place"), "placed")
    last = placed.agg(F.max("place")).first()[0] or 0
    width = min(WORDS, last // 64 + 1)
    told = ids if about is None else stored(ids.join(about, "node"), "told")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = _matrix(batch.column(0), width).view(np.int64).ravel()
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, len(bits) + 1, width), pa.int32()), pa.array(bits))
            yield pa.RecordBatch.from_arrays([rows, *batch.columns[1:]], ["bits", *batch.schema.names[1:]])

    turns = []
    for first in range(0, last + 1, 64 * width):
        own = placed.where(F.col("place").between(first, first + 64 * width - 1)).select("id", "entry", (F.col("place") - first).alias("pos"))
        levels = _traced(own, step, depth, width)
        reached = reduce(DataFrame.union, [x.where("length(fresh) > 0").select("id", F.lit(i).alias("depth"), F.col("fresh").alias("bits")) for i, x in enumerate(levels)])
        rows = reached.join(told, "id").drop("id").sortWithinPartitions("node", "depth")
        rows = rows.select("bits", *(c for c in rows.columns if c != "bits"))
        sets = stored(rows.mapInArrow(lists, "bits array<long>, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:])), "flows")
        alive = reached.where("depth > 0").select(F.col("bits"), "depth").mapInArrow(lists, "bits array<long>, depth int")
        alive = alive.select(F.posexplode("bits").alias("word", "set")).groupBy("word").agg(F.bit_or("set").alias("alive"))
        names = own.groupBy(F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.array_sort(F.collect_list(F.struct("pos", "entry")))["entry"].alias("entries"))
        turns.append((sets, stored(names.join(alive, "word"), "words")))
        drop(*levels)
    drop(plain, starts, ids, step, near, placed, *([] if about is None else [told]))
    return FlowSets(turns, width)


def flow_nodes(entries: DataFrame, calls: DataFrame, depth: int = 15) -> DataFrame:
    """entry, node, depth: what each entry point reaches over resolved calls, all entry points at once.

    Flows of a single node are left out.
    """
    return flow_sets(entries, calls, depth).rows().select("entry", "node", "depth")


def to_retrace(flows: DataFrame, before: DataFrame, entries: DataFrame, nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Entry points (qualified_name) whose flow must be traced again: those that weren't entry points before, and those whose stored flow or own file a changed file (file_path) is part of."""
    homes = nodes.select(F.col("qualified_name").alias("node"), "file_path").join(changed.select("file_path").distinct(), "file_path", "left_semi").select("node")
    touched = flows.join(homes, "node", "left_semi").select(F.col("entry").alias("qualified_name"))
    new = entries.select("qualified_name").join(before.select("qualified_name"), "qualified_name", "left_anti")
    own = entries.select("qualified_name").join(homes.toDF("qualified_name"), "qualified_name", "left_semi")
    return new.union(own).union(entries.select("qualified_name").join(touched, "qualified_name", "left_semi")).distinct()


def retrace(flows: DataFrame, before: DataFrame, entries: DataFrame, calls: DataFrame, nodes: DataFrame, changed: DataFrame, depth: int = 15) -> DataFrame:
    """entry, node, depth after a change: the stored flows (entry, node, depth) that it leaves alone, and only the others traced anew.

    before and entries: the entry points (qualified_name) then and now. Calls may differ only
    where they stand in changed files (file_path). nodes must hold the symbols of then and now,
    with their files. What was an entry point and is none any more loses its flow.
    """
    again = stored(to_retrace(flows, before, entries, nodes, changed), "again")
    kept = flows.join(entries.select(F.col("qualified_name").alias("entry")), "entry", "left_semi").join(again.select(F.col("qualified_name").alias("entry")), "entry", "left_anti")
    return kept.select("entry", "node", "depth").union(flow_nodes(again, calls, depth).select("entry", "node", "depth"))


def flow_depth(flows: DataFrame) -> DataFrame:
    return flows.groupBy("entry").agg(F.count("*").alias("n_nodes"), F.max("depth").alias("depth"))


def depths(sets: FlowSets) -> DataFrame:
    """As flow_depth."""
    return sets.summed().select("entry", F.col("n").alias("n_nodes"), "depth")


def traits(nodes: DataFrame, calls: DataFrame, tested: DataFrame, words: list[str]) -> DataFrame:
    """node, file, secure, outside, covered: what the criticality of a flow takes from each symbol."""
    outside = calls.where("is_bare").groupBy(F.col("source").alias("node")).agg(F.count("*").alias("outside"))
    covered = tested.select(F.col("source").alias("node"), F.lit(1).alias("covered")).distinct()
    known = nodes.select(F.col("qualified_name").alias("node"), F.col("file_path").alias("file"), F.lower("qualified_name").rlike("|".join(words)).cast("int").alias("secure"))
    zero = F.lit(0)
    return known.join(outside, "node", "left").join(covered, "node", "left").select("node", "file", "secure", F.coalesce("outside", zero).alias("outside"), F.coalesce("covered", zero).alias("covered"))


def _rated(sums: DataFrame) -> DataFrame:
    # .30 (files - 1) / 4 + .20 outside / 5 + .25 secure / n + .15 (1 - covered / n) + .10 depth / 10, in whole thousandths of 1 / n, so that halves round up exactly
    part = "(75 * least(files - 1, 4) + 40 * least(outside, 5) + 10 * least(depth, 10)) * n + 250 * secure + 150 * (n - covered)"
    return sums.select("entry", F.expr(f"cast((20 * ({part}) + n) div (2 * n) as double) / 10000").alias("criticality"))


def criticality(flows: DataFrame, nodes: DataFrame, calls: DataFrame, tested: DataFrame, words: list[str]) -> DataFrame:
    """entry, criticality: spread over files, unresolved calls, security words, missing tests and depth, from 0 to 1."""
    rows = flows.join(traits(nodes, calls, tested, words), "node")
    return _rated(rows.groupBy("entry").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"), *(F.sum(c).alias(c) for c in ("outside", "secure", "covered")), F.max("depth").alias("depth")))


def set_criticality(sets: FlowSets) -> DataFrame:
    """As criticality, of sets that tell the traits of their nodes."""
    return _rated(sets.summed("outside", "secure", "covered", distinct="file"))


def touched_flows(flows: DataFrame, changed: DataFrame) -> DataFrame:
    """Entry points whose flow holds a changed node, with the number of such nodes."""
    return flows.join(changed.select(F.col("qualified_name").alias("node")).distinct(), "node", "left_semi").groupBy("entry").agg(F.count("*").alias("n_changed"))


def touched_sets(entries: DataFrame, calls: DataFrame, changed: DataFrame, depth: int = 15) -> DataFrame:
    """As touched_flows, of the flows that it traces."""
    sets = flow_sets(entries, calls, depth, changed.select(F.col("qualified_name").alias("node")).distinct())
    return sets.summed().select("entry", F.col("n").alias("n_changed"))


def ripple(calls: DataFrame, changed: DataFrame) -> DataFrame:
    """Other files that call a changed symbol, by its qualified or its bare name."""
    names = changed.select(F.col("qualified_name").alias("target"), F.lit(False).alias("is_bare")).union(changed.select("name", F.lit(True))).distinct()
    own = changed.select("file_path").distinct()
    return calls.join(names, ["target", "is_bare"], "left_semi").select("file_path").distinct().join(own, "file_path", "left_anti")


def tests_of(changed: DataFrame, calls: DataFrame, tested: DataFrame) -> DataFrame:
    """test, indirect: tests of the changed symbols, and of what they call."""
    direct = changed.select(F.col("qualified_name").alias("source")).distinct()
    called = calls.where("not is_bare").join(direct, "source", "left_semi").select(F.col("target").alias("source")).distinct()
    either = direct.withColumn("indirect", F.lit(False)).union(called.withColumn("indirect", F.lit(True)))
    return tested.join(either, "source").groupBy(F.col("target").alias("test")).agg(F.min("indirect").alias("indirect"))


def test_evidence(nodes: DataFrame, calls: DataFrame, tested: DataFrame) -> DataFrame:
    """Production symbols that a test calls by their qualified name, or by a name that only they have."""
    by_name = calls.where("is_bare and source_test").select(F.col("target").alias("name")).distinct()
    unique = nodes.groupBy("name").agg(F.count("*").alias("c")).where("c = 1").select("name").join(by_name, "name", "left_semi")
    rows = nodes.where("not is_test").select("qualified_name", "name")
    marked = rows.join(tested.select(F.col("source").alias("qualified_name"), F.lit(True).alias("q")).distinct(), "qualified_name", "left").join(unique.withColumn("b", F.lit(True)), "name", "left")
    return marked.where("q or b").select("qualified_name", F.coalesce("q", F.lit(False)).alias("by_qualified"), F.coalesce("b", F.lit(False)).alias("by_name"))
