"""Exact top-k search in binary codes by incremental multi-index hashing.

A 64-bit code is cut into m segments, each with an index of its own.  A code within distance d of a query is within
floor(d / m) of it in some segment.  The search radius of the segments grows step by step: after radius r all codes within
m * (r + 1) - 1 have been met, so a query ends as soon as its k-th verified distance is not beyond that.  Equal codes are one
entry of the index, whatever their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BITS = 64
K = 10
#: Seed of the projections for vectors with more than 64 dimensions.
SEED = 11
#: Entries of a part of a segment's index: its values are dealt by their upper bits, at least PART_BITS of them.
PART_ENTRIES, PART_BITS = 100_000, 3


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code): the signs of the first 64 dimensions as bits (missing dimensions and NaN: 0); vectors with more
    dimensions are projected on 64 fixed random directions first.  Rows with a null id or vector have no code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions: dict[int, np.ndarray] = {}
        weight = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
        for batch in batches:
            codes = np.zeros(batch.num_rows, np.uint64)
            for i, v in enumerate(batch.column(1)):
                x = np.nan_to_num(np.array([0.0 if y is None else y for y in v.as_py()], np.float64))
                if len(x) > BITS:
                    if len(x) not in directions:
                        directions[len(x)] = np.random.Generator(np.random.PCG64(SEED)).standard_normal((len(x), BITS))
                    x = x @ directions[len(x)]
                codes[i] = weight[:len(x)][x > 0].sum(dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], names=["id", "code"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    return rows.filter("id is not null and v is not null").mapInArrow(run, "id long, code long")


def segments(n_codes: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment; a segment has about log2 of the number of codes."""
    bits = min(max(round(math.log2(max(n_codes, 2))), 4), 32)
    m = -(-BITS // bits)
    edge = [round(i * BITS / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _cut(code: np.ndarray, segment: tuple[int, int]) -> np.ndarray:
    return (code.view(np.uint64) >> np.uint64(segment[0])) & np.uint64((1 << segment[1]) - 1)


def part_bits(cuts: list[tuple[int, int]], n_codes: int) -> list[int]:
    """Upper bits of each segment's values that name a part."""
    wanted = max(PART_BITS, math.ceil(math.log2(max(n_codes, 1) / PART_ENTRIES))) if n_codes > PART_ENTRIES else PART_BITS
    return [min(wanted, bits - 1) for _, bits in cuts]


def _index(codes: DataFrame, cuts: list[tuple[int, int]], upper: list[int]) -> DataFrame:
    """(seg, part, value, code, first): a row for each segment of each distinct code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column(0).to_numpy(zero_copy_only=False)
            for s, cut in enumerate(cuts):
                value = _cut(code, cut).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(code), s, np.int32)), pa.array(value >> (cut[1] - upper[s])), pa.array(value),
                     batch.column(0), batch.column(1)], names=["seg", "part", "value", "code", "first"])

    return codes.select("code", "first").mapInArrow(run, "seg int, part long, value long, code long, first long")


def _probes(active: DataFrame, cuts: list[tuple[int, int]], upper: list[int], radius: int) -> DataFrame:
    """(seg, part, left, qcode): the parts that hold values at exactly ``radius`` from a query's segment, with the flips
    that are left for the lower bits.  The values themselves are made in the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column(0).to_numpy(zero_copy_only=False)
            for s, cut in enumerate(cuts):
                own = _cut(code, cut).view(np.int64) >> (cut[1] - upper[s])
                for part in range(1 << upper[s]):
                    left = radius - np.bitwise_count(own ^ part).astype(np.int64)
                    at = np.flatnonzero((left >= 0) & (left <= cut[1] - upper[s]))
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), s, np.int32)), pa.array(np.full(len(at), part, np.int64)),
                             pa.array(left[at]), pa.array(code[at])], names=["seg", "part", "left", "qcode"])

    return active.select("qcode").mapInArrow(run, "seg int, part long, left long, qcode long")


def _verify(keep: int, cuts: list[tuple[int, int]], upper: list[int]):
    """The nearest ``keep`` codes of each query among the entries of a part that its values hit."""

    def run(probes: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"qcode": [], "code": [], "first": [], "dist": []}, dtype=np.int64)
        if not len(probes) or not len(index):
            return none
        seg, part = int(probes["seg"].iloc[0]), int(probes["part"].iloc[0])
        lower = cuts[seg][1] - upper[seg]
        index = index.sort_values("value")
        value, code, first = (index[c].to_numpy() for c in ("value", "code", "first"))
        best = none
        for left, own in probes.groupby("left")["qcode"]:
            mask = np.array([sum(1 << i for i in c) for c in combinations(range(lower), int(left))], np.int64)
            own = own.to_numpy()
            step = max(1, (1 << 18) // len(mask))
            for a in range(0, len(own), step):
                q = own[a:a + step]
                base = (_cut(q, cuts[seg]).view(np.int64) & ((1 << lower) - 1)) | (part << lower)
                want = (base[:, None] ^ mask[None, :]).ravel()
                lo, hi = np.searchsorted(value, want), np.searchsorted(value, want, side="right")
                hit = np.flatnonzero(hi > lo)
                n = (hi - lo)[hit]
                edge = np.r_[0, np.cumsum(n)]
                x = 0
                while x < len(hit):  # at most about a million comparisons at a time
                    y = max(x + 1, int(np.searchsorted(edge, edge[x] + (1 << 20), side="right")) - 1)
                    at = np.repeat(lo[hit[x:y]] - edge[x:y], n[x:y]) + np.arange(edge[x], edge[y])
                    qq = np.repeat(q[hit[x:y] // len(mask)], n[x:y])
                    far = np.bitwise_count((code[at] ^ qq).view(np.uint64)).astype(np.int64)
                    found = pd.DataFrame({"qcode": qq, "code": code[at], "first": first[at], "dist": far})
                    best = _nearest(pd.concat([best, found]), keep)
                    x = y
        return best

    return run


def _nearest(found: pd.DataFrame, keep: int) -> pd.DataFrame:
    found = found.drop_duplicates(["qcode", "code"]).sort_values(["qcode", "dist", "first"])
    return found[found.groupby("qcode").cumcount() < keep]


def search(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """For each row of ``queries`` (id, code) the ``k`` nearest other rows of ``codes`` (id, code) by Hamming distance, ties
    by id: ``query_id, rank`` (from 1), ``neighbor_id, distance``.

    A row is no neighbour of its own id.  Repeated rows count once; rows with nulls are left out; a query with fewer than k
    other rows gets all of them; an empty table on either side gives an empty result."""
    keep = k + 1  # one more, since a query may meet itself
    rows = written(codes.filter("id is not null and code is not null").select("id", "code").distinct(), "codes")
    asked = written(queries.filter("id is not null and code is not null").select("id", "code").distinct(), "asked")
    by_id = Window.partitionBy("code").orderBy("id")
    lowest = (rows.withColumn("_n", F.row_number().over(by_id)).filter(F.col("_n") <= keep)
              .groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")))  # at most keep ids of a code
    entries = written(lowest.withColumn("first", F.col("ids")[0]), "entries")
    n = entries.count()
    cuts = segments(n)
    upper = part_bits(cuts, n)
    index = written(_index(entries, cuts, upper), "index")
    active = written(asked.select(F.col("code").alias("qcode")).distinct(), "active")
    best = None
    schema = "qcode long, code long, first long, dist long"
    by_distance = Window.partitionBy("qcode").orderBy("dist", "first")
    reach = Window.partitionBy("qcode").orderBy("dist").rangeBetween(Window.unboundedPreceding, 0)
    for radius in range(max(b for _, b in cuts) + 1):
        found = (_probes(active, cuts, upper, radius).groupBy("seg", "part").cogroup(index.groupBy("seg", "part"))
                 .applyInPandas(_verify(keep, cuts, upper), schema))
        found = found if best is None else found.unionByName(best)
        best = written(found.dropDuplicates(["qcode", "code"]).withColumn("_n", F.row_number().over(by_distance))
                       .filter(F.col("_n") <= keep).drop("_n"), "best")
        covered = len(cuts) * (radius + 1) - 1
        full = (best.join(entries.select("code", F.size("ids").alias("n")), "code")
                .withColumn("met", F.sum("n").over(reach)).filter((F.col("met") >= keep) & (F.col("dist") <= covered))
                .select("qcode").distinct())
        active = written(active.join(full, "qcode", "left_anti"), "active")
        if covered >= BITS or active.isEmpty():
            break
    order = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    top = Window.partitionBy("qcode").orderBy("dist", "id")
    near = (best.join(entries.select("code", "ids"), "code").select("qcode", "dist", F.explode("ids").alias("id"))
            .withColumn("_n", F.row_number().over(top)).filter(F.col("_n") <= keep).drop("_n"))
    return (asked.select(F.col("id").alias("query_id"), F.col("code").alias("qcode")).join(near, "qcode")
            .filter("query_id <> id")
            .select("query_id", F.col("id").alias("neighbor_id"), F.col("dist").alias("distance"))
            .withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
            .select("query_id", "rank", "neighbor_id", "distance"))
