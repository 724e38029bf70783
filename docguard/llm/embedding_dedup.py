"""Near-duplicate vectors: spherical k-means cells, and blocked cosine products within cells."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docguard.llm.common import Handoff, small
from docguard.llm.components import connected_components, roots


@dataclass(frozen=True)
class Settings:
    """Threshold, size of the sample that k-means is fitted on, vectors of a label per cell aimed at, rows of a block, and from
    how many blocks on a cell is cut into rings."""
    least_cosine: float = 0.98
    sample_rows: int = 20_000
    cell_rows: int = 4_096
    most_cells: int = 4_096
    block_rows: int = 4_096
    ringed_blocks: int = 4
    rounds: int = 8
    seed: int = 3


#: More than the blocks of any ring, so that a ring and a part are one number.
BLOCKS = 1 << 32


def usable(vector: str) -> str:
    """SQL: not null, not empty, all components finite, not all zero."""
    return (f"{vector} IS NOT NULL AND size({vector}) > 0 AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) "
            f"AND exists({vector}, x -> x <> 0)")


def fit_cells(rows: DataFrame, n_rows: int, settings: Settings) -> np.ndarray:
    """Unit centroids of spherical k-means on the `sample_rows` vectors with the smallest hashes.

    Only where the cells lie depends on the sample: every vector is assigned, and the comparison is exact for any cells.
    """
    sample = rows.orderBy(F.expr(f"xxhash64({settings.seed}, node)"), "node").limit(settings.sample_rows).select("vector").collect()
    x = np.array([r["vector"] for r in sample], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    k = int(min(settings.most_cells, max(1, -(-n_rows // settings.cell_rows)), max(1, len(x) // 8)))
    rng = np.random.default_rng(settings.seed)
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(settings.rounds):
        cell = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, cell, x)
        size = np.linalg.norm(sums, axis=1)
        empty = size < 1e-9
        sums[empty], size[empty] = x[rng.integers(0, len(x), int(empty.sum()))], 1.0
        centers = sums / size[:, None]
    return centers


def assigned(rows: DataFrame, centers: np.ndarray, settings: Settings) -> DataFrame:
    """(group, node, weight, vector, cell, ring, home, visits): each vector in its home cell, and as a guest in cells near it.

    Two unit vectors with the least cosine are at most `reach` apart. If x is at home in cell p and y in q, the plane
    between the two centers lies between x and y, so one of them is at most half of `reach` from it: that one is a
    guest in the other's cell. So each such pair meets, once or twice, and pairs at home in one cell meet there.
    A ring counts the angle to the cell's center in steps of the greatest angle of a link, so links cross one ring at most.
    """
    shared = rows.sparkSession.sparkContext.broadcast(centers)
    reach = math.sqrt(2 - 2 * settings.least_cosine) / 2 + 1e-9
    step = math.acos(max(-1.0, settings.least_cosine)) + 1e-6

    def run(batches):
        import pyarrow as pa

        c = shared.value
        apart = np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))
        for batch in batches:
            if not batch.num_rows:
                continue
            width = len(c[0])
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = flat.reshape(batch.num_rows, width)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            for at in range(0, len(x), 4096):
                part = x[at:at + 4096]
                near = part @ c.T
                home = near.argmax(axis=1)
                best = near[np.arange(len(part)), home]
                row, cell = np.nonzero(best[:, None] - near <= reach * apart[home] + 1e-9)
                take = pa.array(row + at)
                counts = np.bincount(row, minlength=len(part))
                ends = np.cumsum(counts)
                own = np.repeat(ends[row] - counts[row] - np.concatenate([[0], np.cumsum(counts[row])[:-1]]), counts[row]) + np.arange(counts[row].sum())
                visits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts[row])]).astype(np.int32)), pa.array(cell[own].astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(take) for i in range(3)),
                     pa.FixedSizeListArray.from_arrays(pa.array(part[row].reshape(-1)), width).cast(pa.list_(pa.float64())),
                     pa.array(cell.astype(np.int32)), pa.array((np.arccos(np.clip(near[row, cell], -1, 1)) / step).astype(np.int32)),
                     pa.array(home[row].astype(np.int32)), visits],
                    ["group", "node", "weight", "vector", "cell", "ring", "home", "visits"])

    return rows.select("group", "node", "weight", "vector").mapInArrow(
        run, "group string, node long, weight long, vector array<double>, cell int, ring int, home int, visits array<int>")


def compared(members: DataFrame, settings: Settings) -> DataFrame:
    """(node, links, root) from the products of each block pair of a cell: links found, and a node of the same component.

    A cell of up to `block_rows` vectors is one block, to which each of its vectors goes once. Larger ones are dealt into
    blocks by a hash, and each pair of blocks is a task of its own; those beyond `ringed_blocks` blocks first into rings, of which
    only neighbours meet. A block pair yields a row per node that has a link, not a row per pair. Pairs of two guests are left
    to their own cells.
    """
    rings = members.groupBy("group", "cell", "ring").agg(F.count(F.lit(1)).alias("n"))
    cells = rings.groupBy("group", "cell").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("ring", "n"))).alias("of")).selectExpr(
        "group", "cell", f"n > {settings.ringed_blocks * settings.block_rows} AS ringed", "n", "of").selectExpr(
        "group", "cell", "ringed", f"transform_values(if(ringed, of, map(0, n)), (r, k) -> int(ceil(k / {settings.block_rows}D))) AS parts_of")
    dealt = members.join(small(cells), ["group", "cell"]).withColumn("ring", F.expr("if(ringed, ring, 0)")).selectExpr(
        "*", f"int(pmod(xxhash64({settings.seed}, node), parts_of[ring])) AS part").selectExpr("*", f"{BLOCKS}L * ring + part AS block")

    def others(ring: str) -> str:  # the blocks of a ring, if it has any
        return f"transform(filter(sequence(0, coalesce(try_element_at(parts_of, {ring}), 0)), o -> o < try_element_at(parts_of, {ring})), o -> {BLOCKS}L * ({ring}) + o)"

    paired = dealt.selectExpr(
        "*", f"explode(transform(concat({others('ring')}, {others('ring - 1')}, {others('ring + 1')}), o -> named_struct('low', least(block, o), 'high', greatest(block, o)))) AS pair").selectExpr(
        "group", "cell", "pair.low AS low", "pair.high AS high", "block", "node", "weight", "vector", "home", "visits")
    least = settings.least_cosine

    def products(table):
        import pyarrow as pa

        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        node, weight = table.column("node").to_numpy(), table.column("weight").to_numpy()
        block, home = table.column("block").to_numpy(), table.column("home").to_numpy()
        here = home == table.column("cell")[0].as_py()
        x = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)
        # whether a row visits the home of another
        homes, at_home = np.unique(home, return_inverse=True)
        visits = table.column("visits").combine_chunks()
        visitor = np.repeat(np.arange(len(node)), np.diff(visits.offsets.to_numpy()))
        visited = visits.flatten().to_numpy()
        known = np.isin(visited, homes)
        visiting = np.zeros((len(node), len(homes)), bool)
        visiting[visitor[known], np.searchsorted(homes, visited[known])] = True
        first = np.flatnonzero(block == low)
        second = first if low == high else np.flatnonzero(block == high)
        links, a, b = np.zeros(len(node), np.int64), [], []
        for at in range(0, len(first), 512):
            rows = first[at:at + 512]
            near = (x[rows] @ x[second].T >= least) & (here[rows][:, None] | here[second][None, :])
            near &= node[rows][:, None] != node[second][None, :]
            # a guest counts a pair here only if the other does not visit the guest's home, where the pair meets again
            links[rows] += (near & (here[rows][:, None] | ~visiting[second][:, at_home[rows]].T)) @ weight[second]
            if low != high:
                links[second] += (near & (here[second][None, :] | ~visiting[rows][:, at_home[second]])).T @ weight[rows]
            i, j = np.nonzero(near)
            own = np.arange(len(node))
            if len(i):
                own = roots(len(node), rows[i], second[j])
                keep = np.flatnonzero(own != np.arange(len(node)))
                a.append(keep)
                b.append(own[keep])
        parent = roots(len(node), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(node))
        out = np.flatnonzero((links > 0) | (parent != np.arange(len(node))))
        return pa.table({"node": node[out], "links": links[out], "root": node[parent[out]]})

    return paired.groupBy("group", "cell", "low", "high").applyInArrow(products, "node long, links long, root long")


def near_duplicate_vectors(rows: DataFrame, settings: Settings = Settings(), id_column: str = "vec_id",
                           vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors are compared if their labels are equal and not null, by cosine in double precision. Vectors that are null,
    empty, zero, or hold a null or a number that is not finite, link with nothing; vectors of different lengths
    are not compared. Equal vectors under a label are one node with a weight and link all to each other. Rows that share an
    id are rows of their own with links to each other if they are near. An empty table gives no rows.
    """
    spark = rows.sparkSession
    hand = Handoff(spark, "vectors")
    plain = rows.selectExpr(f"bigint(`{id_column}`) AS id", f"CAST(`{vector}` AS array<double>) AS vector", f"string(`{label}`) AS group").selectExpr(
        "*", f"coalesce({usable('vector')} AND group IS NOT NULL, false) AS ok")
    width = plain.filter("ok").agg(F.max(F.size("vector"))).first()[0]
    alone = plain.selectExpr(f"id AS `{id_column}`", "0L AS n_links", "id AS component_id", "true AS kept")
    if width is None:
        return alone
    padded = f"if(ok, concat(vector, array_repeat(0D, {width} - size(vector))), NULL) AS vector"
    keyed = hand.write(plain.selectExpr("id", "concat(group, ':', size(vector)) AS group", "ok", padded).selectExpr(
        "*", "if(ok, xxhash64(group, vector), NULL) AS print_a", "if(ok, xxhash64(1, vector, group), NULL) AS print_b"), "keyed")
    # equal vectors are told by 128 bits, so that no vector moves for it but the one that is kept
    same = ["group", "print_a", "print_b"]
    distinct = keyed.filter("ok").groupBy(*same).agg(F.first("vector").alias("vector"), F.min("id").alias("node"), F.count(F.lit(1)).alias("weight"))
    # two nodes may not share a number, which rows with one id could give them
    nodes = hand.write(distinct.selectExpr(*same, "vector", "node AS least_id", "weight", "monotonically_increasing_id() AS node"), "nodes")
    largest = nodes.groupBy("group").count().agg(F.max("count")).first()[0]
    centers = fit_cells(nodes, largest, settings)
    members = hand.write(assigned(nodes, centers, settings), "members")
    found = hand.write(compared(members, settings), "found")
    hand.drop("members")
    groups = connected_components(found.selectExpr("node AS a", "root AS b"), hand, "components")
    joined = nodes.drop("vector").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(groups, "node", "left").selectExpr(
        *same, "node", "least_id", "weight", "coalesce(links, 0L) AS links", "coalesce(component, node) AS component")
    joined = hand.write(joined, "joined")
    hand.drop("nodes", "found", "components")
    least = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_node = joined.join(small(least), "component").selectExpr(*same, "links + weight - 1 AS n_links", "component_id")
    linked = keyed.filter("ok").select("id", *same).join(by_node, same)
    rest = keyed.filter("NOT ok").selectExpr("id", "0L AS n_links", "id AS component_id")
    return linked.select("id", "n_links", "component_id").unionByName(rest).selectExpr(
        f"id AS `{id_column}`", "n_links", "component_id", "coalesce(id = component_id, true) AS kept")
