"""Operator 5: approximate nearest neighbours by NN-descent and greedy graph search.

*Index.* Equal vectors are one node. The graph starts from ``TREES`` random splits of the nodes into blocks of about ``BLOCK``, compared
in full; a block that stays large is dealt by hash, another one in each tree. Then NN-descent: a node's neighbours are also those
that have it as a neighbour; all neighbours of a node meet there (a Spark join sends each one's vector), are compared with each
other, and every node takes over what is nearer than its farthest neighbour. A node that is the neighbour of many is met in chunks
of ``CHUNK``, others in each round. Rounds go on until less than ``SETTLED`` of the entries of all lists change.

*Precision.* The graph holds single-precision vectors in units of a power of two, and distances are taken in double precision from
the middle of what is compared, so neither one very long vector nor a dense cluster far from the origin blurs the order.

*Search.* Greedy best-first: a query keeps its ``BEAM`` nearest nodes so far; each round opens the ``OPEN`` nearest ones not yet
opened, joins their neighbours in the graph with their vectors, and ends when none is left. Queries that are rows of the table
start at their own node, others at ``ENTRIES`` nodes with the smallest hashes. What is found is measured again in double
precision on the original vectors.

Defined results: vectors that are null, empty, all zero, hold a null or non-finite component, or are of another length than most take no part,
nor do rows without id; of rows with one id the smallest vector counts; ties go to the smaller id; an empty table gives an empty
result; with fewer than ``BLOCK`` nodes all are compared; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import BOOK, read
from almanac.storage import written

NEIGHBOURS = 20
TREES = 8
BLOCK = 1024
SETTLED = 0.02
CHUNK = 64
BEAM = 400
OPEN = 64
ENTRIES = 32
TASK_NODES = 2000
GRAPH = "node long, vec binary, nbrs array<long>, dists array<float>, farthest float"
UPDATES = "node long, nbrs array<long>, dists array<float>"


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part, as double precision."""
    v = F.col("v")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size(v).alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(1)
    rows = rows.join(F.broadcast(sizes), F.size(v) == F.col("size")).select("id", "v")  # one row
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def packed(v: Column, largest: float) -> Column:
    """The vector in units of a power of two near the ``largest`` component of all, as single-precision bytes, for building and
    walking the graph. Units are there for components that single precision cannot hold."""
    unit = 2.0 ** math.frexp(largest)[1]

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        return pd.Series([(np.asarray(x) / unit).astype(np.float32).tobytes() for x in vectors])

    return pack(v)


def matrix(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float32).reshape(len(blobs), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows, in double precision from the mean of ``b``."""
    middle = b.mean(axis=0, dtype=np.float64)
    a, b = a - middle, b - middle
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0)).astype(np.float32)


def nearest(owner: np.ndarray, nbr: np.ndarray, dist: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest distinct neighbours of every owner, nearest first, as lists."""
    other = owner != nbr
    owner, nbr, dist = owner[other], nbr[other], dist[other]
    order = np.lexsort((dist, nbr, owner))
    owner, nbr, dist = owner[order], nbr[order], dist[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (nbr[1:] != nbr[:-1])])[:len(owner)]
    owner, nbr, dist = owner[new], nbr[new], dist[new]
    order = np.lexsort((nbr, dist, owner))
    owner, nbr, dist = owner[order], nbr[order], dist[order]
    start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])[:len(owner)])
    ends = np.append(start[1:], len(owner))
    return pd.DataFrame({"node": owner[start], "nbrs": [nbr[a:min(b, a + k)] for a, b in zip(start, ends)],
                         "dists": [dist[a:min(b, a + k)].astype(np.float32) for a, b in zip(start, ends)]})


def flat(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners, neighbours and distances of rows of lists."""
    sizes = pdf["nbrs"].str.len().fillna(0).astype(int)
    rows = pdf[sizes > 0]
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return (np.repeat(rows["node"].to_numpy(), sizes[sizes > 0]), np.concatenate(rows["nbrs"].tolist()),
            np.concatenate(rows["dists"].tolist())) if len(rows) else none


def _dealt(df: DataFrame, tasks: int, *key: str):
    return df.groupBy(F.pmod(F.xxhash64(*key), F.lit(tasks)))


def _merged(points: DataFrame, updates: DataFrame, tasks: int, k: int) -> DataFrame:
    """The graph with the updates taken in; ``points`` has a row with the vector of every node, and its lists if there are any."""
    if "nbrs" not in points.columns:
        points = points.select("node", "vec", F.lit(None).cast("array<long>").alias("nbrs"), F.lit(None).cast("array<float>").alias("dists"))
    rows = points.select("node", "vec", "nbrs", "dists").unionByName(
        updates.select("node", F.lit(None).cast("binary").alias("vec"), "nbrs", "dists"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        best = nearest(*flat(pdf), k)
        best["farthest"] = [d[-1] if len(d) == k else np.inf for d in best["dists"]]
        out = pdf.loc[pdf["vec"].notna(), ["node", "vec"]].merge(best, on="node", how="left")
        out["farthest"] = out["farthest"].fillna(np.inf).astype(np.float32)
        return out

    return written(_dealt(rows, tasks, "node").applyInPandas(merge, GRAPH), "graph")


def _first_lists(points: DataFrame, n: int, tasks: int, k: int) -> DataFrame:
    """Lists of near nodes from full comparison inside random blocks of bounded size."""
    depth = max(0, math.ceil(math.log2(max(1, n) / BLOCK)))
    trees = TREES if depth else 1

    def codes(batches):
        for pdf in batches:
            x = matrix(pdf["vec"].tolist()) if len(pdf) else np.zeros((0, 1), np.float32)
            rng = np.random.default_rng(5)
            for tree in range(trees):
                planes = rng.standard_normal((x.shape[1], depth)).astype(np.float32)
                code = (x @ planes > 0) @ (1 << np.arange(depth, dtype=np.int64)) if depth else np.zeros(len(x), np.int64)
                yield pdf.assign(tree=tree, code=code.astype(np.int64))

    coded = points.select("node", "vec").mapInPandas(codes, "node long, vec binary, tree int, code long")
    coded = written(coded, "codes")
    # A block beyond twice the size aimed at is cut by hash, so every comparison has a bounded size.
    cuts = coded.groupBy("tree", "code").agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK)).alias("cuts"))
    blocks = coded.join(cuts, ["tree", "code"]).withColumn("cut", F.pmod(F.xxhash64("node", "tree"), F.col("cuts")))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for _, block in pdf.groupby(["tree", "code", "cut"], sort=False):
            ids, x = block["node"].to_numpy(), matrix(block["vec"].tolist())
            d = distances(x, x)
            np.fill_diagonal(d, np.inf)
            m = min(k, len(ids) - 1)
            if m > 0:
                at = np.argpartition(d, m - 1, axis=1)[:, :m]
                parts.append((np.repeat(ids, m), ids[at].ravel(), np.take_along_axis(d, at, axis=1).ravel()))
        return nearest(*map(np.concatenate, zip(*parts)), k) if parts else pd.DataFrame({"node": [], "nbrs": [], "dists": []})

    return _dealt(blocks, max(tasks, n * trees // (2 * BLOCK)), "tree", "code", "cut").applyInPandas(compare, UPDATES)


def links(graph: DataFrame) -> DataFrame:
    """(node, other) in both directions, once."""
    forth = graph.select("node", F.explode("nbrs").alias("other"))
    return forth.union(forth.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()


def _descend(graph: DataFrame, n: int, tasks: int, k: int, turn: int) -> DataFrame:
    """One round of NN-descent."""
    near = written(links(graph), "graph-links")
    parts = near.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts"))
    members = graph.select(F.col("node").alias("other"), "vec", "farthest")
    met = near.join(parts, "node").join(members, "other").withColumn("part", F.pmod(F.xxhash64("other", F.lit(turn)), F.col("parts")))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["node", "part"])
        place, part, ids, far = (pdf[c].to_numpy() for c in ("node", "part", "other", "farthest"))
        x = matrix(pdf["vec"].tolist())
        border = np.flatnonzero((place[1:] != place[:-1]) | (part[1:] != part[:-1])) + 1
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        for a, b in zip([0, *border], [*border, len(pdf)]):
            d = distances(x[a:b], x[a:b])
            i, j = np.nonzero(d < far[a:b, None])
            found.append((ids[a:b][i], ids[a:b][j], d[i, j]))
        return nearest(*map(np.concatenate, zip(*found)), k)

    updates = _dealt(met, max(tasks, n // TASK_NODES), "node", "part").applyInPandas(meet, UPDATES)
    return _merged(graph, updates, tasks, k)


def changed(before: DataFrame, after: DataFrame) -> float:
    """Share of the entries of all lists that were not there before."""
    old = before.select("node", F.col("nbrs").alias("old"))
    new = F.size(F.array_except("nbrs", F.coalesce("old", F.array().cast("array<long>"))))
    row = after.filter("nbrs is not null").join(old, "node").agg(F.sum(new).alias("new"), F.sum(F.size("nbrs")).alias("all")).first()
    return (row["new"] or 0) / (row["all"] or 1)


def build(points: DataFrame, k: int = NEIGHBOURS, settled: float = SETTLED) -> DataFrame:
    """The neighbour graph of the points (node, vec): (node, vec, nbrs, dists, farthest)."""
    n = points.count()
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // TASK_NODES)
    graph = _merged(points, _first_lists(points, n, tasks, k), tasks, k)
    turn, share = 0, 1.0 if n > BLOCK else 0.0
    while share >= settled:
        before, graph, turn = graph, _descend(graph, n, tasks, k, turn), turn + 1
        share = changed(before, graph)
    return graph


def search(graph: DataFrame, queries: DataFrame, beam: int = BEAM) -> DataFrame:
    """(query, node) of the ``beam`` nearest nodes found for the queries (query, vec, entries: nodes to start from)."""
    spark = graph.sparkSession
    near = written(links(graph), "graph-links")
    points = graph.select("node", F.col("vec").alias("its"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), queries.count() // 500)
    state = queries.select("query", "vec", F.lit(None).cast("array<long>").alias("found"), F.lit(None).cast("array<float>").alias("dists"),
                           F.lit(None).cast("array<boolean>").alias("opened"))
    wanted = queries.select("query", F.explode("entries").alias("node"))

    def advance(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for query, rows in pdf.groupby("query", sort=False):
            own = rows[rows["vec"].notna()].iloc[0]
            more = rows[rows["vec"].isna()]
            ids = np.asarray(own["found"] if own["found"] is not None else [], np.int64)
            dist = np.asarray(own["dists"] if own["dists"] is not None else [], np.float32)
            opened = np.asarray(own["opened"] if own["opened"] is not None else [], bool)
            more = more[~more["node"].isin(ids)]
            if len(more):
                d = distances(matrix([own["vec"]]), matrix(more["its"].tolist()))[0]
                ids, dist = np.concatenate([ids, more["node"].to_numpy(np.int64)]), np.concatenate([dist, d])
                opened = np.concatenate([opened, np.zeros(len(d), bool)])
            order = np.lexsort((ids, dist))[:beam]
            ids, dist, opened = ids[order], dist[order], opened[order]
            turn = np.flatnonzero(~opened)[:OPEN]
            opened[turn] = True
            out.append((query, own["vec"], ids, dist, opened, ids[turn]))
        return pd.DataFrame(out, columns=["query", "vec", "found", "dists", "opened", "turn"])

    while True:
        met = wanted.distinct().join(points, "node").select(
            "query", F.lit(None).cast("binary").alias("vec"), *[F.lit(None).cast(f"array<{t}>").alias(c) for c, t in (
                ("found", "long"), ("dists", "float"), ("opened", "boolean"))], "node", "its")
        rows = state.select("query", "vec", "found", "dists", "opened", F.lit(None).cast("long").alias("node"), F.lit(None).cast("binary").alias("its"))
        state = written(_dealt(rows.unionByName(met), tasks, "query").applyInPandas(
            advance, "query long, vec binary, found array<long>, dists array<float>, opened array<boolean>, turn array<long>"), "search")
        turn = state.select("query", F.explode("turn").alias("node"))
        if turn.isEmpty():
            return state.select("query", F.explode("found").alias("node"))
        wanted = turn.join(near, "node").select("query", F.col("other").alias("node"))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, x: total + x))


def nearest_rows(rows: DataFrame, is_query: Column, id_col: str, vector_col: str, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that ``is_query`` picks, its k nearest other rows found."""
    kept = written(usable(rows, id_col, vector_col), "vectors")
    nodes = written(kept.groupBy("v").agg(F.min("id").alias("node")), "distinct-vectors")
    members = written(kept.join(nodes, "v").select("id", "node"), "members")
    largest = nodes.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 1.0
    points = written(nodes.select("node", packed(F.col("v"), largest).alias("vec")), "points")
    graph = build(points)

    asked = rows.filter(is_query).select(F.col(id_col).cast("long").alias("id")).distinct().join(members, "id")
    asked = written(asked.select(F.col("id").alias("query_id"), F.col("node").alias("query")), "queries")
    starts = asked.select("query").distinct().join(points, F.col("query") == F.col("node")).select("query", "vec", F.array("query").alias("entries"))
    found = search(graph, starts, max(BEAM, 2 * k))

    first = Window.partitionBy("node").orderBy("id")
    # No result needs more than k + 1 rows of one vector: those with the smallest ids, one of which may be the query.
    heads = members.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1).select("id", "node")
    exact = nodes.withColumnRenamed("v", "its")
    own = nodes.select(F.col("node").alias("query"), F.col("v").alias("own"))
    scored = found.join(exact, "node").join(own, "query").select("query", "node", euclidean(F.col("own"), F.col("its")).alias("score"))
    order = Window.partitionBy("query").orderBy("score", "id")
    best = scored.join(heads, "node").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1)
    pairs = asked.join(best.select("query", "id", "score"), "query").filter(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return pairs.select("query_id", rank.alias("rank"), F.col("id").alias("vec_id"), "score").filter(F.col("rank") <= k)


@BOOK.add("op5_nearest_neighbours")
def op5_nearest_neighbours(spark, sf_dir):
    return nearest_rows(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, "vec_id", "embedding")
