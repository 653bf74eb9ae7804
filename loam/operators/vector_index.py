"""An inverted-file index over vectors: approximate top-k by joins.

Cells are the clusters of a bounded sample; every row of the corpus is in the index, in the
cell of its closest centre. A query looks into its ``probes`` closest cells. Rows of a cell are
dealt into blocks and the queries that look into it into blocks of queries, so a cell that
holds a third of all rows, or is asked by a third of all queries, is many groups; each group is
a few matrix products and returns its own k closest rows a query.

Rows without a vector, or of another dimension than the centres, are not found; queries
without one find nothing. Ties: the smaller id. ``exact_top_k`` of ``retrieval`` is the exact way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loam.sources.tables import written

#: Rows of the sample that cells are fitted on; cells at most; rows and queries of one group.
SAMPLE, MOST_CELLS, ROW_BLOCK, QUERY_BLOCK = 100_000, 4096, 1 << 16, 1024


@dataclass(frozen=True)
class VectorIndex:
    """``rows``: cell, block, the id and ``embedding`` as doubles, written in folders by cell;
    ``sizes``: cell, n, blocks; ``centres``: one row a cell, MOST_CELLS at most."""

    rows: DataFrame
    sizes: DataFrame
    centres: np.ndarray
    kind: str
    id_col: str


def _distances(queries: np.ndarray, x: np.ndarray, kind: str) -> np.ndarray:
    dot = queries @ x.T
    if "dot" in kind:
        return -dot
    norms = np.linalg.norm(queries, axis=1), np.linalg.norm(x, axis=1)
    if "cos" in kind:
        return 1 - dot / np.maximum(np.outer(*norms), 1e-300)
    return np.sqrt(np.maximum(norms[0][:, None] ** 2 + norms[1][None] ** 2 - 2 * dot, 0))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def fitted_centres(corpus: DataFrame, cells: int, id_col: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, iterations: int = 8) -> np.ndarray:
    """Centres of ``cells`` clusters of the ``sample`` rows whose ids hash lowest."""
    usable = corpus.where(F.size(vector) > 0).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    held = written(usable.orderBy(F.xxhash64("id")).limit(sample).select(F.size("v").alias("d"), array_to_vector("v").alias("features")), "index-sample")
    common = held.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return np.zeros((0, 0))
    model = KMeans(k=cells, maxIter=iterations, seed=7, initMode="random").fit(held.where(F.col("d") == common.d))
    return np.array(model.clusterCenters(), np.float64)


def build(corpus: DataFrame, cells: int | None = None, kind: str = "dot_product", id_col: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> VectorIndex:
    """An index over all rows; by default as many cells as the square root of their number."""
    if cells is None:
        cells = int(min(MOST_CELLS, max(2, round(corpus.count() ** 0.5))))
    centres = fitted_centres(corpus, cells, id_col, vector, sample)
    dims = centres.shape[1]
    src = corpus.where(F.size(vector) == dims).select(F.col(id_col), F.col(vector).cast("array<double>").alias("embedding"))
    id_type = corpus.schema[id_col].dataType.simpleString()
    fields = f"cell int, {id_col} {id_type}, embedding array<double>"
    schema = to_arrow_schema(StructType.fromDDL(fields))
    shipped = corpus.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                cell = _distances(_matrix(part.column(1), dims), shipped.value, "euclidean").argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), part.column(0), part.column(1)], schema=schema)

    placed = written(src.mapInArrow(place, fields) if dims else corpus.sparkSession.createDataFrame([], fields), "index-cells")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / ROW_BLOCK).cast("int"))
    dealt = placed.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64(id_col), F.col("blocks")).cast("int"))
    rows = written(dealt.select("cell", "block", id_col, "embedding").repartition("cell", "block"), "index-rows")
    return VectorIndex(rows, written(sizes, "index-sizes"), centres, kind, id_col)


def probed(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """query_id, embedding, cell and place, a row for each of a query's closest cells."""
    dims = index.centres.shape[1]
    q_type = queries.schema["query_id"].dataType.simpleString()
    fields = f"query_id {q_type}, embedding array<double>, cell int, place int"
    schema = to_arrow_schema(StructType.fromDDL(fields))
    shipped = queries.sparkSession.sparkContext.broadcast(index.centres)
    n, kind = min(probes, len(index.centres)), index.kind

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                near = np.argsort(_distances(_matrix(part.column(1), dims), shipped.value, kind), axis=1, kind="stable")[:, :n]
                at = pa.array(np.repeat(np.arange(part.num_rows), n))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(near.ravel(), pa.int32()), pa.array(np.tile(np.arange(1, n + 1), part.num_rows), pa.int32())], schema=schema)

    usable = queries.where(F.size("embedding") == dims).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return usable.mapInArrow(choose, fields) if n else queries.sparkSession.createDataFrame([], fields)


def probes_needed(index: VectorIndex, queries: DataFrame, exact: DataFrame, target: float = 0.95) -> int:
    """How many probes find ``target`` of the exact rows of some queries, a bounded sample: the
    quantile of the places that the rows' cells take among each query's cells."""
    cells = probed(index, queries, len(index.centres)).select("query_id", "cell", "place")
    of_rows = exact.select("query_id", index.id_col).join(index.rows.select(index.id_col, "cell"), index.id_col)
    got = of_rows.join(cells, ["query_id", "cell"]).agg(F.expr(f"percentile_disc({target}) WITHIN GROUP (ORDER BY place)").alias("p")).first()
    return int(got.p or 1)


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """query_id, the row's id, raw_score, rank, as ``retrieval.top_k`` gives them."""
    asked = written(probed(index, queries, probes), "index-asked")
    per_cell = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("groups"))
    # a query block meets each row block of its cell, a row block each query block
    of_queries = asked.join(per_cell, "cell").join(index.sizes, "cell")
    of_queries = of_queries.withColumn("qblock", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int"))
    left = of_queries.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "qblock", "query_id", "embedding")
    right = index.rows.join(per_cell, "cell").select("cell", "block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("qblock"), index.id_col, "embedding")
    q_type, id_type = queries.schema["query_id"].dataType.simpleString(), index.rows.schema[index.id_col].dataType.simpleString()
    fields = f"query_id {q_type}, {index.id_col} {id_type}, raw_score double"
    schema = to_arrow_schema(StructType.fromDDL(fields))
    dims, kind, name = index.centres.shape[1], index.kind, index.id_col

    def closest(asking: pa.Table, rows: pa.Table) -> pa.Table:
        if not asking.num_rows or not rows.num_rows:
            return schema.empty_table()
        ids = rows.column(name).combine_chunks()
        order = pc.sort_indices(ids)  # equal distances go by id
        ids, x = ids.take(order), _matrix(rows.column("embedding").combine_chunks().take(order), dims)
        q = _matrix(asking.column("embedding").combine_chunks(), dims)
        out = []
        for a in range(0, len(q), 64):
            d = _distances(q[a : a + 64], x, kind)
            if d.shape[1] > 4 * k:  # all that are as close as the k-th
                cut = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                at, row = np.nonzero(d <= cut)
            else:
                at, row = np.nonzero(np.isfinite(d))
            score = d[at, row]
            best = np.lexsort((row, score, at))
            at, row, score = at[best], row[best], score[best]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            keep = place < k
            out.append((at[keep] + a, row[keep], score[keep]))
        at, row, score = (np.concatenate([o[j] for o in out]) for j in range(3))
        return pa.Table.from_arrays([asking.column("query_id").combine_chunks().take(pa.array(at)), ids.take(pa.array(row)), pa.array(score)], schema=schema)

    keys = ["cell", "block", "qblock"]
    found = left.groupBy(*keys).cogroup(right.select(*(F.col(c).alias(f"_{c}") for c in keys), name, "embedding").groupBy(*(f"_{c}" for c in keys))).applyInArrow(closest, fields)
    w = Window.partitionBy("query_id").orderBy("raw_score", name)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """queries, expected, found, recall: the share of the exact rows that were found."""
    hit = exact.select("query_id", id_col).join(found.select("query_id", id_col, F.lit(1).alias("hit")), ["query_id", id_col], "left")
    out = hit.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("expected"), F.count("hit").alias("found"))
    return out.withColumn("recall", F.col("found") / F.col("expected"))
