"""Search over a stored index: one entry for vectors, words, both fused, reranked, and for selected documents.

The index is three Parquet tables: chunks, unit vectors, and postings of stems (dealt to folders by
the stem's hash, so a set of queries reads the folders of its stems only).  What filters and ties
need stands in each, so nothing is joined to rank.  Queries come as a table and are taken in blocks
of ``BLOCK``; a block is parsed on the driver and sent to the tasks.  Vectors are scored by matrix
products, and a task gives only what can be among the best of each query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as P

from foliary.functions import english, vectors
from foliary.operators import retrieval as R

BLOCK = 10_000
#: folders of postings: one for so many characters of text, so many at least
BUCKET_CHARACTERS, BUCKETS = 1 << 28, 64
OWN = ("chunk_id", "document_id", "sequence_number")
FILTERED = ("content_type", "contains_ocr", "start_page", "end_page")
MODES = ("semantic", "keyword", "hybrid")
# Fixed value: what one least stretch with all terms and nothing between them scores.
WEIGHT = 0.1


def _posted(shown: int, names: list[str]):
    """Stems of each text (behind the shown columns), one row each, with their places; few texts at a time, as arrays."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, R.TEXTS):
                batch = whole.slice(i, R.TEXTS)
                row, term, ends, places = [], [], [0], []
                for n, text in enumerate(batch.column(shown).to_pylist()):
                    at: dict[str, list[int]] = {}
                    for stem, place in english.lexemes(text or ""):
                        at.setdefault(stem, []).append(place)
                    row += [n] * len(at)
                    term += at
                    for held in at.values():
                        places += held
                        ends.append(len(places))
                own = batch.select(list(range(shown))).take(pa.array(row, pa.int64()))
                positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(term, pa.string()), positions], names)

    return task


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def _write(index: Index, chunks: DataFrame, batch: int) -> None:
    """The three tables' rows of chunks, below ``batch=N``; what a failed attempt has left there is replaced."""
    shown = [*OWN, *(c for c in FILTERED if c in chunks.columns)]
    out = lambda df: df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    text = F.concat_ws(" ", F.coalesce("text", F.lit("")), *([F.col("section_heading")] if "section_heading" in chunks.columns else []))
    kind = P.StructType([*(chunks.schema[c] for c in shown), P.StructField("term", P.StringType()), P.StructField("positions", P.ArrayType(P.IntegerType()))])
    found = chunks.select(*shown, text.alias("__text")).mapInArrow(_posted(len(shown), kind.names), kind)
    out(found.withColumn("bucket", _bucket(F.col("term"), index.buckets)).repartition("bucket").sortWithinPartitions("bucket", "term")).partitionBy("batch", "bucket").parquet(f"{index.path}/postings")
    if "embedding" in chunks.columns:
        v = F.col("embedding").cast("array<double>")
        size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        unit = chunks.select(*shown, v.alias("v"), size.alias("size")).where("size > 0").select(*shown, F.transform("v", lambda x: x / F.col("size")).alias("unit"))
        out(unit).partitionBy("batch").parquet(f"{index.path}/vectors")
    out(chunks).partitionBy("batch").parquet(f"{index.path}/chunks")


def build(chunks: DataFrame, path: str) -> Index:
    """Writes the index of chunks (chunk_id, document_id, sequence_number, text; where there are: section_heading, embedding, and what filters ask for)."""
    characters = chunks.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    index = Index(chunks.sparkSession, path, max(BUCKETS, -(-characters // BUCKET_CHARACTERS)))
    index.spark.createDataFrame([(index.buckets,)], "buckets int").coalesce(1).write.mode("overwrite").json(f"{path}/settings")
    _write(index, chunks, 0)
    return index


def opened(spark: SparkSession, path: str) -> Index:
    """An index that was built before."""
    return Index(spark, path, spark.read.schema("buckets int").json(f"{path}/settings").first().buckets)


def remainder(index: Index, chunks: DataFrame, batch: int | None = None) -> DataFrame:
    """Chunks of documents that the index doesn't hold (from batches other than ``batch``)."""
    held = index.table("chunks")
    held = held if batch is None else held.where(F.col("batch") != batch)
    return chunks.join(held.select("document_id").distinct(), "document_id", "left_anti")


def extend(index: Index, chunks: DataFrame, batch: int) -> Index:
    """Adds the chunks of documents that aren't indexed yet, as batch ``batch`` (from 1 on).

    Nothing that is stored is read anew but the ids of its documents.  A batch that is run again, after
    a failure or by chance, replaces its own folders and gives the same index.
    """
    if batch < 1:
        raise R.SearchError("batches are numbered from 1")
    _write(index, remainder(index, chunks, batch), batch)
    return index


def _blocks(queries: DataFrame) -> Iterator[list]:
    block = []
    for row in queries.toLocalIterator():
        block.append(row)
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


def _each(queries: DataFrame, search: Callable[[list], DataFrame]) -> DataFrame:
    out = None
    for block in _blocks(queries):
        found = search(block)
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise R.SearchError("there are no queries")
    return out


def semantic(index: Index, queries: DataFrame, k: int, floor: float | None = None, filters: R.Filters | None = None) -> DataFrame:
    """queries: query_id, vector.  The ``k`` nearest by cosine of each, exactly."""
    return _each(queries.select("query_id", "vector"), lambda block: _semantic(index, queries.schema["query_id"].dataType, block, k, floor, filters))


def _semantic(index: Index, kind: P.DataType, block: list, k: int | None, floor: float | None, filters: R.Filters | None) -> DataFrame:
    body = (filters or R.Filters()).apply(index.table("vectors"))
    found = vectors.nearest(body, "unit", OWN, [(r["query_id"], r["vector"]) for r in block], kind, k, floor, unit=True)
    return R.ranked(found, "semantic_score", k)


@F.pandas_udf(P.DoubleType())
def density(items: pd.Series) -> pd.Series:
    """How near an item's places stand to the others': over all least stretches that hold every item, the weight over 1 plus the other words inside.

    items: for each item, arrays of the places of its words.
    """

    def score(found) -> float:
        marks = sorted((int(p), t) for t, places in enumerate(found) for at in places for p in at)
        last: dict[int, int] = {}
        total, begun = 0.0, -1
        place = sorted({p for p, _ in marks})
        for p, t in marks:
            last[t] = p
            first = min(last.values()) if len(last) == len(found) else -1
            if first > begun:
                begun = first
                inside = np.searchsorted(place, p, "right") - np.searchsorted(place, first, "left")
                total += WEIGHT / (1 + (p - first) - (int(inside) - 1))
        return total

    return items.map(score)


def keyword(index: Index, queries: DataFrame, k: int, filters: R.Filters | None = None) -> DataFrame:
    """queries: query_id, query (see ``english.parse``).  Chunks that meet one of a query's groups, by how near its words stand.

    A group of exclusions only meets nothing.
    """
    return _each(queries.select("query_id", "query"), lambda block: _keyword(index, queries.schema["query_id"].dataType, block, k, filters))


def _keyword(index: Index, kind: P.DataType, block: list, k: int | None, filters: R.Filters | None) -> DataFrame:
    rows = [(r["query_id"], g, i, out, n, len(terms), term) for r in block for g, group in enumerate(english.parse(r["query"] or "")) for i, (out, terms) in enumerate(group) for n, term in enumerate(terms)]
    needed = {}
    for q, g, i, out, *_ in rows:
        if not out:
            needed.setdefault((q, g), set()).add(i)
    rows = [(*r, len(needed.get((r[0], r[1]), ()))) for r in rows]
    schema = P.StructType([P.StructField("query_id", kind), *(P.StructField(c, P.BooleanType() if c == "excluded" else P.StringType() if c == "term" else P.IntegerType()) for c in ("g", "i", "excluded", "n", "words", "term", "needed"))])
    asked = index.spark.createDataFrame(rows, schema).where("needed > 0")
    terms = sorted({r[6] for r in rows})
    buckets = [r[0] for r in index.spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t"), index.buckets).alias("b")).distinct().collect()] if terms else []  # at most one a folder
    postings = (filters or R.Filters()).apply(index.table("postings").where(F.col("bucket").isin(buckets) & F.col("term").isin(terms) if len(terms) <= 1000 else F.col("bucket").isin(buckets)))
    met = postings.join(F.broadcast(asked), "term")
    key = ["query_id", "g", "i", "excluded", "needed", *OWN]
    single = met.where("words = 1").select(*key, F.transform("positions", lambda p: F.array(p)).alias("places"))
    hits = single
    if any(r[5] > 1 for r in rows):
        at = met.where("words > 1").select(*key, "words", "n", F.explode("positions").alias("p")).withColumn("begin", F.col("p") - F.col("n"))
        whole = at.groupBy(*key, "words", "begin").agg(F.countDistinct("n").alias("met")).where("met = words")
        hits = single.unionByName(whole.groupBy(*key).agg(F.collect_list(F.sequence(F.col("begin"), F.col("begin") + F.col("words") - 1)).alias("places")))
    group = hits.groupBy("query_id", "g", "needed", *OWN).agg(F.count_if(~F.col("excluded")).alias("met"), F.count_if("excluded").alias("out"), F.collect_list(F.when(~F.col("excluded"), F.col("places"))).alias("items"))
    scored = group.where("met = needed and out = 0").select("query_id", *OWN, density("items").alias("part"))
    return R.ranked(scored.groupBy("query_id", *OWN).agg(F.sum("part").alias("keyword_score")), "keyword_score", k)


def search(index: Index, queries: DataFrame, mode: str = "semantic", k: int = R.TOP_K, filters: R.Filters | None = None, floor: float | None = None, rerank: bool = False, scorer: Callable[[Column, Column, Column], Column] = R.lexical_scorer, selected: list | None = None, documents: DataFrame | None = None) -> DataFrame:
    """Results (query_id, rank, chunk and scores) of queries: query_id, query, and for vectors vector.

    selected: ids of documents that all are searched, each with a quota; they have to be ready and
    indexed in ``documents`` (document_id, status, is_indexed, chunk_count).
    """
    R.check_k(k)
    if mode not in MODES:
        raise R.SearchError(f"the mode is one of {', '.join(MODES)}")
    if "query" in queries.columns and not queries.where("query is null or trim(query) = ''").isEmpty():
        raise R.SearchError("a query is blank")
    if selected is not None:
        return _selected(index, queries, mode, k, filters, floor, rerank, scorer, selected, documents)
    found = _found(index, queries, mode, R.pool_size(k, mode, rerank) if rerank else k, filters, floor)
    return R.rerank(found, queries, index.table("chunks"), k, scorer) if rerank else found


def _found(index: Index, queries: DataFrame, mode: str, k: int | None, filters: R.Filters | None, floor: float | None) -> DataFrame:
    if mode == "semantic":
        return semantic(index, queries, k, floor, filters)
    if mode == "keyword":
        return keyword(index, queries, k, filters)
    pool = None if k is None else R.MULTIPLIER * k
    return R.fuse(semantic(index, queries, pool, floor, filters), keyword(index, queries, pool, filters), k, R.RRF_K, pool)


def _selected(index, queries, mode, k, filters, floor, rerank, scorer, selected, documents) -> DataFrame:
    ids = list(dict.fromkeys(selected))
    if not 0 < len(ids) <= R.MOST_DOCUMENTS:
        raise R.SearchError(f"1 to {R.MOST_DOCUMENTS} documents can be selected")
    if documents is not None:
        scope = index.spark.createDataFrame([(i,) for i in ids], P.StructType([documents.schema["document_id"]]))
        if not R.missing_documents(documents, scope).isEmpty():
            raise R.SearchError("every selected document must exist, be ready, and have indexed chunks")
    base = filters or R.Filters()
    own = R.Filters(ids, base.content_types, base.contains_ocr, base.start_page, base.end_page, base.more, base.documents)
    score = f"{mode}_score"
    ranked = _found(index, queries, mode, None, own, floor)
    if rerank:
        return R.rerank(R.selected_scope(ranked, score, R.MOST_CANDIDATES, True), queries, index.table("chunks"), k, scorer)
    return R.selected_scope(ranked, score, k)
