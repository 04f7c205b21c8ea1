"""Near-duplicates by bottom-k sketches from one hash function.

A document's set is its distinct word shingles, as 64-bit hashes; its sketch the k least of them.

1. Equal sets become one node (grouped with map-side combination, so masses of copies are cheap).
2. Inverted lists: a pair at the wanted similarity keeps at least ``t`` = 0.55 k common values in
   both sketches (five standard deviations below what 0.8 leads to expect at k = 64).  A set so
   small that its partners' sketches are whole sets as well has t = 0.8 of its size, for certain.
   So it is enough to list, of each sketch, the values that occur in fewest nodes, t - 1 fewer than
   it has; a passage that many documents share then makes no list.
3. Canopies: each list's first member is compared with the others by union sketches (the share of
   common values among the k least of both).  Members near it gather in its canopy; those very near
   leave the list, and the rest goes on to a next round.  As distance is a metric, two similar
   members meet in a canopy before either leaves (the two bounds are 0.35 apart, similar members
   at most 0.2).  Lists that are left after the last round are canopies as they are.
4. Members of a canopy larger than a block are first compared with its centre, exactly.  Those that
   are similar to it are linked by that, so only the others are compared with all: of n copies with
   little changes that is n comparisons, not n squared.  What is to be compared is cut into pairs of
   blocks, which are tasks.  In a task pairs are filtered by size and sketch, and confirmed by exact
   Jaccard on full sets; pairs that are linked already by others need no test.  Only links that join
   something are returned, so a group of n copies gives about n rows.
5. Components of the links, each with its least id.

Joins on values, centres and canopies spread keys of very many rows over several tasks.

With ``exact`` a sketch is the whole set.  Then every step above is lossless: lists are prefixes of
whole sets, estimates are the Jaccard similarities themselves.  Without it that holds for sets of up
to 51 shingles, and for larger ones a pair can be missed by its estimate.

Defined results: null, empty and wordless texts have an empty set, are linked with nothing, and
their component is their own id; rows with a null id take part, and a component's id is the least
that is not null; repeated rows are linked; texts of any length are taken whole; an empty table
gives an empty one; ``near_duplicates`` returns its own columns only, ``keep_one`` all columns of
the table, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.llm import common as C
from foliary.llm.graph import components

SHINGLE = 5
THRESHOLD = 0.8
K = 64
SHARED = 0.55
TIGHT, LOOSE, PASS = 0.45, 0.1, 0.55
ROUNDS = 5
BLOCK = 384
SIEVE_BITS = 23
WHOLE = 1 << 30  # as k: sketches are whole sets


def shingle_sets(texts: list[bytes], scanner: C.WordScanner, n: int) -> Iterator[tuple[np.ndarray, bytes | None]]:
    """Per text, its sorted distinct shingle hashes, and what tells its set apart (128 bits; none: no words).

    The latter is made from hashes independent of the former, over whole words, so equal sets are
    those that agree in both.
    """
    raw, at = C.joined(texts)
    starts, ends, hashes = scanner.scan(raw)
    checks = scanner.check(raw, starts, ends)
    first = np.searchsorted(starts, at)
    grams, others = C.gram_hashes(hashes, n), C.gram_hashes(checks, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            distinct, place = np.unique(grams[a : b - n + 1], return_index=True)
            yield distinct, set_key(distinct, others[a + place])
        elif b > a:
            whole = C.gram_hashes(hashes[a:b], b - a)
            yield whole, set_key(whole, C.gram_hashes(checks[a:b], b - a))
        else:
            yield np.zeros(0, np.uint64), None


def set_key(grams: np.ndarray, others: np.ndarray) -> bytes:
    """128 bits that tell sets apart, whatever order they are in; both hashes of each shingle count."""
    with np.errstate(over="ignore"):
        one = C.mix64(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
        return np.array([one, C.mix64(C.mix64(others) ^ grams).sum(dtype=np.uint64)]).tobytes()


def _profile(n: int, k: int):
    @C.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = C.spaces_scanner()
        for batch in C.slices(batches):
            texts = C.texts_of(batch, "text")
            for a, b in C.sub_batches(texts):
                sets, keys = zip(*shingle_sets(texts[a:b], scanner, n), strict=True)
                own = [batch.column(0).slice(a, b - a), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s[:k].tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([*own, *(c.slice(a, b - a) for c in batch.columns[2:])], ["doc_id", "key", "n_shingles", "sketch", *batch.schema.names[2:]])

    return task


@C.tidy
def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.slices(batches):
        sketches = batch.column(1).to_pylist()
        sizes = np.fromiter((len(s) // 8 for s in sketches), np.int64, len(sketches))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(np.frombuffer(b"".join(sketches), np.int64)), pa.array(np.repeat(sizes, sizes).astype(np.int32))], ["node", "value", "held"])


def union_estimate(x: np.ndarray, y: np.ndarray, k: int) -> float:
    """Share of common values among the k least of both sketches together."""
    both = np.sort(np.concatenate([x, y]))
    twice = both[1:] == both[:-1]
    distinct = np.concatenate([[True], ~twice])
    place = np.cumsum(distinct)
    common = int((twice & (place[1:] <= k)).sum())
    return common / min(k, int(place[-1]))


def _estimates(k: int):
    @C.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            x, y = (batch.column(i).to_pylist() for i in (2, 3))
            got = [union_estimate(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), k) for a, b in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.float64())], ["pivot", "node", "near"])

    return task


class Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def block_links(nodes: list[int], sets: list[bytes], left: list[bool], right: list[bool], percent: int, k: int) -> list[tuple[int, int]]:
    """Links between a left and a right member that join what isn't joined yet."""
    full = [np.frombuffer(s, np.uint64) for s in sets]
    sizes = np.array([len(s) for s in full])
    n = len(nodes)
    forest, out = Forest(n), []
    if n == 2:
        return [(nodes[0], nodes[1])] if similar(full[0], full[1], percent) else []
    sketch = [s[:k] for s in full]
    held = np.array([len(s) for s in sketch])
    values, column = np.unique(np.concatenate(sketch), return_inverse=True)
    row = np.repeat(np.arange(n), held)
    often = np.bincount(column) > 1
    rank = np.cumsum(often) - 1
    common = np.zeros((n, n), np.float32)
    use = often[column]
    row, column, wide = row[use], rank[column[use]], int(often.sum())
    for a in range(0, wide, 4096):
        part = (column >= a) & (column < a + 4096)
        m = np.zeros((n, min(4096, wide - a)), np.float32)
        m[row[part], column[part] - a] = 1
        common += m @ m.T
    least = np.minimum(held[:, None], held[None, :]) * SHARED
    near = (common >= least) & (100 * np.minimum(sizes[:, None], sizes[None, :]) >= percent * np.maximum(sizes[:, None], sizes[None, :]))
    lr = np.array(left)[:, None] & np.array(right)[None, :]
    near &= np.triu(lr | lr.T, 1)
    x, y = np.nonzero(near)
    for i in np.argsort(-common[x, y], kind="stable"):  # the likeliest first: they join most
        a, b = int(x[i]), int(y[i])
        if forest.find(a) != forest.find(b) and union_estimate(sketch[a], sketch[b], k) >= PASS and similar(full[a], full[b], percent):
            forest.join(a, b)
            out.append((nodes[a], nodes[b]))
    return out


def _verify(percent: int, k: int):
    """Rows sorted by (canopy, i, j); links of each such group."""

    @C.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets, left, right = None, [], [], [], []
        for batch in C.slices(batches):
            found = []
            for c, i, j, node, block, body in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (c, i, j) != now:
                    if len(nodes) > 1:
                        found += block_links(nodes, sets, left, right, percent, k)
                    now, nodes, sets, left, right = (c, i, j), [], [], [], []
                nodes.append(node)
                sets.append(body)
                left.append(block == i)
                right.append(block == j)
            yield pa.RecordBatch.from_arrays([pa.array([f[x] for f in found], pa.int64()) for x in (0, 1)], ["a", "b"])
        if len(nodes) > 1:
            found = block_links(nodes, sets, left, right, percent, k)
            yield pa.RecordBatch.from_arrays([pa.array([f[x] for f in found], pa.int64()) for x in (0, 1)], ["a", "b"])

    return task


def _full_sets(docs: DataFrame, wanted: DataFrame, text: str, doc_id: str, n: int) -> DataFrame:
    """(node, body) for the wanted nodes (node, key, first_doc), from the texts of their first documents.

    A bit sieve of the wanted ids (of fixed size, whatever their number) drops most other rows
    before the join by id, so their texts aren't moved.
    """
    h = F.xxhash64(F.coalesce("first_doc", F.lit(-1)))
    place = F.pmod(h, F.lit(1 << SIEVE_BITS))
    marks = wanted.select((place / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod({_sql_hash('first_doc')}, 64) as int))").alias("bit"))
    words = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    for r in marks.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():  # at most 2^17 rows
        words[r["word"]] = r["bits"]
    sieve = docs.sparkSession.sparkContext.broadcast(words.view(np.uint64))

    @C.tidy
    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            at = batch.column(2).to_numpy() % (1 << SIEVE_BITS)
            hit = (sieve.value[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)
            yield batch.filter(pa.array(hit.astype(bool))).select([0, 1])

    some = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(doc_id).cast("long"), F.lit(-1))).alias("h")).mapInArrow(sift, "doc_id long, text string")

    @C.tidy
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = C.spaces_scanner()
        for batch in C.slices(batches):
            texts, keys = C.texts_of(batch, "text"), batch.column(1).to_pylist()
            for a, b in C.sub_batches(texts):
                got = list(shingle_sets(texts[a:b], scanner, n))
                same = [own is not None and own == key for (_, own), key in zip(got, keys[a:b], strict=True)]
                part = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s, _ in got], pa.binary())], ["node", "body"])
                yield part.filter(pa.array(same))

    met = some.join(wanted, F.col("doc_id").eqNullSafe(F.col("first_doc"))).select("node", "key", "text")
    return met.mapInArrow(sets, "node long, body binary").dropDuplicates(["node"])


def _sql_hash(column: str) -> str:
    return f"xxhash64(coalesce({column}, -1L))"


def link_nodes(docs: DataFrame, nodes: DataFrame, text: str, doc_id: str, n: int, percent: int, k: int, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join all nodes of one component; nodes: node, key, first_doc, sketch."""
    postings = nodes.select("node", "sketch").mapInArrow(_postings, "node long, value long, held int")
    often = postings.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = C.spread_join(postings, often, "value", "node", "df", nodes.count() * min(k, K))
    by_node = Window.partitionBy("node")
    # values in one node only are the rarest of all: they count for the place, but make no list
    ranked = shared.withColumn("rest", F.col("held") - F.count(F.lit(1)).over(by_node)).withColumn("place", F.col("rest") + F.row_number().over(by_node.orderBy("df", "value")))
    common = F.when(F.col("held").cast("long") * 100 <= F.lit(percent * k), F.ceil(F.col("held") * percent / 100 - 1e-9)).otherwise(F.ceil(F.col("held") * SHARED))
    lists = C.cut(ranked.where(F.col("place") <= F.col("held") - common + 1).select("value", "node"))

    sketches = nodes.select("node", "sketch")
    canopies = None
    for _ in range(rounds):
        rows = lists.count()
        first = lists.groupBy("value").agg(F.min_by("node", F.struct(F.xxhash64("node"), "node")).alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1")
        lists = C.spread_join(lists, first, "value", "node", "size", rows).where("node <> pivot").select("value", "node", "pivot")
        pairs = lists.select("pivot", "node").distinct()
        centres = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("size")).join(sketches.select(F.col("node").alias("pivot"), F.col("sketch").alias("x")), "pivot")
        with_sketch = C.spread_join(pairs.join(sketches.withColumnRenamed("sketch", "y"), "node"), centres, "pivot", "node", "size", rows)
        near = C.cut(with_sketch.select("pivot", "node", "x", "y").mapInArrow(_estimates(k), "pivot long, node long, near double"))
        gathered = near.where(F.col("near") >= LOOSE).select("pivot", "node")
        canopies = gathered if canopies is None else canopies.unionByName(gathered)
        lists = C.cut(lists.join(near.where(F.col("near") >= TIGHT).select("pivot", "node"), ["pivot", "node"], "left_anti").select("value", "node"))
        if lists.isEmpty():
            break
    kept = canopies.distinct()
    canopy = lambda kind, column: F.xxhash64(F.lit(kind), column)
    members = kept.unionByName(kept.select("pivot", F.col("pivot").alias("node")).distinct()).select(canopy(0, "pivot").alias("c"), "node", F.col("pivot").alias("centre"))
    # lists of the same members are one canopy: told by size and two sums of hashes
    marks = [F.sum(F.xxhash64("node", F.lit(i)).cast("decimal(20,0)")).alias(f"mark{i}") for i in (1, 2)]
    left = lists.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("centre"), *marks).where("size > 1")
    left = left.groupBy("size", "mark1", "mark2").agg(F.min_by(F.struct("value", "centre"), "value").alias("one")).select("one.value", "one.centre", "size")
    members = C.cut(members.unionByName(C.spread_join(lists, left, "value", "node", "size", lists.count()).select(canopy(1, "value").alias("c"), "node", "centre")))
    rows = members.count()
    wanted = members.select("node").distinct().join(nodes.select("node", "key", "first_doc"), "node")
    bodies = C.cut(_full_sets(docs, wanted, text, doc_id, n))
    sizes = members.groupBy("c").agg(F.count(F.lit(1)).alias("size"))
    sized = C.cut(C.spread_join(members, sizes, "c", "node", "size", rows))
    verify = _verify(percent, k)

    def links_of(tasks: DataFrame) -> DataFrame:
        """tasks: c, i, j, node, block; members of block i are compared with those of block j."""
        with_body = tasks.join(bodies, "node").select("c", "i", "j", "node", "block", "body")
        return with_body.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j", "node").mapInArrow(verify, "a long, b long")

    large = sized.where(F.col("size") > block)
    blocks = F.ceil(F.col("size") / block).cast("int")
    dealt = lambda count: F.pmod(F.xxhash64("node"), count).cast("int")
    # each member of a large canopy with the centre, which is block -1 of every task
    around = large.where("node <> centre").withColumn("i", dealt(blocks)).select("c", "i", F.lit(-1).alias("j"), "node", F.col("i").alias("block"))
    centre = large.where("node = centre").withColumn("i", F.explode(F.sequence(F.lit(0), blocks - 1))).select("c", "i", F.lit(-1).alias("j"), "node", F.lit(-1).alias("block"))
    stars = C.cut(links_of(around.unionByName(centre)))
    ends = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(stars.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # what is linked with its centre is done with; the others meet everyone
    linked = ends.select(F.col("u").alias("node"), F.col("v").alias("centre")).distinct().withColumn("done", F.lit(1))
    told = C.cut(large.join(linked, ["node", "centre"], "left").select("c", "node", "size", (F.col("done").isNotNull() | (F.col("node") == F.col("centre"))).alias("done")))
    open_ = told.groupBy("c").agg(F.count(F.lit(1)).alias("size"), F.sum((~F.col("done")).cast("long")).alias("rest")).where("rest > 0")
    again = C.spread_join(told.drop("size"), open_, "c", "node", "size", rows)
    inner, outer = F.ceil((F.col("size") - F.col("rest")) / block).cast("int"), F.ceil(F.col("rest") / block).cast("int")
    placed = again.withColumn("block", F.when(F.col("done"), dealt(inner)).otherwise(inner + dealt(outer)))
    placed = placed.withColumn("other", F.explode(F.sequence(F.when(F.col("done"), inner).otherwise(0), inner + outer - 1)))
    wide = placed.select("c", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block")
    small = sized.where(F.col("size") <= block).select("c", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", F.lit(0).alias("block"))
    return stars.unionByName(links_of(small.unionByName(wide)))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, threshold: float = THRESHOLD, k: int = K, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the component's least id is its own) for every row; ``exact``: whole sets as sketches."""
    own = C.Kept(docs, "unused int")
    given = own.df.select(own.column(doc_id).cast("long").alias("doc_id"), own.column(text).alias("text"))
    return _placed(given, shingle, threshold, WHOLE if exact else k, [])


def _placed(docs: DataFrame, shingle: int, threshold: float, k: int, marks: list[Column]) -> DataFrame:
    """What ``near_duplicates`` returns for docs (doc_id, text), behind it the ``marks`` (long columns) of each row."""
    C.prepare(docs.sparkSession)
    percent = math.ceil(threshold * 100 - 1e-9)
    given = docs.select("doc_id", "text", *marks)
    names = given.columns[2:]
    rows = C.cut(given.mapInArrow(_profile(shingle, k), ", ".join(["doc_id long, key binary, n_shingles long, sketch binary", *(f"{c} long" for c in names)])))
    grouped = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.max("sketch").alias("sketch"))
    nodes = C.cut(grouped.withColumn("node", F.monotonically_increasing_id()))
    links = link_nodes(docs, nodes, "text", "doc_id", shingle, percent, k)
    roots = components(links)
    placed = nodes.select("node", "key", "first_doc").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.where("root <> node").groupBy("root").agg(F.min("first_doc").alias("least"))
    own = placed.select("root", F.col("node").alias("self"), "first_doc").where("root = self").join(least, "root", "left")
    own = own.select("root", F.least("first_doc", "least").alias("component_id")).join(placed.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root")
    by_key = C.spread_join(placed.select("key", "root"), own, "root", "key", "size", nodes.count()).select("key", "component_id")
    out = rows.select("doc_id", "n_shingles", "key", *names).join(by_key, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *names)


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, threshold: float = THRESHOLD, k: int = K, exact: bool = False) -> DataFrame:
    """The rows of ``docs`` that are their component's least id, all columns as they are; of rows that repeat one id and text, one.

    Rows with a null id stay unless their component has an id, or another such row of the same text stays.
    Rows go by id and text (null is an empty one): another text of the same id is judged by its own
    component.  Of rows that differ in other columns only, the one whose columns have the least hash
    stays, whatever order rows come in (maps, which have no hash, aside).
    """
    kept = C.Kept(docs, "unused int", [])
    mark = F.xxhash64(F.coalesce(kept.column(text), F.lit("")))
    found = _placed(kept.df.select(kept.column(doc_id).cast("long").alias("doc_id"), kept.column(text).alias("text"), mark.alias("mark")), shingle, threshold, WHOLE if exact else k, [F.col("mark")])
    gone = found.where("not kept").select(F.col("doc_id").alias("gone"), F.col("mark").alias("copy")).distinct()
    others = F.xxhash64(*(f.name for f in kept.df.schema if "map<" not in f.dataType.simpleString()))
    own = kept.df.withColumn("id", kept.column(doc_id).cast("long")).withColumn("mark", mark).withColumn("others", others)
    repeated = own.groupBy("id", "mark").agg(F.count(F.lit(1)).alias("n"), F.min("others").alias("least")).where("n > 1").select(F.col("id").alias("same"), F.col("mark").alias("twin"), "least")
    own = own.join(repeated, F.col("id").eqNullSafe(F.col("same")) & (F.col("mark") == F.col("twin")), "left").where("least is null or others = least").drop("same", "twin", "least", "others")
    left = own.join(gone, F.col("id").eqNullSafe(F.col("gone")) & (F.col("mark") == F.col("copy")), "left_anti")
    return left.dropDuplicates(["id", "mark"]).drop("id", "mark").toDF(*docs.columns)
