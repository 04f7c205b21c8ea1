"""Comparison of two versions: texts, tables and metadata.

Exact pairs meet by text and occurrence.  Texts of what is left meet in blocks, each of one version with
each of the other, where an index of words finds all similar pairs; what the greedy pairing, a grouped
map for each pair of versions, gets is the blocks' numbers and the measured pairs of texts.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.functions import text as T

SIMILAR, OVERLAP, TABLE_SCORE = 0.55, 0.6, 0.60
MOST_ITEMS, MOST_CHARS = 1000, 100_000
LAST = 10**9
FIELDS = ("title", "author", "subject", "keywords")
_WORD = re.compile(r"\w+(?:[-']\w+)?")


def blocks(chunks: DataFrame, prefix: str, skip_tables: bool = True) -> DataFrame:
    """Labelled blocks of a version: numbered by place before tables and blanks go."""
    order = Window.partitionBy("pair_id").orderBy("sequence_number", "chunk_id")
    out = chunks.withColumn("source_id", F.concat(F.lit(prefix), F.row_number().over(order).cast("string"))).withColumn("normal", T.nfkc(F.col("text")))
    if skip_tables and "content_type" in chunks.columns:
        out = out.where("content_type <> 'table'")
    return out.where("normal <> ''")


def exact_pairs(base: DataFrame, target: DataFrame, text: str = "normal", order: str = "sequence_number", scope: str = "pair_id") -> DataFrame:
    """Full outer join of the k-th base and the k-th target occurrence of each text; sides b_* and t_*."""

    def numbered(df: DataFrame, side: str) -> DataFrame:
        w = Window.partitionBy(scope, text).orderBy(order)
        kept = df.withColumn("occurrence", F.row_number().over(w))
        return kept.select(scope, F.sha2(F.col(text), 256).alias("mark"), "occurrence", *(F.col(c).alias(f"{side}_{c}") for c in df.columns if c != scope))

    return numbered(base, "b").join(numbered(target, "t"), [scope, "mark", "occurrence"], "full_outer")


PAIRS = "pair_id string, base_id string, target_id string, similarity double"
EDGES = "pair_id string, base binary, target binary, ratio double, shared double"
FAR = (2 - SIMILAR) / SIMILAR + 1e-4  # a text longer than the other by more than this can't be similar
BLOCK_CHARS, MOST_CHARS_HELD = 1 << 20, 64 << 20  # characters of a block of one side: where blocks are few, and at most
MOST_BLOCKS = 12  # of a side, unless they would be larger than the most
TOGETHER = 1 << 22  # entries of postings that are looked at together


class Side:
    """Word sets of a block's texts as numbers, each set with its rarest words first once they are ranked."""

    def __init__(self, texts: list[str], ids: dict[str, int]) -> None:
        self.chars = np.fromiter(map(len, texts), np.int64, len(texts))
        self.size = np.zeros(len(texts), np.int64)
        parts = []
        for i, x in enumerate(texts):
            parts.append(np.array([ids.setdefault(w, len(ids)) for w in set(_WORD.findall(x.casefold()))], np.int32))
            self.size[i] = len(parts[-1])
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.start = np.cumsum(self.size) - self.size
        self.owner = np.repeat(np.arange(len(texts)), self.size)

    def ranked(self, rank: np.ndarray) -> None:
        self.words = rank[self.words]
        self.words = self.words[np.lexsort((self.words, self.owner))]
        self.behind = (self.start + self.size)[self.owner] - np.arange(len(self.words))
        least = np.array([next(c for c in range(int(OVERLAP * n), n + 1) if c / n >= OVERLAP) if n else 1 for n in range(int(self.size.max(initial=0)) + 1)])
        self.need = least[self.size]

    def shared(self, one: np.ndarray, others: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """How many of ``one`` 's words each of the other texts (of this side) has; ``mark`` is all false before and after."""
        mark[one] = True
        size = self.size[others]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(self.start[others] - ends + size, size)
        out = np.add.reduceat(mark[self.words[at]].astype(np.int64), ends - size)
        mark[one] = False
        return out


def _overlapping(few: Side, many: Side, larger: bool, mark: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text of few, texts of many, shared words) where few's set is the smaller one (or as large, unless the other is to be ``larger``).

    With words in one order, the rarest first, the first word that two texts share is so far in front in both
    that the words behind it still hold the overlap the smaller set asks for.
    """
    width = int(many.chars.max(initial=0)) + 2
    key = many.words.astype(np.int64) * width + many.chars[many.owner]
    order = np.argsort(key, kind="stable")
    key, owner, behind = key[order], many.owner[order], many.behind[order]
    front = np.flatnonzero(few.behind >= few.need[few.owner])
    own, at = few.owner[front], few.words[front].astype(np.int64) * width
    low = np.searchsorted(key, at + np.minimum((few.chars[own] / FAR).astype(np.int64), width - 1))
    high = np.searchsorted(key, at + np.minimum((few.chars[own] * FAR).astype(np.int64) + 1, width - 1), "right")
    ends = np.cumsum(high - low)
    i = 0
    while i < len(front):
        stop = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + TOGETHER, "right"))
        stop = int(np.searchsorted(own, own[min(max(stop, i + 1), len(own)) - 1], "right"))  # a text's words stay together
        n = (high - low)[i:stop]
        e = np.cumsum(n)
        place = np.arange(e[-1]) + np.repeat(low[i:stop] - e + n, n)
        x, y = np.repeat(own[i:stop], n), owner[place]
        fits = (behind[place] >= few.need[x]) & ((many.size[y] > few.size[x]) if larger else (many.size[y] >= few.size[x]))
        pairs = np.unique(x[fits] * len(many.size) + y[fits])
        x, y = np.divmod(pairs, max(len(many.size), 1))
        for a, b in zip(*(np.searchsorted(x, np.unique(x), w) for w in ("left", "right")), strict=True):
            one = int(x[a])
            both = many.shared(few.words[few.start[one] : few.start[one] + few.size[one]], y[a:b], mark)
            enough = both >= few.need[one]
            if enough.any():
                yield one, y[a:b][enough], both[enough]
        i = stop


def similar_texts(base: list[str], target: list[str]) -> list[tuple[int, int, float, float]]:
    """(base, target, ratio, shared words by the smaller set) of all texts that are similar enough; the lists are one task's."""
    ids: dict[str, int] = {}
    b, t = Side(base, ids), Side(target, ids)
    often = np.bincount(b.words, minlength=len(ids)) + np.bincount(t.words, minlength=len(ids))
    rank = np.zeros(len(ids), np.int32)
    rank[np.argsort(often, kind="stable")] = np.arange(len(ids), dtype=np.int32)
    b.ranked(rank)
    t.ranked(rank)
    mark = np.zeros(len(ids), bool)
    met: dict[int, list[tuple[int, float]]] = {}
    for x, ys, both in _overlapping(b, t, False, mark):
        for y, n in zip(ys.tolist(), both.tolist(), strict=True):
            met.setdefault(y, []).append((x, n / int(b.size[x])))
    for y, xs, both in _overlapping(t, b, True, mark):
        met.setdefault(y, []).extend((x, n / int(t.size[y])) for x, n in zip(xs.tolist(), both.tolist(), strict=True))
    m, out = difflib.SequenceMatcher(None), []
    for y, found in met.items():  # what is known of the second text is used again
        m.set_seq2(target[y])
        for x, shared in found:
            m.set_seq1(base[x])
            if round(m.real_quick_ratio(), 6) >= SIMILAR and round(m.quick_ratio(), 6) >= SIMILAR and (ratio := round(m.ratio(), 6)) >= SIMILAR:
                out.append((x, y, ratio, shared))
    return out


def _edges(base: pd.DataFrame, target: pd.DataFrame) -> pd.DataFrame:
    found = similar_texts(base["normal"].tolist(), target["normal"].tolist()) if len(base) and len(target) else []
    marks, others = base["mark"].tolist(), target["mark"].tolist()
    pair = str((base if len(base) else target)["pair_id"].iloc[0])
    return pd.DataFrame([(pair, marks[x], others[y], ratio, shared) for x, y, ratio, shared in found], columns=["pair_id", "base", "target", "ratio", "shared"])


def similar_edges(left: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges between the similar texts of each pair of versions.

    left: pair_id, side (b or t), mark, chars of what is to be paired; texts: pair_id, side, mark, normal of all lines.
    Both sides are cut into blocks by their characters, and each block of one meets each of the other in one task
    that finds and measures its pairs.  So what is shuffled is a text for each block of the other side, however many
    pairs share words.
    """
    chars = lambda side: F.sum(F.when(F.col("side") == side, F.col("chars")))
    few = lambda c: F.greatest(F.ceil(c / MOST_CHARS_HELD), F.least(F.lit(MOST_BLOCKS), F.ceil(c / BLOCK_CHARS)), F.lit(1)).cast("int")
    both = left.groupBy("pair_id").agg(few(chars("b")).alias("b"), few(chars("t")).alias("t"), F.count_distinct("side").alias("sides")).where("sides = 2")
    wanted = left.select("pair_id", "side", "mark").distinct().join(both.drop("sides"), "pair_id")
    body = texts.groupBy("pair_id", "side", "mark").agg(F.first("normal").alias("normal")).join(wanted, ["pair_id", "side", "mark"])
    block = lambda n: F.pmod(F.xxhash64("mark"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    b = body.where("side = 'b'").select("pair_id", block("b").alias("i"), each("t").alias("j"), "mark", "normal")
    t = body.where("side = 't'").select("pair_id", each("b").alias("i"), block("t").alias("j"), "mark", "normal")
    cell = ["pair_id", "i", "j"]
    return b.groupBy(*cell).cogroup(t.toDF(*t.columns).groupBy(*cell)).applyInPandas(_edges, EDGES)


def _greedy(blocks: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Base blocks in turn take the most similar target that is still free; edges are between texts."""
    pair = str((blocks if len(blocks) else edges)["pair_id"].iloc[0])
    blocks = blocks.sort_values("sequence_number", kind="stable")
    free: dict[bytes, list] = {}  # blocks of a target text, the next one at the end
    for r in blocks[blocks["side"] == "t"].itertuples():
        free.setdefault(r.mark, []).append((-int(r.sequence_number), r.source_id))
    for held in free.values():
        held.sort()
    near: dict[bytes, list] = {}
    for r in edges.itertuples():
        near.setdefault(r.base, []).append((r.ratio, r.shared, r.target))
    out = []
    for b in blocks[blocks["side"] == "b"].itertuples():
        best = max(((ratio, shared, *free[t][-1], t) for ratio, shared, t in near.get(b.mark, ()) if free.get(t)), default=None)
        if best:
            free[best[4]].pop()
        out.append((pair, b.source_id, best[3] if best else None, best[0] if best else None))
    out += [(pair, None, t, None) for held in free.values() for _, t in reversed(held)]
    return pd.DataFrame(out, columns=["pair_id", "base_id", "target_id", "similarity"])


def align(base: DataFrame, target: DataFrame) -> DataFrame:
    """Aligned blocks: pair_id, base_id, target_id, similarity (1 for equal texts, null for one side only)."""
    side = lambda df, name: df.select(F.col("pair_id").cast("string").alias("pair_id"), F.lit(name).alias("side"), F.unhex(F.left(F.sha2("normal", 256), F.lit(32))).alias("mark"), "source_id", "sequence_number", "normal")
    lines = side(base, "b").unionByName(side(target, "t"))
    # equal texts pair by occurrence: one shuffle of their marks serves the numbers and the pairs
    slim = lines.select("pair_id", "side", "mark", "source_id", "sequence_number", F.length("normal").alias("chars")).repartition("pair_id", "mark")
    slim = slim.withColumn("occurrence", F.row_number().over(Window.partitionBy("pair_id", "mark", "side").orderBy("sequence_number", "source_id")))
    here = lambda name, c: F.max(F.when(F.col("side") == name, F.col(c)))
    met = slim.groupBy("pair_id", "mark", "occurrence").agg(here("b", "source_id").alias("base_id"), here("t", "source_id").alias("target_id"), F.count(F.lit(1)).alias("sides"), F.max("side").alias("side"), F.max("sequence_number").alias("sequence_number"), F.max("chars").alias("chars"))
    same = met.where("sides = 2").select("pair_id", "base_id", "target_id", F.lit(1.0).alias("similarity"))
    left = met.where("sides = 1").select("pair_id", "side", "mark", F.coalesce("base_id", "target_id").alias("source_id"), "sequence_number", "chars")
    edges = similar_edges(left, lines.select("pair_id", "side", "mark", "normal"))
    rest = left.drop("chars").groupBy("pair_id").cogroup(edges.groupBy("pair_id")).applyInPandas(_greedy, PAIRS)
    return same.unionByName(rest)


def changes(base: DataFrame, target: DataFrame, unchanged: bool = False) -> DataFrame:
    """Changes in order, C1, C2, ...: change_type added, removed, modified or unchanged, with both texts."""
    b = base.select(F.col("pair_id").cast("string").alias("pair_id"), F.col("source_id").alias("base_id"), F.col("sequence_number").alias("base_seq"), F.col("text").alias("base_text"))
    t = target.select(F.col("pair_id").cast("string").alias("pair_id"), F.col("source_id").alias("target_id"), F.col("sequence_number").alias("target_seq"), F.col("text").alias("target_text"))
    found = align(base, target).join(b, ["pair_id", "base_id"], "left").join(t, ["pair_id", "target_id"], "left")
    kind = F.when(F.col("base_id").isNull(), "added").when(F.col("target_id").isNull(), "removed").when(F.col("similarity") == 1.0, "unchanged").otherwise("modified")
    found = found.withColumn("change_type", kind)
    if not unchanged:
        found = found.where("change_type <> 'unchanged'")
    order = Window.partitionBy("pair_id").orderBy(F.coalesce("base_seq", F.lit(LAST)), F.coalesce("target_seq", F.lit(LAST)), F.coalesce("base_id", "target_id"))
    return found.withColumn("change_id", F.concat(F.lit("C"), F.row_number().over(order).cast("string")))


def statistics(found: DataFrame) -> DataFrame:
    return found.groupBy("pair_id").agg(*(F.count_if(F.col("change_type") == k).alias(k) for k in ("added", "removed", "modified", "unchanged")), F.count(F.lit(1)).alias("total"))


def within_limits(chunks: DataFrame, items: int = MOST_ITEMS, chars: int = MOST_CHARS) -> DataFrame:
    """Pairs that are small enough to be compared."""
    return chunks.groupBy("pair_id").agg(F.count(F.lit(1)).alias("items"), F.sum(F.length("text")).alias("chars")).where((F.col("items") <= items) & (F.col("chars") <= chars))


def require_limits(*sides: DataFrame, items: int = MOST_ITEMS, chars: int = MOST_CHARS) -> None:
    """Raises where a pair is too large to be compared; the first ten are named."""
    for side in sides:
        small = within_limits(side, items, chars).select("pair_id")
        bad = [str(r[0]) for r in side.select("pair_id").distinct().join(small, "pair_id", "left_anti").orderBy("pair_id").limit(10).collect()]
        if bad:
            raise ValueError(f"too large to be compared: {', '.join(bad)}")


def metadata_changes(pairs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """pairs: pair_id, base_<field>, target_<field>.  A null that gets a value is added, the reverse removed; "" is a value."""
    listed = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"base_{f}").alias("before"), F.col(f"target_{f}").alias("after")) for f in fields))
    rows = pairs.select("pair_id", F.inline(listed))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("modified")
    return rows.where(~T.collapse(F.col("before")).eqNullSafe(T.collapse(F.col("after")))).withColumn("change_type", kind)


def keyed_rows(cells: DataFrame) -> DataFrame:
    """Rows (table_id, row_index, cells) with a key: the first cell small-lettered, ``row-i`` where blank, ``#i`` behind repeated ones."""
    first = T.normal_key(F.coalesce(F.get("cells", F.lit(0)), F.lit("")))
    key = F.when(first == "", F.concat(F.lit("row-"), F.col("row_index").cast("string"))).otherwise(first)
    k = F.row_number().over(Window.partitionBy("table_id", "key").orderBy("row_index"))
    out = cells.withColumn("key", key).withColumn("k", k)
    return out.withColumn("row_key", F.when(F.col("k") > 1, F.concat("key", F.lit("#"), F.col("row_index").cast("string"))).otherwise(F.col("key"))).drop("key", "k")


def header_changes(base: DataFrame, target: DataFrame) -> DataFrame:
    """Headers (table_id, header) on one side only."""
    b, t = (x.select("table_id", T.normal_key(F.col("header")).alias("key"), F.col("header").alias(n)) for x, n in ((base, "before"), (target, "after")))
    met = b.join(t, ["table_id", "key"], "full_outer").where("before is null or after is null")
    return met.select("table_id", F.coalesce("before", "after").alias("header"), F.when(F.col("before").isNull(), "header_added").otherwise("header_removed").alias("change_type"))


def row_changes(base: DataFrame, target: DataFrame) -> DataFrame:
    """Rows (table_id, row_key) on one side only."""
    b, t = base.select("table_id", "row_key", F.lit(True).alias("b")), target.select("table_id", "row_key", F.lit(True).alias("t"))
    met = b.join(t, ["table_id", "row_key"], "full_outer").where("b is null or t is null")
    return met.select("table_id", "row_key", F.when(F.col("b").isNull(), "row_added").otherwise("row_removed").alias("change_type"))


def row_states(base: DataFrame, target: DataFrame) -> DataFrame:
    """All rows (table_id, row_key, cells) of both sides: row_added, row_removed, row_modified, or row_unchanged where all cells agree apart from white space."""
    plain = lambda c: F.transform(c, lambda x: T.collapse(F.coalesce(x, F.lit(""))))
    b = base.select("table_id", "row_key", F.coalesce("cells", F.array().cast("array<string>")).alias("before"))
    t = target.select("table_id", "row_key", F.coalesce("cells", F.array().cast("array<string>")).alias("after"))
    state = F.when(F.col("before").isNull(), "row_added").when(F.col("after").isNull(), "row_removed").when(plain("before") == plain("after"), "row_unchanged").otherwise("row_modified")
    return b.join(t, ["table_id", "row_key"], "full_outer").select("table_id", "row_key", state.alias("change_type"))


def cell_changes(base: DataFrame, target: DataFrame) -> DataFrame:
    """Cells (table_id, row_key, header, value) of common rows and headers whose values differ."""
    b, t = base.withColumnRenamed("value", "before"), target.withColumnRenamed("value", "after")
    met = b.join(t, ["table_id", "row_key", "header"])
    differ = T.collapse(F.coalesce("before", F.lit(""))) != T.collapse(F.coalesce("after", F.lit("")))
    return met.where(differ).select("table_id", "row_key", "header", "before", "after")


def table_score(base_headers: Column, target_headers: Column, base_keys: Column, target_keys: Column, pages_apart: Column, same_index: Column) -> Column:
    """How alike two tables are: headers, first-column keys, pages and place."""
    share = lambda a, b: F.when(F.least(F.size(a), F.size(b)) > 0, F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(F.lit(0.0))
    near = F.greatest(F.lit(0.0), 1 - F.abs(pages_apart) / 5)
    return F.round(0.55 * share(base_headers, target_headers) + 0.30 * share(base_keys, target_keys) + 0.10 * near + F.when(same_index, 0.05).otherwise(0.0), 6)


def table_pairs(base: DataFrame, target: DataFrame) -> DataFrame:
    """Pairs of tables (pair_id, table_id, page_number, table_index, headers, keys), best first for each base table in order."""
    b = base.select("pair_id", *(F.col(c).alias(f"b_{c}") for c in ("table_id", "page_number", "table_index", "headers", "keys")))
    t = target.select("pair_id", *(F.col(c).alias(f"t_{c}") for c in ("table_id", "page_number", "table_index", "headers", "keys")))
    score = table_score(F.col("b_headers"), F.col("t_headers"), F.col("b_keys"), F.col("t_keys"), F.col("b_page_number") - F.col("t_page_number"), F.col("b_table_index") == F.col("t_table_index"))
    candidates = b.join(t, "pair_id").withColumn("score", score).where(F.col("score") >= TABLE_SCORE)

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for _, own in pdf.sort_values(["b_page_number", "b_table_index", "b_table_id"]).groupby("b_table_id", sort=False):
            free = own[~own["t_table_id"].isin(used)]
            if len(free):
                best = max(free.itertuples(), key=lambda r: (r.score, -r.t_page_number, -r.t_table_index, r.t_table_id))
                used.add(best.t_table_id)
                out.append((str(best.pair_id), str(best.b_table_id), str(best.t_table_id), float(best.score)))
        return pd.DataFrame(out, columns=["pair_id", "base_table", "target_table", "score"])

    return candidates.groupBy("pair_id").applyInPandas(greedy, "pair_id string, base_table string, target_table string, score double")


def table_alignment(base: DataFrame, target: DataFrame) -> DataFrame:
    """All tables of both sides: pairs as ``table_pairs`` finds them, and those left over as removed or added."""
    met = table_pairs(base, target).withColumn("change_type", F.lit("matched"))
    names = lambda df, to: df.select(F.col("pair_id").cast("string").alias("pair_id"), F.col("table_id").cast("string").alias(to))
    none = F.lit(None).cast("string")
    removed = names(base, "base_table").join(met.select("pair_id", "base_table"), ["pair_id", "base_table"], "left_anti").select("pair_id", "base_table", none.alias("target_table"), F.lit(None).cast("double").alias("score"), F.lit("removed").alias("change_type"))
    added = names(target, "target_table").join(met.select("pair_id", "target_table"), ["pair_id", "target_table"], "left_anti").select("pair_id", none.alias("base_table"), "target_table", F.lit(None).cast("double").alias("score"), F.lit("added").alias("change_type"))
    return met.unionByName(removed).unionByName(added)


def all_changes(*parts: tuple[str, DataFrame, list[str]]) -> DataFrame:
    """One list of changes, numbered C1, C2, ... for each pair: metadata, text, tables, in the order given.

    parts: (what it is about, its rows with pair_id and change_type, the columns it is ordered by);
    what a part says of a change is kept as ``detail`` (JSON).
    """
    out = None
    for place, (about, rows, order) in enumerate(parts):
        own = [c for c in rows.columns if c not in ("pair_id", "change_id", "change_type")]
        number = F.row_number().over(Window.partitionBy("pair_id").orderBy(*order))
        part = rows.select(F.col("pair_id").cast("string").alias("pair_id"), F.lit(place).alias("place"), F.lit(about).alias("about"), "change_type", number.alias("n"), F.to_json(F.struct(*own)).alias("detail"))
        out = part if out is None else out.unionByName(part)
    by = Window.partitionBy("pair_id").orderBy("place", "n")
    return out.select("pair_id", F.concat(F.lit("C"), F.row_number().over(by).cast("string")).alias("change_id"), "about", "change_type", "detail")


def summary_grounded(summaries: DataFrame, found: DataFrame) -> DataFrame:
    """Whether a comparison's summary (pair_id, summary) cites only changes there are, and at least one: pair_id, cited, unknown, grounded."""
    ids = F.array_distinct(F.regexp_extract_all("summary", F.lit(r"\[(C[0-9]+)\]"), F.lit(1)))
    cited = summaries.select(F.col("pair_id").cast("string").alias("pair_id"), F.explode_outer(ids).alias("change_id"))
    held = found.select(F.col("pair_id").cast("string").alias("pair_id"), "change_id", F.lit(True).alias("held"))
    met = cited.join(held, ["pair_id", "change_id"], "left").groupBy("pair_id").agg(F.count("change_id").alias("cited"), F.count_if(F.col("change_id").isNotNull() & F.col("held").isNull()).alias("unknown"))
    return met.withColumn("grounded", (F.col("cited") > 0) & (F.col("unknown") == 0))


def fallback_summary(found: DataFrame, most: int = 20) -> DataFrame:
    """A sentence for each of the first changes of a pair, with the labels of both sides."""
    labels = F.concat(F.when(F.col("base_id").isNotNull(), F.concat(F.lit("["), "base_id", F.lit("]"))).otherwise(""), F.when(F.col("target_id").isNotNull(), F.concat(F.lit("["), "target_id", F.lit("]"))).otherwise(""))
    say = F.when(F.col("change_type") == "modified", F.concat(F.lit("Changed from "), "base_text", F.lit(" to "), "target_text")).when(F.col("change_type") == "added", F.concat(F.lit("Added: "), "target_text")).when(F.col("change_type") == "removed", F.concat(F.lit("Removed: "), "base_text")).otherwise(F.concat(F.lit("Unchanged: "), "base_text"))
    number = F.substring("change_id", 2, 12).cast("int")
    rows = found.where(number <= most).select("pair_id", number.alias("n"), F.concat(say, F.lit(" "), labels, F.lit(".")).alias("s"))
    return rows.groupBy("pair_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]), " ").alias("summary"))
