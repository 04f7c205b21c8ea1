"""The document store: ingest, layout, index, listings, conversations.  Sinks replace whole partitions."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.functions.text import collapse

MOST_BYTES = 25 << 20
OCR_LEAST = 20
TITLE = 512
# Fixed value: what a list item begins with.
LIST_ITEM = r"(?U)^\s*(?:[-*•]|\d+[.)]|[A-Za-z][)])\s+"


def accepted_files(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """Rows of ``binaryFile`` (path, length, content) that are PDF files within the size limit, with their checksum."""
    return files.where(F.lower("path").endswith(".pdf") & (F.col("length") <= most) & (F.substring("content", 1, 5) == F.lit("%PDF-").cast("binary"))).withColumn("checksum_sha256", F.sha2("content", 256))


def accepted_upload(name: Column, mime: Column) -> Column:
    return F.lower(name).endswith(".pdf") & F.coalesce(F.lower(mime), F.lit("")).isin("application/pdf", "application/octet-stream")


def new_documents(incoming: DataFrame, stored: DataFrame, by: str = "checksum_sha256") -> DataFrame:
    """Incoming documents whose checksum isn't stored, each checksum once (the least id)."""
    fresh = incoming.join(stored.select(by).distinct(), by, "left_anti")
    first = Window.partitionBy(by).orderBy("document_id")
    return fresh.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def page_state(pages: DataFrame, least: int = OCR_LEAST) -> DataFrame:
    """What a page's native text (text, has_image) leads to: needs_ocr, run_ocr."""
    plain = collapse(F.coalesce("text", F.lit("")))
    needs = F.length(plain) < least
    return pages.withColumn("native_text", plain != "").withColumn("needs_ocr", needs).withColumn("run_ocr", needs & ((plain != "") | F.col("has_image")))


def merge_ocr(pages: DataFrame, results: DataFrame, least: int = OCR_LEAST) -> DataFrame:
    """Pages with their OCR result (document_id, page_number, ocr_text, ocr_confidence) where it is long enough."""
    met = pages.join(results, ["document_id", "page_number"], "left")
    good = F.col("run_ocr") & (F.length(collapse(F.coalesce("ocr_text", F.lit("")))) >= least)
    return met.withColumn("ocr_applied", F.coalesce(good, F.lit(False))).withColumn("text", F.when(good, F.col("ocr_text")).otherwise(F.col("text"))).withColumn("needs_ocr", F.col("needs_ocr") & ~F.coalesce(good, F.lit(False))).withColumn("extraction_method", F.when(good, "ocr").otherwise("native"))


def ocr_confidence(words: DataFrame) -> DataFrame:
    """Text and mean confidence of a page's OCR words (confidence below 0: none)."""
    order = F.transform(F.array_sort(F.collect_list(F.when(F.trim("word") != "", F.struct("word_index", "word")))), lambda x: x["word"])
    return words.groupBy("document_id", "page_number").agg(F.array_join(order, " ").alias("ocr_text"), F.round(F.avg(F.when(F.col("confidence") >= 0, F.col("confidence"))), 2).alias("ocr_confidence"))


def document_status(pages: DataFrame) -> DataFrame:
    """Counters of each document; one page that still needs OCR makes it fail."""
    return pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("page_count"), F.count_if("native_text").alias("native_pages"), F.count_if("ocr_applied").alias("ocr_pages"), F.count_if("needs_ocr").alias("open_pages")).withColumn("status", F.when(F.col("open_pages") > 0, "failed").otherwise("ready"))


def blank_to_null(columns: list[str]) -> list[Column]:
    return [F.nullif(F.trim(c), F.lit("")).alias(c) for c in columns]


def classify_blocks(blocks: DataFrame) -> DataFrame:
    """Kinds of text blocks (document_id, text, font_size, is_bold): heading, list_item or paragraph.

    A heading is short and set larger than the document's median size, or bold and a little larger, or in capitals.
    """
    median = F.median("font_size").over(Window.partitionBy("document_id"))
    short = (F.length("text") <= 140) & (F.size(F.split(collapse(F.col("text")), " ")) <= 20)
    big = (F.col("font_size") >= 1.2 * median) | (F.coalesce("is_bold", F.lit(False)) & (F.col("font_size") >= 1.05 * median))
    capitals = (F.col("text") == F.upper("text")) & F.col("text").rlike(r"\p{L}") & (F.length("text") <= 100)
    kind = F.when(F.col("text").rlike(LIST_ITEM), "list_item").otherwise("paragraph")
    return blocks.withColumn("element_type", F.when(short & (F.coalesce(big, F.lit(False)) | capitals), "heading").otherwise(kind))


def outside_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks that touch no table of their page: an anti join on the page with strict overlap."""
    b, t = blocks.alias("b"), tables.alias("t")
    touch = (F.col("b.x0") < F.col("t.x1")) & (F.col("t.x0") < F.col("b.x1")) & (F.col("b.y0") < F.col("t.y1")) & (F.col("t.y0") < F.col("b.y1"))
    return b.join(t, (F.col("b.document_id") == F.col("t.document_id")) & (F.col("b.page_number") == F.col("t.page_number")) & touch, "left_anti")


def reading_order(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("sequence_order", F.row_number().over(Window.partitionBy("document_id", "page_number").orderBy("y0", "x0")))


def listing(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of a listing, from 1; the order must be total."""
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def recent_conversations(conversations: DataFrame, most: int = 100) -> DataFrame:
    """The conversations that changed last; on ties the younger, then the least id."""
    return conversations.orderBy(F.desc("updated_at"), F.desc("created_at"), "id").limit(most)


def messages_of(messages: DataFrame, conversation_id) -> DataFrame:
    """A conversation's messages in their order."""
    return messages.where(F.col("conversation_id") == conversation_id).orderBy("sequence_number", "id")


def one_document(documents: DataFrame, document_id) -> DataFrame:
    """The document of that id, or nothing; the filter reaches the scan."""
    return documents.where(F.col("document_id") == document_id)


def with_documents(chunks: DataFrame, documents: DataFrame, shown: tuple[str, ...] = ("original_filename", "is_indexed")) -> DataFrame:
    """Chunks beside their document's columns; chunks of documents that aren't indexed don't count."""
    return chunks.join(documents.where("is_indexed").select("document_id", *shown), "document_id")


def nested_documents(documents: DataFrame, pages: DataFrame, elements: DataFrame) -> DataFrame:
    """Each document with its pages in order, and in each its elements in order."""
    own = [c for c in elements.columns if c not in ("document_id", "page_number")]
    held = elements.groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("sequence_order", *(c for c in own if c != "sequence_order")))).alias("elements"))
    more = [c for c in pages.columns if c not in ("document_id", "page_number")]
    page = pages.join(held, ["document_id", "page_number"], "left").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", *more, "elements"))).alias("pages"))
    return documents.join(page, "document_id", "left")


def total_pages(total: Column, size: int) -> Column:
    return F.when(total > 0, F.ceil(total / size)).otherwise(F.lit(0))


def document_summary(documents: DataFrame, pages: DataFrame, elements: DataFrame, tables: DataFrame) -> DataFrame:
    """Counts over pages, elements and tables of each document, pre-aggregated on each side."""
    p = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if("ocr_applied").alias("ocr_pages"), F.sum(F.length("text")).alias("characters"))
    e = elements.groupBy("document_id").agg(F.count(F.lit(1)).alias("elements"), *(F.count_if(F.col("element_type") == k).alias(f"{k}s") for k in ("heading", "paragraph", "list_item")))
    t = tables.groupBy("document_id").agg(F.count(F.lit(1)).alias("tables"), F.sum(F.size("rows")).alias("table_rows"))
    out = documents.select("document_id")
    for x in (p, e, t):
        out = out.join(x, "document_id", "left")
    return out.na.fill(0)


def replace_index(stored: DataFrame, fresh: DataFrame, by: str = "document_id") -> DataFrame:
    """Stored chunks with those of re-indexed documents replaced; write it as a new version, then swap."""
    return stored.join(fresh.select(by).distinct(), by, "left_anti").unionByName(fresh)


def write_index(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """An upsert of whole documents into a table by document bucket, at ``path``.

    What is stored of the buckets that ``chunks`` touches, less the documents it brings anew, is
    written with it as a new version of those buckets; a list then names the version of each bucket,
    and only from then on old versions go unread.  A task that is lost runs again from
    stored files, none of which is overwritten.
    """
    spark = chunks.sparkSession
    fresh = chunks.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int"))
    touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())  # at most ``buckets``
    if not touched:
        return
    now = _versions(spark, path)
    stored = _stored(spark, path, {b: now[b] for b in touched if b in now})
    whole = fresh if stored is None else replace_index(stored.where(F.col("bucket").isin(touched)), fresh.select(stored.columns))
    version = f"v{max([int(v[1:9]) for v in now.values()], default=0) + 1:08d}-{uuid.uuid4().hex}"  # an attempt that failed before is in nobody's way
    whole.write.partitionBy("bucket").parquet(f"{path}/{version}")
    _set_versions(spark, path, now | dict.fromkeys(touched, version))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The chunks that ``write_index`` left, each bucket in its current version."""
    stored = _stored(spark, path, _versions(spark, path))
    if stored is None:
        raise FileNotFoundError(f"no index at {path}")
    return stored


def _stored(spark: SparkSession, path: str, versions: dict[int, str]) -> DataFrame | None:
    """Rows of buckets by version: a scan of each version, pruned to its buckets."""
    out = None
    for version in sorted(set(versions.values())):
        held = [b for b, v in versions.items() if v == version]
        part = spark.read.parquet(f"{path}/{version}").where(F.col("bucket").isin(held))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place, jvm


def _versions(spark: SparkSession, path: str) -> dict[int, str]:
    """Which version of each bucket counts: the last whole list."""
    fs, place, jvm = _hadoop(spark, path)
    if not fs.exists(place):
        return {}
    lists = sorted(s.getPath().getName() for s in fs.listStatus(place) if s.getPath().getName().startswith("_current-") and not s.getPath().getName().endswith(".tmp"))
    if not lists:
        return {}
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(place, lists[-1]))
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {int(b): v for b, v in json.loads(text).items()}


def _set_versions(spark: SparkSession, path: str, versions: dict[int, str]) -> None:
    """A new list beside the old ones, whole at once by a rename."""
    fs, place, jvm = _hadoop(spark, path)
    name = f"_current-{max(versions.values())}"
    temporary = jvm.org.apache.hadoop.fs.Path(place, name + ".tmp")
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps(versions).encode()))
    out.close()
    if not fs.rename(temporary, jvm.org.apache.hadoop.fs.Path(place, name)):
        raise OSError(f"{name} can't be written at {path}")


def delete_cascade(gone: DataFrame, tables: dict[str, DataFrame], by: str = "document_id") -> dict[str, DataFrame]:
    ids = gone.select(by).distinct()
    return {name: df.join(ids, by, "left_anti") for name, df in tables.items()}


def append_messages(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming messages (conversation_id, arrival, role, content) numbered behind the stored ones; blank ones are left out."""
    last = stored.groupBy("conversation_id").agg(F.max("sequence_number").alias("last"))
    order = Window.partitionBy("conversation_id").orderBy("arrival")
    fresh = incoming.where((F.trim("content") != "") & F.col("role").isin("user", "assistant")).withColumn("n", F.row_number().over(order))
    return fresh.join(last, "conversation_id", "left").withColumn("sequence_number", F.coalesce("last", F.lit(0)) + F.col("n")).drop("last", "n", "arrival")


def titles(conversations: DataFrame, messages: DataFrame, length: int = TITLE) -> DataFrame:
    """Conversations without a title get their first question."""
    first = messages.where("role = 'user'").groupBy("conversation_id").agg(F.min_by("content", "sequence_number").alias("first"))
    return conversations.join(first, "conversation_id", "left").withColumn("title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.left("first", F.lit(length)))).drop("first")


def version_chain(versions: DataFrame) -> DataFrame:
    """Each version with the one before it, and whether it is the latest."""
    order = Window.partitionBy("document_id").orderBy("version_number")
    return versions.withColumn("previous_version", F.lag("version_number").over(order)).withColumn("is_latest", F.lead("version_number").over(order).isNull())


def pages_represented(chunks: DataFrame) -> DataFrame:
    """Distinct pages that chunks cover."""
    spread = F.explode(F.sequence("start_page", F.coalesce("end_page", "start_page")))
    return chunks.where("start_page is not null").select("document_id", spread.alias("page")).groupBy("document_id").agg(F.array_sort(F.collect_set("page")).alias("pages"))


def unverified(mapping: DataFrame, stored: DataFrame, identity: list[str]) -> DataFrame:
    """Mappings whose identity isn't what is stored: nothing may be deleted unless there are none."""
    return mapping.join(stored.select("document_id", *identity), ["document_id", *identity], "left_anti")


def delete_verified(mapping: DataFrame, stored: DataFrame, identity: list[str]) -> DataFrame:
    """What stays stored after the mapped documents go; raises unless every mapping is verified."""
    if not unverified(mapping, stored, identity).isEmpty():
        raise ValueError("a mapping doesn't match what is stored; nothing is deleted")
    return stored.join(mapping.select("document_id"), "document_id", "left_anti")


def distinct_titles(documents: DataFrame) -> DataFrame:
    """Labels for people: the title, with the id behind it where several have it."""
    same = F.count(F.lit(1)).over(Window.partitionBy("title"))
    return documents.withColumn("label", F.when(same > 1, F.concat("title", F.lit(" ("), F.left(F.col("document_id").cast("string"), F.lit(8)), F.lit(")"))).otherwise(F.col("title")))
