"""Readers and writers of evaluation data and reports: JSON, JSON lines, CSV, Markdown, binary files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.functions.text import stable_id

PAGE = "array<struct<page_number:int,width:double,height:double,text:string>>"
REGION = "array<struct<page_number:int,label:string,bounding_box:struct<x0:double,y0:double,x1:double,y1:double>>>"
QUESTION = "array<struct<question_id:string,question:string,answers:array<string>>>"
ENTITY = "array<struct<label:string,text:string,page_number:int>>"
MANIFEST = f"evaluation_id string, dataset string, split string, source_record_id string, source_document_id string, local_pdf_path string, page_count int, pages {PAGE}, layout_regions {REGION}, entities {ENTITY}, qa_pairs {QUESTION}, metadata map<string,string>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with a fixed schema: nothing is inferred from the data."""
    return spark.read.schema(MANIFEST).json(path)


def read_cases(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """Cases as JSON lines, or as one JSON list."""
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)


def normal_cases(cases: DataFrame) -> DataFrame:
    """Evaluation cases whose single labels stand first in their lists, where those lack them.

    cases: id, and for each of document, chunk, page a column expected_X and a list expected_Xs; what is
    missing counts as empty.  A case that expects no evidence yet names documents or chunks stops the
    query; ``case_faults`` lists such cases.
    """

    def labels(name: str) -> Column:
        many = F.coalesce(F.col(f"expected_{name}s"), F.array().cast(cases.schema[f"expected_{name}s"].dataType))
        one = F.col(f"expected_{name}")
        given = one.isNotNull() & (one > 0 if name == "page" else one != "")
        return F.when(given & ~F.coalesce(F.array_contains(many, one), F.lit(False)), F.concat(F.array(one), many)).otherwise(many)

    out = cases.withColumns({f"expected_{n}s": labels(n) for n in ("document", "chunk", "page")})
    named = (F.size("expected_documents") > 0) | (F.size("expected_chunks") > 0)
    fault = F.coalesce(F.col("expect_no_evidence"), F.lit(False)) & named
    return out.withColumn("id", F.when(fault, F.raise_error(F.concat(F.lit("a case without evidence names documents or chunks: "), F.col("id")))).otherwise(F.col("id")))


def case_faults(cases: DataFrame) -> DataFrame:
    """One row for each case that breaks a rule, with the rule."""
    some = lambda n: F.coalesce(F.size(f"expected_{n}s"), F.lit(0)) > 0
    named = some("document") | some("chunk") | (F.coalesce("expected_document", F.lit("")) != "") | (F.coalesce("expected_chunk", F.lit("")) != "")
    rules = {
        "it has no question": F.coalesce("question", F.lit("")) == "",
        "it expects no evidence and names some": F.coalesce(F.col("expect_no_evidence"), F.lit(False)) & named,
        "a page is below 1": (F.col("expected_page") < 1) | F.exists("expected_pages", lambda p: p < 1),
    }
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return cases.select("id", F.explode(found).alias("fault")).unionByName(repeated(cases, "id").select("id", F.lit("an id is used twice").alias("fault")))


def iso(at: Column) -> Column:
    """A time as text in UTC, with its offset; a fraction of six digits where there is one."""
    text = F.date_format(at.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.000000$", ""), F.lit("+00:00"))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).count().where("count > 1")


def manifest_faults(manifest: DataFrame) -> DataFrame:
    """One row for each record that breaks a rule, with the rule."""
    numbers = F.transform("pages", lambda p: p["page_number"])
    box = lambda r: (r["bounding_box"]["x1"] > r["bounding_box"]["x0"]) & (r["bounding_box"]["y1"] > r["bounding_box"]["y0"])
    rules = {
        "pages are numbered twice": F.size(F.array_distinct(numbers)) != F.size(numbers),
        "page_count isn't the number of pages": F.col("page_count") != F.size("pages"),
        "a box has no area": F.exists("layout_regions", lambda r: ~F.coalesce(box(r), F.lit(False))),
    }
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    own = manifest.select("evaluation_id", F.explode(found).alias("fault"))
    return own.unionByName(repeated(manifest, "evaluation_id").select("evaluation_id", F.lit("an id is used twice").alias("fault")))


def manifest_counts(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count(F.lit(1)).alias("records"), F.countDistinct("dataset").alias("datasets"), F.countDistinct("split").alias("splits"), F.sum(F.size("pages")).alias("pages"), F.sum(F.size("layout_regions")).alias("regions"), F.sum(F.size("qa_pairs")).alias("questions"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    """JSON lines in the order of ids, columns by name."""
    manifest.select(*sorted(manifest.columns)).orderBy("evaluation_id").write.mode("overwrite").json(path)


def first_records(rows: DataFrame, n: int, order: list) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def first_groups(rows: DataFrame, key: str, position: str, n: int) -> DataFrame:
    """All rows of the first n distinct keys, in the order in which keys first occur."""
    keys = rows.groupBy(key).agg(F.min(position).alias("__first")).orderBy("__first", key).limit(n)
    return rows.join(keys.select(key), key, "left_semi")


def with_ids(rows: DataFrame, dataset: str, split: str, record: str) -> DataFrame:
    return rows.withColumn("evaluation_id", stable_id(dataset, F.lit(dataset), F.lit(split), F.col(record)))


def from_layout_source(annotations: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """Layout regions of each image from (image_id, category_id, bbox x, y, w, h), labels by name."""
    from foliary.operators.evaluate import normal_box

    box = normal_box(*(F.get("bbox", F.lit(i)) for i in range(4)))
    rows = annotations.join(categories, "category_id").withColumn("box", box).where("box is not null")
    regions = rows.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(F.lit(1).alias("page_number"), F.col("name").alias("label"), F.col("box").alias("bounding_box")))).alias("layout_regions"))
    return images.join(regions, "image_id", "left")


def from_question_source(questions: DataFrame) -> DataFrame:
    """One record for each document from (document_id, question_id, question, answers)."""
    pairs = F.array_sort(F.collect_list(F.struct("question_id", "question", "answers")))
    return questions.groupBy("document_id").agg(pairs.alias("qa_pairs"))


def from_form_source(words: DataFrame) -> DataFrame:
    """Entities of forms from (document_id, entity_index, label, text)."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("entity_index", "label", "text"))), lambda e: F.struct(e["label"].alias("label"), e["text"].alias("text"), F.lit(1).alias("page_number")))
    return words.groupBy("document_id").agg(listed.alias("entities"))


def pick_questions(manifest: DataFrame, n: int | None = None) -> DataFrame:
    """Questions of records with their places; with ``n`` the first of them, in the order of records, then of questions."""
    rows = manifest.select("evaluation_id", F.posexplode("qa_pairs").alias("place", "qa"))
    picked = rows if n is None else rows.orderBy("evaluation_id", "place").limit(n)
    return picked.select("evaluation_id", "place", F.col("qa.question").alias("question"), F.col("qa.answers").alias("answers"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV of measures; blanks are null."""
    return spark.read.schema(schema).option("header", "true").option("nullValue", "").csv(path)


def markdown_lines(rows: DataFrame, order: list[str]) -> DataFrame:
    """A table's rows as lines of Markdown, with their place; for reports of a few rows."""
    cells = F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns))
    body = rows.select(F.row_number().over(Window.orderBy(*order)).alias("n"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("value"))
    head = rows.sparkSession.createDataFrame([(-1, "| " + " | ".join(rows.columns) + " |"), (0, "|" + " --- |" * len(rows.columns))], "n int, value string")
    return head.unionByName(body)


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def metric_records(summary: DataFrame, experiment: str, measures: dict[str, str]) -> DataFrame:
    """Long records of a summary's measures with their denominators: experiment, metric, value, denominator, status."""
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.col(d).cast("long").alias("denominator")) for m, d in measures.items()))
    status = F.when(F.coalesce("denominator", F.lit(0)) == 0, "NOT_APPLICABLE").when(F.col("value").isNull(), "NOT_MEASURED").otherwise("MEASURED")
    return summary.select(F.lit(experiment).alias("experiment"), F.inline(rows)).withColumn("status", status)


def checked_artifact(artifact: DataFrame, identity: dict[str, str]) -> DataFrame:
    """An artifact whose identity columns hold what is expected in every row; raises otherwise."""
    for name, value in identity.items():
        if name not in artifact.columns or not artifact.where(~F.col(name).eqNullSafe(F.lit(value))).isEmpty():
            raise ValueError(f"{name} isn't {value!r} throughout")
    return artifact
