"""Markdown corpora: files with front matter, skill directories, and their export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V

_FRONT = r"(?s)\A---\r?\n(.*?)\r?\n---[ \t]*\r?\n?"
_ENTRY = r"(?m)^([A-Za-z][\w ]*?)[ \t]*:[ \t]*(.*?)[ \t]*$"


def read_files(spark: SparkSession, path: str, suffix: str = "*.md") -> DataFrame:
    """path, modified, title (the file's stem), raw: every file below the folder, but for clippings."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).text(path, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("raw"))
    return rows.filter(~F.col("path").contains("Clippings")).withColumn("title", F.url_decode(F.regexp_extract("path", r"([^/]+)\.[^./]*\z", 1)))


def front_matter(raw: Column | str) -> Column:
    """Front matter as a map from lower-cased keys; a list below a key, or in brackets, is joined by commas; of a repeated key the last entry counts. No front matter: an empty map."""
    block = F.regexp_replace(F.regexp_extract(X.col(raw), _FRONT, 1), r"\n[ \t]*-[ \t]+", ",")
    keys = F.transform(F.regexp_extract_all(block, F.lit(_ENTRY), F.lit(1)), lambda k: F.regexp_replace(F.lower(k), " ", "_"))
    values = F.transform(F.regexp_extract_all(block, F.lit(_ENTRY), F.lit(2)), lambda v: F.regexp_replace(v, r"^[,\[\"']+|[\]\"']+\z", ""))
    last = lambda k, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), k)
    return F.map_from_entries(F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e, i: (e["k"] != "") & last(e["k"], i)))


def faults(files: DataFrame) -> DataFrame:
    """title, fault: files that ``parse`` leaves out or reads with loss: no body, front matter that nothing closes, a key that is there twice."""
    block = F.regexp_replace(F.regexp_extract("raw", _FRONT, 1), r"\n[ \t]*-[ \t]+", ",")
    keys = F.filter(F.transform(F.regexp_extract_all(block, F.lit(_ENTRY), F.lit(1)), lambda k: F.regexp_replace(F.lower(k), " ", "_")), lambda k: k != "")
    twice = F.array_sort(F.array_distinct(F.filter(keys, lambda k, i: F.array_contains(F.slice(keys, i + 2, F.size(keys)), k))))
    open_front = F.col("raw").rlike(r"\A---\r?\n") & ~F.col("raw").rlike(_FRONT)
    found = F.array_compact(F.array(F.when(F.length(body(F.coalesce("raw", F.lit("")))) == 0, "no body"), F.when(open_front, "front matter without an end")))
    said = F.concat(F.coalesce(found, F.array().cast("array<string>")), F.coalesce(F.transform(twice, lambda k: F.concat(F.lit("repeated key: "), k)), F.array().cast("array<string>")))
    return files.select("title", F.explode(said).alias("fault"))


def body(raw: Column | str) -> Column:
    return F.trim(F.regexp_replace(X.col(raw), _FRONT, ""))


def taxonomy(values: Column) -> Column:
    """A comma list as distinct lower-cased values in order; "evaluate" is "analyze", AI stays in capitals, blanks go."""
    parts = F.transform(F.split(F.coalesce(values, F.lit("")), ","), lambda v: F.lower(F.trim(F.regexp_replace(v, "[\"']", ""))))
    named = F.transform(parts, lambda v: F.when(v == "evaluate", "analyze").when(v == "ai", "AI").otherwise(v))
    return F.array_distinct(F.filter(named, lambda v: v != ""))


def parse(files: DataFrame) -> DataFrame:
    """title, prompt_text, domain, intent, task_type, status, summary, notes, source, modality, tag, content_hash; files without a body are left out."""
    m = F.col("__m")
    get = lambda k: F.try_element_at(m, F.lit(k))
    status = F.lower(get("status"))
    rows = files.withColumn("__m", front_matter("raw")).withColumn("prompt_text", body("raw")).filter(F.length("prompt_text") > 0)
    return rows.select(
        "title",
        "prompt_text",
        taxonomy(get("domain")).alias("domain"),
        taxonomy(get("intent")).alias("intent"),
        taxonomy(get("task_type")).alias("task_type"),
        F.when(status.isin(V.STATUSES), status).otherwise("active").alias("status"),
        F.nullif(get("summary"), F.lit("")).alias("summary"),
        F.nullif(get("notes"), F.lit("")).alias("notes"),
        F.coalesce(F.nullif(get("source"), F.lit("")), F.lit("private")).alias("source"),
        F.when(F.lower("title").startswith(V.IMAGE_TITLE), "image").otherwise("text").alias("modality"),
        X.slugify("title").alias("tag"),
        X.content_hash("prompt_text").alias("content_hash"),
    )


def valid_only(rows: DataFrame, valid: dict[str, list[str]]) -> DataFrame:
    return rows.withColumns({c: F.array_intersect(c, X.array_of(v)) for c, v in valid.items()})


def sections(raw: Column | str, names: list[str]) -> Column:
    """A struct of the texts under second-level headings that begin with the names."""
    inside = lambda n: F.regexp_extract(X.col(raw), rf"(?ims)^##[ \t]+{n}[^\n]*\n(.*?)(?=^##[ \t]|\z)", 1)
    return F.struct(*[F.regexp_replace(inside(n), r"\A\s+|\s+\z", "").alias(n.lower()) for n in names])


def skill_steps(raw: Column | str) -> Column:
    """Structs (step_order, id, title, rationale) of "### Step 1 · id · title" blocks; headings with fewer than three parts are no steps."""
    blocks = F.filter(F.split(X.col(raw), r"(?m)^### Step "), lambda b, i: i > 0)

    def step(b: Column) -> Column:
        head = F.transform(F.split(F.substring_index(b, "\n", 1), "·"), lambda x: F.trim(x))
        why = F.nullif(F.trim(F.regexp_extract(b, r"(?mi)^rationale:[ \t]*(.*)$", 1)), F.lit(""))
        return F.struct(F.try_element_at(head, F.lit(1)).cast("int").alias("step_order"), F.try_element_at(head, F.lit(2)).alias("id"), F.try_element_at(head, F.lit(3)).alias("title"), why.alias("rationale"), F.size(head).alias("n"))

    return F.filter(F.transform(blocks, step), lambda s: s["n"] >= 3)


def render_skill(skills: DataFrame) -> DataFrame:
    """tag, text: a skill (tag, name, summary, steps of step_order, id, title, rationale) as a markdown file."""
    one = lambda s: F.concat(F.lit("### Step "), s["step_order"].cast("string"), F.lit(" · "), s["id"], F.lit(" · "), s["title"], F.lit("\n"), F.coalesce(F.concat(F.lit("rationale: "), s["rationale"], F.lit("\n")), F.lit("")))
    return skills.select("tag", F.concat_ws("\n", F.concat(F.lit("# "), F.col("name")), F.col("summary"), F.array_join(F.transform("steps", one), "\n")).alias("text"))


def write_back(files: DataFrame, table: DataFrame) -> DataFrame:
    """Front matter fields to fill: title, and field values of the table where the file's are empty, in title case. Both: title, domain, task_type."""
    t = table.select("title", F.col("domain").alias("td"), F.col("task_type").alias("tt"))
    fill = lambda own, other: F.when(F.size(F.coalesce(F.col(own), F.array().cast("array<string>"))) > 0, F.col(own)).otherwise(F.transform(F.col(other), X.title_case))
    return files.join(t, "title").select("title", fill("domain", "td").alias("domain"), fill("task_type", "tt").alias("task_type"))
