"""Folders of prompts and skills as tables, with what couldn't be read as rows of its own.

``scan`` lists the files of a folder wherever Spark can read it. The other functions
take what it gives, so that files from elsewhere do as well: path (below the folder, with
slashes), modified, content (bytes). No bad file stops a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import markdown

# Types and languages of a skill's files by their suffix; of others the type is config.
CODE = ["py", "js", "sql", "sh"]
LANGUAGES = {"py": "python", "js": "javascript", "sql": "sql", "sh": "bash", "yaml": "yaml", "yml": "yaml", "json": "json", "csv": "csv"}


def scan(spark: SparkSession, folder: str, suffix: str = "*") -> DataFrame:
    """path, modified, content of all files below the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).load(folder)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    below = F.regexp_replace(F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"\A[a-z0-9]+:(//[^/]*)?", ""), F.lit(f"^\\Q{root}/\\E"), F.lit(""))
    return files.select(below.alias("path"), F.col("modificationTime").alias("modified"), "content")


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?\z", 1)


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))


def texts(files: DataFrame) -> DataFrame:
    """files with raw: the content as text, null where it isn't UTF-8."""
    return files.withColumn("raw", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")))


def prompts(files: DataFrame, valid: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(prompts, faults) of a corpus of one folder a department: department, path, and ``markdown.parse``'s columns; path, fault.

    Markdown files right below a department count, those of "skills" and of any path with "Clippings" don't. valid: the values that
    taxonomy fields may have. A file that isn't text, has no body, repeats a key or doesn't end its front matter is a fault; the latter two are read all the same.
    """
    own = texts(files).filter(F.col("path").rlike(r"\A[^/]+/[^/]+\.md\z") & ~F.col("path").contains("Clippings") & ~F.col("path").startswith("skills/"))
    named = own.withColumns({"department": F.substring_index("path", "/", 1), "stem": _stem(F.col("path"))})
    good = markdown.parse(named.filter("raw IS NOT NULL").withColumn("title", F.col("path")))
    title = F.initcap(F.regexp_replace(_stem(F.col("title")), "-", " "))
    rows = good.withColumns({"path": F.col("title"), "department": F.substring_index("title", "/", 1)}).withColumns({"title": title, "tag": X.slugify(_stem(F.col("path")))})
    if valid:
        rows = markdown.valid_only(rows, valid)
    garbled = named.filter("raw IS NULL").select("path", F.lit("not text").alias("fault"))
    return rows, garbled.unionByName(markdown.faults(named.filter("raw IS NOT NULL").withColumn("title", F.col("path"))).select(F.col("title").alias("path"), "fault"))


def _manifest(raw: Column) -> Column:
    """The files that front matter lists: structs (path, type, language, description) in order."""
    front = F.regexp_extract(raw, X.FRONT_MATTER, 0)
    # possessive: a loop that may give lines back calls itself for each, which a long list doesn't survive
    block = F.regexp_extract(front, r"(?m)^files:[ \t]*\n((?:[ \t]+.*\n)++)", 1)
    entries = F.filter(F.split(block, r"(?m)^[ \t]*-[ \t]+"), lambda e: F.trim(e) != "")
    field = lambda e, name: F.nullif(F.regexp_replace(F.regexp_extract(e, rf"(?m)^[ \t]*{name}:[ \t]*(.*?)[ \t]*$", 1), r"\A[\"']|[\"']\z", ""), F.lit(""))
    described = F.transform(entries, lambda e: F.struct(field(e, "path").alias("path"), F.coalesce(field(e, "type"), F.lit("prompt")).alias("type"), field(e, "language").alias("language"), F.coalesce(field(e, "description"), F.lit("")).alias("description")))
    return F.filter(described, lambda e: e["path"].isNotNull())


def _content(path: Column, raw: Column) -> Column:
    return F.when(_suffix(path) == "md", markdown.body(raw)).otherwise(raw)


def skills(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(skills, their files, faults) of a folder of one folder a skill, each with an index.md.

    skills: folder, tag, name, summary, domain, intent, task_type, status, overview, when_to_use,
    how_to_use. files: folder, place, path, type, language, description, content, listed: those that the index
    lists and that are there, in its order, then the others right in the folder, by name. faults:
    path, fault: a folder without an index, an index or a file that isn't text, a listed file that isn't there.
    """
    own = texts(files).filter(F.col("path").contains("/")).withColumns({"folder": F.substring_index("path", "/", 1), "name": F.regexp_replace("path", r"\A[^/]+/", "")})
    index = own.filter("name = 'index.md'")
    read = index.filter("raw IS NOT NULL")
    m = markdown.front_matter("raw")
    get = lambda k, other: F.coalesce(F.nullif(F.try_element_at(m, F.lit(k)), F.lit("")), other)
    head = read.select(
        "folder",
        get("tag", F.col("folder")).alias("tag"),
        get("name", F.initcap(F.regexp_replace("folder", "-", " "))).alias("name"),
        get("summary", F.lit("")).alias("summary"),
        *[markdown.taxonomy(F.try_element_at(m, F.lit(c))).alias(c) for c in ("domain", "intent", "task_type")],
        get("status", F.lit("active")).alias("status"),
        markdown.sections(markdown.body("raw"), ["Overview", "When to Use", "How to Use"]).alias("s"),
    )
    head = head.select("*", F.col("s")["overview"].alias("overview"), F.col("s")["when to use"].alias("when_to_use"), F.col("s")["how to use"].alias("how_to_use")).drop("s")
    listed = read.select("folder", F.posexplode(_manifest(F.col("raw"))).alias("place", "e")).select("folder", "place", "e.*")
    there = own.filter("name <> 'index.md'").select("folder", F.col("name").alias("path"), "raw", F.lit(True).alias("__there"))
    met = listed.join(there, ["folder", "path"], "left")
    columns = ["folder", "place", "path", "type", "language", "description", "content", "listed"]
    first = met.filter("__there AND raw IS NOT NULL").withColumns({"content": _content(F.col("path"), F.col("raw")), "listed": F.lit(True)}).select(*columns)
    suffix = _suffix(F.col("path"))
    kind = F.when(suffix == "md", "prompt").when(suffix.isin(CODE), "code").otherwise("config")
    spoken = F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), suffix)
    rest = there.filter(~F.col("path").contains("/") & F.col("raw").isNotNull()).join(listed.select("folder", "path"), ["folder", "path"], "left_anti").join(read.select("folder"), "folder", "left_semi")
    rest = rest.withColumns({"place": F.lit(None).cast("int"), "type": kind, "language": spoken, "description": F.lit(""), "content": _content(F.col("path"), F.col("raw")), "listed": F.lit(False)}).select(*columns)
    fault = lambda rows, why, path="path": rows.select(F.concat_ws("/", "folder", path).alias("path"), F.lit(why).alias("fault"))
    lone = own.select("folder").distinct().join(index.select("folder"), "folder", "left_anti").select(F.col("folder").alias("path"), F.lit("no index").alias("fault"))
    garbled = own.filter("raw IS NULL").select("path", F.lit("not text").alias("fault"))
    return head, first.unionByName(rest), lone.unionByName(garbled).unionByName(fault(met.filter("__there IS NULL"), "listed, not there"))


def import_skills(skills: DataFrame, held: DataFrame) -> DataFrame:
    """tag, action, and name, summary, domain, intent, task_type as they stand afterwards: skills from files met the table (tag and those columns).

    A tag that isn't held is created. One that is held takes over what the file has; empty values of the file change nothing (updated, or same where nothing changed). Held ones without a file stay (kept).
    """
    text, lists = ["name", "summary"], ["domain", "intent", "task_type"]
    new = skills.select("tag", *[F.nullif(F.col(c), F.lit("")).alias(f"__{c}") for c in text], *[F.when(F.size(c) > 0, F.col(c)).alias(f"__{c}") for c in lists], F.lit(True).alias("__new"))
    both = held.select("tag", *text, *lists, F.lit(True).alias("__old")).join(new, "tag", "full")
    changed = F.lit(False)
    for c in [*text, *lists]:
        changed = changed | (F.col(f"__{c}").isNotNull() & ~F.col(f"__{c}").eqNullSafe(F.col(c)))
    action = F.when(F.col("__old").isNull(), "created").when(F.col("__new").isNull(), "kept").when(changed, "updated").otherwise("same")
    return both.select("tag", action.alias("action"), *[F.coalesce(f"__{c}", c).alias(c) for c in [*text, *lists]])
