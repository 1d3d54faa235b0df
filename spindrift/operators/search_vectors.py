"""Stored search vectors: postings with places and weights, filed by lexeme, and kept in step with their rows.

A table of search vectors is a folder of segments. Each has ``postings`` (lexeme,
id, places, weights, n_lexemes: one row for each lexeme of a row, and one with a null lexeme where there is none, filed by ``bucket``, a hash of the
lexeme) and ``rows`` (the ids that it speaks for, those without any lexeme too). Of an id the newest
segment counts, so a changed row is replaced by writing it again, and a deleted one by an
id without postings. ``compact`` makes one segment of all.

Two configurations: "english" (stems, without stop words) and "simple" (all words in
lower case as they are). Text is taken in fields of weight A to D, in order of place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stemmer as S
from ..functions import text as X
from ..functions import vocabulary as V
from ..session import remove_path, settled
from . import retrieval as R

#: Folders that postings are filed in.
BUCKETS = 64
_ROW = ("id", "lexeme", "places", "weights", "n_lexemes")
#: The weights that places have.
_WEIGHTS = sorted(V.TSVECTOR_WEIGHTS.values())


def vectors(docs: DataFrame, fields: dict[str, str], config: str = "english", id_col: str = "id") -> DataFrame:
    """id, lexeme, places, weights, n_lexemes, n_places: a row for each different lexeme of a document, and one with a null lexeme where there is none.

    fields: column -> A to D. Stop words count as places but aren't lexemes.
    """
    if config not in ("english", "simple"):
        raise ValueError(f"no such configuration: {config}")
    shared = docs.sparkSession.sparkContext.broadcast(([V.TSVECTOR_WEIGHTS[w] for w in fields.values()], config == "english"))

    @F.arrow_udf("struct<n: int, places: int, found: array<struct<lexeme: string, places: array<int>, weights: array<double>>>>")
    def cut(*columns: pa.Array) -> pa.Array:
        known: dict[str, str | None] = {}
        return pa.concat_arrays([some(known, *(c.slice(at, R.TEXTS) for c in columns)) for at in range(0, max(1, len(columns[0])), R.TEXTS)])

    def some(known: dict[str, str | None], *columns: pa.Array) -> pa.Array:
        own, stemmed = shared.value
        totals, spans, out, ends = [], [], [], [0]
        for texts in zip(*(c.to_pylist() for c in columns), strict=True):
            place, n, held = 0, 0, {}
            for text, weight in zip(texts, own, strict=True):
                for token in X.LEXEME.findall((text or "").lower()):
                    place += 1
                    if token not in known:
                        known[token] = token if not stemmed else None if token in S.STOPWORDS else S.stem(token)
                    lexeme = known[token]
                    if lexeme is not None:
                        n += 1
                        places, weights = held.setdefault(lexeme, ([], []))
                        places.append(place)
                        weights.append(weight)
            totals.append(n)
            spans.append(place)
            out += [(x, p, w) for x, (p, w) in held.items()]
            ends.append(len(out))
        lexemes, places, weights = zip(*out) if out else ((), (), ())
        items = pa.StructArray.from_arrays([pa.array(lexemes, pa.string()), pa.array(places, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float64()))], names=["lexeme", "places", "weights"])
        return pa.StructArray.from_arrays([pa.array(totals, pa.int32()), pa.array(spans, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], names=["n", "places", "found"])

    rows = docs.select(F.col(id_col).alias("id"), cut(*[F.col(c).cast("string") for c in fields]).alias("c"))
    return rows.select("id", F.col("c.n").alias("n_lexemes"), F.col("c.places").alias("n_places"), F.explode_outer("c.found").alias("x")).select("id", "x.lexeme", "x.places", "x.weights", "n_lexemes", "n_places")


def _bucket(lexeme: str = "lexeme"):
    return F.pmod(F.xxhash64(lexeme), F.lit(BUCKETS)).cast("int")


def segments(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished segments, in order."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    found = [x.getPath() for x in files.listStatus(at)]
    # rows are written last, so a segment without them was never finished
    return sorted(int(p.getName()[4:]) for p in found if p.getName().startswith("seg-") and files.exists(jvm.org.apache.hadoop.fs.Path(p, "rows/_SUCCESS")))


def _write(rows: DataFrame, path: str, number: int) -> None:
    """rows as ``vectors`` gives them, filed by the tasks that make them: a bucket has a file of each task, and no posting is shuffled."""
    at = f"{path}/seg-{number:06d}"
    rows.select(*_ROW).withColumn("bucket", _bucket()).sortWithinPartitions("bucket", "lexeme").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/postings")
    # the ids are read from what was written, so that rows are neither worked out twice nor written twice
    kind = rows.schema["id"].dataType.simpleString()
    rows.sparkSession.read.schema(f"id {kind}").parquet(f"{at}/postings").select("id").distinct().write.mode("overwrite").parquet(f"{at}/rows")


def write(rows: DataFrame, path: str) -> None:
    """Files search vectors, as ``vectors`` gives them, as the newest segment: they replace those of the same ids."""
    there = segments(rows.sparkSession, path)
    _write(rows, path, there[-1] + 1 if there else 0)


def delete(ids: DataFrame, path: str) -> None:
    """Takes the rows of these ids (column id) away."""
    none = {"lexeme": "string", "places": "array<int>", "weights": "array<double>", "n_lexemes": "int"}
    write(ids.select("id", *[F.lit(None).cast(t).alias(c) for c, t in none.items()]), path)


def _segments(spark: SparkSession, path: str, lexemes: list[str] | None = None) -> list[tuple[int, DataFrame, DataFrame]]:
    """The segments, the newest first: number, postings, ids that it speaks for."""
    there = segments(spark, path)
    if not there:
        raise ValueError(f"no search vectors at {path}")
    buckets = None
    if lexemes is not None:
        buckets = sorted({r[0] for r in spark.createDataFrame([(x,) for x in lexemes], "lexeme string").select(_bucket()).collect()})
    out = []
    for number in reversed(there):
        at = f"{path}/seg-{number:06d}"
        ids = spark.read.parquet(f"{at}/rows")
        own = spark.read.schema("id " + dict(ids.dtypes)["id"] + ", lexeme string, places array<int>, weights array<double>, n_lexemes int, bucket int").parquet(f"{at}/postings").filter("lexeme IS NOT NULL")
        if buckets is not None:
            own = own.filter(F.col("bucket").isin(buckets) & F.col("lexeme").isin(lexemes))
        out.append((number, own.select(*_ROW), ids))
    return out


def read(spark: SparkSession, path: str, lexemes: list[str] | None = None, ids: DataFrame | None = None) -> DataFrame:
    """id, lexeme, places, weights, n_lexemes as they stand now; with lexemes, of these alone: only their buckets' files are opened; with ids (id), few enough to be broadcast, of these rows alone."""
    parts, newer = [], None
    for _, own, spoken in _segments(spark, path, lexemes):
        if ids is not None:
            own, spoken = (x.join(F.broadcast(ids), "id", "left_semi") for x in (own, spoken))
        if newer is not None:
            own = own.join(R.bounded(newer), "id", "left_anti")
        newer = spoken if newer is None else newer.unionByName(spoken).distinct()
        parts.append(own)
    return reduce(DataFrame.unionByName, parts)


def compact(spark: SparkSession, path: str) -> None:
    """Makes one segment of all; searches that still read the others should be done."""
    there = segments(spark, path)
    if len(there) > 1:
        _write(read(spark, path), path, there[-1] + 1)
        for number in there:
            remove_path(spark, f"{path}/seg-{number:06d}")


def put_before(rows: DataFrame, path: str, text_col: str, weight: str = "B", config: str = "english") -> None:
    """Puts a text's lexemes in front of the stored vectors of its rows (id, text), whose places move on by as many words as the text has.

    The same as building the vectors anew with the text as first field. Ids without stored vectors get those of the text alone.
    The rows are worked through in blocks whose lexemes can be broadcast, so that stored postings move where they are read; a block is a segment.
    """
    fresh = settled(vectors(rows, {text_col: weight}, config))
    n, ids = fresh.count(), fresh.select("id").distinct().count()
    blocks = max(1, -(-10 * min(n, 4 * ids) // (9 * R.BROADCAST_ROWS)))  # short texts by their lexemes, long ones by four a row
    for i in range(blocks):
        _put_block(fresh.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i) if blocks > 1 else fresh, path)


def _put_block(fresh: DataFrame, path: str) -> None:
    spark = fresh.sparkSession
    size = fresh.groupBy("id").agg(F.max("n_places").alias("by"), F.max("n_lexemes").alias("more"), F.coalesce(F.sum(F.size("places")), F.lit(0)).alias("told"))
    held = read(spark, path, ids=size.select("id")).groupBy("id").agg(F.max("n_lexemes").alias("had"), F.sum(F.size("places")).alias("held"))
    # a document's lexemes have as many places as it says; more are those of rows that share an id
    sized = settled(size.join(held, "id", "left").select("id", "by", (F.coalesce("had", F.lit(0)) + F.col("more")).alias("n_lexemes"), ((F.col("told") > F.col("more")) | F.coalesce(F.col("held") > F.col("had"), F.lit(False))).alias("shared")))
    front = fresh.filter("lexeme IS NOT NULL").select("id", "lexeme", "places", "weights")
    if front.limit(R.BROADCAST_ROWS + 1).count() > R.BROADCAST_ROWS:
        return write(_grouped(fresh, path, size.select("id")), path)
    single, shared = (F.broadcast(sized.filter(x).select("id", "by", "n_lexemes")) for x in ("NOT shared", "shared"))
    put = front.join(single, "id").select("id", "lexeme", F.col("places").alias("fp"), F.col("weights").alias("fw"), F.col("n_lexemes").alias("n"))
    few = [r[0] for r in front.select("lexeme").distinct().limit(_FEW + 1).collect()]
    met = settled(read(spark, path, few if len(few) <= _FEW else None, single.select("id")).select("id", "lexeme").join(F.broadcast(put.select("id", "lexeme")), ["id", "lexeme"], "left_semi"))
    moved = read(spark, path, ids=single.select("id")).drop("n_lexemes").join(single, "id").join(F.broadcast(put.drop("n")), ["id", "lexeme"], "left")
    after = lambda name, own: F.when(F.col(name).isNull(), own).otherwise(F.concat(name, own))
    out = moved.select("id", "lexeme", after("fp", F.expr("transform(places, p -> p + by)")).alias("places"), after("fw", F.col("weights")).alias("weights"), "n_lexemes")
    out = out.unionByName(put.join(met, ["id", "lexeme"], "left_anti").select("id", "lexeme", F.col("fp").alias("places"), F.col("fw").alias("weights"), F.col("n").alias("n_lexemes")))
    none = single.filter("n_lexemes = 0").select("id", F.lit(None).cast("string").alias("lexeme"), F.lit(None).cast("array<int>").alias("places"), F.lit(None).cast("array<double>").alias("weights"), "n_lexemes")
    out = out.unionByName(none)
    if not sized.filter("shared").isEmpty():
        out = out.unionByName(_grouped(fresh.join(shared.select("id"), "id", "left_semi"), path, shared.select("id")))
    write(out, path)


def _grouped(fresh: DataFrame, path: str, ids: DataFrame) -> DataFrame:
    """The rows after fresh vectors were put before, by gathering all of a lexeme: for ids that rows share, and texts too long to be broadcast."""
    size = fresh.select("id", F.col("n_places").alias("by"), F.col("n_lexemes").alias("more")).distinct()
    old = read(fresh.sparkSession, path, ids=ids).join(R.bounded(size), "id")
    moved = old.select("id", "lexeme", F.expr("transform(places, p -> p + by)").alias("places"), "weights", F.col("n_lexemes").alias("n"))
    both = fresh.filter("lexeme IS NOT NULL").select("id", "lexeme", "places", "weights", F.lit(0).alias("n")).unionByName(moved)
    one = both.groupBy("id", "lexeme").agg(F.sort_array(F.collect_list(F.struct("places", "weights"))).alias("x"), F.max("n").alias("n"))
    total = both.groupBy("id").agg(F.max("n").alias("had"))
    sized = size.join(total, "id", "left").select("id", (F.coalesce("had", F.lit(0)) + F.col("more")).alias("n_lexemes"))
    return sized.join(one, "id", "left").select("id", "lexeme", F.expr("flatten(x.places)").alias("places"), F.expr("flatten(x.weights)").alias("weights"), "n_lexemes")


def query_words(queries: DataFrame, config: str = "english") -> DataFrame:
    """query_id, lexeme: the different lexemes of each query."""
    if config == "english":
        return R.query_lexemes(queries)

    @F.arrow_udf("array<string>")
    def words(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(set(X.LEXEME.findall((x or "").lower()))) for x in texts.to_pylist()], pa.list_(pa.string()))

    return queries.select("query_id", F.explode(words(F.col("query").cast("string"))).alias("lexeme"))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = V.CANDIDATES, config: str = "english") -> DataFrame:
    """query_id, id, score, rank from the stored vectors: what ``retrieval.sparse_search`` finds in the texts.

    While the queries' lexemes are few, only their buckets are read. Their postings go to the task of their row once, however many queries
    ask for them, and a task puts out its k best of each query. More terms than can be broadcast meet the postings by a shuffled join.
    """
    wanted = query_words(queries, config)
    rows = wanted.limit(R.BROADCAST_ROWS + 1).collect()
    lexemes = list(dict.fromkeys(r["lexeme"] for r in rows))
    few = lexemes if len(lexemes) <= _FEW else None
    if len(rows) > R.BROADCAST_ROWS:
        return R.top(R.cover_density(read(spark, path).join(wanted, "lexeme")), k)
    number = F.broadcast(spark.createDataFrame(list(enumerate(lexemes)), "at int, lexeme string"))
    # a place and its weight are one number on the way
    which = lambda w: F.array_position(F.lit(_WEIGHTS), w).cast("int")
    marks = F.zip_with("places", "weights", lambda p, w: F.when(which(w) > 0, p * len(_WEIGHTS) + which(w) - 1).otherwise(F.raise_error(F.lit("no such weight"))))
    parts = []
    for segment, own, ids in _segments(spark, path, few):
        parts.append(own.join(number, "lexeme").select("id", F.lit(segment).alias("segment"), "at", marks.alias("marks"), "n_lexemes"))
        parts.append(ids.select("id", F.lit(segment).alias("segment"), F.lit(-1).alias("at"), F.lit(None).cast("array<int>").alias("marks"), F.lit(0).alias("n_lexemes")))
    stored = reduce(DataFrame.unionByName, parts[:-1])  # the oldest segment replaces nothing
    return R.top(_scored(stored, rows, {x: i for i, x in enumerate(lexemes)}, wanted.schema["query_id"].dataType.simpleString(), k), k)


def _scored(stored: DataFrame, wanted: list, number: dict[str, int], kind: str, k: int) -> DataFrame:
    """query_id, id, score by cover density. stored: id, segment, at (the lexeme's number, -1 where the segment but speaks for the id), marks, n_lexemes; of an id the newest segment counts."""
    ids = list(dict.fromkeys(r["query_id"] for r in wanted))
    of = {q: i for i, q in enumerate(ids)}
    asked: dict[int, list[int]] = {}
    for q, at in dict.fromkeys((of[r["query_id"]], number[r["lexeme"]]) for r in wanted):
        asked.setdefault(at, []).append(q)
    shared = stored.sparkSession.sparkContext.broadcast((asked, ids))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, ids = shared.value
        best = R._Best(len(ids), k)
        query, name, value = [], [], []

        def told(row, n: int, hits: list[tuple[int, int]]) -> None:
            covers: dict[int, list[float]] = {}  # by query: weights, covers, inverse gaps, the last place
            for mark, at in sorted(hits):
                place, weight = mark // len(_WEIGHTS), _WEIGHTS[mark % len(_WEIGHTS)]
                for q in asked[at]:
                    c = covers.get(q)
                    if c is None:
                        covers[q] = [weight, 1, 0.0, place]
                    else:
                        c[0] += weight
                        c[1] += 1
                        if place > c[3]:
                            c[2] += 1 / (place - c[3])
                        c[3] = place
            for q, (w, many, gaps, _) in covers.items():
                r = w / math.log(n + 1.0)
                r = r * gaps / many if gaps else r
                query.append(q)
                name.append(row)
                value.append(round(r / (r + 1), 12))

        def put(type_: pa.DataType) -> None:
            best.put(np.array(query, np.int64), pa.array(name, type_).to_numpy(zero_copy_only=False), np.array(value, np.float64))
            for x in (query, name, value):
                x.clear()

        row, newest, n, hits = None, None, 0, []
        for batch in batches:
            for own, segment, at, marks, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != row or newest is None:
                    told(row, n, hits)
                    row, newest, hits = own, segment, []
                if at >= 0 and (segment == newest or own is None):
                    n = size
                    hits.extend((mark, at) for mark in marks)
            if len(query) >= R._HITS:
                put(batch.schema.field(0).type)
        told(row, n, hits)
        if newest is not None:
            put(batch.schema.field(0).type)
        yield from best.batches(pa.array(ids).to_numpy(zero_copy_only=False))

    own_kind = dict(stored.dtypes)["id"]
    return stored.repartition("id").sortWithinPartitions("id", F.desc("segment")).mapInArrow(score, f"query_id {kind}, id {own_kind}, score double")


#: Lexemes up to which a search names them in the scan's filter.
_FEW = 5000


def update_rows(table: DataFrame, changes: DataFrame, path: str | None, fields: dict[str, str], hashed: str, config: str = "english", key: str = "id") -> DataFrame:
    """table with the values of changes (key and some of its columns; nulls change nothing), content_hash of what ``hashed`` holds afterwards, and, with a path, new search vectors of the changed rows.

    Changes of keys that aren't there do nothing; of repeated ones in changes any one counts. Rows that repeat a key are all changed.
    """
    own = [c for c in changes.columns if c != key and c in table.columns]
    new = changes.dropDuplicates([key]).select(key, *[F.col(c).alias(f"__{c}") for c in own], F.lit(True).alias("__there"))
    after = table.join(R.bounded(new), key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in own})
    after = after.withColumn("content_hash", F.when(F.col("__there"), X.content_hash(F.coalesce(hashed, F.lit("")))).otherwise(F.col("content_hash") if "content_hash" in table.columns else F.lit(None)))
    if path is not None:
        write(vectors(after.filter("__there"), fields, config, key), path)
    names = [*table.columns, *([] if "content_hash" in table.columns else ["content_hash"])]
    return after.select(*names)
