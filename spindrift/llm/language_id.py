"""Language identification by interpolated Kneser-Ney character models.

Texts become letters and single blanks, and runs of ``ORDER`` 16-bit code units
are counted per language over all training texts (one small row for each run,
language and task is shuffled). Lower orders come from the distinct runs, as
Kneser-Ney asks. Each order is one sorted array of packed runs beside a table
of log-probabilities by language, so a lookup is a binary search; a run that a
model hasn't seen falls to the next order with the context's back-off weight.
A text goes to the language of least cross-entropy per character.

Rejection is calibrated on the counts: under its own language's model a text of
n characters has a cross-entropy of mean mu and deviation sigma / sqrt(n), both
known from the training runs; a text ``REJECT_Z`` deviations and ``REJECT_SLACK``
nats above is marked rejected.

The model has a row for each distinct run and a cell in it for each language, counted
before they are collected. Up to ``MAX_CELLS`` cells the tables are broadcast; above,
the same tables of the same order stay on the cluster, and the distinct runs of the
texts are joined with them. Each language and order has a discount of its own.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small, text_of

ORDER = 4
#: Distinct runs of a language, times languages, that are collected and broadcast at most: about 40 bytes each.
MAX_CELLS = 8_000_000
REJECT_Z = 6.0
REJECT_SLACK = 0.5
_BLANK = np.uint16(32)


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Each code unit as its lower-case letter, a mark on a letter or half of a pair as itself, all else as a blank."""
    out = np.full(1 << 16, _BLANK, np.uint16)
    for u in range(1 << 16):
        c = chr(u)
        if 0xD800 <= u < 0xE000:
            out[u] = u
        elif unicodedata.category(c)[0] in "LM":
            low = c.lower()
            out[u] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else u
    return out


def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code units of all texts, blanks single, a blank before and after each; and where each text begins."""
    raw = [(" " + t + " ").encode("utf-16-le", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) // 2 for r in raw])
    folded = _fold()[np.frombuffer(b"".join(raw), "<u2")]
    begin = np.zeros(len(folded), bool)
    begin[np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(raw)]] = True
    keep = (folded != _BLANK) | begin
    keep[1:] |= folded[:-1] != _BLANK
    return folded[keep], np.flatnonzero(begin[keep])


def runs(flat: np.ndarray, order: int) -> np.ndarray:
    """The run of ``order`` units that ends at each place, packed; the first places have blanks before."""
    out = np.zeros(len(flat), np.uint64)
    padded = np.concatenate([np.full(order - 1, _BLANK, np.uint16), flat]).astype(np.uint64)
    for k in range(order):
        out = (out << np.uint64(16)) | padded[k : k + len(flat)]
    return out


def _runs_of(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs, and the text of each; without each text's leading blank, and with blanks for what stands before it."""
    flat, begin = units(texts)
    got = runs(flat, order)
    owner = np.zeros(len(flat), np.int64)
    owner[begin[1:]] = 1
    owner = np.cumsum(owner)
    place = np.arange(len(flat)) - begin[owner]
    for short in range(1, order - 1):  # units of the text before must not show
        near = place == short
        mask = np.uint64((1 << (16 * (short + 1))) - 1)
        fill = np.uint64(sum(32 << (16 * k) for k in range(short + 1, order)))
        got[near] = (got[near] & mask) | fill
    real = place > 0
    return got[real], owner[real]


def count_runs(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """lang, run, n over all rows of docs with a language."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            run, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return run, np.bincount(at, np.concatenate([p[1] for p in parts]), len(run)).astype(np.int64)

        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                got, _ = _runs_of(texts.tolist(), order)
                run, n = np.unique(got, return_counts=True)
                parts = held.setdefault(lang, [])
                parts.append((run, n))
                if len(parts) == 16:
                    held[lang] = [merged(parts)]
        for lang, parts in held.items():
            run, n = merged(parts)
            for at in range(0, len(run), 1 << 16):
                yield pd.DataFrame({"lang": lang, "run": run[at : at + (1 << 16)].view(np.int64), "n": n[at : at + (1 << 16)]})

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text")).filter("lang IS NOT NULL")
    return rows.mapInPandas(count, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))


def _discount(once: int, twice: int) -> float:
    """Kneser-Ney's absolute discount from how many runs were counted once and twice."""
    return min(0.9, max(0.1, once / (once + 2 * twice) if once + twice else 0.5))


class Models:
    """Log-probabilities of all languages, an order after the other, from the highest."""

    def __init__(self, counts: pd.DataFrame, order: int):
        self.langs = sorted(counts["lang"].unique())
        self.order = order
        self.keys, self.logp, self.back = [], [], []  # by order: runs, log p (nan: not seen), contexts' back-off
        number = {x: i for i, x in enumerate(self.langs)}
        code = counts["lang"].map(number).to_numpy(np.int64)
        run, n = counts["run"].to_numpy(np.int64).view(np.uint64), counts["n"].to_numpy(np.float64)
        top_run, top_code, top_n = run, code, n
        tables = []
        for k in range(order, 0, -1):
            tables.append((run, code, n))
            shorter = run & np.uint64((1 << (16 * (k - 1))) - 1)  # the same end without its first unit
            pair = np.stack([code.astype(np.uint64), shorter], axis=1)
            if k > 1:  # how many different units stand before it
                pair, n = np.unique(pair, axis=0, return_counts=True)
                code, run, n = pair[:, 0].astype(np.int64), pair[:, 1].copy(), n.astype(np.float64)
        self.units = max(1, len(np.unique(tables[-1][0])))
        lower = None  # (keys, p by language) of the order below, with back-offs applied
        made = []
        for k, (run, code, n) in zip(range(1, order + 1), tables[::-1], strict=True):
            discount = np.array([_discount(a, b) for a, b in zip(*(np.bincount(code[n == x], minlength=len(self.langs)) for x in (1, 2)), strict=True)])
            contexts, at = np.unique(run >> np.uint64(16), return_inverse=True)
            total, kinds = np.zeros((len(contexts), len(self.langs))), np.zeros((len(contexts), len(self.langs)))
            np.add.at(total, (at, code), n)
            np.add.at(kinds, (at, code), 1)
            gamma = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            keys, place = np.unique(run, return_inverse=True)
            p = np.zeros((len(keys), len(self.langs)))
            of = np.searchsorted(contexts, keys >> np.uint64(16))
            p[place, code] = np.maximum(n - discount[code], 0) / total[at, code]
            if lower is None:
                below = np.full(p.shape, 1.0 / (self.units + 1))
            else:
                below = lower[1][np.searchsorted(lower[0], keys & np.uint64((1 << (16 * (k - 1))) - 1))]
            p += gamma[of] * below
            lower = (keys, p)
            made.append((keys, np.log(p).astype(np.float32), contexts, np.log(gamma).astype(np.float32)))
        self.tables = made[::-1]
        # What a training run costs under its own language, for the calibration.
        cost = -made[-1][1][np.searchsorted(made[-1][0], top_run), top_code]
        weight = np.bincount(top_code, top_n, len(self.langs))
        self.mean = np.bincount(top_code, top_n * cost, len(self.langs)) / weight
        self.dev = np.sqrt(np.maximum(0, np.bincount(top_code, top_n * cost**2, len(self.langs)) / weight - self.mean**2))

    def cost(self, run: np.ndarray) -> np.ndarray:
        """Minus log p of each run's last unit after the others, by language."""
        out = np.zeros((len(run), len(self.langs)), np.float32)
        left = np.arange(len(run))
        for k, (keys, logp, contexts, back) in zip(range(self.order, 0, -1), self.tables, strict=True):
            own = run[left] & np.uint64((1 << (16 * k)) - 1)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            seen = keys[at] == own
            out[left[seen]] -= logp[at[seen]]
            left, own = left[~seen], own[~seen]
            if not len(left):
                return out
            context = own >> np.uint64(16)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            known = contexts[at] == context
            out[left[known]] -= back[at[known]]
        out[left] += np.float32(np.log(self.units + 1))  # a unit never seen
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean cost by text and language, and the characters of each text."""
        mean, size = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        if texts:
            run, owner = _runs_of(texts, self.order)
            if len(run):
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                total = np.zeros((len(first), len(self.langs)))
                step = 1 << 20
                for at in range(0, len(run), step):
                    part, cost = owner[at : at + step], self.cost(run[at : at + step])
                    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                    sums = np.add.reduceat(cost.astype(np.float64), cuts, axis=0)
                    total[np.searchsorted(owner[first], part[cuts])] += sums
                n = np.diff(np.concatenate([first, [len(run)]]))
                mean[owner[first]], size[owner[first]] = total / n[:, None], n
        return mean, size


def _last(run: Column, k: int, order: int) -> Column:
    """The last k units of a packed run of that order."""
    return run if k == order else run.bitwiseAND(F.lit((1 << (16 * k)) - 1))


class SharedModels:
    """What Models has, as one table an order (run, logp by language) and one of its contexts (context, back), on the cluster."""

    def __init__(self, counts: DataFrame, order: int):
        self.order = order
        self.langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
        self.codes = F.array(*[F.lit(i) for i in range(len(self.langs))])
        named = F.array_position(F.array(*[F.lit(x) for x in self.langs]), F.col("lang")).cast("int") - 1
        tables = {order: counts.select(named.alias("code"), "run", F.col("n").cast("double").alias("n"))}
        for k in range(order - 1, 0, -1):  # how many different units stand before it
            tables[k] = cut(tables[k + 1].groupBy("code", _last(F.col("run"), k, order).alias("run")).agg(F.count("*").cast("double").alias("n")))
        self.units = max(1, tables[1].select("run").distinct().count())
        self.keys, self.contexts = {}, {}
        lower = None
        for k in range(1, order + 1):
            t = tables[k].withColumn("context", F.shiftrightunsigned("run", 16))
            few = {r["code"]: _discount(r["a"], r["b"]) for r in t.groupBy("code").agg(F.count_if(F.col("n") == 1).alias("a"), F.count_if(F.col("n") == 2).alias("b")).collect()}
            discount = F.array(*[F.lit(few.get(i, 0.5)) for i in range(len(self.langs))])
            sums = t.groupBy("context", "code").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
            sums = sums.withColumn("gamma", F.get(discount, F.col("code")) * F.col("kinds") / F.col("total"))
            contexts = self._by_lang(sums, "context", total=0.0, gamma=1.0)
            self.contexts[k] = cut(contexts.withColumn("back", F.transform("gamma", lambda g: F.log(g).cast("float"))))
            rows = self._by_lang(t, "run", n=0.0).withColumn("context", F.shiftrightunsigned("run", 16)).join(small(self.contexts[k]), "context")
            if lower is None:
                rows = rows.withColumn("below", F.transform(self.codes, lambda _: F.lit(1.0 / (self.units + 1))))
            else:
                rows = rows.withColumn("suffix", _last(F.col("run"), k - 1, order)).join(small(lower.select(F.col("run").alias("suffix"), F.col("p").alias("below"))), "suffix")
            own = lambda i: F.when(F.get("n", i) > 0, F.greatest(F.get("n", i) - F.get(discount, i), F.lit(0.0)) / F.get("total", i)).otherwise(0.0)  # noqa: E731, B023
            p = F.transform(self.codes, lambda i: own(i) + F.get("gamma", i) * F.get("below", i))  # noqa: B023
            lower = cut(rows.select("run", "n", p.alias("p")).withColumn("logp", F.transform("p", lambda x: F.log(x).cast("float"))))
            self.keys[k] = lower
        # What a training run costs under its own language, for the calibration.
        seen = lower.select(F.posexplode(F.arrays_zip("n", "logp")).alias("code", "x")).filter("x.n > 0")
        n, cost = F.col("x.n"), -F.col("x.logp").cast("double")
        found = {r["code"]: r for r in seen.groupBy("code").agg(F.sum(n).alias("w"), F.sum(n * cost).alias("s"), F.sum(n * cost * cost).alias("q")).collect()}
        w, s, q = (np.array([found[i][c] for i in range(len(self.langs))]) for c in "wsq")
        self.mean = s / w
        self.dev = np.sqrt(np.maximum(0, q / w - self.mean**2))

    def _by_lang(self, rows: DataFrame, key: str, **columns: float) -> DataFrame:
        """key and, for each column, an array by language; the value given stands for languages without a row."""
        held = rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("code", F.struct(*columns)))).alias("m"))
        at = lambda c, v: F.transform(self.codes, lambda i: F.coalesce(F.try_element_at("m", i)[c], F.lit(v))).alias(c)
        return held.select(key, *[at(c, v) for c, v in columns.items()])

    def cost(self, wanted: DataFrame) -> DataFrame:
        """run, cost: minus log p of each run's last unit after the others, an array by language. wanted: distinct runs."""
        less = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
        out = wanted.withColumns({"cost": F.transform(self.codes, lambda _: F.lit(0.0).cast("float")), "seen": F.lit(False)})
        for k in range(self.order, 0, -1):
            own = _last(F.col("run"), k, self.order)
            out = out.withColumns({"own": own, "context": F.shiftrightunsigned(own, 16)})
            out = out.join(small(self.keys[k].select(F.col("run").alias("own"), "logp")), "own", "left")
            out = out.join(small(self.contexts[k].select("context", "back")), "context", "left")
            cost = F.when(F.col("seen"), F.col("cost")).when(F.col("logp").isNotNull(), less("cost", "logp")).when(F.col("back").isNotNull(), less("cost", "back")).otherwise(F.col("cost"))
            out = out.select("run", cost.alias("cost"), (F.col("seen") | F.col("logp").isNotNull()).alias("seen"))
        never = float(np.float32(np.log(self.units + 1)))  # a unit never seen
        return out.select("run", F.when(F.col("seen"), F.col("cost")).otherwise(F.transform("cost", lambda x: x + F.lit(never).cast("float"))).alias("cost"))

    def score(self, docs: DataFrame, text_col: str) -> DataFrame:
        """text_md5, mean (cost by language), size (characters): a row for each different text with a letter."""
        order = self.order

        def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                batch = batch[[any(map(str.isalpha, t)) for t in batch["text"]]]
                for at in range(0, len(batch), 64):
                    part = batch.iloc[at : at + 64]
                    run, owner = _runs_of(part["text"].tolist(), order)
                    by = np.lexsort((run, owner))
                    run, owner = run[by], owner[by]
                    first = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])]))
                    n = np.diff(np.concatenate([first, [len(run)]]))
                    yield pd.DataFrame({"text_md5": part["text_md5"].to_numpy()[owner[first]], "run": run[first].view(np.int64), "n": n})

        text = F.col(text_col).cast("string")
        texts = docs.select(F.md5(text.cast("binary")).alias("text_md5"), text.alias("text")).filter("text IS NOT NULL").dropDuplicates(["text_md5"])
        held = texts.mapInPandas(spread, "text_md5 string, run long, n long")
        costs = self.cost(held.select("run").distinct())
        sums = [F.sum(F.col("n") * F.get("cost", F.lit(i)).cast("double")) for i in range(len(self.langs))]
        total = held.join(costs, "run").groupBy("text_md5").agg(F.sum("n").cast("double").alias("size"), F.array(*sums).alias("total"))
        return total.select("text_md5", F.transform("total", lambda x: x / F.col("size")).alias("mean"), "size")


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", order: int = ORDER, max_cells: int = MAX_CELLS) -> Models | SharedModels | None:
    """Models from all rows with a language, on the cluster if their tables have more than max_cells cells; None if there are no runs."""
    counts = cut(count_runs(docs, lang_col, text_col, order))
    n, langs = counts.agg(F.count("*"), F.count_distinct("lang")).first()
    if n * langs > max_cells:
        return SharedModels(counts, order)
    return Models(counts.toPandas(), order) if n else None


def _verdict(own: Models | SharedModels, mean: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """The language's number, score, cross-entropy and rejection of texts of that mean cost by language and size."""
    pick = mean.argmin(axis=1)
    low = mean[np.arange(len(pick)), pick]
    share = 1 / np.exp(-(mean - low[:, None]) * np.sqrt(size)[:, None]).sum(axis=1)
    over = low > own.mean[pick] + REJECT_SLACK + REJECT_Z * own.dev[pick] / np.sqrt(np.maximum(size, 1))
    return pick, share, low, over


_KIND = "struct<lang: string, score: double, cross_entropy: double, rejected: boolean>"


def _structs(own: Models | SharedModels | None, has: np.ndarray, mean: np.ndarray, size: np.ndarray) -> pa.Array:
    """The structs of all rows; mean and size are of the rows that ``has`` marks, in order."""
    lang, best, entropy, rejected = ["und"] * len(has), np.zeros(len(has)), np.zeros(len(has)), np.ones(len(has), bool)
    if own is not None and has.any():
        pick, best[has], entropy[has], rejected[has] = _verdict(own, mean, size)
        for row, i in enumerate(np.flatnonzero(has).tolist()):
            lang[i] = own.langs[pick[row]]
    return pa.StructArray.from_arrays([pa.array(lang), pa.array(best), pa.array(entropy), pa.array(rejected)], names=["lang", "score", "cross_entropy", "rejected"])


class _Calibration:
    """The part of SharedModels that tasks need."""

    def __init__(self, models: SharedModels):
        self.langs, self.mean, self.dev = models.langs, models.mean, models.dev


def _predict_shared(docs: DataFrame, models: SharedModels, text_col: str, out: str) -> DataFrame:
    """predict by joins: texts meet their scores by their hash."""
    own = _Calibration(models)

    @F.arrow_udf(_KIND)
    def struct(means: pa.Array, sizes: pa.Array) -> pa.Array:
        has = np.asarray(sizes.is_valid())
        mean = np.array([m for m in means.to_pylist() if m is not None], np.float64).reshape(-1, len(own.langs))
        return _structs(own, has, mean, np.array([x for x in sizes.to_pylist() if x is not None], np.float64))

    scores = models.score(docs, text_col).select(F.col("text_md5").alias("__md5"), F.col("mean").alias("__mean"), F.col("size").alias("__size"))
    found = docs.withColumn("__md5", F.md5(F.col(text_col).cast("string").cast("binary"))).join(scores, "__md5", "left")
    return found.select(*[c for c in docs.columns if c != out], struct("__mean", "__size").alias(out))


def predict(docs: DataFrame, models: Models | SharedModels | None, text_col: str = "text", out: str = "language") -> DataFrame:
    """docs with a struct of lang, score (0 to 1), cross_entropy and rejected; a column of that name is replaced.

    Null texts and texts without a letter, and all texts where nothing was
    learned, are "und" with score 0. Languages that tie go to the first by name.
    score is the share of the chosen language in the likelihoods, tempered to ``n ** 0.5`` characters.
    """
    if isinstance(models, SharedModels):
        return _predict_shared(docs, models, text_col, out)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @F.arrow_udf(_KIND)
    def score(texts: pa.Array) -> pa.Array:
        own = shared.value
        held = [t or "" for t in texts.to_pylist()]
        has = np.array([any(map(str.isalpha, t[:64])) or any(map(str.isalpha, t)) for t in held], bool)
        mean, size = own.score([t for t, h in zip(held, has, strict=True) if h]) if own is not None else (None, None)
        return _structs(own, has, mean, size)

    return docs.select(*[c for c in docs.columns if c != out], score(F.col(text_col).cast("string")).alias(out))
