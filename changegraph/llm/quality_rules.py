"""Quality rules: counts of words, symbols and repeats, and n-gram perplexity by language.

The language model has character 5-grams over all code points. Spark counts the 5-grams of
all documents by language; counts of lower orders are continuation counts, and modified
Kneser-Ney smoothing (three discounts an order, from the counts of counts) gives the
interpolated probabilities, an order at a time, each in joins on the n-gram.

No task and no driver holds the model. The documents are dealt into groups of about
``group_chars`` characters; a group asks for the 5-grams that it has, in order and packed by
ranges of their hashes, and is sent packed probabilities in that order, eight bytes a 5-gram
each way. It builds arrays of 64-bit hashes sorted for search, which score its whole texts in
vectorised passes. As the model is counted over these same documents,
every 5-gram asked for is in it.

Of the documents that pass the basic rules, quartiles of mean log perplexity by language and
length (powers of two) make a band: documents outside [q1 - width * iqr, q3 + width * iqr] are
rejected, for being too predictable or too strange. Languages and lengths with fewer than
``least_docs`` documents take the band of their length in all languages or, if that has too
few as well, that of all documents.

Defined results: a null text has no words and fails. Documents without a 5-gram, and tables of
fewer than ``least_docs`` documents to take a band from, have no perplexity verdict and
are kept unless a basic rule fails. A null language is a language of its own. Rows with the
same id are judged each. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changegraph.llm.text import Chunk, chunks, discard, materialise, mix64, n_groups, release, window_hashes

ORDER = 5
#: A code point has 21 bits: two make ``hi`` and three ``lo`` of a 5-gram, the last ones lowest.
BITS = 21
#: About so many bytes of text go into one compressed piece of a group.
PIECE_BYTES = 4 << 20
#: A range of hashes is so narrow that all groups together ask for at most about so many 5-grams of it.
RANGE_ASKS = 8_000_000
#: Up to so many languages, their discounts are sent to all tasks; beyond, they are joined by shuffle.
BROADCAST_LANGUAGES = 10_000

_PLACE = mix64(np.arange(1, ORDER + 1, dtype=np.uint64)) | np.uint64(1)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def base_counts(c: Chunk) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document."""
    lead = (c.data & 0xC0) != 0x80
    out = {"n_words": np.diff(c.word_bounds), "word_chars": c.sums(lead & c.inside), "n_symbols": c.sums(_SYMBOL[c.data])}

    cuts = np.flatnonzero(c.data == 10)
    begin = np.sort(np.concatenate([c.bounds[:-1], cuts + 1]))
    end = np.sort(np.concatenate([c.bounds[1:], cuts]))
    filled = np.concatenate([[0], np.cumsum(c.inside)])
    ok = filled[end] > filled[begin]
    begin, end = begin[ok], end[ok]
    of = np.searchsorted(c.bounds, begin, side="right") - 1
    line = mix64(c.span_hashes(begin, end) ^ mix64(of.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(line, kind="stable")
    again = line[order][1:] == line[order][:-1]
    out["n_dup_lines"] = np.bincount(of[order][1:][again], minlength=c.n)

    doc = c.word_docs()
    at = np.flatnonzero(c.window_ok(8))
    w = window_hashes(c.word_hashes(), 8)[at]
    w = mix64(w ^ mix64(doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    twice = np.zeros(len(w), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(doc) + 1, dtype=np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + 8, -1)
    out["n_repeat_words"] = np.bincount(doc, weights=np.cumsum(step[:-1]) > 0, minlength=c.n).astype(np.int64)
    return out


def _points(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all documents of a chunk, and where each document's begin."""
    lead = (c.data & 0xC0) != 0x80
    bounds = np.concatenate([[0], np.cumsum(lead)])[c.bounds]
    return np.frombuffer(c.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4").astype(np.uint64), bounds


def ngrams(c: Chunk, languages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the 5-grams of all documents: a key (a hash of the 5-gram and its language), the first position; and how many each document has.

    ``languages`` has a 64-bit number a document. Positions are those of ``_points``."""
    points, bounds = _points(c)
    n = len(points) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(c.n, np.int64)
    size = np.diff(bounds)
    ok = np.ones(n, dtype=bool)
    for k in range(1, ORDER):  # the last four of each document begin no 5-gram
        last = bounds[1:] - k
        ok[last[(last >= 0) & (last < n)]] = False
    with np.errstate(over="ignore"):
        total = np.repeat(languages, size)[:n]
        for k in range(ORDER):
            total += points[k : n + k] * _PLACE[k]
    return mix64(total[ok]), np.flatnonzero(ok), np.maximum(size - ORDER + 1, 0)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and how often each occurs."""
    s = np.sort(key)
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[first], np.diff(np.append(first, len(s)))


def _places(key: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """A place of each distinct key in ``key``, by a table over the first bits; keys that share an entry are sorted."""
    shift = np.uint64(42)
    entry = (key >> shift).astype(np.int64)
    table = np.zeros(1 << 22, dtype=np.int32)
    table[entry] = np.arange(len(key), dtype=np.int32)
    at = table[(distinct >> shift).astype(np.int64)]
    other = np.flatnonzero(key[at] != distinct)
    if len(other):
        shared = np.zeros(1 << 22, dtype=bool)
        shared[(distinct[other] >> shift).astype(np.int64)] = True
        some = np.flatnonzero(shared[entry])
        some = some[np.argsort(key[some])]
        at[other] = some[np.searchsorted(key[some], distinct[other])]
    return at


def _language_key(lang: Column) -> Column:
    """Languages as names; a null one has a name that no other has."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def _numbers(names: list[str]) -> np.ndarray:
    known = {x: xxhash.xxh64_intdigest(x.encode()) for x in set(names)}
    return np.array([known[x] for x in names], dtype=np.uint64)


def count_ngrams(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, hi, lo, key, c): how often each 5-gram occurs in all documents of a language; tasks send partial counts."""

    def count(batches):
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def merged():
            key, lang, hi, lo, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            own = order[first]
            return key[first], lang[own], hi[own], lo[own], np.add.reduceat(n[order], first)

        for batch in batches:
            texts = batch["lang"].to_pylist()
            numbers, langs = _numbers(texts), np.array([names.setdefault(x, len(names)) for x in texts], dtype=np.int32)
            for c in chunks(batch["text"]):
                own = slice(c.first, c.first + c.n)
                key, at, n_own = ngrams(c, numbers[own])
                if not len(key):
                    continue
                distinct, n = _distinct(key)
                place = _places(key, distinct)
                points, _ = _points(c)
                p = at[place]
                lang = langs[own][np.searchsorted(np.cumsum(n_own), place, side="right")]
                hi = (points[p] << np.uint64(BITS)) | points[p + 1]
                lo = (points[p + 2] << np.uint64(2 * BITS)) | (points[p + 3] << np.uint64(BITS)) | points[p + 4]
                held.append((distinct, lang, hi, lo, n))
                size += len(distinct)
                if size > 4_000_000:
                    held = [merged()]
                    size = 2 * len(held[0][0])
        if held:
            key, lang, hi, lo, n = merged()
            known = pa.array(list(names), pa.string())
            for i in range(0, len(key), 100_000):
                own = slice(i, i + 100_000)
                text = pa.DictionaryArray.from_arrays(pa.array(lang[own]), known).cast(pa.string())
                yield pa.RecordBatch.from_arrays([text, *(pa.array(x[own].view(np.int64)) for x in (hi, lo, key)), pa.array(n[own].astype(np.int64))], names=["lang", "hi", "lo", "key", "c"])
        held = []
        release()

    rows = docs.select(_language_key(F.col(lang_col).cast("string")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    parts = rows.mapInArrow(count, "lang string, hi long, lo long, key long, c long")
    return parts.groupBy("lang", "hi", "lo").agg(F.min("key").alias("key"), F.sum("c").alias("c"))


def _suffix(order: int) -> tuple[Column, Column]:
    """The last ``order`` code points of an n-gram, as hi and lo."""
    hi, lo = F.col("hi"), F.col("lo")
    return (hi.bitwiseAND((1 << BITS * (order - 3)) - 1) if order > 3 else F.lit(0).cast("long"), lo.bitwiseAND((1 << BITS * min(order, 3)) - 1))


def _context() -> tuple[Column, Column]:
    """An n-gram without its last code point, as hi and lo."""
    hi, lo = F.col("hi"), F.col("lo")
    return F.shiftright(hi, BITS), F.shiftright(lo, BITS).bitwiseOR(F.shiftleft(hi.bitwiseAND((1 << BITS) - 1), 2 * BITS))


def _discount(c: Column) -> Column:
    return F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, hi, lo, key, logp) of the n-grams of the highest order, by interpolated modified Kneser-Ney.

    Each order's counts and probabilities are written before the next one reads them, and deleted when it is written."""
    count = {order: counts}
    for n in range(order - 1, 0, -1):
        hi, lo = _suffix(n)
        count[n] = materialise(count[n + 1].groupBy("lang", hi.alias("hi"), lo.alias("lo")).agg(F.count("*").alias("c")), f"count{n}")
    often = [F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    stats = None
    for n, table in count.items():
        part = table.groupBy("lang").agg(*often, F.count("*").cast("double").alias("size")).withColumn("n", F.lit(n))
        stats = part if stats is None else stats.unionByName(part)
    y = F.expr("n1 / greatest(n1 + 2 * n2, 1)")
    d = [F.greatest(F.lit(0.1), F.least(F.lit(k - 0.05), F.lit(float(k)) - (k + 1) * y * F.expr(f"n{k + 1} / greatest(n{k}, 1)"))).alias(f"d{k}") for k in (1, 2, 3)]
    stats = materialise(stats.select("n", "lang", "size", *d), "discounts")
    few = stats.where("n = 1").count() <= BROADCAST_LANGUAGES
    lower = None
    for n in range(1, order + 1):
        own = stats.where(F.col("n") == n).drop("n")
        rows = count[n].join(F.broadcast(own) if few else own, "lang")
        context_hi, context_lo = _context()
        context = Window.partitionBy("lang", "context_hi", "context_lo")
        rows = rows.withColumns({"context_hi": context_hi, "context_lo": context_lo})
        total = F.sum("c").over(context)
        first = F.greatest(F.col("c") - _discount(F.col("c")), F.lit(0.0)) / total
        rows = rows.withColumns({"first": first, "gamma": F.sum(_discount(F.col("c"))).over(context) / total})
        if lower is None:
            p = F.col("first") + F.col("gamma") / F.col("size")
        else:
            low_hi, low_lo = _suffix(n - 1)
            below = lower.select("lang", F.col("hi").alias("low_hi"), F.col("lo").alias("low_lo"), F.col("p").alias("p_low"))
            rows = rows.withColumns({"low_hi": low_hi, "low_lo": low_lo}).join(below, ["lang", "low_hi", "low_lo"])
            p = F.col("first") + F.col("gamma") * F.col("p_low")
        keys = ["lang", "hi", "lo", "key"] if n == order else ["lang", "hi", "lo"]
        before, lower = lower, materialise(rows.select(*keys, (F.log(p) if n == order else p).alias("logp" if n == order else "p")), f"order{n}")
        for used in (before, count[n] if n < order else None):
            if used is not None:
                discard(used)
    return lower


CHANGED = "a 5-gram is not in the model: the documents changed between two readings"


class Model:
    """Hash arrays sorted for search: the 5-grams of a group with their log probabilities."""

    def __init__(self, key: np.ndarray, logp: np.ndarray):
        order = np.argsort(key)
        self.key, self.logp = key[order], logp[order]
        self.bits = max(1, int(len(key)).bit_length())
        edges = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.begin = np.searchsorted(self.key, edges).astype(np.int32)

    def log_probabilities(self, key: np.ndarray) -> np.ndarray:
        if not len(key):
            return np.zeros(0)
        at = self.begin[(key >> np.uint64(64 - self.bits)).astype(np.int64)] if len(self.key) else np.zeros(len(key), np.int32)
        last = len(self.key) - 1
        low = np.flatnonzero((self.key[np.minimum(at, last)] < key) & (at < last)) if last >= 0 else at[:0]
        while len(low):
            at[low] += 1
            low = low[(self.key[at[low]] < key[low]) & (at[low] < last)]
        if last < 0 or (self.key[np.minimum(at, last)] != key).any():
            raise ValueError(CHANGED)
        return self.logp[at]


def _pieces(docs: DataFrame, groups: int) -> DataFrame:
    """(g, piece): the documents in compressed pieces, dealt into groups by input partition."""
    schema = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("text", pa.string())])

    def pack(batches):
        g = TaskContext.get().partitionId() % groups
        codec = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        for batch in batches:
            for c in chunks(batch["text"], size=PIECE_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, schema, options=codec) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([batch[x].slice(c.first, c.n).cast(schema.field(x).type) for x in schema.names], schema=schema))
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["g", "piece"])
        release()

    return docs.mapInArrow(pack, "g int, piece binary").repartition(groups, "g")


def _unpacked(pieces):
    for piece in pieces:
        with pa.ipc.open_stream(piece.as_buffer()) as batches:
            yield from batches


def _keys(pieces, own: np.ndarray | None = None) -> np.ndarray:
    """The distinct keys of the 5-grams in pieces and of those before, in order."""
    own = np.zeros(0, np.uint64) if own is None else own
    for rows in _unpacked(pieces):
        numbers = _numbers(rows["lang"].to_pylist())
        own = _distinct(np.concatenate([own, *(_distinct(ngrams(c, numbers[c.first : c.first + c.n])[0])[0] for c in chunks(rows["text"]))]))[0]
    return own


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, model: DataFrame, groups: int) -> DataFrame:
    """(id, lang, basic counts, lm_sum, lm_n): the log probability and the number of a document's 5-grams."""
    pieces = _pieces(docs, groups)

    spark = docs.sparkSession
    bits = max(1, (max(4 * n_groups(spark), groups * model.count() // RANGE_ASKS) - 1).bit_length())

    def asked(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, piece in zip(batch["g"].to_pylist(), batch["piece"], strict=True):
                held[g] = _keys([piece], held.get(g))
        for g, key in held.items():
            ranges, begin = np.unique(key >> np.uint64(64 - bits), return_index=True)
            packed = [key[i:j].tobytes() for i, j in zip(begin, [*begin[1:], len(key)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ranges), g, dtype=np.int32)), pa.array(ranges.astype(np.int32)), pa.array(packed, pa.binary())], names=["g", "b", "keys"])
        release()

    told_schema = pa.schema([("g", pa.int32()), ("b", pa.int32()), ("logps", pa.binary())])

    def tell(left, right):
        known, logp = right["key"].to_numpy().view(np.uint64), right["logp"].to_numpy()
        order = np.argsort(known)
        known, logp, out = known[order], logp[order], []
        for packed in left["keys"].to_pylist():
            key = np.frombuffer(packed, dtype=np.uint64)
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            if not len(known) or (known[at] != key).any():
                raise ValueError(CHANGED)
            out.append(logp[at].tobytes())
        return pa.table([left["g"].cast(pa.int32()), left["b"].cast(pa.int32()), pa.array(out, pa.binary())], schema=told_schema)

    asks = pieces.mapInArrow(asked, "g int, b int, keys binary")
    known = model.select(F.shiftrightunsigned("key", 64 - bits).cast("int").alias("b"), "key", "logp")
    told = asks.groupBy("b").cogroup(known.groupBy("b")).applyInArrow(tell, "g int, b int, logps binary")
    schema = pa.schema([("id", pa.int64()), ("lang", pa.string()), *((k, pa.int64()) for k in COUNTS), ("lm_sum", pa.float64()), ("lm_n", pa.int64())])

    def scored(left, right):
        key, logp = _keys(left["piece"]), np.frombuffer(b"".join(right.sort_by("b")["logps"].to_pylist()), dtype=np.float64)
        if len(key) != len(logp):
            raise ValueError(CHANGED)
        model, out = Model(key, logp), []
        for rows in _unpacked(left["piece"]):
            names, cols = rows["lang"].to_pylist(), {k: [np.zeros(0, dtype=np.int64)] for k in (*COUNTS, "lm_n")}
            numbers, sums = _numbers(names), [np.zeros(0)]
            for c in chunks(rows["text"]):
                for k, v in base_counts(c).items():
                    cols[k].append(v.astype(np.int64))
                key, _, n = ngrams(c, numbers[c.first : c.first + c.n])
                cols["lm_n"].append(n)
                sums.append(np.bincount(np.repeat(np.arange(c.n), n), weights=model.log_probabilities(key), minlength=c.n))
            own = [np.concatenate(cols[k]) for k in COUNTS]
            out.append(pa.RecordBatch.from_arrays([rows["id"], rows["lang"], *map(pa.array, own), pa.array(np.concatenate(sums)), pa.array(np.concatenate(cols["lm_n"]))], schema=schema))
        release()
        return pa.Table.from_batches(out, schema=schema)

    kinds = "id long, lang string, " + ", ".join(f"{k} long" for k in COUNTS) + ", lm_sum double, lm_n long"
    return pieces.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(scored, kinds)


def _bands(usable: DataFrame, keys: list[str], least_docs: int, least_iqr: float, width: float) -> DataFrame:
    """(keys, low, high): the band of each group of documents that is large enough, from binned quartiles."""
    bins = usable.groupBy(*keys, F.floor(F.col("score") * 512).alias("bin")).agg(F.sum("k").alias("k"))
    upto = Window.partitionBy(*keys).orderBy("bin")
    bins = bins.withColumn("upto", F.sum("k").over(upto)).withColumn("all", F.sum("k").over(Window.partitionBy(*keys)))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) / 512
    bands = bins.groupBy(*keys).agg(at(0.25).alias("q1"), at(0.75).alias("q3"), F.max("all").alias("docs")).where(F.col("docs") >= least_docs)
    iqr = F.greatest(F.col("q3") - F.col("q1"), F.lit(least_iqr))
    return bands.select(*keys, (F.col("q1") - width * iqr).alias("low"), (F.col("q3") + width * iqr).alias("high"))


def _free_disk(spark: SparkSession) -> None:
    """Have the files of finished shuffles deleted: Spark does so when the driver collects its garbage, which a short driver program may not do for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def judge_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    width: float = 2.0, least_iqr: float = 0.02, least_docs: int = 50, group_chars: int = 48_000_000,
) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, perplexity, kept) of each document."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), _language_key(F.col(lang_col).cast("string")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = materialise(count_ngrams(docs, lang_col, text_col), "counts")
    _free_disk(docs.sparkSession)
    all_chars = counts.agg(F.sum("c")).first()[0] or 0
    model = kneser_ney(counts)
    discard(counts)
    _free_disk(docs.sparkSession)
    measured = materialise(measure(rows, model, -(-all_chars // group_chars) or 1), "measured")
    discard(model)

    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    score = F.when(F.col("lm_n") > 0, -F.col("lm_sum") / F.col("lm_n"))
    judged = measured.withColumns({"base_failed": failed, "score": score, "size": F.floor(F.log2("lm_n")).cast("int")})
    usable = judged.where("NOT base_failed AND lm_n > 0").withColumns({"k": F.lit(1), "everything": F.lit(True)})
    usable = materialise(usable.groupBy("lang", "size", "everything", (F.floor(F.col("score") * 512) / 512).alias("score")).agg(F.sum("k").alias("k")), "scores")
    out = judged.withColumn("everything", F.lit(True))
    for i, keys in enumerate((["lang", "size"], ["size"], ["everything"])):
        bands = _bands(usable, keys, least_docs, least_iqr, width)
        few = bands.count() <= BROADCAST_LANGUAGES
        out = out.join(F.broadcast(bands) if few else bands, keys, "left").withColumnsRenamed({"low": f"low{i}", "high": f"high{i}"})
    low, high = (F.coalesce(*(f"{x}{i}" for i in range(3))) for x in ("low", "high"))
    inside = F.coalesce(F.col("score").between(low, high), F.lit(True))
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.exp("score").alias("perplexity"), (~F.col("base_failed") & inside).alias("kept"),
    )
