"""Toxicity by two Kneser-Ney models, one learnt from toxic and one from ordinary texts.

A word's likelihood under a class is the product of its letters', each given the four before it
(interpolated Kneser-Ney). Only the longest contexts are counted per class; everything below, the
continuation counts of shorter contexts, is shared by both classes, so an expression that neither
class knows says nothing. A document is scored on length-normalised log-likelihood ratios: the mean
over its words, the mean over its strongest stretch of words, and its strongest words. A logistic
curve over these, fitted on labelled rows the models have not seen, turns them into 0 to 1.

Counts come from every labelled training text outside the curve's fold and are summed by Spark, each letter sequence by itself. Up to
BROADCAST_GRAMS sequences, the ratios are computed on the driver and sent to the workers. Beyond,
backoff and ratios are Spark aggregations, each distinct word is summed up by joins with their table,
and batches of distinct texts meet the values of their words by shuffle.

Labels are learnt from rows with crc32(doc_id as text) mod 5 in 1, 2, 3 (models) and 4 (curve); 0 is
held out. If fold 4 or the others lack a class, the curve takes the next of folds 3, 2, 1 that leaves
both classes on both sides, or else half of all ids by another hash. If nothing does (one toxic row),
the models learn from all four folds, and the likelihoods of the strongest stretch are compared with
the classes' shares instead. The curve's rows are sampled
by class and weighted back, so a rare class is not lost. Nulls: a null id is held out and never matches a label; a null or empty text has no words
and gets the curve's value at zero evidence; a null label is not learnt from. With no labelled
training rows of one class every document scores 0. If labels repeat an id, any toxic one counts. Very long
texts are scored whole, repeated rows alike; other columns play no part. Empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import stash
from .common import column_or_null, hold_memory, mix, parts_by_bytes, per_batch, powers, sizes_of, texts_of

FOLDS = 5
CURVE_FOLD = 4
ORDER = 5
LETTER_BITS = 21
# Letter sequences are broadcast up to this number (12 bytes each, and their contexts) and joined beyond.
BROADCAST_GRAMS = 1 << 20
DISCOUNT = 0.75
STRETCH = 12
# Rows of each class that the curve is fitted on, about, at most; a documented bound.
CURVE_ROWS = 20_000
# Training labels are broadcast up to so many rows, 16 bytes each, and joined by shuffle beyond.
BROADCAST_LABELS = 4_000_000
MEMORY_WORDS = 300_000
COUNTED_WORDS = 150_000
BATCH_BYTES = 1 << 20
# Texts that meet the values of their words together, when those are joined.
JOINED_BYTES = 4 << 20
FEATURES = 4
_KINDS = ", ".join(f"f{k} double" for k in range(FEATURES))
_TRIM = "".join(map(chr, range(33, 48))) + "".join(map(chr, range(58, 65))) + "[\\]^_`{|}~"


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the folds; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(FOLDS))


def plain(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(_TRIM)


def letter_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all letter sequences of the words (one row each), and the word of each."""
    pad = "\x02" * (ORDER - 1)
    joined = "".join(f"{pad}{w}\x03" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    first = np.cumsum(sizes + ORDER - 1) - sizes - (ORDER - 1)
    word = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)
    return np.lib.stride_tricks.sliding_window_view(codes, ORDER)[at] if len(at) else np.zeros((0, ORDER), np.uint32), word


def _hash(grams: np.ndarray) -> np.ndarray:
    """64-bit hash of sequences of letters."""
    h = np.zeros(len(grams), np.uint64)
    for i in range(grams.shape[1]):
        h += (grams[:, i].astype(np.uint64) + np.uint64(7)) * powers(i % 2, ORDER + 2)[i + 1]
    return mix(h)


def packed(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of five letters as two numbers, the first two letters and the last three."""
    letters, bits = grams.astype(np.int64), np.int64(LETTER_BITS)
    return (letters[:, 0] << bits) | letters[:, 1], (((letters[:, 2] << bits) | letters[:, 3]) << bits) | letters[:, 4]


def unpacked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    bits, low = LETTER_BITS, (1 << LETTER_BITS) - 1
    return np.stack([x >> bits, x & low, y >> 2 * bits, (y >> bits) & low, y & low], 1).astype(np.uint32)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic, fold) of documents with a label and an id that is not held out."""
    known = (
        labels.select(column_or_null(labels, "doc_id", "long").alias("label_id"), column_or_null(labels, "toxic", "int").alias("toxic"))
        .filter("label_id is not null and toxic is not null")
        .groupBy("label_id")
        .agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
        .withColumn("fold", fold_of(F.col("label_id")).cast("int"))
        .filter("fold != 0")
    )
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    texts = docs.select(column_or_null(docs, "doc_id", "long").alias("doc_id"), column_or_null(docs, "text", "string").alias("text"))
    return texts.filter("text is not null").join(known, F.col("doc_id") == F.col("label_id")).drop("label_id")


def gram_counts(rows: DataFrame) -> DataFrame:
    """Letter sequences of all words of the rows: x and y (packed letters), count in ordinary and in toxic texts."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            by_name = [Counter(), Counter()]
            for total, own in zip(by_name, counts):
                while own:
                    w, n = own.popitem()
                    total[plain(w)] += n
            names = sorted(by_name[0].keys() | by_name[1].keys())
            for i in range(0, len(names), 50_000):
                part = names[i : i + 50_000]
                grams, word = letter_grams(part)
                n = np.array([[by_name[0][w], by_name[1][w]] for w in part], np.int64)[word]
                x, y = packed(grams)
                order = np.lexsort((y, x))
                x, y = x[order], y[order]
                new = np.flatnonzero((np.diff(x, prepend=-1) != 0) | (np.diff(y, prepend=-1) != 0))
                total = np.add.reduceat(n[order], new, axis=0) if len(new) else n
                yield pa.record_batch([pa.array(c) for c in (x[new], y[new], total[:, 0], total[:, 1])], ["x", "y", "ordinary", "toxic"])

        for batch in batches:
            hold_memory("toxicity counts")
            toxic, column = batch.column("toxic").to_pylist(), batch.column("text")
            for a, b in parts_by_bytes(sizes_of(column), BATCH_BYTES):
                for text, label in zip(texts_of(column.slice(a, b - a)), toxic[a:b]):
                    counts[label].update(text.split())
                if len(counts[0]) + len(counts[1]) > COUNTED_WORDS:
                    yield from flush()
        if counts[0] or counts[1]:
            yield from flush()

    sent = rows.select("text", "toxic").mapInArrow(words, "x long, y long, ordinary long, toxic long")
    return sent.groupBy("x", "y").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _groups(grams: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense numbers of equal sequences, and how many there are."""
    names, number = np.unique(_hash(grams), return_inverse=True)
    return number, len(names)


def log_ratios(letters: np.ndarray, counts: np.ndarray, discount: float = DISCOUNT) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood ratio (toxic over ordinary) of each counted sequence, and of any other one after the same letters.

    ``letters``: distinct sequences, ``counts``: ordinary and toxic occurrences of each.
    """
    # Shared backoff, from single letters up: kinds of letters seen before a sequence.
    lower = np.full(len(letters), 1.0 / max(1, len(np.unique(letters[:, -1]))))
    for length in range(1, ORDER):
        tail, n = _groups(letters[:, -length:])
        longer, _ = _groups(letters[:, -length - 1 :])
        first = np.unique(longer, return_index=True)[1]  # each longer sequence once
        kinds = np.bincount(tail[first], minlength=n)
        context, m = _groups(letters[:, -length:-1])
        owner = np.zeros(n, np.int64)
        owner[tail] = context
        total = np.bincount(owner, weights=kinds, minlength=m)
        distinct = np.bincount(owner, minlength=m)
        lower = (np.maximum(kinds[tail] - discount, 0) + discount * distinct[context] * lower) / total[context]
    context, m = _groups(letters[:, :-1])
    logs, unseen = [], []
    for own in (counts[:, 0], counts[:, 1]):
        total = np.bincount(context, weights=own, minlength=m)
        distinct = np.bincount(context, weights=own > 0, minlength=m)
        left = np.where(total > 0, discount * distinct / np.maximum(total, 1), 1.0)
        seen = np.maximum(own - discount, 0) / np.maximum(total[context], 1)
        logs.append(np.log(seen + left[context] * lower))
        unseen.append(np.log(left))
    return logs[1] - logs[0], (unseen[1] - unseen[0])[context]


def _tail(length: int) -> list[Column]:
    """x and y of a packed sequence's last letters."""
    x, y = F.col("x"), F.col("y")
    x = x if length == ORDER else x.bitwiseAND(F.lit((1 << LETTER_BITS) - 1)) if length == 4 else F.lit(0).cast("long")
    return [x, y if length > 2 else y.bitwiseAND(F.lit((1 << length * LETTER_BITS) - 1))]


def ratio_tables(counts: DataFrame, discount: float = DISCOUNT) -> tuple[DataFrame, DataFrame]:
    """``log_ratios`` by Spark: (x, y, ratio) of counted sequences, (x, cy, other) of the letters before them."""
    context = F.shiftright("y", LETTER_BITS)
    kinds = {ORDER: counts}
    for length in range(ORDER - 1, 0, -1):
        x, y = _tail(length)
        kinds[length] = kinds[length + 1].groupBy(x.alias("x"), y.alias("y")).agg(F.count(F.lit(1)).alias("kinds"))

    def with_lower(table: DataFrame, length: int, lower: DataFrame) -> DataFrame:
        px, py = _tail(length)
        return table.withColumns({"px": px, "py": py}).join(lower.toDF("px", "py", "lower"), ["px", "py"])

    lower = None
    for length in range(1, ORDER):
        table = kinds[length].withColumn("cy", context)
        sums = table.groupBy("x", "cy").agg(F.sum("kinds").alias("total"), F.count(F.lit(1)).alias("distinct"))
        table = table.join(sums, ["x", "cy"])
        if lower is None:
            table = table.withColumn("lower", F.lit(1.0 / max(1, kinds[1].count())))
        else:
            table = with_lower(table, length - 1, lower)
        value = (F.greatest(F.col("kinds") - discount, F.lit(0.0)) + discount * F.col("distinct") * F.col("lower")) / F.col("total")
        lower = table.select("x", "y", value.alias("lower"))
    table = counts.withColumn("cy", context)
    names = ("ordinary", "toxic")
    sums = table.groupBy("x", "cy").agg(*[F.sum(c).alias(f"{c}_total") for c in names], *[F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in names])
    left = {c: F.when(F.col(f"{c}_total") > 0, discount * F.col(f"{c}_kinds") / F.col(f"{c}_total")).otherwise(1.0) for c in names}
    contexts = sums.select("x", "cy", *[left[c].alias(f"{c}_left") for c in names], *[F.greatest(f"{c}_total", F.lit(1)).alias(f"{c}_total") for c in names])
    contexts = stash(contexts.withColumn("other", F.log("toxic_left") - F.log("ordinary_left")), "toxicity-contexts")
    table = with_lower(table, ORDER - 1, lower).join(contexts, ["x", "cy"])
    logs = {c: F.log(F.greatest(F.col(c) - discount, F.lit(0.0)) / F.col(f"{c}_total") + F.col(f"{c}_left") * F.col("lower")) for c in names}
    ratios = stash(table.select("x", "y", (logs["toxic"] - logs["ordinary"]).alias("ratio")), "toxicity-ratios")
    return ratios, contexts.select("x", "cy", "other")


class _Sorted:
    """Values by hash of letters."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        self.keys, first = np.unique(_hash(grams), return_index=True)
        self.values = values[first].astype(np.float32)

    def get(self, grams: np.ndarray) -> np.ndarray:
        """Values of sequences; nan for others."""
        hashed = _hash(grams)
        at = np.minimum(np.searchsorted(self.keys, hashed), len(self.keys) - 1)
        return np.where(self.keys[at] == hashed, self.values[at], np.float32(np.nan))


@dataclass
class Models:
    """Log ratios of sequences and (for others) of their contexts; the curve."""

    seen: _Sorted
    context: _Sorted
    curve: np.ndarray | None = None
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def words(self, words: list[str]) -> np.ndarray:
        grams, word = letter_grams(words)
        ratio = self.seen.get(grams)
        other = np.isnan(ratio)
        ratio[other] = np.nan_to_num(self.context.get(grams[other][:, :-1]))
        return np.bincount(word, weights=ratio, minlength=len(words)).astype(np.float32)


@dataclass
class JoinedModels:
    """The same as tables that are joined, for any number of sequences."""

    seen: DataFrame
    context: DataFrame
    curve: np.ndarray | None = None

    def word_values(self, words: DataFrame) -> DataFrame:
        """(word, value) of distinct words."""

        def grams_of(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = batch.column("word").to_pylist()
            grams, word = letter_grams(words)
            return pa.record_batch([batch.column("word").take(pa.array(word)), *map(pa.array, packed(grams))], ["word", "x", "y"])

        grams = words.mapInArrow(per_batch(grams_of), "word string, x long, y long").withColumn("cy", F.shiftright("y", LETTER_BITS))
        found = grams.join(self.seen, ["x", "y"], "left").join(self.context, ["x", "cy"], "left")
        return found.groupBy("word").agg(F.sum(F.coalesce("ratio", "other", F.lit(0.0))).alias("value"))

    def evidence(self, texts: DataFrame) -> DataFrame:
        """(text_key, f0 to f3) of each distinct text."""
        total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        single = texts.filter("text is not null").select(F.md5("text").alias("text_key"), "text").dropDuplicates(["text_key"])
        dealt = single.withColumn("batch", F.pmod(F.xxhash64("text_key"), F.lit(1 + total // JOINED_BYTES)))

        def words_of(batch: pa.RecordBatch) -> pa.RecordBatch:
            column, numbers = batch.column("text"), batch.column("batch").to_pylist()
            found = {(n, plain(w)) for n, text in zip(numbers, texts_of(column)) for w in set(text.split())}
            numbers, words = zip(*found) if found else ((), ())
            return pa.record_batch([pa.array(numbers, pa.int64()), pa.array(words, pa.string())], ["batch", "word"])

        needed = dealt.select("batch", "text").mapInArrow(per_batch(words_of), "batch long, word string").distinct()
        values = self.word_values(needed.select("word").distinct())
        known = needed.join(values, "word").select("batch", F.lit(None).cast("string").alias("text_key"), F.col("word").alias("text"), "value")
        rows = known.unionByName(dealt.withColumn("value", F.lit(None).cast("double")))
        n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # Within a batch the words come first.
        ordered = rows.repartition(n, "batch").sortWithinPartitions("batch", F.col("text_key").asc_nulls_first())

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, known, memory = None, _Known(), {}
            for rows in batches:
                keys, numbers = rows.column("text_key").to_pylist(), rows.column("batch").to_pylist()
                texts, values = texts_of(rows.column("text")), rows.column("value").to_pylist()
                done, out = [], []
                for key, number, text, value in zip(keys, numbers, texts, values):
                    if number != at:
                        at, known, memory = number, _Known(), {}
                    if key is None:
                        known[text.decode()] = value
                    else:
                        done.append(key)
                        out.append(features(known, [text], memory)[0])
                if done:
                    out = np.stack(out)
                    yield pa.record_batch([pa.array(done), *[pa.array(out[:, k]) for k in range(FEATURES)]], ["text_key", *[f"f{k}" for k in range(FEATURES)]])

        return ordered.select("batch", "text_key", "text", "value").mapInArrow(measure, f"text_key string, {_KINDS}")


class _Known(dict):
    """Values of a batch's words."""

    def words(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.float32, len(words))


def fit_models(rows: DataFrame) -> Models | JoinedModels | None:
    """Both models from labelled rows; None if these have no words."""
    counts = stash(gram_counts(rows), "toxicity-grams")
    n = counts.count()
    if n > BROADCAST_GRAMS:
        return JoinedModels(*ratio_tables(counts))
    if not n:
        return None
    x, y, ordinary, toxic = (c.to_numpy() for c in counts.orderBy("x", "y").toArrow().columns)
    letters = unpacked(x, y)
    ratio, other = log_ratios(letters, np.stack([ordinary, toxic], 1))
    return Models(_Sorted(letters, ratio), _Sorted(letters[:, :-1], other))


_memories: dict[str, dict] = {}


def features(models: Models | _Known, texts: list[bytes], memory: dict) -> np.ndarray:
    """Length-normalised evidence of texts: mean, strongest stretch's mean, strongest words, share of strong words."""
    cut = [t.split() for t in texts]
    new = list({w for words in cut for w in words if w not in memory})
    if len(memory) + len(new) > MEMORY_WORDS:
        memory.clear()
        new = list({w for words in cut for w in words})
    for i in range(0, len(new), 50_000):
        part = new[i : i + 50_000]
        memory.update(zip(part, models.words([plain(w) for w in part]).tolist()))
    out = np.zeros((len(texts), FEATURES))
    for i, words in enumerate(cut):
        if not words:
            continue
        x = np.fromiter(map(memory.__getitem__, words), np.float64, len(words))
        size = min(STRETCH, len(x))
        sums = np.cumsum(np.insert(x, 0, 0.0))
        top = np.sort(x)[-3:] if len(x) < 64 else np.partition(x, -3)[-3:]
        stretch = (sums[size:] - sums[:-size]).max() / size
        out[i] = x.mean(), stretch, top.max(), top.sum() / 3
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, share: np.ndarray | None = None, steps: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Logistic curve over standardised features by Newton steps: offset and weights for raw features.

    ``share``: how many rows each given one stands for.
    """
    share = np.ones(len(x)) if share is None else share
    centre = np.average(x, axis=0, weights=share)
    scale = np.sqrt(np.average((x - centre) ** 2, axis=0, weights=share)) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    w = np.zeros(z.shape[1])
    penalty = ridge * len(x) * np.r_[0.0, np.ones(len(w) - 1)]

    def loss(w: np.ndarray) -> float:
        return share @ np.logaddexp(0, (1 - 2 * y) * (z @ w)) + penalty @ w**2 / 2

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (share * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
        move = np.linalg.solve(hessian, z.T @ (share * (y - p)) - penalty * w)
        # With a rare class a whole step may lead too far.
        while loss(w + move) > loss(w) and np.abs(move).max() >= 1e-8:
            move /= 2
        w += move
        if np.abs(move).max() < 1e-8:
            break
    weights = w[1:] / scale
    return np.r_[w[0] - weights @ centre, weights]


def fit(docs: DataFrame, labels: DataFrame) -> Models | JoinedModels | None:
    """Models and curve; None where a class has no training rows."""
    rows = labelled(docs, labels)
    rows = rows.withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))
    counted = rows.groupBy("fold", "half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    total = [sum(r.n for r in counted if r.toxic == c) for c in (0, 1)]
    if not all(total):
        return None
    for name, value in (("fold", CURVE_FOLD), ("fold", 3), ("fold", 2), ("fold", 1), ("half", 1)):
        n = [sum(r.n for r in counted if r.toxic == c and r[name] == value) for c in (0, 1)]
        if all(0 < k < t for k, t in zip(n, total)):
            apart = F.col(name) == value
            break
    else:
        apart = F.lit(False)
    models = fit_models(rows.filter(~apart))
    if models is None:
        return None
    # What holds without a curve: the likelihood ratio of the strongest stretch against the classes' odds.
    models.curve = np.array([np.log(total[1] / total[0]), 0.0, STRETCH, 0.0, 0.0])
    # A share of each class by the rows' hash, so that about CURVE_ROWS of each are left.
    taken = [max(1, int(min(1.0, CURVE_ROWS / max(1, k)) * 1_000_000)) for k in n]
    most = F.when(F.col("toxic") == 1, taken[1]).otherwise(taken[0])
    sampled = rows.filter(apart).filter(F.pmod(F.xxhash64("text", "doc_id"), F.lit(1_000_000)) < most)
    table = _measured(sampled, models).toArrow()
    y = table.column("toxic").to_numpy().astype(int)
    found = np.bincount(y, minlength=2)
    if found.all():
        share = (np.array(n) / found)[y]
        models.curve = fit_curve(np.stack([table.column(f"f{k}").to_numpy() for k in range(FEATURES)], 1), y.astype(float), share)
    return models


def _measured(rows: DataFrame, models: Models | JoinedModels) -> DataFrame:
    """f0 to f3 and toxic of labelled rows."""
    if isinstance(models, JoinedModels):
        keyed = rows.select(F.md5("text").alias("text_key"), "toxic")
        return keyed.join(models.evidence(rows.select("text")), "text_key").drop("text_key")
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _features_of(sent, batch.column("text"))
        return pa.record_batch([pa.array(x[:, k]) for k in range(FEATURES)] + [batch.column("toxic").cast(pa.int32())], [*[f"f{k}" for k in range(FEATURES)], "toxic"])

    return rows.mapInArrow(per_batch(measured), f"{_KINDS}, toxic int")


def _features_of(sent, column: pa.Array) -> np.ndarray:
    models = sent.value
    hold_memory(f"toxicity {models.name}", _memories.clear)
    memory = _memories.setdefault(models.name, {})
    parts = [features(models, texts_of(column.slice(a, b - a)), memory) for a, b in parts_by_bytes(sizes_of(column), BATCH_BYTES)]
    return np.concatenate(parts) if parts else np.zeros((0, FEATURES))


def score(docs: DataFrame, models: Models | JoinedModels | None) -> DataFrame:
    """Documents with ``toxicity`` (0 to 1) as a further last column."""
    if models is None:
        return docs.withColumn("toxicity", F.lit(0.0))
    if isinstance(models, JoinedModels):
        curve = [float(c) for c in models.curve]
        text = column_or_null(docs, "text", "string")
        line = sum((c * F.coalesce(F.col(f"f{k}"), F.lit(0.0)) for k, c in enumerate(curve[1:])), F.lit(curve[0]))
        joined = docs.withColumn("text_key", F.md5(text)).join(models.evidence(docs.select(text.alias("text"))), "text_key", "left")
        found = 1 / (1 + F.exp(-F.greatest(F.least(line, F.lit(30.0)), F.lit(-30.0))))
        return joined.withColumn("toxicity", found).drop("text_key", *[f"f{k}" for k in range(FEATURES)])
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def toxicity(texts: pa.Array) -> pa.Array:
        x, curve = _features_of(sent, texts), sent.value.curve
        return pa.array(1 / (1 + np.exp(-np.clip(curve[0] + x @ curve[1:], -30, 30))))

    return docs.withColumn("toxicity", F.arrow_udf(toxicity, "double")(column_or_null(docs, "text", "string")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    doc_id = column_or_null(docs, "doc_id", "long")
    narrow = docs.select(doc_id.alias("doc_id"), column_or_null(docs, "text", "string").alias("text"))
    return score(narrow, fit(docs, labels)).select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic; columns are kept."""
    models = fit(docs, labels)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    text = column_or_null(docs, "text", "string")
    nested = docs.select(row.alias("row"), text.alias("text"))
    return score(nested, models).filter("toxicity < 0.5").select("row.*")
