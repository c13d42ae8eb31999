"""Language identification by word-first backoff.

A known word adds its log frequency in each language.  An unseen word falls back to
its character n-grams, padded at both ends: the longest n from 5 to 1 of which the
model knows one decides, with the mean log frequency of those it knows.

Words are runs of letters (and of any non-ASCII characters), lower-cased.  The model
is fitted on a bounded sample: at most about ``FIT_PER_LANG`` labelled texts of each
language, chosen by a hash of doc_id; words and n-grams are counted in Spark, and the
most frequent of each language are kept (``MODEL_WORDS``, ``MODEL_GRAMS``), so its
size depends on the number of languages only.

Null texts and texts without a letter are ``und`` with score 0, as is every text when
nothing can be learned.  Ties go to the language that sorts first.  Rows whose lang
or text is null are never learned from.  Repeated rows are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import words as W
from .shuffle import small_batches

FIT_PER_LANG = 1500
MODEL_WORDS = 20_000
MODEL_GRAMS = 8_000
LONGEST = 5
PAD = "\u0001"
WORD = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass
class Model:
    langs: list[str]
    word_keys: np.ndarray
    word_scores: np.ndarray
    gram_keys: dict[int, np.ndarray]
    gram_scores: dict[int, np.ndarray]


def held_out(doc_id, divisor: int, remainder: int):
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % divisor == remainder, F.lit(False))


def _keys(texts: list[str]) -> np.ndarray:
    """The hashes that prediction computes for these single words."""
    out = [s.hashes() for s in W.slices(pa.array(texts, pa.string()), outside=W.NO_LETTER)]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed code points of all padded texts and where each starts."""
    padded = [PAD + t + PAD for t in texts]
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return W.mix(points + np.uint64(1)), np.concatenate(([0], np.cumsum(size)))


def _table(rows: list[tuple[str, str, int]], langs: list[str], keys_of) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys and smoothed log frequencies by language of (item, lang, count)."""
    items = sorted({r[0] for r in rows})
    index, column = {x: i for i, x in enumerate(items)}, {x: i for i, x in enumerate(langs)}
    counts = np.zeros((len(items), len(langs)))
    for item, lang, n in rows:
        counts[index[item], column[lang]] += n
    total = counts.sum(0)
    scores = np.log((counts + 0.1) / (total + 0.1 * (len(items) + 1)))
    keys = keys_of(items)
    order = np.argsort(keys)
    return keys[order], scores[order].astype(np.float32)


def _lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts lower-cased as prediction does it."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["lang"], pc.utf8_lower(b["text"])], ["lang", "text"])


def fit(docs: DataFrame, divisor: int = 4, remainder: int = 2, per_lang: int = FIT_PER_LANG) -> Model:
    """docs (doc_id, text, lang); rows with crc32(doc_id) mod divisor = remainder are held out."""
    rows = docs.select("doc_id", "text", "lang").where(~held_out("doc_id", divisor, remainder)).where("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0), np.float32), {}, {})
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_lang / n))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    lowered = sample.select("lang", "text").mapInArrow(_lowered, "lang string, text string")
    found = lowered.select("lang", F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("item"))
    counted = found.groupBy("lang", "item").agg(F.count("*").alias("n")).persist()
    grams = counted.select("lang", "n", F.concat(F.lit(PAD), "item", F.lit(PAD)).alias("w")).select("lang", "n", "w", F.explode(F.sequence(F.lit(1), F.lit(LONGEST))).alias("k")).where("length(w) >= k")
    grams = grams.select("lang", "k", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - F.col("k") + 1), lambda i: F.substring(F.col("w"), i, F.col("k")))).alias("item"))
    grams = grams.groupBy("lang", "k", "item").agg(F.sum("n").alias("n"))
    top = lambda df, keys, most: df.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "item"))).where(F.col("r") <= most)
    words = [(r.item, r.lang, r.n) for r in top(counted, ["lang"], MODEL_WORDS).collect()]
    by_k: dict[int, list] = {k: [] for k in range(1, LONGEST + 1)}
    for r in top(grams, ["lang", "k"], MODEL_GRAMS).collect():
        by_k[r.k].append((r.item, r.lang, r.n))
    counted.unpersist()
    word_keys, word_scores = _table(words, langs, _keys)
    tables = {k: _table(v, langs, lambda items, k=k: _gram_keys(items, k)) for k, v in by_k.items() if v}
    return Model(langs, word_keys, word_scores, {k: t[0] for k, t in tables.items()}, {k: t[1] for k, t in tables.items()})


def _gram_keys(items: list[str], k: int) -> np.ndarray:
    points = np.frombuffer("".join(items).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return W.windows(W.mix(points + np.uint64(1)), np.arange(0, len(points) + 1, k), k)[0]


def _find(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each h in ascending keys, -1 if absent."""
    if not len(keys):
        return np.full(len(h), -1)
    i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[i] == h, i, -1)


def backoff(model: Model, texts: list[str]) -> np.ndarray:
    """Scores by language of unseen words."""
    out = np.full((len(texts), len(model.langs)), np.log(1e-6) if not model.gram_keys else 0.0, np.float32)
    points, at = _points(texts)
    open_ = np.ones(len(texts), bool)
    for k in sorted(model.gram_keys, reverse=True):
        if not open_.any():
            break
        h, _, word = W.windows(points, at, k)
        keep = open_[word]
        word = word[keep]
        i = _find(model.gram_keys[k], h[keep])
        word, i = word[i >= 0], i[i >= 0]
        n = np.bincount(word, minlength=len(texts))
        hit = n > 0
        for c in range(len(model.langs)):
            total = np.bincount(word, model.gram_scores[k][i, c], minlength=len(texts))
            out[hit, c] = total[hit] / n[hit]
        open_ &= ~hit
    return out


def predict_texts(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and posterior (equal priors) of each text."""
    langs, score = ["und"] * len(texts), np.zeros(len(texts))
    n_langs = len(model.langs)
    if not n_langs:
        return langs, score
    for s in W.slices(pc.utf8_lower(texts), outside=W.NO_LETTER):
        h = s.hashes()
        own, first, back = np.unique(h, return_index=True, return_inverse=True)
        i = _find(model.word_keys, own)
        table = np.zeros((len(own), n_langs), np.float32)
        table[i >= 0] = model.word_scores[i[i >= 0]]
        unseen = np.flatnonzero(i < 0)
        if len(unseen):
            table[unseen] = backoff(model, [s.word(x).decode("utf-8", "replace") for x in first[unseen].tolist()])
        run = np.zeros((len(h) + 1, n_langs))
        np.cumsum(table[back], axis=0, out=run[1:])
        total = run[s.word_of[1:]] - run[s.word_of[:-1]]
        ascii_letter = np.concatenate(([0], np.cumsum((s.buf >= 97) & (s.buf <= 122))))
        plain = ascii_letter[s.bounds[1:]] > ascii_letter[s.bounds[:-1]]
        best = total.argmax(1)
        p = np.exp(total - total.max(1, keepdims=True))
        p = p[np.arange(len(best)), best] / p.sum(1)
        raw = None
        for k in range(s.n_texts):
            known = plain[k]
            if not known and s.word_of[k] < s.word_of[k + 1]:
                raw = raw or s.buf.tobytes()
                known = any(map(str.isalpha, raw[s.bounds[k] : s.bounds[k + 1]].decode("utf-8", "replace")))
            if known:
                langs[s.first + k], score[s.first + k] = model.langs[best[k]], p[k]
    return langs, score


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs with the language and its score under these names (replacing columns of those names)."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*[c for c in docs.columns if c.lower() not in [n.lower() for n in names]])
    schema = StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, score = predict_texts(held.value, b["text"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(score)], [*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
