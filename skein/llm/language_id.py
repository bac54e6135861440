"""Language ID by multilingual mixture inference.

Training is counting: byte trigrams of all labelled texts, by language, summed by Spark.  A document
is modelled as a mixture: each of its trigrams comes from language l with proportion p[l], and
expectation-maximisation estimates p.  The language set grows while the likelihood gains more than a
BIC-like penalty for each further language; the proportions are those under the chosen set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.store import arrow_batches, given_back
from skein.llm.textcols import LOWER, buffers, mix64

#: Hashed trigram classes of the model.
CLASSES = 1 << 15
#: Most languages a model may have; with CLASSES, what goes to the driver is 64 MB at most.
MOST_LANGS = 512
#: Add-alpha smoothing of counts, EM steps, and penalty for each further language in units of log(n) / 2.
ALPHA, STEPS, PENALTY = 0.5, 12, 4.0
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def trigram_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, class, count) of the hashed byte trigrams of each text, padded with one space on each side."""
    data, offsets = buffers(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    grams = np.where(size > 0, size, 0)
    if not grams.sum():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    padded = np.full(len(data) + 2 * n, 0x20, np.uint32)
    doc = np.repeat(np.arange(n), size)
    padded[np.arange(len(data)) + 2 * doc + 1] = LOWER[data]
    begin = offsets[:-1] + 2 * np.arange(n)
    code = padded[:-2] | (padded[1:-1] << 8) | (padded[2:] << 16)
    at = np.arange(len(data)) - offsets[doc] + begin[doc]
    kind = (mix64(code[at].astype(np.uint64)) >> np.uint64(49)).astype(np.uint64)
    key = np.sort((doc.astype(np.uint64) << np.uint64(15)) | kind)
    new = np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1)) != 0)
    count = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> np.uint64(15)).astype(np.int64), (key & np.uint64(CLASSES - 1)).astype(np.int64), count


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language and class over the whole partition: at most languages x CLASSES numbers."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        doc, kind, count = trigram_counts(batch.column("text"))
        coded = batch.column("lang").dictionary_encode()
        lang = coded.indices.to_numpy()
        for i, name in enumerate(coded.dictionary.to_pylist()):
            own = lang[doc] == i
            total[name] = total.get(name, 0) + np.bincount(kind[own], count[own], CLASSES).astype(np.int64)
    for name, counts in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([counts.astype("<i8").tobytes()], pa.binary())], ["lang", "counts"])


def _adding(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, "<i8") for x in rows["counts"])
    return pd.DataFrame({"lang": [key[0]], "counts": [total.astype("<i8").tobytes()]})


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [class, language]) from all rows of (text, lang).

    A map task sends one row for each language, and the sums are of fixed size, whatever the input.
    """
    arrow_batches(labelled.sparkSession)
    kinds = "lang string, counts binary"
    part = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").mapInArrow(given_back(_counting), kinds)
    salted = part.withColumn("salt", F.spark_partition_id() % 32).groupBy("lang", "salt").applyInPandas(_adding, kinds)
    rows = sorted((r["lang"], bytes(r["counts"])) for r in salted.groupBy("lang").applyInPandas(_adding, kinds).limit(MOST_LANGS + 1).collect())
    if len(rows) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    counts = np.array([np.frombuffer(c, "<i8") for _, c in rows], float).reshape(len(rows), CLASSES).T + ALPHA
    return [r[0] for r in rows], np.log(counts / counts.sum(axis=0, keepdims=True))


def mixture(doc: np.ndarray, kind: np.ndarray, count: np.ndarray, n: int, logp: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> np.ndarray:
    """Proportions [document, language]; documents without trigrams get zeros.

    The set starts with the likeliest language.  Another joins, in order of the proportions that EM
    gives under all languages, as long as EM's likelihood under the larger set gains more than
    ``penalty`` * log(trigrams) / 2.
    """
    langs = logp.shape[1]
    out = np.zeros((n, langs))
    if not len(doc) or not langs:
        return out
    p = np.exp(logp)

    def em(rows: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log-likelihood of the documents ``rows`` (ascending), under their sets."""
        own = np.flatnonzero(np.isin(doc, rows, kind="table"))
        d = np.searchsorted(rows, doc[own])
        first = np.flatnonzero(np.diff(d, prepend=-1))
        like, c = p[kind[own]], count[own].astype(float)
        pi = allowed / allowed.sum(axis=1, keepdims=True)
        total = np.add.reduceat(c, first)
        for _ in range(steps):
            joint = like * pi[d]
            pi = np.add.reduceat(joint * (c / joint.sum(axis=1))[:, None], first) / total[:, None]
        return pi, np.add.reduceat(c * np.log((like * pi[d]).sum(axis=1)), first)

    rows = np.unique(doc)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    total = np.add.reduceat(count, first)
    single = np.add.reduceat(count[:, None] * logp[kind], first)
    best = single.argmax(axis=1)
    chosen, score = np.eye(langs)[best], single[np.arange(len(rows)), best]
    out[rows] = chosen
    if langs == 1:
        return out
    full, _ = em(rows, np.ones((len(rows), langs)))
    full[np.arange(len(rows)), best] = 2
    order = np.argsort(-full, axis=1, kind="stable")
    active = np.arange(len(rows))
    for size in range(2, langs + 1):
        allowed = chosen[active].copy()
        allowed[np.arange(len(active)), order[active, size - 1]] = 1
        pi, reached = em(rows[active], allowed)
        gain = reached - score[active] > penalty * np.log(total[active] + 1) / 2
        active, allowed = active[gain], allowed[gain]
        chosen[active], score[active], out[rows[active]] = allowed, reached[gain], pi[gain]
        if not len(active):
            break
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], *, text_col: str = "text", steps: int = STEPS, penalty: float = PENALTY) -> DataFrame:
    """Every row of ``docs`` with ``lang_pred``, ``score`` and ``lang_mix`` (map of language to proportion).

    The whole text counts.  A null text, or one without a letter, gets ``und``, score 0 and an empty
    map, as does every text under a model without languages.  Equal proportions: the language that
    sorts first.  Repeated rows are judged alike; input columns named like an output column are
    replaced.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    own = [c for c in docs.columns if c not in ("lang_pred", "score", "lang_mix")]
    names = model[0]
    sent = spark.sparkContext.broadcast(model[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(own.index(text_col))
            mix = mixture(*trigram_counts(text), batch.num_rows, sent.value, steps, penalty) if names else np.zeros((batch.num_rows, 1))
            known = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False) & (mix.sum(axis=1) > 0)
            top = mix.argmax(axis=1)
            pred = [names[i] if ok else UNKNOWN for i, ok in zip(top, known, strict=True)]
            score = np.where(known, np.clip(mix[np.arange(len(top)), top], 0, 1), 0.0)
            maps = [[(names[j], float(m[j])) for j in np.flatnonzero(m > 1e-3)] if ok else [] for m, ok in zip(mix, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(maps, pa.map_(pa.string(), pa.float64()))], [*own, "lang_pred", "score", "lang_mix"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema.fields)
    return docs.select(*own).mapInArrow(given_back(run), f"{kinds}, lang_pred string, score double, lang_mix map<string,double>")


def fit_on(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The model from the text and lang of all documents that are not held out."""
    return train(docs.filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).select("text", "lang"))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all rows of ``documents``, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = predict(docs.select("doc_id", "text"), fit_on(docs))
    return done.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
