"""Language ID with bit-sliced Bloom filters of n-grams.

One table of machine words is the filters of up to 64 languages at once: bit l of a word
belongs to language l, and the AND of an n-gram's words is the set of languages that
contain it. A text's n-grams are looked up together; per-language counts of the set bits
are corrected for the filter's false positives (its fill to the power of the probes), and
the largest corrected count decides. The score is its share of all corrected counts.

Learning reads a bounded sample: at most ``sample_docs`` labelled documents a language,
the first by a hash of the id, each with its whole text. A language's filter gets the
n-grams that at least ``min_docs`` of its documents hold and whose frequency is at least
``share`` of the most frequent language's. The table has a fixed size, so what is
broadcast doesn't grow with the corpus. Predictions see the text alone.

N-grams are four bytes of the lower-cased text (A-Z), where bytes that are no letters
count as one space.

Defined cases: null text or one without a letter is ``und`` with score 0; a text none of
whose n-grams is known gets the language with the most labelled documents and score 0;
without any labelled row all are ``und``; ties go to the language first by name; repeated
rows are rows of their own; an empty table gives an empty one; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coreloom.llm.hashing import text_chunks
from coreloom.llm.util import bounded_batches, read_table

SLOTS = 1 << 20
PROBES = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77))
#: More labels than this are an error: the filters (8 MB for each 64 languages) wouldn't fit.
MAX_LANGUAGES = 4096
#: Parts of a language that are ranked apart; ids of the sample that are broadcast at most.
SALTS, BROADCAST_IDS = 64, 500_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as uint32 of all texts, where each text's end)."""
    data = _FOLD[np.frombuffer(b"  ".join([*texts, b""]) + b"    ", np.uint8)]
    gap = data == 32
    keep = np.ones(len(data), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 2)
    at = np.cumsum(keep)
    data = np.concatenate([data[keep], np.full(3, 32, np.uint8)]).astype(np.uint32)
    return data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24), at[ends - 1]


def slots_of(g: np.ndarray) -> list[np.ndarray]:
    return [(g ^ (g >> np.uint32(15))) * p >> np.uint32(12) for p in PROBES]


class Filters:
    """Filters of any number of languages, 64 to a table."""

    def __init__(self, languages: list[str], most: str, pairs: dict[int, np.ndarray]):
        """pairs: for each language's place its n-grams."""
        self.languages, self.most = languages, most
        self.tables = [np.zeros(SLOTS, np.uint64) for _ in range(-(-len(languages) // 64))]
        self.false = np.zeros(len(languages))
        for place, own in pairs.items():
            table, bit = self.tables[place // 64], np.uint64(1) << np.uint64(place % 64)
            for s in slots_of(own):
                table[s] |= bit
            self.false[place] = ((table & bit) != 0).mean() ** len(PROBES)

    def counts(self, g: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each text and language, how many n-grams its filter holds, corrected."""
        begins = np.concatenate([[0], ends[:-1]])
        some = np.flatnonzero(ends > begins)
        out = np.zeros((len(ends), len(self.languages)))
        if not len(some):
            return out
        total = (ends - begins)[some]
        probes = slots_of(g)
        for k, table in enumerate(self.tables):
            mask = table[probes[0]]
            for s in probes[1:]:
                mask &= table[s]
            for place in range(k * 64, min(len(self.languages), k * 64 + 64)):
                bits = (mask >> np.uint64(place % 64)).astype(np.uint8) & np.uint8(1)
                hits = np.add.reduceat(bits, begins[some], dtype=np.int64)
                f = self.false[place]
                out[some, place] = np.maximum(0.0, (hits - f * total) / (1.0 - min(f, 0.999)))
        return out


def _sample_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).cast(pa.binary()).to_pylist()
        for lang in set(b.column(0).to_pylist()):
            own = [t for t, x in zip(texts, b.column(0).to_pylist()) if x == lang]
            found = []
            for _, some in text_chunks(range(len(own)), own):
                g, ends = grams(some)
                found += [np.unique(x) for x in np.split(g, ends[:-1])]
            gram, docs = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(gram)), "gram": pa.array(gram.astype(np.int64)), "docs": pa.array(docs.astype(np.int64))})


def learn(labelled: DataFrame, sample_docs: int = 400, min_docs: int = 2, share: float = 0.25) -> Filters:
    """labelled: doc_id, lang, text. Reads at most ``sample_docs`` texts a language."""
    known = labelled.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Filters([], "und", {})
    # first in parts of a language, so that no task gets more of one than SALTS samples
    chosen = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("salt", F.pmod("h", F.lit(SALTS)))
    for parts in (["lang", "salt"], ["lang"]):
        rank = F.row_number().over(W.partitionBy(*parts).orderBy("h", "doc_id"))
        chosen = chosen.withColumn("rank", rank).where(F.col("rank") <= sample_docs)
    chosen = chosen.select("doc_id", "lang").distinct()
    chosen = F.broadcast(chosen) if len(languages) * sample_docs <= BROADCAST_IDS else chosen
    sample = known.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"]).select("lang", "text")
    found = sample.mapInArrow(_sample_grams, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    used = F.greatest(F.lit(1), F.least(F.lit(sample_docs), F.element_at(F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, v)]), F.col("lang"))))
    found = found.withColumn("rate", F.col("docs") / used)
    found = found.withColumn("top", F.max("rate").over(W.partitionBy("gram"))).where((F.col("docs") >= F.least(F.lit(min_docs), used)) & (F.col("rate") >= share * F.col("top")))
    table = found.select("lang", "gram").toArrow()  # bounded by the sample
    lang, gram = np.array(table["lang"].to_pylist(), object), table["gram"].to_numpy().astype(np.uint32)
    pairs = {i: gram[lang == x] for i, x in enumerate(languages)}
    return Filters(languages, max(languages, key=lambda x: sizes[x]), pairs)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: Filters = shared.value
        for b in batches:
            names = b.schema.names
            letters = np.array(b.column(names.index("letters")).to_pylist(), bool)
            texts = b.column(names.index("body")).cast(pa.binary()).to_pylist()
            pred, score = [], []
            for _, own in text_chunks(range(len(texts)), texts):
                counts = filters.counts(*grams(own)) if filters.languages else np.zeros((len(own), 0))
                total = counts.sum(axis=1)
                best = counts.argmax(axis=1) if filters.languages else np.zeros(len(own), int)
                for i, t in enumerate(total):
                    pred.append(filters.languages[best[i]] if t > 0 else filters.most)
                    score.append(float(counts[i, best[i]] / t) if t > 0 else 0.0)
            pred = [p if x else "und" for p, x in zip(pred, letters)]
            score = [s if x else 0.0 for s, x in zip(score, letters)]
            keep = [k for k in names if k not in ("letters", "body")]
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(k)) for k in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return run


def predict(rows: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """The columns of ``rows`` with lang_pred and score beside them. The new columns
    replace columns of these names."""
    spark = rows.sparkSession
    bounded_batches(spark)
    kept = [c for c in rows.columns if c not in ("lang_pred", "score", "letters", "body")]
    body = F.coalesce(F.col(text), F.lit(""))
    fed = rows.select(*kept, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"), body.alias("body"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    return fed.mapInArrow(_predict(spark.sparkContext.broadcast(filters)), f"{kinds}, lang_pred string, score double")


def fold() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    filters = learn(docs.where(fold() != 1).select("doc_id", "lang", "text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 1).alias("held_out"), "text")
    return predict(rows, filters).select("doc_id", "held_out", "lang_pred", "score")
