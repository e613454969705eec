"""Best-fit packing by patterns fitted with non-negative least squares.

1. Documents become token ids (each distinct word is encoded once) and pieces of
   at most ``SEQUENCE`` tokens; the pieces' lengths, checksums and their rank among the
   pieces of one length in a partition are written once.
2. The histogram of lengths (at most 2,048 numbers, whatever the data) goes to the driver.
   Patterns of up to three lengths, in steps of ``STEP`` tokens, that fill a sequence are
   enumerated; non-negative least squares fits how often each repeats; counts are rounded
   down to what is there.
3. What is left is packed by best fit on the histogram, longest first, into the gaps of
   the patterns and then into new ones.
4. The plan, a list of (exact lengths, repeats), says for the r-th piece of each length in
   which sequence and where in it that piece stands. Pieces learn their global rank from
   counts by partition and length and look up their place; no sequence is ever gathered.

Defined cases: null text counts as empty (one piece, the end id alone); repeated rows are
documents of their own; an empty table gives an empty one; other columns are ignored."""

from __future__ import annotations

import array
import bisect
import itertools
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coreloom.llm.hashing import text_chunks
from coreloom.llm.util import read_table, written

SEQUENCE = 2048
STEP = 8
END_ID = 0
#: Words, and pre-tokens, that a worker's caches hold at most; beyond it a cache starts anew.
CACHE_WORDS = 800_000

_encoders: dict = {}


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others
    for the characters from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(rest)}


class _Learning(dict):
    """A cache that makes what it lacks."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        found = self[key] = self.make(key)
        return found


_LETTERS = byte_letters()


class WordEncoder:
    """Token ids of a text, as bytes of little-endian 32-bit numbers.

    The tokenizer drops white space, never joins across it and encodes each of its
    pre-tokens by itself, so a text's ids are those of its words one after the other, and a
    word's those of its pre-tokens. Each distinct word is cut once and each distinct
    pre-token encoded once. Words of common Latin characters are cut by the pre-tokenizer's
    own pattern; others are left to the whole tokenizer."""

    _PLAIN = re.compile(r"[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
    _PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = _Learning(self._word)
        self.parts = _Learning(self._part)

    def _part(self, part: str) -> bytes:
        letters = part if part.isascii() else part.encode().decode("latin-1").translate(_LETTERS)
        return array.array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if self._PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.parts.__getitem__, self._PARTS.findall(text.lower())))
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: bytes) -> bytes:
        for known in (self.words, self.parts):
            if len(known) > CACHE_WORDS:
                known.clear()
        return b"".join(map(self.words.__getitem__, text.split()))


def encoder(path: str | None) -> WordEncoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long"


def _cut(path: str | None, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranks, coder = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64), encoder(path)
        last = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for ids, texts in text_chunks(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                out: dict[str, list] = {k.split()[0]: [] for k in _PIECES.split(", ")}
                for doc_id, text in zip(ids, texts):
                    code = coder.encode(text) + last
                    for k, at in enumerate(range(0, len(code), 4 * size)):
                        piece = code[at : at + 4 * size]
                        n = len(piece) // 4
                        for name, x in zip(out, (doc_id, k, at // 4, n, zlib.crc32(piece), part, ranks[n])):
                            out[name].append(x)
                        ranks[n] += 1
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in out.items()})

    return run


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Minimise |a x - b| for x >= 0 by the active-set method of Lawson and Hanson."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slope = a.T @ b
    least = 1e-9 * max(1.0, float(np.abs(slope).max(initial=0)))
    for _ in range(rounds):
        open_ = np.where(passive, -np.inf, slope)
        best = int(open_.argmax())
        if open_[best] <= least:
            break
        passive[best] = True
        while True:
            on = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (s > 0).all():
                break
            low = s <= 0
            own = x[on]
            alpha = (own[low] / np.maximum(own[low] - s[low], 1e-300)).min()
            x[on] = own + alpha * (s - own)
            passive[on[x[on] <= 1e-12]] = False
            x[~passive] = 0
            if not passive.any():
                return x
        x[:] = 0
        x[on] = s
        slope = a.T @ (b - a @ x)
    return x


def step_patterns(n: int) -> list[tuple[int, ...]]:
    """Multisets of one to three steps that add up to n."""
    two = [(a, n - a) for a in range(n - 1, (n - 1) // 2, -1) if a >= n - a >= 1]
    three = [(a, b, n - a - b) for a in range(n - 2, 0, -1) for b in range(min(a, n - a - 1), 0, -1) if b >= n - a - b >= 1]
    return [(n,), *two, *three]


def make_plan(histogram: dict[int, int], size: int = SEQUENCE, step: int = STEP) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths, repeats)]: every piece of the histogram once, at most ``size`` tokens a sequence."""
    left = Counter({k: v for k, v in histogram.items() if v})
    bins: dict[int, list[int]] = defaultdict(list)
    for length in sorted(left, reverse=True):
        bins[-(-length // step)].append(length)
    plan: list[tuple[tuple[int, ...], int]] = []
    patterns = [p for p in step_patterns(size // step) if all(x in bins for x in p)]
    if patterns:
        a, b = np.zeros((size // step + 1, len(patterns))), np.zeros(size // step + 1)
        for j, p in enumerate(patterns):
            for x in p:
                a[x, j] += 1
        for x, lengths in bins.items():
            b[x] = sum(left[k] for k in lengths)
        rows = np.flatnonzero(b)
        fit = nnls(a[rows], b[rows])
        for j in np.argsort(-fit, kind="stable"):
            p, times = patterns[j], int(fit[j] + 0.5)
            times = min([times, *(sum(left[k] for k in bins[x]) // p.count(x) for x in set(p))])
            if times <= 0:
                continue
            runs = []
            for x in p:  # the next pieces of each step, longest first, as runs of one length
                need, own = times, []
                for length in bins[x]:
                    if need and (n := min(need, left[length])):
                        own.append([length, n])
                        left[length] -= n
                        need -= n
                runs.append(own)
            while runs[0]:
                n = min(r[0][1] for r in runs)
                plan.append((tuple(r[0][0] for r in runs), n))
                for r in runs:
                    r[0][1] -= n
                    if not r[0][1]:
                        r.pop(0)
    return _best_fit(plan, left, size)


def _best_fit(plan: list[tuple[tuple[int, ...], int]], left: Counter, size: int) -> list[tuple[tuple[int, ...], int]]:
    gaps: dict[int, list] = defaultdict(list)
    for lengths, n in plan:
        gaps[size - sum(lengths)].append((lengths, n))
    order = sorted(gaps)
    for length in sorted((k for k, v in left.items() if v), reverse=True):
        need = left[length]
        while need:
            i = bisect.bisect_left(order, length)
            if i == len(order):
                each = size // length
                for times, n in ((each, need // each), (need % each, 1)):
                    if times and n:
                        gap = size - times * length
                        if gap not in gaps:
                            bisect.insort(order, gap)
                        gaps[gap].append(((length,) * times, n))
                break
            gap = order[i]
            lengths, n = gaps[gap].pop()
            took = min(n, need)
            if took < n:
                gaps[gap].append((lengths, n - took))
            if not gaps[gap]:
                del gaps[gap]
                order.pop(i)
            if gap - length not in gaps:
                bisect.insort(order, gap - length)
            gaps[gap - length].append(((*lengths, length), took))
            need -= took
    return [x for gap in sorted(gaps) for x in gaps[gap]]


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length (rank where a run begins, its first sequence, the offset in it)."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    seen: Counter = Counter()
    first = 0
    for lengths, n in plan:
        for length, offset in zip(lengths, itertools.accumulate((0, *lengths))):
            runs[length].append((seen[length], first, offset))
            seen[length] += n
        first += n
    return {k: tuple(np.array(v, np.int64).T) for k, v in runs.items()}


def _place(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(b.schema.get_field_index("length")).to_numpy(), b.column(b.schema.get_field_index("rank")).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                begin, first, off = table[int(n)]
                i = np.searchsorted(begin, rank[at], "right") - 1
                sequence[at], offset[at] = first[i] + rank[at] - begin[i], off[i]
            kept = [b.column(i) for i, k in enumerate(b.schema.names) if k != "rank"]
            names = [k for k in b.schema.names if k != "rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str | None = None, size: int = SEQUENCE, end_id: int = END_ID, step: int = STEP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    pieces = written(rows.mapInArrow(_cut(tokenizer_path, size, end_id), _PIECES), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    table = places(make_plan(histogram, size, step))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(counts.select("part", "length", before.alias("before")), ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(_place(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
