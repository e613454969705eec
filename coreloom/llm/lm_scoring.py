"""LM scoring with a weighted backoff automaton.

The model is a trigram model with Dirichlet smoothing. For a token w after the tokens a b

    P(w)     = (c(w) + 0.1) / (N + 0.1 * (V + 1))
    P(w|b)   = (c(b w) + K[0] * P(w)) / (c(b) + K[0])
    P(w|a b) = (c(a b w) + K[1] * P(w|b)) / (c(a b) + K[1])      where c(a b) >= ``CONTEXT``

over all training tokens, where each text starts in the state ``<s>`` and ends with an end
token. As an automaton: the states are the root, each token of the training texts, and each
pair of them that occurs ``CONTEXT`` times or more. A state's arcs are the tokens that were
seen after it; an arc carries the weight above and leads to the longest state that ends what
was read. Each state has a failure arc to the state without its first token, of weight
K / (c + K). A text is read once from left to right: the state is carried along, takes its
arc on the next token, or failure arcs until one has it, and the weights' logarithms add up.

The corpus' counts cover every token of every training text, and no task needs them all:

1. Texts are written once as compressed shards of about ``SHARD_BYTES``, dealt to buckets.
2. Each shard sends the owners of the hash space its distinct tokens and pairs as sorted,
   gap-coded blobs with its training counts. Owners are as many as the keys need
   (``OWNER_KEYS``), add the counts up and answer each shard with the totals of its keys.
3. The same once more for the triples whose first two tokens are a state.
4. Each shard compiles its slice of the automaton from the totals and traverses it.

Tokens: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, known by 64-bit hashes (two of V
different tokens share one with probability V * V / 2 ** 65), then one end. Defined cases:
null text is empty (the end alone); repeated rows count each; a null doc_id is held out (the
checksum of an empty string is 0); without training rows N and V are 0 and all tokens are
unknown; an empty table gives an empty one; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coreloom.llm.hashing import Words, mix64, text_chunks
from coreloom.llm.util import bucketed, read_table, written

SHARD_BYTES = 5 << 20
#: Keys, repeats across shards included, that one owner adds up.
OWNER_KEYS = 2_000_000
#: Weight of the next shorter context's distribution, in tokens, after one and two tokens.
K = (30.0, 2.0)
#: Occurrences that make a pair of tokens a state.
CONTEXT = 2
ALPHA = 0.1
_U = np.uint64
_END, _START = _U(0x5BF0363557D5C1B7), _U(0x2545F4914F6CDD1D)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_BYTES = _LOWER.tobytes()


def packed(values: np.ndarray) -> bytes:
    """Fixed-width numbers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def shards(rows: DataFrame, size: int = SHARD_BYTES) -> DataFrame:
    """rows: doc_id, train, text -> (shard, size, payload), a row for about ``size`` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, some = TaskContext.get().partitionId(), 0, 0, []

        def made() -> pa.RecordBatch:
            nonlocal n, held
            size_of = held
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, some[0].schema) as out:
                for x in some:
                    out.write_batch(x)
            some.clear()
            n, held = n + 1, 0
            payload = zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_pydict({"shard": pa.array([(part << 32) + n], pa.int64()), "size": pa.array([size_of], pa.int64()), "payload": pa.array([payload], pa.binary())})

        for b in batches:
            at = 0
            for ids, texts in text_chunks(range(b.num_rows), b.column(2).cast(pa.binary()).to_pylist()):
                some.append(b.slice(at, len(ids)))
                at += len(ids)
                held += sum(map(len, texts))
                if held >= size:
                    yield made()
        if some:
            yield made()

    return bucketed(rows.mapInArrow(run, "shard long, size long, payload binary"), "shards", "shard")


class ShardTokens:
    """A shard's tokens: cur and prev hash and text of each, the ends in place."""

    def __init__(self, payload: bytes):
        table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)).read_all().combine_chunks()
        self.doc_id = table["doc_id"].combine_chunks()
        self.train = np.array(table["train"].to_pylist(), bool)
        raw = [t.translate(_LOWER_BYTES) for t in table["text"].cast(pa.binary()).to_pylist()]
        cur, counts = [], []
        for _, own in text_chunks(range(len(raw)), raw):
            w = Words(own)
            counts.append(np.diff(w.first) + 1)
            cur.append(np.insert(w.hash, w.first[1:], _END))
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.cur = np.concatenate(cur) if cur else np.zeros(0, _U)
        self.first = np.cumsum(self.counts) - self.counts
        self.prev = np.roll(self.cur, 1)
        self.prev[self.first] = _START
        self.text = np.repeat(np.arange(len(raw)), self.counts)
        self.tokens, at = np.unique(np.append(self.cur, _START), return_inverse=True)
        self.token_at, self.start = at[:-1], int(at[-1])
        self.pairs, self.pair_at = np.unique(mix64(self.prev * _U(0x9E3779B97F4A7C15) + mix64(self.cur ^ _U(0xB1A5))), return_inverse=True)
        self.weight = self.train[self.text].astype(np.float64)

    def triples(self, pair_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places whose last two tokens are a state, the distinct triples there, triple of each place)."""
        after = np.ones(len(self.cur), bool)
        after[self.first] = False
        place = np.flatnonzero(after)
        place = place[pair_counts[self.pair_at[place - 1]] >= CONTEXT]
        keys = mix64(self.pairs[self.pair_at[place - 1]] * _U(0xC2B2AE3D27D4EB4F) + mix64(self.cur[place] ^ _U(0x7A31)))
        return place, *np.unique(keys, return_inverse=True)


class BackoffAutomaton:
    """The slice of the automaton that a shard's texts use.

    States: 0 the root, 1 + t token t (or <s>), then the pairs that are states. ``goto[level, i]``
    is the arc that a state of that many tokens, the last ones read, has on the token at
    place i (-1: none; the root has one on every token)."""

    def __init__(self, own: ShardTokens, token_counts, pair_counts, triple_counts, triples, n: int, v: int, k=K):
        place, _, triple_at = triples
        tokens, cur, prev = len(own.tokens), own.token_at, np.roll(own.token_at, 1)
        prev[own.first] = own.start
        root = (token_counts + ALPHA) / (n + ALPHA * (v + 1))
        is_state = pair_counts >= CONTEXT
        pair_state = 1 + tokens + np.cumsum(is_state) - 1
        # of each pair its two tokens, and the state that reading it leads to
        pair_cur, pair_prev = np.zeros(len(own.pairs), np.int64), np.zeros(len(own.pairs), np.int64)
        pair_cur[own.pair_at], pair_prev[own.pair_at] = cur, prev
        token_to = np.where(token_counts > 0, 1 + np.arange(tokens), 0)
        pair_to = np.where(is_state, pair_state, token_to[pair_cur])
        after_one = (pair_counts + k[0] * root[pair_cur]) / (token_counts[pair_prev] + k[0])
        triple_pair, triple_before = np.zeros(len(triple_counts), np.int64), np.zeros(len(triple_counts), np.int64)
        triple_pair[triple_at], triple_before[triple_at] = own.pair_at[place], own.pair_at[place - 1]
        after_two = (triple_counts + k[1] * after_one[triple_pair]) / (pair_counts[triple_before] + k[1])
        # arcs: of the root, of tokens, of pairs
        self.weight = np.log10(np.concatenate([root, after_one, after_two]))
        self.to = np.concatenate([token_to, pair_to, pair_to[triple_pair]])
        goto = np.full((3, len(cur)), -1, np.int64)
        goto[0] = cur
        goto[1] = np.where(pair_counts[own.pair_at] > 0, tokens + own.pair_at, -1)
        goto[2, place] = np.where(triple_counts[triple_at] > 0, tokens + len(own.pairs) + triple_at, -1)
        self.goto = goto
        chosen = np.flatnonzero(is_state)
        self.level = np.concatenate([[0], np.ones(tokens, np.int64), np.full(len(chosen), 2)])
        self.fail_to = np.concatenate([[0], np.zeros(tokens, np.int64), token_to[pair_cur[chosen]]])
        self.fail = np.concatenate([[0.0], np.log10(k[0] / (token_counts + k[0])), np.log10(k[1] / (pair_counts[chosen] + k[1]))])
        self.start = 1 + own.start

    def traverse(self, first: np.ndarray, counts: np.ndarray, few: int = 48) -> np.ndarray:
        """log10 probability of each text. All texts advance together, a token a step; the last
        ``few`` that are still being read go on one by one."""
        order = np.argsort(-counts, kind="stable")
        first, counts = first[order], counts[order]
        state, score = np.full(len(order), self.start), np.zeros(len(order))
        step, active = 0, len(order)
        while True:
            active = int(np.searchsorted(-counts[:active], -step, side="left"))  # those longer than step
            if active <= few:
                break
            at, s = first[:active] + step, state[:active]
            arc = self.goto[self.level[s], at]
            miss = np.flatnonzero(arc < 0)
            while len(miss):
                score[miss] += self.fail[s[miss]]
                s[miss] = self.fail_to[s[miss]]
                arc[miss] = self.goto[self.level[s[miss]], at[miss]]
                miss = miss[arc[miss] < 0]
            score[:active] += self.weight[arc]
            state[:active] = self.to[arc]
            step += 1
        fail, fail_to, level = self.fail, self.fail_to, self.level
        for t in range(active):
            s, total = int(state[t]), 0.0
            begin, end = int(first[t]) + step, int(first[t] + counts[t])
            goto = self.goto[:, begin:end]
            arcs, to, weight = goto.T.tolist(), self.to, self.weight
            for own in arcs:
                while (arc := own[level[s]]) < 0:
                    total += fail[s]
                    s = fail_to[s]
                total += weight[arc]
                s = to[arc]
            score[t] += total
        out = np.empty(len(order))
        out[order] = score
        return out


def _blobs(shard: int, kind: int, keys: np.ndarray, counts: np.ndarray, owners: int) -> list[dict]:
    width = (1 << 64) // owners + 1
    cut = np.searchsorted(keys // _U(width), np.arange(owners + 1).astype(_U))
    counts = counts.astype(np.uint32)
    return [
        {"owner": i, "kind": kind, "shard": shard, "keys": packed(np.diff(keys[a:z], prepend=_U(0))), "counts": packed(counts[a:z])}
        for i, (a, z) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist()))
        if z > a
    ]


_SENT = pa.schema([("owner", pa.int64()), ("kind", pa.int32()), ("shard", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _send(owners: int):
    """Kind 1: tokens, 2: pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = ShardTokens(payload)
                counts = np.bincount(own.token_at, own.weight, len(own.tokens))
                counts[own.start] = own.train.sum()
                rows = _blobs(shard, 1, own.tokens, counts, owners)
                rows += _blobs(shard, 2, own.pairs, np.bincount(own.pair_at, own.weight, len(own.pairs)), owners)
                yield pa.RecordBatch.from_pylist(rows, schema=_SENT)

    return run


def _send_triples(owners: int):
    """Kind 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, payload, answers in zip(*(b.column(i).to_pylist() for i in range(3))):
                own = ShardTokens(payload)
                place, keys, at = own.triples(totals_of(answers, 2))
                yield pa.RecordBatch.from_pylist(_blobs(shard, 3, keys, np.bincount(at, own.weight[place], len(keys)), owners), schema=_SENT)

    return run


def totals_of(answers: list[dict], kind: int) -> np.ndarray:
    """The totals of a shard's keys of one kind, in the order of the keys."""
    some = [unpacked(x["totals"], np.int64) for x in answers if x["kind"] == kind]
    return np.concatenate(some) if some else np.zeros(0, np.int64)


def _total(table: pa.Table) -> pa.Table:
    keys = [np.cumsum(unpacked(x, _U), dtype=_U) for x in table["keys"].to_pylist()]
    counts = np.concatenate([unpacked(x, np.uint32) for x in table["counts"].to_pylist()])
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, counts, minlength=len(every)).astype(np.int64)
    words = (every != _START) & (table["kind"][0].as_py() == 1)
    answer = total[at]
    blobs, begin = [], 0
    for k in keys:
        blobs.append(packed(answer[begin : begin + len(k)]))
        begin += len(k)
    rest = [0] * (len(blobs) - 1)
    return pa.table(
        {
            "owner": table["owner"],
            "kind": table["kind"],
            "shard": table["shard"],
            "totals": pa.array(blobs, pa.binary()),
            "n": pa.array([int(total[words].sum()), *rest], pa.int64()),
            "v": pa.array([int((total[words] > 0).sum()), *rest], pa.int64()),
        }
    )


def _score(n: int, v: int, k):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload, one, two in zip(*(b.column(i).to_pylist() for i in range(3))):
                own = ShardTokens(payload)
                tokens, pairs = totals_of(one, 1), totals_of(one, 2)
                model = BackoffAutomaton(own, tokens, pairs, totals_of(two or [], 3), own.triples(pairs), n, v, k)
                add = lambda x: np.add.reduceat(x, own.first) if len(own.first) else x
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": own.doc_id,
                        "held_out": pa.array(~own.train),
                        "n_tokens": pa.array(own.counts, pa.int64()),
                        "n_known": pa.array(add((tokens[own.token_at] > 0).astype(np.int64)), pa.int64()),
                        "train_tokens": pa.array(np.full(len(own.counts), n, np.int64)),
                        "base_score": pa.array(add(model.weight[own.token_at])),
                        "score": pa.array(model.traverse(own.first, own.counts)),
                    }
                )

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _answered(sent: DataFrame, what: str) -> tuple[DataFrame, DataFrame]:
    """(the owners' answers, the answers of each shard: as many totals as it has keys)."""
    answers = written(sent.groupBy("owner", "kind").applyInArrow(_total, "owner long, kind int, shard long, totals binary, n long, v long"), what)
    own = answers.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("kind", "owner", "totals"))).alias("answers"))
    return answers, own


def score_texts(docs: DataFrame, train, k=K) -> DataFrame:
    """A row for each row of ``docs``; ``train`` is the condition of the rows to learn from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    stored = shards(rows)
    size = stored.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    owners = max(2, -(-size // 6 // OWNER_KEYS))  # a token takes some six bytes
    sent = "owner long, kind int, shard long, keys binary, counts binary"
    answers, one = _answered(stored.select("shard", "payload").mapInArrow(_send(owners), sent), "totals")
    n, v = answers.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    known = stored.join(one, "shard")
    _, two = _answered(known.select("shard", "payload", "answers").mapInArrow(_send_triples(owners), sent), "triple-totals")
    both = known.join(two.withColumnRenamed("answers", "triples"), "shard", "left")
    return both.select("payload", "answers", "triples").mapInArrow(_score(n, v, k), _SCORES)


def fold() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"), fold() != 0)
