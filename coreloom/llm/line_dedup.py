"""Line dedup by a segment-partition edit join.

A line (split at ``\\n``, trimmed of white space at both ends) of at least ``min_chars``
code points goes if an earlier line of the corpus, by doc_id and line number, is within
``tau`` edits (insertions, deletions, substitutions of code points). A shorter line of at
least ``exact_chars`` code points goes if an earlier line equals it; without ``exact_chars``
shorter lines stay. Empty lines always stay. Lines are judged on the input, not on what is left.

1. Equal lines collapse by a 128-bit cryptographic digest of their bytes before all else, so
   a line in a third of all documents is one entry.
2. Each line is cut into ``tau + 1`` segments; two lines within ``tau`` edits share one at
   nearly the same place. A line's own segments are its index entries, keyed by (length,
   segment number, content). As a probe it looks, for each indexed length from its own down
   to ``tau`` less, at the substrings whose shift is compatible with that segment
   (multi-match-aware selection). A bounded filter of the index keys keeps probes that can't
   match out of the shuffle; the join on the key is exact.
3. Keys are counted, and a bounded filter of those with several rows keeps index entries that
   are alone out of the shuffle. A bucket (one key) is compared where it lies, by a signature of character counts (two
   lines within ``tau`` edits differ by at most ``2 * tau`` in all), and gives out the rows
   that have a partner, never pairs. A bucket of more than ``BUCKET`` rows is dealt to blocks
   of its index entries against blocks of all its rows.
4. These rows come back with their texts, the same blocks are verified by a bit-parallel
   automaton kept to the band of ``tau`` around the diagonal, and each line of a bucket gets
   one row: the number of its links and the earliest place linked to. A pair that meets in
   several buckets counts in the one of its first common segment.

A bucket of n different lines costs n * n signature comparisons, however they are dealt:
nothing else tells whether two of them are near.

Defined cases: null text has no lines and stays null; a null doc_id comes last; rows that
share a doc_id are ordered by a hash of the text; repeated rows are judged as one (equal
places never precede each other); an empty table gives an empty one; other columns are
passed through by ``drop_repeated_lines``."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coreloom.llm.hashing import _BASES, RunHashes, digest128, mix64, text_chunks
from coreloom.llm.util import HashFilter, hashes_in, read_table, written

TAU, MIN_CHARS = 2, 20
#: What the query and the pipeline judge by equality alone: every line that is not empty.
EXACT_CHARS = 1
#: Rows of a bucket that meet in one block.
BUCKET = 4000
_TRIM = b" \t\r\x0b\x0c"
_BLANK = np.zeros(256, bool)
_BLANK[list(_TRIM)] = True
_LAST = (1 << 63) - 1
_U = np.uint64


class Lines:
    """The long enough lines of some texts, as runs of their bytes and of their code points."""

    def __init__(self, texts: list[bytes], min_chars: int):
        self.data = b"\n".join(texts)
        raw = np.frombuffer(self.data + b"\n", np.uint8)
        end = np.flatnonzero(raw == 10)
        start = np.concatenate([[0], end[:-1] + 1])
        _trimmed(self.data, raw, start, end)
        own = np.array([t.count(b"\n") + 1 for t in texts])
        text = np.repeat(np.arange(len(texts)), own)
        number = np.arange(len(end)) - np.repeat(np.cumsum(own) - own, own)
        self.points = np.frombuffer(self.data.decode().encode("utf-32-le"), np.uint32)
        if len(self.points) < len(self.data):
            inner = np.flatnonzero((raw & 0xC0) == 0x80)  # bytes that begin no code point
            first, last = start - np.searchsorted(inner, start), end - np.searchsorted(inner, end)
        else:
            first, last = start, end
        use = np.flatnonzero(last - first >= min_chars)
        self.text, self.number, self.bytes = text[use], number[use], list(zip(start[use].tolist(), end[use].tolist()))
        self.start, self.end = first[use], last[use]
        self.length = self.end - self.start
        self._runs = None

    def content(self, use: np.ndarray) -> list[bytes]:
        return [self.data[a:b] for a, b in map(self.bytes.__getitem__, use.tolist())]

    def digests(self, use: np.ndarray | None = None) -> np.ndarray:
        return digest128(self.content(np.arange(len(self.length)) if use is None else use))

    def signature(self, use: np.ndarray) -> np.ndarray:
        """Sixteen counts of code points by class, modulo 16, in 64 bits."""
        if not len(use):
            return np.zeros(0, _U)
        points = np.concatenate([self.points[a:b] for a, b in zip(self.start[use].tolist(), self.end[use].tolist())])
        line = np.repeat(np.arange(0, len(use) * 16, 16), self.length[use])
        counts = np.bincount(line + _classes()[points], minlength=len(use) * 16).reshape(-1, 16).astype(_U) & _U(15)
        return (counts << (np.arange(16, dtype=_U) * _U(4))).sum(axis=1, dtype=_U)

    def segment(self, length: np.ndarray, i: int, shift: int, tau: int) -> tuple[np.ndarray, np.ndarray]:
        """(key, valid) of the substring that stands for segment i of a line of ``length``."""
        if self._runs is None:  # of all code points once, whatever is asked of them
            self._runs = RunHashes(self.points.astype(_U) + _U(1), _BASES[2])
        parts = tau + 1
        base, rest = length // parts, length % parts
        size = base + (i >= parts - rest)
        at = i * base + np.maximum(0, i - (parts - rest)) + shift
        valid = (length >= parts) & (at >= 0) & (at + size <= self.length)
        a = np.where(valid, self.start + at, 0)
        h = self._runs(a, np.where(valid, a + size, 0))
        return mix64(h ^ mix64((length * 16 + i).astype(_U))), valid

    def index_keys(self, tau: int) -> np.ndarray:
        return np.stack([self.segment(self.length, i, 0, tau)[0] for i in range(tau + 1)], axis=1)

    def probes(self, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(key, valid, kind) of all but those equal to the line's own index keys."""
        own = self.index_keys(tau)
        for less in range(tau + 1):
            for i in range(tau + 1):
                for shift in shifts(i, less, tau):
                    if less or shift:
                        key, valid = self.segment(self.length - less, i, shift, tau)
                        yield key, valid & (key != own[:, i]), kind_of(i, less, tau)


def _trimmed(data: bytes, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
    """Takes the white space at both ends off lines."""
    for k in np.flatnonzero((start < end) & (_BLANK[raw[start]] | _BLANK[raw[end - 1]])).tolist():
        line = data[start[k] : end[k]].lstrip(_TRIM)
        start[k] = end[k] - len(line)
        end[k] = start[k] + len(line.rstrip(_TRIM))


@cache
def _classes() -> np.ndarray:
    """The class of each code point in a signature."""
    return (mix64(np.arange(1, 0x110001, dtype=_U)) & _U(15)).astype(np.uint8)


def shifts(i: int, less: int, tau: int) -> range:
    """Where segment i of a line may lie in a line that is ``less`` longer."""
    return range(max(-i, less - (tau - i)), min(i, less + tau - i) + 1)


def kind_of(i: int, less: int, tau: int) -> int:
    return less * (tau + 1) + i


def first_common(x: str, y: str, tau: int) -> int:
    """The first segment of x that y holds at a compatible place (tau + 1: none)."""
    base, rest = divmod(len(x), tau + 1)
    at = 0
    for i in range(tau + 1):
        size = base + (i >= tau + 1 - rest)
        part = x[at : at + size]
        for shift in shifts(i, len(y) - len(x), tau):
            if at + shift >= 0 and y[at + shift : at + shift + size] == part:
                return i
        at += size
    return tau + 1


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, top = 0, min(len(a), len(b))
    while low < top:
        half = (low + top + 1) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            top = half - 1
    return low


def within(a: str, b: str, tau: int) -> bool:
    """Edit distance <= tau, by a bit-parallel automaton in the band around the diagonal."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > tau:
        return False
    cut = _common(a, b)
    a, b = a[cut:], b[cut:]
    cut = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - cut], b[: len(b) - cut]
    if not a:
        return len(b) <= tau
    # bit k of rows[d], having read j of b: with d edits at most it matches the first j - tau + k of a
    rows = [((1 << (d + 1)) - 1) << tau for d in range(tau + 1)]
    full, n = (1 << (2 * tau + 1)) - 1, len(a)
    for j, c in enumerate(b, 1):
        own = 0
        for i in range(max(1, j - tau), min(n, j + tau) + 1):
            if a[i - 1] == c:
                own |= 1 << (i - j + tau)
        before = rows[0]
        rows[0] = before & own
        for d in range(1, tau + 1):
            now = rows[d]
            rows[d] = (now & own | before | before >> 1 | rows[d - 1] << 1) & full
            before = now
        if not rows[tau]:
            return False
    return bool(rows[tau] >> (n - len(b) + tau) & 1)


def _scan(tau: int, min_chars: int, exact_chars: int):
    """All lines that are judged; those for the edit join alone have a signature and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, rk = b.column(0).to_numpy(), b.column(1).to_numpy()
            for ids, texts in text_chunks(range(b.num_rows), b.column(2).cast(pa.binary()).to_pylist()):
                ids = np.array(ids)
                own = Lines(texts, exact_chars)
                at, digests = ids[own.text], own.digests()
                short = own.length < min_chars
                sig = np.zeros(len(short), _U)
                sig[~short] = own.signature(np.flatnonzero(~short))
                keys = own.index_keys(tau).astype(_U).view(np.int64)[~short].ravel()
                ends = np.concatenate([[0], np.cumsum(~short)]) * (tau + 1)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc": pa.array(doc[at]),
                        "rk": pa.array(rk[at]),
                        "line": pa.array(own.number.astype(np.int32)),
                        "h1": pa.array(digests[:, 0]),
                        "h2": pa.array(digests[:, 1]),
                        "sig": pa.array(sig.view(np.int64), mask=short),
                        "keys": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys), mask=pa.array(short)),
                    }
                )

    return run


_ENTRY = "key long, kind int, probe boolean, h1 long, h2 long, sig long"


def _probes(tau: int, min_chars: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in text_chunks(range(b.num_rows), b.column(0).cast(pa.binary()).to_pylist()):
                own = Lines(texts, min_chars)
                key, line, kind = [np.zeros(0, _U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
                for k, valid, what in own.probes(tau):
                    keep = np.flatnonzero(valid)
                    keep = keep[hashes_in(shared.value, k[keep])]
                    key.append(k[keep])
                    line.append(keep)
                    kind.append(np.full(len(keep), what, np.int32))
                # few lines have a probe that may match: only these are digested
                hit, line = np.unique(np.concatenate(line), return_inverse=True)
                digests, sig = own.digests(hit), own.signature(hit)
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array(np.concatenate(key).view(np.int64)),
                        "kind": pa.array(np.concatenate(kind)),
                        "probe": pa.array(np.ones(len(line), bool)),
                        "h1": pa.array(digests[line, 0]),
                        "h2": pa.array(digests[line, 1]),
                        "sig": pa.array(sig[line].view(np.int64)),
                    }
                )

    return run


def _near_pairs(rows: dict[str, np.ndarray], tau: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y) of the pairs of a block that pass the signature: x an index entry that
    counts as one here, y any other line, longer or of a larger id."""
    counts = ((rows["sig"].view(_U)[:, None] >> (np.arange(16, dtype=_U) * _U(4))) & _U(15)).astype(np.int8)
    h1, h2, longer = rows["h1"], rows["h2"], rows["kind"] > tau
    left, right = np.flatnonzero(rows["side"] != 2), np.flatnonzero(rows["side"] != 1)
    left = left[~rows["probe"][left]]
    for a in range(0, len(left), 500):
        for b in range(0, len(right), 500):
            x, y = left[a : a + 500], right[b : b + 500]
            d = (counts[x][:, None, :] - counts[y][None, :, :]) & 15
            near = np.minimum(d, 16 - d).sum(axis=2, dtype=np.int16) <= 2 * tau
            i, j = np.nonzero(near)
            i, j = x[i], y[j]
            same = (h1[i] == h1[j]) & (h2[i] == h2[j])
            ordered = longer[j] | (h1[i] < h1[j]) | ((h1[i] == h1[j]) & (h2[i] < h2[j]))
            yield i[ordered & ~same], j[ordered & ~same]


def _blocks(names: list[str], each, out: pa.Schema):
    """Rows sorted by (key, i, j), the first three columns -> what ``each`` makes of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def made(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            cols = {n: table[n].to_numpy() for n in names if n != "content"}
            cols["probe"] = cols["probe"].astype(bool)
            if "content" in names:
                cols["content"] = table["content"].to_pylist()
            new = np.zeros(table.num_rows, bool)
            new[:1] = True
            for n in names[:3]:
                new[1:] |= cols[n][1:] != cols[n][:-1]
            edge = np.flatnonzero(new)
            size = np.diff(np.append(edge, len(new)))
            found = [x for a, n in zip(edge[size > 1], size[size > 1]) if (x := each({k: v[a : a + n] for k, v in cols.items()})) is not None]
            if not found:
                return pa.RecordBatch.from_pylist([], schema=out)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in found]), f.type) for i, f in enumerate(out)], schema=out)

        for b in batches:
            if not b.num_rows:
                continue
            own = pa.Table.from_batches([b])
            held = pa.concat_tables([held, own]) if held is not None else own
            last = [held[n][held.num_rows - 1].as_py() for n in names[:3]]
            head = [held[n][0].as_py() for n in names[:3]]
            if head != last:  # the last block may go on in the next batch
                same = np.ones(held.num_rows, bool)
                for n, v in zip(names[:3], last):
                    same &= held[n].to_numpy() == v
                cut = int(np.flatnonzero(same)[0])
                yield made(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield made(held)

    return run


_DEALT = ["key", "i", "j", "side", "kind", "probe", "h1", "h2", "sig"]
_DEALT_SCHEMA = pa.schema([("key", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("side", pa.int32()), ("kind", pa.int32()), ("probe", pa.bool_()), ("h1", pa.int64()), ("h2", pa.int64()), ("sig", pa.int64())])
_DEALT_DDL = "key long, i long, j long, side int, kind int, probe boolean, h1 long, h2 long, sig long"


def _with_partner(tau: int):
    """The rows of each block that have a partner by the signature."""

    def each(rows):
        use = np.zeros(len(rows["h1"]), bool)
        for x, y in _near_pairs(rows, tau):
            use[x] = use[y] = True
        return [rows[n][use] for n in _DEALT] if use.any() else None

    return _blocks(_DEALT, each, _DEALT_SCHEMA)


_LINKED_SCHEMA = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("links", pa.int64()), ("doc", pa.int64()), ("rk", pa.int64()), ("line", pa.int32())])


def _linked(tau: int):
    """A row for each line of a block that is linked: its links there, the earliest place linked."""

    def each(rows):
        text, place = rows["content"], list(zip(rows["doc"].tolist(), rows["rk"].tolist(), rows["line"].tolist()))
        kind = rows["kind"].tolist()
        links, least = [0] * len(text), [None] * len(text)
        for xs, ys in _near_pairs(rows, tau):
            for x, y in zip(xs.tolist(), ys.tolist()):
                if first_common(text[x], text[y], tau) == kind[x] and within(text[x], text[y], tau):
                    for a, b in ((x, y), (y, x)):
                        links[a] += 1
                        if least[a] is None or place[b] < least[a]:
                            least[a] = place[b]
        use = [k for k, n in enumerate(links) if n]
        if not use:
            return None
        doc, rk, line = zip(*(least[k] for k in use))
        return [rows["h1"][use], rows["h2"][use], np.array([links[k] for k in use]), np.array(doc), np.array(rk), np.array(line, np.int32)]

    return _blocks([*_DEALT, "content", "doc", "rk", "line"], each, _LINKED_SCHEMA)


def _fetch(min_chars: int, texts_in, lines_in):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(hashes_in(texts_in.value, b.column(0).to_numpy())))
            for _, texts in text_chunks(range(b.num_rows), b.column(1).cast(pa.binary()).to_pylist()):
                own = Lines(texts, min_chars)
                digests = own.digests()
                use = np.flatnonzero(hashes_in(lines_in.value, digests[:, 0]))
                yield pa.RecordBatch.from_pydict({"h1": pa.array(digests[use, 0]), "h2": pa.array(digests[use, 1]), "content": pa.array(own.content(use), pa.binary()).cast(pa.string())})

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*_place(), text.alias("text"))


def _with_company(tau: int, shared):
    """Lines h1, h2, sig, keys -> their entries in buckets that may have another row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(3).flatten().to_numpy()
            at = np.flatnonzero(hashes_in(shared.value, keys))
            line = pa.array(at // (tau + 1))
            kind, probe = (at % (tau + 1)).astype(np.int32), np.zeros(len(at), bool)
            yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(kind), pa.array(probe), *(b.column(i).take(line) for i in range(3))], ["key", "kind", "probe", "h1", "h2", "sig"])

    return run


def _dealt(met: DataFrame, buckets: DataFrame) -> DataFrame:
    """The entries of buckets with company, by (key, i, j). side 0: the whole bucket meets in
    one block; in larger ones 1: an index entry on the left, 2: any line on the right."""
    large = buckets.where(F.col("n") > BUCKET).select("key", F.ceil(F.col("n") / BUCKET).alias("blocks"))
    zero = F.lit(0).cast("long")
    hot = large.count()
    if not hot:
        return met.select("key", zero.alias("i"), zero.alias("j"), F.lit(0).alias("side"), "kind", "probe", "h1", "h2", "sig")
    met = written(met, "line-entries")
    # each of them holds more than BUCKET rows, so there are few
    large = F.broadcast(large) if hot <= 100_000 else large
    marked = met.join(large, "key", "left")
    plain = marked.where("blocks is null").select("key", zero.alias("i"), zero.alias("j"), F.lit(0).alias("side"), "kind", "probe", "h1", "h2", "sig")
    own = F.pmod(F.col("h1"), F.col("blocks"))
    every = F.explode(F.sequence(zero, F.col("blocks") - 1))
    many = marked.where("blocks is not null")
    left = many.where("not probe").select("key", own.alias("i"), every.alias("j"), F.lit(1).alias("side"), "kind", "probe", "h1", "h2", "sig")
    right = many.select("key", every.alias("i"), own.alias("j"), F.lit(2).alias("side"), "kind", "probe", "h1", "h2", "sig")
    return plain.unionAll(left).unionAll(right)


def edit_links(lines: DataFrame, rows: DataFrame, tau: int, min_chars: int) -> DataFrame:
    """lines: h1, h2, first, sig, keys, one row a different line; rows: rk, text -> h1, h2, links,
    least: how many different lines are within tau edits, and the earliest place of one."""
    entries = lines.select(F.explode("keys").alias("key"))
    index = HashFilter(entries, "key", expected=lines.count() * (tau + 1))
    probes = written(rows.select("text").mapInArrow(_probes(tau, min_chars, index.shared), _ENTRY).distinct(), "line-probes")
    index.done()
    buckets = written(entries.unionAll(probes.select("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "line-buckets")
    # most index entries are alone in their bucket; these are kept out of the shuffle
    company = HashFilter(buckets, "key", expected=buckets.count())
    met = lines.select("h1", "h2", "sig", "keys").mapInArrow(_with_company(tau, company.shared), _ENTRY).unionAll(probes)
    met = _dealt(met, buckets).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    some = written(met.mapInArrow(_with_partner(tau), _DEALT_DDL), "line-partners")
    company.done()
    places = written(lines.join(some.select("h1", "h2").distinct(), ["h1", "h2"]).select("h1", "h2", "first.*"), "line-places")
    # the earliest text that holds a line is read again for it
    texts_in, lines_in = HashFilter(places, "rk"), HashFilter(places, "h1")
    fetched = rows.select("rk", "text").mapInArrow(_fetch(min_chars, texts_in.shared, lines_in.shared), "h1 long, h2 long, content string")
    content = written(places.join(fetched.distinct(), ["h1", "h2"]), "line-texts")
    for x in (texts_in, lines_in):
        x.done()
    fed = some.join(content, ["h1", "h2"]).select(*_DEALT, "content", "doc", "rk", "line")
    fed = fed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = fed.mapInArrow(_linked(tau), "h1 long, h2 long, links long, doc long, rk long, line int")
    return found.groupBy("h1", "h2").agg(F.sum("links").alias("links"), F.min(F.struct("doc", "rk", "line")).alias("least"))


def repeated_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """doc, rk, lines array<int>, n_links: the lines of each text that go; rk is
    xxhash64(doc_id, text), doc the doc_id with the largest long for null."""
    rows = _keyed(docs)
    kinds = "doc long, rk long, line int, h1 long, h2 long, sig long, keys array<long>"
    occurrences = written(rows.mapInArrow(_scan(tau, min_chars, min_chars if exact_chars is None else max(1, exact_chars)), kinds), "lines")
    place = F.struct("doc", "rk", "line")
    lines = occurrences.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    lines = written(lines, "distinct-lines")
    near = edit_links(lines.where("keys is not null"), rows, tau, min_chars)
    judged = lines.select("h1", "h2", "first", "n").join(near, ["h1", "h2"], "left").where("n > 1 or links > 0")
    judged = judged.select("h1", "h2", "first", F.coalesce(F.col("least") < F.col("first"), F.lit(False)).alias("late"), F.coalesce("links", F.lit(0)).alias("links"))
    found = occurrences.select("doc", "rk", "line", "h1", "h2").join(judged, ["h1", "h2"]).where(F.col("late") | (F.col("links") > 0) | (place > F.col("first")))
    gone = F.collect_set(F.when(F.col("late") | (place > F.col("first")), F.col("line")))  # at most a text's lines
    return found.groupBy("doc", "rk").agg(gone.alias("lines"), F.sum("links").cast("long").alias("n_links"))


def _inside(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(hashes_in(shared.value, b.column(0).to_numpy())))

    return run


def _place() -> tuple:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("doc_id", "text").alias("rk")


def kept_text(text: str, gone) -> str:
    drop = set(gone)
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)


def _digest(shared=None):
    """n_lines, n_dropped, n_links and the digest of what is kept; with a filter, of the rows outside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if shared is not None:
                b = b.filter(pa.array(~hashes_in(shared.value, b.column(0).to_numpy())))
            texts = b.column(2).to_pylist()
            gone = b.column(3).to_pylist() if shared is None else [()] * len(texts)
            kept = [kept_text(t, g) if g else t for t, g in zip(texts, gone)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column(1),
                    "n_lines": pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
                    "n_dropped": pa.array([len(g or ()) for g in gone], pa.int64()),
                    "n_links": b.column(4) if shared is None else pa.array([0] * len(texts), pa.int64()),
                    "kept_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in kept], pa.string()),
                }
            )

    return run


def line_digests(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, n_links, kept_sha256: a row for each row of ``docs``."""
    marks = written(repeated_lines(docs, tau, min_chars, exact_chars), "line-marks")
    wanted = HashFilter(marks.select("rk"), "rk")
    doc, rk = _place()
    rows = docs.select(rk, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), doc)
    kinds = "doc_id long, n_lines long, n_dropped long, n_links long, kept_sha256 string"
    clean = rows.mapInArrow(_digest(wanted.shared), kinds)
    touched = rows.mapInArrow(_inside(wanted.shared), "rk long, doc_id long, text string, doc long").join(marks, ["doc", "rk"], "left")
    touched = touched.select("rk", "doc_id", "text", "lines", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return clean.unionAll(touched.mapInArrow(_digest(), kinds))


def drop_repeated_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """The rows and columns of ``docs`` with the texts that stay; a document none of whose
    lines with a word stays, though it had some, goes."""
    marks = repeated_lines(docs, tau, min_chars, exact_chars).select("doc", "rk", "lines")
    own = docs.select(*_place(), "text", F.struct(*docs.columns).alias("row"))  # so that no name clashes
    joined = own.join(marks, ["doc", "rk"], "left")
    stay = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col("lines"), i))
    joined = joined.withColumn("left", F.when(F.size("lines") > 0, F.array_join(stay, "\n")).otherwise(F.col("text")))
    emptied = (F.size("lines") > 0) & ~F.col("left").rlike(r"[^\x20\x09-\x0D]")
    kept = joined.where(~F.coalesce(emptied, F.lit(False)))
    return kept.select(*[F.col("left").alias("text") if c == "text" else F.col(f"row.{c}") for c in docs.columns])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(read_table(spark, sf_dir, "documents"), exact_chars=EXACT_CHARS)
