"""The training-data operators: brute force, round trips and edge cases on small fixtures."""

import hashlib
import json
import math
import os
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from conftest import oracle, same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from coreloom.llm import ann, chat_format, exact_dedup, language_id, line_dedup, lm_scoring, minhash, mixing, packing, queries, substring_dedup
from coreloom.llm.hashing import Words, digest128, mix64, sliding_min

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(parts)


def words(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def thue_morse(a, b, n=1024):
    """Two different strings that every polynomial hash modulo 2**64 takes for one."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


EDGE = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c d e f"), (4, "x"), (4, "x"), (5, "é ü 中文 word"), (6, "long " * 30_000)]


@tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    same(queries.QUERIES[name](spark, SF).toPandas(), oracle(queries.ORACLES[name], SF))


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


# 1


def brute_windows(rows, n):
    seen, out = {}, []
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        own = [tuple(w[s : s + n]) for s in range(len(w) - n + 1)]
        for s, k in enumerate(own):
            if seen.get(k, i) < i:
                gone[s : s + n] = True
        for k in own:
            seen.setdefault(k, i)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_substrings_brute_force(spark, batches):
    r = random.Random(batches)
    shared = [words(r, k) for k in (12, 15, 40)]
    rows = [(i, " ".join([words(r, r.randrange(30)), r.choice(shared), words(r, r.randrange(20)), r.choice(shared)[: r.randrange(400)]])) for i in range(60)]
    rows += [(100, "a " * 50), (101, "a " * 33 + "b"), (102, rows[3][1]), (103, rows[3][1])]
    got = substring_dedup.dedup_substrings(docs(spark, rows), 10, 4, batches).drop("kept").collect()
    assert sorted(map(tuple, got)) == brute_windows(rows, 10)


@pytest.mark.parametrize("batches", [1, 2])
def test_substrings_in_a_repeated_section(spark, batches):
    r = random.Random(21)
    passage = words(r, 14, 10**6)
    section = " ".join([words(r, 20, 10**6), passage, words(r, 20, 10**6)])
    rows = [(1, " ".join([words(r, 25, 10**6), passage, words(r, 25, 10**6)])), (2, f"{section} {section} {section}"), (4, words(r, 60, 10**6))]
    got = sorted(map(tuple, substring_dedup.dedup_substrings(docs(spark, rows), 10, 4, batches).drop("kept").collect()))
    assert got == brute_windows(rows, 10) and got[1][2] == 3 * 14
    twice = [*rows, (2, f"another row {section}")]  # a second row of the document
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.dedup_substrings(docs(spark, twice), 10, 4, batches).collect())
    assert [x[2] for x in got] == [0, 14, 42, 0]


def batch_of(spark, rows):
    return spark.createDataFrame([(k, k, t) for k, t in rows], "doc long, rk long, text string")


def marked_windows(found):
    return {(r["doc"], r["start"] + i) for r in found.collect() for i in range(r["n"])}


def test_index_is_opened_again_and_compacts(spark, tmp_path):
    """A new object on the same folder goes on where the last one stopped."""
    r = random.Random(4)
    shared = words(r, 25, 10**6)
    texts = [(k, " ".join([words(r, 8), shared if k % 2 else words(r, 25), words(r, 8)])) for k in range(12)]
    got, seen = set(), []
    for k in range(0, 12, 3):
        index = substring_dedup.FingerprintIndex(spark, f"{tmp_path}/index", 10, 4, fan_in=3)
        assert index.version == len(seen)
        got |= marked_windows(index.ingest(batch_of(spark, texts[k : k + 3])))
        seen = [0] * index.version
        assert len(index.tables) < 3
    assert index.version == 4 + 1  # four batches, one compaction
    assert index.tables[0].select("d1", "d2").distinct().count() == index.tables[0].count()
    want, first = set(), {}
    for k, t in texts:
        w = t.split()
        for s in range(len(w) - 9):
            if first.setdefault(tuple(w[s : s + 10]), k) < k:
                want.add((k, s))
    assert got == want and want
    plan = index.tables[0].join(index.tables[-1].select("d1", "d2", F.col("doc").alias("d")), ["d1", "d2"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_words_equal_by_hash_alone_stay(spark):
    a, b = thue_morse("a", "b")
    r = random.Random(2)
    some = words(r, 60, 10**6)
    rows = [(1, f"{some} {a} z"), (2, f"{some} {b} z"), (3, " ".join([a] * 60)), (4, " ".join([b] * 60))]
    got = sorted(map(tuple, substring_dedup.dedup_substrings(docs(spark, rows)).drop("kept").collect()))
    assert got == brute_windows(rows, 50) and [x[2] for x in got] == [0, 60, 0, 0]


def test_substrings_edges(spark):
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(docs(spark, EDGE), 5, 2).collect()}
    assert got[1]["n_words"] == 0 and got[4]["n_removed"] == 0 and got[6]["n_words"] == 30_000
    assert substring_dedup.dedup_substrings(docs(spark, EDGE).limit(0)).count() == 0


@given(st.lists(st.integers(0, 5), min_size=1, max_size=40), st.integers(1, 12))
def test_sliding_min(x, width):
    if width <= len(x):
        assert list(sliding_min(np.array(x), width)) == [min(x[i : i + width]) for i in range(len(x) - width + 1)]


@settings(max_examples=60)
@given(st.lists(st.text(alphabet="ab \t\n\x0b\x0c\r\x1c\x85é", max_size=12), min_size=1, max_size=5))
def test_words_are_those_of_the_pattern(texts):
    w = Words([t.encode() for t in texts])
    assert list(np.diff(w.first)) == [len(t.encode().split()) for t in texts]
    flat = [x for t in texts for x in t.encode().split()]
    assert len(set(zip(flat, w.hash.tolist()))) == len(set(flat)) == len(set(w.hash.tolist()))


def test_structured_strings_stay_apart():
    a, b = thue_morse("a", "b")
    w = Words([f"{a} {b} {a}x {b}x".encode()])
    assert len(set(w.hash.tolist())) == 4
    runs = Words([x.replace("a", "one ").replace("b", "two ").encode() for x in (a, b)])
    windows, _ = runs.windows(1024)
    assert windows[0] != windows[1024]


# 2


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400)
@given(st.text(alphabet="abé", max_size=9), st.text(alphabet="abé", max_size=9), st.integers(0, 3))
def test_banded_distance(a, b, tau):
    assert line_dedup.within(a, b, tau) == (distance(a, b) <= tau)


@pytest.mark.parametrize("bucket", [4000, 6])
def test_lines_brute_force(spark, bucket, monkeypatch):
    monkeypatch.setattr(line_dedup, "BUCKET", bucket)
    r = random.Random(2)
    base = ["".join(r.choice("abcdé ") for _ in range(r.randrange(6, 24))).strip() for _ in range(40)]

    def edited(x):
        x = list(x)
        for _ in range(r.randrange(4)):
            k = r.randrange(len(x) + 1)
            if r.random() < 0.4 or not x:
                x.insert(k, r.choice("abcdé"))
            elif r.random() < 0.5:
                x.pop(min(k, len(x) - 1))
            else:
                x[min(k, len(x) - 1)] = "z"
        return "".join(x)

    rows = [(i, "\n".join(edited(r.choice(base)) for _ in range(r.randrange(1, 6)))) for i in range(80)]
    least, first, seen = 8, {}, []
    for i, t in rows:
        for k, line in enumerate(t.split("\n")):
            line = line.strip(" \t\r\x0b\x0c")
            if len(line) >= least:
                seen.append((i, k, line))
                first.setdefault(line, (i, k))
    near = {a: [b for b in first if b != a and distance(a, b) <= 2] for a in first}
    want = []
    for i, t in rows:
        own = [(k, x) for d, k, x in seen if d == i]
        gone = {k for k, x in own if first[x] != (i, k) or any(first[b] < first[x] for b in near[x])}
        kept = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        want.append((i, t.count("\n") + 1 if t else 0, len(gone), sum(len(near[x]) for _, x in own), hashlib.sha256(kept.encode()).hexdigest()))
    got = sorted(map(tuple, line_dedup.line_digests(docs(spark, rows), 2, least).collect()))
    assert got == want and sum(x[2] for x in want) > 40


def test_lines_edges(spark):
    rows = [*EDGE, (7, "this line is long enough\nshort"), (8, "short\nthis line is long enough!"), (9, "this line is long enough")]
    got = {r["doc_id"]: r for r in line_dedup.line_digests(docs(spark, rows)).collect()}
    assert (got[7]["n_dropped"], got[8]["n_dropped"], got[9]["n_dropped"], got[1]["n_lines"]) == (0, 1, 1, 0)
    left = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(docs(spark, rows)).collect()}
    assert left[8] == "short" and 9 not in left and left[1] is None and left[2] == ""
    assert line_dedup.line_digests(docs(spark, EDGE).limit(0)).count() == 0


def test_lines_equal_by_hash_alone_stay(spark):
    a, b = thue_morse("a", "b")
    rows = [(1, f"{a}\nthis line is long enough"), (2, f"{b}\nthis line is long enough")]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_digests(docs(spark, rows)).collect()}
    assert got == {1: 0, 2: 1}


def test_near_lines_give_a_row_each(spark):
    """n lines within two edits of each other: n rows come out of the buckets, not n * n."""
    r = random.Random(6)
    base = "the same line with a number in it and a few words more"
    places = r.sample([(i, c) for i in range(len(base)) for c in "0123456789"], 300)
    rows = [(k, base[:i] + c + base[i + 1 :]) for k, (i, c) in enumerate(places)]
    own = docs(spark, rows)
    got = {x["doc_id"]: (x["n_dropped"], x["n_links"]) for x in line_dedup.line_digests(own).collect()}
    assert got == {k: (int(k > 0), 299) for k in range(300)}


def test_short_lines_go_by_equality(spark, tmp_path):
    rows = [(1, "Read more\n\n第一章 开始\na line that is long enough"), (2, "Read more\n\n第一章 开始\nRead mare\nx"), (3, " x \nown"), (None, "x\nlast"), (7, "a line that is long enough!")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in line_dedup.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert {i: (r["n_lines"], r["n_dropped"], r["n_links"]) for i, r in got.items()} == {1: (4, 0, 1), 2: (5, 2, 0), 3: (2, 1, 0), None: (2, 1, 0), 7: (1, 1, 1)}
    import corpus_pipeline

    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, docs(spark, rows), "").collect()}
    assert left == {1: rows[0][1], 2: "\nRead mare\nx", 3: "own", None: "last"}
    assert got[2]["kept_sha256"] == hashlib.sha256(left[2].encode()).hexdigest()


@settings(max_examples=200)
@given(st.lists(st.text(alphabet="ab \t\n\x0b\x0c\r\x1c\x85é第𝄞", max_size=14), min_size=1, max_size=5), st.integers(0, 3))
def test_lines_are_those_of_the_strings(texts, least):
    own = line_dedup.Lines([t.encode() for t in texts], least)
    want = [(i, k, x.strip(" \t\r\x0b\x0c")) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n"))]
    want = [x for x in want if len(x[2]) >= least]
    every = np.arange(len(want))
    assert list(zip(own.text.tolist(), own.number.tolist(), [x.decode() for x in own.content(every)])) == want
    assert own.length.tolist() == [len(x) for _, _, x in want]
    kind = mix64(np.arange(1, 0x110001, dtype=np.uint64)) & np.uint64(15)
    counts = [np.bincount(kind[np.array([ord(c) for c in x], int)].astype(int), minlength=16) % 16 for _, _, x in want]
    assert own.signature(every).tolist() == [sum(int(n) << 4 * k for k, n in enumerate(c)) for c in counts]
    one = [line_dedup.Lines([x.encode()], 0).index_keys(2)[0].tolist() for _, _, x in want if x]
    assert own.index_keys(2)[own.length > 0].tolist() == one  # a segment's key holds wherever it lies


def test_lines_without_a_probe_are_not_digested(monkeypatch):
    import pyarrow as pa

    texts = [f"line number {i} of a text\nthat is long enough to be probed {i * i}" for i in range(50)]
    batch, found = pa.RecordBatch.from_pydict({"text": pa.array(texts)}), []
    monkeypatch.setattr(line_dedup, "digest128", lambda parts: found.extend(parts := list(parts)) or digest128(parts))
    rows = lambda bits: sum(b.num_rows for b in line_dedup._probes(2, 20, SimpleNamespace(value=bits))(iter([batch])))
    assert rows(bytes(8)) == 0 and not found
    assert rows(b"\xff" * 8) > 100 and len(found) == 100


@pytest.mark.parametrize("bucket", [4000, 2])
def test_lone_entries_stay_out_of_the_shuffle(spark, bucket, monkeypatch):
    r = random.Random(8)
    rows = [(i, "".join(r.choice("abcdefgh ") for _ in range(60)).strip()) for i in range(300)]
    rows += [(300, rows[7][1] + "x"), (301, "y" + rows[7][1])]
    met, dealt = [], line_dedup._dealt
    monkeypatch.setattr(line_dedup, "BUCKET", bucket)
    monkeypatch.setattr(line_dedup, "_dealt", lambda some, *a: met.append(some.count()) or dealt(some, *a))
    got = {x["doc_id"]: (x["n_dropped"], x["n_links"]) for x in line_dedup.line_digests(docs(spark, rows)).collect()}
    assert got == {i: (int(i >= 300), 2 * (i in (7, 300, 301))) for i in range(302)}
    assert met[0] < 30  # of 906 index entries


# 3


def check_packing(rows, texts, size):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in texts:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), size):
            want.append((i, k // size, k, len(ids[k : k + size]), zlib.crc32(np.array(ids[k : k + size], "<u4").tobytes())))
    key = lambda x: (x[0] is None, x)
    assert sorted((tuple(r)[:5] for r in rows), key=lambda x: str(x)) == sorted(want, key=lambda x: str(x))
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(by), sum(r["length"] for r in rows)


def test_packing(spark):
    r = random.Random(1)
    texts = [*EDGE, *((10 + i, words(r, r.randrange(1, 120))) for i in range(300))]
    rows = packing.pack(docs(spark, texts), size=128).collect()
    used, tokens = check_packing(rows, texts, 128)
    assert used <= math.ceil(tokens / 128) * 1.02 + 2
    assert packing.pack(docs(spark, EDGE).limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_holds_every_piece_once(histogram):
    plan = packing.make_plan(histogram, 64, 4)
    assert all(sum(lengths) <= 64 for lengths, _ in plan)
    found = Counter()
    for lengths, n in plan:
        for length in lengths:
            found[length] += n
    assert found == Counter(histogram)


def test_nnls_is_optimal():
    draw = np.random.default_rng(3)
    a, b = draw.random((12, 20)), draw.random(12) * 5
    x = packing.nnls(a, b)
    slope = a.T @ (a @ x - b)
    assert (x >= 0).all() and (slope > -1e-6).all() and abs(slope @ x) < 1e-6


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=list("abXY'stSd .,\n\t09éÉßñ²½µªİıΣςσ́̇\x85\x1c中<|>"), max_size=25))
def test_word_encoder_is_the_tokenizer(text):
    coder = packing.encoder(None)
    want = coder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(coder.encode(text.encode()), "<u4").tolist() == want


# 4


def test_mix_targets_and_limits(spark):
    r = random.Random(5)
    rows = [(i, words(r, r.randrange(0, 60)), "en", s, 0) for i, s in enumerate(["a"] * 30 + ["b"] * 200 + [None] * 150 + [""] * 20)]
    own = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_sources(own).collect()
    assert len(got) == 400 and all(x["taken"] <= 3 * x["size"] for x in got)
    source = {r[0]: r[3] for r in rows}
    taken, target, size = Counter(), {}, {}
    for x in got:
        s = source[x["doc_id"]]
        taken[s] += x["taken"]
        target[s], size[s] = x["target"], x["source_size"]
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    assert target["a"] <= 3 * size["a"] and all(abs(taken[s] - target[s]) <= 31 for s in target)
    again = mixing.mix_sources(own.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    with pytest.raises(Exception, match="use mixed_rows"):
        mixing.repeated(own.unionAll(own), mixing.mix_sources(own.unionAll(own))).count()
    whole = mixing.repeated(own, mixing.mix_sources(own))
    assert whole.columns == own.columns and whole.count() == sum(x["taken"] // x["size"] for x in got if x["size"])


def test_mix_of_rows_that_share_an_id(spark):
    import corpus_pipeline

    r = random.Random(8)
    rows = [(i, f"t{n} {words(r, 9)}", "en", s, 0) for n, (i, s) in enumerate([(1, "a")] * 4 + [(None, "a")] * 5 + [(None, "b")] * 30 + [(2, "b")] * 20 + [(k, None) for k in range(40)])]
    own = spark.createDataFrame(rows, DOCS).repartition(3)
    plan = mixing.mix_sources(own).collect()
    out = corpus_pipeline.mix(spark, own, "")
    assert out.columns == own.columns
    copies = Counter(map(tuple, out.collect()))
    assert set(copies) <= set(rows) and max(copies.values()) == 3
    assert sum(copies.values()) == sum(x["taken"] // x["size"] for x in plan if x["size"])


def test_mix_bins_are_even_and_quality_counts(spark):
    """Bad documents, however bad, fill no bin; good ones are taken first."""
    r = random.Random(4)
    rows = [(i, words(r, 20), "en", "a", 0) for i in range(4000)] + [(9000 + i, words(r, 20), "en", "b", 0) for i in range(1500)]
    own = spark.createDataFrame(rows, DOCS)
    key = -F.log(1.0 - mixing.uniform(7, F.col("doc_id"))) / F.lit(1 / 11)
    keyed = own.select("doc_id", F.lit("=a").alias("s"), key.alias("key"))
    sizes = [x["n"] for x in mixing._binned(keyed).groupBy("bin").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 5500 / mixing.COARSE * 1.5 and len(sizes) > 500
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 4000)] + [(5, 0), (None, 1)], "doc_id long, quality int")
    got = mixing.mix_sources(own, weights=(1, 1), labels=labels).collect()
    share = lambda odd: sum(x["taken"] // 20 for x in got if x["doc_id"] < 4000 and x["doc_id"] % 2 == odd)
    assert share(1) > 1.5 * share(0)


def test_mix_edges(spark):
    got = mixing.mix_sources(docs(spark, EDGE)).collect()
    assert len(got) == len(EDGE) and all(x["taken"] == x["size"] for x in got)
    assert mixing.mix_sources(docs(spark, EDGE).limit(0)).count() == 0


# 5


def test_exact_groups(spark):
    rows = [(5, "a b"), (3, "ab"), (9, "a\nb "), (4, None), (2, " "), (7, "A b"), (None, "zz"), (8, "zz"), (8, "zz"), (1, "unique " * 5000)]
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs(spark, rows)).collect())
    assert got == sorted([(5, 9, 3, False), (3, 9, 3, False), (9, 9, 3, True), (4, 2, 2, False), (2, 2, 2, True), (7, 7, 1, True), (-1, 8, 3, False), (8, 8, 3, True), (8, 8, 3, True), (1, 1, 1, True)])
    assert exact_dedup.exact_groups(docs(spark, rows).limit(0)).count() == 0


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60))
def test_rice_round_trip(values):
    x = np.sort(np.array(values, np.uint64))
    assert (exact_dedup.rice_decode(len(x), *exact_dedup.rice_encode(x)) == x).all()


# 6


def brute_score(own, one, two, three, train, n, v):
    """log10 P by the three formulas; counts of tokens, pairs and triples."""
    total, context = 0.0, one | {b"\r": train}
    for i, w in enumerate(own):
        p = (one[w] + 0.1) / (n + 0.1 * (v + 1))
        b = own[i - 1] if i else b"\r"
        p = (two[b, w] + lm_scoring.K[0] * p) / (context.get(b, 0) + lm_scoring.K[0])
        a = None if not i else own[i - 2] if i > 1 else b"\r"
        if a is not None and two[a, b] >= lm_scoring.CONTEXT:
            p = (three[a, b, w] + lm_scoring.K[1] * p) / (two[a, b] + lm_scoring.K[1])
        total += math.log10(p)
    return total


@pytest.mark.parametrize("shard", [5 << 20, 900])
def test_scores_brute_force(spark, shard, monkeypatch):
    monkeypatch.setattr(lm_scoring.shards, "__defaults__", (shard,))
    r = random.Random(6)
    texts = [(i, (words(r, r.randrange(0, 50), 25) + " The THEÉ").strip()) for i in range(80)] + [(200, None), (201, "")]
    got = {x["doc_id"]: x for x in lm_scoring.score_texts(docs(spark, texts), lm_scoring.fold() != 0).collect()}
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    tokens = {i: [*(t or "").encode().translate(lower).split(), b"\n"] for i, t in texts}
    train = {i for i in tokens if zlib.crc32(str(i).encode()) % 10}
    one, two, three = Counter(), Counter(), Counter()
    for i in train:
        own = [b"\r", *tokens[i]]
        one.update(tokens[i])
        two.update(zip(own, own[1:]))
        three.update(zip(own, own[1:], own[2:]))
    n, v = sum(one.values()), len(one)
    for i, own in tokens.items():
        p = [(one[t] + 0.1) / (n + 0.1 * (v + 1)) for t in own]
        x = got[i]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (i not in train, len(own), sum(one[t] > 0 for t in own), n)
        assert x["base_score"] == pytest.approx(sum(map(math.log10, p))) and x["score"] == pytest.approx(brute_score(own, one, two, three, len(train), n, v))


@pytest.mark.parametrize("few", [0, 3, 99])
def test_traversal_is_one_however_it_advances(few):
    """States carried together or text by text give the same sums; probabilities add up to one."""
    import pyarrow as pa
    import zstandard

    r = random.Random(1)
    texts = [" ".join(r.choice("abcd") for _ in range(r.randrange(30))) for _ in range(20)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(20)), "train": [True] * 20, "text": texts})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    own = lm_scoring.ShardTokens(zstandard.compress(sink.getvalue().to_pybytes()))
    one = np.bincount(own.token_at, minlength=len(own.tokens)).astype(np.int64)
    one[own.start] = 20
    pairs = np.bincount(own.pair_at, minlength=len(own.pairs))
    triples = own.triples(pairs)
    n, v = len(own.cur), 5
    model = lm_scoring.BackoffAutomaton(own, one, pairs, np.bincount(triples[2], minlength=len(triples[1])), triples, n, v)
    tokens = [[*t.split(), "."] for t in texts]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for t in tokens:
        own_t = [b"\r", *t]
        c1.update(t), c2.update(zip(own_t, t)), c3.update(zip(own_t, t, t[1:]))
    want = [brute_score(t, c1, c2, c3, 20, n, v) for t in tokens]
    assert model.traverse(own.first, own.counts, few) == pytest.approx(want)
    for head in (["a"], ["a", "b"], ["b", "b"]):  # all next tokens, an unknown one included
        p = [10 ** (brute_score([*head, w], c1, c2, c3, 20, n, v) - brute_score(head, c1, c2, c3, 20, n, v)) for w in ["a", "b", "c", "d", ".", "?"]]
        assert sum(p) == pytest.approx(1.0)


def test_scores_edges(spark):
    got = lm_scoring.score_texts(docs(spark, EDGE), lm_scoring.fold() != 0)
    assert got.count() == len(EDGE) and got.where("score is null or score > 0").count() == 0
    assert lm_scoring.score_texts(docs(spark, EDGE).limit(0), lm_scoring.fold() != 0).count() == 0


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=50))
def test_packed_round_trip(values):
    x = np.array(values, np.uint64)
    assert (lm_scoring.unpacked(lm_scoring.packed(x), np.uint64) == x).all()


# 7


@tables
def test_language_held_out(spark):
    rows = queries.QUERIES["op7_language_id"](spark, SF)
    own = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = rows.where("held_out").join(own, "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count()
    assert rows.where("score < 0 or score > 1").count() == 0


def test_filter_counts_are_those_of_sets():
    """Corrected counts against exact sets of n-grams, texts of three made-up languages."""
    r = random.Random(7)
    letters = ["abcdefgh", "efghijklm", "lmnopqrs"]
    text = lambda k, n: " ".join("".join(r.choice(letters[k]) for _ in range(r.randrange(2, 8))) for _ in range(n))
    known = {k: np.unique(language_id.grams([text(k, 400).encode()])[0]) for k in range(3)}
    filters = language_id.Filters(["x", "y", "z"], "x", known)
    texts = [text(k % 3, r.randrange(0, 60)).encode() for k in range(40)] + [b""]
    g, ends = language_id.grams(texts)
    got = filters.counts(g, ends)
    for i, own in enumerate(np.split(g, ends[:-1])):
        exact = [int(np.isin(own, known[k]).sum()) for k in range(3)]
        assert got[i] == pytest.approx(exact, abs=1 + 0.01 * len(own))


def test_language_of_most_documents_first_by_name(spark):
    rows = [(i, "abc def", "bb" if i % 2 else "aa", "s", 0) for i in range(8)]
    assert language_id.learn(spark.createDataFrame(rows, DOCS)).most == "aa"


def test_language_edges(spark):
    rows = docs(spark, [*EDGE, (20, "123 ... !!!"), (21, "ж")])
    got = {r["doc_id"]: r for r in language_id.predict(rows.withColumn("score", F.lit("mine")), language_id.learn(rows)).collect()}
    assert got[1]["lang_pred"] == got[20]["lang_pred"] == got[3]["lang_pred"] == "und" and got[20]["score"] == 0
    assert got[21]["lang_pred"] == "en" and got[5]["lang_pred"] == "en"
    none = language_id.predict(rows, language_id.learn(rows.where("false")))
    assert none.where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(rows.limit(0), language_id.learn(rows)).count() == 0


def test_many_languages(spark):
    r = random.Random(7)
    rows = [(i, " ".join("".join(r.choice(f"abcd{chr(101 + k // 12)}{chr(104 + k % 12)}") for _ in range(6)) for _ in range(80)), f"l{k:03}", "s", 0) for i, k in enumerate(k for k in range(70) for _ in range(4))]
    frame = spark.createDataFrame(rows, DOCS)
    got = language_id.predict(frame, language_id.learn(frame))
    assert got.where("lang = lang_pred").count() > 0.9 * len(rows)


# 8


def test_neighbours_recall_and_order(spark):
    draw = np.random.default_rng(8)
    x = draw.normal(size=(1500, 16)) + np.repeat(draw.normal(size=(15, 16)) * 2, 100, axis=0)
    x[700:1100] = x[700]  # a hot vector
    rows = [(i, [float(v) for v in y]) for i, y in enumerate(x)] + [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [1.0]), (None, [1.0] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    hit = total = 0
    for q in range(0, 1500, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        own = [r for r in got if r["query_id"] == q]
        assert [r["rank"] for r in own] == list(range(1, 11)) and all(abs(d[r["vec_id"]] - r["score"]) < 1e-12 for r in own)
        assert [(r["score"], r["vec_id"]) for r in own] == sorted((r["score"], r["vec_id"]) for r in own)
        hit, total = hit + len({r["vec_id"] for r in own} & set(best)), total + 10
    assert hit / total >= 0.9 and {r["query_id"] for r in got} == set(range(0, 1500, 50))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_recall_of_queries_that_were_not_calibrated_on(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for x in ann.search(rows, F.col("vec_id") % 7 == 3, probe_queries=40).collect():
        got.setdefault(x["query_id"], set()).add(x["vec_id"])
    every = ann.usable(rows).collect()
    ids, v = np.array([x["vec_id"] for x in every]), np.array([x["v"] for x in every])
    queries = ann.usable(rows).where("vec_id % 7 = 3")
    probes = {x["vec_id"] for x in queries.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(40).collect()}
    hit, total = 0, 0
    for q in set(got) - probes:
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
        best = [ids[i] for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hit, total = hit + len(got[q] & set(best)), total + 10
    assert total > 2000 and hit / total >= 0.9


def test_vectors_of_two_lengths(spark):
    rows = [(i, [float(i), 1.0]) for i in range(8)] + [(100 + i, [float(i), 1.0, 2.0]) for i in range(5)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(0, 100), k=3).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (100, 1, 101), (100, 2, 102), (100, 3, 103)]


def test_few_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0])] * 15 + [(1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = ann.search(frame, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["rank"]) for r in got] == [(2, 1), (1, 2)]
    assert ann.search(frame.limit(0), F.col("vec_id") == 0).count() == 0
    assert ann.search(frame, F.col("vec_id") == 77).count() == 0


# 9


def brute_classes(rows, n=5, least=0.8):
    bags = {}
    for i, t in rows:
        w = (t or "").encode().split()
        bags[i] = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else Counter([tuple(w)] if w else [])
    up = {i: i for i in bags}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(bags)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            low = sum((bags[a] & bags[b]).values())
            high = sum(bags[a].values()) + sum(bags[b].values()) - low
            if low and low >= least * high:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in bags}


@pytest.mark.parametrize("group", [1000, 7])
def test_near_duplicates_brute_force(spark, group, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP", group)
    r = random.Random(9)
    base = [words(r, 120) for _ in range(8)]

    def copy(t):
        w = t.split()
        for _ in range(r.choice((0, 1, 1, 2, 4))):
            w[r.randrange(len(w))] = "new" + str(r.randrange(999))
        return " ".join(w)

    rows = [(i, copy(r.choice(base))) for i in range(150)] + [(300, words(r, 4)), (301, ""), (302, None), (303, "a b"), (304, "a  b"), (305, "x " * 200), (306, "x " * 190), (307, "x " * 100)]
    got = {x["doc_id"]: x["class_id"] for x in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_signature_estimates_weighted_jaccard():
    r = random.Random(10)
    a = " ".join(f"w{r.randrange(30)}" for _ in range(400))
    b = " ".join(a.split()[:300] + [f"w{r.randrange(30)}" for _ in range(60)])
    text, shingle, weight = minhash.multisets([a.encode(), b.encode()], 1)
    sig = minhash.signatures(text, shingle, weight, 2, 4096)
    x, y = Counter(a.split()), Counter(b.split())
    want = sum((x & y).values()) / sum((x | y).values())
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.03)


def test_near_edges(spark):
    got = minhash.near_duplicates(docs(spark, [*EDGE, (None, "a b c d e f")])).collect()
    assert len(got) == len(EDGE) + 1 and [r["doc_id"] for r in got if not r["kept"]] == [4]  # one of its two rows
    assert {r["class_id"] for r in got} == {r["doc_id"] for r in got}
    assert minhash.near_duplicates(docs(spark, EDGE).limit(0)).count() == 0


def test_words_with_one_hash_are_two_classes(spark):
    a, b = thue_morse("a", "b")
    rows = [(1, " ".join([a] * 60)), (2, " ".join([b] * 60)), (3, " ".join([b] * 60))]
    got = {x["doc_id"]: x["class_id"] for x in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def test_a_star_of_like_documents_is_linear(spark, monkeypatch):
    """400 near copies in groups of 20: each text is fed to the verification once, leaders a group."""
    monkeypatch.setattr(minhash, "GROUP", 20)
    r = random.Random(3)
    base = words(r, 300, 10**6).split()
    rows = [(k, " ".join(base[:k] + [f"n{k}"] + base[k + 1 :]) if k else " ".join(base)) for k in range(300)]
    fed = []
    real = minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, what: fed.append((what, real(df, what))) or fed[-1][1])
    got = minhash.near_duplicates(docs(spark, rows)).collect()
    assert {x["class_id"] for x in got} == {0} and sum(x["kept"] for x in got) == 1
    assert [df.count() for what, df in fed if what == "unlike"] == [0]
    assert [df.count() for what, df in fed if what == "verified"][1] == 0


def test_one_row_of_a_class_stays(spark):
    r = random.Random(5)
    a, b = words(r, 60), words(r, 60)
    rows = [(1, a), (1, a), (1, b), (2, a), (3, b), (None, a), (None, a), (4, None), (4, None)]
    left = sorted(map(str, minhash.kept_rows(docs(spark, rows)).select("doc_id").toPandas()["doc_id"].astype("Int64")))
    assert left == ["1", "4", "<NA>", "<NA>"]


# 10


def test_long_conversation(spark):
    n = 50_000
    rows = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id) AS text")
    got = chat_format.digest(chat_format.format_chats(rows)).first()
    loss = "".join(f"turn {i}" for i in range(1, n, 2))
    assert got["n_turns"] == n and got["loss_chars"] == len(loss) and got["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_round_trip(spark):
    nasty = ["\\", "\\l", "</turn>", "### user: ", "\\### Assistant: </turn> ok", "<\\</turn>\n", "", None, "a:b", "</turn>\n### x: y</turn>\n", "é中\U0001f600" * 50]
    r = random.Random(11)
    rows = [(c, t, r.choice(["user", "assistant", "sys: tem", "#", None]), r.choice(nasty)) for c in range(60) for t in range(r.randrange(1, 6))]
    rows += [(99, None, "user", "no turn"), (99, 1, "user", "tie b"), (99, 1, "user", "tie a"), (99, 1, "user", "tie a"), (None, 0, "assistant", "no id")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("source", F.lit(1))
    chats = chat_format.format_chats(frame)
    got = {x["conv_id"]: x for x in chat_format.digest(chats).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    for c, own in by.items():
        own.sort()
        loss = "".join(x[2] for x in own if x[1] == "assistant")
        x = got[c]
        assert x["n_turns"] == len(own) and x["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert x["loss_chars"] == len(loss) and x["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    for x in chats.collect():
        for t in x["turns"]:
            part = x["formatted"][t["start"] - 1 : t["start"] - 1 + t["length"]]
            for code, plain in (("\\c", ":"), ("\\h", "#"), ("\\l", "<"), ("\\b", "\\")):
                part = part.replace(code, plain) if x["level"] else part
            assert part == t["text"]
    assert chat_format.format_chats(frame.limit(0)).count() == 0


# pipeline


@tables
def test_pipeline(spark):
    import corpus_pipeline

    own = spark.read.parquet(f"{SF}/documents.parquet")
    out, sizes = own, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == own.columns, name
        sizes.append(out.count())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "mix_sources", "best_fit_packing"]
    assert own.count() >= sizes[0] >= sizes[1] >= sizes[2] > 0.5 * own.count()
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len({r["doc_id"] for r in rows}) <= sizes[2]


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline

    r = random.Random(12)
    own = docs(spark, [(i, words(r, 40) + "\n" + words(r, 30)) for i in range(12)] + [(50, None)])
    for name in ("score", "lang_pred", "rk", "lines", "left", "row", "size", "taken", "mix_id", "doc", "class_id", "near_id", "key", "body"):
        own = own.withColumn(name, F.lit(f"mine {name}"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, own, SF)
        assert out.columns == own.columns, name
        assert out.where("score <> 'mine score' or left <> 'mine left' or row <> 'mine row' or body <> 'mine body'").count() == 0
        assert out.count() >= 12 - (name == "mix_sources") * 12
    assert corpus_pipeline.STAGES[-1][1](spark, own, SF).count() >= 13


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Empty tables, null ids, repeated rows."""
    import corpus_pipeline

    r = random.Random(13)
    a, b = words(r, 80) + " word", words(r, 80) + " word"
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for name, rows in {"empty": [], "odd": [(1, a), (1, a), (None, b), (None, None), (2, ""), (3, a), (4, words(r, 90, 900))]}.items():
        docs(spark, rows).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {x["doc_id"] for x in out} == ({1, None, 4} if rows else set())
        assert len({(x["sequence_id"], x["offset"]) for x in out}) == len(out)


def test_native_plans(spark):
    """Operators 4 and 10 run no Python."""
    own = docs(spark, [(1, "a b"), (2, "c")])
    for frame in (mixing.mix_sources(own), chat_format.digest(chat_format.format_chats(own.selectExpr("doc_id conv_id", "doc_id turn", "source role", "text")))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
    assert json.dumps(sorted(queries.ORACLES))
