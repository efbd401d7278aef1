"""Fingerprints, toxicity, substring dedup, WARC, near dedup, BPE, and the pipeline."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from cases import ODD, docs, odd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import bpe, fingerprints, near_dedup, shingles, substring_dedup, suffix_array, toxicity, warc
from quillon.llm.components import components
from quillon.llm.common import shared_dir

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def prose(r, n, vocabulary=5000):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def edits(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


# --- fingerprints ---


def test_sketches_estimate_and_merge():
    r = random.Random(1)
    words = [f"w{r.randrange(10**6)}" for _ in range(6000)]
    a, b = " ".join(words[:4000]), " ".join(words[1000:])
    x, y = fingerprints.sketch(a.encode()), fingerprints.sketch(b.encode())
    A, B = shingle_set(a), shingle_set(b)
    assert fingerprints.resemblance(x, y) == pytest.approx(jaccard(A, B), abs=0.1)
    assert fingerprints.containment(x, y) == pytest.approx(len(A & B) / len(A), abs=0.12)
    assert fingerprints.distinct(x) == pytest.approx(len(A), rel=0.2)
    whole = fingerprints.bottom(np.union1d(shingles.shingle_hashes(a.encode()), shingles.shingle_hashes(b.encode())))
    assert (fingerprints.merge(x, y) == whole).all()
    assert (fingerprints.from_text(fingerprints.to_text(x)) == x).all()
    assert len(fingerprints.from_text("")) == 0


def test_edited_pairs_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)
    r = random.Random(2)
    rows = [(i * 3 - 50, prose(r, r.randrange(0, 120))) for i in range(60)]
    got = {x.doc_id: x for x in fingerprints.edited_pairs(docs(spark, rows)).collect()}
    assert len(got) == 60
    for n, (i, t) in enumerate(rows):
        following = rows[(n + 1) % 60][1]
        cut = len(t) // 4
        e = t[: len(t) - cut] + following[:cut]
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert x.near_edited == pytest.approx(jaccard(shingle_set(t), shingle_set(e)), abs=1e-9)
        assert x.near_next == pytest.approx(jaccard(shingle_set(t), shingle_set(following)), abs=1e-9)


def test_fingerprints_of_odd_rows(spark):
    got = fingerprints.edited_pairs(odd(spark)).collect()
    assert len(got) == 12
    twins = [x.fingerprint for x in got if x.n_chars == len(ODD[0][1]) and x.doc_id in (1, 5)]
    assert len(twins) == 3 and len(set(twins)) == 1
    assert all(0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 for x in got)
    assert fingerprints.edited_pairs(odd(spark).limit(0)).count() == 0
    one = fingerprints.edited_pairs(docs(spark, [(1, "a b c d e f g h")])).first()
    assert one.near_next == 1.0
    merged = fingerprints.merged(fingerprints.edited_pairs(docs(spark, [(1, "a b c d e f"), (2, "b c d e f g")])).withColumn("k", F.lit("x")), "k").first()
    assert merged.n_distinct == 3


# --- toxicity ---


def all_maximal(scores):
    """Maximal segments by definition, recursively: the best one, then left and right of it."""
    if not any(s > 0 for s in scores):
        return []
    best = max(((i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), key=lambda p: (round(sum(scores[p[0] : p[1]]), 9), -(p[1] - p[0])))
    i, j = best
    return all_maximal(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in all_maximal(scores[j:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=14))
def test_segments_are_the_maximal_ones(scores):
    # weights break ties between equal sums
    s = [x + 0.001 * (k % 7) + 0.0001 * k for k, x in enumerate(scores)]
    got = toxicity.segments(np.array(s, dtype=float))
    assert sorted((b, e) for b, e, _ in got) == sorted(all_maximal(s))
    assert all(abs(v - sum(s[b:e])) < 1e-9 for b, e, v in got)


def toxic_corpus(spark, n=600):
    r = random.Random(3)
    bad = ["vile", "scum", "rotten"]
    rows, labels = [], []
    for i in range(n):
        w = prose(r, r.randrange(20, 200), 800).split()
        toxic = i % 6 == 0
        for _ in range(3 if toxic else 0):
            w[r.randrange(len(w))] = r.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxic_documents_and_passages(spark):
    df, labels, truth = toxic_corpus(spark)
    model = toxicity.fit(df, labels.where("doc_id < 400"))
    got = {x.doc_id: x.score for x in toxicity.scored(df, model).collect()}
    wrong = [i for i in range(400, 600) if (got[i] >= 0.5) != truth[i]]
    assert len(wrong) <= 4
    kept = {x.doc_id for x in toxicity.clean_documents(df, model).collect()}
    assert kept == {i for i, s in got.items() if s < 0.5}
    text = "calm words here and there " * 20 + "you vile rotten scum " + "and calm again " * 20
    spans = model.passages(text)
    assert len(spans) == 1 and text[spans[0][0] : spans[0][1]] == "vile rotten scum" and spans[0][3] < 0.05
    assert toxicity.toxic_passages(docs(spark, [(1, text), (2, "calm"), (3, None)]), model).count() == 1


def test_toxicity_without_labels_and_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(odd(spark), none)
    got = toxicity.scored(odd(spark), model).collect()
    assert len(got) == 12 and all(x.score < 0.5 for x in got)
    one_kind = spark.createDataFrame([(1, 0), (3, 0)], "doc_id long, toxic int")
    assert all(x.score < 0.5 for x in toxicity.scored(odd(spark), toxicity.fit(odd(spark), one_kind)).collect())
    assert toxicity.scored(odd(spark).limit(0), model).count() == 0
    assert toxicity.clean_documents(odd(spark), model).columns == odd(spark).columns


def test_model_equals_brute_force(spark):
    df, labels, truth = toxic_corpus(spark, 240)
    model = toxicity.fit(df, labels)
    texts = {r.doc_id: r.text for r in df.collect()}
    fold = {i: int(hashlib.md5(str(i).encode()).hexdigest()[24:32], 16) % 3 for i in texts}

    def learned(ids):
        ids = list(ids)
        n = {y: sum(truth[i] == y for i in ids) for y in (0, 1)}
        stands = {}
        for i in ids:
            for f in {f for w in re.findall(r"\w+", texts[i].lower()) for f in [w + " "] + [w[:k] for k in (3, 4, 5, 6, 7, 8) if len(w) >= k]}:
                stands.setdefault(f, [0, 0])[truth[i]] += 1
        out = {}
        for f, (c, t) in stands.items():
            def odds(share):
                prior = share * (n[0] + n[1])
                a, b = (x + prior * (c + t) / (n[0] + n[1]) for x in (t, c))
                o = math.log(a / (n[1] + prior - a) * (n[0] + prior - b) / b)
                return o, abs(o) / math.sqrt(1 / a + 1 / b)

            if c + t >= 3 and odds(0.2)[1] >= 2.5:
                o = odds(0.02)[0]
                if o <= 0 or o >= 2:
                    out[f] = min(6.0, o) if o > 0 else max(-1.0, -0.25 + 0.1 * o)
        return out

    want = learned(texts)
    assert model.odds.keys() == want.keys() and all(model.odds[f] == pytest.approx(want[f]) for f in want)

    def token(w, odds):
        return max([odds[f] for f in [w + " "] + [w[:k] for k in range(3, 9) if len(w) >= k] if f in odds], default=-0.25)

    def evidence(i, odds):
        scores = [token(w, odds) for w in re.findall(r"\w+", texts[i].lower())]
        best, low = [], 0  # maximal segments by their definition, from the best one outwards

        def split(a, b):
            total, top, at, start = 0.0, 0.0, None, a
            for k in range(a, b):
                if total <= 0:
                    total, start = 0.0, k
                total += scores[k]
                if total > top + 1e-12:
                    top, at = total, (start, k + 1)
            if at:
                best.append(top)
                split(a, at[0])
                split(at[1], b)

        split(low, len(scores))
        floor = math.log(max(1.0, model.size * len(scores)))
        return sum(max(0.0, model.rate * s - floor) for s in best), max(best, default=0.0), len(scores)

    for r in toxicity.scored(df, model).collect():
        e = evidence(r.doc_id, want)[0]
        assert r.score == pytest.approx(1 / (1 + math.exp(-model.bias - model.slope * math.log1p(e))), abs=1e-9)
    # the law and the curve come from documents that taught nothing to the odds they are scored by
    others = {k: learned(i for i in texts if fold[i] != k) for k in range(3)}
    clean = [evidence(i, others[fold[i]]) for i in texts if not truth[i]]
    assert model.size == pytest.approx(len(clean) / sum(n * math.exp(-model.rate * s) for _, s, n in clean))
    x = [(math.log1p(evidence(i, others[fold[i]])[0]), truth[i]) for i in texts]
    slope = sum((1 / (1 + math.exp(-model.bias - model.slope * v)) - y) for v, y in x)
    assert abs(slope) < 1e-3  # the curve's bias is at its best


def test_labels_of_held_out_rows_change_nothing(spark, tmp_path):
    import zlib

    from quillon.llm.queries_toxicity import op2_toxic_segments

    df, labels, truth = toxic_corpus(spark, 300)
    scores = []
    for flip in (False, True):
        d = f"{tmp_path}/{flip}"
        df.write.parquet(f"{d}/documents.parquet")
        rows = [(i, y ^ (flip and zlib.crc32(str(i).encode()) % 5 == 0)) for i, y in truth.items()]
        spark.createDataFrame(rows, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
        scores.append({r.doc_id: r.score for r in op2_toxic_segments(spark, d).collect()})
    assert scores[0] == scores[1] and sum((s >= 0.5) == truth[i] for i, s in scores[0].items()) >= 0.95 * len(truth)


def test_toxicity_of_odd_rows_with_a_model(spark):
    df, labels, _ = toxic_corpus(spark)
    model = toxicity.fit(df, labels)
    long = "calm " * 50_000 + "vile rotten scum " * 3 + "calm " * 50_000
    rows = odd(spark).unionByName(odd(spark).where("doc_id = 1").withColumn("doc_id", F.lit(77).cast("long")).withColumn("text", F.lit(long)))
    got = {}
    for r in toxicity.scored(rows, model).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    assert sum(map(len, got.values())) == 13 and got[77][0] >= 0.5
    blank = model.probability(0.0)
    assert got[2] == got[3] == got[4] == [blank] and blank < 0.5 and len(got[5]) == 3 and got[1][0] in got[5]
    assert toxicity.clean_documents(rows.limit(0), model).count() == 0


def test_held_out_rows_dont_teach(spark):
    from quillon.llm.queries_toxicity import op2_toxic_segments

    got = op2_toxic_segments(spark, SF).collect()
    import zlib

    assert len(got) == 200
    for x in got:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5)


# --- suffix arrays ---


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.binary(max_size=120), st.text("ab", max_size=120).map(str.encode), st.tuples(st.binary(min_size=1, max_size=6), st.integers(1, 30)).map(lambda p: p[0] * p[1])))
def test_suffix_array_and_prefixes(raw):
    text = np.frombuffer(raw, np.uint8)
    array = suffix_array.suffix_array(text)
    want = sorted(range(len(raw)), key=lambda i: raw[i:])
    assert array.tolist() == want
    if not raw:
        return
    lcp = suffix_array.common_prefixes(text, array, 10)
    for a, b in zip(want, want[1:]):
        n = 0
        while n < 10 and max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
            n += 1
        assert lcp[b] == n
    assert lcp[want[0]] == 0


@pytest.mark.parametrize("alphabet", [258, 2])
def test_names_are_sorted_by_recursion(monkeypatch, alphabet):
    monkeypatch.setattr(suffix_array, "BYTE_ALPHABET", alphabet)
    real, levels = suffix_array._sorted, []
    monkeypatch.setattr(suffix_array, "_sorted", lambda s, n: levels.append((len(s), n)) or real(s, n))
    r = random.Random(13)
    raw = (prose(r, 3000, 400) + " " + prose(r, 200, 50) * 3 + "ab" * 400).encode()
    assert suffix_array.suffix_array(np.frombuffer(raw, np.uint8)).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    assert len(levels) >= 3 and max(n for _, n in levels[1:]) > 258
    assert all(2 * b[0] <= a[0] + 2 for a, b in zip(levels, levels[1:]))


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, raw in rows:
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, kept)
    return out


@pytest.mark.parametrize("coarse,fine", [(4096, 32768), (2, 4), (1, 1)])
def test_repeats_equal_brute_force(spark, monkeypatch, coarse, fine):
    monkeypatch.setattr(substring_dedup, "COARSE", coarse)
    monkeypatch.setattr(substring_dedup, "FINE", fine)
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 2000)
    monkeypatch.setattr(substring_dedup, "HASH_BYTES", 1500)
    r = random.Random(6)
    base = [prose(r, 60, 300) for _ in range(4)]
    rows = []
    for i in range(40):
        a, b = r.choice(base), r.choice(base)
        x, y = r.randrange(len(a)), r.randrange(len(b))
        rows.append((i * 2, a[x : x + 220] + (prose(r, 5) if i % 3 else "") + b[y : y + 180] + ("é" * 150 if i % 7 == 0 else "")))
    rows += [(200, "z" * 500), (201, "ab" * 300), (202, base[0]), (203, base[0]), (204, "")]
    want = brute_repeats([(i, t.encode()) for i, t in rows], 100)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in substring_dedup.deduped(docs(spark, rows)).collect()}
    assert got == want


def test_repeats_of_odd_rows(spark):
    got = substring_dedup.digests(odd(spark)).collect()
    assert len(got) == 12
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
    assert by[2][0].n_bytes == 0 and by[9][0].n_removed == 199_999
    assert substring_dedup.digests(odd(spark).limit(0)).count() == 0
    twice = substring_dedup.digests(docs(spark, [(1, "q" * 50 + "r" * 80), (1, "q" * 50 + "r" * 80), (2, "q" * 50 + "r" * 80)])).orderBy("doc_id").collect()
    assert [x.n_removed for x in twice] == [0, 0, 130]


# --- WARC ---


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)


def test_archive_round_trip(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7} é</p>" * (i % 7 * 30)) for i in range(80)] + [(900, None, None), (None, "u\r\nX: y", "no id"), (901, "u", "no id"), (5, "again", "<p>5 é</p>" * 150)]
    root = shared_dir(spark)
    manifest = warc.write_archive(pages(spark, rows), root, roll=600, rows_each=20)
    files = manifest.orderBy("file").collect()
    assert len(files) > 4 and sum(f.records for f in files) == len(rows)
    got = warc.read_archive(spark, root, manifest).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = first.get(h or "")
        revisit = i is not None and i > to
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    key = lambda t: repr(t)
    assert sorted(((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got), key=key) == sorted(want, key=key)
    assert all(x.html == next(h or "" for i, _, h in rows if i == x.page_id and (h or "").encode().__len__() == x.payload_bytes) for x in got if x.record_type == "response" and x.page_id is not None)
    again = shared_dir(spark)
    other = warc.write_archive(pages(spark, rows).repartition(5), again, roll=600, rows_each=20).orderBy("file").collect()
    assert other == files


def test_archive_edges(spark):
    root = shared_dir(spark)
    empty = warc.write_archive(pages(spark, []), root)
    assert empty.count() == 0 and warc.read_archive(spark, root, empty).count() == 0
    root = shared_dir(spark)
    some = warc.write_archive(pages(spark, [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "long enough"), (4, "d", "long enough")]), root, min_revisit=5)
    assert {x.page_id: x.refers_to for x in warc.read_archive(spark, root, some).collect()} == {1: None, 2: None, 3: None, 4: 3}


# --- near dedup ---


def brute_groups(rows, percent=85):
    sets = [(i, shingle_set(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in up}


@pytest.mark.parametrize("block", [1024, 8])
def test_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "HUB_PARTNERS", 4)
    r = random.Random(8)
    rows, i = [], 0
    for family in range(12):
        base = prose(r, r.choice([6, 40, 150, 400]))
        for _ in range(r.randrange(1, 16)):
            rows.append((i, edits(r, base, r.randrange(0, max(1, len(base.split()) // 40) + 1))))
            i += 1
    chain = prose(r, 300)
    for _ in range(20):  # each like the one before, the ends unlike
        rows.append((i, chain))
        chain = edits(r, chain, 3)
        i += 1
    rows += [(i, ""), (i + 1, None), (i + 2, "A b"), (i + 3, "a B"), (i + 4, "a"), (i + 5, "x y")]
    r.shuffle(rows)
    got = {x.doc_id: x for x in near_dedup.grouped(docs(spark, rows)).collect()}
    want = brute_groups(rows)
    assert {k: x.component_id for k, x in got.items()} == want
    assert all(x.n_shingles == len(shingle_set(dict(rows)[k])) and x.kept == (k == x.component_id) for k, x in got.items())
    assert len(set(want.values())) < len(rows) - 10


def test_family_below_the_threshold_makes_no_pairs(spark):
    """All pairs of 600 texts are a little too unlike: sketches pass many, and no row comes of them."""
    r = random.Random(11)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(600):
        w = list(base)
        for k in range(2 + i % 2, 300, 60):  # five edits a text, far apart
            w[(k + r.randrange(50)) % 300] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base + [f"z{i}"])) for i in range(300)]  # and a family that is linked
    df = docs(spark, rows)
    made = []
    real = near_dedup._spanning
    near_dedup._spanning = lambda *a: made.append(real(*a).cache()) or made[-1]
    try:
        got = {x.doc_id: x.component_id for x in near_dedup.grouped(df).collect()}
    finally:
        near_dedup._spanning = real
    sets = [(i, shingle_set(t)) for i, t in rows]
    assert {got[1000 + i] for i in range(300)} == {min(got[1000 + i] for i in range(300))}
    assert got == brute_groups(rows)
    assert made[0].count() < len(rows) and len(sets) == len(rows)


def test_sketches_pass_what_is_alike():
    r = random.Random(9)
    for n in (8, 60, 300, 1500, 6000):
        base = prose(r, n, 10**6)
        for _ in range(20):
            other = edits(r, base, r.randrange(0, n // 50 + 1))
            A, B = (shingles.shingle_hashes(t.encode()) for t in (base, other))
            (x, fx), (y, fy) = near_dedup.odd_sketch(A), near_dedup.odd_sketch(B)
            d = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
            if jaccard(shingle_set(base), shingle_set(other)) >= 0.85:
                assert d <= near_dedup.most_differing(len(A), len(B), fx, fy)
        A, B = (shingles.shingle_hashes(prose(r, n, 10**6).encode()) for _ in range(2))
        (x, fx), (y, fy) = near_dedup.odd_sketch(A), near_dedup.odd_sketch(B)
        if n >= 60:
            assert np.bitwise_count((x ^ y).view(np.uint64)).sum() > near_dedup.most_differing(len(A), len(B), fx, fy)


def test_sketches_pass_pairs_at_the_threshold():
    r = np.random.default_rng(10)
    for n in (40, 100, 200, 400, 800, 1600, 6000):
        both = -(-85 * n // 100)
        for _ in range(400):
            h = r.integers(0, 2**64, n, dtype=np.uint64)
            cut = both + (n - both) // 2
            A, B = np.sort(h[:cut]), np.sort(np.concatenate([h[:both], h[cut:]]))
            (x, fx), (y, fy) = near_dedup.odd_sketch(A), near_dedup.odd_sketch(B)
            d = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
            assert d <= near_dedup.most_differing(len(A), len(B), fx, fy), n


def test_pipeline_links_from_four_fifths_on(spark):
    import corpus_pipeline as p

    r = random.Random(12)
    rows, alike = [], []
    for i in range(0, 60, 2):
        w = [f"v{r.randrange(10**6)}" for _ in range(104)]
        other = list(w)
        for k in (20, 60) + ((90,) if i % 4 else ()):  # each edit changes five of 100 shingles
            other[k] = f"e{i}x{k}"
        a, b = " ".join(w), " ".join(other)
        rows += [(i, a), (i + 1, b)]
        alike.append(jaccard(shingle_set(a), shingle_set(b)))
    assert sorted(set(alike)) == [85 / 115, 90 / 110]
    df = docs(spark, rows)
    kept = {x.doc_id for x in p.dedup_near_copies(spark, df, SF).collect()}
    assert kept == {i for i, _ in rows if i % 2 == 0 or alike[i // 2] < 0.8}
    assert near_dedup.kept_documents(df).count() == 60
    assert near_dedup.banding(85) == (26, 6) and near_dedup.banding(80) == (31, 5)


def test_near_dedup_odd_rows(spark):
    got = near_dedup.grouped(odd(spark)).collect()
    assert len(got) == 12
    by = {(x.doc_id, x.n_shingles): x for x in got}
    assert by[(5, 6)].component_id == 1 and not by[(5, 6)].kept
    assert [x.kept for x in got if x.doc_id is None] == [True]
    assert near_dedup.grouped(odd(spark).limit(0)).count() == 0
    kept = near_dedup.kept_documents(odd(spark))
    assert kept.columns == odd(spark).columns and kept.where("doc_id = 5").count() == 0


def test_components(spark):
    r = random.Random(4)
    links = [(a, b) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(45)) if a != b] + [(100 + k, 101 + k) for k in range(30)]
    up = {x: x for p in links for x in p}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(links, "a long, b long"), shared_dir(spark), "t")
    assert {x.id: x.label for x in got.collect()} == {x: find(x) for x in up}


# --- BPE ---


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(RANKS, public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=st.one_of(st.text(max_size=60), st.text("ab \n\t'’s12  \u0085\x1cé漢", max_size=60), st.tuples(st.text("abeinst", min_size=1, max_size=4), st.integers(1, 40)).map(lambda p: p[0] * p[1])))
def test_encoding_is_that_of_the_ranks(reference, codec, text):
    ids = codec.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert codec.decode(ids) == text and "".join(codec.decode_stream(ids)) == text
    offsets = codec.encode_with_offsets(text)
    raw = text.encode()
    assert [i for i, _, _ in offsets] == ids
    assert b"".join(raw[a:b] for _, a, b in offsets) == raw
    assert codec.unmapped(codec.mapped(raw)) == raw and codec.decode_bytes(ids) == raw
    ends, split = codec.ends(ids)
    assert ends.tolist() == [b for _, _, b in offsets]
    assert split == sum(0x80 <= raw[a] < 0xC0 for _, a, b in offsets)


def test_encoded_documents(spark, reference):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want, offsets = [], []
    for i, t, *_ in ODD:
        raw, ids = (t or "").encode(), reference.encode_ordinary(t or "")
        sizes = [len(reference.decode_single_token_bytes(k)) for k in ids]
        ends = np.cumsum(sizes).tolist()
        split = sum(0x80 <= raw[e - n] < 0xC0 for e, n in zip(ends, sizes, strict=True))
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(raw), sha(np.array(ends, "<i8").tobytes()), split))
        offsets.append((i, ids, ends))
    got = bpe.encoded_digests(odd(spark), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    whole = bpe.encode_documents(odd(spark), RANKS, public_tokenizers.PATTERN).collect()
    assert all(x.decodes and x.n_tokens == len(x.ids) for x in whole)
    assert sorted(((x.doc_id, x.ids, x.ends) for x in whole), key=repr) == sorted(offsets, key=repr)
    assert bpe.encoded_digests(odd(spark).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    assert any(x[-1] for x in want)


def test_small_memo(monkeypatch, reference):
    monkeypatch.setattr(bpe, "MEMO_PIECES", 3)
    own = bpe.ByteBPE(RANKS, public_tokenizers.PATTERN)
    text = "one two three four five six seven one two three"
    assert own.encode(text) == reference.encode_ordinary(text) == own.encode(text)


# --- pipeline ---


def test_pipeline_stages(spark):
    import corpus_pipeline as p
    from quillon.llm.common import words_of

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mix_sources", "byte_bpe"]
    clean = p.drop_toxic(spark, docs, SF).cache()
    assert clean.columns == names and 0.5 * docs.count() < clean.count() <= docs.count()
    lined = p.dedup_lines(spark, clean, SF).cache()
    assert lined.columns == names and lined.count() == clean.count()
    assert lined.where("n_chars <> char_length(text)").count() == 0
    single = p.dedup_near_copies(spark, lined, SF).cache()
    assert single.columns == names
    want = brute_groups([(r.doc_id, r.text) for r in lined.collect()], 80)
    assert {r.doc_id for r in single.collect()} == {k for k, v in want.items() if k == v}
    mix = p.mix_sources(spark, single, SF).cache()
    assert mix.columns == names
    total = single.agg(F.sum(F.size(words_of(F.col("text"))))).first()[0]
    most = single.agg(F.max(F.size(words_of(F.col("text"))))).first()[0]
    assert abs(mix.agg(F.sum(F.size(words_of(F.col("text"))))).first()[0] - total) <= 20 * most
    last = p.encode(spark, mix, SF)
    assert last.count() == mix.count() and last.where("NOT decodes").count() == 0
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    whole = p.run(spark, SF)
    assert sorted((r.doc_id, r.ids) for r in whole.collect()) == sorted((r.doc_id, r.ids) for r in last.collect())


def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline as p

    for name, stage in p.STAGES:
        out = stage(spark, odd(spark), SF)
        if name != "byte_bpe":
            assert out.columns == odd(spark).columns
        got = Counter(r.doc_id for r in out.collect())
        want = Counter(i for i, *_ in ODD)
        if name in ("toxicity", "line_dedup", "byte_bpe"):
            assert got == want, name
        elif name == "near_dedup":
            assert got == want - Counter({5: 3}), name
        else:
            assert all(n <= 3 * want[i] for i, n in got.items()), name


def test_strings_without_an_equal_stay_out_of_the_arrays():
    r = np.random.default_rng(7)
    lone = [bytes(r.integers(97, 123, 300, np.uint8)) for _ in range(40)]
    pieces = [(i, 0, 5, x) for i, x in enumerate(lone)] + [(100, 0, 0, b"__" + lone[3][50:200]), (101, 0, 9, lone[3][100:260])]
    left = substring_dedup.sieved(pieces, 100)
    assert sum(len(p[3]) for p in left) < 1000 < sum(len(p[3]) for p in pieces)

    def runs(pieces):
        owner, begin, end = (x.tolist() for x in substring_dedup.repeats_of(pieces, 100))
        return sorted((pieces[o][0], pieces[o][2] + b, pieces[o][2] + e) for o, b, e in zip(owner, begin, end, strict=True))

    assert runs(left) == runs(pieces) == [(100, 2, 152), (101, 9, 169)]
    assert substring_dedup.sieved(pieces[:40], 100) == []


def test_workers_forget_what_other_operators_remember():
    from quillon.llm.common import lean

    shingles.shingle_hashes(b"a b c d e f")
    assert shingles._memo
    assert list(lean("shingles", lambda batches: iter([len(shingles._memo) > 0]))([])) == [True]
    assert list(lean("bpe", lambda batches: iter([len(shingles._memo)]))([])) == [0]
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    codec.encode("some words to remember")
    assert codec.memo
    list(lean("bpe", lambda batches: iter(()))([]))
    assert codec.memo
    list(lean("toxicity", lambda batches: iter(()))([]))
    assert not codec.memo
