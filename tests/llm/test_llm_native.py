"""Licence scan, mixing, quality rules, line dedup."""

import math
import hashlib
import random
import re
import textwrap
from collections import Counter

import pytest
from cases import docs, odd
from oracle import same
from pyspark.sql import functions as F

from quillon.llm import licenses, line_dedup, mixing, quality, registry
from quillon.llm.common import words_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)


# --- licences ---


def scan(spark, text):
    return licenses.scanned(docs(spark, [(1, text)])).first()


def test_license_rules(spark):
    assert scan(spark, "Some text.\nReleased under the MIT License.").licenses == "MIT"
    assert scan(spark, "This work is licensed under the GNU General Public License, version 3. More.").licenses == "GPL-3.0"
    s = licenses.SENTENCES
    mit = ". ".join(s[k][0] for k in ("mit-grant", "mit-notice", "mit-as-is", "mit-liable")) + "."
    assert scan(spark, mit).licenses == "MIT"
    wrapped = mit.replace(" the ", "\nthe ")
    assert scan(spark, wrapped).sentence_ids == "mit-grant;mit-notice;mit-as-is;mit-liable"
    both = scan(spark, ". ".join(s[k][0] for k in ("bsd-redistribute", "bsd-source", "bsd-binary")) + ".\nLicensed under CC BY-NC 4.0.\nAll rights reserved.")
    assert (both.licenses, both.unexplained) == ("BSD-2-Clause,CC-BY-NC-4.0", "all-rights")
    three = scan(spark, ". ".join(s[k][0] for k in ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse")) + ".")
    assert three.licenses == "BSD-3-Clause"
    assert scan(spark, "The licence of poets is unlimited.").n_known == 0


def test_titles_and_wrapped_sentences_side_by_side(spark):
    s = licenses.SENTENCES
    wrap = lambda t: textwrap.fill(t, 70)
    paragraphs = [s["mit-grant"][0] + ":", s["mit-notice"][0] + ".", s["mit-as-is"][0] + ". " + s["mit-liable"][0] + "."]
    for gap in ("\n\n", "\n", "\r\n\r\n"):
        got = scan(spark, gap.join(["MIT License", "Copyright (c) 2020 Some One", *map(wrap, paragraphs)]))
        assert (got.licenses, got.sentence_ids, got.unexplained) == ("MIT", "mit-grant;mit-notice;mit-as-is;mit-liable", "")
    got = scan(spark, "Some title\nReleased under the MIT License\nMore\nThis is free and unencumbered software\nreleased into the public domain.\nAll rights reserved")
    assert (got.sentence_ids, got.licenses) == ("named:MIT;public-domain;all-rights", "Unlicense,MIT")


def test_every_known_sentence_has_a_trigger():
    for group in licenses.SENTENCES.values():
        for s in group:
            assert any(t in s.lower() for t in licenses.TRIGGERS), s
    for names in licenses.NAMES.values():
        assert all(any(t in f"licensed under {n}".lower() for t in licenses.TRIGGERS) for n in names)
    for lead in licenses.LEADS:
        for names in licenses.NAMES.values():
            for n in names:
                if not any(t in f"{lead} {n}".lower() for t in licenses.TRIGGERS):
                    pytest.fail(f"{lead} {n}")


def test_triggers_wrap_too(spark):
    assert scan(spark, "This is free and unencumbered software released into the public\ndomain.").licenses == "Unlicense"
    assert scan(spark, "All rights  reserved.").sentence_ids == "all-rights"
    assert scan(spark, "Released under CC\r\nBY 4.0.").licenses == "CC-BY-4.0"


def test_license_odd_rows(spark):
    got = licenses.scanned(odd(spark)).collect()
    assert len(got) == 12 and all(r.n_known == 0 and r.licenses == "" for r in got)
    assert licenses.scanned(odd(spark).limit(0)).count() == 0


# --- mixing ---




def brute_targets(sizes):
    names = sorted((k for k in sizes if k is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {k: mixing.WEIGHTS[i % 3] for i, k in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = {k: w[k] for k in names if k not in full}
        left = total - sum(full.values())
        share = {k: left * x / sum(rest.values()) for k, x in rest.items()}
        over = {k: 3.0 * sizes[k] for k in share if share[k] > 3 * sizes[k]}
        if not over:
            return full | share
        full |= over


def served_one_by_one(rows):
    """Words taken of each document, by serving quanta from a heap until the budget is spent."""
    queues, budget = {}, sum(x.size for x in rows)
    for x in sorted(rows, key=lambda x: (hashlib.md5(str(x.doc_id).encode()).hexdigest(), x.doc_id)):
        queues.setdefault(x.source, []).append(x)
    names = sorted((k for k in queues if k is not None), key=lambda s: s.encode()) + [k for k in queues if k is None]
    heap, taken = [], {x.doc_id: 0 for x in rows}
    for place, k in enumerate(names):
        steps = ((x, min(mixing.QUANTUM, x.size - at)) for _ in range(3) for x in queues[k] for at in range(0, x.size, mixing.QUANTUM))
        total = 0
        for x, n in steps:
            total += n
            heap.append((total / x.target, place, x.doc_id, n))
    for _, _, i, n in sorted(heap):
        taken[i] += min(n, budget)
        budget -= min(n, budget)
    return taken


@pytest.mark.parametrize("words,wide,quantum", [(1 << 16, 4096, 64), (50, 3, 7)])
def test_mixing_in_many_ranges(spark, monkeypatch, words, wide, quantum):
    for name, value in (("RANGE_WORDS", words), ("WIDE", wide), ("QUANTUM", quantum)):
        monkeypatch.setattr(mixing, name, value)
    r = random.Random(5)
    got = mixing.mixed(docs(spark, [(i, "w " * (3000 if i == 7 else r.randrange(0, 80))) for i in range(200)])).collect()
    assert {x.doc_id: x.taken for x in got} == served_one_by_one(got)
    assert sum(x.taken for x in got) == sum(x.size for x in got)


def test_mixing_targets_and_totals(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" * r.randrange(1, 9) for _ in range(r.randrange(0, 60)))) for i in range(400)]
    df = docs(spark, rows).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("é"), (F.col("doc_id") % 5).cast("string"))))
    got = mixing.mixed(df).collect()
    sizes = Counter()
    for x in got:
        sizes[x.source] += x.size
    want = brute_targets(sizes)
    taken = Counter()
    for x in got:
        assert x.target == pytest.approx(want[x.source]) and x.source_size == sizes[x.source]
        assert 0 <= x.taken <= 3 * x.size
        taken[x.source] += x.taken
    for k, t in want.items():
        assert -mixing.QUANTUM < taken[k] - t < mixing.QUANTUM * len(want)
    assert sum(taken.values()) == sum(sizes.values()) == pytest.approx(sum(want.values()))
    assert {x.doc_id: x.taken for x in got} == served_one_by_one(got)
    again = mixing.mixed(df.repartition(7)).collect()
    assert sorted((x.doc_id, x.taken) for x in got) == sorted((x.doc_id, x.taken) for x in again)


def test_mixed_documents(spark):
    df = docs(spark, [(i, "a b c d " * (1 + i % 4)) for i in range(120)])
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    words = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.size(words_of(F.col("text")))).alias("n")).collect()}
    for r in mixing.mixed(df).select("source", "target").distinct().collect():
        assert abs(words[r.source] - r.target) <= 8 + mixing.QUANTUM
    assert mixing.mixed(df).where("taken > 0 AND finish > 1.2").count() == 0


def test_mixing_odd_rows(spark):
    got = mixing.mixed(odd(spark)).collect()
    assert len(got) == 12 and {x.size for x in got if x.doc_id in (2, 3, 4)} == {0}
    assert all(x.taken == 0 for x in got if x.size == 0)
    assert mixing.mixed(odd(spark).limit(0)).count() == 0
    assert mixing.mix_documents(odd(spark)).columns == odd(spark).columns
    empty = docs(spark, [(1, ""), (2, None)])
    assert [x.taken for x in mixing.mixed(empty).collect()] == [0, 0]


# --- quality ---


def counted(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    cover = {j for i, x in enumerate(windows) if often[x] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_quality_counts(spark):
    r = random.Random(2)
    texts = ["", None, "a", "a a", "a a a", "a a a a", "x y z x y z", "# | <b> $", "l1\nl1\n \n \nl1", "a b\x85c d e\x1cf"]
    texts += [" ".join(r.choice("ab") for _ in range(r.randrange(60))) for _ in range(60)] + ["\n".join(r.choice(["p q", "r", "", " "]) for _ in range(20)) for _ in range(10)]
    texts.append("w " * 5000 + " ".join(map(str, range(3000))))
    got = {x.doc_id: x for x in quality.judged(docs(spark, list(enumerate(texts))), [0.0] * quality.BUCKETS).collect()}
    for i, t in enumerate(texts):
        x, want = got[i], counted(t)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want, t
        assert x.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert x.kept == (not x.base_failed)


def test_quality_ratios_and_scores(spark):
    r = random.Random(1)
    clean = [(i, " ".join(f"good{r.randrange(90)}" for j in range(80))) for i in range(60)]
    junk = [(100 + i, " ".join(f"j{i}unk{j}$$$" for j in range(80))) for i in range(20)]
    df = docs(spark, clean + junk)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)] + [(100, 0)], "doc_id long, quality int")
    raw = quality.feature_counts(df)
    assert sum(raw) == 80 * (2 * 80 - 1)
    target = quality.feature_counts(df.where("doc_id < 60 AND doc_id % 2 = 0"))
    ratios = quality.fit(df, labels)
    for b in (0, 17, 4242):
        p = (raw[b] + 1) / (sum(raw) + len(raw))
        q = (target[b] + sum(target) * p) / (2 * sum(target))
        assert ratios[b] == pytest.approx(math.log(q / p), abs=1e-6)
    kept = {x.doc_id for x in quality.judged(df, ratios).where("kept").collect()}
    assert kept == set(range(60))


def test_quality_odd_rows(spark):
    got = quality.judged(odd(spark), [0.0] * quality.BUCKETS).collect()
    assert len(got) == 12
    assert quality.judged(odd(spark).limit(0), [0.0] * quality.BUCKETS).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert set(quality.fit(odd(spark), labels)) == {0.0}


# --- line dedup ---


def test_repeated_chunks_go(spark):
    r = random.Random(5)
    line = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(6))
    passage = [line() for _ in range(40)]
    rows = [(i, "\n".join([line() for _ in range(r.randrange(4))] + passage + [line() for _ in range(3)])) for i in range(12)]
    alone = [(50 + i, "\n".join(line() for _ in range(20))) for i in range(5)]
    df = docs(spark, rows + alone)
    out = {x.doc_id: x for x in line_dedup.deduped(df, stats=True).collect()}
    for i, t in rows + alone:
        kept = out[i].text.split("\n")
        if i == 0 or i >= 50:
            assert out[i].text == t
            continue
        own = [x for x in t.split("\n") if x not in passage]
        assert [x for x in kept if x not in passage] == own
        assert sum(x in passage for x in kept) <= 12  # the chunks at the edges
        assert out[i].n_removed_lines == len(t.split("\n")) - len(kept)


def test_equal_digest_isnt_enough(spark, monkeypatch):
    rows = [(1, "a1 b\nc d"), (2, "a2 b\nc d")]
    real = line_dedup.F.md5
    monkeypatch.setattr(line_dedup.F, "md5", lambda c: real(F.regexp_replace(c, "[12]", "")))
    out = {x.doc_id: x.text for x in line_dedup.deduped(docs(spark, rows)).collect()}
    assert out == dict(rows)


def test_line_dedup_odd_rows(spark):
    df = odd(spark)
    out = line_dedup.deduped(df)
    assert out.columns == df.columns and out.count() == 12
    texts = sorted(str(r.text) for r in out.collect())
    assert texts.count("None") == 1
    same_chunk = [r.text for r in out.where("doc_id IN (1, 5)").orderBy("doc_id").collect()]
    assert same_chunk[0] == "one two three four five six seven\neight nine ten"
    assert line_dedup.deduped(df.limit(0)).count() == 0


def test_line_chunks_cost_in_proportion(spark):
    """A text's chunks are found again by its digest, which is taken once a text and not once a chunk."""
    found = line_dedup._numbered(docs(spark, [(1, "a\nb\nc")]), "doc_id", "text")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert "md5(" not in above


def test_repeated_passages_leave_their_inner_lines(spark):
    r = random.Random(7)
    line = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(9))
    passages = [[line() for _ in range(24)] for _ in range(30)]
    rows = [(2 * i, "\n".join([line()] + p + [line()])) for i, p in enumerate(passages)] + [(2 * i + 1, "\n".join([line(), line()] + p)) for i, p in enumerate(passages)]
    kept = {x.doc_id: x.text.split("\n") for x in line_dedup.deduped(docs(spark, rows)).collect()}
    stay = sum(x in kept[2 * i + 1] for i, p in enumerate(passages) for x in p)
    assert all(x in kept[2 * i] for i, p in enumerate(passages) for x in p) and stay <= 0.35 * 24 * len(passages)
    assert all(len(kept[i]) == len(t.split("\n")) for i, t in rows if i % 2 == 0)
