"""Base counts against plain Python, distances against numpy."""

import os
import re
from collections import Counter

import numpy as np

from conftest import SMALL
from llm_cases import awkward_rows, clashing, docs
from millrun.llm import queries, rules


def plain_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for k in range(len(w) - 2):
        if seen[tuple(w[k:k + 3])] > 1:
            hit.update((k, k + 1, k + 2))
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))


def plain_shares(text):
    """Class and word histograms in billionths, from the definitions."""
    text = text or ""
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789",
             " \t\n\r\x0b\x0c", ".,;:!?'\"()-", "", "#*$%&|<>"]
    counts = [0] * 8
    for ch in text:
        k = next((i for i, chars in enumerate(kinds) if ch in chars), 7 if ord(ch) > 127 else 5)
        counts[k] += 1
    bins = sorted({w for words in rules.COMMON_WORDS.values() for w in words.split()})
    found = Counter(re.sub(r"[A-Z]", lambda m: m[0].lower(), w).strip(".,;:!?")
                    for w in re.findall(r"[^\x20\x09-\x0D]+", text))
    words = [found[w] for w in bins]
    words.append(sum(found.values()) - sum(words))

    def shares(xs):
        return [x * 10**9 // max(1, sum(xs)) for x in xs]
    return shares(counts), shares(words)


def js(p, q):
    p, q = np.array(p) / 10**9, np.array(q)
    m = (p + q) / 2
    half = [np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0])) for x in (p, q)]
    return np.sqrt(max(0.0, sum(half) / 2))


def coarse(x):
    return [x[0] + x[1] + x[3] + x[7], x[2], x[4], x[5], x[6]]


def normed(x):
    return [v / max(1, sum(x)) for v in x]


def brute_force(rows, limit=rules.LIMITS):
    """Counts and verdicts of (id, text, lang) rows."""
    counts = {i: plain_counts(t) for i, t, _ in rows}
    shares = {i: plain_shares(t) for i, t, _ in rows}
    failed = {i: c[0] < 50 or 100 * c[4] > 50 * c[0] for i, c in counts.items()}
    lang = {i: (g or "").strip().lower() for i, _, g in rows}
    refs = {}
    for g in set(lang.values()) - {""}:
        group = [i for i in lang if lang[i] == g and not failed[i]]
        if len(group) >= limit["min_docs"]:
            middle = normed([float(np.median([shares[i][0][k] // 10**6 for i in group]))
                             for k in range(8)])
            core = [i for i in group if js(shares[i][0], middle) <= limit["class"]]
            if len(core) >= limit["min_docs"]:
                refs[g] = [[sum(shares[i][at][k] for i in core)
                            for k in range(len(shares[core[0]][at]))] for at in (0, 1)]
    every = normed(coarse([sum(r[0][k] for r in refs.values()) for k in range(8)])) if refs else None
    out = {}
    for i, t, _ in rows:
        c = w = 0.0
        if len(t or "") >= limit["min_chars"]:
            if lang[i] in refs:
                c = js(shares[i][0], normed(refs[lang[i]][0]))
            elif every:
                c = js(coarse(shares[i][0]), every)
        if counts[i][0] >= limit["min_words"] and lang[i] in refs and lang[i] in rules.COMMON_WORDS:
            w = js(shares[i][1], normed(refs[lang[i]][1]))
        off = c > limit["class"] or (c > limit["both_class"] and w > limit["both_word"])
        out[i] = (*counts[i], failed[i], not failed[i] and not off)
    return out


NAMES = [*rules.COUNTS, "base_failed", "kept"]


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in
            spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = brute_force(rows)
    got = {r["doc_id"]: tuple(r[c] for c in NAMES)
           for r in queries.op5_quality_rules(spark, SMALL).collect()}
    assert got == want


def test_awkward_rows(spark):
    rows = [r for r in awkward_rows() if r[0] is not None]
    got = rules.quality_rules(clashing(docs(spark, awkward_rows())))
    assert got.count() == len(awkward_rows())
    for r in got.where("doc_id is not null").collect():
        text = next(x[1] for x in rows if x[0] == r["doc_id"])
        assert tuple(r[c] for c in rules.COUNTS) == plain_counts(text)
    kept = rules.keep_good(clashing(docs(spark, awkward_rows())))
    assert kept.columns == clashing(docs(spark, [])).columns
    assert kept.count() == got.where("kept").count()


def test_nothing_passes_and_empty_table(spark):
    short = docs(spark, [(1, "too short", "en", "s", 9)])
    assert [r["kept"] for r in rules.quality_rules(short).collect()] == [False]
    assert rules.quality_rules(docs(spark, [])).count() == 0
    assert rules.keep_good(docs(spark, [])).count() == 0


def test_junk_goes_and_clean_stays(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = queries.op5_quality_rules(spark, SMALL).join(labels, "doc_id").where("not base_failed")
    share = {r["quality"]: r["share"] for r in
             got.selectExpr("quality", "int(kept) as k").groupBy("quality").agg(
                 {"k": "avg"}).withColumnRenamed("avg(k)", "share").collect()}
    assert share[1] >= 0.98 and share[0] <= 0.3


WORDS_IN = {"en": "the mill by river sold grain and bought slow barges before winter".split(),
            "ru": "мельница на реке продала зерно и купила баржи перед зимой тихо".split(),
            "el": "ο μύλος στο ποτάμι πούλησε σιτάρι και αγόρασε βάρκες πριν χειμώνα".split(),
            None: "물레방아는 강가에서 곡식을 팔고 겨울 전에 배를 샀다 조용히".split()}
JUNK = " ".join(f"#{i}$%{i * 37}|&" for i in range(100))


def prose_in(rng, lang):
    words = WORDS_IN[lang]
    return " ".join(f"{rng.choice(words)}{rng.choice(words)}" for _ in range(120)) + "."


def verdicts(spark, rows):
    """{id: row}, checked against brute force."""
    got = {r["doc_id"]: r for r in rules.quality_rules(docs(spark, rows)).collect()}
    want = brute_force([r[:3] for r in rows])
    assert {i: tuple(r[c] for c in NAMES) for i, r in got.items()} == want
    return got


def test_clean_documents_in_other_scripts_stay(spark):
    rng = np.random.default_rng(3)
    rows = [(i, prose_in(rng, "en"), "en", "s", 1) for i in range(60)]
    rows += [(100 + i, prose_in(rng, "ru"), ["ru", "RU "][i % 2], "s", 1) for i in range(30)]
    rows += [(200 + i, prose_in(rng, "el"), "el", "s", 1) for i in range(4)]
    rows += [(300 + i, prose_in(rng, None), [None, ""][i % 2], "s", 1) for i in range(4)]
    rows += [(400, JUNK, "ru", "s", 1), (401, JUNK, "en", "s", 1), (402, JUNK, None, "s", 1)]
    got = verdicts(spark, rows)
    assert not any(r["base_failed"] for r in got.values())
    assert {i for i, r in got.items() if not r["kept"]} == {400, 401, 402}
    assert got[100]["word_distance"] is None and got[0]["word_distance"] is not None
    kept = {r["doc_id"] for r in rules.keep_good(docs(spark, rows)).collect()}
    assert kept == set(got) - {400, 401, 402}


def test_a_language_needs_support(spark):
    """Junk alone in a language isn't its own reference; clean texts alone in one stay."""
    rng = np.random.default_rng(4)
    rows = [(i, prose_in(rng, "en"), "en", "s", 1) for i in range(40)]
    rows += [(100, JUNK, "zz", "s", 1), (101, prose_in(rng, "el"), "el", "s", 1)]
    got = verdicts(spark, rows)
    assert {i for i, r in got.items() if not r["kept"]} == {100}
    few = verdicts(spark, rows[:10] + rows[-2:])  # no reference at all: base rules alone
    assert all(r["kept"] and r["class_distance"] is None for r in few.values())


def test_junk_doesnt_move_a_small_reference(spark):
    rng = np.random.default_rng(5)
    rows = [(i, prose_in(rng, "en"), "en", "s", 1) for i in range(24)]
    rows += [(100 + i, JUNK + f" {i}", "en", "s", 1) for i in range(6)]
    got = verdicts(spark, rows)
    assert {i for i, r in got.items() if not r["kept"]} == {100 + i for i in range(6)}
    assert max(r["class_distance"] for i, r in got.items() if i < 100) < 0.1


def test_keep_good_leaves_no_copy_of_the_texts(spark):
    """What stays on disk is the references, by language."""
    rng = np.random.default_rng(6)
    df = docs(spark, [(i, prose_in(rng, "en"), "en", "s", 1) for i in range(40)])
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(root))
    kept = rules.keep_good(df)
    folder, = (f for f in set(os.listdir(root)) - before if f.startswith("millrun-rules-"))
    assert os.listdir(f"{root}/{folder}") == ["references"]
    assert kept.count() == 40
