"""The operators against brute force on small tables, with nulls, empty texts, ties and repeated rows."""

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from enclosa.llm import decontamination, difference_cover, distributed_suffixes, language_id, license_scan, packing, quality_ranker, quality_rules, set_join, substring_dedup, token_files, url_filter
from enclosa.llm.components import components
from enclosa.llm.common import Shared
from enclosa.llm.queries import vocabulary
from pyspark.sql import functions as F

WORDS = "the and of ing tion ble ond er es that with this from have für ñandú être 日本 zq alpha beta gamma delta".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality string, lo double, id long"


def prose(seed: int, n: int, line: int = 9) -> str:
    r = random.Random(seed)
    w = [r.choice(WORDS) + r.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(w[i : i + line]) for i in range(0, n, line))


def edited(text: str, seed: int, changes: int) -> str:
    r, w = random.Random(seed), text.split(" ")
    for _ in range(changes):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    base = [prose(k, 150 + 13 * k) for k in range(12)]
    shared = prose(99, 60)
    out = [*base, base[0], base[0], base[1].upper(), *(edited(base[2], k, 3) for k in range(5)), *(edited(base[3], k, 12) for k in range(4))]
    out += [f"{prose(200 + k, 40)}\n{shared}\n{prose(300 + k, 40)}" for k in range(5)]
    out += [None, "", " ", "a", "a b c", "a b c", "\n\n", "ing " * 300, "ing " * 301, "日本語 テキスト", prose(7, 6000), "1 2 3 !!", "x" * 99, "x" * 100, "x" * 101]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, (None if i % 5 == 0 else "en" if i % 2 else "de"), f"s{i % 3}", 0, "clash", 1.0, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(t: str) -> str:
    return "".join(chr(ord(c) | 32) if "A" <= c <= "Z" else c for c in t)


def split(t: str | None) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


# --- quality rules ---


def rules_brute(t):
    t = t or ""
    w = split(t)
    places = collections.defaultdict(list)
    for i in range(len(w) - 4):
        places[tuple(w[i : i + 5])].append(i)
    covered = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if split(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_counts(docs, texts, empty):
    got = {r[0]: r for r in quality_rules.weak_supervision(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert tuple(r[1:6]) == rules_brute(t), i
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.weak_supervision(empty).count() == 0


def test_quality_rules_em():
    patterns = [((1, 1, 1, 1, 1), 900), ((-1, 1, 1, 1, 1), 80), ((1, -1, 1, 1, 1), 20), ((0, 0, 0, 0, 0), 5)]
    model = quality_rules.fit(patterns)
    p = [quality_rules.posterior(model["prior"], model["table"], v) for v, _ in patterns]
    assert p[0] > 0.9 and p[1] < 0.5 and p[0] > p[3] > p[1]
    assert all(a > 0.5 for a in quality_rules.accuracies(model)[:2])
    assert quality_rules.fit([])["prior"] == quality_rules.PRIOR


def test_quality_rules_em_recovers_planted_accuracies():
    """Ten rules of known error rates, some of them noisy, over documents of which 15 % are bad."""
    rng = np.random.default_rng(6)
    alarm = np.array([0.01, 0.02, 0.01, 0.12, 0.01, 0.03, 0.02, 0.08, 0.01, 0.02])
    seen = np.array([0.6, 0.5, 0.7, 0.3, 0.4, 0.5, 0.8, 0.2, 0.4, 0.6])
    good = rng.random(40_000) < 0.85
    v = np.where(rng.random((len(good), 10)) < np.where(good[:, None], alarm, seen), -1, 1)
    v[rng.random(v.shape) < 0.15] = 0
    rows, place, n = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    rows = [tuple(r) for r in rows.tolist()]
    model = quality_rules.fit(list(zip(rows, n.tolist(), strict=True)))
    assert abs(model["prior"] - 0.85) < 0.02
    for k, t in enumerate(model["table"]):
        assert abs(t[1][-1] - alarm[k]) < 0.02 and abs(t[-1][-1] - seen[k]) < 0.06, k
    kept = np.array([quality_rules.posterior(model["prior"], model["table"], r) >= 0.5 for r in rows])[place.ravel()]
    every = (v >= 0).all(1)
    assert (kept == good).mean() > 0.97 > 0.85 > (every == good).mean()
    assert 0.1 < (kept != every).mean()


def test_quality_rules_are_not_a_conjunction(spark):
    """Short but clean texts are kept although a rule votes against them; texts in which several rules agree are not."""
    r = random.Random(12)
    clean = [". ".join(" ".join(r.choice(WORDS) for _ in range(9)).capitalize() for _ in range(r.randrange(2, 40))) + "." for _ in range(400)]
    junk = [" ".join(w + r.choice(["###", "&&&", "%%%"]) for w in c.split()) for c in clean[:40]]
    d = spark.createDataFrame(list(enumerate(clean + junk)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in quality_rules.weak_supervision(d).collect()}
    assert sum(got[i]["kept"] for i in range(400)) >= 390
    assert sum(got[i]["kept"] for i in range(400, 440)) <= 1
    assert any(x["kept"] and x["bad_votes"] for x in got.values())
    assert quality_rules.weak_supervision(d.limit(0)).count() == 0


# --- licence scan ---


@pytest.mark.parametrize("expression, leaves, mit, both", [
    ("MIT", {"mit"}, True, True),
    ("MIT OR Apache-2.0", {"mit", "apache-2.0"}, True, True),
    ("MIT AND GPL-2.0", {"mit", "gpl-2.0"}, False, False),
    ("(MIT OR GPL-2.0) AND Apache-2.0", {"mit", "gpl-2.0", "apache-2.0"}, False, True),
    ("GPL-2.0 WITH Classpath-exception-2.0 OR MIT", {"gpl-2.0 with classpath-exception-2.0", "mit"}, True, True),
    ("MIT AND", {"mit"}, True, True),
    (")(", set(), False, False),
    ("", set(), False, False),
    ("MIT some words", {"mit"}, True, True),
])
def test_license_expressions(expression, leaves, mit, both):
    p = license_scan.postfix(expression)
    assert license_scan.licences(p) == leaves
    assert license_scan.evaluate(p, lambda x: x == "mit") is mit
    assert license_scan.evaluate(p, lambda x: x in ("mit", "apache-2.0")) is both


def test_license_scan(spark, empty):
    some = ["Under the MIT License, the MIT-License.", "GNU General\nPublic  License v3; apache license", "// SPDX-License-Identifier: Apache-2.0 OR MIT\nx", "éMIT License", None, "", "mit licenses"]
    d = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.license_scan(d).collect()}
    for i, t in enumerate(some):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
        at = [(k, lab) for k in range(len(w)) for p, lab in license_scan.BASE.items() if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert 0 <= r["score"] <= 1
    assert got[2]["labels"] == "apache-2.0,mit"
    assert license_scan.license_scan(empty).count() == 0


# --- language ---


def test_language_id(spark, empty):
    r = random.Random(3)
    parts = {"en": ["the", "ing", "tion", "and"], "fr": ["eau", "que", "ment", "été"], "de": ["sch", "ung", "keit", "über"]}
    rows = [(i, " ".join(r.choice(parts[k]) + r.choice(parts[k]) for _ in range(40)), k) for i, k in enumerate(list(parts) * 60)]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "12 !?", "fr"), (1003, "the andtion", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in language_id.language_id(d, language_id.fit(d)).collect()}
    assert len(got) == len(rows)
    for i, t, k in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= got[i]["score"] <= 1
        if t and re.search(r"[^\W\d_]", t):
            assert k is None or got[i]["lang_pred"] == k
        else:
            assert got[i]["lang_pred"] == "und"
    assert language_id.fit(empty) is None
    assert {x["lang_pred"] for x in language_id.language_id(d, None).collect()} == {"und"}


def test_codewords_are_apart():
    for n in (2, 3, 4, 9):
        c = language_id.codewords(n)
        assert min((c[i] != c[j]).sum() for i in range(n) for j in range(i)) >= 4


# --- ranking ---


def test_quality_ranker(spark, empty):
    rows = [(i, prose(i, 60) if i % 3 else " ".join(f"{w}$$$" for w in prose(i, 60).split())) for i in range(240)] + [(900, ""), (901, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)] + [(3, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality_ranker.rank_quality(d, quality_ranker.fit(d, lab)).collect()}
    assert len(got) == len(rows)
    held = [x for i, x in got.items() if x["held_out"] and i < 240]
    assert sum(x["predicted"] == int(x["doc_id"] % 3 > 0) for x in held) >= 0.95 * len(held)
    assert all(x["predicted"] == int(x["score"] >= 0.7) and 0 <= x["score"] <= 1 for x in got.values())
    assert quality_ranker.fit(d, lab.limit(0)) is None
    assert quality_ranker.rank_quality(empty, None).count() == 0


def test_quality_quantiles_are_of_all_labelled_rows(spark):
    d = spark.createDataFrame([(i, prose(i, 60) if i % 5 else " ".join(f"{w}$" for w in prose(i, 20 + i % 40).split())) for i in range(400)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(400)], "doc_id long, quality int")
    model = quality_ranker.fit(d, lab, sample=40)
    raw = [x["raw"] for x in quality_ranker.rank_quality(d, model).collect() if not x["held_out"]]
    low, high = np.quantile(raw, [0.1, 0.9], method="inverted_cdf")
    assert abs(6 / model["slope"] - (high - low)) < 3 / 1024


# --- set join ---


def jaccard_brute(texts, n, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = split(low(t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("group", [48, 2])
def test_set_join(docs, texts, empty, group, monkeypatch):
    monkeypatch.setattr(set_join, "GROUP", group)
    got = {r[0]: (r[1], r[2]) for r in set_join.near_duplicates(docs).collect()}
    assert got == jaccard_brute(texts, 4, 85)
    if group == 2:
        assert set_join.near_duplicates(empty).count() == 0


def test_large_groups_are_compared_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(set_join, "BLOCK", 64)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, 64, dtype=np.uint8)
    rows = []
    for i in range(600):
        x = base.copy() if i % 2 else rng.integers(0, 256, 64, dtype=np.uint8)
        x[i % 64] ^= 1
        rows.append((5, i, 200, i // 3, bytes(x), 600, 200))
    hot = spark.createDataFrame(rows, "sig long, id long, size long, component long, sketch binary, n long, most long")
    pairs = set_join._block_pairs(hot)
    assert pairs.groupBy("sig", "pair").count().agg(F.max("count")).first()[0] < 4 * 64
    got = pairs.repartition(4, "sig", "pair").sortWithinPartitions("sig", "pair", "side").mapInArrow(set_join._left_over(85), "a long, b long").distinct()
    most = 400 - 2 * set_join.overlap(200, 200, 85)
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if i // 3 != j // 3 and set_join.differ(rows[i][4], rows[j][4]) <= most}
    assert len(want) > 10000
    assert {tuple(r) for r in got.collect()} == want


def test_set_join_other_threshold(spark):
    base = [prose(k, 90) for k in range(4)]
    some = [*base, *(edited(b, 7 * i + k, k) for k in (1, 2, 3, 4) for i, b in enumerate(base)), *(prose(50, 30) + " " + prose(60 + k, 3) for k in range(6))]
    d = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in set_join.near_duplicates(d, n=5, percent=80).collect()}
    assert got == jaccard_brute(some, 5, 80)


def test_allocation_meets_the_pigeonhole_bound():
    low_ = set_join.bands(5000)
    for k in range(len(low_) - 1):
        ones, twos = set_join.allocate(low_[k], low_[k + 1], 1000)
        for a in {low_[k], low_[k + 1] - 1}:
            for b in range(a, a * 100 // 85 + 1):
                assert a + b - 2 * set_join.overlap(a, b) < ones + 2 * twos


def test_signatures_of_an_element_are_bounded_at_every_size():
    """Bytes that a text writes, by the number of texts in its band."""
    low_ = set_join.bands(40_000)
    for percent in (85, 80):
        for texts in (1000, 10**6, 10**8, 10**11):
            for k in range(len(low_) - 1):
                ones, twos = set_join.allocate(low_[k], low_[k + 1], texts, percent)
                most = set_join.apart(low_[k], low_[k + 1], percent)
                assert set_join.spare(ones, twos, most) >= 0
                assert set_join.signed(ones, twos, low_[k + 1]) <= set_join.ROWS * low_[k + 1] + 5
    assert set_join.allocate(316, 474, 10**8, 85)[1] > 0 == set_join.allocate(316, 474, 10**4, 85)[1]


def test_linked_sets_share_a_segment_that_is_not_empty():
    rng = np.random.default_rng(7)
    for percent in (85, 80):
        plan = set_join.Plan(set_join.bands(400), [10**6] * 20, percent)
        for _ in range(300):
            n = int(rng.integers(1, 200))
            base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            gone = int(rng.integers(0, len(base) * (100 - percent) // 100 + 1))
            other = np.sort(np.concatenate([base[gone:], rng.integers(0, 2**63, int(rng.integers(0, 3)), dtype=np.uint64)]))
            both = len(np.intersect1d(base, other))
            if 100 * both < percent * len(np.union1d(base, other)):
                continue
            h, rows = np.concatenate([base, other]), np.repeat([0, 1], [len(base), len(other)])
            sig, of = set_join.signatures(h, rows, np.array([len(base), len(other)]), plan)
            assert len(np.intersect1d(sig[of == 0], sig[of == 1]))


@pytest.mark.parametrize("patch", [{"twos": True}, {"WAVE": 0.05}, {"NEAR": 1, "GROUP": 2, "LOOK": 2}])
def test_set_join_every_branch(docs, texts, monkeypatch, patch):
    """One-deletion segments alone (and sets with too many empty ones), several waves, groups that are paired on the spot."""
    if patch.pop("twos", False):
        def forced(low, high, n, percent):
            twos = (set_join.apart(low, high, percent) + 2) // 2
            return (0, twos) if set_join.apart(low, high, percent) else (1, 0)

        monkeypatch.setattr(set_join, "allocate", forced)
    for k, v in patch.items():
        monkeypatch.setattr(set_join, k, v)
    got = {r[0]: (r[1], r[2]) for r in set_join.near_duplicates(docs).collect()}
    assert got == jaccard_brute(texts, 4, 85)


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(2))
        x, y = (set_join.parity(v, np.zeros(len(v), int), np.array([len(v)]))[0] for v in (a, b))
        assert set_join.differ(x, y) <= len(np.setxor1d(a, b))


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    d = spark.createDataFrame(links, "a long, b long")
    got = {r[0]: r[1] for r in components(d, Shared(spark, "test")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100)}


# --- substring deduplication ---


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in [*range(12), 50, 51, 52, 300]:
        for a in (1, 2, 6):
            x = rng.integers(1, a + 1, n)
            assert difference_cover.suffix_array(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())


@pytest.mark.parametrize("n, kinds, local", [(300, 2, 40), (301, 3, 40), (302, 2, 60), (100, 26, 4), (64, 1, 8)])
def test_distributed_suffixes(spark, n, kinds, local, monkeypatch):
    monkeypatch.setattr(distributed_suffixes, "CHUNK", 16)
    x = np.random.default_rng(n).integers(1, kinds + 1, n)
    d = spark.createDataFrame([(i, int(v)) for i, v in enumerate(x)], "pos long, sym long").repartition(3)
    got = {r["pos"]: r["rank"] for r in distributed_suffixes.suffix_ranks(d, Shared(spark, "test"), local).collect()}
    want = sorted(range(n), key=lambda i: x[i:].tolist())
    assert [got[i] for i in want] == list(range(1, n + 1))


def removed_brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        rest = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(rest).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_substring_dedup(docs, texts, empty, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    got = {r[0]: tuple(r[1:]) for r in substring_dedup.removals(docs).collect()}
    assert got == removed_brute(list(enumerate(texts)))
    if hot == 1:
        assert substring_dedup.removals(empty).count() == 0


def test_contexts_do_not_depend_on_neighbours(texts, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SPAN", 700)
    some = [(t or "").encode() for t in texts]

    def of(order):
        off = np.concatenate([[0], np.cumsum([len(some[i]) for i in order])])
        row, first, last, anchor = substring_dedup.contexts(np.frombuffer(b"".join(some[i] for i in order), np.uint8), off)
        return sorted((order[r], f - off[r], k - off[r], int(h)) for r, f, k, h in zip(row, first, last, anchor, strict=True))

    order = list(range(len(some)))
    assert of(order) == of(order[::-1]) == of(sorted(order, key=lambda i: (i * 7) % len(some)))


@pytest.mark.parametrize("span", [300, 5000])
def test_substring_dedup_spans(spark, texts, span, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SPAN", span)
    rows = list(enumerate(texts))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {r[0]: tuple(r[1:]) for r in substring_dedup.removals(d).collect()} == removed_brute(rows)


def test_substring_dedup_text(spark):
    r = random.Random(5)
    line = "".join(r.choice("éàüñabc") for _ in range(120))
    d = spark.createDataFrame([(1, f"{line} a"), (2, f"b {line}"), (None, line)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in substring_dedup.removals(d, text_out=True).collect()}
    assert got == {1: f"{line} a", 2: "b ", None: line}


# --- decontamination ---


def test_decontamination(spark, empty):
    items = [(k, prose(500 + k, 14 + 5 * k)) for k in range(8)] + [(20, "one two three"), (21, ""), (22, None), (23, prose(500, 14))]
    docs = [(0, prose(1, 300)), (1, prose(2, 80) + "\n" + items[2][1] + "\n" + prose(3, 90)), (2, items[5][1].upper()), (3, prose(4, 20) + " " + edited(items[7][1], 1, 1) + " " + prose(5, 20)),
            (4, None), (5, ""), (6, "so one, two; three!"), (7, items[0][1]), (8, " ".join(items[6][1].split()[: len(items[6][1].split()) // 2]))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(d, b).collect()}
    assert got == {(1, 2), (2, 5), (3, 7), (6, 20), (7, 0), (7, 23)}
    assert decontamination.leaks(d, b.limit(0)).count() == 0
    assert decontamination.leaks(empty, b).count() == 0


def leaks_of(docs, items):
    """Items by document, and their similarities, by comparing every window with every item."""
    word = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    own = {i: (len(word(t)), min(5, len(word(t)))) for i, t in items}
    sets = {i: set(grams(word(t), own[i][1])) for i, t in items}
    count = collections.Counter(x for s in sets.values() for x in s)
    out = {}
    for d, t in docs:
        w = word(t)
        for i, s in sets.items():
            n, k = own[i]
            weight = {x: 1 / (1 + np.log(count[x])) for x in s}
            sims = [(sum(weight[x] for x in s & set(grams(w[c : c + n], k))) / sum(weight.values()), -c) for c in range(len(w) - n + 1)]
            if sims and max(sims)[0] >= 0.8 - 1e-12:
                out[d, i] = (round(max(sims)[0], 9), -max(sims)[1])
    return out


def found_leaks(spark, docs, items):
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    return {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["start_word"]) for r in got}


def test_decontamination_of_items_that_share_a_passage(spark):
    passage = prose(700, 36)
    items = [(k, passage + " " + prose(710 + k % 3, 8)) for k in range(60)]  # three questions on one passage, each twenty times
    docs = [(10 * k + j, prose(800 + j, 12) + " " + edited(items[k][1], 900 + 31 * k + j, 1) + " " + prose(850 + j, 12)) for k in range(3) for j in range(8)]
    want = leaks_of(docs, items)
    assert len(want) > 300
    assert found_leaks(spark, docs, items) == want


@pytest.mark.parametrize(("phrases", "times"), [(1, 30), (5, 10), (5, 6)])
def test_decontamination_of_exact_copies_with_repeated_phrases(spark, phrases, times):
    items = [(k, " ".join([prose(1000 + k, 36)] + [prose(1100 + 10 * k + p, 5) for p in range(phrases) for _ in range(times)])) for k in range(20)]
    got = decontamination.leaks(spark.createDataFrame(items, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"], r["similarity"]) for r in got) == [(k, k, 0, 1.0) for k in range(20)]


def test_decontamination_does_not_depend_on_blocks(spark, monkeypatch):
    passage = prose(700, 12)
    items = [(k, passage + " " + prose(2000 + k, 9)) for k in range(40)] + [(50, "one two three"), (51, ""), (52, None)]
    docs = [(k, prose(2100 + k, 12) + " " + items[k][1].replace(" ", " new ", k % 3) + " " + edited(items[k + 1][1], k, 1)) for k in range(30)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(decontamination.leaks(d, b).collect())
    assert {(r["doc_id"], r["item_id"]) for r in whole} == set(leaks_of(docs, items[:41]))
    number = decontamination.item_blocks
    monkeypatch.setattr(decontamination, "item_blocks", lambda *a: number(*a, 1500))
    assert sorted(decontamination.leaks(d, b).collect()) == whole


def test_decontamination_recall_at_the_threshold():
    """Windows that keep just enough of an item, with words of other items among the new ones: none is lost."""
    r = random.Random(8)
    texts = [prose(3000 + k, r.choice((9, 12, 20, 33, 50))).replace("\n", " ") for k in range(60)]
    items = decontamination.Items(list(range(60)), texts)
    docs = []
    for k in range(600):
        own = texts[k % 60].split()
        shingles = max(1, len(own) - 4)
        lost = int(0.2 * shingles + 1e-9)
        if lost:
            own[: min(lost, len(own))] = (prose(4000 + k, 60).split() if k % 2 else texts[(k + 7) % 60].split() * 9)[: min(lost, len(own))]
        docs.append(prose(5000 + k, 8).replace("\n", " ") + " " + " ".join(own) + " " + prose(6000 + k, 8).replace("\n", " "))
    want = leaks_of(list(enumerate(docs)), list(enumerate(texts)))
    assert len(want) >= 600
    raw = [t.encode() for t in docs]
    got = decontamination.matches(items, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw]))
    assert {(m[0], m[1]): (round(m[-1], 9), m[2]) for m in got} == want


@pytest.mark.parametrize("number", [10, 1000, 20000])
def test_index_prunes_however_many_items(number):
    """Unrelated items that a window is compared with: fewer than one in a hundred."""
    texts = [prose(10**6 + k, 20) for k in range(number)]
    items = decontamination.Items(list(range(number)), texts)
    raw = [prose(7 * 10**6, 40).encode(), *(t.encode() for t in texts[:10])]
    seen = []
    got = decontamination.matches(items, np.frombuffer(b"\n".join(raw) , np.uint8), np.cumsum([0] + [len(x) + 1 for x in raw[:-1]] + [len(raw[-1])]), seen)
    assert {m[1] for m in got} == set(range(10))
    windows, candidates = {}, 0
    for n, _, c in seen:
        windows[n] = n
        candidates += c
    assert candidates <= 4 * sum(windows) + 0.01 * number * sum(windows)


def test_blocks_hold_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 2**63, (300, decontamination.BLOCKS), dtype=np.uint64)
    near = prints[:40].copy()
    for k in range(40):
        for bit in rng.choice(64 * decontamination.BLOCKS, decontamination.BLOCKS * decontamination.RADIUS, replace=False):
            near[k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    p, q = decontamination.within(prints, near)
    far = np.bitwise_count(prints[:, None] ^ near[None]).sum(2)
    assert {(int(i), int(j)) for i, j in zip(p, q)} == {(int(i), int(j)) for i, j in zip(*np.nonzero(far <= decontamination.BLOCKS * decontamination.RADIUS))} >= {(k, k) for k in range(40)}


def test_near_tables_hold_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, 8)
    for _ in range(300):
        b = a.copy()
        for bit in rng.choice(64, decontamination.RADIUS, replace=False):
            b[bit // 8] ^= 1 << (bit % 8)
        assert any(decontamination._NEAR[x][y] for x, y in zip(a, b, strict=True))


# --- URL filter ---


def test_url_filter(spark):
    entries = [("example.com", "block", 10), ("example.com", "allow", 20), ("Sub.example.com", "block", 15), ("d.c.b.a.example.net", "block", 1), (None, "block", 1), ("example.org", None, 1)]
    pages = [(1, "http://example.com/x", 5), (2, "https://example.com", 10), (3, "http://example.com:80/", 20), (4, "http://u@sub.EXAMPLE.com/?q", 30), (5, "http://other.example.com/", 12),
             (6, "http://x.e.d.c.b.a.example.net", 3), (7, None, 3), (8, "nothing", 3), (9, "http://example.com/", None), (9, "http://example.com/", None), (10, "http://example.org", 9)]
    got = url_filter.temporal_filter(spark.createDataFrame(pages, "page_id long, url string, fetched long"), spark.createDataFrame(entries, "host string, action string, day long"))
    rows = sorted((r["page_id"], r["matched"], r["kept"]) for r in got.collect() if r["page_id"] != 9)
    assert rows == [(1, None, True), (2, "example.com", False), (3, "example.com", True), (4, "sub.example.com", False), (5, "example.com", False), (6, "d.c.b.a.example.net", False), (7, None, True), (8, None, True), (10, None, True)]
    assert got.where("page_id = 9").count() == 2


# --- tokens and packing ---


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    return [np.array(t.encode(x or "", add_special_tokens=False).ids, dtype="<u4") for x in texts]


def test_encoder(texts):
    odd = ["a  b", " a", "a ", "a \n b", "x\n\n y", "\n", "  ", "a\tb c", "<|endoftext|> x", "　 x", "it's 12"]
    e = packing.Encoder(vocabulary())
    for t, want in zip([*texts, *odd], ids_of([*texts, *odd]), strict=True):
        assert e.encode(t or "") == want.tobytes(), t


def test_packing(docs, texts, empty):
    got = packing.pack_documents(docs, vocabulary()).toPandas()
    for i, want in enumerate(ids_of(texts)):
        want = np.append(want, 0).astype("<u4")
        g = got[got.doc_id == i].sort_values("start")
        assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == len(want) == g.doc_tokens.iloc[0]
        for r in g.itertuples():
            assert r.ids_crc32 == zlib.crc32(want[r.start : r.start + r.length].tobytes())
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1024
    assert packing.pack_documents(empty, vocabulary()).count() == 0


def test_differencing_is_near_equal():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 257, 400).tolist()
    w = packing.windows(sizes)
    sums = np.bincount(w, weights=sizes)
    assert sums.max() <= 1024 and len(sums) <= -(-sum(sizes) // 1024) + 2
    assert packing.windows([1024, 1024]).tolist() in ([0, 1], [1, 0])
    assert packing.windows([]).tolist() == []
    assert sorted(np.bincount(packing.windows([700, 700, 700], 1024)).tolist()) == [1, 1, 1]


@pytest.mark.parametrize("size, chunk", [(4, 2), (7, 3), (1 << 16, 1024)])
def test_token_counts(spark, size, chunk, monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK", chunk)
    rng = np.random.default_rng(size)
    files = {1: rng.integers(0, 4, 100), 2: np.zeros(9, int), 3: np.full(20, 3), 4: np.zeros(0, int), 5: np.array([1, 2, 0])}
    blocks, want = [], set()
    for f, t in files.items():
        raw = t.astype("<u2").tobytes()
        blocks += [(f, k, raw[2 * size * k : 2 * size * (k + 1)]) for k in range(max(1, -(-len(t) // size)))]
        start, doc = 0, 0
        for p, x in enumerate(t.tolist()):
            if x == 0:
                want.add((f, doc, start, p - start, True))
                start, doc = p + 1, doc + 1
        if start < len(t):
            want.add((f, doc, start, len(t) - start, False))
    d = spark.createDataFrame([(f, k, bytearray(b)) for f, k, b in blocks], "file_id long, block long, tokens binary")
    assert {tuple(r) for r in token_files.token_counts(d, 0).collect()} == want


def test_token_files_on_disk(spark, tmp_path):
    t = np.array([5, 6, 0, 7, 0, 0, 9], "<u2")
    (tmp_path / "a.bin").write_bytes(t.tobytes())
    d = token_files.from_files(spark, str(tmp_path), 2, 3)
    got = sorted((r["document"], r["n_tokens"], r["closed"]) for r in token_files.token_counts(d, 0).collect())
    assert got == [(0, 2, True), (1, 1, True), (2, 0, True), (3, 1, False)]


def test_token_files_are_read_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "RANGE", 40)
    rng = np.random.default_rng(9)
    want = []
    for name in ("a b", "c"):
        t = rng.integers(0, 5, 333).astype("<u4")
        (tmp_path / name).write_bytes(t.tobytes())
        cut = np.flatnonzero(t == 0)
        start = np.concatenate([[0], cut + 1])
        want += [(int(s), int(e - s)) for s, e in zip(start, [*cut, len(t)], strict=True) if s < len(t)]
    d = token_files.from_files(spark, str(tmp_path), 4, 3)
    got = token_files.token_counts(d, 0, 4).collect()
    assert sorted((r["start"], r["n_tokens"]) for r in got) == sorted(want)
    assert d.count() == 2 * 111 and len({r["file_id"] for r in got}) == 2
    (tmp_path / "c").write_bytes(b"123")
    with pytest.raises(ValueError, match="whole ids"):
        token_files.from_files(spark, str(tmp_path), 4, 3)


def test_flat_blocks_round_trip(spark, docs, texts):
    made = Shared(spark, "test").keep(token_files.flat_blocks(docs, vocabulary(), 50256, block_tokens=500), "flat")
    counts = token_files.token_counts(made.where("tokens IS NOT NULL"), 50256)
    ids = made.where("tokens IS NULL").select("file_id", F.col("block").alias("document"), "doc_id")
    got = {r["doc_id"]: r["n_tokens"] for r in counts.join(ids, ["file_id", "document"]).collect()}
    assert got == {i: len(x) for i, x in enumerate(ids_of(texts))}


def test_vocabulary_is_not_copied():
    assert "vocab" in json.load(open(vocabulary()))["model"]
