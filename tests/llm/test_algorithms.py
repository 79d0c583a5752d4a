"""Near-duplicates, overlaps, pieces, packing and mixing against brute force and exact round trips."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from millrace.llm import band, classes, mixing, neardup, numbering, overlap, packing, pieces, words

WORD = re.compile(r"[^\W_]+")


def shingles(text, size=3):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def similarity(a, b, size=3):
    x, y = shingles(a, size), shingles(b, size)
    return len(x & y) / len(x | y) if x and y else 0.0


def corpus(seed, n=40):
    """Texts that share passages, with copies and copies with small edits and moved sentences."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(25))
    out = {}
    for i in range(n):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 20))) for _ in range(rng.randint(3, 8))]
        if i % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), passage)
        out[f"d{i}"] = ". ".join(parts)
        for k in range(rng.randint(0, 2)):
            w = out[f"d{i}"].split()
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = rng.choice([[], ["zz"], [w[at].upper()]])
            out[f"d{i}-{k}"] = " ".join(w)
    return out | {"copy": out["d1"], "short-a": "two words", "short-b": "Two, words!", "one": "single", "blank": " ..", "empty": "", "null": None, "accents": "Über größe straße naïve", "accents-b": "über GRÖSSE straße naïve"}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("aB1 _-.é’ß\n", max_size=30), max_size=12))
def test_words_as_by_regex(texts):
    hashes, rows = words.words(pa.array(texts, pa.string()))
    expected = [WORD.findall(t.lower()) for t in texts]
    assert np.diff(rows).tolist() == [len(w) for w in expected]
    seen = {}
    for w, h in zip((w for ws in expected for w in ws), hashes.tolist()):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    s, at = words.shingles(hashes, rows, 3)
    assert [len(set(s[at[i] : at[i + 1]].tolist())) for i in range(len(texts))] == [len(shingles(t)) for t in texts]


def test_long_texts_in_blocks(monkeypatch):
    text = ["ab " * 5000 + "x" * 9000 + " end", None, "ab"]
    whole = words.words(pa.array(text))
    monkeypatch.setattr(words, "BLOCK", 512)
    parts = words.words(pa.array(text))
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


@pytest.mark.parametrize("size,threshold", [(3, 0.6), (5, 0.8)])
def test_near_duplicates_equal_brute_force(spark, size, threshold):
    texts = corpus(5)
    rows = [("t", k, v) for k, v in texts.items()] + [("t", "d0", texts["d0"]), ("t", None, "x")]
    df = spark.createDataFrame(rows, "tbl string, key string, text string")
    member = {r.key: r.rid for r in classes.members(classes.hashed(df)).collect()}
    assert set(member) == {k for k, v in texts.items() if shingles(v)}
    links = {frozenset((r.a, r.b)) for r in neardup.links(classes.class_words(classes.hashed(df)), threshold, size).collect()}
    for a in member:
        for b in member:
            if a < b:
                found = member[a] == member[b] or frozenset((member[a], member[b])) in links
                assert found == (similarity(texts[a], texts[b], size) >= threshold - 1e-12), (a, b)


def test_overlaps_find_pairs_across_splits(spark):
    texts = corpus(11, 80)
    side = {k: "eval" if hash_part(k) else "train" for k in texts}
    df = spark.createDataFrame([(side[k], k, v) for k, v in texts.items()], "tbl string, key string, text string")
    member = {r.key: r.rid for r in classes.members(classes.hashed(df)).collect()}
    e, t = (classes.class_words(classes.hashed(df.filter(f"tbl = '{s}'"))) for s in ("eval", "train"))
    links = {(r.a, r.b) for r in overlap.overlaps(e, t, classes.class_words(classes.hashed(df)), 0.6, 3).collect()}
    wanted = {(member[a], member[b]) for a in member for b in member if side[a] == "eval" and side[b] == "train" and member[a] != member[b] and similarity(texts[a], texts[b]) >= 0.6}
    assert links <= wanted and len(links) >= 0.97 * len(wanted) and wanted


def hash_part(key):
    return sum(map(ord, key)) % 3 == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 3), st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=9), st.lists(st.integers(0, 3), max_size=9)), min_size=1, max_size=20))
def test_banded_distance(k, rows):
    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    def flat(values):
        return np.array([v for x in values for v in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in values])])

    got = band.within(*flat([a for a, _ in rows]), *flat([b for _, b in rows]), k)
    assert got.tolist() == [distance(a, b) <= k for a, b in rows]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["word ", "end. ", "line\n", "\n\n", "x" * 400, "é "]), max_size=400).map("".join))
def test_pieces_cover_the_text(text):
    out = pieces.cut(text)
    if not text:
        assert out == []
        return
    assert out[0][0] == 0 and out[-1][1] == len(text)
    for (a, b), (c, d) in zip(out, out[1:]):
        assert a < c <= b < d and b - c <= 4 * pieces.OVERLAP
    assert all(max(1, (b - a) // 4) <= pieces.TOKENS for a, b in out)


def test_split_texts_and_files(spark, tmp_path):
    rng = random.Random(2)
    long = "".join(rng.choice(["word ", "Ende über. ", "line\n", "\n\n", "x" * 900]) for _ in range(6000))
    rows = [("long", long), ("short", "a b"), ("empty", ""), ("null", None), ("solid", "y" * 5000)]
    df = spark.createDataFrame(rows, "key string, text string")
    got = {}
    for r in pieces.split_texts(df, size=4096).collect():
        got.setdefault(r.key, {})[r.piece] = r
    assert set(got) == {"long", "short", "solid"} and len(got["short"]) == 1
    for key, text in (("long", long), ("solid", "y" * 5000)):
        own = [got[key][i] for i in range(len(got[key]))]
        assert own[0].begin == 0 and own[-1].end == len(text)
        assert all(p.text == text[p.begin : p.end] and len(p.text) // 4 <= 220 for p in own)
        assert all(a.begin < b.begin <= a.end < b.end for a, b in zip(own, own[1:]))
    path = tmp_path / "f.txt"
    path.write_text(long)
    raw = long.encode()
    own = sorted(pieces.split_files(spark, [str(path)], size=1 << 14).collect(), key=lambda r: r.piece)
    assert [r.piece for r in own] == list(range(len(own))) and own[0].begin == 0 and own[-1].end == len(raw)
    assert all(raw[p.begin : p.end].decode() == p.text for p in own) and all(b.begin <= a.end for a, b in zip(own, own[1:]))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 99), min_size=1, max_size=400), st.integers(100, 128))
def test_plan_places_every_item_once(lengths, capacity):
    sizes, counts = np.unique(lengths, return_counts=True)
    ranges, n = packing.plan(sizes, counts, capacity, number=20)
    load = np.zeros(n, np.int64)
    for i, own in ranges.items():
        place = 0
        for k, (first, per, base) in enumerate(own):
            assert first == place
            place = own[k + 1][0] if k + 1 < len(own) else int(counts[i])
            np.add.at(load, base + np.arange(place - first) // per, sizes[i])
        assert place == counts[i]
    assert load.max() <= capacity and (load > 0).all()
    assert n <= 1.7 * -(-sum(lengths) // capacity) + 1


def test_packed(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 5, 30, 64, 64, 64, 100, 130, 400])) for i in range(900)] + [(None, 5), (1000, None)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long")
    got = packing.packed(df, "p", 128).collect()
    load, whole = {}, {}
    for r in got:
        load[r.container] = load.get(r.container, 0) + r.tokens
        whole.setdefault(r.doc_id, []).append(r.tokens)
    assert max(load.values()) <= 128
    assert {d: sum(t) for d, t in whole.items()} == {d: t for d, t in rows if d is not None and t}
    assert all(len(t) == 1 for d, t in whole.items() if sum(t) <= 128)
    assert sum(load.values()) / (128 * len(load)) > 0.9
    assert packing.packed(df.filter("false"), "p", 128).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 5), min_size=1, max_size=6), st.integers(0, 60))
def test_knapsack_is_best(counts, budget):
    best = {0}
    for length, n in counts.items():
        best = {s + k * length for s in best for k in range(n + 1)}
    got = mixing.knapsack(list(counts), list(counts.values()), budget)
    assert all(n <= counts[k] for k, n in got.items())
    assert sum(k * n for k, n in got.items()) == max(s for s in best if s <= budget)


def test_mixture(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([" A-b", "a_b", "c", "c", "c", None, "x"]), rng.randint(0, 50)) for i in range(3000)]
    targets = spark.createDataFrame([("a_b", 0.5, 3), ("c", 0.4, 2), ("none", 0.1, 4)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    mixture = mixing.mixed(df, targets)
    shares = {r.source: r for r in mixing.report(mixture, targets).collect()}
    assert abs(shares["a_b"].actual_share - 5 / 9) < 1e-3 and abs(shares["c"].actual_share - 4 / 9) < 1e-3 and shares["none"].tokens == 0
    assert all(r.most_repeats <= r.max_repeats for r in shares.values())
    assert mixture.count() == mixture.select("doc_id").distinct().count()
    assert sorted(mixture.collect()) == sorted(mixing.mixed(df.repartition(5), targets).collect())


def test_numbering_of_a_hot_group(spark):
    df = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 'hot' else cast(id % 7 as string) end g")
    rows = numbering.numbered(df, ["g"], "id").collect()
    for g in {r.g for r in rows}:
        own = sorted(r["rank"] for r in rows if r.g == g)
        assert own == list(range(len(own)))


def test_overlaps_with_scattered_edits_are_all_found(spark):
    rng = random.Random(5)
    texts = {}
    for i in range(240):
        own = [f"w{rng.randrange(3000)}" for _ in range((4, 30, 60, 100, 200, 400)[i % 6])]
        texts[f"e{i}"] = " ".join(own)
        for at in rng.sample(range(len(own)), max(1, round(len(own) * rng.uniform(0.05, 0.1)))):
            own[at] = "new" + own[at]
        texts[f"t{i}"] = " ".join(own)
    df = spark.createDataFrame([("eval" if k[0] == "e" else "train", k, v) for k, v in texts.items()], "tbl string, key string, text string")
    member = {r.rid: r.key for r in classes.members(classes.hashed(df)).collect()}
    e, t = (classes.class_words(classes.hashed(df.filter(f"tbl = '{s}'"))) for s in ("eval", "train"))
    links = {(member[r.a], member[r.b]) for r in overlap.overlaps(e, t, classes.class_words(classes.hashed(df)), 0.6, 3).collect()}
    assert links == {(f"e{i}", f"t{i}") for i in range(240) if similarity(texts[f"e{i}"], texts[f"t{i}"]) >= 0.6} and len(links) > 100


def ranged(text, size=pieces.RANGE, tokens=pieces.TOKENS, overlap=pieces.OVERLAP):
    read, halo = lambda a, b: text[a:b], pieces.longest(tokens)
    return [p for i, _ in enumerate(pieces._stretches(len(text), size)) for p in pieces.stretch_pieces(read, i, len(text), tokens, overlap, size, halo)]


@pytest.mark.parametrize("text", ["x" * 5000, "y" * 200_000, ("word " * 4 + "\n\n") * 9000, ("A sentence stands here. " * 30 + "\n") * 300])
def test_pieces_overlap_everywhere(text):
    out = ranged(text)
    assert out[0][0] == 0 and out[-1][1] == len(text) and all(text[a:b] == t for a, b, t in out)
    assert all(b - a <= pieces.longest(pieces.TOKENS) for a, b, _ in out)
    assert all(0 < out[i][1] - out[i + 1][0] <= pieces.longest(pieces.OVERLAP) and out[i + 1][1] > out[i][1] for i in range(len(out) - 1))


def nearest_sum(histogram, budget, cap):
    supply = sum(k * n for k, n in histogram.items())
    repeats = min(budget // supply, cap)
    rest, sums = budget - repeats * supply if repeats < cap else 0, {0}
    for k, n in histogram.items():
        sums = {x + k * i for x in sums for i in range(n + 1)}
    return repeats * supply + min(sums, key=lambda x: (abs(x - rest), x))


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 4), min_size=1, max_size=5), st.integers(1, 600), st.integers(1, 3))
def test_draws_are_nearest(histogram, budget, cap):
    out = mixing.draw(histogram, budget, cap)
    assert out.tokens == nearest_sum(histogram, budget, cap)
    assert all(n <= histogram[k] for k, n in out.more.items())


def test_large_draws_meet_the_budget():
    rng = random.Random(3)
    histogram = {rng.randint(20, 4000): rng.randint(1, 3000) for _ in range(2500)}
    total = sum(k * n for k, n in histogram.items())
    out = mixing.draw(histogram, total * 37 // 100, 2, whole=1 << 20)
    assert out.tokens == total * 37 // 100 and all(n <= histogram[k] for k, n in out.more.items())
    assert mixing.draw({1000: 50, 7: 3}, 40003, 2).tokens == 40000


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), min_size=1, max_size=6), st.integers(1, 9000))
def test_draws_depend_on_no_size(histogram, budget):
    one, other = (mixing.draw(histogram, budget, 2, whole=w) for w in (1, 1 << 30))
    assert one == other and one.tokens == nearest_sum(histogram, budget, 2)


def test_large_draws_are_nearest():
    histogram = {1000: 3_000_000, 11: 80}
    budget = 1_234_567_960
    assert mixing.draw(histogram, budget, 1).tokens == min((1000 * i + 11 * j for i in range(1_234_560, 1_234_570) for j in range(81)), key=lambda x: (abs(x - budget), x))
    # Met only if some 5,000 documents of an equal share are exchanged.
    assert mixing.draw({10_007: 60_000, 10_009: 60_000}, 500_410_000, 1).tokens == 500_410_000
    assert mixing.draw({3000: 100_000, 7: 3}, 150_001_300, 1, whole=1 << 20).tokens == 150_000_021


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), min_size=40, max_size=90), st.lists(st.tuples(st.integers(0, 39), st.sampled_from("xyz"), st.sampled_from("isd")), max_size=4))
def test_what_a_band_finds_is_linked(text, edits):
    other = list(text)
    for place, letter, kind in edits:
        if kind == "i":
            other.insert(place, letter)
        elif kind == "s":
            other[place % len(other)] = letter
        else:
            del other[place % len(other)]
    batch = pa.array([" ".join(text), " ".join(other)])
    hashes, rows = words.words(batch)
    folded = classes.fold(hashes)
    sets = [classes.set3(folded[a:b]) for a, b in zip(rows[:-1], rows[1:])]
    value = classes.jaccard(*sets)
    n = min(map(len, sets))
    if band.within(folded[rows[0] : rows[1]], np.array([0, rows[1]]), folded[rows[1] :], np.array([0, rows[2] - rows[1]]), 4)[0] and n > 12:
        assert value >= (n - 12) / (n + 12) - 1e-9
