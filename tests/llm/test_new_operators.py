"""Spelling variants, embedding near-dedup and importance resampling against brute force, and on the edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from prismlake.llm import mixing, resampling, spherical, variants
from pyspark.sql import functions as F

# ------------------------------------------------------------- 11


def brute_variants(docs):
    """Words and their near words by trying every addition, removal and exchange."""
    count = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    vocabulary = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    alphabet = sorted({c for w in vocabulary for c in w})
    near, form = {}, {}
    for w in vocabulary:
        tried = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}
        tried |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in ["", *alphabet]}
        near[w] = [x for x in tried if x != w and x in vocabulary]
        best = min(near[w], key=lambda x: (-vocabulary[x], x), default=None)
        form[w] = best if best and vocabulary[best] >= 2 * vocabulary[w] else None
    out = {}
    for w in vocabulary:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, vocabulary[w], len(near[w]), vocabulary.get(form[w]))
    return out


def found_variants(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.group(df).collect()}


def spelled(seed=2):
    """Texts of a small vocabulary with slips, anagrams and doubled letters."""
    rng = random.Random(seed)
    base = ["letter", "lettre", "hello", "anemone", "ÀÉñîø", "straÿe", "banana", "nabana", "aaaaa", "abcde", "×÷×÷×"]
    out = []
    for _ in range(80):
        row = []
        for _ in range(40):
            w = rng.choice(base)
            if rng.random() < 0.25:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("aelxÉ") + w[at:], w[:at] + rng.choice("aelxÉ") + w[at + 1 :]])
            row.append(w.capitalize() if rng.random() < 0.1 else w)
        out.append(" ".join(row))
    return out


def test_spelling_variants(spark, docs, texts, empty, clashing):
    assert found_variants(docs) == brute_variants(list(enumerate(texts))) == found_variants(clashing)
    rows = [*enumerate(spelled()), (None, "letter letter letter leter leter leter"), (900, None), (901, ""), (902, "12 34"), (903, "uvwxyq " * 3 + "uvwxyp " * 8 + "tvwxyp " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_variants(rows)
    assert found_variants(df) == want and any(x[0] != x[1] for x in want.values() if x[0]) and max(x[3] for x in want.values()) > 5
    assert found_variants(df.union(df)) == brute_variants(rows + rows)
    assert found_variants(empty) == {}


def test_long_words_and_flushed_counts(spark, monkeypatch):
    """Words far beyond the pattern's size, compared by what is left of them; counts handed on early; a hot anagram key."""
    monkeypatch.setattr(variants, "KEEP", 50)
    rng = random.Random(1)
    long = "".join(rng.choice("ab") for _ in range(700))
    scrambled = ["".join(rng.sample("abcdefg", 7)) for _ in range(300)]
    rows = [(i, " ".join([long, long[:350] + long[351:], long[:350] + "c" + long[351:], "z" * 2000, "z" * 2001, *scrambled])) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: r for r in variants.group(df, corrupt=None).collect()}
    assert got[long].n_near == 2 and got["z" * 2000].n_near == 1 and len(got) == len({*scrambled}) + 5
    pairs = {w: sum(len(w) == len(v) and sum(a != b for a, b in zip(w, v, strict=True)) == 1 for v in {*scrambled}) for w in scrambled}
    assert all(got[w].n_near == n for w, n in pairs.items())


def test_anagram_keys_meet_for_every_edit():
    key = lambda w: int(variants.POWER[np.frombuffer(w.encode("latin-1"), np.uint8)].sum())
    power = lambda c: int(variants.POWER[ord(c)])
    assert key("listen") == key("silent") and key("hello") - power("l") == key("helo") and key("helo") + power("x") - power("h") == key("xelo")


# ------------------------------------------------------------- 12


def brute_links(rows, threshold=0.98):
    """n_links and component by all pairs."""
    n = len(rows)
    sound = []
    for _, v, label in rows:
        ok = label is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)
        sound.append(np.array(v, float) if ok else None)
    links = [[] for _ in range(n)]
    for i in range(n):
        for j in range(n):
            if i != j and sound[i] is not None and sound[j] is not None and rows[i][2] == rows[j][2] and len(sound[i]) == len(sound[j]):
                a, b = sound[i] / np.abs(sound[i]).max(), sound[j] / np.abs(sound[j]).max()
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i].append(j)
    part = list(range(n))
    for i in range(n):
        stack, seen = [i], {i}
        while stack:
            for j in links[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        part[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    return Counter((r[0], len(k), p) for r, k, p in zip(rows, links, part, strict=True))


def found_links(df):
    return Counter((r.id, r.n_links, r.component_id) for r in spherical.components(df).collect())


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n=400, dim=12, seed=3):
    """Loose balls, tight families, copies, and all that cannot be linked."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        v = centres[i % 6] + rng.normal(size=dim) * (0.05 if i % 3 else 0.6)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 2) if i % 17 else None))
    copy = rows[5][1]
    rows += [(n + i, copy, 1) for i in range(30)] + [(n + 40, [2 * x for x in copy], 1), (n + 41, copy, 0), (None, copy, 1), (None, [1.0] * dim, 7), (3, copy, 1), (5, copy, 1)]
    rows += [(n + 50, None, 1), (n + 51, [], 1), (n + 52, [0.0] * dim, 1), (n + 53, [float("nan")] * dim, 1), (n + 54, [float("inf")] * dim, 1), (n + 55, [None] * dim, 1), (n + 56, copy[:5], 1), (n + 57, copy[:5], 1)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_embedding_near_dedup(spark, monkeypatch, small):
    if small:  # cells within cells, blocks of a few rows, models and copies beyond a broadcast
        for name, value in (("CELL", 12), ("FAN", 3), ("BLOCK", 5), ("BROADCAST_BYTES", 1000)):
            monkeypatch.setattr(spherical, name, value)
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    assert found_links(df) == brute_links(rows)
    if not small:
        clash = df.withColumns({c: F.lit(1) for c in ("id", "v", "w", "cid", "path", "home", "n", "least", "component", "kept", "at")})
        assert found_links(clash) == brute_links(rows)
        assert found_links(df.limit(0)) == Counter()


def test_representatives(spark):
    rows = vectors(60)
    df = spark.createDataFrame(rows, VECTORS).withColumns({"id": F.lit("x"), "at": F.lit(2)})
    out = spherical.representatives(df)
    kept = {r[0] for r in brute_links(rows) if r[0] == r[2]}
    assert out.columns == df.columns
    ids = [r.vec_id for r in out.collect()]
    assert set(ids) == kept and len(ids) == len(kept) and {None, 3} <= kept


def test_cells_lose_no_near_pair():
    """Whatever the centroids, a near pair's vectors reach each other's cells."""
    rng = np.random.default_rng(0)
    x = spherical.unit(rng.normal(size=(500, 8)))
    y = spherical.unit(x + rng.normal(size=x.shape) * 0.05)
    near = (x * y).sum(1) >= 0.98
    for c in (spherical.kmeans(x, 9), spherical.unit(rng.normal(size=(20, 8)))):
        home = (y @ c.T).argmax(1)
        assert near.sum() > 100 and spherical.reached(x @ c.T, c, 0.98)[np.arange(500), home][near].all()
        assert spherical.reached(x @ c.T, c, 0.98).mean() < 0.9


def test_spherical_kmeans_finds_balls():
    rng = np.random.default_rng(1)
    centre = spherical.unit(rng.normal(size=(4, 16)))
    x = spherical.unit(np.repeat(centre, 50, 0) + rng.normal(size=(200, 16)) * 0.02)
    cos = centre @ spherical.kmeans(x, 12).T
    assert (cos.max(1) > 0.99).all()


# ------------------------------------------------------------- 13


def brute_draw(docs, target, least=20, share=25, buckets=10_000):
    def grams(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        return len(w), [zlib.crc32(g.encode()) % buckets for g in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]

    own, wanted = [grams(t) for _, t in docs], [grams(t) for t in target]
    s, t = Counter(b for _, g in own for b in g), Counter(b for _, g in wanted for b in g)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for (i, _), (n, g) in zip(docs, own, strict=True):
        weight = sum(map(gain, g)) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0]))
    drawn = {id(r): k + 1 for k, r in enumerate(able[: share * len(able) // 100])}
    return Counter((*r[:4], drawn.get(id(r))) for r in rows)


def found_draw(df, target):
    return Counter((r.id, r.n_features, r.weight, r.score, r.rank) for r in resampling.resample(df, target).collect())


def test_importance_resampling(spark, docs, texts, empty, clashing, monkeypatch):
    target = [texts[4], texts[9], None, "Ünïcode words, and 12 numbers"]
    wanted = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    want = brute_draw(list(enumerate(texts)), target)
    assert found_draw(docs, wanted) == want == found_draw(clashing, wanted)
    # portions of a few words: long texts are cut between words and each run is counted once
    monkeypatch.setattr(resampling, "PORTION", 40)
    monkeypatch.setattr(resampling.parts, "__defaults__", (resampling.WIDTH, 40))
    assert found_draw(docs.repartition(1), wanted) == want
    monkeypatch.undo()
    rows = [(None, texts[0]), (None, texts[0]), (7, texts[1]), (7, texts[1]), (8, texts[2]), (-9, texts[2])]
    odd = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_draw(odd, wanted.limit(0)) == brute_draw(rows, [])
    assert found_draw(empty, wanted) == Counter()


def test_runs_of_other_widths(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "x")], "doc_id long, text string")
    counts = {w: {r.id: (r.n_words, sum(r.counts)) for r in resampling.spilled(df, "doc_id", "text", w, 50, "t").collect()} for w in (1, 3)}
    assert counts == {1: {"1": (4, 4), "2": (1, 1)}, 3: {"1": (4, 9), "2": (1, 1)}}


def test_texts_are_cut_between_words():
    text = "one two,three " * 50 + "x" * 300 + " end"
    for width in (1, 2, 3):
        cut = resampling.parts(text, width, 64)
        own = [w for lead, part in cut for w in re.findall(r"\w+", part)[lead:]]
        assert own == re.findall(r"\w+", text) and len(cut) > 5
        assert all(lead == width - 1 for lead, _ in cut[1:])


# ------------------------------------------------------------- 5


def test_null_is_not_the_value_that_is_shown_for_it(spark):
    rows = [(i, "word " * 40, None, (None, "(none)", "\\(none)", "web")[i % 4]) for i in range(80)]
    found = mixing.probabilities(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert {(r.doc_id % 4, r.source) for r in found.collect()} == {(0, "(none)"), (1, "\\(none)"), (2, "\\\\(none)"), (3, "web")}
