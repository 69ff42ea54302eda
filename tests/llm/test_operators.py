"""Each operator against a brute-force version, and on the edge cases."""

import hashlib
import os
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.llm import factorisation, licenses, line_dedup, linking, mixing, near_dedup, packing, quality_rules, spotsigs, suffix_dedup, textstats, toxicity


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def joined(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# ------------------------------------------------------------- 1


def brute_statistics(text):
    text = text or ""
    import re

    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    seen, dup = set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    grams = Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))
    covered = {i + k for i in range(len(found) - 4) if grams[tuple(found[i : i + 5])] > 1 for k in range(5)}
    return len(found), sum(map(len, found)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_rule_statistics(texts):
    odd = ["a\x0bb\x0cc\x1fd\x85e", "x\nx\n x\nx", "# | <b> &", "a b c d e f a b c d e", "  　"]
    for t in [*texts, *odd]:
        assert textstats.statistics(t)[:5] == brute_statistics(t)


def test_quality_rules(spark, docs, labels, texts, clashing, empty):
    judged = rows(quality_rules.judge(docs, labels))
    assert len(judged) == len(texts)
    for i, t in enumerate(texts):
        n, chars, symbols, dup, repeats = brute_statistics(t)
        r = judged[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeats)
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n)
        assert not (r.base_failed and r.kept)
    kept = quality_rules.filter_documents(clashing, labels)
    assert kept.columns == clashing.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in judged.items() if r.kept}
    assert quality_rules.judge(empty, labels).count() == 0
    assert quality_rules.judge(docs, labels.limit(0)).count() == len(texts)
    # rows that repeat are judged alike
    assert all(len({r.kept for r in g}) == 1 for g in _by(quality_rules.judge(docs.union(docs), labels).collect(), "doc_id").values())


def _by(found, key):
    out = defaultdict(list)
    for r in found:
        out[r[key]].append(r)
    return out


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (2000, 3))
    x[:20] += 12
    s = quality_rules.grow(x).score(x)
    assert s[:20].min() > np.quantile(s[20:], 0.99)


def test_path_lengths_by_hand():
    """Each point walked down each tree on its own."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (700, 3)).round(1)
    forest = quality_rules.grow(x, trees=20, subsample=64)

    def expected(n):
        return 0 if n < 2 else 1 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def walk(points, at, depth):
        """Leaf lengths by splitting the tree's own points again."""
        f = forest.feature[at]
        if f < 0:
            assert forest.length[at] == pytest.approx(depth + expected(len(points)))
            return 1
        go = points[:, f] >= forest.value[at]
        assert go.any() and not go.all()
        return walk(points[~go], forest.left[at], depth + 1) + walk(points[go], forest.left[at] + 1, depth + 1)

    for t, root in enumerate(forest.roots):
        assert walk(x[t::20][:64], root, 0) > 1
    for p in x[:40]:
        total = 0
        for root in forest.roots:
            at = root
            while forest.feature[at] >= 0:
                at = forest.left[at] + int(p[forest.feature[at]] >= forest.value[at])
            total += forest.length[at]
        assert forest.score(p[None])[0] == pytest.approx(2 ** (-total / len(forest.roots) / max(expected(35), 1)))


# ------------------------------------------------------------- 2


def test_fingerprints(docs, texts, clashing, empty):
    got = rows(spotsigs.compare_with_next(clashing), "id")
    assert len(got) == len(texts)
    order = sorted(range(len(texts)), reverse=True)
    for k, i in enumerate(order):
        t, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (set(spotsigs.signatures(x).tolist()) for x in (t, edited, after))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert r.near_edited == pytest.approx(like(a, b)) and r.near_next == pytest.approx(like(a, c))
        assert r.fingerprint == spotsigs.fingerprint(spotsigs.signatures(t)) and set(spotsigs.parsed(r.edited_fingerprint).tolist()) == b
    assert spotsigs.compare_with_next(empty).count() == 0
    assert spotsigs.compare_with_next(docs.union(docs)).count() == 2 * len(texts)


def test_spotsigs_groups_lose_no_link(docs, texts):
    sets = [set(spotsigs.signatures(t).tolist()) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-12]
    got = rows(spotsigs.groups(docs), "id")
    assert [got[i].component for i in range(len(texts))] == joined(len(texts), links)


# ------------------------------------------------------------- 3


@pytest.mark.parametrize("width", [4, 5])
def test_near_dedup(docs, texts, clashing, empty, width):
    sets = [near_dedup.shingle_set(t, width) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert links
    want = joined(len(texts), links)
    got = rows(near_dedup.components(clashing, width), "id")
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    if width == 5:
        kept = near_dedup.filter_documents(clashing.union(clashing))
        assert kept.columns == clashing.columns
        assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts)) if want[i] == i]
        assert near_dedup.components(empty).count() == 0


def test_near_dedup_of_null_and_repeated_ids(spark):
    same, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"x{i}" for i in range(60))
    near = same.replace("w30", "new")
    df = spark.createDataFrame([(None, same, 1), (5, same, 2), (5, other, 3), (7, near, 4), (8, None, 5), (None, "", 6), (9, other, 7), (9, other, 8), (2**60 + 1, "no copy of this one here", 9)], "doc_id long, text string, at long")
    kept = sorted(near_dedup.filter_documents(df).collect(), key=lambda r: r.at)
    assert [r.at for r in kept if r.at not in (7, 8)] == [1, 3, 5, 6, 9] and not any(r.at in (7, 8) for r in kept)
    assert kept[-1].doc_id == 2**60 + 1
    got = near_dedup.components(df).collect()
    assert Counter((r.id, r.component_id) for r in got) == Counter([(None, 5), (5, 5), (5, 5), (7, 5), (8, 8), (None, None), (9, 5), (9, 5), (2**60 + 1, 2**60 + 1)])


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    hasher = near_dedup.Hasher(1)
    for share in (0.2, 0.5, 0.8, 0.95):
        same = [f"s{i}" for i in range(int(2000 * share))]
        a = hasher(" ".join(same + [f"a{rng.integers(1 << 60)}" for _ in range(2000 - len(same))]))
        b = hasher(" ".join(same + [f"b{rng.integers(1 << 60)}" for _ in range(2000 - len(same))]))
        x, y = near_dedup.sketch(a), near_dedup.sketch(b)
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        est = near_dedup.estimate(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(est - j) < 0.13
        assert (near_dedup.merge(x, y) == near_dedup.sketch(np.union1d(a, b))).all()


def test_linking_large_bucket(spark):
    """A bucket too large for all its pairs: a chain, strays and a big family."""
    n = 700
    value = {i: (i if i < 120 else 1000 if i < 600 else 5000 + 10 * i) for i in range(n)}
    members = spark.createDataFrame([(k, i, 1) for i in range(n) for k in (7, 8)], "key long, id long, size long")
    table = spark.createDataFrame(list(value.items()), "id long, v long")

    def verify(pairs):
        a, b = table.toDF("a", "va"), table.toDF("b", "vb")
        return pairs.join(a, "a").join(b, "b").where("abs(va - vb) <= 1").select("a", "b")

    got = {r.id: r.component for r in linking.resolve(members, verify).collect()}
    want = {i: 0 if i < 120 else 120 if i < 600 else i for i in range(n)}
    assert all(got.get(i, i) == want[i] for i in range(n))


# ------------------------------------------------------------- 4


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def normal(line):
    import re

    return re.sub(r"[\W_]+", " ", line.lower()).strip()


def test_line_dedup(monkeypatch, docs, texts, clashing, empty):
    places = [(i, k, normal(x)) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n"))]
    places = [p for p in places if p[2]]
    assert {(r.doc.id, r.line_no) for r in line_dedup.lines(docs).collect()} == {p[:2] for p in places}
    links, fuzzy = [], 0
    for x in range(len(places)):
        for y in range(x):
            a, b = places[x][2], places[y][2]
            if a == b:
                links.append((x, y))
            elif min(a.count(" "), b.count(" ")) >= 4 and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and edits(a, b) <= 0.2 * max(len(a), len(b)):
                links.append((x, y))
                fuzzy += 1
    assert fuzzy > 20
    group = joined(len(places), links)
    gone = {places[x][:2] for x in range(len(places)) if group[x] != x}
    want = {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone) for i, t in enumerate(texts)}
    got = line_dedup.dedup(clashing)
    assert got.columns == [*clashing.columns, "_lines_removed"]
    assert {r.doc_id: r.text or "" for r in got.collect()} == want
    # a column of the result's name passes through
    named = line_dedup.dedup(docs.withColumn("_lines_removed", F.lit(9)))
    assert named.columns == [*docs.columns, "_lines_removed", "__lines_removed"]
    assert all(r._lines_removed == 9 and r.text == t.text for r, t in zip(named.orderBy("doc_id").collect(), got.orderBy("doc_id").collect(), strict=True))
    # beyond the broadcast bound the lines come by a shuffle; blocks of three lines are large
    monkeypatch.setattr(line_dedup, "BROADCAST_DOCS", 0)
    monkeypatch.setattr(linking, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(line_dedup, "FAN", 2)
    assert {r.doc_id: r.text or "" for r in line_dedup.dedup(clashing).collect()} == want
    assert line_dedup.dedup(empty).count() == 0
    assert line_dedup.dedup(docs.union(docs)).count() == 2 * len(texts)


def test_lines_of_null_and_short(spark):
    df = spark.createDataFrame([(None, "one two\n---\n\nkeep me"), (2, "One, two!\n---\n\nand me"), (3, None), (4, "one two")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r._lines_removed) for r in line_dedup.dedup(df).collect()}
    assert got == {None: ("one two\n---\n\nkeep me", 0), 2: ("---\n\nand me", 1), 3: (None, 0), 4: ("", 1)}


def test_simhash_is_the_majority_of_bits(spark):
    rng = np.random.default_rng(5)
    given = [rng.integers(-(2**63), 2**63, n).tolist() for n in (1, 2, 7, 127, 128, 1000)]
    got = spark.createDataFrame(list(enumerate(given)), "i int, h array<bigint>")
    for r in line_dedup.with_simhash(got, "h", "s").collect():
        h = np.array(given[r.i])
        want = sum(1 << k for k in range(64) if 2 * int(((h >> k) & 1).sum()) > len(h))
        assert r.s & (2**64 - 1) == want


@pytest.mark.parametrize("fan", [2])
def test_large_blocks_of_strangers(spark, monkeypatch, fan):
    """Lines that share a template of half their words, and pairs of them that are alike."""
    monkeypatch.setattr(line_dedup, "FAN", fan)
    rng = np.random.default_rng(9)
    make = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7))
    template = [make() for _ in range(10)]
    given = []
    for _ in range(150):
        w = [x for t in template for x in (t, make())]
        given += [" ".join(w), " ".join([*w[:3], make(), *w[4:]])]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r.doc_id: r._lines_removed for r in line_dedup.dedup(df).collect()}
    assert [got[i] for i in range(len(given))] == [i % 2 for i in range(len(given))]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the given tables are not here")
def test_recall_of_fuzzy_lines(spark):
    """Lines of documents whose id is divisible by 50, against all lines, by plain edit similarity."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    line = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", line_dedup.word_list(F.col("line")).alias("w")).where("size(w) >= 5")
    line = line.select("doc_id", F.xxhash64("w").alias("h"), F.array_join("w", " ").alias("t")).withColumn("n", F.length("t")).cache()
    a, b = line.where("doc_id % 50 = 0").dropDuplicates(["h"]).toDF("i", "a", "ta", "na"), line.dropDuplicates(["h"]).toDF("j", "b", "tb", "nb")
    far = F.expr("levenshtein(ta, tb, cast(floor(0.2 * greatest(na, nb) + 1e-9) as int)) >= 0")
    true = a.join(b, (F.col("a") != F.col("b")) & (F.col("nb") * 5 >= F.col("na") * 4) & (F.col("na") * 5 >= F.col("nb") * 4) & far).select("a", "b").collect()
    part = {r.id: r.component for r in line_dedup.groups(line_dedup.lines(docs), docs).collect()}
    caught = sum(r.a in part and part[r.a] == part.get(r.b) for r in true)
    assert len(true) > 10 and caught >= 0.95 * len(true)


def test_fuzzy_lines_are_linked(spark):
    base = " ".join(f"word{i} again" for i in range(150))
    near = base.replace("word77 ", "word7 ")
    df = spark.createDataFrame([(1, base), (2, near), (3, "another line of five words")], "doc_id long, text string")
    assert {r.doc_id: r._lines_removed for r in line_dedup.dedup(df).collect()} == {1: 0, 2: 1, 3: 0}


@pytest.mark.parametrize("length", [(5, 6, 7, 8, 10, 13), (16, 20, 30, 40, 100)])
def test_recall_with_a_fifth_of_the_words_replaced(spark, length):
    rng = np.random.default_rng(11)
    make = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10)))
    given, base = [], [make() for _ in range(3000)]
    while len(given) < 400:
        w = rng.choice(base, rng.choice(length)).tolist()
        near = list(w)
        for at in rng.choice(len(w), max(1, round(0.18 * len(w))), replace=False):
            near[at] = make()[: len(w[at])]
        if sum(max(len(x), len(y)) for x, y in zip(w, near, strict=True) if x != y) <= 0.2 * len(" ".join(w)):
            given += [" ".join(w), " ".join(near)]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    assert sum(r._lines_removed for r in line_dedup.dedup(df).collect()) >= 0.9 * 200


@pytest.mark.parametrize("change", ["word", "typo", "dropped"])
def test_lines_with_a_changed_word_are_linked(spark, change):
    rng = np.random.default_rng(8)
    make = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(5, 10)))
    given = []
    for n in (6, 8, 10, 13, 16, 20, 40, 100):
        for _ in range(20):
            w = [make() for _ in range(n)]
            at = min(range(n), key=lambda k: len(w[k]))
            new = {"word": [make()[:5]], "typo": [w[at][:2] + "zq"[w[at][2] == "z"] + w[at][3:]], "dropped": []}[change]
            given += [" ".join(w), " ".join([*w[:at], *new, *w[at + 1 :]])]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r.doc_id: r._lines_removed for r in line_dedup.dedup(df).collect()}
    assert [got[i] for i in range(len(given))] == [i % 2 for i in range(len(given))]


def test_long_lines_keep_the_proportional_bound(spark):
    w = [f"word{i}again" for i in range(400)]
    near = [y for i, x in enumerate(w) for y in ([x, "addition"] if i % 40 == 7 else [x])]
    far = [x if i % 2 else f"other{i}thing" for i, x in enumerate(w)]
    df = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert 64 < 10 * len("addition ") < 0.2 * len(" ".join(w))
    assert {r.doc_id: r._lines_removed for r in line_dedup.dedup(df).collect()} == {1: 0, 2: 1, 3: 0}


def test_no_line_of_a_large_block_is_left_out(spark):
    """Pairs alike in a block of 40 lines, which share no word among the first that their block's least line lacks."""
    rng = np.random.default_rng(13)
    made = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(8000)]
    rank = {r.w: r.s[0] for r in spark.createDataFrame([(w,) for w in made], "w string").select("w", line_dedup.sketch(F.array("w")).alias("s")).collect()}
    made = sorted(rank, key=rank.get)
    # ranks rise from layer to layer: three words of all lines, then words of one line (0) or of a pair (1), then the pair's others
    head, layers, rest = made[:3], np.array_split(made[3:1003], 7), made[1003:]
    given = []
    for i in range(20):
        tail = rest[40 * i : 40 * i + 40]
        for k in range(2):
            own = [layers[j][2 * i + (0 if both else k)] for j, both in enumerate((0, 0, 0, 1, 0, 1, 0))]
            given.append(" ".join([*head, *own, *tail]))
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r.doc_id: r._lines_removed for r in line_dedup.dedup(df).collect()}
    assert 2 * 20 > line_dedup.FAN and [got[i] for i in range(40)] == [i % 2 for i in range(40)]


def test_pairs_of_a_passage_in_many_lines_are_no_rows(spark, monkeypatch):
    """Lines of one long passage and own words, each alike with one other only: all pairs are decided, few become rows."""
    rng = np.random.default_rng(19)
    make = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7))
    passage, given = [make() for _ in range(30)], []
    for i in range(100):
        own = [make() for _ in range(14)]
        given += [" ".join([*own, *passage]), " ".join([*own[:3], make(), *own[4:], *passage])]
    rows = Counter()
    for name in ("_proven", "_compared"):

        def counted(pairs, texts, name=name, real=getattr(line_dedup, name)):
            rows[name] += pairs.count()
            return real(pairs, texts)

        monkeypatch.setattr(line_dedup, name, counted)
    # three portions
    monkeypatch.setattr(line_dedup, "PORTION", 70)
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r.doc_id: r._lines_removed for r in line_dedup.dedup(df).collect()}
    assert [got[i] for i in range(200)] == [i % 2 for i in range(200)]
    assert max(rows.values()) < 200 * 199 / 2 / 4


@pytest.mark.parametrize("a, b, edits", [("x y z", "x z", 2), ("x", "y x", 2), ("same a b", "same", 4), ("ab cd ef", "ab zd ef", 1), ("p q", "p q p q", 4), ("abc " * 40 + "q", "q " + "abc " * 39 + "abc", 4), ("kitten " * 30, "sitting " * 30, 90)])
def test_words_of_both_ends_do_not_change_the_distance(spark, a, b, edits):
    a, b = a.strip(), b.strip()
    df = spark.createDataFrame([(a.split(), b.split(), k) for k in (edits - 1, edits, edits + 1)], "a array<string>, b array<string>, k int")
    alike = [r.alike for r in df.select("k", line_dedup._alike(F.col("a"), F.col("b"), F.col("k")).alias("alike"), line_dedup._alike(F.col("b"), F.col("a"), F.col("k")).alias("back")).orderBy("k").collect() if r.alike == r.back]
    assert alike == [df.selectExpr(f"levenshtein('{a}', '{b}') <= {k} x").first().x for k in (edits - 1, edits, edits + 1)]


def test_lines_are_compared_from_the_end_that_tells_them_apart(spark):
    """A passage near the beginning, and other words behind it: the comparison by characters need not read the passage."""
    rng = np.random.default_rng(23)
    make = lambda n: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(n)]
    rows = []
    for _ in range(8):
        passage = make(300)
        rows.append((make(5) + passage + make(300), make(5) + passage + make(300)))
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", F.array_join("a", " ").alias("x"), F.array_join("b", " ").alias("y")).coalesce(1).cache()
    most = line_dedup._most(F.length("x"), F.length("y"))
    plain, ours = F.call_function("levenshtein", F.col("x"), F.col("y"), most) >= 0, line_dedup._alike(F.col("a"), F.col("b"), most)

    def seconds(alike):
        start = time.perf_counter()
        assert df.where(alike).count() == 0
        return time.perf_counter() - start

    assert min(seconds(ours) for _ in range(3)) < 0.7 * min(seconds(plain) for _ in range(3))


@pytest.mark.parametrize("where", ["begin", "end"])
def test_both_directions_decide_alike(spark, where):
    """Short and long lines at the very bound, with the passage at either end."""
    rng = np.random.default_rng(29)
    make = lambda n: ["".join(rng.choice(list("abcdéê"), rng.integers(1, 9))) for _ in range(n)]
    rows = []
    for n in (1, 2, 3, 8, 30, 500):
        for _ in range(3):
            one, two = make(n), make(n)
            passage = make(3 * n)
            parts = [["p", *passage, *w] if where == "begin" else [*w, *passage, "p"] for w in (one, two)]
            parts[1][0 if where == "begin" else -1] = "q"
            rows.append((parts[0], parts[1]))
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").where("a <> b").select("a", "b", F.levenshtein(F.array_join("a", " "), F.array_join("b", " ")).alias("d")).cache()
    for less in (0, 1):
        k = F.col("d") - less
        got = [r.alike for r in df.select(line_dedup._alike(F.col("a"), F.col("b"), k).alias("alike")).collect()]
        assert len(got) == 18 and set(got) == {not less}


def test_what_no_bound_proves_is_compared(spark):
    """A word more, and a typo in every fourth word of long lines, a short one: no run of four words is left, and few edits."""
    rng = np.random.default_rng(17)
    given = []
    for n in (150, 400):
        for _ in range(5):
            w = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 4 if i % 4 == 1 else 8)) for i in range(n)]
            given += [" ".join(w), "more " + " ".join(x[:2] + "0" + x[3:] if i % 4 == 1 else x for i, x in enumerate(w))]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r.doc_id: r._lines_removed for r in line_dedup.dedup(df).collect()}
    assert [got[i] for i in range(len(given))] == [i % 2 for i in range(len(given))]


# ------------------------------------------------------------- 5


def test_raking_meets_marginals(spark):
    rng = np.random.default_rng(2)
    cells = [(f"s{a}", f"l{b}", f"t{c}", int(rng.integers(200, 2000)) * (30 if a == 0 else 1)) for a in range(4) for b in range(3) for c in range(2)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    got = mixing.raked(df, keep=0.1).collect()
    tokens = {(s, lang, t): n for s, lang, t, n in cells}
    total = sum(tokens.values())
    for k, d in enumerate(mixing.DIMENSIONS):
        have, target = Counter(), Counter()
        for r in got:
            have[r[d]] += r.probability * tokens[r.source, r.lang, r.topic]
        for c, n in tokens.items():
            target[c[k]] += n
        norm = sum(n**0.5 for n in target.values())
        for v in target:
            assert have[v] == pytest.approx(0.1 * total * target[v] ** 0.5 / norm, rel=0.02)
    given = mixing.raked(df, {"source": {"s1": 1.0}}, keep=0.01).collect()
    assert all((r.probability > 0) == (r.source == "s1") for r in given)


def test_mixing(docs, labels, texts, clashing, empty):
    got = mixing.probabilities(docs).collect()
    assert len(got) == len(texts) and all(0 <= r.probability <= 1 for r in got)
    for r in got:
        u = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:13], 16) / 16**13
        assert r.kept == (u < r.probability)
        assert r.tokens == brute_statistics(texts[r.doc_id])[0]
    kept = mixing.sample(clashing.drop("topic"))
    assert kept.columns == clashing.drop("topic").columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert mixing.sample(clashing).columns == clashing.columns
    assert mixing.probabilities(empty).count() == 0 and mixing.sample(empty).count() == 0


# ------------------------------------------------------------- 6


def test_packing(docs, texts, clashing, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(clashing.union(docs.where("doc_id = 3").select(*[F.col(c) if c in docs.columns else F.lit(1).alias(c) for c in clashing.columns]))).collect()
    pieces = _by(got, "doc_id")
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for start, same in sorted(_by(pieces[i], "start").items()):
            assert len(same) == (2 if i == 3 else 1)
            r = same[0]
            assert start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for seq in _by(got, "sequence_id").values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(empty).count() == 0


def test_added_tokens_get_their_ids(spark):
    df = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "α <|endoftext|>"), (3, "a b")], "doc_id long, text string")
    enc = packing.encoder()
    assert enc.ids("a <|endoftext|> b").tolist() == [64, 220, 50256, 275, 1] and enc.ids("α <|endoftext|>").tolist()[-2:] == [50256, 1]
    got = {r.doc_id: r for r in packing.pack(df).collect()}
    assert got[1].doc_tokens == 5 and got[1].ids_crc32 == zlib.crc32(np.array([64, 220, 50256, 275, 1], "<u4").tobytes())


def test_packing_of_null_and_large_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (2**60 + 1, "a b"), (3, None)], "doc_id long, text string")
    got = packing.pack(df).collect()
    assert Counter(r.doc_id for r in got) == Counter([None, None, 2**60 + 1, 3])
    assert len({(r.sequence_id, r.offset) for r in got}) == 4


def test_shortest_pack_first():
    rng = np.random.default_rng(4)
    histogram = {int(n): int(rng.integers(1, 400)) for n in rng.choice(np.arange(1, 2049), 300, replace=False)}
    patterns = packing.shortest_pack_first(histogram)
    used = Counter()
    for pattern, count in patterns:
        assert sum(pattern) <= 2048 and list(pattern) == sorted(pattern, reverse=True)
        for n in pattern:
            used[n] += count
    assert used == histogram
    total = sum(n * c for n, c in histogram.items())
    assert sum(c for _, c in patterns) * 2048 < 1.25 * total


# ------------------------------------------------------------- 7 and 9


def test_factorisation_identity():
    rng = np.random.default_rng(1)
    m = factorisation.Machine(0.3, rng.normal(size=40), rng.normal(size=(40, 5)))
    idx, x = np.array([1, 5, 9, 30]), rng.normal(size=4)
    pairs = sum(m.factor[idx[i]] @ m.factor[idx[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert m.logit(idx, x) == pytest.approx(0.3 + m.weight[idx] @ x + pairs)


def test_factorisation_learns_a_pairwise_rule():
    rng = np.random.default_rng(6)
    make = lambda: " ".join(rng.permutation([*rng.choice(["alpha", "beta"], 1), *rng.choice(["gamma", "delta"], 1), *rng.choice([f"w{i}" for i in range(50)], 8)]))
    texts = [make() for _ in range(1500)]
    y = np.array([("alpha" in t.split()) ^ ("gamma" in t.split()) for t in texts], float)
    rows_ = factorisation.features(texts)
    m = factorisation.train(rows_[:1200], y[:1200], epochs=25)
    assert ((m.score(rows_[1200:]) > 0.5) == y[1200:]).mean() > 0.9


def _scored(found, texts):
    got = rows(found)
    assert len(got) == len(texts)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    return got


def test_quality_classifier(docs, labels, texts, clashing, empty):
    got = _scored(factorisation.score(clashing, factorisation.fit(clashing, labels)), texts)
    assert all(r.predicted == (r.score >= 0.3) for r in got.values())
    # held-out labels are never learnt from
    flipped = labels.withColumn("quality", F.when(factorisation.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = _scored(factorisation.score(docs, factorisation.fit(docs, flipped)), texts)
    assert all(abs(got[i].score - again[i].score) < 1e-6 for i in got)
    machine = factorisation.fit(docs, labels.limit(0))
    assert {r.score for r in factorisation.score(docs, machine).collect()} == {0.5}
    assert factorisation.score(empty, machine).count() == 0


def test_deobfuscation():
    n = np.zeros(toxicity.SYMBOLS**3)
    for _ in range(30):
        n += toxicity.trigram_counts(b"the idiot said that the moron and the loser are stupid people in this house of worthless trash")
    r = toxicity.Restorer(toxicity.smoothed(n))
    for obfuscated, plain in {"1d10t": "idiot", "m0r0n!!": "moron", "idiiiiot": "idiot", "st*pid": "stupid", "i##ot": "idiot", "tr@sh.": "trash", "the###": "the", "l0ser": "loser"}.items():
        assert r.token(obfuscated) == plain
    assert "stupid" in r.words("s t u p i d people") and "idiot" in r.words("i.d.i.o.t")
    assert r.words(None) == set() and r.words("") == set()


def test_decoding_finds_the_best_of_all_paths():
    from itertools import product

    n = toxicity.trigram_counts(b"the idiot said that you are the moron and the loser are stupid people in this house of worthless trash") * 30.0
    model = toxicity.smoothed(n)

    def cost(way):
        x = y = 0
        total = sum(price for _, price in way)
        for c in "".join(letters for letters, _ in way):
            k = toxicity._code(c)
            total += model[x, y, k]
            x, y = y, k
        return total + model[x, y, 0]

    lattices = [toxicity.lattice(t) for t in ("1d10t", "m0r0n", "tr@5h", "l0$er", "iiidiot", "7h3", "st*pid", "a", "|d|0t", "you!!!1")] + [toxicity.spaced_lattice(t) for t in ("y o u", "i.d.1.o", "a r e  y o u", "7 h e")]
    for ways in lattices:
        every = sorted(((cost(w), "".join(x for x, _ in w)) for w in product(*ways)), reverse=True)
        found = toxicity._search(ways, model)
        assert any(text == found and c == pytest.approx(every[0][0]) for c, text in every)


def test_trigrams_do_not_depend_on_the_batches(spark):
    given = ["ab  c", "x", "", "déjà vu", None, "a" * 500]
    one = spark.createDataFrame([(t,) for t in given], "text string")
    want = sum(toxicity.trigram_counts(t.encode()) for t in given if t)
    for parts in (1, 5):
        assert np.allclose(toxicity.language_model(one.repartition(parts)), toxicity.smoothed(want.astype(float)))


def test_long_and_spaced_tokens():
    n = np.zeros(toxicity.SYMBOLS**3)
    for _ in range(30):
        n += toxicity.trigram_counts(b"the idiot said that you are the moron and the loser are stupid people in this house of worthless trash")
    r = toxicity.Restorer(toxicity.smoothed(n))
    assert r.token("st" + "u" * 40 + "pid") == "stupid" and r.token("1d10" + "t" * 40) in ("idiot", "idiott")
    assert {"you", "idiot"} <= r.words("so y o u i d i o t") and {"you", "idiot"} <= r.words("y o u  i d i o t")
    assert {"you", "idiot"} <= r.words("y.o.u.1.d.1.0.t") and {"stupid", "people"} <= r.words("s t u u u u p i d p e o p l e")
    # words joined by signs, and tokens of any length
    assert {"you", "idiot", "stupid", "loser"} <= r.words("y0u-1d10t-5tup1d-l053r") and "idiot" in r.words("1d10t/1d10t_1d10t")
    assert r.token("1d10t" * 6) == "idiot" * 6 and r.token("ab12" * 5000).isalpha()


def test_hidden_letters_take_linear_time():
    import time

    n = toxicity.trigram_counts(b"the idiot said that you are the moron and the loser are stupid people in this house of worthless trash") * 30.0
    model = toxicity.smoothed(n)
    for t in ("i##ot", "st**id", "*d*ot", "1##0t", "a#b#c", "l##err", "##"):
        ways = toxicity.lattice(t)
        way = lambda text: toxicity._search([*ways, [("", 0.0)]], model) if text else None  # noqa: E731, B023

        def cost(text, ways=ways):
            """The best price of a text through the lattice."""
            best = {(0, 0, 0): 0.0}
            for options in ways:
                new = {}
                for (x, y, at), c in best.items():
                    for letters, price in options:
                        if text.startswith(letters, at):
                            p, q, total = x, y, c + price
                            for ch in letters:
                                total += model[p, q, toxicity._code(ch)]
                                p, q = q, toxicity._code(ch)
                            key = (p, q, at + len(letters))
                            new[key] = max(new.get(key, -np.inf), total)
                best = new
            return max(c + model[x, y, 0] for (x, y, at), c in best.items() if at == len(text))

        wide = toxicity._wide_search(ways, model)
        narrow = {(0, 0): (0.0, "")}
        for options in ways:
            new = {}
            for (x, y), (c, text) in narrow.items():
                for letters, price in options:
                    p, q, total = x, y, c + price
                    for ch in letters:
                        total += model[p, q, toxicity._code(ch)]
                        p, q = q, toxicity._code(ch)
                    if (p, q) not in new or new[p, q][0] < total:
                        new[p, q] = (total, text + letters)
            narrow = new
        assert cost(wide) == pytest.approx(max(c + model[x, y, 0] for (x, y), (c, _) in narrow.items()))
        assert way(t) == wide
    r = toxicity.Restorer(model)
    took = time.process_time()
    assert r.token("a" + "*#" * 10_000 + "b").isalpha()
    assert time.process_time() - took < 4


def test_toxicity(spark, docs, labels, texts, empty, clashing):
    bad = [(i, f"{t or ''} you {'1d10t' if i % 4 == 1 and i % 3 else 'idiot' if i % 4 == 1 else 'friend'}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(bad, "doc_id long, text string")
    every = spark.createDataFrame([(i, int(i % 4 == 1)) for i in range(len(texts))], "doc_id long, toxic int")
    got = _scored(toxicity.score(df, every), texts)
    assert all(r.predicted == (r.score >= 0.5) for r in got.values())
    assert np.mean([r.predicted == (i % 4 == 1) for i, r in got.items()]) > 0.9
    assert toxicity.score(empty, every).count() == 0
    assert len(rows(toxicity.score(docs, labels.limit(0)))) == len(texts)
    assert {r.doc_id: round(r.score, 9) for r in toxicity.score(clashing, labels).collect()} == {r.doc_id: round(r.score, 9) for r in toxicity.score(docs, labels).collect()}


# ------------------------------------------------------------- 8


def test_licenses(spark, texts, empty):
    import re

    more = [
        "Licensed under CC BY-NC 4.0.",
        "released under the MIT License",
        "cc by cc by CC-BY.",
        "ccby cc bye éall rights reserved",
        "all rights\nreserved, all  rights reserved",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the Apache License, Version 2.0.",
        "general Public LICENSE",
    ]
    given = [*texts, *more]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("words", "rare", "place", "score", "template", "doc")})
    got = rows(licenses.scan(df))
    assert len(got) == len(given)
    for i, t in enumerate(given):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        at = [(k, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()] for k in range(len(w)) if w[k : k + len(p)] == p]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({b for _, b in at}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1
    found = lambda k: got[len(texts) + k].labels.split(",")
    assert "cc-by-nc-4.0" in found(0) and "mit" in found(1) and {"gpl", "gpl-3.0"} <= set(found(5)) and "apache-2.0" in found(6)
    assert all(not got[i].labels for i in range(len(texts)))
    assert licenses.scan(df.limit(0)).count() == 0
    assert licenses.scan(df.union(df)).count() == 2 * len(given)


def test_licences_of_frequent_words(spark):
    notices = {"mit": "released under the MIT License", "apache-2.0": "Licensed under the Apache License, Version 2.0", "cc-by-4.0": "Licensed under CC BY 4.0", "mpl-2.0": "subject to the terms of the Mozilla Public License, v. 2.0"}
    # in a third of all rows, in all rows, and in one row
    for given in ([x for v in notices.values() for x in (v, "plain text", "more text")], list(notices.values()) * 2, [notices["apache-2.0"]]):
        got = rows(licenses.scan(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")))
        for i, t in enumerate(given):
            assert {k for k, v in notices.items() if v == t} <= set(got[i].labels.split(",")), t
    # more notices in one file than it has rare words
    every = " ; ".join(x for _, x, _ in licenses.TEMPLATES)
    df = spark.createDataFrame([(0, every)] + [(i, "plain text") for i in range(1, 20)], "doc_id long, text string")
    assert set(rows(licenses.scan(df))[0].labels.split(",")) == {k for k, _, _ in licenses.TEMPLATES}


def brute_licences(text):
    """Every template at every place of the text."""
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    found, best = set(), 0
    for label, notice, keys in licenses.TEMPLATES:
        own, need = notice.split(), licenses.needed_places(notice, keys)
        for at in range(-len(own), len(w)):
            got = {i for i, x in enumerate(own) if 0 <= at + i < len(w) and w[at + i] == x}
            if set(need) <= got and len(got) >= licenses.LEAST * len(own):
                found.add(label)
                best = max(best, round(len(got) / len(own), 6))
    return found, best


def test_licence_places_against_every_place(spark):
    rng = np.random.default_rng(12)
    given = []
    for _, notice, _ in licenses.TEMPLATES:
        for lost in (0, 1, 3, 6):
            w = notice.split()
            for _ in range(lost):
                if len(w) > 1:
                    w[rng.integers(len(w))] = "other"
            given.append("before it " + " ".join(w) + " after it")
            given.append(" ".join(w[: len(w) // 2] + ["inserted"] + w[len(w) // 2 :]))
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = rows(licenses.scan(df))
    for i, t in enumerate(given):
        found, best = brute_licences(t)
        base = set(filter(None, got[i].base_labels.split(",")))
        assert set(filter(None, got[i].labels.split(","))) == found | base, t
        assert got[i].score == (1.0 if base else best)


def test_licences_by_sql(spark, texts, tmp_path):
    import duckdb

    from prismlake.llm import oracles

    given = [*texts, *(f"x {n} y" for _, n, _ in licenses.TEMPLATES), "all all rights reserved rights reserved", "cc by by cc by"]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = {r[0]: r[1:] for r in con.sql(f"SELECT doc_id, n_words, n_base, first_word, last_word, base_labels, labels, round(score, 6) FROM ({oracles.licence_scan()})").fetchall()}
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 6)) for r in licenses.scan(df).collect()}
    assert got == want


# ------------------------------------------------------------- 10


def brute_removed(texts):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        m, new = bytearray(len(b)), set()
        for j in range(len(b) - 49):
            if b[j : j + 50] in seen:
                m[j : j + 50] = b"\1" * 50
            else:
                new.add(b[j : j + 50])
        seen |= new
        out.append(m)
    return out


def test_suffix_dedup_of_null_ids(spark):
    text = "a passage of well over fifty bytes that stands in each of these documents"
    df = spark.createDataFrame([(None, text), (None, text), (2**60 + 1, text), (2**60 + 3, f"{text} and more")], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_removed) for r in suffix_dedup.dedup(df).collect())
    assert got == Counter([(None, 0), (None, 0), (2**60 + 1, 0), (2**60 + 3, len(text))])


@pytest.mark.parametrize(("hot", "most_bits"), [(2000, 30), (3, 30), (2000, 1)])
def test_suffix_dedup(monkeypatch, docs, texts, clashing, empty, hot, most_bits):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "MOST_BITS", most_bits)
    got = rows(suffix_dedup.dedup(clashing))
    assert len(got) == len(texts)
    for i, (t, m) in enumerate(zip(texts, brute_removed(texts), strict=True)):
        b = (t or "").encode()
        r = got[i]
        assert (r.n_bytes, r.n_removed) == (len(b), sum(m))
        assert bytes(r.kept) == bytes(c for c, x in zip(b, m, strict=True) if not x)
        assert r.n_spans == sum(1 for j in range(len(m)) if m[j] and (j == 0 or not m[j - 1]))
    assert sum(r.n_removed for r in got.values()) > 1000
    if hot == 3:
        assert suffix_dedup.dedup(empty).count() == 0
        assert suffix_dedup.dedup(docs.union(docs)).count() == 2 * len(texts)


@pytest.mark.parametrize("most_bits", [8, 28])
def test_suffix_dedup_leaves_no_shuffled_texts(monkeypatch, spark, docs, texts, most_bits):
    """Shuffles of steps that have ended would add up to several times the texts."""
    monkeypatch.setattr(suffix_dedup, "MOST_BITS", most_bits)

    def files():
        return {p: p.stat().st_size for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for p in Path(str(d)).rglob("shuffle_*.data")}

    old, most, until = files(), sum(len((t or "").encode()) for t in texts) / 10, time.time() + 20
    out = suffix_dedup.dedup(docs)
    while (left := sum(n for p, n in files().items() if p not in old)) > most and time.time() < until:
        time.sleep(0.2)
    assert left <= most
    assert out.count() == len(texts)


def test_suffix_dedup_tags_of_shared_anchors(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PACK_BYTES", 4000)
    given = suffix_dedup._given(docs, "doc_id", "text")
    packs = suffix_dedup._packs(given, 4)
    keys, owners = [], {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        keys.append(suffix_dedup.segments(raw, np.array([len(raw)]))[0])
        for k in keys[-1].tolist():
            owners.setdefault(k, set()).add(i)
    want = {i: {int(x) & 0xFFFFFFFF for x, key in zip(suffix_dedup._tags(k, 4), k.tolist(), strict=True) if len(owners[key]) > 1} for i, k in enumerate(keys)}
    got = {r.doc: np.frombuffer(r.tags, "<u4").tolist() for r in suffix_dedup._by_document(suffix_dedup._shared_tags(packs)).collect()}
    assert {i: set(x) for i, x in got.items()} == {i: x for i, x in want.items() if x}
    assert all(x == sorted(set(x)) for x in got.values())
    sent = [r for r in packs.collect() if r.part >= 0]
    assert sum(len(r.tags) for r in sent) == suffix_dedup.TAG_BYTES * sum(map(len, keys))
    assert sum(len(r.owners) for r in sent) == sum(map(len, keys))


def test_induced_sorting():
    rng = np.random.default_rng(1)
    for t in range(150):
        k = int(rng.integers(1, 6))
        s = rng.integers(0, k, int(rng.integers(1, 300)))
        if t % 3 == 0:
            s = np.repeat(s, rng.integers(1, 9, len(s)))
        assert suffix_dedup.suffix_array(s, k).tolist() == sorted(range(len(s)), key=lambda i, s=s: tuple(s[i:]))
