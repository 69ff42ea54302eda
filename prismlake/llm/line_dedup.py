"""Line dedup for fuzzy lines. DataFrame functions only.

Lines are normalised: lower case, runs of other than letters and digits become
one space. Equal normalised lines of any length are one line from the start.
Fuzzy candidates are lines of MIN_WORDS or more words that share a block: a run
of WIDTH of the line's distinct words in the order of their hashes, long words
first, RUNS runs a line. The pigeonhole holds for words: each changed word
breaks WIDTH of the runs at most when it goes and WIDTH - 1 when it comes, and
the rest stay equal. (Blocks of SimHash bits cannot serve here: one word in
eight flips about 10 of 64 bits; see the README.) Of lines in one block those
are candidates whose sketches share LEAST_COMMON of the smaller one. Candidates
are linked by the edit similarity of the whole normalised lines (SIMILARITY): an
alignment of the word runs that both have bounds the distance from above and
proves most links; whatever it does not prove is compared character by
character, at any length, unless other links join the two lines. Candidates
whose 64-bit SimHashes of word pairs differ like strangers' (DISTANCE) go there
without an alignment. Of each connected group the first occurrence (least
document, then line) stays; all others are cut out of their texts.

Lines of a block of more than FAN are compared with its least line first, then
with some PIVOTS more. Those that this leaves in different groups are compared
each with each, portions of PORTION lines with portions, whose pairs never become
rows: no candidate of a block is left out, whatever its size.

Defined results: null and empty texts stay as they are; lines without a letter
or digit stay; lines of fewer than MIN_WORDS words (a line in a script without
spaces is one) go as exact copies only; texts whose lines all occur earlier
become empty; rows that repeat with one id and text are one document (both keep
the line); a null id is the least; an empty table gives an empty result; columns
of any name pass through. Lines are told apart by a 64-bit hash (three billion
distinct lines: a quarter of one false match expected).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linking
from .common import discard, fresh, materialise, partitions

MIN_WORDS = 5
#: Words of as many bytes come first: shorter ones are common to most lines and tell them apart badly.
LONG_WORD = 5
#: Words in a run, and runs a line.
WIDTH, RUNS = 3, 8
SKETCH = RUNS + WIDTH - 1
#: SimHashes of unrelated lines differ in 32 +- 4 bits, at a fifth of the words replaced in 18 +- 3.5.
DISTANCE = 28
#: The SimHash of fewer word pairs says too little.
LEAST_PAIRS = 12
SIMILARITY = 0.8
#: Share of the smaller sketch that the other must have; of lines at the bound about three quarters are shared.
LEAST_COMMON = 0.5
#: Lines of a block that are compared each with each at once; in larger blocks only those that their least line leaves apart.
FAN = 16
#: So many lines of a large block, or up to twice as many, are compared with all others there before all are.
PIVOTS = 8
#: Lines of a large block that one row holds against as many.
PORTION = 128
#: Line numbers of up to this many documents, ten each, are broadcast; more are joined by a shuffle.
BROADCAST_DOCS = 200_000
#: Lines of about as many words or more are aligned in pieces of SEGMENT marks.
LONG_LINE, SEGMENT = 130, 64
#: A gap of more characters counts with its whole length in the bound: where that proves nothing, the lines are compared as a whole.
LONG_GAP = 64
#: Short lines that share less than a twentieth of the marks are not aligned, but compared as a whole.
MOST_APART = 0.95
#: Lines of more characters are compared with half of the edits first.
LONG_TEXT = 2000
_MARK = "\x01"
_SLICE = 127
_LANES = 0x0101010101010101
_WORD_BITS = 30


def word_list(line: Column) -> Column:
    """The words of a normalised line."""
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), "")


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def sketch(words: Column) -> Column:
    """The SKETCH distinct words of least rank: hashes of 30 bits, those of short words after all others."""
    rank = lambda w: F.shiftrightunsigned(F.xxhash64(w), 64 - _WORD_BITS).cast("int") + F.when(F.octet_length(w) < LONG_WORD, 1 << _WORD_BITS).otherwise(0)
    return F.slice(F.sort_array(F.array_distinct(F.transform(words, rank))), 1, SKETCH)


def blocks(ranks: Column) -> Column:
    """Hashes of the runs of a sketch; where it holds all words of the line, runs go around its end."""
    n = F.size(ranks)
    at = lambda i: F.get(ranks, F.lit(i) % F.greatest(n, F.lit(1)))
    runs = [F.when(F.lit(i) < n, F.xxhash64(*[at(i + k) for k in range(WIDTH)])) for i in range(RUNS)]
    return F.array_distinct(F.array_compact(F.array(*runs)))


def _lane_sums(hashes: Column) -> Column:
    """Struct of 8 numbers whose bytes count how many hashes have each bit; of _SLICE hashes at most."""
    zero = F.struct(*[F.lit(0).cast("long").alias(f"l{j}") for j in range(8)])
    step = lambda a, h: F.struct(*[(a[f"l{j}"] + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_LANES))).alias(f"l{j}") for j in range(8)])
    return F.aggregate(hashes, zero, step)


def _majority(sums: Column, n: Column) -> Column:
    """The SimHash from packed sums over n <= _SLICE hashes: all bytes are tested against n / 2 at once.

    Even and odd bytes are spread to 16 bits each, so that no sum overflows.
    """
    even, high = F.lit(0x00FF00FF00FF00FF), F.lit(0x0080008000800080)
    add = (F.lit(_SLICE) - F.floor(n / 2).cast("long")) * F.lit(0x0001000100010001)

    def over(x: Column) -> Column:
        return F.shiftrightunsigned((x.bitwiseAND(even) + add).bitwiseAND(high), 7)

    parts = [F.shiftleft(over(sums[f"l{j}"]).bitwiseOR(F.shiftleft(over(F.shiftrightunsigned(sums[f"l{j}"], 8)), 8)), j) for j in range(8)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def _majority_of_slices(sums: Column, n: Column) -> Column:
    """The same from the packed sums of several slices, bit by bit."""
    bits = F.sequence(F.lit(0), F.lit(63))
    lane = lambda s, k: F.call_function("shiftrightunsigned", F.get(s, k % 8), (k / 8).cast("int") * 8).bitwiseAND(F.lit(255).cast("long"))
    arrays = F.transform(sums, lambda s: F.array(*[s[f"l{j}"] for j in range(8)]))
    counts = F.aggregate(arrays, F.array_repeat(F.lit(0).cast("long"), 64), lambda a, s: F.zip_with(a, bits, lambda c, k: c + lane(s, k)))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    return _bound(counts, lambda c: F.aggregate(bits, F.lit(0).cast("long"), lambda t, k: t.bitwiseOR(F.when(F.get(c, k) * 2 > n, bit(k)).otherwise(F.lit(0).cast("long")))))


def with_simhash(df: DataFrame, hashes: str, name: str = "sim") -> DataFrame:
    """Adds the 64-bit SimHash of an array of hashes: each bit that more than half of them have; the array is dropped."""
    h, n = F.col(hashes), F.size(hashes)
    cut = F.when(n <= _SLICE, F.array(h)).otherwise(F.transform(F.sequence(F.lit(0), ((n - 1) / _SLICE).cast("int")), lambda i: F.slice(h, i * _SLICE + 1, _SLICE)))
    summed = df.select(*[c for c in df.columns if c != hashes], n.alias("_n"), F.transform(cut, _lane_sums).alias("_sums"))
    sim = F.when(F.size("_sums") == 1, _majority(F.col("_sums")[0], F.col("_n"))).otherwise(_majority_of_slices(F.col("_sums"), F.col("_n")))
    return summed.withColumn(name, sim).drop("_n", "_sums")


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("version")).alias("doc"), text.alias("text"))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines with a word: doc (id, version), line_no, h (hash of the normalised line), size (characters), sketch (of lines with enough words)."""
    split = _given(docs, id_col, text_col).select("doc", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    # lines without words are dropped as the table is read: a filter before it would normalise all lines twice
    words = split.select("doc", "line_no", word_list(F.col("line")).alias("words"))
    size = F.length(F.array_join("words", " "))
    found = words.select("doc", "line_no", F.xxhash64("words").alias("h"), size.alias("size"), F.when(F.size("words") >= MIN_WORDS, sketch(F.col("words"))).alias("sketch"))
    return materialise(found, "lines").where("size > 0")


def _common(ka: str, kb: str) -> Column:
    return F.size(F.array_intersect(ka, kb))


#: Of two lines alike (sizes sa and sb, sketches ka and kb), the lengths differ little and most words of the smaller sketch are in the other.
def _near() -> Column:
    return (F.least("sa", "sb") >= SIMILARITY * F.greatest("sa", "sb")) & (_common("ka", "kb") >= LEAST_COMMON * F.least(F.size("ka"), F.size("kb")))


def _side(df: DataFrame, name: str, *more: str | Column) -> DataFrame:
    return df.select(*more, F.col("h").alias(name), F.col("size").alias(f"s{name}"), F.col("sketch").alias(f"k{name}"))


def _pairs(members: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates (a, b, common, star) of blocks (key, h), with the words that their sketches share; and the rows of large blocks.

    ``known`` has size and sketch of each h. Of large blocks (more than FAN) there are the pairs with the least line, the stars.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("h").alias("pivot")).where("n > 1")
    facts = known.select("h", "size", "sketch")
    level = materialise(members.join(sizes, "key").join(facts, "h"), "blocks")
    small = level.where(F.col("n") <= FAN)
    met = _side(small, "a", "key").join(_side(small, "b", "key"), "key").where((F.col("a") < F.col("b")) & _near())
    large = level.where(F.col("n") > FAN)
    star = _side(large, "b", "pivot").join(_side(facts, "a"), F.col("pivot") == F.col("a")).where((F.col("a") != F.col("b")) & _near())
    both = [df.select("a", "b", _common("ka", "kb").alias("common"), F.lit(x).alias("star")) for df, x in ((met, False), (star, True))]
    pairs = both[0].union(both[1]).groupBy("a", "b").agg(F.first("common").alias("common"), F.max("star").alias("star"))
    return materialise(pairs, "pairs"), large.select("key", "h", "n", "size", "sketch")


def _open(large: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows of the large blocks that hold lines of several groups, with these as g."""
    group = _grouped(large, labels, "h", "g")
    open_ = group.groupBy("key").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low < high").select("key")
    return group.join(open_, "key")


def _pivots(rows: DataFrame) -> DataFrame:
    """Candidates (a, b) of rows in different groups, one of which is a pivot: lines by hash, so that blocks of about the same lines have the same ones."""
    every = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.floor(F.log2(F.col("n") / PIVOTS)), F.lit(0)).cast("int"))
    chosen = rows.where(F.pmod(F.xxhash64("h"), every) == 0)
    met = _side(chosen, "a", "key", F.col("g").alias("ga")).join(_side(rows, "b", "key", F.col("g").alias("gb")), "key").where((F.col("ga") != F.col("gb")) & _near())
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _met(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The links (a, b) between groups in blocks (key, h, n, g, size, sketch): of each two portions all candidates are compared in one row."""
    line = rows.groupBy("h").agg(F.first("g").alias("g"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.collect_set(F.struct("key", "n")).alias("in"))
    told = line.join(texts.select("h", F.array_join("words", " ").alias("text")), "h")
    cut = told.select(F.explode("in").alias("at"), F.struct("h", "g", "size", "sketch", "text", F.col("in.key").alias("keys")).alias("line"))
    portions = F.ceil(F.col("at.n") / PORTION).cast("int")
    held = cut.groupBy("at.key", portions.alias("portions"), F.pmod(F.xxhash64("line.h"), portions).cast("int").alias("own")).agg(F.collect_list("line").alias("lines"))
    held = materialise(held, "large-blocks", "zstd")
    # each two portions meet once; few rows, but much work: not for a handful of tasks
    left = held.select("key", F.col("own").alias("p"), F.explode(F.sequence("own", F.col("portions") - 1)).alias("q"), F.col("lines").alias("these"))
    right = held.select("key", F.explode(F.sequence(F.lit(0), "own")).alias("p"), F.col("own").alias("q"), F.col("lines").alias("those"))
    n = partitions(rows.sparkSession)
    both = left.repartition(n, "key", "p", "q").join(right.repartition(n, "key", "p", "q"), ["key", "p", "q"])

    def linked(a: Column, b: Column) -> Column:
        near = (F.least(a["size"], b["size"]) >= SIMILARITY * F.greatest(a["size"], b["size"])) & (F.size(F.array_intersect(a["sketch"], b["sketch"])) >= LEAST_COMMON * F.least(F.size(a["sketch"]), F.size(b["sketch"])))
        # lines that share several blocks are compared in the least one
        here = F.array_min(F.array_intersect(a["keys"], b["keys"])) == F.col("key")
        alike = _alike(F.split(a["text"], " "), F.split(b["text"], " "), _most(a["size"], b["size"]))
        return (a["g"] != b["g"]) & ((F.col("p") < F.col("q")) | (a["h"] < b["h"])) & near & here & alike

    found = F.flatten(F.transform("these", lambda a: F.transform(F.filter("those", lambda b: linked(a, b)), lambda b: F.struct(a["h"].alias("a"), b["h"].alias("b")))))
    return both.select(F.explode(found).alias("l")).select("l.a", "l.b")


def _grouped(df: DataFrame, labels: DataFrame | None, on: str, name: str) -> DataFrame:
    """Adds the group of line ``on``: its component, or itself."""
    if labels is None:
        return df.withColumn(name, F.col(on))
    return df.join(labels.select(F.col("id").alias(on), F.col("component").alias("_c")), on, "left").withColumn(name, F.coalesce("_c", on)).drop("_c")


def _across(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The pairs between groups, with these as ga and gb."""
    return _grouped(_grouped(pairs, labels, "a", "ga"), labels, "b", "gb").where("ga <> gb")


def _texts(docs: DataFrame, spots: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """h, words, marks (hashes of word pairs) and SimHash of the lines at ``spots`` (h, doc, line_no); each document is split once."""
    by_doc = materialise(spots.groupBy("doc").agg(F.collect_list(F.struct("h", "line_no")).alias("spots")), "line-spots")
    size = by_doc.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("spots")), F.lit(0)).alias("lines")).first()
    few = size["docs"] <= BROADCAST_DOCS and size["lines"] <= 10 * BROADCAST_DOCS
    at = _given(docs, id_col, text_col).join(F.broadcast(by_doc) if few else by_doc, "doc")
    own = at.select("spots", F.split("text", "\n", -1).alias("own"))
    line = own.select(F.explode(F.transform("spots", lambda s: F.struct(s["h"].alias("h"), F.col("own")[s["line_no"]].alias("line")))).alias("l"))
    # rows that repeat with one id and text bring a line twice
    words = line.groupBy("l.h").agg(F.first("l.line").alias("line")).select("h", word_list(F.col("line")).alias("words"))
    pairs = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda x, y: F.xxhash64(x, y))
    n = F.size("words")
    known = words.select("h", "words", n.alias("n"), pairs.alias("hashes"), F.when(n <= LONG_LINE + 30, _marks(2)).alias("m2"), F.when(n >= LONG_LINE - 30, _marks(4)).alias("m4"))
    return with_simhash(known.select("h", "words", "n", "hashes", _unique("m2").alias("m2"), _unique("m4").alias("m4")), "hashes")


def _marks(width: int) -> Column:
    """Hashes of the runs of ``width`` words that begin at each word."""
    tail = lambda k: F.slice("words", k + 1, F.greatest(F.size("words") - width + 1, F.lit(0)))
    two = lambda k: F.zip_with(tail(k), tail(k + 1), lambda x, y: F.hash(x, y))
    return two(0) if width == 2 else F.zip_with(two(0), two(2), lambda x, y: F.hash(x, y))


def _unique(marks: str) -> Column:
    """The marks with null for those that occur more than once."""
    s = F.sort_array(marks)
    twice = _bound(s, lambda s: F.array_distinct(F.array_compact(F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda x, y: F.when(x == y, x)))))
    return F.when(F.size(marks) > 1, _bound(twice, lambda t: F.transform(marks, lambda k: F.when(~F.array_contains(t, k), k)))).otherwise(F.col(marks))


def _alignment(df: DataFrame, keep: list[str], strangers: bool = True) -> DataFrame:
    """``keep`` and bound: the edits gap by gap between the marks (ma, mb) that words wa and wb share; null where their order differs. Without ``strangers`` rows that share next to no marks are left out.

    A bound on the edit distance from above, hardly ever more than it.
    """
    lone = df if strangers else df.where(F.size(F.array_except("ma", "mb")) <= MOST_APART * F.size("ma"))
    # each list of own marks is bound, or it would be made again for each mark
    marked = lambda m, other: _bound(F.array_except(m, other), lambda own: F.transform(m, lambda k: F.when(~F.array_contains(own, F.coalesce(k, F.lit(0))), k)))
    kept = lone.select(*keep, "wa", "wb", marked("ma", "mb").alias("ma"), marked("mb", "ma").alias("mb"))
    gaps = lambda w, m: F.split(F.array_join(F.zip_with(w, m, lambda x, k: F.when(k.isNotNull(), F.lit(_MARK)).otherwise(F.concat(x, F.lit(" ")))), ""), _MARK, -1)
    cut = kept.select(*keep, (F.array_compact("ma") == F.array_compact("mb")).alias("ordered"), gaps(F.col("wa"), F.col("ma")).alias("ga"), gaps(F.col("wb"), F.col("mb")).alias("gb"))
    # a long gap is not compared: its length is a bound, too
    edits = lambda x, y: F.when(x == y, 0).when((F.least(F.length(x), F.length(y)) == 0) | (F.greatest(F.length(x), F.length(y)) > LONG_GAP), F.greatest(F.length(x), F.length(y))).otherwise(F.levenshtein(x, y))
    return cut.select(*keep, F.when(F.col("ordered"), F.aggregate(F.zip_with("ga", "gb", edits), F.lit(0), lambda t, d: t + d)).alias("bound"), F.array_join("ga", "").alias("xa"), F.array_join("gb", "").alias("xb"))


def _segments(long: DataFrame) -> DataFrame:
    """Pairs of long lines cut at every SEGMENT-th mark that both have, as far as these come in one order: a, b, most and the words and marks of each piece."""
    marks = long.select("a", "b", "most", "wa", "wb", "ma", "mb", F.filter(F.array_compact(F.array_intersect("ma", "mb")), lambda k, i: i % SEGMENT == SEGMENT - 1).alias("anchors"))
    spots = F.transform("anchors", lambda k: F.struct(F.array_position("ma", k).cast("int").alias("x"), F.array_position("mb", k).cast("int").alias("y")))
    start = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))
    rising = F.aggregate(spots, start, lambda t, s: F.when(s["y"] > F.element_at(t, -1)["y"], F.concat(t, F.array(s))).otherwise(t))
    ends = F.array(F.struct(F.size("wa").alias("x"), F.size("wb").alias("y")))
    cut = marks.select("a", "b", "most", "wa", "wb", "ma", "mb", F.concat(rising, ends).alias("at"))
    each = cut.select("*", F.explode(F.sequence(F.lit(1), F.size("at") - 1)).alias("i")).select("a", "b", "most", "i", "wa", "wb", "ma", "mb", F.get("at", F.col("i") - 1).alias("p"), F.get("at", "i").alias("q"))
    part = lambda c, f: F.slice(c, F.col("p")[f] + 1, F.col("q")[f] - F.col("p")[f]).alias(c)
    return each.select("a", "b", "most", "i", part("wa", "x"), part("wb", "y"), part("ma", "x"), part("mb", "y"))


def _most(la: Column, lb: Column) -> Column:
    """The edits allowed between lines of so many characters."""
    return F.floor((1 - SIMILARITY) * F.greatest(la, lb) + 1e-9).cast("int")


def _proven(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that a bound from above proves to be alike; the others are open.

    Runs of words that both lines have once each are marks; the edits between
    them bound the distance. Long lines (LONG_LINE words) are aligned in pieces.
    """
    sides = ["h", "words", "n", "sim", "m2", "m4"]
    side = lambda c: texts.select(*[F.col(x).alias(c if x == "h" else f"{x}_{c}") for x in sides])
    alike = (F.least("n_a", "n_b") <= LEAST_PAIRS) | (F.bit_count(F.col("sim_a").bitwiseXOR(F.col("sim_b"))) <= DISTANCE)
    chars = lambda w: F.length(F.array_join(w, " "))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where(alike)
    # replaced words alone bound the distance, too, and decide for half of the pairs at a tenth of the cost
    replaced = F.aggregate(F.zip_with("words_a", "words_b", lambda x, y: F.when(x == y, 0).otherwise(F.greatest(F.length(x), F.length(y)))), F.lit(0), lambda t, d: t + d)
    close = F.when(F.col("n_a") == F.col("n_b"), replaced <= F.col("most")).otherwise(False)
    long = F.least("n_a", "n_b") >= LONG_LINE - 30
    both = both.withColumn("most", _most(chars("words_a"), chars("words_b"))).withColumns({"close": close, "long": long})
    marks = lambda c: F.when(F.col("close"), None).when(F.col("long"), F.col(f"m4_{c}")).otherwise(F.col(f"m2_{c}")).alias(f"m{c}")
    both = materialise(both.select("a", "b", "most", "close", "long", *[F.when(~F.col("close"), F.col(f"words_{c}")).alias(f"w{c}") for c in "ab"], marks("a"), marks("b")), "aligned")
    pieces = _alignment(_segments(both.where("long and not close")), ["a", "b", "most", "i"])
    # a piece whose marks come in another order costs its length
    cost = F.coalesce("bound", F.greatest(F.length("xa"), F.length("xb")))
    in_pieces = pieces.groupBy("a", "b", "most").agg(F.sum(cost).alias("bound"))
    whole = _alignment(both.where("not close and not long"), ["a", "b", "most"], strangers=False)
    found = [both.where("close"), *(df.where("bound <= most") for df in (in_pieces, whole))]
    out = materialise(reduce(DataFrame.union, [df.select("a", "b") for df in found]), "line-links")
    discard(both)
    return out


def _alike(wa: Column, wb: Column, most: Column) -> Column:
    """Whether lines of words wa and wb are no more than ``most`` edits apart, character by character.

    Words with which both begin or end do not change the distance and are left out.
    ``levenshtein`` ends where the rest cannot help any more, so lines are read from
    the end where they have fewer words in common.
    """
    apart = lambda x, y: F.array_position(F.zip_with(x, y, lambda v, w: v.eqNullSafe(w)), False).cast("int")
    text = lambda w: F.when(F.size(w) > 0, F.concat(F.array_join(w, " "), F.lit(" "))).otherwise("")
    tails = _bound(apart(wa, wb), lambda i: F.struct(F.slice(wa, i, F.size(wa)).alias("x"), F.slice(wb, i, F.size(wb)).alias("y")))
    head = lambda w, i: F.slice(w, 1, F.size(w) - i + 1)
    words = _bound(tails, lambda t: _bound(apart(F.reverse(t["x"]), F.reverse(t["y"])), lambda i: F.struct(head(t["x"], i).alias("x"), head(t["y"], i).alias("y"))))
    third = lambda w: (F.size(w) / 3).cast("int") + 1
    shared = lambda x, y: F.size(F.array_intersect(x, y))
    first, last = (lambda w: F.slice(w, 1, third(w))), (lambda w: F.slice(w, -third(w), third(w)))
    back = lambda c: shared(first(c["x"]), first(c["y"])) > shared(last(c["x"]), last(c["y"]))
    turned = lambda w, b: F.when(b, F.reverse(text(w))).otherwise(text(w))
    cores = _bound(words, lambda c: _bound(back(c), lambda b: F.struct(turned(c["x"], b).alias("x"), turned(c["y"], b).alias("y"))))
    within = lambda x, y, k: F.call_function("levenshtein", x, y, k) >= 0

    def decided(c: Column) -> Column:
        size = F.greatest(F.length(c["x"]), F.length(c["y"]))
        # of long lines most links need half of the edits, at half of the cost
        half = F.when(size > LONG_TEXT, within(c["x"], c["y"], F.floor(most / 2).cast("int"))).otherwise(False)
        return (size <= most) | half | within(c["x"], c["y"], most)

    return _bound(cores, decided)


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose edit similarity is SIMILARITY or more, character by character."""
    side = lambda c: texts.select(F.col("h").alias(c), F.col("words").alias(f"w{c}"))
    chars = lambda w: F.length(F.array_join(w, " "))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    # few bytes, but much work: not for a handful of tasks (a filter would be moved before the shuffle)
    both = both.repartition(partitions(pairs.sparkSession), "a", "b")
    pair = F.when(_alike(F.col("wa"), F.col("wb"), _most(chars("wa"), chars("wb"))), F.array(F.struct("a", "b")))
    return both.select(F.explode(pair).alias("l")).select("l.a", "l.b")


def groups(found: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """(id, component) of the distinct lines that have fuzzy partners, or None if none has."""
    keyed = found.where("sketch is not null").select(F.explode(blocks(F.col("sketch"))).alias("key"), "h")
    shared = materialise(keyed.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low < high").select("key"), "shared-blocks")
    members = materialise(linking.with_ids(keyed, shared, "key").distinct(), "members")
    ids = materialise(members.select("h").distinct(), "line-ids")
    place = F.struct("doc", "line_no")
    known = linking.with_ids(found, ids, "h").groupBy("h").agg(F.min(place).alias("place"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    known = materialise(known, "known-lines")
    pairs, large = _pairs(members, known)

    def read(pairs: DataFrame, but: DataFrame | None = None) -> DataFrame | None:
        ends = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct()
        ends = materialise(ends if but is None else ends.join(but.select("h"), "h", "left_anti"), "line-ids")
        if but is not None and ends.isEmpty():
            return None
        spots = materialise(linking.with_ids(known, ends, "h").select("h", "place.doc", "place.line_no"), "line-spots")
        return materialise(_texts(docs, spots, id_col, text_col), "line-texts", "zstd")

    texts = read(pairs)
    # each line with its likeliest partner first; what that joins needs no further comparison
    either = pairs.select(F.col("a").alias("h"), F.struct("common", F.col("b").alias("other")).alias("p")).union(pairs.select(F.col("b").alias("h"), F.struct("common", F.col("a").alias("other")).alias("p")))
    best = either.groupBy("h").agg(F.max("p").alias("p")).select(F.least("h", "p.other").alias("a"), F.greatest("h", "p.other").alias("b"))
    tried = materialise(best.union(pairs.where("star").select("a", "b")).distinct(), "pairs")
    labels = linking.relabel(None, _proven(tried, texts))
    # then the likeliest pair of each two groups
    rest = materialise(_across(pairs.join(tried, ["a", "b"], "left_anti"), labels), "pairs")
    likeliest = rest.groupBy(F.least("ga", "gb"), F.greatest("ga", "gb")).agg(F.max(F.struct("common", "a", "b")).alias("p")).select("p.a", "p.b")
    likeliest = materialise(likeliest, "pairs")
    labels = linking.relabel(labels, _proven(likeliest, texts))
    # then all others between groups, and in large blocks those with pivots
    tried = tried.union(likeliest)
    star = materialise(_pivots(_open(large, labels)), "pairs")
    if (more := read(star, texts)) is not None:
        texts = texts.union(more)
    rest = rest.select("a", "b").union(star).distinct().join(tried, ["a", "b"], "left_anti")
    rest = materialise(_across(rest, labels).select("a", "b"), "pairs")
    labels = linking.relabel(labels, _proven(rest, texts))
    # what no bound has proven and no other link has joined
    open_ = materialise(_across(tried.union(rest), labels).select("a", "b"), "pairs")
    labels = linking.relabel(labels, materialise(_compared(open_, texts), "line-links"))
    # then all that is left between groups in large blocks
    rows = materialise(_open(large, labels), "open-blocks")
    if rows.isEmpty():
        return labels
    if (more := read(rows.select(F.col("h").alias("a"), F.col("h").alias("b")), texts)) is not None:
        texts = texts.union(more)
    return linking.relabel(labels, materialise(_met(rows, texts), "line-links"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document that loses lines: doc (id, version) and gone, the numbers of its lines (from 0)."""
    found = lines(docs, id_col, text_col)
    labels = groups(found, docs, id_col, text_col)
    place = F.struct("doc", "line_no").alias("place")
    if labels is None:
        grouped = found.select(F.col("h").alias("g"), place)
    else:
        names = labels.select(F.col("id").alias("h"), "component")
        n = names.count()
        grouped = found.join(F.broadcast(names) if n <= linking.BROADCAST_ROWS else names, "h", "left").select(F.coalesce("component", "h").alias("g"), place)
    first = materialise(grouped.groupBy("g").agg(F.count("*").alias("rows"), F.min("place").alias("stays")).where("rows > 1").select("g", "stays"), "line-groups")
    gone = grouped.join(first, "g").where(F.col("place") != F.col("stays")).select("place.*")
    return materialise(gone.groupBy("doc").agg(F.collect_set("line_no").alias("gone")), "line-removals")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each repeated line cut out; the last column, ``_lines_removed`` (or a longer name if that is taken), counts them."""
    key, cut, count = fresh(docs, "key"), fresh(docs, "gone"), fresh(docs, "_lines_removed")
    gone = removals(docs, id_col, text_col).select(F.col("doc").alias(key), F.col("gone").alias(cut))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumn(key, F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("version")))
    own = F.split(text, "\n", -1)
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col(cut)), lambda i: own[i])
    size = gone.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size(cut)), F.lit(0)).alias("lines")).first()
    if size["docs"] <= BROADCAST_DOCS and size["lines"] <= 10 * BROADCAST_DOCS:
        both = keyed.join(F.broadcast(gone), key, "left")
        changed = F.when(F.col(cut).isNotNull(), F.array_join(left, "\n")).otherwise(F.col(text_col))
        return both.withColumn(count, F.when(F.col(cut).isNotNull(), F.size(cut)).otherwise(0)).withColumn(text_col, changed).select(*docs.columns, count)
    rest = linking.with_ids(keyed, gone.select(key), key, "left_anti", size["docs"])
    hit = linking.with_ids(keyed, gone.select(key), key, "left_semi", size["docs"]).join(gone, key)
    hit = hit.withColumn(count, F.size(cut)).withColumn(text_col, F.array_join(left, "\n"))
    return hit.select(*docs.columns, count).unionByName(rest.select(*docs.columns, F.lit(0).alias(count)))
