"""Importance resampling towards a target: hashed n-gram models of raw and target text, weights and a top-k draw with Gumbel noise.

Each partition hands its texts to a DuckDB of its own, which splits them into
words, unnests these, forms runs of 1 to ``width`` words by window functions and
counts the buckets of their CRC-32 (a registered function). The counts, one row
a document, are spilled to a Parquet table in the shared folder; all else is
Spark: bucket sums of both models, gains (one row a bucket, so a broadcast of a
known size), weights, scores, and the draw. Ranks come from a sort by ranges
and the sizes of its partitions, so no task holds all rows.

Texts go to DuckDB in portions of about PORTION characters; longer ones are cut
between words and keep the words before the cut as a lead-in, so that each run
is counted once, where it ends.

Defined results: a null or empty text has no words, weight 0, and takes part
in no draw (as any of fewer than ``least`` words); a null id counts as an
empty one in the hash and comes before others among ties; rows that repeat are
drawn each on their own; a target without features pulls towards frequent
buckets of none; an empty table gives an empty result. Only the id and text
columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, partitions

BUCKETS = 10_000
WIDTH = 2
SHARE = 25  # percent
LEAST = 20
SEED = 7
#: Characters of text that DuckDB gets at once.
PORTION = 3_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def bucket_sql(width: int = WIDTH, buckets: int = BUCKETS) -> str:
    """Over ``portion`` (doc, lead_in, text): per doc its n_words, buckets and counts. A run counts where it ends, past the lead-in."""
    runs = " UNION ALL ".join(f"SELECT doc, {chr(32).join(_join(k))} AS gram FROM framed WHERE place >= greatest(lead_in, {k - 1})" for k in range(1, width + 1))
    lags = "".join(f", lag(word, {k}) OVER (PARTITION BY doc, part ORDER BY place) AS w{k}" for k in range(1, width))
    return f"""
WITH listed AS (SELECT doc, part, lead_in, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM portion),
placed AS (SELECT doc, part, lead_in, unnest(words) AS word, unnest(range(len(words))) AS place FROM listed),
framed AS MATERIALIZED (SELECT doc, lead_in, place, word{lags} FROM placed),
grams AS ({runs}),
counted AS (SELECT doc, CAST(crc32(gram) % {buckets} AS INTEGER) AS bucket, CAST(count(*) AS INTEGER) AS n FROM grams GROUP BY ALL),
packed AS (SELECT doc, list(bucket ORDER BY bucket) AS buckets, list(n ORDER BY bucket) AS counts FROM counted GROUP BY doc),
sized AS (SELECT doc, CAST(sum(len(words) - lead_in) AS BIGINT) AS n_words FROM listed GROUP BY doc)
SELECT doc, n_words, buckets, counts FROM sized LEFT JOIN packed USING (doc) ORDER BY doc"""


def _join(k: int) -> list[str]:
    """The SQL of a run of ``k`` words that ends at ``word``."""
    return [" || ' ' || ".join([*(f"w{i}" for i in range(k - 1, 0, -1)), "word"])]


def parts(text: str, width: int = WIDTH, portion: int = PORTION) -> list[tuple[int, str]]:
    """(lead-in words, text): a text cut between words; each part but the first begins with the words before it that runs may need."""
    out, start, lead = [], 0, []
    while len(text) - start > portion and (gap := _GAP.search(text, start + portion)):
        piece = text[start : gap.start()]
        out.append((len(lead), " ".join([*lead, piece])))
        lead = [*lead, *_WORD.findall(piece)][-(width - 1) :] if width > 1 else []
        start = gap.start()
    return [*out, (len(lead), " ".join([*lead, text[start:]]))]


def _crc32(column):
    """The registered function: zlib's CRC-32 of each text's UTF-8 bytes."""
    import numpy as np
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    data = memoryview(column.buffers()[2] or b"")
    crc = zlib.crc32
    return pa.array([crc(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.uint32())


def spilled(docs: DataFrame, id_col: str, text_col: str, width: int, buckets: int, name: str) -> DataFrame:
    """(doc, id, n_words, buckets, counts), written as Parquet: a row for each document, or for each portion of a long one."""
    sql = bucket_sql(width, buckets)

    def run(batches):
        import duckdb
        import pyarrow as pa
        from pyspark import TaskContext

        doc = TaskContext.get().partitionId() << 33
        con = duckdb.connect(config={"threads": 1})
        con.create_function("crc32", _crc32, ["VARCHAR"], "UINTEGER", type="arrow")
        schema = pa.schema([("doc", pa.int64()), ("id", pa.string()), ("n_words", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

        def count(rows: list[tuple]) -> pa.RecordBatch:
            ids = {r[0]: r[4] for r in rows}
            portion = pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate([("doc", pa.int64()), ("part", pa.int32()), ("lead_in", pa.int64()), ("text", pa.large_string())])})
            con.register("portion", portion)
            got = con.sql(sql).to_arrow_table()
            con.unregister("portion")
            got = got.append_column("id", pa.array([ids[d] for d in got["doc"].to_pylist()], pa.string()))
            return got.select(schema.names).cast(schema).combine_chunks().to_batches()

        rows, size = [], 0
        for batch in batches:
            for key, text in zip(batch["id"].to_pylist(), batch["text"], strict=True):
                for k, (lead, part) in enumerate(parts(text.as_py() or "", width)):
                    rows.append((doc, k, lead, part, key))
                    size += len(part)
                    if size >= PORTION:
                        yield from count(rows)
                        rows, size = [], 0
                doc += 1
        if rows:
            yield from count(rows)
        con.close()

    given = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialise(given.mapInArrow(run, "doc long, id string, n_words long, buckets array<int>, counts array<int>"), name, "zstd")


def model(spill: DataFrame) -> DataFrame:
    """(bucket, n): summed in each task before the shuffle."""
    pairs = spill.select(F.explode(F.arrays_zip("buckets", "counts")).alias("p"))
    return pairs.groupBy("p.buckets").agg(F.sum("p.counts").alias("n")).select(F.col("buckets").alias("bucket"), "n")


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): thousandths of the log ratio of smoothed shares, target over raw, floored."""
    total = lambda m: m.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    s_all, t_all = total(raw), total(target)
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    share = lambda mine, other: ((F.coalesce(mine, F.lit(0)) + 1) * F.lit(other + buckets)).cast("double")
    return both.select("bucket", F.floor(1000 * F.log(share(F.col("t"), s_all) / share(F.col("s"), t_all))).alias("gain"))


def scores(spill: DataFrame, gain: DataFrame, seed: int = SEED) -> DataFrame:
    """Per document: doc, id, n_words, n_features, weight, score."""
    sums = spill.select("doc", F.explode(F.arrays_zip("buckets", "counts")).alias("p")).select("doc", F.col("p.buckets").alias("bucket"), F.col("p.counts").alias("n"))
    sums = sums.join(F.broadcast(gain), "bucket").groupBy("doc").agg(F.sum(F.col("gain") * F.col("n")).alias("total"), F.sum("n").alias("n_features"))
    heads = spill.groupBy("doc").agg(F.max("id").alias("id"), F.sum("n_words").alias("n_words"))
    found = heads.join(sums, "doc", "left").withColumn("n_features", F.coalesce("n_features", F.lit(0)))
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(0)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("id", F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    return found.select("doc", "id", "n_words", "n_features", weight.alias("weight"), (weight + noise).alias("score"))


def ranked(rows: DataFrame, draw: int) -> DataFrame:
    """Rows with their rank by falling score, then id; null past the drawn ones."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_first(), F.col("doc")]
    spread = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = materialise(spread.withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))  # a row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    rank = F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("part", part).join(F.broadcast(bases), "part").withColumn("rank", F.when(rank <= draw, rank)).drop("part", "base", "at")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST, width: int = WIDTH, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text") -> DataFrame:
    """Per document: id, n_features, weight, score, rank (1, 2, 3... of the drawn ``share`` percent; else null)."""
    spill, wanted = spilled(docs, id_col, text_col, width, buckets, "buckets"), spilled(target, target_id, target_text, width, buckets, "target-buckets")
    gain = materialise(gains(model(spill), model(wanted), buckets), "gains")
    found = materialise(scores(spill, gain, seed).withColumn("id", F.col("id").cast("long")), "scores")
    for t in (spill, wanted, gain):
        discard(t)
    able = F.col("n_words") >= least
    draw = share * found.where(able).count() // 100
    drawn = ranked(found.where(able), draw)
    return drawn.unionByName(found.where(~able).withColumn("rank", F.lit(None).cast("long"))).select("id", "n_features", "weight", "score", "rank")
