"""One validation over all rule groups: in their order, cut at the first fatal issue, with its verdict and a gate for other operators.

Input are examined files (``container.examined``). Groups run as predicates over
all files at once; a file takes part in a group only if its bytes go far
enough, so what lies behind a fatal issue is never computed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizes import align, lcm4
from . import descriptor, formats, globaldata, paddings, validate
from .validate import ERROR, FATAL

HEADER, INDEX, DESCRIPTOR, LEVELS, METADATA, GLOBAL, PADDING, LOADING = range(8)
COLUMNS = ["path", "stage", "place", "id", "severity", "rule"]


def _stage(found: DataFrame, stage: int, place: Column | None = None) -> DataFrame:
    return found.withColumns({"stage": F.lit(stage), "place": (F.lit(None) if place is None else place).cast("string")}).select(COLUMNS)


def _raised(files: DataFrame, rules: list[tuple[int, int, str, str, Column]]) -> DataFrame:
    """Rules over one file's row, (stage, id, severity, rule, predicate), all tested in one scan."""
    hits = F.array_compact(F.array(*[F.when(p, F.struct(F.lit(n).alias("stage"), F.lit(i).alias("id"), F.lit(s).alias("severity"), F.lit(r).alias("rule"))) for n, i, s, r, p in rules]))
    return files.select("path", F.explode(hits).alias("x")).select("path", "x.*").withColumn("place", F.lit(None).cast("string")).select(COLUMNS)


def level_rows(files: DataFrame) -> DataFrame:
    """The level index with what its rules compare: sizes by the format, or by the descriptor where the number is unknown."""
    c = F.col
    # the first group of bytes that the sections before the payload end with
    ends = [("sgd", c("sgd_offset") + c("sgd_length")), ("kvd", c("kvd_offset") + c("kvd_length")), ("dfd", c("dfd_offset") + c("dfd_length"))]
    shown = F.greatest("levels", F.lit(1))
    end = reduce(lambda rest, e: F.when(c(f"{e[0]}_length") != 0, e[1]).otherwise(rest), ends[::-1], 80 + 24 * shown)
    block = F.coalesce(c("fact.block_bytes"), c("planes")[0], F.lit(0)).cast("long")
    side = lambda n, i: F.coalesce(c(f"fact.block_{n}"), c("texel_block")[i] + 1, F.lit(1)).cast("long")
    rows = files.select(
        c("path").alias("texture_id"), "vk_format", "sc_scheme", "width", "height", "depth", "faces", F.greatest("layers", F.lit(1)).alias("n_layers"), end.alias("index_end"),
        block.alias("block"), side("w", 0).alias("bw"), side("h", 1).alias("bh"), F.explode("level_index").alias("l"),
    )
    half = lambda n: F.greatest(F.call_function("shiftright", c(n), c("l.level")), F.lit(1).cast("long"))
    blocks = F.ceil(half("width") / c("bw")) * F.ceil(half("height") / c("bh")) * half("depth")
    plain = c("sc_scheme") == 0
    return rows.select(
        "texture_id", "vk_format", "sc_scheme", "l.level", "l.byte_offset", "l.byte_length", "l.uncompressed_length", "index_end",
        (blocks * c("block") * c("faces") * c("n_layers")).cast("long").alias("expected_size"), F.greatest(c("faces") * c("n_layers"), F.lit(1)).alias("images"),
        F.when(plain, lcm4(F.greatest("block", F.lit(1).cast("long")))).otherwise(1).cast("long").alias("alignment"),
    )


def issues(files: DataFrame, gltf: bool = False) -> DataFrame:
    """(path, stage, place, id, severity, rule) of examined files; ``place`` names a level, sample, key or image.

    The files are scanned once for each kind of row (file, sample, level, key,
    image), so give this a table, not a plan that parses them.
    """
    c = F.col
    end = F.coalesce(c("end_stage"), F.lit(99))
    known = formats.facts(files).withColumns({"gltf": F.lit(gltf), "compressed": F.coalesce("fact.compressed", F.lit(False))})
    upto = lambda stage: known.where(c("identified") & (end > stage))
    renamed = lambda t: t.withColumnRenamed("path", "texture_id")
    back = lambda t: t.withColumnRenamed("texture_id", "path")
    within = lambda stage, rules, also=F.lit(True): [(stage, i, s, r, c("identified") & (end > stage) & also & p) for i, s, r, p in rules]
    of_format = validate.format_rules(c("fact"))
    rules = [(HEADER, 2001, FATAL, "NotKTX2", ~c("identified"))]
    rules += [(s, 1003, FATAL, "UnexpectedEOF", c("end_stage") == s) for s in (HEADER, DESCRIPTOR, LEVELS, METADATA, GLOBAL, PADDING)]
    rules += within(HEADER, [*validate.header_rules(c("compressed")), *[r for r in of_format if r[0] != 3012]]) + within(INDEX, validate.section_rules())
    # the type size is judged once the descriptor is known
    rules += within(DESCRIPTOR, [r for r in of_format if r[0] == 3012], c("model").isNotNull())
    parts = [
        _raised(known, rules),
        _stage(descriptor.byte_issues(upto(DESCRIPTOR).where("dfd_length > 0 AND dfd_offset > 0")), DESCRIPTOR),
        _stage(descriptor.issues(upto(DESCRIPTOR), "path"), DESCRIPTOR, c("sample")),
        _stage(back(validate.level_issues(level_rows(upto(LEVELS)))), LEVELS, c("level")),
    ]
    facts = upto(METADATA).withColumns(
        {
            "depth_stencil": F.coalesce("fact.depth_stencil", F.lit(False)),
            "astc_ldr": F.coalesce("fact.astc_ldr", F.lit(False)),
            "block_model": c("model") >= descriptor.BC1A,
            "linear_or_float": c("transfer").isin(0, 1) | F.coalesce(c("fact.name").rlike("FLOAT"), F.lit(False)),
        }
    )
    pairs = facts.select(c("path").alias("texture_id"), F.explode("metadata").alias("m")).select("texture_id", "m.*")
    sections = upto(GLOBAL).withColumns({"n_samples": F.size("samples"), "anim": F.exists("metadata", lambda m: m["key"] == "KTXanimData")})
    levels = sections.select("path", F.explode("level_index").alias("l")).select("path", "l.level", "l.byte_length", "l.bytes")
    parts += [
        _stage(validate.block_issues(facts), METADATA),
        _stage(back(validate.metadata_issues(pairs, renamed(facts))), METADATA, c("key")),
        _stage(globaldata.issues(sections, levels, "path"), GLOBAL, F.concat_ws("/", *globaldata.PLACE)),
        _stage(paddings.issues(known.where(c("identified") & (end >= PADDING))), PADDING, c("place")),
    ]
    found = reduce(DataFrame.unionByName, parts)
    # payloads are opened only where nothing was found
    tried = known.where((end > PADDING) & (c("payload_state") != "ok")).select("path", "payload_state").join(found.select("path").distinct(), "path", "left_anti")
    state = {"wrong length": (4008, ERROR, "UncompressedByteLengthMismatch"), "damaged": (5006, ERROR, "DecompressChecksumError"), "end": (5005, FATAL, "CreateFailure")}
    return found.unionByName(_raised(tried, [(LOADING, *facts_, c("payload_state") == s) for s, facts_ in state.items()]))


def verdict(files: DataFrame, found: DataFrame, warnings_as_errors: bool = False) -> DataFrame:
    """path, n_errors (fatal ones too), n_warnings, stopped_at (the step of a fatal issue, else null), valid."""
    out = validate.verdict(files.withColumnRenamed("path", "texture_id"), found.withColumnRenamed("path", "texture_id"), warnings_as_errors)
    return out.withColumnRenamed("texture_id", "path")


def admitted(rows: DataFrame, found: DataFrame, key: str = "path") -> DataFrame:
    """The gate before other work on files: rows whose file has neither an error nor a fatal issue."""
    bad = found.where(F.col("severity").isin(ERROR, FATAL)).select(F.col("path").alias(key)).distinct()
    return rows.join(bad, key, "left_anti")


def document(files: DataFrame, found: DataFrame, warnings_as_errors: bool = False) -> DataFrame:
    """(path, report): a JSON document for each file, with its verdict and its messages in their order."""
    message = F.struct("stage", "id", F.col("severity").alias("type"), F.col("rule").alias("message"), F.col("place").alias("details"))
    lists = found.groupBy("path").agg(F.array_sort(F.collect_list(message)).alias("messages"))
    told = F.transform(F.coalesce("messages", F.array().cast("array<struct<stage:int,id:int,type:string,message:string,details:string>>")), lambda m: F.struct(m["id"].alias("id"), m["type"].alias("type"), m["message"].alias("message"), m["details"].alias("details")))
    whole = F.struct(F.lit("urn:prismlake:schema:validate:1").alias("$schema"), F.col("valid"), told.alias("messages"))
    return verdict(files, found, warnings_as_errors).join(lists, "path", "left").select("path", F.to_json(whole).alias("report"))


def as_lines(found: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(path, line) and the columns to ``keep``: issues as text, "severity-0000: rule" with its place."""
    place = F.when(F.col("place").isNotNull(), F.concat(F.lit(" ("), F.col("place"), F.lit(")"))).otherwise("")
    return found.select("path", *(keep or []), F.concat(F.col("severity"), F.lit("-"), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit(": "), F.col("rule"), place).alias("line"))
