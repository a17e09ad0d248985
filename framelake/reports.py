"""Reports of checks: JSON, Markdown and SARIF as rows of text, and the exit code of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .operators import audit

#: Exit codes.
EXIT = {"usage": 64, "no decoder": 70, "input": 3, "critical": 2, "warning": 1, "clean": 0}
MARK = {"pass": "ok", "warn": "warning", "fail": "FAIL", "info": "note", "skip": "skipped"}
SARIF_LEVEL = {"critical": "error", "warning": "warning", "info": "note"}


def combined(*checks: DataFrame) -> DataFrame:
    """Checks of files, ladders, playlists, measurements and conversions in one table."""
    out = checks[0]
    for more in checks[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def json_report(checks: DataFrame) -> DataFrame:
    """(entity, json) with the tally and the checks of an entity, in the order of the rules."""
    row = F.struct(*[c for c in ("place", "id", "category", "level", "severity", "spec", "clause", "value", "expected", "offset") if c in checks.columns])
    listed = checks.groupBy("entity").agg(F.sort_array(F.collect_list(row)).alias("checks"))
    count = audit.tally(checks, "entity")
    summary = F.struct(*[c for c in count.columns if c != "entity"]).alias("summary")
    return listed.join(count.select("entity", summary), "entity").select("entity", F.to_json(F.struct(F.col("entity").cast("string").alias("entity"), "summary", "checks")).alias("json"))


def markdown(checks: DataFrame) -> DataFrame:
    """(entity, text) with a heading, the tally and a line by check, worst first (K2)."""
    mark = F.coalesce(*[F.when(F.col("level") == k, v) for k, v in MARK.items()])
    detail = F.concat(F.coalesce(F.concat(F.lit(" = "), "value"), F.lit("")), F.coalesce(F.concat(F.lit(", expected "), "expected"), F.lit("")), F.lit(" ("), "spec", F.lit(" "), "clause", F.lit(")"))
    line = F.concat(F.lit("- "), mark, F.lit(" **"), "id", F.lit("**"), detail)
    lines = checks.withColumn("line", line).groupBy("entity").agg(F.sort_array(F.collect_list(F.struct(audit.rank().alias("r"), "id", "line"))).alias("ls"))
    count = audit.tally(checks, "entity")
    head = F.concat(F.lit("## "), F.col("entity").cast("string"), F.lit("\n\n"), F.col("n_fail"), F.lit(" failed, "), F.col("n_warn"), F.lit(" warned, "), F.col("n_pass"), F.lit(" passed\n\n"))
    return lines.join(count, "entity").select("entity", F.concat(head, F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("text"))


def sarif(checks: DataFrame, rules: Sequence[audit.Rule] = audit.ALL_RULES, tool: str = "framelake") -> DataFrame:
    """One row with a SARIF 2.1.0 log of all warnings and failures (K3); rules are literals, results come by entity."""
    level = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in SARIF_LEVEL.items()])
    region = F.when(F.col("offset").isNotNull(), F.struct(F.col("offset").alias("byteOffset")))
    place = F.struct(F.struct(F.struct(F.col("entity").cast("string").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    text = F.concat("id", F.coalesce(F.concat(F.lit(": "), "value"), F.lit("")), F.coalesce(F.concat(F.lit(", expected "), "expected"), F.lit("")))
    result = F.struct(F.col("id").alias("ruleId"), level.alias("level"), F.struct(text.alias("text")).alias("message"), F.array(place).alias("locations"))
    found = checks.where("level in ('warn', 'fail')").agg(F.sort_array(F.collect_list(result)).alias("results"))
    known = F.array(*[F.struct(F.lit(r.id).alias("id"), F.struct(F.lit(f"{r.spec} {r.clause}").alias("text")).alias("shortDescription")) for r in rules])
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), known.alias("rules")).alias("driver")).alias("tool"), "results")
    log = F.struct(F.lit("2.1.0").alias("version"), F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.array(run).alias("runs"))
    return found.select(F.to_json(log).alias("sarif"))


def exit_code(checks: DataFrame, input_errors: int = 0, decoder_missing: bool = False) -> int:
    """What a command line would return (K4)."""
    if decoder_missing:
        return EXIT["no decoder"]
    if input_errors:
        return EXIT["input"]
    worst = checks.agg(F.max((F.col("severity") == "critical").cast("int")).alias("c"), F.max((F.col("severity") == "warning").cast("int")).alias("w")).first()
    return EXIT["critical"] if worst.c else EXIT["warning"] if worst.w else EXIT["clean"]
