"""Merging findings: same-spot merge, per-file collapse, enrichment and report order.

A file is a row, and all its findings come from that row, so merging happens inside it: hits are
sorted by their key and cut into runs, and each run is folded from its first finding to its
last, for any number of detectors. Nothing is shuffled, and the text is still at hand for
whatever comes next (``scan_files``). Findings that come as a table of raw hits are gathered by
file once (``merge_findings``) and folded in the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims, scalars, text
from ..functions.arrays import runs
from ..functions.dims import REPEAT_BOOST, RULES, SAME_SPOT_BOOST, Detector, Rule
from ..functions.text import let
from ..session import remembered, written
from .calls import flagged_calls, marked_calls
from .detect import HIT, all_rule_hits, describe, hit_rows

SPOT_KEYS = ["canon_cwe", "fn_key", "line"]
FILE_KEYS = ["canon_cwe", "fn_key"]
#: What a finding in a file's row has, in this order, so that sorting them gives the report's order.
FINDING_FIELDS = ["rank", "line", "seq", "vuln_type", "rule_id", "cwe_id", "severity", "confidence", "description",
                  "recommendation", "detector", "function_name"]
ORDER_FIELDS = FINDING_FIELDS[:3]


def prepared(files: DataFrame) -> DataFrame:
    """The files with the texts that the detectors read, each made once."""
    return files.select("*", _scan_text().alias("_code"), _marked_calls().alias("_m"))


@remembered
def _scan_text() -> Column:
    return text.scan_text(F.col("code"))


@remembered
def _marked_calls() -> Column:
    return marked_calls()


def _placed(base: int):
    """The hit of a further detector, whose rules come behind ``base`` others."""
    return lambda h: F.struct(h["line"].cast("int").alias("line"), (h["rule"] + base).cast("int").alias("dim"),
                              F.coalesce(h["function_name"], F.lit("")).alias("function_name"))


def hits(rules: Sequence[Rule], detectors: Sequence[Detector] = ()) -> Column:
    """All hits of a ``prepared`` file, detector after detector."""
    found = [_rule_hits(tuple(rules)), _flagged_calls(len(rules))]
    base = len(rules) + len(dims.SIGNATURES)
    for d in detectors:
        own = F.coalesce(d.hits(F.col("code"), F.col("language")), F.array().cast("array<struct<line:int,rule:int,function_name:string>>"))
        found.append(F.transform(own, _placed(base)))
        base += len(d.rules)
    return F.concat(*found)


@remembered
def _rule_hits(rules: tuple[Rule, ...]) -> Column:
    return all_rule_hits(rules)


@remembered
def _flagged_calls(dim_base: int) -> Column:
    return flagged_calls(F.col("_m"), F.col("language"), dim_base)


def raw_findings(files: DataFrame, rules: Sequence[Rule] = tuple(RULES), detectors: Sequence[Detector] = ()) -> DataFrame:
    """All detectors in one pass over the texts: file_path, language, seq, line, dim, function_name."""
    return hit_rows(prepared(files), hits(dims.usable_rules(rules), detectors))


def detect_all(files: DataFrame, rules: Sequence[Rule] = tuple(RULES), detectors: Sequence[Detector] = ()) -> DataFrame:
    rules = dims.usable_rules(rules)
    return describe(raw_findings(files, rules, detectors), dims.finding_dim(files.sparkSession, rules, detectors))


# ---------------------------------------------------------------- folds over the hits of a file

def _same(keys: Sequence[str]):
    """Whether an item of a sorted array begins a new key."""
    def begins(before: Column, x: Column) -> Column:
        out = F.lit(False)
        for k in reversed(keys):  # lines differ more often than weaknesses
            out = out | (before[k] != x[k])
        return out
    return begins


def same_spot(found: Column, dim: Column) -> Column:
    """One entry per (canonical weakness, function, line), sorted so, from the hits of one file."""
    kind = lambda x: F.get(dim, x["dim"])

    def keyed(h: Column, i: Column) -> Column:
        return let(kind(h), lambda d: F.struct(
            d["canon_cwe"].alias("canon_cwe"),
            F.when(h["function_name"] != "", F.lower(h["function_name"])).otherwise(d["type_key"]).alias("fn_key"),
            h["line"].alias("line"), i.alias("seq"), h["dim"].alias("dim"), h["function_name"].alias("function_name")))

    state = lambda dim, fn, detector, rank, confidence: F.struct(
        dim.alias("dim"), fn.alias("function_name"), detector.alias("detector"), rank.alias("rank"), confidence.alias("confidence"))

    def step(s: Column, x: Column) -> Column:
        def met(d: Column) -> Column:
            better = d["rank"] > s["rank"]
            known = F.contains(s["detector"], d["detector"])
            # a merged name ranks 0
            return state(
                F.when(better, x["dim"]).otherwise(s["dim"]),
                F.when(better, x["function_name"]).otherwise(s["function_name"]),
                F.when(better, F.concat(d["detector"], F.lit("+"), s["detector"])).when(known, s["detector"])
                .otherwise(F.concat(s["detector"], F.lit("+"), d["detector"])),
                F.when(~better & known, s["rank"]).otherwise(F.lit(0)),
                F.least(F.lit(1.0), F.greatest(s["confidence"], d["confidence"]) + F.lit(SAME_SPOT_BOOST)))
        return let(kind(x), met)

    def spot(first: Column, *fields: Column) -> Column:
        return F.struct(*[first[c].alias(c) for c in ("canon_cwe", "fn_key", "line", "seq")],
                        *[f.alias(c) for f, c in zip(fields, ("dim", "function_name", "detector", "rank", "confidence"))])

    def fold(run: Column) -> Column:
        def begun(first: Column, d: Column) -> Column:
            begin = (first["dim"], first["function_name"], d["detector"], d["rank"], d["confidence"])
            whole = let(F.aggregate(F.slice(run, 2, F.size(run)), state(*begin), step),
                        lambda s: spot(first, *[s[c] for c in ("dim", "function_name", "detector", "rank", "confidence")]))
            return F.when(F.size(run) == 1, spot(first, *begin)).otherwise(whole)  # most are alone

        return let(F.get(run, F.lit(0)), lambda first: let(kind(first), lambda d: begun(first, d)))

    return runs(F.sort_array(F.transform(found, keyed)), _same(SPOT_KEYS), fold)


def per_file(spots: Column) -> Column:
    """One entry per (canonical weakness, function) from the spots of one file, folded in the order
    in which the detectors met them; ``lines`` has all its lines."""
    fields = ("dim", "line", "function_name", "detector", "rank", "confidence")

    def step(s: Column, x: Column) -> Column:
        replace = (x["rank"] > s["rank"]) | (x["confidence"] > s["confidence"])
        names = F.when(replace, x["detector"]).otherwise(F.concat(s["detector"], F.lit("+"), x["detector"]))

        def named(name: Column) -> Column:
            merged = F.contains(name, F.lit("+"))
            whole = F.when(merged, F.array_join(F.sort_array(F.array_distinct(F.split(name, r"\+", -1))), "+")).otherwise(name)
            return let(whole, lambda w: F.struct(
                *[F.when(replace, x[c]).otherwise(s[c]).alias(c) for c in ("dim", "line", "function_name")],
                w.alias("detector"),
                F.when(F.contains(w, F.lit("+")), 0).otherwise(F.when(replace, x["rank"]).otherwise(s["rank"])).alias("rank"),
                F.least(F.lit(1.0), F.when(replace, x["confidence"]).otherwise(s["confidence"]) + F.lit(REPEAT_BOOST)).alias("confidence")))

        return let(names, named)

    def fold(run: Column) -> Column:
        in_order = F.sort_array(F.transform(run, lambda x: F.struct(x["seq"].alias("seq"), *[x[c].alias(c) for c in fields])))
        entry = lambda x, seq, lines, s: F.struct(x["canon_cwe"].alias("canon_cwe"), x["fn_key"].alias("fn_key"), seq.alias("seq"),
                                                  lines.alias("lines"), *[s[c].alias(c) for c in fields])
        whole = lambda x: let(in_order, lambda xs: let(F.get(xs, F.lit(0)), lambda first: let(F.aggregate(
            F.slice(xs, 2, F.size(xs)), F.struct(*[first[c].alias(c) for c in fields]), step),
            lambda s: entry(x, first["seq"], F.transform(run, lambda x: x["line"]), s))))
        return let(F.get(run, F.lit(0)), lambda x: F.when(F.size(run) == 1, entry(x, x["seq"], F.array(x["line"]), x)).otherwise(whole(x)))

    return runs(spots, _same(FILE_KEYS), fold)


def _finding(x: Column, d: Column, description: Column, fields: Sequence[str] = tuple(FINDING_FIELDS)) -> Column:
    of = {"rank": d["report_rank"], "description": description, **{c: x[c] for c in ("line", "seq", "confidence", "detector", "function_name")}}
    return F.struct(*[of.get(c, d[c]).alias(c) for c in FINDING_FIELDS if c in (*ORDER_FIELDS, *fields)])


def described(whole: Column, dim: Column, minimum: str = "", enriched: bool = False, fields: Sequence[str] = tuple(FINDING_FIELDS)) -> Column:
    """The entries of ``per_file`` as findings in report order, texts attached where ``fields`` asks for them."""
    least = dims.SEVERITY_RANK.get(minimum, 0)

    def one(x: Column) -> Column:
        return let(F.get(dim, x["dim"]), lambda d: told(x, d))

    def told(x: Column, d: Column) -> Column:
        lines = F.concat(F.lit(" [also on line(s): "), F.array_join(F.transform(x["lines"], lambda n: n.cast("string")), ", "), F.lit("]"))
        said = d["named"] if enriched else d["description"]
        return _finding(x, d, F.when(F.size(x["lines"]) > 1, F.concat(said, lines)).otherwise(said), fields)

    if least > 0:
        whole = F.filter(whole, lambda x: F.get(dim, x["dim"])["severity_rank"] >= least)
    return F.sort_array(F.transform(whole, one))


def with_name(description: Column, cwe_id: Column, cwe_name: Column) -> Column:
    """The weakness name in front of the description unless it is there already."""
    return F.when(cwe_name.isNotNull() & ~F.contains(description, cwe_name), F.concat(
        F.lit("["), cwe_id, F.lit("] "), cwe_name, F.lit(" — "), description)).otherwise(description)


# ---------------------------------------------------------------- operators

def in_row(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is worked out once. It goes through a generator of one row: a filter or a
    join behind a projection would be pushed below it and work the column out again."""
    keep = [c for c in rows.columns if c != name]
    return rows.select(*keep, F.inline(F.array(F.struct(value.alias(name)))))


@remembered
def _spots(rules: tuple[Rule, ...], detectors: tuple[Detector, ...]) -> Column:
    return same_spot(F.coalesce("_hits", F.array().cast(HIT)), dims.finding_literal(rules, detectors))


@remembered
def _entries() -> Column:
    return per_file(F.col("_spots"))


@remembered
def _described(rules: tuple[Rule, ...], detectors: tuple[Detector, ...], minimum: str, enriched: bool,
               fields: tuple[str, ...] = tuple(FINDING_FIELDS)) -> Column:
    return described(F.col("_merged"), dims.finding_literal(rules, detectors), minimum, enriched, fields)


def _keys(rules: Sequence[Rule], detectors: Sequence[Detector]) -> tuple[tuple[Rule, ...], tuple[Detector, ...]]:
    return tuple(rules), tuple(d._replace(rules=tuple(d.rules)) for d in detectors)


def folded(rows: DataFrame, rules: Sequence[Rule], detectors: Sequence[Detector]) -> DataFrame:
    """From the hits in ``_hits`` to ``_merged``, the entries of ``per_file``."""
    spots = rows.withColumn("_spots", _spots(*_keys(rules, detectors))).drop("_hits")
    return spots.withColumn("_merged", _entries()).drop("_spots")


def scan_files(files: DataFrame, minimum: str = "low", rules: Sequence[Rule] = tuple(RULES),
               detectors: Sequence[Detector] = (), enriched: bool = True, fields: Sequence[str] = tuple(FINDING_FIELDS)) -> DataFrame:
    """The files, each with ``findings``: merged, named and filtered, in report order. For counts and
    short lists ``fields`` names what a finding has beside rank, line and seq.

    Every row is a file of its own. Other columns stay; a file without a text has no findings."""
    rules = dims.usable_rules(rules)
    rows = prepared(files.drop("findings")).withColumn("_hits", hits(rules, detectors)).drop("_code", "_m")
    texts = _described(*_keys(rules, detectors), minimum, enriched, tuple(fields))
    return in_row(folded(rows, rules, detectors), "findings", texts).drop("_merged")


def findings_of(files: DataFrame) -> DataFrame:
    """One row for each finding of files that carry theirs."""
    return files.select("file_path", F.inline("findings")).drop("rank")


def scan(files: DataFrame, minimum: str = "low", rules: Sequence[Rule] = tuple(RULES),
         detectors: Sequence[Detector] = ()) -> DataFrame:
    """files -> merged, enriched and filtered findings (unordered)."""
    return findings_of(scan_files(files, minimum, rules, detectors))


def gathered(raw: DataFrame) -> DataFrame:
    """``file_path, _hits`` of a table of raw hits; the hits of a file in their order."""
    hit = F.struct("seq", "line", "dim", "function_name")
    grouped = raw.groupBy("file_path").agg(F.sort_array(F.collect_list(hit)).alias("h"))
    return grouped.select("file_path", F.transform("h", lambda h: F.struct(
        h["line"].cast("int").alias("line"), h["dim"].cast("int").alias("dim"), h["function_name"].alias("function_name"))).alias("_hits"))


def merge_same_spot(files: DataFrame, rules: Sequence[Rule] = tuple(RULES), detectors: Sequence[Detector] = ()) -> DataFrame:
    """The first pass alone: one row per spot of each file."""
    rules = dims.usable_rules(rules)
    dim = dims.finding_literal(rules, detectors)
    rows = prepared(files).select("file_path", hits(rules, detectors).alias("_hits"))
    spots = rows.select("file_path", _spots(*_keys(rules, detectors)).alias("_spots"))

    def one(x: Column) -> Column:
        d = F.get(dim, x["dim"])
        return _finding(x, d, d["description"])

    return spots.select("file_path", F.inline(F.transform("_spots", one))).drop("rank")


def collapse_per_file(files: DataFrame, rules: Sequence[Rule] = tuple(RULES), detectors: Sequence[Detector] = ()) -> DataFrame:
    """Both passes without the texts: file_path, canon_cwe, fn_key, seq, lines, dim, line, ..."""
    rules = dims.usable_rules(rules)
    rows = prepared(files).select("file_path", hits(rules, detectors).alias("_hits"))
    whole = folded(rows, rules, detectors)
    return in_row(whole.select("file_path", F.col("_merged").alias("_whole")), "_merged", F.col("_whole")).select("file_path", F.inline("_merged"))


def merge_findings(raw: DataFrame, rules: Sequence[Rule] = tuple(RULES), detectors: Sequence[Detector] = ()) -> DataFrame:
    """Both passes over a table of raw hits, whose ``dim`` counts ``rules``, signatures and
    detectors: the hits of a path are gathered, so rows of one path merge. ``seq`` is the
    position a finding holds among its file's findings."""
    rules = dims.usable_rules(rules)
    rows = folded(gathered(raw), rules, detectors).withColumn("findings", _described(*_keys(rules, detectors), "", False))
    return findings_of(rows)


def enrich(findings: DataFrame) -> DataFrame:
    """Put the weakness name in front of the description unless it is there already."""
    d = F.broadcast(dims.cwe_dim(findings.sparkSession))
    return (findings.join(d, "cwe_id", "left")
            .withColumn("description", with_name(F.col("description"), F.col("cwe_id"), F.col("cwe_name"))).drop("cwe_name"))


def min_severity(findings: DataFrame, minimum: str = "low") -> DataFrame:
    """Keep findings at or above ``minimum``; an unknown name keeps all."""
    threshold = dims.SEVERITY_RANK.get(minimum, 0)
    return findings.where(scalars.severity_rank(F.col("severity")) >= threshold)


def report_keys() -> list[Column]:
    return [scalars.report_rank(F.col("severity")), F.col("file_path"), F.col("line"), F.col("seq")]


def report_order(findings: DataFrame) -> DataFrame:
    """Sorted by ranges, which take a first pass: the findings are written before it."""
    return written(findings).orderBy(*report_keys())
