"""Raw log text to structured rows: tokens, template match, arguments, line filters."""

from __future__ import annotations

from collections import Counter

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.order import LINE_BUCKET, line_bucket, rank_in_order
from emberlog.session import small_rows, stage

# Shortest valid lines of the two log families, in tokens.
HDFS_TOKENS = 6
OPENSTACK_TOKENS = 8

# Templates per generated projection; longer catalogues are matched in several steps.
MATCH_STEP = 50
# Catalogues with more templates are searched for their fixed parts first.
LONG_CATALOGUE = 60


def _tokens() -> Column:
    return F.split("value", " ")


def _once(value: Column, name: str) -> Column:
    """A generator output: computed once per row, never copied into later filters and projections."""
    return F.explode(F.array(value)).alias(name)


def _rest(tokens: Column, start: int) -> Column:
    return F.array_join(F.slice(tokens, F.lit(start), F.greatest(F.size(tokens) - F.lit(start - 1), F.lit(0))), " ")


def hdfs_until_short(lines: DataFrame, on_bad_line: str = "stop") -> DataFrame:
    """Lines before the first one that is too short (``stop``), or all long enough ones (``skip``)."""
    if on_bad_line not in ("stop", "skip"):
        raise ValueError("on_bad_line must be 'stop' or 'skip'")
    short = F.size(_tokens()) < HDFS_TOKENS
    if on_bad_line == "skip":
        return lines.where(~short)
    first = lines.where(short).agg(F.min("line_no").alias("n")).scalar()
    return lines.where(first.isNull() | (F.col("line_no") < first))


def hdfs_fields(lines: DataFrame, cut_comma: bool = True) -> DataFrame:
    """date, time, pid, level, component (without its last character) and content."""
    t = F.col("_t")
    component = F.get(t, F.lit(4))
    content = _rest(t, 6)
    kept = [c for c in lines.columns if c in ("line_no", "line_id")]
    return lines.select(*kept, _once(_tokens(), "_t")).select(
        *kept,
        F.get(t, F.lit(0)).alias("date"),
        F.get(t, F.lit(1)).alias("time"),
        F.get(t, F.lit(2)).alias("pid"),
        F.get(t, F.lit(3)).alias("level"),
        F.substring(component, F.lit(1), F.length(component) - 1).alias("component"),
        _once(F.substring_index(content, ",", 1) if cut_comma else content, "content"),
    )


def openstack_fields(lines: DataFrame) -> DataFrame:
    """Fields plus address (inside the first bracket) and content; short or bracketless lines go."""
    t = F.col("_t")
    tokens = lines.select("line_no", _once(_tokens(), "_t")).where(F.size(t) >= OPENSTACK_TOKENS)
    cut = tokens.select(
        "line_no",
        *[
            F.get(t, F.lit(i)).alias(name)
            for i, name in enumerate(("logrecord", "date", "time", "pid", "level", "component"))
        ],
        _once(_rest(t, 7), "_rest"),
    ).withColumn("_end", F.instr("_rest", "]"))
    return cut.where(F.col("_end") > 0).select(
        "line_no",
        "logrecord",
        "date",
        "time",
        "pid",
        "level",
        "component",
        F.substring(F.col("_rest"), F.lit(2), F.col("_end") - 2).alias("addr"),
        F.substring(F.col("_rest"), F.col("_end") + 2, F.length("_rest")).alias("content"),
    )


def wildcard_patterns(templates: DataFrame) -> DataFrame:
    """Turn ``<*>`` templates into patterns: brackets, dots and parentheses are taken literally."""
    pattern: Column = F.col("template")
    for mark in "[].()":
        pattern = F.replace(pattern, F.lit(mark), F.lit("\\" + mark))
    return templates.withColumn("pattern", F.replace(pattern, F.lit("<*>"), F.lit("(.*)")))


def check_patterns(templates: DataFrame) -> DataFrame:
    """Fail at load time if a pattern does not compile; returns the table."""
    try:
        templates.select(F.sum(F.rlike(F.lit(""), F.col("pattern")).cast("int"))).collect()
    except Exception as error:
        raise ValueError("a template pattern does not compile") from error
    return templates


def _start_match(pattern: str) -> str:
    # Anchored at the start only; only a line feed ends a line, classes are Unicode-aware.
    return f"(?dU)^(?:{pattern})"


def required_literals(pattern: str) -> list[str]:
    """Strings that every match of a pattern contains: runs of plain characters outside groups and classes.

    None for a pattern with alternatives at the top or with inline flags; a character before a quantifier
    does not count.
    """
    runs, run, i, n = [], "", 0, len(pattern)

    def skipped(i: int) -> int:
        """The place after the group or class that opens at ``i``; classes may nest."""
        groups = classes = 0
        while i < n:
            c = pattern[i]
            if c == "\\":
                i += 1
            elif c == "[":
                classes += 1
                # A closing bracket that comes first in a class is a character of it.
                i += 1 if pattern[i + 1 : i + 2] == "^" else 0
                i += 1 if pattern[i + 1 : i + 2] == "]" else 0
            elif c == "]":
                classes -= classes > 0
            elif not classes:
                groups += (c == "(") - (c == ")")
            i += 1
            if groups <= 0 and not classes:
                break
        return i

    while i < n:
        c = pattern[i]
        if c == "|" or pattern.startswith("(?", i) and pattern[i + 2 : i + 3] not in (":", "=", "!", "<", ">"):
            return []
        if c == "\\" and i + 1 < n and not pattern[i + 1].isalnum():
            run, i = run + pattern[i + 1], i + 2
            continue
        if c in "*+?{":
            runs.append(run[:-1])
            run = ""
            i = pattern.find("}", i) + 1 if c == "{" and "}" in pattern[i:] else i + 1
        elif c in "([":
            runs.append(run)
            run, i = "", skipped(i)
        elif c in "\\.^$":
            runs.append(run)
            run, i = "", i + (2 if c == "\\" else 1)
        else:
            run, i = run + c, i + 1
    return sorted({r for r in (*runs, run) if r})


def _candidates(patterns: list[str]):
    """A function from text to the places of the patterns all of whose required literals occur in it."""
    literals = [required_literals(p) for p in patterns]
    always = [k for k, found in enumerate(literals) if not found]
    owners: dict[str, list[int]] = {}
    for k, found in enumerate(literals):
        for literal in found:
            owners.setdefault(literal, []).append(k)

    @F.pandas_udf("array<int>")
    def places(texts: pd.Series) -> pd.Series:
        automaton = ahocorasick.Automaton()
        for literal in owners:
            automaton.add_word(literal, literal)
        if owners:
            automaton.make_automaton()

        def of(text: str | None) -> list[int]:
            if text is None:
                return []
            seen: Counter = Counter()
            for literal in {found for _, found in automaton.iter(text)} if owners else ():
                seen.update(owners[literal])
            return sorted([*always, *(k for k, times in seen.items() if times == len(literals[k]))])

        return texts.map(of, na_action=None)

    return places


def _match_long(fields: DataFrame, catalogue: list, arguments: bool) -> DataFrame:
    """The same for a long catalogue: one automaton over the fixed parts of all templates, then the regexes
    of the few templates whose parts all occur, in order."""
    catalogue_patterns = [t["pattern"] for t in catalogue]
    constant = lambda values: F.array(*[F.lit(v) for v in values])
    patterns = constant([_start_match(p) for p in catalogue_patterns])
    content = F.col("content")
    out = fields.withColumn("_places", _candidates(catalogue_patterns)("content"))
    fits = F.filter("_places", lambda k: F.call_function("rlike", content, F.get(patterns, k)))
    out = out.select(*fields.columns, _once(F.get(fits, 0), "_place"))
    idx = F.get(constant([t["idx"] for t in catalogue]), F.col("_place"))
    names = constant([t["template"] if "template" in t else t["pattern"] for t in catalogue])
    out = out.withColumns({"idx": idx, "event_id": F.concat(F.lit("E"), idx.cast("string")), "event_template": F.get(names, F.col("_place"))})
    if arguments:
        kept = constant([",".join(map(str, t["args_keep"] or [])) for t in catalogue])
        groups = F.filter(F.split(F.coalesce(F.get(kept, F.col("_place")), F.lit("")), ","), lambda k: k != "")
        pattern = F.get(patterns, F.col("_place"))
        out = out.withColumn(
            "args", F.transform(groups, lambda k: F.call_function("regexp_extract", content, pattern, k.cast("int") + 1))
        )
    return out.drop("_place")


def match_templates(
    fields: DataFrame, templates: DataFrame, arguments: bool = False, long_catalogue: int = LONG_CATALOGUE
) -> DataFrame:
    """Add ``idx, event_id, event_template`` of the first template, in ``idx`` order, matching at
    the start of ``content`` (null if none) and, if asked, ``args``: the kept groups, packed."""
    catalogue = sorted(small_rows(templates), key=lambda r: r["idx"])
    if len(catalogue) > long_catalogue:
        return _match_long(fields, catalogue, arguments)
    out = fields.withColumn("_idx", F.lit(None).cast("int"))
    for start in range(0, len(catalogue), MATCH_STEP):
        tests = [
            F.when(F.col("content").rlike(_start_match(t["pattern"])), F.lit(t["idx"]))
            for t in catalogue[start : start + MATCH_STEP]
        ]
        out = out.select(*fields.columns, _once(F.coalesce("_idx", *tests), "_idx"))
    out = out.withColumnRenamed("_idx", "idx")
    names = {t["idx"]: t["template"] if "template" in t else t["pattern"] for t in catalogue}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    out = out.withColumn("event_id", F.concat(F.lit("E"), F.col("idx").cast("string"))).withColumn(
        "event_template", F.try_element_at(table, F.col("idx"))
    )
    if arguments:
        packed = F.array().cast("array<string>")
        for t in catalogue:
            groups = [F.regexp_extract("content", _start_match(t["pattern"]), k + 1) for k in t["args_keep"] or []]
            if groups:
                packed = F.when(F.col("idx") == t["idx"], F.array(*groups)).otherwise(packed)
        out = out.withColumn("args", packed)
    return out


def number_lines(kept: DataFrame, width: int = LINE_BUCKET) -> DataFrame:
    """Add ``line_id`` 1..n over the kept lines."""
    ranked = rank_in_order(kept, line_bucket("line_no", width), ["line_no"], out="line_id")
    return ranked.withColumn("line_id", F.col("line_id") + 1)


def structured_hdfs(
    lines: DataFrame, templates: DataFrame, on_bad_line: str = "stop", arguments: bool = True
) -> DataFrame:
    """Full structured table; lines without a template keep empty trailing columns."""
    # Every kept line gets a number, so numbers come from the line alone, before anything is parsed.
    numbered = number_lines(hdfs_until_short(lines, on_bad_line).select("line_no", "value"))
    fields = hdfs_fields(numbered)
    return match_templates(fields, templates, arguments)


def structured_openstack(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """Full structured table; lines without a template are dropped before numbering."""
    matched = match_templates(openstack_fields(lines), templates)
    # Which lines are kept is known only after matching; the table is read twice, the text parsed once.
    return number_lines(stage(matched.where(F.col("idx").isNotNull()), "matched"))
