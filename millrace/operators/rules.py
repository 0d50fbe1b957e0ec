"""Finding rules as tables: what session metrics and a scanned tree show, in the shape of ``findings.SCHEMA``.

A rule looks at counts and at the first few rows that it names, so each is a grouped sum or a top-n of its input beside a
one-row table of totals; no list of all that is found is made anywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import usage
from millrace.operators import repo as R
from millrace.operators import sessions
from millrace.operators.findings import top_per_group

#: Waste in USD from which it matters, and from which it is severe.
MATERIAL_USD, SEVERE_USD = 0.50, 1.00
#: Sessions and files of each whose repeated reading is priced, and characters of a read.
REREAD_SESSIONS, REREAD_FILES, REREAD_CHARS = 5, 2, 4000
#: Junk files beyond which they are a grave matter, orphans beyond which they are a middling one.
MANY_JUNK, MANY_ORPHANS = 5, 3
#: Names that evidence shows of a list.
SHOWN = 4


def row(id_: str, title: str, severity: Column | str, category: str, evidence: Column, advice: str, impact: Column | None = None, locations: Column | None = None, effort: str = "small", autofixable: bool = False, tags: tuple[str, ...] = ()) -> list[Column]:
    """The columns of a finding."""
    own = severity if isinstance(severity, Column) else F.lit(severity)
    empty = F.array().cast("array<string>")
    return [
        F.lit(id_).alias("id"), F.lit(title).alias("title"), own.alias("severity"), F.lit(category).alias("category"), evidence.alias("evidence"), F.lit(advice).alias("recommendation"),
        (F.lit(None).cast("double") if impact is None else impact.cast("double")).alias("impact_usd"), (empty if locations is None else locations).alias("locations"),
        F.lit(effort).alias("effort"), F.lit(autofixable).alias("autofixable"), (F.array(*map(F.lit, tags)) if tags else empty).alias("tags"),
    ]


def many(n: Column, one: str, more: str | None = None) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(more or f"{one}s"))


def percent(x: Column | float) -> Column:
    return F.concat(F.bround((x if isinstance(x, Column) else F.lit(x)) * 100, 0).cast("int").cast("string"), F.lit("%"))


def _input_cost(chars: Column, price: usage.Price) -> Column:
    return F.bround(usage.tokens_of_chars(chars) * F.lit(price.input) / F.lit(1e6), 2)


def _first(rows: DataFrame, order: list[Column], n: int, name: str, shown: Column) -> DataFrame:
    """One row with ``name``, an array of the first ``n`` rows' ``shown`` in order."""
    top = rows.orderBy(*order).limit(n).select(shown.alias("_x"), F.monotonically_increasing_id().alias("_i"))
    held = F.array_sort(F.collect_list(F.struct("_i", "_x")))
    return top.agg(F.transform(held, lambda x: x._x).alias(name))


def _beside(one: DataFrame, *others: DataFrame) -> DataFrame:
    """One-row tables side by side."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), others, one)


def token_findings(metrics: DataFrame, order: list[Column] | None = None, price: usage.Price = usage.Price()) -> DataFrame:
    """What session metrics show; each kind of waste is one finding. ``order``: in which sessions were loaded."""
    order = order or [F.col("session_id")]
    again = F.size("reread_files") > 0
    sums = metrics.agg(
        F.count("*").alias("sessions"), F.coalesce(F.sum("cache_waste_usd"), F.lit(0)).cast("double").alias("waste"), F.count_if(F.col("cache_waste_usd") > 0).alias("poor"),
        F.count_if(again).alias("again"), F.coalesce(F.sum("big_outputs"), F.lit(0)).alias("big"), F.count_if(F.size("repeated_cmds") > 0).alias("loops"),
        F.count_if(F.col("denial_ratio") > usage.HIGH_DENIAL_RATIO).alias("denied"), F.count_if(F.col("compactions") >= usage.COMPACTIONS).alias("thrash"),
    )
    worst = _first(metrics.where("cache_waste_usd > 0"), [F.col("cache_waste_usd").desc(), *order], 3, "worst", F.concat(F.substring("session_id", 1, 8), F.lit(" ("), percent(F.col("cache_hit_ratio")), F.lit(")")))
    reads = _first(metrics.where(again), order, REREAD_SESSIONS, "reads", F.slice(F.map_entries("reread_files"), 1, REREAD_FILES))
    one = _beside(sums, sessions.totals(metrics).select(F.col("overall_cache_hit_ratio").alias("ratio")), worst, reads).withColumn("reads", F.flatten("reads"))
    names = F.array_join(F.transform(F.slice("reads", 1, 6), lambda e: F.concat(F.substring_index(e.key, "/", -1), F.lit(" x"), e.value.cast("string"))), ", ")
    extra = F.aggregate("reads", F.lit(0).cast("bigint"), lambda a, e: a + e.value - 1)
    low = F.col("ratio") < usage.LOW_CACHE_RATIO
    cache = F.concat(
        percent(F.col("ratio")), F.lit(f" of context came from the cache (aim: {100 * usage.LOW_CACHE_RATIO:.0f}%); "), F.col("poor").cast("string"), F.lit(" of "), F.col("sessions").cast("string"),
        F.lit(" sessions are below it. Worst: "), F.array_join("worst", ", "), F.lit("."),
    )
    said = lambda n, what: F.concat(many(F.col(n), "session"), F.lit(f" {what}."))
    rules = [
        ((F.col("waste") > 0) & low, row("cache-hit-ratio", "The prompt cache is underused", F.when(F.col("waste") >= SEVERE_USD, "high").otherwise("medium"), "tokens", cache, "Keep what comes first in a prompt the same from turn to turn, and leave out what changes, such as times and file dumps.", F.bround("waste", 2))),
        ((F.col("waste") >= MATERIAL_USD) & ~low, row("cache-hit-ratio", "A few sessions miss the cache", "low", "tokens", cache, "The whole is sound. Look at these sessions only if they come again; short ones never warm the cache.", F.bround("waste", 2))),
        (F.col("again") > 0, row("file-reread-churn", "Files are read again and again", "medium", "tokens", F.concat(many(F.col("again"), "session"), F.lit(f" read a file {usage.REREAD_COUNT} times or more: "), names, F.lit(".")), "Read a file once, widely enough, and keep it in context.", _input_cost(REREAD_CHARS * extra, price))),
        (F.col("big") > 0, row("oversized-tool-output", "Tool outputs flood the context", "medium", "tokens", F.concat(many(F.col("big"), "tool result"), F.lit(f" had {usage.BIG_OUTPUT_CHARS:,} characters or more.")), "Bound noisy commands, read parts of files, and search long logs instead of printing them.", _input_cost(usage.BIG_OUTPUT_CHARS * F.col("big"), price))),
        (F.col("loops") > 0, row("command-retry-loops", "The same command is run again", "low", "tokens", said("loops", f"ran a command {usage.REPEATED_COMMANDS} times or more"), "Write down the form that works as a script.", F.lit(0.0))),
        (F.col("denied") > 0, row("permission-and-error-friction", "Many tool calls fail", "low", "tokens", said("denied", f"had over {100 * usage.HIGH_DENIAL_RATIO:.0f}% of tool calls fail"), "Allow safe commands beforehand and mend those that always fail.", F.lit(0.0))),
        (F.col("thrash") > 0, row("context-thrash", "Context is compacted often", "medium", "tokens", said("thrash", f"compacted {usage.COMPACTIONS} times or more"), "Shorten what is always loaded and load the rest on demand.", F.lit(0.0))),
    ]
    return _fired(one, rules)


def _fired(one: DataFrame, rules: list[tuple[Column, list[Column]]]) -> DataFrame:
    """The findings of one row of facts whose rules fire, with ``pos``, the rules' order: one pass over that row."""
    made = F.array(*[F.when(fires, F.struct(F.lit(i).alias("pos"), *columns)) for i, (fires, columns) in enumerate(rules)])
    return one.select(F.inline(F.filter(made, lambda x: x.isNotNull())))


#: Of each rule about a tree, the places that it names at most.
PLACES = {"junk": 10, "code": 8, "docs": 8, "near": 8, "library": 12, "scripts": 12, "big": 8, "dead": 8, "stems": 5}


def _places(found: DataFrame, exact: DataFrame, near: DataFrame, orphans: DataFrame) -> DataFrame:
    """rule, least (what comes first), name and shown of everything that a rule may name."""
    place = lambda rule, fires, least, shown: F.when(fires, F.struct(F.lit(rule).alias("rule"), least.cast("bigint").alias("least"), F.col("path").alias("name"), shown.alias("shown")))
    measured = F.concat("path", F.lit(" ("), F.format_number("lines", 0), F.lit(" lines)"))
    own = F.array(
        place("junk", F.col("class") == R.JUNK, F.lit(0), F.col("path")), place("big", F.col("lines") >= R.MANY_LINES, -F.col("lines"), measured),
        place("dead", F.col("dead_run") >= R.MANY_COMMENTS, F.lit(0), F.col("path")),
    )
    of = lambda rows, rule, name: rows.select(rule.alias("rule"), F.lit(0).cast("bigint").alias("least"), F.col(name).alias("name"), F.col(name).alias("shown"))
    parts = [
        found.select(F.inline(F.filter(own, lambda x: x.isNotNull()))), of(R.scattered(found), F.lit("stems"), "stem"), of(near, F.lit("near"), "first"),
        of(exact, F.when(F.col("is_doc"), "docs").otherwise("code"), "first"), of(orphans, F.when(F.col("is_script"), "scripts").otherwise("library"), "path"),
    ]
    return reduce(DataFrame.unionAll, parts)


def _like(found: DataFrame, groups: DataFrame, keys: list[str], name: str, sign: str) -> DataFrame:
    """One row with ``name``: the names of the first few groups' files."""
    top = R.members(found, groups.orderBy("first").limit(SHOWN), keys)
    return _first(top, [F.col("first")], SHOWN, name, F.array_join(F.transform("paths", lambda p: F.substring_index(p, "/", -1)), f" {sign} "))


def repo_findings(found: DataFrame, exact: DataFrame, near: DataFrame, orphans: DataFrame) -> DataFrame:
    """What a scanned tree shows. found: ``repo.features``; the others as ``repo`` gives them.

    All that rules may name goes through one count and one top-n by rule, cut before its shuffle.
    """
    places = _places(found, exact, near, orphans)
    counts = places.groupBy("rule").agg(F.count("*").alias("n"))
    first = top_per_group(places, ["rule"], [F.col("least"), F.col("name")], max(PLACES.values()))
    first = first.groupBy("rule").agg(F.array_sort(F.collect_list(F.struct("least", "name", "shown"))).alias("at"))
    both = counts.join(F.broadcast(first), "rule")
    of = lambda rule, c: F.max(F.when(F.col("rule") == rule, F.col(c)))
    facts = both.agg(*[F.coalesce(of(rule, "n"), F.lit(0).cast("bigint")).alias(rule) for rule in PLACES], *[F.transform(F.slice(of(rule, "at"), 1, most), lambda x: x.shown).alias(f"{rule}_at") for rule, most in PLACES.items()], (-F.get(of("big", "at"), F.lit(0)).least).alias("longest"))
    one = _beside(facts, _like(found, exact.where("not is_doc"), ["digest"], "code_like", "="), _like(found, near, ["suffix", "norm"], "near_like", "~"))
    n = F.col
    such = lambda name: F.concat(F.lit(", such as "), F.array_join(f"{name}_like", "; "))
    said = lambda count, rest: F.concat(count, rest if isinstance(rest, Column) else F.lit(rest))
    at = lambda name: n(f"{name}_at")
    rules = [
        ("junk", row("junk-artifacts", "Junk is kept in the tree", F.when(n("junk") > MANY_JUNK, "high").otherwise("medium"), "repo", said(many(n("junk"), "junk file"), " among the files (logs, editor and system leftovers)."), "Delete them and have them ignored.", None, at("junk"), "trivial", True, ("hygiene",))),
        ("code", row("duplicate-code", "Source files with the same bytes", "medium", "repo", F.concat(many(n("code"), "group"), F.lit(" of equal source files"), such("code")), "Keep one and import it.", None, at("code"), tags=("dedupe", "slop"))),
        ("docs", row("duplicate-docs", "Documents with the same bytes", "low", "repo", said(many(n("docs"), "group"), " of equal documents."), "Keep one and link to it.", None, at("docs"), "trivial", tags=("docs",))),
        ("near", row("near-duplicate-code", "Source files that differ in form only", "low", "repo", F.concat(many(n("near"), "group"), F.lit(" of files equal but for layout, comments and imports"), such("near")), "Draw what they share into one module with parameters.", None, at("near"), "medium", tags=("slop", "dedupe"))),
        ("library", row("orphan-modules", "Modules that nothing refers to", F.when(n("library") > MANY_ORPHANS, "medium").otherwise("low"), "repo", said(many(n("library"), "module"), " without a reference; look for dynamic imports first."), "Check them, then delete what is dead.", None, at("library"), "medium", tags=("dead-code",))),
        ("scripts", row("unreferenced-scripts", "Scripts that nothing refers to", "info", "repo", said(many(n("scripts"), "script"), " without a reference, which is as it should be for entry points."), "Keep those in use and archive the rest.", None, at("scripts"), tags=("dead-code", "scripts"))),
        ("big", row("oversized-files", "Very long source files", "low", "repo", F.concat(many(n("big"), "file"), F.lit(f" of {R.MANY_LINES} lines or more; the longest has "), F.format_number("longest", 0), F.lit(".")), "Split them by what they are for.", None, at("big"), "medium", tags=("structure",))),
        ("dead", row("commented-out-code", "Long runs of commented-out code", "low", "repo", said(many(n("dead"), "file"), f" with {R.MANY_COMMENTS} such lines in a row or more."), "Delete them; history keeps them.", None, at("dead"), "trivial", True, ("slop",))),
        ("stems", row("ambiguous-basenames", "One file name in many folders", "info", "repo", F.concat(many(n("stems"), "name"), F.lit(f" in {R.MANY_FOLDERS} folders or more, such as "), F.array_join("stems_at", ", "), F.lit(".")), "Give them names of their own, or put them together.", tags=("naming",))),
    ]
    return _fired(one, [(n(name) > 0, columns) for name, columns in rules])


def by_impact() -> list[Column]:
    """Order of token findings: severity, impact, the rules' order."""
    return [usage.severity_rank(F.col("severity")).desc(), F.coalesce("impact_usd", F.lit(0.0)).desc(), F.col("pos")]


def by_locations() -> list[Column]:
    """Order of a tree's findings: severity, number of places, the rules' order."""
    return [usage.severity_rank(F.col("severity")).desc(), F.size("locations").desc(), F.col("pos")]


def summary(found: DataFrame, exact: DataFrame, orphans: DataFrame) -> DataFrame:
    """One row: the inventory of a tree, what copies and junk cost, and its health score."""
    groups = exact.agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum((F.col("n") - 1) * F.col("size")), F.lit(0)).cast("bigint").alias("copied"))
    apart = orphans.agg(F.count_if(~F.col("is_script")).alias("orphan_candidates"))
    one = _beside(R.inventory(found), groups, apart)
    one = one.withColumns({"junk_count": F.col("junk") + F.col("duplicate_groups"), "reclaimable_bytes": F.col("junk_bytes") + F.col("copied")})
    score = R.health_score(F.col("junk_count"), F.col("orphan_candidates"), F.col("duplicate_groups"), F.col("reclaimable_bytes"), F.col("bytes"))
    return one.withColumn("health_score", score).drop("copied")

