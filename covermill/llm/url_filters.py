"""URL filters with DataFrame operations only: rules first, then a tree of path templates per host.

The urls that a rule decides are the labelled ones. Paths are reduced to shapes (digits become ``{n}``) and counted by
host, shape and label, so that what follows works on distinct shapes. The tree grows level by level:
a branch stays a literal if it has pages enough and differs from its siblings taken together, by chi-square tests of its
labels and of whether paths go on below it. All other branches, rare segments of variable text and those statistically
alike, are merged into one wildcard. A template at the end of a path is rejected if the smoothed share
of blocked pages among its labelled ones reaches a limit.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covermill.llm.line_dedup import LOWER, UPPER
from covermill.llm.token_files import new_folder


class Rule(NamedTuple):
    """Blocks or allows the urls of a host and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Levels of the tree; all segments from the last level on count as one.
DEPTH = 16
#: Pages that a branch, and its siblings together, need to be told apart.
MIN_PAGES = 5
#: Chi-square beyond which two branches differ at 1 %: of three labels, and of two ways to go on.
LABELS_DIFFER, WAYS_DIFFER = 9.21, 6.63
#: Smoothing: so many blocked and as many allowed pages are added to each template; then the share that rejects it, in percent.
SMOOTHING, REJECTED_PERCENT = 1, 80
_WILDCARD = "*"
_COUNTS = ["blocked", "allowed", "unlabelled"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z in lower case, and from there up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _shape(path: Column) -> Column:
    """The segments after the first slash with digits replaced, ``DEPTH`` at most: the last holds the rest."""
    return F.slice(F.split(F.regexp_replace(path, "[0-9]+", "{n}"), "/", DEPTH + 1), 2, DEPTH)


def _fitting(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text, r.verdict)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _differ(mine: list[str], all_: list[str], limit: float) -> Column:
    """Whether a branch's counts differ from its siblings' by chi-square."""
    n, r = F.lit(0.0), F.lit(0.0)
    for a, b in zip(mine, all_, strict=True):
        n, r = n + F.col(a).cast("double"), r + (F.col(b) - F.col(a)).cast("double")
    chi = F.lit(0.0)
    for a, b in zip(mine, all_, strict=True):
        x, total = F.col(a).cast("double"), F.col(b).cast("double")
        chi = chi + F.when(total > 0, (x * r - (total - x) * n) * (x * r - (total - x) * n) / total).otherwise(0.0)
    return chi > F.lit(limit) * (n * r)


def grow(shapes: DataFrame, folder: str) -> DataFrame:
    """Adds ``template`` to ``host``, ``tokens`` and the three counts of pages; steps are written below ``folder``."""
    spark = shapes.sparkSession
    columns = "host string, tokens array<string>, blocked long, allowed long, unlabelled long, template string"
    shapes.withColumn("template", F.lit("")).write.parquet(f"{folder}/tree-0")
    now = spark.read.schema(columns).parquet(f"{folder}/tree-0")
    deepest = now.agg(F.max(F.size("tokens"))).first()[0] or 0
    for level in range(deepest):
        pages = F.col("blocked") + F.col("allowed") + F.col("unlabelled")
        token, size = F.get("tokens", F.lit(level)).alias("token"), F.size("tokens")
        sums = [F.sum(c).alias(c) for c in _COUNTS]
        ways = [F.sum(F.when(size == level + 1, pages).otherwise(0)).alias("ends"), F.sum(F.when(size > level + 1, pages).otherwise(0)).alias("goes_on")]
        now.where(size > level).groupBy("host", "template", token).agg(*sums, *ways).write.parquet(f"{folder}/branches-{level}")
        branches = spark.read.schema("host string, template string, token string, blocked long, allowed long, unlabelled long, ends long, goes_on long").parquet(f"{folder}/branches-{level}")
        together = [*_COUNTS, "ends", "goes_on"]
        nodes = branches.groupBy("host", "template").agg(F.count(F.lit(1)).alias("branches"), *[F.sum(c).alias(f"all_{c}") for c in together])
        every = F.col("all_ends") + F.col("all_goes_on")
        enough = (pages >= MIN_PAGES) & (every - pages >= MIN_PAGES)
        other = _differ(_COUNTS, [f"all_{c}" for c in _COUNTS], LABELS_DIFFER) | _differ(["ends", "goes_on"], ["all_ends", "all_goes_on"], WAYS_DIFFER)
        literal = (F.col("branches") == 1) | (enough & other)
        named = branches.join(nodes, ["host", "template"]).select("host", "template", "token", F.when(literal, F.col("token")).otherwise(_WILDCARD).alias("name"))
        on = ["host", "template", "token"]
        done = now.where(size <= level).select(*columns_of(columns))
        step = now.where(size > level).withColumn("token", token).join(named, on).withColumn("template", F.concat("template", F.lit("/"), "name"))
        done.unionByName(step.select(*columns_of(columns))).write.parquet(f"{folder}/tree-{level + 1}")
        now = spark.read.schema(columns).parquet(f"{folder}/tree-{level + 1}")
    return now


def columns_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def with_verdicts(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``verdict`` (allow or block) and, of urls rejected by it, ``template``.

    The longest rule that fits decides (ties: the last by text); a rule fits its host and all subdomains. Where none does,
    the url is blocked if its template was rejected. ``rules`` are the caller's short list, part of the query.
    A null url, or one without ``://``, has an empty host and path. Every row is kept, repeated ones
    count as so many pages; columns of the five names are replaced. Paths are taken whole, however long: from
    segment 16 on they count as one segment. An empty table gives an empty result.
    """
    spark, folder = pages.sparkSession, new_folder(pages.sparkSession, "urls")
    new = ["host", "path", "rule", "verdict", "template"]
    names = [c for c in pages.columns if c.lower() not in new]
    host, path = host_and_path(F.coalesce(F.col(url), F.lit("")))
    rows = pages.select(F.struct(*[F.col(c) for c in names]).alias("held"), host.alias("host"), path.alias("path"))
    text, verdict = _fitting(rules, F.col("host"), F.col("path"))
    rows = rows.select("held", "host", "path", text.alias("rule"), verdict.alias("decided"), _shape(F.col("path")).alias("tokens"))

    counts = [F.count(F.when(c, 1)).alias(n) for c, n in zip((F.col("decided") == "block", F.col("decided") == "allow", F.col("decided").isNull()), _COUNTS, strict=True)]
    tree = grow(rows.groupBy("host", "tokens").agg(*counts), folder)
    total = tree.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in _COUNTS[:2]])
    share = 100 * (F.col("blocked") + SMOOTHING) >= REJECTED_PERCENT * (F.col("blocked") + F.col("allowed") + 2 * SMOOTHING)
    rejected = total.where(share).select("host", "template")
    # only shapes of which an undecided page may have need of it
    tree.where(F.col("unlabelled") > 0).join(rejected, ["host", "template"]).select("host", "tokens", "template").write.parquet(f"{folder}/rejected")
    rejected = spark.read.schema("host string, tokens array<string>, template string").parquet(f"{folder}/rejected")
    template = F.when(F.col("decided").isNull(), F.col("template"))
    judged = F.coalesce("decided", F.when(F.col("template").isNotNull(), "block").otherwise("allow"))
    return rows.join(rejected, ["host", "tokens"], "left").select("held.*", "host", "path", "rule", judged.alias("verdict"), template.alias("template"))
