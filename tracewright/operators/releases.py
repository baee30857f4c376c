"""Packages, releases, CI runs, pull requests and branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions import classify as C
from tracewright.functions.scalars import age_days, script_value, strict_time, version_compare, version_key
from tracewright.operators.ordered import Ordered

RUNS, PULLS, REFS = 5, 30, 50
#: Attempts at a registry.
ATTEMPTS = 3
#: Rows of a group that tasks may each keep while they look for its first ones; beyond, groups are numbered over ranges.
FEW = 1000
#: A line that names a failure.
FAILURE = r"(?i)\b(error|fail(ed|ure|ures)?|fatal|exception)\b"


def real_dependencies(requires: Column) -> Column:
    """names that aren't the language or its extensions, sorted."""
    names = F.coalesce(F.map_keys(requires), F.array().cast("array<string>"))
    return F.array_sort(F.filter(names, lambda k: (k != "php") & ~k.startswith("ext-")))


def package_list(packages: DataFrame) -> DataFrame:
    """One row per package by name and directory; the type defaults to library."""
    keys = lambda c: F.array_sort(F.coalesce(F.map_keys(c), F.array().cast("array<string>")))
    return packages.select(
        "name", "dir", F.coalesce("version", F.lit("")).alias("version"), F.coalesce(F.nullif("type", F.lit("")), F.lit("library")).alias("type"), F.coalesce(F.element_at("require", F.lit("php")), F.lit("")).alias("php"),
        keys(F.col("scripts")).alias("scripts"), real_dependencies(F.col("require")).alias("deps"), real_dependencies(F.col("require-dev")).alias("dev"),
    ).orderBy("name", "dir")


def package_scripts(packages: DataFrame) -> DataFrame:
    """A row for each script of each package."""
    return packages.select("name", F.explode("scripts").alias("script", "value")).select("name", "script", script_value(F.col("value")).alias("value")).orderBy("name", "script")


def latest_stable(versions: DataFrame) -> DataFrame:
    """The highest stable version of each name, the first of equal ones."""
    stable = versions.where(C.is_stable(F.col("version")))
    return stable.groupBy("name").agg(F.max_by("version", F.struct(version_key(F.col("version")).alias("k"), (-F.col("ord")).alias("o"))).alias("published"))


def release_status(packages: DataFrame, tags: DataFrame, versions: DataFrame, offline: bool = False, unreachable: DataFrame | None = None) -> DataFrame:
    """packages(name, dir) with tags(dir, local_tag, pushed) and the registry's versions(name, version, ord)."""
    base = packages.select("name", "dir").join(tags, "dir", "left")
    if offline:
        return base.select("name", "dir", F.coalesce("local_tag", F.lit("")).alias("local_tag"), F.lit("?").alias("pushed"), F.lit("").alias("published"), F.lit("skip-net").alias("state")).orderBy("name", "dir")
    out = base.join(latest_stable(versions), "name", "left")
    state = C.release_state(F.col("local_tag"), F.col("published"), version_compare(F.col("published"), F.col("local_tag")))
    if unreachable is not None:
        out = out.join(unreachable.select("name", F.lit(True).alias("down")), "name", "left")
        state = F.when(F.col("down"), "unknown").otherwise(state)
    empty = F.lit("")
    return out.select("name", "dir", F.coalesce("local_tag", empty).alias("local_tag"), F.coalesce("pushed", F.lit("?")).alias("pushed"), F.coalesce("published", empty).alias("published"), state.alias("state")).orderBy("name", "dir")


def drift(status: DataFrame) -> DataFrame:
    """A22."""
    return status.agg(F.count_if(F.col("state").isin("needs-update", "local-stale", "unpublished", "no-tags")).alias("drift"), F.count_if(F.col("state") == "unknown").alias("unknown"))


def first_of_each(rows: DataFrame, by: str, order: str, limit: int) -> DataFrame:
    """The first `limit` rows of each group, whatever its size, without a task that holds a group; one row a group reaches the driver."""
    if limit <= FEW:
        return rows.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy(order))).where(F.col("_k") <= limit).drop("_k")
    if rows.groupBy(by).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0] <= limit:
        return rows
    numbered = Ordered(rows, by, order).rows("_k", 0)
    starts = numbered.groupBy(F.col(by).alias("_by")).agg(F.min("_k").alias("_start"))
    return numbered.join(F.broadcast(starts), F.col(by).eqNullSafe(F.col("_by"))).where(F.col("_k") - F.col("_start") < limit).select(*rows.columns)


def pull_requests(prs: DataFrame, limit: int = PULLS) -> DataFrame:
    """prs(dim, repo, is_fork, number, title, is_draft, review, ci, url) of the dimensions author, reviewer and owned.

    A request found in several keeps the first of them; those of forks go from owned only. Each
    dimension has its first `limit` rows by ord.
    """
    rank = C.first_match([(F.col("dim") == d, k) for k, d in enumerate(("author", "reviewer", "owned"))], 9)
    kept = first_of_each(prs, "dim", "ord", limit).where(~((F.col("dim") == "owned") & F.col("is_fork"))).withColumn("prec", rank)
    one = kept.withColumn("k", F.row_number().over(W.partitionBy("repo", "number").orderBy("prec", "ord"))).where("k = 1")
    ci = C.ci_state(F.col("ci"))
    return one.select("repo", "number", ci.alias("ci"), F.coalesce("review", F.lit("")).alias("review"), F.col("dim").alias("role"), F.col("is_draft").alias("draft"), "title", "url").orderBy(C.action_rank(F.col("ci"), F.col("review")), "repo", "number")


def branches(refs: DataFrame, now: Column, limit: int = REFS) -> DataFrame:
    """Branches of repositories that aren't archived, but their default ones: merged, closed, none, open."""
    live = refs.where(~F.col("archived") & (F.col("name") != F.col("default_branch")))
    status = C.branch_status(F.col("pr_state"))
    out = live.select("repo", F.col("name").alias("branch"), age_days(strict_time(F.col("committed_date")), now).alias("age_days"), C.branch_label(F.col("pr_state"), F.col("pr_number")).alias("pr"), status.alias("status"))
    return out.orderBy(C.status_rank(F.col("status")), "repo", "branch")


def ci_latest(runs: DataFrame) -> DataFrame:
    """The newest run of each package."""
    return runs.withColumn("k", F.row_number().over(W.partitionBy("pkg").orderBy(F.desc("created"), F.desc("id")))).where("k = 1").drop("k").orderBy("pkg")


def ci_failing(runs: DataFrame) -> DataFrame:
    """A22, F13."""
    return runs.agg(F.count_if(C.is_failing(F.col("status"), F.col("conclusion"))).alias("failing"))


def first_failure(output: DataFrame) -> DataFrame:
    """the first line of each run's output that names a failure, else the last that isn't blank."""
    text = F.btrim("line")
    return output.groupBy("dir").agg(F.coalesce(F.min_by(text, F.when(F.col("line").rlike(FAILURE), F.col("ord"))), F.max_by(text, F.when(text != "", F.col("ord"))), F.lit("")).alias("fail"))


def with_precedence(managed: DataFrame, found: DataFrame) -> DataFrame:
    """Managed entries hide found ones of the same name."""
    both = managed.withColumn("managed", F.lit(True)).unionByName(found.withColumn("managed", F.lit(False)))
    return both.withColumn("k", F.row_number().over(W.partitionBy("name").orderBy(F.desc("managed"), "path"))).where("k = 1").drop("k").orderBy("name")


def bundle_drift(receipts: DataFrame, files: DataFrame) -> DataFrame:
    """receipts(pack, path, sha256) against files(path, content): how many files are gone, unchanged and changed."""
    held = files.select("path", F.sha2("content", 256).alias("now"))
    joined = receipts.join(held, "path", "left")
    return joined.groupBy("pack").agg(F.count_if(F.col("now").isNull()).alias("missing"), F.count_if(F.col("now") == F.col("sha256")).alias("ok"), F.count_if(F.col("now") != F.col("sha256")).alias("modified")).orderBy("pack")


def worktrees(lines: DataFrame) -> DataFrame:
    """SC21: a row for each block of lines(ord, line) of a worktree listing, its blocks numbered down the listing."""
    of = lambda key: F.max(F.when(F.startswith("line", F.lit(key + " ")), F.substring("line", len(key) + 2, 1 << 20)))
    blocks = Ordered(lines.select("ord", "line"), "ord", sums={"block": F.when(F.startswith("line", F.lit("worktree ")), 1).otherwise(0)})
    rows = blocks.rows().where("block > 0").groupBy("block").agg(of("worktree").alias("dir"), of("HEAD").alias("head"), of("branch").alias("ref"), F.bool_or(F.col("line") == "detached").alias("detached"))
    return rows.select("block", "dir", F.substring_index("dir", "/", -1).alias("slug"), "head", F.regexp_replace("ref", "^refs/heads/", "").alias("branch"), "detached")


def registry_states(attempts: DataFrame, most: int = ATTEMPTS, pause: float = 0.2) -> DataFrame:
    """SC17: (name, state, version, attempts, waited) from attempts(name, ord, status, retry_after, version) at a registry, in the order of ord.

    200 with a version is published and without one unknown, 404 unpublished; 429, 500 and more, and no status (the
    network failed) are tried again, up to `most` attempts; any other status is unknown at once. Before the next attempt the pause is
    what a 429 asks for (whole seconds above 0), else `pause`, three times as long each time; waited sums them, without the jitter a
    caller adds. Attempts after the one that decides are not looked at.
    """
    first = attempts.withColumn("k", F.row_number().over(W.partitionBy("name").orderBy("ord"))).where(F.col("k") <= most)
    listed = first.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("k", "status", "retry_after", "version"))).alias("a"))

    def step(s: Column, x: Column) -> Column:
        again = x["status"].isNull() | (x["status"] == 429) | (x["status"] >= 500)
        state = F.when(x["status"] == 404, "unpublished").when((x["status"] == 200) & (F.coalesce(x["version"], F.lit("")) != ""), "published").when(again & (x["k"] < most), F.lit(None).cast("string")).otherwise("unknown")
        asked = F.when((x["status"] == 429) & (x["retry_after"] > 0), x["retry_after"].cast("double"))
        wait = F.when(again & (x["k"] < F.least(F.lit(most), F.size("a"))), F.coalesce(asked, F.lit(pause) * F.pow(F.lit(3.0), x["k"] - 1))).otherwise(0.0)
        after = F.struct(state.alias("state"), F.when(state == "published", x["version"]).alias("version"), x["k"].cast("long").alias("attempts"), (s["waited"] + wait).alias("waited"))
        return F.when(s["state"].isNotNull(), s).otherwise(after)

    start = F.struct(F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("version"), F.lit(0).cast("long").alias("attempts"), F.lit(0.0).alias("waited"))
    end = listed.select("name", F.aggregate("a", start, step).alias("s"))
    return end.select("name", F.coalesce("s.state", F.lit("unknown")).alias("state"), "s.version", "s.attempts", F.round("s.waited", 3).alias("waited"))
