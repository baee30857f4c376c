"""Captured documents of registries, CI runs, reviews and tags as the rows that the release operators take (SC16-SC18).

Documents are rows (…, value), each value a whole JSON text; those that aren't JSON of the expected kind give no rows. Lists are
taken apart by Spark where they are, with the place of each element, and fields of another kind than expected are absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def elements(docs: DataFrame, path: str, *keys: str) -> DataFrame:
    """(keys, at, e): the elements of the list at a path of v, numbered from 0."""
    return docs.select(*keys, F.posexplode(field("v", path, "array<variant>")).alias("at", "e"))


def parsed(docs: DataFrame, *keys: str) -> DataFrame:
    return docs.select(*keys, F.try_parse_json("value").alias("v")).where("v IS NOT NULL")


#: Sets of a document of pull requests, by the dimension that they stand for.
DIMENSIONS = {"authored": "author", "review": "reviewer", "owned": "owned"}


def pull_request_documents(docs: DataFrame) -> DataFrame:
    """SC18, D17: rows for pull_requests() from docs(ord, value): nodes of the authored, review and owned sets, in the order of documents and nodes.

    Nodes without a repository or a number are no requests. ci is the state of the last commit's checks, null without one.
    """
    v, out = parsed(docs, "ord"), None
    for name, dim in DIMENSIONS.items():
        e = elements(v, f"$.data.{name}.nodes", "ord")
        rows = e.select(
            F.lit(dim).alias("dim"), field("e", "$.repository.nameWithOwner").alias("repo"), F.coalesce(field("e", "$.repository.isFork", "boolean"), F.lit(False)).alias("is_fork"), field("e", "$.number", "int").alias("number"), F.coalesce(field("e", "$.title"), F.lit("")).alias("title"),
            F.coalesce(field("e", "$.isDraft", "boolean"), F.lit(False)).alias("is_draft"), F.nullif(field("e", "$.reviewDecision"), F.lit("")).alias("review"), field("e", "$.commits.nodes[0].commit.statusCheckRollup.state").alias("ci"), F.coalesce(field("e", "$.url"), F.lit("")).alias("url"), F.struct("ord", "at").alias("ord"),
        ).where("coalesce(repo, '') <> '' AND number IS NOT NULL")
        out = rows if out is None else out.unionByName(rows)
    return out


def branch_documents(docs: DataFrame) -> DataFrame:
    """SC18, D18: rows for branches() from docs(value): the references of every repository, with their newest pull request."""
    repos = elements(parsed(docs), "$.data.repositoryOwner.repositories.nodes").select(field("e", "$.nameWithOwner").alias("repo"), F.coalesce(field("e", "$.isArchived", "boolean"), F.lit(False)).alias("archived"), field("e", "$.defaultBranchRef.name").alias("default_branch"), F.col("e").alias("v"))
    refs = elements(repos, "$.refs.nodes", "repo", "archived", "default_branch")
    return refs.select("repo", "archived", "default_branch", field("e", "$.name").alias("name"), field("e", "$.target.committedDate").alias("committed_date"), field("e", "$.associatedPullRequests.nodes[0].number", "int").alias("pr_number"), field("e", "$.associatedPullRequests.nodes[0].state").alias("pr_state"))


def run_documents(docs: DataFrame) -> DataFrame:
    """SC18, D16: rows for ci_latest() from docs(pkg, value): a list of runs, or one run."""
    v = parsed(docs, "pkg")
    one = v.where(F.schema_of_variant("v").startswith("OBJECT")).select("pkg", F.col("v").alias("e"))
    rows = elements(v, "$", "pkg").select("pkg", "e").unionByName(one)
    text = lambda path: F.coalesce(field("e", path), F.lit(""))
    return rows.select("pkg", field("e", "$.databaseId", "bigint").alias("id"), text("$.workflowName").alias("workflow"), text("$.status").alias("status"), text("$.conclusion").alias("conclusion"), text("$.headBranch").alias("branch"), text("$.event").alias("event"), text("$.displayTitle").alias("title"), text("$.createdAt").alias("created")).where("id IS NOT NULL")


def registry_documents(docs: DataFrame) -> DataFrame:
    """SC17: (name, version, ord) of docs(name, value): the versions that a registry's document lists for the package that was asked for, whatever else it lists.

    A listing of several documents has their numbers, from 0 on, as page: its versions are in the order of pages.
    """
    page = F.col("page") if "page" in docs.columns else F.lit(0)
    listed = parsed(docs.withColumn("page", page.cast("long")), "name", "page").select("name", "page", F.element_at(field("v", "$.packages", "map<string,variant>"), F.col("name")).alias("v"))
    return elements(listed, "$", "name", "page").select("name", field("e", "$.version").alias("version"), (F.col("page") * (1 << 32) + F.col("at")).alias("ord")).where("version IS NOT NULL")


def tag_listings(described: DataFrame, remote: DataFrame) -> DataFrame:
    """SC16: (dir, local_tag, pushed) from described(dir, line), the newest tag of each directory, and remote(dir, line), the remote's tags.

    A remote that was asked has a row, an empty line if it has no tag; one that wasn't, or didn't answer, leaves ?. Lines are an object and
    refs/tags/NAME; the object that a tag points to (NAME^{}) is the same tag. Directories without a tag have no row.
    """
    local = described.select("dir", F.regexp_replace("line", r"^\s+|\s+$", "").alias("local_tag")).where("local_tag <> ''")
    tags = remote.select("dir", F.regexp_extract("line", r"\trefs/tags/(.*?)(\^\{\})?$", 1).alias("tag"))
    asked = tags.select("dir").distinct().withColumn("asked", F.lit(True))
    there = tags.where("tag <> ''").distinct().withColumn("there", F.lit(True))
    both = local.join(asked, "dir", "left").join(there.withColumnRenamed("tag", "local_tag"), ["dir", "local_tag"], "left")
    return both.select("dir", "local_tag", F.when(F.col("asked").isNull(), "?").when(F.col("there").isNull(), "no").otherwise("yes").alias("pushed"))
