"""Queries of captured API documents and tag listings, with their SQL; documents are put together from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import classify as C
from tracewright.operators import releases as R
from tracewright.plans import document_queries as DQ
from tracewright.sources import api_documents as A
from tracewright.sources.shared import shared_path
from tracewright.sources.stand_ins import table

QUERIES, ORACLES = {}, {}
#: Keys of the table that one page of a captured listing covers: a document holds a page at most, however large the table is.
PAGE = 1000


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def pick(i, *v):
    return F.element_at(F.array(*[F.lit(x) for x in v]), (i % len(v) + 1).cast("int"))


def as_files(docs, label: str):
    """Documents written as text files, one a line, and read again with what they are keyed by."""
    spark = docs.sparkSession
    path = shared_path(spark, label)
    docs.write.json(path)
    return spark.read.schema(docs.schema).json(path)


def listed(*order_and_value):
    """A group's values as a list in their order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order_and_value))), lambda s: s["node"])


@query("sc18_pull_requests", DQ.PULLS)
def _(spark, sf):
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    checks = F.when(k % 4 < 3, F.struct(pick(k, "SUCCESS", "FAILURE", "PENDING", "").alias("state")))
    node = F.struct((k % 400).alias("number"), F.lit("t").alias("title"), F.lit(False).alias("isDraft"), pick(c, "APPROVED", "CHANGES_REQUESTED", "REVIEW_REQUIRED").alias("reviewDecision"), F.struct(F.concat(F.lit("r"), (c % 9).cast("string")).alias("nameWithOwner"), (k % 5 == 0).alias("isFork")).alias("repository"), F.struct(F.array(F.struct(F.struct(checks.alias("statusCheckRollup")).alias("commit"))).alias("nodes")).alias("commits"))
    rows = o.select(F.floor(k / 100).cast("long").alias("ord"), k.alias("place"), pick(k, "owned", "review", "authored").alias("set"), node.alias("node"))
    nodes = rows.groupBy("ord", "set").agg(listed("place", "node").alias("nodes")).groupBy("ord").agg(*[F.max(F.when(F.col("set") == s, F.struct("nodes"))).alias(s) for s in A.DIMENSIONS])
    docs = nodes.select("ord", F.to_json(F.struct(F.struct(*A.DIMENSIONS).alias("data"))).alias("value"))
    broken = docs.select(F.col("ord"), F.substring("value", 1, 40).alias("value"))
    found = R.pull_requests(A.pull_request_documents(as_files(docs.unionByName(broken), "pulls")), limit=1 << 30)
    return found.select("repo", "number", "ci", "review", "role", C.ci_glyph(F.col("ci")).alias("glyph"), C.action_rank(F.col("ci"), F.col("review")).alias("rank"))


@query("sc18_branches", DQ.ORACLES["c5_branches"])
def _(spark, sf):
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.concat(F.lit("b"), k.cast("string"))
    pull = F.struct(k.cast("int").alias("number"), pick(k, "MERGED", "CLOSED", "OPEN", "").alias("state"))
    node = F.struct(name.alias("name"), F.struct(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("committedDate")).alias("target"), F.struct(F.when(k % 4 < 3, F.array(pull)).otherwise(F.array().cast("array<struct<number:int,state:string>>")).alias("nodes")).alias("associatedPullRequests"))
    # a repository comes in several documents, one a page; the branch whose number ends in 0 is a default branch of its own entry
    rows = o.select((c % 9).alias("r"), F.floor(k / PAGE).alias("page"), F.when(k % 10 == 0, k).otherwise(-1 - k % 7).alias("part"), k.alias("place"), name.alias("name"), node.alias("node"))
    repos = rows.groupBy("r", "page", "part").agg(listed("place", "node").alias("nodes"), F.min("name").alias("first"))
    main = F.struct(F.when(F.col("part") >= 0, F.col("first")).otherwise("main").alias("name"))
    repo = F.struct(F.concat(F.lit("r"), F.col("r").cast("string")).alias("nameWithOwner"), (F.col("r") == 4).alias("isArchived"), main.alias("defaultBranchRef"), F.struct("nodes").alias("refs"))
    docs = repos.select("r", "page", repo.alias("repo")).groupBy("r", "page").agg(F.collect_list("repo").alias("nodes")).select("r", F.to_json(F.struct(F.struct(F.struct(F.struct("nodes").alias("repositories")).alias("repositoryOwner")).alias("data"))).alias("value"))
    out = R.branches(A.branch_documents(as_files(docs, "branches")), F.lit(DQ.NOW).cast("timestamp"))
    return out.withColumn("deletable", C.deletable(F.col("branch"), F.col("status"), "closed"))


@query("sc18_runs", DQ.ORACLES["d16_ci_latest"])
def _(spark, sf):
    r = DQ.runs(spark, sf)
    node = F.struct(F.col("id").alias("databaseId"), "status", "conclusion", F.col("created").alias("createdAt"))
    lists = r.where("id % 5 > 0").groupBy("pkg", F.floor(F.col("id") / PAGE).alias("page")).agg(F.to_json(listed("id", node.alias("node"))).alias("value")).drop("page")
    single = r.where("id % 5 = 0").select("pkg", F.to_json(node).alias("value"))
    return R.ci_latest(A.run_documents(as_files(lists.unionByName(single), "runs"))).select("pkg", "id", "status", "conclusion", "created")


@query("sc17_versions", DQ.ORACLES["a23_latest_stable"])
def _(spark, sf):
    v = DQ.versions(spark, sf).groupBy("name", F.floor(F.col("ord") / PAGE).alias("page")).agg(listed("ord", F.struct("version").alias("node")).alias("listed"))
    other = F.array(F.struct(F.lit("999.0").alias("version")))
    docs = v.select("name", "page", F.to_json(F.struct(F.map_from_arrays(F.array(F.lit("other/package"), F.col("name")), F.array(other, F.col("listed"))).alias("packages"))).alias("value"))
    return R.latest_stable(A.registry_documents(as_files(docs, "registry")))


@query("sc16_tags", """SELECT 'd' || s_suppkey AS dir, 'v1.' || (s_suppkey % 7) || '.0' AS local_tag, CASE WHEN s_suppkey % 4 = 0 THEN '?' WHEN s_suppkey % 7 <= s_suppkey % 5 THEN 'yes' ELSE 'no' END AS pushed FROM supplier WHERE s_suppkey % 6 <> 0""")
def _(spark, sf):
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    folder = F.concat(F.lit("d"), k.cast("string")).alias("dir")
    described = s.select(folder, F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("v1."), (k % 7).cast("string"), F.lit(".0\n"))).alias("line"))
    each = s.where(k % 4 != 0).select(folder, F.explode(F.sequence(F.lit(0), k % 5)).alias("n"))
    end = F.when(F.col("n") % 2 == 0, "^{}").otherwise("")
    remote = each.select("dir", F.concat(F.lit("abc\trefs/tags/v1."), F.col("n").cast("string"), F.lit(".0"), end).alias("line")).unionByName(s.where(k % 4 != 0).select(folder, F.lit("").alias("line")))
    return A.tag_listings(described, remote)
