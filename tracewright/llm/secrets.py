"""Secret scans: pattern spans, then the number of repositories and owners that hold each value."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm._common import bounded_batches, numbered, read, stash

#: Kinds of base spans in the order that breaks ties: pattern, group whose length counts, least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
#: Further shapes of credentials: public token prefixes, private key blocks and signed web tokens.
MORE = (
    ("prefixed", re.compile(r"(?:gh[pousr]_|github_pat_|xox[abprs]-|sk-|glpat-|npm_|AIza)[A-Za-z0-9_-]{16,}"), 0, 20),
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----"), 0, 40),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"), 0, 30),
)
KINDS = tuple(k for k, *_ in BASE + MORE)
#: A value in this many distinct repositories or owners is a widely copied example.
COPIED_REPOSITORIES = 4
COPIED_OWNERS = 4
#: Bits per character below which a value isn't live-looking.
LIVE_ENTROPY = 2.5

SCANNED = "row long, doc_id long, repository string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, candidates array<struct<kind:string,at:int,start:int,end:int,value:string,entropy:double>>"


def scan(text: str) -> list[tuple[str, int, int, int, str]]:
    """(kind, kind's place, start, end, value) of all spans in order of start, then kind; matches are leftmost and don't overlap within a kind."""
    out = []
    for at, (kind, pattern, group, least) in enumerate(BASE + MORE):
        if kind == "hex":  # the same maximal runs, found without visiting the short ones
            pattern = _HEX
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((kind, at, m.start(), m.end(), m.group(group)))
    return sorted(out, key=lambda s: (s[2], s[1]))


_HEX = re.compile(r"[0-9a-f]{32,}")


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def scanned(docs: DataFrame, repository: str, owner: str, row: Column | None = None) -> DataFrame:
    """One row per row of docs with its spans, numbered by row if given; values leave the scan only as SHA-256."""

    def run(batches):
        for b in batches:
            rows = []
            for row, doc_id, repo, own, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                spans = scan(text or "")
                base = [s for s in spans if s[1] < len(BASE)]
                n = Counter(s[0] for s in base)
                sha = hashlib.sha256(joined((k, s, e) for k, _, s, e, _ in base).encode()).hexdigest()
                found = [{"kind": k, "at": at, "start": s, "end": e, "value": hashlib.sha256(v.encode()).hexdigest(), "entropy": entropy(v)} for k, at, s, e, v in spans]
                rows.append({"row": row, "doc_id": doc_id, "repository": repo, "owner": own, "n_assign": n["assign"], "n_access": n["access"], "n_hex": n["hex"], "base_sha256": sha, "candidates": found})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    candidate = pa.struct([("kind", pa.string()), ("at", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("entropy", pa.float64())])
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("repository", pa.string()), ("owner", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("candidates", pa.list_(candidate))])
    lean = docs.select((F.monotonically_increasing_id() if row is None else row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"), F.col("text").cast("string").alias("text"))
    return lean.mapInArrow(run, SCANNED)


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_repositories, n_owners, n_spans) of every candidate value over the whole corpus.

    Spans are first summed per value, repository and owner, so a value that a third of the rows hold
    reaches the second step as one row for each of its owners.
    """
    spans = found.select("repository", "owner", F.explode("candidates").alias("c")).groupBy("c.value", "repository", "owner").agg(F.count("*").alias("n"))
    repositories = spans.groupBy("value", "repository").agg(F.sum("n").alias("n")).groupBy("value").agg(F.count("repository").alias("n_repositories"), F.sum("n").alias("n_spans"))
    owners = spans.groupBy("value", "owner").agg(F.lit(1).alias("one")).groupBy("value").agg(F.count("owner").alias("n_owners"))
    return repositories.join(owners, "value")


def secret_spans(docs: DataFrame, repository: str = "source", owner: str = "source", copied_repositories: int = COPIED_REPOSITORIES, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """One row per row of docs: counts and digest of the base spans, all spans, and which of them look live.

    A value that at least so many repositories or owners hold is an example that people copy; one held
    by fewer, and of at least LIVE_ENTROPY bits a character, looks live. spans_live and spans_copied
    list the two sorts; spans lists all. Null and empty texts have no spans (the digest is that of an
    empty string); a null repository or owner counts as none; repeated rows are each reported and count
    once for their owner; overlapping spans of different kinds all stay. No rows give no rows.
    """
    return _judged(docs, None, repository, owner, copied_repositories, copied_owners).drop("row")


def _judged(docs: DataFrame, row: Column | None, repository: str = "source", owner: str = "source", copied_repositories: int = COPIED_REPOSITORIES, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """secret_spans() with the number of each row."""
    bounded_batches(docs.sparkSession)
    found = stash(scanned(docs, repository, owner, row), "secrets")
    stats = ownership(found)
    each = found.where(F.size("candidates") > 0).select("row", F.explode("candidates").alias("c")).select("row", "c.*").join(stats, "value")
    copied = (F.col("n_repositories") >= copied_repositories) | (F.col("n_owners") >= copied_owners)
    live = ~copied & (F.col("entropy") >= LIVE_ENTROPY)
    each = each.select("row", F.struct("start", "at", "kind", "end", copied.alias("copied"), live.alias("live"), F.col("n_owners").cast("long").alias("n_owners")).alias("s"))
    judged = each.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("s"))

    def text(which) -> F.Column:
        return F.coalesce(F.array_join(F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","), F.lit(""))

    some = lambda field: F.filter("s", lambda s: s[field])
    return (
        found.drop("candidates", "repository", "owner")
        .join(judged, "row", "left")
        .select("row", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text(F.col("s")).alias("spans"), F.coalesce(F.size(some("live")), F.lit(0)).cast("long").alias("n_live"), F.coalesce(F.size(some("copied")), F.lit(0)).cast("long").alias("n_copied"), text(some("live")).alias("spans_live"), text(some("copied")).alias("spans_copied"))
    )


def redact(docs: DataFrame, mark: str = "[secret]", **params) -> DataFrame:
    """docs with every live-looking span replaced by mark; widely copied examples stay. n_chars, if there, follows.

    Overlapping spans are replaced as one. Rows without live spans, null texts among them, are untouched.
    Rows are numbered first, and texts meet the (few) spans of their own row, whatever their doc_id, in one join.
    Repeated rows are each treated, columns may have any names, and no rows give no rows. params are those of
    secret_spans(); repository and owner name columns of docs.
    """
    kept = [f"c{k}" for k in range(len(docs.columns))]
    of = dict(zip(docs.columns, kept, strict=True))
    rows = numbered(docs.toDF(*kept), "secrets-rows")
    named = {c: params.pop(c, "source") for c in ("repository", "owner")}
    lean = rows.select("_row", F.col(of["doc_id"]).alias("doc_id"), F.col(of["text"]).alias("text"), *[F.col(of[c]).alias(name) for name, c in named.items()])
    live = _judged(lean, F.col("_row"), "repository", "owner", **params).where("n_live > 0").select("row", "spans_live")

    def merge(batches):
        for b in batches:
            merged = []
            for spans in b.column(1).to_pylist():
                out: list[dict] = []
                for s, e in sorted((int(s), int(e)) for _, s, e in (x.split(":") for x in spans.split(","))):
                    if out and s < out[-1]["e"]:
                        out[-1]["e"] = max(out[-1]["e"], e)
                    else:
                        out.append({"s": s, "e": e})
                merged.append(out[::-1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(merged, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))], ["_id", "_cut"])

    cuts = stash(live.mapInArrow(merge, "_id long, _cut array<struct<s:int,e:int>>"), "secrets-live")
    both = rows.join(cuts, rows["_row"] == cuts["_id"], "left")
    text = F.aggregate("_cut", F.col(of["text"]), lambda t, x: F.concat(F.substring(t, F.lit(1), x["s"]), F.lit(mark), F.substring(t, x["e"] + 1, F.length(t))))
    new = {of["text"]: F.when(F.col("_cut").isNull(), F.col(of["text"])).otherwise(text)}
    if "n_chars" in of:
        new[of["n_chars"]] = F.when(F.col("_cut").isNull(), F.col(of["n_chars"])).otherwise(F.length(new[of["text"]]).cast(docs.schema["n_chars"].dataType))
    return both.select(*[new.get(c, F.col(c)).alias(c) for c in kept]).toDF(*docs.columns)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """secret_spans() of the whole documents table, source being repository and owner; nulls, empty texts, repeated rows and an empty table as there."""
    return secret_spans(read(spark, sf_dir, "documents", "doc_id", "source", "text"))
