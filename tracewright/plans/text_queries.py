"""Queries of the text-search operators over the documents table, with their SQL.

Documents stand in for files. The SQL counts and slices text in its own way (RE2, no look-behind), so
whole words are found by doubling the characters that may stand between them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import classify as C
from tracewright.functions import dialect as D
from tracewright.functions import scalars as S
from tracewright.operators import search as T
from tracewright.sources.files import pruned, split_text
from tracewright.sources.stand_ins import files, table

WORDS = ["the", "und", "la", "zzzz"]
LAYERS = [("front", ["src1/**", "src2/en/*"]), ("core", ["src[3-5]/*/*.php", "src?/de/**"]), ("docs", ["**/*.txt"])]
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


FILES = """WITH files AS (SELECT source || '/' || lang || '/' || doc_id || (['.php', '.ts', '.ini', '.html', '.go', '.txt'])[doc_id % 6 + 1] AS path, (['.php', '.ts', '.ini', '.html', '.go', '.txt'])[doc_id % 6 + 1] AS ext, coalesce(text, '') AS content FROM documents),
cut AS (SELECT path, ext, CASE WHEN content = '' THEN [] WHEN ends_with(content, chr(10)) THEN string_split(content[:-2], chr(10)) ELSE string_split(content, chr(10)) END AS parts FROM files),
lines AS (SELECT path, ext, CAST(i AS INTEGER) AS line, regexp_replace(parts[i], '\\r$', '') AS text FROM (SELECT path, ext, parts, unnest(range(1, len(parts) + 1)) AS i FROM cut))
"""


@query("t1_lines", FILES + "SELECT path, line, strlen(text) AS bytes, length(text) AS chars FROM lines")
def _(spark, sf):
    return T.lines(files(spark, sf)).select("path", "line", F.octet_length("text").cast("long").alias("bytes"), F.length("text").cast("long").alias("chars"))


HITS = """, pats AS (SELECT unnest([{pats}]) AS pattern), pieces AS (SELECT pattern, path, line, {text} AS text, string_split({text}, pattern) AS p FROM lines, pats WHERE contains({text}, pattern)),
hits AS (SELECT pattern, path AS file, line, CAST(list_sum(list_transform(p[:k], lambda x: strlen(x))) + (k - 1) * strlen(pattern) AS INTEGER) AS col FROM (SELECT *, unnest(range(1, len(p))) AS k FROM pieces))
"""


@query("t2_literal", FILES + HITS.format(pats="'the', 'und', 'la', 'zzzz'", text="text") + "SELECT * FROM hits")
def _(spark, sf):
    return T.hits(T.lines(files(spark, sf)), WORDS).select("pattern", F.col("path").alias("file"), "line", "col")


@query("t3_ignore_case", FILES + HITS.format(pats="'the', 'ción'", text="lower(text)") + "SELECT * FROM hits")
def _(spark, sf):
    return T.hits(T.lines(files(spark, sf)), ["THE", "Ción"], ignore_case=True).select(F.lower("pattern").alias("pattern"), F.col("path").alias("file"), "line", "col")


WORD_COUNT = r"len(regexp_extract_all(regexp_replace(' ' || text || ' ', '([^\p{{L}}\p{{Nd}}_])', '\1\1', 'g'), '[^\p{{L}}\p{{Nd}}_]{w}[^\p{{L}}\p{{Nd}}_]'))"
WORD_SQL = " UNION ALL ".join(f"SELECT '{w}' AS pattern, path AS file, line, {WORD_COUNT.format(w=w)} AS n FROM lines" for w in ("the", "und", "la"))


@query("t4_whole_word", FILES + f"SELECT * FROM ({WORD_SQL}) WHERE n > 0")
def _(spark, sf):
    return T.hits(T.lines(files(spark, sf)), WORDS, word=True).groupBy("pattern", F.col("path").alias("file"), "line").agg(F.count("*").alias("n"))


@query("t5_regex", FILES + r"SELECT path AS file, line, len(regexp_extract_all(text, 'th[a-z]+ (of|in)')) AS n FROM lines WHERE regexp_matches(text, 'th[a-z]+ (of|in)')")
def _(spark, sf):
    return T.hits(T.lines(files(spark, sf)), ["th[a-z]+ (of|in)"], regex=True).groupBy(F.col("path").alias("file"), "line").agg(F.count("*").alias("n"))


@query("t6_regex_ignore_case", FILES + r"SELECT path AS file, line, len(regexp_extract_all(text, '(?i)ÜB|ción$')) AS n FROM lines WHERE regexp_matches(text, '(?i)ÜB|ción$')")
def _(spark, sf):
    return T.hits(T.lines(files(spark, sf)), ["ÜB|ción$"], regex=True, ignore_case=True).groupBy(F.col("path").alias("file"), "line").agg(F.count("*").alias("n"))


SCOPES = {
    "('.php')": (C.SCOPES[0][1], "' '"),
    "('.ts', '.tsx', '.js', '.vue')": (C.SCOPES[1][1], "' '"),
    "('.html', '.twig', '.tpl')": (C.SCOPES[2][1], "' '"),
}
LABEL = "CASE " + " ".join(f"WHEN ext IN {e} AND regexp_matches(text, '{p}') THEN regexp_extract(text, '{p}', 1) || ' ' || regexp_extract(text, '{p}', 2)" for e, (p, _) in SCOPES.items()) + f" WHEN ext = '.ini' AND regexp_matches(text, '{C.INI}') THEN '[' || regexp_extract(text, '{C.INI}', 1) || ']' END"


def seeded(spark, sf):
    """Lines with a declaration put on every seventh, so that scopes occur."""
    word = F.regexp_extract("text", "([A-Za-z]+)", 1)
    ext = F.col("ext")
    opened = F.when(ext == ".php", F.concat(F.lit("public function "), word)).when(ext == ".ts", F.concat(F.lit("export class "), word)).when(ext == ".ini", F.concat(F.lit("["), word, F.lit("]"))).when(ext == ".html", F.concat(F.lit("{% block "), word)).otherwise(F.col("text"))
    return T.lines(files(spark, sf)).withColumn("text", F.when((F.col("line") % 7 == 1) & (word != ""), opened).otherwise(F.col("text")))


SEEDED = """, seeded AS (SELECT path, ext, line, CASE WHEN line % 7 = 1 AND w <> '' THEN CASE ext WHEN '.php' THEN 'public function ' || w WHEN '.ts' THEN 'export class ' || w WHEN '.ini' THEN '[' || w || ']' WHEN '.html' THEN '{% block ' || w ELSE text END ELSE text END AS text
FROM (SELECT *, regexp_extract(text, '([A-Za-z]+)', 1) AS w FROM lines))"""


@query("j5_enclosing", FILES + SEEDED + f"SELECT path, line, coalesce(last_value(label IGNORE NULLS) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS enclosing FROM (SELECT *, {LABEL} AS label FROM seeded)")
def _(spark, sf):
    return T.enclosing(seeded(spark, sf)).select("path", "line", "enclosing")


@query("t9_grep", FILES + HITS.format(pats="'the', 'und', 'la', 'zzzz'", text="text") + f", named AS (SELECT path AS file, line, coalesce(last_value(label IGNORE NULLS) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS enclosing FROM (SELECT *, {LABEL} AS label FROM lines)) SELECT * FROM hits JOIN named USING (file, line)")
def _(spark, sf):
    return T.grep(files(spark, sf), WORDS)["hits"].select("pattern", "file", "line", "col", "enclosing")


@query("a20_per_pattern", FILES + HITS.format(pats="'the', 'und', 'la', 'zzzz'", text="text") + "SELECT pattern, count(DISTINCT file) AS files, count(*) AS hits FROM hits GROUP BY pattern")
def _(spark, sf):
    return T.grep(files(spark, sf), WORDS)["patterns"]


@query("u3_empty_patterns", "SELECT 'zzzz' AS pattern")
def _(spark, sf):
    return T.grep(files(spark, sf), WORDS)["empty"]


TOKENS = r"(strlen(regexp_replace({t}, '[^\x00-\x7F]', '', 'g')) / 4.0 + length(regexp_replace({t}, '[\x00-\x7F]', '', 'g')))"


@query("a24_raw_cost", FILES + HITS.format(pats="'the', 'und', 'la', 'zzzz'", text="text") + ", h AS (SELECT file || ':' || line || ':' || text || chr(10) AS s FROM hits JOIN (SELECT path AS file, line, text FROM lines) USING (file, line)) SELECT CAST(floor(sum(" + TOKENS.format(t="s") + ") + 0.5) AS BIGINT) AS raw_tokens FROM h")
def _(spark, sf):
    return T.grep(files(spark, sf), WORDS)["raw"]


@query("l1_capped", FILES + HITS.format(pats="'the', 'und', 'la', 'zzzz'", text="text") + "SELECT pattern, file, line, col, greatest(n - 30, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY file, line, col) AS k, count(*) OVER (PARTITION BY pattern) AS n FROM hits) WHERE k <= 30")
def _(spark, sf):
    return T.capped(T.grep(files(spark, sf), WORDS)["hits"]).select("pattern", "file", "line", "col", "more")


@query("sc8_pruned_tree", FILES + "SELECT path, ext FROM files WHERE ext IN ('.php', '.ts') AND NOT regexp_matches(path, '(^|/)(de|src3)/') AND NOT starts_with(path, 'src1/en/')")
def _(spark, sf):
    return pruned(files(spark, sf).drop("ext"), [".PHP", ".ts"], ["de", "src3"], ["src1/en"]).select("path", "ext")


@query("sc9_skipped", "SELECT count(*) FILTER (doc_id % 10 <> 0) AS readable, count(*) FILTER (doc_id % 10 = 0) AS skipped FROM documents")
def _(spark, sf):
    marked = files(spark, sf).withColumn("content", F.when(F.regexp_extract("path", r"(\d+)\.", 1).cast("long") % 10 == 0, F.concat(F.lit("\0"), F.col("content"))).otherwise(F.col("content")))
    good, bad = split_text(marked)
    return good.agg(F.count("*").alias("readable")).crossJoin(bad.agg(F.count("*").alias("skipped")))


@query("t8_ref_kind", FILES + SEEDED + r"""SELECT path AS file, line, CASE WHEN ext = '.php' AND regexp_matches(text, '\b(function|class|interface|trait|enum|const)\s+The\b') THEN 'def' WHEN ext = '.ts' AND regexp_matches(text, '\b(export\s+)?(default\s+)?(async\s+)?(function|class|interface|type|enum|const|let)\s+The\b') THEN 'def' ELSE 'use' END AS kind FROM seeded WHERE regexp_matches(text, '\bThe\b')""")
def _(spark, sf):
    rows = seeded(spark, sf).where(F.col("text").rlike(r"\bThe\b"))
    return rows.select(F.col("path").alias("file"), "line", C.ref_kind("The", F.col("text"), F.col("ext")).alias("kind"))


REFS = FILES + ", r AS (SELECT path AS file, line, unnest(range(" + WORD_COUNT.format(w="the") + ")) AS k FROM lines WHERE ext IN ('.php', '.ts', '.go'))"


@query("a21_ref_totals", REFS + " SELECT CAST(0 AS BIGINT) AS defs, count(*) AS uses FROM r")
def _(spark, sf):
    return T.ref_totals(T.refs(files(spark, sf), "the"))


@query("t10_refs", REFS + " SELECT file, line, count(*) AS n FROM r GROUP BY ALL")
def _(spark, sf):
    return T.refs(files(spark, sf), "the").groupBy("file", "line").agg(F.count("*").alias("n"))


LAYER = "CASE WHEN regexp_matches(path, '^src1/') OR regexp_matches(path, '^src2/en/[^/]*$') THEN 'front' WHEN regexp_matches(path, '^src[3-5]/[^/]*/[^/]*\\.php$') OR regexp_matches(path, '^src[^/]/de(/.*)?$') THEN 'core' WHEN regexp_matches(path, '\\.txt$') THEN 'docs' ELSE '(unclassified)' END"


@query("j7_layers", FILES + f"SELECT path, {LAYER} AS layer FROM files")
def _(spark, sf):
    return files(spark, sf).select("path", D.layer_of(F.concat(F.lit("./"), "path"), LAYERS).alias("layer"))


@query("t11_layer_counts", FILES + f"SELECT {LAYER} AS layer, count(*) AS files FROM files GROUP BY 1")
def _(spark, sf):
    return T.layer_counts(files(spark, sf), LAYERS)


@query("t11_layered_grep", FILES + HITS.format(pats="'the'", text="text") + f"SELECT {LAYER} AS layer, count(*) AS hits FROM (SELECT file AS path FROM hits) GROUP BY 1")
def _(spark, sf):
    return T.by_layer(T.grep(files(spark, sf), ["the"])["hits"], LAYERS).groupBy("layer").agg(F.count("*").alias("hits"))


@query("n1_tokens", "SELECT doc_id, CAST(floor(" + TOKENS.format(t="coalesce(text, '')") + " + 0.5) AS BIGINT) AS tokens FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.tokens(F.col("text")).alias("tokens"))


@query("sk8_metered", "SELECT source, CAST(sum(floor(" + TOKENS.format(t="text") + " + 0.5)) AS BIGINT) AS each_rounded, CAST(floor(sum(" + TOKENS.format(t="text") + ") + 0.5) AS BIGINT) AS once_rounded FROM documents GROUP BY source")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.sum(S.tokens(F.col("text"))).alias("each_rounded"), S.raw_tokens(F.col("text")).alias("once_rounded"))


@query("n2_edit_distance", "SELECT p_partkey, levenshtein(p_name, p_brand) AS d FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.levenshtein("p_name", "p_brand").cast("long").alias("d"))


QUOTED = """'"' || replace(replace(replace(t, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '"'"""


@query("n6_toon", "SELECT doc_id, CASE WHEN t = '' THEN '\"\"' WHEN regexp_matches(t, '[,:\"\\\\\\n\\r\\t\\[\\]{}]|^[ \\t]|[ \\t]$') THEN " + QUOTED + " ELSE t END AS toon FROM (SELECT doc_id, text AS t FROM documents)")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.toon(F.col("text")).alias("toon"))


@query("n23_collapse", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(S.collapse(F.col("text"))).alias("digest"))


@query("t13_cut_bytes", "SELECT doc_id, CASE WHEN strlen(text) <= 200 THEN text ELSE (SELECT max(left(text, k)) FROM (SELECT unnest(range(100, 200)) AS k) WHERE strlen(left(text, k)) <= 199) || '…' END AS text FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.cut_bytes(F.col("text"), 200).alias("text"))
