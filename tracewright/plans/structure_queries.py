"""Queries of the structure operators: a small source file is made from every row of a table, so that SQL knows its declarations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import structure as X
from tracewright.sources.stand_ins import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


GO = 'package p{}\n\nimport m "math"\n\n// doc\ntype T{} struct {{\n\tA int // a\n\tb string\n}}\n\nfunc (t *T{}) Get(a, b int) (int, error) {{\n\treturn a, nil // }}\n}}\n\nconst c{} int = 3\n'
PHP = '<?php\nnamespace App;\nuse Foo\\Bar as B;\nfinal class C{} extends Base\n{{\n    use Tr;\n    private int $p = 1;\n    public function __construct(private B $b) {{}}\n    public function run{}(int $a): string {{ return "}}"; }}\n    private function no() {{}}\n}}\n'
PYTHON = 'import os\n\nX{}: int = 3\n\n@deco\nclass K{}(Base):\n    """def no(): pass"""\n\n    def get(self,\n            a=1) -> int:\n        def inner(): pass\n        return 1\n\n    def _hid(self): ...\n'
VUE = "<template><Foo /></template>\n<script setup lang=\"ts\">\nimport Foo from './Foo.vue'\nconst props = defineProps<{{ a{}: string }}>()\nexport interface P{} {{ x: number; y?: string }}\n</script>\n"
ROUTES = "import Home from './Home.vue'\nconst routes = [\n  {{ path: '/r{}', name: 'n{}', component: Home, children: [ {{ path: 'kid', name: 'k', component: () => import('@/views/Kid.vue') }}, {{ path: '', name: 'same' }} ] }},\n]\n"


def made(spark, sf, template: str, ext: str):
    d = table(spark, sf, "documents")
    parts = template.replace("{{", "\0").replace("}}", "\1").split("{}")
    parts = [p.replace("\0", "{").replace("\1", "}") for p in parts]
    k = F.col("doc_id").cast("string")
    text = F.concat(*[c for p in parts for c in (F.lit(p), k)][:-1])
    return d.select(F.concat(F.lit("f"), k, F.lit(ext)).alias("path"), F.lit(ext).alias("ext"), text.alias("content"))


def rows(ext: str, *decls: tuple) -> str:
    """SQL of the declarations of every file: (kind, owner, name, detail, exported, first line, last line), with {} for the id."""
    text = lambda s: "'" + s.replace("'", "''").replace("{}", "' || doc_id || '") + "'"
    each = [f"SELECT 'f' || doc_id || '{ext}' AS path, {text(k)} AS kind, {text(o)} AS owner, {text(n)} AS name, {text(d)} AS detail, {str(x).lower()} AS exported, CAST({a} AS INTEGER) AS start_line, CAST({b} AS INTEGER) AS end_line FROM documents" for k, o, n, d, x, a, b in decls]
    return " UNION ALL ".join(each)


COLUMNS = ("path", "kind", "owner", "name", "detail", "exported", "start_line", "end_line")
GO_ROWS = rows(".go", ("package", "", "p{}", "", False, 1, 1), ("import", "", "math", "m", False, 3, 3), ("struct", "", "T{}", "A int; b string", True, 6, 9), ("func", "*T{}", "Get", "(a, b int) (int, error)", True, 11, 13), ("const", "", "c{}", "int", False, 15, 15))


@query("x1_go", GO_ROWS)
def _(spark, sf):
    return X.declarations(made(spark, sf, GO, ".go")).select(*COLUMNS)


@query("x2_go_spans", "SELECT 'f' || doc_id || '.go' AS path, CAST(unnest([6, 11, 15]) AS INTEGER) AS start_line, CAST(unnest([9, 13, 15]) AS INTEGER) AS end_line, unnest(['type T' || doc_id, 'func T' || doc_id || '.Get', 'const c' || doc_id]) AS label FROM documents")
def _(spark, sf):
    return X.go_spans(X.declarations(made(spark, sf, GO, ".go"))).select("path", "start_line", "end_line", "label")


@query("x3_go_slice", "SELECT 'f' || doc_id || '.go' AS path, 'Get' AS symbol, CAST(11 AS INTEGER) AS start_line, 'func (t *T' || doc_id || ') Get(a, b int) (int, error) {' || chr(10) || chr(9) || 'return a, nil // }' || chr(10) || '}' AS text FROM documents")
def _(spark, sf):
    f = made(spark, sf, GO, ".go")
    return X.slices(f, X.declarations(f), ["Get", "Nowhere"]).select("path", "symbol", "start_line", "text")


@query("x4_php", rows(".php", ("namespace", "", "App", "", True, 2, 2), ("use", "", "Foo\\Bar", "B", True, 3, 3), ("class", "", "C{}", "final extends Base", True, 4, 11), ("uses", "C{}", "Tr", "", True, 6, 6), ("property", "C{}", "p", "int", False, 7, 7), ("ctor", "C{}", "b", "B", True, 8, 8), ("method", "C{}", "run{}", "(int $a): string", True, 9, 9)))
def _(spark, sf):
    return X.declarations(made(spark, sf, PHP, ".php")).select(*COLUMNS)


PY_ROWS = rows(".py", ("import", "", "os", "", True, 1, 1), ("var", "", "X{}", "int", True, 3, 3), ("class", "", "K{}", "Base", True, 6, 14), ("func", "K{}", "get", "(self, a=1) -> int", True, 9, 12), ("func", "K{}", "_hid", "(self)", False, 14, 14))


@query("x9_python", PY_ROWS)
def _(spark, sf):
    return X.declarations(made(spark, sf, PYTHON, ".py")).select(*COLUMNS)


@query("f9_exported_brief", f"SELECT path, kind, name, CASE WHEN kind = 'var' THEN '' ELSE detail END AS detail FROM ({PY_ROWS}) WHERE exported")
def _(spark, sf):
    return X.brief(X.exported(X.declarations(made(spark, sf, PYTHON, ".py")))).select("path", "kind", "name", "detail")


@query("x10_python_slice", "SELECT 'f' || doc_id || '.py' AS path, CAST(5 AS INTEGER) AS start_line, CAST(14 AS INTEGER) AS end_line FROM documents")
def _(spark, sf):
    f = made(spark, sf, PYTHON.replace("K{}", "K"), ".py")
    return X.slices(f, X.declarations(f), ["K"]).select("path", "start_line", "end_line")


@query("x11_vue", rows(".vue", ("import", "", "./Foo.vue", "Foo", True, 3, 3), ("const", "", "props", "", False, 4, 4), ("interface", "", "P{}", "x, y?", True, 5, 5), ("props", "", "a{}", "", True, 4, 4), ("component", "", "Foo", "", True, 0, 0)))
def _(spark, sf):
    return X.declarations(made(spark, sf, VUE, ".vue")).select(*COLUMNS)


@query("x12_routes", "SELECT 'f' || doc_id || '.ts' AS path, CAST(unnest([0, 1, 2]) AS INTEGER) AS ord, '/r' || doc_id || unnest(['', '/kid', '']) AS route, unnest(['n' || doc_id, 'k', 'same']) AS name, unnest(['Home', 'Kid', '']) AS component FROM documents")
def _(spark, sf):
    return X.routes(made(spark, sf, ROUTES, ".ts")).select("path", "ord", "route", "name", "component")


@query("a27_counts", "SELECT 'f' || doc_id || '.go' AS path, unnest(['package', 'import', 'struct', 'func', 'const']) AS kind, CAST(1 AS BIGINT) AS n FROM documents")
def _(spark, sf):
    return X.counts(X.declarations(made(spark, sf, GO, ".go")))


@query("x13_summaries", "SELECT 'f' || doc_id || '.go' AS path, CAST(5 AS BIGINT) AS n_lines FROM documents")
def _(spark, sf):
    f = made(spark, sf, GO, ".go")
    return X.summaries(f, X.declarations(f), floor=0).select("path", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


@query("j6_innermost", "SELECT 'f' || doc_id || '.go' AS file, 'func T' || doc_id || '.Get' AS enclosing FROM documents")
def _(spark, sf):
    from tracewright.operators.search import innermost

    f = made(spark, sf, GO, ".go")
    hits = f.select("path", "ext", F.lit(12).alias("line"), F.lit(1).alias("col"), F.lit("").alias("enclosing"))
    return innermost(hits, X.go_spans(X.declarations(f))).select(F.col("path").alias("file"), "enclosing")


@query("j10_effective_api", "SELECT 'c' || s_suppkey AS root, unnest(['own', 'shared', 'ta', 'tb', 'deep', 'base', 'grand']) AS method, unnest(['', '', 'a', 'b', 'c', 'p', 'g']) AS via FROM supplier")
def _(spark, sf):
    s = table(spark, sf, "supplier").select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("type"))
    links = s.select("type", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("target"), F.lit(o).alias("ord")) for k, t, o in (("uses", "a", 0), ("uses", "b", 1), ("extends", "p", 0))])).alias("l")).select("type", "l.*")
    links = links.unionByName(spark.createDataFrame([("b", "uses", "c", 0), ("p", "extends", "g", 0), ("c", "uses", "b", 0)], links.schema))
    own = s.select("type", F.explode(F.array(F.struct(F.lit("own").alias("name"), F.lit(0).alias("ord")), F.struct(F.lit("shared").alias("name"), F.lit(1).alias("ord")))).alias("m")).select("type", "m.name", "m.ord")
    more = spark.createDataFrame([("a", "shared", 0), ("a", "ta", 1), ("b", "tb", 0), ("c", "deep", 0), ("p", "base", 0), ("p", "ta", 1), ("g", "grand", 0)], own.schema)
    return X.effective_api(s, links, own.unionByName(more)).select("root", "method", "via")


@query("j11_psr4", "SELECT 'App\\' || CASE WHEN p_partkey % 2 = 0 THEN 'Sub\\' ELSE '' END || 'C' || p_partkey AS fqcn, CASE WHEN p_partkey % 2 = 0 THEN 'lib/sub/' ELSE 'src/' END || 'C' || p_partkey || '.php' AS path FROM part")
def _(spark, sf):
    name = F.concat(F.lit("App\\"), F.when(F.col("p_partkey") % 2 == 0, "Sub\\").otherwise(""), F.lit("C"), F.col("p_partkey").cast("string"))
    prefixes = spark.createDataFrame([("App\\", "src"), ("App\\Sub\\", "lib/sub/")], "prefix string, dir string")
    return X.psr4_path(table(spark, sf, "part").select(name.alias("fqcn")), prefixes)
