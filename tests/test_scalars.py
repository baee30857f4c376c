import pytest
from pyspark.sql import functions as F

from tracewright.functions import classify as C
from tracewright.functions import scalars as S
from tracewright.functions import render as R


def values(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def lit(x):
    return F.lit(x)


def test_tokens(spark):
    assert values(spark, *[S.tokens(lit(t)) for t in ("", "abcd", "abcdef", "привет", "a😀", None, "ab")]) == (0, 1, 2, 6, 1, 0, 1)


def test_distances(spark):
    assert values(spark, *[S.nearest(lit(w), ["status", "show", "Stat"]) for w in ("statsu", "shwo", "zzzzzz", "STAT")]) == ("status", "show", None, "Stat")


def test_identity(spark):
    args = lambda *a: F.array(*[lit(x) for x in a])
    a, b, c, d = values(spark, S.fingerprint(args("x", "y")), S.fingerprint(args("y", "x")), S.fingerprint(args("x")), S.dedup_key(lit("t"), args("x")))
    assert a == b != c and len(a) == 16 and d not in (a, c)
    assert values(spark, S.short_id(lit("abc-def")), S.short_id(lit("0123456789")), S.project_of_dir(lit("-home-me-app")), S.relative(lit("/a/b/c"), lit("/a")), S.relative(lit("/ab/c"), lit("/a")), S.safe_session(lit("a/b c"))) == ("abc", "01234567", "app", "b/c", "/ab/c", "a_b_c")


def test_times(spark):
    ok = values(spark, *[S.strict_time(lit(t)).isNotNull() for t in ("2026-05-21T01:02:03Z", "2026-05-21T01:02:03.5+02:00", "2026-05-21", "2026-05-21 01:02:03", "x")])
    assert ok == (True, True, False, False, False)
    now = lit("2026-06-14 00:00:00").cast("timestamp")
    assert values(spark, S.age_days(lit("2026-06-01 01:00:00").cast("timestamp"), now), S.age_days(lit(None).cast("timestamp"), now)) == (12, -1)
    assert S.parse_bucket("H") == "hour" and S.parse_bucket("Day") == "day"
    with pytest.raises(ValueError):
        S.parse_bucket("week")


@pytest.mark.parametrize(("a", "b", "want"), [("12.6.0", "12.6", 0), ("v1.2", "1.2", 0), ("1.10", "1.9", 1), ("1.0-beta", "1.0", 0), ("1.x", "1.1", -1), ("2", "10", -1), ("1.2+m", "1.2", 0)])
def test_versions(spark, a, b, want):
    assert values(spark, S.version_compare(lit(a), lit(b)), S.version_compare(lit(b), lit(a))) == (want, -want)


def test_protocols(spark):
    assert values(spark, *[S.compatible(lit("2.1"), lit(p)) for p in ("2.0", "2.2", "1.9", "0.9", "3", "x")]) == ("ok", "too-new", "ok", "too-old", "too-new", "invalid")
    assert values(spark, S.is_release_tag(lit("v1.2.3-rc.1")), S.is_release_tag(lit("1.2"))) == (True, False)


def test_diff_text(spark):
    assert values(spark, *[S.renamed_to(lit(p)) for p in ("a/{b => c}/d", "a/{ => x}/d", "a/{x => }/d", "old => new", "plain")]) == ("a/c/d", "a/x/d", "a/d", "new", "plain")
    assert values(spark, S.hunk_section(lit("@@ -1,2 +3 @@ func A()")), S.hunk_section(lit("@@ -1 +1 @@")), S.count_or_zero(lit("-")), S.count_or_zero(lit("7"))) == ("func A()", "", 0, 7)
    assert values(spark, *[S.route_path(lit(p), lit(c)) for p, c in (("/a", "b"), ("/a/", "b"), ("/a", "/b"), ("/a", ""), ("", ""))]) == ("/a/b", "/a/b", "/b", "/a", "/")


def test_json_probes(spark):
    doc = F.parse_json(lit('{"n": 7.9, "s": "7", "t": true, "u": "true", "l": ["a", 1, "b"]}'))
    assert values(spark, S.json_number(doc, "n"), S.json_number(doc, "s"), S.json_number(doc, "zz"), S.json_flag(doc, "t"), S.json_flag(doc, "u"), S.json_texts(doc, "l"), S.json_texts(doc, "n")) == (7, None, None, True, False, ["a", "b"], [])
    blocks = F.parse_json(lit('[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]'))
    assert values(spark, S.result_text(F.parse_json(lit('"x"'))), S.result_text(blocks), S.script_value(F.parse_json(lit('["a","b"]'))), S.script_value(F.parse_json(lit('"c"')))) == ("x", "a\nb\n", "a && b", "c")


def test_formats(spark):
    n = lambda f, *v: values(spark, *[f(lit(x)) for x in v])
    assert n(S.format_ms, 999, 1500) == ("999ms", "1.50s")
    assert n(S.format_bytes, 1023, 1280, 3 << 20) == ("1023B", "1.2KB", "3.0MB")
    assert n(S.format_k, 999, 1499, 1500, 182600) == ("999", "1K", "2K", "183K")
    assert n(S.format_duration, 0, 59, 3599, 3660) == ("0s", "59s", "59m", "1h1m")
    assert n(S.format_age, 59, 89, 90) == ("59s", "1m", "2m")
    assert n(S.format_size_k, 8192, 9000) == ("8K", "8.8K")


def test_compact_or_raw(spark):
    assert values(spark, S.smaller_of(lit("abcd"), lit("abcd")), S.smaller_of(lit("abcdefgh"), lit("a")), S.smaller_of(lit("abc"), lit(None).cast("string"))) == ("abcd", "a", "abc")
    assert values(spark, *[S.footer(lit(t), lit(r)) for t, r in ((10, 30), (30, 10), (5, 0))]) == ("# ≈10 tok · raw ≈30 · saved ≈20", "# ≈30 tok · raw passthrough", "# ≈5 tok")


def test_toon(spark):
    assert values(spark, *[S.toon(lit(t)) for t in ("", "plain text", " lead", "a,b", 'q"\\', "x\ny", "[1]", None)]) == ('""', "plain text", '" lead"', '"a,b"', '"q\\"\\\\"', '"x\\ny"', '"[1]"', '""')


def test_cut_bytes(spark):
    assert values(spark, S.cut_bytes(lit("abcdef"), 6), S.cut_bytes(lit("abcdefg"), 6), S.cut_bytes(lit("ééééé"), 6), S.collapse(lit(" a \n b c "))) == ("abcdef", "abcde…", "éé…", "a b c")


def test_render(spark):
    df = spark.createDataFrame([("a,b", 1, ["x", "y"]), (None, 2, [])], "name string, n int, l array<string>")
    assert R.render(df, "t") == 't[2]{name,n,l}:\n  "a,b",1,x y\n  "",2,""\n'
    assert R.render(df, "t", most=1).endswith("# +1 more\n") and R.render(df, "t", "md").startswith("| name | n | l |\n| --- |")
    assert '"name":"a,b"' in R.render(df, "t", "json", most=1) and R.render(df, "t", "json", most=1).count("{") == 2
    assert R.chosen_format(json=True) == "json" and R.chosen_format() == "toon"
    with pytest.raises(ValueError):
        R.chosen_format("md", json=True)


@pytest.mark.parametrize(("path", "category", "lang"), [("a_test.go", "test", "go"), ("x/FooTest.php", "test", "php"), ("a.spec.ts", "test", "ts"), ("db/migrations/1.sql", "migration", "sql"), ("docs/a.png", "docs", ""), ("README.md", "docs", ""), ("composer.json", "build", ""), ("Dockerfile.dev", "build", ""), ("config/x.php", "config", "php"), ("a.yaml", "config", ""), ("src/a.vue", "source", "vue"), ("logo.png", "other", "")])
def test_paths(spark, path, category, lang):
    assert values(spark, C.path_category(lit(path)), C.path_language(lit(path))) == (category, lang)


def test_people_and_guards(spark):
    assert values(spark, *[C.is_human(lit(t)) for t in ("hi", "  ", "<x>", "Caveat: y", "[Request interrupted", " API Error")]) == (True, False, False, False, False, False)
    assert values(spark, *[C.bare_cat(lit(c)) for c in ("cat a.go", "cat 'b.go'", "cat -n a", "cat a | head", "cat a b", "head a", "/bin/cat *.go")]) == ("a.go", "b.go", None, None, None, None, None)
    none = lit(None).cast("string")
    act = lambda mode, seen=False, size=9000, path="a.go", offset=0: C.guard_action(lit("Read"), lit(path), lit(offset), lit(0), none, lit(size), lit(seen), mode)
    assert values(spark, act("nudge"), act("nudge", True), act("off"), act("suggest"), act("strict", True), act("nudge", size=8191), act("nudge", path="a.py"), act("strict", offset=5)) == ("deny", "allow", "allow", "suggest", "deny", "allow", "allow", "allow")


def test_states(spark):
    s = lambda tag, pub: C.release_state(lit(tag), lit(pub), S.version_compare(lit(pub), lit(tag)))
    assert values(spark, s("", "1.0"), s("1.0", ""), s("1.0", "v1.0"), s("1.1", "1.0"), s("1.0", "1.1")) == ("no-tags", "unpublished", "in-sync", "needs-update", "local-stale")
    assert values(spark, *[C.is_stable(lit(v)) for v in ("1.0", "dev-main", "1.x-dev", "2.0-RC1", "1.0-alpha")]) == (True, False, False, False, False)
    assert values(spark, C.check_status(lit(True), lit("")), C.check_status(lit(True), lit("x")), C.check_status(lit(False), lit("x"))) == ("ok", "skip", "FAIL")
    assert values(spark, C.is_failing(lit("completed"), lit("failure")), C.is_failing(lit("completed"), lit("success")), C.is_failing(lit("queued"), lit("failure"))) == (True, False, False)
