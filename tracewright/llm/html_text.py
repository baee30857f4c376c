"""Main text of web pages: blocks by markup, and lines that the page of the nearest URL shares deleted."""

from __future__ import annotations

import html
import os
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm._common import bounded_batches, read, stash

#: Elements whose content is never text of the page, up to their end tag or the end of the page.
RAW = "script style noscript template textarea title iframe object svg canvas audio video select button xmp noframes noembed".split()
#: Elements without content.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a block of text where they start and where they end.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Blocks that may hold other blocks, so that where they end matters.
NESTED = BLOCK - set("p li dd dt h1 h2 h3 h4 h5 h6 hr tr td th tbody thead tfoot caption html body legend summary figcaption pre address".split())
#: Elements, roles and words of a class or id that mark what isn't the article.
BOILER = set("nav footer aside form menu dialog search fieldset head".split())
BOILER_ROLE = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
BOILER_WORD = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "notice cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist disqus respond reply replies "
    "widget toolbar pagination pager copyright skip".split()
)
#: Of those, the ones that count on an article or main element, too.
BOILER_ARTICLE = set("ad ads advert advertisement sponsored promo comment comments reply replies related".split())
#: Class or id values that mark the article where no article element does.
CONTENT = set("article article-body article-content articlebody content main-content maincontent post-content post-body post entry entry-content story story-body page-content body-content".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>"""
    + "|".join(RAW)
    + r""")\b(?:"[^"]*"|'[^']*'|[^>"'])*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^>"'])*)>|<[!?/][^>]*>|(?P<text>[^<]+|<)""",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
WORD = re.compile(r"[^a-z0-9]+")

#: What a block is: outside any marked part, boilerplate, in a main part, in an article.
OPEN, BOILERPLATE, MAIN, ARTICLE = 0, -1, 1, 2
#: A neighbour that has at least this part of both pages' open text in common is a near copy, not another page of the same template.
COPY = 0.8


def kind_of(tag: str, attrs: str, above: int) -> int:
    """What the blocks inside this element are, given what it stands in."""
    a = {k.lower(): html.unescape(v.strip("\"'")).lower() for k, v in ATTRIBUTE.findall(attrs)} if attrs.strip(" /\n") else {}
    if above == BOILERPLATE or tag in BOILER or a.get("role") in BOILER_ROLE or "hidden" in a or re.search(r"display\s*:\s*none", a.get("style", "")):
        return BOILERPLATE
    names = f"{a.get('class', '')} {a.get('id', '')}".split()
    words = {w for n in names for w in WORD.split(n)}
    if tag in ("article", "main", "body", "html"):
        if words & BOILER_ARTICLE and tag == "article":
            return BOILERPLATE
        return max(above, {"article": ARTICLE, "main": MAIN}.get(tag, above))
    if tag == "header" and above < ARTICLE or words & BOILER_WORD and not set(names) & CONTENT:
        return BOILERPLATE
    return max(above, MAIN) if set(names) & CONTENT or a.get("role") in ("main", "article") else above


def page_blocks(source: str) -> list[tuple[int, str]]:
    """(kind, text) of each block that has text, in page order, white space turned into single spaces."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    kind, held = OPEN, []

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((kind, text))

    for m in TOKEN.finditer(source):
        if m["text"] is not None:
            held.append(m["text"])
        elif m["tag"]:
            tag = m["tag"].lower()
            if tag == "br":
                held.append(" ")
            elif tag in BLOCK or tag == "hr":
                flush()
            if tag in VOID:
                continue
            if m["end"]:
                at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
                if at is not None:
                    flush()
                    del stack[at:]
                    kind = stack[-1][1] if stack else OPEN
            elif tag in NESTED or tag in ("html", "body"):
                kind = kind_of(tag, m["attrs"], kind)
                stack.append((tag, kind))
            elif m["attrs"].strip() and kind != BOILERPLATE and kind_of(tag, m["attrs"], kind) == BOILERPLATE:
                # a paragraph, list item or inline element that is marked itself
                flush()
                kind = BOILERPLATE
                stack.append((tag, kind))
    flush()
    return out


def host_path(url: str | None) -> tuple[str, str]:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^?#]*)", url or "")
    return (m[1].lower(), m[2] or "/") if m else ("", re.split(r"[?#]", url or "")[0])


def shared_lines(own: list[int], other: list[int]) -> list[int]:
    """Places in own of a longest common subsequence with other (Hunt and Szymanski's, after equal ends)."""
    low, n, m = 0, len(own), len(other)
    while low < min(n, m) and own[low] == other[low]:
        low += 1
    while n > low and m > low and own[n - 1] == other[m - 1]:
        n, m = n - 1, m - 1
    where: dict[int, list[int]] = {}
    for j in range(m - 1, low - 1, -1):
        where.setdefault(other[j], []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i in range(low, n):
        for j in where.get(own[i], ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            ends[k : k + 1], links[k : k + 1] = [j], [link]
    middle, at = [], links[-1] if links else None
    while at:
        middle.append(at[0])
        at = at[1]
    return [*range(low), *middle[::-1], *range(n, len(own))]


PARSED = "row long, page_id long, url string, host string, path string, kinds array<byte>, lines array<string>, level int"


def parsed(pages: DataFrame) -> DataFrame:
    """A row for each row of pages: its lines that aren't boilerplate by markup, with their kinds; level is that of the text."""

    def run(batches):
        for b in batches:
            out = []
            for row, page_id, url, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
                blocks = [x for x in page_blocks(source or "") if x[0] != BOILERPLATE]
                host, path = host_path(url)
                out.append((row, page_id, url, host, path, [k for k, _ in blocks], [t for _, t in blocks], max((k for k, _ in blocks), default=OPEN)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int8()), pa.list_(pa.string()), pa.int32()]
    names = [x.split()[0] for x in PARSED.split(", ")]
    lean = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return lean.mapInArrow(run, PARSED)


def neighbours(pages: DataFrame) -> DataFrame:
    """pages(row, host, path, lines, sizes) with the pages before and after each in (host, path) order, whatever host those are of.

    Rows are dealt by range, so a host of any size spreads over tasks; the first and last row of each
    range (two for each partition) carry the order over to the next.
    """
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["host", "path", "row"]
    ranged = pages.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    ranged = stash(ranged, "pages-ranged")
    page = F.struct("host", "path", "lines", "sizes")
    over = W.partitionBy("part").orderBy("at")
    ends = ranged.groupBy("part").agg(F.min_by(page, "at").alias("first"), F.max_by(page, "at").alias("last"))
    parts = W.orderBy("part")  # one row for each partition
    ends = ends.select("part", F.lag("last").over(parts).alias("before"), F.lead("first").over(parts).alias("after"))
    return ranged.withColumn("prev", F.lag(page).over(over)).withColumn("next", F.lead(page).over(over)).join(ends, "part").select("row", "host", "path", "lines", "sizes", F.coalesce("prev", "before").alias("prev"), F.coalesce("next", "after").alias("next"))


def template_lines(page: dict) -> tuple[list[int], list[int]]:
    """Places of the lines of a page that its neighbours show to be its template's, on a page that marks no article and inside a marked one.

    Inside a marked article they are those that it shares with both neighbours, neither a near copy, for of_most_pages() to confirm: a few pages may tell or quote the same.
    On a page without, they are those that it shares with the neighbour of the longer common path; on a tie, with the one that shares
    more characters, then with the earlier. If that one is a near copy, they are those that both neighbours
    share, unless both are near copies; with no other neighbour there are none.
    """
    found = []
    for x in (page["prev"], page["next"]):
        if x and x["host"] == page["host"]:
            at = shared_lines(page["lines"], x["lines"])
            size = sum(page["sizes"][k] for k in at)
            copy = size >= COPY * max(sum(page["sizes"]), sum(x["sizes"]))
            found.append((len(os.path.commonprefix([x["path"], page["path"]])), size, copy, at))
    if not found:
        return [], []
    both = sorted(set(found[0][3]) & set(found[1][3])) if len(found) == 2 else []
    inside = [] if any(f[2] for f in found) else both
    first = max(found, key=lambda f: f[:2])
    if not first[2]:
        return first[3], inside
    return ([] if all(f[2] for f in found) else both), inside


def shared_with_nearest(pages: DataFrame) -> DataFrame:
    """(row, shared, inside): places of the lines that each page shares with the pages of the nearest paths of its host (see template_lines).

    Pages of a host with the same lines count as one, at the first path of theirs, so that copies don't hide the other pages.
    """
    keyed = pages.withColumn("same", F.md5(F.concat_ws(",", "host", F.col("lines").cast("array<string>"))))
    firsts = keyed.groupBy("same").agg(F.min(F.struct("path", "row", "host", "lines", "sizes")).alias("x")).select("x.row", "x.host", "x.path", "x.lines", "x.sizes", "same")

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            shared, inside = zip(*map(template_lines, rows), strict=True) if rows else ((), ())
            held = [[r["lines"][k] for k in at] for r, at in zip(rows, inside, strict=True)]
            columns = [pa.array([r["row"] for r in rows], pa.int64()), pa.array([r["host"] for r in rows], pa.string()), pa.array(shared, pa.list_(pa.int32())), pa.array(inside, pa.list_(pa.int32())), pa.array(held, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "host", "shared", "inside", "held"])

    firsts = stash(firsts, "pages-distinct")
    found = neighbours(firsts.drop("same")).mapInArrow(run, "row long, host string, shared array<int>, inside array<int>, held array<long>").where((F.size("shared") > 0) | (F.size("inside") > 0))
    found = stash(found, "pages-shared")
    found = found.select("row", "shared").join(of_most_pages(found, firsts), "row", "left")
    of_same = found.join(firsts.select("row", "same"), "row").select("same", "shared", "inside")
    return keyed.select("row", "same", "level").join(of_same, "same").drop("same")


def of_most_pages(found: DataFrame, firsts: DataFrame) -> DataFrame:
    """(row, inside): of the places found inside, those of lines (held) that more than half of the host's pages (firsts) hold."""
    asked = found.where(F.size("inside") > 0).select("row", "host", F.explode(F.arrays_zip("inside", "held")).alias("x")).select("row", "host", F.col("x.inside").alias("place"), F.col("x.held").alias("line"))
    once = stash(asked.select("host", "line").distinct(), "pages-asked")  # written, so that its size is known where it meets all lines
    lines = firsts.select("host", F.explode(F.array_distinct("lines")).alias("line")).join(once, ["host", "line"], "left_semi")
    held = lines.groupBy("host", "line").agg(F.count("*").alias("n"))
    of = firsts.groupBy("host").agg(F.count("*").alias("of"))
    return asked.join(held, ["host", "line"]).join(of, "host").where("2 * n > of").groupBy("row").agg(F.collect_list("place").alias("inside"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html).

    Markup comes first: blocks in menus, headers, footers, asides, forms, adverts, notices and comments
    go, and if a page marks its article (or else its main part), the text is of that part's blocks. Then every
    page is aligned with those of the nearest URLs of its host. On a page that marks neither, the lines that it
    shares with the nearest that isn't a copy are its template and go; inside a marked part, those that it shares
    with the pages on both sides, neither a near copy, if more than half of the host's pages hold them: a sentence that
    some articles share stays, as do copies.
    A null or empty page, or one without text, has text ''. Repeated rows are each reported, and pages
    without a URL are neighbours of each other. An empty table gives no rows.
    """
    bounded_batches(pages.sparkSession, rows=256)
    found = stash(parsed(pages), "pages-lines")
    keys = found.where(F.size("lines") > 0).select("row", "host", "path", F.transform("lines", lambda x: F.xxhash64(x)).alias("lines"), F.transform("lines", F.length).alias("sizes"), "level")
    shared = shared_with_nearest(keys)
    template = shared.select("row", F.when(F.col("level") > OPEN, F.col("inside")).otherwise(F.col("shared")).alias("template")).where(F.size("template") > 0)
    template = stash(template, "pages-template")  # written, so that texts aren't shuffled for the few pages of a small one
    ours = found.select("row", "page_id", "url", "kinds", "lines", "level").join(template, "row", "left")
    kept = F.filter("lines", lambda x, k: (F.get("kinds", k) == F.col("level")) & ~F.coalesce(F.array_contains("template", k), F.lit(False)))
    text = F.array_join(kept, "\n")
    return ours.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """main_text() of the whole pages table; nulls, empty pages, repeated rows and an empty table as there."""
    return main_text(read(spark, sf_dir, "pages", "page_id", "url", "html"))
