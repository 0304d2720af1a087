import math
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import sitetree

DDL = "page_id bigint, url string, html string"


def page(i, host):
    body = "".join(f"<p>Story {host} {i} part {k} <b>bold</b> words.<br>more" for k in range(1 + i % 3))
    return f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a><li><a href=/x>About {host}</a></ul></nav><div class=ad>Buy {'now' if i % 2 else 'more'}!</div><article><h1>Head {i}</h1>{body}</article><script>var a='</p>'</script><footer>&copy; {host}</footer></body></html>"


ROWS = [(i, f"https://big.example/{i}", page(i, "big")) for i in range(60)] + [(100 + i, f"http://small.example/{i}", page(i, "small")) for i in range(2)]


def test_boilerplate_goes_and_stories_stay(spark):
    got = {r["page_id"]: r for r in sitetree.main_text(spark.createDataFrame(ROWS, DDL)).collect()}
    assert len(got) == len(ROWS)
    for i in range(60):
        t = got[i]["main_text"]
        assert f"Head {i}" in t and all(f"Story big {i} part {k} bold words. more" in t for k in range(1 + i % 3))
        assert not any(s in t for s in ("Home", "About", "Buy", "©", "var a")) and got[i]["branches_cut"] >= 3
    assert "Home" in got[100]["main_text"] and got[100]["branches_cut"] == 0


def brute_importance(pages):
    """The tree of one host, held as nested dictionaries, with composite importance by plain recursion."""

    def node():
        return {"n": 0, "styles": defaultdict(lambda: {"n": 0, "children": defaultdict(node)}), "texts": Counter()}

    root = node()

    def add(to, dom):
        to["n"] += 1
        if dom.tag == "#text" or not dom.children:
            to["texts"][dom.text] += 1
            return
        style = to["styles"][tuple((c.tag, c.attrs) for c in dom.children)]
        style["n"] += 1
        for i, c in enumerate(dom.children):
            if c.tag != "head":
                add(style["children"][i], c)

    for p in pages:
        add(root, sitetree.parse(p))

    def weigh(e):
        below = [weigh(c) for s in e["styles"].values() for c in s["children"].values()]
        if e["n"] == 1:
            e["own"] = 1.0
        elif not e["styles"]:
            e["own"] = 1 - sum(math.log(k) for k in e["texts"].values()) / math.log(e["n"]) / len(e["texts"])
        else:
            share = [(s["n"] / e["n"], s) for s in e["styles"].values()]
            entropy = -sum(p * math.log(p, e["n"]) for p, _ in share)
            under = sum(p * sum(c["own"] for c in s["children"].values()) / max(1, len(s["children"])) for p, s in share)
            w = sitetree.GAMMA ** len(share)
            e["own"] = (1 - w) * entropy + w * under
        e["own"] = 1 - (1 - e["own"]) * (e["n"] - 1) / (e["n"] - 1 + sitetree.EVIDENCE)
        e["most"] = max([e["own"], *below])
        return e["most"]

    weigh(root)

    def text(e, dom):
        if e["most"] <= sitetree.THRESHOLD:
            return []
        if dom.tag == "#text":
            return [dom.text]
        style = e["styles"].get(tuple((c.tag, c.attrs) for c in dom.children)) if dom.children else None
        return [t for i, c in enumerate(dom.children) if style and c.tag != "head" for t in text(style["children"][i], c)]

    return ["\n".join(text(root, sitetree.parse(p))) for p in pages]


def test_texts_are_those_of_plain_recursion(spark):
    got = {r["page_id"]: r["main_text"] for r in sitetree.main_text(spark.createDataFrame(ROWS, DDL)).collect()}
    for rows in (ROWS[:60], ROWS[60:]):
        assert [got[r[0]] for r in rows] == brute_importance([r[2] for r in rows])


@pytest.mark.parametrize(
    ("html", "want"),
    [("", []), ("a<b", ["a<b"]), ("<p>x<p>y", ["x", "y"]), ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]), ("x <b>y</b><br>z &amp; q", ["x y z & q"]), ("<!-- no --><script>no</script>yes<style>no", ["yes"]), ("<div><p>a</div>b", ["a", "b"]), ("</p></div>t", ["t"]), ("5 < 6", ["5 < 6"])],
)
def test_trees(html, want):
    assert [n.text for *_, n in sitetree.walk(sitetree.parse(html)) if n.tag == "#text"][::-1] in (want, want[::-1])
    assert sitetree.extract(sitetree.parse(html), frozenset())[0].split("\n") == (want or [""])


def test_awkward_pages(spark):
    rows = [*ROWS, (200, None, page(1, "x")), (201, "no host", page(2, "x")), (202, "https://big.example/n", None), (203, "https://big.example/e", ""), (None, "https://big.example/k", page(61, "big")), ROWS[0], (204, "https://BIG.example:80/z", page(62, "big")), (205, "https://deep.example/", "<div>" * 3000 + "deep"), (206, "https://long.example/", "<p>" + "word " * 100_000)]
    df = spark.createDataFrame(rows, DDL).withColumns({c: F.lit(1) for c in ("host", "cut", "known", "main_text", "n", "t", "e")})
    out = sitetree.main_text(df).collect()
    assert len(out) == len(rows)
    got = {r["page_id"]: r for r in out}
    assert "Home" in got[200]["main_text"] and "Home" in got[201]["main_text"] and (got[202]["main_text"], got[202]["branches_cut"]) == (None, None)
    assert got[203]["main_text"] == "" and "Home" not in got[None]["main_text"] and "Home" not in got[204]["main_text"]
    assert got[205]["main_text"] == "deep" and len(got[206]["main_text"]) == 5 * 100_000 - 1
    assert sitetree.main_text(spark.createDataFrame([], DDL)).collect() == []


def test_small_hosts_are_trimmed_and_copies_count_once(spark):
    rows = [(i, f"https://few.example/{i}", page(i, "few")) for i in range(3)] + [(100 + i, f"https://copy.example/{i}", page(1, "copy")) for i in range(12)]
    rows += [(200 + i, f"https://both.example/{i}", page(i % 6, "both")) for i in range(18)]
    got = {r["page_id"]: r for r in sitetree.main_text(spark.createDataFrame(rows, DDL)).collect()}
    assert all("Home" not in got[i]["main_text"] and f"Head {i}" in got[i]["main_text"] for i in range(3))
    assert all("Home" in got[i]["main_text"] and "Head 1" in got[i]["main_text"] and got[i]["branches_cut"] == 0 for i in range(100, 112))
    assert all("Home" not in got[200 + i]["main_text"] and f"Head {i % 6}" in got[200 + i]["main_text"] for i in range(18))


def test_deep_nesting_is_dissolved_and_stays_nested():
    """Beyond the deepest level end tags still meet their own start tags."""
    html = "<div>" * 198 + "<section><div>in</div>tail</section>" + "</div>" * 197 + "<p>top</p></div><p>out</p>"
    root = sitetree.parse(html)
    assert sitetree.extract(root, frozenset())[0] == "in\ntail\ntop\nout"
    assert [c.tag for c in root.children] == ["div", "p"] and [c.tag for c in root.children[0].children] == ["div", "p"]
    text, depth = sitetree.extract(sitetree.parse("<div>a" * 5000 + "</div>b" * 5000), frozenset())[0], max(d for *_, d, _ in sitetree.walk(sitetree.parse("<div>" * 5000 + "x")))
    assert text.split("\n") == ["a"] * 5000 + ["b"] * 5000 and depth == sitetree.DEEPEST + 1


@pytest.mark.parametrize("html", ["<a" * 500_000, "<a " + '="x" ' * 200_000, "<div>" * 200_000 + "</p>" * 200_000, "<!--" * 250_000, "<script>" + "</script" * 100_000, "<p class='" * 100_000, "<" * 1_000_000, "&amp" * 250_000])
def test_hostile_pages_take_linear_time(html):
    start = time.perf_counter()
    sitetree.extract(sitetree.parse(html), frozenset())
    assert time.perf_counter() - start < 4


def test_many_branches_are_joined_and_not_sent(spark):
    df = spark.createDataFrame([*ROWS, (900, "https://big.example/null", None), (901, None, "<p>x")], DDL)
    key = lambda rows: sorted((r["page_id"], r["main_text"] or "", r["branches_cut"] or 0) for r in rows)
    assert key(sitetree.main_text(df).collect()) == key(sitetree.main_text(df, most_sent=0).collect())


def test_a_hot_host(spark):
    """One host of 200,000 different pages: its tree is summed up by level, and never gathered."""
    body = F.concat(F.lit("<nav>Home About</nav><div><p>"), F.col("id").cast("string"), F.lit(" story</p></div>"), F.when(F.col("id") % 3 == 0, F.lit("<aside>More</aside>")).otherwise(F.lit("")), F.lit("<footer>Us</footer>"))
    df = spark.range(200_000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://hot.example/"), F.col("id").cast("string")).alias("url"), body.alias("html"))
    got = sitetree.main_text(df).agg(F.count("*"), F.count_if(F.col("main_text") == F.concat(F.col("page_id").cast("string"), F.lit(" story")))).first()
    assert tuple(got) == (200_000, 200_000)
