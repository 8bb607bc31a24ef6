"""Fragments, script literals and trees against plain versions."""

import json
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from quarry.operators import fragments as G
from quarry.operators import trees as T
from quarry.sources import script_toc as J


def plain_walk(nodes, stop, cut):
    """nodes: name -> parent. name -> (nearest, excluded, path from the root), None for those in or below cycles."""
    out = {}
    for n in nodes:
        way, at, seen = [], n, set()
        while at is not None and at in nodes and at not in seen:
            seen.add(at)
            way.append(at)
            at = nodes[at]
        out[n] = None if at in seen else (next((x for x in way if stop(x)), None), any(map(cut, way)), [str(x) for x in reversed(way)])
    return out


def shapes():
    rng = random.Random(6)
    yield {i: None if i == 0 else i - 1 for i in range(400)}  # a chain
    yield {i: None if i == 0 else 0 for i in range(400)}  # a star
    yield {i: None if rng.random() < 0.05 else rng.randrange(i) if i else None for i in range(500)}
    yield {i: (i + 1) % 7 if i < 7 else rng.randrange(i) if i % 9 else 10_000 for i in range(200)}  # a cycle, and parents without a row
    yield {0: 0, 1: 0, 2: None}


@pytest.mark.parametrize("nodes", list(shapes()))
@pytest.mark.parametrize("hot", [10, 100_000])
def test_climb_equals_plain_walk(spark, nodes, hot):
    df = spark.createDataFrame([(n, p, "x") for n, p in nodes.items()], "node long, parent long, near string")
    stop, cut = lambda n: n % 5 == 3, lambda n: n % 23 == 22
    want = plain_walk(nodes, stop, cut)
    found = T.climb(df, stop=df.node % 5 == 3, cut=df.node % 23 == 22, label=df.node.cast("string"), hot=hot).collect()
    assert {r.node for r in found} == set(nodes)
    for r in found:
        if want[r.node] is None:
            assert not r.whole or r.excluded
        elif want[r.node][1]:
            assert r.excluded
        else:
            assert (r.nearest, r.excluded, r.path) == want[r.node] and r.whole
    near = {r.node: r.nearest for r in T.climb(df, stop=df.node % 5 == 3, hot=hot).collect()}
    assert all(near[n] == w[0] for n, w in want.items() if w)


def test_climb_odd_tables(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, 1), (2, 1)], "node long, parent long")
    assert sorted((r.node, r.nearest) for r in T.climb(df, stop=df.node == 1).collect()) == [(1, 1), (2, 1)]
    assert T.climb(df.limit(0), stop=df.node == 1).count() == 0


def test_by_container(spark):
    rows = [("c", None, "chapter", "Zoning"), ("a", "c", "article", "I"), ("s1", "a", "section", "1"), ("s2", "c", "section", "2"), ("x", "c", "article", "Subdivision of land"), ("s3", "x", "section", "3"), ("s4", None, "section", "4")]
    df = spark.createDataFrame(rows, "node string, parent string, kind string, title string")
    got = T.by_container(df, leaf=df.kind == "section", container=df.kind.isin("chapter", "article"), cut=df.title.rlike("(?i)subdivision|map"))
    assert sorted((r.node, r.container) for r in got.collect()) == [("s1", "a"), ("s2", "c"), ("s4", None)]


def dumped(value, rng):
    """A value as a script literal: keys bare or quoted, either kind of quotes, comments and commas at random."""
    gap = lambda: rng.choice(["", "", " ", "\n", "/* x:{ */", "// ]\n"])
    more = lambda: rng.choice(["", "", ","])

    def text(s):
        q = rng.choice("'\"")
        return q + s.replace("\\", "\\\\").replace(q, "\\" + q).replace("\n", "\\n").replace("é", rng.choice(["é", "\\u00e9", "\\xe9"])) + q

    if isinstance(value, dict):
        key = lambda k: k if k.isidentifier() and rng.random() < 0.5 else text(k)
        return "{" + gap() + ("," + gap()).join(f"{key(k)}{gap()}:{gap()}{dumped(v, rng)}" for k, v in value.items()) + (more() if value else "") + gap() + "}"
    if isinstance(value, list):
        return "[" + gap() + ",".join(dumped(v, rng) + gap() for v in value) + (more() if value else "") + "]"
    return text(value) if isinstance(value, str) else json.dumps(value)


def value_of(rng, depth=0):
    kind = rng.randrange(6 if depth < 5 else 4)
    if kind == 4:
        return {rng.choice(["a", "i", "tree", "'/x.htm'", "é b", "n9", ""]) + str(k): value_of(rng, depth + 1) for k in range(rng.randrange(4))}
    if kind == 5:
        return [value_of(rng, depth + 1) for _ in range(rng.randrange(4))]
    return [rng.randrange(-9, 99), rng.choice([True, False, None]), rng.choice(["it's", 'say "x"', "", "é\\n{]", "a:b,c"]), 2.5][kind]


def test_literals_round_trip():
    rng = random.Random(1)
    for _ in range(400):
        value = {"v": value_of(rng), "w": [value_of(rng)]}
        assert J.literal(dumped(value, rng)) == value
    deep = "[" * 50_000 + "]" * 50_000
    assert J.literal("{a:" + deep + "}")["a"] is not None


@pytest.mark.parametrize("broken", ["{", "{a:1", "{a 1}", "{a:}", "[1,2", "{a:'x}", "{a:[1}]", "{:1}", "{a:1 b}", "", "{a:{b:1},c", "[1 : 2]", "{a,b:1}"])
def test_broken_literals(broken):
    with pytest.raises(ValueError):
        J.literal(broken)


def test_script_toc(spark):
    """A generated site: numbers, parents and paths as in the plain structure it was made of; broken files are errors and nothing else."""
    rng = random.Random(8)
    up = {i: None if i < 3 else rng.randrange(i) for i in range(120)}
    title = {i: rng.choice(["It's", 'A "b"', "Plain", " spaced "]) + f" {i}" for i in up}
    nest = lambda p: [{"i": i, "c": 0} | ({"n": nest(i)} if any(q == i for q in up.values()) else {}) for i, q in up.items() if q == p]
    pages = {}
    for i in up:
        pages.setdefault(f"/Content/p{i % 11}.htm", []).append(i)
    chunks = [{h: {"i": x, "t": [title[i] for i in x], "b": [f"#b{i}" if i % 2 else "" for i in x]} for h, x in pages.items() if int(h[10:-4]) % 2 == k} for k in (0, 1)]
    rows = [("s", "toc", f"define({dumped({'numchunks': 2, 'prefix': 'C', 'tree': {'n': nest(None)}}, rng)});")]
    rows += [("s", f"c{k}", f"define({dumped(c, rng)});") for k, c in enumerate(chunks)]
    rows += [("s", "bad", "define({'/x.htm':{i:[1],t:['a]}})"), ("t", "none", None), ("t", "empty", ""), ("u", "less", "({'/a.htm':{i:[4,9],t:['x'],b:[]},'/skip.txt':{i:[5]}})")]
    read = J.read_scripts(spark.createDataFrame(rows, "site string, name string, body string"))
    assert {(r.site, r.name) for r in read.where("error is not null").collect()} == {("s", "bad"), ("t", "none"), ("t", "empty")}
    entries = J.entries(read)
    got = {r.i: r for r in entries.where("site = 's'").collect()}
    assert {i: (r.parent, r.title, r.anchor) for i, r in got.items()} == {i: (up[i], title[i].strip(), f"#b{i}" if i % 2 else "") for i in up}

    def path(i):
        return [*(path(up[i]) if up[i] is not None else []), title[i].strip()]

    assert {r.i: r.path for r in J.paths(entries).where("site = 's'").collect()} == {i: path(i) for i in up}
    assert sorted((r.i, r.title, r.anchor, r.parent) for r in entries.where("site = 'u'").collect()) == [(4, "x", "", None), (9, "", "", None)]


def test_scripts_mean_the_same_as_json_and_by_tokens():
    """Whatever is changed in a script: what the substitutions make JSON of has the value that its tokens have."""
    rng, some, seen = random.Random(3), [*"{}[]:,'\"/\\ \n\0*a1.-e", "NaN", "1e5", "undefined", "//", "/*", "*/", "01", "\u00a0", "\\ud83d\\ude00"], 0
    for k in range(3000):
        text = list(dumped({"v": value_of(rng), "w": [value_of(rng)]}, rng) if k % 2 else json.dumps({"v": value_of(rng), "f": 1.5}))
        for _ in range(rng.randrange(3)):
            text.insert(rng.randrange(1, len(text) + 1), rng.choice(some))
        found = J._as_json("".join(text))
        if found is not None:
            seen += 1
            assert repr(found) == repr(J._by_tokens("".join(text), 0)), "".join(text)
    assert seen > 300
    for broken in ("{a:'" + "\\'" * 300_000, "{" + "/* " * 200_000, "{" + "a" * 500_000):
        assert J._as_json(broken) is None


def test_published_scripts_are_not_read_by_tokens(monkeypatch):
    monkeypatch.setattr(J, "_by_tokens", lambda *_: pytest.fail("token by token"))
    assert J.literal("define({numchunks:1,prefix:'C',tree:{n:[{i:0,c:0,n:[{i:1,c:0}]}]}});", 7)["tree"] == {"n": [{"i": 0, "c": 0, "n": [{"i": 1, "c": 0}]}]}
    assert J.literal("""{/* pages */'/a.htm':{i:[0,1],t:['Order\\'s 1','"R", 2'],b:['',]}});""") == {"/a.htm": {"i": [0, 1], "t": ["Order's 1", '"R", 2'], "b": [""]}}


def test_only_parents_climb(spark, monkeypatch):
    climbed = []
    monkeypatch.setattr(J, "climb", lambda nodes, **more: climbed.append(nodes.count()) or T.climb(nodes, **more))
    rows = [("s", i, None if i == 0 else i // 10 if i % 10 else 0, f"/{i}.htm", str(i), "") for i in range(100)]
    got = {r.i: r.path for r in J.paths(spark.createDataFrame(rows, "site string, i int, parent int, href string, title string, anchor string")).collect()}
    assert climbed == [10] and len(got) == 100
    assert got[57] == ["0", "5", "57"] and got[0] == ["0"] and got[30] == ["0", "30"]


class Plain(HTMLParser):
    """Names and places of elements as a parser of events sees them."""

    def __init__(self, html):
        super().__init__()
        self.html, self.open, self.seen = html, [], []
        self.starts = [0]
        for line in html.splitlines(keepends=True):
            self.starts.append(self.starts[-1] + len(line))
        self.feed(html)
        self.close()
        for at, _ in self.open:
            self.seen[at][2] = len(html)

    def here(self):
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def handle_starttag(self, tag, attrs):
        self.seen.append([tag, self.here(), None])
        if tag in G.VOID:
            self.seen[-1][2] = self.here() + len(self.get_starttag_text())
        else:
            self.open.append((len(self.seen) - 1, tag))

    def handle_startendtag(self, tag, attrs):
        self.seen.append([tag, self.here(), self.here() + len(self.get_starttag_text())])

    def handle_endtag(self, tag):
        at = [i for i, (_, t) in enumerate(self.open) if t == tag]
        if at:
            for i, (k, t) in reversed(list(enumerate(self.open))[at[-1] :]):
                self.seen[k][2] = self.here() + (self.html.index(">", self.here()) - self.here() + 1 if i == at[-1] else 0)
                self.open.pop()


def test_elements_equal_a_parser():
    rng = random.Random(3)
    for _ in range(300):
        html = "".join(rng.choice(["<div>", "</div>", "<p>", "</p>", "<div class='a b'>", "<b>", "</b>", "<br>", "<img src=x/>", "text ", "\n", "</i>", "<h4 id=\"x\">", "</h4>"]) for _ in range(rng.randrange(40)))
        assert [(e.name, e.begin, e.end) for e in G.elements(html)] == [tuple(x) for x in Plain(html).seen], html


@pytest.mark.parametrize(
    ("html", "rules", "want"),
    [
        ("<h4 class=x>T <i>t</i></h4><p>a</p><h4>U</h4>", (G.HEADING,), "<p>a</p><h4>U</h4>"),
        ('  <div class="history">[Added <div>2019</div> by 3]</div> <p>a</p><div class="history">b</div>', (G.HISTORY,), '   <p>a</p><div class="history">b</div>'),
        ('<p>a</p><div class="history">b</div>', (G.HISTORY,), '<p>a</p><div class="history">b</div>'),
        ("<div><div class='phx-name '><a href=x>Sec. 1</a></div></div><p>b</p>", (G.NAMED,), "<p>b</p>"),
        ("<div><div class='phx-name '>Sec. 1</div><p>b</p></div>", (G.NAMED,), "<div><p>b</p></div>"),
        ('<p><a class="H1_H2_Ref">1 > 2</a></p><p>text</p><p>x <b class=H1_H2_Ref></p>', (G.CRUMBS,), "<p>text</p>"),
        ("<div class=ad>a<div>b</div>c</div>d<div class='ad big'>e", (G.Rule("div", "class", "ad"),), "d"),
        ("", (G.HEADING, G.CRUMBS), ""),
    ],
)
def test_strip(html, rules, want):
    assert G.strip(html, rules) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>nav</p><div id='text-container'><h1>Title</h1><p>One &amp; two</p><div>in<div>ner</div></div></div><p>after</p>", "One & two\n\nin\nner"),
        ("<div id=text-container>a<br>b <h2>C</h2>   d\te</div>", "a\nb\nC\nd e"),
        ("<div id=text-container><h1>Only</h1></div><p>page</p>", "Only\n\npage"),
        ("<p>plain</p>", "plain"),
        ("<div id=text-container>never closed<p>x", "never closed\nx"),
        ("", ""),
    ],
)
def test_container_text(html, want):
    assert G.container_text(html, "div", "id", "text-container") == want


def test_pages_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "<nav>x</nav><div id='text-container'>y</div>")], "page_id long, html string")
    assert {r.page_id: r.html for r in G.stripped_pages(df, (G.Rule("nav"),)).collect()} == {1: "", 2: "<div id='text-container'>y</div>"}
    assert {r.page_id: r.text for r in G.container_texts(df, "div", "id", "text-container").collect()} == {1: "", 2: "y"}


def test_by_container_climbs_with_parents_alone(spark, monkeypatch):
    """A thousand leaves under two nodes: two rows climb; leaves in leaves, in a cut branch, cut themselves and without a parent's row are told alike."""
    climbed, real = [], T.climb
    monkeypatch.setattr(T, "climb", lambda rows, **k: (climbed.append(rows.count()), real(rows, **k))[1])
    rows = [("a", None, "box", ""), ("b", "a", "box", "cut"), *[(f"l{i}", "ab"[i % 2], "leaf", "") for i in range(1000)]]
    rows += [("in", "l0", "leaf", ""), ("out", "a", "leaf", "cut"), ("lone", "gone", "leaf", ""), ("free", None, "leaf", ""), (None, "a", "leaf", "")]
    df = spark.createDataFrame(rows, "node string, parent string, kind string, title string")
    got = {r.node: r.container for r in T.by_container(df, leaf=F.col("kind") == "leaf", container=F.col("kind") == "box", cut=F.col("title") == "cut").collect()}
    assert got == {**{f"l{i}": "a" for i in range(0, 1000, 2)}, "in": "a", "lone": None, "free": None}
    assert climbed == [3]
