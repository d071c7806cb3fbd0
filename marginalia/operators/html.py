"""Web pages as rows: blocks, clean html, references and citations.

One small parser turns a page into its events; all decisions are DataFrame operations on them.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import match as M
from marginalia.functions.text import escape_html, normalize
from marginalia.functions.udf import arrow
from marginalia.session import materialize

# Fixed values of the clean-up: elements and attributes that stay, elements that go with all in them.
KEPT = {
    "a": ["href"], "img": ["src", "alt", "width", "height"], "td": ["colspan", "rowspan"], "th": ["colspan", "rowspan"], "ol": ["start"], "source": ["src", "type"],
    "video": ["src", "poster", "autoplay", "loop", "muted", "playsinline", "controls", "preload", "width", "height"],
    **{t: [] for t in "table thead tbody tfoot caption tr ul li pre code b i em strong sub sup br hr p h1 h2 h3 h4 h5 h6 figure figcaption blockquote span".split()},
}
# Hosts of players that stay as iframes, with the attributes that these keep.
PLAYERS, PLAYER_ATTRS = ("www.youtube.com", "www.youtube-nocookie.com", "youtube.com", "player.vimeo.com"), ("src", "title", "allowfullscreen", "width", "height")
# Elements and attributes of inline drawings that stay.
SVG = "svg g path line polyline polygon rect circle ellipse text tspan defs clippath lineargradient radialgradient stop marker symbol use title desc pattern mask".split()
SVG_ATTRS = (
    "id viewbox width height x y x1 x2 y1 y2 cx cy r rx ry d points dx dy offset fill fill-opacity fill-rule stroke stroke-width stroke-dasharray stroke-dashoffset stroke-linecap stroke-linejoin "
    "stroke-opacity stroke-miterlimit opacity transform font-size font-family font-weight font-style text-anchor dominant-baseline alignment-baseline letter-spacing stop-color stop-opacity "
    "gradientunits gradienttransform clip-path mask preserveaspectratio vector-effect paint-order patternunits markerunits markerwidth markerheight refx refy orient xmlns style href xlink:href"
).split()
DROPPED = "script style iframe object embed noscript form input button link meta".split()
CHROME = ["nav", "footer", "header", "aside", "head", "title", *DROPPED]
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p": "PARAGRAPH", "li": "LIST", "pre": "CODE", "table": "TABLE", "figure": "FIGURE", "hr": "SEPARATOR", "blockquote": "PARAGRAPH", **{f"h{i}": "HEADING" for i in range(1, 7)}}
#: What a new element of these closes if it is open.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, **{f"h{i}": {"p"} for i in range(1, 7)}, "ul": {"p"}, "ol": {"p"}, "table": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}

EVENTS = "id bigint, seq int, kind string, tag string, attrs map<string,string>, text string, path array<string>, nodes array<int>"


class _Events(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.stack, self.n = [], [], 0

    def add(self, kind, tag="", attrs=(), text=""):
        self.out.append((len(self.out), kind, tag, dict(attrs), text, [t for t, _ in self.stack], [n for _, n in self.stack]))

    def handle_starttag(self, tag, attrs):
        while self.stack and self.stack[-1][0] in CLOSES.get(tag, ()):
            self.close_one()
        self.n += 1
        self.stack.append((tag, self.n))
        self.add("open", tag, [(k, v or "") for k, v in attrs])
        if tag in VOID:
            self.stack.pop()

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.stack):
            while self.stack[-1][0] != tag:
                self.close_one()
            self.close_one()

    def close_one(self):
        self.add("close", self.stack[-1][0])
        self.stack.pop()

    def handle_data(self, data):
        self.add("text", text=data)


def events(pages: DataFrame) -> DataFrame:
    """Opening and closing tags and texts of pages (id, html) in order, with the open elements."""

    def run(batches):
        for b in batches:
            for i, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = _Events()
                p.feed(html or "")
                p.close()
                while p.stack:
                    p.close_one()
                if p.out:
                    seq, kind, tag, attrs, text, path, nodes = map(list, zip(*p.out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i] * len(seq), pa.int64()), pa.array(seq, pa.int32()), pa.array(kind), pa.array(tag), pa.array([list(a.items()) for a in attrs], pa.map_(pa.string(), pa.string())), pa.array(text), pa.array(path, pa.list_(pa.string())), pa.array(nodes, pa.list_(pa.int32()))],
                        names=["id", "seq", "kind", "tag", "attrs", "text", "path", "nodes"],
                    )

    return pages.select(F.col("id").cast("bigint"), "html").mapInArrow(run, EVENTS)


def _in(path: Column, tags) -> Column:
    return F.arrays_overlap(path, F.array(*map(F.lit, tags)))


def page_blocks(ev: DataFrame) -> DataFrame:
    """Typed blocks of pages in order: id, ord, type, text, html (of headings).

    A text belongs to its nearest block element, in a table or figure to that; chrome is left out.
    """
    kinds = F.create_map(*(F.lit(x) for kv in BLOCKS.items() for x in kv))
    places = F.sequence(F.lit(1), F.size("path"))
    at = F.filter(F.when(F.size("path") > 0, places).otherwise(F.array().cast("array<int>")), lambda i: F.element_at(F.col("path"), i).isin(*BLOCKS))
    whole = F.filter(at, lambda i: F.element_at(F.col("path"), i).isin("table", "figure"))
    t = ev.filter("kind = 'text' OR tag IN ('hr', 'br')").filter(~F.coalesce(_in(F.col("path"), CHROME), F.lit(False)))
    t = t.withColumn("at", F.coalesce(F.try_element_at(whole, F.lit(1)), F.try_element_at(at, F.lit(-1)))).filter("at IS NOT NULL")
    piece = F.when(F.col("tag") == "br", "\n").otherwise(F.col("text"))
    t = t.select("id", "seq", F.element_at("path", F.col("at")).alias("block"), F.element_at("nodes", F.col("at")).alias("node"), piece.alias("piece"))
    g = t.groupBy("id", "node", "block").agg(F.min("seq").alias("seq"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "").alias("text"))
    text = F.when(F.col("block") == "pre", F.col("text")).otherwise(normalize(F.col("text")))
    g = g.select("id", "seq", kinds[F.col("block")].alias("type"), text.alias("text"), "block").filter("text <> '' OR type = 'SEPARATOR'")
    level = F.least(F.substring("block", 2, 1).cast("int"), F.lit(3)).cast("string")
    html = F.when(F.col("type") == "HEADING", F.concat(F.lit("<h"), level, F.lit(">"), escape_html(F.col("text")), F.lit("</h"), level, F.lit(">")))
    return g.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("seq")) - 1).alias("ord"), "type", "text", html.alias("html"))


def absolute(url: Column, base: Column) -> Column:
    """A URL made absolute on a page's; null for schemes that run or hold content."""
    origin = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    return (
        F.when(url.rlike(r"(?i)^\s*(javascript|data|blob):"), F.lit(None).cast("string"))
        .when(url.rlike("(?i)^[a-z][a-z0-9+.-]*:"), url)
        .when(F.startswith(url, F.lit("//")), F.concat(F.substring_index(base, ":", 1), F.lit(":"), url))
        .when(F.startswith(url, F.lit("/")), F.concat(origin, url))
        .when(F.startswith(url, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), url))
        .otherwise(F.concat(folder, F.lit("/"), url))
    )


def sanitized(ev: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages' html with only what may stay: id, clean.

    Some elements go with all in them, unknown ones leave their children behind, attributes are
    pruned, links and images made absolute, links opened without a referrer.  Players of known hosts
    stay as iframes, inline drawings keep what cannot load anything, videos start muted.
    """
    svg = F.array_position("path", "svg").cast("int")
    drawn = F.slice("path", F.greatest(svg, F.lit(1)), F.size("path"))
    player = (F.col("kind") == "open") & (F.col("tag") == "iframe")
    around = F.when(svg > 0, F.slice("path", F.lit(1), svg - 1)).when(player, F.slice("path", F.lit(1), F.size("path") - 1)).otherwise(F.col("path"))
    stays = ~_in(around, [*DROPPED, "title"]) & ((svg == 0) | F.forall(drawn, lambda t: t.isin(*SVG)))
    e = ev.join(pages.select("id", F.col("source_url").alias("base")), "id").withColumn("in_svg", F.coalesce(svg > 0, F.lit(False))).filter(F.coalesce(stays, F.lit(True)))
    allowed = F.create_map(*(x for k, v in (KEPT | {"iframe": PLAYER_ATTRS}).items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    own = F.when(F.col("in_svg"), F.array(*map(F.lit, SVG_ATTRS))).otherwise(allowed[F.col("tag")])
    names = F.filter(F.map_keys("attrs"), lambda k: F.array_contains(own, k))

    def value(k):
        raw = F.element_at("attrs", k)
        local = ~raw.rlike(r"(?i)url\(\s*['\"]?(?!#)[^'\")]") & ~(k.isin("href", "xlink:href") & ~F.startswith(F.trim(raw), F.lit("#"))) & ~((k == "style") & raw.rlike("(?i)expression|@import|javascript:"))
        return F.when(F.col("in_svg"), F.when(local, raw)).when(k.isin("href", "src", "poster"), absolute(raw, F.col("base"))).otherwise(raw)

    plays = ("muted", "controls", "preload", "playsinline")
    shown = F.filter(names, lambda k: value(k).isNotNull() & ~((F.col("tag") == "video") & k.isin(*plays)))
    attrs = F.array_join(F.transform(shown, lambda k: F.concat(F.lit(" "), k, F.lit('="'), escape_html(value(k), True), F.lit('"'))), "")
    extra = (
        F.when((F.col("tag") == "a") & ~F.col("in_svg"), ' rel="noopener noreferrer" target="_blank"')
        .when(F.col("tag") == "video", F.concat(F.lit(' muted=""'), F.when(F.map_contains_key("attrs", "autoplay"), "").otherwise(' controls=""'), F.lit(' preload="metadata" playsinline=""')))
        .when(F.col("tag") == "iframe", ' loading="lazy" referrerpolicy="no-referrer"').otherwise("")
    )
    src = value(F.lit("src"))
    known = F.col("in_svg") | (F.col("tag").isin(*KEPT) & ~(F.col("tag").isin("img", "source") & src.isNull()))
    trusted = player & F.regexp_extract(src, "^https://([^/?#:]+)", 1).isin(*PLAYERS)
    piece = (
        F.when(F.col("kind") == "text", escape_html(F.col("text")))
        .when(F.coalesce(trusted, F.lit(False)), F.concat(F.lit("<iframe"), attrs, extra, F.lit("></iframe>")))
        .when((F.col("kind") == "open") & known, F.concat(F.lit("<"), F.col("tag"), attrs, extra, F.lit(">")))
        .when((F.col("kind") == "close") & known, F.concat(F.lit("</"), F.col("tag"), F.lit(">")))
        .otherwise("")
    )
    return e.select("id", "seq", piece.alias("piece")).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "").alias("clean"))


# Headings of reference lists, those under which paragraphs may be entries, class and id
# hints, ids of entries, marks of links that lead back.
_HEADING = r"(?i)^[^a-z]*(references?|bibliography|works cited|citations?|notes|endnotes|footnotes|sources|literature cited)\b[\s\d.:]*$"
_STRONG = r"(?i)^[^a-z]*(references?|bibliography|works cited|literature cited)\b[\s\d.:]*$"
_HINT = r"(?i)\b(references|bibliography|footnotes|endnotes|citation-list|works[-_]?cited|ref[-_]?list|reflist|refbegin|biblist|literature)\b"
_ENTRY_ID = r"(?i)^(cite[_-]?note|citeref|ref|reference|fn|footnote|note|bib|endnote)[-_:.]?"
_SHORT_ENTRY_ID = r"(?i)^(b|r|cr)-?\d+$"
_BACK_CLASS = r"(^|\s)(mw-cite-backlink|footnote-backref|footnote-return)(\s|$)"
PARAGRAPH_CHARS = 800
ENTRY_CHARS, LINK_CHARS = 600, 300


def _entry_paragraphs(opened: DataFrame, words: DataFrame) -> DataFrame:
    """Paragraphs that are reference entries: three or more right after a heading that leaves no
    doubt, half of them with a year, a number before them or a link."""
    parent = F.coalesce(F.try_element_at("nodes", F.lit(-2)), F.lit(0))
    sib = opened.select("id", "node", "seq", "tag", parent.alias("parent"))
    w = Window.partitionBy("id", "parent").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)  # bounded by a page
    sib = sib.withColumn("run", F.sum(F.when(F.col("tag") == "p", 0).otherwise(1)).over(w))
    titled = words.withColumnRenamed("item", "node")
    heads = sib.filter(F.col("tag").rlike("^h[1-6]$")).join(titled, ["id", "node"]).filter(F.col("text").rlike(_STRONG)).select("id", "parent", "run", F.col("node").alias("list"))
    links = opened.filter("tag = 'a'").filter(F.map_contains_key("attrs", "href")).select("id", F.explode("nodes").alias("node")).distinct().withColumn("linked", F.lit(True))
    p = sib.filter("tag = 'p'").join(heads, ["id", "parent", "run"]).join(titled, ["id", "node"], "left").join(links, ["id", "node"], "left")
    shaped = (F.char_length("text") <= PARAGRAPH_CHARS) & (F.col("text").rlike(r"\b(19|20)\d{2}\b") | F.col("text").rlike(r"^\[?\d{1,4}[\]).]") | F.coalesce("linked", F.lit(False)))
    good = p.groupBy("id", "list").agg(F.count("*").alias("n"), F.count_if(F.coalesce(shaped, F.lit(False))).alias("shaped")).filter("n >= 3 AND shaped * 2 >= n").select("id", "list")
    none = F.lit(None).cast("string")
    return p.join(good, ["id", "list"], "left_semi").select("id", F.col("node").alias("item"), F.col("seq").alias("item_seq"), "list", none.alias("html_id"), none.alias("value"))


def page_references(ev: DataFrame, pages: DataFrame) -> DataFrame:
    """Reference entries of pages: id, ref_id, label, text, url, formal.

    A list is one of references if its class or id, or that of an element above, says so and it has
    two items, if most of three or more items have ids of entries, or if a heading that names
    references stands before it; paragraphs under a clear heading can be entries too.  Outbound links in the text follow as entries of their own, to
    other hosts only if there is a formal list.
    """
    e = ev.join(pages.select("id", F.col("source_url").alias("base")), "id").filter(~F.coalesce(_in(F.col("path"), CHROME), F.lit(False)))
    e = materialize(e, "events")  # read some twenty times below; pages are parsed once
    opened = e.filter("kind = 'open'").withColumn("node", F.element_at("nodes", -1))
    marks = F.concat_ws(" ", F.element_at("attrs", F.lit("class")), F.element_at("attrs", F.lit("id")))
    hints = opened.filter(marks.rlike(_HINT)).select("id", F.col("node").alias("hint"))
    lists = opened.filter("tag IN ('ol', 'ul')").filter(~_in(F.slice("path", F.lit(1), F.size("path") - 1), ["ol", "ul"])).select("id", F.col("node").alias("list"), "seq", "nodes")
    items = opened.filter("tag = 'li'").select("id", F.col("node").alias("item"), F.col("seq").alias("item_seq"), F.element_at("nodes", -2).alias("list"), F.element_at("attrs", F.lit("id")).alias("html_id"), F.element_at("attrs", F.lit("value")).alias("value"))
    sizes = items.groupBy("id", "list").agg(F.count("*").alias("n"), F.count_if(F.col("html_id").rlike(_ENTRY_ID) | F.col("html_id").rlike(_SHORT_ENTRY_ID)).alias("ids"))
    near = F.slice("nodes", F.greatest(F.size("nodes") - 2, F.lit(1)), F.lit(3))
    hinted = lists.select("id", "list", F.explode(near).alias("hint")).join(hints, ["id", "hint"], "left_semi").select("id", "list").distinct().withColumn("hinted", F.lit(True))
    # the heading with the greatest place before a list, if no other block lies between
    texts = e.filter("kind = 'text' AND trim(text) <> ''").withColumn("heading", F.coalesce(_in(F.col("path"), [f"h{i}" for i in range(1, 7)]), F.lit(False)))
    before = lists.select("id", "list", F.col("seq").alias("list_seq")).join(texts.select("id", F.col("seq").alias("t_seq"), "text", "heading"), "id").filter("t_seq < list_seq")
    last = before.groupBy("id", "list").agg(F.max_by(F.struct("text", "heading"), "t_seq").alias("x"))
    headed = last.filter("x.heading").filter(normalize(F.col("x.text")).rlike(_HEADING)).select("id", "list", F.lit(True).alias("headed"))
    formal = sizes.join(hinted, ["id", "list"], "left").join(headed, ["id", "list"], "left").filter("(hinted AND n >= 2) OR (n >= 3 AND ids * 2 > n) OR headed").select("id", "list")
    inside = e.filter("kind = 'text'").select("id", "seq", "text", F.explode("nodes").alias("item"))
    words = inside.groupBy("id", "item").agg(normalize(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")).alias("text"))
    paragraphs = _entry_paragraphs(opened, words)
    entries = items.join(formal, ["id", "list"], "left_semi").unionByName(paragraphs)
    # links that lead back from an entry to the text are none of its words
    back = F.coalesce(F.element_at("attrs", F.lit("class")).rlike(_BACK_CLASS), F.lit(False)) | ((F.col("tag") == "a") & ((F.element_at("attrs", F.lit("role")) == "doc-backlink") | (F.element_at("attrs", F.lit("rev")) == "footnote")))
    tiny = opened.filter("tag = 'a'").filter(F.startswith(F.element_at("attrs", F.lit("href")), F.lit("#"))).select("id", F.col("node").alias("item")).join(words.filter("char_length(text) <= 2"), ["id", "item"], "left_semi")
    backs = opened.filter(F.coalesce(back, F.lit(False))).select("id", F.col("node").alias("item")).union(tiny)
    backed = inside.join(backs, ["id", "item"], "left_semi").select("id", "seq").distinct()
    text = inside.join(backed, ["id", "seq"], "left_anti").join(entries.select("id", "item"), ["id", "item"], "left_semi").groupBy("id", "item").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("raw"))
    links = opened.filter("tag = 'a'").select("id", "seq", F.explode("nodes").alias("item"), absolute(F.element_at("attrs", F.lit("href")), F.col("base")).alias("url"), F.element_at("attrs", F.lit("href")).alias("href"))
    link = links.filter(~F.startswith("href", F.lit("#")) & F.col("url").rlike("^https?:")).groupBy("id", "item").agg(F.min_by("url", "seq").alias("url"))
    full = entries.join(text, ["id", "item"]).join(link, ["id", "item"], "left").withColumn("raw", normalize(F.col("raw"))).filter("raw <> ''")
    marker = r"^\[?(\d{1,4})[\]).:]?\s+"
    body = F.regexp_replace("raw", marker, "")
    first = full.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("item_seq"))).select(
        "id", "n", F.coalesce(F.nullif(F.regexp_extract("raw", marker, 1), F.lit("")), "value", F.col("n").cast("string")).alias("label"),
        F.when(F.char_length(body) > ENTRY_CHARS, F.concat(F.left(body, F.lit(ENTRY_CHARS)), F.lit("…"))).otherwise(body).alias("text"), F.coalesce("url", first_weblink(F.col("raw"))).alias("url"), F.lit(True).alias("formal"),
    )
    # hyperlinks of the running text
    taken = formal.select("id", F.col("list").alias("item")).union(paragraphs.select("id", "item")).distinct()
    a = opened.filter("tag = 'a'").filter(~F.coalesce(_in(F.col("path"), ["figure", "table", "pre", "svg"]), F.lit(False)))
    a = a.select("id", "seq", F.col("node").alias("item"), "nodes", "base", absolute(F.element_at("attrs", F.lit("href")), F.col("base")).alias("url")).filter(F.col("url").rlike("^https?:"))
    in_list = a.select("id", "seq", F.explode("nodes").alias("item")).join(taken, ["id", "item"], "left_semi").select("id", "seq").distinct()
    host = lambda c: F.regexp_extract(c, "^[a-z]+://([^/?#:]*)", 1)
    count = first.groupBy("id").agg(F.count("*").alias("k"))
    out = a.join(in_list, ["id", "seq"], "left_anti").join(words, ["id", "item"]).join(count, "id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    out = out.filter((F.col("text") != "") & (F.char_length("text") <= LINK_CHARS) & ((F.col("k") == 0) | (host(F.col("url")) != host(F.col("base")))))
    page = lambda c: F.regexp_replace(c, "#.*$", "")
    out = out.filter(page(F.col("url")) != page(F.col("base"))).withColumn("key", F.regexp_replace("url", "/$", ""))
    known = first.filter("url IS NOT NULL").select("id", F.regexp_replace("url", "/$", "").alias("key")).distinct()
    new = out.join(known, ["id", "key"], "left_anti").groupBy("id", "key", "k").agg(F.min_by(F.struct("seq", "text", "url"), "seq").alias("x"))
    new = new.withColumn("n", F.col("k") + F.row_number().over(Window.partitionBy("id").orderBy("x.seq")))
    new = new.select("id", "n", F.col("n").cast("string").alias("label"), "x.text", "x.url", F.lit(False).alias("formal"))
    both = first.withColumn("n", F.col("n").cast("bigint")).unionByName(new)
    return both.select("id", F.concat(F.lit("r"), F.col("n").cast("string")).alias("ref_id"), "label", "text", "url", "formal")


@arrow("string")
def first_weblink(text: pd.Series) -> pd.Series:
    return pd.Series([(M.weblinks(t or "") or [(0, 0, None)])[0][2] for t in text], dtype=object)


def pruned_references(references: DataFrame, cited: DataFrame) -> DataFrame:
    """References that are formal or cited (id, ref_id); link references take the labels of their
    new places."""
    keep = references.join(cited.select("id", "ref_id", F.lit(True).alias("is_cited")).distinct(), ["id", "ref_id"], "left").filter("formal OR is_cited")
    n = F.regexp_extract("ref_id", r"(\d+)", 1).cast("int")
    place = F.row_number().over(Window.partitionBy("id").orderBy(n))
    return keep.withColumn("label", F.when(F.col("formal"), F.col("label")).otherwise(place.cast("string"))).drop("is_cited")


# Types of blocks that keep the spans of their citations.
CITED = ("PARAGRAPH", "HEADING", "LIST")


def lifted(blocks: DataFrame, squeeze: bool = True) -> DataFrame:
    """Blocks whose texts have shed their citation marks; texts, headings and lists keep the spans,
    and blocks left empty go.  Without ``squeeze`` texts keep all their white space, and blank blocks
    stay."""
    names = blocks.columns
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ref_id", pa.string()), ("quoted", pa.string())]))

    def run(batches):
        for b in batches:
            found = [M.take_citations(t or "", squeeze) for t in b.column("text").to_pylist()]
            cited = [[dict(zip(("start", "end", "ref_id", "quoted"), c)) for c in cs] if k in CITED else None for (_, cs), k in zip(found, b.column("type").to_pylist())]
            columns = [pa.array([t for t, _ in found], pa.string()) if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cited, spans)], names=[*names, "citations"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema)
    out = blocks.mapInArrow(run, f"{schema}, citations array<struct<start:int,end:int,ref_id:string,quoted:string>>")
    return out.filter(normalize(F.col("text")) != "") if squeeze else out


def bracket_citations(blocks: DataFrame, references: DataFrame) -> DataFrame:
    """Citations in brackets that name an entry's label: block_id, start, end, ref_id, quoted.
    ``blocks`` has block_id, id, text; of equal labels the last entry wins."""
    n = F.regexp_extract("ref_id", r"(\d+)", 1).cast("int")
    labels = references.groupBy("id", "label").agg(F.max_by("ref_id", n).alias("ref_id"))
    labels = labels.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("label", "ref_id"))).alias("labels"))

    @arrow("array<struct<start:int,end:int,ref_id:string,quoted:string>>")
    def find(text: pd.Series, known: pd.Series) -> pd.Series:


        return pd.Series([[dict(zip(("start", "end", "ref_id", "quoted"), c)) for c in M.bracket_citations(t or "", dict(k), [])] for t, k in zip(text, known)])

    j = blocks.filter(F.contains("text", F.lit("["))).join(labels, "id")
    return j.select("block_id", F.explode(find("text", "labels")).alias("c")).select("block_id", "c.*")
