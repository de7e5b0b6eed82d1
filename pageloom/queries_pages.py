"""Registered queries of selectors, the document tree, styles, extraction, crawl, search, usage and storage, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions import js, urls
from pageloom.operators import crawl as crawling
from pageloom.operators import css, dom, search, storage, usage
from pageloom.operators.article import skim
from pageloom.operators.selections import camel, selections
from pageloom.plans import selectors
from pageloom.plans.checkpoints import ensure_checkpoint_dir, written
from pageloom.queries import _UNESCAPED, _nodes, _t, query
from pageloom.sources.fetch import page_errors
from pageloom.sources.pages import parse_pages

# --- selectors ---

#: The pages have neither ids nor classes beyond `ad`; these replacements give their elements some, here and in SQL.
DRESS = {
    "<article>": '<article id="main" class="post lead wide" data-kind="Blog Post" lang="en-us" title="" style="Color: RED; width:1px; color: blue !important; background:url(data:image/png;base64,AA==)">',
    "<footer>": '<footer class="wide last" align="center" width="40">',
    "<nav>": '<nav class="lead" aria-label="Top">',
}
_DRESSED = reduce(lambda sql, x: f"replace({sql}, '{x[0]}', '{x[1]}')", DRESS.items(), "html")


def _dressed(spark, d) -> DataFrame:
    return _t(spark, d, "pages").withColumn("html", reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), DRESS.items(), F.col("html")))


def _dressed_nodes(spark, d) -> DataFrame:
    return written(parse_pages(_dressed(spark, d)), "nodes")


_HREFS = "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)"
_COUNT = "len(regexp_extract_all(html, '{}'))"
_HAS = "contains(html, '{}')::int"
_ITEMS = _COUNT.format("<li>")
_ALL = _COUNT.format("<[a-z][a-z0-9]*[^>]*>")
_PARAGRAPHS = _COUNT.format("<p>")
#: Selectors and the SQL of how many elements of a page they match.
PATTERNS = {
    "*": _ALL, "article, footer, nav": f"{_HAS.format('<article')} + {_HAS.format('<footer')} + {_HAS.format('<nav')}", "#main": _HAS.format("<article"), "#MAIN": "0", "ARTICLE": _HAS.format("<article"),
    "[data-kind='Blog Post']": _HAS.format("<article"), "[data-kind='blog post']": "0", "[data-kind='blog post' i]": _HAS.format("<article"), "[title]": _HAS.format("<article"), "[title='']": _HAS.format("<article"), "[title*='']": "0",
    "[class~=lead]": f"{_HAS.format('<article')} + {_HAS.format('<nav')}", "[class~=le]": "0", "[lang|=en]": f"{_HAS.format('<article')} + {_HAS.format('<html lang="en">')}", "a[href^='/']": f"len(list_filter({_HREFS}, lambda x: starts_with(x, '/')))",
    "a[href$='e']": f"len(list_filter({_HREFS}, lambda x: ends_with(x, 'e')))", "a[href*='th']": f"len(list_filter({_HREFS}, lambda x: contains(x, 'th')))", "a[href*='TH' i]": f"len(list_filter({_HREFS}, lambda x: contains(lower(x), 'th')))", ".wide.lead": _HAS.format("<article"), ".wide": f"{_HAS.format('<article')} + {_HAS.format('<footer')}",
    "li:first-child": _HAS.format("<li>"), "li:last-child": _HAS.format("<li>"), "li:only-child": f"({_ITEMS} = 1)::int", "li:nth-child(odd)": f"({_ITEMS} + 1) // 2", "li:nth-child(2n)": f"{_ITEMS} // 2", "li:nth-child(-n+3)": f"least({_ITEMS}, 3)", "li:nth-last-child(2)": f"({_ITEMS} > 1)::int",
    "head > :first-of-type": _COUNT.format("<meta") + " + " + _HAS.format("<title>") + " + " + _HAS.format("<style>") + " + " + _HAS.format("<script>"), "li:last-of-type": _HAS.format("<li>"), "footer:only-of-type": _HAS.format("<footer"), "li:nth-of-type(3n+1)": f"({_ITEMS} + 2) // 3", "li:nth-last-of-type(1)": _HAS.format("<li>"),
    ":root": "1", ":scope": "1", "br:empty": _COUNT.format("<br>"), "ul:empty": "0", ":is(h1, footer)": f"{_HAS.format('<h1>')} + {_HAS.format('<footer')}", ":where(nav, h1)": f"{_HAS.format('<nav')} + {_HAS.format('<h1>')}", "p:not(h1 + p)": f"greatest({_PARAGRAPHS} - 1, 0)", ":not(*)": "0",
    "h1 + p": f"least({_PARAGRAPHS}, 1)", "h1 ~ p": _PARAGRAPHS, "article > p": _PARAGRAPHS, "nav ul a": _COUNT.format("<a href"), "body:has(footer)": _HAS.format("<footer"), "ul:has(li)": _HAS.format("<li>"),
}
_LIST = ", ".join("{'s': '" + k.replace("'", "''") + "', 'n': (" + v + ")::bigint}" for k, v in PATTERNS.items())


@query(f"select page_id, x.s as selector, x.n as n from (select page_id, unnest([{_LIST}]) as x from (select page_id, {_DRESSED} as html from pages)) where x.n > 0")
def css_patterns(spark, d):
    """How many elements of each page every kind of selector matches."""
    nodes = _dressed_nodes(spark, d)
    parts = [selectors.select_all(nodes, s).groupBy(F.col("doc_id").alias("page_id")).agg(F.count("*").alias("n")).select("page_id", F.lit(s).alias("selector"), "n") for s in PATTERNS]
    return reduce(DataFrame.unionByName, parts)


_BAD = ("p::before", "p:unknown", "[a", "p >", "", ":nth-child(x)", "..x")


@query("select unnest([" + ", ".join(f"'{s}'" for s in _BAD) + "]) as selector, 'SelectorError' as error")
def css_errors(spark, d):
    """Selectors that are refused, not taken to match nothing."""

    def fault(s: str) -> str | None:
        try:
            selectors.parse_selector(s)
            return None
        except selectors.SelectorError as e:
            return type(e).__name__

    return spark.createDataFrame([(s, fault(s)) for s in _BAD], "selector string, error string")


@query(f"select page_id, {_PARAGRAPHS} as n_after, least({_PARAGRAPHS}, 1)::bigint as n_next from pages where {_PARAGRAPHS} > 0")
def css_siblings(spark, d):
    """Sibling combinators: paragraphs after the heading, and the one right after it."""
    nodes = _nodes(spark, d)
    after = selectors.select_all(nodes, "h1 ~ p").groupBy("doc_id").agg(F.count("*").alias("n_after"))
    next_ = selectors.select_all(nodes, "h1 + p").groupBy("doc_id").agg(F.count("*").alias("n_next"))
    return after.join(next_, "doc_id", "full_outer").select(F.col("doc_id").alias("page_id"), "n_after", "n_next")


# --- the document tree ---


@query("select kind, tag, count(*) as n from (select 'element' as kind, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[^>]*>', 1)) as tag from pages union all select 'comment', unnest(list_transform(regexp_extract_all(html, '<!--.*?-->'), lambda x: null::varchar)) from pages union all select 'doctype', null from pages where contains(html, '<!DOCTYPE') union all select 'document', null from pages) where tag is not null or kind <> 'element' group by 1, 2")
def dom_nodes(spark, d):
    """Nodes by kind and tag."""
    return _nodes(spark, d).where("kind <> 'text'").groupBy("kind", F.when(F.col("kind") == "element", F.col("tag")).alias("tag")).agg(F.count("*").alias("n"))


@query("select page_id, unnest(regexp_extract_all(html, '<!--(.*?)-->', 1)) as data from pages")
def dom_walk(spark, d):
    """A tree walker that shows comments."""
    return dom.walk(_nodes(spark, d), dom.SHOW["comment"]).select(F.col("doc_id").alias("page_id"), "data")


@query(f"select page_id, {_ITEMS}::bigint as n_items, 'comment' as after_nav, 'div' as before_article, 'li' as first_item, 'body' as above, {_COUNT.format('<a href')}::bigint as below, 'div' as next_element, 'ul' as last_of_nav from pages where contains(html, '<article>')")
def dom_navigation(spark, d):
    nodes = _nodes(spark, d)
    one = lambda s: selectors.select_all(nodes, s)
    nav, ul, article = one("nav"), one("ul"), one("article")
    first = lambda df, name, what="tag": df.groupBy("doc_id").agg(F.first(what).alias(name))
    parts = [
        dom.child_element_count(nodes, ul).select("doc_id", F.col("n").alias("n_items")), first(dom.next_sibling(nodes, nav), "after_nav", "kind"), first(dom.previous_sibling(nodes, article), "before_article"), first(dom.first_element_child(nodes, ul), "first_item"), first(dom.parent(nodes, article), "above"),
        dom.descendants(nodes, nav).where("tag = 'a'").groupBy("doc_id").agg(F.count("*").alias("below")), first(dom.next_element_sibling(nodes, nav), "next_element"), first(dom.last_element_child(nodes, nav), "last_of_nav"),
    ]
    return reduce(lambda a, b: a.join(b, "doc_id"), parts).withColumnRenamed("doc_id", "page_id")


@query(f"select page_id, {_COUNT.format('<a href')}::bigint as n_in_nav, {_ITEMS}::bigint as n_in_item, 0::bigint as n_matching_div, {_COUNT.format('<a href')}::bigint as n_matching, {_COUNT.format('<a href')}::bigint as n_scoped, {_COUNT.format('<a href')}::bigint as n_by_tag, 1::bigint as n_by_class from pages where contains(html, '</ul>')")
def dom_queries(spark, d):
    """closest, matches, queries from an element, and elements by tag and class."""
    nodes = _nodes(spark, d)
    links = dom.by_tag(nodes, "a")
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    hits = dom.matches(nodes, links, "li > a[href]").groupBy("doc_id").agg(F.count_if("matches").alias("n_matching"))
    none = dom.matches(nodes, links, "div a").groupBy("doc_id").agg(F.count_if("matches").alias("n_matching_div"))
    parts = [count(selectors.closest(nodes, links, "nav"), "n_in_nav"), selectors.closest(nodes, links, "li").groupBy("doc_id").agg(F.count_distinct("closest_id").alias("n_in_item")), none, hits, count(dom.select_within(nodes, selectors.select_all(nodes, "ul"), "nav a"), "n_scoped"), count(links, "n_by_tag"), count(dom.by_class(nodes, "ad"), "n_by_class")]
    closed = selectors.select_all(nodes, "article").select("doc_id").distinct()
    return reduce(lambda a, b: a.join(b, "doc_id"), parts).join(closed, "doc_id", "left_semi").withColumnRenamed("doc_id", "page_id")


@query("""select page_id, ['post', 'lead', 'wide', 'new'] as added, ['post', 'wide'] as removed, ['post', 'wide'] as toggled, true as has_post, 'Blog Post' as kind, 'blue' as color, '1px' as width, 'url(data:image/png;base64,AA==)' as background, 'main' as id from pages where contains(html, '<article>')""")
def dom_attributes(spark, d):
    """classList, dataset, style and the element with an id."""
    c, s = F.col("classes"), dom.style(F.col("attr_map"))
    return dom.by_id(_dressed_nodes(spark, d), "main").select(F.col("doc_id").alias("page_id"), dom.class_add(c, "new").alias("added"), dom.class_remove(c, "lead").alias("removed"), dom.class_toggle(c, "lead").alias("toggled"), dom.class_contains(c, "post").alias("has_post"), F.element_at(dom.dataset(F.col("attr_map")), "kind").alias("kind"), s["color"].alias("color"), s["width"].alias("width"), s["background"].alias("background"), F.col("elem_id").alias("id"))


@query("select page_id, trim(regexp_replace(" + _UNESCAPED.format("regexp_extract(html, '<title>(.*?)</title>', 1)") + r", '\s+', ' ', 'g')) as title, " + f"{_COUNT.format('<a href')}::bigint as n_links, 0::bigint as n_images, 0::bigint as n_forms, {_COUNT.format('<script')}::bigint as n_scripts, true as in_order from pages")
def dom_document(spark, d):
    doc = dom.document(_nodes(spark, d))
    return doc.select(F.col("doc_id").alias("page_id"), "title", "n_links", "n_images", "n_forms", "n_scripts", ((F.col("html") < F.col("head")) & (F.col("head") < F.col("body"))).alias("in_order"))


@query("""select page_id, 'attributes' as type, 'h1' as tag, 'class' as attribute, null as old_value, 'x' as new_value from pages where contains(html, '<h1>') union all select page_id, 'characterData', null, null, ' ad ' || page_id || ' ', ' note ' || page_id || ' ' from pages where contains(html, '<!-- ad ')""")
def dom_mutations(spark, d):
    """The records of what differs between the pages and a changed snapshot of them."""
    pages = _t(spark, d, "pages")
    changed = pages.withColumn("html", F.replace(F.replace("html", F.lit("<h1>"), F.lit('<h1 class="x">')), F.lit("<!-- ad "), F.lit("<!-- note ")))
    found = dom.mutations(_nodes(spark, d), written(parse_pages(changed), "nodes"))
    return found.select(F.col("doc_id").alias("page_id"), "type", "tag", "attribute", "old_value", "new_value")


# --- styles ---

SHEET = "p { margin: 0 } article p { color: navy; margin: 1px } body { color: black } nav, .ad { color: gray } h1 { font-size: 2em !important } @media print { p { margin: 9px } } @media (min-width: 600px) and (max-width: 2000px) { ul { --gap: 4px; padding: var(--gap, 1px) } } h1 { font-size: 1em } /* p { color: red } */ li::marker { color: red }"
_TAGS = "sum(len(regexp_extract_all(html, '<{}[ >]')))"
_STYLES = {
    ("margin", "1px"): _TAGS.format("p"), ("color", "navy"): f"{_TAGS.format('p')} + {_TAGS.format('b')} + {_TAGS.format('br')}", ("color", "gray"): " + ".join(_TAGS.format(t) for t in ("nav", "ul", "li", "a", "div")),
    ("color", "black"): " + ".join(_TAGS.format(t) for t in ("body", "article", "h1", "footer")), ("font-size", "2em"): _TAGS.format("h1"), ("--gap", "4px"): " + ".join(_TAGS.format(t) for t in ("ul", "li", "a")), ("padding", "4px"): _TAGS.format("ul"),
}


@query("select property, value, n::bigint as n from (" + " union all ".join(f"select '{p}' as property, '{v}' as value, {n} as n from pages" for (p, v), n in _STYLES.items()) + ")")
def css_computed_style(spark, d):
    """A sheet's cascade over all pages, inherited and with var() resolved: how often each property takes each value."""
    styles = written(css.computed_style(_nodes(spark, d), SHEET), "styles")
    return css.resolve_vars(styles).unionByName(styles.where(F.col("property").startswith("--"))).groupBy("property", "value").agg(F.count("*").alias("n"))


@query("""select page_id, 'article' as tag, 'color' as property, 'blue' as value from dressed where contains(html, '<article') union all select page_id, 'article', 'width', '9px' from dressed where false union all select page_id, 'article', 'width', '1px' from dressed where contains(html, '<article')
union all select page_id, 'article', 'background', 'url(data:image/png;base64,AA==)' from dressed where contains(html, '<article') union all select page_id, 'footer', 'text-align', 'center' from dressed where contains(html, '<footer')""".replace("dressed", f"(select page_id, {_DRESSED} as html from pages)"))
def css_inline_style(spark, d):
    """Inline declarations beat important rules; presentation hints give way to every rule."""
    nodes = _dressed_nodes(spark, d)
    styles = css.computed_style(nodes, "article { color: green !important; width: 9px !important }")
    own = nodes.where("tag in ('article', 'footer')").select("doc_id", "node_id", "tag")
    wanted = (F.col("tag") == "article") & F.col("property").isin("color", "width", "background") | (F.col("tag") == "footer") & (F.col("property") == "text-align")
    return styles.join(own, ["doc_id", "node_id"]).where(wanted).select(F.col("doc_id").alias("page_id"), "tag", "property", "value")


# --- extraction ---

_ARTICLE = "regexp_extract(html, '<article>(.*?)(</article>|$)', 1, 's')"
_BODY = "regexp_extract(html, '<body>(.*?)(</body>|$)', 1, 's')"
_SIZE = lambda part: "length(" + _UNESCAPED.format(f"regexp_replace({part}, '<!--.*?-->|<[^>]*>|<[^>]*$', '', 'gs')") + ")"
_LINKED_SIZE = "coalesce(list_sum(list_transform(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)', 1), lambda x: length(" + _UNESCAPED.format("x") + "))), 0)"
_POINTS = "30 * len(regexp_extract_all(html, '<p>')) + 20 * len(regexp_extract_all(html, '<h1>'))"
#: The article is the content where it is long enough and beats the body, which counts all text that is not a link's.
_WINS = f"{_SIZE(_ARTICLE)} >= 100 and ({_LINKED_SIZE} > 0.5 * {_SIZE(_BODY)} or ({_SIZE(_ARTICLE)} + {_POINTS}) * 1.5 > {_SIZE(_BODY)} - {_LINKED_SIZE} + {_POINTS})"
_ROOT = f"case when {_WINS} then {_ARTICLE} else regexp_replace({_BODY}, '<nav>.*?</nav>|<!--.*?-->', '', 'gs') end"
_BLOCKS = f"regexp_replace(regexp_replace(regexp_replace({_ROOT}, '</?(p|h1|article|footer|div)[^>]*>', chr(10) || chr(10), 'g'), '<br>', chr(10), 'g'), '</?b>|<[^>]*$', '', 'g')"
_PLAIN = f"trim(regexp_replace(regexp_replace(regexp_replace({_UNESCAPED.format(_BLOCKS)}, '[ \\t]*\\n[ \\t]*\\n\\s*', chr(1), 'g'), '\\s+', ' ', 'g'), ' ?\\x01 ?', chr(10) || chr(10), 'g'), ' ' || chr(10))"


@query(f"select page_id, plain_text, len(list_filter(string_split_regex(plain_text, '\\s+'), lambda x: x <> ''))::int as word_count, null::varchar as byline, null::varchar as published_at, null::varchar as hero_image, 0 as n_images, 0 as n_links, null::varchar as error from (select page_id, {_PLAIN} as plain_text from pages)")
def article_texts(spark, d):
    """The content root's text without noise, its words, and what the pages do not have."""
    got = skim(_t(spark, d, "pages"))
    return got.select("page_id", "plain_text", "word_count", "byline", "published_at", "hero_image", F.size("images").alias("n_images"), F.size("links").alias("n_links"), "error")


_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
_LINKED = f"""with l as (select page_id, {_ORIGIN} as origin, unnest(range(len({_HREFS}))) as i, {_HREFS} as hs, regexp_extract_all(html, '<a href="[^"]*">([^<]*)', 1) as ts from pages),
r as (select page_id, i, origin || '/' || replace(replace(replace(url_encode(substr(hs[i + 1], 2)), '%2C', ','), '%27', ''''), '%21', '!') as href, {_UNESCAPED.format('ts[i + 1]')} as text from l),
f as (select *, row_number() over (partition by page_id, href order by i) as k from r)"""


@query(f"""select page_id, url, {_UNESCAPED.format("trim(regexp_extract(html, '<title>(.*?)</title>', 1))")} as title, null::varchar as byline, null::varchar as published_at, regexp_extract(html, '<html lang="([^"]*)"', 1) as lang, regexp_extract(url, '^https?://([^/:?#]+)', 1) as site_name, null::varchar as description, null::varchar as hero_image,
len(list_filter(string_split_regex(plain, '\\s+'), lambda x: x <> ''))::int as word_count, plain as plain_text, null::varchar as error from (select *, {_PLAIN} as plain from pages)""")
def articles(spark, d):
    return skim(_t(spark, d, "pages")).drop("images", "links", "nav_links", "content_root")


@query(_LINKED + " select page_id, (row_number() over (partition by page_id order by i) - 1)::int as pos, href, text from f where k = 1 and text <> ''")
def article_links(spark, d):
    """The navigation's links: resolved, the first of each address, with their labels."""
    return skim(_t(spark, d, "pages")).select("page_id", F.posexplode("nav_links").alias("pos", "link")).select("page_id", "pos", "link.href", "link.text")


_REST = f"regexp_replace(regexp_extract({_ARTICLE}, '</h1>(.*)$', 1, 's'), '</p>|</b>|<[^>]*$', '', 'g')"
_PARTS = f"list_transform(string_split({_REST}, '<p>')[2:], lambda x: {{'bold': starts_with(x, '<b>'), 'line': contains(x, '<br>'), 'text': {_UNESCAPED.format("replace(replace(x, '<b>', ''), '<br>', '')")}}})"
_FOOTER = _UNESCAPED.format("regexp_replace(regexp_extract(html, '<footer>(.*?)(</footer>|$)', 1, 's'), '<[^>]*$', '')")
_AD = _UNESCAPED.format("regexp_extract(html, '<div class=\"ad\">([^<]*)', 1)")
_SAFE = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_MARKED = "trim(regexp_replace(regexp_replace({}, '\\s+', ' ', 'g'), '([\\\\`*_\\[\\]])', '\\\\\\1', 'g'))"
_RENDERED = f"""with t as (select page_id, url, {_WINS} as wins, {_UNESCAPED.format("regexp_extract(html, '<title>(.*?)</title>', 1)")} as title, {_UNESCAPED.format(f"regexp_extract({_ARTICLE}, '<h1>(.*?)</h1>', 1)")} as head, {_PARTS} as ps, {_FOOTER} as footer, {_AD} as ad, contains(html, '<footer>') as has_footer from pages)"""


_HTML = _RENDERED + f""", a as (select *, '<article><h1>' || {_SAFE.format('head')} || '</h1>' || array_to_string(list_transform(ps, lambda x: '<p>' || case when x.bold then '<b>' else '' end || {_SAFE.format('x.text')} || case when x.line then '<br>' else '' end || case when x.bold then '</b>' else '' end || '</p>'), '') || '</article>' as body from t)
select page_id, '<h1>' || {_SAFE.format('trim(title)')} || '</h1>' || case when wins then body else '<div>' || {_SAFE.format('ad')} || '</div>' || body || {_SAFE.format('footer')} end as html from a"""
_MARKDOWN = _LINKED + f""", nav as (select page_id, array_to_string(list('| [' || replace(text, '|', '\\') || '](' || href || ') |' order by i), chr(10)) as rows from f where k = 1 and text <> '' group by 1), {_RENDERED[5:]},
b as (select *, list_filter(list_transform(ps, lambda x: case when {_MARKED.format('x.text')} = '' then '' when x.bold then '**' || {_MARKED.format('x.text')} || '**' else {_MARKED.format('x.text')} end), lambda x: x <> '') as lines from t)
select b.page_id, array_to_string(list_filter(list_concat(['# ' || trim(title), 'on _' || regexp_extract(url, '^https?://([^/:?#]+)', 1) || '_ • [source](' || url || ')', case when rows is null then '' else '| Navigation |' || chr(10) || '| --- |' || chr(10) || rows end, case when wins then '' else {_MARKED.format('ad')} end, '# ' || {_MARKED.format('head')}], lines, [case when wins then '' else {_MARKED.format('footer')} end]), lambda x: x <> ''), chr(10) || chr(10)) || chr(10) as markdown from b left join nav on nav.page_id = b.page_id"""


@query(f"select m.page_id, markdown, html, null::varchar as error from ({_MARKDOWN}) m join ({_HTML}) h on h.page_id = m.page_id")
def article_renderings(spark, d):
    """Title, source, navigation and content as Markdown; allowed elements and escaped text as HTML."""
    return skim(_t(spark, d, "pages"), renders=("markdown", "html")).select("page_id", "markdown", "html", "error")


@query(f"""select page_id, url, {_UNESCAPED.format("trim(regexp_extract(html, '<title>(.*?)</title>', 1))")} as title, regexp_extract(html, '<html lang="([^"]*)"', 1) as lang, regexp_extract(url, '^https?://([^/:?#]+)', 1) as site, null::varchar as byline, len(list_filter(string_split_regex(plain, '\\s+'), lambda x: x <> ''))::int as words, plain as text, '[]' as images from (select *, {_PLAIN} as plain from pages)""")
def article_json(spark, d):
    """The JSON record, read back member by member."""
    get = lambda path: F.get_json_object("json", path)
    return skim(_t(spark, d, "pages"), renders=("json",)).select("page_id", get("$.url").alias("url"), get("$.title").alias("title"), get("$.lang").alias("lang"), get("$.siteName").alias("site"), get("$.byline").alias("byline"), get("$.wordCount").cast("int").alias("words"), get("$.plainText").alias("text"), get("$.images").alias("images"))


_META = '<meta property="og:title" content=" Card &amp; title "><meta name="Author" content="A. Writer"><meta name="description" content="Told"><meta property="og:image" content="/i/a.png"><meta name="twitter:title" content="other"><meta itemprop="datePublished" content="2024-01-02"><meta property="og:site_name" content="Site"><title>'
_INSIDE = '<article><img src="/p/1.jpg" alt="one"><p><a href="/in?a=1#f">In</a> <a href="/in?a=1#f">Again</a><a href="#x">no</a><a href="mailto:a@b">no</a></p>'


@query(f"select page_id, 'Card & title' as title, 'A. Writer' as byline, '2024-01-02' as published_at, 'Told' as description, 'Site' as site_name, {_ORIGIN} || '/i/a.png' as hero_image, [{_ORIGIN} || '/p/1.jpg'] as images, [{_ORIGIN} || '/in?a=1#f'] as links, ['In'] as labels from pages")
def article_cards(spark, d):
    """What meta elements tell, and the links and images of the content, on pages that are given some."""
    pages = _t(spark, d, "pages").withColumn("html", F.replace(F.replace("html", F.lit("<title>"), F.lit(_META)), F.lit("<article>"), F.lit(_INSIDE)))
    take = lambda c, f: F.transform(c, lambda x: x[f])
    return skim(pages).select("page_id", "title", "byline", "published_at", "description", "site_name", "hero_image", take("images", "src").alias("images"), take("links", "href").alias("links"), take("links", "text").alias("labels"))


@query(f"select page_id, n_items, plain_text from (select page_id, {_ITEMS}::int as n_items, array_to_string(list_filter(list_transform(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)', 1), lambda x: trim({_UNESCAPED.format('x')})), lambda x: x <> ''), chr(10) || chr(10)) as plain_text from pages)")
def selection_texts(spark, d):
    """The crawl's selector projection: the texts of the matches, collapsed and joined."""
    return selections(_t(spark, d, "pages"), ["nav li"]).select("page_id", F.col("selections")[0]["match_count"].alias("n_items"), "plain_text")


@query("select page_id, '{\"pageId\":' || page_id || ',\"siteHost\":\"' || regexp_extract(url, '^https?://([^/:?#]+)', 1) || '\"}' as line from pages")
def jsonl_lines(spark, d):
    """Records as the JSON-lines sink writes them: camelCase names, absent values left out."""
    rows = _t(spark, d, "pages").select("page_id", F.lit(None).cast("string").alias("no_value"), urls.hostname(F.col("url")).alias("site_host"))
    return rows.select("page_id", F.to_json(F.struct(*(F.col(c).alias(camel(c)) for c in rows.columns)), {"ignoreNullFields": "true"}).alias("line"))


@query("""select page_id, case page_id % 5 when 0 then 'HTTP 404' when 1 then 'empty response' when 2 then 'not HTML' end as error from pages""")
def fetch_errors(spark, d):
    """Error rows of responses: a bad status, no body, another kind of content."""
    k = F.col("page_id") % 5
    body = F.when(k == 1, F.lit(None)).when(k == 2, F.encode(F.lit("%PNG"), "UTF-8")).otherwise(F.encode("html", "UTF-8"))
    got = _t(spark, d, "pages").select("page_id", F.col("page_id").cast("string").alias("url"), F.when(k == 0, 404).otherwise(200).alias("status"), F.when(k == 2, "image/png").when(k == 3, None).otherwise("text/html").alias("content_type"), body.alias("body"))
    return page_errors(got).select(F.col("url").cast("long").alias("page_id"), "error")


# --- crawl and search ---


@query(_LINKED + r""", s as (select page_id, regexp_replace(url, '#.*$', '') as url, lower(regexp_replace(url, '#.*$', '')) as key from pages), s1 as (select key, min(url) as url from s group by 1),
w as (select key, min(struct_pack(u := url, p := page_id)).p as page_id from (select key, pages.url, pages.page_id from s join pages using (page_id)) group by 1),
n as (select distinct lower(f.href) as key from f join w on w.page_id = f.page_id where f.k = 1)
select key, 0 as depth from s1 union all select key, 1 from n where key not in (select key from s1)""")
def crawl_own_links(spark, d):
    """A crawl from all pages along their own links, one level deep: every address once, at its least depth."""
    ensure_checkpoint_dir(spark)
    web = written(skim(_t(spark, d, "pages"), all_links=True).select("url", "page_links", "error"), "web")
    reached = crawling.crawl(web.select("url"), web, crawling.CrawlOptions(max_pages=10_000_000, max_depth=1))
    return reached.select("key", "depth")


@query(r"""select lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) as host, page_id, ((row_number() over (partition by lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) order by page_id) - 1) * 250)::bigint as start_ms, case when page_id % 2 = 1 then 'not found' end as error
from pages""")
def crawl_schedule(spark, d):
    """When a polite crawl asks for each address, and what it finds where half of the pages are gone."""
    pages = _t(spark, d, "pages")
    frontier = pages.select(F.concat("url", F.lit("&id="), "page_id").alias("url"), F.col("page_id").alias("ord"), "page_id").withColumn("key", urls.crawl_key(F.regexp_replace("url", "#", "")))
    there = pages.where("page_id % 2 = 0").select(F.regexp_replace(F.concat("url", F.lit("&id="), "page_id"), "#", "").alias("url"))
    return crawling.with_pages(crawling.polite_schedule(frontier), there).select("host", "page_id", "start_ms", "error")


_PAYLOADS = {"github": ("items", "html_url", "full_name"), "gdelt": ("articles", "url", "title"), "stackexchange": ("items", "link", "title")}


def _payloads(spark, d) -> DataFrame:
    """Answers of three providers, which list the pages."""
    parts = []
    for k, (provider, (path, url, title)) in enumerate(_PAYLOADS.items()):
        rows = _t(spark, d, "pages").where(F.col("page_id") % 3 == k)
        items = F.array_sort(F.collect_list(F.struct(F.col("page_id").alias("n"), F.struct(F.col("url").alias(url), F.concat(F.lit("page "), "page_id").alias(title)).alias("i"))))
        parts.append(rows.agg(items.alias("l")).select(F.lit(provider).alias("provider"), F.to_json(F.struct(F.transform("l", lambda x: x["i"]).alias(path))).alias("payload")))
    return reduce(DataFrame.unionByName, parts).unionByName(spark.createDataFrame([("crossref", "broken {"), ("mojeek", "")], "provider string, payload string"))


_HITS = """with h as (select page_id, url, page_id % 3 as k, (row_number() over (partition by page_id % 3 order by page_id) - 1)::int as rank from pages), n as (select *, case k when 0 then 'github' when 1 then 'gdelt' else 'stackexchange' end as source from h)"""


@query(_HITS + " select source, rank, url, 'page ' || page_id as title from n")
def search_fan_in(spark, d):
    """The hits of all providers; a broken answer gives none."""
    return search.fan_in(_payloads(spark, d), search.flags_of("github", "stackexchange", "news", "crossref", "mojeek")).select("source", "rank", "url", "title")


@query(_HITS + """, t as (select *, row_number() over (partition by lower(regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '')) order by case k when 0 then 1 when 2 then 2 else 3 end, rank) as m from n where rank < 5)
select source, rank, url from t where m = 1""")
def search_bundles(spark, d):
    """A search over bundles of providers, five hits of each, merged."""
    return search.search(_payloads(spark, d), "news", "community", per_provider=5).select("source", "rank", "url")


@query(_HITS + """, t as (select *, row_number() over (partition by lower(regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '')) order by case k when 0 then 1 when 2 then 2 else 3 end, rank) as m from n where rank < 10),
s as (select *, row_number() over (order by case k when 0 then 1 when 2 then 2 else 3 end, rank) as o from t where m = 1)
select regexp_replace(url, '#.*$', '') as url, o as ord, 0 as depth, source, rank, page_id % 2 = 0 as there from s where o <= 12""")
def search_crawl(spark, d):
    """Search, then a crawl from the first hits, each row with the hit that led to it; half of the pages are gone."""
    ensure_checkpoint_dir(spark)
    pages = _t(spark, d, "pages").where("page_id % 2 = 0").select("url", F.array().cast("array<string>").alias("page_links"))
    got = search.search_and_crawl(_payloads(spark, d), pages, "github", "stackexchange", "gdelt", max_crawled=12)
    return got.select("url", "ord", "depth", F.col("search.source").alias("source"), F.col("search.rank").alias("rank"), F.col("error").isNull().alias("there"))


@query("select 1 as per_provider, 200 as max_crawled, 5 as max_depth, 50 as max_pages, 8 as parallel, 16383 as every, 1792 as web")
def search_options(spark, d):
    """Options within their bounds, and bundles as bits."""
    o = search.options(per_provider=0, max_crawled=999, max_depth=7)
    return spark.createDataFrame([(*o.values(), search.flags_of("all"), search.flags_of("web"))], ", ".join(f"{k} int" for k in (*o, "every", "web")))


# --- usage and storage ---


def _keys(spark, d) -> DataFrame:
    c = _t(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("account_id"), F.col("c_nationkey").cast("string").alias("user_id"), F.md5("c_name").alias("token_hash"), (F.col("c_acctbal") < 0).alias("is_revoked"), F.timestamp_seconds(F.col("c_custkey") * 86400).alias("created"), F.when(F.col("c_custkey") % 3 == 0, F.timestamp_seconds(F.col("c_custkey") * 100000)).alias("expires"))


@query("select count(*) as active from customer where not c_acctbal < 0 and (c_custkey % 3 <> 0 or to_timestamp(c_custkey * 100000) > timestamptz '1970-01-10 00:00:00+00')")
def usage_active_keys(spark, d):
    return usage.active_keys(_keys(spark, d), F.timestamp_seconds(F.lit(9 * 86400)))


@query("select c_custkey as id from customer where c_mktsegment = 'BUILDING' and c_nationkey = 3 and not c_acctbal < 0")
def usage_live_keys(spark, d):
    return usage.live_keys(_keys(spark, d), "BUILDING", "3").select("id")


@query("select c_custkey as id from customer where md5(c_name) = md5((select min(c_name) from customer where c_acctbal >= 0)) and not c_acctbal < 0")
def usage_key_by_hash(spark, d):
    name = _t(spark, d, "customer").where("c_acctbal >= 0").agg(F.min("c_name").alias("n")).first().n
    return usage.key_by_hash(_keys(spark, d), spark.sql("select md5(:n) as h", args={"n": name}).first().h).select("id")


@query("select floor(avg(event_id % 500))::int as avg_latency from (select event_id from events order by ts desc, event_id limit 100)")
def usage_latency(spark, d):
    return usage.latency_of_latest(_t(spark, d, "events").withColumn("duration_ms", F.col("event_id") % 500))


@query("select user_id, case when n < 1024 then n || ' B' when n < 1048576 then format('{:.1f} KB', round(n / 1024.0, 1)) else format('{:.1f} MB', round(n / 1048576.0, 1)) end as size from (select user_id, count(*) * count(*) * 37 as n from events group by 1)")
def usage_bytes(spark, d):
    n = _t(spark, d, "events").groupBy("user_id").agg((F.count("*") * F.count("*") * 37).alias("n"))
    return n.select("user_id", usage.bytes_text(F.col("n")).alias("size"))


def _store(spark, d, where: str) -> DataFrame:
    e = _t(spark, d, "events").where(where)
    return e.select(F.lit("app").alias("db"), F.col("event_type").alias("store"), F.col("event_id").alias("seq"), F.concat(F.lit("u"), "user_id").alias("key"), F.col("props").alias("value"))


_STORED = """with r as (select event_type as store, event_id as seq, 'u' || user_id as key, props as value from events), o as (select store, key, min(seq) filter (seq % 2 = 0) as old_seq, max(seq) filter (seq % 2 = 0) as old_last, max(seq) filter (seq % 2 = 1) as new_last from r group by 1, 2)"""


@query(_STORED + ", v as (select o.store, o.key, coalesce(old_last, new_last) as seq, coalesce(new_last, old_last) as from_seq from o) select v.store, v.key, v.seq, r.value from v join r on r.seq = v.from_seq")
def storage_put(spark, d):
    """Upserts: a key keeps its place and takes the last value written."""
    table = storage.put(_store(spark, d, "false"), _store(spark, d, "event_id % 2 = 0"))
    return storage.put(table, _store(spark, d, "event_id % 2 = 1")).select("store", "key", "seq", "value")


@query(_STORED + ", k as (select store, key from o where old_last is not null) select 'click' as store, count(*) as n from k where store = 'click' union all select 'error', 0 union all select 'view', count(*) - count(*) filter (key = 'u1') from k where store = 'view'")
def storage_reads(spark, d):
    """count, clear and delete."""
    table = storage.put(_store(spark, d, "false"), _store(spark, d, "event_id % 2 = 0"))
    counted = lambda t, s: storage.count(t, "app", s).select(F.lit(s).alias("store"), "n")
    return counted(table, "click").unionByName(counted(storage.clear(table, "app", "error"), "error")).unionByName(counted(storage.delete(table, "app", "view", "u1"), "view"))


@query("select props as value from events where event_id = (select max(event_id) from events where user_id = (select min(user_id) from events))")
def storage_local(spark, d):
    """setItem and getItem: the last value of a key."""
    e = _t(spark, d, "events")
    items = e.select(F.lit("http://h").alias("db"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"))
    table = storage.set_item(_store(spark, d, "false"), items)
    least = e.agg(F.min("user_id").cast("string").alias("k")).first().k
    return storage.get_item(storage.remove_item(table, "http://h", "none"), "http://h", least)


@query("select p_partkey, trim(p_name) as name, p_retailprice as price, true as same from part where p_size > 10 and p_brand like '%1%'")
def text_selection(spark, d):
    """Column functions over another table: the library does not know where its columns come from."""
    p = _t(spark, d, "part").where((F.col("p_size") > 10) & js.includes(F.col("p_brand"), "1"))
    return p.select("p_partkey", js.trim(F.col("p_name")).alias("name"), F.col("p_retailprice").alias("price"), js.strict_equal(F.col("p_retailprice"), F.col("p_retailprice")).alias("same"))


# --- the parser ---


@query("select page_id, regexp_extract(html, '<script>(.*?)</script>', 1, 's') as script, regexp_extract(html, '<style>(.*?)</style>', 1, 's') as style, " + _UNESCAPED.format("regexp_extract(html, '<footer>(.*?)</footer>', 1, 's')") + " as footer, 1::bigint as n_texts, (" + _PARAGRAPHS + ")::bigint as n_paragraphs, 0::bigint as n_nested from pages where contains(html, '</footer>')")
def html_texts(spark, d):
    """Raw text of scripts and styles, character references, merged text, and paragraphs that close one another."""
    nodes = _nodes(spark, d)
    text = lambda s, name: selectors.text_content(nodes, selectors.select_all(nodes, s)).select("doc_id", F.col("text").alias(name))
    footer = selectors.select_all(nodes, "footer")
    texts = dom.child_nodes(nodes.where("kind = 'text'"), footer).groupBy("doc_id").agg(F.count("*").alias("n_texts"))
    nested = selectors.select_all(nodes, "p p").groupBy("doc_id").agg(F.count("*").alias("n"))
    paragraphs = dom.by_tag(nodes, "p").groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"))
    closed = _t(spark, d, "pages").where(F.col("html").contains("</footer>")).select(F.col("page_id").alias("doc_id"))
    parts = [closed, text("script", "script"), text("style", "style"), text("footer", "footer"), texts, paragraphs]
    got = reduce(lambda a, b: a.join(b, "doc_id"), parts).join(nested, "doc_id", "left")
    return got.select(F.col("doc_id").alias("page_id"), "script", "style", "footer", "n_texts", "n_paragraphs", F.coalesce("n", F.lit(0)).cast("long").alias("n_nested"))


@query(r"""select page_id, '<nav><ul>' || regexp_extract(html, '<nav><ul>(.*?)</ul></nav>', 1) || '</ul></nav>' as html from pages""")
def html_serialized(spark, d):
    """outerHTML of the navigation: what was read, written again."""
    from pageloom.operators.render import serialize
    from pageloom.sources.html import parse

    @F.pandas_udf("string")
    def nav(pages):
        out = []
        for h in pages:
            p = parse(h or "")
            at = next((k for k in range(len(p.kind)) if p.tag[k] == "nav"), None)
            out.append(None if at is None else serialize(p, at))
        return pages.__class__(out, dtype=object)

    return _t(spark, d, "pages").select("page_id", nav("html").alias("html"))
