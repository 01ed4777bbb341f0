"""HTML extraction by site template removal.

What a site repeats at one place of its pages is not the article: menus, headers, footers, sidebars and notices.  Every
element subtree is hashed (tag, class, text and children) and named with its place (the path of tags and class words from
the root).  Spark counts, per host, on how many different pages each hash stands at its place, and deletes it there

- if it stands on at least ``MIN_SHARE`` of the host's pages that have the place, or
- if the place rotates: at least ``MIN_SHARE`` of all that the host's pages have there recurs, as with a menu or an
  advert drawn from some versions.  Only containers go by this; single paragraphs, list items and cells do not.

Both rules are shares, alike on hosts of any size; what stands on one page only is no template.  Headings are never
templates by themselves.  Inside ``article`` and ``main`` recurrence proves nothing (recipes all say "Method"), so there only
subtrees go of which half of the text are links.  Pages with the same body count once, so copies of one page do not turn
its text into a template.

What a host shows too rarely to be counted (a page of its own, an advert that changes) is left to the
element's own name and class words: navigation, forms, adverts, reader comments and the like
(``by_words=False`` leaves these rules out).

The counts leave Spark only as the hashes of the templates.  Up to ``SEND_LIMIT`` of them (8 bytes
each) are sent to the tasks; beyond that each page is joined with its own templates instead.

Defined results: NULL or empty html gives an empty text; a NULL url or one without a host is one
host of its own (the empty one); broken or cut off html is read as far as it goes; a page of any length
is read whole; repeated rows each get their row; an empty table gives no rows; other columns are
ignored whatever their names.  Known limit: on a host where near copies of one page are most of all pages,
their shared paragraphs outside of ``article`` and ``main`` are templates.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_tree import INLINE, Node, blocks, parse, walk
from .tables import KEY, staged

#: share of the pages with a place on which a template stands there
MIN_SHARE = 0.5
#: most template hashes sent to the tasks (8 bytes each)
SEND_LIMIT = 2_000_000

# fixed values: elements and class words that mark what is no article
NOT_ARTICLE = frozenset("nav footer aside form button select dialog menu svg canvas object audio video figure-toolbar fieldset head".split())
NOT_ARTICLE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "cookie cookies consent notice notices alert popup modal overlay share sharing social related recommended comments comment disqus respond reply "
    "newsletter subscribe subscription footer contentinfo complementary search toolbar widget skip pagination".split()
)
ARTICLE = ("article", "main")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: blocks that are no containers
PIECES = frozenset("p li dt dd td th tr caption figcaption blockquote pre address summary legend".split())

_HOST = re.compile(r"://([^/?#]*)")


def host_of(url: str | None) -> str:
    m = _HOST.search(url or "")
    return m[1].lower() if m else ""


def _marked(node: Node) -> bool:
    return node.tag in NOT_ARTICLE or node.tag not in INLINE and node.tag not in ("html", "body", *ARTICLE) and bool(node.words & NOT_ARTICLE_WORDS)


def _in_article(node: Node) -> bool:
    while node is not None:
        if node.tag in ARTICLE:
            return not node.words & NOT_ARTICLE_WORDS
        node = node.parent
    return False


def _signed(h: int) -> int:
    return h - (1 << 63)


def _host_hash(host: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(host.encode("utf-8", "surrogatepass")))


def template_hash(host: str, node: Node) -> int:
    """One number for a subtree at its place on a host."""
    return _signed(xxhash.xxh3_64_intdigest(host.encode("utf-8", "surrogatepass") + b"\0" + node.place.to_bytes(8, "little") + node.digest.to_bytes(8, "little")))


def countable(node: Node) -> bool:
    """Subtrees that can be a template: blocks with text, no headings; in an article mostly links."""
    if not node.n_text or node.tag in INLINE or node.tag in HEADINGS or node.tag in ("#root", "html", "body", "head", *ARTICLE):
        return False
    return 2 * node.n_link >= node.n_text or not _in_article(node)


def _body(root: Node) -> int:
    """Names a page by the text of its articles, or of its whole body."""
    main = [x for x in walk(root) if x.tag in ARTICLE] or [x for x in walk(root) if x.tag == "body"] or [root]
    return _signed(xxhash.xxh3_64_intdigest("\n".join(b for x in main for b in blocks(x, lambda _: False)).encode("utf-8", "surrogatepass")))


def _subtrees(batches):
    """(host, place, template, piece, page) of each page's subtrees; a NULL template stands for the place itself."""
    for batch in batches:
        columns: dict[str, list] = {"host": [], "place": [], "template": [], "piece": [], "page": []}
        for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            host = host_of(url)
            root = parse(source or "")
            found = {(_signed(x.place), template_hash(host, x), x.tag in PIECES) for x in walk(root) if countable(x)}
            found |= {(place, None, piece) for place, _, piece in found}
            for name, values in zip(columns, ([_host_hash(host)] * len(found), *(zip(*found) if found else ((), (), ())), [_body(root)] * len(found))):
                columns[name].extend(values)
        kinds = {"piece": pa.bool_()}
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in columns.items()], names=list(columns))


def site_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_share: float = MIN_SHARE) -> DataFrame:
    """(template) hashes of the subtrees that recur at their place across the pages of their host."""
    rows = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    each = rows.mapInArrow(_subtrees, "host long, place long, template long, piece boolean, page long").distinct()
    n = staged(each.groupBy("host", "place", "template", "piece").agg(F.count(F.lit(1)).alias("n")), "subtrees")
    of_place = n.groupBy("host", "place").agg(
        F.sum(F.when(F.col("template").isNull(), F.col("n"))).alias("pages"),
        F.sum(F.when(F.col("template").isNotNull(), F.col("n"))).alias("all"),
        F.sum(F.when(F.col("template").isNotNull() & (F.col("n") > 1), F.col("n"))).alias("again"),
    )
    found = n.where("template is not null and n > 1").join(of_place, ["host", "place"])
    often = F.col("n") >= F.col("pages") * min_share
    rotates = ~F.col("piece") & (F.col("again") >= F.col("all") * min_share)
    return found.where(often | rotates).select("template")


def extract(source: str | None, host: str, templates, by_words: bool = True) -> str:
    """The article of one page; ``templates(hash)`` says whether a subtree is a template."""
    if not source:
        return ""

    def gone(node: Node) -> bool:
        if by_words and (_marked(node) or node.tag == "header" and not _in_article(node)):
            return True
        return node.tag == "head" or countable(node) and templates(template_hash(host, node))

    return " ".join(blocks(parse(source), gone))


def _extract(templates, by_words: bool):
    """Adds the text; ``templates``: broadcast sorted hashes, or None to read them from the row."""

    def run(batches):
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()  # noqa: E731,B023
            out = []
            own = col("templates") if templates is None else None
            for i, (url, source) in enumerate(zip(col("url"), col("html"))):
                if own is not None:
                    mine = frozenset(own[i] or ())
                    test = mine.__contains__
                else:
                    every = templates.value
                    test = lambda h: (k := int(np.searchsorted(every, h))) < len(every) and every[k] == h  # noqa: E731,B023
                out.append(extract(source, host_of(url), test, by_words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("id")), batch.column(batch.schema.get_field_index("url")), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=["id", "url", "text", "n_chars"],
            )

    return run


def _page_templates(batches):
    """(key of the page, template) of each page's subtrees."""
    for batch in batches:
        a, b, t = [], [], []
        cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("ka", "kb", "url", "html")]
        for ka, kb, url, source in zip(*cols):
            host = host_of(url)
            found = {template_hash(host, x) for x in walk(parse(source or "")) if countable(x)}
            a += [ka] * len(found)
            b += [kb] * len(found)
            t += found
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(t, pa.int64())], names=[*KEY, "template"])


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", send_limit: int = SEND_LIMIT, by_words: bool = True, min_share: float = MIN_SHARE,
) -> DataFrame:
    """One row per page: id, url, ``text`` and ``n_chars``."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    templates = staged(site_templates(rows, "url", "html", min_share), "templates")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, url string, text string, n_chars long"
    if templates.count() <= send_limit:
        sent = spark.sparkContext.broadcast(np.sort(templates.toArrow().column(0).to_numpy()))
        out = rows.mapInArrow(_extract(sent, by_words), schema)
    else:
        keyed = rows.withColumns({"ka": F.xxhash64("url", "html"), "kb": F.xxhash64(F.lit(0x5EED), "url", "html")})
        own = keyed.mapInArrow(_page_templates, "ka long, kb long, template long").join(templates, "template", "left_semi")
        own = staged(own.groupBy(*KEY).agg(F.collect_set("template").alias("templates")), "own_templates")
        out = keyed.join(own, KEY, "left").select("id", "url", "html", "templates").mapInArrow(_extract(None, by_words), schema)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
