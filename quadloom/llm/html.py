"""Operator 4: main text of web pages by equivalence-class template deduction.

Markup tokens are told apart by the path of elements around them; a block of text is a token as well, told by its path and text. Over
the pages of one host, tokens with the same occurrence vector form an equivalence class. A vector is kept as a 64-bit sum of
hashes of (page, count), which partial aggregates combine, so a host's pages never meet in one task. A class is valid if it covers enough of the
host's pages and its tokens occur in one order. Valid classes, in the order of their places, make the host's template. The text between template tokens fills its
slots, and slots are what is extracted: a block of text that is itself a template token is constant and goes, be it menu, header,
footer or notice, whatever its element is called. As copies of an article would turn it into template, the pages a text token is on
must differ in their sentences, and constant sentences stay where they would be most of what a page says.

What varies from page to page and is still no article (reader comments, adverts, related links, forms) cannot be told by a
template. Fixed lists of element names and class words name these parts. Class words that are ambiguous inside an article
(`WEAK`) do not count there; the template decides alone. Inside article elements a text token needs more support.
"""

import hashlib
import html as entities
import json
import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm.common import saved, slices, small_batches, table

#: Share of a host's pages on which a template token occurs: markup, text, and text inside article elements.
SUPPORT, TEXT_SUPPORT, ARTICLE_SUPPORT = 0.5, 0.3, 0.9
#: Pages with different texts that a text token is on at least, and one inside article elements.
LEAST, ARTICLE_LEAST = 3, 5
#: Pages of a host that are joined to its template in one task, about.
TOGETHER = 1 << 12
#: Characters of a path that a token's name spells out; what is above is named by a 128-bit hash.
LONG = 400
#: Words that make a block a sentence, which copied articles have and menus have not.
SENTENCE = 10
#: So many blocks in turn that are links as a whole are a menu, outside article elements.
LINKS = 3

# Elements by their meaning in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template iframe object svg canvas math head title nav header footer aside form button select option textarea label fieldset menu dialog datalist audio video map".split())
BLOCKS = frozenset("address article blockquote body br center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose class says something of the page, not of a part beside the article.
WHOLE = frozenset("html body main".split())
#: Words of class, id and role values of parts that are no article.
CHROME = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar navbar navigation menu breadcrumb breadcrumbs masthead colophon cookie cookies consent gdpr newsletter subscribe subscription signup login comment comments commentlist reply replies disqus respond share sharing social related recommended widget toolbar pager pagination complementary contentinfo".split())
#: The same, but words that parts of an article have as well.
WEAK = frozenset("banner side rail nav header footer foot notice notices alert popup modal overlay search form skip".split())
#: Of CHROME, words that count on article elements, whose class often tells of the page's layout.
CARDS = frozenset("ad ads advert advertisement sponsored promo comment comments reply related recommended".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=[A-Za-z/])[^>]*>", re.S)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg")}
#: An end tag that HTML lets be left out: an opening tag of the first kind closes an open one of the second.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


def tokens(page: str):
    """(kind, name, marks, text) of a page in order: "open", "close" or "text"; marks: words of class, id and role values."""
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            yield "text", "", (), page[at:]
            return
        if m.start() > at:
            yield "text", "", (), page[at : m.start()]
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, (), ""
            continue
        marks = tuple(sorted({w for v in ATTRIBUTE.findall(m[3] or "") for w in re.split(r"[^a-z0-9]+", v.lower()) if w})) if m[3] else ()
        yield "open", name, marks, ""
        if name in RAW and not (m[3] or "").endswith("/"):
            end = RAW[name].search(page, at)
            at = end.end() if end else n
            yield "close", name, (), ""


class Tree:
    """The paths of a page's elements, each held once as (parent, name, marks): a path of any depth and any number of class words is
    an int. Node 0 is the page; a parent is less than its children."""

    def __init__(self):
        self.ids: dict[tuple, int] = {}
        self.parents, self.own, self.names = [0], [("", ())], [""]
        #: Whether the node is in an article element (or one that is marked so), and in a link.
        self.in_article, self.in_link = [False], [False]

    def node(self, parent: int, name: str, marks: tuple) -> int:
        key = (parent, name, marks)
        at = self.ids.get(key)
        if at is None:
            at = self.ids[key] = len(self.parents)
            own = name + "".join(f".{w}" for w in marks)
            above = self.names[parent]
            if len(above) > LONG:  # names stay in proportion to the page, and paths that differ have names that differ
                above = f"#{hashlib.blake2b(above.encode(), digest_size=16).hexdigest()}"
            self.parents.append(parent)
            self.own.append((name, marks))
            self.in_article.append(self.in_article[parent] or name == "article" or "article" in marks)
            self.in_link.append(self.in_link[parent] or name == "a")
            self.names.append(f"{above}/{own}")
        return at

    def below(self, tops: set[int]) -> list[bool]:
        """For each node, whether it is one of `tops` or below it."""
        out = [False] * len(self.parents)
        for i in range(len(out)):
            out[i] = i in tops or (i > 0 and out[self.parents[i]])
        return out

    def gone(self) -> list[bool]:
        """For each node, whether it is no part of an article by its own or an ancestor's name or class words. The class words of an
        element with an article element inside tell of the layout."""
        n = len(self.parents)
        out, holds = [False] * n, [False] * n
        for i in range(n - 1, 0, -1):
            if (self.own[i][0] == "article" and not CARDS.intersection(self.own[i][1])) or holds[i]:
                holds[self.parents[i]] = True
        for i in range(1, n):
            above, (name, marks) = self.parents[i], self.own[i]
            inside = self.in_article[above]
            if out[above] or (name in DROPPED and not (name == "header" and inside)):
                out[i] = True
            elif name == "article":
                out[i] = bool(CARDS.intersection(marks))
            elif name not in WHOLE and not holds[i]:
                out[i] = bool(CHROME.intersection(marks)) or (not inside and "article" not in marks and bool(WEAK.intersection(marks)))
        return out


def walk(page: str, tree: Tree):
    """(node, name, text) of a page in order: text is None at a tag; node is the path of the open elements."""
    stack: list[tuple[str, int]] = []
    for kind, name, marks, text in tokens(page):
        path = stack[-1][1] if stack else 0
        if kind == "text":
            yield path, "", text
        elif kind == "open":
            closing = IMPLIED.get(name, set()) | ({"p"} if name in CLOSES_P else set())
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in closing:
                        del stack[k:]
                        break
                    if stack[k][0] in BLOCKS and stack[k][0] != "p":
                        break
                path = stack[-1][1] if stack else 0
            own = tree.node(path, name, marks)
            yield own, name, None
            if name not in VOID:
                stack.append((name, own))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            yield (stack[-1][1] if stack else 0), f"/{name}", None


def host(url: str | None) -> str:
    m = re.match(r"[a-z][a-z0-9+.-]*://([^/?#]*)", url or "", re.I)
    return m[1].lower() if m else ""


def main_nodes(held: list[int], tree: Tree) -> tuple[set[int], bool]:
    """The paths whose slots are the article's, and whether these are article or main elements: all article elements with text; else
    the lowest path above all elements that are marked so by class, id or role; the same for main; else the page."""
    for word in ("article", "main"):
        if found := {p for p in range(1, len(held)) if held[p] and tree.own[p][0] == word}:
            return found, True
        if found := [p for p in range(1, len(held)) if held[p] and word in tree.own[p][1]]:
            top = found[0]
            for p in found[1:]:
                while p != top:  # a parent is less than its children
                    p, top = (tree.parents[p], top) if p > top else (p, tree.parents[top])
            return {top}, True
    return {0}, False


def slots(page: str) -> tuple[list[tuple[str, int]], list[tuple[str, str, int]]]:
    """The page's distinct markup tokens with their counts, by first place; and the blocks of text that may be the article's, in page
    order: text token, text, and the rank of the markup before it. A text token is "=" (inside article elements) or "~" (elsewhere)
    and a hash of the block's path and text."""
    tree, count = Tree(), {}
    seen = []
    for path, name, text in walk(page, tree):
        if text is None and name[:1] != "/":
            count[tree.names[path]] = count.get(tree.names[path], 0) + 1
        seen.append((path, name, text, len(count)))
    gone = tree.gone()
    held = [0] * len(tree.parents)
    for path, _, text, _ in seen:
        if not gone[path] and text is not None:
            held[path] += len(text.strip())
    for i in range(len(held) - 1, 0, -1):
        held[tree.parents[i]] += held[i]
    tops, named = main_nodes(held, tree)
    inside = tree.below(tops)
    kind = "=" if named else "~"
    blocks, links, now, at = [], [], [], []

    def close():
        text = " ".join(entities.unescape("".join(now)).split())
        if text:
            token = hashlib.blake2b(f"{tree.names[at[0][0]]}\n{text}".encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
            blocks.append((kind + token, text, at[0][1]))
            links.append(all(tree.in_link[x] for x, _ in at))
        now.clear()
        at.clear()

    for path, name, text, rank in seen:
        if text is None:
            if name.lstrip("/") in BLOCKS:
                close()
        elif not gone[path] and inside[path]:
            now.append(text)
            if text.strip():
                at.append((path, rank))
    close()
    if not named and not all(links):
        menu = [False] * len(blocks)
        for i in range(len(blocks) - LINKS + 1):
            if all(links[i : i + LINKS]):
                menu[i : i + LINKS] = [True] * LINKS
        blocks = [x for x, out in zip(blocks, menu, strict=True) if not out]
    return list(count.items()), blocks


def sketch(texts: list[str]) -> int:
    """The least hash of the sentences' runs of three words (of all texts' if there are none): pages whose sentences are alike share it
    about as often as these are alike."""
    words = " ".join([x for x in texts if len(x.split()) >= SENTENCE] or texts).encode("utf-8", "surrogatepass").split()
    runs = zip(words, words[1:], words[2:], strict=False) if len(words) > 2 else [words]
    return min(zlib.crc32(b" ".join(x)) for x in runs)


def extract(page: str, template: list[str] | None) -> str:
    """The article's text: blocks in page order, one a line, without those that are tokens of the template. Constant sentences stay
    on a page that would have less text without them than they are: it is a copy of others."""
    return filled([(token, text) for token, text, _ in slots(page)[1]], template)


def filled(blocks: list[tuple[str, str]], template: list[str] | None) -> str:
    """extract() from the page's blocks as (text token, text)."""
    constant = {t for t in template or () if t[:1] in "=~"}
    size = lambda sentence: sum(len(x) for t, x in blocks if (t in constant) == sentence and (not sentence or len(x.split()) >= SENTENCE))
    if size(True) > size(False):
        constant = {t for t, x in blocks if t in constant and len(x.split()) < SENTENCE}
    return "\n".join(text for token, text in blocks if token not in constant)


def packed(page: str) -> bytes:
    """The page's blocks, compressed: all that extract() needs of it, and much less than the page."""
    return zlib.compress(json.dumps([(token, text) for token, text, _ in slots(page)[1]], ensure_ascii=False).encode("utf-8", "surrogatepass"))


def unpacked(data: bytes) -> list[tuple[str, str]]:
    return [(token, text) for token, text in json.loads(zlib.decompress(data).decode("utf-8", "surrogatepass"))]


def occurrences(pages: DataFrame) -> DataFrame:
    """host, token, n_pages, n_texts, vector, least_rank, most_rank: for each token of a host, the pages it is on, how many different
    sketches they have, a hash of its occurrence vector, and the least and greatest rank of its first place among the page's
    distinct markup tokens."""
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("token", T.StringType()), *(T.StructField(x, T.LongType()) for x in ("n", "rank", "page", "sketch"))])

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "html"):
            out: list[list] = [[] for _ in range(6)]
            for url, page, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                markup, blocks = slots(page)
                alike = sketch([text for _, text, _ in blocks])
                texts: dict[str, list[int]] = {}
                for token, _, rank in blocks:
                    texts.setdefault(token, [0, rank])[0] += 1
                for token, n, rank in [(x, n, rank) for rank, (x, n) in enumerate(markup)] + [(x, *v) for x, v in texts.items()]:
                    for col, x in zip(out, (host(url), token, n, rank, key, alike), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), *(pa.array(x, pa.int64()) for x in out[2:])], schema.names)

    rows = small_batches(pages).select("url", F.coalesce("html", F.lit("")).alias("html"), F.xxhash64("page_id", "url").alias("page")).mapInArrow(run, schema)
    cell = F.shiftrightunsigned(F.xxhash64("page", "n"), 31)  # 33 bits: sums over 2^30 pages stay inside a long
    parts = rows.groupBy("host", "token", "sketch").agg(F.count("*").alias("n_pages"), F.sum(cell).alias("vector"), F.min("rank").alias("least_rank"), F.max("rank").alias("most_rank"))
    return parts.groupBy("host", "token").agg(F.sum("n_pages").alias("n_pages"), F.count("*").alias("n_texts"), F.sum("vector").alias("vector"), F.min("least_rank").alias("least_rank"), F.max("most_rank").alias("most_rank"))


def _host(url: Column) -> Column:
    """host() as a column: Java's match is the same."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?i)[a-z][a-z0-9+.-]*://([^/?#]*)", 1))


def _totals(pages: DataFrame) -> DataFrame:
    """host, pages: how many pages each host has."""
    return pages.groupBy(_host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


def templates(pages: DataFrame, support: float = SUPPORT, text_support: float = TEXT_SUPPORT, article_support: float = ARTICLE_SUPPORT) -> DataFrame:
    """host, pages, template: the tokens of the host's valid equivalence classes, by place, and how many pages the host has.

    A class holds the tokens with one vector; it is valid if it is on `support` of the host's pages at least and its tokens'
    ranges of rank keep one order (the class of a host's only page always is); tokens of equal rank are ordered by name. Text tokens
    need `text_support`, or `article_support` inside article elements, and LEAST or ARTICLE_LEAST pages, which have to differ: half as
    many sketches as pages. Repeated rows count as pages of their own.
    """
    kind = F.substring("token", 1, 1)
    least = F.when(kind == "~", LEAST).when(kind == "=", ARTICLE_LEAST).otherwise(1)
    text = kind.isin("~", "=")
    # most texts are on one page only
    tokens_of = saved(occurrences(pages).where(~text | ((F.col("n_texts") >= least) & (2 * F.col("n_texts") >= F.col("n_pages")))))
    total = _totals(pages)
    share = F.when(kind == "~", text_support).when(kind == "=", article_support).otherwise(support)
    rank = F.struct("least_rank", "most_rank", "token")
    classes = tokens_of.join(total, "host").where(F.col("n_pages") >= share * F.col("pages")).groupBy("host", "pages", "n_pages", "vector").agg(F.sort_array(F.collect_list(rank)).alias("members"))
    ordered = F.forall(F.transform("members", lambda m, i: F.coalesce(F.get("members", i - 1)["most_rank"] <= m["most_rank"], F.lit(True))), lambda ok: ok)
    return classes.where(ordered).select("host", "pages", F.explode("members").alias("m")).groupBy("host", "pages").agg(F.sort_array(F.collect_list("m")).alias("t")).select("host", "pages", F.col("t.token").alias("template"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text: the main text of every row of pages.

    Null or empty html gives an empty text; a null url counts as one host with other such pages; repeated rows repeat. White space
    in a block becomes one blank, blocks are trimmed and joined by a line end; empty blocks and the host's constant ones are left
    out, nothing else.
    """
    keys = [pages.schema["page_id"], pages.schema["url"]]
    blocks_of = T.StructType([*keys, T.StructField("__ql_host", T.StringType()), T.StructField("__ql_salt", T.IntegerType()), T.StructField("blocks", T.BinaryType())])
    schema = T.StructType([*keys, T.StructField("text", T.StringType())])

    def pack(batches):
        import pyarrow as pa

        for batch in slices(batches, "html"):
            blocks = [packed(page) for page in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(blocks, pa.binary())], blocks_of.names)

    def fill(batches):
        import pyarrow as pa

        for batch in slices(batches, "blocks"):
            texts = [filled(unpacked(blocks), template) for blocks, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema.names)

    # hosts with very many pages, of which there are few, are dealt to several tasks
    parts = F.ceil(F.col("pages") / TOGETHER).cast("int")
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), _host(F.col("url")).alias("__ql_host"))
    known = saved(templates(pages))
    large = F.broadcast(known.where(F.col("pages") > TOGETHER).select(F.col("host").alias("__ql_large"), parts.alias("__ql_parts")))
    salt = F.pmod(F.xxhash64("page_id", "html"), F.coalesce("__ql_parts", F.lit(1))).cast("int")
    own = own.join(large, F.col("__ql_host") == F.col("__ql_large"), "left").select("page_id", "url", "__ql_host", salt.alias("__ql_salt"), "html")
    # pages stay where they are; their blocks, which are a small part of them, meet the template's text tokens
    own = own.mapInArrow(pack, blocks_of)
    texts = F.filter("template", lambda t: F.substring(t, 1, 1).isin("~", "="))
    known = known.select(F.col("host").alias("__ql_host"), texts.alias("template"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("__ql_salt"))
    return own.join(known, ["__ql_host", "__ql_salt"], "left").select("page_id", "url", "blocks", "template").mapInArrow(fill, schema)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
