"""HTML extraction by union-free regular expressions.

Pages of a host come from few templates. A *wrapper* is an expression over tags and text slots with optional and repeated
groups, but no alternatives. It begins as one page and is aligned with further ones: equal tags are matched (longest common
subsequence, level by level), runs of equal tags become one repeated item, tags that one side lacks become optional, and texts
that differ become slots; texts that never differ stay as constants of the template.

Wrappers align with wrappers just as with pages, so tasks infer one per host from the pages they hold, and partial wrappers
are aligned in two steps. No task holds the pages of a host. A wrapper's size follows the templates, not the pages.

Extraction walks a page along its host's wrapper. The main part is ``article``, else ``main`` (by tag or role), else the page's body; inside it,
elements that are menus, headers, footers, sidebars, notices, adverts, forms, comments and the like by name are left out. On pages
without ``article`` and ``main`` the wrapper tells the template from the text: constants of a wrapper inferred from at least ``TRUSTED`` pages are left
out, if it has slots in the body at all, and so are blocks that are mostly links.

Defined cases: null or empty html gives an empty text; a page without host shares one wrapper with all such pages; repeated
pages change nothing; unclosed and stray tags are repaired; character references are decoded once.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm import workers
from winnow.llm.html_trees import INLINE, Node, parse
from winnow.session import materialise

TRUSTED = 8
LEFT_OUT = set("""head title nav header footer aside form script style noscript template iframe object svg canvas button select option
textarea input dialog menu datalist audio video map""".split())
#: Words in class, id and role names that mark what is not the article.
CUES = set("""nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended promo promotion ad
ads adv advert adverts advertisement advertising sponsor sponsored banner cookie cookies consent notice notices alert gdpr newsletter subscribe
signup social share sharing comment comments reply replies respond disqus login search pagination pager popup modal toolbar copyright hidden
contentinfo complementary""".split())
_SPLIT = re.compile(r"[^a-z]+")
_MANY = 400  # items of one level that are aligned item by item

# A wrapper item: [key, optional, repeated, constant or None, items]; texts have key "#".
KEY, OPTIONAL, REPEATED, CONSTANT, ITEMS = range(5)


def squeezed(text: str) -> str:
    return " ".join(text.split())


def item_of(node: Node | str) -> list:
    """One page as an expression."""
    if isinstance(node, str):
        return ["#", False, False, f"{len(node)}:{zlib.crc32(node.encode('utf-8', 'surrogatepass'))}", []]
    kids = [k for k in node.kids if not isinstance(k, str) or not k.isspace()]
    return [node.key, False, False, None, folded([item_of(k) for k in kids])]


def folded(items: list[list]) -> list[list]:
    """Runs of equal keys become one repeated item; then runs of equal groups of two to four, item by item."""
    out: list[list] = []
    for item in items:
        if out and out[-1][KEY] == item[KEY]:
            out[-1] = both(out[-1], item)
            out[-1][REPEATED] = True
        else:
            out.append(item)
    for size in (2, 3, 4):
        at = 0
        while at + 2 * size <= len(out):
            if all(out[at + i][KEY] == out[at + size + i][KEY] for i in range(size)):
                for i in range(size):
                    out[at + i] = both(out[at + i], out[at + size + i])
                    out[at + i][REPEATED] = True
                del out[at + size:at + 2 * size]
            else:
                at += 1
    return out


def both(a: list, b: list) -> list:
    """The least expression that covers two items of one key."""
    return [a[KEY], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED], a[CONSTANT] if a[CONSTANT] == b[CONSTANT] else None,
            aligned(a[ITEMS], b[ITEMS])]


def aligned(a: list[list], b: list[list]) -> list[list]:
    """Two levels as one: common items matched in order, the others optional."""
    if [x[KEY] for x in a] == [x[KEY] for x in b]:
        return [both(x, y) for x, y in zip(a, b)]
    if len(a) > _MANY or len(b) > _MANY:  # a level without structure: one repeated item per key
        return list(_by_key([*a, *b]).values())
    n, m = len(a), len(b)
    longest = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            longest[i][j] = longest[i + 1][j + 1] + 1 if a[i][KEY] == b[j][KEY] else max(longest[i + 1][j], longest[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][KEY] == b[j][KEY]:
            out.append(both(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j >= m or i < n and longest[i + 1][j] >= longest[i][j + 1]:
            out.append([a[i][KEY], True, *a[i][REPEATED:]])
            i += 1
        else:
            out.append([b[j][KEY], True, *b[j][REPEATED:]])
            j += 1
    return folded(out)


def _by_key(items: list[list]) -> dict[str, list]:
    found: dict[str, list] = {}
    for item in items:
        found[item[KEY]] = both(found[item[KEY]], item) if item[KEY] in found else item
        found[item[KEY]][OPTIONAL] = found[item[KEY]][REPEATED] = True
    return found


def left_out(key: str, name: str) -> bool:
    return name in LEFT_OUT or " " in key and not CUES.isdisjoint(_SPLIT.split(key.partition(" ")[2]))


def main_rank(key: str, name: str) -> int:
    return 2 if name == "article" else 1 if name == "main" or " main" in f" {key.partition(' ')[2]} " and "main" in key.split()[1:] else 0


class Extractor:
    """Main texts of pages under one wrapper."""

    def __init__(self, wrapper: list | None, pages: int):
        self.wrapper = wrapper
        self.trusted = pages >= TRUSTED

    def blocks(self, root: Node) -> list[str]:
        ranks = {r for r in self._ranks(root)}
        want = max(ranks, default=0)
        spans: list[tuple[str, bool, bool]] = []  # text, constant, in a link; "\n" ends a block
        self._walk(root, self.wrapper, want == 0, want, False, spans)
        varying = any(not constant and text.strip() for text, constant, _ in spans if text != "\n")
        out, block, linked = [], [], 0
        for text, constant, link in [*spans, ("\n", False, False)]:
            if text == "\n":
                whole = squeezed("".join(block))
                if whole and (want or 2 * linked <= len(whole)):
                    out.append(whole)
                block, linked = [], 0
            elif want or not (constant and varying and self.trusted):
                block.append(text)
                linked += len(text.strip()) if link else 0
        return out

    def _ranks(self, node: Node) -> Iterator[int]:
        stack = [node]
        while stack:
            there = stack.pop()
            for kid in there.kids:
                if not isinstance(kid, str) and not left_out(kid.key, kid.name):
                    rank = main_rank(kid.key, kid.name)
                    if rank:
                        yield rank
                    stack.append(kid)

    def _walk(self, node: Node, item: list | None, inside: bool, want: int, link: bool, spans: list) -> None:
        stack: list = [(node, item, inside, link)]
        while stack:
            there = stack.pop()
            if there is None:
                spans.append(("\n", False, False))
                continue
            node, item, inside, link = there
            if isinstance(node, str):
                if inside:
                    spans.append((unescape(node), item is not None and item[CONSTANT] is not None and not item[REPEATED], link))
                continue
            if left_out(node.key, node.name):
                continue
            inside = inside or bool(want) and main_rank(node.key, node.name) == want
            link = link or node.name == "a"
            items, at, todo = item[ITEMS] if item else [], 0, []
            for kid in node.kids:
                key, found = "#" if isinstance(kid, str) else kid.key, None
                if key != "#" or not kid.isspace():
                    place = at if at < len(items) and items[at][KEY] == key else next((i for i in [*range(at, len(items)), *range(at)] if items[i][KEY] == key), None)
                    if place is not None:
                        found, at = items[place], place if items[place][REPEATED] else place + 1
                todo.append((kid, found, inside, link))
            if node.name not in INLINE:
                todo = [None, *todo, None]
            stack += reversed(todo)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def _merged(wrappers: Iterator[str]) -> list:
    whole = None
    for text in sorted(wrappers):
        item = json.loads(text)
        whole = item if whole is None else both(whole, item)
    return whole


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper as JSON, pages): one row per host."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        number = 0

        def rows():
            return pd.DataFrame([(h, number % 32, json.dumps(w), n) for h, (w, n) in held.items()], columns=["host", "part", "wrapper", "pages"])

        for batch in batches:
            for host, page in zip(batch["host"], batch["html"]):
                item = item_of(parse(page))
                whole = held.get(host)
                held[host] = [item, 1] if whole is None else [both(whole[0], item), whole[1] + 1]
            if len(held) > 2_000:
                yield rows()
                held.clear()
                number += 1
        yield rows()

    def merged(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(keys[0], keys[-1] if len(keys) > 1 else 0, json.dumps(_merged(rows["wrapper"])), int(rows["pages"].sum()))], columns=["host", "part", "wrapper", "pages"])

    schema = "host string, part int, wrapper string, pages long"
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    parts = rows.mapInPandas(partial, schema).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = parts.groupBy("host", "part").applyInPandas(merged, schema)
    return some.groupBy("host").applyInPandas(merged, schema).select("host", "wrapper", "pages")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    workers.small_batches(pages.sparkSession)
    wrappers = materialise(infer(pages, url_col, html_col), "wrappers")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("_html"), host_of(F.col(url_col)).alias("_host"))

    @F.pandas_udf("string")
    def texts(htmls: pd.Series, hosts: pd.Series, known: pd.Series, counts: pd.Series) -> pd.Series:
        ready: dict[str, Extractor] = {}
        out = []
        for page, host, wrapper, count in zip(htmls, hosts, known, counts):
            if host not in ready:
                if len(ready) > 500:
                    ready.clear()
                ready[host] = Extractor(json.loads(wrapper) if wrapper else None, int(count or 0))
            out.append(" ".join(ready[host].blocks(parse(page))))
        return pd.Series(out, dtype=object)

    joined = rows.join(wrappers.withColumnRenamed("host", "_host"), "_host", "left")
    found = joined.select("page_id", "url", texts.asNondeterministic()("_html", "_host", "wrapper", "pages").alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
