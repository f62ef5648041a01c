"""Main text of web pages by consensus of host paths.

Each page scores its containers by the text that stands in them and outside links and furniture. What a
container scores counts for the whole that it is part of: the outermost article or main part, or else the
lowest node with nearly all text and the first headline. The best of these vote, by generalised path (tags and classes from the body down, digits folded), and Spark
adds the votes up by host. Every page is then extracted again from the host's best-voted path that it
has, so that a page with little text follows its siblings; a page without a host, or with none of the
winning paths, keeps its own best container.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame, Window, functions as F

from .common import arrow_pass, cut

#: So many of a host's most voted paths travel as one list; those after them meet the pages by a join.
WINNERS = 64
#: A host with this share of all pages is hot; there can be 1 / HOT_SHARE of them at most. Their pages
#: get the winners by broadcast and are dealt out evenly, over SALTS keys.
HOT_SHARE, SALTS = 0.01, 1024

#: This share of a page's unlinked text is nearly all of it.
NEARLY = 0.9

# HTML's own tag classes.
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = set("article body center dd div fieldset main section td".split())
FURNITURE = set("aside dialog footer form menu nav".split())
#: A new one of these ends an open one, up to the nearest of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Words in class, id or role that mark furniture wherever they stand in a name.
FURNITURE_WORDS = set(
    "ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter outbrain overlay pager pagination paywall popup promo promoted replies respond sharing sidebar signin signup sponsor sponsored subscribe subscription taboola teaser toolbar widget widgets".split()
)
#: Words that are as often a topic: they mark furniture alone, or beside words that name a part of a page.
TOPIC_WORDS = set("copyright dialog discussion legal notice notification popular privacy promotion recommended related reply responses search share skip social".split())
PART_WORDS = set("area article articles bar block box button buttons container content entries form icons inner items link links list media more news outer panel post posts section stories story wrap wrapper".split())
#: Inside an article or main part, a name of these words alone may be a topic as well: it marks furniture
#: only if most of the node's text is in links.
DOUBTFUL_WORDS = set("banner copyright dialog discussion legal menu popular privacy promotion recommended reply responses search skip".split())
#: Words for a place or an owner, which don't make a topic of a name inside an article or main part.
PLACE_WORDS = set("bottom form global inline left main page primary reader right secondary site slot top unit user".split())
#: Headings, paragraphs and cells of text are never furniture by their names.
PROSE = set("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 hgroup li p pre summary td th tr".split())

_token = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|textarea|noscript|template|iframe|svg|select|button)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|(?P<open>\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[a-zA-Z/!?][^>]*+>",
    re.S | re.I,
)
_attribute = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Classes such as with-sidebar or has-banner say what stands in a node or beside it, not what it is.
_beside = re.compile(r"(?<!\S)(?:has|have|with|without|no)[-_]\S*", re.I)
_word = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_host = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#\s]+)")


def _names_furniture(name: str) -> bool:
    """Whether one class, id or role names furniture: by a word of furniture, or by a topic alone or with
    words for parts of a page only, so that related-posts is and related-work is not."""
    words = {w.lower() for w in _word.findall(name)}
    if words & FURNITURE_WORDS:
        return True
    return bool(words & TOPIC_WORDS) and words <= TOPIC_WORDS | PART_WORDS


def _names_furniture_inside(name: str) -> tuple[bool, bool]:
    """The same for a name inside an article or main part, where a word of another kind makes it a topic
    (comments-on-kant); and whether the name is doubtful."""
    words = {w.lower() for w in _word.findall(name)}
    named = words & (FURNITURE_WORDS | TOPIC_WORDS)
    if not _names_furniture(name) or not words <= named | PART_WORDS | PLACE_WORDS:
        return False, False
    doubtful = words <= DOUBTFUL_WORDS
    return not doubtful, doubtful


class Page:
    """Blocks of text with the nodes they stand in.

    nodes: (parent, tag, label, furniture); blocks: (node, text, characters in links).
    """

    def __init__(self, source: str) -> None:
        self.nodes: list[tuple[int, str, str, bool]] = [(-1, "body", "body", False)]
        self.blocks: list[tuple[int, str, int]] = []
        #: Nodes that are furniture by their words only, and those by tag or as hidden.
        self.worded: set[int] = set()
        self.doubtful: set[int] = set()
        self.sure: set[int] = set()
        self._parse(source)
        self._settle()

    def _parse(self, source: str) -> None:
        stack, parts, at, in_link, link_chars = [0], [], 0, False, 0
        nodes, blocks = self.nodes, self.blocks

        def flush() -> None:
            nonlocal parts, link_chars
            if parts:
                text = "".join(parts)
                if "&" in text:
                    text = entities.unescape(text)
                if text := " ".join(text.split()):
                    blocks.append((stack[-1], text, min(link_chars, len(text))))
                parts = []
            link_chars = 0

        def pop(tags: set[str], until: set[str]) -> None:
            for i in range(len(stack) - 1, 0, -1):
                tag = nodes[stack[i]][1]
                if tag in tags:
                    del stack[i:]
                    return
                if tag in until:
                    return

        # What comes after the last ">" can't be a whole tag; a tag cut off there is no text.
        end = source.rfind(">") + 1
        for m in _token.finditer(source, 0, end):
            if m.start() > at:
                parts.append(source[at : m.start()])
                if in_link:
                    link_chars += m.start() - at
            at = m.end()
            if m["open"] is not None or m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = end = len(source)  # open to the page's end
                break
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag == "a":
                in_link = not m["end"]
            elif tag == "br":
                flush()
            elif tag in BLOCKS:
                flush()
                if m["end"]:
                    if tag not in ("body", "html"):
                        pop({tag}, set())
                    continue
                in_link = False
                pop({"p"}, {"td", "th", "table", "li"})
                if tag in ENDS:
                    pop(*ENDS[tag])
                if tag in ("html", "body", "hr"):
                    continue
                self._node(stack[-1], tag, m["attributes"])
                stack.append(len(nodes) - 1)
            elif not in_link and tag in ("img", "input"):
                parts.append(" ")
        rest = source[at:]
        cut = re.search(r"<[a-zA-Z/!?]", rest)
        parts.append(rest[: cut.start()] if cut else rest)
        flush()

    def _node(self, parent: int, tag: str, attributes: str) -> None:
        label, sure, worded, doubtful = tag, tag in FURNITURE, False, False
        if tag == "header":
            sure = not self._inside(parent, {"article", "main"})
        if attributes and "=" in attributes or "hidden" in attributes:
            for name, a, b, c in _attribute.findall(attributes):
                value = a or b or c
                if name.lower() == "class":
                    label += "".join("." + re.sub(r"\d+", "9", x) for x in sorted(value.lower().split()))
                if name.lower() == "hidden" or (name.lower() == "aria-hidden" and value == "true"):
                    sure = True
                elif not worded and tag not in PROSE and (name.lower() != "id" or not self._inside(parent, {"article"})):
                    names = _beside.sub("", value).split()
                    if self._inside(parent, {"article", "main"}):
                        found = [_names_furniture_inside(x) for x in names]
                        worded, doubtful = any(x for x, _ in found), doubtful or any(x for _, x in found)
                    else:
                        worded = any(map(_names_furniture, names))
        if tag in ("article", "main") and not self._inside(parent, {"article"}):
            sure, worded = sure and "comment" in label, worded and "comment" in label
        if sure:
            self.sure.add(len(self.nodes))
        elif worded:
            self.worded.add(len(self.nodes))
        elif doubtful:
            self.doubtful.add(len(self.nodes))
        self.nodes.append((parent, tag, label, False))

    def _below(self, marked: set[int]) -> list[bool]:
        """Which nodes are one of ``marked`` or stand below one."""
        out: list[bool] = []
        for i, node in enumerate(self.nodes):
            out.append(i in marked or node[0] >= 0 and out[node[0]])
        return out

    def _worth(self, use: list[bool]) -> list[int]:
        """Characters outside links below each node, of blocks in the nodes ``use``."""
        out = [0] * len(self.nodes)
        for node, text, linked in self.blocks:
            if use[node]:
                out[node] += len(text) - linked
        for i in range(len(out) - 1, 0, -1):
            out[self.nodes[i][0]] += out[i]
        return out

    def _linked(self) -> list[int]:
        """Characters in links below each node."""
        out = [0] * len(self.nodes)
        for node, _, linked in self.blocks:
            out[node] += linked
        for i in range(len(out) - 1, 0, -1):
            out[self.nodes[i][0]] += out[i]
        return out

    def _settle(self) -> None:
        """Furniture passes down. A doubtful name counts where most text is in links. Words alone make no furniture of a node that holds most text of the
        page's articles (main parts, if there is no article; all text, if there is neither), or nearly all
        text of the page, or articles, where all articles would be lost."""
        if self.doubtful:
            unlinked, linked = self._worth([True] * len(self.nodes)), self._linked()
            self.worded |= {i for i in self.doubtful if linked[i] > unlinked[i]}
        if self.worded:
            sure = self._below(self.sure)
            all_ = self._worth([not x for x in sure])
            inside, held = [False] * len(sure), all_
            for tag in ("article", "main"):
                below = self._below({i for i, n in enumerate(self.nodes) if n[1] == tag and i not in self.worded})
                own = self._worth([a and not b for a, b in zip(below, sure, strict=True)])
                if own[0]:
                    inside, held = below, own
                    break
            if all_[0]:
                self.worded -= {i for i in self.worded if not inside[i] and 2 * held[i] > held[0] or all_[i] >= NEARLY * all_[0]}
            if held is not all_:
                lost = self._below(self.worded | self.sure)
                if not self._worth([a and not b for a, b in zip(inside, lost, strict=True)])[0]:
                    self.worded -= {i for i in self.worded if not inside[i] and held[i]}
        lost = self._below(self.worded | self.sure)
        self.nodes = [(*n[:3], x) for n, x in zip(self.nodes, lost, strict=True)]

    def _inside(self, node: int, tags: set[str]) -> bool:
        while node >= 0:
            if self.nodes[node][1] in tags:
                return True
            node = self.nodes[node][0]
        return False

    def path(self, node: int) -> str:
        labels = []
        while node >= 0:
            labels.append(self.nodes[node][2])
            node = self.nodes[node][0]
        return "/".join(reversed(labels))

    def scores(self) -> dict[int, float]:
        """A block counts its characters outside links, for its nearest container, and half for the
        container above; articles and main parts count one and a half times."""
        out: dict[int, float] = {}
        for node, text, linked in self.blocks:
            if self.nodes[node][3]:
                continue
            worth, share = float(len(text) - linked), 1.0
            while node >= 0 and share > 0.4:
                if self.nodes[node][1] in CONTAINERS:
                    out[node] = out.get(node, 0.0) + worth * share
                    share /= 2
                node = self.nodes[node][0]
        return {n: s * (1.5 if self.nodes[n][1] in ("article", "main") else 0.3 if n == 0 else 1.0) for n, s in out.items() if s > 0}

    def _wholes(self) -> list[int]:
        """For each node, the outermost article or main part that it stands in, or else the lowest node
        above that has nearly all text and the first headline."""
        worth = self._worth([not n[3] for n in self.nodes])
        title = next((i for i, n in enumerate(self.nodes) if n[1] == "h1" and not n[3] and worth[i]), 0)
        over = {0}
        while title > 0:
            over.add(title)
            title = self.nodes[title][0]
        if len(over) == 1:
            over = set(range(len(self.nodes)))
        out: list[int] = []
        article: list[bool] = []
        for i, (parent, tag, _, furniture) in enumerate(self.nodes):
            above = out[parent] if parent >= 0 else 0
            article.append(parent >= 0 and article[parent] or tag in ("article", "main") and not furniture)
            if parent >= 0 and article[parent]:
                out.append(above)
            elif article[i] or (tag in CONTAINERS and i in over and worth[i] >= NEARLY * worth[0]):
                out.append(i)
            else:
                out.append(above)
        return out

    def best(self) -> list[tuple[str, float]]:
        """The best paths with their scores; nodes of one whole, and wholes of one path, add up."""
        sums: dict[str, float] = {}
        scores = self.scores()
        wholes = self._wholes() if scores else []
        for node, score in scores.items():
            path = self.path(wholes[node])
            sums[path] = sums.get(path, 0.0) + score
        return sorted(sums.items(), key=lambda x: (-x[1], x[0]))

    def text(self, path: str) -> str:
        """Blocks below the nodes of a path, without furniture, in page order."""
        inside = [False] * len(self.nodes)
        for i, (parent, _, _, _) in enumerate(self.nodes):
            inside[i] = parent >= 0 and inside[parent] or (path.endswith(self.nodes[i][2]) and self.path(i) == path)
        return "\n".join(t for n, t, _ in self.blocks if inside[n] and not self.nodes[n][3])

    def containers(self) -> set[str]:
        return {self.path(i) for i, n in enumerate(self.nodes) if n[1] in CONTAINERS}

    def extract(self, winners: list[str]) -> str:
        own = self.best()
        have = self.containers() if winners else set()
        for path in [*(w for w in winners if w in have), *(p for p, _ in own)]:
            if text := self.text(path):
                return text
        return ""


def host_of(url: str | None) -> str | None:
    found = _host.match(url or "")
    return found[1].lower() if found else None


def host_votes(pages: DataFrame) -> DataFrame:
    """``host, path, votes, pages``: votes of all pages; a page's best path counts 1000, its others less.
    A page is counted at its best path, one without text at a path of its own without votes."""

    def rows(columns: list[list]) -> dict:
        out: dict[str, list] = {"host": [], "path": [], "votes": [], "pages": []}
        for url, source in zip(*columns, strict=True):
            if (host := host_of(url)) is None:
                continue
            best = Page(source or "").best() or [("", 0.0)]
            for i, (path, score) in enumerate(best):
                for k, v in zip(out, (host, path, int(1000 * score / best[0][1]) if path else 0, int(i == 0)), strict=True):
                    out[k].append(v)
        return out

    votes = arrow_pass(pages.select(F.col("url").cast("string"), F.col("html").cast("string")), "host string, path string, votes long, pages long", rows)
    return votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("pages").alias("pages"))


def _later_paths(rows: DataFrame, late: DataFrame) -> DataFrame:
    """``id, later``: the paths of each page (rows: id, host, html) that are in ``late`` (host, path, r), in
    order. A page has as many as its containers at most; repeated pages are one."""

    def paths(columns: list[list]) -> dict:
        out: dict[str, list] = {"id": [], "host": [], "path": []}
        for id_, host, source in zip(*columns, strict=True):
            for path in Page(source or "").containers():
                for k, v in zip(out, (id_, host, path), strict=True):
                    out[k].append(v)
        return out

    of_pages = arrow_pass(rows.select("id", "host", "html"), "id long, host string, path string", paths).distinct()
    return of_pages.join(late.select("host", "path", "r"), ["host", "path"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", "path")))["path"].alias("later"))


def extract_pages(pages: DataFrame, listed: int = WINNERS) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages``; no text gives the empty string. Every voted
    path of a host may win; ``listed`` of them travel as one list.

    A null html is empty; a null url has no host; repeated rows each give a row; other columns are
    ignored; an empty table gives no rows. Votes that tie are ordered by path.
    """
    of_host = Window.partitionBy("host")
    order = F.row_number().over(of_host.orderBy(F.desc("votes"), "path"))
    voted = host_votes(pages).withColumn("n", F.sum("pages").over(of_host)).where(F.col("path") != "")
    ranked = cut(voted.select("host", "path", "n", order.alias("r")), "ranked")
    paths = F.array_sort(F.collect_list(F.struct("r", "path")))["path"]
    winners = cut(ranked.where(F.col("r") <= listed).groupBy("host").agg(F.max("n").alias("n"), paths.alias("winners")), "winners")
    total = winners.agg(F.sum("n")).first()[0] or 0
    hot = winners.where(F.col("n") >= HOT_SHARE * total).select(F.col("host").alias("hot_host"), F.col("winners").alias("hot_winners"))
    rest = winners.where(F.col("n") < HOT_SHARE * total).select(F.col("host").alias("key"), F.col("winners").alias("rest_winners"))
    host = F.lower(F.regexp_extract(F.col("url").cast("string"), _host.pattern, 1))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), F.when(host != "", host).alias("host"))
    rows = rows.join(F.broadcast(hot), F.col("host") == F.col("hot_host"), "left")
    # No host has a blank in its name, so these keys meet no winners.
    spread = F.concat(F.lit(" "), F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("string"))
    rows = rows.withColumn("key", F.when(F.col("hot_winners").isNull() & F.col("host").isNotNull(), F.col("host")).otherwise(spread))
    joined = rows.join(rest, "key", "left").select("page_id", "url", "html", "host", F.coalesce("hot_winners", "rest_winners").alias("winners"))
    late = ranked.where(F.col("r") > listed)
    if not late.isEmpty():
        full = F.coalesce(F.size("winners") >= listed, F.lit(False))
        more = joined.where(full).withColumn("id", F.xxhash64("page_id", "url", "html"))
        all_ = F.concat("winners", F.coalesce("later", F.array().cast("array<string>"))).alias("winners")
        more = more.join(_later_paths(more, late), "id", "left").select("page_id", "url", "html", "host", all_)
        joined = joined.where(~full).unionByName(more)
    joined = joined.drop("host")

    def extract(columns: list[list]) -> dict:
        ids, urls, sources, winners = columns
        texts = [Page(s or "").extract(w or []) for s, w in zip(sources, winners, strict=True)]
        return {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

    return arrow_pass(joined, "page_id long, url string, text string, n_chars long", extract)
