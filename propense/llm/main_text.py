"""Main text of web pages by the distribution of line blocks.

Markup is stripped into lines, one for each block of the page. The lengths of
the lines are summed over a sliding window: where the sum surges from nothing a
run of text begins, where it dives back to nothing the run ends, and the text
between the two points of the heaviest run is kept. What stands in menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments is stripped like markup and leaves an empty line behind.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from propense.llm.tables import texts_of

# Lines in a window: a run ends where so many lines in a row are empty.
WINDOW = 3

# HTML's elements and the words sites use for what surrounds an article.
RAW = "script|style|noscript|template|iframe|svg|annotation-xml|annotation|object|textarea|select|title|canvas|audio|video"
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup"
    " option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = BLOCKS - frozenset("p li dt dd hr tr td th thead tbody tfoot option optgroup h1 h2 h3 h4 h5 h6".split())
STORIES = frozenset(("article", "main"))
SURROUNDINGS = frozenset("nav header footer aside form head menu dialog button search fieldset".split())
SURROUNDING_NAMES = re.compile(
    r"(?<![a-z])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promos?|promotions?|banners?|cookies?|consent|notices?"
    r"|popups?|modal|overlay|newsletters?|subscri(?:be|ption)s?|signup|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?"
    r"|footers?|headers?|masthead|comments?|commentlist|respond|replies|discussion|disqus|shar(?:e|ing)|social"
    r"|related|recommend(?:ed|ations)?|widgets?|login|pagination|pager|toolbar|skip-?link)(?![a-z])",
    re.IGNORECASE,
)
# A name that says that its element has such a thing beside it, or none, is not the thing's own.
MODIFIED = re.compile(r"(?<![a-z])(?:has|have|no|non|not|with|without)(?![a-z])", re.IGNORECASE)
COMMENT_NAMES = re.compile(r"(?<![a-z])(?:comments?|commentlist|respond|replies|disqus)(?![a-z])", re.IGNORECASE)
# Headings that a story's sections are named after.
SECTION_NAMES = frozenset("discussion recommendation recommendations consent notice notices navigation social".split())
# What holds a story's title, alone or as in entry-header and article_header.
HEADER_NAMES = re.compile(r"(?<![a-z])(?:headers?|masthead)(?![a-z])", re.IGNORECASE)
SURROUNDING_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<svg(?=[\s/])(?:[^<>\"'/]|/(?!>)|\"[^\"<]*\"|'[^'<]*')*+/>"
    rf"|<(?P<raw>{RAW})(?=[\s/>]).*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/<>]*)(?P<rest>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/<>]*)(?P<rest2>[^<>]*+)>"
    r"|<[!?][^<>]*+>",
    re.IGNORECASE | re.DOTALL,
)
STORY = re.compile(r"<(?:article|main)(?=[\s/>])", re.IGNORECASE)
NAMED = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
ROLE = re.compile(r"\brole\s*=\s*[\"']?([a-z]+)", re.IGNORECASE)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)


def names_of(rest: str) -> list[str]:
    """The classes and the id of an element that name something around an article."""
    names = [name for found in NAMED.findall(rest) for value in found for name in value.split()]
    return [name for name in names if SURROUNDING_NAMES.search(name) and not MODIFIED.search(name)]


def surrounds_by_kind(tag: str, rest: str, in_story: bool) -> bool:
    """Whether an element's tag or attributes other than its names say that it holds something other than the article."""
    if tag in SURROUNDINGS:
        # A story's own header holds its title.
        return not (in_story and tag == "header")
    if not rest or tag in ("html", "body", "main"):
        return False
    return bool(HIDDEN.search(rest) or ((role := ROLE.search(rest)) and role[1].lower() in SURROUNDING_ROLES))


def surrounds_by_name(tag: str, rest: str, in_story: bool) -> bool:
    """Whether an element's names say that it holds something other than the article; an article's only if it is a comment."""
    if not rest or tag in ("html", "body", "main"):
        return False
    names = names_of(rest)
    if tag == "article":
        return any(COMMENT_NAMES.search(name) for name in names)
    if in_story:
        names = [name for name in names if SURROUNDING_NAMES.search(HEADER_NAMES.sub(" ", name))]
    if tag == "section" and in_story:
        names = [name for name in names if name.lower() not in SECTION_NAMES]
    return bool(names)


class OpenTags:
    """The containers that are open, each with what is known of it; an end tag finds its container at once."""

    def __init__(self) -> None:
        self.held: list[tuple] = []
        self.places: dict[str, list[int]] = {}

    def open(self, tag: str, *known) -> None:
        self.places.setdefault(tag, []).append(len(self.held))
        self.held.append((tag, *known))

    def close(self, tag: str) -> list[tuple]:
        """The containers that an end tag closes, outermost first: the last of its name and all within it; none if none is open."""
        places = self.places.get(tag)
        if not places:
            return []
        closed = self.held[places[-1] :]
        del self.held[places[-1] :]
        for one in closed:
            self.places[one[0]].pop()
        return closed


def story_holders(page: str) -> frozenset[int]:
    """The numbers of the containers that hold the page's story although they are named or formed like surroundings.

    Such a story is the longest article or main element in one of them, and is
    longer than all the text outside surroundings. Comments hold the story only
    of a page that has no other text.
    """
    # Open containers: tag, whether it surrounds by kind, by name, and as comments, whether it counts as a story,
    # and the numbers of the named containers around it, as pairs of a number and the further ones.
    open_tags = OpenTags()
    stories: list[int] = []  # places of the open stories in `lengths`
    lengths: list[int] = []
    found: list[tuple[tuple | None, bool]] = []
    kinds = named = commented = outside = number = 0
    links = 0
    place = 0
    for token in TOKEN.finditer(page):
        if not kinds and token.start() > place:
            size = len(page[place : token.start()].strip())
            if stories:
                lengths[stories[-1]] += size
            if not named and not links:
                outside += size
        place = token.end()
        tag = (token["tag"] or token["tag2"] or "").lower()
        if tag == "a":
            links = 0 if token["end"] or token["end2"] else 1
        if tag == "p" or tag == "li":
            links = 0
        if tag not in CONTAINERS:
            continue
        rest = token["rest"] or token["rest2"] or ""
        if token["end"] or token["end2"]:
            for _, kind, by_name, comment, story, _ in open_tags.close(tag):
                kinds, named, commented = kinds - kind, named - by_name, commented - comment
                if story:
                    stories.pop()
        elif not rest.endswith("/"):
            number += 1
            in_story = bool(stories)
            kind = tag != "form" and surrounds_by_kind(tag, rest, in_story)
            by_name = tag == "form" or surrounds_by_name(tag, rest, in_story)
            comment = by_name and any(COMMENT_NAMES.search(name) for name in names_of(rest))
            around = open_tags.held[-1][-1] if open_tags.held else None
            if by_name:
                around = (number, around)
            story = tag in STORIES and not kinds and not kind
            if story:
                stories.append(len(lengths))
                lengths.append(0)
                found.append((around, bool(commented) or comment))
            open_tags.open(tag, kind, by_name, comment, story, around)
            kinds, named, commented = kinds + kind, named + by_name, commented + comment
    best, around = outside, None
    for length, (containers, comment) in zip(lengths, found, strict=True):
        if length > best and containers and not (comment and outside):
            best, around = length, containers
    holders = set()
    while around:
        number, around = around
        holders.add(number)
    return frozenset(holders)


def lines_of(page: str) -> Iterator[tuple[str, int, bool, int]]:
    """The page's lines in order: a block's text, its weight, whether it stands in a story, and the number of its container.

    The weight is the length; a block of links alone has none outside a story.
    A story's begin and end give a window of empty lines, ("", 0, _, _), any
    number of surroundings in a row a single one. A container that holds the
    page's story is none of the surroundings.
    """
    held: list[str] = []
    linked = length = 0
    holders: frozenset[int] | None = None if STORY.search(page) else frozenset()
    open_tags = OpenTags()  # whether each holds surroundings, and its number
    inside = stories = links = number = 0
    empty = False

    def line() -> Iterator[tuple[str, int, bool, int]]:
        nonlocal linked, length, empty
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                yield text, len(text) if stories or length > linked else 0, stories > 0, open_tags.held[-1][2] if open_tags.held else 0
                empty = False
            held.clear()
        linked = length = 0

    place = 0
    for token in TOKEN.finditer(page):
        if inside == 0 and token.start() > place:
            text = page[place : token.start()]
            held.append(text)
            size = len(text.strip())
            length += size
            linked += size if links else 0
        place = token.end()
        tag = token["tag"] or token["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        ends = token["end"] or token["end2"]
        rest = token["rest"] or token["rest2"] or ""
        if tag == "br":
            held.append(" ")
        elif tag == "a":
            links = 0 if ends else 1
        elif tag in BLOCKS:
            if inside == 0:
                yield from line()
            if tag == "p" or tag == "li":
                links = 0
            if tag not in CONTAINERS:
                continue
            if ends:
                for name, aside, _ in open_tags.close(tag):
                    inside -= aside
                    if name in STORIES and inside == 0:
                        stories -= 1
                        if stories == 0:
                            yield from [("", 0, False, 0)] * WINDOW
            elif not rest.endswith("/"):
                number += 1
                aside = surrounds_by_kind(tag, rest, stories > 0) or surrounds_by_name(tag, rest, stories > 0)
                if aside and inside == 0:
                    if holders is None:
                        holders = story_holders(page)
                    aside = number not in holders
                if aside and inside == 0 and not empty:
                    yield "", 0, stories > 0, 0
                    empty = True
                open_tags.open(tag, aside, number)
                if tag in STORIES and inside == 0 and not aside:
                    if stories == 0:
                        yield from [("", 0, False, 0)] * WINDOW
                    stories += 1
                inside += aside
    if inside == 0 and place < len(page):
        held.append(page[place:])
        length += len(page[place:].strip())
    yield from line()


def main_blocks(page: str, window: int = WINDOW) -> list[str]:
    """The article's blocks: the text between the surge and the dive of the heaviest run of lines.

    Runs in a story come before all others, whatever their weight. Neighbouring
    runs with blocks in the same container are parts of one.
    """
    lines = list(lines_of(page))
    lengths = np.array([0] * window + [n for _, n, _, _ in lines] + [0] * window, dtype=np.int64)
    sums = np.convolve(lengths, np.ones(window, np.int64), "valid")  # of the lines from i to i + window - 1
    full = sums > 0
    # The run's own lines begin where the window reaches the first and end where it leaves the last.
    surges = np.flatnonzero(full[1:] & ~full[:-1])
    dives = np.flatnonzero(full[:-1] & ~full[1:]) + 1 - window
    runs: list[tuple[int, int]] = []
    last: set[tuple[bool, int]] = set()
    for first, end in zip(surges.tolist(), dives.tolist(), strict=True):
        homes = {(s, home) for _, n, s, home in lines[first:end] if n}
        if last & homes:
            runs[-1] = (runs[-1][0], end)
            last |= homes
        else:
            runs.append((first, end))
            last = homes

    def weight(run: tuple[int, int]) -> tuple[bool, int]:
        own = lines[slice(*run)]
        return any(s and n for _, n, s, _ in own), sum(n for _, n, _, _ in own)

    best = max(runs, key=weight, default=(0, 0))
    return [text for text, _, _, _ in lines[slice(*best)] if text]


def main_text(page: Column | str) -> Column:
    """Column of a page's main text, its blocks joined by an empty line; empty for a page without one, or null."""

    @arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(("\n\n".join(main_blocks(p)) for p in texts_of(batch)), pa.string())

    return extract(page)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    A null or empty page, or one without an article, has an empty text. Rows
    stay apart, also when they repeat or have no id; other columns are not
    read. An empty table gives an empty result.
    """
    return pages.select("page_id", "url", main_text("html").alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
