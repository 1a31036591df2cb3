"""Main-text extraction by consensus host paths.

Each page is parsed once: its blocks of text, and its containers with their scores, are written to a scratch table that has no markup any more. A block counts for the container that it
stands in, less for those around it, link text not at all. The best containers of each page vote, by their share of its best score, for their generalised path (tags with classes, digits unified); Spark sums
the votes per host and path, and each page's text is then re-extracted by its host's winning path, from the blocks. A page where the winner is absent or empty uses its own best container. Containers beside
the one found, with the same parent and the same path that ends in a class or an article, belong to it: parts of an article are not left out.

Tags and attributes are read by the rules of HTML: quotes inside an unquoted value are part of it, a slash before the end of a tag means nothing but in svg and math.

Hosts: votes are summed before the shuffle. Winners (a row a host) meet the pages in a plain join on the host: Spark broadcasts the winners where their size allows, else both sides are exchanged and
adaptive execution may split a hot host; no html is shuffled.

Defined results: a null or empty page has an empty text and no vote; a null or odd url belongs to the host ''; repeated rows are extracted each for itself;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from kindred.llm.arrow import column, slices, texts
from kindred.plans.scratch import Scratch

#: Elements whose content is never text of the page.
RAW = frozenset("script style title textarea noscript template iframe xmp svg math object canvas select button audio video".split())
#: Elements that are boilerplate as a whole.
NOISE = frozenset("nav header footer aside form menu dialog".split())
#: Elements that can hold blocks.
STRUCTURE = frozenset("html body div section article main table thead tbody tfoot tr td th ul ol dl figure blockquote details fieldset center".split()) | NOISE
#: Elements that begin and end a block.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr address figcaption caption summary legend option".split()) | STRUCTURE
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in a class, id or role that mark boilerplate.
MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer footer form header hidden login masthead menu modal nav navbar navigation newsletter notice "
    "notification pagination pager popup promo promoted related reply replies respond search share sharing sidebar signup skyscraper social sponsor sponsored subscribe toolbar widget widgets contentinfo complementary alert".split()
)
#: What a block's score keeps with each container further out; the bonus of elements made for main text.
DECAY, BONUS = 0.8, {"article": 1.6, "main": 1.4}
#: Words that make a class of an article's own parts (entry-header), and words that mark boilerplate elsewhere only.
CONTENT = frozenset("article body chapter content entry heading main page post section story text title".split())
SOFT = frozenset("alert banner form header masthead notice reply respond search widget".split())
_VALUE = r"\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+|(?=>))"
_TAG = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]*+[^\s/>][^\s/>=]*+(?:{_VALUE})?+)*+)([\s/]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+)({_VALUE})?+")
_WORD = re.compile(r"[a-z]+")


def _hints(attributes: str, inside: bool) -> tuple[bool, str]:
    """Whether class, id or role mark boilerplate (``inside`` an article its own parts don't), and the generalised classes."""
    noise, classes = False, ""
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name not in ("class", "id", "role"):
            continue
        value = value.partition("=")[2].strip().strip("\"'").lower()
        for token in value.split():
            words = set(_WORD.findall(token))
            noise = noise or bool(words & MARKS - (SOFT if inside and words & CONTENT else frozenset()))
        if name == "class":
            classes = "".join("." + c for c in sorted(set(re.sub(r"\d+", "0", value).split())))
    return noise, classes


class Page:
    """Blocks of a page and its containers: [path, tag, score, first block, block after the last, number of the container around or -1]."""

    def __init__(self, page: str):
        self.blocks: list[str] = []
        self.nodes: list[list] = []
        self._read(page)

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int, bool]] = []  # tag, node or -1, boilerplate
        parts: list[str] = []
        linked, link, noise, at = 0, False, 0, 0

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(parts).split())
            parts.clear()
            if text and not noise:
                worth = max(len(text) - linked, 0)
                for _, node, _ in reversed(stack):
                    if node >= 0:
                        self.nodes[node][2] += worth
                        worth *= DECAY
                self.blocks.append(text)
            linked = 0

        def close() -> None:
            nonlocal noise
            _, node, dull = stack.pop()
            noise -= dull
            if node >= 0:
                self.nodes[node][4] = len(self.blocks)

        end = len(page)
        while at < end:
            m = _TAG.search(page, at)
            if m is None:
                if not noise:
                    parts.append(entities.unescape(page[at:]))
                break
            if m.start() > at and not noise:
                said = entities.unescape(page[at : m.start()])
                parts.append(said)
                if link:
                    linked += len(said.strip())
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            closing, attributes, empty = m[1], m[3], "/" in m[4]
            if not closing and tag in RAW:
                if empty and tag in ("svg", "math"):
                    continue
                over = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
                at = over.end() if over else at if empty else end
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag in BLOCKS:
                flush()
                link = False
            if closing:
                link = link and tag != "a"
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == tag:
                        if tag not in BLOCKS and any(t in STRUCTURE for t, _, _ in stack[depth + 1 :]):
                            break
                        if tag in BLOCKS:
                            flush()
                        while len(stack) > depth:
                            close()
                        break
                    if tag not in STRUCTURE and stack[depth][0] in STRUCTURE:
                        break
                continue
            if tag in VOID:
                continue
            if tag in BLOCKS:  # open paragraphs, items and headings end where a block begins
                while stack and stack[-1][0] not in STRUCTURE and (stack[-1][0] in BLOCKS or tag in STRUCTURE):
                    close()
            if tag == "a":
                link = True
            dull, classes = _hints(attributes, any(t in ("article", "main") for t, _, _ in stack)) if "=" in attributes else (False, "")
            dull = (dull and tag not in ("html", "body", "main", "article")) or tag in NOISE
            if tag in STRUCTURE:
                around = next((n for _, n, _ in reversed(stack) if n >= 0), -1)
                self.nodes.append([f"{self.nodes[around][0] if around >= 0 else ''}/{tag}{classes}", tag, 0.0, len(self.blocks), -1, around])
                stack.append((tag, len(self.nodes) - 1, dull))
                noise += dull
            elif dull:
                flush()
                stack.append((tag, -1, True))
                noise += 1
        flush()
        while stack:
            close()
        if not self.nodes and self.blocks:
            self.nodes.append(["", "", float(sum(map(len, self.blocks))), 0, len(self.blocks), -1])
        for node in self.nodes:
            node[2] *= BONUS.get(node[1], 1.0)

    def ranked(self) -> list[list]:
        """Containers with text, best first; of equals the first."""
        return sorted((n for n in self.nodes if n[2] > 0), key=lambda n: -n[2])

    def choices(self) -> dict[str, list[int]]:
        """For each path, best first, the blocks [first, after the last, ..] of its best container and of those that belong to it."""
        out, beside = {}, {}
        for path, tag, score, first, end, around in self.nodes:
            if score > 0 and (tag == "article" or "." in path.rpartition("/")[2]):
                beside.setdefault((path, around), []).extend((first, end))
        for path, _, _, first, end, around in self.ranked():
            if path not in out:
                out[path] = beside.get((path, around), [first, end])
        return out

    def text(self, path: str | None) -> str:
        choices = self.choices()
        spans = choices.get(path) or next(iter(choices.values()), [])
        return "\n".join(b for first, end in zip(spans[::2], spans[1::2]) for b in self.blocks[first:end])


#: Containers of a page that vote, and the power of their share of the best one's score: wrappers, second on every page, must not win by diligence.
VOTERS, SHARPNESS = 3, 4
_PARSED = "page_id long, url string, host string, blocks array<string>, keys array<long>, spans array<array<int>>, voters array<struct<path: string, votes: long>>"
_VOTER = pa.struct([("path", pa.string()), ("votes", pa.int64())])


def path_key(path: str) -> int:
    """A signed 64-bit number for a path; a page has thousands at most."""
    return xxhash.xxh64_intdigest(path) - (1 << 63)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        blocks, keys, spans, voters = [], [], [], []
        for html in texts(batch, "html"):
            page = Page(html)
            choices, ranked = page.choices(), page.ranked()[:VOTERS]
            blocks.append(page.blocks)
            keys.append([path_key(p) for p in choices])
            spans.append(list(choices.values()))
            voters.append([{"path": n[0], "votes": round(1000 * (n[2] / ranked[0][2]) ** SHARPNESS)} for n in ranked])
        arrays = [pa.array(blocks, pa.list_(pa.string())), pa.array(keys, pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(voters, pa.list_(_VOTER))]
        yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("page_id", "url", "host")), *arrays], ["page_id", "url", "host", "blocks", "keys", "spans", "voters"])


def parsed(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, host, blocks, and of each path: key and spans of blocks, best first; and the paths that vote."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return scratch.cut(pages.select(F.col("page_id").cast("long"), F.col("url"), host.alias("host"), F.col("html")).mapInArrow(_parsed, _PARSED))


def host_paths(told: DataFrame, scratch: Scratch) -> DataFrame:
    """host, path, key: the consensus of each host's ``parsed`` pages."""
    votes = told.select("host", F.explode("voters").alias("v")).groupBy("host", "v.path").agg(F.sum("v.votes").alias("votes"))
    return scratch.cut(votes.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path")))


def extract(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, text for every row of ``pages`` (page_id, url, html)."""
    told = parsed(pages, scratch)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([path_key(p) for p in column(batch, "path").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([column(batch, "host"), keys], ["host", "key"])

    winners = scratch.cut(host_paths(told, scratch).mapInArrow(keyed, "host string, key long"))
    at = F.greatest(F.coalesce(F.array_position("keys", F.col("key")), F.lit(0)), F.lit(1)).cast("int")
    spans = F.coalesce(F.try_element_at("spans", at), F.array().cast("array<int>"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(spans) / 2).cast("int") - 1), lambda i: F.slice("blocks", F.get(spans, 2 * i) + 1, F.get(spans, 2 * i + 1) - F.get(spans, 2 * i)))
    text = F.when(F.size(spans) > 0, F.array_join(F.flatten(pairs), "\n")).otherwise("")
    return told.join(winners, "host", "left").select("page_id", "url", text.alias("text"))


def op5_html_host_paths(spark, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), Scratch(spark, "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
