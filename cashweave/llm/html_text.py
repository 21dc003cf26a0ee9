"""Main text of web pages by union-free regular expressions.

A page is read as a stream of block tags and text slots. Repetitions of a
group of tokens fold into one repeated group, so a page becomes a short
expression such as ``<body <nav (<li # >li)+ >nav <article # (<p # >p)+``. The
expressions of a host's pages are aligned one after the other: tokens that
only one side has become optional, text stays a slot. The result, a
union-free regular expression, is the host's wrapper.

Text that is the same at a place (region and path) on most of the host's pages
that have the place, at least ``TEMPLATE_PAGES`` of differing text, is template
and a token of its own in the expressions; only other text is a slot. This is
counted over whole hosts before pages fold. An ``<article>`` says itself that
it holds content, so its texts are always slots. Slots are judged
once per host: those inside menus, headers, footers, sidebars, notices,
adverts, forms and comments are boilerplate, within a content region (article,
main, named content) only menus, forms, adverts and comment lists. Of the
others a page's text in content regions is main text, nested or side by side,
and so is text outside of them, with few links, on pages that have more of it.
Extraction keeps, in page order, the text of the chosen slots.

Pages fold in parallel and only distinct expressions of a host meet, in groups
of ``MERGE`` at most, so a host with a third of all pages is no hot group.

Nulls and ties: a null html is empty, and so is its text; pages without a host
form one host; repeated rows get equal text; as much text outside of content
regions as in them is left out; a page of template text alone keeps it.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashweave.llm.common import small_side, stored

MERGE = 256
BROADCAST_HOSTS = 20_000
MAX_PERIOD = 24          # tokens of the longest group looked for as a repetition
TEMPLATE_PAGES = 3       # pages of differing text from which on equal text can be template
LOOSE = 4                # kind of region of text outside any named one
MAX_DEPTH = 40           # ancestors that tell slots of one region apart

# HTML's element kinds.
BLOCK = frozenset("html body head header footer main article section nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd menu "
                  "table thead tbody tfoot tr td th caption form fieldset figure figcaption blockquote pre address details "
                  "summary hr dialog center hgroup search button select option label textarea".split())
RAW = frozenset("script style title textarea iframe xmp noframes".split())
CODE = frozenset("script style".split())
FOREIGN = frozenset("svg object canvas audio video template noscript".split())
VOID = frozenset("hr".split())
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
          "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
ENDS_P = BLOCK - frozenset("button select option label textarea body html head".split())
HOLDERS = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]),
           "td": frozenset(["table"]), "th": frozenset(["table"]), "option": frozenset(["select"])}

# What marks boilerplate and content.
BOILER_TAGS = frozenset("head nav footer aside form menu dialog button select option label textarea fieldset search".split())
BOILER_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side rail "
                         "nav navbar navigation menu breadcrumb breadcrumbs footer foot header masthead topbar toolbar cookie "
                         "cookies consent gdpr notice notices alert popup modal overlay share sharing social follow subscribe "
                         "subscription newsletter signup login search comment comments reply replies disqus discussion respond "
                         "related recommended recommendations popular trending pagination pager tags widget copyright".split())
# In a content region only these are boilerplate: adverts, comment lists, menus.
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond".split())
INNER_WORDS = COMMENT_WORDS | frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo sidebar nav navbar navigation "
                                        "menu breadcrumb breadcrumbs pagination pager share sharing newsletter cookie cookies consent gdpr".split())
SHAPE_WORDS = frozenset("box boxes wrap wrapper container area section block blocks list bar left right top bottom inner outer page site "
                        "global panel unit slot widget widgets col column links item items row module thread form small large".split())
CONTAINERS = frozenset("div section ul ol dl table tbody thead tr td details figure center header".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
CONTENT_WORDS = frozenset("content article post entry story body text maintext articlebody".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_WORD = re.compile(r"[a-z]+")


@lru_cache(1 << 14)
def _mark(tag: str, attrs: str) -> str:
    """Tag with the words of its class, id, role and itemprop, digits left out."""
    if "=" not in attrs:
        return tag
    found = []
    for name, value in _ATTR.findall(attrs):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop"):
            value = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
            found += [("@" if name == "role" else ".") + w for w in _WORD.findall(value)]
    return tag + "".join(dict.fromkeys(found))


@lru_cache(1 << 14)
def _names(attrs: str) -> tuple[list[list[str]], list[list[str]]]:
    """The words of each class, and of the id."""
    found: dict[str, list[list[str]]] = {"class": [], "id": []}
    for name, value in _ATTR.findall(attrs):
        if name.lower() in found:
            value = re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().strip("\"'")
            found[name.lower()] += [words for words in map(_WORD.findall, value.split()) if words]
    return found["class"], found["id"]


def _all_of(name: list[str], words: frozenset) -> bool:
    """Whether a class or id says nothing but one of these words, and what shape it has."""
    return any(w in words for w in name) and all(w in words or w in SHAPE_WORDS for w in name)


@lru_cache(1 << 14)
def _region(kind: int, tag: str, mark: str, attrs: str = "") -> int:
    """Region of an element in a region: 0 boilerplate; else the kind, the lower the better."""
    if not kind:
        return 0
    words = re.split(r"(?=[.@])", mark)[1:]
    names = {w[1:] for w in words if w[0] == "."}
    roles = {w[1:] for w in words if w[0] == "@"}
    if tag in BOILER_TAGS or roles & BOILER_ROLES or (tag == "header" and kind == LOOSE):
        return 0
    if tag in CONTAINERS:
        classes, ids = _names(attrs)
        if any(_all_of(n, INNER_WORDS) for n in classes) or any(_all_of(n, COMMENT_WORDS) for n in ids):
            return 0
        if kind == LOOSE and any(_all_of(n, BOILER_WORDS) for n in classes + (ids if tag != "section" else [])):
            return 0
    elif kind == LOOSE and tag == "p" and any(_all_of(n, BOILER_WORDS) for n in _names(attrs)[0]):
        return 0
    if tag == "article" or "article" in roles or "articlebody" in names or {"article", "body"} <= names:
        return 1
    if tag == "main" or "main" in roles:
        return min(kind, 2)
    if tag in ("div", "section", "td") and names & CONTENT_WORDS:
        return min(kind, 3)
    return kind


def _path(marks: list[str]) -> str:
    """The nearest ancestors of a slot, equal ones in a row once."""
    near = marks[-MAX_DEPTH:]
    return " ".join(m for k, m in enumerate(near) if not k or m != near[k - 1])


def _spans(page: str, tag: str) -> dict[int, int]:
    """End of each closed element of a kind by the end of its start tag; nested
    ones are paired, self-closed and unclosed ones are not there."""
    spans, opened = {}, []
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.I).finditer(page):
        if not m[1]:
            if not m[2].endswith("/"):
                opened.append(m.end())
        elif opened:
            spans[opened.pop()] = m.end()
    return spans


def blocks_of(html: str | None) -> tuple[list[str], list[tuple[str, str, int, int]]]:
    """Token stream, and the text blocks as (path, text, characters in links,
    kind of region); the region is that of all ancestors."""
    tokens: list[str] = []
    blocks: list[tuple[str, str, int, int]] = []
    stack: list[tuple[str, str, int]] = []
    spans: dict[str, dict[int, int]] = {}
    text: list[str] = []
    links = [0, 0]                                  # open anchors, characters within

    def flush():
        if text:
            whole = " ".join(html_lib.unescape("".join(text)).split())
            text.clear()
            if whole:
                path = _path([m for _, m, _ in stack[-MAX_DEPTH:]])
                tokens.append("#")
                blocks.append((path, whole, min(links[1], len(whole)), stack[-1][2] if stack else LOOSE))
        links[1] = 0

    def close(until: int):
        flush()
        while len(stack) > until:
            tokens.append(">" + stack.pop()[1])

    page, at = html or "", 0
    find = _TAG.search
    while True:
        m = find(page, at)
        piece = page[at:m.start() if m else len(page)]
        if piece:
            text.append(piece)
            if links[0]:
                links[1] += len(piece)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ends = bool(m[1] or m[4])
        if tag in FOREIGN and not ends:
            if tag not in spans:
                spans[tag] = _spans(page, tag)
            at = spans[tag].get(at, at)
            continue
        if tag in RAW and not ends:
            if tag in spans or (m[3] or "").endswith("/") and tag not in CODE:
                continue                            # self-closed, or none of its kind is closed from here on
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if stop or tag in CODE:
                at = stop.end() if stop else len(page)
            else:
                spans[tag] = {}
            continue
        if tag not in BLOCK:
            if tag == "a":
                links[0] = 0 if ends else 1
            elif tag == "br" or tag == "img":
                text.append(" ")
            continue
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            else:
                flush()
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] != "p" and stack[k][0] in ENDS_P:
                    break
        if tag in CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES[tag]:
                    close(k)
                    break
                if stack[k][0] in HOLDERS.get(tag, ()) or tag == "p":
                    break
        flush()
        attrs = m[3] or m[6] or ""
        mark = _mark(tag, attrs)
        tokens.append("<" + mark)
        if tag not in VOID:
            stack.append((tag, mark, _region(stack[-1][2] if stack else LOOSE, tag, mark, attrs if "=" in attrs else "")))
    close(0)
    return tokens, blocks


class Folder:
    """Folds token streams; symbols are one character each, so that repeated
    groups are found by a regular expression."""

    _REPEAT = re.compile(rf"(.{{1,{MAX_PERIOD}}}?)\1+", re.S)

    def __init__(self):
        self.char: dict[str, str] = {}
        self.name: dict[str, str] = {}

    def symbol(self, name: str) -> str:
        if name not in self.char:
            c = chr(0x10000 + len(self.char))
            self.char[name], self.name[c] = c, name
        return self.char[name]

    def fold(self, tokens: list[str]) -> list[str]:
        if len(self.char) > 500_000:
            self.char.clear()
            self.name.clear()
        stream, before = "".join(map(self.symbol, tokens)), None
        while stream != before:
            before = stream
            stream = self._REPEAT.sub(lambda m: self._group(m[1]), stream)
        return [self.name[c] for c in stream]

    def _group(self, chars: str) -> str:
        if len(chars) == 1 and self.name[chars].startswith("("):
            return chars                            # a repetition of a repetition is one
        return self.symbol("(" + " ".join(self.name[c] for c in chars) + ")+")


def align(wrapper: list[list], sample: list[list]) -> list[list]:
    """Align two expressions of [token, optional]; what only one of them has is
    optional. A group met once on one side and repeated on the other is repeated."""
    wrapper, sample = _same_groups(wrapper, sample), _same_groups(sample, wrapper)
    out: list[list] = []
    match = SequenceMatcher(None, [t for t, _ in wrapper], [t for t, _ in sample], autojunk=False)
    for op, a, b, c, d in match.get_opcodes():
        if op == "equal":
            out += [[t, o or p] for (t, o), (_, p) in zip(wrapper[a:b], sample[c:d])]
        else:
            out += [[t, True] for t, _ in wrapper[a:b]] + [[t, True] for t, _ in sample[c:d]]
    return out


def _same_groups(one: list[list], other: list[list]) -> list[list]:
    groups = {t: t[1:-2].split(" ") for t, _ in other if t.startswith("(") and "(" not in t[1:]}
    for group, tokens in groups.items():
        k, out = 0, []
        while k < len(one):
            if [t for t, _ in one[k:k + len(tokens)]] == tokens:
                out.append([group, any(o for _, o in one[k:k + len(tokens)])])
                k += len(tokens)
            else:
                out.append(one[k])
                k += 1
        one = out
    return one


def slots_of(wrapper: list[list]) -> set[str]:
    """Paths of the text slots of an expression."""
    stack: list[str] = []
    paths = set()
    for token in " ".join(t for t, _ in wrapper).replace("(", "").replace(")+", "").split(" "):
        if token == "#":
            paths.add(_path(stack))
        elif token.startswith("<"):
            if token[1:].split(".")[0].split("@")[0] not in VOID:
                stack.append(token[1:])
        elif token.startswith(">") and token[1:] in stack:
            while stack.pop() != token[1:]:
                pass
    return paths


def template_of(wrapper: list[list]) -> list[str]:
    """Keys of the template texts of an expression."""
    return sorted({t[1:] for t in " ".join(t for t, _ in wrapper).replace("(", "").replace(")+", "").split(" ") if t.startswith("=")})


def _has_slot(slots: set[str], path: str) -> bool:
    """Whether a page's slot is one of the wrapper's, optional ancestors left out."""
    marks = path.split(" ")

    def within(slot: str) -> bool:
        rest = iter(slot.split(" "))
        return all(m in rest for m in marks)

    return path in slots or any(within(slot) for slot in slots)


def _slot(region: int, path: str) -> str:
    return f"{region} {path}"


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))


def _key(*parts: str) -> str:
    return hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _can_be_template(region: int) -> bool:
    return region > 1


def template_texts(pages: DataFrame) -> DataFrame:
    """``host, template``: keys of the texts that are the same on most pages,
    stored. Pages of equal text count once; of each place the pages are counted
    (rows without a text) and of each text there."""

    def run(batches):
        for b in batches:
            rows = set()
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                blocks = [(_slot(region, path), text, region) for path, text, _, region in blocks_of(page)[1]]
                places = [(slot, text) for slot, text, region in blocks if _can_be_template(region)]
                if places:
                    whole = _key(*[part for slot, text, _ in blocks for part in (slot, text)])
                    for slot, text in places:
                        place = _key(slot)
                        rows.add((host, place, None, whole))
                        rows.add((host, place, _key(slot, text), whole))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["host", "place", "text", "page"])

    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    counts = stored(rows.mapInArrow(run, "host string, place string, text string, page string").distinct()
                    .groupBy("host", "place", "text").agg(F.count(F.lit(1)).alias("pages"))
                    .filter(F.col("pages") >= TEMPLATE_PAGES), "texts")
    places = counts.filter("text IS NULL").select("host", "place", F.col("pages").alias("of"))
    same = counts.filter("text IS NOT NULL").join(places, ["host", "place"]).filter("2 * pages > of")
    return stored(same.groupBy("host").agg(F.concat_ws(" ", F.sort_array(F.collect_list("text"))).alias("template")), "template")


def folded_pages(pages: DataFrame, template: DataFrame | None = None) -> DataFrame:
    """Distinct expressions and slot paths by host, with counts, stored:
    ``host, kind, value, pages, chars, links``."""

    def run(batches):
        folder = Folder()
        known: dict[str, frozenset] = {}
        for b in batches:
            sums: dict[tuple, list] = {}
            for host, page, same in zip(*(b.column(i).to_pylist() for i in range(3))):
                if same not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[same] = frozenset((same or "").split())
                tokens, blocks = blocks_of(page)
                texts, by = iter(blocks), {}
                for k, token in enumerate(tokens):
                    if token != "#":
                        continue
                    path, text, linked, region = next(texts)
                    slot = _slot(region, path)
                    if known[same] and _can_be_template(region) and (key := _key(slot, text)) in known[same]:
                        tokens[k] = "=" + key
                        continue
                    p = by.setdefault(slot, [0, 0])
                    p[0], p[1] = p[0] + len(text), p[1] + linked
                rows = [((host, "expression", json.dumps([[t, False] for t in folder.fold(tokens)])), (0, 0))]
                rows += [((host, "path", path), v) for path, v in by.items()]
                for key, (chars, linked) in rows:
                    s = sums.setdefault(key, [0, 0, 0])
                    s[0], s[1], s[2] = s[0] + 1, s[1] + chars, s[2] + linked
            keys, values = list(sums), list(sums.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in keys], pa.string()) for i in range(3)]
                + [pa.array([v[i] for v in values], pa.int64()) for i in range(3)],
                ["host", "kind", "value", "pages", "chars", "links"])

    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    if template is None:
        rows = rows.withColumn("template", F.lit(None).cast("string"))
    else:
        rows = rows.join(small_side(template, BROADCAST_HOSTS), "host", "left").select("host", "html", "template")
    return stored(rows.mapInArrow(run, "host string, kind string, value string, pages long, chars long, links long")
                  .groupBy("host", "kind", "value").agg(*[F.sum(c).alias(c) for c in ("pages", "chars", "links")]), "folded")


def wrappers_of(folded: DataFrame) -> DataFrame:
    """``host, wrapper, slots``: each host's wrapper, and as JSON the slots
    that can hold main text with the kind of region they are in, and the keys
    of the wrapper's template texts."""
    expressions = folded.filter("kind = 'expression'").select("host", "value", "pages")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pages", "value"], ascending=[False, True])
        wrapper = json.loads(pdf["value"].iloc[0])
        for value in pdf["value"].iloc[1:]:
            wrapper = align(wrapper, json.loads(value))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "value": [json.dumps(wrapper)], "pages": [int(pdf["pages"].sum())]})

    while True:
        sizes = expressions.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / MERGE).alias("groups"))
        many = sizes.agg(F.max("groups")).first()[0] or 1
        dealt = expressions.join(sizes, "host").withColumn("group", F.pmod(F.xxhash64("value"), F.col("groups")))
        expressions = stored(dealt.groupBy("host", "group").applyInPandas(merge, "host string, value string, pages long"), "wrappers")
        if many <= 1:
            break

    paths = folded.filter("kind = 'path'").groupBy("host").agg(
        F.collect_list(F.struct("value", "pages", "chars", "links")).alias("paths"))

    def judge(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                wrapper = json.loads(r.value)
                slots = slots_of(wrapper)
                kinds = {}
                for p in r.paths if r.paths is not None else []:
                    region, path = p["value"].split(" ", 1)
                    kind = int(region) if _has_slot(slots, path) else 0
                    if kind == LOOSE and p["links"] > 0.5 * p["chars"]:
                        kind = 0
                    if kind:
                        kinds[p["value"]] = kind
                rows.append((r.host, r.value, json.dumps([kinds, template_of(wrapper)])))
            yield pd.DataFrame(rows, columns=["host", "wrapper", "slots"])

    return stored(expressions.join(paths, "host", "left").select("host", "value", "paths")
                  .mapInPandas(judge, "host string, wrapper string, slots string"), "judged")


def chosen(found: list[tuple[int, str]]) -> list[str]:
    """Texts of a page's content regions (article, main, named, nested or side
    by side), with the loose ones if those hold more of the page's text."""
    named, loose = (sum(len(t) for k, t in found if k and (k == LOOSE) == is_loose) for is_loose in (False, True))
    return [t for k, t in found if k and (k != LOOSE or loose > named)]


def extract(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every page."""
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    joined = rows.join(small_side(wrappers.select("host", "slots"), BROADCAST_HOSTS), "host", "left") \
        .select("page_id", "url", "html", "slots")

    def run(batches):
        known: dict[str, tuple] = {}
        for b in batches:
            texts = []
            for page, slots in zip(*(b.column(i).to_pylist() for i in (2, 3))):
                if slots not in known:
                    if len(known) > 1000:
                        known.clear()
                    kinds, same = json.loads(slots or "[{}, []]")
                    known[slots] = kinds, frozenset(same)
                kinds, same = known[slots]
                found, template = [], []
                for path, text, linked, region in blocks_of(page)[1]:
                    if region == LOOSE and linked > 0.5 * len(text):
                        continue
                    slot = _slot(region, path)
                    if same and _can_be_template(region) and _key(slot, text) in same:
                        template.append((region, text))
                    else:
                        found.append((kinds.get(slot, 0), text))
                texts.append("\n\n".join(chosen(found) or chosen(template)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    schema = rows.select("page_id", "url").schema.add("text", "string")
    return joined.mapInArrow(run, schema)


def main_text(pages: DataFrame) -> DataFrame:
    return extract(pages, wrappers_of(folded_pages(pages, template_texts(pages))))
