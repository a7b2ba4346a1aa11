"""Main text of web pages, by structure and by nearest-URL page differencing.

A page becomes lines, one for each block, with character references decoded and white
space collapsed. Elements that by name, role, class or id are menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles or reader comments give no lines.

Plain differencing, which deletes every line that a page shares with its neighbour,
cannot give right results alone: mirrored articles, quoted passages and common headings
are shared as well, and pages without a neighbour keep their menus. So where a page has an
article or main element the rest goes, and lines inside are kept, but for those that
structure leaves in doubt: of an element whose class or id has a word such as "share" or
"notice", with which articles have names too, or any such word among others. Words such as
"comments" or "advert" leave no doubt. A line in doubt that is a link for the most part goes,
whatever neighbours have. In a page without such an element every line is in doubt.
Pages are aligned, by a longest common subsequence of lines, with their neighbour: the next
page of the same host in order of URL path, or the one before for a host's last page.
Lines in doubt that they share go as well; none goes where no line were left.

Pages are shuffled once, into ranges of (host, path, page_id). No range starts with a
host's last page, so every page meets its neighbour in one task, and a host of any size
is spread over tasks that stream through it holding two pages.

Rows: null html gives empty text; a null or odd url is a page of the host "", which has
neighbours there like any; repeated rows keep a row each and may be each other's
neighbours (sharing all lines, they lose none); a null page_id comes first.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import with_successors

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
NO_TEXT = frozenset(
    "head nav footer aside form button select datalist dialog menu object audio video canvas svg math template applet".split()
) | RAW
#: Words of a class, id or role that mark what is not the article.
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies consent "
    "gdpr notice notices alert disclaimer sidebar aside menu nav navbar navigation breadcrumb breadcrumbs toc footer masthead "
    "comment comments commentlist disqus respond replies reply share sharing social related recommended recommendations newsletter "
    "subscribe subscription signup login popup modal overlay paywall skip pagination pager contentinfo complementary search "
    "searchbox toolbar widget copyright".split()
)
#: Those of them that, even beside words of ``PARTS``, may as well name a subject.
SUBJECTS = frozenset("alert disclaimer menu notice notices search".split())
#: Those that, alone, may as well name a subject or be short for something else.
SHORT = frozenset("ad ads aside banner consent copyright overlay promo promoted promotion recommended related reply respond share sharing skip social toc toolbar widget".split())
#: Those that name reader comments, adverts or forms in any company.
ALWAYS = frozenset("adverts advertisement commentlist comments disqus newsletter".split())
#: Words that, beside one of ``NOT_ARTICLE``, name a part of the page and not a subject.
PARTS = frozenset(
    "area bar block body box btn button buttons card container content form frame group head header icons inner item items "
    "links list module panel placeholder posts pane region row section slot thread title unit wrap wrapper zone".split()
)
_CONTAINER = frozenset(("article", "main"))
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[^<]+|<", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_WORD = re.compile(r"[a-z]+")


SURE, DOUBT = 2, 1


def _marked(attributes: str, own: bool = False) -> int:
    """What class, id and role say: ``SURE``, the element is neither the article nor of it, as a
    name holds nothing but such words, and not only ``SUBJECTS`` or one that is ``SHORT``, or
    holds one of ``ALWAYS`` (which says nothing about an article element itself, its ``own``);
    ``DOUBT``, only some words say so; 0."""
    found = 0
    for name, *value in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            for token in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", "".join(value)).lower().split():
                words = _WORD.findall(token)
                said = NOT_ARTICLE.intersection(words)
                if said:
                    whole = all(w in NOT_ARTICLE or w in PARTS for w in words) and not said <= (SUBJECTS if len(words) > 1 else SUBJECTS | SHORT)
                    sure = whole or name.lower() == "role" or not own and not ALWAYS.isdisjoint(words)
                    found = max(found, SURE if sure else DOUBT)
    if re.search(r"(?i)\bhidden(?=[\s=/]|\Z)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", attributes):
        return SURE
    return found


class Page:
    """Lines of one page, and for each whether it is in ``doubt`` and whether it is in doubt and
    mostly ``linked``; ``contained`` if the page has an article or main element."""

    def __init__(self, html: str):
        inside: list[tuple[str, bool, bool]] = []
        every: list[tuple[str, bool, bool]] = []
        held: list[str] = []
        stack: list[tuple[str, bool, bool, bool]] = []  # name, starts a skip, a container, a doubt
        opened: dict[str, int] = {}
        skip = box = doubt = links = 0
        contained = False
        at = 0

        def flush():
            nonlocal links
            line = " ".join("".join(held).split())
            linked = doubt > 0 and 2 * links > len(line)
            held.clear()
            links = 0
            if line:
                every.append((line, True, linked))
                if box:
                    inside.append((line, doubt > 0, linked))

        while m := _TOKEN.match(html, at):
            at = m.end()
            name = m[2]
            if name is None:
                if m[0][:1] != "<" or m[0] == "<":
                    if not skip:
                        held.append(references.unescape(m[0]))
                        if doubt and opened.get("a"):
                            links += len(held[-1].strip())
                continue
            name = name.lower()
            if m[1]:  # an end tag closes the nearest element of its name, if one is open
                if name in BLOCKS:
                    flush()
                if opened.get(name):
                    while True:
                        n, skips, boxes, doubts = stack.pop()
                        opened[n] -= 1
                        skip -= skips
                        if boxes or doubts:
                            flush()
                        box -= boxes
                        doubt -= doubts
                        if n == name:
                            break
                continue
            if name in BLOCKS:
                flush()
                if stack and stack[-1][0] == "p":
                    _, skips, boxes, doubts = stack.pop()
                    skip, box, doubt = skip - skips, box - boxes, doubt - doubts
                    opened["p"] -= 1
            elif name == "br":
                held.append(" ")
            if name in VOID:
                continue
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            attributes = m[3]
            outer = name in _CONTAINER and not box
            mark = _marked(attributes, outer) if attributes.strip() and name not in ("html", "body") else 0
            mark = 0 if outer and mark == DOUBT else mark
            # an article's own header holds its title
            skips = name in NO_TEXT or (name == "header" and not box) or mark == SURE or (mark == DOUBT and not box)
            role = re.search(r"(?i)\brole\s*=\s*[\"']?(main|article)\b", attributes) if attributes else None
            boxes = not skip and not skips and (name in _CONTAINER or bool(role))
            doubts = not skips and mark == DOUBT
            contained = contained or boxes
            if doubts:
                flush()
            stack.append((name, skips, boxes, doubts))
            opened[name] = opened.get(name, 0) + 1
            skip += skips
            box += boxes
            doubt += doubts
        flush()
        self.contained = contained
        kept = inside if contained else every
        self.lines = [line for line, _, _ in kept]
        self.doubt = [d for _, d, _ in kept]
        self.linked = [k for _, _, k in kept]


def _lengths(a: list[str], b: list[str]) -> list[int]:
    """LCS length of ``a`` and each prefix of ``b``, a word of bits at a time."""
    width = len(b)
    full = (1 << width) - 1
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    v = full
    for x in a:
        hit = v & where.get(x, 0)
        v = ((v + hit) | (v - hit)) & full
    out, n = [0], 0
    bits = bin(v | 1 << width)[:2:-1]
    for c in bits:
        n += c == "0"
        out.append(n)
    return out


def common(a: list[str], b: list[str]) -> list[int]:
    """Indices of ``a`` in one longest common subsequence with ``b``, in linear memory
    (divide and conquer over the bit-parallel lengths)."""
    found: list[int] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, j, k, m = work.pop()
        while i < j and k < m and a[i] == b[k]:
            found.append(i)
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            found.append(j - 1)
            j, m = j - 1, m - 1
        if i == j or k == m:
            continue
        if j - i == 1:
            if a[i] in b[k:m]:
                found.append(i)
            continue
        mid = (i + j) // 2
        left = _lengths(a[i:mid], b[k:m])
        right = _lengths(a[mid:j][::-1], b[k:m][::-1])
        cut = max(range(m - k + 1), key=lambda t: left[t] + right[m - k - t])
        work += [(i, mid, k, k + cut), (mid, j, k + cut, m)]
    return sorted(found)


def main_text(page: Page, neighbour: Page | None) -> str:
    lines = page.lines
    gone = {i for i, linked in enumerate(page.linked) if linked}
    if neighbour is not None and True in page.doubt:
        both = set(lines) & set(neighbour.lines)
        if both:
            mine = [i for i, x in enumerate(lines) if x in both]
            shared = common([lines[i] for i in mine], [x for x in neighbour.lines if x in both])
            gone |= {mine[i] for i in shared if page.doubt[mine[i]]}
    if gone and len(gone) < len(lines):
        lines = [x for i, x in enumerate(lines) if i not in gone]
    return "\n\n".join(lines)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


_OUT = "page_id long, url string, text string, n_chars long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (_bucket, _ahead, _key): each is written when the next one is seen."""
    before = pending = None  # (host, page_id, url, Page)
    bucket, done = None, False

    def close(after):
        near = next((x[3] for x in (after, before) if x is not None and x[0] == pending[0]), None)
        text = main_text(pending[3], near)
        return pending[1], pending[2], text, len(text)

    for batch in batches:
        rows = []
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("_bucket", "_ahead", "_host", "page_id", "url", "html")]
        for i in range(batch.num_rows):
            at, ahead, name, page_id, url, text = (c[i].as_py() for c in columns)
            if at != bucket:
                if pending is not None:
                    rows.append(close(None))
                before = pending = None
                bucket, done = at, False
            if done:
                continue
            row = (name, page_id, url, Page(text or ""))
            if pending is not None:
                rows.append(close(row))
            before, pending, done = pending, None if ahead else row, ahead
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int64()))],
                names=["page_id", "url", "text", "n_chars"],
            )
    if pending is not None:
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("page_id", "url", "text", "n_chars"), close(None)))],
            schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]),
        )


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host(F.col("url")).alias("_host"))
    rank = F.lpad(F.hex(F.coalesce("page_id", F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    key = F.concat_ws("\x01", "_host", path(F.col("url")), rank)
    last = slim.select("_host", key.alias("_key")).groupBy("_host").agg(F.max("_key").alias("_key")).select("_key")
    ordered = with_successors(slim, key, ["html"], wrap=False, size=F.octet_length("html"), barred=last)
    return ordered.select("_bucket", "_ahead", "_host", "page_id", "url", "html").mapInArrow(_extract, _OUT)
