"""Main text of web pages by the distribution of text over lines.

Markup is stripped and every block element starts a line. A line's weight is its characters without those of links; a line that ends as a sentence does weighs PROSE more. Menus,
headers, footers, sidebars, notices and forms, known by their elements or by their classes and ids as whole tokens, only weigh a part, DISCOUNT, of that; adverts, reader comments and
cookie notices weigh nothing. Over a sliding window of WINDOW lines the weights are summed: a stretch begins where the sum rises from nothing and ends where it dives to nothing and
stays there, and it is text if the sum surges in between. The page itself says how high that is: the lines of the page's body have to reach SURGE, or the page's peak if that is less; lines that
are discounted have to surge above the body's peak, so that they are text only where they hold most of the page's. Both are distributions of their own: a menu between two
paragraphs doesn't part them. Links within an article or main element count as text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines in a window, the window sum (characters) that makes a surge, what a sentence's end counts, and the share that lines of asides weigh.
WINDOW, SURGE, PROSE, DISCOUNT = 3, 25, 15, 1 / 8

# Elements of HTML by what they mean here.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed frame hr img input keygen link meta param source track wbr".split())
#: Dropped with what they hold; those of the first line hold plain text, so that without an end tag they hold the rest of the page; others without one hold nothing.
RAW, CLOSED = "script|style|textarea|title|iframe", "noscript|template|select|object|canvas|desc|metadata|annotation-xml|annotation"
ASIDE = frozenset("nav header footer aside menu dialog head".split())
FORMS = frozenset(("form", "fieldset"))
MAIN = frozenset(("article", "main"))
_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer copyright sidebar aside widget widgets related recommended ad ads adv advert advertisement banner sponsored promo promotion "
    "cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup login share sharing social comment comments commentlist disqus replies reply respond pagination pager tags toolbar search".split()
)
#: Words that may stand beside a name in a token, as in site-header; any other, as in has-sidebar or entry-header, makes it no aside.
_BESIDE = frozenset("site global main primary secondary top bottom left right box bar list links section area wrap wrapper container block inner form buttons icons item items posts".split())
#: Words that make a token name an advert, a reader's comment or a cookie notice, whatever stands beside them but a negation.
_CONDEMNED = frozenset("comment comments commentlist disqus replies reply respond ad ads adv advert adverts advertisement advertising sponsored cookie cookies consent gdpr".split())
_NEGATED = frozenset("no non not has with without free hide".split())
_DROP = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({RAW})(?=[\s/>])[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))|<({CLOSED})(?=[\s/>])[^>]*?(?:/>|>.*?</\2\s*>)", re.I | re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?/][^>]*>")
_NAMED = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ROLES = re.compile(r"(?:^|\s)(?:navigation|banner|contentinfo|complementary|search|alert|dialog)(?:$|\s)", re.I)


def names_aside(named: str, main: bool) -> bool:
    """Whether a token of classes and ids means an aside by all its words. An article's header is its own heading."""
    for token in named.lower().split():
        words = [x for x in re.split(r"[-_\d]+", token) if x]
        if not (_NAMES.isdisjoint(words) or (main and "header" in words)) and all(x in _NAMES or x in _BESIDE for x in words):
            return True
    return False


def names_condemned(named: str) -> bool:
    """Whether a token of classes and ids has a word for adverts, comments or cookie notices, and no negation."""
    tokens = (set(re.split(r"[-_\d]+", x)) for x in named.lower().split())
    return any(not _CONDEMNED.isdisjoint(words) and _NEGATED.isdisjoint(words) for words in tokens)


def lines_of(page: str) -> list[tuple[str, bool, bool, bool, float]]:
    """Text, whether it's condemned, whether it stands in an aside, whether in the main element, and share of link text of each line that isn't blank."""
    page = _DROP.sub("", page)
    out: list[tuple[str, bool, bool, bool, bool, int, float]] = []
    # of each open block: whether it's condemned, whether an aside outside of an article, inside of one, whether in the main element, and the number of its form
    stack: list[tuple[str, bool, bool, bool, bool, int]] = []
    text: list[str] = []
    linked = at = forms = 0
    in_link = False

    def end_line() -> None:
        nonlocal linked
        line = " ".join(entities.unescape("".join(text)).split())
        if line:
            out.append((line, *(stack[-1][1:] if stack else (False, False, False, False, 0)), min(1.0, linked / len(line))))
        text.clear()
        linked = 0

    for m in _TAG.finditer(page):
        piece = page[at : m.start()]
        at = m.end()
        text.append(piece)
        linked += len(piece.strip()) if in_link else 0
        name = (m[2] or "").lower()
        if name in ("a", "button"):
            in_link = not m[1]
        elif name == "br":
            text.append(" ")
        if name in BLOCKS:
            end_line()
        if not name or name in VOID or name not in BLOCKS:
            continue
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            in_link = False
        else:
            if name in ("p", "li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == name:
                stack.pop()  # their end tags may be left out
            gone, around, aside, main, form = stack[-1][1:] if stack else (False, False, False, False, 0)
            named = " ".join(a or b or c for a, b, c in _NAMED.findall(m[3] or ""))
            if name in MAIN and not main:
                # the page's main element lies in no aside; a form around an article holds more than controls
                main, around, gone, form = True, around and name != "main", gone and name != "main", 0
            gone = gone or bool(named and name not in ("body", "html", "main") and names_condemned(named))
            inner = name in ("header", "footer") and main  # an article's own heading
            if (name in ASIDE and not inner) or bool(named and name not in ("body", "html", "article", "main") and (names_aside(named, main) or _ROLES.search(named))):
                around, aside = around or not main, aside or main
            if name in FORMS and not form:
                forms += 1
                form = forms
            stack.append((name, gone, around, aside, main, form))
    text.append(page[at:])
    end_line()
    return _weighed(out)


def _weighed(lines: list[tuple[str, bool, bool, bool, bool, int, float]]) -> list[tuple[str, bool, bool, bool, float]]:
    """Settles which forms and which asides around an article count as asides."""
    held: dict[int, int] = {}
    swallowed = 0
    for line, gone, around, aside, main, form, _ in lines:
        if not aside and not gone:
            if around:
                swallowed += len(line) * main
            else:
                held[form] = held.get(form, 0) + len(line)
    most = sum(held.values()) / 2
    wide = {0, *(f for f, n in held.items() if n > most)}
    freed = swallowed > sum(n for f, n in held.items() if f in wide)
    return [(line, gone, aside or (around and not (freed and main)) or form not in wide, main, share) for line, gone, around, aside, main, form, share in lines]


def window_sums(weight: list[float]) -> list[float]:
    n, half, upto = len(weight), WINDOW // 2, [0.0]
    for w in weight:
        upto.append(upto[-1] + w)
    return [upto[min(n, i + half + 1)] - upto[max(0, i - half)] for i in range(n)]


def between_surge_and_dive(weight: list[float], surge: float) -> list[bool]:
    """Of each line, whether it has weight and stands between a surge point and a dive point of the window sums."""
    n, sums = len(weight), window_sums(weight)
    kept, i = [False] * n, 0
    while i < n:
        j, high = i, 0.0
        while j < n and sums[j]:  # from where the sum rises to where it dives
            high = max(high, sums[j])
            j += 1
        if j > i and high >= surge:
            kept[i:j] = [w > 0 for w in weight[i:j]]
        i = max(j, i + 1)
    return kept


def ends_sentence(text: str) -> bool:
    """Whether a line ends in a sentence's punctuation, quotes and brackets aside, after something else."""
    end = text.rstrip("\"')]\u201d\u00bb")
    return len(end) > 1 and end[-1] in ".!?:;\u2026\u3002"


def weight_of(text: str, gone: bool, aside: bool, main: bool, share: float) -> float:
    """What a line weighs, in eighths so that sums are exact: nothing if it's condemned or, outside an article, mostly links."""
    if gone or (share > 0.5 and not main):
        return 0.0
    own = len(text) - (0 if main else round(share * len(text))) + PROSE * ends_sentence(text)
    return own * DISCOUNT if aside else float(own)


def main_text(page: str | None) -> str:
    """The main text: its blocks in page order, joined by two line feeds; empty if there is none."""
    lines = lines_of(page or "")
    weight = [weight_of(*line) for line in lines]
    body, asides = ([k for k, line in enumerate(lines) if line[2] is kind] for kind in (False, True))
    peak = max(window_sums([weight[k] for k in body]), default=0.0)
    chosen = []
    for own, surge in ((body, min(float(SURGE), peak)), (asides, max(SURGE * DISCOUNT, peak))):
        chosen += [k for k, keep in zip(own, between_surge_and_dive([weight[k] for k in own], surge), strict=True) if keep]
    return "\n\n".join(lines[k][0] for k in sorted(chosen))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every row; null, empty or text-free html gives an empty text.

    The whole html counts, whatever its length. One row for each input row, repeated rows included; other columns aren't read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(pages[id_col], pages[url_col].cast("string"), pages[html_col]).mapInArrow(run, "page_id long, url string, text string")
