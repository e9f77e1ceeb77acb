"""Halls out of web pages: a small HTML helper, then columns."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import clamp, collapse, listed

c = F.col
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = frozenset(("script", "style", "noscript", "template"))
#: An element left open ends where one of these starts, within the nearest of the containers.
IMPLIED_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "p": ({"p"}, {"div", "section", "article", "main", "li", "td", "th", "body", "aside", "nav", "header", "footer"})}
HEADINGS = frozenset(("h1", "h2", "h3", "h4"))
LONGEST_TEXT = 12_000
CANDIDATE = "struct<name:string,role:string,structural_role:string,href:string,surrounding:string,repeated:boolean,position:int,selector:string,category:string,parent_hint:string,image:string,context:boolean,procedural:boolean>"
#: What the rules need of a page, with its Arrow type; and the same as Spark's.
_LINK = pa.struct([(k, pa.string()) for k in ("href", "text", "role", "absolute")])
_FOUND = pa.struct([(k, {"boolean": pa.bool_(), "int": pa.int32()}.get(kind, pa.string())) for k, kind in (f.split(":") for f in CANDIDATE[7:-1].split(","))])
PARTS = {k: (pa.string(), "string") for k in ("title", "h1", "og_title", "breadcrumbs", "headings", "main_text")} | {"n_scripts": (pa.int32(), "int"), "image": (pa.string(), "string"), "links": (pa.list_(_LINK), "array<struct<href:string,text:string,role:string,absolute:string>>"), "candidates": (pa.list_(_FOUND), f"array<{CANDIDATE}>")}
#: Pages are handed on whenever so many characters were read or found, so a task never holds the texts of many pages.
HANDED_ON = 1 << 20


class _Element:
    """An element with the span of its descendants and of its text parts; chrome and section come down from its ancestors."""

    __slots__ = ("tag", "given", "classes", "parent", "at", "last", "first_text", "last_text", "chrome", "section", "heading")

    def __init__(self, tag: str, given: dict, parent: _Element | None, at: int, text: int):
        self.tag, self.given, self.parent, self.at, self.last, self.first_text, self.last_text = tag, given, parent, at, at, text, None
        self.classes = frozenset(given.get("class", "").lower().split())
        self.chrome = (parent.chrome if parent else frozenset()) | self._chrome()
        self.heading: _Element | None = None  # of a section: its first heading
        self.section = self if tag == "section" or "section" in self.classes else parent.section if parent else None

    def _chrome(self) -> frozenset:
        role, own, name = self.given.get("role", ""), self.classes, self.given.get("id", "")
        found = {
            "nav": self.tag == "nav" or role == "navigation" or own & {"nav", "navbar", "menu", "mega-menu", "breadcrumb", "breadcrumbs"},
            "header": self.tag == "header",
            "footer": self.tag == "footer",
            "aside": self.tag == "aside" or own & {"sidebar", "utility-nav", "cookie"} or name == "cookie",
            "main": self.tag == "main" or role == "main" or name in ("main", "content") or "main-content" in own,
        }
        return frozenset(k for k, yes in found.items() if yes)

    def role(self) -> str:
        return next((k for k in ("nav", "header", "footer", "aside", "main") if k in self.chrome), "unknown")

    def in_body_row(self) -> bool:
        up = self.parent
        while up and up.tag not in ("table", "thead", "tbody", "tfoot"):
            up = up.parent
        return bool(up) and up.tag in ("table", "tbody")  # rows right in a table are its body


class _Page(HTMLParser):
    """One pass over a page: its elements in order, and its texts; then all texts as one, with blanks squeezed, and where each begins in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[_Element] = []
        self.stack: list[_Element] = []
        self.texts: list[str] = []
        self.title, self.scripts, self.skipping = [], 0, 0
        self.whole, self.starts = "", []
        self.spoken: dict[str, tuple[list[int], list[int]]] = {}

    def _end(self, depth: int) -> None:
        for gone in self.stack[depth:]:
            gone.last, gone.last_text = len(self.elements) - 1, len(self.texts)
            self.skipping -= gone.tag in SKIPPED
        del self.stack[depth:]

    def handle_starttag(self, tag, attrs):
        ends, within = IMPLIED_ENDS.get(tag, ((), ()))
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag in ends:
                self._end(k)
                break
            if self.stack[k].tag in within or not ends:
                break
        element = _Element(tag, {k: v or "" for k, v in attrs}, self.stack[-1] if self.stack else None, len(self.elements), len(self.texts))
        self.elements.append(element)
        self.scripts += tag == "script"
        if tag in ("h1", "h2", "h3"):
            up = element.section
            while up and up.heading is None:
                up.heading = element
                up = up.parent.section if up.parent else None
        if tag in VOID:
            element.last_text = len(self.texts)
        else:
            self.stack.append(element)
            self.skipping += tag in SKIPPED

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._end(len(self.stack) - 1)

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                self._end(k)
                break

    def handle_data(self, data):
        if not self.skipping:
            if self.stack and self.stack[-1].tag == "title":
                self.title.append(data)
            else:
                self.texts.append(data)

    def close(self):
        super().close()
        self._end(0)
        pieces, size, blank = [], 0, True
        for text in self.texts:
            words = " ".join(text.split())
            piece = (" " if not blank and text[:1].isspace() else "") + words + (" " if words and text[-1].isspace() else "")
            blank = text[-1].isspace() if text else blank
            pieces.append(piece)
            self.starts.append(size)
            size += len(piece)
        self.starts.append(size)
        self.whole = "".join(pieces)

    def span(self, element: _Element) -> tuple[int, int]:
        """Where an element's text begins and ends, without the blanks around it."""
        a, b = self.starts[element.first_text], self.starts[element.last_text]
        a += a < b and self.whole[a] == " "
        return a, b - (a < b and self.whole[b - 1] == " ")

    def text(self, element: _Element, n: int | None = LONGEST_TEXT) -> str:
        a, b = self.span(element)
        return self.whole[a : b if n is None else min(b, a + n)]

    def finds(self, element: _Element, pattern: re.Pattern) -> bool:
        """Whether the whole text of an element holds a pattern that looks at nothing around it."""
        return bool(pattern.search(self.whole, *self.span(element)))

    def says(self, element: _Element, key: str) -> bool | None:
        """Whether the whole text of an element holds one of SPEAKS; None where its first LONGEST_TEXT characters are all. The page is searched once; only at an element's ends may its words differ from the page's."""
        a, b = self.span(element)
        if b - a <= LONGEST_TEXT:
            return None
        pattern = SPEAKS[key]
        if key not in self.spoken:
            found = [m.span(1) for m in re.finditer(f"(?=({pattern.pattern}))", self.whole, pattern.flags)]
            ends = [e for _, e in found]
            for k in range(len(ends) - 2, -1, -1):
                ends[k] = min(ends[k], ends[k + 1])
            self.spoken[key] = [k for k, _ in found], ends
        starts, ends = self.spoken[key]
        k = bisect_left(starts, a)
        return k < len(ends) and ends[k] <= b or bool(pattern.match(self.whole[a : min(b, a + LONGEST_PHRASE)]) or pattern.search(self.whole, max(a, b - LONGEST_PHRASE), b))

    def within(self, element: _Element, wanted: Callable[[_Element], bool]) -> Iterator[_Element]:
        return (e for e in self.elements[element.at + 1 : element.last + 1] if wanted(e))


def _absolute(base: str, href: str | None) -> str | None:
    try:
        return urljoin(base or "", href.strip()) if href is not None else None
    except ValueError:  # no URL at all
        return None


def _slug_title(url: str) -> str:
    """A name from the last part of a URL's path."""
    try:
        last = [p for p in unquote(urlsplit(url).path).split("/") if p][-1]
    except (ValueError, IndexError):
        return ""
    words = re.sub("[-_]+", " ", last).split()
    return " ".join(w[:1].upper() + w[1:] for w in words)


# Selectors of cards, in the order in which they count, and words of parents, links and options.
CARDS: tuple[tuple[str, Callable[[_Element], bool]], ...] = (
    ("article", lambda e: e.tag == "article"),
    (".card", lambda e: "card" in e.classes),
    (".views-row", lambda e: "views-row" in e.classes),
    (".teaser", lambda e: "teaser" in e.classes),
    ("[class*='housing-card']", lambda e: "housing-card" in e.given.get("class", "")),
    ("[class*='residence-card']", lambda e: "residence-card" in e.given.get("class", "")),
    (".accordion-item", lambda e: "accordion-item" in e.classes),
    ("table tbody tr", lambda e: e.tag == "tr" and e.in_body_row()),
)
PARENT_WORDS = re.compile("village|college|complex|community|unit", re.I)
LINK_WORDS = re.compile("housing|residenc|living|unit|apartment|hall|dorm|village|commons", re.I)
OPTION_PROMPT = re.compile("select|choose|please", re.I)
NO_PICTURE = re.compile("logo|sprite|icon|1x1|pixel", re.I)
CHROME = ("nav", "header", "footer")


def _harvest(page: _Page, roots: list[_Element], base: str, has_main: bool) -> Iterator[dict]:
    """Candidates of a page's roots by structural role: cards and table rows, headings, links, select options."""

    def found(name, role, structural, surrounding, *, around=None, href=None, repeated=False, selector="", category=None, parent=None, image=None):
        says = {k: page.says(around, k) if around else None for k in SPEAKS}
        return {"name": name, "role": role, "structural_role": structural, "href": href, "surrounding": surrounding, "repeated": repeated, "selector": selector, "category": category, "parent_hint": parent, "image": image} | says

    def all_within(wanted):
        return [e for root in roots for e in page.within(root, wanted)]

    in_main = lambda e: "main" if has_main and e.role() == "unknown" else e.role()
    for selector, is_card in CARDS:
        cards = all_within(is_card)
        for card in cards:
            if card.role() in CHROME:
                continue
            named = next(page.within(card, lambda e: e.tag in HEADINGS or e.tag == "a" or e.classes & {"title", "card-title"}), None)
            title = page.text(named) if named else ""
            if not title:
                cell = next(page.within(card, lambda e: e.tag == "td"), None)
                title = page.text(cell) if cell else ""
            if not title:
                continue
            link = next(page.within(card, lambda e: e.tag == "a" and "href" in e.given), None)
            picture = next(page.within(card, lambda e: e.tag == "img"), None)
            heading = page.text(card.section.heading) if card.section and card.section.heading else ""
            parent = heading if heading and page.finds(card.section.heading, PARENT_WORDS) and heading != title else None
            yield found(title, card.role(), "table_cell" if "tr" in selector else "card_title", page.text(card), around=card, href=_absolute(base, link.given["href"]) if link else None, repeated=len(cards) >= 3, selector=selector, category=heading or None, parent=parent, image=_absolute(base, picture.given.get("src")) if picture and picture.given.get("src") else None)
    for heading in all_within(lambda e: e.tag in HEADINGS):
        if heading.role() not in CHROME:
            up = heading.parent or heading
            beside = sum(1 for _ in page.within(up, lambda e: e.tag in ("article", "li", "tr") or "card" in e.classes))
            yield found(page.text(heading), in_main(heading), "heading", page.text(up), around=up, repeated=beside >= 3, selector="heading")
    for link in all_within(lambda e: e.tag == "a" and e.given.get("href")):
        href, text = _absolute(base, link.given["href"]), page.text(link)
        if link.role() in CHROME or href is None:
            continue
        name = text if len(text) >= 2 else _slug_title(href)
        if name and (LINK_WORDS.search(f"{href} {name}") or page.finds(link, LINK_WORDS)):
            yield found(name, in_main(link), "link", page.text(link.parent, 400) if link.parent else text, href=href, repeated=True, selector="a[href]")
    for select in all_within(lambda e: e.tag == "select"):
        for option in page.within(select, lambda e: e.tag == "option"):
            name = page.text(option)
            if name and not page.finds(option, OPTION_PROMPT):
                yield found(name, "main", "select_option", "housing select option room assignment", repeated=True, selector="select option")


def parse_page(html: str, url: str = "", parts: Iterable[str] = tuple(PARTS)) -> dict:
    """What the rules need of a page, or some ``parts`` of that. Broken markup never fails; what can't be read is left out. Names and texts around candidates are kept up to LONGEST_TEXT characters; what whole texts beyond that say stands in context and procedural."""
    page = _Page()
    page.feed(html or "")
    page.close()
    each = lambda wanted: [e for e in page.elements if wanted(e)]
    texts = lambda found, joint=" ": joint.join(t for t in map(page.text, found) if t)
    mains = [e for e in each(lambda e: e.tag == "main") if not (e.parent and "main" in {u.tag for u in _ancestors(e)})]
    roots = mains or each(lambda e: e.tag == "body")[:1]
    if not roots:  # a fragment: what stands outside a head is its body
        whole = _Element("body", {}, None, -1, 0)
        whole.last, whole.last_text = len(page.elements) - 1, len(page.texts)
        roots = [whole]

    def headings():
        found = [e for root in mains for e in page.within(root, lambda e: e.tag in ("h1", "h2", "h3"))]
        return (texts(found) or texts(each(lambda e: e.tag in ("h1", "h2"))))[:1500]

    def breadcrumbs():
        found, last = [], -1
        for e in page.elements:
            if e.at > last and (e.classes & {"breadcrumb", "breadcrumbs"} or (e.tag == "nav" and "breadcrumb" in e.given.get("aria-label", "").lower())):
                found.append(page.text(e, None))
                last = e.last  # what is within them is said
        return " ".join(filter(None, found))

    def image():
        picture = next((e for e in page.elements if e.tag == "img" and {"main", "article"} & {u.tag for u in _ancestors(e)}), None)
        found = _absolute(url, picture.given.get("src")) if picture and picture.given.get("src") else None
        return found if found and not NO_PICTURE.search(found) else None

    reads = {
        "title": lambda: " ".join("".join(page.title).split()),
        "h1": lambda: next((page.text(e, None) for e in page.elements if e.tag == "h1"), ""),
        "og_title": lambda: next((e.given.get("content", "") for e in page.elements if e.tag == "meta" and e.given.get("property") == "og:title"), ""),
        "breadcrumbs": breadcrumbs,
        "headings": headings,
        "main_text": lambda: " ".join(filter(None, map(page.text, roots)))[:LONGEST_TEXT],
        "n_scripts": lambda: page.scripts,
        "image": image,
        "links": lambda: [{"href": e.given["href"], "text": page.text(e), "role": e.role(), "absolute": _absolute(url, e.given["href"])} for e in each(lambda e: e.tag == "a" and e.given.get("href"))],
        "candidates": lambda: [{**k, "position": at} for at, k in enumerate(k for k in _harvest(page, roots, url, bool(mains)) if k["name"])],
    }
    return {k: reads[k]() for k in parts}


def _ancestors(element: _Element) -> Iterator[_Element]:
    while element := element.parent:
        yield element


def _parse(parts: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task for mapInArrow: pages go on in small batches, as what is found on a page may be many times its html."""
    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), *((k, PARTS[k][0]) for k in parts)])

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for at in range(batch.num_rows):
                page_id, url, html = (column[at].as_py() for column in batch.columns)
                row = {"page_id": page_id, "url": url} | parse_page(html, url, parts)
                rows.append(row)
                size += len(html or "") + sum(len(v or "") for k in row.get("links", ()) for v in k.values()) + sum(len(k["surrounding"]) + len(k["name"]) for k in row.get("candidates", ()))
                if size >= HANDED_ON:
                    yield pa.RecordBatch.from_pylist(rows, kind)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, kind)

    return run


def page_signals(pages: DataFrame, *parts: str) -> DataFrame:
    """Signals, links and candidates of each page (page_id, url, html), or some ``parts`` of them: parsed once, the html goes no further."""
    parts = parts or tuple(PARTS)
    return pages.select("page_id", "url", "html").mapInArrow(_parse(parts), ", ".join(["page_id long", "url string", *(f"{k} {PARTS[k][1]}" for k in parts)]))


# Patterns of page roles and candidates, as in the source data.
POSITIVE_URL = r"(?i)/(housing|residence|residential|res-?life|living|dorm|halls?|units?|apartments?|villages?|communities|residences)\b"
NEGATIVE_EXACT = r"(?i)^(residence halls?|residence life|residential life|housing|housing options|explore housing|apply( now)?|learn more|see this residence|view all|dining|meal plans?|move[- ]?in|move[- ]?out|living on campus|our residences|campus housing|student housing|undergraduate housing|graduate housing|family housing|theme programs?|theme houses|greek houses|cooperative houses|self-operated houses|row houses|specialized communities|living sustainably|home|menu|skip to|search|contact( us)?|about|staff|directory of staff|faq|faqs|rates?|room types?|floor plans?|virtual tour|map|parking|laundry facilities|how to apply|eligibility|important dates|news|events|policies|tours|health|safety|my room|compare housing options|housing guarantee|dates? (&|and) deadlines|bridge program|edge programs|housing task force|spring housing|off-campus housing|housing by user type|cancellations? (&|and) appeals|terms?,? conditions,? (&|and) agreements|transit and transportation|front desks? (&|and) housing facilities|mail service|cleaning (&|and) maintenance|technology (&|and)? ?services|winter break closure|living with a roommate|on-campus housing benefits|temporary quad room|optional apartment cleaning service|bed bugs.*|missing student policy.*|graduate housing assignment.*|family housing.*|how to .*|newly admitted.*|visiting scholar.*|summer .*housing.*|housing relocation.*|housing application|amenities|residence|high-rise|low-rise|apartment features|apartment layouts|apartments and suites|apartments & suites|single graduate housing|single undergraduate housing|on-campus housing options.*|on-campus housing amenities|stanford (on-campus )?housing amenities|residences for couples without children|residences for single graduates|residences for students with children)$"
NEGATIVE_NAME = r"(?i)\b(dining hall|town hall|lecture hall|great hall|city hall|music hall|concert hall|residence life staff|housing staff|housing application|housing portal|meal plan|dining commons|food court|career center|student union|recreation center|fitness center|library|registrar|bursar|admissions office|projected rates|contract rates|cost of attendance|additional fees|equipment fee|furniture rental|housing amenities|application process|front desk)\b"
NEGATIVE_PREFIX = r"(?i)^(about the|be excited|be a big|furnished single-occupancy|unfurnished single-occupancy|academic year \d{4})"
NEGATIVE_TITLE = r"(?i)^(how to|newly admitted|graduate student|family student|undergraduate|visiting|optional|temporary|summer |spring |winter |medical|dates)"
NEGATIVE_HREF = r"(?i)\b(faq|policy|policies|terms|condition|apply|login|portal|move-in|move-out|contact|staff|news|event|deadline|cancellation|appeal|renewal|accommodation|checklist|parking|dining|meal|health|safety|laundry-facilit|technology|cleaning|roommate|sustainab|guarantee|task-force|bridge-program|edge-program)\b"
SOFT_SURROUND = r"(?i)\b(how to apply|assignment process|move-in|move-out|terms and conditions|terms & conditions|deadlines|checklist|furniture leasing|parking & directions)\b"
POSITIVE_SURROUND = r"(?i)\b(residence hall|residential hall|housing option|living community|room type|double|single|suite|bathroom|laundry|floor plan|residents?|assignment|air conditioning|occupancy|bedrooms?|apartment|theme house|living.?learning|first[- ]year|upperclass|freshman housing|on[- ]campus housing|mini-suites?)\b"
STRONG_NAME = r"(?i)\b(hall|house|houses|quad|tower|towers|villa|villas|residence|dorm|dormitory|commons|apartments?|suites?|village|manor|lodge|court|courts|inn|unit\s*\d+|complex|mini-suites?)\b"
KINDS = ((r"(?i)\bunit\s*\d", "UNIT"), (r"(?i)\bvillage\b", "VILLAGE"), (r"(?i)\bcommons\b", "COMPLEX"), (r"(?i)\bcollege\b", "RESIDENTIAL_COLLEGE"), (r"(?i)\bapartments?\b", "APARTMENT_COMMUNITY"), (r"(?i)\bhouses?\b", "HOUSE"), (r"(?i)\bcomplex\b", "COMPLEX"), (r"(?i)\btowers?\b", "BUILDING"), (r"(?i)\bhall\b", "BUILDING"), (r"(?i)\bsuites?\b", "SUITE_COMMUNITY"))

#: What texts around candidates may say. Names of the two columns in which a page's parser says it of long texts; no phrase is longer than LONGEST_PHRASE.
SPEAKS = {k: re.compile(p.removeprefix("(?i)"), re.I | re.A) for k, p in (("context", POSITIVE_SURROUND), ("procedural", SOFT_SURROUND))}
LONGEST_PHRASE = 64


#: What the roles of a page are read from, besides its URL.
SAYS = ("title", "h1", "og_title", "breadcrumbs", "headings")


def page_roles(signals: DataFrame) -> DataFrame:
    """Add roles: what title, headings and URL say a page is; procedural pages don't become directories by their menus."""
    url, head = F.lower("url"), F.lower(F.concat_ws(" ", *SAYS))
    says = lambda p, x=head: F.coalesce(x.rlike(p), F.lit(False))
    path_housing, head_housing = says(POSITIVE_URL, url), says(r"\b(housing|residence halls?|residential life|res(?:idence)? life|living on campus|housing options)\b")
    application, staff, faq = says("how to apply|housing application|apply for housing|assignment process"), says(r"\bstaff\b|directory of staff|contact housing"), says(r"\bfaqs?\b|frequently asked")
    directory_head = says(r"housing options|residence halls|our residences|find (?:your )?home|explore housing|residential communities|undergraduate housing") | says("residence-halls|housing-options|explore-housing|our-residences", url)
    detail_path = says(r"/(unit|hall|house|apartment|village|commons|residence)[-_/][\w-]+/?$", url)
    stops = (application | staff | faq) & ~directory_head & ~detail_path
    housing = path_housing | head_housing
    directory, detail = ~stops & directory_head & housing, ~stops & detail_path & housing
    first = [F.when(application, "application"), F.when(staff, "staff"), F.when(faq, "faq"), F.when(says("/maps?/|campus map|housing map", F.concat_ws(" ", url, head)), "map"), F.when(says(r"\brates?\b|room (?:and|&) board|housing cost|price") | says(r"/rates?\b", url), "rates"), F.when(says("room types?|occupancy|double|single room"), "room_type"), F.when(says("eligib|freshman|upperclass|graduate housing"), "eligibility"), F.when(says("floor plan"), "floor_plan")]
    roles = listed(*first, F.when(directory, "housing_directory"), F.when(detail, "housing_detail"), F.when(~stops & housing & ~directory & ~detail, "housing_landing"))
    return signals.withColumn("roles", roles).withColumn("roles", F.when(F.size("roles") == 0, F.array(F.lit("irrelevant"))).otherwise(c("roles")))


def entity_kind(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(KINDS):
        out = F.when(name.rlike(pattern), kind).otherwise(out)
    return out


def classify_candidates(candidates: DataFrame) -> DataFrame:
    """Add accepted, score_confidence, reject_reason and kind to candidates (name, role, structural_role, href, surrounding, repeated, roles, url; context and procedural, where surrounding is not the whole text): hard rejections first, then points."""
    name = collapse(c("name"))
    href, around = F.coalesce("href", F.lit("")), F.coalesce("surrounding", F.lit(""))
    says = lambda k, p: F.coalesce(c(k), around.rlike(p)) if k in candidates.columns else around.rlike(p)
    strong, context, procedural = name.rlike(STRONG_NAME) | name.rlike(r"(?i)^unit\s*\d+[a-z]?$"), says("context", POSITIVE_SURROUND), says("procedural", SOFT_SURROUND)
    on_page = F.arrays_overlap("roles", F.array(*map(F.lit, ("housing_landing", "housing_directory", "housing_detail", "rates", "room_type"))))
    points = lambda condition, n: F.when(condition, n).otherwise(0.0)
    menu = c("role") == "nav"
    score = points(c("role").isin("nav", "header", "footer"), -0.45) + points(procedural, -0.15) + points(strong, 0.35) + points(context, 0.25)
    score = score + F.when(menu, -0.25).otherwise(points(c("repeated") & (strong | context), 0.2)) + points((c("structural_role") == "card_title") & (strong | context), 0.1)
    score = score + points((c("structural_role") == "link") & href.rlike(POSITIVE_URL) & strong, 0.15) + points(c("url").rlike(POSITIVE_URL) & strong, 0.1)
    score = score + points(~strong & c("repeated") & context & name.rlike(r"^[A-Z][A-Za-z0-9 .'&\-]{2,60}$") & ~menu, 0.35) + points(name.rlike(r"(?i)\b(school of|college of|department|center for|institute)\b") & ~context, -0.4)
    score = score + points((c("structural_role") == "heading") & ~c("repeated") & ~context, -0.2)
    reject = (
        F.when((F.length(name) < 2) | (F.length(name) > 90), "name_length_out_of_range")
        .when(name.rlike(NEGATIVE_EXACT), "negative_exact_nav_or_section_heading")
        .when(name.rlike(NEGATIVE_NAME) | name.rlike(NEGATIVE_PREFIX), "negative_facility_or_procedural_name")
        .when((href != "") & href.rlike(NEGATIVE_HREF), "negative_href_procedural")
        .when(name.rlike(NEGATIVE_TITLE), "negative_procedural_title")
        .when(~on_page, "not_on_housing_page")
    )
    out = candidates.withColumns({"name": name, "reject_reason": reject, "__score": score, "__evidence": strong | context})
    accepted = c("reject_reason").isNull() & (c("__score") >= 0.5) & c("__evidence")
    out = out.withColumn("accepted", accepted).withColumn("score_confidence", F.when(c("reject_reason").isNull(), clamp(F.when(c("accepted"), F.greatest("__score", F.lit(0.55))).otherwise(c("__score")), 0.0, 1.0)).otherwise(0.0))
    return out.withColumns({"reject_reason": F.when(~c("accepted") & c("reject_reason").isNull(), "insufficient_entity_evidence").otherwise(c("reject_reason")), "kind": entity_kind(c("name"))}).drop("__score", "__evidence")


def page_candidates(pages: DataFrame) -> DataFrame:
    """Candidates of pages, classified; one row each."""
    signals = page_roles(page_signals(pages, *SAYS, "candidates"))
    exploded = signals.select("page_id", "url", "roles", F.explode("candidates").alias("k")).select("page_id", "url", "roles", "k.*")
    return classify_candidates(exploded)


def page_metadata(signals: DataFrame, most: int = 60) -> DataFrame:
    """Title, roles and up to 60 distinct housing links per page."""
    wanted = F.filter("links", lambda a: a["href"].rlike("(?i)housing|residence|residential|res-?life|living|dorm|hall|apartment") & ~a["href"].rlike(r"(?i)facebook|twitter|instagram|youtube|linkedin|mailto:|tel:|maps\."))
    return page_roles(signals).select("page_id", "url", "title", "roles", F.slice(F.array_distinct(F.transform(wanted, lambda a: a["href"])), 1, most).alias("housing_links"))


def spa_signals(html: Column, main_text: Column) -> Column:
    """Whether a page is a shell that scripts fill."""
    shell = html.rlike(r"""(?i)__NEXT_DATA__|__NUXT__|ng-version|data-reactroot|id=["']__next["']|id=["']app["']\s*>\s*</div>""")
    bare = (F.length(main_text) < 200) & (F.regexp_count(html, F.lit("(?i)<script")) >= 8)
    return shell | bare | (main_text.rlike(r"(?i)loading\.\.\.|please wait|skeleton|hydrat") & (F.length(main_text) < 800))


def embedded_names(html: Column, most: int = 80) -> Column:
    names = F.regexp_extract_all(F.regexp_extract(html, r"(?s)__NEXT_DATA__[^>]*>(.*?)</script>", 1), F.lit(r'"name"\s*:\s*"([^"]{3,80})"'), F.lit(1))
    return F.slice(F.array_distinct(F.filter(names, lambda n: n.rlike(STRONG_NAME) & ~n.rlike(NEGATIVE_EXACT) & ~n.rlike(NEGATIVE_NAME))), 1, most)


def detail_links(signals: DataFrame) -> DataFrame:
    """The first floor-plan and virtual-tour link of each page, absolute, and its first picture in the main part or an article, if that is no logo."""
    first = lambda p: F.try_element_at(F.filter("links", lambda a: F.concat(a["href"], a["text"]).rlike(p) & a["absolute"].isNotNull()), F.lit(1))["absolute"]
    return signals.select("page_id", first(r"(?i)floor[- ]?plan").alias("floor_plan_url"), first(r"(?i)virtual\s*tour|matterport|youvisit").alias("virtual_tour_url"), "image")


def housing_flags(kind: Column) -> dict[str, Column]:
    """Whether a kind of entity can be assigned, stands as a building, and ranks by itself."""
    return {"assignable": ~kind.isin("COMPLEX", "VILLAGE", "OTHER"), "physical": kind.isin("BUILDING", "HOUSE", "RESIDENCE", "UNIT"), "granular": ~kind.isin("COMPLEX", "VILLAGE")}


def resolve_tri_state(amenities: Column, name: str) -> Column:
    return F.when(F.array_contains(amenities, f"no_{name}"), False).when(F.array_contains(amenities, name), True)


def pick_yearly_cost(costs: Column) -> Column:
    of = lambda period: F.try_element_at(F.filter(costs, lambda p: p["period"] == period), F.lit(1))["amount"]
    return F.coalesce(of("yearly"), of("unknown"))


def activate(candidates: DataFrame) -> DataFrame:
    """Add status: active from 0.55 on official pages or 0.7 elsewhere, else for review."""
    sure = (c("score_confidence") >= 0.55) & (c("official") | (c("score_confidence") >= 0.7))
    return candidates.withColumn("status", F.when(sure, "ACTIVE").otherwise("REVIEW"))


def merge_amenities(card: Column, detail: Column) -> Column:
    """Amenities of a card and a detail page; what the detail page contradicts goes."""
    denied = F.transform(F.filter(detail, lambda a: a.startswith("no_")), lambda a: F.substring(a, 4, 80))
    contradicted = F.transform(F.filter(detail, lambda a: ~a.startswith("no_")), lambda a: F.concat(F.lit("no_"), a))
    return F.array_union(F.array_except(F.array_except(card, denied), contradicted), detail)


def merge_detail_facts(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """Candidates of detail pages with the page's facts where the card knows none; facts: page_id and columns f_<name>."""
    joined = candidates.join(facts, "page_id", "left")
    names = [k[2:] for k in facts.columns if k.startswith("f_")]
    return joined.withColumns({k: F.coalesce(c(k), c(f"f_{k}")) if k in candidates.columns else c(f"f_{k}") for k in names}).drop(*[f"f_{k}" for k in names])


Adapter = tuple[str, Callable[[], Column], Callable[[DataFrame], DataFrame]]
_adapters: dict[str, Adapter] = {}


def register_adapter(name: str, matches: Callable[[], Column], extract: Callable[[DataFrame], DataFrame]) -> None:
    """Extract the pages that ``matches`` holds for with a function of one's own."""
    _adapters[name] = (name, matches, extract)


register_adapter("generic", lambda: F.lit(True), page_candidates)


def extract(pages: DataFrame) -> DataFrame:
    """Candidates of all pages, each by the adapters that match it."""
    out = None
    for name, matches, run in _adapters.values():
        part = run(pages.where(matches())).withColumn("adapter", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
