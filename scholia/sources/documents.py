"""Parsers of raw documents that need a little code: textbook modules, lesson and problem pages, exams, item JSON.

Each helper is a pure function of one record; a job runs it by mapInPandas, without a shuffle.
"""

from __future__ import annotations

import html
import json
import re
import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from string import Formatter
from typing import NamedTuple
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions import standards as S
from scholia.sources import columns as C


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _job(raw: DataFrame, parse: Callable[[dict], list[tuple]], columns: list[str], schema: str, inputs: list[str]) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [r for rec in pdf.to_dict("records") for r in parse(rec)]
            yield pd.DataFrame(rows, columns=columns)

    return raw.select(*inputs).mapInPandas(run, schema)


# ---- math and text of textbook markup ----

# Symbols and their commands.
SYMBOLS = {
    "−": "-", "–": "-", "×": r"\times ", "·": r"\cdot ", "÷": r"\div ", "≤": r"\le ", "≥": r"\ge ", "≠": r"\ne ", "≈": r"\approx ",
    "±": r"\pm ", "∞": r"\infty ", "→": r"\to ", "…": r"\ldots ", "∙": r"\cdot ", "π": r"\pi ", "°": r"^\circ ",
}
# Elements that end a line, and elements that are no text.
LINES = frozenset("para item title caption entry row".split())
NO_TEXT = frozenset("media image figure labeled-item".split())
#: Elements of presentation markup: what they become with so many operands (None: any other number). {0}, {1}, ... are the
#: operands, {b0} is one in braces unless it is one character, {all} are all in a row, {drawn} all but spaces, {listed} with
#: commas, {rows} the rows of a table, {own} the element's text, {symbol} its command, {open} and {close} its fences.
#: What stands in none of these gives its operands, or its text without any.
MARKUP = {
    "mi": {None: "{symbol}"}, "mn": {None: "{symbol}"}, "mo": {None: "{symbol}"}, "mtext": {None: r"\text{{{own}}}"}, "mspace": {None: r"\ "},
    "mfrac": {2: r"\frac{{{0}}}{{{1}}}"}, "msup": {2: "{b0}^{{{1}}}"}, "msub": {2: "{b0}_{{{1}}}"}, "msubsup": {3: "{b0}_{{{1}}}^{{{2}}}"}, "mroot": {2: r"\sqrt[{1}]{{{0}}}"},
    "msqrt": {None: r"\sqrt{{{all}}}"}, "munder": {None: "{drawn}"}, "mover": {None: "{drawn}"}, "munderover": {None: "{drawn}"}, "mfenced": {None: "{open}{listed}{close}"},
    "mtable": {None: r"\begin{{matrix}}{rows}\end{{matrix}}"}, "math": {None: "{all}"}, "mrow": {None: "{all}"}, "mstyle": {None: "{all}"}, "semantics": {None: "{all}"},
}


class _Fields(dict):
    """What a template of MARKUP may ask for, made when it is."""

    def __init__(self, e: ET.Element, operands: list[str]):
        super().__init__(all="".join(operands), own=(e.text or "").strip(), open=e.get("open", "("), close=e.get("close", ")"), listed=", ".join(operands))
        self.e, self.operands = e, operands

    def __missing__(self, name: str) -> str:
        kinds = [_local(k.tag) for k in self.e]
        if name[0] == "b":
            x = self.operands[int(name[1:])]
            return x if len(x) == 1 else f"{{{x}}}"
        if name == "symbol":
            return SYMBOLS.get(self["own"], self["own"])
        if name == "drawn":
            return "".join(x for k, x in zip(kinds, self.operands, strict=True) if k != "mspace")
        if name == "rows":
            return r" \\ ".join(" & ".join(latex(cell) for cell in row) for k, row in zip(kinds, self.e, strict=True) if k == "mtr")
        return self.operands[int(name)]


class _Template(Formatter):
    """Positions are names too, so that every field is looked up in one place."""

    def get_value(self, key: int | str, args: tuple, kwargs: dict) -> str:
        return args[0][str(key)]


_FILL = _Template()


def latex(e: ET.Element) -> str:
    """A math element in LaTeX, by MARKUP."""
    operands = [latex(k) for k in e]
    fields = _Fields(e, operands)
    ways = MARKUP.get(_local(e.tag), {})
    template = ways.get(len(operands), ways.get(None))
    if template is None:
        return fields["all"] if operands else fields["own"]
    return _FILL.vformat(template, (fields,), {}) if template.count("{own}") == 0 or fields["own"] else ""


def _events(e: ET.Element) -> list[str]:
    """The texts of an element in order, a line end after every block; space between elements alone is left out."""
    out: list[str] = []
    todo: list[ET.Element | str] = [e]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        tag = _local(x.tag)
        if tag == "math":
            out.append(f"${m}$" if (m := latex(x).strip()) else "")
        elif tag not in NO_TEXT:
            inside = [y for k in x for y in (k, k.tail)]
            todo += [y for y in reversed([x.text, *inside, "\n" if tag in LINES else ""]) if isinstance(y, ET.Element) or (y and (y == "\n" or y.strip()))]
    return out


def flat_text(e: ET.Element) -> str:
    """Text of an element: blocks end lines, media go, math is $...$, one blank line at most between lines."""
    lines = [" ".join(line.split()) for line in "".join(_events(e)).split("\n")]
    kept = [line for i, line in enumerate(lines) if line or not i or lines[i - 1]]
    return "\n".join(kept).strip()


class Roles(NamedTuple):
    """Class tokens of sections: the summary, the container whose sections are exercise sets, and exercise sets themselves."""

    summary: str
    container: str
    sets: tuple[str, ...] = ()


# The classes that the books of a discipline use.
PROFILES = {
    "math": Roles("key-concepts", "section-exercises"),
    "social-studies": Roles("summary", "", ("review-questions", "critical-thinking", "problems", "self-check-questions")),
    "social-studies-section": Roles("section-summary", "", ("review-questions", "critical-thinking", "check-understanding", "reflection-questions", "own-words", "section-quiz", "short-answer")),
    "science": Roles("summary", "", ("critical-thinking", "multiple-choice", "exercises", "problems", "self-check-questions", "review-questions", "review", "science-practice")),
    "science-section": Roles("section-summary", "", ("problems-exercises", "conceptual-questions", "ap-test-prep", "check-understanding")),
    "science-key-concepts": Roles("key-concepts", "", ("review-problems", "review-conceptual-questions", "review-additional-problems", "review-challenge", "check-understanding")),
}


def _named(e: ET.Element, name: str) -> list[ET.Element]:
    return [k for k in e if _local(k.tag) == name]


def _heading(e: ET.Element) -> str | None:
    """What stands first in an element's title; None without a title."""
    found = _named(e, "title")
    return (found[0].text or "").strip() if found else None


def _pieces(body: ET.Element, title: str, roles: Roles) -> Iterator[tuple[str, str, ET.Element]]:
    """(kind, title, element) of the pieces of a module, in page order; examples are taken out of their section."""
    examples = 0
    for section in _named(body, "section"):
        tokens, name = (section.get("class") or "").split(), _heading(section) or ""
        exercise = [t for t in tokens if t in roles.sets]
        if roles.summary in tokens:
            yield "summary", f"{title} — Key Concepts", section
        elif roles.container and roles.container in tokens:
            for group in _named(section, "section"):
                yield "set", f"{title} — {'Exercises' if (g := _heading(group)) is None else g}", group
        elif exercise:
            yield "set", f"{title} — {name or exercise[0].replace('-', ' ').title()}", section
        else:
            for example in _named(section, "example"):
                section.remove(example)
                examples += 1
                yield "ex", f"{title} — Example {examples}", example
            yield "expo", f"{title}: {name}" if name else title, section


# Content types of the kinds of pieces.
KINDS = {"expo": "exposition", "ex": "worked_example", "set": "exercise_set", "summary": "summary"}


def split_module(xml: str, module_id: str, prefix: str, profile: str = "math") -> list[tuple[str, str, str, str, str]]:
    """(chunk_id, content_type, title, content, classes) of the pieces of a textbook module, numbered by kind within the module
    (a module has one summary); empty ones count but are left out. `classes` are all class attributes in a piece, for tag
    codes. Broken markup and a module without content give no rows."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return []
    title = _heading(root)
    numbers: Counter[str] = Counter()
    out = []
    for body in _named(root, "content")[:1]:
        for kind, name, e in _pieces(body, module_id if title is None else title, PROFILES[profile]):
            numbers[kind] += 1
            if text := flat_text(e):
                number = "" if kind == "summary" else numbers[kind]
                out.append((f"{prefix}-{kind}{number}", KINDS[kind], name, text, " ".join(x.get("class") or "" for x in e.iter()).strip()))
    return out


def parse_modules(raw: DataFrame, source: str) -> DataFrame:
    """Chunks of raw modules (slug, module_id, profile, payload)."""
    parse = lambda r: [(r["slug"], r["module_id"], *c) for c in split_module(r["payload"] or "", r["module_id"], f"{source}-{r['slug']}-{r['module_id']}", r["profile"])]
    names = ["slug", "module_id", "chunk_id", "content_type", "title", "content", "classes"]
    return _job(raw, parse, names, ", ".join(f"{n} string" for n in names), ["slug", "module_id", "profile", "payload"])


# ---- pages ----


class Node:
    """An element of a page: tag, attributes, and its texts and elements in order."""

    def __init__(self, tag: str, attrs: dict[str, str | None], up: Node | None):
        self.tag, self.attrs, self.up = tag, attrs, up
        self.kids: list[Node | str] = []

    def has(self, name: str) -> bool:
        return name in (self.attrs.get("class") or "")

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            x = todo.pop()
            yield x
            todo += [k for k in reversed(x.kids) if isinstance(k, Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in ("script", "style"):
                todo += reversed(x.kids)
        return " ".join("".join(out).split())

    def after(self, tag: str) -> Node | None:
        """The next element of a tag beside it."""
        beside = self.up.kids if self.up else []
        at = next((i for i, k in enumerate(beside) if k is self), len(beside))
        return next((k for k in beside[at + 1 :] if isinstance(k, Node) and k.tag == tag), None)


class _Tree(HTMLParser):
    """Reads a page; an element left open ends with its parent."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at)
        self.at.kids.append(node)
        if tag not in self.VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        x = self.at
        while x.up and x.tag != tag:
            x = x.up
        if x.up:
            self.at = x.up

    def handle_data(self, data):
        self.at.kids.append(data)


def tree(page: str) -> Node:
    t = _Tree()
    t.feed(page)
    t.close()
    return t.root


# Classes of lesson pages.
CONTENT_CLASS, LABEL_CLASS, HEADING_CLASS = "im-c-content", "im-c-hero__underline", "hero__heading"


def lesson_text(page: Node, least: int = 40) -> str:
    """Blocks of the content class, nested ones too, from `least` characters, each once, by an empty line."""
    return "\n\n".join(dict.fromkeys(t for n in page.walk() if n.has(CONTENT_CLASS) and len(t := n.text()) >= least))


def labelled_standards(page: Node) -> dict[str, list[str]]:
    """Tags in the links of the list that follows each label; of a label that stands twice, the last."""
    labels = [n for n in page.walk() if n.tag == "p" and n.has(LABEL_CLASS)]
    lists = [(n.text(), n.after("ul")) for n in labels]
    return {label: tags for label, ul in lists if ul and (tags := [a.text() for a in ul.walk() if a.tag == "a"])}


def lesson(page: str) -> tuple[str, list[str], dict[str, list[str]]]:
    """Text, headings and labelled tags of a lesson page."""
    t = tree(page)
    return lesson_text(t), [n.text() for n in t.walk() if n.has(HEADING_CLASS)], labelled_standards(t)


def parse_lessons(raw: DataFrame, *, least_words: int = 30) -> DataFrame:
    """(key, title, content, standards, addressing) of lesson pages (key, base, payload) with at least `least_words` words.

    The title is the structured `base` and the page's first heading that can be one; `standards` maps every label to its
    normalised identifiers, `addressing` are those that become alignments."""
    pages = _job(raw, lambda r: [(r["key"], r["base"], *lesson(r["payload"] or ""))], ["key", "base", "content", "headings", "tags"], "key string, base string, content string, headings array<string>, tags map<string,array<string>>", ["key", "base", "payload"])
    ids = F.transform_values("tags", lambda _, v: F.filter(F.transform(v, S.id_from_lesson_tag), lambda x: x.isNotNull()))
    out = pages.where(C.words(F.col("content")) >= least_words).withColumn("standards", F.map_filter(ids, lambda _, v: F.size(v) > 0))
    return out.select("key", C.page_title(F.col("headings"), F.col("base")).alias("title"), "content", "standards", F.coalesce(F.try_element_at("standards", F.lit("Addressing")), F.array().cast("array<string>")).alias("addressing"))


# What ends the directions and the hint of a problem page; tags that are no author.
DIRECTIONS = r"Directions?:?\s*(.*?)(?:Hint|Answer|Source|Use this problem|Print)"
HINT = r"(?:Hint|Answer)\s*(.*?)(?:Source|Use this problem|Print|Embedded)"
NO_AUTHOR = ("Open Middle", "Illustrative Mathematics")
# The end of a problem page's title; how an article's class names its grade.
TITLE_END, GRADE_CLASS = " | Open Middle®", r"category-(grade-\d+|kindergarten|high-school[^\s]*)"


def problem(page: str) -> tuple[str, str, list[str], str | None, str] | None:
    """Directions, hint, tags (links marked as tags, then keywords), title and the article's classes of a problem page; None
    without an article."""
    t = tree(page)
    article = next((n for n in t.walk() if n.tag == "article"), None)
    if article is None:
        return None
    text = article.text()
    directions, hint = (m[1].strip() if (m := re.search(p, text, re.I)) else "" for p in (DIRECTIONS, HINT))
    tags = [n.text() for n in t.walk() if n.tag == "a" and n.attrs.get("rel") == "tag"]
    words = next((n.attrs.get("content") or "" for n in t.walk() if n.tag == "meta" and n.attrs.get("name") == "keywords"), "")
    title = next((n.attrs.get("content") or "" for n in t.walk() if n.tag == "meta" and n.attrs.get("property") == "og:title"), None)
    return directions, hint, list(dict.fromkeys(tags + [w.strip() for w in words.split(",") if w.strip()])), title, article.attrs.get("class") or ""


def parse_problems(raw: DataFrame, *, least: int = 10) -> DataFrame:
    """(key, url, title, content, standards, dok_level, author, grade, grade_band) of problem pages (key, url, payload, and
    grade_cat if the index page's category is known), one for each URL, with directions of at least `least` characters.

    The title is the page's own without the site's name, else the key; the grade is the first that the article's classes
    name, else that of the category."""
    raw = raw if "grade_cat" in raw.columns else raw.withColumn("grade_cat", F.lit(None).cast("string"))
    one = raw.groupBy("url").agg(F.min_by(F.struct("key", "payload", "grade_cat"), "key").alias("r")).select("url", "r.*")

    def parse(r: dict) -> list[tuple]:
        found = problem(r["payload"] or "")
        return [(r["key"], r["url"], r["grade_cat"], *found)] if found and len(found[0]) >= least else []

    names = ["key", "url", "grade_cat", "directions", "hint", "tags", "og_title", "classes"]
    got = _job(one, parse, names, ", ".join(f"{n} {'array<string>' if n == 'tags' else 'string'}" for n in names), ["key", "url", "payload", "grade_cat"])
    standard = lambda x: S.id_from_problem_tag(x)
    dok = lambda x: F.regexp_extract(x, r"(?i)DOK\s*(\d)", 1)
    rest = F.filter("tags", lambda x: standard(x).isNull())
    author = F.filter(rest, lambda x: (dok(x) == "") & ~x.rlike("[0-9]") & ~x.isin(*NO_AUTHOR))
    content = F.concat(F.lit("Directions: "), "directions", F.when(F.col("hint") != "", F.concat(F.lit("\n\nAnswer/Hint: "), "hint")).otherwise(""))
    title = F.coalesce(F.trim(F.replace(F.col("og_title"), F.lit(TITLE_END), F.lit(""))), "key")
    grade, band = C.grade_of_category(F.coalesce(F.nullif(F.regexp_extract("classes", GRADE_CLASS, 1), F.lit("")), "grade_cat", F.lit("")))
    return got.select(
        "key", "url", title.alias("title"), content.alias("content"), F.filter(F.transform("tags", standard), lambda x: x.isNotNull()).alias("standards"),
        F.try_element_at(F.filter(F.transform(rest, dok), lambda x: x != ""), F.lit(-1)).cast("int").alias("dok_level"), F.get(author, F.lit(0)).alias("author"), grade.alias("grade"), band.alias("grade_band"),
    )


# ---- exams ----

# How a question and a part begin, lines of exam booklets that are no text, and what begins the reference sheet.
START = r"^\s{0,2}(\d{1,2})\s+(?=[A-Z(“\"])"
PART = r"^Part\s+(I{1,3}V?|IV)\b"
NOISE = (r"^Use this space for\s*$", r"^computations\.?\s*$", r"^Use this space for computations\.?\s*$", r"^\s*\[\s*\d+\s*\]\s*(\[OVER\])?\s*$", r"^\s*\[OVER\]\s*$")
NOISE_IN_ANY_CASE = (r"^(Algebra I|Geometry|Algebra II)\s*[–—-]\s*(Jan|June|Aug)", r"^GO RIGHT ON TO THE NEXT PAGE")
SHEET = ("High School Math Reference Sheet", "Tear Here")
_START, _PART = re.compile(START), re.compile(PART)
_NOISE = [re.compile(p) for p in NOISE] + [re.compile(p, re.I) for p in NOISE_IN_ANY_CASE]


def split_exam(text: str, least: int = 8) -> list[tuple[int, str]]:
    """(number, text) of the questions of an exam: one begins only where a line starts with the next number in turn."""
    found: list[list[str]] = []
    for line in text.split("\n"):
        if any(p.match(line) for p in _NOISE):
            continue
        m = _START.match(line)
        if m and int(m[1]) == len(found) + 1:
            found.append([line.strip()])
        elif found and not _PART.match(line.strip()):
            found[-1].append(line.rstrip())
    texts = ["\n".join(q).strip() for q in found]
    if texts:
        cuts = [at for s in SHEET if (at := texts[-1].find(s)) > 0]
        texts[-1] = texts[-1][: min(cuts)].rstrip() if cuts else texts[-1]
    return [(i, t) for i, t in enumerate(texts, 1) if len(t.split()) >= least]


def parse_exams(raw: DataFrame) -> DataFrame:
    """(exam, num, text) of exam texts (exam, payload)."""
    return _job(raw, lambda r: [(r["exam"], n, t) for n, t in split_exam(r["payload"] or "")], ["exam", "num", "text"], "exam string, num int, text string", ["exam", "payload"])


# ---- item JSON ----


def plain(fragment: str) -> str:
    """The text of an encoded fragment of markup."""
    return " ".join(re.sub(r"<[^>]+>", " ", unquote(fragment)).split())


def _nodes(x: object) -> Iterator[dict]:
    """All objects of a JSON value, each before what is in it."""
    if isinstance(x, dict):
        yield x
    for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
        yield from _nodes(y)


def item_content(raw: str) -> tuple[str, list[tuple[str, str]]]:
    """Prompt and choices of an item's JSON: texts under prompt or html at any depth but in STYLE nodes, each once, by an empty
    line; and of each distractor its letter, else id, else nothing, and content."""
    try:
        nodes = list(_nodes(json.loads(raw)))
    except (TypeError, ValueError, RecursionError):
        return "", []
    said = [plain(v) for n in nodes if n.get("tag") != "STYLE" for v in (n.get("prompt"), n.get("html")) if isinstance(v, str)]
    options = [o for n in nodes if isinstance(n.get("distractors"), list) for o in n["distractors"] if isinstance(o, dict) and o.get("content")]
    return "\n\n".join(dict.fromkeys(t for t in said if len(t) > 2)), [(str(o.get("letter") or o.get("id") or ""), plain(str(o["content"]))) for o in options]


def parse_items(raw: DataFrame) -> DataFrame:
    """(key, prompt, choices array of (id, text)) of item JSON (key, payload)."""
    return _job(raw, lambda r: [(r["key"], *item_content(r["payload"]))], ["key", "prompt", "choices"], "key string, prompt string, choices array<struct<id:string,text:string>>", ["key", "payload"])


# Marks in the alternative text of an item's picture.
SHOT, QUESTION, CHOICES = r"^Screen shot of an interactive question\.\s*", "QUESTION TEXT:", r"\s*ANSWER CHOICES:\s*"


def _unescaped(text: Column) -> Column:
    """Character references decoded, which no column function does."""

    @F.pandas_udf("string")
    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    return decode(text)


def _readable(text: Column) -> Column:
    lines = F.replace(text, F.lit(r"\r\n"), F.lit("\n"))
    return F.regexp_replace(_unescaped(lines), r"(?U)^\s+|\s+$", "")


def without_tags(page: Column) -> Column:
    """The words of a page with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(page, "<[^>]+>", " "), r"(?U)\s+", " "))


def question_text(page: Column) -> Column:
    """The longest alternative text (of several the first) if it holds the mark of a question: its parts between the marks,
    choices on a line of their own; of other pages the words."""
    pictures = F.regexp_extract_all(page, F.lit('alt="([^"]+)"'), F.lit(1))
    longest = F.aggregate(pictures, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    asked = F.trim(F.array_join(F.split(F.regexp_replace(longest, SHOT, ""), QUESTION), ""))
    return _readable(F.when(longest.contains(QUESTION), F.array_join(F.split(asked, CHOICES), "\n")).otherwise(without_tags(page)))


def guide_text(guide: Column, limit: int = 500) -> Column:
    """The words of a scoring guide, `limit` characters of them; null if there are none."""
    return F.nullif(F.substring(_readable(without_tags(guide)), 1, limit), F.lit(""))


def parse_question_pages(raw: DataFrame) -> DataFrame:
    """(key, question, answer_key) of item pages (key, payload, guide): the guide in 500 characters."""
    page, guide = F.coalesce("payload", F.lit("")), F.coalesce("guide", F.lit(""))
    return raw.select("key", question_text(page).alias("question"), guide_text(guide).alias("answer_key"))
