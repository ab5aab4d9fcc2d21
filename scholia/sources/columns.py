"""Parsers of raw records that are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.sources.corpus import stored

# Fixed values of the sources.
MONTHS = {1: "January", 6: "June", 8: "August"}
#: Item types by the code of a state, a national and a consortium's catalogue; other codes are constructed responses.
ITEM_TYPES = {
    "state": {"sr": "multiple_choice", "cr": "constructed_response", "sa": "constructed_response", "es": "constructed_response"},
    "national": {"mc": "multiple_choice", "sr": "multiple_choice", "scr": "constructed_response", "ecr": "constructed_response", "cr": "constructed_response"},
    "consortium": {
        "mc": "multiple_choice", "ms": "multiple_choice", "sa": "constructed_response", "wer": "constructed_response", "er": "constructed_response", "te": "constructed_response",
        "eq": "constructed_response", "gi": "performance_task", "sim": "performance_task", "mi": "constructed_response", "ti": "constructed_response", "htq": "constructed_response",
    },
}
QUESTION_HEAD = r"\n(?=(?:Question|Problem)\s+\d+\b|\d+\.\s+[A-Z])"
BOOKLET_LINES = (r"AP®.*?Free-Response Questions\s*", r"(?s)Write your responses to this question.*?booklet\.\s*", r"GO ON TO THE NEXT PAGE\.\s*\d*", r"© \d{4} College Board\..*?collegeboard\.org\.")
SCORING_ROW = r"(?:Algebra I{1,2}|Geometry)\s+\w+\.?\s+['’]?\d{2}\s+(\d{1,2})\s+(\d)\s+MC\s+\d"
EXAM_LINK = r'href="([^"]*SLUG(?:cc)?-?(\d{5})-exam(?!lt|-lt)[a-z]{0,2}\.pdf)"'
CATALOGUE_HEAD, STANDARD_PREFIX = "Smarter Balanced Grade {} Mathematics Assessment Item", "CCSS.MATH.Content."
COMPLEXITY_DOK = {"low": 1, "moderate": 2, "high": 3}
#: Grades that a national and a state's assessment have.
TESTED_GRADES = {"national": (4, 8, 12), "state": (3, 4, 5, 6, 7, 8, 10)}


def words(text: Column) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def without_repeats(lines: Column) -> Column:
    """An array without elements equal to the one before."""
    before = F.concat(F.array(F.lit(None).cast("string")), lines)
    return F.filter(F.zip_with(lines, F.slice(before, F.lit(1), F.size(lines)), lambda x, y: F.when(~x.eqNullSafe(y), x)), lambda x: x.isNotNull())


def transcript_text(vtt: Column) -> Column:
    """The words of a transcript: no header, notes, times, numbers, tags or speakers, no line twice in a row."""
    lines = F.transform(F.split(vtt, r"\r\n|\n|\r"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    said = F.filter(lines, lambda x: (x != "") & (x != "WEBVTT") & ~x.contains("-->") & ~x.rlike("^(NOTE|STYLE|REGION)") & ~x.rlike("^[0-9]+$"))
    clean = F.transform(said, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "</?[^>]+>", ""), r"^-?\s*\[[^\]]+\]\s*", "")))
    return F.trim(F.array_join(without_repeats(F.filter(clean, lambda x: x != "")), " "))


def transcripts(raw: DataFrame, least: int = 20) -> DataFrame:
    """Chunks of raw transcripts (key, title, payload) with at least `least` words."""
    out = raw.select("key", "title", transcript_text(F.col("payload")).alias("content"))
    return out.withColumn("word_count", words(F.col("content"))).where(F.col("word_count") >= least)


def grade_band(title: Column) -> Column:
    t = F.lower(title)
    g = F.regexp_extract(t, r"([0-9]+)(?:st|nd|rd|th)\s+grade", 1).try_cast("int")
    high = t.rlike("high school|algebra|geometry|trigonometry|precalculus|calculus|statistics")
    return F.when(t.contains("kindergarten"), "K-5").when(g.isNotNull(), F.when(g <= 5, "K-5").when(g <= 8, "6-8").otherwise("9-12")).when(high, "9-12")


def licence_name(url: Column, names: dict[str, str]) -> Column:
    """The name of a licence by its code in a URL; one that isn't known is the URL."""
    code = F.regexp_extract(url, "/licenses/([^/]+)", 1)
    out = None
    for k, v in names.items():
        out = F.when(code == k, v) if out is None else out.when(code == k, v)
    return out.otherwise(url) if out is not None else url


def attribution(book: Column, chapter: Column, section: Column, title: Column, licence: Column) -> Column:
    place = F.when(chapter.isNotNull(), F.concat(F.lit(", Section "), chapter.cast("string"), F.when(section.isNotNull(), F.concat(F.lit("."), section.cast("string"))).otherwise("")))
    return F.concat(book, F.coalesce(place, F.lit("")), F.lit(": "), title, F.lit(", "), licence)


def objective_ids(classes: Column, system: Column) -> Column:
    """Identifiers AP.SYSTEM.idea.objective of tag codes like aplo-2-1 in a text of classes, each once; numbers lose leading zeros."""
    part = lambda n: F.transform(F.regexp_extract_all(classes, F.lit(r"aplo-(\d+)-(\d+)"), F.lit(n)), lambda x: x.cast("int").cast("string"))
    name = F.concat(F.lit("AP."), F.replace(F.upper(system), F.lit("-"), F.lit("_")))
    return F.array_distinct(F.zip_with(part(1), part(2), lambda i, o: F.concat_ws(".", name, i, o)))


def page_title(headings: Column, base: Column) -> Column:
    """The structured title, and after it the first heading (of an array) that, without its minutes, is short and not empty."""
    clean = F.transform(headings, lambda h: F.regexp_replace(h, r"\s*\([0-9]+\s*minutes?\)\s*$", ""))
    head = F.get(F.filter(clean, lambda h: (h != "") & (F.length(h) < 100)), F.lit(0))
    return F.concat(base, F.coalesce(F.concat(F.lit(": "), head), F.lit("")))


def administration(code: Column) -> Column:
    """Struct of month and year of a code like 62025; null if it is none."""
    ok = code.rlike("^[0-9]{5,6}$")
    n = F.length(code)
    return F.when(ok, F.struct(F.substring(code, F.lit(1), n - 4).cast("int").alias("month"), F.substring(code, n - 3, F.lit(4)).cast("int").alias("year")))


def exam_links(html: Column, slug: str) -> Column:
    """Administration codes of an exam's files on an index page, large-type editions left out."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(EXAM_LINK.replace("SLUG", slug)), F.lit(2)))


def file_year(name: Column) -> Column:
    """The year in a file name, of four digits or two."""
    four, two = F.regexp_extract(name, "((?:19|20)[0-9]{2})", 1), F.regexp_extract(name, r"(?<![0-9])([0-9]{2})(?![0-9])", 1)
    return F.when(four != "", four.try_cast("int")).when(two != "", 2000 + two.try_cast("int"))


def first_per_administration(files: DataFrame) -> DataFrame:
    """The first file (series, month, year, ord) of each administration."""
    return files.groupBy("series", "month", "year").agg(F.min_by(F.struct(*[c for c in files.columns if c not in ("series", "month", "year")]), "ord").alias("f")).select("series", "month", "year", "f.*")


def scoring_key(text: Column) -> Column:
    """Map of question number to choice from the rows of a scoring key."""
    q, a = F.regexp_extract_all(text, F.lit(SCORING_ROW), F.lit(1)), F.regexp_extract_all(text, F.lit(SCORING_ROW), F.lit(2))
    pairs = F.arrays_zip(F.transform(q, lambda x: x.cast("int")).alias("q"), F.transform(a, lambda x: x.cast("int")).alias("a"))
    return F.map_from_entries(F.filter(pairs, lambda x, i: ~F.array_contains(F.slice(F.transform(pairs, lambda p: p["q"]), F.lit(1), i), x["q"])))


def with_answers(questions: DataFrame, keys: DataFrame, last_choice: int = 24) -> DataFrame:
    """Questions (exam, num, text) with their answer and item type; keys: exam, answers map."""
    j = questions.join(keys, "exam", "left")
    answer = F.try_element_at("answers", F.col("num"))
    return j.select("exam", "num", "text", F.when(F.col("num") <= last_choice, "multiple_choice").otherwise("constructed_response").alias("item_type"), F.when((F.col("num") <= last_choice) & answer.isNotNull(), F.concat(F.lit("("), answer.cast("string"), F.lit(")"))).alias("answer_key"))


def free_response(text: Column, least: int = 20) -> Column:
    """Array of (number, text) of the questions of a free-response booklet, which begin at heads of a line; what is before the
    first head is the cover. Lines of the booklet go; questions under `least` words before or after that do, too."""
    parts = F.transform(F.split(text, "(?i)" + QUESTION_HEAD), lambda x, i: F.struct(i.alias("i"), F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")).alias("t")))
    asked = F.filter(parts, lambda x: (x["i"] > 0) & (words(x["t"]) >= least))

    def question(x: Column) -> Column:
        number = F.coalesce(F.nullif(F.regexp_extract(x["t"], r"(?i)^(?:Question|Problem)\s+(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(x["t"], r"^(\d+)\.\s+", 1), F.lit("")))
        body = x["t"]
        for line in BOOKLET_LINES:
            body = F.regexp_replace(body, line, "")
        return F.struct(F.coalesce(number.cast("int"), x["i"]).alias("number"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("text"))

    return F.filter(F.transform(asked, question), lambda x: words(x["text"]) >= least)


def rubric_answer(rubric: Column, choices: Column) -> Column:
    """'Correct: (B) text; (i); ...' of the ids (else values) in all states of a JSON rubric's score groups, looked up in choices
    (array of id and text); without ids the 500 first characters of its guide for people; else null."""
    states = "array<struct<RubricStates:array<struct<id:string,val:string>>>>"
    r = F.from_json(rubric, f"HumanScoringGuide string, ScoreGroups {states}")
    ids = F.transform(F.flatten(F.transform(F.filter(r["ScoreGroups"], lambda g: g["RubricStates"].isNotNull()), lambda g: g["RubricStates"])), lambda s: F.coalesce(F.nullif(s["id"], F.lit("")), F.nullif(s["val"], F.lit(""))))
    last = lambda i: F.try_element_at(F.filter(choices, lambda c: c["id"] == i), F.lit(-1))["text"]
    said = F.transform(F.filter(ids, lambda i: i.isNotNull()), lambda i: F.concat(F.lit("("), i, F.lit(")"), F.coalesce(F.concat(F.lit(" "), last(i)), F.lit(""))))
    guide = F.trim(F.substring(F.regexp_replace(F.trim(r["HumanScoringGuide"]), "<[^>]+>", " "), 1, 500))
    return F.when(F.size(said) > 0, F.concat(F.lit("Correct: "), F.array_join(said, "; "))).otherwise(F.nullif(guide, F.lit("")))


def item_body(prompt: Column, choices: Column, description: Column, category: Column) -> Column:
    """Prompt and choices; the description alone if that is under five words, else before it unless it is in it; then the category."""
    base = F.trim(F.concat_ws("\n", prompt, F.array_join(choices, "\n")))
    body = F.when(words(base) < 5, F.coalesce(description, base)).when(description.isNotNull() & ~F.contains(base, description), F.concat(description, F.lit("\n\n"), base)).otherwise(base)
    return F.concat_ws("\n\n", body, category)


def percent_correct(performance: Column) -> Column:
    """Share (0 to 1) of the first data point with a star in its label, of JSON {"result": {"series": [{"dataPoints":
    [{"AxisLabel", "YValues": [...]}]}]}}; null if any part lacks."""
    series = F.from_json(performance, "result struct<series:array<struct<dataPoints:array<struct<AxisLabel:string,YValues:array<double>>>>>>")["result"]["series"]
    points = F.flatten(F.transform(series, lambda p: p["dataPoints"]))
    return F.get(F.get(F.filter(points, lambda x: x["AxisLabel"].contains("*")), F.lit(0))["YValues"], F.lit(0)) / 100


def _mapped(code: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.lower(code))


def item_type(code: Column, catalogue: str) -> Column:
    """The item type of a code in one of the catalogues."""
    return F.coalesce(_mapped(code, ITEM_TYPES[catalogue]), F.lit("constructed_response"))


def dok_level(complexity: Column) -> Column:
    return _mapped(complexity, COMPLEXITY_DOK)


def catalogue_lines(grade: Column, kind: Column, standard: Column, description: Column, dok: Column, domain: Column, claim: Column, target: Column, url: Column) -> Column:
    """The content of a catalogue item: its head and type, those of the next lines that there is something for, and its address."""
    lines = (("Standard: " + STANDARD_PREFIX, standard), ("Standard Description: ", description), ("Depth of Knowledge: Level ", F.nullif(dok.cast("string"), F.lit("0"))), ("Domain: ", domain), ("Claim: ", claim), ("Target: ", target))
    head, tail = CATALOGUE_HEAD.split("{}")
    there = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name), c)) for name, c in lines]
    return F.concat_ws("\n", F.concat(F.lit(head), grade.cast("string"), F.lit(tail)), F.concat(F.lit("Type: "), F.coalesce(kind, F.lit(""))), *there, F.concat(F.lit("\nView item: "), url))


def catalogue_items(items: DataFrame, grades: list[int]) -> DataFrame:
    """Mathematics items of the wanted grades (subject, grade_label)."""
    grade = F.when(F.lower("grade_label").contains("high school"), 11).otherwise(F.regexp_extract("grade_label", "([0-9]+)", 1).try_cast("int"))
    return items.withColumn("grade", grade).where((F.upper("subject") == "MATH") & F.col("grade").isin(grades))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def item_id(style: Column, standard: Column, question: Column) -> Column:
    """A short identifier that the same item always has."""
    return F.substring(F.sha2(F.concat(style, F.lit(":"), standard, F.lit(":"), F.substring(question, 1, 80)), 256), 1, 12)


def child_numbers(html: Column, prefix: str) -> Column:
    """Distinct numbers that follow a prefix in the links of an index page, sorted."""
    return F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(rf'href="{prefix}/([0-9]+)'), F.lit(1)), lambda x: x.cast("int"))))


def band_of_grade(grade: Column) -> Column:
    """K-5, 6-8 or 9-12 of a grade's number; null stays."""
    return F.when(grade <= 5, "K-5").when(grade <= 8, "6-8").when(grade.isNotNull(), "9-12")


def tested_band(grade: Column, assessment: str) -> Column:
    """The band of a grade that the assessment tests; of any other null."""
    number = grade.try_cast("int")
    return F.when(number.isin(*TESTED_GRADES[assessment]), band_of_grade(number))


def grade_of_category(category: Column) -> tuple[Column, Column]:
    """(grade, band) of a page category: kindergarten is K, grade-n is n up to 8, all others are HS."""
    number = F.when(category == "kindergarten", 0).otherwise(F.regexp_extract(category, "^grade-([1-8])$", 1).try_cast("int"))
    return F.when(number == 0, "K").when(number.isNotNull(), number.cast("string")).otherwise("HS"), F.coalesce(band_of_grade(number), F.lit("9-12"))


def problem_links(html: Column, base: str) -> Column:
    """Distinct addresses, in page order, of the links in the second-level headings of a page's articles: those of the site
    `base` and those without a host, which get it."""
    blocks = lambda text, tag: F.regexp_extract_all(text, F.lit(rf"(?is)<{tag}\b.*?</{tag}\s*>"), F.lit(0))
    links = lambda text: F.regexp_extract_all(text, F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    heads = F.flatten(F.transform(blocks(html, "article"), lambda x: blocks(x, "h2")))
    found = F.filter(F.flatten(F.transform(heads, links)), lambda x: x.startswith(base) | x.startswith("/"))
    return F.array_distinct(F.transform(found, lambda x: F.when(x.startswith("http"), x).otherwise(F.concat(F.lit(base), x))))


def unit_lessons(html: Column, prefix: str) -> Column:
    """Distinct (unit, lesson) pairs in the links of an index page."""
    pattern = rf'href="{prefix}/unit-([0-9]+)/lesson-([0-9]+)'
    u, n = F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), F.regexp_extract_all(html, F.lit(pattern), F.lit(2))
    return F.sort_array(F.array_distinct(F.transform(F.arrays_zip(u.alias("u"), n.alias("n")), lambda x: F.struct(x["u"].cast("int").alias("unit"), x["n"].cast("int").alias("lesson")))))


def place_in_book(books: DataFrame, modules: DataFrame) -> DataFrame:
    """Modules with chapter and section: positions of the subcollection and inside it. books: slug, chapters array<array<string>>
    of module ids; modules that no chapter holds (front matter) are left out."""
    c = books.select("slug", F.posexplode("chapters").alias("c", "ms")).select("slug", (F.col("c") + 1).alias("chapter"), F.posexplode("ms").alias("s", "module_id")).withColumn("section", F.col("s") + 1).drop("s")
    return modules.join(c, ["slug", "module_id"])


def descendants(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, root_order, distance) of the roots (id, root_order) and of all nodes (id, parent_id) below them, at any depth.

    Pointers double: after round j every node points to the one 2 ** j above it and knows the roots below that point, so a
    tree of depth n takes log2(n) rounds, each stored. A node of a cycle never runs out of nodes above it; no path is
    longer than the number of nodes, so the rounds end there. Among several ways to a root the shortest counts.
    """
    up = stored(nodes.where("id is not null and parent_id is not null").select("id", F.col("parent_id").alias("above")).distinct())
    hits = stored(roots.select("id", "root_order", F.lit(0).cast("long").alias("distance")).groupBy("id", "root_order").agg(F.min("distance").alias("distance")))
    most, step = up.count(), 1
    while step <= most and not up.isEmpty():
        over = up.join(hits.withColumnRenamed("id", "above"), "above").select("id", "root_order", (F.col("distance") + step).alias("distance"))
        hits = stored(hits.unionByName(over).groupBy("id", "root_order").agg(F.min("distance").alias("distance")))
        up = stored(up.join(up.select(F.col("id").alias("above"), F.col("above").alias("next")), "above").select("id", F.col("next").alias("above")).distinct())
        step *= 2
    return hits.select("id", "root_order", F.col("distance").cast("int").alias("distance"))


def inherited_grades(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, band) of every node below a grade topic (id, root_order, title): the first topic wins."""
    r = roots.withColumn("band", grade_band(F.col("title"))).where("band is not null")
    return descendants(nodes, r).join(r.select("root_order", "band"), "root_order").groupBy("id").agg(F.min_by("band", "root_order").alias("band"))


def leaf_files(nodes: DataFrame, files: DataFrame, local: DataFrame, *, kind: str, preset: str, extension: str) -> DataFrame:
    """One file for each node of a kind: nodes (id, kind), files (node_id, preset, lang, local_id), local (local_id, extension)."""
    j = nodes.where(F.col("kind") == kind).join(files.where(F.col("preset") == preset), F.col("id") == F.col("node_id")).join(local.where(F.col("extension") == extension), "local_id")
    w = Window.partitionBy("id").orderBy("local_id")
    return j.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "node_id")


def one_per_content(nodes: DataFrame) -> DataFrame:
    """One node for each content_id: the first that has a band, else the first (content_id, band, ord, id)."""
    best = F.min_by(F.struct("id", "band", "ord"), F.struct(F.col("band").isNull().alias("n"), F.col("ord").alias("o"), F.col("id").alias("i")))
    return nodes.groupBy("content_id").agg(best.alias("b")).select("content_id", "b.*")
