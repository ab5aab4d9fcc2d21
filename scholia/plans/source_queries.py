"""The registered queries of sources, parsers and evaluation: raw records are written from the given tables, one for each of
their rows, and the SQL says what must come out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.operators import align, evals, merge, review
from scholia.plans.fixtures import view
from scholia.plans.registry import query
from scholia.sources import columns as C
from scholia.sources import corpus as IO
from scholia.sources import documents as D


def _raw(s: SparkSession, d: str, table: str, *columns: str) -> DataFrame:
    return view(s, d, table).selectExpr(*columns)


# ---- sources and sinks ----


@query("SELECT CAST(s_suppkey AS BIGINT) s_suppkey, s_name, CAST(NULL AS BIGINT) c_custkey, 'core' part FROM supplier UNION ALL SELECT NULL, NULL, CAST(c_custkey AS BIGINT), 'ncsa' FROM customer")
def s1_partitions(s: SparkSession, d: str) -> DataFrame:
    parts = IO.read_parts(s, f"{d}/supplier.parquet", {"ncsa": f"{d}/customer.parquet", "ap": f"{d}/no such partition.parquet"})
    return parts.selectExpr("bigint(s_suppkey) s_suppkey", "s_name", "bigint(c_custkey) c_custkey", "part")


@query("SELECT chunk_id, dok_level, exam_series, CAST(NULL AS VARCHAR) item_type, CAST(NULL AS VARCHAR) answer_key, CAST(NULL AS INTEGER) exam_year, CAST(NULL AS DOUBLE) difficulty, CAST(NULL AS VARCHAR) item_generation, 'item_type,answer_key,exam_year,difficulty,item_generation' added FROM fx_chunks")
def s2_healed_partition(s: SparkSession, d: str) -> DataFrame:
    healed, added = IO.heal(view(s, d, "fx_chunks"))
    return healed.select("chunk_id", *(f.name for f in IO.ASSESSMENT.fields), F.lit(",".join(added)).alias("added"))


_SNAPSHOTS = "concat('src-', substr(o_orderpriority, 1, 1)) source_id", "concat('k:', o_orderkey, '/x') key", "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") fetched_at", "string(o_totalprice) payload"


@query("SELECT concat('src-', substr(o_orderpriority, 1, 1)) source_id, concat('k:', o_orderkey, '/x') AS key, concat('src-', substr(o_orderpriority, 1, 1), '/', strftime(o_orderdate, '%Y-%m-%d'), '/k__', o_orderkey, '_x.json') path FROM orders")
def s3_snapshot_paths(s: SparkSession, d: str) -> DataFrame:
    return IO.snapshot_paths(_raw(s, d, "orders", *_SNAPSHOTS), ext="json")


@query("SELECT concat('src-', substr(o_orderpriority, 1, 1)) source_id, strftime(o_orderdate, '%Y') AS year, count(*) n FROM orders GROUP BY ALL")
def s3_snapshots_written(s: SparkSession, d: str) -> DataFrame:
    at = IO.shared_folder(s)
    by_year = _raw(s, d, "orders", *_SNAPSHOTS).withColumn("fetched_at", F.concat(F.substring("fetched_at", 1, 4), F.lit("-01-01")))
    IO.write_snapshots(by_year, at)
    IO.write_snapshots(by_year, at)  # again: nothing doubles
    return s.read.parquet(at).groupBy("source_id", F.date_format("fetch_date", "yyyy").alias("year")).agg(F.count("*").alias("n"))


@query("SELECT concat('STD.', n_regionkey, '.', n_nationkey) standard_id, concat('http://x.y/', n_name) url FROM nation")
def s4_commented_seed(s: SparkSession, d: str) -> DataFrame:
    item = F.expr("concat('  {\"standard_id\": \"STD.', n_regionkey, '.', n_nationkey, '\", \"url\": \"http://x.y/', n_name, '\"}')")
    lists = view(s, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(item)), ",\n// next\n").alias("i"))
    texts = lists.selectExpr("concat(' // seed\n', if(n_regionkey % 2 = 0, concat('{\"crosswalks\": [\n', i, ']}'), concat('[', i, ']'))) value")
    return IO.read_seed(texts, "standard_id string, url string", "crosswalks")


@query("SELECT CAST(c_custkey AS BIGINT) id, c_mktsegment question, c_custkey % 4 dok FROM customer")
def s5_json_seed(s: SparkSession, d: str) -> DataFrame:
    item = F.to_json(F.struct(F.col("c_custkey").cast("long").alias("id"), F.col("c_mktsegment").alias("question"), (F.col("c_custkey") % 4).alias("dok")))
    texts = view(s, d, "customer").groupBy("c_nationkey").agg(F.collect_list(item).alias("i")).selectExpr("if(c_nationkey % 2 = 0, concat('[', array_join(i, ','), ']'), concat('{\"items\": [', array_join(i, ','), ']}')) value")
    return IO.read_seed(texts, "id long, question string, dok long", "items")


@query("SELECT standard_id, CAST(count(*) AS VARCHAR) n FROM fx_alignments GROUP BY 1")
def s6_csv_report(s: SparkSession, d: str) -> DataFrame:
    at = IO.shared_folder(s)
    IO.write_report(view(s, d, "fx_alignments").groupBy("standard_id").agg(F.count("*").alias("n")), at)
    return s.read.csv(at, header=True)


@query("SELECT source_id, count(*) n FROM fx_chunks GROUP BY 1")
def s7_json_result(s: SparkSession, d: str) -> DataFrame:
    at = IO.shared_folder(s)
    IO.write_result(view(s, d, "fx_chunks").groupBy("source_id").agg(F.count("*").alias("n")), at)
    return s.read.schema("source_id string, n long").json(at)


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) pos, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) i FROM embeddings)")
def s8_vector_codec(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "embeddings").select("vec_id", F.posexplode(IO.decode_vectors(IO.encode_vectors(F.col("embedding")))).alias("pos", "value")).withColumn("value", F.col("value").cast("double"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s9_external_table(s: SparkSession, d: str) -> DataFrame:
    return IO.read_table(s, "nation", exported=d).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT CAST(p_partkey AS BIGINT) id, p_name AS stem, concat('STD.', CAST(p_size AS VARCHAR)) AS standard, CAST(p_size % 3 AS BIGINT) AS level FROM part")
def s10_nested_items(s: SparkSession, d: str) -> DataFrame:
    texts = _raw(s, d, "part", "concat('[{\"id\": ', p_partkey, ', \"body\": {\"stem\": \"', p_name, '\", \"standards\": [{\"id\": \"STD.', p_size, '\", \"level\": ', p_size % 3, '}]}}]') value")
    items = IO.read_seed(texts, "id long, body struct<stem:string,standards:array<struct<id:string,level:long>>>", "items")
    return items.select("id", F.col("body.stem").alias("stem"), F.inline("body.standards")).toDF("id", "stem", "standard", "level")


# ---- textbooks ----

#: One module for each part: two plain sections, one with an example; a summary; exercises by the profile of the book.
_MODULE = """concat('<document xmlns="http://cnx.rice.edu/cnxml" xmlns:m="http://www.w3.org/1998/Math/MathML"><title>', p_name, '</title><content><section><title>', p_type, '</title><para>Add <m:math><m:mfrac><m:mn>', p_size,
'</m:mn><m:mn>7</m:mn></m:mfrac><m:mo>×</m:mo><m:msup><m:mi>ab</m:mi><m:mn>2</m:mn></m:msup></m:math> now.</para><example class="aplo-2-', p_size, '"><title>Try</title><para>Worked ', p_size, '.</para></example><figure><para>no</para></figure></section>',
'<section class="lead"><para/></section><section class="wide ', if(p_partkey % 2 = 0, 'key-concepts', 'summary'), '"><para>In short.</para></section>',
if(p_partkey % 2 = 0, '<section class="section-exercises"><section><title>Verbal</title><para>1. Do.</para></section><section><para>2. Again.</para></section></section>', '<section class="multiple-choice"><para>1. Do.</para></section>'),
'<section><para>Last.</para></section></content></document>')"""
_MODULES = """SELECT p_partkey, concat('os-b-m', p_partkey) pre, p_name n, p_type t, p_size z, p_partkey % 2 = 0 math FROM part"""


def _modules(s: SparkSession, d: str) -> DataFrame:
    return D.parse_modules(_raw(s, d, "part", "'b' as slug", "concat('m', p_partkey) module_id", "if(p_partkey % 2 = 0, 'math', 'science') profile", f"{_MODULE} payload"), "os")


@query(f"""WITH m AS ({_MODULES})
SELECT concat(pre, '-expo1') chunk_id, 'exposition' content_type, concat(n, ': ', t) title, concat(t, chr(10), 'Add $\\frac{{', z, '}}{{7}}\\times {{ab}}^{{2}}$ now.') AS content FROM m
UNION ALL SELECT concat(pre, '-ex1'), 'worked_example', concat(n, ' — Example 1'), concat('Try', chr(10), 'Worked ', z, '.') FROM m UNION ALL SELECT concat(pre, '-summary'), 'summary', concat(n, ' — Key Concepts'), 'In short.' FROM m
UNION ALL SELECT concat(pre, '-set1'), 'exercise_set', concat(n, CASE WHEN math THEN ' — Verbal' ELSE ' — Multiple Choice' END), CASE WHEN math THEN concat('Verbal', chr(10), '1. Do.') ELSE '1. Do.' END FROM m
UNION ALL SELECT concat(pre, '-set2'), 'exercise_set', concat(n, ' — Exercises'), '2. Again.' FROM m WHERE math UNION ALL SELECT concat(pre, '-expo3'), 'exposition', n, 'Last.' FROM m""")
def p1_module_splitter(s: SparkSession, d: str) -> DataFrame:
    return _modules(s, d).select("chunk_id", "content_type", "title", "content")


_PROFILE_CASES = [(p, r.summary, r.container or r.sets[0], "nested" if r.container else "flat") for p, r in D.PROFILES.items()]


@query("WITH p(profile, i) AS (VALUES " + ", ".join(f"('{p}', {i})" for i, (p, *_) in enumerate(_PROFILE_CASES)) + f"""), m AS (SELECT n_nationkey k, profile FROM nation JOIN p ON i = n_nationkey % {len(_PROFILE_CASES)})
SELECT k, profile, 'exercise_set' content_type, '-set1' AS suffix FROM m UNION ALL SELECT k, profile, 'summary', '-summary' FROM m UNION ALL SELECT k, profile, 'exposition', '-expo1' FROM m""")
def p2_section_roles(s: SparkSession, d: str) -> DataFrame:
    """Every discipline's classes, among other tokens, for each nation's module."""
    cases = F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(summary).alias("summary"), F.lit(exercise).alias("exercise"), F.lit(kind).alias("kind")) for p, summary, exercise, kind in _PROFILE_CASES])
    m = view(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.get(cases, F.col("n_nationkey") % len(_PROFILE_CASES)).alias("c"))
    xml = F.expr("""concat('<document><title>T</title><content><section class="', c.summary, ' x"><para>a</para></section><section class="x ', c.exercise, '">', if(c.kind = 'nested', '<section><para>b</para></section>', '<para>b</para>'), '</section><section class="', c.summary, 's"><para>c</para></section></content></document>')""")
    out = D.parse_modules(m.select(F.lit("b").alias("slug"), F.col("k").cast("string").alias("module_id"), "c.profile", xml.alias("payload")), "os")
    return out.join(m.selectExpr("string(k) module_id", "k", "c.profile as profile"), "module_id").select("k", "profile", "content_type", F.regexp_extract("chunk_id", "-[a-z]+[0-9]*$", 0).alias("suffix"))


@query(r"""SELECT o_orderkey, concat('$\sqrt[3]{x_{', o_orderkey % 9, '}}\text{cm}\ [a, ', o_orderkey, ']\begin{matrix}1 & 2 \\ \pi & 4\end{matrix}$ end') AS content FROM orders""")
def p3_markup_and_math(s: SparkSession, d: str) -> DataFrame:
    xml = """concat('<document><content><section><para><math><mroot><msub><mi>x</mi><mn>', o_orderkey % 9, '</mn></msub><mn>3</mn></mroot><mtext> cm </mtext><mspace/><mfenced open="[" close="]"><mi>a</mi><mn>', o_orderkey,
'</mn></mfenced><mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr><mtr><mtd><mi>π</mi></mtd><mtd><mn>4</mn></mtd></mtr></mtable></math> end<media>no</media></para></section></content></document>')"""
    out = D.parse_modules(_raw(s, d, "orders", "'b' as slug", "string(o_orderkey) module_id", "'math' as profile", f"{xml.replace('<math>', '<m:math xmlns:m=\"m\">').replace('</math>', '</m:math>')} payload"), "os")
    return out.select(F.col("module_id").cast("long").alias("o_orderkey"), "content")


@query("""SELECT concat('os-b-m', p_partkey, '-ex1') chunk_id, concat('AP.AP_BIO.2.', p_size) standard_id FROM part""")
def p4_objective_tags(s: SparkSession, d: str) -> DataFrame:
    return _modules(s, d).select("chunk_id", F.explode(C.objective_ids(F.col("classes"), F.lit("ap-bio"))).alias("standard_id"))


@query("""SELECT concat('m', n_nationkey) module_id, n_regionkey slug, CAST(dense_rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 2) AS INTEGER) chapter, CAST(row_number() OVER (PARTITION BY n_regionkey, n_nationkey % 2 ORDER BY n_nationkey) AS INTEGER) section FROM nation""")
def p5_book_tree(s: SparkSession, d: str) -> DataFrame:
    n = view(s, d, "nation")
    ch = n.groupBy("n_regionkey", (F.col("n_nationkey") % 2).alias("c")).agg(F.sort_array(F.collect_list("n_nationkey")).alias("ms")).select("n_regionkey", "c", F.transform("ms", lambda x: F.concat(F.lit("m"), x.cast("string"))).alias("ms"))
    books = ch.groupBy(F.col("n_regionkey").alias("slug")).agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "ms"))), lambda x: x["ms"]).alias("chapters"))
    front = n.selectExpr("n_regionkey as slug", "concat('front', n_nationkey) module_id")
    return C.place_in_book(books, n.selectExpr("n_regionkey as slug", "concat('m', n_nationkey) module_id").unionByName(front)).select("module_id", "slug", "chapter", "section")


_LICENCES = {"by": "CC BY 4.0", "by-nc-sa": "CC BY-NC-SA 4.0"}


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'CC BY 4.0' WHEN 1 THEN 'CC BY-NC-SA 4.0' ELSE 'https://creativecommons.org/licenses/by-x/4.0/' END AS licence FROM orders""")
def p6_licence_codes(s: SparkSession, d: str) -> DataFrame:
    url = F.expr("concat('https://creativecommons.org/licenses/', case o_orderkey % 3 when 0 then 'by' when 1 then 'by-nc-sa' else 'by-x' end, '/4.0/')")
    return view(s, d, "orders").select("o_orderkey", C.licence_name(url, _LICENCES).alias("licence"))


@query("""SELECT p_partkey, concat('Book', CASE WHEN p_size % 3 > 0 THEN concat(', Section ', p_size % 3, CASE WHEN p_size % 2 = 1 THEN '.4' ELSE '' END) ELSE '' END, ': ', p_name, ', CC BY 4.0') attribution FROM part""")
def p7_attributions(s: SparkSession, d: str) -> DataFrame:
    chapter, section = F.expr("if(p_size % 3 > 0, p_size % 3, null)"), F.expr("if(p_size % 2 = 1, 4, null)")
    return view(s, d, "part").select("p_partkey", C.attribution(F.lit("Book"), chapter, section, F.col("p_name"), F.lit("CC BY 4.0")).alias("attribution"))


# ---- pages ----

_SAID = "A block of text about the matter that this lesson is on and that all will read"
_LESSON = f"""concat('<html><h1 class="im-c-hero__heading">', if(c_custkey % 3 = 0, '', concat(c_name, ' (', c_custkey % 30, ' minutes)')), '</h1><div class="x im-c-content">{_SAID} number ', c_custkey, ' &amp; more words.<br></div><nav>no part of it, whatever its length may be in the end</nav>',
'<div class="im-c-content">short</div><section class="im-c-content"><p>{_SAID} again ', c_custkey, '.</p></section><section class="im-c-content">{_SAID} again ', c_custkey, '.</section>',
'<p class="im-c-hero__underline">Addressing</p><div>x</div><ul><li><a href="#">', c_custkey % 9 + 1, '.RP.A.', c_custkey % 5, '</a></li><li><a>no tag</a></li></ul><p class="im-c-hero__underline">Building On</p><ul><li><a>K.CC.B.4</a></li></ul></html>')"""


def _lessons(s: SparkSession, d: str) -> DataFrame:
    return D.parse_lessons(_raw(s, d, "customer", "string(c_custkey) key", "'IM Grade 6' as base", f"{_LESSON} payload"))


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS key, concat('{_SAID} number ', c_custkey, ' & more words.', chr(10), chr(10), '{_SAID} again ', c_custkey, '.') AS content FROM customer")
def p8_lesson_text(s: SparkSession, d: str) -> DataFrame:
    return _lessons(s, d).select("key", "content")


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 3 = 0 THEN 'IM Grade 6' ELSE concat('IM Grade 6: ', c_name) END AS title FROM customer")
def p9_page_titles(s: SparkSession, d: str) -> DataFrame:
    return _lessons(s, d).select("key", "title")


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 9 + 1 <= 5 THEN concat('CCSS.MATH.', c_custkey % 9 + 1, '.RP.A.', c_custkey % 5) ELSE concat('CCSS.MATH.', c_custkey % 9 + 1, '.RP.', c_custkey % 5) END standard_id, 'CCSS.MATH.K.CC.B.4' building_on FROM customer")
def p10_labelled_standards(s: SparkSession, d: str) -> DataFrame:
    return _lessons(s, d).select("key", F.explode("addressing").alias("standard_id"), F.array_join(F.col("standards")["Building On"], ",").alias("building_on"))


_TRANSCRIPT = "concat('WEBVTT\n\nNOTE made by hand\n\n1\n00:00:01.000 --> 00:00:02.000\n- [Voiceover] ', p_name, '\n\n2\n00:00:02.000 --> 00:00:03.000\n<i>', p_name, '</i>\n', p_type, '\n00:00:03.000 --> 00:00:04.000\n', p_name, ' and so on until all of this has come to be as long as twenty ', if(p_size % 2 = 0, 'words or more of them', ''))"


@query("""SELECT * FROM (SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS title, trim(concat(p_name, ' ', p_type, ' ', p_name, ' and so on until all of this has come to be as long as twenty ', CASE WHEN p_size % 2 = 0 THEN 'words or more of them' ELSE '' END)) AS content, CAST(len(string_split(content, ' ')) AS INTEGER) word_count FROM part) WHERE word_count >= 20""")
def p12_transcripts(s: SparkSession, d: str) -> DataFrame:
    return C.transcripts(_raw(s, d, "part", "string(p_partkey) key", "p_name as title", f"{_TRANSCRIPT} payload"))


# ---- channel tree ----


def _tree(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Regions above nations above customers; regions are the topics of grades, and two nations stand under two of them."""
    n = view(s, d, "nation")
    nodes = _raw(s, d, "region", "concat('r', r_regionkey) id", "string(null) parent_id").unionByName(n.selectExpr("concat('n', n_nationkey) id", "concat('r', n_regionkey) parent_id"))
    nodes = nodes.unionByName(n.where("n_nationkey < 2").selectExpr("concat('n', n_nationkey) id", "'r4' as parent_id")).unionByName(_raw(s, d, "customer", "concat('c', c_custkey) id", "concat('n', c_nationkey) parent_id"))
    return nodes, _raw(s, d, "region", "concat('r', r_regionkey) id", "r_regionkey as root_order", "case r_regionkey when 0 then 'Kindergarten' when 3 then 'Arithmetic' else concat(r_regionkey * 3, 'th grade') end title")


_BELOW = """SELECT concat('r', r_regionkey) id, r_regionkey root_order, 0 distance FROM region UNION ALL SELECT concat('n', n_nationkey), n_regionkey, 1 FROM nation UNION ALL SELECT concat('n', n_nationkey), 4, 1 FROM nation WHERE n_nationkey < 2 AND n_regionkey <> 4
UNION ALL SELECT concat('c', c_custkey), n_regionkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT concat('c', c_custkey), 4, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey < 2 AND n_regionkey <> 4"""
_TOPICS = "CASE root_order WHEN 0 THEN 'K-5' WHEN 1 THEN 'K-5' WHEN 2 THEN '6-8' WHEN 4 THEN '9-12' END"


@query(_BELOW)
def p14_descendants(s: SparkSession, d: str) -> DataFrame:
    nodes, roots = _tree(s, d)
    return C.descendants(nodes, roots)


@query(f"SELECT id, arg_min({_TOPICS}, root_order) band FROM ({_BELOW}) WHERE root_order <> 3 GROUP BY id")
def p15_inherited_labels(s: SparkSession, d: str) -> DataFrame:
    nodes, roots = _tree(s, d)
    return C.inherited_grades(nodes, roots)


@query("""SELECT concat('o', l_orderkey) id, min(l_orderkey * 10 + l_linenumber) local_id FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_orderkey * 10 + l_linenumber IN (SELECT l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_linestatus = 'F') GROUP BY l_orderkey""")
def p16_leaf_files(s: SparkSession, d: str) -> DataFrame:
    nodes = _raw(s, d, "orders", "concat('o', o_orderkey) id", "o_orderstatus as kind")
    files = _raw(s, d, "lineitem", "concat('o', l_orderkey) node_id", "l_returnflag as preset", "'en' as lang", "l_orderkey * 10 + l_linenumber as local_id")
    local = _raw(s, d, "lineitem", "l_orderkey * 10 + l_linenumber as local_id", "l_linestatus as extension").distinct()
    return C.leaf_files(nodes, files, local, kind="F", preset="R", extension="F").select("id", "local_id").distinct()


@query("""SELECT content_id, id, band, ord FROM (SELECT o_custkey content_id, concat('o', o_orderkey) id, CASE WHEN o_orderstatus = 'F' THEN '6-8' END band, o_orderkey ord, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_orderkey) n FROM orders) WHERE n = 1""")
def p17_one_per_content(s: SparkSession, d: str) -> DataFrame:
    return C.one_per_content(_raw(s, d, "orders", "o_custkey as content_id", "concat('o', o_orderkey) id", "if(o_orderstatus = 'F', '6-8', null) band", "o_orderkey as ord"))


# ---- exams ----

_ASKED = "What is the value of x in the equation number"
_EXAM = f"""concat('Part I\n1 {_ASKED} ', c_custkey, '\nUse this space for\n7 {_ASKED} out of turn\n2 {_ASKED} two\n[3]\nPart II\nalgebra i - june\n3 Too short\n4 {_ASKED} last\nHigh School Math Reference Sheet\n5 Inches are a measure of length in use in some places')"""


@query(f"""SELECT c_custkey, 1 num, concat('1 {_ASKED} ', c_custkey, chr(10), '7 {_ASKED} out of turn') AS text FROM customer UNION ALL SELECT c_custkey, 2, '2 {_ASKED} two' FROM customer UNION ALL SELECT c_custkey, 4, '4 {_ASKED} last' FROM customer""")
def p18_exam_questions(s: SparkSession, d: str) -> DataFrame:
    out = D.parse_exams(_raw(s, d, "customer", "string(c_custkey) exam", f"{_EXAM.replace('5 Inches', 'Inches')} payload"))
    return out.select(F.col("exam").cast("long").alias("c_custkey"), "num", "text")


@query("""SELECT c_custkey, num, CASE WHEN num <= 24 THEN 'multiple_choice' ELSE 'constructed_response' END item_type, CASE WHEN num IN (7, 24) THEN concat('(', CASE num WHEN 7 THEN 1 + c_custkey % 4 ELSE 2 END, ')') END answer_key FROM customer, (VALUES (7), (8), (24), (25)) t(num)""")
def p19_scoring_key(s: SparkSession, d: str) -> DataFrame:
    key = F.expr("""concat('Scoring Key\nAlgebra I June \\'25 7 ', 1 + c_custkey % 4, ' MC 2\nAlgebra I June \\'25 7 9 MC 2\nGeometry Jan. 25 24 2 MC 2\nAlgebra II June 25 25 3 MC 2\nAlgebra I June 25 8 - CR 2')""")
    keys = view(s, d, "customer").select(F.col("c_custkey").alias("exam"), C.scoring_key(key).alias("answers"))
    asked = _raw(s, d, "customer", "c_custkey as exam", "explode(array(7, 8, 24, 25)) num", "'q' as text")
    return C.with_answers(asked, keys).select(F.col("exam").alias("c_custkey"), "num", "item_type", "answer_key")


@query("""SELECT month, year, CAST(min(o_orderkey) AS BIGINT) ord, count(*) files FROM (SELECT CAST(1 + o_orderkey % 12 AS INTEGER) AS month, CAST(2015 + o_orderkey % 8 AS INTEGER) AS year, o_orderkey FROM orders) GROUP BY ALL""")
def p20_administrations(s: SparkSession, d: str) -> DataFrame:
    """Codes of files, then the first file of each administration."""
    f = view(s, d, "orders").select(F.lit("x").alias("series"), C.administration(F.expr("concat(1 + o_orderkey % 12, 2015 + o_orderkey % 8)")).alias("a"), F.col("o_orderkey").cast("long").alias("ord"))
    f = f.select("series", "a.month", "a.year", "ord")
    return C.first_per_administration(f).join(f.groupBy("month", "year").agg(F.count("*").alias("files")), ["month", "year"]).select("month", "year", "ord", "files")


@query("""SELECT c_custkey, concat('6', 2016 + c_custkey % 4, ',', '8', 2020) codes, CAST(CASE WHEN c_custkey % 2 = 0 THEN 2016 + c_custkey % 4 ELSE 2010 + c_custkey % 10 END AS INTEGER) AS year FROM customer""")
def p20_exam_files(s: SparkSession, d: str) -> DataFrame:
    page = F.expr("concat('<a href=\"/x/algone-6', 2016 + c_custkey % 4, '-exam.pdf\"><a href=\"/x/algone6', 2016 + c_custkey % 4, '-examlt.pdf\"><a href=\"algone82020-examw.pdf\"><a href=\"geom12020-exam.pdf\">')")
    name = F.expr("if(c_custkey % 2 = 0, concat('frq-', 2016 + c_custkey % 4, '-set.pdf'), concat('ap', 10 + c_custkey % 10, '-frq.pdf'))")
    return view(s, d, "customer").select("c_custkey", F.array_join(C.exam_links(page, "algone"), ",").alias("codes"), C.file_year(name).alias("year"))


_LONG = "a b c d e f g h i j k l m n o p q r s t"


@query(f"""SELECT c_custkey, CAST(3 AS INTEGER) number, concat('Question 3 {_LONG} ', c_custkey) AS text FROM customer UNION ALL SELECT c_custkey, 4, 'problem 4 {_LONG} end' FROM customer UNION ALL SELECT c_custkey, 9, '9. The {_LONG}' FROM customer""")
def p21_free_response(s: SparkSession, d: str) -> DataFrame:
    text = F.expr(f"concat('AP cover {_LONG}\nQuestion 3 {_LONG} ', c_custkey, '\nGO ON TO THE NEXT PAGE. 3\nproblem 4 {_LONG} end © 2024 College Board. Visit us at collegeboard.org.\nQuestion 5 too short\n9. The {_LONG}')")
    return view(s, d, "customer").select("c_custkey", F.inline(C.free_response(text)))


# ---- items ----

_ITEM = """concat('{"tree": [{"tag": "P", "prompt": "%3Cp%3EWhat is ', p_size, '%3C/p%3E"}, {"tag": "STYLE", "html": "p {}"}, {"kids": {"html": "<i>', p_name, '</i>", "distractors": [{"letter": "A", "content": "<b>one</b> ', p_size, '"}, {"id": 7, "content": "two"}]}}, {"prompt": "What is ', p_size, '"}]}')"""


def _items(s: SparkSession, d: str) -> DataFrame:
    return D.parse_items(_raw(s, d, "part", "string(p_partkey) key", f"{_ITEM} payload"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, concat('What is ', p_size, chr(10), chr(10), p_name) prompt, concat('A=one ', p_size, ';7=two') choices FROM part")
def p22_item_json(s: SparkSession, d: str) -> DataFrame:
    return _items(s, d).select("key", "prompt", F.array_join(F.transform("choices", lambda c: F.concat_ws("=", c["id"], c["text"])), ";").alias("choices"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS key, CASE p_partkey % 3 WHEN 0 THEN concat('Correct: (A) one ', p_size, '; (9)') WHEN 1 THEN 'One point  for this' END answer_key FROM part""")
def p23_rubric_answers(s: SparkSession, d: str) -> DataFrame:
    rubric = F.expr("""case int(key) % 3 when 0 then '{"ScoreGroups": [{"RubricStates": [{"id": "A"}, {"val": "9"}, {}]}, {}]}' when 1 then '{"HumanScoringGuide": " <p>One point <b>for this</p> ", "ScoreGroups": []}' else 'no JSON' end""")
    return _items(s, d).select("key", C.rubric_answer(rubric, F.col("choices")).alias("answer_key"))


@query("""SELECT p_partkey, concat_ws(chr(10) || chr(10), CASE p_size % 3 WHEN 0 THEN p_type WHEN 1 THEN concat(p_type, chr(10), chr(10), 'Find the sum of both numbers', chr(10), '(A) 1', chr(10), '(B) 2') ELSE concat('Find the sum of both numbers', chr(10), '(A) 1', chr(10), '(B) 2') END, CASE WHEN p_size % 2 = 0 THEN 'Number' END) body FROM part""")
def p24_item_bodies(s: SparkSession, d: str) -> DataFrame:
    prompt = F.expr("if(p_size % 3 = 0, 'See', 'Find the sum of both numbers')")
    choices = F.expr("if(p_size % 3 = 0, array('1'), array('(A) 1', '(B) 2'))")
    about = F.expr("case p_size % 3 when 0 then p_type when 1 then p_type else 'both numbers' end")
    return view(s, d, "part").select("p_partkey", C.item_body(prompt, choices, about, F.expr("if(p_size % 2 = 0, 'Number', null)")).alias("body"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_size % 2 = 0 THEN concat('What is ', p_size, ' & why?', chr(10), 'A. one') ELSE concat('Add ', p_size, ' to it.') END question, CASE WHEN p_size % 3 > 0 THEN substr(concat(p_name, ' gets ', repeat('a point ', 70)), 1, 500) END answer_key FROM part""")
def p25_item_pages(s: SparkSession, d: str) -> DataFrame:
    page = """if(p_size % 2 = 0, concat('<img alt="logo"><img alt="Screen shot of an interactive question. QUESTION TEXT: What is ', p_size, ' &amp; why? ANSWER CHOICES: A. one">'), concat('<p>Add  <b>', p_size, '</b> to it.</p>'))"""
    return D.parse_question_pages(_raw(s, d, "part", "string(p_partkey) key", f"{page} payload", "if(p_size % 3 > 0, concat('<p>', p_name, '</p> gets ', repeat('a  point ', 70)), '') guide"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN CAST(p_size AS DOUBLE) / 100 END difficulty FROM part")
def p26_percent_correct(s: SparkSession, d: str) -> DataFrame:
    perf = F.expr("""if(p_size % 4 > 0, concat('{"result": {"series": [{"dataPoints": [{"AxisLabel": "A", "YValues": [1]}]}, {"dataPoints": [{"AxisLabel": "B *", "YValues": [', p_size, ', 3]}, {"AxisLabel": "*", "YValues": [9]}]}]}}'), '{"result": {"series": []}}')""")
    return view(s, d, "part").select("p_partkey", C.percent_correct(perf).alias("difficulty"))


_CODES = sorted({c for values in C.ITEM_TYPES.values() for c in values} | {"zz"})


@query(f"""SELECT p_partkey, code, CASE WHEN code = 'sr' THEN 'multiple_choice' ELSE 'constructed_response' END state, CASE WHEN code IN ('mc', 'sr') THEN 'multiple_choice' ELSE 'constructed_response' END AS national,
CASE WHEN code IN ('mc', 'ms') THEN 'multiple_choice' WHEN code IN ('gi', 'sim') THEN 'performance_task' ELSE 'constructed_response' END consortium, CAST(CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS INTEGER) dok,
CASE p_size % 14 WHEN 4 THEN 'K-5' WHEN 8 THEN '6-8' WHEN 12 THEN '9-12' END national_band, CASE WHEN p_size % 14 IN (3, 4, 5) THEN 'K-5' WHEN p_size % 14 IN (6, 7, 8) THEN '6-8' WHEN p_size % 14 = 10 THEN '9-12' END state_band
FROM (SELECT p_partkey, p_size, {_CODES!r}[1 + p_partkey % {len(_CODES)}] code FROM part)""")
def p27_vocabularies(s: SparkSession, d: str) -> DataFrame:
    c = _raw(s, d, "part", "p_partkey", f"array({', '.join(map(repr, _CODES))})[int(p_partkey % {len(_CODES)})] code", "case p_size % 4 when 0 then 'Low' when 1 then 'Moderate' when 2 then 'high' else 'none' end complexity", "if(p_size % 14 = 13, 'ungraded', string(p_size % 14)) grade")
    bands = [C.tested_band(F.col("grade"), k).alias(f"{k}_band") for k in C.TESTED_GRADES]
    return c.select("p_partkey", "code", *(C.item_type(F.upper("code"), k).alias(k) for k in C.ITEM_TYPES), C.dok_level(F.col("complexity")).alias("dok"), *bands)


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 11 ELSE 3 + p_size % 5 END grade, concat_ws(chr(10), concat('Smarter Balanced Grade ', CASE WHEN p_size % 3 = 0 THEN 11 ELSE 3 + p_size % 5 END, ' Mathematics Assessment Item'), concat('Type: ', p_type), CASE WHEN p_size % 2 = 0 THEN concat('Standard: CCSS.MATH.Content.7.RP.', p_size) END,
CASE WHEN p_size % 4 > 0 THEN concat('Depth of Knowledge: Level ', p_size % 4) END, concat('Claim: ', p_name), concat(chr(10), 'View item: http://x/Item/Details/', p_partkey)) AS content FROM part WHERE p_size % 3 = 0 OR p_size % 5 < 4""")
def p28_catalogue_items(s: SparkSession, d: str) -> DataFrame:
    rows = _raw(s, d, "part", "*", "'Math' as subject", "if(p_size % 3 = 0, 'High School', concat('Grade ', 3 + p_size % 5)) grade_label").unionByName(_raw(s, d, "part", "*", "'ELA' as subject", "'Grade 3' as grade_label"))
    items = C.catalogue_items(rows, [3, 4, 5, 6, 11])
    lines = C.catalogue_lines(F.col("grade"), F.col("p_type"), F.expr("if(p_size % 2 = 0, concat('7.RP.', p_size), null)"), F.lit(""), F.col("p_size") % 4, F.lit(None).cast("string"), F.col("p_name"), F.lit(""), F.expr("concat('http://x/Item/Details/', p_partkey)"))
    return items.select("p_partkey", "grade", lines.alias("content"))


@query("""SELECT concat('u', c_custkey) url, concat('Directions: Use the digits 1 to ', 1 + c_custkey % 9, ' once.', CASE WHEN c_custkey % 2 = 0 THEN concat(chr(10), chr(10), 'Answer/Hint: Think of ', c_custkey) ELSE '' END) AS content, concat('CCSS.MATH.3.OA.', c_custkey % 9, ',CCSS.MATH.HSF.IF.4') standards, CAST(1 + c_custkey % 4 AS INTEGER) dok_level, c_mktsegment AS author,
CASE WHEN c_custkey % 3 = 0 THEN concat('k', c_custkey) ELSE concat('Task ', c_custkey) END title, CASE c_custkey % 5 WHEN 0 THEN 'K' WHEN 1 THEN '1' WHEN 2 THEN '7' WHEN 3 THEN 'HS' ELSE '5' END grade, CASE c_custkey % 5 WHEN 2 THEN '6-8' WHEN 3 THEN '9-12' ELSE 'K-5' END grade_band FROM customer""")
def p29_problem_pages(s: SparkSession, d: str) -> DataFrame:
    """Pages that were fetched twice, and pages without directions."""
    page = """concat('<meta name="keywords" content="F-IF.4, DOK ', 1 + c_custkey % 4, ': x"><nav>Directions: none here at all</nav>', if(c_custkey % 3 = 0, '', concat('<meta property="og:title" content="Task ', c_custkey, ' | Open Middle®">')), '<article class="post', if(c_custkey % 5 = 4, '', concat(' category-', array('kindergarten', 'grade-1', 'grade-7', 'high-school-algebra')[int(c_custkey % 5)], ' category-grade-2')), '"><p>Directions: Use the digits 1 to ', 1 + c_custkey % 9, ' once.</p>', if(c_custkey % 2 = 0, concat('<p>Hint Think of ', c_custkey, '</p>'), ''), '<p>Source: us</p></article><a rel="tag">3.OA.', c_custkey % 9, '</a><a rel="tag">Open Middle</a><a rel="tag">', c_mktsegment, '</a>')"""
    raw = _raw(s, d, "customer", "concat('k', c_custkey) key", "concat('u', c_custkey) url", f"{page} payload", "'grade-5' grade_cat")
    raw = raw.unionByName(raw.withColumn("key", F.concat("key", F.lit("-again")))).unionByName(raw.withColumn("url", F.concat("url", F.lit("x"))).withColumn("payload", F.lit("<article>No task</article>")))
    return D.parse_problems(raw).select("url", "content", F.array_join("standards", ",").alias("standards"), "dok_level", "author", "title", "grade", "grade_band")


@query(r"""SELECT page_id, concat(CASE WHEN page_id % 9 = 2 THEN '2' ELSE concat(least(2, page_id % 9), ',', greatest(2, page_id % 9)) END) numbers, CASE WHEN page_id % 3 = 0 THEN '0.1,1.2' ELSE '1.2' END lessons,
concat('http://m.example/p', page_id, CASE WHEN page_id % 2 = 0 THEN ',http://m.example/q/' ELSE '' END) problems FROM pages""")
def p32_link_harvest(s: SparkSession, d: str) -> DataFrame:
    """Links that are put behind every page, and an index page for each."""
    index = F.expr("""concat('<h2><a href="/menu">x</a></h2><article><h2 class="t"><a class="u" href="/p', page_id, '">A</a></h2><a href="/body">b</a><h3><a href="/no">n</a></h3></article>',
'<ARTICLE id="2"><h2><a href="http://other.example/x">o</a> <a href="/p', page_id, '">again</a></h2>', if(page_id % 2 = 0, "<h2>Q <a href='http://m.example/q/'>q</a></h2>", ''), '</ARTICLE>')""")
    html = F.expr("""concat(coalesce(html, ''), '<a href="/zz/2"><a href="/zz/', page_id % 9, '/x"><a href="/zz/2"><a href="/uu/unit-1/lesson-2"><a href="/uu/unit-', if(page_id % 3 = 0, '0/lesson-1', '1/lesson-2'), '/x">')""")
    pairs = F.array_join(F.transform(C.unit_lessons(html, "/uu"), lambda x: F.concat_ws(".", x["unit"], x["lesson"])), ",")
    return view(s, d, "pages").select("page_id", F.array_join(C.child_numbers(html, "/zz").cast("array<string>"), ",").alias("numbers"), pairs.alias("lessons"), F.array_join(C.problem_links(index, "http://m.example"), ",").alias("problems"))


# ---- load, align, review ----


@query("""SELECT concat('os-b', p_size, '-m', p_partkey, '-expo1') chunk_id, CASE WHEN p_partkey % 2 = 0 THEN concat('os/2026/', p_partkey, '.xml') END snapshot_path FROM part""")
def l4_snapshot_paths(s: SparkSession, d: str) -> DataFrame:
    chunks = _raw(s, d, "part", "concat('os-b', p_size, '-m', p_partkey, '-expo1') chunk_id")
    paths = _raw(s, d, "part", "concat('os-b', p_size, '-m', p_partkey) prefix", "concat('os/2026/', p_partkey, '.xml') path").where("int(split(path, '[/.]')[2]) % 2 = 0")
    return merge.attach_snapshots(chunks, paths).select("chunk_id", "snapshot_path")


@query("""SELECT '2026-01-02' run_date, 'src' source_id, (SELECT count(*) FROM part) chunks, (SELECT concat('[', string_agg(concat('"region ', r_name, '"'), ',' ORDER BY r_name), ']') FROM region) warnings, 1 completed""")
def l10_run_log(s: SparkSession, d: str) -> DataFrame:
    return merge.run_record("src", view(s, d, "part").agg(F.count("*").alias("chunks")), _raw(s, d, "region", "concat('region ', r_name) warning"), run_date="2026-01-02")


@query("""SELECT CASE x.verified_by_human WHEN 1 THEN x.align_id ELSE b.align_id END align_id, x.chunk_id, x.standard_id FROM (SELECT *, CASE WHEN align_id % 13 = 0 THEN 1 ELSE 0 END verified_by_human, row_number() OVER (PARTITION BY chunk_id, standard_id ORDER BY align_id) n FROM fx_alignments_raw) x JOIN
(SELECT *, row_number() OVER (PARTITION BY chunk_id, standard_id ORDER BY CASE alignment_source WHEN 'human' THEN 4 WHEN 'publisher_guide' THEN 3 WHEN 'llm_verified' THEN 2 ELSE 1 END DESC, align_id DESC) n FROM fx_alignments_raw) b USING (chunk_id, standard_id) WHERE x.n = 1 AND b.n = 1""")
def l5_frozen_merge(s: SparkSession, d: str) -> DataFrame:
    """Pairs whose first row a person verified keep it."""
    a = view(s, d, "fx_alignments_raw").withColumn("arrival", F.col("align_id")).withColumn("verified_by_human", F.expr("if(align_id % 13 = 0, 1, 0)"))
    return merge.merge_alignments(a).select("align_id", "chunk_id", "standard_id")


@query("""WITH x AS (SELECT c.vec_id k, s.vec_id std, list_cosine_similarity(c.embedding::DOUBLE[], s.embedding::DOUBLE[]) raw FROM embeddings c, embeddings s WHERE c.label = 1 AND s.label = 2) SELECT concat('v', k) chunk_id, concat('S', std) standard_id, round(raw, 4) alignment_score, raw >= 0.3e0 flagged FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY raw DESC, concat('S', std)) n FROM x WHERE raw >= 0.1e0) WHERE n <= 5""")
def e8_scoped_alignment(s: SparkSession, d: str) -> DataFrame:
    """Chunks of one book against the standards of one system."""
    v = view(s, d, "embeddings")
    chunks = v.selectExpr("concat('v', vec_id) chunk_id", "'t' as title", "'exposition' as content_type", "string(null) grade_band", "concat('book-', label) book_id", "0 as stale")
    standards = v.selectExpr("concat('S', vec_id) standard_id", "concat('sys-', label) as system", "'3' as grade")
    return align.align(chunks, v.selectExpr("concat('v', vec_id) chunk_id", "embedding as vector"), standards, v.selectExpr("concat('S', vec_id) standard_id", "embedding as vector"), threshold=0.1, flag=0.3, system="sys-2", books=["book-1"])


@query("""SELECT align_id, chunk_id, standard_id, CASE WHEN alignment_source = 'embedding' AND alignment_score >= 0.65e0 AND alignment_score < 0.78e0 THEN 1 WHEN align_id % 2 = 0 THEN 1 ELSE 0 END flagged_for_review FROM fx_alignments""")
def v11_flagged_band(s: SparkSession, d: str) -> DataFrame:
    a = view(s, d, "fx_alignments").withColumn("flagged_for_review", F.expr("if(align_id % 2 = 0, 1, null)"))
    return review.flag_band(a).select("align_id", "chunk_id", "standard_id", "flagged_for_review")


# ---- evaluation ----


@query("""WITH t AS (SELECT o_custkey question_id, o_orderkey, concat(substr(concat('Order ', o_orderkey, ' ', repeat('x', 1000)), 1, 900), chr(10), '[', o_orderpriority, ']') AS text, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) SELECT question_id, string_agg(text, chr(10) || chr(10) ORDER BY r) context FROM t WHERE r <= 3 GROUP BY 1""")
def b1_contexts(s: SparkSession, d: str) -> DataFrame:
    w = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    top = view(s, d, "orders").select(F.col("o_custkey").alias("question_id"), w.alias("rank"), F.expr("concat('Order ', o_orderkey, ' ', repeat('x', 1000))").alias("content"), F.col("o_orderpriority").alias("attribution")).where("rank <= 3")
    return evals.context(top)


@query("SELECT standard_id, CASE WHEN std_num % 3 = 0 THEN concat('Standard ', standard_id) ELSE concat(standard_id, ': ', standard_text) END reference FROM fx_standards")
def b1_judge_references(s: SparkSession, d: str) -> DataFrame:
    return evals.judge_reference(_raw(s, d, "fx_standards", "standard_id", "if(std_num % 3 = 0, null, standard_text) standard_text"))


@query("""SELECT standard_id topic, l AS "left", r AS "right", concat(least(l, r), ' ', greatest(l, r)) AS blind, true mixed FROM fx_standards, (VALUES ('content', 'standards'), ('content', 'nothing'), ('standards', 'nothing')) p(l, r)""")
def b2_build_pairs(s: SparkSession, d: str) -> DataFrame:
    """What a judge sees is the pair in either order, and both orders do occur."""
    p = evals.build_pairs(_raw(s, d, "fx_standards", "standard_id as topic"))
    both = p.agg((F.count_if(F.col("a") == F.col("left")) > 0).alias("x"), (F.count_if(F.col("a") == F.col("right")) > 0).alias("y"))
    return p.crossJoin(both).select("topic", "left", "right", F.concat_ws(" ", F.least("a", "b"), F.greatest("a", "b")).alias("blind"), (F.col("x") & F.col("y")).alias("mixed"))


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'content' WHEN 1 THEN 'nothing' WHEN 2 THEN 'tie' END winner FROM conversations""")
def b4_winners(s: SparkSession, d: str) -> DataFrame:
    said = F.expr("case turn % 4 when 0 then 'A' when 1 then 'b, clearly' when 2 then 'It is a tie' else 'unclear' end")
    return view(s, d, "conversations").select("conv_id", "turn", evals.winner(evals.parse_preference(said), F.lit("content"), F.lit("nothing")).alias("winner"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) scenario, o_orderkey % 4 = 3 ok, CASE o_orderkey % 4 WHEN 0 THEN 'tools not called: search' WHEN 1 THEN 'too few calls' WHEN 2 THEN 'phrase missing: ratio' ELSE 'ok' END reason FROM orders""")
def b6_scenarios(s: SparkSession, d: str) -> DataFrame:
    k = "o_orderkey % 4"
    return evals.check_scenarios(_raw(s, d, "orders", "string(o_orderkey) scenario", "array('fetch', 'search') expected_tools", f"if({k} = 0, array('fetch'), array('search', 'fetch')) called_tools", f"if({k} = 1, 3, 1) min_calls", "array('ratio') phrases", f"if({k} = 2, 'no such word', 'A RATIO of both') answer"))


@query("""SELECT count(*) FILTER (doc_id % 5 = 0) a_wins, count(*) FILTER (doc_id % 5 = 1) b_wins, count(*) FILTER (doc_id % 5 IN (2, 3)) ties, count(*) FILTER (quality = 1) a_passed, count(*) FILTER (toxic = 0) b_passed, count(*) n FROM labels""")
def b7_head_to_head(s: SparkSession, d: str) -> DataFrame:
    said = "case doc_id % 5 when 0 then '\n A. it is\nB' when 1 then 'b' when 2 then 'Tie' when 3 then 'unsure' end answer"
    return evals.head_to_head(_raw(s, d, "labels", "quality = 1 as a_ok", "toxic = 0 as b_ok", said))
