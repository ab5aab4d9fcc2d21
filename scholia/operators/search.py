"""Batch hybrid search: keyword arm (BM25), semantic arm (cosine), reciprocal-rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.standards import part_rank
from scholia.operators.align import cosine_top_k
from scholia.sources.corpus import stored

K1, B = 1.2, 0.75
ARM = 50
FUSE = 60
#: Rows (query, term) that are broadcast, some 40 bytes each.
SENT_TERMS = 200_000
#: Different queries, and their words in all, that a pass over the corpus searches for; queries of more passes are joined by word.
PASS_QUERIES, PASS_TERMS, PASSES = 16_384, 1_000_000, 16
#: Chunks that a task scores at once, and postings at which it stops before.
SHARD, POSTINGS = 4096, 500_000
#: Queries, and pairs (query, chunk) by rare words, of one matrix product; words that one in DENSE chunks holds are in it.
AT_ONCE, RARE, DENSE = 256, 2_000_000, 16
#: Scores are ranked after rounding to 6 places.
SLACK = 2e-6


def terms(text: Column) -> Column:
    """Lower-case word tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times) of queries (query_id, query_text); a repeated term counts as often as it stands."""
    return queries.select("query_id", F.explode(terms(F.col("query_text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def filtered(chunks: DataFrame, *, source: str | None = None, grade_band: str | None = None, content_type: str | None = None, aligned_to: DataFrame | None = None) -> DataFrame:
    """Live chunks under the search filters; `aligned_to` has the chunk_id of chunks aligned to the wanted standard."""
    c = chunks.where("stale = 0")
    for name, value in (("source_id", source), ("grade_band", grade_band), ("content_type", content_type)):
        c = c.where(F.col(name) == value) if value is not None else c
    return c.join(aligned_to.select("chunk_id"), "chunk_id", "left_semi") if aligned_to is not None else c


def postings(terms_of: DataFrame, corpus: DataFrame, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(postings, statistics) of the words of `terms_of` (term) in `corpus` (chunk_id, title, content; by).

    postings: by..., chunk_id, len, term, tf. Only words of the queries leave the scan, dealt by chunk; a table of more than
    SENT_TERMS words is joined by word instead. statistics: by..., n, mean.
    """
    words = corpus.select(*by, "chunk_id", terms(F.concat_ws(" ", "title", "content")).alias("w")).withColumn("len", F.size("w"))
    stats = words.groupBy(*by).agg(F.count("*").alias("n"), (F.sum("len") / F.count("*")).alias("mean"))
    some = terms_of.select("term").distinct()
    few = some.count() <= SENT_TERMS
    found = words.select(*by, "chunk_id", "len", F.explode("w").alias("term")).join(F.broadcast(some) if few else some, "term")
    return (found.repartition("chunk_id") if few else found).groupBy(*by, "chunk_id", "len", "term").agg(F.count("*").alias("tf")), stats


def weighed(posted: DataFrame, stats: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The postings with `part_score`, what one occurrence of the word in a query adds to the score of the chunk (BM25)."""
    df = posted.groupBy(*by, "term").agg(F.count("*").alias("df"))
    # one row, or one for each value of `by`: licence partitions
    terms_of = df.join(F.broadcast(stats), list(by)) if by else df.crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = terms_of.select(*by, "term", idf.alias("idf"), "mean")
    score = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return posted.join(known, [*by, "term"]).select(*by, "chunk_id", "term", score.alias("part_score"))


def split_terms(queries: DataFrame, scored: DataFrame, by: tuple[str, ...] = (), *, limit: int = ARM) -> DataFrame:
    """(by..., query_id, term, times, bound, rest, least, essential): MaxScore's split of each query's words.

    `bound` is the most that the word can add. `least` is a score that `limit` chunks reach for certain: the limit-th best
    that one word of the query alone gives. The words with the smallest bounds, as long as these together (`rest`, up to
    and with the word) stay below `least`, can't bring a chunk among the best by themselves; the others are essential.
    """
    ranked = scored.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "term").orderBy(F.desc("part_score"))))
    top = ranked.where(F.col("_n") <= limit).groupBy(*by, "term").agg(F.max("part_score").alias("most"), F.max(F.when(F.col("_n") == limit, F.col("part_score"))).alias("kth"))
    q = queries.join(top, "term").withColumn("bound", F.col("times") * F.col("most"))
    all_words = Window.partitionBy(*by, "query_id")
    rising = all_words.orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    out = q.withColumn("least", F.coalesce(F.max(F.col("times") * F.col("kth")).over(all_words), F.lit(0.0))).withColumn("rest", F.sum("bound").over(rising))
    # scores are ranked after rounding to 6 places
    out = out.withColumn("essential", F.col("rest") >= F.col("least") - 2e-6)
    other = F.coalesce(F.max(F.when(~F.col("essential"), F.col("rest"))).over(all_words), F.lit(0.0))
    return out.select(*by, "query_id", "term", "times", "bound", "least", other.alias("other"), "essential")


def candidates(split: DataFrame, scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., query_id, chunk_id, partial): chunks with an essential word that can still be among the best."""
    hits = scored.join(split.where("essential"), [*by, "term"])
    partial = hits.groupBy(*by, "query_id", "chunk_id").agg(F.sum(F.col("times") * F.col("part_score")).alias("partial"), F.first("least").alias("least"), F.first("other").alias("other"))
    return partial.where(F.col("partial") + F.col("other") >= F.col("least") - 2e-6).select(*by, "query_id", "chunk_id", "partial")


def joined_hits(q: DataFrame, corpus: DataFrame, allowed: DataFrame | None = None, *, limit: int = ARM, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., query_id, chunk_id, score) of words of queries (`query_terms`), joined by word, the best and others.

    Chunks come up by their essential words only (`split_terms`); the other words, which are the common ones, are looked up
    for the chunks that these leave, so a stop word doesn't pair its queries with its chunks. Postings and the split are
    stored when the plan is made.
    """
    posted, stats = postings(q, corpus, by)
    scored = weighed(posted, stats, by)
    scored = scored.join(allowed.select(*by, "chunk_id"), [*by, "chunk_id"], "left_semi") if allowed is not None else scored
    scored = stored(scored)  # read for bounds, for candidates and for what they lack
    split = stored(split_terms(q, scored, by, limit=limit))
    found = candidates(split, scored, by)
    rest = found.join(split.where("not essential").select(*by, "query_id", "term", "times"), [*by, "query_id"]).join(scored, [*by, "chunk_id", "term"])
    more = rest.groupBy(*by, "query_id", "chunk_id").agg(F.sum(F.col("times") * F.col("part_score")).alias("more"))
    return found.join(more, [*by, "query_id", "chunk_id"], "left").select(*by, "query_id", "chunk_id", F.round(F.col("partial") + F.coalesce("more", F.lit(0.0)), 6).alias("score"))


def _kinds(df: DataFrame, *names: str) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def numbered_postings(corpus: DataFrame, vocabulary: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., chunk_id, len, term, tf): a row of each chunk of `corpus`, with the numbers of its words in `vocabulary`, ascending."""
    sent = corpus.sparkSession.sparkContext.broadcast(pa.array(vocabulary, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            w = b.column(b.num_columns - 1)
            size = pc.list_value_length(w).to_numpy()
            values = w.flatten()
            at = pc.fill_null(pc.index_in(values, value_set=known.cast(values.type)), -1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(w)), size)
            pair, tf = np.unique(row[at >= 0] * len(known) + at[at >= 0], return_counts=True)
            edge = pa.array(np.searchsorted(pair, np.arange(len(w) + 1) * len(known)), pa.int32())
            lists = [pa.ListArray.from_arrays(edge, pa.array(x, pa.int32())) for x in (pair % max(1, len(known)), tf)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(size, pa.int32()), *lists], names=[*by, "chunk_id", "len", "term", "tf"])

    words = corpus.select(*by, "chunk_id", terms(F.concat_ws(" ", "title", "content")).alias("w"))
    return words.mapInArrow(run, f"{_kinds(corpus, *by, 'chunk_id')}, len int, term array<int>, tf array<int>")


def merged_postings(laid: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., chunk_id, size, term, tf) of `numbered_postings`, one row of each chunk. Rows of a repeated chunk_id are one chunk,
    and one document where they have the same length; `size` is the length that belongs to each word."""
    keys = [*by, "chunk_id"]
    one = laid.select(*keys, F.array_repeat("len", F.size("term")).alias("size"), "term", "tf")
    again = laid.where("chunk_id is not null").groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    if again.isEmpty():
        return one
    again = stored(again)
    words = laid.join(again, keys, "left_semi").select(*keys, "len", F.explode(F.arrays_zip("term", "tf")).alias("w"))
    words = words.groupBy(*keys, "len", "w.term").agg(F.sum("w.tf").cast("int").alias("tf")).groupBy(*keys).agg(F.collect_list(F.struct("len", "term", "tf")).alias("w"))
    return one.join(again, keys, "left_anti").unionByName(words.select(*keys, F.col("w.len").alias("size"), "w.term", "w.tf"))


def _document_frequencies(n_by: int):
    """(by..., term, df) of a partition of `merged_postings`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [*b.schema.names[:n_by], "term"]
            lists = b.column(b.schema.get_field_index("term"))
            row = pc.list_parent_indices(lists)
            t = pa.table([*[b.column(i).take(row) for i in range(n_by)], lists.flatten()], names=names)
            yield from t.group_by(names).aggregate([([], "count_all")]).rename_columns([*names, "df"]).to_batches()

    return run


class _Best:
    """The `k` best (score, name) of each of `n` queries."""

    def __init__(self, n: int, k: int):
        self.k, self.names = k, []
        self.q, self.score, self.at = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.kth = np.full(n, -1.0)  # where there are k

    def cut(self, q: np.ndarray, score: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Places of the k best of each query."""
        at = np.lexsort((order, -score, q))
        first = np.searchsorted(q[at], q[at])
        return at[np.arange(len(at)) - first < self.k]

    def take(self, q: np.ndarray, score: np.ndarray, doc: np.ndarray, names: list) -> None:
        """Takes pairs of queries and documents; `names` are those of the documents, ascending."""
        kept = self.cut(q, score, doc)
        used, doc = np.unique(doc[kept], return_inverse=True)
        q, score, at = np.concatenate((self.q, q[kept])), np.concatenate((self.score, score[kept])), np.concatenate((self.at, doc + len(self.names)))
        self.names += [names[i] for i in used.tolist()]
        used, place = np.unique(at, return_inverse=True)
        of = [self.names[i] for i in used.tolist()]
        rank = np.empty(len(of), np.int64)
        rank[sorted(range(len(of)), key=of.__getitem__)] = np.arange(len(of))
        kept = self.cut(q, score, rank[place])
        self.q, self.score = q[kept], score[kept]
        used, self.at = np.unique(place[kept], return_inverse=True)
        self.names = [of[i] for i in used.tolist()]
        last = np.flatnonzero(np.diff(np.append(self.q, -1)))  # by query, best first
        n = np.bincount(self.q, minlength=len(self.kth))[self.q[last]]
        self.kth[self.q[last[n == self.k]]] = self.score[last[n == self.k]]


def _score_shard(doc: np.ndarray, term: np.ndarray, part: np.ndarray, names: list, first: np.ndarray, word: np.ndarray, times: np.ndarray, n_terms: int, best: _Best) -> None:
    """Scores postings (doc, term, part) of documents `names` for queries, whose words lie from `first` on in `word` and `times`."""
    width = len(names)
    by_term = np.argsort(term, kind="stable")
    doc, term, part = doc[by_term], term[by_term], part[by_term]
    count = np.bincount(term, minlength=n_terms)
    start = np.concatenate(([0], np.cumsum(count)))
    often = np.flatnonzero(count * DENSE >= width)
    place = np.full(n_terms, -1)
    place[often] = np.arange(len(often))
    dense = np.zeros((len(often), width))
    held = place[term] >= 0
    np.add.at(dense, (place[term[held]], doc[held]), part[held])
    rare = np.where(place < 0, count, 0)
    pairs = np.concatenate(([0], np.cumsum(rare[word])))[first]
    low = 0
    while low < len(first) - 1:
        high = int(np.searchsorted(pairs, pairs[low] + RARE, "right")) - 1
        high = max(low + 1, min(high, low + AT_ONCE, len(first) - 1))
        some = slice(first[low], first[high])
        t, n = word[some], times[some]
        q = np.repeat(np.arange(high - low), np.diff(first[low : high + 1]))
        w = np.zeros((high - low, len(often)))
        here = place[t] >= 0
        w[q[here], place[t[here]]] = n[here]
        score = w @ dense
        each = rare[t]
        at = np.repeat(start[t] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
        score += np.bincount(np.repeat(q * width, each) + doc[at], part[at] * np.repeat(n, each), (high - low) * width).reshape(high - low, width)
        need = best.kth[low:high] - SLACK
        if width > best.k and (need < 0).any():
            open_ = need < 0
            need[open_] = np.partition(score[open_], width - best.k, axis=1)[:, width - best.k] - SLACK
        hit_q, hit_d = np.nonzero((score > 0) & (score >= need[:, None]))
        if len(hit_q):
            best.take(hit_q + low, np.round(score[hit_q, hit_d], 6), hit_d, names)
        low = high


def _search_pass(idf: dict[tuple, tuple[np.ndarray, np.ndarray, float]], first: np.ndarray, word: np.ndarray, times: np.ndarray, names: list[str], n_terms: int, k: int, schema: list[tuple[str, pa.DataType]]):
    """(by..., key, chunk_id, score): the `k` best of each query in a partition of `merged_postings`. `idf` has for each value
    of `by` its words, their idf and the mean length."""
    n_by = len(schema) - 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, _Best] = {}
        held: dict[tuple, list] = {}
        load = [0, 0]

        def flush() -> None:
            for of, parts in held.items():
                known, value, mean = idf[of]
                weight = np.zeros(n_terms)
                weight[known] = value
                ids = [i for x, *_ in parts for i in x]
                base = np.cumsum([0] + [len(x) for x, *_ in parts])
                order = sorted(range(len(ids)), key=ids.__getitem__)
                rank = np.empty(len(ids), np.int64)
                rank[order] = np.arange(len(ids))
                doc = rank[np.concatenate([d + at for (_, d, *_), at in zip(parts, base, strict=False)])]
                term, tf, size = (np.concatenate([x[i] for x in parts]) for i in (2, 3, 4))
                part = weight[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
                _score_shard(doc, term, part, [ids[i] for i in order], first, word, times, n_terms, best.setdefault(of, _Best(len(names), k)))
            held.clear()
            load[:] = 0, 0

        for b in batches:
            for at in range(0, b.num_rows, SHARD):
                t = pa.table(b.slice(at, SHARD))
                t = t.filter(pc.greater(pc.list_value_length(t["term"]), 0))
                values = list(zip(*(t[i].to_pylist() for i in range(n_by)), strict=True)) if n_by else [()] * len(t)
                for of in dict.fromkeys(values):
                    if None in of:
                        continue
                    some = t.filter(pa.array([x == of for x in values])) if n_by else t
                    term = some["term"].combine_chunks()
                    numbers = [x.combine_chunks().flatten().to_numpy().astype(np.int64) for x in (some["term"], some["tf"], some["size"])]
                    held.setdefault(of, []).append((some["chunk_id"].to_pylist(), pc.list_parent_indices(term).to_numpy(), *numbers))
                    load[0] += len(some)
                    load[1] += len(numbers[0])
                if load[0] >= SHARD or load[1] > POSTINGS:
                    flush()
        flush()
        for of, x in best.items():
            columns = [*([v] * len(x.q) for v in of), [names[i] for i in x.q.tolist()], [x.names[i] for i in x.at.tolist()], x.score]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])

    return run


def searched_hits(different: DataFrame, corpus: DataFrame, allowed: DataFrame | None = None, *, limit: int = ARM, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., key, chunk_id, score), at least the best of queries (key, words: term, times), searched in tasks.

    A row of a chunk has all its words, so a task has the whole score of every pair of its chunks and gives back its own
    `limit` best of each query: no row of a word, or of a pair, is shuffled. Queries go to the tasks in passes of PASS_QUERIES
    and PASS_TERMS; for each the postings of its words are stored when the plan is made, and their frequencies come to the driver.
    """
    spark = corpus.sparkSession
    out, block, size = None, [], 0

    def search(block: list) -> DataFrame:
        vocabulary = sorted({w["term"] for _, words in block for w in words})
        number = {t: i for i, t in enumerate(vocabulary)}
        first = np.cumsum([0] + [len(words) for _, words in block])
        word = np.array([number[w["term"]] for _, words in block for w in words], np.int64)
        times = np.array([w["times"] for _, words in block for w in words], float)
        laid = stored(numbered_postings(corpus, vocabulary, by))
        totals = {tuple(r)[:-2]: (r["n"], r["mean"]) for r in laid.groupBy(*by).agg(F.count("*").alias("n"), (F.sum("len") / F.count("*")).alias("mean")).collect()}
        merged = merged_postings(laid, by)
        df = merged.select(*by, "term").mapInArrow(_document_frequencies(len(by)), f"{_kinds(corpus, *by) + ', ' if by else ''}term int, df long").groupBy(*by, "term").agg(F.sum("df").alias("df"))
        df = df.toArrow()  # of each value of `by` a row of each word of the pass
        rows: dict[tuple, list[int]] = {}
        for i, of in enumerate(zip(*(df[x].to_pylist() for x in by), strict=True) if by else [()] * len(df)):
            rows.setdefault(of, []).append(i)
        known, count = df["term"].to_numpy(), df["df"].to_numpy()
        idf = {of: (known[at], np.log(1 + (totals[of][0] - count[at] + 0.5) / (count[at] + 0.5)), totals[of][1]) for of, at in rows.items()}
        live = merged.where("chunk_id is not null")
        live = live.join(allowed.select(*by, "chunk_id"), [*by, "chunk_id"], "left_semi") if allowed is not None else live
        kinds = f"{_kinds(corpus, *by) + ', ' if by else ''}key string, {_kinds(corpus, 'chunk_id')}, score double"
        arrow = spark.createDataFrame([], kinds).toArrow().schema
        return live.select(*by, "chunk_id", "size", "term", "tf").mapInArrow(_search_pass(idf, first, word, times, [k for k, _ in block], len(vocabulary), limit, [(f.name, f.type) for f in arrow]), kinds)

    for row in different.orderBy("key").toLocalIterator():
        if block and (len(block) == PASS_QUERIES or size + len(row["words"]) > PASS_TERMS):
            part = search(block)
            out, block, size = (part if out is None else out.unionByName(part)), [], 0
        block.append((row["key"], row["words"]))
        size += len(row["words"])
    part = search(block)
    return part if out is None else out.unionByName(part)


def keyword_hits(queries: DataFrame, corpus: DataFrame, allowed: DataFrame | None = None, *, limit: int = ARM, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., query_id, chunk_id, score, rank): the best of BM25 over title and content of `corpus` (chunk_id, title, content).

    Statistics are those of the whole corpus, with `by` of each of its partitions, all in one plan. Queries of the same words
    are searched once. `allowed` restricts what may be a hit before the limit; chunks without an id are none. Scores are
    rounded to 6 places before they are ranked, so that the order of sums doesn't matter. Queries of up to PASSES passes are
    searched in tasks (`searched_hits`), more are joined by word (`joined_hits`).
    """
    q = query_terms(queries)
    words = F.sort_array(F.collect_list(F.struct("term", "times")))
    text = F.array_join(F.transform("words", lambda w: F.concat_ws(":", w["term"], w["times"])), " ")
    asked = stored(q.groupBy("query_id").agg(words.alias("words")).withColumn("key", F.md5(text)))
    different = asked.groupBy("key").agg(F.first("words").alias("words"))
    many = different.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("words")).first()
    if max(many["n"] / PASS_QUERIES, many["words"] / PASS_TERMS) <= PASSES:
        found = searched_hits(different, corpus, allowed, limit=limit, by=by)
    else:
        found = joined_hits(different.select(F.col("key").alias("query_id"), F.inline("words")), corpus, allowed, limit=limit, by=by).withColumnRenamed("query_id", "key")
    w = Window.partitionBy(*by, "key").orderBy(F.desc("score"), "chunk_id")
    top = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return asked.select("query_id", "key").join(top, "key").select(*by, "query_id", "chunk_id", "score", "rank")


def semantic_hits(query_vectors: DataFrame, chunk_vectors: DataFrame, allowed: DataFrame | None = None, *, limit: int = ARM, by: str | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank) by cosine, with `by` in each partition of `allowed`. Queries (id, vector) are the
    side that a task scores whole batches of; chunks (id, vector) are filtered before anything is scored."""
    c = chunk_vectors
    if allowed is not None:
        c = c.join(allowed.select(F.col("chunk_id").alias("id"), by), "id") if by else c.join(allowed.select(F.col("chunk_id").alias("id")), "id", "left_semi")
    found = cosine_top_k(query_vectors, c, k=limit, threshold=-2.0, by=by).selectExpr(*([by] if by else []), "left_id as query_id", "right_id as chunk_id", "round(score, 6) score")
    w = Window.partitionBy(*([by] if by else []), "query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def fuse(*arms: DataFrame, by: tuple[str, ...] = ("query_id",), k: int = FUSE) -> DataFrame:
    """(by..., chunk_id, score, rank) of rankings (by..., chunk_id, rank): the sum of 1 / (k + rank)."""
    keys = [*by, "chunk_id"]
    u = arms[0].select(*keys, "rank")
    for a in arms[1:]:
        u = u.unionByName(a.select(*keys, "rank"))
    s = u.groupBy(*keys).agg(F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 9).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "chunk_id")))


def hybrid_search(queries: DataFrame, chunks: DataFrame, *, query_vectors: DataFrame | None = None, chunk_vectors: DataFrame | None = None, limit: int = 5, **filters) -> DataFrame:
    """(query_id, rank, chunk_id, part, score, mode) of queries (query_id, query_text); one without words has the mode
    empty_query and no chunk. Each partition's arms are fused, partitions are put one after the other, and their places
    are scored once more, so that an id in two partitions gains; with one partition its own order stands."""
    allowed = filtered(chunks, **filters)
    mode = "hybrid" if query_vectors is not None else "keyword_fallback"
    part = ("part",)
    arm = keyword_hits(queries, chunks, allowed, by=part)
    if query_vectors is not None:
        arm = fuse(arm, semantic_hits(query_vectors, chunk_vectors, allowed, by="part"), by=("query_id", "part"))
    placed = arm.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(part_rank(F.col("part")), "part", "rank")))
    # one partition's own scores stand; places in several are scored once more
    several = F.broadcast(chunks.agg((F.min("part") < F.max("part")).alias("several")))
    again = F.round(F.sum(F.lit(1.0) / (FUSE + F.col("place"))), 9)
    lists = placed.groupBy("query_id", "chunk_id").agg(F.min_by("part", "place").alias("part"), again.alias("again"), F.min_by("score", "place").alias("own"))
    lists = lists.crossJoin(several).withColumn("score", F.when(F.col("several"), F.col("again")).otherwise(F.col("own")))
    lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
    top = lists.where(F.col("rank") <= limit).select("query_id", "rank", "chunk_id", "part", "score", F.lit(mode).alias("mode"))
    empty = queries.where((F.size(terms(F.coalesce("query_text", F.lit("")))) == 0))
    return top.unionByName(empty.selectExpr("query_id", "1 as rank", "string(null) chunk_id", "string(null) part", "double(null) score", "'empty_query' as mode"))
