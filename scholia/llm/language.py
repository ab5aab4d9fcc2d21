"""Language of whole texts by cross-parsing entropy.

For each language a suffix automaton holds a bounded sample of labelled text. A text is parsed greedily into the longest
phrases that occur in that sample; with c phrases and a sample of n letters the cross-entropy is c * log2(n) bits, and
the language that needs the fewest wins. All texts of a batch are parsed in step: one table look-up moves every (piece,
language) by one letter, so the cost for a letter does not depend on how long the phrases are. Texts are cut into pieces
for that, and the parse is carried over from piece to piece, so the counts are those of whole texts.

Only letters count, in lower case; what is between them is one separator. The sample is bounded by `SAMPLE_ROWS` rows and
`SAMPLE_CHARS` letters for each language and `TABLE_CHARS` in all; the rows that are labelled and not held out
(crc32 of doc_id as text, modulo 4, is not 2) are dealt to `SAMPLE_ROWS` buckets of a language by a hash of doc_id, each
of which gives one row.

Defined results: a text that is null or has no letter is `und` with score 0, as is every text if there is nothing to learn
from; ties go to the language that is first by code point; a row without doc_id is not held out and not learned from;
repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.textvec import slices, tidy

SAMPLE_ROWS = 96
SAMPLE_CHARS = 12_000
TABLE_CHARS = 400_000
MAX_LANGUAGES = 500
PIECE = 1024
#: Bytes of text parsed in step.
STEP_BYTES = 2 << 20
#: Own classes of letters; rarer ones share 32 by blocks of code points.
LETTERS = 95


@lru_cache(1)
def _lowered() -> np.ndarray:
    """For each code point that of its lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            out[c] = ord(s.lower()[0])
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


@dataclass
class Model:
    languages: list[str]
    classes: np.ndarray  # of each code point; 0: no letter
    table: np.ndarray  # [state * width + class] -> (next state * width) << 1 | whether a phrase begins
    roots: np.ndarray
    bits: np.ndarray  # log2 of the sample's length
    width: int


def _automaton(seq: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in seq:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def _collapse(codes: np.ndarray) -> np.ndarray:
    """Without all but the first of neighbouring separators."""
    if not len(codes):
        return codes
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep]


def fit(samples: dict[str, list[str]], sample_chars: int = SAMPLE_CHARS, table_chars: int = TABLE_CHARS) -> Model | None:
    """Learns from texts by language."""
    most = min(sample_chars, table_chars // max(1, len(samples)))
    low = _lowered()
    texts = {k: np.concatenate([np.append(low[_points(t)], 0) for t in v]) for k, v in samples.items() if v}
    texts = {k: t for k, t in texts.items() if t.any()}
    if not texts:
        return None
    seen = Counter()
    for t in texts.values():
        for c, n in zip(*np.unique(t[t > 0], return_counts=True), strict=True):
            seen[int(c)] += int(n)
    own = {c: i + 1 for i, c in enumerate(sorted(sorted(seen), key=lambda c: -seen[c])[:LETTERS])}
    shared = len(own) + 1
    classes = np.where(low > 0, shared + (low >> 7) % 32, 0).astype(np.uint8)
    for c, k in own.items():
        classes[low == c] = k
    width = shared + 32
    languages, tables, roots, bits, base = sorted(texts), [], [], [], 0
    for lang in languages:
        seq = _collapse(classes[texts[lang]])[:most].tolist()
        nxt = _automaton(seq)
        t = np.zeros((len(nxt), width), np.int64)
        start = np.full(width, base, np.int64)
        for c, s in nxt[0].items():
            start[c] = base + s
        t[:] = start * width << 1 | 1
        for s, move in enumerate(nxt[1:], 1):
            for c, to in move.items():
                t[s, c] = (base + to) * width << 1
        tables.append(t.ravel())
        roots.append(base * width << 1)
        bits.append(np.log2(max(2, len(seq))))
        base += len(nxt)
    table = np.concatenate(tables)
    return Model(languages, classes, table.astype(np.int32) if table.max() < 2**31 else table, np.array(roots), np.array(bits), width)


def phrases(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """[text, language] number of phrases; whether each text has a letter."""
    codes = [_collapse(model.classes[_points(t)]) if t else np.empty(0, np.uint8) for t in texts]
    letters = np.array([bool(c.any()) for c in codes], bool)
    owner, cuts = [], []
    for i, c in enumerate(codes):
        if letters[i]:
            for at in range(0, len(c), PIECE):
                owner.append(i)
                cuts.append(c[at : at + PIECE])
    out = np.zeros((len(texts), len(model.languages)), np.int64)
    if not cuts:
        return out, letters
    size = np.array([len(c) for c in cuts])
    order = np.argsort(-size, kind="stable")
    size = size[order]
    grid = np.zeros((int(size[0]), len(cuts)), np.uint8)
    for k, j in enumerate(order):
        grid[: size[k], k] = cuts[j]
    state = np.repeat(model.roots[:, None], len(cuts), 1)
    count = np.zeros(state.shape, np.int32)
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # pieces with more than t letters
    for t in range(int(size[0])):
        n = int(active[t])
        at = state[:, :n] >> 1
        at += grid[t, :n]
        v = model.table.take(at)
        count[:, :n] += (v & 1).astype(np.int32)
        state[:, :n] = v
    place = np.argsort(order)
    count = count[:, place]
    _carry(model, cuts, np.array(owner), state[:, place] >> 1 << 1, count)
    np.add.at(out, np.array(owner), count.T)
    return out, letters


def _carry(model: Model, cuts: list[np.ndarray], owner: np.ndarray, end: np.ndarray, count: np.ndarray) -> None:
    """Makes the counts of pieces, each parsed from its own start, those of whole texts.

    A piece is parsed again from where the piece before it ended, beside the parse from its own start, until both are in
    the same state, mostly after a few phrases. Where they never meet, what follows is parsed letter by letter.
    """
    later = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    size = np.array([len(c) for c in cuts])
    some = later
    own, true = np.repeat(model.roots[:, None], len(some), 1), end[:, some - 1].copy()
    more, ended = count.copy(), end.copy()
    letters = np.zeros((PIECE, len(some)), np.uint8)
    for k, i in enumerate(some):
        letters[: size[i], k] = cuts[i]
    for t in range(PIECE):
        if t % 8 == 0:
            open_ = (own != true).any(0)
            some, own, true, letters = some[open_], own[:, open_], true[:, open_], letters[:, open_]
        live = size[some] > t
        if not live.all():
            ended[:, some[~live]] = true[:, ~live]
            some, own, true, letters = some[live], own[:, live], true[:, live], letters[:, live]
        if not len(some):
            break
        a, b = model.table.take((own >> 1) + letters[t]), model.table.take((true >> 1) + letters[t])
        more[:, some] += (b & 1).astype(np.int32) - (a & 1).astype(np.int32)
        own, true = a >> 1 << 1, b >> 1 << 1
    ended[:, some] = true
    for k in range(len(end)):
        last = ended[k].copy()
        for i in later[ended[k, later - 1] != end[k, later - 1]]:
            while i < len(cuts) and owner[i] == owner[i - 1] and last[i - 1] != end[k, i - 1]:
                at, n = int(last[i - 1]), 0
                for c in cuts[i].tolist():
                    v = int(model.table[(at >> 1) + c])
                    n += v & 1
                    at = v >> 1 << 1
                done = at == last[i]
                more[k, i], last[i] = n, at
                if done:
                    break
                i += 1
    count[:] = more


def _label(model: Model | None, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value if hasattr(model, "value") else model
        for b in batches:
            pred: list[str] = []
            score: list[float] = []
            for _, raw in slices(b.column(b.schema.get_field_index("text")), STEP_BYTES):
                if m is None:
                    pred += ["und"] * len(raw)
                    score += [0.0] * len(raw)
                    continue
                count, letters = phrases(m, [t.decode() if t else None for t in raw])
                need = count * m.bits
                best = need.argmin(1)
                p = 1 / np.exp2(-(need - need.min(1, keepdims=True)) / 8).sum(1)
                pred += [m.languages[k] if ok else "und" for k, ok in zip(best, letters, strict=True)]
                score += [float(s) if ok else 0.0 for s, ok in zip(p, letters, strict=True)]
            kept = [i for i, n in enumerate(b.schema.names) if n not in names]
            yield pa.record_batch([b.column(i) for i in kept] + [pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[b.schema.names[i] for i in kept] + list(names))

    return tidy(run)


def held_out(remainder: int = 2, modulus: int = 4) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def learn(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model | None:
    """A model from `docs` (doc_id, text, lang). Ids of the sample are found without reading texts; the collected sample is
    bounded by the parameters."""
    spark = docs.sparkSession
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    # one row of each of a language's buckets, by an aggregate: no task has all rows of a language
    bucket = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(sample_rows)).cast("int").alias("k")
    some = labelled.groupBy("lang", bucket).agg(F.min_by("doc_id", F.xxhash64("doc_id")).alias("doc_id"))
    ids = some.limit(sample_rows * MAX_LANGUAGES + 1).collect()
    if len(ids) > sample_rows * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not ids:
        return None
    wanted = F.broadcast(spark.createDataFrame([(r["doc_id"], r["lang"], r["k"]) for r in ids], "doc_id long, lang string, k int"))
    # the letters of a row's share of the sample, from a place that its id sets
    share = max(200, 2 * sample_chars // sample_rows)
    text = F.expr(f"substring(text, cast(1 + pmod(xxhash64(doc_id), greatest(1, length(text) - {share})) as int), {share})")
    got = docs.select("doc_id", "lang", "text").join(wanted, ["doc_id", "lang"]).where("text is not null").groupBy("lang", "k").agg(F.min(text).alias("text")).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["k"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return fit(samples, sample_chars)


def identify_languages(docs: DataFrame, model: Model | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`docs` (any columns, with text) with the language and its score under `names`; columns of these names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model) if model is not None else None
    kept = [f for f in docs.schema.fields if f.name not in names]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(_label(sent, names), f"{ddl}, `{names[0]}` string, `{names[1]}` double")


def language_id(docs: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of `docs` (doc_id, text, lang), learned from those not held out."""
    out = identify_languages(docs.select("doc_id", "text"), learn(docs, **bounds))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
