"""Reading level of documents.

For every document the smallest frequency-ranked vocabulary is found that covers a fixed share of its
words: words are counted over the whole corpus per language, ranked by frequency (ties share a
rank), and the coverage rank is the rank a reader must know up to. Coverage ranks at several shares,
word length and sentence complexity are calibrated against labelled documents by a ridge
regression whose normal equations are summed in SQL; the level is kept within 1 ... 5. Words a sentence, clauses a sentence and
marks a word flatten for texts that run on (x / (x + typical)); nothing is cut off.

Only prose counts: fenced and inline code, lines with few words for their signs of code, headings' and list
marks and speaker labels of chat exports are taken out first; of other lines only the tokens with such signs. A document with fewer words of prose than
``min_words`` has no level (band 0). The language is the one whose function words are most frequent in
the text; where none occurs, the stated one, else English.

Null and empty texts have band 0. Texts of any length are read whole. Repeated texts count each, in the
corpus as well. Documents rated twice weigh by their mean band. An empty corpus or no labels give no
levels (null).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.operators.ranking import tie_rank
from thicket.session import Scratch

#: Shares of a document's words that the vocabulary has to cover.
COVER = (0.5, 0.75, 0.9, 0.97)
#: Words of a language up to this rank are looked up from memory of each task, the rest by a join.
HEAD = 20_000
#: Words of prose that a document needs to be graded.
MIN_WORDS = 4
#: At most so many labelled documents are used to fit the calibration, chosen by a hash of their id.
MAX_LABELS = 50_000
#: Ridge of the calibration, relative to the number of labels.
RIDGE = 1e-3

#: Frequent function words by which a language is told (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with as are by on this be at not from or an has have which a",
    "de": "der die das und ist nicht den von zu mit auf für ein eine im dem des sich wird als auch es an war hat",
    "fr": "le la les des et est une un du dans que qui pour pas sur au avec ne se ce sont par plus il elle",
    "es": "el la los las de y es una un en que por para no con del se su al lo como más está son fue",
}
#: Words that join or open clauses in the four languages (fixed values).
CLAUSE_WORDS = (
    "although because while whereas when after before unless until which that if insofar notwithstanding provided extent since though "
    "obwohl weil während wohingegen wenn nachdem bevor dass damit sofern ungeachtet indem "
    "bien parce tandis pendant lorsque quand après avant afin puisque quoique alors pourvu "
    "aunque porque mientras cuando después antes siempre puesto obstante"
).split()


#: A line with fewer words than this for every sign of code is code.
WORDS_PER_SIGN = 8
_CODE = "_={}\\|"
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]*`(?: = [\w.]+)?")
_MARK = re.compile(r"\s*(?:#{1,6}\s|[-*+•]\s|\d+[.)]\s|>\s?)?(?:(?:user|assistant|system|tool)\s*:\s)?")
_START = re.compile(r"\s*(?:SELECT|assert|import|def|return)\b|\[")
_END = re.compile(r";\s*$|\):\s*$")
_TOKEN = re.compile(r"\S+")
#: Letters, and apostrophes and hyphens after the first; texts are composed first, so accents are part of letters.
_WORD = re.compile(r"[^\W\d_]+(?:['’-]+[^\W\d_]+)*['’-]*")
_END_MARKS = ".!?…"
_SENTENCE = re.compile(r"[.!?…](?=\s|\Z)")
_ODD_BLANK = re.compile(r"[^\S \n]")
_FUNCTION = {lang: frozenset(s.split()) for lang, s in FUNCTION_WORDS.items()}
_CLAUSE = frozenset(CLAUSE_WORDS)


def prose_of(text: str) -> list[str]:
    """The lines of prose of a text; every step is linear in its length."""
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    if not unicodedata.is_normalized("NFC", t):
        t = unicodedata.normalize("NFC", t)
    if "`" in t:
        t = _INLINE.sub(" ", _FENCE.sub("\n", t))
    out = []
    for line in t.split("\n"):
        line = line[_MARK.match(line).end() :]
        if not line or line.isspace():
            continue
        # marks of code, and a beginning or an end as statements and log lines have it
        signs = sum(map(line.count, _CODE)) + (_START.match(line) is not None) + (_END.search(line[-200:]) is not None)
        if signs:
            if sum(len(w) > 1 for w in _WORD.findall(line)) < WORDS_PER_SIGN * signs:
                continue
            # what is left is prose: only the tokens that are code go
            first = line[:1] == "["
            line = _TOKEN.sub(lambda m: " " if any(c in m[0] for c in _CODE) or (first and not m.start()) else m[0], line)
        out.append(line)
    return out


def words_of(prose: str) -> list[str]:
    return _WORD.findall(prose.lower())


def sentences_of(prose: str) -> int:
    """Ends of sentences (marks before a blank or the end) and of lines; lines are apart by one break."""
    if _ODD_BLANK.search(prose):
        marks = len(_SENTENCE.findall(prose))
    else:
        marks = sum(prose.count(m + " ") + prose.count(m + "\n") for m in _END_MARKS) + prose.endswith(tuple(_END_MARKS))
    return marks + prose.count("\n")


def language_of(counts: dict[str, int], stated: str | None) -> str:
    """en, de, fr or es, by function words; else as stated, else en."""
    hits = {lang: sum(counts.get(w, 0) for w in s) for lang, s in _FUNCTION.items()}
    best = max(hits, key=hits.get)
    if hits[best]:
        return best
    code = (stated or "").strip().lower()[:2]
    return code if code in hits else "en"


def prose(text: Column) -> Column:
    """Lines of prose (array)."""
    return F.pandas_udf(lambda s: s.fillna("").map(prose_of), "array<string>")(text)


def words(text: Column) -> Column:
    """Words of a text (array)."""
    return F.pandas_udf(lambda s: s.fillna("").map(words_of), "array<string>")(text)


def language(all_words: Column, stated: Column) -> Column:
    return F.pandas_udf(lambda w, s: pd.Series([language_of(Counter(a), b) for a, b in zip(w, s)], dtype=object), "string")(all_words, stated)


_MEASURED = "rid long, doc_id long, lang string, n_words long, letters long, long_words long, clauses long, sentences long, marks long, words array<string>, counts array<int>"


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each text is read once: its words are found and counted in one pass, and the measures follow from the counts."""
    for pdf in batches:
        rows = []
        for rid, doc, text, stated in zip(pdf["rid"], pdf["doc_id"], pdf["text"], pdf["stated"]):
            t = "\n".join(prose_of(text)) if isinstance(text, str) else ""
            c = Counter(words_of(t))
            size = {w: len(w) for w in c}
            rows.append((
                rid, doc, language_of(c, stated if isinstance(stated, str) else None), sum(c.values()), sum(size[w] * n for w, n in c.items()), sum(n for w, n in c.items() if size[w] >= 10),
                sum(c[w] for w in _CLAUSE if w in c), max(1, sentences_of(t)), sum(map(t.count, ",;:")), list(c), list(c.values()),
            ))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in _MEASURED.split(", ")]).astype({"doc_id": "Int64"})


def measured(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: language, counts, and the distinct words of its prose with theirs."""
    slim = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").alias("stated"))
    return slim.mapInPandas(_measure, _MEASURED)


def vocabulary(pairs: DataFrame) -> DataFrame:
    """(lang, word, rank) over the whole corpus from (lang, word, n)."""
    counted = pairs.groupBy("lang", "word").agg(F.sum("n").alias("tf"))
    return tie_rank(counted, ["lang"], "tf").select("lang", "word", "rank")


def _covered(head: dict[str, dict[str, int]], cover: tuple[float, ...]):
    """Coverage ranks of each document from the ranks of its words: those in ``head``, the others in (more, more_n)."""

    names = [*[f"cover_{int(c * 100)}" for c in cover], "mean_log_rank", "distinct_words"]

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = len(pdf)
            rank: list[int] = []
            for lang, ws in zip(pdf["lang"], pdf["words"]):
                get = head.get(lang, {}).get
                rank += [get(w, 0) for w in ws]
            each = lambda lists: np.concatenate([np.zeros(0, np.int64), *(np.asarray(v, np.int64) for v in lists)])
            doc = np.repeat(np.arange(size), pdf["words"].map(len).to_numpy(int))
            n, r = each(pdf["counts"]), np.array(rank, np.int64)
            more = pdf["more"].notna().to_numpy()
            if more.any():
                found = pdf[more]
                doc, r, n = np.concatenate([doc, np.repeat(np.flatnonzero(more), found["more"].map(len))]), np.concatenate([r, each(found["more"])]), np.concatenate([n, each(found["more_n"])])
            known = r > 0
            doc, r, n = doc[known], r[known], n[known]
            order = np.lexsort((r, doc))
            doc, r, n = doc[order], r[order], n[order]
            out = pd.DataFrame({c: pd.array([pd.NA] * size, "Int64") for c in names[:-2]} | {"mean_log_rank": np.full(size, np.nan), "distinct_words": np.zeros(size, int)})
            if len(doc):
                start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                at, held = doc[start], np.diff(np.r_[start, len(doc)])
                total = np.add.reduceat(n, start)
                upto = np.cumsum(n)
                share = (upto - np.repeat(upto[start] - n[start], held)) / np.repeat(total, held)
                for c, name in zip(cover, names):
                    below = np.add.reduceat((share < c - 1e-12).astype(int), start)
                    out.loc[at, name] = r[start + np.minimum(below, held - 1)]
                out.loc[at, "mean_log_rank"] = np.add.reduceat(np.log(r) * n, start) / total
                out.loc[at, "distinct_words"] = held
            own = pdf.drop(columns=["rid", "words", "counts", "more", "more_n"]).astype({"doc_id": "Int64"}).reset_index(drop=True)
            yield pd.concat([own, out], axis=1)

    return f


def features(docs: DataFrame, cover: tuple[float, ...] = COVER, head: int = HEAD) -> DataFrame:
    """One row per document: lang, n_words and the numeric features; coverage ranks are null without words.

    Words of a language up to rank ``head`` are looked up in the memory of each task (at most ``head`` for each of four
    languages); only the rarer ones travel to the vocabulary and back to their document.
    """
    scratch = Scratch(docs.sparkSession, "reading")
    m = scratch.save(measured(docs), "measured")
    each = F.explode(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))).alias("e")
    pairs = m.select("rid", "lang", each).select("rid", "lang", "e.word", "e.n")
    vocab = scratch.save(vocabulary(pairs.drop("rid")), "vocabulary")
    top = vocab.where(F.col("rank") <= head).toPandas()
    known = {lang: dict(zip(g["word"], g["rank"].tolist())) for lang, g in top.groupby("lang")}
    tail = vocab.where(F.col("rank") > head)
    item = F.struct("rank", "n")
    far = pairs.join(tail, ["lang", "word"]).groupBy("rid").agg(F.collect_list(item).alias("_f")).select("rid", F.col("_f.rank").alias("more"), F.col("_f.n").alias("more_n"))
    none = F.lit(None).cast("array<long>")
    # nothing to bring back where the heads hold every word
    per = m.withColumns({"more": none, "more_n": none}) if tail.isEmpty() else m.join(far, "rid", "left")
    own = _MEASURED.removeprefix("rid long, ").split(", words ")[0]
    return per.mapInPandas(_covered(known, cover), f"{own}, " + ", ".join(f"cover_{int(c * 100)} long" for c in cover) + ", mean_log_rank double, distinct_words long")


def columns(cover: tuple[float, ...] = COVER) -> dict[str, Column]:
    """The regressors by name, all finite for a document with words."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    # ratios without an end go through x / (x + typical), which flattens where texts run on and cuts nothing off
    flat = lambda x, typical: x / (x + F.lit(float(typical)))
    out = {"one": F.lit(1.0), **{f"l{int(c * 100)}": F.log(F.coalesce(F.col(f"cover_{int(c * 100)}"), F.lit(1)).cast("double")) for c in cover}}
    out["mean"] = F.coalesce("mean_log_rank", F.lit(0.0))
    out["len"] = F.col("letters") / n
    out["long"] = F.col("long_words") / n
    out["sent"] = flat(F.col("n_words") / F.col("sentences"), 20)
    out["clause"] = F.col("clauses") / n
    out["clause_s"] = flat(F.col("clauses") / F.col("sentences"), 1)
    out["marks"] = flat(F.col("marks") / n, 0.1)
    out["mean2"] = F.pow(F.coalesce("mean_log_rank", F.lit(0.0)), 2)
    out["len2"] = F.pow(F.col("letters") / n, 2)
    out["sent_mean"] = out["sent"] * out["mean"]
    for lang in list(FUNCTION_WORDS)[1:]:
        flag = (F.col("lang") == lang).cast("double")
        out |= {f"is_{lang}": flag, f"mean_{lang}": flag * out["mean"], f"len_{lang}": flag * out["len"]}
    return out


def fit(feats: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, min_words: int = MIN_WORDS) -> list[float] | None:
    """Coefficients in the order of ``columns``. The sums of products are one small row."""
    truth = labels.where("band IS NOT NULL").groupBy("doc_id").agg(F.avg("band").alias("y"))
    truth = truth.where("y >= 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    cols = columns()
    known = feats.where(F.col("n_words") >= min_words).join(truth, "doc_id").select("y", *[c.alias(k) for k, c in cols.items()])
    names = list(cols)
    sums = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
    row = known.agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("xx"), F.array(*[F.sum(F.col(a) * F.col("y")) for a in names]).alias("xy")).first()
    if not row["n"]:
        return None
    p = len(names)
    xx = np.zeros((p, p))
    xx[np.triu_indices(p)] = row["xx"]
    xx = xx + np.triu(xx, 1).T
    scale = np.sqrt(np.maximum(np.diag(xx) / row["n"], 1e-12))
    a = xx / row["n"] / np.outer(scale, scale) + RIDGE * np.diag([0.0] + [1.0] * (p - 1))
    beta = np.linalg.solve(a + 1e-12 * np.eye(p), np.array(row["xy"]) / row["n"] / scale) / scale
    return [float(x) for x in beta]


def levels(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, lang, n_words, level, band, coverage ranks, words per sentence); band 0 has no level."""
    feats = Scratch(docs.sparkSession, "levels").save(features(docs), "features")
    beta = fit(feats, labels, max_labels, min_words)
    if beta is None:
        level = F.lit(None).cast("double")
    else:
        level = sum((c * b for c, b in zip(columns().values(), beta)), F.lit(0.0))
        level = F.greatest(F.lit(1.0), F.least(F.lit(5.0), level))
    graded = F.col("n_words") >= min_words
    level = F.when(graded, level)
    out = feats.withColumn("level", level)
    return out.select(
        "doc_id", "lang", "n_words", "level", F.when(~graded, F.lit(0)).otherwise(F.floor(F.col("level") + 0.5)).cast("int").alias("band"),
        *[f"cover_{int(c * 100)}" for c in COVER], (F.col("n_words") / F.col("sentences")).alias("words_per_sentence"),
    )
