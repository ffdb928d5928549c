"""Reading level of each document (problem 8): coverage rank in a frequency-ranked vocabulary, and sentence complexity, in SQL.

The words of the whole corpus are ranked by frequency. A document's coverage rank at a share s is the size of the smallest
frequency-ranked vocabulary that holds a share s of its words. Together with the sentences' complexity it is
calibrated on the levels people gave: the sums of a least-squares fit are one SQL aggregate, and its result is one expression.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunklake.session import merged, stage

LEAST_WORDS = 20
SHARES = (0.5, 0.75, 0.9, 0.97)
#: Levels 4 and 5 are advanced.
ADVANCED = 4
#: The most frequent strings, at most so many, are broadcast to the documents; the others are merged.
HEAD = 100_000
#: Frequencies below this are joined by broadcast (one row each), those above by merging.
COMMON = 10_000
#: Where the border between level k and k + 1 may lie, as parts of the way.
_BORDERS = tuple(round(0.2 + 0.05 * i, 2) for i in range(13))
_MARKUP = r"<[^<>]{1,200}>|&#?[A-Za-z0-9]{1,10};|https?://\S+"
_UNSEEN = r"[\p{Mn}\p{Cf}]"
_BLANKS = r"[\p{Z}\p{Cc}]+"
#: A sentence ends with a mark that is followed by a blank or the end, or with a line break.
_SENTENCE = r"(?<=[.!?])[\"')\]]*\s+|[\r\n]+"
#: A word is a string between blanks, with other marks around it at most.
_WORD = r"^[^\p{L}\p{N}]*+(\p{L}++(?:['’-]\p{L}++)*+)[^\p{L}\p{N}]*+$"


def _prose(documents: DataFrame, ident: str, text: str, lang: str | None) -> DataFrame:
    """Each document's strings between blanks, and its sentences' number and longest one (characters); `row` tells rows apart."""
    t = F.col(text)
    # The patterns run only where they can match: most texts have no markup, and plain ASCII no unseen characters.
    plain = F.when(t.contains("<") | t.contains("&") | t.contains("http"), F.regexp_replace(t, _MARKUP, " \n ")).otherwise(t)
    seen = F.when(F.octet_length("plain") == F.length("plain"), F.col("plain")).otherwise(F.regexp_replace("plain", _UNSEEN, ""))
    language = F.lower(F.substring(F.col(lang), 1, 2)) if lang else F.lit("en")
    return (
        documents.select(F.monotonically_increasing_id().alias("row"), F.col(ident).cast("long").alias("doc_id"), language.eqNullSafe("en").alias("en"), plain.alias("plain"))
        .select("row", "doc_id", "en", seen.alias("t"))
        .select("row", "doc_id", "en", F.split("t", _BLANKS).alias("strings"), F.transform(F.split("t", _SENTENCE), lambda x: F.length(F.trim(x))).alias("s"))
        .select("row", "doc_id", "en", "strings", F.greatest(F.size(F.filter("s", lambda x: x > 1)), F.lit(1)).alias("sentences"), F.array_max("s").alias("longest"))
    )


def _at_least(counts: DataFrame, n: str = "n") -> DataFrame:
    """(n, rank): how many rows of counts have at least that n. There are at most about the square root of twice the sum of n such rows."""
    return counts.groupBy(n).agg(F.count(F.lit(1)).alias("_rows")).select(n, F.sum("_rows").over(Window.orderBy(F.col(n).desc())).alias("rank"))


def vocabulary(prose: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(head, tail), both (string, rank, english, letters, marks, named): what each string between blanks says of its document.

    rank is the number of words at least as frequent as the string's word, null where it is no word; english tells whether the
    word is more frequent in documents marked English than the corpus's words on average; letters is the word's length,
    marks the number of commas and the like, named whether a letter or digit is in it. Frequencies are counted over all documents.

    The patterns run once for each different string, not for each occurrence. The rank needs no sort of all words: it comes from the
    number of words at each frequency. head holds the most frequent strings, at most HEAD; tail is None where these are all.
    """
    counts = stage(
        prose.select("en", F.explode("strings").alias("string"))
        .groupBy("string")
        .agg(F.count(F.lit(1)).alias("times"), F.count(F.when(F.col("en"), 1)).alias("times_en"))
        .select("string", "times", "times_en", F.nullif(F.regexp_extract(F.lower("string"), _WORD, 1), F.lit("")).alias("word")),
        "strings",
    )
    words = stage(counts.filter("word is not null").groupBy("word").agg(F.sum("times").alias("n"), F.sum("times_en").alias("en")), "words")
    steps = stage(_at_least(words), "steps")
    # Rare frequencies hold most words, but are few numbers; the others are many numbers with few words each.
    ranked = words.filter(F.col("n") < COMMON).join(F.broadcast(steps.filter(F.col("n") < COMMON)), "n").unionByName(words.filter(F.col("n") >= COMMON).join(merged(steps.filter(F.col("n") >= COMMON)), "n"))
    all_n, all_en = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("en"), F.lit(0))).first()
    prior = float(np.log((all_en + 1) / (all_n - all_en + 1)))
    odds = F.log((F.col("en") + 0.5) / (F.col("n") - F.col("en") + 0.5)) - F.lit(prior)
    known = ranked.select("word", "rank", (odds > 0).alias("english"))
    marks = F.length("string") - F.length(F.translate("string", ",;:", ""))
    said = stage(
        counts.join(merged(known), "word", "left").select("string", "times", "rank", "english", F.length("word").alias("letters"), marks.alias("marks"), F.col("string").rlike(r"[\p{L}\p{N}]").alias("named")),
        "said",
    )
    least = _at_least(said, "times").filter(F.col("rank") <= HEAD).agg(F.min("times"), F.max("rank")).first()
    head = said.filter(F.col("times") >= (least[0] if least[0] is not None else 1 << 62)).drop("times")
    if (least[1] or 0) == said.count():
        return head, None
    return head, said.filter(F.col("times") < (least[0] if least[0] is not None else 1 << 62)).drop("times")


def measures(documents: DataFrame, ident: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """One row for each row: word counts, coverage ranks cover_50 .. and sentence complexity; without words all but words is null."""
    # Cut into strings once; the vocabulary and the documents both read the written strings.
    prose = stage(_prose(documents, ident, text, lang), "prose")
    head, tail = vocabulary(prose)
    own = ["row", "doc_id", "sentences", "longest"]
    each = prose.select(*own, F.explode("strings").alias("string"))
    # At most HEAD strings are broadcast, and hold most occurrences; no string of the tail is frequent, so that merging has no hot key.
    found = each.join(F.broadcast(head), "string")
    if tail is not None:
        found = found.unionByName(each.join(F.broadcast(head.select("string")), "string", "left_anti").join(merged(tail), "string"))
    # The strings of a row lie together, so that they are folded to one row before they are shuffled by row.
    folded = found.groupBy(*own).agg(
        F.sort_array(F.collect_list("rank")).alias("ranks"),
        F.count("rank").alias("words"),
        F.count(F.when(F.col("named"), 1)).alias("named"),
        F.avg(F.col("english").cast("double")).alias("english"),
        F.avg("letters").alias("letters"),
        F.avg((F.col("letters") > 9).cast("double")).alias("long_words"),
        F.avg(F.log("rank")).alias("mean_log_rank"),
        (F.sum("marks") + 1).alias("clauses"),
    )
    at = lambda s: F.try_element_at("ranks", F.greatest(F.ceil(F.size("ranks") * F.lit(s)), F.lit(1)).cast("int"))
    some = F.nullif("words", F.lit(0))
    full = folded.select(
        "doc_id",
        F.col("words").cast("int").alias("words"),
        (F.col("words") / F.greatest("named", "words", F.lit(1))).alias("prose_share"),
        "english",
        *[F.log(at(s).cast("double")).alias(f"cover_{round(100 * s)}") for s in SHARES],
        "mean_log_rank",
        "letters",
        "long_words",
        F.log(some / F.col("sentences")).alias("log_sentence"),
        F.log(F.greatest("longest", F.lit(1))).alias("log_longest"),
        (F.col("clauses") / some).alias("clause_share"),
    )
    none = prose.filter("coalesce(size(strings), 0) <= 0").select("doc_id", F.lit(0).alias("words"))
    return full.unionByName(none, allowMissingColumns=True)


FEATURES = (*(f"cover_{round(100 * s)}" for s in SHARES), "mean_log_rank", "letters", "long_words", "log_sentence", "log_longest", "clause_share")


#: The fit's terms, each the list of the features it multiplies: one, the features, and their products by twos.
_POWERS = ((), *((i,) for i in range(len(FEATURES))), *((i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))))


def _product(i: int, j: int) -> tuple[int, ...]:
    """The features that the product of two terms multiplies: many pairs of terms have the same."""
    return tuple(sorted(_POWERS[i] + _POWERS[j]))


def _terms() -> list[Column]:
    return [math.prod((F.col(FEATURES[i]) for i in p), start=F.lit(1.0)) for p in _POWERS]


def labelled(measured: DataFrame, labels: DataFrame, ident: str = "doc_id", level: str = "read_level") -> DataFrame:
    """The features of all labelled documents with words, and y, their level (the mean, where a document has several)."""
    y = labels.filter(F.col(level).between(1, 5)).groupBy(F.col(ident).cast("long").alias("doc_id")).agg(F.avg(level).alias("y"))
    return stage(measured.filter("words > 0").join(merged(y), "doc_id").select("y", *FEATURES), "labelled")


def calibrate(rows: DataFrame) -> list[float]:
    """Weights of the terms by least squares on all labels.

    Each labelled row becomes one number for each product of features that the normal equations need, and one aggregate sums
    them: 1,067 sums, whatever the number of labels. Without labels all weights are 0, so the level is 0.
    """
    k, place = len(_POWERS), {}
    for i in range(k):
        for j in range(i, k):
            place.setdefault(_product(i, j), (len(place), i, j))
    pairs = [(i, j) for _, i, j in place.values()] + [(i, k) for i in range(k)]
    left, right = (F.array(*[F.lit(p[side]) for p in pairs]) for side in (0, 1))
    products = F.zip_with(left, right, lambda i, j: F.get("x", i) * F.get("x", j))
    x = F.array(*_terms(), F.col("y"))
    sums = rows.select(x.alias("x")).select(F.posexplode(products).alias("no", "v")).groupBy("no").agg(F.sum("v").alias("v")).collect()
    if not sums:
        return [0.0] * k
    total = dict(sums)
    a = np.array([[total[place[_product(i, j)][0]] for j in range(k)] for i in range(k)])
    b = np.array([total[len(place) + i] for i in range(k)])
    scale = 1 / np.sqrt(np.maximum(np.diag(a), 1e-12))
    # A prior of fixed strength, which a few hundred labels need and which many outweigh; a[0, 0] is the number of labels.
    w = np.linalg.solve(a * scale[:, None] * scale + (0.01 / a[0, 0]) * np.eye(k), b * scale) * scale
    return [float(v) for v in w]


def _score(weights: list[float]) -> Column:
    return sum((F.lit(v) * t for v, t in zip(weights[1:], _terms()[1:])), F.lit(weights[0]))


def borders(rows: DataFrame, weights: list[float]) -> list[float]:
    """The scores where level k ends and k + 1 begins: least squares draws scores to the middle, so that half-way isn't best.

    One aggregate counts the labels of each level in steps of a twentieth of the score, at most 605 rows; of equally good
    places the mean is taken. Without labels the borders lie half-way.
    """
    step = F.least(F.greatest(F.floor(_score(weights) * 20), F.lit(0)), F.lit(120)).cast("int")
    counts = np.zeros((121, 5), dtype=np.int64)
    for r in rows.groupBy(step.alias("step"), F.least(F.greatest(F.ceil(F.col("y") - 0.5), F.lit(1)), F.lit(5)).cast("int").alias("level")).count().collect():
        counts[r["step"], r["level"] - 1] = r["count"]
    out = []
    for k in range(1, 5):
        at = [round(20 * (k + b)) for b in _BORDERS]
        right = [int(counts[:i, :k].sum() + counts[i:, k:].sum()) for i in at]
        best = [b for b, c in zip(_BORDERS, right) if c == max(right)]
        out.append(k + sum(best) / len(best))
    return out


def reading_levels(documents: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """(doc_id, words, prose_share, english, coverage_rank, words_a_sentence, score, level, is_prose), one row for each row.

    coverage_rank is the smallest frequency-ranked vocabulary that holds 90 % of the document's words. score is the
    calibrated level as a number within 1 to 5, level the whole one by the calibrated borders. is_prose: English prose of at least 20 words,
    whatever `lang` says (most words are English by the corpus's own odds, and most strings are words). score and level are
    null elsewhere: for null, empty and blank texts, lists of codes, other languages. Repeated rows each get their row.
    """
    measured = stage(measures(documents, ident, text, lang), "measures")
    known = labelled(measured, labels)
    w = calibrate(known)
    raw = _score(w)
    cuts = borders(known, w)
    prose = (F.col("words") >= LEAST_WORDS) & (F.col("prose_share") >= 0.6) & (F.col("english") >= 0.6)
    score = F.when(prose, F.greatest(F.lit(1.0), F.least(F.lit(5.0), raw)))
    whole = F.when(prose, F.lit(1) + sum((F.when(raw >= c, 1).otherwise(0) for c in cuts), F.lit(0)))
    return measured.select(
        "doc_id",
        F.col("words").cast("int").alias("words"),
        "prose_share",
        "english",
        F.round(F.exp("cover_90")).cast("long").alias("coverage_rank"),
        F.exp("log_sentence").alias("words_a_sentence"),
        score.alias("score"),
        whole.cast("int").alias("level"),
        F.coalesce(prose, F.lit(False)).alias("is_prose"),
    )


def advanced(levels: DataFrame, least: int = ADVANCED) -> DataFrame:
    """(doc_id) of the English prose of level 4 or 5."""
    return levels.filter(F.col("is_prose") & (F.col("level") >= least)).select("doc_id").distinct()


def level_profile(levels: DataFrame, documents: DataFrame, by: str = "source", ident: str = "doc_id") -> DataFrame:
    """(by, level, documents, mean_words, mean_coverage_rank) for English prose."""
    group = documents.select(F.col(ident).cast("long").alias("doc_id"), F.lower(by).alias(by)).dropDuplicates(["doc_id"])
    return levels.filter("is_prose").join(merged(group), "doc_id").groupBy(by, "level").agg(F.count(F.lit(1)).alias("documents"), F.avg("words").alias("mean_words"), F.avg("coverage_rank").alias("mean_coverage_rank"))
