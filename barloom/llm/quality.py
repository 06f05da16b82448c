"""Quality rules by distribution divergence (DataFrame functions only).

Each document gets two histograms: of character classes and of common words. They are
compared with the reference of the document's language, which pools the counts of all
documents of that language that pass the base rules, by Jensen-Shannon distance. A histogram of a text below the
minimum length gives no verdict; the limit on words is narrower from `long_hist_words` on.

Defined results: a null text counts as empty; an empty text has no words and fails the base
rules; languages outside REFERENCE_LANGUAGES, and null, share one reference named '*';
repeated rows are each judged; other columns pass through untouched; where one is called
`quality` the result is `_quality` (free_name); a language without a passing document has no
reference and gives no verdict; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE, SPACE, free_name, fresh, materialise, text_of

#: Languages with a reference of their own: bounds the reference table.
REFERENCE_LANGUAGES = ("en", "de", "fr", "es")
#: Frequent function words of those languages (fixed values).
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des",
    "de", "la", "le", "et", "les", "des", "en", "un", "du", "une",
    "que", "el", "y", "los", "se", "del", "las", "por", "con", "para",
)
COMMON_WORDS = tuple(dict.fromkeys(COMMON_WORDS))
#: Character classes beside 'space' and 'other'.
CHAR_CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{Nd}", "mark": r"[^\p{L}\p{M}\p{N}\s]"}
WINDOW = 8


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def _repeated_windows(hashes: str) -> Column:
    """Hashes of all 8-word windows, by doubling: of 1, 2, 4 and 8 words."""
    def joined(col: Column, step: int) -> Column:
        return F.transform(F.array(col), lambda a: F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + step))))[0]

    return joined(joined(joined(F.col(hashes), 1), 2), 4)


def features(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with the base counts and both histograms; the names of the new columns."""
    keys = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "common")
    temps = ("text", "words", "hashes", "windows", "sorted", "starts", "hits")
    names = dict(zip([*keys, *(f"t_{t}" for t in temps)], fresh(docs, *keys, *(f"t_{t}" for t in temps)), strict=True))
    n = names
    c = lambda k: F.col(n[k])
    df = docs.withColumn(n["t_text"], text_of(text_col)).withColumn(n["t_words"], _words(c("t_text")))
    df = df.withColumns({
        n["n_words"]: F.size(c("t_words")).cast("long"),
        n["word_chars"]: F.length(F.array_join(c("t_words"), "")).cast("long"),
        n["n_symbols"]: F.regexp_count(c("t_text"), F.lit(r"[#*$%&|<>]")).cast("long"),
        n["t_hashes"]: F.transform(c("t_words"), lambda w: F.xxhash64(w)),
        n["t_hits"]: F.filter(F.transform(c("t_words"), F.lower), lambda w: w.isin(*COMMON_WORDS)),
    })
    lines = F.filter(F.split(c("t_text"), "\n"), lambda x: x.rlike(NON_SPACE))
    df = df.withColumns({
        n["n_dup_lines"]: F.transform(F.array(lines), lambda a: F.size(a) - F.size(F.array_distinct(a)))[0].cast("long"),
        n["t_windows"]: F.when(c("n_words") > WINDOW, F.slice(_repeated_windows(n["t_hashes"]), F.lit(1), (c("n_words") - (WINDOW - 1)).cast("int"))),
    })
    #: Only texts with some window twice are sorted.
    df = df.withColumn(n["t_sorted"], F.when(F.size(F.array_distinct(c("t_windows"))) < F.size(c("t_windows")), F.sort_array(F.transform(c("t_windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter(c("t_sorted"), lambda e, k: (e.h == F.get(c("t_sorted"), k - 1).h) | (e.h == F.get(c("t_sorted"), k + 1).h))
    df = df.withColumn(n["t_starts"], F.sort_array(F.transform(twice, lambda e: e.i)))
    covered = F.aggregate(
        F.transform(c("t_starts"), lambda p, k: F.coalesce(F.least(F.lit(WINDOW), p - F.get(c("t_starts"), k - 1)), F.lit(WINDOW))),
        F.lit(0), lambda acc, x: acc + x,
    )
    spaces = F.length(c("t_text")) - c("word_chars")
    marks = [F.regexp_count(c("t_text"), F.lit(p)).cast("long") for p in CHAR_CLASSES.values()]
    counts = [F.size(c("t_hits")) - F.size(F.array_remove(c("t_hits"), w)) for w in COMMON_WORDS]
    df = df.withColumns({
        n["n_repeat_words"]: F.coalesce(covered, F.lit(0)).cast("long"),
        n["chars"]: F.array(spaces.cast("long"), *marks),
        n["common"]: F.array(*(x.cast("long") for x in counts)),
    })
    df = df.withColumns({
        n["chars"]: F.concat(c("chars"), F.array(F.length(c("t_text")) - F.aggregate(c("chars"), F.lit(0).cast("long"), lambda a, x: a + x))),
        n["common"]: F.concat(c("common"), F.array(c("n_words") - F.size(c("t_hits")))),
    })
    return df.drop(*(n[f"t_{t}"] for t in temps)), {k: n[k] for k in keys}


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of counts; null if one is all zero."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    share = lambda a: F.transform(a, lambda x: F.try_divide(x.cast("double"), total(a)))
    div = lambda a, b: F.zip_with(a, b, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(total(div(share(p), share(q))), F.lit(0.0)))


def language_references(feats: DataFrame, lang: Column, n: dict[str, str]) -> DataFrame:
    """One row for each reference language: pooled counts of all documents. At most
    len(REFERENCE_LANGUAGES) + 1 rows, whatever the input."""
    sums = [F.sum(F.col(n[k])[i]).alias(f"{k}{i}") for k, size in (("chars", len(CHAR_CLASSES) + 2), ("common", len(COMMON_WORDS) + 1)) for i in range(size)]
    agg = feats.groupBy(lang.alias("ref_lang")).agg(*sums)
    return agg.select(
        "ref_lang",
        F.array(*(F.col(f"chars{i}") for i in range(len(CHAR_CLASSES) + 2))).alias("ref_chars"),
        F.array(*(F.col(f"common{i}") for i in range(len(COMMON_WORDS) + 1))).alias("ref_common"),
    )


def judge(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    *,
    min_words: int = 20,
    max_repeat_percent: int = 30,
    min_chars: int = 200,
    min_hist_words: int = 50,
    max_char_distance: float = 0.27,
    max_word_distance: float = 0.3,
    long_hist_words: int = 75,
    max_long_word_distance: float = 0.25,
    carry: tuple[str, ...] | None = None,
) -> DataFrame:
    """The columns of docs (or those in carry) and a struct column `quality` (or free_name): n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance,
    base_failed, kept. The features are computed once and written to the shared folder;
    the references pool them; a broadcast of at most five rows brings them back."""
    df = docs
    carry = tuple(docs.columns) if carry is None else carry
    feats, n = features(df, text_col)
    (lang,) = fresh(feats, "ref_lang")
    known = F.when(F.col(lang_col).isin(*REFERENCE_LANGUAGES), F.col(lang_col)).otherwise(F.lit("*"))
    feats = materialise(feats.withColumn(lang, known).select(*carry, lang, *n.values()), "quality")
    base_failed = (F.col(n["n_words"]) < min_words) | (100 * F.col(n["n_repeat_words"]) > max_repeat_percent * F.col(n["n_words"]))
    refs = F.broadcast(materialise(language_references(feats.where(~base_failed), F.col(lang), n), "quality-refs").withColumnsRenamed({x: f"{lang}_{x}" for x in ("ref_lang", "ref_chars", "ref_common")}))
    df = feats.join(refs, F.col(lang) == F.col(f"{lang}_ref_lang"), "left")
    long_enough = {"chars": F.col(n["word_chars"]) >= min_chars, "common": F.col(n["n_words"]) >= min_hist_words}
    dist = {k: F.when(long_enough[k], js_distance(F.col(n[k]), F.col(f"{lang}_ref_{k}"))) for k in ("chars", "common")}
    (cd, wd) = fresh(df, "cd", "wd")
    df = df.withColumns({cd: dist["chars"], wd: dist["common"]})
    word_limit = F.when(F.col(n["n_words"]) >= long_hist_words, max_long_word_distance).otherwise(max_word_distance)
    fits = reduce(lambda a, b: a & b, (F.coalesce(F.col(d) <= most, F.lit(True)) for d, most in ((cd, F.lit(max_char_distance)), (wd, word_limit))))
    return df.select(*carry, F.struct(
        *(F.col(n[k]).alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        F.col(cd).alias("char_distance"), F.col(wd).alias("word_distance"),
        base_failed.alias("base_failed"), (~base_failed & fits).alias("kept"),
    ).alias(free_name(docs, "quality", carry)))


def op1_query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    q = judge(table(spark, sf_dir, "documents"), carry=("doc_id",))
    return q.select("doc_id", *(F.col(f"quality.{k}") for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: only kept documents, columns unchanged."""
    name = free_name(docs, "quality")
    return judge(docs).where(f"{name}.kept").drop(name)
