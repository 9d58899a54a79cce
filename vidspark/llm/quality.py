"""Quality rules: repetition limits and distribution divergence, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh, written

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A text with fewer words, or fewer characters in words, is too short for the divergence to tell anything.
JUDGED_WORDS = 50
JUDGED_CHARS = 200
MAX_CLASS_DIVERGENCE = 0.09
MAX_WORD_DIVERGENCE = 0.08
#: What the words of a short text differ from their language by chance falls with their number; so much over n_words is allowed.
WORD_ALLOWANCE = 4.0

# Frequent function words of the languages that are told apart, one list a language.
COMMON_WORDS = {
    "de": ["auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "in", "ist", "mit", "nicht", "sich", "und", "von", "zu"],
    "en": ["a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"],
    "es": ["con", "de", "del", "el", "en", "es", "la", "las", "los", "no", "para", "por", "que", "se", "su", "un", "una", "y"],
    "fr": ["au", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une"],
}
WORDS = sorted({w for words in COMMON_WORDS.values() for w in words})

_WHITE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Words of a text: longest runs without space and U+0009 to U+000D; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _WHITE), lambda w: w != "")


def with_repeated_window_words(docs: DataFrame, words: str, out: str, window: int = WINDOW) -> DataFrame:
    """Adds how many words lie in a window of that many words that the text holds twice or more.

    Windows are hashed; only texts with fewer different windows than windows sort them, each with its place, and
    add up what equal neighbours cover. Each step is a column, so that none is computed twice or again for
    every element of a later one.
    """
    w = F.col(words)
    wins = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - window + 1, F.lit(0))), lambda x, i: F.xxhash64(F.slice(w, i + 1, F.lit(window))))
    docs = docs.withColumn("_wins", wins)
    sort = F.sort_array(F.transform("_wins", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    docs = docs.withColumn("_pairs", F.when(F.size(F.array_distinct("_wins")) < F.size("_wins"), sort))
    docs = docs.withColumn("_keys", F.transform("_pairs", lambda x: x["h"])).withColumn("_places", F.transform("_pairs", lambda x: x["p"]))
    key = F.col("_keys")
    tied = F.transform("_places", lambda p, i: F.when((F.get(key, i + 1) == F.get(key, i)) | ((i > 0) & (F.get(key, i - 1) == F.get(key, i))), p))
    docs = docs.withColumn("_tied", F.array_sort(F.filter(tied, lambda p: p.isNotNull())))
    covered = F.aggregate(
        "_tied",
        F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(window), p - s["last"])).alias("n"), p.alias("last")),
        lambda s: s["n"].cast("long"),
    )
    return docs.withColumn(out, F.coalesce(covered, F.lit(0).cast("long")))


def _left_over(text: Column, classes: str) -> Column:
    return F.length(F.regexp_replace(text, classes, ""))


def class_histogram(text: Column, packed: Column) -> Column:
    """Bytes of a text by class: white space, digits, ASCII capitals, sentence marks, other ASCII marks, continuation bytes of UTF-8, all others.

    packed: the text without white space.
    """
    size = F.length(packed)
    parts = [
        F.length(text) - size,
        size - _left_over(packed, "[0-9]+"),
        size - _left_over(packed, "[A-Z]+"),
        size - _left_over(packed, r"[.,;:!?'\"()\-]+"),
        size - _left_over(packed, r"[\x00-\x1F#$%&*+/<=>@\[\\\]^_`{|}~\x7F]+"),
        F.octet_length(packed) - size,
    ]
    return F.array(*[p.cast("double") for p in parts], size.cast("double"))


def with_word_histogram(docs: DataFrame, words: str, lang: str, out: str) -> DataFrame:
    """Adds the counts of each common word of a document's language (of all, if it has no list), and of all other words."""

    def chosen(of) -> Column:
        case = None
        for code, listed in COMMON_WORDS.items():
            case = F.when(F.col(lang) == code, of(listed)) if case is None else case.when(F.col(lang) == code, of(listed))
        return case.otherwise(of(WORDS))

    docs = docs.withColumn("_common", chosen(lambda listed: F.filter(words, lambda w: w.isin(listed))))
    n = F.size("_common")
    return docs.withColumn(out, chosen(lambda listed: F.array(*[(n - F.size(F.array_remove("_common", w))).cast("double") for w in listed], (F.size(words) - n).cast("double"))))


def shares(counts: Column) -> Column:
    """A histogram as shares of its sum."""
    return F.aggregate(counts, F.lit(0.0), lambda a, b: a + b, lambda total: F.transform(counts, lambda x: F.try_divide(x, total)))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of two lists of shares, in bits (0 to 1); null if either is of nothing."""

    def term(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).when(y >= 0, 0.0)

    return F.aggregate(F.zip_with(p, q, lambda a, b: term(a, b) + term(b, a)), F.lit(0.0), lambda a, b: a + b) / 2


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame) -> DataFrame:
    """text and lang (if there), COUNTS, _lang, the histograms _classes and _wordy, and all other columns as the struct _others; in one pass."""
    named = [c for c in ("text", "lang") if c in docs.columns]
    others = [c for c in docs.columns if c not in (*named, *COUNTS)]
    out = docs.select(*named, F.struct(*others, F.lit(0).alias(fresh("_none", others))).alias("_others"), _language(docs).alias("_lang"))
    out = out.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("_words", words_of(F.col("_text")))
    out = with_word_histogram(out.withColumn("_packed", F.array_join("_words", "")), "_words", "_lang", "_wordy")
    out = out.withColumn("_classes", class_histogram(F.col("_text"), F.col("_packed")))
    lines = F.filter(F.split("_text", "\n", -1), lambda line: F.length(F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    out = out.withColumn("n_words", F.size("_words").cast("long")).withColumn("word_chars", F.length("_packed").cast("long"))
    out = out.withColumn("n_symbols", (F.length("_packed") - _left_over(F.col("_packed"), "[#*$%&|<>]+")).cast("long"))
    out = out.withColumn("_lines", lines).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    out = with_repeated_window_words(out, "_words", "n_repeat_words")
    return out.select(*named, "_others", *COUNTS, "_lang", "_classes", "_wordy")


def language_references(measured: DataFrame) -> DataFrame:
    """Per language: shares of the summed histograms of all its documents that are long enough to be judged.

    Repeated rows count each. A language without a document of that length, and an empty table, have no row, so nothing is judged by them; documents without language are one language.
    """
    some = measured.filter(F.col("n_words") >= JUDGED_WORDS)
    total = lambda name, n: F.array(*[F.coalesce(F.sum(F.get(name, F.lit(i))), F.lit(0.0)) for i in range(n)])
    sums = some.groupBy("_lang").agg(total("_classes", 7).alias("_a"), F.slice(total("_wordy", len(WORDS) + 1), F.lit(1), F.max(F.size("_wordy"))).alias("_b"))
    return sums.select("_lang", shares(F.col("_a")).alias("_ref_classes"), shares(F.col("_b")).alias("_ref_words"))


def _language(docs: DataFrame) -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")


def judge(measured: DataFrame, references: DataFrame) -> DataFrame:
    """Adds base_failed, kept, class_divergence and word_divergence to what ``measure`` gives, and takes its help columns off."""
    keep = [c for c in measured.columns if c not in ("_lang", "_classes", "_wordy")]
    out = measured.join(references, "_lang", "left")
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    out = out.withColumn("_p", shares(F.col("_classes"))).withColumn("_q", shares(F.col("_wordy")))
    out = out.withColumn("class_divergence", divergence(F.col("_p"), F.col("_ref_classes"))).withColumn("word_divergence", divergence(F.col("_q"), F.col("_ref_words")))
    judged = (F.col("n_words") >= JUDGED_WORDS) & (F.col("word_chars") >= JUDGED_CHARS)
    odd = (F.coalesce("class_divergence", F.lit(0.0)) > MAX_CLASS_DIVERGENCE) | (F.coalesce("word_divergence", F.lit(0.0)) > MAX_WORD_DIVERGENCE + WORD_ALLOWANCE / F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~(judged & odd)).select(*keep, *VERDICT)


VERDICT = ("base_failed", "kept", "class_divergence", "word_divergence")


def quality(docs: DataFrame, references: DataFrame | None = None, keep_text: bool = True) -> DataFrame:
    """``docs`` with counts, divergences and verdict.

    Adds n_words, word_chars, n_symbols (of ``#*$%&|<>``), n_dup_lines (lines with a word that equal an earlier
    line), n_repeat_words (words in windows of five that the text holds twice or more), base_failed, kept, and
    class_divergence and word_divergence: Jensen-Shannon divergences of the text's histograms of character
    classes and of common words from those of its language.

    base_failed: fewer than MIN_WORDS words, or more than MAX_REPEAT_PERCENT of them repeated. kept: not
    base_failed, and neither divergence over its limit (for words plus WORD_ALLOWANCE / n_words); texts under
    JUDGED_WORDS words or JUDGED_CHARS characters in words are not judged by them. A language's reference is
    all its documents (``language_references``), or what is given.

    The measured rows are written once, as both the references and the verdicts need them; without keep_text
    the texts are not written and not returned.

    Null and empty texts have no words and fail. Null languages are one language; without a column lang all
    documents are. Texts of any length are judged whole. Repeated rows are judged each for itself. An
    empty table stays empty. Columns named as the new ones are replaced, all others are kept.
    """
    docs = docs.drop(*COUNTS, *VERDICT)
    measured = measure(docs)
    measured = written(measured if keep_text else measured.drop("text"), "measured")
    judged = judge(measured, references if references is not None else written(language_references(measured), "references"))
    keep = [F.col(c) if c in ("text", "lang") else F.col("_others").getField(c).alias(c) for c in docs.columns if keep_text or c != "text"]
    return judged.select(*keep, *COUNTS, *VERDICT)


def drop_low_quality(docs: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """The documents that ``quality`` keeps, with their own columns.

    A plain filter would be pushed below the steps that compute its verdict, with all of them written out in it
    again and again; a row that is repeated once or not at all is not.
    """
    own = F.struct(*docs.columns).alias("_row")
    judged = quality(docs.select(own, F.col("text"), *([F.col("lang")] if "lang" in docs.columns else [])), references, keep_text=False)
    return judged.select(F.inline(F.array_repeat("_row", F.when(F.col("kept"), 1).otherwise(0))))
