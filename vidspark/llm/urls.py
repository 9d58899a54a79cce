"""URL filters: rules first, then the ratio of two character language models, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import fresh, written

#: Characters of context at most.
ORDER = 3
#: A context that a model has seen fewer times gives way to a shorter one.
MIN_SEEN = 5
#: Characters that a model may meet: the symbols of ``symbols`` and the end.
ALPHABET = 37
#: Mean scores, in thousandths, are told apart up to this on either side of 0 when the threshold is chosen.
MOST_SCORE = 5000
#: First hex digits of the md5 of a URL by which rule-decided pages are held out for the threshold: three in sixteen.
HELD_OUT = "012"

_BITS = 128
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path); the production rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end. Without ``://`` both are empty."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    part = lambda k: F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k)
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, written as host and path, and its verdict; null if none does. A rule fits its host and what is below it, if the path starts with the rule's."""
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def symbols(text: Column) -> Column:
    """What the models see of host and path: a-z, 0 for any digit, seven marks, ? for all else."""
    return F.regexp_replace(F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[0-9]", "0"), r"[^a-z0./_%:~-]", "?")


def with_grams(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Adds each character with the ORDER before it as a number, one for each character and the end. Linear in the text: whole lists are put beside each other, none is looked into for each character."""
    each = F.when(F.col(text) != "", F.transform(F.split(text, ""), F.ascii)).otherwise(F.array().cast("array<int>"))
    codes, n = F.concat(F.array_repeat(F.lit(1), ORDER), each, F.array(F.lit(2))), F.length(text) + 1
    value = F.slice(codes, F.lit(1), n)
    for k in range(1, ORDER + 1):
        value = F.zip_with(value, F.slice(codes, F.lit(k + 1), n), lambda v, c: v * _BITS + c)
    return rows.withColumn(out, value)


def gram_scores(counts: DataFrame) -> DataFrame:
    """gram, score: a thousand times the logarithm of how much likelier the accepted URLs' model holds the character after its context than that of the rejected ones.

    counts: gram, allowed, blocked. Each order mixes its own counts with the order below (Witten and Bell: a context counts as many
    new characters as it has seen different ones), down to a uniform one. There is a row for each gram of the corpus, so 38^4, two million, at most.
    """
    names = ("allowed", "blocked")
    below = None
    for k in range(ORDER + 1):
        grams = counts.groupBy(F.expr(f"gram % {_BITS ** (k + 1)}").alias("gram")).agg(*[F.sum(n).alias(n) for n in names]).withColumn("context", F.expr(f"gram div {_BITS}"))
        seen = [F.sum(n).alias(f"{n}_seen") for n in names] + [F.sum((F.col(n) > 0).cast("long")).alias(f"{n}_kinds") for n in names]
        rows = grams.join(grams.groupBy("context").agg(*seen), "context")
        if below is None:
            rows = rows.withColumns({f"{n}_below": F.lit(1.0 / ALPHABET) for n in names})
        else:
            rows = rows.withColumn("shorter", F.expr(f"gram % {_BITS**k}")).join(below, "shorter")
        mixed = [
            F.when(F.col(f"{n}_seen") >= MIN_SEEN, (F.col(n) + F.col(f"{n}_kinds") * F.col(f"{n}_below")) / (F.col(f"{n}_seen") + F.col(f"{n}_kinds"))).otherwise(F.col(f"{n}_below")).alias(f"{n}_below") for n in names
        ]
        below = rows.select(F.col("gram").alias("shorter"), *mixed)
    return below.select(F.col("shorter").alias("gram"), F.floor(1000 * (F.ln("allowed_below") - F.ln("blocked_below"))).alias("score"))


def _means(rows: DataFrame, grams: str, scores: DataFrame, key: list[str]) -> DataFrame:
    """key and the mean score of the grams of its rows, in whole thousandths; rows of one key have equal grams.

    Grams are added up where they are made, and only with their key, so a row a key and task moves however long a text is; the scores are broadcast (two million at most).
    """
    each = rows.select(*key, F.explode(grams).alias("gram")).join(F.broadcast(scores), "gram")
    return each.groupBy(*key).agg(F.floor(F.sum("score") / F.count("*")).alias("_mean"))


def threshold(held: DataFrame) -> int:
    """The least mean score that is accepted: where the shares of held-out pages that are rightly accepted and rightly rejected add up to most, as near to 0 as that leaves it.

    held: verdict and _mean of each page. 0 if either verdict has no page. Its bins are 10,001 at most.
    """
    at = F.greatest(F.least(F.col("_mean"), F.lit(MOST_SCORE)), F.lit(-MOST_SCORE)).alias("at")
    bins = held.groupBy(at).agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b"))
    every, upto = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.desc("at"))
    low = F.lead("at").over(upto) + 1  # from here to "at" all accept the same
    sums = bins.select(F.when(F.col("at") <= 0, F.col("at")).otherwise(F.greatest(low, F.lit(0))).alias("at"), F.sum("a").over(upto).alias("a_from"), F.sum("b").over(upto).alias("b_from"), F.sum("a").over(every).alias("a"), F.sum("b").over(every).alias("b"))
    gain = F.col("a_from") * F.col("b") + (F.col("b") - F.col("b_from")) * F.col("a")
    best = sums.filter("a > 0 and b > 0").select("at", gain.cast("decimal(38,0)").alias("gain")).orderBy(F.desc("gain"), F.abs("at"), "at").limit(1).collect()
    return int(best[0].at) if best else 0


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` (url, and any other columns) with host, path, rule, verdict and url_score.

    A rule's verdict stands. What no rule decides is judged by two variable-order Markov models of characters, of the URLs
    that rules accept and those that they reject: the difference of their log-likelihoods over the number of characters (url_score, in whole
    thousandths; null where a rule decides) is held against a threshold that is calibrated on rule-decided pages held out from both
    models. Models and threshold come from all pages, by sums alone.

    Null urls and those without ``://`` have empty host and path, which no rule fits; they are judged by the end alone. Very long
    urls are read whole. Repeated rows count each. Without rule-decided pages every score is 0 and all are accepted. An empty table
    stays empty. Columns named as the new ones are replaced, all others are kept; rows that no rule decides move with them once, to where the mean of
    their text is (a text that very many rows have is split by adaptive execution, as means have one row a text), so select what is needed.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "url_score")
    names = pages.columns
    text, grams, held, key = (fresh(c, names) for c in ("_text", "_grams", "_held", "_key"))
    host, path = host_and_path(F.col("url"))
    rows = pages.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict, text: symbols(F.concat("host", "path")), held: F.md5(F.coalesce(F.col("url").cast("string"), F.lit(""))).substr(1, 1).isin(list(HELD_OUT))})
    rows = rows.withColumn(key, F.sha1(text))
    judged = with_grams(rows.select("verdict", held, text, key), text, grams)
    trained = lambda said: F.count_if(F.equal_null("verdict", F.lit(said)) & ~F.col(held))
    counts = judged.select("verdict", held, F.explode(grams).alias("gram")).groupBy("gram").agg(trained("allow").alias("allowed"), trained("block").alias("blocked"))
    scores = written(gram_scores(written(counts, "grams")), "scores")
    held_out = judged.filter(F.col("verdict").isNotNull() & F.col(held))
    least = threshold(held_out.select("verdict", key).join(_means(held_out, grams, scores, [key]), key))
    decided = rows.filter(F.col("verdict").isNotNull()).select(*names, "host", "path", "rule", "verdict", F.lit(None).cast("long").alias("url_score"))
    means = _means(judged.filter(F.col("verdict").isNull()), grams, scores, [key])
    said = F.when(F.col("_mean") >= least, "allow").otherwise("block")
    open_ = rows.filter(F.col("verdict").isNull()).drop("verdict").join(means, key)
    return decided.unionByName(open_.select(*names, "host", "path", "rule", said.alias("verdict"), F.col("_mean").alias("url_score")))
