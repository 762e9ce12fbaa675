"""Themes and tone of written answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import let

#: English words without a topic, words of good and bad feeling, and words that turn a feeling round.
STOP = (
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by can can't cannot could "
    "couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't have haven't having he he'd he'll he's her "
    "here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor "
    "not of off on once only or other ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that that's "
    "the their theirs them themselves then there there's these they they'd they'll they're they've this those through to too under until up very was wasn't we "
    "we'd we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's with won't would wouldn't you you'd you'll "
    "you're you've your yours yourself yourselves also just get got really will one would like much many lot lots even still well make made thing things way bit quite"
).split()
POSITIVE = (
    "good great excellent amazing awesome love loved lovely nice friendly helpful fast quick easy clean fresh tasty delicious perfect happy pleased recommend "
    "wonderful fantastic best brilliant comfortable reliable kind polite efficient enjoyed enjoy fun beautiful smooth convenient affordable cheap fair satisfied "
    "impressive welcoming warm professional quality"
).split()
NEGATIVE = (
    "bad poor terrible awful horrible slow rude dirty cold expensive overpriced broken late wrong hate hated disappointed disappointing worst difficult hard "
    "confusing noisy crowded unfriendly unhelpful bland stale long waiting wait problem problems issue issues complaint missing never mess messy annoying buggy "
    "crash crashed small tiny unclear useless"
).split()
FEELING_ONLY = (
    "good great excellent amazing awesome love loved lovely nice perfect wonderful fantastic best brilliant bad poor terrible awful horrible worst hate hated "
    "disappointing disappointed happy pleased satisfied"
).split()
NEGATIONS = ("not", "no", "never", "n't", "hardly", "barely", "don't", "didn't", "wasn't", "isn't", "aren't", "won't", "couldn't")
# Fixed pattern: usual English endings.
ENDINGS = "(ingly|edly|ing|ed|es|s|ly)$"
MOST_THEMES = 15


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and apostrophes."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), "’", "'"), F.lit(r"([\p{L}\p{N}']+)"), F.lit(1))


def stem(word: Column) -> Column:
    """A word without its usual English ending; short words stay."""
    cut = F.when(word.rlike("ies$"), F.regexp_replace(word, "ies$", "y")).otherwise(F.regexp_replace(word, ENDINGS, ""))
    bare = F.regexp_replace(F.regexp_replace(cut, r"(.)\1$", "$1"), "e$", "")
    return F.when(F.length(word) <= 4, word).when(bare == "", word).otherwise(bare)


def _among(c: Column, fixed) -> Column:
    return c.isin(*fixed)


def tone(text: Column) -> Column:
    """1, 0 or -1: the sign of the good words less the bad ones, each turned round by a negation one or two words before.

    The words are taken once a text: named within the function of each word, they would be taken anew for every word.
    """

    def total(w: Column) -> Column:
        before = lambda i, k: F.coalesce(F.get(w, i - k), F.lit(""))

        def value(x: Column, i: Column) -> Column:
            flip = F.when(_among(before(i, 1), NEGATIONS) | _among(before(i, 2), NEGATIONS), -1).otherwise(1)
            return F.when(_among(x, POSITIVE), flip).when(_among(x, NEGATIVE), -flip).otherwise(0)

        return F.aggregate(F.transform(w, value), F.lit(0), lambda a, b: a + b)

    return F.coalesce(F.signum(let(words(text), total).cast("double")).cast("int"), F.lit(0))


def answered(df: DataFrame, column: str) -> DataFrame:
    c = F.col(f"`{column}`")
    return df.where(c.isNotNull() & (F.trim(c) != ""))


def tones(df: DataFrame, column: str) -> DataFrame:
    """(tone, n) of all written answers."""
    return answered(df, column).groupBy(tone(F.col(f"`{column}`")).alias("tone")).agg(F.count("*").alias("n"))


def mentions(df: DataFrame, column: str) -> DataFrame:
    """(term, phrase, n, shown): stems of words and pairs of neighbouring words with the number of answers that hold them.

    ``shown`` is the most frequent form. Each answer counts a term once, within its own row, so nothing is grouped by
    answer.
    """
    held = answered(df, column).select(words(F.col(f"`{column}`")).alias("w"))
    topic = lambda x: ~_among(x, STOP) & (F.length(x) > 2) & ~x.rlike(r"^\d+$")
    kept = held.select(F.filter("w", lambda x: (F.length(x) > 1) & ~x.rlike(r"^\d+$")).alias("w"))
    single = kept.select(F.explode(F.array_distinct(F.transform(F.filter("w", topic), lambda x: F.struct(stem(x).alias("term"), x.alias("form"))))).alias("t"))
    stems = kept.select(F.explode(F.array_distinct(F.transform(F.filter("w", topic), stem))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    forms = single.groupBy("t.term", "t.form").agg(F.count("*").alias("k"))
    shown = forms.groupBy("term").agg(F.max_by("form", F.struct("k", "form")).alias("shown"))
    pairs = F.zip_with("w", F.slice("w", 2, 1 << 30), lambda a, b: F.when(~_among(a, STOP) & ~_among(b, STOP) & (F.length(a) > 2) & (F.length(b) > 2), F.concat(a, F.lit(" "), b)))
    phrases = kept.select(F.explode(F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    words_of = stems.join(shown, "term").select("term", F.lit(False).alias("phrase"), "n", "shown")
    return words_of.unionByName(phrases.select("term", F.lit(True).alias("phrase"), "n", F.col("term").alias("shown")))


def themes(df: DataFrame, column: str, most: int = MOST_THEMES) -> DataFrame:
    """(theme, phrase, n, share): the most mentioned topics.

    A term needs three answers, two below 20 answers. A word gives way to a phrase with it that has four fifths of its
    answers; words of mere feeling are no topics.
    """
    answers = answered(df, column).count()
    if answers < 3:
        raise ValueError(f"{column} has only {answers} written answers; themes need at least 3.")
    found = mentions(df, column).where(F.col("n") >= (3 if answers >= 20 else 2))
    inside = found.where("phrase").select(F.explode(F.split("term", " ")).alias("w"), F.col("n").alias("m"))
    best = inside.groupBy("w").agg(F.max("m").alias("m"))
    joined = found.join(best, (F.col("shown") == F.col("w")) & ~F.col("phrase"), "left")
    topic = F.col("phrase") | (F.coalesce(F.col("m"), F.lit(0)) < 0.8 * F.col("n")) & ~_among(F.col("shown"), FEELING_ONLY)
    first = joined.where(topic).orderBy(F.desc("n"), F.desc("phrase"), "shown").limit(most)
    return first.select(F.col("shown").alias("theme"), "phrase", "n", (F.col("n") / answers).alias("share"))
