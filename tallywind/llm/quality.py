"""Quality rules by weak supervision.

Every rule votes for a document (1), against it (-1) or abstains (0). Nobody knows the rules' accuracies; they are
estimated by expectation-maximisation from how the votes agree. The only thing this needs from the corpus is how often
each combination of votes occurs: at most 3 ^ rules rows, counted over all documents. The posterior probability that a
document is good then decides, instead of "every rule must pass".
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywind.llm.tables import land, row_key, space_words

#: Frequent function words of the languages that the rules know.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "was", "for", "with", "der", "die", "und", "den", "von", "das", "ist", "mit",
    "de", "la", "que", "el", "en", "los", "las", "del", "le", "les", "et", "des", "une", "est", "du", "un",
)


@dataclass(frozen=True)
class Rule:
    """SQL conditions over the columns of `add_features`: `good` votes for, else `bad` votes against, else it abstains."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("length", "n_words >= 50", "n_words < 10"),
    Rule("word_length", "word_chars BETWEEN 3 * n_words AND 10 * n_words", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "20 * n_dup_lines <= n_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("repeated_words", "20 * n_repeat_words <= n_words", "5 * n_repeat_words > n_words"),
    Rule("case", "10 * n_upper <= n_letters", "2 * n_upper > n_letters"),
    Rule("letters", "10 * n_letters >= 9 * word_chars", "10 * n_letters < 8 * word_chars"),
    Rule("plain_words", "20 * n_odd_words <= n_words", "10 * n_odd_words > n_words"),
    Rule("stop_words", "n_stop_words >= 3", "n_words >= 20 AND n_stop_words = 0"),
    Rule("distinct_words", "3 * n_distinct_words >= n_words OR n_distinct_words >= 200", "10 * n_distinct_words < n_words"),
    Rule("exclamations", "100 * n_exclamations <= n_words", "5 * n_exclamations > n_words"),
)

#: Words in a repeated window.
REPEAT = 5


def add_features(documents: DataFrame) -> DataFrame:
    """`doc` (the row as it was) and the counts that rules use, of every whole text. Null text counts as empty.

    Repeated windows are found inside the row: windows become 64-bit hashes; only if some are equal are they sorted
    together with their places to find the words that repeated windows cover.
    """
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    rows = documents.select(F.struct("*").alias("doc")).select("doc", text.alias("text"), space_words(text).alias("words"))
    rows = rows.withColumns({
        "n_words": F.size("words").cast("long"),
        "joined": F.array_join("words", ""),
        "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "windows": F.expr(
            f"CASE WHEN size(words) >= {REPEAT} THEN transform(sequence(1, size(words) - {REPEAT - 1}), i -> xxhash64(slice(words, i, {REPEAT})))"
            " ELSE cast(array() AS array<bigint>) END"
        ),
    })
    placed = F.expr("array_sort(transform(windows, (h, i) -> struct(h AS h, i AS i)))")
    rows = rows.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed))
    again = F.expr(
        """array_sort(transform(filter(placed, (x, k) -> (k > 0 AND placed[k - 1].h = x.h)
            OR (k < size(placed) - 1 AND placed[k + 1].h = x.h)), x -> x.i))"""
    )
    rows = rows.withColumn("again", F.when(F.col("placed").isNotNull(), again))
    covered = F.expr(
        f"""aggregate(again, struct(0L AS n, -1 AS past), (a, i) -> struct(
            a.n + i + {REPEAT} - greatest(i, a.past) AS n, i + {REPEAT} AS past), a -> a.n)"""
    )
    return rows.select(
        "doc",
        "n_words",
        F.length("joined").cast("long").alias("word_chars"),
        (F.length("joined") - F.length(F.regexp_replace("joined", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("joined", r"[^\p{L}\p{N}]+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("joined", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.size(F.array_intersect(F.array(*map(F.lit, STOP_WORDS)), "words")).cast("long").alias("n_stop_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        F.size(F.filter("words", lambda w: w.rlike(r"^[^\p{L}\p{N}]+$|[#*$%&|<>!]$"))).cast("long").alias("n_odd_words"),
        (F.length("joined") - F.length(F.regexp_replace("joined", "!+", ""))).cast("long").alias("n_exclamations"),
    )


def vote(features: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds `votes`, one digit a rule in base 3: 0 against, 1 abstains, 2 for."""
    digits = [
        f"(CASE WHEN {rule.good} THEN 2 WHEN {rule.bad} THEN 0 ELSE 1 END) * {3 ** k}L" for k, rule in enumerate(rules)
    ]
    return features.withColumn("votes", F.expr(" + ".join(digits)))


def base_failed() -> Column:
    """Fewer than ten words, or over a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def fit(voted: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = 40, prior: float = 0.8) -> DataFrame:
    """`votes, posterior` for each combination of votes that occurs, and the accuracies behind it.

    Two accuracies a rule: how often it votes for a good document, and against a bad one, where it votes at all; so
    a rule that rarely objects, but then rightly, weighs much when it does. EM starts from `prior` and from rules that are
    right in nine (good) and seven (bad) of ten votes; each round adds one pseudo-vote a side. Documents that `base_failed`
    rejects are settled and don't count in the estimates. No documents: no rows.
    """
    m = len(rules)
    patterns = voted.groupBy("votes").agg(F.sum(F.when(base_failed(), 0).otherwise(1)).alias("count"))
    patterns = patterns.withColumn("v", F.array(*[F.expr(f"cast(floor(votes / {3 ** j}) % 3 AS int)") for j in range(m)]))
    # At most 3 ^ m rows come together in one.
    one = patterns.agg(F.collect_list(F.struct("votes", "count", "v")).alias("seen"))
    score = """transform(seen, p -> aggregate(sequence(0, {last}), ln(s.prior / (1 - s.prior)), (sum, j) -> sum + CASE p.v[j]
        WHEN 2 THEN ln(s.good[j] / (1 - s.bad[j])) WHEN 0 THEN ln((1 - s.good[j]) / s.bad[j]) ELSE 0D END,
        sum -> 1D / (1D + exp(-sum))))""".format(last=m - 1)
    # An estimate: over the documents where rule j votes, the posterior-weighted part in which it is right.
    share = """transform(sequence(0, {last}), j -> aggregate(seen, struct(0D AS n, 0D AS k, 0 AS i), (a, p) -> struct(
        a.n + (CASE WHEN p.v[j] <> 1 THEN p.count * {weight} ELSE 0D END) AS n,
        a.k + (CASE WHEN p.v[j] = {side} THEN p.count * {weight} ELSE 0D END) AS k, a.i + 1 AS i),
        a -> (a.k + {start}) / (a.n + 1D)))"""
    good = share.format(last=m - 1, weight="post[a.i]", side=2, start="0.9D")
    bad = share.format(last=m - 1, weight="(1D - post[a.i])", side=0, start="0.7D")
    base = "aggregate(seen, struct(0D AS n, 0D AS k, 0 AS i), (a, p) -> struct(a.n + p.count AS n, a.k + p.count * post[a.i] AS k, a.i + 1 AS i), a -> (a.k + 0.8D) / (a.n + 1D))"
    # `transform(array(x), post -> ...)[0]` names a value that is used more than once.
    step = f"transform(array({score}), post -> struct({base} AS prior, {good} AS good, {bad} AS bad))[0]"
    start = f"struct({float(prior)}D AS prior, array_repeat(0.9D, {m}) AS good, array_repeat(0.7D, {m}) AS bad)"
    fitted = one.withColumn("s", F.expr(f"aggregate(sequence(1, {rounds}), {start}, (s, round) -> {step})"))
    posts = fitted.withColumn("post", F.expr(score)).select("s", F.explode(F.arrays_zip("seen", "post")).alias("x"))
    return posts.select(
        F.col("x.seen.votes").alias("seen_votes"), F.col("x.post").alias("posterior"),
        F.col("s.prior").alias("share_good"), F.col("s.good").alias("accuracy_good"), F.col("s.bad").alias("accuracy_bad"),
    )


def judge(voted: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """Adds `posterior` and `good` (`posterior` >= `threshold`) to the rows of `voted`, which is read twice: land it first."""
    model = fit(voted, rules).select("seen_votes", "posterior")  # at most 3 ^ rules rows of 16 bytes
    return (
        voted.join(F.broadcast(model), F.col("votes") == F.col("seen_votes"), "left")
        .drop("seen_votes")
        .withColumn("good", F.coalesce(F.col("posterior") >= threshold, F.lit(False)))
    )


def keep_good(documents: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """The rows of `documents` that pass the base rules and whose posterior is high enough, with all their columns.

    Judged by text alone: equal texts, ids repeated or null make no difference. Null, empty and blank texts have too few
    words and go. An empty table gives none.
    """
    key = row_key(F.col("text"))
    featured = vote(add_features(documents.select("text")), rules)
    features = [c for c in featured.columns if c != "doc"]
    voted = land(featured.select("doc.text", *features).select(*key, *features))  # numbers only, no texts
    good = judge(voted, rules, threshold).filter(F.col("good") & ~base_failed()).select("key_a", "key_b").distinct()
    rows = documents.select(F.struct("*").alias("doc"), *key)
    return rows.join(good, ["key_a", "key_b"], "left_semi").select("doc.*")
