"""Quality rules combined by weak supervision, in DataFrame expressions only.

Each rule looks at one statistic of a text and votes good (1), bad (-1) or
abstains (0).  A Dawid-Skene label model (two classes, abstentions carry no
evidence), fitted by expectation-maximisation on
the counts of distinct vote patterns over *all* documents, estimates for every
rule how often it votes each way on good and on bad texts; a document is kept
when its posterior probability of being good reaches ``keep_at``.

Several rules look at the same kind of fault from different sides, so junk draws two
or more bad votes; whether a single one is enough depends on the rule's estimated
accuracy and on the other votes.

The pattern table has at most 3**10 rows whatever the size of the corpus.  The
fit is one SQL expression over that table held as an array, so the plan has
one pass over the texts, one partial aggregation and no Python on the executors.

Defined results: a null or empty text has no words, fails the base rules and is
not kept; repeated rows each get the same row; an empty table gives no rows.
Columns of the input other than ``doc_id`` and ``text`` never enter, so clashing
names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: (name, SQL over the statistics: good, SQL: bad).  Otherwise the rule abstains.
RULES = [
    ("symbols", "n_symbols <= 0.05 * n_words", "n_symbols > 0.3 * n_words"),
    ("symbol_share", "n_symbols <= 0.01 * word_chars", "n_symbols > 0.04 * word_chars"),
    ("exclaiming", "n_bangs <= 0.05 * n_words", "n_bangs > 0.3 * n_words"),
    ("shouting", "n_upper <= 0.1 * word_chars", "n_upper > 0.3 * word_chars"),
    ("tables", "n_pipes <= 0.02 * n_words", "n_pipes > 0.2 * n_words"),
    ("word_length", "word_chars between 3 * n_words and 9 * n_words", "word_chars > 14 * n_words or word_chars < 2 * n_words"),
    ("repetition", "n_repeat_words <= 0.05 * n_words", "n_repeat_words > 0.2 * n_words"),
    ("line_copies", "n_dup_lines <= 0.05 * n_lines", "n_dup_lines > 0.3 * n_lines"),
    ("vocabulary", "n_words >= 30 and n_distinct > 0.35 * n_words", "n_words >= 30 and n_distinct < 0.2 * n_words"),
    ("length", "n_words >= 40", "n_words < 10"),
]

ITERATIONS = 25
#: What a rule's author expects: P(votes bad | good text, voted) and P(votes bad | bad text, voted).  Also the first guess.
EXPECTED = (0.01, 0.3)
#: First guess of P(good text).
FIRST_PRIOR = 0.9
#: How much that expectation weighs, as a part of the votes that the rule has cast; so it informs a corpus of any size alike.
#: Without it, likelihood alone can let a frequent kind of junk count as good.
TRUST = 0.02
#: Pseudo-votes for what is expected, besides; they matter where a rule has hardly voted.
SMOOTHING = 1.0


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id with the statistics that the rules read, one row per input row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = docs.select("doc_id", text.alias("text"), F.btrim(text, F.lit(SPACES)).alias("bare"))
    none = F.array().cast("array<string>")
    has_word = lambda line: F.btrim(line, F.lit(SPACES)) != ""
    words = bare.select(
        "doc_id",
        F.regexp_count("text", F.lit("[" + SYMBOLS + "]")).alias("n_symbols"),
        (F.size(F.split("text", r"\|")) - 1).alias("n_pipes"),
        (F.size(F.split("text", "!")) - 1).alias("n_bangs"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_upper"),
        F.filter(F.split("text", "\n"), has_word).alias("lines"),
        F.when(F.col("bare") == "", none).otherwise(F.split("bare", r"[\x20\x09-\x0D]+")).alias("words"),
    )
    hashed = words.select(
        "doc_id", "n_symbols", "n_pipes", "n_bangs", "n_upper",
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size("words").alias("n_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    starts = F.slice("h", 1, F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0)))
    windows = hashed.withColumn("w", F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get("h", i + k) for k in range(1, WINDOW)])))
    # Most texts repeat no window; only the others pay for the sort below.
    ordered = windows.select(
        "*",
        F.size(F.array_distinct("h")).alias("n_distinct"),
        F.when(F.size(F.array_distinct("w")) < F.size("w"), F.array_sort(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("o"),
    ).drop("h", "w")
    same = lambda e, k: F.coalesce(F.get("o", k)["x"] == e["x"], F.lit(False))
    spots = ordered.select(
        "*",
        F.array_sort(F.array_compact(F.transform("o", lambda e, k: F.when(same(e, k + 1) | F.when(k > 0, same(e, k - 1)).otherwise(False), e["i"])))).alias("p"),
    ).drop("o")
    # A repeated window at p covers words p .. p+4; count each word once.
    gaps = F.transform("p", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1) - x, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, g: a + g), F.lit(0))
    as_long = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_pipes", "n_bangs", "n_upper", "n_distinct")
    return spots.select("doc_id", *[F.col(c).cast("long").alias(c) for c in as_long], covered.cast("long").alias("n_repeat_words"))


def vote_columns(rules=RULES) -> list[Column]:
    return [F.expr(f"cast(case when {good} then 1 when {bad} then -1 else 0 end as int)") for _, good, bad in rules]


def fit_label_model(votes: DataFrame, n_rules: int, iterations: int = ITERATIONS) -> DataFrame:
    """One row: prior, and per rule how often its votes say bad on good and on bad texts.

    ``votes`` has an array column ``votes``.  Without any row the first guess comes back.
    """
    patterns = votes.groupBy("votes").agg(F.count("*").cast("double").alias("c"))
    guess = f"named_struct('good', {EXPECTED[0]}D, 'bad', {EXPECTED[1]}D)"
    first = f"named_struct('prior', {FIRST_PRIOR}D, 'rules', array_repeat({guess}, {n_rules}))"
    a = SMOOTHING
    table = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "c"))).alias("t"))
    trust = f"({a}D + {TRUST}D * {_sum('q', 'if(e.v[j] <> 0, e.c, 0D)')})"
    rate = lambda g, expected: f"({expected}D * {trust} + {_sum('q', f'if(e.v[j] = -1, e.c * {g}, 0D)')}) / ({trust} + {_sum('q', f'if(e.v[j] <> 0, e.c * {g}, 0D)')})"
    step = f"""
      transform(array(s), s0 ->
        transform(array(transform(t, p -> named_struct('v', p.votes, 'c', p.c, 'g', {_posterior('s0', 'p.votes')}))), q ->
          named_struct(
            'prior', ({a}D + {_sum('q', 'e.c * e.g')}) / (2 * {a}D + {_sum('q', 'e.c')}),
            'rules', transform(sequence(0, {n_rules} - 1), j -> named_struct(
              'good', {rate('e.g', EXPECTED[0])}, 'bad', {rate('(1D - e.g)', EXPECTED[1])})))
        )[0]
      )[0]"""
    return table.select(F.expr(f"if(size(t) > 0, aggregate(sequence(1, {iterations}), {first}, (s, i) -> {step}), {first})").alias("model"))


def _sum(rows: str, term: str) -> str:
    return f"aggregate({rows}, 0D, (acc, e) -> acc + {term})"


def _posterior(model: str, votes: str) -> str:
    odds = f"""aggregate(zip_with({votes}, {model}.rules, (v, r) -> case v
        when 1 then ln((1D - r.good) / (1D - r.bad)) when -1 then ln(r.good / r.bad) else 0D end),
        ln({model}.prior / (1D - {model}.prior)), (acc, x) -> acc + x)"""
    return f"(1D / (1D + exp(-({odds}))))"


def judge(docs: DataFrame, keep_at: float = 0.5, rules=RULES, iterations: int = ITERATIONS) -> DataFrame:
    """Statistics, base_failed, quality (posterior, 6 decimals) and kept for each row of ``docs``."""
    voted = text_statistics(docs).withColumn("votes", F.array(*vote_columns(rules)))
    # Written, so that the texts are read once and no filter below is pushed into the array expressions.
    voted = Scratch(docs.sparkSession, "quality").keep(voted, "votes")
    model = fit_label_model(voted.select("votes"), len(rules), iterations)
    scored = voted.crossJoin(F.broadcast(model))  # one row, by construction
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.round(F.expr(_posterior("model", "votes")), 6).alias("quality"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_at))


def kept_documents(docs: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with their own columns.

    The verdict depends on the text alone, so it is joined back by row, not by a
    possibly repeated or null doc_id: every column travels in one struct.
    """
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), F.col("text"))
    return judge(boxed, keep_at).filter("kept").select("doc_id.*")
