"""Quality rules with host-level evidence, in DataFrame functions only.

A document's own rules decide first. Rule failures are then counted by host, each host's failure rate is shrunk to
the corpus by a beta prior fitted to the hosts' rates (method of moments), and the host's verdict goes back to its
documents: all documents of a rejected host go, of a watched host those that break any rule, of an accepted host
those that break a base rule.

Defined cases: a null or empty text has no words and fails the base rules. A null host is a host of its own. Repeated
rows count as often as they occur. An empty table gives an empty table. Columns of the input that bear a name of the
output are replaced in rule_report() and kept in passing().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftline.llm._common import GAP, WORD, small, stored

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Beyond the base rules: symbols for a hundred characters of words, repeated lines for a hundred lines, characters a word.
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT, MAX_MEAN_WORD = 25, 50, 40
#: Host verdicts: rejected above this shrunk rate; watched above the mean of the hosts' rates by this much.
REJECT_RATE, WATCH_MARGIN = 0.5, 0.1
#: Bounds of the prior's strength, in documents.
PRIOR_BOUNDS = (1.0, 1000.0)

NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a one-element transform binds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window whose words occur in two windows or more.

    Windows are hashed and sorted with their positions; equal neighbours mark windows that repeat; the marked
    positions in order cover min(3, distance to the next) words each.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(hashes)
        twice = F.array_distinct(F.filter(F.zip_with(ordered, F.slice(ordered, 2, F.size(ordered)), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull()))
        return F.when(F.size(twice) == 0, F.lit(0)).otherwise(_let(hashes, marked))

    def marked(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(p: Column) -> Column:
            after = F.concat(F.slice(p, 2, F.size(p)), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
            before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(p, 1, F.size(p) - 1))
            near = F.zip_with(after, before, lambda a, b: F.struct(a["h"].alias("a"), b["h"].alias("b")))
            hit = F.zip_with(p, near, lambda x, y: F.when((x["h"] == y["a"]) | (x["h"] == y["b"]), x["i"]))
            return F.array_sort(F.filter(hit, lambda x: x.isNotNull()))

        def cover(at: Column) -> Column:
            return F.aggregate(F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0), lambda s, x: s + x)

        return _let(_let(pairs, positions), cover)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(windows, covered))


def rule_numbers(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the five numbers, base_failed and rule_failed (base rules or the others)."""
    raw = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(raw, "\n"), lambda x: x.rlike(WORD))
    found = F.struct(
        _let(F.regexp_extract_all(raw, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(F.regexp_replace(raw, GAP, "")).cast("long").alias("word_chars"),
        (F.length(raw) - F.length(F.translate(raw, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("all"))).alias("lines"),
    )
    df = docs.withColumn("_found", found)
    df = df.withColumns({
        "n_words": F.col("_found.w.n_words"), "word_chars": F.col("_found.word_chars"), "n_symbols": F.col("_found.n_symbols"),
        "n_dup_lines": F.col("_found.lines.dup"), "n_repeat_words": F.col("_found.w.n_repeat_words"), "_lines": F.col("_found.lines.all"),
    }).drop("_found")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    more = (
        (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars"))
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("_lines"))
        | (F.col("word_chars") > MAX_MEAN_WORD * F.col("n_words"))
    )
    return df.withColumn("base_failed", base).withColumn("rule_failed", F.col("base_failed") | more).drop("_lines")


def host_verdicts(scored: DataFrame, host: str = "source") -> DataFrame:
    """One row a host: documents, failures, shrunk rate and verdict (accept, watch, reject)."""
    hosts = scored.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("rule_failed").alias("n_failed"))
    rates = hosts.withColumn("rate", F.col("n_failed") / F.col("n_docs"))
    prior = rates.agg(F.avg("rate").alias("m"), F.var_pop("rate").alias("v"))
    low, high = PRIOR_BOUNDS
    strength = F.when(F.col("v") > 0, F.least(F.lit(high), F.greatest(F.lit(low), F.try_divide(F.col("m") * (1 - F.col("m")), F.col("v")) - 1))).otherwise(F.lit(high))
    prior = prior.select("m", strength.alias("s"))
    shrunk = (F.col("n_failed") + F.col("m") * F.col("s")) / (F.col("n_docs") + F.col("s"))
    return (
        rates.join(F.broadcast(prior))  # one row of two numbers
        .withColumn("shrunk", shrunk)
        .withColumn("verdict", F.when(F.col("shrunk") > REJECT_RATE, "reject").when(F.col("shrunk") > F.col("m") + WATCH_MARGIN, "watch").otherwise("accept"))
        .select("host", "n_docs", "n_failed", "shrunk", "verdict")
    )


def judged(scored: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """scored with its host's shrunk rate and verdict, and kept. verdicts: a stored table, whose rows are counted before it is broadcast."""
    v = verdicts.select(F.col("host").alias("_host"), F.col("shrunk").alias("host_rate"), F.col("verdict").alias("host_verdict"))
    kept = ~F.col("base_failed") & (F.col("host_verdict") != "reject") & ((F.col("host_verdict") != "watch") | ~F.col("rule_failed"))
    joined = scored.join(small(v, verdicts.count()), F.col(host).eqNullSafe(F.col("_host")), "left").drop("_host")
    return joined.withColumn("kept", F.coalesce(kept, F.lit(False)))


def rule_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Every document's numbers and verdicts: the texts are read once, their numbers are stored."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("source"))
    scored = stored(rule_numbers(narrow).drop("text"), "rules")
    return judged(scored, stored(host_verdicts(scored), "hosts"))


def passing(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """docs without what the rules or their hosts' verdicts reject, in the columns of docs."""
    own = lambda c: f"_row.`{c}`"
    held = docs.select(F.struct(*docs.columns).alias("_row"))
    scored = stored(rule_numbers(held, own(text)), "rules")  # with the texts: their numbers cost more than a copy
    return judged(scored, stored(host_verdicts(scored, own(host)), "hosts"), own(host)).filter("kept").select("_row.*")
