"""Spelling variants: words one edit apart, found over a reduced alphabet.

Letters are hashed to ``SYMBOLS`` symbols, so a word's reduced form has a small full
neighbourhood: every form with one symbol replaced (by itself, too), deleted or inserted.
Words generate it and meet the vocabulary's reduced forms in a join; pairs that meet are
verified on the words themselves.  One edit leaves the first ``ENDS`` letters or the last
``ENDS`` as they are, as words have at least ``SHORTEST`` letters; a generated form goes
with the end that its edit left alone, and the vocabulary with either.  So words that are
alike in the reduced alphabet only don't meet, and no group of them is paired up.  Nothing
is lost: of two words one edit apart each generates the other's form with such an end.

Forms and ends are joined by one 64-bit hash; wrong meetings fall to the verification.

Defined results: null and empty texts have no words; a null id counts as an empty text in
what is hashed; repeated rows count as often as they stand; further columns are ignored;
an empty table gives an empty result.  A text's letters are read by one expression in the
row's task, however long it is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactweave.llm.base import let, lower_ascii_col, written

SYMBOLS, ENDS, SHORTEST, LEAST, FACTOR = 3, 3, 7, 2, 10
#: Letters of words: A-Z, a-z and the code points C0 to FF.
LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]))
_OF = "".join(chr(48 + ((ord(c) * 2654435761) >> 16) % SYMBOLS) for c in LETTERS)
#: Letters to delete from a run are drawn by a hash that this divides.
DRAWN = 31


def occurrences(docs: DataFrame) -> DataFrame:
    """(word): the runs of letters of ``docs`` (doc_id, text) in lower case, some of them
    with a letter less.  Runs too short to become words are left out."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower_ascii_col(F.col("text")), F.lit(rf"[A-Za-zÀ-ÿ]{{{SHORTEST},}}"), F.lit(0))).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    shorter = F.overlay("run", F.lit(""), (F.col("h") % F.length("run") + 1).cast("int"), F.lit(1))
    return runs.select(F.when(F.col("h") % DRAWN == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= SHORTEST)


def reduced(word: Column) -> Column:
    return F.translate(word, LETTERS, _OF)


def _key(form: Column, first: bool, end: Column) -> Column:
    return F.xxhash64(form, F.lit(first), end)


def _published(word: Column, form: Column) -> Column:
    return F.array(_key(form, True, F.substr(word, F.lit(1), F.lit(ENDS))), _key(form, False, F.substr(word, F.lit(-ENDS))))


def _generated(word: Column, form: Column) -> Column:
    """Keys of the whole neighbourhood, each once."""
    symbols = F.array(*(F.lit(str(s)) for s in range(SYMBOLS)))
    head, tail = F.substr(word, F.lit(1), F.lit(ENDS)), F.substr(word, F.lit(-ENDS))
    n = F.length(form)

    def keys(places: Column, width: int, put: bool) -> Column:
        """Forms with ``width`` symbols at each place (from 1) taken out and, if ``put``,
        one put in; places up to ``ENDS`` leave the last letters, others the first."""

        def at(p: Column) -> Column:
            left, right = F.substr(form, F.lit(1), p - 1), F.substr(form, p + width)
            new = F.transform(symbols, lambda s: F.concat(left, s, right)) if put else F.array(F.concat(left, right))
            first = p > ENDS
            end = F.when(first, head).otherwise(tail)
            return F.transform(new, lambda f: F.xxhash64(f, first, end))

        return F.flatten(F.transform(places, at))

    every = F.sequence(F.lit(1), n)
    return F.array_distinct(F.concat(keys(every, 1, True), keys(every, 1, False), keys(F.sequence(F.lit(1), n + 1), 0, True)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): pairs of ``words`` (word, n) one edit apart, both ways."""
    of = lambda keys: F.explode(let(reduced(F.col("word")), lambda f: keys(F.col("word"), f)))
    asks = words.select("word", of(_generated).alias("key"))
    holds = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.posexplode(let(reduced(F.col("word")), lambda f: _published(F.col("word"), f))).alias("last", "k"))
    met = asks.join(holds, F.col("key") == F.col("k")).where(F.abs(F.length("word") - F.length("near")) <= 1)
    # A pair that shares its first letters meets by them, so once.
    once = (F.col("last") == 0) | (F.substring("word", 1, ENDS) != F.substring("near", 1, ENDS))
    return met.where(once & (F.levenshtein("word", "near", 1) == 1)).select("word", "near", "near_n")


def variants(docs: DataFrame) -> DataFrame:
    """Per word of ``docs``: word, n, n_near, form, form_n and root."""
    words = written(occurrences(docs).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST), "words")
    pairs = near_pairs(words)
    # Largest n, then the smallest word: structs compare field by field.
    near = written(pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")), "near")
    judged = words.join(near, "word", "left").withColumn("takes", -F.col("best.less") >= FACTOR * F.col("n"))
    judged = written(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("takes"), F.col("best.near")).alias("form"), F.when(F.col("takes"), -F.col("best.less")).alias("form_n")), "forms")
    # Along forms n grows tenfold at each step, so chains are short; every round halves them.
    most = words.agg(F.max("n")).first()[0] or 1
    roots = judged.where("form is not null").select("word", F.col("form").alias("root"))
    for k in range(math.ceil(math.log2(max(1.0, math.log(most, FACTOR))))):
        after = roots.select(F.col("word").alias("w"), F.col("root").alias("next"))
        roots = written(roots.join(after, F.col("root") == F.col("w"), "left").select("word", F.coalesce("next", "root").alias("root")), f"roots{k}")
    return judged.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
