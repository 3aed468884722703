"""Scalar text functions as Column builders; all stay in the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as Python's ``\s``.
SPACE = r"(?U)\s+"
#: The marker before a passage in a prompt, and the token that ends a turn.
PASSAGE_MARKER = "Here is the passage."
END_OF_TURN = "<|eot_id|>"


def collapse_spaces(text: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def clean_text(text: Column) -> Column:
    """Control characters and backslash-e become blanks, semicolons commas, NUL goes; blanks collapse."""
    blank = F.regexp_replace(text, r"[\n\r\t\x0B\f\x08\x07]|\\e", " ")
    return collapse_spaces(F.translate(F.translate(blank, ";", ","), "\0", ""))


def remove_nul(text: Column) -> Column:
    return F.translate(text, "\0", "")


def passage_of_prompt(prompt: Column) -> Column:
    """NUL dropped; what follows the last marker, up to the first end-of-turn token."""
    body = remove_nul(prompt)
    tail = F.when(F.contains(body, F.lit(PASSAGE_MARKER)), F.substring_index(body, PASSAGE_MARKER, -1)).otherwise(body)
    return F.substring_index(tail, END_OF_TURN, 1)


def hash_id(text: Column, suffix: str) -> Column:
    """SHA-256 in a namespace: ``_text``, ``_entity`` or ``_concept``."""
    return F.sha2(F.concat(text, F.lit(suffix)), 256)


def short_hash(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of parts joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 16)


def node_md5(name: Column) -> Column:
    return F.concat(F.lit("n"), F.substring(F.md5(name.cast("binary")), 1, 16))


def normalise_answer(text: Column) -> Column:
    """Lower-case, hyphens to blanks, everything but word characters and blanks dropped, blanks collapsed."""
    return collapse_spaces(F.regexp_replace(F.translate(F.lower(text), "-", " "), r"(?U)[^\w\s]", ""))


def normalise_answer_no_articles(text: Column) -> Column:
    """Lower-case, ASCII punctuation dropped, English articles blanked, blanks collapsed."""
    bare = F.translate(F.lower(text), string.punctuation, "")
    return collapse_spaces(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "))


def normalise_for_retrieval(text: Column) -> Column:
    return collapse_spaces(F.lower(text))


def split_answer(text: Column) -> Column:
    """What follows the last ``Answer:`` or else ``answer:``; nothing there reads ``none``."""
    tail = F.when(F.contains(text, F.lit("Answer:")), F.substring_index(text, "Answer:", -1)).when(F.contains(text, F.lit("answer:")), F.substring_index(text, "answer:", -1)).otherwise(text)
    tail = collapse_spaces(tail)
    return F.when(tail == "", F.lit("none")).otherwise(tail)


def split_labels(answer: Column) -> Column:
    """A comma list as trimmed lower-case strings."""
    return F.transform(F.split(answer, ","), lambda x: F.lower(F.trim(x)))


def concept_list(text: Column) -> Column:
    """A comma list as trimmed, non-empty strings, order and repeats kept."""
    return F.filter(F.transform(F.split(text, ","), F.trim), lambda x: x != "")


def word_set(text: Column) -> Column:
    """Distinct runs of ASCII letters and digits, lower-case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def janitor_normalise(text: Column) -> Column:
    """A-Z lower-cased, ASCII punctuation dropped."""
    return F.translate(text, string.ascii_uppercase + string.punctuation, string.ascii_lowercase)


def tokens(text: Column) -> Column:
    """White-space separated words."""
    return F.array_remove(F.split(text, SPACE), "")


def ngrams(words: Column, n: int) -> Column:
    """Sliding n-word strings of an array of words; fewer words give none.

    The array is bound to a variable first, so that it is made once and not again for every gram.
    """

    def runs(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.element_at(F.transform(F.array(words), runs), 1)


def gram_hashes(words: Column, n: int, seeds: tuple[int, ...] = ()) -> Column:
    """As ``ngrams``, but each gram is the 64-bit hash of its words' hashes; with ``seeds`` a struct of one hash a seed.

    Words are hashed once, so a gram costs ``n`` longs and no string.
    """
    kind = f"array<struct<{', '.join(f'h{i}: bigint' for i in range(len(seeds)))}>>" if seeds else "array<bigint>"

    def key(run: Column) -> Column:
        return F.struct(*[F.xxhash64(F.lit(s), run).alias(f"h{i}") for i, s in enumerate(seeds)]) if seeds else F.xxhash64(run)

    def runs(h: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: key(F.slice(h, i, n)))
        return F.when(F.size(h) >= n, hashes).otherwise(F.array().cast(kind))

    return F.element_at(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), runs), 1)


def chunk(text: Column, size: int, overlap: int = 0) -> Column:
    """Greedy word chunks of at most ``size`` characters, a blank counted after each word.

    A word that would overflow closes the chunk; the next one begins with the last words of that, as many
    as it takes for their lengths to reach ``overlap``. A longer word is a chunk of its own. The fold
    carries word numbers and lengths; the text is cut once at the end.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size is positive and overlap less than it")
    state = "struct<cuts: array<struct<first: int, last: int>>, first: int, at: int, len: int>"
    start = F.struct(F.array().cast("array<struct<first: int, last: int>>").alias("cuts"), F.lit(1).alias("first"), F.lit(1).alias("at"), F.lit(0).alias("len")).cast(state)

    def kept(lengths: Column, s: Column) -> Column:
        """How many of the closed chunk's last words the next one begins with, and their length."""
        back = F.reverse(F.slice(lengths, s["first"], s["at"] - s["first"]))
        none = F.struct(F.lit(0).alias("words"), F.lit(0).alias("len"))
        return F.aggregate(back, none, lambda k, n: F.when(k["len"] < overlap, F.struct((k["words"] + 1).alias("words"), (k["len"] + n).alias("len"))).otherwise(k))

    def cut(w: Column) -> Column:
        lengths = F.transform(w, lambda x: F.length(x) + 1)

        def fold(n: Column) -> Column:
            def step(s: Column, more: Column) -> Column:
                tail = kept(n, s) if overlap else F.struct(F.lit(0).alias("words"), F.lit(0).alias("len"))
                closed = F.struct(F.concat(s["cuts"], F.array(F.struct(s["first"].alias("first"), (s["at"] - 1).alias("last")))).alias("cuts"), (s["at"] - tail["words"]).alias("first"), (s["at"] + 1).alias("at"), (tail["len"] + more).alias("len"))
                open_ = F.struct(s["cuts"].alias("cuts"), s["first"].alias("first"), (s["at"] + 1).alias("at"), (s["len"] + more).alias("len"))
                return F.when((s["len"] + more > size) & (s["at"] > s["first"]), closed.cast(state)).otherwise(open_.cast(state))

            return F.aggregate(n, start, step, lambda s: F.concat(s["cuts"], F.array(F.struct(s["first"].alias("first"), (s["at"] - 1).alias("last")))))

        cuts = F.element_at(F.transform(F.array(lengths), fold), 1)
        return F.transform(cuts, lambda c: F.array_join(F.slice(w, c["first"], c["last"] - c["first"] + 1), " "))

    done = F.element_at(F.transform(F.array(F.split(text, " ")), cut), 1)
    return F.when(F.length(text) > 0, done).otherwise(F.array().cast("array<string>"))


def rolling_windows(n: Column, longest: int, context: int) -> Column:
    """Windows over ``n`` tokens as structs (first, last, scored): the first predicts all its tokens, each later
    one the next ``longest - context + 1`` with at most ``longest`` tokens before them. Zero-based, ends exclusive."""
    step = longest - context + 1
    first = F.struct(F.lit(0).alias("first"), F.least(n, F.lit(longest)).cast("int").alias("last"), F.least(n, F.lit(longest)).cast("int").alias("scored"))
    more = F.greatest(F.ceil((n - longest) / step), F.lit(0)).cast("int")
    rest = F.transform(
        F.sequence(F.lit(1), more),
        lambda i: F.struct(
            F.greatest(F.least(F.lit(longest) + i * step, n) - longest, F.lit(0)).cast("int").alias("first"),
            F.least(F.lit(longest) + i * step, n).cast("int").alias("last"),
            (F.least(F.lit(longest) + i * step, n) - (F.lit(longest) + (i - 1) * step)).cast("int").alias("scored"),
        ),
    )
    return F.when(n <= 0, F.array().cast("array<struct<first: int, last: int, scored: int>>")).when(more > 0, F.concat(F.array(first), rest)).otherwise(F.array(first))


def xml_safe(text: Column) -> Column:
    """Characters that XML 1.0 forbids are dropped."""
    return F.regexp_replace(text, r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")


def question_of(prompt: Column) -> Column:
    """What follows the last ``Question:``."""
    return F.trim(F.substring_index(prompt, "Question:", -1))


def attribute_text(values: Column) -> Column:
    """A list as one text, items by comma and blank, nulls left out."""
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ", ")
