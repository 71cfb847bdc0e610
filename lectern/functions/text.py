"""Text columns: Unicode trimming, bounded splitting, budgets, prefixes, sanitising, validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters per token of the size estimates, the share of a context window that
# prompt, question and answer take, and the least words of a question.
CHARS_PER_TOKEN = 4
OVERHEAD = 0.2
MIN_QUESTION_WORDS = 3
DISPLAY_CHARS = 80


def utrim(text: Column) -> Column:
    """Strip Unicode white space; Spark's own trim strips U+0020 only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def bounded_split(text: Column, most: int) -> Column:
    """Pieces of at most `most` (2 or more) characters, cut before the last white space that fits.

    A text that fits is one trimmed piece, even an empty one; of longer texts empty pieces go.
    """
    cut = F.filter(F.transform(_runs(text, most), utrim), lambda x: x != "")
    return F.when(F.char_length(text) <= most, F.array(utrim(text))).otherwise(cut)


def _runs(text: Column, most: int) -> Column:
    pattern = rf"(?s)(?U).{{1,{most}}}\z|.{{1,{most - 1}}}(?=\s)|.{{{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def raw_pieces(text: Column, most: int) -> Column:
    """The pieces of bounded_split() before trimming, blank ones too: together they are the text."""
    return F.when(F.char_length(text) <= most, F.array(text)).otherwise(_runs(text, most))


def document_budget(context: Column) -> Column:
    """Characters of document text that a context window of so many tokens holds."""
    return F.floor(context * (1 - OVERHEAD)).cast("bigint") * CHARS_PER_TOKEN


def map_budget(context: Column, fraction: Column) -> Column:
    """Characters of one map chunk: a fraction of the window, 200 tokens at least."""
    return F.greatest(F.lit(200).cast("bigint"), F.floor(context * fraction).cast("bigint")) * CHARS_PER_TOKEN


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.expr("1").cast("bigint") * F.floor(F.char_length(text) / CHARS_PER_TOKEN))


def common_prefix(a: Column, b: Column, bits: int = 31) -> Column:
    """Length of the common prefix in characters, by binary descent over lengths below 2**bits."""
    top = F.least(F.char_length(a), F.char_length(b))

    def grow(n: Column, k: Column) -> Column:
        m = (n + F.pow(F.lit(2), k)).cast("bigint")
        return F.when((m <= top) & (F.substring(a, (n + 1).cast("int"), (m - n).cast("int")) == F.substring(b, (n + 1).cast("int"), (m - n).cast("int"))), m).otherwise(n)

    descent = F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), F.lit(0).cast("bigint"), grow)
    # Most pairs that are asked about extend each other: one comparison settles them.
    whole = F.substring(a, F.lit(1), top) == F.substring(b, F.lit(1), top)
    return F.when(whole, top.cast("bigint")).otherwise(descent)


def truncate_display(text: Column, most: int = DISPLAY_CHARS) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def file_name(name: Column) -> Column:
    r"""Last component after / or \; `upload` where that is empty."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"[^/\\]*$", 0), F.lit("")), F.lit("upload"))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(name, r"[^/\\]*$", 0), r"(?<=.)\.[^.]*$", "")


def workspace_name(name: Column) -> Column:
    """Trimmed letters, digits, space, - and _; null if empty, or over 100 characters before."""
    trimmed = utrim(name)
    kept = utrim(F.regexp_replace(trimmed, r"[^\p{IsAlphabetic}\p{N} _-]", ""))
    return F.when((trimmed != "") & (F.char_length(trimmed) <= 100), F.nullif(kept, F.lit("")))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("bigint")


def question_problem(question: Column) -> Column:
    """null for a question that may be asked, else `empty` or `too generic`."""
    return F.when(utrim(question) == "", "empty").when(word_count(question) < MIN_QUESTION_WORDS, "too generic")


def relevant(extraction: Column) -> Column:
    """Whether an extraction says something: not empty, and not NONE in any ASCII case."""
    return (F.translate(extraction, "NOE", "noe") != "none") & (extraction != "")


def query_type(question: Column) -> Column:
    """Type of a question by its wording; the first pattern that fits decides."""
    q = F.lower(question)
    return (
        F.when(q.rlike(r"\b(compare|versus|vs|difference|differ)\b"), "comparison")
        .when(q.rlike(r"\b(summari[sz]e|summary|overview)\b"), "summary")
        .when(q.rlike(r"\b(history|origin|evolution|timeline)\b"), "history")
        .when(q.rlike(r"\b(how many|how much|count|total)\b"), "quantity")
        .otherwise("fact-lookup")
    )


def is_compound(question: Column) -> Column:
    """Whether a question asks for more than one hop: joined questions or a back reference."""
    return F.lower(question).rlike(r"\?.*\S.*\?|,? and (what|who|when|where|why|how|its|their)\b|\bof the .* (that|which|whose)\b")
