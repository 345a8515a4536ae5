"""Per-essay text expressions.

Everything here returns a ``Column`` built from Spark built-ins and
higher-order functions, so a whole feature row is computed in one
whole-stage-codegen pass over the text, without exploding or shuffling.
Regexes stay inside the subset Java and RE2 share (no look-around, no
back-references) so that the DuckDB oracle can mirror each one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorewright.functions import fixed

# Word characters in the Unicode sense (letters, digits, underscore).
WORD_CHARS = r"\p{L}\p{N}_"
# One token: a run of word characters, or one other non-space character.
TOKEN_PATTERN = rf"([{WORD_CHARS}]+|[^\s{WORD_CHARS}])"
# A vocabulary term: a run of two or more word characters.
TERM_PATTERN = rf"([{WORD_CHARS}]{{2,}})"
WORD_RUN_PATTERN = rf"([{WORD_CHARS}]+)"
# What stands between two such runs.
NO_WORD_RUN = rf"[^{WORD_CHARS}]+"


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def whitespace_words(text: Column) -> Column:
    """Whitespace-separated pieces, empty pieces ignored (Python ``str.split()``)."""
    return F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("bigint")


def unique_word_count(text: Column) -> Column:
    """Distinct whitespace pieces: case-sensitive, punctuation kept."""
    return F.size(F.array_distinct(whitespace_words(text))).cast("bigint")


def normalized_words(text: Column) -> Column:
    """Non a-z/A-Z characters become spaces; lower-case; split; drop empties."""
    spaced = F.lower(F.regexp_replace(text, r"[^a-zA-Z]", " "))
    return F.filter(F.split(spaced, " +"), lambda w: w != "")


def word_tokens(text: Column) -> Column:
    """Tokens where each punctuation mark is its own token."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(1))


def vocabulary_terms(text: Column) -> Column:
    """Lower-cased runs of >= 2 word characters (count-vectoriser tokens)."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(1))


def word_runs(text: Column) -> Column:
    """Lower-cased runs of word characters (bag-of-words tokens for cosine)."""
    return F.array_remove(F.split(F.lower(text), NO_WORD_RUN, -1), "")


def strip(s: Column) -> Column:
    """Python ``str.strip()`` for ASCII whitespace."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def line_sentences(text: Column) -> Column:
    """Split on newline and strip each piece; empty lines are kept."""
    return F.transform(F.split(text, "\n", -1), strip)


def literal_count(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal (Python ``str.count``)."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))
    return (removed / F.lit(len(needle))).cast("bigint") if len(needle) > 1 else removed.cast("bigint")


def remove_stopwords(words: Column, stop_words=None) -> Column:
    stop = list(stop_words if stop_words is not None else fixed.STOP_WORDS)
    return F.filter(words, lambda w: ~w.isin(stop))


def lemma(word: Column) -> Column:
    """Noun lemma of a lower-case word: irregular list, then ordered suffix rules.

    Every suffix rule needs a final "s", so other words skip the regexes.
    """
    irregular = [src for src, _ in fixed.IRREGULAR_LEMMAS]
    table = F.create_map(*[F.lit(x) for kv in fixed.IRREGULAR_LEMMAS for x in kv])
    expr = F.when(word.isin(irregular), F.element_at(table, word)).when(~word.endswith("s"), word)
    for pattern, repl in fixed.LEMMA_RULES:
        expr = expr.when(word.rlike(pattern), F.regexp_replace(word, pattern, repl))
    return expr.otherwise(word)


def lemmatize(words: Column) -> Column:
    return F.transform(words, lemma)


def clean_corpus(text: Column, stop_words=None) -> Column:
    """normalize -> stop-word drop -> lemmatise -> join by one space."""
    return F.array_join(lemmatize(remove_stopwords(normalized_words(text), stop_words)), " ")


def pos_tag(token: Column) -> Column:
    """Rule/lexicon part-of-speech tag of one token (re-aimed tagger).

    Lambdas of higher-order functions are evaluated without codegen, so the
    cheap tests come first: one hash-set probe for all closed-class words,
    first-character tests and ``endswith``; regexes only behind guards.
    """
    low = F.lower(token)
    first = F.substring(token, 1, 1)
    closed = [w for _, words in fixed.POS_WORDS for w in words]
    which = None
    for tag, words in fixed.POS_WORDS:
        cond = low.isin(words)
        which = F.when(cond, F.lit(tag)) if which is None else which.when(cond, F.lit(tag))
    suffix = None
    for tag, suffixes in fixed.POS_SUFFIXES:
        cond = None
        for suf in suffixes:
            c = token.endswith(suf)
            cond = c if cond is None else cond | c
        suffix = F.when(cond, F.lit(tag)) if suffix is None else suffix.when(cond, F.lit(tag))
    return F.when(first.between("0", "9") & token.rlike(fixed.NUMBER_PATTERN), F.lit("NUM")) \
        .when(low.isin(closed), which) \
        .when((F.length(token) == 1) & ~token.rlike(rf"[{WORD_CHARS}]"), F.lit("PUNCT")) \
        .when(first != F.lower(first), F.lit("PROPN")) \
        .when(first != F.upper(first), suffix.otherwise(F.lit("NOUN"))) \
        .otherwise(F.lit("X"))


def pos_tags(tokens: Column) -> Column:
    return F.transform(tokens, pos_tag)


def tag_count(tags: Column, tag: str) -> Column:
    """Occurrences of ``tag`` (``array_remove`` is codegen'd; a ``filter`` lambda is not)."""
    return (F.size(tags) - F.size(F.array_remove(tags, tag))).cast("bigint")


def entities(text: Column) -> Column:
    """Anonymised ``@TYPE n`` marks and capitalised multi-word runs (re-aimed NER)."""
    return F.regexp_extract_all(text, F.lit(ENTITY_PATTERN), F.lit(1))


ENTITY_PATTERN = r"(@[A-Z]+[0-9]*|\p{Lu}\p{Ll}+(?:[ \t]+\p{Lu}\p{Ll}+)+)"


def polarity_map() -> Column:
    pairs = []
    for w, p in fixed.POLARITY:
        pairs += [F.lit(w), F.lit(float(p))]
    return F.create_map(*pairs)


def sentiment_polarity(text: Column) -> Column:
    """Mean polarity of known words; a negator before a word multiplies it by -0.5; 0 if none known.

    One left-to-right ``aggregate`` over the word array carrying
    (sum, known-word count, previous-word-is-negator).
    """
    words = normalized_words(text)
    pmap = polarity_map()
    neg = list(fixed.NEGATORS)
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("neg"))

    def step(acc, w):
        pol = pmap[w]
        factor = F.when(acc["neg"], F.lit(fixed.NEGATION_FACTOR)).otherwise(F.lit(1.0))
        return F.struct(
            (acc["s"] + F.coalesce(factor * pol, F.lit(0.0))).alias("s"),
            (acc["n"] + F.when(pol.isNotNull(), 1).otherwise(0)).alias("n"),
            w.isin(neg).alias("neg"))

    def finish(acc):
        return F.coalesce(F.try_divide(acc["s"], acc["n"].cast("double")), F.lit(0.0))

    return F.aggregate(words, zero, step, finish)


def syllables(word: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(word, F.lit("[aeiouy]+")))


def flesch_reading_ease(text: Column) -> Column:
    """206.835 - 1.015 words/sentences - 84.6 syllables/words; null for a text without words.

    Words are the normalised words, syllables are vowel groups (at least one
    per word) and sentences are runs of . ! ? (at least one).
    """
    words = normalized_words(text)
    n_words = F.size(words).cast("double")
    n_syll = F.aggregate(F.transform(words, syllables), F.lit(0).cast("bigint"),
                         lambda acc, x: acc + x).cast("double")
    n_sent = F.greatest(F.lit(1), F.regexp_count(text, F.lit("[.!?]+"))).cast("double")
    score = F.lit(206.835) - F.lit(1.015) * (n_words / n_sent) - F.lit(84.6) * (n_syll / n_words)
    return F.when(n_words > 0, score)


#: Literals of which every match of a rule holds one: texts without any skip the rule's regex.
RULE_LITERALS = {"DOUBLE_SPACE": ["  "], "TEH_TYPO": ["teh"], "COMMA_PERIOD": [",."], "REPEATED_PUNCTUATION": ["!!", "!?", "?!", "??"]}


def _lacks(text: Column, literals: list[str]) -> Column:
    out = ~F.contains(text, F.lit(literals[0]))
    for x in literals[1:]:
        out = out & ~F.contains(text, F.lit(x))
    return out


def rule_match_count(text: Column, pattern: str, literals: list[str] | None = None) -> Column:
    found = F.regexp_count(text, F.lit(pattern)).cast("bigint")
    return F.when(_lacks(text, literals), F.lit(0).cast("bigint")).otherwise(found) if literals else found


def grammar_corrections(text: Column) -> Column:
    total = None
    for rule_id, pattern, _ in fixed.GRAMMAR_RULES:
        c = rule_match_count(text, pattern, RULE_LITERALS.get(rule_id))
        total = c if total is None else total + c
    return total


def correct_text(text: Column) -> Column:
    """Fold of ``regexp_replace`` over the grammar rules, in rule order.

    The slowest regex is skipped for texts without its word, which no rule before it can make: those change
    blanks and punctuation only and leave a character between any two letters that were apart."""
    out = text
    for rule_id, pattern, repl in fixed.GRAMMAR_RULES:
        changed = F.regexp_replace(out, pattern, repl)
        out = F.when(_lacks(text, RULE_LITERALS[rule_id]), out).otherwise(changed) if rule_id == "TEH_TYPO" else changed
    return out


# Anonymisation marks for a text without them (the essay corpus ships marked;
# this derives comparable marks from raw text so the counters have work).
ANON_RULES = [
    (r"[\w.+-]+@[\w-]+(\.[\w-]+)+", "@PERSON1"),
    (r"\$[0-9]+([.,][0-9]+)?", "@MONEY1"),
    (r"[0-9]+([.,][0-9]+)?%", "@PERCENT1"),
    (r"(19|20)[0-9][0-9]", "@DATE1"),
    (r"[0-9]{1,2}:[0-9]{2}", "@TIME1"),
    (r"[A-Z]{2,}", "@CAPS1"),
]


def anonymize(text: Column) -> Column:
    out = text
    for pattern, repl in ANON_RULES:
        out = F.regexp_replace(out, pattern, repl)
    return out
