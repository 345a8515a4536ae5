"""DuckDB SQL fragments shared by the oracles (the same definitions as the Spark side)."""

from __future__ import annotations

from scorewright.functions import fixed
from scorewright.functions.text import ENTITY_PATTERN, TERM_PATTERN, TOKEN_PATTERN, WORD_RUN_PATTERN


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def duck_repl(repl: str) -> str:
    """Spark replacement ``$1`` -> RE2 ``\\1``."""
    import re
    return re.sub(r"\$(\d)", r"\\\1", repl)


ESSAYS = r"""essays AS (
  SELECT id, topic, source, text, n_chars, word_count,
         CAST(length(bin(word_count)) AS INTEGER) AS score,
         split_hash,
         CAST(length(bin(word_count)) AS INTEGER) AS rater1,
         CAST(greatest(1, length(bin(word_count)) + split_hash % 3 - 1) AS INTEGER) AS rater2
  FROM (SELECT doc_id AS id, lang AS topic, source, text, n_chars,
               CAST(len(regexp_extract_all(text, '(\S+)', 1)) AS BIGINT) AS word_count,
               ('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':26'), 1, 8))::BIGINT AS split_hash
        FROM documents) d)"""


def split_hash(key: str, seed: int) -> str:
    return f"('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 8))::BIGINT"


def whitespace_words(t: str) -> str:
    return rf"regexp_extract_all({t}, '(\S+)', 1)"


def normalized_words(t: str) -> str:
    return (f"list_filter(string_split_regex(lower(regexp_replace({t}, '[^a-zA-Z]', ' ', 'g')), ' +'), "
            f"lambda w: w <> '')")


def word_tokens(t: str) -> str:
    return f"regexp_extract_all({t}, {q(TOKEN_PATTERN)}, 1)"


def vocabulary_terms(t: str) -> str:
    return f"regexp_extract_all(lower({t}), {q(TERM_PATTERN)}, 1)"


def word_runs(t: str) -> str:
    return f"regexp_extract_all(lower({t}), {q(WORD_RUN_PATTERN)}, 1)"


def strip(s: str) -> str:
    return rf"regexp_replace({s}, '^\s+|\s+$', '', 'g')"


def line_sentences(t: str) -> str:
    return f"list_transform(string_split({t}, chr(10)), lambda x: {strip('x')})"


def literal_count(t: str, needle: str) -> str:
    removed = f"(length({t}) - length(replace({t}, {q(needle)}, '')))"
    return f"CAST({removed} // {len(needle)} AS BIGINT)" if len(needle) > 1 else f"CAST({removed} AS BIGINT)"


def remove_stopwords(words: str) -> str:
    return f"list_filter({words}, lambda w: w NOT IN {in_list(fixed.STOP_WORDS)})"


def lemma(w: str) -> str:
    parts = [f"WHEN {w} = {q(s)} THEN {q(d)}" for s, d in fixed.IRREGULAR_LEMMAS]
    parts += [f"WHEN regexp_matches({w}, {q(p)}) THEN regexp_replace({w}, {q(p)}, {q(duck_repl(r))})"
              for p, r in fixed.LEMMA_RULES]
    return "CASE " + " ".join(parts) + f" ELSE {w} END"


def lemmatize(words: str) -> str:
    return f"list_transform({words}, lambda w: {lemma('w')})"


def clean_corpus(t: str) -> str:
    return f"array_to_string({lemmatize(remove_stopwords(normalized_words(t)))}, ' ')"


def pos_tag(t: str) -> str:
    from scorewright.functions.text import WORD_CHARS
    closed = [w for _, words in fixed.POS_WORDS for w in words]
    which = "CASE " + " ".join(f"WHEN lower({t}) IN {in_list(words)} THEN {q(tag)}" for tag, words in fixed.POS_WORDS) + " END"
    first = f"left({t}, 1)"
    parts = [f"WHEN {first} BETWEEN '0' AND '9' AND regexp_matches({t}, {q(fixed.NUMBER_PATTERN)}) THEN 'NUM'",
             f"WHEN lower({t}) IN {in_list(closed)} THEN {which}",
             f"WHEN length({t}) = 1 AND NOT regexp_matches({t}, {q('[' + WORD_CHARS + ']')}) THEN 'PUNCT'",
             f"WHEN {first} <> lower({first}) THEN 'PROPN'"]
    lower_initial = f"{first} <> upper({first})"
    for tag, sufs in fixed.POS_SUFFIXES:
        cond = " OR ".join(f"ends_with({t}, {q(x)})" for x in sufs)
        parts.append(f"WHEN {lower_initial} AND ({cond}) THEN {q(tag)}")
    parts.append(f"WHEN {lower_initial} THEN 'NOUN'")
    return "CASE " + " ".join(parts) + " ELSE 'X' END"


def pos_tags(tokens: str) -> str:
    return f"list_transform({tokens}, lambda t: {pos_tag('t')})"


def tag_count(tags: str, tag: str) -> str:
    return f"CAST(len(list_filter({tags}, lambda x: x = {q(tag)})) AS BIGINT)"


def entities(t: str) -> str:
    return f"regexp_extract_all({t}, {q(ENTITY_PATTERN)}, 1)"


def polarity_map() -> str:
    return "MAP {" + ", ".join(f"{q(w)}: CAST({p} AS DOUBLE)" for w, p in fixed.POLARITY) + "}"


def sentiment_polarity(t: str) -> str:
    words = normalized_words(t)
    neg = in_list(fixed.NEGATORS)
    scores = (f"list_filter(list_transform(ws, lambda w, i: (CASE WHEN i > 1 AND ws[i - 1] IN {neg} "
              f"THEN {fixed.NEGATION_FACTOR} ELSE 1.0 END) * {polarity_map()}[w]), lambda x: x IS NOT NULL)")
    return (f"(SELECT coalesce(list_sum(sc) / nullif(len(sc), 0), 0.0) "
            f"FROM (SELECT {scores} AS sc FROM (SELECT {words} AS ws)))")


def flesch(t: str) -> str:
    words = normalized_words(t)
    syl = "greatest(1, len(regexp_extract_all(w, '[aeiouy]+')))"
    return (f"(SELECT CASE WHEN len(ws) > 0 THEN 206.835 - 1.015 * (len(ws)::DOUBLE / "
            f"greatest(1, len(regexp_extract_all({t}, '[.!?]+')))::DOUBLE) - 84.6 * "
            f"(list_sum(list_transform(ws, lambda w: {syl}))::DOUBLE / len(ws)::DOUBLE) END "
            f"FROM (SELECT {words} AS ws))")


def rule_count(t: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({t}, {q(pattern)})) AS BIGINT)"


def grammar_corrections(t: str) -> str:
    return "(" + " + ".join(rule_count(t, p) for _, p, _ in fixed.GRAMMAR_RULES) + ")"


def correct_text(t: str) -> str:
    out = t
    for _, p, r in fixed.GRAMMAR_RULES:
        out = f"regexp_replace({out}, {q(p)}, {q(duck_repl(r))}, 'g')"
    return out


def anonymize(t: str) -> str:
    from scorewright.functions.text import ANON_RULES
    out = t
    for p, r in ANON_RULES:
        out = f"regexp_replace({out}, {q(p)}, {q(duck_repl(r))}, 'g')"
    return out
