"""Fixed values.

FIXED VALUES -- the lists below are data, not logic.  The stop-word list and
the punctuation set are the standard English lists the reference scripts load
from their NLP libraries; the placeholder marks are the anonymisation marks of
the essay corpus.  The lexicons and rules further down are this project's own
small stand-ins for pretrained taggers, sentiment analysers and grammar
checkers, which are not available (see README, "Re-aimed operators").
"""

from __future__ import annotations

# English stop words (the standard NLTK English list, natural order).
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're",
    "you've", "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "she's", "her", "hers", "herself", "it",
    "it's", "its", "itself", "they", "them", "their", "theirs", "themselves",
    "what", "which", "who", "whom", "this", "that", "that'll", "these", "those",
    "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if",
    "or", "because", "as", "until", "while", "of", "at", "by", "for", "with",
    "about", "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when", "where",
    "why", "how", "all", "any", "both", "each", "few", "more", "most", "other",
    "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too",
    "very", "s", "t", "can", "will", "just", "don", "don't", "should", "should've",
    "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn",
    "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn",
    "hasn't", "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't",
    "mustn", "mustn't", "needn", "needn't", "shan", "shan't", "shouldn",
    "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
]

# ASCII punctuation characters, natural order.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Anonymisation marks counted as features (prefix match: "@CAPS1" counts as "@CAPS").
PLACEHOLDERS = [
    ("organization", "@ORGANIZATION"),
    ("caps", "@CAPS"),
    ("person", "@PERSON"),
    ("location", "@LOCATION"),
    ("money", "@MONEY"),
    ("time", "@TIME"),
    ("date", "@DATE"),
    ("percent", "@PERCENT"),
]

# Universal part-of-speech tags that become features, in feature order.
POS_FEATURES = [
    ("noun", "NOUN"), ("adj", "ADJ"), ("pron", "PRON"), ("verb", "VERB"),
    ("cconj", "CCONJ"), ("adv", "ADV"), ("det", "DET"), ("propn", "PROPN"),
    ("num", "NUM"), ("part", "PART"), ("intj", "INTJ"),
]

# The 30 predictors of the score models, in the reference's order.
PREDICTORS = [
    "corrections", "similarity", "token_count", "unique_token_count", "nostop_count", "sent_count",
    "ner_count", "comma", "question", "exclamation", "quotation", "organization", "caps", "person",
    "location", "money", "time", "date", "percent", "noun", "adj", "pron", "verb", "cconj", "adv",
    "det", "propn", "num", "part", "intj",
]

# The 28 features that feature selection looks at: token_count and nostop_count join only for the models.
SELECTION_FEATURES = [
    "corrections", "similarity", "unique_token_count", "sent_count",
    "ner_count", "comma", "question", "exclamation", "quotation", "organization", "caps", "person",
    "location", "money", "time", "date", "percent", "noun", "adj", "pron", "verb", "cconj", "adv",
    "det", "propn", "num", "part", "intj",
]

# The elastic-net search grid.
L1_RATIOS = [0.01, 0.1, 0.5, 0.9]
ALPHAS = [0.01, 0.1, 1.0]

# ---- this project's own small lexicons (re-aimed annotators) -------------

# Closed-class words by tag (matched on the lower-cased token).
POS_WORDS = [
    ("DET", ["the", "a", "an", "this", "that", "these", "those", "every", "each",
             "some", "any", "no", "another", "all", "both", "either", "neither"]),
    ("PRON", ["i", "me", "you", "he", "him", "she", "her", "it", "we", "us", "they",
              "them", "my", "your", "his", "its", "our", "their", "mine", "yours",
              "ours", "theirs", "myself", "yourself", "himself", "herself",
              "itself", "ourselves", "themselves", "who", "whom", "what",
              "which", "someone", "something", "anyone", "anything", "everyone",
              "everything", "nobody", "nothing"]),
    ("CCONJ", ["and", "or", "but", "nor", "yet", "so"]),
    ("PART", ["to", "not", "n't", "'s"]),
    ("INTJ", ["oh", "wow", "hey", "hello", "yes", "ouch", "alas", "hi", "ah", "oops", "well"]),
    ("ADP", ["of", "in", "on", "at", "by", "for", "with", "from", "about", "into",
             "over", "under", "after", "before", "between", "through", "during",
             "without", "within", "against", "among", "upon"]),
    ("AUX", ["is", "are", "was", "were", "be", "been", "being", "am", "have", "has",
             "had", "do", "does", "did", "will", "would", "shall", "should", "can",
             "could", "may", "might", "must"]),
    ("ADV", ["very", "too", "also", "just", "only", "then", "there", "here", "now",
             "never", "always", "often", "again", "soon", "still", "already",
             "almost", "quite", "rather"]),
]

# Open-class fallback, applied in this order after the closed-class words:
#   NUM    a token starting with a digit that matches NUMBER_PATTERN
#   PUNCT  a single character that is not a word character
#   PROPN  a token whose first character is an upper-case letter
#   then, for tokens starting with a lower-case letter, the first matching
#   suffix list below, else NOUN; anything else is X.
NUMBER_PATTERN = r"^[0-9]+([.,][0-9]+)*$"
POS_SUFFIXES = [
    ("ADV", ["ly"]),
    ("VERB", ["ing", "ed", "ize", "ise", "ate"]),
    ("ADJ", ["ous", "ful", "able", "ible", "ive", "ic", "less", "ish", "al"]),
]

# Sentiment lexicon: word -> polarity in [-1, 1].  Written for this project in the manner of public
# English lexicons; many values are rounded averages as such lexicons give them, so results are
# comparable to theirs, not equal.
POLARITY = [
    ("good", 0.7), ("great", 0.8), ("excellent", 1.0), ("best", 1.0), ("better", 0.5),
    ("happy", 0.8), ("love", 0.5), ("nice", 0.6), ("wonderful", 1.0), ("amazing", 0.6),
    ("beautiful", 0.85), ("fun", 0.3), ("interesting", 0.5), ("important", 0.4),
    ("helpful", 0.5), ("positive", 0.23), ("easy", 0.43), ("right", 0.29),
    ("true", 0.35), ("clear", 0.1), ("bad", -0.7), ("worst", -1.0), ("worse", -0.4),
    ("terrible", -1.0), ("awful", -1.0), ("sad", -0.5), ("hate", -0.8),
    ("poor", -0.4), ("wrong", -0.5), ("hard", -0.29), ("difficult", -0.5),
    ("negative", -0.3), ("boring", -1.0), ("stupid", -0.8), ("angry", -0.5),
    ("dangerous", -0.6), ("problem", -0.2), ("fail", -0.5), ("ugly", -0.7),
    ("dead", -0.2),
]

# Words that flip (and damp) the polarity of the next word.
NEGATORS = ["not", "no", "never", "nor", "neither", "nobody", "nothing", "none", "cannot"]
NEGATION_FACTOR = -0.5

# Noun lemmas that suffix rules get wrong.
IRREGULAR_LEMMAS = [
    ("men", "man"), ("women", "woman"), ("children", "child"), ("feet", "foot"),
    ("teeth", "tooth"), ("mice", "mouse"), ("geese", "goose"), ("people", "people"),
    ("news", "news"), ("series", "series"), ("species", "species"), ("bus", "bus"),
    ("gas", "gas"), ("lens", "lens"), ("this", "this"), ("has", "has"), ("was", "was"),
    ("is", "is"), ("his", "his"), ("its", "its"), ("us", "us"), ("yes", "yes"),
]

# Ordered suffix rules for the noun lemmatiser: (regex on the word, replacement).
# Replacement groups are written $1 (Spark); the oracle rewrites them for DuckDB.
LEMMA_RULES = [
    (r"^(\w{2,})ies$", "$1y"),
    (r"^(\w+(?:s|x|z|ch|sh))es$", "$1"),
    (r"^(\w{2,}[^su])s$", "$1"),
]

# Grammar rules: (rule_id, regex, replacement), applied in rule_id order.
GRAMMAR_RULES = [
    ("DOUBLE_SPACE", r" {2,}", " "),
    ("SPACE_BEFORE_PUNCT", r" +([,.;:!?])", "$1"),
    ("MISSING_SPACE_AFTER_COMMA", r",(\p{L})", ", $1"),
    ("TEH_TYPO", r"(^|[^\p{L}])teh([^\p{L}]|$)", "$1the$2"),
    ("COMMA_PERIOD", r",\.", "."),
    ("REPEATED_PUNCTUATION", r"([!?])[!?]+", "$1"),
    ("MISSING_SPACE_AFTER_SENTENCE", r"([.!?])(\p{Lu})", "$1 $2"),
]
