"""Column expressions: text, hashes, scores. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What words are kept, and the bands of scores.
WORD_CLASS = r"[\p{L}\p{N}_]"
MIN_WORD = 4
STOP_WORDS = (
    "de", "het", "een", "van", "in", "is", "en", "op", "dat", "te", "zijn", "voor", "met", "aan", "er", "maar", "ze", "bij", "ook", "als", "al", "naar", "om", "dit", "niet", "meer", "was",
    "we", "je", "ik", "hij", "had", "door", "uit", "zo", "over", "dan", "wat", "nog", "heeft", "wordt", "worden", "zich", "heb", "kunnen", "gaan", "komen", "zal", "zou", "hun", "hen", "die",
    "werd", "deze", "nu", "mijn", "jouw", "haar", "ons", "onze", "the", "a", "to", "of", "and", "for", "on", "with",
)
ORIGINAL_SOUND = ("original sound", "son original", "geluid van", "origineel geluid", "оригинальный звук", "звук", "صوت", "صدای اصلی")
HIGH, MEDIUM = 0.60, 0.30

# What makes a free-text query a hypothesis, in Dutch and, besides, in English.
HYPOTHESIS_NL = (
    r"\bbestaat\b", r"\bklopt\b", r"\bis het zo dat\b", r"\bzou\b.*\b(bubbel|cluster)\b", r"\bcombinatie\b", r"\btegelijk(ertijd)?\b", r"\b(én|zowel).+\bals\b", r"\?\z", r"\bwaar of niet\b",
    r"\bsamen\b.+\bbubbel\b", r"\bblijken\b", r"\bveronderstelling\b", r"\bthese\b", r"\bhypothese\b", r"\bdie ook\b", r"\bmaar ook\b", r"\ben ook\b", r"\btegelijk\b",
)
HYPOTHESIS_EN = (
    r"\bexist[s]?\b.*\bbubble\b", r"\bis it true\b", r"\bdo.*both\b", r"\bsame bubble\b", r"\?\z", r"\bhypothesis\b", r"\bsuppose\b", r"\bwho also\b", r"\bbut also\b", r"\band also\b",
    r"\bat the same time\b", r"\bcombination\b", r"\bcoexist\b", r"\boverlap\b",
)


def query_mode(text: Column, lang: str = "nl") -> Column:
    """Whether a free-text query states a hypothesis or asks for a match."""
    out = F.lit(False)
    for pattern in HYPOTHESIS_NL + (HYPOTHESIS_EN if lang == "en" else ()):
        out = out | text.rlike(f"(?iu){pattern}")
    return F.when(out, "hypothesis").otherwise("match")


def original_sound(title: Column) -> Column:
    """True for the title of a sound that an account made itself."""
    return any_substring(title, list(ORIGINAL_SOUND))


def falsy_to(col: Column, default: Column) -> Column:
    """``default`` where a value is null, zero or empty."""
    text = col.cast("string")
    return F.when(text.isNull() | text.isin("", "0", "0.0", "false"), default).otherwise(col)


def caption_words(text: Column) -> Column:
    """Words of a caption: tags, mentions and links stripped in that order, then marks; four letters at least, no stop words."""
    t = F.regexp_replace(text, f"#{WORD_CLASS}+", "")
    t = F.regexp_replace(t, f"@{WORD_CLASS}+", "")
    t = F.regexp_replace(t, r"https?://\S+", "")
    return plain_words(t)


def plain_words(text: Column) -> Column:
    words = F.split(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " "), r"\s+")
    return F.transform(F.filter(words, lambda w: (F.length(w) >= MIN_WORD) & ~F.lower(w).isin(*STOP_WORDS)), F.lower)


def mentions(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"@([\p{L}\p{N}_.]+)"), 1))


def url_username(url: Column) -> Column:
    """The last path segment without leading @; null unless it has no dot or is longer than two."""
    name = F.regexp_replace(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1), "^@+", "")
    return F.when(((name != "") & ~name.contains(".")) | (F.length(name) > 2), name)


def fingerprint(tags: Column) -> Column:
    """The first eight hex digits of the md5 of the first five tags, sorted and joined."""
    return F.substring(F.md5(F.array_join(F.array_sort(F.slice(tags, 1, 5)), ",")), 1, 8)


def confidence_label(score: Column) -> Column:
    return F.when(score >= HIGH, "HIGH").when(score >= MEDIUM, "MEDIUM").otherwise("LOW")


def macro_confidence(n: Column, density: Column) -> Column:
    return F.round(F.least(F.lit(1.0), (n - 8) / 25) * F.least(F.lit(1.0), density / 0.4), 3)


def sub_confidence(n: Column, density: Column, top_lift: Column, depth: Column) -> Column:
    one = F.lit(1.0)
    return F.round(F.least(one, (n - 3) / 22) * F.least(one, density / 0.5) * F.least(one, top_lift / 8) * F.pow(F.lit(0.85), depth - 1), 3)


def lift(in_group: Column, group: Column, in_rest: Column, rest: Column) -> Column:
    return (in_group / group) / (in_rest / F.greatest(rest, F.lit(1)) + 0.01)


def normalised_difference(x: Column, y: Column) -> Column:
    return F.when(x + y == 0, 0.0).otherwise((x - y) / (x + y))


def frontier_score(followers: Column, novelty: Column) -> Column:
    reach = F.when(followers > 0, followers).otherwise(10000)
    return F.pow(F.log10(reach), 2) * (0.7 + 0.3 * novelty)


def label_hint(tags: Column) -> Column:
    return F.when(F.size(tags) == 0, "unclear").otherwise(F.array_join(F.transform(F.slice(tags, 1, 3), lambda t: F.concat(F.lit("#"), t)), " / "))


def path_prefixes(path: Column) -> Column:
    """Each prefix of an array path, joined by the middle dot."""
    return F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.array_join(F.slice(path, 1, i), "·"))


def abbreviated(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.concat(F.format_number(n / 1_000_000, 1), F.lit("M"))).when(n >= 1000, F.concat(F.format_number(n / 1000, 0), F.lit("K"))).otherwise(n.cast("string"))


def any_substring(text: Column, signals: list[str]) -> Column:
    """True if the lower-cased text contains any of the signals."""
    out = F.lit(False)
    for s in signals:
        out = out | F.lower(text).contains(s)
    return out
