"""Column functions on report text. All of them are native expressions and pass NULL through."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the collection's tools see it: Unicode white space and the four separator control characters.
SPACE = r"(?U)[\s\x1c-\x1f]"

# Unit spellings and their tokens, applied in this order.
UNIT_TOKENS = [("°C", " <degC>"), ("l/m²", " <l_per_sqm>"), ("km/h", " <kmh>"), ("%", " <percent>")]
# Unit patterns of the tagging variant, applied in this order.
UNIT_TAGS = [
    (r"(°[ ]*C|Grad)", " <temp>"), (r"[ ]*km/h", " <velocity>"), (r"[ ]*%", " <percentile>"), (r"[ ]*l/m²", " <rainfall>"),
]
# Tags that entity masking leaves alone.
PROTECTED_TAGS = ["<city>", "<temp>", "<date>", "<velocity>", "<percentile>", "<rainfall>"]
# Emoji and symbol ranges removed by the full clean.
EMOJI_RANGES = [
    "1F600-1F64F", "1F300-1F5FF", "1F680-1F6FF", "1F1E0-1F1FF", "2500-2BEF", "2702-27B0", "24C2-1F251", "1F926-1F937",
    "10000-10FFFF", "2640-2642", "2600-2B55", "200D", "23CF", "23E9", "231A", "FE0F", "3030",
]
# Words that arrive with soft hyphens.
SOFT_HYPHEN_WORDS = [
    ("Aben­teuer", "Abenteuer"), ("Regen­schauer", "Regenschauer"), ("grin­sen", "grinsen"),
    ("deli­kat­en", "delikaten"),
]
# Openings that announce an introductory paragraph.
INTRO_OPENINGS = ["Hier", "Witziger"]
CITY = "<city>"
GUST_WORD = "Böe"
INTEGER = r"-?[0-9]+"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def swap(text: Column, old: str | Column, new: str | Column) -> Column:
    """Plain substring replacement."""
    return F.replace(text, F.lit(old) if isinstance(old, str) else old, F.lit(new) if isinstance(new, str) else new)


def words(text: str | Column) -> Column:
    """Tokens between runs of white space, without empty ones."""
    return F.filter(F.split(col(text), SPACE + "+"), lambda w: w != "")


def strip(text: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col(text), "^" + SPACE + "+", ""), SPACE + "+$", "")


def drop_gust_sentences(text: str | Column) -> Column:
    """Remove the sentences (parts between full stops) that speak of gusts."""
    return F.array_join(F.filter(F.split(col(text), r"\.", -1), lambda s: ~s.contains(GUST_WORD)), ".")


def mask_city(text: str | Column, city: str | Column) -> Column:
    """Every plain occurrence of the city becomes ``<city>``; an empty city changes nothing."""
    return swap(col(text), F.coalesce(col(city), F.lit("")), CITY)


def unmask_city(text: str | Column, city: str | Column) -> Column:
    return swap(col(text), CITY, col(city))


def unit_tokens(text: str | Column, units: Sequence[tuple[str, str]] = UNIT_TOKENS) -> Column:
    out = col(text)
    for unit, token in units:
        out = swap(out, unit, token)
    return out


def mask_city_and_units(text: str | Column, city: str | Column) -> Column:
    """City as a whole word, unit tags, then clean-up of markup, spaces and line breaks."""
    text, city = col(text), col(city)
    pattern = F.concat(F.lit(r"(?U)\b\Q"), swap(city, r"\E", r"\E\\E\Q"), F.lit(r"\E\b"))
    out = F.when(city.isNull() | (city == ""), text).otherwise(F.regexp_replace(text, pattern, F.lit(CITY)))
    for unit, tag in UNIT_TAGS:
        out = F.regexp_replace(out, unit, tag)
    for old, new in [("*", ""), (" .", "."), ("\n\n", "\n"), ("\n ", "\n")]:
        out = swap(out, old, new)
    return F.regexp_replace(out, " +", " ")


def mask_dates(text: str | Column) -> Column:
    return F.regexp_replace(col(text), r"(?U)\b\d{1,2}\.\d{1,2}\.\d{4}\b", "<date>")


def tagged_text(text: str | Column, city: str | Column) -> Column:
    return mask_dates(mask_city_and_units(text, city))


def free_length(text: str | Column) -> Column:
    """Characters outside the protected tags; entity masking is skipped when there are 20 or fewer."""
    return F.length(F.regexp_replace(col(text), "|".join(PROTECTED_TAGS), ""))


def remove_punctuation(text: str | Column) -> Column:
    return F.translate(col(text), ".,;!?:", "")


def collapse_spaces(text: str | Column) -> Column:
    return F.regexp_replace(col(text), "[ ]{2,}", " ")


def join_minus(text: str | Column) -> Column:
    return F.regexp_replace(col(text), " (-) ([0-9]+)", " $1$2")


def tidy(text: str | Column) -> Column:
    """Post-processing of generated text: single spaces, joined minus signs, no outer white space."""
    return strip(join_minus(collapse_spaces(text)))


def display_text(text: str | Column, city: str | Column) -> Column:
    return swap(unmask_city(tidy(text), city), " <degC>", "°C")


def profiling_text(text: str | Column, city: str | Column) -> Column:
    """Text as the corpus statistics see it: city and degrees masked, punctuation deleted."""
    return F.regexp_replace(swap(mask_city(text, city), "°C", " <degC>"), "[.,;:?!]", "")


def similarity_text(text: str | Column, city: str | Column) -> Column:
    """Text as the term weights see it: city masked, degrees and punctuation deleted, numbers unified."""
    out = F.regexp_replace(swap(mask_city(text, city), "°C", ""), "[.,;:?!]", "")
    return F.regexp_replace(out, INTEGER, "<number>")


def numbers(text: str | Column) -> Column:
    """All integers of a text, as strings."""
    return F.regexp_extract_all(col(text), F.lit("(" + INTEGER + ")"), F.lit(1))


def file_identifier(name: str | Column) -> Column:
    """Identifier inside a file name: the last dash part, up to its first underscore."""
    return F.substring_index(F.substring_index(col(name), "-", -1), "_", 1)


def title_case(text: str | Column) -> Column:
    """Upper case after every non-letter, lower case otherwise (``initcap`` only looks at spaces)."""
    pieces = F.regexp_extract_all(col(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    cased = F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2)))))
    return F.array_join(cased, "")


def drop_intro(text: str | Column, city: str | Column) -> Column:
    """Remove the first paragraph when the text opens like an introduction and that paragraph closes like one."""
    text, city = col(text), col(city)
    parts = F.split(text, "\n\n", -1)
    first = strip(F.get(parts, F.lit(0)))
    opened = F.lit(False)
    for opening in INTRO_OPENINGS:
        opened = opened | text.startswith(opening)
    closes = first.endswith(":") | F.endswith(first, city)
    rest = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "\n\n")
    return F.when(opened & (F.size(parts) > 1) & closes, rest).otherwise(text)


def strip_emoji(text: str | Column) -> Column:
    ranges = "".join("-".join("\\x{%s}" % end for end in r.split("-")) for r in EMOJI_RANGES)
    return F.regexp_replace(col(text), f"[{ranges}]+", "")


def clean_steps(city: Column, fix_ranges: bool = False) -> list:
    """The full clean as an ordered list of Column functions, one per step."""
    def plain(old, new):
        return lambda t: swap(t, old, new)

    def regex(pattern, new):
        return lambda t: F.regexp_replace(t, pattern, new)

    # What stands before a sign is looked back at and not matched: a search that begins at every letter of a word takes time with the
    # square of its length. ``(?!\G)``: it does not belong to the match before.
    # The backslash written by three steps is turned into a quote further down, which doubles that quote; kept as is.
    return [
        lambda t: mask_city(t, city),
        *[plain(o, n) for o, n in [("‚", ","), ("**", ""), ("*", ""), ("„", '"'), ("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'")]],
        regex("°( *)[C]?", "°C"),
        regex("(?<=[0-9]) +°C", "°C"),
        plain("–", "—"),
        plain(" - ", "—"),
        plain("…", ""),
        strip_emoji,
        lambda t: drop_intro(t, city),
        regex("[ ]+[\n]{2,}", "\n\n"),
        regex("[ ]{2,}", " "),
        regex("( +)'([A-Za-z0-9]+)", r'$1 \\"$2'),
        regex("(?<=[A-Za-z0-9])'( +)", r'\\" $1'),
        regex(r"(?<=[0-9])(?!\G)-([0-9]+)" if fix_ranges else r"(?<=[0-9])(?!\G)-([0-9])+", " bis $1"),
        regex("( +)-([A-Za-z]+)", "-$2"),
        regex("(?<=[A-Za-z])- +", "-"),
        regex(r"(?<=[a-z])(?!\G)'-([A-Za-z]+)", r'\\"-$1'),
        plain("´", "'"),
        *[plain(o, n) for o, n in SOFT_HYPHEN_WORDS],
        plain("<<", '"'),
        plain(">>", '"'),
        plain("\\", '"'),
        plain("_", '"'),
        plain("—", " — "),
        regex('"([A-Za-z0-9 ]+)"-([A-Za-z0-9]+)', "$1 $2"),
        lambda t: unmask_city(t, city),
        strip,
        regex('^"+|"+$', ""),
        strip,
    ]


def clean_rewritten(text: str | Column, city: str | Column, fix_ranges: bool = False) -> Column:
    """Ordered clean of rewritten reports."""
    out = col(text)
    for step in clean_steps(col(city), fix_ranges):
        out = step(out)
    return out


def rouge_tokens(text: str | Column, letters: str = "a-z0-9") -> Column:
    """Lower case, everything outside ``letters`` separates tokens (the public scorer keeps ASCII only)."""
    return F.filter(F.split(F.lower(col(text)), f"[^{letters}]+"), lambda w: w != "")


def bleu_tokens(text: str | Column) -> Column:
    """International 13a tokens: symbols stand alone, a stop or comma splits unless between digits."""
    out = col(text)
    for old, new in [("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]:
        out = swap(out, old, new)
    out = F.concat(F.lit(" "), out, F.lit(" "))
    out = F.regexp_replace(out, r"([{-~\[-` -&(-+:-@/])", " $1 ")
    out = F.regexp_replace(out, r"([^0-9])([.,])", "$1 $2 ")
    out = F.regexp_replace(out, r"([.,])([^0-9])", " $1 $2")
    out = F.regexp_replace(out, r"([0-9])(-)", "$1 $2 ")
    return words(out)


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` neighbouring tokens, joined by a space."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
