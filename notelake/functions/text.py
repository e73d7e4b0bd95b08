"""Text functions as column expressions: they stay in the JVM and need no Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic in a question.
STOPWORDS = (
    "a an and are as at be best between but by can do does doing done "
    "explain for from get gets getting handle handled handles has have how in into is it "
    "its me my of on or practices should so than that the their them then there these "
    "they this to use used uses using vs was way we what when where which while who why "
    "will with work working works would you your"
).split()

# Letters that a slug spells out; any other character parts words.
TRANSLITERATION = {
    "ç": "c", "ğ": "g", "ı": "i", "ö": "o", "ş": "s", "ü": "u",
    "á": "a", "à": "a", "â": "a", "ä": "a", "å": "a", "ã": "a",
    "é": "e", "è": "e", "ê": "e", "ë": "e",
    "í": "i", "ì": "i", "î": "i", "ï": "i",
    "ó": "o", "ò": "o", "ô": "o", "õ": "o",
    "ú": "u", "ù": "u", "û": "u",
    "ñ": "n", "ß": "ss", "æ": "ae", "ø": "o",
    "+": "plus", "&": "and", "#": "sharp",
}
MAX_SLUG = 80

# Phrases that a note must not hold, in the order in which the first is reported.
BANNED_PHRASES = [
    "in today's fast-paced world",
    "it's important to note that",
    "it is important to note that",
    "let's dive in",
    "in conclusion",
    "game changer",
    "game-changer",
    "cutting-edge",
    "cutting edge",
    "leverage",
    "utilize",
    "delve into",
    "unlock the power of",
    "unlock the potential of",
    "seamlessly",
    "robust and scalable",
    "in the realm of",
    "at the end of the day",
    "when it comes to",
    "it goes without saying",
    "needless to say",
    "as an ai language model",
]

# Patterns of code, links, citations and conclusions.
CODE = r"(?s)```.*?```|`[^`\n]*`"
WIKILINK = r"\[\[([^\]\[|#]+)(?:#[^\]\[|]*)?(?:\|[^\]\[]*)?\]\]"
CONCLUSION = r"(?i)\bwe (established|decided|concluded|agreed) that\b[^.\n]*[.\n]?"
SLUG = r"^[a-z0-9]+(-[a-z0-9]+)*$"
SOURCE_EXTENSIONS = [".java", ".ts", ".tsx", ".js", ".jsx", ".kt"]


BLANKS = " \t\n\x0b\x0c\r"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def lowered(text: Column) -> Column:
    """Lower case as simple mapping does it: the dotted capital I and the final sigma need care."""
    return F.translate(F.lower(F.translate(text, "İ", "i")), "ς", "σ")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of more than one byte, in order."""
    return F.filter(F.split(lowered(text), r"[^\p{L}\p{Nd}]+"), lambda t: F.octet_length(t) > 1)


def terms(text: Column) -> Column:
    """Sorted distinct tokens without the stopwords."""
    return F.sort_array(F.array_distinct(F.array_except(tokens(text), F.array(*map(F.lit, STOPWORDS)))))


def token_set(values: Column) -> Column:
    """Distinct tokens of a list of values: spring-boot holds spring and boot."""
    return F.array_distinct(F.flatten(F.transform(F.coalesce(values, F.expr("cast(array() as array<string>)")), tokens)))


def shingles(text: Column) -> Column:
    """Lower-case words for similarity; letters and all numbers, single characters kept."""
    return F.filter(F.split(lowered(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def slug(title: Column) -> Column:
    """Kebab-case identity of a title; past the limit it ends before the last, possibly cut, word."""
    text = lowered(title)
    single = {k: v for k, v in TRANSLITERATION.items() if len(v) == 1}
    text = F.translate(text, "".join(single), "".join(single.values()))
    for k, v in TRANSLITERATION.items():
        if len(v) > 1:
            text = F.replace(text, F.lit(k), F.lit(v))
    whole = F.btrim(F.regexp_replace(text, "[^a-z0-9]+", "-"), F.lit("-"))
    cut = F.substring(whole, 1, MAX_SLUG)
    return F.when(F.length(whole) > MAX_SLUG, F.btrim(F.when(F.locate("-", cut) > 1, F.regexp_replace(cut, "-[^-]*$", "")).otherwise(cut), F.lit("-"))).otherwise(whole)


def is_slug(value: Column) -> Column:
    return value.rlike(SLUG)


def strip_code(body: Column) -> Column:
    return F.regexp_replace(body, CODE, " ")


def wikilinks(body: Column) -> Column:
    """Targets of [[target#heading|alias]] outside code, in order."""
    return F.filter(F.transform(F.regexp_extract_all(strip_code(body), F.lit(WIKILINK), F.lit(1)), lambda t: stripped(t)), lambda t: t != "")


def fenced_blocks(body: Column) -> Column:
    """array<struct<lang, code>>: info string and content of each fenced block."""
    blocks = F.filter(F.regexp_extract_all(body, F.lit(CODE), F.lit(0)), lambda b: b.startswith("```"))
    inner = lambda b: F.substring(b, F.lit(4), F.length(b) - 6)
    return F.transform(
        blocks,
        lambda b: F.struct(
            F.lower(F.split_part(F.trim(F.split_part(inner(b), F.lit("\n"), F.lit(1))), F.lit(" "), F.lit(1))).alias("lang"),
            F.regexp_replace(inner(b), r"^[^\n]*\n?", "").alias("code"),
        ),
    )


def link_key(target: Column) -> Column:
    text = F.trim(F.regexp_replace(target, r"^\./", ""))
    return F.lower(F.btrim(F.regexp_replace(text, r"\.md$", ""), F.lit("/")))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def first_banned(body: Column) -> Column:
    """The first banned phrase in the prose of a body, or null."""
    prose = F.lower(strip_code(body))
    found = F.try_element_at(F.filter(F.array(*map(F.lit, BANNED_PHRASES)), lambda p: F.contains(prose, p)), F.lit(1))
    # plain searches of the whole body first: most notes hold no phrase
    low = F.lower(body)
    some = F.contains(low, F.lit(BANNED_PHRASES[0]))
    for p in BANNED_PHRASES[1:]:
        some = some | F.contains(low, F.lit(p))
    return F.when(some, found)


def conclusions(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(CONCLUSION), F.lit(0)), lambda t: stripped(t))


def segments(path: Column) -> Column:
    """Parts of a path without empty parts and dots."""
    return F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda s: (s != "") & (s != "."))


def is_subsequence(want: Column, have: Column) -> Column:
    """All of ``want`` occurs in ``have`` in order, whatever the case."""
    size = F.size(want)
    walked = F.aggregate(have, F.lit(0), lambda i, h: F.when((i < size) & (F.lower(h) == F.lower(F.get(want, i))), i + 1).otherwise(i))
    return walked == size


def span_ref(span: Column) -> Column:
    """struct<raw, kind, path, symbol, line> of an inline code span; null if it cites nothing."""
    s = F.trim(span)
    line = F.regexp_extract(s, r"(?::|#L)(\d{1,6})$", 1)
    bare = F.regexp_replace(s, r"(?::|#L)\d{1,6}$", "")
    extension = F.lower(F.regexp_extract(bare, r"(\.[^.]*)$", 1))
    symbol = F.concat_ws(".", F.nullif(F.regexp_extract(bare, SYMBOL, 1), F.lit("")), F.nullif(F.regexp_extract(bare, SYMBOL, 2), F.lit("")))
    is_path = extension.isin(SOURCE_EXTENSIONS)
    sound = (s != "") & ~s.rlike(r"[ \t\"'|$<>*?]")
    row = lambda kind, path, name, at: F.struct(s.alias("raw"), F.lit(kind).alias("kind"), path.alias("path"), name.alias("symbol"), at.alias("line"))
    number = F.when(line != "", line.cast("int")).otherwise(F.lit(0))
    return F.when(sound & is_path, row("path", F.translate(bare, "\\", "/"), F.lit(""), number)).when(
        sound & ~F.contains(bare, F.lit("/")) & (symbol != ""), row("symbol", F.lit(""), symbol, F.lit(0))
    )


SYMBOL = r"^([A-Z][A-Za-z0-9_]{2,})(?:\.([A-Za-z_][A-Za-z0-9_]*))?(?:\(\))?$"


def body_refs(body: Column) -> Column:
    """Citations in inline code spans, the first of each spelling, in order."""
    # equal spans are equal citations once trimmed, so the distinct spans in order are the first of each
    spans = F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit("`([^`\\n]{1,200})`"), F.lit(1)), lambda s: F.trim(s)))
    return F.filter(F.transform(spans, span_ref), lambda r: r.isNotNull())


def canonical_ref(entry: Column) -> Column:
    """struct<repo, path, symbol, line> of repo:path[:line][#symbol]; null without a repo and a path."""
    head, symbol = F.split_part(entry, F.lit("#"), F.lit(1)), F.when(F.contains(entry, F.lit("#")), F.regexp_replace(entry, "^[^#]*#", "")).otherwise(F.lit(""))
    repo = F.trim(F.split_part(head, F.lit(":"), F.lit(1)))
    rest = F.when(F.contains(head, F.lit(":")), F.regexp_replace(head, "^[^:]*:", "")).otherwise(F.lit(""))
    line, path = F.regexp_extract(rest, r":(\d{1,6})$", 1), F.regexp_replace(rest, r":\d{1,6}$", "")
    number = F.when(line != "", line.cast("int")).otherwise(F.lit(0))
    return F.when((repo != "") & (path != ""), F.struct(repo.alias("repo"), path.alias("path"), symbol.alias("symbol"), number.alias("line")))


def host(url: Column) -> Column:
    """host:port of a URL, or the whole if it has none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)
    return F.when(found != "", found).otherwise(url)


def short_hash(text: Column, n: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)
