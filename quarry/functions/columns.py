"""Scalar functions as column expressions. Lengths are in code points; all stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ALNUM_SPLIT = r"[^\p{L}\p{N}]+"
#: Letters with accents and what they fold to.
ACCENTED = "àáâäãåçéèêëîïíìôöóòõùûüúÿñÀÁÂÄÃÅÇÉÈÊËÎÏÍÌÔÖÓÒÕÙÛÜÚ"
PLAIN = "aaaaaaceeeeiiiiooooouuuuynAAAAAACEEEEIIIIOOOOOUUUU"
#: Words that keyword search ignores.
STOP_WORDS = (
    "les des une est que qui quoi dans pour par sur avec sans pas plus mais ont sont elle ils elles nous vous leur leurs "
    "cette ces son ses aux comment quel quelle quels quelles dit fait faire peux peut tu moi the and for with what which "
    "how does this that are from about"
).split()
#: File kinds by extension.
MARKDOWN = "md markdown mdx".split()
TEXT = "txt text rst org adoc csv tsv log tex".split()
CODE = (
    "rs py js mjs cjs ts tsx jsx go java kt kts scala c h cc cpp cxx hpp cs rb php swift m lua r jl hs ml ex exs erl clj dart "
    "zig nim sh bash zsh fish ps1 sql html htm css scss sass vue svelte xml toml yaml yml json ini cfg conf gradle cmake make "
    "mk dockerfile proto graphql"
).split()
CODE_NAMES = ("makefile", "dockerfile", "justfile")
#: Folders, prefixes, fragments and extensions of paths that hold secrets.
SECRET = (
    r"(^|/)(\.ssh|\.gnupg|\.aws|\.kube|\.password-store|\.docker|\.env[^/]*|id_rsa[^/]*|id_ed25519[^/]*|id_ecdsa[^/]*"
    r"|[^/]*credentials[^/]*|[^/]*secret[^/]*|[^/]*\.(pem|key|p12|pfx|kdbx))(/|$)"
)
#: What image tokens and a message's frame count.
IMAGE_TOKENS, MESSAGE_TOKENS = 1000, 4


def tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def message_tokens(text: Column) -> Column:
    return tokens(text) + F.lit(MESSAGE_TOKENS)


def percent(used: Column, total: Column) -> Column:
    """Whole percent, rounded down; 0 of nothing."""
    return F.when(total == 0, F.lit(0)).otherwise(F.floor(used * 100 / F.nullif(total, F.lit(0)))).cast("long")


def fold(text: Column) -> Column:
    """Lower case without accents."""
    plain = F.translate(text, ACCENTED, PLAIN)
    for a, b in (("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return F.lower(plain)


def words(text: Column) -> Column:
    """Runs of letters and digits."""
    return F.filter(F.split(text, ALNUM_SPLIT), lambda w: w != "")


def search_terms(question: Column) -> Column:
    """Prefix terms of a question: long enough or code-like, no stop words, singular, each once, in order.

    Two letters count as code only in upper case, so words are folded after that test.
    """

    def wanted(w: Column) -> Column:
        code = w.rlike("[0-9]") | w.rlike(r"^\p{Lu}+$")
        return (F.length(w) >= 3) | ((F.length(w) == 2) & code)

    lowered = F.transform(F.filter(words(question), wanted), F.lower)
    kept = F.filter(lowered, lambda w: ~w.isin(*STOP_WORDS))
    singular = F.transform(kept, lambda w: F.regexp_replace(w, "^(.{4,})s$", "$1"))
    return F.array_distinct(F.transform(singular, fold))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def names(value: Column) -> Column:
    """A comma-separated list: trimmed, without blanks or repeats."""
    return F.array_distinct(F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != ""))


def title_from(text: Column, most: int = 60) -> Column:
    """The first line with text, cut to `most` characters."""
    first = F.coalesce(F.get(F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)), F.lit(""))
    return F.when(F.length(first) <= most, first).otherwise(F.concat(F.substring(first, 1, most - 1), F.lit("…")))


def label(source: Column, location: Column) -> Column:
    return F.concat_ws(" ", source, F.nullif(location, F.lit("")))


def collection_label(collection: Column, label_: Column, n_collections: int) -> Column:
    """The collection is named only where a search covers several."""
    return F.concat_ws(" › ", collection, label_) if n_collections > 1 else label_


def slug(title: Column) -> Column:
    """A file name: ASCII words in lower case, joined by dashes, 50 characters at most."""
    dashed = F.regexp_replace(F.regexp_replace(fold(title), "[^a-z0-9]+", "-"), "^-", "")
    cut = F.regexp_replace(F.substring(dashed, 1, 50), "-+$", "")
    return F.when(cut == "", F.lit("conversation.md")).otherwise(F.concat(cut, F.lit(".md")))


def cited_numbers(text: Column) -> Column:
    """Numbers in square brackets; a bracket with anything else gives none."""
    groups = F.regexp_extract_all(text, F.lit(r"\[(\s*\d+\s*(?:[,;]\s*\d+\s*)*)\]"), F.lit(1))
    return F.transform(
        F.flatten(F.transform(groups, lambda g: F.split(g, "[,;]"))), lambda n: F.trim(n).cast("long")
    )


def keep_cited(citations: Column, text: Column) -> Column:
    """Citations whose number the text names; all of them if it names none."""
    cited = cited_numbers(text)
    kept = F.filter(citations, lambda c: F.array_contains(cited, c["number"]))
    return F.when(F.size(kept) > 0, kept).otherwise(citations)


def format_count(n: Column) -> Column:
    """Groups of three digits, with a narrow no-break space."""
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(" "))


def format_short(n: Column) -> Column:
    def tenths(unit: int, mark: str) -> Column:
        t = F.floor((n + unit // 20) / (unit // 10)).cast("long")
        return F.concat(F.floor(t / 10).cast("string"), F.lit(","), (t % 10).cast("string"), F.lit(mark))

    return (
        F.when(n < 1_000, n.cast("string"))
        .when(n < 10_000, tenths(1_000, "k"))
        .when(n < 1_000_000, F.concat(F.floor((n + 500) / 1_000).cast("string"), F.lit("k")))
        .otherwise(tenths(1_000_000, "M"))
    )


def format_bytes(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" o"))
    for unit, scale in (("ko", 1 << 10), ("Mo", 1 << 20), ("Go", 1 << 30)):
        value = n / F.lit(scale)
        small = F.replace(F.format_string("%.1f", F.bround(value, 1)), F.lit("."), F.lit(","))
        whole = F.floor(value + 0.5).cast("string")
        out = F.when(n >= scale, F.concat(F.when(value < 10, small).otherwise(whole), F.lit(f" {unit}"))).otherwise(out)
    return out


def format_cost(micros: Column, currency: str, decimals: int | None = None) -> Column:
    """With so many decimals; by default four below one and two from there on."""
    value = micros / 1_000_000
    if decimals is None:
        text = F.when(value < 1, F.format_string("%.4f", value)).otherwise(F.format_string("%.2f", value))
    else:
        text = F.format_string(f"%.{decimals}f", value)
    return F.concat(F.replace(text, F.lit("."), F.lit(",")), F.lit(f" {currency}"))


def ago(seconds: Column) -> Column:
    def of(unit: int) -> Column:
        return F.floor(seconds / unit).cast("string")

    minute, hour, day = 60, 3600, 86400
    return (
        F.when(seconds < minute, F.lit("à l'instant"))
        .when(seconds < hour, F.concat(F.lit("il y a "), of(minute), F.lit(" min")))
        .when(seconds < day, F.concat(F.lit("il y a "), of(hour), F.lit(" h")))
        .when(seconds < 2 * day, F.lit("hier"))
        .when(seconds < 30 * day, F.concat(F.lit("il y a "), of(day), F.lit(" j")))
        .when(seconds < 365 * day, F.concat(F.lit("il y a "), of(30 * day), F.lit(" mois")))
        .otherwise(F.concat(F.lit("il y a "), of(365 * day), F.lit(" an(s)")))
    )


def file_kind(path: Column) -> Column:
    """markdown, text, code, pdf, docx or odt; null if unsupported."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    ext = F.regexp_extract(name, r".\.([^.]+)$", 1)
    return (
        F.when(name.isin(*CODE_NAMES), F.lit("code"))
        .when(ext.isin(*MARKDOWN), F.lit("markdown"))
        .when(ext.isin(*TEXT), F.lit("text"))
        .when(ext.isin(*CODE), F.lit("code"))
        .when(ext.isin("pdf", "docx", "odt"), ext)
    )


def is_secret(path: Column) -> Column:
    return F.lower(path).rlike(SECRET)


def watch_relevant(path: Column) -> Column:
    """No hidden component, no build folder, a supported kind."""
    hidden = path.rlike(r"(^|/)\.[^/]")
    built = path.rlike(r"(^|/)(target|node_modules|__pycache__)(/|$)")
    return ~hidden & ~built & file_kind(path).isNotNull()


def has_all_words(haystack: Column, filter_text: Column) -> Column:
    """Every white-space separated word of the filter occurs, without regard to case."""
    hay = F.lower(haystack)
    return F.forall(F.filter(F.split(F.lower(filter_text), r"\s+"), lambda w: w != ""), lambda w: F.contains(hay, w))


def matches_prefixes(text: Column, query: str) -> Column:
    """Every word of the query begins some word of the text."""
    own = F.transform(words(text), F.lower)
    wanted = [w for w in re.split(r"[\W_]+", query.lower()) if w]
    out = F.lit(bool(wanted))
    for w in map(F.lit, wanted):
        out = out & _any_starts(own, w)
    return out


def _any_starts(terms: Column, prefix: Column) -> Column:
    return F.exists(terms, lambda t: F.startswith(t, prefix))


#: Names that decode_entities knows.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "eacute": "é", "egrave": "è", "ecirc": "ê", "agrave": "à",
    "ccedil": "ç", "ocirc": "ô", "ugrave": "ù", "icirc": "î", "laquo": "«", "raquo": "»", "hellip": "…", "mdash": "—", "ndash": "–",
    "rsquo": "’", "lsquo": "‘", "euro": "€",
}


def decode_entities(text: Column) -> Column:
    """Named entities and numeric references of at most ten characters between & and ;, from left to right; others stay."""
    known = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def decoded(part: Column) -> Column:
        name = F.regexp_extract(part, r"^([^;]{1,10});", 1)
        hexadecimal = F.regexp_extract(name, r"^#[xX]\+?([0-9a-fA-F]+)$", 1)
        decimal = F.regexp_extract(name, r"^#\+?([0-9]+)$", 1)
        point = F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10)).when(decimal != "", decimal).cast("long")
        valid = (point < 0xD800) | ((point > 0xDFFF) & (point <= 0x10FFFF))
        # the decoder takes U+FEFF as a byte order mark
        sign = F.when(point == 0xFEFF, F.lit("\ufeff")).when(valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
        found = F.coalesce(F.try_element_at(known, name), sign)
        rest = F.substring(part, F.length(name) + 2, F.length(part))
        return F.when(found.isNotNull(), F.concat(found, rest)).otherwise(F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), decoded), ""))


def html_title(html: Column) -> Column:
    """The text of <title> with its entities decoded; null if empty."""
    raw = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.nullif(decode_entities(raw), F.lit(""))


def markdown_heading(line: Column) -> Column:
    """(level, title) of an ATX heading; null otherwise."""
    at = r"^\s*(#{1,6}) (.*)$"
    title = F.trim(F.regexp_extract(line, at, 2))
    return F.when(
        line.rlike(at) & (title != ""), F.struct(F.length(F.regexp_extract(line, at, 1)).alias("level"), title.alias("title"))
    )


def error_message(body: Column) -> Column:
    """error.message, else error, else the first 200 characters of the body."""
    own = F.get_json_object(body, "$.error.message")
    return F.coalesce(own, F.get_json_object(body, "$.error"), F.substring(F.trim(body), 1, 200))


def exposed_name(server: Column, tool: Column) -> Column:
    return F.substring(F.regexp_replace(F.concat_ws("_", server, tool), "[^A-Za-z0-9_-]", "_"), 1, 64)


def truncated(text: Column, most: int, mark: str = "\n[…]") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def fenced(text: Column) -> Column:
    """In a code fence longer than any inside."""
    runs = F.transform(F.split(text, "\n"), lambda x: F.length(F.regexp_extract(x, r"^\s*(`*)", 1)))
    fence = F.repeat(F.lit("`"), F.greatest(F.array_max(runs), F.lit(2)) + 1)
    return F.concat(fence, F.lit("\n"), F.rtrim(text), F.lit("\n"), fence)


def is_loopback(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z]+://(\[[^\]]*\]|[^/:?#]*)", 1).isin("localhost", "127.0.0.1", "[::1]", "0.0.0.0")
