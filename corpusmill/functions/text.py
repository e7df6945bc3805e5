"""Text functions as column expressions.

Patterns carry (?U) where white space, letters or word boundaries are meant in the Unicode sense. Every function takes and returns columns, and
null in gives null out unless its docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_STATED = "Not stated"


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), where x is computed once a row however often use names it; a column named twice is else computed twice."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def begins_with(x: Column, mark: str) -> Column:
    """Whether a text begins with a mark, apart from white space."""
    return x.rlike(rf"(?U)\A\s*\Q{mark}\E")


def word_count(x: Column) -> Column:
    """Words between white space; 0 for null and blank text."""
    t = strip(F.coalesce(x, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"(?U)\s+"))).cast("long")


def words(x: Column) -> Column:
    """The words of a text; an empty array for null and blank text."""
    t = strip(F.coalesce(x, F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"(?U)\s+"))


def strip(x: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def squeeze(x: Column) -> Column:
    """Runs of white space become one space, ends are stripped."""
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def tokens(x: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; accented letters split."""
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), 0)


def clean_profile_a(x: Column) -> Column:
    """Soft hyphens and NULs out, hyphenated line ends joined, blanks squeezed, at most one blank line, stripped."""
    x = F.regexp_replace(x, "[\u00ad\u0000]", "")
    x = F.regexp_replace(x, r"(?U)(\w)-\n(\w)", "$1$2")
    x = F.regexp_replace(x, r"[ \t\f\x0B]+", " ")
    x = F.regexp_replace(x, r" *\n *", "\n")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def clean_profile_b(x: Column) -> Column:
    """NULs out, hyphenated line ends joined, spaces and tabs squeezed, three or more line breaks collapsed, stripped."""
    x = F.regexp_replace(x, "\u0000", "")
    x = F.regexp_replace(x, r"(?U)(\w)-\n(\w)", "$1$2")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    return strip(F.regexp_replace(x, r"(?U)\n\s*\n\s*(\n\s*)+", "\n\n"))


def join_pages(pages: Column) -> Column:
    """Pages (array) under numbered heads; blank ones are left out but keep their number."""
    numbered = F.transform(pages, lambda p, i: F.struct(strip(F.coalesce(p, F.lit(""))).alias("t"), (i + 1).alias("i")))
    kept = F.filter(numbered, lambda p: p["t"] != "")
    return F.array_join(F.transform(kept, lambda p: F.concat(F.lit("[Page "), p["i"].cast("string"), F.lit("]\n"), p["t"])), "\n\n")


def slug(x: Column, size: int = 48, default: str = "pattern") -> Column:
    """Runs of anything but a-z and 0-9 become hyphens, none at the ends, at most size characters."""
    dashed = F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-")
    cut = F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, size)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(default))


def flatten(x: Column, is_array: bool = False) -> Column:
    """One line of text; a list is joined by commas, null is empty."""
    x = F.array_join(x, ", ") if is_array else x.cast("string")
    return F.coalesce(squeeze(x), F.lit(""))


def sentences(x: Column) -> Column:
    """Split after full stops, exclamation and question marks that white space follows."""
    return F.split(strip(x), r"(?U)(?<=[.!?])\s+")


def sentence_ends(x: Column) -> Column:
    return F.size(F.regexp_extract_all(x, F.lit(r"(?U)[.!?](\s|\z)"), 0)).cast("long")


def first_word(x: Column) -> Column:
    """Lower-case text before the first separator; empty where it begins with one."""
    return F.lower(F.element_at(F.split(x, r"(?U)[\s,.:;]+", 2), 1))


def strip_quotes(x: Column, marks: str = '"') -> Column:
    return F.regexp_replace(x, f"^[{marks}]+|[{marks}]+\\z", "")


def strip_bullet(x: Column, more: str = "") -> Column:
    """Without list marks, numbering (and characters more) in front."""
    return F.regexp_replace(x, rf"(?U)^[-*\d.)\s{more}]+", "")


def normalise_reason(x: Column) -> Column:
    """Quoted parts and numbers replaced, so that like reasons are equal."""
    return F.regexp_replace(F.regexp_replace(x, "'[^']*'", "'X'"), r"\d+", "N")


def rough_tokens(x: Column) -> Column:
    """A token estimate: words, numbers and marks count one each, words of over six letters one per four letters begun."""
    pieces = F.regexp_extract_all(x, F.lit(r"(?U)[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]"), 0)
    cost = lambda p: F.when(p.rlike("^[A-Za-z]{7,}$"), F.ceil(F.length(p) / 4)).otherwise(F.lit(1)).cast("long")
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda total, p: total + cost(p))


def escape_cell(x: Column, profile: str = "a") -> Column:
    """A table cell's text: profile a escapes bars, b writes slashes; empty becomes the sentinel."""
    cell = F.replace(flatten(x), F.lit("|"), F.lit("\\|" if profile == "a" else "/"))
    return F.when(cell == "", F.lit(NOT_STATED)).otherwise(cell)


def fill_template(template: str | Column, values: dict[str, Column], last: str | None = None) -> Column:
    """{{KEY}} replaced by columns; the value named last goes in last, so that marks inside it stay as they are."""
    out = F.lit(template) if isinstance(template, str) else template
    for key in sorted(values, key=lambda k: k == last):
        out = F.replace(out, F.lit("{{" + key + "}}"), F.coalesce(values[key].cast("string"), F.lit("")))
    return out


def strip_think(x: Column) -> Column:
    """Without think-tagged parts; null is empty."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"(?s)<think>.*?</think>", "")


def trim_to_limit(x: Column, limit: int) -> Column:
    """Struct(text, mode): within limit words as it is (mode none); else whole sentences from the start that fit (sentence); else the first
    limit words, marks at the end taken off and a full stop set (hard)."""
    parts = sentences(x)
    counts = F.transform(parts, word_count)
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("fit"))
    add = lambda s, c: F.struct((s["total"] + c).alias("total"), (s["fit"] + (s["total"] + c <= limit).cast("int")).alias("fit"))
    most = F.greatest(F.aggregate(counts, start, add)["fit"], F.lit(1))
    kept = F.array_join(F.slice(parts, 1, most), " ")
    cut = F.regexp_replace(F.array_join(F.slice(words(kept), 1, limit), " "), "[,;:-]+$", "")
    hard = F.when(cut.rlike("[.?]$"), cut).otherwise(F.concat(cut, F.lit(".")))
    mode = F.when(word_count(x) <= limit, "none").when(word_count(kept) <= limit, "sentence").otherwise("hard")
    return F.struct(F.when(mode == "none", x).when(mode == "sentence", kept).otherwise(hard).alias("text"), mode.alias("mode"))


def truncate_words(x: Column, limit: int) -> Column:
    """The first limit words; cut at the last full stop where that lies past half, else marks at the end give way to a full stop."""
    cut = F.array_join(F.slice(words(x), 1, limit), " ")
    n = F.length(cut)
    at = F.when(F.instr(cut, ".") == 0, F.lit(-1)).otherwise(n - F.instr(F.reverse(cut), "."))
    short = F.when(at > F.floor(n / 2), F.substring(cut, F.lit(1), at + 1)).otherwise(F.concat(F.regexp_replace(cut, "[,;:]+$", ""), F.lit(".")))
    return F.when(word_count(x) <= limit, x).otherwise(short)


def prefix(x: Column, n: int) -> Column:
    return F.substring(x, 1, n)


def shortened(x: Column, n: int) -> Column:
    """At most n characters, and three dots behind a cut."""
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def title_of_name(x: Column) -> Column:
    """A file name without extension, underscores as spaces."""
    return F.replace(F.regexp_replace(x, r"\.[^.]*$", ""), F.lit("_"), F.lit(" "))


def padded_name(stem: Column, number: Column, digits: int = 3, join: str = "#") -> Column:
    """stem, join, and the number with leading zeros; larger numbers keep all digits."""
    return F.format_string(f"%s{join}%0{digits}d", stem, number)


def html_escape(x: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(mark), F.lit(name))
    return x


def strip_tags(x: Column) -> Column:
    """Text of HTML: scripts, styles and comments out, then tags; spaces squeezed."""
    x = F.regexp_replace(x, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return squeeze(F.regexp_replace(x, r"(?s)<[^>]*>", " "))


def distinct_ignoring_case(x: Column, most: int | None = None) -> Column:
    """An array without later elements that equal an earlier one apart from case; at most the first ones."""
    if most:  # what is kept has a fixed size, so each element is compared with so many at most, and with none behind the last
        none = F.array().cast("array<string>")
        state = lambda v, low: F.struct(v.alias("v"), low.alias("low"))

        def add(s: Column, v: Column) -> Column:
            new = (F.size(s["v"]) < most) & ~F.array_contains(s["low"], F.lower(v))
            return F.when(new, state(F.concat(s["v"], F.array(v)), F.concat(s["low"], F.array(F.lower(v))))).otherwise(s)

        return F.aggregate(x, state(none, none), add, lambda s: s["v"])

    def kept(x: Column) -> Column:
        first = lambda low: F.filter(x, lambda v, i: F.array_position(low, F.get(low, i)) == i + 1)
        return once(F.transform(x, F.lower), first)

    return once(x, kept)


def contains_term(x: Column, term: str, hyphens: bool = True) -> Column:
    """Whether a term stands alone; with hyphens a part of a hyphenated word does not count."""
    edge = r"[\w-]" if hyphens else r"\w"
    return F.lower(x).rlike(rf"(?U)(?<!{edge})\Q{term.lower()}\E(?!{edge})")


def terms_alone(x: Column, terms: Sequence[str], hyphens: bool = True) -> Column:
    """Those of the terms that stand alone in a text, in the order given: contains_term() of all of them in one pass. At a place the longest term
    that stands alone there is found; shorter ones that it begins with stand there too."""
    if not terms:
        return F.array().cast("array<string>")
    edge = r"[\w-]" if hyphens else r"\w"
    lower = list(dict.fromkeys(t.lower() for t in terms))
    either = "|".join(rf"\Q{t}\E" for t in sorted(lower, key=len, reverse=True))
    found = F.regexp_extract_all(F.lower(x), F.lit(rf"(?U)(?=(?<!{edge})({either})(?!{edge}))"), 1)
    ends = lambda c: not (c.isalnum() or c == "_" or hyphens and c == "-")
    for long in lower:
        if begun := [t for t in lower if t != long and long.startswith(t) and ends(long[len(t)])]:
            found = F.when(F.array_contains(found, long), F.concat(found, F.array(*map(F.lit, begun)))).otherwise(found)
    given = F.transform(F.array_intersect(F.array(*map(F.lit, lower)), found), lambda t: t)
    if lower == list(terms):
        return given
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.array_contains(given, F.lower(t)))


def array_or_empty(items: Sequence[Column]) -> Column:
    """An array of those columns that aren't null."""
    return F.array_compact(F.array(*items)) if items else F.array().cast("array<string>")
